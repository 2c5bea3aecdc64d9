"""Byte-pair encoding and decoding of documents; words that share a prefix share its encoding."""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.workers import handing_back

if TYPE_CHECKING:
    from flowtide.llm.piece_bpe import Merges

#: Words, and pairs of tokens, that a worker remembers; beyond it only the words of the texts at hand stay.
REMEMBERED_WORDS = 300_000
REMEMBERED_PAIRS = 300_000
#: Characters of text whose words are encoded together.
GROUP_CHARS = 1 << 18
#: Symbols of words that walk the trie depth by depth; longer ones walk it one by one.
WALKED_SYMBOLS = 48
#: Pairs of tokens, a power of two, whose stability the walk by depth remembers.
REMEMBERED_SLOTS = 1 << 19
#: First stand-in for "byte at the end of a word", in a private-use area that byte alphabets do not reach.
_FINAL = 0xE000
_NEVER = 1 << 60
#: White space to Python that is none to the vocabularies' patterns.
_NO_SPACE = "\x1c\x1d\x1e\x1f"


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it can be shown, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_LOOSE_SPACE = regex.compile(r" (?!\S)")


class Trie:
    """Encodings of words over an alphabet of single-character symbols.

    The encoding of a prefix is the encoding of a shorter prefix and one last token, the only token there whose pair with
    the token before it is stable (merging the two anew gives the same two).  So one last token a trie node describes the
    encodings of all words.  ``encode`` walks the trie of the given words depth first, in sorted order, keeping the states
    of the current path only: what two neighbours share is computed once, and the trie is never held whole.  ``walk`` takes
    sorted words of bounded length and walks all nodes of one depth together.
    """

    def __init__(self, ids: dict[str, int], merges: dict[tuple[str, str], int]) -> None:
        self.merges = merges
        self.codes = {token: array("I", [i]).tobytes() for token, i in ids.items()}
        #: Length of the longest token that ends in two symbols.
        self.tails: dict[str, int] = {}
        for token in ids:
            if len(token) > 1:
                self.tails[token[-2:]] = max(self.tails.get(token[-2:], 0), len(token))
        self._made: dict[str, tuple[str, str, int]] = {}
        for (a, b), rank in sorted(merges.items(), key=lambda m: m[1]):
            self._made.setdefault(a + b, (a, b, rank))
        self._own: dict[str, bool] = {}
        self._spines: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self._stable: dict[tuple[str, str], bool] = {}
        self._walker: _Walker | None = None

    def merged(self, word: str) -> list[str]:
        """The encoding by definition: the leftmost pair of lowest rank is merged until none is left."""
        parts, rank = list(word), self.merges.get
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.merges:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _whole(self, token: str) -> bool:
        """Whether the token is its own encoding."""
        got = self._own.get(token)
        if got is None:
            got = self._own[token] = self.merged(token) == [token]
        return got

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """What stands at one end of the token (0: left, 1: right) as it is merged, and the rank that makes each."""
        spine = []
        while token in self._made:
            *halves, rank = self._made[token]
            spine.append((token, rank))
            token = halves[side]
        spine.append((token, -1))
        return spine[::-1]

    def _fits(self, before: str, token: str) -> bool:
        got = self._stable.get((before, token))
        if got is None:
            if len(self._stable) >= REMEMBERED_PAIRS:
                self._stable.clear()
            got = self._stable[before, token] = self._whole(token) and (not before or self._apart(before, token))
        return got

    def _apart(self, before: str, token: str) -> bool:
        """Whether no merge crosses the border while both sides are built up, lowest rank first and leftmost on ties."""
        left, right = (self._spines.get(k) or self._spines.setdefault(k, self._spine(*k)) for k in ((before, 1), (token, 0)))
        i = j = 0
        while True:
            next_left = left[i + 1][1] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1][1] if j + 1 < len(right) else _NEVER
            cross = self.merges.get((left[i][0], right[j][0]), _NEVER)
            if cross < next_left and cross <= next_right and cross < _NEVER:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word with its ids, 32-bit unsigned integers in this machine's byte order."""
        codes, tails, stable, fits = self.codes, self.tails, self._stable, self._fits
        # For the current word's first i symbols: the last token of their encoding, and the encoding.
        last, done = [""], [b""]
        previous = ""
        for word in sorted(set(words)):
            if word.startswith(previous):
                shared = len(previous)
            else:
                shared = 0
                for a, b in zip(word, previous, strict=False):
                    if a != b:
                        break
                    shared += 1
                del last[shared + 1 :], done[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                most = tails.get(word[end - 2 : end], 1) if end > 1 else 1
                for start in range(end - most if end > most else 0, end):
                    token = word[start:end]
                    if token in codes:
                        pair = last[start], token
                        fit = stable.get(pair)
                        if fit or fit is None and fits(*pair):
                            last.append(token)
                            done.append(done[start] + codes[token])
                            break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            previous = word
            yield word, done[-1]

    def walk(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, given in an order that keeps equal prefixes together, and how many each has.

        ``symbols``, the words one after another, are ids of tokens of one symbol; each word has one symbol at least.
        """
        return self.walker().walk(symbols, lengths)

    def walker(self) -> _Walker:
        if self._walker is None:
            self._walker = _Walker(self)
        return self._walker


class _Walker:
    """Walks the trie of many words depth by depth, in flat arrays.

    A node keeps its last token, the node before that token and how many tokens lead to it.
    """

    def __init__(self, trie: Trie) -> None:
        from flowtide.llm.piece_bpe import Merges, PairTable

        self._whole, ids = trie._whole, {t: int.from_bytes(c, sys.byteorder) for t, c in trie.codes.items()}
        count = max(ids.values()) + 1
        self._token = {i: t for t, i in ids.items()}
        self._own = np.full(count, -1, np.int8)  # whether a token is its own encoding, -1 unknown
        # Prefixes of tokens: those of one symbol are numbered like their ids.
        states: dict[str, int] = {}
        steps: list[tuple[int, int]] = []
        of_state: list[int] = []
        for token, i in ids.items():
            if len(token) == 1:
                states[token] = i
        free = count
        for token, i in ids.items():
            for end in range(2, len(token) + 1):
                part = token[:end]
                if part not in states:
                    if part[:-1] not in states or part[-1] not in states or states[part[-1]] >= count:
                        break
                    steps.append((states[part[:-1]] << 21 | states[part[-1]], free))
                    states[part] = free
                    free += 1
        self._of_state = np.full(free, -1, np.int32)
        for token, i in ids.items():
            if token in states:
                self._of_state[states[token]] = i
        keys, codes = (np.array(x, kind) for x, kind in zip(zip(*steps, strict=True), (np.int64, np.int32), strict=True)) if steps else (np.empty(0, np.int64), np.empty(0, np.int32))
        self._steps = PairTable(keys, np.zeros(len(keys), np.int32), codes)
        self._merges = PairTable(*Merges.columns([(ids[a] << 21 | ids[b], rank, ids[a + b]) for (a, b), rank in trie.merges.items()]))
        # How each token is made: its halves and the rank that joins them, -1 for a single symbol.
        self._half, self._rank = np.zeros((2, count), np.int32), np.full(count, -1, np.int32)
        for (a, b), rank in sorted(trie.merges.items(), key=lambda m: -m[1]):
            i = ids[a + b]
            self._half[0, i], self._half[1, i], self._rank[i] = ids[a], ids[b], rank
        made = np.flatnonzero(self._rank >= 0)
        #: Whether every token is made after its halves, which walking back from it needs.
        self.ordered = bool((self._rank[self._half[:, made]] < self._rank[made]).all())
        self._slot_keys, self._slot_fits = np.full(REMEMBERED_SLOTS, -1, np.int64), np.zeros(REMEMBERED_SLOTS, bool)

    def walk(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = len(lengths)
        if not count:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        deepest, ends = int(lengths.max()), np.cumsum(lengths)
        starts = ends - lengths
        # Symbols in rows of words; how many of its first symbols a word shares with the word before it.
        inside = np.arange(deepest) < lengths[:, None]
        rows = np.full((count, deepest), -1, np.int32)
        rows[inside] = symbols
        shared = np.zeros(count, np.int64)
        shared[1:] = np.minimum(np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1).sum(axis=1), np.minimum(lengths[1:], lengths[:-1]))
        # Nodes: the root, then all of depth 1, all of depth 2 and so on.
        fresh = inside & (np.arange(deepest) >= shared[:, None])
        of_depth = fresh.sum(axis=0)
        first = 1 + np.cumsum(of_depth) - of_depth
        node = np.zeros((count, deepest + 1), np.int32)
        node[:, 1:] = np.cumsum(fresh, axis=0) - 1 + first
        # Tokens that end at a node: grow from every start, drop what is no prefix of a token.
        word, at = np.nonzero(inside)
        state, length = rows[inside].astype(np.int32), 1
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            token = self._of_state[state]
            good = np.flatnonzero((token >= 0) & (at + length > shared[word]))
            found.append((node[word[good], at[good] + length], node[word[good], at[good]], token[good]))
            goes = np.flatnonzero(at + length < lengths[word])
            word, at, state = word[goes], at[goes], state[goes]
            there, state = self._steps.get(state, rows[word, at + length])
            goes = np.flatnonzero(there == 0)
            word, at, state, length = word[goes], at[goes], state[goes], length + 1
        # By node, the longest token first.
        end, begin, token = (np.concatenate(x[::-1]) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        end, begin, token = end[order], begin[order], token[order]
        total = int(first[-1] + of_depth[-1])
        from_ = np.searchsorted(end, np.arange(total + 1))
        last, before, size = np.full(total, -1, np.int32), np.zeros(total, np.int32), np.zeros(total, np.int32)
        for depth in range(deepest):
            nodes = np.arange(first[depth], first[depth] + of_depth[depth])
            tried = from_[nodes]
            while len(nodes):
                if (tried == from_[nodes + 1]).any():
                    raise ValueError("no token ends a word's first symbols")
                left = last[begin[tried]]
                fits = self._fits(left, token[tried])
                here, taken = nodes[fits], tried[fits]
                last[here], before[here], size[here] = token[taken], begin[taken], size[begin[taken]] + 1
                nodes, tried = nodes[~fits], tried[~fits] + 1
        # Back from each word's end.
        now = node[np.arange(count), lengths]
        sizes = size[now].astype(np.int64)
        put = np.cumsum(sizes) - 1
        out = np.empty(int(sizes.sum()), np.int32)
        while len(now):
            out[put] = last[now]
            now, put = before[now], put - 1
            goes = now > 0
            now, put = now[goes], put[goes]
        return out, sizes

    def _fits(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token, its own encoding, is stable behind the one on its left (-1: none)."""
        own = self._own[token]
        for i in np.unique(token[own < 0]).tolist():
            self._own[i] = self._whole(self._token[i])
        fits = self._own[token] == 1
        asked = np.flatnonzero(fits & (left >= 0))
        keys = left[asked].astype(np.int64) << 21 | token[asked]
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (REMEMBERED_SLOTS - 1)
        known = self._slot_keys[slots] == keys
        fits[asked] = self._slot_fits[slots]
        new = np.flatnonzero(~known)
        if len(new):
            apart = self._apart(left[asked[new]], token[asked[new]])
            fits[asked[new]] = apart
            # Of several pairs for one slot the last stays, key and answer alike.
            self._slot_keys[slots[new]] = keys[new]
            mine = self._slot_keys[slots[new]] == keys[new]
            self._slot_fits[slots[new][mine]] = apart[mine]
        return fits

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As ``Trie._apart``, from the other end: the last of all steps on either side is undone first.

        The two sides are met in the states that they pass through while they are built up; the pair's rank in each must
        not be lower than what either side does next.
        """
        apart = np.ones(len(left), bool)
        never = np.int64(_NEVER)
        at, x, y = np.arange(len(left)), left.copy(), right.copy()
        next_x, next_y = np.full(len(left), never), np.full(len(left), never)
        while len(at):
            cross = self._merges.get(x, y)[0].astype(np.int64)
            cross[cross == 0x7FFFFFFF] = never
            crossed = (cross < next_x) & (cross <= next_y) & (cross < never)
            apart[at[crossed]] = False
            rank_x, rank_y = self._rank[x].astype(np.int64), self._rank[y].astype(np.int64)
            goes = ~crossed & ((rank_x >= 0) | (rank_y >= 0))
            at, x, y, next_x, next_y, rank_x, rank_y = (v[goes] for v in (at, x, y, next_x, next_y, rank_x, rank_y))
            # Of two steps of one rank the left one comes first, so the right one is undone first.
            undo = rank_x > rank_y
            next_x, next_y = np.where(undo, rank_x, next_x), np.where(undo, next_y, rank_y)
            x, y = np.where(undo, self._half[1][x], x), np.where(undo, y, self._half[0][y])
        return apart


class Tokenizer:
    """Encoder and decoder of one public vocabulary file in the tokenizers library's JSON format (model type BPE)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.suffix = bool(suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.alphabet = _byte_alphabet()
        self._final = {c: chr(_FINAL + i) for i, c in enumerate(self.alphabet)}

        def symbols(token: str) -> str:
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                token = token[: -len(suffix)]
                return token[:-1] + self._final[token[-1]]
            return token

        vocabulary = {t: i for t, i in model["vocab"].items() if t not in self.special}
        ids = {symbols(t): i for t, i in vocabulary.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.trie = Trie(ids, {(symbols(a), symbols(b)): r for r, (a, b) in enumerate(pairs)})
        code = {ord(c): b for b, c in enumerate(self.alphabet)} | {_FINAL + b: b for b in range(256)}
        # What each id stands for in a decoded text.
        self.bytes: list[bytes] = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for t, i in ids.items():
            self.bytes[i] = bytes(code[ord(c)] for c in t) + (b" " if suffix and _FINAL <= ord(t[-1]) < _FINAL + 256 else b"")
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        splitter = spec["pre_tokenizer"]
        steps = splitter.get("pretokenizers", [splitter])
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        normalizers = [n["type"] for n in ((spec["normalizer"] or {}).get("normalizers") or ([spec["normalizer"]] if spec["normalizer"] else []))]
        self.nfc, self.lower = "NFC" in normalizers, "Lowercase" in normalizers
        # Fixed value: the pattern of the byte-level pre-tokenizer when the file names none.
        self._words = regex.compile(split or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        #: Whether the pattern drops white space, so that words never depend on what lies beyond it.
        self._dropped = split is not None and not regex.search(split, " ")
        self._known: dict[str, bytes] = {}
        self._side_by_side: Merges | None = None
        self._symbol_ids: tuple[np.ndarray, np.ndarray] | None = None

    def _units(self, text: str) -> list[str]:
        """Stretches of a text that are split into words by themselves: shorter than the text, longer than words.

        Where white space is dropped, what stands between it.  Where a word may take one space along, the text is cut before
        each space, unless a space is followed by more white space or ends the text; then the words themselves.
        """
        if self._dropped:
            return self._words(text) if any(c in text for c in _NO_SPACE) else text.split()
        if not text or _LOOSE_SPACE.search(text):
            return self._words(text)
        first, *rest = text.split(" ")
        units = [" " + u for u in rest]
        return [first, *units] if first else units

    def _normal(self, text: str) -> str:
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # each character by itself, so no rule for the end of a word
            text = text.replace("Σ", "σ").lower()
        return text

    def _pieces(self, text: str) -> list[list[str] | int]:
        """Runs of units, and the ids of special tokens between them."""
        if self._special is None or not self._special.search(text):
            return [self._units(self._normal(text))]
        out: list[list[str] | int] = []
        at = 0
        for m in self._special.finditer(text):
            out += [self._units(self._normal(text[at : m.start()])), self.special[m.group()]]
            at = m.end()
        return [*out, self._units(self._normal(text[at:]))]

    def _symbols(self, word: str) -> str:
        if word.isascii() and word.isprintable() and " " not in word:
            mapped = word
        else:
            mapped = "".join(map(self.alphabet.__getitem__, word.encode("utf-8", "surrogatepass")))
        return mapped[:-1] + self._final[mapped[-1]] if self.suffix else mapped

    def _merged(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word with its ids, as the trie gives them: all words are merged side by side, in flat arrays."""
        if self._side_by_side is None:
            from flowtide.llm.piece_bpe import Merges

            ids = {t: int.from_bytes(c, sys.byteorder) for t, c in self.trie.codes.items()}
            self._side_by_side = Merges([(ids[a] << 21 | ids[b], rank, ids[a + b]) for (a, b), rank in self.trie.merges.items()])
        return self._each(words, *self._side_by_side.run(*self._flat([w.encode("utf-8", "surrogatepass") for w in words])))

    def _walked(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word with its ids: all words walk the trie together, long ones one by one."""
        words = sorted(words)  # as by their bytes, so words that share their first symbols stand together
        spelled = [w.encode("utf-8", "surrogatepass") for w in words]
        most = WALKED_SYMBOLS if self.trie.walker().ordered else 0
        if max(map(len, spelled), default=0) > most:
            back = {self._symbols(w): w for w, b in zip(words, spelled, strict=True) if len(b) > most}
            for symbols, ids in self.trie.encode(back):
                yield back[symbols], ids
            words = [w for w, b in zip(words, spelled, strict=True) if len(b) <= most]
            spelled = [b for b in spelled if len(b) <= most]
        yield from self._each(words, *self.trie.walk(*self._flat(spelled)))

    def _flat(self, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all symbols of the words, one word after another, and how many each has."""
        if self._symbol_ids is None:
            codes = self.trie.codes
            self._symbol_ids = tuple(np.array([int.from_bytes(codes[c], sys.byteorder) for c in row], np.int32) for row in (self.alphabet, self._final.values() if self.suffix else self.alphabet))
        inner, final = self._symbol_ids
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        data = np.frombuffer(b"".join(spelled), np.uint8)
        symbols, last = inner[data], np.cumsum(lengths) - 1
        symbols[last] = final[data[last]]
        return symbols, lengths

    @staticmethod
    def _each(words: list[str], codes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[str, bytes]]:
        raw, ends = codes.astype(np.uint32).tobytes(), np.cumsum(4 * sizes).tolist()
        yield from zip(words, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True)

    def _learn(self, units: set[str], rounds: bool) -> None:
        """Remember the ids of all units (and of their words, which are units of their own)."""
        new = units.difference(self._known)
        if len(self._known) + len(new) > REMEMBERED_WORDS:
            self._known = {u: self._known[u] for u in units if u in self._known}
            new = units.difference(self._known)
        known, words, fresh, compound = self._known, self._words, set(), []
        for unit in new:
            bare = unit[1:] if unit[0] == " " else unit
            # Letters alone, or with one mark behind them, need no pattern.
            if bare.isalpha():
                fresh.add(unit)
                continue
            parts = [unit[:-1], unit[-1]] if bare[:-1].isalpha() and bare[-1] in ".,;:!?" else words(unit)
            compound.append((unit, parts))
            fresh.update([w for w in parts if w not in known])
        known.update((self._merged if rounds else self._walked)(list(fresh)))
        for unit, parts in compound:
            if unit not in known:
                known[unit] = b"".join([known[w] for w in parts])

    def encode(self, texts: list[str], rounds: bool = False) -> Iterator[bytes]:
        """The ids of each text as 32-bit unsigned integers in this machine's byte order.

        New words walk the trie, or, with ``rounds``, are merged side by side: same ids, less time where most words are new.
        """
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= GROUP_CHARS):
                chars += len(texts[end])
                end += 1
            split = [self._pieces(t) for t in texts[at:end]]
            distinct: set[str] = set()
            for pieces in split:
                for p in pieces:
                    if not isinstance(p, int):
                        distinct.update(p)
            self._learn(distinct, rounds)
            get = self._known.__getitem__
            for pieces in split:
                yield b"".join([array("I", [p]).tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in pieces])
            at = end

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, read once a process."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def vocabulary(name: str, path: str | None = None) -> Callable[[], Tokenizer]:
    """A loader to send to tasks: the public file ``name``, or ``path`` where a cluster keeps its own copy."""

    def load() -> Tokenizer:
        if path is not None and os.path.exists(path):
            return tokenizer(path)
        import public_tokenizers

        return tokenizer(public_tokenizers.path(name))

    return load


def _id_lists(ids: list[bytes | None]) -> pa.Array:
    lengths = np.array([0 if b is None else len(b) // 4 for b in ids], dtype=np.int64)
    values = np.frombuffer(b"".join([b for b in ids if b is not None]), dtype=np.uint32).astype(np.int32)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose column holds about ``most`` bytes together; a larger row comes alone."""
    sizes = np.array([0 if not v.is_valid else v.as_buffer().size if pa.types.is_large_string(v.type) or pa.types.is_string(v.type) else 4 * len(v) for v in batch.column(column)])
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def encode_documents(docs: DataFrame, load: Callable[[], Tokenizer], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` per row: the text's token ids, special-token strings in it included as their ids.

    Null text counts as empty: no ids.  Ids may be null or repeated; each row is encoded by itself.  Extra columns are
    ignored.  Memory is bounded by one group of texts and the remembered words of a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load()
        for batch in batches:
            for part in _slices(batch, "text"):
                ids = list(t.encode([x or "" for x in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("id"), _id_lists(ids)], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(handing_back(run), f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode_documents(encoded: DataFrame, load: Callable[[], Tokenizer], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, ids, text)`` per row: the text that the ids stand for; bytes that are no UTF-8 become U+FFFD.

    Null ids give null text, no ids the empty text.  Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load()
        for batch in batches:
            for part in _slices(batch, "ids"):
                texts = [t.decode(v.values.to_numpy().tolist()) if v.is_valid else None for v in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(handing_back(run), f"id {kind}, ids array<int>, text string").select(F.col("id").alias(id_col), "ids", "text")
