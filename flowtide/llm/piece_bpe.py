"""Encoding and decoding with public BPE piece models, by rounds of merges over flat symbol arrays."""

from __future__ import annotations

import codecs
import heapq
import os
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.workers import handing_back
from flowtide.llm.bpe import _id_lists, _slices

#: Units that a worker remembers, and characters in them; beyond either only the units of the texts at hand stay.
REMEMBERED_UNITS = 200_000
REMEMBERED_CHARS = 4_000_000
#: Characters whose units are merged together.
GROUP_CHARS = 1 << 18
#: Rounds after which what still merges one pair at a time (long runs of tied pairs) is finished from a heap.
ROUNDS = 256
#: The visible space of piece models, and the types of pieces in their files.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

_CODE_BITS = 21
_NEVER = np.int32(0x7FFFFFFF)


def _one_by_one(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1  # type: ignore[attr-defined]


codecs.register_error("flowtide-each-byte", _one_by_one)


class PairTable:
    """From pairs of symbol codes to (rank, merged code): open addressing in flat arrays, looked up many at a time."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, codes: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, _NEVER, np.int32)
        self._codes = np.zeros(1 << bits, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self._keys[at[left]] == -1]
            self._keys[at[free]] = keys[free]  # of several keys for one slot, the last stays
            put = left[self._keys[at[left]] == keys[left]]
            self._ranks[at[put]], self._codes[at[put]] = ranks[put], codes[put]
            left = left[self._keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged code of each pair; rank ``_NEVER`` where the pair is none."""
        keys = (left.astype(np.int64) << _CODE_BITS) | right
        at = self._slot(keys)
        there = self._keys[at]
        lost = np.flatnonzero((there != keys) & (there != -1))
        while len(lost):
            at[lost] = (at[lost] + 1) & self._mask
            there = self._keys[at[lost]]
            lost = lost[(there != keys[lost]) & (there != -1)]
        return np.where(self._keys[at] == keys, self._ranks[at], _NEVER), self._codes[at]


class Merges:
    """Merges of pairs of symbol codes by rank; ``made`` lists (left << 21 | right, rank, merged code)."""

    def __init__(self, made: list[tuple[int, int, int]]) -> None:
        self._made = self.columns(made)
        self._pairs = PairTable(*self._made)
        self._ranked: dict[int, tuple[int, int]] = {}

    @staticmethod
    def columns(made: list[tuple[int, int, int]]) -> list[np.ndarray]:
        return [np.array(x, kind) for x, kind in zip(zip(*made, strict=True), (np.int64, np.int32, np.int32), strict=True)]

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged codes of all units, given as consecutive stretches of symbols, and how many each has.

        All units are merged side by side.  A round finds each unit's lowest rank and merges, from the left, every pair of
        that rank that does not overlap another, up to the first whose merge makes a pair of the same or a lower rank: that
        is what merging one pair after another does.  Units without a pair leave the arrays, which are then compacted.
        """
        count = len(lengths)
        name = np.flatnonzero(lengths)
        lengths = lengths[name]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = got = None
        for _ in range(ROUNDS):
            if not len(name):
                break
            last = np.cumsum(lengths) - 1
            first = last - lengths + 1
            if rank is None:
                rank, got = self._pairs.get(symbols[:-1], symbols[1:])
                rank, got = np.append(rank, _NEVER), np.append(got, np.int32(0))
                rank[last] = _NEVER
            least = np.minimum.reduceat(rank, first)
            busy = least != _NEVER
            if not busy.all():
                stays = np.repeat(busy, lengths)
                done.append((name[~busy], lengths[~busy], symbols[~stays]))
                symbols, rank, got, name, lengths, least = symbols[stays], rank[stays], got[stays], name[busy], lengths[busy], least[busy]
                if not len(name):
                    break
                last = np.cumsum(lengths) - 1
                first = last - lengths + 1
            unit = np.repeat(np.arange(len(name)), lengths)
            at = np.flatnonzero(rank == least[unit])
            fresh = np.append(True, np.diff(at) != 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            here, made = unit[at], got[at]
            # What each merge meets at its time: on the left perhaps the merge before it, on the right what stands there now.
            before = symbols[at - 1]
            joined = np.flatnonzero(np.diff(at) == 2) + 1
            joined = joined[here[joined] == here[joined - 1]]
            before[joined] = made[joined - 1]
            low = np.minimum(
                np.where(at > first[here], self._pairs.get(before, made)[0], _NEVER),
                np.where(at + 1 < last[here], self._pairs.get(made, symbols[np.minimum(at + 2, len(symbols) - 1)])[0], _NEVER),
            )
            stops = np.cumsum(low <= least[here])
            own = np.searchsorted(here, here)  # the first merge of the same unit
            stopped = stops - (low <= least[here]) - (stops[own] - (low[own] <= least[here[own]])) > 0
            at, here, made = at[~stopped], here[~stopped], made[~stopped]
            symbols[at] = made
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            place = at - np.arange(len(at))  # each merge so far has taken one symbol out
            symbols, rank, got = symbols[stays], rank[stays], got[stays]
            lengths = lengths - np.bincount(here, minlength=len(name))
            last = np.cumsum(lengths) - 1
            inner = place[place < last[here]]
            rank[place] = _NEVER
            rank[inner], got[inner] = self._pairs.get(symbols[inner], symbols[inner + 1])
            inner = place[place > (last - lengths + 1)[here]] - 1
            rank[inner], got[inner] = self._pairs.get(symbols[inner], symbols[inner + 1])
        at = 0
        for i, n in zip(name.tolist(), lengths.tolist(), strict=True):
            codes = np.array(self.finish(symbols[at : at + n].tolist()), np.int32)
            done.append((np.array([i]), np.array([len(codes)]), codes))
            at += n
        return self._in_order(done, count)

    @staticmethod
    def _in_order(done: list[tuple[np.ndarray, np.ndarray, np.ndarray]], count: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.zeros(count, np.int64)
        for name, lengths, _ in done:
            sizes[name] = lengths
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        for name, lengths, codes in done:
            out[np.arange(len(codes)) + np.repeat(starts[name] - np.cumsum(lengths) + lengths, lengths)] = codes
        return out, sizes

    def finish(self, codes: list[int]) -> list[int]:
        """Merge one pair after another: lowest rank first, leftmost on ties."""
        if not self._ranked:  # few texts need it
            self._ranked = {key: (rank, merged) for key, rank, merged in zip(*(c.tolist() for c in self._made), strict=True)}
        pair, n = self._ranked.get, len(codes)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(p[0], i, codes[i], codes[i + 1]) for i in range(n - 1) if (p := pair(codes[i] << _CODE_BITS | codes[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if codes[i] != a or j < 0 or codes[j] != b:
                continue
            codes[i], codes[j] = pair(a << _CODE_BITS | b)[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := pair(codes[i] << _CODE_BITS | codes[k]):
                    heapq.heappush(heap, (p[0], i, codes[i], codes[k]))
            if (k := before[i]) >= 0 and (p := pair(codes[k] << _CODE_BITS | codes[i])):
                heapq.heappush(heap, (p[0], k, codes[k], codes[i]))
        return [c for c in codes if c >= 0]


class PieceModel:
    """Encoder and decoder of one public piece model file: type BPE, no normalisation, byte fallback, no user-defined pieces.

    A symbol is coded as its piece id, or as the number of pieces plus its code point where a character is no piece.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != pb.TrainerSpec.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not spec.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: only BPE models with byte fallback and without normalisation")
        if {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: piece types that are not supported")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.size = len(spec.pieces)
        pieces = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.begin, self.end = spec.trainer_spec.bos_id, spec.trainer_spec.eos_id
        self._byte = np.array([next(i for i, p in enumerate(spec.pieces) if p.type == BYTE and int(p.piece[1:-1], 16) == b) for b in range(256)], np.uint32)
        self._codes = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for piece, i in pieces.items():
            if len(piece) == 1:
                self._codes[ord(piece)] = i
        code = lambda s: pieces.get(s, self.size + ord(s) if len(s) == 1 else -1)
        order = {score: rank for rank, score in enumerate(sorted({spec.pieces[i].score for i in pieces.values()}, reverse=True))}
        made = [
            (code(piece[:k]) << _CODE_BITS | code(piece[k:]), order[spec.pieces[i].score], i)
            for piece, i in pieces.items() for k in range(1, len(piece)) if code(piece[:k]) >= 0 and code(piece[k:]) >= 0
        ]
        self.merges = Merges(made)
        #: Whether no piece goes on with a space behind another character, and whether none holds a line end.
        self._by_space = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self._by_line = not any("\n" in p for p in pieces)
        #: The bytes that each id stands for, its piece's visible spaces being spaces.
        self.bytes = [
            b"" if p.type == CONTROL else spec.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode()
            for p in spec.pieces
        ]
        self.control = frozenset(i for i, p in enumerate(spec.pieces) if p.type == CONTROL)
        self._led = frozenset(i for p, i in pieces.items() if p[0] == SPACE)
        self._known: dict[str, bytes] = {}
        self._known_chars = 0

    def units(self, text: str) -> list[str]:
        """Stretches of a text, spaces made visible, whose borders no piece crosses; empty ones are harmless."""
        if not text:
            return []
        shown = self.prefix + text.replace(" ", SPACE)
        if not self._by_space:
            return [shown]
        if SPACE + SPACE in shown or " " in shown:
            return re.findall(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+" if self._by_line else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", shown)
        if self._by_line and "\n" in shown:
            shown = shown.replace("\n", " \n ")
        return shown.replace(SPACE, " " + SPACE).split(" ")

    def symbols(self, shown: str) -> np.ndarray:
        """The symbol codes of a text whose spaces are visible."""
        return self._codes[np.frombuffer(shown.encode("utf-32-le"), np.uint32)]

    def merged(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, 32-bit little-endian unsigned integers."""
        codes, sizes = self.merges.run(self.symbols("".join(units)), np.fromiter(map(len, units), np.int64, len(units)))
        ids, ends = self.ids(codes, sizes)
        raw, ends = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [raw[x:y] for x, y in pairwise(ends)]

    def ids(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of codes, characters that are no piece as the ids of their bytes; and where each of ``sizes`` codes end."""
        ends = np.cumsum(sizes)
        odd = np.flatnonzero(codes >= self.size)
        if not len(odd):
            return codes.astype("<u4"), ends
        raw = [chr(c - self.size).encode() for c in codes[odd].tolist()]
        wide = np.ones(len(codes), np.int64)
        wide[odd] = list(map(len, raw))
        ids = np.repeat(codes, wide).astype("<u4")
        ids[np.repeat(codes >= self.size, wide)] = self._byte[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, np.concatenate(([0], np.cumsum(wide)))[ends]

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """The ids of all units, merged now or remembered."""
        new = units.difference(self._known)
        chars = sum(map(len, new))
        if len(self._known) + len(new) > REMEMBERED_UNITS or self._known_chars + chars > REMEMBERED_CHARS:
            self._known = {u: self._known[u] for u in units if u in self._known}
            self._known_chars = sum(map(len, self._known))
        self._known_chars += chars
        group: list[str] = []
        size = 0
        for unit in new:
            group.append(unit)
            size += len(unit)
            if size >= GROUP_CHARS:
                self._known.update(zip(group, self.merged(group), strict=True))
                group, size = [], 0
        self._known.update(zip(group, self.merged(group), strict=True))
        return self._known

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text without begin and end, 32-bit little-endian unsigned integers."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= GROUP_CHARS):
                chars += len(texts[end])
                end += 1
            split = [self.units(t) for t in texts[at:end]]
            get = self.learn(set().union(*split)).__getitem__
            for units in split:
                yield b"".join(map(get, units))
            at = end

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: the first piece loses the space put before every text, control pieces are nothing."""
        if self.control.isdisjoint(ids[1:-1]):
            a, b = (1 if ids and ids[0] in self.control else 0), (len(ids) - 1 if len(ids) > 1 and ids[-1] in self.control else len(ids))
            runs = [ids[a:b]]
        else:  # bytes on both sides of a control piece are not joined
            runs = [[]]
            for i in ids:
                if i in self.control:
                    runs.append([])
                else:
                    runs[-1].append(i)
            runs = [r for r in runs if r] or [[]]
        parts = [b"".join(map(self.bytes.__getitem__, r)).decode("utf-8", "flowtide-each-byte") for r in runs]
        if self.prefix and runs[0] and runs[0][0] in self._led:
            parts[0] = parts[0][1:]
        return "".join(parts)


_LOADED: dict[str, PieceModel] = {}


def piece_model(name: str = "piece_bpe_32k.model", path: str | None = None) -> Callable[[], PieceModel]:
    """A loader to send to tasks: the public file ``name``, or ``path`` where a cluster keeps its own copy; read once a process."""

    def load() -> PieceModel:
        found = path
        if found is None or not os.path.exists(found):
            import public_tokenizers

            found = public_tokenizers.path(name)
        if found not in _LOADED:
            _LOADED[found] = PieceModel(found)
        return _LOADED[found]

    return load


def _parts(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose binary or list column holds about ``most`` bytes together; a larger row comes alone."""
    values = batch.column(column)
    sizes = pc.binary_length(values) if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else pc.multiply(pc.list_value_length(values), 4)
    total = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def encode_pieces(
    docs: DataFrame, load: Callable[[], PieceModel], id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True, packed: bool = False,
) -> DataFrame:
    """``(id_col, ids)`` per row: the text's piece ids, ``array<int>`` or, ``packed``, 32-bit little-endian integers as binary.

    Null text counts as empty: the begin and end ids alone, where asked for.  Strings of control pieces in a text are plain
    text.  Ids may be null or repeated; each row is encoded by itself.  Extra columns are ignored.  Memory is bounded by one
    group of texts, or one longer text, and the remembered units of a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load()
        head, tail = (np.array([i], "<u4").tobytes() if on else b"" for i, on in ((m.begin, begin), (m.end, end)))
        for batch in batches:
            for part in _slices(batch, "text"):
                ids = [head + x + tail for x in m.encode([x or "" for x in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.binary()) if packed else _id_lists(ids)], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(handing_back(run), f"id {kind}, ids {'binary' if packed else 'array<int>'}").select(F.col("id").alias(id_col), "ids")


def decode_pieces(encoded: DataFrame, load: Callable[[], PieceModel], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, ids, text)`` per row: the text that the ids (an array, or packed) stand for.

    Null ids give null text, no ids the empty text; a byte that is no UTF-8 becomes U+FFFD.  Extra columns are ignored.
    """
    packed = dict(encoded.dtypes)[ids_col] == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load()
        for batch in batches:
            for part in _parts(batch, "ids"):
                texts = [
                    None if not v.is_valid else m.decode(np.frombuffer(v.as_buffer(), "<u4").tolist() if packed else v.values.to_numpy().tolist())
                    for v in part.column("ids")
                ]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("binary" if packed else "array<int>").alias("ids"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(handing_back(run), f"id {kinds['id']}, ids {kinds['ids']}, text string").select(F.col("id").alias(id_col), "ids", "text")
