"""Language of texts by a linear-chain conditional random field over words, so that text may switch languages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.bpe import _slices

#: Bounds of the training sample: distinct stretches of lines of each language, fewer where together they pass the second
#: number, and characters of a stretch.
LINES, ALL_LINES, STRETCH = 800, 25_600, 400
#: Shorter stretches train only languages that lack longer ones.
SHORT = 20
#: Hashed features; the model is FEATURES numbers a language, which are broadcast.
BITS = 17
FEATURES = 1 << BITS
LEXICON = 500
ROUNDS, RATE, SHRINK = 30, 0.1, 1e-4
#: Words of a training sequence that come from one line before the language may change, and how often it does.
SWITCH = 0.3
#: Words of a text that are chained in one vectorised step, and words whose scores a worker remembers.
SEGMENT = 128
REMEMBERED = 300_000

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters and the like in lower case; a run without a letter (``½``, ``²``) is no word."""
    return [w for w in _WORDS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def word_features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-case words, one word's after another's, and how many each word has.

    They are the word's first and last one to three characters, its n-grams of one to four characters between marks, its
    lexicon entries and a constant.  All words are hashed at once: a gram's hash follows from the one that is a character
    shorter.
    """
    marked = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    starts, own = ends - lengths, np.repeat(np.arange(len(words)), lengths)
    left = ends[own] - np.arange(len(marked))  # characters from here to the word's end, the mark included
    gram = np.zeros(len(marked), np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(owners: np.ndarray, hashes: np.ndarray, salt: int) -> None:
        mixed = (hashes ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((owners, ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)))

    for k in (1, 2, 3, 4):
        here = np.flatnonzero(left >= k)
        gram[here] = gram[here] * np.uint64(0x100000001B3) + marked[here + k - 1] + np.uint64(1)
        add(own[here], gram[here], k)
        if k < 4:  # an affix is a gram that starts behind the first mark or ends before the last one
            long = np.flatnonzero(lengths - 2 >= k)
            add(long, gram[starts[long] + 1], 16 + k)
            add(long, gram[ends[long] - 1 - k], 32 + k)
    listed = [(i, k) for i, w in enumerate(words) for k in lexicon.get(w, ())]
    add(np.array([i for i, _ in listed], np.int64), np.array([k for _, k in listed], np.uint64), 48)
    add(np.arange(len(words)), np.zeros(len(words), np.uint64), 64)
    owners, features = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(owners, kind="stable")
    return features[order], np.bincount(owners, minlength=len(words))


class Chains:
    """Word positions of many sequences, cut into segments of equal length for vectorised recursions."""

    def __init__(self, lengths: np.ndarray, segment: int = SEGMENT) -> None:
        counts = -(-lengths // segment)
        self.first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.counts, self.segment = counts, segment
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        own = np.repeat(np.arange(len(lengths)), counts)
        k = np.arange(len(own)) - self.first[own]
        self.begin = starts[own] + k * segment
        self.size = np.minimum(segment, lengths[own] - k * segment)
        self.total = int(lengths.sum())

    def posteriors(self, scores: np.ndarray, start: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
        """Label probabilities of each word by forward-backward; with ``pairs`` expected transitions and log-likelihood's normaliser.

        Every segment first becomes one matrix; segments are chained; then words inside all segments are resolved.
        """
        labels, n = scores.shape[1], len(self.begin)
        top = scores.max(axis=1, keepdims=True) if len(scores) else scores[:, :1]
        weight = np.exp(scores - top)
        step, begin = np.exp(transition), np.exp(start)
        at = lambda t: np.minimum(self.begin + t, self.total - 1)
        live = lambda t: t < self.size
        longest = int(self.size.max(initial=0))
        most = int(self.counts.max(initial=0))
        seg = self.first[self.counts > 0]  # the segments that begin a sequence: nothing comes before, the start weight does
        matrix = np.broadcast_to(np.eye(labels), (n if most > 1 else 0, labels, labels)).copy()
        for t in range(longest if most > 1 else 0):
            grown = (matrix @ step) * weight[at(t)][:, None, :]
            if t == 0:
                grown[seg] = (begin * weight[self.begin[seg]])[:, None, :]
            grown /= grown.max(axis=(1, 2), keepdims=True)
            matrix = np.where(live(t)[:, None, None], grown, matrix)
        enter, leave = np.zeros((n, labels)), np.ones((n, labels))
        enter[seg, 0] = 1.0
        for k in range(1, most):
            cur = (self.first + k)[self.counts > k]
            v = np.einsum("ij,ijk->ik", enter[cur - 1], matrix[cur - 1])
            enter[cur] = v / v.max(axis=1, keepdims=True)
        for k in range(most - 2, -1, -1):
            cur = (self.first + k)[self.counts > k + 1]
            v = np.einsum("ijk,ik->ij", matrix[cur + 1], leave[cur + 1])
            leave[cur] = v / v.max(axis=1, keepdims=True)
        forward, backward = np.zeros_like(weight), np.zeros_like(weight)
        a, norm = enter, 0.0
        for t in range(longest):
            m, i = live(t), at(t)
            new = (a @ step) * weight[i]
            if t == 0:
                new[seg] = begin * weight[i[seg]]
            total = new.sum(axis=1, keepdims=True)
            new = new / total
            if pairs:
                norm += float(np.log(total[m]).sum())
            a = np.where(m[:, None], new, a)
            forward[i[m]] = new[m]
        b = leave
        for t in range(longest - 1, -1, -1):
            m, i = live(t), at(t)
            backward[i[m]] = b[m]
            new = (weight[i] * b) @ step.T
            b = np.where(m[:, None], new / new.max(axis=1, keepdims=True), b)
        out = forward * backward
        out /= out.sum(axis=1, keepdims=True)
        expected = np.zeros((labels, labels))
        if pairs:
            inner = np.ones(self.total, bool)
            inner[self.begin[seg]] = False
            j = np.flatnonzero(inner)
            before, after = forward[j - 1], weight[j] * backward[j]
            expected = step * ((before / ((before @ step) * after).sum(axis=1, keepdims=True)).T @ after)
        return out, expected, norm


def _segment(labels: int) -> int:
    """Segment length: a segment's matrix costs as much as ``labels`` passes, so with many labels texts are chained whole."""
    return SEGMENT if labels <= 16 else 1 << 40


def train(lines: list[tuple[str, str]]) -> dict:
    """Model from ``(language, line)`` pairs, a bounded sample: deterministic, full-batch, adaptive gradient steps."""
    languages = sorted({lang for lang, _ in lines})
    index = {lang: k for k, lang in enumerate(languages)}
    counts: dict[str, Counter] = {}
    split = [(index[lang], words_of(line)) for lang, line in lines]
    split = [(k, ws) for k, ws in split if ws]
    for k, ws in split:
        for w in ws:
            counts.setdefault(w, Counter())[k] += 1
    lexicon: dict[str, tuple[int, ...]] = {}
    for k in range(len(languages)):
        own = sorted(((c[k], w) for w, c in counts.items() if c[k] >= 3 and c[k] >= 0.9 * c.total()), key=lambda x: (-x[0], x[1]))
        for _, w in own[:LEXICON]:
            lexicon[w] = (*lexicon.get(w, ()), k)
    model = {"languages": languages, "lexicon": lexicon, "weights": np.zeros((FEATURES, max(1, len(languages))), np.float32)}
    labels = len(languages)
    model["start"], model["transition"] = np.zeros(max(1, labels)), np.zeros((max(1, labels), max(1, labels)))
    if labels < 2:
        return model
    # Neighbouring lines, mixed over languages, are joined so that transitions can be learned.
    rng = np.random.default_rng(0)
    order = rng.permutation(len(split))
    sequences: list[list[tuple[int, str]]] = []
    for i in order:
        k, ws = split[i]
        if not sequences or rng.random() >= SWITCH:
            sequences.append([])
        sequences[-1] += [(k, w) for w in ws]
    lengths = np.array([len(s) for s in sequences])
    gold = np.array([k for s in sequences for k, _ in s])
    vocabulary = {w: i for i, w in enumerate(sorted(counts))}
    word = np.array([vocabulary[w] for s in sequences for _, w in s])
    flat, sizes = word_features(list(vocabulary), lexicon)
    at = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    chains = Chains(lengths, _segment(labels))
    firsts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    inner = np.ones(len(gold), bool)
    inner[firsts] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (gold[j - 1], gold[j]), 1)
    one = np.eye(labels)[gold]
    weights, start, transition = np.zeros((FEATURES, labels)), np.zeros(labels), np.zeros((labels, labels))
    sums = [np.full_like(x, 1e-8) for x in (weights, start, transition)]
    n = len(gold)
    for _ in range(ROUNDS):
        scores = np.add.reduceat(weights[flat], at, axis=0)[word]
        p, expected, _ = chains.posteriors(scores, start, transition, pairs=True)
        miss = one - p
        by_word = np.stack([np.bincount(word, miss[:, k], len(sizes)) for k in range(labels)], axis=1)
        gradients = (
            np.stack([np.bincount(flat, by_word[row, k], FEATURES) for k in range(labels)], axis=1) / n - SHRINK * weights,
            miss[firsts].sum(axis=0) / n - SHRINK * start,
            (seen - expected) / n - SHRINK * transition,
        )
        for x, g, s in zip((weights, start, transition), gradients, sums, strict=True):
            s += g * g
            x += RATE * g / np.sqrt(s)
    model |= {"weights": weights.astype(np.float32), "start": start, "transition": transition}
    return model


class Labeller:
    """Scores words of a trained model, remembering the words it has met."""

    def __init__(self, model: dict) -> None:
        self.model = model
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(model["languages"])))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.rows]
        if len(self.rows) + len(new) > REMEMBERED:
            self.rows, self.scores, new = {}, self.scores[:0], list(words)
        if new:
            flat, sizes = word_features(new, self.model["lexicon"])
            own = np.add.reduceat(self.model["weights"][flat], np.cumsum(sizes) - sizes, axis=0)
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, own])

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``(language, mean posterior of its words)`` of each text; ``und`` and 0 without a letter."""
        languages = self.model["languages"]
        split = [words_of(t) if t else [] for t in texts]
        lengths = np.array([len(s) for s in split], dtype=np.int64)
        if not languages or not lengths.sum():
            return [("und", 0.0)] * len(texts)
        self._learn({w for s in split for w in s})
        get = self.rows.__getitem__
        ids = np.fromiter((get(w) for s in split for w in s), np.int64, int(lengths.sum()))
        some = np.flatnonzero(lengths)
        p, _, _ = Chains(lengths[some], _segment(len(languages))).posteriors(self.scores[ids], self.model["start"], self.model["transition"])
        means = np.add.reduceat(p, np.concatenate(([0], np.cumsum(lengths[some])))[:-1], axis=0) / lengths[some][:, None]
        out = [("und", 0.0)] * len(texts)
        for i, m in zip(some, means, strict=True):
            k = int(m.argmax())
            out[i] = (languages[k], float(min(1.0, max(0.0, m[k]))))
        return out


def training_lines(labelled: DataFrame, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """A bounded sample: of each language the ``LINES`` distinct stretches of smallest hash, short ones after all others.

    With more than 32 languages it is an equal part of ``ALL_LINES``, one at least.

    A stretch is a line, or a part of at most ``STRETCH`` characters, ended at white space where there is any; those of every
    labelled text take part, wherever they stand.  Only hashes below a bound are ranked; it goes by the number of distinct
    stretches, so that some four times as many as are wanted lie below, however often each repeats.  The driver gets one row a
    language, and the sample.
    """
    cut_up = F.expr(rf"regexp_extract_all(text, '(?:[^\n]{{1,{STRETCH}}}(?=\\s|$)|[^\n]{{1,{STRETCH}}})', 0)")
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    rows = rows.select("lang", F.explode(cut_up).alias("line")).where(F.col("line").rlike(r"\p{L}"))
    rows = rows.select("lang", "line", (F.length("line") < SHORT).alias("short"), F.xxhash64("line").alias("o"))
    sizes = rows.groupBy("lang", "short").agg(F.approx_count_distinct("o").alias("distinct")).collect()
    if not sizes:
        return []
    most = max(1, min(LINES, ALL_LINES // len({r["lang"] for r in sizes})))
    bound = lambda n: min(2**63 - 1, 2**64 * 4 * max(most, 100) // max(n, 1) - 2**63)
    limits = labelled.sparkSession.createDataFrame([(r["lang"], r["short"], bound(r["distinct"])) for r in sizes], "lang string, short boolean, bound bigint")
    few = rows.join(F.broadcast(limits), ["lang", "short"]).where("o <= bound").select("lang", "line", "short", "o").distinct()
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("short", "o", "line"))).where(F.col("r") <= most)
    return [(r["lang"], r["line"]) for r in ranked.orderBy("lang", "r").collect()]


def identify_languages(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` per row, from the text alone.

    Null texts and texts without a letter are ``und`` with score 0.  Rows are independent; whole texts are read; extra
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for part in _slices(batch, "text"):
                labels = labeller.label(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([x for x, _ in labels], pa.string()), pa.array([s for _, s in labels], pa.float64())], names=["id", "lang_pred", "score"]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """One row in five, by crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` per row; trained on the rows that are not held out and have a language.

    Runs jobs.  Without any labelled row every text is ``und``; an empty table gives an empty result.
    """
    model = train(training_lines(docs.where(~held_out(id_col)), text_col, lang_col))
    return identify_languages(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
