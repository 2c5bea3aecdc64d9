"""Alignment of two tokenizers' tokens over the same texts, and how often each pair is linked in the whole corpus."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.durable import rows_a_batch, scratch_path
from flowtide.functions.workers import handing_back
from flowtide.llm.bpe import _LOOSE_SPACE, Tokenizer
from flowtide.llm.piece_bpe import SPACE, Merges, PieceModel

#: Bytes of text whose links are counted together before they are shuffled; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Rows that tasks get at a time; blocks are gathered from them.
BATCH_ROWS = 256
#: Distinct stretches that are encoded and aligned together.
GROUP_UNITS = 8_000

_UNIT_BORDER = regex.compile(r"(?V1)(?<! )(?= \S)")


class Aligner:
    """Aligns the tokens of a byte-level tokenizer (A) and of a piece model (B), stretch of text by stretch.

    No token of either crosses the border before a space that follows another character and is followed by no white space,
    so the stretches between such borders are aligned by themselves, each distinct one of a block once.
    """

    def __init__(self, a: Tokenizer, b: PieceModel, links: str = "ends") -> None:
        if links not in ("ends", "groups"):
            raise ValueError("links: ends or groups")
        self._b, self._links, self._words = b, links, a._words
        ids = {t: int.from_bytes(c, sys.byteorder) for t, c in a.trie.codes.items()}
        self._base = np.array([ids[c] for c in a.alphabet], np.int32)
        self._merges = Merges([(ids[x] << 21 | ids[y], rank, ids[x + y]) for (x, y), rank in a.trie.merges.items()])
        self._spell_a, self._spell_b = a.bytes, b.bytes
        self._wide_a, self._wide_b = (np.array(list(map(len, x)), np.int64) for x in (a.bytes, b.bytes))
        # An id with what follows it among the groups: another of its side, or the end of its side.
        self._names = [[np.array([f"{i}{mark}" for i in range(len(x))], object) for mark in marks] for x, marks in ((a.bytes, ",|"), (b.bytes, ",;"))]

    def units(self, text: str) -> list[str]:
        shown = " " + text
        if _LOOSE_SPACE.search(shown):
            return [u for u in _UNIT_BORDER.split(shown) if u]
        return [" " + u for u in shown.split(" ")[1:]]

    def _encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's ids and B's ids of all units in a row, and the byte offsets where units end.  Special tokens' strings are plain text."""
        words: list[str] = []
        for u in units:
            if u[0] == " " and u[1:].isalpha():
                words.append(u)
            else:
                words += self._words(u)
        text = "".join(units)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))))
        ends = lambda of: offsets[np.cumsum(np.fromiter(map(len, of), np.int64, len(of)))]
        a, _ = self._merges.run(self._base[np.frombuffer(text.encode(), np.uint8)], np.diff(ends(words), prepend=0))
        shown = text.replace(" ", SPACE)
        b, _ = self._b.ids(*self._b.merges.run(self._b.symbols(shown), np.fromiter(map(len, units), np.int64, len(units))))
        return a, b, ends(units)

    def align(self, units: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each unit ``(n_a, n_b, n_groups)`` (-1 where the tokens do not spell it), its groups and number of links; and all links.

        The ends of A's and of B's tokens are dictionaries from byte offset to index; the offsets in both, in order, cut both
        lists into groups.  A link, 64 bits, is the pair of tokens that end a group, or, for ``groups``, any pair of a group.
        """
        if not units:
            return np.empty((0, 3), np.int64), [], np.empty(0, np.int64), np.empty(0, np.int64)
        a, b, unit_ends = self._encode(units)
        raw = "".join(units).encode()
        spelled = [b"".join(map(spell.__getitem__, ids.tolist())) for spell, ids in ((self._spell_a, a), (self._spell_b, b))]
        if spelled != [raw, raw]:
            good = [i for i, u in enumerate(units) if len(units) > 1 and self.align([u])[0][0, 0] >= 0]
            n, texts, n_links = np.full((len(units), 3), -1, np.int64), [""] * len(units), np.zeros(len(units), np.int64)
            own, own_texts, n_links[good], links = self.align([units[i] for i in good])
            n[good] = own
            for i, t in zip(good, own_texts, strict=True):
                texts[i] = t
            return n, texts, n_links, links
        ends_a = dict(zip(np.cumsum(self._wide_a[a]).tolist(), range(1, len(a) + 1)))
        ends_b = dict(zip(np.cumsum(self._wide_b[b]).tolist(), range(1, len(b) + 1)))
        common = sorted(ends_a.keys() & ends_b.keys())
        to_a, to_b = (np.fromiter(map(x.__getitem__, common), np.int64, len(common)) for x in (ends_a, ends_b))
        size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        last = np.searchsorted(np.array(common), unit_ends)  # a unit's last group
        n = np.diff(np.stack([to_a[last], to_b[last], last + 1], axis=1), axis=0, prepend=0)
        if self._links == "ends":
            links, n_links = a[to_a - 1].astype(np.int64) << 32 | b[to_b - 1].astype(np.int64), n[:, 2]
        else:
            each = size_a * size_b
            k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            wide = np.repeat(size_b, each)
            links = a[np.repeat(to_a - size_a, each) + k // wide].astype(np.int64) << 32 | b[np.repeat(to_b - size_b, each) + k % wide].astype(np.int64)
            n_links = np.diff(np.cumsum(each)[last], prepend=0)
        flat = np.empty(len(a) + len(b), object)
        for ids, names, to, size, before in ((a, self._names[0], to_a, size_a, to_b - size_b), (b, self._names[1], to_b, size_b, to_a)):
            ended = np.zeros(len(ids), bool)
            ended[to - 1] = True
            flat[np.arange(len(ids)) + np.repeat(before, size)] = np.where(ended, names[1][ids], names[0][ids])
        pieces, at = flat.tolist(), [0, *(to_a[last] + to_b[last]).tolist()]
        return n, ["".join(pieces[x:y]) for x, y in pairwise(at)], n_links, links


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(a: Tokenizer, b: PieceModel, links: str) -> Aligner:
    """One a process: its tables take a second to make."""
    return _ALIGNERS.setdefault((id(a), id(b), links), Aligner(a, b, links))


_COUNTS = ["n_a", "n_b", "n_groups", "groups", "units", "unit_n", "link_of", "link_n"]
#: Bytes of a row group of what is written in between: readers take one at a time.
ROW_GROUP_BYTES = 8 << 20


def _one_row(columns: list[pa.Array]) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]


def _pack(columns: list[pa.Array]) -> bytes:
    """The columns of a block as one compressed value, which passes through shuffles unopened."""
    batch = pa.RecordBatch.from_arrays(_one_row(columns), names=_COUNTS)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of all batches in blocks whose texts hold about ``most`` bytes together; a larger text comes alone."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        sizes = pc.coalesce(pc.binary_length(batch.column("text")), 0).to_pylist()
        at = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, total, at = [], 0, i
            total += n
        held.append(batch.slice(at))
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _block(aligner: Aligner, texts: list[str | None], digest: bool) -> list:
    """One block's documents, each as the indexes of its units; each unit's links as indexes of the block's distinct pairs."""
    index: dict[str, int] = {}
    split = []
    for t in texts:
        units = aligner.units(t) if t else []
        for u in units:
            if u not in index:
                index[u] = len(index)
        split.append(np.fromiter(map(index.__getitem__, units), np.int32, len(units)))
    distinct = list(index)
    done = [aligner.align(distinct[at : at + GROUP_UNITS]) for at in range(0, len(distinct), GROUP_UNITS)] or [aligner.align([])]
    counts, link_n, flat = (np.concatenate([x[i] for x in done]) for i in (0, 2, 3))
    text_of = [t for x in done for t in x[1]]
    n, groups, used = np.zeros((len(texts), 3), np.int64), [], []
    for k, at in enumerate(split):
        if (counts[at, 0] < 0).any():
            at = at[:0]
        joined = "".join(map(text_of.__getitem__, at.tolist()))[:-1]
        groups.append(hashlib.sha256(joined.encode()).hexdigest() if digest and len(at) else joined)
        n[k] = counts[at].sum(axis=0)
        used.append(at)
    units = np.concatenate(used) if used else np.empty(0, np.int32)
    pairs, link_of = np.unique(flat, return_inverse=True)
    times = np.bincount(units, minlength=len(distinct)).astype(np.int64)
    pair_n = np.bincount(link_of, weights=np.repeat(times, link_n), minlength=len(pairs)).astype(np.int64)
    return [*n.T, groups, units, np.array([len(x) for x in used], np.int32), link_of.astype(np.int32), link_n.astype(np.int32), pairs, pair_n]


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given lengths."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def _finish(blocks: pa.Table, scores: pa.Table) -> pa.Table:
    """The documents of a block, with the corpus-wide counts of their links added up."""
    with pa.ipc.open_stream(blocks.column("payload")[0].as_buffer()) as reader:
        batch = reader.read_next_batch()
    one = lambda c: batch.column(c).flatten()
    array_of = lambda c: one(c).to_numpy(zero_copy_only=False)
    count, best = np.zeros(scores.num_rows, np.int64), np.zeros(scores.num_rows, np.int64)
    at = scores.column("pos").to_numpy()
    count[at], best[at] = scores.column("n").to_numpy(), scores.column("best").to_numpy().astype(np.int64)
    units, unit_n, link_of, link_n = (array_of(c).astype(np.int64) for c in ("units", "unit_n", "link_of", "link_n"))
    per_unit = [link_n, _sums(best[link_of], link_n), _sums(count[link_of], link_n)]
    sums = [pa.array(_sums(x[units], unit_n)) for x in per_unit]
    return pa.table([blocks.column("ids").combine_chunks().flatten(), one("n_a"), one("n_b"), one("n_groups"), *sums, one("groups")], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def align_tokens(
    docs: DataFrame, load_a: Callable[[], Tokenizer], load_b: Callable[[], PieceModel],
    id_col: str = "doc_id", text_col: str = "text", links: str = "ends", digest: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: how the tokens of its text by two tokenizers lie on each other.

    A encodes a space and the text, B the text, before which it sets a space itself; neither knows special tokens.  Columns:
    ``id_col``, ``n_a`` and ``n_b`` tokens, ``n_groups`` (stretches between the byte offsets where tokens of both end),
    ``n_links``, ``n_best`` (links whose pair is linked more often in the corpus than any other pair of its B id, or as
    often), ``count_sum`` (over links, how often their pair is linked in the corpus) and ``groups``
    (``a1,a2|b1;a3|b2,b3``, or its SHA-256 in lowercase hex where ``digest``).  ``links`` is ``ends``: the two tokens that end
    together, or ``groups``: any two of one group.  A text that is null, empty or not spelled by the tokens of both (it holds
    a visible space, U+2581) has no tokens: zeros and no groups.  Ids may be null or repeated.  Extra columns are ignored.

    Runs a job: texts are encoded once, and what is needed of them is written below ``spark.checkpoint.dir``.  A task counts
    the links of a block of documents before anything is shuffled; counts come back as one number for each distinct pair of
    a block.  What a task holds is bounded by a block, or one longer text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(load_a(), load_b(), links)
        number = TaskContext.get().partitionId() << 32
        for part in _gathered(batches, block_bytes):
            columns = [pa.array(c, pa.string()) if isinstance(c, list) else pa.array(c) for c in _block(aligner, part.column("text").to_pylist(), digest)]
            ids, pairs, pair_n = _one_row([part.column("id").combine_chunks(), *columns[-2:]])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([_pack(columns[:-2])], pa.binary()), pairs, pair_n], names=["block", "ids", "payload", "pairs", "pair_n"])
            number += 1

    path = scratch_path(spark, "aligned")
    with rows_a_batch(spark, BATCH_ROWS):
        rows.mapInArrow(handing_back(run), f"block bigint, ids array<{kind}>, payload binary, pairs array<bigint>, pair_n array<bigint>").write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    blocks = spark.read.parquet(path)
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_n").alias("n"))
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    counts = counts.select("pair", of_b, "n")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    scored = counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    scores = spark.read.parquet(path).select("block", F.posexplode("pairs").alias("pos", "pair")).join(scored, "pair").select("block", "pos", "n", "best")
    done = blocks.select("block", "ids", "payload").groupBy("block").cogroup(scores.groupBy("block")).applyInArrow(
        _finish, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string",
    )
    return done.withColumnRenamed("id", id_col)
