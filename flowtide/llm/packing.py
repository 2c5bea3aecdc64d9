"""Packing token pieces into sequences of fixed length: cutting stock by column generation."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.functions.durable import cut
from flowtide.functions.workers import handing_back
from flowtide.llm.bpe import Tokenizer, _slices
from flowtide.llm.columns import aside

CAPACITY = 4096
#: Piece lengths are planned in steps of so many tokens, which bounds the histogram at CAPACITY / GRID classes.
GRID = 16
#: Column generation ends when no packing can need fewer sequences than (1 - GAP) times the plan's.
GAP = 1e-3
#: Pieces of one class that are ranked together in one task.
RANKED = 200_000


def cut_documents(
    docs: DataFrame, load: Callable[[], Tokenizer], end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True
) -> DataFrame:
    """``(id_col, start, length, ids_crc32, doc_tokens[, ids])``: each text's tokens, ``end_id`` appended, in pieces.

    A text is cut only where it exceeds ``capacity``.  Null text counts as empty; without ``end_id`` it has no piece.
    ``ids_crc32`` is over little-endian unsigned 32-bit ids.  Rows are independent; extra columns are ignored.
    """
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load()
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in _slices(batch, "text"):
                rows: list[tuple] = []
                for k, raw in enumerate(t.encode([x or "" for x in part.column("text").to_pylist()], rounds=True)):
                    raw = np.frombuffer(raw, np.uint32).astype("<u4").tobytes() + tail
                    total = len(raw) // 4
                    for start in range(0, total, capacity):
                        own = raw[4 * start : 4 * (start + capacity)]
                        rows.append((k, start, len(own) // 4, zlib.crc32(own), total, own))
                at, start, length, crc, total, ids = zip(*rows, strict=True) if rows else ((),) * 6
                columns = [part.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(handing_back(run), schema).withColumnRenamed("id", id_col)


def best_pattern(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits, by dynamic programming over the room."""
    order = np.argsort(sizes, kind="stable")
    sizes, values = sizes[order], values[order]
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    best, item = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r], item[r] = best[r - 1], -1
        if n := upto[r]:
            gain = values[:n] + best[r - sizes[:n]]
            k = int(gain.argmax())
            if gain[k] > best[r]:
                best[r], item[r] = gain[k], k
    counts, r = np.zeros(len(sizes)), room
    while r > 0:
        if item[r] < 0:
            r -= 1
        else:
            counts[order[item[r]]] += 1
            r -= sizes[item[r]]
    return float(best[room]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: items of each size) and how often the linear program uses each.

    The program minimises the number of sequences; its dual values price a knapsack whose answer is the next column.  It
    starts from one pattern a size and ends at Farley's bound.
    """
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / (room // sizes))
    use = inverse @ demand
    for step in range(40 * m):
        price = inverse.sum(axis=0)
        worth, column = best_pattern(sizes, np.maximum(price, 0), room)
        if worth <= 1 + gap:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, use / np.where(direction > 1e-9, direction, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[leaves] = column
        pivot = inverse[leaves] / direction[leaves]
        inverse -= np.outer(direction, pivot)
        inverse[leaves] = pivot
        if step % 200 == 199:  # rounding builds up in the updates
            inverse = np.linalg.inv(basis.T)
        use = np.maximum(inverse @ demand, 0)
    return basis.astype(np.int64), use


def _fill(left: dict[int, int], room: int) -> list[int]:
    """Items for one sequence: the largest that is left, then the subset that fills the rest best."""
    first = max(left)
    space, steps, reach = room - first, [], 1
    mask = (1 << (space + 1)) - 1
    for s in sorted(left, reverse=True):
        for _ in range(min(left[s] - (s == first), space // s)):
            grown = (reach | reach << s) & mask
            if grown == reach:
                break
            steps.append((s, reach))
            reach = grown
        if reach >> space & 1:
            break
    total, out = reach.bit_length() - 1, [first]
    for s, before in reversed(steps):
        if not before >> total & 1:
            out.append(s)
            total -= s
    return out


def plan_sequences(histogram: dict[int, int], room: int, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """``(pattern, times)`` that covers the histogram exactly: rounded-down columns, then filled leftovers.

    The leftovers come from the fractions of at most one pattern a size, so their number does not grow with the data.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    if left:
        sizes = np.array(sorted(left))
        patterns, use = cutting_stock(sizes, np.array([left[s] for s in sizes], dtype=float), room, gap)
        for pattern, times in sorted(zip(patterns.tolist(), use, strict=True), key=lambda p: -p[1]):
            chosen = {int(s): int(k) for s, k in zip(sizes, pattern, strict=True) if k}
            n = min([int(np.floor(times + 1e-6)), *(left[s] // k for s, k in chosen.items())])
            if n > 0:
                out.append((chosen, n))
                for s, k in chosen.items():
                    left[s] -= n * k
    left = {s: n for s, n in left.items() if n}
    while left:
        chosen = {}
        for s in _fill(left, room):
            chosen[s] = chosen.get(s, 0) + 1
        n = min(left[s] // k for s, k in chosen.items())
        out.append((chosen, n))
        for s, k in chosen.items():
            left[s] -= n * k
            if not left[s]:
                del left[s]
    return out


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, grid: int = GRID, gap: float = GAP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` tokens, offsets gapless from 0.

    ``pieces`` has ``id_col``, ``start`` and ``length`` (1 to ``capacity``; shorter or longer pieces are refused) and any
    further columns, which are carried along.  Runs jobs.  Only the histogram of rounded lengths, at most
    ``capacity / grid`` numbers, reaches the driver; patterns come back as rank ranges of each length class, and a piece
    finds its sequence by its rank.  A class of any size is ranked in salted parts.  Ties, repeated rows and null ids are
    separate pieces; an empty table gives an empty result.
    """
    room = capacity // grid
    pieces, own = aside(pieces.drop("sequence_id", "offset"), id=id_col, start="start", length="length")
    length = F.col("length")
    checked = F.when((length >= 1) & (length <= capacity), F.ceil(length / grid).cast("int")).otherwise(F.raise_error(F.lit("piece length out of range")).cast("int"))
    rows = cut(pieces.withColumn("_class", checked))
    counts = {r["_class"]: r["n"] for r in rows.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    spark = rows.sparkSession

    ranges, base = [], 0
    taken: dict[int, int] = {}
    # A piece of the top class fills a sequence alone.
    plan = [({room: 1}, counts[room])] if room in counts else []
    plan += plan_sequences({c: n for c, n in counts.items() if c != room}, room, gap)
    for pattern, times in plan:
        for c, k in pattern.items():
            at = taken.get(c, 0)
            ranges.append((c, at, at + times * k, k, base))
            taken[c] = at + times * k
        base += times
    ranged = spark.createDataFrame(ranges, "_class int, _from bigint, _to bigint, _each bigint, _base bigint")

    parts = max(1, -(-sum(counts.values()) // RANKED))
    salted = rows.withColumn("_part", F.pmod(F.xxhash64("id", "start", "length"), F.lit(parts)).cast("int"))
    sums = salted.groupBy("_class", "_part").agg(F.count("*").alias("_n"))
    before = sums.select("_class", "_part", (F.sum("_n").over(Window.partitionBy("_class").orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = (
        salted.withColumn("_own", F.row_number().over(Window.partitionBy("_class", "_part").orderBy("id", "start")))
        .join(F.broadcast(before) if parts <= 64 else before, ["_class", "_part"])
        .withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    )
    # At most one range for each size of each pattern: bounded by the plan, not by the data.
    placed = ranked.join(F.broadcast(ranged), "_class").where("_rank >= _from and _rank < _to")
    placed = placed.withColumn("sequence_id", F.expr("_base + (_rank - _from) div _each"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*own.values(), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the tokens of each sequence of ``pack`` over pieces with ``ids``; a sequence is bounded."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
