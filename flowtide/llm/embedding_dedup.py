"""Near-duplicate vectors by cosine: tiles compared along principal axes, stopped early by suffix norms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.functions.durable import cut
from flowtide.llm.components import components

#: Vectors of one side of a tile, and the leading dimensions after which the bound is tried.
TILE = 2048
STEPS = (8, 16, 32)
#: Slack of the bounds, well above rounding and far below any threshold.
SLACK = 1e-9
#: Vectors longer than this are compared in their own axes.
MAX_AXES = 2048


def _unit(values: object) -> np.ndarray | None:
    """The vector at length 1 in double precision, or None if it cannot be compared."""
    if values is None:
        return None
    v = np.array([np.nan if x is None else x for x in values], dtype=np.float64)
    if not len(v) or not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top  # squares of very large or small components stay in range
    return v / np.sqrt(v @ v)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    return [_unit(v.values.to_numpy(zero_copy_only=False) if v.is_valid and not v.values.null_count else v.as_py()) for v in column]


def principal_axes(df: DataFrame) -> tuple[int, np.ndarray]:
    """Length and principal axes (columns, strongest first) of the most frequent vector length; over all rows of ``vec``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for v in _vectors(batch.column("vec")):
                if v is not None:
                    by.setdefault(len(v), []).append(v)
            for d, vs in by.items():
                have = sums.setdefault(d, [0, 0.0])
                have[0] += len(vs)
                if d <= MAX_AXES:
                    x = np.stack(vs)
                    have[1] = have[1] + x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([np.asarray(s[1]).tobytes() for s in sums.values()], pa.binary())],
            names=["dim", "n", "moments"],
        )

    parts = df.select("vec").mapInArrow(partial, "dim int, n bigint, moments binary")
    counts = parts.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not counts or counts[0]["dim"] > MAX_AXES:
        return 0, np.zeros((0, 0))
    dim = counts[0]["dim"]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(dim * dim)
        for batch in batches:
            for m in batch.column("moments").to_pylist():
                out += np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["moments"])

    # Two levels of sums: one matrix a task, then one a group of tasks, so the driver adds up a bounded number.
    halves = parts.where(F.col("dim") == dim).repartition(32).mapInArrow(total, "moments binary").collect()
    moments = sum(np.frombuffer(r["moments"]) for r in halves).reshape(dim, dim)
    return dim, np.ascontiguousarray(np.linalg.eigh(moments)[1][:, ::-1])


def _prepared(df: DataFrame, dim: int, axes: np.ndarray) -> DataFrame:
    """``(id, label, size, key, lead, coords)``; ``key`` is null for vectors that link with nothing."""
    shared = df.sparkSession.sparkContext.broadcast(axes)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for v in _vectors(batch.column("vec")):
                if v is None:
                    rows.append((None, None, None, None))
                    continue
                c = v @ shared.value if len(v) == dim else v
                rows.append((len(v), hashlib.blake2b(v.tobytes(), digest_size=16).digest(), float(c[0]), c.tobytes()))
            size, key, lead, coords = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(size, pa.int32()), pa.array(key, pa.binary()), pa.array(lead, pa.float64()), pa.array(coords, pa.binary())],
                names=["id", "label", "size", "key", "lead", "coords"],
            )

    return df.mapInArrow(rotate, "id bigint, label string, size int, key binary, lead double, coords binary")


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with ``x[i] @ y[j] >= threshold`` for unit rows.

    Leading dimensions come first; what the others can add is at most the product of the suffix norms.  Pairs that can no
    longer reach the threshold are dropped, and the tile ends when none is left.
    """
    d = x.shape[1]
    product, done = np.zeros((len(x), len(y))), 0
    for k in [*(s for s in STEPS if s < d), d]:
        product += x[:, done:k] @ y[:, done:k].T
        done = k
        if k == d:
            break
        rest = np.outer(np.sqrt((x[:, k:] ** 2).sum(1)), np.sqrt((y[:, k:] ** 2).sum(1)))
        open_ = product + rest >= threshold - SLACK
        left = int(open_.sum())
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        if left * 8 < open_.size:  # few are left: finish those pairs alone
            i, j = np.nonzero(open_)
            found = [np.empty((2, 0), np.int64)]
            for at in range(0, left, 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                hit = product[a, b] + np.einsum("ij,ij->i", x[a, k:], y[b, k:]) >= threshold
                found.append(np.stack([a[hit], b[hit]]))
            i, j = np.concatenate(found, axis=1)
            return i, j
    return np.nonzero(product >= threshold)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def embedding_near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int = TILE
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` per row.

    Vectors with equal label and length link when their cosine, in double precision, is at least ``threshold``;
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id reachable, ``kept`` says whether
    that is the row's own id.  Runs jobs.

    Plan: principal axes from a d x d sum over all rows; rows with the same vector become one class with a count; classes
    are dealt to strips of the first axis (cosine bounds the distance there) and salted into blocks of about ``tile``
    classes; each pair of near strips' blocks is one task's tile.  A tile returns link counts and a spanning forest, never
    its pairs, so a group of thousands of near copies stays linear.

    Null label, null or empty vector, null or non-finite components, zero vectors and null ids: no links, own component
    (null for a null id).  Rows that share an id are one node of the component graph.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    dim, axes = principal_axes(rows)
    ready = cut(_prepared(rows, dim, axes))
    usable = ready.where("id is not null and label is not null and key is not null")
    classes = usable.groupBy("label", "size", "key").agg(F.min("id").alias("class"), F.count("*").alias("copies"), F.first("lead").alias("lead"), F.first("coords").alias("coords"))

    # Unit vectors with cosine >= t lie within sqrt(2 - 2t) of each other on every axis.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    width = max(reach / 4, 1e-3)
    classes = cut(classes.withColumn("strip", F.floor(F.col("lead") / width).cast("int")))
    salts = classes.groupBy("label", "size", "strip").agg(F.ceil(F.count("*") / tile).cast("int").alias("salts"))
    blocked = classes.join(salts, ["label", "size", "strip"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    span = int(np.ceil(reach / width))
    near = salts.select("label", "size", F.col("strip").alias("strip_b"), F.col("salts").alias("salts_b"))
    tiles = (
        salts.withColumn("strip_b", F.explode(F.sequence("strip", F.col("strip") + span))).join(near, ["label", "size", "strip_b"])
        .withColumn("salt_a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("salt_b", F.explode(F.sequence(F.lit(0), F.col("salts_b") - 1)))
        .where("strip < strip_b or salt_a <= salt_b")
        .withColumn("tile", F.struct("label", "size", "strip", "salt_a", "strip_b", "salt_b"))
    )
    left = tiles.select("label", "size", "strip", F.col("salt_a").alias("salt"), "tile")
    right = tiles.where("strip <> strip_b or salt_a <> salt_b").select("label", "size", F.col("strip_b").alias("strip"), F.col("salt_b").alias("salt"), "tile")

    def dealt(side: DataFrame, name: int) -> DataFrame:
        return blocked.join(side, ["label", "size", "strip", "salt"]).select("tile", "class", "copies", "key", "coords", F.lit(name).alias("side"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("side", kind="stable").reset_index(drop=True)
        coords = np.stack([np.frombuffer(c) for c in part["coords"]])
        one = int((part["side"] == 0).sum())
        diagonal = one == len(part)
        i, j = tile_links(coords[:one], coords if diagonal else coords[one:], threshold)
        if diagonal:
            i, j = i[i < j], j[i < j]
        else:
            j = j + one
        copies = part["copies"].to_numpy()
        links = np.bincount(i, copies[j], len(part)) + np.bincount(j, copies[i], len(part))
        hit = np.unique(np.concatenate([i, j]))
        root = _forest(len(part), i, j)
        out = part.loc[hit, ["class", "key"]]
        return out.assign(links=links[hit].astype("int64"), root=part["class"].to_numpy()[root[hit]])

    found = cut(
        dealt(left, 0).union(dealt(right, 1)).groupBy("tile").applyInPandas(compare, "class bigint, key binary, links bigint, root bigint")
        if not classes.isEmpty()
        else classes.select("class", "key", F.col("copies").alias("links"), F.col("class").alias("root"))
    )
    # A key stands for one vector but may occur under several labels, so counts go by class and key.
    linked = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("class", "key").agg(F.sum("links").alias("links"))
    named = (
        classes.select("label", "size", "key", "class", "copies").join(counts, ["class", "key"], "left")
        .join(linked, F.col("class") == F.col("node"), "left")
        .select("label", "size", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    )
    alone = ready.where("id is null or label is null or key is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    joined = usable.select("id", "label", "size", "key").join(named, ["label", "size", "key"]).select("id", "n_links", "component_id")
    return joined.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
