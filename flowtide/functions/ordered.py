"""Ordered computations that stay parallel inside one large group.

A window function puts a whole partition key into one task.  The helpers here cut
each group into blocks first, work inside the blocks, and carry a few values per
block across the block borders.  Every result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowtide.functions.expressions import col

_BEFORE = (W.unboundedPreceding, -1)


def _partition(names: Sequence[str]):
    return W.partitionBy(*([col(n) for n in names] or [F.lit(0)]))


def prefix(
    rows: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    order: Sequence[Column],
    measures: dict[str, tuple[str, str]],
) -> DataFrame:
    """Add running totals over the rows strictly before each row of its group.

    ``levels`` are columns from coarse to fine that never decrease along ``order``;
    they cut the group into blocks.  ``measures`` maps an output name to
    ``("sum" | "max" | "xor", input column)``.  Sums and exclusive ors start at 0, maxima at null.
    """
    keys, levels = list(keys), list(levels)
    agg = {"sum": F.sum, "max": F.max, "xor": F.bit_xor}
    path = keys + levels
    inside = _partition(path).orderBy(*order).rowsBetween(*_BEFORE)
    result = rows.withColumns({f"_in_{m}": agg[kind](col(c)).over(inside) for m, (kind, c) in measures.items()})
    if not levels:
        carried = result
    else:
        totals = rows.groupBy(*[col(p) for p in path]).agg(
            *[agg[kind](col(c)).alias(f"_t_{m}") for m, (kind, c) in measures.items()]
        )
        offsets = None
        for depth in range(1, len(levels) + 1):
            names = keys + levels[:depth]
            level = totals if depth == len(levels) else totals.groupBy(*[col(n) for n in names]).agg(
                *[agg[kind](f"_t_{m}").alias(f"_t_{m}") for m, (kind, _) in measures.items()]
            )
            across = _partition(names[:-1]).orderBy(col(names[-1])).rowsBetween(*_BEFORE)
            level = level.select(
                *[col(n) for n in names],
                *[agg[kind](f"_t_{m}").over(across).alias(f"_o{depth}_{m}") for m, (kind, _) in measures.items()],
            )
            offsets = level if offsets is None else _join(offsets, level, names[:-1])
        carried = _join(result, offsets, path)
    done = {}
    for m, (kind, _) in measures.items():
        parts = [col(f"_in_{m}")] + [col(f"_o{d}_{m}") for d in range(1, len(levels) + 1)]
        if kind in ("sum", "xor"):
            total = F.coalesce(parts[0], F.lit(0))
            for part in parts[1:]:
                more = F.coalesce(part, F.lit(0))
                total = total + more if kind == "sum" else total.bitwiseXOR(more)
            done[m] = total
        else:
            done[m] = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return carried.select(*[col(c) for c in rows.columns], *[c.alias(m) for m, c in done.items()])


def _join(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Equi-join that keeps one copy of the key columns and, where a key may be null, joins nulls too.

    Keys that cannot be null use plain equality, which keeps the partitioning of a window over them.
    """
    if not names:
        one = "_one"
        return left.withColumn(one, F.lit(1)).join(right.withColumn(one, F.lit(1)), one).drop(one)
    renamed = right.select(
        *[col(c).alias(f"_r_{c}" if c in names else c) for c in right.columns]
    )
    condition = None
    for n in names:
        mine, other = left[f"`{n}`"], renamed[f"`_r_{n}`"]
        test = mine.eqNullSafe(other) if left.schema[n].nullable else mine == other
        condition = test if condition is None else condition & test
    return left.join(renamed, condition).drop(*[f"_r_{n}" for n in names])


def position(
    rows: DataFrame, keys: Sequence[str], levels: Sequence[str], order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Zero-based row position inside each group, computed block by block."""
    counted = prefix(rows.withColumn("_one_row", F.lit(1).cast("bigint")), keys, levels, order,
                     {name: ("sum", "_one_row")})
    return counted.drop("_one_row")


def previous(
    rows: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[Column],
    values: dict[str, str],
) -> DataFrame:
    """Value of the row before, also across block borders (``lag`` without one big partition).

    ``block`` never decreases along ``order``.  ``values`` maps output name to input column.
    """
    keys = list(keys)
    inside = _partition(keys + [block]).orderBy(*order)
    payload = F.struct(*[col(c).alias(n) for n, c in values.items()])
    ordering = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    marked = rows.withColumns({"_lag": F.lag(payload).over(inside)})
    edge = (
        rows.groupBy(*[col(k) for k in keys], col(block))
        .agg(F.max_by(payload, ordering).alias("_edge_value"))
        .withColumn("_edge", F.lag("_edge_value").over(_partition(keys).orderBy(col(block))))
        .drop("_edge_value")
    )
    joined = _join(marked, edge, keys + [block])
    picked = F.when(col("_lag").isNotNull(), col("_lag")).otherwise(col("_edge"))
    return joined.select(*[col(c) for c in rows.columns], *[picked[n].alias(n) for n in values])


def next_at_or_after(
    probes: DataFrame, points: DataFrame, keys: Sequence[str], probe: str, point: str, name: str
) -> DataFrame:
    """For every probe time (microseconds) the first point time that is not earlier.

    Both sides shrink to distinct times first, so one second of one key holds at most
    a million rows; seconds and days carry the next non-empty second forward.
    """
    keys = list(keys)
    second = F.floor(F.col("_t") / 1_000_000).cast("bigint")
    times = (
        points.select(*[col(k) for k in keys], col(point).alias("_t")).distinct().withColumn("_is_point", F.lit(True))
        .unionByName(
            probes.select(*[col(k) for k in keys], col(probe).alias("_t")).distinct().withColumn("_is_point", F.lit(False))
        )
        .withColumns({"_s": second, "_d": F.floor(second / 86400).cast("bigint")})
    )
    hit = F.when(F.col("_is_point"), F.col("_t"))
    ahead = _partition(keys + ["_d", "_s"]).orderBy("_t", "_is_point")
    inside = times.withColumn("_near", F.first(hit, ignorenulls=True).over(ahead.rowsBetween(0, W.unboundedFollowing)))
    later = (1, W.unboundedFollowing)
    per_second = times.groupBy(*[col(k) for k in keys], "_d", "_s").agg(F.min(hit).alias("_m"))
    per_day = per_second.groupBy(*[col(k) for k in keys], "_d").agg(F.min("_m").alias("_m"))
    per_day = per_day.select(
        *[col(k) for k in keys], "_d", F.min("_m").over(_partition(keys).orderBy("_d").rowsBetween(*later)).alias("_next_d")
    )
    per_second = per_second.select(
        *[col(k) for k in keys], "_d", "_s",
        F.min("_m").over(_partition(keys + ["_d"]).orderBy("_s").rowsBetween(*later)).alias("_next_s"),
    )
    found = _join(_join(inside.filter(~F.col("_is_point")), per_second, keys + ["_d", "_s"]), per_day, keys + ["_d"])
    answers = found.select(
        *[col(k) for k in keys], F.col("_t").alias(probe), F.coalesce("_near", "_next_s", "_next_d").alias(name)
    )
    return _join(probes, answers, keys + [probe])


def log_bin(value: Column, per_octave: int) -> Column:
    """Order-preserving logarithmic bin of a number."""
    size = F.floor(F.log2(F.abs(value) + 1) * per_octave).cast("int")
    return F.when(value < 0, -size - 1).otherwise(size)


def group_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    per_octave: int = 16,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group; no task holds the values of a group.

    Values become (value, count) pairs first.  Counts per logarithmic bin tell which bins
    hold the ranks in question, and only the pairs of those bins are ranked.
    """
    keys = list(keys)
    key_columns = [col(k) for k in keys]
    pairs = (
        rows.select(*key_columns, col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*key_columns, log_bin(F.col("_v"), per_octave).alias("_bin"), "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ordered = _partition(keys).orderBy("_bin")
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("q")) for n, q in quantiles.items()]))
    rank = (F.col("_all") - 1) * F.col("_w.q")
    bins = (
        pairs.groupBy(*key_columns, "_bin")
        .agg(F.sum("_n").alias("_bn"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_bn").over(ordered.rowsBetween(*_BEFORE)), F.lit(0)),
                "_all": F.sum("_bn").over(_partition(keys)),
            }
        )
        .select("*", wanted.alias("_w"))
        .withColumns({"_low": F.floor(rank), "_high": F.ceil(rank), "_part": rank - F.floor(rank)})
        .filter((F.col("_before") <= F.col("_high")) & (F.col("_before") + F.col("_bn") > F.col("_low")))
        .groupBy(*key_columns, "_bin")
        .agg(F.first("_before").alias("_before"), F.collect_list(F.struct("_w.name", "_low", "_high", "_part")).alias("_asks"))
    )
    chosen = _join(pairs, bins, keys + ["_bin"])
    running = _partition(keys + ["_bin"]).orderBy("_v").rowsBetween(*_BEFORE)
    ranked = chosen.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
    holds = lambda r: (F.col("_from") <= r) & (F.col("_from") + F.col("_n") > r)
    asked = ranked.select("*", F.explode("_asks").alias("_a")).filter(holds(F.col("_a._low")) | holds(F.col("_a._high")))
    picked = asked.groupBy(*key_columns, F.col("_a.name").alias("_name"), F.col("_a._part").alias("_part")).agg(
        F.max(F.when(holds(F.col("_a._low")), F.col("_v"))).alias("_lo"),
        F.max(F.when(holds(F.col("_a._high")), F.col("_v"))).alias("_hi"),
    )
    number = F.col("_lo") + F.col("_part") * (F.col("_hi") - F.col("_lo"))
    return picked.groupBy(*key_columns).agg(
        *[F.max(F.when(F.col("_name") == n, number)).alias(n) for n in quantiles]
    )


def group_median(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per group, the same plan for groups of every size; no task holds a group."""
    return group_quantiles(rows, keys, value, {name: 0.5})
