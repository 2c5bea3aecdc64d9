"""Similarity join of documents on word shingles: grouped prefix join with verified members."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.durable import cut, rows_a_batch
from flowtide.functions.workers import handing_back
from flowtide.llm.components import components
from flowtide.llm.hashing import mix, shingle_set, text_bytes, word_hashes

#: Counters of the shingle order; fixed, so what is broadcast never grows with the data.
COUNTERS = 1 << 20
_BLOCK = 1 << 14
#: Members from which a list counts as long.
LONG_LIST = 32
#: Rows that workers get at a time: a row is a text, or the sets of two.
BATCH_ROWS = 512
#: Ids of active documents that may be broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(44)).astype(np.int64)


def _shingle_order(texts: DataFrame, width: int) -> np.ndarray:
    """How often the shingles of each counter occur: rare ones come first in every prefix.

    Counts cover all rows.  Shingles that share a counter share its count; the order stays the same for all documents,
    which is all that prefixes need, and frequent shingles still come last.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for data in text_bytes(batch.column("text")):
                if data is not None:
                    np.add.at(counts, _slots(shingle_set(word_hashes(data), width)), 1)
        # Blocks keep a partial sum small enough to be shuffled and added up piece by piece.
        blocks = [b for b in range(COUNTERS // _BLOCK) if counts[b * _BLOCK : (b + 1) * _BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array([counts[b * _BLOCK : (b + 1) * _BLOCK].astype("<u4").tobytes() for b in blocks], pa.binary())],
            names=["block", "counts"],
        )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"]
        )

    out = np.zeros(COUNTERS, np.int64)
    schema = "block int, counts binary"
    for row in texts.select("text").mapInArrow(handing_back(partial), schema).repartition("block").mapInArrow(total, schema).collect():
        out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["counts"], "<i8")
    return out


def _shared_least(n: int, percent: int) -> int:
    """Shingles that linked documents of size n or more are asked to share within their prefixes."""
    return 1 + 3 * (n - -(-percent * n // 100)) // 10


def _prefix_length(n: int, percent: int) -> int:
    """Two sets with 100 * |x & y| >= percent * |x | y| share ``_shared_least`` (of the smaller) of their first so many.

    One common shingle would need the shortest prefix; asking for a few more drops documents that meet by chance.
    """
    return n - -(-percent * n // 100) + _shared_least(n, percent)


def _least_sql(n: str, percent: int) -> str:
    return f"(1 + (3 * ({n} - ({percent} * {n} + 99) div 100)) div 10)"


def _signatures(texts: DataFrame, width: int, percent: int, order: np.ndarray) -> DataFrame:
    """``(id, n, k1, k2, p1, p2, prefix)`` per document: set size, 128-bit keys of set and prefix, prefix in the shared order."""
    shared = texts.sparkSession.sparkContext.broadcast(np.minimum(order, np.iinfo(np.uint32).max).astype(np.uint32))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            sizes, k1, k2, prefixes = [], [], [], []
            for data in text_bytes(batch.column("text")):
                s = shingle_set(word_hashes(data), width) if data is not None else np.empty(0, np.uint64)
                n = len(s)
                sizes.append(n)
                k1.append(int(np.add.reduce(mix(s, 11)).astype(np.int64)) if n else 0)
                k2.append(int(np.bitwise_xor.reduce(mix(s, 12)).astype(np.int64)) if n else 0)
                p = _prefix_length(n, percent) if n else 0
                # s is sorted, and a stable sort by count keeps that order among equal counts.
                prefixes.append(s[np.argsort(counts[_slots(s)], kind="stable")[:p]].astype(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                names=["id", "n", "k1", "k2", "prefix"],
            )

    signed = texts.mapInArrow(handing_back(sign), "id bigint, n bigint, k1 bigint, k2 bigint, prefix array<bigint>")
    return signed.select("id", "n", "k1", "k2", F.xxhash64("prefix").alias("p1"), F.hash("prefix").alias("p2"), "prefix")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(word_hashes(d), width).astype("<u8").tobytes() if d is not None else b"" for d in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "items"])

    return texts.mapInArrow(handing_back(build), "id bigint, items binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, few: bool) -> DataFrame:
    """The pairs ``(a, b)`` that really link.  Sets in no pair are left behind before anything is shuffled, if pairs are ``few``."""

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("id").alias(k), F.col("items").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    if few:
        left, pairs = left.join(F.broadcast(pairs.select("a").distinct()), "a", "left_semi"), F.broadcast(pairs)
    return right.join(pairs, "b").join(left.hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(handing_back(intersect), "a bigint, b bigint")


def _sizes_allow(percent: int) -> str:
    """Size filter of a and b in a list they share; it never drops a link, whichever of their lists it is.

    Common shingles ranked before the list's lie in both prefixes, so they are among those that each has met others with:
    ``pos - own``, ``own`` being the shingles before the position that no other class has in its prefix.  One of these ranked
    later may be common, for it can lie behind the partner's prefix.
    """
    most = "(least(pos_a - own_a, pos_b - own_b) + least(n_a - pos_a, n_b - pos_b))"
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and (100 + {percent}) * {most} >= {percent} * (n_a + n_b)"


def _positions_allow(percent: int) -> str:
    """Position filter at the first common shingle of a and b; at a later one it may be stricter, never at the first."""
    return f"(100 + {percent}) * (1 + least(n_a - pos_a, n_b - pos_b)) >= {percent} * (n_a + n_b)"


#: Of a part of a group: the group, the part, its size of set, shingles of its own, position, smallest id, whether it has several members.
_COLUMNS = ("g", "part", "n", "own", "pos", "rep", "many")


def _leader_pairs(rows: DataFrame, members: DataFrame, percent: int, last: bool) -> DataFrame:
    """Candidate pairs of documents out of the pairs of each list's parts with one leader of the list.

    The leader is, of the parts with the fewest shingles of their own, which lie in the middle of a group of near copies,
    the one with the largest or smallest id.  Pairs of parts are filtered first; the smallest member of the leader then
    meets every member of the other part, so that both steps stay linear.  A leader meets itself if it has several members.
    """
    order = F.struct(-F.col("own"), F.col("rep") if last else -F.col("rep"))
    lead = rows.groupBy("h").agg(F.max_by(F.struct(*_COLUMNS), order).alias("l")).select("h", *[F.col(f"l.{c}").alias(f"{c}_a") for c in _COLUMNS])
    side = rows.select("h", *[F.col(c).alias(f"{c}_b") for c in _COLUMNS])
    met = side.join(lead.hint("merge"), "h").where("part_a <> part_b or many_b and g_a = g_b")
    met = cut(met.where(_sizes_allow(percent)).where(_positions_allow(percent)).select("rep_a", F.col("g_b").alias("g"), F.col("part_b").alias("part")).distinct())
    pairs = met.join(members.hint("merge"), ["g", "part"]).where("rep_a <> id")
    return pairs.select(F.least("rep_a", "id").alias("a"), F.greatest("rep_a", "id").alias("b")).distinct()


def _remaining_pairs(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame | None:
    """Candidate pairs of documents of different components: exact, and none for a list whose members are linked.  None: no list is left.

    Parts (the members of a group in one component) outside a list's largest component meet the parts of all other
    components; pairs of parts are filtered by sizes, positions and number of shared shingles, then expanded to members.
    """
    sizes = rows.groupBy("h", "part").count()
    lists = sizes.groupBy("h").agg(F.max(F.struct("count", "part")).alias("m"), F.count("*").alias("parts"), F.sum("count").alias("members")).where("parts > 1")
    rows = cut(rows.join(lists.select("h", F.col("m.part").alias("major"), (F.col("members") > LONG_LIST).alias("long")).hint("merge"), "h"))
    if rows.isEmpty():
        return None
    # Two parts of one long list mostly share many; each brings the long lists of its group along, and a pair comes out of
    # the first of them with their number.
    long = rows.where("long")
    own_lists = long.groupBy("g").agg(F.sort_array(F.collect_set(F.struct("pos", "h")))["h"].alias("lists"))
    common = F.array_intersect("lists_a", "lists_b")
    met = _across(rows.where("not long"), _COLUMNS, percent).select("*", F.lit(1).alias("shared")).unionByName(
        _across(long.join(own_lists.hint("merge"), "g"), (*_COLUMNS, "lists"), percent).where(F.get(common, F.lit(0)) == F.col("h")).withColumn("shared", F.size(common)).drop("lists_a", "lists_b")
    )
    keys = ("g_a", "part_a", "g_b", "part_b")
    turned = F.col("part_a") > F.col("part_b")
    met = met.withColumns({k: F.when(turned, F.col(other)).otherwise(F.col(k)) for k, other in zip(keys, keys[2:] + keys[:2], strict=True)})
    pairs = met.groupBy(*keys, F.least("n_a", "n_b").alias("n")).agg(F.sum("shared").alias("shared"), F.bool_or(F.expr(_positions_allow(percent))).alias("may"))
    # Of all pairs of parts few stay; cut, the two steps are two small plans, not one that the driver plans again at each stage.
    pairs = cut(pairs.where(f"may and shared >= {_least_sql('n', percent)}").select(*keys))
    for k in ("a", "b"):
        pairs = pairs.join(members.select(*[F.col(c).alias(f"{c}_{k}") for c in ("g", "part", "id")]).hint("merge"), [f"g_{k}", f"part_{k}"])
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _across(rows: DataFrame, columns: tuple[str, ...], percent: int) -> DataFrame:
    """Parts outside a list's largest component beside the parts of every other component, sizes permitting."""
    minor = rows.where("part <> major").select("h", *[F.col(c).alias(f"{c}_a") for c in columns])
    others = rows.select("h", "major", *[F.col(c).alias(f"{c}_b") for c in columns])
    return minor.join(others.hint("merge"), "h").where("part_a <> part_b and (part_b = major or part_a < part_b)").where(_sizes_allow(percent))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` per row: shingle-set size and the smallest id reachable by links.

    Two documents link when ``100 * |x & y| >= percent * |x | y|`` over their sets of ``width``-word shingles.  Words are
    runs of characters other than space and U+0009 to U+000D, with A-Z lower-cased; fewer words than ``width`` make one
    shingle.  Runs jobs (checkpoints in ``spark.checkpoint.dir``).

    Plan: count shingles into a fixed number of counters, which orders them rare first; documents with equal sets become
    one class, classes with equal prefix and size one group; a group whose prefix meets too few others links with none and is
    left out, unless it has several classes; pairs of groups sharing a prefix shingle are filtered by sizes and positions, then
    expanded to their classes and verified on whole sets.  Pairs already connected are never compared: each list
    is first compared with a leader, then only across the components that remain.  The driver plans small steps: their joins
    are hinted as merges, so that it need not collect and keep a small table for each of them.

    Null or empty text: 0 shingles, own component.  Null id: 0 or more shingles, null component, no links.  Rows with the
    same id are one node, linked when any of their texts links.  Extra columns are ignored.  An empty table gives an empty result.
    """
    with rows_a_batch(docs.sparkSession, BATCH_ROWS):
        return _joined(docs, id_col, text_col, width, percent)


def _joined(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(_signatures(texts, width, percent, _shingle_order(texts, width)))
    usable = signed.where("id is not null and n > 0")
    classes = cut(usable.groupBy("n", "k1", "k2", "p1", "p2").agg(F.min("id").alias("id")))

    # Groups: classes with identical prefix and size, named by their hash.  One row of each brings its prefix; rows that
    # merely repeat an id and its text would bring it again.
    group = F.xxhash64("n", "p1", "p2").alias("g")
    groups = usable.groupBy("n", "p1", "p2").agg(F.min(F.struct("id", "k1")).alias("l"), (F.min("k1") < F.max("k1")).alias("several"))
    leaders = cut(groups.select("l.id", "l.k1", "several"))
    prefixes = usable.join(F.broadcast(leaders) if leaders.count() <= BROADCAST_IDS else leaders, ["id", "k1"])
    repeated = not usable.groupBy("id", "k1").count().where("count > 1").isEmpty()
    if repeated:
        prefixes = prefixes.dropDuplicates(["id", "k1"])
    # Lists of the groups by shingle.
    postings = prefixes.select(group, "n", "several", F.posexplode("prefix").alias("pos", "h"))
    shared = postings.groupBy("h").agg(F.count("*").alias("k"), F.bool_or("several").alias("several")).where("k > 1 or several").select("h")
    met = postings.select("h", "g", "n", "pos").join(shared.hint("merge"), "h").groupBy("g", "n").agg(F.sort_array(F.collect_set(F.struct("pos", "h"))).alias("met"))
    # A link of a document of size n is with one of size percent * n / 100 at least.
    smaller = f"(({percent} * n + 99) div 100)"
    met = cut(met.where(f"size(met) >= {_least_sql(smaller, percent)}"))
    rows = met.select("g", "n", F.posexplode("met").alias("i", "m")).select("g", "n", (F.col("m.pos") - F.col("i")).alias("own"), "m.pos", "m.h")

    members = cut(classes.select(group, "id").join(met.select("g").hint("merge"), "g").distinct())
    active = members.select("id").distinct()
    few = members.count() <= BROADCAST_IDS
    sets = _sets(texts.join(F.broadcast(active) if few else active, "id", "left_semi"), width)
    sets = cut(sets.distinct() if repeated else sets)

    # At first a group is one part; then a part is what a group has in one component.
    parted, labels, tried = members.withColumn("part", F.col("g")), active.select("id", F.col("id").alias("comp")), None
    for step in ("first", "last", "rest"):
        parts = parted.groupBy("g", "part").agg(F.min("id").alias("rep"), (F.lit(step == "first") & (F.count("*") > 1)).alias("many"))
        placed = rows.join(parts.hint("merge"), "g")
        pairs = _remaining_pairs(placed, parted, percent) if step == "rest" else _leader_pairs(placed, parted, percent, step == "last")
        if pairs is None:
            break
        if tried is not None:
            pairs = pairs.join(tried.hint("merge"), ["a", "b"], "left_anti")
        pairs = cut(pairs)
        n_pairs, linking = pairs.count(), False
        if n_pairs:
            tried = pairs if tried is None else tried.union(pairs)
            found = cut(_verified(pairs, sets, percent, n_pairs <= BROADCAST_IDS))
            linking = not found.isEmpty()
        if linking:
            # Links join components: the smallest id of what they connect names all of it.
            ends = [labels.select(F.col("id").alias(k), F.col("comp").alias(c)) for k, c in (("a", "u"), ("b", "v"))]
            linked = components(found.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").select("u", "v"))
            joined = labels.join(linked.hint("merge"), labels["comp"] == linked["node"], "left")
            labels = cut(joined.select("id", F.coalesce("component", "comp").alias("comp")))
        if step == "first" or step == "last" and linking:
            parted = cut(members.join(labels.withColumnRenamed("comp", "part").hint("merge"), "id"))

    named = classes.select("n", "k1", "k2", F.col("id").alias("class")).join(labels.withColumnRenamed("id", "class").hint("merge"), "class", "left")
    named = named.select("n", "k1", "k2", F.coalesce("comp", "class").alias("comp"))
    alone = signed.where("id is null or n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return (
        usable.select("id", "n", "k1", "k2").join(named.hint("merge"), ["n", "k1", "k2"])
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
        .union(alone)
    )
