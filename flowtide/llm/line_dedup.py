"""Removal of lines that are spread over many sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.durable import cut
from flowtide.llm.columns import aside

#: A line is boilerplate from so many distinct sites on, if it has so many characters without outer blanks.
MIN_SITES = 8
MIN_CHARS = 20
#: Registers of a sketch as a power of two, and how many standard errors around the threshold are counted exactly.
SKETCH_BITS = 8
ERRORS = 4.0
#: Rows with lines to drop that may be broadcast (an id, a hash and a few positions each); beyond it they are shuffled.
BROADCAST_ROWS = 200_000
BLANKS = " \t\r"


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int, passage_words: int | None = None) -> DataFrame:
    """One row per line that is long enough: row key ``(id, t)``, position, line hashes, site and whether it is a passage."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("site"),
        F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("pos", "line"),
    )
    line = F.btrim("line", F.lit(BLANKS))
    rows = rows.where(F.length(line) >= min_chars)
    passage = F.lit(False) if passage_words is None else F.size(F.split(line, r"\s+")) >= passage_words
    return rows.select("id", "t", "site", "pos", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"), passage.alias("passage"))


def _repeated_passages(lines: DataFrame) -> DataFrame:
    """``(h1, h2)`` of the passages in two or more documents with an id, on whatever sites."""
    document = F.when(F.col("id").isNotNull(), F.xxhash64("id", "t"))
    return lines.where("passage").groupBy("h1", "h2").agg((F.min(document) < F.max(document)).alias("many")).where("many").select("h1", "h2")


def widespread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """``(h1, h2)`` of the lines on at least ``min_sites`` distinct sites.

    HyperLogLog sketches of the sites merge in the aggregation and settle most lines; lines whose estimate lies near the
    threshold are counted exactly.  A line on a third of all rows is a partial sketch a task.
    """
    error = ERRORS * 1.04 / 2 ** (SKETCH_BITS / 2)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("s"))
    spread = cut(sketched.select("h1", "h2", F.hll_sketch_estimate("s").alias("sites")).where(F.col("sites") >= F.lit(min_sites * (1 - error))))
    clear = spread.where(F.col("sites") > F.lit(min_sites * (1 + error))).select("h1", "h2")
    near = spread.where(F.col("sites") <= F.lit(min_sites * (1 + error))).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").count()
    return clear.union(exact.where(F.col("count") >= min_sites).select("h1", "h2"))


def remove_widespread_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS,
    passage_words: int | None = None,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text and ``n_removed`` (their number) added; every row stays.

    A line (outer blanks aside) of at least ``min_chars`` characters on at least ``min_sites`` distinct sites is
    boilerplate.  Its first occurrence, by smallest id and position, stays: text that many sites copy is kept once, not
    lost.  With ``passage_words``, a line of so many words or more is also taken out when it repeats in two documents of
    any sites.  Null sites count as one site.  Null text stays null with nothing removed; a null id never holds the first
    occurrence; rows equal in id and text are treated alike.  All columns stay; an empty table gives an empty result.
    Runs jobs.
    """
    lines = _lines(docs, id_col, text_col, site_col, min_chars, passage_words)
    spread = widespread_lines(lines, min_sites)
    spread = cut(spread if passage_words is None else spread.union(_repeated_passages(lines)).distinct())
    hits = lines.join(spread, ["h1", "h2"])
    first = hits.where("id is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "pos")).alias("f"))
    repeated = hits.join(first, ["h1", "h2"], "left").where("f is null or not (id <=> f.id and pos <=> f.pos)")
    drops = cut(repeated.groupBy("id", "t").agg(F.collect_set("pos").alias("_drop")))
    few = drops.count() <= BROADCAST_ROWS
    keyed = drops.withColumnsRenamed({"id": "_id", "t": "_th"})
    rows, own = aside(docs, id=id_col, text=text_col)
    joined = rows.withColumn("_t", F.xxhash64("text")).join(
        F.broadcast(keyed) if few else keyed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left"
    )
    own[text_col] = _cleaned("text").alias(text_col)
    return joined.select(*[c for name, c in own.items() if name != "n_removed"], F.coalesce(F.size("_drop"), F.lit(0)).cast("bigint").alias("n_removed"))


def _cleaned(text_col: str) -> Column:
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drop"))
    kept = F.element_at(F.transform(F.array(lines), lambda ls: F.transform(left, lambda i: F.get(ls, i))), 1)
    return F.when(F.col("_drop").isNull(), F.col(text_col).cast("string")).otherwise(F.array_join(kept, "\n"))
