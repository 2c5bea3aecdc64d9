"""Conversations without quotations: quoted passages are linked to the messages they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.ordered import position, previous

#: Marks in front of a quoted line, and the line that introduces a quotation.
MARKS = r"^(?:[ \t]*>)*"
ATTRIBUTION = r"(?i)\bwrote:[ \t\r]*$"
#: Turns ordered together in one task.
BLOCK = 1024
_CUT, _LEVEL = "\u0001", "\u0002"


def parse_passages(text: Column) -> Column:
    """``array<struct<level int, norm string>>``: runs of non-blank lines of one quote level, blanks and case normalised."""
    lines = F.split(F.translate(text, _CUT + _LEVEL, "  "), "\n", -1)

    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        body = F.trim(F.regexp_replace(F.substring(line, F.length(marks) + 1, F.length(line)), r"\s+", " "))
        return F.struct((F.length(marks) - F.length(F.translate(marks, ">", ""))).alias("level"), body.alias("body"), F.regexp_like(line, F.lit(ATTRIBUTION)).alias("intro"))

    def piece(this: Column, before: Column) -> Column:
        # A blank line, an introduction or another level ends a passage.
        starts = before.isNull() | (before["level"] != this["level"]) | (before["body"] == "") | before["intro"]
        mark = F.concat(F.lit(_CUT), this["level"].cast("string"), F.lit(_LEVEL))
        return F.when(this["intro"] | (this["body"] == ""), "").when(starts, F.concat(mark, this["body"])).otherwise(F.concat(F.lit(" "), this["body"]))

    def joined(rows: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<level:int,body:string,intro:boolean>")), F.slice(rows, F.lit(1), F.greatest(F.size(rows) - 1, F.lit(0))))
        return F.array_join(F.zip_with(rows, before, piece), "")

    whole = F.element_at(F.transform(F.array(F.transform(lines, parsed)), joined), 1)
    parts = F.filter(F.split(whole, _CUT), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, _LEVEL, 1).cast("int").alias("level"), F.lower(F.trim(F.substring_index(p, _LEVEL, -1))).alias("norm")))


def own_text(text: Column) -> Column:
    """The text without quoted lines and the lines that introduce them; outer blank lines are dropped."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: ~F.regexp_like(x, F.lit(r"^[ \t]*>")) & ~F.regexp_like(x, F.lit(ATTRIBUTION)))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\n+|\n+$", "")


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per message: keys and role, ``parent_turn``, ``by_quote``, ``n_quotes``, ``n_linked``, ``depth``, ``position``, ``text``.

    Lines that begin with ``>`` are quoted, as many levels deep as there are marks; a passage is a run of such lines of one
    level.  A passage is linked to the first message of the conversation that has it among its own paragraphs (equal up to
    white space and case), if that came earlier.  The parent is the latest message that a level-1 passage links to, else the
    latest that any passage links to, else the turn before.  ``position`` orders by parent, then turn: replies to one
    message stand together and no message precedes the one it answers.  ``depth`` is the deepest quote level, ``text`` is
    free of quotations.

    Links are a hash join on conversation and passage against one row per distinct paragraph, so a passage that everyone
    quotes costs each quote one row.  Null text counts as empty; messages with a null conversation or turn stand alone
    (no parent, position 0); repeated turns share their links and come in text order; extra columns are ignored.
    """
    rows = messages.select(
        F.col(conv_col).alias("c"), F.col(turn_col).cast("bigint").alias("n"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    ).withColumn("p", parse_passages(F.col("t")))
    known = rows.where("c is not null and n is not null")
    passages = known.select("c", "n", F.explode("p").alias("p")).select("c", "n", "p.level", F.xxhash64("p.norm").alias("h1"), F.hash("p.norm").alias("h2"))
    originals = passages.where("level = 0").groupBy("c", "h1", "h2").agg(F.min("n").alias("origin"))
    quotes = passages.where("level > 0").groupBy("c", "n", "level", "h1", "h2").agg(F.count("*").alias("k"))
    linked = quotes.join(originals, ["c", "h1", "h2"]).where("origin < n")
    found = linked.groupBy("c", "n").agg(F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("direct"), F.max("origin").alias("any"), F.sum("k").alias("n_linked"))

    turns = known.select("c", "n").distinct().withColumn("block", F.floor(F.col("n") / BLOCK))
    before = previous(turns, ["c"], "block", [F.col("n")], {"before": "n"})
    parents = before.join(found, ["c", "n"], "left").select(
        "c", "n", F.coalesce("direct", "any", "before").alias("parent_turn"), F.coalesce("direct", "any").isNotNull().alias("by_quote"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")
    )
    whole = known.join(parents, ["c", "n"]).withColumn("_first", F.coalesce("parent_turn", F.lit(-(1 << 62)))).withColumn("_block", F.floor(F.col("_first") / BLOCK))
    placed = position(whole, ["c"], ["_block"], [F.col("_first"), F.col("n"), F.col("t"), F.col("role")])
    alone = rows.where("c is null or n is null").select(
        *rows.columns, F.lit(None).cast("bigint").alias("parent_turn"), F.lit(False).alias("by_quote"), F.lit(0).cast("bigint").alias("n_linked"), F.lit(0).cast("bigint").alias("position")
    )
    quoted = F.filter("p", lambda x: x["level"] > 0)
    return placed.select(alone.columns).union(alone).select(
        F.col("c").alias(conv_col), F.col("n").alias(turn_col), F.col("role").alias(role_col), "parent_turn", "by_quote", F.size(quoted).cast("bigint").alias("n_quotes"), "n_linked",
        F.coalesce(F.array_max(F.transform(quoted, lambda x: x["level"])), F.lit(0)).cast("bigint").alias("depth"), "position", own_text(F.col("t")).alias(text_col),
    )
