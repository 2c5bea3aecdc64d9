"""Secrets in texts: fixed patterns, and Markov models of random strings against ordinary identifiers.

DataFrame code only.  Each row carries its own spans; the driver sees pair counts of printable ASCII characters, at most
96 * 96 a model.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.durable import cut
from flowtide.llm.columns import aside

#: Kinds of base secrets in their order, their patterns, and the shortest secret of each.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: What the models look at: runs of 16 or more of the usual token characters that stand alone.
CANDIDATE = r"(?<![\p{L}\p{N}])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![\p{L}\p{N}])"
KINDS = ("assign", "access", "hex", "markov")
#: A candidate is a secret from this log-likelihood ratio on (odds of about 160,000 to 1, for secrets are rare), and from
#: this mean over its pairs of characters, so that long words of an unusual kind do not add up to one.
LEAST_RATIO, LEAST_MEAN = 12.0, 2.0
#: What is an ordinary identifier: shorter runs, so that no candidate is judged by itself.
ORDINARY = r"(?<![\p{L}\p{N}])[A-Za-z0-9+/_-]{6,15}+(?![\p{L}\p{N}+/_=-])"
#: Share of the random model that takes every token character for equally likely: secrets come in more alphabets than the
#: labelled ones.
UNIFORM, TOKEN_CHARACTERS = 0.5, 66
#: Pairs of a model count as much as so many unseen ones that are spread evenly over all characters.
EVEN = 10.0
FIRST, CHARACTERS = 32, 96
PLACEHOLDER = "[secret]"
#: Matches are marked by these two characters, which are first replaced in the text by one that no pattern knows.
_OPEN, _CLOSE, _PLAIN = "\u0001", "\u0002", "\u0003"
_CHUNK = 256


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _before(lengths: Column, i: Column, chunks: Column) -> Column:
    """Sum of the lengths before the i-th: whole chunks first, so that many matches in one text stay cheap."""
    done = F.floor(i / _CHUNK).cast("int")
    return _total(F.slice(chunks, F.lit(1), done)) + _total(F.slice(lengths, done * _CHUNK + 1, i - done * _CHUNK))


def _matches(text: Column, pattern: str) -> Column:
    """Array of ``(start, end, value)`` of all leftmost matches, in code points."""
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)

    def spans(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x))

        def placed(n: Column) -> Column:
            chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / _CHUNK).cast("int")), lambda c: _total(F.slice(n, c * _CHUNK + 1, F.lit(_CHUNK))))
            return _let(chunks, lambda sums: F.transform(p, lambda x, i: F.struct(_before(n, i, sums).alias("start"), (_before(n, i, sums) + F.length(x)).alias("end"), x.alias("value"))))

        # Plain text and matches take turns.
        return F.filter(_let(lengths, placed), lambda x, i: i % 2 == 1)

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), _let(pieces, spans)).otherwise(empty)


def _found(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns of ``docs`` with the base spans and the free candidates of each text."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _OPEN + _CLOSE, _PLAIN * 2)
    out = docs.withColumn("_t", text)
    out = out.withColumns({f"_{k}": _matches(F.col("_t"), p) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("all", CANDIDATE))})
    out = out.withColumn("_assign", F.filter("_assign", lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= ASSIGN_LEAST))
    out = out.withColumn("_access", F.filter("_access", lambda m: m["end"] - m["start"] >= ACCESS_LEAST))
    base = F.flatten(F.array("_assign", "_access", "_hex"))
    free = F.filter("_all", lambda c: c["value"].rlike("[A-Za-z]") & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return out.withColumn("_free", F.when(F.size("_all") > 0, free).otherwise(F.col("_all"))).drop("_t", "_all")


def _pairs(values: Column) -> Column:
    """Codes of neighbouring characters of a value."""
    codes = F.transform(F.filter(F.split(values, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)
    return _let(codes, lambda c: F.filter(F.zip_with(c, F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a * CHARACTERS + b), lambda x: x.isNotNull()))


def _pair_counts(values: DataFrame) -> dict[int, int]:
    """Counts over all rows; at most CHARACTERS ** 2 of them."""
    rows = values.select(F.explode(_pairs(F.col("value"))).alias("pair")).where(F.col("pair").between(0, CHARACTERS**2 - 1)).groupBy("pair").count()
    return {r["pair"]: r["count"] for r in rows.collect()}


def log_ratios(random: dict[int, int], ordinary: dict[int, int]) -> list[float]:
    """For each pair of characters, log P(second | first) as a random string less that as an ordinary identifier."""

    def model(counts: dict[int, int]) -> Callable[[int], float]:
        totals = [0] * CHARACTERS
        for pair, n in counts.items():
            totals[pair // CHARACTERS] += n
        return lambda pair: (counts.get(pair, 0) + EVEN / CHARACTERS) / (totals[pair // CHARACTERS] + EVEN)

    a, b = model(random), model(ordinary)
    if not random:
        return [0.0] * CHARACTERS**2
    return [math.log(UNIFORM / TOKEN_CHARACTERS + (1 - UNIFORM) * a(p)) - math.log(b(p)) for p in range(CHARACTERS**2)]


def _ordinary(docs: DataFrame, text_col: str) -> DataFrame:
    """Ordinary identifiers of all documents, what the base patterns match left out."""
    bare = F.regexp_replace(F.col(text_col).cast("string"), f"(?:{ASSIGN})|(?:{ACCESS})|(?:{HEX})", " ")
    return docs.select(F.explode(F.regexp_extract_all(bare, F.lit(f"({ORDINARY})"), 1)).alias("value")).where(F.col("value").rlike("[A-Za-z]"))


def _scored(found: DataFrame, ordinary: DataFrame) -> DataFrame:
    """``found`` with ``_markov``: free candidates whose log-likelihood ratio is high enough.

    Labelled samples: all secrets of the base patterns against ordinary identifiers.
    """
    assigned = F.transform("_assign", lambda m: F.regexp_extract(m["value"], ASSIGN, 2))
    secrets = F.flatten(F.array(assigned, F.transform("_access", lambda m: m["value"]), F.transform("_hex", lambda m: m["value"])))
    random = _pair_counts(found.select(F.explode(secrets).alias("value")))
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in log_ratios(random, _pair_counts(ordinary)))), ",").cast("array<double>")
    known = bool(random)  # without any secret there is nothing to compare with

    def secret(value: Column) -> Column:
        ratio = F.aggregate(_pairs(value), F.lit(0.0), lambda s, p: s + F.element_at(table, p + 1))
        return ratio >= F.greatest(F.lit(LEAST_RATIO), LEAST_MEAN * (F.length(value) - 1))

    return found.withColumn("_markov", F.filter("_free", lambda m: F.lit(known) & secret(m["value"])))


def _listed(kinds: tuple[str, ...]) -> Column:
    def tagged(n: int, kind: str) -> Column:
        return F.transform(f"_{kind}", lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("n"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.sort_array(F.flatten(F.array(*[tagged(n, k) for n, k in enumerate(kinds)])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col``, n_assign, n_access, n_hex, ``base_spans`` and ``spans`` (``kind:start:end`` joined by commas).

    Offsets are code points, ends exclusive; spans are ordered by start, then kind.  Base kinds follow the fixed patterns,
    leftmost and non-overlapping within a kind, matches with a secret that is too short dropped; ``markov`` spans are added
    where no base span lies.  The random model learns
    from all base secrets, the other from the ordinary identifiers of all documents.  Runs jobs.  Null and empty texts have no spans; ids may be
    null or repeated, each row stands for itself; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    scored = _scored(cut(_found(rows, "_text").drop("_text")), _ordinary(docs, text_col))
    return scored.select(
        F.col("_id").alias(id_col), *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        _joined(_listed(KINDS[:3])).alias("base_spans"), _joined(_listed(KINDS)).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", placeholder: str = PLACEHOLDER) -> DataFrame:
    """``docs`` with each run of overlapping secret spans in the text replaced by the placeholder; all columns stay.

    Texts without secrets, nulls included, come back as they are.  Runs jobs.
    """
    rows, own = aside(docs, text=text_col)
    found = cut(_found(rows, "text"))
    scored = _scored(found, _ordinary(docs, text_col)).withColumn("_spans", _listed(KINDS))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        # parts: the plain stretches between secrets.
        plain = F.struct(acc["end"].alias("start"), s["start"].alias("end"))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.when((s["start"] > acc["end"]) | (F.size(acc["parts"]) == 0), F.concat(acc["parts"], F.array(plain))).otherwise(acc["parts"]).alias("parts"))

    text = F.col("text").cast("string")

    def rebuilt(acc: Column) -> Column:
        kept = F.concat(acc["parts"], F.array(F.struct(acc["end"].alias("start"), F.length(text).alias("end"))))
        return F.array_join(F.transform(kept, lambda p: F.substring(text, p["start"] + 1, p["end"] - p["start"])), placeholder)

    new = F.when(F.size("_spans") > 0, _let(F.aggregate("_spans", start, add), rebuilt)).otherwise(text)
    return scored.withColumn("text", new).select(*own.values())
