"""Text quality by perplexity: interpolated modified Kneser-Ney over characters, trained on trusted documents.

Counting, estimation and joins are DataFrame work on sharded n-gram tables, which grow with the trusted text.  The unit is the
code point.  A table of a counted size is sent to the tasks; beyond it each document's own n-grams, added up, are joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.durable import cut
from flowtide.llm.bpe import _slices

#: Length of the n-grams, and bits of a character class.  A code takes all bits of a bigint: shifts are unsigned.
ORDER, BITS = 4, 16
CLASSES = 1 << BITS
#: A document is kept up to this quantile of its language's trusted perplexities, times the slack.
QUANTILE, SLACK = 0.98, 1.5
#: Ids of trusted documents that may be broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: N-grams of all orders that may be sent to tasks (32 bytes each at most); beyond it documents are joined to the table.
BROADCAST_GRAMS = 2_000_000
#: Code points scored together; a longer text is taken in overlapping parts.
PART = 1 << 20
#: Memory that partial counts of a task may take before they are passed on: distinct n-grams.
DISTINCT = 1 << 21


def _class_table() -> np.ndarray:
    """Class of every code point below U+10000: blanks and controls are 0, all others stand for themselves."""
    return np.array([0 if c < 32 or chr(c).isspace() else c for c in range(1 << BITS)], np.int64)


_TABLE = _class_table()
#: Code points from U+10000 on share the classes of the surrogates and the private use area, which texts hardly hold.
_REST, _RESTS = 0xD800, 0xF900 - 0xD800


def classes_of(text: str) -> np.ndarray:
    """Character classes of a text, blanks before it so that its beginning has a context."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(codes < CLASSES, _TABLE[np.minimum(codes, CLASSES - 1)], _REST + codes.astype(np.int64) % _RESTS)
    return np.concatenate([np.zeros(ORDER - 1, np.int64), out.astype(np.int64)])


def grams_of(classes: np.ndarray) -> np.ndarray:
    """Codes of the n-grams that end at each character; the earliest character has the highest bits."""
    n = len(classes) - ORDER + 1
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out = out << BITS | classes[k : k + n]
    return out


def _mask(order: int) -> int:
    """Bits of the last ``order`` characters of a code, as a bigint."""
    return -1 if order * BITS == 64 else (1 << (BITS * order)) - 1


def _parts(text: str) -> Iterator[np.ndarray]:
    """N-gram codes of a text in bounded parts that together cover each character once."""
    for at in range(0, len(text), PART):
        lead = min(at, ORDER - 1)
        codes = grams_of(classes_of(text[at - lead : at + PART]))
        yield codes[lead:]


def count_grams(texts: DataFrame) -> DataFrame:
    """``(gram, n)`` over all rows of ``text``; tasks add up their own texts before anything is shuffled."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(have), pa.array(counts)], names=["gram", "n"])

        for batch in batches:
            for part in _slices(batch, "text"):
                codes = [c for t in part.column("text").to_pylist() if t for c in _parts(t)]
                if not codes:
                    continue
                new, n = np.unique(np.concatenate(codes), return_counts=True)
                have, where = np.unique(np.concatenate([have, new]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
                if len(have) > DISTINCT:
                    yield flushed()
                    have, counts = have[:0], counts[:0]
        yield flushed()

    return texts.select("text").mapInArrow(partial, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of a level from how many n-grams occur once, twice, three and four times."""
    n = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n1, n2, n3, n4 = (float(n.get(i, 0)) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    bound = lambda d, most: min(max(d, 0.05), most)
    return bound(1 - 2 * y * n2 / n1, 1.0), bound(2 - 3 * y * n3 / n2, 2.0), bound(3 - 4 * y * n4 / n3 if n3 else 1.0, 3.0)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``(gram, order, p, back)`` of every seen n-gram of orders 1 to ORDER, gram coded with a leading 1 bit by order.

    ``p`` is its interpolated probability, ``back`` what its context leaves to the lower order.  The highest order counts
    occurrences, lower orders the distinct characters that precede (continuations).  Each level is two hash aggregations
    and two joins: with its contexts, and with the level below.
    """
    level, levels = cut(counts), []
    for order in range(ORDER, 0, -1):
        levels.append((order, level))
        mask = (1 << (BITS * (order - 1))) - 1
        level = cut(level.groupBy(F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count("*").alias("n")))
    done, lower = None, None
    for order, level in reversed(levels):
        d1, d2, d3 = _discounts(level)
        rows = level.withColumn("context", F.shiftrightunsigned("gram", BITS)).withColumn("d", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        own = rows.join(contexts, "context").withColumn("back", F.col("left") / F.col("total")).withColumn("own", (F.col("n") - F.col("d")) / F.col("total"))
        if lower is None:
            own = own.withColumn("p", F.col("own") + F.col("back") / CLASSES)
        else:
            mask = (1 << (BITS * (order - 1))) - 1
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(mask)).join(lower, "suffix").withColumn("p", F.col("own") + F.col("back") * F.col("p_lower"))
        own = cut(own.select("gram", "p", "context", "back"))
        lower = own.select(F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
        tagged = own.select(F.lit(order).alias("order"), "gram", "p", "context", "back")
        done = tagged if done is None else done.union(tagged)
    return done


class Scorer:
    """Log-probabilities of n-grams from the seen ones of each order."""

    def __init__(self, tables: dict[int, tuple[np.ndarray, np.ndarray]], backs: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.tables, self.backs = tables, backs

    def log_probabilities(self, grams: np.ndarray) -> np.ndarray:
        """A seen n-gram has its own probability; an unseen one what its contexts leave, down to the first order seen."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            keys, values = self.tables[order]
            own = grams[left] & _mask(order)
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            out[left[hit]] += values[at[hit]]
            left, own = left[~hit], own[~hit]
            keys, values = self.backs[order]
            if len(left) and len(keys):
                context = (own.view(np.uint64) >> np.uint64(BITS)).view(np.int64)
                at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
                out[left] += np.where(keys[at] == context, values[at], 0.0)
        out[left] -= np.log(CLASSES)
        return out

    def perplexity(self, text: str | None) -> float | None:
        total, n = 0.0, 0
        for codes in _parts(text or ""):
            distinct, times = np.unique(codes, return_counts=True)
            total += float(self.log_probabilities(distinct) @ times)
            n += len(codes)
        return float(np.exp(-total / n)) if n else None


def _scorer(model: DataFrame) -> Scorer:
    """The model as sorted arrays, for a table of at most ``BROADCAST_GRAMS`` n-grams."""
    table = model.select("order", "gram", F.log("p").cast("float").alias("p"), "context", F.log("back").cast("float").alias("b")).toArrow()
    order, gram, p, context, back = (table.column(c).to_numpy() for c in ("order", "gram", "p", "context", "b"))
    tables, backs = {}, {}
    for k in range(1, ORDER + 1):
        own = order == k
        by = np.argsort(gram[own])
        tables[k] = gram[own][by], p[own][by]
        keys, first = np.unique(context[own], return_index=True)
        backs[k] = keys, back[own][first]
    return Scorer(tables, backs)


def perplexities(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``docs`` (with ``text``) and the perplexity of each whole text; null for empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                scores = [shared.value.perplexity(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores, pa.float64())], names=[*names, "perplexity"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(run, f"{schema}, perplexity double")


def joined_perplexities(docs: DataFrame, model: DataFrame) -> DataFrame:
    """As ``perplexities``, by joins with the sharded table: each text's distinct n-grams, then what each n-gram met costs.

    An n-gram is looked up once for all texts, from the highest order down.
    """
    names = [c for c in docs.columns if c != "text"]
    docs = cut(docs.withColumn("_row", F.monotonically_increasing_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text"):
                for row, text in zip(part.column("_row").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for codes in _parts(text or ""):
                        grams, n = np.unique(codes, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), row)), pa.array(grams), pa.array(n)], names=["_row", "gram", "n"])

    counts = cut(docs.select("_row", "text").mapInArrow(run, "_row bigint, gram bigint, n bigint"))
    left, costs = counts.select("gram", F.lit(0.0).alias("log_p")).distinct(), None
    for order in range(ORDER, 0, -1):
        table = model.where(F.col("order") == order)
        seen = table.select(F.col("gram").alias("own"), F.log("p").alias("l"))
        backs = table.groupBy("context").agg(F.log(F.first("back")).alias("b"))
        left = left.withColumn("own", F.col("gram").bitwiseAND(_mask(order)))
        met = cut(left.join(seen, "own", "left"))
        hit = met.where("l is not null").select("gram", (F.col("log_p") + F.col("l")).alias("log_p"))
        costs = hit if costs is None else costs.union(hit)
        missed = met.where("l is null").withColumn("context", F.shiftrightunsigned("own", BITS)).join(backs, "context", "left")
        left = cut(missed.select("gram", (F.col("log_p") + F.coalesce("b", F.lit(0.0))).alias("log_p")))
    costs = costs.union(left.withColumn("log_p", F.col("log_p") - float(np.log(CLASSES))))
    sums = counts.join(costs, "gram").groupBy("_row").agg(F.exp(-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("perplexity"))
    return docs.drop("text").join(sums, "_row", "left").select(*names, "perplexity")


def quality_classifier(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK
) -> DataFrame:
    """Per row ``id_col``, ``lang``, ``trusted``, ``perplexity``, ``threshold`` and ``kept``.

    ``trusted`` holds the ids (column ``id_col``) of documents to learn from; all of their text is counted.  A document is
    kept if its perplexity is at most its language's threshold: the quantile of that language's trusted documents times the
    slack; languages without one use that of all trusted documents.  Without trusted documents all are kept.  Null or empty
    texts have no perplexity and are not kept.  Null ids are never trusted, null languages are a language of their own;
    repeated rows are scored each.  Runs jobs; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    ids = cut(trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    model = kneser_ney(count_grams(rows.join(few, "id", "left_semi")))
    scores = perplexities(rows, _scorer(model)) if model.count() <= BROADCAST_GRAMS else joined_perplexities(rows, model)
    flagged = scores.join(ids.withColumn("trusted", F.lit(True)), "id", "left")
    scored = cut(flagged.withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    learned = scored.where("trusted and perplexity is not null")
    mark: Column = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = learned.groupBy("lang").agg(mark.alias("own")).withColumnRenamed("lang", "_lang")
    overall = learned.agg(mark.alias("all")).first()["all"]
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    joined = joined.withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")) * slack)
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return joined.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "trusted", "perplexity", "threshold", kept.alias("kept"))
