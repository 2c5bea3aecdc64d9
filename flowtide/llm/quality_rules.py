"""Quality filtering by weak supervision: rules vote or abstain, their accuracies are estimated, posteriors decide.

Everything on the main path is DataFrame code; the driver sees one count per vote pattern (at most 3 ** rules of them).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.functions.durable import cut

#: Characters between words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The symbols that count as markup, and the length of a repeat window.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Verdict: share of good documents that is assumed at first, and the posterior that keeps a document.
PRIOR_GOOD = 0.8
KEEP = 0.5
#: How a rule is thought to vote (bad, not at all, good) on good and on bad documents; where it starts, and what it is
#: drawn towards with the weight of so many documents.
START = {True: (0.02, 0.18, 0.80), False: (0.35, 0.30, 0.35)}
WEIGHT = 20.0
#: Rules are written to be precise: on good documents a bad vote is at most this likely.  Without that bound, one kind of
#: bad document can take over the class and the other kinds pass for good.
FALSE_ALARM = 0.02


def _neighbours(array: str, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of each element and the next; the last is given null."""
    return F.zip_with(array, F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0))), f)


def _measures(docs: DataFrame, id_col: str | Column, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    base = docs.select(key.alias("_id"), text.alias("_t"))
    base = base.select(
        "_id", "_t", F.regexp_extract_all("_t", F.lit(f"({WORD})"), 1).alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
    )
    counted = base.select(
        "_id", F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE + "+", "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.length(F.regexp_replace("_t", r"\P{L}+", "")).cast("bigint").alias("n_letters"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("bigint").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"[^0-9]+", "")).cast("bigint").alias("n_digits"),
        F.regexp_count("_t", F.lit(r"[^\p{L}\x20\x09-\x0D]*+\p{L}[^\x20\x09-\x0D]*+")).cast("bigint").alias("n_lettered"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?:;…。][\"'»”)]*\s*$"))).cast("bigint").alias("n_closed_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    counted = counted.withColumn("n_stutters", F.size(F.filter(_neighbours("_h", lambda a, b: a == b), lambda x: x)).cast("bigint"))
    # Hashes of 2, 4 and then 8 words from those of half the length.
    for half in (1, 2, 4):
        n = F.size("_h") - half
        counted = counted.withColumn(
            "_h", F.when(n > 0, F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(half + 1), n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
        )
    counted = counted.withColumn("_repeats", F.size(F.array_distinct("_h")) < F.size("_h"))
    # Only texts with a repeated window sort theirs: equal neighbours give the windows, gaps between them the words.
    placed = F.when(F.col("_repeats"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = counted.withColumn("_s", placed).drop("_h")
    equal = F.filter(_neighbours("_s", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda p: p.isNotNull())
    counted = counted.withColumn("_p", F.when(F.col("_repeats"), F.sort_array(F.array_distinct(F.flatten(equal))))).drop("_s")
    gaps = _neighbours("_p", lambda a, b: F.least(F.lit(WINDOW), b - a))  # the last has no neighbour and counts in full
    covered = F.aggregate(gaps, F.lit(0), lambda s, g: s + g)
    return counted.withColumn("n_repeat_words", F.when(F.col("_repeats"), covered).otherwise(0).cast("bigint")).drop("_p", "_repeats")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, 0 bad, null abstains."""
    word, symbols, digits = _share("word_chars", "n_words"), _share("n_symbols", "word_chars"), _share("n_digits", "word_chars")
    upper, closed = _share("n_upper", "n_letters"), _share("n_closed_lines", "n_lines")
    letters, repeats, lines = _share("n_letters", "word_chars"), _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")

    lettered, stutters = _share("n_lettered", "n_words"), _share("n_stutters", "n_words")

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    return {
        "length": vote(F.col("n_words") >= 40, F.col("n_words") < 20),
        "word_length": vote((word >= 3.5) & (word <= 9), (word < 2.5) | (word > 14)),
        "symbols": vote(symbols <= 0.002, symbols > 0.02),
        "digits": vote(digits <= 0.05, digits > 0.2),
        "capitals": vote(upper <= 0.12, upper > 0.4),
        "letters": vote(letters >= 0.85, letters < 0.65),
        "repeats": vote(repeats <= 0.05, repeats > 0.3),
        "lines": vote(lines <= 0.1, lines > 0.4),
        "lettered": vote(lettered >= 0.92, lettered < 0.8),
        "stutters": vote(stutters <= 0.02, stutters > 0.15),
        "sentences": vote(closed >= 0.7, closed < 0.2),
    }


#: Of each rule, the probabilities of its votes (bad, none, good) on good and on bad documents.
Accuracy = list[dict[bool, tuple[float, float, float]]]


def fit_rules(patterns: list[tuple[tuple[int | None, ...], int]], rules: int, rounds: int = 200) -> tuple[float, Accuracy]:
    """Share of good documents and how each rule votes on either class, by expectation-maximisation over vote counts.

    Votes are independent given the class.  Deterministic; without patterns the starting values come back.
    """
    prior, accuracy = PRIOR_GOOD, [dict(START) for _ in range(rules)]
    for _ in range(rounds):
        seen = [{y: [WEIGHT * s for s in START[y]] for y in (True, False)} for _ in range(rules)]
        good, total = WEIGHT * PRIOR_GOOD, WEIGHT
        for votes, n in patterns:
            p = posterior(prior, accuracy, votes)
            good, total = good + n * p, total + n
            for rule, v in zip(seen, votes, strict=True):
                rule[True][_place(v)] += n * p
                rule[False][_place(v)] += n * (1 - p)
        new = [{y: _shares(rule[y], FALSE_ALARM if y else 1.0) for y in rule} for rule in seen]
        change = max([abs(a - b) for x, y in zip(new, accuracy, strict=True) for k in x for a, b in zip(x[k], y[k], strict=True)], default=0.0)
        prior, accuracy = good / total, new
        if change < 1e-6:
            break
    return prior, accuracy


def _shares(counts: list[float], most_bad: float) -> tuple[float, float, float]:
    bad, none, good = (c / sum(counts) for c in counts)
    if bad > most_bad:
        bad, none, good = most_bad, none * (1 - most_bad) / (none + good), good * (1 - most_bad) / (none + good)
    return bad, none, good


def _place(vote: int | None) -> int:
    return 1 if vote is None else 2 * vote


def _weights(accuracy: Accuracy) -> list[tuple[float, float, float]]:
    """Log-odds that each rule's bad vote, abstention and good vote add."""
    return [tuple(math.log(g / b) for g, b in zip(rule[True], rule[False], strict=True)) for rule in accuracy]


def posterior(prior: float, accuracy: Accuracy, votes: tuple[int | None, ...]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(w[_place(v)] for w, v in zip(_weights(accuracy), votes, strict=True))
    return 1 / (1 + math.exp(-odds))


def _voted(docs: DataFrame, id_col: str | Column, text_col: str) -> DataFrame:
    return _measures(docs, id_col, text_col).select("*", *[v.cast("int").alias(f"_v_{k}") for k, v in _votes().items()])


def _judged(voted: DataFrame, prior: float, accuracy: Accuracy) -> DataFrame:
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, (bad, none, good) in zip(_votes(), _weights(accuracy), strict=True):
        odds = odds + F.when(F.col(f"_v_{k}") == 1, good).when(F.col(f"_v_{k}") == 0, bad).otherwise(none)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = voted.withColumn("base_failed", failed).withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))


def _fitted(voted: DataFrame) -> tuple[float, Accuracy]:
    votes = [f"_v_{k}" for k in _votes()]
    rows = voted.groupBy(*votes).agg(F.count("*").alias("n")).collect()
    return fit_rules([(tuple(r[v] for v in votes), r["n"]) for r in rows], len(votes))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col``, counts, ``base_failed``, ``p_good`` (posterior of being good) and ``kept``.

    Counts: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word equal to an earlier one),
    n_repeat_words (words in 8-word windows found twice or more).  ``base_failed``: under 20 words or over 30 % repeat
    words.  ``kept`` is false if it holds, else whether the posterior is at least one half.  The votes' model is estimated
    over all rows.  Runs jobs.  Null and empty texts count nothing and fail; ids may be null or repeated, each row stands
    for itself; extra columns are ignored; an empty table gives an empty result.
    """
    voted = cut(_voted(docs, id_col, text_col))
    return _judged(voted, *_fitted(voted)).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept"
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Measures are taken once for the model and once for the filter, so that no text is shuffled and rows need no key.
    """
    prior, accuracy = _fitted(_voted(docs, F.lit(0), text_col))
    # A row number that the filter also names keeps it above the measures; pushed below, it would repeat all of them.
    voted = _voted(docs, F.struct("*"), text_col).withColumn("_row", F.monotonically_increasing_id())
    return _judged(voted, prior, accuracy).where("kept and _row >= 0").select("_id.*")
