"""From raw documents to packed training sequences; each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.durable import cut, scratch_path
from flowtide.llm.bpe import vocabulary
from flowtide.llm.line_dedup import remove_widespread_lines
from flowtide.llm.ngram_join import BROADCAST_IDS, ngram_jaccard_join
from flowtide.llm.packing import cut_documents, pack
from flowtide.llm.quality_rules import keep_good
from flowtide.llm.secret_scan import redact_secrets

#: Lines of so many words go when they repeat in any two documents.
PASSAGE_WORDS = 50


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines and repeated passages; a document of which nothing is left was a copy and goes."""
    cleaned = remove_widespread_lines(docs, passage_words=PASSAGE_WORDS)
    return _counted(cleaned.where(~((F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S"))).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.8).

    Rows that repeat both id and text are one document.  Rows of one id with different texts all stay: a link names an id,
    not one of its texts, and none of them may be lost for another's sake.
    """
    groups = cut(ngram_jaccard_join(docs))
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    again = cut(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    repeated = not again.isEmpty()
    if repeated:
        digest = F.coalesce(F.sha2("text", 256), F.lit(""))
        texts = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
        gone = gone.join(texts.where("a <> b"), "doc_id", "left_anti")
    gone = cut(gone)
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)
    if not repeated:
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(once)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a placeholder."""
    return _counted(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts placed in sequences of at most 4096 tokens."""
    return pack(cut_documents(docs, vocabulary("word_bpe_49k.json"), end_id=2, with_ids=False))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Vote models, tokens and packing have no SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written below ``spark.checkpoint.dir`` and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
