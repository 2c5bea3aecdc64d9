"""The stages on the smallest tables, and the queries that have SQL against it."""

import glob
import math
import os

import duckdb
import pytest

import corpus_pipeline
from flowtide.functions import durable, workers
from flowtide.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(90001, None, None, None, None), (None, "", "en", "s", 0), (90002, "word " * 50_000, "en", "s", 250_000)], docs.schema)
    docs = docs.union(extra).union(docs.limit(2))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
        if name == "near_duplicates":
            ids = [r[0] for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids))
            again = stage(spark, docs, SMALL)
            assert again.count() == len(ids)
    assert docs.select("doc_id").distinct().count() == before


def test_passages_on_few_sites_are_kept_once(spark):
    passages = {n: " ".join(f"p{n}w{i}" for i in range(51)) for n in range(1, 8)}  # n sites; one site: two of its documents
    rows = [(100 * n + k, f"Own line {n} {k} of this document.\n{p}", "en", f"site{k % n}", 0) for n, p in passages.items() for k in range(n + 1)]
    rows += [(9000 + k, f"Other line {k} of this document.\n" + " ".join(f"s{i}" for i in range(49)), "en", f"site{k}", 0) for k in range(7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, SMALL).collect()}
    assert out.keys() == {r[0] for r in rows}
    for n, p in passages.items():
        assert [i for i, t in out.items() if p in t] == [100 * n]
    assert all(len(out[9000 + k].split("\n")) == 2 for k in range(7))


def test_texts_of_one_id_are_not_lost_for_each_other(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(3)), (3, text(3)), (4, text(4)), (4, text(4)), (5, text(1)), (None, text(6)), (None, text(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()), key=repr)
    assert out == sorted([(1, text(1)), (1, text(2)), (2, text(3)), (4, text(4)), (None, text(6)), (None, text(7))], key=repr)


def test_driver_hands_unused_memory_back_after_each_step(spark, monkeypatch):
    monkeypatch.setattr(workers, "_driver_next", float("-inf"))
    assert workers.driver_hands_back(spark) and not workers.driver_hands_back(spark)
    monkeypatch.setattr(workers, "_driver_next", float("-inf"))
    collected = []
    monkeypatch.setattr(workers.gc, "collect", lambda: collected.append(1))
    assert workers.driver_hands_back(spark) and collected
    done, docs = [], spark.createDataFrame([(i, " ".join(f"w{i // 2}x{k}" for k in range(40)), "en", "s", 0) for i in range(8)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    monkeypatch.setattr(durable, "driver_hands_back", lambda session: done.append(session))
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()} == {0, 2, 4, 6}
    assert len(done) > 5


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_quality_threshold_is_the_quantile(spark):
    by_lang = {}
    for r in queries.op9_quality_classifier(spark, SMALL).where("trusted and perplexity is not null").collect():
        by_lang.setdefault((r["lang"], r["threshold"]), []).append(r["perplexity"])
    assert by_lang and all(sum(p < threshold for p in own) < math.ceil(0.97 * len(own)) <= sum(p <= threshold for p in own) for (_, threshold), own in by_lang.items())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())
