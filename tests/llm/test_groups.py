"""Links, components, languages, perplexities and conversations against plain single-threaded versions."""

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.llm import ngram_join
from flowtide.llm.components import components
from flowtide.llm.embedding_dedup import embedding_near_duplicates, tile_links
from flowtide.llm.hashing import shingle_set, word_hashes
from flowtide.llm.kneser_ney import BITS, CLASSES, ORDER, _scorer, classes_of, count_grams, grams_of, joined_perplexities, kneser_ney, perplexities, quality_classifier
from flowtide.llm.language_id import LINES, STRETCH, Chains, language_id, training_lines, word_features
from flowtide.llm.ngram_join import ngram_jaccard_join
from flowtide.llm.quotation import link_quotations


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_a_path_a_star_and_noise(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(100, 160)] + [(7, 7), (5, 5), (300, 301), (301, 300)]
    edges = spark.createDataFrame([*links, (None, 3), (4, None)], "u bigint, v bigint")
    want = roots({x for e in links for x in e} - {7, 5} | {7, 5}, links)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {n: c for n, c in want.items()}
    assert components(edges.limit(0)).count() == 0


def words(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    out, word = [], ""
    for c in lower + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_similarity_join_is_exact(spark, width, percent):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choices(vocabulary, k=rng.choice([4, 30, 120])) for _ in range(25)]
    docs = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, " ".join(w), 1))
    hub = rng.choices(vocabulary, k=100)
    docs += [(1000 + i, " ".join(hub[: i % 90] + [f"new{i}"] + hub[i % 90 + 1 :]), 1) for i in range(150)]  # near copies of one text
    docs += [(2000 + i, "Same  words\there É", 1) for i in range(40)] + [(2100, "same words here É", 1)]
    docs += [(3000, None, 1), (3001, "", 1), (3002, " \n\t ", 1), (3003, "one", 1), (3004, "ONE", 1), (3005, "x" * 100_000, 1), (None, "one", 1), (0, docs[0][1], 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, n int")
    got = ngram_jaccard_join(frame, width=width, percent=percent).collect()
    assert len(got) == len(docs)
    sets = {i: shingles(t, width) for i, t, _ in docs if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(sets, links)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == len(sets[r["doc_id"]])
    assert ngram_jaccard_join(frame.limit(0)).count() == 0


@pytest.mark.parametrize("width, percent, size", [(5, 80, 80), (3, 90, 90)])
def test_similarity_join_finds_insertions_and_containment(spark, width, percent, size):
    docs, most = [], size * 100 // percent - size
    for added in range(most + 2):
        w = [f"{added}w{i}" for i in range(size + width - 1)]
        new = [f"{added}n{i}" for i in range(added)]
        inner = [*w[: size // 2], *new[: max(0, added - width + 1)], *w[size // 2 :]]  # inserted: takes width - 1 shingles away, too
        docs += [(4 * added, " ".join(w)), (4 * added + 1, " ".join([*w, *new])), (4 * added + 2, " ".join([*new, *w])), (4 * added + 3, " ".join(inner))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    sets = {i: shingles(t, width) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(frame, width=width, percent=percent).collect()} == roots(sets, links)
    for added in (1, most // 2, most, most + 1):  # isolated: one text, and the text with rare text added
        two = frame.where(f"doc_id in ({4 * added}, {4 * added + 1})")
        got = [r["component_id"] for r in ngram_jaccard_join(two, width=width, percent=percent).collect()]
        assert len(set(got)) == (1 if added <= most else 2)


def test_similarity_join_plans_small_steps(spark, monkeypatch):
    plans, cut = [], ngram_join.cut

    def noted(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        plans.append(out.getvalue())
        return cut(df)

    monkeypatch.setattr(ngram_join, "cut", noted)
    base = [f"w{i}" for i in range(60)]
    near = [(i, " ".join([*base[:i], f"new{i}", *base[i + 1 :]])) for i in range(40)]
    docs = spark.createDataFrame([*near, (100, "alone in here"), (101, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(docs).collect()}
    want = roots(dict(near), [(a, b) for a, x in near for b, y in near if a < b and (s := shingles(x, 5)) and 100 * len(s & (t := shingles(y, 5))) >= 80 * len(s | t)])
    assert got == want | {100: 100, 101: 101}
    assert max(p.count("Exchange") for p in plans) <= 16, sorted(p.count("Exchange") for p in plans)


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    import flowtide.llm.hashing as h

    text = " ".join(random.Random(1).choices(["alpha", "Beta", "é", "x" * 70], k=500)).encode()
    whole = word_hashes(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(h, "CHUNK", 64)
    assert (word_hashes(np.frombuffer(text, np.uint8)) == whole).all() and len(set(whole.tolist())) == 4
    assert len(shingle_set(whole[:2], 3)) == 1 and len(shingle_set(whole[:0], 3)) == 0


def test_embedding_links_are_exact(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = [(i, int(i % 3), (centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4])).tolist()) for i in range(400)]
    vectors += [(500 + i, 1, vectors[1][2]) for i in range(150)] + [(700, 1, [2 * x for x in vectors[1][2]])]
    bad = [(800, None, vectors[0][2]), (801, 0, None), (802, 0, []), (803, 0, [0.0] * 16), (804, 0, [None] + [1.0] * 15), (805, 0, [float("nan")] * 16), (806, 0, [1.0, 2.0]), (None, 0, vectors[0][2])]
    frame = spark.createDataFrame([(*v, "z") for v in [*vectors, *bad]], "vec_id bigint, label int, embedding array<double>, key string")
    got = {r["vec_id"]: r for r in embedding_near_duplicates(frame, tile=64).collect()}
    assert len(got) == len(vectors) + len(bad)
    x = np.array([v[2] for v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels, ids = np.array([v[1] for v in vectors]), [v[0] for v in vectors]
    link = (x @ x.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    want = roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])
    for k, i in enumerate(ids):
        assert got[i]["n_links"] == link[k].sum() and got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i)
    assert all(got[b[0]]["n_links"] == 0 and got[b[0]]["component_id"] == b[0] for b in bad)
    assert embedding_near_duplicates(frame.limit(0)).count() == 0


def test_tiles_stop_early_without_losing_links():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)) * np.linspace(3, 0.1, 64)
    x = np.concatenate([x, x[:50] + rng.normal(size=(50, 64)) * 0.05])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert set(zip(*tile_links(x, x, 0.93), strict=True)) == set(zip(*np.nonzero(x @ x.T >= 0.93), strict=True))


def test_posteriors_by_hand():
    rng = np.random.default_rng(0)
    lengths = [5, 1, 300, 129, 128]
    scores, start, transition = rng.normal(size=(sum(lengths), 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    got, expected, _ = Chains(np.array(lengths)).posteriors(scores, start, transition, pairs=True)
    at, pairs = 0, np.zeros((3, 3))
    for n in lengths:
        a, b, e, t = np.zeros((n, 3)), np.ones((n, 3)), np.exp(scores[at : at + n]), np.exp(transition)
        for k in range(n):
            a[k] = (np.exp(start) if k == 0 else a[k - 1] @ t) * e[k]
            a[k] /= a[k].sum()
        for k in range(n - 2, -1, -1):
            b[k] = t @ (e[k + 1] * b[k + 1])
            b[k] /= b[k].sum()
        p = a * b
        assert np.allclose(got[at : at + n], p / p.sum(1, keepdims=True))
        for k in range(1, n):
            j = a[k - 1][:, None] * t * (e[k] * b[k])[None]
            pairs += j / j.sum()
        at += n
    assert np.allclose(expected, pairs)


ENGLISH = "the house of the old man was near the river and there she waited with her brother until the night".split()
GERMAN = "der alte Mann und seine Schwester wohnten nicht weit von dem Fluss und warteten auf die lange Nacht".split()


def test_languages_and_switches(spark):
    rng = random.Random(0)
    line = lambda w: " ".join(rng.choices(w, k=12))
    rows = [(i, "\n".join(line(ENGLISH if i % 2 else GERMAN) for _ in range(3)), "en" if i % 2 else "de", "s") for i in range(200)]
    odd = [(900, None, "en", "s"), (901, "", None, "s"), (902, "123 !!", "de", "s"), (903, line(ENGLISH) + "\n" + line(GERMAN) + "\n" + line(GERMAN), None, None), (None, line(GERMAN), None, None)]
    frame = spark.createDataFrame([*rows, *odd], "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in language_id(frame).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert held and all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[903]["lang_pred"] == "de" and 0.5 < got[903]["score"] < 0.8 and got[None]["lang_pred"] == "de"
    nothing = language_id(frame.where("lang is null"))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"} and language_id(frame.limit(0)).count() == 0


def test_training_lines_do_not_depend_on_copies(spark):
    few = spark.range(100_000).select(F.format_string("copied line number %d of a few", F.col("id") % 30).alias("text"), F.lit("aa").alias("lang"))
    many = spark.range(5000).select(F.format_string("one line number %d of very many", "id").alias("text"), F.lit("bb").alias("lang"))
    got = training_lines(few.union(many).union(many.limit(10).crossJoin(spark.range(2000)).select("text", "lang")), "text", "lang")
    assert sum(lang == "aa" for lang, _ in got) == 30
    smallest = [r["text"] for r in many.orderBy(F.xxhash64("text")).limit(LINES).collect()]
    assert [line for lang, line in got if lang == "bb"] == smallest


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words, lexicon = ["a", "haus", "x" * 90, "straße", "дом", "𝒳y"], {"haus": (1, 3)}
    flat, sizes = word_features(words, lexicon)
    assert flat.tolist() == [f for w in words for f in word_features([w], lexicon)[0].tolist()] and sizes.sum() == len(flat)
    grams = lambda w: sum(max(len(w) + 3 - k, 0) for k in (1, 2, 3, 4)) + 2 * min(len(w), 3)
    assert sizes.tolist() == [grams(w) + len(lexicon.get(w, ())) + 1 for w in words]


def test_many_languages_short_lines_and_long_lines_all_train(spark):
    rng = random.Random(1)
    words = [["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(20)] for _ in range(40)]
    rows = [(f"l{k:02d}", "\n".join(" ".join(rng.choices(words[k], k=2 if k == 7 else 8)) for _ in range(4))) for k in range(40) for _ in range(12)]
    frame = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id(frame).collect()}
    assert sum(got[i] == lang for i, (lang, _) in enumerate(rows)) >= 0.95 * len(rows)
    assert all(len(line) < 20 for _, t in rows if _ == "l07" for line in t.split("\n"))
    line = " ".join(f"w{chr(97 + i % 26)}{'q' * (i // 26)}" for i in range(300))
    parts = [p for _, p in training_lines(spark.createDataFrame([(line + "\n" + "z" * 900, "a")], "text string, lang string"), "text", "lang")]
    assert all(0 < len(p) <= STRETCH for p in parts) and sum(map(len, parts)) == len(line) + 500  # two of its three parts are equal
    assert {w for p in parts for w in p.split() if "z" * 50 not in w} == set(line.split())


def test_kneser_ney_sums_to_one_and_matches_a_plain_model(spark):
    texts = ["the cat sat on the mat.", "a cat and a hat", "that is the thing"] * 3 + ["cats", None, ""]
    counted = count_grams(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = {}
    for t in texts:
        for g in grams_of(classes_of(t or "")).tolist():
            want[g] = want.get(g, 0) + 1
    assert {r["gram"]: r["n"] for r in counted.collect()} == want
    scorer = _scorer(kneser_ney(counted))
    for context in {g >> BITS for g in want} | {12345}:
        assert np.exp(scorer.log_probabilities((context << BITS) + np.arange(CLASSES))).sum() == pytest.approx(1, abs=1e-5)

    def plain(gram):
        """The interpolated recursion written out over dictionaries."""
        levels, now = {}, want
        for order in range(ORDER, 0, -1):
            levels[order] = now
            low = {}
            for g in now:
                low[g & ((1 << BITS * (order - 1)) - 1)] = low.get(g & ((1 << BITS * (order - 1)) - 1), 0) + 1
            now = low
        p = 1 / CLASSES
        for order in range(1, ORDER + 1):
            counts = levels[order]
            n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
            d = (0.5, 0.5, 0.5)
            if n1 and n2:
                y = n1 / (n1 + 2 * n2)
                third = 3 - 4 * y * n4 / n3 if n3 else 1.0
                d = tuple(min(max(v, 0.05), top) for v, top in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (third, 3)))
            own = gram & ((1 << BITS * order) - 1)
            mates = {g: c for g, c in counts.items() if g >> BITS == own >> BITS}
            if mates:
                off = lambda c: d[min(c, 3) - 1]
                c = counts.get(own, 0)
                p = (max(c - off(c), 0) if c else 0) / sum(mates.values()) + sum(map(off, mates.values())) / sum(mates.values()) * p
        return p

    for g in [*list(want)[:20], 999, 123456]:
        assert np.exp(scorer.log_probabilities(np.array([g]))[0]) == pytest.approx(plain(g), rel=1e-4)


def test_letters_of_other_scripts_are_told_apart(spark):
    rng = random.Random(0)
    prose = "старый дом стоял над рекой и она ждала там брата до самой ночи".split()
    rows = [(i, " ".join(rng.choices(prose, k=60)), "ru") for i in range(40)] + [(50, "", "ru"), (51, None, "ru"), (52, "🎉 дом 漢字 \uffff", "ru")]
    for i in range(10):
        letters = list("".join(rng.choices(prose, k=60)))
        rng.shuffle(letters)
        rows.append((100 + i, " ".join("".join(letters[k : k + 5]) for k in range(0, len(letters), 5)), "ru"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {r["doc_id"]: r["kept"] for r in quality_classifier(frame, frame.where("doc_id < 40").select("doc_id"), quantile=1.0, slack=1.0).collect()}
    assert all(out[i] for i in range(40)) and not any(out[100 + i] for i in range(10))
    texts = frame.select("doc_id", "text")
    model = kneser_ney(count_grams(texts.where("doc_id % 2 = 0")))
    sent, joined = ({r["doc_id"]: r["perplexity"] for r in f.collect()} for f in (perplexities(texts, _scorer(model)), joined_perplexities(texts, model)))
    assert joined.keys() == sent.keys() and all(joined[i] == (p and pytest.approx(p, rel=1e-4)) for i, p in sent.items())


def test_classifier_keeps_what_reads_like_the_trusted(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(ENGLISH, k=60)), "en") for i in range(60)] + [(100 + i, " ".join("".join(rng.choices("#$%&XQZ!", k=6)) for _ in range(60)), "en") for i in range(10)]
    rows += [(200, None, "en"), (201, "", None), (202, " ".join(ENGLISH), None), (None, " ".join(ENGLISH), "xx"), (0, rows[0][1], "en")]
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, lang string, perplexity double")
    trusted = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(None, 1), (2, 1)], "doc_id bigint, text int")
    out = quality_classifier(frame, trusted).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["kept"] for i in range(60)) and not any(by[100 + i]["kept"] for i in range(10))
    assert not by[200]["kept"] and by[200]["perplexity"] is None and by[202]["kept"] and by[None]["kept"] and not by[None]["trusted"]
    assert quality_classifier(frame.limit(0), trusted).count() == 0
    assert all(r["kept"] for r in quality_classifier(frame, trusted.limit(0)).collect() if r["perplexity"] is not None)


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Where is the key?\nI need it."), (1, 1, "user", "Is the shop open?"),
        (1, 2, "assistant", "On Monday A wrote:\n> where IS the\n>   key? I need it.\n\nUnder the mat."), (1, 3, "user", "> > Where is the key?\n> > I need it.\n> Under the mat.\nThanks"),
        (1, 4, "assistant", "> Never said\nHm"), (1, 5, "user", ">Is the shop open?\n>> Never said\nYes"), (2, 0, "user", "> Where is the key? I need it.\nOther talk"),
        (2, 1, None, None), (None, 0, "user", "> x\nalone"), (3, None, "user", ""), (2, 1, "user", "again"),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, position int")
    out = link_quotations(frame).collect()
    assert len(out) == len(rows)
    got = {(r["conv_id"], r["turn"]): r for r in out}
    assert [(got[1, t]["parent_turn"], got[1, t]["by_quote"], got[1, t]["n_quotes"], got[1, t]["n_linked"], got[1, t]["depth"]) for t in range(6)] == [
        (None, False, 0, 0, 0), (0, False, 0, 0, 0), (0, True, 1, 1, 1), (2, True, 2, 2, 2), (3, False, 1, 0, 1), (1, True, 2, 1, 2),
    ]
    assert [got[1, t]["position"] for t in range(6)] == [0, 1, 2, 4, 5, 3]
    assert got[1, 2]["text"] == "Under the mat." and got[1, 3]["text"] == "Thanks" and got[1, 5]["text"] == "Yes"
    assert got[2, 0]["parent_turn"] is None and not got[2, 0]["by_quote"] and {r["text"] for r in out if (r["conv_id"], r["turn"]) == (2, 1)} == {"", "again"}
    assert got[None, 0]["text"] == "alone" and got[3, None]["position"] == 0 and link_quotations(frame.limit(0)).count() == 0


def test_join_hands_workers_few_rows(spark, monkeypatch):
    name, seen, cut = "spark.sql.execution.arrow.maxRecordsPerBatch", [], ngram_join.cut
    monkeypatch.setattr(ngram_join, "cut", lambda df: seen.append(int(spark.conf.get(name))) or cut(df))
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{k}" for k in range(12))) for i in range(6)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(6)}
    assert seen and max(seen) <= 512 and spark.conf.get(name) == before
