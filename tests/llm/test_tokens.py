"""Piece encoding, and what is built on it, against the public libraries and plain single-threaded versions."""

import hashlib
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowtide.llm import bpe, packing, piece_bpe, queries, token_alignment
from flowtide.llm.bpe import _byte_alphabet, vocabulary
from flowtide.llm.piece_bpe import decode_pieces, encode_pieces, piece_model
from flowtide.functions.durable import rows_a_batch
from flowtide.llm.token_alignment import _gathered, align_tokens

ROOT = Path(__file__).resolve().parents[2]
POOL = "aAbBzZ'sdtm  \t\n\r\x0b\x1c\x85\xa0　İΣσßÉé漢字🎉👩‍👧0123½²|<>endoftext​한가!?.,;:#$%&*\x00▁ "
SCHEMA = "doc_id bigint, text string, lang string, source string, id string, ids string"
NAME = "piece_bpe_32k.model"


def public():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))


def texts():
    rng = random.Random(11)
    out = ["".join(rng.choices(POOL, k=rng.randint(0, 60))) for _ in range(800)]
    out += ["".join(rng.choices(rng.sample("abeinrst  ", 4), k=rng.randint(0, 200))) for _ in range(800)]
    out += ["", " ", "  ", "▁", "a" * 5000, "ab" * 4000, " " * 2000, "x " * 3000, "\n" * 100, " \n" * 50, "<s>a</s><unk><0x0A>", " " * 17 + "the" + " " * 33, "🎉" * 500]
    return [*out, "inin" * 500 + "ere" * 600, "the quick " * 3000, *[" " * k + "t" + " " * k for k in range(40)]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", "y") for i, t in rows], SCHEMA)


def test_pieces_are_the_public_ones(spark):
    s, rows, load = public(), list(enumerate(texts())), piece_model(NAME)
    docs = frame(spark, [*rows, (None, None), (0, rows[0][1])])
    encoded = encode_pieces(docs, load)
    assert encoded.columns == ["doc_id", "ids"]
    got = encoded.collect()
    assert len(got) == len(rows) + 2
    by = {r["doc_id"]: r["ids"] for r in got}
    assert by[None] == [1, 2] and all(by[i] == s.encode(t, add_bos=True, add_eos=True) for i, t in rows)
    packed = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in encode_pieces(docs, load, begin=False, end=False, packed=True).collect()}
    assert all(packed[i] == s.encode(t) for i, t in rows)
    decoded = {r["doc_id"]: r["text"] for r in decode_pieces(encoded, load).collect()}
    assert all(decoded[i] == s.decode(by[i]) == t.replace("▁", " ") for i, t in rows)
    assert encode_pieces(docs.limit(0), load).count() == 0 and decode_pieces(encoded.limit(0), load).count() == 0


def test_any_ids_decode_like_the_public_ones(spark):
    rng, s, load = random.Random(2), public(), piece_model(NAME)
    lists = [[rng.choice([0, 1, 2, 259, 29871, rng.randint(3, 258), rng.randint(190, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    encoded = spark.createDataFrame([*enumerate(lists), (-1, None)], "doc_id bigint, ids array<int>")
    decoded = {r["doc_id"]: r["text"] for r in decode_pieces(encoded, load).collect()}
    assert decoded.pop(-1) is None and all(decoded[i] == s.decode(ids) for i, ids in enumerate(lists))


def test_rounds_agree_with_single_merges():
    m = piece_model(NAME)()
    units = {u for t in texts() for u in m.units(t) if len(u) < 300} | {"", "a" * 700}
    units = sorted(units)
    for unit, ids in zip(units, m.merged(units), strict=True):
        codes = np.array(m.merges.finish(m.symbols(unit).tolist()), np.int32)
        assert ids == m.ids(codes, np.array([len(codes)]))[0].tobytes()


def test_piece_query(spark, tmp_path):
    s, rows = public(), [*enumerate(texts()[-60:]), (7777, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_piece_round_trip(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = s.encode(t or "", add_bos=True, add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(s.decode(ids).encode()).hexdigest()


def plain_alignment(rows, links="ends"):
    """By definition, with the public libraries: ``{doc_id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)}``."""
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), public()
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(_byte_alphabet())}
    made, counts = {}, Counter()
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spell_a = [bytes(byte_of[c] for c in a.id_to_token(x)) for x in ids_a]
        spell_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ids_b for p in [b.id_to_piece(x)]]
        if not text or b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
            made[i] = None
            continue
        ends_a, ends_b = ([sum(map(len, spell[: k + 1])) for k in range(len(spell))] if len(spell) < 300 else np.cumsum(list(map(len, spell))).tolist() for spell in (spell_a, spell_b))
        groups, pairs, at_a, at_b = [], [], 0, 0
        in_b = {e: j for j, e in enumerate(ends_b)}
        for k, end in enumerate(ends_a):
            if end in in_b:
                own_a, own_b = ids_a[at_a : k + 1], ids_b[at_b : in_b[end] + 1]
                groups.append((own_a, own_b))
                pairs += [(own_a[-1], own_b[-1])] if links == "ends" else [(x, y) for x in own_a for y in own_b]
                at_a, at_b = k + 1, in_b[end] + 1
        made[i] = len(ids_a), len(ids_b), groups, pairs
        counts.update(pairs)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = {}
    for i, m in made.items():
        if m is None:
            out[i] = (0, 0, 0, 0, 0, 0, "")
        else:
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in m[2])
            out[i] = (m[0], m[1], len(m[2]), len(m[3]), sum(counts[p] == most[p[1]] for p in m[3]), sum(counts[p] for p in m[3]), text)
    return out


@pytest.mark.parametrize("links", ["ends", "groups"])
def test_alignment_is_the_plain_one(spark, links):
    rows = [*enumerate(texts()), (-1, "a<|endoftext|>b <|endoftext|>"), (-2, "hid▁den"), (-3, "odd \x1c\x1d space\x1f x \x1e"), (-4, " lead"), (-5, "trail "), (-6, "a \n b\n\n c\n d  e\t f")]
    docs = frame(spark, [*rows, (None, None)]).repartition(5)
    out = align_tokens(docs, vocabulary("byte_bpe_50k.json"), piece_model(NAME), links=links, block_bytes=20_000)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got, want = {r[0]: tuple(r)[1:] for r in out.collect()}, plain_alignment(rows, links)
    assert got.pop(None) == (0, 0, 0, 0, 0, 0, "") and got[-2] == (0, 0, 0, 0, 0, 0, "")
    assert got.keys() == want.keys() and all(got[i] == want[i] for i in want)
    assert align_tokens(docs.limit(0), vocabulary("byte_bpe_50k.json"), piece_model(NAME)).count() == 0


def test_blocks_are_gathered_from_small_batches(spark):
    lists = [["aaa", None, "é"], [], ["x" * 20, "yy", "zz"], ["q"] * 9, [None, None]]
    batches, at = [], 0
    for t in lists:
        batches.append(pa.RecordBatch.from_arrays([pa.array(range(at, at + len(t)), pa.int64()), pa.array(t, pa.string())], names=["id", "text"]))
        at += len(t)
    for most in (1, 4, 5, 10, 100):
        blocks = [b.to_pydict() for b in _gathered(iter(batches), most)]
        assert [t for b in blocks for t in b["text"]] == [t for x in lists for t in x] and [i for b in blocks for i in b["id"]] == list(range(at))
        assert all(sum(len((t or "").encode()) for t in b["text"]) <= most or sum(bool(t) for t in b["text"]) == 1 for b in blocks)
    assert [b.num_rows for b in _gathered(iter(batches), 100)] == [at] and list(_gathered(iter([]), 5)) == []

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with rows_a_batch(spark, 16):
        assert max(r["n"] for r in spark.range(0, 500, 1, 2).mapInArrow(sizes, "n bigint").collect()) == 16
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_alignment_query(spark, tmp_path):
    rows = [*enumerate(texts()[-80:]), (901, texts()[-1]), (901, texts()[-1])]
    frame(spark, [*rows, (7777, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_token_alignment(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = plain_alignment([(k, t) for k, (_, t) in enumerate(rows)])
    want = sorted((i, *want[k][:6], hashlib.sha256(want[k][6].encode()).hexdigest() if want[k][6] else "") for k, (i, _) in enumerate(rows))
    assert sorted(tuple(r) for r in out.collect()) == [*want, (7777, 0, 0, 0, 0, 0, 0, "")]


MEMORY = """
import random, re, threading, time, sys
from flowtide.llm.bpe import vocabulary
from flowtide.llm.piece_bpe import piece_model
def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
model = piece_model("piece_bpe_32k.model")() if sys.argv[1] == "pieces" else vocabulary("byte_bpe_50k.json")()
list(model.encode(["a few words, so that tables are made"]))
rng = random.Random(1)
texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(300)) for _ in range(1500)]
start, most = held(), [0]
def watch():
    while True:
        most[0] = max(most[0], held())
        time.sleep(0.01)
threading.Thread(target=watch, daemon=True).start()
for ids in model.encode(texts):
    pass
print(round(most[0] - start))
"""


@pytest.mark.parametrize("kind, most", [("pieces", 70), ("bytes", 98)])
def test_encoding_holds_a_small_group(kind, most):
    ran = subprocess.run([sys.executable, "-c", MEMORY, kind], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    assert int(ran.stdout) < most  # MB


def test_workers_hand_memory_back(spark, monkeypatch):
    from flowtide.functions import workers

    calls = []
    monkeypatch.setattr(workers, "hand_back", lambda: calls.append(1))
    batches = [pa.record_batch({"x": [i]}) for i in range(3)]
    assert list(workers.handing_back(lambda given: given)(iter(batches))) == batches and len(calls) == 1
    started = workers.handing_back(lambda given: given)(iter(batches))
    next(started)
    started.close()
    assert len(calls) == 2

    wrapped = []
    for module in (token_alignment, packing, piece_bpe, bpe):
        monkeypatch.setattr(module, "handing_back", lambda run: wrapped.append(run.__module__) or run)
    docs = frame(spark, [(1, "a few words"), (None, None)])
    align_tokens(docs, vocabulary("byte_bpe_50k.json"), piece_model(NAME))
    packing.cut_documents(docs, vocabulary("word_bpe_49k.json"))
    decode_pieces(encode_pieces(docs, piece_model(NAME)), piece_model(NAME))
    bpe.decode_documents(bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json")), vocabulary("byte_bpe_50k.json"))
    assert wrapped == [m.__name__ for m in (token_alignment, packing, piece_bpe, piece_bpe, bpe, bpe)]
