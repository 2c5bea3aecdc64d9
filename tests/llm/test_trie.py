"""The trie of conversations against a plain dictionary of prefixes, with awkward rows."""

import hashlib
import random
import re
import zlib

import pytest

from flowtide.llm import queries
from flowtide.llm.prefix_trie import graft_heads, prefix_trie, turn_keys

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, depth string, a string, block string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def tie(turn):
    _, role, text = turn
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def ordered(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(own, key=lambda t: (t[0] is not None, t[0] or 0, tie(t)))] for c, own in out.items()}


def grafted(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for k in members:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, own in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] = leaves.get(k[:d], 0) + (k not in kids)
            saved[k[:d]] = saved.get(k[:d], 0) + ((len(own) - 1) * len(WORD.findall(k[-1][1])) if k else 0)
    ends = lambda k, own: hashlib.sha256(",".join(map(str, sorted(c for c in own if len(convs[c]) == len(k)))).encode()).hexdigest()
    return {(min(own), len(k), min(members[k[:-1]]) if k else None, len(own), kids.get(k, 0), leaves[k], saved[k], ends(k, own)) for k, own in members.items()}


def awkward():
    rng = random.Random(4)
    rows = [(c, t, "user" if t % 2 else "assistant", f"{rng.choice('ab')} word  two\n") for c in range(120) for t in range(rng.randint(1, 11))]
    rows += [(c, t, "user", f"same {t}") for c in range(9000, 9150) for t in range(6)]  # copies; ids over several chunks below
    rows += [(5000 * c, t, "user", f"same {t}") for c in range(3, 9) for t in range(6)]
    rows += [(400, t, "user", f"long {t}") for t in range(700)] + [(401, t, "user", f"long {t}") for t in range(650)]
    rows += [(500, None, "user", "no turn"), (500, None, None, None), (500, 3, "user", "x"), (500, 3, "user", "a"), (500, 3, "user", "a"), (501, 0, "", ""), (501, 0, "1:", "")]
    return [*rows, (None, 0, "user", "nobody"), (-20, 0, "user", "below zero"), (-21, 1, "user", "a"), (-7, 0, None, None), (603, 0, "user", "x"), (777, 0, "user", "y"), (777, -5, "user", "z"), (800, 0, "user", "w " * 20_000)]


@pytest.mark.parametrize("block_turns", [1, 4])
def test_trie_is_the_plain_one(spark, block_turns):
    turns, ids = graft_heads(turn_keys(frame(spark, awkward())))
    out = prefix_trie(turns, ids, block_turns)
    assert out.columns == COLUMNS
    got, want = [tuple(r) for r in out.collect()], plain(grafted(ordered(awkward())))
    assert any(len(k) == 0 for k in grafted(ordered(awkward())).values()) and len(got) == len(want) and set(got) == want


def test_trie_without_grafts_and_without_rows(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes yes")]
    turns = turn_keys(frame(spark, rows))
    assert {tuple(r) for r in prefix_trie(turns).collect()} == plain(ordered(rows))
    assert prefix_trie(turns.limit(0)).count() == 0
    only = spark.createDataFrame([(7,), (5,)], "conv_id bigint")
    assert [tuple(r)[:7] for r in prefix_trie(turns.limit(0), only).collect()] == [(5, 0, None, 2, 0, 1, 0)]


def test_trie_query(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is None or not 9000 <= r[0] < 9150]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(r) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect()} == plain(grafted(ordered(rows)))
