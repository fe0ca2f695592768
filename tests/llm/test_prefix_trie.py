"""op12 against a trie of dictionaries, and against its SQL."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from test_queries import assert_same

from fitgrid.llm import prefix_trie
from fitgrid.llm.queries import ORACLES, QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_hand(rows, group=100):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    if group:
        made = {}
        for c in own:
            h = zlib.crc32(str(c).encode()) % 6
            made[c] = own.get(c - c % group, [])[:h] + own[c][h:]
    else:
        made = own
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    sums = {}
    for n in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in kids[n]) or 1
        sums[n] = (leaves, (len(members[n]) - 1) * (len(n[-1][1]) if n else 0) + sum(sums[k][1] for k in kids[n]))
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), *sums[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()), key=repr)


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 230), 500, 512, 777]:
        rows += [(c, t, ["user", "assistant", None][int(rng.integers(0, 3))], ["", "a", "b", "é🙂", None][int(rng.integers(0, 5))]) for t in range(int(rng.integers(1, 9)))]
    rows += [(3, t, "user", f"long {t % 2}") for t in range(100, 140)] + [(4, t, "user", f"long {t % 2}") for t in range(100, 140)]
    rows += [(7, None, "user", "first of all"), (7, None, "user", "first of all"), (None, 1, "user", "no conversation"), (8, 1, "x", "tie"), (8, 1, "x", "tie 2"), (900, 0, "user", "z" * 50_000)]
    return rows


@pytest.mark.parametrize(("seed", "chunk", "group"), [(1, 1024, 100), (2, 4, 100), (3, 4, None)])
def test_against_dictionaries(spark, monkeypatch, seed, chunk, group):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = rows_of(seed)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, k1 string, depth int").repartition(5)
    assert found(prefix_trie.conversation_trie(df, group)) == by_hand(rows, group)


def test_many_copies_end_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "JOINED", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1090) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(prefix_trie.conversation_trie(df)) == by_hand(rows, None)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert found(prefix_trie.conversation_trie(df, 100)) == []


def test_query(spark, duck):
    df = QUERIES["op12_prefix_trie"](spark, DATA)
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(df) == by_hand(rows)
    assert_same(df, duck, ORACLES["op12_prefix_trie"])
