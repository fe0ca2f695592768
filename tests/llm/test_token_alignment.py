"""op11 against plain loops over tokens, and the rank file against the library it stands for."""

import collections
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from fitgrid.llm import token_alignment
from fitgrid.llm.queries import QUERIES

A, RANKS, B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def by_hand(texts):
    """Rows of the contract, by loops over bytes."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    tk = Tokenizer.from_file(P.path(A))
    tk.encode_special_tokens = True
    level = decoders.ByteLevel()
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path(B))
    found, pairs = [], collections.Counter()
    for t in texts:
        groups, links = [], []
        if t:
            whole = (" " + t).encode()
            ids_a, ids_b = tk.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            joined = b"".join(bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b)
            if joined == whole and level.decode([tk.id_to_token(i) for i in ids_a]) == " " + t:
                cover = list(whole)  # a token takes its bytes off the front
                ends = [{}, {}]
                shown = {b: c for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
                for k, b in enumerate(b for b in range(256) if b not in shown):
                    shown[b] = chr(256 + k)
                byte = {c: b for b, c in shown.items()}
                for side, ids in ((0, ids_a), (1, ids_b)):
                    at = 0
                    for i in ids:
                        piece = bytes(byte[c] for c in tk.id_to_token(i)) if side == 0 else (bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())
                        at += len(piece)
                        ends[side][at] = i
                    assert at == len(cover)
                links = [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
                left = [sorted(side.items(), reverse=True) for side in ends]
                for e in sorted(ends[0].keys() & ends[1].keys()):
                    own = [[], []]
                    for side, more in zip(own, left, strict=True):
                        while more and more[-1][0] <= e:
                            side.append(str(more.pop()[1]))
                    groups.append("|".join(map(",".join, own)))
                found.append([len(ids_a), len(ids_b), groups, links])
        if not groups:
            found.append([0, 0, [], []])
        pairs.update(links)
    top = collections.Counter()
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    return [(n_a, n_b, len(g), len(links), sum(pairs[p] == top[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, links in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("tasks", [40_000_000, 50])
def test_against_loops(spark, monkeypatch, tasks):
    monkeypatch.setattr(token_alignment, "TASK_LINKS", tasks)
    rng = np.random.default_rng(3)
    words = "the The running Überraschung naïve 東京 données 2024 12345 <|endoftext|> <s> </s> <0x0A> ▁ \t \n\n \x00 🙂 don't it's ... ( ) https://x.org/a?b=c".split(" ") + [" ", "  "]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 40)))) for _ in range(120)]
    texts += [None, "", " ", "a", "the cat the cat the cat", "the cat the cat the cat", "▁only", "é", "x" * 3000, " ".join(["one two three"] * 5000)]
    rows = [(i, t, i % 3, "clash") for i, t in enumerate(texts)] + [(None, "a null id", 0, "k"), (4, "the cat", 1, "again"), (4, "the cat", 1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, key string").repartition(5)
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in token_alignment.token_alignment(df).collect()), key=repr)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, by_hand([r[1] for r in rows]), strict=True)), key=repr)
    assert {r[-1] for r in got if r[0] in (120, 121)} == {""}


def test_the_rank_file_agrees():
    quick, slow = token_alignment.Pair(A, RANKS, B), token_alignment.Pair(A, None, B)
    rng = np.random.default_rng(7)
    plain = [chr(c) for c in [9, 10, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250)]]
    texts = ["".join(rng.choice(plain, int(rng.integers(0, 30)))) for _ in range(4000)]
    assert quick.encode(texts)[0] == slow.encode(texts)[0]
    assert [sum(len(slow.a_bytes[i]) for i in ids) for ids in slow.encode(texts)[0]] == [len((" " + t).encode()) for t in texts]


def test_empty_table(spark):
    assert token_alignment.token_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    df = QUERIES["op11_token_alignment"](spark, DATA)
    assert df.columns == ["doc_id", *COLUMNS]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert df.count() == docs.count()
    texts = [r["text"] for r in docs.select("text").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*(F.col(c) for c in COLUMNS)).collect())
    assert got == sorted(by_hand(texts))
