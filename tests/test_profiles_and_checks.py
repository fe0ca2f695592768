"""Operators of profiles, lines, checks and comparison against plain loops and cases worked out by hand."""

import hashlib
import hmac
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgrid.functions import lines as L
from fitgrid.functions import text as T
from fitgrid.operators import checks as K
from fitgrid.operators import comparison as C
from fitgrid.operators import profiles as P
from fitgrid.operators import semantic as M
from fitgrid.operators import taxonomy as X
from fitgrid.sources import postings


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_text_is_cleaned():
    assert L.clean_text("develop-\nment ﬁne") == "development fine"
    assert L.clean_text("Front-\nEnd\n\n a \t b") == "Front-\nEnd\na b"
    assert L.clean_text("soft­hyphen and so­\nft") == "softhyphen and soft"


def test_lines_of_html():
    html = "<h2>What you do</h2><p><b>Your tasks</b></p><ul><li>- Write <b>SQL</b><li>Ship &amp; fix</ul><script>x()</script><p>Plain text<br>goes on</p><div><strong>All bold but far too long to be a heading of anything at all, really</strong></div>"
    got = L.posting_lines(html)
    assert got == [("What you do", True, False, False), ("Your tasks", True, False, False), ("Write SQL", False, True, False), ("Ship & fix", False, True, False), ("Plain text", False, False, False), ("goes on", False, False, False), ("All bold but far too long to be a heading of anything at all, really", False, False, False)]
    assert L.posting_lines(None) == [] and L.posting_lines(" \n ") == []


def test_lines_of_text():
    got = L.posting_lines("Requirements:\n* five years\n2) more\n\nSenior Data Engineer\nAnd a sentence, here.\n" + "x" * 100 + ":")
    assert [g[1:] for g in got] == [(True, False, False), (False, True, False), (False, True, False), (False, False, True), (False, False, False), (False, False, False)]
    assert got[1][0] == "five years"


def test_skills_take_the_longest_run_from_the_left(spark):
    rng = np.random.default_rng(0)
    vocabulary = {"a b", "b c d", "c", "d a", "b", "a b c d e"}
    rows = [(i, " ".join(rng.choice(list("abcde"), 12))) for i in range(40)] + [(90, "Node.js, C++ and .NET. b."), (91, "")]
    vocabulary |= {"node.js", "c++", ".net"}
    v = spark.createDataFrame([(w, False) for w in vocabulary], "alias_norm string, weak boolean")
    got = {(r["id"], r["place"], r["norm"]) for r in L.skill_hits(spark.createDataFrame(rows, "id int, text string"), ["id"], v).collect()}
    want = set()
    for i, text in rows:
        w = [t.rstrip(".,") if t not in (".", ",") else t for t in text.lower().split()]
        at = 0
        while at < len(w):
            k = next((k for k in range(5, 0, -1) if at + k <= len(w) and " ".join(w[at : at + k]) in vocabulary), 0)
            if k:
                want.add((i, at + 1, " ".join(w[at : at + k])))
            at += max(k, 1)
    assert got == want


def test_subjects_are_keyed_hashes(spark):
    key = b"k" * 70

    def want(text):
        return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()

    rows = [("1.2.3.4", "1.2.3.4"), (" 10.0.0.1 ", "10.0.0.1"), ("2001:db8::1", "2001:db8::"), ("2001:db8:0:0:5::9", "2001:db8::"), ("::ffff:1.2.3.4", "1.2.3.4"), ("999.1.1.1", None), (None, None), ("x", None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "a string").select("a", K.subject(F.col("a"), key).alias("h")).collect()
    assert {r["a"]: r["h"] for r in got} == {a: w and want(w) for a, w in rows}


def test_calibration_is_read_or_not():
    good = {"floor": 0.7, "ceil": 0.9, "embedding_version": "m"}
    assert M.read_calibration(json.dumps(good), "m") == (0.7, 0.9)
    for bad in ({"floor": 0.9, "ceil": 0.7}, {"floor": True}, {"ceil": None}, {"embedding_version": "n"}, {"floor": math.inf}):
        assert M.read_calibration(json.dumps(good | bad), "m") is None
    assert M.read_calibration("{", "m") is None and M.read_calibration("[]", "m") is None


def test_learned_weight_finds_the_truth(spark):
    rng = np.random.default_rng(1)
    skill, semantic = rng.random(800), rng.random(800)
    y = rng.random(800) < 1 / (1 + np.exp(-14 * (0.8 * skill + 0.2 * semantic - 0.5)))
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(skill, semantic, y, strict=True)]
    got = C.skill_weight(spark.createDataFrame(rows, "skill double, semantic double, label int"), strength=0.0).first()
    assert 0.7 <= got["w"] <= 0.9 and got["slope"] > 5
    flipped = [(a, b, 1 - c) for a, b, c in rows]
    assert C.skill_weight(spark.createDataFrame(flipped, "skill double, semantic double, label int")).first()["w"] == C.PRIOR_SKILL
    assert C.skill_weight(spark.createDataFrame(rows[:20], "skill double, semantic double, label int")).count() == 0


def test_decisions():
    assert C.decision(0.01, ["b", "a", "a"])["recommendation"] == "change to a"
    assert C.decision(None, ["b"])["recommendation"] == C.decision(-0.1, ["b"])["recommendation"] == "keep current"


def test_months(spark):
    rows = [(1, "2020", "2020"), (1, "2021-01", "2021-03"), (2, None, "2020"), (2, "2020-05", None), (3, "2020-05", "2020-04"), (4, "2019-11", "present")]
    today = F.lit("2020-02-10").cast("date")
    got = {r["by"]: tuple(r)[1:] for r in P.months_worked(spark.createDataFrame(rows, "by int, start string, end string"), "by", today).collect()}
    assert got == {1: (0, 0, 0, 15), 2: (1, 1, 0, None), 3: (0, 0, 1, None), 4: (0, 0, 0, 4)}


def test_latest_title(spark):
    rows = [(1, 0, "a", "2010", "2019"), (1, 1, "b", "2009", "present"), (2, 0, "a", "2010", "2012"), (2, 1, "b", "2011", "2012"), (3, 0, " ", "2010", "present"), (3, 1, "b", None, None), (3, 2, "c", "2001", None)]
    got = P.latest_title(spark.createDataFrame(rows, "by int, pos int, title string, start string, end string"), "by")
    assert {r["by"]: r["title"] for r in got.collect()} == {1: "b", 2: "a", 3: "c"}


def test_stripped_forms(spark):
    rows = [("go1", "Go (programming)", "en", "preferred"), ("go2", "Go (board game)", "en", "preferred"), ("py", "Python (computer programming)", "en", "preferred"), ("ml", "ML (x)", "en", "alt"), ("ml", "ml", "en", "alt"), ("r", "R (y)", "en", "custom")]
    found = X.aliases(spark.createDataFrame(rows, "canonical_id string, label string, lang string, kind string"))
    new, contested = X.stripped(found)
    assert [(r["canonical_id"], r["alias"], r["kind"]) for r in new.collect()] == [("py", "Python", "stripped")]
    assert [(r["alias_norm"], r["canonical_ids"]) for r in contested.collect()] == [("go", ["go1", "go2"])]


@pytest.mark.parametrize("word", ["betting site", "betting apps", "betting companies", "betting company", "betting platform", "betting operators", "betting markets", "online betting", "slot machines"])
def test_every_alternative_of_a_niche(spark, word):
    assert one(spark, T.niches(F.lit(f"a {word} here"), F.lit(""))) == ["gambling"]


def test_times_without_a_zone_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for text in ("2024-05-01T10:00:00", "2024-05-01 10:00:00", "2024-05-01T10:00:00Z", "2024-05-01T12:00:00+02:00", "2024-05-01T12:00:00+0200", "2024-05-01T10:00:00.1234567"):
            assert one(spark, F.unix_timestamp(postings.parse_time(F.lit(text)))) == 1714557600, text
        assert one(spark, F.unix_timestamp(postings.parse_time(F.lit("2024-05-01")))) == 1714521600
        assert one(spark, F.unix_timestamp(postings.parse_time(F.lit("1714557600")))) == 1714557600
        assert one(spark, postings.parse_time(F.lit("soon"))) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_semantic_gates_in_order(spark):
    rows = [([[1.0, 0.0], [0.6, 0.8]], [0.6, 0.8], True, True), (None, [0.6, 0.8], False, False), ([[1.0]], None, False, False), ([[1.0]], [1.0], False, False), ([[1.0]], [1.0], True, False), ([[1.0]], [1.0, 0.0], True, True)]
    df = spark.createDataFrame(rows, "vectors array<array<double>>, embedding array<double>, same_model boolean, same_text boolean")
    got = M.scored(df, "top2_mean", 0.0, 1.0).collect()
    assert (got[0]["raw"], got[0]["best"], got[0]["semantic_warning"]) == (pytest.approx(0.8), 1, None)
    assert [r["semantic_warning"] for r in got[1:]] == list(M.PROBLEMS) and all(r["semantic"] is None for r in got[1:])
