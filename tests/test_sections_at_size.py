"""Keys of headings are worked out once a text, and only of texts that may be headings."""

import random
import re

from pyspark.sql import functions as F

from fitgrid.functions import headings as H
from fitgrid.functions.blocks import heading_key
from fitgrid.operators import sections as S


def test_a_key_is_worked_out_once(spark):
    plan = spark.createDataFrame([("Skills",)], "t string").select(H.may_be_heading(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("regexp_extract(") == 1


def test_shapes_as_before(spark):
    rng, words = random.Random(7), ["Skills", "SQL", " ", "  ", "\n", " ", "\t", ",", ".", "•", "–", "s k i l l s", "досвід", "x" * 38, "y" * 20, "😀", "1.", "IV)", ":", "'", "\r", ""]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(1500)] + ["a" * 40, "a" * 41, " " + "😀" * 40 + "\n", "a\n", None]
    t = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    shape = (t != "") & ~t.contains("\n") & (F.char_length(t) <= H.CHARS) & ~t.rlike(r"[.,]$") & ~F.substring(t, 1, 1).isin(*H.BULLETS)
    key = heading_key(t)
    may = F.coalesce(shape & (key != "") & (F.size(F.split(key, " ")) <= H.WORDS), F.lit(False))
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    rows = df.select("t", H.heading_of(F.col("t")).alias("got"), F.when(may, key).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows) and 100 < sum(r["got"] is not None for r in rows) < len(rows)


def test_capitals_and_kinds(spark):
    texts = ["AB", "A1B", "A", "Ab", "ДОСВІД 2", "ß ß", "1 2", "", "ÀÉ!", "中文", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")

    def caps(t):
        letters = [c for c in t if c.isalpha()]
        return len(letters) >= 2 and all(re.match(r"[A-ZÀ-ÞА-ЯІ]", c) for c in letters)

    assert [r[0] for r in df.select(S.all_caps(F.col("t"))).collect()] == [None if t is None else caps(t) for t in texts]
    keys = ["skills", "skils", "nothing here", "", None, "education & volunteering", "skills"]
    got = spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).select(H.key_kinds(F.col("k")).alias("x")).select("x.types", "x.source").collect()
    want = [k and H.kinds_of(k) for k in keys]
    assert [tuple(r) for r in got] == [w or (None, None) for w in want]
