"""Postings are parsed once, their words brought to the normal form a sentence at a time, and searched only where they may hold something."""

import re

from pyspark.sql import functions as F

from fitgrid.functions import lines as L
from fitgrid.functions import requirements as Q
from fitgrid.functions.text import normal_words, normalize
from fitgrid.operators import requirements as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_parsed_once_and_dealt_before(spark):
    rows = [(1, "<p>" + "Work with Python every day. " * 10 + "</p>"), (2, "short"), (3, None)]
    df = R.section_lines(spark.createDataFrame(rows, "id int, description string"))
    plan = _plan(df)
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.rindex("Exchange hashpartitioning(id")  # the exchange is below the parser
    assert [(r["id"], r["at"]) for r in df.collect()] == [(1, 0)]


def test_words_leave_the_jvm_by_text(spark):
    texts = ["C++ and Node.js", "Größe ＳＱＬ ﬁne", "ΟΔΟΣ a/Ä ﷺ", "ﱞ x", "", "!?", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("w", L.tokens(F.col("text")))
    got = {r["id"]: r["n"] for r in df.select("id", normal_words(F.col("text"), F.col("w")).alias("n")).collect()}
    want = {r["id"]: r["n"] for r in df.select("id", F.posexplode("w")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", normalize(F.col("col")).alias("n")))).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert (got[i] or []) == [x["n"] for x in want.get(i, [])], t
    v = spark.createDataFrame([("sql", False), ("node.js", True)], "alias_norm string, weak boolean")
    hits = L.skill_hits(df.select("id", "text"), ["id"], v)
    plan = _plan(hits)
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") > plan.index("posexplode(")  # below the words' rows
    assert {(r["id"], r["place"], r["skill"], r["norm"]) for r in hits.collect()} == {(0, 3, "Node.js", "node.js"), (1, 2, "ＳＱＬ", "sql")}


def test_no_phrase_is_spared_that_could_hold():
    assert all(re.search(Q.OF_PREFERRED, Q._key(p)) for p in Q.PREFERRED)
    assert all(re.search(Q.OF_LEVELS, Q._key(p)) for phrases in Q.LEVELS.values() for p in phrases)


def test_what_may_hold_is_found(spark):
    rows = [("A huge PLUſ for you",), ("Ideally Kotlin",), ("Higher Education",), ("5 years, or 3 Jahre",), ("шість РОКІВ або 2 роки",), ("nothing",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(Q.is_preferred(F.col("t")), Q.education_in(F.col("t")), Q.years_in(F.col("t")), Q.preferred_from(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, None]
    assert [r[1] for r in got] == [None, None, "degree", None, None, None, None]
    assert [r[2] for r in got] == [[], [], [], [5, 3], [2], [], None]
    assert [r[3] for r in got] == [0, 0, None, None, None, None, None]
