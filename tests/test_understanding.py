"""Places, postings' lines, contacts, wording, alert tracking and intervals on small inputs."""

from pyspark.sql import functions as F

from fitgrid.functions import places as P
from fitgrid.functions import requirements as Q
from fitgrid.functions import wording as V
from fitgrid.operators import alerts as A


def one(spark, text, f, kind="string"):
    return spark.createDataFrame([(t,) for t in text], f"x {kind}").select(f(F.col("x")).alias("y")).collect()


def test_places(spark):
    known = P.Gazetteer(cities={"Köln": "DE", "Paris": "FR"})
    got = one(spark, ["Koln", "KÖLN, Germany", "Paris / Köln", "Georgia", "Austin, TX", "CA", "ON", None, "", "Österreich"], lambda c: P.resolve_country(c, known))
    assert [r["y"] for r in got] == ["DE", "DE", None, None, "US", None, "CA", None, None, "AT"]
    got = one(spark, ["Remote - EU only", "USA, Canada", "Worldwide", "EU, Atlantis", None, "remote"], P.allowed_countries)
    assert [r["y"] and len(r["y"]) for r in got] == [27, 2, None, None, None, None]


def test_sentences(spark):
    got = one(spark, ["Use tools, e.g. Jira. Be kind! ok", "", None], Q.sentences)
    assert [r["y"] for r in got] == [["Use tools, e.g. Jira.", "Be kind!", "ok"], [], None]


def test_lines_get_their_section(spark):
    lines = [(1, 0, "Intro", False, False), (1, 1, "Responsibilities", False, False), (1, 2, "Build things", False, False), (1, 3, "Nice to have", True, False), (1, 4, "Go", False, False), (1, 5, "Zebra", False, True), (1, 6, "End", None, None)]
    got = Q.sectioned(spark.createDataFrame(lines, "doc int, at int, text string, heading boolean, title boolean"), "doc", "at").orderBy("at").collect()
    assert [(r["text"], r["section"]) for r in got] == [("Intro", "general"), ("Build things", "responsibilities"), ("Go", "nice_to_have"), ("Zebra", "general"), ("End", "general")]


def test_responsibilities_and_tags(spark):
    rows = [([("Plain", False, "responsibilities"), ("We're looking for you", True, "responsibilities"), ("word " * 60, True, "responsibilities"), ("Other", True, "other")],)]
    got = one(spark, [rows[0][0]], Q.responsibilities, "array<struct<text:string,bullet:boolean,section:string>>")[0]["y"]
    assert len(got) == 1 and got[0].endswith("word…") and len(got[0]) <= 201
    assert one(spark, [[" SQL", "sql", "", "x" * 61, "Go"]], Q.tags_kept, "array<string>")[0]["y"] == ["SQL", "Go"]


def test_contacts(spark):
    text = "Mail a.b@c.org, call +49 (151) 234-56789, see www.x.org/a; 01.2019 - 03.2021, é"
    masked, n = V.masked_text(text)
    assert n == 3 and len(masked) == len(text) and "01.2019 - 03.2021, é" in masked and "@" not in masked
    got = one(spark, [text, "plain", "", None], V.mask_contacts)
    assert [tuple(r["y"]) for r in got] == [(masked, 3), ("plain", 0), ("", 0), (None, None)]


def test_wording(spark):
    got = one(spark, [None, 3, 12, 51], V.years_tile, "int")
    assert [r["y"] for r in got] == ["—", "<1 yr", "1 yr", "4½ yrs"]
    got = one(spark, [[], ["a"], ["a", "b"], ["a", "b", "c"]], V.join_natural, "array<string>")
    assert [r["y"] for r in got] == ["", "a", "a and b", "a, b and c"]
    got = one(spark, [0], lambda c: V.required_sentence(c, F.lit(3), F.lit(1), F.lit(1)), "int")
    assert got[0]["y"] == "You have none of the 3 required skills, but the one nice-to-have one."


def test_alerts_batch_and_stream(spark, tmp_path):
    told = [("warning", "-"), ("warning", "new"), ("critical", "new"), ("critical", "-"), (None, "-"), (None, "resolved"), ("warning", "-"), (None, "-"), ("warning", "-")]
    rows = [("db", i * 60.0, s, True) for i, (s, _) in enumerate(told)] + [("api", 0.0, "warning", False), ("api", 60.0, "warning", False), ("api", 120.0, "warning", True), ("api", 30000.0, "warning", True)]
    schema = "code string, now double, severity string, delivered boolean"
    want = sorted([("db", i * 60.0, t) for i, (_, t) in enumerate(told) if t != "-"] + [("api", 60.0, "new"), ("api", 120.0, "new"), ("api", 30000.0, "still")])
    assert sorted(tuple(r)[:3] for r in A.tracked(spark.createDataFrame(rows, schema)).collect()) == want
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = A.tracked_stream(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r)[:3] for r in spark.table("told").collect()) == want


def test_interval_holds_the_mean(spark):
    df = spark.range(400).select(F.lit("g").alias("g"), "id", (F.col("id") % 10).cast("double").alias("v"))
    low, high = A.bootstrap_mean(df, "g", "id", "v", samples=300).select("low", "high").collect()[0]
    assert low < 4.5 < high and 0.4 < high - low < 0.8
    p = A.sign_test(spark.createDataFrame([("a", 1.0)] * 5 + [("a", -1.0), ("a", 0.0), ("b", 0.0)], "g string, d double"), "g", "d").orderBy("g").collect()
    assert abs(p[0]["p"] - 14 / 64) < 1e-9 and p[1]["p"] is None


def test_intervals_run_with_the_default_samples(spark, monkeypatch):
    from fitgrid.plans import understanding

    seen = []
    monkeypatch.setattr(understanding.A, "bootstrap_mean", lambda *a, **how: seen.append(how))
    understanding.balance_intervals(spark, "/root/testdata/sf0.001")
    assert seen == [{}]
