"""Feeds in their documented shapes, normal forms, industries, and limits as batch and stream."""

import json

from pyspark.sql import functions as F

from fitgrid.functions import text as T
from fitgrid.sources import postings
from fitgrid.streaming import limits


def test_feed_pages(spark):
    items = [{"slug": "a", "url": "https://x/a", "title": "A", "remote": True, "created_at": 1700000000, "tags": ["t"], "job_types": ["full", "part"]}, {"slug": "b", "url": "https://x/b", "title": "B", "remote": False}, {"slug": "c", "url": "", "title": "C", "remote": True}, {"slug": "a", "url": "https://x/again", "title": "A2", "remote": True}]
    pages = spark.createDataFrame([(1, json.dumps({"data": items}))], "page int, body string")
    kept, counts = postings.parsed_run(pages, "arbeitnow")
    rows = kept.collect()
    assert [(r["source_id"], r["url"], r["employment_type"]) for r in rows] == [("a", "https://x/a", "full, part")]
    # the id that comes again is skipped, as the survey has it, and no longer counted as kept
    assert tuple(counts.collect()[0]) == (1, 1, 2, 4, None)


def test_runs_end_at_a_page_that_is_none(spark):
    good = json.dumps({"data": [{"slug": "a", "url": "https://x/a", "title": "A", "remote": True}]})
    unwanted = json.dumps({"data": [{"slug": "a", "url": "https://x/a", "title": "A", "remote": False}]})
    broken = json.dumps({"data": [{"slug": "a", "remote": True}]})

    def run(*bodies):
        kept, counts = postings.parsed_run(spark.createDataFrame(list(enumerate(bodies)), "page int, body string"), "arbeitnow")
        r = counts.collect()[0]
        assert kept.count() == r["kept"]
        return r["kept"], r["error"]

    assert run(good, "<html>", good.replace('"a"', '"b"')) == (1, None)
    assert run("<html>", good) == run('{"data": 3}') == run(broken) == (0, "invalid_response")
    assert run(unwanted) == run('{"data": []}') == (0, "no_postings")


def test_feed_without_ids(spark):
    pages = spark.createDataFrame([(1, json.dumps({"jobs": [{"link": "https://j/1", "title": "J", "updated": "2024-05-01T10:00:00.1234567"}]})), (2, "not json")], "page int, body string")
    row = postings.parsed_run(pages, "jooble")[0].collect()[0]
    assert len(row["source_id"]) == 20 and row["posted_at"].year == 2024 and row["description_is_excerpt"]


def test_normal_form_and_niches(spark):
    df = spark.createDataFrame([("  Spark SQL ", "Online casino", "text"), ("ﬁne  X", "shop", "bitcoin and blockchain"), ("a", "shop", "one bitcoin")], "s string, head string, body string")
    got = df.select(T.normalize(F.col("s")), T.niches(F.col("head"), F.col("body"))).collect()
    assert [tuple(r) for r in got] == [("spark sql", ["gambling"]), ("fine x", ["crypto"]), ("a", [])]


def test_batch_and_stream_agree(spark, tmp_path):
    hits = [(f"u{i % 3}", float(i // 2)) for i in range(90)]
    rules = ((10, 2), (40, 5))
    for part in range(3):
        spark.createDataFrame(hits[part * 30 : part * 30 + 30], "subject string, ts double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("subject string, ts double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = limits.limited_stream(stream, rules, expire=False).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = []
    for who in ("u0", "u1", "u2"):
        ts = [t for w, t in hits if w == who]
        allowed = []  # a plain loop over what was allowed before
        for t in ts:
            counts = [sum(int(a // s) == int(t // s) for a in allowed) for s, _ in rules]
            first = [s for n, (s, most) in zip(counts, rules, strict=True) if n >= most][:1]
            if not first:
                allowed.append(t)
            want.append((who, t, not first, int(-(-((t // first[0] + 1) * first[0] - t) // 1)) if first else None))
    batch = limits.limited_batch(spark.createDataFrame(hits, "subject string, ts double"), rules)
    key = lambda r: (r[0], r[1], str(r[2:]))
    assert sorted(map(tuple, batch.collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, spark.table("verdicts").collect()), key=key) == sorted(want, key=key)


def test_counters_keep_a_hundred_keys(spark, tmp_path):
    from datetime import datetime, timedelta

    from fitgrid.plans.records import event_counters

    day = datetime(2024, 1, 1)
    rows = [(i, day + timedelta(seconds=i), '{"k": "key%d"}' % (i % 103)) for i in range(206)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["key"]: r["n"] for r in event_counters(spark, str(tmp_path)).collect()}
    assert got == {f"key{i}": 2 for i in range(100)} | {"other": 6}
