"""Evaluation, text and vector queries over documents, labels, events and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators.matching import best_of_labels
from .ranking import _t


def _labelled(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "n_chars", "quality", "toxic")


def ndcg_by_language(spark, sf_dir):
    df = E.ndcg(_labelled(spark, sf_dir), "lang", [F.desc("n_chars"), F.asc("doc_id")], "quality")
    return df.select("lang", F.round("ndcg", 6).alias("ndcg"))


def spearman_by_status(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))
    return E.spearman(o, "o_orderstatus", "p", "o_totalprice").select("o_orderstatus", F.round("spearman", 6).alias("spearman"), "n")


def kendall_by_nation(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    return E.kendall(s, "s_nationkey", "s_suppkey", "s_suppkey", "s_acctbal").select("s_nationkey", F.round("tau", 6).alias("tau"))


def auc_by_language(spark, sf_dir):
    return E.auc(_labelled(spark, sf_dir), "lang", "n_chars", "quality").select("lang", F.round("auc", 6).alias("auc"), "positive", "negative")


def precision_by_language(spark, sf_dir):
    return E.precision_recall(_labelled(spark, sf_dir), "lang", F.col("n_chars") > 1000, F.col("quality") == 1)


def macro_f1(spark, sf_dir):
    df = _labelled(spark, sf_dir).withColumn("guess", (F.col("n_chars") > 1000).cast("int"))
    both = df.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("label"), "guess", "quality")
    per = E.precision_recall(both, "label", F.col("guess") == F.col("label"), F.col("quality") == F.col("label"))
    return per.agg(F.round(F.avg(F.coalesce("f1", F.lit(0.0))), 4).alias("macro_f1"))


def confusion(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def threshold_search(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return E.threshold(e, "value", F.col("event_type") != "error", 0.8, 50)


def value_percentiles(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return e.groupBy("event_type").agg(p.alias("p")).select("event_type", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


def value_histogram(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.groupBy((F.floor(F.col("value") / 5) * 5).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def nearest_concepts(spark, sf_dir):
    """For every vector whose id is divisible by 20, the five nearest concepts (labels) by their best vector, its own left out."""
    v = _t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("expected"), F.col("v").alias("q"))
    best = best_of_labels(v, q)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("s", 9)), "label")
    return best.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("query", "place", "label", F.round("s", 6).alias("similarity"))


def language_share(spark, sf_dir):
    """uk, en, mixed or unknown by the share of Cyrillic among Cyrillic and Latin letters."""
    d = _t(spark, sf_dir, "documents")
    c, n = F.regexp_count("text", F.lit("[Ѐ-ӿ]")), F.regexp_count("text", F.lit("[A-Za-z]"))
    share = F.try_divide(c.cast("double"), c + n)
    name = F.when(share.isNull(), "unknown").when(share >= 0.7, "uk").when(share <= 0.1, "en").otherwise("mixed")
    return d.select("doc_id", name.alias("language"), n.alias("latin"))


def contact_counts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    mail, web = F.regexp_count("text", F.lit(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+")), F.regexp_count("text", F.lit(r"(https?://|www\.)[^ \t\n\r]+"))
    return d.select("doc_id", mail.alias("emails"), web.alias("urls"))


def benchmark_tfidf(spark, sf_dir):
    """Smoothed TF-IDF cosine of the benchmark items that share a word: ln((1+N)/(1+df))+1, L2."""
    b = _t(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("w")).filter("w <> ''")
    tf = b.groupBy("item_id", "w").agg(F.count("*").alias("tf"))
    n = tf.agg(F.count_distinct("item_id").alias("N"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    t = tf.join(df, "w").crossJoin(F.broadcast(n)).withColumn("x", F.col("tf") * (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1))
    t = t.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("item_id")))).select("item_id", "w", "x")
    o = t.select(F.col("item_id").alias("other"), "w", F.col("x").alias("y"))
    return t.join(o, "w").filter("item_id < other").groupBy("item_id", "other").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("cosine"))


def years_asked(spark, sf_dir):
    """Years of experience as texts: about n years, in halves."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7) % 120).cast("int").alias("months"))
    half = F.floor(F.col("months") / 6 + 0.5) / 2
    whole = F.floor(half).cast("int").cast("string")
    number = F.when(half == F.floor(half), whole).when(half < 1, F.lit("½")).otherwise(F.concat(whole, F.lit("½")))
    text = F.when(F.col("months") < 6, "less than a year").when(half == 0.5, "about half a year").otherwise(F.concat(F.lit("about "), number, F.when(half == 1, " year").otherwise(" years")))
    return o.select("o_orderkey", text.alias("years_text"))


QUERIES = {f.__name__: f for f in (ndcg_by_language, spearman_by_status, kendall_by_nation, auc_by_language, precision_by_language, macro_f1, confusion, threshold_search, value_percentiles, value_histogram, nearest_concepts, language_share, contact_counts, benchmark_tfidf, years_asked)}

_LAB = "WITH d AS (SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"
ORACLES = {
    "ndcg_by_language": _LAB + """, r AS (SELECT lang, pow(2, quality) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, n_chars DESC, doc_id) AS b FROM d)
SELECT lang, round(coalesce(sum(g / log2(a + 1)) FILTER (a <= 10), 0) / nullif(coalesce(sum(g / log2(b + 1)) FILTER (b <= 10), 0), 0), 6) AS ndcg FROM r GROUP BY lang""",
    "spearman_by_status": """WITH o AS (SELECT o_orderstatus, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p, o_totalprice AS t FROM orders),
r AS (SELECT o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY p) + (count(*) OVER (PARTITION BY o_orderstatus, p) - 1) / 2.0 AS x, rank() OVER (PARTITION BY o_orderstatus ORDER BY t) + (count(*) OVER (PARTITION BY o_orderstatus, t) - 1) / 2.0 AS y FROM o)
SELECT o_orderstatus, round(corr(x, y), 6) AS spearman, count(*) AS n FROM r GROUP BY 1""",
    "kendall_by_nation": """WITH p AS (SELECT a.s_nationkey, sign(a.s_suppkey - b.s_suppkey) AS dx, sign(a.s_acctbal - b.s_acctbal) AS dy FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT s_nationkey, round(sum(dx * dy) / nullif(sqrt(sum(abs(dx)) * sum(abs(dy))), 0), 6) AS tau FROM p GROUP BY 1""",
    "auc_by_language": _LAB + """, r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM d),
c AS (SELECT lang, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n, coalesce(sum(r) FILTER (quality = 1), 0) AS s FROM r GROUP BY lang)
SELECT lang, round((s - p * (p + 1) / 2.0) / nullif(p * n, 0), 6) AS auc, p AS positive, n AS negative FROM c""",
    "precision_by_language": _LAB + """, c AS (SELECT lang, count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1000 AND quality <> 1) AS fp, count(*) FILTER (n_chars <= 1000 AND quality = 1) AS fn FROM d GROUP BY lang)
SELECT lang, tp, fp, fn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 4) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 4) AS recall, round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 4) AS f1 FROM c""",
    "macro_f1": _LAB + """, c AS (SELECT label, count(*) FILTER (CAST(n_chars > 1000 AS INT) = label AND quality = label) AS tp, count(*) FILTER (CAST(n_chars > 1000 AS INT) = label AND quality <> label) AS fp, count(*) FILTER (CAST(n_chars > 1000 AS INT) <> label AND quality = label) AS fn FROM d, (VALUES (0), (1)) v(label) GROUP BY label)
SELECT round(avg(coalesce(round(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 4), 0)), 4) AS macro_f1 FROM c""",
    "confusion": _LAB + " SELECT quality, toxic, count(*) AS n FROM d GROUP BY 1, 2",
    "threshold_search": """WITH p AS (SELECT value AS d, count(*) AS n, count(*) FILTER (event_type <> 'error') AS g FROM events GROUP BY 1),
r AS (SELECT d, sum(n) OVER (ORDER BY d) AS n, sum(g) OVER (ORDER BY d) AS g FROM p)
SELECT max(d) FILTER (n >= 50 AND CAST(g AS DOUBLE) / n >= 0.8::DOUBLE) AS threshold, count(*) FILTER (n >= 50 AND CAST(g AS DOUBLE) / n >= 0.8::DOUBLE) AS n_ok FROM r""",
    "value_percentiles": "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
    "value_histogram": "SELECT CAST(floor(value / 5) * 5 AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1",
    "nearest_concepts": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
b AS (SELECT q.vec_id AS query, v.label, max(list_dot_product(q.v, v.v)) AS s FROM v JOIN v q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, label) AS place FROM b)
SELECT query, place, label, round(s, 6) AS similarity FROM r WHERE place <= 5""",
    "language_share": """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[Ѐ-ӿ]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS n FROM documents)
SELECT doc_id, CASE WHEN c + n = 0 THEN 'unknown' WHEN c / (c + n) >= 0.7 THEN 'uk' WHEN c / (c + n) <= 0.1 THEN 'en' ELSE 'mixed' END AS language, n AS latin FROM c""",
    "contact_counts": r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+')) AS emails, len(regexp_extract_all(text, '(https?://|www\.)[^ \t\n\r]+')) AS urls FROM documents",
    "benchmark_tfidf": """WITH b AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark), tf AS (SELECT item_id, w, count(*) AS tf FROM b WHERE w <> '' GROUP BY 1, 2),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT item_id) AS n FROM tf),
x AS (SELECT item_id, w, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (w), n), z AS (SELECT item_id, sqrt(sum(x * x)) AS z FROM x GROUP BY 1), y AS (SELECT item_id, w, x / z AS x FROM x JOIN z USING (item_id))
SELECT a.item_id, b.item_id AS other, round(sum(a.x * b.x), 6) AS cosine FROM y a JOIN y b ON a.w = b.w AND a.item_id < b.item_id GROUP BY 1, 2""",
    "years_asked": """WITH o AS (SELECT o_orderkey, (o_orderkey * 7) % 120 AS m FROM orders), h AS (SELECT *, floor(m / 6 + 0.5::DOUBLE) / 2 AS y FROM o)
SELECT o_orderkey, CASE WHEN m < 6 THEN 'less than a year' WHEN y = 0.5 THEN 'about half a year' ELSE 'about ' || CASE WHEN y = floor(y) THEN CAST(CAST(floor(y) AS INT) AS VARCHAR) ELSE CAST(CAST(floor(y) AS INT) AS VARCHAR) || '½' END || CASE WHEN y = 1 THEN ' year' ELSE ' years' END END AS years_text FROM h""",
}
