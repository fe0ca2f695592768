"""Profile queries: candidates are customers, their jobs orders, the skills of a job its lines' parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import profiles as P
from .ranking import _t

TODAY = "2001-03-15"


def _jobs(spark, sf_dir):
    """Urgent jobs know only years, pending ones no start; open ones are held still or, where the total is high, without an end."""
    o = _t(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    start = F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_orderpriority") == "1-URGENT", F.substring(month, 1, 4)).otherwise(month)
    after = F.date_format(F.add_months("o_orderdate", (F.col("o_orderkey") % 40 - 2).cast("int")), "yyyy-MM")
    end = F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 250000), F.lit(None)).when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 7 == 0), "present").when(F.col("o_orderpriority") == "2-HIGH", F.substring(after, 1, 4)).otherwise(after)
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    title = F.when(F.col("o_orderkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Keeper of "), F.col("o_orderkey"), F.lit(" ")))
    return o.select(F.col("o_custkey").alias("candidate_id"), pos.alias("pos"), title.alias("title"), F.col("o_orderpriority").alias("company"), F.when(F.col("o_orderkey") % 3 == 0, F.repeat(F.col("o_orderpriority"), F.lit(150))).alias("description"), F.when(F.col("o_orderkey") % 2 == 0, "as quoted").alias("quote"), start.alias("start"), end.alias("end"), "o_orderkey")


def months_worked(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    n = jobs.groupBy("candidate_id").agg(F.count("*").alias("jobs"))
    df = P.months_worked(jobs, "candidate_id", F.lit(TODAY).cast("date")).join(n, "candidate_id")
    return df.select("candidate_id", "months", "no_start", "no_end", "reversed", P.months_for_fit(F.col("months"), F.col("jobs"), F.col("no_start") + F.col("no_end") + F.col("reversed")).alias("months_for_fit"))


def latest_titles(spark, sf_dir):
    return P.latest_title(_jobs(spark, sf_dir), "candidate_id")


def _used(spark, sf_dir):
    ln, p = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    return ln.join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type"), "l_partkey").join(_jobs(spark, sf_dir).select("candidate_id", F.col("pos").alias("job"), F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


def merged_skills(spark, sf_dir):
    """Lines of a customer's orders as mentions of their part's type."""
    u = _used(spark, sf_dir)
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    m = u.select("candidate_id", (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("pos"), name.alias("name"), F.when(F.col("l_returnflag") == "R", "hard").otherwise("soft").alias("kind"), F.col("l_returnflag").alias("found_in"), F.col("p_type").alias("quote"))
    df = P.merged_skills(m, "candidate_id")
    return df.select("candidate_id", "norm", "name", "kind", F.array_join("found_in", ",").alias("found_in"), F.array_join("quotes", ",").alias("quotes"))


def candidate_texts(spark, sf_dir):
    """Jobs of customers; those of every seventh customer say nothing, so their skills are used."""
    silent = F.col("candidate_id") % 7 == 0
    jobs = _jobs(spark, sf_dir).withColumns({c: F.when(~silent, F.col(c)) for c in ("title", "company", "description", "quote")})
    skills = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), F.explode(F.array(F.struct(F.lit(1).alias("pos"), F.col("c_name").alias("name")), F.struct(F.lit(0).alias("pos"), F.concat(F.lit(" "), "c_mktsegment").alias("name")))).alias("s")).select("candidate_id", "s.*")
    return P.candidate_texts(jobs, skills, "candidate_id")


def vacancy_texts(spark, sf_dir):
    """Orders with their parts' names as responsibilities."""
    ln, p = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    named = ln.join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))), lambda x: x["p_name"]).alias("r"))
    o = _t(spark, sf_dir, "orders").join(named.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    return o.select(F.col("o_orderkey").alias("vacancy_id"), P.vacancy_text(F.concat(F.lit(" "), "o_orderpriority"), F.col("r")).alias("text"))


def skill_places(spark, sf_dir):
    own = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), F.lit(0).alias("pos"), F.col("c_mktsegment").alias("name"))
    at = F.row_number().over(Window.partitionBy("candidate_id", "job").orderBy("l_linenumber", "l_partkey")) - 1
    used = _used(spark, sf_dir).withColumn("pos", at).select("candidate_id", "job", "pos", F.col("p_name").alias("name"))
    return P.skill_paths(own, used, "candidate_id").groupBy("path", "raw").agg(F.count("*").alias("n"))


def _tags(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" "))).alias("tag"), F.col("p_partkey").alias("pos"))


def tag_coverage(spark, sf_dir):
    known = _t(spark, sf_dir, "part").filter("p_size > 45").select(F.lower("p_name").alias("alias_norm"))
    df = P.coverage(P.top_tags(_tags(spark, sf_dir), known, 20))
    return df.select(F.round("coverage", 6).alias("coverage"), F.round("weighted", 6).alias("weighted"))


QUERIES = {f.__name__: f for f in (months_worked, latest_titles, merged_skills, candidate_texts, vacancy_texts, skill_places, tag_coverage)}

_J = f"""WITH j AS (SELECT o_custkey AS candidate_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CASE WHEN o_orderkey % 5 > 0 THEN 'Keeper of ' || o_orderkey ELSE '' END AS title, o_orderpriority AS company,
  CASE WHEN o_orderkey % 3 = 0 THEN repeat(o_orderpriority, 150) END AS description, CASE WHEN o_orderkey % 2 = 0 THEN 'as quoted' END AS quote, o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m') END AS s,
  CASE WHEN o_orderstatus = 'O' AND o_totalprice > 250000 THEN NULL WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN 'present'
    WHEN o_orderpriority = '2-HIGH' THEN strftime(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 40 - 2 AS INTEGER)), '%Y') ELSE strftime(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 40 - 2 AS INTEGER)), '%Y-%m') END AS e FROM orders),
m AS (SELECT *, CAST(s[1:4] AS INT) * 12 + CASE WHEN len(s) = 4 THEN 0 ELSE CAST(s[6:7] AS INT) - 1 END AS a,
  CASE WHEN e = 'present' THEN 2001 * 12 + 2 ELSE TRY_CAST(e[1:4] AS INT) * 12 + CASE WHEN len(e) = 4 THEN 11 ELSE TRY_CAST(e[6:7] AS INT) - 1 END END AS b FROM j)
"""
_U = _J + ", u AS (SELECT j.candidate_id, j.pos AS job, l.*, p_name, p_type FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN j ON j.o_orderkey = l_orderkey)"
ORACLES = {
    "months_worked": _J + """, c AS (SELECT candidate_id, count(*) FILTER (a IS NULL) AS no_start, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS no_end, count(*) FILTER (b < a) AS reversed FROM m GROUP BY 1),
x AS (SELECT candidate_id, count(DISTINCT k) AS months FROM (SELECT candidate_id, unnest(range(a, b + 1)) AS k FROM m WHERE b >= a) GROUP BY 1)
SELECT c.candidate_id, months, no_start, no_end, reversed, CASE WHEN no_start + no_end + reversed = 0 THEN months END AS months_for_fit FROM c LEFT JOIN x USING (candidate_id)""",
    "latest_titles": _J + """, r AS (SELECT *, CASE WHEN e = 'present' THEN 3 WHEN e IS NOT NULL THEN 2 WHEN s IS NOT NULL THEN 1 ELSE 0 END AS k FROM j WHERE title <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY k DESC, CASE k WHEN 3 THEN coalesce(s, '') WHEN 2 THEN e WHEN 1 THEN s ELSE '' END DESC, pos) AS n FROM r) SELECT candidate_id, title FROM n WHERE n = 1""",
    "merged_skills": _U + """, t AS (SELECT candidate_id, lower(p_name) AS norm, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS pos, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, l_returnflag AS f, p_type AS q FROM u),
n AS (SELECT candidate_id, norm, arg_min(name, pos) AS name, CASE WHEN bool_or(f = 'R') THEN 'hard' ELSE 'soft' END AS kind FROM t GROUP BY 1, 2),
f AS (SELECT candidate_id, norm, string_agg(f, ',' ORDER BY p, f) AS found_in FROM (SELECT candidate_id, norm, f, min(pos) AS p FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2),
q AS (SELECT candidate_id, norm, string_agg(q, ',' ORDER BY p, q) AS quotes FROM (SELECT candidate_id, norm, q, min(pos) AS p FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT n.candidate_id, n.norm, name, kind, found_in, quotes FROM n JOIN f USING (candidate_id, norm) JOIN q USING (candidate_id, norm)""",
    "candidate_texts": _J + """, t AS (SELECT candidate_id, 'experience[' || pos || ']' AS path, concat_ws(chr(10), nullif(title, ''), company, coalesce(description, quote)) AS text FROM j WHERE candidate_id % 7 <> 0),
k AS (SELECT c_custkey AS candidate_id, 'skills' AS path, c_mktsegment || ', ' || c_name AS text FROM customer WHERE c_custkey NOT IN (SELECT candidate_id FROM t))
SELECT candidate_id, path, text, length(text) > 1500 AS truncated FROM (SELECT * FROM t UNION ALL SELECT * FROM k)""",
    "vacancy_texts": "WITH n AS (SELECT l_orderkey, string_agg(p_name, chr(10) ORDER BY l_linenumber, l_partkey, p_name) AS r FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT o_orderkey AS vacancy_id, concat_ws(chr(10), o_orderpriority, r) AS text FROM orders LEFT JOIN n ON l_orderkey = o_orderkey",
    "skill_places": _U + """, a AS (SELECT 'skills[0]' AS path, c_mktsegment AS raw FROM customer UNION ALL
SELECT 'experience[' || job || '].skills_used[' || (row_number() OVER (PARTITION BY candidate_id, job ORDER BY l_linenumber, l_partkey) - 1) || ']', p_name FROM u) SELECT path, raw, count(*) AS n FROM a GROUP BY 1, 2""",
    "tag_coverage": """WITH t AS (SELECT lower(p_name) AS norm, count(*) AS n FROM part GROUP BY 1), k AS (SELECT * FROM t ORDER BY n DESC, norm LIMIT 20), c AS (SELECT *, norm IN (SELECT lower(p_name) FROM part WHERE p_size > 45) AS ok FROM k)
SELECT round(count(*) FILTER (ok) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(CAST(coalesce(sum(n) FILTER (ok), 0) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS weighted FROM c""",
}
