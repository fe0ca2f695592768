"""Taxonomy queries: concepts are brands of parts, their labels the parts' names and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import taxonomy as X
from .ranking import _t


def released_rows(spark, sf_dir):
    """Lines as versions of a part's row: accepted ones are not released, those still open are of another kind."""
    ln = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("uri"), F.when(F.col("l_returnflag") == "A", "deprecated").otherwise("released").alias("status"), F.when(F.col("l_linestatus") == "F", "KnowledgeSkillCompetence").otherwise("SkillGroup").alias("concept_type"), F.date_trunc("month", "l_shipdate").alias("modified"), "l_orderkey", "l_linenumber")
    return X.released(ln, [F.col("l_orderkey"), F.col("l_linenumber")]).select("uri", "l_orderkey", "l_linenumber")


def _labels(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    cell = F.concat_ws("\n", F.initcap("p_name"), F.lit("  "), F.concat("p_type", F.lit(" ")), F.concat(F.initcap("p_name"), F.lit(" ("), F.lower("p_type"), F.lit(")")), F.concat(F.lit("x"), F.col("p_size") % 10))
    kind = F.element_at(F.array(*map(F.lit, ("preferred", "alt", "hidden", "custom"))), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("canonical_id"), F.explode(X.split_labels(cell)).alias("label"), F.when(F.col("p_partkey") % 3 == 0, "uk").otherwise("en").alias("lang"), kind.alias("kind"))


def part_aliases(spark, sf_dir):
    return X.deduped(X.aliases(_labels(spark, sf_dir)))


def stripped_aliases(spark, sf_dir):
    """Forms without parentheses that only one concept has; names that other brands have too are left out."""
    labels = _labels(spark, sf_dir).filter(F.col("label").contains("(")).withColumn("label", F.when(F.length("label") % 2 == 0, F.concat(F.lit("only "), "canonical_id", F.lit(" "), "label")).otherwise(F.col("label")))
    return X.stripped(X.aliases(labels))[0].select("canonical_id", "alias", "alias_norm", "lang", "exact_only")


def strip_collisions(spark, sf_dir):
    labels = _labels(spark, sf_dir)
    return X.stripped(X.aliases(labels.filter(F.col("label").contains("("))))[1].select("alias_norm", F.size("canonical_ids").alias("n"), F.array_join("canonical_ids", ",").alias("ids"))


def _concepts(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("Brand#"), F.col("s_suppkey")).alias("canonical_id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).otherwise("").alias("name_en"), (F.col("s_acctbal") > 5000).alias("is_digital"), F.when(F.col("s_nationkey") < 5, "custom").otherwise("esco").alias("source"))


def alias_names(spark, sf_dir):
    """Concepts with the names of two languages, and the names that their aliases then show."""
    c = _t(spark, sf_dir, "customer").select(F.concat(F.lit("Brand#"), F.col("c_custkey")).alias("canonical_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("label"))
    concepts, _ = X.with_second_names(_concepts(spark, sf_dir), c)
    return X.named(part_aliases(spark, sf_dir), concepts).groupBy("canonical_id", "canonical_name").agg(F.count("*").alias("aliases"))


def unknown_labels(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.concat(F.lit("Brand#"), F.col("c_custkey")).alias("canonical_id"), F.col("c_name").alias("label"))
    return X.with_second_names(_concepts(spark, sf_dir), c)[1]


def second_names(spark, sf_dir):
    """The least preferred alias of the second language for each concept."""
    a = X.aliases(_labels(spark, sf_dir)).filter("lang = 'uk' AND kind = 'preferred'")
    return a.groupBy("canonical_id").agg(F.min("alias").alias("name"))


def taxonomy_manifest(spark, sf_dir):
    return X.manifest(part_aliases(spark, sf_dir))


def strong_aliases(spark, sf_dir):
    return X.strong_norms(part_aliases(spark, sf_dir), _concepts(spark, sf_dir))


QUERIES = {f.__name__: f for f in (released_rows, part_aliases, stripped_aliases, strip_collisions, alias_names, unknown_labels, second_names, taxonomy_manifest, strong_aliases)}

_ICAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), ' ')"
_A = f"""WITH c AS (SELECT p_brand AS canonical_id, p_partkey, p_size, {_ICAP} AS name, p_type FROM part),
l AS (SELECT canonical_id, trim(unnest([name, '  ', p_type || ' ', name || ' (' || lower(p_type) || ')', 'x' || CAST(p_size % 10 AS VARCHAR)])) AS alias, CASE WHEN p_partkey % 3 = 0 THEN 'uk' ELSE 'en' END AS lang, ['preferred', 'alt', 'hidden', 'custom'][p_size % 4 + 1] AS kind FROM c),
a AS (SELECT canonical_id, alias, lower(alias) AS alias_norm, lang, kind, length(lower(alias)) <= 2 AS exact_only FROM l WHERE alias <> ''),
d AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id, alias_norm ORDER BY list_position(['preferred', 'alt', 'hidden', 'stripped', 'custom'], kind), CASE WHEN lang = 'en' THEN 0 ELSE 1 END, lang, alias) AS n FROM a) WHERE n = 1)
"""
_CON = "con AS (SELECT 'Brand#' || s_suppkey AS canonical_id, CASE WHEN s_suppkey % 3 > 0 THEN s_name ELSE '' END AS name_en, s_acctbal > 5000 AS is_digital, CASE WHEN s_nationkey < 5 THEN 'custom' ELSE 'esco' END AS source FROM supplier)"
_S = """, p AS (SELECT canonical_id, regexp_extract(alias, '^(.*[^ ]) *\\([^()]*\\) *$', 1) AS alias, lang, kind FROM {src} WHERE kind NOT IN ('stripped', 'custom')),
q AS (SELECT canonical_id, alias, lower(alias) AS alias_norm, lang FROM p WHERE alias <> ''),
f AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id, alias_norm ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, lang, alias) AS n FROM q WHERE NOT EXISTS (SELECT 1 FROM {src} o WHERE o.canonical_id = q.canonical_id AND o.alias_norm = q.alias_norm)) WHERE n = 1),
w AS (SELECT alias_norm, canonical_id FROM f UNION SELECT alias_norm, canonical_id FROM {src} WHERE alias_norm IN (SELECT alias_norm FROM f)),
k AS (SELECT alias_norm, count(*) AS n, string_agg(canonical_id, ',' ORDER BY canonical_id) AS ids FROM w GROUP BY 1)
"""
_EVEN = ", e AS (SELECT canonical_id, CASE WHEN length(alias) % 2 = 0 THEN 'only ' || canonical_id || ' ' || alias ELSE alias END AS alias, lang, kind FROM a WHERE alias LIKE '%(%'), b AS (SELECT *, lower(alias) AS alias_norm FROM e)"
ORACLES = {
    "released_rows": "SELECT uri, l_orderkey, l_linenumber FROM (SELECT l_partkey AS uri, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY date_trunc('month', l_shipdate) DESC, l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus = 'F') WHERE n = 1",
    "part_aliases": _A + "SELECT * FROM d",
    "stripped_aliases": _A + _EVEN + _S.format(src="b") + "SELECT canonical_id, alias, alias_norm, lang, length(alias_norm) <= 2 AS exact_only FROM f WHERE alias_norm NOT IN (SELECT alias_norm FROM k WHERE n > 1)",
    "strip_collisions": _A + ", b AS (SELECT * FROM a WHERE alias LIKE '%(%')" + _S.format(src="b") + "SELECT alias_norm, n, ids FROM k WHERE n > 1",
    "alias_names": _A + ", " + _CON + ", cu AS (SELECT 'Brand#' || c_custkey AS canonical_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS name_uk FROM customer) SELECT d.canonical_id, coalesce(nullif(name_en, ''), CASE WHEN con.canonical_id IS NOT NULL THEN nullif(name_uk, '') END, d.canonical_id) AS canonical_name, count(*) AS aliases FROM d LEFT JOIN con USING (canonical_id) LEFT JOIN cu ON cu.canonical_id = d.canonical_id GROUP BY 1, 2",
    "unknown_labels": "SELECT count(*) AS unknown FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "second_names": _A + "SELECT canonical_id, min(alias) AS name FROM a WHERE lang = 'uk' AND kind = 'preferred' GROUP BY 1",
    "taxonomy_manifest": _A + "SELECT count(DISTINCT canonical_id) AS concepts, count(*) AS aliases, count(*) FILTER (kind = 'preferred') AS preferred, count(*) FILTER (kind = 'alt') AS alt, count(*) FILTER (kind = 'hidden') AS hidden, count(*) FILTER (kind = 'stripped') AS stripped, count(*) FILTER (kind = 'custom') AS custom, count(*) FILTER (exact_only) AS exact_only, (SELECT count(*) FROM (SELECT alias_norm FROM d GROUP BY 1 HAVING count(DISTINCT canonical_id) > 1)) AS ambiguous FROM d",
    "strong_aliases": _A + ", " + _CON + " SELECT alias_norm, bool_or(coalesce(is_digital OR source = 'custom', false) OR kind = 'custom') AS strong FROM d LEFT JOIN con USING (canonical_id) GROUP BY 1",
}
