"""Queries on extractions: quotes of documents, names that are nearly equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blocks import assembled
from ..operators import fuzzy_pairs as P
from ..operators import grounding as G
from ..operators import sections as S
from .ranking import _t


def _quotes(spark, sf_dir):
    """Of every text: some words, their white space made plain; the same less a character; the beginning of a benchmark item."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    some = F.regexp_replace(F.regexp_extract("text", r"\S+(?:\s+\S+){3,6}", 0), r"\s+", " ")
    item = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), F.substring("text", 1, 60).alias("begin"))
    q = d.select("doc_id", (F.col("doc_id") % 200).alias("item"), some.alias("some")).join(item, "item", "left")  # texts stay behind
    some = F.col("some")
    one = F.overlay(some, F.lit(""), F.lit(10), F.lit(1))
    items = F.array(F.struct(F.lit("skills[0]").alias("path"), some.alias("quote")), F.struct(F.lit("skills[1]").alias("path"), one.alias("quote")), F.struct(F.lit("experience[0]").alias("path"), F.col("begin").alias("quote")))
    return q.select("doc_id", F.explode(items).alias("i")).select("doc_id", "i.*", F.lit("skills_list").alias("found_in")).filter("quote <> ''")


def grounded_quotes(spark, sf_dir):
    df = G.grounded(_t(spark, sf_dir, "documents").select("doc_id", "text"), _quotes(spark, sf_dir))
    return df.select("doc_id", "path", "status", "start", "end", "score", "ambiguous", "low_confidence")


def exact_quotes(spark, sf_dir):
    """The first two words of letters of a text, where they stand."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    q = d.select("doc_id", F.lit("skills[0]").alias("path"), F.regexp_extract("text", "[A-Za-z]{3,} [A-Za-z]{3,}", 0).alias("quote"), F.lit(None).cast("string").alias("found_in")).filter("quote <> ''")
    return G.grounded(d, q).select("doc_id", "status", "start", "end", "matched", "ambiguous")


def _names(spark, sf_dir):
    """Gold: parts' names and brands, by size and type; predicted: some misspelled, some with a word more, some others."""
    p = _t(spark, sf_dir, "part").select(F.concat_ws("/", F.col("p_size"), "p_type", F.col("p_partkey") % 40).alias("grp"), F.col("p_partkey").alias("pos"), F.concat_ws(" ", "p_name", "p_brand", F.concat(F.lit("mark "), F.col("p_partkey") % 7)).alias("text"))
    n = F.col("pos") % 6
    other = F.when(n == 0, F.overlay("text", F.lit("x"), F.lit(4), F.lit(1))).when(n == 1, F.concat(F.lit("new "), F.col("text"))).when(n == 2, F.upper("text")).when(n == 3, F.substring("text", 1, 9)).when(n == 4, F.reverse("text")).otherwise(F.col("text"))
    return p, p.filter("pos % 11 > 0").select("grp", "pos", other.alias("text"))


def name_pairs(spark, sf_dir):
    gold, predicted = _names(spark, sf_dir)
    return P.pair_counts(gold, predicted, "grp")


HEADINGS = ("Experience", "EDUCATION", "Skills: SQL and more", "Languages", "My Journey", "Work Expirience", "Education & Volunteering", "Certificates", "me@mail.example", "Tools:", "04. Projects", "ДОСВІД РОБОТИ")


def _lines(spark, sf_dir):
    """Lines of documents as blocks; each sixth is a heading or an address. Sizes and weight follow from place and length."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("i", "line")).filter(F.trim("line") != "")
    place = (F.col("doc_id") + F.col("i")) % len(HEADINGS)
    headed = (F.col("i") + F.col("doc_id")) % 6 == 0
    text = F.when(headed, F.element_at(F.array(*map(F.lit, HEADINGS)), (place + 1).cast("int"))).otherwise(F.col("line"))
    size = F.when(headed, 13.0 + F.col("doc_id") % 3).otherwise(9.0 + F.char_length("line") % 4 * 0.5)
    return assembled(d.select("doc_id", "i", text.alias("text"), size.alias("size"), (headed & (F.col("doc_id") % 4 > 0)).alias("bold")), "doc_id", "i")


def document_sections(spark, sf_dir):
    df = S.sections(_lines(spark, sf_dir))
    return df.select("doc_id", "n", F.array_join("types", ",").alias("types"), "heading", "content_start", "end", "confidence", "source", F.size("blocks").alias("n_blocks"))


def section_warnings(spark, sf_dir):
    return S.section_warnings(_lines(spark, sf_dir)).groupBy("warning").agg(F.count("*").alias("documents"))


def body_sizes(spark, sf_dir):
    return S.body_size(_lines(spark, sf_dir))


QUERIES = {f.__name__: f for f in (grounded_quotes, exact_quotes, name_pairs, document_sections, section_warnings, body_sizes)}
#: grounded_quotes, name_pairs and sections hang on likeness by common subsequences; tests hold them to plain loops.
ORACLES = {
    "exact_quotes": """WITH q AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{3,} [A-Za-z]{3,}') AS q FROM documents),
p AS (SELECT *, instr(text, q) AS place FROM q WHERE q <> '')
SELECT doc_id, 'exact' AS status, place - 1 AS start, place - 1 + length(q) AS "end", q AS matched, instr(substr(text, place + 1), q) > 0 AS ambiguous FROM p""",
    "body_sizes": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
b AS (SELECT doc_id, CASE WHEN (i + doc_id) % 6 = 0 THEN 13.0::DOUBLE + doc_id % 3 ELSE 9.0::DOUBLE + length(line) % 4 * 0.5::DOUBLE END AS size,
  length(CASE WHEN (i + doc_id) % 6 = 0 THEN ['""" + "', '".join(HEADINGS) + """'][(doc_id + i) % 12 + 1] ELSE line END) AS n FROM l WHERE trim(line) <> ''),
s AS (SELECT doc_id, size, sum(n) AS n FROM b GROUP BY 1, 2),
r AS (SELECT doc_id, size, 2 * sum(n) OVER (PARTITION BY doc_id ORDER BY size) >= sum(n) OVER (PARTITION BY doc_id) AS half FROM s)
SELECT doc_id, min(size) AS body FROM r WHERE half GROUP BY 1""",
}
