"""Pages of blocks, four orders a page: lines are blocks, their box follows from their keys and amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from .ranking import _t

WIDTH = 595.0


def _blocks(spark, sf_dir):
    """Three pages in four have two columns, some with a wide block or a narrow one in between; the rest are of one column."""
    ln = _t(spark, sf_dir, "lineitem")
    two, wide, narrow = F.expr("l_orderkey div 4 % 4 < 3"), F.col("l_quantity") > 46, (F.col("l_quantity") == 7) & (F.col("l_discount") > 0.05)
    x0 = F.when(~two | wide, 40.0).when(narrow, 200.0 + F.col("l_partkey") % 60).otherwise(40.0 + F.col("l_suppkey") % 2 * 280.0 + F.col("l_partkey") % 5 * 0.5)
    long = F.when(~two | wide, 400.0 + F.col("l_partkey") % 120).when(narrow, 90.0).otherwise(170.0 + F.col("l_quantity"))
    y0 = F.col("l_orderkey") % 4 * 180.0 + F.col("l_linenumber") * 22.0 + F.col("l_partkey") % 40 * 0.5
    df = ln.select(F.expr("l_orderkey div 4").alias("page"), (F.col("l_orderkey") % 4 * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("pos"), x0.alias("x0"), y0.alias("y0"), (x0 + long).alias("x1"), (y0 + 10.0 + F.col("l_suppkey") % 7 * 2.0).alias("y1"))
    return df.groupBy("page", "pos").agg(F.min(F.struct("x0", "y0", "x1", "y1")).alias("box")).select("page", "pos", "box.*")


def reading_order(spark, sf_dir):
    return L.reading_order(_blocks(spark, sf_dir), WIDTH).select("page", "pos", F.round("gutter", 3).alias("gutter"), "place")


def page_gutters(spark, sf_dir):
    """How many pages have their gutter where."""
    g = L.gutters(_blocks(spark, sf_dir), WIDTH)
    return g.groupBy(F.round("gutter", 1).alias("gutter")).agg(F.count("*").alias("pages"))


QUERIES = {f.__name__: f for f in (reading_order, page_gutters)}

_BLOCKS = """WITH b AS (SELECT DISTINCT l_orderkey // 4 AS page, l_orderkey % 4 * 100000000 + l_linenumber * 10000000 + l_partkey AS pos,
  CASE WHEN l_orderkey // 4 % 4 = 3 OR l_quantity > 46 THEN 40.0::DOUBLE WHEN l_quantity = 7 AND l_discount > 0.05::DOUBLE THEN 200.0::DOUBLE + l_partkey % 60 ELSE 40.0::DOUBLE + l_suppkey % 2 * 280.0::DOUBLE + l_partkey % 5 * 0.5::DOUBLE END AS x0,
  CASE WHEN l_orderkey // 4 % 4 = 3 OR l_quantity > 46 THEN 400.0::DOUBLE + l_partkey % 120 WHEN l_quantity = 7 AND l_discount > 0.05::DOUBLE THEN 90.0::DOUBLE ELSE 170.0::DOUBLE + l_quantity END AS w,
  l_orderkey % 4 * 180.0::DOUBLE + l_linenumber * 22.0::DOUBLE + l_partkey % 40 * 0.5::DOUBLE AS y0, 10.0::DOUBLE + l_suppkey % 7 * 2.0::DOUBLE AS h FROM lineitem),
k AS (SELECT page, pos, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM b QUALIFY row_number() OVER (PARTITION BY page, pos ORDER BY x0, y0, w, h) = 1),
n AS (SELECT page, x0, x1, y0, y1, x1 - x0 <= 357.0::DOUBLE AS narrow FROM k),
i AS (SELECT page, i, 148.75::DOUBLE + i AS x FROM (SELECT DISTINCT page FROM k), range(298) t(i)),
v AS (SELECT i.page, i.i, i.x, coalesce(bool_or(x1 <= x), false) AND coalesce(bool_or(x0 >= x), false)
    AND min(y0) FILTER (x1 <= x) < max(y1) FILTER (x0 >= x) AND min(y0) FILTER (x0 >= x) < max(y1) FILTER (x1 <= x) AS fine
  FROM i JOIN n USING (page) GROUP BY 1, 2, 3),
bad AS (SELECT DISTINCT v.page, v.i FROM v JOIN n a ON a.page = v.page AND a.x0 < x AND x < a.x1 AND a.narrow
  JOIN n s ON s.page = v.page AND (s.x1 <= x OR s.x0 >= x) AND a.y0 < s.y1 AND s.y0 < a.y1 WHERE v.fine),
f AS (SELECT v.page, v.i, v.i - row_number() OVER (PARTITION BY v.page ORDER BY v.i) AS run FROM v ANTI JOIN bad USING (page, i) WHERE fine),
r AS (SELECT page, min(i) AS a, max(i) AS z FROM f GROUP BY page, run HAVING max(i) - min(i) >= 4),
g AS (SELECT page, 148.75::DOUBLE + (a + z) / 2.0::DOUBLE AS gutter FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY z - a DESC, a) AS best FROM r) WHERE best = 1)"""
ORACLES = {
    "reading_order": _BLOCKS + """, d AS (SELECT k.*, gutter, round_even(y0, 1) AS t, (y0 + y1) / 2 AS m, CASE WHEN gutter IS NULL OR x1 <= gutter THEN 0 WHEN x0 >= gutter THEN 1 ELSE 2 END AS side FROM k LEFT JOIN g USING (page)),
c AS (SELECT page, pos, m AS bottom, row_number() OVER w AS band, coalesce(lag(m) OVER w, -1e9) AS upper FROM d WHERE side = 2 WINDOW w AS (PARTITION BY page ORDER BY t, x0, pos)),
bands AS (SELECT page, band, upper, bottom FROM c UNION ALL SELECT page, max(band) + 1, arg_max(bottom, band), 1e9 FROM c GROUP BY page),
e AS (SELECT d.*, coalesce(band, 1) AS band FROM d LEFT JOIN bands USING (page) WHERE side < 2 AND (band IS NULL OR (m >= upper AND m < bottom))
  UNION ALL SELECT d.*, c.band FROM d JOIN c USING (page, pos) WHERE side = 2)
SELECT page, pos, round(gutter, 3) AS gutter, row_number() OVER (PARTITION BY page ORDER BY band, side, t, x0, pos) AS place FROM e""",
    "page_gutters": _BLOCKS + " SELECT round(gutter, 1) AS gutter, count(*) AS pages FROM g GROUP BY 1",
}
