"""Profiles and grids as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.operators import grid as gx
from litloom.registry import register
from litloom.runtime import table

_CELLS = "SELECT month(o_orderdate)::DOUBLE AS x, CAST(left(o_orderpriority, 1) AS DOUBLE) AS y, max(o_totalprice) AS value FROM orders GROUP BY 1, 2"


def cells(spark, sf):
    """Highest order price by month and priority."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.month("o_orderdate").cast("double").alias("x"), F.left("o_orderpriority", F.lit(1)).cast("double").alias("y")).agg(F.max("o_totalprice").alias("value"))


PROFILED = (
    "record_id", "provider", "title", "authors", "publication_date", "year", "venue", "doi", "pmid", "pmcid", "openalex_id", "semantic_scholar_id", "arxiv_id", "url", "abstract", "publication_types",
    "fields_of_study", "keywords", "citation_count", "reference_count", "is_retracted", "is_open_access", "provenance", "retrieved_at", "ingested_at",
)


@register("prj_10_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null FROM paper_records" for c in PROFILED))
def prj_10(spark, sf):
    """Rows and nulls of every column."""
    return gx.profile(table(spark, sf, "paper_records").select(*PROFILED)).select("column", "n_rows", "n_null")


@register("grid_01_rectangular", f"WITH g AS ({_CELLS}) SELECT a.x, b.y, g.value FROM (SELECT DISTINCT x FROM g) a CROSS JOIN (SELECT DISTINCT y FROM g) b LEFT JOIN g ON g.x = a.x AND g.y = b.y")
def grid_01(spark, sf):
    return gx.from_samples(cells(spark, sf), "x", "y", "value", allow_incomplete=True)


@register("grid_02_resample", f"""
WITH g AS ({_CELLS}), t AS (SELECT unnest([1.5, 4.25, 8.0, 11.5])::DOUBLE AS tx), u AS (SELECT unnest([1.5, 3.0, 4.75])::DOUBLE AS ty),
a AS (SELECT tx AS x, y, lo.value + (tx - floor(tx)) * (coalesce(hi.value, lo.value) - lo.value) AS value FROM t JOIN g lo ON lo.x = floor(tx) LEFT JOIN g hi USING (y) WHERE hi.x = floor(tx) + 1)
SELECT lo.x, ty AS y, round(lo.value + (ty - floor(ty)) * (hi.value - lo.value), 6) AS value FROM u JOIN a lo ON lo.y = floor(ty) JOIN a hi ON hi.y = floor(ty) + 1 AND hi.x = lo.x
""")  # fmt: skip
def grid_02(spark, sf):
    g = gx.from_samples(cells(spark, sf), "x", "y", "value")
    return gx.resample(g, [1.5, 4.25, 8.0, 11.5], [1.5, 3.0, 4.75]).select("x", "y", F.round("value", 6).alias("value"))


@register("grid_03_vectors", "SELECT l_orderkey, l_linenumber, round(sqrt(u * u + v * v), 6) AS magnitude, round(CASE WHEN sqrt(u * u + v * v) > 0 THEN atan2(v, u) / pi() END, 6) AS direction FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity - 25 AS u, l_discount * 100 - 5 AS v FROM lineitem)")
def grid_03(spark, sf):
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("u"), (F.col("l_discount") * 100 - 5).alias("v")).distinct()
    magnitude, direction, _, _ = gx.vector(F.col("u"), F.col("v"))
    return p.select("l_orderkey", "l_linenumber", F.round(magnitude, 6).alias("magnitude"), F.round(direction, 6).alias("direction"))


@register("grid_04_strided", f"SELECT x, y, value FROM ({_CELLS}) WHERE (x - 1) % 3 = 0 AND y % 2 = 1")
def grid_04(spark, sf):
    """Every third month and second priority: a sampling operator."""
    return cells(spark, sf).where("(x - 1) % 3 = 0 and y % 2 = 1")


@register("grid_05_pivot", "SELECT y, " + ", ".join(f"max(value) FILTER (x = {m}) AS m{m}" for m in range(1, 13)) + f" FROM ({_CELLS}) GROUP BY y")
def grid_05(spark, sf):
    """One row per priority with a column for each month."""
    p = cells(spark, sf).groupBy("y").pivot("x", [float(m) for m in range(1, 13)]).agg(F.first("value"))
    return p.select("y", *[F.col(f"`{float(m)}`").alias(f"m{m}") for m in range(1, 13)])


@register("grid_06_groups_in_order", "SELECT l_returnflag, min(l_orderkey) AS first_seen, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def grid_06(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.min("l_orderkey").alias("first_seen"), F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))


@register("grid_08_error_bars", "SELECT l_partkey, round(avg(l_extendedprice) - min(l_extendedprice), 8) AS below, round(max(l_extendedprice) - avg(l_extendedprice), 8) AS above FROM lineitem GROUP BY l_partkey")
def grid_08(spark, sf):
    mean = F.avg("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.round(mean - F.min("l_extendedprice"), 8).alias("below"), F.round(F.max("l_extendedprice") - mean, 8).alias("above"))
