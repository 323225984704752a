"""Windows, orders and top-k as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litloom.operators import windows as wx
from litloom.registry import register
from litloom.runtime import table


@register("win_01_rank", "SELECT record_id, row_number() OVER (ORDER BY round(coalesce(citation_count, 0) + coalesce(reference_count, 0) / 1000.0, 12) DESC, record_id) AS rank FROM paper_records")
def win_01(spark, sf):
    p = table(spark, sf, "paper_records").select("record_id", F.round(F.coalesce("citation_count", F.lit(0)) + F.coalesce("reference_count", F.lit(0)) / 1000.0, 12).alias("total"))
    return wx.ranked(p, [F.desc("total"), F.asc("record_id")]).select("record_id", "rank")


_SCALED = "CASE WHEN abs({h} - {l}) <= 1e-9 * greatest(abs({h}), abs({l})) THEN 1.0 ELSE ({v} - {l}) / nullif({h} - {l}, 0) END"


@register("win_02_minmax", f"SELECT event_id, round({_SCALED.format(v='value', l='min(value) OVER w', h='max(value) OVER w')}, 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def win_02(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return wx.scaled_within(e, "event_type", "value", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


@register("win_03_provider_signals", f"""
WITH s AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), n AS (SELECT user_id, {_SCALED.format(v='v', l='min(v) OVER w', h='max(v) OVER w')} AS x FROM s WINDOW w AS (PARTITION BY event_type))
SELECT user_id, round(avg(x), 6) AS signal FROM n GROUP BY user_id
""")  # fmt: skip
def win_03(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return wx.scaled_within(s, "event_type", "v", "x").groupBy("user_id").agg(F.round(F.avg("x"), 6).alias("signal"))


@register("win_04_citation_signals", f"""
WITH y AS (SELECT max(year) AS ref FROM paper_records), a AS (SELECT record_id, provider, ln(1 + greatest(0, citation_count)) / sqrt(greatest(0, ref - coalesce(year, ref)) + 1) AS v FROM paper_records, y WHERE citation_count IS NOT NULL)
SELECT record_id, round({_SCALED.format(v='v', l='min(v) OVER w', h='max(v) OVER w')}, 6) AS signal FROM a WINDOW w AS (PARTITION BY provider)
""")  # fmt: skip
def win_04(spark, sf):
    p = table(spark, sf, "paper_records").select("record_id", "provider", "citation_count", "year")
    latest = p.agg(F.max("year").alias("ref"))  # one row
    age = F.greatest(F.lit(0), F.col("ref") - F.coalesce("year", "ref")) + 1
    a = p.where("citation_count is not null").join(F.broadcast(latest)).select("record_id", "provider", (F.log1p(F.greatest(F.lit(0), "citation_count")) / F.sqrt(age)).alias("v"))
    return wx.scaled_within(a, "provider", "v", "signal").select("record_id", F.round("signal", 6).alias("signal"))


@register("win_05_nth_appearance", "SELECT evidence_id, format('ref-{}-{}', source_id, row_number() OVER (PARTITION BY source_id ORDER BY evidence_id)) AS anchor FROM evidence_records WHERE source_id IS NOT NULL")
def win_05(spark, sf):
    e = table(spark, sf, "evidence_records").where("source_id is not null").select("evidence_id", "source_id")
    return wx.numbered_within(e, "source_id", ["evidence_id"], "n").select("evidence_id", F.format_string("ref-%s-%d", "source_id", "n").alias("anchor"))


@register("win_06_first_appearance", "SELECT lower(venue) AS venue, min(record_id) AS record_id FROM paper_records WHERE venue IS NOT NULL GROUP BY 1")
def win_06(spark, sf):
    p = table(spark, sf, "paper_records").where("venue is not null").select(F.lower("venue").alias("venue"), "record_id")
    return wx.first_appearance(p, "venue", "record_id")


@register("win_07_running_budget", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS request_no, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 12 AS allowed FROM events")
def win_07(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return wx.within_budget(e, "user_id", ["ts", "event_id"], 12).select("event_id", "request_no", "allowed")


@register("win_08_ordinal_ids", "SELECT record_id, format('ref-{:03d}', row_number() OVER (ORDER BY record_id)) AS reference_id FROM paper_records")
def win_08(spark, sf):
    p = wx.ranked(table(spark, sf, "paper_records").select("record_id"), [F.asc("record_id")])
    return p.select("record_id", F.format_string("ref-%03d", "rank").alias("reference_id"))


@register("win_09_collision_suffixes", """
WITH k AS (SELECT lower(split_part(authors[1], ' ', -1)) || '_' || year AS base, record_id FROM paper_records WHERE len(authors) > 0 AND year IS NOT NULL),
n AS (SELECT base, record_id, row_number() OVER (PARTITION BY base ORDER BY record_id) AS n, count(*) OVER (PARTITION BY base) AS c FROM k)
SELECT record_id, CASE WHEN c = 1 THEN base WHEN n <= 26 THEN base || '_' || chr(CAST(96 + n AS INTEGER)) ELSE base || '_' || n END AS citation_key FROM n
""")  # fmt: skip
def win_09(spark, sf):
    base = F.concat(F.lower(F.element_at(F.split(F.get("authors", F.lit(0)), " "), -1)), F.lit("_"), F.col("year").cast("string"))
    k = table(spark, sf, "paper_records").where("size(authors) > 0 and year is not null").select("record_id", base.alias("base")).where("base is not null")
    of_base = Window.partitionBy("base")
    n, c = F.row_number().over(of_base.orderBy("record_id")), F.count("*").over(of_base)
    letter = F.when(n <= 26, F.char(F.lit(96) + n)).otherwise(n.cast("string"))
    return k.select("record_id", F.when(c == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), letter)).alias("citation_key"))


_SCORE = "CASE WHEN coalesce(is_retracted, false) THEN 0 ELSE 1 END, CASE WHEN coalesce(abstract, '') <> '' THEN 1 ELSE 0 END, {ids}, coalesce(citation_count, 0) + coalesce(year, 0)"
_FOUR = " + ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN 1 ELSE 0 END" for c in ("doi", "pmid", "openalex_id", "semantic_scholar_id"))


def record_score():
    """Order of records: not retracted, verified by an abstract, identifiers, citations and year."""
    four = sum(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0) for c in ("doi", "pmid", "openalex_id", "semantic_scholar_id"))
    return [
        F.when(F.coalesce("is_retracted", F.lit(False)), 0).otherwise(1),
        F.when(F.coalesce("abstract", F.lit("")) != "", 1).otherwise(0),
        four,
        F.coalesce("citation_count", F.lit(0)) + F.coalesce("year", F.lit(0)),
    ]


@register("ord_01_record_score", f"""
SELECT record_id, CASE WHEN coalesce(is_retracted, false) THEN 0 ELSE 1 END AS eligible, CASE WHEN coalesce(abstract, '') <> '' THEN 1 ELSE 0 END AS verification, {_FOUR} AS identifiers,
  coalesce(citation_count, 0) + coalesce(year, 0) AS weight FROM paper_records
""")  # fmt: skip
def ord_01(spark, sf):
    names = ("eligible", "verification", "identifiers", "weight")
    return table(spark, sf, "paper_records").select("record_id", *[c.alias(n) for c, n in zip(record_score(), names)])


@register("ord_02_packet_order", f"""
SELECT record_id, row_number() OVER (ORDER BY (CASE WHEN coalesce(is_retracted, false) THEN 0 ELSE 1 END) DESC, (CASE WHEN coalesce(abstract, '') <> '' THEN 1 ELSE 0 END) DESC, ({_FOUR}) DESC,
  (coalesce(citation_count, 0) + coalesce(year, 0)) DESC, record_id) AS place FROM paper_records
""")  # fmt: skip
def ord_02(spark, sf):
    p = table(spark, sf, "paper_records").select("record_id", *[c.alias(f"s{i}") for i, c in enumerate(record_score())])
    return wx.ranked(p, [*[F.desc(f"s{i}") for i in range(4)], F.asc("record_id")], "place").select("record_id", "place")


@register("ord_03_extraction_candidates", "SELECT record_id FROM paper_records WHERE coalesce(is_open_access, false) AND coalesce(url, '') <> '' ORDER BY coalesce(citation_count, 0) DESC, record_id LIMIT 20")
def ord_03(spark, sf):
    """Report of the 20 most cited open-access records with an address."""
    p = table(spark, sf, "paper_records").where("coalesce(is_open_access, false) and coalesce(url, '') <> ''")
    return p.orderBy(F.coalesce("citation_count", F.lit(0)).desc(), "record_id").limit(20).select("record_id")


@register("ord_06_top_per_group", "SELECT provider, record_id FROM paper_records QUALIFY row_number() OVER (PARTITION BY provider ORDER BY coalesce(citation_count, 0) DESC, record_id) <= 3")
def ord_06(spark, sf):
    """The three most cited records of each provider, by a window whose rank limit keeps three rows a task before the shuffle."""
    best = F.struct(-F.coalesce("citation_count", F.lit(0)), "record_id")
    p = table(spark, sf, "paper_records").select("provider", "record_id", best.alias("k"))
    w = Window.partitionBy("provider").orderBy("k")  # a window with a rank limit keeps three rows a task before the shuffle
    return p.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("provider", "record_id")


@register("hlp_01_unique_locations", r"SELECT lower(rtrim(trim(url), '/')) AS location, min(record_id) AS record_id FROM paper_records WHERE url IS NOT NULL GROUP BY 1")
def hlp_01(spark, sf):
    p = table(spark, sf, "paper_records").where("url is not null").select(F.lower(F.regexp_replace(F.trim("url"), "/+$", "")).alias("location"), "record_id")
    return p.groupBy("location").agg(F.min("record_id").alias("record_id"))
