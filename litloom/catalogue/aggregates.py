"""Aggregates and constraint reports as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.catalogue import scalars as sc
from litloom.functions import text as fx
from litloom.operators import constraints as ck
from litloom.registry import register
from litloom.runtime import broadcast_if_small, table

# Verdicts from weak to strong, and confidence caps from low to high.
VERDICTS = ("keep", "downgrade", "revise", "kill")


def references(spark, sf):
    """Evidence rows of all papers with their derived columns."""
    p = table(spark, sf, "paper_records")
    kind = fx.publication_class(F.col("publication_types"), sc.source_text())
    p = p.withColumn("publication_class", kind).withColumn("preprint", fx.is_preprint()).withColumn("findings", fx.findings(F.col("abstract")))
    verified = (
        F.when(F.coalesce("abstract", F.lit("")) != "", "abstract-verified").when(fx.has_identifier(False), "identifier-verified").otherwise("search-only")
    )
    quality = fx.evidence_label(F.col("publication_class"), F.col("preprint"), F.col("is_retracted"))
    return p.withColumn("verification", verified).withColumn("evidence_quality", quality).withColumn("retracted", F.coalesce("is_retracted", F.lit(False)))


_VERIFIED = "CASE WHEN coalesce(abstract, '') <> '' THEN 'abstract-verified' WHEN coalesce(doi, '') <> '' OR coalesce(pmid, '') <> '' OR coalesce(pmcid, '') <> '' OR coalesce(openalex_id, '') <> '' OR coalesce(semantic_scholar_id, '') <> '' THEN 'identifier-verified' ELSE 'search-only' END"


@register("agg_02_coverage", f"""
SELECT count(*) AS total, count(*) FILTER (v <> 'search-only' AND NOT r) AS verified, CAST(greatest(0, 60 - count(*) FILTER (v <> 'search-only' AND NOT r)) AS BIGINT) AS shortfall, count(*) FILTER (coalesce(is_open_access, false)) AS open_access,
count(*) FILTER (r) AS retracted, count(*) FILTER (preprint) AS preprints, count(*) FILTER (coalesce(doi, '') = '' AND coalesce(pmid, '') = '') AS without_doi_or_pmid
FROM (SELECT *, {_VERIFIED} AS v, coalesce(is_retracted, false) AS r, {sc.SQL_PREPRINT} AS preprint FROM paper_records)
""")  # fmt: skip
def agg_02(spark, sf):
    r = references(spark, sf)
    ok = (F.col("verification") != "search-only") & ~F.col("retracted")
    return r.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("verified"),
        F.greatest(F.lit(0), 60 - F.count_if(ok)).cast("bigint").alias("shortfall"),
        F.count_if(F.coalesce("is_open_access", F.lit(False))).alias("open_access"),
        F.count_if("retracted").alias("retracted"),
        F.count_if("preprint").alias("preprints"),
        F.count_if((F.coalesce("doi", F.lit("")) == "") & (F.coalesce("pmid", F.lit("")) == "")).alias("without_doi_or_pmid"),
    )


@register("agg_02_mixes", f"""
WITH q AS (SELECT *, {_VERIFIED} AS v FROM ({sc.SQL_QUALITY}))
SELECT 'verification' AS mix, v AS value, count(*) AS n FROM q GROUP BY v UNION ALL SELECT 'evidence_quality', evidence_quality, count(*) FROM q GROUP BY evidence_quality
UNION ALL SELECT 'provider', p, count(*) FROM (SELECT unnest(list_transform(provenance, lambda x: x.provider)) AS p FROM q) GROUP BY p
""")  # fmt: skip
def agg_02_mixes(spark, sf):
    r = references(spark, sf)
    parts = [r.select(F.lit("verification").alias("mix"), F.col("verification").alias("value")), r.select(F.lit("evidence_quality").alias("mix"), F.col("evidence_quality").alias("value"))]
    both = parts[0].unionByName(parts[1]).unionByName(r.select(F.lit("provider").alias("mix"), F.explode("provenance.provider").alias("value")))
    return both.groupBy("mix", "value").agg(F.count("*").alias("n"))


_CONFLICT = " OR ".join(f"contains(lower(f), '{w}')" for w in fx.CONFLICT_WORDS)


@register("agg_04_synthesis", f"SELECT record_id, f AS finding, CASE WHEN {_CONFLICT} THEN 'conflicting' ELSE 'consensus' END AS side FROM (SELECT record_id, unnest(findings) AS f FROM ({sc.SQL_FINDINGS}) WHERE NOT coalesce(is_retracted, false))")
def agg_04(spark, sf):
    """Findings of eligible papers, split by wording; the reader's list of the first 30 is a report made from it."""
    f = references(spark, sf).where("not retracted").select("record_id", F.explode("findings").alias("finding"))
    return f.withColumn("side", F.when(fx.any_of(F.lower("finding"), fx.CONFLICT_WORDS), "conflicting").otherwise("consensus"))


@register("agg_04_designs", f"SELECT kind AS study_design, count(*) AS n FROM ({sc.SQL_QUALITY}) GROUP BY kind")
def agg_04_designs(spark, sf):
    return references(spark, sf).groupBy(F.col("publication_class").alias("study_design")).agg(F.count("*").alias("n"))


@register("agg_05_claim_map", f"SELECT record_id, claim, 'single-source' AS status FROM (SELECT record_id, unnest(findings) AS claim FROM ({sc.SQL_FINDINGS}) WHERE NOT coalesce(is_retracted, false))")
def agg_05(spark, sf):
    return references(spark, sf).where("not retracted").select("record_id", F.explode("findings").alias("claim"), F.lit("single-source").alias("status"))


_METHOD = " OR ".join(f"contains(lower(combined), '{w}')" for w in ("method", "protocol", "assay", "measure", "instrument", "benchmark"))


@register("agg_06_section_briefs", f"""
SELECT section, count(*) AS n_references FROM (SELECT unnest(CASE WHEN kind = 'methods/protocol' OR {_METHOD} THEN ['introduction', 'discussion', 'methods-rationale'] ELSE ['introduction', 'discussion'] END) AS section FROM ({sc.SQL_QUALITY})) GROUP BY section
""")  # fmt: skip
def agg_06(spark, sf):
    words = ("method", "protocol", "assay", "measure", "instrument", "benchmark")
    text = F.concat(F.lower(F.array_join(F.coalesce("publication_types", F.array().cast("array<string>")), " ")), F.lit(" "), F.lower(sc.source_text()))
    tags = F.when((F.col("publication_class") == "methods/protocol") | fx.any_of(text, words), F.array(F.lit("introduction"), F.lit("discussion"), F.lit("methods-rationale"))).otherwise(
        F.array(F.lit("introduction"), F.lit("discussion"))
    )
    return references(spark, sf).select(F.explode(tags).alias("section")).groupBy("section").agg(F.count("*").alias("n_references"))


@register("agg_08_source_counts", "SELECT feed, count(DISTINCT e.source_id) AS n_sources, count(DISTINCT CASE WHEN coalesce(direct_evidence, false) THEN e.source_id END) AS n_direct, count(*) AS n_rows FROM evidence_records e JOIN evidence_sources s USING (source_id) GROUP BY feed")
def agg_08(spark, sf):
    s = table(spark, sf, "evidence_sources").select("source_id", "feed")
    # one row per source first, so that a hot source is added up before it is joined
    e = table(spark, sf, "evidence_records").groupBy("source_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("direct_evidence", F.lit(False))).alias("direct"))
    j = e.join(broadcast_if_small(s), "source_id")
    return j.groupBy("feed").agg(F.count("*").alias("n_sources"), F.count_if("direct").alias("n_direct"), F.sum("n").alias("n_rows"))


@register("agg_09_strongest_verdict", """
WITH v AS (SELECT l_partkey AS target, l_orderkey AS decision, CASE l_returnflag WHEN 'R' THEN 4 WHEN 'A' THEN 3 ELSE CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END END AS r FROM lineitem), m AS (SELECT target, max(r) AS r FROM v GROUP BY target)
SELECT v.target, ['keep', 'downgrade', 'revise', 'kill'][m.r] AS verdict, count(DISTINCT decision) AS n_decisions, min(decision) AS first_decision FROM v JOIN m ON v.target = m.target AND v.r = m.r GROUP BY v.target, m.r
""")  # fmt: skip
def agg_09(spark, sf):
    rank = F.when(F.col("l_returnflag") == "R", 4).when(F.col("l_returnflag") == "A", 3).when(F.col("l_linestatus") == "F", 2).otherwise(1)
    v = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_orderkey").alias("decision"), rank.alias("r"))
    by_rank = v.groupBy("target", "r").agg(F.countDistinct("decision").alias("n_decisions"), F.min("decision").alias("first_decision"))
    top = by_rank.groupBy("target").agg(F.max(F.struct("r", "n_decisions", "first_decision")).alias("t"))
    return top.select("target", F.element_at(F.array(*[F.lit(x) for x in VERDICTS]), F.col("t.r")).alias("verdict"), "t.n_decisions", "t.first_decision")


@register("agg_10_breadth", "SELECT provider, count(DISTINCT lower(f)) AS n_families, count(DISTINCT lower(f)) >= 4 AS wide_enough FROM (SELECT provider, unnest(fields_of_study) AS f FROM paper_records) GROUP BY provider")
def agg_10(spark, sf):
    f = table(spark, sf, "paper_records").select("provider", F.explode("fields_of_study").alias("f"))
    n = F.countDistinct(F.lower("f"))
    return f.groupBy("provider").agg(n.alias("n_families"), (n >= 4).alias("wide_enough"))


@register("agg_12_minimum_cap", "SELECT o_custkey AS claim, min(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END) AS cap FROM orders GROUP BY o_custkey")
def agg_12(spark, sf):
    caps = spark.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3)], "o_orderpriority string, level int")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("claim"), "o_orderpriority").join(F.broadcast(caps), "o_orderpriority", "left")
    return o.groupBy("claim").agg(F.min(F.coalesce("level", F.lit(4))).alias("cap"))


@register("agg_13_duplicates", "SELECT parsed_id, chunk_no, count(*) AS n FROM evidence_chunks GROUP BY 1, 2 HAVING count(*) > 1")
def agg_13(spark, sf):
    return table(spark, sf, "evidence_chunks").groupBy("parsed_id", "chunk_no").agg(F.count("*").alias("n")).where("n > 1")


@register("agg_14_exact_cover", "SELECT o_custkey AS lane, list_sort(list(DISTINCT o_orderstatus)) = ['F', 'O', 'P'] AS covered FROM orders GROUP BY o_custkey")
def agg_14(spark, sf):
    want = F.array(*[F.lit(x) for x in ("F", "O", "P")])
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("lane")).agg((F.array_sort(F.collect_set("o_orderstatus")) == want).alias("covered"))


@register("agg_15_missing_outcomes", """
SELECT r.doc_id AS route, t.source_type AS missing FROM (SELECT DISTINCT doc_id FROM evidence_records WHERE doc_id IS NOT NULL) r, (SELECT DISTINCT source_type FROM evidence_records WHERE source_type IS NOT NULL) t
WHERE NOT EXISTS (SELECT 1 FROM evidence_records e WHERE e.doc_id = r.doc_id AND e.source_type = t.source_type)
""")  # fmt: skip
def agg_15(spark, sf):
    """Kinds of evidence that a document lacks, against the vocabulary of all kinds."""
    e = table(spark, sf, "evidence_records")
    every = F.broadcast(e.agg(F.collect_set("source_type").alias("every")))  # one row
    seen = e.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("source_type").alias("seen"))
    return seen.join(every).select(F.col("doc_id").alias("route"), F.explode(F.array_except("every", "seen")).alias("missing"))


@register("agg_16_ledger_rollup", "SELECT user_id, count(*) AS n_requests, count(DISTINCT event_type) AS n_stages, bool_or(event_type = 'error') AS any_error, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def agg_16(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("n_requests"), F.countDistinct("event_type").alias("n_stages"), F.bool_or(F.col("event_type") == "error").alias("any_error"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@register("agg_20_tree_hash", "SELECT parsed_id, sha256(string_agg(chunk_no || ':' || sha256(coalesce(text, '')), chr(10) ORDER BY chunk_no)) AS tree_hash FROM (SELECT parsed_id, chunk_no, min(text) AS text FROM evidence_chunks GROUP BY 1, 2) GROUP BY parsed_id")
def agg_20(spark, sf):
    one = table(spark, sf, "evidence_chunks").groupBy("parsed_id", "chunk_no").agg(F.min("text").alias("text"))
    leaf = F.struct("chunk_no", F.concat(F.col("chunk_no").cast("string"), F.lit(":"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(leaf)), lambda x: x["h"]), "\n")  # hashes of the chunks of one document
    return one.groupBy("parsed_id").agg(F.sha2(lines, 256).alias("tree_hash"))


@register("agg_21_grid_checks", """
WITH g AS (SELECT user_id AS x, event_type AS y, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT x, y FROM (SELECT DISTINCT x FROM g), (SELECT DISTINCT y FROM g))
SELECT count(*) AS cells, count(*) FILTER (g.n > 1) AS repeated, count(*) FILTER (g.n IS NULL) AS missing FROM c LEFT JOIN g USING (x, y)
""")  # fmt: skip
def agg_21(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("x"), F.col("event_type").alias("y")).agg(F.count("*").alias("n"))
    # the full grid is a number, not rows: axis lengths multiplied
    axes = g.agg(F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"), F.count_if(F.col("n") > 1).alias("repeated"), F.count("*").alias("present"))
    return axes.select((F.col("nx") * F.col("ny")).alias("cells"), "repeated", (F.col("nx") * F.col("ny") - F.col("present")).alias("missing"))


@register("agg_22_contiguity", "SELECT parsed_id, min(chunk_no) = 1 AND max(chunk_no) = count(DISTINCT chunk_no) AS contiguous FROM evidence_chunks GROUP BY parsed_id")
def agg_22(spark, sf):
    return table(spark, sf, "evidence_chunks").groupBy("parsed_id").agg(((F.min("chunk_no") == 1) & (F.max("chunk_no") == F.countDistinct("chunk_no"))).alias("contiguous"))


@register("agg_23_multimap", "SELECT doc_id, count(DISTINCT source_id) AS n_sources, array_to_string(list_sort(list(DISTINCT source_type)), ',') AS kinds FROM evidence_records WHERE doc_id IS NOT NULL AND source_type IS NOT NULL GROUP BY doc_id")
def agg_23(spark, sf):
    e = table(spark, sf, "evidence_records").where("doc_id is not null and source_type is not null")
    return e.groupBy("doc_id").agg(F.countDistinct("source_id").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("kinds"))


@register("chk_01_constraint_report", """
SELECT 'duplicate-id' AS check_id, count(*) AS n_violations, CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END AS status FROM (SELECT 1 FROM evidence_chunks GROUP BY parsed_id, chunk_no HAVING count(*) > 1)
UNION ALL SELECT 'blank-cell', count(*), CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END FROM (SELECT record_id, title AS v FROM paper_records UNION ALL SELECT record_id, venue FROM paper_records UNION ALL SELECT record_id, doi FROM paper_records) WHERE trim(coalesce(v, '')) = ''
UNION ALL SELECT 'invalid-enum', count(*), CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'zh', 'de')
UNION ALL SELECT 'invalid-id', count(*), CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END FROM paper_records WHERE doi IS NOT NULL AND NOT regexp_matches(doi, '^10\\.\\d{4,9}/\\S+$')
UNION ALL SELECT 'key-unique', count(*), CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END FROM (SELECT 1 FROM paper_records GROUP BY record_id HAVING count(*) > 1)
""")  # fmt: skip
def chk_01(spark, sf):
    papers, chunks, docs = (table(spark, sf, n) for n in ("paper_records", "evidence_chunks", "documents"))
    parts = [
        ck.unique(chunks, ["parsed_id", "chunk_no"]),
        ck.not_blank(papers, "record_id", ["title", "venue", "doi"]),
        ck.in_vocabulary(docs, "doc_id", "lang", ("en", "zh", "de")),
        ck.matches(papers, "record_id", "doi", r"^10\.\d{4,9}/\S+$"),
        ck.unique(papers, ["record_id"], "key-unique"),
    ]
    return ck.report(parts, ["duplicate-id", "blank-cell", "invalid-enum", "invalid-id", "key-unique"])
