"""Joins, closure checks and set operations as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.operators import constraints as ck
from litloom.operators.graph import connected_components
from litloom.registry import register
from litloom.runtime import broadcast_if_small, table


@register("jn_03_open_access_enrichment", """
WITH ranked AS (SELECT record_id, lower(doi) AS doi, row_number() OVER (ORDER BY coalesce(citation_count, 0) DESC, record_id) AS rn FROM paper_records),
oa AS (SELECT lower(doi) AS doi, bool_or(coalesce(is_open_access, false)) AS is_oa FROM paper_records WHERE coalesce(doi, '') <> '' GROUP BY lower(doi))
SELECT record_id, oa.is_oa FROM ranked LEFT JOIN oa ON ranked.doi = oa.doi AND ranked.doi <> '' WHERE rn <= 60
""")  # fmt: skip
def jn_03(spark, sf):
    """The first 60 records by citations, each with the open-access state known for its DOI."""
    papers = table(spark, sf, "paper_records").select("record_id", F.lower("doi").alias("doi"), "citation_count", "is_open_access")
    top = papers.orderBy(F.coalesce("citation_count", F.lit(0)).desc(), "record_id").limit(60).select("record_id", "doi")
    oa = papers.where("doi <> ''").groupBy("doi").agg(F.bool_or(F.coalesce("is_open_access", F.lit(False))).alias("is_oa"))
    return oa.join(F.broadcast(top), "doi", "right").select("record_id", "is_oa")


@register("jn_04_venue_lookup", "SELECT record_id, v.venue_id FROM paper_records p LEFT JOIN (SELECT lower(trim(name)) AS k, min(venue_id) AS venue_id FROM venue_list GROUP BY 1) v ON lower(trim(p.venue)) = v.k")
def jn_04(spark, sf):
    """Venue of each record by its folded name, null where none is listed."""
    venues = table(spark, sf, "venue_list").groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("venue_id").alias("venue_id"))
    papers = table(spark, sf, "paper_records").select("record_id", F.lower(F.trim("venue")).alias("k"))
    return papers.join(broadcast_if_small(venues), "k", "left").select("record_id", "venue_id")


@register("jn_05_scores_with_defaults", """
SELECT p.record_id, coalesce(s.score, 0.5) AS score FROM paper_records p
LEFT JOIN (SELECT record_id, round(avg(length(text)) / 1000.0, 6) AS score FROM documents WHERE record_id IS NOT NULL GROUP BY record_id) s USING (record_id)
""")  # fmt: skip
def jn_05(spark, sf):
    scores = table(spark, sf, "documents").where("record_id is not null").groupBy("record_id").agg(F.round(F.avg(F.length("text")) / 1000.0, 6).alias("score"))
    return table(spark, sf, "paper_records").select("record_id").join(scores, "record_id", "left").select("record_id", F.coalesce("score", F.lit(0.5)).alias("score"))


@register("jn_06_dangling_references", """
SELECT 'evidence_records' AS relation, CAST(evidence_id AS VARCHAR) AS subject_id, CAST(doc_id AS VARCHAR) AS missing_id FROM evidence_records WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT parsed_id FROM parsed_documents)
UNION ALL SELECT 'parsed_documents', CAST(parsed_id AS VARCHAR), CAST(record_id AS VARCHAR) FROM parsed_documents WHERE record_id IS NOT NULL AND record_id NOT IN (SELECT record_id FROM paper_records)
UNION ALL SELECT 'evidence_records', CAST(evidence_id AS VARCHAR), source_id FROM evidence_records WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM evidence_sources)
UNION ALL SELECT 'library_entries', CAST(entry_id AS VARCHAR), venue FROM library_entries WHERE venue IS NOT NULL AND venue NOT IN (SELECT name FROM venue_list)
""")  # fmt: skip
def jn_06(spark, sf):
    """References without a target: documents, records, sources, and typed venues that are not on the list."""
    evidence, parsed = table(spark, sf, "evidence_records"), table(spark, sf, "parsed_documents")
    some = table(spark, sf, "evidence_sources")
    parts = [
        ck.dangling(evidence, "evidence_id", "doc_id", parsed, "parsed_id", "evidence_records"),
        ck.dangling(parsed, "parsed_id", "record_id", table(spark, sf, "paper_records"), "record_id", "parsed_documents"),
        ck.dangling(evidence, "evidence_id", "source_id", some, "source_id", "evidence_records"),
        ck.dangling(table(spark, sf, "library_entries"), "entry_id", "venue", table(spark, sf, "venue_list"), "name", "library_entries"),
    ]
    return reduce(DataFrame.unionByName, parts)


@register("jn_08_artifact_projection", """
SELECT coalesce(d.doc_id, p.parsed_id) AS artifact, CASE WHEN p.parsed_id IS NULL THEN 'declared-missing' WHEN d.doc_id IS NULL THEN 'observed-undeclared' ELSE 'declared-present' END AS state
FROM (SELECT DISTINCT doc_id FROM evidence_records WHERE doc_id IS NOT NULL) d FULL OUTER JOIN (SELECT parsed_id FROM parsed_documents) p ON d.doc_id = p.parsed_id
""")  # fmt: skip
def jn_08(spark, sf):
    declared = table(spark, sf, "evidence_records").where("doc_id is not null").select(F.col("doc_id").alias("key")).distinct()
    observed = table(spark, sf, "parsed_documents").select(F.col("parsed_id").alias("key"))
    return ck.projection(declared, observed, "key").select(F.col("key").alias("artifact"), "state")


@register("jn_09_id_closure", """
WITH d AS (SELECT source_id AS id, count(*) AS n_def FROM evidence_sources GROUP BY 1), o AS (SELECT source_id AS id, count(*) AS n_use FROM evidence_records WHERE source_id IS NOT NULL GROUP BY 1)
SELECT coalesce(d.id, o.id) AS id, CASE WHEN coalesce(n_def, 0) > 1 THEN 'duplicate' WHEN n_def IS NULL THEN 'dangling' WHEN n_use IS NULL THEN 'unreferenced' ELSE 'closed' END AS state FROM d FULL OUTER JOIN o ON d.id = o.id
""")  # fmt: skip
def jn_09(spark, sf):
    return ck.id_closure(table(spark, sf, "evidence_sources").select(F.col("source_id").alias("id")), table(spark, sf, "evidence_records").select(F.col("source_id").alias("id")))


@register("jn_10_citation_projection", """
WITH r AS (SELECT record_id, lower(doi) AS doi FROM paper_records WHERE coalesce(doi, '') <> ''), e AS (SELECT lower(doi) AS doi, count(*) AS n FROM evidence_records WHERE coalesce(doi, '') <> '' GROUP BY 1)
SELECT CAST(r.record_id AS VARCHAR) AS reference, r.doi, coalesce(e.n, 0) AS n_evidence, CASE WHEN e.n IS NULL THEN 'unused' WHEN e.n = 1 THEN 'matched' ELSE 'ambiguous' END AS state FROM r LEFT JOIN e ON r.doi = e.doi
UNION ALL SELECT '' AS reference, e.doi, e.n, 'body-only' FROM e WHERE e.doi NOT IN (SELECT doi FROM r)
""")  # fmt: skip
def jn_10(spark, sf):
    r = table(spark, sf, "paper_records").where("coalesce(doi, '') <> ''").select("record_id", F.lower("doi").alias("doi"))
    e = table(spark, sf, "evidence_records").where("coalesce(doi, '') <> ''").groupBy(F.lower("doi").alias("doi")).agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "unused").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    matched = r.join(e, "doi", "left").select(F.col("record_id").cast("string").alias("reference"), "doi", F.coalesce("n", F.lit(0)).alias("n_evidence"), state.alias("state"))
    body_only = e.join(r, "doi", "left_anti").select(F.lit("").alias("reference"), "doi", F.col("n").alias("n_evidence"), F.lit("body-only").alias("state"))
    return matched.unionByName(body_only)


@register("jn_12_bidirectional_edges", """
WITH a AS (SELECT DISTINCT doc_id AS x, source_id AS y FROM evidence_records WHERE doc_id IS NOT NULL AND coalesce(partial, false) = false),
b AS (SELECT DISTINCT doc_id AS x, source_id AS y FROM evidence_records WHERE doc_id IS NOT NULL AND coalesce(direct_evidence, false))
SELECT x AS doc_id, y AS source_id, 'missing-back-link' AS problem FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.x = a.x AND b.y = a.y)
UNION ALL SELECT x, y, 'missing-forward-link' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.x = a.x AND b.y = a.y)
""")  # fmt: skip
def jn_12(spark, sf):
    edges = table(spark, sf, "evidence_records").where("doc_id is not null")
    a = edges.where("not coalesce(partial, false)").select("doc_id", "source_id").distinct()
    b = edges.where("coalesce(direct_evidence, false)").select("doc_id", "source_id").distinct()
    back = a.join(b, ["doc_id", "source_id"], "left_anti").withColumn("problem", F.lit("missing-back-link"))
    return back.unionByName(b.join(a, ["doc_id", "source_id"], "left_anti").withColumn("problem", F.lit("missing-forward-link")))


@register("jn_18_same_keys_in_tables", """
WITH u AS (SELECT parsed_id AS k, 'documents' AS t FROM parsed_documents UNION ALL SELECT parsed_id, 'chunks' FROM evidence_chunks UNION ALL SELECT doc_id, 'evidence' FROM evidence_records WHERE doc_id IS NOT NULL)
SELECT k AS parsed_id, count(DISTINCT t) AS n_tables, bool_or(t = 'documents') AS in_documents, bool_or(t = 'chunks') AS in_chunks, bool_or(t = 'evidence') AS in_evidence FROM u GROUP BY k HAVING count(DISTINCT t) < 3
""")  # fmt: skip
def jn_18(spark, sf):
    parts = {
        "documents": table(spark, sf, "parsed_documents").select(F.col("parsed_id").alias("k")),
        "chunks": table(spark, sf, "evidence_chunks").select(F.col("parsed_id").alias("k")),
        "evidence": table(spark, sf, "evidence_records").where("doc_id is not null").select(F.col("doc_id").alias("k")),
    }
    return ck.key_presence(parts, "k").where("n_tables < 3").withColumnRenamed("k", "parsed_id")


@register("jn_24_cross_table_identity", "SELECT p.record_id, l.entry_id FROM (SELECT record_id, lower(regexp_extract(doi, '10\\.\\d{4,9}/\\S*[^\\s.]')) AS d FROM paper_records) p JOIN (SELECT entry_id, lower(regexp_extract(doi, '10\\.\\d{4,9}/\\S*[^\\s.]')) AS d FROM library_entries) l ON p.d = l.d AND p.d <> ''")
def jn_24(spark, sf):
    doi = F.lower(F.regexp_extract("doi", r"10\.\d{4,9}/\S*[^\s.]", 0)).alias("d")
    p, e = table(spark, sf, "paper_records").select("record_id", doi), table(spark, sf, "library_entries").select("entry_id", doi)
    return p.join(e.where("d <> ''"), "d").select("record_id", "entry_id")


@register("jn_27_hash_drift", "SELECT c.parsed_id, c.chunk_no, CASE WHEN content_hash IS NULL THEN 'unrecorded' WHEN content_hash = sha256(text) THEN 'same' ELSE 'drift' END AS state FROM (SELECT DISTINCT parsed_id, chunk_no, content_hash, text FROM evidence_chunks) c")
def jn_27(spark, sf):
    chunks = table(spark, sf, "evidence_chunks").select("parsed_id", "chunk_no", "content_hash", "text").distinct()
    state = F.when(F.col("content_hash").isNull(), "unrecorded").when(F.col("content_hash") == F.sha2("text", 256), "same").otherwise("drift")
    return chunks.select("parsed_id", "chunk_no", state.alias("state"))


@register("jn_28_snapshot_diff", """
WITH a AS (SELECT lower(doi) AS doi, min(title) AS h FROM paper_records WHERE provider = 'crossref' AND coalesce(doi, '') <> '' GROUP BY 1), b AS (SELECT lower(doi) AS doi, min(title) AS h FROM paper_records WHERE provider = 'openalex' AND coalesce(doi, '') <> '' GROUP BY 1)
SELECT coalesce(a.doi, b.doi) AS doi, CASE WHEN b.doi IS NULL THEN 'removed' WHEN a.doi IS NULL THEN 'added' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'same' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.doi = b.doi
""")  # fmt: skip
def jn_28(spark, sf):
    """What one provider's view of the DOIs changes against another's."""
    p = table(spark, sf, "paper_records").where("coalesce(doi, '') <> ''").select("provider", F.lower("doi").alias("doi"), "title")
    view = lambda name: p.where(F.col("provider") == name).groupBy("doi").agg(F.min("title").alias("h"))
    return ck.snapshot_diff(view("crossref"), view("openalex"), "doi", "h")


@register("jn_30_one_hop", """
WITH e AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supp FROM lineitem), seed AS (SELECT supp FROM e WHERE part = 1)
SELECT DISTINCT e.part AS neighbour FROM e JOIN seed USING (supp) WHERE e.part <> 1
""")  # fmt: skip
def jn_30(spark, sf):
    """Neighbours of a seed over one shared node."""
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    seed = edges.where("part = 1").select("supp").distinct()
    return edges.join(broadcast_if_small(seed), "supp", "left_semi").where("part <> 1").select(F.col("part").alias("neighbour")).distinct()


@register("jn_31_evidence_chains", """
WITH RECURSIVE edges AS (SELECT DISTINCT 's' || source_id AS a, 'd' || doc_id AS b FROM evidence_records WHERE doc_id IS NOT NULL AND source_id IS NOT NULL), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT a AS node, min(b) AS chain FROM reach GROUP BY a
""")  # fmt: skip
def jn_31(spark, sf):
    """Chains of evidence: sources that share a document, directly or over others."""
    e = table(spark, sf, "evidence_records").where("doc_id is not null")
    edges = e.select(F.concat(F.lit("s"), "source_id").alias("src"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("dst")).distinct()
    return connected_components(edges).select("node", F.col("component").alias("chain"))


@register("set_01_bag_union", "SELECT provider, count(*) AS n FROM (SELECT provider FROM paper_records UNION ALL SELECT p.provider FROM (SELECT unnest(provenance, recursive := false) AS p FROM paper_records)) GROUP BY provider")
def set_01(spark, sf):
    p = table(spark, sf, "paper_records")
    both = p.select("provider").unionByName(p.select(F.explode("provenance.provider").alias("provider")))
    return both.groupBy("provider").agg(F.count("*").alias("n"))


@register("set_02_caseless_union", "SELECT k AS keyword, min(v) AS spelling FROM (SELECT lower(trim(v)) AS k, v FROM (SELECT unnest(list_concat(coalesce(keywords, []), coalesce(fields_of_study, []))) AS v FROM paper_records)) WHERE k <> '' GROUP BY k")
def set_02(spark, sf):
    empty = F.array().cast("array<string>")
    v = table(spark, sf, "paper_records").select(F.explode(F.concat(F.coalesce("keywords", empty), F.coalesce("fields_of_study", empty))).alias("v"))
    return v.where("trim(v) <> ''").groupBy(F.lower(F.trim("v")).alias("keyword")).agg(F.min("v").alias("spelling"))


@register("set_03_difference", "SELECT DISTINCT doc_id FROM evidence_records WHERE doc_id IS NOT NULL EXCEPT SELECT record_id FROM parsed_documents WHERE record_id IS NOT NULL")
def set_03(spark, sf):
    used = table(spark, sf, "evidence_records").where("doc_id is not null").select("doc_id")
    return used.subtract(table(spark, sf, "parsed_documents").where("record_id is not null").select("record_id"))


@register("set_04_symmetric_difference", "SELECT k, 'left' AS side FROM (SELECT venue AS k FROM paper_records WHERE venue IS NOT NULL EXCEPT SELECT venue FROM library_entries) UNION ALL SELECT k, 'right' FROM (SELECT venue AS k FROM library_entries WHERE venue IS NOT NULL EXCEPT SELECT venue FROM paper_records)")
def set_04(spark, sf):
    a = table(spark, sf, "paper_records").where("venue is not null").select(F.col("venue").alias("k")).distinct()
    b = table(spark, sf, "library_entries").where("venue is not null").select(F.col("venue").alias("k")).distinct()
    return a.join(b, "k", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "k", "left_anti").withColumn("side", F.lit("right")))


@register("set_05_intersection", "SELECT name FROM venue_list INTERSECT SELECT venue FROM paper_records")
def set_05(spark, sf):
    return table(spark, sf, "venue_list").select("name").intersect(table(spark, sf, "paper_records").select("venue"))
