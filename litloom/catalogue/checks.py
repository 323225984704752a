"""Constraints over the tables: every check is a query for the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.catalogue.scalars import SQL_DOI
from litloom.functions import text as fx
from litloom.registry import register
from litloom.runtime import broadcast_if_small, table

PROVIDERS = ("crossref", "europe_pmc", "openalex", "semantic_scholar")
LANGUAGES = ("de", "en", "zh")


def _broken(df: DataFrame, code: str, subject) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject_id") if isinstance(subject, str) else subject.cast("string").alias("subject_id"))


_DIAGNOSTICS = {
    "blank-cell": "SELECT record_id AS s FROM paper_records WHERE trim(coalesce(title, '')) = ''",
    "duplicate-id": "SELECT record_id FROM paper_records GROUP BY record_id HAVING count(*) > 1",
    "duplicate-field": "SELECT parsed_id FROM (SELECT parsed_id, unnest(sections).title AS t FROM parsed_documents) WHERE coalesce(t, '') <> '' GROUP BY parsed_id, t HAVING count(*) > 1",
    "duplicate-reference": "SELECT parsed_id FROM (SELECT parsed_id, unnest(reference_list) AS r FROM parsed_documents) GROUP BY parsed_id, r HAVING count(*) > 1",
    "dangling-reference": "SELECT evidence_id FROM evidence_records WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT parsed_id FROM parsed_documents)",
    "invalid-id": r"SELECT record_id FROM paper_records WHERE coalesce(doi, '') <> '' AND NOT regexp_matches(doi, '10\.\d{4,9}/')",
    "invalid-enum": "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('de', 'en', 'zh')",
    "invalid-counter": "SELECT record_id FROM paper_records WHERE citation_count < 0 OR reference_count < 0",
    "invalid-reference-cell": "SELECT evidence_id FROM evidence_records WHERE page_number < 1",
    "malformed-row": r"SELECT record_id FROM paper_records WHERE publication_date IS NOT NULL AND NOT regexp_matches(publication_date, '\d{4}')",
    "missing-table": "SELECT parsed_id FROM parsed_documents WHERE sections IS NULL",
    "missing-run-field": "SELECT parsed_id FROM parsed_documents WHERE parser_name IS NULL OR parser_version IS NULL",
    "file-unreadable": "SELECT parsed_id FROM parsed_documents WHERE coalesce(text, '') = '' AND coalesce(markdown, '') = ''",
    "self-joint-reference": "SELECT parsed_id FROM parsed_documents WHERE title <> '' AND len(list_filter(coalesce(reference_list, []), lambda r: contains(lower(r), lower(title)))) > 0",
    "duplicate-source-identity": f"SELECT d FROM (SELECT {SQL_DOI.format(c='doi')} AS d FROM paper_records) WHERE d <> '' GROUP BY d HAVING count(*) > 1",
    "duplicate-evidence-relation": "SELECT source_id || '/' || doc_id || '/' || chunk_id FROM evidence_records WHERE source_id IS NOT NULL AND doc_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY source_id, doc_id, chunk_id HAVING count(*) > 1",
    "verified-without-full-read": "SELECT evidence_id FROM evidence_records WHERE direct_evidence AND coalesce(partial, false)",
    "cited-unverified-source": "SELECT evidence_id FROM evidence_records WHERE source_id IS NOT NULL AND NOT coalesce(direct_evidence, false) AND inference IS NULL",
    "cited-without-key": "SELECT evidence_id FROM evidence_records WHERE coalesce(text, '') <> '' AND source_id IS NULL",
    "citation-key-without-citation": "SELECT source_id FROM evidence_sources WHERE source_id NOT IN (SELECT source_id FROM evidence_records WHERE source_id IS NOT NULL)",
    "strong-without-locator": "SELECT evidence_id FROM evidence_records WHERE direct_evidence AND locator IS NULL AND page_number IS NULL",
    "strong-unverified-source": "SELECT evidence_id FROM evidence_records WHERE direct_evidence AND len(coalesce(warnings, [])) > 0",
    "source-count-mismatch": "SELECT doc_id FROM documents WHERE n_chars IS DISTINCT FROM length(text)",
    "main-identity-conflict": f"SELECT g.group_id FROM duplicate_groups g JOIN (SELECT record_id, {SQL_DOI.format(c='doi')} AS d FROM paper_records) p USING (record_id) WHERE d <> '' GROUP BY g.group_id HAVING count(DISTINCT d) > 1",
    "identity-limited": "SELECT record_id FROM paper_records WHERE coalesce(doi, '') || coalesce(pmid, '') || coalesce(pmcid, '') || coalesce(openalex_id, '') || coalesce(semantic_scholar_id, '') || coalesce(arxiv_id, '') = ''",
    "empty-claim-registry": "SELECT parsed_id FROM parsed_documents WHERE parsed_id NOT IN (SELECT parsed_id FROM evidence_chunks)",
    "canonical-owner-mismatch": "SELECT e.evidence_id FROM evidence_records e JOIN evidence_sources s USING (source_id) WHERE e.source_type IS DISTINCT FROM s.source_type",
    "table-columns": "SELECT parsed_id FROM (SELECT parsed_id, unnest(captions) AS c FROM parsed_documents) WHERE coalesce(c.label, '') = '' OR coalesce(c.text, '') = ''",
    "missing-file": "SELECT record_id FROM paper_records WHERE coalesce(is_open_access, false) AND coalesce(url, '') = ''",
    "role-state-missing": "SELECT evidence_id FROM evidence_records WHERE direct_evidence IS NULL",
}


def diagnostics(spark, sf) -> DataFrame:
    """``(code, subject_id)`` of everything that breaks one of thirty checks; ``identity-limited`` is a warning."""
    p, d, e, k = (table(spark, sf, n) for n in ("paper_records", "parsed_documents", "evidence_records", "evidence_chunks"))
    documents, sources, groups = (table(spark, sf, n) for n in ("documents", "evidence_sources", "duplicate_groups"))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    repeated = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    strong = F.coalesce(F.col("direct_evidence"), F.lit(False))
    dois = p.select("record_id", fx.normalize_doi(F.col("doi")).alias("d")).where("d <> ''")
    titled = F.exists(F.coalesce("reference_list", F.array().cast("array<string>")), lambda r: F.contains(F.lower(r), F.lower(F.col("title"))))
    parts = {
        "blank-cell": (p.where(F.trim(none("title")) == ""), "record_id"),
        "duplicate-id": (repeated(p, "record_id"), "record_id"),
        "duplicate-field": (repeated(d.select("parsed_id", F.explode("sections.title").alias("t")).where("t <> ''"), "parsed_id", "t"), "parsed_id"),
        "duplicate-reference": (repeated(d.select("parsed_id", F.explode("reference_list").alias("r")), "parsed_id", "r"), "parsed_id"),
        "dangling-reference": (e.where("doc_id is not null").join(d.select(F.col("parsed_id").alias("doc_id")), "doc_id", "left_anti"), "evidence_id"),
        "invalid-id": (p.where((none("doi") != "") & ~F.col("doi").rlike(r"10\.\d{4,9}/")), "record_id"),
        "invalid-enum": (documents.where(F.col("lang").isNotNull() & ~F.col("lang").isin(*LANGUAGES)), "doc_id"),
        "invalid-counter": (p.where("citation_count < 0 or reference_count < 0"), "record_id"),
        "invalid-reference-cell": (e.where("page_number < 1"), "evidence_id"),
        "malformed-row": (p.where(~F.col("publication_date").rlike(r"\d{4}")), "record_id"),
        "missing-table": (d.where("sections is null"), "parsed_id"),
        "missing-run-field": (d.where("parser_name is null or parser_version is null"), "parsed_id"),
        "file-unreadable": (d.where((none("text") == "") & (none("markdown") == "")), "parsed_id"),
        "self-joint-reference": (d.where((F.col("title") != "") & titled), "parsed_id"),
        "duplicate-source-identity": (repeated(dois, "d"), "d"),
        "duplicate-evidence-relation": (repeated(e.where("source_id is not null and doc_id is not null and chunk_id is not null"), "source_id", "doc_id", "chunk_id"), F.concat_ws("/", "source_id", "doc_id", "chunk_id")),
        "verified-without-full-read": (e.where(strong & F.coalesce("partial", F.lit(False))), "evidence_id"),
        "cited-unverified-source": (e.where(F.col("source_id").isNotNull() & ~strong & F.col("inference").isNull()), "evidence_id"),
        "cited-without-key": (e.where((none("text") != "") & F.col("source_id").isNull()), "evidence_id"),
        "citation-key-without-citation": (sources.join(e.select("source_id"), "source_id", "left_anti"), "source_id"),
        "strong-without-locator": (e.where(strong & F.col("locator").isNull() & F.col("page_number").isNull()), "evidence_id"),
        "strong-unverified-source": (e.where(strong & (F.size("warnings") > 0)), "evidence_id"),
        "source-count-mismatch": (documents.where(~F.col("n_chars").eqNullSafe(F.length("text").cast("bigint"))), "doc_id"),
        "main-identity-conflict": (groups.join(dois, "record_id").groupBy("group_id").agg(F.countDistinct("d").alias("n")).where("n > 1"), "group_id"),
        "identity-limited": (p.where(~fx.has_identifier()), "record_id"),
        "empty-claim-registry": (d.join(k.select("parsed_id"), "parsed_id", "left_anti"), "parsed_id"),
        "canonical-owner-mismatch": (e.join(broadcast_if_small(sources.select("source_id", F.col("source_type").alias("own"))), "source_id").where(~F.col("source_type").eqNullSafe(F.col("own"))), "evidence_id"),
        "table-columns": (d.select("parsed_id", F.explode("captions").alias("c")).where((F.coalesce("c.label", F.lit("")) == "") | (F.coalesce("c.text", F.lit("")) == "")), "parsed_id"),
        "missing-file": (p.where(F.coalesce("is_open_access", F.lit(False)) & (none("url") == "")), "record_id"),
        "role-state-missing": (e.where("direct_evidence is null"), "evidence_id"),
    }
    return reduce(DataFrame.unionByName, [_broken(df, code, subject) for code, (df, subject) in parts.items()])


@register("chk_01_diagnostics", " UNION ALL ".join(f"SELECT '{code}' AS code, CAST(s AS VARCHAR) AS subject_id FROM ({sql}) AS t(s)" for code, sql in _DIAGNOSTICS.items()))
def chk_01_diagnostics(spark, sf):
    """Everything that breaks one of the thirty diagnostic checks."""
    return diagnostics(spark, sf)


@register("agg_07_retrieval_completeness", """
SELECT s.feed, count(e.evidence_id) AS n, CASE WHEN bool_or(coalesce(e.partial, false) OR coalesce(e.truncated, false) OR list_contains(coalesce(e.warnings, []), 'stale-cache')) THEN 'partial' WHEN count(e.evidence_id) > 0 THEN 'bounded' ELSE 'unknown' END AS status
FROM evidence_sources s LEFT JOIN evidence_records e USING (source_id) GROUP BY s.feed
""")  # fmt: skip
def agg_07(spark, sf):
    """Per feed: partial if any request was cut short, bounded if there were requests, else unknown."""
    e = table(spark, sf, "evidence_records").groupBy("source_id").agg(
        F.count("evidence_id").alias("n"),
        F.bool_or(F.coalesce("partial", F.lit(False)) | F.coalesce("truncated", F.lit(False)) | F.coalesce(F.array_contains("warnings", "stale-cache"), F.lit(False))).alias("cut_short"),
    )
    feeds = table(spark, sf, "evidence_sources").select("source_id", "feed").join(e, "source_id", "left").groupBy("feed").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.bool_or("cut_short").alias("cut_short"))
    return feeds.select("feed", "n", F.when(F.coalesce("cut_short", F.lit(False)), "partial").when(F.col("n") > 0, "bounded").otherwise("unknown").alias("status"))


@register("agg_11_gate_fold", """
SELECT source_id, CASE WHEN bool_or(state = 'fail') THEN 'no-go' WHEN bool_or(state = 'unknown') THEN 'defer' WHEN bool_or(state = 'conditional') THEN 'conditional-go' ELSE 'go' END AS overall FROM (
SELECT source_id, CASE WHEN coalesce(truncated, false) THEN 'fail' WHEN direct_evidence IS NULL THEN 'unknown' WHEN coalesce(partial, false) THEN 'conditional' ELSE 'pass' END AS state FROM evidence_records WHERE source_id IS NOT NULL) GROUP BY source_id
""")  # fmt: skip
def agg_11(spark, sf):
    """The verdict over all rows of a source: the worst state decides."""
    e = table(spark, sf, "evidence_records").where("source_id is not null")
    rank = F.when(F.coalesce("truncated", F.lit(False)), 3).when(F.col("direct_evidence").isNull(), 2).when(F.coalesce("partial", F.lit(False)), 1).otherwise(0)
    names = F.array(*[F.lit(x) for x in ("go", "conditional-go", "defer", "no-go")])
    return e.groupBy("source_id").agg(F.max(rank).alias("worst")).select("source_id", F.get(names, F.col("worst")).alias("overall"))


@register("agg_09_all_strongest", """
WITH r AS (SELECT doc_id, evidence_id, CASE WHEN coalesce(truncated, false) THEN 3 WHEN coalesce(partial, false) THEN 2 WHEN direct_evidence IS NULL THEN 1 ELSE 0 END AS v FROM evidence_records WHERE doc_id IS NOT NULL)
SELECT doc_id, evidence_id, v AS verdict FROM r QUALIFY v = max(v) OVER (PARTITION BY doc_id)
""")  # fmt: skip
def agg_09_all(spark, sf):
    """The strongest verdict on each document with every decision that has it: ties are all kept."""
    verdict = F.when(F.coalesce("truncated", F.lit(False)), 3).when(F.coalesce("partial", F.lit(False)), 2).when(F.col("direct_evidence").isNull(), 1).otherwise(0)
    rows = table(spark, sf, "evidence_records").where("doc_id is not null").select("doc_id", "evidence_id", verdict.alias("verdict"))
    top = rows.groupBy("doc_id").agg(F.max("verdict").alias("verdict"))
    return rows.join(top, ["doc_id", "verdict"], "left_semi").select("doc_id", "evidence_id", "verdict")


_REFERENCES_SQL = "SELECT parsed_id, i AS number, r AS entry FROM (SELECT parsed_id, reference_list, unnest(range(1, len(reference_list) + 1)) AS i FROM parsed_documents), LATERAL (SELECT reference_list[i] AS r)"
_CITED_SQL = r"SELECT DISTINCT parsed_id, CAST(n AS BIGINT) AS number FROM (SELECT parsed_id, unnest(regexp_extract_all(coalesce(text, ''), '\[(\d{1,4})\]', 1)) AS n FROM parsed_documents)"


@register("jn_11_citation_closure", f"""
WITH r AS ({_REFERENCES_SQL}), c AS ({_CITED_SQL})
SELECT parsed_id, number, CASE WHEN r.entry IS NULL THEN 'cited-only' WHEN c.number IS NULL THEN 'listed-only' ELSE 'closed' END AS state FROM (SELECT parsed_id, number, entry FROM r) r FULL JOIN c USING (parsed_id, number)
""")  # fmt: skip
def jn_11(spark, sf):
    """Numbers that a text cites against the references it lists: closed, cited only, or listed only."""
    d = table(spark, sf, "parsed_documents")
    listed = d.select("parsed_id", F.posexplode("reference_list").alias("p", "entry")).select("parsed_id", (F.col("p") + 1).cast("bigint").alias("number"), F.lit(True).alias("listed"))
    cited = d.select("parsed_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\[(\d{1,4})\]"), F.lit(1))).alias("n")).select("parsed_id", F.col("n").cast("bigint").alias("number")).distinct().withColumn("cited", F.lit(True))
    state = F.when(F.col("listed").isNull(), "cited-only").when(F.col("cited").isNull(), "listed-only").otherwise("closed")
    return listed.join(cited, ["parsed_id", "number"], "full").select("parsed_id", "number", state.alias("state"))


@register("jn_14_unique_owner", f"""
WITH i AS (SELECT record_id, {SQL_DOI.format(c='doi')} AS d FROM paper_records), q AS (SELECT DISTINCT d, l.shelf FROM (SELECT shelf, {SQL_DOI.format(c='doi')} AS d FROM library_entries) l WHERE d <> '')
SELECT d AS identity, count(DISTINCT shelf) AS owners, count(DISTINCT record_id) AS records, count(DISTINCT shelf) = 1 AS owned_once FROM q LEFT JOIN i USING (d) GROUP BY d
""")  # fmt: skip
def jn_14(spark, sf):
    """Whether each identity on the shelves has exactly one owner, and how many records stand behind it."""
    doi = fx.normalize_doi(F.col("doi")).alias("identity")
    queue = table(spark, sf, "library_entries").select(doi, "shelf").where("identity <> ''")
    owners = queue.groupBy("identity").agg(F.countDistinct("shelf").alias("owners"))
    records = table(spark, sf, "paper_records").select(doi, "record_id").groupBy("identity").agg(F.countDistinct("record_id").alias("records"))
    return owners.join(records, "identity", "left").select("identity", "owners", F.coalesce("records", F.lit(0)).alias("records"), (F.col("owners") == 1).alias("owned_once"))


@register("jn_15_coverage", """
SELECT e.source_type AS lane, count(DISTINCT s.source_id) AS selected, count(DISTINCT e.source_id) AS used, count(DISTINCT e.source_id) FILTER (s.source_id IS NULL) AS outside
FROM (SELECT DISTINCT source_type, source_id FROM evidence_records WHERE source_id IS NOT NULL AND source_type IS NOT NULL) e LEFT JOIN evidence_sources s ON s.source_id = e.source_id AND s.source_type = e.source_type GROUP BY e.source_type
""")  # fmt: skip
def jn_15(spark, sf):
    """Per lane of evidence: sources used, those registered for the lane, and those outside it."""
    used = table(spark, sf, "evidence_records").where("source_id is not null and source_type is not null").select("source_type", "source_id").distinct()
    known = table(spark, sf, "evidence_sources").select("source_type", "source_id").withColumn("known", F.lit(1))
    both = used.join(broadcast_if_small(known), ["source_type", "source_id"], "left")
    return both.groupBy(F.col("source_type").alias("lane")).agg(F.count("known").alias("selected"), F.count("*").alias("used"), F.count_if(F.col("known").isNull()).alias("outside"))


@register("jn_19_projection_equality", """
SELECT coalesce(a.parsed_id, b.parsed_id) AS parsed_id, a.parsed_id IS NOT NULL AND b.parsed_id IS NOT NULL AND a.n IS NOT DISTINCT FROM b.n AND a.kind IS NOT DISTINCT FROM b.kind AS equal FROM (SELECT parsed_id, CAST(len(sections) AS BIGINT) AS n, source_type AS kind FROM parsed_documents) a
FULL JOIN (SELECT parsed_id, count(DISTINCT locator) AS n, min(source_type) AS kind FROM evidence_chunks GROUP BY parsed_id) b ON a.parsed_id = b.parsed_id
""")  # fmt: skip
def jn_19(spark, sf):
    """Whether what the chunks say of a document (sections, kind) equals what the document says."""
    a = table(spark, sf, "parsed_documents").select("parsed_id", F.when(F.col("sections").isNotNull(), F.size("sections")).cast("bigint").alias("n"), F.col("source_type").alias("kind"))
    b = table(spark, sf, "evidence_chunks").groupBy("parsed_id").agg(F.countDistinct("locator").alias("m"), F.min("source_type").alias("other"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "parsed_id", "full")
    return both.select("parsed_id", (F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & F.col("n").eqNullSafe(F.col("m")) & F.col("kind").eqNullSafe(F.col("other"))).alias("equal"))


@register("jn_22_audit_projection", """
SELECT 'missing' AS state, chunk_id, count(*) AS n FROM (SELECT DISTINCT doc_id, chunk_id FROM evidence_records WHERE chunk_id IS NOT NULL AND doc_id IS NOT NULL EXCEPT SELECT parsed_id, 'chunk-' || chunk_no FROM evidence_chunks) GROUP BY chunk_id
UNION ALL SELECT 'unused', chunk_id, count(*) FROM (SELECT parsed_id, 'chunk-' || chunk_no AS chunk_id FROM evidence_chunks EXCEPT SELECT doc_id, chunk_id FROM evidence_records WHERE chunk_id IS NOT NULL AND doc_id IS NOT NULL) GROUP BY chunk_id
""")  # fmt: skip
def jn_22(spark, sf):
    """Chunks that evidence names and that are not there, and chunks that no evidence names, by number."""
    used = table(spark, sf, "evidence_records").where("chunk_id is not null and doc_id is not null").select("doc_id", "chunk_id").distinct()
    there = table(spark, sf, "evidence_chunks").select(F.col("parsed_id").alias("doc_id"), F.concat(F.lit("chunk-"), F.col("chunk_no").cast("string")).alias("chunk_id")).distinct()
    count = lambda df, state: df.groupBy("chunk_id").agg(F.count("*").alias("n")).select(F.lit(state).alias("state"), "chunk_id", "n")
    return count(used.join(there, ["doc_id", "chunk_id"], "left_anti"), "missing").unionByName(count(there.join(used, ["doc_id", "chunk_id"], "left_anti"), "unused"))


@register("jn_23_ordered_projection", """
SELECT parsed_id, list_position(list_transform(range(1, greatest(len(t), len(l)) + 1), lambda i: t[i] IS NOT DISTINCT FROM l[i]), false) AS first_difference FROM (SELECT parsed_id, list_transform(coalesce(sections, []), lambda s: s.title) AS t,
  coalesce((SELECT list(DISTINCT locator ORDER BY locator) FROM evidence_chunks e WHERE e.parsed_id = d.parsed_id AND locator IS NOT NULL), []) AS l FROM parsed_documents d) WHERE t <> l
""")  # fmt: skip
def jn_23(spark, sf):
    """Documents whose section titles are not, in this order, the places of their chunks, and where the first difference is."""
    d = table(spark, sf, "parsed_documents").select("parsed_id", F.coalesce("sections.title", F.array().cast("array<string>")).alias("t"))
    places = table(spark, sf, "evidence_chunks").where("locator is not null").groupBy("parsed_id").agg(F.array_sort(F.collect_set("locator")).alias("l"))  # the places of one document
    both = d.join(places, "parsed_id", "left").select("parsed_id", "t", F.coalesce("l", F.array().cast("array<string>")).alias("l")).where("not (t <=> l)")
    differs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("t"), F.size("l")) - 1), lambda i: ~F.get("t", i).eqNullSafe(F.get("l", i)))
    return both.select("parsed_id", F.array_position(differs, True).cast("int").alias("first_difference"))


@register("jn_25_registry_keys", """
SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'unregistered' WHEN b.k IS NULL THEN 'unused' ELSE 'both' END AS state FROM (SELECT DISTINCT lower(name) AS k FROM venue_list) a FULL JOIN (SELECT DISTINCT lower(trim(venue)) AS k FROM library_entries WHERE venue IS NOT NULL) b ON a.k = b.k
""")  # fmt: skip
def jn_25(spark, sf):
    """Keys of a registry against those that entries use."""
    a = table(spark, sf, "venue_list").select(F.lower("name").alias("key")).distinct().withColumn("a", F.lit(1))
    b = table(spark, sf, "library_entries").where("venue is not null").select(F.lower(F.trim("venue")).alias("key")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "key", "full").select("key", F.when(F.col("a").isNull(), "unregistered").when(F.col("b").isNull(), "unused").otherwise("both").alias("state"))


@register("jn_29_bundle_hashes", """
SELECT parsed_id, chunk_no, CASE WHEN bool_or(content_hash IS NULL) AND NOT bool_or(content_hash IS NOT NULL) THEN 'unrecorded' WHEN bool_and(content_hash IS NULL OR content_hash = sha256(text)) THEN 'intact' ELSE 'changed' END AS state FROM evidence_chunks GROUP BY parsed_id, chunk_no
""")  # fmt: skip
def jn_29(spark, sf):
    """Whether the text of each chunk has the hash that is recorded for it."""
    recorded, fits = F.col("content_hash").isNotNull(), F.col("content_hash") == F.sha2("text", 256)
    k = table(spark, sf, "evidence_chunks").groupBy("parsed_id", "chunk_no").agg(F.bool_or(recorded).alias("r"), F.bool_and(~recorded | fits).alias("f"))
    return k.select("parsed_id", "chunk_no", F.when(~F.col("r"), "unrecorded").when(F.coalesce("f", F.lit(True)), "intact").otherwise("changed").alias("state"))


@register("grid_07_plot_data", """
SELECT 'null' AS problem, 'quantity' AS field, count(*) FILTER (l_quantity IS NULL) AS n FROM lineitem UNION ALL SELECT 'null', 'price', count(*) FILTER (l_extendedprice IS NULL) FROM lineitem
UNION ALL SELECT 'not-finite', 'price', count(*) FILTER (isnan(l_extendedprice::DOUBLE) OR isinf(l_extendedprice::DOUBLE)) FROM lineitem UNION ALL SELECT 'error-bar', 'price', count(*) FILTER (l_extendedprice * (1 - l_discount) > l_extendedprice) FROM lineitem
UNION ALL SELECT 'duplicate', 'key', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
""")  # fmt: skip
def grid_07(spark, sf):
    """What would make a table unfit for a plot: nulls, numbers that are not finite, bounds on the wrong side, repeated keys."""
    li = table(spark, sf, "lineitem")
    price = F.col("l_extendedprice").cast("double")
    counts = li.agg(
        F.count_if(F.col("l_quantity").isNull()).alias("a"), F.count_if(price.isNull()).alias("b"), F.count_if(F.isnan(price) | F.abs(price).isin(float("inf"))).alias("c"),
        F.count_if(F.col("l_extendedprice") * (1 - F.col("l_discount")) > F.col("l_extendedprice")).alias("d"),
    )
    named = (("null", "quantity", "a"), ("null", "price", "b"), ("not-finite", "price", "c"), ("error-bar", "price", "d"))
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("problem"), F.lit(f).alias("field"), F.col(c).alias("n")) for p, f, c in named])).alias("x")).select("x.*")
    repeated = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    return rows.unionByName(repeated.select(F.lit("duplicate").alias("problem"), F.lit("key").alias("field"), "n"))


@register("ord_07_contiguous_ranks", """
SELECT parsed_id, min(chunk_no) = 1 AND max(chunk_no) = count(DISTINCT chunk_no) AS contiguous, count(*) = count(DISTINCT chunk_no) AS unique_numbers FROM evidence_chunks GROUP BY parsed_id
""")  # fmt: skip
def ord_07(spark, sf):
    """Whether the chunks of a document are numbered 1 to n, and each number once."""
    k = table(spark, sf, "evidence_chunks").groupBy("parsed_id").agg(F.min("chunk_no").alias("a"), F.max("chunk_no").alias("b"), F.countDistinct("chunk_no").alias("d"), F.count("*").alias("n"))
    return k.select("parsed_id", ((F.col("a") == 1) & (F.col("b") == F.col("d"))).alias("contiguous"), (F.col("n") == F.col("d")).alias("unique_numbers"))


@register("chk_19_budget_drift", """
SELECT provider, planned, actual, actual - planned AS drift FROM (SELECT p.provider, count(*) AS actual, CASE p.provider WHEN 'openalex' THEN 4 WHEN 'crossref' THEN 3 WHEN 'semantic_scholar' THEN 2 WHEN 'europe_pmc' THEN 3 ELSE 0 END AS planned
FROM (SELECT DISTINCT provider, CAST(retrieved_at AS DATE) AS day FROM paper_records WHERE provider IS NOT NULL AND retrieved_at IS NOT NULL) p GROUP BY p.provider)
""")  # fmt: skip
def chk_19(spark, sf):
    """Days on which each provider was asked against the number planned for it."""
    from litloom.plans.lexicon import PROVIDER_BUDGETS

    planned = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in PROVIDER_BUDGETS.items() for x in pair]), F.col("provider")), F.lit(0))
    days = table(spark, sf, "paper_records").where("provider is not null and retrieved_at is not null").select("provider", F.to_date("retrieved_at").alias("day")).distinct()
    return days.groupBy("provider").agg(F.count("*").alias("actual")).select("provider", planned.alias("planned"), "actual", (F.col("actual") - planned).alias("drift"))


@register("chk_16_ranges", """
SELECT check_id, count(*) FILTER (broken) AS n FROM (SELECT 'year' AS check_id, year IS NOT NULL AND NOT year BETWEEN 1900 AND 2030 AS broken FROM paper_records UNION ALL SELECT 'discount', NOT l_discount BETWEEN 0 AND 1 FROM lineitem
UNION ALL SELECT 'max_size', max_size <= 0 OR overlap < 0 OR overlap >= max_size FROM size_limits UNION ALL SELECT 'provider', provider IS NOT NULL AND provider NOT IN ('crossref', 'europe_pmc', 'openalex', 'semantic_scholar') FROM paper_records) GROUP BY check_id
""")  # fmt: skip
def chk_16(spark, sf):
    """Values outside their range or vocabulary, per check."""
    p = table(spark, sf, "paper_records")
    parts = {
        "year": p.select((F.col("year").isNotNull() & ~F.col("year").between(1900, 2030)).alias("broken")),
        "discount": table(spark, sf, "lineitem").select((~F.col("l_discount").between(0, 1)).alias("broken")),
        "max_size": table(spark, sf, "size_limits").select(F.expr("max_size <= 0 or overlap < 0 or overlap >= max_size").alias("broken")),
        "provider": p.select((F.col("provider").isNotNull() & ~F.col("provider").isin(*PROVIDERS)).alias("broken")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check_id"), "broken") for name, df in parts.items()]).groupBy("check_id").agg(F.count_if("broken").alias("n"))


@register("snk_12_severity_report", """
SELECT severity, count(*) AS n, count(DISTINCT code) AS codes FROM (SELECT code, CASE WHEN code = 'identity-limited' THEN 'warning' ELSE 'error' END AS severity FROM (DIAGNOSTICS)) GROUP BY severity
""".replace("DIAGNOSTICS", " UNION ALL ".join(f"SELECT '{code}' AS code FROM ({sql})" for code, sql in _DIAGNOSTICS.items())))  # fmt: skip
def snk_12_severity(spark, sf):
    """Errors and warnings of all diagnostics, and how many checks they come from."""
    severity = F.when(F.col("code") == "identity-limited", "warning").otherwise("error").alias("severity")
    return diagnostics(spark, sf).groupBy(severity).agg(F.count("*").alias("n"), F.countDistinct("code").alias("codes"))


