"""Smaller operators: excerpts, spellings, legacy references, layered settings, edges, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litloom.catalogue.scalars import SQL_DOI, SQL_FINDINGS, SQL_PREPRINT, SQL_QUALITY
from litloom.functions import text as fx
from litloom.operators.resolve import TRUST
from litloom.registry import register
from litloom.runtime import broadcast_if_small, table


@register("hlp_02_supporting_excerpts", """
WITH c AS (SELECT d.record_id, count(*) AS n FROM parsed_documents d JOIN evidence_chunks e USING (parsed_id) WHERE d.record_id IS NOT NULL AND trim(coalesce(e.text, '')) <> '' GROUP BY d.record_id)
SELECT record_id, CASE WHEN n > 0 THEN 'chunks' WHEN trim(coalesce(abstract, '')) <> '' THEN 'abstract' ELSE 'none' END AS origin, CASE WHEN n > 0 THEN least(n, 10) WHEN trim(coalesce(abstract, '')) <> '' THEN 1 ELSE 0 END AS n_excerpts FROM paper_records LEFT JOIN c USING (record_id)
""")  # fmt: skip
def hlp_02(spark, sf):
    """What supports a record: up to ten chunks of its documents, else its abstract."""
    chunks = table(spark, sf, "evidence_chunks").where("trim(text) <> ''").select("parsed_id")
    counts = table(spark, sf, "parsed_documents").where("record_id is not null").select("parsed_id", "record_id").join(chunks, "parsed_id").groupBy("record_id").agg(F.count("*").alias("n"))
    p = table(spark, sf, "paper_records").select("record_id", (F.trim(F.coalesce("abstract", F.lit(""))) != "").alias("a")).join(counts, "record_id", "left")
    return p.select(
        "record_id",
        F.when(F.col("n") > 0, "chunks").when(F.col("a"), "abstract").otherwise("none").alias("origin"),
        F.when(F.col("n") > 0, F.least("n", F.lit(10))).when(F.col("a"), 1).otherwise(0).alias("n_excerpts"),
    )


@register("hlp_03_distinct_strings", "SELECT record_id, array_to_string(list_filter(t, lambda x, i: x <> '' AND list_position(t, x) = i), '|') AS fields FROM (SELECT record_id, list_transform(list_concat(coalesce(fields_of_study, []), coalesce(keywords, [])), lambda x: trim(x)) AS t FROM paper_records)")
def hlp_03(spark, sf):
    """Fields and keywords, trimmed, each spelling once."""
    none = F.array().cast("array<string>")
    t = F.array_distinct(F.transform(F.concat(F.coalesce("fields_of_study", none), F.coalesce("keywords", none)), lambda x: F.trim(x)))
    return table(spark, sf, "paper_records").select("record_id", F.array_join(F.filter(t, lambda x: x != ""), "|").alias("fields"))


@register("hlp_18_body_citations", r"""
SELECT parsed_id, CAST(n AS BIGINT) AS number FROM (SELECT DISTINCT parsed_id, unnest(regexp_extract_all(string_split_regex(coalesce(text, ''), '\n(References|Literatur|参考文献)\s*\n')[1], '\[(\d{1,4})\]', 1)) AS n FROM parsed_documents)
""")  # fmt: skip
def hlp_18(spark, sf):
    """Numbers that the body of a text cites, before its list of references."""
    body = F.split(F.coalesce("text", F.lit("")), r"\n(References|Literatur|参考文献)\s*\n")[0]
    numbers = table(spark, sf, "parsed_documents").select("parsed_id", F.explode(F.regexp_extract_all(body, F.lit(r"\[(\d{1,4})\]"), F.lit(1))).alias("n"))
    return numbers.distinct().select("parsed_id", F.col("n").cast("bigint").alias("number"))


@register("hlp_20_ids_by_class", r"""
SELECT string_split(i, '-')[1] AS class, string_agg(DISTINCT i, ',' ORDER BY i) AS ids FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\b[A-Z]{2,4}-\d{1,3}\b')) AS i FROM parsed_documents) GROUP BY 1
""")  # fmt: skip
def hlp_20(spark, sf):
    """Short typed ids of all parsed texts by their class, sorted."""
    ids = table(spark, sf, "parsed_documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b[A-Z]{2,4}-\d{1,3}\b"), F.lit(0))).alias("i")).distinct()
    return ids.groupBy(F.split("i", "-")[0].alias("class")).agg(F.array_join(F.array_sort(F.collect_list("i")), ",").alias("ids"))  # at most a thousand ids a prefix


@register("hlp_23_active_codes", "SELECT evidence_id, CASE WHEN len(coalesce(warnings, [])) = 0 THEN 'none' ELSE array_to_string(list_sort(list_distinct(warnings)), ',') END AS codes FROM evidence_records")
def hlp_23(spark, sf):
    """The codes of each evidence row, or none."""
    none = F.coalesce(F.size("warnings"), F.lit(0)) <= 0
    return table(spark, sf, "evidence_records").select("evidence_id", F.when(none, "none").otherwise(F.array_join(F.array_sort(F.array_distinct("warnings")), ",")).alias("codes"))


_TRUST_ROWS = [(field, provider, len(order) - k) for field, order in TRUST.items() for k, provider in enumerate(order)]
_TRUST_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field, '{p}' AS provider, {n} AS trust" for f, p, n in _TRUST_ROWS)


@register("hlp_31_provider_trust", f"WITH t AS ({_TRUST_SQL}), f AS (SELECT DISTINCT field FROM t), p AS (SELECT DISTINCT provider FROM paper_records WHERE provider IS NOT NULL) SELECT field, provider, coalesce(trust, 0) AS trust FROM f CROSS JOIN p LEFT JOIN t USING (field, provider)")
def hlp_31(spark, sf):
    """How much each provider of the records is trusted for each field; 0 where it is not listed."""
    trust = spark.createDataFrame(_TRUST_ROWS, "field string, provider string, trust int")
    fields = F.array(*[F.lit(f) for f in TRUST])
    pairs = table(spark, sf, "paper_records").where("provider is not null").select("provider").distinct().select(F.explode(fields).alias("field"), "provider")
    return pairs.join(F.broadcast(trust), ["field", "provider"], "left").select("field", "provider", F.coalesce("trust", F.lit(0)).alias("trust"))


@register("src_12_one_hop", "SELECT l_partkey AS node, l_suppkey AS neighbour FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) <= 100")
def src_12(spark, sf):
    """Up to a hundred neighbours of every node of the graph of parts and suppliers, in order."""
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("neighbour")).distinct()
    n = F.row_number().over(Window.partitionBy("node").orderBy("neighbour"))  # a rank limit keeps a hundred rows a task before the shuffle
    return edges.withColumn("n", n).where("n <= 100").select("node", "neighbour")


@register("src_14_venue_enrichment", """
SELECT k AS venue, n AS n_records, publisher FROM (SELECT lower(trim(venue)) AS k, count(*) AS n FROM paper_records WHERE trim(coalesce(venue, '')) <> '' GROUP BY 1) LEFT JOIN (SELECT lower(trim(name)) AS k, min(publisher) AS publisher FROM venue_list GROUP BY 1) USING (k)
""")  # fmt: skip
def src_14(spark, sf):
    """Every distinct venue, looked up once, with its publisher."""
    key = lambda c: F.lower(F.trim(c)).alias("venue")
    asked = table(spark, sf, "paper_records").where("trim(venue) <> ''").groupBy(key("venue")).agg(F.count("*").alias("n_records"))
    known = table(spark, sf, "venue_list").groupBy(key("name")).agg(F.min("publisher").alias("publisher"))
    return asked.join(broadcast_if_small(known), "venue", "left").select("venue", "n_records", "publisher")


@register("src_17_legacy_references", rf"""
SELECT parsed_id, i AS position, trim(regexp_extract(r, '^(.*?)\s*\((?:19|20)\d{{2}}\)', 1)) AS authors, TRY_CAST(regexp_extract(r, '\(((?:19|20)\d{{2}})\)', 1) AS INTEGER) AS year, trim(regexp_extract(r, '\((?:19|20)\d{{2}}\)\.?\s*([^.]*)', 1)) AS title,
  {SQL_DOI.format(c='r')} AS doi, regexp_extract(r, '(?i)pmid:?\s*(\d+)', 1) AS pmid FROM (SELECT parsed_id, i, coalesce(reference_list[i], '') AS r FROM (SELECT parsed_id, reference_list, unnest(range(1, len(reference_list) + 1)) AS i FROM parsed_documents))
""")  # fmt: skip
def src_17(spark, sf):
    """Free references read as records: people before the year, the year, the title after it, DOI and PMID."""
    rows = table(spark, sf, "parsed_documents").select("parsed_id", F.posexplode("reference_list").alias("p", "r")).withColumn("r", F.coalesce("r", F.lit("")))
    return rows.select(
        "parsed_id",
        (F.col("p") + 1).cast("bigint").alias("position"),
        F.trim(F.regexp_extract("r", r"^(.*?)\s*\((?:19|20)\d{2}\)", 1)).alias("authors"),
        F.regexp_extract("r", r"\(((?:19|20)\d{2})\)", 1).try_cast("int").alias("year"),
        F.trim(F.regexp_extract("r", r"\((?:19|20)\d{2}\)\.?\s*([^.]*)", 1)).alias("title"),
        fx.normalize_doi(F.col("r")).alias("doi"),
        F.regexp_extract("r", r"(?i)pmid:?\s*(\d+)", 1).alias("pmid"),
    )


@register("prj_09_ordered_projection", "SELECT entry_id, trim(coalesce(title, '')) AS title, trim(coalesce(venue, '')) AS venue, coalesce(CAST(year AS VARCHAR), '') AS year FROM library_entries")
def prj_09(spark, sf):
    cells = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("title", "venue", "year")]
    return table(spark, sf, "library_entries").select("entry_id", *cells)


def overridden(lower, upper):
    """Two maps as one: the upper one wins, key by key."""
    return F.map_concat(F.map_filter(lower, lambda k, _: ~F.map_contains_key(upper, k)), upper)


def merged_maps(*layers):
    """One map of several: a later layer wins; null layers are left out."""
    empty = F.create_map().cast("map<string,string>")
    merged = empty
    for layer in layers:
        merged = overridden(merged, F.coalesce(layer, empty))
    return merged


@register("prj_14_layered_settings", """
SELECT source_id, 'format=' || CASE WHEN homepage IS NOT NULL THEN 'html' ELSE 'json' END || ',limit=' || CASE WHEN source_type = 'note' THEN '5' ELSE '10' END || ',name=' || coalesce(display_name, 'none') || ',source=' || source_type AS settings FROM evidence_sources WHERE source_type IS NOT NULL
""")  # fmt: skip
def prj_14(spark, sf):
    """Settings of each source from three layers: defaults, its kind, and what it states itself."""
    s = table(spark, sf, "evidence_sources").where("source_type is not null")
    default = F.create_map(*[F.lit(x) for x in ("limit", "10", "format", "json", "name", "none")])
    kind = F.map_concat(F.create_map(F.lit("source"), "source_type"), F.when(F.col("source_type") == "note", F.create_map(F.lit("limit"), F.lit("5"))).otherwise(F.create_map().cast("map<string,string>")))
    stated = F.map_filter(F.create_map(F.lit("name"), F.col("display_name"), F.lit("format"), F.when(F.col("homepage").isNotNull(), "html")), lambda _, v: v.isNotNull())
    entries = F.array_sort(F.map_entries(merged_maps(default, kind, stated)))
    return s.select("source_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("settings"))


@register("win_07_two_budgets", """
WITH a AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 4 AS own FROM events),
b AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM a WHERE own)
SELECT a.event_id, coalesce(b.n <= 12, false) AS allowed FROM a LEFT JOIN b USING (event_id)
""")  # fmt: skip
def win_07_two(spark, sf):
    """Requests that both budgets allow: four of a kind and twelve in all for each user, in order of time."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    own = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) <= 4
    marked = e.withColumn("own", own)
    running = F.sum(F.col("own").cast("int")).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("event_id", (F.col("own") & (running <= 12)).alias("allowed"))


@register("agg_10_split_families", """
SELECT provider, count(DISTINCT f) AS families, count(DISTINCT f) >= 4 AS enough FROM (SELECT provider, lower(trim(unnest(string_split_regex(array_to_string(coalesce(fields_of_study, []), ';'), '[,;/]+')))) AS f FROM paper_records WHERE provider IS NOT NULL) WHERE f <> '' GROUP BY provider
""")  # fmt: skip
def agg_10_breadth(spark, sf):
    """Distinct families that each provider covers, read from multi-valued cells, and whether they are four or more."""
    cells = table(spark, sf, "paper_records").where("provider is not null").select("provider", F.explode(F.split(F.array_join("fields_of_study", ";"), "[,;/]+")).alias("f"))
    n = F.countDistinct("f")
    return cells.select("provider", F.lower(F.trim("f")).alias("f")).where("f <> ''").groupBy("provider").agg(n.alias("families"), (n >= 4).alias("enough"))


@register("win_03_two_signals", """
WITH s AS (SELECT record_id, provider, citation_count::DOUBLE AS c, reference_count::DOUBLE AS r FROM paper_records WHERE provider IS NOT NULL),
a AS (SELECT record_id, CASE WHEN max(c) OVER w = min(c) OVER w THEN 1.0 ELSE (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) END AS v FROM s WHERE c IS NOT NULL WINDOW w AS (PARTITION BY provider)),
b AS (SELECT record_id, CASE WHEN max(r) OVER w = min(r) OVER w THEN 1.0 ELSE 1.0 - (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) END AS v FROM s WHERE r IS NOT NULL WINDOW w AS (PARTITION BY provider))
SELECT record_id, round(avg(v), 6) AS signal FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY record_id
""")  # fmt: skip
def win_03_two(spark, sf):
    """The mean of two signals scaled within providers, the second one a rank that is better when smaller."""
    from litloom.operators import windows as wx

    p = table(spark, sf, "paper_records").where("provider is not null").select("record_id", "provider", F.col("citation_count").cast("double").alias("c"), F.col("reference_count").cast("double").alias("r"))
    one = wx.scaled_within(p.where("c is not null"), "provider", "c", "v").select("record_id", "v")
    other = wx.scaled_within(p.where("r is not null"), "provider", "r", "v", reverse=True).select("record_id", "v")
    return one.unionByName(other).groupBy("record_id").agg(F.round(F.avg("v"), 6).alias("signal"))


_FULL_SQL = "SELECT d.record_id, bool_or(d.source_type IN ('pdf', 'full-text', 'xml', 'jats')) AS full_text FROM parsed_documents d JOIN evidence_chunks e USING (parsed_id) WHERE d.record_id IS NOT NULL AND trim(coalesce(e.text, '')) <> '' GROUP BY d.record_id"
_STATUS_SQL = f"""
SELECT p.*, CASE WHEN f.full_text THEN 'full-text-extracted' WHEN f.record_id IS NOT NULL THEN 'page-extracted' WHEN trim(coalesce(abstract, '')) <> '' THEN 'abstract-verified'
  WHEN coalesce(doi, '') || coalesce(pmid, '') || coalesce(pmcid, '') || coalesce(openalex_id, '') || coalesce(semantic_scholar_id, '') <> '' THEN 'identifier-verified' ELSE 'search-only' END AS status FROM paper_records p LEFT JOIN ({_FULL_SQL}) f USING (record_id)
"""


def verified_papers(spark, sf):
    """Papers with ``status``: how far each was verified, from a full text down to a mere hit of a search."""
    chunks = table(spark, sf, "evidence_chunks").where("trim(text) <> ''").select("parsed_id")
    documents = table(spark, sf, "parsed_documents").where("record_id is not null").join(chunks, "parsed_id", "left_semi")
    read = documents.groupBy("record_id").agg(F.bool_or(F.col("source_type").isin("pdf", "full-text", "xml", "jats")).alias("full_text"), F.lit(True).alias("page"))
    status = (
        F.when(F.col("full_text"), "full-text-extracted")
        .when(F.col("page"), "page-extracted")
        .when(F.trim("abstract") != "", "abstract-verified")
        .when(fx.has_identifier(False), "identifier-verified")
        .otherwise("search-only")
    )
    return table(spark, sf, "paper_records").join(read, "record_id", "left").withColumn("status", status)


@register("sf_26_verification_status", f"SELECT record_id, status FROM ({_STATUS_SQL})")
def sf_26(spark, sf):
    return verified_papers(spark, sf).select("record_id", "status")


@register("agg_02_all_counters", f"""
WITH s AS ({_STATUS_SQL}), c AS (SELECT DISTINCT g.record_id FROM duplicate_groups g JOIN (SELECT group_id FROM duplicate_groups JOIN paper_records USING (record_id) GROUP BY group_id HAVING count(DISTINCT title) > 1) USING (group_id))
SELECT 60 AS requested, count(*) AS total, count(*) FILTER (status <> 'search-only' AND NOT coalesce(is_retracted, false)) AS verified, greatest(0, 60 - count(*) FILTER (status <> 'search-only' AND NOT coalesce(is_retracted, false))) AS shortfall,
  count(*) FILTER (coalesce(is_open_access, false)) AS open_access, count(*) FILTER (status = 'full-text-extracted') AS full_text, count(*) FILTER (PREPRINT) AS preprints, count(*) FILTER (coalesce(is_retracted, false)) AS retracted,
  count(c.record_id) AS with_conflicts, count(*) FILTER (coalesce(doi, '') = '' AND coalesce(pmid, '') = '') AS without_doi_or_pmid FROM s LEFT JOIN c USING (record_id)
""".replace("PREPRINT", SQL_PREPRINT))  # fmt: skip
def agg_02_all(spark, sf):
    """All ten counters of a packet's coverage, for sixty references."""
    members = table(spark, sf, "duplicate_groups")
    titles = members.join(table(spark, sf, "paper_records").select("record_id", "title"), "record_id")
    disputed = titles.groupBy("group_id").agg(F.countDistinct("title").alias("n")).where("n > 1")
    conflicts = members.join(disputed, "group_id", "left_semi").select("record_id").distinct().withColumn("conflict", F.lit(True))
    p = verified_papers(spark, sf).join(conflicts, "record_id", "left")
    retracted = F.coalesce(F.col("is_retracted"), F.lit(False))
    ok = F.count_if((F.col("status") != "search-only") & ~retracted)
    return p.agg(
        F.lit(60).alias("requested"), F.count("*").alias("total"), ok.alias("verified"), F.greatest(F.lit(0), 60 - ok).alias("shortfall"), F.count_if(F.coalesce("is_open_access", F.lit(False))).alias("open_access"),
        F.count_if(F.col("status") == "full-text-extracted").alias("full_text"), F.count_if(fx.is_preprint()).alias("preprints"), F.count_if(retracted).alias("retracted"), F.count("conflict").alias("with_conflicts"),
        F.count_if((F.coalesce("doi", F.lit("")) == "") & (F.coalesce("pmid", F.lit("")) == "")).alias("without_doi_or_pmid"),
    )


_CONFLICT_SQL = " OR ".join(f"contains(lower(f), '{w}')" for w in fx.CONFLICT_WORDS)


@register("agg_04_gaps", f"""
SELECT NOT bool_or(k.evidence_quality = 'high') AS no_high_tier, (SELECT count(*) FROM (SELECT unnest(findings) AS f FROM ({SQL_FINDINGS}) WHERE NOT coalesce(is_retracted, false)) WHERE {_CONFLICT_SQL}) = 0 AS no_conflicts,
  (SELECT count(*) FROM ({_STATUS_SQL}) WHERE status = 'full-text-extracted') = 0 AS no_full_text FROM ({SQL_QUALITY}) k
""")  # fmt: skip
def agg_04_gaps(spark, sf):
    """The three gaps of a synthesis: no strong design, no conflicting wording, no full text."""
    from litloom.catalogue.aggregates import references

    r = references(spark, sf)
    strong = r.agg((~F.bool_or(F.col("evidence_quality") == "high")).alias("no_high_tier"))
    findings = r.where("not retracted").select(F.explode("findings").alias("f"))
    conflicts = findings.agg((F.count_if(fx.any_of(F.lower("f"), fx.CONFLICT_WORDS)) == 0).alias("no_conflicts"))
    texts = verified_papers(spark, sf).agg((F.count_if(F.col("status") == "full-text-extracted") == 0).alias("no_full_text"))
    return strong.join(F.broadcast(conflicts)).join(F.broadcast(texts))  # one row each


@register("agg_05_claims_with_evidence", f"""
WITH c AS (SELECT d.record_id, count(*) AS n FROM parsed_documents d JOIN evidence_chunks e USING (parsed_id) WHERE d.record_id IS NOT NULL AND trim(coalesce(e.text, '')) <> '' GROUP BY d.record_id)
SELECT record_id, claim, least(2, coalesce(n, 1)) AS n_excerpts FROM (SELECT record_id, unnest(findings) AS claim FROM ({SQL_FINDINGS}) WHERE NOT coalesce(is_retracted, false)) LEFT JOIN c USING (record_id)
""")  # fmt: skip
def agg_05_evidence(spark, sf):
    """Every finding with the number of excerpts that are shown for it: two at most, of chunks or of the abstract."""
    from litloom.catalogue.aggregates import references

    chunks = table(spark, sf, "evidence_chunks").where("trim(text) <> ''").select("parsed_id")
    counts = table(spark, sf, "parsed_documents").where("record_id is not null").select("parsed_id", "record_id").join(chunks, "parsed_id").groupBy("record_id").agg(F.count("*").alias("n"))
    claims = references(spark, sf).where("not retracted").select("record_id", F.explode("findings").alias("claim"))
    return claims.join(counts, "record_id", "left").select("record_id", "claim", F.least(F.lit(2), F.coalesce("n", F.lit(1))).alias("n_excerpts"))


@register("hlp_06_fenced_lines", r"""
WITH l AS (SELECT parsed_id, i, m[i] AS line FROM (SELECT parsed_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT parsed_id, string_split(coalesce(markdown, ''), chr(10)) AS m FROM parsed_documents))),
f AS (SELECT parsed_id, regexp_matches(line, '^\s{0,3}(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(line, '^\s{0,3}(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY parsed_id ORDER BY i) AS k FROM l)
SELECT parsed_id, count(*) AS n_lines, count(*) FILTER (fence OR k % 2 = 1) AS n_fenced FROM f GROUP BY parsed_id
""")  # fmt: skip
def hlp_06(spark, sf):
    """Lines of each document's Markdown, and those inside fences."""
    lines = table(spark, sf, "parsed_documents").select("parsed_id", F.posexplode(F.split(F.coalesce("markdown", F.lit("")), "\n")).alias("i", "line"))
    fence = F.col("line").rlike(r"^\s{0,3}(```|~~~)")
    k = F.sum(fence.cast("int")).over(Window.partitionBy("parsed_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))  # the lines of one document
    return lines.select("parsed_id", (fence | (k % 2 == 1)).alias("fenced")).groupBy("parsed_id").agg(F.count("*").alias("n_lines"), F.count_if("fenced").alias("n_fenced"))
