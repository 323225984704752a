"""Steps of running plans as tables: choices of providers, fallbacks, attempts, snapshots, templates and contracts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litloom.catalogue.planning import _IDS_SQL, _ROUTE_CASE, _ROUTES_SQL, _VARIANTS_SQL
from litloom.catalogue.scalars import _SQL_HAS_ID
from litloom.functions import identifiers as ix
from litloom.functions import text as fx
from litloom.plans import columns as pc
from litloom.registry import register
from litloom.runtime import broadcast_if_small, table


def _requests(spark, sf):
    routed = table(spark, sf, "documents").select("doc_id", pc.route(F.col("text")).alias("kind"))
    return pc.requests(routed, "doc_id", "kind").join(routed, "doc_id")


@register("ctl_02_targeted", f"""
WITH k AS (SELECT i.doc_id, {_ROUTE_CASE} AS kind FROM ({_IDS_SQL}) i JOIN documents d USING (doc_id)), r AS ({_ROUTES_SQL}), a AS (SELECT DISTINCT provider FROM paper_records WHERE provider IS NOT NULL),
t AS (SELECT doc_id, kind, provider, row_number() OVER (PARTITION BY doc_id ORDER BY priority) AS n FROM k JOIN r USING (kind) JOIN a USING (provider))
SELECT doc_id, provider FROM t WHERE n <= CASE WHEN kind = 'identifier' THEN 3 ELSE 2 END
""")  # fmt: skip
def ctl_02(spark, sf):
    """The first providers of each route that are there: three for identifiers, else two."""
    there = table(spark, sf, "paper_records").where("provider is not null").select("provider").distinct()
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("priority"))  # four rows a question
    usable = _requests(spark, sf).join(broadcast_if_small(there), "provider", "left_semi").withColumn("n", n)
    return usable.where(F.col("n") <= F.when(F.col("kind") == "identifier", 3).otherwise(2)).select("doc_id", "provider")


@register("ctl_05_decisions", f"""
WITH k AS (SELECT i.doc_id, {_ROUTE_CASE} AS kind FROM ({_IDS_SQL}) i JOIN documents d USING (doc_id)), r AS ({_ROUTES_SQL})
SELECT provider, decision, reason, count(*) AS n FROM (SELECT provider, CASE WHEN priority <= CASE WHEN kind = 'identifier' THEN 3 ELSE 2 END THEN 'selected' ELSE 'skipped' END AS decision,
  CASE WHEN priority <= CASE WHEN kind = 'identifier' THEN 3 ELSE 2 END THEN kind || ' route' ELSE 'beyond the first ' || CASE WHEN kind = 'identifier' THEN '3' ELSE '2' END END AS reason FROM k JOIN r USING (kind)) GROUP BY ALL
""")  # fmt: skip
def ctl_05(spark, sf):
    """How often each provider is selected or skipped, and why."""
    most = F.when(F.col("kind") == "identifier", 3).otherwise(2)
    chosen = F.col("priority") <= most
    reason = F.when(chosen, F.concat("kind", F.lit(" route"))).otherwise(F.concat(F.lit("beyond the first "), most.cast("string")))
    return _requests(spark, sf).groupBy("provider", F.when(chosen, "selected").otherwise("skipped").alias("decision"), reason.alias("reason")).agg(F.count("*").alias("n"))


@register("ctl_06_fallback", f"""
SELECT provider, n_records, round(n_stable / n_records, 6) AS stable_share, CASE WHEN n_records < 20 THEN 'few records' WHEN n_stable / n_records < 0.8 THEN 'few stable identifiers' ELSE 'none' END AS fallback_reason
FROM (SELECT provider, count(*) AS n_records, count(*) FILTER ({_SQL_HAS_ID}) AS n_stable FROM paper_records WHERE provider IS NOT NULL GROUP BY provider)
""")  # fmt: skip
def ctl_06(spark, sf):
    """What each provider covers, and the reason for a fallback if that is not enough."""
    p = table(spark, sf, "paper_records").where("provider is not null").groupBy("provider").agg(F.count("*").alias("n_records"), F.count_if(fx.has_identifier()).alias("n_stable"))
    share = F.col("n_stable") / F.col("n_records")
    return p.select("provider", "n_records", F.round(share, 6).alias("stable_share"), F.when(F.col("n_records") < 20, "few records").when(share < 0.8, "few stable identifiers").otherwise("none").alias("fallback_reason"))


@register("ctl_07_next_variant", f"SELECT record_id, min(position) AS position, min_by(variant, position) AS variant FROM ({_VARIANTS_SQL}) v WHERE variant <> 'original' GROUP BY record_id")
def ctl_07(spark, sf):
    """The first variant of each question that was not asked yet, when the original was."""
    planned = pc.variants(table(spark, sf, "paper_records").select("record_id", "title"), "record_id", "title")
    asked = planned.where("variant = 'original'").select("record_id", "variant")
    left = planned.join(asked, ["record_id", "variant"], "left_anti")
    return left.groupBy("record_id").agg(F.min("position").alias("position"), F.min_by("variant", "position").alias("variant"))


@register("ctl_04_annotated_routes", """
SELECT record_id, len(coalesce(provenance, [])) + CASE WHEN provider IS NOT NULL AND len(list_filter(coalesce(provenance, []), lambda p: p.provider = provider)) = 0 THEN 1 ELSE 0 END AS n_routes FROM paper_records
""")  # fmt: skip
def ctl_04(spark, sf):
    """Provenance with the record's own provider added if it is not there."""
    known = F.coalesce("provenance.provider", F.array().cast("array<string>"))
    added = F.when(F.col("provider").isNotNull() & ~F.array_contains(known, F.col("provider")), 1).otherwise(0)
    return table(spark, sf, "paper_records").select("record_id", (F.size(known) + F.coalesce(added, F.lit(0))).cast("bigint").alias("n_routes"))


@register("ctl_10_first_text", """
SELECT parsed_id, CASE WHEN trim(coalesce(text, '')) <> '' THEN 'text' WHEN trim(coalesce(markdown, '')) <> '' THEN 'markdown' WHEN len(list_filter(coalesce(sections, []), lambda s: trim(coalesce(s.text, '')) <> '')) > 0 THEN 'sections' ELSE 'none' END AS origin,
  length(CASE WHEN trim(coalesce(text, '')) <> '' THEN text WHEN trim(coalesce(markdown, '')) <> '' THEN markdown ELSE array_to_string(list_transform(list_filter(coalesce(sections, []), lambda s: trim(coalesce(s.text, '')) <> ''), lambda s: s.text), chr(10)) END) AS n_chars FROM parsed_documents
""")  # fmt: skip
def ctl_10(spark, sf):
    """The first of three attempts that gives a text: the text, the Markdown, the sections."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    parts = F.filter(F.coalesce("sections.text", F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    attempts = (("text", filled(F.col("text"))), ("markdown", filled(F.col("markdown"))), ("sections", F.when(F.size(parts) > 0, F.array_join(parts, "\n"))))
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in attempts], F.lit("none"))
    return table(spark, sf, "parsed_documents").select("parsed_id", origin.alias("origin"), F.length(F.coalesce(*[c for _, c in attempts], F.lit(""))).cast("bigint").alias("n_chars"))


@register("ctl_12_snapshot", r"""
SELECT parsed_id, sha256(coalesce(text, '')) AS sha256, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '\b[A-Z]{1,4}-\d{1,6}\b'))), ',') AS ids FROM parsed_documents
""")  # fmt: skip
def ctl_12(spark, sf):
    """Hash of every text and the typed ids it defines."""
    return table(spark, sf, "parsed_documents").select("parsed_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.array_join(F.array_sort(F.array_distinct(ix.cell_ids(F.col("text")))), ",").alias("ids"))


@register("ctl_13_inherited_ids", """
SELECT chunk_id, CASE WHEN NOT regexp_full_match(chunk_id, 'chunk-[0-9]+') THEN 'malformed' WHEN k IS NULL THEN 'unknown' ELSE 'inherited' END AS state FROM (SELECT DISTINCT chunk_id FROM evidence_records WHERE chunk_id IS NOT NULL) LEFT JOIN (SELECT DISTINCT 'chunk-' || chunk_no AS k FROM evidence_chunks) ON k = chunk_id
""")  # fmt: skip
def ctl_13(spark, sf):
    """Ids that evidence inherits: each once, of the right form, and known to the parent."""
    ids = table(spark, sf, "evidence_records").where("chunk_id is not null").select("chunk_id").distinct()
    known = table(spark, sf, "evidence_chunks").select(F.concat(F.lit("chunk-"), F.col("chunk_no").cast("string")).alias("chunk_id")).distinct().withColumn("k", F.lit(True))
    state = F.when(~F.col("chunk_id").rlike("^chunk-[0-9]+$"), "malformed").when(F.col("k").isNull(), "unknown").otherwise("inherited")
    return ids.join(known, "chunk_id", "left").select("chunk_id", state.alias("state"))


@register("ctl_16_unchanged", "SELECT parsed_id, CASE WHEN content_hash IS NULL THEN 'unrecorded' WHEN content_hash = sha256(coalesce(text, '')) THEN 'unchanged' ELSE 'changed' END AS state FROM parsed_documents")
def ctl_16(spark, sf):
    """Whether each text still has the hash that was recorded."""
    state = F.when(F.col("content_hash").isNull(), "unrecorded").when(F.col("content_hash") == F.sha2(F.coalesce("text", F.lit("")), 256), "unchanged").otherwise("changed")
    return table(spark, sf, "parsed_documents").select("parsed_id", state.alias("state"))


@register("ctl_17_template_plan", """
SELECT b.venue_id, coalesce(nullif(trim(o.venue), ''), b.name) AS chosen, o.venue IS NOT NULL AS overridden FROM venue_list b LEFT JOIN (SELECT lower(name) AS k, min(venue) AS venue FROM venue_list JOIN library_entries ON lower(trim(library_entries.venue)) = lower(name) GROUP BY 1) o ON o.k = lower(b.name)
""")  # fmt: skip
def ctl_17(spark, sf):
    """A base list with overrides by key: the first writing that entries use, else the base's."""
    base = table(spark, sf, "venue_list").select("venue_id", "name", F.lower("name").alias("k"))
    used = table(spark, sf, "library_entries").where("venue is not null").groupBy(F.lower(F.trim("venue")).alias("k")).agg(F.min("venue").alias("venue"))
    own = F.when(F.trim("venue") != "", F.trim("venue"))
    return base.join(used, "k", "left").select("venue_id", F.coalesce(own, "name").alias("chosen"), F.col("venue").isNotNull().alias("overridden"))


@register("ctl_18_rendered_template", r"""
SELECT record_id, r AS line, regexp_matches(r, '\{\{[a-z]+\}\}') AS unresolved FROM (SELECT record_id, replace(replace('{{title}} ({{year}})', '{{title}}', coalesce(title, '{{title}}')), '{{year}}', coalesce(CAST(year AS VARCHAR), '{{year}}')) AS r FROM paper_records)
""")  # fmt: skip
def ctl_18(spark, sf):
    """A template filled for each record; what is left over is reported."""
    line = F.lit("{{title}} ({{year}})")
    for name in ("title", "year"):
        line = F.replace(line, F.lit("{{%s}}" % name), F.coalesce(F.col(name).cast("string"), F.lit("{{%s}}" % name)))
    return table(spark, sf, "paper_records").select("record_id", line.alias("line")).withColumn("unresolved", F.col("line").rlike(r"\{\{[a-z]+\}\}"))


@register("ctl_19_source_status", """
SELECT s.source_id, CASE WHEN e.n IS NULL THEN 'never used' WHEN e.bad > 0 THEN 'error' WHEN s.homepage IS NULL THEN 'unwatched' WHEN e.late > 0 THEN 'pending update' ELSE 'current' END AS status FROM evidence_sources s LEFT JOIN (SELECT source_id, count(*) AS n,
  count(*) FILTER (list_contains(warnings, 'encoding-guess')) AS bad, count(*) FILTER (ingested_at > retrieved_at + INTERVAL 7 DAY) AS late FROM evidence_records WHERE source_id IS NOT NULL GROUP BY source_id) e USING (source_id)
""")  # fmt: skip
def ctl_19(spark, sf):
    """One status for each source; errors of one do not hide the others."""
    e = table(spark, sf, "evidence_records").where("source_id is not null").groupBy("source_id").agg(
        F.count("*").alias("n"), F.count_if(F.array_contains("warnings", "encoding-guess")).alias("bad"), F.count_if(F.expr("ingested_at > retrieved_at + interval 7 day")).alias("late")
    )
    status = F.when(F.col("n").isNull(), "never used").when(F.col("bad") > 0, "error").when(F.col("homepage").isNull(), "unwatched").when(F.col("late") > 0, "pending update").otherwise("current")
    return table(spark, sf, "evidence_sources").select("source_id", "homepage").join(e, "source_id", "left").select("source_id", status.alias("status"))


@register("hlp_24_block_substance", r"""
SELECT parsed_id, count(*) AS n_sections, count(*) FILTER (len(list_filter(string_split(coalesce(s.text, ''), chr(10)), lambda l: trim(l) <> '' AND NOT regexp_matches(l, '^\s{0,3}#{1,6}\s'))) > 0) AS n_with_substance FROM (SELECT parsed_id, unnest(sections) AS s FROM parsed_documents) GROUP BY parsed_id
""")  # fmt: skip
def hlp_24(spark, sf):
    """Sections that hold a line other than blanks and headings, of all sections (CHK-02)."""
    lines = F.split(F.coalesce("s.text", F.lit("")), "\n")
    solid = F.exists(lines, lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s{0,3}#{1,6}\s"))
    return table(spark, sf, "parsed_documents").select("parsed_id", F.explode("sections").alias("s")).groupBy("parsed_id").agg(F.count("*").alias("n_sections"), F.count_if(solid).alias("n_with_substance"))


@register("hlp_26_canonical_names", "SELECT parsed_id, len(list_filter(list_transform(coalesce(sections, []), lambda s: lower(trim(coalesce(s.title, '')))), lambda t: t NOT IN ('introduction', 'background', 'methods', 'materials and methods', 'results', 'discussion', 'conclusions'))) = 0 AS canonical FROM parsed_documents")
def hlp_26(spark, sf):
    """Whether all section titles of a document are canonical ones."""
    names = F.array(*[F.lit(x) for x in ("introduction", "background", "methods", "materials and methods", "results", "discussion", "conclusions")])
    titles = F.transform(F.coalesce("sections.title", F.array().cast("array<string>")), lambda t: F.lower(F.trim(F.coalesce(t, F.lit("")))))
    return table(spark, sf, "parsed_documents").select("parsed_id", (F.size(F.array_except(titles, names)) == 0).alias("canonical"))


@register("hlp_34_provenance_rows", "SELECT record_id, p.provider AS provider, p.operation AS operation, coalesce(p.request_url, '') AS request_url, coalesce(p.provider_record_id, '') AS provider_record_id FROM (SELECT record_id, unnest(provenance) AS p FROM paper_records)")
def hlp_34(spark, sf):
    """Every step of every record's provenance."""
    p = table(spark, sf, "paper_records").select("record_id", F.explode("provenance").alias("p"))
    none = lambda c: F.coalesce(c, F.lit("")).alias(c.split(".")[1])
    return p.select("record_id", "p.provider", "p.operation", none("p.request_url"), none("p.provider_record_id"))


@register("hlp_22_numbered_links", r"""
SELECT parsed_id, CAST(n AS BIGINT) AS number, count(*) AS n_lines FROM (SELECT parsed_id, regexp_extract(l, '^\s*(\d{1,6})[.)]\s+', 1) AS n FROM (SELECT parsed_id, unnest(string_split(coalesce(markdown, ''), chr(10))) AS l FROM parsed_documents)) WHERE n <> '' GROUP BY ALL
""")  # fmt: skip
def hlp_22(spark, sf):
    """Numbered lines of the Markdown of each document; a number on several lines is a duplicate (HLP-17)."""
    lines = table(spark, sf, "parsed_documents").select("parsed_id", F.explode(F.split(F.coalesce("markdown", F.lit("")), "\n")).alias("l"))
    numbers = lines.select("parsed_id", F.regexp_extract("l", r"^\s*(\d{1,6})[.)]\s+", 1).alias("n")).where("n <> ''")
    return numbers.groupBy("parsed_id", F.col("n").cast("bigint").alias("number")).agg(F.count("*").alias("n_lines"))


@register("chk_08_lens_coverage", """
SELECT f.feed, t.source_type, count(s.source_id) AS n_sources, CASE WHEN count(s.source_id) = 0 THEN 'zero hits' ELSE 'covered' END AS state FROM (SELECT DISTINCT feed FROM evidence_sources WHERE feed IS NOT NULL) f CROSS JOIN (SELECT DISTINCT source_type FROM evidence_sources WHERE source_type IS NOT NULL) t
LEFT JOIN evidence_sources s ON s.feed = f.feed AND s.source_type = t.source_type GROUP BY f.feed, t.source_type
""")  # fmt: skip
def chk_08(spark, sf):
    """Every lens (kind of source) of every feed, those without a hit stated as such."""
    s = table(spark, sf, "evidence_sources")
    # the kinds of source are a short vocabulary: one array of them, not a join
    kinds = s.where("source_type is not null").agg(F.collect_set("source_type").alias("kinds"))
    lenses = s.where("feed is not null").select("feed").distinct().join(F.broadcast(kinds)).select("feed", F.explode("kinds").alias("source_type"))
    hits = s.groupBy("feed", "source_type").agg(F.count("source_id").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return lenses.join(hits, ["feed", "source_type"], "left").select("feed", "source_type", n.alias("n_sources"), F.when(n == 0, "zero hits").otherwise("covered").alias("state"))
