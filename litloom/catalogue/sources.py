"""Scans and sinks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.registry import register
from litloom.runtime import table
from litloom.sources import search as sx

_FILTERS = sx.Filters(after=2012, before=2022, types=("article", "review"), open_access=True, min_citations=10)
_STRICT = "year BETWEEN 2012 AND 2022 AND list_has_any(publication_types, ['article', 'review']) AND coalesce(is_open_access, false) AND citation_count >= 10"


@register("src_06_search_openalex", f"SELECT record_id FROM paper_records WHERE provider = 'openalex' AND {_STRICT}")
def src_06(spark, sf):
    return sx.search(table(spark, sf, "paper_records"), "openalex", _FILTERS).select("record_id")


@register("src_07_search_semantic_scholar", f"SELECT record_id FROM paper_records WHERE provider = 'semantic_scholar' AND {_STRICT}")
def src_07(spark, sf):
    return sx.search(table(spark, sf, "paper_records"), "semantic_scholar", _FILTERS).select("record_id")


@register("src_08_search_crossref_loose", "SELECT record_id FROM paper_records WHERE provider = 'crossref' AND year BETWEEN 2012 AND 2022 AND list_contains(publication_types, 'article')")
def src_08(spark, sf):
    """What that source gives by itself: it knows no open access, citations or second type."""
    return sx.search(table(spark, sf, "paper_records"), "crossref", _FILTERS, strict=False).select("record_id")


@register("src_09_search_europe_pmc", f"SELECT record_id FROM paper_records WHERE provider = 'europe_pmc' AND {_STRICT}")
def src_09(spark, sf):
    return sx.search(table(spark, sf, "paper_records"), "europe_pmc", _FILTERS).select("record_id")


@register("src_10_point_lookup", "SELECT record_id, title FROM paper_records WHERE record_id = (SELECT min(record_id) FROM paper_records)")
def src_10(spark, sf):
    p = table(spark, sf, "paper_records")
    first = F.broadcast(p.agg(F.min("record_id").alias("record_id")))  # one row
    return p.join(first, "record_id").select("record_id", "title")


@register("src_11_batched_lookup", "SELECT record_id FROM paper_records WHERE doi IN (SELECT doi FROM evidence_records)")
def src_11(spark, sf):
    keys = table(spark, sf, "evidence_records").where("doi is not null").select("doi")
    return sx.lookup_many(table(spark, sf, "paper_records"), "doi", keys).select("record_id")


def citation():
    """Authors (year). Title. Venue. with n.d. for a missing year."""
    names = F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ")
    return F.concat(F.when(names == "", "Unknown").otherwise(names), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("). "), F.coalesce("title", F.lit("Untitled source")), F.lit(". "), F.coalesce("venue", F.lit("")))


_CITATION = "CASE WHEN array_to_string(coalesce(authors, []), ', ') = '' THEN 'Unknown' ELSE array_to_string(coalesce(authors, []), ', ') END || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '). ' || coalesce(title, 'Untitled source') || '. ' || coalesce(venue, '')"


@register("snk_05_citation_text", f"SELECT record_id, {_CITATION} AS citation FROM paper_records")
def snk_05(spark, sf):
    return table(spark, sf, "paper_records").select("record_id", citation().alias("citation"))


@register("snk_03_bibtex", r"""
SELECT record_id, '@article{ref' || record_id || ',' || chr(10) || '  title = {' || regexp_replace(coalesce(title, ''), '([&%$#_{}])', '\\\1', 'g') || '},' || chr(10) || '  year = {' || coalesce(CAST(year AS VARCHAR), '') || '}' || chr(10) || '}' AS entry
FROM paper_records WHERE NOT coalesce(is_retracted, false)
""")  # fmt: skip
def snk_03(spark, sf):
    """BibTeX entries of all papers that are not retracted."""
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"([&%$#_{}])", r"\\$1")
    entry = F.concat(F.lit("@article{ref"), F.col("record_id").cast("string"), F.lit(",\n  title = {"), title, F.lit("},\n  year = {"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit("}\n}"))
    return table(spark, sf, "paper_records").where(~F.coalesce("is_retracted", F.lit(False))).select("record_id", entry.alias("entry"))


@register("snk_12_report_counts", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN coalesce(abstract, '') = '' THEN 'warning' WHEN coalesce(doi, '') = '' THEN 'error' ELSE 'passed' END AS status FROM paper_records) GROUP BY status")
def snk_12(spark, sf):
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    status = F.when(empty("abstract"), "warning").when(empty("doi"), "error").otherwise("passed")
    return table(spark, sf, "paper_records").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
