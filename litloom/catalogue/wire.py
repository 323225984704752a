"""Answers of services made of paper_records, and read back to rows of the common schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.catalogue.scalars import SQL_DOI
from litloom.registry import register
from litloom.runtime import table
from litloom.sources import wire


def _papers(spark, sf):
    return table(spark, sf, "paper_records")


def _inverted(column):
    """The inverted index of a text: its distinct words with their places."""
    words = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"\s+"), lambda w: w != "")
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["w"] == x["w"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(x["w"].alias("w"), F.array_append(F.element_at(acc, -1)["p"], x["i"]).alias("p")))),
    ).otherwise(F.array_append(acc, F.struct(x["w"].alias("w"), F.array(x["i"]).alias("p"))))
    entries = F.aggregate(placed, F.array().cast("array<struct<w:string,p:array<int>>>"), step)
    return F.when(F.size(words) > 0, F.map_from_entries(entries))


def _named(column):
    return F.transform(column, lambda n: F.struct(n.alias("display_name")))


def _after(prefix, column):
    return F.when(F.col(column).isNotNull(), F.concat(F.lit(prefix), column))


def _openalex():
    return F.struct(
        _after("https://openalex.org/", "openalex_id").alias("id"), "title", "doi", F.struct(_after("https://pubmed.example.org/", "pmid").alias("pmid"), _after("https://pmc.example.org/articles/", "pmcid").alias("pmcid"), _after("https://arxiv.org/abs/", "arxiv_id").alias("arxiv")).alias("ids"),
        F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), "publication_date", F.col("year").alias("publication_year"),
        F.struct(F.col("url").alias("landing_page_url"), F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"), F.struct(F.col("is_open_access").alias("is_oa")).alias("open_access"),
        F.transform("fields_of_study", lambda f: F.struct(f.alias("display_name"), F.struct(F.upper(f).alias("display_name")).alias("field"))).alias("topics"), _named(F.col("keywords")).alias("keywords"),
        F.col("citation_count").alias("cited_by_count"), "is_retracted", F.get("publication_types", F.lit(0)).alias("type"), _inverted("abstract").alias("abstract_inverted_index"),
    )


def _semantic_scholar():
    return F.struct(
        F.col("semantic_scholar_id").alias("paperId"), F.struct(F.col("doi").alias("DOI"), F.col("pmid").alias("PubMed"), F.col("pmcid").alias("PubMedCentral"), F.col("openalex_id").alias("OpenAlex"), F.col("arxiv_id").alias("ArXiv")).alias("externalIds"),
        "title", "abstract", "year", F.col("publication_date").alias("publicationDate"), "venue", "url", F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), F.col("citation_count").alias("citationCount"),
        F.col("reference_count").alias("referenceCount"), F.col("is_open_access").alias("isOpenAccess"), F.col("fields_of_study").alias("fieldsOfStudy"), F.transform("keywords", lambda k: F.struct(k.alias("category"))).alias("s2FieldsOfStudy"), F.col("publication_types").alias("publicationTypes"),
    )


def _crossref():
    day = F.col("publication_date").rlike(r"^\d{4}-\d{2}-\d{2}$")
    parts = lambda *x: F.struct(F.array(F.array(*x)).alias("date-parts"))
    number = lambda k: F.regexp_extract("publication_date", r"^(\d{4})-0?(\d{1,2})-0?(\d{1,2})$", k)
    return F.struct(
        F.array("title").alias("title"), F.transform("authors", lambda a: F.struct(F.regexp_extract(a, r"^(.*) \S+$", 1).alias("given"), F.regexp_extract(a, r"(\S+)$", 1).alias("family"))).alias("author"), F.array("venue").alias("container-title"),
        F.col("doi").alias("DOI"), F.concat(F.lit("<jats:p>"), "abstract", F.lit("</jats:p>")).alias("abstract"), F.get("publication_types", F.lit(0)).alias("type"), F.col("citation_count").alias("is-referenced-by-count"),
        F.col("reference_count").alias("references-count"), F.when(day, parts(number(1), number(2), number(3))).alias("published"), F.when(F.col("year").isNotNull(), parts(F.col("year").cast("string"))).alias("issued"),
    )


def _europe_pmc():
    return F.struct(
        F.col("pmid").alias("id"), "title", F.array_join("authors", ", ").alias("authorString"), F.col("publication_date").alias("firstPublicationDate"), F.col("year").alias("pubYear"), F.col("venue").alias("journalTitle"), "doi", "pmid", "pmcid",
        F.col("abstract").alias("abstractText"), F.struct(F.col("publication_types").alias("pubType")).alias("pubTypeList"), F.col("citation_count").alias("citedByCount"), F.when(F.col("is_open_access"), "Y").when(~F.col("is_open_access"), "N").alias("isOpenAccess"),
    )


def _unpaywall():
    return F.struct(
        "doi", F.concat(F.lit("https://doi.org/"), "doi").alias("doi_url"), "title", "year", F.col("publication_date").alias("published_date"), F.col("venue").alias("journal_name"), F.get("publication_types", F.lit(0)).alias("genre"), F.col("is_open_access").alias("is_oa"),
        F.struct(F.concat("url", F.lit(".pdf")).alias("url_for_pdf"), F.col("url")).alias("best_oa_location"), F.transform("authors", lambda a: F.struct(a.alias("raw_author_name"))).alias("z_authors"),
    )


WRITTEN = {"openalex": _openalex, "semantic_scholar": _semantic_scholar, "crossref": _crossref, "europe_pmc": _europe_pmc, "unpaywall": _unpaywall}


def answers(spark, sf, provider):
    """``(record_id, item)``: every paper record as the service would write it."""
    return _papers(spark, sf).select("record_id", F.to_json(WRITTEN[provider]()).alias("item"))


def _flat(df):
    """Arrays as text, so that rows compare; locations by kind."""
    joined = {c: F.array_join(c, "|") for c in ("authors", "publication_types", "fields_of_study", "keywords")}
    return df.withColumns(joined).withColumn("locations", F.array_join(F.transform("locations", lambda x: F.concat(x["kind"], F.lit(" "), x["url"])), "|"))


_EMPTY = "'' AS pmid, '' AS pmcid, '' AS openalex_id, '' AS semantic_scholar_id, '' AS arxiv_id"
_T = "coalesce({0}, '') AS {0}"
_COMMON = ", ".join(_T.format(c) for c in ("title", "publication_date", "venue"))
_JOINED = "array_to_string(coalesce(authors, []), '|') AS authors"
_KINDS = "array_to_string(coalesce(publication_types, []), '|') AS publication_types"
_FIRST_KIND = "coalesce(publication_types[1], '') AS publication_types"
_WORDS = r"array_to_string(list_filter(string_split_regex(coalesce(abstract, ''), '\s+'), lambda w: w <> ''), ' ') AS abstract"
_DOI = SQL_DOI.format(c="doi") + " AS doi"


@register("prj_01_openalex", f"""
SELECT record_id, {_COMMON}, {_JOINED}, year, {_DOI}, coalesce(pmid, '') AS pmid, coalesce(pmcid, '') AS pmcid, coalesce(openalex_id, '') AS openalex_id, '' AS semantic_scholar_id, coalesce(arxiv_id, '') AS arxiv_id,
  coalesce(url, doi, 'https://openalex.org/' || openalex_id, '') AS url, {_WORDS}, {_FIRST_KIND}, array_to_string(flatten(list_transform(coalesce(fields_of_study, []), lambda f: [f, upper(f)])), '|') AS fields_of_study,
  array_to_string(coalesce(keywords, []), '|') AS keywords, citation_count, CAST(NULL AS BIGINT) AS reference_count, coalesce(is_retracted, false) AS is_retracted, is_open_access, '' AS locations,
  CASE WHEN coalesce(title, '') || {SQL_DOI.format(c="doi")} || coalesce(pmid, '') || coalesce(pmcid, '') || coalesce(openalex_id, '') = '' THEN 'discarded' ELSE 'ok' END AS status FROM paper_records
""")  # fmt: skip
def prj_01(spark, sf):
    """Items with nested topics, people and an inverted abstract (SF-05)."""
    return _flat(wire.normalized(answers(spark, sf, "openalex"), "openalex", keep=("record_id",)))


@register("prj_02_semantic_scholar", f"""
SELECT record_id, {_COMMON}, {_JOINED}, year, {_DOI}, coalesce(pmid, '') AS pmid, coalesce(pmcid, '') AS pmcid, coalesce(openalex_id, '') AS openalex_id, coalesce(semantic_scholar_id, '') AS semantic_scholar_id, coalesce(arxiv_id, '') AS arxiv_id,
  coalesce(url, '') AS url, coalesce(abstract, '') AS abstract, {_KINDS}, array_to_string(list_concat(coalesce(fields_of_study, []), coalesce(keywords, [])), '|') AS fields_of_study, '' AS keywords, citation_count, reference_count,
  CAST(NULL AS BOOLEAN) AS is_retracted, is_open_access, '' AS locations,
  CASE WHEN coalesce(title, '') || {SQL_DOI.format(c="doi")} || coalesce(pmid, '') || coalesce(pmcid, '') || coalesce(openalex_id, '') || coalesce(semantic_scholar_id, '') = '' THEN 'discarded' ELSE 'ok' END AS status FROM paper_records
""")  # fmt: skip
def prj_02(spark, sf):
    return _flat(wire.normalized(answers(spark, sf, "semantic_scholar"), "semantic_scholar", keep=("record_id",)))


@register("prj_03_crossref", rf"""
WITH p AS (SELECT *, CASE WHEN regexp_full_match(coalesce(publication_date, ''), '\d{{4}}-\d{{2}}-\d{{2}}') THEN publication_date WHEN year IS NOT NULL THEN CAST(year AS VARCHAR) ELSE '' END AS d FROM paper_records)
SELECT record_id, coalesce(title, '') AS title, coalesce(venue, '') AS venue, d AS publication_date, {_JOINED}, TRY_CAST(regexp_extract(d, '^(\d{{4}})', 1) AS INTEGER) AS year, {_DOI}, {_EMPTY},
  CASE WHEN {SQL_DOI.format(c="doi")} <> '' THEN 'https://doi.org/' || {SQL_DOI.format(c="doi")} ELSE '' END AS url, {_FIRST_KIND}, '' AS fields_of_study, '' AS keywords, citation_count, reference_count,
  CAST(NULL AS BOOLEAN) AS is_retracted, CAST(NULL AS BOOLEAN) AS is_open_access, '' AS locations, CASE WHEN coalesce(title, '') || {SQL_DOI.format(c="doi")} = '' THEN 'discarded' ELSE 'ok' END AS status FROM p
""")  # fmt: skip
def prj_03(spark, sf):
    """Items with date parts, people in two parts and marked-up abstracts (which SF-30 reads)."""
    return _flat(wire.normalized(answers(spark, sf, "crossref"), "crossref", keep=("record_id",))).drop("abstract")


@register("prj_04_europe_pmc", f"""
SELECT record_id, {_COMMON}, array_to_string(list_transform(CASE WHEN authors IS NULL THEN [] ELSE string_split(array_to_string(authors, ', '), ',') END, lambda n: trim(n)), '|') AS authors, year, {_DOI}, coalesce(pmid, '') AS pmid, coalesce(pmcid, '') AS pmcid,
  '' AS openalex_id, '' AS semantic_scholar_id, '' AS arxiv_id, CASE WHEN coalesce(pmid, pmcid, '') = '' THEN '' ELSE 'https://europepmc.org/article/MED/' || coalesce(pmid, pmcid) END AS url, coalesce(abstract, '') AS abstract, {_KINDS},
  '' AS fields_of_study, '' AS keywords, citation_count, CAST(NULL AS BIGINT) AS reference_count, CAST(NULL AS BOOLEAN) AS is_retracted, is_open_access,
  CASE WHEN is_open_access AND coalesce(pmcid, '') <> '' THEN 'jats https://www.ebi.ac.uk/europepmc/webservices/rest/' || pmcid || '/fullTextXML' ELSE '' END AS locations,
  CASE WHEN coalesce(title, '') || {SQL_DOI.format(c="doi")} || coalesce(pmid, '') || coalesce(pmcid, '') = '' THEN 'discarded' ELSE 'ok' END AS status FROM paper_records
""")  # fmt: skip
def prj_04(spark, sf):
    return _flat(wire.normalized(answers(spark, sf, "europe_pmc"), "europe_pmc", keep=("record_id",)))


@register("prj_05_unpaywall", f"""
SELECT record_id, {_COMMON}, {_JOINED}, year, {_DOI}, {_EMPTY}, coalesce('https://doi.org/' || doi, '') AS url, '' AS abstract, {_FIRST_KIND}, '' AS fields_of_study, '' AS keywords, CAST(NULL AS BIGINT) AS citation_count,
  CAST(NULL AS BIGINT) AS reference_count, CAST(NULL AS BOOLEAN) AS is_retracted, coalesce(is_open_access, false) AS is_open_access, CASE WHEN url IS NULL THEN '' ELSE 'pdf ' || url || '.pdf|landing ' || url END AS locations,
  CASE WHEN coalesce(title, '') || {SQL_DOI.format(c="doi")} = '' THEN 'discarded' ELSE 'ok' END AS status FROM paper_records
""")  # fmt: skip
def prj_05(spark, sf):
    return _flat(wire.normalized(answers(spark, sf, "unpaywall"), "unpaywall", keep=("record_id",)))


@register("prj_06_page_isolation", f"""
WITH s AS (SELECT provider, CASE WHEN abstract IS NULL THEN 'bad' WHEN coalesce(title, '') || {SQL_DOI.format(c="doi")} || coalesce(pmid, '') || coalesce(pmcid, '') || coalesce(openalex_id, '') || coalesce(semantic_scholar_id, '') = '' THEN 'discarded' ELSE 'ok' END AS status, doi
  FROM paper_records WHERE provider IS NOT NULL),
g AS (SELECT provider, count(*) AS received_count, count(*) FILTER (status = 'ok') AS normalized_count, count(*) FILTER (status <> 'ok') AS discarded_count, CASE WHEN provider = 'crossref' THEN NULL ELSE count(doi) + 100 END AS provider_total FROM s GROUP BY provider)
SELECT *, provider_total > received_count AS has_more, CASE WHEN provider_total > received_count THEN 'single-page-limit' WHEN provider_total <= received_count THEN 'source-exhausted' ELSE 'pagination-unknown' END AS stop_reason,
  CASE WHEN discarded_count > 0 THEN 'partial' ELSE 'ok' END AS status FROM g
""")  # fmt: skip
def prj_06(spark, sf):
    """One page per provider, in which the items without abstract arrive cut off: they are counted and end nothing."""
    papers = _papers(spark, sf).where("provider is not null")
    whole = F.to_json(_semantic_scholar())
    items = papers.select("provider", F.when(F.col("abstract").isNull(), F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("item"))
    totals = papers.groupBy("provider").agg(F.when(F.col("provider") != "crossref", F.count("doi") + 100).alias("provider_total"))
    return wire.page_report(wire.normalized(items, "semantic_scholar", keep=("provider",)), totals, "provider")


@register("sf_05_reconstructed_abstract", f"SELECT record_id, {_WORDS} FROM paper_records")
def sf_05(spark, sf):
    """Abstracts rebuilt from their inverted indexes."""
    return _papers(spark, sf).select("record_id", wire.reconstruct_abstract(_inverted("abstract")).alias("abstract"))


@register("sf_30_stripped_markup")
def sf_30(spark, sf):
    """Abstracts without tags and character references."""
    return _papers(spark, sf).select("record_id", wire.strip_markup(F.col("abstract")).alias("abstract"))


@register("ord_04_ranked_locations", """
SELECT record_id, array_to_string(CASE WHEN coalesce(is_open_access, false) AND url IS NOT NULL THEN CASE WHEN coalesce(pmcid, '') <> '' THEN ['jats', 'pdf', 'landing'] ELSE ['pdf', 'landing'] END ELSE [] END, ',') AS kinds FROM paper_records
""")  # fmt: skip
def ord_04(spark, sf):
    """The open locations of each record in the order in which they are tried: markup, pages, PDF, landing pages."""
    order = {"jats": 0, "xml": 0, "html": 1, "pdf": 2, "landing": 3}
    both = wire.normalized(answers(spark, sf, "unpaywall"), "unpaywall", keep=("record_id",)).select("record_id", "locations")
    pmc = wire.normalized(answers(spark, sf, "europe_pmc"), "europe_pmc", keep=("record_id",)).select("record_id", F.col("locations").alias("more"))
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    all_of = both.join(pmc, "record_id").select("record_id", F.concat("locations", F.when(F.size("locations") > 0, F.col("more")).otherwise(F.array().cast("array<struct<url:string,kind:string,is_oa:boolean>>"))).alias("l"))
    ranked = F.array_sort(F.transform(F.filter("l", lambda x: x["is_oa"]), lambda x, i: F.struct(F.coalesce(F.element_at(rank, x["kind"]), F.lit(4)).alias("rank"), i.alias("position"), x["kind"].alias("kind"))))
    return all_of.select("record_id", F.array_join(F.transform(ranked, lambda x: x["kind"]), ",").alias("kinds"))
