"""Answers of literature services: JSON items to rows of one schema, and pages whose bad items are counted, not fatal.

Every service has a schema for the parts of its items that are read, and a projection of the parsed item to the common
columns: ``title, authors, publication_date, year, venue, doi, pmid, pmcid, openalex_id, semantic_scholar_id, arxiv_id, url,
abstract, publication_types, fields_of_study, keywords, citation_count, reference_count, is_retracted, is_open_access,
locations``. Numbers are read as text and cast with tolerance, so a wrong one is null and not an error. Texts that are
missing are empty, flags that are missing are null.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as fx

_NAMED = "struct<display_name:string>"
SCHEMAS = {
    "openalex": "struct<id:string,title:string,doi:string,ids:struct<doi:string,pmid:string,pmcid:string,arxiv:string>,authorships:array<struct<author:struct<display_name:string>>>,"
    f"publication_date:string,publication_year:string,primary_location:struct<landing_page_url:string,source:{_NAMED}>,best_oa_location:struct<pdf_url:string,landing_page_url:string,license:string>,"
    f"open_access:struct<is_oa:boolean,oa_url:string>,topics:array<struct<display_name:string,field:{_NAMED},domain:{_NAMED}>>,keywords:array<struct<display_name:string,keyword:string>>,"
    "cited_by_count:string,is_retracted:boolean,type:string,abstract_inverted_index:map<string,array<int>>>",
    "semantic_scholar": "struct<paperId:string,externalIds:struct<DOI:string,PubMed:string,PubMedCentral:string,OpenAlex:string,ArXiv:string>,title:string,abstract:string,year:string,publicationDate:string,venue:string,"
    "url:string,authors:array<struct<name:string>>,citationCount:string,referenceCount:string,isOpenAccess:boolean,openAccessPdf:struct<url:string,license:string>,fieldsOfStudy:array<string>,"
    "s2FieldsOfStudy:array<struct<category:string>>,publicationTypes:array<string>>",
    "crossref": "struct<title:array<string>,author:array<struct<given:string,family:string>>,`container-title`:array<string>,DOI:string,URL:string,abstract:string,type:string,`is-referenced-by-count`:string,"
    "`references-count`:string,published:struct<`date-parts`:array<array<string>>>,`published-online`:struct<`date-parts`:array<array<string>>>,`published-print`:struct<`date-parts`:array<array<string>>>,"
    "issued:struct<`date-parts`:array<array<string>>>,license:array<struct<URL:string>>,link:array<struct<URL:string,`content-type`:string>>>",
    "europe_pmc": "struct<id:string,source:string,title:string,authorString:string,authorList:struct<author:array<struct<fullName:string,lastName:string>>>,firstPublicationDate:string,pubYear:string,journalTitle:string,"
    "doi:string,pmid:string,pmcid:string,abstractText:string,pubTypeList:struct<pubType:array<string>>,citedByCount:string,isOpenAccess:string,fullTextUrlList:struct<fullTextUrl:array<struct<url:string,documentStyle:string>>>>",
    "unpaywall": "struct<doi:string,doi_url:string,title:string,year:string,published_date:string,journal_name:string,genre:string,is_oa:boolean,oa_status:string,"
    "best_oa_location:struct<url_for_pdf:string,url_for_landing_page:string,url:string,license:string,host_type:string,version:string>,z_authors:array<struct<raw_author_name:string>>>",
}

_LOCATION = "struct<url:string,kind:string,is_oa:boolean>"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def texts(c: Column) -> Column:
    """An array of texts without nulls; empty for null."""
    return F.coalesce(F.transform(c, lambda x: text(x)), F.array().cast("array<string>"))


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unescaped(value: Column) -> Column:
    """Character references replaced; only values that may hold one reach Python."""

    @F.pandas_udf("string")
    def resolve(values: pd.Series) -> pd.Series:
        return values.map(lambda x: html.unescape(x) if x is not None else None)

    return F.when(F.contains(value, F.lit("&")), resolve(value)).otherwise(value)


def strip_markup(value: Column) -> Column:
    """Tags become spaces, character references are resolved, and white space is collapsed."""
    bare = unescaped(F.regexp_replace(text(value), r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def reconstruct_abstract(index: Column) -> Column:
    """The text of an inverted index (word → places); of words that claim one place, the last in the index has it."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("place"), i.alias("seq"), e["key"].alias("word")))))
    last = lambda placed: F.filter(placed, lambda p, i: (i == F.size(placed) - 1) | (F.get(placed, i + 1)["place"] != p["place"]))
    return F.coalesce(F.array_join(F.transform(once(F.array_sort(pairs), last), lambda p: p["word"]), " "), F.lit(""))


def _last_part(value: Column) -> Column:
    return fx.short_id(value)


def _locations(*rows: tuple[Column, str, Column]) -> Column:
    made = [F.when(text(url) != "", F.struct(text(url).alias("url"), F.lit(kind).alias("kind"), oa.cast("boolean").alias("is_oa"))) for url, kind, oa in rows]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def _row(**given: Column) -> list[Column]:
    none = {
        "title": F.lit(""), "authors": F.array().cast("array<string>"), "publication_date": F.lit(""), "year": F.lit(None).cast("int"), "venue": F.lit(""), "doi": F.lit(""), "pmid": F.lit(""),
        "pmcid": F.lit(""), "openalex_id": F.lit(""), "semantic_scholar_id": F.lit(""), "arxiv_id": F.lit(""), "url": F.lit(""), "abstract": F.lit(""), "publication_types": F.array().cast("array<string>"),
        "fields_of_study": F.array().cast("array<string>"), "keywords": F.array().cast("array<string>"), "citation_count": F.lit(None).cast("bigint"), "reference_count": F.lit(None).cast("bigint"),
        "is_retracted": F.lit(None).cast("boolean"), "is_open_access": F.lit(None).cast("boolean"), "locations": F.array().cast(f"array<{_LOCATION}>"),
    }
    return [given.get(name, default).alias(name) for name, default in none.items()]


def from_openalex(x: Column) -> list[Column]:
    yes = F.lit(True)
    best, access = x["best_oa_location"], x["open_access"]
    fields = F.flatten(F.transform(x["topics"], lambda t: F.array(t["display_name"], t["field"]["display_name"], t["domain"]["display_name"])))
    return _row(
        title=text(x["title"]), authors=texts(F.transform(x["authorships"], lambda a: a["author"]["display_name"])), publication_date=text(x["publication_date"]), year=x["publication_year"].try_cast("int"),
        venue=text(x["primary_location"]["source"]["display_name"]), doi=fx.normalize_doi(F.coalesce(x["doi"], x["ids"]["doi"])), pmid=_last_part(x["ids"]["pmid"]), pmcid=_last_part(x["ids"]["pmcid"]),
        openalex_id=_last_part(x["id"]), arxiv_id=_last_part(x["ids"]["arxiv"]), url=text(F.coalesce(x["primary_location"]["landing_page_url"], x["doi"], x["id"])),
        abstract=reconstruct_abstract(x["abstract_inverted_index"]), publication_types=F.array(text(x["type"])),
        fields_of_study=F.filter(texts(fields), lambda f: f != ""), keywords=texts(F.transform(x["keywords"], lambda k: F.coalesce(k["display_name"], k["keyword"]))),
        citation_count=x["cited_by_count"].try_cast("bigint"), is_retracted=F.coalesce(x["is_retracted"], F.lit(False)), is_open_access=access["is_oa"],
        locations=_locations((best["pdf_url"], "pdf", yes), (best["landing_page_url"], "html", yes), (access["oa_url"], "landing", yes)),
    )


def from_semantic_scholar(x: Column) -> list[Column]:
    ids = x["externalIds"]
    return _row(
        title=text(x["title"]), authors=texts(F.transform(x["authors"], lambda a: a["name"])), publication_date=text(x["publicationDate"]), year=x["year"].try_cast("int"), venue=text(x["venue"]),
        doi=fx.normalize_doi(ids["DOI"]), pmid=text(ids["PubMed"]), pmcid=text(ids["PubMedCentral"]), openalex_id=text(ids["OpenAlex"]), semantic_scholar_id=text(x["paperId"]), arxiv_id=text(ids["ArXiv"]),
        url=text(x["url"]), abstract=text(x["abstract"]), publication_types=texts(x["publicationTypes"]),
        fields_of_study=F.concat(texts(x["fieldsOfStudy"]), texts(F.transform(x["s2FieldsOfStudy"], lambda f: f["category"]))),
        citation_count=x["citationCount"].try_cast("bigint"), reference_count=x["referenceCount"].try_cast("bigint"), is_open_access=x["isOpenAccess"],
        locations=_locations((x["openAccessPdf"]["url"], "pdf", F.lit(True))),
    )


def from_crossref(x: Column) -> list[Column]:
    parts = [F.get(x[key]["date-parts"], F.lit(0)) for key in ("published", "published-online", "published-print", "issued")]
    stated = F.coalesce(*[F.when(F.size(p) > 0, p) for p in parts])
    date = F.coalesce(F.array_join(F.transform(stated, lambda v, i: F.when(F.length(v) < 2, F.lpad(v, 2, "0")).otherwise(v)), "-"), F.lit(""))
    people = F.transform(x["author"], lambda a: F.array_join(F.filter(F.array(a["given"], a["family"]), lambda n: text(n) != ""), " "))
    open_licence = F.exists(F.transform(x["license"], lambda v: F.lower(text(v["URL"]))), lambda v: F.contains(v, F.lit("creativecommons.org")))
    links = F.filter(F.transform(x["link"], lambda v: F.struct(text(v["URL"]).alias("url"), F.when(F.contains(F.lower(text(v["content-type"])), F.lit("pdf")), "pdf").otherwise("html").alias("kind"), F.when(open_licence, True).alias("is_oa"))), lambda v: v["url"] != "")
    doi = fx.normalize_doi(x["DOI"])
    return _row(
        title=text(F.get(x["title"], F.lit(0))), authors=texts(people), publication_date=date, year=F.regexp_extract(date, r"^(\d{4})", 1).try_cast("int"), venue=text(F.get(x["container-title"], F.lit(0))),
        doi=doi, url=F.coalesce(x["URL"], F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)), F.lit("")), abstract=strip_markup(x["abstract"]), publication_types=F.array(text(x["type"])),
        citation_count=x["is-referenced-by-count"].try_cast("bigint"), reference_count=x["references-count"].try_cast("bigint"), locations=F.coalesce(links, F.array().cast(f"array<{_LOCATION}>")),
    )


def from_europe_pmc(x: Column) -> list[Column]:
    listed = texts(F.transform(x["authorList"]["author"], lambda a: F.coalesce(a["fullName"], a["lastName"])))
    split = F.transform(F.split(x["authorString"], ","), lambda n: F.trim(n))
    oa = F.upper(text(x["isOpenAccess"])) == "Y"
    number = F.coalesce(*[F.when(text(v) != "", v) for v in (x["id"], x["pmid"], x["pmcid"])], F.lit(""))
    given = F.transform(x["fullTextUrlList"]["fullTextUrl"], lambda v: F.struct(text(v["url"]).alias("url"), F.when(F.contains(F.lower(text(v["documentStyle"])), F.lit("pdf")), "pdf").otherwise("html").alias("kind"), oa.alias("is_oa")))
    own = F.when(oa & (text(x["pmcid"]) != ""), F.array(F.struct(F.concat(F.lit("https://www.ebi.ac.uk/europepmc/webservices/rest/"), text(x["pmcid"]), F.lit("/fullTextXML")).alias("url"), F.lit("jats").alias("kind"), F.lit(True).alias("is_oa"))))
    none = F.array().cast(f"array<{_LOCATION}>")
    return _row(
        title=text(x["title"]), authors=F.when(F.size(listed) > 0, listed).otherwise(texts(split)), publication_date=text(x["firstPublicationDate"]), year=x["pubYear"].try_cast("int"), venue=text(x["journalTitle"]),
        doi=fx.normalize_doi(x["doi"]), pmid=text(x["pmid"]), pmcid=text(x["pmcid"]),
        url=F.when(number != "", F.concat(F.lit("https://europepmc.org/article/"), F.coalesce(x["source"], F.lit("MED")), F.lit("/"), number)).otherwise(""), abstract=text(x["abstractText"]),
        publication_types=texts(x["pubTypeList"]["pubType"]), citation_count=x["citedByCount"].try_cast("bigint"), is_open_access=F.when(x["isOpenAccess"].isNotNull(), oa),
        locations=F.concat(F.coalesce(given, none), F.coalesce(own, none)),
    )


def from_unpaywall(x: Column) -> list[Column]:
    place = x["best_oa_location"]
    oa = F.coalesce(x["is_oa"], F.lit(False))
    return _row(
        title=text(x["title"]), authors=texts(F.transform(x["z_authors"], lambda a: a["raw_author_name"])), publication_date=text(x["published_date"]), year=x["year"].try_cast("int"), venue=text(x["journal_name"]),
        doi=fx.normalize_doi(x["doi"]), url=text(x["doi_url"]), publication_types=F.array(text(x["genre"])), is_open_access=oa,
        locations=_locations((place["url_for_pdf"], "pdf", oa), (place["url_for_landing_page"], "html", oa), (place["url"], "landing", oa)),
    )


PROJECTIONS = {"openalex": from_openalex, "semantic_scholar": from_semantic_scholar, "crossref": from_crossref, "europe_pmc": from_europe_pmc, "unpaywall": from_unpaywall}


def normalized(items: DataFrame, provider: str, item: str = "item", keep: tuple[str, ...] = ()) -> DataFrame:
    """The common columns of JSON ``items``, with the columns to ``keep`` and ``status``.

    An item is ``bad`` if it is no JSON object, ``discarded`` if it has neither a title nor a stable identifier, else ``ok``.
    No item ends the query.
    """
    parsed = items.select(*keep, F.from_json(item, SCHEMAS[provider].replace("struct<", "struct<_corrupt:string,", 1), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("x"))
    parsed = parsed.withColumn("bad", F.col("x").isNull() | F.col("x._corrupt").isNotNull())
    rows = parsed.select(*keep, "bad", *PROJECTIONS[provider](F.col("x")))
    ids = F.concat("title", "doi", "pmid", "openalex_id", "semantic_scholar_id", "pmcid")
    return rows.withColumn("status", F.when(F.col("bad"), "bad").when(ids == "", "discarded").otherwise("ok")).drop("bad")


def page_report(rows: DataFrame, totals: DataFrame, page: str) -> DataFrame:
    """One row per page of ``normalized`` items: received, normalized, discarded, whether there is more, and why it ended.

    ``totals(page, provider_total)`` is what the service says it holds; a negative or missing total says nothing.
    """
    counted = rows.groupBy(page).agg(F.count("*").alias("received_count"), F.count_if(F.col("status") == "ok").alias("normalized_count"), F.count_if(F.col("status") != "ok").alias("discarded_count"))
    total = F.when(F.col("provider_total") >= 0, F.col("provider_total"))
    more = total > F.col("received_count")
    return counted.join(totals, page, "left").select(
        page, "received_count", "normalized_count", "discarded_count", total.alias("provider_total"), more.alias("has_more"),
        F.when(more, "single-page-limit").when(~more, "source-exhausted").otherwise("pagination-unknown").alias("stop_reason"), F.when(F.col("discarded_count") > 0, "partial").otherwise("ok").alias("status"),
    )
