"""Scalar functions, projections and predicates as queries over paper_records, evidence_records and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.functions import text as fx
from litloom.registry import register
from litloom.runtime import table

#: Question of the sample queries, as the tokens it leaves.
QUESTION = "thermal stability and hydrolysis kinetics in protein networks"
TERMS = ["hydrolysis", "kinetics", "networks", "protein", "stability", "thermal"]


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _papers(spark, sf, *columns):
    return table(spark, sf, "paper_records").select("record_id", *columns)


SQL_DOI = r"lower(regexp_replace(regexp_extract(regexp_replace(trim(coalesce({c}, '')), '(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''), '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+'), '[.,;:)\]}}]+$', ''))"
SQL_TITLE = r"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"
SQL_TOKENS = r"list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+|[一-鿿]')), lambda t: NOT list_contains({stop}, t))".replace("{stop}", _sql_list(fx.STOPWORDS))
SQL_MATCH = (
    "CASE WHEN len(" + SQL_TOKENS + ") = 0 THEN 0.0 ELSE least(1.0, 0.85 * len(list_intersect(" + SQL_TOKENS + ", {terms})) / {n}.0"
    " + 0.15 * len(list_intersect(" + SQL_TOKENS + ", {terms})) / len(" + SQL_TOKENS + ")) END"
)


def sql_match(column: str, terms=TERMS) -> str:
    return SQL_MATCH.replace("{c}", column).replace("{terms}", _sql_list(terms)).replace("{n}", str(len(terms)))


_ID_COLUMNS = (("doi", "doi"), ("pmid", "pmid"), ("pmcid", "pmcid"), ("openalex", "openalex_id"), ("s2", "semantic_scholar_id"), ("arxiv", "arxiv_id"))
_SQL_RECORD_KEY = (
    "coalesce(" + ", ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN '{p}:' || lower({c}) END" for p, c in _ID_COLUMNS)
    + ", 'title:' || " + SQL_TITLE.format(c="title") + " || '|authors:' || lower(array_to_string(coalesce(authors[1:2], []), '|')))"
)

SQL_KIND = (
    "CASE WHEN len(list_filter(coalesce(publication_types, []), lambda t: replace(lower(trim(t)), '_', '-') = 'peer-review')) > 0 THEN 'peer-review-document' "
    + " ".join(f"WHEN {' OR '.join(f"contains(combined, '{w}')" for w in words)} THEN '{name}'" for name, words in fx.PUBLICATION_CLASSES)
    + " ELSE coalesce(publication_types[1], 'primary/other') END"
)
SQL_COMBINED = "' ' || lower(array_to_string(coalesce(publication_types, []), ' ')) || ' ' || lower(concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(abstract), ''))) || ' ' AS combined"
SQL_PREPRINT = r"(coalesce(arxiv_id, '') <> '' OR regexp_matches(lower(concat_ws(' ', coalesce(url, ''), coalesce(venue, ''), array_to_string(coalesce(publication_types, []), ' '))), 'preprint|arxiv\.org|biorxiv\.org|medrxiv\.org'))"
SQL_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')), '([.!?。！？])\s+([A-Z0-9一-鿿])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) BETWEEN 30 AND 1200)"


def extracted(spark, sf):
    """``record_id`` of the papers of which a parsed document has evidence chunks."""
    chunks = table(spark, sf, "evidence_chunks").where("trim(text) <> ''").select("parsed_id")
    return table(spark, sf, "parsed_documents").where("record_id is not null").join(chunks, "parsed_id", "left_semi").select("record_id").distinct()


def source_text():
    """Title and abstract on lines of their own, blanks dropped."""
    return F.concat_ws("\n", F.when(F.trim("title") != "", F.trim("title")), F.when(F.trim("abstract") != "", F.trim("abstract")))


@register("sf_01_canonical_url", r"""
SELECT record_id, CASE WHEN trim(coalesce(url, '')) = '' THEN '' ELSE
  lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || '://' || lower(regexp_extract(trim(url), '^[^:/?#]+://([^/?#]*)', 1))
  || CASE WHEN regexp_replace(regexp_extract(trim(url), '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(trim(url), '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') END
  || CASE WHEN array_to_string(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|campaign|ref)(=|$)')), '&') = '' THEN ''
     ELSE '?' || array_to_string(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|campaign|ref)(=|$)')), '&') END
  END AS canonical_url FROM (SELECT record_id, url || '/?utm_source=x&b=2&ref=q&a=1#top' AS url FROM paper_records)
""")  # fmt: skip
def sf_01(spark, sf):
    url = F.concat(F.col("url"), F.lit("/?utm_source=x&b=2&ref=q&a=1#top"))
    return _papers(spark, sf, "url").select("record_id", fx.canonical_url(url).alias("canonical_url"))


@register("sf_02_normalize_doi", f"SELECT record_id, {SQL_DOI.format(c='doi')} AS normal_doi FROM paper_records")
def sf_02(spark, sf):
    return _papers(spark, sf, "doi").select("record_id", fx.normalize_doi(F.col("doi")).alias("normal_doi"))


@register("sf_03_normalize_title", f"SELECT record_id, {SQL_TITLE.format(c='title')} AS normal_title FROM paper_records")
def sf_03(spark, sf):
    return _papers(spark, sf, "title").select("record_id", fx.normalize_title(F.col("title")).alias("normal_title"))


@register("sf_04_short_id", "SELECT record_id, string_split(rtrim(trim(coalesce(url, '')), '/'), '/')[-1] AS short_id FROM paper_records")
def sf_04(spark, sf):
    return _papers(spark, sf, "url").select("record_id", fx.short_id(F.col("url")).alias("short_id"))


@register("sf_06_identity_keys", f"""
WITH p AS (SELECT *, {SQL_TITLE.format(c='title')} AS nt, {SQL_TITLE.format(c='authors[1]')} AS lead FROM paper_records)
SELECT record_id, unnest(list_filter([{', '.join(f"CASE WHEN coalesce({c}, '') <> '' THEN '{k}:' || lower({c}) END" for k, c in (*_ID_COLUMNS, ('url', 'url')))},
  CASE WHEN length(nt) >= 20 AND len(coalesce(authors, [])) > 0 AND lead <> '' THEN 'title-author:' || nt || ':' || lead END,
  CASE WHEN length(nt) >= 20 AND len(coalesce(authors, [])) = 0 THEN 'title-only:' || nt END], lambda k: k IS NOT NULL)) AS identity_key FROM p
""")  # fmt: skip
def sf_06(spark, sf):
    return table(spark, sf, "paper_records").select("record_id", F.explode(fx.identity_keys()).alias("identity_key"))


@register("sf_07_record_key", f"SELECT record_id, {_SQL_RECORD_KEY} AS record_key FROM paper_records")
def sf_07(spark, sf):
    return table(spark, sf, "paper_records").select("record_id", fx.record_key().alias("record_key"))


@register("sf_08_source_text", "SELECT record_id, sha256(concat_ws(chr(10), nullif(trim(title), ''), nullif(trim(abstract), ''))) AS text_hash FROM paper_records")
def sf_08(spark, sf):
    return _papers(spark, sf, "title", "abstract").select("record_id", F.sha2(source_text(), 256).alias("text_hash"))


@register("sf_09_tokens", f"SELECT doc_id, len({SQL_TOKENS.replace('{c}', 'text')}) AS n_tokens, list_min({SQL_TOKENS.replace('{c}', 'text')}) AS first_token FROM documents")
def sf_09(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", fx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.array_min("t").alias("first_token"))


@register("sf_10_text_match", f"SELECT record_id, round({sql_match('title')}, 6) AS title_match, round(CASE WHEN coalesce(abstract, '') = '' THEN 0.5 ELSE {sql_match('abstract')} END, 6) AS abstract_match FROM paper_records")
def sf_10(spark, sf):
    return _papers(spark, sf, "title", "abstract").select(
        "record_id",
        F.round(fx.text_match(TERMS, F.col("title")), 6).alias("title_match"),
        F.round(F.when(F.coalesce("abstract", F.lit("")) == "", 0.5).otherwise(fx.text_match(TERMS, F.col("abstract"))), 6).alias("abstract_match"),
    )


@register("sf_11_year_score", "SELECT record_id, round(CASE WHEN year IS NULL THEN 0.5 ELSE 1.0 / (1 + greatest(2015 - year, 0) + greatest(year - 2020, 0)) END, 6) AS in_range, round(CASE WHEN year IS NULL THEN 0.5 ELSE 1.0 / (1 + abs(year - 2018)) END, 6) AS near_target FROM paper_records")
def sf_11(spark, sf):
    return _papers(spark, sf, "year").select(
        "record_id", F.round(fx.year_score(F.col("year"), 2015, 2020), 6).alias("in_range"), F.round(fx.year_score(F.col("year"), target=2018), 6).alias("near_target")
    )


_SQL_HAS_ID = "(" + " OR ".join(f"coalesce({c}, '') <> ''" for _, c in _ID_COLUMNS) + ")"


@register("sf_12_evidence_score", f"SELECT record_id, round(CAST((CASE WHEN coalesce(abstract, '') <> '' THEN 0.45 ELSE 0 END) + (CASE WHEN record_id IN (SELECT d.record_id FROM parsed_documents d JOIN evidence_chunks e USING (parsed_id) WHERE d.record_id IS NOT NULL AND trim(e.text) <> '') THEN 0.35 ELSE 0 END) + (CASE WHEN {_SQL_HAS_ID} THEN 0.1 ELSE 0 END) + (CASE WHEN coalesce(is_open_access, false) THEN 0.1 ELSE 0 END) AS DOUBLE), 6) AS evidence_score FROM paper_records")
def sf_12(spark, sf):
    flagged = table(spark, sf, "paper_records").join(extracted(spark, sf).withColumn("x", F.lit(True)), "record_id", "left")
    return flagged.select("record_id", F.round(fx.evidence_score(F.coalesce("x", F.lit(False))), 6).alias("evidence_score"))


@register("sf_14_query_language", "SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[㐀-䶿一-鿿]') AND regexp_matches(coalesce(text, ''), '[A-Za-z]') THEN 'zh-en-mixed' WHEN regexp_matches(coalesce(text, ''), '[㐀-䶿一-鿿]') THEN 'zh' WHEN regexp_matches(coalesce(text, ''), '[A-Za-z]') THEN 'en' ELSE 'undetermined' END AS language FROM documents")
def sf_14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fx.query_language(F.col("text")).alias("language"))


@register("sf_22_sentences", f"SELECT record_id, len({SQL_SENTENCES.format(c='abstract')}) AS n_sentences, sha256(array_to_string({SQL_SENTENCES.format(c='abstract')}, '|')) AS sentence_hash FROM paper_records")
def sf_22(spark, sf):
    s = _papers(spark, sf, "abstract").select("record_id", fx.sentences(F.col("abstract")).alias("s"))
    return s.select("record_id", F.size("s").alias("n_sentences"), F.sha2(F.array_join("s", "|"), 256).alias("sentence_hash"))


@register("sf_24_publication_class", f"SELECT record_id, {SQL_KIND} AS publication_class FROM (SELECT *, {SQL_COMBINED} FROM paper_records)")
def sf_24(spark, sf):
    return table(spark, sf, "paper_records").select("record_id", fx.publication_class(F.col("publication_types"), source_text()).alias("publication_class"))


_SQL_LABEL = "CASE WHEN coalesce(is_retracted, false) THEN 'exclude' WHEN w >= 4 THEN 'high' WHEN w = 3 THEN 'moderate' WHEN w = 2 THEN 'contextual' ELSE 'low' END"
_SQL_WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fx.EVIDENCE_WEIGHTS.items()) + " ELSE 2 END"
SQL_QUALITY = f"""
SELECT *, {_SQL_LABEL} AS evidence_quality FROM (SELECT *, CASE WHEN preprint THEN greatest(1, {_SQL_WEIGHT}) - CASE WHEN {_SQL_WEIGHT} > 1 THEN 1 ELSE 0 END ELSE {_SQL_WEIGHT} END AS w
FROM (SELECT *, {SQL_KIND} AS kind, {SQL_PREPRINT} AS preprint FROM (SELECT *, {SQL_COMBINED} FROM paper_records)))
"""


@register("sf_25_evidence_quality", f"SELECT record_id, evidence_quality FROM ({SQL_QUALITY})")
def sf_25(spark, sf):
    kind = fx.publication_class(F.col("publication_types"), source_text())
    return table(spark, sf, "paper_records").select("record_id", fx.evidence_label(kind, fx.is_preprint(), F.col("is_retracted")).alias("evidence_quality"))


_SQL_MARKED = "list_filter(s, lambda x: " + " OR ".join(f"contains(lower(x), '{w}')" for w in fx.FINDING_WORDS) + ")"
SQL_FINDINGS = f"SELECT *, (CASE WHEN len({_SQL_MARKED}) > 0 THEN {_SQL_MARKED} ELSE s END)[1:3] AS findings FROM (SELECT *, {SQL_SENTENCES.format(c='abstract')} AS s FROM paper_records)"


@register("sf_27_findings", f"SELECT record_id, len(findings) AS n_findings, sha256(array_to_string(findings, '|')) AS findings_hash FROM ({SQL_FINDINGS})")
def sf_27(spark, sf):
    f = _papers(spark, sf, "abstract").select("record_id", fx.findings(F.col("abstract")).alias("f"))
    return f.select("record_id", F.size("f").alias("n_findings"), F.sha2(F.array_join("f", "|"), 256).alias("findings_hash"))


@register("sf_29_sample_and_effects", r"SELECT record_id, replace(regexp_extract(coalesce(abstract, ''), '(?i)\b(?:n\s*=\s*|sample(?:\s+size)?\s+(?:of\s+)?)([\d,]+)\b', 1), ',', '') AS sample_size, len(list_filter(" + SQL_SENTENCES.format(c="abstract") + r", lambda x: regexp_matches(x, '(?i)(?:\b\d+(?:\.\d+)?\s*%|\bp\s*[<=>]\s*0?\.\d+|\b(?:OR|RR|HR|MD|SMD)\s*[=:]\s*-?\d+(?:\.\d+)?|\b95\s*%\s*CI\b)'))[1:5]) AS n_effects FROM paper_records")
def sf_29(spark, sf):
    effects = F.slice(F.filter(fx.sentences(F.col("abstract")), lambda s: s.rlike(fx.EFFECT)), 1, 5)
    return _papers(spark, sf, "abstract").select(
        "record_id", F.replace(F.regexp_extract(F.coalesce("abstract", F.lit("")), fx.SAMPLE_SIZE, 1), F.lit(","), F.lit("")).alias("sample_size"), F.size(effects).alias("n_effects")
    )


@register("sf_31_tolerant_casts", "SELECT record_id, TRY_CAST(left(publication_date, 4) AS INTEGER) AS year_of_date, TRY_CAST(pmid AS BIGINT) AS pmid_number, TRY_CAST(venue AS DOUBLE) AS not_a_number FROM paper_records")
def sf_31(spark, sf):
    return _papers(spark, sf, "publication_date", "pmid", "venue").select(
        "record_id",
        F.expr("try_cast(left(publication_date, 4) as int)").alias("year_of_date"),
        F.expr("try_cast(pmid as bigint)").alias("pmid_number"),
        F.expr("try_cast(venue as double)").alias("not_a_number"),
    )


@register("sf_38_text_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents")
def sf_38(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))


@register("sf_45_cited_numbers", r"""
WITH g AS (SELECT evidence_id, string_split(x, ',') AS parts FROM (SELECT evidence_id, unnest(regexp_extract_all(coalesce(text, ''), '\[(\d{1,4}(?:\s*[-–,]\s*\d{1,4})*)\]', 1)) AS x FROM evidence_records)),
p AS (SELECT evidence_id, trim(unnest(parts)) AS p FROM g),
n AS (SELECT evidence_id, CAST(regexp_extract(p, '^\d+') AS INT) AS lo, CAST(regexp_extract(p, '\d+$') AS INT) AS hi FROM p)
SELECT DISTINCT evidence_id, unnest(range(lo, hi + 1))::INT AS cited FROM n WHERE hi >= lo AND hi - lo <= 1000
""")  # fmt: skip
def sf_45(spark, sf):
    return table(spark, sf, "evidence_records").select("evidence_id", F.explode(fx.cited_numbers(F.col("text"))).alias("cited"))


@register("sf_46_projection_text", r"SELECT record_id, trim(lower(regexp_replace(coalesce(venue, ''), '\s+', ' ', 'g'))) AS projected FROM paper_records")
def sf_46(spark, sf):
    return _papers(spark, sf, "venue").select("record_id", F.trim(F.lower(F.regexp_replace(F.coalesce("venue", F.lit("")), r"\s+", " "))).alias("projected"))


@register("sf_51_slug", "SELECT record_id, regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM paper_records")
def sf_51(spark, sf):
    return _papers(spark, sf, "title").select("record_id", fx.slug(F.col("title")).alias("slug"))


@register("flt_01_retraction", "SELECT record_id, CASE WHEN coalesce(is_retracted, false) THEN 'retracted' ELSE 'eligible' END AS status FROM paper_records")
def flt_01(spark, sf):
    return _papers(spark, sf, "is_retracted").select("record_id", F.when(F.coalesce("is_retracted", F.lit(False)), "retracted").otherwise("eligible").alias("status"))


@register("flt_02_preprint", f"SELECT record_id FROM paper_records WHERE {SQL_PREPRINT}")
def flt_02(spark, sf):
    return table(spark, sf, "paper_records").where(fx.is_preprint()).select("record_id")


@register("flt_03_stable_identifier", f"SELECT record_id, {_SQL_HAS_ID} AS any_of_six, ({' OR '.join(f"coalesce({c}, '') <> ''" for _, c in _ID_COLUMNS[:-1])}) AS any_of_five FROM paper_records")
def flt_03(spark, sf):
    return table(spark, sf, "paper_records").select("record_id", fx.has_identifier().alias("any_of_six"), fx.has_identifier(False).alias("any_of_five"))


@register("flt_04_meaningful", r"""
SELECT record_id FROM (SELECT record_id, trim(regexp_replace(coalesce(venue, ''), '[*_`]', '', 'g')) AS v FROM paper_records)
WHERE v <> '' AND NOT regexp_matches(v, '(?i)\b(TBD|TODO|FIXME)\b|\{\{[^}]*\}\}|<[^>]*placeholder[^>]*>|待补充|待定') AND lower(v) NOT IN ('-', 'n/a', 'na', 'none', 'null', 'unknown', 'tbd', 'todo')
""")  # fmt: skip
def flt_04(spark, sf):
    return _papers(spark, sf, "venue").where(fx.is_meaningful(F.col("venue"))).select("record_id")


@register("flt_08_internal_ids", r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\b[A-Z]{1,4}-\d{2,}\b')) AS found_id FROM documents")
def flt_08(spark, sf):
    ids = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b[A-Z]{1,4}-\d{2,}\b"), F.lit(0)))
    return table(spark, sf, "documents").select("doc_id", F.explode(ids).alias("found_id"))


@register("flt_10_conflict_wording", f"SELECT record_id FROM paper_records WHERE {' OR '.join(f"contains(lower(coalesce(abstract, '')), '{w}')" for w in fx.CONFLICT_WORDS)}")
def flt_10(spark, sf):
    return _papers(spark, sf, "abstract").where(fx.any_of(fx.lower_text(F.col("abstract")), fx.CONFLICT_WORDS)).select("record_id")


@register("flt_12_redact_url", r"SELECT record_id, regexp_replace(url || '?api_key=abc&q=1&mailto=me@x.org', '(?i)([?&](?:api_?key|key|token|access_token|mailto|email|secret|password)=)[^&#]*', '\1***', 'g') AS redacted FROM paper_records WHERE url IS NOT NULL")
def flt_12(spark, sf):
    return _papers(spark, sf, "url").where("url is not null").select("record_id", fx.redact_url(F.concat("url", F.lit("?api_key=abc&q=1&mailto=me@x.org"))).alias("redacted"))


@register("prj_08_field_sources", "SELECT record_id, unnest([f FOR f IN ['title', 'venue', 'doi', 'abstract'] IF f IS NOT NULL]) AS field, provider FROM paper_records WHERE false UNION ALL SELECT record_id, 'title', provider FROM paper_records WHERE coalesce(title, '') <> '' UNION ALL SELECT record_id, 'venue', provider FROM paper_records WHERE coalesce(venue, '') <> '' UNION ALL SELECT record_id, 'doi', provider FROM paper_records WHERE coalesce(doi, '') <> '' UNION ALL SELECT record_id, 'abstract', provider FROM paper_records WHERE coalesce(abstract, '') <> ''")
def prj_08(spark, sf):
    names = ["title", "venue", "doi", "abstract"]
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.col(n), F.lit("")))])
    kept = F.map_filter(pairs, lambda k, v: v != "")
    return _papers(spark, sf, "provider", *names).select("record_id", F.explode(F.map_keys(kept)).alias("field"), "provider")


@register("prj_13_ordinal_ids", "SELECT source_type, format('CTX-{:03d}', row_number() OVER (ORDER BY source_type)) AS context_id FROM (SELECT DISTINCT source_type FROM evidence_records WHERE source_type IS NOT NULL)")
def prj_13(spark, sf):
    from pyspark.sql.window import Window

    kinds = table(spark, sf, "evidence_records").select("source_type").where("source_type is not null").distinct()  # a closed vocabulary
    return kinds.select("source_type", F.format_string("CTX-%03d", F.row_number().over(Window.orderBy("source_type"))).alias("context_id"))
