"""Identifiers, keys, cells, paths and links as queries over the tables that hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.functions import identifiers as ix
from litloom.registry import register
from litloom.runtime import table


def _papers(spark, sf, *columns):
    return table(spark, sf, "paper_records").select("record_id", *columns)


SQL_BALANCED = "substring({s}, 1, (length({s}) - greatest(0, least(length(regexp_extract({s}, '\\)*$')), (length({s}) - length(replace({s}, ')', ''))) - (length({s}) - length(replace({s}, '(', ''))))))::BIGINT)"

_IDENTIFIER_SQL = r"""
WITH v AS (SELECT record_id, url_decode(trim(coalesce(doi, url, ''))) AS v FROM paper_records),
d AS (SELECT record_id, v, regexp_replace(regexp_extract(v, '(?i)10\.\d{4,9}/[^\s<>"|;,]+'), '[.\]}]+$', '') AS doi,
  regexp_extract(v, '(?i)(?:arxiv\s*:\s*|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5}(?:v\d+)?)', 1) AS arxiv, regexp_extract(v, '(?i)pmid\s*:?\s*(\d+)', 1) AS pmid FROM v)
SELECT record_id, CASE WHEN doi <> '' THEN 'doi:' || lower(BALANCED) WHEN arxiv <> '' THEN 'arxiv:' || lower(arxiv) WHEN pmid <> '' THEN 'pmid:' || pmid
  ELSE lower(regexp_replace(regexp_replace(v, '\s+', ' ', 'g'), '/+$', '')) END AS identifier FROM d
""".replace("BALANCED", SQL_BALANCED.replace("{s}", "doi"))


@register("sf_39_identifier", _IDENTIFIER_SQL)
def sf_39(spark, sf):
    """The normal identifier of each record, from its DOI or else its address."""
    return _papers(spark, sf, ix.normalize_identifier(F.coalesce("doi", "url")).alias("identifier"))


_IDENTITY_SQL = r"""
WITH v AS (SELECT entry_id, lower(trim(url_decode(coalesce(doi, title, '')))) AS v FROM library_entries),
d AS (SELECT entry_id, v, regexp_replace(regexp_extract(v, '10\.\d{4,9}/[^\s<>|#;]+'), '[.,\]}"]+$', '') AS doi, regexp_extract(v, '(?:arxiv[:/]|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5})(?:v\d+)?', 1) AS arxiv FROM v)
SELECT entry_id, CASE WHEN doi <> '' THEN 'doi:' || BALANCED WHEN arxiv <> '' THEN 'arxiv:' || arxiv ELSE regexp_replace(v, '/+$', '') END AS identity FROM d
""".replace("BALANCED", SQL_BALANCED.replace("{s}", "doi"))


@register("sf_40_identity", _IDENTITY_SQL)
def sf_40(spark, sf):
    """The identity of each typed entry, from its DOI or else its title."""
    return table(spark, sf, "library_entries").select("entry_id", ix.normalize_identity(F.coalesce("doi", "title")).alias("identity"))


@register("sf_41_source_link", r"""
WITH v AS (SELECT record_id, coalesce(doi, url, '') AS v FROM paper_records),
r AS (SELECT record_id, regexp_extract(v, '(?i)10\.\d{4,9}/[^\s)>]+') AS doi,
  regexp_replace(CASE WHEN regexp_extract(v, '(?i)https?://[^\s)>]+') <> '' THEN regexp_extract(v, '(?i)https?://[^\s)>]+') ELSE trim(v) END, '[.,;\]]+$', '') AS raw FROM v),
h AS (SELECT *, regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+') AS head FROM r)
SELECT record_id, CASE WHEN doi <> '' THEN 'https://doi.org/' || lower(regexp_replace(doi, '[.,;\]]+$', '')) ELSE lower(head) || substring(raw, length(head) + 1) END AS link FROM h
""")  # fmt: skip
def sf_41(spark, sf):
    return _papers(spark, sf, ix.source_link(F.coalesce("doi", "url")).alias("link"))


@register("sf_43_cell_ids", r"""
SELECT doc_id, id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\b[A-Z]{1,4}-\d{1,6}\b')) AS id FROM documents) GROUP BY ALL
""")  # fmt: skip
def sf_43(spark, sf):
    """Every typed id that a document names, and how often."""
    return table(spark, sf, "documents").select("doc_id", F.explode(ix.cell_ids(F.col("text"))).alias("id")).groupBy("doc_id", "id").agg(F.count("*").alias("n"))


@register("sf_44_split_multi", r"""
SELECT record_id, part, count(*) AS n FROM (SELECT record_id, trim(unnest(string_split_regex(coalesce(venue, ''), '[,;/]+'))) AS part FROM paper_records) WHERE part <> '' GROUP BY ALL
""")  # fmt: skip
def sf_44(spark, sf):
    return _papers(spark, sf, F.explode(ix.split_multi(F.col("venue"))).alias("part")).groupBy("record_id", "part").agg(F.count("*").alias("n"))


@register("sf_47_chain_ids", r"""
WITH c AS (SELECT evidence_id, 'chains=' || CASE WHEN doc_id IS NULL THEN 'unknown' ELSE 'ec-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ', EC-' || lpad(CAST(page_number % 1000 AS VARCHAR), 3, '0') END
  || '; basis=' || coalesce(locator, 'not known') AS cell FROM evidence_records),
p AS (SELECT evidence_id, upper(regexp_extract(cell, '(?i)^\s*chains\s*=\s*([^;]*);', 1)) AS listed, trim(regexp_replace(regexp_replace(cell, '(?i)^\s*chains\s*=\s*[^;]*;', ''), '(?i)^\s*basis\s*=\s*', '')) AS basis FROM c WHERE cell IS NOT NULL)
SELECT evidence_id, array_to_string(list_sort(list_distinct(regexp_extract_all(listed, 'EC-\d{3}'))), ',') AS chains FROM p
WHERE len(regexp_extract_all(listed, 'EC-\d{3}')) > 0 AND trim(regexp_replace(basis, '(?i)^\s*basis\s*=\s*', '')) <> '' AND NOT regexp_matches(trim(regexp_replace(basis, '(?i)^\s*basis\s*=\s*', '')), '(?i)^(?:unknown|none|pending|tbd|not[- ](?:known|available|documented))\b')
""")  # fmt: skip
def sf_47(spark, sf):
    """Chains of the evidence rows that name any, from a cell made of document, page and locator."""
    number = lambda c: F.lpad((F.col(c) % 1000).cast("string"), 3, "0")
    cell = F.concat(F.lit("chains="), F.when(F.col("doc_id").isNull(), "unknown").otherwise(F.concat(F.lit("ec-"), number("doc_id"), F.lit(", EC-"), number("page_number"))), F.lit("; basis="), F.coalesce("locator", F.lit("not known")))
    return table(spark, sf, "evidence_records").select("evidence_id", ix.chain_ids(cell).alias("c")).where("c is not null").select("evidence_id", F.array_join("c", ",").alias("chains"))


@register("sf_48_evidence_window", r"""
WITH v AS (SELECT record_id, trim(coalesce(publication_date, '')) || '..' || CASE WHEN year IS NULL THEN '' ELSE CAST(year AS VARCHAR) END AS w FROM paper_records),
p AS (SELECT record_id, trim(regexp_extract(w, '^(.*?)\.\.', 1)) AS a, trim(regexp_extract(w, '^.*?\.\.(.*)$', 1)) AS b FROM v),
e AS (SELECT record_id, b, CASE WHEN a = '' THEN DATE '2019-01-01' WHEN regexp_full_match(a, '\d{4}') THEN TRY_CAST(a || '-01-01' AS DATE) WHEN regexp_full_match(a, '\d{4}-\d{2}') THEN TRY_CAST(a || '-01' AS DATE)
  WHEN regexp_full_match(a, '\d{4}-\d{2}-\d{2}') THEN TRY_CAST(a AS DATE) END AS s,
  CASE WHEN b = '' OR b = '2024' THEN DATE '2024-06-30' WHEN regexp_full_match(b, '\d{4}') THEN TRY_CAST(b || '-12-31' AS DATE) END AS t FROM p)
SELECT record_id, CAST(s AS VARCHAR) AS start, CAST(t AS VARCHAR) AS "end", coalesce(s <= t AND t <= DATE '2024-06-30', false) AS valid FROM e
""")  # fmt: skip
def sf_48(spark, sf):
    """Windows from the publication date to the stated year, as of 30 June 2024."""
    window = ix.evidence_window(F.concat(F.trim(F.coalesce("publication_date", F.lit(""))), F.lit(".."), F.coalesce(F.col("year").cast("string"), F.lit(""))), F.lit("2024-06-30").cast("date"))
    return _papers(spark, sf, window.alias("w")).select("record_id", F.col("w.start").cast("string").alias("start"), F.col("w.end").cast("string").alias("end"), "w.valid")


@register("sf_49_schema_version", r"""
SELECT parsed_id, TRY_CAST(regexp_extract(p, '^(\d{1,9})\.(\d{1,9})$', 1) AS INTEGER) AS major, TRY_CAST(regexp_extract(p, '^(\d{1,9})\.(\d{1,9})$', 2) AS INTEGER) AS minor,
  coalesce(regexp_full_match(p, '\d{1,9}\.\d{1,9}') AND (TRY_CAST(regexp_extract(p, '^(\d{1,9})', 1) AS INTEGER), TRY_CAST(regexp_extract(p, '^\d{1,9}\.(\d{1,9})', 1) AS INTEGER)) >= (1, 2), false) AS at_least_1_2
FROM (SELECT parsed_id, coalesce(regexp_extract(parser_version, '^\d+\.\d+'), '') AS p FROM parsed_documents)
""")  # fmt: skip
def sf_49(spark, sf):
    """Major and minor part of each parser's version, and whether it is 1.2 or later."""
    d = table(spark, sf, "parsed_documents").select("parsed_id", ix.schema_version(F.regexp_extract(F.coalesce("parser_version", F.lit("")), r"^\d+\.\d+", 0)).alias("v"))
    later = (F.col("v.major") > 1) | ((F.col("v.major") == 1) & (F.col("v.minor") >= 2))
    return d.select("parsed_id", "v.major", "v.minor", F.coalesce(later, F.lit(False)).alias("at_least_1_2"))


SQL_KEY = "regexp_replace(coalesce(authors[1], ''), '_', ' ', 'g') || '_' || regexp_replace(coalesce(venue, ''), '_', ' ', 'g') || '_' || coalesce(CAST(year AS VARCHAR), '') || CASE WHEN is_retracted THEN '_b' ELSE '' END"


def _key():
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "_", " ")
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    return F.concat(clean(F.get("authors", F.lit(0))), F.lit("_"), clean(F.col("venue")), F.lit("_"), year, F.when(F.coalesce("is_retracted", F.lit(False)), "_b").otherwise(""))


@register("sf_52_key_errors", r"""
WITH k AS (SELECT record_id, KEY AS k FROM paper_records),
b AS (SELECT record_id, k, string_split(regexp_replace(k, '^([^_]*_[^_]*_[^_]*)_[a-z]$', '\1'), '_') AS p FROM k),
c AS (SELECT record_id, [CASE WHEN k <> trim(k) OR contains(k, '  ') OR contains(k, chr(9)) THEN 'spacing' END, CASE WHEN len(p) <> 3 THEN 'parts' END, CASE WHEN len(p) = 3 AND (p[1] = '' OR p[2] = '') THEN 'empty' END,
  CASE WHEN len(p) = 3 AND NOT contains(trim(p[1]), ' ') THEN 'one-name' END, CASE WHEN len(p) = 3 AND regexp_matches(p[1], '(^|\s)[A-Za-z](\s|$)') THEN 'initial' END, CASE WHEN len(p) = 3 AND NOT regexp_full_match(p[3], '\d{4}') THEN 'year' END,
  CASE WHEN len(p) = 3 AND (regexp_matches(p[1], '[^\p{L}\p{M}\p{N} \-''’]') OR regexp_matches(p[2], '[^\p{L}\p{M}\p{N} \-''’]')) THEN 'punctuation' END] AS e FROM b)
SELECT record_id, array_to_string(list_sort(list_filter(e, lambda x: x IS NOT NULL)), ',') AS errors FROM c
""".replace("KEY", SQL_KEY))  # fmt: skip
def sf_52(spark, sf):
    """What is wrong with the citation key that first author, venue and year make."""
    return table(spark, sf, "paper_records").select("record_id", F.array_join(ix.key_errors(_key()), ",").alias("errors"))


@register("hlp_09_collision_key", rf"SELECT record_id, regexp_replace(k, '^([^_]*_[^_]*_[^_]*)_[a-z]$', '\1') AS base, nullif(regexp_extract(k, '^[^_]*_[^_]*_[^_]*_([a-z])$', 1), '') AS suffix FROM (SELECT record_id, {SQL_KEY} AS k FROM paper_records)")
def hlp_09(spark, sf):
    """Base and collision suffix of each citation key."""
    return table(spark, sf, "paper_records").select("record_id", ix.key_base(_key()).alias("base"), ix.key_suffix(_key()).alias("suffix"))


_NAMESPACE_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ix.NAMESPACES.items())


@register("sf_54_namespace", rf"SELECT CASE p {_NAMESPACE_CASES} ELSE 'unknown' END AS namespace, count(*) AS n FROM (SELECT string_split(i, '-')[1] AS p FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\b[A-Z]{{1,4}}-\d{{1,6}}\b')) AS i FROM documents)) GROUP BY 1")
def sf_54(spark, sf):
    """What the typed ids in documents stand for."""
    ids = table(spark, sf, "documents").select(F.explode(ix.cell_ids(F.col("text"))).alias("id"))
    return ids.groupBy(ix.namespace(F.col("id")).alias("namespace")).agg(F.count("*").alias("n"))


_RISK_SQL = "[" + ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{risk}' END" for risk, words in ix.PATH_RISKS) + "]"


@register("sf_55_path_risks", f"SELECT record_id, array_to_string(list_filter({_RISK_SQL}, lambda x: x IS NOT NULL), ',') AS risks FROM (SELECT record_id, lower(coalesce(url, '') || ' ' || coalesce(title, '')) AS low FROM paper_records)")
def sf_55(spark, sf):
    """Risk tags of address and title, read as a path."""
    return _papers(spark, sf, F.array_join(ix.path_risks(F.concat_ws(" ", F.coalesce("url", F.lit("")), F.coalesce("title", F.lit("")))), ",").alias("risks"))


_SENTINEL_SQL = ", ".join(f"'{s}'" for s in ix.SENTINELS)


@register("flt_05_scope_rationale", rf"SELECT entry_id, b <> '' AND b NOT IN ({_SENTINEL_SQL}) AS explains FROM (SELECT entry_id, lower(regexp_replace(coalesce(note, ''), '[^\p{{L}}\p{{N}}]+', '', 'g')) AS b FROM library_entries)")
def flt_05(spark, sf):
    return table(spark, sf, "library_entries").select("entry_id", ix.scope_rationale(F.col("note")).alias("explains"))


CLAIM = r"(?i)\b(?:first|never|always|only|no one|unprecedented|novel|unique|conclude)\b|首次|首个|前所未有"
PROHIBITION = r"(?i)\b(?:do not|don't|must not|never)\s+(?:claim|infer|treat|state|say)\b|\b(?:forbidden|prohibited)\b|禁止|不得|不可|不要(?:声称|推断)|不能(?:声称|推断)"


@register("flt_07_priority_claims", f"""
SELECT doc_id, trim(line) AS line, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r')) AS line FROM documents)
WHERE regexp_matches(line, '{CLAIM}') AND NOT regexp_matches(line, '{PROHIBITION.replace("'", "''")}') GROUP BY ALL
""")  # fmt: skip
def flt_07(spark, sf):
    """Lines that claim priority without bounds and do not forbid the claim."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).alias("line"))
    return lines.where(F.col("line").rlike(CLAIM) & ~F.col("line").rlike(PROHIBITION)).groupBy("doc_id", F.trim("line").alias("line")).agg(F.count("*").alias("n"))


_REVIEW_SQL = "'review=' || CASE WHEN direct_evidence THEN 'Independent' ELSE 'self' END || '; reviewer = ' || coalesce(source_id, 'none') || ';basis=' || coalesce(locator, 'tbd (later)')"


@register("flt_09_independent_review", r"""
SELECT evidence_id, coalesce(direct_evidence, false) AND trim(coalesce(source_id, 'none')) <> '' AND NOT regexp_matches(trim(coalesce(source_id, 'none')), '(?i)^(?:unknown|none|pending|tbd)\b')
  AND trim(coalesce(locator, 'tbd (later)')) <> '' AND NOT regexp_matches(trim(coalesce(locator, 'tbd (later)')), '(?i)^(?:unknown|none|pending|tbd)\b') AS reviewed FROM evidence_records
""")  # fmt: skip
def flt_09(spark, sf):
    """Whether a review cell made of flag, source and locator is an attributable independent review."""
    cell = F.concat(F.lit("review="), F.when(F.coalesce("direct_evidence", F.lit(False)), "Independent").otherwise("self"), F.lit("; reviewer = "), F.coalesce("source_id", F.lit("none")), F.lit(";basis="), F.coalesce("locator", F.lit("tbd (later)")))
    return table(spark, sf, "evidence_records").select("evidence_id", ix.independently_reviewed(cell).alias("reviewed"))


@register("flt_13_redacted_arguments", r"""
SELECT record_id, '--title ' || coalesce(title, '') || ' --api-key=[REDACTED] --token [REDACTED] --provider ' || provider AS args FROM paper_records
WHERE NOT regexp_matches(lower(coalesce(title, '')), 'token|password|secret|api-?key') AND provider IS NOT NULL
UNION ALL SELECT record_id, '--title ' || title || ' [REDACTED] --token [REDACTED] --provider ' || provider FROM paper_records
WHERE regexp_matches(lower(title), 'token|password|secret|api-?key') AND NOT contains(title, '=') AND provider IS NOT NULL
UNION ALL SELECT record_id, '--title ' || string_split(title, '=')[1] || '=[REDACTED] --api-key=[REDACTED] --token [REDACTED] --provider ' || provider FROM paper_records
WHERE regexp_matches(lower(title), 'token|password|secret|api-?key') AND contains(title, '=') AND provider IS NOT NULL
""")  # fmt: skip
def flt_13(spark, sf):
    """A command line made of each record, with its secrets hidden."""
    args = F.array(F.lit("--title"), F.coalesce("title", F.lit("")), F.concat(F.lit("--api-key="), F.coalesce("doi", F.lit("x"))), F.lit("--token"), F.coalesce("openalex_id", F.lit("y")), F.lit("--provider"), F.col("provider"))
    return table(spark, sf, "paper_records").where("provider is not null").select("record_id", F.array_join(ix.redacted_arguments(args), " ").alias("args"))


@register("flt_14_safe_path", r"""
SELECT parsed_id, p <> '' AND p = trim(p) AND len(list_filter(string_split(replace(p, '\', '/'), '/'), lambda s: s IN ('', '.', '..') OR contains(s, ':'))) = 0 AS safe
FROM (SELECT parsed_id, CASE WHEN record_id IS NULL THEN coalesce(url, '') ELSE regexp_replace(coalesce(url, ''), '^[a-z]+://', '') END AS p FROM parsed_documents)
""")  # fmt: skip
def flt_14(spark, sf):
    """Whether the address of a document, without its scheme where a record is known, would be a safe path."""
    path = F.when(F.col("record_id").isNull(), F.coalesce("url", F.lit(""))).otherwise(F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-z]+://", ""))
    return table(spark, sf, "parsed_documents").select("parsed_id", ix.safe_path(path).alias("safe"))


@register("flt_15_public_url", r"""
SELECT source_id, coalesce(regexp_matches(homepage, '(?i)^https?://[^/?#@]+([/?#]|$)') AND NOT regexp_matches(homepage, '[\\\x00-\x1f\x7f]')
  AND NOT regexp_matches(lower(homepage), '^https?://(localhost|[^/?#:]*\.localhost|10\.\d+\.\d+\.\d+|127\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+)([:/?#]|$)'), false) AS public FROM evidence_sources
""")  # fmt: skip
def flt_15(spark, sf):
    return table(spark, sf, "evidence_sources").select("source_id", ix.public_url(F.col("homepage")).alias("public"))


@register("flt_17_watch_hits", r"""
SELECT parsed_id, url FROM parsed_documents WHERE url = 'https://archive.example.net/00' OR starts_with(url, 'https://archive.example.net/00/') OR url = 'https://reader.example.net' OR starts_with(url, 'https://reader.example.net/')
""")  # fmt: skip
def flt_17(spark, sf):
    """Documents below the watched addresses."""
    return table(spark, sf, "parsed_documents").where(ix.watched(F.col("url"), ["https://archive.example.net/00/", "https://reader.example.net"])).select("parsed_id", "url")


@register("jn_24_identity_join", r"""
WITH i AS (SELECT entry_id, lower(trim(url_decode(coalesce(doi, '')))) AS v FROM library_entries), p AS (SELECT record_id, lower(trim(url_decode(coalesce(doi, '')))) AS v FROM paper_records),
a AS (SELECT entry_id, regexp_replace(regexp_extract(v, '10\.\d{4,9}/[^\s<>|#;]+'), '[.,\]}"]+$', '') AS d FROM i), b AS (SELECT record_id, regexp_replace(regexp_extract(v, '10\.\d{4,9}/[^\s<>|#;]+'), '[.,\]}"]+$', '') AS d FROM p)
SELECT DISTINCT entry_id, record_id FROM (SELECT entry_id, ABAL AS d FROM a WHERE d <> '') JOIN (SELECT record_id, BBAL AS d FROM b WHERE d <> '') USING (d)
""".replace("ABAL", SQL_BALANCED.replace("{s}", "d")).replace("BBAL", SQL_BALANCED.replace("{s}", "d")))  # fmt: skip
def jn_24_identity(spark, sf):
    """Entries and records that name one DOI, whatever its writing."""
    side = lambda name, key: table(spark, sf, name).select(key, ix.normalize_identity(F.col("doi")).alias("identity")).where(F.startswith("identity", F.lit("doi:")))
    return side("library_entries", "entry_id").join(side("paper_records", "record_id"), "identity").select("entry_id", "record_id").distinct()
