"""Plans of questions: every title or text of a table is taken as a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.catalogue.scalars import SQL_DOI
from litloom.plans import columns as pc
from litloom.plans import lexicon as lx
from litloom.registry import register
from litloom.runtime import table


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _titles(spark, sf):
    return table(spark, sf, "paper_records").select("record_id", "title")


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


SQL_TERMS = f"list_filter(list_transform(regexp_extract_all(coalesce({{c}}, ''), '[A-Za-z][A-Za-z0-9-]{{{{2,}}}}'), lambda w: lower(w)), lambda w: NOT list_contains({_list(lx.ENGLISH_STOPWORDS)}, w))"


def sql_terms(column: str) -> str:
    """Distinct terms in the order of their first appearance, at most twelve."""
    found = SQL_TERMS.format(c=column).replace("{{", "{").replace("}}", "}")
    return f"list_filter({found}, lambda w, i: list_position({found}, w) = i)[1:12]"


@register("sf_13_normal_question")
def sf_13(spark, sf):
    """Titles with compatibility forms folded, control characters and white space collapsed."""
    return _titles(spark, sf).select("record_id", pc.nfkc(F.col("title")).alias("question"))


_IDS_SQL = (
    "SELECT doc_id, " + SQL_DOI.format(c="text") + r" AS doi, CASE WHEN regexp_extract(coalesce(text, ''), '(?i)\bPMC(?:ID)?\s*[:#-]?\s*(\d+)\b', 1) <> '' THEN 'PMC' || regexp_extract(text, '(?i)\bPMC(?:ID)?\s*[:#-]?\s*(\d+)\b', 1) ELSE '' END AS pmcid,"
    r" regexp_extract(coalesce(text, ''), '(?i)\bPMID\s*[:#-]?\s*(\d+)\b', 1) AS pmid, regexp_extract(coalesce(text, ''), '(?i)\barXiv\s*:\s*((?:\d{4}\.\d{4,5})|(?:[a-z-]+/\d{7}))\b', 1) AS arxiv FROM documents"
)


_NAMED = "concat_ws(' ', title, doi, 'PMID: ' || pmid, pmcid, 'arXiv:' || arxiv_id)"
_NAMED_SQL = _IDS_SQL.replace("doc_id", "record_id").replace("FROM documents", f"FROM (SELECT record_id, {_NAMED} AS text FROM paper_records)")


@register("sf_15_identifiers", f"SELECT * FROM ({_NAMED_SQL}) WHERE doi || pmcid || pmid || arxiv <> ''")
def sf_15(spark, sf):
    """Identifiers in questions made of each record's title and ids."""
    papers = table(spark, sf, "paper_records")
    text = F.concat_ws(" ", "title", "doi", F.concat(F.lit("PMID: "), "pmid"), "pmcid", F.concat(F.lit("arXiv:"), "arxiv_id"))
    found = papers.select("record_id", *[v.alias(k) for k, v in pc.identifiers(text).items()])
    return found.where(F.concat("doi", "pmcid", "pmid", "arxiv") != "")


@register("sf_16_english_terms", f"SELECT record_id, array_to_string({sql_terms('title')}, ' ') AS terms FROM paper_records")
def sf_16(spark, sf):
    return _titles(spark, sf).select("record_id", F.array_join(pc.english_terms(F.col("title")), " ").alias("terms"))


_WORKING = "coalesce(text, '')"
for _word in lx.CHINESE_FUNCTION_WORDS:
    _WORKING = f"replace({_WORKING}, '{_word}', ' ')"
_ZH = "list_concat(list_filter(" + _list(zh for zh, _ in lx.CHINESE_TERMS) + f", lambda t: contains(coalesce(text, ''), t)), regexp_extract_all({_WORKING}, '[㐀-䶿一-鿿]{{2,20}}'))".replace("{{", "{").replace("}}", "}")


@register("sf_17_chinese_terms", f"SELECT doc_id, array_to_string(list_filter(t, lambda w, i: list_position(t, w) = i)[1:12], ' ') AS terms FROM (SELECT doc_id, {_ZH} AS t FROM documents) WHERE len(t) > 0")
def sf_17(spark, sf):
    """Chinese terms of the documents that hold any."""
    return _documents(spark, sf).select("doc_id", pc.chinese_terms(F.col("text")).alias("t")).where(F.size("t") > 0).select("doc_id", F.array_join("t", " ").alias("terms"))


_CATEGORY_SQL = ", ".join(f"array_to_string(list_filter({_list(words)}, lambda t: contains(lower(coalesce(text, '')), t))[1:12], ',') AS {name}" for name, words in lx.CATEGORIES.items())


@register("sf_18_category_terms", f"SELECT doc_id, {_CATEGORY_SQL} FROM documents")
def sf_18(spark, sf):
    return _documents(spark, sf).select("doc_id", *[F.array_join(pc.category_terms(F.col("text"), name), ",").alias(name) for name in lx.CATEGORIES])


_EXPANSION = "list_sort(list_filter([" + ", ".join(f"{{'place': instr(coalesce(text, ''), '{zh}'), 'longer': {-len(zh)}, 'term': '{en}'}}" for zh, en in lx.CHINESE_TERMS) + "], lambda e: e.place > 0))"


@register("sf_19_english_expansion", f"SELECT doc_id, array_to_string(list_filter(t, lambda w, i: list_position(t, w) = i)[1:10], ' ') AS expansion FROM (SELECT doc_id, list_transform({_EXPANSION}, lambda e: e.term) AS t FROM documents) WHERE len(t) > 0")
def sf_19(spark, sf):
    """English terms for the Chinese ones of documents (and the order in which the question names them, ORD-05)."""
    return _documents(spark, sf).select("doc_id", pc.english_expansion(F.col("text")).alias("expansion")).where("expansion <> ''")


@register("sf_20_english_status", rf"""
WITH q AS (SELECT doc_id, title, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) AS q FROM documents),
r AS (SELECT doc_id, title, CASE WHEN q = '' THEN 'empty after normalization' WHEN length(q) > 512 THEN 'exceeds 512 characters' WHEN regexp_matches(q, '[㐀-䶿一-鿿]') THEN 'contains CJK text'
  WHEN len({sql_terms('q')}) < 2 THEN 'fewer than two English content terms' ELSE '' END AS reason FROM q)
SELECT doc_id, CASE WHEN title IS NULL THEN 'not-supplied' WHEN reason <> '' THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN title IS NULL THEN '' ELSE reason END AS reason FROM r
""")  # fmt: skip
def sf_20(spark, sf):
    """Whether the title of each document would do as the English form of a question."""
    return table(spark, sf, "documents").select("doc_id", pc.english_status(F.col("title")).alias("s")).select("doc_id", "s.status", "s.reason")


_INTENT_SQL = "['broad-discovery', " + ", ".join("CASE WHEN len(list_filter(" + _list(words) + f", lambda w: contains(low, w))) > 0 THEN '{name}' END" for name, words in lx.INTENTS.items()) + ", 'evidence-coverage']"


@register("sf_21_intents", f"SELECT doc_id, array_to_string(list_filter({_INTENT_SQL}, lambda x: x IS NOT NULL), ',') AS intents FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)")
def sf_21(spark, sf):
    return _documents(spark, sf).select("doc_id", F.array_join(pc.intents(F.col("text")), ",").alias("intents"))


_ROUTE_CASE = f"CASE WHEN doi || pmcid || pmid || arxiv <> '' THEN 'identifier' WHEN len(list_filter({_list(lx.BIOMEDICAL)}, lambda w: contains(lower(coalesce(d.text, '')), w))) > 0 THEN 'biomedical' ELSE 'general' END"
_ROUTES_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, '{p}' AS provider, {k} AS priority, {min(lx.REQUEST_LIMIT, lx.PROVIDER_BUDGETS[p])} AS budget" for kind, ps in lx.ROUTES.items() for k, p in enumerate(ps, 1))


@register("pln_03_provider_route", f"WITH k AS (SELECT i.doc_id, {_ROUTE_CASE} AS kind FROM ({_IDS_SQL}) i JOIN documents d USING (doc_id)), r AS ({_ROUTES_SQL}) SELECT doc_id, provider, priority, budget FROM k JOIN r USING (kind)")
def pln_03(spark, sf):
    """The providers that each document, taken as a question, asks in turn, with their budgets (PLN-05)."""
    return pc.requests(_documents(spark, sf).select("doc_id", pc.route(F.col("text")).alias("kind")), "doc_id", "kind")


_VARIANTS_SQL = rf"""
WITH q AS (SELECT record_id, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) AS text, {SQL_DOI.format(c="title")} AS doi, {sql_terms('title')} AS words FROM paper_records),
v AS (SELECT record_id, list_filter([{{'variant': 'original', 'text': text}}, CASE WHEN doi <> '' THEN {{'variant': 'identifier-doi', 'text': doi}} END,
  CASE WHEN len(words) >= 2 THEN {{'variant': 'terms', 'text': array_to_string(words, ' ')}} END, CASE WHEN len(words) >= 2 THEN {{'variant': 'concept-wide', 'text': array_to_string(words[1:4], ' OR ')}} END], lambda x: x IS NOT NULL) AS v FROM q),
f AS (SELECT record_id, list_filter(v, lambda x, i: len(list_filter(v[1:i-1], lambda u: lower(u.text) = lower(x.text))) = 0) AS f FROM v)
SELECT record_id, position, f[position].variant AS variant, f[position].text AS text FROM (SELECT record_id, f, unnest(range(1, len(f) + 1)) AS position FROM f)
"""


@register("pln_01_variants", _VARIANTS_SQL)
def pln_01_variants(spark, sf):
    """The variants in which each title, taken as a question, is asked."""
    return pc.variants(_titles(spark, sf), "record_id", "title")


@register("rnk_04_question_bounds", r"""
SELECT doc_id, TRY_CAST(regexp_extract(text, '(?i)\b(?:since|after|from)\s+(19\d{2}|20\d{2})\b', 1) AS INTEGER) AS after, TRY_CAST(regexp_extract(text, '(?i)\b(?:before|until|through)\s+(19\d{2}|20\d{2})\b', 1) AS INTEGER) AS before FROM documents
""")  # fmt: skip
def rnk_04(spark, sf):
    """Bounds of the year that a question states in words."""
    return _documents(spark, sf).select("doc_id", pc.year_bounds(F.col("text")).alias("y")).select("doc_id", "y.after", "y.before")


@register("rnk_05_context_values", """
SELECT record_id, array_to_string(list_filter(list_transform(list_concat(string_split_regex(coalesce(venue, ''), '[,;]'), string_split_regex(coalesce(title, ''), '[,;]')), lambda x: trim(x)), lambda x: x <> ''), '|') AS context FROM paper_records
""")  # fmt: skip
def rnk_05(spark, sf):
    return table(spark, sf, "paper_records").select("record_id", F.array_join(pc.context_values(F.col("venue"), F.col("title")), "|").alias("context"))


_PROFILES = {"deep": ("comprehensive", "exhaustive", "systematic review", "全面", "深入"), "quick": ("quick", "brief", "overview", "快速", "简要")}
_NOT = r"(?i)\b(?:not|no|without)\s+(?:a\s+|an\s+)?"


def _signal(low, words):
    hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return hit & ~low.rlike(_NOT + "(?:" + "|".join(words) + ")")


@register("pln_07_profile", "SELECT doc_id, CASE WHEN d AND NOT q THEN 'deep' WHEN q AND NOT d THEN 'quick' ELSE 'standard' END AS profile FROM (SELECT doc_id, " + ", ".join(
    "len(list_filter(" + _list(words) + f", lambda w: contains(low, w))) > 0 AND NOT regexp_matches(low, '{_NOT}(?:{'|'.join(words)})') AS {name[0]}" for name, words in _PROFILES.items()) + " FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents))")
def pln_07(spark, sf):
    """The profile a question asks for in words: a negated signal is none, and contrary ones cancel each other."""
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    d, q = _signal(low, _PROFILES["deep"]), _signal(low, _PROFILES["quick"])
    return _documents(spark, sf).select("doc_id", F.when(d & ~q, "deep").when(q & ~d, "quick").otherwise("standard").alias("profile"))
