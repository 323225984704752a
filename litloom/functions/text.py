"""Scalar functions over text, identifiers and records, as column expressions without Python in the path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "in", "is", "of", "on", "or", "paper", "papers",
    "research", "study", "the", "to", "using", "what", "which", "with",
)

# Publication classes in the order in which they are tried, with the words that make them.
PUBLICATION_CLASSES = (
    ("systematic review", ("systematic review",)),
    ("meta-analysis", ("meta-analysis", "meta analysis")),
    ("randomized controlled trial", ("randomized controlled trial", "randomised controlled trial", " rct ")),
    ("clinical trial", ("clinical trial",)),
    ("cohort study", ("cohort",)),
    ("case-control study", ("case-control", "case control")),
    ("cross-sectional study", ("cross-sectional", "cross sectional")),
    ("methods/protocol", ("protocol", "benchmark", "methodology", "methods paper")),
    ("case report/series", ("case report", "case series")),
    ("review", ("review",)),
)

# Evidence weight of a publication class; others weigh 2.
EVIDENCE_WEIGHTS = {
    "systematic review": 5, "meta-analysis": 5, "randomized controlled trial": 4, "clinical trial": 4, "cohort study": 3, "case-control study": 3,
    "cross-sectional study": 2, "methods/protocol": 2, "review": 2, "case report/series": 1, "primary/other": 2,
}

# Wording of conflicting results and of findings.
CONFLICT_WORDS = ("conflict", "contradict", "no significant", "null result", "did not", "failed to", "inconsistent")
FINDING_WORDS = ("found", "showed", "demonstrated", "associated", "increased", "decreased", "effect", "result", "concluded", "发现", "结果", "表明", "显示")

# Patterns of sample sizes, effects, preprint servers and placeholders.
SAMPLE_SIZE = r"(?i)\b(?:n\s*=\s*|sample(?:\s+size)?\s+(?:of\s+)?)([\d,]+)\b"
EFFECT = r"(?i)(?:\b\d+(?:\.\d+)?\s*%|\bp\s*[<=>]\s*0?\.\d+|\b(?:OR|RR|HR|MD|SMD)\s*[=:]\s*-?\d+(?:\.\d+)?|\b95\s*%\s*CI\b)"
PREPRINT = r"preprint|arxiv\.org|biorxiv\.org|medrxiv\.org"
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"


def lower_text(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """True if one of the words occurs in the text."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, no trailing slash; empty for null."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|campaign|ref)(=|$)"))
    joined = F.array_join(kept, "&")
    return F.when(u == "", "").otherwise(F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))))


def normalize_doi(value: Column) -> Column:
    """The DOI in lower case without resolver and closing marks; empty if there is none."""
    bare = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.lower(F.regexp_replace(F.regexp_extract(bare, DOI, 0), r"[.,;:)\]}]+$", ""))


def normalize_title(value: Column) -> Column:
    """Lower case; everything but ASCII letters and digits becomes single spaces."""
    return F.trim(F.regexp_replace(lower_text(value), r"[^a-z0-9]+", " "))


def short_id(value: Column) -> Column:
    """The last segment of a path-like identifier."""
    return F.element_at(F.split(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"/+$", ""), "/"), -1)


def tokens(text: Column) -> Column:
    """Distinct ASCII words and single CJK characters in lower case, without stop words."""
    found = F.regexp_extract_all(lower_text(text), F.lit(r"[a-z0-9]+|[一-鿿]"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOPWORDS]))


def match_score(needles: list[str], hay: Column) -> Column:
    """Coverage of the needles and precision of the words, weighted 0.85 and 0.15; 0.5 without needles, 0 without words."""
    if not needles:
        return F.lit(0.5)
    wanted = sorted(set(needles))
    both = F.size(F.array_intersect(hay, F.array(*[F.lit(n) for n in wanted])))
    score = F.least(F.lit(1.0), 0.85 * both / F.lit(float(len(wanted))) + 0.15 * both / F.greatest(F.size(hay), F.lit(1)))
    return F.when(F.size(hay) == 0, 0.0).otherwise(score)


def text_match(needles: list[str], text: Column) -> Column:
    """The score of a text; its words are found once."""
    return F.element_at(F.transform(F.array(tokens(text)), lambda hay: match_score(needles, hay)), 1)


def year_score(year: Column, after: int | None = None, before: int | None = None, target: int | None = None) -> Column:
    """1 within the bounds (or at the target), falling with the distance in years; 0.5 unconstrained or without year."""
    if after is None and before is None and target is None:
        return F.lit(0.5)
    if target is not None:
        return F.when(year.isNull(), 0.5).otherwise(1.0 / (1.0 + F.abs(year - F.lit(target))))
    below = F.greatest(F.lit(after) - year, F.lit(0)) if after is not None else F.lit(0)
    above = F.greatest(year - F.lit(before), F.lit(0)) if before is not None else F.lit(0)
    return F.when(year.isNull(), 0.5).otherwise(1.0 / (1.0 + below + above))


IDENTIFIERS = ("doi", "pmid", "pmcid", "openalex_id", "semantic_scholar_id", "arxiv_id")


def has_identifier(include_arxiv: bool = True) -> Column:
    """True if any stable identifier is set; the two readings differ in the arXiv id."""
    names = IDENTIFIERS if include_arxiv else IDENTIFIERS[:-1]
    return F.greatest(*[F.coalesce(F.col(c), F.lit("")) != "" for c in names])


def evidence_score(has_chunks: Column) -> Column:
    """0.45 for an abstract, 0.35 for extracted evidence, 0.10 for an identifier and 0.10 for open access."""
    return F.least(
        F.lit(1.0),
        F.when(F.coalesce(F.col("abstract"), F.lit("")) != "", 0.45).otherwise(0.0)
        + F.when(has_chunks, 0.35).otherwise(0.0)
        + F.when(has_identifier(), 0.10).otherwise(0.0)
        + F.when(F.coalesce(F.col("is_open_access"), F.lit(False)), 0.10).otherwise(0.0),
    )


def identity_keys() -> Column:
    """All keys under which a record may be one with another: identifiers, address, long title with its lead author."""
    keys = [
        F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(prefix + ":"), F.lower(F.col(c))))
        for prefix, c in (("doi", "doi"), ("pmid", "pmid"), ("pmcid", "pmcid"), ("openalex", "openalex_id"), ("s2", "semantic_scholar_id"), ("arxiv", "arxiv_id"), ("url", "url"))
    ]
    title = normalize_title(F.col("title"))
    lead = normalize_title(F.get(F.col("authors"), F.lit(0)))
    authors = F.size(F.coalesce(F.col("authors"), F.array().cast("array<string>")))
    by_author = F.when((F.length(title) >= 20) & (authors > 0) & (lead != ""), F.concat_ws(":", F.lit("title-author"), title, lead))
    alone = F.when((F.length(title) >= 20) & (authors == 0), F.concat_ws(":", F.lit("title-only"), title))
    return F.filter(F.array(*keys, by_author, alone), lambda k: k.isNotNull())


def record_key() -> Column:
    """The first identifier a record has, else its title and first two authors."""
    parts = [
        F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(prefix + ":"), F.lower(F.col(c))))
        for prefix, c in (("doi", "doi"), ("pmid", "pmid"), ("pmcid", "pmcid"), ("openalex", "openalex_id"), ("s2", "semantic_scholar_id"), ("arxiv", "arxiv_id"))
    ]
    two = F.slice(F.coalesce(F.col("authors"), F.array().cast("array<string>")), 1, 2)
    return F.coalesce(*parts, F.concat(F.lit("title:"), normalize_title(F.col("title")), F.lit("|authors:"), F.lower(F.array_join(two, "|"))))


def is_preprint() -> Column:
    """True for an arXiv id or a preprint marker in address, venue or type."""
    where = F.lower(F.concat_ws(" ", F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("venue"), F.lit("")), F.array_join(F.coalesce(F.col("publication_types"), F.array().cast("array<string>")), " ")))
    return (F.coalesce(F.col("arxiv_id"), F.lit("")) != "") | where.rlike(PREPRINT)


def sentences(text: Column) -> Column:
    """Sentences of 30 to 1200 characters; a sentence ends before a capital, a digit or a CJK character."""
    compact = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.transform(F.split(compact, r"(?<=[.!?。！？])\s+(?=[A-Z0-9一-鿿])"), lambda s: F.trim(s)), lambda s: F.length(s).between(30, 1200))


def publication_class(types: Column, text: Column) -> Column:
    """The first class whose words occur in type or text; a peer-review document is none of them."""
    names = F.coalesce(types, F.array().cast("array<string>"))
    document = F.exists(names, lambda t: F.regexp_replace(F.lower(F.trim(t)), "_", "-") == "peer-review")
    combined = F.concat(F.lit(" "), F.lower(F.array_join(names, " ")), F.lit(" "), lower_text(text), F.lit(" "))
    found = F.when(document, "peer-review-document")
    for name, words in PUBLICATION_CLASSES:
        found = found.when(any_of(combined, words), name)
    return found.otherwise(F.coalesce(F.get(names, F.lit(0)), F.lit("primary/other")))


def evidence_label(kind: Column, preprint: Column, retracted: Column) -> Column:
    """high, moderate, contextual, low, or exclude for a retracted source; a preprint counts one less."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in EVIDENCE_WEIGHTS.items() for x in kv])[kind], F.lit(2))
    weight = F.when(preprint, F.greatest(F.lit(1), weight - 1)).otherwise(weight)
    return F.when(F.coalesce(retracted, F.lit(False)), "exclude").when(weight >= 4, "high").when(weight == 3, "moderate").when(weight == 2, "contextual").otherwise("low")


def findings(text: Column) -> Column:
    """Up to three sentences with the wording of a finding, else the first three."""
    all_of = sentences(text)
    marked = F.filter(all_of, lambda s: any_of(F.lower(s), FINDING_WORDS))
    return F.slice(F.when(F.size(marked) > 0, marked).otherwise(all_of), 1, 3)


def redact_url(url: Column) -> Column:
    """Values of secret query parameters become ``***``."""
    return F.regexp_replace(url, r"(?i)([?&](?:api_?key|key|token|access_token|mailto|email|secret|password)=)[^&#]*", "$1***")


def is_meaningful(value: Column) -> Column:
    """True for text that is neither empty, nor a placeholder, nor a word that says nothing."""
    bare = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[*_`]", ""))
    return (bare != "") & ~has_placeholder(bare) & ~F.lower(bare).isin("-", "n/a", "na", "none", "null", "unknown", "tbd", "todo")


def has_placeholder(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).rlike(r"(?i)\b(TBD|TODO|FIXME)\b|\{\{[^}]*\}\}|<[^>]*placeholder[^>]*>|待补充|待定")


def query_language(text: Column) -> Column:
    """zh-en-mixed, zh, en or undetermined, from the CJK characters and Latin letters of a text."""
    cjk = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[㐀-䶿一-鿿]"))
    latin = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z]"))
    return F.when((cjk > 0) & (latin > 0), "zh-en-mixed").when(cjk > 0, "zh").when(latin > 0, "en").otherwise("undetermined")


def cited_numbers(text: Column) -> Column:
    """Numbers cited in square brackets, ranges of at most 1000 expanded, in ascending order."""
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d{1,4}(?:\s*[-–,]\s*\d{1,4})*)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))

    def expand(p: Column) -> Column:
        ends = F.split(p, r"\s*[-–]\s*")
        low, high = F.get(ends, F.lit(0)).cast("int"), F.element_at(ends, -1).cast("int")
        return F.when((high >= low) & (high - low <= 1000), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def slug(value: Column) -> Column:
    """Lower case with single hyphens between runs of letters and digits."""
    return F.regexp_replace(F.regexp_replace(lower_text(value), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
