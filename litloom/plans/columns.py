"""Plans of many questions at once: every step as a column expression over a column of questions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as fx
from litloom.plans import lexicon as lx

CJK = r"[㐀-䶿一-鿿]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _list(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def nfkc(question: Column) -> Column:
    """Compatibility forms folded, control characters as spaces, white space collapsed; Unicode folding has no built-in."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else "")

    return F.trim(F.regexp_replace(F.regexp_replace(fold(question), r"[\x00-\x1f\x7f]+", " "), r"\s+", " "))


def language(question: Column) -> Column:
    q = _text(question)
    cjk, latin = q.rlike(CJK), q.rlike("[A-Za-z]")
    return F.when(cjk & latin, "zh-en-mixed").when(cjk, "zh").when(latin, "en").otherwise("undetermined")


def identifiers(question: Column) -> dict[str, Column]:
    """DOI, PMCID, PMID and arXiv id that a text names; empty if it names none."""
    q = _text(question)
    pmcid = F.regexp_extract(q, r"(?i)\bPMC(?:ID)?\s*[:#-]?\s*(\d+)\b", 1)
    return {
        "doi": fx.normalize_doi(q),
        "pmcid": F.when(pmcid != "", F.concat(F.lit("PMC"), pmcid)).otherwise(""),
        "pmid": F.regexp_extract(q, r"(?i)\bPMID\s*[:#-]?\s*(\d+)\b", 1),
        "arxiv": F.regexp_extract(q, r"(?i)\barXiv\s*:\s*((?:\d{4}\.\d{4,5})|(?:[a-z-]+/\d{7}))\b", 1),
    }


def english_terms(question: Column, most: int = 12) -> Column:
    """Words of three letters or more in lower case without stop words, in the order of their first appearance."""
    words = F.transform(F.regexp_extract_all(_text(question), F.lit(r"[A-Za-z][A-Za-z0-9-]{2,}"), F.lit(0)), lambda w: F.lower(w))
    return F.slice(F.array_except(F.array_distinct(words), _list(lx.ENGLISH_STOPWORDS)), 1, most)


def chinese_terms(question: Column, most: int = 12) -> Column:
    """Terms of the lexicon that occur, then runs of 2 to 20 characters between function words."""
    q = _text(question)
    working = q
    for word in lx.CHINESE_FUNCTION_WORDS:
        working = F.replace(working, F.lit(word), F.lit(" "))
    known = F.filter(_list(zh for zh, _ in lx.CHINESE_TERMS), lambda t: F.contains(q, t))
    runs = F.regexp_extract_all(working, F.lit(CJK + "{2,20}"), F.lit(0))
    return F.slice(F.array_distinct(F.concat(known, runs)), 1, most)


def category_terms(question: Column, category: str) -> Column:
    """The words of a category that occur, in the order of the lexicon."""
    low = F.lower(_text(question))
    return F.slice(F.filter(_list(lx.CATEGORIES[category]), lambda t: F.contains(low, t)), 1, 12)


def english_expansion(question: Column) -> Column:
    """English terms for the Chinese ones that occur, by place, then longer ones first; at most ten."""
    q = _text(question)
    entries = F.array(*[F.struct(F.instr(q, zh).alias("place"), F.lit(-len(zh)).alias("longer"), F.lit(en).alias("term")) for zh, en in lx.CHINESE_TERMS])
    found = F.array_sort(F.filter(entries, lambda e: e["place"] > 0))
    return F.array_join(F.slice(F.array_distinct(F.transform(found, lambda e: e["term"])), 1, 10), " ")


def english_status(supplied: Column) -> Column:
    """``struct(status, reason)`` of an English question that the caller may supply."""
    q = F.trim(F.regexp_replace(_text(supplied), r"\s+", " "))
    reason = (
        F.when(q == "", "empty after normalization")
        .when(F.length(q) > lx.MAX_ENGLISH_LENGTH, f"exceeds {lx.MAX_ENGLISH_LENGTH} characters")
        .when(q.rlike(CJK), "contains CJK text")
        .when(F.size(english_terms(q)) < 2, "fewer than two English content terms")
        .otherwise("")
    )
    status = F.when(supplied.isNull(), "not-supplied").when(reason != "", "rejected").otherwise("accepted")
    return F.struct(status.alias("status"), F.when(supplied.isNull(), "").otherwise(reason).alias("reason"))


def intents(question: Column, academic: bool = True) -> Column:
    """Broad discovery, then every intent whose words occur, then evidence coverage for academic questions."""
    low = F.lower(_text(question))
    hits = [F.when(F.exists(_list(words), lambda w: F.contains(low, w)), F.lit(intent)) for intent, words in lx.INTENTS.items()]
    last = [F.lit("evidence-coverage")] if academic else []
    return F.filter(F.array(F.lit("broad-discovery"), *hits, *last), lambda x: x.isNotNull())


def biomedical(question: Column) -> Column:
    low = F.lower(_text(question))
    return F.exists(_list(lx.BIOMEDICAL), lambda w: F.contains(low, w))


def route(question: Column) -> Column:
    """The kind of route: by identifiers, else biomedical or general."""
    found = F.concat(*identifiers(question).values()) != ""
    return F.when(found, "identifier").when(biomedical(question), "biomedical").otherwise("general")


def year_bounds(question: Column) -> Column:
    """``struct(after, before)`` from wordings such as ``since 2019`` and ``until 2022``."""
    q = _text(question)
    year = lambda words: F.regexp_extract(q, rf"(?i)\b(?:{words})\s+(19\d{{2}}|20\d{{2}})\b", 1).try_cast("int")
    return F.struct(year("since|after|from").alias("after"), year("before|until|through").alias("before"))


def context_values(*values: Column) -> Column:
    """Strings split at commas and semicolons, blanks dropped, in order."""
    parts = [F.filter(F.transform(F.split(_text(v), "[,;]"), lambda x: F.trim(x)), lambda x: x != "") for v in values]
    return F.concat(*parts)


def variants(questions: DataFrame, key: str, question: str, supplied: str | None = None) -> DataFrame:
    """``(key, position, variant, text)``: the variants in which a question is asked, at most ``MAX_VARIANTS``.

    The original always comes first; then its identifiers, a usable English form (supplied, else from the lexicon), its
    content words, and a wide form of the first four. A variant whose text is there already is left out.
    """
    q = F.col(question)
    ids = identifiers(q)
    given = F.col(supplied) if supplied else F.lit(None).cast("string")
    expansion = english_expansion(q)
    words = english_terms(q)
    useful = F.size(english_terms(expansion)) >= 2
    rows = [F.struct(F.lit("original").alias("variant"), F.trim(F.regexp_replace(_text(q), r"\s+", " ")).alias("text"))]
    rows += [F.when(value != "", F.struct(F.lit(f"identifier-{name}").alias("variant"), value.alias("text"))) for name, value in ids.items()]
    rows.append(F.when(english_status(given)["status"] == "accepted", F.struct(F.lit("caller-english").alias("variant"), F.trim(F.regexp_replace(given, r"\s+", " ")).alias("text"))).when(useful, F.struct(F.lit("lexicon-english").alias("variant"), expansion.alias("text"))))
    many = F.size(words) >= 2
    rows.append(F.when(many, F.struct(F.lit("terms").alias("variant"), F.array_join(words, " ").alias("text"))))
    rows.append(F.when(many, F.struct(F.lit("concept-wide").alias("variant"), F.array_join(F.slice(words, 1, 4), " OR ").alias("text"))))
    made = F.filter(F.array(*rows), lambda v: v.isNotNull())
    fresh = F.filter(made, lambda v, i: ~F.exists(F.slice(made, F.lit(1), i), lambda u: F.lower(u["text"]) == F.lower(v["text"])))
    return questions.select(key, F.posexplode(F.slice(fresh, 1, lx.MAX_VARIANTS)).alias("position", "v")).select(key, (F.col("position") + 1).alias("position"), "v.variant", "v.text")


def requests(planned: DataFrame, key: str, kind: str) -> DataFrame:
    """``(key, provider, priority, budget)``: the providers of each question's route, with what is left of the limit for them."""
    routes = F.create_map(*[x for name, providers in lx.ROUTES.items() for x in (F.lit(name), _list(providers))])
    budgets = F.create_map(*[F.lit(x) for pair in lx.PROVIDER_BUDGETS.items() for x in pair])
    rows = planned.select(key, F.posexplode(F.element_at(routes, F.col(kind))).alias("priority", "provider"))
    return rows.select(key, "provider", (F.col("priority") + 1).alias("priority"), F.least(F.lit(lx.REQUEST_LIMIT), F.element_at(budgets, F.col("provider"))).alias("budget"))
