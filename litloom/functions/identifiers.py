"""Identifiers, keys, links, cells and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a typed id's prefix stands for.
NAMESPACES = {
    "ART": "artifact", "BR": "branch", "CAP": "capability", "CTX": "context", "DR": "deep-read-request", "CL": "claim", "B": "claim", "M": "claim", "S": "claim",
    "C": "candidate", "E": "evidence", "Q": "query", "A": "attack", "D": "decision", "I": "interface", "GS": "gray-space", "H": "hypothesis", "G": "gap", "F": "finding", "R": "repair",
}

# Answers that explain nothing, as letters and digits in lower case.
SENTINELS = ("na", "none", "unknown", "notapplicable", "outofscope", "sameasabove", "无", "未知", "不适用", "范围外", "同上")

# Words of a path and the risk that a change there brings.
PATH_RISKS = (
    ("api-or-spec", ("cli", "spec", "api")),
    ("dependencies", ("pyproject", "requirements", "lock")),
    ("output-behavior", ("export", "save")),
    ("routing-or-guidance", ("skill.md", "readme", "routing")),
)

# Words in a command line argument after which a secret follows.
SECRET_MARKERS = ("token", "password", "secret", "api-key", "apikey")


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def percent_decoded(value: Column) -> Column:
    """Percent escapes replaced; a plus sign stays one, and a text with broken escapes stays as it is."""
    return F.coalesce(F.call_function("try_url_decode", F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def balanced(value: Column) -> Column:
    """Closing parentheses at the end that were never opened are dropped."""
    closing = F.length(F.regexp_extract(value, r"\)*$", 0))
    surplus = F.regexp_count(value, F.lit(r"\)")) - F.regexp_count(value, F.lit(r"\("))
    return F.substring(value, F.lit(1), F.length(value) - F.greatest(F.lit(0), F.least(closing, surplus)))


def normalize_identifier(value: Column) -> Column:
    """``doi:``, ``arxiv:`` (with version) or ``pmid:`` and the identifier, else the text with single spaces in lower case."""
    v = percent_decoded(F.trim(_text(value)))
    doi = F.regexp_replace(F.regexp_extract(v, r"(?i)10\.\d{4,9}/[^\s<>\"|;,]+", 0), r"[.\]}]+$", "")
    arxiv = F.regexp_extract(v, r"(?i)(?:arxiv\s*:\s*|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5}(?:v\d+)?)", 1)
    pmid = F.regexp_extract(v, r"(?i)pmid\s*:?\s*(\d+)", 1)
    plain = F.lower(F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"/+$", ""))
    return F.when(doi != "", F.concat(F.lit("doi:"), F.lower(balanced(doi)))).when(arxiv != "", F.concat(F.lit("arxiv:"), F.lower(arxiv))).when(pmid != "", F.concat(F.lit("pmid:"), pmid)).otherwise(plain)


def normalize_identity(value: Column) -> Column:
    """``doi:`` or ``arxiv:`` (without version) and the identifier, else the text in lower case without closing slash."""
    v = F.lower(F.trim(percent_decoded(_text(value))))
    doi = F.regexp_replace(F.regexp_extract(v, r"10\.\d{4,9}/[^\s<>|#;]+", 0), r"[.,\]}\"]+$", "")
    arxiv = F.regexp_extract(v, r"(?:arxiv[:/]|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5})(?:v\d+)?", 1)
    return F.when(doi != "", F.concat(F.lit("doi:"), balanced(doi))).when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).otherwise(F.regexp_replace(v, r"/+$", ""))


def source_link(value: Column) -> Column:
    """The resolver's address of a DOI in lower case, else the first address with scheme and host in lower case, else the text."""
    v = _text(value)
    doi = F.regexp_extract(v, r"(?i)10\.\d{4,9}/[^\s)>]+", 0)
    found = F.regexp_extract(v, r"(?i)https?://[^\s)>]+", 0)
    raw = F.regexp_replace(F.when(found != "", found).otherwise(F.trim(v)), r"[.,;\]]+$", "")
    head = F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0)
    return F.when(doi != "", F.concat(F.lit("https://doi.org/"), F.lower(F.regexp_replace(doi, r"[.,;\]]+$", "")))).otherwise(F.concat(F.lower(head), F.substring(raw, F.length(head) + 1, F.length(raw))))


def split_multi(value: Column) -> Column:
    """The parts of a cell between commas, semicolons and slashes, without blanks."""
    return F.filter(F.transform(F.split(_text(value), r"[,;/]+"), lambda x: F.trim(x)), lambda x: x != "")


def cell_ids(value: Column, prefix: str = "[A-Z]{1,4}") -> Column:
    """All typed ids of a cell, in order."""
    return F.regexp_extract_all(_text(value), F.lit(rf"\b{prefix}-\d{{1,6}}\b"), F.lit(0))


def namespace(identifier: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.split(_text(identifier), "-")[0]), F.lit("unknown"))


def chain_ids(value: Column) -> Column:
    """The chains of ``chains=EC-001,EC-002; basis=...``, sorted; null if unknown or without basis."""
    listed = F.regexp_extract(_text(value), r"(?i)^\s*chains\s*=\s*([^;]*);", 1)
    basis = F.trim(F.regexp_replace(F.regexp_replace(_text(value), r"(?i)^\s*chains\s*=\s*[^;]*;", ""), r"(?i)^\s*basis\s*=\s*", ""))
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(listed), F.lit(r"EC-\d{3}"), F.lit(0))))
    usable = (F.size(ids) > 0) & (basis != "") & ~basis.rlike(r"(?i)^(?:unknown|none|pending|tbd|not[- ](?:known|available|documented))\b")
    return F.when(usable, ids)


def independently_reviewed(value: Column) -> Column:
    """``review=independent`` with a named reviewer and basis."""
    pairs = F.filter(F.transform(F.split(_text(value), ";"), lambda x: F.split(x, "=", 2)), lambda x: F.size(x) == 2)
    said = lambda key: F.coalesce(F.element_at(F.filter(pairs, lambda x: F.lower(F.trim(x[0])) == key), -1)[1], F.lit(""))
    named = lambda key: (F.trim(said(key)) != "") & ~F.trim(said(key)).rlike(r"(?i)^(?:unknown|none|pending|tbd)\b")
    return (F.lower(F.trim(said("review"))) == "independent") & named("reviewer") & named("basis")


def schema_version(value: Column) -> Column:
    """``struct(major, minor)`` of MAJOR.MINOR, null for any other form."""
    v = _text(value)
    part = lambda k: F.regexp_extract(v, r"^(\d{1,9})\.(\d{1,9})", k).try_cast("int")
    return F.when(v.rlike(r"^\d{1,9}\.\d{1,9}$"), F.struct(part(1).alias("major"), part(2).alias("minor")))


def evidence_window(value: Column, as_of: Column) -> Column:
    """``struct(start, end, valid)`` of ``start..end``, ``start:end`` or one start; an endpoint is a year, month or day.

    Without a start it is the first of January five years before; without an end it is ``as_of``. A window is valid if its
    endpoints are dates, do not cross and do not lie behind ``as_of``; the running year as an end means ``as_of``.
    """
    v = F.trim(_text(value))
    mark = F.when(F.contains(v, F.lit("..")), F.instr(v, "..")).otherwise(F.instr(v, ":"))
    wide = F.when(F.contains(v, F.lit("..")), 2).otherwise(1)
    first = F.trim(F.when(mark > 0, F.substring(v, F.lit(1), mark - 1)).otherwise(v))
    last = F.trim(F.when(mark > 0, F.substring(v, mark + wide, F.length(v))).otherwise(F.lit("")))
    day = lambda x: F.call_function("try_to_date", x, F.lit("yyyy-MM-dd"))
    year, month = lambda x: x.rlike(r"^\d{4}$"), lambda x: x.rlike(r"^\d{4}-\d{2}$")
    from_ = F.when(first == "", F.make_date(F.greatest(F.lit(1), F.year(as_of) - 5), F.lit(1), F.lit(1))).when(year(first), day(F.concat(first, F.lit("-01-01")))).when(month(first), day(F.concat(first, F.lit("-01")))).otherwise(day(first))
    until = F.when(last == "", as_of).when(year(last), day(F.concat(last, F.lit("-12-31")))).when(month(last), F.last_day(day(F.concat(last, F.lit("-01"))))).otherwise(day(last))
    until = F.when(year(last) & (last == F.date_format(as_of, "yyyy")), F.least(until, as_of)).otherwise(until)
    valid = F.coalesce((from_ <= until) & (until <= as_of), F.lit(False))
    return F.struct(from_.alias("start"), until.alias("end"), valid.alias("valid"))


def key_base(key: Column) -> Column:
    """A citation key without its collision suffix."""
    return F.when(_text(key).rlike(r"^[^_]*_[^_]*_[^_]*_[a-z]$"), F.regexp_replace(key, r"_[a-z]$", "")).otherwise(_text(key))


def key_suffix(key: Column) -> Column:
    return F.when(_text(key).rlike(r"^[^_]*_[^_]*_[^_]*_[a-z]$"), F.substring(key, -1, 1))


def key_errors(key: Column) -> Column:
    """What is wrong with a key of the form ``Given Family_Journal_Year`` with an optional suffix, as sorted codes."""
    k = _text(key)
    parts = F.split(key_base(key), "_")
    author, journal, year = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    whole = F.size(parts) == 3
    odd = r"[^\p{L}\p{M}\p{N} \-'’]"
    codes = (
        ("spacing", (k != F.trim(k)) | F.contains(k, F.lit("  ")) | F.contains(k, F.lit("\t"))),
        ("parts", ~whole),
        ("empty", whole & ((author == "") | (journal == ""))),
        ("one-name", whole & ~F.contains(F.trim(author), F.lit(" "))),
        ("initial", whole & author.rlike(r"(^|\s)[A-Za-z](\s|$)")),
        ("year", whole & ~year.rlike(r"^\d{4}$")),
        ("punctuation", whole & (author.rlike(odd) | journal.rlike(odd))),
    )
    return F.array_sort(F.filter(F.array(*[F.when(broken, F.lit(code)) for code, broken in codes]), lambda x: x.isNotNull()))


def safe_path(path: Column) -> Column:
    """A relative path without empty, dotted or colon segments and outer blanks."""
    p = _text(path)
    segments = F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/")
    return (p != "") & (p == F.trim(p)) & ~F.exists(segments, lambda s: s.isin("", ".", "..") | F.contains(s, F.lit(":")))


def path_risks(path: Column) -> Column:
    """Sorted tags of what a change of a path may affect."""
    low = F.lower(_text(path))
    hit = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w)), F.lit(risk)) for risk, words in PATH_RISKS]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())


def watched(path: Column, prefixes: list[str]) -> Column:
    """True for a watched path or one below it."""
    bare = [p.rstrip("/") for p in prefixes]
    return F.exists(F.array(*[F.lit(p) for p in bare]), lambda w: (path == w) | F.startswith(path, F.concat(w, F.lit("/"))))


def scope_rationale(value: Column) -> Column:
    """Letters and digits in lower case are left and are no sentinel (compatibility forms are folded before, see ``nfkc``)."""
    bare = F.lower(F.regexp_replace(_text(value), r"[^\p{L}\p{N}]+", ""))
    return (bare != "") & ~bare.isin(*SENTINELS)


def redacted_arguments(args: Column) -> Column:
    """Arguments with secrets hidden: the value after ``=`` of a sensitive flag, or the argument that follows it."""
    sensitive = lambda x: F.exists(F.array(*[F.lit(m) for m in SECRET_MARKERS]), lambda m: F.contains(F.lower(x), m))
    step = lambda state, x: (
        F.when(state["hide"], F.struct(F.array_append(state["out"], F.lit("[REDACTED]")).alias("out"), F.lit(False).alias("hide")))
        .when(sensitive(x) & F.contains(x, F.lit("=")), F.struct(F.array_append(state["out"], F.concat(F.substring_index(x, "=", 1), F.lit("=[REDACTED]"))).alias("out"), F.lit(False).alias("hide")))
        .otherwise(F.struct(F.array_append(state["out"], x).alias("out"), sensitive(x).alias("hide")))
    )
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide"))
    return F.aggregate(args, start, step, lambda state: state["out"])


def public_url(url: Column) -> Column:
    """An absolute http address without credentials, control characters, local names or private and reserved IPv4 numbers."""
    u = _text(url)
    place = F.regexp_extract(u, r"(?i)^https?://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(place, r":\d*$", ""), r"\.+$", ""))
    port = F.regexp_extract(place, r":(\d+)$", 1).try_cast("int")
    private = host.rlike(r"^(0|10|127|22[4-9]|23\d|24\d|25[0-5])\.\d+\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^192\.0\.[02]\.\d+$|^198\.1[89]\.\d+\.\d+$|^198\.51\.100\.\d+$|^203\.0\.113\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d+\.\d+$|^\[")
    local = host.rlike(r"%|^localhost$|\.localhost$|^localhost\.localdomain$")
    return (host != "") & ~F.contains(place, F.lit("@")) & ~u.rlike(r"[\\\x00-\x1f\x7f]") & ~private & ~local & (port.isNull() | port.between(1, 65535))
