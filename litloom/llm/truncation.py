"""Problem 4: texts cut off by field limits.

Method: a self-join by prefix. All values are put into one global sort order; in that order the longer copies of a value
lie directly beside it, and all of them are looked at: one that goes on with wording proves a cut, whatever page furniture
other copies add. A value that has no longer copy left is judged by its end: marks of a cut, broken characters, and wording
that stops inside a sentence.

Nulls, empty and blank values are never cuts; repeated rows are judged alike; empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.runtime import broadcast_if_small, cut, table

#: How much of the end of a value is looked at.
TAIL = 240

#: How many whole values must end in a sentence of the same form, and in the same word, for each value that does so without
#: a stop, before a missing stop is forgiven. As only the ratio counts, the verdict does not depend on the number of rows.
KNOWN_FORM, KNOWN_FINAL = 3, 2

#: Values shorter than this are too common as a beginning to prove a cut.
MIN_PREFIX = 40

# Writings of "there is no text here", compared in lower case without brackets and closing stop.
PLACEHOLDERS = (
    "abstract missing", "abstract not available", "abstract unavailable", "n/a", "na", "no abstract", "no abstract available",
    "none", "not available", "null", "see full text", "text missing", "this article has no abstract", "unknown",
)

# Beginnings of what may follow a text and belongs to it.
APPENDED = ("data:", "funded by", "see http")

# Beginnings of page furniture that publishers append to a whole text.
FURNITURE = (
    "all rights reserved", "article metrics", "back to top", "cite this article", "content provided by", "copyright",
    "download citation", "download pdf", "export citation", "for permissions", "keywords:", "licensed under",
    "privacy policy", "published by", "related articles", "reprints and permissions", "share this",
    "sign in", "subscribe", "supplementary material", "terms of use", "the publisher", "this article is protected",
    "this content", "this site uses cookies", "this website uses cookies", "view full text", "©",
)

# Words no English or German sentence ends with.
OPEN_WORDS = (
    "a", "an", "and", "as", "at", "be", "because", "been", "between", "but", "by", "each", "for", "from", "had", "if", "in",
    "into", "is", "its", "no", "of", "on", "or", "our", "over", "than", "that", "the", "their", "this", "to", "under", "was",
    "we", "were", "when", "whereas", "whether", "which", "while", "with", "yet", "der", "die", "das", "ein", "eine", "und",
    "oder", "von", "mit", "für", "zu", "wurde", "ist",
)

# Abbreviations whose stop is not the end of a sentence.
ABBREVIATIONS = ("al", "approx", "bzw", "ca", "cf", "e.g", "eq", "eqs", "fig", "figs", "i.e", "no", "nos", "p", "pp", "ref", "refs", "sect", "tab", "vgl", "vol", "vs", "z")

_MARK = re.compile(
    r"(…|\.\.+|\[(…|\.\.\.)\]|\((…|\.\.\.)\)|[\(\[](more|continued|cont\.?|truncated|cut|read more|see more)\.?[\)\]]|\bread more|>>)$",
    re.IGNORECASE,
)
_BROKEN = re.compile(r"(�|&#?[A-Za-z0-9]{0,7}|<[/A-Za-z]{0,8}|\\u?[0-9A-Fa-f]{0,4}|\\x[0-9A-Fa-f]{0,2}|(?<![0-9])%[0-9A-F]?)$")
_ADDED = re.compile(
    r"\s*(\[[0-9, –-]+\]|\((Table|Tab\.|Fig\.|Figure|Eq\.|Sect\.|Section|Funded by|Supported by|Tabelle|Abb\.)[^()]*\)"
    r"|(See|Data|Code|Source|DOI|Available at|Siehe|Daten):?\s+(https?://|doi:|10\.)\S*[^\s.,;:])$"
)
_CLOSED = re.compile(r"[.!?。！？][\"'”’»)\]」\s]*$")
_OPEN_STOP = re.compile(r"[a-zäöüß]\.[\"'”’]*$")
_DECIMAL = re.compile(r"(from|to|of|and|over|after|by|=|than|approx\.|for) [-−]?[0-9]{1,3}\.$")
_CELL = r"[^\d;,.]{2,40} [-−+]?\d[\d.,]*\s?[A-Za-z%µ°/][^\s;]*"
_TABLE = re.compile(rf"{_CELL}(?:[;|\t]\s*{_CELL})*")
_TITLE = re.compile(r"[^.;,:!?]*[\w)]")
_END_TAGS = re.compile(r"(\s|</[A-Za-z]{1,10}>)+$")
_START_TAGS = re.compile(r"^(\s|<[A-Za-z]{1,10}>)+")
_LAST_WORD = re.compile(r"(\S+?)[.!?\"'”’)\]]*$")
_LEAD = re.compile(r"^(\[?(…|\.\.\.)\]?\s*|[\"'“«]|(?:abstract|summary)[:.]\s*)+")
_PLACEHOLDERS, _OPEN, _ABBREVIATED = frozenset(PLACEHOLDERS), frozenset(OPEN_WORDS), frozenset(ABBREVIATIONS)
_FURNITURE = (*APPENDED, *FURNITURE)


def tidy(text: str) -> str:
    """The value without closing tags and outer white space."""
    s = text.strip()
    if s.endswith(">"):
        s = _END_TAGS.sub("", s)
    return _START_TAGS.sub("", s) if s.startswith("<") else s


def end_state(text: str | None, title_words: int = 8) -> str | None:
    """``whole``, ``mark``, ``broken`` or ``open``: how the wording of a value ends; None for null and placeholders.

    All tests but that for a table look at the last ``TAIL`` characters only. A title is a value of at most
    ``title_words`` words without any sentence mark.
    """
    if text is None:
        return None
    s = tidy(text)
    if not s or (len(s) < 64 and s.strip("[]()<>*-. !").lower() in _PLACEHOLDERS):
        return None
    tail = s[-TAIL:]
    if _MARK.search(tail):
        return "mark"
    if _BROKEN.search(tail):
        return "broken"
    core = _ADDED.sub("", tail)
    found = _LAST_WORD.search(core[-60:])
    last = found.group(1).lower() if found else ""
    if _CLOSED.search(core):
        cut = (last in _OPEN and _OPEN_STOP.search(core)) or (core.endswith(".") and (last in _ABBREVIATED or _DECIMAL.search(core)))
        return "open" if cut else "whole"
    if (core != tail and last not in _OPEN) or _TABLE.fullmatch(s):
        return "whole"
    if len(s) < TAIL and s.count(" ") < title_words and last not in _OPEN and _TITLE.fullmatch(s):
        return "whole"
    return "open"


def wording(text: str) -> str:
    """What the prefix join compares: lower case, single spaces, no opening or closing marks of an omission."""
    s = _BROKEN.sub("", _MARK.sub("", tidy(text)))
    return " ".join(_LEAD.sub("", s.lower()).split())


# Further words that keep their form in the pattern of a sentence.
_PATTERN_WORDS = _OPEN | frozenset((
    "after", "all", "alone", "also", "any", "before", "both", "can", "could", "did", "do", "does", "during", "e", "few", "g", "has", "have",
    "he", "here", "how", "it", "its", "may", "might", "more", "most", "not", "only", "other", "re", "s", "several", "should", "so", "some", "such",
    "them", "then", "there", "these", "they", "those", "through", "to", "upon", "us", "what", "who", "will", "within", "without", "would", "i",
    "am", "auch", "auf", "aus", "bei", "bleibt", "blieb", "dem", "den", "durch", "einer", "eines", "einem", "er", "es", "haben", "hat",
    "im", "nach", "nicht", "noch", "nur", "obwohl", "sich", "sie", "sind", "um", "waren", "war", "wenn", "werden", "wir", "wird", "zum", "zur",
))
_TOKEN = re.compile(r"[^\W\d_]+|\d[\d.,]*|[^\w\s]")
_SENTENCE_START = re.compile(r"[.!?。]\s+(?=[A-Z“\"(\[])")


def last_sentence(text: str) -> str:
    """What follows the last end of a sentence that another sentence follows."""
    tail = text[-600:]
    begin = 0
    for m in _SENTENCE_START.finditer(tail):
        begin = m.end()
    return tail[begin:]


def pattern(sentence: str) -> str:
    """The form of a sentence: function words and marks stay, other words, names and numbers become w, C and 0."""
    out = []
    for token in _TOKEN.findall(sentence.rstrip(".!?。\"'”’»)] ") + (")" if sentence.rstrip(".!?。").endswith(")") else "")):
        low = token.lower()
        if low in _PATTERN_WORDS:
            out.append(low)
        elif token[0].isdigit():
            out.append("0")
        elif token[0].isalpha():
            out.append("w" if not out or token[0].islower() else "C")
        else:
            out.append(token)
    return " ".join(out)


_JUDGED = "table_name string, row_id bigint, source string, end_state string, wording string, form bigint, final string, repeated boolean"
_KEPT = ["table_name", "row_id", "source", "end_state", "form", "final", "repeated"]
_COMPARED = "table_name string, row_id bigint, source string, end_state string, form bigint, final string, repeated boolean, longer boolean, pending string"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        states, forms, finals, repeats, words = [], [], [], [], []
        for text in batch["text"]:
            state = end_state(text)
            form = final = repeated = None
            if state in ("open", "whole"):
                s = tidy(text)
                sentence = last_sentence(s)
                if state == "open" or _CLOSED.search(sentence):
                    form = xxhash.xxh3_64_intdigest(pattern(sentence)) - (1 << 63)
                    found = _LAST_WORD.search(s[-60:])
                    final = found.group(1).lower() if found else None
                    if state == "open" and final:
                        repeated = bool(re.search(rf"(?<!\w){re.escape(final)}(?!\w)", s[: -len(final)].lower()))
            states.append(state)
            forms.append(form)
            finals.append(final)
            repeats.append(repeated)
            words.append("" if state is None else wording(text))
        yield batch[["table_name", "row_id", "source"]].assign(
            end_state=states, wording=words, form=pd.array(forms, "Int64"), final=finals, repeated=pd.array(repeats, "boolean")
        )


def is_furniture(added: str) -> bool:
    """True if what a longer copy adds is page furniture, so that the shorter value is whole."""
    bare = added[:120].lstrip(" \t\n.;:,|([–—-")
    return not bare or bare.startswith(_FURNITURE)


class LongerCopies:
    """Takes values in descending order and tells of each whether a value before it is a longer copy that goes on with wording.

    Held are the values that a later one may still begin: those that share ``MIN_PREFIX`` characters with the last one, each
    with the wording (of a longer copy of its own) that its continuation by marks only may hide.
    """

    def __init__(self) -> None:
        self.held: list[tuple[str, str | None]] = []

    def take(self, value: str) -> bool:
        if not self.held or self.held[-1][0][:MIN_PREFIX] != value[:MIN_PREFIX]:
            self.held = []
        beyond = None
        while self.held and self.held[-1][0].startswith(value):
            longer, further = self.held.pop()
            for copy in (longer, further):
                if beyond is None and copy is not None and not is_furniture(copy[len(value) : len(value) + 120]):
                    beyond = copy
        if len(value) >= MIN_PREFIX:
            self.held.append((value, beyond))
            return beyond is not None
        return False


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partition in descending order of the wording, each value with whether it has a longer copy there.

    The longer copies of a value that the partition's first value begins with may lie in the partitions before: such a
    value comes out ``pending`` if nothing is found here.
    """
    from pyspark import TaskContext

    known, first, last, found = LongerCopies(), None, None, False
    later = TaskContext.get().partitionId() > 0
    for batch in batches:
        longer, pending = [], []
        for value in batch["wording"]:
            if first is None:
                first = value
            if value != last:
                last, found = value, known.take(value)
            longer.append(found)
            pending.append(value if later and not found and len(value) >= MIN_PREFIX and first.startswith(value) else None)
        yield batch[_KEPT].assign(longer=longer, pending=pending)


def _across(pending: DataFrame, judged: DataFrame) -> DataFrame:
    """``(pending, across)``: the pending values that have a longer copy which goes on with wording in any partition.

    There are a few of them for each border between partitions.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = [not is_furniture(w[len(v) : len(v) + 120]) for v, w in zip(batch["pending"], batch["wording"])]
            yield batch[hit][["pending"]].drop_duplicates()

    asked = pending.withColumn("head", F.substring("pending", 1, MIN_PREFIX))
    copies = judged.select("wording", F.substring("wording", 1, MIN_PREFIX).alias("head")).join(broadcast_if_small(asked), "head")
    longer = copies.where((F.length("wording") > F.length("pending")) & F.startswith("wording", "pending")).select("pending", "wording")
    return longer.mapInPandas(check, "pending string").distinct().withColumn("across", F.lit(True))


def truncated_values(values: DataFrame, partitions: int | None = None) -> DataFrame:
    """Judge each row of ``values(table_name, row_id, source, text)``.

    Result: ``table_name, row_id, source, end_state, has_longer_copy, is_truncated``, one row per row of the input. A row
    is truncated if its wording is a strict prefix of a longer copy that goes on with wording (not with page furniture)
    or if its own end shows a cut; an end without a stop is none if whole values end in sentences of that form. The sort is
    by range over wording and row, so that neither values that share a long beginning nor repeated values gather in one
    task; what crosses a border is settled for the few values that do.
    """
    spark = values.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the sort samples its input, so the judging is done before and once
    judged = cut(values.select("table_name", "row_id", "source", "text").mapInPandas(_judge, _JUDGED))
    compared = cut(judged.repartitionByRange(n, F.desc("wording"), "row_id").sortWithinPartitions(F.desc("wording"), "row_id").mapInPandas(_compare, _COMPARED))
    pending = cut(compared.where("pending is not null").select("pending").distinct())
    whole, open_ = F.col("end_state") == "whole", F.col("end_state") == "open"
    ends = compared.where(F.col("form").isNotNull() & (whole | open_))
    forms = ends.groupBy("form").agg(F.count_if(whole).alias("n_whole"), F.count_if(open_).alias("n_open")).where(f"n_open > 0 and n_whole >= {KNOWN_FORM} * n_open")
    finals = ends.where("final is not null").groupBy("final").agg(F.count_if(whole).alias("n_whole"), F.count_if(open_).alias("n_open")).where(f"n_open > 0 and n_whole >= {KNOWN_FINAL} * n_open")
    asked = compared.withColumn("asked", F.when(open_, F.col("form"))).withColumn("asked_final", F.when(open_, F.col("final")))
    copies = (
        asked.join(broadcast_if_small(cut(_across(pending, judged))), "pending", "left")
        .join(broadcast_if_small(cut(forms.select(F.col("form").alias("asked"), F.lit(True).alias("known_form")))), "asked", "left")
        .join(broadcast_if_small(cut(finals.select(F.col("final").alias("asked_final"), F.lit(True).alias("known_final")))), "asked_final", "left")
    )
    complete = open_ & F.col("known_form").isNotNull() & (F.col("known_final").isNotNull() | F.coalesce("repeated", F.lit(False)))
    return copies.select(
        "table_name",
        "row_id",
        "source",
        F.when(complete, "whole").otherwise(F.col("end_state")).alias("end_state"),
        (F.col("longer") | F.coalesce("across", F.lit(False))).alias("has_longer_copy"),
    ).withColumn("is_truncated", F.coalesce(F.col("end_state") != "whole", F.lit(False)) | F.col("has_longer_copy"))


def source_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that may be cut, with the source that delivered them (feed or provider)."""
    feeds = table(spark, sf_dir, "evidence_sources").select("source_id", "feed")
    evidence = (
        table(spark, sf_dir, "evidence_records")
        .select("evidence_id", "source_id", "text")
        .join(broadcast_if_small(feeds), "source_id", "left")
        .select(F.lit("evidence_records").alias("table_name"), F.col("evidence_id").alias("row_id"), F.col("feed").alias("source"), "text")
    )
    papers = table(spark, sf_dir, "paper_records").select(
        F.lit("paper_records").alias("table_name"), F.col("record_id").alias("row_id"), F.col("provider").alias("source"), F.col("abstract").alias("text")
    )
    return evidence.unionByName(papers)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text lost its end."""
    return truncated_values(source_values(spark, sf_dir)).where("is_truncated").select("table_name", "row_id").distinct()


def p4_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each feed or provider truncates: rows with a text, cut rows (and how they show), and their share."""
    judged = truncated_values(source_values(spark, sf_dir))
    return (
        judged.groupBy("table_name", F.coalesce("source", F.lit("(none)")).alias("source"))
        .agg(
            F.count("end_state").alias("n_values"),
            F.count_if("is_truncated").alias("n_truncated"),
            F.count_if("has_longer_copy").alias("n_with_longer_copy"),
            F.count_if(F.col("is_truncated") & F.col("end_state").isin("mark", "broken")).alias("n_with_mark"),
        )
        .withColumn("share", F.round(F.coalesce(F.try_divide("n_truncated", "n_values"), F.lit(0.0)), 6))
    )


QUERIES = {"p4_found": p4_found, "p4_source_report": p4_source_report}
