"""Scans of a landed source with the filters that the source itself understands, and what is left of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """What a search may restrict: years, publication types, fields of study, open access, citations."""

    after: int | None = None
    before: int | None = None
    types: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    open_access: bool = False
    min_citations: int | None = None


# Which filters each source applies itself; one source takes only the first type.
PUSHED = {
    "openalex": ("after", "before", "types", "fields", "open_access", "min_citations"),
    "semantic_scholar": ("after", "before", "types", "fields", "open_access", "min_citations"),
    "crossref": ("after", "before", "first_type"),
    "europe_pmc": ("after", "before", "open_access"),
}


def _conditions(f: Filters, names) -> list:
    found = []
    if "after" in names and f.after is not None:
        found.append(F.col("year") >= f.after)
    if "before" in names and f.before is not None:
        found.append(F.col("year") <= f.before)
    if "types" in names and f.types:
        found.append(F.arrays_overlap("publication_types", F.array(*[F.lit(t) for t in f.types])))
    if "first_type" in names and f.types:
        found.append(F.array_contains("publication_types", f.types[0]))
    if "fields" in names and f.fields:
        found.append(F.arrays_overlap("fields_of_study", F.array(*[F.lit(t) for t in f.fields])))
    if "open_access" in names and f.open_access:
        found.append(F.coalesce("is_open_access", F.lit(False)))
    if "min_citations" in names and f.min_citations is not None:
        found.append(F.col("citation_count") >= f.min_citations)
    return found


def search(papers: DataFrame, source: str, filters: Filters, strict: bool = True) -> DataFrame:
    """Rows of one source. Not strict, only what the source understands is applied; strict, the rest is applied after it."""
    names = PUSHED[source]
    found = papers.where(F.col("provider") == source)
    for c in _conditions(filters, names):
        found = found.where(c)
    if strict:
        for c in _conditions(filters, PUSHED["openalex"]):
            found = found.where(c)
    return found


def lookup(papers: DataFrame, key: str, value: str) -> DataFrame:
    """The row of an identifier, or none; the smallest record if it has several."""
    return papers.where(F.col(key) == value).orderBy("record_id").limit(1)


def lookup_many(papers: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Rows of many identifiers at once: a semi-join, broadcast by size."""
    from litloom.runtime import broadcast_if_small

    return papers.join(broadcast_if_small(values.select(key).distinct()), key, "left_semi")
