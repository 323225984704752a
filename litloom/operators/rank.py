"""Explained relevance ranking: nine component scores, their weighted total, and a rank."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as fx
from litloom.operators import windows as wx
from litloom.runtime import cut

# Weights of the components.
WEIGHTS = {
    "title_match": 0.32, "abstract_match": 0.27, "method_match": 0.13, "field_match": 0.11, "year_fit": 0.06, "semantic_similarity": 0.05,
    "seed_graph_proximity": 0.02, "evidence_availability": 0.02, "normalized_citation_signal": 0.02,
}


@dataclass(frozen=True)
class Question:
    """What a ranking is for: tokens of the question, of methods and of fields, and bounds of the year."""

    terms: tuple[str, ...]
    methods: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    after: int | None = None
    before: int | None = None
    target: int | None = None
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))

    def normal_weights(self) -> dict[str, float]:
        """Weights that sum to 1; negative ones count as 0, unknown names and a sum of 0 are errors."""
        if unknown := set(self.weights) - set(WEIGHTS):
            raise ValueError(f"unknown ranking components: {sorted(unknown)}")
        clamped = {k: max(0.0, float(self.weights.get(k, 0.0))) for k in WEIGHTS}
        total = sum(clamped.values())
        if total <= 0:
            raise ValueError("at least one ranking weight must be positive")
        return {k: v / total for k, v in clamped.items()}


def component_scores(papers: DataFrame, question: Question, extracted: DataFrame | None = None) -> DataFrame:
    """``record_id`` and the nine component scores of every paper that is not retracted.

    Semantic and graph signals are joined by name if ``papers`` has them (``semantic_score``, ``graph_score``), else neutral.
    ``extracted(record_id)`` lists the papers with extracted text. The words of each text are found once.
    """
    listed = lambda name: F.array_join(F.coalesce(F.col(name), F.array().cast("array<string>")), " ")
    eligible = papers.where(~F.coalesce("is_retracted", F.lit(False)))
    if extracted is None:
        eligible = eligible.withColumn("_extracted", F.lit(False))
    else:
        known = extracted.select("record_id").where("record_id is not null").distinct().withColumn("_extracted", F.lit(True))
        eligible = eligible.join(known, "record_id", "left").withColumn("_extracted", F.coalesce("_extracted", F.lit(False)))
    latest = eligible.agg(F.max("year").alias("latest_year"))  # one row
    age = F.when(F.coalesce("year", F.lit(0)) != 0, F.greatest(F.lit(0), F.col("latest_year") - F.col("year")) + 1).otherwise(1)
    counted = eligible.join(F.broadcast(latest)).withColumn("_adjusted", F.log1p(F.greatest(F.lit(0.0), F.col("citation_count").cast("double"))) / F.sqrt(age))
    scaled = wx.scaled_within(counted, "provider", "_adjusted", "_citation")
    has = lambda name: F.coalesce(F.col(name), F.lit(0.5)) if name in papers.columns else F.lit(0.5)
    words = F.struct(*[fx.tokens(c).alias(n) for n, c in (("t", F.col("title")), ("a", F.col("abstract")), ("p", listed("publication_types")), ("k", listed("keywords")), ("f", listed("fields_of_study")))])
    union = lambda w, *names: F.array_distinct(F.concat(*[w[n] for n in names]))
    matched = F.element_at(
        F.transform(
            F.array(words),
            lambda w: F.struct(
                fx.match_score(list(question.terms), w["t"]).alias("title"),
                fx.match_score(list(question.terms), w["a"]).alias("abstract"),
                F.element_at(F.transform(F.array(union(w, "t", "a", "p", "k")), lambda h: fx.match_score(list(question.methods), h)), 1).alias("method"),
                F.element_at(F.transform(F.array(union(w, "f", "k", "t", "a")), lambda h: fx.match_score(list(question.fields), h)), 1).alias("field"),
            ),
        ),
        1,
    )
    return scaled.withColumn("_m", matched).select(
        "record_id",
        fx.record_key().alias("record_key"),
        F.col("_m.title").alias("title_match"),
        F.when(F.coalesce("abstract", F.lit("")) == "", 0.5).otherwise(F.col("_m.abstract")).alias("abstract_match"),
        F.col("_m.method").alias("method_match"),
        F.col("_m.field").alias("field_match"),
        fx.year_score(F.col("year"), question.after, question.before, question.target).alias("year_fit"),
        has("semantic_score").alias("semantic_similarity"),
        has("graph_score").alias("seed_graph_proximity"),
        fx.evidence_score(F.col("_extracted")).alias("evidence_availability"),
        F.coalesce("_citation", F.lit(0.0)).alias("normalized_citation_signal"),
    )


def rank_papers(papers: DataFrame, question: Question, extracted: DataFrame | None = None) -> DataFrame:
    """``record_id``, total score (6 digits) and rank of every eligible paper; totals equal to 12 digits are ordered by key and id."""
    weights = question.normal_weights()
    scores = component_scores(papers, question, extracted)
    total = sum(F.col(k) * w for k, w in weights.items())
    totals = scores.select("record_id", "record_key", F.round(total, 12).alias("_total"))
    return wx.ranked(totals, [F.desc("_total"), F.asc("record_key"), F.asc("record_id")]).select("record_id", F.round("_total", 6).alias("total_score"), "rank")


def semantic_signals(papers: DataFrame, backends: Mapping[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """``(record_id, semantic_score)``, the mean of all backends' scores scaled to [0, 1], and the backends that failed.

    A backend maps papers to ``(record_id, score)``. One that fails is on record with the kind of its error and stops nothing;
    if all fail there are no signals, and the ranking takes the neutral value.
    """
    scores, failures = [], {}
    for name, backend in backends.items():
        try:
            scores.append(cut(backend(papers).select("record_id", F.lit(name).alias("_backend"), F.col("score").cast("double").alias("_score")).where("_score is not null")))
        except Exception as e:  # noqa: BLE001 - whatever a backend raises is its failure, not the ranking's
            failures[name] = type(e).__name__
    if not scores:
        return None, failures
    scaled = wx.scaled_within(reduce(DataFrame.unionByName, scores), "_backend", "_score", "_scaled")
    return scaled.groupBy("record_id").agg(F.avg("_scaled").alias("semantic_score")), failures
