"""Ranking and entity resolution as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from litloom.catalogue import scalars as sc
from litloom.operators import rank, resolve
from litloom.registry import register
from litloom.runtime import table

QUESTION = rank.Question(tuple(sc.TERMS), methods=("microscopy", "simulation"), fields=("ecology", "physics"), after=2015, before=2022)

_LISTS = {"publication_types", "keywords", "fields_of_study"}


def _words(*names: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"array_to_string(coalesce({n}, []), ' ')" if n in _LISTS else f"coalesce({n}, '')" for n in names) + ")"


_COMPONENTS = f"""
WITH p AS (SELECT *, {_words('title', 'abstract', 'publication_types', 'keywords')} AS mt, {_words('fields_of_study', 'keywords', 'title', 'abstract')} AS ft FROM paper_records WHERE NOT coalesce(is_retracted, false)),
y AS (SELECT max(year) AS ref FROM p), a AS (SELECT p.*, ln(1 + greatest(0.0, citation_count::DOUBLE)) / sqrt(CASE WHEN coalesce(year, 0) <> 0 THEN greatest(0, ref - year) + 1 ELSE 1 END) AS adj FROM p, y),
c AS (SELECT *, CASE WHEN citation_count IS NULL THEN 0.0 WHEN abs(max(adj) OVER w - min(adj) OVER w) <= 1e-9 * greatest(abs(max(adj) OVER w), abs(min(adj) OVER w)) THEN 1.0 ELSE (adj - min(adj) OVER w) / nullif(max(adj) OVER w - min(adj) OVER w, 0) END AS cit FROM a WINDOW w AS (PARTITION BY provider)),
s AS (SELECT record_id, {sc._SQL_RECORD_KEY} AS record_key, {sc.sql_match('title')} AS title_match, CASE WHEN coalesce(abstract, '') = '' THEN 0.5 ELSE {sc.sql_match('abstract')} END AS abstract_match,
{sc.sql_match('mt', ['microscopy', 'simulation'])} AS method_match, {sc.sql_match('ft', ['ecology', 'physics'])} AS field_match, CASE WHEN year IS NULL THEN 0.5 ELSE 1.0 / (1 + greatest(2015 - year, 0) + greatest(year - 2022, 0)) END AS year_fit,
CAST((CASE WHEN coalesce(abstract, '') <> '' THEN 0.45 ELSE 0 END) + (CASE WHEN record_id IN (SELECT d.record_id FROM parsed_documents d JOIN evidence_chunks e USING (parsed_id) WHERE d.record_id IS NOT NULL AND trim(e.text) <> '') THEN 0.35 ELSE 0 END) + (CASE WHEN {sc._SQL_HAS_ID} THEN 0.1 ELSE 0 END) + (CASE WHEN coalesce(is_open_access, false) THEN 0.1 ELSE 0 END) AS DOUBLE) AS evidence_availability, coalesce(cit, 0.0) AS citation FROM c),
t AS (SELECT record_id, record_key, round(CAST(0.32 AS DOUBLE) * title_match + CAST(0.27 AS DOUBLE) * abstract_match + CAST(0.13 AS DOUBLE) * method_match + CAST(0.11 AS DOUBLE) * field_match + CAST(0.06 AS DOUBLE) * year_fit + 0.05::DOUBLE * 0.5::DOUBLE + 0.02::DOUBLE * 0.5::DOUBLE + 0.02::DOUBLE * evidence_availability + 0.02::DOUBLE * citation, 12) AS total FROM s)
"""


@register("rnk_01_rank_papers", _COMPONENTS + "SELECT record_id, round(total, 6) AS total_score, row_number() OVER (ORDER BY total DESC, record_key, record_id) AS rank FROM t")
def rnk_01(spark, sf):
    """All eligible papers ranked for a question."""
    return rank.rank_papers(table(spark, sf, "paper_records"), QUESTION, sc.extracted(spark, sf))


@register("rnk_02_components", _COMPONENTS + "SELECT record_id, round(title_match, 6) AS title_match, round(abstract_match, 6) AS abstract_match, round(method_match, 6) AS method_match, round(field_match, 6) AS field_match, round(year_fit, 6) AS year_fit, round(evidence_availability, 6) AS evidence_availability, round(citation, 6) AS normalized_citation_signal FROM s")
def rnk_02(spark, sf):
    names = ("title_match", "abstract_match", "method_match", "field_match", "year_fit", "evidence_availability", "normalized_citation_signal")
    return rank.component_scores(table(spark, sf, "paper_records"), QUESTION, sc.extracted(spark, sf)).select("record_id", *[F.round(n, 6).alias(n) for n in names])


@register("src_13_recommend", """
WITH s AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT vec_id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST(s.e AS DOUBLE[])), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda z: z * z))) * sqrt(list_sum(list_transform(CAST(s.e AS DOUBLE[]), lambda z: z * z)))), 6) AS similarity FROM embeddings, s
""")  # fmt: skip
def src_13(spark, sf):
    """Cosine similarity of every vector to a seed."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    seed = F.broadcast(e.agg(F.min_by("v", "vec_id").alias("s")))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return e.join(seed).select("vec_id", F.round(dot("v", "s") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("s", "s"))), 6).alias("similarity"))


_KEYS = " UNION ALL ".join(f"SELECT record_id, '{p}:' || lower({c}) AS k FROM paper_records WHERE coalesce({c}, '') <> ''" for p, c in resolve.IDS.items())


@register("jn_01_components", f"""
WITH RECURSIVE t AS (SELECT record_id, {sc.SQL_TITLE.format(c='title')} AS title FROM paper_records), keys AS ({_KEYS} UNION ALL SELECT record_id, 'title:' || title FROM t WHERE length(title) >= 20),
firsts AS (SELECT k, min(record_id) AS f FROM keys GROUP BY k), star AS (SELECT DISTINCT record_id AS a, f AS b FROM keys JOIN firsts USING (k)), edges AS (SELECT a, b FROM star UNION SELECT b, a FROM star),
reach(a, b) AS (SELECT record_id, record_id FROM paper_records UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT a AS record_id, min(b) AS component FROM reach GROUP BY a
""")  # fmt: skip
def jn_01(spark, sf):
    """Component of every record: those that share a key, directly or over others."""
    return resolve.components(table(spark, sf, "paper_records"))


@register("jn_02_merged_records")
def jn_02(spark, sf):
    """One surviving record per entity; tested against a sequential fold."""
    return resolve.merge_records(table(spark, sf, "paper_records"))


@register("agg_03_router_coverage")
def agg_03(spark, sf):
    """Unique records after merging, those with a stable identifier, and their share."""
    merged = resolve.merge_records(table(spark, sf, "paper_records"))
    n, stable = F.count("*"), F.count_if("has_identifier")
    return merged.agg(n.alias("n_unique"), stable.alias("n_stable"), F.round(F.coalesce(F.try_divide(stable, n), F.lit(0.0)), 6).alias("stable_share"))
