"""Document parsing, chunking, planning and streaming as queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from litloom.functions import documents as dx
from litloom.registry import register
from litloom.runtime import table
from litloom.streaming import ledger


def parsed(df, column: str, reader, schema: str):
    """One row per part that ``reader(text)`` yields, with the key ``parsed_id``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *part) for key, text in zip(batch["parsed_id"], batch[column]) for part in reader(text)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return df.select("parsed_id", column).mapInPandas(read, schema)


@register("sf_32_markdown_sections")
def sf_32(spark, sf):
    """Sections of the Markdown of all parsed documents; tested on fixtures."""
    reader = lambda t: [(k, title, body) for k, (title, body) in enumerate(dx.markdown_sections(t), 1)]
    return parsed(table(spark, sf, "parsed_documents"), "markdown", reader, "parsed_id bigint, section_no int, title string, text string")


@register("sf_33_markdown_tables")
def sf_33(spark, sf):
    """Tables of the Markdown of all parsed documents; tested on fixtures."""
    reader = lambda t: [(k, x["line"], len(x["header"]), len(x["rows"]), len(x["bad_lines"])) for k, x in enumerate(dx.markdown_tables(t), 1)]
    return parsed(table(spark, sf, "parsed_documents"), "markdown", reader, "parsed_id bigint, table_no int, line int, n_columns int, n_rows int, n_bad int")


@register("sf_23_packed_paragraphs")
def sf_23(spark, sf):
    """Texts packed into chunks of about 1800 characters; tested on fixtures."""
    reader = lambda t: [(k, len(c), c) for k, c in enumerate(dx.pack_paragraphs(t), 1)]
    return parsed(table(spark, sf, "parsed_documents"), "text", reader, "parsed_id bigint, chunk_no int, n_chars int, chunk string")


@register("sf_34_evidence_chunks", r"""
WITH s AS (SELECT parsed_id, source_type, i, trim(regexp_replace(coalesce(sections[i].text, ''), '\s+', ' ', 'g')) AS v, coalesce(nullif(sections[i].title, ''), 'section') AS locator FROM (SELECT parsed_id, source_type, sections, unnest(range(1, len(sections) + 1)) AS i FROM parsed_documents)),
c AS (SELECT parsed_id, CASE WHEN captions[i].kind = 'fig' THEN 'figure-caption' ELSE 'table-caption' END AS source_type, 100000 + i AS i, trim(regexp_replace(coalesce(captions[i].text, ''), '\s+', ' ', 'g')) AS v, coalesce(nullif(captions[i].label, ''), 'caption-' || i) AS locator FROM (SELECT parsed_id, captions, unnest(range(1, len(captions) + 1)) AS i FROM parsed_documents)),
r AS (SELECT parsed_id, 'reference-list' AS source_type, 200000 + i AS i, trim(regexp_replace(coalesce(reference_list[i], ''), '\s+', ' ', 'g')) AS v, 'reference-' || i AS locator FROM (SELECT parsed_id, reference_list, unnest(range(1, least(20, len(reference_list)) + 1)) AS i FROM parsed_documents)),
a AS (SELECT parsed_id, source_type, i, v, locator FROM s UNION ALL SELECT parsed_id, source_type, i, v, locator FROM c UNION ALL SELECT parsed_id, source_type, i, v, locator FROM r),
f AS (SELECT parsed_id, source_type, 300000 AS i, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS v, 'text' AS locator FROM parsed_documents WHERE parsed_id NOT IN (SELECT parsed_id FROM a WHERE v <> '')),
u AS (SELECT parsed_id, source_type, locator, v, min(i) AS i FROM (SELECT * FROM a UNION ALL SELECT parsed_id, source_type, i, v, locator FROM f) WHERE v <> '' GROUP BY 1, 2, 3, 4)
SELECT parsed_id, source_type, locator, sha256(v) AS content_hash, CAST(row_number() OVER (PARTITION BY parsed_id ORDER BY i) AS INTEGER) AS chunk_no FROM u
""")  # fmt: skip
def sf_34(spark, sf):
    """Chunks of sections, captions and the first 20 references with their hashes, in reading order, repeats dropped.

    A document without any of these has its text as one chunk (which SF-23 packs further).
    """
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    named = lambda c, default: F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(c)
    part = lambda kind, locator, text: F.struct(kind.alias("source_type"), locator.alias("locator"), clean(text).alias("v"))
    d = table(spark, sf, "parsed_documents").select("parsed_id", "source_type", "text", "sections", "captions", "reference_list")
    numbered = lambda prefix, i: F.concat(F.lit(prefix), (i + 1).cast("string"))
    sections = F.transform("sections", lambda s: part(F.col("source_type"), named(s["title"], F.lit("section")), s["text"]))
    captions = F.transform("captions", lambda c, i: part(F.when(c["kind"] == "fig", "figure-caption").otherwise("table-caption"), named(c["label"], numbered("caption-", i)), c["text"]))
    refs = F.transform(F.slice("reference_list", 1, 20), lambda r, i: part(F.lit("reference-list"), numbered("reference-", i), r))
    kind = "array<struct<source_type:string,locator:string,v:string>>"
    empty = F.array().cast(kind)
    parts = F.concat(*[F.coalesce(x.cast(kind), empty) for x in (sections, captions, refs)])
    whole = F.array(part(F.col("source_type"), F.lit("text"), F.col("text"))).cast(kind)
    filled = lambda x: F.filter(x, lambda p: p["v"] != "")
    kept = F.array_distinct(F.when(F.size(filled(parts)) > 0, filled(parts)).otherwise(filled(whole)))
    return d.select("parsed_id", F.posexplode(kept)).select("parsed_id", "col.source_type", "col.locator", F.sha2("col.v", 256).alias("content_hash"), (F.col("pos") + 1).alias("chunk_no"))


@register("stm_01_ledger_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stm_01(spark, sf):
    """Extension: hourly totals of the ledger, the batch form of the stream in litloom.streaming.ledger."""
    return ledger.hourly(table(spark, sf, "events"))
