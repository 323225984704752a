"""Problem 3: splitting oversized items at natural boundaries.

Method: lexical-cohesion segmentation. For every place where a text may be cut, the words of the blocks before and after
it are compared; valleys of that similarity mark changes of topic. Within the window in which a piece must end, the piece
ends at the deepest valley of the best kind of boundary there is (paragraph or sentence, else clause, else word, else any
code point that does not tear a combined character). The next piece starts ``overlap`` code points before the cut.

Pieces never exceed the limit, together cover the text, and overlap by exactly the stated number of code points. Items
within the limit, null and empty texts make no pieces; repeated rows count once; empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.runtime import table

#: Words in the blocks that are compared; share of a piece's room that must be filled before it may end.
BLOCK_WORDS, LEAST_FILL = 40, 0.5

_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W\d_]{4,}")
_SENTENCE = re.compile(r"\n[ \t]*\n\s*|[.!?][\"'”’)\]]*\s+(?=\S)|[。！？；][”」』]*|\n(?=[#|*\-•\d])")
_SHORT = re.compile(r"\b(approx|al|bzw|ca|cf|e\.g|eq|fig|i\.e|no|ref|sect|tab|vgl|vol|vs|z\. ?b)$", re.IGNORECASE)
_CLAUSE = re.compile(r"[,;:，、：]\s*|\n")
_SPACE = re.compile(r"\s+")


def boundaries(text: str) -> dict[int, int]:
    """Places to cut (offset of the next character) with their kind: 3 paragraph, 2 sentence."""
    found: dict[int, int] = {}
    for m in _SENTENCE.finditer(text):
        if m.group()[0] == "." and _SHORT.search(text, max(0, m.start() - 12), m.start()):
            continue
        found[m.end()] = 3 if "\n" in m.group() else 2
    return found


def valley_depths(text: str, places: list[int], block: int = BLOCK_WORDS) -> list[float]:
    """For each place how deep the similarity of the words around it lies below the peaks on both sides."""
    words, starts = [], []
    for m in _WORD.finditer(text):
        words.append(m.group().lower())
        starts.append(m.start())
    n = len(words)
    if not n:
        return [0.0] * len(places)
    left: Counter = Counter()
    right = Counter(words[:block])
    dot, left2, right2 = 0, 0, sum(c * c for c in right.values())
    similar, at = [], 0
    for place in places:
        while at < n and starts[at] < place:  # the word at `at` moves from the right block to the left one
            w = words[at]
            a, b = left[w], right[w]
            dot += b - a - 1
            left2 += 2 * a + 1
            right2 -= 2 * b - 1
            left[w], right[w] = a + 1, b - 1
            if at + block < n:
                w = words[at + block]
                dot += left[w]
                right2 += 2 * right[w] + 1
                right[w] += 1
            if at >= block:
                w = words[at - block]
                dot -= right[w]
                left2 -= 2 * left[w] - 1
                left[w] -= 1
            at += 1
        similar.append(dot / (left2 * right2) ** 0.5 if left2 > 0 and right2 > 0 else 0.0)
    # the peak of a place is that of its neighbour as long as the similarity does not fall on the way there
    lefts, rights = list(similar), list(similar)
    for i in range(1, len(similar)):
        if similar[i - 1] >= similar[i]:
            lefts[i] = lefts[i - 1]
    for i in range(len(similar) - 2, -1, -1):
        if similar[i + 1] >= similar[i]:
            rights[i] = rights[i + 1]
    return [a + b - 2 * s for a, b, s in zip(lefts, rights, similar)]


def _whole_character(text: str, place: int, least: int) -> int:
    """The nearest place at or before ``place`` that tears no combined character or line end; ``place`` if none is left."""
    p = place
    while p >= least:
        if not (unicodedata.combining(text[p]) or text[p] in "\u200d\ufe0f" or text[p - 1] == "\u200d" or text[p - 1 : p + 1] == "\r\n"):
            return p
        p -= 1
    return place


def split_points(text: str, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """``(begin, end)`` of the pieces of a text, in code points."""
    n = len(text)
    if n <= max_size:
        return [(0, n)]
    overlap = max(0, min(overlap, max_size - 1))
    kinds = boundaries(text)
    places = sorted(p for p in kinds if 0 < p < n)
    depth = dict(zip(places, valley_depths(text, places)))
    pieces, begin, first = [], 0, 0
    while n - begin > max_size:
        limit = begin + max_size
        # the piece must reach beyond its overlap; a piece may end early only as far as the rest still gets pieces
        least = begin + overlap + max(1, int((max_size - overlap) * LEAST_FILL))
        while first < len(places) and places[first] < least:
            first += 1
        window = []
        i = first
        while i < len(places) and places[i] <= limit:
            window.append(places[i])
            i += 1
        if window:
            end = max(window, key=lambda p: (depth[p] + 0.15 * (kinds[p] == 3), p))
        else:
            part = text[least:limit]
            ends = [m.end() for m in _CLAUSE.finditer(part)] or [m.end() for m in _SPACE.finditer(part)]
            end = least + ends[-1] if ends else _whole_character(text, limit, max(least, limit - 32))
        pieces.append((begin, end))
        begin = end - overlap
    pieces.append((begin, n))
    return pieces


_PIECES = "item_kind string, item_id bigint, item_no bigint, piece_no int, begin int, end int, piece string"


def split_items(items: DataFrame, max_size: int, overlap: int) -> DataFrame:
    """The pieces of all items longer than ``max_size``: their number, place and text.

    ``items`` has ``item_kind, item_id, item_no, text``. Sizes are code points of the text as stored.
    """
    large = items.select("item_kind", "item_id", "item_no", "text").where(F.length("text") > max_size)

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, item, no, text in batch.itertuples(index=False):
                for k, (a, b) in enumerate(split_points(text, max_size, overlap), 1):
                    rows.append((kind, item, no, k, a, b, text[a:b]))
            if rows:
                yield pd.DataFrame(rows, columns=["item_kind", "item_id", "item_no", "piece_no", "begin", "end", "piece"])

    return large.mapInPandas(cut_up, _PIECES)


def size_limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    """``(max_size, overlap)`` of a named limit (one row)."""
    row = table(spark, sf_dir, "size_limits").where(F.col("limit_name") == name).select("max_size", "overlap").first()
    if row is None:
        raise ValueError(f"no size limit is named {name}")
    return int(row["max_size"]), int(row["overlap"] or 0)


def all_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, their sections, and evidence chunks as ``(item_kind, item_id, item_no, text)``."""
    documents = table(spark, sf_dir, "parsed_documents")
    texts = documents.select(F.lit("text").alias("item_kind"), F.col("parsed_id").alias("item_id"), F.lit(0).cast("bigint").alias("item_no"), "text")
    sections = documents.select("parsed_id", F.posexplode("sections")).select(
        F.lit("section").alias("item_kind"), F.col("parsed_id").alias("item_id"), (F.col("pos") + 1).cast("bigint").alias("item_no"), F.col("col.text").alias("text")
    )
    chunks = table(spark, sf_dir, "evidence_chunks").select(
        F.lit("chunk").alias("item_kind"), F.col("parsed_id").alias("item_id"), F.col("chunk_no").cast("bigint").alias("item_no"), "text"
    )
    return texts.unionByName(sections).unionByName(chunks)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized item."""
    max_size, overlap = size_limit(spark, sf_dir, "evidence_chunk")
    return split_items(all_items(spark, sf_dir), max_size, overlap).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that had to be split."""
    max_size, overlap = size_limit(spark, sf_dir, "evidence_chunk")
    return split_items(all_items(spark, sf_dir), max_size, overlap).where("piece_no > 1").select("item_kind", "item_id", "item_no").distinct()


_OVERSIZED = """
WITH l AS (SELECT max_size FROM size_limits WHERE limit_name = 'evidence_chunk'),
items AS (
  SELECT 'text' AS item_kind, parsed_id AS item_id, CAST(0 AS BIGINT) AS item_no, text FROM parsed_documents
  UNION ALL
  SELECT 'section', parsed_id, CAST(i AS BIGINT), sections[i].text FROM (SELECT parsed_id, sections, unnest(range(1, len(sections) + 1)) AS i FROM parsed_documents)
  UNION ALL
  SELECT 'chunk', parsed_id, CAST(chunk_no AS BIGINT), text FROM evidence_chunks
)
SELECT DISTINCT item_kind, item_id, item_no FROM items, l WHERE length(text) > max_size
"""

QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
ORACLES = {"p3_found": _OVERSIZED}
