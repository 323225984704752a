"""Problem 8: filling containers of fixed capacity with texts.

Method: cost-balanced packing. The cost of a text is estimated as linear plus quadratic attention cost of its tokens;
texts are taken in descending order and each goes to the container with the lowest cost that still has room.

Texts are first dealt to shards of like total size (by a hash, so that any split of the input gives the same shards) and
each shard is packed by one task on sizes alone; a shard's size is bounded by ``SHARD_TOKENS``, whatever the input. Within a
shard the number of containers starts at the least that could hold all, and a text that fits into none opens a new one.
A text is divided only if it alone exceeds the capacity: into full containers and a rest that is packed like a text.
Null texts and texts without tokens are not packed; repeated documents are packed each; an empty table gives no containers;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.llm.splitting import size_limit
from litloom.runtime import cut, table

#: The folder of the public tokenizers and the vocabulary that sizes are taken in.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"

#: Tokens that one task packs, and tokens at which quadratic and linear cost are equal.
SHARD_TOKENS, EVEN = 4_000_000, 2048

_ENCODINGS: dict = {}


def vocabulary_files(folder: str, vocabulary: str) -> tuple[str, dict[bytes, int]]:
    """Splitting pattern and ranks of a vocabulary, read on the driver."""
    spec = importlib.util.spec_from_file_location("_tokenizer_files", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{vocabulary}", "rb") as lines:
        return module.PATTERN, {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of every document with a text.

    The vocabulary (a file of fixed size) is read once and travels with the job, so workers need no copy of the folder.
    """
    files = documents.sparkSession.sparkContext.broadcast(vocabulary_files(folder, vocabulary))
    name = f"{folder}/{vocabulary}"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        if name not in _ENCODINGS:
            pattern, ranks = files.value
            _ENCODINGS[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        enc = _ENCODINGS[name]
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) for t in batch["text"]]})

    return documents.select("doc_id", "text").where("text is not null").mapInPandas(count, "doc_id bigint, n_tokens bigint")


def cost(tokens: int) -> float:
    """Linear plus quadratic attention cost of one text."""
    return tokens + tokens * tokens / EVEN


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item (all at most ``capacity``), given in descending order.

    Each item goes to the container of lowest cost among all that have room for it; if none has, a new one is opened. So
    many containers are open from the start as could hold all.
    """
    start = -(-sum(sizes) // capacity)
    rooms = np.full(start, capacity, np.int64)
    spent = np.zeros(start)
    placed = []
    for size in sizes:
        costs = np.where(rooms >= size, spent, np.inf)
        at = int(costs.argmin()) if len(costs) else 0
        if at == len(costs) or costs[at] == np.inf:
            at = len(rooms)
            rooms, spent = np.append(rooms, capacity), np.append(spent, 0.0)
        rooms[at] -= size
        spent[at] += cost(size)
        placed.append(at)
    return placed


def pack_texts(counts: DataFrame, capacity: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(container_id, doc_id, part_no, n_tokens)``: every text, or part of one that exceeds the capacity, once."""
    counts = cut(counts.where("n_tokens > 0"))
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    parts = counts.select(
        "doc_id",
        F.explode(F.sequence(F.lit(1), F.expr(f"cast(ceil(n_tokens / {capacity}) as int)"))).alias("part_no"),
        "n_tokens",
    ).select("doc_id", "part_no", F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - (F.col("part_no") - 1) * capacity).alias("n_tokens"))
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(shards)))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True])
        shard = int(rows["shard"].iloc[0])
        placed = pack(rows["n_tokens"].tolist(), capacity)
        ids = [shard * (1 << 32) + k for k in placed]
        return rows[["doc_id", "part_no", "n_tokens"]].assign(container_id=ids)[["container_id", "doc_id", "part_no", "n_tokens"]]

    return dealt.groupBy("shard").applyInPandas(fill, "container_id bigint, doc_id bigint, part_no int, n_tokens bigint")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its container of ``context_pack`` size."""
    capacity, _ = size_limit(spark, sf_dir, "context_pack")
    return pack_texts(token_counts(table(spark, sf_dir, "documents")), capacity)


def p8_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full and how balanced the containers are: number, tokens, room, the least number that could hold all, and the spread of cost."""
    capacity, _ = size_limit(spark, sf_dir, "context_pack")
    tokens = F.col("n_tokens").cast("double")
    packed = p8_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.sum(tokens + tokens * tokens / EVEN).alias("cost"))
    return packed.agg(
        F.count("*").alias("n_containers"),
        F.sum("tokens").alias("n_tokens"),
        F.max("tokens").alias("largest"),
        F.round(1 - F.sum("tokens") / (F.count("*") * capacity), 6).alias("unused_share"),
        F.expr(f"cast(ceil(sum(tokens) / {capacity}) as bigint)").alias("least_containers"),
        F.round(F.stddev_pop("cost") / F.avg("cost"), 6).alias("cost_spread"),
    )


QUERIES = {"p8_containers": p8_containers, "p8_fill_report": p8_fill_report}
