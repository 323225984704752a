"""Folders of files as tables, settings and specifications, a cache of answers, ledgers that grow, and packets of results."""

from __future__ import annotations

import json
import tomllib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.functions import identifiers as ix
from litloom.functions import text as fx


def observed_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, size, sha256)`` of every file below a folder, the path relative to it; the files are read by the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(inside.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _unique_pairs(pairs: list[tuple]) -> dict:
    names = [k for k, _ in pairs]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated keys: {sorted({k for k in names if names.count(k) > 1})}")
    return dict(pairs)


def load_spec(path: str) -> dict:
    """A JSON object in which no key is repeated."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file, object_pairs_hook=_unique_pairs)
    if not isinstance(spec, dict):
        raise ValueError("a specification is one JSON object")
    return spec


def load_manifest(path: str, kind: str) -> dict:
    """A manifest, which must say that it is of the kind asked for."""
    manifest = load_spec(path)
    if manifest.get("kind") != kind:
        raise ValueError(f"a manifest of {manifest.get('kind')!r}, not of {kind!r}")
    return manifest


def load_settings(path: str) -> dict:
    """Settings in TOML."""
    with open(path, "rb") as file:
        return tomllib.load(file)


def request_key(method, url, body):
    """What identifies a request in the cache."""
    return F.sha2(F.concat_ws("\n", F.upper(method), url, F.coalesce(body, F.lit(""))), 256)


def read_through(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests(method, url, body)`` with ``key``, ``answer`` and ``hit``; an answer that is no JSON is a miss."""
    keyed = requests.withColumn("key", request_key(F.col("method"), F.col("url"), F.col("body")))
    sound = cache.where(F.call_function("try_parse_json", F.col("answer")).isNotNull()).groupBy("key").agg(F.max_by("answer", "stored_at").alias("answer"))
    return keyed.join(sound, "key", "left").withColumn("hit", F.col("answer").isNotNull())


def write_answers(answers: DataFrame, folder: str) -> None:
    """Append ``(key, url, answer, stored_at)`` to the cache, secrets in addresses hidden."""
    answers.withColumn("url", fx.redact_url(F.col("url"))).write.mode("append").parquet(folder)


def append_log(entries: DataFrame, folder: str, arguments: str | None = None) -> None:
    """Append rows to a ledger of JSON lines; an array of arguments is written without its secrets."""
    rows = entries.withColumn(arguments, ix.redacted_arguments(F.col(arguments))) if arguments else entries
    rows.write.mode("append").json(folder)


def save_packet(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Each table as JSON lines in a folder of its own; what is there is replaced by Spark's commit, or stays whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    return sorted(tables)


def packet_markdown(references: DataFrame, title: str) -> DataFrame:
    """``(line_no, line)`` of a report: a title, then for each type of publication a heading and its references by id."""
    kind = F.coalesce(F.get("publication_types", F.lit(0)), F.lit("other"))
    cite = F.concat(F.lit("- "), F.coalesce("title", F.lit("(untitled)")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit(")"))
    rows = references.select(kind.alias("kind"), F.lit(1).alias("part"), F.col("record_id"), cite.alias("line"))
    heads = rows.groupBy("kind").agg(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("record_id")).select("kind", "part", "record_id", F.concat(F.lit("## "), "kind").alias("line"))
    first = references.sparkSession.createDataFrame([("", 0, 0, f"# {title}")], "kind string, part int, record_id bigint, line string")
    from litloom.operators.windows import ranked

    return ranked(first.unionByName(heads).unionByName(rows), [F.asc("kind"), F.asc("part"), F.asc("record_id")], "line_no").select("line_no", "line")


def load_npz_field(spark: SparkSession, path: str, x: str, y: str, value: str, time: int | None = None, scale: float = 1.0, digits: int | None = None) -> DataFrame:
    """``(x, y, value)`` of named arrays: one time slice if there are several, scaled and rounded."""
    with np.load(path, allow_pickle=False) as arrays:
        xs, ys, field = arrays[x], arrays[y], arrays[value]
    if field.ndim == 3:
        if time is None or not -len(field) <= time < len(field):
            raise ValueError("a field with times needs the number of one of them")
        field = field[time]
    if field.shape != (len(ys), len(xs)):
        raise ValueError(f"a field of shape {field.shape} over {len(ys)} by {len(xs)} points")
    field = field * scale if digits is None else np.round(field * scale, digits)
    grid = pd.DataFrame({"x": np.tile(xs, len(ys)), "y": np.repeat(ys, len(xs)), "value": field.ravel()}).astype("float64")
    return spark.createDataFrame(grid)
