"""Readers of tables: CSV, TSV, text, JSON, XLSX, NPY and NPZ."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession

FORMATS = {".csv": "csv", ".tsv": "tsv", ".txt": "text", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".xlsx": "xlsx", ".npy": "npy", ".npz": "npz"}


def infer_format(path: str, explicit: str | None = None) -> str:
    """The format of a file by its extension, unless given; old binary workbooks and unknown ones are errors."""
    kind = explicit or FORMATS.get(os.path.splitext(path)[1].lower())
    if kind not in set(FORMATS.values()):
        raise ValueError(f"unsupported table format: {explicit or path}")
    return kind


def array_frame(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """Structured arrays by their fields, one dimension as ``value``, two as ``col_0``, ``col_1``, …; more are errors."""
    if array.dtype.names:
        rows, names = array.tolist(), list(array.dtype.names)
    elif array.ndim == 1:
        rows, names = [(v,) for v in array.tolist()], ["value"]
    elif array.ndim == 2:
        rows, names = [tuple(r) for r in array.tolist()], [f"col_{i}" for i in range(array.shape[1])]
    else:
        raise ValueError("arrays of more than two dimensions are no tables")
    if not rows:
        raise ValueError("the table is empty")
    return spark.createDataFrame(rows, names)


def load_table(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A table from a file or folder. Duplicate column names and empty tables are errors.

    Text formats are read by Spark's own scans; options ``delimiter``, ``comment``, ``encoding``, ``header``, ``schema`` and
    ``array`` (name within an NPZ file). Workbooks and NumPy files are read on the driver, as they are single files.
    """
    kind = infer_format(path, kind)
    if kind in ("csv", "tsv", "text"):
        reader = spark.read.option("header", options.get("header", True)).option("encoding", options.get("encoding", "UTF-8")).option("sep", options.get("delimiter", "\t" if kind == "tsv" else ","))
        if options.get("comment"):
            reader = reader.option("comment", options["comment"])
        reader = reader.schema(options["schema"]) if options.get("schema") else reader.option("inferSchema", True)
        df = reader.csv(path)
    elif kind == "json":
        df = spark.read.option("multiLine", path.endswith(".json")).json(path, schema=options.get("schema"))
    elif kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "npy":
        df = array_frame(spark, np.load(path, allow_pickle=False))
    elif kind == "npz":
        with np.load(path, allow_pickle=False) as arrays:
            df = array_frame(spark, arrays[options.get("array") or arrays.files[0]])
    else:
        import pandas as pd  # reading workbooks needs an optional engine

        df = spark.createDataFrame(pd.read_excel(path, sheet_name=options.get("sheet_name", 0)))
    names = [c.lower() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("column names repeat")
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df
