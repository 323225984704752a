"""Session-level helpers shared by every operator: table loading, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}

#: Largest estimated size, in bytes, of a side that may be broadcast.
BROADCAST_LIMIT = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application under ``spark.checkpoint.dir``; it is removed when the session's JVM ends.

    Only a session on one machine (tests, a local run) may do without the setting and gets a folder of its own; anywhere
    else executors could not read what others wrote there, so it is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="litloom-")
        folder = f"{named.rstrip('/')}/litloom-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[sc.applicationId] = folder
    return _FOLDERS[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it, so that later stages survive lost executors.

    A table takes far less room than the serialised rows of a checkpoint, is read column by column, and its size is known
    to the optimizer.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; file sizes for scans, an upper estimate elsewhere."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is within ``limit``, else unchanged (a shuffle join)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def hash_key(*cols) -> "F.Column":
    """64-bit key of the given columns."""
    return F.xxhash64(*cols)
