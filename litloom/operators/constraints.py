"""Constraints as queries: each returns the rows that break it; none means it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = ("check_id", "severity", "subject_id", "message")


def violations(df: DataFrame, check_id: str, subject: Column, message: Column, severity: str = "error") -> DataFrame:
    """Broken rows in the common form of all constraints."""
    return df.select(F.lit(check_id).alias("check_id"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject_id"), message.alias("message"))


def unique(df: DataFrame, keys: list[str], check_id: str = "duplicate-id") -> DataFrame:
    """Keys that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return violations(repeated, check_id, F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.concat(F.col("n").cast("string"), F.lit(" rows")))


def not_blank(df: DataFrame, subject: str, columns: list[str], check_id: str = "blank-cell") -> DataFrame:
    """Cells without a value, one row each."""
    blanks = F.filter(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    return violations(df.select(subject, F.explode(blanks).alias("column")), check_id, F.col(subject), F.col("column"))


def in_vocabulary(df: DataFrame, subject: str, column: str, allowed: tuple[str, ...], check_id: str = "invalid-enum") -> DataFrame:
    """Values outside a closed vocabulary; null is left to not_blank."""
    return violations(df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)), check_id, F.col(subject), F.col(column).cast("string"))


def matches(df: DataFrame, subject: str, column: str, pattern: str, check_id: str = "invalid-id") -> DataFrame:
    """Values that do not have the form of their type."""
    return violations(df.where(F.col(column).isNotNull() & ~F.col(column).rlike(pattern)), check_id, F.col(subject), F.col(column).cast("string"))


def dangling(df: DataFrame, subject: str, reference: str, target: DataFrame, key: str, relation: str) -> DataFrame:
    """References without a target."""
    known = target.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    broken = df.where(F.col(reference).isNotNull()).join(known, F.col(reference) == F.col("_key"), "left_anti")
    return broken.select(F.lit(relation).alias("relation"), F.col(subject).cast("string").alias("subject_id"), F.col(reference).cast("string").alias("missing_id"))


def projection(declared: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """declared-present, declared-missing or observed-undeclared for every key of either side."""
    a, b = declared.select(key).withColumn("_d", F.lit(1)), observed.select(key).withColumn("_o", F.lit(1))
    state = F.when(F.col("_o").isNull(), "declared-missing").when(F.col("_d").isNull(), "observed-undeclared").otherwise("declared-present")
    return a.join(b, key, "full").select(key, state.alias("state"))


def id_closure(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """duplicate, dangling, unreferenced or closed (in that order of precedence) for every id."""
    d = definitions.where("id is not null").groupBy("id").agg(F.count("*").alias("n_def"))
    u = uses.where("id is not null").groupBy("id").agg(F.count("*").alias("n_use"))
    state = F.when(F.coalesce("n_def", F.lit(0)) > 1, "duplicate").when(F.col("n_def").isNull(), "dangling").when(F.col("n_use").isNull(), "unreferenced").otherwise("closed")
    return d.join(u, "id", "full").select("id", state.alias("state"))


def key_presence(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """In which of several tables each key occurs."""
    tagged = reduce(DataFrame.unionByName, [df.select(key).withColumn("_t", F.lit(name)) for name, df in tables.items()])
    flags = [F.bool_or(F.col("_t") == name).alias(f"in_{name}") for name in tables]
    return tagged.groupBy(key).agg(F.countDistinct("_t").alias("n_tables"), *flags)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, changed or same for every key of two states."""
    a, b = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    change = F.when(F.col("_in_b").isNull(), "removed").when(F.col("_in_a").isNull(), "added").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def report(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Number of violations of every named check, 0 for those that hold."""
    found = reduce(DataFrame.unionByName, parts)
    spark = found.sparkSession
    counts = found.groupBy("check_id").agg(F.count("*").alias("n"))
    checks = spark.createDataFrame([(n,) for n in names], "check_id string")
    joined = F.broadcast(checks).join(counts, "check_id", "left")
    return joined.select("check_id", F.coalesce("n", F.lit(0)).alias("n_violations"), F.when(F.col("n").isNull(), "passed").otherwise("failed").alias("status"))
