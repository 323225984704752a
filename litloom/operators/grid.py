"""Tables and grids: profiles, rectangular grids from samples, resampling, vector components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litloom.runtime import cut


def profile(df: DataFrame) -> DataFrame:
    """``(column, type, n_rows, n_null)`` of every column; NaN counts as null. One pass over the data."""
    kinds = dict(df.dtypes)
    missing = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(missing(c)).alias(c) for c in df.columns])  # one row
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col("_n").alias("n_rows"), F.col(c).alias("n_null")) for c in df.columns])
    return counts.select(F.inline(rows))


def from_samples(df: DataFrame, x: str, y: str, value: str, duplicates: str = "error", allow_incomplete: bool = False, max_cells: int = 1_000_000) -> DataFrame:
    """``(x, y, value)`` of a rectangular grid from unordered samples.

    Not finite coordinates or values, repeated points (unless ``duplicates`` is ``identical`` and their values agree),
    missing cells (unless allowed, then null) and unstructured points are errors.
    """
    if duplicates not in ("error", "identical"):
        raise ValueError("duplicates must be error or identical")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    points = cut(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("value")))
    bad = points.where(~(finite("x") & finite("y") & finite("value"))).limit(1).count()
    if bad:
        raise ValueError("coordinates and values must be finite")
    cells = cut(points.groupBy("x", "y").agg(F.min("value").alias("value"), F.max("value").alias("_hi"), F.count("*").alias("_n")))
    facts = cells.agg(
        F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"), F.count("*").alias("present"), F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("value") != F.col("_hi")).alias("conflicting")
    ).first()
    if min(facts["nx"] or 0, facts["ny"] or 0) < 2:
        raise ValueError("a grid needs two distinct coordinates on each axis")
    if facts["repeated"] and duplicates == "error":
        raise ValueError("repeated coordinates")
    if facts["conflicting"]:
        raise ValueError("repeated coordinates hold conflicting values")
    total = facts["nx"] * facts["ny"]
    if total != facts["present"] and not allow_incomplete:
        raise ValueError("incomplete grid")
    if total > max(4 * facts["present"], max_cells):
        raise ValueError("coordinates are unstructured")
    if total == facts["present"]:
        return cells.select("x", "y", "value")
    axes = cells.select("x").distinct().join(F.broadcast(cells.select("y").distinct()))  # the grid itself, bounded above
    return axes.join(cells.select("x", "y", "value"), ["x", "y"], "left")


def _interpolated(df: DataFrame, along: str, other: str, targets: list[float]) -> DataFrame:
    """Linear interpolation of ``value`` along one axis at the targets, each line of the other axis by itself."""
    line = Window.partitionBy(other).orderBy(along)
    segments = df.select(other, F.col(along).alias("_a"), F.col("value").alias("_va"), F.lead(along).over(line).alias("_b"), F.lead("value").over(line).alias("_vb"))
    hits = F.filter(F.array(*[F.lit(float(t)) for t in targets]), lambda t: ((t >= F.col("_a")) & (t < F.col("_b"))) | (F.col("_b").isNull() & (t == F.col("_a"))))
    at = segments.select("*", F.explode(hits).alias(along))
    fraction = F.when(F.col("_b").isNull(), 0.0).otherwise((F.col(along) - F.col("_a")) / (F.col("_b") - F.col("_a")))
    return at.select(along, other, (F.col("_va") + fraction * (F.coalesce("_vb", "_va") - F.col("_va"))).alias("value"))


def resample(grid: DataFrame, xs: list[float], ys: list[float]) -> DataFrame:
    """Bilinear values of a complete grid at ``xs`` times ``ys``, first along x, then along y; no extrapolation."""
    for targets in (xs, ys):
        if len(targets) < 2 or any(b <= a for a, b in zip(targets, targets[1:])):
            raise ValueError("targets must be increasing")
    b = grid.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count_if(F.col("value").isNull() | F.isnan("value"))).first()
    if b[4]:
        raise ValueError("missing cells cannot be bridged")
    if xs[0] < b[0] or xs[-1] > b[1] or ys[0] < b[2] or ys[-1] > b[3]:
        raise ValueError("targets lie outside the grid")
    return _interpolated(_interpolated(grid, "x", "y", xs), "y", "x", ys).select("x", "y", "value")


def vector(u: Column, v: Column, mask_at: float = 0.0) -> list[Column]:
    """Magnitude, direction in units of pi and unit components of a vector; null where the magnitude is masked."""
    size = F.hypot(u, v)
    shown = lambda c: F.when(size > mask_at, c)
    return [size.alias("magnitude"), shown(F.atan2(v, u) / F.pi()).alias("direction"), shown(u / size).alias("unit_u"), shown(v / size).alias("unit_v")]
