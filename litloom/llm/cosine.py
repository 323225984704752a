"""Distributed sparse cosine join of weighted feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litloom.runtime import cut


def cosine_pairs(features: DataFrame, n: int, threshold: float, rare_enough: int = 1, power: float = 1.0, among: DataFrame | None = None) -> DataFrame:
    """``(a, b, cosine)`` for all pairs ``a < b`` of ids whose cosine is at least ``threshold``.

    ``features(id, feature, tf)`` are weighted by ``tf`` and rarity among the ``n`` vectors; features of fewer than
    ``rare_enough`` vectors weigh alike; ``power`` above 1 makes rarity count for more. Exact prefix filter: a vector's features are ordered by rarity, and those are
    joined whose weight together with all more frequent ones still reaches the threshold; a pair that has only the rest
    in common cannot reach it. So the features that most vectors share are not joined.

    With ``among(a, b)`` only these pairs are looked at, ``a < b`` and each once; rarity is still that among all vectors.
    """
    features = cut(features)
    frequency = features.groupBy("feature").agg(F.count("*").alias("df"))
    rarity = F.pow(F.log(F.lit(n + 1.0 + rare_enough) / F.greatest("df", F.lit(rare_enough))) + 0.1, F.lit(power))
    weighted = features.join(frequency, "feature").select("id", "feature", "df", (F.col("tf") * rarity).alias("w"))
    of_id = Window.partitionBy("id")
    rest = F.sum(F.col("w") * F.col("w")).over(of_id.orderBy("df", "feature").rowsBetween(0, Window.unboundedFollowing))
    total = F.sum(F.col("w") * F.col("w")).over(of_id)
    vectors = cut(
        weighted.select("id", "feature", "df", "w", rest.alias("rest"), total.alias("total")).select(
            "id", "feature", (F.col("w") / F.sqrt("total")).alias("w"), (F.col("rest") / F.col("total")).alias("rest"), "df"
        )
    )
    if among is None:
        prefix = vectors.where((F.col("rest") >= threshold * threshold) & (F.col("df") > 1)).select("id", "feature")
        among = prefix.select(F.col("id").alias("a"), "feature").join(prefix.select(F.col("id").alias("b"), "feature"), "feature").where("a < b").select("a", "b").distinct()
    shared = vectors.where("df > 1")
    va = shared.select(F.col("id").alias("a"), "feature", F.col("w").alias("wa"))
    vb = shared.select(F.col("id").alias("b"), "feature", F.col("w").alias("wb"))
    return among.join(va, "a").join(vb, ["b", "feature"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= threshold)
