"""Problem 10: long identical stretches shared between documents.

Method: content-defined chunking with a gear rolling hash. A cut lies where the gear hash of the last 32 code points is
the smallest of its neighbourhood, which depends on nothing but the text around it, so insertions elsewhere shift no
cut, and no chunk is longer than ``SPREAD``. Neighbouring chunks are joined to pieces of at least ``PIECE`` code
points; their digests are deduplicated, and pieces that follow each other in both of two documents make chains. The sizes
are chosen so that a shared stretch of ``MIN_RUN`` code points holds at least one whole piece. A chain that is too short by
itself is verified on the stored text around it, so documents travel as short contexts, not as whole texts.

Identical texts are one text: they are joined as classes, and only the result lists their members. Null and empty texts
share nothing; repeated documents are pairs like any other; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litloom.llm.vectext import code_points, mix
from litloom.runtime import broadcast_if_small, cut, table

#: Code points of a stretch that counts, window of the gear hash, longest gap between cuts, and shortest piece.
MIN_RUN, GEAR, SPREAD, PIECE = 400, 32, 120, 128
assert GEAR + 2 * SPREAD + PIECE <= MIN_RUN

#: Occurrences above which a digest no longer makes pairs by itself: whole stretches around the piece are compared first.
HOT = 64

_U = np.uint64


def gear_cuts(cps: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Positions whose gear hash is the smallest of ``spread`` neighbouring ones, in ascending order."""
    n = len(cps)
    if n <= GEAR:
        return np.zeros(0, np.int64)
    h = (mix(cps.astype(_U) + _U(77)) >> _U(32)).astype(np.uint32)
    width = 1
    while width < GEAR:  # after each round h covers twice as many code points: h[i] = sum of gear[i-k] << k
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
        width *= 2
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    low, width = h, 1
    while 2 * width <= spread:  # low[i] = smallest of h[i .. i+width-1]
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = spread - width
    if rest:
        if len(low) <= rest:
            return np.zeros(0, np.int64)
        low = np.minimum(low[:-rest], low[rest:])
    if len(low) == 0:
        return np.zeros(0, np.int64)
    chosen = np.zeros(n, bool)  # winnowing: every window marks its smallest hashes
    left = np.full(n, np.uint32(0xFFFFFFFF))
    # position p is marked if some window of `spread` hashes that holds p has h[p] as its minimum
    padded = np.concatenate((np.zeros(spread - 1, np.uint32), low, np.zeros(spread - 1, np.uint32)))
    high, width = padded, 1
    while 2 * width <= spread:
        high = np.maximum(high[:-width], high[width:])
        width *= 2
    rest = spread - width
    if rest:
        high = np.maximum(high[:-rest], high[rest:])
    left[: len(high)] = high[:n]
    chosen[: len(high)] = h[: len(high)] == left[: len(high)]
    return np.flatnonzero(chosen)


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, begin, end, digest, periodic)`` of all pieces: from each cut to the first cut at least ``PIECE`` further on.

    Where one piece follows itself again and again, the first and the last one, which are ``periodic``, stand for all.
    """
    cps, offsets = code_points(texts)
    at = gear_cuts(cps)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    text = np.searchsorted(offsets, at, "right") - 1
    usable = at - offsets[text] >= GEAR - 1  # the hash saw nothing of the text before
    at, text = at[usable], text[usable]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(bool)
    end = np.searchsorted(at, at + PIECE)
    ok = end < len(at)
    end = np.where(ok, end, 0)
    ok &= text[end] == text
    begin, stop, text = at[ok], at[end[ok]], text[ok]
    ok = stop - begin <= PIECE + SPREAD
    begin, stop, text = begin[ok], stop[ok], text[ok]
    # digest of a stretch: difference of running sums of scrambled code points, made independent of the place
    base = 0x9E3779B97F4A7C15
    first = mix(cps.astype(_U) + _U(0xABCD1234))
    digest = np.zeros(len(begin), _U)
    power = _U(1)
    length = stop - begin
    for k in range(int(length.max()) if len(length) else 0):
        inside = length > k
        digest[inside] += first[begin[inside] + k] * power
        power = _U((int(power) * base) & 0xFFFFFFFFFFFFFFFF)
    digest = mix(digest ^ (length.astype(_U) << _U(48)))
    same = (digest[1:] == digest[:-1]) & (text[1:] == text[:-1])
    inner = np.zeros(len(digest), bool)
    inner[1:-1] = same[:-1] & same[1:]
    periodic = inner.copy()
    periodic[:-1] |= inner[1:]
    periodic[1:] |= inner[:-1]
    text, begin, stop, digest = text[~inner], begin[~inner], stop[~inner], digest[~inner]
    return text, begin - offsets[text], stop - offsets[text], digest.view(np.int64), periodic[~inner]


_PIECES = "class_id bigint, place int, size int, digest bigint, periodic boolean"


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in range(0, len(batch), 1_000):
            rows = batch.iloc[part : part + 1_000]
            text, begin, end, digest, periodic = pieces(rows["text"].tolist())
            ids = rows["class_id"].to_numpy()
            yield pd.DataFrame({"class_id": ids[text], "place": begin.astype(np.int32), "size": (end - begin).astype(np.int32), "digest": digest, "periodic": periodic})


def common_end(a: str, b: str) -> int:
    """Length of the longest common ending of two texts."""
    n = min(len(a), len(b))
    if n == 0 or a[len(a) - n :] == b[len(b) - n :]:
        return n
    low, high = 0, n  # the endings of length low are equal, those of length high are not
    while high - low > 1:
        middle = (low + high) // 2
        if a[len(a) - middle :] == b[len(b) - middle :]:
            low = middle
        else:
            high = middle
    return low


def common_start(a: str, b: str) -> int:
    """Length of the longest common beginning of two texts."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def text_classes(documents: DataFrame) -> DataFrame:
    """``(doc_id, class_id, length)``: the class of a text is the smallest id of the documents that hold it."""
    keyed = documents.where("text is not null and text <> ''").select(
        "doc_id", F.length("text").alias("length"), F.xxhash64("text").alias("k1"), F.md5("text").alias("k2")
    )
    classes = keyed.groupBy("k1", "k2", "length").agg(F.min("doc_id").alias("class_id"))
    return keyed.join(classes, ["k1", "k2", "length"]).select("doc_id", "class_id", "length")


class Shared:
    """The pieces that different texts share, ready for pairs (``pairs``) or for the shared part of each text (``intervals``).

    ``members`` lists the documents of each class of identical texts, with their length.
    """

    def __init__(self, documents: DataFrame, min_run: int = MIN_RUN):
        self.min_run = min_run
        documents = documents.select("doc_id", "text").where("doc_id is not null")
        self.members = cut(text_classes(documents))
        copies = cut(self.members.where("doc_id <> class_id").select("doc_id"))
        long = documents.where(F.length("text") >= min_run)
        self.texts = long.join(broadcast_if_small(copies), "doc_id", "left_anti").select(F.col("doc_id").alias("class_id"), "text")
        found = cut(self.texts.mapInPandas(_emit, _PIECES))
        hot = (F.count("*") > HOT) | F.bool_or("periodic")
        repeated = found.groupBy("digest").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), hot.alias("hot")).where("lo < hi")
        kept = cut(found.drop("periodic").join(repeated.select("digest", "hot"), "digest"))
        self.plain = kept.where("not hot").select("class_id", "place", "digest", "size")
        self.hot = kept.where("hot").select("class_id", "place", "size", "digest")

    def chains(self) -> DataFrame:
        """``(class_a, class_b, shift, begin, end)``: what pieces that follow each other on one diagonal cover in text a.

        A diagonal is the difference of the places in the two texts. Only pieces of at most ``HOT`` occurrences, none of
        them periodic, make pairs.
        """
        met = _meet(self.plain, ["digest", "size"]).select("class_a", "class_b", (F.col("place_a") - F.col("place_b")).alias("shift"), F.col("place_a").alias("begin"), (F.col("place_a") + F.col("size")).alias("end"))
        diagonal = Window.partitionBy("class_a", "class_b", "shift").orderBy("begin", "end")
        reached = F.max("end").over(diagonal.rowsBetween(Window.unboundedPreceding, -1))
        marked = met.withColumn("new", F.when(F.col("begin") <= reached, 0).otherwise(1)).withColumn("chain", F.sum("new").over(diagonal.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy("class_a", "class_b", "shift", "chain").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("chain")

    def grown(self, chains: DataFrame, margin) -> DataFrame:
        """``chains`` with ``more_before`` and ``more_after``: how far both texts go on alike, up to ``margin`` either way."""
        key = ["class_a", "class_b", "shift", "begin", "end"]
        asked = chains.select(*key, margin.alias("margin"))
        a = asked.select(*key, "margin", F.lit(True).alias("is_a"), F.col("class_a").alias("class_id"), F.col("begin").alias("p"), F.col("end").alias("q"))
        b = asked.select(*key, "margin", F.lit(False).alias("is_a"), F.col("class_b").alias("class_id"), (F.col("begin") - F.col("shift")).alias("p"), (F.col("end") - F.col("shift")).alias("q"))
        placed = self.texts.join(broadcast_if_small(cut(a.unionByName(b))), "class_id")
        from_ = F.greatest(F.lit(0), F.col("p") - F.col("margin"))
        around = placed.select(*key, "is_a", F.substring("text", from_ + 1, F.col("p") - from_).alias("before"), F.substring("text", F.col("q") + 1, F.col("margin")).alias("after"))
        sides = [F.max(F.when(F.col("is_a") == is_a, F.col(c))).alias(f"{c}_{name}") for is_a, name in ((True, "a"), (False, "b")) for c in ("before", "after")]

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                before = [common_end(x, y) for x, y in zip(batch["before_a"], batch["before_b"])]
                after = [common_start(x, y) for x, y in zip(batch["after_a"], batch["after_b"])]
                yield batch[key].assign(more_before=before, more_after=after)

        return around.groupBy(*key).agg(*sides).mapInPandas(compare, "class_a bigint, class_b bigint, shift int, begin int, end int, more_before int, more_after int")

    def windows(self) -> DataFrame:
        """``(class_id, begin, h1, h2)``: all stretches of ``min_run`` code points around hot pieces.

        Between two equal pieces in a row lie the equal ones that a periodic stretch was spared, so all between them count.
        """
        min_run = self.min_run
        places = cut(self.hot.groupBy("class_id").agg(F.collect_list(F.struct("place", "size", "digest")).alias("places")))  # the places of one text

        def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            columns = ["class_id", "begin", "h1", "h2"]
            for batch in batches:
                rows = []
                for class_id, text, places in zip(batch["class_id"], batch["text"], batch["places"]):
                    done, before = -1, None
                    for place, size, piece in sorted((x["place"], x["size"], x["digest"]) for x in places):
                        first = done + 1 if piece == before else max(0, place + size - min_run, done + 1)
                        before = piece
                        for begin in range(first, min(place, len(text) - min_run) + 1):
                            digest = xxhash.xxh3_128_intdigest(text[begin : begin + min_run].encode("utf-8", "surrogatepass"))
                            rows.append((class_id, begin, (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)))
                            done = begin
                        if len(rows) > 50_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

        return self.texts.join(broadcast_if_small(places), "class_id").mapInPandas(emit, "class_id bigint, begin int, h1 bigint, h2 bigint")

    def pairs(self) -> DataFrame:
        """``(class_a, class_b)`` of all different texts that share a stretch, once."""
        chains = cut(self.chains())
        sure = chains.where(F.col("end") - F.col("begin") >= self.min_run).select("class_a", "class_b").distinct()
        open_ = chains.where(F.col("end") - F.col("begin") < self.min_run).join(sure, ["class_a", "class_b"], "left_anti")
        length = F.col("end") - F.col("begin")
        proven = self.grown(open_, F.lit(self.min_run) - length).where(F.col("more_before") + length + F.col("more_after") >= self.min_run)
        windows = cut(self.windows())
        # of windows that the same texts share, one is kept
        shared = (
            windows.select("h1", "h2", "class_id")
            .distinct()
            .groupBy("h1", "h2")
            .agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), F.expr("bit_xor(xxhash64(class_id))").alias("ids"), F.count("*").alias("n"))
            .where("lo < hi")
            .groupBy("lo", "hi", "ids", "n")
            .agg(F.min(F.struct("h1", "h2")).alias("h"))
            .select("h.h1", "h.h2")
        )
        around = _meet(windows.join(shared, ["h1", "h2"], "left_semi").select("class_id", F.col("begin").alias("place"), "h1", "h2"), ["h1", "h2"])
        return sure.unionByName(proven.select("class_a", "class_b")).unionByName(around.select("class_a", "class_b")).distinct()

    def intervals(self) -> DataFrame:
        """``(class_id, begin, end)``: stretches of at least ``min_run`` code points that another text holds, too.

        They may overlap and cover exactly what is shared. Texts around hot pieces make no pairs here: a window counts if
        any other text holds it, which is added up before it moves.
        """
        chains = cut(self.grown(self.chains(), F.lit(self.min_run - PIECE)))  # further stretches hold further pieces
        length = F.col("end") - F.col("begin") + F.col("more_before") + F.col("more_after")
        at_a = chains.where(length >= self.min_run).select("class_a", "class_b", "shift", (F.col("begin") - F.col("more_before")).alias("begin"), length.alias("run"))
        spans = at_a.select(F.col("class_a").alias("class_id"), "begin", (F.col("begin") + F.col("run")).alias("end"))
        spans = spans.unionByName(at_a.select(F.col("class_b").alias("class_id"), (F.col("begin") - F.col("shift")).alias("begin"), (F.col("begin") - F.col("shift") + F.col("run")).alias("end")))
        windows = cut(self.windows())
        shared = windows.groupBy("h1", "h2").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo < hi").select("h1", "h2")
        hot = windows.join(shared, ["h1", "h2"], "left_semi").select("class_id", "begin", (F.col("begin") + self.min_run).alias("end"))
        return spans.unionByName(hot).distinct()


def _meet(occurrences: DataFrame, on: list[str]) -> DataFrame:
    a = occurrences.select(F.col("class_id").alias("class_a"), F.col("place").alias("place_a"), *on)
    b = occurrences.select(F.col("class_id").alias("class_b"), F.col("place").alias("place_b"), *on)
    return a.join(b, on).where("class_a < class_b")


def shared_runs(documents: DataFrame, min_run: int = MIN_RUN) -> tuple[DataFrame, DataFrame]:
    """``(class_a, class_b)`` of different texts that share a stretch, and the documents of each class."""
    shared = Shared(documents, min_run)
    return shared.pairs(), shared.members


def shared_shares(documents: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """How much of every document that shares a stretch with another one is shared.

    Result: ``doc_id, class_id, n_chars, n_copies, longest_run, shared_chars, longest_share, shared_share``.
    ``shared_chars`` is the united length of all its shared stretches and ``longest_run`` the longest of the united ones;
    a text that several documents hold is shared as a whole.
    """
    shared = Shared(documents, min_run)
    order = Window.partitionBy("class_id").orderBy("begin", "end")  # the stretches of one text
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = shared.intervals().withColumn("new", F.when(F.col("begin") <= reached, 0).otherwise(1)).withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    united = marked.groupBy("class_id", "k").agg((F.max("end") - F.min("begin")).alias("run")).groupBy("class_id").agg(F.sum("run").alias("united"), F.max("run").alias("longest"))
    sizes = shared.members.groupBy("class_id").agg(F.count("*").alias("n_copies"))
    whole = F.col("n_copies") > 1
    return (
        shared.members.where(f"length >= {min_run}")
        .join(sizes, "class_id")
        .join(united, "class_id", "left")
        .where(whole | F.col("united").isNotNull())
        .select(
            "doc_id",
            "class_id",
            F.col("length").alias("n_chars"),
            "n_copies",
            F.when(whole, F.col("length")).otherwise(F.col("longest")).alias("longest_run"),
            F.when(whole, F.col("length")).otherwise(F.col("united")).cast("int").alias("shared_chars"),
        )
        .withColumn("longest_share", F.round(F.col("longest_run") / F.col("n_chars"), 6))
        .withColumn("shared_share", F.round(F.col("shared_chars") / F.col("n_chars"), 6))
    )


def p10_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with a shared stretch: its class, longest stretch, and how much of the text is shared in all."""
    return shared_shares(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of documents that share a stretch of 400 or more code points."""
    pairs, members = shared_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    a = members.select(F.col("class_id").alias("class_a"), F.col("doc_id").alias("x"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("doc_id").alias("y"))
    across = pairs.join(a, "class_a").join(b, "class_b")
    long = members.where(f"length >= {MIN_RUN}")
    same = long.select("class_id", F.col("doc_id").alias("x")).join(long.select("class_id", F.col("doc_id").alias("y")), "class_id").where("x < y")
    return (
        across.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
        .unionByName(same.select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b")))
        .distinct()
    )


QUERIES = {"p10_found": p10_found, "p10_shared_share": p10_shared_share}
