"""Problem 5: the best value of each field among duplicate records.

Method: Bayesian fusion with copy detection. Every record claims a value for each field. Claims that cannot be the best
value (placeholders, cut or dressed-up texts, impossible days and counts) get a low prior. Providers vote with the log odds
of their accuracy for the field; the accuracy is estimated from the posterior of their claims, and a provider that shares
more false values with another one than independent providers would is taken for a copier, whose vote is discounted. The
claim with the highest posterior survives.

A group's claims are first added up by value and provider, so no step holds the records of a group together. Null is a
value that never survives while another one is claimed; ties go to the smaller record id; groups whose records all hold one
value have no row; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import datetime as dt
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litloom.llm import truncation
from litloom.llm.venues import fold, map_values, strip_extras
from litloom.runtime import broadcast_if_small, cut, table

FIELDS = ("abstract", "venue", "citation_count", "publication_date")

#: Accuracy before the first round; share of claims that a copier copies.
START_ACCURACY, COPY_RATE = 0.8, 0.8

#: Change of every accuracy below which the rounds end, and rounds after which steps get shorter, so that they do end.
STABLE, FULL_STEPS = 0.01, 4

# Counts that stand for "unknown".
SENTINELS = frozenset((-1, 99999, 999999, 9999999, 2147483647, 4294967295))

_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_ISO = re.compile(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(T.*| .*)?")
_DAY_FIRST = re.compile(r"(\d{1,2})(?:st|nd|rd|th)?\.? ([A-Za-z]{3})[a-z]*\.?,? (\d{4})")
_MONTH_FIRST = re.compile(r"([A-Za-z]{3})[a-z]*\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})")
_LABEL = re.compile(r"^(abstract|summary|background|keywords)\b\s*(&#58;|[:.—–-])?\s+", re.IGNORECASE)


def parse_day(value: str | None) -> str | None:
    """ISO day of a date in any usual writing; None for other precisions and impossible days."""
    if not value:
        return None
    s = value.strip()
    if m := _ISO.fullmatch(s):
        y, mo, d = int(m[1]), int(m[2]), int(m[3])
    elif m := _DAY_FIRST.fullmatch(s):
        y, mo, d = int(m[3]), _MONTHS.get(m[2].lower(), 0), int(m[1])
    elif m := _MONTH_FIRST.fullmatch(s):
        y, mo, d = int(m[3]), _MONTHS.get(m[1].lower(), 0), int(m[2])
    else:
        return None
    try:
        return dt.date(y, mo, d).isoformat()
    except ValueError:
        return None


def date_claim(value: str | None, year: int | None, seen: dt.datetime | None) -> tuple[str | None, float]:
    """Key of a date and its prior (log odds): a possible day, less for 1 January, least for other precisions."""
    if value is None or not value.strip():
        return None, -40.0
    day = parse_day(value)
    if day is None:
        return value.strip(), -14.0 if re.search(r"\d{4}", value) and not re.search(r"[-/](1[3-9]|[2-9]\d)[-/]", value) else -18.0
    prior = 0.0
    if seen is not None and not pd.isna(seen) and day > (seen + dt.timedelta(days=400)).date().isoformat():
        prior -= 16.0
    if year is not None and not pd.isna(year) and abs(int(day[:4]) - int(year)) > 1:
        prior -= 3.0
    if day.endswith("-01-01"):
        prior -= 6.0
    return day, prior


def abstract_claim(value: str | None) -> tuple[str | None, float]:
    """Key of an abstract (its wording without label, tags and furniture) and its prior."""
    if value is None:
        return None, -40.0
    state = truncation.end_state(value)
    if state is None:
        return None, -30.0
    bare = truncation.tidy(value)
    prior = 0.0 if bare == value.strip() else -9.0
    unlabelled = _LABEL.sub("", bare)
    prior -= 9.0 * (unlabelled != bare)
    head, low = unlabelled, unlabelled.lower()
    for mark in truncation.FURNITURE:
        at = low.find(mark)
        while at >= 0:
            before = low[:at].rstrip()
            if at and before.endswith((".", "!", "?", ")", ">", "|")) and len(before) > 60:
                head, low = head[:at].rstrip(), low[:at].rstrip()
            elif at == 0:
                prior -= 12.0
            at = low.find(mark, at + 1) if at + 1 < len(low) else -1
    if head != unlabelled:
        prior -= 10.0
    if re.search(r"&[a-z#0-9]+;|</?[a-z]", head):
        prior -= 6.0
    if state in ("mark", "broken"):
        prior -= 12.0
    elif state == "open":
        prior -= 1.0
    return truncation.wording(head), prior


def venue_claims(values: DataFrame, entries: DataFrame) -> DataFrame:
    """``(venue, venue_key, venue_prior)`` of distinct ``values(venue)``: the listed entry or the folded name, and the prior of the writing.

    Official writing is best, then tidy writing. The list is searched in blocks (see venues), so it may be of any length.
    """

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for v in batch["venue"]:
                tidy = strip_extras(v) == v and "  " not in v and any(c.isupper() for c in v) and not v.isupper()
                rows.append((v, fold(v), fold(strip_extras(v)), tidy, len(v.split()) < 3 or v.count(".") > 1))
            yield pd.DataFrame(rows, columns=["venue", "folded", "bare", "tidy", "short"])

    def folded_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(folded=[fold(x) for x in batch["name"]])

    values = cut(values.where(F.trim("venue") != "").select("venue").distinct())
    names = cut(entries.select("venue_id", "name").where(F.trim("name") != "").mapInPandas(folded_names, "venue_id bigint, name string, folded string"))
    exact = names.groupBy("folded").agg(F.min("venue_id").alias("exact"))
    official = names.select(F.col("name").alias("venue"), F.col("venue_id").alias("entry"), F.lit(True).alias("official")).distinct()
    near = map_values(values.withColumn("k", F.lit(0).cast("bigint")), entries, "k", "venue").select("venue", "venue_id")
    placed = (
        values.mapInPandas(written, "venue string, folded string, bare string, tidy boolean, short boolean")
        .join(broadcast_if_small(exact), "folded", "left")
        .join(near, "venue", "left")
        .withColumn("entry", F.coalesce("exact", "venue_id", F.lit(0).cast("bigint")))
        .join(broadcast_if_small(official), ["venue", "entry"], "left")
    )
    listed = F.col("entry") != 0
    untidy = F.when(listed, -8.0).otherwise(-2.0) - F.when(F.col("tidy"), 0.0).otherwise(6.0) - F.when(F.col("short"), 8.0).otherwise(0.0)
    return placed.select(
        "venue",
        F.when(listed, F.concat(F.lit("#"), F.col("entry").cast("string"))).otherwise(F.col("bare")).alias("venue_key"),
        F.when(F.col("official"), 2.0).otherwise(untidy).alias("venue_prior"),
    )


_CLAIMS = "group_id bigint, record_id bigint, provider string, field_name string, value string, value_key string, prior double"


def claims(records: DataFrame, groups: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per record of a group and field: the stored value, its key and the prior of this writing."""
    columns = ["record_id", "provider", "abstract", "venue", "publication_date", "year", "retrieved_at"]
    joined = cut(groups.select("group_id", "record_id").distinct().join(records.select(*columns), "record_id"))

    def claim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for field, keyed in (
                ("abstract", [abstract_claim(v) for v in batch["abstract"]]),
                ("publication_date", [date_claim(*x) for x in zip(batch["publication_date"], batch["year"], batch["retrieved_at"])]),
            ):
                parts.append(
                    batch[["group_id", "record_id", "provider"]].assign(
                        field_name=field, value=batch[field], value_key=[k for k, _ in keyed], prior=[p for _, p in keyed]
                    )
                )
            yield pd.concat(parts)

    known = cut(venue_claims(joined.select("venue"), entries))
    venue = joined.join(broadcast_if_small(known), "venue", "left").select(
        "group_id", "record_id", "provider", F.lit("venue").alias("field_name"), F.col("venue").alias("value"), F.col("venue_key").alias("value_key"), F.coalesce("venue_prior", F.lit(-40.0)).alias("prior")
    )
    return joined.select("group_id", "record_id", "provider", "abstract", "publication_date", "year", "retrieved_at").mapInPandas(claim, _CLAIMS).unionByName(venue)


def _prefix_loss(claimed: DataFrame) -> DataFrame:
    """Abstract keys of a group that only begin another key of the group get a lower prior: their end is missing."""
    keys = claimed.where("field_name = 'abstract' and value_key is not null").select("group_id", "value_key").distinct()
    order = Window.partitionBy("group_id").orderBy("value_key")
    longer = keys.withColumn("next", F.lead("value_key").over(order)).where("startswith(next, value_key)")
    return longer.select("group_id", F.lit("abstract").alias("field_name"), "value_key", F.lit(-12.0).alias("loss"))


def _fuse(claimed: DataFrame) -> DataFrame:
    """``(group_id, field_name, value_key, score)`` with the posterior log odds of every claimed key."""
    votes = claimed.where("value_key is not null").groupBy("group_id", "field_name", "value_key", "provider").agg(F.max("prior").alias("prior"))
    votes = cut(votes.join(_prefix_loss(claimed), ["group_id", "field_name", "value_key"], "left").withColumn("prior", F.col("prior") + F.coalesce("loss", F.lit(0.0))).drop("loss"))
    accuracy = votes.select("provider", "field_name").distinct().withColumn("accuracy", F.lit(START_ACCURACY))
    weight = votes.select("group_id", "field_name", "value_key", "provider").withColumn("independent", F.lit(1.0))
    for step in itertools.count(1):
        odds = F.log(F.col("accuracy") * 10 / (1 - F.col("accuracy")))
        voted = votes.join(broadcast_if_small(accuracy), ["provider", "field_name"]).join(weight, ["group_id", "field_name", "value_key", "provider"])
        score = cut(voted.groupBy("group_id", "field_name", "value_key").agg((F.max("prior") + F.sum(odds * F.col("independent"))).alias("score")))
        if step > 1 and settled:
            return score
        top = F.max("score").over(Window.partitionBy("group_id", "field_name"))
        odds_of = score.withColumn("share", F.exp(F.greatest(F.col("score") - top, F.lit(-40.0))))
        total = F.sum("share").over(Window.partitionBy("group_id", "field_name"))
        posterior = cut(odds_of.withColumn("p", F.col("share") / total).select("group_id", "field_name", "value_key", "p"))
        judged = votes.join(posterior, ["group_id", "field_name", "value_key"])
        fresh = judged.groupBy("provider", "field_name").agg(F.least(F.lit(0.99), F.greatest(F.lit(0.2), (F.sum("p") + 4) / (F.count("*") + 5))).alias("fresh"))
        stride = 1.0 / max(1, step - FULL_STEPS)
        moved = cut(accuracy.join(fresh, ["provider", "field_name"]).select("provider", "field_name", (F.col("accuracy") + stride * (F.col("fresh") - F.col("accuracy"))).alias("accuracy"), (stride * F.abs(F.col("fresh") - F.col("accuracy"))).alias("change")))
        settled = (moved.agg(F.max("change")).first()[0] or 0.0) < STABLE
        accuracy = moved.drop("change")
        a = judged.select("group_id", "field_name", F.col("value_key").alias("va"), F.col("provider").alias("a"), F.col("p").alias("pa"))
        b = judged.select("group_id", "field_name", F.col("value_key").alias("vb"), F.col("provider").alias("b"))
        # providers, not records, meet here: at most their number squared for each group
        same = F.col("va") == F.col("vb")
        pairs = (
            a.join(b, ["group_id", "field_name"])
            .where("a <> b")
            .groupBy("field_name", "a", "b")
            .agg(F.sum(F.when(same, F.col("pa")).otherwise(0.0)).alias("both_true"), F.sum(F.when(same, 1 - F.col("pa")).otherwise(0.0)).alias("both_false"), F.sum(F.when(same, 0.0).otherwise(1.0)).alias("differ"))
            .join(broadcast_if_small(accuracy.withColumnRenamed("provider", "a")), ["a", "field_name"])
        )
        # log odds of copying: a shared false value is unlikely among independent providers, a difference among copiers
        e = 1 - F.col("accuracy")
        llr = F.col("both_false") * F.log((COPY_RATE + (1 - COPY_RATE) * e / 10) / (e / 10 + 0.01)) + F.col("both_true") * 0.02 + F.col("differ") * F.log(F.lit(1 - COPY_RATE + 0.05)) - 2.0
        dependence = cut(pairs.select("field_name", "a", "b", (1 / (1 + F.exp(F.greatest(F.least(-llr, F.lit(40.0)), F.lit(-40.0))))).alias("copies")))
        rank = judged.join(broadcast_if_small(accuracy), ["provider", "field_name"])
        x = rank.select("group_id", "field_name", "value_key", "provider", "accuracy")
        y = rank.select("group_id", "field_name", "value_key", F.col("provider").alias("b"), F.col("accuracy").alias("acc_b"))
        before = (F.col("acc_b") > F.col("accuracy")) | ((F.col("acc_b") == F.col("accuracy")) & (F.col("b") < F.col("provider")))
        weight = cut(
            x.join(y, ["group_id", "field_name", "value_key"])
            .join(broadcast_if_small(dependence.withColumnRenamed("a", "provider")), ["field_name", "provider", "b"], "left")
            .groupBy("group_id", "field_name", "value_key", "provider")
            .agg(F.exp(F.sum(F.when(before, F.log(1 - 0.95 * COPY_RATE * F.coalesce("copies", F.lit(0.0)))).otherwise(0.0))).alias("independent"))
        )


def heaviest_chain(counts: list[int], lasts: list, ns: list[int]) -> int:
    """The last count of the heaviest chain of counts that never fall in the order of their times.

    A count weighs 1 (0.4 if it is zero) and a tenth more for each of up to five repetitions. Of equally heavy chains the one
    that ends highest counts. The heaviest chain up to a count is looked up in a Fenwick tree, so the time is near linear.
    """
    order = sorted(range(len(counts)), key=lambda i: (lasts[i], counts[i]))
    place = {c: k for k, c in enumerate(sorted(set(counts)), 1)}
    tree = [0.0] * (len(place) + 1)
    ends: list[tuple[float, int]] = []
    for i in order:
        k, below = place[counts[i]], 0.0
        while k:
            below = max(below, tree[k])
            k &= k - 1
        weight = (1.0 if counts[i] > 0 else 0.4) * (1 + 0.1 * min(ns[i] - 1, 5)) + below
        ends.append((weight, counts[i]))
        k = place[counts[i]]
        while k < len(tree):
            tree[k] = max(tree[k], weight)
            k += k & -k
    top = max(ends)[0]
    return max(c for w, c in ends if w > top - 1e-9)


def latest_counts(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``(group_id, value)``: of each group the latest count on the heaviest chain of counts that never fall.

    Sentinels and negative counts are no counts. A group's claims are added up by count first.
    """
    rows = groups.select("group_id", "record_id").distinct().join(records.select("record_id", "citation_count", "retrieved_at"), "record_id")
    points = (
        rows.where(F.col("citation_count").isNotNull() & (F.col("citation_count") >= 0) & ~F.col("citation_count").isin(*sorted(SENTINELS)))
        .groupBy("group_id", "citation_count")
        .agg(F.max("retrieved_at").alias("last"), F.count("*").alias("n"))
    )

    def chains(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for group, part in rows.groupby("group_id", sort=False):
            out.append((group, heaviest_chain(part["citation_count"].tolist(), part["last"].tolist(), part["n"].tolist())))
        return pd.DataFrame(out, columns=["group_id", "value"])

    points = cut(points)
    buckets = max(64, points.count() // 50_000)  # many small groups make one call; their number grows with the input
    return points.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets))).groupBy("bucket").applyInPandas(chains, "group_id bigint, value bigint")


def survivors(records: DataFrame, groups: DataFrame, entries: DataFrame) -> DataFrame:
    """``(group_id, field_name, record_id, value)`` for each group and field whose stored values differ."""
    claimed = cut(claims(records, groups, entries))
    score = _fuse(claimed)
    placed = claimed.join(score, ["group_id", "field_name", "value_key"], "left")
    null_last = F.coalesce(F.col("score"), F.lit(-1000.0)) + F.when(F.col("value_key").isNull(), F.col("prior")).otherwise(0.0)
    placed = placed.withColumn("score", null_last)
    # the best key first, then its best writing, then the smallest record
    best = placed.groupBy("group_id", "field_name").agg(
        F.max_by("record_id", F.struct("score", F.coalesce("value_key", F.lit("")), F.round("prior", 3), -F.col("record_id"))).alias("record_id"),
        F.min(F.struct(F.col("value").isNull().alias("n"), "value")).alias("lo"),
        F.max(F.struct(F.col("value").isNull().alias("n"), "value")).alias("hi"),
    )
    texts = best.where(~F.col("lo").eqNullSafe(F.col("hi"))).select("group_id", "field_name", "record_id")
    members = groups.select("group_id", "record_id").distinct().join(records.select("record_id", "citation_count"), "record_id")
    spread = members.groupBy("group_id").agg(F.min("citation_count").alias("lo"), F.max("citation_count").alias("hi"), F.count("*").alias("n"), F.count("citation_count").alias("k"))
    differing = spread.where("k > 0 and (lo <> hi or k < n)").select("group_id")
    counted = members.join(differing, "group_id", "left_semi").join(latest_counts(records, groups), "group_id", "left")
    ranked = F.struct(F.coalesce(F.col("citation_count") == F.col("value"), F.lit(False)), F.col("citation_count").isNotNull(), -F.col("record_id"))
    counts = counted.groupBy("group_id").agg(F.max_by("record_id", ranked).alias("record_id")).select("group_id", F.lit("citation_count").alias("field_name"), "record_id")
    return texts.unionByName(counts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each reviewed group and field the record whose value survives."""
    return survivors(table(spark, sf_dir, "paper_records"), table(spark, sf_dir, "duplicate_groups"), table(spark, sf_dir, "venue_list"))


QUERIES = {"p5_found": p5_found}
