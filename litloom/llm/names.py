"""Problem 6: variant spellings of names typed by people.

Method: names become weighted vectors of character n-grams (within words, weighted by rarity); a distributed sparse join
finds the pairs above a cosine threshold, of groups and of surnames without given names. The join is exact: the n-grams of
a name are ordered by rarity and only so many of the rarest are joined that what is left out could not reach the threshold
alone. Persons with given names meet if their surnames are equal or misspellings of each other (deletion neighbourhoods)
and their first given names agree: a slip can destroy every n-gram of a short surname, and a cosine of n-grams that many
surnames share proposes ever more pairs that cannot agree. Pairs that contradict each other in given names, initials or the words of a group name are
dropped; average-linkage clustering of each connected component groups the rest.

Names are compared without case, accents and titles. Null and blank names are no names; a name that occurs repeatedly is
one name; an empty table gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.llm.cosine import cosine_pairs
from litloom.llm.venues import distance
from litloom.operators.graph import connected_components
from litloom.runtime import cut, table

#: Length of the n-grams, cosine from which names are compared, mean similarity from which clusters are joined.
GRAM, COSINE, LINKAGE = 5, 0.25, 0.5

#: N-grams of fewer names than this weigh alike, so that a misspelling does not outweigh the rest of a name; and the power
#: of rarity that counts, so that given names, which many share, meet nobody by themselves.
RARE_ENOUGH, POWER = 5, 2.0

#: Names from which a word may be a word of its own, and how much more frequent the right word must be then.
KNOWN_LEAST, MORE_FREQUENT = 4, 20

#: Edges that are clustered in one call, about.
BUCKET_EDGES = 20_000

# Short forms of given names.
SHORT_FORMS = {
    "alexander": "alex al sasha xander sandy", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "charles": "charlie chuck",
    "christopher": "chris kit topher", "christine": "chris tina", "daniel": "dan danny", "deborah": "deb debbie debby", "dorothy": "dot dolly",
    "edward": "ed eddie ned ted teddy", "elizabeth": "liz lizzie beth betty eliza libby lisa bess", "eleanor": "ellie nell nora", "frederick": "fred freddie freddy rick",
    "gabriela": "gabi gaby gabby gabe ela", "gregory": "greg gregg", "harriet": "hattie harry harrie hatty", "henry": "harry hank hal", "ignatius": "iggy nate nacho", "isabella": "bella izzy isa belle",
    "james": "jim jimmy jamie", "jennifer": "jen jenny jenna", "john": "jack johnny", "jonathan": "jon jonny nathan", "joseph": "joe joey jo", "katherine": "kate kathy kat katie kit kitty cathy kay",
    "leonard": "leo len lenny", "margaret": "maggie meg mags peg peggy greta marge margie", "matthew": "matt matty", "michael": "mike mick mickey", "nathaniel": "nate nat nathan",
    "nicholas": "nick nicky nico", "olivia": "liv livvy ollie", "patricia": "pat patty tricia trish", "philippa": "pippa pip", "rebecca": "becky becca beck bec",
    "richard": "rick dick rich", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "stephanie": "steph stephie stevie steffi steffie", "stephen": "steve", "susanna": "sue susie suzy sanna susan",
    "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "ulrike": "ulli uli ulla rike", "valentina": "val tina", "victoria": "vicky vic tori vicki",
    "vincent": "vince vin vinnie", "william": "bill will billy willy liam", "yvonne": "eve yve yvie von vonnie", "zachary": "zach zack zac",
}
_FORMS = {(short, full) for full, shorts in SHORT_FORMS.items() for short in shorts.split()}

# Words of group names, titles and other additions to a name.
_GROUP = re.compile(r"\b(coll(a(b(o(ration)?)?)?)?\.|cons(o(rtium)?)?\.|init(i(ative)?)?\.|netw(o(rk)?)?\.|grou?\.|collaboration|consortium|group|initiative|network|team|project|committee|society|investigators|working party)(?!\w)")
_TITLES = re.compile(r"\b(dr|prof|professor|mr|mrs|ms|md|phd|msc|bsc|jr|sr|mph)\b\.?")
_GROUP_FILL = re.compile(r"^(on behalf of|for|by)\s+|\b(the|of|for|and|on behalf)\b")


def fold(name: str) -> str:
    s = unicodedata.normalize("NFKD", name.replace("ø", "o").replace("ß", "ss").replace("ł", "l")).lower()
    return "".join(c for c in s if not unicodedata.combining(c))


class Name:
    """What a typed name says: the words of a group, or surname and given names in one or two readings."""

    __slots__ = ("group", "readings")

    def __init__(self, text: str):
        folded = fold(text)
        self.group: list[str] | None = None
        self.readings: list[tuple[str, list[str]]] = []
        if _GROUP.search(folded):
            bare = re.sub(r"\([^)]*\)", " ", folded)
            self.group = sorted(re.findall(r"[^\W\d_]+", _GROUP_FILL.sub(" ", bare)))
            return
        capitals = bool(re.search(r"[a-z]", text))  # else every word is in capitals and a short word no initials
        bare = _TITLES.sub(" ", re.sub(r"\([^)]*\)", " ", folded))
        cased = re.sub(r"\([^)]*\)", " ", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)))
        initials = {w.lower() for w in re.findall(r"\b[A-Z]{2,3}\b", cased)} if capitals else set()

        def given(part: str) -> list[str]:
            words = []
            for w in re.findall(r"[^\W\d_]+", part):
                words.extend(w if w in initials and len(w) <= 3 else [w])
            return words

        head, comma, tail = bare.partition(",")
        if comma and re.search(r"\w", head) and re.search(r"\w", tail):
            self.readings = [("".join(re.findall(r"[^\W\d_]+", head)), given(tail))]
            return
        words = [w for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", bare)]
        if not words:
            return
        words = ["".join(re.findall(r"[^\W\d_]+", w)) for w in words]
        if len(words) == 1:
            self.readings = [(words[0], [])]
            return
        long = [w for w in words if len(w) > 1 and w not in initials]
        if len(long) == 1:
            self.readings = [(long[0], [c for w in words if w != long[0] for c in w])]
            return
        forward = (words[-1], [c for w in words[:-1] for c in given(w)])
        backward = (words[0], [c for w in words[1:] for c in given(w)])
        if len(words[-1]) == 1 or words[-1] in initials:
            self.readings = [backward]
        elif len(words) > 2 and any(len(w) == 1 for w in words[1:-1]):
            self.readings = [forward]
        else:
            self.readings = [forward, backward]


def own_words(n: int, m: int) -> bool:
    """True for the frequencies of two different words: neither is so much rarer that it can be a misspelling of the other.

    Only their ratio counts, so the verdict is the same at every number of names.
    """
    return min(n, m) >= KNOWN_LEAST and max(n, m) < MORE_FREQUENT * min(n, m)


def close(a: str, b: str, known: Mapping[str, int]) -> bool:
    """True for one word and a misspelling of it; ``known`` has the frequencies of words."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 4 or own_words(known.get(a, 0), known.get(b, 0)):
        return False
    most = 1 if min(len(a), len(b)) < 7 else 2
    return len(set(a) ^ set(b)) <= 2 * most and distance(a, b) <= most  # an edit changes at most two of the letters that occur


def _first(a: str, b: str, known: Mapping[str, int]) -> float:
    """How well two first names agree: 0 for a contradiction."""
    if a == b:
        return 1.0 if len(a) > 1 else 0.8
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return 0.7 if long.startswith(short) else 0.0
    if (short, long) in _FORMS or (long, short) in _FORMS:
        return 0.95
    for full, shorts in SHORT_FORMS.items():
        names = shorts.split()
        if short in names and long in names:
            return 0.8
        if (short in names and close(long, full, known)) or (long in names and close(short, full, known)):
            return 0.8
    if 2 <= len(short) <= 4 and long.startswith(short) and (len(short) < 4 or known.get(short, 0) < KNOWN_LEAST):
        return 0.9
    if close(a, b, known):
        return 0.9
    return 0.0


def agreement(a: Name, b: Name, known: Mapping[str, int]) -> float:
    """Similarity of two names in [0, 1]; 0 if they contradict each other."""
    if (a.group is None) != (b.group is None):
        return 0.0
    if a.group is not None:
        return _group_agreement(a.group, b.group, known)
    best = 0.0
    for surname_a, given_a in a.readings:
        for surname_b, given_b in b.readings:
            if not close(surname_a, surname_b, known):
                continue
            score = 1.0 if surname_a == surname_b else 0.9
            if given_a and given_b:
                score *= _first(given_a[0], given_b[0], known)
                for x, y in zip(given_a[1:], given_b[1:]):
                    if x[0] != y[0]:
                        score = 0.0
            else:
                score *= 0.4
            best = max(best, score)
    return best


def _group_agreement(a: list[str], b: list[str], known: Mapping[str, int]) -> float:
    """Groups agree if their words do, one by one; a word may be abbreviated or missing at one end."""
    left, missing = list(b), 0
    for x in a:
        hit = next((y for y in left if x == y), None) or next((y for y in left if close(x, y, known)), None)
        hit = hit or next((y for y in left if min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x))), None)
        if hit is None:
            missing += 1
        else:
            left.remove(hit)
    missing += len(left)
    if missing == 0:
        return 1.0
    return 0.6 if missing == 1 and min(len(a), len(b)) >= 2 and abs(len(a) - len(b)) == 1 else 0.0


def _grams(names: DataFrame) -> DataFrame:
    """``(id, feature, tf)`` of the folded words of each name."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, name in zip(batch["id"], batch["name"]):
                counts: dict[str, int] = {}
                for w in re.findall(r"[^\W\d_]+", _TITLES.sub(" ", fold(name))):
                    padded = f"^{w}$"
                    for k in range(max(1, len(padded) - GRAM + 1)):
                        g = padded[k : k + GRAM]
                        counts[g] = counts.get(g, 0) + 1
                rows.extend((i, g, n) for g, n in counts.items())
            if rows:
                yield pd.DataFrame(rows, columns=["id", "feature", "tf"])

    return names.mapInPandas(cut_up, "id bigint, feature string, tf int")


def name_words(text: str) -> set[str]:
    """The words by which a name is compared."""
    name = Name(text)
    return set(name.group or ()) | {w for surname, given in name.readings for w in (surname, *given) if len(w) > 1}


def word_counts(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(word, n)``, the number of names that hold each word, and ``(id, words)``, the words of each name with that number."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(i, w) for i, name in zip(batch["id"], batch["name"]) for w in name_words(name)], columns=["id", "word"])

    held = cut(names.mapInPandas(cut_up, "id bigint, word string"))
    counts = cut(held.groupBy("word").agg(F.count("*").alias("n")))
    return counts, held.join(counts, "word").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("words"))


def deletions(word: str) -> set[str]:
    """Keys that a word shares with each of its misspellings (see close): itself with one or two letters left out."""
    found = {word}
    if len(word) >= 4:
        found.update(word[:i] + word[i + 1 :] for i in range(len(word)))
    if len(word) >= 7:
        found.update(w[:i] + w[i + 1 :] for w in tuple(found) for i in range(len(w)))
    return found


def misspellings(words: DataFrame) -> DataFrame:
    """``(word, variant)``: every one of the distinct ``words(word, n)`` with itself and the words that are close to it."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(w, n, k) for w, n in zip(batch["word"], batch["n"]) for k in deletions(w)], columns=["word", "n", "key"])

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[close(x, y, {x: n, y: m}) for x, n, y, m in zip(batch["word"], batch["n"], batch["variant"], batch["m"])]][["word", "variant"]]

    keys = cut(words.where("length(word) >= 4").mapInPandas(keyed, "word string, n bigint, key string"))
    pairs = keys.join(keys.select(F.col("word").alias("variant"), F.col("n").alias("m"), "key"), "key").where("word < variant").select("word", "n", "variant", "m").distinct()
    near = cut(pairs.mapInPandas(checked, "word string, variant string"))
    return words.select("word", F.col("word").alias("variant")).unionByName(near).unionByName(near.select(F.col("variant").alias("word"), F.col("word").alias("variant")))


def short_forms(given: str) -> set[str]:
    """The other names that a given name may stand for or be short for."""
    found = set(SHORT_FORMS.get(given, "").split())
    for full, shorts in SHORT_FORMS.items():
        if given in shorts.split():
            found.update((full, *shorts.split()))
    return found - {given}


def misspelt_forms(given: str) -> set[str]:
    """The short forms of every name of which a given name may be a misspelling, however frequent it is."""
    return {short for full, shorts in SHORT_FORMS.items() if close(given, full, {}) for short in shorts.split()} - {given}


def alike_names(names: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``(a, b)`` with ``a < b``: names ``(id, name)`` with close surnames whose first given names may agree.

    ``counts(word, n)`` tells how frequent words are; without it none is taken for a word of its own.

    One name asks for what the given name of another offers: the name itself, its initial, or its beginning.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, s, g[0]) for i, name in zip(batch["id"], batch["name"]) for s, g in Name(name).readings if g]
            yield pd.DataFrame(rows, columns=["id", "surname", "given"])

    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, s, g in zip(batch["id"], batch["surname"], batch["given"]):
                rows.extend((i, s, t) for t in {g, f"{g[0]}.", *(f"{g[:k]}-" for k in (2, 3, 4) if len(g) > k)})
            yield pd.DataFrame(rows, columns=["b", "surname", "token"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms: dict[str, set[str]] = {}
        for batch in batches:
            rows = []
            for i, s, g, variant in zip(batch["id"], batch["surname"], batch["given"], batch["variant"]):
                if variant not in forms:
                    if len(forms) > 50_000:
                        forms.clear()
                    forms[variant] = short_forms(variant) | misspelt_forms(variant)
                tokens = {f"{g}."} if len(g) == 1 else {variant, *(forms[variant] if variant == g else short_forms(variant))}
                if 2 <= len(g) <= 4:
                    tokens.add(f"{g}-")
                rows.extend((i, s, t) for t in tokens)
            yield pd.DataFrame(rows, columns=["a", "surname", "token"])

    readings = cut(names.mapInPandas(read, "id bigint, surname string, given string"))
    spark = names.sparkSession
    fixed = spark.createDataFrame([(w,) for full, shorts in SHORT_FORMS.items() for w in (full, *shorts.split())], "word string")
    words = readings.select(F.explode(F.array("surname", "given")).alias("word")).unionByName(fixed).distinct()
    words = words.withColumn("n", F.lit(0).cast("bigint")) if counts is None else words.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    variants = cut(misspellings(words))
    asked = readings.join(variants.withColumnRenamed("word", "given"), "given").mapInPandas(ask, "a bigint, surname string, token string").distinct()
    # numbers for the surname and token that meet take less room; names that meet by a number alone don't agree
    asked = asked.join(variants.withColumnRenamed("word", "surname"), "surname").select("a", F.xxhash64("variant", "token").alias("key"))
    offered = readings.mapInPandas(offer, "b bigint, surname string, token string").select("b", F.xxhash64("surname", "token").alias("key")).distinct()
    met = asked.join(offered, "key").where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_names(names: DataFrame, counts: DataFrame | None = None, threshold: float = COSINE) -> DataFrame:
    """``(a, b, cosine)`` for the pairs of names ``(id, name)`` with ``a < b`` and a cosine of at least ``threshold`` that may agree and that :func:`alike_names` doesn't propose.

    Those are two groups, and a surname without given names with any person. Of two groups that agree, the one of fewer words
    finds each of them in the other: equal, misspelt or abbreviated. So the rarest word of one must meet a word of the other.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["name"]):
                name = Name(text)
                if name.group is not None:
                    rows.extend((i, True, True, w) for w in set(name.group) or {""})
                else:
                    rows.extend((i, False, not given, surname) for surname, given in name.readings)
            yield pd.DataFrame(rows, columns=["id", "of_group", "asks", "word"])

    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, of_group, w in zip(batch["id"], batch["of_group"], batch["word"]):
                rows.append((i, of_group, f"{w}."))
                rows.extend((i, of_group, f"{w[:k]}-") for k in range(3, len(w)) if of_group)
            yield pd.DataFrame(rows, columns=["y", "of_group", "token"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, of_group, w, variant in zip(batch["id"], batch["of_group"], batch["word"], batch["variant"]):
                rows.append((i, of_group, f"{variant}."))
                if of_group and variant == w:
                    rows.append((i, of_group, f"{w}-"))
                    rows.extend((i, of_group, f"{w[:k]}.") for k in range(3, len(w)))
            yield pd.DataFrame(rows, columns=["x", "of_group", "token"])

    held = cut(names.mapInPandas(read, "id bigint, of_group boolean, asks boolean, word string"))
    words = held.select("word").distinct()
    words = cut(words.withColumn("n", F.lit(0).cast("bigint")) if counts is None else words.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")))
    asking = held.where("asks").join(words, "word")
    rarest = asking.where("of_group").groupBy("id", "of_group").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    asking = rarest.unionByName(asking.where("not of_group").select("id", "of_group", "word"))
    variants = misspellings(words).withColumnRenamed("word", "meant")
    asked = cut(asking.join(variants, F.col("word") == F.col("meant")).mapInPandas(ask, "x bigint, of_group boolean, token string"))
    offered = held.mapInPandas(offer, "y bigint, of_group boolean, token string")
    met = asked.join(offered, ["of_group", "token"]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return cosine_pairs(_grams(names), names.count(), threshold, RARE_ENOUGH, POWER, cut(met))


def average_linkage(n: int, pairs: list[tuple[int, int, float]], least: float = LINKAGE) -> np.ndarray:
    """Cluster (its smallest point) of each of ``n`` points: the two clusters of highest mean similarity are joined while it is ``least``.

    Pairs that are not given have similarity 0. The smaller row of sums is always added to the larger one, and a heap holds
    the means; outdated entries are passed over, so the time is near the number of pairs.
    """
    sums: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, s in pairs:
        sums[a][b] = sums[b][a] = s
    size, least_point, stamp, parent = [1] * n, list(range(n)), [0] * n, list(range(n))

    def entry(a: int, b: int) -> tuple:
        low, high = sorted((least_point[a], least_point[b]))
        return (-sums[a][b] / (size[a] * size[b]), -(size[a] + size[b]), low, high, a, b, stamp[a], stamp[b])

    heap = [entry(a, b) for a in range(n) for b in sums[a] if a < b and sums[a][b] >= least]
    heapq.heapify(heap)
    while heap:
        _, _, _, _, a, b, at_a, at_b = heapq.heappop(heap)
        if stamp[a] != at_a or stamp[b] != at_b:
            continue
        if len(sums[a]) < len(sums[b]):
            a, b = b, a
        del sums[a][b]
        del sums[b][a]
        for c, s in sums[b].items():
            del sums[c][b]
            sums[a][c] = sums[c][a] = sums[a].get(c, 0.0) + s
        sums[b] = {}
        size[a] += size[b]
        least_point[a] = min(least_point[a], least_point[b])
        parent[b] = a
        stamp[a] += 1
        stamp[b] = -1
        for c, s in sums[a].items():
            if s >= least * size[a] * size[c]:
                heapq.heappush(heap, entry(a, c))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    return np.array([least_point[root(k)] for k in range(n)], np.int64)


def name_clusters(names: DataFrame) -> DataFrame:
    """``(name, cluster, n_links)`` for the distinct non-blank names of column ``name``.

    ``n_links`` is the number of other names that agree with a name by themselves.
    """
    distinct = cut(names.select("name").where(F.trim("name") != "").distinct().select(F.xxhash64("name").alias("id"), "name"))
    counts, words = word_counts(distinct)
    typed_names = cut(distinct.join(words, "id", "left").select("id", "name", "words"))
    similar = similar_names(distinct, counts).select("a", "b").unionByName(alike_names(distinct, counts)).distinct()
    left = typed_names.select(F.col("id").alias("a"), F.col("name").alias("name_a"), F.col("words").alias("words_a"))
    right = typed_names.select(F.col("id").alias("b"), F.col("name").alias("name_b"), F.col("words").alias("words_b"))
    typed = similar.join(left, "a").join(right, "b").select("a", "b", "name_a", "name_b", F.map_entries("words_a").alias("words_a"), F.map_entries("words_b").alias("words_b"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, tuple[Name, dict[str, int]]] = {}

        def known(name: str, words) -> tuple[Name, dict[str, int]]:
            if name not in memory:
                memory[name] = (Name(name), {w["key"]: w["value"] for w in words} if words is not None else {})
            return memory[name]

        for batch in batches:
            if len(memory) > 50_000:
                memory.clear()
            scores = []
            for x, y, wx, wy in zip(batch["name_a"], batch["name_b"], batch["words_a"], batch["words_b"]):
                (a, in_a), (b, in_b) = known(x, wx), known(y, wy)
                scores.append(agreement(a, b, in_a | in_b))
            yield batch[["a", "b"]].assign(agreement=scores)

    judged = cut(typed.mapInPandas(judge, "a bigint, b bigint, agreement double").where("agreement > 0"))
    parts = connected_components(judged.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    edges = judged.join(parts.select(F.col("node").alias("a"), "component"), "a")

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby("component", sort=False):
            ids, at = np.unique(np.concatenate((part["a"].to_numpy(), part["b"].to_numpy())), return_inverse=True)
            a, b = at[: len(part)].tolist(), at[len(part) :].tolist()
            label = average_linkage(len(ids), list(zip(a, b, part["agreement"].tolist())))
            out.append(pd.DataFrame({"id": ids, "cluster": ids[label]}))
        return pd.concat(out)

    # many small components make one call; their number grows with the input
    buckets = max(64, judged.count() // BUCKET_EDGES)
    bucket = F.pmod(F.xxhash64("component"), F.lit(buckets)).alias("bucket")
    clusters = edges.select("a", "b", "agreement", "component", bucket).groupBy("bucket").applyInPandas(cluster, "id bigint, cluster bigint")
    links = judged.where(F.col("agreement") >= LINKAGE).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    return distinct.join(clusters, "id", "left").join(links, "id", "left").select("name", F.coalesce("cluster", "id").alias("cluster"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paper_records").select(F.explode("authors").alias("name"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings of one person or group author."""
    clusters = cut(name_clusters(author_names(spark, sf_dir)))
    a = clusters.select(F.col("name").alias("name_a"), "cluster")
    b = clusters.select(F.col("name").alias("name_b"), "cluster")
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its cluster and the number of spellings that agree with it by themselves."""
    return name_clusters(author_names(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_clusters": p6_clusters}
