"""Problem 7: mapping free-entered venues to a reference list.

Method: the entries and their alias paths (given and derived abbreviations, initials, names without function words) are
kept in one trie, which is searched with a Levenshtein automaton: a walk down the trie carries the row of edit
distances (with swaps of neighbours) and leaves a branch once the row exceeds the length-dependent limit. All entries
within the limit come out; the closest one that no rule excludes is the match.

The list is fixed and small, so it travels to the tasks in blocks of bounded size and the venues are never shuffled.
Null and blank venues are no cases; a value that matches nothing, or two entries equally well, gets 0; repeated rows are
judged alike; an empty list maps everything to 0; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.runtime import table

#: Entries of the list that one task holds at once; a longer list is searched block by block.
BLOCK = 20_000

#: Remembered values per task.
MEMORY = 100_000

# Function words that abbreviations leave out.
FUNCTION_WORDS = frozenset(("a", "an", "and", "at", "der", "des", "die", "et", "for", "für", "in", "la", "le", "of", "on", "the", "und"))

# What people put before or after a venue.
_BEFORE = re.compile(r"^(in|publ|published in|publ in|appeared in|appears in|to appear in|from|see)\s*[.:]?\s+(?=\S)|^(in|the)\s*:?\s+", re.IGNORECASE)
_AFTER = re.compile(
    r"([\s,;:]*([\[(](vol(ume)?\.?\s*)?[\d\s().:–-]+[\])]|vol(ume)?\.?\s*\d+[\d()\s.:–-]*|no\.?\s*\d+|\d+\s*\(\d+\)|,?\s*\d+|[\[(]?(online|print|online first|electronic)[\])]?))+$",
    re.IGNORECASE,
)


def fold(value: str) -> str:
    """Lower case without accents; ``&`` is ``and``; only letters, digits and single spaces remain."""
    s = unicodedata.normalize("NFKD", value.replace("&", " and ")).lower()
    s = "".join(c for c in s if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w]+|_", " ", s).split())


def strip_extras(value: str) -> str:
    """The value without quotes, leading ``In:`` and the like, and trailing volume, issue or medium."""
    s = value.strip().strip("\"'“”‘’«»").strip()
    for _ in range(3):
        t = _BEFORE.sub("", s).strip()
        t = _AFTER.sub("", t).strip().rstrip(".,;:").strip().strip("\"'“”‘’«»").strip()
        if t == s or not t:
            break
        s = t
    return s


def unrotate(value: str) -> str | None:
    """``Symposium on X, Proceedings of the`` with its head moved back to the front."""
    head, comma, tail = value.rpartition(",")
    return f"{tail.strip()} {head.strip()}" if comma and head.strip() and tail.strip() else None


def content(words: list[str]) -> list[str]:
    return [w for w in words if w not in FUNCTION_WORDS]


class Shortener:
    """How the list shortens words, learnt from its own pairs of name and abbreviation."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        known: dict[str, Counter] = defaultdict(Counter)
        lengths: dict[int, Counter] = defaultdict(Counter)
        for name, short in pairs:
            if not short:
                continue
            words, parts = content(fold(name).split()), fold(short).split()
            if len(words) == len(parts):
                for word, part in zip(words, parts):
                    if word.startswith(part):
                        known[word][part] += 1
                        lengths[len(word)][len(part)] += 1
        self.known = {word: parts.most_common(1)[0][0] for word, parts in known.items()}
        self.lengths = {n: c.most_common(1)[0][0] for n, c in lengths.items()}

    def short(self, word: str) -> str:
        return self.known.get(word) or word[: self.lengths.get(len(word), min(4, len(word)))]


class Trie:
    """Alias paths of the entries, searched with a Levenshtein automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, entry: tuple) -> None:
        node = self.root
        for c in path:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(entry)

    def search(self, query: str, limit: int) -> dict[tuple, int]:
        """Every entry within ``limit`` edits (insert, delete, replace, swap) of ``query``, with its distance."""
        found: dict[tuple, int] = {}
        n = len(query)
        stack = [(child, c, "", list(range(n + 1)), None) for c, child in self.root.items() if c]
        while stack:
            node, c, before, above, above2 = stack.pop()
            row = [above[0] + 1]
            append = row.append
            best = row[0]
            for j in range(1, n + 1):
                q = query[j - 1]
                cost = above[j - 1] if q == c else 1 + min(above[j - 1], above[j], row[j - 1])
                if above2 is not None and j > 1 and q == before and query[j - 2] == c and above2[j - 2] + 1 < cost:
                    cost = above2[j - 2] + 1
                append(cost)
                if cost < best:
                    best = cost
            if best > limit:
                continue
            for child_char, child in node.items():
                if child_char:
                    stack.append((child, child_char, c, row, above))
                elif row[n] <= limit:
                    for entry in child:
                        if row[n] < found.get(entry, limit + 1):
                            found[entry] = row[n]
        return found


def limit_of(length: int) -> int:
    """Edits allowed for a value of the given length."""
    return 0 if length < 8 else 1 if length < 16 else 2 if length < 32 else 3


class VenueIndex:
    """The reference list, ready for searching."""

    def __init__(self, entries: list[tuple[int, str, str | None]], shortener: Shortener | None = None, vocabulary: set[str] | None = None):
        """An index of ``entries``; of one block of a list if what all its words say (``list_words``) is given, too."""
        entries = [(i, name, short) for i, name, short in entries if name and name.strip()]
        shortener = shortener or Shortener([(name, short) for _, name, short in entries])
        self.trie, self.vocabulary = Trie(), vocabulary if vocabulary is not None else {w for _, name, _ in entries for w in content(fold(name).split())}
        self.words: dict[int, list[str]] = {}
        self.paths: dict[str, set] = defaultdict(set)
        self.initials: dict[str, set] = defaultdict(set)
        self.names: dict[int, str] = {}
        for i, name, short in entries:
            folded = fold(name)
            words = content(folded.split())
            self.words[i], self.names[i] = words, folded
            for kind, path in (
                ("name", " ".join(words)),
                ("short", " ".join(content(fold(short).split())) if short else ""),
                ("short", " ".join(shortener.short(w) for w in words)),
                ("short", " ".join(shortener.short(w) for w in content(fold(name.replace("-", "")).split()))),
                ("full", folded),
            ):
                if path and (i, kind) not in self.paths[path]:
                    self.paths[path].add((i, kind))
                    self.trie.add(path, (i, kind, path))
            self.initials["".join(w[0] for w in words)].add(i)
            self.initials["".join(w[0] for w in folded.split())].add(i)

    def _sound(self, query: str, path: str) -> bool:
        """The edits look like typing slips: no known word for another, and short tokens and numbers are equal."""
        a, b = query.split(), path.split()
        if len(a) != len(b):
            return query.replace(" ", "") == path.replace(" ", "") or distance(query.replace(" ", ""), path.replace(" ", "")) <= 1
        for x, y in zip(a, b):
            if x != y:
                if y in FUNCTION_WORDS and len(y) > 1:
                    if x in self.vocabulary or distance(x, y) > 2:
                        return False
                elif len(y) <= 2 or y.isdigit() or x.isdigit() or x in self.vocabulary or x in FUNCTION_WORDS:
                    return False
                elif distance(x, y) > (1 if len(y) <= 4 else 2 if len(y) <= 8 else 3):
                    return False
        return True

    def candidates(self, value: str, closest: bool = False) -> list[tuple[int, int, int, bool]]:
        """``(way, distance, entry, named)`` of all entries within the limit, over the readings of the value.

        Entries come by edits (way 0), initials (1) or as the value's continuation (2); ``named`` tells a path by name from one
        by abbreviation. With ``closest`` entries beyond an exact one may be left out.
        """
        bare = strip_extras(value)
        readings = [bare] + ([r] if (r := unrotate(bare)) else [])
        best: dict[int, tuple[int, bool]] = {}
        for reading in readings:
            folded = fold(reading)
            query = " ".join(content(folded.split()))
            if not query:
                continue
            hits = {(i, kind, query): 0 for i, kind in self.paths.get(query, ())}
            for asked in () if hits and closest else dict.fromkeys((query, folded)):
                for e, d in self.trie.search(asked, limit_of(len(asked))).items():
                    if self._sound(asked, e[2]):
                        hits[e] = min(d, hits.get(e, d))
            for (i, kind, _), d in hits.items():
                known = best.get(i)
                named = kind in ("full", "name")
                if known is None or d < known[0] or (d == known[0] and named and not known[1]):
                    best[i] = (d, named)
        found = [(0, d, i, named) for i, (d, named) in best.items()]
        if re.fullmatch(r"[A-Z]{3,}|([A-Z]\.\s?){3,}", bare):
            found += [(1, 0, i, False) for i in self.initials.get(re.sub(r"[^a-z]", "", bare.lower()), ())]
        if len(folded := fold(bare)) >= 16:
            found += [(2, 0, i, False) for i, name in self.names.items() if name.startswith(folded)]
        return sorted(found)

    def summary(self, value: str) -> tuple[int, int, int, int, int, int] | None:
        """``(way, distance, entries, one of them, named entries, one of them)`` of the closest candidates, None without any."""
        found = self.candidates(value, closest=True)
        if not found:
            return None
        way, least = found[0][:2]
        near = {i: named for w, d, i, named in found if (w, d) == (way, least)}
        named = [i for i, x in near.items() if x]
        return way, least, len(near), min(near), len(named), min(named, default=0)

    def match(self, value: str) -> tuple[int, int]:
        """The closest entry and its distance; ``(0, -1)`` without any or with two equally close ones."""
        return decided(self.summary(value))


def decided(closest: tuple[int, int, int, int, int, int] | None) -> tuple[int, int]:
    """The entry that a summary means: its only one, or its only one by name; ``(0, -1)`` if there is none."""
    if closest is None:
        return 0, -1
    _, least, n, one, n_named, named = closest
    return (one, least) if n == 1 else (named, least) if n_named == 1 else (0, -1)


@lru_cache(maxsize=200_000)
def distance(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours; words recur, so distances are kept."""
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = one[j - 1] if x == y else 1 + min(one[j - 1], one[j], row[j - 1])
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, two[j - 2] + 1)
            row.append(cost)
        two, one = one, row
    return one[-1]


def _blocks(entries: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int, str, str | None]]]:
    block: list[tuple[int, str, str | None]] = []
    for row in entries.select("venue_id", "name", "abbreviation").orderBy("venue_id").toLocalIterator():
        block.append((row[0], row[1], row[2]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def list_words(entries: DataFrame) -> tuple[Shortener, set[str]]:
    """How the whole list shortens words, and its vocabulary."""
    pairs, vocabulary = [], set()
    for _, name, short in (row for block in _blocks(entries) for row in block):
        if name and name.strip():
            vocabulary.update(content(fold(name).split()))
            if short:
                pairs.append((name, short))
    return Shortener(pairs), vocabulary


_SUMMARY = ("way", "edits", "n", "one", "n_named", "named")


def map_values(rows: DataFrame, entries: DataFrame, key: str, value: str, block_size: int = BLOCK) -> DataFrame:
    """``(key, venue, venue_id, edits)`` for each row of ``rows`` whose value is not null or blank.

    ``venue_id`` is 0 and ``edits`` -1 where no entry matches. The rows stay where they are; each task remembers values. A
    list of several blocks gives the same result as one of a single block: each block says how close its closest entries
    are and how many they are, and only the sum of that decides.
    """
    rows = rows.select(F.col(key).alias("row_key"), F.col(value).alias("venue")).where(F.trim("venue") != "")
    shortener, vocabulary = list_words(entries)
    parts = []
    for block in _blocks(entries, block_size):

        def search(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            index, memory = VenueIndex(block, shortener, vocabulary), {}
            for batch in batches:
                if len(memory) >= MEMORY:
                    memory.clear()
                for v in batch["venue"].unique():
                    if v not in memory:
                        memory[v] = index.summary(v) or (9, -1, 0, 0, 0, 0)
                yield pd.concat([batch, pd.DataFrame([memory[v] for v in batch["venue"]], columns=_SUMMARY, index=batch.index)], axis=1)

        parts.append(rows.mapInPandas(search, "row_key bigint, venue string, way int, edits int, n int, one bigint, n_named int, named bigint"))
    if not parts:
        return rows.select("row_key", "venue", F.lit(0).cast("bigint").alias("venue_id"), F.lit(-1).alias("edits"))
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        # of equally close blocks the numbers are added up, by one aggregation for each way and distance
        level = found.distinct().groupBy("row_key", "venue", "way", "edits").agg(F.sum("n").alias("n"), F.max("one").alias("one"), F.sum("n_named").alias("n_named"), F.max("named").alias("named"))
        found = level.groupBy("row_key", "venue").agg(F.min(F.struct("way", "edits", "n", "one", "n_named", "named")).alias("m")).select("row_key", "venue", "m.*")
    entry = F.when(F.col("n") == 1, F.col("one")).when(F.col("n_named") == 1, F.col("named")).otherwise(F.lit(0).cast("bigint"))
    return found.select("row_key", "venue", entry.alias("venue_id"), F.when(entry == 0, -1).otherwise(F.col("edits")).alias("edits"))


def mapped_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "venue_list")
    names = entries.select(F.col("name").alias("venue")).distinct()
    papers = table(spark, sf_dir, "paper_records").select("record_id", "venue")
    return map_values(papers.join(names, "venue", "left_anti"), entries, "record_id", "venue")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper records whose venue is not exactly a listed name, with the entry it means or 0."""
    return mapped_papers(spark, sf_dir).select(F.col("row_key").alias("record_id"), "venue_id").distinct()


def p7_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no listed venue, with their number of records."""
    return mapped_papers(spark, sf_dir).where("venue_id = 0").groupBy("venue").agg(F.count("*").alias("n_records"))


QUERIES = {"p7_found": p7_found, "p7_unmatched": p7_unmatched}
