"""Problem 9: evaluation texts inside training texts.

Method: every window of ``WINDOW`` words of the items and of the documents is embedded by a CGK random walk, which
turns edit distance into Hamming distance; bit sampling (``SAMPLES`` steps of the walk) gives hash keys under which similar
windows meet. It is repeated as often as passages that are edited as much as allowed need to reach ``TARGET`` recall (see
``repeats_for``). Meetings are verified by an exact local alignment of the words. A window is half a passage of ``MIN_WORDS``
words, not a whole item, since a passage of an item is enough. Exact passages of ``MIN_WORDS`` words always meet.

The items are the small side (a fixed table) and travel to the documents in blocks of bounded size, so the corpus is
read once per block and never shuffled; which words are rare is counted over all items, so blocks change no result. Case,
punctuation and spacing are ignored. Null and empty texts match nothing;
repeated items and documents are judged alike; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.llm.vectext import mix, words
from litloom.runtime import table

#: Items that one task holds at once.
BLOCK = 5_000

#: Words of an item in a row that make a leak, and the share of them that must be equal.
MIN_WORDS, MIN_SHARE = 15, 0.8

#: A word is rare if at most this share of the items (or two of them) hold it, and the share of rare words that must be equal.
RARE_AMONG, RARE_SHARE = 0.04, 0.6

#: Rare words that a key and a passage must hold at least (a passage with fewer must hold all of them).
RARE_IN_KEY, RARE_IN_PASSAGE = 2, 3

#: Words a window must have left, steps of its walk, and steps sampled for a key.
WINDOW, STEPS, SAMPLES = 8, 14, 6

#: Share of the edited passages that must meet, passages it is measured on, and keys per window at most.
TARGET, TRIALS, MOST_REPEATS = 0.99, 600, 64

#: Words that may be set in between, and words of an item that are aligned at once.
REMARK, SEGMENT = 16, 96

_SEED = 20_240_917
_U = np.uint64


def _walks(repeats: int) -> list[tuple[np.uint64, list[int]]]:
    rng = np.random.default_rng(_SEED)
    return [(_U(rng.integers(1 << 63)), sorted(rng.choice(np.arange(1, STEPS), SAMPLES - 1, replace=False).tolist())) for _ in range(repeats)]


@lru_cache(maxsize=8)
def measured_recall(share: float = MIN_SHARE, repeats: int = MOST_REPEATS) -> tuple[float, ...]:
    """Share of passages of ``MIN_WORDS`` words that meet their edited copies after 1, 2, ... repeats.

    Words of random passages are replaced, left out or set in until no more than ``share`` of them is left.
    """
    rng = np.random.default_rng(_SEED)
    word = lambda n: mix(rng.integers(1 << 62, size=n).astype(_U))
    items, texts = [], []
    for _ in range(TRIALS):
        passage = word(MIN_WORDS)
        edited = passage.tolist()
        for _ in range(round((1 - share) * MIN_WORDS)):
            k, kind = int(rng.integers(1, len(edited) - 1)), int(rng.integers(3))
            edited[k : k + (kind != 1)] = [int(word(1)[0])] if kind != 2 else []
        items.append(passage)
        texts.append(np.concatenate((word(STEPS), np.asarray(edited, _U), word(STEPS))))
    sides = []
    for parts in (items, texts):
        firsts = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        sides.append((np.concatenate(parts), np.repeat(np.arange(TRIALS), np.diff(firsts)), whole_windows(firsts, firsts[-1])))
    (a, trial_a, whole), (b, trial_b, _) = sides
    met, found = np.zeros(TRIALS, bool), []
    for (ka, _), (kb, _) in zip(window_keys(a, repeats), window_keys(b, repeats)):
        held = set(zip(trial_a[whole].tolist(), ka[whole].tolist()))
        met[[t for t, k in zip(trial_b.tolist(), kb.tolist()) if (t, k) in held]] = True
        found.append(float(met.mean()))
    return tuple(found)


def repeats_for(target: float = TARGET, share: float = MIN_SHARE) -> int:
    """The least number of keys per window that reaches the target recall on edited passages."""
    reached = next((k for k, recall in enumerate(measured_recall(share), 1) if recall >= target), None)
    if reached is None:
        raise ValueError(f"a recall of {target} is not reached with {MOST_REPEATS} repeats")
    return reached


def window_keys(hashes: np.ndarray, repeats: int, rare: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each repeat the key of the window that begins at each word, and how many of its words are ``rare``.

    In step j the walk writes the word it stands on and moves on if the word's j-th random bit is set, so it sees
    about ``STEPS / 2`` words. Walks that leave their text only make keys that meet nothing.
    """
    n = len(hashes)
    padded = np.concatenate((hashes, np.zeros(STEPS, _U)))
    for seed, sampled in _walks(repeats):
        bits = (mix(padded ^ seed) >> _U(40)).astype(np.uint16)
        position = np.arange(n, dtype=np.int32)
        key = hashes ^ seed
        flags = None if rare is None else np.append(rare, np.zeros(STEPS, bool))
        seen = None if rare is None else rare.astype(np.int8)
        for j in range(1, sampled[-1] + 1):
            position += (bits[position] >> np.uint16(j)) & np.uint16(1)
            if j in sampled:
                key *= _U(0x9E3779B97F4A7C15)
                key ^= padded[position]
                if flags is not None:
                    seen += flags[position]
        key ^= key >> _U(29)
        yield key * _U(0xBF58476D1CE4E5B9), seen


def whole_windows(firsts: np.ndarray, n: int) -> np.ndarray:
    """True for the words that have at least ``WINDOW`` words left in their text."""
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(n)
    return left >= WINDOW


def aligned(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words of the item are matched in the best local alignment with ``text``."""
    n, m = len(item), len(text)
    equal = item[:, None] == text[None, :]
    score = np.zeros((n + 1, m + 1), np.float32)
    gap = np.float32(0.25)
    ramp = np.arange(m + 1, dtype=np.float32) * gap
    for i in range(1, n + 1):
        row = np.maximum(score[i - 1, :-1] + np.where(equal[i - 1], np.float32(1), np.float32(-0.75)), score[i - 1, 1:] - np.float32(0.75))
        row = np.concatenate(([np.float32(0)], np.maximum(row, 0)))
        score[i] = np.maximum.accumulate(row + ramp) - ramp  # skipping words of the text
    matched = np.zeros(n, bool)
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    while i > 0 and j > 0 and score[i, j] > 1e-4:
        s = score[i, j]
        if equal[i - 1, j - 1] and abs(score[i - 1, j - 1] + 1 - s) < 1e-3:
            matched[i - 1] = True
            i, j = i - 1, j - 1
        elif abs(score[i, j - 1] - gap - s) < 1e-3:
            j -= 1
        elif abs(score[i - 1, j - 1] - 0.75 - s) < 1e-3:
            i, j = i - 1, j - 1
        else:
            i -= 1
    return matched


def holds_passage(matched: np.ndarray, rare: np.ndarray, least: int = MIN_WORDS) -> bool:
    """True if at least ``least`` words in a row are there but for a few, with both ends of the stretch in place.

    Texts of one kind share phrases, so the words that are rare among the items must be there by themselves, too.
    """
    n = len(matched)
    least = min(least, n)
    if matched.sum() < MIN_SHARE * least:
        return False
    sums = np.concatenate(([0], np.cumsum(matched)))
    rares, both = np.concatenate(([0], np.cumsum(rare))), np.concatenate(([0], np.cumsum(rare & matched)))
    for a in np.flatnonzero(matched):
        if matched[a : a + 3].sum() < 2:
            continue
        for b in range(n, a + least - 1, -1):
            if matched[b - 1] and matched[max(a, b - 3) : b].sum() >= 2 and sums[b] - sums[a] >= MIN_SHARE * (b - a):
                r = rares[b] - rares[a]
                if both[b] - both[a] >= max(RARE_SHARE * r, min(RARE_IN_PASSAGE, r)):
                    return True
    return False


class segmented:
    """Items of more than ``SEGMENT`` words in overlapping parts, so that a part's alignment is of bounded size.

    A passage of up to half a part lies within one part; equal parts of one item are kept once.
    """

    def __init__(self, w, ids: list[int]):
        parts, owners = [], []
        for k, item in enumerate(ids):
            own = w.hashes[w.firsts[k] : w.firsts[k + 1]]
            seen = set()
            for a in range(0, max(1, len(own) - SEGMENT // 2), SEGMENT // 2) if len(own) > SEGMENT else (0,):
                part = own[a : a + SEGMENT]
                if part.tobytes() not in seen:
                    seen.add(part.tobytes())
                    parts.append(part)
                    owners.append(item)
        self.ids = np.asarray(owners, np.int64)
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, _U)
        self.firsts = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64)


def exact_keys(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, key)`` of every run of ``MIN_WORDS`` words within one text."""
    n = len(hashes) - MIN_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    key = np.zeros(n, _U)
    for k in range(MIN_WORDS):
        key = key * _U(0x9E3779B97F4A7C15) + hashes[k : k + n]
    left = np.repeat(firsts[1:], np.diff(firsts))[:n] - np.arange(n)
    place = np.flatnonzero(left >= MIN_WORDS)
    return place, mix(key[place])


def item_words(texts: list[str]) -> np.ndarray:
    """The distinct words of each text, as one array."""
    w = words(texts)
    parts = [np.unique(w.hashes[w.firsts[k] : w.firsts[k + 1]]) for k in range(len(texts))]
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def common_words(items: DataFrame) -> np.ndarray:
    """The words that are not rare: more than ``RARE_AMONG`` of the distinct item texts hold them, and more than two.

    There are at most 1 / ``RARE_AMONG`` times as many of them as words in a text of average length.
    """
    texts = items.select("text").where("text is not null").distinct()
    n = texts.count()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": item_words(batch["text"].tolist()).view(np.int64)})

    held = texts.mapInPandas(cut_up, "word bigint").groupBy("word").agg(F.count("*").alias("n"))
    return np.sort(np.array([r[0] for r in held.where(F.col("n") > max(2.0, RARE_AMONG * n)).select("word").toLocalIterator()], np.int64).view(_U))


class ItemIndex:
    """The keys of a block of items, ready to be met by documents; ``common`` are the words that are not rare."""

    def __init__(self, ids: list[int], texts: list[str], common: np.ndarray, repeats: int):
        w = segmented(words(texts), ids)
        self.repeats = repeats
        self.ids, self.hashes, self.firsts = w.ids, w.hashes, w.firsts
        lengths = np.diff(w.firsts)
        self.longest = int(lengths.max()) if len(lengths) else 0
        owner = np.repeat(np.arange(len(lengths)), lengths)
        self.rare = ~np.isin(w.hashes, common)
        whole = whole_windows(w.firsts, len(w.hashes))
        self.lookup = []
        for key, seen in window_keys(w.hashes, repeats, self.rare):
            usable = np.flatnonzero(whole & (seen >= RARE_IN_KEY))  # phrases that all texts share would meet everywhere
            # of equal windows of one item part, the first stands for all
            _, single = np.unique(np.stack((key[usable], owner[usable].astype(_U))), axis=1, return_index=True)
            usable = np.sort(usable[single])
            key = key[usable]
            order = np.argsort(key, kind="stable")
            sieve = np.zeros(1 << 22, bool)
            sieve[(key >> _U(42)).astype(np.int64)] = True
            self.lookup.append((key[order], usable[order], sieve))
        place, key = exact_keys(w.hashes, w.firsts)  # passages without rare words meet if they are whole
        order = np.argsort(key, kind="stable")
        sieve = np.zeros(1 << 22, bool)
        sieve[(key >> _U(42)).astype(np.int64)] = True
        self.exact = key[order], place[order], sieve
        self.short = {}
        for i in np.flatnonzero((lengths > 0) & (lengths < WINDOW)):  # shorter than a window: compared word by word
            self.short.setdefault(int(w.hashes[w.firsts[i]]), []).append(int(i))

    def meetings(self, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(word of the batch, word of the items)`` of all windows that meet under some key."""
        here, there = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        everywhere = np.arange(len(hashes))
        asking = itertools.chain(((everywhere, key) for key, _ in window_keys(hashes, self.repeats)), (exact_keys(hashes, firsts),))
        for (at, key), (keys, places, sieve) in zip(asking, (*self.lookup, self.exact)):
            passed = np.flatnonzero(sieve[(key >> _U(42)).astype(np.int64)])
            asked, passed = key[passed], at[passed]
            low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
            count = high - low
            hit = count > 0
            passed, low, count = passed[hit], low[hit], count[hit]
            slot = np.repeat(low, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            here.append(np.repeat(passed, count))
            there.append(places[slot])
        return np.concatenate(here), np.concatenate(there)

    def clusters(self, hashes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(text, item, lowest, highest diagonal)`` where equal words could make up a passage.

        Meetings of one text and item whose diagonals lie within a remark of each other belong together; the words of
        the item that are equal on any of their diagonals are counted, which is at least what an alignment can match.
        """
        here, there = self.meetings(hashes, firsts)
        if not len(here):
            return
        text = np.searchsorted(firsts, here, "right") - 1
        item = np.searchsorted(self.firsts, there, "right") - 1
        diagonal = here - there + self.firsts[item] - firsts[text]  # where the item's first word would be in the text
        rows = np.unique(np.stack((text, item, diagonal), 1), axis=0)
        text, item, diagonal = rows.T
        new = np.ones(len(rows), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(diagonal) > REMARK)
        cluster = np.cumsum(new) - 1
        columns = np.arange(self.longest)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(rows)) - 1
        step = max(1, 4_000_000 // max(1, self.longest))
        for a in range(0, len(first), step):
            b = min(a + step, len(first))
            r = np.arange(first[a], last[b - 1] + 1)
            words_at = self.firsts[item[r]][:, None] + columns
            text_at = (firsts[text[r]] + diagonal[r])[:, None] + columns
            ok = (words_at < self.firsts[item[r] + 1][:, None]) & (text_at >= firsts[text[r]][:, None]) & (text_at < firsts[text[r] + 1][:, None])
            equal = ok & (hashes[np.where(ok, text_at, 0)] == self.hashes[np.where(ok, words_at, 0)])
            union = np.logical_or.reduceat(equal, first[a:b] - first[a], axis=0)
            span = min(MIN_WORDS, self.longest)

            def in_spans(flags: np.ndarray, span=span) -> np.ndarray:
                sums = np.cumsum(np.pad(flags, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
                return sums[:, span:] - sums[:, : sums.shape[1] - span]

            heads = first[a:b]
            there_at = self.firsts[item[heads]][:, None] + columns
            inside = there_at < self.firsts[item[heads] + 1][:, None]
            rare = inside & self.rare[np.where(inside, there_at, 0)]
            need = np.minimum(np.diff(self.firsts)[item[heads]], MIN_WORDS) * MIN_SHARE
            good = (in_spans(union) >= need[:, None] - 1e-9) & (in_spans(union & rare) >= RARE_SHARE * 0.8 * in_spans(rare))
            for c in np.flatnonzero(good.any(axis=1)) + a:
                yield int(text[first[c]]), int(item[first[c]]), int(diagonal[first[c]]), int(diagonal[last[c]])

    def leaks(self, hashes: np.ndarray, firsts: np.ndarray) -> set[tuple[int, int]]:
        """``(text of the batch, item)`` of all verified leaks."""
        found: set[tuple[int, int]] = set()
        for t, i, low, high in self.clusters(hashes, firsts):
            if (t, i) not in found:
                a, b = int(self.firsts[i]), int(self.firsts[i + 1])
                begin, end = int(firsts[t]), int(firsts[t + 1])
                part = hashes[max(begin, begin + low - REMARK) : min(end, begin + high + (b - a) + REMARK)]
                if holds_passage(aligned(self.hashes[a:b], part), self.rare[a:b]):
                    found.add((t, i))
        for h, items in self.short.items():
            for place in np.flatnonzero(hashes == _U(h)).tolist():
                t = int(np.searchsorted(firsts, place, "right")) - 1
                for i in items:
                    word = self.hashes[self.firsts[i] : self.firsts[i + 1]]
                    if place + len(word) <= firsts[t + 1] and (hashes[place : place + len(word)] == word).all():
                        found.add((t, i))
        return found


def leaked_passages(documents: DataFrame, items: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id)`` for each document that holds a passage of an item.

    ``documents(doc_id, text)`` may be of any size; ``items(item_id, text)`` is searched in blocks of ``block_size`` items.
    """
    documents = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    schema = "doc_id bigint, item_id bigint"
    found = None
    common, repeats = common_words(items), repeats_for()
    for block in _blocks(items, block_size):

        def search(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            index = ItemIndex([i for i, _ in block], [t for _, t in block], common, repeats)
            for batch in batches:
                for part in range(0, len(batch), 2_000):  # bounds the arrays of one step
                    rows = batch.iloc[part : part + 2_000]
                    w = words(rows["text"].tolist())
                    ids = rows["doc_id"].to_numpy()
                    leaks = index.leaks(w.hashes, w.firsts)
                    yield pd.DataFrame({"doc_id": [ids[t] for t, _ in leaks], "item_id": [index.ids[i] for _, i in leaks]}, dtype="int64")

        hits = documents.mapInPandas(search, schema)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return documents.sparkSession.createDataFrame([], schema)
    return found.distinct()


def _blocks(items: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each evaluation item in how many documents it leaked (0 for none)."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite")
    leaks = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(leaks, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_documents"))


QUERIES = {"p9_found": p9_found, "p9_item_report": p9_item_report}
