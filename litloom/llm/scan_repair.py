"""Problem 2: noise in texts from scanned pages.

Method: an averaged-perceptron character editor predicts for each character of a doubtful word whether to keep, replace or
delete it or to insert one after it, and for the end of a line whether to join it with the next one. It is trained on a
bounded sample of documents that have both layouts: where text and markdown of one document differ in a word, the far
rarer form is the misread one; where one layout goes on within a line, the other shows whether an end of line divides a
word. Running headings and page numbers are decided by a perceptron over page-position features (place between body lines,
neighbourhood of a page number, repetition within the document, likeness to the title, capitals), which learns from lines
that the other layout lacks although its text goes on across them. Weights start from those of ``PRIORS``, so that a corpus
without double layouts is read, too.

Words are doubtful if they are not among the known words of the corpus (counted over all documents) or of their document.
Null and empty fields have no lines; documents without damage have no rows; repeated documents are judged alike; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import difflib
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import ne

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.runtime import table

#: Documents the editor is trained on, about (chosen by a hash of their id), passes over them, and the seed of their order.
TRAIN_DOCUMENTS, EPOCHS, SEED = 400, 5, 11

#: Share of all words (and least count) from which a word is known, and how much more frequent a correction must be.
KNOWN_SHARE, KNOWN_LEAST, MORE_FREQUENT = 0.000001, 4, 12

#: Share of all words (and least count) from which both halves of a divided word are words by themselves.
COMMON_SHARE, COMMON_LEAST = 0.000033, 40

#: Rate of a word in continuous fields, as a share of its rate on pages, from which it is no misreading.
REAL_SHARE = 0.5

#: Marks that divide a word at the end of a line.
DIVIDERS = "-¬\xad‐"

#: Weights that the decisions begin with.
PRIORS = {
    "join": {"divider": 2.0, "open compound": -3.0, "spaced dash": -3.0, "bias": -1.0},
    "head": {"repeated": 2.0, "near page": 1.5, "capitals": 1.0, "edge": 3.0, "short": 1.0, "series": 2.5, "interrupts": 1.0, "wordy": -2.0, "small start": -1.5, "bias": -3.0},
    "page": {"marked": 2.0, "in series": 1.5, "beside": 2.0, "interrupts": 1.5, "inner": 0.5, "listed": -2.5, "alone": 0.7, "low bracket": -1.0, "bias": -2.0},
}

#: Passes over the lines a decision is learned from, and how far a right decision must lie on its side.
LINE_EPOCHS, MARGIN = 3, 0.25

# Words in the name of a series of publications.
SERIES = ("bulletin", "journal", "letters", "notes", "papers", "proceedings", "reports", "review")

# Words after a hyphen that belongs to a left-out part of a compound (short- and long-range).
_AFTER_OPEN_COMPOUND = frozenset(("and", "or", "to", "und", "oder", "bis", "vs", "versus"))

_PAGE = re.compile(
    r"\s*(?:(?P<dash>[-—–]\s*(?P<n1>\d{1,4})\s*[-—–])|(?P<bracket>\[\s*(?P<n2>\d{1,4})\s*\])|(?P<bar>\|?\s*(?P<n3>\d{1,4})\s*\|)"
    r"|(?P<word>(?:p[a-z0-9]{1,4}|s[e]ite|p\.|s\.|pg\.?)\s*(?P<n4>\d{1,4})(?:\s*(?:of|/|von|0f)\s*\d{1,4})?)|(?P<plain>(?P<n5>\d{1,4})))\s*",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"[^\s.,;:!?()\[\]{}\"“”‘’«»/=<>|*#_`，。；：、（）]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_EDGE_NUMBER = re.compile(r"^\s*\d{1,4}\s{1,}\|?\s*|\s*\|?\s{1,}\d{1,4}\s*$")
_MIXED_NUMBER = re.compile(r"\b(?=[0-9lIoO]*[0-9])[0-9lIoO]{2,4}\b")
_DIGITS = str.maketrans("lIoO", "1100")
_EDGE = re.compile(r"^\s*[0-9lIO]{1,4}\s{2,}[^\W\d_]{2}|[^\W\d_]\S*\s{2,}[0-9lIO]{1,4}\s*$")
_UNMIX = str.maketrans("015†", "olst")


def folded(line: str) -> str:
    """A line for comparing headings: without edge numbers, marks and the usual confusions."""
    return re.sub(r"[\W_]+", " ", _EDGE_NUMBER.sub("", line).lower().translate(_UNMIX)).strip()


def _like(a: str, b: str) -> bool:
    """Equal but for a few misread characters."""
    if a == b:
        return True
    if not a or len(a) != len(b):
        return False
    return sum(map(ne, a, b)) <= max(1, len(a) // 10)


class AlikeForms:
    """Finds forms that are equal but for a few characters (see _like): at least one of their sections is equal then."""

    def __init__(self, forms) -> None:
        self.by_section: dict[tuple, list[str]] = defaultdict(list)
        for form in forms:
            for section in self.sections(form):
                self.by_section[section].append(form)

    @staticmethod
    def sections(form: str) -> list[tuple]:
        parts = max(1, len(form) // 10) + 1
        edges = [len(form) * k // parts for k in range(parts + 1)]
        return [(len(form), k, form[a:b]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]

    def others(self, form: str) -> bool:
        """True if there is another form like this one."""
        return any(other != form and _like(other, form) for section in self.sections(form) for other in self.by_section.get(section, ()))


class Decision:
    """An averaged perceptron for one question about lines; above zero it is a yes."""

    def __init__(self, weights: dict[str, float]):
        self.weights = dict(weights)

    def score(self, features: dict[str, float]) -> float:
        return sum(self.weights.get(name, 0.0) * value for name, value in features.items())

    def train(self, rows: list[tuple[dict[str, float], bool]]) -> None:
        """Learn from features and right answers, in an order that does not depend on where they were found."""
        if not rows:
            return
        rows = sorted(rows, key=lambda r: (sorted(r[0].items()), r[1]))
        random.Random(SEED).shuffle(rows)
        current, total, step = dict(self.weights), Counter(), 0
        for _ in range(LINE_EPOCHS):
            for features, right in rows:
                step += 1
                side = 1.0 if right else -1.0
                if side * sum(current.get(k, 0.0) * v for k, v in features.items()) < MARGIN:
                    for k, v in features.items():
                        current[k] = current.get(k, 0.0) + 0.1 * side * v
                        total[k] += 0.1 * side * v * step
        self.weights = {k: w - total[k] / (step + 1) for k, w in current.items()}


def decisions() -> dict[str, Decision]:
    return {name: Decision(weights) for name, weights in PRIORS.items()}


_UNTRAINED = decisions()


def _series_name(folded_line: str) -> bool:
    """True for a short line with a word, maybe misread, of a series' name, or with its number."""
    words = folded_line.split()
    near = any(len(w) == len(s) and sum(x != y for x, y in zip(w, s)) <= 1 for w in words for s in SERIES) or any(w in ("report", "paper") for w in words)
    return len(words) <= 6 and (near or bool(re.search(r"\bno \d+$", folded_line)))


def page_furniture(lines: list[str], title: str | None, headings: set[str], asked: dict[str, Decision] = _UNTRAINED, seen: list | None = None) -> dict[int, str]:
    """Index of each furniture line with its kind, by page-position features.

    ``seen`` takes the question, line and features of every decision, for training.
    """
    n = len(lines)

    def is_so(question: str, i: int, features: dict[str, float]) -> bool:
        features = {k: float(v) for k, v in features.items() if v}
        if seen is not None:
            seen.append((question, i, features))
        return asked[question].score(features) >= 0.0

    full = [i for i in range(n) if lines[i].strip()]
    if len(full) < 2:
        return {}
    place = {i: k for k, i in enumerate(full)}
    forms: dict[int, tuple[str, int]] = {}
    for i in full:
        if len(lines[i]) <= 24 and (m := _PAGE.fullmatch(_MIXED_NUMBER.sub(lambda x: x.group().translate(_DIGITS), lines[i]))):
            forms[i] = (m.lastgroup if m.lastgroup in ("dash", "bracket", "bar", "word", "plain") else next(g for g in ("dash", "bracket", "bar", "word", "plain") if m.group(g)), int(next(x for x in m.group("n1", "n2", "n3", "n4", "n5") if x)))
    about = folded(title or "")
    first_body = full[0]
    counts: Counter = Counter()
    short: dict[int, str] = {}
    for i in full:
        s = lines[i].strip()
        if i in forms or len(s) > 110 or s.startswith(("#", "|", "- ", "* ", "> ")) or re.match(r"\d+[.)] ", s) or s.endswith((".", ",", ";")) and not re.search(r"No\. ?$", s):
            continue
        k = folded(s)
        if k and k not in headings:
            short[i] = k
            counts[re.sub(r"\d+", "", k).strip()] += 1
    wide = sorted(len(lines[i]) for i in full)[len(full) * 3 // 4]

    def interrupts(i: int) -> bool:
        """The lines around belong together: no stop before, small letter after."""
        k = place[i]
        before = after = None
        for j in range(k - 1, max(-1, k - 4), -1):
            if full[j] not in forms and full[j] not in heads:
                before = lines[full[j]].rstrip()
                break
        for j in range(k + 1, min(len(full), k + 4)):
            if full[j] not in forms and full[j] not in heads:
                after = lines[full[j]].lstrip()
                break
        if before is None or after is None:
            return False
        return (not before.endswith((".", "?", "!", ":", "”", "。")) and folded(before) not in headings and not before.startswith("#")) or after[:1].islower()

    found: dict[int, str] = {}
    heads: set[int] = set()
    for i, k in short.items():  # likeness to the title or repetition
        if i == first_body:
            continue
        if sum(map(ne, k[:8], about)) > max(1, len(k) // 10):
            continue
        words = k.split()  # the title, whole or shortened, maybe with the name of a series after it
        stems = (" ".join(words[:m]) for m in range(len(words), max(0, len(words) - 4), -1))
        titled = any(len(stem) >= 8 and len(about) >= len(stem) and _like(about[: len(stem)], stem) for stem in stems)
        if titled and len(lines[i]) <= max(wide + 30, 60):
            heads.add(i)
    alike = AlikeForms(form for form in counts if 6 < len(form) <= 60)
    near_page = {j for i in forms for j in full[max(0, place[i] - 1) : place[i] + 2]}
    for i, k in short.items():
        if i == first_body or i in heads:
            continue
        base = re.sub(r"\d+", "", k).strip()
        repeated = counts[base] >= 2 or (len(base) > 6 and alike.others(base))
        capitals = lines[i].strip().isupper() and len(base) > 3
        if len(base) < 4 or len(lines[i]) > 60:
            continue
        features = {
            "repeated": repeated, "near page": i in near_page, "capitals": capitals, "edge": bool(_EDGE.search(lines[i])), "short": len(lines[i]) < 0.6 * wide, "series": _series_name(k),
            "interrupts": interrupts(i), "wordy": len(k.split()) > 9, "small start": lines[i].strip()[:1].islower(), "bias": 1,
        }
        if is_so("head", i, features):
            heads.add(i)
    for i in heads:
        found[i] = "running_header"
    by_form: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, (form, number) in forms.items():
        by_form[form].append((i, number))
    for form, rows in by_form.items():
        numbers = {number for _, number in rows}
        for i, number in rows:
            k = place[i]
            around = [full[j] for j in (k - 1, k + 1) if 0 <= j < len(full)]
            in_series = (number - 1 in numbers) or (number + 1 in numbers)
            beside = any(j in heads for j in around)
            listed = any(re.fullmatch(r"[\W\d]*\d[\W\d]*|\S+\s+[\d.]+", lines[j].strip()) and j not in forms for j in around) or any(j in forms for j in around)
            features = {
                "marked": form != "plain", "in series": in_series, "beside": beside, "interrupts": interrupts(i), "inner": 0 < i < n - 1, "listed": listed,
                "alone": i > 0 and not lines[i - 1].strip() and i + 1 < n and not lines[i + 1].strip(), "low bracket": form == "bracket" and number < 30 and not in_series, "bias": 1,
            }
            if is_so("page", i, features):
                found[i] = "page_number"
    return found


class Editor:
    """Averaged perceptron over the characters of a word; also decides whether a line's end is joined, and what is furniture."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}
        self.ops: dict[str, list[str]] = {}
        self.asked = decisions()

    @staticmethod
    def end_features(line: str, last: str, first: str, known) -> dict[str, float]:
        """What the end of a line, its last word and the next line's first say about joining them; ``known`` counts words."""
        stem = last.rstrip(DIVIDERS)
        found = {"small start": first[:1].islower(), "digit": first[:1].isdigit() or stem[-1:].isdigit(), "bias": 1}
        if line[-1:] in DIVIDERS:
            whole, kept = known(stem + first), known(f"{stem}-{first}")
            found |= {
                "divider": 1, "plain mark": line[-1] == "-", "open compound": line[-1] == "-" and first.lower() in _AFTER_OPEN_COMPOUND, "spaced dash": line.endswith((" -", "--")),
                "whole known": whole >= KNOWN_LEAST, "kept known": kept >= KNOWN_LEAST, "parts known": not whole and not kept and known(stem) >= KNOWN_LEAST and known(first) >= KNOWN_LEAST,
            }
        return {k: float(v) for k, v in found.items() if v}

    def joins(self, line: str, last: str, following: str, known) -> bool:
        """The operation at the end of a line: whether its last word goes on in the next line."""
        first = _TOKEN.search(following)
        if first is None or not first.group()[0].isalnum() or not last.rstrip(DIVIDERS):
            return False
        return self.asked["join"].score(self.end_features(line, last, first.group(), known)) > 0

    @staticmethod
    def features(word: str, i: int) -> list[str]:
        w = f"  {word}  "
        a, b, c, d, e = w[i : i + 5]
        lower = "a" if c.isalpha() else "1" if c.isdigit() else "#"
        return [f"c{c}", f"l{b}{c}", f"r{c}{d}", f"ll{a}{b}{c}", f"rr{c}{d}{e}", f"m{b}{c}{d}", f"k{lower}{b.isalpha()}{d.isalpha()}", f"x{b}_{d}"]

    @staticmethod
    def operations(noisy: str, clean: str) -> list[str]:
        """The operation of each character of ``noisy``: keep, delete, replace by x, insert x after it."""
        ops = ["="] * len(noisy)
        for tag, a, b, c, d in difflib.SequenceMatcher(None, noisy, clean, autojunk=False).get_opcodes():
            if tag == "replace":
                for k in range(a, b):
                    ops[k] = f">{clean[c + k - a]}" if c + k - a < d else "-"
                if d - c > b - a:
                    ops[b - 1] = f">{clean[c + b - a - 1 : d]}"
            elif tag == "delete":
                for k in range(a, b):
                    ops[k] = "-"
            elif tag == "insert" and a > 0:
                ops[a - 1] += f"+{clean[c:d]}"
        return ops

    @staticmethod
    def apply(word: str, ops: dict[int, str]) -> str:
        out = []
        for i, ch in enumerate(word):
            op = ops.get(i, "=")
            if op == "-":
                continue
            body, _, extra = op.partition("+")
            out.append((body[1:] if body.startswith(">") else ch) + extra)
        return "".join(out)

    def train(self, pairs: list[tuple[str, str]], epochs: int = EPOCHS) -> None:
        rows = [(noisy, self.operations(noisy, clean)) for noisy, clean in pairs]
        seen: dict[str, Counter] = defaultdict(Counter)
        for word, ops in rows:
            for ch, op in zip(word, ops):
                seen[ch][op] += 1
        self.ops = {ch: ["=", *[op for op, c in counts.items() if op != "=" and c >= 2]] for ch, counts in seen.items()}
        weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        totals: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        step, order = 1, random.Random(SEED)
        for _ in range(epochs):
            order.shuffle(rows)
            for word, ops in rows:
                for i, (ch, gold) in enumerate(zip(word, ops)):
                    choices = self.ops[ch]
                    if len(choices) == 1 or gold not in choices:
                        continue
                    feats = self.features(word, i)
                    best = max(choices, key=lambda op: (sum(weights[f].get(op, 0.0) for f in feats), op))
                    if best != gold:
                        for f in feats:
                            for op, sign in ((gold, 1.0), (best, -1.0)):
                                weights[f][op] += sign
                                totals[f][op] += sign * step
                    step += 1
        self.weights = {f: {op: w - totals[f][op] / step for op, w in row.items()} for f, row in weights.items()}

    def margins(self, word: str) -> list[tuple[float, int, str]]:
        """Operations other than keep with their lead over keeping, best first."""
        found = []
        for i, ch in enumerate(word):
            choices = self.ops.get(ch)
            if not choices or len(choices) == 1:
                continue
            rows = [self.weights.get(f, {}) for f in self.features(word, i)]
            keep = sum(r.get("=", 0.0) for r in rows)
            found.extend((sum(r.get(op, 0.0) for r in rows) - keep, i, op) for op in choices[1:])
        found.sort(key=lambda x: (-x[0], x[1], x[2]))
        return found

    def correct(self, word: str, count, more: float, own: int) -> str | None:
        """The most likely known word that ``word`` is a misreading of, if any: one edit, or two that go together.

        ``own`` is how often the word itself occurs; the right word must be ``more`` times as frequent.
        """
        margins = self.margins(word)[:24]
        for k, (_, i, op) in enumerate(margins):
            single = self.apply(word, {i: op})
            if single != word and count(single) >= max(more * own, 2):
                return single
            for _, j, other in margins[k + 1 : 16] if k < 6 else ():
                if j != i:
                    double = self.apply(word, {i: op, j: other})
                    if double != word and count(double) >= max(more * own, 2):
                        return double
        return None


def tokens(line: str) -> list[str]:
    return _TOKEN.findall(line)


def _body(lines: list[str], furniture: dict[int, str]) -> list[int]:
    return [i for i in range(len(lines)) if i not in furniture and lines[i].strip()]


def _joined_words(text: str, title: str | None, headings: set[str]) -> list[str]:
    """Words of a field in reading order, without furniture and with divided words joined."""
    lines = text.split("\n")
    words: list[str] = []
    carry = ""
    for i in _body(lines, page_furniture(lines, title, headings)):
        line = lines[i].rstrip()
        found = tokens(line)
        if carry and found:
            found[0] = carry + found[0]
        carry = ""
        if found and line[-1] in DIVIDERS:
            carry = found.pop().rstrip(DIVIDERS)
        words.extend(found)
    return words + ([carry] if carry else [])


def is_laid_out(text: str) -> bool:
    """True for a field that is broken into the lines of a page."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 4:
        return False
    return sum(25 < len(x) < 110 for x in lines) >= 0.5 * len(lines) and sum(len(x) > 140 for x in lines) <= 0.1 * len(lines)


def training_pairs(rows: list, counts: dict[str, int]) -> list[tuple[str, str]]:
    """Misread and right form of words in which the two layouts of a document differ, and as many undamaged words."""
    pairs, clean = [], []
    for row in rows:
        if not row["text"] or not row["markdown"] or not (is_laid_out(row["text"]) or is_laid_out(row["markdown"])):
            continue
        headings = {folded(s) for s in row["headings"] or () if s}
        a = _joined_words(row["text"], row["title"], headings)
        b = _joined_words(row["markdown"], row["title"], headings)
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag == "equal":
                clean.extend(x for x in a[i:j:7] if len(x) > 2)
            elif tag == "replace" and j - i == m - k <= 3:
                for x, y in zip(a[i:j], b[k:m]):
                    low, high = sorted((x, y), key=lambda w: counts.get(w, 0))
                    if low.lower() != high.lower() and counts.get(high, 0) >= 5 * max(1, counts.get(low, 0)) and abs(len(x) - len(y)) <= 1:
                        if difflib.SequenceMatcher(None, low, high, autojunk=False).ratio() >= 0.6:
                            pairs.append((low, high))
    clean = clean[: 2 * len(pairs)]
    return pairs + [(w, w) for w in clean]


def line_lessons(rows: list, known) -> dict[str, list[tuple[dict[str, float], bool]]]:
    """Features and right answers for the decisions about lines, from documents with two layouts.

    A line that the other layout lacks, although the words around it follow each other there, is furniture; one whose words
    follow each other there is none. An end of line divides a word if the other layout has the word whole.
    """
    lessons: dict[str, list] = {name: [] for name in PRIORS}
    for row in rows:
        headings = {folded(s) for s in row["headings"] or () if s}
        for own, other in ((row["text"], row["markdown"]), (row["markdown"], row["text"])):
            if not own or not other or not is_laid_out(own):
                continue
            there = [w.lower() for w in _joined_words(other, row["title"], headings)]
            words, follow = set(there), set(zip(there, there[1:]))
            lines = own.split("\n")
            seen: list = []
            furniture = page_furniture(lines, row["title"], headings, seen=seen)
            body = _body(lines, furniture)
            place = {i: [w.lower() for w in tokens(lines[i])] for i in range(len(lines)) if lines[i].strip()}
            for question, i, features in seen:
                before = next((place[j] for j in reversed(body) if j < i and place[j]), None)
                after = next((place[j] for j in body if j > i and place[j]), None)
                mine = [pair for pair in zip(place[i], place[i][1:])]
                inside = bool(mine) and sum(pair in follow for pair in mine) > 0.7 * len(mine)
                across = bool(before and after) and ((before[-1], after[0]) in follow or before[-1].rstrip(DIVIDERS) + after[0] in words)
                if across and not inside:
                    lessons[question].append((features, True))
                elif inside or (question == "page" and before and place[i] and (before[-1], place[i][0]) in follow):
                    lessons[question].append((features, False))
            for i, j in zip(body, body[1:]):
                line, following = lines[i].rstrip(), lines[j].lstrip()
                if place[i] and place[j]:
                    stem, first = place[i][-1].rstrip(DIVIDERS), place[j][0]
                    joined = stem + first in words or f"{stem}-{first}" in words
                    apart = (place[i][-1], first) in follow or (stem, first) in follow
                    if joined != apart:
                        lessons["join"].append((Editor.end_features(line, tokens(line)[-1], tokens(following)[0], known), joined))
    return lessons


def word_counts(documents: DataFrame) -> DataFrame:
    """``(word, n, flowing)`` over both layouts of all documents; divided words count by their parts.

    ``flowing`` is the number in fields that are not broken into the lines of a page.
    """

    def rows(total: Counter, flowing: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": list(total), "n": list(total.values()), "flowing": [flowing[w] for w in total]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, flowing = Counter(), Counter()
        for batch in batches:
            for column in ("text", "markdown"):
                for text in batch[column]:
                    if text:
                        found = _TOKEN.findall(text)
                        total.update(found)
                        if not is_laid_out(text):
                            flowing.update(found)
            if len(total) > 200_000:
                yield rows(total, flowing)
                total.clear()
                flowing.clear()
        if total:
            yield rows(total, flowing)

    counted = documents.select("text", "markdown").mapInPandas(count, "word string, n bigint, flowing bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("flowing").alias("flowing"))


class Reader:
    """Finds the noise in one field: furniture, divided and misread words."""

    def __init__(self, editor: Editor, counts: dict[str, int], real: frozenset = frozenset()):
        self.editor, self.counts, self.real = editor, counts, real
        self.common = max(COMMON_LEAST, int(sum(counts.values()) * COMMON_SHARE))
        self.memory: dict[str, str | None] = {}

    def known(self, word: str) -> int:
        n = self.counts.get(word, 0)
        if not n and word[:1].isupper():
            n = self.counts.get(word[0].lower() + word[1:], 0)
        return n

    def is_real(self, word: str) -> bool:
        if word not in self.counts and word[:1].isupper():
            word = word[0].lower() + word[1:]
        return word in self.real

    def misread(self, word: str, local: Counter) -> str | None:
        """The right form of a misread word."""
        if len(word) < 3 or _CJK.search(word) or not any(c.isalpha() for c in word):
            return None
        if word in self.memory:
            hit = self.memory[word]
        else:
            if len(self.memory) > 200_000:
                self.memory.clear()
            hit = self.memory[word] = self._correct(word, self.known)
        if hit is None and local[word] <= 1 and self.known(word) < KNOWN_LEAST:
            # names of one document are known by repetition there
            hit = self._correct(word, lambda w: max(self.known(w), 3 * local[w] if local[w] >= 2 else 0))
        return hit

    def _correct(self, word: str, count) -> str | None:
        parts = word.strip("-–—'").split("-")
        whole = count(word)
        for k, part in enumerate(parts):
            own = max(count(part), whole)
            if len(part) >= 3 and not self.is_real(part):
                right = self.editor.correct(part, count, MORE_FREQUENT, own)
                if right and not (any(c.isdigit() for c in part) and any(c.isdigit() for c in right) and count(part) > 1):
                    return "-".join([*parts[:k], right, *parts[k + 1 :]])
        return None

    def lines(self, text: str, title: str | None, headings: set[str]) -> list[tuple[int, str]]:
        """``(line number from 1, kind)`` of all noise of a field."""
        lines = text.split("\n")
        laid_out = is_laid_out(text)
        furniture = page_furniture(lines, title, headings, self.editor.asked) if laid_out or len(lines) > 6 else {}
        found = [(i + 1, kind) for i, kind in furniture.items()]
        if not laid_out:
            return found
        body = _body(lines, furniture)
        local: Counter = Counter(t for i in body for t in tokens(lines[i]))
        carry, carried_from = "", None
        for k, i in enumerate(body):
            line = lines[i].rstrip()
            words = tokens(line)
            following = lines[body[k + 1]].lstrip() if k + 1 < len(body) else ""
            bad = False
            if carry and words:
                whole, kept = carry + words[0], carry + "-" + words[0]
                if self.known(whole) < KNOWN_LEAST and self.known(kept) < KNOWN_LEAST and not (self.known(carry) >= self.common and self.known(words[0]) >= self.common):
                    right = self.misread(whole, local)
                    if right:  # the line of the part that differs is misread
                        if right.startswith(carry):
                            bad = True
                        elif right.endswith(words[0]):
                            found.append((carried_from + 1, "misread"))
                        else:
                            found.append((carried_from + 1, "misread"))
                            bad = True
                words = words[1:]
            carry, carried_from = "", None
            if words and following and self.editor.joins(line, words[-1], following, self.known):
                found.append((i + 1, "split_word"))
                carry, carried_from = words[-1].rstrip(DIVIDERS), i
                words = words[:-1]
            if not bad:
                bad = any(self.misread(w, local) for w in words)
            if bad:
                found.append((i + 1, "misread"))
        return found

    def repair(self, text: str, title: str | None, headings: set[str]) -> str:
        """The field as continuous paragraphs: no furniture, words joined, misreadings corrected."""
        if not is_laid_out(text):
            return text
        lines = text.split("\n")
        furniture = page_furniture(lines, title, headings, self.editor.asked)
        local: Counter = Counter(t for i in _body(lines, furniture) for t in tokens(lines[i]))
        out: list[str] = []
        paragraph = ""
        blank_before = False
        fix = lambda m: self.misread(m.group(), local) or m.group()
        for i, line in enumerate(lines):
            if i in furniture:
                continue
            s = line.strip()
            if not s:
                blank_before = True
                continue
            continues = paragraph and not paragraph.endswith((".", "?", "!", ":", "。")) and not s.startswith(("#", "|", "- ", "* ")) and folded(paragraph) not in headings
            if blank_before and not (continues and (s[:1].islower() or paragraph[-1] in DIVIDERS)):
                if paragraph:
                    out.append(paragraph)
                paragraph = ""
            blank_before = False
            if paragraph and self.editor.joins(paragraph, (tokens(paragraph[-200:]) or [""])[-1], s, self.known):
                head, first = (tokens(paragraph[-200:]) or [""])[-1].rstrip(DIVIDERS), tokens(s)[0]
                hyphen = self.known(head + "-" + first) > self.known(head + first)
                paragraph = paragraph.rstrip(DIVIDERS) + ("-" if hyphen else "") + s
            else:
                paragraph = f"{paragraph} {s}" if paragraph else s
        if paragraph:
            out.append(paragraph)
        return "\n\n".join(_TOKEN.sub(fix, p) for p in out)


def trained(documents: DataFrame) -> tuple[Editor, dict[str, int], frozenset]:
    """The editor, the known words of the corpus, and those of them that are no misreadings.

    Only pages are misread, so a word that is as usual in continuous fields (``REAL_SHARE``) is no misreading, however often it occurs.

    A known word makes up ``KNOWN_SHARE`` of all words, so there are at most ``1 / KNOWN_SHARE`` of them.
    """
    counted = word_counts(documents).cache()
    total, flowing = (x or 0 for x in counted.agg(F.sum("n"), F.sum("flowing")).first())
    least = max(KNOWN_LEAST, int(total * KNOWN_SHARE))
    counts, real = {}, set()
    for word, n, clean in counted.where(F.col("n") >= least).toLocalIterator():
        counts[word] = n
        if clean * (total - flowing) >= REAL_SHARE * (n - clean) * flowing > 0:
            real.add(word)
    counted.unpersist()
    usable = documents.where("text is not null and markdown is not null")
    share = min(1.0, TRAIN_DOCUMENTS / max(1, usable.count()))
    # by a hash of the id, so that no task sends more than its share of the sample
    chosen = F.pmod(F.xxhash64("parsed_id"), F.lit(10**15)) < F.lit(max(1, round(share * 10**15)))
    sample = usable.where(chosen).select("title", "text", "markdown", F.expr("transform(sections, s -> s.title)").alias("headings"), "parsed_id").collect()
    sample.sort(key=lambda r: r["parsed_id"])
    editor = Editor()
    editor.train(training_pairs(sample, counts))
    for name, lessons in line_lessons(sample, lambda w: counts.get(w, 0)).items():
        editor.asked[name].train(lessons)
    return editor, counts, frozenset(real)


def _fields(documents: DataFrame) -> DataFrame:
    return documents.select("parsed_id", "title", "text", "markdown", F.expr("transform(sections, s -> s.title)").alias("headings"))


def page_noise(documents: DataFrame) -> DataFrame:
    """``(parsed_id, field_name, line_no, noise_kind)`` of all noisy lines of ``parsed_documents``."""
    model = documents.sparkSession.sparkContext.broadcast(trained(documents))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*model.value)
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                headings = {folded(s) for s in (row.headings if row.headings is not None else ()) if s}
                for field, text in (("text", row.text), ("markdown", row.markdown)):
                    if text:
                        rows.extend((row.parsed_id, field, n, kind) for n, kind in reader.lines(text, row.title, headings))
            if rows:
                yield pd.DataFrame(rows, columns=["parsed_id", "field_name", "line_no", "noise_kind"])

    return _fields(documents).mapInPandas(read, "parsed_id bigint, field_name string, line_no bigint, noise_kind string").distinct()


def repaired(documents: DataFrame) -> DataFrame:
    """``(parsed_id, text, markdown)`` as continuous readable paragraphs."""
    model = documents.sparkSession.sparkContext.broadcast(trained(documents))

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*model.value)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                headings = {folded(s) for s in (row.headings if row.headings is not None else ()) if s}
                out.append((row.parsed_id, *[reader.repair(t, row.title, headings) if t else t for t in (row.text, row.markdown)]))
            yield pd.DataFrame(out, columns=["parsed_id", "text", "markdown"])

    return _fields(documents).mapInPandas(mend, "parsed_id bigint, text string, markdown string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of parsed documents that carry damage from page layout or recognition."""
    return page_noise(table(spark, sf_dir, "parsed_documents"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both layouts of every parsed document as continuous paragraphs."""
    return repaired(table(spark, sf_dir, "parsed_documents"))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
