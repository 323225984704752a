"""Plans of a research question: language, identifiers, and the variants in which sources are asked."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from litloom.plans.lexicon import ENGLISH_STOPWORDS as STOPWORDS

#: Variants of a plan at most.
MAX_VARIANTS = 6


@dataclass(frozen=True)
class Variant:
    name: str
    text: str
    intent: str


@dataclass(frozen=True)
class Plan:
    question: str
    language: str
    identifiers: dict[str, str]
    terms: tuple[str, ...]
    variants: tuple[Variant, ...] = field(default=())


def normal_question(text: str) -> str:
    """NFKC, control characters as spaces, white space collapsed."""
    folded = unicodedata.normalize("NFKC", text or "")
    return re.sub(r"\s+", " ", "".join(" " if unicodedata.category(c) == "Cc" else c for c in folded)).strip()


def language(text: str) -> str:
    cjk, latin = bool(re.search(r"[㐀-䶿一-鿿]", text)), bool(re.search(r"[A-Za-z]", text))
    return "zh-en-mixed" if cjk and latin else "zh" if cjk else "en" if latin else "undetermined"


def identifiers(text: str) -> dict[str, str]:
    """DOI, PMCID, PMID and arXiv id in a question."""
    patterns = {"doi": r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+", "pmcid": r"\bPMC(?:ID)?\s*[:#-]?\s*(\d+)\b", "pmid": r"\bPMID\s*[:#-]?\s*(\d+)\b", "arxiv": r"\barXiv\s*:\s*((?:\d{4}\.\d{4,5})|(?:[a-z-]+/\d{7}))\b"}
    found = {}
    for name, pattern in patterns.items():
        if m := re.search(pattern, text, re.IGNORECASE):
            value = (m.group(1) if m.groups() else m.group()).rstrip(".,;:)]}")
            found[name] = f"PMC{value}" if name == "pmcid" else value
    return found


def english_terms(text: str, most: int = 12) -> tuple[str, ...]:
    """Words of three letters or more without stop words, in order."""
    words = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9-]{2,}", text)]
    return tuple(dict.fromkeys(w for w in words if w not in STOPWORDS))[:most]


def plan(question: str, english: str | None = None) -> Plan:
    """The plan of a question: the original first, then identifiers, a given translation, terms and a wide form."""
    asked = normal_question(question)
    kind, ids, terms = language(asked), identifiers(asked), english_terms(asked)
    variants = [Variant("original", asked, "recall")]
    variants += [Variant(f"identifier-{k}", v, "lookup") for k, v in ids.items()]
    if english and re.search(r"[A-Za-z]", english) and not re.search(r"[㐀-䶿一-鿿]", english) and len(english) <= 512 and len(english_terms(english)) >= 2:
        variants.append(Variant("caller-english", normal_question(english), "translation"))
    if len(terms) >= 2:
        variants.append(Variant("terms", " ".join(terms), "precision"))
        variants.append(Variant("concept-wide", " OR ".join(terms[:4]), "recall"))
    seen: dict[str, Variant] = {}
    for v in variants:
        seen.setdefault(v.text.casefold(), v)
    return Plan(asked, kind, ids, terms, tuple(seen.values())[:MAX_VARIANTS])
