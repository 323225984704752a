"""Profiles of retrieval: limits by name, overrides by alias, and every clamp on record."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from litloom.plans import lexicon as lx
from litloom.plans import query

#: Requests of a question, rows of a request, and references aimed at.
PROFILES = {
    "quick": {"max_requests": 6, "rows_per_request": 5, "target_references": 12},
    "standard": {"max_requests": 12, "rows_per_request": 10, "target_references": 60},
    "deep": {"max_requests": 24, "rows_per_request": 20, "target_references": 100},
}

#: Other names of the settings.
ALIASES = {"requests": "max_requests", "request_limit": "max_requests", "per_page": "rows_per_request", "limit": "rows_per_request", "references": "target_references", "target": "target_references"}

#: Largest value of each setting.
CEILINGS = {"max_requests": 48, "rows_per_request": 100, "target_references": 500}

FILTERS = ("after_date", "before_date", "fields_of_study", "publication_types", "open_access_only", "min_citation_count")


@dataclass(frozen=True)
class Resolved:
    profile: str
    settings: dict[str, int]
    budgets: dict[str, int]
    clamps: tuple[str, ...] = field(default=())


def overrides(given: Mapping[str, object]) -> dict[str, int]:
    """Settings under their own names; an unknown name or a value that is no number is an error."""
    found = {}
    for name, value in given.items():
        own = ALIASES.get(name, name)
        if own not in CEILINGS:
            raise ValueError(f"no setting is named {name!r}")
        if isinstance(value, bool) or not isinstance(value, int):
            raise ValueError(f"{name} must be a whole number")
        found[own] = value
    return found


def budgets(limit: int, given: Mapping[str, int] | None = None, clamp: bool = True) -> dict[str, int]:
    """Requests of each provider, none below 0 and, if clamped, none above the limit of all; known ones first."""
    wanted = {**lx.PROVIDER_BUDGETS, **(given or {})}
    order = [*lx.PROVIDER_BUDGETS, *sorted(set(wanted) - set(lx.PROVIDER_BUDGETS))]
    return {p: max(0, min(wanted[p], limit) if clamp else wanted[p]) for p in order}


def resolve(profile: str, given: Mapping[str, object] | None = None) -> Resolved:
    """The settings of a profile with overrides, each kept between 1 and its ceiling."""
    if profile not in PROFILES:
        raise ValueError(f"no profile is named {profile!r}")
    settings, clamps = dict(PROFILES[profile]), []
    for name, value in overrides(given or {}).items():
        settings[name] = min(max(value, 1), CEILINGS[name])
        if settings[name] != value:
            clamps.append(f"{name}: {value} became {settings[name]}")
    return Resolved(profile, settings, budgets(settings["max_requests"]), tuple(clamps))


def filters(given: Mapping[str, object] | None) -> dict[str, object]:
    """The filters of a search with their empty values."""
    source = dict(given or {})
    return {
        name: list(source.get(name) or []) if name in ("fields_of_study", "publication_types") else bool(source.get(name)) if name == "open_access_only" else source.get(name)
        for name in FILTERS
    }


def emergency_plan(question: str) -> query.Plan:
    """The plan when planning fails: the question as it is, and nothing else."""
    text = str(question or "")
    return query.Plan(text, "undetermined", {}, (), (query.Variant("original", text, "recall"),))
