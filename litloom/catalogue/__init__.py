"""Importing this package registers every general query with its oracle."""

from litloom.catalogue import aggregates, checks, controls, documents, grids, helpers, identifiers, joins, planning, ranking, scalars, sources, windows, wire  # noqa: F401
