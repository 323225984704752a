"""Every registered operator on empty tables, and on tables with nulls, repeats, long texts and clashing columns."""

import os

import duckdb
import pytest

from litloom.llm import registry

KEYS = {
    "paper_records": "record_id", "library_entries": "entry_id", "parsed_documents": "parsed_id", "evidence_records": "evidence_id", "documents": "doc_id", "eval_items": "item_id",
    "venue_list": "venue_id", "evidence_chunks": "parsed_id", "duplicate_groups": "group_id", "evidence_sources": "source_id",
}
CLASHING = ("id", "text_a", "word", "n", "part", "component", "class_id", "wording", "bucket", "score")


def variant(data, folder, kind):
    c = duckdb.connect()
    for file in os.listdir(data):
        name, source = file.removesuffix(".parquet"), f"'{data}/{file}'"
        if name not in KEYS and name != "size_limits":
            continue
        sql = f"SELECT * FROM {source}"
        if kind == "empty" and name != "size_limits":
            sql += " LIMIT 0"
        elif name in KEYS:
            columns = [(r[0], r[1]) for r in c.execute(f"DESCRIBE SELECT * FROM {source}").fetchall()]
            key = KEYS[name]
            offset = f"{key} || 'x'" if dict(columns)[key] == "VARCHAR" else f"{key} + 70000000"
            nulls = ", ".join(f"{offset} AS {n}" if n == key else f"CAST(NULL AS {t}) AS {n}" for n, t in columns)
            blank = ", ".join(f"{offset}{'' if dict(columns)[key] == 'VARCHAR' else ' + 1000'} AS {n}" if n == key else f"CAST('' AS {t}) AS {n}" if t == "VARCHAR" else f"{n}" for n, t in columns)
            long = ", ".join(f"{offset}{'' if dict(columns)[key] == 'VARCHAR' else ' + 2000'} AS {n}" if n == key else f"repeat('a long text without any end. ', 4000) AS {n}" if n in ("text", "abstract", "markdown") else n for n, _ in columns)
            extra = ", ".join(f"7 AS {n}" for n in CLASHING if n not in dict(columns))
            parts = [f"SELECT * FROM {source}", f"(SELECT {nulls} FROM {source} LIMIT 3)", f"(SELECT {blank} FROM {source} LIMIT 3)", f"(SELECT {long} FROM {source} LIMIT 1)"]
            if name in ("evidence_chunks", "duplicate_groups"):
                parts.append(f"(SELECT * FROM {source} LIMIT 5)")
            sql = f"SELECT *, {extra} FROM ({' UNION ALL '.join(parts)})"
        c.execute(f"COPY ({sql}) TO '{folder}/{file}' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def empty(data, tmp_path_factory):
    return variant(data, tmp_path_factory.mktemp("empty"), "empty")


@pytest.fixture(scope="module")
def dirty(data, tmp_path_factory):
    return variant(data, tmp_path_factory.mktemp("dirty"), "dirty")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == (1 if name == "p8_fill_report" else 0)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_dirty_tables(spark, dirty, name):
    rows = registry.queries()[name](spark, dirty).collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows)) and all(v is not None for r in rows for v in r)
