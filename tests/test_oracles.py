"""Every general query against its DuckDB oracle."""

import pytest

from litloom import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_oracle(spark, data, duck, name):
    same(registry.queries()[name](spark, data), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_same_rows_for_any_partitioning(spark, data, name):
    """Without an oracle, at least the rows may not depend on how the work is split."""
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in (before, "3"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            seen.append(sorted(map(repr, registry.queries()[name](spark, data).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_merged_records_are_a_partition_with_values_of_their_members(spark, data):
    merged = registry.queries()["jn_02_merged_records"](spark, data).collect()
    papers = {r.record_id: r for r in spark.read.parquet(f"{data}/paper_records.parquet").collect()}
    assert sorted(i for m in merged for i in m.members) == sorted(papers)
    for m in merged:
        own = [papers[i] for i in m.members]
        assert m.entity_id == min(m.members) and m.n_records == len(own) and m.is_retracted == any(r.is_retracted for r in own)
        for name in ("title", "venue", "doi", "year", "citation_count"):
            values = {getattr(r, name) for r in own if getattr(r, name) not in (None, "")}
            assert getattr(m, name) in values if values else getattr(m, name) is None
        assert m.providers == ",".join(sorted({r.provider for r in own}))
    coverage = registry.queries()["agg_03_router_coverage"](spark, data).first()
    assert (coverage.n_unique, coverage.n_stable) == (len(merged), sum(m.has_identifier for m in merged))
    assert all(m.has_identifier == any(getattr(papers[i], c) for i in m.members for c in ("doi", "pmid", "pmcid", "openalex_id", "semantic_scholar_id", "arxiv_id")) for m in merged)


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
