"""Entity resolution against one sequential fold over all records."""

from litloom.operators import resolve
from litloom.operators.graph import connected_components
from litloom.runtime import table


def test_components_small(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (5, None), (3, 1), (1, 2)], "src bigint, dst bigint")
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}
    assert connected_components(edges.limit(0)).count() == 0


def test_long_path_and_hub(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 50)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "src bigint, dst bigint")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[1000 + k] == 1000 for k in range(50))


def test_same_as_sequential_fold(spark, data):
    papers = table(spark, data, "paper_records")
    rows = [r.asDict(recursive=True) for r in papers.select(*resolve.COLUMNS).orderBy("record_id").collect()]
    want = {(min(m.members), tuple(sorted(m.members)), m.values["title"], m.values["venue"], m.values["doi"], m.values["citation_count"], m.retracted) for m in resolve.fold(rows)}
    got = {(r.entity_id, tuple(r.members), r.title, r.venue, r.doi, r.citation_count, r.is_retracted) for r in resolve.merge_records(papers).collect()}
    assert got == want


def test_survivorship_rules():
    base = {c: None for c in resolve.COLUMNS} | {"record_id": 1, "provider": "openalex", "doi": "10.1/a", "title": "A title that is long enough to count", "venue": "V1", "is_retracted": False}
    other = base | {"record_id": 2, "provider": "crossref", "venue": "V2", "is_retracted": True, "keywords": ["Ice", "ice", "sea"]}
    third = base | {"record_id": 3, "provider": "unknown", "venue": "V3", "doi": "10.1/b", "title": None}
    merged = resolve.fold([base, other, third])
    assert [m.members for m in merged] == [[1, 2], [3]]
    assert merged[0].values["venue"] == "V2" and merged[0].retracted and merged[0].lists["keywords"] == ["Ice", "sea"]
    assert merged[0].conflicts["venue"] == [("V1", "openalex"), ("V2", "crossref")]


def test_empty(spark, data):
    assert resolve.merge_records(table(spark, data, "paper_records").limit(0)).count() == 0
