"""Grids, documents, sources, plans and streams on fixtures."""

import json

import numpy as np
import pytest

from litloom.functions import documents as dx
from litloom.operators import grid as gx
from litloom.operators import rank
from litloom.plans import query
from litloom.sources import tabular
from litloom.streaming import ledger


def test_resample_as_numpy(spark):
    xs, ys = [0.0, 1.0, 3.0], [0.0, 2.0, 5.0, 6.0]
    z = np.array([[x * 2 + y * y for x in xs] for y in ys])
    g = spark.createDataFrame([(x, y, float(z[j, i])) for i, x in enumerate(xs) for j, y in enumerate(ys)], "x double, y double, value double")
    tx, ty = [0.0, 0.5, 3.0], [1.0, 5.5, 6.0]
    along = np.array([np.interp(tx, xs, row) for row in z])
    want = np.array([np.interp(ty, ys, col) for col in along.T]).T
    got = {(r.x, r.y): r.value for r in gx.resample(gx.from_samples(g, "x", "y", "value"), tx, ty).collect()}
    assert len(got) == 9 and all(abs(got[(x, y)] - want[j, i]) < 1e-9 for i, x in enumerate(tx) for j, y in enumerate(ty))
    with pytest.raises(ValueError):
        gx.resample(g, [0.0, 4.0], ty)


@pytest.mark.parametrize(
    "rows, message",
    [
        ([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "incomplete"),
        ([(0, 0, 1.0), (0, 0, 2.0), (1, 0, 3.0), (0, 1, 1.0), (1, 1, 1.0)], "repeated"),
        ([(0, 0, float("nan")), (1, 1, 1.0)], "finite"),
        ([(0, 0, 1.0), (1, 0, 1.0)], "two distinct"),
    ],
)
def test_bad_grids(spark, rows, message):
    df = spark.createDataFrame([(float(a), float(b), c) for a, b, c in rows], "x double, y double, v double")
    with pytest.raises(ValueError, match=message):
        gx.from_samples(df, "x", "y", "v")


def test_markdown():
    text = "intro\n# One\nbody\n\n| a | b |\n|---|---|\n| 1 | x\\|y |\n| 1 |\n```\n| no | table |\n|---|---|\n```\n## Two\n"
    assert dx.markdown_sections(text)[0] == ("document", "intro") and [t for t, _ in dx.markdown_sections(text)] == ["document", "One"]
    (table,) = dx.markdown_tables(text)
    assert table["header"] == ["a", "b"] and table["rows"] == [["1", "x|y"]] and table["bad_lines"] == [8]
    assert dx.markdown_sections(None) == [] and dx.markdown_tables("") == []


def test_html():
    html = """<html><head><title>A  page</title><meta name="author" content="Ann"><meta property="article:published_time" content="2020-01-02"></head>
    <body><nav>menu menu menu menu menu menu menu menu</nav><p>This paragraph is long enough to be kept as text.</p><p>short</p>
    <div class="cookie banner">We use cookies on this site, as everybody does.</div><p>This paragraph is long enough to be KEPT as text.</p>
    <table><tr><td>a</td><td>1</td></tr></table></body></html>"""
    page = dx.read_html(html)
    assert page["title"] == "A page" and page["authors"] == ["Ann"] and page["date"] == "2020-01-02"
    assert page["text"].startswith("A page This paragraph") or "This paragraph is long enough to be kept as text." in page["text"]
    assert page["tables"] == ["a 1"] and "cookies" not in page["text"] and "menu" not in page["text"]


def test_jats():
    xml = """<article><front><article-title>T</article-title><contrib><name><surname>Ng</surname><given-names>Li</given-names></name></contrib>
    <pub-date><day>3</day><month>7</month><year>2021</year></pub-date><abstract><p>Short.</p></abstract></front>
    <body><sec><title>Aims</title><p>First.</p><p>Second.</p></sec><fig><label>Fig. 1</label><caption><p>Seen</p></caption></fig></body><back><ref>R1</ref></back></article>"""
    d = dx.read_jats(xml)
    assert d["authors"] == ["Ng Li"] and d["date"] == "2021-07-03" and d["sections"] == [("Abstract", "Short."), ("Aims", "First.\n\nSecond.")]
    assert d["captions"] == [("Fig. 1", "Seen", "fig")] and d["references"] == ["R1"]
    with pytest.raises(ValueError):
        dx.read_jats("no xml")


def test_packing_paragraphs():
    text = ("A sentence of a good length that is kept here. " * 80).strip()
    chunks = dx.pack_paragraphs(text, 500)
    assert all(len(c) <= 500 for c in chunks) and " ".join(chunks) == text
    assert dx.pack_paragraphs(None) == []


def test_tables_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n#no\n3;4\n")
    assert tabular.load_table(spark, str(tmp_path / "a.csv"), delimiter=";", comment="#").count() == 2
    np.save(tmp_path / "b.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert tabular.load_table(spark, str(tmp_path / "b.npy")).columns == ["col_0", "col_1"]
    np.savez(tmp_path / "c.npz", v=np.arange(3))
    assert [r.value for r in tabular.load_table(spark, str(tmp_path / "c.npz"), array="v").collect()] == [0, 1, 2]
    (tmp_path / "d.json").write_text(json.dumps([{"k": 1}, {"k": 2}]))
    assert tabular.load_table(spark, str(tmp_path / "d.json")).count() == 2
    for bad in ("e.xls", "f.bin"):
        with pytest.raises(ValueError):
            tabular.infer_format(bad)
    (tmp_path / "g.csv").write_text("x,y\n")
    with pytest.raises(ValueError):
        tabular.load_table(spark, str(tmp_path / "g.csv"))


def test_plans():
    p = query.plan("How does thermal stability affect hydrolysis?", english="thermal stability hydrolysis")
    assert p.language == "en" and p.variants[0].name == "original" and len(p.variants) <= query.MAX_VARIANTS
    assert query.plan("see 10.1234/abc.5, please").identifiers == {"doi": "10.1234/abc.5"}
    assert query.plan("样品温度").language == "zh" and query.plan("样品 x").language == "zh-en-mixed" and query.plan("").language == "undetermined"
    assert query.plan("a b", english="样品") == query.plan("a b")


def test_ranking_weights():
    q = rank.Question(("a",), weights={"title_match": 2.0, "year_fit": -1.0})
    assert q.normal_weights()["title_match"] == 1.0 and q.normal_weights()["year_fit"] == 0.0
    for bad in ({"nonsense": 1.0}, {"title_match": 0.0}):
        with pytest.raises(ValueError):
            rank.Question(("a",), weights=bad).normal_weights()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"2024-01-01T{h:02d}:{k % 60:02d}:00", k % 3, "a" if k % 2 else "b", float(k), "{}") for k, h in enumerate([1, 1, 2, 2, 3, 5])]
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))
    q = ledger.stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = ledger.hourly(spark.read.schema(ledger.SCHEMA).json(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, batch.collect()))
