"""Parts that SQL cannot express: folding, markup, ledgers, trees, budgets and numbers within groups, against plain Python."""

import datetime as dt
import html
import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from litloom.catalogue import helpers
from litloom.functions import documents as dx
from litloom.functions import identifiers as ix
from litloom.operators import resolve
from litloom.operators import windows as wx
from litloom.plans import columns as pc
from litloom.plans import query
from litloom.runtime import shared_folder
from litloom.sources import landing, wire


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_folding_and_markup(spark):
    texts = ["ﬁeld  ① Ａ\x07b", None, "  plain ", "é"]
    assert column(spark, texts, pc.nfkc) == [" ".join(unicodedata.normalize("NFKC", t or "").replace("\x07", " ").split()) for t in texts]
    marked = ["<jats:p>A &amp; b&#58; <i>c</i></jats:p>", None, "x &lt; y", "no markup"]
    assert column(spark, marked, wire.strip_markup) == ["A & b: c", "", html.unescape("x &lt; y"), "no markup"]


def test_last_word_has_a_place_that_two_claim(spark):
    df = spark.sql("select map('a', array(0, 2), 'b', array(1), 'c', array(2)) as m union all select cast(null as map<string,array<int>>)")
    assert sorted(r[0] for r in df.select(wire.reconstruct_abstract(F.col("m"))).collect()) == ["", "a b c"]


def test_bad_items_end_nothing(spark):
    rows = [("p", '{"title": "A", "year": "x1", "citationCount": 3}'), ("p", '{"title": "B", '), ("p", '{"year": 2001}'), ("p", "[]"), ("p", None), ("p", '{"paperId": 7}')]
    found = wire.normalized(spark.createDataFrame(rows, "page string, item string"), "semantic_scholar", keep=("page",))
    assert sorted(r.status for r in found.collect()) == ["bad", "bad", "bad", "discarded", "ok", "ok"]
    totals = spark.createDataFrame([("p", 9)], "page string, provider_total bigint")
    report = wire.page_report(found, totals, "page").collect()[0]
    assert (report.received_count, report.normalized_count, report.discarded_count, report.has_more, report.status) == (6, 2, 4, True, "partial")
    assert wire.page_report(found, totals.limit(0), "page").collect()[0].stop_reason == "pagination-unknown"


def test_secrets_paths_and_addresses(spark):
    args = [["--token", "--password", "x", "y"], ["--api-key=1", "z"], [], None]
    assert column(spark, args, ix.redacted_arguments, "array<string>") == [["--token", "[REDACTED]", "x", "y"], ["--api-key=[REDACTED]", "z"], [], None]
    paths = ["a/b.md", "../a", "/a", "c:/a", "a//b", "", None, " a"]
    assert column(spark, paths, ix.safe_path) == [True] + [False] * 7
    urls = ["https://a.example.org/x", "http://127.0.0.1/", "http://u:p@a.org", "ftp://a.org", "https://localhost", "http://10.1.2.3:80/", "http://a.org:99999/", "http://a.org:8080/", None]
    assert column(spark, urls, ix.public_url) == [True, False, False, False, False, False, False, True, False]


def test_identifiers(spark):
    texts = ["https://doi.org/10.1234/a(b)c).", "10.1234/x%2Fy]", "arXiv: 2101.00001v2", "PMID 77", "Plain  Text/"]
    assert column(spark, texts, ix.normalize_identifier) == ["doi:10.1234/a(b)c", "doi:10.1234/x/y", "arxiv:2101.00001v2", "pmid:77", "plain text"]
    assert column(spark, ["arxiv.org/abs/2101.00001v2", "10.1/x", None], ix.normalize_identity) == ["arxiv:2101.00001", "10.1/x", ""]
    assert column(spark, ["chains=EC-001, ec-002; basis=read", "chains=unknown; basis=x", "chains=EC-001; basis=none", None], ix.chain_ids) == [["EC-001", "EC-002"], None, None, None]


def test_evidence_windows(spark):
    as_of = F.lit("2024-06-30").cast("date")
    rows = column(spark, ["2020..2022", "2021-05:", None, "2022..2020", "..2024", "x", "2023..2025"], lambda c: ix.evidence_window(c, as_of))
    day = dt.date
    assert [(r.start, r.end, r.valid) for r in rows] == [
        (day(2020, 1, 1), day(2022, 12, 31), True), (day(2021, 5, 1), day(2024, 6, 30), True), (day(2019, 1, 1), day(2024, 6, 30), True), (day(2022, 1, 1), day(2020, 12, 31), False),
        (day(2019, 1, 1), day(2024, 6, 30), True), (None, day(2024, 6, 30), False), (day(2023, 1, 1), day(2025, 12, 31), False),
    ]


def test_plans_of_one_and_of_many_questions_agree(spark):
    questions = ["How does thermal stability affect hydrolysis kinetics?", "PMCID: 123 and arXiv:2101.00001", "柔性传感器 的 步态监测 方法", "", None]
    df = spark.createDataFrame(list(enumerate(questions)), "i int, q string")
    found = {}
    for r in pc.variants(df, "i", "q").collect():
        found.setdefault(r.i, []).append((r.position, r.variant, r.text))
    for i, q in enumerate(questions):
        rows = sorted(found[i])
        assert rows[0][1] == "original" and [p for p, _, _ in rows] == list(range(1, len(rows) + 1)) and len({t.casefold() for _, _, t in rows}) == len(rows)
        ids = query.identifiers(q or "")
        assert {v[len("identifier-") :]: t for _, v, t in rows if v.startswith("identifier-")} == ids
    assert ("lexicon-english", "flexible sensor sensor gait monitoring method") in {(v, t) for _, v, t in found[2]}


def test_numbers_within_hot_groups(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), k) for k in range(500)]
    rng.shuffle(rows)
    want, seen = {}, {}
    for g, k in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want[g, k] = seen[g]
    got = wx.numbered_within(spark.createDataFrame(rows, "g string, k int"), "g", ["k"], "n").collect()
    assert {(r.g, r.k): r.n for r in got} == want


def test_survivorship_is_ordered():
    claim = resolve.Claim
    held = None
    for value, provider in (("A", "openalex"), ("A", "crossref"), ("B", "europe_pmc"), ("C", "crossref"), ("D", "openalex")):
        held = resolve.preferred("title", held, claim(value, provider))
    assert held == claim("C", "crossref")
    assert resolve.preferred("authors", claim(("Ann",), "openalex"), claim(("ANN",), "crossref")).provider == "openalex"
    base = {c: None for c in resolve.COLUMNS} | {"provider": "x"}
    rows = [base | {"record_id": 1, "doi": "10.1/a"}, base | {"record_id": 2, "pmid": "7"}, base | {"record_id": 3, "doi": "10.1/A", "pmid": "7", "keywords": ["Sea", "ice", "ICE"]}]
    merged = resolve.fold(rows)
    assert [m.members for m in merged] == [[1, 2, 3]] and merged[0].lists["keywords"] == ["Sea", "ice"]


def test_trees_of_pages_and_articles():
    page = dx.read_html("<title>T</title><div class='share'><p>This paragraph belongs to the furniture of the page.</p></div><p>One <b>bold</b> paragraph that is long enough<br>to be kept.<table><tr><td>1</table>")
    assert page["title"] == "T" and page["tables"] == ["1"] and "One bold paragraph that is long enough to be kept." in page["text"] and "furniture" not in page["text"]
    assert dx.read_html(None) == {"title": "", "text": "", "authors": [], "date": "", "tables": []}
    article = dx.read_jats("<a xmlns='urn:x'><body><p>Before <i>it</i> and after.</p><p>More.</p></body></a>")
    assert article["sections"] == [("Body", "Before it and after.\n\nMore.")]


def test_landing(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_text("abc")
    files = landing.observed_files(spark, str(tmp_path / "f")).collect()
    assert [(r.path, r.size) for r in files] == [("a.txt", 3)] and files[0].sha256.startswith("ba7816bf")
    (tmp_path / "s.json").write_text('{"kind": "run", "x": 1}')
    (tmp_path / "d.json").write_text('{"x": 1, "x": 2}')
    assert landing.load_manifest(str(tmp_path / "s.json"), "run")["x"] == 1
    for call in (lambda: landing.load_spec(str(tmp_path / "d.json")), lambda: landing.load_manifest(str(tmp_path / "s.json"), "other")):
        with pytest.raises(ValueError):
            call()
    (tmp_path / "c.toml").write_text("[a]\nb = 2\n")
    assert landing.load_settings(str(tmp_path / "c.toml")) == {"a": {"b": 2}}
    requests = spark.createDataFrame([("get", "u1", None), ("get", "u2", None), ("get", "u3", "b")], "method string, url string, body string")
    keys = {r.url: r.key for r in requests.withColumn("key", landing.request_key(F.col("method"), F.col("url"), F.col("body"))).collect()}
    stored = spark.createDataFrame([(keys["u1"], "u1", '{"a": 1}', 1), (keys["u1"], "u1", '{"a": 2}', 2), (keys["u2"], "u2", "{broken", 1)], "key string, url string, answer string, stored_at int")
    landing.write_answers(stored, str(tmp_path / "cache"))
    hits = {r.url: (r.hit, r.answer) for r in landing.read_through(requests, spark.read.parquet(str(tmp_path / "cache"))).collect()}
    assert hits == {"u1": (True, '{"a": 2}'), "u2": (False, None), "u3": (False, None)}
    log = spark.createDataFrame([(1, ["--token", "t"])], "n int, args array<string>")
    for _ in range(2):
        landing.append_log(log, str(tmp_path / "log"), "args")
    assert [r.args for r in spark.read.json(str(tmp_path / "log")).collect()] == [["--token", "[REDACTED]"]] * 2
    papers = spark.createDataFrame([(1, "B", 2001, ["review"]), (2, "A", None, None)], "record_id bigint, title string, year int, publication_types array<string>")
    lines = [r.line for r in landing.packet_markdown(papers, "P").orderBy("line_no").collect()]
    assert lines == ["# P", "## other", "- A (n.d.)", "## review", "- B (2001)"]
    assert landing.save_packet({"papers": papers}, str(tmp_path / "packet")) == ["papers"] and spark.read.json(str(tmp_path / "packet" / "papers")).count() == 2
    np.savez(tmp_path / "f.npz", x=np.arange(2), y=np.arange(3), v=np.arange(12).reshape(2, 3, 2))
    field = landing.load_npz_field(spark, str(tmp_path / "f.npz"), "x", "y", "v", time=1, scale=0.5)
    assert {(r.x, r.y): r.value for r in field.collect()}[1.0, 2.0] == 5.5
    with pytest.raises(ValueError):
        landing.load_npz_field(spark, str(tmp_path / "f.npz"), "x", "y", "v")


def test_layers(spark):
    df = spark.range(1).select(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("x"), F.create_map(F.lit("b"), F.lit("3")).alias("y"), F.lit(None).cast("map<string,string>").alias("z"))
    assert df.select(helpers.merged_maps(F.col("x"), F.col("y"), F.col("z"))).first()[0] == {"a": "1", "b": "3"}


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    assert json.dumps(shared_folder(spark))
    from litloom import runtime

    monkeypatch.setattr(runtime, "_FOLDERS", {})

    class Context:
        applicationId, master = "app-1", "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session())


def test_service_as_a_data_source_and_chunks_as_a_table_function(spark, data):
    from litloom.sources.provider import register_extensions

    register_extensions(spark)
    path = f"{data}/paper_records.parquet"
    papers = spark.read.parquet(path)
    for service in ("openalex", "crossref"):
        read = spark.read.format("landed_service").option("service", service).option("path", path).load()
        got = {r[0] for r in read.where("year >= 2015 and citation_count >= 3").select("record_id").collect()}
        assert got == {r[0] for r in papers.where(f"provider = '{service}' and year >= 2015 and citation_count >= 3").select("record_id").collect()}
    texts = spark.createDataFrame([(1, "A sentence of a good length that is kept here. " * 30), (2, None)], "id int, text string")
    texts.createOrReplaceTempView("texts_to_pack")
    rows = spark.sql("select id, chunk_no, chunk from texts_to_pack, lateral packed_chunks(text, 500)").collect()
    assert [(r.id, r.chunk_no, r.chunk) for r in sorted(rows)] == [(1, k, c) for k, c in enumerate(dx.pack_paragraphs("A sentence of a good length that is kept here. " * 30, 500), 1)]


def test_profiles():
    from litloom.plans import profile

    found = profile.resolve("quick", {"requests": 90, "limit": 0})
    assert found.settings == {"max_requests": 48, "rows_per_request": 1, "target_references": 12} and len(found.clamps) == 2
    assert profile.budgets(2, {"zeta": 9, "alpha": -1}) == {"openalex": 2, "crossref": 2, "semantic_scholar": 2, "europe_pmc": 2, "alpha": 0, "zeta": 2}
    assert profile.filters({"open_access_only": 1, "fields_of_study": ("a",)})["fields_of_study"] == ["a"] and profile.filters(None)["after_date"] is None
    for bad in ({"x": 1}, {"limit": "3"}, {"limit": True}):
        with pytest.raises(ValueError):
            profile.overrides(bad)
    with pytest.raises(ValueError):
        profile.resolve("other")
    assert [v.name for v in profile.emergency_plan("q").variants] == ["original"]


def test_failing_backend_is_on_record(spark):
    from litloom.operators import rank

    papers = spark.createDataFrame([(1, 3.0), (2, 5.0), (3, 4.0)], "record_id bigint, x double")

    def broken(df):
        raise RuntimeError("no model")

    late = lambda df: df.select("record_id", F.raise_error(F.lit("late")).alias("score"))
    good = lambda df: df.select("record_id", F.col("x").alias("score"))
    other = lambda df: df.where("record_id < 3").select("record_id", (-F.col("x")).alias("score"))
    signals, failures = rank.semantic_signals(papers, {"broken": broken, "late": late, "good": good, "other": other})
    assert {r.record_id: r.semantic_score for r in signals.collect()} == {1: 0.5, 2: 0.5, 3: 0.5} and set(failures) == {"broken", "late"} and failures["broken"] == "RuntimeError"
    assert rank.semantic_signals(papers, {"broken": broken}) == (None, {"broken": "RuntimeError"})
