"""Numbers, cursors, joins over time and place, limits, lookups, details, table functions and stored runs, each against a plain version."""

import json
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import tables as table_functions
from lodestone.operators import asof, cite, limiter, lookups, numbering, project, retrieve, state
from lodestone.operators.identity import with_keys
from lodestone.plans import expression as ex
from lodestone.plans.planner import Channel
from lodestone.sources import records, tables

from .conftest import DATA


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_numbers_without_one_task(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 10**6) for _ in range(3000)]
    df = spark.createDataFrame([(v, f"r{i}") for i, v in enumerate(values)], "v int, ref string").repartition(7)
    out = numbering.numbered(df, "v", "ref")
    want = {r: n + 1 for n, (_, r) in enumerate(sorted((v, f"r{i}") for i, v in enumerate(values)))}
    assert {r["ref"]: r["n"] for r in out.collect()} == want
    cited = cite.citations(tables.papers(spark, str(DATA)), "gbt7714")
    assert "SinglePartition" not in plan_of(cited) and "Window" not in plan_of(cited)
    assert numbering.numbered(df.limit(0), "v").collect() == []


def test_pages_by_cursor_are_pages_by_number(spark):
    papers = tables.papers(spark, str(DATA))
    channel = Channel("q1", ex.term("title", "the"))
    whole = [r["ref"] for r in papers.where(ex.predicate(channel.expression)).orderBy(F.desc(F.coalesce("cited", F.lit(-1))), "ref").collect()]
    got, cursor, pages = [], "", 0
    while True:
        page = retrieve.grid_page(papers, channel, [], "citations", cursor=cursor, size=40)
        got += [r["ref"] for r in page.rows.orderBy("position").collect()]
        pages += 1
        assert (page.total, page.page, page.last_page) == (len(whole), pages, -(-len(whole) // 40))
        if page.exhausted:
            assert page.cursor == ""
            break
        cursor = page.cursor
    assert got == whole
    anew = retrieve.grid_page(papers, channel, [], "citations", page=2, size=40)  # no cursor: counted from the start
    assert [r["ref"] for r in anew.rows.orderBy("position").collect()] == whole[40:80] and anew.rows.agg(F.min("position")).first()[0] == 41
    with pytest.raises(ex.QueryError):
        retrieve.grid_page(papers, channel, [], "date", cursor=cursor or json.dumps({"of": "x"}), size=40)
    none = retrieve.grid_page(papers, Channel("q", ex.term("title", "no such word")), [])
    assert (none.total, none.last_page, none.exhausted, none.cursor, none.rows.count()) == (0, 0, True, "", 0)


def test_channels_are_one_scan(spark):
    papers = tables.papers(spark, str(DATA))
    channels = [Channel(f"q{i}", ex.term("title", w)) for i, w in enumerate(("the", "der", "la"))]
    out = retrieve.scan_all(papers, channels, ["the"])
    assert plan_of(out).count("Scan parquet") == 2 and "WindowGroupLimit" in plan_of(out)  # once in the tree, once in its list
    for c in channels:
        one = retrieve.scan(papers, c, ["the"])
        assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for r in out.where(F.col("channel") == c.id).collect())


def test_asof_join(spark):
    rng = random.Random(2)
    day = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    requests = [(i, rng.choice([None, 1, 1, 1, 2, 3]), rng.randint(0, 3000)) for i in range(600)]
    snapshots = [(i, rng.choice([None, 1, 1, 2]), rng.choice([None, rng.randint(0, 3000)])) for i in range(150)]
    r = spark.createDataFrame([(i, k, day(s)) for i, k, s in requests], "id long, k long, at string").withColumn("at", F.col("at").cast("timestamp")).repartition(5)
    s = spark.createDataFrame([(i, k, None if t is None else day(t)) for i, k, t in snapshots], "sid long, k long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for age in (None, 200):
        got = {x["id"]: x["snapshot"] and x["snapshot"]["sid"] for x in asof.asof_join(r, s, "k", "at", "ts", "sid", age).collect()}
        want = {}
        for i, k, at in requests:
            before = [(t, sid) for sid, sk, t in snapshots if k is not None and sk == k and t is not None and t <= at]
            last = max(before, default=None)
            want[i] = last[1] if last and (age is None or at - last[0] <= age) else None
        assert got == want


def test_intervals_that_overlap(spark):
    rng = random.Random(3)
    make = lambda n: [(i, rng.choice([1, 1, 2, None]), a := rng.randint(-50, 300), a + rng.choice([0, 1, 5, 40, 200])) for i in range(n)]
    a, b = make(80), make(60)
    schema = "id int, k int, s long, e long"
    out = asof.overlapping(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", ("s", "s"), ("e", "e"), 32)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and max(x[2], y[2]) < min(x[3], y[3]))
    assert sorted((r["a"]["id"], r["b"]["id"]) for r in out.collect()) == want
    assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out)


def simulated(rows, interval):
    """(backoff, start) of one lane's (at, slow) by a clock."""
    out, ready, backoff = [], float("-inf"), 1.0
    for at, slow in rows:
        begin = max(at, ready)
        ready = begin + interval * backoff
        out.append((backoff, begin))
        backoff = min(8.0, max(2.0, backoff * 2)) if slow else max(1.0, backoff * 0.9)
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_spacing_with_backoff(spark, monkeypatch, block):
    monkeypatch.setattr(limiter, "BLOCK", block)
    rng = random.Random(4)
    lanes = {name: sorted((rng.randint(0, 60_000), i) for i in range(n)) for name, n in (("hot", 400), ("b", 30), ("c", 1))}
    rows = [(name, at, i, rng.random() < 0.2) for name, own in lanes.items() for at, i in own]
    df = spark.createDataFrame(rows, "lane string, at_ms long, id long, slow boolean").repartition(6)
    got = {(r["lane"], r["id"]): (r["backoff"], r["start_ms"]) for r in limiter.starts(df, 300, order=["at_ms", "id"]).collect()}
    assert len(got) == len(rows)
    for name in lanes:
        own = [r for r in rows if r[0] == name]
        for (_, _, i, _), (backoff, begin) in zip(own, simulated([(r[1], r[3]) for r in own], 300), strict=True):
            assert got[name, i][0] == pytest.approx(backoff) and abs(got[name, i][1] - begin) <= 1
    assert limiter.starts(df.limit(0), 300).collect() == []


def test_given_requests_start_as_a_clock_says(spark):
    from lodestone.plans import catalogue

    events = tables.table(spark, str(DATA), "events").select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at")).collect()
    got = {r["event_id"]: (r["backoff"], r["start_ms"]) for r in catalogue.QUERIES["rate_limits"](spark, str(DATA)).collect()}
    assert len(got) == len(events)
    for kind in {e["event_type"] for e in events}:
        own = sorted((e["at"], e["event_id"]) for e in events if e["event_type"] == kind)
        for (_, i), (backoff, begin) in zip(own, simulated([(at, i % 7 == 0) for at, i in own], 500), strict=True):
            assert got[i][0] == pytest.approx(backoff, abs=1e-6) and abs(got[i][1] - begin) <= 1


def test_backoff_maps_compose():
    rng = random.Random(5)
    for _ in range(200):
        flags, f, b = [rng.random() < 0.3 for _ in range(rng.randint(0, 30))], (1.0, 0.0, limiter.MOST), rng.uniform(1, 8)
        now = b
        for s in flags:
            f = limiter.composed(f, limiter.SLOW_MAP if s else limiter.FAST_MAP)
            now = limiter.slower(now) if s else limiter.faster(now)
        assert limiter.applied(f, b) == pytest.approx(now)


def test_a_stream_is_limited_and_held(spark, tmp_path):
    events = [
        [("a", 0, "request", "1"), ("a", 10, "request", "2"), ("a", 20, "slow", ""), ("b", 5, "request", "x")],
        [("a", 30, "request", "3"), ("a", 40, "request", "4"), ("a", 50, "hold", ""), ("a", 60, "request", "5")],
        [("a", 5000, "release", ""), ("a", 5001, "request", "6"), ("a", 5002, "fast", ""), ("b", 6000, "request", "y")],
    ]
    schema = "lane string, at_ms long, kind string, request_id string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n in range(3):
            spark.createDataFrame(events[n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = limiter.limited(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 100)
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination(200)
        got = {(r["lane"], r["request_id"]): r["start_ms"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {("a", "1"): 0, ("a", "2"): 100, ("b", "x"): 5, ("a", "3"): 200, ("a", "4"): 400, ("a", "5"): 5100, ("a", "6"): 5300, ("b", "y"): 6000}


def test_failed_lookups_are_remembered_for_an_hour(spark, tmp_path):
    at = lambda t: F.lit(f"2024-01-01 {t}").cast("timestamp")
    misses = lookups.Misses(state.Store(spark, str(tmp_path / "store")))
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "key string")
    ask = lambda t, known=None: sorted(r["key"] for r in misses.ask(asked, at(t), known).collect())
    assert ask("09:00:00") == ["a", "b", "c"]
    outcomes = spark.createDataFrame([("a", "2024-01-01 09:00:00", True), ("b", "2024-01-01 09:00:00", True), ("b", "2024-01-01 09:10:00", False)], "key string, at string, failed boolean")
    misses.record(outcomes.withColumn("at", F.col("at").cast("timestamp")))
    assert ask("09:59:59") == ["b", "c"] and ask("10:00:00") == ["a", "b", "c"]
    assert ask("09:30:00", spark.createDataFrame([("c",)], "key string")) == ["b"]
    misses.prune(at("12:00:00"))
    assert misses.table().count() == 0


def test_one_checked_detail_for_each_paper(spark):
    papers = spark.createDataFrame([("a", "T", "10.1/x", "old"), ("b", "U", "", ""), ("c", "V", "", "own")], "ref string, title string, doi string, abstract string")
    details = spark.createDataFrame([("a", "T", "10.1/y", "foreign", 1), ("b", "u", "10.1/z", "first", 1), ("b", "U", "10.1/z", "second", 2), ("c", "V", "", "", 1)], "ref string, title string, doi string, abstract string, detail_at int")
    got = {r["ref"]: (r["abstract"], r["doi"], r["detail_error"]) for r in project.bind_details(papers, details).collect()}
    assert got == {"a": ("old", "10.1/x", "IDENTITY_CONFLICT"), "b": ("second", "10.1/z", None), "c": ("own", "", None)}
    assert project.with_details(papers, details).count() == 3


def test_listed_rows_are_read_once(spark, tmp_path, monkeypatch):
    source, write, done = str(tmp_path / "keyed"), project.written, []
    rows = [(f"r{i}", f"Title {i // 2}", f"10.1/{i}" if i % 3 else "", "", "", "") for i in range(12)]
    spark.createDataFrame(rows, "ref string, title string, doi_key string, native_key string, dbcode string, bib_key string").write.parquet(source)

    def gone(df, name):
        out = write(df, name)
        done.append(name)
        if len(done) == 2:
            shutil.rmtree(source)  # what is read again fails
        return out

    monkeypatch.setattr(project, "written", gone)
    p = spark.read.parquet(source)
    got = {r["ref"]: (r["found"], r["error"]) for r in project.located(p, p).collect()}
    assert got == {f"r{i}": (f"r{i}", None) if i % 3 else (None, "IDENTITY_AMBIGUOUS") for i in range(12)}


def test_papers_are_located_by_title_and_identity(spark):
    schema = "ref string, title string, authors array<string>, source string, year int, doi string, dbname string, filename string, dbcode string"
    papers = [("a", "T", ["A"], "S", 2020, "10.1/x", "", "", ""), ("b", "T", [], "", 0, "", "", "", ""), ("c", "Q", ["A"], "S", 2020, "10.1/q", "", "", ""), ("d", "W", [], "", 0, "10.1/w", "", "", ""), ("e", "Only", [], "", 0, "", "", "", "")]
    rows = [("1", "t", [], "", 0, "doi:10.1/X", "", "", ""), ("2", "T", [], "", 0, "10.1/other", "", "", ""), ("3", "W", [], "", 0, "10.1/w", "", "", ""), ("4", "w", [], "", 0, "10.1/W", "", "", ""), ("5", "ONLY", [], "", 0, "10.1/o", "", "", "")]
    out = project.located(with_keys(spark.createDataFrame(papers, schema)), with_keys(spark.createDataFrame(rows, schema)))
    assert {r["ref"]: (r["found"], r["error"]) for r in out.collect()} == {
        "a": ("1", None), "b": (None, "IDENTITY_AMBIGUOUS"), "c": (None, "DOCUMENT_NOT_FOUND"), "d": (None, "IDENTITY_AMBIGUOUS"), "e": ("5", None),
    }


@pytest.mark.parametrize("label,want", [("收录：SCI-Expanded", []), ("收录：EI来源期刊a", []), ("收录：SCI-E", ["SCI-E"]), ("收录：SCI，EI来源期刊", ["SCI", "EI来源期刊"]), ("SCI EI", ["SCI", "EI"]), ("XSCI", []), ("about SCI", []), ("CSSCI来源期刊", ["CSSCI来源期刊"])])
def test_tiers_are_whole_words(label, want):
    assert records.tiers_of(label) == want


GRID = '<table class="result-table-list"><tbody>{}</tbody></table>'
ROW = '<tr><td class="name"><a href="/kcms/{n}">Title {n}</a></td><td class="author"><a>A{n}</a></td><td class="source">S</td><td class="date">2020-01-0{n}</td><td class="data">期刊</td><td class="quote">{n}</td></tr>'


def test_table_functions_in_sql(spark):
    table_functions.register(spark)
    pages = spark.createDataFrame([(1, GRID.format(ROW.format(n=1) + ROW.format(n=2)), "https://example.org/x"), (2, None, None), (3, "<p>none</p>", "")], "page_id int, html string, url string")
    rows = spark.sql("SELECT p.page_id, g.pos, g.title, g.authors, g.year, g.cited FROM {p} p, LATERAL read_grid(p.html, p.url) g", p=pages).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "Title 1", ["A1"], 2020, 1), (1, 1, "Title 2", ["A2"], 2020, 2)]
    texts = spark.createDataFrame([(1, "See 《One》 and 《Two《in》》, not `《code》`."), (2, None)], "id int, text string")
    marked = spark.sql("SELECT t.id, m.start, m.end, m.title FROM {t} t, LATERAL marked_titles(t.text) m", t=texts).collect()
    assert sorted(map(tuple, marked)) == [(1, 4, 9, "One"), (1, 14, 23, "Two《in》")]
    pages = tables.table(spark, str(DATA), "pages")
    want = {(r["page_id"], r["title"], r["offset"]) for r in __import__("lodestone.sources.html", fromlist=["x"]).parsed(pages).select("page_id", F.inline("sections").alias("level", "title", "offset")).collect()}
    got = spark.sql("SELECT p.page_id, s.title, s.offset FROM {p} p, LATERAL page_sections(p.html, p.url) s", p=pages).collect()
    assert {tuple(r) for r in got} == want


def test_a_run_is_resumed_by_another_engine(spark, tmp_path):
    p = tables.papers(spark, str(DATA))
    bare, quality = p.withColumn("abstract", F.lit("")), tables.source_quality(spark, str(DATA))
    details = p.select("ref", "title", "abstract", F.lit(1).alias("parser"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("detail_at"))
    engine = lambda: Engine(spark, bare, quality, str(tmp_path / "e"), details=details)
    asked = {"concept_groups": [["tion", "ment"], ["the", "der"]], "as_of": "2026-06-01 00:00:00"}
    first = engine()
    stopped = first.search(**asked, budget=20)
    assert stopped.operation.status == "partial"
    other = engine()  # as after a restart
    (view,) = other.operations()
    assert view["status"] == "partial" and view["next"] == "resume(search_id)" and view["active_seconds"] > 0
    whole = other.resume(stopped.search_id, 500)
    once = Engine(spark, bare, quality, None, details=details).search(**asked, budget=520)
    columns = ("ref", "rank", "score", "eligible", "selected")
    assert whole.operation.status == "completed" and whole.operation.used >= once.operation.used
    assert sorted(map(tuple, whole.entries.select(*columns).collect())) == sorted(map(tuple, once.entries.select(*columns).collect()))
    with pytest.raises(ex.QueryError):
        engine().resume(stopped.search_id)  # it is finished
    manifest = json.loads((Path(tmp_path) / "e" / "runs" / stopped.search_id / "manifest.json").read_text())
    assert engine().prune_operations(manifest["saved_at"] + 6 * 86_400) == 0 and engine().prune_operations(manifest["saved_at"] + 8 * 86_400) == 1
    assert engine().operations() == []


def test_json_files_are_replaced_whole(spark, tmp_path):
    for value in ({"a": 1}, {"b": "é"}):
        state.write_json(spark, str(tmp_path / "j"), "state.json", value)
        assert json.loads((tmp_path / "j" / "state.json").read_text()) == value
    assert [x.name for x in (tmp_path / "j").iterdir() if not x.name.endswith(".crc")] == ["state.json"]
