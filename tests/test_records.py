"""Identity, merging, citations, links, paging, pages, state and the engine."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import text as tx
from lodestone.operators import cite, identity, links, project, resolution, state
from lodestone.plans import expression as ex
from lodestone.sources import html, tables
from lodestone.streaming import upsert

from .conftest import DATA

FIELDS = "ref string, title string, authors array<string>, source string, year int, doi string, dbname string, dbcode string, filename string"
BASE = {"ref": "a", "title": "On C++: a study", "authors": ["Ann B"], "source": "J (X)", "year": 2020, "doi": "", "dbname": "", "dbcode": "", "filename": ""}


@pytest.mark.parametrize(
    ("other", "same", "detail"),
    [
        ({}, True, True), ({"title": "ON C++ ： a  study".replace("：", ":"), "source": "j (x)"}, True, True), ({"title": "On C#: a study"}, False, False), ({"authors": ["Bob"]}, False, False),
        ({"year": 2021}, False, True), ({"source": ""}, False, True), ({"doi": "10.1/x"}, True, True),
    ],
)
def test_identity_pairs(spark, other, same, detail):
    names = FIELDS.replace("string", "").replace("array<>", "").replace("int", "").replace(",", "").split()
    rows = [tuple(BASE[n] for n in names), tuple({**BASE, "ref": "b", **other}[n] for n in names)]
    df = identity.with_keys(spark.createDataFrame(rows, FIELDS))
    a, b = df.where("ref = 'a'").select(F.struct("*").alias("a")), df.where("ref = 'b'").select(F.struct("*").alias("b"))
    got = a.join(b).select(identity.same_paper("a", "b").alias("s"), identity.detail_matches("a", "b").alias("d")).first()
    assert (got.s, got.d) == (same, detail)


def test_conflicts_veto(spark, tmp_path):
    rows = [("a", "T", ["A"], "S", 2020, "10.1/x", "D", "CJ", "f1"), ("b", "T", ["A"], "S", 2020, "https://doi.org/10.1/Y", "D", "cj", "f1"), ("c", "T", ["A"], "S", 2020, "DOI:10.1/X", "", "", ""), ("d", "T", ["A"], "S", 2020, "", "d", "ZZ", "F1")]
    df = identity.with_keys(spark.createDataFrame(rows, FIELDS))
    assert sorted(tuple(r) for r in identity.same_pairs(df).collect()) == [("a", "c", "pair"), ("c", "d", "pair")]
    seq = df.withColumn("seq", F.ascii("ref").cast("long"))
    papers = resolution.PaperStore(state.Store(spark, str(tmp_path / "store")))
    assert {r.seq: r.ref for r in papers.upsert(seq).collect()} == {97: "a", 98: "b", 99: "a", 100: "d"}


def test_listing_never_overrides_detail(spark):
    o = spark.createDataFrame([("r", 1, False, "old", ["A"], "S", 2019, "", 1, ""), ("r", 2, True, "detail", ["A", "B"], "S2", 2020, "abs", None, "d"), ("r", 3, False, "late", ["Z"], "S3", 2021, "", 7, "")],
        "ref string, seq int, is_detail boolean, title string, authors array<string>, source string, year int, abstract string, cited long, doi string")
    r = identity.merge_observations(o).first()
    assert (r.title, r.authors, r.source, r.year, r.abstract, r.cited, r.doi) == ("detail", ["A", "B"], "S2", 2020, "abs", 7, "d")


PAPERS = [
    ("journal", "Graphs {and} trees & more_1", ["Li Wei", "Ann Lee"], "J. Graphs", 2021, "期刊论文", "An abstract.", ["graph", "tree"], 5, "10.1/a", "https://example.org/a(1)", "12", "3", "10-20"),
    ("thesis", "Deep [things]", ["Bo"], "Some University", 2019, "博士论文", "", [], None, "", "", "", "", ""),
    ("unknown", "=SUM(A1)", [], "", 0, "", "", [], None, "", "", "", "", ""),
]
GOLDEN = {
    "gbt7714": ["[1] Li Wei, Ann Lee. Graphs {and} trees & more_1[J]. J. Graphs, 2021, 12(3): 10-20.", "[2] Bo. Deep [things][D]. Some University, 2019.", "[3] [作者未取得]. =SUM(A1)[Z]. [来源未取得], [年份未取得]."],
    "apa": ["Li Wei, Ann Lee. (2021). Graphs {and} trees & more_1. J. Graphs, 12(3): 10-20.", "Bo. (2019). Deep [things]. Some University.", "[作者未取得]. ([年份未取得]). =SUM(A1). [来源未取得]."],
    "mla": ["Li Wei, Ann Lee. “Graphs {and} trees & more_1.” J. Graphs, 2021, 12(3): 10-20.", "Bo. “Deep [things].” Some University, 2019.", "[作者未取得]. “=SUM(A1).” [来源未取得], [年份未取得]."],
    "chicago": ["Li Wei, Ann Lee. “Graphs {and} trees & more_1.” J. Graphs (2021): 12(3): 10-20.", "Bo. “Deep [things].” Some University (2019).", "[作者未取得]. “=SUM(A1).” [来源未取得] ([年份未取得])."],
    "vancouver": ["1. Li Wei, Ann Lee. Graphs {and} trees & more_1. J. Graphs. 2021;12(3): 10-20.", "2. Bo. Deep [things]. Some University. 2019.", "3. [作者未取得]. =SUM(A1). [来源未取得]. [年份未取得]."],
    "bibtex": [
        "@article{journal,\n  author = {{Li Wei} and {Ann Lee}},\n  title = {Graphs \\{and\\} trees \\& more\\_1},\n  year = {2021},\n  volume = {12},\n  number = {3},\n  pages = {10-20},\n  abstract = {An abstract.},\n  keywords = {graph; tree},\n  doi = {10.1/a},\n  url = {https://example.org/a(1)},\n  journal = {J. Graphs},\n}",
        "@phdthesis{thesis,\n  author = {{Bo}},\n  title = {Deep [things]},\n  year = {2019},\n  school = {Some University},\n}", "@misc{unknown,\n  title = {=SUM(A1)},\n}",
    ],
    "ris": ["TY  - JOUR\nTI  - Graphs {and} trees & more_1\nAU  - Li Wei\nAU  - Ann Lee\nJO  - J. Graphs\nPY  - 2021\nVL  - 12\nIS  - 3\nSP  - 10\nEP  - 20\nDO  - 10.1/a\nUR  - https://example.org/a(1)\nAB  - An abstract.\nKW  - graph\nKW  - tree\nER  -",
        "TY  - THES\nTI  - Deep [things]\nAU  - Bo\nJO  - Some University\nPY  - 2019\nER  -", "TY  - GEN\nTI  - =SUM(A1)\nER  -"],
    "endnote": ["%0 Journal Article\n%T Graphs {and} trees & more_1\n%A Li Wei\n%A Ann Lee\n%J J. Graphs\n%D 2021\n%V 12\n%N 3\n%P 10-20\n%R 10.1/a\n%U https://example.org/a(1)\n%X An abstract.\n%K graph\n%K tree", "%0 Thesis\n%T Deep [things]\n%A Bo\n%J Some University\n%D 2019", "%0 Generic\n%T =SUM(A1)"],
    "markdown": ["- [Graphs {and} trees & more_1](https://example.org/a(1))", "- Deep \\[things\\]", "- =SUM(A1)"],
    "csv": ["Graphs {and} trees & more_1,Li Wei; Ann Lee,J. Graphs,2021,12,3,10-20,10.1/a,https://example.org/a(1)", "Deep [things],Bo,Some University,2019,,,,,", "'=SUM(A1),,,,,,,,"],
}


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(PAPERS, tables.PAPER)


@pytest.mark.parametrize("style", sorted(GOLDEN))
def test_citations(papers, style):
    assert [r.text for r in cite.citations(papers, style).orderBy("n").collect()] == GOLDEN[style]


def test_structured_citations(papers):
    item = json.loads(cite.citations(papers, "csl-json").where("ref = 'journal'").first().text)
    assert item["type"] == "article-journal" and item["issued"] == {"date-parts": [[2021]]} and item["author"] == [{"literal": "Li Wei"}, {"literal": "Ann Lee"}]
    assert "DOI" not in json.loads(cite.citations(papers, "csl-json").where("ref = 'thesis'").first().text)
    assert {r.ref: r.missing_fields for r in cite.citations(papers).collect()} == {"journal": "", "thesis": "", "unknown": "authors,source,year"}
    assert cite.citations(papers, "custom", "{{{year}}} {title} {type}").where("n = 2").first().text == "{2019} Deep [things] 博士论文"
    for template in ("{nope}", "{title", "a}b", "x" * 5001, "a\0"):
        with pytest.raises(ex.QueryError):
            cite.custom(template)
    with pytest.raises(ex.QueryError):
        cite.citation("docx")
    assert cite.joined(cite.citations(papers, "csv"), "csv").first().text.startswith("title,authors,source,year,volume,issue,pages,doi,url\r\nGraphs")


def test_bib_text(spark):
    texts = ["\\", "a\\{b", "{}%&#_$", "\\\\&"]
    got = [r.t for r in spark.createDataFrame([(x,) for x in texts], "x string").select(tx.bib_text("x").alias("t")).collect()]
    one = str.maketrans({"\\": r"\textbackslash{}", **{c: f"\\{c}" for c in "{}%&#_$"}})
    assert got == [x.translate(one) for x in texts]


def test_link_spans(spark, papers):
    text = "See 《Deep [things]》, 《A《B》C》, `《code》` ``《x`《y》`` [《l》](u) 《=SUM(A1)》 and 《Graphs {and} trees & more_1》 《open"
    assert [t for _, _, t in links.reference_spans(text)] == ["Deep [things]", "A《B》C", "=SUM(A1)", "Graphs {and} trees & more_1"]
    engine = Engine(spark, papers)
    out, found = engine.link_references(text)
    assert [r.status for r in found.collect()] == ["matched_without_link", "unresolved", "matched_without_link", "linked"]
    assert "[《Graphs {and} trees & more_1》](https://example.org/a%281%29)" in out and out.startswith("See 《Deep [things]》, 《A《B》C》, `《code》`")


def test_text_pages_and_sections(spark):
    docs = spark.createDataFrame([(1, "é" * 9000), (2, ""), (3, "x" * 8000)], "i int, text string")
    assert sorted((r.i, r.offset, len(r.page), r.next_offset) for r in project.text_pages(docs).collect()) == [(1, 0, 8000, 8000), (1, 8000, 1000, None), (2, 0, 0, None), (3, 0, 8000, None)]
    s = spark.createDataFrame([("s", 1, 0, 100), ("s", 2, 10, 100), ("s", 2, 30, 100), ("s", 1, 60, 100)], "snapshot_id string, level int, offset long, total long")
    assert sorted((r.offset, r.length) for r in project.section_lengths(s).collect()) == [(0, 58), (10, 18), (30, 28), (60, 40)]


PAGE = """<html><head><title>A &amp; B</title><style>p{}</style><script>var x='<p>no</p>'</script></head><body><h1>One<p>Body <b>bold
<p hidden>secret</p><p style="display:none">gone</p><h2>Two</h2><ul><li>item<li>next</ul><a href="/x?y=1">link</a><!-- c --></body>"""


def test_html_pages(spark):
    r = html.parsed(spark.createDataFrame([(1, "https://example.org/d/e", PAGE), (2, None, None)], "page_id long, url string, html string")).where("page_id = 1").first()
    assert r.title == "A & B" and r.links == ["https://example.org/x?y=1"]
    assert r.text.split("\n\n") == ["One", "Body bold", "Two", "item", "next", "link"]
    assert [(s.level, s.title, s.offset) for s in r.sections] == [(1, "One", 0), (2, "Two", 16)]
    assert r.text[16:19] == "Two"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.tokens(F.lit("C++ node.js 图像识别 a_b"))) == ["c", "node.js", "a_b", "图像", "像识", "识别"]
    assert one(tx.unique_strings(F.array(*map(F.lit, (" A", "a ", "", "B", "b  "))))) == ["A", "B"]
    assert one(tx.source_key(F.lit("J　（X）。."))) == "j (x)"
    assert one(tx.title_key(F.lit(" A ： B"))) == "a：b"
    assert one(tx.public_url(F.lit("https://evil.org/abstract/1"))) == ""
    names = {"con.txt": "论文_con.txt", "com0": "com0", "COM1": "论文_COM1", "a\x7fb/c": "a\x7fb_c", " .": "论文_", "x" * 74 + ". y": "x" * 74 + "."}
    assert {k: one(tx.safe_file_name(F.lit(k))) for k in names} == names
    assert one(tx.json_string(F.lit('a"b\\c<&>\x01\n'))) == '"a\\"b\\\\c\\u003c\\u0026\\u003e\\u0001\\n"'
    assert one(tx.author_names(F.array(F.lit("Li(文)"), F.lit("Li （主编）"), F.lit("Bo3")))) == ["Li", "Bo3"]
    assert one(tx.parse_count(F.lit("x"))) is None


def test_state(spark, tmp_path):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("k", "2024-01-14 23:55:00", 1), ("k", "2024-01-14 23:59:00", 2), ("k", "2024-01-14 20:00:00", 3)], "cache_key string, t string, v int").withColumn("ts", F.col("t").cast("timestamp"))
    assert state.cached_search(df, "k", now).first().v == 2
    assert state.newest(df, "cache_key").first().v == 2
    store = state.Store(spark, str(tmp_path / "root"))
    assert store.read("t") is None
    store.append("t", df)
    store.append("t", df)
    assert store.read("t").count() == 6 and store.versions("t") == [] and len(store.batches("t")) == 2
    store.append("t", df, "named")
    store.append("t", df, "named")
    assert store.read("t").count() == 9
    store.compact("t")
    assert store.read("t").count() == 9 and store.versions("t") == [1] and store.batches("t") == []
    store.append("t", df, "named")
    assert store.read("t").count() == 9
    store.write("t", df)
    assert store.read("t").count() == 3
    spark.createDataFrame([(99,)], "version int").write.json(str(tmp_path / "foreign" / "schema"))
    with pytest.raises(ex.QueryError):
        state.Store(spark, str(tmp_path / "foreign"))
    op = state.Operation("search", budget=2)
    op.charge(2)
    with pytest.raises(RuntimeError):
        op.charge()
    assert op.status == "interrupted"


def test_engine(spark, tmp_path):
    p = tables.papers(spark, str(DATA))
    engine = Engine(spark, p, tables.source_quality(spark, str(DATA)), str(tmp_path / "engine"))
    found = engine.search(concept_groups=[["tion", "ment"], ["the", "der"]], as_of="2024-01-15 00:00:00")
    total = found.summary()
    assert total["candidates"] > total["eligible"] >= total["selected"] > 0
    page = engine.results(found, "selected", 0, 5)
    assert page.count() == 5 and page.columns[:2] == ["ref", "rank"]
    again = engine.search(concept_groups=[["tion", "ment"], ["the", "der"]], as_of="2024-01-15 00:05:00")
    assert again.search_id == found.search_id and again.operation.status == "cached"
    assert engine.search(concept_groups=[["tion", "ment"], ["the", "der"]], as_of="2024-01-15 01:00:00").search_id != found.search_id
    assert [r.ref for r in engine.results(found.search_id, "selected", 0, 5).collect()] == [r.ref for r in page.collect()]
    refs = [r.ref for r in page.collect()]
    assert [r.ref for r in engine.get_metadata(refs[::-1] + ["nope"], fields=["doi"]).collect()] == refs[::-1]
    assert engine.export(refs, "ris").first()["count"] == 5
    engine.export(refs, "bibtex", path=str(tmp_path / "out"))
    structured = engine.search(expression=ex.term("title", "the"))
    assert structured.summary()["eligible"] == structured.summary()["candidates"]
    for bad in (lambda: engine.results("cs_nope"), lambda: engine.get_metadata(titles=["no such title"]), lambda: engine.results(found, limit=101)):
        with pytest.raises(ex.QueryError):
            bad()


def test_engine_reads_sections(spark, papers):
    snaps = spark.createDataFrame([("r", 1, "old", []), ("r", 2, "Intro\n\nbody of it\n\nEnd\n\nlast", [(1, "Intro", 0, 17), (1, "End", 19, 9)])], "ref string, ts int, text string, sections array<struct<level:int,title:string,offset:long,length:long>>")
    engine = Engine(spark, papers)
    assert engine.read(snaps, "r", section=" end ").first().text == "End\n\nlast"
    r = engine.read(snaps, "r", offset=2, limit=5).first()
    assert (r.text, r.next_offset, r.total_characters) == ("tro\n\n", 7, 28)
    with pytest.raises(ex.QueryError):
        engine.read(snaps, "r", section="none")


def test_streaming_upsert(spark, tmp_path):
    o = tables.observations(spark, str(DATA))
    for seq in (1, 2, 3):
        o.where(F.col("seq") == seq).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = state.Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert.run_upserts(stream, store, str(tmp_path / "check")).awaitTermination(300)
    columns = ("ref", "title", "source", "year", "abstract", "cited")
    want = {tuple(r) for r in identity.merge_observations(o).select(*columns).collect()}
    assert {tuple(r) for r in upsert.merged_papers(store).select(*columns).collect()} == want


def test_components_of_a_long_chain(spark):
    n = 300
    order = [(7 * i) % n for i in range(n)]  # neighbours in the chain are far apart in seq
    rows = [(s, f"r{s}", f"N{i // 2}", f"D{(i + 1) // 2}", "", "") for i, s in enumerate(order)]
    df = spark.createDataFrame(rows, "seq long, ref string, native_key string, doi_key string, bib_key string, dbcode string")
    links = df.select(F.col("seq").alias("node"), F.explode(identity.identity_keys()).alias("key"))
    assert {r.node: r.component for r in resolution.labelled(links).collect()} == {s: 0 for s in order}


def test_replayed_batches_change_nothing(spark, tmp_path):
    o = tables.observations(spark, str(DATA))
    store = state.Store(spark, str(tmp_path / "store"))
    for seq in (1, 2, 2, 1, 3):
        upsert.upsert(store, o.where(F.col("seq") == seq), f"b{seq}")
    columns = ("ref", "title", "source", "year", "abstract", "cited")
    want = {tuple(r) for r in identity.merge_observations(o).select(*columns).collect()}
    assert store.read("observations").count() == o.count()
    upsert.compact(store)
    assert {tuple(r) for r in upsert.merged_papers(store).select(*columns).collect()} == want
    ref = o.first().ref
    store.update("papers", "ref", ref, lambda row: row.withColumn("title", F.lit("new")))
    assert [r.title for r in upsert.merged_papers(store).where(F.col("ref") == ref).collect()] == ["new"]


def test_links_survive_a_conflicting_first_record(spark):
    """a and b share a DOI with c, a conflicts with both by database: b-c stays."""
    rows = [("a", "", "D", "x", ""), ("b", "", "D", "y", ""), ("c", "", "D", "y", ""), ("d", "N", "", "", "B"), ("e", "M", "", "", "B"), ("f", "", "", "", "B"), ("g", "", "", "z", ""), ("h", "", "", "z", "")]
    df = spark.createDataFrame(rows, "ref string, native_key string, doi_key string, dbcode string, bib_key string")
    assert {(r.a, r.b, r.kind) for r in identity.same_pairs(df).collect()} == {("b", "c", "member"), ("d", "f", "pair"), ("e", "f", "pair")}
    assert {r.ref: r.n for r in identity.link_counts(df).collect()} == {"b": 1, "c": 1, "d": 1, "e": 1, "f": 2}


def test_search_phases_budget_and_resume(spark, tmp_path):
    p = tables.papers(spark, str(DATA))
    bare = p.withColumn("abstract", F.lit(""))
    details = p.select("ref", "title", "abstract", F.lit(1).alias("parser"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("detail_at"))
    engine = Engine(spark, bare, tables.source_quality(spark, str(DATA)), str(tmp_path / "e"), details=details)
    asked = {"concept_groups": [["tion", "ment"], ["the", "der"]]}
    stopped = engine.search(**asked, as_of="2026-06-01 00:00:00", budget=20)  # the details are too old to be free
    assert stopped.operation.status == "partial" and stopped.operation.done == ["retrieve", "pool"] and stopped.operation.used <= 20
    assert stopped.output(bare)["operation"]["errors"] == [{"code": "BUDGET_EXHAUSTED"}]
    whole = engine.resume(stopped.search_id, 500)
    assert whole.operation.status == "completed" and whole.search_id == stopped.search_id
    assert whole.operation.done == ["retrieve", "pool", "enrich", "feedback", "enrich_feedback", "rank"]
    n = whole.summary()["candidates"]
    assert whole.operation.used > 20 and n >= whole.summary()["eligible"]
    fresh = engine.search(**asked, as_of="2024-01-15 00:00:00")
    assert fresh.operation.used < whole.operation.used  # details read lately cost nothing
    shown = fresh.output(p, limit=3)
    assert len(shown["rows"]) <= 3 and shown["plan"]["channels"]["rows"][0][0] == "q1" and "abstract" not in shown["fields"]
    for bad in (lambda: engine.resume("cs_nope"), lambda: whole.operation.resumed()):
        with pytest.raises(ex.QueryError):
            bad()


def test_details_of_another_paper_are_refused(spark):
    papers = spark.createDataFrame([("a", "One", "", ["x"]), ("b", "Two", "kept", [])], "ref string, title string, abstract string, keywords array<string>")
    details = spark.createDataFrame([("a", " ONE", "new", ["k"]), ("b", "Other", "lost", ["k"])], "ref string, title string, abstract string, keywords array<string>")
    assert {r.ref: (r.abstract, r.keywords) for r in project.with_details(papers, details).collect()} == {"a": ("new", ["k"]), "b": ("kept", [])}


def test_quality_view(spark):
    rows = [("a", "J", "J.", ["EI"], 2.5, None, 2023, "present"), ("b", "J", "K", [], None, None, 0, "unknown"), ("c", "J", "", [], None, None, 0, "unknown"), ("d", "J", "", [], None, None, 0, None)]
    df = spark.createDataFrame(rows, "ref string, source string, canonical string, tiers array<string>, composite double, aggregate double, metric_year int, state string")
    got = {r.ref: r.quality and json.loads(r.quality) for r in project.quality_view(df).collect()}
    assert got == {"a": {"tiers": ["EI"], "composite_impact": 2.5, "metric_year": 2023}, "b": {"journal_page_title": "K"}, "c": {"state": "no_indexing_or_metrics_shown"}, "d": None}


def test_files_are_whole_and_never_replaced(spark, tmp_path):
    path, size, digest = state.write_file(spark, str(tmp_path / "out"), "a.txt", "é\n".encode())
    assert (tmp_path / "out" / "a.txt").read_bytes() == "é\n".encode() and size == 3 and len(digest) == 64
    for name in ("a.txt", "con", ".x", "a/b", "x.", ""):
        with pytest.raises(ex.QueryError):
            state.write_file(spark, str(tmp_path / "out"), name, b"x")
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.endswith(".crc")) == ["a.txt"]


def test_legacy_import(spark, tmp_path):
    old = {"version": 5, "papers": {"r1": {"record_ref": "r1", "title": "T"}, "x": None, "y": {"title": "no ref"}}, "sources": {"j": {"tiers": ["EI"]}}, "artifacts": {}}
    (tmp_path / "old.json").write_text(json.dumps(old))
    store = state.Store(spark, str(tmp_path / "s"))
    assert state.import_legacy(store, str(tmp_path / "old.json")) and state.import_legacy(store, str(tmp_path / "old.json"))
    assert [(r.ref, json.loads(r.record)["title"]) for r in store.read("papers").collect()] == [("r1", "T")]
    assert [r.key for r in store.read("sources").collect()] == ["j"]
    for text in ("{", json.dumps({"version": 4, "papers": old["papers"]})):
        (tmp_path / "bad.json").write_text(text)
        assert not state.import_legacy(state.Store(spark, str(tmp_path / "t")), str(tmp_path / "bad.json"))


def test_classes_generate_code(spark):
    """No fallback to interpreted expressions: the plan of the pairs compiles."""
    plan = identity.class_pairs(identity.classes(spark.createDataFrame([("a", "", "D", "x", "")], "ref string, native_key string, doi_key string, dbcode string, bib_key string")))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert plan.count() == 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_python_stages_run_without_the_path():
    """Workers get the package from the driver: a session started elsewhere, without PYTHONPATH."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from lodestone.plans import catalogue
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("html_sections", "grid_records", "link_spans", "resolve_batch"):
    assert catalogue.QUERIES[name](spark, {str(DATA)!r}).count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd="/tmp", env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]
