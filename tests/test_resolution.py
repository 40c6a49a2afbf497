"""Resolution against stored papers: batches equal one sequence, and the store's tables."""

import hashlib
import random
import shutil
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx
from lodestone.operators import resolution as rs
from lodestone.operators.resolution import FIELDS, PaperStore
from lodestone.operators.state import BUCKETS, Store, current
from lodestone.streaming.upsert import run_resolution

SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("ref", T.StringType()), *FIELDS.fields])


def observation(seq, ref, **more):
    return (seq, ref, *(more.get(f.name, False if f.name == "is_detail" else None) for f in FIELDS.fields))


def made(seed, n=110):
    """Few titles, years, DOIs and refs, so that keys collide, conflict and arise by merging."""
    rng = random.Random(seed)
    rows = []
    for seq in range(1, n + 1):
        t = rng.randint(0, 9)
        row = observation(
            seq, rng.choice(["", *(f"r{i}" for i in range(14))]), title=rng.choice([f"Title {t}", f" title  {t}", f"Other {t}"]), authors=rng.choice([None, [], ["A. One"], ["a. one"], ["B", "C"]]),
            source=rng.choice([None, "", "Journal", "journal . "]), year=rng.choice([None, 0, 2020, 2021]), doi=rng.choice([None, "", "", f"10.1/{rng.randint(0, 30)}", f"DOI:10.1/{rng.randint(0, 30)}"]),
            dbname=rng.choice([None, "CJFD"]), filename=rng.choice([None, "", f"F{rng.randint(0, 25)}"]), dbcode=rng.choice([None, None, None, "x", "X", "y"]), is_detail=rng.random() < 0.3,
            abstract=rng.choice([None, "", f"about {seq}"]), cited=rng.choice([None, 0, seq]), locator=rng.choice([None, f"l{t}"]),
        )
        rows += [row] if rng.random() < 0.85 else [row, (seq + 1000, *row[1:])]
    return sorted((i + 1, *r[1:]) for i, r in enumerate(sorted(rows)))


def brute(rows):
    """One observation after the other against all records and all keys."""
    names = FIELDS.names
    records, keys, out = {}, {}, {}

    def key_list(p):
        return [f"{k}:{v}" for k, v in rs.keys_of(p).items() if v]

    for seq, ref, *values in rows:
        p = dict(zip(names, values, strict=True))
        if not ref:
            k = rs.keys_of(p)
            base = k["native"] or k["doi"] or k["bib"] or f"{p['title'] or ''}\0{p['locator'] or ''}"
            ref = "cr_" + hashlib.sha256(rs._json(base).encode()).hexdigest()[:16]
        new = p | {"keys": rs.keys_of(p)}
        refs = sorted({ref} | {r for k in key_list(p) for r in keys.get(k, ())})
        hit = next((r for r in refs if r in records and ((r == ref and rs.detail_of(records[r], new)) or rs.same(records[r], new))), None)
        if hit is None:
            hit = ref if ref not in records else rs.another_ref(ref, seq)
            assert hit not in records
            record = dict(p)
        else:
            record = rs.merged(records[hit], new)
        records[hit] = record | {"keys": rs.keys_of(record)}
        for k in key_list(record):
            keys.setdefault(k, set()).add(hit)
        out[seq] = hit
    return out, records, {(k, r) for k, found in keys.items() for r in found}


def plain(value):
    return tuple(value) if isinstance(value, list) else value


@pytest.mark.parametrize("seed,cuts", [(1, (1000,)), (3, (40, 60, 1000))])
def test_batches_resolve_as_one_sequence(spark, tmp_path, seed, cuts):
    rows = made(seed)
    want, records, keys = brute(rows)
    papers = PaperStore(Store(spark, str(tmp_path / "store")))
    got, low = {}, 0
    for n, cut in enumerate(cuts):
        batch = spark.createDataFrame([r for r in rows if low < r[0] <= cut], SCHEMA).repartition(3)
        got |= {r["seq"]: r["ref"] for r in papers.upsert(batch, f"b{n}").collect()}
        low = cut
    assert got == want
    stored = {r["ref"]: {c: plain(r[c]) for c in FIELDS.names} for r in papers.papers().collect()}
    assert stored == {ref: {c: plain(p[c]) for c in FIELDS.names} for ref, p in records.items()}
    assert {(r["key"], r["ref"]) for r in papers.store.read("paper_keys").collect()} == keys
    again = papers.upsert(spark.createDataFrame(rows[:3], SCHEMA), "b0")  # a batch that is known
    assert {r["seq"] for r in again.collect()} == {r[0] for r in rows if r[0] <= cuts[0]} and papers.papers().count() == len(records)


def resolved(spark, tmp_path, *rows):
    papers = PaperStore(Store(spark, str(tmp_path / "store")))
    out = {r["seq"]: r["ref"] for r in papers.upsert(spark.createDataFrame(list(rows), SCHEMA)).collect()}
    return out, papers


def test_a_ref_is_given_once_in_the_whole_store(spark, tmp_path):
    out, papers = resolved(spark, tmp_path, observation(1, "a", title="T", doi="10.1/x"), observation(2, "a", title="T", doi="10.1/y"), observation(3, "z", title="Q", doi="10.1/y"))
    assert out[1] == "a" and out[2] == rs.another_ref("a", 2) == out[3]
    later = papers.upsert(spark.createDataFrame([observation(4, "a", title="T", doi="10.1/z")], SCHEMA)).collect()
    assert later[0]["ref"] == rs.another_ref("a", 4) and papers.papers().count() == 3


def test_a_key_that_a_merge_makes_is_found_by_another_component(spark, tmp_path):
    rows = (
        observation(1, "a", title="T", authors=["A"], source="S", doi="10.1/x"), observation(2, "b", year=2020, doi="10.1/x"),  # together they have a bibliography
        observation(3, "c", title="t", authors=["a"], source="s", year=2020, dbname="D", filename="F"), observation(4, "d", dbname="d", filename="f", abstract="late"),
    )
    out, papers = resolved(spark, tmp_path, *rows)
    assert set(out.values()) == {"a"} and papers.by_key(["native:D:F"]).first()["ref"] == "a" and papers.by_ref(["a"]).first()["abstract"] == "late"


def test_the_own_ref_is_a_candidate_by_detail(spark, tmp_path):
    out, _ = resolved(spark, tmp_path, observation(1, "a", title="C++", authors=["A", "B"]), observation(2, "a", title="c++", authors=["a"], source="S"), observation(3, "a", title="C", authors=["A"]))
    assert out == {1: "a", 2: "a", 3: rs.another_ref("a", 3)}


def test_runs_of_equal_observations_fold_as_one(spark, tmp_path):
    busy = [observation(i, "a", title="T", doi="10.1/x") for i in range(1, 3000)] + [observation(i, "k", title="U") for i in range(3000, 3004)] + [observation(4000, "k", title="V"), observation(4001, "k", title="V")]
    out, _ = resolved(spark, tmp_path, *busy)
    assert {out[i] for i in range(1, 3000)} == {"a"} and {out[i] for i in range(3000, 3004)} == {"k"} and out[4000] != out[4001]


def test_keys_of_a_fold_are_those_of_columns(spark):
    odd = ["C++ & <b>", " a　b ", 'say "no"\\', "line\nend ", "É—Ü", "x：y", "", "İstanbul"]
    rows = [(t, [t, "B"], s, 2020, f" DOI:{t}", "db", "f1") for t in odd for s in ("J . ", "Ｊ（a）。")]
    df = spark.createDataFrame(rows, "title string, authors array<string>, source string, year int, doi string, dbname string, filename string")
    got = rs.with_keys(df).select("*", tx.title_key("title").alias("t"), tx.source_key("source").alias("s")).collect()
    for r in got:
        assert rs.keys_of(r.asDict()) == {"native": r["native_key"], "doi": r["doi_key"], "bib": r["bib_key"]}, r
        assert (rs._title(r["title"]), rs._source(r["source"])) == (r["t"], r["s"])


def test_a_fold_gives_each_key_with_its_ref_once():
    rows = [dict.fromkeys(rs.IN.names) | {"component": 1, "kind": rs.OBSERVATION, "seq": i, "ref": "a", "title": "T", "doi": "10.1/x", "abstract": f"v{i}"} for i in range(50)]
    stored = dict.fromkeys(rs.IN.names) | {"component": 2, "kind": rs.KEY, "key": "doi:10.1/y", "ref": "b"}
    known = dict.fromkeys(rs.IN.names) | {"component": 2, "kind": rs.OBSERVATION, "seq": 60, "ref": "b", "title": "U", "doi": "10.1/y"}
    out = [r for b in rs._folded(iter([pa.RecordBatch.from_pylist([*rows, stored, known], schema=rs.ARROW_OUT)])) for r in b.to_pylist()]
    assert [(r["key"], r["ref"]) for r in out if r["kind"] == rs.KEY] == [("doi:10.1/x", "a")]
    assert [(r["seq"], r["ref"]) for r in out if r["kind"] == rs.OBSERVATION] == [*((i, "a") for i in range(50)), (60, "b")]
    assert [(r["component"], r["ref"], r["abstract"]) for r in out if r["kind"] == rs.RECORD] == [(1, "a", "v49"), (2, "b", None)]


def test_links_are_computed_once(spark, tmp_path, monkeypatch):
    source, write = str(tmp_path / "links"), rs.written
    spark.createDataFrame([(i, f"k{j}") for i in range(40) for j in (i // 4, 100 + (i + 1) // 8)], "node long, key string").write.parquet(source)

    def gone(df, name):
        out = write(df, name)
        shutil.rmtree(source, ignore_errors=True)  # what is read a second time fails
        return out

    monkeypatch.setattr(rs, "written", gone)
    got = {r["node"]: r["component"] for r in rs.labelled(spark.read.parquet(source)).collect()}
    assert got == dict.fromkeys(range(40), 0)


def test_title_keys_of_every_code_point(spark):
    points = spark.range(1, 0x3100).union(spark.range(0xFE00, 0x10000)).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    title = F.concat(F.lit("a "), "c", F.lit(" "), "c", F.lit("  b"))
    plain = F.regexp_replace(F.lower(F.btrim(F.regexp_replace(title, f"{tx.BLANK}+", " "), F.lit(" "))), f" ?({tx.TITLE_MARKS}) ?", "$1")
    got = points.select("c", tx.title_key(title).alias("key"), plain.alias("plain"), F.col("c").rlike(f"^{tx.BLANK}$").alias("b"), F.col("c").rlike(f"^{tx.WHITE}$").alias("w")).collect()
    assert len(got) > 12_000 and [r["c"] for r in got if r["b"] != r["w"] or r["key"] != r["plain"]] == []


def files_read(df):
    df = df.select("*")  # a plan that has not run yet
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves() if "Adaptive" not in plan.getClass().getName() else plan.finalPhysicalPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_a_lookup_opens_the_files_of_its_keys_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    store.append_keyed("things", df, "key", "one")
    found = store.lookup("things", "key", ["k7", "k19999", "none"])
    assert sorted(r["id"] for r in found.collect()) == [7, 19_999]
    assert 0 < files_read(found) <= 3 < files_read(store.read("things")) >= BUCKETS
    assert sorted(r["id"] for r in store.matching("things", "key", spark.createDataFrame([("k5",), ("k6",), ("x",)], "key string")).collect()) == [5, 6]
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_two_writers_never_take_one_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append("runs", spark.createDataFrame([("a", 0, 0)], "key string, n int, version long"))
    turns = []

    def slow(row):
        if len(turns) < 2:  # another writer comes between reading and entering, twice
            turns.append(1)
            store.update("runs", "key", "a", lambda r: r.withColumn("n", F.col("n") + 10))
        return row.withColumn("n", F.col("n") + 1)

    store.update("runs", "key", "a", slow)
    rows = store.read("runs").orderBy("version").collect()
    assert [r["n"] for r in rows] == [0, 10, 20, 21] and [r["version"] for r in rows] == [0, 1, 2, 3]
    store.compact("runs", lambda df: current(df, "key"))
    store.update("runs", "key", "a", lambda r: r.withColumn("n", F.col("n") * 2))
    assert [r["n"] for r in current(store.read("runs"), "key").collect()] == [42]


def test_updates_of_threads_all_survive(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.append("runs", spark.createDataFrame([("a", 0, 0)], "key string, n int, version long"))
    threads = [threading.Thread(target=store.update, args=("runs", "key", "a", lambda r: r.withColumn("n", F.col("n") + 1))) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert current(store.read("runs"), "key").first()["n"] == 3


def test_a_stream_resolves_as_one_sequence(spark, tmp_path):
    rows = made(6, 50)
    want, records, _ = brute(rows)
    for n, part in enumerate((rows[:20], rows[20:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        papers = PaperStore(Store(spark, str(tmp_path / "store")))  # a new process each time
        run_resolution(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), papers, str(tmp_path / "check")).awaitTermination(300)
    assert {r["seq"]: r["ref"] for r in papers.store.read("resolved").collect()} == want
    assert {r["ref"] for r in papers.papers().collect()} == set(records)
