"""Co-bucketed tables against a plain sort of all rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import co_bucket as cb
from lodestone.llm.common import shared_dir

SALES, LINES = "sale_id long, client_id long, status string, total double", "sale_id long, line_no int, item_id long, flag string, Bucket int"


def crc(value, salt=""):
    return zlib.crc32(f"{salt}{value}".encode()) % 150


def sort_key(row):
    """First column descending, the rest ascending; nulls first, NaN last, strings by bytes."""

    def one(v, down=False):
        if v is None:
            return (0, 0)
        if isinstance(v, float) and math.isnan(v):
            return (2, 0)
        return (1, v.encode() if isinstance(v, str) else -v if down else v)

    return (one(row[0], True), *map(one, row[1:]))


def sha(values):
    return hashlib.sha256(",".join("" if v is None else str(v) for v in values).encode()).hexdigest()


def brute(sales, lines, item_at):
    ids = {r[0] for r in sales if r[0] is not None}
    start = lambda b: b - 1 if b % 5 == 1 else b
    tables = {
        "sales": [(r, start(b), b) for r in sales for b in [151 if r[0] is None else crc(r[0], "pair")]],
        "sale_lines": [(r, 0 if r[item_at] is None else crc(r[item_at]), 151 if r[0] is None else crc(r[0], "pair") if r[0] in ids else 150) for r in lines],
    }
    n, m = Counter(r[0] for r in sales), Counter(r[0] for r in lines)
    joined = Counter()
    for k in ids:
        joined[crc(k, "pair")] += n[k] * m[k]
    out = {}
    for name, rows in tables.items():
        by, froms = defaultdict(list), defaultdict(Counter)
        sent = defaultdict(set)
        for r, s, b in rows:
            by[b].append(r)
            froms[b][s] += 1
            sent[s].add(b)
        for b, own in by.items():
            own.sort(key=sort_key)
            stays = len(froms[b]) == 1 and len(sent[next(iter(froms[b]))]) == 1
            out[name, b] = own, sha(r[0] for r in own), sha(f"{s}:{k}" for s, k in sorted(froms[b].items())), joined[b] if b < 150 else 0, not stays
    return out


def checked(out, want, columns, root):
    rows = out.collect()
    assert {(r["table_name"], r["bucket"]) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        own, ids, lineage, joined, rewritten = want[r["table_name"], r["bucket"]]
        stored = pq.read_table(r["path"])
        assert stored.column_names == columns[r["table_name"]] == r["columns"].split(",")
        got = [tuple(x.values()) for x in stored.to_pylist()]
        assert list(map(repr, got)) == list(map(repr, own))
        assert (r["n_rows"], r["ids_sha256"], r["lineage_sha256"], r["n_joined"], r["rewritten"]) == (len(own), ids, lineage, joined, rewritten)
    assert {str(p) for p in Path(root).rglob("*") if p.is_file()} == {r["path"] for r in rows}


def made(spark, tmp_path, sales, lines):
    for name, rows, schema in (("sales", sales, SALES), ("sale_lines", lines, LINES)):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def case(seed, n=900):
    rng = random.Random(seed)
    words = [None, "", "a", "Z", "é", "z", "\U0001f600", "ﬀ", "a b"]
    sales = [(rng.choice([None, *range(-3, 200)]), rng.choice([None, 1, 2]), rng.choice(words), rng.choice([None, math.nan, -1.5, 0.0, 7.25, math.inf])) for _ in range(n // 4)]
    lines = [(rng.choice([None, 7, 7, 7, *range(-3, 400)]), rng.choice([None, 1, 2]), rng.choice([None, *range(60)]), rng.choice(words), rng.randint(0, 3)) for _ in range(n)]
    return sales, lines + lines[:50]


def of_query(spark, folder):
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("co-bucket-*"))
    out = cb.op12_co_bucket(spark, folder)
    (root,) = set(Path(shared_dir(spark).removeprefix("file:")).glob("co-bucket-*")) - before
    return out, root


def test_files_are_those_of_a_plain_sort(spark, tmp_path, monkeypatch):
    for name, n in (("RUN_ROWS", 40), ("BLOCK_ROWS", 3), ("OPEN_RUNS", 2)):  # many short runs, merged in rounds
        monkeypatch.setattr(cb, name, n)
    sales, lines = case(2)
    out, root = of_query(spark, made(spark, tmp_path, sales, lines))
    checked(out, brute(sales, lines, 2), {"sales": ["sale_id", "client_id", "status", "total"], "sale_lines": ["sale_id", "line_no", "item_id", "flag", "Bucket"]}, root)


def test_the_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    tables = {t: pq.read_table(f"{folder}/{t}.parquet") for t in ("sales", "sale_lines")}
    rows = {t: [tuple(r.values()) for r in x.to_pylist()] for t, x in tables.items()}
    out, root = of_query(spark, folder)
    checked(out, brute(rows["sales"], rows["sale_lines"], 2), {t: x.column_names for t, x in tables.items()}, root)


def test_empty_tables_have_no_files(spark, tmp_path):
    def paired(sales, lines, folder):
        left, right = spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)
        starts = F.lit(0), F.lit(0)
        return cb.co_bucket(left, right, ("sales", "sale_lines"), "sale_id", starts, 1, 3, "", str(folder)).collect()

    assert paired([], [], tmp_path / "none") == [] and not [p for p in (tmp_path / "none").rglob("*") if p.is_file()]
    rows = paired([(1, None, "a", 1.0), (1, None, "a", 1.0)], [], tmp_path / "one")
    assert [(r["table_name"], r["n_rows"], r["n_joined"], r["rewritten"]) for r in rows] == [("sales", 2, 0, False)]  # the starting file is the bucket's


def test_merging_holds_a_block_of_each_run():
    order = [("k", True), ("s", False)]
    rng = random.Random(5)
    rows = [[(rng.randint(0, 30), rng.choice("abc")) for _ in range(500)] for _ in range(6)]
    loaded = Counter()

    def blocks(i, own):
        own = sorted(own, key=lambda r: (-r[0], r[1]))
        for at in range(0, 500, 20):
            loaded[i] += 1
            yield pa.table({"k": [r[0] for r in own[at : at + 20]], "s": [r[1] for r in own[at : at + 20]]})

    got, most = [], 0
    for part in cb.merged([blocks(i, r) for i, r in enumerate(rows)], order):
        most = max(most, part.num_rows)
        got += [tuple(r.values()) for r in part.to_pylist()]
        assert sum(loaded.values()) * 20 - len(got) <= 6 * 20
    assert got == sorted((r for own in rows for r in own), key=lambda r: (-r[0], r[1])) and most <= 6 * 20


def test_columns_without_an_order_are_refused(spark):
    with pytest.raises(TypeError):
        cb.runs(spark.range(3).withColumn("a", F.array("id")), F.lit(0), [("id", False)], "/nowhere", "_b")
