"""Decontamination against a plain comparison of all windows."""

import hashlib
import random
import re

import duckdb
import pytest

from lodestone.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    found |= own
        names = sorted({str(i) for i in found if i is not None})
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def written(spark, path, docs, items):
    spark.createDataFrame([(d, t, "x", [1]) for d, t in docs], "doc_id long, text string, n_words string, found array<int>").repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, window string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(seed, vocabulary, n=150):
    rng = random.Random(seed)
    text = lambda low, high: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.randint(low, high)))
    items = [(rng.choice([None, *range(40)]), text(0, 40)) for _ in range(40)]
    docs = [(rng.choice([None, *range(n)]), " ".join(rng.choice([text(0, 30), rng.choice(items)[1], rng.choice(items)[1][:70]]) for _ in range(rng.randint(0, 5)))) for _ in range(n)]
    more = [None, "", "...", "-", items[0][1].upper(), "word" * 3000, "É" * 9, " ".join(["same"] * 4000), items[3][1] * 30]
    return docs + docs[:5] + [(1000 + i, t) for i, t in enumerate(more)], items + items[:2] + [(90, None), (91, "!"), (92, "same same same"), (93, "word" * 3000 + " a")]


@pytest.mark.parametrize("seed,vocabulary", [(1, ["a", "b", "c"]), (2, ["alpha", "Beta", "ÉTÉ", "été", "你好", "7", "x9"] + [f"w{i}" for i in range(60)]), (3, ["the", "of", "The"] * 3 + [f"v{i}" for i in range(9)])])
def test_all_windows_are_found_and_no_other(spark, tmp_path, seed, vocabulary):
    docs, items = made(seed, vocabulary)
    assert collected(dc.op13_decontamination(spark, written(spark, tmp_path, docs, items))) == brute(docs, items)


def test_a_full_bit_map_and_small_blocks_lose_nothing(spark, tmp_path, monkeypatch):
    docs, items = made(4, ["p", "q", "rr", "sss"])
    monkeypatch.setattr(dc, "FILTER_BITS", 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert collected(dc.op13_decontamination(spark, written(spark, tmp_path, docs, items))) == brute(docs, items)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables(spark, tmp_path):
    docs, items = made(5, ["a", "b"], 10)
    (tmp_path / "x").mkdir(), (tmp_path / "y").mkdir()
    assert collected(dc.op13_decontamination(spark, written(spark, tmp_path / "x", docs, []))) == brute(docs, [])
    assert collected(dc.op13_decontamination(spark, written(spark, tmp_path / "y", [], items))) == []


def test_spans_are_the_places_of_windows_and_every_size_is_guaranteed(spark):
    docs = spark.createDataFrame([(1, "z z one two three four five z one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "zero one two three four five")], "item_id long, text string")
    (row,) = dc.decontaminate(docs, items, words=5).collect()
    assert [tuple(s) for s in row["spans"]] == [(2, 7), (8, 13)] and row["n_hit"] == 10 and row["items"] == ["5"]
    for size in range(1, 30):
        k, w = dc.gram_and_window(size)
        assert k + w - 1 == size


def test_long_words_hash_alike_in_any_place():
    import pyarrow as pa

    long = "é" * dc.LONG_WORD
    w = dc.Words(pa.array([f"a {long}", None, f"{long} {'b' * dc.BLOCK} A", "", f"b {long.upper()}"]))
    assert w.row_at.tolist() == [0, 2, 2, 5, 5, 7]
    assert w.hash[1] == w.hash[2] and w.hash[0] == w.hash[4] and w.hash[1] != w.hash[6] and len(set(w.hash.tolist())) == 5


def test_the_sql_says_the_same(spark, tmp_path):
    docs, items = made(6, ["a", "b", "É", "long"])
    folder = written(spark, tmp_path, docs, items)
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = db.sql(dc.OP13_SQL)
    assert sorted((tuple(r) for r in found.select(", ".join(COLUMNS)).fetchall()), key=repr) == brute(docs, items)
