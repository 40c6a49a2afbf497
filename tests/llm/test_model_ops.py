"""Packing, embeddings, quality, SimHash, suffix arrays, BPE and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, embed_dedup, packing, quality, simhash, suffix_dedup

from .test_text_ops import saved

DATA = "/root/testdata/sf0.001"


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


ODD_TEXTS = [None, "", " ", "a <|endoftext|> b", "don't  \n\n x\t\t", "ΣΑΣ İstanbul ² x３ 你好 😀 <|startoftext|>", "é" * 3000, "word " * 6000, "\x00\x7f\xad ﻿", "a" * 9000]


def test_bpe_equals_library(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    out = {r.doc_id: r for r in bpe.op10_bpe(spark, saved(spark, tmp_path, list(enumerate(texts)))).collect()}
    for k, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert out[k].n_tokens == len(ids)
        assert out[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[k].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode(spark.createDataFrame([(1, "hello world", "x")], "doc_id long, text string, ids string")).first()
    assert full.ids == t.encode("hello world", add_special_tokens=False).ids


def code_points(per_text=64):
    """Texts that hold every code point between, behind and before letters and digits."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    return [" ".join(f"a{c}b {c} 1{c}{c} {c}'s" for c in every[a : a + per_text]) for a in range(0, len(every), per_text)]


def test_ids_equal_the_libraries_for_every_code_point():
    texts = code_points()
    for name, own in (("word_bpe_49k.json", bpe.WordBpe), ("byte_bpe_50k.json", packing.ByteEncoder)):
        path = public_tokenizers.path(name)
        encode = own(path).encode
        for x, e in zip(texts, Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), strict=True):
            assert list(encode(x)) == e.ids, hex(ord(x[1]))


def test_ids_equal_the_libraries_for_mixed_characters():
    rng = random.Random(8)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(chr(rng.choice(every)) if rng.random() < 0.2 else chr(rng.randint(0x300, 0x36F)) if rng.random() < 0.2 else rng.choice(" \n'sa1.éΣkK") for _ in range(40)) for _ in range(5000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    own = bpe.WordBpe(path)
    assert all(own.encode(x) == e.ids for x, e in zip(texts, Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), strict=True))


def test_bpe_empty_table_and_repeated_rows(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = bpe.encode(spark.createDataFrame([(1, "ab"), (1, "ab")], "doc_id long, text string"), digests=True).collect()
    assert len(out) == 2 and out[0] == out[1]


def test_bpe_word_memory_is_only_a_memory(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    b = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = "several words that are more than three words"
    assert b.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert b.decode(b.encode(text)) == t.decode(b.encode(text), skip_special_tokens=False)


def test_packing_pieces_and_places(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", 60)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    out = packing.op3_packing(spark, saved(spark, tmp_path, list(enumerate(texts)))).toPandas()
    for k, x in enumerate(texts[:60]):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        mine = out[out.doc_id == k].sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine))) and mine.length.sum() == len(ids)
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]]
        assert (mine.length.iloc[1:] == 1024).all() and (len(mine) == 1 or len(ids) > 1024)
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, group in out.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 1024
    assert out.sequence_id.nunique() <= 1.02 * packing.lower_bound(out.length.to_numpy(), 1024) + 1


def test_packing_exchanges_until_nothing_is_saved(spark, tmp_path, monkeypatch):
    """Many small partitions: more exchanges than any fixed number of rounds; repeated rows and an empty table."""
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", 8)
    rng = np.random.default_rng(9)
    rows = [(int(k), 0, int(n), int(k)) for k, n in enumerate(rng.integers(300, 500, 400))]
    items = spark.createDataFrame(rows + rows[:5], "doc_id long, piece int, length long, ids_crc32 long").checkpoint()
    out = packing.pack(items).toPandas()
    assert len(out) == 405 and packing.lower_bound(out.length.to_numpy(), 1024) <= out.sequence_id.nunique() <= 203
    for _, group in out.sort_values("offset").groupby("sequence_id"):
        assert group.offset.tolist() == [0, *np.cumsum(group.length)[:-1]] and group.length.sum() <= 1024
    assert packing.pack(items.limit(0)).count() == 0
    assert packing.op3_packing(spark, saved(spark, tmp_path, [])).count() == 0


def test_packing_bound_and_fit():
    rng = np.random.default_rng(1)
    for _ in range(200):
        c = int(rng.integers(5, 30))
        sizes = rng.integers(1, c + 1, int(rng.integers(0, 9)))
        bins, offsets, used = packing.best_fit_decreasing(sizes, c)
        fill = np.bincount(bins, weights=sizes, minlength=used) if used else np.zeros(0)
        assert (fill <= c).all()
        assert packing.lower_bound(sizes, c) <= least_bins(sorted(sizes.tolist(), reverse=True), c, []) <= used


def least_bins(sizes, c, rooms):
    if not sizes:
        return len(rooms)
    options = [[*rooms, c - sizes[0]]] + [[r - sizes[0] if j == i else r for j, r in enumerate(rooms)] for i in {rooms.index(r) for r in rooms if r >= sizes[0]}]
    return min(least_bins(sizes[1:], c, o) for o in options)


@pytest.mark.parametrize(("threshold", "tile"), [(0.95, 4096), (0.3, 90)])
def test_embeddings_equal_brute_force(spark, threshold, tile):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()][:300]
    v = rows[5][1]
    rows += [(1001, None), (1002, [0.0] * 64), (1003, [None, *v[1:]]), (1004, [float("nan"), *v[1:]]), (1005, v), (1006, v), (1007, [2 * x for x in v]), (1008, []), (1009, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("first", F.lit("x"))
    good = [i for i, (_, x) in enumerate(rows) if x and len(x) == 64 and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    u = np.array([np.float32(rows[i][1]) for i in good], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = [(good[a], good[b]) for a, b in zip(*np.nonzero(u @ u.T >= threshold), strict=True) if a != b]
    root, degree = roots(len(rows), near), collections.Counter(a for a, _ in near)
    out = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(df, threshold, tile=tile).collect()}
    assert out == {rows[i][0]: (degree[i], rows[root[i]][0]) for i in range(len(rows))}
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(200, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    q, s, e = embed_dedup.quantised(u)
    cos = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(cos - u @ u.T) <= e[:, None] * (1 + e) + (1 + e[:, None]) * e + e[:, None] * e + 1e-9).all()


@pytest.mark.parametrize("dimensions", [3, 1024, 3000])
def test_int8_products_are_exact_in_any_dimension(dimensions):
    """Extreme components: products reach their largest sums."""
    rng = np.random.default_rng(10)
    a = np.where(rng.random((40, dimensions)) < 0.95, 1.0, -1.0) * (1 + 1e-3 * rng.random((40, dimensions)))
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    for threshold in np.quantile(u @ u.T, [0.1, 0.5, 0.9]):
        assert (embed_dedup.linked(a, a, threshold) == (u @ u.T >= threshold)).mean() > 0.999


def test_embeddings_repeated_rows(spark):
    out = embed_dedup.near_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_quality_finds_junk_and_keeps_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs)
    out = quality.score(docs, model).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    table = {(r.quality, r.kept): r.n for r in out.groupBy("quality", "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert table.get((1, False), 0) <= 0.01 * table[(1, True)]
    assert table.get((0, True), 0) <= 0.05 * table[(0, False)]
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 100_000, "c"), (3, "x" * 100_000, "c")], "doc_id long, text string, votes string")
    assert quality.score(odd, model).count() == 4
    assert quality.good_documents(odd, model).columns == odd.columns
    none = docs.limit(0)
    assert quality.score(none, quality.train(none)).count() == 0


def test_labellers_recover_planted_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    rates = np.array([[0.5, 0.002], [0.6, 0.005], [0.4, 0.001]])
    patterns = collections.Counter("".join("-" if rng.random() < r[int(g)] else "+" for r in rates) for g in good)
    posterior, found, share = quality.fit_labellers(patterns)
    assert abs(share - 0.8) < 0.06 and np.abs(found[:, 0, 0] - rates[:, 0]).max() < 0.15
    assert posterior["+++"] > 0.5 > posterior["--+"]


def test_labellers_that_err_often_are_estimated():
    """No rate is set: one labeller votes bad on every fifth good document and is found to."""
    rng = np.random.default_rng(12)
    good = rng.random(30_000) < 0.7
    rates = np.array([[0.8, 0.2], [0.7, 0.01], [0.75, 0.03], [0.6, 0.01]])
    patterns = collections.Counter("".join("-" if rng.random() < r[int(g)] else "+" for r in rates) for g in good)
    posterior, found, share = quality.fit_labellers(patterns)
    assert abs(share - 0.7) < 0.05 and np.abs(found[:, :, 0] - rates).max() < 0.06
    assert posterior["-+++"] > 0.9 > 0.1 > posterior["---+"]


def brute_quality(texts):
    """Scores of the texts by the operator's own description, one text at a time, with a scorer fitted here."""
    seen = [quality.described(t or "") for t in texts]
    posterior, _, _ = quality.fit_labellers(collections.Counter(p for p, _, _ in seen))
    x = np.zeros((len(seen), quality.DIMENSIONS))
    for i, (_, at, value) in enumerate(seen):
        x[i, at] = value
    weights, bias = quality.fit_scorer(x, np.array([posterior[p] for p, _, _ in seen]))
    return [(1 / (1 + np.exp(-(sum(float(v) * weights[a] for a, v in zip(at, value, strict=True)) + bias))), posterior[p], p) for p, at, value in seen]


def test_quality_equals_brute_force(spark, tmp_path):
    """The query on a table that is smaller than the sample; repeated rows, clashing columns, ties at the threshold."""
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [None, "", "!!", "x" * 5000, "ab " * 3000]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(7, texts[7], "y")]
    spark.createDataFrame(rows, "doc_id long, text string, votes string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_quality([t for _, t, _ in rows])
    out = sorted(quality.op6_quality(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    for r, (score, posterior, votes) in zip(out, [want[k] for k in sorted(range(len(rows)), key=lambda i: rows[i][0])], strict=True):
        assert abs(r.score - score) < 1e-3 and abs(r.posterior - posterior) < 1e-9 and r.votes == votes and r.kept == (r.score >= 0.5)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = sorted(r.doc_id for r in quality.good_documents(docs).collect())
    assert kept == [r.doc_id for r in out if r.kept]
    tie = quality.score(docs, quality.QualityModel({}, np.zeros(quality.DIMENSIONS), 0.0, 1.0))
    assert {(r.score, r.kept) for r in tie.collect()} == {(0.5, True)}


def test_quality_reads_whole_words_and_long_texts():
    head = "a1" * 40
    assert quality.described(head + "b")[1].tolist() != quality.described(head + "###")[1].tolist()
    spam = [quality.described("buy this now or never again friends " * n)[0][4] for n in (20, 200, 20_000)]
    assert spam == ["-", "-", "-"]
    rng = random.Random(13)
    prose = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(30_000))
    assert quality.described(prose)[0][4] == "+"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_code_is_perfect_and_keys_meet():
    assert (np.bincount(simhash.golay_index(np.arange(1 << 23))) == 2048).all()
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = y = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for b in rng.choice(64, 3, replace=False):
            y ^= 1 << int(b)
        rows, keys = simhash.fuzzy_keys(np.array([x, y], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_simhash_equals_brute_force(spark, tmp_path):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [None, "", "one", "one two", "one two", "É Ü  ab c\x0bd", "w " * 3000]
    rng = random.Random(5)
    long = "lorem ipsum dolor sit amet " * 3 + " ".join(str(rng.random()) for _ in range(400))
    texts += [long.replace(" ", " x" + str(i) + " ", 1) for i in range(60)]
    rows = list(enumerate(texts))
    fp = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    root = roots(len(rows), [(a, int(b)) for a in range(len(rows)) for b in np.flatnonzero(np.bitwise_count(fp ^ fp[a]) <= 3)])
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, saved(spark, tmp_path, rows)).collect()}
    assert out == {k: (f"{int(fp[k]):016x}", root[k]) for k in range(len(rows))}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string, fp string")).count() == 0


def test_simhash_large_buckets(monkeypatch):
    """Buckets that are cut again give the same components."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 48, 40, dtype=np.uint64) << np.uint64(16)
    members = np.unique(np.concatenate([b ^ (np.uint64(1) << np.uint64(k)) ^ (np.uint64(1) << np.uint64(j)) for b in base for k in range(16, 64, 5) for j in range(17, 64, 7)] + [base], axis=None))
    place = {int(x): i for i, x in enumerate(members)}
    want = roots(len(members), [(a, int(b)) for a in range(len(members)) for b in np.flatnonzero(np.bitwise_count(members ^ members[a]) <= 3)])
    monkeypatch.setattr(simhash, "WHOLE_BUCKET", 16)
    assert roots(len(members), [(place[int(x)], place[int(y)]) for x, y in simhash._bucket_links(members, 0, 3)]) == want


def brute_repeats(strings, least):
    where = collections.defaultdict(set)
    for k, s in enumerate(strings):
        for i in range(len(s)):
            for j in range(i + least, len(s) + 1):
                where[s[i:j]].add((k, i))
    out = set()
    for w, occ in where.items():
        left = {strings[k][i - 1] if i else ("^", k) for k, i in occ}
        right = {strings[k][i + len(w)] if i + len(w) < len(strings[k]) else ("$", k) for k, i in occ}
        if len(occ) > 1 and len(left) > 1 and len(right) > 1:
            out.add((len(w), frozenset(occ)))
    return out


def test_maximal_repeats():
    rng = random.Random(6)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 4))]
        ends = np.cumsum([len(s) for s in strings])
        starts = np.append(0, ends[:-1])
        got = set()
        for n, occ in suffix_dedup.maximal_repeats(np.frombuffer(b"".join(strings), np.uint8), ends, 3):
            k = np.searchsorted(ends, occ, side="right")
            got.add((n, frozenset(zip(k.tolist(), (occ - starts[k]).tolist(), strict=True))))
        assert got == brute_repeats(strings, 3)


def brute_removal(rows):
    low = {}
    for k, t in rows:
        b, k = (t or "").encode(), suffix_dedup.NO_ID if k is None else k
        for i in range(len(b) - 49):
            low[b[i : i + 50]] = min(low.get(b[i : i + 50], k), k)
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if low[b[i : i + 50]] < (suffix_dedup.NO_ID if k is None else k):
                gone[i : i + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone, strict=True) if not y)).hexdigest()))
    return collections.Counter(out)


def test_suffix_dedup_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BYTES_PER_TASK", 1 << 14)
    rng = random.Random(7)
    blocks = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 120))) for _ in range(30)]
    rows = [
        (i, "".join(rng.choice(blocks)[rng.randint(0, 15) :] if rng.random() < 0.6 else "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 12))))
        for i in rng.sample(range(1000), 200)
    ]
    rows += [(None, rows[3][1]), (None, "x" * 300), (5001, "x" * 200), (5002, None), (5003, "ab" * 100), (5003, "ab" * 90 + "c"), (5000, "x" * 400), (5001, "x" * 200), (6000, "xy" * 200_000 + rows[5][1])]
    out = collections.Counter(tuple(r) for r in suffix_dedup.op9_suffix_dedup(spark, saved(spark, tmp_path, rows)).collect())
    assert out == brute_removal(rows)
    none = spark.createDataFrame([], "doc_id long, text string, doc string")
    assert suffix_dedup.without_spans(none, suffix_dedup.repeated_spans(none)).count() == 0


@pytest.mark.parametrize(("at_once", "held"), [(1, 4), (1, 10_000), (50, 60)])
def test_suffix_streams_of_any_size(monkeypatch, at_once, held):
    """The stages in one process, on streams cut anywhere: k-mers with more rows than a task holds lose nothing."""
    monkeypatch.setattr(suffix_dedup, "ROWS_AT_ONCE", at_once)
    monkeypatch.setattr(suffix_dedup, "ROWS_HELD", held)
    monkeypatch.setattr(suffix_dedup, "SEGMENTS_AT_ONCE", 5)
    rng = random.Random(14)
    hot = "the very same passage that a third of all documents share, " * 2
    rows = [(k, (hot if k % 3 == 0 else "") + "".join(rng.choice(["a" * rng.randint(1, 90), hot[rng.randint(0, 40) :], "".join(rng.choice("xyz") for _ in range(30))]) for _ in range(4))) for k in range(120)]
    rng.shuffle(rows)
    got = []
    for k in range(0, len(rows), 10):
        some = [t.encode() for _, t in rows[k : k + 10]]
        ids = np.array([i for i, _ in rows[k : k + 10]], np.int64)
        got += suffix_dedup._rows_of(ids, ids.astype(np.int32), np.cumsum([0, *map(len, some)]), np.frombuffer(b"".join(some), np.uint8))

    def dealt(table, *by):
        return table.sort_by([(c, "ascending") for c in by]).to_batches(max_chunksize=7)

    found = pa.Table.from_batches(suffix_dedup._matched(iter(dealt(pa.Table.from_batches(got), "h", "id", "more", "doc")))).to_pylist()
    text = {i: t.encode() for i, t in rows}
    asked = [{**r, "bytes": text[r["doc"]][r["lo"] : r["hi"]]} for r in found if r["g"] is not None]
    resolved = pa.Table.from_batches(suffix_dedup._resolved(iter(dealt(pa.Table.from_pylist(asked), "g", "doc", "row", "lo")))).to_pylist()
    want = {k: n for k, _, n, _, _ in brute_removal(rows)}
    for i, _ in rows:
        gone = {x for r in [r for r in found if r["g"] is None] + resolved if r["doc"] == i for x in range(r["lo"], r["hi"])}
        assert len(gone) == want[i], i


def test_pipeline_stages(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = documents.withColumn("votes", F.lit("kept")).union(documents.limit(3).select((F.col("doc_id") + 10_000).alias("doc_id"), "text", "lang", "source", "n_chars", F.lit("copy")))
    docs, seen = extra.unionByName(spark.createDataFrame([(20_000, None, None, None, None, "x"), (20_001, "", "en", "s", 0, "")], extra.schema)), {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(step(spark, docs, DATA), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert seen["quality"].count() < extra.count()
    exact = seen["exact_dedup"].toPandas()
    assert not exact.text.fillna("").duplicated().any()
    fp = [int(brute_like(t, 5)) for t in seen["simhash"].toPandas().text.fillna("")]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fp) for b in fp[:i])
    assert "@" not in " ".join(re.findall(r"\S+@\S+\.\S+", " ".join(seen["pii"].toPandas().text.fillna(""))))
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in seen["pii"].collect()}
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, documents.limit(0), DATA).count() == 0


def brute_like(text, k):
    return simhash.fingerprint(text, k)
