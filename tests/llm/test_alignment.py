"""Cross-tokenizer alignment against a plain version by both libraries."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import alignment
from lodestone.llm.alignment import align, aligned, count_pairs, load, op11_alignment

ODD = [
    None, "", " ", "   ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\n  \nb", "a▁b", "▁", "<s> </s> <|endoftext|>", " x　y", "é é", "tab\tand\r\nline", "nul\0 in", "\x1c \x85",
    "don't we'll I'D", "😀😀 你好 привет", "x" * 5000, "a b" * 3000, "word " * 700 + "\n", "\n" * 300 + "end", "a" + " " * 3000 + "b",
]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    from tokenizers import Tokenizer

    own = load(None, None)
    tokenizer = Tokenizer.from_file(own.encoder.path)
    tokenizer.encode_special_tokens = True
    docs = []
    for doc_id, text in rows:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = own.model.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        bytes_a, bytes_b = [own.tokens_a[i] for i in a], [own.tokens_b[i] for i in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append((doc_id, [], [], [], []))
            continue
        owner_a = [i for i, t in enumerate(bytes_a) for _ in t]
        owner_b = [i for i, t in enumerate(bytes_b) for _ in t]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, x, y = [], [], []
        for at, (i, j) in enumerate(zip(owner_a, owner_b, strict=True)):
            end_a, end_b = (at + 1 == len(raw) or o[at + 1] != o[at] for o in (owner_a, owner_b))
            x += [str(a[i])] * end_a
            y += [str(b[j])] * end_b
            if end_a and end_b:
                groups.append(f"{','.join(x)}|{','.join(y)}")
                x, y = [], []
        docs.append((doc_id, a, b, groups, [(a[i], b[j]) for i, j in links]))
    count = Counter(p for d in docs for p in set(d[4]))
    best = {}
    for (a, _), n in count.items():
        best[a] = max(n, best.get(a, 0))
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted((d, len(a), len(b), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest(g)) for d, a, b, g, links in docs)


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_given_and_odd_texts_agree_with_the_libraries(spark):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = given + [(10_000 + i, t) for i, t in enumerate(ODD)] + given[:3]  # and repeated rows
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n_a int, groups string").repartition(5)
    assert collected(align(docs)) == brute(rows)


def test_the_query_is_the_operator_on_documents(spark):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert collected(op11_alignment(spark, "/root/testdata/sf0.001")) == brute(given)


def test_an_empty_table_has_an_empty_result(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_memory_bounds_do_not_change_results(spark, monkeypatch):
    rows = [(i, f"word{i % 7} other{i} the same\nline {i % 3}") for i in range(300)]
    monkeypatch.setattr(alignment, "PARTS_KEPT", 3)
    own, texts = load(None, None), [t for _, t in rows]
    small = [own.rows(texts[at : at + 10]) for at in range(0, 300, 10)]
    monkeypatch.setattr(alignment, "PARTS_KEPT", 250_000)
    whole = own.rows(texts)
    for x, y in zip([r for part in small for r in part], whole, strict=True):
        assert x[:4] == y[:4] and (x[4] == y[4]).all() and (x[5] == y[5]).all()


def test_sums_are_whole_in_any_cut_of_a_partition(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    docs = [np.unique(rng.integers(0, 50, 20)) for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array([d.tolist() for d in docs[at : at + 9]], pa.list_(pa.int32()))] * 2, ["a", "b"]) for at in range(0, 200, 9)]
    want = Counter((int(k) << 32) + int(k) for d in docs for k in d)
    for held in (1, 100, 1 << 20):
        monkeypatch.setattr(alignment, "KEYS_HELD", held)
        got = Counter()
        for batch in alignment._partial(iter(batches)):
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got[k] += n
        assert got == want


def test_shards_hold_every_pair_once_in_order(spark):
    docs = spark.createDataFrame([(i, f"a b c d{i % 5} e") for i in range(64)], "doc_id long, text string").repartition(8)
    pairs = aligned(docs, with_groups=True)
    shards = count_pairs(pairs)
    try:
        want = Counter((r["a"] << 32) + r["b"] for r in pairs.select(F.inline(F.arrays_zip("a", "b"))).collect())
        keys = np.array(sorted(want), np.int64)
        assert shards.counts(keys, {}).tolist() == [want[k] for k in keys.tolist()]
        with pytest.raises((ValueError, IndexError)):
            shards.counts(np.array([keys[0] + 1 if keys[0] + 1 not in want else keys[0] - 1], np.int64), {})
    finally:
        shards.remove()


def test_a_vocabulary_without_safe_cuts_is_applied_to_whole_texts():
    own = load(None, None)
    texts = [t for t in ODD if t and len(t) < 1000]
    whole = alignment.Aligner(own.encoder.path, __import__("public_tokenizers").path("piece_bpe_32k.model"))
    whole.cuts = False
    for x, y in zip(own.rows(texts), whole.rows(texts), strict=True):
        assert (x is None) == (y is None) and (x is None or (x[:4] == y[:4] and (x[4] == y[4]).all() and (x[5] == y[5]).all()))
