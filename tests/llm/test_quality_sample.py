"""The classifier's sample, its rounds and its columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality

DATA = "/root/testdata/sf0.001"


def test_a_text_that_fills_half_the_table_does_not_fill_the_sample(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    one = docs.where("doc_id = 7").first()["text"]
    copies = spark.range(5_000).select((F.col("id") + 100_000).alias("doc_id"), F.lit(one).alias("text"))
    plain, full = quality.train(docs, 64), quality.train(docs.union(copies), 64)
    same = [r["text"] for r in docs.collect()]
    kept = [[m.score(t or "")[0] >= 0.5 for t in same] for m in (plain, full)]
    assert np.mean(np.array(kept[0]) == np.array(kept[1])) > 0.97
    seen = quality.describe_all(docs.union(copies))
    taken = []

    def noted(x, y, weight=None, **more):
        taken.append((len(x), weight))
        return np.zeros(x.shape[1]), 0.0

    original, quality.fit_scorer = quality.fit_scorer, noted
    try:
        quality.fit(seen, 64)
        quality.fit(seen, 100_000)
    finally:
        quality.fit_scorer = original
    texts = {t or "" for t in same}
    assert taken[0][0] == 64 and taken[1][0] == len(texts) and taken[1][1].sum() == len(same) + 5_000


def test_rounds_that_do_not_suffice_are_an_error():
    rng = random.Random(1)
    patterns = {"".join(rng.choice("+-0") for _ in range(9)): rng.randint(1, 50) for _ in range(300)}
    with pytest.raises(RuntimeError):
        quality.fit_labellers(patterns, rounds=1)
    assert 0 < quality.fit_labellers(patterns)[2] < 1


def test_no_share_is_bounded():
    _, _, share = quality.fit_labellers({"+++": 999_990, "++0": 8})
    assert share > 0.98


def test_columns_may_be_called_like_the_operator_s_own(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs)
    odd = docs.select("doc_id", "text", *(F.lit(n).alias(n) for n in ("__pattern", "__at", "__value", "__score", "__posterior", "score", "c0")))
    out = quality.good_documents(odd, model)
    assert out.columns == odd.columns and out.first()["__at"] == "__at"
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in quality.good_documents(docs, model).collect())
