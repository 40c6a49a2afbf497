"""Staged tables: whose they are, and that a failure leaves none."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.llm.common import cleared, release, shared_dir, stage, tidied
from lodestone.llm.embed_dedup import near_vectors
from lodestone.llm.simhash import near_duplicates


def tables(spark):
    return {p.name for p in (Path(shared_dir(spark).removeprefix("file:")) / "stage").glob("*")}


def test_a_failed_query_leaves_no_table(spark):
    def query(spark, _):
        stage(spark.range(3), "left-over")
        raise ValueError("no")

    before = tables(spark)
    with pytest.raises(ValueError):
        tidied(query)(spark, "")
    with pytest.raises(ValueError), cleared(spark):
        query(spark, "")
    assert tables(spark) == before


def test_runs_at_the_same_time_keep_their_own_tables(spark):
    kept, turn = {}, threading.Barrier(2)

    def run(name):
        with cleared(spark, lambda: kept[name]):
            stage(spark.range(2), f"first-{name}")
            turn.wait()
            kept[name] = stage(spark.range(5).withColumn("who", F.lit(name)), f"last-{name}")
            turn.wait()

    before = tables(spark)
    threads = [threading.Thread(target=run, args=(n,)) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(tables(spark) - before) == 2
    assert all(df.count() == 5 and df.first()["who"] == n for n, df in kept.items())
    release(*kept.values())
    release(spark.range(3))  # not staged
    assert tables(spark) == before


def test_rows_without_an_id(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in near_vectors(vectors).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (None, 0, None)}
    docs = spark.createDataFrame([(5, "same words here in a row"), (None, "same words here in a row"), (None, "quite another text of its own")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 5), (5, 5)]
