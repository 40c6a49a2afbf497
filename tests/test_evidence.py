"""Problems as codes, and the tables that runs leave behind."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import problems
from lodestone.operators.evidence import Evidence
from lodestone.operators.state import OperationStopped, Store
from lodestone.plans.expression import QueryError


def test_foreign_errors_have_codes(spark):
    rows = [("RATE_LIMITED", "x", False), ("", "read: Connection RESET by peer", False), (None, "context canceled", True), (None, "no such thing", None), ("", None, False)]
    df = spark.createDataFrame(rows, "code string, message string, cancelled boolean")
    code = problems.foreign_code(F.col("code"), F.col("message"), F.col("cancelled"))
    got = df.select(code.alias("code"), problems.error_view(code, F.col("message")).alias("view")).collect()
    assert [r["code"] for r in got] == ["RATE_LIMITED", "BROWSER_UNAVAILABLE", "CANCELLED", "OPERATION_FAILED", "OPERATION_FAILED"]
    assert [problems.view_of(r["view"])["error"].get("retryable", False) for r in got] == [True, True, False, False, False]


@pytest.mark.parametrize(
    "error,view",
    [
        (QueryError("INVALID_LIMIT", "0 to 100 rows"), {"code": "INVALID_LIMIT", "message": "0 to 100 rows"}), (OperationStopped("BUDGET_EXHAUSTED"), {"code": "BUDGET_EXHAUSTED", "message": "", "retryable": True}),
        (ConnectionResetError("gone"), {"code": "BROWSER_UNAVAILABLE", "message": "gone", "retryable": True}), (ValueError("odd"), {"code": "OPERATION_FAILED", "message": "odd"}),
    ],
)
def test_exceptions_are_shown_alike(error, view):
    assert problems.problem_of(error) == {"error": view}


def test_shown_rows_have_a_default():
    assert [problems.shown(n) for n in (None, 0, -1, 7)] == [10, 10, 10, 7]


def test_evidence_is_superseded_by_key_and_pruned(spark, tmp_path):
    e = Evidence(Store(spark, str(tmp_path / "store")))
    at = lambda day: f"2024-01-{day:02d} 00:00:00"

    def put(kind, schema, *rows):
        e.put(kind, spark.createDataFrame(list(rows), schema).withColumn("updated", F.col("updated").cast("timestamp")))

    assert e.get("sources", ["j"]) is None and e.latest_snapshots() is None
    put("snapshots", "id string, ref string, text string, updated string", ("s1", "a", "old", at(1)), ("s2", "a", "new", at(3)), ("s3", "b", "one", at(2)), (None, "c", "lost", at(2)))
    put("snapshots", "id string, ref string, text string, updated string", ("s2", "a", "newer", at(4)), ("s3", "b", "older", at(1)))
    assert {r["ref"]: r["text"] for r in e.latest_snapshots().collect()} == {"a": "newer", "b": "one"}
    assert [(r["id"], r["text"]) for r in e.get("snapshots", ["s2", "none"]).collect()] == [("s2", "newer")]
    put("artifacts", "key string, state string, incoming string, updated string", ("k1", "clicked", "in1", at(10)), ("k2", "clicked", "in2", at(1)), ("k3", "done", "in3", at(10)), ("k1", "clicked", "", at(2)))
    as_of = F.lit(at(12)).cast("timestamp")
    assert [tuple(r) for r in e.pending(as_of).collect()] == [("k1", "in1")]
    put("operations", "id string, body string, updated string", ("o1", "{}", at(1)), ("o2", "{}", at(11)))
    e.prune(as_of)
    assert [r["id"] for r in e.all("operations").collect()] == ["o2"] and e.all("artifacts").count() == 3 and e.all("snapshots").count() == 3
