"""Expressions, planner, ranking rules."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import rank as rk
from lodestone.operators import retrieve
from lodestone.plans import expression as ex
from lodestone.plans.planner import Channel, Options, Plan, aliases, lexical_parts, make_plan, search_input

A, B, C = (ex.term("title", x) for x in ("alpha", "beta", "gamma"))


def truth(e, row):
    if not e.op:
        return e.value in (row[e.field] or "")
    values = [truth(i, row) for i in e.items]
    return not values[0] if e.op == "not" else all(values) if e.op == "and" else any(values)


def tree(rng, depth=0):
    if depth == 3 or rng.random() < 0.3:
        return rng.choice((A, B, C))
    if rng.random() < 0.3:
        return ex.none_of(tree(rng, depth + 1))
    return ex.Expression(op=rng.choice(("and", "or")), items=tuple(tree(rng, depth + 1) for _ in range(rng.randint(2, 3))))


def test_trees_keep_their_meaning(spark):
    rows = [(i, " ".join(w for w, on in zip(("alpha", "beta", "gamma"), bits, strict=True) if on) or None) for i, bits in enumerate(itertools.product((0, 1), repeat=3))]
    df = spark.createDataFrame(rows, "i int, title string")
    rng = random.Random(1)
    trees = [tree(rng) for _ in range(30)]
    got = df.select("i", *[ex.predicate(t).alias(f"t{n}") for n, t in enumerate(trees)]).collect()
    for r in got:
        for n, t in enumerate(trees):
            assert r[f"t{n}"] == truth(t, {"title": rows[r.i][1]}), ex.printed(t)
    for t in trees:
        try:
            branches = ex.branches(t)
        except ex.QueryError:
            continue
        for _, title in rows:
            assert any(all(truth(x, {"title": title}) != neg for x, neg in b) for b in branches) == truth(t, {"title": title})


@pytest.mark.parametrize(
    ("bad", "code"),
    [
        (ex.none_of(A), "UNBOUNDED_QUERY"), (ex.any_of(A, ex.none_of(B)), "UNBOUNDED_QUERY"), (ex.term("nope", "x"), "INVALID_CONDITION"), (ex.term("title", " "), "INVALID_CONDITION"),
        (ex.term("title", "x", "fuzzy"), "INVALID_MATCH"), (ex.Expression(op="not", items=(A, B)), "INVALID_NOT"), (ex.Expression(op="xor", items=(A, B)), "INVALID_OPERATOR"),
        (ex.Expression(op="and", items=(A,)), "INVALID_OPERATOR"), (ex.Expression(field="title", op="and", items=(A, B)), "INVALID_EXPRESSION"), (ex.term("subject", "x", "exact"), "QUERY_UNSUPPORTED"),
        (ex.all_of(*[ex.any_of(A, B)] * 6), "QUERY_TOO_COMPLEX"), (ex.term("title", "a'b\"c"), "QUERY_UNSUPPORTED"),
    ],
)
def test_refused_expressions(bad, code):
    with pytest.raises(ex.QueryError) as e:
        ex.validate(bad)
    assert e.value.code == code


def test_printing_and_anchor():
    e = ex.all_of(ex.term("subject", "a"), ex.any_of(ex.term("title", "b", "exact"), ex.none_of(ex.term("keywords", "c"))))
    assert ex.printed(e) == "SU='a' AND (TI=='b' OR NOT KY='c')"
    assert ex.anchor(ex.all_of(ex.none_of(A), B)) == "beta"
    assert [[neg for _, neg in b] for b in ex.validate(ex.all_of(ex.none_of(A), B))] == [[False, True]]


def test_planner():
    plan = make_plan("graph neural networks, C++ and privacy")
    assert plan.concepts == [["graph neural networks"], ["C++"], ["privacy"]] and [c.id for c in plan.channels] == ["q1", "q2", "q3"]
    assert lexical_parts("图神经网络 deep learning 隐私") == ["图神经网络", "deep learning", "隐私"]
    assert aliases("Wi-Fi 6 latency") == ["Wi-Fi 6 latency", "WiFi6 latency", "Wi-Fi6 latency"]
    assert aliases("WiFi 6月") == ["WiFi 6月"]
    assert "IEEE 802.11ax" in aliases("802.11ax")
    for groups in ([["a"]] * 9, [[]], [["x" * 81]], [[" "]]):
        with pytest.raises(ex.QueryError):
            make_plan(concept_groups=groups)
    with pytest.raises(ex.QueryError):
        search_input("a", expression=A)
    for bad in ({"mode": "x"}, {"limit": 101}, {"year_from": 1700}, {"year_from": 2020, "year_to": 2010}, {"sort": "x"}, {"view": "x"}, {"max_pages": 0}):
        with pytest.raises(ex.QueryError):
            Options(query="a", **bad).checked()
    assert search_input(expression=A)[0].target == 50


PAPER = "ref string, title string, abstract string, keywords array<string>, source string, year int, doc_type string, cited long"


def test_ranking_pair(spark):
    papers = spark.createDataFrame(
        [("a", "federated learning privacy", "privacy in federated learning", ["federated learning", "privacy"], "J One", 2024, "期刊", 30), ("b", "cooking rice", "", [], "J Two", 2024, "期刊", 900)], PAPER,
    )
    sources = spark.createDataFrame([("j one", ["CSSCI"], 2.0, "present"), ("j two", ["SCI"], 9.0, "present")], "source_key string, tiers array<string>, composite double, state string")
    hits = spark.createDataFrame([("a", c, 1, 1.0) for c in ("q1", "q2", "q3")] + [("b", "q1", 2, 1.0)], "ref string, channel string, position long, weight double")
    plan = make_plan(concept_groups=[["federated learning"], ["privacy"]])
    ranked = rk.rank(papers, plan, hits, sources, 2026)
    rows = {r.ref: r for r in ranked.collect()}
    assert rows["a"].eligible and not rows["b"].eligible
    assert rows["a"].tier == 0.96 and rows["b"].tier == 1.0
    assert abs(rows["a"].rrf - 3 / 61) < 1e-12 and rows["a"].coverage == 1
    assert [r.ref for r in rk.ordered(ranked).orderBy("rank").collect()] == ["a", "b"]
    assert [r.ref for r in rk.select(ranked).collect()] == ["a"]
    assert rk.summary(ranked, rk.select(ranked)).first().asDict() == {"candidates": 2, "eligible": 1, "quality_sources": 2, "selected": 1}


@pytest.mark.parametrize(("tag", "weight"), [("CSSCI 扩展", 0.96), ("ssci", 1.0), ("SCI-E", 1.0), ("A&HCI", 1.0), ("SCI X", 0.0), ("北大核心", 0.94), ("CSCD", 0.94), ("EI", 0.9), ("EI 期刊", 0.0), ("AMI核心", 0.88), ("", 0.0)])
def test_tiers(spark, tag, weight):
    assert spark.range(1).select(rk.tier_weight(F.lit(tag)).alias("w")).first().w == weight


def test_feedback_shares_one_keyword(spark):
    rows = [(f"r{i}", "t", "", ["Alpha", "shared  term", "Shared Term", "x", f"own{i}"], "s", 2020, "期刊", None) for i in range(3)]
    ranked = spark.createDataFrame(rows, PAPER).withColumns({"eligible": F.lit(True), "score": F.lit(1.0)})
    plan = make_plan(concept_groups=[["alpha"]])
    assert [tuple(r) for r in rk.feedback_keywords(ranked, plan).collect()] == [("shared term", "shared  term", 3)]
    channels = rk.feedback_channels(ranked, plan)
    assert channels[0].weight == 0.8 and ex.printed(channels[0].expression) == "SU='alpha' AND SU='shared  term'"


def test_simulated_source_gives_160_candidates(spark):
    """Three channels over overlapping ranges, five pages of twenty each."""
    import lodestone.operators.retrieve as r

    old, r.PAGE = r.PAGE, 20
    try:
        papers = spark.range(180).select(F.format_string("p%03d", "id").alias("ref"), F.when(F.col("id") < 120, "one").otherwise("").alias("title"), F.lit(2020).alias("year"), F.lit(None).cast("long").alias("cited"),
            F.when(F.col("id").between(30, 149), "two").otherwise("").alias("abstract"), F.when(F.col("id") >= 60, F.array(F.lit("three"))).otherwise(F.array()).cast("array<string>").alias("keywords"))
        channels = [Channel("q1", ex.term("title", "one")), Channel("q2", ex.term("abstract", "two")), Channel("q3", ex.term("keywords", "three"))]
        scanned = r.scan_all(papers, channels, ["zzz"], sort="citations")
        assert [x.known for x in r.rounds(scanned).orderBy("round").collect()] == [60, 100, 120, 140, 160]
        assert {x.channel: (x.pages, x.rows) for x in r.coverage(scanned).collect()} == {c: (5, 100) for c in ("q1", "q2", "q3")}
        assert r.hits(scanned).select("ref").distinct().count() == 160
        assert r.until_target(scanned, 110).agg(F.max("page")).first()[0] == 3
    finally:
        r.PAGE = old


def test_unknown_year_fails_bounds(spark):
    df = spark.createDataFrame([(0,), (2010,), (2020,)], "year int")
    assert sorted(r.year for r in df.where(retrieve.year_between(2015, 0)).collect()) == [2020]
    assert df.where(retrieve.year_between()).count() == 3
    assert Plan([], [], "structured").method == "structured"
