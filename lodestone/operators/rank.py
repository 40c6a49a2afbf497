"""Evidence, scores, order, pool, selection and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans.expression import all_of, of_concepts, term
from lodestone.plans.planner import Channel, Plan

# Weights of tiers and document types, in the order they are tested.
FIRST_TIERS = ("SSCI", "SCI", "SCI-E", "A&HCI")
TYPE_WEIGHTS = (("博士", 0.72), ("硕士", 0.46), ("本科", 0.1), ("期刊", 0.55), ("会议", 0.52), ("报纸", 0.14))
BLEND = {"title": 0.32, "abstract": 0.28, "keywords": 0.12, "rrf": 0.20, "channels": 0.08, "coverage": 0.12}
QUALITY = {"tier": 0.45, "impact": 0.25, "annual": 0.20, "kind": 0.10}
RRF_K = 60.0


def tier_weight(tag: Column) -> Column:
    u = F.upper(tag)
    return (
        F.when(F.contains(u, F.lit("CSSCI")), 0.96).when(u.isin(*FIRST_TIERS), 1.0).when(F.contains(u, F.lit("北大核心")) | F.contains(u, F.lit("CSCD")), 0.94)
        .when(u == "EI", 0.9).when(F.contains(u, F.lit("AMI")) & F.contains(u, F.lit("核心")), 0.88).otherwise(0.0)
    )


def with_quality(papers: DataFrame, sources: DataFrame | None, as_of_year: int) -> DataFrame:
    """papers with tier, impact, annual, kind, quality and quality_known.

    sources has a row per source and is as small as the list of sources; the join's strategy is left
    to its measured size.
    """
    if sources is None:
        df = papers.withColumns({"tiers": F.array().cast("array<string>"), "composite": F.lit(None).cast("double"), "state": F.lit("unknown")})
    else:
        df = papers.withColumn("source_key", tx.source_key("source")).join(sources, "source_key", "left").drop("source_key")
    present = F.coalesce(F.col("state") == "present", F.lit(False))
    dated = F.col("cited").isNotNull() & (F.col("year") > 0) & (F.col("year") <= as_of_year)
    age = F.greatest(F.lit(1), as_of_year - F.col("year") + 1)
    kind = F.lit(0.0)
    for name, weight in reversed(TYPE_WEIGHTS):
        kind = F.when(F.contains("doc_type", F.lit(name)), weight).otherwise(kind)
    df = df.withColumns({
        "tier": F.when(present, F.coalesce(F.array_max(F.transform("tiers", tier_weight)), F.lit(0.0))).otherwise(0.0),
        "impact": F.when(present & F.col("composite").isNotNull(), 1 - F.exp(-F.greatest(F.lit(0.0), F.col("composite")) / 2)).otherwise(0.0),
        "annual": F.when(dated, 1 - F.exp(-F.greatest(F.lit(0), F.col("cited")).cast("double") / age / 3)).otherwise(0.0),
        "kind": F.coalesce(kind, F.lit(0.0)), "quality_known": present | dated,
    })
    quality = sum((F.col(c) * w for c, w in QUALITY.items()), F.lit(0.0))
    return df.withColumn("quality", quality).drop("tiers", "composite", "state")


def rrf(hits: DataFrame) -> DataFrame:
    """Reciprocal rank fusion per ref: (ref, rrf, channels)."""
    return hits.groupBy("ref").agg(F.sum(F.col("weight") / (RRF_K + F.col("position"))).alias("rrf"), F.countDistinct("channel").alias("channels"))


def rank(papers: DataFrame, plan: Plan, hits: DataFrame, sources: DataFrame | None, as_of_year: int) -> DataFrame:
    """Candidates (the refs of hits) with evidence, score and eligible.

    Only candidates are scored: the hits side is bounded by channels and pages.
    """
    query = F.array_distinct(tx.tokens(F.lit(" ".join(t for g in plan.concepts for t in g))))
    fused = rrf(hits)
    df = with_quality(papers.join(fused, "ref"), sources, as_of_year)
    text = tx.normalize(F.concat_ws(" ", "title", F.array_join("keywords", " "), "abstract"))
    df = df.withColumns({
        "e_title": tx.dice(query, tx.tokens("title")), "e_abstract": tx.dice(query, tx.tokens("abstract")), "e_keywords": tx.dice(query, tx.tokens(F.array_join("keywords", " "))),
        "coverage": tx.concept_coverage(text, plan.concepts),
    })
    parts = {
        "title": F.col("e_title"), "abstract": F.col("e_abstract"), "keywords": F.col("e_keywords"), "rrf": F.least(F.col("rrf") * 20, F.lit(1.0)),
        "channels": F.least(F.col("channels") / 3.0, F.lit(1.0)), "coverage": F.col("coverage"),
    }
    relevance = sum((parts[k] * w for k, w in BLEND.items()), F.lit(0.0)) / 1.12
    df = df.withColumn("relevance", relevance)
    score = F.col("relevance") * (0.35 + 0.65 * F.col("quality")) + 0.20 * F.col("quality")
    return df.withColumns({"score": score, "eligible": (F.col("relevance") >= 0.25) & (F.col("coverage") >= 0.5)})


ORDER = (F.desc, "eligible"), (F.desc, "score"), (F.asc, "ref")


def ordered(ranked: DataFrame) -> DataFrame:
    """ranked with rank from 1; candidates are bounded by channels and pages, so one task orders them."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*[f(c) for f, c in ORDER])).cast("long"))


def select(ranked: DataFrame, limit: int = 50) -> DataFrame:
    """Thresholded selection in rank order."""
    top = ranked.where("eligible").agg(F.greatest(F.lit(0.24), F.max("score") * 0.55).alias("floor"))
    q, r = F.col("quality"), F.col("relevance")
    good = ((r >= 0.35) & (F.col("coverage") == 1)) | (q >= 0.45) | ((q >= 0.25) & (r >= 0.35)) | (~F.col("quality_known") & (r >= 0.55))
    passed = ranked.where(F.col("eligible") & good).join(F.broadcast(top), F.col("score") >= F.col("floor")).drop("floor")  # one row
    return passed.orderBy(*[f(c) for f, c in ORDER]).limit(limit)


def pool_size(n: Column) -> Column:
    return F.least(n, F.when(n <= 30, n).when(n <= 100, 40).when(n <= 300, 60).otherwise(80))


def pool(ranked: DataFrame, metadata: str = "ranked") -> DataFrame:
    """Refs to enrich: none, all or the best by rank."""
    if metadata == "basic":
        return ranked.limit(0).select("ref")
    if metadata == "all":
        return ranked.select("ref")
    size = ranked.agg(pool_size(F.count(F.lit(1))).alias("size"))
    return ordered(ranked).join(F.broadcast(size), F.col("rank") <= F.col("size")).select("ref")  # one row


def feedback_keywords(ranked: DataFrame, plan: Plan, best: int = 10) -> DataFrame:
    """Keywords that eligible papers among the best share: (key, keyword, frequency), at most two."""
    original = [" ".join(t.split()).lower() for g in plan.concepts for t in g]
    top = ordered(ranked).where((F.col("rank") <= best) & F.col("eligible"))
    words = top.select("ref", "rank", F.posexplode("keywords").alias("pos", "keyword")).withColumn("key", tx.normalize("keyword"))
    words = words.where(F.char_length("key").between(2, 30) & ~F.col("key").isin(*original))
    once = words.groupBy("ref", "rank", "key").agg(F.min_by("keyword", "pos").alias("keyword"))
    shared = once.groupBy("key").agg(F.count(F.lit(1)).alias("frequency"), F.max_by("keyword", "rank").alias("keyword"))
    return shared.where("frequency >= 2").orderBy(F.desc("frequency"), F.asc("key")).limit(2).select("key", "keyword", "frequency")


def feedback_channels(ranked: DataFrame, plan: Plan) -> list[Channel]:
    """At most two more channels; only their keywords reach the driver."""
    rows = feedback_keywords(ranked, plan).collect()
    return [Channel(f"feedback{n}", all_of(of_concepts("subject", plan.concepts), term("subject", r["keyword"])), 0.8, r["keyword"]) for n, r in enumerate(rows, 1)]


def exclusion_reason() -> Column:
    """Why a candidate is not eligible; null if it is."""
    return F.when(F.col("eligible"), None).when(F.col("coverage") < 0.5, "coverage").otherwise("relevance")


def summary(ranked: DataFrame, selected: DataFrame) -> DataFrame:
    """One row of counts."""
    counts = ranked.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("eligible").alias("eligible"), F.countDistinct(F.when(F.col("tier") > 0, F.col("source"))).alias("quality_sources"),
    )
    return counts.join(selected.agg(F.count(F.lit(1)).alias("selected")))
