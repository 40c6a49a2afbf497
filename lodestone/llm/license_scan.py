"""License scan: ordered signature rules behind a keyword filter, overlaps settled by containment.

A text that holds none of a few stems is done after one pass. For the others each rule whose
keyword occurs runs its pattern; a detection inside another one of higher priority, or of the same
priority and longer or earlier in the rule list, is suppressed. Beside the rules, the base phrases
are counted on the sequence of words. The rule table is a constant. DataFrame functions only.

Defined cases: a null text counts as empty: no word, no label, score 0; repeated rows give equal
results; an empty table gives an empty result; scan() passes all other columns through, those with
the names of its results as `<name>_input`.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bind, find_all, make_room, running, text_of
from .license_rules import CONFIDENCE, STEMS, rules

MARKS = r"[\s*#/]+"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Fixed values of the base scan: phrase and label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def _rule_column() -> Column:
    """The rules by keyword, so that a keyword is looked for once however many rules it gates."""
    by_keyword: dict[str, list[Column]] = {}
    for n, r in enumerate(rules()):
        rule = F.struct(F.lit(n).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.also).alias("also"))
        by_keyword.setdefault(re.sub(MARKS, " ", r.keyword), []).append(rule)
    return F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*v).alias("rules")) for k, v in by_keyword.items()])


def gate_text(low: Column) -> Column:
    """The text in which keywords are looked for: each run of white space and comment marks is one blank."""
    return F.regexp_replace(low, MARKS, " ")


def detections(low: Column, gate: Column) -> Column:
    """Detections of a lower-cased text that no other suppresses: (start, end, priority, rule, label)."""

    def of_rule(r: Column) -> Column:
        found = find_all(low, r["pattern"])
        return F.transform(
            F.when(r["also"] == "", found).otherwise(F.filter(found, lambda m: F.regexp_like(m["match"], r["also"]))),
            lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.char_length(m["match"])).alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label")),
        )

    held = F.filter(_rule_column(), lambda k: F.contains(gate, k["keyword"]))
    return F.flatten(F.transform(F.flatten(F.transform(held, lambda k: k["rules"])), of_rule))


def unsuppressed(found: Column) -> Column:
    """Detections that lie in no stronger one.

    By start, longest first, all that could hold a detection comes before it; so it is enough to
    know the furthest end so far of each priority and those above it.
    """
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["rule"].alias("rule"), d["label"].alias("label"))))

    def shown(d: Column) -> Column:
        def ends(priority: int) -> Column:
            return running(F.transform(d, lambda x: F.when(x["priority"] <= priority, -x["back"]).otherwise(-1)), F.greatest)

        def of(reach: Column) -> Column:
            free = F.filter(d, lambda x, i: F.coalesce(F.get(F.get(reach, x["priority"]), i - 1), F.lit(-1)) < -x["back"])
            return F.transform(free, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["priority"].alias("priority"), x["rule"].alias("rule"), x["label"].alias("label")))

        return bind(F.array(*[ends(p) for p in CONFIDENCE]), of)

    return bind(ordered, shown)


def blanks(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))


def base_places(padded: Column) -> Column:
    """Places of the base phrases in words that stand between single blanks: (word, label)."""
    none, parts = F.array().cast("array<struct<word:int,label:string>>"), []

    def place(label: str) -> Callable[[Column], Column]:
        return lambda m: F.struct((m["start"] - 1).alias("word"), F.lit(label).alias("label"))

    for phrase, label in PHRASES.items():
        # the blanks before a word are its number and one more
        found = find_all(padded, f"(?<= ){phrase}(?= )", measure=blanks)
        parts.append(F.coalesce(F.when(F.contains(padded, F.lit(f" {phrase} ")), F.transform(found, place(label))), none))
    return F.concat(*parts)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, base (places of base phrases), detections and score."""
    low, gate, padded, found = F.col("__low"), F.col("__gate"), F.col("__padded"), F.col("__found")
    docs = make_room(docs, "n_words", "base", "detections", "score")
    held = F.lit(False)
    for stem in STEMS:
        held = held | F.contains(gate, F.lit(re.sub(MARKS, " ", stem)))
    none = F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string>>")
    df = docs.withColumn("__low", ascii_lower(text_of(docs, text)))
    df = df.withColumn("__padded", F.concat(F.lit(" "), F.btrim(F.regexp_replace(low, BREAKS, " "), F.lit(" ")), F.lit(" ")))
    df = df.withColumn("__gate", gate_text(low)).withColumn("__found", F.when(held, detections(low, gate)))
    words = F.when(padded == "  ", 0).otherwise(blanks(padded) - 1)
    df = df.withColumns({"n_words": words.cast("long"), "base": base_places(padded), "detections": F.when(F.size(found) > 0, unsuppressed(found)).otherwise(none)})
    score = F.lit(0.0)
    for priority, confidence in CONFIDENCE.items():
        score = F.when(F.array_contains(F.col("detections")["priority"], priority), F.greatest(score, F.lit(confidence))).otherwise(score)
    score = F.when(F.size("base") > 0, F.greatest(score, F.lit(0.9))).otherwise(score)
    return df.withColumn("score", score).drop("__low", "__gate", "__padded", "__found")


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    words = F.transform("base", lambda b: b["word"].cast("long"))
    base, more = F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), "score",
    )
