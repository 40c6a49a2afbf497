"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain. Expectation-maximisation on the table of
vote patterns, which has at most 3^9 rows whatever the corpus, estimates how often each labeller
votes what for good and for bad documents, without any true label. The posteriors of a bounded
sample of documents train a linear scorer on hashed word shapes and document statistics, and the
scorer decides on every document.

Texts are read once: what describes a document, its votes and its features, is staged, and both the
fit and the scores come from there. The training sample is bounded by SAMPLE texts, taken by hash
over the whole table and weighted by their rows; votes, patterns and scores cover all rows and whole texts.

Defined cases: a null text counts as empty; a text without words gets no bad vote and is scored like
any other; repeated rows get equal scores; on an empty table the result is empty; good_documents()
passes all columns through, whatever they are called.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, ship, stage

SAMPLE = 8192
DIMENSIONS = 2048
WINDOW = 100
"""Words in which distinct ones are counted, over and over through the whole text."""
SHAPES_KEPT = 300_000
"""Words whose shape a worker remembers before it starts anew; a bound on memory, not on results."""

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-?\"()")
_RUN = re.compile(r"[^\w\s.,;:'?\"()-]{2,}")
_PART = re.compile(r"[^\W\d_]+|\d+")


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSIONS


def _letters(part: str) -> str:
    """Lower case, capitalised or capitals."""
    if not part[0].isupper():
        return "a"
    return "A" if len(part) == 1 else "AA" if part.isupper() else "Aa"


class _Shapes(dict):
    """Word to its hashed shape and three flags: no letter or digit, end of a sentence, run of symbols."""

    def __missing__(self, word: str) -> int:
        if len(self) >= SHAPES_KEPT:
            self.clear()
        stem, mark = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
        if stem.isalpha():
            shape, flags = _letters(stem) + mark, 2 * (mark != "" and mark in ".!?")
        else:
            shape = _PART.sub(lambda m: "0" if m[0][0].isdigit() else _letters(m[0]), word)
            flags = 4 * (not any(map(str.isalnum, word))) + 2 * (mark != "" and mark in ".!?") + bool(_RUN.search(word))
        out = self[word] = 8 * _hash(f"w {shape}") + flags
        return out


_shapes = _Shapes()
STATISTICS = ("symbols", "capitals", "bare", "repeats", "distinct", "word_length", "ends", "runs", "row")


def describe(text: str) -> tuple[dict[str, float], int, int, np.ndarray]:
    """Statistics, number of words and of letters, and the word part of the features."""
    raw, words = text.encode(), text.split()
    n = len(words)
    some = max(n, 1)
    letters = len(raw) - len(raw.translate(None, LETTERS))
    upper = len(raw) - len(raw.translate(None, UPPER))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    ids = np.fromiter(map(_shapes.__getitem__, words), np.int64, n)
    table = np.bincount(ids, minlength=8 * DIMENSIONS).reshape(DIMENSIONS, 8)
    flags = table.sum(axis=0) / some
    same = bytes(map(eq, words, words[1:]))
    stats = (
        symbols / max(len(raw), 1), upper / max(letters, 1), float(flags[4:].sum()), sum(same) / some,
        sum([len(set(words[i : i + WINDOW])) for i in range(0, n, WINDOW)]) / some if n else 1.0, sum(map(len, words)) / some, float(flags[[2, 3, 6, 7]].sum()), float(flags[1::2].sum()), float(bytes(3 * [1]) in same),
    )
    return dict(zip(STATISTICS, stats, strict=True)), n, letters, table.sum(axis=1) / some


def votes(s: dict[str, float], n: int, letters: int) -> str:
    """A character per labeller: + good, - bad, 0 no opinion."""

    def vote(bad: bool, good: bool) -> str:
        return "-" if bad else "+" if good else "0"

    return "".join((
        vote(s["symbols"] > 0.02 and n >= 5, s["symbols"] < 0.005),
        vote(s["capitals"] > 0.3 and letters >= 20, s["capitals"] < 0.1),
        vote(s["bare"] > 0.05 and n >= 5, s["bare"] < 0.01),
        vote(s["repeats"] > 0.1 and n >= 10, s["repeats"] < 0.03),
        vote(s["distinct"] < 0.2 and n >= 50, s["distinct"] > 0.5),
        vote(n >= 20 and not 2.5 <= s["word_length"] <= 7, 3.5 <= s["word_length"] <= 6.5),
        vote(s["ends"] > 0.5 and n >= 10, 0.02 <= s["ends"] <= 0.25),
        vote(s["runs"] > 0.1 and n >= 5, s["runs"] == 0),
        vote(s["row"] > 0, s["repeats"] < 0.05),
    ))


def features(s: dict[str, float], n: int, shapes: np.ndarray) -> np.ndarray:
    """Hashed features: square roots of the shares of word shapes, and statistics in steps."""
    x = np.sqrt(shapes)
    for name, value in s.items():
        step = min(12, int(math.log2(1 + 200 * value))) if name not in ("word_length", "distinct") else min(12, int(value if name == "word_length" else 10 * value))
        x[_hash(f"s {name} {step}")] += 1.0
    x[_hash(f"n {min(12, int(math.log2(n + 1)))}")] += 0.5
    return x


def fit_labellers(patterns: dict[str, int], rounds: int = 50_000, belief: tuple = ((0.01, 0.4), (0.02, 0.02))) -> tuple[dict[str, float], np.ndarray, float]:
    """EM over vote patterns: posterior of good per pattern, vote rates [labeller, class, vote], share of good.

    Rates are of the votes cast, bad and good; an abstention says nothing. They are estimated with a
    prior: for bad and for good documents a weight, as a part of the corpus, and the share of bad
    votes that it holds, which says which class is which; of the share, one document of each class is
    believed in beforehand. No rate or share is set or bounded. It ends when no posterior moves, and fails
    where that takes more than `rounds`.
    """
    if not patterns:
        return {}, np.zeros((0, 2, 2)), 1.0
    names = sorted(patterns)
    w = np.array([patterns[p] for p in names], float)
    hot = np.array([[(c == "-", c == "+") for c in p] for p in names], float)
    good = np.where(hot[:, :, 0].any(axis=1), 0.05, 0.95)
    held = w.sum() * np.array([[weight * bad, weight * (1 - bad)] for weight, bad in belief])
    share = 0.5
    for _ in range(rounds):
        both = np.stack([1 - good, good], axis=1) * w[:, None]
        rates = np.einsum("pc,plv->lcv", both, hot) + held + 1e-9
        rates /= rates.sum(axis=2, keepdims=True)
        share = float((both[:, 1].sum() + 1) / (w.sum() + 2))
        log = np.einsum("plv,lcv->pc", hot, np.log(rates)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            return dict(zip(names, good.tolist(), strict=True)), rates, share
    raise RuntimeError(f"the labellers' rates have not settled in {rounds} rounds")


def fit_scorer(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam from zero; deterministic."""
    share = np.full(len(x), 1 / max(len(x), 1)) if weight is None else weight / max(weight.sum(), 1e-9)
    x, w = x.astype(np.float64), np.zeros(x.shape[1] + 1)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (share * (p - y)) + decay * np.append(w[:-1], 0)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


class QualityModel:
    """Labeller posteriors by vote pattern and the scorer's weights; both of bounded size."""

    def __init__(self, posteriors: dict[str, float], weights: np.ndarray, bias: float, share: float):
        self.posteriors, self.weights, self.bias, self.share = posteriors, weights, bias, share

    def scores(self, sizes: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scores of rows of features that lie one behind the other."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        z = np.bincount(owner, weights=self.weights[at] * value, minlength=len(sizes)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def score(self, text: str) -> tuple[float, float, str]:
        """Score, posterior of the votes and votes of one text."""
        pattern, at, value = described(text)
        return float(self.scores(np.array([len(at)]), at, value)[0]), self.posteriors.get(pattern, self.share), pattern


def described(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """Votes, and the places and values of the features that are not zero."""
    s, n, letters, shapes = describe(text)
    row = features(s, n, shapes)
    at = np.flatnonzero(row)
    return votes(s, n, letters), at.astype(np.int16), row[at].astype(np.float32)


MORE = T.StructType().add("__pattern", T.StringType()).add("__at", T.ArrayType(T.ShortType())).add("__value", T.ArrayType(T.FloatType()))


def describe_all(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the votes and features of each row; the only pass over the texts."""
    ship(docs.sparkSession)
    at, schema = docs.columns.index(text), T.StructType([*docs.schema.fields, *MORE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(x.as_py() or "") for x in batch.column(at)]
            ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int32)
            places = pa.array(np.concatenate([np.zeros(0, np.int16), *(r[1] for r in rows)]))
            values = pa.array(np.concatenate([np.zeros(0, np.float32), *(r[2] for r in rows)]))
            new = [pa.array([r[0] for r in rows], pa.string()), pa.ListArray.from_arrays(pa.array(ends), places), pa.ListArray.from_arrays(pa.array(ends), values)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "__pattern", "__at", "__value"])

    return docs.mapInArrow(run, schema)


def fit(seen: DataFrame, sample: int = SAMPLE, text: str = "text") -> QualityModel:
    """Fits the labellers on all rows of describe_all() and the scorer on at most `sample` of their texts.

    Texts are taken in the order of their hash, each once and weighted by its number of rows, so no text
    fills the sample, however often it occurs, and equal tables give equal models.
    """
    key = F.xxhash64(F.coalesce(seen[text].cast("string"), F.lit("")))
    patterns = {r["__pattern"]: r["n"] for r in seen.groupBy("__pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    posteriors, _, good = fit_labellers(patterns)
    texts = seen.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    share = min(1.0, 1.25 * sample / max(texts, 1))
    near = seen.select(key.alias("key"), "__pattern", "__at", "__value").where(F.pmod("key", F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    once = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("__pattern", "__at", "__value")))
    rows = once.orderBy("key").limit(sample).collect()
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        x[i, r["__at"]] = r["__value"]
    weights, bias = fit_scorer(x, np.array([posteriors[r["__pattern"]] for r in rows]), np.array([r["n"] for r in rows], float))
    return QualityModel(posteriors, weights, bias, good)


def train(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """The model of a table."""
    seen = stage(_slim(describe_all(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))), "described")
    model = fit(seen, sample)
    release(seen)
    return model


def _slim(seen: DataFrame) -> DataFrame:
    """Without the text, of which a hash stays."""
    return seen.withColumn("text", F.xxhash64(F.coalesce("text", F.lit(""))))


def _scored(seen: DataFrame, model: QualityModel) -> DataFrame:
    """describe_all()'s rows with __score and __posterior, without votes and features."""
    names = [f for f in seen.schema.fields if f.name not in ("__at", "__value")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            lists = table["__at"].combine_chunks(), table["__value"].combine_chunks()
            at, value = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            scores = model.scores(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False), at, value)
            posteriors = [model.posteriors.get(p, model.share) for p in table["__pattern"].to_pylist()]
            out = table.select([f.name for f in names]).append_column("__score", pa.array(scores, pa.float64())).append_column("__posterior", pa.array(posteriors, pa.float64()))
            yield from out.combine_chunks().to_batches()

    return seen.mapInArrow(run, T.StructType([*names, *T.StructType().add("__score", T.DoubleType()).add("__posterior", T.DoubleType()).fields]))


def score(docs: DataFrame, model: QualityModel | None = None, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score, posterior, votes, kept), by a given model or by the table's own."""
    seen = _slim(describe_all(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    if model is None:
        seen = stage(seen, "described")
        model = fit(seen)
    out = _scored(seen, model)
    return out.select("doc_id", F.col("__score").alias("score"), F.col("__posterior").alias("posterior"), F.col("__pattern").alias("votes"), (F.col("__score") >= threshold).alias("kept"))


def good_documents(docs: DataFrame, model: QualityModel | None = None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs, unchanged, that the scorer keeps; no text is shuffled."""
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # so that no name clashes
    text = f"c{docs.columns.index(text)}"
    seen = describe_all(own, text)
    if model is None:
        seen = stage(seen, "described")
        model = fit(seen, text=text)
    return _scored(seen, model).where(F.col("__score") >= threshold).select(*own.columns).toDF(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs)
