"""Benchmark decontamination by winnowing.

Both sides are fingerprinted alike: of every window of consecutive words the least hash of its
k-grams is kept. A window that stands in a document and in an item has the same words, hence the same
least k-gram on both sides, so every shared span of at least one window is found, without exception.
Fingerprints are joined, and a hit is extended to each whole window that carries it: the windows' own
words are compared in the join, so a hash never decides.

A bit map of the benchmark's fingerprints, bounded in size, goes to the tasks that read documents;
what it lets through by chance falls in the join, and what it has never falls. So documents are read
once, and only windows that may be hits are shuffled. Documents with the same set of windows share
one look-up of the items.

Defined cases: null, empty and wordless texts have no words and no hits; repeated rows each get their
row; a row without doc_id is a row like any other; repeated items and item rows of one id count once;
an item without id marks words, but is not counted or named; an empty benchmark hits nothing; texts of
any length are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, ship, small_batches, stage

FILTER_BITS = 26
"""Largest size of the bit map, as a power of two: 8 MB. Beyond it more windows pass, none is lost."""

LONG_WORD = 4096
"""Longer words, in bytes, are hashed one by one."""

BLOCK = 1 << 20
"""Bytes of text hashed at a time."""

_byte = np.arange(256, dtype=np.uint8)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)
IS_WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (_byte >= 0x80)
POWERS = np.multiply.accumulate(np.full(LONG_WORD, 0x9E3779B97F4A7C15, np.uint64))


def gram_and_window(words: int) -> tuple[int, int]:
    """k and w of a window of so many words: w k-grams of k words."""
    k = (words + 1) // 2
    return k, words - k + 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64 (Steele, Lea and Flood, 2014)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Lower-cased words of a column of texts: byte ranges, hashes and the row that each is in."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        inside = IS_WORD[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = at[1:-1]  # a word ends with its text
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row_at = np.searchsorted(self.start, at)  # row r has words row_at[r] to row_at[r + 1]
        self.bytes = LOWER[raw].tobytes()
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.zeros(len(self.start), np.uint64)
        lower, size = np.frombuffer(self.bytes, np.uint8), self.end - self.start
        edges = np.unique(np.append(np.searchsorted(self.start, np.arange(0, len(lower), BLOCK)), len(self.start)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            n = np.minimum(size[a:b], LONG_WORD)
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) - np.repeat(ends - n, n)
            values = (lower[place + np.repeat(self.start[a:b], n)].astype(np.uint64) + np.uint64(1)) * POWERS[place]
            out[a:b] = np.add.reduceat(values, ends - n)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = xxhash.xxh64_intdigest(self.bytes[self.start[i] : self.end[i]])
        return mixed(out)

    def fingerprints(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of so many words, and each window's least k-gram hash."""
        k, w = gram_and_window(words)
        n = len(self.hash) - words + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        gram = self.hash[: n + w - 1].copy()
        for j in range(1, k):
            gram = gram * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + n + w - 1]
        gram = mixed(gram)
        least = gram[:n]
        for j in range(1, w):
            least = np.minimum(least, gram[j : j + n])
        row = np.searchsorted(self.row_at, np.arange(n), side="right")
        whole = np.arange(n) + words <= self.row_at[np.minimum(row, len(self.row_at) - 1)]
        return np.flatnonzero(whole), least[whole]

    def text(self, first: int, words: int) -> str:
        return b" ".join([self.bytes[self.start[i] : self.end[i]] for i in range(first, first + words)]).decode()


def item_windows(items: DataFrame, words: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id, size, fp, words): all windows of all items; a shorter item is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column(1))
            number = np.diff(w.row_at)
            rows: list[tuple] = []
            for size in sorted({min(words, int(n)) for n in number if n}):
                first, fp = w.fingerprints(size)
                row = np.searchsorted(w.row_at, first, side="right") - 1
                fits = number[row] >= words if size == words else number[row] == size
                rows += [(r, size, f, w.text(i, size)) for r, i, f in zip(row[fits].tolist(), first[fits].tolist(), fp[fits].view(np.int64).tolist(), strict=True)]
            at, size, fp, own = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(size, pa.int32()), pa.array(fp, pa.int64()), pa.array(own, pa.string())], ["item_id", "size", "fp", "words"])

    ship(items.sparkSession)
    kind = items.schema[item_id].dataType.simpleString()
    return items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(run, f"item_id {kind}, size int, fp long, words string")


def bit_map(windows: DataFrame) -> tuple[np.ndarray, int]:
    """The fingerprints of windows as a bit map of at most 2**FILTER_BITS bits, and its mask."""
    bits = min(FILTER_BITS, max(12, (32 * windows.count()).bit_length()))
    low = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1))
    words = windows.select(F.shiftright(low, 6).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(fp & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros((1 << bits) // 64, np.int64)
    found = words.toArrow()  # no longer than the map
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64), (1 << bits) - 1


CANDIDATES = pa.list_(pa.struct([("fp", pa.int64()), ("size", pa.int32()), ("words", pa.string()), ("starts", pa.list_(pa.int32()))]))


def candidates(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, n_words and the windows whose fingerprint the benchmark may have, each with its places."""
    spark = docs.sparkSession
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # ten at most by default
    bits, mask = bit_map(windows)
    sent = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            w = Words(batch.column(1))
            found: list[dict[tuple, list[int]]] = [{} for _ in range(batch.num_rows)]
            for size in sizes:
                first, fp = w.fingerprints(size)
                low = fp & np.uint64(mask)
                hit = (known[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
                first, fp = first[hit], fp[hit].view(np.int64)
                row = np.searchsorted(w.row_at, first, side="right") - 1
                for r, i, f, at in zip(row.tolist(), first.tolist(), fp.tolist(), (first - w.row_at[row]).tolist(), strict=True):
                    found[r].setdefault((f, size, w.text(i, size)), []).append(at)
            rows = [[{"fp": f, "size": s, "words": t, "starts": at} for (f, s, t), at in own.items()] for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(w.row_at), pa.int64()), pa.array(rows, CANDIDATES)], ["doc_id", "n_words", "found"])

    ship(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, found array<struct<fp: long, size: int, words: string, starts: array<int>>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def covered(spans: Column) -> Column:
    """How many words an array of (start, end) covers."""

    def add(acc: Column, x: Column) -> Column:
        new = F.greatest(F.lit(0), x["end"] - F.greatest(acc["upto"], x["start"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["upto"], x["end"]).alias("upto"))

    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")), add, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans (maximal runs of places of windows), n_items, items (ids as strings, sorted).

    A group that is collected is one document's windows or the items of one set of windows.
    """
    spark = docs.sparkSession
    own = stage(item_windows(items, words, item_id, item_text).distinct(), "item-windows")
    windows = stage(own.select("fp", "size", "words").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    with small_batches(spark):
        found = stage(candidates(docs, windows, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "candidates")
    ids = own.where(F.col("item_id").isNotNull()).join(windows, ["fp", "size", "words"]).select("window", F.col("item_id").cast("string").alias("item")).distinct()
    hits = found.where(F.size("found") > 0).select("row", F.inline("found")).join(windows, ["fp", "size", "words"])
    place = F.transform("starts", lambda s: F.struct(s.alias("start"), (s + F.col("size")).alias("end")))
    per_row = stage(hits.groupBy("row").agg(F.flatten(F.collect_list(place)).alias("places"), F.array_sort(F.collect_set("window")).alias("windows")).select("row", "windows", F.sort_array("places").alias("spans"), covered(F.col("places")).alias("n_hit")), "hits")
    sets = stage(per_row.select("windows").distinct().withColumn("set", F.monotonically_increasing_id()), "window-sets")
    named = sets.select("set", F.explode("windows").alias("window")).join(ids, "window").select("set", "item").distinct().groupBy("set").agg(F.sort_array(F.collect_list("item")).alias("items"))
    told = per_row.join(sets.join(named, "set", "left"), "windows").select("row", "n_hit", "spans", "items")
    out = found.select("row", "doc_id", "n_words").join(told, "row", "left")
    none = F.array().cast("array<string>")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"), F.coalesce("items", none).alias("items"))
    out = stage(out, "decontaminated")
    release(own, windows, found, per_row, sets)
    return out.select("doc_id", "n_words", "n_hit", "spans", F.size("items").cast("long").alias("n_items"), "items")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), dw AS (
  SELECT r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t
  FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, len(w) - m + 2)) AS u(i)
), hit AS (
  SELECT DISTINCT r, item_id, m, i FROM dw JOIN bw USING (m, t)
), words AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, m, i FROM hit), unnest(range(0, m)) AS u(k) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""
