"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints link at three or fewer differing bits. The 64 bits are four blocks of 16: with three
errors one block is untouched, and of the other 48 bits one half of 24 holds at most one error. The
(23, 12) Golay code is perfect, so each word of 23 bits lies within three bits of one codeword.
A half's keys are the codeword indices of the word itself and of all words one bit away, which are
one or six; two halves one bit apart share one. So block and index, over four blocks and two
halves, bring every linked pair together in some bucket, and a random pair rarely.

Only distinct fingerprints are compared. A bucket yields a spanning forest of its verified links,
found by breadth-first search over the members not yet reached, never all its pairs. A large bucket is
first cut again: its members agree in one block, and of four parts of the other 48 bits three errors
leave one untouched, so linked members meet in one of the four cuts.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like
any other; texts of any length are hashed whole, in parts; repeated rows are one document; a row without
doc_id links like any other and names no component, so a component of such rows alone has none; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, release, ship, stage

HASHES_AT_ONCE = 1 << 16
WHOLE_BUCKET = 1024
GOLAY = 0b110001110101
"""Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the (23, 12) Golay code."""


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """64-bit hashes (uint64) of the word shingles, repeats included, in parts; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    for a in range(0, len(starts), HASHES_AT_ONCE):
        yield np.array([h(joined[i:j], 42) for i, j in zip(starts[a : a + HASHES_AT_ONCE], ends[a : a + HASHES_AT_ONCE], strict=True)], np.uint64)


def simhash_of(hashes: Iterable[np.ndarray]) -> int:
    """Bit i is set if it is in over half the hashes; 0 of none."""
    ones, n = np.zeros(64, np.int64), 0
    for some in hashes:
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(some)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included."""
    return simhash_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fp); fp is the fingerprint as a signed long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py() or "", shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY << (bit - 11)
    return word


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the high 12 and the low 11 bits, and the error pattern of each remainder."""
    high = np.array([_remainder(x << 11) for x in range(1 << 12)], np.int32)
    low = np.arange(1 << 11, dtype=np.int32)
    errors = np.zeros(1 << 11, np.int32)
    bits = [1 << i for i in range(23)]
    for i, a in enumerate(bits):
        errors[_remainder(a)] = a
        for j, b in enumerate(bits[:i]):
            errors[_remainder(a | b)] = a | b
            for c in bits[:j]:
                errors[_remainder(a | b | c)] = a | b | c
    return high, low, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each word of 23 bits."""
    high, low, errors = _golay()
    words = words.astype(np.int32)
    return (words ^ errors[high[words >> 11] ^ low[words & 0x7FF]]) >> 11


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of fingerprints (uint64): row numbers and keys, at most 48 for each."""
    rows, keys = [], []
    for block in range(4):
        exact = (fp >> np.uint64(16 * block) & np.uint64(0xFFFF)).astype(np.int64)
        rest = np.zeros_like(fp)
        for n, other in enumerate(b for b in range(4) if b != block):
            rest |= (fp >> np.uint64(16 * other) & np.uint64(0xFFFF)) << np.uint64(16 * n)
        for half in range(2):
            word = (rest >> np.uint64(24 * half) & np.uint64(0x7FFFFF)).astype(np.int64)
            near = np.stack([golay_index(word), *(golay_index(word ^ (1 << i)) for i in range(23))], axis=1)
            near.sort(axis=1)
            new = np.ones(near.shape, bool)
            new[:, 1:] = near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(new)
            rows.append(r)
            keys.append(((block * 2 + half) << 28) | (exact[r] << 12) | near[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _forest(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links among fingerprints (uint64) that keep their components together."""
    left, links = members, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                links += [(x, y) for y in found]
                front += list(found)
                left = left[~near]
    return links


def _bucket_links(members: np.ndarray, block: int, max_bits: int) -> Iterator[tuple[int, int]]:
    """The same for a bucket whose members agree in a block of 16 bits."""
    if len(members) <= WHOLE_BUCKET:
        yield from _forest(members, max_bits)
        return
    rest = np.zeros_like(members)
    for n, other in enumerate(b for b in range(4) if b != block):
        rest |= (members >> np.uint64(16 * other) & np.uint64(0xFFFF)) << np.uint64(16 * n)
    for part in range(4):
        value = rest >> np.uint64(12 * part) & np.uint64(0xFFF)
        order = np.argsort(value, kind="stable")
        for some in np.split(members[order], np.flatnonzero(np.diff(value[order])) + 1):
            yield from _forest(some, max_bits)


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (u, v) between distinct fingerprints fp that connect what lies within max_bits (at most 3)."""
    if max_bits > 3:
        raise ValueError("the keys cover up to three differing bits")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # parts of the bucket that may go on

        def found() -> Iterator[pa.RecordBatch]:
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(edge, len(key)))
            two = edge[size == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            more = [x for at, n in zip(edge[size > 2], size[size > 2], strict=True) for x in _bucket_links(fp[at : at + n], int(key[at]) >> 29, max_bits)]
            u, v = np.array(more, np.uint64).reshape(-1, 2).T
            u, v = np.append(fp[two], u).view(np.int64), np.append(fp[two + 1], v).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            fp, last = fp.view(np.uint64), int(np.searchsorted(key, key[-1]))
            if last or (held and held[-1][0][-1] != key[-1]):
                held.append((key[:last], fp[:last]))
                yield from found()
            held.append((key[last:], fp[last:]))
        if held:
            yield from found()

    ship(fps.sparkSession)
    keyed = fps.select("fp").mapInArrow(expand, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "u long, v long")


def near_duplicates(docs: DataFrame, max_bits: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest doc_id reachable by links."""
    rows = stage(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = stage(links(classes.repartition("fp"), max_bits), "links")
    parts = components(found)
    release(found)
    linked = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    linked = stage(linked, "linked")
    low = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stage(linked.join(low, "component").select("fp", "component_id"), "named")
    release(classes, parts, linked)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
