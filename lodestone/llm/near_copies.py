"""Near copies by Jaccard similarity of word shingles, beside the links of SimHash.

Texts with the same set of shingles are one node. MinHash keys bring pairs together: 48 bands of
six minima each, of which a pair at similarity 0.8 shares none with probability 5e-7; fewer minima
would gather all texts that share a long passage. A byte of each of the 288 minima makes a sketch: a
pair whose sketches agree in fewer than LIKELY places is at 0.8 with a probability below 1e-6 and is
dropped. What is left is verified on whole sets of 64-bit shingle hashes, with integers, which only
these texts make. Pairs within three bits of SimHash are linked as well.

A bucket's pairs are not formed at once: members are first compared with one pivot a bucket, which
is the same one in all buckets that a group of copies shares, and from then on only pairs whose ends
are still in different components count. When pivots link few, all those pairs are looked at where
their bucket is read as a stream: by sketches, which leave the members that may have a partner, then
these by their whole sets. Only links leave a bucket, so no table grows with the square of its size.

Defined cases: as in SimHash; a text without words has no MinHash keys; rows without doc_id take part
in the links of SimHash only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, release, ship, small_batches, stage
from .simhash import links, shingle_hashes, simhash_of

BANDS, ROWS = 48, 6
_RNG = np.random.default_rng(20)
XOR, ODD = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64), _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
AT_ONCE = 1 << 11
LIKELY = 196
"""Of 288 bytes; at similarity 0.8 they agree in 230 on average, with a deviation of 6.8."""
PAIRS_PER_MEMBER = 4
"""Up to so many open pairs for each bucket member, all are verified at once, without more pivots."""


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def set_id(items: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(items.tobytes(), 7)


def minima(items: np.ndarray) -> np.ndarray:
    """Least hash of a set that is not empty, for each of BANDS * ROWS hash functions."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), AT_ONCE):
        np.minimum(low, ((items[at : at + AT_ONCE] ^ XOR) * ODD).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """MinHash keys, one for each band."""
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def sketch(low: np.ndarray) -> bytes:
    """A byte of each minimum: the low one, as a minimum's high bytes are all small."""
    return (low & np.uint64(0xFF)).astype(np.uint8).tobytes()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of at least 0.8 of two sorted sets."""
    if not len(x) or 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def sketches(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fp, node, keys, sketch): SimHash, id of the shingle set, MinHash keys and sketch, both empty without words."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, nodes, keys, short = [], [], [], []
            for x in batch.column(1):
                found = list(shingle_hashes(x.as_py() or "", shingle))
                items = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
                low = minima(items) if len(items) else None
                fps.append(simhash_of(found))
                nodes.append(set_id(items))
                keys.append(np.zeros(0, np.int64) if low is None else band_keys(low).view(np.int64))
                short.append(b"" if low is None else sketch(low))
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed(fps), signed(nodes), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["doc_id", "fp", "node", "keys", "sketch"])

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long, node long, keys array<long>, sketch binary")


def sets_of(texts: DataFrame, shingle: int) -> DataFrame:
    """A row (node, items) per distinct shingle set of a column of texts; items are the hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py() or "", shingle) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([set_id(x) for x in sets], np.uint64).view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "items"])

    return texts.mapInArrow(run, "node long, items binary").groupBy("node").agg(F.any_value("items").alias("items"))


def _kept(pairs: DataFrame, values: DataFrame, column: str, ok) -> DataFrame:
    """Of the pairs (u, v) those whose two values pass; values has a row per node."""
    x, y = (values.select(F.col("node").alias(end), F.col(column).alias(f"{end}_value")) for end in ("u", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([ok(a.as_py(), b.as_py()) for a, b in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in (0, 1)], ["u", "v"])

    return pairs.join(x, "u").join(y, "v").select("u", "v", "u_value", "v_value").mapInArrow(run, "u long, v long")


def alike(a: bytes, b: bytes) -> bool:
    """Whether two sketches agree in so many places that a similarity of 0.8 is possible."""
    return int(np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8))) >= LIKELY


def similar_sets(a: bytes, b: bytes) -> bool:
    return similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))


def asked_sets(ends: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The sets (node, items) of some nodes, made from their texts; nodes has (node, first, sketch)."""
    # by sort-merge at every size: what is asked for grows with the corpus
    texts = docs.join(nodes.join(ends, "node", "left_semi").select(F.col("first").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select("text")
    with small_batches(docs.sparkSession, 500):
        return stage(sets_of(texts, shingle), "sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Of the pairs (u, v) those that are similar, a staged table."""
    likely = stage(_kept(pairs, nodes, "sketch", alike), "likely")
    sets = asked_sets(likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct(), nodes, docs, shingle)
    with small_batches(docs.sparkSession, 500):
        out = stage(_kept(likely, sets, "items", similar_sets), "verified")
    release(likely, sets)
    return out


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A table for each key of sorted batches."""
    held: list[pa.Table] = []
    current = None
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
        for a, b in zip(edges, edges[1:], strict=False):
            if held and key[a] != current:
                yield pa.concat_tables(held)
                held = []
            current = key[a]
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield pa.concat_tables(held)


def _likely(bucket: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, later members of other components that i's sketch allows, components); links may change the components on the way."""
    n, component = bucket.num_rows, bucket["component"].to_numpy().copy()
    short = np.frombuffer(b"".join(bucket["sketch"].to_pylist()), np.uint8).reshape(n, -1)
    for i in range(n - 1):
        other = np.flatnonzero(component[i + 1 :] != component[i]) + i + 1
        for part in np.array_split(other, len(other) // AT_ONCE + 1):
            near = part[np.count_nonzero(short[part] == short[i], axis=1) >= LIKELY]
            if len(near):
                yield i, near, component


def _with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the members of buckets (key, node, component, sketch) those that may be similar to one of another component."""
    for bucket in _buckets(batches):
        hit = np.zeros(bucket.num_rows, bool)
        for i, near, _ in _likely(bucket):
            hit[i] = True
            hit[near] = True
        if hit.any():
            yield from bucket.filter(pa.array(hit)).combine_chunks().to_batches()


def _linked_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that connect what is similar in buckets (key, node, component, sketch, items)."""
    for bucket in _buckets(batches):
        node = bucket["node"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in bucket["items"].to_pylist()]
        out = []
        for i, near, component in _likely(bucket):
            for j in near.tolist():
                if component[i] != component[j] and similar(sets[i], sets[j]):
                    out.append((node[i], node[j]))
                    component[component == component[j]] = component[i]
        if out:
            u, v = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links_of_buckets(open_: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Links (u, v) that connect all that is similar in the buckets (key, node, component), a staged table."""
    rows = open_.select("key", "node", "component").join(nodes.select("node", "sketch"), "node").select("key", "node", "component", "sketch")
    some = stage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_with_partners, rows.schema), "partners")
    sets = asked_sets(some.select("node").distinct(), nodes, docs, shingle)
    whole = some.join(sets, "node").select("key", "node", "component", "sketch", "items")
    with small_batches(docs.sparkSession, 500):
        out = stage(whole.repartition("key").sortWithinPartitions("key").mapInArrow(_linked_members, "u long, v long").distinct(), "verified")
    release(some, sets)
    return out


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs (u, v), u < v, of rows (a, b)."""
    return found.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def jaccard_links(docs: DataFrame, rows: DataFrame, known: DataFrame, shingle: int) -> DataFrame:
    """Links (u, v) between nodes that, with the known ones, connect all verified pairs of the buckets; rows, a staged table, is removed."""
    per_node = rows.where("doc_id is not null and size(keys) > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch"))
    all_nodes = stage(per_node, "nodes")
    keyed = all_nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = stage(keyed.join(shared, "key").select("key", "node", "n"), "members")
    # the text that others were copied from meets more of them than they meet each other
    degree = sized.groupBy("node").agg(F.sum("n").alias("degree"))
    members = stage(sized.join(degree, "node").select("key", "node", "degree"), "members")
    release(sized)
    nodes = stage(all_nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "first", "sketch"), "sketched")
    release(all_nodes, rows)
    found, useful, turn = known, True, 0
    while True:
        parts = components(found)
        labelled = stage(members.join(parts, "node", "left").select("key", "node", "degree", F.coalesce("component", "node").alias("component")), "labelled")
        # buckets whose members are all in one component are done
        per_part = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        sizes = stage(per_part.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inner"), F.max_by("component", F.struct("n", "component")).alias("main")).where("n * n > inner"), "sizes")
        open_ = stage(labelled.join(sizes.select("key", "main"), "key"), "open")
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("inner")) / 2), F.lit(0.0))).first()
        release(parts, labelled, sizes)
        rest = total[1] <= PAIRS_PER_MEMBER * total[0] or not useful
        if not total[0]:
            release(open_, members, nodes)
            return found
        if rest:
            more = links_of_buckets(open_, nodes, docs, shingle)
        else:
            # of the largest component, first the member that meets most others, then any: what is outside is compared with it
            rank = F.struct("degree", F.xxhash64("node")) if not turn else F.struct(F.xxhash64(F.lit(turn), "key", "node"))
            pivot = open_.where("component = main").groupBy("key").agg(F.max_by(F.struct("node", "component"), rank).alias("p"))
            pairs = stage(_pairs(open_.join(pivot, "key").where("component <> p.component").select(F.col("node").alias("a"), F.col("p.node").alias("b"))), "pairs")
            more = verified(pairs, nodes, docs, shingle)
            useful, turn = 10 * more.count() > pairs.count(), turn + 1
            release(pairs)
        both = stage(found.union(more), "found")
        release(open_, more, found)
        found = both
        if rest:
            release(members, nodes)
            return found


def near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Rows (doc_id, component_id): the smallest doc_id reachable by links of SimHash or Jaccard similarity."""
    whole = stage(sketches(docs, shingle), "sketches")
    rows = stage(whole.select("doc_id", "fp", "node"), "rows")
    classes = stage(rows.groupBy("fp").agg(F.min("node").alias("low")), "classes")
    same = rows.join(classes, "fp").where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v")).distinct()
    near = stage(links(classes.select("fp").repartition("fp")), "links")
    u, v = classes.select(F.col("fp").alias("u"), F.col("low").alias("a")), classes.select(F.col("fp").alias("v"), F.col("low").alias("b"))
    known = stage(near.join(u, "u").join(v, "v").select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").union(same), "known")
    found = jaccard_links(docs, whole, known, shingle)
    parts = components(found)
    named = rows.join(parts, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    low = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = stage(named.join(low, "component").select("doc_id", "component_id"), "near")
    release(rows, classes, near, found, parts)
    return out
