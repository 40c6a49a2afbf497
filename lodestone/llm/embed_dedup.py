"""Embedding near-dedup by int8 tile products with rigorous quantisation error bounds.

Equal vectors are one class. Classes are dealt to tiles; a task takes one pair of tiles, scales
each unit vector to int8 and multiplies tile by tile. Integers below 2^24 are exact in single precision
and 1,024 products of int8 stay below it, so up to 1,024 components are multiplied at a time and
the parts added in double precision: the product is exact in any number of dimensions. With u = s q + d and |d| known for each vector, the cosine differs from
the scaled product by at most |d_u| |s_v q_v| + |s_u q_u| |d_v| + |d_u| |d_v|: pairs further below
the threshold are done, pairs further above are links, and all between are computed anew in double
precision. A task returns per class the number of its links and one row that ties it to the rest of
its component in the task, never the pairs.

Defined cases: vectors that are null, zero or hold null or non-finite numbers link with nothing;
vectors of different length are not compared; repeated rows are vectors of their own; a row without
vec_id links with nothing and has no component; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, release, ship, stage

TILE = 4096
STRIP = 512
EXACT = 1024
"""Components whose int8 products sum up exactly in single precision: 1024 * 127^2 < 2^24."""
SLACK = 1e-6
"""Added to every error bound: above the rounding of four operations in single precision on values up to 2."""


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales and the norms of what quantisation lost, for rows of unit length."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    q = np.rint(unit / scale)
    return q.astype(np.int8), scale[:, 0], np.linalg.norm(unit - q * scale, axis=1)


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the cosine of each row of a with each row of b (double precision) reaches the threshold.

    The error bound e + f + 3 e f of a pair is at most a row's part plus a column's part. One
    comparison per pair drops what lies below; pairs within the bounds are computed anew.
    """
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    (qa, sa, ea), (qb, sb, eb) = quantised(ua), quantised(ub)
    row_part, column_part = ea * (1 + 3 * eb.max(initial=0)) + SLACK, eb
    out = np.zeros((len(a), len(b)), bool)
    parts = [slice(k, k + EXACT) for k in range(0, qa.shape[1], EXACT)]
    right = [np.ascontiguousarray(qb[:, p].T, np.float32) for p in parts]
    kind = np.float32 if len(parts) == 1 else np.float64
    columns, above = sb.astype(kind), column_part.astype(kind)
    for i in range(0, len(a), STRIP):
        strip = slice(i, i + STRIP)
        high = qa[strip, parts[0]].astype(np.float32) @ right[0]
        if len(parts) > 1:
            high = high.astype(np.float64)
            for p, r in zip(parts[1:], right[1:], strict=True):
                high += qa[strip, p].astype(np.float32) @ r
        high *= columns
        high *= sa[strip, None].astype(kind)
        high += above
        r, c = np.nonzero(high >= (threshold - row_part[strip, None]).astype(kind))
        cos = high[r, c].astype(np.float64) - column_part[c]
        sure = cos - row_part[r + i] - column_part[c] >= threshold
        out[r[sure] + i, c[sure]] = True
        r, c = r[~sure] + i, c[~sure]
        for k in range(0, len(r), 1 << 16):
            rr, cc = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            x, y = a[rr], b[cc]
            exact = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
            out[rr, cc] = exact >= threshold
    return out


def _ties(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) of each component of the links between ids a and b."""
    rows, cols = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    some = links[np.ix_(rows, cols)]
    row_left, col_left = np.ones(len(rows), bool), np.ones(len(cols), bool)
    nodes, roots = [], []
    for start in range(len(rows)):
        if not row_left[start]:
            continue
        row_left[start] = False
        front, got_rows, got_cols = [(True, start)], [start], []
        while front:
            is_row, at = front.pop()
            if is_row:
                new = np.flatnonzero(some[at] & col_left)
                col_left[new] = False
                got_cols += new.tolist()
            else:
                new = np.flatnonzero(some[:, at] & row_left)
                row_left[new] = False
                got_rows += new.tolist()
            front += [(not is_row, int(x)) for x in new]
        ids = np.unique(np.append(a[rows[got_rows]], b[cols[got_cols]]))
        nodes.append(ids)
        roots.append(np.full(len(ids), ids[0]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (none, none)


def tile_links(classes: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """Rows (first, n, root): a class, links it gained in one pair of tiles, and the least of its component there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, copies, tiles = (table[c].to_numpy() for c in ("first", "copies", "tile"))
        x = table["v"].combine_chunks()
        x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        one = tiles == tiles.min()
        if one.all() and table["low"][0].as_py() != table["high"][0].as_py():
            ids = ids[:0]  # the other tile is empty
        if not len(ids):
            none = pa.array([], pa.int64())
            return pa.Table.from_arrays([none, none, none], ["first", "n", "root"])
        if one.all():
            both = linked(x, x, threshold)
            np.fill_diagonal(both, False)
            a = b = ids
            n = both @ copies.astype(np.float64)
            ids_out, n_out = ids, n
            np.fill_diagonal(both, both.any(axis=1))  # a node's row and column are one
        else:
            a, b = ids[one], ids[~one]
            both = linked(x[one], x[~one], threshold)
            ids_out = np.append(a, b)
            n_out = np.append(both @ copies[~one].astype(np.float64), copies[one].astype(np.float64) @ both)
        node, root = _ties(both, a, b)
        order = np.argsort(ids_out)
        at = order[np.searchsorted(ids_out, node, sorter=order)]
        return pa.Table.from_arrays([pa.array(node), pa.array(np.rint(n_out[at]).astype(np.int64)), pa.array(root)], ["first", "n", "root"])

    ship(classes.sparkSession)
    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    tiles = F.lit(None).cast("int")
    for dim, n in sizes.items():
        tiles = F.when(F.size("v") == dim, max(1, math.ceil(n / tile))).otherwise(tiles)
    dealt = classes.select("first", "copies", "v", F.size("v").alias("dim"), tiles.alias("tiles")).withColumn("tile", F.pmod(F.xxhash64("first"), "tiles").cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = other.select("dim", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "first", "copies", "v")
    return pairs.groupBy("dim", "low", "high").applyInArrow(run, "first long, n long, root long")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", tile: int = TILE) -> DataFrame:
    """Rows (vec_id, n_links, component_id)."""
    v = F.col("v")
    valid = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).withColumn("v", F.when(F.coalesce(valid, F.lit(False)), v))
    classes = stage(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")), "vectors")
    found = stage(tile_links(classes, threshold, tile), "tiles")
    parts = components(found.select(F.col("first").alias("u"), F.col("root").alias("v")))
    gained = found.groupBy("first").agg(F.sum("n").alias("n"))
    named = classes.join(gained, "first", "left").join(parts.withColumnRenamed("node", "first"), "first", "left")
    named = named.select(F.col("v").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    named = stage(named, "named")
    release(classes, found, parts)
    # vectors without a class link with nothing; they take no part in the join
    some, none = rows.where("v IS NOT NULL"), rows.where("v IS NULL")
    out = some.join(named, some["v"] == named["of"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.union(none.select("vec_id", F.lit(0).cast("long"), "vec_id"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
