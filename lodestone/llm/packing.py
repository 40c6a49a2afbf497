"""Bound-certified best-fit packing of tokenised documents into sequences.

Documents become pieces of at most `capacity` tokens; only longer ones are cut, the odd rest first.
Pieces are dealt evenly to bounded partitions, each packed by best-fit decreasing. A lower bound
from dual-feasible functions certifies a partition whose number of sequences it meets. Partitions
with a gap to their bound then exchange pieces: their sequences with room are dissolved, dealt anew
and packed again, until that saves no sequence. Last, what certified partitions have left with room
joins in, as two of them may still share a sequence. An exchange whose own bound says that it cannot
gain is not made; there is no limit to their number. Texts never move: only (doc_id, piece, length)
rows, and full sequences stay where they are.

Defined cases: a null text counts as empty, and an empty text is the end token alone; a text of any
length is cut into as many pieces as it needs; pieces of equal length are packed in the order of doc_id,
piece and checksum; repeated rows are packed each, in any order among themselves; an empty table gives
no piece; other columns are not read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import release, ship, stage

GPT2_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES_PER_PARTITION = 65_536
BIN_BITS = 24

_encoders: dict = {}


class ByteEncoder:
    """ids of the tokenizers library for a byte-level BPE file, computed by the faster tiktoken."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in token): n for token, n in spec["model"]["vocab"].items() if all(c in byte for c in token)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {token: n for token, n in ranks.items() if n not in special.values()}
        self.fast = tiktoken.Encoding("bytes", pat_str=GPT2_SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.path, self.slow, self.special = path, None, set(special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special=self.special, disallowed_special=()), dtype="<u4")
        except BaseException as e:  # the fast library panics on enormous runs of blanks
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def _encoder(path: str | None) -> ByteEncoder:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocab_path: str | None = None, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and end_id, cut where needed."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocab_path)
        for batch in batches:
            rows: list[tuple] = []
            for at, value in enumerate(batch.column(1)):
                ids = np.append(enc.encode(value.as_py() or ""), np.array(end_id, "<u4"))
                raw, n = ids.tobytes(), len(ids)
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(at, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), ids[a:b].tolist() if with_ids else None) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            at, k, start, length, crc, ids = zip(*rows, strict=True) if rows else [()] * 6
            cols = {"doc_id": batch.column(0).take(pa.array(at, pa.int32())), "piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                cols["ids"] = pa.array(ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    ship(docs.sparkSession)
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Least number of sequences for these lengths."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """Least number of sequences by dual-feasible functions, from the number of pieces of each length.

    For every threshold a up to half the capacity, the function that counts lengths over
    capacity - a as full, drops lengths under a and keeps the others, and the step functions
    floor((k + 1) x / C) / k for small k.
    """
    c, sizes = capacity, np.arange(capacity + 1)
    n, total = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * sizes))
    best = math.ceil(total[-1] / c)
    for a in range(1, c // 2 + 1):
        large = n[-1] - n[c - a + 1]
        middle = n[c - a + 1] - n[c // 2 + 1]
        rest = total[c - a + 1] - total[a]
        best = max(best, large + middle + math.ceil(max(0, rest - middle * c) / c), large + math.ceil(rest / c))
    for k in range(1, 100):
        scaled = (k + 1) * sizes
        weight = np.where(scaled % c == 0, k * sizes, (scaled // c) * c)  # in units of 1 / (k c)
        best = max(best, math.ceil(int((count * weight).sum()) / (k * c)))
    return int(best)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins; a bit per room that some bin has."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if fit := open_rooms >> size:
            left = size + (fit & -fit).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            left, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, used


def _packed(items: DataFrame, capacity: int, base: int) -> DataFrame:
    """items (part, ...) with sequence_id, offset, room and gap, packed partition by partition.

    gap says that the partition needs more sequences than its bound; ids start behind those of `base` partitions.
    """
    kept = [f for f in items.schema.fields if f.name != "part"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])  # the same result wherever the rows come from
        part, lengths = table["part"][0].as_py(), table["length"].to_numpy().astype(np.int64)
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        new = {"sequence_id": (base + part << BIN_BITS) + bins, "offset": offsets, "room": capacity - fill[bins]}
        table = table.select([f.name for f in kept])
        for name, values in new.items():
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table.append_column("gap", pa.array(np.full(len(bins), used > lower_bound(lengths, capacity))))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long, room long, gap boolean"
    return items.groupBy("part").applyInArrow(run, schema)


def _state(pool: DataFrame, capacity: int) -> dict[bool, tuple[int, np.ndarray]]:
    """Number of sequences and of pieces of each length, apart for partitions with and without a gap."""
    rows = pool.groupBy("gap", "length").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("offset") == 0).alias("first")).collect()  # at most two rows a length
    out = {g: (0, np.zeros(capacity + 1, np.int64)) for g in (False, True)}
    for r in rows:
        used, count = out[r["gap"]]
        count[r["length"]] += r["n"]
        out[r["gap"]] = used + r["first"], count
    return out


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """items (doc_id, piece, length, ids_crc32, ...) with sequence_id, offset and certified.

    certified says that the partition that packed the piece met its lower bound.
    """
    columns, base, turn = items.columns, 0, 0

    def packed(df: DataFrame, n: int) -> DataFrame:
        nonlocal base, turn
        parts = max(1, math.ceil(n / PIECES_PER_PARTITION))
        dealt = df.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts)))
        out = stage(_packed(dealt, capacity, base), "packed")
        base, turn = base + parts, turn + 1
        return out

    room = F.col("room") > 0
    now = packed(items, items.count())
    done, pool = [now.where(~room)], now.where(room)
    saved = True
    while saved:
        saved, state = False, _state(pool, capacity)
        for with_gap in (True, False):
            chosen = [state[True]] if with_gap else list(state.values())
            used, count = sum(s[0] for s in chosen), sum(s[1] for s in chosen)
            if used <= bound_of(count, capacity) or (not with_gap and not state[False][0]):
                continue
            out = pool.where("gap") if with_gap else pool
            new = packed(out.select(*columns), int(count.sum()))
            after = new.agg(F.count_if(F.col("offset") == 0)).first()[0]
            if after < used:
                rest = pool.where("NOT gap").unionByName(new.where(room)) if with_gap else new.where(room)
                done.append(new.where(~room))
                pool, saved = stage(rest, "pool"), True
                break
            release(new)
    out = pool
    for more in done:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset", (~F.col("gap")).alias("certified"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = stage(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces")
    return pack(items)
