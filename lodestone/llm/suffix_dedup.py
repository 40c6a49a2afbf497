"""Suffix-array dedup: repeated byte strings found through the common-prefix interval tree.

The core is maximal_repeats(): it sorts suffixes, takes the common prefixes of neighbours, scans
them with a stack, which visits the intervals of the tree from the leaves up, and reports each
interval whose suffixes differ in the byte to their left: a repeat that extends to neither side,
with all its occurrences. Every window of `least` bytes lies in such a repeat with exactly the
window's own occurrences, so taking out all but the occurrences in the smallest document removes
just the windows that also start in a smaller document.

One suffix array over a large corpus fits no machine, so equal windows are brought together first.
Each window of `least` bytes selects its least-hashed k-mer, a choice by content alone. Neighbouring
windows that select one k-mer form a segment, a plain row with the hash of its k-mer:
1. A batch of text keeps of segments with equal bytes, which are compared there, that of the smallest
   document, and marks the others. So a passage that a third of all documents share is a row a batch.
2. One exchange sorts the rows by k-mer. A task reads them as a stream: a k-mer of one document is
   done; of segments of one identity (64 bits of all bytes, 16 of either side, beside the k-mer and the
   shape) the smallest document's stays and the others are marked.
3. A shared window reaches at least 17 bytes beyond the k-mer on one side. So only segments that share
   the k-mer and 17 bytes to one side, but are not equal, can share a window. They fetch their bytes
   and meet in groups of k-mer and side, which cut a frequent k-mer up; each group is resolved by the
   interval tree of its suffix array.
Tasks hold a bounded number of rows at a time, but for the differing segments of one group.

Defined cases: a null text counts as empty; texts shorter than `least` lose nothing; rows of one
doc_id are one document, so they take nothing from each other; a missing doc_id counts as the
largest; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, ship, small_batches, stage, text_of, trim

LEAST = 50
KMER = 16
SIDE = (LEAST - KMER + 1) // 2
SLICE = 1 << 17
BATCH_BYTES = 8 << 20
BYTES_PER_TASK = 48 << 20
ROWS_AT_ONCE, ROWS_HELD = 1 << 16, 1 << 20
SEGMENTS_AT_ONCE = 4096
NO_ID = (1 << 63) - 1
_ODD = 0x9E3779B97F4A7C15
_POS = 21
"""Bits of a k-mer's sort key that hold its place; slices are shorter than that."""


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64 bits evenly (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n, and a random number for each byte."""
    return _power_table(1 << max(18, (n - 1).bit_length()))  # few sizes, so that few tables are kept


@cache
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


class _Hashes:
    """Hashes of all parts of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down, table = _powers(len(data))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], dtype=np.uint64, out=self.total[1:])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.total[b] - self.total[a]) * self.down[a]


def segments(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of concatenated documents that end at `ends` (a slice of at most 2 SLICE bytes).

    Per segment: h (k-mer), id (all its bytes and their place), lo and hi (first and last window), at
    (k-mer's place), left and right (hashes of the SIDE bytes beside the k-mer).
    """
    n = len(data)
    empty = {k: np.zeros(0, np.uint64 if k in ("h", "id", "left", "right") else np.int64) for k in ("h", "id", "lo", "hi", "at", "left", "right")}
    if n < LEAST:
        return empty
    spans = _Hashes(data).spans
    h = mixed(spans(np.arange(n - KMER + 1), np.arange(KMER, n + 1)))
    place = np.arange(len(h), dtype=np.uint64)
    key = ((h >> np.uint64(_POS)) << np.uint64(_POS)) | place
    width, low = LEAST - KMER + 1, key
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: n - LEAST + 1], low[width - step : width - step + n - LEAST + 1])
    pick = (low & np.uint64((1 << _POS) - 1)).astype(np.int64)
    starts = np.append(0, ends[:-1])
    first = np.zeros(n + 1, np.int64)  # +1 where windows of a document begin, -1 behind the last
    some = ends - starts >= LEAST
    np.add.at(first, starts[some], 1)
    np.add.at(first, ends[some] - LEAST + 1, -1)
    inside = np.cumsum(first)[: len(pick)] > 0
    new = inside.copy()
    new[1:] &= (pick[1:] != pick[:-1]) | ~inside[:-1]
    fresh = starts[some]
    new[fresh] = True
    lo = np.flatnonzero(new)
    if not len(lo):
        return empty
    stop = inside.copy()
    stop[:-1] &= new[1:] | ~inside[1:]
    hi = np.flatnonzero(stop)
    at = pick[lo]
    # a window never leaves its document, but the bytes beside the k-mer may
    doc = np.searchsorted(ends, lo, side="right")
    a, b = np.maximum(at - SIDE, starts[doc]), np.minimum(at + KMER + SIDE, ends[doc])
    left = np.where(at - a == SIDE, mixed(spans(a, at)) % np.uint64(65535) + np.uint64(1), np.uint64(0))
    right = np.where(b - at - KMER == SIDE, mixed(spans(at + KMER, b)) % np.uint64(65535) + np.uint64(1), np.uint64(0))
    shape = ((at - lo) * 64 + (hi - lo)).astype(np.uint64)
    return {"h": h[at], "id": mixed(spans(lo, hi + LEAST) ^ mixed(shape + np.uint64(1))), "lo": lo, "hi": hi, "at": at, "left": left, "right": right}


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(ends of the documents within the slice, place of the slice), documents longer than a slice in parts."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1
        if j > i:
            yield offsets[i + 1 : j + 1] - offsets[i], int(offsets[i])
        else:
            j = i + 1
            for a in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[j]) - LEAST + 1), SLICE):
                yield np.array([min(SLICE + LEAST - 1, int(offsets[j]) - a)]), a
        i = j


_ROW = ("h", "id", "more", "doc", "place")
_SEGMENTS = ", ".join(f"{c} long" for c in _ROW)
_FOUND = "g long, doc long, row int, lo int, hi int"
MARK = -1
"""`more` of a row that is a mark: place is row and lo, id is hi, h only spreads it."""


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A value per run to a value per row."""
    return np.repeat(values, np.diff(np.append(starts, n)))


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes at a and at b agree."""
    out = np.ones(len(a), bool)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(out & (size > k))
        out[some] = data[a[some] + k] == data[b[some] + k]
    return out


def _rows_of(ids: np.ndarray, rows: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of some documents: segments that may matter to others, marks that these documents alone decide."""
    got = []
    for ends, at in _slices(data, offsets):
        part = segments(data[at : at + int(ends[-1])], ends)
        for c in ("lo", "hi", "at"):
            part[c] += at
        got.append(part)
    if not got:
        return
    s = {c: np.concatenate([p.pop(c) for p in got]) for c in list(got[0])}
    total = len(s["h"])
    if not total:
        return
    n = np.searchsorted(offsets, s["lo"], side="right") - 1
    doc, size = ids[n], s["hi"] - s["lo"] + LEAST
    order = np.lexsort((doc, s["id"]))
    run = _starts(s["id"][order])
    first = np.empty(total, np.int64)
    first[order] = _spread(order[run], run, total)
    copy = np.flatnonzero((doc > doc[first]) & (size == size[first]))
    copy = copy[_equal_bytes(data, s["lo"][copy], s["lo"][first[copy]], size[copy])]
    lost = np.zeros(total, bool)
    lost[copy] = True
    lo = s["lo"] - offsets[n]
    m_doc, m_row, m_lo, m_hi = _joined(doc[lost], rows[n[lost]], lo[lost], (lo + size)[lost])
    keep = ~lost
    more = (s["hi"] - s["lo"]) | (s["at"] - s["lo"]) << 8 | s["left"].astype(np.int64) << 16 | s["right"].astype(np.int64) << 32
    place = lambda row, at: (row.astype(np.int64) << 32) | at
    marks = {"h": mixed(m_doc.astype(np.uint64)).view(np.int64), "id": m_hi, "doc": m_doc, "place": place(m_row, m_lo), "more": np.full(len(m_doc), MARK)}
    found = {"h": s["h"].view(np.int64), "id": s["id"].view(np.int64), "doc": doc, "place": place(rows[n], lo), "more": more}
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found[c][keep], marks[c]).astype(np.int64)) for c in _ROW], list(_ROW))


def _segments(docs: DataFrame) -> DataFrame:
    """Plain rows of docs (doc, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(2)
            _, offs, raw = text.buffers()
            offsets = np.frombuffer(offs, np.int32 if pa.types.is_string(text.type) else np.int64)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            i = 0
            while i < len(ids):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BATCH_BYTES, side="right")) - 1)
                yield from _rows_of(ids[i:j], rows[i:j], offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                i = j
            trim()

    return docs.select("doc", "row", "text").mapInArrow(run, _SEGMENTS)


def _joined(doc: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of each document, those that touch made one."""
    if not len(doc):
        return doc, row, lo, hi
    order = np.lexsort((lo, row, doc))
    doc, row, lo, hi = (x[order] for x in (doc, row, lo, hi))
    new = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))
    base = np.cumsum(new) * (1 << 40)  # keeps documents apart for one running maximum
    reach = np.maximum.accumulate(base + hi)
    new[1:] |= (base + lo)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], row[at], lo[at], (np.maximum.reduceat(base + hi, at) - base[at])


def _streamed(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Batches sorted by key as columns of whole keys; True with a part of a key that has too many rows to hold.

    Such a part ends where its id does, or it is one id alone, of which the first row goes on.
    """
    held: list[dict[str, np.ndarray]] = []
    rows, open_key = 0, None

    def whole(table: dict[str, np.ndarray]) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
        """Complete keys; the first may be the rest of one that was given in parts."""
        more = int(np.searchsorted(table[key], open_key, side="right")) if open_key is not None and len(table[key]) and table[key][0] == open_key else 0
        if more:
            yield {c: v[:more] for c, v in table.items()}, True
        if more < len(table[key]):
            yield {c: v[more:] for c, v in table.items()}, False

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names})
        rows += batch.num_rows
        last = held[-1][key][-1]
        if rows < ROWS_AT_ONCE or (last == held[0][key][0] and rows < ROWS_HELD):
            continue  # few rows, or one key so far
        table = {c: np.concatenate([x[c] for x in held]) for c in held[0]}
        cut = int(np.searchsorted(table[key], last))
        if cut:
            yield from whole({c: v[:cut] for c, v in table.items()})
            held = [{c: v[cut:] for c, v in table.items()}]
        else:
            open_key = last
            cut = int(_starts(table["id"], table["more"])[-1])
            yield ({c: v[:cut] for c, v in table.items()} if cut else table), True
            held = [{c: v[cut:] if cut else v[:1] for c, v in table.items()}]
        rows = len(held[0][key])
    if held:
        yield from whole({c: np.concatenate([x[c] for x in held]) for c in held[0]})


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by k-mer, identity and document: marks (g null), and segments to be resolved in group g."""
    for s, part in _streamed(batches, "h"):
        is_mark = s["more"] == MARK
        marks = [(s["doc"][is_mark], s["place"][is_mark] >> 32, s["place"][is_mark] & 0xFFFFFFFF, s["id"][is_mark])]
        s = {c: v[~is_mark] for c, v in s.items()}
        total = len(s["h"])
        run = _starts(s["h"], s["id"], s["more"])
        lost = s["doc"] > _spread(s["doc"][run], run, total)
        row, lo = s["place"] >> 32, s["place"] & 0xFFFFFFFF
        hi = lo + (s["more"] & 0xFF) + LEAST
        marks.append((s["doc"][lost], row[lost], lo[lost], hi[lost]))
        # what differs: a row for each side on which another segment of another document agrees
        out = []
        for shift, salt in ((16, 0), (32, 1 << 16)):
            side = s["more"] >> shift & 0xFFFF
            some = np.flatnonzero(side > 0)  # a side that leaves the document is 0
            group = mixed(s["h"][some].view(np.uint64) ^ mixed((side[some] + salt + 1).astype(np.uint64))).view(np.int64)
            number = np.searchsorted(run, some, side="right")
            if not part:
                order = np.argsort(group, kind="stable")
                g, q, d = group[order], number[order], s["doc"][some][order]
                at = _starts(g)
                if not len(at):
                    continue
                several = (np.maximum.reduceat(q, at) > np.minimum.reduceat(q, at)) & (np.maximum.reduceat(d, at) > np.minimum.reduceat(d, at))
                near = np.zeros(len(some), bool)
                near[order] = _spread(several, at, len(g))
            else:
                near = np.ones(len(some), bool)  # others of the k-mer are elsewhere in the stream
            near &= ~lost[some]
            out.append((group[near], some[near]))
        g = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in out)])
        ask = np.concatenate([np.zeros(0, np.int64), *(x for _, x in out)])
        m = [np.concatenate(x) for x in zip(*marks, strict=True)]
        cols = [np.append(a, b) for a, b in zip(m, (s["doc"][ask], row[ask], lo[ask], hi[ask]), strict=True)]
        none = np.append(np.ones(len(m[0]), bool), np.zeros(len(ask), bool))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(len(m[0]), np.int64), g), mask=none), *(pa.array(c.astype(np.int64)).cast(k) for c, k in zip(cols, kinds, strict=True))], ["g", "doc", "row", "lo", "hi"])
    trim()


def maximal_repeats(data: np.ndarray, ends: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts of all occurrences) of each maximal repeat of at least `least` bytes.

    data holds strings one after the other that end at `ends`; repeats lie within strings.
    """
    ends = np.asarray(ends, np.int64)
    starts = np.append(0, ends[:-1])
    sizes = np.maximum(ends - starts - least + 1, 0)
    owner = np.repeat(np.arange(len(ends)), sizes)
    if not len(owner):
        return
    suffix = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
    left = ends[owner] - suffix
    # a suffix whose first bytes occur once is in no interval; equal bytes have equal hashes
    window = _Hashes(data).spans(suffix, suffix + least)
    order = np.argsort(window, kind="stable")
    run = np.flatnonzero(np.append(True, window[order][1:] != window[order][:-1]))
    size = np.diff(np.append(run, len(order)))
    some = np.sort(order[np.repeat(size > 1, size)])
    suffix, left, end = suffix[some], left[some], ends[owner[some]]
    if not len(suffix):
        return
    deepest = int(left.max())
    # by words of eight bytes from the last to the first; of equal ones the shorter comes first
    order = np.argsort(left, kind="stable")
    for at in range(8 * ((deepest - 1) // 8), -1, -8):
        place = suffix[:, None] + np.arange(at, at + 8)
        word = np.where(place < end[:, None], data[np.minimum(place, len(data) - 1)], 0).astype(np.uint8)
        order = order[np.argsort(np.ascontiguousarray(word).view(">u8")[:, 0].astype(np.uint64)[order], kind="stable")]
    sa, room = suffix[order], left[order]
    common = np.zeros(len(sa) + 1, np.int64)  # of neighbours, 0 at both ends
    alive = np.arange(1, len(sa))
    for depth in range(deepest):
        a, b = sa[alive - 1], sa[alive]
        ok = (room[alive - 1] > depth) & (room[alive] > depth)
        ok[ok] = data[a[ok] + depth] == data[b[ok] + depth]
        alive = alive[ok]
        if not len(alive):
            break
        common[alive] += 1
    before = np.where(np.isin(sa, starts), -1 - np.arange(len(sa)), data[np.maximum(sa - 1, 0)].astype(np.int64))  # a string's start differs from all
    # intervals: (depth, first, byte to the left if it is one)
    runs = np.flatnonzero(common >= least)
    if not len(runs):
        return
    cut = np.flatnonzero(np.diff(runs) > 1)
    many = 1 << 62
    for a, b in zip(np.append(runs[0], runs[cut + 1]).tolist(), np.append(runs[cut], runs[-1]).tolist(), strict=True):
        stack: list[list[int]] = []
        for i in range(a, b + 2):
            depth = int(common[i]) if i <= b else 0
            first, side = i - 1, int(before[i - 1])
            while stack and stack[-1][0] > depth:
                d, at, one = stack.pop()
                one = one if one == side else many
                if one == many:
                    yield d, sa[at:i]
                first, side = at, one
            if depth >= least:
                if stack and stack[-1][0] == depth:
                    stack[-1][2] = side if stack[-1][2] == side else many
                else:
                    stack.append([depth, first, side])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from the bytes of segments sorted by group, document and place; whole groups share a suffix array up to a number of segments.

    Equal windows of a group lie at equal distance from its k-mer, so what other groups add is sorted out by the windows' own bytes.
    """
    held = None

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g, doc, row, lo = (table[c].to_numpy() for c in ("g", "doc", "row", "lo"))
        part = table["bytes"].to_pylist()
        edges = np.append(_starts(g), len(g))
        i = 0
        while i < len(edges) - 1:
            j = i + 1
            while j < len(edges) - 1 and edges[j + 1] - edges[i] < SEGMENTS_AT_ONCE:
                j += 1
            a, b = int(edges[i]), int(edges[j])
            ends = np.cumsum([len(x) for x in part[a:b]])
            begin, out = np.append(0, ends[:-1]), []
            for size, occurrences in maximal_repeats(np.frombuffer(b"".join(part[a:b]), np.uint8), ends):
                n = np.searchsorted(ends, occurrences, side="right")
                lost = doc[a + n] > doc[a + n].min()
                if lost.any():
                    n = n[lost]
                    at = lo[a + n] + occurrences[lost] - begin[n]
                    out.append((doc[a + n], row[a + n], at, at + size))
            if out:
                cols = _joined(*(np.concatenate(c) for c in zip(*out, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc", "row", "lo", "hi"])
            i = j

    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        g = held["g"].to_numpy()
        cut = int(np.searchsorted(g, g[-1])) if g[0] <= g[-1] else 0
        if cut >= SEGMENTS_AT_ONCE:
            yield from found(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None:
        yield from found(held)
    trim()


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, row, spans): byte intervals to remove; doc is doc_id or NO_ID, row tells rows of one doc_id apart."""
    spark = docs.sparkSession
    ship(spark)
    body = text_of(docs, text)
    keyed = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(body).alias("row"), body.alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BYTES_PER_TASK))
    with small_batches(spark, 4000):
        found = stage(_segments(keyed).repartition(tasks, "h").sortWithinPartitions("h", "id", "more", "doc").mapInArrow(_matched, _FOUND), "segments")
    marks = found.where("g IS NULL").select("doc", "row", "lo", "hi")

    asked = found.where("g IS NOT NULL").groupBy("doc", "row").agg(F.collect_list(F.struct("g", "lo", "hi")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            n, inner = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
            g, lo, hi = (inner.field(i) for i in range(3))
            owner = pa.array(np.repeat(np.arange(len(n)), n))
            texts, at = batch.column(2), 0
            cut = []
            for k, raw in zip(n.tolist(), texts, strict=True):
                data = raw.as_py()
                cut += [data[a:b] for a, b in zip(lo[at : at + k].to_pylist(), hi[at : at + k].to_pylist(), strict=True)]
                at += k
            yield pa.RecordBatch.from_arrays([g, batch.column(0).take(owner), batch.column(1).take(owner), lo, pa.array(cut, pa.binary())], ["g", "doc", "row", "lo", "bytes"])

    texts = keyed.join(asked, ["doc", "row"]).select("doc", "row", F.col("text").cast("binary").alias("bytes"), "asked")
    bytes_of = texts.mapInArrow(fetch, "g long, doc long, row int, lo int, bytes binary")
    with small_batches(spark):
        resolved = stage(bytes_of.repartition(tasks, "g").sortWithinPartitions("g", "doc", "row", "lo").mapInArrow(_resolved, "doc long, row int, lo int, hi int"), "resolved")
    out = stage(marks.union(resolved).groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    release(found, resolved)
    return out


def without_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): the bytes that stay, or their SHA-256 in hex.

    The bytes that stay need not be UTF-8.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    body = text_of(docs, text)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.hash(body).alias("row"), body.cast("binary").alias("bytes"))
    both = keyed.join(spans, ["doc", "row"], "left").select("doc_id", "bytes", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, spans in zip(batch.column(1), batch.column(2), strict=True):
                data, at, kept, runs = raw.as_py(), 0, [], []
                for lo, hi in sorted((x["lo"], x["hi"]) for x in spans.as_py() or ()):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                for lo, hi in runs:
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest() if digest else left))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_spans(docs, repeated_spans(docs), digest=True).withColumnRenamed("kept", "kept_sha256")
