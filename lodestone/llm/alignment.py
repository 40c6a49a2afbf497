"""Alignment of two tokenizers: a byte-level BPE (A) and a sentence-piece BPE with byte fallback (B).

Texts are cut at blanks and line ends behind a character that is no white space; both tokenizers end a
token there, so a part's ids, groups and links do not depend on its surroundings. Parts repeat, so each
Python worker remembers a bounded number of them. Every pair of an A and a B token that share bytes is
one stretch between two neighbouring token ends of either kind.

A pair is one int64, A's id above B's. np.unique counts the documents of a pair within a task; these
partial counts are range-partitioned and sorted by pair, and the run lengths of equal pairs summed.
Each range is written as a shard, two files of sorted numbers in the shared folder, which the tasks that
look pairs up map into memory and search. So neither counts nor pairs pass through the driver or a
broadcast; only the highest count of each A id does, which the vocabulary bounds.

Defined cases: texts that are null, empty or not given back byte by byte have no tokens; every row is a
document, so repeated rows count as many; a text of any length is read whole; an empty table has an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import release, ship, small_batches, stage
from .packing import ByteEncoder
from .shared_files import mapped, new_folder, opened, remove_folder

PARTS_KEPT = 250_000
"""Parts that a worker remembers before it starts anew; a bound on memory, not on results."""

CHUNK = 100
"""Parts that B encodes in one call; its time for a part grows with the text around it."""

LONG_PART = 64
"""Longer parts are not remembered."""

KEYS_HELD = 1 << 21
"""Pairs that a counting task holds before it sums them."""

PARTS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*(?:\s+\Z)?|\s+").findall
TWO_BLANKS = re.compile(r"\s\s").search

_aligners: dict[tuple, Aligner] = {}


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import json

        import sentencepiece

        self.encoder = ByteEncoder(a_path)
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_symbols())}
        tokens_a = {n: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, n in vocab.items()}
        self.tokens_a = [tokens_a.get(n, b"") for n in range(max(tokens_a) + 1)]
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
        self.tokens_b = [bytes([int(p[3:5], 16)]) if self.model.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        # a cut is safe where no piece goes on across it
        self.cuts = not any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in pieces)
        self.size_a, self.size_b = (np.array([len(t) for t in ts], np.int64) for ts in (self.tokens_a, self.tokens_b))
        self.word_a, self.word_b = (np.array([f"{n}{end}".encode() for end in ends for n in range(size)], object) for ends, size in ((",|", len(self.tokens_a)), (",;", len(self.tokens_b))))
        self.stop = len(self.model.encode("."))
        self.kept: dict[str, tuple | None] = {}
        self.slow = None

    def ids_a(self, text: str) -> np.ndarray:
        """Ids of A, in which special strings are plain text."""
        try:
            return np.array(self.encoder.fast.encode_ordinary(text), np.int64)
        except BaseException as e:  # the fast library panics on enormous runs of blanks
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.encoder.path)
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def ids_b(self, parts: list[str]) -> np.ndarray:
        """Ids of B for parts that stand one behind the other; each chunk follows a full stop, whose ids are dropped."""
        if len(parts) == 1 and parts[0][0] == " ":
            return np.array(self.model.encode(parts[0][1:]), np.int64)  # B adds this blank
        chunks = ["." + "".join(parts[at : at + CHUNK]) for at in range(0, len(parts), CHUNK)]
        return np.fromiter(chain.from_iterable([ids[self.stop :] for ids in self.model.encode(chunks, num_threads=1)]), np.int64)

    def parts(self, text: str) -> list[str]:
        """A text that begins with a blank, cut."""
        if not self.cuts:
            return [text]
        if TWO_BLANKS(text) or text[-1].isspace() or "\0" in text:
            return PARTS(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]

    def learn(self, parts: list[str]) -> None:
        """Remembers parts: numbers of tokens, groups as text, pairs; None where the bytes differ."""
        text = "".join(parts)
        raw = text.encode()
        a, b = self.ids_a(text), self.ids_b(parts)
        if any(b"".join(map(tokens.__getitem__, ids.tolist())) != raw for tokens, ids in ((self.tokens_a, a), (self.tokens_b, b))):
            if len(parts) > 1:
                self.learn(parts[: len(parts) // 2])
                self.learn(parts[len(parts) // 2 :])
            else:
                self.kept[parts[0]] = None
            return
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        in_a, in_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        in_a[end_a], in_b[end_b] = True, True
        both, last_a, last_b = np.flatnonzero(in_a | in_b), in_b[end_a], in_a[end_b]
        pairs = (a[np.searchsorted(end_a, both)] << 32 | b[np.searchsorted(end_b, both)]).tobytes()
        # a group's A tokens come before its B tokens
        before_a, until_b = np.append(0, np.flatnonzero(last_b) + 1), np.append(np.flatnonzero(last_a) + 1, len(a))
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + before_a[np.cumsum(last_a) - last_a]] = self.word_a[a + last_a * len(self.tokens_a)]
        words[np.arange(len(b)) + until_b[np.cumsum(last_b) - last_b]] = self.word_b[b + last_b * len(self.tokens_b)]
        words = words.tolist()
        edges = np.cumsum([0, *map(len, parts)] if text.isascii() else [0, *(len(p.encode()) for p in parts)])
        at_a, at_b, at_both = (np.searchsorted(x, edges, "right") for x in (end_a, end_b, both))
        sizes, at, at_both, kept = (np.diff(at_a) << 32 | np.diff(at_b)).tolist(), (at_a + at_b).tolist(), (8 * at_both).tolist(), self.kept
        for i, part in enumerate(parts):
            kept[part] = sizes[i], b"".join(words[at[i] : at[i + 1]]), pairs[at_both[i] : at_both[i + 1]]

    def rows(self, texts: list[str | None]) -> list[tuple[int, int, int, bytes, np.ndarray, np.ndarray] | None]:
        """Per text: tokens of A and B, groups, groups as text, its pairs sorted and how often each is linked."""
        kept = self.kept
        if len(kept) > PARTS_KEPT:
            kept.clear()
        cut = [self.parts(" " + t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(kept))
        odd = [p for p in new if p[-1].isspace() or not self.cuts]
        for part in odd:  # these do not stand before others
            self.learn([part])
        if len(odd) < len(new):
            self.learn([p for p in new if not p[-1].isspace()] if odd else new)
        out: list = []
        for parts in cut:
            found = list(map(kept.__getitem__, parts))
            if not found or None in found:
                out.append(None)
                continue
            sizes, groups, pairs = zip(*found, strict=True)
            n, own = sum(sizes), b"".join(groups)[:-1]
            keys, times = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
            out.append((n >> 32, n & (1 << 32) - 1, own.count(b"|"), own, keys, times))
        for part in new:
            if len(part) > LONG_PART:
                del kept[part]
        return out


def load(a_path: str | None, b_path: str | None) -> Aligner:
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, groups_sha256[, groups], and its pairs: a, b and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(a_path, b_path)
        for batch in batches:
            rows = aligner.rows(batch.column(1).to_pylist())
            counts = [[r[k] if r else 0 for r in rows] for k in range(3)]
            groups = [r[3] if r else b"" for r in rows]
            none = np.zeros(0, np.int64)
            keys, times = ([r[k] if r else none for r in rows] for k in (4, 5))
            at = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            all_keys, all_times = np.concatenate([none, *keys]), np.concatenate([none, *times])
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (all_keys >> 32, all_keys & 0xFFFFFFFF, all_times)]
            cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([int(t.sum()) for t in times], pa.int64()), pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string())]
            cols += [pa.array([g.decode() for g in groups], pa.string())] * with_groups
            yield pa.RecordBatch.from_arrays([*cols, *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * with_groups, "a", "b", "times"])

    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + "groups string, " * with_groups + "a array<int>, b array<int>, times array<int>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) lists, a document each, to (key, n) with few repeats of a key."""
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        new, times = np.unique(np.concatenate(held), return_counts=True)
        both = np.append(keys, new)
        order = np.argsort(both, kind="stable")
        both, counts = both[order], np.append(n, times)[order]
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        return both[at], np.add.reduceat(counts, at)

    def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], ["key", "n"])

    for batch in batches:
        held.append(_flat(batch.column(0)) << 32 | _flat(batch.column(1)))
        if sum(map(len, held)) >= KEYS_HELD:
            keys, n = summed()
            held = []
            if len(keys) >= KEYS_HELD:
                yield from rows(keys, n)
                keys, n = keys[:0], n[:0]
    if held and sum(map(len, held)):
        keys, n = summed()
    yield from rows(keys, n)


class PairShards:
    """Sorted counts of pairs in the shared folder: a file of keys and one of counts for each range."""

    def __init__(self, folder: str, shards: list[tuple[int, str]], best: np.ndarray):
        self.folder, self.best = folder, best
        self.first, self.names = np.array([s[0] for s in shards], np.int64), [s[1] for s in shards]

    def counts(self, keys: np.ndarray, files: dict) -> np.ndarray:
        """Counts of sorted keys that the shards have; files keeps what is mapped."""
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.first, keys, "right") - 1
        for s in np.unique(shard).tolist():
            if s not in files:
                files[s] = mapped(f"{self.folder}/{self.names[s]}.keys"), mapped(f"{self.folder}/{self.names[s]}.counts")
            known, n = files[s]
            a, b = np.searchsorted(shard, [s, s + 1])
            at = np.searchsorted(known, keys[a:b])
            if not (known[at] == keys[a:b]).all():
                raise ValueError("a pair is in no shard")
            out[a:b] = n[at]
        return out

    def remove(self) -> None:
        remove_folder(self.folder)


def count_pairs(pairs: DataFrame) -> PairShards:
    """Number of rows of pairs (a, b: lists) that hold each pair, as sorted shards."""
    spark = pairs.sparkSession
    folder = new_folder(spark, "pair-counts")
    partial = stage(pairs.select("a", "b").mapInArrow(_partial, "key long, n long"), "pair-counts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard from a sorted range; the name is the attempt's own, so a repeated task disturbs nothing."""
        name, first, best = uuid.uuid4().hex, None, {}
        fs, path = opened(f"{folder}/{name}")
        last_key, last_n = None, 0
        with fs.open_output_stream(f"{path}.keys") as keys_out, fs.open_output_stream(f"{path}.counts") as counts_out:

            def put(keys: np.ndarray, n: np.ndarray) -> None:
                keys_out.write(keys.tobytes())
                counts_out.write(n.tobytes())
                at = np.flatnonzero(np.append(True, keys[1:] >> 32 != keys[:-1] >> 32))
                for a, most in zip((keys[at] >> 32).tolist(), np.maximum.reduceat(n, at).tolist(), strict=True):
                    best[a] = max(most, best.get(a, 0))

            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, n = (c.to_numpy() for c in batch.columns)
                at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                keys, n = keys[at], np.add.reduceat(n, at)
                if last_key is not None and keys[0] == last_key:
                    n[0] += last_n
                elif last_key is not None:
                    put(np.array([last_key]), np.array([last_n]))
                first = int(keys[0]) if first is None else first
                if len(keys) > 1:
                    put(keys[:-1], n[:-1])
                last_key, last_n = int(keys[-1]), int(n[-1])  # it may go on in the next batch
            if last_key is not None:
                put(np.array([last_key]), np.array([last_n]))
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([name]), pa.array([list(best)], pa.list_(pa.int32())), pa.array([list(best.values())], pa.list_(pa.int64()))], ["first", "name", "a", "best"])

    ship(spark)
    shards = stage(partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(write, "first long, name string, a array<int>, best array<long>"), "pair-shards")
    names = sorted((r["first"], r["name"]) for r in shards.select("first", "name").collect())  # one for each partition
    highest = shards.select(F.inline(F.arrays_zip("a", "best"))).groupBy("a").agg(F.max("best").alias("best")).toArrow()  # no more than the vocabulary
    best = np.zeros(max(highest["a"].to_pylist(), default=-1) + 1, np.int64)
    best[highest["a"].to_numpy()] = highest["best"].to_numpy()
    release(partial, shards)
    return PairShards(folder, names, best)


def scored(pairs: DataFrame, shards: PairShards) -> DataFrame:
    """pairs (doc_id, ..., a, b, times) without its lists, with n_best and count_sum."""
    kept = [f for f in pairs.schema.fields if f.name not in ("a", "b", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict = {}
        for batch in batches:
            lists = batch.column(len(kept))
            a, b, times = (_flat(batch.column(len(kept) + k)) for k in range(3))
            keys, back = np.unique(a << 32 | b, return_inverse=True)
            n = shards.counts(keys, files)[back]
            at = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))
            sums = [np.append(0, np.cumsum(x))[at] for x in (times * (n == shards.best[a]), times * n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(np.diff(s), pa.int64()) for s in sums)], [*(f.name for f in kept), "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long"
    return pairs.select(*(f.name for f in kept), "a", "b", "times").mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, with_groups: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents: doc_id, n_a, n_b, n_groups, n_links, groups_sha256[, groups], n_best, count_sum."""
    with small_batches(docs.sparkSession, 200):
        pairs = stage(aligned(docs, a_path, b_path, with_groups, doc_id, text), "pairs")
        shards = count_pairs(pairs)
        out = stage(scored(pairs, shards), "aligned")
    shards.remove()
    release(pairs)
    return out


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
