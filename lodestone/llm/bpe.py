"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked symbol list.

Each word starts as a linked list of symbols. A heap holds (rank, position) of adjacent pairs that
merge; the smallest is taken, entries whose pair has changed since are stale and skipped, and a
merge pushes the pairs of the new symbol with its neighbours. Decoding concatenates vocabulary
strings. Around it stand the vocabulary file's own steps: special strings, NFC, blanks, lower case
and word splitting. Two libraries agree on these for the scripts named in SHARED, whose character
data have long been settled; a part with any other character goes through the tokenizers library's own
normaliser and splitter. Words repeat, so each Python worker remembers a bounded number of them.

Defined cases: a null text counts as empty and gives no ids; a text of any length is encoded whole, and
a heap holds one word at a time; equal ranks merge from left to right; repeated rows give equal results;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

WORDS_KEPT = 400_000
"""Words that a worker remembers before it starts anew; a bound on memory, not on results."""

SHARED = "\\u0000-\\u036F\\u0400-\\u052F\\u2000-\\u2064\\u20AC\\u3041-\\u3096\\u4E00-\\u9FA5\\uAC00-\\uD7A3"
"""Latin, combining marks, Cyrillic, punctuation, Hiragana, Han and Hangul characters."""

_loaded: dict[str, WordBpe] = {}


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself if printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a byte-level BPE vocabulary with a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in (self.vocab | self.special).items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): n for n, (a, b) in enumerate(pairs)}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        self.bytes = byte_symbols()
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.kept: dict[str, tuple[bytes, int, bytes]] = {}
        self.path, self.library, self.foreign = path, None, regex.compile(f"[^{SHARED}]").search

    def merge(self, word: str) -> list[str]:
        """Symbols of one word."""
        sym = [self.bytes[b] for b in word.encode()]
        if not sym:
            return []
        sym[-1] += self.end
        n = len(sym)
        prev, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not sym[i] or j < 0 or rank.get((sym[i], sym[j])) != r:
                continue  # stale: one of the two has been merged since
            sym[i] += sym[j]
            sym[j] = ""
            after[i] = k = after[j]
            if k >= 0:
                prev[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := prev[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [s for s in sym if s]

    def split(self, text: str) -> list[str]:
        """Words of a text that holds no special string."""
        if not text.isascii():
            if self.foreign(text):
                return self.library_words(text)
            text = unicodedata.normalize("NFC", text)
            # lower-casing goes by character here, so a final sigma is like any other
            text = text.replace("Σ", "σ")
        return self.words(text.lower())

    def library_words(self, text: str) -> list[str]:
        """The same by the tokenizers library, which gives a word's bytes as printable characters."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.byte_of = {c: b for b, c in enumerate(self.bytes)}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in pieces]

    def _word(self, word: str) -> tuple[bytes, int, bytes]:
        if len(self.kept) >= WORDS_KEPT:
            self.kept.clear()
        sym = self.merge(word)
        out = self.kept[word] = (" ".join(str(self.vocab[s]) for s in sym).encode(), len(sym), " ".join(sym).encode())
        return out

    def rows(self, text: str) -> list[tuple[bytes, int, bytes]]:
        """Per word or special string: decimal ids, their number, decoded text."""
        kept, word = self.kept, self._word

        def plain(part: str) -> list[tuple[bytes, int, bytes]]:
            return [kept.get(w) or word(w) for w in self.split(part)]

        if "<|" not in text:
            return plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += plain(text[at : m.start()])
            out.append((str(self.special[m[0]]).encode(), 1, m[0].encode()))
            at = m.end()
        return out + plain(text[at:])

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.rows(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings with a blank between them, as the file names no decoder."""
        return " ".join(self.names[i] for i in ids)


def load(path: str | None) -> WordBpe:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, vocab_path: str | None = None, digests: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, ids, decoded), or with digests (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        for batch in batches:
            cols: list[list] = [[], [], []]
            for value in batch.column(1):
                rows = bpe.rows(value.as_py() or "")
                ids, decoded = b" ".join([r[0] for r in rows]), b" ".join([r[2] for r in rows])
                if digests:
                    new = sum([r[1] for r in rows]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()
                else:
                    new = [int(i) for i in ids.split()], decoded.decode(), None
                for col, x in zip(cols, new, strict=True):
                    col.append(x)
            if digests:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.string())], ["doc_id", "ids", "decoded"])

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
