"""Resolution of observations against stored papers, batch by batch.

The store keeps two tables with keys: papers by ref and the identity keys of each ref. A batch probes
both for its own keys and refs only, so a batch's cost follows the batch and what it touches. What is
connected by keys or refs is a component and is folded in the order of arrival, as each match changes
the record that the next one is compared with. A fold may give a merged record a key that no
observation of its component had; where another component asks for that key, the two become one and
are folded anew, until no key leads out of a component. So batches resolve as one sequence would.

A fold streams its component's rows, sorted, and holds the records it has found, not the observations.
Runs of equal observations are one row of the fold, since the second finds what the first made.

Defined cases: an observation without keys and ref gets its ref from title and locator; a ref is given
once in the whole store, so a second paper that comes with it gets another one, made from ref and seq;
an observation that conflicts with all candidates is a paper of its own; a batch whose name is known
changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.cluster import removed, ship, written
from lodestone.functions import text as tx
from lodestone.operators.identity import identity_keys, with_keys
from lodestone.operators.state import Store, current

TEXTS = ("title", "source", "doi", "dbname", "filename", "dbcode", "abstract", "locator")
FIELDS = T.StructType([
    *(T.StructField(c, T.StringType()) for c in TEXTS), T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("year", T.IntegerType()),
    T.StructField("cited", T.LongType()), T.StructField("is_detail", T.BooleanType()),
])
LISTED = ("title", "authors", "source", "year")
"""What a listing does not change once a detail has been read."""

BLANKS, MARKS = (re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", p)) for p in (f"{tx.BLANK}+", f" ?({tx.TITLE_MARKS}) ?"))


# The keys of functions.text for one record, as a fold makes records that no column holds.


def _clean(s: str | None) -> str:
    return BLANKS.sub(" ", s or "").strip(" ")


@lru_cache(256)  # neighbours in a fold have the same titles
def _title(s: str | None) -> str:
    return MARKS.sub(r"\1", _clean(s).lower())


def _source(s: str | None) -> str:
    return _clean(_clean(s).rstrip(" .。")).lower().translate({0xFF08: "(", 0xFF09: ")"})


def _json(value: object) -> str:
    out = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return re.sub("[<>&\u2028\u2029]", lambda m: f"\\u{ord(m[0]):04x}", out)


@lru_cache(256)
def _bibliography(title: str, authors: tuple[str, ...], source: str, year: int) -> str:
    listed = [_title(title), _clean("|".join(authors)).lower(), _clean(source).lower(), year]
    return hashlib.sha256(_json(listed).encode()).hexdigest()


def keys_of(p: dict) -> dict[str, str]:
    """native, doi and bib key of a record, as far as it has them."""
    doi = _clean(p["doi"]).lower()
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        doi = doi.removeprefix(prefix)
    out = {"native": f"{p['dbname']}:{p['filename']}".upper() if p["dbname"] and p["filename"] else "", "doi": doi, "bib": ""}
    if p["title"] and p["authors"] and p["source"] and p["year"]:
        out["bib"] = _bibliography(p["title"], tuple(p["authors"]), p["source"], p["year"])
    return out


def conflict(a: dict, b: dict) -> bool:
    """Both have an identifier and it differs."""
    x, y = a["keys"], b["keys"]
    return any(x[k] and y[k] and x[k] != y[k] for k in ("doi", "native")) or bool(a["dbcode"] and b["dbcode"] and a["dbcode"].lower() != b["dbcode"].lower())


def same(a: dict, b: dict) -> bool:
    x, y = a["keys"], b["keys"]
    return not conflict(a, b) and bool((x["doi"] and y["doi"]) or (x["native"] and y["native"]) or (x["bib"] and x["bib"] == y["bib"]))


def detail_of(a: dict, b: dict) -> bool:
    """Whether b may be a later view of a, which came with the same ref: title, first author and source agree."""
    if conflict(a, b) or _title(a["title"]) != _title(b["title"]):
        return False
    if a["authors"] and b["authors"] and _clean(a["authors"][0]).lower() != _clean(b["authors"][0]).lower():
        return False
    return not a["source"] or not b["source"] or _source(a["source"]) == _source(b["source"])


def merged(old: dict, new: dict) -> dict:
    """old with what new has; a listing leaves title, authors, source and year of a record that was read in detail."""
    closed = bool(old["is_detail"]) and not new["is_detail"]
    out = {c: old[c] if new[c] in (None, "", [], 0) and c != "cited" or new[c] is None or (closed and c in LISTED) else new[c] for c in FIELDS.names}
    return out | {"is_detail": bool(old["is_detail"] or new["is_detail"])}


def another_ref(ref: str, seq: int) -> str:
    return "cr_" + hashlib.sha256(f"{ref}\0{seq}".encode()).hexdigest()[:16]


class Fold:
    """The records of one component, and which of them have a key."""

    def __init__(self) -> None:
        self.records: dict[str, dict] = {}
        self.refs: dict[str, set[str]] = {}
        self.changed: set[str] = set()
        self.made: set[tuple[str, str]] = set()  # (key, ref), of all versions of a record

    def stored(self, ref: str, record: dict) -> None:
        self.records[ref] = record | {"keys": keys_of(record)}

    def key(self, key: str, ref: str) -> None:
        self.refs.setdefault(key, set()).add(ref)

    def observe(self, seq: int, ref: str, record: dict) -> str:
        """The ref of the paper that an observation is of."""
        new = record | {"keys": keys_of(record)}
        asked = [f"{k}:{v}" for k, v in new["keys"].items() if v]
        candidates = set().union({ref}, *(self.refs.get(k, ()) for k in asked))
        for candidate in sorted(candidates):
            old = self.records.get(candidate)
            if old is not None and ((candidate == ref and detail_of(old, new)) or same(old, new)):
                found, out = candidate, merged(old, new)
                break
        else:
            found, out = (ref if ref not in self.records else another_ref(ref, seq)), {c: record[c] for c in FIELDS.names}
        out["keys"] = keys_of(out)
        self.records[found] = out
        self.changed.add(found)
        for k, v in out["keys"].items():
            if v:
                key = f"{k}:{v}"
                if found not in self.refs.get(key, ()):  # what is stored is not given again
                    self.key(key, found)
                    self.made.add((key, found))
        return found


IN = T.StructType([T.StructField("component", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("ref", T.StringType()), T.StructField("key", T.StringType()), *FIELDS.fields])
"""What a fold reads and what it gives."""
RECORD, KEY, OBSERVATION = 0, 1, 2
"""Kinds of rows; of those that come in, stored records and keys stand before observations."""


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows IN, sorted by component, kind and seq, to rows of the same form: refs of observations, records that changed, keys that were made, each with its ref once."""
    fold, now = Fold(), None
    out: dict[int, list[tuple]] = {RECORD: [], KEY: [], OBSERVATION: []}
    columns = {RECORD: ("component", "ref", *FIELDS.names), KEY: ("component", "key", "ref"), OBSERVATION: ("component", "seq", "ref")}

    def ended() -> None:
        out[RECORD].extend((now, ref, *(fold.records[ref][c] for c in FIELDS.names)) for ref in sorted(fold.changed))
        out[KEY].extend((now, *pair) for pair in sorted(fold.made))

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, rows in out.items():
            if rows:
                have = dict(zip(columns[kind], zip(*rows, strict=True), strict=True)) | {"kind": [kind] * len(rows)}
                yield pa.RecordBatch.from_arrays([pa.array(have[f.name], f.type) if f.name in have else pa.nulls(len(rows), f.type) for f in ARROW_OUT], schema=ARROW_OUT)
                rows.clear()

    for batch in batches:
        for r in batch.to_pylist():
            if r["component"] != now:
                ended()
                fold, now = Fold(), r["component"]
            if r["kind"] == RECORD:
                fold.stored(r["ref"], {c: r[c] for c in FIELDS.names})
            elif r["kind"] == KEY:
                fold.key(r["key"], r["ref"])
            else:
                out[OBSERVATION].append((now, r["seq"], fold.observe(r["seq"], r["ref"], {c: r[c] for c in FIELDS.names})))
            if len(out[RECORD]) + len(out[KEY]) + len(out[OBSERVATION]) > 5_000:
                yield from flush()
    ended()
    yield from flush()


ARROW_OUT = to_arrow_schema(IN)


def complete(observations: DataFrame) -> DataFrame:
    """observations (seq, ref, ...) with all fields, whichever are missing, their keys, and a ref for each row: of its keys, else of title and locator."""
    have = dict(observations.dtypes)
    df = observations.select("seq", *(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in FIELDS.fields), *(["ref"] if "ref" in have else [F.lit("").alias("ref")]))
    return with_keys(df).withColumn("ref", F.coalesce(F.nullif("ref", F.lit("")), provisional_ref())).withColumn("keys", identity_keys())


def provisional_ref() -> Column:
    """The stable reference of a record with keys: from its native key, DOI, bibliography, or from title and locator."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    chain = (F.nullif(c, F.lit("")) for c in ("native_key", "doi_key", "bib_key"))
    return tx.record_ref(F.coalesce(*chain, F.concat(text("title"), F.lit("\0"), text("locator"))))


def labelled(links: DataFrame) -> DataFrame:
    """(node, component) of links (node, key): the least node that shared keys reach.

    Rounds of minima, in which a label also takes the label of its own node, so chains settle in few;
    there is no limit to them. Each round's table replaces the one before. The links are written first,
    unless they are a written table, so that no round computes them again.
    """
    given, links = links, links if hasattr(links, "written_at") else written(links, "links")
    label = written(links.select("node").distinct().withColumn("component", F.col("node")), "labels")
    while True:
        per_key = links.join(label, "node").groupBy("key").agg(F.min("component").alias("low"))
        per_node = links.join(per_key, "key").groupBy("node").agg(F.min("low").alias("low"))
        near = written(label.join(per_node, "node").select("node", "component", F.least("component", "low").alias("low")), "labels")
        hook = near.groupBy("component").agg(F.min("low").alias("hook")).select(F.col("component").alias("node"), "hook")
        low = near.join(hook, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "low", "hook").alias("component"))
        up = low.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = written(low.join(up, "component").select("node", F.least("component", "up").alias("component"), (F.col("up") < F.col("old")).alias("moved")), "labels")
        removed(label, near)
        if new.where("moved").isEmpty():
            removed(*([] if links is given else [links]))
            return new
        label = new


class PaperStore:
    """Papers and their keys in a Store, to which batches of observations are resolved."""

    def __init__(self, store: Store, papers: str = "resolved_papers", keys: str = "paper_keys"):
        self.store, self.names = store, (papers, keys)

    def papers(self) -> DataFrame | None:
        """The newest row of each ref."""
        now = self.store.read(self.names[0])
        return None if now is None else current(now, "ref")

    def by_ref(self, refs: list[str]) -> DataFrame | None:
        found = self.store.lookup(self.names[0], "ref", refs)
        return None if found is None else current(found, "ref")

    def by_key(self, keys: list[str]) -> DataFrame | None:
        """(key, ref) of identity keys such as doi:10.1/x."""
        found = self.store.lookup(self.names[1], "key", keys)
        return None if found is None else found.select("key", "ref").distinct()

    def upsert(self, observations: DataFrame, batch: str | None = None) -> DataFrame:
        """Resolves a batch and stores what it changed; gives (seq, ref)."""
        papers, keys = self.names
        if batch is not None and self.store.has("resolved", batch):
            return self.store.read("resolved").where(F.col("batch") == batch).select("seq", "ref")
        obs = written(complete(observations), "observations")
        asked = obs.select(F.explode("keys").alias("key")).distinct()
        found = self.store.matching(keys, "key", asked)
        known_keys = written(found.select("key", "ref").distinct(), "known-keys") if found is not None else None
        refs = obs.select("ref").union(known_keys.select("ref")).distinct() if known_keys is not None else obs.select("ref").distinct()
        records = self.store.matching(papers, "ref", refs)
        records = written(current(records, "ref"), "records") if records is not None else None
        out, runs = self._resolved(obs, known_keys, records)
        version = F.lit(self.store.next_version(papers)).cast("long")
        changed = out.where((F.col("kind") == RECORD)).select("ref", *FIELDS.names)
        self.store.append_keyed(keys, out.where(F.col("kind") == KEY).select("key", "ref").distinct(), "key", batch)
        self.store.append_keyed(papers, changed.withColumn("version", version), "ref", batch)
        of_head = out.where(F.col("kind") == OBSERVATION).select(F.col("seq").alias("head"), "ref")
        result = written(runs.select("seq", "head").join(of_head, "head").select("seq", "ref"), "resolved")
        self.store.append("resolved", result.withColumn("batch", F.lit(batch)), batch)  # last, as it says that the batch is done
        removed(obs, out, runs, *(t for t in (known_keys, records) if t is not None))
        return result

    def _resolved(self, obs: DataFrame, known_keys: DataFrame | None, records: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Rows of all components, and all observations (seq, head): written tables."""
        empty = obs.sparkSession.createDataFrame([], "key string, ref string")
        known = known_keys if known_keys is not None else empty
        own = obs.select(F.col("seq").alias("node"), F.explode(F.concat("keys", F.array(F.concat(F.lit("ref:"), "ref")))).alias("key"))
        # what has a stored key in common with a record has the record in common
        links = written(own.union(own.join(known, "key").select("node", F.concat(F.lit("ref:"), "ref").alias("key"))).distinct(), "links")
        while True:
            parts = labelled(links)  # node, component, moved
            of_key = links.join(parts, "node").select("key", "component").distinct()
            runs = written(_runs(obs.join(parts, F.col("seq") == F.col("node")).drop("node")), "runs")
            rows = [_input(runs.where("seq = head"), OBSERVATION)]
            if records is not None:
                rows.append(_input(records.join(of_key.withColumn("ref", F.expr("substr(key, 5)")).where("startswith(key, 'ref:')").drop("key"), "ref"), RECORD))
                rows.append(_input(known.join(of_key, "key"), KEY))
            ship(obs.sparkSession)
            folded = written(reduce(DataFrame.unionByName, rows).repartition("component").sortWithinPartitions("component", "kind", "seq").mapInArrow(_folded, IN), "folded")
            made = folded.where(F.col("kind") != OBSERVATION).select("component", F.coalesce("key", F.concat(F.lit("ref:"), "ref")).alias("key")).distinct()
            out = made.join(of_key.withColumnRenamed("component", "other"), "key").where("component <> other").select("component", "key", "other").distinct()
            bridges = written(out.select(F.col("component").alias("node"), "key").union(out.select(F.col("other").alias("node"), "key")).distinct(), "bridges")
            if bridges.isEmpty():
                removed(links, parts, bridges)
                return folded, runs
            more = written(links.union(bridges).distinct(), "links")
            removed(links, parts, folded, bridges, runs)
            links = more



def _runs(placed: DataFrame) -> DataFrame:
    """placed (component, seq, ...) with head: the first of neighbours in a component that are alike in everything.

    What has no key stands for itself, as it may get a ref of its own each time.
    """
    alike = F.struct("ref", *FIELDS.names)
    order = Window.partitionBy("component").orderBy("seq")
    first = F.when((F.size("keys") > 0) & alike.eqNullSafe(F.lag(alike).over(order)), None).otherwise(F.col("seq"))
    return placed.withColumn("first", first).withColumn("head", F.last("first", ignorenulls=True).over(order)).drop("first")


def _input(rows: DataFrame, kind: int) -> DataFrame:
    """Rows IN of a kind."""
    have = set(rows.columns)
    return rows.select(*(F.lit(kind).alias("kind") if f.name == "kind" else F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in IN.fields))
