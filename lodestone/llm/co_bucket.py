"""Co-bucketed table pair: a two-phase external sort into one sorted Parquet file per table and bucket.

Map tasks hold a bounded number of rows, sort them by bucket and order, and spill them to the shared
folder as one Arrow file whose batches each belong to one bucket. Bucket tasks merge the runs of a
bucket through a heap of the runs' next blocks: the block that ends first bounds what is surely next,
so no more than a block of each run is held, however large the bucket. A bucket with more runs than a
task may open is merged in rounds, several tasks a round; only its file is written by one task,
streaming. Two tables that are bucketed by the same key then join bucket by bucket, without a shuffle.

Of rows, only counts by file and bucket reach the driver, whose number the buckets bound. Files carry
the attempt's own name, and only those in the stored manifest are kept, so a task can be repeated.

Defined cases: nulls come first in every column, whatever its direction; NaN is above all numbers,
-0.0 equals 0.0; strings are compared by their UTF-8 bytes; repeated rows all stay; an empty table has
no file; columns keep their names, types and order, whatever they are called. Columns of arrays, maps
or structs have no order here and are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, ship, stage
from .shared_files import new_folder, opened, remove_folder

RUN_ROWS = 262_144
"""Rows that a map task sorts and spills at a time, at most."""

RUN_BYTES = 64 << 20
"""The same in bytes of Arrow memory."""

BLOCK_ROWS = 8_192
"""Rows of a batch of a run, the unit that a merging task holds of each run."""

OPEN_RUNS = 48
"""Runs that one task merges."""

Order = list[tuple[str, bool]]
"""Columns and whether each descends."""


def crc_bucket(value: Column, buckets: int, salt: str = "") -> Column:
    """Unsigned crc32 of salt and the decimal value, modulo buckets."""
    return F.pmod(F.crc32(F.concat(F.lit(salt), value.cast("string"))), F.lit(buckets)).cast("int")


# Sorting: an order is a list of key columns for pyarrow, nulls first.


def _keys(table: pa.Table, order: Order) -> tuple[pa.Table, list[tuple[str, str]]]:
    """The columns of an order as pyarrow sorts them: floats as integers of the same order, so NaN comes last."""
    cols, names = [], []
    for i, (name, descending) in enumerate(order):
        col = table[name].combine_chunks()
        if pa.types.is_floating(col.type):
            x = pc.fill_null(col, 0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            bits = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
            bits = np.where(np.isnan(x), np.iinfo(np.int64).max, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits))
            col = pa.array(bits, mask=col.is_null().to_numpy(zero_copy_only=False))
        cols.append(col)
        names.append((f"k{i}", "descending" if descending else "ascending"))
    return pa.table(cols, names=[n for n, _ in names]), names


def _sorted(table: pa.Table, order: Order) -> pa.Table:
    keys, by = _keys(table, order)
    return table.take(pc.sort_indices(keys, sort_keys=by, null_placement="at_start"))


class _Key:
    """One row of key columns, comparable as the rows are sorted."""

    __slots__ = ("values", "down")

    def __init__(self, keys: pa.Table, at: int, down: list[bool]):
        self.values, self.down = [c[at].as_py() if not pa.types.is_temporal(c.type) else c[at].value for c in keys.columns], down

    def __lt__(self, other: _Key) -> bool:
        for x, y, down in zip(self.values, other.values, self.down, strict=True):
            if x is None or y is None:
                if (x is None) != (y is None):
                    return x is None
            elif x != y:
                if isinstance(x, str):
                    x, y = x.encode(), y.encode()
                return (y < x) if down else (x < y)
        return False


class _Run:
    """A sorted source of blocks: the loaded one, its keys and how far it has been given."""

    def __init__(self, blocks: Iterator[pa.Table], order: Order):
        self.blocks, self.order, self.down, self.table = blocks, order, [d for _, d in order], None

    def load(self) -> bool:
        self.table = next((b for b in self.blocks if b.num_rows), None)
        if self.table is None:
            return False
        self.keys, _ = _keys(self.table, self.order)
        self.at, self.last = 0, self.key(self.table.num_rows - 1)
        return True

    def key(self, at: int) -> _Key:
        return _Key(self.keys, at, self.down)

    def upto(self, bound: _Key) -> pa.Table:
        """Gives the rows that do not come behind bound."""
        low, high = self.at, self.table.num_rows
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if bound < self.key(mid) else (mid + 1, high)
        out, self.at = self.table.slice(self.at, low - self.at), low
        return out


def merged(sources: list[Iterator[pa.Table]], order: Order) -> Iterator[pa.Table]:
    """Merges sorted sources through a heap of their blocks' last keys."""
    runs = [r for r in (_Run(s, order) for s in sources) if r.load()]
    heap = [(r.last, i) for i, r in enumerate(runs)]
    heapq.heapify(heap)
    while heap:
        bound, first = heap[0]
        parts = [part for _, i in heap if (part := runs[i].upto(bound)).num_rows]
        yield parts[0] if len(parts) == 1 else _sorted(pa.concat_tables(parts), order)
        while heap and runs[heap[0][1]].at == runs[heap[0][1]].table.num_rows:
            _, i = heap[0]
            if runs[i].load():
                heapq.heapreplace(heap, (runs[i].last, i))
            else:
                heapq.heappop(heap)


# Phase one: runs.

RUNS = "bucket int, source int, run string, first int, last int, n_rows long"


def _spill(table: pa.Table, order: Order, folder: str) -> pa.RecordBatch:
    """Writes rows (columns, then bucket) as one run, a bucket's batches behind the other's; gives the run's entries."""
    bucket = table.column_names[-1]
    table = _sorted(table, [(bucket, False), *order])
    of = table[bucket].to_numpy()
    table = table.drop_columns([bucket])
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    name, batches, rows = f"{uuid.uuid4().hex}.arrow", 0, []
    fs, path = opened(f"{folder}/{name}")
    with fs.open_output_stream(path) as out, pa.ipc.new_file(out, table.schema) as writer:
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            first = batches
            for at in range(a, b, BLOCK_ROWS):
                writer.write_batch(table.slice(at, min(BLOCK_ROWS, b - at)).combine_chunks().to_batches()[0])
                batches += 1
            rows.append((int(of[a]), -1, name, first, batches, b - a))
    return _entries(rows)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "source", "run", "first", "last", "n_rows"])


def runs(df: DataFrame, bucket: Column, order: Order, folder: str, name: str) -> DataFrame:
    """Spills df in sorted runs by bucket, a column that is called name on the way; the entries are RUNS."""
    refused = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")]
    if refused:
        raise TypeError(f"no order for columns {refused}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= RUN_ROWS or size >= RUN_BYTES:
                yield _spill(pa.Table.from_batches(held), order, folder)
                held, rows, size = [], 0, 0
        if held:
            yield _spill(pa.Table.from_batches(held), order, folder)

    ship(df.sparkSession)
    return df.withColumn(name, bucket).mapInArrow(run, RUNS)


def _blocks(folder: str, run: str, first: int, last: int) -> Iterator[pa.Table]:
    fs, path = opened(f"{folder}/{run}")
    with fs.open_input_file(path) as file, pa.ipc.open_file(file) as reader:
        for k in range(first, last):
            yield pa.Table.from_batches([reader.get_batch(k)])


def fewer(entries: DataFrame, order: Order, folder: str) -> DataFrame:
    """entries in which no bucket has more than OPEN_RUNS runs: groups of them are merged, in rounds, each by a task."""
    while True:
        most = entries.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        if most <= OPEN_RUNS:
            return entries

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    name, n, count = f"{uuid.uuid4().hex}.arrow", 0, 0
                    fs, path = opened(f"{folder}/{name}")
                    stream = merged([_blocks(folder, r["run"], r["first"], r["last"]) for r in row["runs"]], order)
                    block = next(stream)
                    with fs.open_output_stream(path) as out, pa.ipc.new_file(out, block.schema) as writer:
                        while block is not None:
                            for at in range(0, block.num_rows, BLOCK_ROWS):
                                writer.write_batch(block.slice(at, BLOCK_ROWS).combine_chunks().to_batches()[0])
                                n += 1
                            count += block.num_rows
                            block = next(stream, None)
                    yield _entries([(row["bucket"], -1, name, 0, n, count)])

        numbered = entries.selectExpr("*", "row_number() OVER (PARTITION BY bucket ORDER BY run, first) AS k").withColumn("part", F.expr(f"CAST((k - 1) / {OPEN_RUNS} AS INT)"))
        groups = numbered.groupBy("bucket", "part").agg(F.collect_list(F.struct("run", "first", "last")).alias("runs"))
        step = stage(groups.repartition(max(8, most // OPEN_RUNS + 1), "bucket", "part").mapInArrow(merge, RUNS), "runs")
        release(entries)
        entries = step


# Phase two: files.

FILES = "bucket int, path string, n_rows long, keys_sha256 string"


class _Digest:
    """sha256 of decimal values joined by commas, null as nothing."""

    def __init__(self) -> None:
        self.hash, self.open = hashlib.sha256(), False

    def add(self, values: pa.ChunkedArray | pa.Array) -> None:
        if len(values):
            text = ",".join("" if v is None else str(v) for v in values.to_pylist())
            self.hash.update(("," * self.open + text).encode())
            self.open = True


def _file_row(bucket: int, path: str, rows: int, digest: _Digest) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((bucket, path, rows, digest.hash.hexdigest()), kinds, strict=True)], ["bucket", "path", "n_rows", "keys_sha256"])


def files(entries: DataFrame, order: Order, key: str, folder: str, target: str, name: str, buckets: int) -> DataFrame:
    """Merges each bucket's runs into one Parquet file target/name-bucket-*.parquet, a task each; rows FILES."""
    entries = fewer(entries, order, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path, count, digest = f"{target}/{name}-{row['bucket']:05d}-{uuid.uuid4().hex[:12]}.parquet", 0, _Digest()
                fs, at = opened(path)
                stream = merged([_blocks(folder, r["run"], r["first"], r["last"]) for r in row["runs"]], order)
                block = next(stream)
                with pq.ParquetWriter(at, block.schema, filesystem=fs) as writer:
                    held: list[pa.Table] = []
                    while block is not None:
                        held.append(block)
                        count += block.num_rows
                        digest.add(block[key])
                        block = next(stream, None)
                        if block is None or sum(t.num_rows for t in held) >= 16 * BLOCK_ROWS:
                            writer.write_table(pa.concat_tables(held))
                            held = []
                yield _file_row(row["bucket"], path, count, digest)

    grouped = entries.groupBy("bucket").agg(F.collect_list(F.struct("run", "first", "last")).alias("runs"))  # OPEN_RUNS at most
    out = stage(grouped.repartitionById(buckets, F.col("bucket")).mapInArrow(run, FILES), "files")
    release(entries)
    return out


def digests(paths: DataFrame, key: str, parallel: int) -> DataFrame:
    """n_rows and keys_sha256 of files that stay, read in blocks, a file a task: rows FILES from (bucket, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = opened(row["path"])
                rows, digest = 0, _Digest()
                with fs.open_input_file(at) as file:
                    for block in pq.ParquetFile(file).iter_batches(BLOCK_ROWS, columns=[key]):
                        rows += block.num_rows
                        digest.add(block.column(0))
                yield _file_row(row["bucket"], row["path"], rows, digest)

    return paths.select("bucket", "path").repartitionById(parallel, F.col("bucket")).mapInArrow(run, FILES)


def write_numbered(df: DataFrame, number: Column, order: Order, key: str, target: str, name: str, numbers: int) -> DataFrame:
    """df as one sorted file for each number from 0 to below numbers: rows FILES."""
    spill = new_folder(df.sparkSession, "runs")
    try:
        return files(stage(runs(df, number, order, spill, free("_bucket", df)), "runs"), order, key, spill, target, name, numbers)
    finally:
        remove_folder(spill)


def rewrite(df: DataFrame, starting: DataFrame, bucket: Callable[[DataFrame, str], DataFrame], order: Order, key: str, target: str, name: str, buckets: int) -> DataFrame:
    """Rewrites the files `starting` (bucket: their number, path), which hold df, as one file for each bucket.

    bucket(rows, column) adds the rows' bucket as a column. Rows: bucket, path, n_rows, keys_sha256,
    lineage_sha256, rewritten. A starting file whose rows are those of a bucket, neither more nor fewer,
    stays as it is.
    """
    spark, came, goes = df.sparkSession, free("_from", df), free("_to", df)
    number = F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"-(\d+)-[0-9a-f]+\.parquet$", 1).cast("int")

    def read(paths: list[str]) -> DataFrame:
        stored = spark.read.schema(df.schema).parquet(*paths).select(*df.columns, number.alias(came)) if paths else df.limit(0).withColumn(came, F.lit(0))
        return bucket(stored, goes)

    at = {r["bucket"]: r["path"] for r in starting.select("bucket", "path").collect()}  # a file each
    flow = stage(read(list(at.values())).groupBy(F.col(came).alias("start"), F.col(goes).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "flow")
    pairs = [(r["start"], r["bucket"]) for r in flow.collect()]  # files times buckets at most
    leaves, enters = Counter(s for s, _ in pairs), Counter(b for _, b in pairs)
    stays = {b: at[s] for s, b in pairs if leaves[s] == enters[b] == 1}
    moved = sorted({s for s, b in pairs if b not in stays})
    spill = new_folder(spark, "runs")
    try:
        rows = read([at[s] for s in moved])
        new = files(stage(runs(rows.select(*df.columns, goes), F.col(goes), order, spill, goes), "runs"), order, key, spill, target, name, buckets)
    finally:
        remove_folder(spill)
    kept = stage(digests(spark.createDataFrame(list(stays.items()), "bucket int, path string"), key, buckets), "kept")
    lineage = flow.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("parts"))
    digest = F.sha2(F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["start"], p["n"])), ","), 256)
    both = new.withColumn("rewritten", F.lit(True)).unionByName(kept.withColumn("rewritten", F.lit(False)))
    out = stage(both.join(lineage, "bucket").select("bucket", "path", "n_rows", "keys_sha256", digest.alias("lineage_sha256"), "rewritten"), "rewritten")
    release(flow, new, kept)
    keep_only(target, [r["path"] for r in out.select("path").collect()])
    return out


def free(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def keep_only(target: str, paths: list[str]) -> None:
    """Removes every file of a folder but these."""
    fs, at = opened(target)
    stay = {opened(p)[1] for p in paths}
    for info in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if info.path not in stay:
            fs.delete_file(info.path)


def sorted_by(df: DataFrame, key: str) -> Order:
    """key descending, then the other columns from left to right ascending."""
    return [(key, True), *((c, False) for c in df.columns if c != key)]


def co_bucket(
    left: DataFrame, right: DataFrame, names: tuple[str, str], key: str, starts: tuple[Column, Column], numbers: int, buckets: int, salt: str, target: str
) -> DataFrame:
    """Writes two tables into numbered files below target and rewrites them there as one file for each bucket of key.

    Bucket `buckets` holds rows of the right table whose key the left one lacks, the next one null keys.
    Rows: table_name, path, columns, ids_sha256, lineage_sha256, bucket, n_rows, n_joined (rows of the
    bucket's inner join), rewritten.
    """
    # a table of its own, so that both sides of its join are plain exchanges and a key that many rows share is split
    known = stage(left.where(F.col(key).isNotNull()).select(F.col(key).alias(key)).distinct(), "known-keys")
    own = crc_bucket(F.col(key), buckets, salt)

    def of_left(rows: DataFrame, column: str) -> DataFrame:
        return rows.withColumn(column, F.coalesce(own, F.lit(buckets + 1)))

    def of_right(rows: DataFrame, column: str) -> DataFrame:
        has, found = free("_has", rows), free("_key", rows)
        both = rows.join(known.select(F.col(key).alias(found), F.lit(True).alias(has)), F.col(key) == F.col(found), "left")
        return both.select(*rows.columns, F.when(F.col(has), own).when(F.col(key).isNull(), buckets + 1).otherwise(buckets).alias(column))

    parts = []
    for df, name, start, bucket in zip((left, right), names, starts, (of_left, of_right), strict=True):
        order, folder = sorted_by(df, key), f"{target}/{name}"
        fs, path = opened(folder)
        fs.create_dir(path)
        starting = write_numbered(df, start, order, key, folder, "start", numbers)
        out = rewrite(df, starting, bucket, order, key, folder, "bucket", buckets + 2)
        release(starting)
        parts.append(out.withColumn("table_name", F.lit(name)).withColumn("columns", F.lit(",".join(df.columns))))
    release(known)
    counts = [df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias(f"n{i}")) for i, df in enumerate((left, right))]
    joined = counts[0].join(counts[1], "key").groupBy(crc_bucket(F.col("key"), buckets, salt).alias("bucket")).agg(F.sum(F.col("n0") * F.col("n1")).alias("n_joined"))
    both = reduce(DataFrame.unionByName, parts).join(joined, "bucket", "left")
    return both.select("table_name", "path", "columns", F.col("keys_sha256").alias("ids_sha256"), "lineage_sha256", F.col("bucket").cast("long").alias("bucket"), "n_rows", F.coalesce("n_joined", F.lit(0)).alias("n_joined"), "rewritten")


def op12_co_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sales", "sale_lines"))
    bucket = F.coalesce(crc_bucket(F.col("sale_id"), 150, "pair"), F.lit(151))
    starts = F.when(bucket % 5 == 1, bucket - 1).otherwise(bucket), F.coalesce(crc_bucket(F.col("item_id"), 150), F.lit(0))
    target = new_folder(spark, "co-bucket")
    out = co_bucket(sales, lines, ("sales", "sale_lines"), "sale_id", starts, 152, 150, "pair", target)
    return out.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
