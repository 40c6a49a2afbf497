"""Stored tables with time to live: newest row per key, freshness, retention, operations."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.cluster import removed, written
from lodestone.functions.text import RESERVED, UNSAFE
from lodestone.plans.expression import QueryError

SCHEMA_VERSION = 1
RETENTION_DAYS = {"operations": 7, "searches": 14, "snapshots": 60}
CACHE_MINUTES, DETAIL_DAYS, PRESENT_DAYS, UNKNOWN_DAYS = 10, 30, 7, 1
BUCKETS = 64
PENDING = "log-"
"""Names of batches that are seen once the log has them begin with it."""
RESUMABLE = ("BUDGET_EXHAUSTED", "SITE_TEMPORARILY_EMPTY", "RATE_LIMITED", "TIMEOUT")


def bucket_of(key: Column) -> Column:
    """Bucket of a key: its CRC-32 modulo BUCKETS, which zlib gives alike."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(BUCKETS)).cast("int")


def newest(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The newest row of each key; combines on the map side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("row")).select(key, "row.*")


def fresh(ts: Column | str, as_of: Column, **age: int) -> Column:
    """Younger than the age at as_of."""
    seconds = age.get("days", 0) * 86400 + age.get("minutes", 0) * 60
    c = F.col(ts) if isinstance(ts, str) else ts
    return c.cast("timestamp") > as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def detail_fresh(ts: Column | str, parser: Column, version: int, as_of: Column) -> Column:
    """Read by the current parser within 30 days."""
    return F.coalesce((parser == version) & fresh(ts, as_of, days=DETAIL_DAYS), F.lit(False))


def prune(df: DataFrame, kind: str, as_of: Column, ts: str = "ts") -> DataFrame:
    return df.where(fresh(ts, as_of, days=RETENTION_DAYS[kind]))


def cached(searches: DataFrame, as_of: Column) -> DataFrame:
    """Searches that may answer again."""
    return searches.where(fresh("ts", as_of, minutes=CACHE_MINUTES))


def cached_search(searches: DataFrame, cache_key: str, as_of: Column) -> DataFrame:
    """The newest search of a key within ten minutes, or no row."""
    return cached(searches.where(F.col("cache_key") == cache_key), as_of).orderBy(F.desc("ts")).limit(1)


def spacing(events: DataFrame, interval_ms: int, by: str, ts_ms: str, order: list[str]) -> DataFrame:
    """Start of each request at least interval_ms after the one before: max(t_j - j d) + i d, in closed form."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(*order)
    i = F.row_number().over(w).cast("long")
    df = events.withColumn("__i", i)
    start = F.max(F.col(ts_ms) - F.col("__i") * interval_ms).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__i") * interval_ms
    return df.withColumn("start_ms", start).drop("__i")


def resumable(status: Column, errors: Column) -> Column:
    return (status == "interrupted") | F.exists(errors, lambda e: e.isin(*RESUMABLE))


# Marks of a page that asks for a human, codes that end a run.
CHALLENGE = """<title>\\s*安全验证\\s*</title>|id=["']?vericode|name=["']?vericodeForm"""
FATAL = ("BUDGET_EXHAUSTED", "RATE_LIMITED", "SITE_UNAVAILABLE", "VERIFICATION_TIMEOUT", "LOGIN_REQUIRED", "QUERY_TEMPLATE_UNAVAILABLE", "QUERY_TEMPLATE_UNSUPPORTED", "CANCELLED", "BROWSER_UNAVAILABLE")


def error_class(status: Column, body: Column, url: Column) -> Column:
    """Code of the problem that a response shows; null if it shows none."""
    return (
        F.when(status == 429, "RATE_LIMITED").when(body.rlike(CHALLENGE), "VERIFICATION_REQUIRED").when((status == 401) | F.contains(url, F.lit("//login.")), "LOGIN_REQUIRED")
        .when(status == 403, "ACCESS_DENIED").when(status == 404, "LOCATOR_EXPIRED").when(status >= 500, "SITE_UNAVAILABLE")
    )


def fatal(code: Column) -> Column:
    """Whether a problem ends the run; the others concern one record."""
    return F.coalesce(code.isin(*FATAL), F.lit(False))


def with_context(problems: DataFrame, stage: str, *keys: str) -> DataFrame:
    """problems (code, ref, title) with the stage they arose in: (keys, code, fatal, details); details name the record where the problem is not fatal."""
    about = F.struct(F.col("ref").alias("record_ref"), "title", F.lit(stage).alias("stage"))
    return problems.select(*keys, "code", fatal(F.col("code")).alias("fatal"), F.when(~fatal(F.col("code")), F.to_json(about)).alias("details"))


@dataclass
class Operation:
    """Audit record of a run: budget, stages, progress, errors; cancelling interrupts its Spark jobs by tag.

    A run whose budget ends is partial: what its stages have finished is its checkpoint, from which
    a run of the same id goes on with a larger budget.
    """

    kind: str
    budget: int = 600
    id: str = field(default_factory=lambda: f"op_{uuid.uuid4().hex[:16]}")
    status: str = "running"
    stage: str = ""
    used: int = 0
    errors: list[str] = field(default_factory=list)
    done: list[str] = field(default_factory=list)
    progress: tuple[int, int] | None = None
    active_seconds: float = 0.0

    def charge(self, n: int = 1) -> None:
        if self.status == "cancelled":
            raise OperationStopped("CANCELLED")
        if self.used + n > self.budget:
            self.status = "interrupted"
            self.errors.append("BUDGET_EXHAUSTED")
            raise OperationStopped("BUDGET_EXHAUSTED")
        self.used += n

    def resumed(self, extra: int = 200) -> Operation:
        """The same run with more budget, its errors cleared."""
        if self.status == "completed":
            raise QueryError("OPERATION_STATE", "the run is finished")
        if not resumable_run(self):
            raise QueryError("CONTINUE_UNAVAILABLE", self.id)
        return replace(self, budget=max(self.budget, self.used) + extra, status="running", errors=[], done=list(self.done))

    def start(self, spark: SparkSession, stage: str) -> None:
        spark.addTag(self.id)
        self.stage = stage

    def finish(self, spark: SparkSession, stage: str, failed: bool = False) -> None:
        spark.removeTag(self.id)
        if not failed:
            self.done.append(stage)

    def cancel(self, spark: SparkSession) -> None:
        spark.interruptTag(self.id)
        self.status = "cancelled"

    def view(self) -> dict:
        """What a client sees: a finished run is its status, any other one says how to go on."""
        if self.status == "completed":
            return {"status": "completed"}
        out: dict = {"status": self.status}
        if self.status in ("running", "interrupted", "partial"):
            out["operation_id"] = self.id
        if self.status == "running":
            out |= {"stage": self.stage} if self.stage else {}
            out |= {"progress": "{}/{}".format(*self.progress)} if self.progress else {}
        elif self.errors:
            out["errors"] = [{"code": e} for e in self.errors]
        if self.kind == "search" and resumable_run(self):
            out["next"] = "resume(search_id)"
        return out


class OperationStopped(RuntimeError):
    """A run's budget is used up or it was cancelled."""


def resumable_run(op: Operation) -> bool:
    return op.status in ("interrupted", "partial") or any(e in RESUMABLE for e in op.errors)


class Store:
    """Parquet tables below a root.

    A table is a base version, written as a whole, and the batches appended since. A batch has a name;
    one that is there already is not written again, so a replay changes nothing, and writers of
    different batches do not meet. compact() makes a new base, whose list of batches is written before
    it, so that a crash between the two neither loses nor doubles a row.

    What depends on the rows before it goes through the table's log: a writer reads, writes its rows
    out of sight and then creates the log's next entry, which only one can. Who comes late starts anew
    from what the other has written, so versions follow one another and no change is lost.

    Tables with a key lie in buckets by its checksum, sorted and with Bloom filters on it, so that a
    lookup of few keys opens the files of their buckets and reads the row groups that may have them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        schema = f"{self.root}/schema"
        if self.root and not self._names(f"{self.root}") and not self._exists(schema):
            spark.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.mode("ignore").json(schema)
        elif self._exists(schema):
            version = spark.read.json(schema).first()["version"]
            if version != SCHEMA_VERSION:
                raise QueryError("STORE_VERSION", f"version {version}, expected {SCHEMA_VERSION}")

    def _exists(self, path: str) -> bool:
        p = self._path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _names(self, path: str) -> list[str]:
        p = self._path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _complete(self, name: str, lead: str) -> list[str]:
        base = f"{self.root}/v{SCHEMA_VERSION}/{name}"
        return [n[2:] for n in self._names(base) if n.startswith(lead) and self._exists(f"{base}/{n}/_SUCCESS")]

    def versions(self, name: str) -> list[int]:
        return sorted({int(n.split("-")[0]) for n in self._complete(name, "n=")})

    def batches(self, name: str) -> list[str]:
        """Names of the appended batches that the base does not hold."""
        held, logged = self._held(name), set(self._log(name).values())
        return [b for b in self._complete(name, "a=") if b not in held and (not b.startswith(PENDING) or b in logged)]

    def _log(self, name: str) -> dict[int, str]:
        """The table's log: number of an entry to the batch that it made visible."""
        folder = f"{self.root}/v{SCHEMA_VERSION}/{name}/log"
        if not [n for n in self._names(folder) if n[0] != "."]:
            return {}
        rows = self.spark.read.text(folder).select(F.col("_metadata.file_name").alias("entry"), "value").collect()  # an entry for each change since the last base
        return {int(r["entry"]): r["value"] for r in rows}

    def _claim(self, name: str, number: int, batch: str) -> bool:
        """Creates an entry of the log, unless there is one of that number."""
        try:
            write_file(self.spark, f"{self.root}/v{SCHEMA_VERSION}/{name}/log", f"{number:012d}", batch.encode())
        except QueryError as e:
            if e.code != "FILE_EXISTS":
                raise
            return False
        return True

    def commit(self, name: str, make: Callable[[int], DataFrame | None], key: str | None = None) -> int:
        """Appends what make(version) gives of the table as it then is; made anew while others come first. Gives the version."""
        while True:
            number, batch = max(self._log(name), default=0) + 1, f"{PENDING}{uuid.uuid4().hex}"
            rows = make(number)
            if rows is None:
                return number - 1
            self._put(name, rows, batch, key=key)
            if self._claim(name, number, batch):
                return number
            self._delete(f"{self.root}/v{SCHEMA_VERSION}/{name}/a={batch}")

    def exists(self, name: str) -> bool:
        """Whether there is a file or folder of a name below the root."""
        return self._exists(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        return self._names(f"{self.root}/{folder}")

    def delete(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        p = self._path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _base(self, name: str) -> str | None:
        found = sorted(self._complete(name, "n="), key=lambda n: (int(n.split("-")[0]), n))
        return found[-1] if found else None

    def _held(self, name: str) -> set[str]:
        base = self._base(name)
        path = f"{self.root}/v{SCHEMA_VERSION}/{name}/m={base}"
        return {r["batch"] for r in self.spark.read.schema("batch string").json(path).collect()} if base and self._exists(path) else set()

    def has(self, name: str, batch: str) -> bool:
        return batch in self._held(name) or batch in self._complete(name, "a=")

    def read(self, name: str) -> DataFrame | None:
        folder, base = f"{self.root}/v{SCHEMA_VERSION}/{name}", self._base(name)
        parts = [self.spark.read.parquet(f"{folder}/n={base}")] if base else []
        # a batch without rows that is laid out by a column has no file
        parts += [self.spark.read.parquet(f"{folder}/a={b}") for b in self.batches(name) if any(n[0] not in "_." for n in self._names(f"{folder}/a={b}"))]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def write(self, name: str, df: DataFrame) -> None:
        """A new base in place of all that the table holds; readers keep theirs."""
        self._rebase(name, df, sorted(self._held(name) | set(self.batches(name))))

    def _rebase(self, name: str, df: DataFrame, held: list[str]) -> None:
        found = self.versions(name)
        base, folder = f"{(found[-1] if found else 0) + 1}-{uuid.uuid4().hex[:8]}", f"{self.root}/v{SCHEMA_VERSION}/{name}"
        if held:
            self.spark.createDataFrame([(b,) for b in held], "batch string").coalesce(1).write.json(f"{folder}/m={base}")
        df.write.mode("errorifexists").parquet(f"{folder}/n={base}")

    def append(self, name: str, df: DataFrame, batch: str | None = None, partition: str | None = None) -> None:
        """Adds a batch; one whose name is known is left alone."""
        batch = batch or uuid.uuid4().hex
        if not self.has(name, batch):
            self._put(name, df, batch, partition)

    def append_keyed(self, name: str, df: DataFrame, key: str, batch: str | None = None) -> None:
        """The same for a table with a key."""
        batch = batch or uuid.uuid4().hex
        if not self.has(name, batch):
            self._put(name, df, batch, key=key)

    def _put(self, name: str, df: DataFrame, batch: str, partition: str | None = None, key: str | None = None) -> None:
        if key:
            partition = "bucket"
            df = df.withColumn("bucket", bucket_of(F.col(key))).repartition("bucket").sortWithinPartitions("bucket", key)
        writer = df.write.mode("overwrite")  # what a broken attempt left behind
        if key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", "100000")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{self.root}/v{SCHEMA_VERSION}/{name}/a={batch}")

    def lookup(self, name: str, key: str, values: list[str]) -> DataFrame | None:
        """Rows of a table with a key that have one of a few values; opens the buckets of these alone."""
        now = self.read(name)
        buckets = sorted({zlib.crc32(v.encode()) % BUCKETS for v in values})
        return None if now is None else now.where(F.col("bucket").isin(buckets) & F.col(key).isin(values))

    def matching(self, name: str, key: str, values: DataFrame) -> DataFrame | None:
        """The same for a column of distinct values, however many."""
        now = self.read(name)
        if now is None:
            return None
        buckets = [r["b"] for r in values.select(bucket_of(F.col(key)).alias("b")).distinct().collect()]  # at most BUCKETS
        return now.where(F.col("bucket").isin(buckets)).join(values.select(key), key, "left_semi")

    def compact(self, name: str, reduce_rows=lambda df: df) -> None:
        """One base of the base and its batches; reduce_rows may drop rows that others replace."""
        now = self.read(name)
        if now is not None and self.batches(name):
            self._rebase(name, reduce_rows(now), sorted(self._held(name) | set(self.batches(name))))

    def update(self, name: str, key: str, value: str, change) -> None:
        """Changes the newest row of one key by a function of a one-row table: a new row supersedes it, whoever else writes."""

        def make(version: int) -> DataFrame:
            row = current(self.read(name), key).where(F.col(key) == value)
            return change(row.drop("version")).withColumn("version", F.lit(max(version, self.next_version(name))).cast("long"))

        self.commit(name, make)

    def next_version(self, name: str) -> int:
        """Larger than the version of any row that is stored."""
        now = self.read(name)
        return 0 if now is None or "version" not in now.columns else (now.agg(F.max("version")).first()[0] or 0) + 1


def current(df: DataFrame, key: str) -> DataFrame:
    """The row of the highest version of each key; all rows where there are no versions."""
    return newest(df, key, "version") if "version" in df.columns else df


def import_legacy(store: Store, path: str) -> bool:
    """Papers, sources and artifacts of a version-5 JSON file; another version or an unreadable file leaves the store as it is.

    The file is parsed once, by Spark, and its members become rows of one table; each of the store's tables
    is one append from there.
    """
    spark, names = store.spark, ("papers", "sources", "artifacts")
    schema = "version int, " + ", ".join(f"{n} map<string,string>" for n in names)
    file = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("f"))
    none = F.array().cast("array<struct<kind:string,key:string,record:string>>")

    def members(name: str) -> Column:
        return F.coalesce(F.transform(F.map_entries(f"f.{name}"), lambda e: F.struct(F.lit(name).alias("kind"), e["key"].alias("key"), e["value"].alias("record"))), none)

    rows = file.where("f.version = 5").select(F.inline(F.concat(F.array(F.struct(F.lit("version").alias("kind"), F.lit("").alias("key"), F.lit("5").alias("record"))), *map(members, names))))
    read = written(rows, "legacy")
    if read.where("kind = 'version'").isEmpty():
        removed(read)
        return False
    for name, key in (("papers", "ref"), ("sources", "key"), ("artifacts", "key")):
        some = read.where((F.col("kind") == name) & F.col("record").isNotNull() & (F.col("record") != "null"))
        if name == "papers":
            some = some.withColumn("ref", F.get_json_object("record", "$.record_ref")).where("ref <> ''")
        store.append(name, some.select(key, "record"), f"legacy-{name}")
    removed(read)
    return True


def check_name(name: str) -> None:
    if not name or len(name) > 180 or name[0] == "." or name[-1] in ". " or re.search(UNSAFE, name) or re.match(RESERVED, name):
        raise QueryError("INVALID_FILENAME", name)


def write_json(spark: SparkSession, folder: str, name: str, value: object) -> str:
    """Writes one JSON file whole, in place of the one that has the name; readers see the old or the new one."""
    check_name(name)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    target, draft = path(f"{folder.rstrip('/')}/{name}"), path(f"{folder.rstrip('/')}/.write_{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    try:
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()))
        out.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf)
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    finally:
        fs.delete(draft, False)
    return target.toString()


def write_file(spark: SparkSession, folder: str, name: str, data: bytes) -> tuple[str, int, str]:
    """Writes one file, whole or not at all and never over another: (path, bytes, SHA-256).

    The bytes go to a file beside the target, which is then renamed; the file system refuses a name
    that is taken. For outputs of bounded size, such as exports.
    """
    check_name(name)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    target, draft = path(f"{folder.rstrip('/')}/{name}"), path(f"{folder.rstrip('/')}/.write_{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise QueryError("FILE_EXISTS", name)
    fs.mkdirs(target.getParent())
    try:
        out = fs.create(draft, False)
        out.write(bytearray(data))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf)
        none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
        except Py4JJavaError as e:
            raise QueryError("FILE_EXISTS", name) from e
    finally:
        fs.delete(draft, False)
    return target.toString(), len(data), hashlib.sha256(data).hexdigest()
