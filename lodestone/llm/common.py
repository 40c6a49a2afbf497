"""Shared helpers of the operators: staged tables, plain columns and connected components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.cluster import shared_dir, ship  # noqa: F401

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A session setting for the jobs within."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
"""Tables staged by the innermost cleared() or tidied() of this thread."""


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the stored table.

    This cuts the lineage: a lost executor costs no more than the running job, and what is read
    several times is computed once. Spark deletes the job's shuffle files when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    own = _scope.get()
    if own is not None:
        own.append(path)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more; what is not staged is left alone."""
    own = _scope.get()
    for df in tables:
        if (path := getattr(df, "staged_at", None)) is not None:
            delete(df.sparkSession, path)
            if own is not None and path in own:
                own.remove(path)


@contextmanager
def cleared(spark: SparkSession, keep: Callable[[], DataFrame | None] = lambda: None) -> Iterator[None]:
    """Removes the tables staged within, but for the one that keep() names at the end, if all went well.

    Each thread has its own, so runs at the same time do not touch each other's tables.
    """
    outer, own = _scope.get(), []
    token, stays = _scope.set(own), None
    try:
        yield
        stays = getattr(keep(), "staged_at", None)
    finally:
        _scope.reset(token)
        for path in own:
            if path != stays:
                delete(spark, path)
        if stays is not None and outer is not None:
            outer.append(stays)


def tidied(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query; if it fails, what it had staged is removed. Its result may read staged tables, so they stay if it succeeds."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        outer, own = _scope.get(), []
        token = _scope.set(own)
        try:
            out = query(spark, sf_dir)
        except BaseException:
            for path in own:
                delete(spark, path)
            raise
        finally:
            _scope.reset(token)
        if outer is not None:
            outer += own
        return out

    return run


def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of fewer rows for the jobs within, as texts are long; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = int(spark.conf.get(key))
    return setting(spark, key, min(old, rows) if old > 0 else rows)


def trim() -> None:
    """Gives a Python worker's freed memory back to the system, where its C library can do so."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps it
        return


def make_room(df: DataFrame, *names: str) -> DataFrame:
    """df in which columns with the names of results are called `<name>_input`, so that none is lost."""
    for name in names:
        if name in df.columns:
            other = f"{name}_input"
            while other in df.columns:
                other += "_input"
            df = df.withColumnRenamed(name, other)
    return df


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(docs[text], F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v): rows (node, component), the smallest node.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond", 2014) until the edge set is stable. Each step is a grouped minimum, which combines
    on the map side, and a join, whose skewed side adaptive execution splits. Only a count and a
    checksum reach the driver. Nodes without an edge are absent from the result. Every round shortens
    the paths to the least node, so there is no limit to their number.
    """

    def directed(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large(e: DataFrame) -> DataFrame:
        both = directed(e)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        rest = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.union(low.select("u", F.col("m").alias("v"))).distinct()

    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        # the checksum is taken over the edge set, which the last step leaves free of repeats
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        step = stage(small(large(now)), "edges")
        release(now)
        now = step
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = stage(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    release(now)
    return out


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running totals of an array under an associative op.

    Doubling (Hillis and Steele, "Data Parallel Algorithms", 1986): a pass for each power of two below
    the size, each a plain transform, so nothing is copied element by element as in a fold that appends.
    """

    def scan(a: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            shift = F.call_function("shiftleft", F.lit(1), k)
            return F.transform(acc, lambda x, i: F.when(i < shift, x).otherwise(op(F.get(acc, i - shift), x)))

        last = F.ceil(F.log2(F.size(a).cast("double"))).cast("int") - 1
        return F.when(F.size(a) > 1, F.aggregate(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), a, step)).otherwise(a)

    return bind(values, scan)


def find_all(text: Column, pattern: Column | str, around: int = 0, measure: Callable[[Column], Column] = F.char_length) -> Column:
    """All matches of a pattern from left to right: array of (start, match), in code points.

    The parts between the matches and the matches themselves add up to the text, so each start is
    the running total of what stands before. The pattern must not match the empty string. With
    `around`, `before` and `after` are up to so many characters of the parts beside the match.
    `measure` counts something else than characters.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def part(gap: Column, match: Column) -> Column:
        more = (F.substr(gap, F.lit(-around), F.lit(around)).alias("before"), F.substr(gap, F.lit(1), F.lit(around)).alias("head")) if around else ()
        size = F.coalesce(measure(match), F.lit(0))
        return F.struct((F.coalesce(measure(gap), F.lit(0)) + size).alias("both"), size.alias("size"), match.alias("match"), *more)

    def placed(parts: Column) -> Column:
        def of(ends: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                more = (x["before"].alias("before"), F.get(parts, i + 1)["head"].alias("after")) if around else ()
                return F.struct((F.get(ends, i) - x["size"]).alias("start"), x["match"].alias("match"), *more)

            # the last part has no match behind it
            return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)

        return bind(running(F.transform(parts, lambda x: x["both"]), lambda a, b: a + b), of)

    return bind(F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, regex, F.lit(0)), part), placed)
