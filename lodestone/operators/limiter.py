"""Spacing of requests with back-off and holds, for a stream of requests and for a stored table of them.

A lane starts its requests in the order of their arrival, each no sooner than `interval` times the
back-off after the start before. An answer that asks to slow down doubles the back-off, from two up to
eight; any other answer lets it decay by a tenth, down to one. An answer is in force for what starts
after it. While a lane is held, nothing starts; it goes on one interval after its release.

A stream keeps a lane's next start, back-off and waiting requests as state. A stored table is
computed without a task per lane: within a stretch of equal spacing a start is max(arrival, start
before + spacing), which composes, so stretches of a lane are summed up by tasks of their own and only
the sums, one for each stretch, are put one behind the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lodestone.cluster import ship

MOST, DECAY = 8.0, 0.9
BLOCK = 4096
"""Requests of a lane that are one row of the scan over its blocks."""


def slower(backoff: float) -> float:
    return min(MOST, max(2.0, backoff * 2))


def faster(backoff: float) -> float:
    return max(1.0, backoff * DECAY)


def backoffs(slow: np.ndarray, before: float = 1.0) -> np.ndarray:
    """The back-off in force at each request of a lane, whose answers come before the next one starts."""
    out, now = np.empty(len(slow)), before
    for i, s in enumerate(slow.tolist()):
        out[i] = now
        now = slower(now) if s else faster(now)
    return out


# The back-off after n answers is a clamped multiple of the one before: min(high, max(low, factor * b)).
# Such maps compose, so blocks of a lane are summed up apart.


def composed(f: tuple[float, float, float], g: tuple[float, float, float]) -> tuple[float, float, float]:
    """g after f; each is (factor, low, high)."""
    low, high = (min(g[2], max(g[1], g[0] * x)) for x in (f[1], f[2]))
    return f[0] * g[0], low, high


SLOW_MAP, FAST_MAP = (2.0, 2.0, MOST), (DECAY, 1.0, MOST)


def applied(f: tuple[float, float, float], b: float) -> float:
    return min(f[2], max(f[1], f[0] * b))


def starts(requests: DataFrame, interval_ms: int, lane: str = "lane", at: str = "at_ms", slow: str = "slow", order: list[str] | None = None) -> DataFrame:
    """requests with backoff and start_ms.

    Two passes over blocks of at most BLOCK requests of a lane. The first gives each block's map of
    back-offs, and these are composed along the lane; with the back-off that a block begins with, its
    spacings are known, hence its map of starts x -> max(x + a, c), which are composed likewise. The
    composing walks over blocks, not requests; the last pass fills each block in.
    """
    ship(requests.sparkSession)
    order = order or [at]
    own = requests.columns
    # blocks by place in the lane: places by counts of time slices, so that a lane is sorted by many tasks
    placed = in_lanes(requests, lane, order)
    small = placed.select(lane, "__block", "__i", at, slow)
    of_backoff = small.groupBy(lane, "__block").applyInArrow(_backoff_map, f"{lane} {_kind(requests, lane)}, __block long, factor double, low double, high double")
    first = of_backoff.groupBy(lane).applyInArrow(_walk_backoffs, f"{lane} {_kind(requests, lane)}, __block long, before double")
    of_start = small.join(first, [lane, "__block"]).groupBy(lane, "__block").applyInArrow(_start_map(at, slow, interval_ms), f"{lane} {_kind(requests, lane)}, __block long, before double, a double, c double")
    begun = of_start.groupBy(lane).applyInArrow(_walk_starts, f"{lane} {_kind(requests, lane)}, __block long, before double, ready double")
    schema = StructType([*placed.schema.fields]).add("backoff", "double").add("start_ms", "long")
    full = placed.join(begun, [lane, "__block"]).groupBy(lane, "__block").applyInArrow(_filled(at, slow, interval_ms, placed.columns), schema)
    return full.select(*own, "backoff", "start_ms")


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def in_lanes(df: DataFrame, lane: str, order: list[str]) -> DataFrame:
    """df with __i, the place of a row in its lane from 0, and __block, its block.

    Rows are sorted over all lanes at once by ranges, and each range numbers its own rows of a lane; the
    counts of the ranges before, a row for each range and lane, give the rest.
    """
    from lodestone.cluster import written

    cut = written(df.repartitionByRange(lane, *order).sortWithinPartitions(lane, *order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "lanes")
    per = cut.groupBy("__part", lane).agg(F.count(F.lit(1)).alias("rows"), F.min("__row").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(lane).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("__part", F.col(lane).alias("__lane"), "first", before.alias("before"))
    at = cut.join(offsets, (cut["__part"] == offsets["__part"]) & cut[lane].eqNullSafe(offsets["__lane"])).drop(offsets["__part"])
    i = F.col("before") + F.col("__row") - F.col("first")
    return at.withColumn("__i", i).withColumn("__block", F.floor(F.col("__i") / BLOCK)).drop("__part", "__row", "__lane", "first", "before")


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    table = table.sort_by("__i")
    return [table[n].to_numpy() for n in names]


def _backoff_map(key: tuple, table: pa.Table) -> pa.Table:
    slow = table.sort_by("__i").column(table.num_columns - 1).to_numpy()
    f = (1.0, 0.0, MOST)
    for s in slow.tolist():
        f = composed(f, SLOW_MAP if s else FAST_MAP)
    return pa.table({table.column_names[0]: [key[0]], "__block": [key[1]], "factor": [f[0]], "low": [f[1]], "high": [f[2]]}, schema=pa.schema([table.schema.field(0), ("__block", pa.int64()), ("factor", pa.float64()), ("low", pa.float64()), ("high", pa.float64())]))


def _walk_backoffs(key: tuple, table: pa.Table) -> pa.Table:
    table, now, before = table.sort_by("__block"), 1.0, []
    for f in zip(*(table[c].to_pylist() for c in ("factor", "low", "high")), strict=True):
        before.append(now)
        now = applied(f, now)
    return table.select([0, 1]).append_column("before", pa.array(before, pa.float64()))


def _start_map(at: str, slow: str, interval: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        times, flags, before = _columns(table, at, slow, "before")
        gap = interval * backoffs(flags, float(before[0]))
        # ready -> ready after the block: max(ready + all gaps, the last arrival that sets the pace)
        left = np.cumsum(gap[::-1])[::-1]
        schema = pa.schema([table.schema.field(0), ("__block", pa.int64()), ("before", pa.float64()), ("a", pa.float64()), ("c", pa.float64())])
        return pa.table({table.column_names[0]: [key[0]], "__block": [key[1]], "before": [float(before[0])], "a": [float(gap.sum())], "c": [float((times + left).max())]}, schema=schema)

    return run


def _walk_starts(key: tuple, table: pa.Table) -> pa.Table:
    table, now, ready = table.sort_by("__block"), -np.inf, []
    for a, c in zip(table["a"].to_pylist(), table["c"].to_pylist(), strict=True):
        ready.append(now)
        now = max(now + a, c)
    return table.select([0, 1, 2]).append_column("ready", pa.array(ready, pa.float64()))


def _filled(at: str, slow: str, interval: int, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        times, flags, before, ready = (table[c].to_numpy() for c in (at, slow, "before", "ready"))
        b = backoffs(flags, float(before[0]))
        gap = interval * b
        done = np.cumsum(gap) - gap  # of the block before each request
        begin = np.maximum(np.maximum.accumulate(times - done), ready[0]) + done
        return table.select(names).append_column("backoff", pa.array(b)).append_column("start_ms", pa.array(np.ceil(begin - 1e-6).astype(np.int64)))

    return run


class Limiter(StatefulProcessor):
    """Starts of a lane's requests as a stream, with holds.

    Rows: lane, at_ms, kind (request, slow, fast, hold, release), request_id. A request that comes while
    the lane is held waits in the state; the release starts all of them.
    """

    def __init__(self, interval_ms: int):
        self.interval = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lane", "ready double, backoff double, held boolean")
        self.waiting = handle.getListState("waiting", "request_id string, at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        ready, backoff, held = self.state.get() if self.state.exists() else (0.0, 1.0, False)
        waiting = [tuple(w) for w in self.waiting.get()] if self.waiting.exists() else []
        out: list[tuple[str, str, int]] = []

        def start(request: str, at: float) -> None:
            nonlocal ready
            begin = max(float(at), ready)
            ready = begin + self.interval * backoff
            out.append((key[0], request, int(np.ceil(begin - 1e-6))))

        events = pd.concat(list(rows)).sort_values(["at_ms", "request_id"], kind="stable")
        for at, kind, request in zip(events["at_ms"], events["kind"], events["request_id"], strict=True):
            if kind == "request" and held:
                waiting.append((request, int(at)))
            elif kind == "request":
                start(request, at)
            elif kind == "slow":
                backoff = slower(backoff)
            elif kind == "fast":
                backoff = faster(backoff)
            elif kind == "hold":
                held = True
            elif kind == "release" and held:
                held, ready = False, float(at) + self.interval
                for request_id, came in waiting:
                    start(request_id, max(came, at))
                waiting = []
        self.state.update((float(ready), float(backoff), bool(held)))
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        yield pd.DataFrame(out, columns=["lane", "request_id", "start_ms"])

    def close(self) -> None:
        pass


def limited(events: DataFrame, interval_ms: int) -> DataFrame:
    """Starts (lane, request_id, start_ms) of a stream of events (lane, at_ms, kind, request_id), in the order of the stream's batches."""
    ship(events.sparkSession)
    return events.groupBy("lane").transformWithStateInPandas(Limiter(interval_ms), outputStructType="lane string, request_id string, start_ms long", outputMode="Append", timeMode="None")
