"""Stateful streams: recent items of a session with a cap, events folded in event-time order, and an incremental rebuild.

State is kept by transformWithState (RocksDB), bounded for each key by a parameter or by the lateness
that the watermark allows. Each stream has a batch form of the same meaning, and tests hold one against the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB state store; a session that has chosen a provider keeps it."""
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, ROCKSDB)


# sessions: the items used last


class _Recent(StatefulProcessor):
    """Keeps for a session its `cap` items of the latest use, and closes it `idle_ms` after the last one if that is given."""

    def __init__(self, cap: int, idle_ms: int | None):
        self.cap, self.idle_ms = cap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", T.StructType([T.StructField("item", T.StringType()), T.StructField("used", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        used = dict(self.items.get()) if self.items.exists() else {}
        for pdf in rows:
            for item, at in zip(pdf["item"], pdf["used"]):
                used[item] = max(int(at), used.get(item, int(at)))
        left = sorted(used.items(), key=lambda x: (-x[1], x[0]))[: self.cap]
        self.items.put(left)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(left[0][1] // 1000 + self.idle_ms)
        yield pd.DataFrame([(key[0], i, item, at, False) for i, (item, at) in enumerate(left, 1)], columns=["session", "rank", "item", "used", "closed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        left = list(self.items.get())
        self.items.clear()
        yield pd.DataFrame([(key[0], i, item, at, True) for i, (item, at) in enumerate(left, 1)], columns=["session", "rank", "item", "used", "closed"])

    def close(self) -> None:
        pass


_RECENT = "session long, rank long, item string, used long, closed boolean"


def recent_items(uses: DataFrame, cap: int, idle_ms: int | None = None) -> DataFrame:
    """session, rank, item, used (microseconds), closed: after each batch the items that a session used last, latest first.

    uses: a stream of session (long), item, ts. An item that is used again moves to the front; beyond
    cap the one used longest ago goes. What has gone can't come back but by a later use, so the result
    doesn't depend on the order in which events arrive. With idle_ms a session whose last use lies
    so far behind the watermark is told once more as closed, and forgotten.
    """
    with_rocksdb(uses.sparkSession)
    rows = uses.where("session is not null and item is not null and ts is not null").withColumn("used", F.unix_micros("ts"))
    # rows that another batch brings behind the watermark still count while no timer hangs on it
    rows = rows.withWatermark("ts", "0 seconds") if idle_ms is not None else rows
    mode = "eventTime" if idle_ms is not None else "none"
    return rows.groupBy("session").transformWithStateInPandas(_Recent(cap, idle_ms), _RECENT, "append" if idle_ms is not None else "update", mode)


def recent_items_of(uses: DataFrame, cap: int) -> DataFrame:
    """session, rank, item, used: the batch form."""
    from graphmill.operators.relational import first_per

    last = uses.where("session is not null and item is not null and ts is not null").groupBy("session", "item").agg(F.max(F.unix_micros("ts")).alias("used"))
    return first_per(last, ["session"], [F.desc("used"), "item"], "rank", cap).select("session", F.col("rank").cast("long").alias("rank"), "item", "used")


# events in their order


class _Ordered(StatefulProcessor):
    """Holds events until the watermark has passed them, then folds them in the order of (ts, id). An entry has one timer, at its earliest event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("at", T.LongType()), T.StructField("id", T.LongType()), T.StructField("kind", T.StringType())]))
        self.folded = handle.getValueState("folded", T.StructType([T.StructField("verified", T.LongType()), T.StructField("negated", T.LongType()), T.StructField("confidence", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            at = pdf["at"].tolist()
            self.waiting.appendList(list(zip(at, pdf["id"].tolist(), pdf["kind"].tolist())))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self._wake(first, list(self.handle.listTimers()))
        yield from ()

    def _wake(self, first: int, due: list[int]) -> None:
        """The timer goes to the earliest event that waits."""
        t = first // 1000 + 1
        if due and min(due) <= t:
            return
        for old in due:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        now = [x for x in rows if x[0] < end]
        if not now:
            return
        state = self.folded.get() or (0, 0, 0.0)
        for _, _, kind in now:
            state = folded(*state, kind)
        self.folded.update(state)
        if len(now) < len(rows):
            self.waiting.put(rows[len(now) :])
            self.handle.registerTimer(rows[len(now)][0] // 1000 + 1)
        else:
            self.waiting.clear()
        yield pd.DataFrame([(key[0], now[-1][0], *state)], columns=_FOLDED_NAMES)

    def close(self) -> None:
        pass


_FOLDED = "entry long, at long, verified long, negated long, confidence double"
_FOLDED_NAMES = ["entry", "at", "verified", "negated", "confidence"]
STEP = 0.25


def folded(verified: int, negated: int, confidence: float, kind: str) -> tuple[int, int, float]:
    """The state after one event: `verify` adds STEP, at most 1; `negate` halves."""
    if kind == "verify":
        return verified + 1, negated, min(1.0, confidence + STEP)
    if kind == "negate":
        return verified, negated + 1, confidence / 2
    return verified, negated, confidence


def ordered_fold(events: DataFrame, late: str) -> DataFrame:
    """entry, at, verified, negated, confidence: the fold of each entry's events up to the watermark, told when it moves on.

    events: a stream of entry (long), id (long), kind, ts. Events that come up to `late` after later
    ones are folded in their place; events behind the watermark are dropped by the stream, which is what
    `late` says. State is the events of the last `late` and one row for each entry.
    """
    with_rocksdb(events.sparkSession)
    rows = events.where("entry is not null and ts is not null").withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("entry").transformWithStateInPandas(_Ordered(), _FOLDED, "append", "eventTime")


def ordered_fold_of(events: DataFrame) -> DataFrame:
    """entry, at, verified, negated, confidence: the batch form over all events. The events of one entry meet in one row."""
    rows = events.where("entry is not null and ts is not null").groupBy("entry").agg(F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("at"), "id", "kind"))).alias("x"))
    value = F.aggregate("x", F.lit(0.0), lambda s, e: F.when(e["kind"] == "verify", F.least(F.lit(1.0), s + STEP)).when(e["kind"] == "negate", s / 2).otherwise(s))
    n = lambda kind: F.size(F.filter("x", lambda e: e["kind"] == kind)).cast("long")
    return rows.select("entry", F.element_at("x", -1)["at"].alias("at"), n("verify").alias("verified"), n("negate").alias("negated"), value.alias("confidence"))


# incremental rebuild


class VersionedTable:
    """A table of which each version is a folder; the newest one that was written to its end is the table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Whole versions in order: Spark leaves _SUCCESS when all tasks have committed."""
        root = self._path(self.folder)
        names = [x.getPath().getName() for x in self._fs.listStatus(root)] if self._fs.exists(root) else []
        found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
        return [v for v in found if self._fs.exists(self._path(f"{self.folder}/v={v}/_SUCCESS"))]

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest one under `before`; None where there is none."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.folder}/v={found[-1]}") if found else None

    def write(self, df: DataFrame, version: int, keep: int = 2) -> None:
        """Writes a version, in place of an earlier try at it, and deletes all but the newest `keep` whole ones."""
        df.write.mode("overwrite").parquet(f"{self.folder}/v={version}")
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/v={v}"), True)


def merged_by_hash(old: DataFrame | None, scan: DataFrame) -> DataFrame:
    """The table after a scan of some files: a file whose hash is new or other brings its rows, one marked deleted loses them.

    scan: path, hash, deleted, rows (an array); the last scan of a path (seq) counts. old and the result:
    path, hash, row. A file of an unchanged hash keeps its rows and isn't read again.
    """
    last = scan.where("path is not null").groupBy("path").agg(F.max_by(F.struct("hash", "deleted", "rows"), "seq").alias("x")).select("path", "x.*")
    if old is None:
        return last.where("not deleted").select("path", "hash", F.explode("rows").alias("row"))
    known = old.select("path", F.col("hash").alias("_known")).distinct()
    changed = last.join(known, "path", "left").where(F.col("deleted") | F.col("_known").isNull() | (F.col("_known") != F.col("hash")))
    kept = old.join(changed.select("path"), "path", "left_anti")
    return kept.unionByName(changed.where("not deleted").select("path", "hash", F.explode("rows").alias("row")))


def rebuild_stream(scans: DataFrame, folder: str, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Merges each batch of scans into the table in folder. A batch that runs again, as after a crash, starts from the version before it, so it leaves the same table.

    after is called with the number of a batch once its version is written, before the stream notes it as done.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, folder)
        table.write(merged_by_hash(table.read(before=number), batch), number)
        if after is not None:
            after(number)

    return scans.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
