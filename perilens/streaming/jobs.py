"""Incremental jobs on Structured Streaming; each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from perilens.operators.upsert import touch


PART = "part_of_key"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, table: str) -> dict[int, int]:
    """Each part's newest finished version; the log has a line for every part that a batch wrote, a bounded number of parts."""
    try:
        log = spark.read.schema(f"number long, {PART} int").json(f"{table}/log")
        return {r[0]: r[1] for r in log.groupBy(PART).agg(F.max("number")).collect()}
    except AnalysisException:  # no folder yet
        return {}


def _snapshots(spark: SparkSession, table: str, parts: set[int] | None = None) -> tuple[DataFrame | None, int]:
    """The newest state of a table (of some ``parts``), and the number of its newest version; none and 0 before the first."""
    newest = _versions(spark, table)
    paths = [f"{table}/v{v}/{PART}={p}" for p, v in sorted(newest.items()) if parts is None or p in parts]
    return (spark.read.parquet(*paths) if paths else None), max(newest.values(), default=0)


def _log(spark: SparkSession, table: str, entries: list[tuple[int, int]]) -> None:
    spark.createDataFrame(entries, f"number long, {PART} int").coalesce(1).write.mode("append").json(f"{table}/log")


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> None:
    """Removes what no reader needs: versions of a part that had a newer one ``keep`` batches ago already, and all lines of the log but the newest.

    A reader that started within the last ``keep`` batches still finds its files. Only versions that the log has superseded go, and
    the log's one new file is there before its old ones go, so this can stop anywhere and be run again.
    """
    newest = _versions(spark, table)
    last = max(newest.values(), default=0)
    files, root = _files(spark, table)
    if not newest:
        return
    held: dict[str, list[int]] = {}
    versions = [v.getPath() for v in files.listStatus(root) if v.getPath().getName().startswith("v")]
    for version in versions:
        for part in files.listStatus(version):
            if part.isDirectory():
                held.setdefault(part.getPath().getName(), []).append(int(version.getName()[1:]))
    # What a reader of ``keep`` batches ago found stays, and all after it.
    base = {name: max((n for n in numbers if n <= last - keep), default=0) for name, numbers in held.items()}
    for version in versions:
        number = int(version.getName()[1:])
        own = [name for name, numbers in held.items() if number in numbers]
        old = [name for name in own if number < base[name]]
        if len(old) == len(own) and number <= last:
            files.delete(version, True)
        else:
            for name in old:
                files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(version, name), True)
    _, log = _files(spark, f"{table}/log")
    old = [f.getPath() for f in files.listStatus(log)]
    if len(old) > 2:
        _log(spark, table, sorted((v, p) for p, v in newest.items()))
        for f in old:
            files.delete(f, False)


def _keyed_table(stream: DataFrame, table: str, checkpoint: str, key: str, parts: int, keep: int, merged: Callable[[DataFrame | None, DataFrame], DataFrame]) -> StreamingQuery:
    """A table cut by the key's hash into ``parts``, of which a batch writes anew those that it touches, by ``merged`` of the old part's rows and its own.

    Older versions stay as they are until ``keep`` batches later, and the batch's line in the log is what makes its version count. So a batch
    that is run again starts from the same older versions and has the same outcome, wherever it was stopped before.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        rows = rows.persist()
        try:
            touched = {r[0] for r in rows.select(part).distinct().collect()}
            old, _ = _snapshots(spark, table, touched)
            if max(_versions(spark, table).values(), default=0) > number or not touched:  # written before a restart, or empty
                return
            merged(old, rows).withColumn(PART, part).write.mode("overwrite").partitionBy(PART).parquet(f"{table}/v{number + 1}")
            _log(spark, table, [(number + 1, p) for p in sorted(touched)])  # only now it counts
            if (number + 1) % (8 * keep) == 0:
                vacuum(spark, table, keep)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_reviews(stream: DataFrame, table: str, checkpoint: str, key: str = "content_hash", first: str = "first_seen_at", last: str = "last_seen_at", parts: int = 64, keep: int = 2) -> StreamingQuery:
    """Reviews as they come: unknown hashes are added, a known one only moves its last time. See ``_keyed_table``; files are bounded by ``vacuum``."""

    def merged(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        new = rows if old is None else rows.select(*old.columns)
        return touch(rows.sparkSession.createDataFrame([], new.schema) if old is None else old, new, key, first, last)

    return _keyed_table(stream, table, checkpoint, key, parts, keep, merged)


def summed(changes: DataFrame, key: str, sign: str, measures: Sequence[str]) -> DataFrame:
    """(key, entries, measures): sums of signed changes, +1 for what is there now and -1 for what was; an update is one of each.

    Measures are whole numbers or decimals, so that a retraction leaves nothing behind. Missing ones count as 0.
    """
    wide = lambda c: F.col(c).cast("decimal(38,%d)" % int(t.rstrip(")").split(",")[1])) if (t := dict(changes.dtypes)[c]).startswith("decimal") else F.col(c).cast("long")
    sums = [F.sum(F.coalesce(wide(c), F.lit(0)) * F.col(sign)).cast(changes.select(wide(c)).dtypes[0][1]).alias(c) for c in measures]
    return changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(F.col(sign).cast("long")).alias("entries"), *sums)


def keep_sums(changes: DataFrame, key: str, sign: str, measures: Sequence[str], table: str, checkpoint: str, parts: int = 64, keep: int = 2) -> StreamingQuery:
    """The sums of ``summed`` kept up to date over a stream of signed changes; ``current_sums`` reads them.

    A batch adds up its own changes and rewrites only the parts whose keys they name: its work grows with the changes and not with the table's history.
    """

    def merged(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        new = summed(rows, key, sign, measures)
        both = new if old is None else old.select(*new.columns).unionByName(new)
        return both.groupBy(key).agg(F.sum("entries").alias("entries"), *[F.sum(c).cast(dict(new.dtypes)[c]).alias(c) for c in measures])

    return _keyed_table(changes.where(F.col(key).isNotNull()), table, checkpoint, key, parts, keep, merged)


def current_sums(spark: SparkSession, table: str) -> DataFrame | None:
    """What ``keep_sums`` holds now; keys whose entries are all retracted are left out. None before the first batch."""
    held, _ = _snapshots(spark, table)
    return None if held is None else held.where("entries > 0")


def rescored(changes: DataFrame, key: str, recompute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of the institutions that a table of changes names, and of no others."""
    return recompute(changes.where(F.col(key).isNotNull()).select(key).distinct())


def refresh_scores(changes: DataFrame, key: str, recompute: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Institutions named in a stream of changes are scored anew, these ids only, and appended with the batch's number."""

    def batch(rows: DataFrame, number: int) -> None:
        scored = rescored(rows, key, recompute).withColumn("batch", F.lit(number))
        scored.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(log: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Current status and number of transitions per key, kept up to date over an event log (update mode)."""
    return log.groupBy(key).agg(F.max_by(status, order).alias("status"), F.max(order).alias("changed_at"), F.count("*").alias("entries"))


def distinct_reviews(stream: DataFrame, time: str, key: str = "content_hash", late: str = "7 days") -> DataFrame:
    """First arrivals by hash within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


class Cooldown(StatefulProcessor):
    """Keeps the last done time of a key; a request within ``wait`` seconds of it is refused."""

    def __init__(self, key: str, wait: int = 600):
        self.key, self.wait = key, wait

    def init(self, handle: Any) -> None:
        self.last = handle.getValueState("last_done", "at timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "id"])
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for r in frame.itertuples(index=False):
            refused = last is not None and (r.at - pd.Timestamp(last)).total_seconds() < self.wait
            out.append((r.id, key[0], "cooldown" if refused else "start"))
            if r.status == "done":
                last = r.at if last is None or r.at > pd.Timestamp(last) else last
        if last is not None:
            self.last.update((pd.Timestamp(last).to_pydatetime(),))
        yield pd.DataFrame(out, columns=["id", self.key, "decision"])

    def close(self) -> None:
        pass


def cooldown(requests: DataFrame, key: str, wait: int = 600) -> DataFrame:
    """Decisions on a stream (id, key, at, status): state is one timestamp a key (needs the RocksDB state store)."""
    kind = dict(requests.dtypes)[key]
    return requests.groupBy(key).transformWithStateInPandas(Cooldown(key, wait), f"id long, {key} {kind}, decision string", "Append", "none")


class OrderedCooldown(StatefulProcessor):
    """Decides requests in the order of their times, once the watermark has passed them; a key's state ends ``wait`` seconds after its last done time.

    Requests wait in a list until no earlier one can come. A timer at each request's time decides what is due, by time and id, and one
    at the end of the wait forgets the last done time, after which no request could be refused for it.
    """

    def __init__(self, key: str, wait: int = 600):
        self.key, self.wait = key, wait

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_done", "us long")
        self.waiting = handle.getListState("waiting", "id long, us long, status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples(index=False):
                self.waiting.appendValue((int(r.id), int(r.us), r.status))
                self.handle.registerTimer(-(-int(r.us) // 1000))
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), self.key: pd.Series(dtype="int64"), "decision": pd.Series(dtype="str")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(((us, i, status) for i, us, status in self.waiting.get()), key=lambda r: r[:2])
        due, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for us, i, status in due:
            out.append((i, key[0], "cooldown" if last is not None and us - last < self.wait * 1_000_000 else "start"))
            if status == "done":
                last = us if last is None else max(us, last)
        if due and rest:
            self.waiting.put([(i, us, status) for us, i, status in rest])
        elif due:
            self.waiting.clear()
        if last is not None:
            end = last + self.wait * 1_000_000
            if end <= now and not rest:
                self.last.clear()
            else:
                self.last.update((last,))
                if due or end > now:
                    self.handle.registerTimer(max(-(-end // 1000), now // 1000 + 1))
        yield pd.DataFrame(out, columns=["id", self.key, "decision"])

    def close(self) -> None:
        pass


def cooldown_in_order(requests: DataFrame, key: str, wait: int = 600, late: str = "1 hour") -> DataFrame:
    """Decisions on a stream (id, key, at, status) by event time: late and out-of-order requests within the watermark are decided as ``gated`` does.

    Needs the RocksDB state store. A decision comes when the watermark has passed its request; requests later than ``late`` are dropped by Spark.
    """
    kind = dict(requests.dtypes)[key]
    rows = requests.select("id", key, "at", F.unix_micros("at").alias("us"), "status").withWatermark("at", late)
    return rows.groupBy(key).transformWithStateInPandas(OrderedCooldown(key, wait), f"id long, {key} {kind}, decision string", "Append", "EventTime")


def gated(requests: DataFrame, key: str, wait: int = 600) -> DataFrame:
    """Batch twin of ``cooldown``: each request against the last done time before it, by time and id."""
    earlier = Window.partitionBy(key).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("status") == "done", F.col("at"))).over(earlier)
    refused = F.coalesce(F.unix_micros("at") - F.unix_micros(last) < wait * 1_000_000, F.lit(False))
    return requests.select("id", key, F.when(refused, "cooldown").otherwise("start").alias("decision"))
