"""Streaming jobs: change feeds, keyed state, rolling counts and incremental upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def watch(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream; none is dropped, a trigger takes so many at most."""
    reader = spark.readStream.format(fmt).schema(schema)
    for key, value in (("maxFilesPerTrigger", files_per_trigger), ("pathGlobFilter", glob)):
        reader = reader if value is None else reader.option(key, value)
    return reader.load(path)


def rolling_counts(stream: DataFrame, keys: list[str], time: str, window: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows of each key in each window of event time; rows later than ``late`` are dropped."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    counts = stream.withWatermark(time, late).groupBy(*keys, span.alias("w")).agg(F.count("*").alias("n"))
    return counts.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, checkpoint: str, name: str | None = None, mode: str = "complete") -> DataFrame:
    """What a stream gives for all that is there now, by a run that then ends.

    The result is a table in memory on the driver: for small results such as counts of keys.
    """
    name = name or f"stream_{uuid.uuid4().hex}"
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def upserts(stream: DataFrame, keys: list[str], table: str, checkpoint: str, order: str, interval: str | None = None) -> StreamingQuery:
    """Keeps a Parquet table of the last row of each key, batch by batch.

    A batch is merged with the table into a new version beside it, and a small file names the
    version that counts, so a batch that is repeated after a failure gives the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        old = current(batch.sparkSession, table, before=number)
        rows = batch if old is None else old.unionByName(batch)
        rest = [c for c in rows.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r"))
        last.select(*keys, "r.*").select(*rows.columns).write.mode("overwrite").parquet(f"{table}/version={number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The newest version of such a table; None if there is none (below ``before``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [s.getPath() for s in fs.listStatus(path)]
    versions = sorted(int(p.getName().partition("=")[2]) for p in found if p.getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    versions = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{table}/version={versions[-1]}") if versions else None


def rate_limited(requests: DataFrame, key: str, time: str, per_minute: int = 60, per_hour: int = 500) -> DataFrame:
    """``requests`` with ``allowed``: whether fixed minute and hour windows of the key have room.

    A request that is refused counts in neither window.  In a minute's window the first
    ``per_minute`` pass; of these, those that are among the hour's first ``per_hour``.
    """
    minute = Window.partitionBy(key, F.date_trunc("minute", time)).orderBy(time, "event_id")
    rows = requests.withColumn("in_minute", F.row_number().over(minute))
    hour = Window.partitionBy(key, F.date_trunc("hour", time), F.col("in_minute") <= per_minute).orderBy(time, "event_id")
    rows = rows.withColumn("in_hour", F.row_number().over(hour))
    return rows.withColumn("allowed", (F.col("in_minute") <= per_minute) & (F.col("in_hour") <= per_hour)).drop("in_minute", "in_hour")


def rate_limit_stream(requests: DataFrame, per_minute: int = 60, per_hour: int = 500) -> DataFrame:
    """The same for a stream of ``key``, ``ts``, ``event_id``: counters of a key are its state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches, state: GroupState):
        minute, in_minute, hour, in_hour = state.get if state.exists else (-1, 0, -1, 0)
        for batch in batches:
            batch = batch.sort_values(["ts", "event_id"])
            allowed = []
            for at in (batch["ts"].astype("int64") // 10**9).tolist():
                if at // 60 != minute:
                    minute, in_minute = at // 60, 0
                if at // 3600 != hour:
                    hour, in_hour = at // 3600, 0
                ok = in_minute < per_minute and in_hour < per_hour
                in_minute, in_hour = in_minute + ok, in_hour + ok
                allowed.append(ok)
            yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"], "allowed": allowed})
        state.update((minute, in_minute, hour, in_hour))

    kind = requests.schema["key"].dataType.simpleString()
    counters = "minute long, in_minute long, hour long, in_hour long"
    return requests.groupBy("key").applyInPandasWithState(step, f"key {kind}, event_id long, allowed boolean", counters, "append", GroupStateTimeout.NoTimeout)


def on_each_batch(stream: DataFrame, checkpoint: str, job: Callable[[DataFrame], None], interval: str = "60 seconds") -> StreamingQuery:
    """Runs a job on what came since the last trigger."""
    return stream.writeStream.foreachBatch(lambda batch, _: job(batch)).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def on_changes(stream: DataFrame, checkpoint: str, keys: list[str], order: str, job: Callable[[DataFrame], None], interval: str | None = None) -> StreamingQuery:
    """Runs a job on the last event of each key since the last trigger; none is dropped while a job runs.

    Events that come meanwhile wait for the next trigger and are merged there by key, so a job that is
    slower than its events does fewer runs over more keys. Without an interval it ends with what is there.
    """

    def step(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
        job(last.select(*batch.columns))

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def cached(requests: DataFrame, ttl: float, late: str = "1 minute") -> DataFrame:
    """A cache with an age limit as a stream: ``requests`` have key, ts, event_id, value (null: a lookup).

    Gives each lookup with the ``value`` it finds, null if the key was never set or its value is ``ttl`` seconds old or
    older at that time. Setting a key again renews it. A key's state goes when the watermark passes its end, so that
    state is bounded by the keys set within ``ttl`` and ``late``; later requests may find none.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        value, ends = state.get if state.exists else (None, -(1 << 62))
        for batch in batches:
            batch = batch.sort_values(["ts", "event_id"])
            asked, found = [], []
            for at, n, given in zip((batch["ts"].astype("datetime64[us]").astype("int64")).tolist(), batch["event_id"].tolist(), batch["value"].tolist(), strict=True):
                if isinstance(given, str):
                    value, ends = given, at + int(ttl * 1e6)
                else:
                    asked.append(n)
                    found.append(value if at < ends else None)
            yield pd.DataFrame({"key": key[0], "event_id": asked, "value": pd.Series(found, dtype=object)})
        if value is not None:
            state.update((value, ends))
            state.setTimeoutTimestamp(max(ends // 1000, state.getCurrentWatermarkMs() + 1))

    kind = requests.schema["key"].dataType.simpleString()
    seen = requests.withWatermark("ts", late).groupBy("key")
    return seen.applyInPandasWithState(step, f"key {kind}, event_id long, value string", "value string, ends long", "append", GroupStateTimeout.EventTimeTimeout)
