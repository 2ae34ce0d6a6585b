"""The batch operators that also make sense on data as it arrives.

State is bounded by watermarks; the queries keep their progress in the shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..session import shared_dir


def daily_profile_stream(events: DataFrame, ts: str, value: str, lateness: str | None = "1 day") -> DataFrame:
    """(day, n, daily_sum, daily_mean) per day, emitted once the day can no longer change.

    ``lateness`` None: the stream has its watermark already.
    """
    marked = events.withWatermark(ts, lateness) if lateness else events
    daily = marked.groupBy(F.window(ts, "1 day")).agg(
        F.count(value).alias("n"), F.sum(value).alias("daily_sum"), F.avg(value).alias("daily_mean")
    )
    return daily.select(F.to_date("window.start").alias("day"), "n", "daily_sum", "daily_mean")


def first_wins_stream(rows: DataFrame, key: str, ts: str, lateness: str = "1 day") -> DataFrame:
    """First arrival per key passes, repeats within the lateness bound are dropped."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def conversion_stream(events: DataFrame, ts: str, variant: Column, converted: Column, a, b) -> DataFrame:
    """Daily conversions of both variants as a running table (complete mode); feed it to the peeking profile."""
    is_a, is_b = variant == F.lit(a), variant == F.lit(b)
    c = converted.cast("bigint")
    return events.groupBy(F.to_date(ts).alias("day")).agg(
        F.coalesce(F.sum(F.when(is_a, c)), F.lit(0)).alias("conv_a"), F.count_if(is_a).alias("n_a"),
        F.coalesce(F.sum(F.when(is_b, c)), F.lit(0)).alias("conv_b"), F.count_if(is_b).alias("n_b"),
    )


def late_rows(arrived: DataFrame, closed_days: DataFrame, ts: str, key: str, lateness: str = "1 day") -> DataFrame:
    """Rows for days already reported, the earliest of each key: what a correction run has to add.

    On a stream a key is remembered for ``lateness`` only, so the state is bounded; the first arrival counts there.
    """
    if arrived.isStreaming:
        once = arrived.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
        return once.withColumn("day", F.to_date(ts)).join(closed_days.select("day").distinct(), "day", "left_semi")
    late = arrived.withColumn("day", F.to_date(ts)).join(closed_days.select("day").distinct(), "day", "left_semi")
    first = late.groupBy(key).agg(F.min_by(F.struct(*late.columns), F.struct(ts, *[c for c in late.columns if c != ts])).alias("_r"))
    return first.select("_r.*")


def late_arrivals_stream(
    rows: DataFrame, key: str, ts: str, arrived: str, lateness: timedelta, kept: timedelta = timedelta(days=400), buckets: int = 64
) -> DataFrame:
    """Rows that reached the stream ``lateness`` or more after their day had ended, the first arrival of each key only.

    A key that came in time and is repeated late is no correction, so every key's arrival is remembered, in ``buckets`` parts per
    day: the state of a part is its sorted keys, about the day's rows / buckets, and is dropped when nothing has come for it for
    ``kept``. The clock of that is a watermark over the arrival time, which late rows do not fall behind. Rows
    without key or time are left out.
    """
    columns = rows.columns
    kept_ms = int(kept.total_seconds() * 1000)

    def fresh(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = set(state.get[0]) if state.exists else set()
        frame = pd.concat(list(frames)).sort_values([arrived, ts], kind="stable")
        new = frame[~frame[key].isin(known)].drop_duplicates(key)
        state.update((sorted(known | set(new[key].tolist())),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(frame[arrived].max().timestamp() * 1000)) + kept_ms)
        reported = pd.Timestamp(group[0]) + timedelta(days=1) + lateness
        late = new.loc[new[arrived] >= reported, columns]
        if len(late):
            yield late

    dated = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(arrived).isNotNull())
    keyed = dated.withColumns({"_day": F.to_date(ts), "_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
    groups = keyed.withWatermark(arrived, "1 day").groupBy("_day", "_bucket")
    return groups.applyInPandasWithState(fresh, rows.schema, "ids array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, path: str, mode: str = "append", name: str | None = None) -> StreamingQuery:
    """Process what is there and stop: Parquet sink (append), checkpoint in the shared folder.

    A run under the same ``name`` goes on where the last one ended, after a failure too. State is kept in RocksDB, on
    the executors' disks and in the checkpoint, not in their heaps.
    """
    spark = stream.sparkSession
    progress = os.path.join(shared_dir(spark), "streams", name or uuid.uuid4().hex)
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", path)
            .option("checkpointLocation", progress).trigger(availableNow=True).start()
        )
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
    query.awaitTermination()
    return query


def replay(log: DataFrame, arrived: str, span: timedelta, streams: Sequence[Callable[[DataFrame], DataFrame]]) -> list[DataFrame]:
    """What each stream has written when the log's rows reach it span by span, in order of ``arrived``.

    The log (a written table) is appended to a folder one span at a time; after each the streams run from their checkpoints over
    the new files, so each span is one micro-batch of every stream. Results are read from the sinks.
    """
    spark = log.sparkSession
    root = os.path.join(shared_dir(spark), "replay", uuid.uuid4().hex)
    landing = os.path.join(root, "landing")
    at, last = log.agg(F.min(arrived), F.max(arrived)).first()
    sinks = [os.path.join(root, f"sink-{i}") for i in range(len(streams))]
    schemas: list[StructType] = []
    # an empty log still makes the folders that the results are read from
    log.limit(0).write.mode("append").parquet(landing)
    for i, stream in enumerate(streams):
        schemas.append(stream(_landed(spark, landing, log.schema)).schema)
        spark.createDataFrame([], schemas[i]).write.mode("append").parquet(sinks[i] + "-empty")
    while at is not None and at <= last:
        log.filter((F.col(arrived) >= F.lit(at)) & (F.col(arrived) < F.lit(at + span))).write.mode("append").parquet(landing)
        for i, stream in enumerate(streams):
            run_available(stream(_landed(spark, landing, log.schema)), sinks[i], name=os.path.join(os.path.basename(root), str(i)))
        at += span
    if last is None:
        return [spark.read.schema(s).parquet(p + "-empty") for s, p in zip(schemas, sinks)]
    return [spark.read.schema(s).parquet(p) for s, p in zip(schemas, sinks)]


def _landed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
