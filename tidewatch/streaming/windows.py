"""The window rows as a stream: watermarked tumbling windows, closed once no late line is expected."""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import timing

#: Seconds a window waits for late lines.
GRACE = 120
#: The setting and the store that keyed state needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that start inside have the store that keyed state needs."""
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before)


def to_table(path: str):
    """A foreachBatch writer: each batch has a folder of its own, written anew if the batch is run again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def stream_rows(lines: DataFrame, size: int, grace: int = GRACE) -> DataFrame:
    """As operators.windows.rows; lines: tenant_id, device_key, ts (seconds), byte_len."""
    timed = lines.withColumn("t", F.timestamp_seconds(F.coalesce("ts", F.lit(0)))).withWatermark("t", f"{grace} seconds")
    got = timed.groupBy(F.window("t", f"{size} seconds").alias("w"), "tenant_id", "device_key").agg(F.count("*").alias("lines"), F.sum("byte_len").cast("long").alias("bytes"))
    ws = F.unix_seconds("w.start")
    return got.select("tenant_id", "device_key", ws.alias("ws"), (ws + size).alias("we"), timing.time_bucket(ws).alias("bucket"), "lines", "bytes")


def stream_features(lines: DataFrame, size: int, grace: int = GRACE) -> DataFrame:
    """As operators.windows.row_features."""
    timed = lines.withColumn("t", F.timestamp_seconds(F.coalesce("ts", F.lit(0)))).withWatermark("t", f"{grace} seconds")
    each = timed.select("t", "tenant_id", "device_key", F.explode("features").alias("feature"))
    got = each.groupBy(F.window("t", f"{size} seconds").alias("w"), "tenant_id", "device_key", "feature").agg(F.count("*").alias("n"))
    return got.select("tenant_id", "device_key", F.unix_seconds("w.start").alias("ws"), "feature", "n")


class Closer(StatefulProcessor):
    """Windows of one device as they come, closed by the watermark or, `idle` seconds after its last line came, by a timer.

    Keyed state holds the open windows; a line of a window that was closed already opens a row of its own.
    """

    OUT = "tenant_id string, device_key string, ws long, lines long, bytes long"

    def __init__(self, size: int, idle: int):
        self.size, self.idle = size, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "ws long", "lines long, bytes long")

    def _closed(self, key, until: float) -> Iterator[pd.DataFrame]:
        done = [(*key, ws, lines, size) for (ws,), (lines, size) in sorted(self.open.iterator()) if ws + self.size <= until]
        for row in done:
            self.open.removeKey((row[2],))
        if done:
            yield pd.DataFrame(done, columns=["tenant_id", "device_key", "ws", "lines", "bytes"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ws, lines, size in part.groupby("ws")["byte_len"].agg(["size", "sum"]).itertuples():
                old = self.open.getValue((ws,)) if self.open.containsKey((ws,)) else (0, 0)
                self.open.updateValue((ws,), (old[0] + lines, old[1] + int(size)))
        yield from self._closed(key, timerValues.getCurrentWatermarkInMs() / 1000)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._closed(key, math.inf)

    def close(self) -> None:
        pass


def idle_rows(lines: DataFrame, size: int, idle: int, grace: int = GRACE) -> DataFrame:
    """As stream_rows, with the last windows too: a device's open windows close `idle` seconds after its last line has come."""
    timed = lines.withColumn("t", F.timestamp_seconds(F.coalesce("ts", F.lit(0)))).withWatermark("t", f"{grace} seconds")
    each = timed.select("t", "tenant_id", "device_key", timing.window_start(F.coalesce("ts", F.lit(0).cast("long")), size).alias("ws"), "byte_len")
    got = each.groupBy("tenant_id", "device_key").transformWithStateInPandas(Closer(size, idle), Closer.OUT, "Append", "ProcessingTime")
    return got.select("tenant_id", "device_key", "ws", (F.col("ws") + size).alias("we"), timing.time_bucket(F.col("ws")).alias("bucket"), "lines", "bytes")


def run_until_idle(stream: DataFrame, checkpoint: str, each_batch, most: float = 600.0, every: str = "1 second") -> StreamingQuery:
    """Works off what has arrived and waits for the timers of the open windows, then stops: a pass that leaves none open.  most: seconds it may take."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(each_batch).start()
    began = time.time()
    while query.isActive and time.time() < began + most:
        time.sleep(0.2)
        last = query.recentProgress[-2:]
        if len(last) == 2 and all(p["numInputRows"] == 0 and not sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in last):
            break
        if not last and time.time() > began + 30 and not query.status["isDataAvailable"]:
            break  # nothing has ever come
    query.stop()
    if query.exception() is not None:
        raise query.exception()
    return query


def run_once(stream: DataFrame, checkpoint: str, each_batch) -> StreamingQuery:
    """Works off what has arrived, then stops; foreachBatch with the checkpoint makes a restart go on where it was."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each_batch).start()
