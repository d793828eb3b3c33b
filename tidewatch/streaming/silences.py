"""Hard silences of a stream: told when the time comes, though no line does.

Keyed state holds a device's counters and its last window; an event-time timer stands where its silence would be a candidate.
A window that comes before takes the timer away; one that comes after closes the silence that the timer opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.volume_loss import SilenceGates
from .windows import GRACE

OUT = "tenant_id string, device_key string, window_start_ts long, window_end_ts long, missed long, expected_lines long, last_bucket int"


class Watch(StatefulProcessor):
    """The machine of one device: counts windows, waits, opens a silence once, closes it with the next window."""

    def __init__(self, size: int, gates: SilenceGates, min_lines: int):
        self.size, self.gates, self.min_lines = size, gates, min_lines

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("device", "observed long, mature long, last_we long, last_lines long, last_bucket int, opened boolean")

    def _missed(self, mature: int, lines: int) -> int | None:
        """After how many missed windows the device is a candidate."""
        if mature < self.gates.min_mature or (lines == 0 and self.gates.min_lines > 0):
            return None
        return max(self.gates.min_missed, -(-self.gates.min_lines // lines) if lines else 0)

    def _row(self, key, end: int, lines: int, bucket: int, missed: int) -> tuple:
        return (*key, end, end + missed * self.size, missed, lines * missed, bucket)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True).sort_values("ws")
        observed, mature, end, last, bucket, opened = self.state.get() or (0, 0, None, 0, 0, False)
        found = []
        for ws, lines, b in zip(got["ws"].tolist(), got["lines"].tolist(), got["bucket"].tolist()):
            missed = self._missed(mature, last) if end is not None and not opened else None
            if missed is not None and ws >= end + missed * self.size:  # both came in one batch: the timer would have been first
                found.append(self._row(key, end, last, bucket, missed))
            observed, mature, opened = observed + 1, mature + (lines >= self.min_lines), False
            if end is None or ws + self.size >= end:
                end, last, bucket = ws + self.size, lines, b
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        missed = self._missed(mature, last)
        if missed is not None:
            self.handle.registerTimer(1000 * (end + missed * self.size))
        self.state.update((observed, mature, end, last, bucket, opened))
        if found:
            yield pd.DataFrame(found, columns=[c.strip().split()[0] for c in OUT.split(",")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        observed, mature, end, last, bucket, opened = self.state.get()
        missed = self._missed(mature, last)
        if not opened and missed is not None:
            self.state.update((observed, mature, end, last, bucket, True))
            yield pd.DataFrame([self._row(key, end, last, bucket, missed)], columns=[c.strip().split()[0] for c in OUT.split(",")])

    def close(self) -> None:
        pass


def stream_silences(lines: DataFrame, size: int, gates: SilenceGates = SilenceGates(), min_lines: int = 10, grace: int = GRACE) -> DataFrame:
    """Silences of devices as they open; lines: tenant_id, device_key, ts, byte_len."""
    from ..functions import timing

    timed = lines.withColumn("t", F.timestamp_seconds(F.coalesce("ts", F.lit(0)))).withWatermark("t", f"{grace} seconds")
    closed = timed.groupBy(F.window("t", f"{size} seconds").alias("w"), "tenant_id", "device_key").agg(F.count("*").alias("lines"))
    ws = F.unix_seconds("w.start")
    rows = closed.select("tenant_id", "device_key", ws.alias("ws"), timing.time_bucket(ws).alias("bucket"), "lines", F.window_time("w").alias("t"))
    return rows.groupBy("tenant_id", "device_key").transformWithStateInPandas(Watch(size, gates, min_lines), OUT, "Append", "EventTime")
