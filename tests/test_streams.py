"""Streams with keyed state: restarts go on where they were, and what they give is what the batch plan gives."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import timing
from tidewatch.operators import scoring, windows
from tidewatch.operators.volume_loss import SilenceGates
from tidewatch.streaming import scoring as stream_scoring
from tidewatch.streaming import silences, windows as streaming

SCHEMA = "tenant_id string, device_key string, ts long, byte_len long, features array<string>"
HOUR = 3600
LOW = scoring.Thresholds(min_lines=1, cold_start_days=1)


def some_lines(seed, days=9):
    """Lines of a few devices over days: two of a tenant, one of another; hours without lines, and a day without any."""
    rng, rows = random.Random(seed), []
    for day in range(days):
        for hour in (1, 2, 9):
            for t, d in (("t", "a"), ("t", "b"), ("u", "a")):
                if day != 4 and rng.random() < 0.8:
                    for _ in range(rng.randint(1, 4)):
                        rows.append((t, d, day * 86_400 + hour * HOUR + rng.randrange(HOUR), rng.randint(5, 90), rng.sample(["w=x1", "k=y", "canon=z", "q", "User=u1"], rng.randint(0, 4))))
    return sorted(rows, key=lambda r: r[2])


def parts(spark, folder, rows, cuts):
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in the order of their times


def test_slots():
    """What a feature's slots hold is what a scan of its history gives."""
    rng, slots, history = random.Random(3), stream_scoring.Slots(None), []
    day = -20
    for _ in range(300):
        day += rng.choice([0, 0, 1, 1, 2, 5, 9])
        days, counts, own, there = slots.before(day)
        for r in range(timing.SLOTS):
            earlier = [d for d in history if d % timing.SLOTS == r and d < day]
            want = (max(earlier), earlier.count(max(earlier))) if earlier else (stream_scoring.Slots.NONE, 0)
            assert (days[r], counts[r]) == want
        assert (own, there) == (history.count(day), day in history)
        slots.add(day), history.append(day)
        slots = stream_scoring.Slots(slots.held)


def test_moments():
    rng, m, seen = random.Random(1), stream_scoring.Moments(), pd.Series(dtype=float)
    for _ in range(40):
        x = rng.random() * 50
        want = max(0.0, (x - seen.mean()) / seen.std()) if len(seen) > 1 else 0.0
        assert m.z(x) == pytest.approx(want)
        m.add(x)
        seen = pd.concat([seen, pd.Series([x])], ignore_index=True)


def test_scores_over_restarts(spark, tmp_path):
    """Two runs of the stream, the second from the checkpoint of the first, score closed windows as one batch plan does."""
    rows, folder = some_lines(1), str(tmp_path / "in")
    half = len(rows) // 2
    out = str(tmp_path / "out")

    def run():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        with streaming.keyed_state(spark):
            streaming.run_once(stream_scoring.stream_scores(source, HOUR, LOW), str(tmp_path / "check"), streaming.to_table(out)).awaitTermination()

    parts(spark, folder, rows[:half], [half // 2])
    run()
    first = spark.read.parquet(out).count()
    parts(spark, folder, rows[half:], [])
    run()
    lines = spark.createDataFrame(rows, SCHEMA)
    want, _ = scoring.scored(windows.rows(lines, HOUR), windows.row_features(lines, HOUR), HOUR, LOW)
    closed = want.where(F.col("we") <= rows[-1][2] - streaming.GRACE).toPandas()
    got = spark.read.parquet(out).toPandas()
    both = closed.merge(got, on=["tenant_id", "device_key", "ws"], suffixes=("", "_s"))
    assert 0 < first < len(got) == len(both) == len(closed) and (both["cold_start"] == both["cold_start_s"]).all() and not both["cold_start"].all()
    for c in ("lines", "bytes", "n_bucket", "stats_n", "rarity", "drift", "volume", "total", "blob_ratio", "centroid_norm"):
        assert both[c].tolist() == pytest.approx(both[f"{c}_s"].tolist(), abs=1e-6), c


def test_silences(spark, tmp_path):
    """A silence opens while other devices go on, once; a window closes it; too few or too small windows open none."""
    at = lambda hours, device, n: [("t", device, h * HOUR + i, 9, None) for h in hours for i in range(n)]
    rows = sorted([*at(range(40), "steady", 12), *at([*range(6), *range(20, 27)], "gap", 12), *at(range(2), "young", 12), *at(range(8), "thin", 1)], key=lambda r: r[2])
    folder = str(tmp_path / "in")
    parts(spark, folder, rows, [len(rows) // 3, 2 * len(rows) // 3])
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    made = silences.stream_silences(source, HOUR, SilenceGates(5, 3, 10), 10)
    with streaming.keyed_state(spark):
        streaming.run_once(made, str(tmp_path / "check"), streaming.to_table(str(tmp_path / "out"))).awaitTermination()
    got = sorted((r.device_key, r.window_start_ts // HOUR, r.window_end_ts // HOUR, r.missed, r.expected_lines) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("gap", 6, 9, 3, 36), ("gap", 27, 30, 3, 36)]
    # with low gates the thin device waits for as many windows as make its expected lines enough
    watch = silences.Watch(HOUR, SilenceGates(0, 3, 10), 0)
    assert [watch._missed(9, n) for n in (0, 1, 2, 4, 100)] == [None, 10, 5, 3, 3]


def test_idle_windows(spark, tmp_path):
    """Timers close the last windows, of a device that has gone too; a restart has nothing left to close."""
    rows, folder = some_lines(2, 3), str(tmp_path / "in")
    parts(spark, folder, rows, [len(rows) // 2])
    out = str(tmp_path / "out")
    for _ in range(2):
        source = spark.readStream.schema(SCHEMA).parquet(folder)
        with streaming.keyed_state(spark):
            streaming.run_until_idle(streaming.idle_rows(source, HOUR, 1), str(tmp_path / "check"), streaming.to_table(out), 90)
    lines = spark.createDataFrame(rows, SCHEMA)
    got = spark.read.parquet(out).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windows.rows(lines, HOUR).select(got.columns).collect()))
