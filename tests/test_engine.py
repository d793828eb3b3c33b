"""Baselines against sequential brute force; gates of volume loss."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import baselines, dictionary, scoring, volume_loss, windows


def history(seed):
    rng = random.Random(seed)
    rows = set()
    for _ in range(120):
        rows.add(("t", rng.choice("ab"), rng.choice([0, 1, 2, 6, 7, 8, 9, 14, 15, 16, 21, 30, 37]) * 86_400 + rng.choice([0, 3600, 7200])))
    return [(*r, rng.sample(["w=x1", "k=y", "canon=z", "q"], rng.randint(1, 4))) for r in sorted(rows)]


def frames(spark, rows):
    r = spark.createDataFrame([(t, d, ws, 3, 9) for t, d, ws, _ in rows], "tenant_id string, device_key string, ws long, lines long, bytes long")
    from tidewatch.functions import timing

    r = r.withColumn("bucket", timing.time_bucket(F.col("ws")))
    f = spark.createDataFrame([(t, d, ws, x, 1 + len(x)) for t, d, ws, fs in rows for x in fs], "tenant_id string, device_key string, ws long, feature string, n long")
    return r, f


@pytest.mark.parametrize("seed", [1, 2])
def test_ring_and_centroid(spark, seed):
    rows = history(seed)
    r, f = frames(spark, rows)
    buckets = {(x.device_key, x.ws): x.bucket for x in r.collect()}
    counted, seen = baselines.with_ring(r, f)
    with_c, seen = baselines.with_centroid(counted, seen)
    got_n = {(x.device_key, x.ws): (x.n_bucket, x.dot, x.centroid_norm2) for x in with_c.collect()}
    got_df = {(x.device_key, x.ws, x.feature): x.df for x in seen.collect()}
    slots: dict = {}
    centroid: dict = {}
    weight = {"w=x1": 0.3, "k=y": 0.5, "canon=z": 0.5, "q": 1.0}
    for _, d, ws, fs in sorted(rows, key=lambda x: (x[2], x[1])):
        day, b = ws // 86_400, buckets[d, ws]
        held = [s[1].get(b, (0, {})) for s in slots.values()]
        assert got_n[d, ws][0] == sum(h[0] for h in held)
        for x in fs:
            assert got_df[d, ws, x] == sum(h[1].get(x, 0) for h in held)
        c = centroid.setdefault((d, b), {})
        row = {x: weight[x] * math.log(2 + len(x)) for x in fs}
        assert got_n[d, ws][1] == pytest.approx(sum(v * c.get(k, 0) for k, v in row.items()), abs=1e-5)
        assert got_n[d, ws][2] == pytest.approx(sum(v * v for v in c.values()), abs=1e-5)
        for k in {*c, *row}:
            c[k] = 0.5 * c.get(k, 0) + 0.5 * row.get(k, 0)
        if day % 7 not in slots or slots[day % 7][0] != day:
            slots[day % 7] = (day, {})
        n, df = slots[day % 7][1].setdefault(b, (0, {}))
        for x in fs:
            df[x] = df.get(x, 0) + 1
        slots[day % 7][1][b] = (n + 1, df)


def test_silence_gates(spark):
    base = (1, "t", "d", 60, 12, 12, 1_700_000_000, 1_700_000_060, 30, 900, 1, 0)
    cols = "subject_kind int, tenant_id string, subject_key string, window_size_s long, observed_windows long, mature_windows long, last_ws long, last_we long, last_lines long, last_bytes long, last_bucket int, last_update_ts long"

    def run(at=1_700_000_240, row=base, open_=None):
        opened = spark.createDataFrame([open_], "subject_kind int, tenant_id string, subject_key string") if open_ else None
        return volume_loss.evaluate_silence(spark.createDataFrame([row], cols), F.lit(at), volume_loss.SilenceGates(5, 2, 10), open_silence=opened).first()

    got = run()
    assert got.suppression is None and (got.missed, got.expected_lines, got.window_start_ts, got.window_end_ts, got.drop_ratio) == (3, 90, 1_700_000_060, 1_700_000_240, 1.0)
    change = lambda **k: tuple(k.get(c.split()[0], v) for c, v in zip(cols.split(", "), base))
    assert run(row=change(mature_windows=4)).suppression == "NotMature"
    assert run(row=change(mature_windows=13)).suppression == "CounterInversion"
    assert run(row=change(last_bucket=48)).suppression == "InvalidBucket"
    assert run(row=change(last_lines=1)).suppression == "BelowExpectedLineFloor"
    assert run(at=1_700_000_060).suppression == "NotSilent"
    assert run(at=1_700_000_130).suppression == "NotEnoughMissedWindows"
    assert run(open_=(1, "t", "d")).suppression == "OpenSilenceAlreadyExists"
    alert = volume_loss.silence_alerts(volume_loss.evaluate_silence(spark.createDataFrame([base], cols), F.lit(1_700_000_240), volume_loss.SilenceGates(5, 2, 10))).first()
    assert alert.reasons[0].code == "V_DROP" and alert.device_key == "d" and alert.label == "info"


def test_drop_gates(spark):
    cols = "tenant_id string, subject_key string, ws long, we long, bucket int, lines long, bytes long, maturity long, mean_lines double, mean_bytes double, sd_lines double"
    gates = volume_loss.DropGates(8, 25.0, 25.0, 0.25, 0.75, 3.0)
    run = lambda **k: volume_loss.evaluate_drop(spark.createDataFrame([tuple({**dict(tenant_id="t", subject_key="d", ws=0, we=60, bucket=1, lines=20, bytes=9, maturity=12, mean_lines=100.0, mean_bytes=50.0, sd_lines=10.0), **k}.values())], cols), gates).first()  # noqa: E731, C408
    got = run()
    assert got.suppression is None and (got.ratio, got.drop_ratio, got.absolute_drop, got.z_drop) == (0.2, 0.8, 80.0, 8.0)
    assert run(lines=0).suppression == "HardSilencePriority"
    assert run(lines=90).suppression == "AbsoluteDropBelowFloor"
    assert run(lines=40).suppression == "ObservedRatioAboveThreshold"
    assert run(sd_lines=60.0).suppression == "VarianceGateNotMet"
    assert run(maturity=3).suppression == "NotMature"
    assert run(mean_lines=20.0).suppression == "BelowExpectedLineFloor"


def test_dictionary_keeps_ids(spark):
    lines = spark.createDataFrame([("t", 1, ["w=b", "k=a"]), ("t", 2, ["w=c"])], "tenant_id string, seq long, features array<string>")
    known = spark.createDataFrame([("t", "w=c", 1)], "tenant_id string, feature string, feature_id long")
    got = {r.feature: r.feature_id for r in dictionary.dictionary(lines, known).collect()}
    assert got == {"w=c": 1, "k=a": 2, "w=b": 3}
    assert dictionary.faults(dictionary.dictionary(lines, known)).count() == 0
    assert dictionary.faults(known.unionByName(known)).first().fault == "a feature has two ids"


def test_labels(spark):
    t = scoring.Thresholds()
    assert t.cold_start_windows(60) == 120 and t.cold_start_windows(3600) == 2
    assert windows.FEATURE_CAPS["all"] == 50_000


def test_full_dictionary(spark):
    from tidewatch.operators.dictionary import dictionary, faults

    lines = spark.createDataFrame([("t", i, [f"w=a{i}", "k=x"]) for i in range(5)] + [("u", 1, ["k=y"])], "tenant_id string, seq long, features array<string>")
    first = dictionary(lines, most=3)
    got = {(r.tenant_id, r.feature): r.feature_id for r in first.collect()}
    assert got == {("t", "k=x"): 1, ("t", "w=a0"): 2, ("t", "w=a1"): 3, ("u", "k=y"): 1} and faults(first, 3).count() == 0
    again = dictionary(lines, first, 4)
    assert {(r.tenant_id, r.feature): r.feature_id for r in again.collect()} == got | {("t", "w=a2"): 4}
