"""Scores of a stream of lines: the ring, the centroids and the moments are keyed state, updated as windows close.

Closed windows leave one native aggregation as rows (tenant_id, device_key, ws, feature, n); the row itself is the one without a
feature.  Two stateful steps follow, each dealt by its own key, so no tenant is one task:
- `Ring`, by (tenant, feature): what the ring knows of the feature in the row's bucket, by slot; and for rows, which days the slots of
  the tenant hold.
- `Scorer`, by (tenant, device, bucket): df of the features of a row are the counts of the days that its tenant holds; centroid, norm and
  moments are those before the row, as in `operators.scoring.scored`.

Rows of one micro-batch are taken in order of (ws, device_key), and windows close for all devices at once, as the watermark passes their
end: scores are those of the batch plan.  State lies in the state store (RocksDB) and its checkpoint; a restart goes on
where the last whole batch ended.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import families, timing
from ..operators import baselines
from ..operators.scoring import Thresholds
from .windows import GRACE

SLOTS = timing.SLOTS


def windowed(lines: DataFrame, size: int, grace: int = GRACE) -> DataFrame:
    """Closed windows: tenant_id, device_key, ws, bucket, feature (null: the row itself), n, bytes, tf_w and blob of features."""
    timed = lines.withColumn("t", F.timestamp_seconds(F.coalesce("ts", F.lit(0)))).withWatermark("t", f"{grace} seconds")
    each = timed.select("t", "tenant_id", "device_key", "byte_len", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("features", F.array().cast("array<string>")))).alias("feature"))
    got = each.groupBy(F.window("t", f"{size} seconds").alias("w"), "tenant_id", "device_key", "feature").agg(F.count("*").alias("n"), F.sum("byte_len").cast("long").alias("bytes"))
    ws, feature = F.unix_seconds("w.start"), F.col("feature")
    got = got.select("tenant_id", "device_key", ws.alias("ws"), timing.time_bucket(ws).alias("bucket"), feature, "n", "bytes")
    weight = F.when(feature.isNotNull(), baselines.weighted(feature, F.least("n", F.lit(4_294_967_295))).cast("double"))
    return got.withColumns({"tf_w": weight, "blob": F.coalesce(families.is_blob(feature), F.lit(False))}).where("feature IS NULL OR tf_w > 0")


def _ordered(parts: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(list(by), kind="stable")


class Slots:
    """Day and count of each slot, and what the slot of the current day held before: 4 numbers a slot; no day: -2**62."""

    NONE = -(1 << 62)

    def __init__(self, held: list[int] | None):
        self.held = list(held) if held else [self.NONE, 0, self.NONE, 0] * SLOTS

    def before(self, day: int) -> tuple[list[int], list[int], int, bool]:
        """(latest earlier day of each slot, its counts, rows of the same day so far, whether the day is there)."""
        days, counts, own, there = [], [], 0, False
        for r in range(SLOTS):
            d, c, e, f = self.held[4 * r : 4 * r + 4]
            if r == day % SLOTS and d == day:
                d, c, own, there = e, f, c, True
            days.append(d), counts.append(c)
        return days, counts, own, there

    def add(self, day: int) -> None:
        r = 4 * (day % SLOTS)
        if self.held[r] == day:
            self.held[r + 1] += 1
        else:
            self.held[r : r + 4] = [day, 1, self.held[r], self.held[r + 1]]


class Ring(StatefulProcessor):
    """Adds days, counts and own (see `Slots.before`) to rows of one tenant and feature; to rows without a feature also visible, the days that their tenant's slots hold."""

    OUT = "tenant_id string, device_key string, ws long, bucket int, feature string, n long, bytes long, tf_w double, blob boolean, days array<long>, counts array<long>, own long, visible array<long>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        # all buckets at once: a call to the store for each would take longer than the rest
        self.slots = handle.getValueState("slots", "buckets array<int>, held array<long>")
        self.days = handle.getValueState("days", "held array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got, touched = _ordered(rows, "ws", "device_key"), None
        buckets, flat = self.slots.get() or ([], [])
        known = {b: Slots(flat[4 * SLOTS * i : 4 * SLOTS * (i + 1)]) for i, b in enumerate(buckets)}
        if key[1] is None:
            found = self.days.get()
            touched = Slots(found[0] if found else None)
        out = {c: [] for c in ("days", "counts", "own", "visible")}
        for ws, bucket in zip(got["ws"].tolist(), got["bucket"].tolist()):
            day = ws // timing.DAY
            if bucket not in known:
                known[bucket] = Slots(None)
            days, counts, own, _ = known[bucket].before(day)
            known[bucket].add(day)
            visible = None
            if touched is not None:
                held, _, _, there = touched.before(day)
                visible = [d for r, d in enumerate(held) if d != Slots.NONE and (r != day % SLOTS or not there)]
                touched.add(day)
            for c, v in zip(out, (days, counts, own, visible)):
                out[c].append(v)
        self.slots.update((list(known), [x for s in known.values() for x in s.held]))
        if touched is not None:
            self.days.update((touched.held,))
        yield got.assign(**out)

    def close(self) -> None:
        pass


class Moments:
    """Count, mean and squared differences, one value after another."""

    def __init__(self, n: int = 0, mean: float = 0.0, m2: float = 0.0):
        self.n, self.mean, self.m2 = n, mean, m2

    def add(self, x: float) -> None:
        self.n += 1
        gap = x - self.mean
        self.mean += gap / self.n
        self.m2 += gap * (x - self.mean)

    def z(self, x: float) -> float:
        var = self.m2 / (self.n - 1) if self.n > 1 else 0.0
        return 0.0 if var <= 1e-12 else max(0.0, (x - self.mean) / math.sqrt(var))


class Scorer(StatefulProcessor):
    """Scores of rows of one tenant, device and bucket; all features of a row come with it in one batch."""

    OUT = "tenant_id string, device_key string, ws long, bucket int, lines long, bytes long, n_bucket long, stats_n long, rarity double, drift double, volume double, total double, blob_ratio double, cold_start boolean, centroid_norm double"

    def __init__(self, size: int, t: Thresholds, alpha: float):
        self.t, self.least, self.alpha = t, t.cold_start_windows(size), alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("centroid", "feature string", "i long, value double")
        self.group = handle.getValueState("group", "i long, norm2 double, " + ", ".join(f"{c}_n long, {c}_mean double, {c}_m2 double" for c in ("lines", "bytes", "total")))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _ordered(rows, "ws")
        state = self.group.get() or (0, 0.0, *(0, 0.0, 0.0) * 3)
        i, norm2 = state[:2]
        moments = [Moments(*state[k : k + 3]) for k in (2, 5, 8)]
        known: dict[str, tuple[int, float]] = {}
        beta, out = 1 - self.alpha, []
        fresh = i == 0  # nothing is stored yet
        for ws, row in got.groupby("ws", sort=True):
            of = row[row["feature"].isna()].iloc[0]
            visible = {int(d) for d in of["visible"]}

            def seen(days, counts, own):
                return int(own) + sum(int(c) for d, c in zip(days, counts) if int(d) in visible)

            n_bucket = seen(of["days"], of["counts"], of["own"])
            dot = row_norm2 = mass = mass_idf = mass_blob = 0.0
            for f in row[row["feature"].notna()].itertuples(index=False):
                if f.feature not in known:
                    known[f.feature] = tuple(self.values.getValue((f.feature,))) if not fresh and self.values.containsKey((f.feature,)) else (i, 0.0)
                at, value = known[f.feature]
                now = value * beta ** (i - at)
                df = seen(f.days, f.counts, f.own)
                dot, row_norm2, mass = dot + f.tf_w * now, row_norm2 + f.tf_w * f.tf_w, mass + f.tf_w
                mass_idf += f.tf_w * (math.log((n_bucket + 1) / (df + 1)) + 1)
                mass_blob += f.tf_w if f.blob else 0.0
                known[f.feature] = (i + 1, beta * now + self.alpha * f.tf_w)
            row_norm, norm = math.sqrt(row_norm2), math.sqrt(max(norm2, 0.0))
            rarity = 1 - math.exp(-mass_idf / mass) if mass > 1e-12 else 0.0
            drift = 0.0 if row_norm <= 1e-12 or norm <= 1e-12 else 1 - max(0.0, min(1.0, dot / (row_norm * norm)))
            lines, size = int(of["n"]), int(of["bytes"])
            volume = max(0.0, min(1.0, max(moments[0].z(lines), moments[1].z(size)) / self.t.z_max))
            total = 0.45 * rarity + 0.40 * drift + 0.15 * volume
            cold = norm <= 0.0 or (self.least > 0 and n_bucket < self.least)
            out.append((*key[:2], int(ws), key[2], lines, size, n_bucket, moments[0].n, rarity, drift, volume, total, mass_blob / mass if mass > 1e-12 else 0.0, cold, norm))
            for m, x in zip(moments, (lines, size, total)):
                m.add(x)
            norm2 = beta * beta * norm2 + 2 * self.alpha * beta * dot + self.alpha * self.alpha * row_norm2
            i += 1
        for feature, value in known.items():
            self.values.updateValue((feature,), value)
        self.group.update((i, norm2, *[x for m in moments for x in (m.n, m.mean, m.m2)]))
        yield pd.DataFrame(out, columns=[c.strip().split()[0] for c in self.OUT.split(",")])

    def close(self) -> None:
        pass


def stream_scores(lines: DataFrame, size: int, t: Thresholds = Thresholds(), alpha: float = baselines.ALPHA, grace: int = GRACE) -> DataFrame:
    """Rows of closed windows with their scores; lines: tenant_id, device_key, ts, byte_len, features."""
    closed = windowed(lines, size, grace)
    ringed = closed.groupBy("tenant_id", "feature").transformWithStateInPandas(Ring(), Ring.OUT, "Append", "None")
    return ringed.groupBy("tenant_id", "device_key", "bucket").transformWithStateInPandas(Scorer(size, t, alpha), Scorer.OUT, "Append", "None")
