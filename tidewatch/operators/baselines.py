"""Baselines as of before each row: document frequencies of a week's ring, a decaying centroid, running volume.

Rows are in event-time order (ws, device_key).  Everything read by a row excludes the row itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import families, timing
from ..sources.shared import settled

if TYPE_CHECKING:
    from .state import Baseline

ALPHA = 0.5
GROUP = ["tenant_id", "device_key", "bucket"]


@dataclass(frozen=True)
class Placed:
    """Rows in their place; crowded: whether a tenant has more rows in a bucket than one frame should hold."""

    rows: DataFrame
    crowded: bool


#: Rows of one tenant and bucket up to which they (and each feature of theirs) are counted in one sorted frame.
CROWD = 4_000_000
#: Counts and days share a number in the frames: a day above, its count below.
_PACK = 1 << 40


def calendar(rows: DataFrame, past: Baseline | None = None) -> DataFrame:
    """tenant_id, day, held, first, known: of each active day of rows, the last earlier active day of each residue mod 7 (slot) there is, its first row, and whether `past` has the day.

    A few rows a day and tenant; the frames run over days, not rows.
    """
    days = rows.withColumn("day", timing.day_epoch(F.col("ws"))).groupBy("tenant_id", "day").agg(F.min(F.struct("ws", "device_key")).alias("first"), F.lit(False).alias("known"))
    if past is not None:
        old = past.windows.select("tenant_id", "day").distinct().select("*", F.lit(None).cast(days.schema["first"].dataType).alias("first"), F.lit(True).alias("known"))
        days = days.unionByName(old).groupBy("tenant_id", "day").agg(F.max("first").alias("first"), F.bool_or("known").alias("known"))
    before = Window.partitionBy("tenant_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    slot = timing.day_slot(F.col("day"))
    held = F.array_compact(F.array(*[F.max(F.when(slot == r, F.col("day"))).over(before) for r in range(timing.SLOTS)]))
    return days.withColumn("held", held).where("first IS NOT NULL")


def _opened(rows: DataFrame, past: Baseline | None) -> DataFrame:
    """rows with day, held, opens (whether the row is the first of its tenant and day) and visible, the days that the ring holds for it."""
    rows = rows.withColumn("day", timing.day_epoch(F.col("ws"))).join(calendar(rows, past), ["tenant_id", "day"])
    rows = rows.withColumn("opens", ~F.col("known") & (F.struct("ws", "device_key") == F.col("first"))).drop("first", "known")
    return rows.withColumn("visible", F.filter("held", lambda h: (timing.day_slot(h) != timing.day_slot(F.col("day"))) | F.col("opens")))


def _in_frames(each: DataFrame, by: list[str], name: str, past: DataFrame | None) -> DataFrame:
    """As _ring_count, with one shuffle: all rows of `by` and bucket in order, days before in one frame, the day's rows before in another."""
    every = each.withColumns({"_w": F.lit(1).cast("long"), "_past": F.lit(False)})
    if past is not None:
        every = every.unionByName(past.select(*by, "day", "bucket", F.col("c").alias("_w"), F.lit(True).alias("_past")), allowMissingColumns=True)
    every = every.repartition(*by, "bucket")
    own = Window.partitionBy(*by, "bucket", "day")
    before = own.orderBy(F.desc("_past"), "ws", "device_key").rowsBetween(Window.unboundedPreceding, -1)
    days = Window.partitionBy(*by, "bucket").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    every = every.withColumns({"_before": F.coalesce(F.sum("_w").over(before), F.lit(0)), "_day": F.col("day") * _PACK + F.sum("_w").over(own)})
    slot = timing.day_slot(F.col("day"))
    every = every.withColumns({f"_slot{r}": F.max(F.when(slot == r, F.col("_day"))).over(days) for r in range(timing.SLOTS)})
    total = F.col("_before")
    for r in range(timing.SLOTS):
        c = F.col(f"_slot{r}")
        total = total + F.when(F.array_contains("visible", F.shiftright(c, 40)), c.bitwiseAND(F.lit(_PACK - 1))).otherwise(0)
    return every.where("NOT _past").withColumn(name, total.cast("long")).drop("_w", "_past", "_before", "_day", *[f"_slot{r}" for r in range(timing.SLOTS)])


def _in_parts(each: DataFrame, by: list[str], name: str, past: DataFrame | None) -> DataFrame:
    """As _ring_count, for rows that are too many for one frame.

    Rows are counted by window first; running sums go over the few windows of a day and bucket, and only the devices of one
    window are ranked among themselves, so what all rows have doesn't gather a day of them in one task.
    """
    window, of = [*by, "ws"], [*by, "day", "bucket"]
    ranked = each.withColumn("_rank", F.row_number().over(Window.partitionBy(*window).orderBy("device_key")) - 1)
    counts = each.groupBy(*window, "day", "bucket", "held").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*of).orderBy("ws").rowsBetween(Window.unboundedPreceding, -1)
    daily = counts.groupBy(*of, "held").agg(F.sum("_c").alias("c"))
    known = daily.select(*of, "c")
    if past is not None:
        known = known.unionByName(past.select(*of, "c")).groupBy(*of).agg(F.sum("c").alias("c"))
    asked = daily.select(*of, F.explode("held").alias("_held")).withColumn("_same", timing.day_slot(F.col("day")) == timing.day_slot(F.col("_held")))
    # a feature's own days; a day on which it is not seen is asked for by the days on which it is
    ring = asked.join(known.withColumnsRenamed({"day": "_held", "c": "_n"}), [*by, "_held", "bucket"])
    ring = ring.groupBy(*of).agg(F.sum(F.when(~F.col("_same"), F.col("_n"))).alias("_other"), F.sum(F.when(F.col("_same"), F.col("_n"))).alias("_old"))
    counts = counts.withColumn("_earlier", F.sum("_c").over(before)).join(ring, of, "left")
    if past is not None:
        counts = counts.join(past.select(*of, F.col("c").alias("_own")), of, "left").withColumn("_earlier", F.coalesce("_earlier", F.lit(0)) + F.coalesce("_own", F.lit(0)))
    counts = counts.select(*window, "_earlier", "_other", "_old")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.col("_rank") + zero(F.col("_earlier")) + zero(F.col("_other")) + F.when(F.col("opens"), zero(F.col("_old"))).otherwise(0)
    return ranked.join(counts, window).withColumn(name, total.cast("long")).drop("_rank", "_earlier", "_other", "_old")


def _ring_count(each: DataFrame, by: list[str], name: str, past: DataFrame | None, crowded: bool) -> DataFrame:
    """each (by, device_key, ws, day, bucket, held, visible, opens) with how many rows of the ring that its row sees share the columns `by`.  past: (by, day, bucket, c)."""
    return (_in_parts if crowded else _in_frames)(each, by, name, past)


def placed(rows: DataFrame, past: Baseline | None = None) -> Placed:
    """rows with day, opens, n_bucket (rows of the ring in the bucket) and i, the place in the history of device and bucket.

    Rows are few beside their features and used many times, so they are written to the shared folder, once."""
    opened = settled(_opened(rows, past), "opened")
    crowded = (opened.groupBy("tenant_id", "bucket").count().agg(F.max("count")).first()[0] or 0) > CROWD
    at = _ring_count(opened, ["tenant_id"], "n_bucket", past and past.windows, crowded)
    at = at.withColumn("i", F.row_number().over(Window.partitionBy(*GROUP).orderBy("ws")).cast("long"))
    if past is not None:
        at = at.join(past.groups.select(*GROUP, F.col("i").alias("_i")), GROUP, "left").withColumn("i", F.col("i") + F.coalesce("_i", F.lit(0))).drop("_i")
    return Placed(at, crowded)


def seen_features(row_features: DataFrame, place: Placed, past: Baseline | None = None) -> DataFrame:
    """row features with day, bucket, opens, i, n_bucket of their rows and df, as of before the row."""
    keyed = row_features.drop("bucket").join(place.rows.select("tenant_id", "device_key", "ws", "day", "bucket", "held", "opens", "visible", "i", "n_bucket"), ["tenant_id", "device_key", "ws"])
    return _ring_count(keyed, ["tenant_id", "feature"], "df", past and past.features, place.crowded).drop("held", "visible")


def with_ring(rows: DataFrame, row_features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with n_bucket, row features with bucket and df), both as of before the row.

    A slot holds its latest active day.  The first row of a day still sees the day that its slot held before; later
    rows see the rows before them of their own day instead.
    """
    place = placed(rows)
    return place.rows.drop("opens", "day", "i", "held", "visible"), seen_features(row_features, place).drop("day", "opens", "i", "n_bucket")


def capped_df(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Of (tenant_id, day, bucket, feature, feature_id, df), the features of highest df (ties: least id)."""
    order = Window.partitionBy("tenant_id", "day", "bucket").orderBy(F.desc("df"), "feature_id")
    return df.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def weighted(feature: Column, n: Column) -> Column:
    """weight * ln(1 + count) as a 32-bit number; zeros are to be dropped."""
    return (families.weight(feature) * F.log1p(n.cast("double"))).cast("float")


def _decayed(x: Column, i: Column, keys: list[str], beta: float) -> Column:
    """Sum over earlier i' < i of beta**(i-1-i') * x, inside keys.

    Terms under 1e-18 are cut by the frame.  Powers are taken from the start of blocks of positions, so they stay finite
    however long a history is; a frame spans two blocks at most.
    """
    reach = max(1, math.ceil(-18 * math.log(10) / math.log(beta)))
    size = max(reach, int(400 * math.log(2) / -math.log(beta)))
    block = F.floor(i / size)
    raised = x * F.pow(F.lit(1 / beta), (i - block * size).cast("double"))
    frame = Window.partitionBy(*keys).orderBy(i).rangeBetween(-reach, -1)
    even, odd = (F.coalesce(F.sum(F.when(F.pmod(block, F.lit(2)) == k, raised)).over(frame), F.lit(0.0)) for k in (0, 1))
    own, other = F.when(F.pmod(block, F.lit(2)) == 0, even).otherwise(odd), F.when(F.pmod(block, F.lit(2)) == 0, odd).otherwise(even)
    down = F.pow(F.lit(beta), (i - 1 - block * size).cast("double"))
    return own * down + other * down * beta**size


def centroid_features(seen: DataFrame, alpha: float = ALPHA, past: Baseline | None = None) -> DataFrame:
    """row features (with bucket and i) with tf_w and centroid, the device's and bucket's mean of the feature before the row.

    The centroid is an exponential mean of weighted rows, in closed form: its value for a feature is a decayed sum over the
    feature's own earlier rows.  A value of `past` stands in for all rows up to its own place.
    """
    seen = seen.withColumn("tf_w", weighted(F.col("feature"), F.col("n")))
    x = F.col("tf_w").cast("double")
    if past is not None:
        old = past.centroids.select(*GROUP, "feature", "i", (F.col("value") / alpha).alias("_x"))
        seen, x = seen.unionByName(old, allowMissingColumns=True), F.coalesce("_x", x)
    seen = seen.withColumn("centroid", F.lit(alpha) * _decayed(x, F.col("i"), [*GROUP, "feature"], 1 - alpha))
    return seen if past is None else seen.where("_x IS NULL").drop("_x")


def centroid_sums() -> list[Column]:
    """Aggregates of centroid_features over a row: dot and row_norm2."""
    x = F.col("tf_w").cast("double")
    return [F.sum(x * F.col("centroid")).alias("dot"), F.sum(x * x).alias("row_norm2")]


def with_centroid_norm(rows: DataFrame, alpha: float = ALPHA, past: Baseline | None = None) -> DataFrame:
    """rows (i, dot, row_norm2) with centroid_norm2, as of before the row.

    The norm needs features absent from the row too; it follows |C'|^2 = b^2 |C|^2 + 2ab C.x + a^2 |x|^2, a decayed sum of
    one number a row.
    """
    rows = rows.fillna(0.0, ["dot", "row_norm2"])
    step = norm_step(alpha)
    if past is not None:
        rows = rows.unionByName(past.groups.select(*GROUP, "i", F.col("norm2").alias("_x")), allowMissingColumns=True)
        step = F.coalesce("_x", step)
    rows = rows.withColumn("centroid_norm2", _decayed(step, F.col("i"), GROUP, (1 - alpha) ** 2))
    return rows if past is None else rows.where("_x IS NULL").drop("_x")


def norm_step(alpha: float) -> Column:
    """What a row adds to the squared norm of its centroid, once that has decayed."""
    return F.lit(2 * alpha * (1 - alpha)) * F.col("dot") + F.lit(alpha * alpha) * F.col("row_norm2")


def with_centroid(rows: DataFrame, seen: DataFrame, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """(rows with dot, row_norm2, centroid_norm2; row features with tf_w and centroid), as of before the row."""
    key = ["tenant_id", "device_key", "ws"]
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy(*GROUP).orderBy("ws")).cast("long"))
    made = centroid_features(seen.join(numbered.select(*key, "i"), key), alpha)
    numbered = numbered.join(made.groupBy(*key).agg(*centroid_sums()), key, "left")
    return with_centroid_norm(numbered, alpha).drop("i"), made.drop("i")


def capped_centroid(values: DataFrame, most: int = 10_000) -> DataFrame:
    """Of (tenant_id, device_key, bucket, feature_id, value), the largest by size (ties: least id)."""
    order = Window.partitionBy("tenant_id", "device_key", "bucket").orderBy(F.desc(F.abs("value")), "feature_id")
    return values.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def merged_moments(n: Column, mean: Column, m2: Column, n2: Column, mean2: Column, m22: Column) -> tuple[Column, Column]:
    """(mean, m2) of two lots of numbers, each with how many, their mean and their sum of squared differences from it."""
    both, gap = F.greatest(n + n2, F.lit(1)), mean2 - mean
    return mean + gap * n2 / both, m2 + m22 + gap * gap * n * n2 / both


def with_stats(rows: DataFrame, past: Baseline | None = None) -> DataFrame:
    """rows with n, mean and sample variance of lines and bytes over the earlier rows of the device and bucket."""
    before = Window.partitionBy("tenant_id", "device_key", "bucket").orderBy("ws").rowsBetween(Window.unboundedPreceding, -1)
    made = {"stats_n": F.count("lines").over(before)}
    if past is not None:
        old = ["n", *[f"{c}_{m}" for c in ("lines", "bytes") for m in ("mean", "m2")]]
        rows = rows.join(past.groups.select(*GROUP, *[F.col(c).alias(f"_{c}") for c in old]), GROUP, "left")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        n, n0 = F.count("lines").over(before), F.coalesce("_n", F.lit(0))
        made = {"stats_n": n + n0}
        for c in ("lines", "bytes"):
            mean, m2 = merged_moments(n0, zero(F.col(f"_{c}_mean")), zero(F.col(f"_{c}_m2")), n, zero(F.avg(c).over(before)), zero(F.var_pop(c).over(before) * n))
            made[f"{c}_mean"], made[f"{c}_var"] = mean, F.when(n + n0 > 1, m2 / (n + n0 - 1)).otherwise(0.0)
        return rows.withColumns(made).drop(*[f"_{c}" for c in old])
    for c in ("lines", "bytes"):
        made[f"{c}_mean"] = F.coalesce(F.avg(c).over(before), F.lit(0.0))
        made[f"{c}_var"] = F.coalesce(F.var_samp(c).over(before), F.lit(0.0))
    return rows.withColumns(made)


def final_stats(rows: DataFrame) -> DataFrame:
    """n, mean and m2 of lines and bytes after all rows, per device and bucket."""
    agg = [F.count("*").alias("n"), F.max("ws").alias("last_ws")]
    for c in ("lines", "bytes"):
        agg += [F.avg(c).alias(f"{c}_mean"), (F.var_pop(c) * F.count(c)).alias(f"{c}_m2")]
    return rows.groupBy("tenant_id", "device_key", "bucket").agg(*agg)
