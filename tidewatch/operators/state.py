"""Baselines that outlive a run: tables that merge, so rows scored in many runs have the scores of one.

A run reads what earlier runs left as four tables and writes the next four.  Everything is a sum or merges like one:
- windows, features: rows of the ring by day and bucket, of a tenant and of each of its features; of each slot only the latest day.
- centroids: each feature's value of the mean of a device and bucket as of place `i` in its history; later it has decayed by a known power.
- groups: of a device and bucket the place reached, the centroid's squared norm there, and count, mean and squared differences of
  lines, bytes and total score.

Rows of a run come after all that earlier runs have seen, whatever their time; a window that two runs have lines of is a row
in each.  Only groups that a run touches change; the others are carried over as they are.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timing
from ..sources.shared import settled
from . import baselines
from .baselines import ALPHA, GROUP
from .volume_loss import WATCHED, Watched

STATS = ("lines", "bytes", "total")
SCHEMAS = {
    "windows": "tenant_id string, day long, bucket int, c long",
    "features": "tenant_id string, feature string, day long, bucket int, c long",
    "groups": "tenant_id string, device_key string, bucket int, i long, norm2 double, n long, last_ws long, " + ", ".join(f"{c}_mean double, {c}_m2 double" for c in STATS),
    "centroids": "tenant_id string, device_key string, bucket int, feature string, i long, value double",
}


@dataclass(frozen=True)
class Baseline:
    windows: DataFrame
    features: DataFrame
    groups: DataFrame
    centroids: DataFrame


def empty(spark: SparkSession) -> Baseline:
    return Baseline(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})


def save(tables: Baseline | Watched, path: str) -> None:
    """A folder with a table of each."""
    for f in fields(tables):
        getattr(tables, f.name).write.mode("overwrite").parquet(os.path.join(path, f.name))


def _read(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {n: spark.read.schema(s).parquet(os.path.join(path, n)) for n, s in schemas.items()}


def load(spark: SparkSession, path: str) -> Baseline:
    return Baseline(**_read(spark, path, SCHEMAS))


def load_watched(spark: SparkSession, path: str) -> Watched:
    return Watched(**_read(spark, path, WATCHED))


def _ring(old: DataFrame, new: DataFrame, by: list[str], held: DataFrame) -> DataFrame:
    """Counts of both by day and bucket, of the days that slots hold."""
    both = old.unionByName(new).groupBy(*by, "day", "bucket").agg(F.sum("c").alias("c"))
    return both.join(held, ["tenant_id", "day"], "left_semi")


def advanced(past: Baseline, scores: DataFrame, seen: DataFrame, alpha: float = ALPHA, most_features: int | None = None, most_values: int | None = None) -> Baseline:
    """`past` after the rows that `scoring.scored(..., past, carry=True)` gave.

    most_features: of a tenant, day and bucket the features of highest counts are kept; most_values: of a device and bucket
    the largest values of the centroid (ties: by text).
    """
    daily = scores.groupBy("tenant_id", "day", "bucket").agg(F.count("*").alias("c"))
    slot = Window.partitionBy("tenant_id", timing.day_slot(F.col("day"))).orderBy(F.desc("day"))
    days = past.windows.select("tenant_id", "day").unionByName(daily.select("tenant_id", "day")).distinct()
    held = settled(days.withColumn("k", F.row_number().over(slot)).where("k = 1").drop("k"), "held")
    features = _ring(past.features, seen.groupBy("tenant_id", "feature", "day", "bucket").agg(F.count("*").alias("c")), ["tenant_id", "feature"], held)
    if most_features is not None:
        features = baselines.capped_df(features.withColumns({"feature_id": F.col("feature"), "df": F.col("c")}), most_features).drop("feature_id", "df")

    beta = 1 - alpha
    last = F.max_by(F.struct("i", (beta * beta * F.col("centroid_norm2") + baselines.norm_step(alpha)).alias("norm2")), "i")
    made = [F.count("*").alias("n"), F.max("ws").alias("last_ws"), last.alias("last")]
    for c in STATS:
        made += [F.avg(c).alias(f"{c}_mean"), (F.var_pop(c) * F.count(c)).alias(f"{c}_m2")]
    now = settled(scores.groupBy(*GROUP).agg(*made).select(*GROUP, "last.*", "n", "last_ws", *[f"{c}_{m}" for c in STATS for m in ("mean", "m2")]), "groups")
    old = past.groups.withColumnsRenamed({c: f"_{c}" for c in past.groups.columns if c not in GROUP})
    zero = lambda c: F.coalesce(c, F.lit(0).cast("double"))
    both = now.join(old, GROUP, "full")
    n, n0 = F.coalesce("n", F.lit(0)), F.coalesce("_n", F.lit(0))
    kept = {"i": F.coalesce("i", "_i"), "norm2": F.coalesce("norm2", "_norm2"), "n": n + n0, "last_ws": F.greatest("last_ws", "_last_ws")}
    for c in STATS:
        kept[f"{c}_mean"], kept[f"{c}_m2"] = baselines.merged_moments(n0, zero(F.col(f"_{c}_mean")), zero(F.col(f"_{c}_m2")), n, zero(F.col(f"{c}_mean")), zero(F.col(f"{c}_m2")))
    groups = both.select(*GROUP, *[v.alias(k) for k, v in kept.items()])

    # a value decays to the place that its group has reached; one of a group without rows stays where it is
    reached = now.select(*GROUP, F.col("i").alias("_to"))
    values = past.centroids.unionByName(seen.select(*GROUP, "feature", "i", (F.lit(alpha) * F.col("tf_w").cast("double")).alias("value"))).join(reached, GROUP, "left")
    to = F.coalesce("_to", "i")
    values = values.select(*GROUP, "feature", to.alias("i"), (F.col("value") * F.pow(F.lit(beta), (to - F.col("i")).cast("double"))).alias("value"))
    centroids = values.groupBy(*GROUP, "feature", "i").agg(F.sum("value").alias("value")).where("value > 1e-18")
    if most_values is not None:
        centroids = baselines.capped_centroid(centroids.withColumn("feature_id", F.col("feature")), most_values).drop("feature_id")
    columns = {n: [c.strip().split()[0] for c in s.split(",")] for n, s in SCHEMAS.items()}
    return Baseline(_ring(past.windows, daily, ["tenant_id"], held).select(columns["windows"]), features.select(columns["features"]), groups.select(columns["groups"]), centroids.select(columns["centroids"]))
