"""Scores, labels, reasons and row alerts, all as expressions over baselines as of before the row."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import families
from . import baselines
from .windows import KEY

if TYPE_CHECKING:
    from .state import Baseline


@dataclass(frozen=True)
class Thresholds:
    """The defaults of scoring."""

    outlier: float = 0.85
    noise: float = 0.65
    info: float = 0.60
    blob_ratio: float = 0.60
    drift_outlier: float = 0.25
    drift_high: float = 0.35
    drift_med: float = 0.25
    volume_extreme: float = 0.90
    volume_spike: float = 0.70
    rare: float = 0.001
    z_max: float = 6.0
    min_lines: int = 10
    cold_start_days: int = 2
    top: int = 25

    def cold_start_windows(self, size: int) -> int:
        return self.cold_start_days * (3600 // size)


def idf(n: Column, df: Column) -> Column:
    return F.ln((n + 1.0) / (df + 1.0)) + 1.0


def z_score(value: Column, n: Column, mean: Column, var: Column) -> Column:
    return F.when((n < 2) | (var <= 1e-12), 0.0).otherwise(F.greatest(F.lit(0.0), (value - mean) / F.sqrt(var)))


def scored(rows: DataFrame, row_features: DataFrame, size: int, t: Thresholds = Thresholds(), alpha: float = baselines.ALPHA, past: Baseline | None = None, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with all scores, row features with df, idf, tf_w and contrib).  past: what earlier runs left; carry: keep the columns that `state.advanced` needs."""
    place = baselines.placed(rows, past)
    seen = baselines.centroid_features(baselines.seen_features(row_features, place, past), alpha, past)
    mass = F.col("tf_w").cast("double")
    seen = seen.withColumn("idf", idf(F.col("n_bucket"), F.col("df"))).withColumn("contrib", (mass * F.col("idf")).cast("float")).where("tf_w > 0")
    blob = F.when(families.is_blob(F.col("feature")), mass).otherwise(0.0)
    sums = seen.groupBy(*KEY).agg(*baselines.centroid_sums(), F.sum(mass).alias("mass"), F.sum(mass * F.col("idf")).alias("mass_idf"), F.sum(blob).alias("mass_blob"))
    carried = ["day", "i"] if carry else []
    seen = seen.drop(*{"day", "opens", "i", "n_bucket"}.difference(carried))
    out = place.rows.drop("opens", "held", "visible").join(sums, KEY, "left").fillna(0.0, ["mass", "mass_idf", "mass_blob"])
    out = baselines.with_stats(baselines.with_centroid_norm(out, alpha, past), past)
    some = F.col("mass") > 1e-12
    row_norm, centroid_norm = F.sqrt("row_norm2"), F.sqrt(F.greatest(F.col("centroid_norm2"), F.lit(0.0)))
    cosine = F.col("dot") / (row_norm * centroid_norm)
    z = F.greatest(*[z_score(F.col(c).cast("double"), F.col("stats_n"), F.col(f"{c}_mean"), F.col(f"{c}_var")) for c in ("lines", "bytes")])
    out = out.withColumns(
        {
            "rarity": F.when(some, 1 - F.exp(-F.col("mass_idf") / F.col("mass"))).otherwise(0.0),
            "drift": F.when((row_norm <= 1e-12) | (centroid_norm <= 1e-12), 0.0).otherwise(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine))),
            "volume": F.greatest(F.lit(0.0), F.least(F.lit(1.0), z / t.z_max)),
            "blob_ratio": F.when(some, F.col("mass_blob") / F.col("mass")).otherwise(0.0),
            "centroid_norm": centroid_norm,
        }
    )
    least = t.cold_start_windows(size)
    out = out.withColumns(
        {
            "total": 0.45 * F.col("rarity") + 0.40 * F.col("drift") + 0.15 * F.col("volume"),
            "cold_start": (centroid_norm <= 0.0) | (F.lit(least > 0) & (F.col("n_bucket") < least)),
        }
    )
    return out.drop("mass", "mass_idf", "mass_blob", *{"day", "i", "dot", "row_norm2", "centroid_norm2"}.difference(["day", "i", "dot", "row_norm2", "centroid_norm2"] if carry else [])), seen


def top_features(seen: DataFrame, most: int = 25) -> DataFrame:
    """The features of a row that contribute most (ties: by text): a rank filter, which Spark applies before the shuffle's sort."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("contrib"), "feature")
    return seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _focus(feature: Column) -> Column:
    starts = lambda p, canon: feature.startswith(p) | (feature == f"canon={canon}")
    src, dst, user = starts("SourceIp", "SourceIp"), starts("DestIp", "DestIp"), starts("User=", "User")
    host = starts("SourceHost", "SourceHost") | starts("DestHost", "DestHost")
    has = lambda c: F.size(F.col(c)) > 0
    return F.when(src, has("src_ips")).when(dst, has("dst_ips")).when(user, has("user_ids")).when(host, has("hosts")).otherwise(False)


def _reason(when: Column, code: str, msg: str, key: str | None, value: Column | None) -> Column:
    pair = "array<struct<k:string,v:string>>"
    details = F.array(F.struct(F.lit(key).alias("k"), value.alias("v"))).cast(pair) if key else F.array().cast(pair)
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(msg).alias("msg"), details.alias("details")))


def labelled(scores: DataFrame, seen: DataFrame, entities: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """scores with entities, top_features, entity_focus, reasons, label (null: no alert), confidence and summaries."""
    top = top_features(seen, t.top)
    item = F.struct("rank", "feature", F.col("n").alias("count"), families.family(F.col("feature")).alias("family"), "tf_w", F.col("idf").cast("float").alias("idf"), "contrib", "df")
    tops = top.groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("top_features"))
    out = scores.join(tops, KEY, "left").join(entities, KEY, "left")
    none = F.array().cast("array<struct<value:string,count:bigint>>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("src_ips", "dst_ips", "user_ids", "domains", "hosts")})
    out = out.withColumn("top_features", F.coalesce("top_features", F.array().cast(tops.schema["top_features"].dataType)))
    out = out.withColumn("entity_focus", F.exists("top_features", lambda x: _focus(x["feature"])))
    cold, total, drift, volume, blob, focus = (F.col(c) for c in ("cold_start", "total", "drift", "volume", "blob_ratio", "entity_focus"))
    outlier = ~cold & (total >= t.outlier) & (focus | (drift >= t.drift_outlier))
    noise = ~cold & (total >= t.noise) & (blob >= t.blob_ratio) & ~focus
    info = (total >= t.info) | (cold & (volume >= t.volume_extreme))
    out = out.withColumn("label", F.when(F.col("lines") < t.min_lines, None).when(outlier, "outlier").when(noise, "noise_suspect").when(info, "info"))
    number = lambda c: F.format_string("%.3f", c.cast("double"))
    n = F.col("n_bucket").cast("string")
    rare = lambda x: (x["df"] > 0) & (x["df"] / F.col("n_bucket") < t.rare)
    reasons = F.array_compact(
        F.array(
            _reason(F.exists("top_features", lambda x: x["df"] == 0), "R_NEW_FEATURE", "one or more top features are new in this time bucket", "n_bucket", n),
            _reason((F.col("n_bucket") > 0) & F.exists("top_features", rare), "R_RARE_FEATURE", "one or more top features are rare for this time bucket", "n_bucket", n),
            _reason(drift > t.drift_high, "D_HIGH_DRIFT", "the current feature mix is far from the device baseline", "drift", number(drift)),
            _reason((drift > t.drift_med) & (drift <= t.drift_high), "D_MED_DRIFT", "the current feature mix differs from the device baseline", "drift", number(drift)),
            _reason(volume > t.volume_extreme, "V_EXTREME", "window volume is extremely high for this device and bucket", "volume", number(volume)),
            _reason((volume > t.volume_spike) & (volume <= t.volume_extreme), "V_SPIKE", "window volume is elevated for this device and bucket", "volume", number(volume)),
            _reason((blob > t.blob_ratio) & ~focus, "N_HIGH_CARDINALITY", "high-cardinality blob-like features dominate this window", "blob_ratio", number(blob)),
            _reason((F.col("label") == "outlier") & focus, "O_ENTITY_FOCUSED", "top features align with captured entities for this window", None, None),
        )
    )
    out = out.withColumn("reasons", reasons)
    sure = ~cold & (F.col("label") == "outlier") & (F.size("reasons") >= 2) & focus
    out = out.withColumn("confidence", F.when(sure, "high").when(~cold & (total >= t.info), "medium").otherwise("low"))
    return out.withColumns({"summary_analyst": _analyst(number), "summary_customer": _customer()})


def _analyst(number) -> Column:
    some = lambda c, f, lead: F.when(F.size(c) > 0, F.concat(F.lit(lead), F.array_join(F.transform(F.slice(c, 1, 3), lambda x: x[f]), ", "), F.lit("."))).otherwise("")
    return F.concat(F.col("label"), F.lit(" score "), number(F.col("total")), F.lit("."), some("reasons", "code", " Reasons: "), some("top_features", "feature", " Top features: "))


def _customer() -> Column:
    phrase = (
        F.when(F.col("label") == "outlier", "An unusual pattern was observed in this log window")
        .when(F.col("label") == "noise_suspect", "A likely noisy pattern was observed in this log window")
        .when(F.col("label") == "info", "A notable pattern was observed in this log window")
    )
    lead = F.coalesce(*[F.get(c, F.lit(0))["value"] for c in ("user_ids", "src_ips", "dst_ips", "hosts", "domains")])
    signal = F.coalesce(F.concat(F.lit("key entity: "), lead), F.concat(F.lit("top signal: "), F.get("top_features", F.lit(0))["feature"]))
    return F.when(phrase.isNotNull(), F.concat(F.concat_ws(". ", phrase, F.get("reasons", F.lit(0))["msg"], signal), F.lit(".")))
