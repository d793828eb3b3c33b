"""Silent and sharply reduced sources: per device, per tenant and per source stream.

Rows: tenant_id, device_key, ws, we, bucket, lines, bytes.  The evaluation time of silences is a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .baselines import merged_moments

#: Subject kinds.
DEVICE, TENANT, STREAM = 1, 2, 3


@dataclass(frozen=True)
class SilenceGates:
    min_mature: int = 120
    min_missed: int = 3
    min_lines: int = 10


@dataclass(frozen=True)
class DropGates:
    """The defaults of sharp drops."""

    min_maturity: int = 120
    min_expected: float = 10.0
    min_absolute: float = 10.0
    max_ratio: float = 0.25
    min_drop: float = 0.75
    stddevs: float = 3.0


def subjects(rows: DataFrame, kind: int) -> DataFrame:
    """rows with subject_kind and subject_key.  Tenant subjects take each device window on its own."""
    key = {DEVICE: "device_key", TENANT: "tenant_id", STREAM: "source_stream_id"}[kind]
    return rows.withColumns({"subject_kind": F.lit(kind), "subject_key": F.col(key)})


def expected_state(rows: DataFrame, kind: int, size: int, min_lines: int = 10) -> DataFrame:
    """Counters and last-seen window of every subject.  Late windows count but don't move the last-seen window back;
    of equal ends the last in (ws, device_key) order stands."""
    last = F.max_by(F.struct("ws", "we", "lines", "bytes", "bucket"), F.struct("we", "ws", "device_key"))
    mature = F.col("lines") >= min_lines if min_lines else F.lit(True)
    got = subjects(rows, kind).groupBy("subject_kind", "tenant_id", "subject_key").agg(F.count("*").alias("observed_windows"), F.count_if(mature).alias("mature_windows"), last.alias("l"), F.max("we").alias("last_update_ts"))
    return got.select(
        "subject_kind", "tenant_id", "subject_key", F.lit(size).cast("long").alias("window_size_s"), "observed_windows", "mature_windows",
        F.col("l.ws").alias("last_ws"), F.col("l.we").alias("last_we"), F.col("l.lines").alias("last_lines"), F.col("l.bytes").alias("last_bytes"), F.col("l.bucket").alias("last_bucket"), "last_update_ts",
    )


def evaluate_silence(state: DataFrame, eval_ts: Column, gates: SilenceGates = SilenceGates(), policy: DataFrame | None = None, open_silence: DataFrame | None = None) -> DataFrame:
    """state with suppression (null: a candidate), missed, expected_lines, observed_lines, drop_ratio, window_start/end_ts.

    policy: tenant_id and min_missed, min_mature, min_lines, each null or an override; small, one row a tenant.
    open_silence: subject_kind, tenant_id, subject_key of open silences.
    """
    out = state
    names = {"min_missed": gates.min_missed, "min_mature": gates.min_mature, "min_lines": gates.min_lines}
    if policy is not None:
        out = out.join(policy.select("tenant_id", *[F.col(n).alias(f"_{n}") for n in names]), "tenant_id", "left")
        out = out.withColumns({n: F.coalesce(F.col(f"_{n}"), F.lit(v)) for n, v in names.items()}).drop(*[f"_{n}" for n in names])
    else:
        out = out.withColumns({n: F.lit(v) for n, v in names.items()})
    if open_silence is not None:
        opened = open_silence.select("subject_kind", "tenant_id", "subject_key").distinct().withColumn("opened", F.lit(True))
        out = out.join(opened, ["subject_kind", "tenant_id", "subject_key"], "left")
    else:
        out = out.withColumn("opened", F.lit(None).cast("boolean"))
    size, ends = F.col("window_size_s"), F.col("last_we")
    missed = F.floor((eval_ts - ends) / size)
    expected = F.col("last_lines") * missed
    gate = (
        F.when(~F.col("subject_kind").isin(DEVICE, TENANT, STREAM), "InvalidSubjectKind")
        .when(F.col("min_missed") <= 0, "InvalidEvaluationConfig")
        .when(size <= 0, "InvalidWindowSize")
        .when(ends <= F.col("last_ws"), "InvalidWindowBounds")
        .when(F.col("last_bucket") > 47, "InvalidBucket")
        .when(F.col("mature_windows") > F.col("observed_windows"), "CounterInversion")
        .when(F.col("mature_windows") < F.col("min_mature"), "NotMature")
        .when(F.col("opened"), "OpenSilenceAlreadyExists")
        .when(eval_ts <= ends, "NotSilent")
        .when(missed < F.col("min_missed"), "NotEnoughMissedWindows")
        .when(expected < F.col("min_lines"), "BelowExpectedLineFloor")
    )
    out = out.withColumn("suppression", gate)
    found = F.col("suppression").isNull()
    return out.withColumns(
        {
            "missed": F.when(found, missed).cast("long"),
            "expected_lines": F.when(found, expected).cast("long"),
            "observed_lines": F.when(found, F.lit(0)).cast("long"),
            "drop_ratio": F.when(found, F.lit(1.0)),
            "window_start_ts": F.when(found, ends).cast("long"),
            "window_end_ts": F.when(found, ends + missed * size).cast("long"),
        }
    ).drop(*names, "opened")


def expected_volume(rows: DataFrame, key: str = "device_key", past: DataFrame | None = None) -> DataFrame:
    """rows with maturity, mean_lines, mean_bytes and sd_lines of the earlier windows of the same subject and bucket.  past: moments that earlier runs left, as of `volumes_after`."""
    before = Window.partitionBy("tenant_id", key, "bucket").orderBy("ws").rowsBetween(Window.unboundedPreceding, -1)
    if past is not None:
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        old = past.select("tenant_id", F.col("subject_key").alias(key), "bucket", F.col("n").alias("_n"), *[F.col(f"{c}_{m}").alias(f"_{c}_{m}") for c in ("lines", "bytes") for m in ("mean", "m2")])
        rows = rows.join(old, ["tenant_id", key, "bucket"], "left")
        n, n0, made = F.count("lines").over(before), F.coalesce("_n", F.lit(0)), {}
        for c in ("lines", "bytes"):
            made[c] = merged_moments(n0, zero(F.col(f"_{c}_mean")), zero(F.col(f"_{c}_m2")), n, zero(F.avg(c).over(before)), zero(F.var_pop(c).over(before) * n))
        sd = F.when(n + n0 > 1, F.sqrt(made["lines"][1] / (n + n0 - 1))).otherwise(0.0)
        rows = rows.withColumns({"maturity": n + n0, "mean_lines": made["lines"][0], "mean_bytes": made["bytes"][0], "sd_lines": sd})
        return rows.drop("_n", *[f"_{c}_{m}" for c in ("lines", "bytes") for m in ("mean", "m2")])
    return rows.withColumns(
        {
            "maturity": F.count("lines").over(before),
            "mean_lines": F.coalesce(F.avg("lines").over(before), F.lit(0.0)),
            "mean_bytes": F.coalesce(F.avg("bytes").over(before), F.lit(0.0)),
            "sd_lines": F.coalesce(F.stddev_samp("lines").over(before), F.lit(0.0)),
        }
    )


def _total(c: Column) -> Column:
    """The sum of doubles, whatever their order: as decimals of 12 places.  Sums of doubles in the order of a shuffle miss a gate that they meet exactly."""
    return F.sum(c.cast("decimal(38,12)"))


def tenant_windows(volumes: DataFrame, gates: DropGates = DropGates(), silent: DataFrame | None = None) -> DataFrame:
    """Device windows rolled up to tenants: devices must be mature and expected; two at least; silent devices are out.
    Means add up (to 9 places, so that thirds add up to one), deviations add as squares, maturity is the number of parts."""
    parts = volumes.where((F.col("maturity") >= gates.min_maturity) & (F.col("mean_lines") >= gates.min_expected))
    if silent is not None:
        parts = parts.join(silent.select("tenant_id", F.col("subject_key").alias("device_key")), ["tenant_id", "device_key"], "left_anti")
    mean = lambda c: F.round(_total(F.col(c)), 9).cast("double").alias(c)
    got = parts.groupBy("tenant_id", "ws", "we", "bucket").agg(
        F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.count("*").alias("maturity"), mean("mean_lines"),
        mean("mean_bytes"), F.sqrt(_total(F.col("sd_lines") * F.col("sd_lines")).cast("double")).alias("sd_lines"),
    )
    return got.where("maturity >= 2")


def evaluate_drop(windows: DataFrame, gates: DropGates = DropGates()) -> DataFrame:
    """windows with suppression (null: a candidate), ratio, drop_ratio, absolute_drop and z_drop."""
    mean, lines = F.col("mean_lines"), F.col("lines")
    ratio = lines / mean
    drop = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio))
    z = F.when(F.col("sd_lines") > 1e-12, F.greatest(F.lit(0.0), (mean - lines) / F.col("sd_lines")))
    bad_gates = gates.min_maturity <= 0 or not gates.min_expected > 0 or gates.min_absolute < 0 or not 0 <= gates.max_ratio <= 1 or not 0 <= gates.min_drop <= 1 or gates.stddevs < 0
    single = lambda c: c.cast("float")
    gate = (
        F.when(F.col("we") <= F.col("ws"), "InvalidWindowBounds")
        .when(F.col("bucket") > 47, "InvalidBucket")
        .when(F.lit(bad_gates), "InvalidEvaluationConfig")
        .when((mean <= 0) | mean.isNull(), "InvalidExpectedVolume")
        .when(F.col("maturity") < gates.min_maturity, "NotMature")
        .when(mean < gates.min_expected, "BelowExpectedLineFloor")
        .when(lines == 0, "HardSilencePriority")
        .when(mean - lines < gates.min_absolute, "AbsoluteDropBelowFloor")
        .when(single(ratio) > single(F.lit(gates.max_ratio)), "ObservedRatioAboveThreshold")
        .when(single(drop) < single(F.lit(gates.min_drop)), "DropRatioBelowThreshold")
        .when(single(z) < single(F.lit(gates.stddevs)), "VarianceGateNotMet")
    )
    out = windows.withColumn("suppression", gate)
    found = F.col("suppression").isNull()
    return out.withColumns({"ratio": F.when(found, ratio), "drop_ratio": F.when(found, drop), "absolute_drop": F.when(found, mean - lines), "z_drop": F.when(found, z)})


#: Suppressions that say a source has recovered.
RECOVERED = ("AbsoluteDropBelowFloor", "ObservedRatioAboveThreshold", "DropRatioBelowThreshold")


def _drop_mark() -> Column:
    """1: a candidate, which opens a drop; 0: recovered, which closes it."""
    return F.when(F.col("suppression").isNull(), 1).when(F.col("suppression").isin(*RECOVERED), 0)


def emitted_drops(evaluated: DataFrame, keys: list[str], silences: DataFrame | None = None, opened: DataFrame | None = None) -> DataFrame:
    """Candidates that open a drop: one while a drop is open is suppressed, recovery or hard silence closes it.
    opened: tenant_id and subject_key of drops that earlier runs left open.

    Without recursion: a candidate is emitted unless the last mark before it in its subject is a candidate too.
    silences: keys and ws of hard silences, which close.
    """
    marked = evaluated.withColumn("mark", _drop_mark())
    if silences is not None:
        marked = marked.unionByName(silences.select(*keys, "ws").withColumn("mark", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy("ws", F.desc_nulls_last("mark")).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("was", F.last("mark", ignorenulls=True).over(before))
    if opened is not None:
        left = opened.select("tenant_id", "subject_key", F.lit(1).alias("left"))
        marked = marked.join(left, ["tenant_id", "subject_key"], "left").withColumn("was", F.coalesce("was", "left")).drop("left")
    return marked.where("mark = 1 AND coalesce(was, 0) = 0").drop("mark", "was")


def silence_spells(windows: DataFrame, silences: DataFrame, keys: list[str]) -> DataFrame:
    """Hard silences that open: any observed window of the subject closes, an open one suppresses repeats.

    silences: keys and window_start_ts of candidates at their evaluation times (eval_ts)."""
    events = silences.select(*keys, F.col("eval_ts").alias("at"), F.lit(1).alias("mark"), F.struct(*silences.columns).alias("row"))
    seen = windows.select(*keys, F.col("we").alias("at"), F.lit(0).alias("mark"), F.lit(None).cast(events.schema["row"].dataType).alias("row"))
    before = Window.partitionBy(*keys).orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, -1)
    both = events.unionByName(seen).withColumn("was", F.last("mark").over(before))
    return both.where("mark = 1 AND coalesce(was, 0) = 0").select("row.*")


def stream_rows(lines: DataFrame, size: int) -> DataFrame:
    """Windows per source stream: tenant_id, device_key, source_path, source_stream_id (as given), ws, we, bucket, lines, bytes."""
    from ..functions import timing

    ws = timing.window_start(F.coalesce("ts", F.lit(0).cast("long")), size)
    keys = ["tenant_id", "device_key", "source_path", "source_stream_id"]
    got = lines.withColumn("ws", ws).groupBy(*keys, "ws").agg(F.count("*").alias("lines"), F.sum("byte_len").cast("long").alias("bytes"))
    return got.withColumns({"we": F.col("ws") + size, "bucket": timing.time_bucket(F.col("ws"))})


def canonical_path(path: Column) -> Column:
    """Backslashes as slashes; null where the path is absolute, empty, climbs or holds control bytes."""
    p = F.translate(path, "\\", "/")
    bad = (p == "") | p.startswith("/") | p.rlike(r"(^|/)(\.{0,2})(/|$)") | p.rlike(r"[\x00-\x1f\x7f]") | p.rlike(r"^[A-Za-z]:")
    return F.when(~bad, p)


def stream_catalog(stream_windows: DataFrame) -> DataFrame:
    return stream_windows.groupBy("tenant_id", "device_key", "source_path", "source_stream_id").agg(F.min("ws").alias("first_seen_ts"), F.max("we").alias("last_seen_ts"))


def silence_alerts(evaluated: DataFrame) -> DataFrame:
    """Alert rows of silence candidates, without ids.  Source streams come with device_key and source_path."""
    d, stream = F.col("subject_kind") == DEVICE, "source_path" in evaluated.columns
    kv = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    kind = F.when(d, "device").when(F.col("subject_kind") == TENANT, "tenant").otherwise("source_stream")
    details = F.array_compact(F.array(
        *([kv("drop_kind", F.lit("hard_silence"))] if stream else []), kv("subject_kind", kind), kv("tenant_id", F.col("tenant_id")), F.when(d, kv("device_key", F.col("subject_key"))), *_stream_details(stream), kv("window_start_ts", F.col("window_start_ts")), kv("window_end_ts", F.col("window_end_ts")),
        kv("last_seen_ts", F.col("last_we")), kv("expected_windows_missed", F.col("missed")), kv("expected_lines", F.col("expected_lines")), kv("observed_lines", F.col("observed_lines")),
        kv("drop_ratio", F.format_string("%.6f", F.col("drop_ratio"))), kv("bucket", F.col("last_bucket")),
    ))
    of, name = _named(stream, kind)
    score = F.format_string("%.3f", F.col("drop_ratio"))
    analyst = F.concat(F.lit("V_DROP hard_silence score " if stream else "V_DROP score "), score, F.lit(". Expected "), F.col("expected_lines"), F.lit(" lines over "), F.col("missed"), F.lit(" missed windows for "), of, F.lit("; observed 0 lines since "), F.col("last_we"), F.lit("."))
    customer = F.concat(F.lit("Expected log activity was not observed for "), name, F.lit(". The last observed window ended at "), F.col("last_we"), F.lit("."))
    msg = f"expected log activity was not observed for this {'source stream' if stream else 'subject'}"
    return _alert(evaluated.where("suppression IS NULL"), msg, details, F.lit(0), F.lit(0), F.col("last_bucket"), kind, analyst, customer)


def _stream_details(stream: bool) -> list[Column]:
    kv = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    return [kv("device_key", F.col("device_key")), kv("source_stream_id", F.col("subject_key")), kv("source_path", F.col("source_path"))] if stream else []


def _named(stream: bool, kind: Column) -> tuple[Column, Column]:
    """A subject as the summaries for analysts and customers name it."""
    if not stream:
        return (F.concat_ws(" ", kind, "subject_key"),) * 2
    return tuple(F.concat(F.lit("source stream "), F.col(c), F.lit(" on device "), F.col("device_key")) for c in ("subject_key", "source_path"))


def drop_alerts(evaluated: DataFrame, kind: int, gates: DropGates = DropGates()) -> DataFrame:
    d, stream = F.lit(kind == DEVICE), kind == STREAM and "source_path" in evaluated.columns
    kv = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    six = lambda c: F.format_string("%.6f", c.cast("double"))
    name = {DEVICE: "device", TENANT: "tenant", STREAM: "source_stream"}[kind]
    details = F.array_compact(F.array(
        kv("drop_kind", F.lit("sharp_drop")), kv("subject_kind", F.lit(name)), kv("tenant_id", F.col("tenant_id")), F.when(d, kv("device_key", F.col("subject_key"))), *_stream_details(stream), kv("window_start_ts", F.col("ws")), kv("window_end_ts", F.col("we")),
        kv("bucket", F.col("bucket")), kv("expected_lines", six(F.col("mean_lines"))), kv("observed_lines", F.col("lines")), kv("observed_expected_ratio", six(F.col("ratio").cast("float"))), kv("drop_ratio", six(F.col("drop_ratio").cast("float"))),
        kv("baseline_n", F.col("maturity")), kv("baseline_mean_lines", six(F.col("mean_lines"))), kv("baseline_stddev_lines", six(F.col("sd_lines"))), kv("z_drop", F.coalesce(six(F.col("z_drop").cast("float")), F.lit("none"))),
        kv("max_observed_expected_ratio", six(F.lit(gates.max_ratio))), kv("min_drop_ratio", six(F.lit(gates.min_drop))), kv("min_absolute_drop_lines", six(F.lit(gates.min_absolute))),
        kv("expected_bytes", six(F.col("mean_bytes"))), kv("observed_bytes", F.col("bytes")), kv("absolute_drop_lines", six(F.col("absolute_drop"))),
    ))
    found = evaluated.where("suppression IS NULL").withColumns({"subject_kind": F.lit(kind), "window_start_ts": F.col("ws"), "window_end_ts": F.col("we")})
    of, named = _named(stream, F.lit(name))
    analyst = F.concat(F.lit("V_DROP sharp_drop score "), F.format_string("%.3f", F.col("drop_ratio")), F.lit(". Expected "), six(F.col("mean_lines")), F.lit(" lines for "), of, F.lit("; observed "), F.col("lines"), F.lit(" lines, drop ratio "), six(F.col("drop_ratio").cast("float")), F.lit("."))
    customer = F.concat(F.lit("Log activity dropped sharply but did not stop for "), named, F.lit(" during this window."))
    msg = f"log volume dropped sharply but did not stop for this {'source stream' if stream else 'subject'}"
    return _alert(found, msg, details, F.col("lines"), F.col("bytes"), F.col("bucket"), F.lit(name), analyst, customer)


def _alert(found: DataFrame, msg: str, details: Column, lines: Column, size: Column, bucket: Column, kind: Column, analyst: Column, customer: Column) -> DataFrame:
    reason = F.struct(F.lit("V_DROP").alias("code"), F.lit(msg).alias("msg"), details.alias("details"))
    stream = "source_path" in found.columns
    device = F.when(F.col("subject_kind") == TENANT, "__tenant__").otherwise(F.col("device_key" if stream else "subject_key"))
    return found.select(
        "tenant_id", kind.alias("subject_kind"), "subject_key", device.alias("device_key"), *(["source_path"] if stream else []), "window_start_ts", "window_end_ts",
        (F.col("window_end_ts") - F.col("window_start_ts")).cast("int").alias("window_size_s"), bucket.cast("int").alias("bucket"), F.lit("info").alias("label"), F.lit("medium").alias("confidence"), F.lit(False).alias("cold_start"),
        F.col("drop_ratio").cast("float").alias("score_total"), F.col("drop_ratio").cast("float").alias("score_volume"), F.array(reason).alias("reasons"), analyst.alias("summary_analyst"), customer.alias("summary_customer"), lines.cast("long").alias("lines"), size.cast("long").alias("bytes"),
    )


@dataclass(frozen=True)
class Volume:
    """Which subjects are watched, and their gates; sharp drops take the maturity and line floors of silences."""

    device: bool = True
    tenant: bool = True
    stream: bool = False
    gates: SilenceGates = SilenceGates()

    def drops(self, kind: int) -> DropGates:
        lines = float(self.gates.min_lines)
        return DropGates(min_maturity=2 if kind == TENANT else self.gates.min_mature, min_expected=lines, min_absolute=lines)


#: What runs leave of volume: subjects as of `expected_state` (a stream with its device and path), moments of lines and bytes by bucket, open silences and drops.
WATCHED = {
    "subjects": "subject_kind int, tenant_id string, subject_key string, window_size_s long, observed_windows long, mature_windows long, last_ws long, last_we long, last_lines long, last_bytes long, last_bucket int, last_update_ts long, device_key string, source_path string",
    "volumes": "subject_kind int, tenant_id string, subject_key string, bucket int, n long, lines_mean double, lines_m2 double, bytes_mean double, bytes_m2 double",
    "opened": "subject_kind int, tenant_id string, subject_key string, silence boolean, sharp_drop boolean",
}
SUBJECT = ["subject_kind", "tenant_id", "subject_key"]


@dataclass(frozen=True)
class Watched:
    subjects: DataFrame
    volumes: DataFrame
    opened: DataFrame


def nothing_watched(spark: SparkSession) -> Watched:
    return Watched(**{n: spark.createDataFrame([], s) for n, s in WATCHED.items()})


def state_after(past: DataFrame, now: DataFrame) -> DataFrame:
    """expected_state of all windows, from that of earlier runs and of this one, whose windows come later where they end alike."""
    names = ("last_ws", "last_we", "last_lines", "last_bytes", "last_bucket")
    both = past.withColumn("_run", F.lit(0)).unionByName(now.withColumn("_run", F.lit(1)))
    last = F.max_by(F.struct("window_size_s", *names, "device_key", "source_path"), F.struct("last_we", "last_ws", "_run"))
    got = both.groupBy(*SUBJECT).agg(F.sum("observed_windows").alias("observed_windows"), F.sum("mature_windows").alias("mature_windows"), last.alias("l"), F.max("last_update_ts").alias("last_update_ts"))
    return got.select(*SUBJECT, "l.window_size_s", "observed_windows", "mature_windows", *[f"l.{c}" for c in names], "last_update_ts", "l.device_key", "l.source_path")


def volumes_after(past: DataFrame, rows: DataFrame, kind: int, key: str) -> DataFrame:
    """Moments of lines and bytes of subjects of a kind by bucket, after the windows `rows`."""
    made = [F.count("*").alias("n")]
    for c in ("lines", "bytes"):
        made += [F.avg(c).alias(f"{c}_mean"), (F.var_pop(c) * F.count(c)).alias(f"{c}_m2")]
    keys, old = [*SUBJECT, "bucket"], past.where(F.col("subject_kind") == kind)
    now = rows.select(F.lit(kind).alias("subject_kind"), "tenant_id", F.col(key).alias("subject_key"), "bucket", "lines", "bytes").groupBy(*keys).agg(*made)
    both = now.join(old.withColumnsRenamed({c: f"_{c}" for c in old.columns if c not in keys}), keys, "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n, n0, out = F.coalesce("n", F.lit(0)), F.coalesce("_n", F.lit(0)), []
    for c in ("lines", "bytes"):
        mean, m2 = merged_moments(n0, zero(F.col(f"_{c}_mean")), zero(F.col(f"_{c}_m2")), n, zero(F.col(f"{c}_mean")), zero(F.col(f"{c}_m2")))
        out += [mean.alias(f"{c}_mean"), m2.alias(f"{c}_m2")]
    return both.select(*keys, (n + n0).alias("n"), *out)


def loss_alerts(rows: DataFrame, size: int, eval_ts: Column, volume: Volume = Volume(), min_lines: int = 10, streams: DataFrame | None = None) -> DataFrame | None:
    """As judged, of one run alone."""
    return judged(rows, size, eval_ts, volume, min_lines, streams)[0]


def judged(rows: DataFrame, size: int, eval_ts: Column, volume: Volume = Volume(), min_lines: int = 10, streams: DataFrame | None = None, past: Watched | None = None) -> tuple[DataFrame | None, Watched]:
    """Alert rows, without ids, in the order of priority: silences of devices and of tenants at eval_ts, drops of those that are not
    silent, then source streams (streams: as of `stream_rows`); None where nothing is watched.  And what the next run goes on from.

    past: what earlier runs left.  A subject that stays silent is not reported again until a window of it was seen; nor is a
    drop before its source has recovered or been silent.
    """
    old = past or nothing_watched(rows.sparkSession)
    found, silent, states, volumes, opens = [], {}, [], [], []
    kinds = [(DEVICE, volume.device, rows), (TENANT, volume.tenant, rows), (STREAM, volume.stream and streams is not None, streams)]
    for kind, on, windows in kinds:
        if not on:
            continue
        now = expected_state(windows, kind, size, min_lines)
        if kind == STREAM:
            named = stream_catalog(streams).select("tenant_id", F.col("source_stream_id").alias("subject_key"), "device_key", "source_path")
            now = now.join(named, ["tenant_id", "subject_key"])
        else:
            now = now.withColumns({c: F.lit(None).cast("string") for c in ("device_key", "source_path")})
        still, state = None, now
        if past is not None:
            state = state_after(old.subjects.where(F.col("subject_kind") == kind), now)
            still = old.opened.where((F.col("subject_kind") == kind) & F.col("silence")).join(now, SUBJECT, "left_anti")
        got = evaluate_silence(state, eval_ts, volume.gates, open_silence=still)
        if kind != STREAM:
            got = got.drop("device_key", "source_path")
        found.append(silence_alerts(got))
        silent[kind] = got.where("suppression IS NULL OR suppression = 'OpenSilenceAlreadyExists'").select("tenant_id", "subject_key")
        states.append(state)
        opens.append(silent[kind].select(F.lit(kind).alias("subject_kind"), "tenant_id", "subject_key", F.lit(True).alias("silence"), F.lit(False).alias("sharp_drop")))
    moments = lambda kind: None if past is None else old.volumes.where(F.col("subject_kind") == kind)

    def drops(windows: DataFrame, kind: int, key: str, quiet: DataFrame) -> DataFrame:
        loud = windows.withColumn("subject_key", F.col(key)).join(quiet, ["tenant_id", "subject_key"], "left_anti")
        evaluated = evaluate_drop(loud, volume.drops(kind))
        keys = ["tenant_id", "device_key", "subject_key"] if kind == STREAM else ["tenant_id", "subject_key"]
        left = old.opened.where((F.col("subject_kind") == kind) & F.col("sharp_drop")).select("tenant_id", "subject_key").join(quiet, ["tenant_id", "subject_key"], "left_anti")
        marks = evaluated.withColumn("mark", _drop_mark()).where("mark IS NOT NULL").groupBy("tenant_id", "subject_key").agg(F.max_by("mark", "ws").alias("mark"))
        now = left.join(marks, ["tenant_id", "subject_key"], "left_anti").unionByName(marks.where("mark = 1").select("tenant_id", "subject_key"))
        opens.append(now.select(F.lit(kind).alias("subject_kind"), "tenant_id", "subject_key", F.lit(False).alias("silence"), F.lit(True).alias("sharp_drop")))
        return drop_alerts(emitted_drops(evaluated, keys, opened=None if past is None else left), kind, volume.drops(kind))

    expected = expected_volume(rows, past=moments(DEVICE))
    if volume.device or volume.tenant:
        volumes.append(volumes_after(old.volumes, rows, DEVICE, "device_key"))
    if volume.device:
        found.insert(1 + volume.tenant, drops(expected, DEVICE, "device_key", silent[DEVICE]))
    if volume.tenant:
        found.insert(2 * volume.device + 1, drops(tenant_windows(expected, volume.drops(DEVICE), silent.get(DEVICE)), TENANT, "tenant_id", silent[TENANT]))
    if STREAM in silent:
        found.append(drops(expected_volume(streams, "source_stream_id", moments(STREAM)), STREAM, "source_stream_id", silent[STREAM]))
        volumes.append(volumes_after(old.volumes, streams, STREAM, "source_stream_id"))
    out = None
    for part in found:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, _after(old, states, volumes, opens)


def _after(old: Watched, states: list[DataFrame], volumes: list[DataFrame], opens: list[DataFrame]) -> Watched:
    """Of kinds that were judged the new tables, of others those that were there."""
    made = {}
    for name, parts in (("subjects", states), ("volumes", volumes), ("opened", opens)):
        columns = [c.strip().split()[0] for c in WATCHED[name].split(",")]
        out = getattr(old, name)
        if parts:
            new = parts[0].select(columns)
            for p in parts[1:]:
                new = new.unionByName(p.select(columns))
            out = out.join(new.select("subject_kind").distinct(), "subject_kind", "left_anti").select(columns).unionByName(new) if name != "opened" else new
        made[name] = out
    made["opened"] = made["opened"].groupBy(*SUBJECT).agg(F.bool_or("silence").alias("silence"), F.bool_or("sharp_drop").alias("sharp_drop"))
    return Watched(**made)


def diagnostics(silences: DataFrame, drops: DataFrame) -> DataFrame:
    """Counts of evaluated, candidate and suppressed subjects by tenant, and over all (tenant_id null)."""
    both = silences.select("tenant_id", F.lit("silence").alias("what"), "suppression").unionByName(drops.select("tenant_id", F.lit("sharp_drop").alias("what"), "suppression"))
    found = both.rollup("what", "tenant_id").agg(F.count("*").alias("evaluated"), F.count_if(F.col("suppression").isNull()).alias("candidates"), F.count_if(F.col("suppression").isNotNull()).alias("suppressed"))
    return found.where("what IS NOT NULL")
