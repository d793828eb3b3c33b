"""From raw lines to alerts in one plan."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.envelope import with_envelope
from ..functions.features import emitted
from ..functions.ids import source_stream_id
from ..functions.tokens import tokenize
from ..operators import alerts, provenance, scoring, state, volume_loss, windows
from ..sources.shared import settled, spread


def dated(lines: DataFrame, ingest_ts: int = 0, since: int | None = None, until: int | None = None) -> DataFrame:
    """lines (with `line`) with the envelope p and ts.  since and until, both inclusive, apply to the native time before
    anything is tokenized.  A line without time counts as time 0."""
    # Tests on ts (the filters here, null tests that joins infer) must not be pushed below this projection: each step of
    # the envelope would be put in place of its name again and again.  A term that is always 0 but not deterministic stops them.
    ts = F.coalesce("p.ts", F.lit(0).cast("long")) + F.spark_partition_id() * 0
    out = with_envelope(spread(lines), ingest_ts).withColumn("ts", ts)
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if until is not None:
        out = out.where(F.col("ts") <= until)
    return out.drop("line")


def parsed(lines: DataFrame, ingest_ts: int = 0, since: int | None = None, until: int | None = None, header: list[str] | None = None) -> DataFrame:
    """One row an event of a line: its other columns, ts, features and entities."""
    return _events(dated(lines, ingest_ts, since, until), header)


def _events(timed: DataFrame, header: list[str] | None = None) -> DataFrame:
    out = timed.withColumns({"pri": F.col("p.pri"), "app": F.col("p.app"), "version": F.col("p.version"), "msg": F.col("p.msg")}).drop("p")
    return emitted(out.withColumn("events", tokenize(F.col("msg"), header)).drop("msg"))


def _placed(lines: DataFrame) -> DataFrame:
    """lines with seq, the order in which caps admit: as given, else by file (plain before gzip) and place, else by line text."""
    if "seq" in lines.columns:
        return lines
    if "offset_start" not in lines.columns:
        return lines.withColumn("seq", F.xxhash64("line"))
    number = ["line_no"] if "line_no" in lines.columns else []
    return lines.withColumn("seq", F.struct("is_gzip", "file_rel", "offset_start", *number)).drop(*number)


def analyze(
    lines: DataFrame, size: int = 60, thresholds: scoring.Thresholds = scoring.Thresholds(), ingest_ts: int = 0, since: int | None = None, until: int | None = None, eval_ts: int | None = None,
    volume: volume_loss.Volume | None = volume_loss.Volume(), feature_caps: dict[str, int] = windows.FEATURE_CAPS, entity_caps: dict[str, int] = windows.ENTITY_CAPS,
    past: tuple[state.Baseline, volume_loss.Watched] | None = None, keep: Callable[[state.Baseline, volume_loss.Watched], None] | None = None,
) -> DataFrame:
    """Alerts of raw lines (tenant_id, device_key, line, byte_len), of rows and of lost volume (volume: None for none), silences
    as of eval_ts (else now); with provenance where lines have offsets, which source streams need too.

    Dated lines, counts and rows are written to the shared folder, so lines are parsed once, before this returns.
    past: what earlier runs left to score against; keep: called with what this one leaves, for the caller to write.
    """
    base, watched_before = past or (None, None)
    timed = settled(dated(_placed(lines), ingest_ts, since, until), "dated")
    rows = settled(windows.rows(timed, size), "rows")
    features, drops, counted = windows.capped_items(settled(windows.ordered_items(_events(timed), size), "items"), feature_caps)
    features = settled(features, "features")
    got, seen = scoring.scored(rows, features, size, thresholds, past=base, carry=keep is not None)
    got = settled(got.join(drops, windows.KEY, "left").fillna(0, ["dropped_features", "dropped_words", "dropped_shapes"]), "scores")
    seen = settled(seen, "seen")
    if keep is not None:
        after = state.advanced(base or state.empty(lines.sparkSession), got, seen)
        got, seen = got.drop("day", "i", "dot", "row_norm2", "centroid_norm2"), seen.drop("day", "i")
    labelled = scoring.labelled(got, seen, windows.entities_wide(windows.ranked(counted, entity_caps)), thresholds)
    out = alerts.row_alerts(labelled, size)
    from_files = "offset_start" in lines.columns
    watched = volume is not None and volume.stream and from_files
    named = timed.withColumn("source_path", volume_loss.canonical_path(F.col("file_rel"))).where("source_path IS NOT NULL") if watched else None
    streams = settled(volume_loss.stream_rows(named.withColumn("source_stream_id", F.lit(None).cast("string")), size), "streams") if watched else None
    if watched:
        streams = settled(streams.withColumn("source_stream_id", source_stream_id(F.col("tenant_id"), F.col("device_key"), F.col("source_path"))), "streams")
    left = watched_before or volume_loss.nothing_watched(lines.sparkSession)
    if volume is not None:
        at = F.lit(int(time.time()) if eval_ts is None else eval_ts)
        lost, left = volume_loss.judged(rows, size, at, volume, thresholds.min_lines, streams, watched_before)
        out = alerts.with_volume(out, lost)
    if keep is not None:
        keep(after, left)
    if not from_files:
        return out
    out = settled(out, "alerts")
    for c in ("subject_kind", "source_path"):
        out = out if c in out.columns else out.withColumn(c, F.lit(None).cast("string"))
    # silences have no lines of their own; a drop of a stream has those of its file
    has_lines = F.col("subject_kind").isNull() | (F.get("reasons", F.lit(0))["details"][0]["v"] == "sharp_drop")
    of = ["tenant_id", "device_key", "ws"]
    in_window = windows.with_window(timed, size)
    spans = provenance.spans(in_window, [*of, "device_dir"]).withColumn("source_path", F.lit(None).cast("string"))
    if watched:
        by_file = provenance.spans(windows.with_window(named, size), [*of, "device_dir", "source_path"])
        spans = spans.unionByName(by_file)
    spans = spans.withColumnsRenamed({c: f"_{c}" for c in (*of, "source_path")})
    same = (out.tenant_id == F.col("_tenant_id")) & (out.device_key == F.col("_device_key")) & (out.window_start_ts == F.col("_ws")) & out.source_path.eqNullSafe(F.col("_source_path")) & has_lines
    out = out.join(spans, same, "left").drop(*[f"_{c}" for c in (*of, "source_path")])
    return out.withColumn("provenance", F.coalesce("provenance", F.array().cast(spans.schema["provenance"].dataType)))
