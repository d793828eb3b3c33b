"""Queries over the supplied tables, each with independent SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import families, timing
from ..operators import baselines, scoring, state, volume_loss, windows
from ..sources.shared import parts_of, settled, shared_dir, spread
from . import inputs
from .inputs import SIZE

KEY = windows.KEY
#: Test thresholds: the supplied hours have few lines.
LOW = scoring.Thresholds(min_lines=1, outlier=0.75, noise=0.5, info=0.5)
SILENCE = volume_loss.SilenceGates(min_mature=5, min_missed=3, min_lines=10)
DROP = volume_loss.DropGates(min_maturity=3, min_expected=2.0, min_absolute=1.0, max_ratio=0.6, min_drop=0.4, stddevs=0.5)
EVAL_TS = 1_706_745_600  # 2024-02-01


def _base(spark: SparkSession, sf_dir: str):
    lines = inputs.event_lines(spark, sf_dir)
    return lines, windows.rows(lines, SIZE), windows.row_features(lines, SIZE)


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def window_rows(spark, sf_dir):
    return _base(spark, sf_dir)[1]


def row_features(spark, sf_dir):
    found = _base(spark, sf_dir)[2]
    f = F.col("feature")
    return found.select(*KEY, "feature", "n", families.family(f).alias("family"), families.weight(f).cast("double").alias("weight"))


def entity_topk(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir)
    return windows.top_entities(lines, 86_400, {"SourceIp": 3, "UserId": 5}).select(*KEY, "kind", "value", "n", F.col("rank").cast("long").alias("rank"))


def feature_caps(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir)
    kept, drops = windows.capped(lines, 86_400, {"Word": 1, "Shape": 6, "Syslog": 1, "all": 12})
    got = kept.groupBy(*KEY).agg(F.count("*").alias("features"), F.sum("n").alias("uses"))
    return got.join(drops, KEY).select(*KEY, "features", "uses", "dropped_features", "dropped_words", "dropped_shapes")


def df_ring(spark, sf_dir):
    _, rows, found = _base(spark, sf_dir)
    return baselines.with_ring(rows, found)[1].select(*KEY, "feature", "df")


def df_ring_windows(spark, sf_dir):
    _, rows, found = _base(spark, sf_dir)
    return baselines.with_ring(rows, found)[0].select(*KEY, "n_bucket")


def rarity(spark, sf_dir):
    _, rows, found = _base(spark, sf_dir)
    seen = baselines.seen_features(found, baselines.placed(rows))
    tf = baselines.weighted(F.col("feature"), F.col("n")).cast("double")
    mass = seen.groupBy(*KEY).agg(F.max("n_bucket").alias("n_bucket"), (F.sum(tf * scoring.idf(F.col("n_bucket"), F.col("df"))) / F.sum(tf)).alias("m"))
    return mass.select(*KEY, "n_bucket", F.round(1 - F.exp(-F.col("m")), 6).alias("rarity"))


def _scored(spark, sf_dir):
    lines, rows, found = _base(spark, sf_dir)
    return lines, *scoring.scored(rows, found, SIZE, LOW)


def scores(spark, sf_dir):
    _, got, _ = _scored(spark, sf_dir)
    return _round(got.select(*KEY, "rarity", "drift", "volume", "total", "cold_start", "centroid_norm"), "rarity", "drift", "volume", "total", "centroid_norm", digits=5)


def resumed_scores(spark, sf_dir):
    """The events in two runs, cut at a window in the middle of a day; the second goes on from the tables that the first left."""
    _, rows, found = _base(spark, sf_dir)
    cut = int(rows.agg((F.min("ws") + (F.max("ws") - F.min("ws")) / 2).alias("x")).first()[0] or 0) // SIZE * SIZE
    first, second = F.col("ws") < cut, F.col("ws") >= cut
    got, seen = scoring.scored(rows.where(first), found.where(first), SIZE, LOW, carry=True)
    got, seen = settled(got, "scores"), settled(seen, "seen")
    path = f"{shared_dir(spark).rstrip('/')}/baselines-{uuid.uuid4().hex}"
    state.save(state.advanced(state.empty(spark), got, seen), path)
    later, _ = scoring.scored(rows.where(second), found.where(second), SIZE, LOW, past=state.load(spark, path))
    both = got.select(later.columns).unionByName(later)
    return _round(both.select(*KEY, "stats_n", "rarity", "drift", "volume", "total", "cold_start", "centroid_norm"), "rarity", "drift", "volume", "total", "centroid_norm", digits=5)


def baseline_groups(spark, sf_dir):
    """What three runs over thirds of the days leave of each device and bucket: counts and moments, the centroid's norm, how many features it has."""
    _, rows, found = _base(spark, sf_dir)
    day = F.floor(F.col("ws") / timing.DAY)
    past = None
    for k in range(3):
        own = F.pmod(F.floor(day / 10), F.lit(3)) == k  # tens of days: runs need not follow one another in time
        got, seen = scoring.scored(rows.where(own), found.where(own), SIZE, LOW, past=past, carry=True)
        got, seen = settled(got, "scores"), settled(seen, "seen")
        path = f"{shared_dir(spark).rstrip('/')}/baselines-{uuid.uuid4().hex}"
        state.save(state.advanced(past or state.empty(spark), got, seen), path)
        past = state.load(spark, path)
    return _round(past.groups.select("tenant_id", "device_key", "bucket", "n", "last_ws", "lines_mean", "lines_m2", "bytes_mean", "bytes_m2"), "lines_mean", "lines_m2", "bytes_mean", "bytes_m2", digits=4)


def drift(spark, sf_dir):
    _, rows, found = _base(spark, sf_dir)
    got, seen = baselines.with_centroid(rows, found.join(rows.select(*KEY, "bucket"), KEY))
    return _round(got.select(*KEY, "dot", "row_norm2", "centroid_norm2"), "dot", "row_norm2", "centroid_norm2", digits=5)


def volume_stats(spark, sf_dir):
    got = baselines.with_stats(_base(spark, sf_dir)[1])
    return _round(got.select(*KEY, "stats_n", "lines_mean", "lines_var", "bytes_mean", "bytes_var"), "lines_mean", "lines_var", "bytes_mean", "bytes_var")


def final_stats(spark, sf_dir):
    got = baselines.final_stats(_base(spark, sf_dir)[1])
    return _round(got, "lines_mean", "lines_m2", "bytes_mean", "bytes_m2", digits=4)


def _labelled(spark, sf_dir):
    lines, got, seen = _scored(spark, sf_dir)
    return scoring.labelled(got, seen, windows.entities_wide(windows.top_entities(lines, SIZE)), LOW)


def row_alerts(spark, sf_dir):
    got = _labelled(spark, sf_dir).where("label IS NOT NULL")
    codes = F.array_join(F.transform("reasons", lambda r: r["code"]), ",")
    return got.select(*KEY, "label", "confidence", "entity_focus", "cold_start", codes.alias("reasons"), "lines", "bytes")


def top_features(spark, sf_dir):
    _, got, seen = _scored(spark, sf_dir)
    top = scoring.top_features(seen, 3)
    return _round(top.select(*KEY, F.col("rank").cast("long").alias("rank"), "n", "df", "contrib"), "contrib", digits=4)


def alert_filter(spark, sf_dir):
    """Alerts of two weeks with a line of one user, whatever a row keeps of its entities, newest first."""
    from ..operators import alerts

    every = windows.every_entity(inputs.event_lines(spark, sf_dir), SIZE)
    found = alerts.select_alerts(_alerts(spark, sf_dir), since=1_704_672_000, until=1_705_881_600, entity=("userid", "u7"), every=every)
    return found.select("tenant_id", "device_key", "window_start_ts", "label")


def alert_search(spark, sf_dir):
    from ..operators import alerts

    found = alerts.search(_alerts(spark, sf_dir), "USER=U1")
    return found.groupBy("tenant_id", "device_key", "label").agg(F.count("*").alias("n"))


def _alerts(spark, sf_dir):
    from ..operators import alerts

    return alerts.row_alerts(_labelled(spark, sf_dir), SIZE)


def alert_counts(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy("tenant_id", "label", "confidence").agg(F.count("*").alias("n"), F.countDistinct("alert_id").alias("ids"))


def expected_sources(spark, sf_dir):
    rows = _base(spark, sf_dir)[1]
    both = [volume_loss.expected_state(rows, k, SIZE, 2) for k in (volume_loss.DEVICE, volume_loss.TENANT)]
    return both[0].unionByName(both[1])


def hard_silence(spark, sf_dir):
    got = volume_loss.evaluate_silence(expected_sources(spark, sf_dir), F.lit(EVAL_TS), SILENCE)
    return got.select("subject_kind", "tenant_id", "subject_key", "suppression", "missed", "expected_lines", "window_start_ts", "window_end_ts")


def _volumes(spark, sf_dir):
    return volume_loss.expected_volume(_base(spark, sf_dir)[1])


def sharp_drop(spark, sf_dir):
    got = volume_loss.evaluate_drop(_volumes(spark, sf_dir), DROP)
    return _round(got.select(*KEY, "suppression", "ratio", "drop_ratio", "absolute_drop", "z_drop"), "ratio", "drop_ratio", "absolute_drop", "z_drop", digits=5)


def tenant_sharp_drop(spark, sf_dir):
    got = volume_loss.evaluate_drop(volume_loss.tenant_windows(_volumes(spark, sf_dir), DROP), volume_loss.DropGates(**{**DROP.__dict__, "min_maturity": 2}))
    return _round(got.select("tenant_id", "ws", "maturity", "lines", "mean_lines", "sd_lines", "suppression", "drop_ratio"), "mean_lines", "sd_lines", "drop_ratio", digits=5)


def open_drops(spark, sf_dir):
    got = volume_loss.emitted_drops(volume_loss.evaluate_drop(_volumes(spark, sf_dir), DROP), ["tenant_id", "device_key"])
    return got.select(*KEY, "lines")


def drop_diagnostics(spark, sf_dir):
    silences = volume_loss.evaluate_silence(expected_sources(spark, sf_dir), F.lit(EVAL_TS), SILENCE)
    return volume_loss.diagnostics(silences, volume_loss.evaluate_drop(_volumes(spark, sf_dir), DROP))


def supplier_volume(spark, sf_dir):
    """Day windows of lineitem: tenants by return flag, devices by supplier."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = items.select(F.col("l_returnflag").alias("tenant_id"), F.col("l_suppkey").cast("string").alias("device_key"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.col("l_quantity").cast("long").alias("byte_len"))
    rows = windows.rows(lines, timing.DAY, parts_of(items))  # nearly every line is the only one of its supplier and day
    state = volume_loss.expected_state(rows, volume_loss.DEVICE, timing.DAY, 1)
    got = volume_loss.evaluate_silence(state, F.lit(915_148_800), volume_loss.SilenceGates(10, 30, 20))
    return got.select("tenant_id", "subject_key", "observed_windows", "last_we", "last_lines", "suppression", "missed", "expected_lines")


def envelope(spark, sf_dir):
    from ..functions.envelope import with_envelope

    return with_envelope(spread(inputs.raw_lines(spark, sf_dir)), 1_706_745_600).select("seq", "p.pri", "p.version", "p.ts", "p.host", "p.app", "p.procid", "p.msgid", "p.msg")


def tokens(spark, sf_dir):
    from ..functions.envelope import with_envelope
    from ..functions.tokens import tokenize

    lines = with_envelope(spread(inputs.raw_lines(spark, sf_dir)), 1_706_745_600)
    got = lines.select("seq", F.explode(tokenize(F.col("p.msg"))).alias("e")).select("seq", "e.kind", "e.key", "e.value")
    return got.groupBy("kind", "key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


def parsed_features(spark, sf_dir):
    """Features of rendered lines, told from their text."""
    from . import analyze

    lines = analyze.parsed(inputs.raw_lines(spark, sf_dir).withColumn("byte_len", F.length("line").cast("long")), ingest_ts=1_706_745_600)
    return windows.row_features(lines, SIZE)


def parsed_entities(spark, sf_dir):
    from . import analyze

    lines = analyze.parsed(inputs.raw_lines(spark, sf_dir).withColumn("byte_len", F.length("line").cast("long")), ingest_ts=1_706_745_600)
    return windows.top_entities(lines, SIZE).select(*KEY, "kind", "value", "n")


def document_words(spark, sf_dir):
    """Word features of documents (tenant: language, device: source)."""
    from ..functions.features import word_feature
    from ..functions.tokens import whole_words

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # words are counted as they stand, then features are made of the distinct ones; outer: see `emitted`
    each = docs.select(F.col("lang").alias("tenant_id"), F.explode_outer(whole_words(F.col("text"))).alias("word")).where("word IS NOT NULL")
    counted = each.groupBy("tenant_id", "word").agg(F.count("*").alias("n")).withColumn("feature", word_feature(F.col("word")))
    return counted.where("feature IS NOT NULL").groupBy("tenant_id", "feature").agg(F.sum("n").alias("n"))


def feature_dictionary(spark, sf_dir):
    from ..operators.dictionary import dictionary

    return dictionary(inputs.event_lines(spark, sf_dir)).select("tenant_id", "feature", "feature_id")


def stream_windows(spark, sf_dir):
    """Source streams: the paths of lines inside devices."""
    lines = inputs.event_lines(spark, sf_dir).withColumn("source_path", volume_loss.canonical_path(F.concat(F.lit("logs\\"), F.pmod("seq", F.lit(3)), F.lit(".log"))))
    lines = lines.withColumn("source_stream_id", F.concat_ws("/", "tenant_id", "device_key", "source_path"))
    got = volume_loss.stream_catalog(volume_loss.stream_rows(lines, SIZE))
    return got.drop("source_stream_id")


QUERIES = {
    f.__name__: f
    for f in (
        rarity, window_rows, row_features, entity_topk, feature_caps, df_ring, df_ring_windows, drift, scores, resumed_scores, baseline_groups, volume_stats, final_stats, row_alerts, top_features, alert_filter, alert_search, alert_counts, expected_sources,
        hard_silence, sharp_drop, tenant_sharp_drop, open_drops, drop_diagnostics, supplier_volume, envelope, tokens, parsed_features, parsed_entities, document_words, feature_dictionary, stream_windows,
    )
}


def queries() -> dict:
    from .rule_queries import QUERIES as RULES

    return QUERIES | RULES


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL
    from .rule_oracle import SQL as RULES

    return SQL | RULES
