"""Alert rows, their ids, and list, search, show and export over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, timing
from ..sources.shared import settled

#: The entity kinds of filters and the arrays they look into.
ENTITY_FIELDS = {"srcip": "src_ips", "dstip": "dst_ips", "userid": "user_ids", "domain": "domains", "host": "hosts"}
ENTITY_KINDS = {"srcip": "SourceIp", "dstip": "DestIp", "userid": "UserId", "domain": "Domain", "host": "Host"}
CATEGORIES = ("outlier", "noise_suspect", "info")


def signature_text(top: Column) -> Column:
    return F.array_join(F.transform(top, lambda x: F.concat(x["feature"], F.lit("\t"), x["count"], F.lit("\n"))), "")


def reason_text(code: Column, details: Column) -> Column:
    return F.concat(code, F.lit("\n"), F.array_join(F.transform(details, lambda d: F.concat(d["k"], F.lit("\t"), d["v"], F.lit("\n"))), ""))


def row_alerts(labelled: DataFrame, size: int, debug: bool = False) -> DataFrame:
    """The alerts of labelled rows.  Ids are hashed for alerts only, after the label filter."""
    found = labelled.where(F.col("label").isNotNull())
    found = found.withColumn("signature", ids.stable_id_of(signature_text(F.col("top_features"))))
    text = F.concat_ws("\t", "tenant_id", "device_key", F.col("ws").cast("string"), "signature")
    entities = F.struct(*ENTITY_FIELDS.values())
    single = lambda c: F.col(c).cast("float")
    dropped = [(F.col(c) if c in labelled.columns else F.lit(0)).cast("long").alias(c) for c in ("dropped_features", "dropped_words", "dropped_shapes")]
    return found.select(
        F.lit(1).alias("schema_version"), ids.stable_id_of(text).alias("alert_id"), "tenant_id", "device_key", F.col("ws").alias("window_start_ts"), F.col("we").alias("window_end_ts"), F.lit(size).alias("window_size_s"), "bucket",
        "label", "confidence", "cold_start", single("total").alias("score_total"), single("rarity").alias("score_rarity"), single("drift").alias("score_drift"), single("volume").alias("score_volume"),
        F.when(F.lit(debug), F.col("n_bucket").cast("int")).alias("baseline_n_bucket"), F.when(F.lit(debug), single("centroid_norm")).alias("baseline_centroid_norm"),
        "reasons", "top_features", "summary_analyst", "summary_customer", entities.alias("entities"), "lines", "bytes", *dropped, "signature",
    )


def volume_alerts(found: DataFrame) -> DataFrame:
    """Ids and signatures for the rows of `volume_loss.silence_alerts` and `drop_alerts`."""
    details = F.col("reasons")[0]["details"]
    at = lambda k: F.get(F.filter(details, lambda d: d["k"] == k), F.lit(0))["v"]
    drop = at("drop_kind") == "sharp_drop"
    last = F.when(drop, "sharp_drop").when(F.col("subject_kind") == "source_stream", "hard_silence").otherwise(at("expected_windows_missed"))
    text = F.concat_ws("\t", "tenant_id", "subject_kind", "subject_key", F.col("window_start_ts").cast("string"), F.col("window_end_ts").cast("string"), F.lit("V_DROP"), last)
    return found.withColumns({"alert_id": ids.stable_id_of(text), "signature": ids.stable_id_of(reason_text(F.lit("V_DROP"), details))})


def with_volume(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Row alerts and, with empty features and entities, volume alerts; subject_kind is null for row alerts."""
    if found is None:
        return rows
    out = rows.unionByName(volume_alerts(found), allowMissingColumns=True)
    empty = {"schema_version": F.lit(1), "score_rarity": F.lit(0.0), "score_drift": F.lit(0.0), **{f"dropped_{c}": F.lit(0) for c in ("features", "words", "shapes")}, "top_features": F.array()}
    empty["entities"] = F.struct(*[F.array().alias(c) for c in ENTITY_FIELDS.values()])
    return out.withColumns({c: F.coalesce(c, v.cast(rows.schema[c].dataType)) for c, v in empty.items()})


def upsert(alerts: DataFrame, order: str = "window_end_ts") -> DataFrame:
    """One row an alert_id: the last."""
    w = Window.partitionBy("alert_id").orderBy(F.desc(order))
    return alerts.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def _kind(kind: str) -> str:
    if kind not in ENTITY_KINDS:
        raise ValueError(f"entity kind {kind!r}")
    return ENTITY_KINDS[kind]


def _of_rows(alerts: DataFrame) -> DataFrame:
    """Alerts of rows: those of lost volume have no lines, so no entities."""
    return alerts.where("subject_kind IS NULL") if "subject_kind" in alerts.columns else alerts


def has_entity(kind: str, value: str) -> Column:
    _kind(kind)
    return F.exists(F.col("entities")[ENTITY_FIELDS[kind]], lambda e: e["value"] == value)


def select_alerts(alerts: DataFrame, since: int | None = None, until: int | None = None, category: str | None = None, entity: tuple[str, str] | None = None, every: DataFrame | None = None) -> DataFrame:
    """since <= window start < until; newest first, then by id.

    every: the entities of windows as of `windows.every_entity`.  With them an entity is found that a row doesn't keep, since it
    keeps the most frequent alone.
    """
    if category is not None and category not in CATEGORIES:
        raise ValueError(f"category {category!r}")
    out = alerts
    if since is not None:
        out = out.where(F.col("window_start_ts") >= since)
    if until is not None:
        out = out.where(F.col("window_start_ts") < until)
    if category is not None:
        out = out.where(F.col("label") == category)
    if entity is not None and every is not None:
        kind, value = _kind(entity[0]), entity[1]
        at = every.where((F.col("kind") == kind) & (F.col("value") == value)).select("tenant_id", "device_key", F.col("ws").alias("window_start_ts")).distinct()
        out = _of_rows(out).join(at, ["tenant_id", "device_key", "window_start_ts"], "left_semi")
    elif entity is not None:
        out = out.where(has_entity(*entity))
    return out.orderBy(F.desc("window_start_ts"), "alert_id")


def search(alerts: DataFrame, contains: str, **filters) -> DataFrame:
    """Alerts whose ids, summaries, signature, reasons, top features or entities contain the text (A-Z in either case)."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    reasons = F.transform("reasons", lambda r: F.concat_ws("\n", r["code"], r["msg"], F.array_join(F.transform(r["details"], lambda d: F.concat_ws("\n", d["k"], d["v"])), "\n")))
    entities = F.flatten(F.array(*[F.transform(F.col("entities")[f], lambda e: e["value"]) for f in ENTITY_FIELDS.values()]))
    extra = [c for c in ("device_path",) if c in alerts.columns]
    text = F.concat_ws("\n", "alert_id", "tenant_id", "device_key", *extra, "summary_analyst", "summary_customer", "signature", reasons, F.transform("top_features", lambda x: x["feature"]), entities)
    return select_alerts(alerts, **filters).where(lower(text).contains("".join(c.lower() if c.isascii() else c for c in contains)))


def show(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("alert_id") == alert_id)


def export(alerts: DataFrame, path: str, gzip: bool = False, category: str | None = None, entity: tuple[str, str] | None = None, files: int | None = None) -> None:
    """Writes JSON lines, without time bounds; files: how many (else as many as partitions)."""
    out = select_alerts(alerts, category=category, entity=entity)
    if files:
        out = out.coalesce(files)
    out.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


#: Folders of a table that say where an alert_id or an entity is; Spark's readers of the table itself pass over them.
BY_ID, BY_ENTITY, SHARDS = "_by_id", "_by_entity", 256


def _shard(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SHARDS)).cast("int")


def write_table(alerts: DataFrame, path: str, every: DataFrame | None = None) -> None:
    """Appends alerts as Parquet by tenant and day, in order of their ids, with Bloom filters; and, in folders beside them, where each id
    and each entity is, dealt by digest and in order: a lookup reads one file of those and the days that it names.

    The places are written after the alerts, so what they name is there; a run that ends before is written again as a whole.
    every: the entities of windows as of `windows.every_entity`; with them those that no row keeps have places too.
    """
    rows = settled(alerts.withColumn("day", timing.utc_day(F.col("window_start_ts"))), "alerts")
    ordered = rows.repartitionByRange("tenant_id", "day", "alert_id").sortWithinPartitions("tenant_id", "day", "alert_id")
    ordered.write.mode("append").option("parquet.bloom.filter.enabled#alert_id", "true").partitionBy("tenant_id", "day").parquet(path)
    place = ["tenant_id", "day", "alert_id"]
    ids_ = rows.select(_shard(F.col("alert_id")).alias("shard"), *place).distinct()
    if every is None:
        one = lambda kind, f: F.transform(F.col("entities")[f], lambda e: F.struct(F.lit(kind).alias("kind"), e["value"].alias("value")))
        each = rows.select(*place, F.explode(F.flatten(F.array(*[one(k, f) for k, f in ENTITY_FIELDS.items()]))).alias("e")).select(*place, "e.*").distinct()
    else:
        name = F.coalesce(*[F.when(F.col("kind") == v, k) for k, v in ENTITY_KINDS.items()])
        found = every.select("tenant_id", "device_key", F.col("ws").alias("window_start_ts"), name.alias("kind"), "value").where("kind IS NOT NULL").distinct()
        own = _of_rows(rows).select("device_key", "window_start_ts", *place).distinct()
        each = found.join(own, ["tenant_id", "device_key", "window_start_ts"]).select(*place, "kind", "value")
    each = each.select(_shard(F.col("kind"), F.col("value")).alias("shard"), "kind", "value", *place)
    for found, folder, order, bloom in ((ids_, BY_ID, ["alert_id"], "alert_id"), (each, BY_ENTITY, ["kind", "value"], "value")):
        found = found.repartition("shard").sortWithinPartitions("shard", *order)
        found.write.mode("append").option(f"parquet.bloom.filter.enabled#{bloom}", "true").partitionBy("shard").parquet(f"{path}/{folder}")


def find(spark: SparkSession, path: str, alert_id: str) -> DataFrame:
    """The alert of this id in a table of write_table: its place is looked up, then that day of that tenant alone is read."""
    table = spark.read.parquet(path)
    if not _indexed(spark, path):
        return show(table, alert_id)
    places = spark.read.parquet(f"{path}/{BY_ID}").where((F.col("shard") == _shard(F.lit(alert_id))) & (F.col("alert_id") == alert_id))
    # an id is of one tenant and window; written again it has the same place
    at = F.lit(False)
    for r in places.select("tenant_id", "day").distinct().collect():
        at = at | ((F.col("tenant_id") == r["tenant_id"]) & (F.col("day") == r["day"]))
    return show(table.where(at), alert_id)


def find_entity(spark: SparkSession, path: str, kind: str, value: str, **filters) -> DataFrame:
    """As select_alerts with an entity, of a table of write_table: only days that have alerts with it are read."""
    table = spark.read.parquet(path)
    if not _indexed(spark, path):
        return select_alerts(table, entity=(kind, value), **filters)
    if kind not in ENTITY_FIELDS:
        raise ValueError(f"entity kind {kind!r}")
    places = spark.read.parquet(f"{path}/{BY_ENTITY}").where((F.col("shard") == _shard(F.lit(kind), F.lit(value))) & (F.col("kind") == kind) & (F.col("value") == value))
    hits = table.join(places.select("tenant_id", "day", "alert_id").distinct(), ["tenant_id", "day", "alert_id"], "left_semi")
    return select_alerts(hits.select(table.columns), **filters)


def _indexed(spark: SparkSession, path: str) -> bool:
    """Whether the table has places: one written otherwise is scanned."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{BY_ID}")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
