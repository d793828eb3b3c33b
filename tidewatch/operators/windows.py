"""Tumbling-window rows per (tenant, device): counts, features, entities and caps.

Input `lines`: tenant_id, device_key, ts, byte_len, features array<string>, entities array<struct<kind, value>>, and
a line order (seq) where caps are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import families, timing

KEY = ["tenant_id", "device_key", "ws"]
#: How many entities of each kind a row keeps.
ENTITY_CAPS = {"SourceIp": 64, "DestIp": 64, "UserId": 128, "Domain": 128, "Host": 128}
#: Distinct features of a row, by class and in all.
FEATURE_CAPS = {"Word": 20_000, "Shape": 20_000, "Syslog": 2_000, "all": 50_000}


def with_window(lines: DataFrame, size: int) -> DataFrame:
    """An undated line has time 0."""
    return lines.withColumn("ws", timing.window_start(F.coalesce("ts", F.lit(0).cast("long")), size))


def rows(lines: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """tenant_id, device_key, ws, we, bucket, lines, bytes: one row a window; partial and final hash aggregation.

    parts: for lines most of which have a window of their own, which are no fewer once a task has counted its own: they are dealt
    by device into so many parts first, so a task's table doesn't grow with the input where the parts do, and what follows by device
    needs no further shuffle.  A device with very many lines has no more windows than its time has.
    """
    found = with_window(lines, size)
    if parts:
        found = found.select(*KEY, "byte_len").repartition(parts, "tenant_id", "device_key")
    got = found.groupBy(*KEY).agg(F.count("*").alias("lines"), F.sum("byte_len").cast("long").alias("bytes"))
    return got.select(*KEY, (F.col("ws") + size).alias("we"), timing.time_bucket(F.col("ws")).alias("bucket"), "lines", "bytes")


def row_features(lines: DataFrame, size: int) -> DataFrame:
    """tenant_id, device_key, ws, feature, n: the sparse rows in long form."""
    each = with_window(lines, size).select(*KEY, F.explode_outer("features").alias("feature")).where("feature IS NOT NULL")
    return each.groupBy(*KEY, "feature").agg(F.count("*").alias("n")).withColumn("n", F.least("n", F.lit(4_294_967_295)))


def capped(lines: DataFrame, size: int, caps: dict[str, int] = FEATURE_CAPS) -> tuple[DataFrame, DataFrame]:
    """(row features admitted, drop counters per row).

    Features are admitted first come, first served: by line, then family and text inside a line.  One admitted before
    a cap was reached keeps counting.  Admission over all classes depends on admission by class, so the class ranks
    come first and the total ranks only what they let through.
    """
    each = with_window(lines, size).select(*KEY, "seq", F.explode("features").alias("feature"))
    return _admitted(each.groupBy(*KEY, "feature").agg(F.count("*").alias("n"), F.min("seq").alias("seq")), caps)


def _admitted(found: DataFrame, caps: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """As capped, of row features with n and seq, the place of their first line."""
    fam = families.family(F.col("feature"))
    found = found.withColumns({"class": families.cap_class(F.col("feature")), "place": F.struct("seq", families.family_order(fam).alias("o"), "feature")})
    by_class = Window.partitionBy(*KEY, "class").orderBy("place")
    limit = F.lit(None).cast("int")
    for name in ("Word", "Shape", "Syslog"):
        limit = F.coalesce(F.when(F.col("class") == name, caps[name]), limit)
    found = found.withColumn("fits", F.coalesce(F.row_number().over(by_class) <= limit, F.lit(True)))
    in_all = Window.partitionBy(*KEY, "fits").orderBy("place")
    found = found.withColumn("kept", F.col("fits") & (F.row_number().over(in_all) <= caps["all"]))
    counter = families.drop_counter(F.col("feature"))
    drops = found.groupBy(*KEY).agg(*[F.coalesce(F.sum(F.when(~F.col("kept") & (counter == c), F.col("n"))), F.lit(0)).alias(f"dropped_{c}") for c in ("features", "words", "shapes")])
    return found.where("kept").select(*KEY, "feature", "n"), drops


def top_entities(lines: DataFrame, size: int, caps: dict[str, int] = ENTITY_CAPS) -> DataFrame:
    """tenant_id, device_key, ws, kind, value, n, rank: the most frequent entities of each kind (ties by value)."""
    each = with_window(lines, size).select(*KEY, F.explode_outer("entities").alias("e")).select(*KEY, "e.kind", "e.value")
    return ranked(each.groupBy(*KEY, "kind", "value").agg(F.count("*").alias("n")), caps)


def every_entity(lines: DataFrame, size: int) -> DataFrame:
    """KEY, kind, value of the entities of all lines, those too that a row doesn't keep; as often as lines have them."""
    each = with_window(lines, size).select(*KEY, F.explode_outer("entities").alias("e"))
    return each.select(*KEY, "e.kind", "e.value").where("kind IS NOT NULL")


def ranked(counted: DataFrame, caps: dict[str, int] = ENTITY_CAPS) -> DataFrame:
    counted = counted.where(F.col("kind").isin(*caps))
    order = Window.partitionBy(*KEY, "kind").orderBy(F.desc("n"), "value")
    most = F.create_map(*[F.lit(x) for k, v in caps.items() for x in (k, v)])
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most[F.col("kind")])


def _items(events: DataFrame, *order: str) -> DataFrame:
    """Windowed event rows with one row a feature (kind 'feature') or entity."""
    one = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    both = F.concat(F.transform("features", lambda f: one(F.lit("feature"), f)), F.transform("entities", lambda e: one(e["kind"], e["value"])))
    return events.select(*KEY, *order, F.explode_outer(both).alias("x")).select(*KEY, *order, "x.kind", "x.value").where("kind IS NOT NULL")


def items(events: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(row features, entity counts) of event rows from one aggregation: what parsing gave is counted once for both."""
    counted = _items(with_window(events, size)).groupBy(*KEY, "kind", "value").agg(F.count("*").alias("n"))
    features = counted.where("kind = 'feature'").select(*KEY, F.col("value").alias("feature"), F.least("n", F.lit(4_294_967_295)).alias("n"))
    return features, counted.where("kind <> 'feature'")


def ordered_items(events: DataFrame, size: int) -> DataFrame:
    """KEY, kind, value, n, seq (the first line) of the features (kind 'feature') and entities of event rows."""
    return _items(with_window(events, size), "seq").groupBy(*KEY, "kind", "value").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))


def capped_items(counted: DataFrame, caps: dict[str, int] = FEATURE_CAPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row features admitted, drop counters per row, entity counts) of ordered_items."""
    kept, drops = _admitted(counted.where("kind = 'feature'").select(*KEY, F.col("value").alias("feature"), "n", "seq"), caps)
    return kept.withColumn("n", F.least("n", F.lit(4_294_967_295))), drops, counted.where("kind <> 'feature'").drop("seq")


def entities_wide(top: DataFrame) -> DataFrame:
    """One row a window: src_ips, dst_ips, user_ids, domains, hosts as arrays of (value, count)."""
    names = {"SourceIp": "src_ips", "DestIp": "dst_ips", "UserId": "user_ids", "Domain": "domains", "Host": "hosts"}
    item = F.struct("rank", "value", F.col("n").alias("count"))
    agg = [F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, item))), lambda x: F.struct(x["value"].alias("value"), x["count"].alias("count"))).alias(v) for k, v in names.items()]
    return top.groupBy(*KEY).agg(*agg)


def undated(lines: DataFrame) -> DataFrame:
    """How many lines of each device had no time."""
    return lines.groupBy("tenant_id", "device_key").agg(F.count_if(F.col("ts").isNull()).alias("undated"))
