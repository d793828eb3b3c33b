"""Feature dictionary: ids per tenant in first-seen order, from 1.  Ids are for presentation; plans join on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.families import family, family_order

MOST = 2_000_000


def dictionary(lines: DataFrame, known: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """tenant_id, feature, feature_id.  Features of `known` keep their ids, new ones follow until the tenant has `most`; later ones get none.

    Distinct features come first, so a tenant's sort holds its vocabulary, not its lines.
    """
    each = lines.select("tenant_id", "seq", F.explode("features").alias("feature"))
    first = each.groupBy("tenant_id", "feature").agg(F.min("seq").alias("seq"))
    last = None
    if known is not None:
        first = first.join(known.select("tenant_id", "feature"), ["tenant_id", "feature"], "left_anti")
        last = known.groupBy("tenant_id").agg(F.max("feature_id").alias("last"))
    order = Window.partitionBy("tenant_id").orderBy("seq", family_order(family(F.col("feature"))), "feature")
    got = first.withColumn("k", F.row_number().over(order).cast("long"))
    if last is not None:
        got = got.join(F.broadcast(last), "tenant_id", "left").withColumn("k", F.col("k") + F.coalesce("last", F.lit(0)))
    got = got.where(F.col("k") <= most).select("tenant_id", "feature", F.col("k").alias("feature_id"))
    return got if known is None else known.select("tenant_id", "feature", "feature_id").unionByName(got)


def faults(entries: DataFrame, most: int = MOST) -> DataFrame:
    """tenant_id, fault of dictionaries that are no bijection, have ids under 1 or gaps, or are too large."""
    per = entries.groupBy("tenant_id").agg(F.count("*").alias("n"), F.countDistinct("feature").alias("f"), F.countDistinct("feature_id").alias("i"), F.min("feature_id").alias("low"), F.max("feature_id").alias("high"))
    fault = F.when(F.col("f") != F.col("n"), "a feature has two ids").when(F.col("i") != F.col("n"), "an id has two features").when((F.col("low") != 1) | (F.col("high") != F.col("n")), "ids are not 1..n").when(F.col("n") > most, "full")
    return per.select("tenant_id", fault.alias("fault")).where("fault IS NOT NULL")
