"""Lookups in a table of alerts read the files that they need, and find what a scan finds."""

from pyspark.sql import functions as F

from tidewatch.operators import alerts
from tidewatch.plans import registry

from .conftest import SF


def files_read(df):
    """How many files the scan of a collected frame has read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_lookups(spark, tmp_path):
    found, path = registry._alerts(spark, SF).cache(), str(tmp_path / "t")
    first = found.where("window_start_ts < 1705300000")
    alerts.write_table(first, path)
    alerts.write_table(found.where("window_start_ts >= 1705300000"), path)
    table = spark.read.parquet(path)
    assert table.count() == found.count() and "shard" not in table.columns
    days = table.select("tenant_id", "day").distinct().count()
    one = found.orderBy("window_start_ts", "alert_id").first()
    got = alerts.find(spark, path, one.alert_id)
    assert [r.alert_id for r in got.collect()] == [one.alert_id] and files_read(got) <= 2 < days
    assert alerts.find(spark, path, "no such id").count() == 0
    for kind, value in (("userid", "u7"), ("srcip", "10.0.3.1"), ("userid", "nobody")):
        want = [r.alert_id for r in alerts.select_alerts(found, entity=(kind, value)).collect()]
        assert [r.alert_id for r in alerts.find_entity(spark, path, kind, value).collect()] == want
    week = [r.alert_id for r in alerts.select_alerts(found, since=1_704_672_000, entity=("userid", "u7")).collect()]
    assert [r.alert_id for r in alerts.find_entity(spark, path, "userid", "u7", since=1_704_672_000).collect()] == week
    plain = str(tmp_path / "plain")  # a table of another writer has no places
    found.withColumn("day", F.lit("x")).write.parquet(plain)
    assert alerts.find(spark, plain, one.alert_id).count() == 1 and len(alerts.find_entity(spark, plain, "userid", "u7").collect()) == alerts.select_alerts(found, entity=("userid", "u7")).count()
