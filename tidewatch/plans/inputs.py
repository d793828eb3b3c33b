"""The supplied tables as log lines of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3600


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_seconds():
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines of `events`: two tenants, event types as devices, features and entities straight from the columns."""
    return lines_of(events(spark, sf_dir))


def lines_of(found: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    user = F.concat(F.lit("u"), F.col("user_id"))
    return found.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("t"), F.pmod("user_id", F.lit(2))).alias("tenant_id"),
        F.col("event_type").alias("device_key"),
        event_seconds().alias("ts"),
        (F.length("props") + F.length("event_type")).cast("long").alias("byte_len"),
        F.array(F.concat(F.lit("w="), F.col("event_type")), F.concat(F.lit("User="), user), F.lit("k=k"), F.lit("canon=User"), F.concat(F.lit("SourceIp_net@10.0."), k, F.lit(".0/24"))).alias("features"),
        F.array(F.struct(F.lit("UserId").alias("kind"), user.alias("value")), F.struct(F.lit("SourceIp").alias("kind"), F.concat(F.lit("10.0."), k, F.lit(".1")).alias("value"))).alias("entities"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event rendered as a log line, in one of five formats by event_id."""
    t = event_seconds()
    iso = F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bsd = F.date_format(F.timestamp_seconds(t), "MMM d HH:mm:ss")
    k = F.get_json_object("props", "$.k")
    s = lambda c: F.col(c).cast("string")
    host = F.concat(F.lit("host"), F.pmod("user_id", F.lit(8)))
    pid = (F.lit(1000) + F.pmod("user_id", F.lit(50))).cast("string")
    ip = F.concat(F.lit("10."), F.pmod("user_id", F.lit(4)), F.lit("."), F.pmod("user_id", F.lit(250)), F.lit("."), F.lit(1) + F.pmod("event_id", F.lit(200)))
    amount = F.col("value").cast("long").cast("string")
    pairs = F.concat(F.lit("src_ip="), ip, F.lit(" user=u"), s("user_id"), F.lit(" action="), F.col("event_type"), F.lit(" bytes="), amount, F.lit(" path=/obj/"), k)
    rfc = F.concat(F.lit("<34>1 "), iso, F.lit(" "), host, F.lit(" "), F.col("event_type"), F.lit(" "), pid, F.lit(" ID"), F.pmod("event_id", F.lit(10000)), F.lit(" - "), pairs)
    json = F.concat(F.lit('{"src_ip":"'), ip, F.lit('","user":"u'), s("user_id"), F.lit('","action":"'), F.col("event_type"), F.lit('","n":{"bytes":'), amount, F.lit("}}"))
    cef = F.concat(F.lit("CEF:0|acme|gate|1.0|100|"), F.col("event_type"), F.lit("|5|src_ip="), ip, F.lit(" suser=u"), s("user_id"), F.lit(" msg=took "), amount, F.lit(" units"))
    old = F.concat(F.lit("<13>"), bsd, F.lit(" "), host, F.lit(" "), F.col("event_type"), F.lit("["), pid, F.lit("]: "), pairs)
    text = F.concat(iso, F.lit(" "), host, F.lit(" "), F.col("event_type"), F.lit(": user u"), s("user_id"), F.lit(" came from "), ip, F.lit(" today"))
    form = F.pmod("event_id", F.lit(5))
    line = F.when(form == 0, rfc).when(form == 1, F.concat(iso, F.lit(" "), json)).when(form == 2, cef).when(form == 3, old).otherwise(text)
    return events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.pmod("user_id", F.lit(2))).alias("tenant_id"), F.col("event_type").alias("device_key"), form.alias("form"), line.alias("line"))
