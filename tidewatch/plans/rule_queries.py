"""Queries over rules that ordinary lines seldom meet, each with its SQL: lines are rendered from the supplied tables, and the SQL
says what was put into them, or states the rule by brute force."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timing
from ..functions.envelope import with_envelope
from ..functions.features import emitted
from ..functions.tokens import parse_counters, tokenize
from ..operators import alerts, baselines, provenance, scoring, volume_loss, windows
from ..sources import files
from ..sources.alert_files import write_alerts
from ..sources.shared import shared_dir, spread
from ..sources.tail import SCHEMA, tail
from ..streaming.scoring import stream_scores
from ..streaming.silences import stream_silences
from ..streaming.windows import idle_rows, keyed_state, run_once, run_until_idle, stream_rows, to_table
from . import inputs
from .inputs import SIZE
from .registry import EVAL_TS, KEY, LOW, _alerts, _labelled, _round

INGEST = 1_706_745_600


def _said(spark, sf_dir) -> DataFrame:
    """seq, tenant_id, t and texts of events to render lines from."""
    t = inputs.event_seconds()
    stamp = F.timestamp_seconds(t)
    return spread(inputs.events(spark, sf_dir)).select(
        F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.pmod("user_id", F.lit(2))).alias("tenant_id"), t.alias("t"), F.col("event_id").cast("string").alias("s"),
        F.concat(F.lit("u"), F.col("user_id")).alias("usr"), F.pmod("user_id", F.lit(9)).cast("string").alias("d"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(stamp, "MMM d HH:mm:ss").alias("bsd"),
    )


def _form(n: int, *texts):
    form = F.pmod("seq", F.lit(n))
    out = F.lit(None).cast("string")
    for i, parts in enumerate(texts):
        out = F.when(form == i, F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])).otherwise(out)
    return out


def envelope_formats(spark, sf_dir):
    """Offsets, fractions, naive times, structured data, vendor prefixes and no header."""
    line = _form(
        6, ["<165>1 ", "$iso", "+02:00 edge app ", "$d", ' - [a@1 x="y]z" n="', "$s", '"][b] sd text'], ["$iso", " host app: said ", "$s"], ["$iso", ".250Z app: fraction ", "$s"],
        ["<13>", "$bsd", " box fw: ", "$iso", "Z: %ASA-6-1: built ", "$s"], ["$bsd", " box fw: alpha: %X-1: two ", "$s"], ["no header ", "$s"],
    )
    got = with_envelope(_said(spark, sf_dir).withColumn("line", line), INGEST)
    return got.select("seq", "p.pri", "p.ts", "p.host", "p.app", "p.procid", "p.structured_data", "p.embedded_ts", F.array_join("p.peeled", ",").alias("peeled"), "p.msg")


def token_rules(spark, sf_dir):
    """Quotes, brackets, colons, nested JSON, escapes and broken headers."""
    msg = _form(
        6, ['k1="two words" c: [x (y)] tail-', "$s"], ['{"b":{"c":[1,true,{"z":1}]},"a":null,"s":"', "$usr", '"}'], ["CEF:0|v|p|1|9|n|5|src=1.2.3.4 msg=a b\\=", "$s"], ["CEF:0|broken ", "$usr"],
        ["see http://x/", "$usr", " then C:\\tmp 12:30 k=v"], ["a=1, b=x; c=(p q) d=", "$s", ")"],
    )
    each = _said(spark, sf_dir).select(F.explode(tokenize(msg)).alias("e"))
    return each.select("e.kind", "e.key", "e.value").groupBy("kind", "key", "value").agg(F.count("*").alias("n"))


def csv_tokens(spark, sf_dir):
    msg = F.concat("d", F.lit(',"'), "usr", F.lit(', x",'), "s")
    each = _said(spark, sf_dir).select(F.explode(tokenize(msg, ["Src IP", "user", "n"])).alias("e"))
    return each.select("e.kind", "e.key", "e.value").groupBy("kind", "key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


def token_caps(spark, sf_dir):
    """Lines of 60 to 69 pairs and up to 299 words."""
    c = F.col("c_custkey")
    pairs = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60) + F.pmod(c, F.lit(10))), lambda i: F.concat(F.lit("k"), i, F.lit("=v"))), " ")
    lines = spread(spark.read.parquet(f"{sf_dir}/customer.parquet")).select("c_custkey", F.concat(pairs, F.lit(" "), F.repeat(F.lit("ab "), F.pmod(c, F.lit(300)).cast("int"))).alias("msg"))
    made = lines.select("c_custkey", tokenize(F.col("msg")).alias("e"), parse_counters(F.col("msg")).alias("h"))
    of = lambda kind: F.size(F.filter("e", lambda x: x["kind"] == kind)).cast("long")
    return made.select("c_custkey", of("kv").alias("pairs"), of("word").alias("words"), "h.kv_cap", "h.token_cap", "h.word_cap")


def key_rules(spark, sf_dir):
    """Features (kind 'feature') and entities of keys and values of every category, in lines of one tenant."""
    msg = F.concat(
        F.lit("src_ip=2001:DB8::"), "d", F.lit(" sha256=ab dport=443 sport=70000 user=CORP\\Bob."), "d", F.lit(" acct=eve@Example.COM dst_host=Web-"), "d",
        F.lit(".local. url=https://x/y file=C:\\t\\x event_time=2024-01-05T13:00:01Z proc=sh cmd=ls src_to_dst_port=1 dest.address=10.0.0."), "d",
    )
    lines = _said(spark, sf_dir).select("tenant_id", tokenize(msg).alias("events"), F.lit(None).cast("long").alias("pri"), F.lit(None).cast("string").alias("app"), F.lit(None).cast("long").alias("version"))
    each = emitted(lines, counted=True)
    one = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    both = F.concat(F.transform("features", lambda f: one(F.lit("feature"), f)), F.transform("entities", lambda x: one(x["kind"], x["value"])))
    return each.select("tenant_id", "n", F.explode_outer(both).alias("x")).select("tenant_id", "n", "x.kind", "x.value").where("kind IS NOT NULL").groupBy("tenant_id", "kind", "value").agg(F.sum("n").alias("n"))


def _numbered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(rows, row features with feature_id: the place of the feature among its tenant's)."""
    lines = inputs.event_lines(spark, sf_dir)
    rows, found = windows.rows(lines, SIZE), windows.row_features(lines, SIZE)
    from pyspark.sql import Window

    ids = found.select("tenant_id", "feature").distinct().withColumn("feature_id", F.row_number().over(Window.partitionBy("tenant_id").orderBy("feature")).cast("long"))
    return rows, found.join(ids, ["tenant_id", "feature"])


def df_caps(spark, sf_dir):
    _, found = _numbered(spark, sf_dir)
    df = found.groupBy("tenant_id", timing.day_epoch(F.col("ws")).alias("day"), timing.time_bucket(F.col("ws")).alias("bucket"), "feature", "feature_id").agg(F.count("*").alias("df"))
    return baselines.capped_df(df, 4).select("tenant_id", "day", "bucket", "feature", "df")


def centroid_caps(spark, sf_dir):
    _, found = _numbered(spark, sf_dir)
    values = found.groupBy("tenant_id", "device_key", timing.time_bucket(F.col("ws")).alias("bucket"), "feature_id").agg(F.sum(F.when(F.pmod("feature_id", F.lit(2)) == 0, -F.col("n")).otherwise(F.col("n"))).alias("value"))
    return baselines.capped_centroid(values, 3).select("tenant_id", "device_key", "bucket", "feature_id", "value")


#: Labels of blobs alone: nothing is an outlier or worth telling.
NOISE = scoring.Thresholds(outlier=2.0, noise=0.0, info=2.0, blob_ratio=0.31, min_lines=2, cold_start_days=0)


def noise_labels(spark, sf_dir):
    lines = inputs.event_lines(spark, sf_dir)
    blob = F.when(F.pmod("seq", F.lit(3)) == 0, F.array(F.lit("Token=<UUID>"))).otherwise(F.array().cast("array<string>"))
    lines = lines.withColumns({"features": F.concat(F.array(F.concat(F.lit("w="), "device_key"), F.lit("k=k")), blob), "entities": F.array().cast("array<struct<kind:string,value:string>>")})
    got, seen = scoring.scored(windows.rows(lines, SIZE), windows.row_features(lines, SIZE), SIZE, NOISE)
    out = scoring.labelled(got, seen, windows.entities_wide(windows.top_entities(lines, SIZE)), NOISE)
    return _round(out.select(*KEY, "blob_ratio", "label", F.exists("reasons", lambda r: r["code"] == "N_HIGH_CARDINALITY").alias("noisy")), "blob_ratio", digits=5)


def signature_texts(spark, sf_dir):
    """What the signatures of alerts are hashed from, and the details of the first reason where it tells of new features."""
    got = _labelled(spark, sf_dir).where("label IS NOT NULL")
    first = F.get("reasons", F.lit(0))
    return got.select(*KEY, F.md5(alerts.signature_text(F.col("top_features"))).alias("signature_md5"), F.when(first["code"] == "R_NEW_FEATURE", alerts.reason_text(first["code"], first["details"])).alias("reason"))


def _offset_lines(spark, sf_dir) -> DataFrame:
    """Lines at offsets in two files a device, in order of seq."""
    from pyspark.sql import Window

    lines = inputs.event_lines(spark, sf_dir).select("seq", "tenant_id", "device_key", "ts", "byte_len", F.concat(F.lit("f"), F.pmod("seq", F.lit(2)), F.lit(".log")).alias("file_rel"), F.lit(False).alias("is_gzip"))
    end = F.sum("byte_len").over(Window.partitionBy("tenant_id", "device_key", "file_rel").orderBy("seq"))
    return windows.with_window(lines.withColumn("offset_end", end).withColumn("offset_start", F.col("offset_end") - F.col("byte_len")), SIZE)


def provenance_spans(spark, sf_dir):
    found = provenance.spans(_offset_lines(spark, sf_dir), KEY)
    return found.select(*KEY, F.posexplode("provenance").alias("k", "s")).select(*KEY, F.col("k").cast("long").alias("k"), "s.file_rel", "s.offset_start", "s.offset_end")


def span_lines(spark, sf_dir):
    """How many lines each window's spans give back."""
    lines = _offset_lines(spark, sf_dir)
    found = provenance.spans(lines, KEY)
    back = provenance.lines_in_spans(lines, found, KEY)
    return back.groupBy(*KEY).agg(F.count("*").alias("lines"), F.sum("byte_len").cast("long").alias("bytes"))


def _state(spark, sf_dir):
    rows = windows.rows(inputs.event_lines(spark, sf_dir), SIZE)
    return rows, volume_loss.expected_state(rows, volume_loss.DEVICE, SIZE, 2)


def silence_policy(spark, sf_dir):
    """Tenant t0 has its own gates but for the one that is null; t1 has none."""
    policy = spark.createDataFrame([("t0", 200, None, 4)], "tenant_id string, min_missed int, min_mature int, min_lines int")
    got = volume_loss.evaluate_silence(_state(spark, sf_dir)[1], F.lit(EVAL_TS), volume_loss.SilenceGates(min_mature=5, min_missed=3, min_lines=10), policy)
    return got.select("tenant_id", "subject_key", "suppression", "missed")


def silence_lifecycle(spark, sf_dir):
    """Devices judged 3, 4 and 5 hours after each window, if nothing came: the first of a spell opens it."""
    from pyspark.sql import Window

    rows = windows.rows(inputs.event_lines(spark, sf_dir), SIZE)
    later = F.lead("ws").over(Window.partitionBy("tenant_id", "device_key").orderBy("ws"))
    found = rows.withColumn("later", later).withColumn("eval_ts", F.explode(F.array(*[F.col("we") + k * SIZE for k in (3, 4, 5)]))).where("later IS NULL OR later >= eval_ts")
    found = found.select("tenant_id", "device_key", F.col("we").alias("window_start_ts"), "eval_ts")
    return volume_loss.silence_spells(rows, found, ["tenant_id", "device_key"])


def loss_alerts(spark, sf_dir):
    """Alert rows of silent and reduced devices; a silent one has no drop."""
    rows = windows.rows(inputs.event_lines(spark, sf_dir), SIZE)
    volume = volume_loss.Volume(tenant=False, gates=volume_loss.SilenceGates(min_mature=5, min_missed=3, min_lines=2))
    got = volume_loss.loss_alerts(rows.where("device_key <> 'click' OR ws < 1706000400"), SIZE, F.lit(1_706_745_600 - 7 * 86_400), volume, 2)
    kind = F.get(F.filter(F.get("reasons", F.lit(0))["details"], lambda d: d["k"] == "expected_windows_missed"), F.lit(0))["v"]
    return got.select("tenant_id", "subject_kind", "subject_key", "device_key", "window_start_ts", "window_end_ts", "label", "confidence", "lines", kind.alias("missed"))


def _streams(spark, sf_dir) -> DataFrame:
    lines = inputs.event_lines(spark, sf_dir).withColumn("source_path", F.concat(F.lit("logs/"), F.pmod("seq", F.lit(3)), F.lit(".log")))
    return volume_loss.stream_rows(lines.withColumn("source_stream_id", F.concat_ws("|", "tenant_id", "device_key", "source_path")), SIZE)


def stream_volume(spark, sf_dir):
    got = volume_loss.expected_volume(_streams(spark, sf_dir), "source_stream_id")
    return _round(got.select("tenant_id", "device_key", "source_path", "ws", "maturity", "mean_lines", "sd_lines"), "mean_lines", "sd_lines", digits=5)


def stream_silence(spark, sf_dir):
    """Silent source streams and what their alerts say of them."""
    streams = _streams(spark, sf_dir)
    named = volume_loss.stream_catalog(streams).select("tenant_id", F.col("source_stream_id").alias("subject_key"), "device_key", "source_path")
    judged = volume_loss.evaluate_silence(volume_loss.expected_state(streams, volume_loss.STREAM, SIZE, 1), F.lit(EVAL_TS), volume_loss.SilenceGates(5, 3, 3))
    made = volume_loss.silence_alerts(judged.where("suppression IS NULL").join(named, ["tenant_id", "subject_key"]))
    details = F.array_join(F.transform(F.slice(F.get("reasons", F.lit(0))["details"], 2, 5), lambda d: F.concat(d["k"], F.lit("="), d["v"])), ";")
    return made.select("tenant_id", "subject_kind", "device_key", "source_path", "window_start_ts", "window_end_ts", details.alias("details"))


def alert_category(spark, sf_dir):
    found = alerts.select_alerts(_alerts(spark, sf_dir), category="outlier")
    return found.select("tenant_id", "device_key", "window_start_ts", "label")


def alert_upsert(spark, sf_dir):
    """Orders as alerts of their customers that are written again and again: the last stands."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("alert_id"), F.struct("o_orderdate", "o_orderkey").alias("window_end_ts"), "o_orderkey")
    return alerts.upsert(orders).select("alert_id", "o_orderkey")


def alert_show(spark, sf_dir):
    """An alert looked up by its id: that of the first window of a tenant and device."""
    found = _alerts(spark, sf_dir).select("tenant_id", "device_key", "window_start_ts", "alert_id")
    row = found.orderBy("window_start_ts", "tenant_id", "device_key").first()
    return alerts.show(found, row["alert_id"] if row else "").drop("alert_id")


def alert_lookup(spark, sf_dir):
    """Alerts of a table, found by the places of ids and entities: the first one, and those of a user in two weeks."""
    path = f"{shared_dir(spark).rstrip('/')}/alerts-{uuid.uuid4().hex}"
    alerts.write_table(_alerts(spark, sf_dir), path, windows.every_entity(inputs.event_lines(spark, sf_dir), SIZE))
    row = spark.read.parquet(path).orderBy("window_start_ts", "tenant_id", "device_key").first()
    one = alerts.find(spark, path, row["alert_id"] if row else "")
    some = alerts.find_entity(spark, path, "userid", "u7", since=1_704_672_000, until=1_705_881_600)
    of = ["tenant_id", "device_key", "window_start_ts", "label"]
    return one.select(F.lit("id").alias("found_by"), *of).unionByName(some.select(F.lit("entity").alias("found_by"), *of))


def file_lines(spark, sf_dir):
    """Lines written as plain and gzip files of tenants and devices, found and read again."""
    root = f"{shared_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    lines = inputs.raw_lines(spark, sf_dir).select("tenant_id", "device_key", F.pmod("seq", F.lit(2)).alias("g"), "line")
    for tenant, device in [tuple(r) for r in lines.select("tenant_id", "device_key").distinct().collect()]:
        own = lines.where((F.col("tenant_id") == tenant) & (F.col("device_key") == device))
        for g, how in ((0, "none"), (1, "gzip")):
            own.where(F.col("g") == g).select("line").write.mode("append").option("compression", how).text(f"{root}/{tenant}/{device}")
    got = files.read_lines(spark, root)
    return got.groupBy("tenant_id", F.col("device_dir").alias("device_key"), "is_gzip").agg(
        F.count("*").alias("lines"), F.sum("byte_len").cast("long").alias("bytes"), F.min(F.col("offset_end") - F.col("offset_start") - F.when(F.col("is_gzip"), F.col("offset_end")).otherwise(F.col("byte_len"))).alias("least_gap")
    )


def _archives(batches, root: str):
    """Writes the lines of a partition as archives, one for each device, in chunks that end anywhere; what comes out are their names."""
    import os
    import struct
    import zlib

    import pandas as pd
    import zstandard

    name, known = uuid.uuid4().hex, {}
    for pdf in batches:
        for (tenant, device), own in pdf.groupby(["tenant_id", "device_key"]):
            path = f"{root}/{tenant}/{device}/{name}.zlg"
            data = "".join(x + "\n" for x in own.line).encode()
            first = path not in known
            known[path] = known.get(path, 0)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb" if first else "ab") as f:
                if first:
                    f.write(files.ZLG_MAGIC + struct.pack("<HH", 1, files.ZLG_HEADER) + bytes(20))
                for at in range(0, len(data), 5000):
                    plain = data[at : at + 5000]
                    packed = zstandard.ZstdCompressor().compress(plain)
                    head = struct.pack("<HHQQQQQIIQ", files.ZLG_CHUNK_HEADER, 0, known[path], 0, 0, len(plain), len(packed), 0, zlib.crc32(plain), 0)
                    f.write(files.ZLG_CHUNK + head + packed)
                    known[path] += 1
    for path, chunks in known.items():
        with open(path, "ab") as f:
            f.write(files.ZLG_DIRECTORY + struct.pack("<IQ", files.ZLG_ENTRY, chunks) + bytes(files.ZLG_ENTRY * chunks) + files.ZLG_FOOTER + struct.pack("<I", files.ZLG_FOOTER_SIZE) + bytes(files.ZLG_FOOTER_SIZE - 8))
        yield pd.DataFrame({"path": [path]})


def archived_lines(spark, sf_dir):
    """Lines written as chunked archives, read again in groups of chunks: lines that go on in the next chunk, and numbers of lines."""
    root = f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    lines = spread(inputs.raw_lines(spark, sf_dir)).select("tenant_id", "device_key", "line")
    folder = files.local(root)
    lines.mapInPandas(lambda batches: _archives(batches, folder), "path string").write.format("noop").mode("overwrite").save()
    got = files.read_lines(spark, root)
    each = got.groupBy("tenant_id", "device_dir", "file_rel").agg(F.count("*").alias("n"), F.sum("byte_len").alias("bytes"), (F.max("line_no") + 1).alias("last"))
    return each.groupBy("tenant_id", F.col("device_dir").alias("device_key")).agg(F.sum("n").alias("lines"), F.sum("bytes").cast("long").alias("bytes"), F.sum("last").alias("numbered"))


def tailed_lines(spark, sf_dir):
    """Lines of files read by a stream with cursors as offsets, that stops and goes on when there are more files."""
    folder = shared_dir(spark).rstrip("/")
    root, out, state = (f"{folder}/{n}-{uuid.uuid4().hex}" for n in ("tailed", "tailed-out", "tailed-state"))
    lines = inputs.raw_lines(spark, sf_dir).select("tenant_id", "device_key", F.pmod("seq", F.lit(2)).alias("g"), "line")
    places = [tuple(r) for r in lines.select("tenant_id", "device_key").distinct().collect()]
    spark.createDataFrame([], SCHEMA).write.parquet(out)
    for g, how in ((0, "none"), (1, "gzip")):
        for tenant, device in places:
            own = lines.where((F.col("tenant_id") == tenant) & (F.col("device_key") == device) & (F.col("g") == g))
            own.select("line").write.mode("append").option("compression", how).text(f"{root}/{tenant}/{device}")
        if places:
            query = tail(spark, root, range_bytes=1 << 20).writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(to_table(f"{out}/{g}")).start()
            query.awaitTermination()
    got = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(out)
    return got.groupBy("tenant_id", F.col("device_dir").alias("device_key"), "is_gzip").agg(F.count("*").alias("lines"), F.sum("byte_len").cast("long").alias("bytes"), F.count("error").alias("errors"))


def alert_files_rows(spark, sf_dir):
    """Alerts written as JSON lines of devices and days by the committing sink, read again by folder."""
    folder = shared_dir(spark).rstrip("/")
    root = f"{folder}/alert-files-{uuid.uuid4().hex}"
    write_alerts(_alerts(spark, sf_dir), root, f"{folder}/alert-spool-{uuid.uuid4().hex}", 1 << 20)
    got = spark.read.schema("alert_id string, tenant_id string, device_key string, window_start_ts long, label string").option("recursiveFileLookup", True).option("pathGlobFilter", "alerts_*.jsonl").json(root)
    got = got.withColumn("path", F.split(F.col("_metadata.file_path"), "/"))
    part = lambda i: F.element_at("path", F.lit(-i))
    placed = F.concat(part(4), part(3), part(2)) == F.date_format(F.timestamp_seconds("window_start_ts"), "yyyyMMdd")
    placed = placed & (part(5) == F.concat(F.lit("device="), "device_key")) & (part(6) == F.concat(F.lit("tenant="), "tenant_id"))
    return got.groupBy("tenant_id", "device_key", F.date_format(F.timestamp_seconds("window_start_ts"), "yyyyMMdd").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("alert_id").alias("ids"), F.bool_and(placed).alias("placed"))


def _cursor_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts as files, and cursors of most of them as they were before."""
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    of = [F.concat(F.lit("t"), k % 3).alias("tenant_id"), F.concat(F.lit("d"), k % 7).alias("device_dir"), F.concat(k.cast("string"), F.when(k % 5 == 0, ".zlg").otherwise(".log")).alias("file_rel")]
    now = p.select(*of, (k % 4 == 1).alias("is_gzip"), k.cast("long").alias("inode"), (F.col("p_size") * 10).cast("long").alias("size"))
    old = p.where(k % 6 != 0).select(*of, (k % 8 == 1).alias("is_gzip"), F.when(k % 11 == 0, k + 1).otherwise(k).cast("long").alias("inode"), (F.col("p_size") * 10 - F.when(k % 2 == 0, 5).otherwise(0)).cast("long").alias("size"), (F.col("p_size") * 10 - 5 + 10 * (k % 9 == 0).cast("int")).cast("long").alias("offset"))
    return now, old


def cursor_decisions(spark, sf_dir):
    """Where reading goes on."""
    got = files.reconcile(*_cursor_tables(spark, sf_dir))
    return got.select("file_rel", "reason", "offset")


def cursor_progress(spark, sf_dir):
    """Cursors after lines were read, some of them beyond what the file had when it was listed."""
    now, _ = _cursor_tables(spark, sf_dir)
    keys = ["tenant_id", "device_dir", "file_rel"]
    lines = now.where("inode % 3 > 0").select(*keys, F.explode(F.array(F.lit(3), F.lit(7), F.when(F.col("inode") % 5 == 1, F.col("size") + 1).otherwise(F.lit(5))).cast("array<long>")).alias("offset_end"))
    return files.advance(now, lines, 9).select("file_rel", "offset", F.col("last_read_ts").cast("long").alias("last_read_ts"))


def streamed_rows(spark, sf_dir):
    """Window rows of events read as a stream; the windows that the watermark has closed."""
    folder = shared_dir(spark).rstrip("/")
    out, seen = f"{folder}/stream-{uuid.uuid4().hex}", f"{folder}/state-{uuid.uuid4().hex}"
    source = spark.readStream.schema(inputs.events(spark, sf_dir).schema).parquet(f"{sf_dir}/event[s].parquet")
    lines = source.select(F.concat(F.lit("t"), F.pmod("user_id", F.lit(2))).alias("tenant_id"), F.col("event_type").alias("device_key"), inputs.event_seconds().alias("ts"), F.length("props").cast("long").alias("byte_len"))
    made = stream_rows(lines, SIZE)
    spark.createDataFrame([], made.schema).write.parquet(out)
    run_once(made, seen, lambda batch, _: batch.write.mode("append").parquet(out)).awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def _events_stream(spark, sf_dir) -> DataFrame:
    """Lines as of inputs.event_lines, read as a stream."""
    return inputs.lines_of(spark.readStream.schema(inputs.events(spark, sf_dir).schema).parquet(f"{sf_dir}/event[s].parquet"))


def _streamed(spark, made: DataFrame, run) -> DataFrame:
    """What a stream with keyed state gives, each batch in a folder of its own."""
    folder = shared_dir(spark).rstrip("/")
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], made.schema).write.parquet(f"{out}/none")  # a stream without rows has no batches
    with keyed_state(spark):
        run(made, f"{folder}/state-{uuid.uuid4().hex}", to_table(out))
    return spark.read.schema(made.schema).option("recursiveFileLookup", True).parquet(out)


def streamed_scores(spark, sf_dir):
    """Scores of a stream with keyed state, of the windows that the watermark has closed."""
    made = stream_scores(_events_stream(spark, sf_dir), SIZE, LOW)
    got = _streamed(spark, made, lambda *x: run_once(*x).awaitTermination())
    numbers = ("rarity", "drift", "volume", "total", "centroid_norm")
    return got.select(*KEY, "cold_start", *[F.round(c, 5).alias(c) for c in numbers])


def streamed_silences(spark, sf_dir):
    """Silences of devices in a stream, three windows long at least, opened by timers up to the watermark."""
    made = stream_silences(_events_stream(spark, sf_dir), SIZE, volume_loss.SilenceGates(0, 3, 0))
    got = _streamed(spark, made, lambda *x: run_once(*x).awaitTermination())
    return got.select("tenant_id", "device_key", "window_start_ts", F.col("window_end_ts").alias("eval_ts"))


def idle_windows(spark, sf_dir):
    """Window rows of a stream with the last ones too, closed by timers when nothing more has come."""
    made = idle_rows(_events_stream(spark, sf_dir), SIZE, 3)
    got = _streamed(spark, made, run_until_idle)
    # a line later than its window's end and grace opens a second row of it
    return got.groupBy(*KEY, "we", "bucket").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


QUERIES = {
    f.__name__: f
    for f in (
        envelope_formats, token_rules, csv_tokens, token_caps, key_rules, df_caps, centroid_caps, noise_labels, signature_texts, provenance_spans, span_lines, silence_policy, silence_lifecycle, loss_alerts, stream_volume,
        stream_silence, alert_category, alert_upsert, alert_show, alert_lookup, file_lines, archived_lines, tailed_lines, alert_files_rows, cursor_decisions, cursor_progress, streamed_rows, streamed_scores, streamed_silences, idle_windows,
    )
}
