"""Files, cursors, sinks, provenance, configuration and streams."""

import gzip
import json
import os
import struct
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from tidewatch.operators import alerts, provenance, windows
from tidewatch.plans import config
from tidewatch.sources import files, sinks
from tidewatch.streaming import windows as streaming


def archive(*chunks, stored=False, bad=False):
    out = files.ZLG_MAGIC + struct.pack("<HH", 1, 32) + bytes(20)
    for i, c in enumerate(chunks):
        packed = c if stored else zstandard.ZstdCompressor().compress(c)
        head = struct.pack("<HHQQQQQIIQ", 64, 0x8000 if stored else 0, i, 0, 1, len(c), len(packed), 3, zlib.crc32(c) ^ bad, 0)
        out += files.ZLG_CHUNK + head + bytes(60 - len(head)) + b"sum" + packed
    return out + files.ZLG_DIRECTORY + struct.pack("<IQ", 64, len(chunks)) + bytes(64 * len(chunks)) + files.ZLG_FOOTER + struct.pack("<I", 48) + bytes(40)


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "logs" / "t1" / "dev"
    d.mkdir(parents=True)
    (d / "a.log").write_bytes(b"one\r\ntwo\n\xff" + b"y" * 40)
    (d / "b.log.gz").write_bytes(gzip.compress(b"three\n"))
    (d / "c.zlg").write_bytes(archive(b"four\nfive\n", b"six\n"))
    (d / ".hidden.log").write_bytes(b"no\n")
    (d / "skip.bin").write_bytes(b"no\n")
    return str(tmp_path / "logs")


def test_read(spark, root):
    got = sorted((r.file_rel, r.offset_start, r.line) for r in files.read_lines(spark, root, most=8).collect())
    size = os.path.getsize(f"{root}/t1/dev/c.zlg")
    assert [g[2] for g in got if g[0] == "a.log"] == ["one", "two", "�yyyyyyy"] and [g[1] for g in got if g[0] == "a.log"] == [0, 5, 9]
    assert [g[2] for g in got if g[0] != "a.log"] == ["three", "five", "four", "six"] and size
    assert files.inventory(files.discover(spark, root)).first().files[0].file_rel == "a.log"
    cursors = spark.createDataFrame([("t1", "dev", "a.log", 5)], "tenant_id string, device_dir string, file_rel string, offset long")
    assert [r.line[:3] for r in files.read_lines(spark, root, cursors=cursors).where("file_rel = 'a.log'").collect()] == ["two", "�yy"]


def test_archive_fails_closed():
    import io

    good = archive(b"x\n", stored=True)
    assert [d for _, _, d in files.zlg_chunks(io.BytesIO(good))] == [b"x\n"]
    assert [d for _, _, d in files.zlg_chunks(io.BytesIO(good[:-48]))] == [b"x\n"]  # a directory may end the file
    for broken in (good[:40], b"no" + good, archive(b"x\n", bad=True), good[:-1], good[:-48] + b"else" + good[-44:], good[:-120]):
        with pytest.raises(ValueError):
            list(files.zlg_chunks(io.BytesIO(broken)))


def test_lines_across_chunks():
    got = list(files.lines_of("x.zlg", archive(b"one\ntw", b"o and", b" on\r\nthree")))
    assert [(n, line) for _, _, n, line in got] == [(4, "one"), (12, "two and on"), (5, "three")]
    assert got[1][0] == got[0][0] and got[1][1] == got[2][1] and got[2][0] > got[0][1]
    packed = gzip.compress(b"a\r\n") + gzip.compress(b"b\nc")
    assert [line for *_, line in files.lines_of("x.gz", packed)] == ["a", "b", "c"]


def test_cursors(spark):
    cols = "tenant_id string, device_dir string, file_rel string, is_gzip boolean, inode long, size long"
    now = [("t", "d", n, n.endswith(".gz"), i, s) for n, i, s in (("new.log", 1, 5), ("same.log", 2, 9), ("moved.log", 9, 9), ("cut.log", 4, 3), ("z.gz", 5, 7))]
    old = [("t", "d", n, n.endswith(".gz"), i, 9, 6) for n, i in (("same.log", 2), ("moved.log", 3), ("cut.log", 4), ("z.gz", 5))]
    got = {r.file_rel: (r.reason, r.offset) for r in files.reconcile(spark.createDataFrame(now, cols), spark.createDataFrame(old, cols + ", offset long")).collect()}
    assert got == {"new.log": ("new", 0), "same.log": ("resume", 6), "moved.log": ("inode", 0), "cut.log": ("truncated", 0), "z.gz": ("size", 0)}


def test_provenance(spark, root):
    lines = files.read_lines(spark, root)
    keys = ["tenant_id", "device_dir"]
    found = provenance.spans(lines, keys)
    row = found.first()
    assert [(s.file_rel, s.offset_start) for s in row.provenance][0] == ("a.log", 0)
    assert provenance.lines_in_spans(lines, found, keys).count() == lines.count()
    got = provenance.drill(root, "t1", "dev", [s.asDict() for s in row.provenance], most_lines=2)
    assert got["lines"] == ["one", "two"]
    whole = provenance.drill(root, "t1", "dev", [s.asDict() for s in row.provenance])
    assert whole["skipped_gzip"] == 1 and "six" in whole["lines"]
    for bad in ("../x", "/etc/passwd", "a/../b", "", "a\\b"):
        with pytest.raises(ValueError):
            provenance.resolve(root, bad)


def test_sinks(tmp_path):
    a = {"tenant_id": "t", "device_key": "d", "window_start_ts": 1_704_459_600, "alert_id": "x"}
    sink = sinks.JsonlSink(str(tmp_path / "out"), rotate_bytes=10)
    first, second = sink.emit(a), sink.emit(a)
    assert first.endswith("tenant=t/device=d/2024/01/05/alerts_d_20240105_0000.jsonl") and second.endswith("_0001.jsonl")
    spool = sinks.Spool(str(tmp_path))
    for i in range(3):
        spool.add({**a, "alert_id": f"x{i}"})
    assert spool.summary()["t"]["files"] == 3
    assert spool.replay(sink, 2) == {"replayed": 2, "failed": 0, "left": 1}
    assert spool.enforce(0) == 1 and not spool.files()
    with pytest.raises(ValueError):
        sinks.checked_part("a/b")


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("[ingest]\nwindow_size_s = 120\n[scoring]\nnoise_threshold = 0.5\n")
    cfg = config.load(str(f), {"TIDEWATCH_SCORING_NOISE_THRESHOLD": "0.6"}, scoring_cold_start_days=3)
    assert (cfg["ingest"]["window_size_s"], cfg["scoring"]["noise_threshold"], cfg["scoring"]["cold_start_days"]) == (120, 0.6, 3)
    assert config.silence_gates(cfg).min_mature == 90 and config.silence_gates(cfg, {"vdrop_min_mature_windows": 4}).min_mature == 4
    with pytest.raises(config.ConfigError):
        config.load(None, {}, ingest_window_size_s=61)
    f.write_text("policy_version = 2\nip_bucket = 'x'\n")
    with pytest.raises(config.ConfigError):
        config.load_policy(str(f))
    f.write_text("policy_version = 1\nvdrop_source_stream_enabled = true\n")
    assert config.streams_enabled(config.load(None, {}), config.load_policy(str(f)))


def test_alert_table(spark, tmp_path):
    from tidewatch.plans import registry

    from .conftest import SF

    found = registry._alerts(spark, SF).limit(50).cache()
    one = found.first()
    assert len(one.alert_id) == 32 and alerts.show(found, one.alert_id).count() == 1
    alerts.export(found, str(tmp_path / "x"), gzip=True, category=one.label, files=1)
    back = spark.read.json(str(tmp_path / "x"))
    assert back.count() == found.where(F.col("label") == one.label).count()
    alerts.write_table(found, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == found.count()
    assert alerts.upsert(found.unionByName(found)).count() == found.count()


def test_stream_equals_batch(spark, tmp_path):
    from tidewatch.plans import inputs

    from .conftest import SF

    lines = inputs.event_lines(spark, SF).select("tenant_id", "device_key", "ts", "byte_len", "features").where("ts < 1704240000")
    lines.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    # a far later line closes all windows
    end = lines.limit(1).withColumn("ts", F.lit(1_904_240_000).cast("long"))
    end.write.mode("append").parquet(str(tmp_path / "in"))
    got: list = []
    for make, batch in ((streaming.stream_rows, windows.rows), (streaming.stream_features, windows.row_features)):
        got.clear()
        stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
        for _ in range(2):  # the second pass, with nothing new, works off what the watermark closed
            streaming.run_once(make(stream, 3600), str(tmp_path / make.__name__), lambda df, _: got.extend(df.collect())).awaitTermination()
        want = batch(lines, 3600).collect()
        assert sorted(json.dumps(r.asDict(), sort_keys=True) for r in got) == sorted(json.dumps(r.asDict(), sort_keys=True) for r in want)
