"""The streaming source with cursors as offsets, and the sink that commits."""

import glob
import gzip
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import alert_files, files, sinks, tail

from .test_sources import archive


def _lines(raw, at=0, most=files.MOST_LINE):
    return list(files.split_lines(raw, most, at))


@pytest.mark.parametrize("size", [1, 3, 7, 64, 5000])
def test_ranges_are_lines(size):
    raw = b"one\r\n\n" + b"x" * 500 + b"\r\n" + b"y" * 40 + b"\nlast \xff"
    for since in (0, 5, 9, len(raw)):
        got = []
        for a in range(since, len(raw), size):
            got += tail.range_lines(io.BytesIO(raw), tail.Range("n", since, a, min(a + size, len(raw)), len(raw)), 30)
        assert got == _lines(raw[since:], since, 30)
    whole = list(tail.range_lines(io.BytesIO(raw + b"grown since"), tail.Range("n", 0, 0, len(raw), len(raw)), 30))
    assert whole == _lines(raw, 0, 30)  # what came after the plan belongs to the next batch


def test_tail_goes_on(spark, tmp_path):
    folder = tmp_path / "logs" / "t" / "d"
    folder.mkdir(parents=True)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        before = set(glob.glob(f"{out}/*.parquet"))
        lines = tail.tail(spark, str(tmp_path / "logs"), range_bytes=100, max_line=50)
        lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
        new = sorted(set(glob.glob(f"{out}/*.parquet")) - before)
        rows = spark.read.parquet(*new).collect() if new else []
        return sorted((r.file_rel, r.offset_start, r.offset_end, r.byte_len, r.line, r.error and "error") for r in rows)

    want = lambda name, raw, at=0: [(name, *x, None) for x in _lines(raw, at, 50)]
    first = b"".join(b"line %d\n" % i for i in range(60)) + b"z" * 300 + b"\n"
    (folder / "a.log").write_bytes(first)
    (folder / "c.gz").write_bytes(gzip.compress(b"p\nq\n"))
    (folder / "z.zlg").write_bytes(archive(b"x\n", b"y\n"))
    (folder / "no.bin").write_bytes(b"n\n")
    (folder / ".hidden.log").write_bytes(b"n\n")
    got = run()
    assert [g for g in got if g[0] == "a.log"] == want("a.log", first)
    assert [(g[0], g[4]) for g in got if g[0] != "a.log"] == [("c.gz", "p"), ("c.gz", "q"), ("z.zlg", "x"), ("z.zlg", "y")]
    assert run() == []
    with open(folder / "a.log", "ab") as f:
        f.write(b"more\nend")
    (folder / "b.log").write_bytes(b"new\n")
    assert run() == want("a.log", b"more\nend", len(first)) + want("b.log", b"new\n")
    # cut: from the start; another file in its place: too; a compressed one that changed: too; a broken one: an error and no lines
    (folder / "a.log").write_bytes(b"cut\n")
    (folder / "other").write_bytes(b"new\nand longer\n")
    os.replace(folder / "other", folder / "b.log")
    (folder / "c.gz").write_bytes(gzip.compress(b"p\nq\nr\n"))
    whole = gzip.compress(os.urandom(5000))
    (folder / "d.gz").write_bytes(whole[:3000])
    got = run()
    assert [g for g in got if g[0] in ("a.log", "b.log")] == want("a.log", b"cut\n") + want("b.log", b"new\nand longer\n")
    assert [(g[4], g[5]) for g in got if g[0] == "c.gz"] == [("p", None), ("q", None), ("r", None)]
    assert [(g[4], g[5]) for g in got if g[0] == "d.gz"] == [(None, "error")]
    assert run() == []


def _alerts(spark, n=400):
    rows = spark.range(n).select(
        F.concat(F.lit("t"), F.col("id") % 2).alias("tenant_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 5)).alias("device_key"),
        (F.lit(1_704_067_200) + F.col("id") * 3600).alias("window_start_ts"), F.concat(F.lit("a"), F.col("id")).alias("alert_id"), F.array(F.struct(F.lit("x").alias("code"))).alias("reasons"),
    )
    return rows


def _read(root):
    found = {}
    for path in glob.glob(f"{root}/tenant=*/device=*/*/*/*/*.jsonl"):
        with open(path) as f:
            found[os.path.relpath(path, root)] = [json.loads(line) for line in f]
    return found


def test_sink(spark, tmp_path):
    root, spool = str(tmp_path / "out"), str(tmp_path / "data")
    alerts = _alerts(spark)
    alert_files.write_alerts(alerts, root, spool, rotate_bytes=300)
    found = _read(root)
    assert sorted(a["alert_id"] for x in found.values() for a in x) == sorted(f"a{i}" for i in range(400))
    for path, inside in found.items():
        tenant, device, y, m, d, name = path.split("/")
        assert sinks.day_dir("", inside[0]["tenant_id"], inside[0]["device_key"], inside[0]["window_start_ts"]) == os.path.join("", tenant, device, y, m, d)
        assert name.startswith(f"alerts_{device[7:]}_{y}{m}{d}_") and inside[0]["reasons"] == [{"code": "x"}]
        assert sum(len(json.dumps(a, separators=(",", ":"))) + 1 for a in inside[:-1]) <= 300  # one that passes the cap is the last
    assert any(p.endswith("_0001.jsonl") for p in found) and not os.path.exists(f"{root}/_temporary")
    alert_files.write_alerts(alerts.where("alert_id = 'a3'"), root, spool, rotate_bytes=300)  # never appended to
    assert len(_read(root)) == len(found) + 1 and not glob.glob(f"{spool}/**/*.json", recursive=True)


def test_sink_of_a_failing_task(spark, tmp_path):
    root, spool = str(tmp_path / "out"), str(tmp_path / "data")
    bad = _alerts(spark).withColumn("alert_id", F.when(F.col("alert_id") == "a390", F.raise_error(F.lit("gone")).cast("string")).otherwise(F.col("alert_id")))
    spark.dataSource.register(alert_files.AlertFiles)
    rows = alert_files.rows_to_write(bad)
    with pytest.raises(Exception, match="gone"):
        rows.write.format("tidewatch_alerts").mode("append").options(root=root, spool=spool).save()
    assert not _read(root) and not os.path.exists(f"{root}/_temporary")


def test_refused_alerts(spark, tmp_path):
    root, spool = str(tmp_path / "out"), str(tmp_path / "data")
    alerts = _alerts(spark, 10).withColumn("device_key", F.when(F.col("alert_id") == "a4", "../up").otherwise(F.col("device_key")))
    alerts = alerts.withColumn("tenant_id", F.when(F.col("alert_id") == "a5", "..").when(F.col("alert_id") == "a6", F.lit(None)).otherwise(F.col("tenant_id")))
    alert_files.write_alerts(alerts, root, spool)
    assert sorted(a["alert_id"] for x in _read(root).values() for a in x) == ["a0", "a1", "a2", "a3", "a7", "a8", "a9"]
    kept = sinks.Spool(spool)
    assert [os.path.basename(p) for p in kept.files()] == ["spool_a4.json"]
    (refused,) = glob.glob(f"{spool}/spool/alerts/refused_*.jsonl")
    with open(refused) as f:
        assert sorted(json.loads(json.loads(line)["alert"])["alert_id"] for line in f) == ["a5", "a6"]
    # a root that can't be written to: all alerts are in the spool, and replayed once there is one
    (tmp_path / "file").write_text("")
    alert_files.write_alerts(_alerts(spark, 6), str(tmp_path / "file"), str(tmp_path / "data2"))
    kept = sinks.Spool(str(tmp_path / "data2"))
    assert len(kept.files()) == 6
    assert kept.replay(sinks.JsonlSink(str(tmp_path / "later"))) == {"replayed": 6, "failed": 0, "left": 0}
    assert len([a for x in _read(str(tmp_path / "later")).values() for a in x]) == 6


def test_sink_of_a_stream(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "out")
    for _ in range(2):
        _alerts(spark, 30).write.mode("append").parquet(src)
        stream = spark.readStream.schema(_alerts(spark, 1).schema).parquet(src)
        alert_files.stream_alerts(stream, root, str(tmp_path / "data"), str(tmp_path / "state")).awaitTermination(120)
    assert len([a for x in _read(root).values() for a in x]) == 60
    (query,) = os.listdir(f"{root}/_batches")
    writer = alert_files.AlertStreamWriter({"root": root, "spool": str(tmp_path / "data"), "query": query})
    writer.commit([alert_files.Written(files=[("gone", "gone", "d", "d")])], 1)  # run again: nothing is written twice
    assert len([a for x in _read(root).values() for a in x]) == 60
