"""Plain files read in ranges, broken files apart."""

import gzip
import os
import random

from tidewatch.plans import cli
from tidewatch.sources import files

from .test_analyze import DAY0, text
from .test_sources import archive


def test_ranges_equal_split_lines(spark, tmp_path):
    """Whatever the ranges, lines and offsets are those of the whole file: long lines, CR, no LF at the end, empty lines, bytes that are not UTF-8."""
    rng = random.Random(6)
    folder = tmp_path / "t" / "d"
    folder.mkdir(parents=True)
    data = {}
    for k in range(4):
        lines = [bytes(rng.choice(b"ab \xff\xc3\xa9,") for _ in range(rng.choice([0, 1, 30, 400, 9000]))) + rng.choice([b"", b"\r"]) for _ in range(300)]
        data[f"{k}.log"] = b"\n".join(lines) + rng.choice([b"", b"\n", b"\n\n"])
    data |= {"empty.log": b"", "one.txt": b"no end", "lf.csv": b"\n", "ignored.bin": b"x\n"}
    for name, raw in data.items():
        (folder / name).write_bytes(raw)
    (folder / "z.gz").write_bytes(gzip.compress(b"a\nb"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = files.read_lines(spark, str(tmp_path), most=500).collect()
        ends = {n: sorted(b for _, b, _, _ in files.split_lines(raw)) for n, raw in data.items()}
        at = {n: e[len(e) // 2] - (3 if n == "one.txt" else 0) for n, e in ends.items() if e}  # the middle of a line, too
        cursors = spark.createDataFrame([("t", "d", n, o) for n, o in at.items()], "tenant_id string, device_dir string, file_rel string, offset long")
        later = files.read_lines(spark, str(tmp_path), cursors=cursors).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, raw in data.items():
        want = list(files.split_lines(raw, 500)) if name != "ignored.bin" else []
        got = sorted((r.line_no, r.offset_start, r.offset_end, r.byte_len, r.line) for r in found if r.file_rel == name)
        assert [g[1:] for g in got] == want and [g[0] for g in got] == list(range(len(want)))
        if name in at and name != "ignored.bin":
            rest = list(files.split_lines(raw[at[name] :], at=at[name]))
            assert sorted((r.offset_start, r.offset_end, r.byte_len, r.line) for r in later if r.file_rel == name) == rest
    assert [r.line for r in found if r.is_gzip] == ["a", "b"]


def test_a_large_file_is_many_tasks(spark, tmp_path):
    folder = tmp_path / "t" / "d"
    folder.mkdir(parents=True)
    with open(folder / "x.log", "w") as f:
        for i in range(200_000):
            f.write(f"line {i} of a file that one task need not hold\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        text_rows = files._plain(spark, str(tmp_path))
        assert text_rows.count() == 200_000
        assert text_rows.where("offset_end - offset_start <> octet_length(raw) + 1").count() == 0
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
        assert text_rows.agg({"offset_end": "max"}).first()[0] == os.path.getsize(folder / "x.log")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_broken_files_end_nothing(spark, tmp_path, monkeypatch, capsys):
    """Code 6 and a message; the other files count, their cursors stand at their ends; a mended file is read by the next run, once."""
    root = tmp_path / "logs"
    lines = "".join(text(0, i, "all is well") + "\n" for i in range(12))
    for d in ("edge01", "edge02"):
        (root / "smoke" / d).mkdir(parents=True)
    (root / "smoke" / "edge01" / "a.log").write_text(lines)
    (root / "smoke" / "edge01" / "b.gz").write_bytes(gzip.compress(lines.encode()))
    whole = gzip.compress("".join(text(1, i % 60, "packed") + "\n" for i in range(4000)).encode())
    (root / "smoke" / "edge02" / "broken.gz").write_bytes(whole[: len(whole) // 2])
    (root / "smoke" / "edge02" / "bad.zlg").write_bytes(archive(b"x\n", bad=True))
    found, failed = files.read_parts(spark, str(root))
    assert {r.file_rel for r in found.select("file_rel").distinct().collect()} == {"a.log", "b.gz"} and {r.file_rel for r in failed.collect()} == {"broken.gz", "bad.zlg"}
    toml = tmp_path / "c.toml"
    toml.write_text('[output]\nsink = "stdout"\n[vdrop]\nenabled = false\n[scoring]\noutlier_threshold = 0.0\n')
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    args = ["--config", str(toml), "oneshot", "--root", str(root), "--state", str(tmp_path / "state")]
    assert cli.main(args) == 6
    said = capsys.readouterr()
    assert "smoke/edge02/broken.gz" in said.err and "edge01" not in said.err
    offsets = {r.file_rel: r.offset for r in spark.read.parquet(cli._cursor_folders(str(tmp_path / "state"))[-1]).collect()}
    assert offsets == {"a.log": len(lines), "b.gz": os.path.getsize(root / "smoke" / "edge01" / "b.gz"), "broken.gz": 0, "bad.zlg": 0}
    (root / "smoke" / "edge02" / "broken.gz").write_bytes(whole)
    (root / "smoke" / "edge02" / "bad.zlg").unlink()
    assert cli.main(args) == 0
    groups = spark.read.parquet(str(tmp_path / "state" / "baselines-00000001" / "groups"))
    assert sorted(r.lines_mean for r in groups.collect()) == [24.0, 4000.0] and DAY0
