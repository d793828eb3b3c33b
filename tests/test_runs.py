"""Runs that go on from one another: alerts of two runs are those of one, open silences and drops are told once."""

import json

from pyspark.sql import functions as F

from tidewatch.operators import scoring, volume_loss
from tidewatch.plans import cli
from tidewatch.plans.analyze import analyze

from .test_analyze import DAY0, EVAL, SIZE, VOLUME, counts, loss, text


def told(found):
    return sorted((r.subject_kind or "row", r.subject_key, r.device_key, (r.window_start_ts - DAY0) // 60, round(r.score_total, 4), r.label) for r in found)


def test_two_runs(spark, tmp_path):
    """The lines in two runs cut at minute 9: each row and drop as in one run; the silence of b in the second only."""
    rows = [("t", d, m, text(m, i, f"user=u{i} seen"), 50) for d, m, n in counts() for i in range(n)]
    lines = spark.createDataFrame(rows, "tenant_id string, device_key string, m int, line string, byte_len long").cache()
    low = scoring.Thresholds(min_lines=1, info=0.0, cold_start_days=0)
    whole = told(analyze(lines.drop("m"), SIZE, low, eval_ts=EVAL, volume=VOLUME).collect())
    kept = []
    first = analyze(lines.where("m < 9").drop("m"), SIZE, low, eval_ts=DAY0 + 9 * 60, volume=VOLUME, keep=lambda *x: kept.append(x)).collect()
    base, watched = kept[0]
    second = analyze(lines.where("m >= 9").drop("m"), SIZE, low, eval_ts=EVAL, volume=VOLUME, past=kept[0]).collect()
    # b is silent only as of the second run, so the first has its drop
    assert [x for x in told([*first, *second]) if x[0] == "row"] == [x for x in whole if x[0] == "row"]
    assert loss(first) == [("device", "a", 8, "drop"), ("device", "b", 8, "drop")]
    assert loss(second) == [("device", "a", 11, "drop"), ("device", "b", 9, "silence")]
    assert {(r.subject_kind, r.subject_key) for r in watched.opened.where("sharp_drop").collect()} == {(1, "a"), (1, "b")}
    assert {(r.subject_kind, r.subject_key): (r.observed_windows, r.last_lines) for r in watched.subjects.collect()} == {(1, "a"): (9, 1), (1, "b"): (9, 1), (1, "c"): (9, 20), (2, "t"): (27, 20)}


def test_open_drop_is_told_once(spark):
    """A drop that goes on over runs is told by the first; recovery lets the next one be told."""
    def run(minutes, past):
        rows = spark.createDataFrame([("t", "a", DAY0 + m * 60, DAY0 + m * 60 + 60, 0, n, n * 9) for m, n in minutes], "tenant_id string, device_key string, ws long, we long, bucket int, lines long, bytes long")
        alerts, left = volume_loss.judged(rows, 60, F.lit(DAY0 + max(m for m, _ in minutes) * 60 + 60), volume_loss.Volume(tenant=False, gates=VOLUME.gates), 10, past=past)
        return [(r.window_start_ts - DAY0) // 60 for r in alerts.collect()], volume_loss.Watched(*[spark.createDataFrame(x.collect(), x.schema) for x in (left.subjects, left.volumes, left.opened)])

    first, past = run([(m, 20) for m in range(40)] + [(40, 1)], None)
    second, past = run([(41, 1), (42, 1)], past)
    third, past = run([(43, 18), (44, 1)], past)
    assert (first, second, third) == ([40], [], [44])
    assert past.volumes.first().n == 45


def test_oneshot_tells_a_silence_once(spark, tmp_path, monkeypatch, capsys):
    device = tmp_path / "logs" / "t" / "b"
    device.mkdir(parents=True)
    other = tmp_path / "logs" / "t" / "a"
    other.mkdir()

    def write(folder, minutes):
        with open(folder / "x.log", "a") as f:
            f.write("".join(text(m, i, "all is well") + "\n" for m in minutes for i in range(12)))

    toml = tmp_path / "c.toml"
    toml.write_text('[output]\nsink = "stdout"\n[vdrop]\nmin_mature_windows = 5\nmin_expected_lines = 2\ntenant_enabled = false\n')
    monkeypatch.setattr(cli, "_spark", lambda: spark)

    def run(minute):
        args = ["--config", str(toml), "oneshot", "--root", str(tmp_path / "logs"), "--state", str(tmp_path / "state"), "--eval-ts", str(DAY0 + minute * 60)]
        assert cli.main(args) == 0
        return sorted((r["window_start_ts"] - DAY0) // 60 for r in map(json.loads, capsys.readouterr().out.splitlines()) if r.get("subject_kind"))

    write(device, range(8)), write(other, range(14))
    assert run(14) == [8]
    write(other, range(14, 16))
    assert run(16) == []  # still silent
    write(device, [16]), write(other, range(16, 22))
    assert run(22) == [17]  # seen, then silent again
    assert spark.read.parquet(str(tmp_path / "state" / "baselines-00000002" / "groups")).agg(F.sum("n")).first()[0] == 9 + 22


def test_run_again_and_again(spark, tmp_path, monkeypatch, capsys):
    """Passes go on from one another: a line is read once, an alert is in the table and in its day's file; a signal ends the run after its pass."""
    import glob
    import json
    import os
    import signal

    from tidewatch.plans import cli

    from .test_analyze import EVAL, counts, text

    root = tmp_path / "logs" / "t" / "d"
    root.mkdir(parents=True)
    (root / "a.log").write_text("".join(text(m, i, "all is well") + "\n" for d, m, n in counts() if d == "a" for i in range(n)))
    toml = tmp_path / "c.toml"
    toml.write_text("[vdrop]\nmin_mature_windows = 5\nmin_expected_lines = 2\n")
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    folders = {n: str(tmp_path / n) for n in ("out", "state", "jsonl", "data")}
    args = ["--config", str(toml), "run", "--root", str(tmp_path / "logs"), "--out", folders["out"], "--state", folders["state"], "--eval-ts", str(EVAL + 60), "--every", "0", "--passes", "9"]
    assert cli.main([*args, "--jsonl", folders["jsonl"]]) == 1  # where would refused alerts go?
    once, seen = cli._oneshot, []

    def watched(args, cfg):
        seen.append(once(args, cfg))
        if len(seen) == 1:
            with open(root / "a.log", "a") as f:
                f.write("".join(text(12, i, "all is well") + "\n" for i in range(12)))
        else:
            os.kill(os.getpid(), signal.SIGTERM)
        return seen[-1]

    monkeypatch.setattr(cli, "_oneshot", watched)
    assert cli.main([*args, "--jsonl", folders["jsonl"], "--data-root", folders["data"]]) == 0 and seen == [0, 0]
    table = spark.read.parquet(folders["out"]).collect()
    written = [json.loads(line) for p in glob.glob(f"{folders['jsonl']}/tenant=t/device=*/*/*/*/alerts_*.jsonl") for line in open(p)]
    assert len(table) >= 2 and sorted(r.alert_id for r in table) == sorted(a["alert_id"] for a in written)
    offsets = {r.file_rel: r.offset for r in spark.read.parquet(cli._cursor_folders(folders["state"])[-1]).collect()}
    assert offsets == {"a.log": os.path.getsize(root / "a.log")}
