"""The end-to-end plan: alerts of lost volume and caps, from raw lines and from a tree of files."""

import pytest

from tidewatch.operators import scoring, volume_loss, windows
from tidewatch.plans import config
from tidewatch.plans.analyze import analyze

SIZE, DAY0 = 60, 1_704_067_200


def text(minute: int, second: int, words: str) -> str:
    return f"2024-01-01T00:{minute:02d}:{second:02d}Z host app: {words}"


def counts():
    """(device, minute, lines): a and b drop at minute 8, b ends there; a goes on to minute 11; c ends at minute 11."""
    made = [(d, m, 20) for d in "ab" for m in range(8)] + [("a", 8, 1), ("b", 8, 1)] + [("a", m, 20) for m in (9, 10)] + [("a", 11, 1)]
    return made + [("c", m, 20) for m in range(12)]


VOLUME = volume_loss.Volume(gates=volume_loss.SilenceGates(min_mature=5, min_missed=3, min_lines=2))
EVAL = DAY0 + 12 * 60


def loss(found):
    return sorted((r.subject_kind, r.subject_key, (r.window_start_ts - DAY0) // 60, "drop" if r.reasons[0].details[0].v == "sharp_drop" else "silence") for r in found if r.subject_kind)


def test_lost_volume_and_caps(spark):
    rows = [("t", d, text(m, i, f"user=u{i} seen"), 50) for d, m, n in counts() for i in range(n)]
    lines = spark.createDataFrame(rows, "tenant_id string, device_key string, line string, byte_len long")
    low = scoring.Thresholds(min_lines=1, info=0.0)
    found = analyze(lines, SIZE, low, eval_ts=EVAL, volume=VOLUME, feature_caps={"Word": 1, "Shape": 3, "Syslog": 1, "all": 4}).collect()
    # b is silent, so its drop and its part in the tenant's are not judged; a alone is no tenant group, a and c are
    assert loss(found) == [("device", "a", 8, "drop"), ("device", "a", 11, "drop"), ("device", "b", 9, "silence")]
    assert len({r.alert_id for r in found}) == len(found) and all(r.entities is not None and r.summary_analyst for r in found)
    plain = [r for r in found if r.subject_kind is None]
    assert plain and any(r.dropped_features + r.dropped_words + r.dropped_shapes > 0 for r in plain) and all(len(r.top_features) <= 4 for r in plain)
    later = analyze(lines, SIZE, low, eval_ts=EVAL + 600, volume=VOLUME).collect()
    assert [x[:2] for x in loss(later)] == [("device", "a"), ("device", "b"), ("device", "c"), ("tenant", "t")]


def test_oneshot(spark, tmp_path, monkeypatch):
    from tidewatch.plans import cli

    for d in "abc":
        (tmp_path / "logs" / "t" / d).mkdir(parents=True)
        (tmp_path / "logs" / "t" / d / "x.log").write_text("".join(text(m, i, "all is well") + "\n" for k, m, n in counts() if k == d for i in range(n)))
    toml = tmp_path / "c.toml"
    toml.write_text("[vdrop]\nmin_mature_windows = 5\nmin_expected_lines = 2\nsource_stream_enabled = true\n")
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    args = ["oneshot", "--root", str(tmp_path / "logs"), "--eval-ts", str(EVAL)]
    assert cli.main(["--config", str(toml), *args, "--out", str(tmp_path / "out")]) == 0
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    got = [(r.subject_kind, (r.window_start_ts - DAY0) // 60, [(s.file_rel, s.offset_end - s.offset_start) for s in r.provenance]) for r in found if r.subject_kind]
    line = len(text(0, 0, "all is well")) + 1
    drops = [(m, [("x.log", line)]) for m in (8, 11)]
    assert sorted(got) == sorted((k, *x) for k in ("device", "source_stream") for x in [*drops, (9, [])])
    assert {r.source_path for r in found if r.subject_kind == "source_stream"} == {"x.log"}


def test_resume(spark, tmp_path, monkeypatch, capsys):
    """A second run reads what files gained; its alerts are those of new lines only; alerts can go to standard output."""
    import gzip
    import json

    from tidewatch.plans import cli

    d = tmp_path / "logs" / "t" / "a"
    d.mkdir(parents=True)
    (d / "x.log").write_text("".join(text(0, i, "all is well") + "\n" for i in range(12)))
    (d / "y.log.gz").write_bytes(gzip.compress("".join(text(1, i, "packed") + "\n" for i in range(12)).encode()))
    toml = tmp_path / "c.toml"
    toml.write_text('[output]\nsink = "stdout"\n[scoring]\noutlier_threshold = 0.0\n[vdrop]\nenabled = false\n')
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    args = ["--config", str(toml), "oneshot", "--root", str(tmp_path / "logs"), "--state", str(tmp_path / "state")]

    def run():
        assert cli.main(args) == 0
        return sorted(((r["window_start_ts"] - DAY0) // 60, r["lines"]) for r in map(json.loads, capsys.readouterr().out.splitlines()))

    first = run()
    assert run() == [] and first and set(first) <= {(0, 12), (1, 12)}
    with open(d / "x.log", "a") as f:
        f.write("".join(text(2, i, "new words") + "\n" for i in range(15)))
    assert set(run()) <= {(2, 15)}
    cursors = spark.read.parquet(cli._cursor_folders(str(tmp_path / "state"))[-1]).collect()
    assert {r.file_rel: r.offset for r in cursors} == {n: (d / n).stat().st_size for n in ("x.log", "y.log.gz")}
    assert cli.main([*args[:3], "--root", str(tmp_path / "none"), "--out", str(tmp_path / "o")]) == 3
    assert cli.main(["oneshot", "--root", str(tmp_path)]) == 1


def test_settings():
    cfg = config.load(environ={}, vdrop_tenant_enabled=False, caps_max_word_features_per_window=7, caps_max_hosts=3)
    assert config.volume(cfg) == volume_loss.Volume(tenant=False)
    assert config.volume(config.load(environ={}, vdrop_enabled=False)) is None
    assert config.caps(cfg) == (windows.FEATURE_CAPS | {"Word": 7}, windows.ENTITY_CAPS | {"Host": 3})
    assert config.volume(cfg).drops(volume_loss.TENANT).min_maturity == 2 and config.volume(cfg).drops(volume_loss.DEVICE).min_expected == pytest.approx(10)
