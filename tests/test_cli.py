import json

from tidewatch.plans import cli, control


def test_codes(tmp_path, capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == cli.VERSION
    assert cli.main(["nonsense"]) == 1 and cli.main(["config-check"]) == 0
    bad = tmp_path / "c.toml"
    bad.write_text("[ingest]\nwindow_size_s = 7\n")
    assert cli.main(["--config", str(bad), "config-check"]) == 2
    assert cli.main(["policy-check", "--path", str(tmp_path / "none")]) == 2
    assert cli.main(["tenant-purge", "--data-root", str(tmp_path), "--tenant", "t"]) == 4
    capsys.readouterr()
    assert cli.main(["replay-spool", "--data-root", str(tmp_path), "--out", str(tmp_path / "o")]) == 0
    assert json.loads(capsys.readouterr().out) == {"replayed": 0, "failed": 0, "left": 0}


def test_registry(tmp_path):
    r = control.Registry(str(tmp_path))
    r.see("a", 1), r.see("b", 2)
    r.set_status("b", control.DISABLED)
    assert control.Registry(str(tmp_path)).active() == ["a"]
    (tmp_path / "alerts" / "tenant_id=a").mkdir(parents=True)
    r.set_status("a", control.TERMINATING)
    assert r.purge("a", [str(tmp_path / "alerts")]) == 1 and not (tmp_path / "alerts" / "tenant_id=a").exists()
    r.state["tenants"]["b"]["schema"] = 0
    assert r.migrate() == ["b"]
    assert control.rates({"x": 5}, {"x": 3, "y": 4}, 2) == {"x": 0.0, "y": 2.0}
