"""Command line.  Exit codes: 0 done, 1 usage, 2 configuration, 3 input or output, 4 schema or state, 6 in part."""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import time

from . import config, control

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewatch")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("oneshot", help="alerts of a root of log files")
    again = sub.add_parser("run", help="oneshot again and again, each pass reading what files gained, until a signal ends it")
    for a in (one, again):
        a.add_argument("--root", required=True)
        a.add_argument("--out", help="table of alerts; not needed where output.sink is stdout")
        a.add_argument("--jsonl", help="folder that alerts are written to as JSON lines too, by tenant, device and day")
        a.add_argument("--data-root", help="folder of the spool, for alerts that --jsonl refuses")
        a.add_argument("--tenant")
        a.add_argument("--policy", help="file with the policy of --tenant")
        a.add_argument("--state", required=a is again, help="folder of cursors and baselines: only what files gained since the last run is read, and scored against all runs before")
        a.add_argument("--since", type=int)
        a.add_argument("--until", type=int)
        a.add_argument("--eval-ts", type=int, help="when silences are judged (else now)")
    again.add_argument("--every", type=float, default=60.0, help="seconds from the start of a pass to that of the next")
    again.add_argument("--passes", type=int, help="how many passes (else until a signal)")
    for name in ("list", "search", "show", "export", "drill"):
        a = sub.add_parser(f"alerts-{name}")
        a.add_argument("--table", required=True)
        a.add_argument("--tenant", required=True)
        if name in ("list", "search", "export"):
            a.add_argument("--category", choices=("outlier", "noise_suspect", "info"))
            a.add_argument("--entity", nargs=2, metavar=("KIND", "VALUE"))
        if name in ("list", "search"):
            a.add_argument("--since", type=int)
            a.add_argument("--until", type=int)
        if name == "search":
            a.add_argument("--contains", required=True)
        if name in ("show", "drill"):
            a.add_argument("--id", required=True)
        if name == "export":
            a.add_argument("--out", required=True)
            a.add_argument("--gzip", action="store_true")
        if name == "drill":
            a.add_argument("--root", required=True)
            a.add_argument("--max-bytes", type=int)
            a.add_argument("--max-lines", type=int)
    sub.add_parser("status").add_argument("--table", required=True)
    sub.add_parser("version")
    sub.add_parser("config-check")
    sub.add_parser("policy-check").add_argument("--path", required=True)
    purge = sub.add_parser("tenant-purge")
    purge.add_argument("--data-root", required=True)
    purge.add_argument("--tenant", required=True)
    purge.add_argument("--folder", action="append", default=[])
    purge.add_argument("--force", action="store_true")
    migrate = sub.add_parser("migrate")
    migrate.add_argument("--data-root", required=True)
    migrate.add_argument("--tenant")
    replay = sub.add_parser("replay-spool")
    replay.add_argument("--data-root", required=True)
    replay.add_argument("--out", required=True)
    return p


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _alerts(args) -> int:
    from pyspark.sql import functions as F

    from ..operators import alerts, provenance

    table = _spark().read.parquet(args.table).where(F.col("tenant_id") == args.tenant)
    action = args.command.removeprefix("alerts-")
    chosen = {k: getattr(args, k) for k in ("since", "until", "category") if getattr(args, k, None) is not None}
    if getattr(args, "entity", None):
        chosen["entity"] = tuple(args.entity)
    if action == "list" and "entity" in chosen:
        found = alerts.find_entity(_spark(), args.table, *chosen.pop("entity"), **chosen).where(F.col("tenant_id") == args.tenant)
        for row in found.toJSON().toLocalIterator():
            print(row)
        return 0
    if action == "export":
        alerts.export(table, args.out, args.gzip, **chosen)
        return 0
    if action in ("show", "drill"):
        found = alerts.find(_spark(), args.table, args.id).where(F.col("tenant_id") == args.tenant).first()
        if found is None:
            return 1
        if action == "show":
            print(json.dumps(found.asDict(recursive=True)))
        else:
            got = provenance.drill(args.root, args.tenant, found["device_dir"], [s.asDict() for s in found["provenance"]], args.max_bytes, args.max_lines)
            print(json.dumps(got))
        return 0
    got = alerts.search(table, args.contains, **chosen) if action == "search" else alerts.select_alerts(table, **chosen)
    for row in got.toJSON().toLocalIterator():
        print(row)
    return 0


def _oneshot(args, cfg) -> int:
    from pyspark.sql import functions as F

    from ..functions.ids import device_key
    from ..operators import alerts
    from ..operators.scoring import Thresholds
    from ..sources.alert_files import write_alerts
    from ..sources.files import KEYS, advance, read_parts
    from ..sources.shared import settled
    from .analyze import analyze

    stdout = cfg["output"]["sink"] == "stdout"
    if (not stdout and not args.out) or (args.policy and not args.tenant) or (args.jsonl and not args.data_root):
        return 1
    s = cfg["scoring"]
    t = Thresholds(outlier=s["outlier_threshold"], noise=s["noise_threshold"], min_lines=s["min_lines_per_window"], cold_start_days=s["cold_start_days"])
    policy = config.load_policy(args.policy) if args.policy else None
    files = _listed(args) if args.state else None
    lines, failed = read_parts(_spark(), args.root, cfg["ingest"]["max_line_len"], files)
    if args.tenant:
        failed = failed.where(F.col("tenant_id") == args.tenant)
    if files is not None:
        lines = settled(lines, "lines")  # cursors end where these lines end, whatever files gain meanwhile
    read = lines.where(F.col("tenant_id") == args.tenant) if args.tenant else lines
    keyed = read.withColumn("device_key", device_key(F.col("tenant_id"), F.col("device_dir")))
    features, entities = config.caps(cfg)
    kept = {} if files is None else {"past": _past(args.state), "keep": lambda base, watched: _write_past(args.state, base, watched)}
    found = analyze(keyed, cfg["ingest"]["window_size_s"], t, since=args.since, until=args.until, eval_ts=args.eval_ts, volume=config.volume(cfg, policy), feature_caps=features, entity_caps=entities, **kept)
    if args.jsonl:
        found = settled(found, "found")  # written twice
        write_alerts(found, args.jsonl, args.data_root, cfg["output"]["jsonl_rotate_mb"] << 20)
    if stdout:
        for row in found.toJSON().toLocalIterator():
            print(row)
    else:
        alerts.write_table(found, args.out)
    if files is not None:
        # files of other tenants and those that failed stay where they were
        seen = (files.where(F.col("tenant_id") == args.tenant) if args.tenant else files).join(failed, KEYS, "left_anti")
        done = advance(seen, read, int(time.time()))
        others = files.join(done.select(*KEYS), KEYS, "left_anti").withColumn("last_read_ts", F.lit(0))
        # one that failed is told apart from one that was read to its end: as if its size had been another
        others = others.join(failed.select(*KEYS, F.lit(True).alias("_failed")), KEYS, "left").withColumn("size", F.when(F.col("_failed"), F.lit(-1)).otherwise(F.col("size")).cast("long")).drop("_failed")
        _write_cursors(args.state, done.unionByName(others))
    broken = failed.orderBy(*KEYS).limit(100).collect()
    for r in broken:
        print(f"{r['tenant_id']}/{r['device_dir']}/{r['file_rel']}: {r['error']}", file=sys.stderr)
    return 6 if broken else 0


def _run(args, cfg) -> int:
    """Passes of oneshot.  One that could not read some files goes on (the code is 6 at the end), any other failure ends the run with its
    code; INT and TERM let the pass at work end first, as what a pass leaves counts only once it has ended."""
    import signal
    import threading

    stop, code, done = threading.Event(), 0, 0
    before = {s: signal.signal(s, lambda *_: stop.set()) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        while not stop.is_set():
            began = time.time()
            got = _oneshot(args, cfg)
            if got not in (0, 6):
                return got
            code, done = max(code, got), done + 1
            print(json.dumps({"pass": done, "code": got, "seconds": round(time.time() - began, 3)}), file=sys.stderr)
            if done == args.passes:
                break
            stop.wait(max(args.every - (time.time() - began), 0))
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)
    return code


def _cursor_folders(state: str) -> list[str]:
    """Whole cursor tables of a state folder, the last one last."""
    return sorted(d for d in glob.glob(os.path.join(state, "cursors-*")) if os.path.exists(os.path.join(d, "_SUCCESS")))


def _listed(args):
    """The files of the root with the offsets where reading goes on."""
    from pyspark.sql import functions as F

    from ..sources.files import discover, reconcile
    from ..sources.shared import settled

    spark, keys = _spark(), ["tenant_id", "device_dir", "file_rel", "is_gzip", "size"]
    now = discover(spark, args.root).select(*keys, F.lit(0).cast("long").alias("inode"))
    folders = _cursor_folders(args.state)
    old = spark.read.parquet(folders[-1]) if folders else now.withColumn("offset", F.lit(0).cast("long")).where("false")
    return settled(reconcile(now, old).drop("reason"), "listed")


def _next(state: str) -> int:
    folders = _cursor_folders(state)
    return int(folders[-1].rpartition("-")[2]) + 1 if folders else 0


def _past(state: str):
    """Baselines and watched subjects as of the last cursors; None before the first run."""
    from ..operators import state as kept

    path = os.path.join(state, f"baselines-{_next(state) - 1:08d}")
    return (kept.load(_spark(), path), kept.load_watched(_spark(), path)) if os.path.isdir(path) else None


def _write_past(state: str, base, watched) -> None:
    """Beside the cursors to come, which make them count: those of a run that ends before are written again by the next."""
    from ..operators import state as kept

    path = os.path.join(state, f"baselines-{_next(state):08d}")
    kept.save(base, path)
    kept.save(watched, path)


def _write_cursors(state: str, cursors) -> None:
    """A table of its own after alerts are written: a run that ends before reads its lines again."""
    cursors.write.mode("overwrite").parquet(os.path.join(state, f"cursors-{_next(state):08d}"))


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    try:
        cfg = config.load(args.config)
        if args.command == "oneshot":
            return _oneshot(args, cfg)
        if args.command == "run":
            return _run(args, cfg)
        if args.command.startswith("alerts-"):
            return _alerts(args)
        if args.command == "status":
            control.status(_spark().read.parquet(args.table)).show(truncate=False)
        elif args.command == "version":
            print(VERSION)
        elif args.command == "policy-check":
            print(json.dumps(config.load_policy(args.path)))
        elif args.command == "config-check":
            print(json.dumps(cfg))
        elif args.command == "tenant-purge":
            print(control.Registry(args.data_root).purge(args.tenant, args.folder, args.force))
        elif args.command == "migrate":
            print(json.dumps(control.Registry(args.data_root).migrate(args.tenant)))
        elif args.command == "replay-spool":
            if cfg["output"]["sink"] == "stdout":
                return 1
            from ..sources.sinks import JsonlSink, Spool

            got = Spool(args.data_root).replay(JsonlSink(args.out, cfg["output"]["jsonl_rotate_mb"] << 20), cfg["output"]["replay_max_files"])
            print(json.dumps(got))
            return 6 if got["failed"] else 0
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    except control.Refused as e:
        print(e, file=sys.stderr)
        return 4
    except OSError as e:
        print(e, file=sys.stderr)
        return 3
    except Exception as e:
        from pyspark.errors import PySparkException

        if not isinstance(e, PySparkException):
            raise
        print(str(e).split("\n")[0], file=sys.stderr)  # a table or folder that can't be read or written
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
