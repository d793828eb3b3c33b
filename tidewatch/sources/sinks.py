"""Alert sinks: JSON lines by tenant, device and day; a spool for what could not be written."""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timing


def checked_part(name: str) -> str:
    """A path component without separators, control bytes or climbing."""
    if not name or name in (".", "..") or re.search(r"[/\\\x00-\x1f\x7f]", name):
        raise ValueError(f"not a path component: {name!r}")
    return name


def day_dir(root: str, tenant: str, device: str, ws: int) -> str:
    d = datetime.fromtimestamp(ws, timezone.utc)
    return os.path.join(root, f"tenant={checked_part(tenant)}", f"device={checked_part(device)}", f"{d:%Y}", f"{d:%m}", f"{d:%d}")


def write_jsonl(alerts: DataFrame, root: str, most_records: int = 100_000) -> None:
    """Appends JSON lines partitioned by tenant, device and day; files are cut by records, none is appended to."""
    out = alerts.withColumns({"tenant": F.col("tenant_id"), "device": F.col("device_key"), "day": timing.utc_day(F.col("window_start_ts"))})
    out.write.mode("append").option("maxRecordsPerFile", most_records).partitionBy("tenant", "device", "day").json(root)


class JsonlSink:
    """One process' sink with exact names: alerts_<device>_<day>_<seq>.jsonl, the next number once a file is full."""

    def __init__(self, root: str, rotate_bytes: int = 256 << 20):
        self.root, self.rotate, self.open = root, rotate_bytes, {}

    def emit(self, alert: dict) -> str:
        tenant, device, ws = alert["tenant_id"], alert["device_key"], alert["window_start_ts"]
        folder = day_dir(self.root, tenant, device, ws)
        day = "".join(folder.split(os.sep)[-3:])
        path = self.open.get(folder)
        if path is None or os.path.getsize(path) > self.rotate:
            os.makedirs(folder, exist_ok=True)
            seq = 0
            while os.path.exists(path := os.path.join(folder, f"alerts_{device}_{day}_{seq:04d}.jsonl")):
                seq += 1
        with open(path, "a") as f:
            f.write(json.dumps(alert) + "\n")
        self.open[folder] = path
        return path


class Spool:
    """Alerts that a sink refused, one file each, until they are replayed."""

    def __init__(self, data_root: str):
        self.root = os.path.join(data_root, "spool", "alerts")

    def add(self, alert: dict) -> str:
        folder = os.path.join(self.root, f"tenant={checked_part(alert['tenant_id'])}")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"spool_{checked_part(alert['alert_id'])}.json")
        with open(path, "w") as f:
            json.dump(alert, f)
        return path

    def files(self) -> list[str]:
        return sorted(os.path.join(d, n) for d, _, names in os.walk(self.root) for n in names if n.startswith("spool_") and n.endswith(".json"))

    def replay(self, sink, most: int | None = None) -> dict[str, int]:
        """Emits in order of path; a file goes once its alert is written."""
        done = failed = 0
        for path in self.files()[:most]:
            try:
                with open(path) as f:
                    sink.emit(json.load(f))
            except (OSError, ValueError, KeyError):
                failed += 1
                continue
            os.remove(path)
            done += 1
        return {"replayed": done, "failed": failed, "left": len(self.files())}

    def enforce(self, most_bytes: int) -> int:
        """Removes the first files by path until the rest fits."""
        files = self.files()
        total, gone = sum(map(os.path.getsize, files)), 0
        for path in files:
            if total <= most_bytes:
                break
            total -= os.path.getsize(path)
            os.remove(path)
            gone += 1
        return gone

    def summary(self) -> dict[str, dict]:
        """files, bytes and oldest time, by tenant."""
        out: dict = defaultdict(lambda: {"files": 0, "bytes": 0, "oldest": None})
        for path in self.files():
            s, x = os.stat(path), out[os.path.basename(os.path.dirname(path)).removeprefix("tenant=")]
            x["files"], x["bytes"] = x["files"] + 1, x["bytes"] + s.st_size
            x["oldest"] = min(x["oldest"] or s.st_mtime, s.st_mtime)
        return dict(out)


def emit_all(alerts: DataFrame, sink, spool: Spool) -> dict[str, int]:
    """Writes alerts one by one from the driver, as a stream's foreachBatch does; refused ones go to the spool."""
    count = {"emitted": 0, "spooled": 0}
    for row in alerts.toJSON().toLocalIterator():
        alert = json.loads(row)
        try:
            sink.emit(alert)
            count["emitted"] += 1
        except OSError:
            spool.add(alert)
            count["spooled"] += 1
    return count
