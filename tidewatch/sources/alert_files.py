"""Alerts as JSON lines with exact names, written by tasks and made visible together.

A task writes whole files into an attempt's own folder under root/_temporary and tells their names; only when all tasks are
done does the driver move them to tenant=<t>/device=<d>/YYYY/MM/DD/alerts_<d>_<yyyymmdd>_<seq>.jsonl, the next free
number each (a rename a file, no bytes).  An attempt that dies leaves nothing behind but its folder, which goes with the job.
A file that has passed `rotate_bytes` takes no further alert.  Alerts that the target refuses (a name that is no path component,
an error of the store) go the same way into the spool, from which `Spool.replay` takes them; those that the spool can't name either
are in spool/alerts/refused_<job>.jsonl with the reason.  root and spool lie on mounts that all executors see.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from .files import local
from .sinks import checked_part, day_dir

SCHEMA = "tenant_id string, device_key string, window_start_ts long, alert_id string, alert string"


@dataclass
class Written(WriterCommitMessage):
    """files: (path, folder, device, day); spooled: (path, tenant, alert id); refused: (reason, alert)."""

    files: list = field(default_factory=list)
    spooled: list = field(default_factory=list)
    refused: list = field(default_factory=list)


class AlertFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewatch_alerts"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return AlertWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return AlertStreamWriter(self.options)


class _Job:
    """What batch and stream writers share."""

    def __init__(self, options):
        self.root = local(options["root"])
        self.spool = os.path.join(local(options["spool"]), "spool", "alerts")
        self.rotate = int(options.get("rotate_bytes", 256 << 20))
        self.query = options.get("query", "")
        self.job = uuid.uuid4().hex

    def _folders(self) -> list[str]:
        return [os.path.join(root, "_temporary", self.job) for root in (self.root, self.spool)]

    def _attempt(self, root: str, job: str) -> str:
        return os.path.join(root, "_temporary", job, f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}")

    def _made(self, attempt: str) -> None:
        os.makedirs(attempt, exist_ok=True)

    def _write(self, rows, job: str) -> Written:
        told, out = Written(), None
        mine, aside = self._attempt(self.root, job), self._attempt(self.spool, job)
        try:
            now = None
            for tenant, device, ws, alert_id, text in rows:
                try:
                    folder = day_dir(self.root, tenant, device, ws)
                    if out is None or now != folder or out.tell() > self.rotate:
                        if out is not None:
                            out.close()
                            out = None
                        self._made(mine)
                        path = os.path.join(mine, f"{len(told.files):06d}")
                        out, now = open(path, "wb"), folder
                        told.files.append((path, folder, device, "".join(folder.split(os.sep)[-3:])))
                    out.write(text.encode() + b"\n")
                except (OSError, ValueError, TypeError, OverflowError) as e:
                    self._aside(told, aside, tenant, alert_id, text, e)
        finally:
            if out is not None:
                out.close()  # an error here fails the attempt: what it wrote is not whole
        return told

    def _aside(self, told: Written, aside: str, tenant, alert_id, text, why: Exception) -> None:
        try:
            checked_part(tenant or "")
            checked_part(alert_id or "")
        except ValueError:
            told.refused.append((f"{type(why).__name__}: {why}", text))
            return
        self._made(aside)
        path = os.path.join(aside, f"{len(told.spooled):06d}")
        with open(path, "w") as f:
            f.write(text)
        told.spooled.append((path, tenant, alert_id))

    def _place(self, messages, job: str) -> None:
        told = [m for m in messages if m is not None]
        for path, folder, device, day in (x for m in told for x in m.files):
            os.makedirs(folder, exist_ok=True)
            seq = 0
            while True:
                final = os.path.join(folder, f"alerts_{device}_{day}_{seq:04d}.jsonl")
                try:
                    os.link(path, final)  # unlike a rename, it never replaces a file
                    break
                except FileExistsError:
                    seq += 1
        for path, tenant, alert_id in (x for m in told for x in m.spooled):
            folder = os.path.join(self.spool, f"tenant={tenant}")
            os.makedirs(folder, exist_ok=True)
            os.replace(path, os.path.join(folder, f"spool_{alert_id}.json"))
        if refused := [x for m in told for x in m.refused]:
            os.makedirs(self.spool, exist_ok=True)
            with open(os.path.join(self.spool, f"refused_{job}.jsonl"), "w") as f:
                f.writelines(json.dumps({"reason": r, "alert": a}) + "\n" for r, a in refused)
        self._clear(job)

    def _clear(self, job: str) -> None:
        for root in (self.root, self.spool):
            folder = os.path.join(root, "_temporary", job)
            try:
                os.rename(folder, folder + ".gone")  # at once, whatever tasks still write there
                shutil.rmtree(folder + ".gone")
                os.rmdir(os.path.join(root, "_temporary"))
            except OSError:
                pass  # never made, or other jobs are at work


class AlertWriter(_Job, DataSourceWriter):
    """The job's folders are made here, on the driver, and never by tasks: one that goes on after the job has ended leaves nothing."""

    def __init__(self, options):
        super().__init__(options)
        for folder in self._folders():
            try:
                os.makedirs(folder)
            except OSError:
                pass  # tasks will find that it can't be written to

    def _made(self, attempt: str) -> None:
        if not os.path.isdir(attempt):
            os.mkdir(attempt)

    def write(self, iterator) -> Written:
        return self._write(iterator, self.job)

    def commit(self, messages) -> None:
        self._place(messages, self.job)

    def abort(self, messages) -> None:
        self._clear(self.job)


class AlertStreamWriter(_Job, DataSourceStreamWriter):
    """A batch that was placed is noted under root/_batches/<query>, so that one that runs again is not placed twice, unless the driver
    died between the two."""

    def write(self, iterator) -> Written:
        return self._write(iterator, self.job)

    def commit(self, messages, batchId: int) -> None:
        note = os.path.join(self.root, "_batches", self.query, str(batchId))
        if os.path.exists(note):
            self._clear(self.job)
            return
        self._place(messages, self.job)
        os.makedirs(os.path.dirname(note), exist_ok=True)
        open(note, "w").close()

    def abort(self, messages, batchId: int) -> None:
        self._clear(self.job)


def rows_to_write(alerts: DataFrame) -> DataFrame:
    """Alerts as the sink takes them: the keys and the whole row as JSON."""
    return alerts.select("tenant_id", "device_key", F.col("window_start_ts").cast("long").alias("window_start_ts"), "alert_id", F.to_json(F.struct("*")).alias("alert"))


def write_alerts(alerts: DataFrame, root: str, spool: str, rotate_bytes: int = 256 << 20) -> None:
    """Appends alerts to the files of their device and day.  Ranges of (tenant, device, time, id) are dealt to tasks, so that a device with
    many alerts is several tasks and files, and a task has one file open."""
    alerts.sparkSession.dataSource.register(AlertFiles)
    order = ["tenant_id", "device_key", "window_start_ts", "alert_id"]
    rows = rows_to_write(alerts).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.format(AlertFiles.name()).mode("append").options(root=root, spool=spool, rotate_bytes=rotate_bytes).save()


def stream_alerts(alerts: DataFrame, root: str, spool: str, checkpoint: str, rotate_bytes: int = 256 << 20):
    """The same for a stream: a query that works off what has come."""
    alerts.sparkSession.dataSource.register(AlertFiles)
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    out = rows_to_write(alerts).writeStream.format(AlertFiles.name()).options(root=root, spool=spool, rotate_bytes=rotate_bytes, query=query)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
