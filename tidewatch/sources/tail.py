"""A streaming source of log files whose offsets are their cursors.

    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tidewatch_tail").option("root", "/logs").load()

An offset is the size and the inode of each file; Spark keeps it with the batch, so a query that starts again reads no
line twice.  Plain files are read from where the last batch ended, in ranges of bytes; another inode or a file shorter
than its offset is read anew, and so is a compressed file whose inode or size changed.  What stands after the last LF when a batch
is planned is a line, as for `files.read_lines`.  root lies on a mount that all executors see (other stores have no inodes, and
their files don't grow).  A compressed file that can't be read through gives one row with `error` and none of its lines.

Options: root; max_line (bytes kept of a line); range_bytes (of one task); tenant (one only).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import BATCH, MOST_LINE, SUFFIXES, _text, lines_of, local

SCHEMA = "tenant_id string, device_dir string, file_rel string, offset_start long, offset_end long, is_gzip boolean, byte_len long, line string, error string"
_TYPES = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.bool_(), pa.int64(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Bytes looked at together when the rest of a line over its cap is passed.
SKIP = 1 << 20


@dataclass
class Range(InputPartition):
    """Bytes of a file that one task reads: lines that start in [start, stop), none beyond end; since is where the batch begins."""

    name: str
    since: int
    start: int
    stop: int
    end: int


def range_lines(f, part: Range, most: int = MOST_LINE) -> Iterator[tuple]:
    """(start, end, raw length, line) of the lines of a range.  A line over its cap is never held whole."""
    at = part.start
    if at > part.since:  # the line that began before belongs to the range before
        f.seek(at - 1)
        at -= 1
        while at < part.end:
            raw = f.readline(min(SKIP, part.end - at))
            at += len(raw)
            if not raw or raw.endswith(b"\n"):
                break
    else:
        f.seek(at)
    while at < part.stop:
        raw = last = f.readline(min(most + 2, part.end - at))
        if not raw:
            return
        n = len(raw)
        while not last.endswith(b"\n") and at + n < part.end and (last := f.readline(min(SKIP, part.end - at - n))):
            n += len(last)
        yield at, at + n, n, _text(raw, most)
        at += n


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewatch_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = local(options["root"]).rstrip("/")
        self.most = int(options.get("max_line", MOST_LINE))
        self.range = int(options.get("range_bytes", 64 << 20))
        self.tenant = options.get("tenant")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """tenant/device/file: [size, inode] of every file with a known suffix; dotfiles and links are left out."""
        found = {}
        for tenant in self._folders(self.root):
            if self.tenant in (None, tenant.name):
                for device in self._folders(tenant.path):
                    with os.scandir(device.path) as names:
                        for e in names:
                            if not e.name.startswith(".") and e.name.endswith(SUFFIXES) and e.is_file(follow_symlinks=False):
                                s = e.stat()
                                found[f"{tenant.name}/{device.name}/{e.name}"] = [s.st_size, s.st_ino]
        return found

    def _folders(self, path: str):
        with os.scandir(path) as names:
            return [e for e in names if not e.name.startswith(".") and e.is_dir(follow_symlinks=False)]

    def partitions(self, start: dict, end: dict) -> list[Range]:
        parts = []
        for name, (size, inode) in sorted(end.items()):
            known = start.get(name)
            if name.endswith((".gz", ".zlg")):
                if known != [size, inode] and size:
                    parts.append(Range(name, 0, 0, size, size))
                continue
            since = known[0] if known and known[1] == inode and known[0] <= size else 0
            parts += [Range(name, since, a, min(a + self.range, size), size) for a in range(since, size, self.range)]
        return parts

    def commit(self, end: dict) -> None:
        """Nothing to keep: Spark has the offsets."""

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        tenant, device, name = part.name.split("/")
        gz = name.endswith(".gz")
        rows = ((tenant, device, name, a, b, gz, n, line, None) for a, b, n, line in self._lines(part, name))
        try:
            if name.endswith((".gz", ".zlg")):
                for _ in self._lines(part, name):  # none of its lines count if the last one can't be read
                    pass
        except Exception as e:  # whatever a broken file makes its library say
            rows = iter([(tenant, device, name, 0, 0, gz, 0, None, f"{type(e).__name__}: {e}")])
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _TYPES)], names=_NAMES)

    def _lines(self, part: Range, name: str) -> Iterator[tuple]:
        with open(os.path.join(self.root, part.name), "rb") as f:
            yield from lines_of(name, f, self.most) if name.endswith((".gz", ".zlg")) else range_lines(f, part, self.most)


def tail(spark, root: str, **options):
    """The stream of lines under root."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).options(root=root, **options).load()
