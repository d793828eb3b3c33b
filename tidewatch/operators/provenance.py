"""Where an alert's lines stand in their files, and getting them back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import zlg_data, zlg_index

MOST_SPANS = 8


def spans(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys and provenance: for each window the runs of adjacent lines of its files, at most MOST_SPANS, by file and offset."""
    order = Window.partitionBy(*keys, "file_rel").orderBy("offset_start", "offset_end")
    opens = F.coalesce((F.col("offset_start") > F.max("offset_end").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    runs = lines.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    merged = runs.groupBy(*keys, "file_rel", "run").agg(F.min("offset_start").alias("offset_start"), F.max("offset_end").alias("offset_end"), F.max("is_gzip").alias("is_gzip"))
    rank = Window.partitionBy(*keys).orderBy("file_rel", "offset_start")
    kept = merged.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= MOST_SPANS)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("file_rel", "offset_start", "offset_end", "is_gzip"))).alias("provenance"))


def lines_in_spans(lines: DataFrame, provenance: DataFrame, keys: list[str]) -> DataFrame:
    """Lines inside the spans of alerts: an equi-join on keys and file with a range test."""
    each = provenance.select(*keys, F.explode("provenance").alias("s")).select(*keys, F.col("s.file_rel").alias("file_rel"), F.col("s.offset_start").alias("a"), F.col("s.offset_end").alias("b"))
    return lines.join(each, [*keys, "file_rel"]).where("offset_start >= a AND offset_end <= b").drop("a", "b")


def resolve(root: str, *parts: str) -> str:
    """A path below root; anything that climbs or leaves it is refused."""
    for p in parts:
        if not p or p.startswith("/") or "\\" in p or any(x in ("", ".", "..") for x in p.split("/")) or any(ord(c) < 32 for c in p):
            raise ValueError(f"not a relative path: {p!r}")
    base = os.path.realpath(root)
    path = os.path.realpath(os.path.join(base, *parts))
    if os.path.commonpath([base, path]) != base:
        raise ValueError("the path leaves its root")
    return path


def drill(root: str, tenant: str, device: str, provenance: list[dict], most_bytes: int | None = None, most_lines: int | None = None, gzip_too: bool = False) -> dict:
    """The lines of an alert's spans, up to the caps; gzip spans are skipped and counted unless they are asked for."""
    import gzip

    out: list[bytes] = []
    used = skipped = 0

    def add(data: bytes) -> bool:
        nonlocal used
        for line in data.splitlines(keepends=True):
            if (most_lines is not None and len(out) >= most_lines) or (most_bytes is not None and used + len(line) > most_bytes):
                return False
            out.append(line)
            used += len(line)
        return True

    for s in provenance:
        path = resolve(root, tenant, device, s["file_rel"])
        if s["is_gzip"] and not gzip_too:
            skipped += 1
            continue
        if path.endswith(".zlg"):
            with open(path, "rb") as f:
                data = b"".join(zlg_data(f, c) for c in zlg_index(f) if c.start >= s["offset_start"] and c.end <= s["offset_end"])
        elif s["is_gzip"]:
            with gzip.open(path) as f:
                data = f.read()
        else:
            with open(path, "rb") as f:
                f.seek(s["offset_start"])
                data = f.read(s["offset_end"] - s["offset_start"])
        if not add(data):
            break
    return {"lines": [x.rstrip(b"\r\n").decode("utf-8", "replace") for x in out], "bytes": used, "skipped_gzip": skipped}


def extract(out_path: str, *args, **caps) -> dict:
    """As drill, gzip included, into a file."""
    got = drill(*args, gzip_too=True, **caps)
    with open(out_path, "w") as f:
        f.writelines(x + "\n" for x in got["lines"])
    return {"lines": len(got["lines"]), "bytes": got["bytes"]}
