"""Log files as lines: discovery, plain, gzip and chunked-archive readers, cursors.

Files lie at root/tenant/device/file, in any store that Spark reads.  Plain files are read in ranges by Spark's text source, so
a large one is many tasks: each line gets its place inside its range in the pass that reads it, and ranges get theirs
from the sums of those before.  On a mount, archives are planned from the headers of their chunks and read in groups of chunks, and a
gzip file is streamed by one task; in other stores both are read whole.  A compressed file that can't be read ends nothing:
it is told in a table of failures, and none of its lines count.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import settled

#: Suffixes that are read; the caps of a line.
SUFFIXES = (".log", ".txt", ".json", ".csv", ".cef", ".gz", ".zlg")
MOST_LINE = 16_384
#: Those of plain and of compressed files, as globs.
PLAIN, PACKED = "*.{log,txt,json,csv,cef}", "*.{gz,zlg}"
#: Cursors up to this number are broadcast.
MOST_BROADCAST = 200_000
LINES = "tenant_id string, device_dir string, file_rel string, offset_start long, offset_end long, is_gzip boolean, byte_len long, line string, line_no long"


def _parts(path: str) -> list[Column]:
    part = lambda i: F.element_at(F.split(path, "/"), -i)
    return [part(3).alias("tenant_id"), part(2).alias("device_dir"), part(1).alias("file_rel")]


def _shown() -> Column:
    return ~(F.col("file_rel").startswith(".") | F.col("tenant_id").startswith(".") | F.col("device_dir").startswith("."))


def discover(spark: SparkSession, root: str, content: bool = False, names: str | None = None) -> DataFrame:
    """tenant_id, device_dir, file_rel, path, size, mtime, is_gzip (and content, if asked for) of all files with a known suffix (of those
    that match the glob `names`), dotfiles left out."""
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", names) if names else reader).load(f"{root.rstrip('/')}/*/*/*")
    found = found.select(*_parts("path"), "path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), *["content"] * content)
    known = F.lit(False)
    for s in SUFFIXES:
        known = known | F.col("file_rel").endswith(s)
    return found.where(known & _shown()).withColumn("is_gzip", F.col("file_rel").endswith(".gz"))


def inventory(files: DataFrame) -> DataFrame:
    """Devices with their files: plain before gzip, then by name."""
    return files.groupBy("tenant_id", "device_dir").agg(F.sort_array(F.collect_list(F.struct("is_gzip", "file_rel"))).alias("files"))


def _text(raw: bytes, most: int) -> str:
    """A line without its LF and the CR before it, cut at the cap."""
    raw = raw.removesuffix(b"\n")
    return raw.removesuffix(b"\r")[:most].decode("utf-8", "replace")


def split_lines(data: bytes, most: int = MOST_LINE, at: int = 0):
    """(start, end, raw length, line) of each line."""
    start = 0
    while start < len(data):
        stop = data.find(b"\n", start) + 1 or len(data)
        yield at + start, at + stop, stop - start, _text(data[start:stop], most)
        start = stop


#: Fixed values of the chunked archive: magics, sizes, flag of a stored chunk, caps.
ZLG_MAGIC, ZLG_CHUNK, ZLG_DIRECTORY, ZLG_FOOTER = b"ZLG1P0\0\0", b"ZCH1", b"ZDR1", b"ZFT1"
ZLG_HEADER, ZLG_CHUNK_HEADER, ZLG_STORED, ZLG_ENTRY, ZLG_FOOTER_SIZE = 32, 64, 0x8000, 64, 48
ZLG_MOST_SUMMARY, ZLG_MOST_CHUNK = 64 << 20, 1 << 30


class Chunk(NamedTuple):
    """A chunk's place in the file and what its header says of it."""

    start: int
    end: int
    stored: bool
    plain: int
    packed: int
    crc: int


def _taken(f: io.BufferedIOBase, n: int) -> bytes:
    got = f.read(n)
    if len(got) != n:
        raise ValueError("archive is cut short")
    return got


def zlg_index(f: io.BufferedIOBase, at: int = 0) -> Iterator[Chunk]:
    """The chunks from one that starts at `at` on (0: all of them), headers only: what they hold is passed over.  Anything out of order
    is an error, in the directory and the footer too."""
    size = f.seek(0, io.SEEK_END)
    if not at:
        f.seek(0)
        head = _taken(f, ZLG_HEADER)
        if head[:8] != ZLG_MAGIC or struct.unpack_from("<HH", head, 8) != (1, ZLG_HEADER):
            raise ValueError("not a chunked archive")
        at = ZLG_HEADER
    while at < size:
        f.seek(at)
        magic = _taken(f, 4)
        if magic == ZLG_DIRECTORY:
            entry, entries = struct.unpack("<IQ", _taken(f, 12))
            if entry != ZLG_ENTRY:
                raise ValueError("directory entry out of bounds")
            if (after := at + 16 + entry * entries) > size:
                raise ValueError("archive is cut short")
            f.seek(after)
            if (magic := f.read(4)) and (magic != ZLG_FOOTER or struct.unpack("<I", _taken(f, 4))[0] != ZLG_FOOTER_SIZE or not _taken(f, ZLG_FOOTER_SIZE - 8)):
                raise ValueError("no footer after the directory")
            return
        if magic != ZLG_CHUNK:
            raise ValueError("unexpected record")
        length, flags, _, _, _, plain, packed, summary, crc, _ = struct.unpack("<HHQQQQQIIQ", _taken(f, ZLG_CHUNK_HEADER - 4))
        if length != ZLG_CHUNK_HEADER or summary > ZLG_MOST_SUMMARY or packed > ZLG_MOST_CHUNK or plain > ZLG_MOST_CHUNK:
            raise ValueError("chunk header out of bounds")
        end = at + ZLG_CHUNK_HEADER + summary + packed
        if end > size:
            raise ValueError("archive is cut short")
        yield Chunk(at, end, bool(flags & ZLG_STORED), plain, packed, crc)
        at = end


def zlg_data(f: io.BufferedIOBase, chunk: Chunk) -> bytes:
    """What a chunk holds."""
    import zstandard

    f.seek(chunk.end - chunk.packed)
    raw = _taken(f, chunk.packed)
    data = raw if chunk.stored else zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if len(data) != chunk.plain or zlib.crc32(data) != chunk.crc:
        raise ValueError("chunk doesn't match its header")
    return data


def zlg_chunks(f: io.BufferedIOBase, start: int = 0):
    """(start, end, data) of each chunk that ends after `start`; those before are not read."""
    return ((c.start, c.end, zlg_data(f, c)) for c in zlg_index(f) if c.end > start)


#: Bytes of chunks, as they lie in the archive, that one task reads; the last chunk may pass it.
GROUP = 16 << 20


def zlg_groups(f: io.BufferedIOBase, start: int = 0, most: int = GROUP) -> list[tuple[int, int, int]]:
    """(start, end, start of the chunk with data before or -1) of groups of chunks that end after `start`."""
    groups: list[tuple[int, int, int]] = []
    before, last = -1, -1
    for c in zlg_index(f):
        if c.end <= start:
            continue
        if groups and c.start - groups[-1][0] < most:
            groups[-1] = (groups[-1][0], c.end, groups[-1][2])
        else:
            before = last
            groups.append((c.start, c.end, before))
        if c.plain:
            last = c.start
    return groups


def group_lines(f: io.BufferedIOBase, group: tuple[int, int, int], most: int = MOST_LINE):
    """(start, end, raw length, line) of the lines that start in a group of chunks: the rest of one from before is passed, the last one is
    read to its end, however many chunks it takes."""
    start, stop, before = group

    def own():
        passing = before >= 0 and not zlg_data(f, next(zlg_index(f, before))).endswith(b"\n")
        whole = True  # whether the last line that started here has ended
        for c in zlg_index(f, start):
            if c.start >= stop and (passing or whole):
                return
            data = zlg_data(f, c)
            cut = data.find(b"\n") + 1
            if passing:
                passing = not cut
                data = data[cut:] if cut else b""
            elif c.start >= stop and cut:
                data = data[:cut]
            if data:
                whole = data.endswith(b"\n")
            yield c.start, c.end, data

    return archive_lines(own(), most)


def archive_lines(chunks, most: int = MOST_LINE):
    """(start, end, raw length, line) of lines of (start, end, data) chunks; a line that goes on in later chunks has the places of
    all of them."""
    held, since, end = b"", 0, 0
    for start, end, data in chunks:
        cut = data.rfind(b"\n") + 1
        if not cut:
            since, held = since if held else start, held + data
            continue
        first = since if held else start
        for i, (_, _, n, line) in enumerate(split_lines(held + data[:cut], most)):
            yield start if i else first, end, n, line
        held, since = data[cut:], start
    if held:
        yield since, end, len(held), _text(held, most)


def lines_of(name: str, data: bytes | io.BufferedIOBase, most: int = MOST_LINE, start: int = 0):
    """(start, end, raw length, line) of a file, or of an open compressed one.  Compressed files give the offsets of what holds the
    line, and are never decompressed as a whole."""
    if name.endswith((".zlg", ".gz")):
        f = io.BytesIO(data) if isinstance(data, bytes) else data
        size = f.seek(0, io.SEEK_END)
        f.seek(0)
    if name.endswith(".zlg"):
        yield from archive_lines(zlg_chunks(f, start), most)
    elif name.endswith(".gz"):
        if start >= size > 0:
            return
        with gzip.open(f) as lines:
            yield from ((0, size, len(raw), _text(raw, most)) for raw in lines)
    else:
        yield from split_lines(data[start:] if start else data, most, start)


#: Lines of one Arrow batch.
BATCH = 20_000
KEYS = ["tenant_id", "device_dir", "file_rel"]


def _numbered(batches):
    """Rows of the text source, in order, with their place and number inside their range: path, range, size, raw, at, length, number."""
    key, at, number = None, 0, 0
    for batch in batches:
        path, start = batch.column("path"), batch.column("range")
        coded = np.asarray(path.dictionary_encode().indices)
        starts = np.asarray(start, np.int64)
        length = np.asarray(batch.column("length"), np.int64)
        first = np.concatenate([[0], np.flatnonzero((np.diff(coded) != 0) | (np.diff(starts) != 0)) + 1, [len(length)]]) if len(length) else np.zeros(1, np.int64)
        place, count = np.cumsum(length) - length, np.arange(len(length))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            now = (path[a].as_py(), int(starts[a]))
            if now != key:
                key, at, number = now, 0, 0
            place[a:b] += at - place[a]
            count[a:b] += number - count[a]
            at, number = int(place[b - 1] + length[b - 1]), int(count[b - 1]) + 1
        yield pa.RecordBatch.from_arrays([path, start, batch.column("size"), batch.column("raw"), pa.array(place), batch.column("length"), pa.array(count)], names=["path", "range", "size", "raw", "at", "length", "number"])


def _plain(spark: SparkSession, root: str) -> DataFrame:
    """Lines of plain files: KEYS, raw (without LF), offset_start, offset_end, line_no (of the file).

    They are written to the shared folder before their offsets are known, so files that grow meanwhile change nothing.
    """
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", PLAIN).text(f"{root.rstrip('/')}/*/*/*")
    of = F.col("_metadata")
    rows = text.select(of["file_path"].alias("path"), of["file_block_start"].alias("range"), of["file_size"].alias("size"), F.col("value").cast("binary").alias("raw"), (F.octet_length("value") + 1).cast("long").alias("length"))
    rows = settled(rows.mapInArrow(_numbered, "path string, range long, size long, raw binary, at long, length long, number long"), "ranges")
    ranges = rows.groupBy("path", "range").agg(F.sum("length").alias("length"), F.count("*").alias("lines"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "range", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("_from"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("_lines"))
    start = F.col("_from") + F.col("at")
    # the last line may have no LF
    rows = rows.join(ranges, ["path", "range"]).select(*_parts("path"), "raw", start.alias("offset_start"), F.least(start + F.col("length"), F.col("size")).alias("offset_end"), (F.col("_lines") + F.col("number")).alias("line_no"))
    return rows.where(_shown())


PARTS = "tenant_id string, device_dir string, file_rel string, is_gzip boolean, offset long, path string, part int, start long, stop long, before long, error string"


def local(path: str) -> str:
    """A path of a mount, without its scheme."""
    if path.startswith("file:"):
        return unquote("/" + path.removeprefix("file:").lstrip("/"))
    if "://" in path:
        raise ValueError(f"not on a mount: {path}")
    return path


def _mounted(spark: SparkSession, root: str) -> bool:
    """Whether tasks can open the files under root themselves, and seek in them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def _known(files: DataFrame, cursors: DataFrame | None) -> DataFrame:
    """files with offset, where reading goes on."""
    if cursors is None:
        return files.withColumn("offset", F.lit(0).cast("long"))
    known = cursors.select(*KEYS, "offset")
    return files.join(F.broadcast(known) if known.count() <= MOST_BROADCAST else known, KEYS, "left").withColumn("offset", F.coalesce("offset", F.lit(0)))


def read_parts(spark: SparkSession, root: str, most: int = MOST_LINE, cursors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines with offsets and their number in the file, or in what was read of a compressed one; failures: KEYS and error).

    cursors (KEYS and offset): where to go on; absent files start at 0.  A compressed file that can't be read through gives a failure and no lines.
    """
    names = [c.split()[0] for c in LINES.split(", ")]

    def cut(batches):
        for batch in batches:
            start, end, since = (np.asarray(batch.column(c), np.int64) for c in ("offset_start", "offset_end", "offset"))
            skipped = np.maximum(since - start, 0)
            raw = batch.column("raw").to_pylist()
            line = [_text(r[k:] if k else r, most) for r, k in zip(raw, skipped.tolist())]
            columns = [*(batch.column(c) for c in KEYS), pa.array(start + skipped), pa.array(end), pa.array(np.zeros(len(start), bool)), pa.array(end - start - skipped), pa.array(line, pa.string()), batch.column("line_no")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = _known(_plain(spark, root), cursors).where(F.col("offset_end") > F.col("offset")).mapInArrow(cut, LINES)

    mounted = _mounted(spark, root)

    def planned(batches):
        """Parts that a task reads: groups of an archive's chunks, other files whole."""
        for pdf in batches:
            out = []
            for t, d, name, gz, offset, path in zip(pdf.tenant_id, pdf.device_dir, pdf.file_rel, pdf.is_gzip, pdf.offset, pdf.path):
                key = (t, d, name, gz, offset, path)
                try:
                    groups = [(-1, -1, -1)]
                    if name.endswith(".zlg"):
                        with open(local(path), "rb") as f:
                            groups = zlg_groups(f, offset)
                    out += [(*key, i, *g, None) for i, g in enumerate(groups)]
                except Exception as e:  # whatever a broken file makes its library say
                    out.append((*key, 0, -1, -1, -1, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")])

    def run(batches):
        for pdf in batches:
            data = pdf.content if "content" in pdf else [None] * len(pdf)
            for t, d, name, gz, offset, path, k, a, b, before, error, raw in zip(pdf.tenant_id, pdf.device_dir, pdf.file_rel, pdf.is_gzip, pdf.offset, pdf.path, pdf.part, pdf.start, pdf.stop, pdf.before, pdf.error, data):
                told = error
                try:
                    if not told:
                        with io.BytesIO(raw) if raw is not None else open(local(path), "rb") as f:
                            found = group_lines(f, (a, b, before), most) if a >= 0 else lines_of(name, f, most, offset)
                            lines = ((t, d, name, x, y, gz, n, line, i, k, None) for i, (x, y, n, line) in enumerate(found))
                            while some := list(islice(lines, BATCH)):
                                yield pd.DataFrame(some, columns=[*names, "part", "error"])
                except Exception as e:
                    told = f"{type(e).__name__}: {e}"
                if told:
                    yield pd.DataFrame([(t, d, name, 0, 0, gz, 0, None, -1, k, told)], columns=[*names, "part", "error"])

    packed = _known(discover(spark, root, content=not mounted, names=PACKED), cursors)
    if mounted:
        parts = packed.select(*KEYS, "is_gzip", "offset", "path").mapInPandas(planned, PARTS)
        # parts are rows of a few bytes, each much work: a number that is given is left alone by AQE
        parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "part")
    else:
        parts = packed.select(*KEYS, "is_gzip", "offset", "path", F.lit(0).alias("part"), *[F.lit(-1).cast("long").alias(c) for c in ("start", "stop", "before")], F.lit(None).cast("string").alias("error"), "content")
    found = settled(parts.mapInPandas(run, f"{LINES}, part int, error string"), "packed")
    failed = found.where("error IS NOT NULL").groupBy(*KEYS).agg(F.min("error").alias("error"))
    whole = found.where("error IS NULL").drop("error").join(failed.select(*KEYS), KEYS, "left_anti")
    # numbers go on over the parts of a file
    earlier = Window.partitionBy(*KEYS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = whole.groupBy(*KEYS, "part").agg(F.count("*").alias("_n")).select(*KEYS, "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_lines"))
    whole = whole.join(counts, [*KEYS, "part"]).withColumn("line_no", F.col("line_no") + F.col("_lines")).select(*names)
    return plain.unionByName(whole), failed


def read_lines(spark: SparkSession, root: str, most: int = MOST_LINE, cursors: DataFrame | None = None) -> DataFrame:
    """The lines of read_parts."""
    return read_parts(spark, root, most, cursors)[0]


def reconcile(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """files with offset and reason: where reading goes on.

    New files, a change between gzip and plain, another inode, and a plain file shorter than its offset start at 0; a
    compressed file whose size changed starts at 0 too.  files and cursors: tenant_id, device_dir, file_rel, is_gzip,
    inode, size; cursors also offset.
    """
    keys = ["tenant_id", "device_dir", "file_rel"]
    old = cursors.select(*keys, F.col("is_gzip").alias("_gzip"), F.col("inode").alias("_inode"), F.col("size").alias("_size"), F.col("offset").alias("_offset"))
    both = files.join(old, keys, "left")
    packed = F.col("is_gzip") | F.col("file_rel").endswith(".zlg")
    reason = (
        F.when(F.col("_offset").isNull(), "new").when(F.col("is_gzip") != F.col("_gzip"), "type").when(F.col("inode") != F.col("_inode"), "inode")
        .when(packed & (F.col("size") != F.col("_size")), "size").when(~packed & (F.col("size") < F.col("_offset")), "truncated").otherwise("resume")
    )
    both = both.withColumn("reason", reason)
    return both.withColumn("offset", F.when(F.col("reason") == "resume", F.col("_offset")).otherwise(0).cast("long")).drop("_gzip", "_inode", "_size", "_offset")


def advance(files: DataFrame, lines: DataFrame, read_ts: int) -> DataFrame:
    """Cursors after `lines` were read: the last offset of each file, at least the one it had (offset, if files have it), at most its
    size."""
    keys = KEYS
    ends = lines.groupBy(*keys).agg(F.max("offset_end").alias("_end"))
    before = F.col("offset") if "offset" in files.columns else F.lit(0)
    offset = F.least(F.greatest(F.coalesce("_end", F.lit(0)), before), F.col("size"))
    return files.join(ends, keys, "left").withColumns({"offset": offset.cast("long"), "last_read_ts": F.lit(read_ts)}).drop("_end")
