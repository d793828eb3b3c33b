"""Suffix-array dedup of substrings of 100 bytes or more.

Only suffixes that can matter are looked at: every 100-byte window picks the place of least digest among its 32-byte
substrings, so equal windows pick equal places, and one place in about 35 begins a suffix.  Splitters sampled from the
suffixes' leading bytes deal them out in ranges; each bucket sorts its suffixes by multikey quicksort over their leading
32 bytes, 8 bytes a key, where only ties go on to the next key.  Suffixes with equal leading bytes and equal digests of
all that their windows cover repeat each other; where the digests differ, `repeats` fetches the bytes, deals them out by
ranges again, sorts whole windows in the same way and compares neighbours, and what reaches the edges of a bucket meets
once more across the boundaries.  So do leading bytes that are so common that several splitters fall on them.

Removed are all bytes that a 100-byte string covers which also starts earlier: in a smaller doc_id or before in the
same document.  Defined cases: texts under 100 bytes and null texts lose nothing; a long text is looked at in
overlapping pieces; a null doc_id counts as the least; rows of one doc_id with different texts are ordered by a digest
of the text, rows that agree in both are one document, each with its result; an empty table gives an empty result; extra
columns stay with `dedup`, and the result columns replace columns of the same name.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import repeats
from .common import set_aside, table, tidy
from .kernels import CHUNK, Digests, blocks, mix, new_key

WINDOW, CORE = 100, 32
_REACH = WINDOW - CORE  # an anchor is at most so far after the window's start
_SEED = np.uint64(0x9E3779B97F4A7C15)


def records(buf: np.ndarray, offs: np.ndarray, key: int = 0):
    """Records of a batch; long texts are looked at in overlapping pieces, so memory is bounded."""
    row_ends = offs[1:]
    step = CHUNK - WINDOW + 1
    for c in range(0, max(0, len(buf) - WINDOW + 1), step):
        part = buf[c : c + CHUNK]
        n = len(part) - WINDOW + 1
        if n <= 0:
            break
        first, last = np.searchsorted(row_ends, c, "right"), np.searchsorted(offs, c + len(part), "left")
        inside = np.zeros(n + 1, np.int8)  # windows that end in their own text
        a = np.clip(offs[first:last] - c, 0, n)
        b = np.clip(row_ends[first:last] - c - WINDOW + 1, 0, n)
        fits = b > a
        np.add.at(inside, a[fits], 1)
        np.add.at(inside, b[fits], -1)
        p = np.flatnonzero(np.cumsum(inside[:n]))
        if not len(p):
            continue
        lane = blocks(part)
        at = np.arange(len(part) - CORE + 1)
        core = mix(lane[: len(at)] ^ _SEED)
        for k in range(8, CORE, 8):
            core = mix(core ^ lane[k : k + len(at)])
        place = (core & ~np.uint64(CHUNK - 1)) | at.astype(np.uint64)  # least digest, then leftmost
        reach = 1
        while 2 * reach <= _REACH + 1:
            place = np.minimum(place[:-reach], place[reach:])
            reach *= 2
        place = np.minimum(place[:n], place[_REACH + 1 - reach : _REACH + 1 - reach + n])
        anchor = (place & np.uint64(CHUNK - 1)).astype(np.int64)[p]
        new = np.ones(len(p), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(p) != 1)
        lo = p[new]
        hi = p[np.append(np.flatnonzero(new)[1:], len(p)) - 1]
        anchor = anchor[new]
        cover = mix(Digests(part, key).of(lo, hi + WINDOW, 1) + ((anchor - lo) * 256 + (anchor - hi)).astype(np.uint64))
        lead = np.stack([lane[anchor + k].byteswap() for k in range(0, CORE, 8)], 1)
        row = np.searchsorted(offs, lo + c, "right") - 1
        yield row, lead, cover, anchor + c - offs[row], (anchor - lo).astype(np.uint16), (anchor - hi).astype(np.uint16), np.full(len(lo), CORE, np.uint16)


def payload(text: bytes, anchor: np.ndarray, before: np.ndarray, last: np.ndarray, size: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    starts, ends = (anchor - before).tolist(), (anchor - last + WINDOW).tolist()
    return [text[a : a + CORE] for a in anchor.tolist()], [text[a:b] for a, b in zip(starts, ends)]


def compare(cover: list[bytes], n: np.ndarray, key: int = 0):
    raw = np.frombuffer(b"".join(cover) + bytes(8), np.uint8)
    sizes = np.fromiter(map(len, cover), np.int64, len(cover))
    starts = np.repeat(np.cumsum(sizes) - sizes, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wide = -(-WINDOW // 8) * 8
    matrix = np.lib.stride_tricks.sliding_window_view(raw, wide)[starts] if len(starts) else np.zeros((0, wide), np.uint8)
    matrix[:, WINDOW:] = 0
    keys = matrix.view(">u8").astype(np.uint64)
    order, along = repeats.multikey_order(keys)
    group = np.empty(len(order), np.int64)
    group[order] = along

    def digests(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = starts[chosen]
        return tuple(Digests(raw, key).of(a, a + WINDOW, seed) for seed in (2, 3))

    return group, digests


KIND = repeats.Kind(WINDOW, records, payload, compare, within=True, keys=CORE // 8, ranges=True)


def dedup(docs: DataFrame, name: str = "suffixes", texts: bool = True) -> DataFrame:
    """docs without text, with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the bytes left."""
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    new += [T.StructField("kept", T.BinaryType())] * texts
    given, back = set_aside(docs.drop(*[f.name for f in new]), "recs", "spans", "dk", "tk")
    key = new_key()
    kind = dataclasses.replace(KIND, records=functools.partial(records, key=key), compare=functools.partial(compare, key=key))
    found = repeats.with_spans(given, kind, name)
    kept_columns = [f for f in given.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in new]
            for text, recs, spans in zip(*(batch.column(c) for c in ("text", "recs", "spans"))):
                raw = (text.as_py() or "").encode("utf-8")
                a, b = repeats.ranges(recs.as_py(), spans.as_py(), WINDOW)
                left = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)])) if len(a) else raw
                row = [len(raw), len(raw) - len(left), len(a), hashlib.sha256(left).hexdigest(), left]
                for column, v in zip(out, row):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept_columns], *[pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]], names=[f.name for f in [*kept_columns, *new]])

    return found.mapInArrow(tidy(run), T.StructType([*kept_columns, *new])).withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
