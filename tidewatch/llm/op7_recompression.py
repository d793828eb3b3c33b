"""Substring dedup of windows of 13 words by recompression.

Words are symbols.  The first round names runs of one symbol, and each round names pairs: a symbol's name decides
globally whether it is a left or a right half, and a left half next to a right one becomes a new symbol.  A name is a
64-bit digest (with a key drawn for the run) of what it stands for, so it is global without a dictionary, and equal word sequences get equal symbols
but for their ends.  How far the ends reach is kept with every symbol: its context is all words that its shape depends on.
A window picks, among symbols whose whole context it holds, one of the highest level, then of least name; such a
symbol and its context are the same wherever the window's words stand.  `repeats` then meets shared symbols and their
contexts across the corpus; equal digests of all that a symbol's windows cover reveal long repeats, and where one
context stands in several surroundings the words themselves are compared.

Removed are words covered by a window that also starts in a document with a smaller doc_id.  Defined cases: texts of
fewer than 13 words and null texts lose nothing; a null doc_id counts as the least; rows of one doc_id don't repeat
each other; an empty table gives an empty result; extra columns stay with `dedup`, and the
result columns replace columns of the same name.
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
from .kernels import Digests, chunks, mix, new_key, sequences, spans, word_table

WINDOW, ROUNDS = 13, 3
#: Words of one piece of a long text; pieces overlap by a window.
PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: The context of a symbol that depends on where a piece starts; no window holds it.
_NEVER = -(1 << 40)


def parse(name: np.ndarray, piece: np.ndarray):
    """Yields (name, context start, context end inclusive) of each level's symbols, from words on.

    Contexts of one level have distinct starts.  A context that reaches beyond a piece is never inside a window."""
    n = len(name)
    left = right = np.arange(n)
    yield name, left, right
    # runs: whether two neighbours are of one run depends on them alone
    joined = np.zeros(n, bool)
    joined[1:] = (name[1:] == name[:-1]) & (piece[1:] == piece[:-1])
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], n) - 1
    size = (last - first + 1).astype(np.uint64)
    name = np.where(size > 1, mix(name[first] + size * np.uint64(0xA24BAED4963EE407)), name[first])
    piece, left, right = piece[first], first - 1, last + 1
    for level in range(1, ROUNDS + 1):
        n = len(name)
        half = mix(name + np.uint64(level * 0x9E3779B9)) & np.uint64(1)  # 0: left, 1: right
        pair = np.zeros(n + 1, bool)  # symbol i and the one before are a pair
        pair[1:n] = (half[:-1] == 0) & (half[1:] == 1) & (piece[1:] == piece[:-1])
        first = np.flatnonzero(~pair[:n])
        two = pair[first + 1]
        last = first + two
        # an unpaired right half looked at its left neighbour, an unpaired left half at its right one
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
        looked_left, looked_right = ~two & (half[first] == 1), ~two & (half[first] == 0)
        beside_left = (first > 0) & (piece[before] == piece[first])
        beside_right = (last < n - 1) & (piece[after] == piece[first])
        lo = np.where(looked_left, np.where(beside_left, left[before], _NEVER), left[first])
        hi = np.where(looked_right, np.where(beside_right, right[after], -_NEVER), right[last])
        name = np.where(two, mix(name[first] * np.uint64(0xD6E8FEB86659FD93) + name[last]), name[first])
        piece, left, right = piece[first], lo, hi
        yield name, left, right


def anchors(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, last window, context start, context end) of runs of windows with one symbol, for pieces that start and
    end at `bounds`."""
    n = len(h)
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][piece]
    free = np.arange(n) + WINDOW <= end  # windows without a symbol yet
    begin = bounds[:-1][piece]
    levels = list(parse(h, piece))
    owner = np.full(n, -1, np.int64)
    lo_of, hi_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level in range(ROUNDS, -1, -1):
        if not free.any():
            break
        name, left, right = levels[level]
        upto = np.concatenate([[0], np.cumsum(free)])
        use = (left >= 0) & (right < n) & (right - left < WINDOW)
        some = upto[np.clip(left, 0, n - 1) + 1] > upto[np.clip(right - WINDOW + 1, 0, n)]
        k = np.flatnonzero(use & some)
        left, right, name = left[k], right[k], name[k]
        best = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        key = (mix(name) & ~_PLACE) | left.astype(np.uint64)
        for o in range(WINDOW):
            p = left - o
            ok = np.flatnonzero((p >= 0) & (right - p < WINDOW))
            if not len(ok):
                break
            q = p[ok]
            fits = free[q] & (begin[left[ok]] == begin[q])
            q, kk = q[fits], key[ok[fits]]
            best[q] = np.minimum(best[q], kk)
        got = np.flatnonzero(best != np.uint64(0xFFFFFFFFFFFFFFFF))
        at = (best[got] & _PLACE).astype(np.int64)
        ends = np.zeros(n, np.int64)
        ends[left] = right
        owner[got] = at * (ROUNDS + 1) + level
        lo_of[got], hi_of[got] = at, ends[at]
        free[got] = False
    p = np.flatnonzero(owner >= 0)
    new = np.ones(len(p), bool)
    new[1:] = (owner[p[1:]] != owner[p[:-1]]) | (np.diff(p) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    if not len(p):
        first = last = np.zeros(0, np.int64)
    return p[first], p[last], lo_of[p[first]], hi_of[p[first]] + 1


def records(buf: np.ndarray, offs: np.ndarray, key: int = 0):
    for a, b in chunks(offs):
        own, o = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        starts, ends, row = spans(own, o, word_table())
        if not len(starts):
            continue
        h_all = Digests(own, key).of(starts, ends)
        g_all = Digests(own, key).of(starts, ends, 1)
        before = np.cumsum(np.bincount(row, minlength=b - a)) - np.bincount(row, minlength=b - a)
        for s in range(0, len(h_all), PIECE):  # one pass, but for a text of over PIECE words
            e = min(len(h_all), s + PIECE + WINDOW - 1)
            h, g, r = h_all[s:e], g_all[s:e], row[s:e]
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]])
            lo, hi, left, right = anchors(h, bounds)
            core = sequences(h, left, right)
            cover = mix(sequences(g, lo, hi + WINDOW, 1) + (((left - lo) * 64 + (left - hi)) * 64 + right - left).astype(np.uint64))
            rows = r[lo]
            yield rows + a, core, cover, left + s - before[rows], (left - lo).astype(np.uint16), (left - hi).astype(np.uint16), (right - left).astype(np.uint16)
            if e == len(h_all):
                break


def payload(text: bytes, anchor: np.ndarray, before: np.ndarray, last: np.ndarray, size: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    words = text.split()  # at the six ASCII white-space bytes
    lead = [b" ".join(words[a : a + k]) for a, k in zip(anchor.tolist(), size.tolist())]
    return lead, [b" ".join(words[a:b]) for a, b in zip((anchor - before).tolist(), (anchor - last + WINDOW).tolist())]


def compare(cover: list[bytes], n: np.ndarray):
    seen: dict[bytes, int] = {}
    group = np.empty(int(n.sum()), np.int64)
    at = 0
    for text, k in zip(cover, n.tolist()):
        words = text.split(b" ")
        for i in range(k):
            group[at] = seen.setdefault(b" ".join(words[i : i + WINDOW]), len(seen))
            at += 1
    names = list(seen)

    def digests(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(hashlib.blake2b(names[g], digest_size=16).digest() for g in group[chosen].tolist())
        both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])

    return group, digests


KIND = repeats.Kind(WINDOW, records, payload, compare, within=False)


def dedup(docs: DataFrame, name: str = "symbols", texts: bool = True) -> DataFrame:
    """docs without text, with n_words, n_removed, kept_sha256 and, if asked for, kept: the words left, one space between."""
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    new += [T.StructField("kept", T.StringType())] * texts
    given, back = set_aside(docs.drop(*[f.name for f in new]), "recs", "spans", "dk", "tk")
    kind = dataclasses.replace(KIND, records=functools.partial(records, key=new_key()))
    found = repeats.with_spans(given, kind, name)
    kept_columns = [f for f in given.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, recs, spans_ in zip(*(batch.column(c) for c in ("text", "recs", "spans"))):
                words = (text.as_py() or "").encode("utf-8").split()
                a, b = repeats.ranges(recs.as_py(), spans_.as_py(), WINDOW)
                left = [w for x, y in zip([0, *b.tolist()], [*a.tolist(), len(words)]) for w in words[x:y]] if len(a) else words
                kept = b" ".join(left)
                for column, v in zip(out, (len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if texts else None)):
                    column.append(v)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept_columns], *columns[: len(new)]], names=[f.name for f in [*kept_columns, *new]])

    return found.mapInArrow(tidy(run), T.StructType([*kept_columns, *new])).withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
