"""Periodic runs of words, by the suffix tree of each document.

`Tree` sorts the suffixes of many documents at once (prefix doubling, vectorised; the document is part of the first rank, so
each has a tree of its own) and reads the nodes off the common prefixes of neighbours: a node is a stretch of the suffix array,
and a node of many children joins them one by one.  At each join all leaves of the smaller part are looked up in the larger
one, d words (the depth of the node) before and after: such a pair is a branching tandem repeat, two equal stretches of d words
that no third word continues.  A leaf is in the smaller part log n times at most.  Rotating a repeat to the left by powers of two, for as
long as words d apart are equal, gives its run; repeats of one run with multiples of its period merge into one.

Each document is judged by itself: nothing is shuffled, and documents of any number go by in bounded batches.  Memory is about
200 bytes a word of the longest document.  Words are compared as they are, not by digests.

Defined cases: a null or empty text has no words and no runs; a very long text is one document like any other; repeated rows
are judged each; an empty table gives an empty result; extra columns stay and the result columns replace columns of the same
name.  Bytes outside ASCII are never white space.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy
from .kernels import chunks, utf8

#: A run has at least LEAST words and three periods.
LEAST, PERIODS = 24, 3
#: Leaves that are looked up at once.
LEAVES = 1 << 20
LONGS = ("n_words", "n_runs", "start", "length", "period", "exponent_milli")


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), first[1], ..."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - sizes), sizes)


class Tree:
    """Suffixes of documents: words as numbers, of all documents one after another; offs as of an Arrow list."""

    def __init__(self, words: np.ndarray, offs: np.ndarray):
        n = self.n = len(words)
        self.end = np.repeat(offs[1:], np.diff(offs))
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        key = doc * (int(words.max(initial=0)) + 1) + words
        self.order = order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = np.diff(key[order]) != 0
        #: Of each power of two: the rank of each suffix by that many words; equal words have the rank of their first place.
        self.ranks: list[np.ndarray] = []
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        step = 1
        while True:
            self.ranks.append(rank)
            alone = fresh.copy()
            alone[:-1] &= fresh[1:]
            at = np.flatnonzero(~alone)  # places in the order that are not settled
            if not len(at):
                break
            i = order[at]
            j = i + step
            after = np.where(j < self.end[i], rank[np.minimum(j, n - 1)].astype(np.int64) + 1, 0)
            key = rank[i].astype(np.int64) * (n + 1) + after
            by = np.argsort(key, kind="stable")
            order[at] = i[by]
            key = key[by]
            fresh[at[1:]] |= np.diff(key) != 0
            rank = rank.copy()
            rank[order[at]] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))[at]
            step *= 2
        self.place = self.ranks[-1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words two suffixes of one document begin with alike."""
        size = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            at = np.flatnonzero(np.maximum(a, b) + size < self.end[a])
            x = size[at]
            size[at] += (self.ranks[k][a[at] + x] == self.ranks[k][b[at] + x]).astype(np.int64) << k
        return size

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(depth, left, middle, right) of each join: the suffixes left..middle-1 and middle..right-1 of the order share `depth` words."""
        first = self.ranks[0][self.order]
        middle = np.flatnonzero(first[1:] == first[:-1]) + 1
        lcp = np.zeros(self.n + 1, np.int64)
        lcp[middle] = self.common(self.order[middle - 1], self.order[middle])
        return lcp[middle], nearest(lcp, middle, -1), middle, nearest(lcp, middle, 1)

    def tandems(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, d) of each branching tandem repeat: the d words from `place` on come twice, and no more."""
        depth, left, middle, right = self.nodes()
        small = middle - left <= right - middle  # which part is the smaller
        first, size = np.where(small, left, middle), np.where(small, middle - left, right - middle)
        low, high = np.where(small, middle, left), np.where(small, right, middle)
        found = [np.zeros((2, 0), np.int64)]
        upto, a = np.cumsum(size), 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] - size[a] + LEAVES, "right")))
            leaf = self.order[_ranges(first[a:b], size[a:b])]
            d, lo, hi = (np.repeat(x[a:b], size[a:b]) for x in (depth, low, high))
            for sign in (1, -1):
                other = leaf + sign * d
                at = np.flatnonzero((other >= 0) & (other < self.n))
                place = self.place[other[at]]
                at = at[(place >= lo[at]) & (place < hi[at])]
                found.append(np.stack([np.minimum(leaf[at], other[at]), d[at]]))
            a = b
        return tuple(np.concatenate(found, 1))

    def runs(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of each maximal run of two periods or more; starts: where the document of each word begins."""
        at, d = self.tandems()
        end, begin = at + 2 * d, starts[at] if len(at) else at
        for k in range(len(self.ranks) - 1, -1, -1):  # rotations by 2**k words: the words before are those d later
            back = at - (1 << k)
            can = np.flatnonzero(back >= begin)
            same = self.ranks[k][back[can]] == self.ranks[k][back[can] + d[can]]
            at[can[same]] = back[can[same]]
        order = np.lexsort((d, end, at))
        at, end, d = at[order], end[order], d[order]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 0) | (np.diff(end) != 0)
        return at[new], end[new], d[new]


def nearest(values: np.ndarray, at: np.ndarray, way: int) -> np.ndarray:
    """The nearest place before (way -1) with a smaller value, or after (way 1) with a smaller or equal one; `values` is 0 at both ends.

    Pointers follow the pointers of others, some rounds for all at once; what is left after them goes one by one with a stack.
    """
    point = np.arange(len(values)) + way
    todo = at
    for _ in range(64):
        there, own = values[point[todo]], values[todo]
        todo = todo[there >= own if way < 0 else there > own]
        if not len(todo):
            return point[at]
        point[todo] = point[point[todo]]
    listed, out, stack = values.tolist(), point, []
    for i in range(len(listed)) if way < 0 else range(len(listed) - 1, -1, -1):
        v = listed[i]
        while stack and (listed[stack[-1]] >= v if way < 0 else listed[stack[-1]] > v):
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out[at]


def runs_of(documents: list[list[bytes]], least: int = LEAST, periods: int = PERIODS) -> list[np.ndarray]:
    """Of each document the runs of `least` words and `periods` periods or more: rows (start, length, period) by start and period."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    offs = np.concatenate([[0], np.cumsum(sizes)])
    words = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(map(known.__getitem__, d), np.int64, len(d)) for d in documents]])
    if not len(words):
        return [np.zeros((0, 3), np.int64)] * len(documents)
    begin = np.repeat(offs[:-1], sizes)
    start, end, period = Tree(words, offs).runs(begin)
    long = end - start >= np.maximum(least, periods * period)
    start, end, period = start[long], end[long], period[long]
    rows = np.stack([start - begin[start] if len(start) else start, end - start, period], 1)
    order = np.lexsort((period, start))
    return np.split(rows[order], np.searchsorted(start[order], offs[1:-1]))


def summary(words: list[bytes], runs: np.ndarray) -> tuple:
    """Result columns of one document, and its words without repeated periods."""
    kept, best = words, (None,) * 4
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        ratio = runs[:, 1] / runs[:, 2]
        near = runs[ratio >= ratio.max() * (1 - 1e-9)].tolist()  # floats choose the few that are compared exactly
        start, length, period = max(near, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = start, length, period, 1000 * length // period
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
    text = b" ".join(kept)
    return (len(words), len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text)


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, periods: int = PERIODS, collapsed: bool = False, listed: bool = False) -> DataFrame:
    """docs without its text, with the figures of its runs; if asked for, with the text without repeated periods and the runs themselves."""
    run_type = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    new = [*[T.StructField(n, T.LongType()) for n in LONGS], T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]
    new += [T.StructField("collapsed", T.StringType())] * collapsed + [T.StructField("runs", run_type)] * listed
    given = docs.drop(*[f.name for f in new if f.name != text])
    kept = [f for f in given.schema.fields if f.name != text]
    schema = T.StructType([*kept, *new])

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column(text))
            for a, b in chunks(offs):
                own = [buf[offs[i] : offs[i + 1]].tobytes().split() for i in range(a, b)]
                found = runs_of(own, least, periods)
                made = [summary(w, r) for w, r in zip(own, found)]
                columns = [batch.column(f.name).slice(a, b - a) for f in kept]
                columns += [pa.array([m[k] for m in made], pa.int64() if k < len(LONGS) else pa.string()) for k in range(len(LONGS) + 2)]
                if collapsed:
                    columns.append(pa.array([m[-1] for m in made], pa.binary()).cast(pa.string()))
                if listed:
                    flat = np.concatenate(found)
                    rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), rows))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return given.mapInArrow(tidy(run), schema)


def woven(docs: DataFrame) -> DataFrame:
    """docs, where every tenth text (by the crc32 of its doc_id) repeats some of its words from a place on to its end.

    With h the crc32 and g = h div 10 of a text of n words, word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    Texts without words and rows without doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)))
    chosen = chosen.withColumn("_w", F.when(F.col("_g").isNotNull(), words)).withColumn("_n", F.size("_w").cast("long"))
    chosen = chosen.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    period = F.expr("1 + (_n - _a) div (3 + _g % 8)")
    again = F.concat_ws(" ", F.slice("_w", F.lit(1), F.col("_a").cast("int")), F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - F.col("_a") - 1), lambda i: F.element_at(F.col("_w"), (F.col("_a") + i % F.col("_p") + 1).cast("int"))))
    return chosen.withColumn("_p", period).withColumn("text", F.when(F.col("_a").isNotNull(), again).otherwise(F.col("text"))).drop("_g", "_w", "_n", "_a", "_p")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(woven(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
