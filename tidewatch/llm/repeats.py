"""Exact search for windows that repeat across a corpus, shared by the two substring operators.

A text is a sequence of units; every window of W units picks an anchor inside itself by its own content only, so
equal windows pick it at the same offset.  Neighbouring windows with one anchor make a record: the digest of the
anchor's core, the digest of all that its windows cover, and where.  Then

1. records meet by core: in ranges of its leading units between sampled splitters (`ranges`), or by its digest.  A core met
   once repeats nowhere.  Records that agree in core and cover are one class: all but its first are repeats, and before the
   shuffle each task already keeps one record of a class.
2. where one core has several classes, the units themselves decide: the first record of each class fetches its
   text, suffixes from the anchors on are dealt out by sampled splitters over their leading units, each bucket sorts
   its windows and compares neighbours, and windows of a hot core that reaches a bucket's edge meet once more by
   digest, so a core of any size may spread over buckets.

Positions are row-wise: (dk, tk, place), where dk is doc_id (a null is the least value) and tk a digest of the text.
Rows equal in both are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, doc_key, settled, tidy
from .kernels import mix, utf8

#: Records that a task holds before it deals them out; and windows that a bucket compares at once.
FLUSH, BLOCK = 400_000, 60_000
#: Document keys up to this number are broadcast to pick texts; beyond it the join is shuffled.
MOST_BROADCAST = 2_000_000

#: Splitters are read off from up to so many sampled documents, each with so many records at most.
SAMPLED, EACH = 4000, 64


def record(keys: int) -> list:
    """before: anchor - first window start; last: anchor - last window start; size: units of the core, from the anchor on."""
    return [("core", np.uint64, (keys,)), ("cover", np.uint64), ("doc", np.int64), ("tie", np.int64), ("anchor", np.int64), ("before", np.uint16), ("last", np.uint16), ("size", np.uint16)]


@dataclass(frozen=True)
class Kind:
    """What the two operators differ in."""

    window: int
    #: (bytes, offsets) -> records as (rows, core, cover, anchor, before, last, size), rows of this batch; core: its digest, or
    #: the keys of its leading units in their order
    records: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, ...]]]
    #: (text bytes, anchors, before, last, size) -> (leading units, covered units) of each record
    payload: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[list[bytes], list[bytes]]]
    #: (covered units of records, numbers of their windows) -> group of each window: equal windows, equal numbers;
    #: and what gives two digests of chosen windows
    compare: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]]]
    #: whether a repeat inside one document counts
    within: bool
    #: cores with more records to compare than this spread over buckets; others are in one whole
    hot: int = 2000
    #: numbers that make a core, and whether records are dealt out in ranges of the first
    keys: int = 1
    ranges: bool = False


#: In the size of a record's core: it is hot.
HOT = np.uint16(0x8000)


def squeeze(arrays: list[np.ndarray]) -> bytes:
    head = np.array([a.nbytes for a in arrays], np.uint64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def expand(blob: bytes, types: list) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.uint64, len(types)).astype(np.int64)
    at = 8 * len(types) + np.concatenate([[0], np.cumsum(sizes)])
    return [np.frombuffer(raw, t, int(n) // np.dtype(t).itemsize, int(a)) for t, n, a in zip(types, sizes, at)]


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group along the order) of the rows of a matrix of keys: three-way quicksort by one key at a time, for all
    ranges at once; a range leaves the sort as soon as it has one row."""
    n, width = keys.shape
    order = np.argsort(keys[:, 0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = np.diff(keys[order, 0]) != 0
    for c in range(1, width):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        range_ = np.cumsum(new)[at]
        key = keys[order[at], c]
        sub = np.lexsort((key, range_))
        order[at] = order[at][sub]
        key = key[sub]
        cut = np.ones(len(at), bool)
        cut[1:] = (range_[1:] != range_[:-1]) | (key[1:] != key[:-1])
        new[at] |= cut
    return order, np.cumsum(new) - 1


_DEALT = [np.int64, np.int64, np.uint32, np.uint64, np.uint64, np.uint32, np.uint16, np.uint16, np.uint16]


def _first_of(groups: list[np.ndarray], r: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, class number along the order, whether each along the order repeats an earlier record).

    Within: all but the first place of a class repeat; else all that are not of its least doc_id."""
    keys = [r["anchor"], r["tie"], r["doc"], *groups]
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for g in groups:
            new[1:] |= g[order][1:] != g[order][:-1]
    number = np.cumsum(new) - 1
    doc, first = r["doc"][order], np.flatnonzero(new)
    again = doc > doc[first][number]
    if within:
        tie, anchor = r["tie"][order], r["anchor"][order]
        again |= (tie != tie[first][number]) | (anchor != anchor[first][number])
    return order, number, again


def _cores(core: np.ndarray) -> np.ndarray:
    """One number for each core, in the order of cores."""
    if core.shape[1] == 1:
        return core[:, 0]
    order, along = multikey_order(core)
    out = np.empty(len(order), np.uint64)
    out[order] = along
    return out


def _splitters(texts: DataFrame, kind: Kind, n: int) -> np.ndarray:
    """n - 1 quantiles of the first keys of sampled documents; a key that several fall on is common."""
    sampled = texts.sample(min(1.0, SAMPLED / max(1, texts.count())), 7)

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column("text"))
            for rows, core, *_ in kind.records(buf, offs):
                new = np.flatnonzero(np.diff(rows, prepend=-1))
                chosen = (np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))) < EACH
                yield pa.RecordBatch.from_arrays([pa.array((core[chosen, 0] ^ np.uint64(1 << 63)).view(np.int64))], names=["key"])

    got = sampled.select("text").mapInArrow(tidy(run), "key long").agg(F.percentile_approx("key", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(10_000)).alias("q")).first()["q"] if n > 1 else None
    return np.array(got or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _dealt_to(splitters: np.ndarray | None, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of buckets that hold its core) of each record."""
    key = r["core"][:, 0]
    if splitters is None:
        return key % np.uint64(n), np.ones(len(r), np.int64)
    low, high = np.searchsorted(splitters, key, "left"), np.searchsorted(splitters, key, "right")
    over = np.maximum(high - low, 1)  # the buckets that end with this key: it is so common that several splitters fall on it
    return low.astype(np.uint64) + mix(r["cover"]) % over.astype(np.uint64), over  # equal covers meet


def _deal(kind: Kind, n: int, splitters: np.ndarray | None):
    """Mapper: documents to record blobs by bucket; repeats inside the task are told apart at once."""

    def flush(parts: list[np.ndarray]):
        r = np.concatenate(parts)
        order, _, again = _first_of([r["cover"], _cores(r["core"])], r, kind.within)
        repeat = np.zeros(len(r), bool)
        repeat[order] = again
        # a repeat needs no comparison: it goes to a bucket by its document
        bucket = np.where(repeat, mix(r["doc"].astype(np.uint64)) % np.uint64(n), _dealt_to(splitters, r, n)[0])
        order = np.lexsort((r["anchor"], r["tie"], r["doc"], repeat, bucket))
        r, repeat, bucket = r[order], repeat[order], bucket[order]
        edge = np.flatnonzero((np.diff(bucket.astype(np.int64)) != 0) | (np.diff(repeat.astype(np.int8)) != 0)) + 1
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip([0, *edge], [*edge, len(r)]):
            s = r[a:b]
            new = np.ones(len(s), bool)
            new[1:] = (s["doc"][1:] != s["doc"][:-1]) | (s["tie"][1:] != s["tie"][:-1])
            docs = np.flatnonzero(new)
            done = bool(repeat[a])
            core = s["core"][:0] if done else s["core"]
            cover = s["cover"][:0] if done else s["cover"]
            out[0].append(int(bucket[a])), out[1].append(done)
            out[2].append(squeeze([s["doc"][docs], s["tie"][docs], np.diff(np.append(docs, len(s))).astype(np.uint32), core, cover, s["anchor"].astype(np.uint32), s["before"], s["last"], s["size"]]))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.binary())], names=["bucket", "done", "blob"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            buf, offs = utf8(batch.column("text"))
            dk, tk = batch.column("dk").to_numpy(), batch.column("tk").to_numpy()
            for rows, core, cover, *places in kind.records(buf, offs):
                r = np.empty(len(rows), record(kind.keys))
                for name, values in zip(r.dtype.names, (core.reshape(-1, kind.keys), cover, dk[rows], tk[rows], *places)):
                    r[name] = values
                parts.append(r)
                held += len(r)
                if held >= FLUSH:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


def _by_doc(r: np.ndarray, chosen: np.ndarray, state: int, out: dict) -> None:
    """Adds a row for each document with chosen records: state 0 repeats, 1 to be compared."""
    s = r[chosen]
    s = s[np.lexsort((s["anchor"], s["tie"], s["doc"]))]
    new = np.ones(len(s), bool)
    new[1:] = (s["doc"][1:] != s["doc"][:-1]) | (s["tie"][1:] != s["tie"][:-1])
    at = np.flatnonzero(new)
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(s)]):
        out["dk"].append(int(s["doc"][a])), out["tk"].append(int(s["tie"][a])), out["state"].append(state)
        out["recs"].append(np.stack([s[c][a:b] for c in ("anchor", "before", "last", "size")]).astype("<u4").tobytes())


_ROWS = "dk long, tk long, state int, recs binary"


def _rows(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out["dk"], pa.int64()), pa.array(out["tk"], pa.int64()), pa.array(out["state"], pa.int32()), pa.array(out["recs"], pa.binary())], names=["dk", "tk", "state", "recs"])


def _classify(kind: Kind, splitters: np.ndarray | None):
    """Reducer: all records of a core; tells repeats and records that need their text."""

    def run(batches):
        parts, done = [], []
        for batch in batches:
            for flag, blob in zip(batch.column("done"), batch.column("blob")):
                docs, ties, counts, core, cover, *places = expand(blob.as_py(), _DEALT)
                r = np.zeros(len(places[0]), record(kind.keys))
                r["doc"], r["tie"] = np.repeat(docs, counts), np.repeat(ties, counts)
                r["anchor"], r["before"], r["last"], r["size"] = places
                if flag.as_py():
                    done.append(r)
                else:
                    r["core"], r["cover"] = core.reshape(-1, kind.keys), cover
                    parts.append(r)
        out: dict = {"dk": [], "tk": [], "state": [], "recs": []}
        repeats = done
        if parts:
            r = np.concatenate(parts)
            del parts
            cores = _cores(r["core"])
            order, number, again = _first_of([r["cover"], cores], r, kind.within)
            s, cores, over = r[order], cores[order], _dealt_to(splitters, r, 1)[1][order]
            core_new = np.ones(len(s), bool)
            core_new[1:] = cores[1:] != cores[:-1]
            core = np.cumsum(core_new) - 1
            first = np.flatnonzero(core_new)
            classes = number[np.append(first[1:], len(s)) - 1] - number[first] + 1
            open_ = ~again & ((classes[core] > 1) | (over > 1))  # the other buckets may have other classes
            s["size"][np.bincount(core, open_)[core] * over > kind.hot] |= HOT
            _by_doc(s, np.flatnonzero(open_), 1, out)
            repeats = [*done, s[again]]
        if repeats and (r := np.concatenate(repeats)).size:
            _by_doc(r, np.arange(len(r)), 0, out)
        if out["dk"]:
            yield _rows(out)

    return run


def _fetch(kind: Kind):
    """The units of the records to be compared."""

    def run(batches):
        for batch in batches:
            for dk, tk, text, blobs in zip(*(batch.column(c) for c in ("dk", "tk", "text", "recs"))):
                anchor, before, last, size = np.concatenate([np.frombuffer(b, "<u4").reshape(4, -1) for b in blobs.as_py()], 1).astype(np.int64)
                hot, size = size >= int(HOT), size & (int(HOT) - 1)
                lead, cover = kind.payload((text.as_py() or "").encode("utf-8"), anchor, before, last, size)
                n = len(lead)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead, pa.binary()), pa.array(hot), pa.array([dk.as_py()] * n, pa.int64()), pa.array([tk.as_py()] * n, pa.int64()), pa.array(anchor - before), pa.array(before - last + 1), pa.array(cover, pa.binary())], names=["lead", "hot", "dk", "tk", "start", "n", "cover"]
                )

    return run


_WINDOWS = "dk long, tk long, at long, n long, d1 long, d2 long"


def _compare(kind: Kind):
    """A bucket of suffixes: windows that repeat (d1 null), and firsts of cores that reach the bucket's edge."""

    def block(lead, dk, tk, start, n, cover, edges):
        # windows of whole cores
        rec = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n) + start[rec]
        group, digests = kind.compare(cover, n)
        r = np.zeros(len(rec), record(1))
        r["doc"], r["tie"], r["anchor"] = dk[rec], tk[rec], at
        order, _, again = _first_of([group], r, kind.within)
        repeat = np.zeros(len(rec), bool)
        repeat[order] = again
        edge = np.fromiter((x in edges for x in lead), bool, len(lead))[rec] & ~repeat
        # neighbouring repeats of a record become one row
        w = np.flatnonzero(repeat)
        cut = np.ones(len(w), bool)
        cut[1:] = (np.diff(w) != 1) | (np.diff(rec[w]) != 0)
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(w)))
        w = w[first]
        e = np.flatnonzero(edge)
        both = np.concatenate([w, e])
        d1, d2 = (pa.concat_arrays([pa.nulls(len(w), pa.int64()), pa.array(d.view(np.int64))]) for d in digests(e))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(dk[rec[both]]), pa.array(tk[rec[both]]), pa.array(at[both]), pa.array(np.concatenate([size, np.ones(len(e), np.int64)])), d1, d2,
            ],
            names=["dk", "tk", "at", "n", "d1", "d2"],
        )

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        table = table.sort_by([("lead", "ascending")])
        lead, cover = table["lead"].to_pylist(), table["cover"]
        dk, tk, start, n = (table[c].to_numpy() for c in ("dk", "tk", "start", "n"))
        hot = table["hot"].to_pylist()
        edges = {lead[i] for i in (0, -1) if hot[i]}
        a = 0
        while a < len(lead):  # blocks end where a core ends
            b, windows = a, 0
            while b < len(lead) and (windows < BLOCK or lead[b] == lead[b - 1]):
                windows += int(n[b])
                b += 1
            yield from block(lead[a:b], dk[a:b], tk[a:b], start[a:b], n[a:b], cover.slice(a, b - a).to_pylist(), edges)
            a = b

    return run


def repeated(docs: DataFrame, kind: Kind, name: str) -> DataFrame:
    """dk, tk, spans (array of start, n: windows start..start+n-1 repeat) of documents with repeats."""
    spark = docs.sparkSession
    n = buckets(spark)
    texts = docs.select(doc_key().alias("dk"), F.xxhash64("text").alias("tk"), "text")
    splitters = _splitters(texts, kind, n) if kind.ranges else None
    dealt = texts.mapInArrow(tidy(_deal(kind, n, splitters)), "bucket int, done boolean, blob binary").repartitionById(n, F.col("bucket"))
    known = settled(dealt.mapInArrow(tidy(_classify(kind, splitters)), _ROWS), f"{name}-classes")
    open_ = known.where("state = 1").groupBy("dk", "tk").agg(F.collect_list("recs").alias("recs"))
    keys = known.where("state = 1").select("dk").distinct()
    few = keys.count() <= MOST_BROADCAST
    picked = texts.join(F.broadcast(keys), "dk", "left_semi") if few else texts
    fetched = picked.join(open_, ["dk", "tk"])
    suffixes = fetched.select("dk", "tk", "text", "recs").mapInArrow(tidy(_fetch(kind)), "lead binary, hot boolean, dk long, tk long, start long, n long, cover binary")
    spread = [F.when(F.col("hot"), F.col(c)) for c in ("dk", "tk", "start")]
    compared = settled(suffixes.repartitionByRange(n, "lead", *spread).mapInArrow(tidy(_compare(kind)), _WINDOWS), f"{name}-windows")
    # across boundaries: firsts of a window in several buckets
    order = Window.partitionBy("d1", "d2").orderBy("dk", "tk", "at")
    met = compared.where("d1 IS NOT NULL").withColumns({"k": F.rank().over(order), "low": F.first("dk").over(order)})
    met = met.where("k > 1" if kind.within else "dk > low")
    none = F.lit(None).cast("binary")
    span = F.struct(F.col("at").alias("start"), "n").alias("span")
    parts = met.select("dk", "tk", none.alias("recs"), span).unionByName(compared.where("d1 IS NULL").select("dk", "tk", none.alias("recs"), span))
    parts = parts.unionByName(known.where("state = 0").select("dk", "tk", "recs"), allowMissingColumns=True)
    return parts.groupBy("dk", "tk").agg(F.collect_list("recs").alias("recs"), F.collect_list("span").alias("spans"))


def ranges(recs: list[bytes] | None, spans: list[dict] | None, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted disjoint (starts, ends) of the units that repeated windows cover."""
    starts = [np.zeros(0, np.int64)]
    ends = [np.zeros(0, np.int64)]
    for blob in recs or ():
        anchor, before, last, _ = np.frombuffer(blob, "<u4").reshape(4, -1).astype(np.int64)
        starts.append(anchor - before), ends.append(anchor - last + window)
    if spans:
        a, n = np.array([(x["start"], x["n"]) for x in spans], np.int64).T
        starts.append(a), ends.append(a + n - 1 + window)
    a, b = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:], len(a)) - 1] if len(a) else b


def with_spans(docs: DataFrame, kind: Kind, name: str) -> DataFrame:
    """docs with the columns recs and spans for `ranges`; null where nothing repeats."""
    keyed = docs.withColumns({"dk": doc_key(), "tk": F.xxhash64("text")})
    return keyed.join(repeated(docs, kind, name), ["dk", "tk"], "left").drop("dk", "tk")
