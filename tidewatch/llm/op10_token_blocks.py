"""Token-ID output in patched frame-of-reference blocks.

A shard holds the ids of consecutive documents, cut into blocks of BLOCK ids.  A block stores its minimum, the
differences packed at the bit width that covers PERCENTILE of them, and the rest in an exception list (place and
high bits).  An index holds each block's start, so any block can be decoded alone.  Shards are rows of a Parquet
table in the shared folder: Spark's commit makes them whole or absent, and any store that Spark reads will do.

Documents are dealt out by ranges of doc_id (sampled splitters) and sorted, so partitions in order hold them in
ascending order.  Encoding goes piece by piece: each distinct piece of the tokenizer's pattern is encoded once by
the library, many to a call with an added token between them, and kept for later texts, of later tasks of the worker too (bounded).  Texts that hold an added token of the tokenizer file are encoded whole by the
library, so ids are those of its encode(text, add_special_tokens=False).

Defined cases: a null or empty text gives just the end id; a null doc_id sorts first; rows of equal doc_id are
ordered by a digest of the text; an empty table gives no shard; extra columns are not stored.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, shared_dir, table, tidy
from .kernels import blocks, utf8
from .pieces import Encoder

BLOCK, PERCENTILE, SHARD, END = 4096, 90, 1 << 20, 2
#: Magic and version of a shard.
MAGIC = b"TWTB0001"
_HEAD = np.dtype([("ids", "<u8"), ("docs", "<u8"), ("blocks", "<u8")])
_BLOCK = np.dtype([("least", "<u4"), ("count", "<u4"), ("width", "u1"), ("patch_width", "u1"), ("patches", "<u2")])


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values below 2**width, least bit first."""
    if not width or not len(values):
        return b""
    octets = values.astype("<u8").view(np.uint8).reshape(len(values), 8)[:, : (width + 7) // 8]
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes()


def unpack(raw: np.ndarray, width: int, count: int) -> np.ndarray:
    """Values of up to 56 bits, each out of the 8 bytes it starts in."""
    if not width or not count:
        return np.zeros(count, np.uint64)
    at = np.arange(count) * width
    return (blocks(raw[: (width * count + 7) // 8])[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


def encode_block(ids: np.ndarray) -> bytes:
    least = int(ids.min())
    rest = ids.astype(np.uint64) - np.uint64(least)
    width = int(np.percentile(rest, PERCENTILE, method="higher")).bit_length()
    high = rest >> np.uint64(width)
    at = np.flatnonzero(high)
    patch_width = int(high.max()).bit_length()
    head = np.array([(least, len(ids), width, patch_width, len(at))], _BLOCK)
    return b"".join([head.tobytes(), pack(rest & np.uint64((1 << width) - 1), width), at.astype("<u2").tobytes(), pack(high[at], patch_width)])


def decode_block(raw: np.ndarray) -> np.ndarray:
    head = raw[: _BLOCK.itemsize].view(_BLOCK)[0]
    n, width, k, patch = int(head["count"]), int(head["width"]), int(head["patches"]), int(head["patch_width"])
    at = _BLOCK.itemsize
    out = unpack(raw[at:], width, n)
    at += (width * n + 7) // 8
    if k:
        where = raw[at : at + 2 * k].copy().view("<u2")
        out[where] |= unpack(raw[at + 2 * k :], patch, k) << np.uint64(width)
    return (out + np.uint64(int(head["least"]))).astype(np.uint32)


def write_shard(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard: head, index of block starts, document table, blocks."""
    made = [encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    index = np.concatenate([[0], np.cumsum([len(b) for b in made])]).astype("<u8")
    docs = np.array([(-1 << 63) if d is None else d for d in doc_ids], "<i8")
    none = np.array([d is None for d in doc_ids], np.uint8)
    body = b"".join([np.array([(len(ids), len(doc_ids), len(made))], _HEAD).tobytes(), index.tobytes(), docs.tobytes(), none.tobytes(), counts.astype("<u4").tobytes(), *made])
    return b"".join([MAGIC, zlib.crc32(body).to_bytes(4, "little"), body])


class Shard:
    """Reads a shard; `ids(a, b)` decodes only the blocks that hold ids a to b."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC or zlib.crc32(blob[12:]) != int.from_bytes(blob[8:12], "little"):
            raise ValueError("not a whole shard")
        raw = np.frombuffer(blob, np.uint8)
        head = raw[12 : 12 + _HEAD.itemsize].view(_HEAD)[0]
        self.size, n, blocks = int(head["ids"]), int(head["docs"]), int(head["blocks"])
        at = 12 + _HEAD.itemsize
        self.index = raw[at : at + 8 * (blocks + 1)].copy().view("<u8").astype(np.int64)
        at += 8 * (blocks + 1)
        docs, none = raw[at : at + 8 * n].copy().view("<i8"), raw[at + 8 * n : at + 9 * n]
        self.doc_ids = [None if x else d for d, x in zip(docs.tolist(), none.tolist())]
        at += 9 * n
        self.counts = raw[at : at + 4 * n].copy().view("<u4").astype(np.int64)
        self.blocks = raw[at + 4 * n :]

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.size if b is None else b
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, (b - 1) // BLOCK
        got = [decode_block(self.blocks[self.index[i] : self.index[i + 1]]) for i in range(first, last + 1)]
        return np.concatenate(got)[a - first * BLOCK : b - first * BLOCK]


def separator(t) -> tuple[str, int] | None:
    """(string, id) of an added token of tokenizer t that may stand between pieces without touching their ids: it takes no spaces
    beside it, and neither it nor another added token can start in a piece and end in it, or the other way round."""
    added = {a.content: (i, a) for i, a in t.get_added_tokens_decoder().items() if a.content}
    for mark, (i, a) in added.items():
        apart = all(c == mark or (c not in mark and mark not in c) for c in added)
        apart &= not any(x[-k:] == y[:k] for c in added for x, y in ((c, mark), (mark, c)) for k in range(1, min(len(c), len(mark))))
        if apart and not (a.lstrip or a.rstrip or a.single_word or a.normalized) and t.normalizer is None and t.encode(mark, add_special_tokens=False).ids == [i]:
            return mark, i
    return None


#: How many pieces the library gets as one text, and how many such texts at once.
JOINED, TEXTS = 64, 64


@lru_cache(2)
def encoder(path: str) -> Encoder:
    t = library(path)[0]
    found = separator(t)

    def encode(pieces: list[bytes]) -> list[list[int]]:
        texts, out = [p.decode("utf-8") for p in pieces], []
        if found is None:
            for i in range(0, len(texts), 4096):
                out += [e.ids for e in t.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
            return out
        mark, own = found
        joined = [mark.join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
        for i in range(0, len(joined), TEXTS):
            for e in t.encode_batch_fast(joined[i : i + TEXTS], add_special_tokens=False):
                ids = e.ids
                ends = np.flatnonzero(np.array(ids) == own).tolist()
                out += [ids[a:b] for a, b in zip([0, *[x + 1 for x in ends]], [*ends, len(ids)])]
        return out

    return Encoder(encode)


@lru_cache(2)
def library(path: str):
    """(the tokenizer as it is in the file, the strings of its added tokens)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t, [a.content for a in t.get_added_tokens_decoder().values() if a.content]


#: How many texts with added tokens the library gets at once.
WHOLE = 64


def _whole(texts: pa.Array, rows: np.ndarray, path: str):
    """The ids of the texts in rows, each encoded by the library."""
    for i in range(0, len(rows), WHOLE):
        got = library(path)[0].encode_batch_fast(texts.take(pa.array(rows[i : i + WHOLE])).to_pylist(), add_special_tokens=False)
        yield from (np.array(e.ids, np.uint32) for e in got)


def encoded(batches, path: str, end: int):
    """(doc_ids, counts, ids with the end id) for successive documents."""
    for batch in batches:
        texts, added = batch.column("text"), np.zeros(batch.num_rows, bool)
        for content in library(path)[1]:
            added |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(added), "", texts) if added.any() else texts
        buf, offs = utf8(plain)
        ids = batch.column("doc_id")
        for row, flat, counts in encoder(path).texts(buf, offs):
            here = np.flatnonzero(added[row : row + len(counts)])
            if len(here):
                own = list(_whole(texts, row + here, path))
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                flat = np.insert(flat, np.repeat((np.cumsum(counts) - counts)[here], sizes), np.concatenate(own))
                counts[here] = sizes
            upto = np.cumsum(counts)
            out = np.insert(flat, upto, end)
            yield ids.slice(row, len(counts)).to_pylist(), counts + 1, out


def write_tokens(docs: DataFrame, path: str, end: int = END) -> str:
    """Writes the shards of docs (doc_id, text) and returns their folder."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    dealt = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(buckets(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        names, counts, flat, size = [], [], [], 0

        def shard():
            blob = write_shard(names, np.concatenate(counts), np.concatenate(flat))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "start", "size", "shard"])

        for doc_ids, n, ids in encoded(batches, path, end):
            names, size = names + doc_ids, size + len(ids)
            counts.append(n), flat.append(ids)
            if size >= SHARD:
                yield shard()
                seq, start = seq + 1, start + size
                names, counts, flat, size = [], [], [], 0
        if size:
            yield shard()

    dealt.mapInArrow(tidy(run), "part long, seq long, start long, size long, shard binary").write.parquet(out)
    return out


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards.  The driver sees one number a partition."""
    shards = spark.read.parquet(folder)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("size").alias("n")).collect())
    before, at = {}, 0
    for part, n in totals:
        before[part], at = at, at + n
    known = spark.sparkContext.broadcast(before)

    def run(batches):
        for batch in batches:
            for part, start, blob in zip(*(batch.column(c) for c in ("part", "start", "shard"))):
                s = Shard(blob.as_py())
                ids = s.ids().astype("<u4")
                upto = np.concatenate([[0], np.cumsum(s.counts)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(upto[:-1], upto[1:])]
                base = known.value[part.as_py()] + start.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(upto[:-1] + base), pa.array(s.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "start", "shard").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), vocabulary()))
