"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Texts are cut by the tokenizer's pattern, vectorised over code points.  The distinct pieces of a partition become
token-position rows of a recursive query (w: piece, p: place, q: place of the next): each round joins neighbouring rows with
the merge table and contracts the leftmost pair of least rank of each piece, until no piece has a pair in the table.  Decoding joins the ids of
a document with the vocabulary and aggregates the bytes in order of position.

A query runs ROUNDS rounds at most and the next one goes on from its result, so the rows of past rounds are given up.
A piece of over LONG bytes without white space (none in ordinary text) needs about as many rounds as it has bytes, each
over all of them; it is contracted by a heap instead, with the same result.  Pieces met before in a task are kept, a
bounded number; a task gives its DuckDB up when it ends, and DuckDB never writes to disk.

Defined cases: a null or empty text has no ids and decodes to nothing; a very long text is cut at white characters where
a piece surely starts, and decoded in parts of ROWS ids; repeated rows are encoded each; an empty table gives an empty result; extra columns stay and the
result columns replace columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import give_back, table, tidy
from .kernels import utf8
from .pieces import Encoder

LONG, ROUNDS = 1024, 48
#: Bytes of the pieces of one recursive query, and token rows in one decoding query; they bound DuckDB's memory.
BYTES, ROWS = 80_000, 100_000

ENCODE = """
WITH RECURSIVE t(w, p, q, tok, r) AS (
    SELECT w, p, p + 1, tok, 0 FROM given
  UNION ALL (
    WITH m AS (SELECT a.w, a.p, a.q, b.q AS after, a.tok, a.r, g.made
        FROM t a LEFT JOIN t b ON b.w = a.w AND b.p = a.q LEFT JOIN merges g ON g.pair = (a.tok::BIGINT << 32) + b.tok),
    best AS (SELECT w, min((made::BIGINT << 40) + (p::BIGINT << 20) + q) AS x FROM m WHERE made IS NOT NULL GROUP BY w),
    c AS (SELECT w, (x >> 20) & 1048575 AS l, x & 1048575 AS r FROM best)
    SELECT m.w, m.p, CASE WHEN m.p = c.l THEN m.after ELSE m.q END, CASE WHEN m.p = c.l THEN m.made ELSE m.tok END, m.r + 1
    FROM m JOIN c USING (w) WHERE m.r < $rounds AND m.p <> c.r
  )
)
SELECT w, tok, r FROM t JOIN (SELECT w, max(r) AS r FROM t GROUP BY w) USING (w, r) ORDER BY w, p
"""
DECODE = "SELECT d, list(v.bytes ORDER BY g.p) AS parts FROM given_ids g JOIN vocabulary v ON g.tok = v.tok GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: least rank first, then leftmost."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (r := ranks.get(piece[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


@lru_cache(2)
def tables(path: str) -> tuple[dict[bytes, int], pa.Table, pa.Table]:
    """(ranks, vocabulary, merge table) of a tokenizer."""
    ranks = read_ranks(path)
    left, right, made = [], [], []
    for token, rank in ranks.items():  # any cut of a token into two tokens is a pair that it contracts
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                left.append(a), right.append(b), made.append(rank)
    vocabulary = pa.table({"bytes": pa.array(ranks, pa.binary()), "tok": pa.array(ranks.values(), pa.int32())})
    pair = (np.array(left, np.int64) << 32) + np.array(right, np.int64)
    return ranks, vocabulary, pa.table({"pair": pair, "made": np.array(made, np.int32)})


class Bpe:
    """A tokenizer in a DuckDB of this process; `close` gives its memory back."""

    def __init__(self, path: str):
        self.ranks, vocabulary, merges = tables(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self.db.register("v", vocabulary), self.db.register("m", merges)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the ranks lack single bytes")
        self.encoder = Encoder(self.pieces)
        give_back()

    def close(self) -> None:
        self.encoder.forget()
        self.db.close()

    def _rows(self, query: str, name: str, rows: pa.Table, **given) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(query, params=given or None).to_arrow_table()
        finally:
            self.db.unregister(name)

    def contracted(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces, by the recursive query until none has a pair in the merge table."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        w = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        tok = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        out: list = [None] * len(raw)
        while len(w):
            first = np.flatnonzero(np.diff(w, prepend=-1))
            p = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
            got = self._rows(ENCODE, "given", pa.table({"w": w, "p": p.astype(np.int32), "tok": tok}), rounds=ROUNDS)
            w, tok, r = (got[c].to_numpy() for c in ("w", "tok", "r"))
            done = r < ROUNDS
            first = np.flatnonzero(np.diff(w, prepend=-1))
            for i, a, b in zip(w[first].tolist(), first.tolist(), [*first[1:].tolist(), len(w)]):
                out[i] = tok[a:b]
            w, tok = w[~done], tok[~done]
        return out

    def pieces(self, pieces: list[bytes]) -> list:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        short = []
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = [r]
            elif len(p) > LONG:
                out[i] = by_heap(p, self.ranks)
            else:
                short.append(i)
        short.sort(key=lambda i: len(pieces[i]))  # pieces of one query need about as many rounds
        a = 0
        while a < len(short):
            b, size = a, 0
            while b < len(short) and size < BYTES:
                size += len(pieces[short[b]])
                b += 1
            for i, ids in zip(short[a:b], self.contracted([pieces[i] for i in short[a:b]])):
                out[i] = ids
            a = b
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each document; one of over ROWS ids is decoded in parts of as many."""
        if len(counts) and counts.max() > ROWS:
            sizes = [[ROWS] * (c // ROWS) + [c % ROWS] for c in counts.tolist()]
            parts = self.decode(ids, np.array([s for own in sizes for s in own], np.int64))
            ends = np.cumsum([len(own) for own in sizes]).tolist()
            return [b"".join(parts[a:b]) for a, b in zip([0, *ends], ends)]
        out = [b""] * len(counts)
        upto = np.concatenate([[0], np.cumsum(counts)])
        a = 0
        while a < len(counts):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + ROWS, "right")) - 1)
            own = ids[upto[a] : upto[b]]
            if len(own):
                given = pa.table({"d": np.repeat(np.arange(a, b), counts[a:b]), "p": np.arange(len(own)), "tok": own.astype(np.int32)})
                got = self._rows(DECODE, "given_ids", given).combine_chunks()
                parts = pa.concat_arrays(got["parts"].chunks) if got["parts"].num_chunks != 1 else got["parts"].chunk(0)
                flat = parts.flatten()
                sizes = np.diff(np.asarray(parts.offsets))
                raw, offs = utf8_bytes(flat)
                ends = offs[np.cumsum(sizes)]
                begin = 0
                for d, e in zip(got["d"].to_pylist(), ends.tolist()):
                    out[d], begin = raw[begin:e], e
            a = b
        return out


def utf8_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return data.to_pybytes()[offs[0] : offs[-1]], offs - offs[0]


def bpe(docs: DataFrame, path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """docs without its text, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves."""
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    given = docs.drop(*[f.name for f in new])
    kept = [f for f in given.schema.fields if f.name != text]

    def run(batches):
        made = Bpe(path)
        try:
            yield from encoded(made, batches)
        finally:
            made.close()

    def encoded(made, batches):
        for batch in batches:
            buf, offs = utf8(batch.column(text))
            for row, flat, counts in made.encoder.texts(buf, offs):
                upto = np.concatenate([[0], np.cumsum(counts)])
                decoded = made.decode(flat, counts)
                columns = [batch.column(f.name).slice(row, len(counts)) for f in kept]
                columns += [pa.array(counts), pa.array([hashlib.sha256(flat[a:b].astype("<u4").tobytes()).hexdigest() for a, b in zip(upto[:-1], upto[1:])], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], *[f.name for f in new]])
            give_back()

    return given.mapInArrow(tidy(run), T.StructType([*kept, *new]))


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


