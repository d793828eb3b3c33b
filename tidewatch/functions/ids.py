"""Stable ids: the first 128 bits of BLAKE3 as hex, from the published specification."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the hash function: initial words and message permutation.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
_COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv, block: bytes, counter: int, size: int, flags: int) -> list[int]:
    m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
    v = [*cv, *IV[:4], counter & 0xFFFFFFFF, counter >> 32, size, flags]
    for _ in range(7):
        for i, (a, b, c, d) in enumerate(_COLUMNS):
            for word, (r1, r2) in ((m[2 * i], (16, 12)), (m[2 * i + 1], (8, 7))):
                v[a] = (v[a] + v[b] + word) & 0xFFFFFFFF
                x = v[d] ^ v[a]
                v[d] = (x >> r1 | x << (32 - r1)) & 0xFFFFFFFF
                v[c] = (v[c] + v[d]) & 0xFFFFFFFF
                x = v[b] ^ v[c]
                v[b] = (x >> r2 | x << (32 - r2)) & 0xFFFFFFFF
        m = [m[p] for p in PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)]


def _chunk(data: bytes, counter: int, root: int) -> list[int]:
    blocks = [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    cv = list(IV)
    for i, b in enumerate(blocks):
        last = i == len(blocks) - 1
        cv = _compress(cv, b, counter, len(b), (CHUNK_START if i == 0 else 0) | ((CHUNK_END | root) if last else 0))
    return cv


def _tree(data: bytes, first: int, root: int) -> list[int]:
    if len(data) <= 1024:
        return _chunk(data, first, root)
    cut = 1024 << ((len(data) - 1) // 1024).bit_length() - 1  # the left side: the largest power of two of chunks
    left, right = _tree(data[:cut], first, 0), _tree(data[cut:], first + cut // 1024, 0)
    return _compress(IV, struct.pack("<16I", *left, *right), 0, 64, PARENT | root)


def blake3(data: bytes) -> bytes:
    return struct.pack("<8I", *_tree(data, 0, ROOT))


def stable_id(text: str) -> str:
    return blake3(text.encode("utf-8", "surrogatepass"))[:16].hex()


def _ids(texts: pd.Series) -> pd.Series:
    known = {t: stable_id(t) for t in texts.dropna().unique()}
    return texts.map(lambda t: known.get(t))


def stable_id_of(column):
    """Of a column; equal texts of a batch are hashed once."""
    return F.pandas_udf(_ids, T.StringType())(column)


def device_key(tenant, device_dir):
    return stable_id_of(F.concat(tenant, F.lit("/"), device_dir))


def source_stream_id(tenant, key, path):
    lines = F.concat(F.lit("source_stream/v1\ntenant_id="), tenant, F.lit("\ndevice_key="), key, F.lit("\nsource_path="), path, F.lit("\n"))
    return stable_id_of(lines)
