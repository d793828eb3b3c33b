"""Vectorised text kernels shared by the Arrow operators: chunking, word spans, digests of byte ranges."""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one vectorised step looks at; bounds the temporary arrays.
CHUNK = 1 << 19
#: The ASCII white space that separates words.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    row, rows = 0, len(offs) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = end


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the maximal runs of bytes for which the table `inside` is true."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    on = inside[buf]
    before, after = np.empty_like(on), np.empty_like(on)
    before[1:], after[:-1] = on[:-1], on[1:]
    edges = offs[:-1][np.diff(offs) > 0]
    before[edges] = False
    before[0] = False
    after[edges[1:] - 1] = False
    after[-1] = False
    starts = np.flatnonzero(on & ~before)
    return starts, np.flatnonzero(on & ~after) + 1, np.searchsorted(offs, starts, "right") - 1


@lru_cache(8)
def word_table(separators: bytes = SPACES) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Byte ranges beyond this size are digested by xxhash, one call each; shorter ones 8 bytes at a time, all at once.
LONG = 256


def blocks(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of buf on, as numbers; zeros follow the end."""
    raw = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", raw, 0, (1,))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def new_key() -> int:
    """A key for the digests of one run; drawn on the driver and shipped, so all tasks have the same."""
    return secrets.randbits(64)


class Digests:
    """64-bit digests of byte ranges of a buffer.

    Each step mixes 8 bytes into the state by a bijection that is not linear, from a state that the length sets: ranges of up
    to 8 bytes of one length never collide.  Who knows the state can solve for bytes that make two longer ranges meet, so where
    digests decide, a run draws its own key (`new_key`), which no text can have been made for.
    """

    def __init__(self, buf: np.ndarray, key: int = 0):
        self.buf, self.blocks, self.key = buf, blocks(buf), key

    def of(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        size = ends - starts
        out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xA24BAED4963EE407 + self.key) % (1 << 64)))
        at = np.flatnonzero((size > 0) & (size <= LONG))
        if len(at) == len(size):
            at = slice(None)
        start, left, h = starts[at], size[at], out[at]
        keep: np.ndarray | None = None  # places in out of what is still worked on; None: all of `at`
        done = 0
        while len(left):
            h = mix(h ^ (self.blocks[start + done] & _MASKS[np.minimum(left - done, 8)]))
            done += 8
            more = left > done
            if keep is None:
                out[at] = h
            else:
                out[keep] = h
            if not more.any():
                break
            if keep is None:
                keep = np.arange(len(out))[at]
            keep, start, left, h = keep[more], start[more], left[more], h[more]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.buf[starts[i] : ends[i]].tobytes(), (seed + 1 + self.key) % (1 << 64))
        return out


def same_bytes(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ranges of `size` bytes that start at a in x and at b in y are equal."""
    out, u, v = np.ones(len(size), bool), blocks(x), blocks(y)
    at, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(at):
        differ = ((u[a[at] + done] ^ v[b[at] + done]) & _MASKS[np.minimum(size[at] - done, 8)]) != 0
        out[at[differ]] = False
        done += 8
        at = at[~differ & (size[at] > done)]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.array_equal(x[a[i] : a[i] + size[i]], y[b[i] : b[i] + size[i]])
    return out


def sequences(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Digests of ranges of a sequence of digests; the ranges are short."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64((seed + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    for j in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > j)
        out[at] = mix(out[at] ^ h[starts[at] + j])
    return out


@lru_cache(1)
def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Digest of each k neighbours of h (of none, if there are fewer)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = mix(h[:n] + np.uint64(k))
    for j in range(1, k):
        out = mix(out ^ h[j : j + n])
    return out
