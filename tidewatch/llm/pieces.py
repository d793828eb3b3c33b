"""Vectorised pre-tokenisation of whole texts and a table of pieces that were encoded before."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from .kernels import CHUNK, Digests, chunks, same_bytes

_SPACE, _LETTER, _NUMBER = 3, 1, 2
#: Unicode white space; the contractions of the pattern.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            out[c] = _LETTER if k == "L" else _NUMBER
    out[list(WHITE)] = _SPACE
    return out


def piece_starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start in code points cp of texts that end at `ends`; the matches cover all."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cp]
    first = np.zeros(n + 1, bool)  # starts of texts
    first[0] = True
    first[ends] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == _SPACE
    space_before = np.zeros(n, bool)
    space_before[1:] = cp[:-1] == 0x20
    space_before &= ~first[:n]
    start = run & (white | ~space_before)
    last = white.copy()  # the last white character before something else in the same text
    last[:-1] &= ~white[1:]
    last[-1] = False
    last &= ~first[1:]
    start |= last
    quote = np.flatnonzero((cp == 0x27) & start & run)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == _LETTER) & ~first[quote + 1]]
    for q in quote.tolist():
        for c in CONTRACTIONS:
            k = len(c)
            if q + k < n and all(cp[q + 1 + j] == ord(c[j]) for j in range(k)) and not first[q + 2 : q + 1 + k].any():
                start[q + 1] = False
                if q + 1 + k < n and kind[q + 1 + k] == _LETTER and not first[q + 1 + k]:
                    start[q + 1 + k] = True
                break
    return np.flatnonzero(start)


def parts(buf: np.ndarray, offs: np.ndarray, most: int = CHUNK):
    """(first row, bytes, offsets, whether the last text goes on) of successive parts of a batch.

    A text of over `most` bytes is cut where a piece surely starts: at a single white character (ASCII) between two that aren't
    white; a stretch without one stays whole.
    """
    white = np.zeros(256, bool)
    white[[0x20, 0x0A]] = True
    dark = np.ones(256, bool)
    dark[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = False
    dark[128:] = False  # may be part of a white character
    for a, b in chunks(offs, most):
        start, end = int(offs[a]), int(offs[b])
        while end - start > most and b - a == 1:
            at, cut = start + most // 2, 0
            while at < end - 1 and not cut:
                stop = min(end - 1, at + most)
                fits = np.flatnonzero(white[buf[at:stop]] & dark[buf[at - 1 : stop - 1]] & dark[buf[at + 1 : stop + 1]])
                cut = at + int(fits[0]) if len(fits) else 0
                at = stop
            if not cut:
                break
            yield a, buf[start:cut], np.array([0, cut - start]), True
            start = cut
        yield a, buf[start:end], np.array([0, end - start]) if b - a == 1 else offs[a : b + 1] - start, False


def _gathered(values: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretches of values of these places and sizes one after another, their new places)."""
    new = np.cumsum(size) - size
    return values[np.arange(int(size.sum())) + np.repeat(place - new, size)], new


class Encoder:
    """Ids of whole texts.  `encode` gets the pieces not met before, as bytes, and returns their ids; it is asked for a piece
    once as long as the table of met pieces holds at most `most`, of `most_bytes` in all; beyond, those met last stay, up to half of it.

    Pieces are looked up by digest and their bytes are compared; one whose digest another piece has is encoded each time.
    """

    def __init__(self, encode, most: int = 400_000, most_bytes: int = 8 << 20):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.digest = lambda part, starts, ends: Digests(part).of(starts, ends)
        self.forget()

    def forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)  # of the piece's bytes in raw
        self.length = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)  # of its ids
        self.size = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)  # in which part it was met last
        self.now = 0
        self.raw = np.zeros(0, np.uint8)
        self.ids = np.zeros(0, np.uint32)

    def _trim(self) -> None:
        last = np.argsort(-self.met, kind="stable")[: self.most // 2]
        keep = np.sort(last[np.cumsum(self.length[last]) <= self.most_bytes // 2])
        for name in ("keys", "place", "length", "at", "size", "met"):
            setattr(self, name, getattr(self, name)[keep])
        self.raw, self.place = _gathered(self.raw, self.place, self.length)
        self.ids, self.at = _gathered(self.ids, self.at, self.size)

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) in self.ids of the ids of pieces, which are added there."""
        got = self.encode(pieces)
        size = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))])
        return at, size

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        at, size = self._ids(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place = len(self.raw) + np.cumsum(length) - length
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(pieces), np.uint8)])
        where = np.searchsorted(self.keys, keys)
        for name, values in (("keys", keys), ("place", place), ("length", length), ("at", at), ("size", size), ("met", np.full(len(keys), self.now))):
            setattr(self, name, np.insert(getattr(self, name), where, values))

    def _part(self, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts by row) of the texts of part that start at `own`."""
        rows = len(own) - 1
        if not len(part):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        cp = np.frombuffer(part.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.flatnonzero((part & 0xC0) != 0x80)  # byte of each code point
        starts = lead[piece_starts(cp, np.searchsorted(lead, own[1:-1]))]
        del cp, lead
        ends = np.append(starts[1:], len(part))
        h = self.digest(part, starts, ends)
        unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.most or len(self.raw) > self.most_bytes:
            self._trim()
        self.now += 1
        at = np.searchsorted(self.keys, unique)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == unique if len(self.keys) else np.zeros(len(unique), bool)
        raw = part.tobytes()
        if not known.all():
            new = where[~known]
            self._learn(unique[~known], [raw[s:e] for s, e in zip(starts[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.keys, unique)
        self.met[at] = self.now
        of, length = at[inverse], ends - starts
        same = self.length[of] == length
        same &= same_bytes(part, starts, self.raw, self.place[of], np.where(same, length, 0))
        odd = np.flatnonzero(~same)
        places, sizes = self.at[of], self.size[of]
        before = len(self.ids)
        if len(odd):
            places[odd], sizes[odd] = self._ids([raw[s:e] for s, e in zip(starts[odd].tolist(), ends[odd].tolist())])
        upto = np.cumsum(sizes)
        ids = self.ids[np.arange(int(upto[-1])) + np.repeat(places - (upto - sizes), sizes)]
        self.ids = self.ids[:before]
        row = np.searchsorted(own, starts, "right") - 1
        return ids, np.bincount(row, weights=sizes, minlength=rows).astype(np.int64)

    def texts(self, buf: np.ndarray, offs: np.ndarray):
        """Yields (first row, ids, counts by row) for successive rows of a batch; a row is never split."""
        held: list[np.ndarray] = []
        for a, part, own, goes_on in parts(buf, offs):
            ids, counts = self._part(part, own)
            if goes_on or held:
                held.append(ids)
                if goes_on:
                    continue
                ids = np.concatenate(held)
                counts, held = np.array([len(ids)]), []
            yield a, ids, counts
