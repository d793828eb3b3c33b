"""Texts made so that digests without a key would meet, and very long texts through encoding, decoding and the pipeline's stages."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import op4_quality, op5_bpe, op6_suffix_dedup, op7_recompression, op8_bottomk
from tidewatch.llm.kernels import Digests, mix, utf8

from . import brute
from .test_operators import COLUMNS, tuples


def solved(a: bytes, b: bytes, rest: bytes, seed: int) -> tuple[bytes, bytes]:
    """a + rest and b + x, 16 bytes each, with one digest of that seed without a key."""
    start = mix(np.array([16], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xA24BAED4963EE407 % (1 << 64)))
    h = [mix(start ^ np.frombuffer(x, "<u8")) for x in (a, b)]
    return a + rest, b + (h[0] ^ h[1] ^ np.frombuffer(rest, "<u8")).astype("<u8").tobytes()


def printable(seed: int) -> tuple[str, str]:
    """A pair of words of printable characters."""
    rng = np.random.default_rng(seed)
    plain = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8)
    while True:
        for _ in range(2000):
            a, b, rest = (plain[rng.integers(0, len(plain), 8)].tobytes() for _ in range(3))
            x, y = solved(a, b, rest, seed)
            try:
                text = y.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if not any(c in " \t\n\r\v\f" or ord(c) < 33 for c in text) and text == text.lower():
                return x.decode(), text


@pytest.fixture(scope="module")
def pairs():
    return [printable(seed) for seed in range(3)]


def test_pairs_meet_without_a_key(pairs):
    for seed, pair in enumerate(pairs):
        buf, offs = utf8(pa.array(pair))
        plain = Digests(buf).of(offs[:-1], offs[1:], seed)
        assert plain[0] == plain[1]
        for key in (1, 2**63 + 5):
            own = Digests(buf, key).of(offs[:-1], offs[1:], seed)
            assert own[0] != own[1]


def test_forged_statistics(pairs):
    texts = [f"{a}\n{b}\n{a} u {b}\n{b} v {a} w {a} u" for a, b in pairs]
    base, _ = op4_quality.statistics(*utf8(pa.array(texts)))
    assert [tuple(x) for x in base] == [brute.quality(t) for t in texts]


@pytest.mark.parametrize("module", [op6_suffix_dedup, op7_recompression, op8_bottomk])
def test_forged_texts(spark, pairs, module):
    """Documents that repeat nothing but for forged words lose nothing and are not linked; exact copies are."""
    rows = []
    for k, (a, b) in enumerate(pairs):
        own = [f"w{k}_{i}" for i in range(14)]
        for word in (a, b):
            rows.append((len(rows), " ".join([*own[:6], word, *own[6:]]) if module is op7_recompression else " ".join([word] * 14) if module is op8_bottomk else word * 8))
    rows += [(50, rows[0][1]), (51, rows[3][1])]
    columns, slow = COLUMNS[module]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = op8_bottomk.near_duplicates(df) if module is op8_bottomk else module.dedup(df, texts=False)
    assert tuples(made, *columns) == sorted(slow(rows))


@pytest.mark.parametrize("size", [2 << 20, 8 << 20])
def test_long_text_is_decoded(spark, size):
    words = " ".join(f"Word{i * 7919 % 100_003} is {i}, née\n" for i in range(size // 24))
    df = spark.createDataFrame([(1, words), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in op5_bpe.bpe(df, op5_bpe.vocabulary(), ids=False).collect()}
    assert got[1].decoded_sha256 == brute.sha(words) and got[1].n_tokens > op5_bpe.ROWS and got[3].n_tokens == 0
    assert got[2].decoded_sha256 == hashlib.sha256(b"short").hexdigest()
