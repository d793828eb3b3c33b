"""Quality rules: base rules and gradient-boosted trees over document statistics.

One vectorised pass gives the statistics of every whole text.  The trees are trained on the driver with labelled
documents: at most SAMPLE of them, those of least digest of doc_id, a fixed sample at any size.  They must not rise with
symbols, repeated lines or repeated words (monotone constraints), and are flattened into node arrays that
score a batch at once.  A document is kept unless a base rule fails or its probability of good quality is under
THRESHOLD.

Defined cases: a null or empty text has no words and fails; an empty table gives an empty result; without labels of
both kinds the trees agree with the labels there are (keep, if there are none); a repeated label row counts again;
extra columns stay with `rate` and the result columns replace columns of the same name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy
from .gbt import Forest, train
from .kernels import SPACES, Digests, chunks, grams, new_key, spans, utf8, word_table

SAMPLE, THRESHOLD = 20_000, 0.2
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeats", "digits", "marks", "upper", "line_words", "lines_ended", "distinct", "non_ascii")
MONOTONE = np.array([0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0, 0])


@lru_cache(1)
def _tables() -> dict[str, np.ndarray]:
    def of(chars: bytes) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(chars)] = True
        return t

    letter = of(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
    line = np.ones(256, bool)
    line[10] = False
    return {"word": word_table(), "symbol": of(SYMBOLS), "digit": of(b"0123456789"), "upper": of(bytes(range(65, 91))), "mark": ~(letter | of(b"0123456789" + SPACES)), "line": line, "stop": of(b".!?")}


def _per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(offs) - 1, np.int64), np.flatnonzero(np.diff(offs))
    if len(some):
        out[some] = np.add.reduceat(flags, offs[some], dtype=np.int64)
    return out


def _distinct(rows: np.ndarray, digests: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct digests of each row, order, whether each in that order repeats the one before)."""
    order = np.lexsort((digests, rows))
    r, d = rows[order], digests[order]
    again = np.zeros(len(order), bool)
    again[1:] = (r[1:] == r[:-1]) & (d[1:] == d[:-1])
    return np.bincount(r[~again], minlength=n), order, again


def statistics(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) of texts, one row each; texts are looked at in chunks."""
    base, features = [], []
    t, key = _tables(), new_key()  # lines and words are compared inside this call alone
    for a, b in chunks(offs):
        own, rows = buf[offs[a] : offs[b]], b - a
        o = offs[a : b + 1] - offs[a]
        starts, ends, row = spans(own, o, t["word"])
        h = Digests(own, key)
        n_words = np.bincount(row, minlength=rows)
        lead = (own & 0xC0) != 0x80
        chars = _per_row(lead & t["word"][own], o)
        symbols = _per_row(t["symbol"][own], o)
        word = h.of(starts, ends)
        distinct, _, _ = _distinct(row, word, rows)
        g = grams(word, 3)
        inside = np.flatnonzero(row[: len(g)] == row[2:]) if len(g) else np.zeros(0, np.int64)
        _, order, again = _distinct(row[inside], g[inside], rows)
        twice = again.copy()
        twice[:-1] |= again[1:]
        marked = np.zeros(len(row) + 1, bool)
        at = inside[order[twice]]
        for k in range(3):
            marked[at + k] = True
        repeats = np.bincount(row[marked[:-1]], minlength=rows)
        ls, le, lrow = spans(own, o, t["line"])
        has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
        ls, le, lrow = ls[has], le[has], lrow[has]
        lines = np.bincount(lrow, minlength=rows)
        single, _, _ = _distinct(lrow, h.of(ls, le), rows)
        dup = lines - single
        base.append(np.stack([n_words, chars, symbols, dup, repeats], 1).astype(np.int64))
        w, c, n = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
        ended = np.bincount(lrow[t["stop"][own[le - 1]]], minlength=rows) if len(le) else np.zeros(rows)
        features.append(np.stack([n_words, chars / w, symbols / c, dup / n, repeats / w, _per_row(t["digit"][own], o) / c, _per_row(t["mark"][own], o) / c, _per_row(t["upper"][own], o) / c, n_words / n, ended / n, distinct / w, _per_row(own >= 0xC0, o) / c], 1))
    if not base:
        return np.zeros((0, len(BASE)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate(base), np.concatenate(features)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """The trees for labels (doc_id, quality 0 or 1)."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column("text"))
            _, x = statistics(buf, offs)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), *[pa.array(x[:, j]) for j in range(x.shape[1])]], names=["quality", *FEATURES])

    found = texts.mapInArrow(tidy(run), ", ".join(f"{n} double" for n in ("quality", *FEATURES)))
    # rows that repeat a doc_id could be more than the labels
    got = found.orderBy(F.xxhash64(*FEATURES), "quality").limit(sample).toArrow()
    x = np.stack([got[n].to_numpy() for n in FEATURES], 1) if len(got) else np.zeros((0, len(FEATURES)))
    y = got["quality"].to_numpy()
    order = np.lexsort([*x.T, y])  # not the order in which tasks ended
    return train(x[order], y[order], MONOTONE)


def rate(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """docs with the base counts, base_failed, quality and kept."""
    new = [*[T.StructField(n, T.LongType()) for n in BASE], T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    given = docs.drop(*[f.name for f in new])
    shipped = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column("text"))
            base, x = statistics(buf, offs)
            failed = (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeats * base[:, 0])
            quality = shipped.value.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(base[:, j]) for j in range(len(BASE))], pa.array(failed), pa.array(quality), pa.array(~failed & (quality >= threshold))], names=[*batch.schema.names, *[f.name for f in new]])

    return given.mapInArrow(tidy(run), T.StructType([*given.schema.fields, *new]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = rate(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", *BASE, "base_failed", "kept", "quality")
