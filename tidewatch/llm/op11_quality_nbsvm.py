"""Quality classifier by naive Bayes support vectors.

Indicators of a text: which pairs of neighbouring bytes it holds, and which shapes of words and pairs of shapes.  A word's
shape has one sign for each stretch of small letters (and all beyond ASCII), capitals or digits, and its other characters
as they are; a word that equals the one before has a shape of its own.  Indicators are scaled by class log-count ratios, and a
linear hinge-loss model over them is fitted by dual coordinate descent (`nbsvm`); margins become probabilities by a
logistic curve fitted to rows left out.

The model is fitted on the driver to labelled documents outside the held-out quarter: at most SAMPLE of them, those of least
digest of doc_id, a fixed sample at any size.  Every document is scored where it lies, by its whole text; nothing but
the sample is shuffled.

Defined cases: a null or empty text has no indicators and the score of the bias alone; a very long text is looked at in
pieces that share two words, with the same result (but a word of over CHUNK bytes is taken in parts); without labels of both kinds every score is the share of label 1 with one row
of each added; a null label is left out, a repeated one counts again; a null doc_id is not held out and has no label; an empty table
gives an empty result; extra columns stay with `rate` and the result columns replace columns of the same name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy
from .kernels import CHUNK, Digests, mix, same_bytes, spans, utf8, word_table
from .nbsvm import Model, train

SAMPLE, THRESHOLD = 6_000, 0.7
#: Indicators: byte pairs, then shapes by digest.
PAIRS, SHAPES = 1 << 16, 1 << 15
SIZE = PAIRS + SHAPES
#: Texts whose indicators are flagged at once.
TEXTS = 64


@lru_cache(1)
def _signs() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = t[0x80:] = ord("a")
    t[ord("A") : ord("Z") + 1] = ord("A")
    t[ord("0") : ord("9") + 1] = ord("0")
    return t


def shapes(buf: np.ndarray, offs: np.ndarray, goes_on: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rows, codes) of the shapes of words and of neighbouring words, repeats included; goes_on: the first word stands here as the neighbour of the second alone."""
    starts, ends, row = spans(buf, offs, word_table())
    if not len(starts):
        return row, row
    sign, size = _signs()[buf], ends - starts
    fresh = np.ones(len(sign), bool)
    fresh[1:] = sign[1:] != sign[:-1]
    fresh[starts] = True
    before = np.concatenate([[0], np.cumsum(fresh)])
    h = Digests(sign[fresh]).of(before[starts], before[ends])
    close = row[1:] == row[:-1]
    at = np.flatnonzero(close & (size[1:] == size[:-1]))
    again = at[same_bytes(buf, starts[at + 1], buf, starts[at], size[at])] + 1
    h[again] = mix(np.array([1], np.uint64))[0]
    one, two = np.arange(len(row))[int(goes_on) :], np.flatnonzero(close)[int(goes_on) :]
    pairs = mix(h[two] * np.uint64(3) ^ h[two + 1])
    return np.concatenate([row[one], row[two]]), (np.concatenate([h[one], pairs]) % np.uint64(SHAPES)).astype(np.int64) + PAIRS


def _cuts(buf: np.ndarray, start: int, end: int) -> list[tuple[int, int, bool]]:
    """Pieces of a text of about CHUNK bytes, and whether each begins with the two words that end the one before."""
    cuts, white, goes_on = [], ~word_table(), False
    while end - start > 2 * CHUNK:
        gaps = np.flatnonzero(white[buf[start + 1 : start + CHUNK]]) + 1
        stop = start + (int(gaps[-1]) if len(gaps) else CHUNK)  # a word of over CHUNK bytes is taken in parts
        cuts.append((start, stop, goes_on))
        words = gaps[:-1][np.diff(gaps) > 1]  # the white byte before each word
        goes_on = len(words) > 1
        start = start + int(words[-2]) if goes_on else stop
    return [*cuts, (start, end, goes_on)]


def indicators(buf: np.ndarray, offs: np.ndarray):
    """(first row, rows, row of each indicator, indicator) of some texts after others; each text's are distinct and in order."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = min(n, row + TEXTS, max(row + 1, int(np.searchsorted(offs, offs[row] + CHUNK, "right")) - 1))
        long = offs[row + 1] - offs[row] > 2 * CHUNK
        flags = np.zeros((end - row) * SIZE, bool)
        for a, b, goes_on in _cuts(buf, int(offs[row]), int(offs[row + 1])) if long else [(int(offs[row]), int(offs[end]), False)]:
            own = buf[a:b]
            o = np.array([0, b - a]) if long else offs[row : end + 1] - a
            which = np.repeat(np.arange(len(o) - 1) * SIZE, np.diff(o))
            pair = own[:-1].astype(np.int64) * 256 + own[1:]
            flags[(which[:-1] + pair)[which[:-1] == which[1:]]] = True
            r, code = shapes(own, o, goes_on)
            flags[r * SIZE + code] = True
        at = np.flatnonzero(flags)
        yield row, end - row, at // SIZE, at % SIZE
        row = end


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of this doc_id are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> Model:
    """The model for labels (doc_id, quality 0 or 1)."""
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    chosen = usable.select("doc_id", F.col("quality").cast("int").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(sample)
    texts = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "_y", "_text")

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column("_text"))
            for row, rows, r, code in indicators(buf, offs):
                upto = np.searchsorted(r, np.arange(rows + 1))
                codes = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(code, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, rows), batch.column("_y").slice(row, rows), codes], names=["doc_id", "y", "codes"])

    found = texts.mapInArrow(tidy(run), "doc_id long, y int, codes array<int>")
    # rows that repeat a doc_id could be more than the labels
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "codes").limit(sample).toArrow()
    x = [np.asarray(c.values, np.int64) for c in got["codes"]]
    return train(x, np.asarray(got["y"], np.int64), SIZE)


def rate(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    given = docs.drop(*[f.name for f in new])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = [np.zeros(0)]
            for _, rows, r, code in indicators(*utf8(batch.column(text))):
                score.append(shipped.value.score(r, code, rows))
            score = np.concatenate(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, *[f.name for f in new]])

    return given.mapInArrow(tidy(run), T.StructType([*given.schema.fields, *new]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = rate(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rated.select("doc_id", held_out().alias("held_out"), "score", "predicted")
