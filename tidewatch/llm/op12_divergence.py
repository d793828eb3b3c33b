"""Source divergence audit: how far the sources of each language are apart in their words.

A language keeps the terms of at least LEAST_DOCS of its documents.  A group (lang, source), and a language, gives a kept term
the share p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N its occurrences of all V kept terms.  Sources of a language
are compared in pairs, value sum(abs(p - q)) over all kept terms, and each with its language by the terms it uses more.

Pairs are summed by a heavy-light split.  A group without a term has the same share `low` for all such terms, so a pair (g, h) has
V * abs(low_g - low_h) plus, for each term that either has, abs(p_g - p_h) - abs(low_g - low_h).  Terms of at least one in HEAVY groups of
their language make dense tiles: a matrix of terms by groups, columns taken from one another.  Rare terms are posting lists: each
posting corrects its group against the `low` of all others, and each two postings of a term correct their pair.  Both
are integers and added up exactly.

Tiles are squares of BLOCK by BLOCK groups; postings go to the tiles of their group, dealt by term over parts of about PART
postings, and a task streams through its sorted rows and holds one tile at a time.  A term is in as many rows as it has
groups, wherever it is used: counts are merged in each text chunk before they are shuffled.

Defined cases: null text, lang and source are ''; rows are documents, whether or not they repeat a doc_id; a group without
kept terms has low shares only; without any kept terms of a language all its pairs have the value 0; a language of one
source has no pairs; an empty table gives an empty result; a very long text is looked at in pieces that end between terms,
its counts merged; other columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets, settled, table, tidy
from .kernels import ascii_lower, chunks, spans, utf8

LEAST_DOCS, RANKS, BASE, ADDED = 30, 50, 1_000_000_000, 5
#: A term of at least one in HEAVY groups of its language is heavy.
HEAVY = 4
#: Groups to a side of a tile, postings to a part, bytes of text whose counts are merged before the shuffle.
BLOCK, PART, MERGED = 256, 1 << 16, 8 << 20
#: Cells of a tensor that one step makes.
CELLS = 1 << 21
#: Bytes that are not of terms.
OUTSIDE = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT lang, source, row, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
cell AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + 5 * v) AS p FROM every JOIN v USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // ((sum(n) OVER (PARTITION BY lang))::HUGEINT + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM cell GROUP BY lang, term) JOIN v USING (lang)),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) s
    ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, rank::INTEGER FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 50
"""


@lru_cache(1)
def _inside() -> np.ndarray:
    t = np.ones(256, bool)
    t[list(OUTSIDE)] = False
    return t


def _counts(buf: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, groups, occurrences, documents) of texts: one row each term and group."""
    own = ascii_lower()[buf]
    starts, ends, row = spans(own, offs, _inside())
    size = ends - starts
    inside = _inside()[own]
    upto = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(upto), pa.py_buffer(own[inside]))
    coded = words.dictionary_encode()
    many, code = max(1, len(coded.dictionary)), np.asarray(coded.indices, np.int64)
    key, n = np.unique(row * many + code, return_counts=True)
    cell, back = np.unique(group[key // many] * many + key % many, return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, back, n)
    return coded.dictionary.take(pa.array(cell % many)), cell // many, total, np.bincount(back, minlength=len(cell))


def _long(buf: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms, occurrences) of one very long text, by pieces that end between terms."""
    outside, parts, start = ~_inside(), [], 0
    while start < len(buf):
        gaps = np.flatnonzero(outside[buf[start + MERGED : start + 2 * MERGED]])
        stop = start + MERGED + int(gaps[0]) if len(gaps) else len(buf)
        term, _, n, _ = _counts(buf[start:stop], np.array([0, stop - start]), np.zeros(1, np.int64))
        parts.append(pa.table({"term": term, "n": n}))
        start = stop
    merged = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
    return merged["term"].combine_chunks(), merged["n_sum"].to_numpy()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: parts of sums, merged over MERGED bytes of text."""
    given = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column("text"))
            group = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], names=["lang", "source"])
            place, known = {}, []
            which = np.array([place.setdefault(g, len(place)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
            known = group.take(pa.array(np.unique(which, return_index=True)[1]))
            for a, b in chunks(offs, MERGED):
                if offs[b] - offs[a] > 2 * MERGED:
                    term, n = _long(buf[offs[a] : offs[b]])
                    at, seen = np.full(len(term), which[a]), np.ones(len(term), np.int64)
                else:
                    term, at, n, seen = _counts(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], which[a:b])
                own = known.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.field("lang"), own.field("source"), term.cast(pa.string()), pa.array(n), pa.array(seen)], names=["lang", "source", "term", "n", "docs"])

    return given.mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, v: str) -> str:
    """SQL of 1 + floor(BASE * (n + ADDED) / (total + ADDED * v)), exact beyond 64 bits."""
    return f"1 + CAST({BASE} * CAST({n} + {ADDED} AS DECIMAL(28, 0)) AS DECIMAL(38, 0)) div CAST({total} + {ADDED} * {v} AS DECIMAL(38, 0))"


class Tile:
    """Sums of one square of groups: rows of block i, columns of block j (the same block, if i = j)."""

    def __init__(self, i: int, j: int):
        self.rows, self.cols = i * BLOCK, j * BLOCK
        self.same = i == j
        self.low: dict[int, int] = {}  # of each group
        self.started = False

    def start(self) -> None:
        ids = np.array(sorted(self.low), np.int64)
        low = np.array([self.low[g] for g in ids.tolist()], np.int64)
        a, b = ids // BLOCK * BLOCK == self.rows, ids // BLOCK * BLOCK == self.cols
        self.ids, self.lows = (ids[a], ids[b]), (low[a], low[b])
        self.gap = np.abs(self.lows[0][:, None] - self.lows[1][None, :])
        self.sum = np.zeros(self.gap.shape, np.int64)
        self.started = True

    def _sides(self, group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(which postings, their place) of the rows, and of the columns."""
        out = []
        for ids in self.ids:
            at = np.searchsorted(ids, group)
            own = np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == group)) if len(ids) else np.zeros(0, np.int64)
            out.append((own, at[own]))
        return out

    def dense(self, term: np.ndarray, group: np.ndarray, p: np.ndarray) -> None:
        """Adds terms as a matrix: term numbers 0, 1, ... in order."""
        terms = int(term[-1]) + 1
        full = []
        for (own, at), low in zip(self._sides(group), self.lows):
            m = np.repeat(low[None, :], terms, 0)
            m[term[own], at] = p[own]
            full.append(m)
        step = max(1, CELLS // max(1, self.sum.size))
        for a in range(0, terms, step):
            self.sum += np.abs(full[0][a : a + step, :, None] - full[1][a : a + step, None, :]).sum(0)
        self.sum -= terms * self.gap

    def sparse(self, term: np.ndarray, group: np.ndarray, p: np.ndarray) -> None:
        """Adds terms by their postings: each against the low shares of the other side, then each two of a term."""
        sides = self._sides(group)
        for axis, (own, at) in enumerate(sides):
            other = self.lows[1 - axis]
            step = max(1, CELLS // max(1, len(other)))
            for a in range(0, len(own), step):
                x, y = own[a : a + step], at[a : a + step]
                change = np.abs(p[x][:, None] - other[None, :]) - np.abs(self.lows[axis][y][:, None] - other[None, :])
                np.add.at(self.sum if axis == 0 else self.sum.T, y, change)
        (x, at_x), (y, at_y) = sides
        first, last = np.searchsorted(term[y], term[x], "left"), np.searchsorted(term[y], term[x], "right")
        upto, a = np.cumsum(last - first), 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CELLS, "right")))
            size = last[a:b] - first[a:b]
            u = np.repeat(np.arange(a, b), size)
            v = np.arange(int(size.sum())) + np.repeat(first[a:b] - (np.cumsum(size) - size), size)
            pu, pv, i, j = p[x[u]], p[y[v]], at_x[u], at_y[v]
            lu, lv = self.lows[0][i], self.lows[1][j]
            np.add.at(self.sum, (i, j), np.abs(pu - pv) - np.abs(pu - lv) - np.abs(lu - pv) + np.abs(lu - lv))
            a = b

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(g, h, sum) of all pairs of the tile, g before h."""
        i, j = np.indices(self.sum.shape)
        i, j = i.ravel(), j.ravel()
        own = self.ids[0][i] < self.ids[1][j] if self.same else np.ones(len(i), bool)
        return self.ids[0][i[own]], self.ids[1][j[own]], self.sum.ravel()[own]


def tiles(batches):
    """Pair sums (lang, g, h, value) of rows sorted by (lang, i, j, part, term, g): rows without a term are the groups of the tile, with their low share as p."""
    key, tile, rest = None, None, None

    def add(rows: pa.Table) -> None:
        if not tile.started:
            tile.start()
        code = rows["term"].combine_chunks().dictionary_encode()
        group, p, heavy = (rows[c].to_numpy() for c in ("g", "p", "heavy"))
        term = np.asarray(code.indices, np.int64)
        for kind, adds in ((True, tile.dense), (False, tile.sparse)):
            at = np.flatnonzero(heavy == kind)
            if len(at):
                adds(np.unique(term[at], return_inverse=True)[1], group[at], p[at])

    def finish():
        if not tile.started:
            tile.start()
        g, h, value = tile.result()
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(g), pa.string()), pa.array(g), pa.array(h), pa.array(value)], names=["lang", "g", "h", "value"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows, rest = pa.concat_tables([rest, rows]), None
        at = 0
        lang, i, j, part = (rows[c].combine_chunks() for c in ("lang", "i", "j", "part"))
        code = np.asarray(lang.dictionary_encode().indices)
        numbers = np.stack([code, *[np.asarray(c, np.int64) for c in (i, j, part)]], 1)
        edges = [*(np.flatnonzero((numbers[1:] != numbers[:-1]).any(1)) + 1).tolist(), rows.num_rows]
        for end in edges:
            if end == at:
                continue
            now = (lang[at].as_py(), i[at].as_py(), j[at].as_py(), part[at].as_py())
            if now != key:
                if key is not None:
                    yield finish()
                key, tile = now, Tile(now[1], now[2])
            own = rows.slice(at, end - at)
            groups = own.filter(own["term"].is_null())
            tile.low.update(zip(groups["g"].to_pylist(), groups["p"].to_pylist()))
            own = own.filter(own["term"].is_valid())
            if end == rows.num_rows and own.num_rows:  # the last term may go on in the next batch
                terms = own["term"].combine_chunks()
                same = np.asarray(pc.equal(terms, terms[-1]))
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                rest = own.slice(cut)
                own = own.slice(0, cut)
            if own.num_rows:
                add(own)
            at = end
    if rest is not None:
        add(rest)
    if key is not None:
        yield finish()


def divergence(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank of the groups of docs (text, lang, source)."""
    spark = docs.sparkSession
    n = buckets(spark)
    # one shuffle, by term: sums of groups, of the language and how many groups there are need no other
    merged = counts(docs).repartition(n, "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    seen = merged.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("all_n"), F.count("*").over(of_term).alias("groups"))
    cells = settled(seen.where(F.col("docs") >= least).drop("docs"), "cells")
    # every group, with its number in its language
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    given = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    terms = cells.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    own = given.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "cells", "v"])
    by_lang = Window.partitionBy("lang")
    own = own.select("*", (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("g"), F.count("*").over(by_lang).alias("of"), F.sum("cells").over(by_lang).alias("lang_cells"), F.sum("total").over(by_lang).alias("lang_total"))
    own = own.withColumn("low", F.when(F.col("v") > 0, F.expr(share("0", "total", "v"))).otherwise(F.lit(0)).cast("long"))
    groups = settled(own.select("*", F.floor(F.col("g") / BLOCK).cast("long").alias("block"), F.ceil(F.col("of") / BLOCK).cast("long").alias("blocks"), (1 + F.floor(F.col("lang_cells") / PART)).cast("long").alias("parts")), "groups")
    shares = cells.join(groups, ["lang", "source"]).withColumn("p", F.expr(share("n", "total", "v")))

    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.withColumn("value", F.col("p") - F.expr(share("all_n", "lang_total", "v"))).where("value > 0")
    term_part = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= ranks)

    def in_tiles(rows: DataFrame) -> DataFrame:
        other = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return other.withColumns({"i": F.least("block", "_b"), "j": F.greatest("block", "_b")}).drop("_b")

    heavy = (F.col("groups") * HEAVY >= F.col("of")).alias("heavy")
    posted = shares.withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts"))).select("lang", "block", "blocks", "part", "term", "g", "p", heavy)
    seeds = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("lang", "block", "blocks", "part", F.lit(None).cast("string").alias("term"), "g", F.col("low").alias("p"), F.lit(False).alias("heavy"))
    keys = ["lang", "i", "j", "part"]
    dealt = in_tiles(posted.unionByName(seeds)).select(*keys, "term", "g", "p", "heavy").repartition(n, *keys).sortWithinPartitions(*keys, F.asc_nulls_first("term"), "g")
    sums = dealt.mapInArrow(tidy(tiles), "lang string, g long, h long, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))

    side = groups.select("lang", "source", "g", "low", "v")
    named = sums.join(side, ["lang", "g"]).join(side.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("low").alias("low_h")), ["lang", "h"])
    named = named.select("lang", "source", "item", (F.col("value") + F.col("v") * F.abs(F.col("low") - F.col("low_h"))).alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = named.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    pair_part = pairs.withColumn("rank", F.row_number().over(by_group))
    return pair_part.unionByName(term_part).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))
