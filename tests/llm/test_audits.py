"""The quality classifier, the divergence of sources and periodic runs, against slow versions from the definitions, and their defined cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidewatch.llm import nbsvm, op11_quality_nbsvm, op12_divergence, op13_periodic_runs
from tidewatch.llm.kernels import utf8

from ..conftest import SF, rows_of
from . import brute

LARGER = SF.replace("sf0.001", "sf0.01")
DOCS = "doc_id long, text string, lang string, source string"


def slow_runs(words, least=24, periods=3):
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def slow_row(doc_id, text):
    words = brute.WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    figures = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *figures, brute.sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), brute.sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def as_rows(df, columns=COLUMNS):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
            words = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, 9)
                words = [words[i] if i < a else words[min(n - 1, a + (i - a) % p)] for i in range(n)]
            docs.append(words)
        least, periods = rng.choice([2, 6, 24]), rng.choice([2, 3])
        got = op13_periodic_runs.runs_of(docs, least, periods)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [slow_runs(d, least, periods) for d in docs]


def test_runs_of_special_words():
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 600:
        fib = fib[1], fib[1] + fib[0]
    morse = [b"%d" % (bin(i).count("1") % 2) for i in range(700)]
    docs = [fib[1], morse, [b"x"] * 900, [b"x", b"y"] * 300 + [b"x"] * 40 + [b"x", b"y"] * 30, []]
    got = op13_periodic_runs.runs_of(docs, 2, 2)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [slow_runs(d, 2, 2) for d in docs]
    values = np.array([0, *([1, 2, 3, 4] * 20), *range(1, 200), 1, 0])  # more rounds than pointers are followed
    at = np.arange(1, len(values) - 1)
    before = [max(j for j in range(i) if values[j] < values[i]) for i in at]
    after = [min(j for j in range(i + 1, len(values)) if values[j] <= values[i]) for i in at]
    assert op13_periodic_runs.nearest(values, at, -1).tolist() == before and op13_periodic_runs.nearest(values, at, 1).tolist() == after


def test_periodic_query(spark, documents):
    want = sorted((slow_row(d, t) for d, t in documents), key=str)
    got = as_rows(op13_periodic_runs.query(spark, SF))
    assert got == want and sum(r[1] > 0 for r in got) > 10


def test_periodic_edges(spark, edge, empty):
    ties = " ".join(["a b"] * 12 + ["-"] + ["c d"] * 12)
    rows = [*[(r.doc_id, r.text) for r in edge.collect()], (30, ties), (31, "so " * 5000), (31, "so " * 5000), *[(i, " é " + " ".join(map(str, range(i % 50)))) for i in range(100, 200)]]
    df = spark.createDataFrame([(d, t, "mine", 7) for d, t in rows], "doc_id long, text string, period string, own int")
    made = op13_periodic_runs.periodic_runs(op13_periodic_runs.woven(df), collapsed=True, listed=True)
    assert as_rows(made) == sorted((slow_row(d, t) for d, t in rows), key=str)
    by = {r.doc_id: r for r in made.collect()}
    assert by[30].start == 0 and by[30].exponent_milli == 12_000 and by[30].collapsed == "a b - c d" and [tuple(x) for x in by[30].runs] == [(0, 24, 2), (25, 24, 2)]
    assert by[31].own == 7 and by[31].n_words == 5000 and by[31].collapsed == "so" and by[1].collapsed == "" and by[1].n_runs == 0
    assert made.columns[:2] == ["doc_id", "own"] and op13_periodic_runs.periodic_runs(empty).count() == 0


def test_periodic_very_long(spark):
    """4 MB in one text: 300,000 words that hardly repeat, then 40,000 in a period of 1,000."""
    words = [f"word{i * 7919 % 300_007}" for i in range(300_000)] + [f"p{i % 1000}" for i in range(40_000)]
    row = op13_periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (row.n_words, row.n_runs, row.start, row.length, row.period) == (340_000, 1, 300_000, 40_000, 1000)
    assert row.collapsed_sha256 == brute.sha(" ".join(words[:301_000]))


def test_divergence_sql(spark, duck):
    assert rows_of(op12_divergence.query(spark, LARGER).toPandas()) == rows_of(duck(documents=pd.read_parquet(f"{LARGER}/documents.parquet")).execute(op12_divergence.SQL).df())


def slow_divergence(rows, least, ranks=50):
    import re

    groups, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for _, text, lang, source in rows:
        terms = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    for lang in {x for x, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: c for (x, s), c in groups.items() if x == lang}
        whole = sum(own.values(), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])[:ranks]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item.decode(), -value, i) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


DIVERGENCE = ("lang", "source", "part", "item", "value", "rank")


def test_divergence_edges(spark, edge, empty):
    rng = random.Random(3)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in edge.collect()]
    rows += [(i, " ".join(rng.choice(["Alpha", "beta,gamma", "é_Ü", "x1y", "日本", "Éa", f"w{rng.randrange(40)}"]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ab", "ä", None, f"s{i % 12}"])) for i in range(300)]
    rows += [(900, "one lone source", "solo", "z"), (901, None, "none", "p"), (902, "", "none", "q"), (903, "rare words only", "none", "r"), rows[0], rows[-1]]
    df = spark.createDataFrame([(*r, "mine") for r in rows], DOCS + ", value string")
    for least in (1, 3, 30):
        assert as_rows(op12_divergence.divergence(df, least), DIVERGENCE) == sorted(slow_divergence(rows, least), key=str)
    assert op12_divergence.divergence(empty).count() == 0


@pytest.mark.parametrize("block,cells", [(2, 1 << 21), (3, 4), (256, 7)])
def test_tiles(monkeypatch, block, cells):
    """Dense and sparse sums over several tiles and parts, in batches that cut terms, are those of the definition."""
    monkeypatch.setattr(op12_divergence, "BLOCK", block), monkeypatch.setattr(op12_divergence, "CELLS", cells)
    rng, n, parts = random.Random(block), 7, 3
    low = [rng.randrange(50) for _ in range(n)]
    posts = {f"t{t}": {g: rng.randrange(1000) for g in rng.sample(range(n), rng.randint(1, n))} for t in range(60)}
    blocks, rows = -(-n // block), []
    for g in range(n):
        for other in range(blocks):
            i, j = sorted((g // block, other))
            rows += [("en", i, j, part, None, g, low[g], False) for part in range(parts)]
            rows += [("en", i, j, int(t[1:]) % parts, t, g, p[g], len(p) * 4 >= n * 2) for t, p in posts.items() if g in p]
    rows.sort(key=lambda r: (*r[:4], r[4] or "", r[5]))
    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "i", "j", "part", "term", "g", "p", "heavy"), r)) for r in rows], schema=pa.schema([("lang", "string"), ("i", "int64"), ("j", "int64"), ("part", "int64"), ("term", "string"), ("g", "int64"), ("p", "int64"), ("heavy", "bool")]))
    got = Counter()
    for out in op12_divergence.tiles(batch.slice(a, 11) for a in range(0, len(rows), 11)):
        for r in out.to_pylist():
            got[r["g"], r["h"]] += r["value"]
    want = {(g, h): sum(abs(p.get(g, low[g]) - p.get(h, low[h])) - abs(low[g] - low[h]) for p in posts.values()) for g in range(n) for h in range(g + 1, n)}
    assert dict(got) == want


def test_divergence_long_text(monkeypatch):
    text = " ".join(f"Word{i % 97} é{i % 5}" for i in range(4000))
    buf, _ = utf8(pa.array([text]))
    terms, _, n, _ = op12_divergence._counts(buf, np.array([0, len(buf)]), np.zeros(1, np.int64))
    monkeypatch.setattr(op12_divergence, "MERGED", 1000)
    some, m = op12_divergence._long(buf)
    assert dict(zip(some.to_pylist(), m.tolist())) == dict(zip(terms.to_pylist(), n.tolist())) == Counter(__import__("re").findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.replace("W", "w")))


def test_share_beyond_64_bits(spark):
    n, total, v = 5 * 10**15 + 1, 6 * 10**15, 12_345
    got = spark.range(1).selectExpr(f"CAST({n} AS LONG) n", f"CAST({total} AS LONG) t", f"CAST({v} AS LONG) v").selectExpr(op12_divergence.share("n", "t", "v") + " AS p").first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_descend():
    """The dual solution is optimal: no weight vector nearby is better, and the duality gap closes."""
    rng = np.random.default_rng(2)
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    dense = rng.normal(size=(60, 8)) + 0.3 * y[:, None]
    w, bias, dual = nbsvm.descend([(np.arange(8), v) for v in dense], y, 8, 0.7, 500, 1e-7)

    def primal(w, b):
        return (w @ w + b * b) / 2 + 0.7 * np.maximum(0, 1 - y * (dense @ w + b)).sum()

    assert np.allclose(w, (dual * y) @ dense) and abs(primal(w, bias) - (dual.sum() - (w @ w + bias * bias) / 2)) < 1e-4
    assert all(primal(w + 1e-2 * rng.normal(size=8), bias + 1e-2 * rng.normal()) >= primal(w, bias) - 1e-6 for _ in range(200))
    r = nbsvm.ratios([np.array([0, 1]), np.array([1]), np.array([2])], np.array([1, 1, 0]), 3)
    assert np.allclose(r, np.log([2 / 4 / (1 / 3), 3 / 4 / (1 / 3), 1 / 4 / (2 / 3)]))


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in op11_quality_nbsvm.query(spark, LARGER).collect()}
    labels = pd.read_parquet(f"{LARGER}/labels.parquet")[["doc_id", "quality"]].itertuples(index=False, name=None)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in rows.items())
    held = [(rows[d].predicted, q) for d, q in labels if d in rows and rows[d].held_out]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.95 * len(held)
    assert all(any(p == q for p, q in held if q == kind) for kind in (0, 1))


def test_quality_learns_only_outside(spark):
    """Held-out labels turned around change no score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - quality, quality) AS quality")
    a, b = (op11_quality_nbsvm.fit(docs, x) for x in (labels, turned))
    assert np.array_equal(a.weight, b.weight) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)
    assert np.array_equal(op11_quality_nbsvm.fit(docs.repartition(7), labels.repartition(5)).weight, a.weight)


def slow_indicators(text):
    import re

    from tidewatch.llm.kernels import Digests, mix

    raw, found, words = (text or "").encode(), set(), (text or "").encode().split()
    found |= {raw[i] * 256 + raw[i + 1] for i in range(len(raw) - 1)}
    h, last = [], None
    for w in words:
        s = re.sub(rb"0+", b"0", re.sub(rb"A+", b"A", re.sub(rb"a+", b"a", re.sub(rb"[0-9]", b"0", re.sub(rb"[A-Z]", b"A", re.sub(rb"[a-z\x80-\xff]", b"a", w))))))
        s = re.sub(rb"(.)\1+", rb"\1", s, flags=re.S)
        h.append(mix(np.array([1], np.uint64))[0] if w == last else Digests(np.frombuffer(s, np.uint8)).of(np.array([0]), np.array([len(s)]))[0])
        last = w
    two = [mix(np.array([a * np.uint64(3) ^ b], np.uint64))[0] for a, b in zip(h, h[1:])]
    return found | {int(x % np.uint64(op11_quality_nbsvm.SHAPES)) + op11_quality_nbsvm.PAIRS for x in [*h, *two]}


@pytest.mark.parametrize("chunk", [1 << 19, 200])
@pytest.mark.filterwarnings("ignore:overflow")
def test_indicators(monkeypatch, chunk):
    rng = random.Random(chunk)
    monkeypatch.setattr(op11_quality_nbsvm, "CHUNK", chunk)
    texts = [None, "", "a", " ", "é", *["".join(rng.choice("ab AB\n09é!|") for _ in range(rng.randint(0, 1200))) for _ in range(80)]]
    texts += [" ".join(rng.choice(["so", "So", "of", "OF!!", "12"]) for _ in range(420)) for _ in range(30)]
    got = [set() for _ in texts]
    for row, rows, r, code in op11_quality_nbsvm.indicators(*utf8(pa.array(texts))):
        for i, c in zip(r.tolist(), code.tolist()):
            assert c not in got[row + i] and i < rows
            got[row + i].add(c)
    assert got == [slow_indicators(t) for t in texts]


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(20, 1), (21, 1), (22, None), (23, 0), (23, 0), (None, 0), (4, 2)], "doc_id long, quality int")
    given = edge.withColumn("score", edge.source)
    model = op11_quality_nbsvm.fit(given, labels)
    rows = op11_quality_nbsvm.rate(given, model).collect()
    assert len(rows) == given.count() and all(0 <= r.score <= 1 for r in rows) and rows[0].kept
    blank = {r.score for r in rows if not r.text}
    assert len(blank) == 1
    none = op11_quality_nbsvm.fit(given, labels.where("quality = 1"))
    assert {r.score for r in op11_quality_nbsvm.rate(given, none).collect()} == {(n + 1) / (n + 2) for n in [sum(zlib.crc32(str(d).encode()) % 4 != 2 for d in (20, 21))]}
    assert {r.score for r in op11_quality_nbsvm.rate(given, op11_quality_nbsvm.fit(empty, labels)).collect()} == {0.5}
    assert op11_quality_nbsvm.rate(empty, model).count() == 0
    long = spark.createDataFrame([(1, "Plain words here and there. " * 100_000, "k"), (1, None, "k")], "doc_id long, text string, predicted string")
    assert [r.predicted in (0, 1) for r in op11_quality_nbsvm.rate(long, model).collect()] == [True, True]
