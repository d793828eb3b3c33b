"""Texts that fooled polynomial digests, very long texts, repeats, clashing columns and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidewatch.llm import op2_secret_scan, op3_decontaminate, op4_quality, op5_bpe, op6_suffix_dedup, op7_recompression, op8_bottomk, op9_url_filter, op10_token_blocks
from tidewatch.llm.kernels import LONG, Digests, same_bytes, utf8
from tidewatch.llm.pieces import Encoder

from ..conftest import SF
from . import brute
from .test_operators import COLUMNS, _encoding, tuples


def thue_morse(n, a, b):
    """A sequence and its complement have the same polynomial digest modulo 2**64, whatever the odd base."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


PAIR = [thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")]


def test_digests():
    rng = random.Random(8)
    words = [*PAIR, *[bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))).decode() for _ in range(2000)], "x" * (LONG + 1), "x" * LONG]
    buf, offs = utf8(pa.array(words))
    h = Digests(buf).of(offs[:-1], offs[1:])
    assert len(set(h.tolist())) == len(set(words))
    a, b = np.array([0, 0]), np.array([0, 1])
    assert same_bytes(buf, offs[a], buf, offs[b], np.full(2, 2048)).tolist() == [True, False]


def test_thue_morse_statistics():
    texts = ["\n".join([*PAIR, "x y", "x y"]), " ".join([PAIR[0], "u", "v", PAIR[1], "u", "v"]), " ".join([PAIR[0], "u", "v"] * 2)]
    base, _ = op4_quality.statistics(*utf8(pa.array(texts)))
    assert [tuple(b) for b in base] == [brute.quality(t) for t in texts]


def test_thue_morse_ids():
    want = _encoding()
    long = " ".join(f"word{i % 977} and\n" for i in range(60_000))  # over a chunk
    texts = [*PAIR, " ".join(PAIR), long, "q" * 5000 + " " + PAIR[0] + long]
    made = op5_bpe.Bpe(op5_bpe.vocabulary())
    got = []
    for _, flat, counts in made.encoder.texts(*utf8(pa.array(texts))):
        got += np.split(flat, np.cumsum(counts)[:-1])
        assert made.decode(flat, counts)
    assert all(g.tolist() == want.encode_ordinary(t) for g, t in zip(got, texts)) and len(got) == len(texts)
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op10_token_blocks.vocabulary())
    got = [x.tolist() for _, counts, ids in op10_token_blocks.encoded([batch], op10_token_blocks.vocabulary(), 2) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [[*library.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert all(made.contracted([p.encode()])[0].tolist() == op5_bpe.by_heap(p.encode(), made.ranks) for p in (PAIR[0][:700], "abcabcabcab" * 20))


@pytest.mark.parametrize("most", [400_000, 3])
def test_pieces_with_one_digest(most):
    """Ids are right though all pieces have the same digest, and though the table is given up again and again."""
    made = Encoder(lambda pieces: [list(p) for p in pieces], most)
    if most > 3:
        made.digest = lambda part, starts, ends: np.full(len(starts), 7, np.uint64)
    texts = ["one two two", "", "two three", "one one"]
    got = [x.tolist() for _, flat, counts in made.texts(*utf8(pa.array(texts))) for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [list(t.encode()) for t in texts]


def _slow_dedup(spark, module, rows):
    columns, slow = COLUMNS[module]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = op8_bottomk.near_duplicates(df) if module is op8_bottomk else module.dedup(df, texts=False)
    assert tuples(made, *columns) == sorted(slow(rows))


def test_thue_morse_windows(spark):
    shared = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{PAIR[0]} {shared}"), (2, f"{PAIR[1]} {shared}"), (3, f"{PAIR[0]} {shared}"), (4, f"{PAIR[1]} {shared} x")]
    for module in COLUMNS:
        _slow_dedup(spark, module, rows)


def test_long_texts(spark):
    """Texts over the size that one step looks at, with repeats across the places where they are cut."""
    rng = random.Random(9)
    words = [f"{rng.randrange(1 << 30):x}" for _ in range(90_000)]
    passage = words[50_000:50_400]
    text = " ".join([*words, *passage, *words[:300]])
    assert len(text) > 1 << 19
    for module in (op6_suffix_dedup, op7_recompression):
        _slow_dedup(spark, module, [(1, text), (2, " ".join(passage)), (3, " ".join(["z", *words[64_000:66_000]])), (4, text[300_000:900_000])])


def test_long_hits(spark):
    words = [f"w{i}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "-".join(words[500:530])), (None, " ".join(words[:11]))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(words[100:40_100])), (6, " ".join(words[505:516]))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in op3_decontaminate.hits(docs, bench).collect()}
    assert got == {1: (60_000, 40_000, 2), 2: (30, 30, 2), None: (11, 0, 0)}
    cut = {r.doc_id: r.text.split() for r in op3_decontaminate.clean(docs, bench, drop=False).collect()}
    assert cut[1] == [*words[:100], *words[40_100:]] and cut[None] == words[:11]


def test_long_scan():
    token = lambda i: f"Zx9Kq2Lm7Np4Rt8Vw3Yb6T{i:05d}"
    text = " ".join(f"{token(i)} secret={token(i)}" for i in range(5000))
    found = op2_secret_scan.find(text)
    assert [k for _, k, _, _ in found].count(3) == 5000 and [k for _, k, _, _ in found].count(0) == 5000


def test_owners_and_repositories(spark):
    """A value of one owner in more repositories than MOST_REPOS is a copied example."""
    live = "Zx9Kq2Lm7Np4Rt8Vw3Yb6Tg1"
    rows = [(i, f"see {live}", "a", f"r{i}") for i in range(op2_secret_scan.MOST_REPOS)]
    spans = lambda rows: {r.s for r in op2_secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), repo=op2_secret_scan.F.col("lang")).select(op2_secret_scan.joined("spans").alias("s")).collect()}
    assert spans(rows) == {"token:4:28"} and spans([*rows, (9, live, "a", "r9")]) == {""}


def test_exact_candidates(spark):
    """The prefix filter over all documents finds the components that sketches find."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randint(3, 200))]
        for i in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"e{rng.random()}"
            rows.append((g * 10 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns, slow = COLUMNS[op8_bottomk]
    assert tuples(op8_bottomk.near_duplicates(df, exact=True), *columns) == tuples(op8_bottomk.near_duplicates(df), *columns) == sorted(slow(rows))


CLASH = ("kept", "quality", "base_failed", "recs", "spans", "dk", "tk", "_dk", "_tk", "_spans", "rule", "n_words")


@pytest.fixture(scope="module")
def clashing(spark, edge):
    return edge.drop("kept").withColumns({c: op2_secret_scan.F.lit(f"own {c}") for c in CLASH})


def _same_columns(made, given, but=()):
    assert [c for c in made.columns if c in given.columns] == [c for c in given.columns if c not in but]
    for row in made.limit(5).collect():
        assert all(row[c] == f"own {c}" for c in CLASH if c in made.columns and c not in but)


def test_clashing_columns(spark, clashing, empty):
    bench = spark.createDataFrame([(9, "one two")], "item_id long, text string")
    _same_columns(op2_secret_scan.redacted(clashing), clashing)
    for drop in (True, False):
        _same_columns(op3_decontaminate.clean(clashing, bench, drop=drop), clashing)
    _same_columns(op8_bottomk.dedup(clashing), clashing)
    for module in (op6_suffix_dedup, op7_recompression):
        made = module.dedup(clashing)
        own = {"text", "n_words", "kept"}
        assert {c for c in clashing.columns if c not in own} < set(made.columns)
        assert all(row[c] == f"own {c}" for row in made.limit(5).collect() for c in CLASH if c not in own)
    assert op2_secret_scan.redacted(empty).count() == op3_decontaminate.clean(empty, bench).count() == op8_bottomk.dedup(empty).count() == 0


def test_edge_values(spark, edge):
    """Nulls, ties and repeated rows: values, not counts."""
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in edge.dropDuplicates(["doc_id", "text"]).collect()), key=lambda r: (r[0], r[1] or ""))
    ids = {r[0]: i for i, r in enumerate(rows)}
    single = [(i, t) for i, t in rows if [x[0] for x in rows].count(i) == 1]
    assert len(ids) > 10
    for module in (op6_suffix_dedup, op7_recompression):
        columns, slow = COLUMNS[module]
        got = {tuple(r[c] for c in columns) for r in module.dedup(edge, texts=False).where("doc_id IS NOT NULL").collect()}
        null_first = [(-1, t) for i, t in rows if i == -1]
        want = {x for x in slow([*null_first, *single]) if x[0] >= 0}
        assert got == want


def test_urls_beyond_a_shipped_list(spark, monkeypatch):
    urls = ["http://www.example.com/en/x", "http://x.net/fr/", "http://a.b.com/", None, "none", "http://x.net/fr/", "http://é.net/es/é"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, _key string")
    want = tuples(op9_url_filter.filter_urls(df).fillna("-"), "page_id", "host", "path", "rule", "verdict", "_key")
    monkeypatch.setattr(op9_url_filter, "MOST_BYTES", 0)
    assert tuples(op9_url_filter.filter_urls(df).fillna("-"), "page_id", "host", "path", "rule", "verdict", "_key") == want and want[5][3:5] == ("net/fr/", "block")


def test_held_out_labels(spark):
    """Trees of half of the labels judge the other half."""
    larger = SF.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{larger}/labels.parquet")
    half = op2_secret_scan.F.pmod("doc_id", op2_secret_scan.F.lit(2))
    rated = op4_quality.rate(docs, op4_quality.fit(docs, labels.where(half == 0))).join(labels.where(half == 1).select("doc_id", op2_secret_scan.F.col("quality").alias("truth")), "doc_id")
    judged = [((r.quality >= 0.5), bool(r.truth)) for r in rated.collect()]
    assert len(judged) > 500 and sum(a == b for a, b in judged) >= 0.9 * len(judged)


def test_pipeline_edges(spark, clashing, empty):
    """Every stage over nulls, empty texts, ties, repeated rows and clashing columns, and over an empty table."""
    docs = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert sorted(got.columns) == sorted(docs.columns), name
        _same_columns(got, docs)
        none = stage(spark, empty, SF)
        assert none.count() == 0 and none.columns == empty.columns
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    assert kept <= {20, 21, 22, None}
    deduped = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    texts = [(r.doc_id, r.text) for r in deduped]
    assert texts.count((20, docs.where("doc_id = 20").first().text)) == 1 and (0, None) in texts and (1, "") in texts
    out = corpus_pipeline.bpe(spark, docs, SF)
    assert out.count() == docs.count() and corpus_pipeline.bpe(spark, empty, SF).count() == 0
    assert all(r.decoded_sha256 == brute.sha("") for r in out.where("n_tokens = 0").collect())


def test_shards_of_repeated_ids(spark):
    rows = [(5, "b"), (5, "a"), (None, "x"), (5, "b"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op10_token_blocks.read_tokens(spark, op10_token_blocks.write_tokens(docs, op10_token_blocks.vocabulary())).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 5, 5, 5] and got[1].n_tokens == 1 and got[1].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")
