"""Each operator against SQL or brute force, and its defined cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import gbt, op1_chat_format, op2_secret_scan, op3_decontaminate, op4_quality, op5_bpe, op6_suffix_dedup, op7_recompression, op8_bottomk, op9_url_filter, op10_token_blocks
from tidewatch.llm.kernels import utf8

from ..conftest import SF, rows_of
from . import brute


def tuples(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("module", [op1_chat_format, op3_decontaminate, op9_url_filter])
def test_sql(spark, duck, module):
    assert rows_of(module.query(spark, SF).toPandas()) == rows_of(duck().execute(module.SQL).df())


def test_chat_edges(spark):
    said = "<|im_end|>\\<|x|> <\\|y <<|"
    turns = [(1, 2, "assistant", said), (1, 1, "us\ner<|n|>", None), (1, 3, "user", "bye"), (None, 1, "assistant", ""), (2, 1, None, "x"), (2, 1, None, "x"), (3, None, "assistant", "z")]
    made = op1_chat_format.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in op1_chat_format.summary(made).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == brute.sha(f"us\ner<|n|>\n\nassistant\n{said}\nuser\nbye\n") and got[1].loss_sha256 == brute.sha(said)
    assert got[None].loss_chars == 0 and got[2].n_turns == 2 and got[3].loss_chars == 1
    assert op1_chat_format.summary(op1_chat_format.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_secrets(spark, edge, documents, empty):
    got = op2_secret_scan.secrets(edge).select("doc_id", op2_secret_scan.joined("base").alias("b")).collect()
    want = sorted((str(r.doc_id), brute.secrets(r.text)) for r in edge.collect())
    assert sorted((str(r.doc_id), r.b) for r in got) == want
    rows = {r.doc_id: r.base_sha256 for r in op2_secret_scan.query(spark, SF).collect()}
    assert all(rows[d] == brute.sha(brute.secrets(t)) for d, t in documents)
    assert op2_secret_scan.secrets(empty).count() == 0
    live = "Zx9Kq2Lm7Np4Rt8Vw3Yb6Tg1"
    docs = spark.createDataFrame([(1, f"see {live}", "a", "en"), (2, live, "a", "de"), (3, live.swapcase() + " é", "a", "en"), (4, live.swapcase(), "b", "en")], "doc_id long, text string, source string, lang string")
    spans = {r.doc_id: r.s for r in op2_secret_scan.secrets(docs).select("doc_id", op2_secret_scan.joined("spans").alias("s")).collect()}
    assert spans == {1: "token:4:28", 2: "token:0:24", 3: "", 4: ""}
    clean = {r.doc_id: r.text for r in op2_secret_scan.redacted(docs).collect()}
    assert clean[1] == "see [SECRET]" and clean[4] == live.swapcase()
    assert op2_secret_scan.redact("abcdef", [(1, 3), (2, 4)]) == "a[SECRET]ef"


def test_decontaminate_edges(spark, edge, empty, duck):
    bench = spark.createDataFrame([(7, "WORD3 and3, word4 and4 word5 and5 word6 and6 word7 and0"), (8, None), (9, "ONE two"), (10, "!!"), (9, "one two")], "item_id long, text string")
    got = op3_decontaminate.hits(edge, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").toPandas()
    want = duck(documents=edge.toPandas(), benchmark=bench.toPandas()).execute(op3_decontaminate.SQL).df()
    assert rows_of(got) == rows_of(want) and got.contaminated.sum() > 2
    kept = op3_decontaminate.clean(edge, bench)
    assert kept.columns == edge.columns and 4 not in [r.doc_id for r in kept.collect()]
    cut = {r.doc_id: r.text for r in op3_decontaminate.clean(edge, bench, drop=False).collect()}
    assert cut[4] == "  three" and cut[0] is None and len(cut) > 10
    most, op3_decontaminate.MOST_BROADCAST = op3_decontaminate.MOST_BROADCAST, 0
    try:
        assert rows_of(op3_decontaminate.hits(edge, bench).drop("tie", "spans").toPandas()) == rows_of(want)
    finally:
        op3_decontaminate.MOST_BROADCAST = most
    assert op3_decontaminate.hits(empty, bench).count() == 0 and op3_decontaminate.hits(edge, bench.limit(0)).where("contaminated").count() == 0


def test_quality(spark, edge, documents, empty):
    rng = random.Random(5)
    texts = [None, "", *["".join(rng.choice(" ab\né#\t") for _ in range(rng.randint(0, 60))) for _ in range(300)]]
    base, _ = op4_quality.statistics(*utf8(pa.array(texts)))
    assert [tuple(b) for b in base] == [brute.quality(t) for t in texts]
    rows = {r.doc_id: r for r in op4_quality.query(spark, SF).collect()}
    for d, t in documents:
        want = brute.quality(t)
        assert tuple(rows[d][c] for c in op4_quality.BASE)[:4] == want[:4] and want[4] in (None, rows[d].n_repeat_words)
    larger = SF.replace("sf0.001", "sf0.01")  # enough labels to learn from
    rows = {r.doc_id: r for r in op4_quality.query(spark, larger).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    judged = [(rows[d].kept, q) for d, q in labels.items() if d in rows and not rows[d].base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged)
    forest = op4_quality.fit(edge, spark.createDataFrame([], "doc_id long, quality int"))
    rated = op4_quality.rate(edge, forest)
    assert rated.count() == edge.count() and op4_quality.rate(empty, forest).count() == 0 and dict(rated.dtypes)["kept"] == "boolean"


def test_trees_are_monotone():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * rng.standard_normal(3000) - x[:, 1] * 0.5) > 0.3).astype(float)
    f = gbt.train(x, y, np.array([1, -1, 0]))
    assert ((f.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.75
    grid = np.linspace(0, 1, 50)
    for j, sign in ((0, 1), (1, -1)):
        for row in x[:20]:
            probe = np.tile(row, (50, 1))
            probe[:, j] = grid
            assert (sign * np.diff(f.score(probe)) >= -1e-12).all()


def _encoding():
    import public_tokenizers as p
    import tiktoken

    ranks = op5_bpe.read_ranks(op5_bpe.vocabulary())
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, edge, documents, empty):
    want = _encoding()
    digest = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    rows = {r.doc_id: r for r in op5_bpe.query(spark, SF).collect()}
    for d, t in documents:
        assert rows[d].ids_sha256 == digest(want.encode_ordinary(t)) and rows[d].decoded_sha256 == brute.sha(t)
    rng = random.Random(2)
    texts = ["x" * 3000, "it's we'll've  \n\n a\n", *["".join(rng.choice(" '  slvrtemd\n\t1é! .A日") for _ in range(rng.randint(0, 40))) for _ in range(500)]]
    made = op5_bpe.Bpe(op5_bpe.vocabulary())
    got = []
    for _, flat, counts in made.encoder.texts(*utf8(pa.array(texts))):
        got += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
        assert made.decode(flat, counts) == [t.encode() for t in texts]
    assert got == [want.encode_ordinary(t) for t in texts]
    out = op5_bpe.bpe(edge, op5_bpe.vocabulary())
    assert out.count() == edge.count() and op5_bpe.bpe(empty, op5_bpe.vocabulary()).count() == 0
    assert all(r.n_tokens == len(r.ids) for r in out.collect())


COLUMNS = {
    op6_suffix_dedup: (("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.suffix),
    op7_recompression: (("doc_id", "n_words", "n_removed", "kept_sha256"), brute.windows13),
    op8_bottomk: (("doc_id", "n_shingles", "component_id", "kept"), brute.components),
}


@pytest.mark.parametrize("module", COLUMNS)
def test_dedup(spark, documents, module):
    columns, slow = COLUMNS[module]
    assert tuples(module.query(spark, SF), *columns) == sorted(slow(documents))


@pytest.mark.parametrize("module", COLUMNS)
def test_dedup_adversarial(spark, module):
    """Runs of one unit, overlapping and shifted copies, one head before many tails."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(0, "a " * 300), (1, "a " * 150 + "b"), (2, passage), (3, passage[37:] + " tail"), (4, "x" + passage), (5, "abab" * 100)]
    rows += [(10 + i, passage[:150] + " " + " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(30)]
    rows += [(50 + i, " ".join(rng.choice(vocabulary[:3]) for _ in range(200))) for i in range(10)]
    many = [rng.choice(vocabulary) + str(rng.random())[2:6] for _ in range(150)]
    for i in range(40):
        copy = list(many)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(150)] = f"edit{rng.random()}"
        rows.append((100 + i, " ".join(copy)))
    columns, slow = COLUMNS[module]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = {op6_suffix_dedup: lambda: op6_suffix_dedup.dedup(df, texts=False), op7_recompression: lambda: op7_recompression.dedup(df, texts=False), op8_bottomk: lambda: op8_bottomk.near_duplicates(df)}[module]()
    assert tuples(made, *columns) == sorted(slow(rows))


@pytest.mark.parametrize("module", [op6_suffix_dedup, op7_recompression])
def test_hot_cores_spread(spark, documents, module, monkeypatch):
    """With nearly every core hot, windows are settled across buckets."""
    import dataclasses

    monkeypatch.setattr(module, "KIND", dataclasses.replace(module.KIND, hot=1))
    columns, slow = COLUMNS[module]
    assert tuples(module.query(spark, SF), *columns) == sorted(slow(documents))


def test_dedup_edges(spark, edge, empty):
    for module in (op6_suffix_dedup, op7_recompression):
        assert module.dedup(edge).count() == edge.count() and module.dedup(empty).count() == 0
        twice = [r for r in module.dedup(edge).collect() if r.doc_id == 20]
        assert len(twice) == 2 and twice[0] == twice[1]
        assert twice[0].n_removed > 0  # a row without doc_id has its text
    got = op8_bottomk.near_duplicates(edge).collect()
    assert len(got) == edge.count() and all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id in (20, 21, 22)} == {20}
    assert op8_bottomk.near_duplicates(empty).count() == 0
    assert sorted({r.doc_id for r in op8_bottomk.dedup(edge).collect() if r.doc_id and r.doc_id >= 20}) == [20, 23]


def test_repeated_ids(spark):
    """Rows that repeat a doc_id are judged by their own texts; of equal rows one is kept."""
    rng = random.Random(6)
    texts = {k: [f"{k}{rng.random()}" for _ in range(120)] for k in "abcd"}
    near = lambda k: " ".join(["other", *texts[k][1:]])
    t = {k: " ".join(v) for k, v in texts.items()}
    rows = [(3, t["b"]), (5, t["a"]), (5, near("b")), (7, t["c"]), (7, t["c"]), (8, near("c")), (9, t["d"]), (9, near("d")), (None, t["a"]), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = tuples(op8_bottomk.near_duplicates(docs).where("n_shingles > 0 AND doc_id IS NOT NULL"), "doc_id", "component_id", "kept")
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 7, False), (7, 7, True), (8, 7, False), (9, 9, False), (9, 9, True)]
    kept = [(r.doc_id, r.text) for r in op8_bottomk.dedup(docs, 85).collect()]
    assert len(kept) == 7 and {(3, t["b"]), (5, t["a"]), (7, t["c"]), (None, t["a"]), (4, None), (4, "")} < set(kept)


def test_urls(spark, duck):
    import pandas as pd

    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://a.example.com/en/", "http://example.com/en", "ftp://x.net/es/?/fr/", "://com/", "http://notcom/", "http://a.b.net/fr/#x", "http://com?x", "http://u@EXAMPLE.com:80/en/"]
    frame = pd.DataFrame({"page_id": range(len(urls)), "url": urls, "rule": "clash"})
    got = op9_url_filter.filter_urls(spark.createDataFrame(list(frame.itertuples(index=False, name=None)), "page_id long, url string, rule string"))
    assert rows_of(got.drop("url").toPandas()[["page_id", "host", "path", "rule", "verdict"]]) == rows_of(duck(pages=frame[["page_id", "url"]]).execute(op9_url_filter.SQL).df())
    rules = spark.createDataFrame(list(op9_url_filter.RULES), "verdict string, host string, path string")
    joined = op9_url_filter.filter_urls_joined(got.drop("host", "path", "rule", "verdict").withColumnRenamed("page_id", "row_id"), rules)
    assert tuples(joined.fillna("-"), "row_id", "rule", "verdict") == tuples(got.fillna("-"), "page_id", "rule", "verdict")
    array = op9_url_filter.DigestArray(op9_url_filter.build([]))
    assert op9_url_filter.judge(array, [("a", "/")]) == [(None, False)]


def test_token_blocks(spark, edge, documents, empty):
    rng = np.random.default_rng(1)
    for n in (1, 7, 4096, 10_000):
        ids = np.concatenate([rng.integers(0, 50, n // 2), rng.integers(0, 1 << 32, n - n // 2, dtype=np.uint64)]).astype(np.uint32)
        shard = op10_token_blocks.Shard(op10_token_blocks.write_shard([1, None], np.array([n - 1, 1]), ids))
        assert (shard.ids() == ids).all() and (shard.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all() and shard.doc_ids == [1, None]
    want, at = [], 0
    tok = _encoding()
    for d, t in documents:
        ids = [*tok.encode_ordinary(t), 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert tuples(op10_token_blocks.query(spark, SF), "doc_id", "start", "n_tokens", "ids_crc32") == want
    got = op10_token_blocks.read_tokens(spark, op10_token_blocks.write_tokens(edge, op10_token_blocks.vocabulary())).orderBy("start").collect()
    assert len(got) == edge.count() and [r.doc_id for r in got] == sorted((r.doc_id for r in edge.collect()), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert op10_token_blocks.read_tokens(spark, op10_token_blocks.write_tokens(empty, op10_token_blocks.vocabulary())).count() == 0


def test_added_tokens():
    """Texts with added tokens get the ids of the library."""
    from tokenizers import Tokenizer

    path = op10_token_blocks.vocabulary()
    t = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", None, "plain text", "<|endoftext|>", "", "x<|endoftext|><|endoftext|>", "é's <|endoftext|", *["y <|endoftext|>"] * 70]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got = [x.tolist() for _, counts, ids in op10_token_blocks.encoded([batch], path, 2) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts] and 50_256 in got[0]


def test_pieces_are_kept_and_joined(monkeypatch):
    """Pieces that a task has met are not encoded again for the next one; joined ones have their own ids, also beside pieces like the separator."""
    from tokenizers import AddedToken, Tokenizer

    path = op10_token_blocks.vocabulary()
    t = Tokenizer.from_file(path)
    texts = ["<|endoftext|", "|>", "<", ">endoftext", " <|endo", "text|>", *[f"kept{k} pieces{k * 7919}\n\n  é{k}'s" for k in range(200)]]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    made = op10_token_blocks.encoder(path)
    made.forget()
    run = lambda: [x.tolist() for _, counts, ids in op10_token_blocks.encoded([batch], path, 2) for x in np.split(ids, np.cumsum(counts)[:-1])]
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert run() == want
    monkeypatch.setattr(made, "encode", None)
    assert run() == want
    assert op10_token_blocks.separator(t) == ("<|endoftext|>", 50_256)
    t.add_tokens([AddedToken("x<|end", normalized=False)])
    assert op10_token_blocks.separator(t) is None  # could start in a piece and end in the separator


def test_pieces_met_last_stay():
    from tidewatch.llm.pieces import Encoder

    asked = []
    made = Encoder(lambda pieces: asked.extend(pieces) or [list(p) for p in pieces], most=8)
    for text in ["a b c d e f", "a g h i", "a x y", "a g h i"]:
        got = [ids.tolist() for _, ids, _ in made.texts(*utf8(pa.array([text])))]
        assert got == [list(text.encode())]
    assert asked.count(b"a") == 1 and len(asked) == 6 + 3 + 2 and len(made.keys) <= 8


def test_secret_repositories(spark):
    live = "Zx9Kq2Lm7Np4Rt8Vw3Yb6Tg1"
    docs = spark.createDataFrame([(1, f"{live} token=abcdefghijkl0", "a", "en"), (2, live, "a", "de"), (3, "token=abcdefghijkl0", "b", None), (4, None, "b", "en")], "doc_id long, text string, source string, lang string")
    got = op2_secret_scan.secrets(docs, repo=docs.lang, owner=docs.source).collect()
    uses = {r.doc_id: [(u.start, u.kind, u.n_repos, u.n_owners, u.n_uses) for u in r.uses] for r in got}
    assert uses == {1: [(0, 3, 2, 1, 2), (25, 0, 2, 2, 2)], 2: [(0, 3, 2, 1, 2)], 3: [(0, 0, 2, 2, 2)], 4: []}


def test_ranks_are_whole():
    ranks = op5_bpe.read_ranks(op5_bpe.vocabulary())
    assert len(ranks) == 50_256
