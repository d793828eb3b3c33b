"""The pipeline against a brute-force version of its stages."""

import corpus_pipeline
from tidewatch.llm import op2_secret_scan, op4_quality

from ..conftest import SF
from . import brute


def test_pipeline(spark, documents):
    texts = dict(documents)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    forest = op4_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in op4_quality.rate(docs, forest).where("kept").collect()}
    kept = {d for d, _, c, k in brute.components([(d, t) for d, t in documents if d in good], 80) if k}
    words = lambda t: __import__("re").findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    grams = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    bench = set().union(*(grams(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    clean = {d for d in kept if not grams(words(texts[d])) & bench}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == clean
    plain = [d for d in clean if not op2_secret_scan.find(texts[d])]
    assert plain and all(got[d].decoded_sha256 == brute.sha(texts[d]) for d in plain)
    assert len(corpus_pipeline.STAGES) == 5
