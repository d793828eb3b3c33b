"""Benchmark decontamination with built-in functions only.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all non-ASCII characters.  Each benchmark
item gives its windows of `n` consecutive words (one shorter window, if it has fewer words); their distinct
hashes are broadcast behind a check of their number, beyond which the same join is shuffled.  Every window of
every document probes them with its hash and place alone, so a long text is no wider than a short one; hits of a row meet
in one small aggregation.  Then the documents with hits, and no others, are read again, and a comparison of the words
verifies each hit.

Defined cases: a null or empty text or one of punctuation only has no words and no hits; a very long text takes time in
proportion to its length; an item without words has no windows; repeated rows are judged each; empty tables give empty
results or no hits; extra columns stay with `clean` and are not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, set_aside, settled, table

#: A word in a text not yet lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to this many rows of hashes (about 32 bytes each) or bytes of windows the benchmark side is broadcast.
MOST_BROADCAST, MOST_BYTES = 500_000, 32 << 20


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    return F.transform(raw_words(text), lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """gram (words), size, key, items: one row for each distinct window."""
    w = F.col("w")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
    grams = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size(w) > 0)
    grams = grams.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(w, i, n))).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items")).select("gram", F.size("gram").alias("size"), F.xxhash64(F.transform("gram", lambda x: F.xxhash64(x))).alias("key"), "items")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, tie (a digest of the text), n_words, n_hit, n_items, items_sha256, contaminated, spans of each row.

    spans: sorted array of (first hit word, words), counted from 1.
    """
    bench = settled(benchmark_windows(benchmark, n), "windows")
    sizes = bench.groupBy("size").agg(F.count("*").alias("count"), F.sum(F.octet_length(F.array_join(F.concat("gram", "items"), " "))).alias("bytes")).collect()  # n rows at most
    windows, size_of = sum(r["count"] for r in sizes), sum(r["bytes"] for r in sizes)
    keys = bench.select("key", F.col("size").alias("len"), F.lit(True).alias("met")).distinct()
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("tie"), words(F.col("text")).alias("w"))
    d = d.select("row", "doc_id", "tie", F.size("w").cast("long").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))

    def probes(size: int) -> Column:
        starts = F.when(F.size("h") >= size, F.sequence(F.lit(1), F.size("h") - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(size).alias("len"), F.xxhash64(F.slice("h", i, size)).alias("key")))

    none = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("key")))
    each = d.select("row", "doc_id", "tie", "n_words", F.explode(F.concat(none, *[probes(r["size"]) for r in sorted(sizes)])).alias("p")).select("row", "doc_id", "tie", "n_words", "p.*")
    met = each.join(F.broadcast(keys) if windows <= MOST_BROADCAST else keys, ["key", "len"], "left").where("met OR len = 0")
    met = settled(met.groupBy("row", "doc_id", "tie", "n_words").agg(F.collect_set(F.when(F.col("met"), F.struct("at", "len"))).alias("hits")), "hits")
    # the words of the hits, of each text once
    few = settled(met.where(F.size("hits") > 0).select(doc_key().alias("dk"), "tie", "hits").dropDuplicates(["dk", "tie"]), "texts")
    some = few.select("dk", "tie", "hits")
    if (few.agg(F.sum(F.size("hits") + 1)).first()[0] or 0) <= MOST_BROADCAST:
        some = F.broadcast(some)
    texts = docs.select(doc_key().alias("dk"), F.xxhash64("text").alias("tie"), "text").join(some, ["dk", "tie"])
    # the explode keeps the words from being put in place of their name, where each hit would find them anew
    own = texts.select("dk", "tie", "hits", F.explode(F.array(words(F.col("text")))).alias("w")).select("dk", "tie", F.explode(F.transform("hits", lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), F.slice("w", x["at"], x["len"]).alias("gram")))).alias("x"))
    same = bench.select("gram", "items")
    verified = own.select("dk", "tie", "x.*").join(F.broadcast(same) if size_of <= MOST_BYTES else same, "gram")
    verified = verified.groupBy("dk", "tie").agg(
        F.array_sort(F.collect_set(F.struct("at", "len"))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    verified = settled(verified, "verified")
    if (verified.agg(F.sum(F.size("at") + F.size("items"))).first()[0] or 0) <= MOST_BROADCAST:
        verified = F.broadcast(verified)
    found = met.drop("hits").withColumn("dk", doc_key()).join(verified, ["dk", "tie"], "left")
    found = found.withColumns({"at": F.coalesce("at", F.array().cast("array<struct<at:int,len:int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def cover(a: Column, x: Column) -> Column:
        end = x["at"] + x["len"]
        return F.struct(F.greatest(a.end, end).alias("end"), (a.n + F.greatest(end - F.greatest(a.end, x["at"]), F.lit(0))).alias("n"))

    return found.select(
        "doc_id",
        "tie",
        "n_words",
        F.aggregate("at", start, cover).n.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("at") > 0).alias("contaminated"),
        F.col("at").alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop: bool = True) -> DataFrame:
    """docs without its contaminated rows (drop), or with the hit words cut out of their texts.

    Found rows are met again by doc_id and a digest of the text; rows that agree in both have the same hits.
    """
    bad = settled(hits(docs, benchmark, n).where("contaminated").select(doc_key().alias("_dk"), F.col("tie").alias("_tk"), F.col("spans").alias("_spans")).dropDuplicates(["_dk", "_tk"]), "contaminated")
    if drop:
        bad = bad.drop("_spans")
    if (bad.agg(F.sum(F.lit(1) if drop else F.size("_spans"))).first()[0] or 0) <= MOST_BROADCAST:
        bad = F.broadcast(bad)
    docs, back = set_aside(docs, "_dk", "_tk", "_spans", "_parts")
    keyed = docs.withColumns({"_dk": doc_key(), "_tk": F.xxhash64("text")})
    if drop:
        return keyed.join(bad, ["_dk", "_tk"], "left_anti").select(*docs.columns).withColumnsRenamed(back)
    span = lambda at, end: F.struct(at.cast("int").alias("at"), end.cast("int").alias("end"))

    def merge(done: Column, s: Column) -> Column:
        last, end = F.element_at(done, -1), s["at"] + s["len"]
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(span(last["at"], F.greatest(last["end"], end))))
        return F.when(s["at"] <= last["end"], longer).otherwise(F.concat(done, F.array(span(s["at"], end))))

    # disjoint ranges of hit words, after an empty one at the first word
    merged = F.aggregate("_spans", F.array(span(F.lit(1), F.lit(1))), merge)
    bad = bad.select("_dk", "_tk", merged.alias("_spans"))
    keyed = keyed.join(settled(bad, "cuts"), ["_dk", "_tk"], "left")
    w, gaps = raw_words(F.col("text")), F.split("text", WORD, -1)
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(w)), w, lambda gap, word: F.concat(gap, word))
    # exploded, so it is made once and not anew for each span
    parts = F.when(F.col("_spans").isNotNull(), F.struct(gaps.alias("gaps"), both.alias("both"), F.size(w).alias("n")))
    keyed = keyed.withColumn("_parts", F.explode(F.array(parts)))
    stop = lambda i: F.coalesce(F.get("_spans", i + 1)["at"], F.col("_parts.n") + 1)
    text = lambda array, a, b: F.array_join(F.slice(array, a, b - a), "")
    cut = F.transform("_spans", lambda x, i: F.concat(text(F.col("_parts.gaps"), x["at"], x["end"]), text(F.col("_parts.both"), x["end"], stop(i))))
    cut = F.concat(F.array_join(cut, ""), F.element_at("_parts.gaps", -1))
    return keyed.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut)).select(*docs.columns).withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i : i + 9] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS s FROM bw),
dw AS (SELECT r, i, s, w[i : i + s - 1] AS g FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, sizes WHERE len(w) >= s)),
hit AS (SELECT dw.r, dw.i, dw.s, bw.item_id FROM dw JOIN bw USING (g)),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + s)) AS p FROM (SELECT DISTINCT r, i, s FROM hit)) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.xs, '')) AS items_sha256, pos.n IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
