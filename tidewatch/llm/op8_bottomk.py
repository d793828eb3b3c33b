"""MinHash near-dedup by bottom-k sketches from one hash function.

A document's set is its distinct 5-word shingles (A-Z lower-cased), each a 64-bit digest; equal sets are one class
from the start, so copies are never paired.  The K least digests of a class are its sketch.

Inverted lists hold the LISTED least values.  A pair of similarity 0.85 shares 27 of the union's 32 least values on
average and fewer than 14 with probability under MISSED, so two such sketches meet already in their prefixes of
32 - 14 + 1 values, in an order that is the same for all (rarest value first): frequent values are no lists
for documents that have rarer ones.  Lists are split by set size, since linked sizes are within the similarity.

A list never gives all its pairs.  First each member meets the list's least id; of these pairs, the sketch of the union
drops those whose estimate is far below the threshold (6 standard deviations), full sets confirm the rest, and the
links found make components.  Lists whose members are then in different components are left to an exact prefix filter
over the full sets of their members: values in one common order, rarest first, a short prefix on the side of the
smaller set and a longer one on the other, and at a shared value what is left of both sets must still reach the
threshold.  In a large group of copies that were each edited too much, the edits' own values fill the prefixes, so
such a group gives few pairs instead of all.  Full sets confirm these pairs too.  What two documents share beyond
the LISTED values is not looked at for candidates; `exact` runs the prefix filter over all documents instead.

Defined cases: documents with fewer than 5 words have their whole sequence as one shingle; without words, or with
null text, a document is linked with nothing; a null doc_id is linked with nothing, has a null component and is
kept; rows that repeat a doc_id are judged each by their own text, and of the rows of a component's least doc_id one is
kept, that of the least digest of the text; an empty table gives an empty result; extra columns stay with `dedup`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_aside, settled, spread_join, table, tidy
from .components import components
from .kernels import Digests, ascii_lower, chunks, grams, mix, new_key, spans, utf8, word_table

WORDS, K, LISTED = 5, 64, 32
#: The chance that a pair at the threshold is not met.
MISSED = 1e-8
#: Ids up to this number (8 bytes each) are broadcast to pick documents; beyond it the join is shuffled.
MOST_BROADCAST = 2_000_000


def shingle_sets(buf: np.ndarray, offs: np.ndarray, key: int = 0):
    """Yields (first row, sorted distinct digests of all rows, counts) for successive rows."""
    for a, b in chunks(offs):
        own, o, rows = ascii_lower()[buf[offs[a] : offs[b]]], offs[a : b + 1] - offs[a], b - a
        starts, ends, row = spans(own, o, word_table())
        word = Digests(own, key).of(starts, ends)
        n_words = np.bincount(row, minlength=rows)
        first = np.cumsum(n_words) - n_words
        keys, owner = [], []
        g = grams(word, WORDS)
        if len(g):
            inside = np.flatnonzero(row[: len(g)] == row[WORDS - 1 :])
            keys.append(g[inside]), owner.append(row[inside])
        for k in range(1, WORDS):
            few = np.flatnonzero(n_words == k)
            if len(few):
                keys.append(grams(word, k)[first[few]]), owner.append(few)
        if not keys:
            yield a, np.zeros(0, np.uint64), np.zeros(rows, np.int64)
            continue
        h, r = np.concatenate(keys), np.concatenate(owner)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        yield a, h[new], np.bincount(r[new], minlength=rows)


def _signed(x: np.ndarray) -> np.ndarray:
    """The order of unsigned values as signed ones."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, key: int = 0) -> DataFrame:
    """row, doc_id, tie (a digest of the text), n, d1, d2 (digests of the set), sketch (its K least values in order)."""

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column("text"))
            for row, h, n in shingle_sets(buf, offs, key):
                upto = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h * np.uint64(c)), dtype=np.uint64)]) for c in (3, 5)]
                d1, d2 = ((s[upto[1:]] - s[upto[:-1]]).view(np.int64) for s in sums)
                place = np.arange(len(h)) - np.repeat(upto[:-1], n)
                sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.minimum(n, K))]), pa.int32()), pa.array(_signed(h[place < K])))
                own = [batch.column(c).slice(row, len(n)) for c in ("row", "doc_id", "tie")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2), sketch], names=["row", "doc_id", "tie", "n", "d1", "d2", "sketch"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(tidy(run), "row long, doc_id long, tie long, n long, d1 long, d2 long, sketch array<long>")


def least_shared(similarity: float) -> int:
    """Of the LISTED least values of a union, how many a pair shares but with probability MISSED."""
    total = 0.0
    for k in range(LISTED + 1):
        total += math.comb(LISTED, k) * similarity**k * (1 - similarity) ** (LISTED - k)
        if total > MISSED:
            return k
    return LISTED


def inverted(classes: DataFrame, similarity: float = 0.85) -> DataFrame:
    """v, band, id, n: the lists, with those of one member where another value of a band is shared."""
    listed = classes.select("id", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    uses = settled(listed.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "uses")
    # a smaller set is listed whole; some of its values may be beyond the LISTED least of a larger partner
    cut = F.greatest(F.floor(F.col("n") / similarity) - LISTED, F.lit(0))
    least = F.when(F.col("n") >= LISTED, F.lit(least_shared(similarity))).otherwise(F.greatest(F.ceil(F.col("n") * similarity) - cut, F.lit(1)))
    prefix = F.least(F.col("n"), F.lit(LISTED)) - least + 1
    # values of one class come first in the order and make no lists
    values = spread_join(listed, uses, ["v"], "df").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    alone = F.least(F.col("n"), F.lit(LISTED)) - F.size("vs")
    values = values.select("id", "n", F.explode(F.slice("vs", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int"))).alias("x"))
    band = F.floor(F.ln(F.col("n").cast("double")) / -math.log(similarity)).cast("int")
    return values.select("id", "n", "x.v", F.explode(F.array(band, band + 1)).alias("band"))


def _estimated(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose union sketch doesn't rule the threshold out."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    same = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    size = F.size(union)
    enough = same >= F.floor(size * (similarity - 6 * math.sqrt(similarity * (1 - similarity)) / F.sqrt(size.cast("double"))))
    return both.where(enough).select("a", "b", "na", "nb")


def full_sets(docs: DataFrame, ids: DataFrame, key: int = 0) -> DataFrame:
    """id, members (the whole set in order) of the documents in ids."""
    n = ids.count()
    picked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if n <= MOST_BROADCAST else ids, "id")

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column("text"))
            for row, h, n in shingle_sets(buf, offs, key):
                members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(_signed(h)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(n)), members], names=["id", "members"])

    return picked.mapInArrow(tidy(run), "id long, members array<long>")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    a, b = (sets.select(F.col("id").alias(x), F.col("members").alias(f"m{x}")) for x in "ab")
    both = pairs.select("a", "b").join(b, "b").join(a, "a")
    same = F.size(F.array_intersect("ma", "mb"))
    return both.where(100 * same >= percent * (F.size("ma") + F.size("mb") - same)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of documents of different components (labels: id, c) that the prefix filter can't rule out."""
    values = sets.select("id", F.size("members").cast("long").alias("n"), F.explode("members").alias("v"))
    common = settled(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "common")
    kept = spread_join(values, common, ["v"], "df").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    kept = kept.join(labels, "id")
    # values of one document only come first in the order and meet nobody
    alone = F.col("n") - F.size("vs")
    need = lambda total: F.ceil(F.lit(percent) * total / F.lit(100 + percent))
    index = F.col("n") - need(2 * F.col("n")) + 1
    probe = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    short = F.slice("vs", F.lit(1), F.greatest(probe - alone, F.lit(0)).cast("int"))
    entries = kept.select("id", "n", "c", index.alias("index"), alone.alias("alone"), F.posexplode(short).alias("i", "x")).select("id", "n", "c", "index", (F.col("alone") + F.col("i") + 1).alias("place"), "x.v")
    left = entries.where("place <= index").select("v", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("place").alias("pa"))
    right = entries.select("v", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("place").alias("pb"))
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    near = 100 * F.col("na") >= percent * F.col("nb")
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1 >= need(F.col("na") + F.col("nb"))
    met = left.join(right, (left.v == right.v) & (F.col("ca") != F.col("cb")) & order & near & reach)
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    exact: candidates come from the prefix filter over the full sets of all documents alone, which misses nothing but
    shuffles all shingles.
    """
    return _judged(docs, percent, exact).select("doc_id", "n_shingles", "component_id", "kept")


def _own_ids(docs: DataFrame, classes: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, docs) where doc_ids repeat (again): classes of such an id get ids of their own, digests, which their first
    text has in docs too; no two rows of docs have one id."""
    named = classes.join(again, classes.doc == again.doc_id).select("d1", "d2", "n", "doc", "tie", F.xxhash64("doc", "d1", "d2", "n").alias("own"))
    named = settled(named, "named")
    classes = classes.join(named.select("d1", "d2", "n", "own"), ["d1", "d2", "n"], "left").withColumn("id", F.coalesce("own", "id")).drop("own")
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = each.join(again, "doc_id", "left_semi").withColumn("tie", F.xxhash64("text")).join(named.withColumnRenamed("doc", "doc_id"), ["doc_id", "tie"])
    first = first.select(F.col("own").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    return settled(classes, "classes"), each.join(again, "doc_id", "left_anti").unionByName(first)


def _all_links(docs: DataFrame, classes: DataFrame, percent: int, key: int) -> DataFrame:
    """u, v: all pairs of classes at the threshold, but for some inside components that others already tie."""
    labels = classes.select("id", F.col("id").alias("c"))
    sets = settled(full_sets(docs, labels.select("id"), key), "sets")
    return _links(prefix_pairs(sets, labels, percent), sets, percent)


def _sketch_links(docs: DataFrame, classes: DataFrame, percent: int, key: int) -> DataFrame:
    """u, v: links whose components are those of all links that the inverted lists meet."""
    lists = settled(inverted(classes, percent / 100), "lists")
    pivots = lists.groupBy("v", "band").agg(F.min("id").alias("a"), F.min_by("n", "id").alias("na"), F.count("*").alias("m")).where("m > 1")
    pivots = settled(pivots, "pivots")
    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    first = spread_join(lists, pivots, ["v", "band"], "m").where(F.col("id") > F.col("a")).where(near(F.col("n"), F.col("na"))).select("a", F.col("id").alias("b")).distinct()
    tested = settled(_estimated(first, classes, percent / 100).select("a", "b"), "pairs")
    ids = tested.select(F.col("a").alias("id")).unionByName(tested.select(F.col("b").alias("id"))).distinct()
    links = settled(_links(tested, settled(full_sets(docs, ids, key), "sets"), percent), "links")
    # members of lists that the first links left apart
    labelled = lists.join(components(links), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    apart = labelled.groupBy("v", "band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("m")).where("low < high").select("v", "band", "m")
    left = settled(spread_join(labelled, settled(apart, "lists-apart"), ["v", "band"], "m", "left_semi").select("id", "c").distinct(), "apart")
    sets = settled(full_sets(docs, left.select("id"), key), "sets")
    return links.unionByName(_links(prefix_pairs(sets, left, percent), sets, percent))


def _judged(docs: DataFrame, percent: int, exact: bool = False) -> DataFrame:
    """near_duplicates with tie, a digest of the text."""
    key = new_key()
    made = settled(sketches(docs, key), "sketches")
    classes = made.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "tie")).alias("least"), F.first("sketch").alias("sketch"))
    classes = settled(classes.select("d1", "d2", "n", F.col("least.doc_id").alias("id"), F.col("least.doc_id").alias("doc"), "least.tie", "sketch"), "classes")
    again = settled(made.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"), "again")
    repeats = again.count() > 0
    if repeats:
        classes, docs = _own_ids(docs, classes, again)
    found = components(_all_links(docs, classes, percent, key) if exact else _sketch_links(docs, classes, percent, key))
    named = classes.select("d1", "d2", "n", "id", "doc").join(found, "id", "left").select("d1", "d2", "n", "doc", F.coalesce("component", "id").alias("c"))
    if repeats:  # ids are not all doc_ids: a component's least doc_id is that of its classes
        named = settled(named, "components")
        named = named.join(named.groupBy("c").agg(F.min("doc").alias("least")), "c")
    else:
        named = named.withColumn("least", F.col("c"))
    out = made.select("row", "doc_id", "tie", "d1", "d2", "n").join(named.drop("doc"), ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    out = out.select("row", "doc_id", "tie", "c", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    if repeats:
        out = settled(out, "judged")
        first = out.where("kept AND c IS NOT NULL").join(again, "doc_id", "left_semi").groupBy("c", "doc_id").agg(F.min(F.struct("tie", "row")).alias("first"))
        out = out.join(first, ["c", "doc_id"], "left").withColumn("kept", F.col("kept") & F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "tie")


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, the one of least doc_id.

    Rows are met again by doc_id and digest; of rows that agree in both, where not all are kept, one is.
    """
    judged = _judged(docs.select("doc_id", "text"), percent).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_dk"), F.col("tie").alias("_tk"))
    cut = settled(judged.agg(F.bool_or("kept").alias("one"), F.bool_and("kept").alias("all")).where("NOT all").select("_dk", "_tk", "one"), "gone")
    counts = {r["one"]: r["count"] for r in cut.groupBy("one").count().collect()}
    if sum(counts.values()) <= MOST_BROADCAST:
        cut = F.broadcast(cut)
    docs, back = set_aside(docs, "_dk", "_tk")
    keyed = docs.withColumns({"_dk": F.col("doc_id").cast("long"), "_tk": F.xxhash64("text")})
    kept = keyed.join(cut, ["_dk", "_tk"], "left_anti").select(*docs.columns)
    if True in counts:
        row = F.struct(*docs.columns)
        once = keyed.join(cut.where("one"), ["_dk", "_tk"], "left_semi").groupBy("_dk", "_tk").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("r"))
        kept = kept.unionByName(once.select("r.*"))
    return kept.withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
