"""Secret scans with corpus-wide ownership frequency.

Base patterns find assignments, access keys and hex runs in every whole text.  The method adds `token` spans:
other runs of 24 or more characters that look random.  The digests of all candidate values are counted by
distinct repositories and owners over the whole corpus; a value of few owners and few repositories is owner-specific and
looks live, a value of many of either is a widely copied example.  A token span stays if its value is owner-specific;
base spans stay always, and `n_live` and `n_copied` tell their values apart.  The numbers of repositories, owners and uses
are given with each span.

A span is the whole match, in code points, end exclusive.  Defined cases: null or empty texts have no spans; a very long
text is scanned whole, in time that grows with its length; a null repository or owner counts as one of its own; repeated
rows are judged each; an empty table gives an empty result; input columns other than the named ones are not read, and
`redacted` keeps them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, set_aside, settled, spread_join, table, tidy

#: The kinds in their order, and their patterns (assign: on bytes with A-Z lower-cased).
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
HEX_LONG = re.compile(rb"[0-9a-f]{16,}")
TOKEN = re.compile(rb"[A-Za-z0-9_\-]{24,}")
MIXED = re.compile(rb"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", re.S)


def entropy(value: bytes) -> float:
    """Bits for each character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def find(text: str, least_entropy: float = 3.5) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) of each candidate by start, then kind; code points."""
    raw = text.encode("utf-8", "surrogatepass")
    found = [(m.start(), 0, m.end(), raw[m.start(2) : m.end(2)]) for m in ASSIGN.finditer(raw.lower()) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    # a maximal run of 16 or more is the same match whether shorter runs are matched and dropped or skipped
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX_LONG.finditer(raw)]
    begins, ends, reach = [], [], 0  # of the spans so far, by start, each with the furthest end up to it
    for a, _, b, _ in sorted(found):
        reach = max(reach, b)
        begins.append(a), ends.append(reach)
    for m in TOKEN.finditer(raw):
        before = bisect_left(begins, m.end())
        if not (before and ends[before - 1] > m.start()) and MIXED.match(m[0]) and entropy(m[0]) >= least_entropy:
            found.append((m.start(), 3, m.end(), m[0]))
    found.sort(key=lambda x: x[:2])
    if found and len(raw) != len(text):
        marks = sorted({p for a, _, b, _ in found for p in (a, b)})
        chars, at, done = {}, 0, 0
        for p in marks:
            at += len(raw[done:p].decode("utf-8", "surrogatepass"))
            chars[p], done = at, p
        found = [(chars[a], k, chars[b], v) for a, k, b, v in found]
    return found


#: Up to this many spans (about 40 bytes each) are broadcast with their documents' keys.
MOST_BROADCAST = 500_000
#: A value of more owners, or of more repositories, is a copied example.
MOST_OWNERS, MOST_REPOS = 1, 3
_SCANNED = "row long, doc_id long, tie long, repo string, owner string, kinds array<int>, starts array<long>, ends array<long>, values array<string>"


def scan(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """One row for each document: its candidates, their values as digests."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), repo.cast("string").alias("repo"), owner.cast("string").alias("owner"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            got = [find(t.as_py()) for t in batch.column("text")]
            columns = [
                pa.array([[x[1] for x in g] for g in got], pa.list_(pa.int32())),
                pa.array([[x[0] for x in g] for g in got], pa.list_(pa.int64())),
                pa.array([[x[2] for x in g] for g in got], pa.list_(pa.int64())),
                pa.array([[hashlib.blake2b(x[3], digest_size=16).hexdigest() for x in g] for g in got], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *columns], names=["row", "doc_id", "tie", "repo", "owner", "kinds", "starts", "ends", "values"])

    return rows.mapInArrow(tidy(run), _SCANNED)


def ownership(scanned: DataFrame) -> DataFrame:
    """value, n_repos, n_owners, n_uses over the corpus.  Each number is a count of counts, so no value's uses meet in one row."""
    uses = scanned.select(F.explode("values").alias("value"), "repo", "owner")
    by = uses.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    owners = by.groupBy("value", "owner").agg(F.sum("n").alias("n")).groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_uses"))
    repos = by.groupBy("value", "repo").count().groupBy("value").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "value")


def secrets(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """row, doc_id, tie (a digest of the text), base and all spans (arrays of start, kind, end), n_live and n_copied of the base values,
    uses (all spans with n_repos, n_owners and n_uses of their values)."""
    scanned = settled(scan(docs, repo if repo is not None else F.col("source"), owner if owner is not None else F.col("source")), "secrets")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos)
    owned = settled(ownership(scanned).select("value", "n_repos", "n_owners", "n_uses", live.alias("live")), "owned")
    each = scanned.where(F.size("values") > 0).select("row", F.explode(F.arrays_zip("starts", "kinds", "ends", "values")).alias("x"))
    each = spread_join(each.select("row", "x.starts", "x.kinds", "x.ends", F.col("x.values").alias("value")), owned, ["value"], "n_uses")
    span = F.struct(F.col("starts").alias("start"), F.col("kinds").alias("kind"), F.col("ends").alias("end"))
    counted = F.struct(F.col("starts").alias("start"), F.col("kinds").alias("kind"), F.col("ends").alias("end"), F.col("n_repos").cast("long").alias("n_repos"), F.col("n_owners").cast("long").alias("n_owners"), F.col("n_uses").cast("long").alias("n_uses"))
    base = F.col("kinds") < 3
    found = each.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(base, span))).alias("base"),
        F.sort_array(F.collect_list(F.when(base | F.col("live"), span))).alias("spans"),
        F.count_if(base & F.col("live")).alias("n_live"),
        F.count_if(base & ~F.col("live")).alias("n_copied"),
        F.sort_array(F.collect_list(F.when(base | F.col("live"), counted))).alias("uses"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    unused = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,n_repos:bigint,n_owners:bigint,n_uses:bigint>>")
    return scanned.select("row", "doc_id", "tie").join(found, "row", "left").select("row", "doc_id", "tie", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("uses", unused).alias("uses"))


def joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """text with each span (merged where they overlap) replaced by a mark."""
    out, at, last = [], 0, -1
    for a, b in sorted(spans):
        if a >= last:
            out += [text[at:a], "[SECRET]"]
        at = last = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """docs with all secrets of their texts replaced by a mark.  Texts are met again by doc_id and digest."""
    found = secrets(docs, repo, owner, most_owners, most_repos).where(F.size("spans") > 0)
    found = settled(found.select(doc_key().alias("_dk"), F.col("tie").alias("_tk"), F.col("spans").alias("_spans")).dropDuplicates(["_dk", "_tk"]), "spans")
    if (found.agg(F.sum(F.size("_spans") + 1)).first()[0] or 0) <= MOST_BROADCAST:
        found = F.broadcast(found)
    docs, back = set_aside(docs, "_dk", "_tk", "_spans")
    keyed = docs.withColumns({"_dk": doc_key(), "_tk": F.xxhash64("text")}).join(found, ["_dk", "_tk"], "left")
    columns = docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t.as_py() if s is None else redact(t.as_py(), [(x["start"], x["end"]) for x in s]) for t, s in zip(batch.column("text"), batch.column("_spans").to_pylist())]
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(columns)

    return keyed.mapInArrow(tidy(run), docs.schema).withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), "n_live", "n_copied", F.array_join(F.transform("uses", lambda u: u["n_repos"].cast("string")), ",").alias("n_repos"))
