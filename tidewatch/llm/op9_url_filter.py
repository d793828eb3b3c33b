"""URL filters: a sorted array of 64-bit digests of host/path rules, memory-mapped and probed by binary search.

A rule `host/path` fits its host and all subdomains if the url's path starts with the rule's path.  Every
(host suffix, path prefix) pair of a url whose prefix length some rule has is a possible key; distinct keys
are hashed once a batch, looked up in the sorted array by a vectorised binary search, and the string stored
with the digest confirms the hit.  The longest rule wins (host and path together, in characters; on a tie the longer
host).  A worker keeps the array it mapped last; a list too large to ship is joined by digest instead.

Defined cases: a null url or one without `://` has empty host and path and no rule; a very long url gives one key for each
label of its host and length of path; the verdict without a rule is `default`; repeated urls are judged each; an empty
table gives an empty result; extra columns of the input stay, and the result columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import mmap
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import set_aside, table, tidy

#: Verdict, host, path of the query's rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Above this size of the rule list the probe is a shuffled join instead of a shipped file.
MOST_BYTES = 256 << 20
_RECORD = np.dtype([("digest", "<u8"), ("at", "<u8"), ("size", "<u4"), ("block", "u1")])


def merged(rules: Iterable[tuple[str, str, str]]) -> dict[tuple[str, str], bool]:
    """(host, path) -> whether it blocks.  A repeated rule: block wins."""
    kept: dict[tuple[str, str], bool] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        kept[host, path] = kept.get((host, path), False) or verdict == "block"
    return kept


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The rule file: numbers of rules and of path lengths, the lengths, records sorted by digest, then the rule strings."""
    kept = {f"{host}{path}".encode(): block for (host, path), block in sorted(merged(rules).items(), key=lambda x: x[1])}
    paths = np.array(sorted({len(path) for (_, path) in merged(rules)}), "<u8")
    keys = sorted(kept, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    records = np.zeros(len(keys), _RECORD)
    records["digest"] = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
    records["at"], records["size"] = np.cumsum(sizes) - sizes, sizes
    records["block"] = np.fromiter((kept[k] for k in keys), np.uint8, len(keys))
    return b"".join([np.array([len(keys), len(paths)], "<u8").tobytes(), paths.tobytes(), records.tobytes(), *keys])


class DigestArray:
    """The rule file in a memory map that has no file."""

    def __init__(self, blob: bytes):
        self.map = mmap.mmap(-1, len(blob))
        self.map.write(blob)
        n, lengths = np.frombuffer(self.map, "<u8", 2).tolist()
        self.path_sizes = np.frombuffer(self.map, "<u8", lengths, 16).tolist()
        self.records = np.frombuffer(self.map, _RECORD, n, 16 + 8 * lengths)
        self.digests = np.ascontiguousarray(self.records["digest"])
        self.text = 16 + 8 * lengths + n * _RECORD.itemsize

    def key(self, i: int) -> bytes:
        r = self.records[i]
        return self.map[self.text + int(r["at"]) : self.text + int(r["at"]) + int(r["size"])]

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key's rule, or -1."""
        if not len(self.digests) or not keys:
            return np.full(len(keys), -1)
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, h, "left")
        out = np.full(len(keys), -1)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == h):
            j = at[i]
            while j < len(self.digests) and self.digests[j] == h[i]:
                if self.key(j) == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out


_mapped: dict[bytes, DigestArray] = {}


def mapped(name: bytes, blob: bytes) -> DigestArray:
    """The array of a rule file, named by its digest; the one before is given up."""
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = DigestArray(blob)
    return _mapped[name]


def judge(rules: DigestArray, parts: list[tuple[str, str]]) -> list[tuple[str | None, bool]]:
    """(rule, blocked) of each (host, path)."""
    wanted: dict[str, int] = {}
    options: list[list[tuple[int, int, int]]] = []
    for host, path in parts:
        mine = []
        at = 0
        while host:
            for n in rules.path_sizes:
                if n <= len(path):
                    key = host[at:] + path[:n]
                    mine.append((len(key), len(host) - at, wanted.setdefault(key, len(wanted))))
            dot = host.find(".", at)
            if dot < 0:
                break
            at = dot + 1
        options.append(mine)
    found = rules.probe([k.encode("utf-8", "surrogatepass") for k in wanted])
    out = []
    for mine in options:
        best = max(((size, host, found[k]) for size, host, k in mine if found[k] >= 0), default=None)
        out.append((None, False) if best is None else (rules.key(best[2]).decode(), bool(rules.records["block"][best[2]])))
    return out


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path, cut from the url by built-in functions."""
    has = F.col(url).contains("://")
    after = F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": F.when(has, lower).otherwise(""), "path": F.when(has, path).otherwise("")})


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict."""
    spark: SparkSession = df.sparkSession
    kept = [("block" if block else "allow", *key) for key, block in merged(rules).items()]
    blob = build(kept)
    if len(blob) > MOST_BYTES:
        return filter_urls_joined(df, spark.createDataFrame(kept, "verdict string, host string, path string"), url, default)
    shipped, name = spark.sparkContext.broadcast(blob), hashlib.blake2b(blob).digest()
    parts = with_parts(df.drop("host", "path", "rule", "verdict"), url)

    def run(batches):
        rules = mapped(name, shipped.value)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            unique = list(dict.fromkeys(zip(hosts, paths)))
            by = dict(zip(unique, judge(rules, unique)))
            got = [by[k] for k in zip(hosts, paths)]
            columns = [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([default if g[0] is None else "block" if g[1] else "allow" for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "rule", "verdict"])

    schema = T.StructType([*parts.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parts.mapInArrow(tidy(run), schema)


def filter_urls_joined(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """As filter_urls, for a rule table (verdict, host, path) of any size: digests meet in a shuffled join and full strings
    confirm.  Distinct urls are judged, so a url that very many rows have is one row here."""
    keys = rules.select(F.concat("host", "path").alias("_rule"), F.length("path").alias("_n"), F.length("host").alias("_h"), F.col("verdict").alias("_verdict"))
    keys = keys.groupBy("_rule", "_n", "_h").agg(F.max("_verdict").alias("_verdict")).withColumn("_key", F.xxhash64("_rule"))
    sizes = F.array(*[F.lit(r["_n"]) for r in keys.select("_n").distinct().collect()]).cast("array<int>")
    parts = with_parts(df.drop("host", "path", "rule", "verdict"), url)
    parts, back = set_aside(parts, "_want", "_key", "_best")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.struct(F.concat(s, F.substring(F.col("path"), F.lit(1), n)).alias("rule"), F.length(s).alias("h")))))
    probe = parts.select("host", "path").distinct().select("host", "path", F.explode(pairs).alias("_want")).withColumn("_key", F.xxhash64("_want.rule"))
    hits = probe.join(keys, "_key").where("_want.rule = _rule AND _want.h = _h").groupBy("host", "path").agg(F.max(F.struct(F.length("_rule"), "_h", "_rule", "_verdict")).alias("_best"))
    return parts.join(hits, ["host", "path"], "left").withColumns({"rule": F.col("_best._rule"), "verdict": F.coalesce("_best._verdict", F.lit(default))}).drop("_best").withColumnsRenamed(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'),
  ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
u AS (SELECT page_id, row_number() OVER () AS n, url LIKE '%://%' AS ok,
  substr(url, instr(url, '://') + 3) AS rest FROM pages),
p AS (SELECT page_id, n,
  CASE WHEN ok THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
m AS (SELECT p.n, arg_max(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) AS rule,
  arg_max(r.verdict, length(r.host || r.path) * 1000 + length(r.host)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.n)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""
