"""What a key means: its normal form and its category.

Keys are few, values are many: each distinct key of a batch is looked at once, and a worker keeps what it found.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that classify a key.
SRC = ("src", "source", "client", "remote", "raddr", "peer", "origin", "from", "caller")
DST = ("dst", "dest", "destination", "server", "local", "laddr", "target", "to", "callee")
KINDS = {
    "port": ("port", "sport", "dport"),
    "ip": ("ip", "ipaddr", "addr", "address"),
    "host": ("host", "hostname", "computer", "device", "node", "machine"),
    "User": ("user", "username", "account", "acct", "principal", "subject", "actor", "login", "logon", "uid"),
    "Process": ("process", "proc", "image", "exe", "program", "binary", "app"),
    "Command": ("cmd", "command", "commandline", "argv", "args"),
    "Path": ("path", "filepath", "file", "filename", "directory", "dir"),
    "Url": ("url", "uri", "request", "resource"),
    "Domain": ("domain", "fqdn", "hostdomain", "dns", "servername", "sni"),
    "FileHash": ("hash", "sha256", "sha1", "md5", "checksum", "fingerprint"),
    "Timestamp": ("timestamp", "time", "ts"),
}
#: Whole keys that are classified at once.
EXACT = {"sport": "SourcePort", "dport": "DestPort"} | dict.fromkeys(("srcip", "src_ip", "source_ip", "source_ip_address", "sourceip"), "SourceIp") | dict.fromkeys(("dstip", "dst_ip", "destination_ip", "dest_ip", "destinationip"), "DestIp")
#: Confidence of a category; 2 where it isn't named, and for address keys without a word of PLAIN_IP.
CONFIDENCE = {"SourcePort": 3, "DestPort": 3, "SourceIp": 3, "DestIp": 3, "Timestamp": 1}
PLAIN_IP = ("ip", "ipaddr")

_CUT = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])")
_NOT_KEY = re.compile(r"[^a-z0-9]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(65_536)
def normal(key: str) -> str:
    """snake_case of a key: parts end at case changes, between letters and digits, and at other characters."""
    return _NOT_KEY.sub("_", _CUT.sub("_", key).translate(_UPPER)).strip("_")


@lru_cache(65_536)
def category_of(norm: str) -> str | None:
    """Category of a normal key, or None."""
    if norm in EXACT:
        return EXACT[norm]
    words = set(norm.split("_"))
    source, dest = not words.isdisjoint(SRC), not words.isdisjoint(DST)
    if source and dest:
        return None
    if source or dest:
        for kind in ("port", "ip", "host"):
            if not words.isdisjoint(KINDS[kind]):
                return ("Source" if source else "Dest") + kind.title()
    return next((name for name, of in KINDS.items() if name[0].isupper() and not words.isdisjoint(of)), None)


def confidence_of(norm: str) -> int | None:
    """1..3; an address key without the word `ip` is worth 2."""
    cat = category_of(norm)
    if cat in ("SourceIp", "DestIp") and norm not in EXACT and set(norm.split("_")).isdisjoint(PLAIN_IP):
        return 2
    return None if cat is None else CONFIDENCE.get(cat, 2)


def _over_distinct(f, kind: str, arrow: pa.DataType):
    """A column function that applies f to the distinct texts of each batch."""

    def run(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        made = pa.array([f(t) for t in coded.dictionary.to_pylist()], arrow)
        return made.take(coded.indices)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def normal_key(key: Column) -> Column:
    return _over_distinct(normal, "string", pa.string())(key)


def category(norm: Column) -> Column:
    return _over_distinct(category_of, "string", pa.string())(norm)


def confidence(norm: Column) -> Column:
    return _over_distinct(confidence_of, "int", pa.int32())(norm)
