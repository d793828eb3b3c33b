"""Envelope, tokenizer, features and ids, line by line."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions import ids, keys
from tidewatch.functions.envelope import with_envelope
from tidewatch.functions.tokens import events_of, events_of_bytes, tokenize

JAN1 = 1_704_067_200 + 3600


def peel(spark, line, ingest=JAN1):
    return with_envelope(spark.createDataFrame([(line,)], "line string"), ingest).select("p.*").first()


@pytest.mark.parametrize(
    "line, want",
    [
        ('<34>1 2024-01-05T13:00:01Z edge sshd 77 ID1 [a@1 x="y]z"][b] hello there', {"pri": 34, "version": 1, "ts": 1704459601, "host": "edge", "app": "sshd", "procid": "77", "msgid": "ID1", "structured_data": '[a@1 x="y]z"][b]', "msg": "hello there"}),
        ("<34>1 2024-01-05T13:00:01.5+02:00 - app - - - hi", {"ts": 1704452401, "host": None, "app": "app", "procid": None, "msg": "hi"}),
        ("<13>Jan  1 00:10:00 box cron[12]: job done", {"ts": 1704067800, "host": "box", "app": "cron", "procid": "12", "msg": "job done"}),
        ("Dec 31 23:59:59 box cron: late", {"ts": 1704067199, "app": "cron", "procid": None, "msg": "late"}),
        ("2024-01-05 13:00:01 box app: said so", {"ts": 1704459601, "host": "box", "app": "app", "msg": "said so"}),
        ("2024-01-05T13:00:01 app: said so", {"ts": 1704459601, "host": None, "app": "app", "msg": "said so"}),
        ("<13>just text", {"pri": 13, "ts": None, "msg": "just text"}),
        ("no header: at all", {"pri": None, "ts": None, "msg": "no header: at all"}),
        ("Jan 1 00:10:00 box fw: 2024-01-05T13:00:01Z: %ASA-6-1: built", {"ts": 1704459601, "embedded_ts": 1704459601, "peeled": ["2024-01-05T13:00:01Z"], "msg": "%ASA-6-1: built"}),
    ],
)
def test_envelope(spark, line, want):
    got = peel(spark, line).asDict()
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize(
    "msg, want",
    [
        ('a=1 b="two words" c: [x (y)] d=e,', [("kv", "a", "1"), ("kv", "b", "two words"), ("kv", "c", "[x (y)]"), ("kv", "d", "e"), ("word", None, "two"), ("word", None, "words")]),
        ("see http://x/y then k=v", [("kv", "k", "v"), ("word", None, "see"), ("word", None, "http://x/y"), ("word", None, "then")]),
        ('{"b":{"c":[1,true,{"z":1}]},"a":null}', [("json", "a", "null"), ("json", "b_c", "1"), ("json", "b_c", "true")]),
        ("CEF:0|v|p|1|9|n|5|src=1.2.3.4 msg=a b\\=c", [("kv", "src", "1.2.3.4"), ("kv", "msg", "a b=c"), ("cef", "version", "0"), ("cef", "device_vendor", "v"), ("cef", "device_product", "p"), ("cef", "device_version", "1"), ("cef", "signature_id", "9"), ("cef", "name", "n"), ("cef", "severity", "5")]),
        ("CEF:0|broken", [("word", None, "CEF:0"), ("word", None, "broken")]),
        ("{broken", [("word", None, "broken")]),
    ],
)
def test_tokens(msg, want):
    assert events_of(msg).out == want


def test_caps_and_counters():
    got = events_of(" ".join(f"k{i}=v" for i in range(70)) + " " + "ab " * 300)
    assert len(got.out) == 256 and got.pairs == 64 and got.hits["kv_cap"] and got.hits["token_cap"]
    assert events_of("{bad}").hits["json_errors"] == 1 and events_of("CEF:0|x").hits["cef_errors"] == 1
    assert events_of_bytes(b"\xff" * 16_385).hits["too_long"] == 1 and events_of_bytes(b"\xff").hits["utf8_fallback"] == 1
    assert events_of("1,2", ["a", "b"]).out == [("csv", "a", "1"), ("csv", "b", "2")]


def test_native_words_equal_python(spark):
    texts = ["plain words only", "", "a bc d-e/f", "é über x@y.z", "x" * 70]
    df = spark.createDataFrame([(t,) for t in texts], "msg string").select("msg", tokenize(F.col("msg")).alias("e"))
    for r in df.collect():
        assert [(e.kind, e.key, e.value) for e in r.e] == events_of(r.msg).out


@pytest.mark.parametrize("key, want", [("SourceIpAddress", "SourceIp"), ("src-address", "SourceIp"), ("source.address", "SourceIp"), ("dport", "DestPort"), ("remote_host", "SourceHost"), ("username", "User"), ("sha256", None), ("src_to_dst_port", None), ("request", "Url"), ("time", "Timestamp")])
def test_categories(spark, key, want):
    got = spark.createDataFrame([(key,)], "k string").select(keys.category(keys.normal_key(F.col("k"))).alias("c")).first()
    assert got.c == want


def test_smoke_line(spark):
    line = "<34>1 2024-01-05T13:00:00Z host sshd 1 ID - src_ip=10.2.3.4 user=alice action=login result=success"
    from tidewatch.plans.analyze import parsed

    df = parsed(spark.createDataFrame([("t", "d", line, 10)], "tenant_id string, device_key string, line string, byte_len long"))
    got = sorted(r.f for r in df.select(F.explode("features").alias("f")).collect())
    assert got == sorted("SourceIp=<IPV4> User=alice SourceIp_net@10.2.3.0/24 k=action k=result k=src_ip k=user canon=SourceIp canon=User syslog_app=sshd syslog_pri=34 syslog_ver=1".split())
    entities = {(r.e.kind, r.e.value) for r in df.select(F.explode("entities").alias("e")).collect()}
    assert entities == {("SourceIp", "10.2.3.4"), ("UserRaw", "alice"), ("UserId", "alice")}


def test_blake3_vectors():
    data = bytes(i % 251 for i in range(2049))
    assert ids.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert ids.blake3(data[:1]).hex() == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert ids.blake3(data[:1025]).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_tokenizer_never_fails(text):
    out = events_of(text)
    assert len(out.out) <= 256 and out.pairs <= 64
