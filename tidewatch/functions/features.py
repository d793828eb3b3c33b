"""From token events to features and entities, in native columns.

Keys come classified from the tokenizer; values are told by their shape, in expressions that only the categories they are for
evaluate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_H = r"[0-9A-Fa-f]{1,4}"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV6 = (
    rf"^(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{6}}{_V4}|(?:{_H}:){{1,7}}:|:(?::{_H}){{1,7}}|"
    + "|".join(rf"(?:{_H}:){{1,{n}}}(?::{_H}){{1,{7 - n}}}" for n in range(1, 7))
    + "|"
    + "|".join(rf"(?:{_H}:){{1,{n}}}(?::{_H}){{0,{5 - n}}}:{_V4}" for n in range(1, 6))
    + rf"|::(?:{_H}:){{0,5}}{_V4}|::)$"
)


def lower(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r\u0085\u00a0"))


def word_feature(raw: Column) -> Column:
    """w=<word>, or null if too short or without letter or digit."""
    kept = F.substring(lower(F.regexp_replace(raw, r"[^A-Za-z0-9_./:@\\-]", "")), 1, 64)
    return F.when((F.length(kept) >= 2) & kept.rlike("[a-z0-9]"), F.concat(F.lit("w="), kept))


def user_parts(v: Column) -> Column:
    """struct<raw, principal, domain> of a stripped value, or null."""
    win, upn = v.contains("\\"), v.contains("@")
    right = F.substring_index(v, "@", -1)
    left_upn = F.regexp_extract(v, r"(?s)^(.*)@[^@]*$", 1)
    left_win, right_win = F.substring_index(v, "\\", 1), F.regexp_extract(v, r"(?s)^[^\\]*\\(.*)$", 1)
    ok = F.when(win, (left_win != "") & (right_win != "")).when(upn, (left_upn != "") & (right != "") & (right.contains(".") | right.rlike("^[A-Za-z0-9_-]*$"))).otherwise(v != "")
    name = F.when(win, right_win).when(upn, left_upn).otherwise(v)
    principal = F.regexp_replace(F.regexp_replace(lower(strip(name)), r"[^a-z0-9._-]", "_"), r"^_+|_+$", "")
    domain = lower(strip(F.when(win, left_win).when(upn, right)))
    return F.when(ok, F.struct(v.alias("raw"), F.when(principal != "", principal).alias("principal"), F.when(domain != "", domain).alias("domain")))


def host_name(v: Column) -> Column:
    """A stripped value as host name, or null."""
    h = lower(F.regexp_replace(v, r"\.+$", ""))
    return F.when(h.rlike(r"^(?=.{1,255}$)(?=.*[a-z])[a-z0-9._-]+$") & ~h.rlike(IPV4), h)


_COLUMNS = ("_v", "_ip", "_user", "_host")


def with_parts(events: DataFrame) -> DataFrame:
    """events (columns kind, norm, category, value) with what the rules look at, each computed once for an event.

    The steps are projections of their own: an expression that used its parts in place would repeat them many times.
    """
    out = events.withColumn("_v", F.when(F.col("category").isNotNull(), strip(F.coalesce("value", F.lit("")))))
    cat, v = F.col("category"), F.col("_v")
    ip = F.when(cat.isin("SourceIp", "DestIp"), F.when(v.rlike(IPV4), "<IPV4>").when(v.contains(":"), F.when(v.rlike(IPV6), "<IPV6>")))
    host = F.when(cat.isin("SourceHost", "DestHost", "Domain"), host_name(v))
    return out.withColumns({"_ip": ip, "_user": F.when(cat == "User", user_parts(v)), "_host": host})


def pair_features() -> Column:
    """array<string> of a pair in the columns of with_parts: key presence, category, shape, network."""
    norm, cat, v, ip = (F.col(c) for c in ("norm", "category", "_v", "_ip"))
    port = v.rlike(r"^\+?[0-9]+$") & v.try_cast("int").between(1, 65_535)
    stamp = (F.octet_length(v) >= 20) & (F.substring(v, 5, 1) == "-") & (F.substring(v, 8, 1) == "-") & v.contains("T")
    shape = (
        F.when(cat.isin("SourceIp", "DestIp"), ip)
        .when(cat == "User", F.col("_user.principal"))
        .when(cat.isin("SourceHost", "DestHost", "Domain"), F.when(F.col("_host").isNotNull(), "<HOSTNAME>"))
        .when(cat.isin("SourcePort", "DestPort"), F.when(port, "<PORT>"))
        .when(cat == "Timestamp", F.when(stamp, "<RFC3339_TS>"))
        .when(cat == "Url", F.when(v.rlike("^(?i)https?://"), "<URL>"))
        .when(cat == "Path", F.when(v.startswith("/"), "<UNIX_PATH>").when(v.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\)"), "<WIN_PATH>"))
    )
    net = F.when(ip == "<IPV4>", F.concat(cat, F.lit("_net@"), F.substring_index(v, ".", 3), F.lit(".0/24")))
    found = F.array(F.concat(F.lit("k="), norm), F.concat(F.lit("canon="), cat), F.concat(cat, F.lit("="), shape), net)
    return F.when(norm != "", F.array_compact(found)).otherwise(F.array().cast("array<string>"))


def pair_entities() -> Column:
    """array<struct<kind, value>> of a pair in the columns of with_parts."""
    cat, v, ip, user, host = (F.col(c) for c in ("category", "_v", "_ip", "_user", "_host"))

    def one(kind: Column, value: Column) -> Column:
        return F.when(kind.isNotNull() & value.isNotNull(), F.struct(kind.alias("kind"), value.alias("value")))

    known = user["principal"].isNotNull()
    host_kind = F.when(cat == "Domain", "Domain").when(cat.isin("SourceHost", "DestHost"), "Host")
    return F.array_compact(
        F.array(
            one(F.when(ip.isNotNull(), cat), F.when(ip == "<IPV6>", lower(v)).otherwise(v)),
            one(F.when(known, "UserRaw"), user["raw"]), one(F.when(known, "UserId"), user["principal"]), one(F.when(known, "Domain"), user["domain"]), one(host_kind, host),
        )
    )


def syslog_features(pri: Column, app: Column, version: Column) -> Column:
    word = F.regexp_replace(word_feature(app), "^w=", "")
    return F.array_compact(F.array(F.concat(F.lit("syslog_pri="), pri), F.concat(F.lit("syslog_app="), word), F.concat(F.lit("syslog_ver="), version)))


PAIRS = ("kv", "json", "csv")


def _address(w: Column) -> Column:
    return F.when(w.contains(".") & w.rlike(IPV4), "shape=<IPV4>").when(w.contains(":"), F.when(w.rlike(IPV6), "shape=<IPV6>"))


def word_features(word: Column, structured: Column) -> Column:
    """array<string> of a word of the tokenizer: only its characters are in it; addresses have a shape of their own where the
    line has no pairs."""
    w = lower(word)
    return F.array_compact(F.array(F.when((F.length(w) >= 2) & w.rlike("[a-z0-9]"), F.concat(F.lit("w="), w)), F.when(~structured, _address(word))))


def text_features(texts: Column, structured: Column) -> Column:
    """array<string> of the words of a text."""
    return F.array_compact(F.concat(F.transform(texts, word_feature), F.transform(texts, lambda w: F.when(~structured, _address(w)))))


def emitted(lines: DataFrame, counted: bool = False) -> DataFrame:
    """One row an event of lines (columns events, pri, app, version): features and entities arrays, other columns kept.

    Pairs, words and the rest go their own ways, so each of the three is a small expression.
    counted: equal events of equal lines are one row with their number n, so the rules see each once."""
    pairs = F.exists("events", lambda e: e["kind"].isin(*PAIRS))
    none = F.lit(None).cast("string")
    extra = F.transform(syslog_features(F.col("pri"), F.col("app"), F.col("version")), lambda s: F.struct(F.lit("ready").alias("kind"), none.alias("key"), none.alias("norm"), none.alias("category"), s.alias("value")))
    out = lines.withColumns({"_pairs": pairs, "_all": F.concat("events", extra)}).drop("events", "pri", "app", "version")
    # outer: a plain explode would push a size test, with all it is made of, down to the scan
    out = out.withColumn("_e", F.explode_outer("_all")).drop("_all").select("*", "_e.kind", "_e.key", "_e.norm", "_e.category", "_e.value").drop("_e").where("kind IS NOT NULL")
    if counted:
        out = out.groupBy(*out.columns).agg(F.count("*").alias("n"))
    out = with_parts(out)
    kind = F.col("kind")
    texts = F.filter(F.split(F.concat_ws(" ", "key", "value"), r"[ \t\n\f\r]+"), lambda w: w != "")
    no = F.array().cast("array<struct<kind:string,value:string>>")
    features = F.when(kind.isin(*PAIRS), pair_features()).when(kind == "ready", F.array("value")).when(kind == "word", word_features(F.col("value"), F.col("_pairs"))).otherwise(text_features(texts, F.col("_pairs")))
    entities = F.when(F.col("category").isNull(), no).otherwise(pair_entities())
    return out.withColumns({"features": features, "entities": entities}).drop("kind", "key", "norm", "category", "value", "_pairs", *_COLUMNS)
