"""Syslog envelopes by regular expressions alone: priority, then RFC 5424, BSD, ISO heuristic, raw; native columns.

`with_envelope` adds struct<pri, version, ts, host, app, procid, msgid, structured_data, embedded_ts, peeled, msg>.
Being native, the time of a line can filter it before the tokenizer runs.  Each header is matched once, where the first
character allows it: its groups are joined by U+FFFF, which is no character (one in a line counts as U+FFFD), and split
again.  The steps are projections of their own, so no expression is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names of BSD headers.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_W = r"[ \t\n\x0B\f\r]"
_PRI = rf"(?s)^<([0-9]{{1,10}})>{_W}*(.*)$"
_ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})?"
_SD = r'(?:\[(?:[^\]"]|"(?:\\.|[^"\\])*")*\])+(?=$| )'
_RFC = rf"(?s)^([0-9]{{1,10}}){_W}+({_ISO}){_W}+(\S+){_W}+(\S+){_W}+(\S+){_W}+(\S+){_W}*(?:-|({_SD})){_W}*(.*)$"
_BSD = rf"(?s)^({'|'.join(MONTHS)}){_W}+([0-9]{{1,2}}){_W}+([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}){_W}+(\S+){_W}+([^:]*[^:\s][^:]*):{_W}*(.*)$"
_STAMP = rf"^({'|'.join(MONTHS)}){_W}+([0-9]{{1,2}}){_W}+([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})(?:{_W}.*)?$"
_HEUR = rf"(?s)^({_ISO})(?={_W}|$){_W}*(.*)$"
_APP = rf"(?s)^([^\s:]\S*):{_W}+(.*)$|^([^\s:]\S*):$"
_HOST_APP = rf"(?s)^([A-Za-z0-9._:-]*[A-Za-z0-9._-]){_W}+(\S+):(?:{_W}+(.*))?$"
_PREFIX = rf"(?s)^{_W}*([^:]*?(?::\S[^:]*?)*?):{_W}+(.+)$"


_CUT = "\uffff"


def _groups(c: Column, pattern: str, n: int) -> Column:
    """An empty text and all groups of a pattern that matches the whole text; else an array of one text."""
    return F.split(F.regexp_replace(c, pattern, "".join(f"{_CUT}${i}" for i in range(1, n + 1))), _CUT, n + 1)


def _group(c: str, i: int) -> Column:
    """Group i of a column of _groups; null if the pattern did not match."""
    return F.get(F.col(c), F.lit(i))


def _matched(c: str) -> Column:
    return F.size(c) > 1


def _none(c: Column) -> Column:
    return F.when(c != "", c)


def iso_seconds(text: Column, known: bool = False) -> Column:
    """Epoch seconds of an ISO time; without an offset it is UTC; null if it is none.  known: it has the form already."""
    offset = F.regexp_extract(text, r"([Zz]|[+-][0-9]{2}:[0-9]{2})$", 1)
    plain = F.concat(F.translate(F.substring(text, 1, 19), "t", "T"), F.when(offset.isin("", "z"), "Z").otherwise(offset))
    seconds = F.unix_seconds(plain.try_cast("timestamp"))
    return seconds if known else F.when(text.rlike(f"^{_ISO}$"), seconds)


def bsd_seconds(month: Column, day: Column, time: Column, ingest_ts: Column) -> Column:
    """The year is that of ingest_ts, or the one before if that lies over a day ahead."""
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month).cast("int")
    year = F.year(F.timestamp_seconds(ingest_ts))

    def at(y: Column) -> Column:
        text = F.format_string("%04d-%02d-%02d %s", y, number, day.try_cast("int"), time)
        return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))

    this = at(year)
    return F.when(number > 0, F.when(this - ingest_ts > 86_400, at(year - 1)).otherwise(this))


_TYPES = {"pri": "bigint", "version": "bigint", "ts": "bigint", "host": "string", "app": "string", "procid": "string", "msgid": "string", "structured_data": "string", "msg": "string", "bsd": "boolean"}


def _struct(**given: Column) -> Column:
    return F.struct(*[given.get(f, F.lit(None)).cast(t).alias(f) for f, t in _TYPES.items()])


def _headers(lines: DataFrame, line: str, ingest_ts: Column) -> DataFrame:
    """lines with _e: the envelope before vendor prefixes."""
    col, at = F.col, _group
    out = lines.withColumn("_l", F.translate(line, _CUT, "\ufffd"))
    out = out.withColumn("_p", F.when(col("_l").startswith("<"), _groups(col("_l"), _PRI, 2)))
    out = out.withColumn("_pri", at("_p", 1).try_cast("bigint"))
    out = out.withColumn("_pri", F.when(col("_pri") <= 4_294_967_295, col("_pri")))
    out = out.withColumn("_rest", F.when(col("_pri").isNull(), col("_l")).otherwise(at("_p", 2)))
    out = out.withColumn("_s", F.ltrim("_rest", F.lit(" \t\n\x0b\f\r")))
    first = F.substring("_s", 1, 1)
    out = out.withColumn("_r", F.when(first.between("0", "9"), _groups(col("_s"), _RFC, 8)))
    out = out.withColumn("_b", F.when(first.between("A", "S"), _groups(col("_s"), _BSD, 6)))
    out = out.withColumn("_h", F.when(first.between("0", "9") & ~F.coalesce(_matched("_r"), F.lit(False)), _groups(col("_s"), _HEUR, 2)))
    out = out.withColumns({"_rt": iso_seconds(at("_r", 2), True), "_bt": bsd_seconds(at("_b", 1), at("_b", 2), at("_b", 3), ingest_ts), "_ht": iso_seconds(at("_h", 1), True), "_tag": F.trim(at("_b", 5)), "_left": at("_h", 2)})
    out = out.withColumns({"_split": F.when(col("_tag").endswith("]"), _groups(col("_tag"), r"^(.*\S)\s*\[([^\[]+)\]$", 2)), "_a": _groups(col("_left"), _APP, 3)})
    out = out.withColumn("_ha", F.when(~_matched("_a"), _groups(col("_left"), _HOST_APP, 3)))
    dash = lambda c: F.when(c != "-", c)
    pri = col("_pri")
    rfc = _struct(pri=pri, version=at("_r", 1).try_cast("bigint"), ts=col("_rt"), host=dash(at("_r", 3)), app=dash(at("_r", 4)), procid=dash(at("_r", 5)), msgid=dash(at("_r", 6)), structured_data=_none(at("_r", 7)), msg=at("_r", 8), bsd=F.lit(False))
    bsd = _struct(pri=pri, ts=col("_bt"), host=at("_b", 4), app=F.coalesce(at("_split", 1), col("_tag")), procid=at("_split", 2), msg=at("_b", 6), bsd=F.lit(True))
    # a first word that ends with a colon is the app; else a host and such a word
    app = F.coalesce(_none(at("_a", 1)), _none(at("_a", 3)), at("_ha", 2))
    iso = _struct(pri=pri, ts=col("_ht"), host=at("_ha", 1), app=app, msg=F.coalesce(at("_a", 2), at("_ha", 3), col("_left")), bsd=F.lit(False))
    head = F.when(col("_rt").isNotNull(), rfc).when(col("_bt").isNotNull(), bsd).when(col("_ht").isNotNull(), iso).otherwise(_struct(pri=pri, msg=col("_rest")))
    return out.withColumn("_e", head).drop("_l", "_p", "_pri", "_rest", "_s", "_r", "_b", "_h", "_rt", "_bt", "_ht", "_tag", "_left", "_split", "_a", "_ha")


def with_envelope(lines: DataFrame, ingest_ts: int = 0, line: str = "line", name: str = "p") -> DataFrame:
    """lines with the envelope of a line as column `name`.  Up to two vendor prefixes `text: ` come off its message."""
    ingest = F.lit(ingest_ts).cast("long")
    col, at = F.col, _group
    out = _headers(lines, line, ingest)
    out = out.withColumns({"_msg": col("_e.msg"), "_go": col("_e.bsd").isNotNull(), "_embedded": F.lit(None).cast("long"), "_peeled": F.array().cast("array<string>")})
    for _ in range(2):
        out = out.withColumn("_x", F.when(col("_go") & col("_msg").rlike(r":[ \t\n\x0B\f\r]"), _groups(col("_msg"), _PREFIX, 2)))
        out = out.withColumn("_prefix", F.trim(at("_x", 1)))
        out = out.withColumn("_d", F.when(F.substring("_prefix", 1, 1).between("A", "S"), _groups(col("_prefix"), _STAMP, 3)))
        out = out.withColumn("_stamp", F.coalesce(F.when(F.substring("_prefix", 1, 1).between("0", "9"), iso_seconds(col("_prefix"))), bsd_seconds(at("_d", 1), at("_d", 2), at("_d", 3), ingest)))
        peels = (col("_prefix") != "") & (F.octet_length("_prefix") <= 96) & (at("_x", 2).startswith("%") | col("_stamp").isNotNull())
        out = out.withColumn("_go", F.coalesce(peels, F.lit(False)))
        out = out.withColumns({
            "_msg": F.when(col("_go"), at("_x", 2)).otherwise(col("_msg")), "_embedded": F.coalesce("_embedded", F.when(col("_go"), col("_stamp"))),
            "_peeled": F.when(col("_go"), F.concat("_peeled", F.array("_prefix"))).otherwise(col("_peeled")),
        })
    ts = F.when(col("_e.bsd") & col("_embedded").isNotNull(), col("_embedded")).otherwise(col("_e.ts"))
    fields = [col(f"_e.{f}") for f in ("host", "app", "procid", "msgid", "structured_data")]
    whole = F.struct(col("_e.pri"), col("_e.version"), ts.alias("ts"), *fields, col("_embedded").alias("embedded_ts"), col("_peeled").alias("peeled"), col("_msg").alias("msg"))
    return out.withColumn(name, whole).drop("_e", "_msg", "_go", "_embedded", "_peeled", "_x", "_prefix", "_d", "_stamp")
