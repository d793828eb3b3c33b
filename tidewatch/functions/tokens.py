"""Message tokenizer: CEF, JSON, CSV with a header, key/value pairs, words.

One Arrow pass gives the ordered events of each message.  Messages that can only be words (no `=`, `:`, brace) are
tokenized by a native expression and reach Python as nulls.  Events are struct<kind, key, norm, category, value>; kind is kv,
json, csv, word or cef.  Keys of pairs come with their normal form and category.
"""

from __future__ import annotations

import csv
import io
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keys

#: Caps a line.
MOST_EVENTS, MOST_PAIRS, MOST_QUOTED_WORDS, MOST_WORD, MOST_LINE = 256, 64, 32, 64, 16_384
JSON_DEPTH, JSON_PAIRS, JSON_SCALARS, CSV_COLUMNS = 8, 256, 16, 256
#: The fields of a CEF header.
CEF_FIELDS = ("version", "device_vendor", "device_product", "device_version", "signature_id", "name", "severity")
COUNTERS = ("utf8_fallback", "too_long", "token_cap", "kv_cap", "json_kv_cap", "word_cap", "cef_errors", "json_errors", "csv_errors")

EVENTS = "array<struct<kind:string,key:string,norm:string,category:string,value:string>>"
WORD = re.compile(r"[A-Za-z0-9_./:@\\-]{2,}")
_KEY = re.compile(r"(?:^|(?<=[ \t\n\r;,(\[{]))[A-Za-z0-9_.-]+")
_BARE = re.compile(r"[^ \t\n\r\f\v,;]*")
_QUOTED = {q: re.compile(rf"{q}((?:\\.|[^\\{q}])*)(?:{q}|\\?$)", re.S) for q in "\"'"}
_ESCAPE = re.compile(r"\\(.)", re.S)
_CEF_KEY = re.compile(r"(?:^|(?<=\s))([A-Za-z0-9_.-]{1,32})(?<!\\)=")
_NOT_KEY = re.compile(r"[^a-z0-9]+")


def normal_key(key: str) -> str:
    return _NOT_KEY.sub("_", key.lower() if key.isascii() else "".join(c.lower() if c.isascii() else c for c in key)).strip("_")


class Events:
    """The events of a line under its caps."""

    def __init__(self):
        self.out: list[tuple[str, str | None, str]] = []
        self.pairs = self.quoted = 0
        self.hits = dict.fromkeys(COUNTERS, 0)

    def pair(self, kind: str, key: str, value: str) -> bool:
        if self.pairs >= MOST_PAIRS or len(self.out) >= MOST_EVENTS:
            self.hits["kv_cap"] = 1
            self.hits["token_cap"] |= self.pairs < MOST_PAIRS
            self.hits["json_kv_cap"] |= kind == "json"
            return False
        self.pairs += 1
        self.out.append((kind, key, value))
        return True

    def words(self, text: str, quoted: bool = False) -> None:
        for m in WORD.finditer(text):
            if quoted and self.quoted >= MOST_QUOTED_WORDS:
                self.hits["word_cap"] = 1
                return
            if len(self.out) >= MOST_EVENTS:
                self.hits["token_cap"] = self.hits["word_cap"] = 1
                return
            self.quoted += quoted
            self.out.append(("word", None, m[0][:MOST_WORD]))


def _quoted(msg: str, at: int) -> tuple[str, int]:
    m = _QUOTED[msg[at]].match(msg, at)
    return _ESCAPE.sub(lambda e: "\n" if e[1] == "n" else e[1], m[1]), m.end()


def _bracketed(msg: str, at: int) -> int | None:
    """End of a bracketed value: two levels at most, quotes respected."""
    open_, close, depth = msg[at], {"[": "]", "{": "}", "(": ")"}[msg[at]], 0
    for m in re.compile(r"\"(?:\\.|[^\\\"])*(?:\"|$)|'(?:\\.|[^\\'])*(?:'|$)|" + re.escape(open_) + "|" + re.escape(close), re.S).finditer(msg, at):
        if m[0] == open_:
            depth += 1
            if depth > 2:
                return None
        elif m[0] == close:
            depth -= 1
            if not depth:
                return m.end()
    return None


def _colon_separates(msg: str, key: str, end: int) -> bool:
    if key.isdigit() or key.lower() in ("http", "https") or msg.startswith((":", "//"), end + 1):
        return False
    return not (len(key) == 1 and key.isalpha() and msg[end + 1 : end + 2] in ("\\", "/") and end + 1 < len(msg))


def key_values(msg: str, out: Events) -> bool:
    """Pairs `key=value` and `key: value`, then the words between them, then those of quoted values."""
    at, left, found = 0, 0, False
    between: list[str] = []
    quoted: list[str] = []
    while m := _KEY.search(msg, at):
        key, end = m[0], m.end()
        if len(key) > 64:
            at = m.start() + 1
            continue
        sign = msg[end : end + 1]
        if sign not in ("=", ":") or not sign or (sign == ":" and not _colon_separates(msg, key, end)):
            at = end + 1
            continue
        start = end + 1 + msg.startswith(" ", end + 1)
        if start >= len(msg):
            break
        value, stop, in_quotes = None, start, False
        if msg[start] in "\"'":
            value, stop = _quoted(msg, start)
            in_quotes = True
        elif msg[start] in "[{(" and (close := _bracketed(msg, start)):
            value, stop = msg[start:close], close
        if value is None:
            b = _BARE.match(msg, start)
            stop = b.end()
            value = b[0][:-1] if b[0] and b[0][-1] in ",;)]}" else b[0]
        name = normal_key(key)
        if not name:
            at = max(stop, end + 1)
            continue
        between.append(msg[left : m.start()])
        found |= out.pair("kv", name, value)
        if in_quotes and re.search(r"[ \t\n\r\f]", value):
            quoted.append(value)
        left = stop
        at = stop + len(msg[stop:]) - len(msg[stop:].lstrip(" \t\n\r,;"))
    if not found:
        return False
    for text in [*between, msg[left:]]:
        out.words(text)
    for text in quoted:
        out.words(text, True)
    return True


def _cef_text(s: str) -> str:
    return re.sub(r"\\([n\\|=])", lambda m: "\n" if m[1] == "n" else m[1], s)


def cef(msg: str, out: Events) -> bool | None:
    """True: done; None: not CEF; False: broken."""
    if not msg.startswith("CEF:"):
        return None
    parts = re.match(r"((?:(?:\\.|[^\\|])*\|){7})(.*)$", msg[4:], re.S)
    if not parts:
        if msg[4:].count("|") - len(re.findall(r"\\\|", msg[4:])) != 6:
            return False
        fields, extension = re.split(r"(?<!\\)\|", msg[4:]), ""
    else:
        fields, extension = re.findall(r"((?:\\.|[^\\|])*)\|", parts[1], re.S), parts[2].strip()
    if extension:
        keys = list(_CEF_KEY.finditer(extension))
        pairs = []
        for m, after in zip(keys, [*keys[1:], None]):
            value = extension[m.end() : after.start() if after else None].strip()
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            if name := normal_key(m[1]):
                pairs.append((name, _cef_text(value)))
        if not pairs:
            return False
        for name, value in pairs:
            if not out.pair("kv", name, value):
                break
        out.words(_cef_text(extension[: keys[0].start()].strip()))
    for name, value in zip(CEF_FIELDS, fields):
        value = _ESCAPE.sub(lambda e: "\n" if e[1] == "n" else e[1], value)
        if value and len(out.out) < MOST_EVENTS:
            out.out.append(("cef", name, value))
        elif value:
            out.hits["token_cap"] = 1
            break
    return True


class _Number(str):
    """A JSON number as written."""


def _scalar(v) -> str | None:
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    return str(v) if isinstance(v, str) else None


def json_object(msg: str, out: Events) -> bool | None:
    """True: done; None: no object; False: broken."""
    try:
        value = json.loads(msg, parse_int=_Number, parse_float=lambda s: repr(float(s)))
    except (ValueError, RecursionError):
        return False
    if not isinstance(value, dict):
        return None
    flat: list[tuple[str, str]] = []

    def walk(v, path: tuple[str, ...], depth: int) -> None:
        if depth > JSON_DEPTH or len(flat) >= JSON_PAIRS:
            return
        if isinstance(v, dict):
            for k in sorted(v, key=lambda k: k.encode("utf-8", "surrogatepass")):
                walk(v[k], (*path, k), depth + 1 if isinstance(v[k], dict) else depth)
        elif isinstance(v, list):
            some = [s for s in map(_scalar, v) if s is not None][:JSON_SCALARS]
            flat.extend((normal_key("_".join(path)), s) for s in some[: JSON_PAIRS - len(flat)])
        else:
            flat.append((normal_key("_".join(path)), _scalar(v)))

    walk(value, (), 1)
    for key, text in flat:
        if not out.pair("json", key, text):
            break
    return True


def csv_row(msg: str, header: list[str], out: Events) -> bool:
    try:
        row = next(csv.reader(io.StringIO(msg)), None)
    except csv.Error:
        row = None
        out.hits["csv_errors"] = 1
    if not header or row is None:
        return False
    out.hits["csv_errors"] |= len(row) != len(header)
    for name, value in list(zip(header, row))[:CSV_COLUMNS]:
        if (key := normal_key(name)) and not out.pair("csv", key, value):
            break
    return True


def events_of(msg: str, header: list[str] | None = None) -> Events:
    out = Events()
    raw = msg.encode("utf-8", "surrogatepass")
    if len(raw) > MOST_LINE:
        out.hits["too_long"] = 1
        msg = raw[:MOST_LINE].decode("utf-8", "ignore")
    short = msg.strip()
    state = cef(short, out)
    if state is False:
        out.hits["cef_errors"] = 1
        out.words(msg)
    if state is not None:
        return out
    if short.startswith("{") and short.endswith("}"):
        state = json_object(short, out)
        if state:
            return out
        out.hits["json_errors"] = int(state is False)
    if header and csv_row(msg, header, out):
        return out
    if not key_values(msg, out):
        out.words(msg)
    return out


def events_of_bytes(raw: bytes, header: list[str] | None = None) -> Events:
    """Invalid UTF-8 becomes replacement characters and is counted."""
    try:
        text, bad = raw[:MOST_LINE].decode("utf-8"), 0
    except UnicodeDecodeError:
        text, bad = raw[:MOST_LINE].decode("utf-8", "replace"), 1
    out = events_of(text, header)
    out.hits["utf8_fallback"] = bad
    out.hits["too_long"] = int(len(raw) > MOST_LINE)
    return out


def whole_words(text: Column) -> Column:
    """Words as they stand, of any length."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./:@\\-]{2,}"), F.lit(0))


def words(text: Column) -> Column:
    """The word tokenizer alone, native."""
    return F.transform(whole_words(text), lambda w: F.substring(w, 1, MOST_WORD))


_FIELDS = pa.struct([(name, pa.string()) for name in ("kind", "key", "norm", "category", "value")])


def event_lists(texts: pa.Array, header: list[str] | None = None) -> pa.Array:
    """Events of each text; null for null.  Flat columns and offsets, no object an event.  Where texts repeat, each is looked at once."""
    coded = texts.dictionary_encode()
    if 2 * len(coded.dictionary) < len(texts) - texts.null_count:
        return event_lists(coded.dictionary, header).take(coded.indices)
    columns, upto = ([], [], [], [], []), [0]
    kinds, names, norms, cats, values = columns
    for text in texts.to_pylist():
        for kind, key, value in events_of(text, header).out if text is not None else ():
            norm = keys.normal(key) if kind not in ("word", "cef") else None
            kinds.append(kind), names.append(key), norms.append(norm), cats.append(norm and keys.category_of(norm)), values.append(value)
        upto.append(len(kinds))
    events = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in columns], fields=list(_FIELDS))
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), events, mask=texts.is_null())


def tokenize(msg: Column, header: list[str] | None = None) -> Column:
    """Events of a message."""

    def run(texts: pa.Array) -> pa.Array:
        return event_lists(texts, header)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    structured = F.arrow_udf(run, EVENTS)
    none = F.lit(None).cast("string")
    plain = F.lit(False) if header else ~msg.rlike(r"[=:{]") & (F.octet_length(msg) <= MOST_LINE)
    native = F.slice(F.transform(words(msg), lambda w: F.struct(F.lit("word").alias("kind"), none.alias("key"), none.alias("norm"), none.alias("category"), w.alias("value"))), 1, MOST_EVENTS)
    return F.when(plain, native).otherwise(structured(F.when(~plain, msg)))


def parse_counters(msg: Column, header: list[str] | None = None) -> Column:
    """The nine counters of a message, to be summed."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTERS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([events_of(t or "", header).hits for t in texts], columns=list(COUNTERS)).astype("int64")

    return counted(msg)
