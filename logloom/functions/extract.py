"""The nine extraction primitives as expressions over the state of a line.

A state is struct<f: fields, t: names whose value was a number or a truth value, b: the unread body, e: error>.
Later steps overwrite earlier fields. A failed step leaves the state and sets the error; an optional one leaves
the state alone.
"""

from __future__ import annotations

import re

from logloom.functions import sql as F
from logloom.functions.sql import E

from logloom.functions.text import FLAGS, MARK, captured, let, numbered, stripped, unmarked

FIELDS = "map<string,string>"
BODY = "__body__"
#: The severities of a syslog priority.
SEVERITIES = ("emerg", "alert", "crit", "err", "warning", "notice", "info", "debug")
#: Names of the header parts of the two event formats.
CEF_PARTS = ("cef_version", "cef_vendor", "cef_product", "cef_device_version", "cef_signature_id", "cef_name", "cef_severity")
LEEF_PARTS = ("leef_version", "leef_vendor", "leef_product", "leef_device_version", "leef_event_id")


def state(fields: E, typed: E, body: E, error: E | None = None) -> E:
    return F.struct(
        fields.alias("f"), typed.alias("t"), body.alias("b"), (F.lit(None).cast("string") if error is None else error).alias("e")
    )


def begin(line: E) -> E:
    return state(F.create_map().cast(FIELDS), F.array().cast("array<string>"), line)


def texts(*names: str) -> E:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def pairs(entries: E) -> E:
    """A map of struct<k, v>; empty values and null keys go, the last of equal keys stays."""
    return F.map_from_entries(F.filter(entries, lambda e: e["k"].isNotNull() & (e["v"] != "")))


def pair(k: E, v: E) -> E:
    return F.struct(k.alias("k"), v.alias("v"))


def _take(s: E, found: E, body: E | None = None) -> E:
    """The state with fields added and the body as given, by default all read."""
    return state(F.map_concat(s["f"], found), s["t"], F.lit("") if body is None else body)


def _fail(s: E, why: E | str) -> E:
    return state(s["f"], s["t"], s["b"], F.lit(why) if isinstance(why, str) else why)


# --- syslog ---------------------------------------------------------------------------------------

_OLD = r"<(\d{1,3})>\s*([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
_NEW = r"<(\d{1,3})>1\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:-|(?:\[[^\]]*\])+)\s*"


def _head(g: E) -> list[E]:
    pri = g[0].cast("int")
    return [
        pair(F.lit("log_facility"), F.shiftright(pri, 3).cast("string")),
        pair(F.lit("log_severity"), texts(*SEVERITIES)[pri.bitwiseAND(7)]),
        pair(F.lit("log_time"), g[1]), pair(F.lit("log_host"), g[2]),
    ]


def _typed_facility(s: E) -> E:
    return F.array_append(s["t"], F.lit("log_facility"))


def rfc3164(s: E) -> E:
    def read(g: E) -> E:
        found = state(F.map_concat(s["f"], pairs(F.array(*_head(g)))), _typed_facility(s), g[3])
        return F.when(g.isNull(), _fail(s, "not RFC 3164")).otherwise(found)

    return let(captured(s["b"], _OLD, [1, 2, 3], anchored=True, rest=True), read)


def rfc5424(s: E) -> E:
    def read(g: E) -> E:
        told = lambda v: F.when(v != "-", v).otherwise("")
        more = [pair(F.lit("log_app"), g[3]), pair(F.lit("log_procid"), told(g[4])), pair(F.lit("log_msgid"), told(g[5]))]
        found = state(F.map_concat(s["f"], pairs(F.array(*_head(g), *more))), _typed_facility(s), g[6])
        return F.when(g.isNull(), _fail(s, "not RFC 5424")).otherwise(found)

    return let(captured(s["b"], _NEW, [1, 2, 3, 4, 5, 6], anchored=True, rest=True), read)


def syslog(s: E, form: str) -> E:
    if form != "auto":
        return rfc3164(s) if form == "rfc3164" else rfc5424(s)
    new = s["b"].startswith("<") & F.substring(s["b"], 1, 8).contains(">1 ")
    return F.when(new, rfc5424(s)).otherwise(rfc3164(s))


# --- positions ------------------------------------------------------------------------------------

def split_quoted(text: E, sep: str, quote: str = '"') -> E:
    """Split at sep outside quotes; quotes toggle and are dropped."""
    plain = F.split(text, re.escape(sep), -1)
    text = unmarked(text)
    if not quote:
        return plain
    outside = (lambda p: F.replace(p, F.lit(sep), F.lit(MARK))) if len(sep) == 1 else (lambda p: p)
    parts = F.transform(F.split(text, re.escape(quote), -1), lambda p, i: F.when(i % 2 == 0, outside(p)).otherwise(p))
    return F.when(text.contains(quote), F.split(F.array_join(parts, ""), MARK, -1)).otherwise(plain)


def columns(s: E, names: tuple[str, ...], sep: str, quote: str) -> E:
    known = F.array(*[F.lit(None if n in ("", "-") else n).cast("string") for n in names])
    named = lambda i: F.when(i < len(names), F.get(known, i)).otherwise(F.concat(F.lit("overflow_"), i.cast("string")))
    return _take(s, pairs(F.transform(split_quoted(s["b"], sep, quote), lambda p, i: pair(named(i), stripped(p)))))


def whitespace(s: E, names: tuple[str, ...], maxsplit: int) -> E:
    known = F.array(*[F.lit(None if n in ("", "-") else n).cast("string") for n in names])
    lead = F.regexp_replace(s["b"], r"^\s+", "")
    body = lead if maxsplit else stripped(s["b"])
    parts = F.split(body, r"\s+", maxsplit + 1 if maxsplit else -1)
    told = lambda p: F.when(p != "-", p).otherwise("")
    return _take(s, pairs(F.transform(parts, lambda p, i: pair(F.when(i < len(names), F.get(known, i)), told(p)))))


# --- keys -----------------------------------------------------------------------------------------

_KEY = r"[A-Za-z_][A-Za-z0-9_.\-]*"


def kv_entries(body: E, pair_sep: str | None = None, lower: bool = False, stop: str | None = None) -> E:
    """struct<k, v> of every key=value in order; values may be empty."""
    bare = stop or (rf"[^{re.escape(pair_sep)}]*" if pair_sep else r"\S*")
    found = F.regexp_extract_all(body, F.lit(rf'{FLAGS}{_KEY}=(?:"[^"]*"|{bare})'), F.lit(0))

    def split(token: E) -> E:
        at = F.instr(token, "=")
        key, value = F.substr(token, F.lit(1), at - 1), F.substr(token, at + 1)
        # a token begins with a quote and ends with another one only if it was matched as quoted
        quoted = value.startswith('"') & value.endswith('"') & (F.octet_length(value) > 1)
        inner = F.substr(value, F.lit(2), F.char_length(value) - 2)
        return pair(F.lower(key) if lower else key, F.when(quoted, inner).otherwise(value))

    return F.transform(found, split)


def kv(s: E, pair_sep: str | None, lower: bool) -> E:
    def read(entries: E) -> E:
        return F.when(F.size(entries) == 0, _fail(s, "no key=value pairs found")).otherwise(_take(s, F.map_from_entries(entries)))

    return let(kv_entries(s["b"], pair_sep, lower), read)


def flattened(value: E, sep: str, depth: int) -> E:
    """struct<k, v variant> of an object's leaves by dotted name."""
    def inner(v: E) -> E:
        return F.map_entries(v.try_cast("map<string,variant>"))

    def is_object(v: E) -> E:
        return v.try_cast("map<string,variant>").isNotNull()

    def expand(entries: E) -> E:
        def one(e: E) -> E:
            below = F.transform(inner(e["v"]), lambda x: pair(F.concat(e["k"], F.lit(sep), x["key"]), x["value"]))
            return F.when(is_object(e["v"]), below).otherwise(F.array(e))

        return F.flatten(F.transform(entries, one))

    entries = F.transform(inner(value), lambda x: pair(x["key"], x["value"]))
    for _ in range(depth):
        entries = let(entries, lambda a: F.when(F.exists(a, lambda e: is_object(e["v"])), expand(a)).otherwise(a))
    return entries


def json_object(s: E, sep: str, depth: int) -> E:
    body = stripped(s["b"])
    text = F.substr(body, F.greatest(F.instr(body, "{"), F.lit(1)))

    def read(entries: E) -> E:
        plain = lambda v: v.try_cast("string")
        scalar = lambda v: ~F.schema_of_variant(v).rlike("^(?:STRING|VOID|ARRAY|OBJECT)")
        found = pairs(F.transform(entries, lambda e: pair(e["k"], plain(e["v"]))))
        typed = F.transform(F.filter(entries, lambda e: e["v"].isNotNull() & scalar(e["v"])), lambda e: e["k"])
        got = state(F.map_concat(s["f"], found), F.concat(s["t"], typed), F.lit(""))
        return F.when(entries.isNull(), _fail(s, "invalid JSON")).otherwise(got)

    got = let(flattened(F.try_parse_json(text), sep, depth), read)
    return F.when(s["b"].contains("{"), got).otherwise(_fail(s, "no JSON object present"))


def _header(parts: E, names: tuple[str, ...], mark: str) -> E:
    first = F.substr(parts[0], F.lit(len(mark) + 1))
    return F.array(*[pair(F.lit(n), stripped(first if i == 0 else F.get(parts, F.lit(i)))) for i, n in enumerate(names)])


def cef(s: E) -> E:
    body = F.substr(s["b"], F.greatest(F.instr(s["b"], "CEF:"), F.lit(1)))

    def read(parts: E) -> E:
        # a value ends where white space and the next key follow; what holds a bare `=` before its last key is passed over
        chunks = F.split(F.get(parts, F.lit(7)), rf"{FLAGS}\s+(?=[A-Za-z][A-Za-z0-9_]*=)", -1)
        # possessive: Java repeats other groups by recursion, which a long value would take beyond the stack
        ends = F.transform(chunks, lambda c: captured(c, r"([A-Za-z][A-Za-z0-9_]*)=((?:[^=\\]|\\.)*+)$", [1, 2]))
        plain = lambda v: stripped(F.replace(F.replace(v, F.lit("\\="), F.lit("=")), F.lit("\\\\"), F.lit("\\")))
        extension = F.transform(F.filter(ends, lambda g: g.isNotNull()), lambda g: pair(g[0], plain(g[1])))
        every = F.concat(_header(parts, CEF_PARTS, "CEF:"), F.coalesce(extension, F.array().cast("array<struct<k:string,v:string>>")))
        return F.when(F.size(parts) < 7, _fail(s, "truncated CEF header")).otherwise(_take(s, pairs(every)))

    return F.when(s["b"].contains("CEF:"), let(F.split(body, r"\|", 8), read)).otherwise(_fail(s, "no CEF header"))


def leef(s: E) -> E:
    body = F.substr(s["b"], F.greatest(F.instr(s["b"], "LEEF:"), F.lit(1)))

    def read(parts: E) -> E:
        rest = F.get(parts, F.lit(5))
        chunks = F.when(rest.contains("\t"), F.split(rest, "\t", -1)).otherwise(F.split(stripped(rest), r"\s+", -1))
        split = lambda c: pair(stripped(F.substring_index(c, "=", 1)), stripped(F.substr(c, F.instr(c, "=") + 1)))
        extension = F.transform(F.filter(chunks, lambda c: c.contains("=")), split)
        every = F.concat(_header(parts, LEEF_PARTS, "LEEF:"), extension)
        return F.when(F.size(parts) < 6, _fail(s, "truncated LEEF header")).otherwise(_take(s, pairs(every)))

    return F.when(s["b"].contains("LEEF:"), let(F.split(body, r"\|", 6), read)).otherwise(_fail(s, "no LEEF header"))


# --- patterns -------------------------------------------------------------------------------------

def regex(s: E, pattern: str, source: str, keep_body: bool) -> E:
    plain, names = numbered(pattern)
    text = s["b"] if source == BODY else F.coalesce(s["f"][source], F.lit(""))

    def read(g: E) -> E:
        found = F.array(*[pair(F.lit(n), g[i]) for i, n in enumerate(names)]) if names else F.array().cast("array<struct<k:string,v:string>>")
        return F.when(g.isNull(), _fail(s, "pattern did not match")).otherwise(_take(s, pairs(found), s["b"] if keep_body else None))

    return let(captured(text, plain, list(names.values())), read)


def prefix(s: E, pattern: str) -> E:
    plain, names = numbered(pattern)

    def read(g: E) -> E:
        found = F.array(*[pair(F.lit(n), g[i]) for i, n in enumerate(names)]) if names else F.array().cast("array<struct<k:string,v:string>>")
        return F.when(g.isNull(), _fail(s, "prefix did not match")).otherwise(_take(s, pairs(found), g[len(names)]))

    return let(captured(s["b"], plain, list(names.values()), anchored=True, rest=True), read)


def run_step(step, s: E) -> E:
    """One step of a grammar on a state."""
    kind, value = step.kind, step.value
    if kind == "syslog":
        got = syslog(s, value)
    elif kind == "columns":
        got = columns(s, value, step.sep, step.quote)
    elif kind == "whitespace":
        got = whitespace(s, value, step.maxsplit)
    elif kind == "kv":
        got = kv(s, step.pair_sep, step.lower_keys)
    elif kind == "json":
        got = json_object(s, step.flatten_sep, step.depth)
    elif kind == "cef":
        got = cef(s)
    elif kind == "leef":
        got = leef(s)
    elif kind == "regex":
        got = regex(s, value, step.source, step.keep_body)
    else:
        got = prefix(s, value)
    if step.optional:
        got = let(got, lambda n: F.when(n["e"].isNull(), n).otherwise(s))
    return F.when(s["e"].isNull(), got).otherwise(s)


# --- types ----------------------------------------------------------------------------------------

_TRUE = ("1", "true", "yes", "on", "enable", "enabled")


def _cast(value: E, kind: str) -> E:
    """Canonical text of a value read as a type, null where it is not of it."""
    if kind == "int":
        return F.trim(value).try_cast("bigint").cast("string")
    if kind == "float":
        return F.trim(value).try_cast("double").cast("string")
    if kind == "bool":
        return F.lower(F.trim(value)).isin(*_TRUE).cast("string")
    return value


def coerced(s: E, casts: dict[str, str]) -> E:
    """struct<f, t, notes>: declared types applied; a value that is not of its type stays text, with a note."""
    by_kind: dict[str, list[str]] = {}
    for name, kind in casts.items():
        by_kind.setdefault(kind, []).append(name)

    def value(k: E, v: E) -> E:
        out = None
        for kind, names in by_kind.items():
            test, got = k.isin(*names), F.coalesce(_cast(v, kind), v)
            out = F.when(test, got) if out is None else out.when(test, got)
        return v if out is None else out.otherwise(v)

    real = {kind: names for kind, names in by_kind.items() if kind != "str"}
    # entries of the declared names alone: struct<name, whether it fits>
    entries = F.map_entries(F.map_filter(s["f"], lambda k, v: k.isin(*[n for names in real.values() for n in names]))) if real else None

    def fits(e: E) -> E:
        out = F.lit(False)
        for kind, names in real.items():
            out = F.when(e["key"].isin(*names), _cast(e["value"], kind).isNotNull()).otherwise(out)
        return out

    def kind_of(e: E) -> E:
        out = F.lit("")
        for kind, names in real.items():
            out = F.when(e["key"].isin(*names), F.lit(kind)).otherwise(out)
        return out

    if real:
        good = [F.transform(F.filter(entries, fits), lambda e: e["key"])]
        note = lambda e: F.concat(e["key"], F.lit(": could not cast to "), kind_of(e), F.lit(", kept as text"))
        bad = [F.transform(F.filter(entries, lambda e: ~fits(e)), note)]
    else:
        good, bad = [], []
    none = F.array().cast("array<string>")
    return F.struct(
        F.transform_values(s["f"], value).alias("f"), F.array_distinct(F.concat(s["t"], *good)).alias("t"), F.concat(none, *bad).alias("notes")
    )
