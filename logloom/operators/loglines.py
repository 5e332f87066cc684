"""Log lines of differing layouts made entries with time, level, component and message.

A weighted context-free grammar says what a line is and is parsed by Earley's algorithm: the header of an entry in
one of many layouts, with its fields, or a continuation (blank, indented, part of a stack trace, or any text, of
ever less weight). The parse of highest score decides; a continuation is appended to the entry above. How far the
best attempt at a header came is kept as the unparsed span of a line that begins no entry. Lines are ordered by
line_no within a stream; a repeated (stream_name, line_no) counts once (the lowest line_id); a payload with line
breaks holds several lines; a trailing CR is not part of a line.

Streams are cut into chunks of line numbers, so that a stream with most of the lines is no task of its own.
A chunk whose first lines continue an entry of an earlier chunk passes their length (and text) back to it; which
entry that is is told by two levels of windows, over the chunks of a section and over the sections of a stream,
that see numbers alone.

A null stream is a stream. Lines without line_no have no place in their stream and belong to no entry. A null
payload is an empty line. A printed time without a year takes the latest year in which it, read as UTC, is at most a
day after receipt; without receipt such a line begins no entry. An entry's message is one value, however long.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.earley import Grammar, Parse
from logloom.storage import materialize

#: Line numbers of a chunk, and chunks of a section.
CHUNK, SECTION = 1024, 1024

#: The spellings of the five levels.
LEVELS = {
    "DEBUG": ("trace", "trc", "debug", "dbg", "verbose", "t", "d"),
    "INFO": ("info", "inf", "information", "informational", "notice", "i", "n"),
    "WARN": ("warn", "warning", "wrn", "w"),
    "ERROR": ("error", "err", "severe", "e"),
    "FATAL": ("fatal", "ftl", "critical", "crit", "emerg", "emergency", "alert", "panic", "f", "c"),
}
LEVEL_OF = {word: level for level, words in LEVELS.items() for word in words}
#: The level of each syslog severity.
SEVERITIES = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
#: The keys of structured lines.
TIME_KEYS, LEVEL_KEYS = ("ts", "time", "timestamp", "@timestamp"), ("level", "severity", "lvl")
NAME_KEYS, MESSAGE_KEYS = ("logger", "component", "name"), ("msg", "message")

_WORDS = "|".join(sorted(LEVEL_OF, key=len, reverse=True))

#: Rules that repeat weigh 1, so that a long line is not worth less, and one that reads a field weighs more than one that
#: passes it over. A header of any length thus outweighs a continuation.
LINES = rf"""
line 1.0 -> entry
line 0.1 -> more

more 0.9 -> rest=/\s*$/
more 0.8 -> rest=/\s+\S.*/
more 0.7 -> rest=/(?:Caused by:|Suppressed:|Traceback \(most recent call last\):|\.\.\. \d+ more).*/
more 0.1 -> rest=/.*/

entry 0.9 -> time=iso " " level=level " [" component=name "]" tail
entry 0.9 -> "<" pri=/\d{{1,3}}/ ">1 " time=iso " " /\S+/ " " component=/\S+/ " " /\S+/ " " /\S+/ " " data tail
entry 0.9 -> "[" time=common "] [" level=level "] " component=name ":" tail
entry 0.9 -> time=plain /\s+\|\s+/ level=level /\s+\|\s+/ component=name /\s+\|/ tail
entry 0.9 -> time=epoch " [" /\d+/ "] " component=name " " level=level ":" tail
entry 0.5 -> time=stamp /\s+/ level=level /\s+(?:\d+ --- )?\[[^\]]*\] +/ component=name /\s+[-:]/ tail
entry 0.5 -> time=stamp /\s+\[[^\]]*\]\s+/ level=level /\s+/ component=name /\s+[-:]/ tail
entry 0.5 -> time=stamp " - " component=name " - " level=level " -" tail
entry 0.5 -> "<" pri=/\d{{1,3}}/ ">" time=bsd " " /\S+/ " " component=/[^\s\[\]:]+/ /(?:\[\d+\])?:/ tail
entry 0.5 -> level=/[TDINWEF](?=\d{{4}} )/ time=short /\s+\d+ / component=/[^\s:]+/ /:\d+\]/ tail
entry 0.6 -> pairs /\s*$/
entry 0.6 -> object /\s*$/

iso 1.0 -> /\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?/ zone
plain 1.0 -> /\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d(?:[.,]\d+)?/ zone
stamp 1.0 -> /\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?/ zone
common 1.0 -> /\d\d\/[A-Za-z]{{3}}\/\d{{4}}:\d\d:\d\d:\d\d(?:[.,]\d+)?/ zone
bsd 1.0 -> /[A-Z][a-z]{{2}} [ \d]\d \d\d:\d\d:\d\d/
short 1.0 -> /\d{{4}} \d\d:\d\d:\d\d(?:\.\d+)?/
epoch 1.0 -> /\d{{10}}(?:\.\d+)?/
zone 1.0 -> /(?:\s?(?:[Zz]|[+-]\d\d:?\d\d)|(?![\dZz+-]))/
level 1.0 -> /(?i:{_WORDS})(?![A-Za-z])/
name 1.0 -> /[A-Za-z0-9_][\w.\/$-]*/
data 1.0 -> /(?:-|(?:\[(?:[^\]"\\]++|"(?:[^"\\]++|\\.)*+"|\\.)*+\])+)/
tail 1.0 -> /(?: |\s*$)/ message=/.*/

pairs 1.0 -> pairs pair
pairs 1.0 -> pair
pair 2.0 -> /(?:\A| )(?:ts|time|timestamp)=/ time=bare
pair 2.0 -> /(?:\A| )(?:level|severity|lvl)=/ level=bare
pair 2.0 -> /(?:\A| )(?:component|logger|name)=/ component=bare
pair 2.0 -> /(?:\A| )(?:msg|message)=/ message=bare
pair 1.0 -> /(?:\A| )[A-Za-z_@][\w.-]*=/ bare
bare 1.0 -> /(?:"(?:[^"\\]++|\\.)*+"|[^\s"]*)/

object 1.0 -> /\{{(?!\s*\}})/ members /\s*\}}/
object 1.0 -> /\{{\s*\}}/
members 1.0 -> members member
members 1.0 -> member
member 2.0 -> comma /"(?:ts|time|timestamp|@timestamp)"\s*:\s*/ time=scalar
member 2.0 -> comma /"(?:level|severity|lvl)"\s*:\s*/ level=string
member 2.0 -> comma /"(?:logger|component|name)"\s*:\s*/ component=string
member 2.0 -> comma /"(?:msg|message)"\s*:\s*/ message=string
member 1.0 -> comma string /\s*:\s*/ scalar
member 1.0 -> comma string /\s*:\s*(?=[\[\{{])/ nested
comma 1.0 -> /(?:(?<=\{{)\s*|(?<!\{{)\s*,\s*)/
nested 1.0 -> object
nested 1.0 -> /\[\s*\]/
nested 1.0 -> /\[\s*/ values /\s*\]/
value 1.0 -> scalar
value 1.0 -> nested
values 1.0 -> values /\s*,\s*/ value
values 1.0 -> value
scalar 1.0 -> /(?:"(?:[^"\\\x00-\x1f]++|\\["\\\/bfnrtu])*+"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)/
string 1.0 -> /"(?:[^"\\\x00-\x1f]++|\\["\\\/bfnrtu])*+"/
"""

#: What every header begins with: one look that spares most continuations the parser.
_FIRST = re.compile(r'[\d<\[{]|[A-Za-z_@][\w.-]*=|[TDINWEF]\d{4} ')

_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_CLOCK = re.compile(
    r"(?:(\d{4})-(\d\d)-(\d\d)[T ]|(\d\d)/([A-Za-z]{3})/(\d{4}):)(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?\s?(?:([Zz])|([+-])(\d\d):?(\d\d))?"
)
_EPOCH = re.compile(r"(\d{10}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?")
_YEARLESS = re.compile(r"(?:([A-Za-z]{3}) ([ \d]\d)|(\d\d)(\d\d)) (\d\d):(\d\d):(\d\d)(?:\.(\d+))?")
_DAY_NS = 86_400_000_000_000


@lru_cache(maxsize=1)
def lines_of() -> Grammar:
    return Grammar(LINES, "line", loose=("more",))


@lru_cache(maxsize=65536)
def _second(*parts: int) -> int | None:
    try:
        return int(datetime(*parts, tzinfo=timezone.utc).timestamp())
    except ValueError:
        return None


def instant(text: str, received_ns: int | None = None) -> int | None:
    """Epoch nanoseconds of a printed time, UTC where no zone is printed."""
    m = _CLOCK.fullmatch(text)
    if not m:
        if m := _EPOCH.fullmatch(text):
            digits = m[1] + (m[2] or "")
            return int(digits[:19].ljust(19, "0"))
        return _yearless(text, received_ns)
    year, month, day = (m[1], int(m[2]), m[3]) if m[1] else (m[6], _MONTHS.get(m[5].lower(), 0), m[4])
    second = _second(int(year), month, int(day), int(m[7]), int(m[8]), min(int(m[9]), 59) if m[9] == "60" else int(m[9]))
    if second is None:
        return None
    if m[12]:
        second -= (-1 if m[12] == "-" else 1) * (int(m[13]) * 3600 + int(m[14]) * 60)
    return second * 1_000_000_000 + int((m[10] or "")[:9].ljust(9, "0"))


def _yearless(text: str, received_ns: int | None) -> int | None:
    m = _YEARLESS.fullmatch(text)
    if not m or received_ns is None:
        return None
    month, day = (_MONTHS.get(m[1].lower(), 0), int(m[2])) if m[1] else (int(m[3]), int(m[4]))
    part = int((m[8] or "")[:9].ljust(9, "0"))
    latest = datetime.fromtimestamp((received_ns + _DAY_NS) // 1_000_000_000, timezone.utc).year
    for year in range(latest, latest - 9, -1):
        second = _second(year, month, day, int(m[5]), int(m[6]), int(m[7]))
        if second is not None and second * 1_000_000_000 + part <= received_ns + _DAY_NS:
            return second * 1_000_000_000 + part
    return None


_ESCAPE = re.compile(r"\\(.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def unquoted(text: str | None) -> str | None:
    if not text or not text.startswith('"'):
        return text
    if "\\" not in text:
        return text[1:-1]
    try:
        return json.loads(text)
    except ValueError:
        return _ESCAPE.sub(lambda m: _PLAIN.get(m[1], m[1]), text[1:-1])


def header(line: str, received_ns: int | None = None) -> tuple[int, str, str, str] | None:
    """(event_ns, level, component, message) if the line begins an entry."""
    return fields(attempt(line), received_ns)


def attempt(line: str, trace: bool = False) -> Parse | None:
    """The best parse of a line; None if it is plain from its first character that no header begins it."""
    return lines_of().parse(line, trace) if _FIRST.match(line) else None


def fields(parse: Parse | None, received_ns: int | None = None) -> tuple[int, str, str, str] | None:
    if parse is None or parse.spans is None or "rest" in parse.spans:
        return None
    time, component = unquoted(parse.get("time")), unquoted(parse.get("component"))
    if not time or not component:
        return None
    if (pri := parse.get("pri")) is not None:
        level = SEVERITIES[int(pri) % 8] if int(pri) <= 191 else None
    else:
        level = LEVEL_OF.get((unquoted(parse.get("level")) or "").lower())
    event_ns = instant(time, received_ns)
    if level is None or event_ns is None:
        return None
    return event_ns, level, component, unquoted(parse.get("message")) or ""


_SCHEMA = (
    "kind string, stream_name string, chunk bigint, line_no bigint, sub int, event_ns bigint, log_level string, "
    "component string, message_chars bigint, message string, last boolean"
)


class Assembly:
    """Entries and leading continuations of chunks, fed payload by payload in order."""

    def __init__(self, texts: bool):
        self.texts, self.at, self.seen, self.rows = texts, None, None, []
        self.lead_chars, self.lead_texts, self.open = 0, [], None

    def feed(self, stream: str | None, chunk: int, line_no: int, payload: bytes | None, received_ns: int | None) -> None:
        if (stream, chunk) != self.at:
            self.flush()
            self.at = (stream, chunk)
        elif line_no == self.seen:
            return
        self.seen = line_no
        for sub, line in enumerate((payload or b"").decode("utf-8", "replace").split("\n")):
            line = line.removesuffix("\r")
            if got := header(line, received_ns):
                self._close(False)
                self.open = [line_no, sub, *got[:3], len(got[3]), [got[3]]]
            elif self.open:
                self.open[5] += 1 + len(line)
                if self.texts:
                    self.open[6] += ("\n", line)
            else:
                self.lead_chars += 1 + len(line)
                if self.texts:
                    self.lead_texts += ("\n", line)

    def _close(self, last: bool) -> None:
        if self.open:
            *entry, parts = self.open
            self.rows.append(("entry", *self.at, *entry, "".join(parts) if self.texts else None, last))
            self.open = None

    def flush(self) -> None:
        self._close(True)
        if self.lead_chars:
            text = "".join(self.lead_texts) if self.texts else None
            self.rows.append(("lead", *self.at, None, None, None, None, None, self.lead_chars, text, False))
        self.lead_chars, self.lead_texts = 0, []

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        columns = [pa.array(c, t) for c, t in zip(zip(*self.rows), kinds)]
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, names)


def _with_receipt(lines: DataFrame) -> DataFrame:
    """received_ns is asked for by printed times without a year alone; a table may lack it."""
    return lines if "received_ns" in lines.columns else lines.withColumn("received_ns", F.lit(None).cast("bigint"))


def chunked(lines: DataFrame, texts: bool, chunk: int = CHUNK) -> DataFrame:
    """Entries as far as their chunk shows them, and the leads that belong to earlier chunks."""
    ordered = (
        _with_receipt(lines).where(F.col("line_no").isNotNull())
        .select("stream_name", F.expr(f"floor(line_no / {chunk})").cast("bigint").alias("chunk"), "line_no", "line_id", "payload", "received_ns")
        .repartition("stream_name", "chunk")
        .sortWithinPartitions("stream_name", "chunk", "line_no", "line_id")
        .select("stream_name", "chunk", "line_no", "payload", "received_ns")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assembly = Assembly(texts)
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                assembly.feed(*row)
            if assembly.rows:
                yield assembly.batch()
        assembly.flush()
        if assembly.rows:
            yield assembly.batch()

    return ordered.mapInArrow(run, _SCHEMA)


def _owners(thin: DataFrame) -> DataFrame:
    """stream_name, chunk, line_no, sub: for each chunk with a lead the last entry of the chunks before it.

    thin: a row or two for each chunk. Windows run over the chunks of a section of 1,024, and over one row for each
    section, so that no window holds more than a thousandth of a stream's chunks at once."""
    entry = F.when(F.col("kind") == "entry", F.struct("chunk", "line_no", "sub"))
    placed = thin.select("kind", "stream_name", "chunk", F.floor(F.col("chunk") / SECTION).alias("section"), entry.alias("entry"))
    within = Window.partitionBy("stream_name", "section").orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    leads = placed.withColumn("owner", F.last("entry", ignorenulls=True).over(within)).where("kind = 'lead'")
    across = Window.partitionBy("stream_name").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    sections = placed.groupBy("stream_name", "section").agg(F.max("entry").alias("last"))
    before = sections.select(F.col("stream_name").alias("s"), F.col("section").alias("n"), F.last("last", ignorenulls=True).over(across).alias("earlier"))
    joined = leads.join(before, F.col("stream_name").eqNullSafe(F.col("s")) & (F.col("section") == F.col("n")))
    owner = F.coalesce("owner", "earlier")
    return joined.where(owner.isNotNull()).select("stream_name", "chunk", owner["line_no"].alias("line_no"), owner["sub"].alias("sub"))


def entries(lines: DataFrame, texts: bool = False, chunk: int = CHUNK) -> DataFrame:
    """stream_name, line_no, event_ns, log_level, component, message_chars, and message if texts are asked for."""
    # what is whole within its chunk is written apart from the one or two rows a chunk that may go on
    part = F.expr("if(kind = 'entry' AND NOT last, 'whole', 'edge')")
    written = materialize(chunked(lines, texts, chunk).withColumn("part", part), "log-entries", ["part"])
    whole, parts = written.where("part = 'whole'"), written.where("part = 'edge'").drop("part")
    owners = _owners(parts.select("kind", "stream_name", "chunk", "line_no", "sub"))
    owners = owners.withColumnsRenamed({"stream_name": "s", "chunk": "c", "line_no": "at_line", "sub": "at_sub"})
    carried = parts.where("kind = 'lead'").join(owners, F.col("stream_name").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))).select(
        "stream_name", F.col("at_line").alias("line_no"), F.col("at_sub").alias("sub"), "chunk", "message_chars", "message"
    )
    empty = {c: F.lit(None).cast(t) for c, t in parts.dtypes if c in ("event_ns", "log_level", "component")}
    lasts = parts.where("last").select("stream_name", "line_no", "sub", "chunk", "message_chars", "message", *empty)
    joined = (
        lasts.unionByName(carried.withColumns(empty))
        .groupBy("stream_name", "line_no", "sub")
        .agg(
            *[F.max(c).alias(c) for c in empty], F.sum("message_chars").alias("message_chars"),
            *([F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "message"))), lambda x: x.message), "").alias("message")] if texts else []),
        )
    )
    columns = ["stream_name", "line_no", "event_ns", "log_level", "component", "message_chars", *(["message"] if texts else [])]
    return whole.select(columns).unionByName(joined.select(columns))


def unparsed(lines: DataFrame) -> DataFrame:
    """stream_name, line_no, unparsed_from, line_chars: for each delivered line that starts no entry, where the best
    attempt at a header stopped (0: none began). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stream, line_no, payload, received_ns in zip(*(b.column(i).to_pylist() for i in range(4))):
                for line in (payload or b"").decode("utf-8", "replace").split("\n"):
                    line = line.removesuffix("\r")
                    parse = attempt(line, trace=True)
                    if fields(parse, received_ns) is None:
                        rows.append((stream, line_no, parse.unparsed if parse else 0, len(line)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["stream_name", "line_no", "unparsed_from", "line_chars"]
                )

    schema = "stream_name string, line_no bigint, unparsed_from int, line_chars int"
    return _with_receipt(lines).select("stream_name", "line_no", "payload", "received_ns").mapInArrow(run, schema)
