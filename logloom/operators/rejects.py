"""Rows that fail to parse, set apart with the reason while the sound rows load.

A block of records is parsed as a whole on a columnar path (Arrow's CSV reader, one JSON document, one
token scan) and its columns are checked with Arrow kernels. A block that does not parse as a whole is
bisected, and its halves parsed anew, until the bad record stands alone (but for up to three neighbours);
these, and every record whose columns fail a check, are then diagnosed strictly. The fast path only ever accepts: what it accepts
the strict reader accepts too, so the verdict does not depend on how records fall into blocks.

Null payloads are read as empty ones. A listener without layout is not judged.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records and bytes of a block; a longer record is a block of its own.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: A failing part of so many records is not halved any more; each of them is diagnosed strictly.
LEAF = 4
EPOCH_FROM, EPOCH_TO = 946684800, 4102444800
FAMILIES = ("csv", "kv", "json", "delimited")
#: Listeners whose layouts one pass over the records knows; of more of them there are more passes.
LAYOUTS = 100_000


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool
    choices: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    grammar: str
    family: str
    header: str
    fields: tuple[Field, ...]


def layouts_by_listener(grammars: DataFrame, most: int = LAYOUTS) -> list[dict[str, Layout]]:
    """Listener -> layout, in parts of about `most` listeners. Of several layouts on one listener the first grammar by
    name holds; grammars without name come first. Layouts are configuration: a part is what a task is given."""
    chosen = (
        grammars.where(F.col("layout").isNotNull() & F.col("family").isin(*FAMILIES))
        .select(F.explode("listeners").alias("listener"), F.struct("grammar", "family", "header_pattern", "layout").alias("g"))
        .where("listener IS NOT NULL")
        .groupBy("listener").agg(F.min_by("g", F.struct(F.coalesce("g.grammar", F.lit("")), "g.family", "g.header_pattern", F.to_json("g.layout"))).alias("g"))
    )
    parts = -(-chosen.count() // most)
    found: list[dict[str, Layout]] = []
    for k in range(parts):
        # one row a layout, with its listeners, so that a layout of many is sent once
        part = chosen.where(F.pmod(F.xxhash64("listener"), F.lit(parts)) == k).groupBy("g").agg(F.collect_list("listener").alias("listeners"))
        found.append({})
        for g, listeners in part.collect():
            fields = tuple(Field(f.field, f.kind, bool(f.required), tuple((c or "").lower() for c in f.choices or ())) for f in g.layout)
            found[-1] |= dict.fromkeys(listeners, Layout(g.grammar or "", g.family, g.header_pattern or "", fields))
    return found


# --- strict reading of one body -------------------------------------------------------------------

_CSV_FIELD = re.compile(r'"((?:[^"]|"")*)"(?=,|\Z)|([^",]*)(?=,|\Z)')
_BLANKS = re.compile(r"\s+")
_KV_TOKEN = re.compile(r'\s*(?:([^\s="]*)=(?:"([^"]*)"|([^\s"]*))|([^\s="]+))(?=\s|\Z)')
_INT = re.compile(r"[0-9]{1,18}")
_IPV4 = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_EPOCH = re.compile(r"[0-9]{1,12}(?:\.[0-9]{1,9})?")
_STAMP = re.compile(r"([0-9]{4})/([0-9]{2})/([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})")


class Broken(Exception):
    """A body that cannot be split into fields; args[0] is the reason."""


def strict_csv(body: str) -> list[str]:
    values, at = [], 0
    while True:
        m = _CSV_FIELD.match(body, at)
        if not m:
            raise Broken("quoting")
        values.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        at = m.end()
        if at == len(body):
            return values
        at += 1


def strict_kv(body: str) -> dict[str, str]:
    values: dict[str, str] = {}
    at, end, columns = 0, len(body.rstrip()), False
    while at < end:
        m = _KV_TOKEN.match(body, at)
        if not m:
            raise Broken("quoting")
        if m[4] is not None or m[1] in values:
            columns = True
        else:
            values[m[1]] = m[3] if m[2] is None else m[2]
        at = m.end()
    if columns:
        raise Broken("columns")
    return values


def _no_constant(text: str) -> str:
    raise ValueError(text)


class _Raw(str):
    """Text that is JSON already; numbers are kept as they are written."""


_JSON = json.JSONDecoder(parse_float=_Raw, parse_int=_Raw, parse_constant=_no_constant)
_MISSING = object()


def _lookup(doc: dict, name: str):
    if name in doc:
        return doc[name]
    here = doc
    for part in name.split("."):
        if not isinstance(here, dict) or part not in here:
            return _MISSING
        here = here[part]
    return here


def _as_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return _nested_text(value)


def _nested_text(value) -> str:
    """JSON of an object or array, however deep."""
    out, pending = [], [value]
    while pending:
        at = pending.pop()
        if isinstance(at, _Raw):
            out.append(at)
        elif isinstance(at, (dict, list)):
            pairs = at.items() if isinstance(at, dict) else ((None, v) for v in at)
            parts: list = []
            for k, v in pairs:
                parts += [_Raw("," if parts else ""), *([_Raw(json.dumps(k, ensure_ascii=False) + ":")] if k is not None else []), v]
            pending += [_Raw("}" if isinstance(at, dict) else "]"), *reversed(parts), _Raw("{" if isinstance(at, dict) else "[")]
        else:
            out.append(json.dumps(at, ensure_ascii=False))
    return "".join(out)


_JSON_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))'
)
_WORDS = {"true": True, "false": False, "null": None}


def _deep_json(body: str):
    """A document nested beyond the interpreter's stack, read with a stack of its own. ValueError if it is none."""
    open_: list[tuple[dict | list, str | None]] = []  # containers and the key that waits in each
    at, end, ready, got = 0, len(body.rstrip(" \t\n\r")), "value", _MISSING
    while at < end:
        m = _JSON_TOKEN.match(body, at)
        if not m or (not open_ and got is not _MISSING):
            raise ValueError(body[at:at + 20])
        at, sign, value = m.end(), m[1], _MISSING
        if sign is None:
            value = json.loads(m[2]) if m[2] else _Raw(m[3]) if m[3] else _WORDS[m[4]]
        elif sign in "{[" and ready in ("value", "first"):
            open_.append(({} if sign == "{" else [], None))
            ready = "key or end" if sign == "{" else "first"
            continue
        elif sign in "}]" and open_ and isinstance(open_[-1][0], dict if sign == "}" else list) and ready in ("end", "key or end" if sign == "}" else "first"):
            value, ready = open_.pop()[0], "value"
        elif sign == "," and open_ and ready == "end":
            ready = "key" if isinstance(open_[-1][0], dict) else "value"
            continue
        elif sign == ":" and ready == "colon":
            ready = "value"
            continue
        else:
            raise ValueError(sign)
        if sign is None and ready in ("key", "key or end") and m[2]:
            open_[-1] = (open_[-1][0], value)
            ready = "colon"
            continue
        if ready not in ("value", "first"):
            raise ValueError(ready)
        if not open_:
            got = value
        elif isinstance(open_[-1][0], dict):
            open_[-1][0][open_[-1][1]] = value
        else:
            open_[-1][0].append(value)
        ready = "end"
    if got is _MISSING:
        raise ValueError("open")
    return got


def strict_json(body: str) -> dict:
    try:
        try:
            doc = _JSON.decode(body)
        except RecursionError:
            doc = _deep_json(body)
    except ValueError:
        raise Broken("quoting") from None
    if not isinstance(doc, dict):
        raise Broken("quoting")
    return doc


def absent(value: str | None) -> bool:
    return value is None or value in ("", "-")


def holds(field: Field, value: str | None) -> bool:
    """Whether one trimmed value satisfies its field."""
    if absent(value):
        return not field.required
    kind = field.kind
    if kind == "choice":
        return value.lower() in field.choices
    if kind == "ipv4":
        return bool(_IPV4.fullmatch(value)) and all(int(p) <= 255 for p in value.split("."))
    if kind == "int":
        return bool(_INT.fullmatch(value))
    if kind == "port":
        return bool(_INT.fullmatch(value)) and int(value) <= 65535
    if kind == "epoch":
        return bool(_EPOCH.fullmatch(value)) and EPOCH_FROM <= Decimal(value) <= EPOCH_TO
    if kind == "stamp":
        m = _STAMP.fullmatch(value)
        if not m:
            return False
        try:
            datetime(*map(int, m.groups()))
        except ValueError:
            return False
    return True


def strict(layout: Layout, body: str) -> tuple[str | None, list[str | None] | None]:
    """(reason, None) of a body that fails, or (None, trimmed values in the layout's order)."""
    try:
        if layout.family in ("csv", "delimited"):
            values = strict_csv(body) if layout.family == "csv" else [v for v in _BLANKS.split(body) if v]
            if len(values) != len(layout.fields):
                return "columns", None
        elif layout.family == "kv":
            found = strict_kv(body)
            if any(f.required and f.name not in found for f in layout.fields):
                return "columns", None
            values = [found.get(f.name) for f in layout.fields]
        else:
            doc = strict_json(body)
            got = [_lookup(doc, f.name) for f in layout.fields]
            if any(f.required and v is _MISSING for f, v in zip(layout.fields, got)):
                return "columns", None
            values = [None if v is _MISSING else _as_text(v) for v in got]
    except Broken as e:
        return e.args[0], None
    values = [v if v is None else v.strip() for v in values]
    if all(map(holds, layout.fields, values)):
        return None, values
    return "value", None


# --- a block at once ------------------------------------------------------------------------------
# A parser takes a block whole: it returns the layout's columns, or None if the block as a whole does not parse. None of
# them tells which record is to blame. A body with a line break of its own never parses here: its rows would shift.

_CSV_FIELD_FORM = r'(?:"(?:[^"\n]++|"")*+"|[^",\n]*+)'
_KV_PAIR_FORM = r'[^\s="]++=(?:"[^"\n]*+"|[^\s"]*+)'
_CSV_ROW = rf"{_CSV_FIELD_FORM}(?:,{_CSV_FIELD_FORM})*+"
_KV_ROW = rf"{_KV_PAIR_FORM}(?:[ \t]++{_KV_PAIR_FORM})*+"
_CSV_BLOCK, _KV_BLOCK = (re.compile(rf"{row}(?:\n{row})*+") for row in (_CSV_ROW, _KV_ROW))
_KV_TOKENS = re.compile(r'([^ \t\n="]+)=(?:"([^"\n]*)"|([^ \t\n"]*))|(\n)')


def _all(mask) -> bool:
    return bool(pc.all(mask, min_count=0).as_py())


def _joined(bodies: list[str]) -> str | None:
    text = "\n".join(bodies)
    return None if text.count("\n") != len(bodies) - 1 or "\r" in text or text.startswith("\ufeff") else text


def _parse_csv(layout: Layout, bodies: list[str]) -> list[pa.Array] | None:
    """Arrow's reader splits the block, given that its quoting is in form from end to end."""
    text = _joined(bodies)
    if text is None or ('"' in text and not _CSV_BLOCK.fullmatch(text)):
        return None
    raw, names = text.encode(), [str(i) for i in range(len(layout.fields))]
    try:
        found = pacsv.read_csv(
            io.BytesIO(raw),
            pacsv.ReadOptions(use_threads=False, column_names=names, block_size=len(raw) + 16),
            pacsv.ParseOptions(newlines_in_values=False, ignore_empty_lines=False),
            pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    return [c.combine_chunks() for c in found.columns] if found.num_rows == len(bodies) else None


def _parse_delimited(layout: Layout, bodies: list[str]) -> list[pa.Array] | None:
    """One split of the block; its parts are a table if every row has as many as there are fields."""
    width = len(layout.fields)
    rows = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array(bodies, pa.string())))
    if "" in bodies or not _all(pc.equal(pc.list_value_length(rows), width)):
        return None
    parts = rows.flatten()
    return [parts.take(pa.array(np.arange(i, len(parts), width))) for i in range(width)]


def _parse_kv(layout: Layout, bodies: list[str]) -> list[pa.Array] | None:
    """One scan of the block for tokens, which are laid out as columns by key and row."""
    text = _joined(bodies)
    if text is None or not _KV_BLOCK.fullmatch(text):
        return None
    keys, quoted, bare, ends = zip(*_KV_TOKENS.findall(text))
    coded = pa.array(keys, pa.string()).dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    end = np.fromiter(map(bool, ends), bool, len(ends))
    row = np.cumsum(end)[~end]
    at, code, n = np.flatnonzero(~end), codes[~end], len(bodies)
    places = row * len(names) + code
    if len(np.unique(places)) != len(places):
        return None  # a key twice
    values = pa.array([q or b for q, b in zip(quoted, bare)], pa.string())
    columns = []
    for f in layout.fields:
        mine = code == names.index(f.name) if f.name in names else np.zeros(len(code), bool)
        if f.required and mine.sum() != n:
            return None
        source = np.full(n, -1, np.int64)
        source[row[mine]] = at[mine]
        columns.append(values.take(pa.array(source, mask=source < 0)))
    return columns


def _parse_json(layout: Layout, bodies: list[str]) -> list[pa.Array] | None:
    """The bodies as one document. A mark after each body must come back at the top level, in its place: then every
    body by itself is exactly one value."""
    head = f"\x01{hash(bodies[0])}:"
    mark = json.dumps(head)[:-1]
    try:
        found = _JSON.decode("[" + ",".join([f'{b},{mark}{i}"' for i, b in enumerate(bodies)]) + "]")
    except (ValueError, RecursionError):
        return None
    docs = found[::2]
    if found[1::2] != [f"{head}{i}" for i in range(len(bodies))] or not all(isinstance(d, dict) for d in docs):
        return None
    columns = []
    for f in layout.fields:
        values = [_lookup(d, f.name) for d in docs]
        if f.required and any(v is _MISSING for v in values):
            return None
        columns.append(pa.array([None if v is _MISSING else _as_text(v) for v in values], pa.string()))
    return columns


PARSERS = {"csv": _parse_csv, "delimited": _parse_delimited, "kv": _parse_kv, "json": _parse_json}


def bisect(layout: Layout, bodies: list[str]) -> tuple[list[int], list[pa.Array], list[int]]:
    """(positions that parse, their columns, positions to be diagnosed).

    The block goes to its parser whole. What fails is halved, and the halves are parsed anew, until the record that
    breaks its block stands alone but for its next neighbours."""
    parse, parts, good, bad, pending = PARSERS[layout.family], [], [], [], [(0, len(bodies))]
    while pending:
        start, end = pending.pop()
        if (columns := parse(layout, bodies[start:end])) is not None:
            parts.append(columns)
            good += range(start, end)
        elif end - start <= LEAF:
            bad += range(start, end)
        else:
            middle = (start + end) // 2
            pending += [(middle, end), (start, middle)]
    if not good:
        return good, [pa.array([], pa.string()) for _ in layout.fields], bad
    whole = parts[0] if len(parts) == 1 else [pa.concat_arrays(c) for c in zip(*parts)]
    return good, [pc.utf8_trim_whitespace(c) for c in whole], bad


_FAST_STAMP = (
    r"^[1-9]\d{3}/(?:(?:0[1-9]|1[0-2])/(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])/(?:29|30)|(?:0[13578]|1[02])/31)"
    r" (?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d$"
)
_FAST_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
_FAST_PORT = r"^(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])$"


def _sound(field: Field, column: pa.Array) -> pa.Array | None:
    """A mask of values that surely hold, absent ones included; None if all do."""
    if field.kind == "text" and not field.required:
        return None
    gone = pc.or_kleene(pc.is_null(column), pc.or_kleene(pc.equal(column, ""), pc.equal(column, "-")))
    gone = pc.fill_null(gone, True)
    if field.kind == "choice":
        ok = pc.is_in(pc.utf8_lower(column), pa.array(field.choices, pa.string()))
    elif field.kind == "ipv4":
        ok = pc.and_(pc.match_substring_regex(column, _FAST_IPV4), pc.invert(pc.ends_with(column, ".")))
    elif field.kind == "int":
        ok = pc.match_substring_regex(column, "^[0-9]{1,18}$")
    elif field.kind == "port":
        ok = pc.match_substring_regex(column, _FAST_PORT)
    elif field.kind == "epoch":
        ok = pc.match_substring_regex(column, r"^[0-9]{1,12}(?:\.[0-9]{1,9})?$")
        number = pc.cast(pc.if_else(pc.fill_null(ok, False), column, "0"), pa.float64())
        ok = pc.and_(ok, pc.and_(pc.greater(number, EPOCH_FROM), pc.less(number, EPOCH_TO)))
    elif field.kind == "stamp":
        ok = pc.match_substring_regex(column, _FAST_STAMP)
    else:
        ok = pc.invert(gone)
    ok = pc.fill_null(ok, False)
    return pc.if_else(gone, not field.required, ok)


def _screen(layout: Layout, columns: list[pa.Array]) -> pa.Array | None:
    """Which rows surely hold, or None if all do."""
    good = None
    for field, column in zip(layout.fields, columns):
        if (mask := _sound(field, column)) is not None:
            good = mask if good is None else pc.and_(good, mask)
    return None if good is None or _all(good) else good


def faults(layout: Layout, bodies: list[str]) -> list[tuple[int, str]]:
    """(position, reason) of the failing bodies alone; sound rows are never turned into Python objects."""
    at, columns, doubtful = bisect(layout, bodies)
    if (good := _screen(layout, columns)) is not None:
        doubtful += [at[i] for i in pc.indices_nonzero(pc.invert(good)).to_pylist()]
    return [(i, reason) for i in doubtful if (reason := strict(layout, bodies[i])[0])]


def judge(layout: Layout, bodies: list[str]) -> Iterator[tuple[int, str | None, list[str | None] | None]]:
    """(position, reason, values) for each body; values only of sound ones."""
    at, columns, doubtful = bisect(layout, bodies)
    good = _screen(layout, columns)
    flags = [True] * len(at) if good is None else good.to_pylist()
    for i, ok, row in zip(at, flags, zip(*(c.to_pylist() for c in columns))):
        if ok:
            yield i, None, list(row)
        else:
            doubtful.append(i)
    for i in doubtful:
        yield i, *strict(layout, bodies[i])


def _body(payload: bytes | None, header: re.Pattern) -> str:
    text = (payload or b"").decode("utf-8", "replace").rstrip("\r\n")
    m = header.match(text)
    return text[m.end():] if m else text


def _blocks(batch: pa.RecordBatch, layouts: dict[str, Layout]) -> Iterator[tuple[Layout, list[int], list[str]]]:
    """The batch's rows by grammar, in blocks, with their bodies."""
    by_grammar: dict[int, tuple[Layout, list[int]]] = {}
    for i, listener in enumerate(batch.column("listener").to_pylist()):
        layout = layouts[listener]
        by_grammar.setdefault(id(layout), (layout, []))[1].append(i)
    payloads = batch.column("payload")
    for layout, rows in by_grammar.values():
        header = re.compile(layout.header)
        part, bodies, size = [], [], 0
        for i in rows:
            body = _body(payloads[i].as_py(), header)
            if part and (len(part) == BLOCK or size + len(body) > BLOCK_BYTES):
                yield layout, part, bodies
                part, bodies, size = [], [], 0
            part.append(i)
            bodies.append(body)
            size += len(body)
        yield layout, part, bodies


def _per_part(records: DataFrame, grammars: DataFrame, keys: list[str], judge_part) -> DataFrame:
    """judge_part(rows, layouts) over the rows of listeners that have a layout: the columns a task needs, and the filter
    reaches the scan. Without layouts there are no rows."""
    listener, out = F.col("env.listener"), None
    for layouts in layouts_by_listener(grammars) or [{}]:
        rows = records.where(listener.isin(sorted(layouts)) if layouts else F.lit(False)).select(*keys, "payload", listener.alias("listener"))
        part = judge_part(rows, layouts)
        out = part if out is None else out.unionByName(part)
    return out


def rejected(records: DataFrame, grammars: DataFrame, keys: tuple[str, ...] = ("seq",)) -> DataFrame:
    """keys + reason (quoting, columns or value): one row for each record that fails. No shuffle."""
    def judge_part(chosen: DataFrame, layouts: dict[str, Layout]) -> DataFrame:
        types = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, why = [], []
                for layout, rows, bodies in _blocks(batch, layouts):
                    for i, reason in faults(layout, bodies):
                        at.append(rows[i])
                        why.append(reason)
                if at:
                    kept = batch.select(list(keys)).take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(why, pa.string())], [*keys, "reason"])

        return chosen.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", reason string")

    return _per_part(records, grammars, list(keys), judge_part)


def loaded(records: DataFrame, grammars: DataFrame) -> DataFrame:
    """seq, grammar, fields: the sound records with their present values by field name. No shuffle."""
    def judge_part(chosen: DataFrame, layouts: dict[str, Layout]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seq, grammar, fields = [], [], []
                seqs = batch.column("seq").to_pylist()
                for layout, rows, bodies in _blocks(batch, layouts):
                    names = [f.name for f in layout.fields]
                    for i, reason, values in judge(layout, bodies):
                        if reason is None:
                            seq.append(seqs[rows[i]])
                            grammar.append(layout.grammar)
                            fields.append([(n, v) for n, v in dict(zip(names, values)).items() if not absent(v)])
                if seq:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seq, pa.int64()), pa.array(grammar, pa.string()), pa.array(fields, pa.map_(pa.string(), pa.string()))],
                        ["seq", "grammar", "fields"],
                    )

        return chosen.mapInArrow(run, "seq bigint, grammar string, fields map<string,string>")

    return _per_part(records, grammars, ["seq"], judge_part)


def recounted(records: DataFrame, metrics: DataFrame, grammars: DataFrame) -> DataFrame:
    """stratum, rejected, counted_before: metrics.rejected anew, 0 for a stratum without a failing record."""
    anew = rejected(records, grammars, ("stratum",)).groupBy("stratum").agg(F.count("*").alias("n"))
    return (
        metrics.select("stratum", F.col("rejected").alias("counted_before"))
        .join(anew, "stratum", "left")
        .select("stratum", F.coalesce("n", F.lit(0)).cast("bigint").alias("rejected"), "counted_before")
    )
