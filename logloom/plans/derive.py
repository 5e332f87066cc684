"""Records to events: triage, extraction, mapping and validation as one narrow plan.

Nothing here shuffles. A grammar is compiled to expressions; a line runs those of the grammar that claims it,
chosen by a CASE on the grammar's number, so all sources go through one scan in one pass. Each step is a
projection of its own, which keeps later references from computing it again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from logloom.functions import extract, shapes, text
from logloom.functions import sql as F
from logloom.functions.sql import E, column, with_columns
from logloom.functions.times import clock_time
from logloom.plans.grammar import Grammar, Library
from logloom.storage import materialize

#: Thresholds of the decision, the schema version, and the plausible range of an event's time.
MARGIN, PENALTY, FLOOR = 0.12, 0.55, 0.70
OCSF_VERSION = "1.8.0"
TIME_FROM, TIME_TO = 946_684_800_000, 4_102_444_800_000
CHANNELS = ("file", "syslog_udp", "syslog_tcp", "syslog_tls", "http", "replay")

#: Flat columns of the lake and the paths they come from, in order.
FLAT = {
    "activity_id": ("activity_id", "int"), "disposition_id": ("disposition_id", "int"), "severity_id": ("severity_id", "int"),
    "src_ip": ("src_endpoint.ip", "string"), "src_port": ("src_endpoint.port", "int"),
    "dst_ip": ("dst_endpoint.ip", "string"), "dst_port": ("dst_endpoint.port", "int"),
    "protocol": ("connection_info.protocol_name", "string"), "app": ("app_name", "string"),
    "bytes_total": ("traffic.bytes", "bigint"), "bytes_in": ("traffic.bytes_in", "bigint"), "bytes_out": ("traffic.bytes_out", "bigint"),
    "user_name": ("actor.user.name", "string"), "rule": ("firewall_rule.name", "string"), "device": ("device.hostname", "string"),
    "vendor": ("metadata.product.vendor_name", "string"), "product": ("metadata.product.name", "string"),
}
LAKE = (
    "time_ms", "class_uid", *FLAT, "grammar", "grammar_version", "confidence", "coverage", "record_id", "stratum", "generation",
    "ocsf", "unmapped",
)


def by_number(grammars: list[Grammar], one: Callable[[Grammar], E | None], otherwise: E | None = None) -> E:
    """CASE on the grammar's number; equal results of several grammars are one branch."""
    out = None
    for i, g in enumerate(grammars):
        value = one(g)
        if value is not None:
            test = F.col("gi") == i
            out = F.when(test, value) if out is None else out.when(test, value)
    if out is None:
        return F.lit(None) if otherwise is None else otherwise
    return out if otherwise is None else out.otherwise(otherwise)


# --- triage ---------------------------------------------------------------------------------------

def pool(grammars: list[Grammar], shape: str) -> list[Grammar]:
    """Grammars that may claim a line of a shape: those of the shape, then the freeform ones."""
    same = [g for g in grammars if g.family == shape]
    return same if shape == "freeform" else same + [g for g in grammars if g.family == "freeform"]


def _score(g: Grammar, line: E, shape: E) -> E:
    """Cheap tests first, each nested in the one before."""
    sig = g.signature
    out = F.lit(sig.weight)
    if sig.pattern:
        out = F.when(line.rlike(text.FLAGS + text.numbered(sig.pattern)[0]), out).otherwise(0.0)
    if sig.any:
        some = line.contains(sig.any[0])
        for literal in sig.any[1:]:
            some = some | line.contains(literal)
        out = F.when(some, out).otherwise(0.0)
    for literal in reversed(sig.must):
        out = F.when(line.contains(literal), out).otherwise(0.0)
    return out if g.family == "freeform" else F.when(shape == g.family, out).otherwise(0.0)


def triaged(lines: DataFrame, grammars: list[Grammar], floor: float = FLOOR) -> DataFrame:
    """Adds counts, shape, contenders, gi (number of the best grammar), best, runner_up and confidence."""
    out = with_columns(lines, counts=shapes.counts(F.col("line")))
    out = with_columns(out, shape=shapes.classified(F.col("line"), F.col("counts")))
    order = sorted(range(len(grammars)), key=lambda i: (grammars[i].family == "freeform", i))
    scores = [
        F.struct((-_score(grammars[i], F.col("line"), F.col("shape"))).alias("s"), F.lit(k).alias("o"), F.lit(i).alias("i"))
        for k, i in enumerate(order)
    ]
    none = F.array().cast("array<struct<s:double,o:int,i:int>>")
    ranked = F.array_sort(F.filter(F.array(*scores), lambda x: x["s"] < 0)) if scores else none
    contenders = F.lit(0)
    for shape in shapes.SHAPES:
        contenders = F.when(F.col("shape") == shape, len(pool(grammars, shape))).otherwise(contenders)
    first, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    names = extract.texts(*[g.id for g in grammars])
    close = F.coalesce((second["s"] - first["s"]) < MARGIN, F.lit(False))
    # rounded here, where the few possible values are known
    sure = by_number(grammars, lambda g: F.lit(round(g.signature.weight, 3)))
    unsure = by_number(grammars, lambda g: F.lit(round(g.signature.weight * PENALTY, 3)))
    out = with_columns(out, contenders=contenders, ranked=ranked)
    out = with_columns(out, gi=first["i"], runner_up=F.get(names, second["i"]), best=F.get(names, first["i"]), close=close)
    sure = F.when(F.col("gi").isNull(), 0.0).otherwise(F.when(F.col("close"), unsure).otherwise(sure))
    return with_columns(out, confidence=sure).drop("ranked", "close")


# --- mapping --------------------------------------------------------------------------------------

@dataclass
class Leaf:
    """A value of a document: as text for flat columns, and for the JSON text as alternatives of different types, of which
    at most one is present. Types that are known beforehand are written by Spark as they are, without a variant."""

    values: list[E]
    text: E


def _literal(value: Any) -> Leaf:
    if isinstance(value, (dict, list)):
        import json

        body = json.dumps(value)
        return Leaf([F.parse_json(F.lit(body))], F.lit(body))
    return Leaf([F.lit(value)], F.lit(str(value).lower() if isinstance(value, bool) else str(value)))


def consumed(g: Grammar) -> list[str]:
    """Fields that an event of the grammar is made of. They are looked up once for each line, into an array `v`."""
    return list(dict.fromkeys([*g.emit.fields.values(), *(e.source for e in g.emit.enums.values()), *([g.clock.field] if g.clock else [])]))


def _value(name: str, g: Grammar) -> E:
    return F.get("v", F.lit(consumed(g).index(name)))


def _field(name: str, g: Grammar) -> Leaf:
    """A field as it was typed. Without a JSON step only declared types and the facility are not text, which is told
    without a look at the row."""
    value = _value(name, g)
    if any(step.kind == "json" for step in g.pipeline):
        typed = F.array_contains("t", name)
        return Leaf([F.when(~typed, value), F.when(typed, F.try_parse_json(value))], value)
    kind = "int" if name == "log_facility" else g.coerce.get(name, "str")
    if kind == "int":
        number = value.try_cast("bigint")
        return Leaf([number, F.when(number.isNull(), value)], value)
    if kind in ("float", "bool"):
        typed = F.array_contains("t", name)
        return Leaf([F.when(~typed, value), F.when(typed, F.try_parse_json(value))], value)
    return Leaf([value], value)


def _table(enum, g: Grammar) -> E:
    key = F.lower(text.stripped(_value(enum.source, g)))
    out = None
    for word, value in enum.table.items():
        out = F.when(key == word, F.lit(value)) if out is None else out.when(key == word, F.lit(value))
    return F.lit(enum.default) if out is None else out.otherwise(F.lit(enum.default))


def _mapped_enum(enum, g: Grammar) -> Leaf:
    present = _value(enum.source, g).isNotNull()
    kinds = {type(v) for v in [*enum.table.values(), enum.default]}
    if kinds <= {int}:
        value = _table(enum, g)
        return Leaf([F.when(present, value)], F.when(present, value.cast("string")))
    value = _table(type(enum)(enum.source, {k: str(v) for k, v in enum.table.items()}, str(enum.default)), g)
    return Leaf([F.when(present, value)], F.when(present, value))


def document(g: Grammar) -> dict:
    """The tree of an event of this grammar: nested dicts with Leaf at their ends. Later entries win where they
    are present."""
    root: dict = {}

    def place(path: str, leaf: Leaf) -> None:
        node, parts = root, path.split(".")
        for part in parts[:-1]:
            if not isinstance(node.get(part), dict):
                node[part] = {}
            node = node[part]
        before = node.get(parts[-1])
        if isinstance(before, Leaf):
            leaf = Leaf([*leaf.values, *(F.when(leaf.text.isNull(), v) for v in before.values)], F.coalesce(leaf.text, before.text))
        node[parts[-1]] = leaf

    number = lambda c: Leaf([c], c.cast("string"))
    place("class_uid", _literal(g.emit.cls))
    place("category_uid", _literal(g.emit.category))
    place("metadata.version", _literal(OCSF_VERSION))
    place("metadata.product.vendor_name", _literal(g.vendor))
    place("metadata.product.name", _literal(g.product))
    place("metadata.product.feature.name", _literal(g.id))
    place("metadata.logged_time", number(F.col("logged_ms")))
    place("metadata.processed_time", number(F.col("processed_ms")))
    for path, value in g.emit.const.items():
        place(path, _literal(value))
    for path, source in g.emit.fields.items():
        place(path, _field(source, g))
    for path, enum in g.emit.enums.items():
        place(path, _mapped_enum(enum, g))
        if enum.keep:
            place(enum.keep, _field(enum.source, g))
    timed = F.col("event_ns").isNotNull()
    if g.clock:
        original = F.when(timed, _value(g.clock.field, g))
        place("metadata.original_time", Leaf([original], original))
    fallback = F.when(~timed, F.lit("receipt_fallback"))
    place("metadata.time_source", Leaf([fallback], fallback))
    root["time"] = number(F.col("time_ms"))
    return root


def _struct(node: dict) -> E:
    """A struct of a tree; an inner node without any value is null, so that it is not written."""
    parts = []
    for name, child in node.items():
        if isinstance(child, Leaf):
            parts += [v.alias(name) for v in child.values]
        else:
            parts.append(F.when(_present(child), _struct(child)).alias(name))
    return F.struct(*parts)


def _present(node: dict) -> E:
    out = None
    for child in node.values():
        test = child.text.isNotNull() if isinstance(child, Leaf) else _present(child)
        out = test if out is None else out | test
    return F.lit(False) if out is None else out


def _dig(root: dict, path: str) -> Leaf | None:
    node: Any = root
    for part in path.split("."):
        if not isinstance(node, dict) or part not in node:
            return None
        node = node[part]
    return node if isinstance(node, Leaf) else None


def _kept(g: Grammar) -> list[str]:
    """Fields that a mapping claims or a grammar passes over."""
    return sorted({*g.emit.claims, *g.emit.ignore, *([g.clock.field] if g.clock else [])})


def _unclaimed(g: Grammar) -> E:
    kept = _kept(g)
    return F.map_filter("f", lambda k, v: ~k.isin(*kept)) if kept else F.col("f")


def _unmapped(g: Grammar) -> E:
    """JSON of the residue. Names that can be numbers or truth values are known without a look at the row, but for JSON,
    whose values bring their types along."""
    free = [n for n, kind in g.coerce.items() if kind != "str" and n not in _kept(g)]
    free += ["log_facility"] if any(step.kind == "syslog" for step in g.pipeline) and "log_facility" not in _kept(g) else []
    if any(step.kind == "json" for step in g.pipeline):
        own = lambda k, v: F.when(F.array_contains("t", k), F.try_parse_json(v)).otherwise(v.cast("variant"))
    elif free:
        own = lambda k, v: F.when(k.isin(*free) & F.array_contains("t", k), F.try_parse_json(v)).otherwise(v.cast("variant"))
    else:
        return F.to_json(F.col("residue"))
    return F.to_json(F.transform_values("residue", own))


# --- the plan -------------------------------------------------------------------------------------

def extracted(lines: DataFrame, grammars: list[Grammar]) -> DataFrame:
    """Adds f, t, notes, error and event_ns by the grammar numbered gi."""
    out = with_columns(lines, st=extract.begin(F.col("line")))
    for k in range(max((len(g.pipeline) for g in grammars), default=0)):
        step = by_number(grammars, lambda g: extract.run_step(g.pipeline[k], F.col("st")) if k < len(g.pipeline) else None, F.col("st"))
        out = with_columns(out, st=step)
    none = F.struct(F.col("st.f").alias("f"), F.col("st.t").alias("t"), F.array().cast("array<string>").alias("notes"))
    typed = by_number(grammars, lambda g: extract.coerced(F.col("st"), g.coerce) if g.coerce else None, none)
    clock = by_number(
        grammars, lambda g: clock_time(text.stripped(F.col("f")[g.clock.field]), g.clock.formats, g.clock.zone, F.col("received_ns")) if g.clock else None
    )
    out = with_columns(out, error=F.col("st.e"), typed=typed)
    out = with_columns(out, f=F.col("typed.f"), t=F.col("typed.t"), notes=F.col("typed.notes")).drop("st", "typed")
    return with_columns(out, event_ns=clock.cast("bigint"))


def lined(records: DataFrame) -> DataFrame:
    """What a derivation needs of stored records; lines are read whole, a limit of size is the gate's (lines.admitted)."""
    line = text.decoded(F.coalesce("payload", F.lit(b"")))
    return records.select(
        "id", "env", "stratum", column(F.coalesce("env.received_ns", F.lit(0))).alias("received_ns"), column(line).alias("line")
    )


def derivation(
    records: DataFrame, library: Library | list[Grammar], generation: int = 0, processed_ms: int | None = None, floor: float = FLOOR,
    replay: bool = False,
) -> DataFrame:
    """One row for each record: verdict, detail, and the columns of the lake where the verdict is `mapped`. The bare
    plan: to be written or aggregated, not filtered (see derive).

    records: id, payload, env, stratum as in the archive. Null payloads are empty lines, a null receipt is 0."""
    grammars = library.all() if isinstance(library, Library) else list(library)
    now = F.unix_millis(F.current_timestamp()) if processed_ms is None else F.lit(processed_ms)
    out = triaged(lined(records), grammars, floor)
    claimed = F.col("gi").isNotNull() & (F.col("confidence") >= floor) & (F.col("line") != "")
    out = with_columns(out, guess=F.when(F.col("line") != "", F.col("best")), gi=F.when(claimed, F.col("gi")))
    out = extracted(out, grammars)
    out = with_columns(
        out, logged_ms=F.expr("received_ns DIV 1000000"), processed_ms=now, time_ms=F.expr("coalesce(event_ns, received_ns) DIV 1000000")
    )
    docs = {g.id: document(g) for g in grammars}
    out = with_columns(out, v=by_number(grammars, lambda g: F.array(*[F.col("f")[n] for n in consumed(g)]) if consumed(g) else None).cast("array<string>"))
    out = with_columns(out, residue=by_number(grammars, _unclaimed, F.col("f")))
    flat = {
        name: by_number(grammars, lambda g, p=path: leaf.text if (leaf := _dig(docs[g.id], p)) else None).cast("string").try_cast(kind)
        for name, (path, kind) in FLAT.items()
    }
    shape, floor_text = F.col("shape"), str(floor)
    verdict = (
        F.when(F.col("line") == "", "unclaimed").when(F.col("best").isNull(), "unclaimed").when(F.col("confidence") < floor, "ambiguous")
        .when(F.col("error").isNotNull() | (F.size("f") == 0), "extract_failed")
        .when((F.col("time_ms") <= TIME_FROM) | (F.col("time_ms") >= TIME_TO), "invalid").otherwise("mapped")
    )
    runner = F.when(F.col("runner_up").isNotNull(), F.concat(F.lit("; runner-up "), "runner_up")).otherwise("")
    detail = (
        F.when(F.col("line") == "", "empty line")
        .when(F.col("best").isNull(), F.concat(F.lit("no grammar claims a "), shape, F.lit(" line")))
        .when(F.col("verdict") == "ambiguous", F.concat(F.lit("confidence "), F.col("confidence").cast("string"), F.lit(f" below floor {floor_text}"), runner))
        .when(F.col("error").isNotNull(), F.substring("error", 1, 200))
        .when(F.col("verdict") == "extract_failed", "pipeline produced no fields")
        .when(F.col("verdict") == "invalid", F.concat(F.lit("time "), F.col("time_ms").cast("string"), F.lit(" is outside a plausible range; check the clock spec")))
    )
    size = F.size("f")
    out = with_columns(out, **{
        "verdict": verdict, "class_uid": by_number(grammars, lambda g: F.lit(g.emit.cls)).cast("int"),
        "grammar": F.when(F.col("gi").isNotNull(), F.col("best")), "grammar_version": by_number(grammars, lambda g: F.lit(g.version)).cast("string"),
        "coverage": F.when(size > 0, (size - F.size("residue")) / size).otherwise(0.0), "record_id": F.lower(F.hex("id")),
        "generation": F.lit(generation), **flat,
        "ocsf": by_number(grammars, lambda g: F.to_json(_struct(docs[g.id]))).cast("string"), "unmapped": by_number(grammars, _unmapped, F.to_json(F.col("residue"))),
    })
    out = with_columns(out, detail=detail)
    channel = F.when(F.lit(replay), F.lit(5).cast("tinyint")).otherwise(F.col("env.channel"))
    return out.select(
        "verdict", "detail", "guess", "shape", "contenders", "runner_up",
        *[column(F.col(c).cast("float")).alias(c) if c in ("confidence", "coverage") else c for c in LAKE],
        column(channel).alias("channel"), column(F.col("env.peer")).alias("peer"), "received_ns", "event_ns", "notes",
        column(F.col("f")).alias("fields"),
    )


def derive(
    records: DataFrame, library: Library | list[Grammar], generation: int = 0, processed_ms: int | None = None, floor: float = FLOOR,
    replay: bool = False,
) -> DataFrame:
    """The derivation, written once by verdict, so that events and rejections are parts of a table.

    A filter on the bare plan would be pushed into its chain of projections, where each step names the one before
    many times; the plan would grow beyond measure."""
    return materialize(derivation(records, library, generation, processed_ms, floor, replay), "derived", ["verdict"])


def events(derived: DataFrame) -> DataFrame:
    """The rows of the lake, of what derive() gave."""
    return derived.where("verdict = 'mapped'").select(*LAKE)


def rejections(derived: DataFrame) -> DataFrame:
    """record_id, verdict, detail, best_guess, confidence of what was not mapped, of what derive() gave; the bytes
    stay in the archive."""
    return derived.where("verdict <> 'mapped'").selectExpr(
        "record_id", "verdict", "detail", "CASE WHEN verdict <> 'unclaimed' THEN guess END AS best_guess",
        "CASE WHEN verdict <> 'unclaimed' THEN CAST(confidence AS DOUBLE) ELSE 0.0D END AS confidence",
    )
