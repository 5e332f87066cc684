"""Grammars: how the lines of one source are recognised, read and mapped. Data, not code.

A grammar is a YAML mapping. Every node refuses unknown keys, so a misspelt key is an error instead of a mapping
that silently does nothing, and a step can name only one of nine primitives: there is nothing to execute.
Reading a directory never fails as a whole; files that are wrong are reported and the others load.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import partial
from pathlib import Path
from typing import Any

import yaml

from logloom.functions.shapes import SHAPES
from logloom.functions.times import FORMATS, zone_offset
from logloom.functions.text import numbered

PRIMITIVES = ("syslog", "columns", "whitespace", "kv", "json", "cef", "leef", "regex", "prefix")
BODY = "__body__"
SHIPPED = Path(__file__).resolve().parent.parent / "grammars"


class GrammarError(ValueError):
    """What is wrong with a grammar, by key."""


# --- checks of single values ----------------------------------------------------------------------

def _text(value: Any, where: str, most: int | None = None, pattern: str | None = None) -> str:
    if not isinstance(value, str):
        raise GrammarError(f"{where}: must be text")
    if most and len(value) > most:
        raise GrammarError(f"{where}: longer than {most}")
    if pattern and not re.fullmatch(pattern, value):
        raise GrammarError(f"{where}: {value!r} does not match {pattern}")
    return value


def _texts(value: Any, where: str, least: int = 0) -> tuple[str, ...]:
    if not isinstance(value, list) or len(value) < least:
        raise GrammarError(f"{where}: must be a list" + (f" of at least {least}" if least else ""))
    return tuple(_text(v, f"{where}.{i}") for i, v in enumerate(value))


def _whole(value: Any, where: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise GrammarError(f"{where}: must be a whole number")
    return value


def _flag(value: Any, where: str) -> bool:
    if not isinstance(value, bool):
        raise GrammarError(f"{where}: must be true or false")
    return value


def _weight(value: Any, where: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 < value <= 1:
        raise GrammarError(f"{where}: must lie above 0 and at most at 1")
    return float(value)


def _one_of(choices: tuple[str, ...], value: Any, where: str) -> str:
    if value not in choices:
        raise GrammarError(f"{where}: {value!r} is not one of {sorted(choices)}")
    return value


def _regex(value: Any, where: str) -> str:
    text = _text(value, where)
    try:
        re.compile(text)
        numbered(text)
    except (re.error, ValueError) as e:
        raise GrammarError(f"{where}: bad regex {text!r}: {e}") from None
    return text


def _mapping(value: Any, where: str) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise GrammarError(f"{where}: must be a mapping")
    return {str(k): v for k, v in value.items()}


def _node(value: Any, where: str, readers: dict[str, Any], required: tuple[str, ...] = ()) -> dict[str, Any]:
    found = _mapping(value, where)
    for key in found:
        if key not in readers:
            raise GrammarError(f"{where}.{key}: unknown key")
    for key in required:
        if key not in found:
            raise GrammarError(f"{where}.{key}: missing")
    return {k: readers[k](v, f"{where}.{k}") for k, v in found.items() if v is not None or k in required}


# --- nodes ----------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Signature:
    must: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    pattern: str | None = None
    weight: float = 0.9

    @staticmethod
    def read(value: Any, where: str) -> "Signature":
        got = Signature(**_node(value, where, {"must": _texts, "any": _texts, "pattern": _regex, "weight": _weight}))
        if not (got.must or got.any or got.pattern):
            raise GrammarError(f"{where}: needs must, any or pattern")
        return got


@dataclass(frozen=True)
class Step:
    kind: str
    value: Any
    sep: str = ","
    quote: str = '"'
    pair_sep: str | None = None
    lower_keys: bool = False
    maxsplit: int = 0
    source: str = BODY
    keep_body: bool = False
    depth: int = 6
    flatten_sep: str = "."
    optional: bool = False

    @staticmethod
    def read(value: Any, where: str) -> "Step":
        readers = {
            "syslog": partial(_one_of, ("auto", "rfc3164", "rfc5424")), "columns": _texts, "whitespace": _texts, "kv": _flag,
            "json": _flag, "cef": _flag, "leef": _flag, "regex": _regex, "prefix": _regex, "sep": _text, "quote": _text,
            "pair_sep": _text, "lower_keys": _flag, "maxsplit": _whole, "source": _text, "keep_body": _flag, "depth": _whole,
            "flatten_sep": _text, "optional": _flag,
        }
        got = _node(value, where, readers)
        named = [k for k in PRIMITIVES if got.get(k) not in (None, False)]
        if len(named) != 1:
            raise GrammarError(f"{where}: {', '.join(named) if named else 'no primitive'} named where one of {', '.join(PRIMITIVES)} is wanted")
        if len(got.get("pair_sep") or " ") != 1:
            raise GrammarError(f"{where}.pair_sep: must be one character")
        arguments = {k: v for k, v in got.items() if k not in PRIMITIVES}
        return Step(named[0], got[named[0]], **arguments)


@dataclass(frozen=True)
class EnumMap:
    source: str
    table: dict[str, int | str]
    default: int | str = 99
    keep: str | None = None

    @staticmethod
    def read(value: Any, where: str) -> "EnumMap":
        def plain(v: Any, at: str) -> int | str:
            if isinstance(v, bool) or not isinstance(v, (int, str)):
                raise GrammarError(f"{at}: must be a whole number or text")
            return v

        def table(v: Any, at: str) -> dict[str, int | str]:
            return {k.lower(): plain(x, f"{at}.{k}") for k, x in _mapping(v, at).items()}

        return EnumMap(**_node(value, where, {"source": _text, "table": table, "default": plain, "keep": _text}, ("source", "table")))


@dataclass(frozen=True)
class Emit:
    cls: int
    category: int
    const: dict[str, Any] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)
    enums: dict[str, EnumMap] = field(default_factory=dict)
    ignore: tuple[str, ...] = ()

    @staticmethod
    def read(value: Any, where: str) -> "Emit":
        def sources(v: Any, at: str) -> dict[str, str]:
            return {k: _text(x, f"{at}.{k}") for k, x in _mapping(v, at).items()}

        def enums(v: Any, at: str) -> dict[str, EnumMap]:
            return {k: EnumMap.read(x, f"{at}.{k}") for k, x in _mapping(v, at).items()}

        readers = {"class": _whole, "category": _whole, "const": _mapping, "fields": sources, "enums": enums, "ignore": _texts}
        got = _node(value, where, readers, ("class", "category"))
        return Emit(got.pop("class"), **got)

    @property
    def claims(self) -> frozenset[str]:
        return frozenset([*self.fields.values(), *(e.source for e in self.enums.values())])


@dataclass(frozen=True)
class Clock:
    field: str
    formats: tuple[str, ...]
    zone: str = "UTC"

    @staticmethod
    def read(value: Any, where: str) -> "Clock":
        got = Clock(**_node(value, where, {"field": _text, "formats": partial(_texts, least=1), "zone": _text}, ("field", "formats")))
        for f in got.formats:
            _one_of(FORMATS, f, f"{where}.formats")
        try:
            zone_offset(got.zone)
        except ValueError as e:
            raise GrammarError(f"{where}.zone: {e}") from None
        return got


@dataclass(frozen=True)
class Grammar:
    id: str
    version: str
    vendor: str
    product: str
    signature: Signature
    pipeline: tuple[Step, ...]
    emit: Emit
    title: str = ""
    family: str = "freeform"
    coerce: dict[str, str] = field(default_factory=dict)
    clock: Clock | None = None

    @staticmethod
    def read(value: Any) -> "Grammar":
        def steps(v: Any, at: str) -> tuple[Step, ...]:
            if not isinstance(v, list) or not v:
                raise GrammarError(f"{at}: must be a list of at least 1")
            return tuple(Step.read(x, f"{at}.{i}") for i, x in enumerate(v))

        def casts(v: Any, at: str) -> dict[str, str]:
            return {k: _one_of(("int", "float", "bool", "str"), x, f"{at}.{k}") for k, x in _mapping(v, at).items()}

        readers = {
            "id": partial(_text, most=64, pattern=r"[a-z0-9]+(?:\.[a-z0-9_]+)+"), "version": partial(_text, pattern=r"\d+\.\d+\.\d+"),
            "vendor": partial(_text, most=64), "product": partial(_text, most=64), "title": _text,
            "family": partial(_one_of, tuple(SHAPES)), "signature": Signature.read, "pipeline": steps, "coerce": casts,
            "clock": Clock.read, "emit": Emit.read,
        }
        return Grammar(**_node(value, "grammar", readers, ("id", "version", "vendor", "product", "signature", "pipeline", "emit")))


class Library:
    """The grammars of a directory; reload() takes up what has changed since."""

    def __init__(self, directory: str | Path = SHIPPED):
        self.directory = Path(directory)
        self.grammars: dict[str, Grammar] = {}
        self.errors: dict[str, str] = {}
        self.generation = 0
        self._stamp: tuple = ()
        self.reload()

    def reload(self) -> dict[str, str]:
        grammars: dict[str, Grammar] = {}
        errors: dict[str, str] = {}
        files = sorted(self.directory.glob("*.y*ml"))
        for path in files:
            try:
                got = Grammar.read(yaml.safe_load(path.read_text(encoding="utf-8")))
                if got.id in grammars:
                    raise GrammarError(f"duplicate grammar id {got.id!r}")
                grammars[got.id] = got
            except (ValueError, yaml.YAMLError) as e:
                errors[path.name] = str(e)
        self.grammars, self.errors, self.generation = grammars, errors, self.generation + 1
        self._stamp = self._now()
        return errors

    def _now(self) -> tuple:
        return tuple((p.name, p.stat().st_mtime_ns, p.stat().st_size) for p in sorted(self.directory.glob("*.y*ml")))

    def refresh(self) -> bool:
        """Reload if a file has come, gone or changed."""
        if self._now() == self._stamp:
            return False
        self.reload()
        return True

    def all(self) -> list[Grammar]:
        return list(self.grammars.values())

    def families(self) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {}
        for g in self.all():
            found.setdefault(g.family, []).append(g.id)
        return {k: sorted(found[k]) for k in SHAPES if k in found}

    def publish(self, grammar: dict[str, Any], name: str | None = None) -> Grammar:
        """Write a grammar beside the others; a wrong one leaves the directory as it was."""
        got = Grammar.read(grammar)
        path = self.directory / f"{name or got.id}.yaml"
        before = path.read_bytes() if path.exists() else None
        part = path.with_suffix(".part")
        part.write_text(yaml.safe_dump(grammar, sort_keys=False, allow_unicode=True), encoding="utf-8")
        os.replace(part, path)
        errors = self.reload()
        if path.name in errors:
            path.unlink() if before is None else path.write_bytes(before)
            self.reload()
            raise GrammarError(errors[path.name])
        return got
