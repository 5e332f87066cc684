"""Expressions as SQL text, written like columns.

Compiled grammars are large expressions. Building each node as a JVM object costs a round trip for every call;
as text a whole projection is parsed at once. Names and rules are those of pyspark.sql.functions: text given to
a function is a column's name, text compared with or given to when() is a value.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as spark_functions

_fresh = count()

#: Arguments that are values when given as text, by function.
_VALUES = {
    "split": (1,), "regexp_replace": (1, 2), "regexp_extract": (1,), "array_join": (1,), "rpad": (2,), "substring_index": (1,),
    "instr": (1,), "array_contains": (1,), "array_append": (1,), "replace": (1, 2), "sha2": (1,), "date_format": (1,),
}


def quoted(text: str) -> str:
    body = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\x00", "\\0")
    return f"'{body}'"


def name(path: str) -> str:
    return ".".join(f"`{p}`" for p in path.split("."))


def _literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        text = f"{value}" if -(2**31) <= value < 2**31 else f"{value}L"
        return f"({text})" if value < 0 else text
    if isinstance(value, float):
        text = f"{value!r}D"
        return f"({text})" if value < 0 else text
    if isinstance(value, (bytes, bytearray)):
        return f"X'{value.hex()}'"
    return quoted(str(value))


def value(x: Any) -> str:
    """Text of an operand; plain text is a value."""
    return x.text if isinstance(x, E) else _literal(x)


def operand(x: Any) -> str:
    """Text of an argument; plain text is a column's name."""
    if isinstance(x, E):
        return x.text
    return name(x) if isinstance(x, str) else _literal(x)


class E:
    """An expression."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use &, | and ~")

    def _op(self, sign: str, other: Any) -> E:
        return E(f"({self.text} {sign} {value(other)})")

    def _rop(self, sign: str, other: Any) -> E:
        return E(f"({value(other)} {sign} {self.text})")

    def __eq__(self, o): return self._op("=", o)  # noqa: E704
    def __ne__(self, o): return self._op("<>", o)  # noqa: E704
    def __lt__(self, o): return self._op("<", o)  # noqa: E704
    def __le__(self, o): return self._op("<=", o)  # noqa: E704
    def __gt__(self, o): return self._op(">", o)  # noqa: E704
    def __ge__(self, o): return self._op(">=", o)  # noqa: E704
    def __add__(self, o): return self._op("+", o)  # noqa: E704
    def __radd__(self, o): return self._rop("+", o)  # noqa: E704
    def __sub__(self, o): return self._op("-", o)  # noqa: E704
    def __rsub__(self, o): return self._rop("-", o)  # noqa: E704
    def __mul__(self, o): return self._op("*", o)  # noqa: E704
    def __rmul__(self, o): return self._rop("*", o)  # noqa: E704
    def __truediv__(self, o): return self._op("/", o)  # noqa: E704
    def __mod__(self, o): return self._op("%", o)  # noqa: E704
    def __and__(self, o): return self._op("AND", o)  # noqa: E704
    def __or__(self, o): return self._op("OR", o)  # noqa: E704
    def __invert__(self): return E(f"(NOT {self.text})")  # noqa: E704
    def __neg__(self): return E(f"(- {self.text})")  # noqa: E704
    def __getitem__(self, k): return E(f"{self.text}[{value(k)}]")  # noqa: E704
    __hash__ = None

    def isNull(self) -> E:
        return E(f"({self.text} IS NULL)")

    def isNotNull(self) -> E:
        return E(f"({self.text} IS NOT NULL)")

    def contains(self, other: Any) -> E:
        return E(f"contains({self.text}, {value(other)})")

    def startswith(self, other: Any) -> E:
        return E(f"startswith({self.text}, {value(other)})")

    def endswith(self, other: Any) -> E:
        return E(f"endswith({self.text}, {value(other)})")

    def rlike(self, pattern: str) -> E:
        return E(f"rlike({self.text}, {value(pattern)})")

    def isin(self, *values: Any) -> E:
        return E(f"({self.text} IN ({', '.join(map(value, values))}))") if values else E("false")

    def between(self, low: Any, high: Any) -> E:
        return E(f"({self.text} BETWEEN {value(low)} AND {value(high)})")

    def bitwiseAND(self, other: Any) -> E:
        return self._op("&", other)

    def cast(self, kind: str) -> E:
        return E(f"CAST({self.text} AS {kind})")

    def try_cast(self, kind: str) -> E:
        return E(f"TRY_CAST({self.text} AS {kind})")

    def alias(self, label: str) -> E:
        return E(f"{self.text} AS `{label}`")


class When(E):
    """CASE under construction; complete at any time."""

    def __init__(self, branches: list[tuple[Any, Any]]):
        self.branches = branches
        super().__init__(self._text("NULL"))

    def _text(self, last: str) -> str:
        body = " ".join(f"WHEN {value(c)} THEN {value(v)}" for c, v in self.branches)
        return f"CASE {body} END" if last == "NULL" else f"CASE {body} ELSE {last} END"

    def when(self, condition: Any, result: Any) -> When:
        return When([*self.branches, (condition, result)])

    def otherwise(self, result: Any) -> E:
        return E(self._text(value(result)))


def when(condition: Any, result: Any) -> When:
    return When([(condition, result)])


def lit(x: Any) -> E:
    return x if isinstance(x, E) else E(_literal(x))


def col(path: str) -> E:
    return E(name(path))


def expr(text: str) -> E:
    return E(f"({text})")


def trim(x: Any, chars: Any = None) -> E:
    return E(f"trim({operand(x)})" if chars is None else f"trim(BOTH {value(chars)} FROM {operand(x)})")


def rtrim(x: Any, chars: Any = None) -> E:
    return E(f"rtrim({operand(x)})" if chars is None else f"trim(TRAILING {value(chars)} FROM {operand(x)})")


def create_map(*parts: Any) -> E:
    return E(f"map({', '.join(map(operand, parts))})")


def _lambda(body: Callable) -> str:
    wanted = [p for p in inspect.signature(body).parameters.values() if p.default is p.empty]
    names = [f"v{next(_fresh)}" for _ in wanted]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {value(body(*map(E, names)))}"


def __getattr__(function: str) -> Callable[..., E]:
    """Any other function of Spark by its name."""
    if function.startswith("__"):
        raise AttributeError(function)

    def call(*arguments: Any) -> E:
        values = _VALUES.get(function, ())
        parts = []
        for i, x in enumerate(arguments):
            if callable(x) and not isinstance(x, E):
                parts.append(_lambda(x))
            else:
                parts.append(value(x) if i in values else operand(x))
        return E(f"{function}({', '.join(parts)})")

    return call


def column(x: E) -> Column:
    """The expression as a column of Spark."""
    return spark_functions.expr(x.text)


def with_columns(df: DataFrame, **added: E) -> DataFrame:
    return df.withColumns({k: column(v) for k, v in added.items()})
