"""The structural family of a line, from counts of a few characters."""

from __future__ import annotations

from logloom.functions import sql as F
from logloom.functions.sql import E

from logloom.functions.text import count_of, stripped

#: Families and their numbers.
SHAPES = {"unknown": 0, "json": 1, "cef": 2, "leef": 3, "kv": 4, "csv": 5, "delimited": 6, "freeform": 7}

_PRI = r"^<([0-9]{1,4})>"


def after_pri(line: E) -> E:
    """The line behind a syslog priority of up to four digits."""
    return F.when(line.startswith("<"), F.regexp_replace(line, _PRI, "")).otherwise(line)


def counts(line: E) -> E:
    """struct of length, counts on the body, syslog_pri (null without one) and body_at."""
    body = after_pri(line)
    pri = F.regexp_extract(line, _PRI, 1)
    return F.struct(
        F.char_length(line).alias("length"),
        *[count_of(body, c).alias(n) for n, c in (("commas", ","), ("equals", "="), ("pipes", "|"), ("tabs", "\t"), ("spaces", " "))],
        F.when(pri != "", pri.cast("int")).alias("syslog_pri"),
        F.when(pri != "", F.char_length(pri) + 2).otherwise(0).alias("body_at"),
    )


def positional(body: E) -> E:
    """Of the first sixteen words at least five, half of them with a digit."""
    words = F.slice(F.split(stripped(body), r"\s+"), 1, 16)
    return (F.size(words) >= 5) & (F.size(F.filter(words, lambda w: w.rlike(r"\d"))) * 2 >= F.size(words))


def classified(line: E, c: E) -> E:
    """Name of the family of a line, given its counts. The surest marks come first."""
    body = after_pri(line)
    bare = stripped(body)
    words = c["spaces"] + 1
    return (
        F.when(bare == "", "unknown")
        .when(bare.startswith("{") & bare.endswith("}"), "json")
        .when((c["pipes"] >= 5) & body.contains("CEF:"), "cef")
        .when((c["pipes"] >= 4) & body.contains("LEEF:"), "leef")
        .when((c["equals"] >= 4) & (c["equals"] * 6 >= words), "kv")
        .when((c["commas"] >= 8) & (c["equals"] < 3), "csv")
        .when(c["tabs"] >= 4, "delimited")
        .when(words.between(5, 24) & (c["commas"] <= 2) & (c["equals"] <= 1) & positional(body), "delimited")
        .otherwise("freeform")
    )
