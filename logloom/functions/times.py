"""Device timestamps as expressions: text to epoch nanoseconds."""

from __future__ import annotations

import re

from logloom.functions import sql as F
from logloom.functions.sql import E

from logloom.functions.text import captured, let

#: The formats a clock may declare, and the months.
FORMATS = ("iso8601", "slashed", "dashed", "bsd", "epoch", "epoch_ms")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DAY_NS = 86_400_000_000_000


def zone_offset(zone: str) -> int:
    """Seconds east of UTC; named zones are refused, they depend on the version of a database."""
    text = zone.strip().upper()
    if text in ("", "UTC", "GMT", "Z"):
        return 0
    m = re.fullmatch(r"(?:([+-])?(?:UTC|GMT))?([+-]?)(\d{2}):?(\d{2})?", text)
    if not m:
        raise ValueError(f"unsupported timezone {zone!r}; use UTC or a fixed offset like +05:30")
    sign = -1 if "-" in ((m[1] or "") + m[2]) else 1
    return sign * (int(m[3]) * 3600 + int(m[4] or 0) * 60)


def _instant(y: E, mo: E, d: E, h: E, mi: E, s: E, nanos: E, offset: E) -> E:
    """Null for an impossible date or time; second 60 reads as 59."""
    ints = [x.try_cast("int") for x in (y, mo, d, h, mi)]
    sound = (ints[3] <= 23) & (ints[4] <= 59) & (s.try_cast("int") <= 60)
    second = F.least(s.try_cast("int"), F.lit(59)).cast("decimal(8,6)")
    at = F.try_make_timestamp(*ints, second, F.lit("UTC"))
    return F.when(sound, (F.unix_seconds(at) - offset) * 1_000_000_000 + nanos)


_ISO = r"(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.(\d*))?(?:([Zz])|([+-])(\d{2}):?(\d{2}))?"
_SLASHED = r"(\d{4})/(\d{2})/(\d{2}) (\d{2}):(\d{2}):(\d{2})"
_BSD = r"([A-Z][a-z]{2}).([ \d]\d|\d ).(\d{2}).(\d{2}).(\d{2})"


def _iso8601(v: E, zone: int, received: E) -> E:
    def read(g: E) -> E:
        micros = F.rpad(F.substring(g[6], 1, 6), 6, "0").cast("bigint") * 1000
        shift = g[9].try_cast("int") * 3600 + g[10].try_cast("int") * 60
        offset = F.when(g[7] != "", 0).when(g[8] == "+", shift).when(g[8] == "-", -shift).otherwise(zone)
        return _instant(*[g[i] for i in range(6)], micros, offset)

    return let(captured(v, _ISO, list(range(1, 12)), anchored=True), read)


def _slashed(v: E, zone: int, received: E) -> E:
    return let(
        captured(v, _SLASHED, [1, 2, 3, 4, 5, 6], anchored=True), lambda g: _instant(*[g[i] for i in range(6)], F.lit(0), F.lit(zone))
    )


def _bsd(v: E, zone: int, received: E) -> E:
    """No year in the text: that of the receipt, or the year before where that lies more than a day ahead of it."""
    def read(g: E) -> E:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), g[0]).cast("string")
        year = F.year(F.timestamp_seconds(F.floor(received / 1_000_000_000)))
        at = lambda y: _instant(y.cast("string"), month, F.trim(g[1]), g[2], g[3], g[4], F.lit(0), F.lit(zone))
        return F.when(at(year) > received + DAY_NS, at(year - 1)).otherwise(at(year))

    return let(captured(v, _BSD, [1, 2, 3, 4, 5], anchored=True), read)


def _number(v: E, scale: float) -> E:
    """Double arithmetic, cut to whole nanoseconds; null beyond what fits."""
    x = v.try_cast("double") * F.lit(scale)
    return F.when(~F.isnan(x) & (F.abs(x) < 9.2e18), x.cast("bigint"))


_READERS = {
    "iso8601": _iso8601, "dashed": _iso8601, "slashed": _slashed, "bsd": _bsd,
    "epoch": lambda v, zone, received: _number(v, 1e9), "epoch_ms": lambda v, zone, received: _number(v, 1e6),
}


def clock_time(value: E, formats: tuple[str, ...] | list[str], zone: str, received_ns: E) -> E:
    """The first declared format that reads the value, as epoch nanoseconds."""
    offset = zone_offset(zone)
    tried = [_READERS[f](value, offset, received_ns) for f in dict.fromkeys(formats)]
    return tried[0] if len(tried) == 1 else F.coalesce(*tried)


def sniffed(value: E) -> E:
    """Name of the format a sample looks like, null if none."""
    received = F.lit(4_000_000_000_000_000_000)
    v = F.trim(value)
    return (
        F.when(v == "", None)
        .when(_iso8601(v, 0, received).isNotNull(), "iso8601")
        .when(_slashed(v, 0, received).isNotNull(), "slashed")
        .when(_bsd(v, 0, received).isNotNull(), "bsd")
        .when(v.rlike(r"^\d{13}$"), "epoch_ms")
        .when(v.rlike(r"^\d{9,11}$"), "epoch")
        .when(v.rlike(r"^(?:\d+\.\d*|\.\d+)$"), "epoch")
    )
