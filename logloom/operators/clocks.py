"""Mixed timestamp formats and zones made one UTC instant, by expectation-maximisation over format mixtures.

Each text is tried under every format its clock declares (all of them where none is declared), and every valid
interpretation is a candidate: the two orders of day and month, both instants of a local time that occurs twice,
and, where the rules leave them open, the zone, the year and the unit of a number. For each clock a mixture over
formats and a distribution of delays (receipt minus instant) are fitted by EM: a reading contributes the
likelihood of each of its candidates, and its posterior chooses the candidate that becomes event_ns. Readings
with the same candidates (formats, delay classes, priors) are alike to the fit, so the corpus is read once and EM
sees a small table of counts.

What a project's rules settle enters as a prior of 0 or 1 on candidates (`Rules`): a printed offset or
abbreviation wins over the clock's zone; of a local time that occurs twice the later instant holds unless it lies
after receipt; a text without a year takes the latest year in which it, read as UTC, is at most a day after receipt;
the digits of a number tell its unit. A rule that is lifted leaves its candidates to the posterior. Always: a local
time that its zone skipped is no time; instants lie in 2000 to 2099 and are cut to whole microseconds.

A reading whose candidates the likelihood alone does not tell apart (below SURE) is marked `ambiguous`, with the next
best instant beside it, whether or not a rule has chosen. Null, blank and unreadable texts, and readings of an unknown
clock without any printed zone, are kept as `no_time`. A null zone is UTC; a null receipt leaves a text without year no
time. Readings without clock_id share a mixture; of clocks with the same clock_id any one holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.storage import materialize

FORMATS = ("iso8601", "dashed", "slashed", "bsd", "epoch", "epoch_ms", "day_first", "month_first")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAY = 86_400
FROM_S, TO_S = 946_684_800, 4_102_444_800
#: Likelihood of the chosen instant, as a part of all, below which it is called ambiguous.
SURE = 0.9
#: Delay classes: 2 signs of 40 powers of two of milliseconds; class 0 where nothing is known.
DELAYS = 82
ROUNDS, TOLERANCE = 200, 1e-9

_TAIL = r"(?P<h>\d{2}):(?P<mi>\d{2}):(?P<s>\d{2})(?:[.,](?P<f>\d+))?(?:[ \t]*(?P<z>[Zz]|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,6}))?$"
_PATTERNS = {
    "iso": r"^(?P<y>\d{4})-(?P<mo>\d{2})-(?P<d>\d{2})(?:[Tt]|[ ]+)" + _TAIL,
    "slashed": r"^(?P<y>\d{4})/(?P<mo>\d{2})/(?P<d>\d{2})(?:[Tt]|[ ]+)" + _TAIL,
    "bsd": r"^(?P<mo>[A-Za-z]{3})[ ]+(?P<d>\d{1,2})(?:[ ]+(?P<y>\d{4}))?[ ]+" + _TAIL,
    "parted": r"^(?P<a>\d{1,2})[/.-](?P<b>\d{1,2})[/.-](?P<y>\d{4})(?:,?[Tt ][ ]*)" + _TAIL,
}
_NUMBER = r"^(?P<whole>\d{1,19})(?:[.,](?P<f>\d+))?$"
_EXPONENT = re.compile(r"(\d+)(?:[.,](\d+))?[eE]([+-]?\d+)")
_BITS = {"iso": 0b00000011, "slashed": 0b00000100, "bsd": 0b00001000, "number": 0b00110000}
_DAY_FIRST, _MONTH_FIRST = 1 << 6, 1 << 7


@dataclass(frozen=True)
class Rules:
    """What is settled whatever the likelihood. A rule that is False leaves its candidates to the posterior: the clock's
    zone or UTC; either instant of a doubled local time; this year or the one before; any unit of a number."""

    zone: bool = True
    fold: bool = True
    year: bool = True
    digits: bool = True


# --- zones ----------------------------------------------------------------------------------------

class Zone:
    """Offsets of a zone from 1999 to 2101 as arrays, and what its abbreviations mean."""

    def __init__(self, changes: list[int], offsets: list[int], names: dict[str, int]):
        self.changes, self.offsets, self.names = np.array(changes, np.int64), np.array(offsets, np.int64), names

    def offset_at(self, utc: np.ndarray) -> np.ndarray:
        return self.offsets[np.searchsorted(self.changes, utc, side="right")]

    def instants(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(earlier, later, exists): UTC seconds of a local time; both equal where it occurs once."""
        before, after = self.offset_at(local - DAY), self.offset_at(local + DAY)
        early, late = local - before, local - after
        early_ok, late_ok = self.offset_at(early) == before, self.offset_at(late) == after
        early, late = np.where(early_ok, early, late), np.where(late_ok, late, early)
        return np.minimum(early, late), np.maximum(early, late), early_ok | late_ok


_FIXED = re.compile(r"(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?")


@lru_cache(maxsize=1024)
def zone(name: str | None) -> Zone | None:
    """None for a name that is no zone."""
    text = (name or "UTC").strip()
    if text.upper() in ("UTC", "GMT", "Z"):
        return Zone([], [0], {text.upper(): 0})
    if m := _FIXED.fullmatch(text.upper()):
        return Zone([], [(-1 if m[1] == "-" else 1) * (int(m[2]) * 3600 + int(m[3] or 0) * 60)], {})
    from zoneinfo import ZoneInfo

    try:
        tz = ZoneInfo(text)
    except Exception:  # unknown, malformed or forbidden names raise different errors
        return None

    def at(utc: int) -> tuple[int, str]:
        local = datetime.fromtimestamp(utc, timezone.utc).astimezone(tz)
        return int(local.utcoffset().total_seconds()), local.tzname() or ""

    start, end, step = 915_148_800, 4_133_980_800, 4 * DAY
    state = at(start)
    changes, offsets, names = [], [state[0]], {state[1].upper(): state[0]}
    for t in range(start + step, end, step):
        if (new := at(t)) == state:
            continue
        low, high = t - step, t
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if at(middle) == state else (low, middle)
        changes.append(high)
        offsets.append(new[0])
        names[new[1].upper()] = new[0]
        state = new
    return Zone(changes, offsets, {n: o for n, o in names.items() if n.isalpha()})


def _printed_offset(mark: str, own: Zone | None) -> int | None:
    """Seconds east of UTC of a printed offset or abbreviation, None if it is neither the zone's own nor UTC."""
    if mark in "Zz" or mark.upper() == "UTC":
        return 0
    if mark[0] in "+-":
        digits = mark[1:].replace(":", "")
        hours, minutes = int(digits[:2]), int(digits[2:] or 0)
        if hours > 23 or minutes > 59:
            return None
        return (-1 if mark[0] == "-" else 1) * (hours * 3600 + minutes * 60)
    return own.names.get(mark.upper()) if own else None


# --- texts to instants, a batch at a time ---------------------------------------------------------

def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days from 1970-01-01 in the Gregorian calendar."""
    y = y - (m <= 2)
    era = np.floor_divide(y, 400)
    of_era = y - era * 400
    of_year = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146_097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year - 719_468


_LENGTHS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _real_date(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    most = _LENGTHS[np.clip(m, 0, 12)] + (leap & (m == 2))
    return (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= most)


def _ints(column: pa.Array) -> np.ndarray:
    filled = pc.if_else(pc.fill_null(pc.equal(column, ""), True), "0", column)
    return pc.cast(filled, pa.int64()).to_numpy(zero_copy_only=False)


def _micros(fraction: pa.Array) -> np.ndarray:
    """The first six digits of a fraction."""
    six = pc.utf8_slice_codeunits(pc.fill_null(fraction, ""), 0, 6)
    return _ints(pc.utf8_rpad(six, 6, "0"))


def _year_of(seconds: np.ndarray) -> np.ndarray:
    return seconds.astype("datetime64[s]").astype("datetime64[Y]").astype(np.int64) + 1970


class Candidates:
    """Interpretations of a batch's texts: the row, the instant in microseconds, the formats that give it, the prior."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, rows: np.ndarray, us: np.ndarray, formats: int, prior: np.ndarray | bool = True) -> None:
        within = (us >= FROM_S * 1_000_000) & (us < TO_S * 1_000_000)
        priors = np.broadcast_to(np.asarray(prior, bool), rows.shape)
        self.parts.append((rows[within], us[within], np.full(int(within.sum()), formats, np.int64), priors[within]))

    def merged(self, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Candidates of the allowed formats by row, the later instant first; equal instants of a row are one."""
        rows, us, formats, prior = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 4
        formats = formats & allowed[rows]
        keep = formats != 0
        rows, us, formats, prior = rows[keep], us[keep], formats[keep], prior[keep].astype(np.int64)
        order = np.lexsort((-us, rows))
        rows, us, formats, prior = rows[order], us[order], formats[order], prior[order]
        if not len(rows):
            return rows, us, formats, prior
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (us[1:] != us[:-1])]))
        return rows[first], us[first], np.bitwise_or.reduceat(formats, first), np.maximum.reduceat(prior, first)


def _calendar(kind: str, texts: pa.Array, received: np.ndarray, known: np.ndarray, zones: np.ndarray, pool: list[str | None], rules: Rules, out: Candidates) -> None:
    """The candidates of the texts that the pattern reads."""
    found = pc.extract_regex(texts, _PATTERNS[kind])
    rows = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
    if not len(rows):
        return
    part = dict(zip([f.name for f in found.type], found.take(pa.array(rows)).flatten()))
    h, mi, s = (_ints(part[k]) for k in ("h", "mi", "s"))
    y, us = _ints(part["y"]), _micros(part["f"])
    good = (h <= 23) & (mi <= 59) & (s <= 60)
    clock_us = (h * 3600 + mi * 60 + np.minimum(s, 59)) * 1_000_000 + us
    marks = np.array(part["z"].to_pylist(), dtype=object)
    place = lambda year, mo, d, formats, ok: _placed(rows, year, mo, d, clock_us, good & ok, marks, received, known, zones, pool, rules, formats, out)
    every = np.ones(len(rows), bool)
    if kind == "parted":
        a, b = _ints(part["a"]), _ints(part["b"])
        place(y, b, a, _DAY_FIRST, every)
        place(y, a, b, _MONTH_FIRST, every)
        return
    d = _ints(part["d"])
    if kind != "bsd":
        place(y, _ints(part["mo"]), d, _BITS[kind], every)
        return
    index = pc.index_in(pc.utf8_lower(part["mo"]), pa.array(MONTHS))
    mo = pc.fill_null(index, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    open_ = pc.equal(part["y"], "").to_numpy(zero_copy_only=False) & good & (mo > 0)
    limit_ns = received[rows] + DAY * 1_000_000_000
    latest = _year_of(np.where(known[rows], limit_ns, 0) // 1_000_000_000)
    y, undecided = np.where(open_, 0, y), open_ & known[rows]
    for back in range(9):
        year = latest - back
        at_us = _days(year, mo, d) * DAY * 1_000_000 + clock_us
        fits = undecided & _real_date(year, mo, d) & (at_us * 1000 <= limit_ns)
        y = np.where(fits, year, y)
        undecided &= ~fits
    place(y, mo, d, _BITS[kind], every)
    if not rules.year:
        before = np.where(open_ & (y > 0), y - 1, 0)
        place(before, mo, d, _BITS[kind], before > 0)


def _placed(rows, y, mo, d, clock_us, good, marks, received, known, zones, pool, rules: Rules, formats: int, out: Candidates) -> None:
    """Candidates of local dates and times of day: by the printed zone, or the clock's, in both instants where it doubles."""
    good = good & _real_date(y, mo, d)
    local = _days(np.where(good, y, 1970), np.where(good, mo, 1), np.where(good, d, 1)) * DAY + clock_us // 1_000_000
    first, second = np.zeros_like(local), np.zeros_like(local)
    own = zones[rows]
    printed = marks != ""
    unzoned = good & ~printed
    for code in np.unique(own):
        z = zone(pool[code])
        mine = own == code
        plain = mine & ~printed
        if z is None:
            good &= ~plain
        elif plain.any():
            early, late, exists = z.instants(local[plain])
            first[plain], second[plain] = early, late
            good[plain] &= exists
        for mark in set(marks[mine & printed]):
            these = mine & (marks == mark)
            shift = _printed_offset(mark, z)
            if shift is None:
                good &= ~these
            else:
                first[these] = second[these] = local[these] - shift
    rest = clock_us % 1_000_000
    early, late = first * 1_000_000 + rest, second * 1_000_000 + rest
    after = known[rows] & (late * 1000 > received[rows])
    twice = good & (early != late)
    out.add(rows[good], late[good], formats, (~after | ~twice | (not rules.fold))[good])
    out.add(rows[twice], early[twice], formats, (after | (not rules.fold))[twice])
    if not rules.zone:
        out.add(rows[unzoned], (local * 1_000_000 + rest)[unzoned], formats)


def _shifted(whole: str, fraction: str, exponent: str) -> int | None:
    """Microseconds of a number with an exponent, cut; None beyond the last instant. Digits are moved, however many."""
    power = exponent.lstrip("+-").lstrip("0") or "0"
    if len(power) > 18:  # more than a text has digits: nothing, or beyond
        return None
    shift = (-int(power) if exponent[0] == "-" else int(power)) + {13: -3, 16: -6, 19: -9}.get(len(whole), 0) + 6
    digits = (whole + fraction).lstrip("0")
    point = len(digits) - len(fraction) + shift
    if point > 16:
        return None
    value = int(digits[:point].ljust(point, "0")) if digits and point > 0 else 0
    return value if value < TO_S * 1_000_000 else None


def _numbers(texts: pa.Array, rules: Rules, out: Candidates) -> None:
    found = pc.extract_regex(texts, _NUMBER)
    rows = np.flatnonzero(pc.is_valid(found).to_numpy(zero_copy_only=False))
    if len(rows):
        whole, fraction = found.take(pa.array(rows)).flatten()
        width = pc.utf8_length(whole).to_numpy(zero_copy_only=False)
        for digits, shift in ((10, 0), (13, 3), (16, 6), (19, 9)):
            mine = np.flatnonzero((width == digits) if rules.digits else (width >= shift + 9) & (width <= shift + 10))
            if not len(mine):
                continue
            at = pa.array(mine)
            number, part = whole.take(at), fraction.take(at)
            # the seconds of a whole; what is behind them, and the fraction, follow the point
            if shift:
                seconds, rest = pc.utf8_slice_codeunits(number, 0, -shift), pc.utf8_slice_codeunits(number, -shift)
                part = pc.binary_join_element_wise(rest, part, "")
            else:
                seconds = number
            out.add(rows[mine], _ints(seconds) * 1_000_000 + _micros(part), _BITS["number"])
    more, values = [], []
    for i in np.flatnonzero(pc.match_substring_regex(texts, "^[0-9.,]+[eE]").fill_null(False).to_numpy(zero_copy_only=False)):
        if (m := _EXPONENT.fullmatch(texts[i].as_py())) and (value := _shifted(m[1], m[2] or "", m[3])) is not None:
            more.append(i)
            values.append(value)
    out.add(np.array(more, np.int64), np.array(values, np.int64), _BITS["number"])


def delay_class(delay_us: np.ndarray) -> np.ndarray:
    ms = np.abs(delay_us) // 1000
    power = np.minimum(np.where(ms > 0, np.floor(np.log2(np.maximum(ms, 1))) + 1, 0), 39).astype(np.int64)
    return 1 + np.where(delay_us < 0, 40, 0) + power


def interpret(texts: pa.Array, received: pa.Array, zone_names: pa.Array, allowed: np.ndarray, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """The candidates of all texts: row, instant (us), and a code of formats, delay class and prior."""
    texts = pc.utf8_trim_whitespace(pc.fill_null(texts, ""))
    known = pc.is_valid(received).to_numpy(zero_copy_only=False)
    got = pc.fill_null(received, 0).to_numpy(zero_copy_only=False)
    coded = zone_names.dictionary_encode()
    pool = [*coded.dictionary.to_pylist(), None]
    codes = pc.fill_null(coded.indices, len(pool) - 1).to_numpy(zero_copy_only=False)
    out = Candidates()
    for kind in _PATTERNS:
        _calendar(kind, texts, got, known, codes, pool, rules, out)
    _numbers(texts, rules, out)
    rows, us, formats, prior = out.merged(allowed)
    delay = np.where(known[rows], delay_class(got[rows] // 1000 - us), 0)
    return {"row": rows, "us": us, "code": formats | (delay << 8) | (prior << 15)}


def _allowed(formats: list[list[str] | None]) -> np.ndarray:
    return np.array([sum(1 << FORMATS.index(f) for f in set(x) if f in FORMATS) if x else 0b11111111 for x in formats], np.int64)


def parsed(readings: DataFrame, clocks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """reading_id, clock_id, codes, instants: each reading with its candidates. The clocks join by what Spark finds their
    size to be."""
    known = clocks.select("clock_id", "formats", "zone_name").dropDuplicates(["clock_id"])
    rows = readings.select("reading_id", "clock_id", "original_time", "received_ns").join(known, "clock_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = interpret(
                b.column("original_time").cast(pa.string()), b.column("received_ns"), b.column("zone_name").cast(pa.string()),
                _allowed(b.column("formats").to_pylist()), rules,
            )
            starts = pa.array(np.searchsorted(got["row"], np.arange(b.num_rows + 1)), pa.int32())
            codes = pa.ListArray.from_arrays(starts, pa.array(got["code"], pa.int32()))
            instants = pa.ListArray.from_arrays(starts, pa.array(got["us"] * 1000, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column("reading_id"), b.column("clock_id"), codes, instants], ["reading_id", "clock_id", "codes", "instants"]
            )

    return rows.select("reading_id", "clock_id", "original_time", "received_ns", "formats", "zone_name").mapInArrow(
        run, "reading_id bigint, clock_id int, codes array<int>, instants array<bigint>"
    )


# --- the mixture of each clock --------------------------------------------------------------------

@dataclass
class Mixture:
    """Weights of the formats and of the delay classes of one clock."""

    weight: np.ndarray
    delay: np.ndarray

    @staticmethod
    def even() -> "Mixture":
        return Mixture(np.full(len(FORMATS), 1 / len(FORMATS)), np.full(DELAYS, 1 / DELAYS))


class Kinds:
    """Readings with the same candidates, flat: the kind each candidate belongs to, its formats, delay class and prior."""

    def __init__(self, codes: list):
        sizes = np.array([len(c) for c in codes], np.int64)
        self.count, self.kind = len(codes), np.repeat(np.arange(len(codes)), sizes)
        self.starts = np.cumsum(sizes) - sizes
        flat = np.concatenate([np.asarray(c, np.int64) for c in codes]) if len(codes) else np.zeros(0, np.int64)
        self.valid = ((flat[:, None] >> np.arange(len(FORMATS))) & 1).astype(float)
        self.delay, self.prior = (flat >> 8) & 127, ((flat >> 15) & 1).astype(float)
        # rules that leave a reading without candidate do not hold for it
        self.prior = np.where(np.bincount(self.kind, self.prior, self.count)[self.kind] > 0, self.prior, 1.0)

    def likelihood(self, m: Mixture) -> np.ndarray:
        return (self.valid * m.weight).sum(1) * m.delay[self.delay]


def fit(kinds: Kinds, n: np.ndarray, mixture: Mixture | None = None) -> Mixture:
    """EM over counts. Expectation: a reading is shared among its candidates by likelihood and prior, and a candidate
    among its formats. Maximisation: formats and delays are weighted by what they got."""
    m, before = mixture or Mixture.even(), -np.inf
    for _ in range(ROUNDS):
        joint = kinds.likelihood(m) * kinds.prior
        whole = np.bincount(kinds.kind, joint, kinds.count)
        now = float((n * np.log(np.maximum(whole, 1e-300))).sum())
        share = n[kinds.kind] * joint / np.maximum(whole[kinds.kind], 1e-300)
        by_format = kinds.valid * m.weight
        by_format *= (share / np.maximum(by_format.sum(1), 1e-300))[:, None]
        weight, delay = by_format.sum(0) + 1e-6, np.bincount(kinds.delay, share, DELAYS) + 1e-3
        m = Mixture(weight / weight.sum(), delay / delay.sum())
        if now - before < TOLERANCE * max(1.0, abs(now)):
            break
        before = now
    return m


_CHOSEN = "clock_id int, codes array<int>, pick int, other int, posterior double, format string, format_posterior double"


def choices(kinds: Kinds, m: Mixture) -> dict[str, list]:
    """For each kind of reading the candidate of highest posterior, the next best by likelihood, and how sure it is."""
    likelihood = kinds.likelihood(m)
    joint = likelihood * kinds.prior
    by_format = kinds.valid * m.weight
    out: dict[str, list] = {"pick": [], "other": [], "posterior": [], "format": [], "format_posterior": []}
    ends = np.append(kinds.starts[1:], len(kinds.kind))
    for a, z in zip(kinds.starts.tolist(), ends.tolist()):
        pick = a + int(joint[a:z].argmax())
        rest = np.delete(np.arange(a, z), pick - a)
        total, formats = likelihood[a:z].sum(), by_format[pick]
        out["pick"].append(pick - a)
        out["other"].append(int(rest[likelihood[rest].argmax()]) - a if len(rest) else None)
        out["posterior"].append(float(likelihood[pick] / total) if total > 0 else 1 / (z - a))
        out["format"].append(FORMATS[int(formats.argmax())])
        out["format_posterior"].append(float(formats.max() / formats.sum()))
    return out


def chosen(readings: DataFrame, fitting=fit) -> DataFrame:
    """For each clock and kind of reading what its mixture chooses. A clock's group has one row for each kind of
    reading, combinations of a few formats and delay classes, however many readings it has."""
    counts = readings.where("size(codes) > 0").groupBy("clock_id", "codes").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = Kinds(pdf.codes.tolist())
        got = choices(kinds, fitting(kinds, pdf.n.to_numpy(float)))
        return pd.DataFrame({"clock_id": pdf.clock_id, "codes": pdf.codes, **got}).astype({"pick": "Int32", "other": "Int32"})

    return counts.groupBy("clock_id").applyInPandas(run, _CHOSEN)


def normalized(readings: DataFrame, clocks: DataFrame, rules: Rules = Rules(), fitting=fit) -> DataFrame:
    """reading_id, clock_id, event_ns, format, posterior, status (resolved, ambiguous, no_time), other_ns, format_posterior.

    event_ns is the candidate of highest posterior under the mixture of the reading's clock; posterior is its part of the
    likelihood of all candidates, those that a rule excludes among them."""
    rows = materialize(parsed(readings, clocks, rules), "clock-readings")
    told = chosen(rows, fitting).withColumnsRenamed({"clock_id": "c", "codes": "k"})
    joined = rows.join(told, F.col("clock_id").eqNullSafe(F.col("c")) & (F.col("codes") == F.col("k")), "left")
    return joined.select(
        "reading_id", "clock_id", F.get("instants", F.col("pick")).alias("event_ns"), "format", "posterior",
        F.when(F.col("pick").isNull(), "no_time").when(F.col("posterior") < SURE, "ambiguous").otherwise("resolved").alias("status"),
        F.get("instants", F.col("other")).alias("other_ns"), "format_posterior",
    )
