"""Reading of one timestamp text by the stated rules, one value at a time."""

import re
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from zoneinfo import ZoneInfo

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
EPOCH = datetime(1970, 1, 1)


def to_us(dt):
    return (dt - EPOCH) // timedelta(microseconds=1)


def shifted(name):
    m = re.fullmatch(r"([+-])(\d\d):(\d\d)", name)
    return m and timedelta(minutes=(int(m[2]) * 60 + int(m[3])) * (-1 if m[1] == "-" else 1))


def read(text, zone, received_ns):
    t = (text or "").strip()
    if m := re.fullmatch(r"(\d+)(?:[.,](\d+))?(?:[eE]\+?(\d+))?", t):
        scale = {10: 0, 13: 3, 16: 6, 19: 9}.get(len(m[1]))
        if scale is None and m[3] is None:
            return None
        us = int(Decimal(f"{m[1]}.{m[2] or 0}").scaleb(int(m[3] or 0) - (scale or 0) + 6))
        return us * 1000 if 946684800 * 10**6 <= us < 4102444800 * 10**6 else None
    m = re.fullmatch(r"(?:(\d{4})([-/])(\d\d)\2(\d\d)[Tt ]|([A-Za-z]{3}) +(\d{1,2})(?: +(\d{4}))? +)"
                     r"(\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(?: *([Zz]|[+-]\d\d:?\d\d|[A-Za-z]+))?", t)
    if not m:
        return None
    y = int(m[1] or m[7] or 0)
    mo = int(m[3]) if m[3] else MONTHS.index(m[5].lower()) + 1 if m[5].lower() in MONTHS else 0
    d, h, mi, s = int(m[4] or m[6]), int(m[8]), int(m[9]), min(int(m[10]), 59) if int(m[10]) <= 60 else 99
    us = int(((m[11] or "") + "000000")[:6])

    def local(year):
        try:
            return datetime(year, mo, d, h, mi, s, us)
        except ValueError:
            return None

    if y:
        dt = local(y)
    else:
        top = (EPOCH + timedelta(microseconds=received_ns // 1000) + timedelta(days=1)).year
        dt = next((x for k in range(9) if (x := local(top - k)) and to_us(x) * 1000 <= received_ns + 86400 * 10**9), None)
    if dt is None:
        return None
    mark = m[12]
    if mark and (mark in "Zz" or mark.upper() == "UTC"):
        found = [to_us(dt)]
    elif mark and mark[0] in "+-":
        minutes = int(mark[1:3]) * 60 + int(mark[-2:])
        found = [to_us(dt - timedelta(minutes=minutes if mark[0] == "+" else -minutes))]
    elif mark:
        tz, found = ZoneInfo(zone), []
        for month in range(1, 13):
            x = datetime(2026, month, 2, tzinfo=tz)
            if x.tzname() == mark.upper():
                found = [to_us(dt - x.utcoffset())]
    elif zone == "UTC" or shifted(zone):
        found = [to_us(dt - (shifted(zone) or timedelta()))]
    else:
        tz, found = ZoneInfo(zone), []
        for fold in (0, 1):
            utc = dt.replace(tzinfo=tz, fold=fold).astimezone(timezone.utc)
            if utc.astimezone(tz).replace(tzinfo=None) == dt:
                found.append(to_us(utc.replace(tzinfo=None)))
    if not found:
        return None
    us = max(found) if max(found) * 1000 <= received_ns else min(found)
    return us * 1000 if 946684800 * 10**6 <= us < 4102444800 * 10**6 else None
