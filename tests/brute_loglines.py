"""Assembly of log entries in one pass over all lines, headers told by one plain pattern a layout."""

import json
import re
from datetime import datetime, timezone

TS = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d[.,]\d+(?:Z|[+-]\d\d:\d\d)?"
PLAIN = [
    re.compile(rf"(?P<t>{TS}) (?P<l>\w+) \[(?P<c>\S+)\] (?P<m>.*)", re.S),
    re.compile(rf"<(?P<p>\d+)>1 (?P<t>{TS}) \S+ (?P<c>\S+) \S+ \S+ - (?P<m>.*)", re.S),
    re.compile(r"\[(?P<t>\d\d/\w{3}/\d{4}:\d\d:\d\d:\d\d [+-]\d{4})\] \[(?P<l>\w+)\] (?P<c>\S+): (?P<m>.*)", re.S),
    re.compile(rf"(?P<t>{TS}) \| (?P<l>\w+) *\| (?P<c>\S+) \| (?P<m>.*)", re.S),
    re.compile(r"(?P<t>\d{10}\.\d{3}) \[\d+\] (?P<c>\S+) (?P<l>\w+): (?P<m>.*)", re.S),
    re.compile(r'ts=(?P<t>\S+) level=(?P<l>\S+) component=(?P<c>\S+) msg=(?P<q>".*")', re.S),
]
GROUPS = {"DEBUG": "trace debug dbg d", "INFO": "info information notice i", "WARN": "warn warning wrn w",
          "ERROR": "err error severe e", "FATAL": "fatal critical crit emerg f"}
LEVEL = {w: k for k, ws in GROUPS.items() for w in ws.split()}
BY_NUMBER = "FATAL FATAL FATAL ERROR WARN INFO INFO DEBUG".split()


def ns(t):
    if isinstance(t, int):
        return t * 10**6
    if re.fullmatch(r"\d{10}\.\d{3}", t):
        return int(t.replace(".", "")) * 10**6
    if t[2] == "/":
        return int(datetime.strptime(t, "%d/%b/%Y:%H:%M:%S %z").timestamp()) * 10**9
    m = re.fullmatch(r"(.{19})[.,](\d+)(.*)", t)
    d = datetime.fromisoformat(m[1] + (m[3] or "+00:00").replace("Z", "+00:00"))
    return int(d.astimezone(timezone.utc).timestamp()) * 10**9 + int(m[2].ljust(9, "0"))


def head(line):
    if line.startswith("{"):
        try:
            d = json.loads(line)
        except ValueError:
            return None
        t, lv, c = d.get("ts", d.get("time")), d.get("level", d.get("severity")), d.get("logger", d.get("component"))
        return None if None in (t, lv, c) else (ns(t), LEVEL[lv.lower()], c, d.get("msg", d.get("message", "")))
    for p in PLAIN:
        if m := p.fullmatch(line):
            g = m.groupdict()
            level = BY_NUMBER[int(g["p"]) % 8] if "p" in g else LEVEL[g["l"].lower()]
            return ns(g["t"]), level, g["c"], json.loads(g["q"]) if "q" in g else g["m"]
    return None


def assemble(rows):
    """rows: (stream_name, line_no, line_id, payload). -> list of (stream, line_no, ns, level, component, message)."""
    out, at, seen, entry = [], None, set(), None
    for stream, no, _, payload in sorted(rows):
        if stream != at:
            at, entry = stream, None
        if (stream, no) in seen:
            continue
        seen.add((stream, no))
        for line in payload.decode("utf-8", "replace").split("\n"):
            line = line.removesuffix("\r")
            if h := head(line):
                entry = [stream, no, *h]
                out.append(entry)
            elif entry:
                entry[5] += "\n" + line
    return [tuple(e) for e in out]
