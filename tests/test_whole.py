"""Queries do the whole job: no prefix, no sample, no chosen listeners, no cut lines."""

import json
import re
from collections import Counter, defaultdict

import __spark_entry__ as entry
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logloom.operators import archive, clocks, induce, late
from logloom.plans import derive
from logloom.plans.grammar import Library
from logloom.sources.tables import table


def test_point_join_sees_every_delivery(spark, small):
    lake = defaultdict(list)
    for r in table(spark, small, "lake").select("record_id", "grammar", "time_ms").collect():
        lake[r.record_id].append((r.grammar, r.time_ms))
    want = Counter((r.seq, *x) for r in table(spark, small, "records").select("seq", "id").collect() for x in lake[bytes(r.id).hex()])
    got = entry.queries()["sql_point_join"](spark, small)
    assert Counter((r.seq, r.grammar, r.time_ms) for r in got.collect()) == want
    assert max(seq for seq, *_ in want) >= 200


def greedy(bodies):
    """(template, count, example) of the lines in order, each compared with every template of its token count."""
    groups = defaultdict(list)
    for body in bodies:
        line = [induce.masked(t) for t in induce.tokens(body)]
        best, score = None, 0.0
        for g in groups[len(line)]:
            same = sum(a in (b, "<*>") for a, b in zip(g[0], line)) / len(line) if line else 0.0
            if same >= 0.55 and same > score:
                best, score = g, same
        if best is None:
            groups[len(line)].append([line, 1, body])
        else:
            best[0] = [a if a == b else "<*>" for a, b in zip(best[0], line)]
            best[1] += 1
    return Counter((" ".join(t), n, e) for found in groups.values() for t, n, e in found)


def test_templates_take_lines_beyond_any_sample(spark):
    body = F.when(F.col("id") < 20_100, F.concat(F.lit("user u"), F.col("id"), F.lit(" logged in"))).otherwise("a template, that comes = last")
    lines = spark.range(20_200).select(F.col("id").alias("ord"), body.alias("body"))
    assert {(r.template, r.n) for r in induce.templates(lines).collect()} == {("user <*> logged in", 20_100), ("a template , that comes = last", 100)}


def test_templates_as_a_plain_greedy_pass(spark, small):
    rows = table(spark, small, "records").select(F.col("seq").alias("ord"), "payload")
    odd = spark.createDataFrame([(-3, "a\u00a0b  c\x1cd"), (-2, "a b <*> d"), (-1, "a b c x"), (-4, ""), (-5, "")], "ord bigint, body string")
    lines = induce.bodies(rows).select("ord", "body").unionByName(odd)
    want = greedy(r.body for r in lines.orderBy("ord").collect())
    assert Counter((r.template, r.n, r.examples[0]) for r in induce.templates(lines).collect()) == want


def test_templates_of_every_listener(spark, small):
    rows = table(spark, small, "records").select(F.col("seq").alias("ord"), "payload", F.col("env.listener").alias("listener"))
    bodies = defaultdict(list)
    for r in induce.bodies(rows, "listener").orderBy("ord").collect():
        bodies[r.listener].append(r.body)
    got = entry.queries()["templates_of_lines"](spark, small)
    assert Counter((r.listener, r.template, r.n, r.examples[0]) for r in got.collect()) == Counter({(k, *x): n for k, v in bodies.items() for x, n in greedy(v).items()})
    assert len(bodies) > 20


def family(line):
    body = re.sub(r"^<[0-9]{1,4}>", "", line)
    bare, commas, equals, pipes = body.strip(), *map(body.count, ",=|")
    words, first = body.count(" ") + 1, body.split()[:16]
    if not bare:
        return "unknown"
    if bare[0] == "{" and bare[-1] == "}":
        return "json"
    if pipes >= 5 and "CEF:" in body:
        return "cef"
    if pipes >= 4 and "LEEF:" in body:
        return "leef"
    if equals >= 4 and equals * 6 >= words:
        return "kv"
    if commas >= 8 and equals < 3:
        return "csv"
    numbered = sum(any(c in "0123456789" for c in w) for w in first)
    few = 5 <= words <= 24 and commas <= 2 and equals <= 1 and len(first) >= 5 and numbered * 2 >= len(first)
    return "delimited" if body.count("\t") >= 4 or few else "freeform"


def test_every_record_has_a_family(spark, small, tmp_path):
    odd = [b"", None, b" \t ", b"<13>", b"{}", b'<13> {"a": 1} ', b"CEF:0|a|b|c|d|", b"LEEF:1|a|b|c|", b"a=1 b=2 c=3 d=4", b"a= b= c= d=" + b" w" * 21,
           b"1,2,3,4,5,6,7,8,9", b"a=1,b=2,c=3,4,5,6,7,8,9", b"a\tb\tc\td\te", b"1 2 3 d e", b"1 2 c d e", b"1 2 3 4", b"\xff\xfe"]
    given = table(spark, small, "records").select("seq", "payload", "env")
    more = spark.createDataFrame([(-1 - i, x if x is None else bytearray(x)) for i, x in enumerate(odd)], "seq bigint, payload binary")
    given.unionByName(more, allowMissingColumns=True).write.parquet(str(tmp_path / "records.parquet"))
    want = {r.seq: family(bytes(r.payload or b"").decode("utf-8", "replace").rstrip("\r\n")) for r in given.select("seq", "payload").collect()}
    want |= {-1 - i: family((x or b"").decode("utf-8", "replace").rstrip("\r\n")) for i, x in enumerate(odd)}
    got = [(r.seq, r.family) for r in entry.queries()["shape_of_vendor_lines"](spark, str(tmp_path)).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert set(want.values()) == {"unknown", "json", "cef", "leef", "kv", "csv", "delimited", "freeform"}


def test_lines_are_read_whole(spark, small):
    """What stands behind 65,535 characters is read as what stands behind a few."""
    kinds = derive.derive(table(spark, small, "records"), Library(), processed_ms=0).where("verdict = 'mapped'")
    ids = {r.grammar: r.id for r in kinds.groupBy("grammar").agg(F.unhex(F.min("record_id")).alias("id")).collect()}
    known = {bytes(r.id): bytes(r.payload) for r in table(spark, small, "records").select("id", "payload").collect()}
    payloads = {}
    for words in (3, 30_000):
        pad = ";".join(f"w{i % 100}" for i in range(words)).encode()
        for grammar, key in ids.items():
            line = known[bytes(key)]
            at = line.index(b"{") + 1 if line.rstrip().endswith(b"}") else None
            payloads[line + b" " + pad + b" ,tail=\"q\",x" if at is None else line[:at] + b'"pad": "' + pad + b'", ' + line[at:]] = (grammar, words)
        payloads[b'devname=fw pad="' + pad + b'" type="traffic" srcip=10.0.0.1 srcport=5 action=accept tail=q'] = ("kv", words)
    rows = spark.createDataFrame([(bytearray(p), (1, "p", "l", 1_780_000_000_000_000_000, False), 1) for p in payloads],
                                 "payload binary, env struct<channel:tinyint,peer:string,listener:string,received_ns:bigint,truncated:boolean>, stratum int")
    rows = archive.identified(rows)
    name = {bytes(r.id).hex(): payloads[bytes(r.payload)] for r in rows.collect()}
    got = {}
    for r in derive.derive(rows, Library(), processed_ms=0).collect():
        rest = sorted(json.loads(r.unmapped)) if r.unmapped else None
        got[name[r.record_id]] = (r.verdict, r.detail, r.grammar, r.time_ms, r.src_ip, r.src_port, r.disposition_id, rest, sorted(r.fields or {}))
    whole = {g for g, words in got if words == 3}
    assert {g: got[g, 30_000] for g in whole} == {g: got[g, 3] for g in whole}
    assert got["kv", 30_000][:3] == ("mapped", None, "fortigate.traffic")
    assert "tail" in got["kv", 30_000][-2] and got["zeek.conn", 30_000][0] == "mapped"


def test_hours_do_not_depend_on_arrow_batches(spark):
    """Three minutes of one shard come in time, and two events late: the group of each round crosses a batch's edge."""
    hour, minute = 400_000 * late.HOUR, late.MINUTE
    early = [(m * 1000 + k, hour + m * minute, hour + m * minute) for m in (0, 16, 32) for k in range(m + 1)]
    behind = [(90_000 + k, hour + k * minute, hour + 2 * late.HOUR) for k in range(40)]
    rows = spark.createDataFrame(early + behind, "k bigint, event_ns bigint, arrival_ns bigint").select(F.col("k").cast("string").cast("binary").alias("id"), "event_ns", "arrival_ns")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    got = []
    try:
        for size in ("10000", "1"):
            spark.conf.set(name, size)
            got.append([tuple(r) for r in late.hours(late.replay(rows)).collect()])
    finally:
        spark.conf.set(name, before)
    assert got[0] == got[1] == [(hour, len(early), len(early) + 40, 1, 0)]


def test_numbers_with_exponents_are_exact_at_any_length():
    us = 1_776_823_773_016_999
    texts = {
        "1.7768237730169999999999999999999999E9": us, "1.776823773016999" + "9" * 200 + "e+9": us, "0." + "0" * 60 + "1776823773016999E70": us,
        "1776823773016999" + "0" * 90 + "E-96": us, "17768237730169999e-7": us, "1776823773016.9999E0": us, "1776823773,0169999e000000": us,
        "1.776823773E" + "0" * 5000 + "9": 1_776_823_773_000_000, "1E" + "9" * 5000: None, "1e-" + "9" * 5000: None, "0e99": None, "1E10": None, "1e3": None,
    }
    n = len(texts)
    got = clocks.interpret(pa.array(list(texts), pa.string()), pa.array([us * 1000] * n, pa.int64()), pa.array(["UTC"] * n, pa.string()), np.array([0b111111] * n, np.int64))
    read = dict(zip(got["row"].tolist(), got["us"].tolist()))
    assert {t: read.get(i) for i, t in enumerate(texts)} == texts
