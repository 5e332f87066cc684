import json
import random
import re

import pytest
import yaml
from pyspark.sql import functions as F

from logloom.functions import extract, shapes, text
from logloom.functions import sql as S
from logloom.functions.times import clock_time, zone_offset
from logloom.operators import archive, induce, inspect
from logloom.plans import derive
from logloom.plans.grammar import SHIPPED, Grammar, GrammarError, Library
from logloom.sources import lines, sinks
from logloom.sources.tables import table
from logloom.streaming import pipelines


def on_lines(spark, data, e):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, line string")
    return [r.x for r in S.with_columns(df, x=e).orderBy("i").collect()]


def test_split_quoted_against_a_scan(spark):
    def scan(t):
        out, buf, inside = [], "", False
        for c in t:
            if c == '"':
                inside = not inside
            elif c == "," and not inside:
                out.append(buf)
                buf = ""
            else:
                buf += c
        return [*out, buf]

    rng = random.Random(1)
    data = ["".join(rng.choice('ab,," ') for _ in range(rng.randint(0, 20))) for _ in range(400)]
    assert on_lines(spark, data, extract.split_quoted(S.col("line"), ",")) == [scan(t) for t in data]


def test_a_mark_in_a_line_forges_no_group(spark):
    mark = text.MARK
    data = [f"zz{mark}evil{mark}", f"abc7{mark}", f"x{mark}abc7", "abc8"]
    assert on_lines(spark, data, text.captured(S.col("line"), r"abc(\d)", [1])) == [None, ["7"], ["7"], ["8"]]
    assert on_lines(spark, [f'a{mark}b,"c,{mark}d"'], extract.split_quoted(S.col("line"), ",")) == [["a\ufffdb", "c,\ufffdd"]]


def test_kv_against_a_pattern(spark):
    rng = random.Random(2)
    data = ["".join(rng.choice(['a=', 'b1=', '"', ' ', 'x', 'y z', '=', '|']) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    pattern = re.compile(r'([A-Za-z_][A-Za-z0-9_.\-]*)=(?:"([^"]*)"|(\S*))')
    want = [{m[1]: m[2] if m[2] is not None else m[3] for m in pattern.finditer(t)} for t in data]
    got = on_lines(spark, data, extract.kv(extract.begin(S.col("line")), None, False))
    assert [g["f"] if g["e"] is None else {} for g in got] == want


def test_shapes(spark):
    data = {"": "unknown", '{"a": 1}': "json", "<13>CEF:0|a|b|c|d|e|f|x=1": "cef", "LEEF:2.0|a|b|c|d|": "leef", "a=1 b=2 c=3 d=4": "kv",
            "1,2,3,4,5,6,7,8,9": "csv", "1\t2\t3\t4\t5": "delimited", "1772.1 20 10.0.0.1 TCP/200 5": "delimited", "the quick brown fox jumps over": "freeform",
            "<12345>x": "freeform"}
    assert on_lines(spark, list(data), shapes.classified(S.col("line"), shapes.counts(S.col("line")))) == list(data.values())


def test_clock_edges(spark):
    at = lambda t, formats, zone="UTC": on_lines(spark, [t], clock_time(S.col("line"), formats, zone, S.lit(1_767_312_000_000_000_000)))[0]
    assert at("2026-08-21T14:32:60.1239999Z junk", ["iso8601"]) == 1_787_322_779_123_999_000
    assert at("2026-08-21 14:32:07", ["dashed"], "+05:30") == 1_787_302_927_000_000_000
    assert at("Dec 31 23:00:00", ["bsd"]) == 1_767_222_000_000_000_000 and at("Aug 5 10:00:00", ["bsd"]) is None
    assert at("1787358200.901", ["epoch"]) == int(1787358200.901 * 1e9) and at("nan", ["epoch"]) is None and at("1e300", ["epoch"]) is None
    assert at("2026-02-31T10:00:00", ["iso8601"]) is None
    assert zone_offset("UTC-03:00") == -10800
    with pytest.raises(ValueError):
        zone_offset("Asia/Kolkata")


BASE = yaml.safe_load((SHIPPED / "squid.access.yaml").read_text())


@pytest.mark.parametrize("change", [
    {"fileds": {}}, {"id": "Bad"}, {"version": "1"}, {"signature": {"weight": 0.5}}, {"signature": {"pattern": "("}}, {"pipeline": []},
    {"pipeline": [{"exec": "rm"}]}, {"pipeline": [{"kv": True, "json": True}]}, {"pipeline": [{"kv": True, "pair_sep": "||"}]},
    {"clock": {"field": "x", "formats": ["epoch"], "zone": "Asia/Kolkata"}}, {"family": "prose"}, {"coerce": {"a": "date"}},
])
def test_wrong_grammars_are_refused(change):
    with pytest.raises(GrammarError):
        Grammar.read(BASE | change)


def test_library_reports_and_publishes(tmp_path):
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(BASE))
    (tmp_path / "b.yaml").write_text("x: [")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(BASE))
    library = Library(tmp_path)
    assert list(library.grammars) == ["squid.access"] and set(library.errors) == {"b.yaml", "c.yaml"}
    with pytest.raises(GrammarError):
        library.publish(BASE, "z")  # a second grammar of the same id: taken back
    assert not (tmp_path / "z.yaml").exists()
    library.publish(BASE | {"id": "squid.other"})
    assert "squid.other" in library.grammars and not library.refresh()


ENV = "struct<channel:tinyint,peer:string,listener:string,received_ns:bigint,truncated:boolean>"


def records(spark, payloads, received=1_780_000_000_000_000_000):
    df = spark.createDataFrame([(bytearray(p) if p is not None else None, (1, "p", "l", received, False), i) for i, p in enumerate(payloads)], f"payload binary, env {ENV}, seq bigint")
    return archive.identified(df).withColumn("stratum", F.lit(1))


def test_every_verdict(spark):
    twin = Grammar.read(BASE | {"id": "squid.twin", "signature": {"pattern": "TCP_MISS", "weight": 0.9}})
    rows = records(spark, [
        b"", None, b"hello there my dear old friends", b"1772627811.611 5 10.0.0.1 TCP_HIT/200 7 GET http://x/1 - h t",
        b"1772627811.611 5 10.0.0.1 TCP_MISS/200 7 GET http://x/1 - h t", b'{"event_type": "alert", "a" 1 }', b"9 5 10.0.0.1 TCP_HIT/200 7 GET http://x/1 - h t", b"\xff\xfe\x00{",
    ])
    derived = derive.derive(rows, [*Library().all(), twin], processed_ms=0).cache()
    got = [(r.verdict, r.detail) for r in rows.select(F.lower(F.hex("id")).alias("record_id"), "seq").join(derived, "record_id").dropDuplicates(["seq"]).orderBy("seq").collect()]
    assert got[0] == got[1] == ("unclaimed", "empty line") and got[2] == ("unclaimed", "no grammar claims a freeform line")
    assert got[3] == ("mapped", None) and got[4] == ("ambiguous", "confidence 0.517 below floor 0.7; runner-up squid.twin")
    assert got[5] == ("extract_failed", "invalid JSON") and got[6][0] == "invalid" and got[7][0] == "unclaimed"


def test_residue_coverage_and_fallback(spark):
    line = rb"CEF:0|Imperva|SecureSphere|14|id|Attack|9|src=10.0.0.1 spt=443 act=block msg=Multi Word Value odd=a\=b"
    r = derive.derive(records(spark, [line]), Library(), processed_ms=0).first()
    doc, rest = json.loads(r.ocsf), json.loads(r.unmapped)
    assert r.vendor == "Imperva" and doc["metadata"]["time_source"] == "receipt_fallback" and doc["time"] == 1_780_000_000_000
    assert doc["src_endpoint"] == {"ip": "10.0.0.1", "port": 443} and "dst_endpoint" not in doc and doc["disposition_orig"] == "block"
    assert rest == {"cef_version": "0", "msg": "Multi Word Value", "odd": "a=b"} and r.disposition_id == 2 and r.severity_id == 5


def test_archive_tree_proof_and_tampering(spark, small):
    rows = table(spark, small, "records")
    sealed = archive.sealed(rows).cache()
    ids = [bytes(r.id) for r in rows.orderBy("stratum", "seq").collect()]
    level = [archive.leaf_hash(i) for i in ids]
    while len(level) > 1:
        level = [archive.node_hash(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert bytes(sealed.first().root) == level[0]
    proof = archive.prove(rows, ids[-1])
    assert archive.verify(ids[-1], proof.path, level[0]) and not archive.verify(ids[0], proof.path, level[0])
    assert archive.decoded_path(proof.encoded()) == list(proof.path) and archive.prove(rows, b"x" * 32) is None
    with pytest.raises(ValueError):
        archive.decoded_path(["Q:00"])
    edited = rows.withColumn("payload", F.when(F.col("seq") == rows.agg(F.min("seq")).first()[0], F.lit(b"x")).otherwise(F.col("payload")))
    assert [r.kind for r in archive.faults(edited, sealed).collect()] == ["content_mismatch"]
    assert {r.kind for r in archive.faults(rows.where("seq % 7 <> 0"), sealed).collect()} == {"root_mismatch"}
    assert [r.kind for r in archive.faults(rows, sealed.withColumn("prev_root", F.lit(b"y" * 32))).collect()] == ["chain_break"]


def test_storing_again_adds_nothing(spark):
    first = archive.stored(records(spark, [b"a", b"b", b"a", b"\xff\x00"]).select("payload", "env", F.col("seq").alias("ord"))).cache()
    assert sorted((bytes(r.payload), r.seen) for r in first.collect()) == [(b"a", 2), (b"b", 1), (b"\xff\x00", 1)]
    again = records(spark, [b"b", b"c"]).select("payload", "env", F.col("seq").alias("ord"))
    assert [bytes(r.payload) for r in archive.stored(again, first).collect()] == [b"c"]
    assert {bytes(r.payload): r.seen for r in archive.seen_again(first, again).collect()}[b"b"] == 2


def test_line_reader_keeps_bytes(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"one\ntwo\xff\xfe\r\r\n\nlast\rline")
    got = [bytes(r.payload) for r in lines.files(spark, str(tmp_path)).collect()]
    assert got == [b"one", b"two\xff\xfe", b"last\rline"]
    rows = lines.enveloped(lines.files(spark, str(tmp_path)), "syslog_udp", "p")
    assert lines.admitted(rows, ["q"]).where("refused = 'unknown_source'").count() == 3


def test_spans_do_not_overlap():
    assert inspect.locate("a=1 b=1 c=11", [("a", "1"), ("b", "1"), ("c", "11"), ("d", "zz")]) == [("a", "1", 2, 3), ("b", "1", 6, 7), ("c", "11", 10, 12)]


def test_unseen_format_is_onboarded(spark):
    payloads = [f"[2026-03-0{i % 9 + 1}T10:00:00Z] session=77{i} client_addr=10.0.0.{i} verdict=PERMIT octets_tx={i * 3} rule=r{i % 4}".encode() for i in range(40)]
    rows = records(spark, payloads)
    assert derive.derive(rows, Library(), processed_ms=0).where("verdict = 'mapped'").count() == 0
    proposal = induce.proposed(rows.select(F.col("seq").alias("ord"), "payload"), "site.meridian")
    assert proposal["family"] == "kv" and proposal["emit"]["fields"]["src_endpoint.ip"] == "client_addr"
    again = derive.derive(rows, [*Library().all(), Grammar.read(proposal)], processed_ms=0)
    assert again.groupBy("verdict").count().collect() == [("mapped", 40)]


def test_sinks(spark, small, tmp_path):
    derived = derive.derive(table(spark, small, "records"), Library(), processed_ms=0)
    events = derive.events(derived)
    n = events.count()
    sinks.write_lake(events, str(tmp_path / "lake"))
    back = sinks.register(spark.read.parquet(str(tmp_path / "lake")))
    assert back.count() == n and spark.sql("SELECT sum(n) FROM (SELECT vendor, count(*) AS n FROM events GROUP BY 1)").first()[0] == n
    sinks.write_ndjson(derived, str(tmp_path / "nd"))
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "nd")).collect()]
    assert len(docs) == n and all({"unmapped", "custody", "time"} <= d.keys() for d in docs)
    assert sinks.cef_lines(events).where("value NOT LIKE 'CEF:0|%'").count() == 0
    assert n + derive.rejections(derived).count() == table(spark, small, "records").count()
    assert sinks.recent(events, 5).count() == 5


def test_stream_equals_batch(spark, small, tmp_path):
    rows = table(spark, small, "records").select("payload", "env")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    seen = []

    def broken(df, n):
        if n == 0 and "once" not in seen:
            seen.append("once")
            raise RuntimeError("sink is down")

    def take(df, n):
        derive.events(df).select("record_id", "src_ip").write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}"))

    start = lambda: pipelines.serve(stream, Library(), {"broken": broken, "take": take}, str(tmp_path / "cp"), str(tmp_path / "arch"))
    with pytest.raises(Exception, match="sink is down"):
        start().awaitTermination()
    start().awaitTermination()
    ledger = archive.Ledger(spark, str(tmp_path / "arch"))
    assert archive.faults(ledger.records(), ledger.segments()).count() == 0 and ledger.records().agg(F.sum("seen")).first()[0] == rows.count()
    # known bytes add to `seen` alone, so a record is derived once
    batch = derive.events(derive.derive(table(spark, small, "records").dropDuplicates(["id"]), Library(), processed_ms=0))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select("record_id", "src_ip").fillna("").collect())) == sorted(map(tuple, batch.select("record_id", "src_ip").fillna("").collect()))


def test_stream_of_hours(spark, tmp_path):
    hour = 3_600_000_000_000
    rows = spark.createDataFrame([(k * 60_000_000_000, k * 60_000_000_000 + (9 * hour if k % 5 == 0 else 0)) for k in range(120)], "event_ns bigint, arrival_ns bigint")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pipelines.hourly(stream, expire=False).writeStream.format("memory").queryName("hourly").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT hour_ns, sum(after - before) AS n, sum(too_late) AS l FROM hourly GROUP BY hour_ns ORDER BY 1").collect()
    assert [(r.n, r.l) for r in got] == [(48, 12), (48, 12)]
