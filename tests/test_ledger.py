import pytest
from pyspark.sql import functions as F

from logloom.operators import archive
from logloom.plans.grammar import Library

ENV = "struct<channel:tinyint,peer:string,listener:string,received_ns:bigint,truncated:boolean>"


def deliveries(spark, payloads, start=0):
    rows = [(bytearray(p), (1, "p", "l", start + i, False), start + i) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, f"payload binary, env {ENV}, ord bigint")


def test_appends_go_on_where_the_last_one_ended(spark, tmp_path):
    ledger = archive.Ledger(spark, f"file://{tmp_path}/a", budget=6)
    for n, payloads in enumerate([[b"aa", b"bb", b"cc", b"dd"], [b"bb", b"ee", b"ff"], [], [b"gg", b"aa", b"aa"]]):
        ledger.append(deliveries(spark, payloads, n * 10))
    rows = ledger.records().orderBy("seq").collect()
    assert [(bytes(r.payload), r.seq, r.seen) for r in rows] == [(b"aa", 0, 3), (b"bb", 1, 2), (b"cc", 2, 1), (b"dd", 3, 1), (b"ee", 4, 1), (b"ff", 5, 1), (b"gg", 6, 1)]
    assert [r.stratum for r in rows] == [0, 0, 0, 1, 2, 2, 3]
    assert archive.faults(ledger.records(), ledger.segments()).count() == 0
    chain = ledger.segments().orderBy("stratum").collect()
    assert [bytes(b.prev_root) for b in chain] == [bytes(32), *(bytes(a.root) for a in chain[:-1])]
    moved = ledger.records().withColumn("seq", F.when(F.col("seq") == 4, 9).otherwise(F.col("seq")))
    assert {(r.stratum, r.kind) for r in archive.faults(moved, ledger.segments()).collect()} == {(2, "root_mismatch")}
    assert archive.faults(moved, ledger.segments(), sample=4).count() == 0 and archive.faults(moved, ledger.segments(), sample=5).count() == 1


def test_an_append_is_done_once_and_by_one_writer(spark, tmp_path):
    ledger = archive.Ledger(spark, f"file://{tmp_path}/a")
    ledger.append(deliveries(spark, [b"x"]), 7)
    ledger.append(deliveries(spark, [b"x", b"y"]), 7)
    assert ledger.records().count() == 1 and ledger.parts() == [7]
    (tmp_path / "a" / "_writer").touch()
    with pytest.raises(archive.Busy):
        ledger.append(deliveries(spark, [b"z"]))
    (tmp_path / "a" / "_writer").unlink()
    (tmp_path / "a" / "segments" / "part=7" / "_SUCCESS").unlink()  # an append that did not come to its end
    assert ledger.records().count() == 0
    assert ledger.append(deliveries(spark, [b"q"]), 7).count() == 1 and ledger.records().count() == 1


def test_rewind_reports(spark):
    lines = [b"1772627811.611 5 10.0.0.1 TCP_HIT/200 7 GET http://x/%d - h t" % k for k in range(5)] + [b"nothing known here at all"]
    rows = archive.stored(deliveries(spark, lines))
    served = []
    got = archive.Rewind.run(rows, Library(), generation=2, sinks=[served.append])
    assert (got.records, got.remapped, got.still_rejected, got.by_grammar, served) == (6, 5, 1, {"squid.access": 5}, [])
    assert len(got.sample) == 5 and archive.Rewind.run(rows, Library(), limit=2, sinks=[served.append], dry_run=False).records == 2 and len(served) == 1
