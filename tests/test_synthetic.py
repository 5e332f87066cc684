from pyspark.sql import functions as F

from logloom.plans import derive
from logloom.plans.grammar import Library
from logloom.sources import lines, synthetic

FIELDS = ("src_ip", "src_port", "dst_ip", "dst_port", "disposition_id")


def test_fields_are_read_as_they_were_written(spark):
    made = synthetic.corpus(spark, 3000, seed=11)
    rows = lines.enveloped(made, received_ns=1_790_000_000_000_000_000).select(F.col("n").cast("string").cast("binary").alias("id"), "payload", "env", F.lit(0).alias("stratum"))
    got = {int(bytes.fromhex(r.record_id)): r for r in derive.derive(rows, Library(), processed_ms=0).collect()}
    truth = made.collect()
    assert len({t.source for t in truth}) == len(synthetic.SOURCES) and len(got) == 3000
    read = right = 0
    for t in truth:
        r = got[t.n]
        if t.source == "unknown":
            assert r.verdict == "unclaimed", t
        elif t.sound:
            assert r.verdict == "mapped" and r.grammar == t.source, (t, r)
            for name, value in t.truth.items():
                read += 1
                right += str(r[name]) == value
    assert right == read > 10_000
    assert 0.95 < sum(r.verdict == "mapped" for r in got.values()) / 3000 < 1


def test_the_corpus_is_the_same_for_a_seed(spark):
    a, b = (synthetic.corpus(spark, 300, seed=3).repartition(k).orderBy("n").collect() for k in (1, 5))
    assert a == b and a != synthetic.corpus(spark, 300, seed=4).orderBy("n").collect()
    assert synthetic.corpus(spark, 0).count() == 0
