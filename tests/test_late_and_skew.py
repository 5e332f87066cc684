import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from logloom.operators import late, skew

H, M = late.HOUR, late.MINUTE
ENV = "struct<channel:tinyint,peer:string,listener:string,received_ns:bigint,truncated:boolean>"


def tables(spark, events):
    """events: (number, event_ns, arrival_ns)."""
    ids = {k: bytes([k % 256, k // 256]) * 16 for k, _, _ in events}
    ex = spark.createDataFrame([(ids[k].hex(), 0, e) for k, e, _ in events], "record_id string, generation int, event_ns bigint")
    rec = spark.createDataFrame([(bytearray(ids[k]), (0, "p", "l", a, False)) for k, _, a in events], f"id binary, env {ENV}")
    return ids, ex, rec


def test_hours_are_corrected_and_late_ones_reported(spark):
    base = 400_000 * H
    events = [(k, base + k * 7 * M % (3 * H), base + k * 7 * M % (3 * H) + d) for k, d in enumerate([M, 70 * M, 3 * H, 8 * H, 0, 65 * M] * 60)]
    ids, ex, rec = tables(spark, events)
    revisions = late.judged(ex, rec).cache()
    want, first, final, out = {}, Counter(), Counter(), Counter()
    for k, e, a in events:
        end = e - e % H + H
        hour = e - e % H
        if a >= end + 6 * H:
            want[ids[k].hex()], out[hour] = "too_late", out[hour] + 1
            continue
        final[hour] += 1
        if a >= end + 10 * M:
            want[ids[k].hex()] = "correction"
        else:
            first[hour] += 1
    assert {r.record_id: r.fate for r in late.fates(revisions).collect()} == want
    got = {r.hour_ns: (r.published, r.corrected, r.too_late) for r in late.hours(revisions).collect()}
    assert got == {h: (first[h], final[h], out[h]) for h in {*first, *final, *out}}
    last = late.revisions_of_hours(revisions).groupBy("hour_ns").agg(F.max_by("events", "revised_ns").alias("n"))
    assert {r.hour_ns: r.n for r in last.collect()} == dict(final)


def test_generations_nulls_and_repeats(spark):
    ex = spark.createDataFrame(
        [("00", 0, 5), ("00", 1, None), ("01", 0, 5), ("01", 0, 5), ("02", None, 7), (None, 1, 1), ("zz", 1, 1), ("03", 1, 1)],
        "record_id string, generation int, event_ns bigint",
    )
    rec = spark.createDataFrame([(bytearray([k]), (0, None, None, a, None)) for k, a in [(0, 1), (1, 9), (1, 3), (2, 8), (4, 1)]] + [(None, None)], f"id binary, env {ENV}")
    got = sorted((r.id[0], r.event_ns, r.arrival_ns) for r in late.arrivals(ex, rec).collect())
    assert got == [(1, 5, 3), (2, 7, 8)]
    assert late.judged(ex.limit(0), rec).count() == 0


def test_timeline_replays_only_what_follows_the_checkpoint():
    line = late.Timeline(late.Lateness(), 0)
    assert line.take(np.array([0, 5, 59]), np.array([1, 1, 2])) == 4
    before = line.replayed
    assert line.take(np.array([55]), np.array([1])) == 5 and line.replayed - before == 10
    assert line.snapshots.tolist() == [0, 2, 2, 2, 2, 2]
    again = late.Timeline(late.Lateness(), 0, line.minutes.tolist(), line.snapshots.tolist())
    assert again.total == 5 and again.take(np.array([9]), np.array([1])) == 6
    assert again.restorable(np.array([again.final_ns - 1, again.final_ns])).tolist() == [True, False]


def _counts(revisions):
    return {r.hour_ns: (r.published, r.corrected, r.too_late) for r in late.hours(revisions).collect()}


def test_runs_that_restore_the_states_of_the_run_before_equal_one_run(spark):
    rng = random.Random(5)
    base = 400_000 * H
    events = [(k, base + rng.randrange(3 * H), rng.choice([M, 70 * M, 2 * H, 5 * H, 9 * H])) for k in range(900)]
    df = spark.createDataFrame([(bytearray(k.to_bytes(4, "big")), e, e + d, k % 3) for k, e, d in events], "id binary, event_ns bigint, arrival_ns bigint, run int")
    whole = late.replay(df)
    fates = {(r.record_id, r.fate) for r in late.fates(whole).collect()}
    states, got, told = None, Counter(), set()
    for n in range(3):
        revisions = late.replay(df.where(F.col("run") == n), states=states).cache()
        states = late.states_of(revisions).cache()
        for h, v in _counts(revisions).items():
            got.update({(h, i): x for i, x in enumerate(v)})
        told |= {(r.record_id, r.fate) for r in late.fates(revisions).collect()}
    assert told == fates and {k: v for k, v in got.items()} == {(h, i): x for h, v in _counts(whole).items() for i, x in enumerate(v)}
    # without the states that were written, nothing remembers what was published
    last = {h: sum(r.after for r in late.states_of(late.replay(df)).withColumn("after", F.aggregate("minutes", F.lit(0).cast("bigint"), lambda a, x: a + x)).collect() if r.hour_ns == h) for h in _counts(whole)}
    assert {h: sum(r.n for r in states.withColumn("n", F.aggregate("minutes", F.lit(0).cast("bigint"), lambda a, x: a + x)).collect() if r.hour_ns == h) for h in last} == last


def test_results_do_not_depend_on_arrow_batches_or_shards(spark):
    base = 400_000 * H
    events = [(k, base + k * 7 * M % (2 * H), base + k * 7 * M % (2 * H) + d) for k, d in enumerate([M, 70 * M, 3 * H, 8 * H, 0, 65 * M] * 30)]
    _, ex, rec = tables(spark, events)
    want = _counts(late.judged(ex, rec))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert _counts(late.judged(ex, rec, late.Lateness(shard_rows=5))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_eager_join_equals_the_join(spark):
    left = spark.createDataFrame([("a", i, "p" if i % 2 else None) for i in range(30)] + [("b", 1, "q"), (None, 5, "p"), ("", 2, "p")], "k string, x bigint, g string")
    right = spark.createDataFrame([("a", i) for i in range(20)] + [("c", 1), (None, 9), ("", None)], "k string, y bigint")
    got = skew.eager_join(left, right, {"k": (F.col("k"), F.col("k"))}, {"g": F.col("g")}, [skew.Measure("sx", F.col("x"))], [skew.Measure("sy", F.col("y"))])
    real = left.join(right, "k").groupBy("g").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    assert {r.g: (int(r.joined_rows), int(r.sx), int(r.sy)) for r in got.collect()} == {r.g: (r.n, r.sx, r.sy) for r in real.collect()}


def test_fractions_and_rows_without_partner(spark):
    left = spark.createDataFrame([("a", 1.5), ("a", 2.25), ("b", 1.0), (None, 4.0)], "k string, x double")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("c", 5)], "k string, y int").withColumn("z", F.expr("cast(y + 0.25 as decimal(9,2))"))
    for how in ("inner", "left", "right", "full"):
        got = skew.eager_join(left, right, {"k": (F.col("k"), F.col("k"))}, None, [skew.Measure("sx", F.col("x"))],
                              [skew.Measure("sy", F.col("y")), skew.Measure("sz", F.col("z"))], how)
        real = left.join(right, "k", how).groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum("z").alias("sz"))
        plain = lambda x: None if x is None else float(x)
        rows = lambda df, n: sorted((str(r.k), int(r[n]), plain(r.sx), plain(r.sy), plain(r.sz)) for r in df.collect())
        assert rows(got, "joined_rows") == rows(real, "n")


def test_shares_are_exact(spark):
    # 7 of 140 are one in twenty, which the product of doubles misses
    a = spark.createDataFrame([("x",)] * 7 + [(f"y{i}",) for i in range(133)], "k string")
    assert [(r.hot_key, r.key_rows, r.all_rows) for r in skew.hot_keys({"f": (a, F.col("k"))}).collect()] == [("x", 7, 140)]


def test_hot_keys(spark):
    a = spark.createDataFrame([(k,) for k in ["x"] * 50 + [""] * 5 + [None] * 41 + list("abcd")], "k string")
    got = {(r.field, r.hot_key) for r in skew.hot_keys({"f": (a, F.col("k")), "g": (a.limit(0), F.col("k"))}).collect()}
    assert got == {("f", "x"), ("f", "")}
