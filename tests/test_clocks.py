import brute_clocks
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from logloom.operators import clocks as C
from logloom.sources.tables import table

ALL = np.array([0b00111111], np.int64)


def candidates(text, zone, received, rules=C.Rules(), allowed=ALL):
    """(instant in ns, prior) of every interpretation."""
    got = C.interpret(pa.array([text], pa.string()), pa.array([received], pa.int64()), pa.array([zone], pa.string()), allowed, rules)
    return [(int(us) * 1000, int(code) >> 15) for us, code in zip(got["us"], got["code"])]


def one(text, zone, received):
    return next((ns for ns, prior in candidates(text, zone, received) if prior), None)


def test_against_one_value_at_a_time(spark, small):
    readings, clocks = table(spark, small, "clock_readings"), table(spark, small, "clocks")
    got = {r.reading_id: r.event_ns for r in C.normalized(readings, clocks).collect()}
    zones = {r.clock_id: r.zone_name for r in clocks.collect()}
    for r in readings.collect():
        assert got[r.reading_id] == brute_clocks.read(r.original_time, zones[r.clock_id], r.received_ns), r


ZONES = ["UTC", "+05:45", "America/New_York", "Australia/Lord_Howe", "Europe/London"]


@settings(max_examples=300, deadline=None)
@given(st.datetimes(min_value=__import__("datetime").datetime(2001, 1, 1), max_value=__import__("datetime").datetime(2098, 1, 1)), st.sampled_from(ZONES), st.integers(0, 9))
def test_local_times(when, zone, digits):
    received = 4_000_000_000_000_000_000
    text = when.strftime("%Y-%m-%d %H:%M:%S") + ("." + f"{when.microsecond:06d}000"[:digits] if digits else "")
    assert one(text, zone, received) == brute_clocks.read(text, zone, received)


def test_rules():
    r = 1_793_600_000_000_000_000
    assert one("2026-03-08 02:30:00", "America/New_York", r) is None  # skipped
    later = one("2025-11-02 01:30:00", "America/New_York", r)
    assert later == 1_762_065_000_000_000_000
    assert one("2025-11-02 01:30:00", "America/New_York", later - 1) == later - 3_600_000_000_000
    assert one("Feb 29 10:00:00", "UTC", r) == 1_709_200_800_000_000_000  # the last leap year
    assert one("1.793528929750E9", "UTC", r) == 1_793_528_929_750_000_000
    for bad in (None, "", "  ", "-1", "0", "99999999999999999999", "2026-02-30 10:00:00", "T10:00:00Z", "2026-01-01 24:00:00", "2026-01-01 10:00:00 XYZ"):
        assert one(bad, "UTC", r) is None, bad
    assert one("2026-01-01 10:00:00", "No/Where", r) is None
    assert one("2026-01-01 10:00:00+01:00", "No/Where", r) == 1_767_258_000_000_000_000


def test_nulls_unknown_clocks_and_empty_tables(spark):
    readings = spark.createDataFrame(
        [(1, 1, "2026-01-01 00:00:00", 5), (2, None, "1767225600", None), (3, 9, None, None), (3, 9, None, None)],
        "reading_id bigint, clock_id int, original_time string, received_ns bigint",
    ).withColumn("zone_name", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash"))
    clocks = spark.createDataFrame([(1, None, None)] * 2, "clock_id int, formats array<string>, zone_name string")
    got = sorted((r.reading_id, r.event_ns, r.status) for r in C.normalized(readings, clocks).collect() if r.event_ns)
    assert got == [(1, 1767225600 * 10**9, "resolved"), (2, 1767225600 * 10**9, "resolved")]
    assert C.normalized(readings, clocks).count() == 4
    assert C.normalized(readings.limit(0), clocks).count() == 0


def code(formats, delay, prior=1):
    return formats | delay << 8 | prior << 15


def test_mixture_weights_follow_the_counts():
    kinds = C.Kinds([[code(0b11, 5)], [code(0b100, 9)]])
    m = C.fit(kinds, np.array([30.0, 10.0]))
    assert abs(m.weight[0] + m.weight[1] - 0.75) < 1e-3 and abs(m.weight[2] - 0.25) < 1e-3 and m.delay[5] > m.delay[9]


def test_the_posterior_chooses_and_a_rule_of_nought_forbids():
    day, month = 1 << 6, 1 << 7
    kinds = C.Kinds([[code(day, 3)], [code(month, 3), code(day, 3)], [code(month, 3, 1), code(day, 3, 0)]])
    m = C.fit(kinds, np.array([50.0, 20.0, 1.0]))
    got = C.choices(kinds, m)
    assert got["pick"] == [0, 1, 0] and got["format"][1] == "day_first" and got["posterior"][1] > C.SURE > got["posterior"][2]
    assert C.choices(kinds, C.Mixture.even())["pick"][1] == 0


def test_candidates_that_rules_leave_open():
    r = 1_793_600_000_000_000_000
    free = C.Rules(zone=False, fold=False, year=False, digits=False)
    assert len(candidates("2025-11-02 01:30:00", "America/New_York", r)) == 2 and sum(p for _, p in candidates("2025-11-02 01:30:00", "America/New_York", r)) == 1
    assert [p for _, p in candidates("2025-11-02 01:30:00", "America/New_York", r, free)] == [1, 1, 1]
    assert len(candidates("Oct 5 10:00:00", "UTC", r, free)) == 2 and len(candidates("Oct 5 10:00:00", "UTC", r)) == 1
    assert candidates("999999999999", "UTC", r) == [] and candidates("999999999999", "UTC", r, free) == [(999999999999 * 10**6, 1)]
    both = np.array([0b11000000], np.int64)
    assert len(candidates("03/04/2026 10:00:00", "UTC", r, C.Rules(), both)) == 2 and len(candidates("13/04/2026 10:00", "UTC", r, C.Rules(), both)) == 0
    assert len(candidates("13.04.2026 10:00:00", "UTC", r, C.Rules(), both)) == 1 == len(candidates("04-04-2026 10:00:00", "UTC", r, C.Rules(), both))


def test_without_the_fit_rows_change(spark):
    """Planted ambiguity: two sources write the same texts, one day first, one month first, without receipt."""
    days = [(d, m) for d in range(1, 29) for m in range(1, 13)]
    rows = [(k, 1, f"{d:02}/{m:02}/2024 00:00:00", None) for k, (d, m) in enumerate(days)] + [(1000 + k, 2, f"{m:02}/{d:02}/2024 00:00:00", None) for k, (d, m) in enumerate(days)]
    readings = spark.createDataFrame(rows, "reading_id bigint, clock_id int, original_time string, received_ns bigint")
    declared = spark.createDataFrame([(c, ["day_first", "month_first"], "UTC") for c in (1, 2)], "clock_id int, formats array<string>, zone_name string")
    truth = {k % 1000: int((np.datetime64(f"2024-{m:02}-{d:02}") - np.datetime64("1970-01-01")) / np.timedelta64(1, "s")) * 10**9 for k, (d, m) in enumerate(days)}
    got = {r.reading_id: r.event_ns for r in C.normalized(readings, declared).collect()}
    assert got == {k: truth[k % 1000] for k, *_ in rows}
    even = C.normalized(readings, declared, fitting=lambda kinds, n: C.Mixture.even()).collect()
    assert {r.reading_id: r.event_ns for r in even} != got and any(r.status == "ambiguous" and r.other_ns for r in even)
    # delays decide as well: receipt a minute after the event leaves one order of day and month
    near = spark.createDataFrame([(k, 3, t, truth[k % 1000] + 60 * 10**9) for k, c, t, _ in rows], readings.schema)
    assert {r.reading_id: r.event_ns for r in C.normalized(near, declared.limit(0)).collect()} == got
