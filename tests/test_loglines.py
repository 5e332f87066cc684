import math

import brute_loglines
from logloom.functions.earley import Grammar
from logloom.operators import loglines as L
from logloom.sources.tables import table

SCHEMA = "line_id bigint, stream_name string, line_no bigint, payload binary, received_ns bigint"


def rows(df):
    return sorted((r.stream_name or "", r.line_no, r.event_ns, r.log_level, r.component, r.message) for r in df.collect())


def test_entries_against_one_pass(spark, small):
    lines = table(spark, small, "app_lines")
    data = [(r.stream_name, r.line_no, r.line_id, bytes(r.payload)) for r in lines.collect()]
    want = sorted(brute_loglines.assemble(data))
    for chunk in (1024, 3, 1):
        assert rows(L.entries(lines, texts=True, chunk=chunk)) == want
    short = {(r.stream_name, r.line_no, r.event_ns): r.message_chars for r in L.entries(lines, chunk=2).collect()}
    assert short == {w[:3]: len(w[5]) for w in want}


def test_edge_cases(spark):
    head = b"2026-03-06T22:03:20.776Z warning [ui] one"
    lines = spark.createDataFrame(
        [(1, None, 1, bytearray(b"lost")), (2, None, 2, bytearray(head + b"\r\nnext\r\n\r")), (3, None, 2, bytearray(b"again")), (4, None, 3, None),
         (5, "s", None, bytearray(head)), (6, "s", 1, bytearray(b"\xff")), (7, "t", -5, bytearray(head + b"\n" + head))],
        "line_id bigint, stream_name string, line_no bigint, payload binary",
    )
    got = rows(L.entries(lines, texts=True))
    assert got == [("", 2, 1772834600776000000, "WARN", "ui", "one\nnext\n\n"), ("t", -5, 1772834600776000000, "WARN", "ui", "one"),
                   ("t", -5, 1772834600776000000, "WARN", "ui", "one")]
    assert L.entries(lines.limit(0)).count() == 0


def test_headers():
    at = 1772834600776000000
    assert L.header('{"msg": "a\\"b", "ts": 1772834600776, "x": {"level": [1, {}]}, "level": "W", "logger": "m.n"}') == (at, "WARN", "m.n", 'a"b')
    assert L.header("level=err ts=2026-03-06T22:03:20.776Z component=c other=1") == (at, "ERROR", "c", "")
    assert L.header("<191>1 2026-03-06T22:03:20.776Z h app - - - x") == (at, "DEBUG", "app", "x")
    for no in ("", " 2026-03-06T22:03:20.776Z warn [x] y", "2026-03-06 nightly", '{"level": "error"}', "2026-13-06T22:03:20Z warn [x] y", "2026-03-06T22:03:20Z loud [x] y", "<999>1 2026-03-06T22:03:20Z h a - - - x"):
        assert L.header(no) is None, no
    assert L.attempt("2026-03-06T22:03:20Z warn (x) y", trace=True).unparsed == 25


def test_ambiguous_grammar_takes_the_best_parse():
    g = Grammar('s 0.4 -> a=x b=x\ns 0.6 -> c=/.*/\nx 1.0 -> "ab" x\nx 0.9 -> "ab"', "s")
    assert g.parse("ababab").get("c") == "ababab"
    g = Grammar('s 1.0 -> x\nx 0.9 -> x x\nx 0.5 -> one=/a/', "s")
    assert g.parse("aaa").spans is not None and g.parse("aab").spans is None and g.parse("aab", trace=True).unparsed == 2


def test_fused_terminals_capture_and_do_not_give_back():
    g = Grammar('s 1.0 -> "<" a=w "=" b=/.*?(?=>)/ ">"\nw 0.5 -> /[a-z]+/ c=/[0-9]*/', "s")
    p = g.parse("<ab1=x y>")
    assert {n: p.get(n) for n in "abc"} == {"a": "ab1", "b": "x y", "c": "1"} and abs(p.score - math.log(0.5)) < 1e-9
    assert Grammar('s 1.0 -> /a*/ "a"', "s").parse("aaa").spans is None  # as it is with one terminal after the other


def test_continuations_are_rules_and_headers_of_many_programs():
    r = 1_793_600_000_000_000_000
    for line in ("", "   at com.acme.Foo(Foo.java:1)", "Caused by: x", "2026-01-01 nothing", "<34>no header"):
        assert L.lines_of().parse(line).get("rest") == line and L.header(line, r) is None
    assert L.lines_of().parse("Caused by: x").score > L.lines_of().parse("caused by: x").score
    at = 1767268800123000000
    for line in ("2026-01-01 12:00:00,123 INFO [main] com.acme.Foo - hello", "2026-01-01 12:00:00.123 [main] INFO  com.acme.Foo - hello",
                 "2026-01-01 12:00:00,123 - com.acme.Foo - INFO - hello", "2026-01-01T12:00:00.123Z  INFO 4711 --- [           main] com.acme.Foo : hello"):
        assert L.header(line) == (at, "INFO", "com.acme.Foo", "hello"), line
    assert L.header("<34>Oct 11 22:14:15 host su[230]: 'su root' failed", r) == (1791756855000000000, "FATAL", "su", "'su root' failed")
    assert L.header("E0102 15:04:05.678901   12345 server.go:77] oops", r) == (1767366245678901000, "ERROR", "server.go", "oops")
    assert L.header("E0102 15:04:05.678901   12345 server.go:77] oops") is None  # no receipt, no year


def test_an_entry_over_many_sections(spark, monkeypatch):
    head = b"2026-03-06T22:03:20.776Z warning [ui] one"
    rows_ = [(n, "s", n, bytearray(head if n in (0, 40, 41) else b"more %d" % n), None) for n in range(60)]
    lines = spark.createDataFrame(rows_, SCHEMA)
    monkeypatch.setattr(L, "SECTION", 3)
    got = rows(L.entries(lines, texts=True, chunk=2))
    assert [(g[1], g[5].count("\n")) for g in got] == [(0, 39), (40, 0), (41, 18)] and got[0][5].endswith("more 39")


def test_long_lines_that_nearly_parse_take_linear_time():
    import time

    for line in ('a="' + "x" * 200_000, '{"a": "' + "\\\\" * 100_000, "<1>1 2026-03-06T22:03:20.776Z h a - - [" + "x " * 100_000, '{"a": ' + "[1, " * 3000, "a=1 " * 20_000 + '"'):
        start = time.perf_counter()
        assert L.header(line) is None and time.perf_counter() - start < 5
