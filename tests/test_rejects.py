import random

from logloom.operators import rejects as R
from logloom.sources.tables import table

F = R.Field
CSV = R.Layout("g.csv", "csv", "^<\\d+>", (F("a", "int", True, ()), F("b", "text", False, ()), F("c", "choice", True, ("x", "y"))))
KV = R.Layout("g.kv", "kv", "", (F("a", "port", True, ()), F("b", "text", False, ()), F("t", "stamp", False, ())))
JSON = R.Layout("g.json", "json", "", (F("a", "ipv4", True, ()), F("o.k", "epoch", False, ())))
WS = R.Layout("g.ws", "delimited", "", (F("a", "int", True, ()), F("b", "text", True, ())))

CASES = [
    (CSV, '1,"q, ""x""",X', None), (CSV, '1,a"b,x', "quoting"), (CSV, '1,"a"b,x', "quoting"), (CSV, '1,"a\nb",y', None),
    (CSV, "1,b", "columns"), (CSV, "", "columns"), (CSV, "x,b,x", "value"), (CSV, "1,b,z", "value"), (CSV, "-,b,x", "value"), (CSV, " 1 ,,x", None),
    (KV, 'a=80 b="two words" t="2024/02/29 10:00:00"', None), (KV, "a=80 b=two words", "columns"), (KV, "a=80 a=81", "columns"), (KV, "b=1", "columns"),
    (KV, 'a=80 b="x', "quoting"), (KV, 'a=80 b=x"y', "quoting"), (KV, "a=65536", "value"), (KV, 'a=1 t="2023/02/29 10:00:00"', "value"), (KV, "a=-", "value"),
    (JSON, '{"a": "1.2.3.4", "o": {"k": 1700000000.5}}', None), (JSON, '{"a": "1.2.3.4", "o.k": "1700000000"}', None), (JSON, '{"a": NaN}', "quoting"),
    (JSON, "[1]", "quoting"), (JSON, '{"a": "1.2.3.4"} {"a": 1}', "quoting"), (JSON, '{"b": 1}', "columns"), (JSON, '{"a": null}', "value"),
    (JSON, '{"a": "1.2.3.256"}', "value"), (JSON, '{"a": "1.2.3.4", "o": {"k": 5}}', "value"), (JSON, '{"a":[{}', "quoting"), (JSON, "{}]}", "quoting"),
    (WS, "1  b", None), (WS, "1", "columns"), (WS, " 1\tb ", None), (WS, "z b", "value"),
]


def test_strict_reasons():
    for layout, body, reason in CASES:
        assert R.strict(layout, body)[0] == reason, (layout.grammar, body)


def test_blocks_agree_with_strict_reading():
    rng = random.Random(5)
    for layout in (CSV, KV, JSON, WS):
        known = [b for l, b, _ in CASES if l is layout]
        for size in (1, 2, 7, 40, 300):
            bodies = [rng.choice(known) for _ in range(size)]
            bodies = ["".join(c if rng.random() > 0.01 else rng.choice('",={} \n1') for c in b) for b in bodies]
            want = {i: r for i, b in enumerate(bodies) if (r := R.strict(layout, b)[0])}
            assert dict(R.faults(layout, bodies)) == want
            got = {i: (r, v) for i, r, v in R.judge(layout, bodies)}
            assert got == {i: R.strict(layout, b) for i, b in enumerate(bodies)}


def test_nulls_repeats_and_other_columns(spark):
    layout = "array<struct<field string, kind string, required boolean, choices array<string>>>"
    grammars = spark.createDataFrame(
        [("g", "1", "csv", ["l"], None, [("a", "int", True, None)]), ("h", "1", "cef", ["m"], "", None), (None, None, None, None, None, None)],
        f"grammar string, grammar_version string, family string, listeners array<string>, header_pattern string, layout {layout}",
    )
    env = "struct<channel:tinyint,peer:string,listener:string,received_ns:bigint,truncated:boolean>"
    e = lambda l: (0, None, l, None, None)
    records = spark.createDataFrame(
        [(1, bytearray(b"5\r\n"), e("l"), "x"), (2, None, e("l"), "x"), (3, bytearray(b"\xff"), e("l"), None), (3, bytearray(b"\xff"), e("l"), None), (4, bytearray(b"zz"), e("m"), ""), (5, b"1", None, "")],
        f"seq bigint, payload binary, env {env}, listener string",
    )
    assert sorted(map(tuple, R.rejected(records, grammars).collect())) == [(2, "value"), (3, "value"), (3, "value")]
    assert [(r.seq, r.fields) for r in R.loaded(records, grammars).collect()] == [(1, {"a": "5"})]
    assert R.rejected(records.limit(0), grammars).count() == 0
    assert R.rejected(records, grammars.limit(0)).count() == 0


def test_every_judged_record_is_loaded_or_rejected(spark, small):
    records, grammars = table(spark, small, "records"), table(spark, small, "grammars")
    judged = [l for part in R.layouts_by_listener(grammars) for l in part]
    total = records.where(records.env.listener.isin(judged)).count()
    assert R.rejected(records, grammars).count() + R.loaded(records, grammars).count() == total
    counted = R.recounted(records, table(spark, small, "metrics"), grammars)
    assert sum(r.rejected for r in counted.collect()) == R.rejected(records, grammars).count()


def test_layouts_in_several_passes_and_empty_tables(spark, small, monkeypatch):
    records, grammars = table(spark, small, "records"), table(spark, small, "grammars")
    want = sorted(map(tuple, R.rejected(records, grammars).collect()))
    monkeypatch.setattr(R.layouts_by_listener, "__defaults__", (7,))
    assert len(R.layouts_by_listener(grammars)) > 1
    assert sorted(map(tuple, R.rejected(records, grammars).collect())) == want
    assert R.rejected(records, grammars.limit(0)).count() == R.loaded(records.limit(0), grammars).count() == 0


def test_a_block_is_told_only_as_a_whole():
    """The parsers return columns or nothing: which record is to blame comes from halving alone."""
    for layout in (CSV, KV, JSON, WS):
        good = [b for l, b, r in CASES if l is layout and R.PARSERS[layout.family](layout, [b]) is not None]
        bad = [b for l, b, r in CASES if l is layout and r in ("quoting", "columns")]
        parse = R.PARSERS[layout.family]
        assert parse(layout, good * 5) is not None and parse(layout, good * 5 + bad[:1] + good) is None
        at, columns, failed = R.bisect(layout, good * 3 + bad[:1] + good * 4)
        assert len(good) * 3 in failed and len(failed) <= R.LEAF and len(columns[0]) == len(at) == len(good) * 7 + 1 - len(failed)


def test_two_wrongs_do_not_shift_rows():
    for bodies in (['1,"a', 'b",x', "1,b\n1,b,x"], ["1,b,x\n", "1,b,x"], ["\ufeff1,b,x", "1,b,x"], ["1,b,x\r", "1,,x"]):
        assert dict(R.faults(CSV, bodies)) == {i: r for i, b in enumerate(bodies) if (r := R.strict(CSV, b)[0])}
    for odd in "\x1c\x85\xa0\u2003\u3000\x0b":
        bodies = [f"a=1{odd}b=2", f"a{odd}b=2 a=3", f'a=1 b="x{odd}y"', "a=1"]
        assert dict(R.faults(KV, bodies)) == {i: r for i, b in enumerate(bodies) if (r := R.strict(KV, b)[0])}


def test_json_nested_beyond_the_stack():
    n = 60_000
    deep = '{"a": "1.2.3.4", "x": ' + "[" * n + '{"k": [1, "\\u00e4", true]}' + "]" * n + "}"
    assert R.strict(JSON, deep) == (None, ["1.2.3.4", None]) and R.strict(JSON, deep[:-1])[0] == "quoting" and R.strict(JSON, deep + "]")[0] == "quoting"
    assert not R.faults(JSON, [deep, '{"a": "1.2.3.4"}'])
    text = R.Layout("g", "json", "", (F("x", "text", True, ()),))
    assert R.strict(text, deep)[1][0] == "[" * n + '{"k":[1,"ä",true]}' + "]" * n
    rng = random.Random(3)
    for _ in range(3000):
        body = "".join(rng.choice(['{', '}', '[', ']', ',', ':', '"a"', '"b":', '1', '-0.5e3', 'true', 'null', ' ', '"', '01']) for _ in range(rng.randint(1, 9)))
        try:
            want = R._JSON.decode(body)
        except ValueError:
            want = None
        try:
            got = R._deep_json(body)
        except ValueError:
            got = None
        assert got == want, body
