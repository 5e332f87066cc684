"""Queries of the engine's own operators over the tables of a folder, with their SQL.

Expressions that SQL can state are checked over texts of the tables; parsers are checked by rendering rows of the
tables to lines in the vendors' formats, reading these back, and comparing with the rows themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import extract, shapes, text
from logloom.functions import sql as S
from logloom.functions.times import clock_time
from logloom.operators import archive, induce, inspect
from logloom.plans import derive as plans
from logloom.plans.grammar import Library
from logloom.sources import lines, sinks
from logloom.sources.tables import table
from logloom.storage import materialize, shared_folder
from logloom.streaming import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RECEIVED = 1_780_000_000_000_000_000


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- identity and archive -------------------------------------------------------------------------

@query("SELECT seq, lower(hex(id)) AS record_id, octet_length(payload) AS bytes FROM records")
def identity(spark, d):
    rows = archive.identified(table(spark, d, "records").drop("id"))
    return rows.select("seq", F.lower(F.hex("id")).alias("record_id"), F.octet_length("payload").cast("bigint").alias("bytes"))


@query("""SELECT lower(hex(id)) AS record_id, min(seq) AS ord, count(*) AS seen,
  CAST(sum(octet_length(payload)) / count(*) AS BIGINT) AS raw_len FROM records GROUP BY id""")
def dedupe_seen(spark, d):
    got = archive.stored(table(spark, d, "records").select("payload", "env", F.col("seq").alias("ord")))
    first = table(spark, d, "records").groupBy("id").agg(F.min("seq").alias("ord"))
    return got.join(first, "id").select(F.lower(F.hex("id")).alias("record_id"), "ord", "seen", "raw_len")


_TREE = """WITH RECURSIVE leaves AS (
    SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY stratum) AS n,
           unhex(sha256('\\x00'::BLOB || id)) AS node FROM records),
  tree AS (
    SELECT stratum, place, n, node FROM leaves
    UNION ALL
    SELECT stratum, place // 2, (any_value(n) + 1) // 2,
           CASE WHEN max(place) % 2 = 0 THEN any_value(node) ELSE unhex(sha256('\\x01'::BLOB || min_by(node, place) || max_by(node, place))) END
    FROM tree WHERE n > 1 GROUP BY stratum, place // 2),
  roots AS (SELECT stratum, lower(hex(node)) AS root FROM tree WHERE n = 1)"""


@query(_TREE + """ SELECT r.stratum AS stratum, coalesce(lag(root) OVER (ORDER BY r.stratum), repeat('0', 64)) AS prev_root, root, c.n AS records
  FROM roots r JOIN (SELECT stratum, count(*) AS n FROM records GROUP BY 1) c USING (stratum)""")
def segments_sealed(spark, d):
    got = archive.sealed(table(spark, d, "records"))
    return got.select("stratum", *[F.lower(F.hex(c)).alias(c) for c in ("prev_root", "root")], "records")


@query("""SELECT stratum, 'content_mismatch' AS kind, lower(hex(id)) AS record_id FROM records WHERE seq % 500 = 3
  UNION ALL SELECT stratum, 'root_mismatch', NULL FROM records WHERE seq = 11
  UNION ALL SELECT max(stratum), 'chain_break', NULL FROM records""")
def audit_faults(spark, d):
    """What an audit finds after payloads were changed, a record was taken out and a segment was unhinged."""
    records = table(spark, d, "records")
    segments = archive.sealed(records)
    last = segments.agg(F.max("stratum").alias("last"))
    unhinged = segments.join(last, segments.stratum == last["last"], "left").withColumn(
        "prev_root", F.when(F.col("last").isNotNull(), F.lit(b"x" * 32)).otherwise(F.col("prev_root"))
    ).drop("last")
    changed = F.when(F.col("seq") % 500 == 3, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload"))
    return archive.faults(records.withColumn("payload", changed).where("seq <> 11"), unhinged)


@query("SELECT count(*) AS records, count(*) AS intact, 1.0::DOUBLE AS fidelity FROM records")
def audit_fidelity(spark, d):
    return archive.fidelity(table(spark, d, "records"))


@query("""SELECT stratum, count(*) AS records, CAST(sum(raw_len) AS BIGINT) AS raw_bytes, CAST(sum(seen) AS BIGINT) AS seen
  FROM records GROUP BY stratum""")
def archive_totals(spark, d):
    return archive.totals(table(spark, d, "records"))


@query("SELECT DISTINCT lower(hex(id)) AS record_id, true AS intact FROM records WHERE env.truncated")
def spot_check(spark, d):
    records = table(spark, d, "records")
    return archive.spot_check(records, records.where("env.truncated"))


@query("SELECT lower(hex(id)) AS record_id, seq FROM records WHERE id IN (SELECT id FROM records WHERE seq = 7)")
def point_lookup(spark, d):
    records = table(spark, d, "records")
    return records.join(records.where("seq = 7").select("id"), "id", "left_semi").select(F.lower(F.hex("id")).alias("record_id"), "seq")


# --- intake ---------------------------------------------------------------------------------------

@query("""SELECT CASE WHEN env.peer IS NULL OR env.peer NOT IN ('10.20.0.4', '10.20.0.9', '') THEN 'unknown_source'
  WHEN octet_length(payload) > 400 THEN 'oversize' ELSE 'accepted' END AS outcome, count(*) AS n FROM records GROUP BY 1
  UNION ALL SELECT 'truncated', count(*) FROM records
  WHERE env.peer IN ('10.20.0.4', '10.20.0.9', '') AND octet_length(payload) <= 400 AND env.truncated""")
def intake_admission(spark, d):
    return lines.intake_stats(lines.admitted(table(spark, d, "records"), ["10.20.0.4", "10.20.0.9", ""], 400))


@query("SELECT env.peer AS peer, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, peer NULLS LAST LIMIT 10")
def top_peers(spark, d):
    return lines.top_peers(table(spark, d, "records"))


_BUCKET = """WITH RECURSIVE o AS (
    SELECT seq, env.peer AS peer, coalesce(env.received_ns, 0) AS came,
           row_number() OVER (PARTITION BY env.peer ORDER BY coalesce(env.received_ns, 0), seq) AS k FROM records),
  b AS (
    SELECT seq, peer, came, k, 19.0::DOUBLE AS tokens, true AS admitted FROM o WHERE k = 1
    UNION ALL
    SELECT seq, peer, came, k, CASE WHEN t >= 1 THEN t - 1 ELSE t END, t >= 1 FROM (
      SELECT o.seq, o.peer, o.came, o.k, least(20.0::DOUBLE, b.tokens + (o.came - b.came) / 1e9::DOUBLE * 0.0005::DOUBLE) AS t
      FROM b JOIN o ON o.k = b.k + 1 AND o.peer IS NOT DISTINCT FROM b.peer))
  SELECT seq, peer, admitted FROM b"""


@query(_BUCKET)
def token_bucket(spark, d):
    return lines.rate_limited(table(spark, d, "records"), rate=0.0005, burst=20)


@query("SELECT seq FROM records WHERE NOT regexp_full_match(hex(payload), '(09|0A|0B|0C|0D|20)*')")
def blank_skip(spark, d):
    return lines.not_blank(table(spark, d, "records")).select("seq")


# --- fingerprint ----------------------------------------------------------------------------------

def _titles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("line"))


@query("""SELECT doc_id, length(t) - length(replace(t, ',', '')) AS commas, length(t) - length(replace(t, '=', '')) AS equals,
  length(t) - length(replace(t, '|', '')) AS pipes, length(t) - length(replace(t, ' ', '')) + 1 AS words
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def fingerprint_counts(spark, d):
    got = S.with_columns(_titles(spark, d), c=shapes.counts(S.col("line")))
    return got.select("doc_id", *[F.col(f"c.{k}").cast("bigint").alias(k) for k in ("commas", "equals", "pipes")], (F.col("c.spaces") + 1).cast("bigint").alias("words"))


@query()
def shape_of_vendor_lines(spark, d):
    """The family of every record. SQL would have to say the whole classification again; a plain one is held against it in
    the tests."""
    records = table(spark, d, "records").select("seq", S.column(text.decoded(S.coalesce("payload", S.lit(b"")))).alias("line"))
    got = S.with_columns(records, c=shapes.counts(S.col("line")))
    return S.with_columns(got, family=shapes.classified(S.col("line"), S.col("c"))).select("seq", "family")


# --- extraction primitives, by rendering and reading back -----------------------------------------

def _read(df: DataFrame, line: str, step: Callable[[S.E], S.E], fields: list[str], keys: list[str]) -> DataFrame:
    """Run a step on a rendered line; the fields as columns beside the keys."""
    rendered = df.select(*keys, F.expr(line).alias("line"))
    got = S.with_columns(rendered, st=step(extract.begin(S.col("line"))))
    return got.select(*keys, *[F.expr(f"st.f['{f}']").alias(f.replace(".", "_")) for f in fields])


_CSV = """concat_ws(',', l_orderkey, concat('"', l_returnflag, ', ', l_linestatus, '"'), '-', l_suppkey, ' x ', 'more')"""


@query("""SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_orderkey AS VARCHAR) AS a, l_returnflag || ', ' || l_linestatus AS b,
  CAST(l_suppkey AS VARCHAR) AS c, 'x' AS e, 'more' AS overflow_5 FROM lineitem""")
def step_columns(spark, d):
    rows = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "k", "l_linenumber": "n"})
    line = _CSV.replace("l_orderkey", "k")
    return _read(rows, line, lambda s: extract.columns(s, ("a", "b", "-", "c", "e"), ",", '"'), ["a", "b", "c", "e", "overflow_5"], ["k", "n"])


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS "user", event_type AS type, NULL::VARCHAR AS gone, 'rest of it' AS rest FROM events""")
def step_whitespace(spark, d):
    line = "concat('  ', user_id, '   ', event_type, ' - rest of it')"
    return _read(table(spark, d, "events"), line, lambda s: extract.whitespace(s, ("user", "type", "gone", "rest"), 3), ["user", "type", "gone", "rest"], ["event_id"])


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS "user", event_type || ' and more' AS type, '' AS empty, '2' AS twice FROM events""")
def step_kv(spark, d):
    line = """concat('user=', user_id, ' twice=1 type="', event_type, ' and more" empty= twice=2')"""
    return _read(table(spark, d, "events"), line, lambda s: extract.kv(s, None, False), ["user", "type", "empty", "twice"], ["event_id"])


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS "user", event_type || ' and more' AS type, 'a b' AS last FROM events""")
def step_kv_bar(spark, d):
    line = "concat('User=', user_id, '|type=', event_type, ' and more|last=\"a b\"')"
    return _read(table(spark, d, "events"), line, lambda s: extract.kv(s, "|", True), ["user", "type", "last"], ["event_id"])


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS a_b_c, event_type AS "type", '[1,2]' AS list, json_extract_string(props, '$.k') AS props_k FROM events""")
def step_json(spark, d):
    line = """concat('<13>x {"a":{"b":{"c":', user_id, '}},"type":"', event_type, '","list":[1, 2],"none":null,"props":', props, '}')"""
    return _read(table(spark, d, "events"), line, lambda s: extract.json_object(s, ".", 6), ["a.b.c", "type", "list", "props.k"], ["event_id"])


@query("""SELECT o_orderkey, 'V' AS cef_vendor, '7' AS cef_severity, CAST(o_custkey AS VARCHAR) AS suser,
  o_orderpriority || ' two words = x' AS msg, o_orderstatus AS act FROM orders""")
def step_cef(spark, d):
    line = r"""concat('<14>h CEF:0|V|P|1|100|Name|7|suser=', o_custkey, ' msg=', o_orderpriority, ' two words \\= x act=', o_orderstatus)"""
    return _read(table(spark, d, "orders"), line, extract.cef, ["cef_vendor", "cef_severity", "suser", "msg", "act"], ["o_orderkey"])


@query("""SELECT o_orderkey, '2.0' AS leef_version, 'V' AS leef_vendor, CAST(o_custkey AS VARCHAR) AS usrName, o_orderpriority AS msg FROM orders""")
def step_leef(spark, d):
    line = r"""concat('LEEF:2.0|V|P|1|E|usrName=', o_custkey, '\t msg = ', o_orderpriority, '\tnovalue=\tplain')"""
    return _read(table(spark, d, "orders"), line, extract.leef, ["leef_version", "leef_vendor", "usrName", "msg"], ["o_orderkey"])


@query("""SELECT c_custkey, 'local1' AS log_host, CAST(16 AS VARCHAR) AS log_facility, 'info' AS log_severity, 'Aug  5 10:00:00' AS log_time,
  c_name AS name, c_mktsegment AS seg FROM customer""")
def step_syslog_prefix_regex(spark, d):
    line = "concat('<134>Aug  5 10:00:00 local1 app[7]: Built for ', c_name, ' in ', c_mktsegment, ' done')"

    def step(s):
        peeled = text.let(extract.syslog(s, "auto"), lambda a: extract.prefix(a, r"^app(?:\[\d+\])?:\s*"))
        return text.let(peeled, lambda b: extract.regex(b, r"for\s+(?P<name>\S+) in (?P<seg>\w+)", extract.BODY, True))

    return _read(table(spark, d, "customer"), line, step, ["log_host", "log_facility", "log_severity", "log_time", "name", "seg"], ["c_custkey"])


@query("""SELECT c_custkey, 'node' AS log_host, 'app' AS log_app, '77' AS log_procid, NULL::VARCHAR AS log_msgid, c_name AS name FROM customer""")
def step_syslog5424(spark, d):
    line = "concat('<165>1 2026-03-01T00:00:00Z node app 77 - [x y=\"1\"][z] ', c_name)"

    def step(s):
        return text.let(extract.syslog(s, "auto"), lambda a: extract.regex(a, r"^(?P<name>.*)$", extract.BODY, False))

    return _read(table(spark, d, "customer"), line, step, ["log_host", "log_app", "log_procid", "log_msgid", "name"], ["c_custkey"])


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'port: could not cast to int, kept as text' END AS note,
  CASE WHEN user_id % 3 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS port, CAST(user_id % 2 = 0 AS VARCHAR) AS flag FROM events""")
def coerce_notes(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(
        "concat('port=', if(user_id % 3 = 0, 'n/a', concat('00', user_id)), ' flag=', if(user_id % 2 = 0, 'YES', 'off'))").alias("line"))
    got = S.with_columns(rows, st=extract.kv(extract.begin(S.col("line")), None, False))
    got = S.with_columns(got, x=extract.coerced(S.col("st"), {"port": "int", "flag": "bool"}))
    return got.selectExpr("event_id", "get(x.notes, 0) AS note", "x.f['port'] AS port", "x.f['flag'] AS flag")


# --- clocks ---------------------------------------------------------------------------------------

def _clock(spark, d, line: str, formats: list[str], zone: str = "UTC") -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.expr(line).alias("t"))
    return S.with_columns(rows, event_ns=clock_time(S.col("t"), formats, zone, S.lit(RECEIVED))).select("k", "n", "event_ns")


_AT = "epoch_us(l_shipdate) * 1000"


@query(f"SELECT l_orderkey AS k, l_linenumber AS n, {_AT} - 19800000000000 + 123456000 AS event_ns FROM lineitem")
def clock_iso8601(spark, d):
    return _clock(spark, d, "concat(date_format(l_shipdate, \"yyyy-MM-dd'T'HH:mm:ss\"), '.1234567+05:30')", ["slashed", "iso8601"])


@query(f"SELECT l_orderkey AS k, l_linenumber AS n, {_AT} + 10800000000000 AS event_ns FROM lineitem")
def clock_slashed_zone(spark, d):
    return _clock(spark, d, "date_format(l_shipdate, 'yyyy/MM/dd HH:mm:ss')", ["slashed"], "-03:00")


@query(f"SELECT l_orderkey AS k, l_linenumber AS n, {_AT} AS event_ns FROM lineitem")
def clock_epoch(spark, d):
    return _clock(spark, d, "cast(unix_micros(cast(l_shipdate as timestamp)) div 1000000 as string)", ["epoch", "epoch_ms"])


@query("""SELECT l_orderkey AS k, l_linenumber AS n, epoch_us(make_timestamp(
    CASE WHEN make_timestamp(2026, month(l_shipdate), least(day(l_shipdate), 28), 12, 0, 0) > make_timestamp(1780000000000000::BIGINT) + INTERVAL 1 DAY
         THEN 2025 ELSE 2026 END, month(l_shipdate), least(day(l_shipdate), 28), 12, 0, 0)) * 1000 AS event_ns FROM lineitem""")
def clock_bsd_year(spark, d):
    return _clock(spark, d, "concat(date_format(l_shipdate, 'MMM'), ' ', lpad(cast(least(day(l_shipdate), 28) as string), 2, ' '), ' 12:00:00')", ["bsd"])


@query("SELECT l_orderkey AS k, l_linenumber AS n, NULL::BIGINT AS event_ns FROM lineitem")
def clock_impossible(spark, d):
    return _clock(spark, d, "concat(year(l_shipdate), if(l_linenumber % 2 = 0, '-02-31', '-13-01'), 'T10:00:00Z')", ["iso8601", "dashed", "slashed", "bsd"])


# --- the whole engine over the archive ------------------------------------------------------------

def _derived(spark, d, generation: int = 0) -> DataFrame:
    return plans.derive(table(spark, d, "records"), Library(), generation=generation, processed_ms=0)


@query()
def derive_events(spark, d):
    return plans.events(_derived(spark, d))


@query()
def derive_rejections(spark, d):
    return plans.rejections(_derived(spark, d))


@query()
def rewind_generation(spark, d):
    return plans.events(archive.rewound(table(spark, d, "records"), Library(), 3, processed_ms=0))


@query()
def verdict_counts(spark, d):
    return _derived(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query()
def triage_selectivity(spark, d):
    return inspect.selectivity(_derived(spark, d), len(Library().all()))


@query()
def provenance_spans(spark, d):
    return inspect.links(table(spark, d, "records"), _derived(spark, d), Library())


@query()
def sink_documents(spark, d):
    return sinks.documents(_derived(spark, d))


@query()
def sink_cef(spark, d):
    return sinks.cef_lines(plans.events(_derived(spark, d)))


_RENDERED = """SELECT o_orderkey AS k, 'zeek.conn' AS grammar, '10.0.' || (o_custkey % 250) || '.1' AS src_ip, CAST(o_custkey % 60000 + 1 AS INTEGER) AS src_port,
  CAST(1700000000000 + o_orderkey * 1000 + 500 AS BIGINT) AS time_ms, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 99 END AS disposition_id,
  CAST(1 AS INTEGER) AS severity_id, '{"extra":"' || o_orderpriority || '"}' AS unmapped, CAST(o_orderkey * 3 AS BIGINT) AS bytes_out FROM orders"""


@query(_RENDERED)
def rendered_round_trip(spark, d):
    """Orders as JSON lines of one sensor, read, mapped and compared with the orders."""
    state = "CASE o_orderstatus WHEN 'F' THEN 'SF' WHEN 'O' THEN 'REJ' ELSE 'zz' END"
    line = f"""concat('{{"ts": ', 1700000000 + o_orderkey, '.5, "id.orig_h": "10.0.', o_custkey % 250, '.1", "id.orig_p": ', o_custkey % 60000 + 1,
      ', "orig_bytes": "', o_orderkey * 3, '", "conn_state": "', {state}, '", "extra": "', o_orderpriority, '"}}')"""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.expr(line).cast("binary").alias("payload"),
        F.expr("named_struct('channel', 0Y, 'peer', '', 'listener', '', 'received_ns', 1800000000000000000L, 'truncated', false)").alias("env"),
        F.lit(0).alias("stratum"),
    )
    # stored first, as any delivery is; the plan then begins at a scan
    marked = materialize(rows.withColumn("id", F.col("k").cast("string").cast("binary")), "rendered")
    got = plans.events(plans.derive(marked, Library(), processed_ms=0))
    return got.select(
        F.unhex("record_id").cast("string").cast("bigint").alias("k"), "grammar", "src_ip", "src_port", "time_ms", "disposition_id", "severity_id",
        "unmapped", "bytes_out",
    )


# Every grammar reads orders that were rendered in its vendor's layout; the SQL says what the events are to hold.

_COLUMNS = ("time_ms", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "app", "bytes_total", "bytes_in", "bytes_out", "user_name", "rule", "device", "disposition_id", "severity_id", "unmapped")
_KINDS = {
    "time_ms": "BIGINT", "src_port": "INTEGER", "dst_port": "INTEGER", "bytes_total": "BIGINT", "bytes_in": "BIGINT", "bytes_out": "BIGINT",
    "disposition_id": "INTEGER", "severity_id": "INTEGER",
}
_PARTS = {  # parts of a line, as SQL that both engines know
    "src": "concat('10.0.', o_custkey % 250, '.1')", "dst": "concat('192.0.2.', o_orderkey % 250)", "sp": "(o_custkey % 60000 + 1)",
    "dp": "(o_orderkey % 1000 + 1)", "n": "(o_orderkey * 3)", "m": "(o_custkey * 7)", "t": "(1700000000 + o_orderkey)",
    "user": "concat('u', o_custkey % 50)", "word": "CASE o_orderstatus WHEN 'F' THEN '{F}' WHEN 'O' THEN '{O}' ELSE '{odd}' END",
}


RENDERED: dict[str, Query] = {}  # the derivations of the rendered lines


def rendered(name: str, line: str, words: tuple[str, str], ids: tuple[int, int], expected: dict[str, str], odd: str = "odd") -> None:
    """Register rendered_<name>: line and expected are templates over _PARTS; words and ids belong to the dispositions of
    orders of status F and O, all others being odd ones."""
    parts = _PARTS | {"word": _PARTS["word"].format(F=words[0], O=words[1], odd=odd)}

    def filled(template: str) -> str:
        for key, value in parts.items():
            template = template.replace("{" + key + "}", value)
        return template

    told = {"disposition_id": f"CASE o_orderstatus WHEN 'F' THEN {ids[0]} WHEN 'O' THEN {ids[1]} ELSE 99 END", "time_ms": "{t} * 1000"} | expected
    columns = ", ".join(f"CAST({filled(told.get(c, 'NULL'))} AS {_KINDS.get(c, 'VARCHAR')}) AS {c}" for c in _COLUMNS)

    def derived(spark, d):
        rows = table(spark, d, "orders").select(
            F.col("o_orderkey").alias("k"), F.expr(filled(line)).cast("binary").alias("payload"),
            F.expr("named_struct('channel', 0Y, 'peer', '', 'listener', '', 'received_ns', 1800000000000000000L, 'truncated', false)").alias("env"), F.lit(0).alias("stratum"),
        )
        marked = materialize(rows.withColumn("id", F.col("k").cast("string").cast("binary")), "rendered")
        return plans.derive(marked, Library(), processed_ms=0)

    def run(spark, d):
        return plans.events(derived(spark, d)).select(F.unhex("record_id").cast("string").cast("bigint").alias("k"), "grammar", *_COLUMNS)

    RENDERED[name] = derived
    run.__name__ = f"rendered_{name}"
    query(f"SELECT o_orderkey AS k, '{name.replace('_', '.')}' AS grammar, {columns} FROM orders")(run)


_DATE = "date_format(timestamp_seconds(1700000000 + o_orderkey), '{}')"

rendered("panos_traffic", "concat('1,', " + _DATE.format("yyyy/MM/dd HH:mm:ss") + ", ',77,TRAFFIC,end,1,', " + _DATE.format("yyyy/MM/dd HH:mm:ss") + """, ',', {src}, ',', {dst}, ',,,"Web, all",',
    {user}, ',,ssl,vs1,trust,untrust,e1,e2,fwd,1,55,1,', {sp}, ',', {dp}, ',0,0,0x1,tcp,', {word}, ',', {n} + {m}, ',', {n}, ',', {m}, ',9,s,4,any')""",
    ("allow", "reset-both"), (1, 8), {
        "src_ip": "{src}", "src_port": "{sp}", "dst_ip": "{dst}", "dst_port": "{dp}", "protocol": "'tcp'", "app": "'ssl'", "bytes_total": "{n} + {m}", "bytes_out": "{n}",
        "bytes_in": "{m}", "user_name": "{user}", "rule": "'Web, all'", "severity_id": "1",
        "unmapped": """'{"receive_time":"' || strftime(make_timestamp((1700000000 + o_orderkey) * 1000000), '%Y/%m/%d %H:%M:%S') || '","log_type":"TRAFFIC","subtype":"end","virtual_system":"vs1",' ||
           '"outbound_interface":"e2","log_profile":"fwd","repeat_count":1,"nat_source_port":"0","nat_destination_port":"0","flags":"0x1","session_start":"s","url_category":"any"}'""",
    })
rendered("fortigate_traffic", """concat('devname="f 1" type="traffic" eventtime=', {t}, ' srcip=', {src}, ' srcport=', {sp}, ' dstip=', {dst}, ' dstport=', {dp}, ' app="two words" srcuser="', {user},
    '" policyname=p1 action="', {word}, '" sentbyte=', {n}, ' rcvdbyte=', {m}, ' odd=')""", ("accept", "deny"), (1, 2), {
        "src_ip": "{src}", "src_port": "{sp}", "dst_ip": "{dst}", "dst_port": "{dp}", "app": "'two words'", "bytes_out": "{n}", "bytes_in": "{m}", "user_name": "{user}", "rule": "'p1'",
        "device": "'f 1'", "severity_id": "1", "unmapped": """'{"type":"traffic","odd":""}'""",
    })
rendered("checkpoint_firewall", "concat('<134>Nov 14 22:13:20 gw time=', {t}, '|action=', {word}, '|origin=gw|src=', {src}, '|s_port=', {sp}, '|dst=', {dst}, '|service=', {dp}, '|proto=udp|bytes=', {n}, '|rule_name=a b|user=', {user})",
    ("drop", "reject"), (3, 2), {
        "src_ip": "{src}", "src_port": "{sp}", "dst_ip": "{dst}", "dst_port": "{dp}", "protocol": "'udp'", "bytes_total": "{n}", "user_name": "{user}", "rule": "'a b'", "device": "'gw'",
        "severity_id": "1", "unmapped": """'{"log_facility":16,"log_severity":"info","log_time":"Nov 14 22:13:20","log_host":"gw"}'""",
    })
rendered("suricata_alert", """concat('{"timestamp": "', """ + _DATE.format("yyyy-MM-dd") + """, 'T', """ + _DATE.format("HH:mm:ss") + """, '.250000+0100", "event_type": "alert", "src_ip": "', {src}, '", "src_port": ', {sp},
    ', "dest_ip": "', {dst}, '", "dest_port": ', {dp}, ', "proto": "TCP", "host": "s1", "alert": {"action": "', {word}, '", "signature_id": 7, "severity": ', o_custkey % 4 + 1, '}, "n": [1, 2]}')""",
    ("allowed", "blocked"), (1, 2), {
        "time_ms": "{t} * 1000 - 3600000 + 250", "src_ip": "{src}", "src_port": "{sp}", "dst_ip": "{dst}", "dst_port": "{dp}", "protocol": "'TCP'", "device": "'s1'",
        "severity_id": "CASE o_custkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END", "unmapped": """'{"event_type":"alert","n":"[1,2]"}'""",
    })
rendered("squid_access", "concat({t}, '.125    ', {n}, ' ', {src}, ' ', {word}, ' ', {m}, ' GET http://x/', o_orderkey, ' ', {user}, ' HIER/1 text/html')", ("TCP_MISS/200", "TCP_DENIED/403"), (1, 2), {
        # seconds are read as a double, as an event's time is
        "time_ms": "CAST((CAST({t} AS DOUBLE) + 0.125) * 1e9 AS BIGINT) // 1000000", "src_ip": "{src}", "bytes_total": "{m}", "user_name": "{user}", "unmapped": """'{"hierarchy":"HIER/1","content_type":"text/html"}'""",
    }, odd="TCP_MEM_HIT/304")
rendered("generic_leef", r"""concat('LEEF:2.0|Acme|Box|1|e7|src=', {src}, '\tsrcPort=', {sp}, '\tdst=', {dst}, '\tdstPort=', {dp}, '\tproto=tcp\ttotalBytes=', {n}, '\tusrName=', {user}, '\taction=', {word}, '\tdevTime=', {t} * 1000, '\tmore=a b')""",
    ("permit", "drop"), (1, 3), {
        "src_ip": "{src}", "src_port": "{sp}", "dst_ip": "{dst}", "dst_port": "{dp}", "protocol": "'tcp'", "bytes_total": "{n}", "user_name": "{user}", "unmapped": """'{"leef_version":"2.0","more":"a b"}'""",
    })
rendered("generic_cef", r"""concat('CEF:0|Acme|Box|1|7|Name|', o_custkey % 11, '|src=', {src}, ' spt=', {sp}, ' dst=', {dst}, ' dpt=', {dp}, ' proto=tcp in=', {m}, ' out=', {n}, ' suser=', {user}, ' act=', {word}, ' msg=three more words')""",
    ("permit", "reset"), (1, 8), {
        "time_ms": "1800000000000", "src_ip": "{src}", "src_port": "{sp}", "dst_ip": "{dst}", "dst_port": "{dp}", "protocol": "'tcp'", "bytes_in": "{m}", "bytes_out": "{n}", "user_name": "{user}",
        "severity_id": "CASE o_custkey % 11 WHEN 10 THEN 6 ELSE (o_custkey % 11) // 2 + 1 END", "unmapped": """'{"cef_version":"0","msg":"three more words"}'""",
    })
rendered("cisco_asa", "concat('<166>Nov 14 22:13:20 fw %ASA-6-302013: ', {word}, ' outbound TCP connection 9 for outside:', {dst}, '/', {dp}, ' (x) to inside:', {src}, '/', {sp}, ' (y)')", ("Built", "Denied"), (1, 2), {
        "time_ms": "1794694400000", "src_ip": "CASE WHEN true THEN {src} END", "src_port": "{sp}", "dst_ip": "{dst}", "dst_port": "{dp}",
        "protocol": "CASE WHEN o_orderstatus IN ('F', 'O') THEN 'TCP' END", "device": "'fw'", "severity_id": "1",
        "disposition_id": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END",
        "unmapped": """'{"log_facility":20,"log_severity":"info","asa_text":"' || CASE o_orderstatus WHEN 'F' THEN 'Built' WHEN 'O' THEN 'Denied' ELSE 'odd' END ||
           ' outbound TCP connection 9 for outside:' || {dst} || '/' || {dp} || ' (x) to inside:' || {src} || '/' || {sp} || ' (y)"' || CASE WHEN o_orderstatus IN ('F', 'O') THEN ',"direction":"outbound"' ELSE '' END || '}'""",
    })
rendered("pfsense_filterlog", "concat('<134>Nov 14 22:13:20 pf filterlog[9]: 5,,,1000,igb0,match,', {word}, ',in,4,0x0,,64,1,0,DF,6,tcp,', {n}, ',', {src}, ',', {dst}, ',', {sp}, ',', {dp})", ("pass", "block"), (1, 2), {
        "time_ms": "1794694400000", "src_ip": "{src}", "src_port": "{sp}", "dst_ip": "{dst}", "dst_port": "{dp}", "protocol": "'tcp'", "bytes_total": "{n}", "device": "'pf'",
        "unmapped": """'{"log_facility":16,"log_severity":"info","tracker":"1000","reason":"match","ip_version":"4","tos":"0x0","ttl":64,"packet_id":"1","fragment_offset":"0","flags":"DF","protocol_id":"6"}'""",
    })


@query("""SELECT o_orderkey AS k, v AS verdict, CASE o_orderkey % 5 WHEN 0 THEN 'empty line' WHEN 1 THEN 'no grammar claims a freeform line' WHEN 2 THEN 'invalid JSON'
    WHEN 3 THEN 'time 9000 is outside a plausible range; check the clock spec' ELSE 'no grammar claims a kv line' END AS detail,
    CASE o_orderkey % 5 WHEN 2 THEN 'suricata.alert' WHEN 3 THEN 'squid.access' END AS best_guess,
    CASE o_orderkey % 5 WHEN 2 THEN 98 WHEN 3 THEN 94 ELSE 0 END AS confidence
  FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN 'extract_failed' WHEN 3 THEN 'invalid' ELSE 'unclaimed' END AS v FROM orders)""")
def rejections_told(spark, d):
    """Orders rendered as lines that come to nothing, each for a reason of its own."""
    line = """CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('the order ', o_orderkey, ' is nothing we know') WHEN 2 THEN concat('{"event_type": "alert", "k" ', o_orderkey, '}')
      WHEN 3 THEN concat('9 5 10.0.0.1 TCP_HIT/200 ', o_orderkey, ' GET http://x/1 - h t') ELSE concat('a=', o_orderkey, ' b=2 c=3 d=4') END"""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.expr(line).cast("binary").alias("payload"), F.lit(0).alias("stratum"),
        F.expr("named_struct('channel', 0Y, 'peer', '', 'listener', '', 'received_ns', 1800000000000000000L, 'truncated', false)").alias("env"),
    )
    marked = materialize(rows.withColumn("id", F.col("k").cast("string").cast("binary")), "rendered")
    got = plans.rejections(plans.derive(marked, Library(), processed_ms=0))
    return got.select(
        F.unhex("record_id").cast("string").cast("bigint").alias("k"), "verdict", "detail", "best_guess", F.round(F.col("confidence") * 100).cast("int").alias("confidence")
    )


@query("""SELECT lower(hex(CAST(o_orderkey AS VARCHAR))) AS record_id, concat('CEF:0|Acme|Box|2.0.0|4001|generic.cef|',
    CASE o_custkey % 11 WHEN 10 THEN 6 ELSE (o_custkey % 11) // 2 + 1 END, '|rt=1800000000000 src=10.0.', o_custkey % 250, '.1 spt=', o_custkey % 60000 + 1,
    ' dst=192.0.2.', o_orderkey % 250, ' dpt=', o_orderkey % 1000 + 1, ' proto=tcp in=', o_custkey * 7, ' out=', o_orderkey * 3, ' suser=u', o_custkey % 50,
    ' act=', CASE o_orderstatus WHEN 'F' THEN 'permit' WHEN 'O' THEN 'reset' ELSE 'odd' END, ' recordId=', lower(hex(CAST(o_orderkey AS VARCHAR)))) AS value FROM orders""")
def sink_cef_rendered(spark, d):
    return sinks.cef_lines(plans.events(RENDERED["generic_cef"](spark, d)))


@query("""SELECT 10 AS grammars_total, 3.0::DOUBLE AS grammars_per_line, 1.0::DOUBLE AS shape_hit_rate, count(*) AS lines_triaged, 0.7::DOUBLE AS work_avoided FROM orders""")
def triage_rendered(spark, d):
    """JSON lines are held against the two JSON grammars and the one of free form."""
    got = inspect.selectivity(RENDERED["suricata_alert"](spark, d), len(Library().all()))
    return got.select(F.col("grammars_total").cast("int").alias("grammars_total"), *[F.col(c).cast("double").alias(c) for c in ("grammars_per_line", "shape_hit_rate")], "lines_triaged", F.col("work_avoided").cast("double").alias("work_avoided"))


@query("""SELECT lower(hex(CAST(o_orderkey AS VARCHAR))) AS record_id, 4001 AS class_uid, '{"more":"a b"}' AS unmapped, '10.0.' || (o_custkey % 250) || '.1' AS src_ip,
    'generic.leef' AS grammar, 'replay' AS channel, o_orderkey * 3 AS bytes FROM orders""".replace('{"more"', '{"leef_version":"2.0","more"'))
def sink_documents_rendered(spark, d):
    """Documents as they are written, read back: parts of the event, what nothing mapped, and the chain of custody."""
    derived = RENDERED["generic_leef"](spark, d).withColumn("channel", F.lit(5).cast("tinyint"))
    v = F.parse_json("value")
    at = lambda path, kind: F.variant_get(v, path, kind)
    return sinks.documents(derived).select(
        at("$.custody.record_id", "string").alias("record_id"), at("$.class_uid", "int").alias("class_uid"), F.to_json(at("$.unmapped", "variant")).alias("unmapped"),
        at("$.src_endpoint.ip", "string").alias("src_ip"), at("$.custody.grammar", "string").alias("grammar"), at("$.custody.channel", "string").alias("channel"),
        at("$.traffic.bytes", "bigint").alias("bytes"),
    )


# --- induction ------------------------------------------------------------------------------------

@query("""SELECT kind, count(*) AS n FROM (SELECT CASE
    WHEN v IS NULL THEN NULL WHEN regexp_full_match(v, '[0-9]{1,5}') AND CAST(v AS BIGINT) BETWEEN 1 AND 65535 THEN 'port_or_int'
    WHEN regexp_full_match(v, '[0-9]{10}|[0-9]{13}') THEN 'epoch_or_int' WHEN regexp_full_match(v, '[0-9]+') THEN 'int'
    ELSE 'float' END AS kind
  FROM (SELECT CAST(l_orderkey * 97 AS VARCHAR) AS v FROM lineitem UNION ALL SELECT CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) FROM lineitem)) GROUP BY 1""")
def kinds_of_numbers(spark, d):
    rows = table(spark, d, "lineitem")
    values = rows.select(F.expr("cast(l_orderkey * 97 as string)").alias("v")).unionByName(rows.select(F.expr("cast(cast(l_quantity as decimal(18,2)) as string)").alias("v")))
    return S.with_columns(values, kind=induce.kind_of(S.col("v"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT key, count(*) AS total, least(count(DISTINCT v), 500) AS "distinct" FROM (
    SELECT 'k1' AS key, CAST(user_id AS VARCHAR) AS v FROM events UNION ALL SELECT 'k2', event_type FROM events) GROUP BY key""")
def profile_fields(spark, d):
    bodies = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.expr("concat('k1=', user_id, ' k2=', event_type)").alias("body"))
    return induce.profiles(induce.observed(bodies, "kv")).select("key", "total", F.col("distinct").cast("bigint").alias("distinct"))


@query()
def templates_of_lines(spark, d):
    rows = table(spark, d, "records").select(F.col("seq").alias("ord"), "payload", F.col("env.listener").alias("listener"))
    return induce.templates(induce.bodies(rows, "listener"), by="listener")


# --- streams, run until their input is used up -----------------------------------------------------

def _streamed(spark, df: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Write df, read it as a stream in several batches, and collect what the stream gives."""
    source = materialize(df.repartition(4), "stream-in").inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    built = build(stream)
    writer = built.writeStream.option("checkpointLocation", f"{where}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{where}/out").start().awaitTermination()
    else:
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{where}/out")
        writer.outputMode(mode).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(built.schema).parquet(f"{where}/out")


@query("SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS starts, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    rows = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    got = _streamed(spark, rows, lambda s: pipelines.windowed_counts(s, "ts", "event_type", late="100 years"), "complete")
    return got.select(F.unix_seconds("starts").alias("starts"), "event_type", "n")


@query("""WITH a AS (SELECT event_ns, event_ns - event_ns % 3600000000000 AS hour_ns, received_ns FROM (
    SELECT e.event_ns, min(r.env.received_ns) AS received_ns FROM (SELECT record_id, max(event_ns) AS event_ns FROM extractions GROUP BY 1) e
    JOIN records r ON lower(hex(r.id)) = e.record_id WHERE e.event_ns IS NOT NULL GROUP BY e.record_id, e.event_ns))
  SELECT hour_ns, count(*) FILTER (received_ns < hour_ns + 25200000000000) AS events, count(*) FILTER (received_ns >= hour_ns + 25200000000000) AS too_late
  FROM a GROUP BY 1""")
def stream_hours(spark, d):
    times = table(spark, d, "extractions").groupBy(F.unhex("record_id").alias("id")).agg(F.max("event_ns").alias("event_ns")).where("event_ns IS NOT NULL")
    came = table(spark, d, "records").groupBy("id").agg(F.min("env.received_ns").alias("arrival_ns"))
    got = _streamed(spark, times.join(came, "id").select("event_ns", "arrival_ns"), lambda s: pipelines.hourly(s, expire=False), "append")
    return got.groupBy("hour_ns").agg(F.sum(F.col("after") - F.col("before")).alias("events"), F.sum("too_late").alias("too_late"))


@query()
def stream_token_bucket(spark, d):
    rows = table(spark, d, "records").select("seq", F.coalesce("env.peer", F.lit("")).alias("peer"), F.col("env.received_ns").alias("received_ns"))
    return _streamed(spark, rows.where("received_ns IS NOT NULL"), lambda s: pipelines.rate_limited(s, 0.0005, 20, expire=False), "append")


# --- ratios ---------------------------------------------------------------------------------------

@query("""SELECT grammar, count(*) AS n, count(*) FILTER (src_ip IS NOT NULL) / count(*) AS with_source, avg(coverage::DOUBLE) AS coverage
  FROM lake GROUP BY grammar""")
def lake_ratios(spark, d):
    return table(spark, d, "lake").groupBy("grammar").agg(
        F.count("*").alias("n"), F.avg(F.col("src_ip").isNotNull().cast("int")).alias("with_source"), F.avg(F.col("coverage").cast("double")).alias("coverage")
    )
