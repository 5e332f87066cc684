"""Queries of the general data problems p1 to p5 over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.operators import clocks, late, loglines, rejects, skew
from logloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.rejected(table(spark, folder, "records"), table(spark, folder, "grammars"))


def p1_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.loaded(table(spark, folder, "records"), table(spark, folder, "grammars"))


def p1_metrics(spark: SparkSession, folder: str) -> DataFrame:
    names = ("records", "metrics", "grammars")
    return rejects.recounted(*(table(spark, folder, n) for n in names))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_readings(spark, folder).where("status <> 'no_time'").select("reading_id", "event_ns")


def p2_readings(spark: SparkSession, folder: str) -> DataFrame:
    return clocks.normalized(table(spark, folder, "clock_readings"), table(spark, folder, "clocks"))


def p2_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose times were written day first or month first, as their source has it, and came without receipt: what
    a text such as 03/04/2024 means is told by the mixture of its source alone."""
    day_first = "pmod(xxhash64(event_type), 2) = 0"
    text = f"date_format(ts, if({day_first}, 'dd/MM/yyyy HH:mm:ss', 'MM/dd/yyyy HH:mm:ss'))"
    source = F.dense_rank().over(Window.orderBy("event_type")).alias("clock_id")
    events = table(spark, folder, "events")
    kinds = events.select("event_type").distinct().select("event_type", source)  # a row for each of a few kinds
    readings = events.join(kinds, "event_type").selectExpr("event_id AS reading_id", "clock_id", f"{text} AS original_time", "CAST(NULL AS BIGINT) AS received_ns")
    declared = kinds.selectExpr("clock_id", "array('day_first', 'month_first') AS formats", "'UTC' AS zone_name")
    return clocks.normalized(readings, declared).select("reading_id", "event_ns")


def _revisions(spark: SparkSession, folder: str) -> DataFrame:
    return late.judged(table(spark, folder, "extractions"), table(spark, folder, "records"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return late.fates(_revisions(spark, folder))


def p3_hours(spark: SparkSession, folder: str) -> DataFrame:
    return late.hours(_revisions(spark, folder))


def p3_revisions(spark: SparkSession, folder: str) -> DataFrame:
    return late.revisions_of_hours(_revisions(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    fields = {
        "peer": (table(spark, folder, "records"), F.col("env.peer")),
        "grammar": (table(spark, folder, "lake"), F.col("grammar")),
    }
    return skew.hot_keys(fields).select("field", "hot_key")


def p4_peers(spark: SparkSession, folder: str) -> DataFrame:
    """Per peer: deliveries joined with the lake rows of their record, and the bytes of those rows."""
    joined = skew.eager_join(
        table(spark, folder, "records"), table(spark, folder, "lake"),
        on={"id": (F.col("id"), F.try_to_binary("record_id", F.lit("hex")))},
        roll_up={"peer": F.col("env.peer")},
        left_measures=[skew.Measure("raw_bytes", F.col("raw_len"))],
        right_measures=[skew.Measure("total_bytes", F.col("bytes_total"))],
    )
    return joined.select("peer", *[F.col(c).cast("bigint").alias(c) for c in ("joined_rows", "left_rows", "raw_bytes", "total_bytes")])


def p4_grammars(spark: SparkSession, folder: str) -> DataFrame:
    """Per grammar: lake rows joined with extractions, hot with hot, without a pair being made."""
    joined = skew.eager_join(
        table(spark, folder, "lake"), table(spark, folder, "extractions"),
        on={"grammar": (F.col("grammar"), F.col("grammar"))},
        left_measures=[skew.Measure("total_bytes", F.col("bytes_total"))],
        right_measures=[skew.Measure("generations", F.col("generation"))],
    )
    numbers = ("joined_rows", "left_rows", "right_rows", "total_bytes", "generations")
    return joined.select("grammar", *[F.col(c).cast("bigint").alias(c) for c in numbers])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return loglines.entries(table(spark, folder, "app_lines"))


def p5_entries(spark: SparkSession, folder: str) -> DataFrame:
    return loglines.entries(table(spark, folder, "app_lines"), texts=True)


def p5_unparsed(spark: SparkSession, folder: str) -> DataFrame:
    return loglines.unparsed(table(spark, folder, "app_lines"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_loaded": p1_loaded,
    "p1_metrics": p1_metrics,
    "p2_found": p2_found,
    "p2_readings": p2_readings,
    "p2_formats": p2_formats,
    "p3_found": p3_found,
    "p3_hours": p3_hours,
    "p3_revisions": p3_revisions,
    "p4_found": p4_found,
    "p4_peers": p4_peers,
    "p4_grammars": p4_grammars,
    "p5_found": p5_found,
    "p5_entries": p5_entries,
    "p5_unparsed": p5_unparsed,
}

_ARRIVALS = """
WITH told AS (
  SELECT record_id, event_ns, row_number() OVER (PARTITION BY record_id ORDER BY generation DESC, event_ns DESC NULLS LAST) AS k
  FROM extractions
), came AS (
  SELECT lower(hex(id)) AS record_id, min(env.received_ns) AS arrival_ns FROM records GROUP BY 1
), judged AS (
  SELECT record_id, event_ns - event_ns % 3600000000000 AS hour_ns, arrival_ns,
         event_ns - event_ns % 3600000000000 + 3600000000000 AS end_ns
  FROM told JOIN came USING (record_id) WHERE k = 1 AND event_ns IS NOT NULL
)"""

SQL: dict[str, str] = {
    "p2_formats": "SELECT event_id AS reading_id, epoch_us(date_trunc('second', ts)) * 1000 AS event_ns FROM events",
    "p3_found": _ARRIVALS + """
SELECT record_id, CASE WHEN arrival_ns >= end_ns + 21600000000000 THEN 'too_late' ELSE 'correction' END AS fate
FROM judged WHERE arrival_ns >= end_ns + 600000000000""",
    "p3_hours": _ARRIVALS + """
SELECT hour_ns, count(*) FILTER (arrival_ns < end_ns + 600000000000) AS published,
       count(*) FILTER (arrival_ns < end_ns + 21600000000000) AS corrected,
       count(DISTINCT CASE WHEN arrival_ns >= end_ns + 600000000000 AND arrival_ns < end_ns + 21600000000000
                           THEN (arrival_ns - end_ns - 600000000000) // 600000000000 END) AS corrections,
       count(*) FILTER (arrival_ns >= end_ns + 21600000000000) AS too_late
FROM judged GROUP BY hour_ns""",
    "p3_revisions": _ARRIVALS + """, rounds AS (
  SELECT hour_ns, greatest(-1, CASE WHEN arrival_ns < end_ns + 600000000000 THEN -1
                                    ELSE (arrival_ns - end_ns - 600000000000) // 600000000000 END) AS round, count(*) AS n
  FROM judged WHERE arrival_ns < end_ns + 21600000000000 GROUP BY 1, 2
)
SELECT hour_ns, hour_ns + 3600000000000 + 600000000000 + (round + 1) * 600000000000 AS revised_ns,
       CAST(sum(n) OVER (PARTITION BY hour_ns ORDER BY round) AS BIGINT) AS events
FROM rounds""",
    "p4_found": """
SELECT 'peer' AS field, env.peer AS hot_key FROM records GROUP BY env.peer
HAVING env.peer IS NOT NULL AND count(*) >= 0.05 * (SELECT count(*) FROM records)
UNION ALL
SELECT 'grammar', grammar FROM lake GROUP BY grammar
HAVING grammar IS NOT NULL AND count(*) >= 0.05 * (SELECT count(*) FROM lake)""",
    "p4_peers": """
WITH joined AS (
  SELECT r.env.peer AS peer, r.id AS id, r.seq AS seq, r.raw_len AS raw_len, l.bytes_total AS bytes_total
  FROM records r JOIN lake l ON lower(hex(r.id)) = lower(l.record_id)
)
SELECT peer, count(*) AS joined_rows, count(DISTINCT seq) AS left_rows, CAST(sum(raw_len) AS BIGINT) AS raw_bytes,
       CAST(sum(bytes_total) AS BIGINT) AS total_bytes
FROM joined GROUP BY peer""",
    "p4_grammars": """
WITH l AS (SELECT grammar, count(*) AS n FROM lake GROUP BY 1), e AS (SELECT grammar, count(*) AS n FROM extractions GROUP BY 1)
SELECT lake.grammar AS grammar, count(*) AS joined_rows, any_value(l.n) AS left_rows, any_value(e.n) AS right_rows,
       CAST(sum(lake.bytes_total) AS BIGINT) AS total_bytes, CAST(sum(extractions.generation) AS BIGINT) AS generations
FROM lake JOIN extractions ON lake.grammar = extractions.grammar JOIN l ON l.grammar = lake.grammar JOIN e ON e.grammar = lake.grammar
GROUP BY 1""",
}
