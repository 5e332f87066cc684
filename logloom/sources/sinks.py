"""Where events go. Every sink is a write of its own: one that fails leaves the others alone."""

from __future__ import annotations

import socket

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import sql as S
from logloom.plans.derive import CHANNELS, LAKE


def documents(derived: DataFrame) -> DataFrame:
    """value: the JSON document of each mapped event, with what no mapping claimed and its chain of custody."""
    names = F.array(*map(F.lit, CHANNELS))
    rounded = lambda c: F.round(F.col(c).cast("double"), 3)
    custody = F.to_json(F.struct(
        "record_id", "stratum", "grammar", "grammar_version", rounded("confidence").alias("confidence"), "generation",
        rounded("coverage").alias("coverage"), F.get(names, F.col("channel").cast("int")).alias("channel"), "peer",
        F.col("received_ns").alias("received"), F.when(F.size("notes") > 0, F.col("notes")).alias("notes"),
    ))
    body = F.expr("substring(ocsf, 1, char_length(ocsf) - 1)")
    return derived.where("verdict = 'mapped'").select(
        F.concat(body, F.lit(',"unmapped":'), "unmapped", F.lit(',"custody":'), custody, F.lit("}")).alias("value")
    )


def write_ndjson(derived: DataFrame, path: str, mode: str = "append") -> None:
    documents(derived).write.mode(mode).text(path)


def note(spark, path: str, actor: str, action: str, detail: str = "") -> None:
    """Append to the log of what was done and by whom: at, actor, action, detail."""
    row = spark.createDataFrame([(actor, action, detail)], "actor string, action string, detail string")
    row.select(F.current_timestamp().alias("at"), "*").write.mode("append").parquet(path)


def lake(events: DataFrame, by: str = "time") -> DataFrame:
    """Events with the partition columns of the lake: date (UTC, of the event or of processing) and source."""
    day = F.to_date(F.timestamp_millis("time_ms")) if by == "time" else F.current_date()
    return events.select(*LAKE, day.alias("date"), F.substring_index("grammar", ".", 1).alias("source"))


def write_lake(events: DataFrame, path: str, mode: str = "append", by: str = "time") -> None:
    """Parquet by date and source. Rows are brought together by both in an exchange that Spark balances by measured size:
    small partitions are joined, and a busy source is split over as many tasks as it needs."""
    (
        lake(events, by).hint("rebalance", "date", "source").write.mode(mode).option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#record_id", "true").partitionBy("date", "source").parquet(path)
    )


#: Extension keys of the CEF outlet and the paths they come from.
CEF_EXTENSION = {
    "src": "$.src_endpoint.ip", "spt": "$.src_endpoint.port", "dst": "$.dst_endpoint.ip", "dpt": "$.dst_endpoint.port",
    "proto": "$.connection_info.protocol_name", "in": "$.traffic.bytes_in", "out": "$.traffic.bytes_out",
    "suser": "$.actor.user.name", "deviceInboundInterface": "$.src_endpoint.interface_name",
}


def cef_lines(events: DataFrame, identity_key: str = "recordId") -> DataFrame:
    """record_id, value: a CEF line for each event, escaped as its format asks."""
    lit = S.lit

    def head(x: S.E) -> S.E:
        return S.replace(S.replace(S.replace(x, lit("\\"), lit("\\\\")), lit("|"), lit("\\|")), lit("\n"), lit(" "))

    def ext(x: S.E) -> S.E:
        plain = S.replace(S.replace(x, lit("\\"), lit("\\\\")), lit("="), lit("\\="))
        return S.replace(S.replace(plain, lit("\n"), lit("\\n")), lit("\r"), lit(""))

    def at(path: str) -> S.E:
        return S.try_variant_get("v", lit(path), lit("string"))

    parts = [S.concat(lit("rt="), S.col("time_ms").cast("string"))]
    parts += [S.concat(lit(f"{key}="), ext(at(path))) for key, path in CEF_EXTENSION.items()]
    parts += [
        S.concat(lit("act="), ext(S.coalesce(at("$.disposition_orig"), at("$.disposition_id")))),
        S.concat(lit(f"{identity_key}="), S.col("record_id")),
    ]
    name = S.coalesce(at("$.activity_name"), S.col("grammar"))
    header = S.concat_ws(
        lit("|"), lit("CEF:0"), head(S.coalesce("vendor", lit("Unknown"))), head(S.coalesce("product", lit("Unknown"))),
        head(S.col("grammar_version")), S.col("class_uid").cast("string"), head(name), S.coalesce(S.col("severity_id"), lit(1)).cast("string"),
    )
    line = S.concat(header, lit("|"), S.concat_ws(lit(" "), *parts))
    return events.withColumn("v", F.try_parse_json("ocsf")).select("record_id", S.column(line).alias("value"))


def write_cef(events: DataFrame, path: str, mode: str = "append") -> None:
    cef_lines(events).select("value").write.mode(mode).text(path)


def send_cef(events: DataFrame, host: str, port: int, most: int = 8192) -> DataFrame:
    """Send each event as one datagram; a row for each task with what was sent and what was too long for `most` bytes. The
    result is to be acted on (collected, written) for anything to be sent, and may be sent twice if a task is tried again."""
    def run(batches):
        sent = long = 0
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for b in batches:
                for value in b.column("value").to_pylist():
                    data = value.encode("utf-8")
                    if len(data) > most:
                        long += 1
                    else:
                        out.sendto(data, (host, port))
                        sent += 1
        yield pa.RecordBatch.from_arrays([pa.array([sent], pa.int64()), pa.array([long], pa.int64())], ["sent", "too_long"])

    return cef_lines(events).select("value").mapInArrow(run, "sent bigint, too_long bigint")


def recent(events: DataFrame, limit: int = 100, grammar: str | None = None) -> DataFrame:
    """The newest events first; of equal times by record."""
    chosen = events if grammar is None else events.where(F.col("grammar") == grammar)
    return chosen.orderBy(F.desc("time_ms"), "record_id").limit(limit)


def register(events: DataFrame, name: str = "events") -> DataFrame:
    """The view that user SQL runs over."""
    events.createOrReplaceTempView(name)
    return events
