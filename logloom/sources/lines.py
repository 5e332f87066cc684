"""Raw lines into deliveries, and what may enter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Channel numbers, the size limit of a delivery, and the length at which network syslog may be cut.
CHANNELS = {"file": 0, "syslog_udp": 1, "syslog_tcp": 2, "syslog_tls": 3, "http": 4, "replay": 5}
MAX_BYTES, CUT_AT = 65_535, 1024


def files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """payload of each non-empty line; lines end at line feeds alone, carriage returns at the end go, bytes stay."""
    reader = spark.readStream if stream else spark.read
    line = F.col("value").cast("binary")
    text = reader.option("lineSep", "\n").text(path).select(F.regexp_replace(F.hex(line), "(?:0D)+$", "").alias("h"))
    return text.where("h <> ''").select(F.unhex("h").alias("payload"))


def enveloped(lines: DataFrame, channel: str = "file", peer: str = "", listener: str = "", received_ns=None) -> DataFrame:
    """Adds env: the facts of receipt. truncated marks UDP and TCP deliveries of 1,024 bytes and more."""
    number = CHANNELS[channel]
    received = F.unix_micros(F.current_timestamp()) * 1000 if received_ns is None else F.lit(received_ns)
    cut = (F.octet_length("payload") >= CUT_AT) & F.lit(channel in ("syslog_udp", "syslog_tcp"))
    return lines.withColumn("env", F.struct(
        F.lit(number).cast("tinyint").alias("channel"), F.lit(peer).alias("peer"), F.lit(listener).alias("listener"),
        received.cast("bigint").alias("received_ns"), cut.alias("truncated"),
    ))


def posted(bodies: DataFrame) -> DataFrame:
    """payload of each line of bodies that were posted (column body, binary; other columns stay): lines end at line feeds
    alone, carriage returns at their end go, empty lines go, bytes stay."""
    digits = F.regexp_replace(F.hex("body"), "(..)", "$1 ")
    line = F.explode(F.split(digits, "0A ")).alias("h")
    kept = [c for c in bodies.columns if c != "body"]
    bare = F.regexp_replace(F.regexp_replace("h", "(?:0D )+$", ""), " ", "")
    return bodies.select(*kept, line).withColumn("h", bare).where("h <> ''").select(*kept, F.unhex("h").alias("payload"))


def not_blank(lines: DataFrame) -> DataFrame:
    """Without payloads of ASCII white space alone."""
    return lines.where(~F.hex("payload").rlike("^(?:09|0A|0B|0C|0D|20)*$"))


def admitted(deliveries: DataFrame, allow: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds refused: unknown_source, oversize or null, in this order. No allow list lets all peers in."""
    refused = F.when(F.octet_length("payload") > max_bytes, "oversize")
    if allow:
        refused = F.when(~F.coalesce(F.col("env.peer").isin(*allow), F.lit(False)), "unknown_source").when(F.octet_length("payload") > max_bytes, "oversize")
    return deliveries.withColumn("refused", refused)


class Bucket:
    """Tokens of one peer; time in nanoseconds, and never backwards."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst, self.tokens, self.at = float(rate), float(burst), float(burst), None

    def take(self, now: int) -> bool:
        if self.at is not None and now > self.at:
            self.tokens = min(self.burst, self.tokens + (now - self.at) / 1e9 * self.rate)
        self.at = now if self.at is None else max(self.at, now)
        if self.tokens >= 1:
            self.tokens -= 1
            return True
        return False


def rate_limited(deliveries: DataFrame, rate: float = 50_000.0, burst: float = 100_000.0, key: str = "seq") -> DataFrame:
    """key, peer, admitted: the token bucket of each peer over its deliveries by receipt.

    A bucket is a chain of decisions, so a peer is one task; it streams through in order and keeps two numbers."""
    ordered = (
        deliveries.select(F.col(key).alias("k"), F.col("env.peer").alias("peer"), F.coalesce("env.received_ns", F.lit(0)).alias("at"))
        .repartition("peer").sortWithinPartitions("peer", "at", "k")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peer, bucket = None, Bucket(rate, burst)
        for b in batches:
            out = []
            for p, at in zip(b.column("peer").to_pylist(), b.column("at").to_pylist()):
                if p != peer:
                    peer, bucket = p, Bucket(rate, burst)
                out.append(bucket.take(at))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("peer"), pa.array(out, pa.bool_())], [key, "peer", "admitted"])

    return ordered.mapInArrow(run, f"{key} bigint, peer string, admitted boolean")


def intake_stats(deliveries: DataFrame) -> DataFrame:
    """outcome, n: accepted, the refusals by kind, and truncated."""
    outcome = F.coalesce("refused", F.lit("accepted"))
    counted = deliveries.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
    cut = deliveries.where("refused IS NULL AND env.truncated").agg(F.count("*").alias("n")).select(F.lit("truncated").alias("outcome"), "n")
    return counted.unionByName(cut)


def top_peers(deliveries: DataFrame, k: int = 10) -> DataFrame:
    """peer, n of the k peers with most deliveries, ties by name."""
    return deliveries.groupBy(F.col("env.peer").alias("peer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("peer")).limit(k)
