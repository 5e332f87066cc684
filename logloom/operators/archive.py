"""The archive: payloads under their SHA-256, sealed by Merkle roots, audited and derived again.

Identity is the hash of the payload alone, so a delivery of known bytes adds to `seen` and nothing else; the
envelope of the first arrival stays. Records are ordered by seq and cut into segments by raw bytes, each with the
root over its ids in order and the root before it. Roots are folded in blocks of a power of two, so a level of
the plan takes ten levels of the tree, and a stratum's size is bounded by its budget.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions import sql as S
from logloom.plans import derive as plans
from logloom.plans.grammar import Library
from logloom.storage import materialize

STRATUM_BYTES = 64 << 20
LEVELS = 10  # of the tree in one step
BLOCK = 1 << LEVELS
EMPTY_ROOT = bytes(32)


# --- storing --------------------------------------------------------------------------------------

def identified(deliveries: DataFrame) -> DataFrame:
    """Adds id, the SHA-256 of the payload's bytes. A null payload is the empty one."""
    return deliveries.withColumn("payload", F.coalesce("payload", F.lit(b""))).withColumn("id", F.unhex(F.sha2("payload", 256)))


def stored(deliveries: DataFrame, archive: DataFrame | None = None, budget: int = STRATUM_BYTES) -> DataFrame:
    """New archive rows for deliveries (payload, env, ord): id, payload, env, stratum, seq, raw_len, seen.

    Deliveries of one id fall together before the exchange; what the archive holds already is left out. New rows go on
    behind the archive's last seq, in segments of their own: sealed ones stay as they are."""
    first = (
        identified(deliveries).groupBy("id")
        .agg(F.min_by(F.struct("payload", "env"), "ord").alias("first"), F.min("ord").alias("ord"), F.count("*").alias("seen"))
        .select("id", "first.payload", "first.env", "ord", F.octet_length("first.payload").cast("bigint").alias("raw_len"), "seen")
    )
    if archive is None:
        return numbered(first, budget)
    last = archive.agg(F.max("seq").alias("seq"), F.max("stratum").alias("stratum")).first()
    new = first.join(archive.select("id"), "id", "left_anti")
    return numbered(new, budget, -1 if last.seq is None else last.seq, -1 if last.stratum is None else last.stratum)


def numbered(rows: DataFrame, budget: int = STRATUM_BYTES, last_seq: int = -1, last_stratum: int = -1) -> DataFrame:
    """seq and stratum by ord, behind the last ones given, without bringing all rows to one task: ranges of ord are counted on their own and
    shifted by what lies before them."""
    spread = rows.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("ord", "id")
    # written, so that both readers see one cut into ranges
    counted = materialize(spread.withColumns({"at": F.row_number().over(within), "bytes": F.sum("raw_len").over(within)}), "archive-ranges")
    parts = counted.groupBy("part").agg(F.count("*").alias("n"), F.sum("raw_len").alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    # one row for each partition: its number is known and small
    joined = counted.join(F.broadcast(shifts), "part")
    upto = F.col("b0") + F.col("bytes") - F.col("raw_len")
    return joined.select(
        "id", "payload", "env", (F.lit(last_stratum + 1) + F.floor(upto / budget)).cast("int").alias("stratum"),
        (F.lit(last_seq) + F.col("n0") + F.col("at")).cast("bigint").alias("seq"), "raw_len", "seen",
    )


def seen_again(archive: DataFrame, deliveries: DataFrame) -> DataFrame:
    """The archive with `seen` raised by deliveries of known ids."""
    more = identified(deliveries).groupBy("id").agg(F.count("*").alias("more"))
    return archive.join(more, "id", "left").withColumn("seen", F.col("seen") + F.coalesce("more", F.lit(0))).drop("more")


# --- trees ----------------------------------------------------------------------------------------

def _sha(*parts) -> S.E:
    return S.unhex(S.sha2(S.concat(*parts), S.lit(256)))


def _up(level: S.E) -> S.E:
    """One level up: pairs are hashed, an odd last node is carried."""
    def node(i: S.E) -> S.E:
        left, right = S.get(level, i * 2), S.get(level, i * 2 + 1)
        return S.when(right.isNull(), left).otherwise(_sha(S.lit(b"\x01"), left, right))

    return S.transform(S.sequence(S.lit(0), S.expr(f"(size({level}) + 1) DIV 2 - 1")), lambda i: node(i))


def _fold(nodes: S.E, levels: int) -> S.E:
    for _ in range(levels):
        nodes = S.element_at(S.transform(S.array(nodes), lambda a: S.when(S.size(a) > 1, _up(a)).otherwise(a)), 1)
    return nodes


def leaves(records: DataFrame) -> DataFrame:
    """stratum, at (place in the stratum by seq, from 0), node. A stratum is no larger than its budget."""
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("seq")) - 1
    return records.select("stratum", place.alias("at"), S.column(_sha(S.lit(b"\x00"), S.col("id"))).alias("node"))


def roots(records: DataFrame, most: int = 1 << 30) -> DataFrame:
    """stratum, root, records: the root over the ids of each stratum."""
    level = leaves(records)
    size = BLOCK
    counts = records.groupBy("stratum").agg(F.count("*").alias("records"))
    while True:
        grouped = level.groupBy("stratum", F.expr(f"at DIV {BLOCK}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("nodes"))
        nodes = S.transform(S.col("nodes"), lambda x: x["node"])
        level = grouped.select("stratum", "at", S.column(S.get(_fold(nodes, LEVELS), 0)).alias("node"))
        if size >= most:
            break
        size *= BLOCK
    return level.select("stratum", F.col("node").alias("root")).join(counts, "stratum")


def sealed(records: DataFrame, sealed_ns: int = 0, before: bytes = EMPTY_ROOT) -> DataFrame:
    """stratum, prev_root, root, records, sealed_ns: the chain of segments behind the root given, a row each."""
    chain = F.lag("root").over(Window.orderBy("stratum"))  # one row a stratum
    return roots(records).select(
        "stratum", F.coalesce(chain, F.lit(before)).alias("prev_root"), "root", "records", F.lit(sealed_ns).cast("bigint").alias("sealed_ns")
    )


@dataclass(frozen=True)
class Proof:
    record_id: bytes
    stratum: int
    root: bytes
    path: tuple[tuple[str, bytes], ...]

    def encoded(self) -> list[str]:
        return [f"{side}:{node.hex()}" for side, node in self.path]


def node_hash(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def leaf_hash(record_id: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + record_id).digest()


def verify(record_id: bytes, path: list[tuple[str, bytes]] | tuple, root: bytes) -> bool:
    at = leaf_hash(record_id)
    for side, node in path:
        if side not in ("L", "R"):
            return False
        at = node_hash(node, at) if side == "L" else node_hash(at, node)
    return at == root


def decoded_path(items: list[str]) -> list[tuple[str, bytes]]:
    out = []
    for item in items:
        side, mark, node = item.partition(":")
        if side not in ("L", "R") or not mark or len(node) != 64:
            raise ValueError(f"malformed proof step: {item!r}")
        out.append((side, bytes.fromhex(node)))
    return out


def prove(records: DataFrame, record_id: bytes) -> Proof | None:
    """The path from a record to its stratum's root; None for an unknown id. At each step of ten levels the driver
    sees one block of at most 1,024 nodes."""
    hit = records.where(F.col("id") == F.lit(record_id)).select("stratum", "seq").orderBy("seq").first()
    if hit is None:
        return None
    level = leaves(records.where(F.col("stratum") == hit.stratum))
    at = records.where((F.col("stratum") == hit.stratum) & (F.col("seq") < hit.seq)).count()
    path: list[tuple[str, bytes]] = []
    while True:
        block = at // BLOCK
        rows = level.where(F.expr(f"at DIV {BLOCK}") == block).orderBy("at").select("node").collect()
        nodes, here = [bytes(r.node) for r in rows], at % BLOCK
        for _ in range(LEVELS):
            if len(nodes) > 1:
                mate = here ^ 1
                if mate < len(nodes):
                    path.append(("L" if mate < here else "R", nodes[mate]))
                nodes = [node_hash(*nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
            here //= 2
        if level.where(F.col("at") >= BLOCK).isEmpty():
            return Proof(record_id, hit.stratum, nodes[0], tuple(path))
        grouped = level.groupBy(F.expr(f"at DIV {BLOCK}").alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("nodes"))
        level = grouped.select("at", S.column(S.get(_fold(S.transform(S.col("nodes"), lambda x: x["node"]), LEVELS), 0)).alias("node"))
        at = block


class Busy(Exception):
    """Another writer holds the archive."""


class Ledger:
    """An archive in a folder that all executors share, written by one writer at a time.

    An append is a numbered part of three tables: records (new bytes), again (deliveries of known ids) and segments (the
    seals of the new records, which go on from the last one). The part of segments is written last and commits the
    append: parts without it are not read, and are written over when the append is tried again. An append of a number
    that is committed already does nothing, so a stream's batches can be repeated."""

    RECORDS = "id binary, payload binary, env struct<channel:tinyint,peer:string,listener:string,received_ns:bigint,truncated:boolean>, stratum int, seq bigint, raw_len bigint, seen bigint"
    SEGMENTS = "stratum int, prev_root binary, root binary, records bigint, sealed_ns bigint"

    def __init__(self, spark: SparkSession, path: str, budget: int = STRATUM_BYTES):
        self.spark, self.path, self.budget = spark, path.rstrip("/"), budget

    def _at(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def parts(self) -> list[int]:
        """Numbers of the committed appends."""
        fs, where = self._at("segments")
        found = fs.listStatus(where) if fs.exists(where) else []
        names = [s.getPath().getName() for s in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("part="))

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{name}/part={n}" for n in self.parts()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def records(self) -> DataFrame:
        """Every record, `seen` raised by later deliveries."""
        more = self._read("again", "id binary, more bigint").groupBy("id").agg(F.sum("more").alias("more"))
        return self._read("records", self.RECORDS).join(more, "id", "left").withColumn("seen", F.col("seen") + F.coalesce("more", F.lit(0))).drop("more")

    def segments(self) -> DataFrame:
        return self._read("segments", self.SEGMENTS)

    def append(self, deliveries: DataFrame, number: int | None = None, sealed_ns: int = 0) -> DataFrame:
        """Store deliveries (payload, env, ord) and seal them; the new records, each id once."""
        fs, lock = self._at("_writer")
        if not fs.createNewFile(lock):
            raise Busy(f"{self.path} has a writer; remove {lock.getName()} if it is gone")
        try:
            known = self.parts()
            number = (known[-1] + 1 if known else 0) if number is None else number
            if number not in known:
                self._write(deliveries, number, sealed_ns)
        finally:
            fs.delete(lock, False)
        return self.spark.read.schema(self.RECORDS).parquet(f"{self.path}/records/part={number}")

    def _write(self, deliveries: DataFrame, number: int, sealed_ns: int) -> None:
        held, before = self._read("records", self.RECORDS), self.segments()

        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/part={number}")

        put(stored(deliveries, held, self.budget), "records")
        put(identified(deliveries).groupBy("id").agg(F.count("*").alias("more")).join(held.select("id"), "id", "left_semi"), "again")
        new = self.spark.read.schema(self.RECORDS).parquet(f"{self.path}/records/part={number}")
        last = before.orderBy(F.desc("stratum")).select("root").first()
        put(sealed(new, sealed_ns, bytes(last.root) if last else EMPTY_ROOT), "segments")


# --- audit and replay -----------------------------------------------------------------------------

def faults(records: DataFrame, segments: DataFrame, sample: int | None = None) -> DataFrame:
    """stratum, kind, record_id: content_mismatch (bytes that are not their id), root_mismatch, chain_break.

    With a sample only the whole segments are audited that the first so many records lie in: a root is never held against a
    part of its segment."""
    if sample is not None:
        counts = segments.select("stratum", F.sum("records").over(Window.orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
        # a row a segment; those whose predecessors do not fill the sample
        chosen = counts.where(F.coalesce("before", F.lit(0)) < sample).select("stratum")
        records, segments = records.join(chosen, "stratum", "left_semi"), segments.join(chosen, "stratum", "left_semi")
    content = records.where(F.unhex(F.sha2("payload", 256)) != F.col("id")).select(
        "stratum", F.lit("content_mismatch").alias("kind"), F.lower(F.hex("id")).alias("record_id")
    )
    now = roots(records).select("stratum", F.col("root").alias("now"))
    none = F.lit(None).cast("string").alias("record_id")
    root = segments.where(F.col("root").isNotNull()).join(now, "stratum", "left").where(~F.col("root").eqNullSafe(F.col("now"))).select(
        "stratum", F.lit("root_mismatch").alias("kind"), none
    )
    before = F.coalesce(F.lag("root").over(Window.orderBy("stratum")), F.lit(EMPTY_ROOT))
    chain = segments.withColumn("before", before).where(~F.col("prev_root").eqNullSafe(F.col("before"))).select(
        "stratum", F.lit("chain_break").alias("kind"), none
    )
    return content.unionByName(root).unionByName(chain)


def fidelity(records: DataFrame) -> DataFrame:
    """One row: records, intact, fidelity (1 where there are none)."""
    intact = F.count_if(F.unhex(F.sha2("payload", 256)) == F.col("id"))
    return records.agg(F.count("*").alias("records"), intact.alias("intact")).withColumn(
        "fidelity", F.coalesce(F.col("intact") / F.nullif("records", F.lit(0)), F.lit(1.0))
    )


def spot_check(records: DataFrame, ids: DataFrame) -> DataFrame:
    """record_id, intact of the chosen ids (column id)."""
    return records.join(ids.select("id").distinct(), "id", "left_semi").select(
        F.lower(F.hex("id")).alias("record_id"), (F.unhex(F.sha2("payload", 256)) == F.col("id")).alias("intact")
    )


def totals(records: DataFrame) -> DataFrame:
    """stratum, records, raw_bytes, seen: what each stratum holds."""
    return records.groupBy("stratum").agg(F.count("*").alias("records"), F.sum("raw_len").alias("raw_bytes"), F.sum("seen").alias("seen"))


def rewound(
    records: DataFrame, library: Library, generation: int, stratum: int | None = None, processed_ms: int | None = None, limit: int | None = None
) -> DataFrame:
    """The archive derived again under the grammars of today: one row for each id, original receipt, replay channel.

    limit: only the records of the lowest so many seq. Nothing is written but the derivation itself: what is done with it is
    the caller's (see Rewind for a report)."""
    chosen = records if stratum is None else records.where(F.col("stratum") == stratum)
    once = chosen.groupBy("id").agg(F.min_by(F.struct("payload", "env", "stratum", "seq"), "seq").alias("r")).select("id", "r.payload", "r.env", "r.stratum", "r.seq")
    if limit is not None:
        once = once.orderBy("seq").limit(limit)
    return plans.derive(once.drop("seq"), library, generation=generation, processed_ms=processed_ms, replay=True)


@dataclass(frozen=True)
class Rewind:
    """What a replay came to. sample: up to twenty of its events."""

    generation: int
    dry_run: bool
    records: int
    remapped: int
    still_rejected: int
    by_grammar: dict[str, int]
    sample: list[dict]

    @staticmethod
    def run(records: DataFrame, library: Library, generation: int = 1, stratum: int | None = None, limit: int | None = None, sinks=(), dry_run: bool = True) -> "Rewind":
        """Derive again and report; the sinks (functions of the derivation) are served unless it is a dry run."""
        derived = rewound(records, library, generation, stratum, limit=limit)
        counts = {(r.verdict, r.grammar): r.n for r in derived.groupBy("verdict", "grammar").agg(F.count("*").alias("n")).collect()}
        good = {g: n for (v, g), n in sorted(counts.items(), key=str) if v == "mapped"}
        sample = plans.events(derived).orderBy("record_id").select("record_id", "grammar", "grammar_version", "coverage").limit(20).collect()
        if not dry_run:
            for sink in sinks:
                sink(derived)
        total = sum(counts.values())
        return Rewind(generation, dry_run, total, sum(good.values()), total - sum(good.values()), good, [r.asDict() for r in sample])
