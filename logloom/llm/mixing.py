"""A mixture of sources with target shares of the total size, by hash thresholds.

Every document has a uniform hash. Of a source, the documents whose hash lies below a threshold are taken once
more than the others, so two numbers for each source describe the mixture, and it is applied as a filter,
without sorting. Thresholds come from histograms: tokens are summed by source and hash bucket, the bucket in
which the running sum reaches the budget is found, and only the documents of that bucket are looked at again by
the next bits of the hash, until the hash is used up. A larger budget always takes a superset. Goals are a table, of
as many sources as there are; the driver sees the number of all tokens and nothing else.

A source's budget is its weight times the tokens of all texts. It is met with as many whole rounds over the
source as fit, and a part of one more round; max_repeats bounds the rounds. Of the two cuts around the budget
the nearer one holds (of equal ones the smaller). Sources without target, and the null source, are not taken;
targets without documents get nothing and are reported so. A null or negative weight is 0, a null max_repeats 1;
of a source named twice among the targets the larger (weight, max_repeats) counts. Null and empty texts have no
tokens: they are part of whole rounds and of the part below the threshold as any other document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.bpe import with_token_counts
from logloom.storage import discard, materialize

#: Bits of the hash for each round of refinement.
LEVELS = (16, 16, 16, 14)
BITS = sum(LEVELS)


def counted(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, hash, n_tokens, written to the shared folder: texts are read and encoded once."""
    hash_ = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS)
    rows = documents.select("doc_id", "source", hash_.alias("hash"), F.col("text").alias("body"))
    return materialize(with_token_counts(rows, "body", vocabulary), "mix-tokens")


def goals_of(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """A row for each target source (source, weight, max_repeats, available, budget, rounds, threshold, need, open), and the
    tokens of all texts. Hashes below the threshold are taken once more than `rounds`; need: tokens still to be found
    at or above it."""
    named = targets.where("source IS NOT NULL").select(
        "source", F.struct(F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.0).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("r")).alias("goal")
    ).groupBy("source").agg(F.max("goal").alias("goal"))
    sizes = rows.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    known = named.join(sizes, "source", "left").select(
        "source", F.col("goal.w").alias("weight"), F.col("goal.r").cast("int").alias("max_repeats"), F.coalesce("n", F.lit(0)).cast("bigint").alias("available")
    ).withColumn("budget", F.col("weight") * float(total))
    whole = F.coalesce(F.least(F.col("max_repeats"), F.floor(F.col("budget") / F.nullif("available", F.lit(0)))), F.lit(0)).cast("int")
    goals = known.withColumn("rounds", whole).withColumn("threshold", F.lit(0).cast("bigint")).withColumn(
        "need", F.when(F.col("available") > 0, F.greatest(F.col("budget") - F.col("rounds") * F.col("available"), F.lit(0.0))).otherwise(0.0)
    ).withColumn("open", (F.col("rounds") < F.col("max_repeats")) & (F.col("need") > 0))
    return materialize(goals, "mix-goals"), total


def plan(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    goals, total = goals_of(rows, targets)
    left = BITS
    for bits in LEVELS:
        left -= bits
        refined = materialize(_refined(rows, goals, bits, left), "mix-goals")
        discard(goals)
        goals = refined
    return goals, total


def _refined(rows: DataFrame, goals: DataFrame, bits: int, left: int) -> DataFrame:
    """Each open goal's threshold moved to the start of the bucket in which its budget is reached; at the last bits, behind
    that bucket if this is nearer to the budget."""
    bounds = goals.where("open").select("source", "threshold", "need")
    above = F.col("hash") - F.col("threshold")
    inside = rows.join(bounds, "source").where(above >= 0).where(F.shiftrightunsigned(above, left + bits) == 0)
    sums = inside.groupBy("source", "need", F.shiftright(above, left).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    # a source has at most 2^bits buckets, however many documents
    running = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    hit = (
        sums.withColumn("upto", running).where(F.col("upto") >= F.col("need"))
        .groupBy("source").agg(F.min_by(F.struct("bucket", "upto", "n"), "bucket").alias("at"))
    )
    found, need = F.col("at").isNotNull(), F.col("need") - (F.col("at.upto") - F.col("at.n"))
    behind = found & F.lit(left == 0) & (F.col("at.n") - need < need)
    return goals.join(hit, "source", "left").select(
        "source", "weight", "max_repeats", "available", "budget", "rounds",
        (F.col("threshold") + F.when(found, F.shiftleft(F.col("at.bucket"), left)).otherwise(0) + F.when(behind, 1).otherwise(0)).alias("threshold"),
        F.when(behind, need - F.col("at.n")).when(found, need).otherwise(F.col("need")).alias("need"), "open",
    )


def mixed(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, copies: every document of the mixture with the times it is taken."""
    rows = counted(documents, vocabulary)
    goals, _ = plan(rows, targets)
    return _applied(rows, goals)


def _applied(rows: DataFrame, goals: DataFrame) -> DataFrame:
    copies = F.col("rounds") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    cuts = goals.select("source", "rounds", "threshold")
    return rows.join(cuts, "source").withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each target: what it should have, what it has and what holds it back."""
    rows = counted(documents, vocabulary)
    goals, total = plan(rows, targets)
    wanted = goals.select("source", "weight", "max_repeats", F.col("available").alias("available_tokens"), F.col("budget").alias("budget_tokens"))
    taken = _applied(rows, goals).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    out = wanted.join(taken, "source", "left").withColumns(
        {"mixed_tokens": F.coalesce("mixed_tokens", F.lit(0)), "documents": F.coalesce("documents", F.lit(0)), "most_copies": F.coalesce("most_copies", F.lit(0))}
    )
    # one window over the targets, as many rows as they are
    mixture = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    return out.select(
        *wanted.columns, "mixed_tokens", "documents", "most_copies",
        (F.col("mixed_tokens") / F.nullif(F.lit(float(total)), F.lit(0.0))).alias("share_of_corpus"),
        (F.col("mixed_tokens") / F.nullif(mixture, F.lit(0))).alias("share_of_mixture"),
    )
