"""Per-key results where a few keys hold most rows, by eager aggregation through joins.

Both inputs of a join are aggregated by the join key before it; the compact states are joined, counts multiply
and sums are combined algebraically, and the result is rolled up. A join of two hot keys then costs one row
instead of the product of their rows, and the exchange carries one row for each key and task.

A null key is no key: it joins nothing (in an outer join its rows stay, unmatched). The empty string is a key.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType

WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Measure:
    """A sum over the joined rows of an expression of one side; nulls add nothing. Whole numbers are summed as
    decimal(38,0), decimals as decimals (of up to six places), other fractions as double."""

    name: str
    value: Column


def state(df: DataFrame, keys: dict[str, Column], measures: list[Measure], prefix: str) -> DataFrame:
    """One row for each key: its rows and the sums of the measures. Partial sums are built before the exchange."""
    bare = df.select(*[c.alias(k) for k, c in keys.items()], *[m.value.alias(f"{prefix}{m.name}") for m in measures])
    return bare.groupBy(*keys).agg(
        F.count("*").alias(f"{prefix}rows"), *[F.sum(f"{prefix}{m.name}").alias(f"{prefix}{m.name}") for m in measures]
    )


def _times(df: DataFrame, name: str, partners: Column) -> Column:
    """A side's sum, once for each row of the other side that its rows meet."""
    kind = df.schema[name].dataType
    if isinstance(kind, DecimalType):
        return F.col(name) * partners.cast("decimal(19,0)")
    if isinstance(kind, FractionalType):
        return F.col(name).cast("double") * partners.cast("double")
    return (F.col(name).cast(WIDE) * partners.cast("decimal(19,0)")).cast(WIDE)


def join_states(
    lefts: DataFrame, rights: DataFrame, on: list[str], by: list[str], left_measures: list[str] = (), right_measures: list[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Join two states (of prefixes l_ and r_) and roll the result up to the columns by.

    how: inner, left, right or full. A row that finds no partner is one joined row, to which the other side adds nothing."""
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"no algebra for a {how} join of states")
    joined = lefts.join(rights, on, how)
    of_left, of_right = F.coalesce("l_rows", F.lit(1)), F.coalesce("r_rows", F.lit(1))
    return joined.groupBy(*by).agg(
        F.sum((of_left.cast("decimal(19,0)") * of_right.cast("decimal(19,0)")).cast(WIDE)).alias("joined_rows"),
        F.sum(F.coalesce("l_rows", F.lit(0))).alias("left_rows"),
        F.sum(F.coalesce("r_rows", F.lit(0))).alias("right_rows"),
        *[F.sum(_times(joined, f"l_{m}", of_right)).alias(m) for m in left_measures],
        *[F.sum(_times(joined, f"r_{m}", of_left)).alias(m) for m in right_measures],
    )


def eager_join(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, tuple[Column, Column]],
    roll_up: dict[str, Column] | None = None,
    left_measures: list[Measure] = (),
    right_measures: list[Measure] = (),
    how: str = "inner",
) -> DataFrame:
    """SELECT roll_up, count(*), sums FROM left JOIN right ON on GROUP BY roll_up, without building the join.

    on: name -> (left expression, right expression). roll_up: further grouping expressions of the left side (null for
    rows of the right side alone in an outer join); without any the result is by join key. Columns: the grouping,
    joined_rows, left_rows, right_rows (rows of either side, each counted once for each partner key), and each
    measure over the joined rows (null where no value took part)."""
    extra = roll_up or {}
    lefts = state(left, {k: c[0] for k, c in on.items()} | extra, list(left_measures), "l_")
    rights = state(right, {k: c[1] for k, c in on.items()}, list(right_measures), "r_")
    return join_states(
        lefts, rights, list(on), list(extra or on), [m.name for m in left_measures], [m.name for m in right_measures], how
    )


def hot_keys(fields: dict[str, tuple[DataFrame, Column]], share: float | Decimal = 0.05) -> DataFrame:
    """field, hot_key, key_rows, all_rows of the keys with at least that share of their table's rows.

    A key's share is what it holds of the join of its table's keys with the table as a whole: the tables are counted
    by key once, these states are rolled up to one state a field, and the two are joined by field. Nothing larger
    than a row for each key and task is exchanged. A null is no key but counts among the rows."""
    rows = None
    for name, (df, key) in fields.items():
        part = df.select(F.lit(name).alias("field"), key.alias("hot_key"))
        rows = part if rows is None else rows.unionByName(part)
    keys = state(rows, {"field": F.col("field"), "hot_key": F.col("hot_key")}, [], "l_")
    # a state rolled up is a state again; the exchange of the count by key serves both
    whole = keys.groupBy("field").agg(F.sum("l_rows").alias("r_rows"))
    held = join_states(keys, whole, ["field"], ["field", "hot_key"])
    # the null key goes by its count: a filter on the key would be pushed below one of the two counts and part them
    counted = F.when(F.col("hot_key").isNotNull(), F.col("left_rows"))
    return held.select("field", "hot_key", counted.alias("key_rows"), F.col("right_rows").alias("all_rows")).where(
        F.col("key_rows") >= F.lit(Decimal(str(share))) * F.col("all_rows")
    )
