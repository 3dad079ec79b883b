"""Per-key results where a few keys hold most rows.

Every function pre-aggregates by the join key first, so a key with a third of all rows leaves
each map task as one row; only those compact states are shuffled, joined and rolled up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_rows(df: DataFrame, fields: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One row per non-null key of each field: (key_field, key_value, *carry).

    Null values are no key and leave no row. Keys keep the spelling they are stored in.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key_value")) for f in fields])
    exploded = df.select(F.explode(pairs).alias("_k"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    return exploded.where(F.col("_k.key_value").isNotNull()).select("_k.key_field", "_k.key_value", *[F.col(f"_c_{c}").alias(c) for c in carry])


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    by_left: Sequence[str] = (),
    by_right: Sequence[str] = (),
    sum_left: dict[str, Column] | None = None,
    sum_right: dict[str, Column] | None = None,
    rows_as: str = "n_rows",
    outer: bool = False,
) -> DataFrame:
    """Aggregate of ``left JOIN right`` without ever building the joined rows.

    Both inputs are aggregated by join key (and by the grouping columns each side brings); the
    states are joined; a joined group has ``n_left * n_right`` rows, a sum of the left side counts
    ``n_right`` times and the other way round; then the groups are rolled up.

    Null join keys match nothing (SQL equality). With ``outer`` left keys without partner stay and
    count one row each, with null for the right grouping columns. Empty inputs give no rows.
    """
    sum_left, sum_right = sum_left or {}, sum_right or {}
    lefts = left.groupBy(*on, *by_left).agg(F.count(F.lit(1)).alias("_nl"), *[F.sum(c).alias(f"_l_{n}") for n, c in sum_left.items()])
    rights = right.groupBy(*on, *by_right).agg(F.count(F.lit(1)).alias("_nr"), *[F.sum(c).alias(f"_r_{n}") for n, c in sum_right.items()])
    rights = rights.select(*[F.col(c).alias(f"_on_{c}") for c in on], *by_right, "_nr", *[f"_r_{n}" for n in sum_right])
    states = lefts.join(rights, [F.col(c) == F.col(f"_on_{c}") for c in on], "left" if outer else "inner")
    times = F.coalesce(F.col("_nr"), F.lit(1))
    return states.groupBy(*by_left, *by_right).agg(
        F.sum(F.col("_nl") * times).alias(rows_as),
        *[F.sum(F.col(f"_l_{n}") * times).alias(n) for n in sum_left],
        *[F.sum(F.col(f"_r_{n}") * F.col("_nl")).alias(n) for n in sum_right],
    )


def heavy_keys(df: DataFrame, fields: Sequence[str], share: float) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: (key_field, key_value, n_rows, total).

    Rows (null keys too) are aggregated to one state a key, the states to one total a field; keys
    and totals are joined as aggregates by :func:`eager_join_aggregate`, so no row of the input is
    ever joined. Null keys count in the total and are no key. Empty input gives no rows.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key_value")) for f in fields]))
    states = df.select(keys.alias("_k")).groupBy("_k.key_field", "_k.key_value").agg(F.count(F.lit(1)).alias("n"))
    totals = states.groupBy("key_field").agg(F.sum("n").alias("total"))
    left = states.where(F.col("key_value").isNotNull()).withColumn("_field", F.col("key_field"))
    joined = eager_join_aggregate(left, totals, ["key_field"], ["_field", "key_value"], ["total"], {"n_rows": F.col("n")}, rows_as="_pairs")
    return joined.where(F.col("n_rows") > F.lit(share) * F.col("total")).select(F.col("_field").alias("key_field"), "key_value", "n_rows", "total")


def key_profile(df: DataFrame, fields: Sequence[str], time_col: str, batch_col: str) -> DataFrame:
    """Per key: rows, first and last sighting, number of batches seen.

    A first level keyed by (key, batch) turns the distinct count into a plain count; hot keys are
    spread over their batches and combined map-side. Null times leave the sighting null only where
    a key has no time at all; rows without a batch count as rows but as no batch.
    """
    by_batch = key_rows(df, fields, [time_col, batch_col]).groupBy("key_field", "key_value", batch_col).agg(
        F.count(F.lit(1)).alias("_n"), F.min(time_col).alias("_lo"), F.max(time_col).alias("_hi")
    )
    return by_batch.groupBy("key_field", "key_value").agg(
        F.sum("_n").alias("n_rows"),
        F.min("_lo").alias("first_seen"),
        F.max("_hi").alias("last_seen"),
        F.count(batch_col).alias("n_batches"),
    )
