"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 10_000  # a key is hot above 1/10000 of the rows, so at most 10000 keys are hot
SALTS = 64


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key meets a null key."""
    renamed = right.withColumnsRenamed({k: "_right_" + k for k in keys})
    match = reduce(and_, [F.col(k).eqNullSafe(F.col("_right_" + k)) for k in keys])
    return left.join(renamed, match, how).drop(*["_right_" + k for k in keys])


def skewed_lookup(
    rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner"
) -> DataFrame:
    """Join ``rows`` (any key distribution) to ``lookup`` (one row per key).

    Hot keys get a salt: their rows spread over SALTS tasks and only their lookup rows are repeated.
    The list of hot keys is broadcast; it has fewer than HOT_SHARE entries by construction.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = F.broadcast(
        counts.where(F.col("_n") > F.greatest(F.lit(1000), total / HOT_SHARE)).select(
            F.col(key).alias("_hot_key")
        )
    )
    others = [F.col(c) for c in rows.columns if c != key] or [F.rand(0)]
    salted_rows = rows.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt",
        F.when(F.col("_hot_key").isNull(), 0)
        .otherwise(F.pmod(F.xxhash64(*others), F.lit(SALTS)))
        .cast("int"),
    ).drop("_hot_key")
    salted_lookup = (
        lookup.join(hot, F.col(key) == F.col("_hot_key"), "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot_key").isNull(), F.array(F.lit(0))).otherwise(
                    F.sequence(F.lit(0), F.lit(SALTS - 1))
                )
            ),
        )
        .drop("_hot_key")
    )
    return salted_rows.join(salted_lookup, [key, "_salt"], how).drop("_salt")
