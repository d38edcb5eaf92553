"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

WORD_SPACE = " \t\n\x0b\f\r"  # everything else belongs to a word
HOT_ROWS = 100  # a key of fewer rows is never worth splitting
HOT_SHARE = 10_000  # so at most this many keys are hot, and their list may be broadcast
SALTS = 64


def seal(
    documents: DataFrame, replaced: tuple[str, ...] = ()
) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """The table under neutral column names, so that no column of it meets a working column.

    Returns the table, the neutral name of each column, and the columns under their own names.
    Columns in ``replaced`` are left out.
    """
    kept = [c for c in documents.columns if c not in replaced]
    at = {c: f"_in{i}" for i, c in enumerate(kept)}
    own = [F.col("`" + c.replace("`", "``") + "`").alias(at[c]) for c in kept]
    return documents.select(*own), at, [F.col(at[c]).alias(c) for c in kept]


def extended(frame: DataFrame, **types: str) -> StructType:
    """The schema of a table with more columns behind."""
    return StructType([*frame.schema.fields, *(StructField(n, DataType.fromDDL(t)) for n, t in types.items())])


def words_of(text: Column) -> Column:
    """Words of a text between ASCII white space; none for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x20\\x09-\\x0D]+")
    )


def hot_lookup(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``lookup``, which has one row per key and in ``_n`` its number of rows.

    Keys above a ten-thousandth of all rows (and HOT_ROWS) are hot: their rows spread over SALTS
    tasks and only their lookup rows are repeated. ``_n`` is dropped. Null keys match nothing.
    """
    total = lookup.agg(F.sum("_n").alias("n")).scalar()
    hot = F.broadcast(
        lookup.where(F.col("_n") > F.greatest(F.lit(HOT_ROWS), total / HOT_SHARE)).select(
            F.col(key).alias("_hot_key")
        )
    )
    others = [F.col(c) for c in rows.columns if c != key] or [F.lit(0)]
    salted = rows.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt",
        F.when(F.col("_hot_key").isNull(), 0)
        .otherwise(F.pmod(F.xxhash64(*others), F.lit(SALTS))).cast("int"),
    ).drop("_hot_key")
    repeated = lookup.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot_key").isNull(), F.array(F.lit(0)))
            .otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        ),
    ).drop("_hot_key", "_n")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def numbered(frame: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... without gaps within each value of the non-null column ``group``.

    No group is ordered in one task: its rows are dealt by a hash of ``order`` into the square root
    of all rows many buckets, numbered inside each bucket, and moved up by the rows of the buckets
    before it. ``frame`` is read twice, so pass a written table.
    """
    buckets = max(1, math.isqrt(frame.count()))
    return _numbered(frame.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets))), group, order, name)


def numbered_as_written(frame: DataFrame, group: str, file: str, row: str, name: str) -> DataFrame:
    """As ``numbered``, in the order of ``file``, the number of a written file, and ``row`` in it.

    A bucket is a stretch of rows of one file, as long as the square root of all rows.
    """
    stretch = max(1, math.isqrt(frame.count()))
    bucket = F.struct(F.col(file).alias("file"), F.floor(F.col(row) / stretch).alias("stretch"))
    return _numbered(frame.withColumn("_bucket", bucket), group, [row], name)


def _numbered(dealt: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    return (
        dealt.join(starts, [group, "_bucket"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_start")
    )
