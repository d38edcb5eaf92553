"""Chi-square screening of hashed columns.

A tree learner keeps split statistics per column, so it cannot take all hashed columns. Counting how
often each column is set with either label needs one aggregate that combines on the map side, with at
most one row per column afterwards; the columns that tell the labels apart best are kept as they are,
so no two of them ever share a place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_scores(frame: DataFrame, columns: str = "buckets", label: str = "label") -> DataFrame:
    """(idx, positive, negative, chi_square) of every column that is set in some row.

    ``columns`` is an array of distinct column numbers, ``label`` 0 or 1; rows without a label are
    left out. The statistic is that of the two-by-two table of column set or not and label; it is 0
    where a column is set in every row or only one label occurs.
    """
    labelled = frame.where(F.col(label).isNotNull())
    totals = labelled.agg(F.struct(
        F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative")
    ).alias("totals")).scalar()
    counts = (
        labelled.select(F.col(label).alias("label"), F.explode(columns).alias("idx"))
        .groupBy("idx")
        .agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    )
    a, b = F.col("positive").cast("double"), F.col("negative").cast("double")
    c, d = F.col("_totals.positive") - a, F.col("_totals.negative") - b
    spread = (a + b) * (c + d) * (a + c) * (b + d)
    statistic = F.when(spread > 0, (a + b + c + d) * F.pow(a * d - b * c, F.lit(2.0)) / spread).otherwise(0.0)
    return counts.withColumn("_totals", totals).select(
        F.col("idx").cast("int"), "positive", "negative", statistic.alias("chi_square")
    )


def screen_columns(frame: DataFrame, width: int, columns: str = "buckets", label: str = "label") -> DataFrame:
    """The ``width`` columns of largest chi-square; equal ones by column number."""
    if width < 1:
        raise ValueError("the number of columns to keep must be a positive integer")
    return column_scores(frame, columns, label).orderBy(F.desc("chi_square"), "idx").limit(width)
