"""Global order without a single-task sort.

Two tools. ``running_totals`` gives cumulative sums along a numeric order, ``ranked_positions`` an
exact rank along a seeded hash. Both cut the order into buckets, run a window inside each bucket,
and add what lies before the bucket from a table with one row per bucket. No window ever spans all
rows, and a bucket's share does not depend on how often one key or one value repeats, because
repeats are merged first (running_totals) or hashed apart (ranked_positions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.operators.skew import null_safe_join

MAX_BUCKETS = 4096


def bucket_count(frame: DataFrame) -> int:
    """A power of two of about eight buckets per shuffle partition, so that tasks even out."""
    width = 8 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKETS, 1 << max(4, (width - 1).bit_length()))


def seeded_hash(seed, *columns: Column) -> Column:
    """Deterministic pseudo-random order: md5 of 'seed:column:...'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def _edges(source: DataFrame, order: str, buckets: int) -> Column:
    shares = [i / buckets for i in range(1, buckets)]
    return source.agg(F.percentile_approx(order, shares, 20 * buckets).alias("edges")).scalar()


def _bucket(edges: Column, value: Column, buckets: int) -> Column:
    """Number of edges below the value, by binary search."""
    steps = []
    step = buckets // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda low, step: F.when(F.get(edges, low + step - 1) < value, low + step).otherwise(low),
    )


def running_totals(
    counts: DataFrame,
    order: str,
    sums: Sequence[str],
    keys: Sequence[str] = (),
    descending: bool = False,
    source: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Adds ``<name>_cum`` (inclusive) for each column in ``sums``.

    ``counts`` must hold one row per (keys, order). ``source`` is the table whose ``order`` values
    set the bucket edges; the raw rows are best, since a quantile sketch needs no shuffle.
    """
    keys = list(keys)
    n = buckets or bucket_count(counts)
    sign = -1 if descending else 1
    parts = (
        counts.withColumn("_edges", _edges(source or counts, order, n))
        # Never null, so the join below adds no null filter that would be pushed to the raw rows.
        .withColumn("_bucket", F.coalesce(_bucket(F.col("_edges"), F.col(order), n), F.lit(0)) * sign)
        .drop("_edges")
    )
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # At most one row per key and bucket.
    offsets = parts.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(s) for s in sums]).select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}_before") for s in sums],
    )
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*keys, "_bucket").orderBy(direction).rowsBetween(
        Window.unboundedPreceding, 0
    )
    joined = null_safe_join(parts, offsets, [*keys, "_bucket"])
    return joined.select(
        *counts.columns,
        *[(F.sum(s).over(inside) + F.col(f"_{s}_before")).alias(f"{s}_cum") for s in sums],
    )


def value_at_rank(
    frame: DataFrame, value: str, indexes: dict[str, Column], keys: Sequence[str] = ()
) -> DataFrame:
    """The element at zero-based sorted positions.

    ``indexes`` maps an output name to an expression over the row count column ``n``.
    """
    keys = list(keys)
    counts = frame.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(counts, value, ["n"], keys, source=frame)
    size = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sized = (
        null_safe_join(totals.withColumnRenamed("n", "_own"), size, keys) if keys
        else totals.withColumnRenamed("n", "_own").withColumn("n", size.scalar())
    )
    picks = [
        F.min(F.when(F.col("n_cum") > index, F.col(value))).alias(name)
        for name, index in indexes.items()
    ]
    return sized.groupBy(*keys).agg(F.first("n").alias("n"), *picks)


def ranked_positions(
    frame: DataFrame, hash_column: str, tie: str, keys: Sequence[str] = (), digits: int = 3,
    name: str = "rank",
) -> DataFrame:
    """Exact 1-based rank by a hex hash within the keys.

    Rows are split by the first hex digits (16 ** digits buckets of equal expected size), so the
    work of one key spreads over thousands of windows.
    """
    keys = list(keys)
    parts = frame.withColumn("_bucket", F.substring(hash_column, 1, digits))
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = parts.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(hash_column, tie)
    return null_safe_join(parts, offsets, [*keys, "_bucket"]).select(
        *frame.columns, (F.row_number().over(inside) + F.col("_before")).alias(name)
    )


def ordered_positions(frame: DataFrame, order: str, name: str = "pos") -> DataFrame:
    """Zero-based position of rows whose ``order`` values are distinct numbers."""
    ones = frame.withColumn("_one", F.lit(1).cast("long"))
    return (
        running_totals(ones, order, ["_one"], source=frame)
        .withColumn(name, F.col("_one_cum") - 1)
        .drop("_one", "_one_cum")
    )
