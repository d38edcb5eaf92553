"""Paired bootstrap of AP and F1 differences.

Draw k of replicate b is a hash of (seed, b, k) modulo the row count: the same rows serve both
models, any task can recompute any draw, and a rerun after a lost executor draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.operators.metrics import percentile_interval, ranking_metrics, score_counts
from sitesift.operators.ordering import ranked_positions, running_totals, seeded_hash

MAX_BROADCAST_ROWS = 1_000_000  # three numbers per row: about 24 MB


def draw_position(seed: int, replicate: Column, draw: Column, rows: int) -> Column:
    """60 bits of a seeded md5, modulo the row count."""
    digest = seeded_hash(seed, replicate, draw)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(rows).cast("long"))


def bootstrap_draws(paired: DataFrame, replicates: int, seed: int = 42, id_column: str = "sample_id") -> DataFrame:
    """(replicate, label, left_score, right_score): n drawn rows per replicate.

    A task makes whole ranges of one replicate, so the score counts that follow combine on the map
    side. Small scored tables are broadcast, larger ones meet the draws in a shuffle on the position.
    """
    spark = paired.sparkSession
    positioned = ranked_positions(
        paired.withColumn("_h", seeded_hash("position", F.col(id_column))), "_h", id_column
    ).select((F.col("rank") - 1).alias("_pos"), "label", "left_score", "right_score")
    rows = paired.count()
    if rows == 0:
        raise ValueError("inputs must not be empty")
    width = max(spark.sparkContext.defaultParallelism, -(-replicates * rows // 5_000_000))
    draws = (
        spark.range(0, replicates * rows, numPartitions=width)
        .select(F.expr(f"id div {rows}").alias("replicate"), F.expr(f"id % {rows}").alias("_k"))
        .select("replicate", draw_position(seed, F.col("replicate"), F.col("_k"), rows).alias("_pos"))
    )
    side = F.broadcast(positioned) if rows <= MAX_BROADCAST_ROWS else positioned
    return draws.join(side, "_pos").drop("_pos")


def replicate_differences(
    paired: DataFrame, left_threshold: float, right_threshold: float, replicates: int, seed: int = 42,
    id_column: str = "sample_id",
) -> DataFrame:
    """(replicate, ap_diff, f1_diff)."""
    def both_sides(frame: DataFrame, *kept: str) -> DataFrame:
        return frame.select(
            *kept, "label",
            F.explode(
                F.array(
                    F.struct(F.lit("left").alias("side"), F.col("left_score").alias("score")),
                    F.struct(F.lit("right").alias("side"), F.col("right_score").alias("score")),
                )
            ).alias("s"),
        ).select(*kept, "label", "s.*")

    keys = ["replicate", "side"]
    drawn = bootstrap_draws(paired, replicates, seed, id_column)
    counts = score_counts(both_sides(drawn, "replicate"), keys=keys)
    prefix = running_totals(
        counts, "score", ["tp", "fp"], keys, descending=True, source=both_sides(paired), buckets=16
    )
    limit = F.when(F.col("side") == "left", float(left_threshold)).otherwise(float(right_threshold))
    merged = ranking_metrics(prefix, ["average_precision", "f1"], keys, limit)
    signed = F.when(F.col("side") == "left", 1.0).otherwise(-1.0)
    return merged.groupBy("replicate").agg(
        F.sum(signed * F.col("average_precision")).alias("ap_diff"),
        F.sum(signed * F.col("f1")).alias("f1_diff"),
    )


def paired_bootstrap(
    paired: DataFrame, left_threshold: float, right_threshold: float, replicates: int = 10_000,
    seed: int = 42, id_column: str = "sample_id",
) -> DataFrame:
    """(metric, p2_5, p50, p97_5) of left minus right."""
    if isinstance(replicates, bool) or int(replicates) != replicates or replicates <= 0:
        raise ValueError("resamples must be a positive integer")
    diffs = replicate_differences(paired, left_threshold, right_threshold, int(replicates), seed, id_column)
    long = diffs.unpivot("replicate", ["ap_diff", "f1_diff"], "metric", "diff")
    return percentile_interval(long, "diff", ["metric"])


def ci_gate(intervals: DataFrame) -> DataFrame:
    """A difference is claimed only if its 95% interval excludes zero."""
    return intervals.withColumn("claim", (F.col("p2_5") > 0) | (F.col("p97_5") < 0))
