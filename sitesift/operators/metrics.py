"""Threshold and ranking metrics, keyed by any columns (variant, rate, replicate).

Scores are merged to one row per distinct value first, so a value held by a third of all rows is one
row after the map side. Ranking metrics then need one running total over distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.constants import FPR_TARGETS, LATENCY_GATE_MS, PAYLOAD_GATE_BYTES
from sitesift.operators.ordering import running_totals, seeded_hash, value_at_rank
from sitesift.operators.skew import null_safe_join


def ratio(numerator: Column, denominator: Column) -> Column:
    """Zero when the denominator is zero."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / F.nullif(denominator, F.lit(0)))


def score_counts(scored: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*keys, score).agg(
        F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp")
    )


def score_prefix_sums(
    scored: DataFrame, score: str = "score", keys: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """(keys, score, tp, fp, tp_cum, fp_cum), scores descending."""
    counts = score_counts(scored, score, keys)
    return running_totals(
        counts, score, ["tp", "fp"], keys, descending=True, source=scored, buckets=buckets
    )


def _ranking_sums(threshold: Column | None) -> list[Column]:
    """What every metric needs, summed over distinct scores."""
    tp, fp, score = F.col("tp"), F.col("fp"), F.col("score")
    hit = F.lit(False) if threshold is None else score >= threshold
    return [
        F.sum(tp).alias("_p"), F.sum(fp).alias("_n"),
        F.sum(tp * F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum"))).alias("_ap"),
        F.sum(fp * (F.col("tp_cum") - tp / 2)).alias("_area"),
        F.sum(F.when(hit, tp).otherwise(0)).alias("_hit"), F.sum(F.when(hit, fp).otherwise(0)).alias("_false"),
        F.sum(tp * (score - 1) * (score - 1) + fp * score * score).alias("_error"),
    ]


def _ranking_values() -> dict[str, Column]:
    p, n, hit, false = F.col("_p"), F.col("_n"), F.col("_hit"), F.col("_false")
    return {
        "tn": n - false, "fp": false, "fn": p - hit, "tp": hit,
        "precision": ratio(hit, hit + false), "recall": ratio(hit, p),
        "f1": ratio(2 * hit, hit + false + p), "accuracy": ratio(hit + n - false, p + n),
        "false_positive_rate": ratio(false, n), "brier": F.col("_error") / (p + n),
        "average_precision": F.when(p == 0, 0.0).when(n == 0, 1.0).otherwise(F.try_divide(F.col("_ap"), p)),
        "roc_auc": F.when((p > 0) & (n > 0), F.try_divide(F.col("_area"), p * n.cast("double"))),
    }


def ranking_metrics(
    prefix: DataFrame, names: Sequence[str] | None = None, keys: Sequence[str] = (), threshold: Column | None = None
) -> DataFrame:
    """The named metrics (all by default) per key, in one aggregate over ``score_prefix_sums``."""
    values = _ranking_values()
    names = list(values) if names is None else names
    return prefix.groupBy(*keys).agg(*_ranking_sums(threshold)).select(*keys, *[values[n].alias(n) for n in names])


def average_precision(prefix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Step-wise AP and trapezoid AUC."""
    return ranking_metrics(prefix, ["average_precision", "roc_auc"], keys)


def pr_curve(prefix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 at every distinct score."""
    totals = prefix.groupBy(*keys).agg(F.sum("tp").alias("_p"))
    if keys:
        joined = prefix.join(totals, list(keys))
    else:
        joined = prefix.withColumn("_p", totals.scalar())
    flagged = F.col("tp_cum") + F.col("fp_cum")
    return joined.select(
        *keys, "score", "tp_cum", "fp_cum",
        ratio(F.col("tp_cum"), flagged).alias("precision"),
        F.when(F.col("_p") == 0, 1.0).otherwise(ratio(F.col("tp_cum"), F.col("_p"))).alias("recall"),
        ratio(2 * F.col("tp_cum"), flagged + F.col("_p")).alias("f1"),
    )


def select_threshold(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Score with the best F1; of several equal ones the lowest."""
    return curve.groupBy(*keys).agg(
        F.max_by("score", F.struct("f1", -F.col("score"))).alias("threshold"), F.max("f1").alias("f1")
    )


def confusion(scored: DataFrame, threshold: Column, keys: Sequence[str] = ()) -> DataFrame:
    flagged = F.col("score") >= threshold
    positive = F.col("label") == 1
    return scored.groupBy(*keys).agg(
        F.count_if(~flagged & ~positive).alias("tn"),
        F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & positive).alias("fn"),
        F.count_if(flagged & positive).alias("tp"),
        F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2))).alias("brier"),
    )


def threshold_metrics(scored: DataFrame, threshold: Column, keys: Sequence[str] = ()) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(scored, threshold, keys).select(
        *keys, "tn", "fp", "fn", "tp",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
        "brier",
    )


def metrics_report(scored: DataFrame, threshold: Column, keys: Sequence[str] = ()) -> DataFrame:
    """All metrics, one row per key, from one pass over the scores.

    A ``threshold`` column in the input, one value per key, is carried along and may be used.
    """
    carried = [*keys, *(["threshold"] if "threshold" in scored.columns else [])]
    prefix = score_prefix_sums(scored, keys=carried)
    return ranking_metrics(prefix, keys=carried, threshold=threshold)


def counted_report(counts: DataFrame, threshold: Column, keys: Sequence[str] = ()) -> DataFrame:
    """All metrics, one row per key, from a written table of ``score_counts``."""
    prefix = running_totals(counts, "score", ["tp", "fp"], keys, descending=True)
    return ranking_metrics(prefix, keys=keys, threshold=threshold)


def tpr_at_fpr(
    scored: DataFrame, targets: Sequence[float] = tuple(FPR_TARGETS), id_column: str = "sample_id"
) -> DataFrame:
    """TPR at the first rank whose FPR reaches each target; tied scores rank by id hash.

    The k-th negative decides. Units of (score, hash prefix) locate it, and only the one unit that
    holds it is ordered row by row.
    """
    digits = 3
    rows = scored.select(
        "label", "score", seeded_hash("tie", F.col(id_column)).alias("_h")
    ).withColumn("_unit", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    units = rows.groupBy("score", "_unit").agg(
        F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp")
    )
    # One score has at most 4096 units: order units inside a score, then scores globally.
    by_score = score_prefix_sums(scored.select("label", "score"))
    start = by_score.select(
        "score", (F.col("tp_cum") - F.col("tp")).alias("_tp0"), (F.col("fp_cum") - F.col("fp")).alias("_fp0")
    )
    inside = Window.partitionBy("score").orderBy("_unit").rowsBetween(Window.unboundedPreceding, 0)
    located = units.join(start, "score").select(
        "score", "_unit", "tp", "fp",
        (F.col("_tp0") + F.sum("tp").over(inside)).alias("tp_cum"),
        (F.col("_fp0") + F.sum("fp").over(inside)).alias("fp_cum"),
    )
    size = scored.agg(
        F.struct(
            F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")
        ).alias("size")
    ).scalar()
    wanted = located.withColumn("_size", size).select(
        "*", F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")
    ).where(
        (F.col("fp_cum") / F.greatest(F.col("_size.n"), F.lit(1)) >= F.col("target"))
        & ((F.col("fp_cum") - F.col("fp")) / F.greatest(F.col("_size.n"), F.lit(1)) < F.col("target"))
    )
    # At most one unit per target survives, so this side is a handful of rows.
    hit = F.broadcast(wanted.drop("tp", "fp").withColumn("_tp1", F.col("tp_cum")).join(
        units.select("score", "_unit", "tp", "fp"), ["score", "_unit"]
    ))
    order = Window.partitionBy("target").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.join(hit, ["score", "_unit"]).select(
        "target", "_size",
        (F.col("tp_cum") - F.col("tp") + F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).over(order)).alias("_t"),
        (F.col("fp_cum") - F.col("fp") + F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).over(order)).alias("_f"),
    ).where(F.col("_f") / F.col("_size.n") >= F.col("target"))
    reached = ranked.groupBy("target").agg(
        F.min_by(F.col("_t") / F.greatest(F.col("_size.p"), F.lit(1)), F.struct("_f", "_t")).alias("tpr")
    )
    all_targets = scored.sparkSession.createDataFrame([(float(t),) for t in targets], "target double")
    # With no negatives the search clamps to the last rank, where every positive is ahead.
    return all_targets.join(reached, "target", "left").select(
        "target",
        F.coalesce(
            "tpr", F.when(scored.agg(F.count_if(F.col("label") == 1)).scalar() > 0, 1.0).otherwise(0.0)
        ).alias("tpr"),
    )


def temporal_cutoff(frame: DataFrame, ts: str = "ts", share: float = 0.90) -> DataFrame:
    """One row (cutoff): the element at ceil(share * n) - 1 of the sorted timestamps."""
    micros = frame.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))
    last = F.col("n") - 1
    index = F.greatest(F.lit(0), F.least(last, F.ceil(F.lit(share) * F.col("n")) - 1))
    return value_at_rank(micros, "micros", {"cutoff_micros": index}).select(
        F.timestamp_micros("cutoff_micros").alias("cutoff"), "n"
    )


def latency_summary(frame: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """avg, p50, p95, max with index floor((n - 1) * q)."""
    last = F.col("n") - 1
    picked = value_at_rank(
        frame, value,
        {"p50": F.floor(last * 0.5), "p95": F.floor(last * 0.95), "max": last}, keys,
    )
    mean = frame.groupBy(*keys).agg(F.avg(value).alias("avg"))
    return null_safe_join(picked, mean, keys) if keys else picked.withColumn("avg", mean.scalar())


def runtime_gates(summary: DataFrame, payload_bytes: int | Column) -> DataFrame:
    """Adds the latency and payload limits a model must keep."""
    size = payload_bytes if isinstance(payload_bytes, Column) else F.lit(payload_bytes)
    return summary.withColumns({
        "within_latency": F.col("p95") <= LATENCY_GATE_MS, "within_payload": size <= PAYLOAD_GATE_BYTES,
    })


def percentile_interval(frame: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated 2.5 / 50 / 97.5 percentiles of replicate values."""
    return frame.groupBy(*keys).agg(
        F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")
    ).select(*keys, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p2_5", "p50", "p97_5"))])


def interpolated_percentiles(
    frame: DataFrame, value: str, shares: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated percentiles of any number of rows, from ranks instead of one buffer."""
    last = F.col("n") - 1
    indexes = {}
    for name, share in shares.items():
        indexes[f"{name}_low"] = F.floor(last * share)
        indexes[f"{name}_high"] = F.ceil(last * share)
    picked = value_at_rank(frame, value, indexes, keys)

    def blend(name: str, share: float) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        at = last * share
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return picked.select(*keys, *[blend(n, s) for n, s in shares.items()])


def window_count_stats(counts: DataFrame, value: str = "windows") -> DataFrame:
    return counts.agg(
        F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"),
        F.percentile(value, 0.9).alias("p90"), F.max(value).alias("max"),
        F.sum(value).alias("total"),
    )


def calibration_summary(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and positive share in equal score bins."""
    bin_column = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(bin_column.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("positive_share")
    )
