"""Exact-size seeded samples and low-prevalence reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.constants import BASE_RATE_PREVALENCES
from sitesift.operators.manifests import manifest_hash
from sitesift.operators.metrics import ranking_metrics
from sitesift.operators.ordering import running_totals, seeded_hash
from sitesift.session import write_and_read

DIGITS = 3


def check_rates(rates: Sequence[float]) -> list[float]:
    values = [float(r) for r in rates]
    if not values:
        raise ValueError("rates must not be empty")
    if any(not math.isfinite(v) or not 0 < v < 1 for v in values):
        raise ValueError("prevalence must be finite with 0 < prevalence < 1")
    if len(set(values)) != len(values):
        raise ValueError("rates must be unique")
    return values


def check_base_rate_input(frame: DataFrame, id_column: str = "sample_id") -> None:
    """Integer labels of both classes, unique non-empty ids."""
    kind = dict(frame.dtypes)["label"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"base rates need an integer column of 0 and 1, label is {kind}")
    ident, label = F.col(id_column), F.col("label")
    unnamed = "ids without text or not unique"
    # One row per id first, so that repeated ids show in the same pass.
    ids = frame.groupBy(id_column).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(label == 0).alias("_n0"), F.count_if(label == 1).alias("_n1")
    )
    found = ids.agg(
        (F.count(F.lit(1)) == 0).alias("no rows: it is empty"),
        F.coalesce(F.bool_or(F.col("_n") != F.col("_n0") + F.col("_n1")), F.lit(False)).alias("labels that are not only 0 and 1"),
        F.coalesce((F.sum("_n0") == 0) | (F.sum("_n1") == 0), F.lit(True)).alias("rows that are not of both classes"),
        F.coalesce(
            F.bool_or((F.col("_n") > 1) | ident.isNull() | (ident == "") | F.contains(ident, F.lit("\x00"))), F.lit(False)
        ).alias(unnamed),
    ).first().asDict()
    problems = [name for name, here in found.items() if here]
    if problems:
        raise ValueError("base-rate input has " + ", ".join(problems))


def base_rate_marks(
    frame: DataFrame, rates: Sequence[float] = tuple(BASE_RATE_PREVALENCES), seed: int = 42,
    id_column: str = "sample_id",
) -> DataFrame:
    """Rows that any requested prevalence takes, each once, with the list ``rates`` of those that take it.

    All negatives and round(p * n0 / (1 - p)) positives; if there are too few positives, all of
    them and round(n1 * (1 - p) / p) negatives. Within a label the rows with the smallest seeded
    hash are taken. Counts per hash prefix decide for whole prefixes; only prefixes where a
    quota ends are ranked row by row. Ids that are empty or repeated and labels other than 0 and 1,
    or of one class only, fail.
    """
    values = check_rates(rates)
    order = seeded_hash(seed, F.col(id_column))
    # Hashed once: the counts and the choice read the prefix, the few ranked rows hash again.
    rows = write_and_read(frame.withColumn("_unit", F.substring(order, 1, DIGITS)), "base-rates")
    check_base_rate_input(rows.select(id_column, "label"), id_column)
    units = rows.groupBy("label", "_unit").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("label").orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    # Two labels and 4096 prefixes bound this side.
    every = Window.partitionBy(F.lit(0))
    n0, n1 = F.col("_n0"), F.col("_n1")

    def left(p: float) -> Column:
        """Rows of a prefix within the quota of its label: below one none, from ``_n`` on all."""
        rate = F.lit(p)
        positives = F.bround(rate * n0 / (1 - rate)).cast("long")
        enough = positives <= n1
        negatives = F.when(enough, n0).otherwise(F.least(n0, F.bround(n1 * (1 - rate) / rate).cast("long")))
        wanted = F.when(F.col("label") == 0, negatives).otherwise(F.when(enough, positives).otherwise(n1))
        return wanted - F.col("_before")

    def taken(rank: Column) -> Column:
        names = F.array(*[F.lit(v) for v in values])
        return F.filter(names, lambda _, i: F.get("_left", i) >= rank)

    quota = (
        units.withColumns({
            "_before": F.coalesce(F.sum("_n").over(ahead), F.lit(0)),
            **{f"_n{label}": F.sum(F.when(F.col("label") == label, F.col("_n")).otherwise(0)).over(every) for label in (0, 1)},
        })
        .withColumn("_left", F.array(*[left(v) for v in values]))
        .where(F.array_max("_left") > 0)
        .select(
            "label", "_unit", "_left", taken(F.lit(1)).alias("rates"),
            (~F.exists("_left", lambda k: (k > 0) & (k < F.col("_n")))).alias("_whole"),
        )
    )
    chosen = rows.join(F.broadcast(quota), ["label", "_unit"])
    rank = Window.partitionBy("label", "_unit").orderBy(order, id_column)
    partial = chosen.where("not _whole").withColumn("_r", F.row_number().over(rank)).withColumn(
        "rates", taken(F.col("_r"))
    ).where(F.size("rates") > 0).drop("_r")
    return chosen.where("_whole").unionByName(partial).drop("_unit", "_left", "_whole")


def base_rate_sample(
    frame: DataFrame, rates: Sequence[float] = tuple(BASE_RATE_PREVALENCES), seed: int = 42,
    id_column: str = "sample_id",
) -> DataFrame:
    """Rows of each requested prevalence: the input columns plus ``rate``, from ``base_rate_marks``."""
    return base_rate_marks(frame, rates, seed, id_column).withColumn("rate", F.explode("rates")).drop("rates")


def base_rate_reports(
    scored: DataFrame, thresholds: dict[str, float], rates: Sequence[float] = tuple(BASE_RATE_PREVALENCES),
    seed: int = 42, id_column: str = "sample_id",
) -> DataFrame:
    """Requested and actual prevalence, counts, id manifest and all metrics per variant and rate.

    ``thresholds`` names the score columns of ``scored``, one per variant. One sample of ids serves
    them all, and a row is counted once per variant for all rates that take it.
    """
    narrow = scored.select(id_column, "label", *thresholds)
    marks = base_rate_marks(narrow, rates, seed, id_column)
    scores = [F.struct(F.lit(v).alias("variant"), F.col(v).alias("score")) for v in thresholds]
    values, label = check_rates(rates), F.col("label")
    sums = {
        f"{name}{i}": F.count_if(F.array_contains("rates", F.lit(rate)) & (label == value))
        for i, rate in enumerate(values) for name, value in (("tp", 1), ("fp", 0))
    }
    # A row per variant and score, with the counts of every rate beside each other.
    counts = write_and_read(
        marks.select("label", "rates", F.explode(F.array(*scores)).alias("_s")).select("label", "rates", "_s.*")
        .groupBy("variant", "score").agg(*[c.alias(name) for name, c in sums.items()]),
        "base-rate-counts",
    )
    each = running_totals(counts, "score", list(sums), ["variant"], descending=True).select(
        "variant", "score", F.explode(F.array(*[
            F.struct(F.lit(rate).alias("rate"), *[F.col(c.format(i)).alias(c.format("")) for c in ("tp{}", "fp{}", "tp{}_cum", "fp{}_cum")])
            for i, rate in enumerate(values)
        ])).alias("_c"),
    ).select("variant", "score", "_c.*").where("tp + fp > 0")
    limit = F.lit(None).cast("double")
    for variant, threshold in thresholds.items():
        limit = F.when(F.col("variant") == variant, F.lit(float(threshold))).otherwise(limit)
    metrics = ranking_metrics(each, keys=["variant", "rate"], threshold=limit)
    ids = manifest_hash(marks.select(id_column, F.explode("rates").alias("rate")), id_column, ["rate"])
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    # A left join, which Spark leaves out where the manifest is not read; each rate has one.
    return metrics.join(ids, "rate", "left").select(
        "variant", F.col("rate").alias("requested_prevalence"),
        ((F.col("fn") + F.col("tp")) / total).alias("actual_prevalence"),
        total.alias("total"), (F.col("tn") + F.col("fp")).alias("benign"),
        (F.col("fn") + F.col("tp")).alias("phishing"), "manifest",
        "precision", "recall", "f1", "accuracy", "false_positive_rate", "brier",
        "average_precision", "roc_auc",
    )


def base_rate_report(
    scored: DataFrame, threshold: float, rates: Sequence[float] = tuple(BASE_RATE_PREVALENCES),
    seed: int = 42, id_column: str = "sample_id",
) -> DataFrame:
    """The report of one ``score`` column."""
    return base_rate_reports(scored, {"score": threshold}, rates, seed, id_column).drop("variant")


def epoch_order(frame: DataFrame, id_column: str, epoch: int, seed: int = 42) -> DataFrame:
    """Seeded permutation of the rows for one epoch, as a sort key."""
    return frame.withColumn("epoch_key", seeded_hash(f"{seed}:{epoch}", F.col(id_column))).orderBy(
        "epoch_key", id_column
    )
