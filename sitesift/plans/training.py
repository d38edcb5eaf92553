"""Training and evaluation plans: candidate grids, three variants, cross-dataset report."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.constants import BASE_RATE_PREVALENCES, HASH_DIM, LINEAR_ALPHAS, TREE_ESTIMATORS, VARIANTS
from sitesift.operators.bootstrap import paired_bootstrap
from sitesift.operators.metrics import counted_report, metrics_report, pr_curve, score_counts, select_threshold
from sitesift.operators.ordering import running_totals
from sitesift.operators.ranking import primary_variant, rank_candidates, rank_grid
from sitesift.operators.sampling import base_rate_report, base_rate_reports
from sitesift.operators.scoring import aligned_or_fail, delta_join
from sitesift.operators.validate import require_scores
from sitesift.plans.models import (
    HybridConfig, LinearConfig, TreeConfig, fit_hybrid, fit_linear, fit_tree, linear_vectors,
    score_hybrid, score_linear, score_tree, with_vectors,
)
from sitesift.session import write_and_read

SCORE_COLUMNS = ["sample_id", "label", "score"]
OFFICIAL_THRESHOLD = 0.5


def thresholds(scores: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    # Read for the edges, the totals and the curve: written once.
    counts = write_and_read(score_counts(scores, keys=list(keys)), "score-counts")
    curve = pr_curve(running_totals(counts, "score", ["tp", "fp"], keys, descending=True), list(keys))
    return select_threshold(curve, list(keys)).select(*keys, "threshold")


def report_at(scores: DataFrame, chosen: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """All metrics per key at that key's threshold. ``chosen`` has one row per key."""
    counts = write_and_read(score_counts(scores, keys=list(keys)), "score-counts")
    with_limit = counts.join(F.broadcast(chosen), list(keys))
    return counted_report(with_limit, F.col("threshold"), [*keys, "threshold"])


def train_candidates(
    train: DataFrame, validation: DataFrame, alphas: Sequence[float] = tuple(LINEAR_ALPHAS),
    include_dom: Sequence[bool] = (False, True), max_iter: int = 30, parallel: int = 2,
    hash_dim: int = HASH_DIM,
) -> tuple[DataFrame, list[dict], dict]:
    """Fit {page features off, on} x alphas. Returns (candidate metrics, failures, models).

    Vectors are made once per feature set; fits run side by side. A failed candidate is recorded.
    """
    models, failures, scored = {}, [], []
    for dom in include_dom:
        base = LinearConfig(alphas[0], max_iter, dom, hash_dim)
        fit_on, check_on = linear_vectors(train, base), linear_vectors(validation, base)

        def attempt(alpha: float, dom=dom, fit_on=fit_on, check_on=check_on):
            config = LinearConfig(alpha, max_iter, dom, hash_dim)
            model = fit_linear(fit_on, config)
            scores = score_linear(model, check_on).select(
                F.lit(alpha).alias("alpha"), F.lit(dom).alias("include_dom"), *SCORE_COLUMNS
            )
            return model, write_and_read(scores, "candidate")

        with ThreadPoolExecutor(max_workers=parallel) as pool:
            jobs = {alpha: pool.submit(attempt, alpha) for alpha in alphas}
        for alpha, job in jobs.items():
            try:
                models[(dom, alpha)], scores = job.result()
                scored.append(scores)
            except Exception as error:  # noqa: BLE001 - a failed candidate must not end the grid
                failures.append({"include_dom": dom, "alpha": alpha, "error_type": type(error).__name__, "message": str(error)[:500]})
    if not scored:
        raise RuntimeError(f"all validation candidates failed: {failures}")
    every = scored[0]
    for part in scored[1:]:
        every = every.unionByName(part)
    keys = ["alpha", "include_dom"]
    report = write_and_read(report_at(every, thresholds(every, keys), keys), "candidates")
    return report, failures, models


def best_candidate(report: DataFrame) -> DataFrame:
    return rank_candidates(report, "average_precision", "f1", "alpha", "include_dom")


def _grid(kind: str, scored: dict, setting: str) -> float:
    """The grid value with the best (AP, F1 at 0.5, smaller setting)."""
    every = None
    for value, scores in scored.items():
        part = scores.withColumn(setting, F.lit(float(value)))
        every = part if every is None else every.unionByName(part)
    report = metrics_report(every, F.lit(0.5), [setting])
    return rank_grid(report, "average_precision", "f1", setting).first()[setting]


def train_variants(
    train: DataFrame, validation: DataFrame, holdout: DataFrame | None = None, seed: int = 42,
    alphas: Sequence[float] = tuple(LINEAR_ALPHAS), estimators: Sequence[int] = tuple(TREE_ESTIMATORS),
    max_iter: int = 30, hash_dim: int = HASH_DIM,
) -> dict:
    """Linear, tree and hybrid models; thresholds from validation; the holdout is scored once.

    Returns models, configurations, the scores tables (validation, holdout), the metrics tables and
    the primary variant.
    """
    linear_base, tree_base = LinearConfig(max_iter=max_iter, hash_dim=hash_dim), TreeConfig(seed=seed)
    fit_on = with_vectors(train, linear_base, tree_base)
    check_on = with_vectors(validation, linear_base, tree_base)

    linears = {a: fit_linear(fit_on, LinearConfig(a, max_iter, hash_dim=hash_dim)) for a in alphas}
    linear_scores = {a: score_linear(m, check_on).select(*SCORE_COLUMNS) for a, m in linears.items()}
    alpha = _grid("linear", linear_scores, "alpha")
    trees = {n: fit_tree(fit_on, TreeConfig(n, seed=seed)) for n in estimators}
    tree_scores = {n: score_tree(m, check_on).select(*SCORE_COLUMNS) for n, m in trees.items()}
    size = int(_grid("tree", tree_scores, "n_estimators"))
    linear_config, tree_config = LinearConfig(alpha, max_iter, hash_dim=hash_dim), TreeConfig(size, seed=seed)
    hybrid = fit_hybrid(fit_on, HybridConfig(seed=seed), linear_config, tree_config)
    models = {"linear": linears[alpha], "tree": trees[size], "hybrid": hybrid}

    scores = write_and_read(score_frozen(models, check_on), "validation-scores")
    chosen = write_and_read(thresholds(scores), "thresholds")
    report = write_and_read(report_at(scores, chosen), "validation-report")
    result = {
        "models": models, "linear_config": linear_config, "tree_config": tree_config,
        "thresholds": chosen, "validation_scores": scores, "validation_report": report,
        "primary": primary_variant(report).first()["variant"],
        "base_rates": base_rates(scores, chosen, seed),
    }
    if holdout is not None:
        held = write_and_read(score_frozen(models, with_vectors(holdout, linear_base, tree_base)), "holdout-scores")
        result["holdout_scores"] = held
        result["holdout_report"] = report_at(held, chosen)
    return result


def score_frozen(models: dict, vectors: DataFrame) -> DataFrame:
    """(variant, sample_id, label, score) of every variant."""
    scorers = {"linear": score_linear, "tree": score_tree, "hybrid": score_hybrid}
    parts = [
        scorers[v](models[v], vectors).select(F.lit(v).alias("variant"), *SCORE_COLUMNS) for v in VARIANTS if v in models
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def variant_limits(chosen: DataFrame) -> dict[str, float]:
    return {r["variant"]: r["threshold"] for r in chosen.orderBy("variant").collect()}


def base_rates(
    scores: DataFrame, chosen: DataFrame, seed: int = 42, rates: Sequence[float] = tuple(BASE_RATE_PREVALENCES)
) -> DataFrame:
    """Low-prevalence report per variant, from one sample where all variants have the same ids and labels."""
    limits = variant_limits(chosen)  # one row per variant
    here = {v: F.col("variant") == v for v in limits}
    wide = write_and_read(scores.where(F.col("variant").isin(*limits)).groupBy("sample_id").agg(
        F.min("label").alias("label"),
        (F.count_if(F.col("label").isNull()) == 0).alias("_labelled"), F.max("label").alias("_label"),
        F.array(*[F.count_if(h) for h in here.values()]).alias("_n"),
        *[F.max(F.when(h, F.col("score"))).alias(v) for v, h in here.items()],
    ), "variants")
    once = F.forall("_n", lambda n: n == 1) & F.col("_labelled") & (F.col("label") == F.col("_label"))
    if wide.where(~F.coalesce(once, F.lit(False))).isEmpty():
        return base_rate_reports(wide, limits, rates, seed)
    parts = []
    for variant, threshold in limits.items():
        side = scores.where(here[variant]).drop("variant")
        report = base_rate_report(side, threshold, rates, seed)
        parts.append(report.select(F.lit(variant).alias("variant"), *report.columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_dataset_report(
    validation_report: DataFrame, chosen: DataFrame, scores: DataFrame, comparator: DataFrame,
    replicates: int = 10_000, seed: int = 42,
) -> dict[str, DataFrame]:
    """Metrics on new data, deltas to validation, base rates, and paired bootstrap to a comparator.

    ``scores`` is (variant, sample_id, label, score), written once by the caller; ``comparator`` is
    (sample_id, label, score) with the same ids and labels, else the job fails.
    """
    require_scores(scores)
    report = write_and_read(report_at(scores, chosen), "cross-report")
    intervals, right = [], None
    for row in chosen.orderBy("variant").collect():
        side = scores.where(F.col("variant") == row["variant"]).drop("variant")
        paired = write_and_read(aligned_or_fail(side, comparator), "aligned")
        right = paired if right is None else right
        interval = paired_bootstrap(paired, row["threshold"], OFFICIAL_THRESHOLD, replicates, seed)
        intervals.append(interval.select(F.lit(row["variant"]).alias("variant"), *interval.columns))
    joined = intervals[0]
    for part in intervals[1:]:
        joined = joined.unionByName(part)
    return {
        "metrics": report,
        "delta": delta_join(validation_report, report),
        "base_rates": base_rates(scores, chosen, seed),
        "comparator": metrics_report(
            right.select("label", F.col("right_score").alias("score")), F.lit(OFFICIAL_THRESHOLD)
        ),
        "bootstrap": joined,
    }


def combined_training(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two training sets as one. ``source`` tells them apart and is never a feature."""
    shared = [c for c in first.columns if c in second.columns]
    return first.select(*shared).withColumn("source", F.lit("first")).unionByName(
        second.select(*shared).withColumn("source", F.lit("second"))
    )
