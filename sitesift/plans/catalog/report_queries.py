"""The report on new data, over three variants of frozen scores.

Orders of the first half of a month stand for validation, the others for the new data. The scores are
formulas, so that the whole way (thresholds chosen on one side, metrics, differences and low
prevalences on the other) has reference SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.constants import BASE_RATE_PREVALENCES, VARIANTS
from sitesift.operators.sampling import base_rate_reports
from sitesift.operators.scoring import delta_join
from sitesift.plans import training as T
from sitesift.plans.catalog.group_queries import _SAMPLE
from sitesift.plans.catalog.inputs import AP_EXPR, AUC_EXPR, ORDER_SQL, order_scores, ranking_sql
from sitesift.plans.catalog.metric_queries import _AT, _METRICS, rounded
from sitesift.plans.catalog.registry import query
from sitesift.session import write_and_read

_VARIANTS = "SELECT 'linear' AS variant, {c}, score FROM {s} UNION ALL SELECT 'tree', {c}, other FROM {s} UNION ALL SELECT 'hybrid', {c}, (score + other) / 2 FROM {s}"
_AT_LIMIT = _AT.replace("0.5", "threshold")
_SIDES = f"""{ORDER_SQL}, sided AS (SELECT oscored.*, day(o_orderdate) <= 15 AS validation FROM oscored JOIN orders ON sample_id = 'o' || o_orderkey),
long AS ({_VARIANTS.format(c='sample_id, validation, label', s='sided')}),
{ranking_sql('long', 'variant, validation')},
curve AS (SELECT variant, score, 2 * tp_cum / (tp_cum + fp_cum + sum(tp) OVER (PARTITION BY variant)) AS f1 FROM prefix WHERE validation),
chosen AS (SELECT variant, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY f1 DESC, score) AS r FROM curve) WHERE r = 1)"""


def sides(spark, sf):
    """Scores of the validation side, thresholds, scores of the new data: a column per variant."""
    early = F.dayofmonth("o_orderdate") <= 15
    rows = order_scores(spark, sf, early.alias("validation")).where("sample_id is not null").select(
        "sample_id", "label", "validation", F.col("score").alias("linear"), F.col("other").alias("tree"),
        ((F.col("score") + F.col("other")) / 2).alias("hybrid"),
    )
    first, new = rows.where("validation").drop("validation"), rows.where("not validation").drop("validation")
    return first, write_and_read(T.thresholds(long(first)), "thresholds"), new


def long(scores):
    """(variant, label, score) of each score column."""
    return scores.select("label", F.explode(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.col(v).alias("score")) for v in VARIANTS
    ])).alias("s")).select("s.variant", "label", "s.score")


@query("cross_dataset_metrics", f"""WITH {_SIDES},
r AS (SELECT variant, validation, {AP_EXPR} AS ap, {AUC_EXPR} AS auc FROM prefix GROUP BY variant, validation),
m AS (SELECT variant, validation, threshold, {_AT_LIMIT}, avg((score - label) * (score - label)) AS brier FROM long JOIN chosen USING (variant) GROUP BY variant, validation, threshold),
f AS (SELECT variant, validation, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS full_f1 FROM m),
a AS (SELECT variant, validation, round(threshold, 9) AS threshold, {_METRICS}, round(brier, 9) AS brier FROM m)
SELECT a.*EXCLUDE (validation), round(t.ap, 9) AS average_precision, round(t.auc, 9) AS roc_auc, round(v.ap - t.ap, 9) AS delta_ap, round(fv.full_f1 - ft.full_f1, 9) AS delta_f1
FROM a JOIN r t ON t.variant = a.variant AND NOT t.validation JOIN r v ON v.variant = a.variant AND v.validation
JOIN f ft ON ft.variant = a.variant AND NOT ft.validation JOIN f fv ON fv.variant = a.variant AND fv.validation WHERE NOT a.validation""")
def _(spark, sf):
    validation, chosen, new = sides(spark, sf)
    report = write_and_read(T.report_at(long(new), chosen), "cross-report")
    return rounded(report.join(delta_join(T.report_at(long(validation), chosen), report), "variant"))


@query("cross_dataset_base_rates", f"""WITH {_SIDES}, later AS (SELECT * EXCLUDE (validation) FROM sided WHERE NOT validation),
{_SAMPLE.replace(ORDER_SQL + ', ', '').replace('oscored', 'later')}, each AS ({_VARIANTS.format(c='rate, label', s='sample')}),
m AS (SELECT variant, rate, {_AT_LIMIT}, avg((score - label) * (score - label)) AS brier FROM each JOIN chosen USING (variant) GROUP BY variant, rate),
{ranking_sql('each', 'variant, rate').replace('counts', 'rate_counts').replace('prefix', 'rate_prefix')},
r AS (SELECT variant, rate, round({AP_EXPR}, 9) AS average_precision, round({AUC_EXPR}, 9) AS roc_auc FROM rate_prefix GROUP BY variant, rate),
a AS (SELECT variant, rate, {_METRICS}, round(brier, 9) AS brier FROM m)
SELECT variant, rate AS requested_prevalence, tp + fn + tn + fp AS total, tn + fp AS benign, fn + tp AS phishing, precision, recall, f1, accuracy, false_positive_rate, brier,
  average_precision, roc_auc FROM a JOIN r USING (variant, rate)""")
def _(spark, sf):
    _, chosen, new = sides(spark, sf)
    report = base_rate_reports(new, T.variant_limits(chosen), BASE_RATE_PREVALENCES + [0.6])
    return rounded(report.drop("manifest", "actual_prevalence"))
