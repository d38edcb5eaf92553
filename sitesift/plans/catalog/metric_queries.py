"""Score evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.constants import FPR_TARGETS
from sitesift.operators import metrics as M
from sitesift.operators.ranking import primary_variant, rank_candidates, rank_grid
from sitesift.operators.scoring import delta_join
from sitesift.plans.catalog.inputs import (
    AP_EXPR, AUC_EXPR, LINE_SQL, ORDER_SQL, VARIANT_SQL, line_scores, ranking_sql, table,
    variant_scores,
)
from sitesift.plans.catalog.registry import query

V = ["variant"]


def rounded(frame, places: int = 9):
    return frame.select(
        *[F.round(c, places).alias(c) if t == "double" and c != "score" else F.col(c) for c, t in frame.dtypes]
    )


@query("score_prefix_sums", f"""WITH {VARIANT_SQL}, {ranking_sql('variants', 'variant')}
SELECT variant, score, tp::BIGINT AS tp, fp::BIGINT AS fp, tp_cum::BIGINT AS tp_cum, fp_cum::BIGINT AS fp_cum FROM prefix""")
def _(spark, sf):
    return M.score_prefix_sums(variant_scores(spark, sf), keys=V)


@query("average_precision", f"""WITH {VARIANT_SQL}, {ranking_sql('variants', 'variant')}
SELECT variant, round({AP_EXPR}, 9) AS average_precision FROM prefix GROUP BY variant""")
def _(spark, sf):
    out = M.average_precision(M.score_prefix_sums(variant_scores(spark, sf), keys=V), V)
    return rounded(out.select("variant", "average_precision"))


@query("roc_auc", f"""WITH {VARIANT_SQL}, {ranking_sql('variants', 'variant')}
SELECT variant, round({AUC_EXPR}, 9) AS roc_auc FROM prefix GROUP BY variant""")
def _(spark, sf):
    out = M.average_precision(M.score_prefix_sums(variant_scores(spark, sf), keys=V), V)
    return rounded(out.select("variant", "roc_auc"))


_CURVE = f"""{VARIANT_SQL}, {ranking_sql('variants', 'variant')},
curve AS (SELECT variant, score, tp_cum, fp_cum, tp_cum / (tp_cum + fp_cum) AS precision, tp_cum / sum(tp) OVER (PARTITION BY variant) AS recall,
  2 * tp_cum / (tp_cum + fp_cum + sum(tp) OVER (PARTITION BY variant)) AS f1 FROM prefix)"""


@query("pr_curve", f"WITH {_CURVE} SELECT variant, score, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM curve")
def _(spark, sf):
    curve = M.pr_curve(M.score_prefix_sums(variant_scores(spark, sf), keys=V), V)
    return rounded(curve.drop("tp_cum", "fp_cum"))


@query("select_threshold", f"""WITH {_CURVE}, best AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY f1 DESC, score ASC) AS r FROM curve)
SELECT variant, round(score, 9) AS threshold, round(f1, 9) AS f1 FROM best WHERE r = 1""")
def _(spark, sf):
    return rounded(M.select_threshold(M.pr_curve(M.score_prefix_sums(variant_scores(spark, sf), keys=V), V), V))


_AT = """sum(CASE WHEN score < 0.5 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS tn, sum(CASE WHEN score >= 0.5 AND label = 0 THEN 1 ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN score < 0.5 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END)::BIGINT AS tp"""
_METRICS = """tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 9) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS f1, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
  round(coalesce(fp / nullif(fp + tn, 0), 0.0), 9) AS false_positive_rate"""


@query("confusion_matrix", f"WITH {VARIANT_SQL} SELECT variant, {_AT} FROM variants GROUP BY variant")
def _(spark, sf):
    return M.confusion(variant_scores(spark, sf), F.lit(0.5), V).drop("brier")


@query("threshold_metrics", f"""WITH {VARIANT_SQL}, m AS (SELECT variant, {_AT}, avg((score - label) * (score - label)) AS brier FROM variants GROUP BY variant)
SELECT variant, {_METRICS}, round(brier, 9) AS brier FROM m""")
def _(spark, sf):
    return rounded(M.threshold_metrics(variant_scores(spark, sf), F.lit(0.5), V))


@query("metrics_report", f"""WITH {VARIANT_SQL}, m AS (SELECT variant, {_AT}, avg((score - label) * (score - label)) AS brier FROM variants GROUP BY variant),
{ranking_sql('variants', 'variant')}, r AS (SELECT variant, round({AP_EXPR}, 9) AS average_precision, round({AUC_EXPR}, 9) AS roc_auc FROM prefix GROUP BY variant)
SELECT variant, {_METRICS}, round(brier, 9) AS brier, average_precision, roc_auc FROM m JOIN r USING (variant)""")
def _(spark, sf):
    return rounded(M.metrics_report(variant_scores(spark, sf), F.lit(0.5), V))


_FPR = ", ".join(f"({t}::DOUBLE)" for t in FPR_TARGETS)


@query("tpr_at_fpr", f"""WITH {LINE_SQL}, ranked AS (SELECT label, row_number() OVER (ORDER BY score DESC, md5('tie:' || sample_id)) AS r, score, md5('tie:' || sample_id) AS h FROM scored),
cum AS (SELECT r, sum(label) OVER (ORDER BY r) / sum(label) OVER () AS tpr, sum(1 - label) OVER (ORDER BY r) / sum(1 - label) OVER () AS fpr FROM ranked)
SELECT target, round(coalesce(min_by(tpr, r) FILTER (WHERE fpr >= target), max(tpr)), 9) AS tpr FROM cum, (VALUES {_FPR}) t(target) GROUP BY target""")
def _(spark, sf):
    return rounded(M.tpr_at_fpr(line_scores(spark, sf).drop("fine")))


@query("temporal_cutoff", "SELECT epoch_us(ts) AS cutoff_micros, n FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS r, count(*) OVER () AS n FROM events) WHERE r = ceil(0.90 * n)")
def _(spark, sf):
    out = M.temporal_cutoff(table(spark, sf, "events"))
    return out.select(F.unix_micros("cutoff").alias("cutoff_micros"), "n")


@query("latency_summary", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, n, round(avg(value), 6) AS avg, max(value) FILTER (WHERE i = floor((n - 1) * 0.5)) AS p50, max(value) FILTER (WHERE i = floor((n - 1) * 0.95)) AS p95, max(value) AS max
FROM r GROUP BY event_type, n""")
def _(spark, sf):
    out = M.latency_summary(table(spark, sf, "events"), "value", ["event_type"])
    return out.withColumn("avg", F.round("avg", 6))


@query("runtime_gates", """WITH r AS (SELECT event_type, value * 10 AS value, n, i FROM (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n,
  row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i FROM events))
SELECT event_type, max(value) FILTER (WHERE i = floor((n - 1) * 0.95)) <= 250 AS within_latency, n * 10000 <= 26214400 AS within_payload FROM r GROUP BY event_type, n""")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_type", (F.col("value") * 10).alias("value"))
    gates = M.runtime_gates(M.latency_summary(events, "value", ["event_type"]), F.col("n") * 10000)
    return gates.select("event_type", "within_latency", "within_payload")


@query("percentile_interval", """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.025), 6) AS p2_5, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.975), 6) AS p97_5 FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    return rounded(M.interpolated_percentiles(
        table(spark, sf, "lineitem"), "l_extendedprice", {"p2_5": 0.025, "p50": 0.5, "p97_5": 0.975}, ["l_returnflag", "l_linestatus"]
    ), 6)


@query("calibration_summary", f"""WITH {LINE_SQL} SELECT least(floor(fine * 10), 9)::INT AS bin, count(*) AS n, round(avg(fine), 9) AS mean_score, round(avg(label), 9) AS positive_share FROM scored GROUP BY 1""")
def _(spark, sf):
    scored = line_scores(spark, sf).select("label", F.col("fine").alias("score"))
    return rounded(M.calibration_summary(scored))


# Candidate grids: metrics of a score column per priority (as alpha) and clerk flag (as include_dom).
_GRID = f"""grid AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS step, o_totalprice > 250000 AS include_dom,
    CAST(o_orderstatus = 'F' AS INT) AS label, CAST(day(o_orderdate) AS DOUBLE) / 31.0 AS score FROM orders),
{ranking_sql('grid', 'step, include_dom')},
gap AS (SELECT step, include_dom, {AP_EXPR} AS average_precision FROM prefix GROUP BY step, include_dom),
gf AS (SELECT step, include_dom, 2 * tp / (2 * tp + fp + fn) AS f1, brier FROM (SELECT step, include_dom, {_AT}, avg((score - label) * (score - label)) AS brier FROM grid GROUP BY step, include_dom)),
cand AS (SELECT step, include_dom, round(average_precision, 9) AS ap, round(f1, 9) AS f1, round(brier, 9) AS brier FROM gap JOIN gf USING (step, include_dom))"""


def _candidates(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("step"), (F.col("o_totalprice") > 250000).alias("include_dom"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.dayofmonth("o_orderdate") / 31.0).cast("double").alias("score"),
    )
    report = M.metrics_report(rows, F.lit(0.5), ["step", "include_dom"])
    return report.select(
        "step", "include_dom", F.round("average_precision", 9).alias("ap"), F.round("f1", 9).alias("f1"), F.round("brier", 9).alias("brier")
    )


@query("rank_candidates", f"""WITH {_GRID} SELECT step, include_dom, ap, f1 FROM cand ORDER BY ap DESC, f1 DESC, step ASC, include_dom::INT ASC LIMIT 1""")
def _(spark, sf):
    best = rank_candidates(_candidates(spark, sf), ap="ap", f1="f1", alpha="step")
    return best.select("step", "include_dom", "ap", "f1")


@query("rank_grid", f"""WITH {_GRID} SELECT include_dom, step, ap, f1 FROM (SELECT *, row_number() OVER (PARTITION BY include_dom ORDER BY ap DESC, f1 DESC, step) AS r FROM cand) WHERE r = 1""")
def _(spark, sf):
    return rank_grid(_candidates(spark, sf), ap="ap", f1="f1", size="step", keys=["include_dom"]).select("include_dom", "step", "ap", "f1")


@query("primary_variant", f"""WITH {_GRID} SELECT step, ap, f1, brier FROM cand WHERE NOT include_dom ORDER BY ap DESC, f1 DESC, brier, step LIMIT 1""")
def _(spark, sf):
    rows = _candidates(spark, sf).where(~F.col("include_dom"))
    return primary_variant(rows, ap="ap", f1="f1", brier="brier", order=F.col("step")).select("step", "ap", "f1", "brier")


_DELTA = f"""{ORDER_SQL}, long AS (SELECT 'score' AS variant, day(o_orderdate) <= 15 AS validation, CAST(o_orderstatus = 'F' AS INT) AS label, o_totalprice / 600000 AS score FROM orders
  UNION ALL SELECT 'day', day(o_orderdate) <= 15, CAST(o_orderstatus = 'F' AS INT), CAST(day(o_orderdate) AS DOUBLE) / 31.0 FROM orders),
{ranking_sql('long', 'variant, validation')}, dap AS (SELECT variant, validation, {AP_EXPR} AS ap FROM prefix GROUP BY variant, validation),
df AS (SELECT variant, validation, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (SELECT variant, validation, {_AT} FROM long GROUP BY variant, validation)),
dm AS (SELECT * FROM dap JOIN df USING (variant, validation))"""


@query("delta_join", f"""WITH {_DELTA} SELECT variant, round(v.ap - t.ap, 9) AS delta_ap, round(v.f1 - t.f1, 9) AS delta_f1
FROM dm v JOIN dm t USING (variant) WHERE v.validation AND NOT t.validation""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    day = F.dayofmonth("o_orderdate")
    long = orders.select(
        (day <= 15).alias("validation"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.explode(F.array(
            F.struct(F.lit("score").alias("variant"), (F.col("o_totalprice") / 600000).alias("score")),
            F.struct(F.lit("day").alias("variant"), (day / 31.0).cast("double").alias("score")),
        )).alias("v"),
    ).select("validation", "label", "v.*")
    report = M.metrics_report(long, F.lit(0.5), ["variant", "validation"])
    return rounded(delta_join(report.where("validation"), report.where("not validation")))

