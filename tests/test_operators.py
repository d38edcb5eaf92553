"""Ordering, metrics, sampling, groups, splits, bootstrap and validation against brute force."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sitesift.constants import VARIANTS
from sitesift.operators import bootstrap as B
from sitesift.operators import groups as G
from sitesift.operators import metrics as M
from sitesift.operators import sampling as P
from sitesift.operators import scoring
from sitesift.operators import splits as X
from sitesift.operators import validate as V
from sitesift.operators.ordering import ranked_positions, running_totals, seeded_hash
from sitesift.operators.scoring import (
    aligned_or_fail, linear_score_join, max_pool, score_pages, sliding_windows,
)
from sitesift.operators.skew import skewed_lookup
from sitesift.operators.vectors import transform_numeric, vectorize
from sitesift.plans import training as T
from sitesift.plans.catalog import report_queries
from sitesift.session import write_and_read


def scored(spark, labels, scores):
    rows = [(f"s{i}", int(y), float(s)) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "sample_id string, label int, score double")


def brute(labels, scores):
    """AP, AUC and the lowest best-F1 threshold by direct definition."""
    p, n = sum(labels), len(labels) - sum(labels)
    ap = last = 0.0
    best = None
    for t in sorted(set(scores), reverse=True):
        tp = sum(1 for y, s in zip(labels, scores) if s >= t and y)
        fp = sum(1 for y, s in zip(labels, scores) if s >= t and not y)
        if p:
            ap += (tp / p - last) * tp / (tp + fp)
            last = tp / p
        f1 = 2 * tp / (tp + fp + p)
        if best is None or f1 >= best[0]:
            best = (f1, t)
    pairs = [(a, b) for y, a in zip(labels, scores) if y for z, b in zip(labels, scores) if not z]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) if pairs else None
    return (0.0 if not p else 1.0 if not n else ap), auc, best[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_metrics(spark, seed):
    rng = random.Random(seed)
    labels = [int(rng.random() < 0.3) for _ in range(200)]
    scores = [0.5 if rng.random() < 0.4 else round(rng.random(), 2) for _ in labels]
    frame = scored(spark, labels, scores)
    ap, auc, threshold = brute(labels, scores)
    prefix = M.score_prefix_sums(frame)
    row = M.average_precision(prefix).first()
    assert row["average_precision"] == pytest.approx(ap) and row["roc_auc"] == pytest.approx(auc)
    assert M.select_threshold(M.pr_curve(prefix)).first()["threshold"] == threshold
    report = M.metrics_report(frame, F.lit(threshold)).first()
    assert report["tn"] + report["fp"] + report["fn"] + report["tp"] == 200


def test_threshold_tie_takes_the_lowest(spark):
    prefix = M.score_prefix_sums(scored(spark, [1, 0, 0, 1], [0.1, 0.2, 0.3, 0.4]))
    assert M.select_threshold(M.pr_curve(prefix)).first()["threshold"] == 0.1


def test_single_class_metrics(spark):
    only = M.average_precision(M.score_prefix_sums(scored(spark, [1, 1], [0.2, 0.9]))).first()
    none = M.average_precision(M.score_prefix_sums(scored(spark, [0, 0], [0.2, 0.9]))).first()
    assert (only["average_precision"], only["roc_auc"]) == (1.0, None)
    assert (none["average_precision"], none["roc_auc"]) == (0.0, None)
    report = M.metrics_report(scored(spark, [0, 0], [0.2, 0.9]), F.lit(2.0)).first()
    assert (report["precision"], report["recall"], report["f1"], report["tn"]) == (0.0, 0.0, 0.0, 2)


def test_tpr_at_fpr_within_ties(spark):
    import hashlib

    labels = [i % 3 == 0 for i in range(90)]
    scores = [0.9 if i < 5 else 0.5 for i in range(90)]
    frame = scored(spark, labels, scores)
    order = sorted(range(90), key=lambda i: (-scores[i], hashlib.md5(f"tie:s{i}".encode()).hexdigest()))
    p, n = sum(labels), 90 - sum(labels)
    for target, got in [(r["target"], r["tpr"]) for r in M.tpr_at_fpr(frame).collect()]:
        tp = fp = 0
        for i in order:
            tp, fp = tp + labels[i], fp + (not labels[i])
            if fp / n >= target:
                break
        assert got == pytest.approx(tp / p)
    assert {r["tpr"] for r in M.tpr_at_fpr(scored(spark, [1, 1], [0.1, 0.2])).collect()} == {1.0}


def test_running_totals_do_not_depend_on_buckets(spark):
    rows = [("a" if i % 3 else "b", float(i * 7 % 101), i) for i in range(101)]
    frame = spark.createDataFrame(rows, "k string, x double, n long")
    for buckets in (2, 64):
        got = running_totals(frame, "x", ["n"], ["k"], buckets=buckets).collect()
        for r in got:
            assert r["n_cum"] == sum(n for k, x, n in rows if k == r["k"] and x <= r["x"])


def test_cutoff_and_latency(spark):
    rows = [(f"2024-01-{d:02d} 00:00:00",) for d in range(1, 12)]
    frame = spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp").alias("ts"))
    assert str(M.temporal_cutoff(frame).first()["cutoff"]) == "2024-01-10 00:00:00"
    values = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    row = M.latency_summary(values, "v").first()
    assert (row["p50"], row["p95"], row["max"], row["avg"]) == (4.0, 8.0, 9.0, 4.5)


def test_base_rate_sample(spark):
    rows = [(f"n{i}", 0) for i in range(10000)] + [(f"p{i}", 1) for i in range(1000)]
    frame = spark.createDataFrame(rows, "sample_id string, label int")
    sample = P.base_rate_sample(frame, [0.01], 7)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    assert counts == {0: 10000, 1: 101}
    assert sample.select("sample_id").distinct().count() == 10101
    again = P.base_rate_sample(frame, [0.01], 7)
    assert again.exceptAll(sample).isEmpty() and sample.exceptAll(again).isEmpty()
    assert not P.base_rate_sample(frame, [0.01], 8).exceptAll(sample).isEmpty()
    few = spark.createDataFrame([(f"n{i}", 0) for i in range(100)] + [("p0", 1), ("p1", 1)], "sample_id string, label int")
    counts = {r["label"]: r["count"] for r in P.base_rate_sample(few, [0.05], 1).groupBy("label").count().collect()}
    assert counts == {0: 38, 1: 2}


@pytest.mark.parametrize("rates", [[], [0.0], [1.0], [0.1, 0.1], [float("nan")]])
def test_bad_rates(rates):
    with pytest.raises(ValueError):
        P.check_rates(rates)


def test_base_rate_input_checks(spark):
    make = lambda rows, kind="int": spark.createDataFrame(rows, f"sample_id string, label {kind}")
    P.check_base_rate_input(make([("a", 0), ("b", 1)]))
    for rows, message in [
        ([("a", 0), ("b", 0)], "both classes"), ([("a", 0), ("b", 2)], "only 0 and 1"),
        ([("a", 0), ("a", 1)], "unique"), ([("", 0), ("b", 1)], "unique"), ([], "empty"),
    ]:
        with pytest.raises(ValueError, match=message):
            P.check_base_rate_input(make(rows))
    with pytest.raises(ValueError, match="integer"):
        P.check_base_rate_input(make([("a", 0.0), ("b", 1.0)], "double"))


def test_groups_join_domains_and_families(spark):
    rows = [(1, "one", "kit-a"), (2, "two", "kit-a"), (3, "one", "kit-b"), (4, "three", ""), (5, "four", "kit-b"), (6, "five", None)]
    frame = spark.createDataFrame(rows, "id int, registrable_domain string, source_family_id string")
    got = {r["id"]: r["group"] for r in G.connected_groups(frame).collect()}
    assert got == {1: "domain:four", 2: "domain:four", 3: "domain:four", 5: "domain:four", 4: "domain:three", 6: "domain:five"}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(70)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)] + [("hub", f"q{i}") for i in range(60)] + [("solo", "solo")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r["node"]: r["root"] for r in G.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_over_batches(spark, monkeypatch):
    """Batches are connected where they are read; the rounds see only roots that batches disagree about."""
    rng = random.Random(5)
    edges = [(f"é{i // 4:04d}", f"{'f' if i % 9 else 'ü'}{i // 5:04d}") for i in range(800)] + [("hub", f"q{i}") for i in range(300)]
    edges += [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(200)] + [("alone", None), (None, "other"), (None, None)]
    label = {}
    for a, b in edges:
        a, b = a or b, b or a
        if a is not None:
            x, y = sorted((label.setdefault(a, {a}), label.setdefault(b, {b})), key=len)
            y |= x
            label.update(dict.fromkeys(x, y))
    seen, rounds = [], G.star_rounds
    monkeypatch.setattr(G, "star_rounds", lambda links, *more: seen.append(links.count()) or rounds(links, *more))
    frame = spark.createDataFrame(edges, "a string, b string").coalesce(1)
    for size in ("10000", "50", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {r["node"]: r["root"] for r in G.connected_components(frame).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {x: min(group) for x, group in label.items()}
    assert len(seen) == 2 and seen[0] < 200  # one batch needs no round; of batches of 50 few roots meet


def test_dedupe_keeps_first(spark):
    frame = spark.createDataFrame([("x", 3, "c"), ("x", 1, "a"), ("y", 2, "b"), ("x", 2, "d")], "sample_id string, ord int, v string")
    assert sorted(r["v"] for r in G.dedupe_keep_first(frame, "sample_id", "ord").collect()) == ["a", "b"]


def test_skewed_lookup_keeps_every_row(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"), "id")
    lookup = rows.select("k").distinct().withColumn("v", F.length("k"))
    joined = skewed_lookup(rows, lookup, "k")
    assert joined.count() == 30000 and joined.select("id").distinct().count() == 30000
    assert skewed_lookup(rows, lookup.where("k <> 'hot'"), "k", "left").where("v is null").count() == 10000


def test_grouped_split(spark):
    rows = [(f"s{g}-{i}", f"g{g}", g % 2) for g in range(25) for i in range(2)]
    frame = spark.createDataFrame(rows, "sample_id string, group string, label int")
    split = X.grouped_split(frame, seed=42)
    X.check_split(split)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(counts.values()) == 50 and counts["train"] == 30
    leaked = split.withColumn("split", F.when(F.col("sample_id") == "s0-0", "test").otherwise(
        F.when(F.col("group") == "g0", "train").otherwise(F.col("split"))))
    with pytest.raises(ValueError, match="overlap"):
        X.check_split(leaked)
    with pytest.raises(ValueError, match="both classes"):
        X.check_split(split.where("label = 0"))
    with pytest.raises(ValueError, match="unknown split"):
        X.official_split(split.withColumn("split", F.lit("dev")))


def test_one_hot_group_stays_whole(spark):
    rows = [(f"h{i}", "hot", i % 2) for i in range(100)] + [(f"s{g}-{i}", f"g{g}", (g + i) % 2) for g in range(100) for i in range(2)]
    split = X.grouped_split(spark.createDataFrame(rows, "sample_id string, group string, label int"))
    assert split.where("group = 'hot'").select("split").distinct().collect()[0]["split"] == "train"
    assert split.where("group = 'hot'").count() == 100
    X.check_split(split)


def test_rank_is_a_permutation(spark):
    frame = spark.range(500).select(F.col("id").cast("string").alias("id")).withColumn("h", seeded_hash(1, F.col("id")))
    ranks = [(r["h"], r["rank"]) for r in ranked_positions(frame, "h", "id").collect()]
    assert [r for _, r in sorted(ranks)] == list(range(1, 501))


def paired(spark, n=60, same=False):
    rng = random.Random(5)
    rows = [(f"s{i}", int(rng.random() < 0.4), round(rng.random(), 2), round(rng.random(), 2)) for i in range(n)]
    rows = [(i, y, a, a if same else b) for i, y, a, b in rows]
    return spark.createDataFrame(rows, "sample_id string, label int, left_score double, right_score double")


def test_bootstrap_of_equal_models_is_zero(spark):
    got = B.paired_bootstrap(paired(spark, same=True), 0.5, 0.5, 30).collect()
    assert all((r["p2_5"], r["p50"], r["p97_5"]) == (0.0, 0.0, 0.0) for r in got) and len(got) == 2
    assert not B.ci_gate(B.paired_bootstrap(paired(spark, same=True), 0.5, 0.5, 5)).where("claim").count()


def test_bootstrap_replicates_match_brute_force(spark):
    frame = paired(spark)
    draws = B.bootstrap_draws(frame, 4, 9).collect()
    assert len(draws) == 240
    diffs = {r["replicate"]: r for r in B.replicate_differences(frame, 0.5, 0.5, 4, 9).collect()}
    for b in range(4):
        rows = [r for r in draws if r["replicate"] == b]
        labels = [r["label"] for r in rows]
        left, right = brute(labels, [r["left_score"] for r in rows]), brute(labels, [r["right_score"] for r in rows])
        assert diffs[b]["ap_diff"] == pytest.approx(left[0] - right[0])
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            B.paired_bootstrap(frame, 0.5, 0.5, bad)


def test_shuffle_join_draws_equal_broadcast_draws(spark, monkeypatch):
    frame = paired(spark)
    small = B.replicate_differences(frame, 0.5, 0.5, 3, 2).orderBy("replicate").collect()
    monkeypatch.setattr(B, "MAX_BROADCAST_ROWS", 0)
    large = B.replicate_differences(frame, 0.5, 0.5, 3, 2).orderBy("replicate").collect()
    assert [r.asDict() for r in small] == [pytest.approx(r.asDict()) for r in large]


def test_alignment_errors(spark):
    make = lambda rows: spark.createDataFrame(rows, "sample_id string, label int, score double")
    left = make([("a", 0, 0.1), ("b", 1, 0.2)])
    assert aligned_or_fail(left, make([("b", 1, 0.9), ("a", 0, 0.8)])).count() == 2
    with pytest.raises(ValueError, match="missing"):
        aligned_or_fail(left, make([("a", 0, 0.8)]))
    with pytest.raises(ValueError, match="extra"):
        aligned_or_fail(left, make([("a", 0, 0.8), ("b", 1, 0.2), ("c", 1, 0.2)]))
    with pytest.raises(ValueError, match="label_conflict"):
        aligned_or_fail(left, make([("a", 1, 0.8), ("b", 1, 0.2)]))


def test_alignment_keeps_the_right_order(spark):
    rows = [(f"s{i}", i % 2, i / 100) for i in range(60)]
    left = spark.createDataFrame(rows, "sample_id string, label int, score double").repartition(5)
    right = spark.createDataFrame(
        [(s, label, 1 - x, (i * 37) % 60) for i, (s, label, x) in enumerate(rows)],
        "sample_id string, label int, score double, position int",
    ).repartition(3)
    got = aligned_or_fail(left, right, order="position").collect()
    assert [r.position for r in got] == list(range(60))
    assert all(r.left_score + r.right_score == pytest.approx(1) for r in got)


def test_vector_values(spark):
    frame = spark.createDataFrame([("k", "https://x.example", "", 9.0)], "sample_id string, url string, title string, dom_image_count double")
    values = {r["idx"]: r["value"] for r in vectorize(frame).collect()}
    assert values[262144 + 14] == pytest.approx(math.log1p(9), rel=1e-6)
    assert {v for i, v in values.items() if i < 262144} == {1.0}
    raw = spark.createDataFrame([("nan",), ("-inf",), (None,), ("x",), ("-2",), ("3",)], "v string")
    counts = [r[0] for r in raw.select(transform_numeric("url_length", F.col("v"))).collect()]
    assert counts == pytest.approx([0, 0, 0, 0, 0, math.log1p(3)])


def test_narrow_scoring_equals_join_scoring(spark):
    rows = [(f"k{i}", f"https://h{i}.example/é{i}?q={i}", "T" * i, float(i)) for i in range(20)]
    frame = spark.createDataFrame(rows, "sample_id string, url string, title string, dom_image_count double")
    for dom, width in ((True, 512 + 39), (False, 512)):
        weights = spark.range(width).select(F.col("id").cast("int").alias("idx"), (F.sin(F.col("id").cast("double"))).cast("float").alias("weight"))
        narrow = {r["sample_id"]: r["score"] for r in score_pages(frame, weights, 0.3, dom, 512).collect()}
        joined = linear_score_join(vectorize(frame, include_dom=dom, dim=512), weights, 0.3)
        assert narrow == pytest.approx({r["sample_id"]: r["score"] for r in joined.collect()}, rel=1e-6)
    with pytest.raises(ValueError, match="dimension"):
        score_pages(frame, weights.limit(5), 0.0, True, 512)


def test_weights_beyond_the_model_width_are_not_broadcast(spark):
    wide = spark.range(scoring.MAX_BROADCAST_WEIGHTS + 1).select(F.col("id").alias("idx"), F.lit(1.0).alias("weight"))
    assert scoring.weights_side(wide) is wide
    narrow = wide.where("idx < 10")
    assert "broadcast" in scoring.weights_side(narrow)._jdf.queryExecution().logical().toString()


def test_base_rate_sample_refuses_repeated_ids(spark):
    frame = scored(spark, [0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8])
    with pytest.raises(ValueError, match="unique"):
        P.base_rate_sample(frame.unionByName(frame.limit(1)), [0.5])
    with pytest.raises(ValueError, match="both classes"):
        P.base_rate_sample(frame.where("label = 0"), [0.5])


def base_rate_sides(spark, n=1500):
    """(variant, sample_id, label, score) of two variants and their thresholds."""
    rng = random.Random(5)
    rows = [(f"s{i}", int(rng.random() < 0.3)) for i in range(n)]
    values = {v: [round(rng.random(), 2) for _ in rows] for v in ("linear", "tree")}
    data = [(v, i, y, x) for v in values for (i, y), x in zip(rows, values[v])]
    scores = spark.createDataFrame(data, "variant string, sample_id string, label int, score double")
    return data, scores, spark.createDataFrame([("linear", 0.4), ("tree", 0.7)], "variant string, threshold double")


def brute_base_rate(data, variant, rate, threshold):
    """Confusion counts, AP and AUC of one variant at one prevalence."""
    side = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i, y, x) for v, i, y, x in data if v == variant)
    low, high = ([r for r in side if r[2] == label] for label in (0, 1))
    want = round(rate * len(low) / (1 - rate))
    kept = low + high[:want] if want <= len(high) else low[: round(len(high) * (1 - rate) / rate)] + high
    labels, scores = [r[2] for r in kept], [r[3] for r in kept]
    at = lambda label, hit: sum(y == label and (x >= threshold) == hit for y, x in zip(labels, scores))
    return (at(0, False), at(0, True), at(1, False), at(1, True)), brute(labels, scores)[:2]


def check_base_rates(data, report, variants):
    got = {(r["variant"], r["requested_prevalence"]): r for r in report.collect()}
    assert set(got) == {(v, p) for v in variants for p in (0.01, 0.05, 0.6)}
    for (variant, rate), row in got.items():
        (tn, fp, fn, tp), (ap, auc) = brute_base_rate(data, variant, rate, variants[variant])
        assert (row["benign"], row["phishing"], row["total"]) == (tn + fp, fn + tp, tn + fp + fn + tp)
        assert row["recall"] == pytest.approx(tp / (tp + fn)) and row["false_positive_rate"] == pytest.approx(fp / (fp + tn))
        assert (row["average_precision"], row["roc_auc"]) == (pytest.approx(ap), pytest.approx(auc))
        assert len(row["manifest"]) == 64
    return got


def test_base_rates_hash_an_id_once_for_all_variants_and_rates(spark, monkeypatch):
    data, scores, chosen = base_rate_sides(spark)
    written = []

    def recorded(frame, purpose):
        out = write_and_read(frame, purpose)
        written.append((purpose, out.count()))
        return out

    monkeypatch.setattr(P, "write_and_read", recorded)
    report = T.base_rates(scores, chosen, rates=[0.01, 0.05, 0.6])
    check_base_rates(data, report, {"linear": 0.4, "tree": 0.7})
    # 1,500 ids, and at most 101 scores in each of two variants.
    assert dict(written)["base-rates"] == 1500 and [p for p, _ in written].count("base-rates") == 1
    assert sum(n for _, n in written) <= 1500 + 2 * 101


def test_base_rates_of_variants_with_other_ids(spark):
    data, scores, chosen = base_rate_sides(spark)
    left_out = {f"s{i}" for i in range(0, 1500, 7)}
    data = [r for r in data if r[0] == "linear" or r[1] not in left_out]
    some = scores.where((F.col("variant") == "linear") | ~F.col("sample_id").isin(*left_out))
    got = check_base_rates(data, T.base_rates(some, chosen, rates=[0.01, 0.05, 0.6]), {"linear": 0.4, "tree": 0.7})
    assert got["linear", 0.05]["manifest"] != got["tree", 0.05]["manifest"]
    twice = scores.unionByName(scores.where("variant = 'tree'").limit(1))
    with pytest.raises(ValueError, match="unique"):
        T.base_rates(twice, chosen)


def test_report_sides_are_columns_of_the_orders(spark):
    _, _, new = report_queries.sides(spark, "/root/testdata/sf0.001")
    assert set(VARIANTS) < set(new.columns)
    assert "Join" not in new._jdf.queryExecution().optimizedPlan().toString()


def test_windows(spark):
    frame = spark.createDataFrame([("a", 300), ("b", 128), ("c", 127), ("d", 0)], "k string, n int")
    tokens = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    windows = sliding_windows(frame, "k", tokens)
    assert sorted((r["k"], r["start"]) for r in windows.collect()) == [("a", 0), ("a", 64), ("a", 128), ("b", 0)]
    pooled = max_pool(frame, windows.withColumn("probability", F.lit(0.25)), "k")
    assert {r["k"]: r["score"] for r in pooled.collect()} == {"a": 0.25, "b": 0.25, "c": 0.0, "d": 0.0}


def test_validation(spark):
    frame = spark.createDataFrame([("0", "benign"), ("1", "x"), (" 1", "Phishing"), ("1", "benign"), (None, None)], "label string, type string")
    dual = [r[0] for r in frame.select(V.label_dual(F.col("label"), F.col("type"))).collect()]
    assert dual == [0, 1, 1, None, None]
    with pytest.raises(ValueError, match="<NA>"):
        V.fail_on_values(frame, V.label_inverted(F.col("label")).isNull(), F.col("label"), "unknown labels")
    with pytest.raises(ValueError, match="missing"):
        V.require_columns(frame, ["url"])
    dates = ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05", "x", None, "2024-13-01"]
    shown = [r[0] for r in spark.createDataFrame([(d,) for d in dates], "d string").select(V.format_utc(V.parse_utc(F.col("d")))).collect()]
    assert shown == ["2024-01-02T00:00:00Z", "2024-01-02T03:04:05Z", "2024-01-02T01:04:05Z", None, None, None, None]
    with pytest.raises(Exception, match="must be 0 or 1"):
        V.accept_record(spark.createDataFrame([(2, "u")], "label int, url string")).collect()
    with pytest.raises(ValueError, match="finite"):
        V.require_scores(scored(spark, [0, 1], [0.1, float("nan")]))


def test_null_keys_are_kept_or_refused(spark):
    from sitesift.operators import groups, metrics, records, splits

    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, None, 1)], "sample_id int, k string, label int")
    with pytest.raises(Exception, match="must not be null"):
        splits.grouped_split(rows, "k").collect()
    with pytest.raises(Exception, match="must not be null"):
        groups.dedupe_keep_first(rows, "k", "sample_id").collect()
    with pytest.raises(Exception, match="must not be null"):
        groups.connected_groups(rows.withColumn("f", F.lit("")), "k", "f").collect()
    unlabelled = rows.withColumn("label", F.when(F.col("label") == 1, 1))
    assert splits.oof_folds(unlabelled, "sample_id").count() == 3
    assert {(r["k"], r["n"]) for r in metrics.latency_summary(rows, "sample_id", ["k"]).collect()} == {("a", 2), (None, 1)}
    raw = spark.createDataFrame([(1, "http://x.com/", 0), (2, "http://x.com", 0), (3, "", 1), (4, " ", 1)], "o int, url string, label int")
    got = {r["metric"]: r["value"] for r in records.audit_report(raw, "o").collect()}
    assert (got["raw_rows"], got["invalid_urls"], got["canonical_rows"], got["duplicate_rows"]) == (4, 2, 1, 1)
