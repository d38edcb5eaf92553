"""Model queries: fitted on page records, so results are checked by row counts and by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitesift.functions.urls import authority_host, canonicalize_url
from sitesift.operators.groups import dedupe_keep_first
from sitesift.operators.records import all_features
from sitesift.operators.splits import grouped_split
from sitesift.plans import models as M
from sitesift.plans import training as T
from sitesift.plans.catalog.inputs import rich_pages, spread
from sitesift.plans.catalog.registry import query
from sitesift.session import shared_folder, write_and_read
from sitesift.sources import tables as S

LINEAR = M.LinearConfig()
NARROW = M.LinearConfig(max_iter=5, hash_dim=4096)
TREE = M.TreeConfig(n_estimators=3, max_depth=3, hash_dim=128)


def split_records(spark, sf):
    """Records with a split by host; label 1 for plain http."""
    named = rich_pages(spark, sf).withColumn("sample_id", F.sha2(canonicalize_url(F.col("url")), 256))
    features = all_features(dedupe_keep_first(named, "sample_id", "page_id")).withColumns({
        "label": F.startswith("url", F.lit("http:")).cast("int"),
        "group": authority_host(F.col("url")),
    }).drop("html")
    # The split reads its rows several times. Stored, they are not de-duplicated again for each.
    return write_and_read(grouped_split(write_and_read(features, "features")), "records")


def parts(spark, sf):
    # Without HTML the records are few bytes in few files; vectors and fits still use all cores.
    records = split_records(spark, sf)
    return [spread(records.where(F.col("split") == s), "sample_id") for s in ("train", "validation", "test")]


@query("fit_linear")
def _(spark, sf):
    train, validation, _ = parts(spark, sf)
    model = M.fit_linear(M.linear_vectors(train, LINEAR), LINEAR)
    return M.score_linear(model, M.linear_vectors(validation, LINEAR)).select("sample_id", "label", "score")


@query("write_model")
def _(spark, sf):
    train, _, _ = parts(spark, sf)
    weights, intercept = M.linear_weights(M.fit_linear(M.linear_vectors(train, LINEAR), LINEAR), LINEAR)
    path = shared_folder(spark, "model")
    S.write_model(weights, S.model_params(intercept, 0.5, metadata={"variant": "linear"}), path)
    return S.read_model(spark, path)[0]


@query("fit_tree")
def _(spark, sf):
    train, validation, _ = parts(spark, sf)
    model = M.fit_tree(M.tree_vectors(train, TREE), TREE)
    return M.score_tree(model, M.tree_vectors(validation, TREE)).select("sample_id", "label", "score")


@query("fit_hybrid")
def _(spark, sf):
    train, validation, _ = parts(spark, sf)
    model = M.fit_hybrid(M.with_vectors(train, NARROW, TREE), M.HybridConfig(), NARROW, TREE)
    return M.score_hybrid(model, M.with_vectors(validation, NARROW, TREE)).select("sample_id", "label", "score")


@query("train_candidates")
def _(spark, sf):
    train, validation, _ = parts(spark, sf)
    report, failures, _ = T.train_candidates(train, validation)
    return report.withColumn("failures", F.lit(len(failures)))


@query("train_variants")
def _(spark, sf):
    result = T.train_variants(*parts(spark, sf))
    report = result["validation_report"].withColumn("split", F.lit("validation")).unionByName(
        result["holdout_report"].withColumn("split", F.lit("holdout"))
    )
    return report.withColumn("primary", F.col("variant") == result["primary"])


@query("cross_dataset_report")
def _(spark, sf):
    train, validation, test = parts(spark, sf)
    hybrid = M.fit_hybrid(M.with_vectors(train, NARROW, TREE), M.HybridConfig(), NARROW, TREE)
    models = {"linear": hybrid.linear, "tree": hybrid.tree, "hybrid": hybrid}
    scores = {
        name: write_and_read(T.score_frozen(models, M.with_vectors(side, NARROW, TREE)), name)
        for name, side in (("validation", validation), ("test", test))
    }
    chosen = write_and_read(T.thresholds(scores["validation"]), "thresholds")
    comparator = test.select("sample_id", "label", F.least(F.length("title") / 100.0, F.lit(1.0)).alias("score"))
    report = T.cross_dataset_report(
        T.report_at(scores["validation"], chosen), chosen, scores["test"], comparator, replicates=20
    )
    return report["bootstrap"].join(report["delta"], "variant").join(report["metrics"], "variant")
