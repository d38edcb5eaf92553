"""Every registered query with reference SQL, compared on the smallest tables."""

import inspect
import os
import re

import pytest

import __spark_entry__
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    assert compare(spark, database, name, __spark_entry__.queries()[name], ORACLES[name], SF_DIR) is None


def test_registry_and_entry(spark):
    queries = __spark_entry__.queries()
    assert set(ORACLES) <= set(queries)
    assert all(re.fullmatch("[a-z][a-z0-9_]*", name) for name in queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_customer_urls_use_all_cores(spark):
    from sitesift.plans.catalog.inputs import shop_urls

    source = "/root/testdata/sf0.001"
    urls = shop_urls(spark, source)
    assert urls.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert urls.count() == spark.read.parquet(f"{source}/customer.parquet").count()


def test_split_reads_stored_features_and_fits_use_all_cores(spark, monkeypatch):
    from sitesift.plans.catalog import model_queries

    read, split = [], model_queries.grouped_split
    monkeypatch.setattr(model_queries, "grouped_split", lambda frame: read.extend(frame.inputFiles()) or split(frame))
    parts = model_queries.parts(spark, "/root/testdata/sf0.001")
    assert read and all("/features-" in path for path in read)
    assert all(part.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism for part in parts)


def test_train_variants_runs_the_whole_grid(spark, monkeypatch):
    from sitesift.constants import HASH_DIM, LINEAR_ALPHAS, TREE_ESTIMATORS
    from sitesift.plans.catalog import model_queries

    signature, called = inspect.signature(model_queries.T.train_variants), []

    def record(*args, **settings):
        bound = signature.bind(*args, **settings)
        bound.apply_defaults()
        called.append(bound.arguments)
        report = spark.createDataFrame([("linear",)], "variant string")
        return {"validation_report": report, "holdout_report": report, "primary": "linear"}

    monkeypatch.setattr(model_queries, "parts", lambda spark, sf: ["train", "validation", "test"])
    monkeypatch.setattr(model_queries.T, "train_variants", record)
    assert __spark_entry__.queries()["train_variants"](spark, SF_DIR).count() == 2
    settings = called[0]
    assert [settings[k] for k in ("train", "validation", "holdout")] == ["train", "validation", "test"]
    assert list(settings["alphas"]) == LINEAR_ALPHAS and list(settings["estimators"]) == TREE_ESTIMATORS
    assert settings["max_iter"] == 30 and settings["hash_dim"] == HASH_DIM
