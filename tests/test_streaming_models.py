"""Streams equal batches, restarts lose nothing, models learn a separable toy set."""

import pytest
from pyspark.sql import functions as F

from sitesift.operators.records import canonical_records, reason_counts
from sitesift.operators.screening import column_scores, screen_columns
from sitesift.plans import models as M
from sitesift.plans import training as T
from sitesift.session import shared_folder
from sitesift.streaming import pages as S
from sitesift.streaming import tabs
from sitesift.streaming.train import StreamConfig, read_counts, train_stream

SCHEMA = "ord long, url string, html string, date string, label string"
CONFIG = StreamConfig(hash_dim=256, passes=2, source="toy")


def raw_rows(spark, start, stop):
    i = F.col("id")
    bad = F.pmod(i, F.lit(2)) == 1
    return spark.range(start, stop).select(
        i.alias("ord"),
        F.when(F.pmod(i, F.lit(11)) == 10, " ").otherwise(
            F.concat(F.when(bad, "http://login-verify").otherwise("https://garden"), i, F.lit(".example/x"))).alias("url"),
        F.when(bad, "<title>Verify your wallet</title><body>pay</body>").otherwise("<title>Roses and tulips</title><body>hi</body>").alias("html"),
        F.concat(F.lit("2024-01-"), F.lpad((F.pmod(i, F.lit(28)) + 1).cast("string"), 2, "0")).alias("date"),
        F.when(bad, "phish").otherwise("benign").alias("label"),
    )


def put(spark, folder, name, start, stop):
    raw_rows(spark, start, stop).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    return S.stream_records(raw)


def as_dict(frame):
    return {(r["kind"], r["reason"]): r["n"] for r in frame.collect()}


def test_training_resumes_where_it_stopped(spark, tmp_path):
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    for folder in (whole, cut):
        put(spark, folder, "a", 0, 30)
    states = str(tmp_path / "s1"), str(tmp_path / "s2")
    train_stream(stream(spark, cut), states[1], CONFIG)
    for folder in (whole, cut):
        put(spark, folder, "b", 30, 60)
    full, bias = train_stream(stream(spark, whole), states[0], CONFIG)
    resumed, again = train_stream(stream(spark, cut), states[1], CONFIG, resume=True)
    assert again == pytest.approx(bias)
    left = {r["idx"]: r["weight"] for r in full.collect()}
    assert {r["idx"]: r["weight"] for r in resumed.collect()} == pytest.approx(left, abs=1e-6)
    batch = as_dict(reason_counts(canonical_records(raw_rows(spark, 0, 60))))
    assert as_dict(read_counts(spark, states[0])) == as_dict(read_counts(spark, states[1])) == batch
    with pytest.raises(ValueError, match="resume=True"):
        train_stream(stream(spark, cut), states[1], CONFIG)
    with pytest.raises(ValueError, match="alpha"):
        train_stream(stream(spark, cut), states[1], StreamConfig(alpha=0.5, hash_dim=256, passes=2, source="toy"), resume=True)
    records = canonical_records(raw_rows(spark, 100, 140)).where("reject_reason is null")
    from sitesift.operators.scoring import score_pages

    means = {r["label"]: r["m"] for r in score_pages(records, full, bias, True, 256).groupBy("label").agg(F.avg("score").alias("m")).collect()}
    assert means[1] > 0.7 > 0.3 > means[0]


def test_counts_and_scores_equal_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, "a", 0, 20)
    put(spark, folder, "b", 20, 33)
    out = shared_folder(spark, "counts")
    S.drain_to_table(S.stream_counts(stream(spark, folder)), str(tmp_path / "c1"), out, "complete")
    batch = canonical_records(raw_rows(spark, 0, 33))
    assert as_dict(S.latest_batch(spark, out, "kind string, reason string, n bigint")) == as_dict(reason_counts(batch))
    before = S.stream_cutoff_filter(stream(spark, folder), F.lit("2024-01-10").cast("timestamp"), "before").where("reject_reason is null").select("ord")
    kept = S.drain_to_table(before, str(tmp_path / "c2"), str(tmp_path / "kept"))
    assert sorted(r["ord"] for r in kept.collect()) == [i for i in range(33) if i % 28 + 1 < 10 and i % 11 != 10]


def test_stream_dedupe_across_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    for name, rows in (("a", [("x", 1), ("y", 2), ("x", 3)]), ("b", [("x", 4), ("z", 5), ("z", 6)])):
        spark.createDataFrame(rows, "sample_id string, ord long").coalesce(1).write.parquet(f"{folder}/{name}")
    source = spark.readStream.schema("sample_id string, ord long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    got = S.stream_dedupe(source, str(tmp_path / "c"), str(tmp_path / "out")).collect()
    assert sorted(r["sample_id"] for r in got) == ["x", "y", "z"]


EVENTS = [
    (1, 1, "navigate", "a"), (1, 2, "result", "a"), (1, 3, "result", "b"), (1, 4, "navigate", "b"), (1, 5, "result", "a"),
    (1, 6, "result", "b"), (2, 1, "result", "a"), (2, 2, "navigate", "a"), (2, 3, "result", "a"), (2, 4, "close", "a"), (2, 5, "result", "a"),
]
STALE = {(1, 2): False, (1, 3): True, (1, 5): True, (1, 6): False, (2, 1): True, (2, 3): False, (2, 5): True}


def tab_frame(spark, rows=EVENTS):
    return spark.createDataFrame([(t, e, k, u) for t, e, k, u in rows], "tab long, event_id long, kind string, url string").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") * 1800))


def test_stale_results_batch_and_stream(spark, tmp_path):
    for bucket in (None, F.lit(1), F.col("event_id")):
        got = {(r["tab"], r["event_id"]): r["stale"] for r in tabs.stale_results(tab_frame(spark), bucket).collect()}
        assert got == STALE
    latest = {r["tab"]: (r["event_id"], r["url"]) for r in tabs.latest_state_per_key(tab_frame(spark)).collect()}
    assert latest == {1: (6, "b")}
    folder = str(tmp_path / "ev")
    for name, rows in (("a", [e for e in EVENTS if e[1] <= 2]), ("b", [e for e in EVENTS if e[1] > 2])):
        tab_frame(spark, rows).coalesce(1).write.parquet(f"{folder}/{name}")
    source = spark.readStream.schema(tab_frame(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    out = tabs.stream_stale_results(source, str(tmp_path / "c"), str(tmp_path / "o"))
    assert {(r["tab"], r["event_id"]): r["stale"] for r in out.collect()} == STALE
    newest = tabs.stream_latest_state(source, str(tmp_path / "c3"), str(tmp_path / "o3"))
    assert {r["tab"]: (r["event_id"], r["url"]) for r in newest.collect()} == latest


def test_state_outlives_restarts(spark, tmp_path):
    """Drained after every file, as over one run; what a closed tab had is gone."""
    folder, got = str(tmp_path / "in"), None
    for n, event in enumerate([*EVENTS, (1, 7, "close", ""), (3, 8, "navigate", "z"), (3, 9, "result", "z")]):
        tab_frame(spark, [event]).coalesce(1).write.parquet(f"{folder}/{n:02d}")
        if n % 5 == 4 or n == 13:
            source = spark.readStream.schema(tab_frame(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
            got = tabs.stream_latest_state(source, str(tmp_path / "c"), str(tmp_path / "o"))
    assert {r["tab"]: (r["event_id"], r["url"]) for r in got.collect()} == {3: (9, "z")}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def toy(spark, start=0, stop=60):
    from sitesift.functions.urls import authority_host

    rows = canonical_records(raw_rows(spark, start, stop)).where("reject_reason is null")
    return rows.withColumn("group", authority_host(F.col("url")))


def test_models_learn(spark):
    linear = M.LinearConfig(alpha=1e-4, max_iter=15, hash_dim=256)
    tree = M.TreeConfig(n_estimators=3, max_depth=2, hash_dim=32)
    fit_on, check_on = M.with_vectors(toy(spark), linear, tree), M.with_vectors(toy(spark, 60, 90), linear, tree)
    model = M.fit_linear(fit_on, linear)
    hybrid = M.fit_hybrid(fit_on, M.HybridConfig(folds=2), linear, tree)
    for scored in (M.score_linear(model, check_on), M.score_tree(M.fit_tree(fit_on, tree), check_on), M.score_hybrid(hybrid, check_on)):
        wrong = scored.where((F.col("score") >= 0.5).cast("int") != F.col("label")).count()
        assert wrong == 0 and scored.where("score < 0 or score > 1").count() == 0
    weights, intercept = M.linear_weights(model, linear)
    from sitesift.operators.scoring import score_pages

    by_table = {r["sample_id"]: r["score"] for r in score_pages(toy(spark, 60, 90), weights, intercept, True, 256).collect()}
    by_model = {r["sample_id"]: r["score"] for r in M.score_linear(model, check_on).collect()}
    assert by_table == pytest.approx(by_model, abs=1e-4)
    with pytest.raises(ValueError, match="empty"):
        M.check_training(toy(spark).limit(0))


def test_screening_by_brute_force(spark):
    """Against the textbook sum over the four cells; the choice is stored and decides the vector."""
    rows = [(i, int(i % 3 == 0), [b for b in range(20) if (i * (b + 3)) % (b + 2) < 2 or b == 7]) for i in range(60)]
    frame = spark.createDataFrame([*rows, (99, None, [1, 2])], "id int, label int, buckets array<int>")
    want = {}
    for b in range(20):
        cells = [[sum((b in s) == on and y == lab for _, y, s in rows) for lab in (1, 0)] for on in (True, False)]
        if not sum(cells[0]):
            continue
        expected = [[sum(r) * sum(c[k] for c in cells) / 60 for k in (0, 1)] for r in cells]
        chi = sum((o - e) ** 2 / e for r, s in zip(cells, expected) for o, e in zip(r, s) if e)
        want[b] = (*cells[0], pytest.approx(chi, abs=1e-9))
    got = {r["idx"]: (r["positive"], r["negative"], r["chi_square"]) for r in column_scores(frame).collect()}
    assert got == want and got[7][2] == 0
    best = [r["idx"] for r in screen_columns(frame, 5).collect()]
    assert best == sorted(got, key=lambda b: (-got[b][2], b))[:5]
    assert screen_columns(frame.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="positive"):
        screen_columns(frame, 0)

    linear, tree = M.LinearConfig(hash_dim=256), M.TreeConfig(n_estimators=1, max_depth=2, hash_dim=12)
    vectors = M.with_vectors(toy(spark), linear, tree)
    model = M.fit_tree(vectors, tree)
    chosen = {r["idx"] for r in screen_columns(vectors, 12).collect()}
    assert set(model.columns[:12]) == chosen and model.columns[12:] == list(range(256, 256 + 39))
    full, part = M._tree_input(vectors, model.columns).select("features", "tree_features").first()
    assert part.toArray().tolist() == [full[i] for i in model.columns]


def test_candidates_and_failures(spark, monkeypatch):
    real = T.fit_linear

    def flaky(vectors, config):
        if config.alpha == 1e-3:
            raise RuntimeError("boom")
        return real(vectors, config)

    monkeypatch.setattr(T, "fit_linear", flaky)
    report, failures, models = T.train_candidates(toy(spark), toy(spark, 60, 90), [1e-4, 1e-3], [True], 5, hash_dim=256)
    assert report.count() == 1 and failures[0]["message"] == "boom" and set(models) == {(True, 1e-4)}
    assert T.best_candidate(report).first()["alpha"] == 1e-4
    both = T.combined_training(toy(spark), toy(spark, 60, 90))
    assert {r["source"] for r in both.select("source").distinct().collect()} == {"first", "second"}


def test_gradient_is_that_of_all_rows(spark):
    """Rows equal but for their page features, and repeated rows, each count; against numpy."""
    import numpy as np

    from sitesift.constants import NUMERIC_FEATURES
    from sitesift.operators.vectors import add_vector_parts
    from sitesift.streaming.train import STATE_SCHEMA, gradient_step

    rows = toy(spark, 0, 12).drop("group")
    other = rows.limit(4).withColumn("dom_iframe_count", F.lit(7.0))
    every = rows.unionByName(other).unionByName(rows.limit(3)).unionByName(rows.limit(3)).repartition(5)
    config = StreamConfig(hash_dim=64, alpha=0.01, passes=1)
    vectors = add_vector_parts(every, True, 64).select("label", "buckets", "numeric").cache()
    got = vectors.collect()
    width = 64 + len(NUMERIC_FEATURES)
    x = np.zeros((len(got), width + 1))
    for i, r in enumerate(got):
        x[i, r["buckets"]] = 1
        x[i, 64:width] = np.float32(r["numeric"])
        x[i, width] = 1
    y = np.array([r["label"] for r in got])
    w, seen = np.zeros(width + 1), np.zeros(width + 1)
    state = spark.createDataFrame([], STATE_SCHEMA)
    for _ in range(3):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(got)
        g[:width] += 0.01 * w[:width]
        seen += g * g
        w = w - 0.5 * g / (np.sqrt(seen) + 1e-8)
        state = spark.createDataFrame(gradient_step(vectors, state, len(got), config).collect(), STATE_SCHEMA)
    found = np.zeros(width + 1)
    for r in state.collect():
        found[r["idx"]] = r["weight"]
    assert len(got) == 21 and found == pytest.approx(w, abs=1e-9)


def test_killed_inside_a_file_and_resumed(spark, tmp_path):
    """Killed in a batch that ends inside a file: resumed, weights and counters are those of one run."""
    from sitesift.streaming.positions import committed, file_positions, rows_between, train_positions
    from sitesift.streaming.train import read_state

    folder = str(tmp_path / "rows")
    for n, (low, high) in enumerate(((0, 17), (17, 18), (18, 45), (45, 60))):
        put(spark, folder, f"part-{n}", low, high)
    files = file_positions(spark, folder)
    assert [(r["rows"], r["start"]) for r in files.orderBy("start").collect()] == [(17, 0), (1, 17), (27, 18), (15, 45)]
    part = rows_between(files, SCHEMA, 16, 47).collect()
    assert sorted((r["position"], r["ord"]) for r in part) == [(i, i) for i in range(16, 47)]
    runs = 0

    def dying(raw):
        nonlocal runs
        runs += 1
        if runs == 3:
            raise RuntimeError("killed")
        return S.stream_records(raw)

    whole, cut = str(tmp_path / "s1"), str(tmp_path / "s2")
    assert train_positions(spark, folder, SCHEMA, S.stream_records, whole, CONFIG, 13) == (5, 60)
    with pytest.raises(RuntimeError, match="killed"):
        train_positions(spark, folder, SCHEMA, dying, cut, CONFIG, 13)
    assert committed(spark, cut) == (2, 26)
    for settings, rows in ((CONFIG, 12), (StreamConfig(hash_dim=256, passes=1, source="toy"), 13)):
        with pytest.raises(ValueError, match="mismatch"):
            train_positions(spark, folder, SCHEMA, S.stream_records, cut, settings, rows, resume=True)
    assert train_positions(spark, folder, SCHEMA, S.stream_records, cut, CONFIG, 13, resume=True) == (5, 60)
    (left, bias), (right, again) = read_state(spark, whole, CONFIG), read_state(spark, cut, CONFIG)
    assert bias == pytest.approx(again)
    assert {r["idx"]: r["weight"] for r in left.collect()} == pytest.approx({r["idx"]: r["weight"] for r in right.collect()}, abs=1e-6)
    batch = as_dict(reason_counts(canonical_records(raw_rows(spark, 0, 60))))
    assert as_dict(read_counts(spark, cut)) == as_dict(read_counts(spark, whole)) == batch


@pytest.mark.parametrize("name", ["stream_pages", "stream_counts", "score_stream", "live_scan_scores", "stream_cutoff_filter"])
def test_stream_tables_may_be_folders(spark, tmp_path, name):
    from sitesift.plans.catalog import QUERIES

    source, folder = "/root/testdata/sf0.001", str(tmp_path / "folders")
    for table in ("pages", "events"):
        spark.read.parquet(f"{source}/{table}.parquet").repartition(3).write.parquet(f"{folder}/{table}.parquet")
    rows = [sorted(map(str, QUERIES[name](spark, path).collect())) for path in (source, folder)]
    assert rows[0] and rows[0] == rows[1]


def test_rows_of_one_file_use_all_cores(spark, tmp_path):
    from sitesift.streaming.positions import file_positions, rows_between

    folder = str(tmp_path / "in")
    put(spark, folder, "a", 0, 50)
    files = file_positions(spark, folder)
    got = rows_between(files, SCHEMA, 5, 45)
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r["position"], r["ord"]) for r in got.collect()) == [(i, i) for i in range(5, 45)]


def test_keyed_state_works_on_rows(spark, tmp_path):
    """Also without a value in the order; a data frame for each key of a batch is too slow for many keys."""
    from sitesift.streaming import keyed

    assert not hasattr(keyed, "pd")
    folder = str(tmp_path / "in")
    spark.createDataFrame([("x", None), ("x", 4), ("y", None), ("x", 3)], "sample_id string, ord long").coalesce(1).write.parquet(f"{folder}/a")
    source = spark.readStream.schema("sample_id string, ord long").parquet(f"{folder}/*")
    got = S.stream_dedupe(source, str(tmp_path / "c"), str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == [("x", 3), ("y", None)]
    tab_frame(spark).coalesce(1).write.parquet(f"{folder}-ev/a")
    source = spark.readStream.schema(tab_frame(spark).schema).parquet(f"{folder}-ev/*")
    newest = tabs.stream_latest_state(source, str(tmp_path / "c2"), str(tmp_path / "o2"))
    assert newest.collect() == tabs.latest_state_per_key(tab_frame(spark)).select(*newest.columns).collect()
