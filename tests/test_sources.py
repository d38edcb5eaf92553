"""Sources and sinks on files written by the tests."""

import csv
import zipfile

import pytest
from pyspark.sql import functions as F

from sitesift.constants import CSV_DOM_COLUMNS, DOM_FEATURES, HASH_DIM, NUMERIC_FEATURES
from sitesift.operators.records import canonical_records, counter_consistency, reason_counts
from sitesift.sources import tables as T
from sitesift.sources.archives import load_site_archives, read_members


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as handle:
        writer = csv.writer(handle)
        writer.writerow(header)
        writer.writerows(rows)
    return str(path)


def labelled(path, rows, header_extra=()):
    header = ["URL", "Title", "label", *CSV_DOM_COLUMNS, *header_extra]
    return write_csv(path, header, [[*r, *["2"] * (len(CSV_DOM_COLUMNS) - 1), "x", *["9"] * len(header_extra)] for r in rows])


def test_labelled_csv(spark, tmp_path):
    path = labelled(tmp_path / "a.csv", [
        ["https://a.co.uk/p", "one, two", "0"], ["https://A.co.uk/p/", "dup", "1"], ["https://b.example", "", "1"],
    ], ["URLSimilarityIndex", "FILENAME"])
    got = {r["url"]: r for r in T.scan_labelled_csv(spark, path).collect()}
    assert set(got) == {"https://a.co.uk/p", "https://b.example"}
    a = got["https://a.co.uk/p"]
    assert (a["label"], a["title"], a["group"]) == (1, "one, two", "a.co.uk") and got["https://b.example"]["label"] == 0
    assert a["dom_html_line_count"] == 2.0 and a["dom_external_ref_count"] == 0.0 and a["dom_url_length"] == 17.0
    assert set(a.asDict()) == {"url", "title", "label", "sample_id", "group", *["dom_" + n for n in NUMERIC_FEATURES]}
    with pytest.raises(ValueError, match="unknown labels"):
        T.scan_labelled_csv(spark, labelled(tmp_path / "b.csv", [["https://a.com", "", "2"], ["https://b.com", "", ""]]))
    with pytest.raises(ValueError, match="Title"):
        T.scan_labelled_csv(spark, write_csv(tmp_path / "c.csv", ["URL", "label"], [["u", "0"]]))


def test_csv_with_html(spark, tmp_path):
    for side, name, text in (("p", "one", "<title>P</title><body>bank</body>"), ("p", "two", "<title>Q</title>"), ("b", "one", "<title>B</title>")):
        (tmp_path / side).mkdir(exist_ok=True)
        (tmp_path / side / f"{name}.html").write_text(text)
    path = write_csv(tmp_path / "split.csv", ["file_name", "url", "label", "type", "split"], [
        ["one", "https://p.com/1", "1", "phishing", "train"], ["one.html", "https://b.com", "", "benign", "test"],
        ["two", "https://p.com/1/", "1", "", "train"], ["gone", "https://x.com", "1", "", "train"], ["two", " ", "1", "", "train"],
    ])
    roots = (str(tmp_path / "p"), str(tmp_path / "b"))
    rows = {r["url"]: r for r in T.scan_csv_with_html(spark, path, *roots).collect()}
    assert {u: (r["title"], r["label"], r["split"]) for u, r in rows.items()} == {
        "https://p.com/1": ("P", 1, "train"), "https://b.com": ("B", 0, "test")}
    assert rows["https://p.com/1"]["dom_mentions_bank"] == 1.0
    assert T.scan_csv_with_html(spark, path, *roots, limit=1).count() == 1
    bad = write_csv(tmp_path / "bad.csv", ["file_name", "url", "label", "type"], [["one", "u", "1", "benign"]])
    with pytest.raises(ValueError, match="unknown labels"):
        T.scan_csv_with_html(spark, bad, *roots)


def make_zip(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, text in members:
            archive.writestr(name, text)
    return str(path)


GOOD = "{'url': 'https://%s', 'family_id': %s, 'brand': 'B', 'isotime': '2024-01-01T00:00:00Z'}"


def test_archives(spark, tmp_path):
    phish = make_zip(tmp_path / "p.zip", [
        ("s1/info.txt", GOOD % ("one.com/a", "'kit-1'")), ("s1/HTML.TXT", "<title>One</title><body>pay</body>"),
        ("s2\\info.txt", GOOD % ("two.com", "'kit-1'")), ("s2\\html.txt", "x"), ("s2/deep/other.txt", "n"),
        ("s3/info.txt", "{'url': }"), ("s3/html.txt", "x"), ("s4/info.txt", GOOD % ("  ", "None")), ("s4/html.txt", "x"),
        ("s5/shot.png", "x"), ("s6/info.txt", GOOD % ("one.com/a/", "'None'")), ("s6/html.txt", "x"), ("top.txt", "x"),
    ])
    benign = make_zip(tmp_path / "b.zip", [("g1/info.txt", "https://good.example/\n"), ("g1/html.txt", b"<title>G\xff</title>"), ("g2/html.txt", "x")])
    records, audit = load_site_archives(spark, phish, benign)
    got = {r["source_member"]: r for r in records.collect()}
    assert set(got) == {"s1", "s2", "g1"}
    assert got["s1"]["group"] == got["s2"]["group"] == "domain:one.com" and got["g1"]["group"] == "domain:good.example"
    assert (got["s1"]["title"], got["s1"]["dom_mentions_pay"], got["s1"]["source_family_id"]) == ("One", 1.0, "kit-1")
    assert got["g1"]["title"] == "G�" and got["g1"]["source_class"] == "benign"
    p, b = (audit.where(f"label = {n}").first().asDict() for n in (1, 0))
    assert {k: p[k] for k in ("accepted", "candidate_pairs", "duplicate_url", "invalid_metadata", "invalid_url", "missing_html", "missing_info", "sample_directories", "scanned_directories")} == {
        "accepted": 2, "candidate_pairs": 5, "duplicate_url": 1, "invalid_metadata": 1, "invalid_url": 1,
        "missing_html": 1, "missing_info": 1, "sample_directories": 6, "scanned_directories": 6}
    assert (b["accepted"], b["missing_info"], p["scan_capped"]) == (1, 1, False)
    capped, audit = load_site_archives(spark, phish, benign, limit=2)
    assert {r["source_member"] for r in capped.collect()} == {"s1", "g1"}
    row = audit.where("label = 1").first()
    assert (row["scanned_directories"], row["sample_directories"], row["scan_capped"]) == (1, 6, True)


def test_archives_in_parts_and_damage(spark, tmp_path, monkeypatch):
    """A folder of archives, members far apart, stored and deflated; a damaged member fails."""
    import zlib

    from sitesift.sources import archives as Z

    rows = [(n % 2, f"s{n}", "html.txt", f"<title>{n}</title>" + "x" * n * 100) for n in range(50)]
    rows += [(n % 2, f"s{n}", "info.txt", f"https://h{n}.example/" if n % 2 == 0 else GOOD % (f"p{n}.example", n)) for n in range(50)]
    folder = f"file://{tmp_path}/zips"
    assert Z.write_site_archives(spark.createDataFrame(rows, "label int, site string, basename string, content string").repartition(7), folder) == 100
    monkeypatch.setattr(Z, "RANGE_BYTES", 64)
    got = {r["site"]: bytes(r["content"]) for r in read_members(spark, f"{folder}/0", 0, "html.txt").where("content is not null").collect()}
    assert got == {s: c.encode() for label, s, b, c in rows if label == 0 and b == "html.txt"}
    records, audit = load_site_archives(spark, f"{folder}/1", f"{folder}/0")
    assert records.count() == 50 and {r["accepted"] for r in audit.collect()} == {25}
    path = make_zip(tmp_path / "d.zip", [("s/html.txt", "some text that will be damaged"), ("s/info.txt", "u")])
    data = bytearray(open(path, "rb").read())
    at = data.index(b"some text")
    data[at] ^= 1
    open(path, "wb").write(data)
    assert zlib.crc32(bytes(data[at:at + 30])) != zlib.crc32(b"some text that will be damaged")
    with pytest.raises(Exception, match="damaged member"):
        read_members(spark, path, 1, "html.txt").count()
    assert read_members(spark, path, 1, "info.txt").where("content is not null").count() == 1


def test_archive_errors(spark, tmp_path):
    one = make_zip(tmp_path / "1.zip", [("s/info.txt", GOOD % ("same.com", "1")), ("s/html.txt", "x")])
    same = make_zip(tmp_path / "2.zip", [("s/info.txt", "https://same.com"), ("s/html.txt", "x")])
    with pytest.raises(ValueError, match="conflicting labels"):
        load_site_archives(spark, one, same)
    twice = make_zip(tmp_path / "3.zip", [("s/info.txt", "u"), ("s/INFO.txt", "u"), ("s/html.txt", "x")])
    with pytest.raises(Exception, match="duplicate member"):
        load_site_archives(spark, one, twice)
    big = make_zip(tmp_path / "4.zip", [("s/info.txt", "u" * (1024 * 1024 + 1)), ("s/html.txt", "x")])
    with pytest.raises(Exception, match="too large"):
        load_site_archives(spark, one, big)
    broken = tmp_path / "5.zip"
    broken.write_bytes(b"not a zip")
    with pytest.raises(Exception, match="invalid site archive"):
        read_members(spark, str(broken), 1).count()


RAW = [
    (0, "https://a.example/login", "<title>A</title><body>x</body>", "2024-01-01T00:00:00Z", "phish"),
    (1, "https://b.example", "", "2024-01-02", "benign"), (2, "https://c.example", "<p>no title</p>", "2024-01-03", "benign"),
    (3, " ", "x", "2024-01-03", "benign"), (4, "https://d.example", "x", None, "phish"), (5, "https://e.example", "x", "2024-01-03", " "),
    (6, "https://f.example", "a\x00", "2024-01-03T01:00:00+01:00", "Phish "),
]


def raw(spark, rows=RAW):
    return spark.createDataFrame(rows, "ord long, url string, html string, date string, label string")


def test_canonical_records_and_counts(spark):
    records = canonical_records(raw(spark))
    by = {r["ord"]: r for r in records.collect()}
    assert [by[i]["parse_status"] for i in range(7)] == [
        "ok", "empty_document", "empty_title", "skipped", "skipped", "skipped", "parse_error"]
    assert [by[i]["reject_reason"] for i in (3, 4, 5)] == ["missing_url", "missing_date", "missing_label"]
    assert by[6]["date_text"] == "2024-01-03T00:00:00Z" and by[6]["label"] == 1
    counts = {(r["kind"], r["reason"]): r["n"] for r in reason_counts(records).collect()}
    assert counts[("class", "0")] == 2 and counts[("class", "1")] == 2 and counts[("reject", "missing_url")] == 1
    assert counter_consistency(reason_counts(records), F.lit(7)).first()["consistent"]
    assert not counter_consistency(reason_counts(records), F.lit(8)).first()["consistent"]
    for row, message in [((9, "https://x.com", "x", "2024-01-01", "spam"), "unknown label"), ((9, "https://x.com", "x", "2024-01-01T00:00:00", "phish"), "ISO-8601"),
                         ((9, "http://", "x", "2024-01-01", "phish"), "invalid url")]:
        with pytest.raises(Exception, match=message):
            canonical_records(raw(spark, [row])).collect()
    with pytest.raises(ValueError, match="missing page stream columns"):
        canonical_records(raw(spark).drop("html"))


def test_frozen_records(spark, tmp_path):
    path = str(tmp_path / "frozen")
    assert T.freeze_records(raw(spark), path, limit=5) == {"processed": 5, "accepted": 3, "rejected": 2}
    frozen = T.read_frozen(spark, path)
    assert frozen.count() == 3 and frozen.where("html <> ''").count() == 2
    with pytest.raises(Exception, match="already exists"):
        T.freeze_records(raw(spark), path)
    with pytest.raises(ValueError, match="empty"):
        empty = str(tmp_path / "none")
        frozen.limit(0).write.json(empty)
        T.read_frozen(spark, empty)
    csv_path = str(tmp_path / "input")
    T.records_to_input(frozen.where("html <> ''"), csv_path)
    assert T.read_scorer_input(spark, csv_path).count() == 2
    for name, rows, message in [
        ("dup", [["a", "1", "x"], ["a", "0", "y"]], "duplicate"), ("label", [["a", "2", "x"]], "malformed label"),
        ("html", [["a", "1", ""]], "malformed html"), ("id", [["", "1", "x"]], "malformed sample_id"),
    ]:
        with pytest.raises(ValueError, match=message):
            T.read_scorer_input(spark, write_csv(tmp_path / f"{name}.csv", ["sample_id", "label", "html"], rows))
    with pytest.raises(ValueError, match="missing required"):
        T.read_scorer_input(spark, write_csv(tmp_path / "m.csv", ["sample_id", "label"], [["a", "1"]]))


def test_predictions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.25, "m", "c"), ("b", 0, 1.0, "m", "c")], "sample_id string, label int, score double, model string, source_commit string")
    path = str(tmp_path / "predictions")
    T.write_predictions(rows, path)
    assert sorted(tuple(r) for r in T.read_predictions(spark, path).collect()) == sorted(tuple(r) for r in rows.collect())
    bad = write_csv(tmp_path / "bad.csv", T.PREDICTION_COLUMNS, [["a", "1", "1.5", "m", "c"]])
    with pytest.raises(ValueError, match="malformed predictions"):
        T.read_predictions(spark, bad)


def test_model_tables(spark, tmp_path):
    width = 64 + len(NUMERIC_FEATURES)
    weights = spark.range(width).select(F.col("id").cast("int").alias("idx"), (F.col("id") / 10).alias("weight"))
    params = T.model_params(0.5, 0.4, True, 64, {"variant": "linear"})
    T.write_model(weights, params, str(tmp_path / "model"))
    back, found = T.read_model(spark, str(tmp_path / "model"))
    assert found == params and back.count() == width and HASH_DIM == 262144
    nan = weights.withColumn("weight", F.when(F.col("idx") == 3, float("nan")).otherwise(F.col("weight")))
    for table, changes, message in [
        (weights.where("idx > 0"), {}, "dimension"), (nan, {}, "finite"), (weights, {"threshold": 1.5}, "threshold"),
        (weights, {"classes": [1, 0]}, "class order"), (weights, {"feature_version": "other"}, "version"),
        (weights, {"metadata": {"__proto__": 1}}, "unsafe"), (weights, {"intercept": float("inf")}, "intercept"),
        (weights, {"extra": 1}, "schema"), (weights, {"ngram_max": 6}, "ngram"),
    ]:
        with pytest.raises(ValueError, match=message):
            T.check_weights(table, {**params, **changes})


def test_reports_and_manifest(spark, tmp_path):
    import hashlib

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_bytes(b"hello")
    row = T.file_manifest(spark, str(tmp_path / "d")).first()
    assert (row["file"], row["bytes"], row["sha256"]) == ("f.txt", 5, hashlib.sha256(b"hello").hexdigest())
    T.write_report(spark.createDataFrame([("a", 0.5)], "k string, v double"), str(tmp_path / "r"))
    with pytest.raises(ValueError, match="finite"):
        T.write_report(spark.createDataFrame([("a", float("inf"))], "k string, v double"), str(tmp_path / "r2"))
    T.check_metadata({"variant": "linear", "rows": 3, "share": 0.5, "final": True})
    for bad in ({"a": {}}, {"a": float("nan")}, {"__proto__": "x"}, {1: "x"}, {"a": None}):
        with pytest.raises(ValueError, match="metadata"):
            T.check_metadata(bad)
    assert len(DOM_FEATURES) == 22


def test_large_html_member_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="too large"):
        read_members(spark, make_zip(tmp_path / "i.zip", [("s/html.txt", "x" * (16 * 1024 * 1024 + 1))]), 1).count()


def test_nested_html_files_are_found(spark, tmp_path):
    root = tmp_path / "html"
    for name in ("a.html", "site/html/b.html", "rawhtml/c.html"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("<title>t</title>")
    (tmp_path / "benign").mkdir()
    (tmp_path / "rows.csv").write_text("file_name,url,label\na,http://a.com/,1\nsite/html/b,http://b.com/,1\nrawhtml/c.html,http://c.com/,1\n")
    rows = T.scan_csv_with_html(spark, str(tmp_path / "rows.csv"), str(root), str(tmp_path / "benign"))
    assert sorted(r["url"] for r in rows.select("url").collect()) == ["http://a.com/", "http://b.com/", "http://c.com/"]


def test_only_matched_files_are_opened(spark, tmp_path):
    """An unreadable file that no row names does no harm; its bytes are never asked for."""
    for side in ("p", "b"):
        (tmp_path / side).mkdir()
    (tmp_path / "p" / "a b%.html").write_text("<title>A</title>")
    (tmp_path / "p" / "gone.html").symlink_to(tmp_path / "p" / "a b%.html")
    path = write_csv(tmp_path / "s.csv", ["file_name", "url", "label"], [["a b%", "http://a.com/", "1"]])
    (tmp_path / "b" / "secret.html").write_text("x")
    rows = T.scan_csv_with_html(spark, path, str(tmp_path / "p"), str(tmp_path / "b")).collect()
    assert [(r["url"], r["title"]) for r in rows] == [("http://a.com/", "A")]


def test_manifest_of_ranges(spark, tmp_path):
    import hashlib

    (tmp_path / "m").mkdir()
    data = bytes(range(256)) * 50
    for name, content in (("long.bin", data), ("exact.bin", data[:1000])):
        (tmp_path / "m" / name).write_bytes(content)
    got = {r["file"]: (r["bytes"], r["ranges"], r["sha256"]) for r in T.file_manifest(spark, str(tmp_path / "m"), 1000).collect()}
    leaves = [hashlib.sha256(data[i: i + 1000]).hexdigest() for i in range(0, len(data), 1000)]
    assert got == {
        "long.bin": (12800, 13, hashlib.sha256("".join(leaves).encode()).hexdigest()),
        "exact.bin": (1000, 1, leaves[0])}
    with open(tmp_path / "m" / "huge.bin", "wb") as handle:
        handle.truncate(5 << 30)  # a hole: takes no disk
    huge = T.file_manifest(spark, str(tmp_path / "m"), 1 << 30).where("file = 'huge.bin'").first()
    zero = hashlib.sha256(bytes(1 << 20) * 1024).hexdigest()
    assert (huge["bytes"], huge["ranges"], huge["sha256"]) == (5 << 30, 5, hashlib.sha256((zero * 5).encode()).hexdigest())


def test_archives_end_between_sites(spark, tmp_path, monkeypatch):
    """A task that writes many members starts further archives; the members of a site stay together."""
    import pyarrow as pa

    from sitesift.sources import archives as Z

    monkeypatch.setattr(Z, "ARCHIVE_MEMBERS", 5)
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 3})()))
    rows = [{"label": x, "site": f"s{n:03d}", "basename": b, "content": f"{n} {b}"} for x in (0, 1) for n in range(300) for b in ("html.txt", "info.txt")]
    batches = [pa.RecordBatch.from_pylist(rows[i: i + 400]) for i in range(0, len(rows), 400)]
    assert [b.to_pylist() for b in Z._store(str(tmp_path))(iter(batches))] == [[{"members": 1200}]]
    for label in (0, 1):
        members = Z.read_members(spark, str(tmp_path / str(label)), label, "html.txt,info.txt").select("site", "basename", "content").collect()
        assert sorted((r.site, r.basename, bytes(r.content).decode()) for r in members) == [(r["site"], r["basename"], r["content"]) for r in rows if r["label"] == label]
        listed = Z.list_members(spark, str(tmp_path / str(label)), label).groupBy("path").agg(F.count("*").alias("n")).collect()
        assert len(listed) == 100 and max(r["n"] for r in listed) == 6
        assert Z.list_members(spark, str(tmp_path / str(label)), label).select("site", "path").distinct().count() == 300
