"""CSV, JSON, HTML-tree, prediction, model and manifest sources and sinks."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitesift.constants import (
    CSV_DOM_COLUMNS, HASH_DIM, NGRAM_MAX, NGRAM_MIN, NUMERIC_FEATURES, UNSAFE_KEYS,
)
from sitesift.functions.urls import (
    add_url_features, canonicalize_url, registrable_domain, strict_host, strip, text,
)
from sitesift.operators.groups import dedupe_keep_first
from sitesift.operators.records import all_features, canonical_records, limit_scan
from sitesift.operators.validate import (
    fail_on_problems, fail_on_values, label_dual, label_inverted, prediction_problem,
    prediction_row_checks, require_columns,
)
from sitesift.operators.vectors import finite_number
from sitesift.session import shared_folder, write_and_read
from sitesift.sources.archives import utf8
from sitesift.sources.files import file_manifest, list_files, read_contents, relative_to  # noqa: F401

PREDICTION_COLUMNS = ["sample_id", "label", "score", "model", "source_commit"]
FEATURE_VERSION = "sitesift-features-v1"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Header CSV as text, quoted fields of any length and with line breaks."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option(
        "maxCharsPerColumn", -1
    )
    return (reader.schema(schema) if schema else reader).csv(path)


def with_source_order(frame: DataFrame, name: str = "_ord") -> DataFrame:
    """Position in the source as (file, row), fixed by writing the rows out once."""
    path = shared_folder(frame.sparkSession, "source-order")
    frame.withColumn(name, F.struct("_file", F.monotonically_increasing_id().alias("row"))).drop("_file").write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def scan_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled CSV to canonical rows: inverted label, allowed features only, first of each URL."""
    raw = read_csv(spark, path)
    require_columns(raw, ["URL", "Title", "label", *CSV_DOM_COLUMNS], "labelled CSV")
    fail_on_values(raw, label_inverted(F.col("label")).isNull(), F.col("label"), "unknown labels")
    ordered = with_source_order(
        raw.select(
            F.col("_metadata.file_path").alias("_file"),
            text(F.col("URL")).alias("url"), text(F.col("Title")).alias("title"),
            label_inverted(F.col("label")).alias("label"),
            *[finite_number(F.col(c)).alias("dom_" + n) for c, n in CSV_DOM_COLUMNS.items()],
        ).withColumn("sample_id", F.sha2(canonicalize_url(F.col("url")), 256))
    )
    fail_on_values(ordered, F.col("sample_id").isNull(), F.col("url"), "invalid urls")
    unique = add_url_features(dedupe_keep_first(ordered, "sample_id", "_ord"), "url", "dom_")
    return unique.select(
        "url", "title", "label", "sample_id",
        registrable_domain(strict_host(F.col("url"))).alias("group"),
        *["dom_" + n for n in NUMERIC_FEATURES],
    )


def qualified(spark: SparkSession, path: str) -> str:
    """The folder's full name, as the file sources report it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")


def scan_csv_with_html(
    spark: SparkSession, csv_path: str, phish_root: str, benign_root: str, limit: int | None = None
) -> DataFrame:
    """Split CSV joined to '<root by label>/<file_name>.html'. Rows without URL or file are skipped.

    ``file_name`` may name nested folders below the root. An invalid URL fails. Rows meet the names
    of the files; only files of rows that are kept are opened, once.
    """
    raw = read_csv(spark, csv_path)
    require_columns(raw, ["file_name", "url", "label"], "split CSV")
    kind = F.col("type") if "type" in raw.columns else F.lit(None).cast("string")
    label = label_dual(F.col("label"), kind)
    fail_on_values(raw, label.isNull(), F.concat_ws("/", F.col("label"), kind), "unknown labels")
    rows = raw.select(
        F.col("_metadata.file_path").alias("_file"),
        strip(text(F.col("url"))).alias("url"), label.alias("label"),
        F.when(F.endswith("file_name", F.lit(".html")), F.col("file_name"))
        .otherwise(F.concat("file_name", F.lit(".html"))).alias("file"),
        *(["split"] if "split" in raw.columns else []),
    )
    ordered = with_source_order(rows.where(F.col("url") != ""))

    def tree(root: str, label_value: int) -> DataFrame:
        base = qualified(spark, root)
        files = list_files(spark, base, "*.html")
        return files.select(relative_to(F.col("path"), base).alias("file"), F.lit(label_value).alias("label"), "path")

    html = tree(phish_root, 1).unionByName(tree(benign_root, 0))
    joined = ordered.join(html, ["file", "label"])
    if limit is not None:
        joined = limit_scan(joined, "_ord", limit)
    fail_on_values(joined, canonicalize_url(F.col("url")).isNull(), F.col("url"), "invalid urls")
    identified = joined.withColumn("sample_id", F.sha2(canonicalize_url(F.col("url")), 256))
    wanted = dedupe_keep_first(identified, "sample_id", "_ord").drop("_ord", "file")
    pages = read_contents(wanted).withColumn("html", utf8(F.col("content"))).drop("content", "path")
    out = write_and_read(all_features(pages).select(
        "url", "title", "label", "sample_id",
        registrable_domain(strict_host(F.col("url"))).alias("group"),
        *["dom_" + n for n in NUMERIC_FEATURES], *(["split"] if "split" in raw.columns else []),
    ), "csv-records")
    if out.isEmpty():
        raise ValueError("no usable rows")
    return out


# --- frozen records ----------------------------------------------------------------


def freeze_records(raw: DataFrame, path: str, order: str = "ord", limit: int | None = None) -> dict:
    """Write accepted canonical records with their HTML once; an existing path fails.

    Returns processed, accepted and rejected, counted in the same pass as the write.
    """
    from pyspark.sql import Observation

    rows = raw if limit is None else limit_scan(raw, order, limit)
    observed = Observation()
    records = canonical_records(rows, keep_html=True)
    counted = records.observe(
        observed, F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"),
    )
    columns = ["url", "title", F.col("date_text").alias("date"), "label", "sample_id",
               F.coalesce("html", F.lit("")).alias("html"), "parse_status", *["dom_" + n for n in NUMERIC_FEATURES]]
    counted.where(F.col("reject_reason").isNull()).select(*columns).write.mode("errorifexists").json(path)
    counts = observed.get
    return {**counts, "rejected": counts["processed"] - counts["accepted"]}


FROZEN_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "title", "date")]
    + [T.StructField("label", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("sample_id", "html", "parse_status")]
    + [T.StructField("dom_" + n, T.DoubleType()) for n in NUMERIC_FEATURES]
)


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    frame = spark.read.schema(FROZEN_SCHEMA).json(path).where(F.col("sample_id").isNotNull())
    if frame.isEmpty():
        raise ValueError(f"frozen records are empty: {path}")
    return frame


def records_to_input(frozen: DataFrame, path: str) -> None:
    """Scorer input: sample_id, label, html."""
    frozen.select("sample_id", "label", "html").write.option("header", True).option("escape", '"').mode(
        "errorifexists"
    ).csv(path)


def read_scorer_input(spark: SparkSession, path: str) -> DataFrame:
    """Scorer input, checked row by row; malformed rows or repeated ids fail the job."""
    header = read_csv(spark, path).columns
    missing = sorted({"sample_id", "label", "html"} - set(header))
    if missing:
        raise ValueError(f"input CSV missing required columns: {missing}")
    schema = ", ".join(f"`{c}` string" for c in header) + ", _extra string"
    frame = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("enforceSchema", True).option("columnNameOfCorruptRecord", "_extra")
        .option("maxCharsPerColumn", -1).schema(schema).csv(path)
    )
    fail_on_problems(prediction_row_checks(frame, corrupt="_extra"), "malformed input rows")
    out = frame.select("sample_id", "label", "html")
    if out.isEmpty():
        raise ValueError("input CSV must contain at least one row")
    return out


def write_predictions(frame: DataFrame, path: str) -> None:
    frame.select(*PREDICTION_COLUMNS).write.option("header", True).mode("errorifexists").csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    schema = "sample_id string, label int, score double, model string, source_commit string"
    frame = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    bad = prediction_problem(html="sample_id").isNotNull() | F.col("score").isNull() | F.isnan("score")
    return fail_on_values(frame, bad | (F.col("score") < 0) | (F.col("score") > 1), F.col("sample_id"), "malformed predictions")


# --- model tables ------------------------------------------------------------------


def check_weights(weights: DataFrame, params: Mapping) -> None:
    """Guards on a linear model: version, classes, width, finite float32 weights, threshold."""
    expected = {"feature_version", "hash_dim", "ngram_min", "ngram_max", "include_dom", "classes",
                "intercept", "threshold", "metadata"}
    if set(params) != expected:
        raise ValueError(
            f"model schema mismatch: missing {sorted(expected - set(params))}, unexpected {sorted(set(params) - expected)}"
        )
    if params["feature_version"] != FEATURE_VERSION:
        raise ValueError(f"feature version mismatch: {params['feature_version']!r}")
    if list(params["classes"]) != [0, 1]:
        raise ValueError("model class order must be exactly [0, 1]")
    if (params["ngram_min"], params["ngram_max"]) != (NGRAM_MIN, NGRAM_MAX):
        raise ValueError("ngram range mismatch")
    if not math.isfinite(params["intercept"]):
        raise ValueError("intercept must be finite")
    if not (math.isfinite(params["threshold"]) and 0.0 <= params["threshold"] <= 1.0):
        raise ValueError("threshold must be between 0 and 1")
    check_metadata(params["metadata"])
    width = params["hash_dim"] + (len(NUMERIC_FEATURES) if params["include_dom"] else 0)
    weight = F.col("weight").cast("float")
    row = weights.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("low"),
        F.max("idx").alias("high"),
        F.count_if(weight.isNull() | F.isnan(weight) | (F.abs(weight) == float("inf"))).alias("bad"),
    ).first()
    if (row["n"], row["d"], row["low"], row["high"]) != (width, width, 0, width - 1):
        raise ValueError(f"model dimension mismatch: expected {width} weights, found {row['n']}")
    if row["bad"]:
        raise ValueError("model weights must be finite")


def write_model(weights: DataFrame, params: Mapping, path: str) -> None:
    """Weights as Parquet (idx, weight float32) and one JSON row of parameters."""
    check_weights(weights, params)
    spark = weights.sparkSession
    weights.select(F.col("idx").cast("int").alias("idx"), F.col("weight").cast("float").alias("weight")).write.mode(
        "errorifexists"
    ).parquet(f"{path}/weights")
    line = json.dumps(params, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/params")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    params = json.loads(spark.read.text(f"{path}/params").first()["value"])
    weights = spark.read.schema("idx int, weight float").parquet(f"{path}/weights")
    check_weights(weights, params)
    return weights, params


def model_params(
    intercept: float, threshold: float, include_dom: bool = True, hash_dim: int = HASH_DIM,
    metadata: Mapping | None = None,
) -> dict:
    return {
        "feature_version": FEATURE_VERSION, "hash_dim": hash_dim, "ngram_min": NGRAM_MIN,
        "ngram_max": NGRAM_MAX, "include_dom": include_dom, "classes": [0, 1],
        "intercept": float(intercept), "threshold": float(threshold), "metadata": dict(metadata or {}),
    }


# --- manifests and reports -----------------------------------------------------------


def check_metadata(metadata: Mapping) -> None:
    """Metadata of a model is one flat table: names with text, flags or finite numbers."""
    refused = [
        str(name) for name, value in metadata.items()
        if not isinstance(name, str) or name in UNSAFE_KEYS or "\x00" in name
        or not isinstance(value, (str, int, float)) or (isinstance(value, float) and not math.isfinite(value))
    ]
    if refused:
        raise ValueError(f"unsafe or nested metadata entries: {sorted(refused)}")


def write_report(metrics: DataFrame, path: str) -> None:
    """A metric table as JSON lines; any non-finite number fails the job before writing."""
    numbers = [c for c, t in metrics.dtypes if t in ("double", "float")]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False))
    unsafe = [c for c in metrics.columns if c in UNSAFE_KEYS or "\x00" in c]
    if unsafe:
        raise ValueError(f"report contains unsafe keys: {unsafe}")
    if not metrics.where(bad).isEmpty():
        raise ValueError("report numbers must be finite")
    metrics.write.mode("errorifexists").json(path)
