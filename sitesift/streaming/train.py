"""Training a linear model on a stream, one micro-batch at a time.

State after batch N is a table in ``state_dir``: weights (idx, weight, accum) and counters. A batch
reads the state of N - 1 and writes that of N, so a replayed batch gives the same result, and the
stream's own checkpoint resumes at the right row. A task sums the gradient of its rows in place and
hands on one number per touched weight; these partial sums are merged by index. Rows need no id, and
no entry of a vector is shuffled. A model has at most 262,183 weights (2 MB), which every task holds.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.constants import HASH_DIM, NUMERIC_FEATURES
from sitesift.operators.records import counter_rows
from sitesift.operators.validate import accept_record
from sitesift.operators.vectors import add_vector_parts
from sitesift.session import write_and_read
from sitesift.streaming.pages import drain

INTERCEPT = -1  # index of the intercept in the state table
STATE_SCHEMA = "idx int, weight double, accum double"


@dataclass(frozen=True)
class StreamConfig:
    alpha: float = 1e-4
    step: float = 0.5
    passes: int = 3
    include_dom: bool = True
    hash_dim: int = HASH_DIM
    cutoff: str | None = None
    source: str = ""

    def __post_init__(self):
        if not self.alpha > 0 or not self.step > 0:
            raise ValueError("alpha and step must be positive")
        if self.passes < 1 or self.hash_dim < 1:
            raise ValueError("passes and hash_dim must be positive integers")

    @property
    def width(self) -> int:
        return self.hash_dim + (len(NUMERIC_FEATURES) if self.include_dom else 0)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.text(path).isEmpty()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def check_config(
    spark: SparkSession, state_dir: str, config: StreamConfig, resume: bool, more: dict | None = None
) -> None:
    """Store the settings on the first run; later runs must ask to resume with equal settings."""
    path = f"{state_dir}/config"
    wanted = json.dumps(asdict(config) | (more or {}), sort_keys=True)
    if not _exists(spark, path):
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(path)
        return
    if not resume:
        raise ValueError("training state exists; pass resume=True or use a new state folder")
    found = spark.read.text(path).first()["value"]
    if found != wanted:
        was, now = json.loads(found), json.loads(wanted)
        changed = sorted(k for k in now.keys() | was.keys() if was.get(k) != now.get(k))
        raise ValueError(f"training settings mismatch: {changed}")


def _weights_path(state_dir: str, batch_id: int) -> str:
    return f"{state_dir}/weights/batch_id={batch_id}"


def _counts_path(state_dir: str, batch_id: int) -> str:
    return f"{state_dir}/counts/batch_id={batch_id}"


def state_array(state: DataFrame, width: int) -> np.ndarray:
    """All weights, the intercept behind them; ``state`` has a row per touched weight."""
    table = state.select("idx", "weight").toArrow()
    out = np.zeros(width + 1)
    out[table["idx"].to_numpy()] = table["weight"].to_numpy()  # the intercept's index is -1
    return out


def partial_gradients(vectors: DataFrame, state: DataFrame, config: StreamConfig) -> DataFrame:
    """(idx, g): for every task, the sum of value * (probability - label) of its rows per weight.

    ``vectors`` has label, buckets and, with page features, numeric: a row per page.
    """
    width, dim = config.width, config.hash_dim
    shared = vectors.sparkSession.sparkContext.broadcast(state_array(state, width))

    def run(batches):
        weights, total = shared.value, np.zeros(width + 1)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            buckets = batch.column("buckets")
            rows = np.repeat(np.arange(len(label)), np.diff(buckets.offsets.to_numpy()))
            at = buckets.flatten().to_numpy()
            logit = weights[width] + np.bincount(rows, weights=weights[at], minlength=len(label))
            if width > dim:
                numeric = batch.column("numeric").flatten().to_numpy(zero_copy_only=False)
                numeric = numeric.astype(np.float32).astype(np.float64).reshape(len(label), width - dim)
                logit += numeric @ weights[dim:width]
            decayed = np.exp(-np.abs(logit))
            miss = np.where(logit >= 0, 1.0, decayed) / (1.0 + decayed) - label
            total[:dim] += np.bincount(at, weights=miss[rows], minlength=dim)
            if width > dim:
                total[dim:width] += miss @ numeric
            total[width] += miss.sum()
        touched = np.flatnonzero(total)
        index = np.where(touched == width, INTERCEPT, touched).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(total[touched])], ["idx", "g"])

    return vectors.mapInArrow(run, "idx int, g double")


def gradient_step(vectors: DataFrame, state: DataFrame, rows: int, config: StreamConfig) -> DataFrame:
    """One full-batch step with per-weight step sizes. ``state`` holds touched weights only.

    With g the mean gradient plus alpha * weight (not for the intercept) and accum the sum of all
    g * g so far, a weight moves by -step * g / (sqrt(accum) + 1e-8).
    """
    gradient = partial_gradients(vectors, state, config).groupBy("idx").agg(F.sum("g").alias("g"))
    decay = F.when(F.col("idx") == INTERCEPT, 0.0).otherwise(config.alpha * F.coalesce("weight", F.lit(0.0)))
    g = F.coalesce(F.col("g") / rows, F.lit(0.0)) + decay
    accum = F.coalesce("accum", F.lit(0.0)) + g * g
    return state.join(gradient, "idx", "full_outer").select(
        "idx",
        (F.coalesce("weight", F.lit(0.0)) - config.step * g / (F.sqrt(accum) + 1e-8)).alias("weight"),
        accum.alias("accum"),
    )


def train_batch(batch: DataFrame, batch_id: int, state_dir: str, config: StreamConfig) -> None:
    spark = batch.sparkSession
    parts = ["buckets", *(["numeric"] if config.include_dom else [])]
    gated = add_vector_parts(accept_record(batch), config.include_dom, config.hash_dim)
    kept = write_and_read(
        gated.select("label", "parse_status", "reject_reason", "drop_reason", *parts), "train-batch"
    )
    rejected = kept.withColumn("reject_reason", F.col("drop_reason"))
    counts = counter_rows(rejected).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))
    if batch_id > 0:
        state = spark.read.schema(STATE_SCHEMA).parquet(_weights_path(state_dir, batch_id - 1))
        earlier = spark.read.schema("kind string, reason string, n bigint").parquet(_counts_path(state_dir, batch_id - 1))
        counts = counts.unionByName(earlier).groupBy("kind", "reason").agg(F.sum("n").alias("n"))
    else:
        state = spark.createDataFrame([], STATE_SCHEMA)
    vectors = kept.where(F.col("drop_reason").isNull()).select("label", *parts)
    rows = vectors.count()
    if rows:
        for _ in range(config.passes):
            state = write_and_read(gradient_step(vectors, state, rows, config), "train-state")
    state.write.mode("overwrite").parquet(_weights_path(state_dir, batch_id))
    counts.write.mode("overwrite").parquet(_counts_path(state_dir, batch_id))


def train_stream(records: DataFrame, state_dir: str, config: StreamConfig, resume: bool = False) -> tuple[DataFrame, float]:
    """Train on everything the stream has now; returns (weights idx / weight, intercept)."""
    spark = records.sparkSession
    check_config(spark, state_dir, config, resume)
    drain(records, f"{state_dir}/stream", lambda batch, batch_id: train_batch(batch, batch_id, state_dir, config))
    return read_state(spark, state_dir, config)


def last_batch(spark: SparkSession, state_dir: str) -> int:
    counts = spark.read.schema("batch_id bigint").option("basePath", f"{state_dir}/counts").parquet(f"{state_dir}/counts")
    return counts.agg(F.max("batch_id")).first()[0]


def read_state(spark: SparkSession, state_dir: str, config: StreamConfig) -> tuple[DataFrame, float]:
    """Full-width weights and intercept after the last committed batch."""
    batch_id = last_batch(spark, state_dir)
    state = spark.read.schema(STATE_SCHEMA).parquet(_weights_path(state_dir, batch_id))
    if state.isEmpty():
        raise ValueError("no accepted training records")
    intercept = state.where(F.col("idx") == INTERCEPT).first()["weight"]
    every = spark.range(config.width).select(F.col("id").cast("int").alias("idx"))
    weights = every.join(F.broadcast(state.select("idx", "weight")), "idx", "left").select(
        "idx", F.coalesce("weight", F.lit(0.0)).cast("float").alias("weight")
    )
    return weights, float(intercept)


def read_counts(spark: SparkSession, state_dir: str) -> DataFrame:
    return spark.read.schema("kind string, reason string, n bigint").parquet(
        _counts_path(state_dir, last_batch(spark, state_dir))
    )
