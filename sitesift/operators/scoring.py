"""Linear scoring against a weights table, score windows and score alignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sitesift.constants import HASH_DIM, NUMERIC_FEATURES, WINDOW_SIZE, WINDOW_STRIDE
from sitesift.functions.hashing import bucket_lists
from sitesift.functions.urls import text
from sitesift.operators.vectors import add_numeric, sigmoid

MAX_BROADCAST_WEIGHTS = HASH_DIM + len(NUMERIC_FEATURES)


def weights_side(weights: DataFrame) -> DataFrame:
    """Broadcast a weights table if a count shows that it is within the model width."""
    rows = weights.limit(MAX_BROADCAST_WEIGHTS + 1).count()
    return F.broadcast(weights) if rows <= MAX_BROADCAST_WEIGHTS else weights


def linear_score_join(
    entries: DataFrame, weights: DataFrame, intercept: float, key: str = "sample_id",
) -> DataFrame:
    """(key, logit, score) from long vector entries and (idx, weight).

    The entries of one sample come from one input row, so the sum is combined before the shuffle.
    Samples whose every index is unknown keep the intercept.
    """
    joined = entries.join(weights_side(weights), "idx", "left")
    products = F.coalesce(F.col("weight").cast("double"), F.lit(0.0)) * F.col("value").cast("double")
    return joined.groupBy(key).agg((F.sum(products) + F.lit(float(intercept))).alias("logit")).select(
        key, "logit", sigmoid(F.col("logit")).alias("score")
    )


def weight_array(weights: DataFrame, width: int) -> np.ndarray:
    """The weights as one array. Refuses a table that is not exactly ``width`` rows."""
    rows = weights.limit(width + 1).select("idx", "weight").toArrow()
    if rows.num_rows != width:
        raise ValueError(f"model dimension mismatch: expected {width} weights, found at least {rows.num_rows}")
    out = np.zeros(width, dtype=np.float64)
    out[rows["idx"].to_numpy()] = rows["weight"].to_numpy().astype(np.float64)
    return out


def score_pages(
    frame: DataFrame, weights: DataFrame, intercept: float, include_dom: bool = True,
    dim: int = HASH_DIM, output: str = "score",
) -> DataFrame:
    """Adds the probability of every row without a shuffle; works on streams.

    The model is at most 262,183 numbers (2 MB), so each Python worker holds it whole. Rows never
    move: n-grams are hashed and summed inside the Arrow batch.
    """
    width = dim + (len(NUMERIC_FEATURES) if include_dom else 0)
    shared = frame.sparkSession.sparkContext.broadcast(weight_array(weights, width))
    base = float(intercept)

    def logits(urls: pa.Array, titles: pa.Array, numeric: pa.Array | None) -> pa.Array:
        w = shared.value
        lists = bucket_lists(urls.to_pylist(), titles.to_pylist(), dim)
        rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        total = base + np.bincount(rows, weights=w[lists.values.to_numpy()], minlength=len(lists))
        if numeric is not None:
            values = numeric.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            total = total + values.reshape(len(lists), -1).astype(np.float64) @ w[dim:]
        return pa.array(total)

    if include_dom:
        @F.arrow_udf(DoubleType())
        def logit(urls: pa.Array, titles: pa.Array, numeric: pa.Array) -> pa.Array:
            return logits(urls, titles, numeric)

        parts = add_numeric(frame)
        scored = parts.withColumn("_logit", logit(text(F.col("url")), text(F.col("title")), F.col("numeric")))
        scored = scored.drop("numeric")
    else:
        @F.arrow_udf(DoubleType())
        def logit(urls: pa.Array, titles: pa.Array) -> pa.Array:
            return logits(urls, titles, None)

        scored = frame.withColumn("_logit", logit(text(F.col("url")), text(F.col("title"))))
    return scored.withColumn(output, sigmoid(F.col("_logit"))).drop("_logit")


# --- windows over long texts -----------------------------------------------------


def sliding_windows(
    frame: DataFrame, key: str, tokens: Column, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE
) -> DataFrame:
    """(key, start, window) for full windows only; texts shorter than a window give none."""
    starts = F.when(
        F.size("_tokens") >= size,
        F.sequence(F.lit(0), F.greatest(F.size("_tokens") - size, F.lit(0)), F.lit(stride)),
    )
    return (
        frame.select(key, tokens.alias("_tokens"))
        .select(key, "_tokens", F.explode(starts).alias("start"))
        .select(key, "start", F.slice("_tokens", F.col("start") + 1, F.lit(size)).alias("window"))
    )


def window_counts(
    frame: DataFrame, key: str, tokens: Column, size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE
) -> DataFrame:
    """Windows per row, without building them."""
    n = F.size(tokens)
    return frame.select(
        key, F.when(n >= size, F.floor((n - size) / stride) + 1).otherwise(0).cast("long").alias("windows")
    )


def max_pool(
    frame: DataFrame, windows: DataFrame, key: str, probability: str = "probability"
) -> DataFrame:
    """Largest window probability per row; rows without windows get 0."""
    best = windows.groupBy(key).agg(F.max(probability).alias("score"))
    return frame.select(key).join(best, key, "left").select(
        key, F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("score")
    )


def score_windows(
    frame: DataFrame, key: str, tokens: Column, scorer: Callable[[Column], Column],
    size: int = WINDOW_SIZE, stride: int = WINDOW_STRIDE,
) -> DataFrame:
    """Split into windows, score each with ``scorer`` (text column -> probability), max-pool."""
    windows = sliding_windows(frame, key, tokens, size, stride)
    scored = windows.select(key, scorer(F.array_join("window", " ")).alias("probability"))
    return max_pool(frame, scored, key)


# --- alignment of two score sets -------------------------------------------------


def missing_extra_ids(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, side): ids found on one side only; 'missing' is absent from the right."""
    missing = left.select(key).join(right.select(key), key, "left_anti").distinct()
    extra = right.select(key).join(left.select(key), key, "left_anti").distinct()
    return missing.withColumn("side", F.lit("missing")).unionByName(
        extra.withColumn("side", F.lit("extra"))
    )


def align_by_id(
    left: DataFrame, right: DataFrame, key: str = "sample_id", order: str | None = None
) -> DataFrame:
    """(key, label, left_score, right_score, left_label, status) over the union of ids.

    ``status`` is 'ok', 'missing' (no right row), 'extra' (no left row) or 'label_conflict'.
    ``order`` is a column of the right side that is carried along, null for 'missing'.
    """
    carried = [order] if order else []
    joined = left.select(
        key, F.col("label").alias("left_label"), F.col("score").alias("left_score")
    ).join(
        right.select(key, F.col("label").alias("label"), F.col("score").alias("right_score"), *carried),
        key, "full_outer",
    )
    return joined.withColumn(
        "status",
        F.when(F.col("label").isNull(), "missing")
        .when(F.col("left_label").isNull(), "extra")
        .when(F.col("label") != F.col("left_label"), "label_conflict")
        .otherwise("ok"),
    )


def aligned_or_fail(
    left: DataFrame, right: DataFrame, key: str = "sample_id", order: str | None = None
) -> DataFrame:
    """Aligned scores; raises if ids repeat or if the id sets or labels differ.

    With ``order``, a column of the right side, rows come in its order and carry it.
    """
    for side, frame in (("left", left), ("right", right)):
        if not frame.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty():
            raise ValueError(f"repeated {key} in the {side} scores")
    aligned = align_by_id(left, right, key, order)
    bad = aligned.where(F.col("status") != "ok")
    counts = {r["status"]: r["count"] for r in bad.groupBy("status").count().collect()}
    if counts:
        examples = [f"{r[key]} ({r['status']})" for r in bad.orderBy(key).limit(5).collect()]
        raise ValueError(f"sample_id set or label mismatch: {counts}, e.g. {', '.join(examples)}")
    columns = [key, "label", "left_score", "right_score"]
    return aligned.orderBy(order).select(*columns, order) if order else aligned.select(*columns)


def delta_join(validation: DataFrame, test: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Validation minus test AP and F1 per key."""
    v = validation.select(*keys, F.col("average_precision").alias("_vap"), F.col("f1").alias("_vf1"))
    t = test.select(*keys, F.col("average_precision").alias("_tap"), F.col("f1").alias("_tf1"))
    return v.join(t, list(keys)).select(
        *keys, (F.col("_vap") - F.col("_tap")).alias("delta_ap"),
        (F.col("_vf1") - F.col("_tf1")).alias("delta_f1"),
    )
