"""Sparse page vectors: hashed n-grams (0/1) plus 39 transformed numeric features."""

from __future__ import annotations

import math

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sitesift.constants import (
    COUNT_FEATURES, DOM_FEATURES, HASH_DIM, NUMERIC_FEATURES, RATIO_FEATURES, URL_FEATURES,
)
from sitesift.functions.columns import built_once
from sitesift.functions.hashing import hashed_buckets
from sitesift.functions.urls import add_url_features
from sitesift.session import shared_folder


def finite_number(value: Column) -> Column:
    """Missing, unparsable or non-finite numbers are 0."""
    number = value.try_cast("double") if not isinstance(value, (int, float)) else F.lit(value)
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == math.inf)
    return F.when(bad, 0.0).otherwise(number)


def transform_numeric(name: str, value: Column) -> Column:
    number = finite_number(value)
    if name in COUNT_FEATURES:
        return F.log1p(F.greatest(number, F.lit(0.0)))
    if name in RATIO_FEATURES:
        return F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))
    return F.when(number != 0, 1.0).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


@built_once
def _numeric_column(present: tuple[str, ...], dom_prefix: str) -> Column:
    values = []
    for name in NUMERIC_FEATURES:
        if name in URL_FEATURES:
            values.append(F.col("_v_" + name))
        elif name in present:
            values.append(F.col(dom_prefix + name).try_cast("double"))
        else:
            values.append(F.lit(0.0))
    counts, ratios = len(COUNT_FEATURES), len(COUNT_FEATURES) + len(RATIO_FEATURES)
    # One pass over the array: every feature expression is evaluated once.
    return F.transform(
        F.array(*values),
        lambda v, i: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == math.inf), 0.0)
        .when(i < counts, F.log1p(F.greatest(v, F.lit(0.0))))
        .when(i < ratios, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))
        .otherwise((v != 0).cast("double")),
    )


def add_numeric(frame: DataFrame, dom_prefix: str = "dom_") -> DataFrame:
    """Adds ``numeric`` (array<double>, 39 wide).

    URL features are always recomputed from the raw URL; the others come from ``dom_*`` columns,
    0 where a column is missing.
    """
    present = tuple(n for n in DOM_FEATURES if dom_prefix + n in frame.columns)
    out = add_url_features(frame, prefix="_v_")
    return out.withColumn("numeric", _numeric_column(present, dom_prefix)).drop(*["_v_" + n for n in URL_FEATURES])


def add_vector_parts(frame: DataFrame, include_dom: bool = True, dim: int = HASH_DIM) -> DataFrame:
    """Adds ``buckets`` (array<int>) and, with DOM, ``numeric``."""
    out = frame.withColumn("buckets", hashed_buckets(F.col("url"), F.col("title"), dim))
    return add_numeric(out) if include_dom else out


def vectorize(
    frame: DataFrame, key: str = "sample_id", include_dom: bool = True, dim: int = HASH_DIM
) -> DataFrame:
    """Long form (key, idx, value): one row per non-zero entry, values rounded to float32."""
    parts = add_vector_parts(frame, include_dom, dim)
    entries = F.transform(
        F.col("buckets"), lambda b: F.struct(b.alias("idx"), F.lit(1.0).alias("value"))
    )
    if include_dom:
        numeric = F.transform(
            F.col("numeric"), lambda v, i: F.struct((i + dim).alias("idx"), v.alias("value"))
        )
        entries = F.concat(entries, F.filter(numeric, lambda e: e["value"] != 0))
    return parts.select(key, F.explode(entries).alias("e")).select(
        key, "e.idx", F.col("e.value").cast("float").alias("value")
    )


def _sparse_struct(base: int, include_dom: bool) -> Column:
    """The stored form of a sparse ML vector: (type, size, indices, values)."""
    hashed = F.col("buckets")
    ones = F.transform(hashed, lambda _: F.lit(1.0))
    extra = len(NUMERIC_FEATURES) if include_dom else 0
    indices, values = hashed, ones
    if include_dom:
        indices = F.concat(hashed, F.sequence(F.lit(base), F.lit(base + extra - 1)))
        values = F.concat(ones, F.col("numeric"))
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(base + extra).alias("size"),
        indices.alias("indices"), values.alias("values"),
    )


def to_ml_vectors(
    frame: DataFrame, output: str = "features", include_dom: bool = True, dim: int = HASH_DIM
) -> DataFrame:
    """id, label, split and group columns, ``buckets`` and an ML sparse vector, written once to the
    shared folder.

    A vector is stored in Parquet as a plain struct; reading it back with the vector type needs no
    per-row Python.
    """
    spark = frame.sparkSession
    keep = [c for c in ("sample_id", "label", "split", "group") if c in frame.columns]
    parts = add_vector_parts(frame, include_dom, dim)
    path = shared_folder(spark, "vectors")
    parts.select(*keep, "buckets", _sparse_struct(dim, include_dom).alias(output)).write.parquet(path)
    schema = StructType(
        [*(frame.schema[c] for c in keep), parts.schema["buckets"], StructField(output, VectorUDT())]
    )
    return spark.read.schema(schema).parquet(path)
