"""Choosing among a handful of candidate models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _best(frame: DataFrame, key: Column, keys: Sequence[str]) -> DataFrame:
    """Row with the greatest key, by a map-side maximum."""
    others = [c for c in frame.columns if c not in keys]
    picked = frame.groupBy(*keys).agg(F.max_by(F.struct(*others), key).alias("_best"))
    return picked.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others])


def rank_candidates(
    frame: DataFrame, ap: str = "validation_ap", f1: str = "validation_f1", alpha: str = "alpha",
    include_dom: str = "include_dom", keys: Sequence[str] = (),
) -> DataFrame:
    """Highest AP, then F1, then smaller alpha, then without page features."""
    return _best(
        frame, F.struct(F.col(ap), F.col(f1), -F.col(alpha), -F.col(include_dom).cast("int")), keys
    )


def rank_grid(
    frame: DataFrame, ap: str = "average_precision", f1: str = "f1", size: str = "alpha",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Highest AP, then F1 at 0.5, then the smaller setting."""
    return _best(frame, F.struct(F.col(ap), F.col(f1), -F.col(size)), keys)


def primary_variant(
    frame: DataFrame, ap: str = "average_precision", f1: str = "f1", brier: str = "brier",
    order: Column | None = None,
) -> DataFrame:
    """Highest AP, then F1, then lower Brier, then the fixed variant order."""
    order = F.array_position(F.array(*[F.lit(v) for v in ("linear", "tree", "hybrid")]), F.col("variant")) if order is None else order
    return _best(frame, F.struct(F.col(ap), F.col(f1), -F.col(brier), -order), [])
