"""Live results per browser tab: which results are stale, and the newest one.

Events are (tab, ts, event_id, kind, url) with kind 'navigate', 'result' or 'close'. A result counts
only while its URL is the tab's current URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.operators.skew import skewed_lookup
from sitesift.streaming.keyed import LatestResult, ShownPage, by_key, rocksdb_state
from sitesift.streaming.pages import drain_to_table


def _marked(events: DataFrame, bucket: Column) -> DataFrame:
    """Adds ``_seen``: struct(url) of the last navigation or close up to each event, null if none.

    A tab's events are cut into time buckets; a bucket starts from the last URL of earlier buckets,
    so a tab with very many events is not ordered in one task.
    """
    mark = F.when(
        F.col("kind").isin("navigate", "close"),
        F.struct(F.when(F.col("kind") == "navigate", F.col("url")).alias("url")),
    )
    staged = events.withColumn("_bucket", bucket).withColumn("_mark", mark)
    last = staged.where(F.col("_mark").isNotNull()).groupBy("tab", "_bucket").agg(
        F.max_by("_mark", F.struct("ts", "event_id")).alias("_last")
    )
    buckets = staged.select("tab", "_bucket").distinct().join(last, ["tab", "_bucket"], "left")
    before = Window.partitionBy("tab").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("tab", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_start"))
    inside = Window.partitionBy("tab", "_bucket").orderBy("ts", "event_id").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return staged.join(starts, ["tab", "_bucket"]).withColumn(
        "_seen", F.coalesce(F.last("_mark", ignorenulls=True).over(inside), F.col("_start"))
    ).drop("_bucket", "_mark", "_start")


def stale_results(
    events: DataFrame, bucket: Column | None = None, carried: DataFrame | None = None
) -> DataFrame:
    """Result events with ``stale``: the tab shows another page, or none, by then.

    ``carried`` is an optional (tab, url) table of pages shown before the first event.
    """
    bucket = F.date_trunc("hour", F.col("ts")) if bucket is None else bucket
    results = _marked(events, bucket).where(F.col("kind") == "result")
    current = F.col("_seen.url")
    if carried is not None:
        results = skewed_lookup(results, carried.withColumnRenamed("url", "_carried"), "tab", "left")
        current = F.when(F.col("_seen").isNull(), F.col("_carried")).otherwise(current)
    return results.select(
        *events.columns, (~F.coalesce(current == F.col("url"), F.lit(False))).alias("stale")
    )


def latest_state_per_key(events: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Newest valid result of every tab whose page is still the one it was made for.

    Both sides are map-side maxima, so a busy tab is reduced before any shuffle.
    """
    order = F.struct("ts", "event_id")
    fresh = stale_results(events, bucket).where(~F.col("stale"))
    newest = fresh.groupBy("tab").agg(F.max_by(F.struct("ts", "event_id", "url"), order).alias("r"))
    moved = events.where(F.col("kind").isin("navigate", "close")).groupBy("tab").agg(F.max(order).alias("m"))
    return newest.join(moved, "tab").where(F.struct("r.ts", "r.event_id") > F.col("m")).select(
        "tab", "r.ts", "r.event_id", "r.url"
    )


def stream_stale_results(events: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Streaming form: the page a tab shows is keyed state, and a closed tab has none.

    Batches must arrive in time order; inside a batch any order will do.
    """
    schema = "tab bigint, event_id bigint, url string, stale boolean"
    with rocksdb_state(events.sparkSession):
        return drain_to_table(by_key(events, "tab", ShownPage(), schema), checkpoint, path)


def stream_latest_state(events: DataFrame, checkpoint: str, path: str) -> DataFrame:
    """Streaming form of ``latest_state_per_key``: each batch writes the tabs it touched, the last
    one of a tab holds. Navigating and closing delete what was there."""
    spark, schema = events.sparkSession, "tab bigint, ts timestamp, event_id bigint, url string"
    with rocksdb_state(spark):
        drain_to_table(by_key(events, "tab", LatestResult(), schema), checkpoint, path)
    written = spark.read.schema(f"{schema}, batch_id bigint").option("basePath", path).parquet(path)
    newest = written.groupBy("tab").agg(F.max_by(F.struct("ts", "event_id", "url"), "batch_id").alias("r"))
    return newest.where(F.col("r.event_id").isNotNull()).select("tab", "r.ts", "r.event_id", "r.url")
