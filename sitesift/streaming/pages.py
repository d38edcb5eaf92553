"""Streams of pages: source, filters, counters, scoring and de-duplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitesift.constants import DOM_FEATURES
from sitesift.operators.records import RAW_COLUMNS, canonical_records, counter_rows
from sitesift.operators.scoring import score_pages
from sitesift.operators.validate import accept_record, page_record_problem, require_columns, temporal_filter
from sitesift.streaming.keyed import FirstSight, by_key, rocksdb_state


def stream_pages(
    spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.parquet",
    files_per_batch: int | None = None, partitions: int | None = None,
) -> DataFrame:
    """Raw page rows as a stream of Parquet files.

    ``partitions`` spreads a batch of few files over more tasks; leave it unset when batches have
    many files.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(path)
    return stream.repartition(partitions) if partitions else stream


def stream_records(raw: DataFrame) -> DataFrame:
    """Canonical records of a raw stream; narrow, so it keeps no state."""
    return canonical_records(require_columns(raw, RAW_COLUMNS, "page stream"))


def stream_cutoff_filter(records: DataFrame, cutoff: Column, keep: str) -> DataFrame:
    return temporal_filter(records, "date", cutoff, keep)


def drain(
    frame: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None],
    output_mode: str = "append",
) -> None:
    """Process everything available now, batch by batch, then stop. Restart with the same
    checkpoint to go on where it ended."""
    query = (
        frame.writeStream.outputMode(output_mode).foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain_to_table(frame: DataFrame, checkpoint: str, path: str, output_mode: str = "append") -> DataFrame:
    """Drain into Parquet, one folder per batch. A replayed batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    drain(frame, checkpoint, write, output_mode)
    return frame.sparkSession.read.schema(frame.schema).parquet(path).select(*frame.columns)


def stream_counts(records: DataFrame) -> DataFrame:
    """Running (kind, reason, n); combined on the map side before the state store."""
    return counter_rows(records).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


def latest_batch(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table of the last batch written by ``drain_to_table`` in complete mode."""
    table = spark.read.schema(f"{schema}, batch_id bigint").option("basePath", path).parquet(path)
    return table.where(F.col("batch_id") == table.agg(F.max("batch_id")).scalar()).drop("batch_id")


def score_stream(
    records: DataFrame, weights: DataFrame, intercept: float, include_dom: bool = True
) -> DataFrame:
    """(sample_id, label, parse_status, score) of accepted rows, stateless."""
    gated = accept_record(records).where(F.col("drop_reason").isNull())
    scored = score_pages(gated, weights, intercept, include_dom)
    return scored.select("sample_id", "label", "parse_status", "score")


def live_scan_scores(
    records: DataFrame, weights: DataFrame, intercept: float, threshold: float
) -> DataFrame:
    """Validate live page records (url, title, dom map), score them and name the outcome."""
    kept = [c for c in records.columns if c not in ("title", "dom")]
    checked = records.withColumn("error", page_record_problem())
    wide = checked.withColumns(
        {"dom_" + n: F.when(F.col("error").isNull(), F.try_element_at("dom", F.lit(n))) for n in DOM_FEATURES}
    )
    scored = score_pages(wide, weights, intercept)
    ok = F.col("error").isNull()
    probability = F.when(ok, F.col("score"))
    return scored.select(
        *kept, "error", probability.alias("probability"),
        (probability >= threshold).cast("int").alias("label"),
        F.when(ok, F.lit(float(threshold))).alias("threshold"),
        F.when(~ok, "unavailable").when(probability >= threshold, "possible-phishing")
        .otherwise("no-signal").alias("status"),
    )


def stream_dedupe(
    stream: DataFrame, checkpoint: str, path: str, id_column: str = "sample_id", order: str = "ord"
) -> DataFrame:
    """First sight of every id over the whole stream. Rows without an id are rejects and left out.

    Seen ids are keyed state, so a batch costs what it brings; of several rows of an id in one batch
    the smallest in ``order`` is kept.
    """
    named = stream.where(F.col(id_column).isNotNull())
    with rocksdb_state(stream.sparkSession):
        return drain_to_table(by_key(named, id_column, FirstSight(order), stream.schema), checkpoint, path)


def stream_dedupe_watermark(
    stream: DataFrame, id_column: str, event_time: str, delay: str
) -> DataFrame:
    """Bounded-state form: repeats within the delay are dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([id_column])
