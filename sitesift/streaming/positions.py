"""Rows of a folder of Parquet files by their position, so that work stops and resumes at any row.

A file's rows are counted from its footer, its first position is the number of rows in the files
before it, and a row's position follows from its place in the file. Reading a range of positions opens
the files that hold it and nothing is sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitesift.session import write_and_read
from sitesift.sources.files import list_files, opened
from sitesift.streaming.train import StreamConfig, check_config, train_batch


def _footers(batches):
    for batch in batches:
        rows = []
        for uri in batch.column("path").to_pylist():
            system, path = opened(uri)
            with system.open_input_file(path) as handle:
                rows.append(pq.ParquetFile(handle).metadata.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rows, pa.int64())], ["path", "rows"])


def file_positions(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows, start) of the Parquet files below a path, in order of their names."""
    counted = write_and_read(
        list_files(spark, path, "*.parquet").select("path").mapInArrow(_footers, "path string, rows long"), "footers"
    )
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return write_and_read(
        counted.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))), "positions"
    )


def rows_between(files: DataFrame, schema, low: int, high: int) -> DataFrame:
    """The rows at positions low to high - 1, with ``position``.

    Rows of fewer files than cores are dealt over all cores: a file is read in as many tasks as it has
    row groups, and what follows costs far more than a shuffle of raw rows.
    """
    spark = files.sparkSession
    held = files.where((F.col("start") < high) & (F.col("start") + F.col("rows") > low)).select("path", "start").collect()
    parts = [
        spark.read.schema(schema).parquet(f["path"]).select(
            "*", (F.col("_metadata.row_index") + F.lit(f["start"])).alias("position")
        ) for f in held
    ]
    if not parts:
        return spark.createDataFrame([], schema).withColumn("position", F.lit(0).cast("long"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.where((F.col("position") >= low) & (F.col("position") < high))
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(cores, "position") if len(parts) < cores else out


def committed(spark: SparkSession, state_dir: str) -> tuple[int, int]:
    """(next batch, position up to which rows are trained on)."""
    try:
        row = spark.read.schema("batch_id long, position long").parquet(f"{state_dir}/position").agg(
            F.max(F.struct("batch_id", "position")).alias("p")
        ).first()
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0, 0
    return (row["p"]["batch_id"] + 1, row["p"]["position"]) if row["p"] else (0, 0)


def train_positions(
    spark: SparkSession, path: str, schema, prepare: Callable[[DataFrame], DataFrame], state_dir: str,
    config: StreamConfig, batch_rows: int, limit: int | None = None, resume: bool = False,
) -> tuple[int, int]:
    """Train on the rows of a folder in batches of ``batch_rows`` positions; returns (batches, position).

    ``prepare`` turns raw rows into records. A batch commits its weights and counters first and its
    position last, so a job that is killed anywhere and resumed trains on every row once, inside a
    file too. ``limit`` counts rows read. Other settings, another batch size or a folder that lost or
    changed rows already counted do not resume.
    """
    files = file_positions(spark, path)
    total = files.agg(F.sum("rows")).first()[0] or 0
    check_config(spark, state_dir, config, resume, {"batch_rows": batch_rows})
    batch_id, position = committed(spark, state_dir)
    if position > total:
        raise ValueError(f"training has read {position} rows, the folder has {total}")
    end = total if limit is None else min(total, limit)
    while position < end:
        high = min(position + batch_rows, end)
        batch = rows_between(files, schema, position, high).drop("position")
        train_batch(prepare(batch), batch_id, state_dir, config)
        spark.createDataFrame([(batch_id, high)], "batch_id long, position long").coalesce(1).write.mode(
            "append"
        ).parquet(f"{state_dir}/position")
        batch_id, position = batch_id + 1, high
    return batch_id, position

