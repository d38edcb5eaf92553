"""Files as rows: listed by name and size first, read later, by whole files or byte ranges.

Listing goes through Spark's file source without contents; reading opens a file where it lies, on any
file system that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

BATCH_BYTES = 8 << 20
LEAF_BYTES = 64 << 20  # range of a file that one row of a manifest's tree covers
HASHED_BYTES = 1 << 20  # bytes held while hashing


def opened(name: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a name as Spark's file sources report it: nothing is escaped."""
    named = re.fullmatch(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?(/.*)", name, re.DOTALL)
    if named is None or named[1] == "file":
        return fs.LocalFileSystem(), name if named is None else re.sub("^/+", "/", named[3])
    system, root = fs.FileSystem.from_uri(f"{named[1]}://{named[2] or ''}/")
    return system, root.rstrip("/") + named[3]


def reading_tasks(spark: SparkSession) -> int:
    """Tasks for rows that are narrow but stand for much to read; adaptive plans would merge them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a path; contents are not read.

    Spark's file sources do not list empty files, so those are absent here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return files.load(path).select("path", "length")


def _contents(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low, held, contents = 0, 0, []
        for at, uri in enumerate(batch.column("path").to_pylist(), 1):
            system, path = opened(uri)
            with system.open_input_file(path) as handle:
                contents.append(handle.read())
            held += len(contents[-1])
            if held > BATCH_BYTES or at == batch.num_rows:
                part = batch.slice(low, at - low)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(contents, pa.binary())], [*batch.schema.names, "content"]
                )
                low, held, contents = at, 0, []


def read_contents(frame: DataFrame) -> DataFrame:
    """Adds ``content``, the bytes of the file named in ``path``. Only the files of these rows are opened."""
    dealt = frame.repartition(reading_tasks(frame.sparkSession), "path")
    return dealt.mapInArrow(_contents, StructType([*frame.schema.fields, StructField("content", BinaryType())]))


def _leaves(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for row in batch.to_pylist():
            digest, left = hashlib.sha256(), row["size"]
            system, path = opened(row["path"])
            with system.open_input_file(path) as handle:
                handle.seek(row["start"])
                while left > 0:
                    block = handle.read(min(left, HASHED_BYTES))
                    if not block:
                        raise ValueError(f"{row['path']} became shorter while it was read")
                    digest.update(block)
                    left -= len(block)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], [*batch.schema.names, "sha256"])


def file_leaves(spark: SparkSession, path: str, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(path, length, start, size, sha256) of every range of ``leaf_bytes`` of every file below a path."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(leaf_bytes).cast("long"))
    ranges = list_files(spark, path).select("path", "length", F.explode(starts).alias("start")).withColumn(
        "size", F.least(F.lit(leaf_bytes), F.col("length") - F.col("start"))
    )
    return ranges.repartition(reading_tasks(spark), "path", "start").mapInArrow(
        _leaves, "path string, length long, start long, size long, sha256 string"
    )


def file_manifest(spark: SparkSession, path: str, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(file, bytes, ranges, sha256) of every file below a path, whatever its size.

    A file of one range has its plain SHA-256; a longer one that of its ranges' hashes, as text, in
    order. Ranges are read in parallel and a task holds HASHED_BYTES.
    """
    leaves = file_leaves(spark, path, leaf_bytes)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("start", "sha256"))), lambda leaf: leaf["sha256"])
    return leaves.groupBy("path").agg(
        F.first("length").alias("bytes"), F.count(F.lit(1)).alias("ranges"), ordered.alias("_h")
    ).select(
        F.substring_index("path", "/", -1).alias("file"), "bytes", "ranges",
        F.when(F.col("ranges") == 1, F.get("_h", F.lit(0))).otherwise(F.sha2(F.array_join("_h", ""), 256)).alias("sha256"),
    )


def _written(folder: str):
    def write(batches):
        count = 0
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                system, path = opened(f"{folder}/{name}")
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as handle:
                    handle.write((content or "").encode())
                count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["files"])

    return write


def write_files(frame: DataFrame, folder: str) -> int:
    """Write each row (file, content) as a file below a folder; returns their number."""
    return frame.select("file", "content").mapInArrow(_written(folder), "files long").agg(F.sum("files")).first()[0] or 0


def relative_to(path: Column, base: str) -> Column:
    """The part of a file's path below a folder's full name."""
    return F.substr(path, F.lit(len(base) + 2))

