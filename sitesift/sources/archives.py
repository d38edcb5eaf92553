"""Site archives (ZIP): listed once, then read by byte ranges on any file system.

The directory of every archive is read in one pass and becomes a table with the place and size of
each member. Decisions are made on that table and on the small metadata; contents are fetched by
seeking to their places, neighbours together, so one large archive is read by the whole cluster. An
archive's path may name a file, a folder or a pattern, wherever Spark and pyarrow read.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sitesift.constants import MAX_HTML_BYTES, MAX_METADATA_BYTES, NUMERIC_FEATURES
from sitesift.functions.urls import registrable_domain, strict_host
from sitesift.operators.archives import (
    archive_audit, balanced_limit, guard_metadata, pair_members, site_status,
)
from sitesift.operators.groups import connected_groups, label_conflicts
from sitesift.operators.records import all_features
from sitesift.operators.validate import oversize_guard
from sitesift.session import write_and_read
from sitesift.sources.files import BATCH_BYTES, list_files, opened, reading_tasks

LIMITS = {"info.txt": MAX_METADATA_BYTES, "html.txt": MAX_HTML_BYTES}
RANGE_BYTES = 16 << 20  # members that start in one such range are fetched by one task
ARCHIVE_MEMBERS = 20_000  # a writer starts another archive then; zipfile holds an entry for each member
LISTED_ROWS = 10_000  # members that leave the listing together
STORED_ROWS = 256  # rows of a batch that are Python objects at once
HEADER, EXTRA = 30, 512  # fixed part of a member's own header, and what is read ahead for its names
PLACE = ("offset", "stored", "method", "crc")
DIRECTORY = (
    "path string, site string, basename string, offset long, stored long, method int, crc long, length long"
)


def _list(batches) -> Iterator[pa.RecordBatch]:
    names = ["path", "site", "basename", "offset", "stored", "method", "crc", "length"]
    types = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            system, path = opened(uri)
            try:
                with system.open_input_file(path) as handle, zipfile.ZipFile(handle) as archive:
                    entries = archive.infolist()
            except zipfile.BadZipFile as error:
                raise ValueError(f"invalid site archive {uri}: {error}") from error
            for low in range(0, len(entries), LISTED_ROWS):
                rows = []
                for entry in entries[low: low + LISTED_ROWS]:
                    parts = PurePosixPath(entry.filename.replace("\\", "/")).parts
                    if entry.is_dir() or len(parts) != 2:
                        continue
                    if entry.flag_bits & 1:
                        raise ValueError(f"encrypted member {entry.filename!r} in {uri}")
                    rows.append((uri, parts[0], parts[1].lower(), entry.header_offset, entry.compress_size,
                                 entry.compress_type, entry.CRC, entry.file_size))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def list_members(spark: SparkSession, path: str, label: int) -> DataFrame:
    """One row per member of two-part name: its archive, place, sizes, method and checksum."""
    files = list_files(spark, path).select("path")
    return files.mapInArrow(_list, DIRECTORY).withColumn("label", F.lit(label))


def _member(handle, offset: int, stored: int, method: int, crc: int, length: int) -> bytes:
    handle.seek(offset)
    block = handle.read(HEADER + EXTRA + stored)
    start = HEADER + int.from_bytes(block[26:28], "little") + int.from_bytes(block[28:30], "little")
    block += handle.read(max(0, start + stored - len(block)))
    data = block[start: start + stored]
    if method == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompressobj(-zlib.MAX_WBITS).decompress(data, length + 1)
        except zlib.error as error:
            raise ValueError(f"damaged member at {offset}: {error}") from error
    elif method != zipfile.ZIP_STORED:
        raise ValueError(f"compression method {method} at {offset} is not supported")
    if len(data) != length or zlib.crc32(data) != crc:
        raise ValueError(f"damaged member at {offset}: content differs from its directory entry")
    return data


def _fetch(batches) -> Iterator[pa.RecordBatch]:
    current, handle = None, None
    for batch in batches:
        low, held, contents = 0, 0, []
        names = [n for n in batch.schema.names if n not in PLACE]
        rows = batch.select(["path", *PLACE, "length"]).to_pylist()
        for at, row in enumerate(rows, 1):
            if row["path"] != current:
                if handle is not None:
                    handle.close()
                system, path = opened(row["path"])
                current, handle = row["path"], system.open_input_file(path)
            contents.append(_member(handle, *(row[c] for c in ("offset", "stored", "method", "crc", "length"))))
            held += row["length"]
            if held > BATCH_BYTES or at == len(rows):
                part = batch.slice(low, at - low)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(contents, pa.binary())], [*names, "content"]
                )
                low, held, contents = at, 0, []
    if handle is not None:
        handle.close()


def fetch_members(directory: DataFrame) -> DataFrame:
    """The rows of a directory with ``content`` in place of where it stands.

    Listed rows are dealt by range and sorted; other columns come along, so that what a member needs
    can be joined to its narrow row before its bytes are read.
    """
    near = F.floor(F.col("offset") / RANGE_BYTES)
    kept = [f for f in directory.schema.fields if f.name not in PLACE]
    dealt = directory.repartition(reading_tasks(directory.sparkSession), "path", near)
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(
        _fetch, StructType([*kept, StructField("content", BinaryType())])
    )


def guard_members(directory: DataFrame) -> DataFrame:
    """Refuse metadata and HTML above their limits, before anything is fetched."""
    html = directory.where(F.col("basename") == "html.txt")
    oversize_guard(html, "length", MAX_HTML_BYTES, "html.txt")
    return guard_metadata(directory)


def utf8(content: Column) -> Column:
    """Bytes as text; malformed sequences become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def read_members(spark: SparkSession, path: str, label: int, content: str = "") -> DataFrame:
    """(label, site, basename, length, content); ``content`` lists the base names whose bytes are read."""
    directory = guard_members(list_members(spark, path, label))
    wanted = F.col("basename").isin([c for c in content.split(",") if c])
    named = directory.where(~wanted).select(
        "label", "site", "basename", "length", F.lit(None).cast("binary").alias("content")
    )
    return named.unionByName(fetch_members(directory.where(wanted)).drop("path"))


def load_site_archives(
    spark: SparkSession, phish_zip: str, benign_zip: str, limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(records, audit) of a phishing and a benign archive.

    Records carry 39 ``dom_*`` features, the registrable domain, and connected groups over domains
    and family ids. A URL with both labels fails the job. Every directory is read once, metadata is
    fetched once, and HTML of accepted sites only, once.
    """
    sides = [list_members(spark, p, label) for p, label in ((phish_zip, 1), (benign_zip, 0))]
    directory = guard_members(write_and_read(sides[0].unionByName(sides[1]), "members"))
    info = F.col("basename") == "info.txt"
    metadata = fetch_members(directory.where(info)).select(
        "label", "site", "basename", "length", utf8(F.col("content")).alias("metadata")
    )
    others = directory.where(~info).select(
        "label", "site", "basename", "length", F.lit(None).cast("string").alias("metadata")
    )
    directories = write_and_read(site_status(pair_members(metadata.unionByName(others))), "sites")
    scanned = balanced_limit(directories, limit)
    accepted = write_and_read(scanned.where(F.col("status") == "accepted"), "accepted")
    conflicts = label_conflicts(accepted).count()
    if conflicts:
        raise ValueError(f"archives contain {conflicts} URL(s) with conflicting labels")
    # What a page needs is joined to its listed row; its HTML is read, used and dropped in one task.
    urls = accepted.select("label", "site", "url", "sample_id", "source_family_id", "source_brand", "source_collected_at")
    wanted = directory.where(F.col("basename") == "html.txt").join(urls, ["label", "site"])
    html = fetch_members(wanted).withColumn("html", utf8(F.col("content"))).drop("content")
    features = write_and_read(all_features(html).select(
        "url", "title", "label", "sample_id",
        registrable_domain(strict_host(F.col("url"))).alias("registrable_domain"),
        F.when(F.col("label") == 1, "phishing").otherwise("benign").alias("source_class"),
        F.col("site").alias("source_member"), "source_family_id", "source_brand", "source_collected_at",
        *["dom_" + n for n in NUMERIC_FEATURES],
    ), "archive-records")
    audit = archive_audit(scanned, directories).withColumn("cross_label_conflicts", F.lit(conflicts))
    if features.isEmpty():
        raise ValueError("no usable archive rows")
    return connected_groups(features), audit


def _store(folder: str):
    def store(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        stamp = (1980, 1, 1, 0, 0, 0)
        current, site, archive, handle, sites, files = None, None, None, None, 0, 0

        def close():
            if archive is not None:
                archive.close()
                handle.close()

        slices = (b.slice(low, STORED_ROWS) for b in batches for low in range(0, b.num_rows, STORED_ROWS))
        for row in (r for part in slices for r in part.to_pylist()):
            full = archive is not None and len(archive.filelist) >= ARCHIVE_MEMBERS and row["site"] != site
            if row["label"] != current or full:
                close()
                files = files + 1 if row["label"] == current else 0
                current = row["label"]
                system, path = opened(f"{folder}/{current}/part-{number:05d}-{files:05d}.zip")
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                handle = system.open_output_stream(path)
                archive = zipfile.ZipFile(handle, "w", zipfile.ZIP_DEFLATED)
            site = row["site"]
            entry = zipfile.ZipInfo(f"{site}/{row['basename']}", stamp)
            entry.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(entry, row["content"] or "")
            sites += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([sites], pa.int64())], ["members"])

    return store


def write_site_archives(members: DataFrame, folder: str) -> int:
    """Write (label, site, basename, content) as archives below ``folder/<label>``; returns the members.

    The members of a site stand in one archive. A task writes one for each label, and another after
    ARCHIVE_MEMBERS members, so that what it holds of an archive's directory is bounded. A repeated
    task writes the same files again.
    """
    dealt = members.select("label", "site", "basename", "content").repartition("site").sortWithinPartitions(
        "label", "site", "basename"
    )
    return dealt.mapInArrow(_store(folder), "members long").agg(F.sum("members")).first()[0] or 0
