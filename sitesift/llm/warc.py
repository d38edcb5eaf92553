"""WARC archives: write them, normalise monolithic gzip files, read records by offset.

A monolithic archive is one gzip stream over the whole file, so a record can only be reached by
inflating everything before it. The normaliser inflates each file once, as a stream, writes every
record as a gzip member of its own, and beside it an index of offsets, after which any record is
one seek and one small inflate.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.llm.common import hot_lookup
from sitesift.session import shared_folder, write_and_read

RECORD_END = "\r\n\r\n"
CHUNK = 1 << 20
REVISIT_BYTES = 100  # smaller payloads cost less than a reference
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "archive string, offset long, length long, record_id string, record_type string"
RECORD_SCHEMA = (
    "page_id long, record_type string, payload_bytes long, payload_digest string, "
    "refers_to long, url string, payload binary"
)


# --- writing -----------------------------------------------------------------------


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def header_text(value: Column) -> Column:
    """A value on one header line: controls are percent-escaped, a null is empty."""
    value = F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D"))
    value = F.replace(value, F.lit("\n"), F.lit("%0A"))
    return F.regexp_replace(value, "[\\x00-\\x1F\\x7F]", "%20")


def with_record_types(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to), refers_to null on responses.

    Among equal payloads of at least ``least_bytes`` the smallest page_id is the response. Rows
    that repeat this id are responses too. A null id is a response only if no copy has an id.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumns({
        "payload_bytes": F.octet_length("html").cast("long"),
        "payload_digest": F.sha2(F.col("html").cast("binary"), 256),
    })
    copies = write_and_read(
        rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1),
        "payloads",
    )
    return hot_lookup(rows, copies, "payload_digest", "left").withColumn(
        "refers_to",
        F.when(~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first")),
    ).drop("_first")


def write_monolithic(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC record per page, in files that are a single gzip stream each.

    The text writer ends every row with the two line ends that close a record, so its gzip files
    are whole archives on any file system that Spark writes to.
    """
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), header_text(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body)
    with_record_types(pages).select(record.alias("value")).write.option(
        "compression", "gzip"
    ).option("lineSep", RECORD_END).text(path)


# --- records in a byte stream --------------------------------------------------------


def inflated(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """Pieces of a gzip file of one or many members, of bounded size; a file cut inside a member fails."""
    machine, begun = zlib.decompressobj(31), False
    while data := stream.read(chunk):
        while data:
            begun = True
            piece = machine.decompress(data, chunk)
            if piece:
                yield piece
            data = machine.unconsumed_tail
            if machine.eof:
                data = machine.unused_data
                machine, begun = zlib.decompressobj(31), False
    if piece := machine.flush():
        yield piece
    if begun and not machine.eof:
        raise ValueError("the archive ends inside a gzip member")


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, whole record, payload) one after the other; memory for one record."""
    buffer, pieces = bytearray(), iter(pieces)

    def fill(size: int) -> bool:
        while len(buffer) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        searched = 0
        while (at := buffer.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(buffer) - 3)
            if not fill(len(buffer) + 1):
                if bytes(buffer).strip():
                    raise ValueError("the archive ends inside a record header")
                return
        headers = {}
        for line in bytes(buffer[:at]).decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        start, end = at + 4, at + 4 + int(headers["content-length"])
        if not fill(end + 4):
            raise ValueError("the archive ends inside a record")
        yield headers, bytes(buffer[: end + 4]), bytes(buffer[start:end])
        del buffer[: end + 4]


# --- normalising ---------------------------------------------------------------------


def _open(uri: str):
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def normalise_file(source: str, folder: str, name: str) -> dict:
    """Rewrite one archive below ``folder`` with a member per record and an index beside it.

    Both files are written under a name of this attempt and moved into place at the end, so an
    attempt that dies leaves nothing that is read.
    """
    import uuid

    reader, path = _open(source)
    writer, target = _open(f"{folder}/{name}")
    writer.create_dir(target.rpartition("/")[0], recursive=True)
    attempt, offset, count = uuid.uuid4().hex, 0, 0
    temporary = f"{target.rpartition('/')[0]}/_{attempt}"
    with reader.open_input_stream(path, compression=None) as stream, \
            writer.open_output_stream(f"{temporary}.gz", compression=None) as out, \
            writer.open_output_stream(f"{temporary}.index", compression=None) as index:
        for headers, whole, _ in records(inflated(stream)):
            machine = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = machine.compress(whole) + machine.flush()
            out.write(member)
            index.write((json.dumps({
                "archive": f"{folder}/{name}", "offset": offset, "length": len(member),
                "record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type"),
            }) + "\n").encode())
            offset += len(member)
            count += 1
    writer.move(f"{temporary}.gz", target)
    writer.move(f"{temporary}.index", f"{target}.index.json")
    return {"archive": f"{folder}/{name}", "records": count, "bytes": offset}


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Normalise all ``*.gz`` below ``source`` into ``folder``: (archive, records, bytes) per file.

    A file is inflated once, by one task and as a stream: a gzip stream has no other entry point.
    Names are kept, with a digest of the source path in front so that equal names do not meet.
    """

    def run(frames):
        for frame in frames:
            yield pd.DataFrame(
                [normalise_file(p, folder, f"{hashlib.sha1(p.encode()).hexdigest()[:12]}-{p.rpartition('/')[2]}")
                 for p in frame["path"]],
                columns=["archive", "records", "bytes"],
            )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    return write_and_read(
        files.mapInPandas(run, "archive string, records long, bytes long"), "normalised"
    )


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes as one table."""
    return spark.read.schema(INDEX_SCHEMA).option("pathGlobFilter", "*.index.json").json(folder)


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_records(index: DataFrame) -> DataFrame:
    """Records at the given offsets. Each is one seek and the inflate of its own member.

    The payload of a response is checked against its digest; a revisit has none and tells the
    length and digest of the payload that it refers to.
    """

    def run(frames):
        for frame in frames:
            for archive, part in frame.groupby("archive", sort=False):
                reader, path = _open(archive)
                rows = []
                with reader.open_input_file(path) as file:
                    for offset, length in zip(part["offset"], part["length"], strict=True):
                        file.seek(offset)
                        headers, _, payload = next(records([zlib.decompress(file.read(length), 31)]))
                        revisit = headers["warc-type"] == "revisit"
                        told = headers["warc-payload-digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(payload).hexdigest() != told:
                            raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                        rows.append((
                            _number(headers["warc-record-id"]), headers["warc-type"],
                            int(headers["x-payload-length"]) if revisit else len(payload), told,
                            _number(headers.get("warc-refers-to")), headers["warc-target-uri"], payload,
                        ))
                        if sum(len(r[-1]) for r in rows[-64:]) > 8 * CHUNK or len(rows) >= 512:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = index.select("archive", "offset", "length")  # a few bytes per record, so deal them out
    return places.repartition(tasks, "archive", F.floor(F.col("offset") / CHUNK)).sortWithinPartitions(
        "archive", "offset"
    ).mapInPandas(run, RECORD_SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [field.split(" ")[0] for field in RECORD_SCHEMA.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages as monolithic archives, normalise them, and read every record back.

    Columns of ``pages`` used: page_id, url, html; others are not read. A null html is an empty
    payload, a null url an empty target, a null page_id comes back null. Repeated rows make a
    record each. An empty table gives no records.
    """
    spark = pages.sparkSession
    source, folder = shared_folder(spark, "warc-monolithic"), shared_folder(spark, "warc")
    write_monolithic(pages, source)
    if normalise(spark, source, folder).isEmpty():
        return spark.createDataFrame([], RECORD_SCHEMA)
    return read_records(read_index(spark, folder))
