"""Site archives: members to accepted, de-duplicated, grouped records with an audit.

A site is a directory with an ``info.txt`` and an ``html.txt``. Decisions are made on narrow rows
(names, lengths, the small metadata text); page HTML is read for accepted sites only.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from sitesift.constants import MAX_METADATA_BYTES
from sitesift.functions.urls import canonicalize_url, strip, text
from sitesift.operators.validate import family_id, oversize_guard

MEMBER_NAMES = ["info.txt", "html.txt"]
METADATA_TYPE = StructType(
    [StructField("ok", BooleanType())]
    + [StructField(n, StringType()) for n in ("url", "family_id", "brand", "isotime")]
)


def _literal_fields(value: str | None) -> dict | None:
    try:
        parsed = ast.literal_eval(value)
    except (SyntaxError, TypeError, ValueError, MemoryError, RecursionError):
        return None
    return parsed if isinstance(parsed, dict) else None


@F.arrow_udf(METADATA_TYPE)
def _parse_literal(values: pa.Array) -> pa.Array:
    rows = []
    for value in values.to_pylist():
        fields = _literal_fields(value)
        row = {"ok": fields is not None}
        for name in METADATA_TYPE.names[1:]:
            found = (fields or {}).get(name)
            row[name] = "" if found is None else str(found).strip()
        rows.append(row)
    kinds = [("ok", pa.bool_())] + [(n, pa.string()) for n in METADATA_TYPE.names[1:]]
    return pa.array(rows, type=pa.struct(kinds))


def metadata_parse(label: Column, metadata: Column) -> Column:
    """struct(ok, url, family_id, brand, isotime): dict text for phishing, the bare URL for benign."""
    parsed = _parse_literal(F.when(label == 1, metadata))
    bare = F.struct(
        F.lit(True).alias("ok"), strip(text(metadata)).alias("url"),
        *[F.lit("").alias(n) for n in ("family_id", "brand", "isotime")],
    )
    return F.when(label == 1, parsed).otherwise(bare)


def member_names(path: Column) -> tuple[Column, Column]:
    """(site, basename) of two-part member paths; null otherwise."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    two = (F.size(parts) == 2) & ~F.endswith(path, F.lit("/"))
    return F.when(two, F.get(parts, F.lit(0))), F.when(two, F.lower(F.get(parts, F.lit(1))))


def top_member_names(members: DataFrame, k: int = 10, salts: int = 256) -> DataFrame:
    """The k most common base names per archive with their file counts; ties by name.

    An archive may hold very many distinct names, so candidates are ranked in name-hash slices
    first; the final ranking sees at most k names per slice.
    """
    counts = members.groupBy("label", "basename").agg(F.count(F.lit(1)).alias("files"))
    order = [F.col("files").desc(), F.col("basename")]
    slices = Window.partitionBy("label", F.pmod(F.xxhash64("basename"), F.lit(salts))).orderBy(*order)
    final = Window.partitionBy("label").orderBy(*order)
    best = counts.withColumn("rank", F.row_number().over(slices)).where(F.col("rank") <= k)
    return best.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)


def pair_members(members: DataFrame) -> DataFrame:
    """One row per site: lengths and metadata text of its two members, null where missing.

    Columns in: label, site, basename, length, metadata (text of info.txt rows). A second member of
    the same name fails the job.
    """
    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col("basename") == name, F.col(column)))

    sites = members.groupBy("label", "site").agg(
        of("info.txt", "length").alias("info_length"),
        of("html.txt", "length").alias("html_length"),
        of("info.txt", "metadata").alias("metadata"),
        *[F.count_if(F.col("basename") == n).alias("_" + n[:4]) for n in MEMBER_NAMES],
    )
    repeated = F.raise_error(F.concat(F.lit("duplicate member for sample "), F.col("site")))
    checked = F.when((F.col("_info") > 1) | (F.col("_html") > 1), repeated).otherwise(F.col("site"))
    return sites.withColumn("site", checked).drop("_info", "_html")


def site_status(sites: DataFrame) -> DataFrame:
    """Adds url, family, brand, time, sample_id and ``status``.

    Status is incomplete, invalid_metadata, invalid_url, duplicate_url or accepted. Of several
    sites with one canonical URL the first in site order is kept.
    """
    parsed = sites.withColumn("_m", metadata_parse(F.col("label"), F.col("metadata"))).select(
        *sites.columns,
        F.col("_m.ok").alias("_ok"), F.col("_m.url").alias("url"),
        family_id(F.col("_m.family_id")).alias("source_family_id"),
        F.col("_m.brand").alias("source_brand"), F.col("_m.isotime").alias("source_collected_at"),
    ).drop("metadata")
    complete = F.col("info_length").isNotNull() & F.col("html_length").isNotNull()
    named = parsed.withColumn("sample_id", F.sha2(canonicalize_url(F.col("url")), 256)).withColumn(
        "_state",
        F.when(~complete, "incomplete").when(~F.col("_ok"), "invalid_metadata")
        .when(F.col("sample_id").isNull(), "invalid_url"),
    )
    firsts = named.where(F.col("_state").isNull()).groupBy("label", "sample_id").agg(
        F.min("site").alias("site"), F.lit(True).alias("_first")
    )
    # The join key holds the site, so a URL repeated over many sites does not gather in one task.
    return named.join(firsts, ["label", "sample_id", "site"], "left").withColumn(
        "status", F.coalesce("_state", F.when(F.col("_first"), "accepted").otherwise("duplicate_url"))
    ).drop("_ok", "_state", "_first")


def balanced_limit(sites: DataFrame, limit: int | None) -> DataFrame:
    """Keep what a scan in site order sees before ``max(1, limit // 2)`` rows per class are accepted.

    Adds ``scan_capped`` per class. The cut is the k-th accepted site, found with a top-k.
    """
    if limit is None:
        return sites.withColumn("scan_capped", F.lit(False))
    k = max(1, int(limit) // 2)
    parts = []
    for label in (1, 0):
        side = sites.where(F.col("label") == label)
        first = side.where(F.col("status") == "accepted").select("site").orderBy("site").limit(k)
        reach = first.agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("site").alias("last")).alias("r")).scalar()
        last = side.agg(F.max("site")).scalar()
        parts.append(
            side.withColumn("_r", reach).where((F.col("_r.n") < k) | (F.col("site") <= F.col("_r.last")))
            .withColumn("scan_capped", (F.col("_r.n") >= k) & (F.col("_r.last") < last)).drop("_r")
        )
    return parts[0].unionByName(parts[1])


def archive_audit(sites: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """One row of counters per class. ``directories`` is the status table before any cap."""
    def n(test: Column) -> Column:
        return F.count_if(test)

    status = F.col("status")
    audit = sites.groupBy("label").agg(
        n(status == "accepted").alias("accepted"),
        n(F.col("info_length").isNotNull() & F.col("html_length").isNotNull()).alias("candidate_pairs"),
        n(status == "duplicate_url").alias("duplicate_url"),
        n(status == "invalid_metadata").alias("invalid_metadata"),
        n(status == "invalid_url").alias("invalid_url"),
        n(F.col("html_length").isNull()).alias("missing_html"),
        n(F.col("info_length").isNull()).alias("missing_info"),
        F.count(F.lit(1)).alias("scanned_directories"),
        (F.bool_or("scan_capped") if "scan_capped" in sites.columns else F.lit(False)).alias("scan_capped"),
    )
    total = (directories if directories is not None else sites).groupBy("label").agg(
        F.count(F.lit(1)).alias("sample_directories")
    )
    return audit.join(total, "label")


def sorted_sites(sites: DataFrame) -> DataFrame:
    """Scan order: phishing archive first, then by site name."""
    return sites.orderBy(F.col("label").desc(), "site")


def guard_metadata(members: DataFrame) -> DataFrame:
    oversize_guard(members.where(F.col("basename") == "info.txt"), "length", MAX_METADATA_BYTES, "info.txt")
    return members
