"""Raw rows to canonical records, counters and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.constants import NUMERIC_FEATURES
from sitesift.functions.columns import built_once
from sitesift.functions.html import add_page_features, parse_status
from sitesift.functions.urls import add_url_features, canonicalize_url, strip, text
from sitesift.operators.groups import dedupe_keep_first
from sitesift.operators.validate import format_utc, label_from_text, parse_utc, reject_reason, require_columns

RAW_COLUMNS = ["url", "html", "date", "label"]


def all_features(frame: DataFrame, url: str = "url", html: str = "html", prefix: str = "dom_") -> DataFrame:
    """title, status and all 39 features; narrow, no shuffle."""
    return add_page_features(add_url_features(frame, url, prefix), url, html, prefix)


@built_once
def _record_columns() -> dict[str, Column]:
    """The checked columns of a raw row; values of rejected rows are null."""
    kept = F.col("reject_reason").isNull()

    def must(value: Column, what: str, shown: str) -> Column:
        checked = F.when(
            value.isNull(), F.raise_error(F.concat(F.lit(what + ": "), F.col(shown)))
        ).otherwise(value)
        return F.when(kept, checked)

    return {
        "label": must(label_from_text(F.col("label")), "unknown label", "label"),
        "url": F.when(kept, strip(text(F.col("url")))),
        "date": must(parse_utc(F.col("date")), "date must be a strict ISO-8601 UTC timestamp", "date"),
        "sample_id": F.sha2(must(canonicalize_url(F.col("url")), "invalid url", "url"), 256),
        "html": F.when(kept, F.col("html")),
    }


@built_once
def _record_output() -> list[Column]:
    kept = F.col("reject_reason").isNull()
    status = F.when(kept, parse_status(F.col("status"), F.col("title"))).otherwise("skipped")
    return [
        F.col("url"), F.when(kept, F.col("title")).alias("title"), F.col("date"),
        format_utc(F.col("date")).alias("date_text"), F.col("label"), F.col("sample_id"),
        status.alias("parse_status"),
        *[F.when(kept, F.col("dom_" + n)).alias("dom_" + n) for n in NUMERIC_FEATURES],
    ]


def canonical_records(raw: DataFrame, keep_html: bool = False) -> DataFrame:
    """Canonical records from (url, html, date, label) rows; other columns are carried through.

    Rejected rows keep only ``reject_reason`` and status 'skipped'. An unknown label or a date that
    is present but unreadable fails the job. HTML is dropped once the features exist.
    """
    require_columns(raw, RAW_COLUMNS, "page stream")
    carried = [c for c in raw.columns if c not in RAW_COLUMNS]
    staged = raw.withColumn("reject_reason", reject_reason()).select(
        *carried, "reject_reason", *[value.alias(name) for name, value in _record_columns().items()]
    )
    return all_features(staged).select(
        *carried, "reject_reason", *_record_output(), *(["html"] if keep_html else [])
    )


def limit_scan(raw: DataFrame, order: str, limit: int) -> DataFrame:
    """The first rows in source order; rejects count, so the cap comes before any filter."""
    if limit < 0:
        raise ValueError("limit must be a non-negative integer")
    return raw.orderBy(order).limit(limit)


# --- counters --------------------------------------------------------------------


def counter_rows(records: DataFrame) -> DataFrame:
    """(kind, reason, n): class, parse and reject counters."""
    accepted = F.col("reject_reason").isNull()
    pairs = F.when(
        accepted,
        F.array(
            F.struct(F.lit("class").alias("kind"), F.col("label").cast("string").alias("reason")),
            F.struct(F.lit("parse").alias("kind"), F.col("parse_status").alias("reason")),
        ),
    ).otherwise(F.array(F.struct(F.lit("reject").alias("kind"), F.col("reject_reason").alias("reason"))))
    return records.select(F.explode(pairs).alias("p")).select("p.kind", "p.reason")


def reason_counts(records: DataFrame) -> DataFrame:
    return counter_rows(records).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n"))


def counter_consistency(counts: DataFrame, processed: Column | None = None) -> DataFrame:
    """One row: accepted, parsed, rejected, consistent."""
    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    sums = counts.agg(
        total("class").alias("accepted"), total("parse").alias("parsed"), total("reject").alias("rejected")
    )
    ok = F.col("accepted") == F.col("parsed")
    if processed is not None:
        ok = ok & (F.col("accepted") + F.col("rejected") == processed)
    return sums.withColumn("consistent", ok)


def class_counts(frame: DataFrame, label: str = "label") -> DataFrame:
    """One row (benign, phishing), zeros included."""
    return frame.agg(
        F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("phishing")
    )


def raw_label_counts(frame: DataFrame, label: str = "label") -> DataFrame:
    return frame.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("<NA>")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def slice_summary(frame: DataFrame, label: str = "label") -> DataFrame:
    return frame.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 0).alias("benign"),
        F.count_if(F.col(label) == 1).alias("phish"),
        F.round(F.avg(F.col(label).cast("double")), 6).alias("phish_rate"),
    )


def audit_report(raw: DataFrame, order: str, url: str = "url", label: str = "label") -> DataFrame:
    """(metric, value): raw and canonical rows, invalid URLs, duplicates and class counts."""
    ids = raw.select(
        F.sha2(canonicalize_url(F.col(url)), 256).alias("sample_id"), F.col(order), F.col(label).alias("label")
    )
    first = dedupe_keep_first(ids.where(F.col("sample_id").isNotNull()), "sample_id", order)
    invalid = F.col("sample_id").isNull().cast("int")
    sides = ids.select(F.lit(1).alias("raw"), invalid.alias("invalid"), F.lit(0).alias("kept"), "label").unionByName(
        first.select(F.lit(0).alias("raw"), F.lit(0).alias("invalid"), F.lit(1).alias("kept"), "label")
    )
    sums = sides.agg(
        F.sum("raw").alias("raw_rows"), F.sum("kept").alias("canonical_rows"),
        F.sum("invalid").alias("invalid_urls"),
        (F.sum("raw") - F.sum("invalid") - F.sum("kept")).alias("duplicate_rows"),
        F.sum(F.when(F.col("label") == 0, F.col("kept")).otherwise(0)).alias("benign"),
        F.sum(F.when(F.col("label") == 1, F.col("kept")).otherwise(0)).alias("phishing"),
    )
    return sums.unpivot([], sums.columns, "metric", "value")

