"""Row validation. Missing columns and unknown labels fail the job; missing values on a row give a
reject reason; malformed HTML is tolerated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.constants import (
    DOM_FEATURES, MAX_DOM_KEYS, MAX_TITLE_CODE_POINTS, MAX_URL_CODE_POINTS, MISSING_FAMILY_IDS,
    UNSAFE_KEYS,
)
from sitesift.functions.urls import strip, text

SHOWN = 20  # distinct bad values named in an error message


def require_columns(frame: DataFrame, required: Sequence[str], source: str = "input") -> DataFrame:
    missing = sorted(set(required) - set(frame.columns))
    if missing:
        raise ValueError(f"missing {source} columns: {missing}; available: {sorted(frame.columns)}")
    return frame


def never_null(name: str) -> Column:
    """The column; a row without a value fails the job instead of vanishing in a later join."""
    column = F.col(name)
    return F.when(column.isNull(), F.raise_error(F.lit(f"{name} must not be null"))).otherwise(column)


def fail_on_values(frame: DataFrame, bad: Column, value: Column, message: str) -> DataFrame:
    """Raise naming the distinct offending values, if any."""
    shown = F.coalesce(value.cast("string"), F.lit("<NA>")).alias("v")
    found = [r["v"] for r in frame.where(bad).select(shown).distinct().orderBy("v").limit(SHOWN).collect()]
    if found:
        raise ValueError(f"{message}: {found}")
    return frame


def blank(value: Column) -> Column:
    return strip(text(value)) == ""


# --- labels ----------------------------------------------------------------------


def label_inverted(raw: Column) -> Column:
    """1 - raw for the texts '0' and '1'; null for anything else."""
    return F.when(raw == "0", 1).when(raw == "1", 0)


def label_from_text(raw: Column) -> Column:
    """0 for benign, 1 for phish (trimmed, any case); null for anything else."""
    name = F.lower(strip(text(raw)))
    return F.when(name == "benign", 0).when(name == "phish", 1)


def label_dual(label: Column, kind: Column) -> Column:
    """One consistent value from a 0/1 label and a phishing/benign type; null otherwise."""
    named = F.lower(strip(text(kind)))
    digit = F.lower(strip(text(label)))
    found = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(digit == "1", 1).when(digit == "0", 0),
                F.when(named == "phishing", 1).when(named == "benign", 0),
            )
        )
    )
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def require_known_labels(frame: DataFrame, raw: str, label: Column, allow_blank: bool = False) -> DataFrame:
    """Raise if a raw label has no value."""
    bad = label.isNull()
    if allow_blank:
        bad = bad & ~blank(F.col(raw))
    return fail_on_values(frame, bad, F.col(raw), "unknown labels")


# --- dates -----------------------------------------------------------------------


def parse_utc(value: Column) -> Column:
    """UTC timestamp of YYYY-MM-DD or an ISO-8601 time with offset or Z; null otherwise."""
    raw = strip(text(value))
    day = F.rlike(raw, F.lit(r"^\d{4}-\d{2}-\d{2}\z"))
    full = F.rlike(
        raw,
        F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})\z"),
    )
    return F.when(day, F.try_to_timestamp(F.concat(raw, F.lit("T00:00:00Z")))).when(
        full, F.try_to_timestamp(raw)
    )


def format_utc(value: Column) -> Column:
    """Canonical text with Z; microseconds only when present. Needs a UTC session zone."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(value), F.lit(1_000_000))
    return F.when(micros == 0, F.concat(whole, F.lit("Z"))).otherwise(
        F.concat(whole, F.lit("."), F.lpad(micros.cast("string"), 6, "0"), F.lit("Z"))
    )


def temporal_filter(frame: DataFrame, date: str, cutoff: Column, keep: str) -> DataFrame:
    """Rows strictly before, or at or after, the cutoff. Rejected rows pass, to be counted."""
    if keep == "before":
        wanted = F.col(date) < cutoff
    elif keep == "at_or_after":
        wanted = F.col(date) >= cutoff
    else:
        raise ValueError("keep must be 'before' or 'at_or_after'")
    if "reject_reason" in frame.columns:
        wanted = wanted | F.col("reject_reason").isNotNull()
    return frame.where(wanted)


# --- rejects ---------------------------------------------------------------------


def reject_reason(label: str = "label", url: str = "url", date: str = "date") -> Column:
    """First missing field, in order; null for an accepted raw row."""
    return (
        F.when(blank(F.col(label)), "missing_label")
        .when(blank(F.col(url)), "missing_url")
        .when(blank(F.col(date)), "missing_date")
    )


def accept_reason(frame: DataFrame) -> Column:
    """Stream gate: why a record is dropped, null when it is accepted."""
    given = F.col("reject_reason") if "reject_reason" in frame.columns else F.lit(None).cast("string")
    return (
        F.when(given.isNotNull(), F.when(strip(given) == "", "unknown").otherwise(strip(given)))
        .when(F.col("label").isNull(), "missing_label")
        .when(blank(F.col("url")), "missing_url")
    )


def accept_record(frame: DataFrame) -> DataFrame:
    """Adds ``drop_reason``. A boolean label column or a label other than 0 / 1 fails the job."""
    if dict(frame.dtypes)["label"] == "boolean":
        raise ValueError("a boolean column cannot train: label must be 0 or 1")
    bad = F.col("label").isNotNull() & ~F.col("label").isin(0, 1)
    checked = F.when(
        bad, F.raise_error(F.concat(F.lit("a label to train on must be 0 or 1, this one is "), F.col("label")))
    ).otherwise(F.col("label"))
    return frame.withColumn("drop_reason", accept_reason(frame)).withColumn(
        "label", F.when(F.col("drop_reason").isNull(), checked).otherwise(F.col("label"))
    )


# --- metadata --------------------------------------------------------------------


def family_id(value: Column) -> Column:
    """Family id text; placeholders become empty."""
    trimmed = strip(text(value))
    return F.when(F.lower(trimmed).isin(MISSING_FAMILY_IDS), "").otherwise(trimmed)


# --- predictions and scores ------------------------------------------------------


def prediction_problem(
    ident: str = "sample_id", label: str = "label", html: str = "html", corrupt: str | None = None
) -> Column:
    """Why a scorer input row is malformed; null when it is fine."""
    def has(column: str, pattern: str) -> Column:
        return F.rlike(F.col(column), F.lit(pattern))

    problem = F.when(F.col(corrupt).isNotNull(), "too many fields") if corrupt else None
    checks = [
        (F.coalesce(F.col(ident), F.lit("")) == "", "malformed sample_id"),
        (has(ident, r"[\x{00}\r\n]"), "malformed sample_id"),
        (~F.coalesce(F.col(label).cast("string"), F.lit("")).isin("0", "1"), "malformed label"),
        (F.coalesce(F.col(html), F.lit("")) == "", "malformed html"),
        (has(html, r"\x{00}"), "malformed html"),
    ]
    for test, name in checks:
        problem = F.when(test, name) if problem is None else problem.when(test, name)
    return problem


def prediction_row_checks(frame: DataFrame, ident: str = "sample_id", **columns) -> DataFrame:
    """(problem, rows): malformed rows by problem, and ids that occur more than once."""
    malformed = (
        frame.select(prediction_problem(ident, **columns).alias("problem"))
        .where(F.col("problem").isNotNull())
        .groupBy("problem").agg(F.count(F.lit(1)).alias("rows"))
    )
    repeated = (
        frame.groupBy(ident).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        .agg(F.sum(F.col("_n") - 1).alias("rows")).where(F.col("rows") > 0)
        .select(F.lit("duplicate sample_id").alias("problem"), "rows")
    )
    return malformed.unionByName(repeated)


def fail_on_problems(problems: DataFrame, what: str) -> None:
    found = {r["problem"]: r["rows"] for r in problems.collect()}
    if found:
        raise ValueError(f"{what}: {found}")


def score_checks(frame: DataFrame, scores: Sequence[str] = ("score",), probability: bool = False) -> DataFrame:
    """One row of counts: rows, bad labels, non-finite scores, scores outside [0, 1]."""
    def bad(name: str) -> Column:
        c = F.col(name)
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    non_finite = sum((bad(s).cast("int") for s in scores), F.lit(0)) > 0
    outside = sum(
        ((~bad(s)) & ((F.col(s) < 0) | (F.col(s) > 1))).cast("int") for s in scores
    ) > 0
    return frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad_labels"),
        F.count_if(non_finite).alias("bad_scores"),
        *([F.count_if(outside).alias("outside_unit")] if probability else []),
    )


def require_scores(frame: DataFrame, scores: Sequence[str] = ("score",), probability: bool = False) -> DataFrame:
    row = score_checks(frame, scores, probability).first().asDict()
    if row["rows"] == 0:
        raise ValueError("inputs must not be empty")
    if row["bad_labels"]:
        raise ValueError("labels must contain only 0 and 1")
    if row["bad_scores"]:
        raise ValueError("scores must be finite")
    if row.get("outside_unit"):
        raise ValueError("probability must be in [0, 1]")
    return frame


# --- live page records -----------------------------------------------------------


def page_record_problem(url: str = "url", title: str = "title", dom: str = "dom") -> Column:
    """Why a live page record is refused; null when it may be scored."""
    u, t, d = F.col(url), F.col(title), F.col(dom)
    names = F.map_keys(d)
    return (
        F.when(u.isNull(), "url must be text")
        .when(F.length(u) > MAX_URL_CODE_POINTS, "url exceeds supported length")
        .when(t.isNull(), "title must be text")
        .when(F.length(t) > MAX_TITLE_CODE_POINTS, "title exceeds supported length")
        .when(~F.rlike(u, F.lit(r"(?i)^https?://[^\s/?#]+")), "url must use http or https")
        .when(d.isNull(), "dom features must be an object")
        .when(F.size(names) > MAX_DOM_KEYS, "too many dom features")
        .when(F.exists(names, lambda n: n.isin(["", *UNSAFE_KEYS]) | F.contains(n, F.lit("\x00"))), "unsafe dom feature")
        .when(~F.forall(names, lambda n: n.isin(DOM_FEATURES)), "dom feature is not allowed")
        .when(
            F.exists(F.map_values(d), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))),
            "dom feature values must be finite",
        )
    )


def oversize_guard(frame: DataFrame, length: str, limit: int, what: str) -> DataFrame:
    """Raise if any row is larger than the limit."""
    row = frame.where(F.col(length) > limit).agg(
        F.count(F.lit(1)).alias("n"), F.max(length).alias("largest")
    ).first()
    if row["n"]:
        raise ValueError(f"{what} is too large: {row['n']} above {limit} bytes, largest {row['largest']}")
    return frame
