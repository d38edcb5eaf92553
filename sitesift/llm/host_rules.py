"""Quality rules per document and per host.

Every document is measured and held against fixed rules. A host's rate of failures is then shrunk
towards the rate of all hosts with a beta prior fitted to them, so a host of three documents is not
judged by one bad one, and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import WORD_SPACE, hot_lookup, seal, words_of
from sitesift.session import write_and_read

LEAST_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
HOST_LIMIT = 0.5  # a host is turned away above this shrunk rate of failures
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: str) -> Column:
    """Words that stand in a three-word window found at least twice in the row's text.

    The windows are sorted by hash inside the row, so equal ones are neighbours; no row meets
    another and nothing is shuffled.
    """
    count = F.size(words) - 2
    windows = F.arrays_zip(
        F.slice(words, 1, count).alias("a"), F.slice(words, 2, count).alias("b"),
        F.slice(words, 3, count).alias("c"),
    )
    hashed = F.transform(
        windows, lambda w, i: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), i.alias("at"))
    )
    return F.when(F.size(words) >= 4, F.sort_array(hashed))


def covered(order: str) -> Column:
    """Number of words under the windows whose hash equals that of a neighbour in the order."""
    nothing = F.array().cast("array<int>")
    equal = F.flatten(F.zip_with(
        order, F.slice(order, 2, F.size(order)),
        lambda x, y: F.when(x["h"] == y["h"], F.array(x["at"], y["at"])).otherwise(nothing),
    ))
    words = F.flatten(F.transform(F.array_distinct(equal), lambda p: F.array(p, p + 1, p + 2)))
    return F.coalesce(F.size(F.array_distinct(words)), F.lit(0))


def measured(rows: DataFrame, text: str) -> DataFrame:
    """Add MEASURES and base_failed; a null text has no words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(whole, WORD_SPACE, "")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")
    return (
        rows.withColumns({"_words": words_of(F.col(text)), "_lines": lines})
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_order": repeated_words("_words"),
        })
        .drop("_words", "_lines")
        .withColumn("n_repeat_words", F.when(F.col("_order").isNull(), 0).otherwise(covered("_order")).cast("long"))
        .drop("_order")
        .withColumn(
            "base_failed",
            (F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        )
    )


def host_verdicts(rows: DataFrame, host: str, failed: str, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, _n, n_failed, host_rate, host_kept) per host.

    The beta prior is fitted to the hosts' rates by moments, each weighted by its documents; where
    the rates do not vary more than chance, the prior is the overall rate with the weight of all
    documents of a mean host. Null is a host of its own.
    """
    hosts = rows.groupBy(host).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(failed).cast("long")).alias("n_failed")
    )
    total, failures = F.sum("_n"), F.sum("n_failed")
    mean = failures / total
    spread = F.sum(F.col("n_failed") * F.col("n_failed") / F.col("_n")) / total - mean * mean
    chance = mean * (1 - mean) * F.count(F.lit(1)) / total
    between = F.greatest(spread - chance, F.lit(0.0))
    strength = F.when(between > 0, F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0)))
    prior = hosts.agg(
        F.struct(
            mean.alias("mean"), F.coalesce(strength, total / F.count(F.lit(1))).alias("strength")
        ).alias("prior")
    ).scalar()
    rate = (F.col("n_failed") + prior["mean"] * prior["strength"]) / (F.col("_n") + prior["strength"])
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= limit)


def host_rules(documents: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: doc_id, host, MEASURES, base_failed, host_rate, kept.

    A document is kept if it passes the rules itself and its host is not turned away. Null and
    empty texts have no words and fail. Rows with a null host form one host. Repeated rows count
    and are returned each. An empty table gives no rows; other columns are not read.
    """
    rows, at, _ = seal(documents)
    facts = measured(
        rows.select(
            F.col(at["doc_id"]).alias("doc_id"), F.col(at[host]).alias("host"),
            F.coalesce(F.concat(F.lit("="), F.col(at[host]).cast("string")), F.lit("null")).alias("_host"),
            F.col(at["text"]).alias("_text"),
        ),
        "_text",
    ).drop("_text")
    facts = write_and_read(facts, "document-facts")
    verdicts = write_and_read(host_verdicts(facts, "_host", "base_failed", limit), "hosts")
    return hot_lookup(facts, verdicts.drop("n_failed"), "_host").select(
        "doc_id", "host", *MEASURES, "base_failed", "host_rate",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
    )
