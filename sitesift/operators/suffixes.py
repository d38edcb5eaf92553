"""Longest-suffix lookup against a table of suffix rules.

The table is a trie of reversed labels: each suffix of a host is a node, and a node is met by three
rules: its own name, ``*.parent`` (any one label below the parent) and ``!name`` (not a suffix although
a wildcard covers it: the parent is). All nodes of a host are looked up in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.functions.urls import host_labels, is_ip_literal
from sitesift.operators.skew import skewed_lookup

MAX_BROADCAST_SUFFIXES = 50_000


def suffix_longest_match(frame: DataFrame, suffixes: DataFrame, host: str = "host") -> DataFrame:
    """Adds ``suffix``: the longest listed suffix with at least one label before it, else null.

    ``suffixes.suffix`` holds plain suffixes, wildcards and exceptions; a matching exception wins
    over longer rules. Works on distinct hosts, so a host shared by many rows is matched once; the result returns to
    the rows through a salted join.
    """
    hosts = frame.select(host).distinct()
    listed = suffixes.select(F.col("suffix").alias("rule")).distinct()
    size = listed.count()
    listed = F.broadcast(listed) if size <= MAX_BROADCAST_SUFFIXES else listed
    def tail(first) -> Column:
        return F.array_join(F.slice("_labels", first, F.size("_labels")), ".")

    at = F.col("_from")
    parent = F.when(at < F.size("_labels"), tail(at + 1))
    candidates = (
        hosts.where(~is_ip_literal(F.col(host)))
        .withColumn("_labels", host_labels(F.col(host)))
        .where(F.size("_labels") > 1)
        .select(host, "_labels", F.explode(F.sequence(F.lit(1), F.size("_labels"))).alias("_from"))
        .select(
            host,
            F.inline(F.array(
                _candidate(F.when(at > 1, tail(at)), tail(at), False),
                _candidate(F.when(at > 1, F.concat(F.lit("*."), parent)), tail(at), False),
                _candidate(F.concat(F.lit("!"), F.when(parent.isNotNull(), tail(at))), parent, True),
            )),
        )
        .where(F.col("rule").isNotNull())
    )
    best = candidates.join(listed, "rule").groupBy(host).agg(
        F.max_by("suffix", F.struct("exception", F.length("suffix"))).alias("suffix")
    )
    return skewed_lookup(frame, best, host, "left")


def _candidate(rule: Column, suffix: Column, exception: bool) -> Column:
    """A rule that would match, and the suffix it then gives."""
    return F.struct(rule.alias("rule"), suffix.alias("suffix"), F.lit(exception).alias("exception"))


def registrable_domain_psl(frame: DataFrame, suffixes: DataFrame, host: str = "host") -> DataFrame:
    """Adds ``domain``: listed suffix plus one label; hosts without a listed suffix stay whole."""
    matched = suffix_longest_match(frame, suffixes, host)
    front = F.substr(F.col(host), F.lit(1), F.length(host) - F.length("suffix") - 1)
    return matched.withColumn(
        "domain",
        F.when(F.col("suffix").isNull(), F.col(host)).otherwise(
            F.concat_ws(".", F.substring_index(front, ".", -1), "suffix")
        ),
    ).drop("suffix")
