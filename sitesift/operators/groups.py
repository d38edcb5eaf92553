"""Duplicates and connected groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.operators.skew import skewed_lookup
from sitesift.operators.validate import never_null
from sitesift.session import write_and_read


def dedupe_keep_first(frame: DataFrame, id_column: str, order: str) -> DataFrame:
    """First row per id in source order. ``order`` must be distinct within an id; a null id fails.

    Two narrow columns are aggregated with a map-side combine, then rows are kept by a semi join on
    (id, order): a page with millions of copies never gathers in one task.
    """
    frame = frame.withColumn(id_column, never_null(id_column))
    firsts = frame.groupBy(id_column).agg(F.min(order).alias(order))
    return frame.join(firsts, [id_column, order], "left_semi")


def label_conflicts(frame: DataFrame, id_column: str = "sample_id") -> DataFrame:
    """Ids seen with more than one label."""
    return (
        frame.groupBy(id_column)
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where(F.col("low") != F.col("high"))
        .select(id_column)
    )


def _lowest_of_each(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """For the nodes 0 to size - 1 the smallest node that links (left, right) connect them with."""
    low = np.arange(size)
    while True:
        smaller = np.minimum(low[left], low[right])
        hooked = low.copy()
        np.minimum.at(hooked, low[left], smaller)
        np.minimum.at(hooked, low[right], smaller)
        while not np.array_equal(further := hooked[hooked], hooked):
            hooked = further
        if np.array_equal(hooked, low):
            return low
        low = hooked


def _stars_of_batches(batches):
    """(node, root) of every node of a batch of edges, connected by the edges of the batch alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pa.concat_arrays([batch.column(0), batch.column(1)]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary.cast(pa.binary())).to_numpy()  # as Spark orders strings
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[ends.indices.to_numpy()]
        low = _lowest_of_each(at[: batch.num_rows], at[batch.num_rows:], len(order))
        names = ends.dictionary.take(pa.array(order))
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(low))], ["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node of the component.

    ``edges`` has string columns ``a`` and ``b``; repeats are welcome. The edges of a batch of rows are
    connected where they are read, so what neighbouring rows connect never travels. Only the roots of
    nodes that batches disagree about go on to the rounds of ``star_rounds``.
    """
    ends = edges.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where(F.col("a").isNotNull())
    stars = write_and_read(ends.mapInArrow(_stars_of_batches, "node string, root string"), "stars")
    firsts = write_and_read(
        stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("_last")), "first-roots"
    )
    # A node stands at most once in a batch, so not even one of all edges is a hot key.
    unsettled = firsts.where(F.col("root") != F.col("_last")).select("node", F.col("root").alias("b"))
    links = write_and_read(
        stars.join(unsettled, "node").where(F.col("root") != F.col("b")).select(F.col("root").alias("a"), "b").distinct(),
        "root-links",
    )
    firsts = firsts.select("node", "root")
    if links.isEmpty():
        return firsts
    tops = star_rounds(links, max_rounds).select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return skewed_lookup(firsts, tops, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))


def star_rounds(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) with root the smallest node of the component.

    ``edges`` has string columns ``a`` and ``b``. Alternating star contraction: each round points
    every node at the smallest neighbour it knows, and the diameter falls by a constant factor.
    Each round is written to the shared folder, which cuts the lineage and gives the next joins sizes.
    Minima are combined on the map side and the
    join back to a node's edges is salted for nodes with very many of them.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    loops = pairs.where(F.col("u") == F.col("v")).select("u")
    pairs = write_and_read(pairs.where(F.col("u") != F.col("v")), "edges")
    nodes = write_and_read(
        pairs.select("u").union(pairs.select(F.col("v").alias("u"))).union(loops).distinct(), "nodes"
    )
    size = pairs.count()
    for _ in range(max_rounds):
        # Large star: larger neighbours of u move to the smallest node around u.
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("_m")).select(
            "u", F.least("u", "_m").alias("low")
        )
        upward = both.where(F.col("v") > F.col("u"))
        large = write_and_read(
            skewed_lookup(upward, lows, "u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .where(F.col("u") != F.col("v")).distinct(),
            "large-star",
        )
        # Small star: u and its smaller neighbours move to the smallest of them.
        mins = large.groupBy("u").agg(F.min("v").alias("low"))
        small = write_and_read(
            skewed_lookup(large, mins, "u")
            .select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("low").alias("v")),
            )).alias("e"))
            .select("e.u", "e.v")
            .where(F.col("u") != F.col("v"))
            .distinct(),
            "small-star",
        )
        before, size = size, small.count()
        settled = size == before and small.join(pairs, ["u", "v"], "left_anti").isEmpty()
        pairs = small
        if settled:
            roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.select(F.col("u").alias("node")).join(roots, "node", "left").select(
                "node", F.coalesce("root", "node").alias("root")
            )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_groups(
    frame: DataFrame, domain: str = "registrable_domain", family: str = "source_family_id",
    group: str = "group",
) -> DataFrame:
    """Rows that share a domain or a family id, directly or through others, share ``group``.

    A row without a domain fails; one without a family id is grouped by its domain.
    """
    family_text = F.trim(F.coalesce(F.col(family).cast("string"), F.lit("")))
    tokens = frame.withColumn("_domain", F.concat(F.lit("domain:"), never_null(domain)))
    edges = tokens.select(
        F.col("_domain").alias("a"),
        F.when(family_text == "", F.col("_domain"))
        .otherwise(F.concat(F.lit("family:"), family_text))
        .alias("b"),
    )
    roots = connected_components(edges).select(
        F.col("node").alias("_domain"), F.col("root").alias(group)
    )
    return skewed_lookup(tokens.drop(group), roots, "_domain").drop("_domain")
