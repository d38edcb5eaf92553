"""Fingerprints of id sets and id orders.

A single sha256 over all ids would push the whole table through one task. Both fingerprints are
therefore trees: blocks of bounded size are hashed where they are, and block hashes are hashed
again until one is left. Equal inputs give equal fingerprints whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF_DIGITS = 4
BLOCK = 4096


def _joined(column: str, order: str) -> Column:
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v")))),
        lambda item: item["v"],
    )
    return F.concat(F.array_join(listed, "\n"), F.lit("\n"))


def manifest_hash(
    frame: DataFrame, id_column: str = "sample_id", keys: Sequence[str] = (), name: str = "manifest"
) -> DataFrame:
    """One hash per key over the set of distinct ids.

    Leaves are id-hash prefixes (65,536 of them, of equal expected size); 256 branches join them.
    """
    keys = list(keys)
    hashed = frame.select(*keys, F.sha2(F.col(id_column).cast("string"), 256).alias("_h")).distinct()
    leaves = hashed.groupBy(*keys, F.substring("_h", 1, LEAF_DIGITS).alias("_leaf")).agg(
        F.sha2(_joined("_h", "_h"), 256).alias("_d")
    )
    branches = leaves.groupBy(*keys, F.substring("_leaf", 1, 2).alias("_branch")).agg(
        F.sha2(_joined("_d", "_leaf"), 256).alias("_d")
    )
    return branches.groupBy(*keys).agg(F.sha2(_joined("_d", "_branch"), 256).alias(name))


def ordered_id_hash(
    frame: DataFrame, id_column: str, position: str, keys: Sequence[str] = (), name: str = "order_hash"
) -> DataFrame:
    """One hash per key over the ids in the order of a zero-based position.

    Three levels of 4096 cover 6.9e10 positions.
    """
    keys = list(keys)
    level = frame.select(
        *keys, F.col(position).cast("long").alias("_o"), F.to_json(F.struct(F.col(id_column).cast("string").alias("id"))).alias("_d")
    )
    for _ in range(2):
        level = level.groupBy(*keys, F.floor(F.col("_o") / BLOCK).alias("_block")).agg(
            F.sha2(_joined("_d", "_o"), 256).alias("_d")
        ).withColumnRenamed("_block", "_o")
    return level.groupBy(*keys).agg(F.sha2(_joined("_d", "_o"), 256).alias(name))
