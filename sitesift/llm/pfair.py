"""Pfair mixing: interleave blocks of sources so that each keeps within a block of its share.

A source of weight w among weights of sum W owns a window for each of its blocks: block j is released
at floor(j W / w) and due at ceil((j + 1) W / w). At each slot the released block with the earliest
deadline is served. Weights are taken as the exact fractions that they are, so no rounding adds up,
and windows are whole numbers of any size. The order is folded over blocks, not over rows: the driver
holds a row per source, and the plan is written range by range, with the blocks served of each source
carried over from the range before.
"""

from __future__ import annotations

import heapq
import itertools
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import numbered, seal
from sitesift.session import shared_folder

BLOCK_ROWS = 16
EXPONENT = 0.5
PLAN_ROWS = 1 << 18  # blocks of a range, which the driver holds at once


def source_key(source: Column) -> Column:
    """A text per source; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def tempered_weights(documents: DataFrame, exponent: float = EXPONENT) -> DataFrame:
    """(source, weight): rows of each source to the given power."""
    return documents.groupBy("source").agg(F.pow(F.count(F.lit(1)), F.lit(exponent)).alias("weight"))


def source_blocks(keys: DataFrame, weights: DataFrame, block_rows: int) -> DataFrame:
    """(key, weight, blocks) of each source in ``keys``, a row per document; no weight is null."""
    given = weights.groupBy(source_key(F.col("source")).alias("key")).agg(F.sum("weight").alias("weight"))
    blocks = F.ceil(F.count(F.lit(1)) / block_rows).cast("long")
    return keys.groupBy("key").agg(blocks.alias("blocks")).join(given, "key", "left").select(
        "key", "weight", "blocks"
    )


def exact_weights(weights: list[float | None]) -> list[int]:
    """Whole numbers in the exact proportion of the weights.

    Weights that are missing or not positive count as the smallest of the others.
    """
    given = [w for w in weights if w is not None and math.isfinite(w) and w > 0]
    least = min(given, default=1.0)
    parts = [Fraction(w if w is not None and math.isfinite(w) and w > 0 else least) for w in weights]
    scale = math.lcm(*(p.denominator for p in parts))
    return [int(p * scale) for p in parts]


def earliest_deadline_first(weights: list[int], blocks: list[int]):
    """(source, block, release, deadline, slot) of every block in the order of the slots."""
    total = sum(weights)
    waiting = [(0, i) for i, n in enumerate(blocks) if n]
    served, ready, slot = [0] * len(blocks), [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(served[i] + 1) * total // weights[i]), i, release))
        deadline, i, release = heapq.heappop(ready)
        yield i, served[i], release, deadline, slot
        served[i] += 1
        if served[i] < blocks[i]:
            heapq.heappush(waiting, (served[i] * total // weights[i], i))
        slot += 1


PLAN = "_key string, block long, release long, deadline long, slot long"


def write_plan(sources: DataFrame, range_rows: int = PLAN_ROWS) -> DataFrame:
    """(_key, block, release, deadline, slot) of each block of (key, weight, blocks) rows, written by ranges."""
    spark = sources.sparkSession
    path = shared_folder(spark, "schedule")
    rows = sorted(tuple(r) for r in sources.toLocalIterator())
    entries = earliest_deadline_first(exact_weights([r[1] for r in rows]), [r[2] for r in rows])
    more = True
    while more:
        held = list(itertools.islice(entries, range_rows))
        more = len(held) == range_rows
        columns = list(zip(*held, strict=True)) if held else [()] * 5
        names = pa.array([rows[i][0] for i in columns[0]], pa.string())
        numbers = [pa.array(c, pa.int64()) for c in columns[1:]]
        part = pa.table([names, *numbers], ["_key", "block", "release", "deadline", "slot"])
        spark.createDataFrame(part).write.mode("append").parquet(path)
    return spark.read.schema(PLAN).parquet(path)


def pfair_mix(
    documents: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS,
    cycle: int | None = None,
) -> DataFrame:
    """Add block, slot, release, deadline and seq to documents; ``seq`` orders the mixture.

    Rows of a source stand in hash order and are cut into blocks. At every slot up to the end of
    the first source that runs out, each source has been served within one block of its share;
    after that every block still lies in its own window, and slots that no block is released for
    stay empty, so the others keep their relative rates. All rows stay, repeated ones too, and there
    may be any number of sources. A null source is a source; a null text or id hashes as such.
    Sources without a positive weight get the smallest weight given; repeated ones add up. An empty
    table stays empty. Columns of the five names are replaced. Shares are exact without a cycle, so
    ``cycle`` has no effect.
    """
    added = ("block", "slot", "release", "deadline", "seq")
    rows, at, own = seal(documents, added)
    source = F.col(at["source"])
    if weights is None:
        weights = tempered_weights(rows.select(source.alias("source")))
    plan = write_plan(source_blocks(rows.select(source_key(source).alias("key")), weights, block_rows))
    ranked = numbered(
        rows.withColumns({
            "_key": source_key(source), "_order": F.xxhash64(at["doc_id"], at["text"]),
        }),
        "_key", ["_order", at["doc_id"]], "_n",
    )
    return (
        ranked.withColumn("block", F.floor(F.col("_n") / block_rows))
        .join(plan, ["_key", "block"])
        .withColumn("seq", F.col("slot") * block_rows + F.pmod("_n", F.lit(block_rows)))
        .select(*own, *added)
    )
