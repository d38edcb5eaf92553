"""Trie of conversation prefixes, by ROLLUP over columns of turn ids.

A conversation is a row with one column per position. ROLLUP over the columns groups all prefixes at
once, and grouping_id says how deep a group reaches. Columns hold WIDTH positions; conversations that
go on, and share all of them with another one, continue in a further block whose first column is the
node they reached. What is left of a conversation that no other one shares is a path of its own.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import _numbered, hot_lookup
from sitesift.session import write_and_read

WIDTH = 8  # positions of a block
ID_BYTES = 20  # 16 of the turn's digest, 4 of its length
BORROWED = 6  # a conversation borrows less than so many turns
FAMILY = 100  # from the conversation whose id is the last multiple of this
BUCKET_BITS = 12  # ids gathered in one string, positions numbered together
TURNS = [f"t{i}" for i in range(WIDTH)]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, said): ``said`` is a turn's digest and its text's length in code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.concat(F.unhex(F.substring(digest, 1, 32)), F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))).alias("said"),
    )


def positions(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, said): 0, 1, ... by turn, null first, then by ``said``.

    Turns are numbered in stretches of 4,096 turn numbers, so an endless conversation is not ordered
    in one task.
    """
    bucket = F.coalesce(F.shiftright("turn", BUCKET_BITS), F.lit(-(1 << 62)))
    return _numbered(turns.withColumn("_bucket", bucket), "conv_id", ["turn", "said"], "pos").select(
        "conv_id", "pos", "said"
    )


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, said) of the rebuilt conversations, and (conv_id, n_turns) of all of them."""
    own = write_and_read(positions(write_and_read(turn_ids(conversations), "turns")), "positions")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(BORROWED))
    heads = own.where(F.col("pos") < BORROWED - 1).groupBy(F.col("conv_id").alias("base")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "said"))), lambda t: t["said"]).alias("_head")
    )
    counted = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"h": taken, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}
    )
    borrowed = F.when(F.col("h") > 0, F.slice("_head", F.lit(1), F.col("h").cast("int")))
    plan = write_and_read(
        counted.join(heads, "base", "left").select(
            "conv_id", "_n", "h", F.coalesce(borrowed, F.array().cast("array<binary>")).alias("head")
        ), "rebuild",
    )
    shift = plan.select("conv_id", "_n", "h", F.size("head").alias("given"))
    later = hot_lookup(own, shift, "conv_id").where(F.col("pos") >= F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("given")).cast("long").alias("pos"), "said"
    )
    first = plan.select("conv_id", F.posexplode("head").alias("pos", "said"))
    turns = later.unionByName(first.withColumn("pos", F.col("pos").cast("long")))
    lengths = plan.select(
        "conv_id", (F.size("head") + F.greatest(F.col("_n") - F.col("h"), F.lit(0))).cast("long").alias("n_turns")
    )
    return write_and_read(turns, "rebuilt"), write_and_read(lengths, "lengths")


def path() -> Column:
    """A node inside its block: the key of the block's row, then the ids of its turns."""
    key = F.unhex(F.lpad(F.hex("key"), 16, "0"))
    return F.concat(key, *[F.coalesce(F.col(t), F.lit(b"")) for t in TURNS])


def parent_of(column: str) -> Column:
    return F.expr(f"substring({column}, 1, length({column}) - {ID_BYTES})")


def rolled(rows: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates of every prefix in a block, with ``d``, the number of its turns there."""
    groups = rows.rollup("key", *TURNS).agg(F.grouping_id().alias("_g"), *aggregates)
    last = F.element_at(F.array(*TURNS), F.greatest(F.col("d"), F.lit(1)))
    return (
        groups.where(F.col("_g") < (1 << WIDTH))
        .withColumn("d", (F.lit(WIDTH) - F.bit_count("_g")).cast("int")).drop("_g")
        .where((F.col("d") == 0) | last.isNotNull())
    )


def _hash_lists(batches):
    """SHA-256 of the comma-joined lists of each path, in constant memory."""
    current, digest = None, None
    for batch in batches:
        paths, sums = [], []
        for at, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if at != current:
                if digest is not None:
                    paths.append(current)
                    sums.append(digest.hexdigest())
                current, digest = at, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(sums, pa.string())], ["path", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([current], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["path", "ends_sha256"]
        )


def end_digests(ending: DataFrame) -> DataFrame:
    """(path, ends_sha256) of the conversations (path, conv_id) that end at each node.

    The ids are gathered into strings of at most 4,096 before they are dealt by node; the strings of
    a node then pass one digest, which is sequential by its nature, and none is kept.
    """
    strings = ending.groupBy("path", F.shiftright("conv_id", BUCKET_BITS).alias("bucket")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    return strings.repartition("path").sortWithinPartitions("path", "bucket").select("path", "ids").mapInArrow(
        _hash_lists, "path binary, ends_sha256 string"
    )


def _descend(turns: DataFrame, lengths: DataFrame, root: int):
    """Blocks of nodes from the root down, and the conversations that end up alone.

    Returns a list of (nodes, ending) and a list of tables (conv_id, n_turns, from).
    """
    front = lengths.withColumn("key", F.lit(root).cast("long"))
    blocks, alone = [], []
    while True:
        low = len(blocks) * WIDTH
        here = turns.where((F.col("pos") >= low) & (F.col("pos") < low + WIDTH)).groupBy("conv_id").agg(
            *[F.max(F.when(F.col("pos") == low + i, F.col("said"))).alias(t) for i, t in enumerate(TURNS)]
        )
        wide = write_and_read(front.join(here, "conv_id", "left"), "trie-rows")
        nodes = rolled(wide, F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
        nodes = write_and_read(nodes if not blocks else nodes.where(F.col("d") > 0), "trie-nodes")
        staying = F.col("n_turns") <= low + WIDTH
        blocks.append((nodes, wide.where(staying).select(path().alias("path"), "conv_id")))
        reached = nodes.where(F.col("d") == WIDTH).select(
            path().alias("path"), F.col("n_convs").alias("_n"), F.col("n_convs").alias("members"),
            F.col("conv_id").alias("key"),
        )
        going = wide.where(~staying).select(path().alias("path"), "conv_id", "n_turns")
        moved = write_and_read(hot_lookup(going, reached, "path").drop("path"), "trie-front")
        alone.append(moved.where(F.col("members") == 1).select(
            "conv_id", "n_turns", F.lit(low + WIDTH).cast("long").alias("from")
        ))
        front = moved.where(F.col("members") > 1).select("conv_id", "n_turns", "key")
        if front.isEmpty():
            return blocks, alone


def _block_result(nodes: DataFrame, ending: DataFrame, low: int, carried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The finished nodes of a block, and (key, children, leaves, saved) for the block above.

    ``carried`` has these sums for the nodes at which the block below starts.
    """
    nodes = nodes.withColumn("path", path())
    children = nodes.where(F.col("d") > 0).groupBy(parent_of("path").alias("path")).agg(F.count(F.lit(1)).alias("inside"))
    below = carried.select(
        F.col("key").alias("conv_id"), F.lit(WIDTH).alias("d"), F.col("children").alias("under"),
        F.col("leaves").alias("under_leaves"), F.col("saved").alias("under_saved"),
    )
    chars = F.when(F.col("d") + low > 0, F.conv(F.hex(F.expr("substring(path, -4, 4)")), 16, 10).cast("long")).otherwise(0)
    valued = write_and_read(
        nodes.join(children, "path", "left").join(below, ["conv_id", "d"], "left").withColumn(
            "n_children", F.coalesce("inside", "under", F.lit(0)).cast("long")
        ).select(
            "key", *TURNS, "d", "path", "conv_id", "n_convs", "n_children",
            (F.coalesce("under_leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long")).alias("leaf"),
            (F.coalesce("under_saved", F.lit(0)) + (F.col("n_convs") - 1) * chars).alias("save"),
        ), "trie-values",
    )
    sums = write_and_read(
        rolled(valued, F.sum("leaf").alias("n_leaves"), F.sum("save").alias("saved_tokens")), "trie-sums"
    ).withColumn("path", path())
    up = sums.where(F.col("d") == 0).select(
        "key", "path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")
    ).join(children.withColumnRenamed("inside", "children"), "path").drop("path")
    parents = valued.where(F.col("n_children") > 0).select(
        F.col("path").alias("_parent"), F.col("n_children").alias("_n"), F.col("conv_id").alias("parent_conv_id")
    )
    row = valued.drop("key", *TURNS, "leaf", "save")
    deep = hot_lookup(row.where(F.col("d") > 1).withColumn("_parent", parent_of("path")), parents, "_parent").drop("_parent")
    top = valued.where(F.col("d") <= 1).withColumn("parent_conv_id", F.when(F.col("d") == 1, F.col("key"))).select(*deep.columns)
    finished = (
        deep.unionByName(top).join(sums.select("path", "n_leaves", "saved_tokens"), "path")
        .join(end_digests(ending), "path", "left")
    )
    return write_and_read(finished.select(
        "conv_id", (F.col("d") + low).cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    ), "trie-result"), write_and_read(up.select("key", "children", "leaves", "saved"), "trie-carried")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations.

    ``conversations`` has conv_id, turn, role, text; other columns are not read. Turns stand by turn,
    null first, those of one number by their digest; repeated rows are turns of their own. A null
    role or text is empty. Rows with a null conv_id name no conversation and are left out. A node is
    named by its smallest member ``conv_id`` and its ``depth``. An empty table has no node.
    Turns are told apart by 128 bits of SHA-256 and their length. Shared nodes are grouped on the map
    side, lookups of nodes with very many members are salted; blocks are needed only as deep as two
    conversations agree.
    """
    turns, lengths = rebuild(conversations)
    root = lengths.agg(F.min("conv_id")).first()[0]
    if root is None:
        return turns.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
            "saved_tokens long, ends_sha256 string",
        )
    blocks, alone = _descend(turns, lengths, root)
    carried = alone[0].limit(0).select(
        F.col("conv_id").alias("key"), *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    )
    results = []
    for number in reversed(range(len(blocks))):
        single = alone[number].select(
            F.col("conv_id").alias("key"), F.lit(1).cast("long").alias("children"),
            F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
        )
        result, carried = _block_result(*blocks[number], number * WIDTH, carried.unionByName(single))
        results.append(result)
    tails = reduce(DataFrame.unionByName, alone).withColumn("_n", F.col("n_turns"))
    last = F.col("pos") + 1 == F.col("n_turns")
    tail = hot_lookup(turns.select("conv_id", "pos"), tails, "conv_id").where(F.col("pos") >= F.col("from")).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    return reduce(DataFrame.unionByName, [*results, tail])
