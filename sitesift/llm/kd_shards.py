"""K-d tree shards: split at weighted medians of the widest dimension until leaves are small enough.

Every document is a point in a space of metadata (language, source, log size, id). A node that must
become k leaves is cut along the dimension in which its box is widest, at the point that has
floor(k/2)/k of its bytes on the left. The cut is found for all nodes of a level at once, as digits
of a position, each from a histogram of at most 256 sums per node; ties in the dimension are ordered
by a hash of the row's content, so one source with a third of all rows is cut like any other, and
where equal rows still weigh much, two more digits order them by their number in the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.llm.common import numbered, numbered_as_written, seal
from sitesift.session import write_and_read

DIMENSIONS = 4
DIGITS = (40, 32, 24, 16, 8, 0)  # bit offsets of the digits of a 48-bit position
ROW_DIGITS = 16  # below, positions tell apart rows that are equal in everything
FINE = 1024  # and are looked at where equal rows weigh more than such a part of a cut's bytes
ROW_BYTES = 16  # each row's size beside its text


def text_rank(value: Column) -> Column:
    """A number that orders texts by their first six bytes; a null or empty text is 0."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(value, F.lit("")), "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("long")


def with_points(rows: DataFrame, at: dict[str, str]) -> DataFrame:
    """Add size, text_crc32, the point _c and the tie-break _tie."""
    text = F.coalesce(at["text"], F.lit(""))
    return rows.withColumns({
        "size": (F.octet_length(text) + ROW_BYTES).cast("long"),
        "text_crc32": F.crc32(F.encode(text, "UTF-8")),
    }).withColumns({
        "_c": F.array(
            text_rank(F.col(at["lang"])), text_rank(F.col(at["source"])),
            F.floor(F.log2(F.col("size")) * 1024).cast("long"),
            F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(0)),
        ),
        "_tie": F.xxhash64(at["doc_id"], "text_crc32", "size").bitwiseAND(F.lit(0xFFFF)),
        "_row": F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFF)),
    })


def position(low: Column, high: Column, dimension: Column) -> Column:
    """Place within a node's box, 16 bits along its widest dimension, 16 of content, 16 of row number."""
    share = (F.get("_c", dimension) - low) / F.greatest(high - low, F.lit(1))
    return (F.floor(share * 65535).cast("long") * 65536 + F.col("_tie")) * 65536 + F.col("_row")


def lookup(numbers: list, kind: str) -> Column:
    """Numbers by node as one constant array; a node beyond its end has none."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast(f"array<{kind}>")


class Tree:
    """The cuts so far. The root is node 1, the parts of node n are 2n and 2n + 1.

    Its lists have an entry per node, so at most four per shard. They enter a plan as constants:
    no join, no broadcast, and the same generated code at every level.
    """

    def __init__(self, shards: int):
        self.parts = [0, shards]  # shards below each node
        self.first = [0, 0]  # the first of them
        self.dim, self.low, self.high, self.cut = [-1, -1], [0, 0], [0, 0], [0, 0]

    @property
    def depth(self) -> int:
        return len(self.parts).bit_length() - 2

    def open_nodes(self) -> list[int]:
        return [n for n in range(len(self.parts) // 2, len(self.parts)) if self.parts[n] > 1]

    def place(self, node: Column) -> Column:
        dim, low, high = (lookup(x, "bigint") for x in (self.dim, self.low, self.high))
        return position(F.get(low, node), F.get(high, node), F.get(dim, node).cast("int"))

    def node(self) -> Column:
        """The deepest node that a point reaches."""
        if not self.depth:
            return F.lit(1)
        dim, cut = lookup(self.dim, "bigint"), lookup(self.cut, "bigint")

        def step(node: Column, _: Column) -> Column:
            right = (self.place(node) >= F.get(cut, node)).cast("int")
            return F.when(F.get(dim, node) >= 0, node * 2 + right).otherwise(node)

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(1), step)

    def grow(self, cuts: dict[int, int]) -> None:
        """Cut the nodes given and open the next level; nodes without rows stay uncut."""
        for column in (self.parts, self.first, self.dim, self.low, self.high, self.cut):
            column.extend([-1 if column is self.dim else 0] * len(column))
        for n, cut in cuts.items():
            k, self.cut[n] = self.parts[n], cut
            self.parts[2 * n], self.parts[2 * n + 1] = k // 2, k - k // 2
            self.first[2 * n], self.first[2 * n + 1] = self.first[n], self.first[n] + k // 2


def _sides() -> list[Column]:
    return [
        f(F.get("_c", F.lit(d))).alias(f"{name}{d}")
        for d in range(DIMENSIONS) for f, name in ((F.min, "low"), (F.max, "high"))
    ]


def _measure(points: DataFrame, tree: Tree, whole: list[int]) -> dict[int, float]:
    """Set the widest dimension of the open nodes; returns the bytes left of each cut."""
    widths = [
        F.struct(
            ((F.col(f"high{d}") - F.col(f"low{d}")) / F.lit(max(1, whole[d]))).alias("width"),
            F.lit(-d).alias("order"), F.col(f"low{d}").alias("low"), F.col(f"high{d}").alias("high"),
        )
        for d in range(DIMENSIONS)
    ]
    boxes = (
        points.withColumn("node", tree.node())
        .where(F.get(lookup(tree.parts, "int"), F.col("node")) > 1)
        .groupBy("node").agg(*_sides(), F.sum("size").alias("bytes"))
        .withColumn("best", F.array_max(F.array(*widths)))
        .select("node", -F.col("best.order"), "best.low", "best.high", "bytes")
    )
    goals = {}
    for n, dim, low, high, size in boxes.collect():  # one row per node
        tree.dim[n], tree.low[n], tree.high[n] = dim, low, high
        goals[n] = float(size * (tree.parts[n] // 2)) / tree.parts[n]
    return goals


def _cuts(points: DataFrame, reached: Column, tree: Tree, goals: dict[int, float]) -> dict[int, int]:
    """For each node the first position that belongs to its right part."""
    size = len(tree.parts)
    prefix, before, goal = [-1] * size, [0.0] * size, [goals.get(n, 0.0) for n in range(size)]
    for n in goals:
        prefix[n] = 0
    cuts, weight = {}, dict(goals)
    node = F.col("node")
    for shift in DIGITS:
        if shift < ROW_DIGITS:
            for n in goals:
                if weight[n] * FINE <= goals[n]:
                    prefix[n] = -1  # the cut stands
            if max(prefix) < 0:
                break
        upto = F.get(lookup(before, "double"), node) + F.sum("bytes").over(
            Window.partitionBy("node").orderBy("_digit")
        )
        chosen = (
            points.withColumn("node", reached).withColumn("_at", tree.place(node))
            .where(F.shiftright("_at", shift + 8) == F.get(lookup(prefix, "bigint"), node))
            .groupBy("node", F.shiftright("_at", shift).alias("_digit"))
            .agg(F.sum("size").alias("bytes"))
            .withColumn("_upto", upto)
            .where(F.col("_upto") >= F.get(lookup(goal, "double"), node))
            .groupBy("node").agg(F.min_by(F.struct("*"), "_digit").alias("s"))
            .select("s.*").collect()  # one row per node
        )
        for r in chosen:
            n, over = r["node"], r["_upto"] - goal[r["node"]]
            prefix[n], before[n], weight[n] = r["_digit"], r["_upto"] - r["bytes"], r["bytes"]
            cuts[n] = (r["_digit"] + (over <= goal[n] - before[n])) << shift
    return cuts


def grow_tree(points: DataFrame, shards: int) -> Tree:
    """Cut one node, level by level, into ``shards`` leaves of near equal bytes."""
    tree = Tree(shards)
    sides = points.agg(*_sides()).first()
    whole = [(sides[f"high{d}"] or 0) - (sides[f"low{d}"] or 0) for d in range(DIMENSIONS)]
    while tree.open_nodes():
        reached = tree.node()
        goals = _measure(points, tree, whole)
        if not goals:
            break
        tree.grow(_cuts(points, reached, tree, goals))
    return tree


def _written_at() -> list[Column]:
    """Number of the file a row stands in, as one text for its task and part, and its row there."""
    name = F.col("_metadata.file_name")
    task = F.lpad(F.regexp_extract(name, "^part-([0-9]+)", 1), 12, "0")
    part = F.lpad(F.regexp_extract(name, "-c([0-9]+)\\.", 1), 12, "0")
    return [F.concat(task, part).alias("_written_file"), F.col("_metadata.row_index").alias("_written_row")]


def kd_shards(
    documents: DataFrame, shards: int | None = None, target_bytes: int | None = None,
    as_written: bool = False,
) -> DataFrame:
    """Add size, text_crc32, shard and slot to documents.

    Give the number of shards, or the bytes that a leaf may reach, from which the number follows.
    Shards are numbered from 0 in tree order; slots from 0 without gaps. A null text counts as
    empty; null languages, sources and ids lie at 0 of their dimension. Repeated rows are rows of
    their own and are parted by their number in the table, so ``documents`` must be a table that reads
    in the same order every time, as a file or a written table does. With fewer rows than shards some shards stay empty; an empty table stays empty.
    Columns of these four names are replaced; the tree is bounded by one row per shard.

    Slots follow a hash of the rows or, with ``as_written``, the order in which ``documents`` was
    written: a table read from files that stand in the order of their numbers.
    """
    added = ("size", "text_crc32", "shard", "slot")
    if as_written:
        documents = documents.select("*", *_written_at())
    rows, at, own = seal(documents, added)
    own = own[:-2] if as_written else own
    full = with_points(rows, at)
    points = write_and_read(full.select("_c", "_tie", "_row", "size"), "points")
    if shards is None:
        total = points.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    tree = grow_tree(points, shards)
    placed = full.withColumn("shard", F.get(lookup(tree.first, "int"), tree.node()))
    if as_written:
        out = numbered_as_written(placed, "shard", at["_written_file"], at["_written_row"], "slot")
    else:
        out = numbered(placed, "shard", ["_tie", "_row", at["doc_id"], "text_crc32"], "slot")
    return out.select(*own, "size", "text_crc32", "shard", "slot")
