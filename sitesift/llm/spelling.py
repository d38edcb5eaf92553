"""Spelling variants: words one code point apart, found through pairs of trie nodes.

The prefixes of all words are the nodes of a trie, their suffixes those of a second one. Nodes get
numbers, and a word is, at each of its places, a pair (prefix node, suffix node): with the place
skipped, and whole. Two words that skip a place and meet in a pair differ there by a replacement; one
that skips a place and meets a whole word has one code point more. Equal pairs of numbers are equal
strings, so the neighbours are exact, and a pair holds one word per letter of the alphabet at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sitesift.operators.skew import skewed_lookup
from sitesift.session import write_and_read

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGED = 97  # one of so many runs of a document loses a code point
LEAST_LENGTH, LEAST_COUNT = 5, 3
RATIO = 2  # a form is at least so many times as frequent
BATCH_NODES = 1 << 20


def document_words(documents: DataFrame) -> DataFrame:
    """(word, n) of the letter runs of all whole texts, lower-cased in A-Z, one in 97 damaged.

    A null text has none; a null doc_id counts as empty text in the run's checksum.
    """
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"),
    )
    ascii_only = F.length("run") == F.octet_length("run")
    low = runs.withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    checked = low.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.expr("left(run, int(h % length(run)))"), F.substr("run", place + 2))
    return checked.select(F.when(F.col("h") % DAMAGED == 0, damaged).otherwise(F.col("run")).alias("word")).groupBy(
        "word"
    ).agg(F.count(F.lit(1)).alias("n"))


def shared(left: str, right: str) -> int:
    """Length of the common prefix."""
    if right.startswith(left):
        return len(left)
    return next(i for i, (a, b) in enumerate(zip(left + "\0", right + "\1", strict=False)) if a != b)


@F.arrow_udf(IntegerType())
def _shared(left: pa.Array, right: pa.Array) -> pa.Array:
    pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
    return pa.array([shared(a or "", b or "") for a, b in pairs], pa.int32())


def border_steps(borders: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int]]]:
    """For each part, which border first has the prefixes that its first word shares with the part before.

    ``borders`` has (part, code points shared with the part before, shared by the whole part) in
    order. The result is a list of (depth, border): nodes down to that depth belong to that border.
    """
    steps, before, out = [], 0, {}
    for part, joint, whole in borders:
        reach = min(before, joint, steps[-1][0] if steps else 0)  # prefixes that come from an earlier border
        kept = [(min(depth, reach), owner) for depth, owner in steps]
        steps = [s for i, s in enumerate(kept) if s[0] > (kept[i - 1][0] if i else 0)]
        if joint > reach:
            steps.append((joint, part))
        out[part] = steps
        before = whole
    return out


def _node(steps: list[tuple[int, int]], depth: int) -> int:
    owner = next(part for reach, part in steps if depth <= reach)
    return -((owner << 32) | depth)


def _numbered_nodes(batches):
    """Node numbers of every prefix of sorted words; a row without id opens a part."""
    ids, sides, counts, nodes, fresh = [], [], [], [], []
    held = 0

    def out():
        lists = []
        for parts, kind in ((nodes, pa.int64()), (fresh, pa.bool_())):
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for p in parts for x in p], kind)))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sides, pa.string()), pa.array(counts, pa.int64()), *lists],
            ["id", "side", "n", "nodes", "fresh"],
        )

    part, before, after, ahead, stack, last, count = 0, [], [], "", [], "", 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["id"] is None:
                part, ahead = row["part"], row["path"]
                before, after = ([(s["depth"], s["part"]) for s in row[c]] for c in ("before", "after"))
                stack, last, count = [], "", 0
                continue
            word = row["path"]
            same, next_part = shared(last, word), shared(word, ahead)
            first = before[-1][0] if before and not last else 0
            stack = stack[:same]
            for depth in range(same + 1, len(word) + 1):
                if depth <= first:
                    stack.append(_node(before, depth))
                elif depth <= next_part:
                    stack.append(_node(after, depth))
                else:
                    stack.append((part << 40) | count)
                    count += 1
            last = word
            ids.append(row["id"])
            sides.append(word[0])
            counts.append(row["n"])
            nodes.append(stack)
            fresh.append([True, *(a != b for a, b in zip(word[2:], word[1:], strict=False))] if word[0] == "f" else [])
            held += len(word)
            if held > BATCH_NODES:
                yield out()
                ids, sides, counts, nodes, fresh, held = [], [], [], [], [], 0
    if ids:
        yield out()


def trie_nodes(words: DataFrame) -> DataFrame:
    """(id, n, prefixes, suffixes, fresh) of words (id, word, n).

    ``prefixes[i]`` numbers the node of the first i code points, ``suffixes[i]`` that of the last i;
    ``fresh[i]`` says that code point i differs from the one before it. Both tries are numbered as
    one, over words led by their side: the words are sorted into ranges, and each adds the nodes
    beyond what it shares with the word before it. A node that reaches over the border of two ranges
    is named by its first border. The driver sees two numbers for each range.
    """
    spark = words.sparkSession
    sides = words.select("id", "n", F.explode(F.array(
        F.concat(F.lit("f"), "word"), F.concat(F.lit("r"), F.reverse("word"))
    )).alias("path"))
    ranged = write_and_read(
        sides.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "spelling-sides"
    )
    ends = ranged.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = F.row_number().over(Window.orderBy("part")) - 1  # one row per range
    lined = write_and_read(ends.withColumn("place", order), "spelling-ends")
    previous = lined.select((F.col("place") + 1).alias("place"), F.col("last").alias("end"))
    joints = write_and_read(
        lined.join(previous, "place", "left").select(
            "part", "place", "first", _shared(F.coalesce("end", F.lit("")), "first").alias("joint"),
            _shared("first", "last").alias("whole"),
        ), "spelling-joints",
    )
    borders = [(r["place"] + 1, r["joint"], r["whole"]) for r in joints.drop("first").orderBy("place").collect()]
    steps = border_steps(borders)
    kind = "place int, before array<struct<depth:int,part:int>>, after array<struct<depth:int,part:int>>"
    rows = [(p - 1, steps[p], steps.get(p + 1, [])) for p, _, _ in borders]
    ahead = joints.select((F.col("place") - 1).alias("place"), F.expr("left(first, joint)").alias("path"))
    openings = joints.select("place", "part").join(spark.createDataFrame(rows, kind), "place").join(
        ahead, "place", "left"
    ).select(
        "part", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("n"),
        F.coalesce("path", F.lit("")).alias("path"), "before", "after",
    )
    nothing = F.lit(None).cast("array<struct<depth:int,part:int>>")
    stream = ranged.select("part", "id", "n", "path", nothing.alias("before"), nothing.alias("after")).unionByName(openings)
    opened = stream.withColumn("_word", F.col("id").isNotNull())
    numbered = opened.repartition("part").sortWithinPartitions("part", "_word", "path").drop("_word").mapInArrow(
        _numbered_nodes, "id long, side string, n long, nodes array<long>, fresh array<boolean>"
    )

    def side(name: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(column)))

    return numbered.groupBy("id").agg(
        F.max("n").alias("n"), side("f", "nodes").alias("prefixes"), side("r", "nodes").alias("suffixes"),
        side("f", "fresh").alias("fresh"),
    )


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): the number of near words, and struct(n, rank) of the largest, rank = -id.

    Rows of a pair are one per letter at most, and each row learns the sums of its pair; no two words
    are put side by side. A word with a doubled letter skips it at its first place only, so that the
    word without it is met once.
    """
    size = F.size("prefixes")
    at = F.col("i")
    whole = F.struct(
        F.get("prefixes", at).alias("p"), F.get("suffixes", size - 1 - at).alias("s"), F.lit(True).alias("whole"),
        F.lit(False).alias("fresh"),
    )
    skip = F.struct(
        F.get("prefixes", at).alias("p"), F.get("suffixes", size - 2 - at).alias("s"), F.lit(False).alias("whole"),
        F.get("fresh", at).alias("fresh"),
    )
    places = trie_nodes(words).select("id", "n", "prefixes", "suffixes", "fresh", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
    pairs = places.select(
        "n", (-F.col("id")).alias("rank"), F.explode(F.array_compact(F.array(whole, F.when(at < size - 1, skip)))).alias("x")
    )
    groups = pairs.groupBy("x.p", "x.s").agg(
        F.collect_list(F.struct("n", "rank", "x.whole", "x.fresh")).alias("m")
    ).where(F.size("m") > 1)

    def ranked(members: Column) -> Column:
        return F.transform(members, lambda m: F.struct(m["n"].alias("n"), m["rank"].alias("rank")))

    skipped = F.filter("m", lambda m: ~m["whole"])
    spelled = groups.select(
        "m", F.size(skipped).alias("skips"), F.sort_array(ranked(skipped), asc=False).alias("top"),
        ranked(F.filter("m", lambda m: m["whole"])).alias("short"),
        ranked(F.filter("m", lambda m: m["fresh"])).alias("long"),
    ).select(
        "skips", F.get("top", F.lit(0)).alias("top"), F.get("top", F.lit(1)).alias("second"),
        F.get("short", F.lit(0)).alias("short"), F.size("long").alias("longs"), F.array_max("long").alias("long"),
        F.explode("m").alias("w"),
    )
    me = F.struct(F.col("w.n").alias("n"), F.col("w.rank").alias("rank"))
    drops = F.col("w.fresh") & F.col("short").isNotNull()
    other = F.when(F.col("top") == me, F.col("second")).otherwise(F.col("top"))
    best = F.array_max(F.array_compact(F.array(other, F.when(drops, F.col("short")))))
    near = spelled.select(
        (-F.col("w.rank")).alias("id"),
        F.when(F.col("w.whole"), F.col("longs")).otherwise(F.col("skips") - 1 + drops.cast("int")).alias("near"),
        F.when(F.col("w.whole"), F.col("long")).otherwise(best).alias("best"),
    )
    return near.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): the last word that following the forms leads to.

    Each round doubles the steps taken. A form is at least twice as frequent as its word, so chains
    are shorter than 64 and six rounds are enough; lookups of a root of very many words are salted.
    """
    pointers = write_and_read(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = pointers.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        moved = write_and_read(skewed_lookup(pointers, further, "root", "left"), "spelling-roots")
        if moved.where(F.col("_next").isNotNull()).isEmpty():
            return pointers
        pointers = moved.select("id", F.coalesce("_next", "root").alias("root"))


def spelling_variants(counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``counts`` (word, n), each word once.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its most
    frequent near word, ties by the smaller one, if that is at least twice as frequent; its root is
    where forms lead. Shorter and rarer words are left out; null words too. No words give no rows.
    Words may be of any length: a place costs two numbers, never a string.
    """
    kept = counts.select("word", "n").where((F.length("word") >= least_length) & (F.col("n") >= least_count))
    sorted_words = write_and_read(kept, "spelling-counts").repartitionByRange("word").sortWithinPartitions("word")
    words = write_and_read(sorted_words.withColumn("id", F.monotonically_increasing_id()), "spelling-words")
    near = words.join(neighbours(words), "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= RATIO * F.col("n"), F.col("best")).alias("best"),
    )
    found = write_and_read(near.select(
        "id", "word", "n", "n_near", (-F.col("best.rank")).alias("form"), F.col("best.n").alias("form_n")
    ), "spelling-near")
    names = found.select(F.col("id").alias("root"), F.col("word").alias("_root"))
    led = skewed_lookup(roots(found.where(F.col("form").isNotNull())), names, "root").select("id", "_root")
    forms = found.select(F.col("id").alias("form"), F.col("word").alias("_form"))
    return found.join(led, "id", "left").join(forms, "form", "left").select(
        "word", F.col("_form").alias("form"), F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n"
    )
