"""Benchmark decontamination by spaced seeds.

A mask says which of eight neighbouring words are hashed and which are ignored, so a replaced word
under a zero leaves the seed intact. Seeds of the benchmark are matched with the seeds at every
position of every document; at a hit the two texts are laid side by side, and of the stretches of
words around it the best must agree but for a few replacements. Wherever in a stretch the replaced
words stand, at least one seed is free of them. Items too short for that are matched whole, by a
mask of ones as long as they are.

The documents meet only a sieve of the benchmark's seeds, a bit table of a few words a seed. What
falls through it, the hits and few others, is joined with the seeds themselves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import seal
from sitesift.session import write_and_read

#: Hit every stretch of WINDOW words, and every whole item of SPAN to WINDOW words, with as many
#: replaced words as LEAST_SHARE allows, wherever they stand.
MASKS = ("111011", "11010011", "11001011")
SPAN = 8
WINDOW = 13
LEAST_SHARE = 0.8
BLOCK_SEEDS = 200_000  # items of no more seeds are broadcast
SIEVE_SEEDS = 3_000_000  # seeds of the benchmark in one sieve
SIEVE_WORDS = 2  # 64-bit words of a sieve for each seed, at least; few other hashes fall through
SIEVE_ROW = 4096  # words of a sieve in one of its inner arrays


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")
    return F.split(F.btrim(plain), " ")


def with_windows(frame: DataFrame, words: str, masks: Sequence[str] = MASKS) -> DataFrame:
    """One row per position: the words from there as _w0, _w1, ... and the position _at.

    There are as many as the longest mask has places. Beyond the end the words are null; positions
    are those at which the shortest mask fits.
    """
    least, span = min(map(len, masks)), max(map(len, masks))
    count = F.size(words) - (least - 1)
    columns = [F.slice(words, k + 1, count).alias(f"_w{k}") for k in range(span)]
    at = F.sequence(F.lit(0), count - 1).alias("_at")
    return frame.where(F.size(words) >= least).select("*", F.inline(F.arrays_zip(*columns, at)))


def seed(mask: str) -> Column:
    """Hash of the words that the mask keeps; null where it goes beyond the end."""
    value = F.xxhash64(*[F.col(f"_w{k}") for k, bit in enumerate(mask) if bit == "1"])
    return F.when(F.col(f"_w{len(mask) - 1}").isNotNull(), value)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item, words, ids): distinct word sequences of one word at least, with the ids they stand for."""
    return (
        benchmark.select(F.col("item_id").cast("long"), tokens(F.col("text")).alias("words"))
        .where(F.get("words", F.lit(0)) != "")
        .groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
        .select(F.xxhash64(F.concat_ws(" ", "words")).alias("item"), "words", "ids")
    )


def _seeds(items: DataFrame, masks: Sequence[str], whole: bool) -> DataFrame:
    """(mask, hash, item, _item_at, _item_hashes): a row for each mask that fits at a position of an item.

    ``whole``: for the mask as long as the item alone.
    """
    hashes = [F.when(F.size("words") == len(m), seed(m)) if whole else seed(m) for m in masks]
    return (
        with_windows(items, "words", masks)
        .select("item", F.col("_at").alias("_item_at"), F.array(*hashes).alias("_item_hashes"))
        .select("*", F.posexplode("_item_hashes").alias("mask", "hash")).where(F.col("hash").isNotNull())
    )


def _sieve_place(value: Column, words: int) -> Column:
    """The word of a hash; ``words`` is a power of two."""
    return F.shiftrightunsigned(value, 32).bitwiseAND(F.lit(words - 1))


def _sieve_pattern(value: Column) -> Column:
    """The bits that a hash sets in its word: about a quarter of them, whatever the word."""
    bits = F.xxhash64(value)
    return bits.bitwiseAND(F.shiftleft(bits, 47).bitwiseOR(F.shiftrightunsigned(bits, 17)))


def _sieve(hashes: DataFrame, words: int) -> DataFrame:
    """One row with the bit table _sieve of the column hash: arrays of SIEVE_ROW words."""
    every = hashes.sparkSession.range(words).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("bits"))
    filled = (
        hashes.select(_sieve_place(F.col("hash"), words).alias("place"), _sieve_pattern(F.col("hash")).alias("bits"))
        .unionByName(every).groupBy("place").agg(F.bit_or("bits").alias("bits"))
    )
    rows = filled.groupBy(F.floor(F.col("place") / SIEVE_ROW).alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("place", "bits")))["bits"].alias("bits")
    )
    return rows.agg(F.sort_array(F.collect_list(F.struct("row", "bits")))["bits"].alias("_sieve"))


def _in_sieve(value: Column, words: int) -> Column:
    """Whether the sieve holds a hash: always, if it is one of its own."""
    place, pattern = _sieve_place(value, words).cast("int"), _sieve_pattern(value)
    row = F.get("_sieve", F.shiftright(place, SIEVE_ROW.bit_length() - 1))
    return F.get(row, place.bitwiseAND(F.lit(SIEVE_ROW - 1))).bitwiseAND(pattern) == pattern


def _leaks_of_block(texts: DataFrame, items: DataFrame, masks: Sequence[str], seeds: int, whole: bool) -> DataFrame:
    """Verified overlaps of documents with a block of items that has about so many ``seeds``."""
    own = _seeds(items, masks, whole)
    small = F.broadcast if seeds <= BLOCK_SEEDS else (lambda frame: frame)
    words = 1 << max(0, math.ceil(math.log2(max(1, SIEVE_WORDS * seeds))))
    start = F.greatest(F.lit(0), F.col("_at") - (WINDOW - 1))
    candidates = (
        with_windows(texts, "_words", masks)
        .select("doc_id", "text_key", "_words", "_at", F.array(*map(seed, masks)).alias("_hashes"))
        .select("*", F.posexplode("_hashes").alias("mask", "hash"))
        .join(F.broadcast(_sieve(own, words)), _in_sieve(F.col("hash"), words))
        .select(
            "doc_id", "text_key", "_at", "_hashes", "mask", "hash", start.alias("_start"),
            F.slice("_words", start + 1, F.col("_at") - start + WINDOW).alias("_near"),
        )
    )
    # two places whose words agree under several masks are one hit, that of the first of them
    again = reduce(Column.__or__, [
        (F.col("mask") > n) & F.coalesce(F.get("_hashes", F.lit(n)) == F.get("_item_hashes", F.lit(n)), F.lit(False))
        for n in range(len(masks))
    ])
    hits = candidates.join(small(own), ["mask", "hash"]).where(~again)
    # stretches of the item that hold a word at _item_at, laid beside the document
    length = F.least(F.lit(WINDOW), F.size("words"))
    low = F.greatest(F.lit(0), F.col("_item_at") - (F.col("_length") - 1))
    high = F.least(F.size("words"), F.col("_item_at") + F.col("_length"))
    beside = (
        hits.join(small(items.select("item", "words")), "item").withColumn("_length", length)
        .withColumns({"_low": low, "_high": high, "_shift": F.col("_at") - F.col("_item_at") - F.col("_start")})
    )
    same = F.transform(
        F.sequence(F.col("_low"), F.col("_high") - 1),
        lambda i: F.when(
            (i + F.col("_shift") >= 0) & (F.get("words", i) == F.get("_near", i + F.col("_shift"))), 1
        ).otherwise(0),
    )
    stretches = F.sequence(F.lit(1), F.size("_same") - F.col("_length") + 1)
    matched = F.array_max(F.transform(
        stretches, lambda k: F.aggregate(F.slice("_same", k, F.col("_length")), F.lit(0), lambda n, x: n + x)
    ))
    least = F.when(F.col("_length") < SPAN, F.col("_length")).otherwise(F.ceil(F.col("_length") * LEAST_SHARE))
    return (
        beside.withColumn("_same", same).withColumn("matched", matched)
        .where(F.col("matched") >= least)
        .groupBy("doc_id", "text_key", "item")
        .agg(
            F.max("matched").alias("matched"), F.max("_length").alias("compared"),
            F.count(F.lit(1)).alias("seeds"), F.min("_at").alias("first_word"),
        )
        .join(small(items.select("item", "ids")), "item")
        .select("doc_id", "text_key", "ids", "matched", "compared", "seeds", "first_word")
    )


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, ids, matched, compared, seeds, first_word) of each leak.

    A leak is a stretch of WINDOW words of an item (all, if it has fewer) that stands in a document
    with at least LEAST_SHARE of its words in place; all are found. ``ids`` are the items with these words.
    Items below SPAN words are too short to bear a replaced word: they must stand whole, word for
    word. Null texts and texts without a word match nothing. Documents of one id and one text are
    one; a null id is kept as null. The benchmark is taken in blocks of about SIEVE_SEEDS seeds (or
    short items), one after the other, so what is broadcast is bounded; each block reads the
    documents once. Other columns are not read.
    """
    items = write_and_read(benchmark_items(benchmark), "items")
    short = F.size("words") < SPAN
    sizes = items.agg(
        F.sum(F.when(~short, F.size("words") - (min(map(len, MASKS)) - 1))).alias("seeds"),
        F.count_if(short).alias("short"), F.sort_array(F.collect_set(F.when(short, F.size("words")))).alias("lengths"),
    ).first()
    texts = documents.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"),
        tokens(F.col("text")).alias("_words"),
    )
    kinds = [(items.where(~short), MASKS, sizes["seeds"] or 0, False)]
    if sizes["short"]:
        kinds.append((items.where(short), ["1" * n for n in sizes["lengths"]], sizes["short"], True))
    found = []
    for rows, masks, seeds, whole in kinds:
        blocks = max(1, math.ceil(seeds / SIEVE_SEEDS))
        for block in range(blocks):
            part = rows.where(F.pmod("item", F.lit(blocks)) == block)
            leaks = _leaks_of_block(texts, part, masks, math.ceil(seeds / blocks), whole)
            found.append(write_and_read(leaks, "leaks"))
    return reduce(DataFrame.unionByName, found)


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without those that hold a leak; rows and columns of the others are unchanged."""
    keys = write_and_read(
        find_leaks(documents, benchmark).select(
            F.col("doc_id").alias("_leak_id"), F.col("text_key").alias("_leak_key")
        ).distinct(),
        "leak-keys",
    )
    rows, at, own = seal(documents)
    same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_leak_id")) & (
        F.xxhash64(at["text"]) == F.col("_leak_key")
    )
    return rows.join(keys, same, "left_anti").select(*own)
