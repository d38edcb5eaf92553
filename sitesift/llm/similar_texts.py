"""Near copies by text: SimHash of a byte-position index, then an exact check of word shingles.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of at least
0.8. The SimHash of the five-word shingles of such a pair differs in up to 10 of 64 bits, too many
for a byte index. A replaced word breaks two of the two-word shingles but five of the five-word ones,
so the index holds fingerprints of two-word shingles, where the pair differs in about 6 bits, and
three of them, made of independent bits of the same shingle hashes.

Each fingerprint is listed under the 20 byte triples of ``simhash.index_triples``. Of a pair in a
list the equal bytes are tallied; three must be equal and at most 10 bits differ. A pair with up to
14 differing bits of the 192 has a fingerprint with at most 4, hence four equal bytes, so it is sure
to meet in a list. The shingle sets of the pairs that are left decide. A list of more than SHORT_RUN texts is
searched breadth first, smallest first, so that a group gives links that connect it, not its pairs.
There a text leaves the search with its first link, before the exact check, so a link that the check
refuses may stand where another would hold. Hence a second search after the check (``late_links``):
the texts of all groups that a refused link lies between are searched again, by the shingles
themselves, and no similar pair of them is missed.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesift.llm.batches import mixed_multipliers
from sitesift.llm.common import extended, hot_lookup, seal
from sitesift.llm.simhash import BLOCK, SEED, byte_at, index_triples
from sitesift.operators.groups import connected_components
from sitesift.session import write_and_read

SHINGLE_WORDS = 5
SIMILARITY = 0.8
PRINTS = 3
PRINT_WORDS = 2
BITS = 10
EQUAL_BYTES = 3
SHORT_RUN = 8
SKETCH_LONGS = 16
SKETCH = [f"k{n}" for n in range(SKETCH_LONGS)]
FACTORS = mixed_multipliers(PRINTS, SEED)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words; a shorter text is one run, one without a word none."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    count = len(words) - width + 1
    spans = zip(starts[:count].tolist(), ends[width - 1:].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, count)


def mixed(hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
    """Other 64 bits of a hash."""
    out = (hashes ^ (hashes >> np.uint64(31))) * factor
    out = (out ^ (out >> np.uint64(29))) * FACTORS[0]
    return out ^ (out >> np.uint64(32))


def text_prints(words: list[bytes]) -> list[int]:
    """The fingerprints of a text as signed longs; zeros without a word."""
    hashes = shingle_hashes(words, PRINT_WORDS)
    out = []
    for factor in FACTORS:
        votes = np.zeros(64, np.int64)
        for low in range(0, len(hashes), BLOCK):
            part = mixed(hashes[low: low + BLOCK], factor).astype(">u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * votes > len(hashes)).tobytes()
        out.append(int.from_bytes(bits, "big", signed=True))
    return out


def add_prints(rows: DataFrame, text: str) -> DataFrame:
    """Add words_id, the XXH128 of a text's lower-cased words, and its fingerprints f0, f1, f2."""
    index = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            ids, prints = [], []
            for value in batch.column(index).cast(pa.large_binary()):
                words = (value.as_py() or b"").lower().split()
                ids.append(xxhash.xxh3_128_digest(b" ".join(words), SEED))
                prints.append(text_prints(words))
            columns = np.array(prints, np.int64).reshape(-1, PRINTS).T
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.binary()), *map(pa.array, columns)],
                [*batch.schema.names, "words_id", *(f"f{n}" for n in range(PRINTS))],
            )

    prints = {f"f{n}": "long" for n in range(PRINTS)}
    return rows.mapInArrow(run, extended(rows, words_id="binary", **prints))


def near(differing: np.ndarray) -> np.ndarray:
    """Fingerprint pairs, given as xor, with enough equal bytes and few enough differing bits."""
    equal = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (equal >= EQUAL_BYTES) & (np.bitwise_count(differing) <= BITS)


def links_in_list(nodes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one list in the order of its nodes: all near pairs, or what connects a long list."""
    left, right = [], []
    if len(nodes) <= SHORT_RUN:
        a, b = np.triu_indices(len(nodes), 1)
        kept = near(prints[a] ^ prints[b])
        return nodes[a[kept]], nodes[b[kept]]
    rest = np.arange(len(nodes))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            found = near(prints[rest] ^ prints[at])
            if found.any():
                left.append(np.full(int(found.sum()), nodes[at]))
                right.append(nodes[rest[found]])
                frontier.extend(rest[found])
                rest = rest[~found]
    empty = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _scan_lists(batches):
    """Links of a partition sorted by key and node; the last list of a batch waits for the next."""
    held: list[tuple[np.ndarray, ...]] = []

    def finished(parts):
        keys, nodes, prints = (np.concatenate(c) for c in zip(*parts, strict=True))
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if high - low > 1:
                a, b = links_in_list(nodes[low:high], prints[low:high])
                left.append(a)
                right.append(b)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        prints = prints.view(np.uint64)
        done = int(np.searchsorted(keys, keys[-1]))
        if held and (done or held[-1][0][-1] != keys[-1]):
            held.append((keys[:done], nodes[:done], prints[:done]))
            yield finished(held)
            held = []
        elif done:
            yield finished([(keys[:done], nodes[:done], prints[:done])])
        held.append((keys[done:], nodes[done:], prints[done:]))
    if held:
        yield finished(held)


def candidate_links(texts: DataFrame) -> DataFrame:
    """Distinct links (a, b), a < b, of texts (node, f0, f1, f2) that are near in a fingerprint: all
    of a short list, those that connect a long one."""
    triples = index_triples()
    postings = F.explode(F.array(*(
        F.struct(
            (F.lit((n * len(triples) + k) << 24) + F.shiftleft(byte_at(F.col(f"f{n}"), a), 16)
             + F.shiftleft(byte_at(F.col(f"f{n}"), b), 8) + byte_at(F.col(f"f{n}"), c)).alias("key"),
            F.col(f"f{n}").alias("print"),
        )
        for n in range(PRINTS) for k, (a, b, c) in enumerate(triples)
    )))
    rows = texts.select("node", postings.alias("p")).select("p.key", "node", "p.print")
    return (
        rows.repartition("key").sortWithinPartitions("key", "node")
        .mapInArrow(_scan_lists, "a long, b long").distinct()
    )


def shingle_sets(rows: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of rows (node, text): distinct hashes of their word shingles."""
    def run(batches):
        for batch in batches:
            sets = [
                np.unique(shingle_hashes((t.as_py() or b"").lower().split(), width)).view(np.int64)
                for t in batch.column(1).cast(pa.large_binary())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"]
            )

    return rows.mapInArrow(run, "node long, shingles array<long>")


def set_sketch(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * SKETCH_LONGS classes of hashes the parity of how many a set holds, as longs.

    Two sets differ in at least as many hashes as their sketches in bits."""
    classes = (hashes % np.uint64(64 * SKETCH_LONGS)).astype(np.int64)
    odd = np.bincount(classes, minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_sketches(sets: DataFrame) -> DataFrame:
    """(node, k0, k1, ...) of rows (node, shingles)."""
    names = ["node", *SKETCH]

    def run(batches):
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            hashes = batch.column(1).flatten().to_numpy().view(np.uint64)
            sketches = np.empty((batch.num_rows, SKETCH_LONGS), np.int64)
            for row, (low, high) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                sketches[row] = set_sketch(hashes[low:high])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sketches.T)], names)

    return sets.select("node", "shingles").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def verified(links: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links whose shingle sets are at least that similar. ``texts`` is (node, text).

    A text with very many links is repeated over several tasks instead of gathering them in one.
    """
    lefts, rights = (links.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("_n")) for c in ("a", "b"))
    used = write_and_read(lefts.unionByName(rights).groupBy("node").agg(F.sum("_n").alias("_n")), "linked-texts")
    sets = write_and_read(
        shingle_sets(texts.join(used, "node", "left_semi").select("node", "text"), width), "shingle-sets"
    ).join(used, "node")
    one = hot_lookup(links, sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"), "_n"), "a")
    both = hot_lookup(one, sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"), "_n"), "b")
    common = F.size(F.array_intersect("_sa", "_sb"))
    total = F.size("_sa") + F.size("_sb") - common
    return both.where(common >= F.lit(float(similarity)) * total).select("a", "b")


def late_links(
    texts: DataFrame, grouped: DataFrame, tried: DataFrame, held: DataFrame, width: int, similarity: float
) -> DataFrame:
    """Links (a, b) not yet tried that may reach the similarity, between groups.

    ``texts`` is (node, text), ``grouped`` (node, root), ``tried`` the links of the first search and
    ``held`` those of them that passed the check, which made the groups. The near pairs of a list are
    connected by tried links; if the groups of a pair differ, one of these links leaves each of the
    two groups. So only texts of groups at such links are searched, here without fingerprints.

    Of two sets at least that similar, each has a share of ``similarity`` in the other. If all sets are
    sorted in one order, both hold a common shingle among their first n - ceil(similarity * n) + 1. The
    order is by how many of the searched texts hold a shingle, so texts that differ by words of their
    own do not meet. Of those that meet in a shingle the largest group is not compared with itself,
    and a pair whose sketches show that it differs in too many shingles is no link: the links of a large
    group of texts just below the similarity would else grow with the square of its size.
    """
    between = (
        tried.join(held, ["a", "b"], "left_anti")
        .join(grouped.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a")
        .join(grouped.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b")
        .where(F.col("_ra") != F.col("_rb"))
    )
    open_roots = between.select("_ra", "_rb").distinct().select(F.explode(F.array("_ra", "_rb")).alias("root")).distinct()
    searched = write_and_read(
        grouped.select("node", "root").join(open_roots, "root", "left_semi"), "searched-again"
    )
    sets = write_and_read(
        shingle_sets(texts.join(searched, "node", "left_semi").select("node", "text"), width), "searched-sets"
    ).join(searched, "node")
    rows = sets.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_texts")).where(F.col("_texts") > 1)
    # Shingles of one text come first in the order; only how many they are matters.
    shared = rows.join(counts, "key")
    order = Window.partitionBy("node").orderBy("_texts", "key")
    own = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    first = F.floor(F.col("n") * (1.0 - similarity) + 1e-6) + 1
    heads = write_and_read(
        shared.withColumns({"_at": F.row_number().over(order), "_own": own})
        .withColumn("at", F.col("_own") + F.col("_at")).where(F.col("at") <= first)
        .select("key", "node", "root", "n", "at"),
        "first-shingles",
    )
    main = write_and_read(
        heads.groupBy("key", "root").agg(F.count(F.lit(1)).alias("_texts"))
        .groupBy("key").agg(F.max_by("root", F.struct("_texts", "root")).alias("_main"), F.count(F.lit(1)).alias("_groups"))
        .where(F.col("_groups") > 1).select("key", "_main"),
        "mixed-shingles",
    )
    mixed_heads = write_and_read(heads.join(main, "key").join(set_sketches(sets), "node"), "mixed-heads")
    others = mixed_heads.where(F.col("root") != F.col("_main")).select(
        "key", *(F.col(c).alias(f"_{c}") for c in ["node", "root", "n", "at", *SKETCH])
    )
    # After the first shingle that both hold, each must still have room for as many as they need.
    room = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at")) + 1
    both = F.col("n") + F.col("_n")
    differing = reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in SKETCH])
    enough = (room >= F.lit(similarity / (1.0 + similarity)) * both - 1e-6) & (
        differing <= F.lit((1.0 - similarity) / (1.0 + similarity)) * both + 1e-6
    )
    pairs = mixed_heads.drop("_main").join(others, "key").where((F.col("root") != F.col("_root")) & enough)
    ends = F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")
    return pairs.select(*ends).distinct().join(tried, ["a", "b"], "left_anti")


def node_text(node: Column | str) -> Column:
    return F.lpad(F.hex(node), 16, "0")


def with_roots(texts: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``root``, the same for all texts that links (a, b) connect."""
    roots = connected_components(links.select(node_text("a").alias("a"), node_text("b").alias("b")))
    joined = texts.withColumn("_node", node_text("node")).join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    return joined.withColumn("root", F.coalesce("root", "_node")).drop("_node")


def keep_one_of_similar(
    documents: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """Documents with one row left of each group of near copies: that with the smallest doc_id.

    Texts of equal lower-cased (A-Z) words are copies; null, empty and blank texts are copies of
    each other, and a text of fewer than ``words`` words is near to its copies only. Other texts are
    linked if the sets of their ``words``-word shingles, told apart by 64 bits, have a Jaccard
    similarity of at least ``similarity``; groups are what links connect. The search finds a pair
    with the chance that its fingerprints give (see the module; measured in the README), the check
    is exact, so rows below the similarity never link. Rows without an id stand after all others;
    among rows of one id any one stays. All columns are returned as they are; others than doc_id
    and text are not read. An empty table gives no rows.
    """
    rows, at, own = seal(documents)
    rows = add_prints(rows.withColumn("_text", F.col(at["text"]).cast("string")), "_text")
    rows = write_and_read(
        rows.drop("_text").withColumn("_row", F.monotonically_increasing_id()), "text-prints"
    )
    doc_id = F.col(at["doc_id"]).cast("long")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("_row").alias("row"))
    prints = [f"f{n}" for n in range(PRINTS)]
    texts = write_and_read(
        rows.groupBy("words_id").agg(F.min(F.struct(order.alias("rank"), *prints)).alias("t"))
        .select(F.col("t.rank.row").alias("node"), "t.rank", *(f"t.{p}" for p in prints)),
        "distinct-texts",
    )
    tried = write_and_read(candidate_links(texts), "candidate-links")
    spelled = rows.select(F.col("_row").alias("node"), F.col(at["text"]).cast("string").alias("text"))
    held = write_and_read(verified(tried, spelled, words, similarity), "near-copies")
    grouped = write_and_read(with_roots(texts, held), "text-groups")
    late = write_and_read(late_links(spelled, grouped, tried, held, words, similarity), "late-links")
    more = write_and_read(verified(late, spelled, words, similarity), "late-copies")
    if not more.isEmpty():
        grouped = with_roots(texts, held.unionByName(more))
    kept = grouped.groupBy("root").agg(F.min("rank").alias("first")).select(F.col("first.row").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*own)
