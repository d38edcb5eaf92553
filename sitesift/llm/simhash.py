"""SimHash near-duplicates by a positional byte index with count filtering.

Two 64-bit fingerprints at most 4 bits apart share at least 4 of their 8 bytes in place. A posting
list for each single byte would hold a 256th of all documents, so the index lists byte triples: the
20 triples below are chosen so that any four byte positions contain at least one of them, hence
every pair to be found meets in a list. Inside a list the shared bytes of a pair are tallied, pairs
with fewer than the guaranteed four are dropped, and the others are verified bit by bit.

Equal fingerprints are one entry, so a text copied a million times is one posting. A list emits
links that connect what is connected, never all its pairs: a found document leaves the search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import extended, hot_lookup, seal
from sitesift.operators.groups import connected_components
from sitesift.session import write_and_read

SHINGLE_WORDS = 4
SEED = 42
BITS = 4
BYTES = 8
SHORT_RUN = 24
BLOCK = 1 << 16


def index_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions so that every four positions hold one.

    Positions lie in three rings; a triple is taken inside a ring, or as two of a ring and one of
    the next. Any four positions put three in one ring, or two in a ring whose successor is met.
    """
    rings = [(0, 1, 2), (3, 4, 5), (6, 7)]
    triples = [r for r in rings if len(r) == 3]
    for i, ring in enumerate(rings):
        follower = rings[(i + 1) % 3]
        triples += [(a, b, c) for k, a in enumerate(ring) for b in ring[k + 1:] for c in follower]
    return triples


def fingerprint(text: bytes, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a text, repeats counted; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(words_in_shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(
            starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True
        )),
        np.uint64, len(words) - width + 1,
    )
    votes = np.zeros(64, np.int64)
    for low in range(0, len(hashes), BLOCK):
        part = hashes[low: low + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def add_fingerprints(rows: DataFrame, text: str) -> DataFrame:
    """Add fp, the fingerprint of a text as a signed long; a null text counts as empty."""
    index = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(index).cast(pa.large_binary())
            values = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values.view(np.int64))], [*batch.schema.names, "fp"]
            )

    return rows.mapInArrow(run, extended(rows, fp="long"))


def shares_enough(differing: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Pairs, given as xor, that share the guaranteed number of bytes and are near enough."""
    shared = (differing.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    passed = shared >= BYTES - bits
    passed[passed] = np.bitwise_count(differing[passed]) <= bits
    return passed


def links_in_run(run: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a long posting list connects: breadth first, found entries leave."""
    rest, left, right = run, [], []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = shares_enough(rest ^ at, bits)
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at))
                right.append(found)
                frontier.extend(found)
                rest = rest[~near]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def links_in_lists(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the posting lists of arrays sorted by key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    for start, length in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN], strict=True):
        a, b = links_in_run(prints[start: start + length])
        left.append(a)
        right.append(b)
    short = np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths)
    keys, prints = keys[short], prints[short]
    for step in range(1, min(SHORT_RUN, len(keys))):
        pairs = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(pairs):
            break
        a, b = prints[pairs], prints[pairs + step]
        near = shares_enough(a ^ b)
        left.append(a[near])
        right.append(b[near])
    empty = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _scan_lists(batches):
    """Links of a partition sorted by key; a list that goes on in the next batch is carried over."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(k, p):
        a, b = links_in_lists(k, p)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))],
            ["a", "b"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        more = batch.column(0).to_numpy(zero_copy_only=False)
        keys = np.concatenate([keys, more])
        prints = np.concatenate(
            [prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        )
        done = int(np.searchsorted(keys, keys[-1]))
        if done:
            yield links(keys[:done], prints[:done])
            keys, prints = keys[done:], prints[done:]
    if len(keys):
        yield links(keys, prints)


def byte_at(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255))


def posting_rows(prints: DataFrame) -> DataFrame:
    """(key, fp) per distinct fingerprint and byte triple; the key holds the triple's number."""
    fp = F.col("fp")
    keys = [
        F.lit(n << 24)
        + F.shiftleft(byte_at(fp, a), 16) + F.shiftleft(byte_at(fp, b), 8) + byte_at(fp, c)
        for n, (a, b, c) in enumerate(index_triples())
    ]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs at most BITS apart."""
    return (
        posting_rows(prints).repartition("key").sortWithinPartitions("key")
        .mapInArrow(_scan_lists, "a long, b long").distinct()
    )


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def component_roots(rows: DataFrame) -> DataFrame:
    """(fp, root, _n) per distinct fingerprint of a written table; ``_n`` counts its rows."""
    prints = write_and_read(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("_n")), "distinct-fingerprints")
    edges = write_and_read(near_links(prints.select("fp")), "links")
    roots = connected_components(
        edges.select(fingerprint_hex(F.col("a")).alias("a"), fingerprint_hex(F.col("b")).alias("b"))
    )
    linked = prints.withColumn("node", fingerprint_hex(F.col("fp"))).join(roots, "node", "left")
    return write_and_read(linked.select("fp", F.coalesce("root", "node").alias("root"), "_n"), "roots")


def with_class(rows: DataFrame, first: Column) -> DataFrame:
    """Add ``first``, the smallest value of that expression over all rows linked to a row.

    Values are first reduced per fingerprint, so a copied text is one row from there on.
    """
    roots = component_roots(rows)
    lows = rows.groupBy("fp").agg(F.min(first).alias("_low"))
    classes = write_and_read(roots.join(lows, "fp"), "classes")
    best = classes.groupBy("root").agg(F.min("_low").alias("first"), F.count(F.lit(1)).alias("_n"))
    named = hot_lookup(classes.select("fp", "root", F.col("_n").alias("_copies")), best, "root")
    named = write_and_read(named.select("fp", "first", F.col("_copies").alias("_n")), "named-classes")
    return hot_lookup(rows, named, "fp")


def simhash_components(documents: DataFrame) -> DataFrame:
    """One row per document: (doc_id, fp, fingerprint, component_id).

    ``component_id`` is the smallest doc_id that links of at most BITS bits reach, itself included.
    Null or wordless texts have fingerprint zero and link like any other; null ids never name a
    component (null only if no member has an id). Repeated rows stay, one output row each. An
    empty table gives no rows; other columns are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    rows = write_and_read(add_fingerprints(rows, "text").select("doc_id", "fp"), "fingerprints")
    return with_class(rows, F.col("doc_id")).select(
        "doc_id", "fp", fingerprint_hex(F.col("fp")).alias("fingerprint"),
        F.col("first").alias("component_id"),
    )


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """Documents with one row left of each component: that with the smallest doc_id.

    Rows without an id stand after all others; among rows of one id any one stays. All columns are
    returned as they are. Nulls, empty texts and tables as in ``simhash_components``.
    """
    rows, at, own = seal(documents)
    rows = add_fingerprints(rows.withColumn("_text", F.col(at["text"]).cast("string")), "_text")
    rows = write_and_read(
        rows.drop("_text").withColumn("_row", F.monotonically_increasing_id()), "fingerprints"
    )
    doc_id = F.col(at["doc_id"]).cast("long")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), F.col("_row").alias("row"))
    narrow = rows.select("fp", "_row", order.alias("_rank"))
    kept = with_class(narrow.select("fp", "_row", "_rank"), F.col("_rank")).where(
        F.col("first.row") == F.col("_row")
    ).select("_row")
    return rows.join(kept, "_row", "left_semi").select(*own)
