"""Character n-grams and the 32-bit FNV-1a hash.

``fnv1a32`` and ``char_ngrams`` are plain column expressions. ``hashed_buckets`` does both for a
whole Arrow batch at once with NumPy: every start position of every text is hashed in the same
array operation, and the hash of a 4- or 5-gram extends that of the 3-gram.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sitesift.constants import FNV_OFFSET, FNV_PRIME, HASH_DIM, MASK32, NGRAM_MAX, NGRAM_MIN
from sitesift.functions.normalize import fold_text
from sitesift.functions.urls import let, text


def fnv1a32(value: Column) -> Column:
    data = F.encode(value, "UTF-8")
    octets = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1))), lambda i: i <= F.octet_length(data)),
        lambda i: F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("long"),
    )
    return F.aggregate(
        octets,
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(
            F.lit(MASK32).cast("long")
        ),
    )


def char_ngrams(namespace: str, value: Column) -> Column:
    """array<string> of '<namespace>:<gram>' for gram sizes 3, 4, 5, repeats kept."""

    def grams(folded: Column, size: int) -> Column:
        starts = F.length(folded) - (size - 1)
        return F.when(starts < 1, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(starts, F.lit(1))),
                lambda i: F.concat(F.lit(namespace.lower() + ":"), F.substr(folded, i, F.lit(size))),
            )
        )

    return let(
        fold_text(text(value)),
        lambda folded: F.concat(*[grams(folded, n) for n in range(NGRAM_MIN, NGRAM_MAX + 1)]),
    )


BLOCK_CHARS = 1 << 17  # characters hashed at once; each takes about 100 bytes while it is


def _start_value(namespace: str) -> np.uint32:
    h = FNV_OFFSET
    for octet in f"{namespace}:".encode():
        h = ((h ^ octet) * FNV_PRIME) & MASK32
    return np.uint32(h)


def _mix(h: np.ndarray, octet: np.ndarray) -> np.ndarray:
    return (h ^ octet) * np.uint32(FNV_PRIME)


def _mix_code_point(h: np.ndarray, cp: np.ndarray, ascii_only: bool) -> np.ndarray:
    """Feed the UTF-8 bytes of each code point."""
    if ascii_only:
        return _mix(h, cp)
    width = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], dtype=np.uint32)[width]
    out = _mix(h, lead | (cp >> (6 * (width - 1)).astype(np.uint32)))
    for k in (3, 2, 1):
        more = width > k
        tail = np.uint32(0x80) | ((cp >> np.uint32(6 * (k - 1))) & np.uint32(0x3F))
        out = np.where(more, _mix(out, tail), out)
    return out


def _fold(value) -> str:
    if value is None:
        return ""
    return value.lower() if value.isascii() else unicodedata.normalize("NFKC", value).lower()


def _batch_keys(values: list, namespace: str, dim: int) -> np.ndarray:
    """Sorted-key form row * dim + bucket for every n-gram of the batch."""
    folded = [_fold(v) for v in values]
    lengths = np.fromiter((len(f) for f in folded), dtype=np.int64, count=len(folded))
    codes = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(folded), dtype=np.int64), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    ascii_only = bool(len(codes) == 0 or codes.max() < 0x80)
    padded = np.concatenate([codes, np.zeros(NGRAM_MAX, dtype=np.uint32)])
    h = np.full(len(codes), _start_value(namespace), dtype=np.uint32)
    found = []
    for step in range(NGRAM_MAX):
        h = _mix_code_point(h, padded[step : step + len(codes)], ascii_only)
        if step + 1 >= NGRAM_MIN:
            fits = left >= step + 1
            found.append(rows[fits] * dim + (h[fits] % np.uint32(dim)).astype(np.int64))
    return np.concatenate(found)


def _blocks(urls: list, titles: list) -> list[tuple[int, int]]:
    """Ranges of rows of at most BLOCK_CHARS characters, or of one row."""
    ends, held = [], 0
    for at, (url, title) in enumerate(zip(urls, titles, strict=True)):
        size = len(url or "") + len(title or "")
        if held and held + size > BLOCK_CHARS:
            ends.append(at)
            held = 0
        held += size
    edges = [0, *ends, len(urls)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def bucket_lists(urls: list, titles: list, dim: int) -> pa.Array:
    """Distinct buckets per row, ascending; URL and title share the bucket space.

    A batch is hashed block by block, so that what a task holds beside the buckets does not grow with
    the rows of a batch.
    """
    counts, buckets = [np.zeros(1, np.int64)], [np.empty(0, np.int32)]
    for low, high in _blocks(urls, titles):
        keys = np.unique(np.concatenate(
            [_batch_keys(urls[low:high], "url", dim), _batch_keys(titles[low:high], "title", dim)]
        ))
        counts.append(np.bincount(keys // dim, minlength=high - low))
        buckets.append((keys % dim).astype(np.int32))
    offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(buckets)))


def hashed_buckets(url: Column, title: Column, dim: int = HASH_DIM) -> Column:
    @F.arrow_udf(ArrayType(IntegerType()))
    def buckets(urls: pa.Array, titles: pa.Array) -> pa.Array:
        return bucket_lists(urls.to_pylist(), titles.to_pylist(), dim)

    return buckets(text(url), text(title))
