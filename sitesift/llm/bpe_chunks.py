"""Byte-pair ids of whole texts: content-defined chunks are encoded once, their joins repaired.

A rolling hash over the code points cuts every text, so equal passages give equal chunks wherever
they stand. Documents are dealt by the smallest hash of their chunks, which brings copies and near
copies together; a task encodes a chunk once and reuses its ids in every document that holds it.
The tokenizer splits a text into pieces from left to right and never merges across them. Blanks and
line ends behind a mark start a piece in every split, wherever it began, so the ids of a chunk hold
between its first and its last such place. What lies between two chunks is encoded again, from the
last place of the left one up to the first of the right one, over more chunks while there is none.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.llm.batches import code_points, mixed_multipliers

WINDOW = 16  # code points under the rolling hash
MEAN_CHUNK = 512  # a cut falls on one of so many places
LEAST_CHUNK = 128
MOST_CHUNK = 4096  # a longer stretch without a cut is cut here
PIECE = 1 << 20  # code points hashed at once
KNOWN_CHARS = 1 << 23  # chunks remembered in a task
BATCH_CHARS = 1 << 22
DEALT = "doc_id long, text string, ends array<int>, deal long"
# Fixed value: the split of byte-level byte-pair vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank or line end behind a character that no version of Unicode counts as white space.
SURE = regex.compile("(?<=[!-~¡-ԯ‐-‧‰-⁞、-ゖァ-ヺ一-龥가-힣！-～])[ \n]")


class Vocabulary:
    """A byte-level vocabulary file, its special strings, and an encoder of the text between them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as handle:
            stated = json.load(handle)
        self.special = {}
        for token in stated["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
                raise ValueError(f"added token {token['content']!r} takes part in the text around it")
            self.special[token["content"]] = token["id"]
        merges = [m if isinstance(m, str) else " ".join(m) for m in stated["model"]["merges"]]
        names = {n: i for n, i in stated["model"]["vocab"].items() if n not in self.special}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if (
            stated["normalizer"] is not None or not plain.items() <= stated["pre_tokenizer"].items()
            or any(names[m.replace(" ", "")] != 256 + i for i, m in enumerate(merges)) or len(names) != 256 + len(merges)
        ):
            raise ValueError("only plain byte-level vocabularies numbered in the order of their merges are exact here")
        shown = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in name): number for name, number in names.items()}
        self.encoder = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def segments(self, text: str) -> Iterator[tuple[int, str]]:
        """(id of the special string before it or -1, text) of the parts between special strings."""
        parts = self.cut.split(text) if self.cut else [text]
        yield -1, parts[0]
        for mark, part in zip(parts[1::2], parts[2::2], strict=True):
            yield self.special[mark], part

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode_ordinary(text), np.int32)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(path)


def candidates(codes: np.ndarray) -> np.ndarray:
    """Ends of the windows whose hash calls for a cut behind them."""
    factors = mixed_multipliers(WINDOW, 11).astype(np.uint32)  # odd
    found = []
    for low in range(0, max(len(codes) - WINDOW + 1, 0), PIECE):
        part = codes[low: low + PIECE + WINDOW - 1]
        count = len(part) - WINDOW + 1
        mixed = np.zeros(count, np.uint32)
        for place in range(WINDOW):
            mixed += part[place: place + count] * factors[place]
        mixed ^= mixed >> np.uint32(15)
        mixed *= factors[0]
        found.append(np.flatnonzero(mixed < np.uint32((1 << 32) // MEAN_CHUNK)) + low + WINDOW)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def cuts(text: str) -> list[int]:
    """Where a text is cut, in code points, its end included; none for an empty text."""
    out, last = [], 0
    for place in [*candidates(code_points(text)).tolist(), len(text)]:
        while place - last > MOST_CHUNK:
            last += MOST_CHUNK
            out.append(last)
        if place - last >= LEAST_CHUNK or (place == len(text) and place > last):
            out.append(place)
            last = place
    return out


def _chunked(batches):
    """(doc_id, text, ends of its chunks, the smallest hash of a chunk)."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ends, deals = [], []
        for text in texts:
            places = cuts(text)
            ends.append(places)
            deals.append(min((xxhash.xxh64_intdigest(text[a:b]) for a, b in zip([0, *places], places, strict=False)), default=0))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(ends, pa.list_(pa.int32())),
                pa.array(np.array(deals, np.uint64).view(np.int64)),
            ],
            ["doc_id", "text", "ends", "deal"],
        )


class Encoder:
    """Ids of texts given in chunks. Chunks between special strings are remembered."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.known: dict[str, tuple[int, int, np.ndarray] | None] = {}
        self.known_chars = 0
        self.encoded = 0

    def chunk(self, text: str) -> tuple[int, int, np.ndarray] | None:
        """(first, last, ids): the sure places of a chunk and the ids between them; None without two."""
        if text not in self.known:
            if self.known_chars > KNOWN_CHARS:
                self.known, self.known_chars = {}, 0
            first = SURE.search(text)
            last = max(text.rfind(" "), text.rfind("\n"))
            while last > 0 and not SURE.match(text, last):
                last = max(text.rfind(" ", 0, last), text.rfind("\n", 0, last))
            between = first is not None and last > first.start()
            self.known[text] = (first.start(), last, self.words.ids(text[first.start(): last])) if between else None
            self.known_chars += len(text) + 64
            self.encoded += 1
        return self.known[text]

    def segment(self, chunks: list[str]) -> Iterator[np.ndarray]:
        """Ids of a text without special strings, cut into ``chunks``."""
        open_text: list[str] = []
        for text in chunks:
            found = self.chunk(text)
            if found is None:
                open_text.append(text)
                continue
            first, last, ids = found
            yield self.words.ids("".join(open_text) + text[:first])
            yield ids
            open_text = [text[last:]]
        yield self.words.ids("".join(open_text))

    def document(self, text: str, ends: list[int]) -> np.ndarray:
        """Ids of a whole text. Special strings cut it too, whatever chunks they lie in."""
        parts = [np.zeros(0, np.int32)]
        start = 0
        for mark, segment in self.words.segments(text):
            if mark >= 0:
                parts.append(np.array([mark], np.int32))
                start += len(self.words.tokenizer.id_to_token(mark))
            inside = [e for e in ends if start < e < start + len(segment)] if segment is not text else ends[:-1]
            places = [start, *inside, start + len(segment)]
            parts.extend(self.segment([text[a:b] for a, b in zip(places, places[1:], strict=False)]))
            start += len(segment)
        return np.concatenate(parts)


def _encoded(path: str):
    def encode(batches):
        encoder = Encoder(vocabulary(path))
        docs, found, held = [], [], 0

        def out():
            offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in found])]).astype(np.int32)
            values = pa.array(np.concatenate(found), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"]
            )

        for batch in batches:
            for doc, text, ends in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ends")), strict=True):
                docs.append(doc)
                found.append(encoder.document(text, ends))
                held += len(found[-1]) + 10
                if held > BATCH_CHARS // 4:
                    yield out()
                    docs, found, held = [], [], 0
        if docs:
            yield out()

    return encode


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the byte-pair ids of every whole text, one row per row of ``documents``.

    ``path`` names a byte-level vocabulary file that every executor sees. Special strings in a text
    are their one id and end the pieces around them. A null or empty text has no ids; repeated rows
    and null doc_ids are rows of their own; other columns are not read; an empty table gives no rows.
    Texts move once, to where their smallest chunk hash sends them. Partitions grown large by one
    group of copies are split by AQE's rebalancing, so such a group is encoded once in each part; a
    chunk of documents with different smallest hashes is encoded once in each of their tasks. A
    document is held by one task, as its row is.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.mapInArrow(_chunked, DEALT).hint("rebalance", F.col("deal")).sortWithinPartitions("deal")
    return dealt.mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def decoder(path: str):
    """A function for mapInArrow over (doc_id, ids) that adds ``decoded``, the text of the ids."""

    def decode(batches):
        words = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            # Lists from numpy: Arrow would make a scalar object of every id, at twice the cost of decoding it.
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            texts = [
                words.tokenizer.decode(values[a:b].tolist(), skip_special_tokens=False)
                for a, b in zip(at[:-1], at[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
            )

    return decode


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of the ids."""
    return encoded.select("doc_id", "ids").mapInArrow(decoder(path), "doc_id long, ids array<int>, decoded string")
