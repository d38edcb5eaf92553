"""Language identification with interpolated Kneser-Ney character models.

Text is reduced to lower-case letters and single spaces. For each language the counts of all
four-letter sequences of its documents give an interpolated Kneser-Ney model: the highest order
uses counts, the lower ones the number of different letters that can stand before a sequence. All
probabilities are stored beside sorted arrays of sequence hashes. Every counted sequence is kept: a
large model is cut into blocks by the two middle letters, and a block at a time is in memory. A document gets the language of
the lowest cross-entropy per letter; one that no model explains better than half way to letters
drawn one by one, measured from where the training documents of the language end, is rejected.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.batches import mixed_multipliers, pieces
from sitesift.llm.common import extended, seal
from sitesift.session import write_and_read

ORDER = 4
MODEL_CELLS = 8_000_000  # probabilities of the highest order that are held at once, over all languages
HELD_COUNTS = 2_000_000  # distinct sequences a counting task holds before it passes them on
SURE_LETTERS = 20  # shorter texts are not rejected for their entropy
CALIBRATED = 0.999
SHARPNESS = 10.0  # nats per letter to odds, for the score
UNKNOWN = "und"
SPACE = 32

FACTORS = mixed_multipliers(ORDER, 11)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _letters:
        table = np.full(0x110000, SPACE, np.uint32)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                table[point] = ord(char.lower()[0])
        _letters.append(table)
    return _letters[0]


def context(text: str, place: int) -> int:
    """Code points before a place that hold the letters on which what follows depends."""
    length = 16 * ORDER
    while length < place and sum(map(str.isalpha, text[place - length: place])) < ORDER:
        length *= 2
    return min(length, place)


def padded(codes: np.ndarray, starts: np.ndarray, owners: np.ndarray, skip: np.ndarray, stop: np.ndarray):
    """(letters with ORDER - 1 spaces before each part, positions to score, owner of each).

    The first ``skip`` code points of a part are context only.
    """
    plain = letters()[codes]
    is_letter = plain != SPACE
    before = np.empty_like(is_letter)
    before[1:] = is_letter[:-1]
    before[starts] = False
    keep = is_letter | before
    kept_before = np.cumsum(keep) - keep
    part = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))[keep]
    out = np.insert(plain[keep], np.repeat(kept_before[starts], ORDER - 1), SPACE)
    positions = np.arange(len(part)) + (part + 1) * (ORDER - 1)
    if skip.any():
        own = np.flatnonzero(keep) - starts[part] >= skip[part]
        positions, part = positions[own], part[own]
    return out, positions, owners[part]


def window(values: np.ndarray, positions: np.ndarray, length: int, shift: int = 0) -> np.ndarray:
    """Hash of the ``length`` letters that end ``shift`` before each position."""
    total = np.zeros(len(positions), np.uint64)
    for k in range(length):
        total += values[positions - shift - k].astype(np.uint64) * FACTORS[k]
    return total


# --- counting ------------------------------------------------------------------------


def piece_counts(values: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, count) of the ORDER letters that end at each position."""
    alphabet, ids = np.unique(values, return_inverse=True)
    if len(alphabet) > 1 << 16:  # does not fit four to a word: count the halves
        middle = len(positions) // 2
        halves = [piece_counts(values[part[0] - ORDER + 1: part[-1] + 1], part - part[0] + ORDER - 1)
                  for part in (positions[:middle], positions[middle:])]
        return np.concatenate([g for g, _ in halves]), np.concatenate([n for _, n in halves])
    ids = ids.astype(np.uint64)
    packed = np.zeros(len(positions), np.uint64)
    for k in range(ORDER - 1, -1, -1):
        packed = packed << np.uint64(16) | ids[positions - k]
    packed.sort()
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    points = np.stack(
        [alphabet[(packed[first] >> np.uint64(16 * k)) & np.uint64(0xFFFF)] for k in range(ORDER - 1, -1, -1)],
        axis=1,
    ).astype(np.uint32)
    grams = np.ascontiguousarray(points).view(f"<U{ORDER}").ravel()
    return grams, np.diff(np.r_[first, len(packed)])


def _counts(batches):
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out():
        for lang, parts in held.items():
            grams = np.concatenate([g for g, _ in parts])
            counts = np.concatenate([n for _, n in parts])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams)), pa.array(grams.tolist(), pa.string()), pa.array(counts)],
                ["lang", "gram", "n"],
            )

    for batch in batches:
        frame = batch.to_pandas()
        for lang, part in frame.groupby("lang"):
            for parts in pieces(part["text"].tolist(), before=context):
                values, positions, _ = padded(*parts)
                if not len(positions):
                    continue
                grams, counts = piece_counts(values, positions)
                held.setdefault(lang, []).append((grams, counts))
                size += len(grams)
                if size > HELD_COUNTS // 4:
                    held, size = _merged(held)
                    if size > HELD_COUNTS:
                        yield from out()
                        held, size = {}, 0
    held, size = _merged(held)
    yield from out()


def _merged(held):
    size, merged = 0, {}
    for lang, parts in held.items():
        total = pd.Series(np.concatenate([n for _, n in parts])).groupby(
            np.concatenate([g for g, _ in parts]).astype(object)
        ).sum()
        merged[lang] = [(total.index.to_numpy(), total.to_numpy())]
        size += len(total)
    return merged, size


def gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over whole texts of all rows of (lang, text) with a language."""
    return (
        training.where(F.col("lang").isNotNull()).select("lang", "text")
        .mapInArrow(_counts, "lang string, gram string, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )


# --- model ---------------------------------------------------------------------------


@dataclass
class Table:
    """Values beside sorted hashes, with a directory by the leading bits."""

    hashes: np.ndarray
    values: np.ndarray
    shift: int = field(init=False)
    directory: np.ndarray = field(init=False)

    def __post_init__(self):
        bits = max(1, min(20, int(len(self.hashes)).bit_length()))
        self.shift = 64 - bits
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(self.shift)
        self.directory = np.r_[np.searchsorted(self.hashes, edges), len(self.hashes)].astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where there is none."""
        bucket = (wanted >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.directory[bucket], self.directory[bucket + 1]
        out = np.full(len(wanted), -1, np.int32)
        open_rows = np.flatnonzero(at < end)
        at, end = at[open_rows], end[open_rows]
        while len(open_rows):
            hit = self.hashes[at] == wanted[open_rows]
            out[open_rows[hit]] = at[hit]
            go_on = ~hit & (at + 1 < end)
            open_rows, at, end = open_rows[go_on], at[go_on] + 1, end[go_on]
        return out


@dataclass
class LanguageModel:
    langs: list[str]
    grams: list[Table]  # of order 1 to ORDER: log probabilities per language
    contexts: list[Table]  # of order 2 to ORDER: log weights of the lower order
    unseen: np.ndarray  # log probability of an unseen letter

    def log_probabilities(self, values, positions, order: int = ORDER) -> np.ndarray:
        """One row per position and one column per language."""
        rows = self.grams[order - 1].find(window(values, positions, order))
        out = self.grams[order - 1].values[rows]
        missed = np.flatnonzero(rows < 0)
        if len(missed):
            if order == 1:
                out[missed] = self.unseen
            else:
                at = positions[missed]
                found = self.contexts[order - 2].find(window(values, at, order - 1, 1))
                weight = self.contexts[order - 2].values[found]
                weight[found < 0] = 0
                out[missed] = weight + self.log_probabilities(values, at, order - 1)
        return out


def _hash_columns(points: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points), np.uint64)
    for k in range(points.shape[1]):
        total += points[:, points.shape[1] - 1 - k].astype(np.uint64) * FACTORS[k]
    return total


def build_model(levels: list[pd.DataFrame], discounts: pd.DataFrame, langs: list[str], size: int) -> LanguageModel:
    """Interpolated Kneser-Ney, all languages side by side.

    ``levels`` has the (lang, gram, n) rows of order 1 to ORDER, those of the two highest for the
    middle letters of one block; ``discounts`` has a row per order and a column per language.
    """
    number = {lang: i for i, lang in enumerate(langs)}
    lower = np.full((1, len(langs)), 1.0 / size)
    grams, contexts, unseen = [], [], None
    for order, level in enumerate(levels, 1):
        points = np.array(level["gram"].tolist(), f"<U{order}").view(np.uint32).reshape(-1, order)
        lang, weight = level["lang"].map(number).to_numpy(np.int64), level["n"].to_numpy(np.float64)
        hashes, first, row = np.unique(_hash_columns(points), return_index=True, return_inverse=True)
        heads, _, head = np.unique(_hash_columns(points[:, :-1]), return_index=True, return_inverse=True)
        count = np.zeros((len(hashes), len(langs)))
        np.add.at(count, (row, lang), weight)
        total = np.zeros((len(heads), len(langs)))
        types = np.zeros((len(heads), len(langs)))
        np.add.at(total, (head, lang), weight)
        np.add.at(types, (head, lang), 1.0)
        discount = discounts.loc[order, langs].to_numpy(np.float64)
        share = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        of_head = head[first]
        if order == 1:
            below = np.repeat(lower, len(hashes), axis=0)
            unseen = np.log(share[0] * lower[0])
        else:
            below = lower_table.values_of(_hash_columns(points[first][:, 1:]))
            contexts.append(Table(heads, np.log(share).astype(np.float32)))
        probability = np.maximum(count - discount, 0) / np.maximum(total[of_head], 1) + share[of_head] * below
        lower_table = _Lower(hashes, probability)
        grams.append(Table(hashes, np.log(probability).astype(np.float32)))
    return LanguageModel(langs, grams, contexts, unseen.astype(np.float32))


@dataclass
class LanguageModels:
    langs: list[str]
    blocks: list[Broadcast]  # of a LanguageModel each
    chance: dict[str, float]  # entropy of each language's own letters, drawn one by one

    def loaded(self):
        """(number, model) of each block; of several, one at a time is in memory."""
        for number, block in enumerate(self.blocks):
            yield number, block.value
            if len(self.blocks) > 1 and getattr(block, "_path", None):
                del block._value


@dataclass
class _Lower:
    hashes: np.ndarray
    probability: np.ndarray

    def values_of(self, wanted: np.ndarray) -> np.ndarray:
        return self.probability[np.searchsorted(self.hashes, wanted)]


def middle_block(gram: Column, blocks: int) -> Column:
    """Block of a sequence of one of the two highest orders, by the two letters before its last."""
    middle = F.substring(gram, -3, 2)
    return F.pmod(F.crc32(F.encode(middle, "UTF-8")), F.lit(blocks)).cast("int")


def blocks_of(values: np.ndarray, positions: np.ndarray, blocks: int) -> np.ndarray:
    """``middle_block`` of the sequences that end at each position."""
    pairs = values[positions - 2].astype(np.uint64) << np.uint64(32) | values[positions - 1]
    known, row = np.unique(pairs, return_inverse=True)
    letter = (chr(int(p) >> 32) + chr(int(p) & 0xFFFFFFFF) for p in known)
    return np.fromiter((zlib.crc32(x.encode()) % blocks for x in letter), np.int64, len(known))[row]


def continuation_levels(counts: DataFrame) -> list[DataFrame]:
    """(lang, gram, n) of order 1 to ORDER; below the highest, n letters stand before a sequence."""
    levels = [counts.select("lang", "gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        lower = levels[0].groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(
            F.count(F.lit(1)).alias("n")
        )
        levels.insert(0, write_and_read(lower, f"grams-{order}"))
    return levels


def level_discounts(levels: list[DataFrame]) -> pd.DataFrame:
    """Kneser-Ney discounts: a row per order, a column per language."""
    found = None
    for order, level in enumerate(levels, 1):
        part = level.groupBy(F.lit(order).alias("order"), "lang").agg(
            F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")
        )
        found = part if found is None else found.unionByName(part)
    rows = found.toPandas()  # ORDER rows per language
    estimate = rows["once"] / np.maximum(rows["once"] + 2 * rows["twice"], 1)
    rows["discount"] = np.where(rows["once"] > 0, estimate, 0.75).clip(0.1, 0.95)
    return rows.pivot(index="order", columns="lang", values="discount")


def letter_entropies(counts: DataFrame) -> dict[str, float]:
    """Entropy per letter of each language's letters by their own frequency.

    A letter that is rare in a language, or only in another one, moves it by next to nothing.
    """
    letter = counts.groupBy("lang", F.substring("gram", ORDER, 1).alias("letter")).agg(F.sum("n").alias("n"))
    n, total = F.col("n"), F.sum("n")
    found = letter.groupBy("lang").agg((F.log(total) - F.sum(n * F.log(n)) / total).alias("entropy"))
    return {r["lang"]: r["entropy"] for r in found.collect()}  # a row per language


def fit_language_models(training: DataFrame, model_cells: int = MODEL_CELLS) -> LanguageModels | None:
    """A model from (lang, text) rows, as broadcast blocks; None without any letter.

    All sequences of all rows are in it. What the driver and a task hold is bounded: a model of more
    than ``model_cells`` probabilities of the highest order is built and read block by block, which
    changes no result. The orders 1 and 2 are in every block.
    """
    counts = write_and_read(gram_counts(training), "gram-counts")
    grams, cells = counts.agg(F.count_distinct("gram"), F.count_distinct("lang")).first()
    if not cells:
        return None
    blocks = math.ceil(grams * cells / model_cells)
    levels = continuation_levels(counts)
    discounts = level_discounts(levels)
    langs = sorted(discounts.columns)
    low = [_ordered(level) for level in levels[:-2]]
    size = len(set(low[0]["gram"]) | {" "}) + 1
    out = []
    for block in range(blocks):
        high = [_ordered(level.where(middle_block(F.col("gram"), blocks) == block)) for level in levels[-2:]]
        out.append(training.sparkSession.sparkContext.broadcast(build_model([*low, *high], discounts, langs, size)))
    return LanguageModels(langs, out, letter_entropies(counts))


def _ordered(level: DataFrame) -> pd.DataFrame:
    return level.toPandas().sort_values(["lang", "gram"], ignore_index=True)


# --- scoring -------------------------------------------------------------------------


def score_texts(models: LanguageModels, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per letter for each text and language, number of letters scored)."""
    sums = np.zeros((len(texts), len(models.langs)))
    counts = np.zeros(len(texts), np.int64)
    blocks = len(models.blocks)

    def parts():
        for part in pieces(texts, before=context):
            values, positions, owner = padded(*part)
            yield values, positions, owner, blocks_of(values, positions, blocks) if blocks > 1 else None

    ready = list(parts()) if blocks > 1 else parts()
    for number, model in models.loaded():
        for values, positions, owner, of_block in ready:
            if blocks > 1:
                positions, owner = positions[of_block == number], owner[of_block == number]
            if not len(positions):
                continue
            logs = model.log_probabilities(values, positions)
            edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            np.add.at(sums, owner[edge], np.add.reduceat(logs.astype(np.float64), edge, axis=0))
            counts += np.bincount(owner, minlength=len(texts))
    return -sums / np.maximum(counts, 1)[:, None], counts


def add_scores(documents: DataFrame, models: LanguageModels | None, text: str) -> DataFrame:
    """Add lang_pred, score, entropy and n_letters; ``und`` without a letter or a model."""
    schema = extended(documents, lang_pred="string", score="double", entropy="double", n_letters="long")
    index = documents.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(index).to_pylist()
            if models is None:
                entropy, counts = np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64)
            else:
                entropy, counts = score_texts(models, texts)
            best = entropy.argmin(axis=1)
            lowest = entropy[np.arange(len(texts)), best]
            odds = np.exp(np.clip((lowest[:, None] - entropy) * SHARPNESS, -700, 0)).sum(axis=1)
            seen = counts > 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns,
                 pa.array([models.langs[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)], pa.string()),
                 pa.array(np.where(seen, 1 / odds, 0.0)), pa.array(lowest, mask=~seen), pa.array(counts)],
                [*batch.schema.names, "lang_pred", "score", "entropy", "n_letters"],
            )

    return documents.mapInArrow(run, schema)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that are kept from learning: crc32 of the id as text is a multiple of ``folds``."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == 0


def entropy_limits(scored: DataFrame, chance: dict[str, float]) -> DataFrame:
    """(lang_pred, limit) from the rows that were learned from.

    The limit lies half way between the entropy that all but a thousandth of a language's training
    documents stay below, and that of the same language's letters drawn one by one. Other languages
    and their letters have no part in it.
    """
    of_lang = F.lit(None).cast("double")
    for lang, value in sorted(chance.items()):
        of_lang = F.when(F.col("lang_pred") == lang, value).otherwise(of_lang)
    top = F.percentile_approx("entropy", CALIBRATED, 10_000)
    learned = ~F.col("held_out") & (F.col("lang") == F.col("lang_pred"))
    return scored.where((F.col("n_letters") >= SURE_LETTERS) & learned).groupBy("lang_pred").agg(top.alias("top")).select(
        "lang_pred", (F.col("top") + F.greatest((of_lang - F.col("top")) / 2, F.lit(0.0))).alias("limit")
    )


def identify_languages(
    documents: DataFrame, folds: int = 5, model_cells: int = MODEL_CELLS
) -> DataFrame:
    """Add held_out, lang_pred, score, entropy, n_letters and rejected to documents.

    Learns from rows with a language that are not held out; language, source and id are not used
    for a prediction. A null text, or one without a letter, is ``und`` with score 0 and rejected; so
    is every text if nothing could be learned. Texts of fewer than SURE_LETTERS letters are not
    rejected for their entropy. Repeated rows are rows of their own. Columns of these names are
    replaced; an empty table stays empty. Long texts are read in parts that carry the letters before
    them, so they score as whole ones.
    """
    rows, model = _learned(documents, folds, model_cells)
    scored = write_and_read(add_scores(rows, model, "text"), "languages")
    return _judged(scored, entropy_limits(scored, model.chance if model else {}))


ADDED = ("held_out", "lang_pred", "score", "entropy", "n_letters", "rejected")


def _learned(documents: DataFrame, folds: int, model_cells: int):
    rows = documents.select(*[c for c in documents.columns if c not in ADDED])
    rows = rows.withColumn("held_out", is_held_out(F.col("doc_id"), folds))
    return rows, fit_language_models(rows.where(~F.col("held_out")).select("lang", "text"), model_cells)


def _judged(scored: DataFrame, limits: DataFrame) -> DataFrame:
    limit = F.lit(None).cast("double")
    for lang, value in sorted((r["lang_pred"], r["limit"]) for r in limits.collect()):  # a row per language
        limit = F.when(F.col("lang_pred") == lang, value).otherwise(limit)
    too_high = (F.col("n_letters") >= SURE_LETTERS) & (F.col("entropy") > limit)
    return scored.withColumn("rejected", (F.col("lang_pred") == UNKNOWN) | F.coalesce(too_high, F.lit(False)))


def keep_identified(documents: DataFrame, folds: int = 5, model_cells: int = MODEL_CELLS) -> DataFrame:
    """Documents that ``identify_languages`` does not reject, with their own columns.

    Scores are computed once to set the limits and once more beside the whole rows: no copy of the
    texts is written.
    """
    sealed, at, own = seal(documents)
    named = sealed.withColumnsRenamed({at[c]: c for c in ("doc_id", "text", "lang")})
    rows, model = _learned(named, folds, model_cells)
    narrow = add_scores(rows.select("held_out", "lang", "text"), model, "text").drop("text")
    limits = entropy_limits(write_and_read(narrow, "entropies"), model.chance if model else {})
    kept = _judged(add_scores(rows, model, "text"), limits).where(~F.col("rejected"))
    return kept.withColumnsRenamed({c: at[c] for c in ("doc_id", "text", "lang")}).select(*own)
