"""Quality scores from supervised subword embeddings.

A document is the mean of the learned vectors of its words and character n-grams, all hashed into
one table, and a softmax over two classes reads the mean. Vectors and output are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows. As the output is linear,
the trained vectors are folded into one number per bucket, which is all that scoring needs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.batches import mixed_multipliers, pieces
from sitesift.llm.common import extended

BUCKET_BITS = 17
DIMENSION = 16
GRAMS = (2, 3, 4)
ROWS_PER_LABEL = 1000  # labelled rows that the classifier is fitted on, of each label
EPOCHS = 6
RATE = 0.5
THRESHOLD = 0.7
SEED = 17

GRAM_FACTORS = mixed_multipliers(max(GRAMS), 23)
WORD_FACTORS = mixed_multipliers(64, 29)
FINAL = mixed_multipliers(1, 31)[0]


def bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint64(kind)) * FINAL
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * FINAL) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(codes: np.ndarray, starts: np.ndarray, owners: np.ndarray, skip: np.ndarray, stop: np.ndarray):
    """(bucket, owner) of every word and n-gram that begins before ``stop`` in its part.

    Parts lie side by side; what follows ``stop`` is there for the n-grams that reach over it.
    """
    lengths = np.diff(np.r_[starts, len(codes)])
    counts = np.arange(len(codes)) - np.repeat(starts, lengths) < np.repeat(stop, lengths)
    owner = np.repeat(owners, lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # code points to the part's end
    wide = codes.astype(np.uint64)
    total = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        total[: max(0, len(codes) - n + 1)] += wide[n - 1:] * GRAM_FACTORS[n - 1]
        if n in GRAMS:
            inside = np.flatnonzero((left >= n) & counts)
            yield bucket(total[inside], n), owner[inside]
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    first = ~space
    first[1:] &= space[:-1] | (left[:-1] == 1)
    begin = np.flatnonzero(first & counts)
    if len(begin):
        word = np.zeros(len(codes), np.int64)
        word[begin] = begin
        in_word = np.arange(len(codes)) - np.maximum.accumulate(word)
        weighted = np.where(space | ~counts, np.uint64(0), wide * WORD_FACTORS[in_word & 63])
        yield bucket(np.add.reduceat(weighted, begin), 0), owner[begin]


@dataclass
class QualityModel:
    weights: np.ndarray  # log odds of label 1 per bucket
    bias: float


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], prior: float) -> QualityModel:
    """Fit on (label, buckets, counts); ``prior`` is the share of label 1 among all labelled rows."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (1 << BUCKET_BITS, DIMENSION)).astype(np.float32)
    output = np.zeros((2, DIMENSION), np.float32)
    offset = np.zeros(2, np.float32)
    rows = [(label, ids, (n / n.sum()).astype(np.float32)) for label, ids, n in rows if len(ids)]
    steps, done = EPOCHS * len(rows), 0
    share = max(1e-6, np.mean([label for label, _, _ in rows])) if rows else prior
    for _ in range(EPOCHS):
        for at in rng.permutation(len(rows)):
            label, ids, part = rows[at]
            rate = RATE * (1 - done / steps)
            done += 1
            own = vectors[ids]
            mean = part @ own
            logits = output @ mean + offset
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = output.T @ error
            output -= rate * np.outer(error, mean)
            offset -= rate * 0.1 * error
            # scaled so that the document's mean moves by rate, however long the text is
            vectors[ids] = own - (rate / float(part @ part)) * np.outer(part, back)
    odds = output[1] - output[0]
    balance = math.log(prior / (1 - prior)) - math.log(share / max(1e-6, 1 - share))
    return QualityModel((vectors @ odds).astype(np.float32), float(offset[1] - offset[0]) + balance)


def _counted(batches):
    for batch in batches:
        ids, counts = [], []
        for text in batch.column(2).to_pylist():
            total: dict[int, int] = {}
            for part in pieces([text], after=max(GRAMS) - 1, at_space=True):
                found, n = np.unique(np.concatenate([b for b, _ in features(*part)]), return_counts=True)
                for key, count in zip(found.tolist(), n.tolist(), strict=True):
                    total[key] = total.get(key, 0) + count
            ids.append(list(total))
            counts.append([float(n) for n in total.values()])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))],
            ["doc_id", "label", "ids", "counts"],
        )


def fit_quality(
    documents: DataFrame, marks: DataFrame, rows_per_label: int = ROWS_PER_LABEL
) -> QualityModel:
    """Fit on documents (doc_id, text) and marks (doc_id, label); labels but 0 and 1 are left out.

    Of each label the ``rows_per_label`` marks first in hash order that have a document are used,
    with their whole texts; the share of label 1 is counted over all marks. Only ids are shuffled:
    the sample is bounded and goes to the texts. Without a mark of either label the share decides.
    """
    rows = marks.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("label").cast("int").alias("label")
    )
    rows = rows.join(documents.select("doc_id"), "doc_id", "left_semi")
    ones, total = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    prior = ((ones or 0) + 1) / (total + 2)
    sample = None
    for label in (0, 1):
        part = rows.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_label)
        sample = part if sample is None else sample.unionByName(part)
    texts = documents.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    counted = texts.mapInArrow(_counted, "doc_id long, label int, ids array<int>, counts array<float>")
    fitted = sorted(
        ((r["label"], r["doc_id"], np.array(r["ids"], np.int32), np.array(r["counts"], np.float32))
         for r in counted.toArrow().to_pylist()),
        key=lambda r: (r[0], r[1], len(r[2]), r[2].tolist()),
    )
    return train([(label, ids, counts) for label, _, ids, counts in fitted], prior)


def score_texts(model: QualityModel, texts: list[str | None]) -> np.ndarray:
    sums, counts = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for part in pieces(texts, after=max(GRAMS) - 1, at_space=True):
        for buckets, owner in features(*part):
            sums += np.bincount(owner, model.weights[buckets].astype(np.float64), len(texts))
            counts += np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + model.bias, -500, 500)))


def score_quality(documents: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Add score, the probability of label 1. A null or empty text gets what the bias says."""
    rows = documents.drop("score")
    shared = rows.sparkSession.sparkContext.broadcast(model)
    index = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            scores = score_texts(shared.value, batch.column(index).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    return rows.mapInArrow(run, extended(rows, score="double"))


def is_held_out(doc_id: Column) -> Column:
    """Rows that are kept from learning: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document.

    Learns from labelled documents that are not held out; labels, language, source and id are no
    input of a score. Null and empty texts get the score of the bias alone. A null label teaches
    nothing; a document with two labels counts with each. Repeated rows are scored each. Empty
    labels give one score to all; an empty table of documents gives no rows. Other columns are not
    read.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text").withColumn(
        "held_out", is_held_out(F.col("doc_id"))
    )
    marks = labels.select(F.col("doc_id").cast("long"), F.col("quality").alias("label"))
    model = fit_quality(rows.where(~F.col("held_out")).select("doc_id", "text"), marks)
    return score_quality(rows, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
