"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Every text becomes counts of hashed terms: words, and triples of bytes in which letters are only upper or
lower case and digits are digits (the look of a text). Log counts, weighted by rarity and brought to length
one, are projected on the leading singular vectors of a sample of labelled documents. A document's score
is the share of label 1 among its ``neighbours`` nearest labelled vectors, weighted by cosine.

Only the sample is bounded (``sample`` labelled rows, in the order of a hash of their id); its vectors are
broadcast (``sample`` x ``rank`` numbers). Every document is compared with all of them, in exact blocked
products, by its whole text.

Rows of any kind: a null or empty text has no terms, its vector is zero and its score the share of label 1
in the sample; labels of null are not learnt; a document labelled twice is learnt twice; without any label
all scores are 0.5; equal similarities go to the earlier row of the sample; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from facetry.llm.words import U64, cut, mix, text_bytes

LOOK_TERMS = 1024
WORD_TERMS = 512
TERMS = LOOK_TERMS + WORD_TERMS
SAMPLE = 3000
RANK = 48
NEIGHBOURS = 25
THRESHOLD = 0.3

_BATCH_BYTES = 4_000_000
#: Bytes whose terms are counted at a time; hashing takes some fifty times as many.
_PART_BYTES = 1_000_000
_BLOCK = 512

_LOOK = np.arange(256, dtype=np.uint8)
_LOOK[ord("a") : ord("z") + 1] = ord("a")
_LOOK[ord("A") : ord("Z") + 1] = ord("A")
_LOOK[ord("0") : ord("9") + 1] = ord("0")
_LOOK[0x80:] = 0x80


def slices(column: pa.Array, limit: int = _BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``limit`` bytes together; a longer text has a range of its own."""
    _, bounds = text_bytes(column)
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + limit, "right")) - 1)
        yield begin, end
        begin = end


def term_counts(column: pa.Array) -> np.ndarray:
    """Log counts of hashed terms of each text, one row per text."""
    data, bounds = text_bytes(column)
    n = len(bounds) - 1
    counts = np.zeros((n, TERMS), np.float32)
    look = _LOOK[data].astype(np.uint64)
    if len(look) >= 3:
        triple = mix((look[:-2] << U64(16)) | (look[1:-1] << U64(8)) | look[2:]) % U64(LOOK_TERMS)
    else:
        triple = np.zeros(0, np.uint64)
    triple = triple.astype(np.int64)
    words = cut(column, lower=True)
    first = words.first
    term = (words.hash % U64(WORD_TERMS)).astype(np.int64)
    for i in range(n):
        if bounds[i + 1] - bounds[i] >= 3:
            counts[i, :LOOK_TERMS] = np.bincount(triple[bounds[i] : bounds[i + 1] - 2], minlength=LOOK_TERMS)
        if first[i + 1] > first[i]:
            counts[i, LOOK_TERMS:] = np.bincount(term[first[i] : first[i + 1]], minlength=WORD_TERMS)
    return np.log1p(counts)


@dataclass
class LatentModel:
    """Weights of terms, the projection, and the sample's vectors with their labels."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(counts * self.weight) @ self.basis)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest vectors, in blocks of rows."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        out = np.empty(len(counts))
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(counts), _BLOCK):
            near = self.project(counts[i : i + _BLOCK]) @ self.vectors.T
            # The place in the sample breaks ties.
            order = np.argpartition(-near.astype(np.float64) + np.arange(near.shape[1]) * 1e-12, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(near, order, 1), 0, None).astype(np.float64) ** 4
            total = weight.sum(1)
            vote = (weight * self.labels[order]).sum(1) / np.where(total > 0, total, 1)
            out[i : i + _BLOCK] = np.where(total > 0, vote, self.labels.mean())
        return np.clip(out, 0, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def held_out(folds: int = 5):
    """Whether a document's label is kept for testing: crc32 of its id as text, modulo ``folds``, is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """Columns doc_id, text and label of at most ``sample`` labelled rows, in the order of a hash of the id."""
    # The sample's ids are chosen first: texts are fetched for them only.
    chosen = (
        labels.select("doc_id", F.col(label).cast("double").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # bounded: ``sample`` rows of two numbers


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, rank: int = RANK) -> LatentModel:
    """Learn from a bounded sample of labelled rows that are not held out."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"], _PART_BYTES):
                part = batch.slice(a, b - a)
                rows = [row.astype(np.float16).tobytes() for row in term_counts(part["text"])]
                yield pa.record_batch([part["doc_id"], part["label"], pa.array(rows, pa.binary())], ["doc_id", "label", "x"])

    got = (
        labelled_sample(docs, labels, label, sample)
        .mapInArrow(features, "doc_id bigint, label double, x binary")
        .toPandas()
        .sort_values(["doc_id", "label", "x"])
    )
    if not len(got):
        none = np.zeros((0, 1), np.float32)
        return LatentModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), none, np.zeros(0), NEIGHBOURS)
    counts = np.stack([np.frombuffer(x, np.float16) for x in got["x"]]).astype(np.float32)
    weight = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    rows = _unit(counts * weight)
    _, vectors = np.linalg.eigh((rows.T @ rows).astype(np.float64))
    basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank]).astype(np.float32)
    return LatentModel(weight, basis, _unit(rows @ basis), got["label"].to_numpy(), NEIGHBOURS)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (0 or 1) of every document."""
    scored = score_rows(docs.select("doc_id", "text"), labels, sample)
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def score_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` with a column ``score`` (in the place of any other of that name)."""
    docs = docs.drop("score")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample=sample))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = slices(batch["text"], _PART_BYTES)
            got = [model.value.scores(term_counts(batch["text"].slice(a, b - a))) for a, b in parts]
            column = pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())
            yield batch.append_column("score", column)

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(score, schema)
