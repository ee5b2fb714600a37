"""Brown class-based bigrams: exchange clustering of words, class transitions and word emissions.

Documents are encoded once: each batch of texts becomes one row with its different words and the sequence of
their numbers, written to the shared folder, so no later pass reads texts or depends on how they were dealt.

1. Words are counted over all training documents.
2. The ``FREQUENT`` most frequent words are clustered by exchange: from the counts of their neighbours, every
   word finds the class in which the likelihood of all class bigrams grows most, given where all others are;
   half of the words (by turns) move in each of ``ROUNDS`` rounds, in parallel tasks that each go on from their
   own moves.
3. Every other word takes the class that most of its places vote for: a place votes for the class that fits best
   between the classes of its neighbours.
4. Class transitions are counted over all training documents. The probability of a word is
   ``SHARE`` * P(class | class before) * P(word | class) + (1 - SHARE) * P(word), where P(word) is the add-half
   unigram. Words without training counts have the second part only; so all words and one unknown sum to one.

Rows of any kind: null and empty texts have one token, their end; a null doc_id is learnt from and not held out;
rows that share a doc_id are scored one by one; equal counts are ordered by the words' hashes; without training
text every token has the base score and the score less what the missing classes take; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm import exchange
from facetry.llm.components import stored
from facetry.llm.quality import slices
from facetry.llm.words import U64, cut

FREQUENT = 4000
CLASSES = 64
ROUNDS = 6
SHARE = 0.9
TASKS = 4
#: Two classes beyond those of the exchange: the end of a text, and words outside of the exchange.
END, RARE = CLASSES, CLASSES + 1
ALL = CLASSES + 2

_PART_BYTES = 500_000
#: Bytes of a hash that are sent besides its leading 16 bits.
_LOW = 6
MESSAGES = "bucket int, chunk bigint, body binary"
ENCODED = "chunk bigint, doc_ids array<bigint>, held array<boolean>, sizes array<int>, tokens binary, words binary"


def held_out(folds: int = 5):
    """Whether a document is not learnt from: crc32 of its id as text, modulo ``folds``, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 1, F.lit(False))


def encode(docs: DataFrame) -> DataFrame:
    """One row per batch of texts: ids, fold, number of words, numbers of the words, and their sorted hashes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                # Hashed a little at a time: what stays is one number per word.
                hashes, sizes = [], []
                for x, y in slices(part["text"], _PART_BYTES):
                    words = cut(part["text"].slice(x, y - x), lower=True)
                    hashes.append(words.hash)
                    sizes.append(np.diff(words.first))
                known, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
                # The same batch of texts has the same name when a task runs again.
                name = hashlib.blake2b(tokens.tobytes() + known.tobytes(), digest_size=8)
                name.update(repr((TaskContext.get().partitionId(), number, a)).encode())
                yield pa.record_batch(
                    [
                        pa.array([int.from_bytes(name.digest(), "big") >> 1], pa.int64()),
                        pa.array([part["doc_id"].to_pylist()], pa.list_(pa.int64())),
                        pa.array([part["held"].to_pylist()], pa.list_(pa.bool_())),
                        pa.array([np.concatenate(sizes).tolist()], pa.list_(pa.int32())),
                        pa.array([tokens.astype(np.uint16 if len(known) < 65536 else np.uint32).tobytes()], pa.binary()),
                        pa.array([known.tobytes()], pa.binary()),
                    ],
                    [name.split()[0] for name in ENCODED.split(", ")],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("held", held_out()).mapInArrow(code, ENCODED)


class _Chunk:
    """A row of the encoded table: per document a sequence of word numbers, with ``ends`` put in after each."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], np.uint64) if "words" in row else range(row["n_words"])
        self.sizes = np.array(row["sizes"], np.int64)
        self.held = np.array(row["held"], bool)
        wide = len(self.words) >= 65536
        tokens = np.frombuffer(row["tokens"], np.uint32 if wide else np.uint16).astype(np.int64)
        # The end of a text is one more word, with the number after all others.
        at = np.cumsum(self.sizes)
        self.tokens = np.insert(tokens, at, len(self.words))
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        self.train = ~self.held[self.doc]

    def with_ends(self, of_words: np.ndarray, of_end: int) -> np.ndarray:
        """A value for each token, from values of the words."""
        return np.append(of_words, of_end)[self.tokens]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, _Chunk]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch[name][i].as_py() for name in batch.schema.names}
            yield row, _Chunk(row)


def _pairs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values before each token (of the end, before the first of a text follows an end) and the values."""
    return np.concatenate([values[-1:], values[:-1]]), values


def word_counts(encoded: DataFrame) -> DataFrame:
    """word (its hash) and n, its count in training documents, of all words; 0 for words of other documents only.

    A chunk hands its words and counts to the buckets in packed values, one word in some eight bytes.
    """
    bits = exchange.bucket_bits(encoded.count())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, c in _chunks(batches):
            n = np.bincount(c.tokens[c.train], minlength=len(c.words) + 1)
            sent = exchange.pack_sorted(c.words, bits, _LOW)
            bodies = [exchange.join_parts(body, exchange.pack_counts(n[a:b])) for _, a, b, body in sent]
            columns = [pa.array([b for b, *_ in sent], pa.int32()), pa.array([row["chunk"]] * len(sent), pa.int64())]
            yield pa.record_batch([*columns, pa.array(bodies, pa.binary())], ["bucket", "chunk", "body"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        parts = [exchange.split_parts(body, 2) for body in table["body"].to_pylist()]
        hashes = np.concatenate([exchange.unpack_sorted(p, bits, _LOW, key[0].as_py()) for p, _ in parts])
        n = np.concatenate([exchange.unpack_counts(c) for _, c in parts])
        known, place = np.unique(hashes, return_inverse=True)
        total = np.zeros(len(known), np.int64)
        np.add.at(total, place, n)
        return pa.table([pa.array(known.view(np.int64)), pa.array(total)], ["word", "n"])

    sent = encoded.mapInArrow(send, MESSAGES)
    return sent.groupBy("bucket").applyInArrow(add, "word bigint, n bigint")


@dataclass
class Frequent:
    """The hashes of the clustered words in order, and their numbers by rank of frequency."""

    hashes: np.ndarray
    rank: np.ndarray

    def ranks(self, words: np.ndarray, other: int) -> np.ndarray:
        """The rank of each word, ``other`` for words that are not clustered."""
        if not len(self.hashes):
            return np.full(len(words), other)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.rank[at], other)


def _frequent(counts: DataFrame, frequent: int) -> Frequent:
    top = counts.where("n > 0").orderBy(F.desc("n"), "word").limit(frequent).collect()
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Frequent(hashes[order], order)


def _neighbours(encoded: DataFrame, words: Frequent) -> DataFrame:
    """For each clustered word its neighbours on both sides with their counts, at most ``FREQUENT`` + 2 on a side."""
    n = len(words.hashes)
    shared = encoded.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in _chunks(batches):
            rank = c.with_ends(shared.value.ranks(c.words, n + 1), n)
            before, here = _pairs(rank)
            codes, counts = np.unique((before * (n + 2) + here)[c.train], return_counts=True)
            yield pa.record_batch([pa.array(codes), pa.array(counts)], ["pair", "n"])

    pairs = encoded.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = pairs.select(F.floor(F.col("pair") / (n + 2)).alias("a"), (F.col("pair") % (n + 2)).alias("b"), "n")
    sides = pairs.select(F.col("a").alias("w"), F.col("b").alias("other"), "n", F.lit(True).alias("right")).unionByName(
        pairs.select(F.col("b").alias("w"), F.col("a").alias("other"), "n", F.lit(False).alias("right"))
    )
    return sides.groupBy("w").agg(F.collect_list(F.struct("right", "other", "n")).alias("sides"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1))


def best_class(left: np.ndarray, right: np.ndarray, own: float, now: int, counts: np.ndarray) -> int:
    """The class in which a word makes class bigrams likeliest.

    ``left`` and ``right`` count the classes of its neighbours (without itself), ``own`` its bigrams with itself.
    """
    m = counts.astype(float).copy()
    m[now, :] -= right
    m[:, now] -= left
    m[now, now] -= own
    rows, columns = m.sum(1), m.sum(0)
    b = np.arange(CLASSES)
    gain = (_xlogx(m[b] + right) - _xlogx(m[b])).sum(1) + (_xlogx(m[:, b] + left[:, None]) - _xlogx(m[:, b])).sum(0)
    corner = m[b, b]
    gain += _xlogx(corner + left[b] + right[b] + own) - _xlogx(corner + right[b]) - _xlogx(corner + left[b]) + _xlogx(corner)
    # The neighbours' own totals are the same wherever the word goes.
    out, into = right.sum() + own, left.sum() + own
    rows, columns = rows[b] + left[b], columns[b] + right[b]
    gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(columns + into) - _xlogx(columns)
    best = int(gain.argmax())
    return best if gain[best] > gain[now] + 1e-9 else now


def exchange_clusters(neighbours: DataFrame, n: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the ``n`` clustered words (then END and RARE), and the counts of class bigrams."""
    classes = np.concatenate([np.arange(n) % CLASSES, [END, RARE]]).astype(np.int64)
    neighbours = neighbours.coalesce(TASKS)  # of a size that the parameters bound, not the corpus
    context = neighbours.sparkSession.sparkContext

    def vectors(batch: pa.RecordBatch, now: np.ndarray):
        for w, sides in zip(batch["w"].to_pylist(), batch["sides"], strict=True):
            flat = sides.values
            right = flat.field("right").to_numpy(zero_copy_only=False)
            other, count = flat.field("other").to_numpy(), flat.field("n").to_numpy().astype(float)
            yield w, right, other, count, now[other]

    def class_pairs(now: np.ndarray) -> np.ndarray:
        shared = context.broadcast(now)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((ALL, ALL))
            for batch in batches:
                for w, right, _, count, of in vectors(batch, shared.value):
                    np.add.at(total[shared.value[w]], of[right], count[right])
            yield pa.record_batch([pa.array(np.arange(ALL * ALL)), pa.array(total.reshape(-1))], ["pair", "n"])

        out = np.zeros(ALL * ALL)
        for row in neighbours.mapInArrow(add, "pair bigint, n double").groupBy("pair").agg(F.sum("n")).collect():
            out[row[0]] = row[1]
        return out.reshape(ALL, ALL)

    counts = class_pairs(classes)
    for turn in range(rounds):
        shared = context.broadcast((classes, counts))

        def move(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            # Each task goes on from its own moves, so that its words do not all run to the same class.
            now, m = (x.copy() for x in shared.value)
            for batch in batches:
                words, new = [], []
                for w, right, other, count, of in vectors(batch, now):
                    if w < n and w // CLASSES % 2 == turn % 2:
                        self_ = other == w
                        own = count[right & self_].sum()
                        to = np.bincount(of[right & ~self_], count[right & ~self_], ALL)
                        from_ = np.bincount(of[~right & ~self_], count[~right & ~self_], ALL)
                        old, best = int(now[w]), best_class(from_, to, own, int(now[w]), m)
                        for c, sign in ((old, -1), (best, 1)):
                            m[c, :] += sign * to
                            m[:, c] += sign * from_
                            m[c, c] += sign * own
                        now[w] = best
                        words.append(w)
                        new.append(best)
                yield pa.record_batch([pa.array(words, pa.int64()), pa.array(new, pa.int64())], ["w", "class"])

        moved = neighbours.mapInArrow(move, "w bigint, class bigint").collect()  # one number per clustered word
        for w, to in moved:
            classes[w] = to
        counts = class_pairs(classes)
    return classes, counts


def _best_between(counts: np.ndarray) -> np.ndarray:
    """For classes before and after, the class of the exchange that fits best between them."""
    out = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * ALL))
    # The class between is one of the exchange; its own frequency is part of the first step.
    return (out[:, :CLASSES, None] + out[None, :CLASSES, :]).argmax(1)


@dataclass
class _Placed:
    """What a task needs to give every token of a chunk the class that its place suggests."""

    words: Frequent
    classes: np.ndarray
    between: np.ndarray

    def of(self, c: _Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The class of every token, and whether it is a vote for a word that was not clustered."""
        n = len(self.words.hashes)
        firm = self.classes[c.with_ends(self.words.ranks(c.words, n + 1), n)]
        rare = firm == RARE
        before, _ = _pairs(firm)
        after = np.concatenate([firm[1:], firm[:1]])
        return np.where(rare, self.between[before, after], firm), rare


def _votes(encoded: DataFrame, placed: _Placed) -> DataFrame:
    """word and class, for words that were not clustered."""
    shared = encoded.sparkSession.sparkContext.broadcast(placed)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in _chunks(batches):
            of, rare = shared.value.of(c)
            codes, n = np.unique((c.tokens * CLASSES + of)[rare & c.train], return_counts=True)
            words = c.words[codes // CLASSES].view(np.int64)
            yield pa.record_batch([pa.array(words), pa.array(codes % CLASSES), pa.array(n)], ["word", "class", "n"])

    votes = encoded.mapInArrow(vote, "word bigint, class bigint, n bigint").repartition("word")
    votes = votes.groupBy("word", "class").agg(F.sum("n").alias("n"))
    return votes.groupBy("word").agg(F.max_by("class", F.struct("n", -F.col("class"))).alias("class"))


def _transitions(encoded: DataFrame, placed: _Placed) -> np.ndarray:
    """Counts of the classes of neighbouring tokens in training documents."""
    shared = encoded.sparkSession.sparkContext.broadcast(placed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in _chunks(batches):
            before, here = _pairs(shared.value.of(c)[0])
            codes, n = np.unique((before * ALL + here)[c.train], return_counts=True)
            yield pa.record_batch([pa.array(codes), pa.array(n)], ["pair", "n"])

    out = np.zeros(ALL * ALL)
    for row in encoded.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n")).collect():
        out[row[0]] = row[1]
    return out.reshape(ALL, ALL)


def _log_transitions(counts: np.ndarray) -> np.ndarray:
    """P(class | class before), smoothed with the classes' own frequencies; the row RARE is for unknown words."""
    counts = counts.copy()
    counts[RARE] = 0
    counts[:, RARE] = 0
    total = counts.sum(0) + 0.5
    total[RARE] = 0
    return (counts + 20 * total / total.sum()) / (counts.sum(1, keepdims=True) + 20)


def _known_words(encoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """For every chunk what is known of its words: bucket, chunk and body, in the order of the words.

    A chunk hands the words whose hashes begin with a bucket's bits to the bucket in one value, and the bucket, which holds
    that part of the vocabulary, sends back a count and a class for each. So a word costs some ten bytes, not a row.
    """
    bits = exchange.bucket_bits(encoded.count())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch["chunk"].to_pylist(), batch["words"].to_pylist(), strict=True):
                sent = exchange.pack_sorted(np.frombuffer(body, np.uint64), bits, _LOW)
                yield pa.record_batch(
                    [
                        pa.array([b for b, *_ in sent], pa.int32()),
                        pa.array([chunk] * len(sent), pa.int64()),
                        pa.array([packed for *_, packed in sent], pa.binary()),
                    ],
                    [name.split()[0] for name in MESSAGES.split(", ")],
                )

    def serve(key: tuple, asked: pa.Table, words: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        hashes = words["word"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes, n, of = hashes[order], words["n"].to_numpy()[order], words["class"].to_numpy()[order].astype(np.uint8)
        bodies = []
        for body in asked["body"].to_pylist():
            at = np.searchsorted(hashes, exchange.unpack_sorted(body, bits, _LOW, bucket))
            bodies.append(exchange.join_parts(exchange.pack_counts(n[at]), of[at].tobytes()))
        return pa.table([asked["bucket"], asked["chunk"], pa.array(bodies, pa.binary())], [n.split()[0] for n in MESSAGES.split(", ")])

    asked = encoded.select("chunk", "words").mapInArrow(ask, MESSAGES)
    bucket = F.shiftrightunsigned("word", 64 - bits).cast("int")
    parts = vocabulary.select(bucket.alias("bucket"), "word", "n", "class")
    return asked.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(serve, MESSAGES)


def _unpack_known(bodies: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and classes of the ``n`` words of a chunk, from the answers in the order of buckets."""
    parts = [exchange.split_parts(body, 2) for body in bodies]
    if not parts:
        return np.zeros(n), np.full(n, RARE)
    counts = np.concatenate([exchange.unpack_counts(c) for c, _ in parts])
    return counts.astype(float), np.frombuffer(b"".join(c for _, c in parts), np.uint8).astype(np.int64)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score_texts(docs: DataFrame, frequent: int = FREQUENT, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """Scores of all documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    encoded = stored(encode(docs), "encoded")
    counts = stored(word_counts(encoded), "counts")
    ends = encoded.select(F.aggregate("held", F.lit(0), lambda s, h: s + (~h).cast("int")).alias("n")).agg(F.sum("n"))
    end_count = ends.first()[0] or 0
    size, total = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, size = total + end_count, size + (end_count > 0)

    words = _frequent(counts, frequent)
    neighbours = stored(_neighbours(encoded, words), "neighbours")
    classes, pairs = exchange_clusters(neighbours, len(words.hashes), rounds)
    placed = _Placed(words, classes, _best_between(pairs))
    step = _log_transitions(_transitions(encoded, placed))

    spark = docs.sparkSession
    firm = [(int(w), int(classes[r])) for w, r in zip(words.hashes.view(np.int64), words.rank, strict=True)]
    clustered = spark.createDataFrame(firm, "word bigint, firm bigint")  # at most ``frequent`` rows
    vocabulary = (
        counts.join(_votes(encoded, placed), "word", "left")
        .join(F.broadcast(clustered), "word", "left")
        .select("word", "n", F.coalesce("firm", "class", F.lit(RARE)).alias("class"))
    )
    vocabulary = stored(vocabulary, "vocabulary")
    sizes = np.zeros(ALL)
    for row in vocabulary.groupBy("class").agg(F.sum("n")).collect():
        sizes[row[0]] = row[1]
    sizes[END] = end_count

    known = _known_words(encoded, vocabulary)
    model = spark.sparkContext.broadcast((step, sizes))
    base_total = total + 0.5 * (size + 1)

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        step, sizes = model.value
        row = {name: chunk[name][0].as_py() for name in chunk.schema.names}
        c = _Chunk(row)
        n, of = _unpack_known(answers.sort_by("bucket")["body"].to_pylist(), len(c.words))
        n_of = c.with_ends(n, end_count)
        before, here = _pairs(c.with_ends(of, END))
        base = (n_of + 0.5) / base_total
        emission = np.where(n_of > 0, n_of / np.maximum(sizes[here], 1), 0)
        chance = share * step[before, here] * emission + (1 - share) * base
        docs_ = len(c.sizes)
        return pa.table(
            [
                pa.array(row["doc_ids"], pa.int64()),
                pa.array(c.held),
                pa.array(c.sizes + 1),
                pa.array(np.bincount(c.doc[n_of > 0], minlength=docs_)),
                pa.array(np.bincount(c.doc, np.log10(base), docs_)),
                pa.array(np.bincount(c.doc, np.log10(chance), docs_)),
            ],
            [name.split()[0] for name in SCORES.split(", ")],
        )

    # The words themselves stay behind: their answers come in their order.
    texts = encoded.select("chunk", "doc_ids", "held", "sizes", "tokens", (F.octet_length("words") / 8).cast("int").alias("n_words"))
    scored = texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, SCORES)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
