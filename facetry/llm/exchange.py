"""Counting numbers that every text is full of (hashes of windows, words) without a row for each.

Documents are dealt by a hash of their id into *chunks* of a few megabytes. A chunk hands each number
once to the *bucket* that its leading bits name, all of a bucket in one binary value; a bucket sees the
numbers of all chunks, and answers each chunk in the order the chunk used. A number that stands in a
third of all documents reaches its bucket once from each chunk, never once from each document.

Spark shuffles texts, values and answers; a task holds one chunk, or one bucket. ``chunk_bytes`` bounds
the first, the number of buckets follows the number of chunks and bounds the second.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.words import U64

CHUNK_BYTES = 4_000_000

MESSAGES = "bucket int, chunk int, body binary"
MESSAGE_TYPES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("body", pa.binary())])


def in_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Columns doc_id, text, those of ``carry`` and chunk of ``docs``, and how many chunks there are.

    The chunk follows from doc_id (and, for rows without one, from the text), so a lost task finds the same again.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    key = F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")))
    return docs.withColumn("chunk", F.pmod(key, F.lit(chunks)).cast("int")), chunks


def bucket_bits(chunks: int) -> int:
    """Leading bits that name a bucket: about one bucket for each chunk, 16 at least."""
    return min(16, max(4, math.ceil(math.log2(max(1, chunks)))))


def sorted_chunk(table: pa.Table) -> pa.Table:
    """The rows of a chunk in an order that does not depend on how they arrived."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def doc_ids(table: pa.Table) -> np.ndarray:
    """Ids for comparing which document is earlier; a document without id counts as the last."""
    return table["doc_id"].combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def ask(chunked: DataFrame, emit: Callable[[pa.Table], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """The values that each chunk sends: ``emit`` yields (bucket, body)."""

    def send(key: tuple, table: pa.Table) -> pa.Table:
        sent = list(emit(sorted_chunk(table)))
        return pa.table(
            [
                pa.array([b for b, _ in sent], pa.int32()),
                pa.array([key[0].as_py()] * len(sent), pa.int32()),
                pa.array([body for _, body in sent], pa.binary()),
            ],
            schema=MESSAGE_TYPES,
        )

    return chunked.groupBy("chunk").applyInArrow(send, MESSAGES)


def answer(messages: DataFrame, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """The answer to each value: ``reply`` gets all values of one bucket and returns as many answers."""

    def serve(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        bodies = reply([x.as_py() for x in table["body"]])
        return pa.table([table["bucket"], table["chunk"], pa.array(bodies, pa.binary())], schema=MESSAGE_TYPES)

    return messages.groupBy("bucket").applyInArrow(serve, MESSAGES)


def finish(
    chunked: DataFrame, answers: DataFrame, work: Callable[[pa.Table, list[tuple[int, bytes]]], pa.Table], schema: str
) -> DataFrame:
    """``work`` gets each chunk again, with the answers to what it sent in the order of buckets."""

    def end(table: pa.Table, got: pa.Table) -> pa.Table:
        got = got.sort_by("bucket")
        return work(sorted_chunk(table), list(zip(got["bucket"].to_pylist(), got["body"].to_pylist(), strict=True)))

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(end, schema)


def pack_sorted(numbers: np.ndarray, bits: int, low_bytes: int) -> list[tuple[int, int, int, bytes]]:
    """Cut sorted 64-bit numbers by their leading ``bits``: (bucket, from, to, body) for each bucket that has any.

    Of the leading 16 bits only the counts are kept, and of the rest the next ``low_bytes`` bytes.
    """
    bounds = np.searchsorted(numbers, (np.arange(1, 2**bits, dtype=np.uint64) << U64(64 - bits)))
    bounds = np.concatenate([[0], bounds, [len(numbers)]])
    out = []
    for b in np.flatnonzero(np.diff(bounds)):
        part = numbers[bounds[b] : bounds[b + 1]]
        leading = (part >> U64(48)).astype(np.int64) - (int(b) << (16 - bits))
        counts = np.bincount(leading, minlength=2 ** (16 - bits))
        counts = counts.astype(np.uint8 if counts.max() < 256 else np.uint32)
        rest = (part << U64(16)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :low_bytes]
        body = bytes([counts.itemsize]) + counts.tobytes() + rest.tobytes()
        out.append((int(b), int(bounds[b]), int(bounds[b + 1]), body))
    return out


def unpack_sorted(body: bytes, bits: int, low_bytes: int, bucket: int = 0) -> np.ndarray:
    """The numbers of a body of ``pack_sorted``, without the bits that were left out."""
    size = 2 ** (16 - bits)
    counts = np.frombuffer(body, np.uint8 if body[0] == 1 else np.uint32, size, 1)
    n = int(counts.sum())
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :low_bytes] = np.frombuffer(body, np.uint8, n * low_bytes, 1 + size * body[0]).reshape(n, low_bytes)
    leading = np.repeat(np.arange(size, dtype=np.uint64), counts) + U64(bucket << (16 - bits))
    return (rest.reshape(-1).view(">u8").astype(np.uint64) >> U64(16)) | (leading << U64(48))


def join_parts(*parts: bytes) -> bytes:
    """Binary values one after another, with their sizes in front."""
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def split_parts(body: bytes, n: int) -> list[bytes]:
    """The values that ``join_parts`` put together."""
    sizes = np.frombuffer(body, np.uint32, n)
    ends = 4 * n + np.cumsum(sizes)
    return [body[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def pack_ids(ids: np.ndarray) -> bytes:
    """Sorted ids as their distances, in as few bytes as the largest needs."""
    steps = np.diff(ids, prepend=ids[:1]).astype(np.uint64)
    first = ids[:1].astype(np.int64).tobytes()
    size = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return first + bytes([size]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack_ids(body: bytes) -> np.ndarray:
    first, size = np.frombuffer(body, np.int64, 1), body[8]
    steps = np.zeros(((len(body) - 9) // size, 8), np.uint8)
    steps[:, :size] = np.frombuffer(body, np.uint8, offset=9).reshape(-1, size)
    return first + np.cumsum(steps.reshape(-1).view("<u8").astype(np.int64))


def pack_owners(ids: np.ndarray, ranks: np.ndarray) -> bytes:
    """The id of each of several numbers, ``ids[ranks]``; ``ids`` are sorted. Only ids that occur are sent."""
    used, place = np.unique(ranks, return_inverse=True)
    kind = np.uint8 if len(used) <= 256 else np.uint16 if len(used) <= 65536 else np.uint32
    return join_parts(pack_ids(ids[used]), place.astype(kind).tobytes())


def unpack_owners(body: bytes, n: int) -> np.ndarray:
    names, place = split_parts(body, 2)
    return unpack_ids(names)[np.frombuffer(place, f"u{len(place) // n}")] if n else np.zeros(0, np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as most need: one for those up to 254, the others apart."""
    small = np.where(counts < 255, counts, 255).astype(np.uint8)
    return join_parts(small.tobytes(), counts[counts >= 255].astype(np.uint64).tobytes())


def unpack_counts(body: bytes) -> np.ndarray:
    small, large = split_parts(body, 2)
    counts = np.frombuffer(small, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, np.uint64).astype(np.int64)
    return counts


def flags_to_bytes(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_from_bytes(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)
