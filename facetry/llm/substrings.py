"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Every window of ``window`` consecutive words of every document gets a 64-bit Rabin-Karp hash. Each chunk
of documents sends its different hashes, with the earliest document that has each, to the buckets; a
bucket counts in how many chunks a hash stands and finds the earliest document of all; the answer is one
bit for each hash of the chunk (does an earlier document have it?). Windows that an earlier document has
then merge into maximal intervals of words to remove.

Rows of any kind: a null or empty text has no words and keeps nothing; texts shorter than the window stay
whole; rows that share a doc_id are one document for the comparison (they never remove from each other)
and come back as one row each; a null doc_id counts as the latest of all; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetry.llm import exchange
from facetry.llm.words import Words, cut, rolling

WINDOW = 50
_LOW = 6

SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept string"
DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_spans bigint"


class _Windows:
    """The windows of a chunk: hash and document of each, and the different hashes in order."""

    def __init__(self, table: pa.Table, width: int):
        self.words = cut(table["text"])
        self.ids = exchange.doc_ids(table)
        hashes = rolling(self.words.hash, width)
        at = np.arange(len(hashes))
        fits = self.words.text[: len(hashes)] == self.words.text[at + width - 1]
        self.at = at[fits]
        self.known, self.number = np.unique(hashes[fits], return_inverse=True)
        # Rows are in the order of ids, so the first window of a hash is that of the earliest document.
        self.earliest, place = np.unique(self.ids, return_inverse=True)
        self.rank = place[self.words.text[self.at]].astype(np.uint32)
        self.first = np.full(len(self.known), np.iinfo(np.uint32).max, np.uint32)
        np.minimum.at(self.first, self.number, self.rank)


def _emit(table: pa.Table, width: int, bits: int):
    w = _Windows(table, width)
    for bucket, a, b, body in exchange.pack_sorted(w.known, bits, _LOW):
        yield bucket, exchange.join_parts(body, exchange.pack_owners(w.earliest, w.first[a:b]))


def _reply(bodies: list[bytes], bits: int) -> list[bytes]:
    hashes, ids, sizes = [], [], []
    for body in bodies:
        packed, owners = exchange.split_parts(body, 2)
        known = exchange.unpack_sorted(packed, bits, _LOW)
        hashes.append(known)
        ids.append(exchange.unpack_owners(owners, len(known)))
        sizes.append(len(known))
    hashes, ids = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    earlier = np.empty(len(ids), bool)
    earlier[order] = least < ids[order]
    ends = np.cumsum(sizes)
    return [exchange.flags_to_bytes(earlier[e - s : e]) for s, e in zip(sizes, ends, strict=True)]


def _removed(table: pa.Table, answers: list[tuple[int, bytes]], width: int, bits: int) -> tuple[Words, np.ndarray]:
    """The words of a chunk, and which of them go."""
    w = _Windows(table, width)
    earlier = np.zeros(len(w.known), bool)
    got = dict(answers)
    for bucket, a, b, _ in exchange.pack_sorted(w.known, bits, _LOW):
        earlier[a:b] = exchange.flags_from_bytes(got[bucket], b - a)
    gone = earlier[w.number] | (w.rank > w.first[w.number])
    cover = np.zeros(len(w.words.hash) + 1, np.int64)
    np.add.at(cover, w.at[gone], 1)
    np.add.at(cover, w.at[gone] + width, -1)
    return w.words, np.cumsum(cover)[:-1] > 0


def _kept_bytes(words: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of all texts, each followed by one space, and where each text's part begins."""
    keep = np.flatnonzero(~removed)
    length = words.end[keep] - words.start[keep] + 1
    first = np.concatenate([[0], np.cumsum(length)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], length) + np.repeat(words.start[keep], length)
    out = np.full(first[-1], 0x20, np.uint8)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    out[inside] = words.data[place[inside]]
    return out, first[np.searchsorted(words.text[keep], np.arange(len(words.bounds)))]


def _finish(table: pa.Table, answers, width: int, bits: int, digest: bool) -> pa.Table:
    words, removed = _removed(table, answers, width, bits)
    first = words.first
    gone = np.concatenate([[0], np.cumsum(removed)])
    begins = removed & ~np.concatenate([[False], removed[:-1]])
    begins[first[:-1][np.diff(first) > 0]] = removed[first[:-1][np.diff(first) > 0]]
    out, at = _kept_bytes(words, removed)
    kept = [out[at[i] : max(at[i], at[i + 1] - 1)].tobytes() for i in range(len(table))]
    counts = [table["doc_id"], pa.array(np.diff(first)), pa.array(gone[first[1:]] - gone[first[:-1]])]
    started = np.concatenate([[0], np.cumsum(begins)])
    n_spans = started[first[1:]] - started[first[:-1]]
    if digest:
        shas = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.table([*counts, pa.array(shas, pa.string()), pa.array(n_spans)], names=_names(DIGEST))
    from_ = np.flatnonzero(begins)
    ends = removed & ~np.concatenate([removed[1:], [False]])
    last = first[1:][np.diff(first) > 0] - 1
    ends[last] = removed[last]
    to = np.flatnonzero(ends) + 1
    base = np.repeat(first[:-1], n_spans)
    pairs = pa.StructArray.from_arrays([pa.array(from_ - base), pa.array(to - base)], ["start", "end"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32))
    spans = pa.ListArray.from_arrays(offsets, pairs)
    texts = pa.array([k.decode("utf-8") for k in kept], pa.string())
    return pa.table([*counts, spans, texts], names=_names(SCHEMA))


def _names(schema: str) -> list[str]:
    names = [part.split()[0] for part in schema.split("spans")[0].rstrip(", ").split(", ")]
    return [*names, "spans", "kept"] if "array" in schema else [p.split()[0] for p in schema.split(", ")]


def remove_repeated_windows(
    docs: DataFrame, window: int = WINDOW, chunk_bytes: int = exchange.CHUNK_BYTES, digest: bool = False
) -> DataFrame:
    """Remove the words that a window covers whose words stand in an earlier document too.

    Returns doc_id, n_words, n_removed, spans (maximal intervals of removed words, from start up to before end)
    and kept (the words left, joined by one space); with ``digest`` the number of spans and the SHA-256 of kept.
    """
    chunked, chunks = exchange.in_chunks(docs, chunk_bytes)
    bits = exchange.bucket_bits(chunks)
    asked = exchange.ask(chunked, lambda table: _emit(table, window, bits))
    answers = exchange.answer(asked, lambda bodies: _reply(bodies, bits))
    return exchange.finish(
        chunked,
        answers,
        lambda table, got: _finish(table, got, window, bits, digest),
        DIGEST if digest else SCHEMA,
    )
