"""Runs: stretches of words that repeat with a period, found by seeds on diagonals.

A run of period q has q words apart identical over its whole length, ``LEAST`` (6) words and ``TIMES`` (4) periods at
least. On the diagonal of lag q it matches for 3 q words at least, and for 5 if q is 1: that many consecutive words
are its seed. Periods fall into classes from a to 1.5 a, each with the k-grams of its guaranteed overlap, k = 3 a (5
for a = 1), indexed per document by sorting their Rabin-Karp hashes. As k is 2 q at least, a k-gram of the run cannot
come back in it sooner than after q words, else the run had a smaller period; so neighbours in the index, as far apart
as a period of the class, are all the pairs that are needed. Each pair is extended along its diagonal both ways by
comparing words. A table of the furthest place covered on each lag suppresses the pairs that an extension has
already passed, so each diagonal is walked once. Of equal stretches the smallest period counts.

Documents in which no five words come back have no run; the longest row of places where they do bounds the classes to
look at. Nothing is shuffled: a task holds a few megabytes of texts, or one longer text, whose memory and time grow with
its words (times their logarithm).

Rows of any kind: a null text has no words; texts of any length are read whole; repeated rows, null ids and ties are
rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.quality import slices
from facetry.llm.words import U64, Words, cut, mix, rolling

LEAST = 6
TIMES = 4
#: Consecutive words that every run repeats.
SEED = 5
#: Words compared at first along a diagonal; twice as many each time.
STEP = 64

SCHEMA = "doc_id bigint, n_runs bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
DIGEST = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)

Run = tuple[int, int, int]


def _classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """Smallest and largest period, and words of a seed, of each class whose seeds fit into ``longest`` words."""
    low = 1
    while True:
        high = low * 3 // 2
        seed = max(SEED, (TIMES - 1) * low)
        if seed > longest:
            return
        yield low, high, seed
        low = high + 1


def _agree(words: np.ndarray, place: int, lag: int) -> int:
    """The first place from ``place`` on whose word differs from the one ``lag`` further on."""
    end, step = len(words) - lag, STEP
    while place < end:
        to = min(place + step, end)
        differ = np.flatnonzero(words[place:to] != words[place + lag : to + lag])
        if len(differ):
            return place + int(differ[0])
        place, step = to, step * 2
    return end


def _agree_back(words: np.ndarray, place: int, lag: int) -> int:
    """The first place of those up to ``place`` that agree with the word ``lag`` further on without a gap."""
    step = STEP
    while place > 0:
        begin = max(0, place - step)
        differ = np.flatnonzero(words[begin:place] != words[begin + lag : place + lag])
        if len(differ):
            return begin + int(differ[-1]) + 1
        place, step = begin, step * 2
    return 0


def runs_of(words: np.ndarray, longest: int | None = None) -> list[Run]:
    """(start, length, period) of every run of one sequence of word hashes, by start, then period.

    ``longest`` bounds the words that a stretch can have in common with an earlier one.
    """
    n = len(words)
    found: dict[tuple[int, int], int] = {}
    for low, high, seed in _classes(min(n, n if longest is None else longest)):
        grams = rolling(words, seed)
        order = np.argsort(grams, kind="stable")
        lags = np.diff(order)
        same = (grams[order[1:]] == grams[order[:-1]]) & (lags >= low) & (lags <= high)
        places, lags = order[:-1][same], lags[same]
        by_place = np.argsort(places)
        furthest: dict[int, int] = {}
        for place, lag in zip(places[by_place].tolist(), lags[by_place].tolist(), strict=True):
            if place < furthest.get(lag, 0):
                continue
            end = _agree(words, place, lag)
            furthest[lag] = max(end, place + 1)
            start = _agree_back(words, place, lag)
            length = end + lag - start
            if length >= max(LEAST, TIMES * lag):
                known = found.get((start, length), lag)
                found[start, length] = min(known, lag)
    return sorted((start, length, period) for (start, length), period in found.items())


def _repeated_rows(words: Words) -> np.ndarray:
    """For each text the longest row of places at which ``SEED`` words stand that stood in it before."""
    longest = np.zeros(len(words.bounds) - 1, np.int64)
    grams = rolling(words.hash, SEED)
    if not len(grams):
        return longest
    at = np.arange(len(grams))
    fits = words.text[at] == words.text[at + SEED - 1]
    # A place that crosses texts gets a number of its own; equal numbers of different texts only cost time.
    keys = mix(np.where(fits, grams, at.astype(U64)) + words.text[at].astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(grams) + 1, bool)
    again[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    again[:-1] &= fits
    edges = np.flatnonzero(np.diff(np.concatenate([[False], again]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    np.maximum.at(longest, words.text[begins], ends - begins)
    return longest


def _collapsed(words: Words, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of every text that are not dropped, joined by spaces, end to end, and where each text begins."""
    edges = np.zeros(len(words.data) + 1, np.int8)
    kept = ~dropped
    edges[words.start[kept]] += 1
    edges[words.end[kept]] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    data = words.data.copy()
    # The byte after a word, unless its text ends there, becomes its space.
    after = words.end[kept & (words.end < words.bounds[words.text + 1])]
    data[after] = 0x20
    inside[after] = True
    sizes = np.concatenate([[0], np.cumsum(inside)])
    return data[inside], sizes[words.bounds]


def find_runs(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Per document its runs, and its words without what repeats the first period of a run, joined by spaces.

    Returns doc_id, n_runs, runs and collapsed; with ``digest`` the longest run (then the first, then that of the smallest
    period), the thousandfold of its length over its period, and SHA-256 of all runs and of the collapsed text.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                yield _rows(part["doc_id"], cut(part["text"]), digest)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, DIGEST if digest else SCHEMA)


def _rows(ids: pa.Array, words: Words, digest: bool) -> pa.RecordBatch:
    first, repeated = words.first, _repeated_rows(words)
    dropped = np.zeros(len(words.hash), bool)
    runs: list[list[Run]] = []
    for i in range(len(ids)):
        # A row of m places covers m + SEED - 1 words that stood before.
        here = runs_of(words.hash[first[i] : first[i + 1]], int(repeated[i]) + SEED - 1) if repeated[i] else []
        for start, length, period in here:
            dropped[first[i] + start + period : first[i] + start + length] = True
        runs.append(here)
    data, bounds = _collapsed(words, dropped)
    texts = [_trimmed(data[bounds[i] : bounds[i + 1]].tobytes()) for i in range(len(ids))]
    counts = pa.array([len(r) for r in runs], pa.int64())
    if not digest:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        listed = [[dict(zip(("start", "length", "period"), run, strict=True)) for run in r] for r in runs]
        columns = [ids, counts, pa.array(listed, kind), pa.array([t.decode() for t in texts], pa.string())]
        return pa.record_batch(columns, ["doc_id", "n_runs", "runs", "collapsed"])
    best = [min(r, key=lambda run: (-run[1], run[0], run[2])) if r else (None, None, None) for r in runs]
    start, length, period = (pa.array([run[k] for run in best], pa.int64()) for k in range(3))
    ratio = pa.array([run[1] * 1000 // run[2] if run[1] else None for run in best], pa.int64())
    listed = ["".join(f"{s},{n},{q}\n" for s, n, q in r) for r in runs]
    hashes = [pa.array([hashlib.sha256(t).hexdigest() for t in group], pa.string()) for group in ([x.encode() for x in listed], texts)]
    names = [column.split()[0] for column in DIGEST.split(", ")]
    return pa.record_batch([ids, counts, start, length, period, ratio, *hashes], names)


def _trimmed(text: bytes) -> bytes:
    return text[:-1] if text.endswith(b" ") else text
