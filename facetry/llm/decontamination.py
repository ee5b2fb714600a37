"""Benchmark decontamination: n-gram seeds join training passages to test items, alignment scores them.

Words are compared in lower case without punctuation. Every three-word sequence of an item is a seed, however
many documents it stands in. Where a document has seeds of an item on nearby diagonals, the passage around them
is aligned with the item by Smith-Waterman (match 2, mismatch and gap -1), all passages of a batch at once. A
document is contaminated by an item from a score of ``LEAST_SCORE`` times the score of the whole item on.

An edited copy may keep no three words in a row. Then each two matches cost at least one, and a score of half the
item's or more needs two thirds of its words. So of the rarer half of an item's words (by the items that have them)
a sixth of the item at least is matched, all within as many diagonals as the item has words: such bands of single
words are the second kind of seeds, for items of ``LEAST_WORDS`` and more, and no passage that scores enough is without
a seed of either kind. (With another ``least`` the same holds for what that score needs.)

Common sequences make many passages that share little else with the item. These are told by a bound before they
are aligned: a word of the item that the passage has not anywhere costs at least one, all others bring two at
most, so no score is above that of the best run of the item's words. The bound looks words up in a table of hash
bits, which can only raise it; no passage that scores enough is left out.

The benchmark is broadcast in parts of ``PART_BYTES`` at most, one pass over the documents for each part, so a
benchmark of any size works. Seeds are laid out for ``_PLACES`` places at a time.

Rows of any kind: null and empty texts and items have no words and match nothing; items of fewer than three
words are compared as one shorter sequence; items that share an item_id are aligned each by itself, and the best
counts; rows that share a doc_id are one document; a null doc_id or item_id is returned as null; an empty
benchmark or table gives no rows; equal scores go to the first place; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from facetry.llm.quality import slices
from facetry.llm.words import U64, Words, cut, shingles

SEED_WORDS = 3
LEAST_SCORE = 0.5
#: Words of an item from which on single words are seeds: a few words may be anywhere.
LEAST_WORDS = 8
PART_BYTES = 8_000_000
MATCH, OTHER = 2, -1
_CELLS = 50_000
#: Places of seeds laid out at once, and hash bits of passages in one table.
_PLACES = 500_000
_BITS = 8_000_000

SCHEMA = "doc_id bigint, item_id bigint, score double, start bigint, end bigint"


@dataclass
class Items:
    """A part of the benchmark: ids and word hashes of the items, and all places of their seeds by hash."""

    ids: list[int | None]
    words: list[np.ndarray]
    flat: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray
    rare: Items | None = None

    @property
    def length(self) -> np.ndarray:
        return np.array([len(w) for w in self.words], np.int64)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``hashes`` are seeds: their places, and the first row of each in ``seeds``."""
        maybe = np.flatnonzero(self.sieve[(hashes & U64(len(self.sieve) - 1)).astype(np.int64)])
        at = np.searchsorted(self.seeds, hashes[maybe])
        found = at < len(self.seeds)
        found[found] = self.seeds[at[found]] == hashes[maybe[found]]
        return maybe[found], at[found]


def _items(rows: list[Row]) -> Items:
    """The items with their seeds of both kinds."""
    found = _with_seeds(rows)
    found.rare = _rarer_half(found)
    return found


def _rarer_half(items: Items) -> Items:
    """The same items with the rarer half of their places, one more than half of the words, as seeds."""
    length = items.length
    item = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(item)) - np.repeat(items.first[: len(length)], length)
    # How many items have each word.
    pairs = np.unique(np.stack([items.flat, item.astype(np.uint64)]), axis=1) if len(item) else np.zeros((2, 0), np.uint64)
    known, number = np.unique(pairs[0], return_counts=True)
    often = number[np.searchsorted(known, items.flat)] if len(item) else item
    order = np.lexsort((place, often, item))
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - np.repeat(items.first[: len(length)], length)
    kept = (nth < length[item] // 2 + 1) & (length[item] >= LEAST_WORDS)
    return _seeded(items.ids, items.words, items.flat, items.first, items.flat[kept], item[kept], place[kept])


def _with_seeds(rows: list[Row]) -> Items:
    texts = pa.array([r["text"] or "" for r in rows], pa.string())
    words = cut(texts, lower=True, punctuation=False)
    first = words.first
    hashes, item = shingles(words, SEED_WORDS)
    place = np.arange(len(item)) - np.searchsorted(item, np.arange(len(rows)))[item] if len(item) else item
    cuts = [words.hash[first[i] : first[i + 1]] for i in range(len(rows))]
    return _seeded([r["item_id"] for r in rows], cuts, words.hash, first, hashes, item, place)


def _seeded(ids: list, words: list, flat: np.ndarray, first: np.ndarray, hashes: np.ndarray, item: np.ndarray, place: np.ndarray) -> Items:
    order = np.argsort(hashes, kind="stable")
    size = 2 ** max(10, math.ceil(math.log2(16 * max(1, len(hashes)))))
    sieve = np.zeros(size, bool)
    sieve[(hashes & U64(size - 1)).astype(np.int64)] = True
    return Items(ids, words, flat, first, hashes[order], item[order], place[order], sieve)


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of each item with its passage: the best score and the place in the passage where it ends."""
    height, width = max(map(len, items)), max(map(len, passages))
    item = np.zeros((len(items), height), np.uint64)
    passage = np.ones((len(items), width), np.uint64)
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        item[k, : len(x)], passage[k, : len(y)] = x | U64(2), y | U64(2)  # padding (0 and 1) equals no word
    row = np.zeros((len(items), width + 1), np.int32)
    slope = np.arange(width + 1, dtype=np.int32)
    best = np.zeros(len(items), np.int32)
    end = np.zeros(len(items), np.int64)
    for i in range(height):
        step = np.where(passage == item[:, i : i + 1], MATCH, OTHER).astype(np.int32)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(0, np.maximum(row[:, :-1] + step, row[:, 1:] + OTHER))
        # A gap in the item costs one for each word: the largest value to the left, less the distance.
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        top = row.argmax(1)
        value = row[np.arange(len(row)), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
    return best, end


def _runs(rows: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Rows (text, item, least and greatest diagonal, seeds) of one text and item joined where gaps are within the slack."""
    text, item, low, high, seeds = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
    # The greatest diagonal so far of the same text and item: groups are lifted above all before them.
    span = int(high.max() - low.min()) + 1
    lift = (np.cumsum(new) - 1) * span
    reached = np.maximum.accumulate(high + lift) - lift
    new[1:] |= low[1:] - reached[:-1] > slack[item[1:]]
    a = np.flatnonzero(new)
    return np.stack([text[a], item[a], low[a], np.maximum.reduceat(high, a), np.add.reduceat(seeds, a)])


def _least_seeds(length: np.ndarray, least: float) -> np.ndarray:
    """How many of the rarer half of an item's words a passage without three words in a row of it has, to score enough.

    With m matches in rows of two at most, there are m / 2 - 1 others between them at least: 2 m - (m / 2 - 1) is the
    greatest score.
    """
    matches = np.ceil((2 * least * length - 1) / 1.5 - 1e-9)
    return np.maximum(1, length // 2 + 1 - (length - matches)).astype(np.int64)


def _passages(items: Items, words: Words, least: float) -> Iterator[np.ndarray]:
    """Columns (text, item, from, to), for some texts at a time: passages around seeds of one item on nearby diagonals."""
    length = items.length
    hashes, text = shingles(words, SEED_WORDS)
    # All gaps of an alignment that scores enough are together no more than the item's words.
    yield from _around(items, words, hashes, text, length, np.ones(len(length), np.int64))
    yield from _around(items.rare, words, words.hash, words.text, length, _least_seeds(length, least))


def _around(
    items: Items, words: Words, hashes: np.ndarray, text: np.ndarray, slack: np.ndarray, least: np.ndarray
) -> Iterator[np.ndarray]:
    """Passages around runs of ``least`` seeds at least, of which neighbours lie within ``slack`` diagonals."""
    first = words.first
    at, row = items.hits(hashes)
    if not len(at):
        return
    begin = np.searchsorted(text, np.arange(len(first) - 1))
    text = text[at]
    at = at - begin[text]
    copies = np.searchsorted(items.seeds, items.seeds[row], "right") - row
    ends = np.cumsum(copies)
    length = items.length
    done, h = 0, 0
    while h < len(at):
        # Whole texts up to the limit, and one at least; a text beyond it is laid out part by part.
        to = int(np.searchsorted(ends, done + _PLACES, "right"))
        to = int(np.searchsorted(text, text[to])) if to < len(at) else to
        to = to if to > h else int(np.searchsorted(text, text[h], "right"))
        parts = []
        for low in range(done, int(ends[to - 1]), _PLACES):
            nth = np.arange(low, min(low + _PLACES, int(ends[to - 1])))
            hit = np.searchsorted(ends, nth, "right")
            seed = row[hit] + nth - (ends[hit] - copies[hit])
            diagonal = at[hit] - items.place[seed]
            one = np.ones(len(nth), np.int64)
            parts.append(_runs(np.stack([text[hit], items.item[seed], diagonal, diagonal, one]), slack))
        runs = parts[0] if len(parts) == 1 else _runs(np.concatenate(parts, axis=1), slack)
        of, item, low, high, _ = runs[:, runs[4] >= least[runs[1]]]
        from_ = np.maximum(0, low - slack[item])
        if len(of):
            yield np.stack([of, item, from_, np.minimum(np.diff(first)[of], high + length[item] + slack[item])])
        done, h = int(ends[to - 1]), to


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group and the place in it, for groups of these sizes one after another."""
    k = np.repeat(np.arange(len(sizes)), sizes)
    return k, np.arange(len(k)) - (np.cumsum(sizes) - sizes)[k]


def _hopeful(items: Items, words: Words, passages: np.ndarray, least: float) -> np.ndarray:
    """The columns of ``passages``, in order of size, whose words allow a score of ``least``."""
    first = words.first
    length = items.length
    passages = passages[:, np.lexsort((passages[3] - passages[2], length[passages[1]]))]
    text, item, from_, to = passages
    width = to - from_
    bits = 2 ** np.ceil(np.log2(16 * np.maximum(width, 8))).astype(np.int64)
    cost = np.concatenate([[0], np.cumsum(bits)])
    kept, a = [], 0
    while a < len(text):
        # As many passages at once as bounded tables hold, and one at least; the items get longer from one to the next.
        b = max(a + 1, int(np.searchsorted(cost, cost[a] + _BITS, "right")) - 1)
        high = length[item[a:b]]
        b = a + max(1, int(np.searchsorted(high * np.arange(1, b - a + 1), _BITS, "right")))
        high, wide = length[item[a:b]], width[a:b]
        base, mask = cost[a:b] - cost[a], (bits[a:b] - 1).astype(np.uint64)
        here = np.zeros(int(cost[b] - cost[a]), bool)
        k, nth = _places(wide)
        here[base[k] + ((words.hash[(first[text[a:b]] + from_[a:b])[k] + nth] >> U64(8)) & mask[k]).astype(np.int64)] = True
        k, nth = _places(high)
        has = here[base[k] + ((items.flat[items.first[item[a:b]][k] + nth] >> U64(8)) & mask[k]).astype(np.int64)]
        gain = np.full((b - a, int(high[-1]) + 1), OTHER, np.int32)
        gain[:, 0] = 0
        gain[k, nth + 1] = np.where(has, MATCH, OTHER)
        sums = np.cumsum(gain, axis=1)
        bound = (sums - np.minimum.accumulate(sums, axis=1)).max(1)
        kept.append(a + np.flatnonzero(bound / (MATCH * high) >= least))
        a = b
    return passages[:, np.concatenate(kept)]


def _matches(items: Items, column: pa.Array, least: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, start, end) of every passage that scores enough."""
    words = cut(column, lower=True, punctuation=False)
    out = []
    for passages in _passages(items, words, least):
        out += _aligned(items, words, _hopeful(items, words, passages, least).T.tolist(), least)
    return out


def _aligned(items: Items, words: Words, found: list[list[int]], least: float) -> list[tuple[int, int, float, int, int]]:
    first = words.first
    out, done = [], 0
    while done < len(found):
        # As many alignments at once as bounded tables hold, and one at least.
        n = done + 1
        while n < len(found) and (n + 1 - done) * (found[n][3] - found[n][2]) <= _CELLS:
            n += 1
        part, done = found[done:n], n
        whole = [items.words[i] for _, i, _, _ in part]
        passages = [words.hash[first[t] + a : first[t] + b] for t, _, a, b in part]
        score, end = align(whole, passages)
        back, behind = align([w[::-1] for w in whole], [p[::-1] for p in passages])
        for (t, i, a, b), s, e, f in zip(part, score.tolist(), end.tolist(), behind.tolist(), strict=True):
            share = s / (MATCH * len(items.words[i]))
            if share >= least:
                out.append((t, i, share, a + min(e - 1, b - a - f), a + e))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, best score (1: the whole item), start, end (in words)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    found = [_contaminated_by(docs, tests.where(part == k).sort("item_id", "text").collect(), least) for k in range(parts)]
    hits = reduce(DataFrame.unionByName, found)
    best = F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"))).alias("best")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _contaminated_by(docs: DataFrame, rows: list[Row], least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_items(rows))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                ids = batch["doc_id"].slice(a, b - a)
                got = _matches(shared.value, batch["text"].slice(a, b - a), least)
                yield pa.record_batch(
                    [
                        ids.take(pa.array([m[0] for m in got], pa.int64())),
                        pa.array([shared.value.ids[m[1]] for m in got], pa.int64()),
                        pa.array([m[2] for m in got], pa.float64()),
                        pa.array([m[3] for m in got], pa.int64()),
                        pa.array([m[4] for m in got], pa.int64()),
                    ],
                    [name.split()[0] for name in SCHEMA.split(", ")],
                )

    return docs.mapInArrow(find, SCHEMA)
