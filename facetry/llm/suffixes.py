"""Suffix-array dedup: the common-prefix intervals of an enhanced suffix array, over all documents.

A string of ``WINDOW`` bytes belongs to the smallest (by hash) of the shorter strings in it, its *anchor*; equal
strings have equal anchors. Neighbouring windows with one anchor make a *context*, the bytes they cover. So all
equal windows of all documents lie in contexts of one anchor, and a suffix array is needed of these only:

1. every chunk of documents sends its anchors and a hash of their contexts to the buckets, which tell for each
   whether an earlier document has the same context (then all its bytes go), and whether other contexts have the
   same anchor; equal contexts are one leaf of the array, that of the earliest document;
2. the contexts that share an anchor with others are sent to the bucket of the anchor. There a suffix array of
   their windows is sorted and scanned with a stack, which yields the tree of intervals with a common prefix of
   ``WINDOW`` bytes or more. An interval whose occurrences all follow the same byte is skipped, as it lies in one
   that begins a byte earlier. The rest are maximal repeats, each with all its occurrences, and every occurrence
   after the earliest document's goes.

An anchor with very many contexts (the edge of a line that a third of all documents have) is dealt out by single
windows, once from each chunk. Equal contexts and windows of one document are sent once; the chunk remembers where
the others are, and what goes of the one goes of all.

Rows of any kind: null and empty texts and texts shorter than the window stay whole; rows that share a doc_id are
one document and never remove from each other; a null doc_id counts as the latest of all; other columns are
ignored. ``remove_repeated_bytes`` may cut inside a character; its ``text`` keeps every character of which a byte
is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetry.llm import exchange
from facetry.llm.quality import slices
from facetry.llm.words import BASE, BYTE_CODES, INVERSE, U64, mix, powers, text_bytes

WINDOW = 50
GRAM = 25
#: Contexts of one anchor from which on they are dealt out by single windows.
MANY = 2000

_LOW_ANCHOR, _CONTEXT = 4, 6
#: Bytes hashed at a time, and suffixes sorted at a time (whole texts, whole anchors).
_PART_BYTES = 1_000_000
_SUFFIXES = 100_000
_NONE, _EARLIER, _SHARED, _MANY = range(4)

DIGEST = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, text string"


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of every ``width`` consecutive values, the first of equal ones."""
    place = np.arange(len(values), dtype=np.int32)
    least, size = values, 1
    while size < width:
        step = min(size, width - size)
        a, b = least[:-step], least[step:]
        right = b < a
        least = np.where(right, b, a)
        place = np.where(right, place[step:], place[:-step])
        size += step
    return place


class _Contexts:
    """The contexts of a chunk: row, first byte, end, anchor and hash of each; and the different ones in order."""

    def __init__(self, table: pa.Table, window: int):
        self.data, self.bounds = text_bytes(table["text"])
        self.earliest, rank = np.unique(exchange.doc_ids(table), return_inverse=True)
        parts = [self._of_rows(a, b, window) for a, b in slices(table["text"].combine_chunks(), _PART_BYTES)]
        row, start, end, anchor, key = map(np.concatenate, zip(*parts, strict=True))
        self.anchor, self.key = anchor, key
        self.row, self.start, self.end = row, start, end
        self.rank = rank[row].astype(np.uint32)
        order = np.lexsort((self.rank, self.key, self.anchor))
        new = np.ones(len(order), bool)
        a, k = self.anchor[order], self.key[order]
        new[1:] = (a[1:] != a[:-1]) | (k[1:] != k[:-1])
        self.top = order[new]  # the earliest of equal contexts
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1

    def _of_rows(self, a: int, b: int, window: int) -> tuple[np.ndarray, ...]:
        """Row, first byte, end, anchor and hash of the contexts of the rows from a to b."""
        base = int(self.bounds[a])
        data, bounds = self.data[base : self.bounds[b]], self.bounds[a : b + 1] - base
        n, gram = len(data), min(GRAM, window)
        if n < window:
            none, nothing = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return none, none, none, nothing, nothing
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * powers(BASE, n), out=sums[1:])
        back = powers(INVERSE, n)
        grams = mix((sums[gram:] - sums[: n - gram + 1]) * back[: n - gram + 1])
        least = _sliding_least(grams, window - gram + 1)
        fits = np.zeros(n - window + 1, bool)  # windows inside one text
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if y - x >= window:
                fits[x : y - window + 1] = True
        at = np.flatnonzero(fits)
        row = np.searchsorted(bounds, at, "right") - 1
        of = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (of[1:] != of[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]])[: len(first)] - 1
        start, end = at[first], at[last] + window
        # The place of the anchor in the context is part of its hash.
        inside = ((end - start) * 64 + (of[first] - start)).astype(np.uint64)
        key = mix(((sums[end] - sums[start]) * back[start]) ^ mix(inside)) >> U64(16)
        return row[first] + a, start + base, end + base, grams[of[first]] >> U64(16), key

    def buckets(self, bits: int):
        """(bucket, from, to, packed anchors) of the different contexts."""
        return exchange.pack_sorted(self.anchor[self.top] << U64(16), bits, _LOW_ANCHOR)


def _emit(table: pa.Table, window: int, bits: int):
    c = _Contexts(table, window)
    keys = c.key[c.top].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_CONTEXT]
    for bucket, a, b, body in c.buckets(bits):
        owners = exchange.pack_owners(c.earliest, c.rank[c.top[a:b]])
        yield bucket, exchange.join_parts(body, keys[a:b].tobytes(), owners)


def _reply(bodies: list[bytes], bits: int) -> list[bytes]:
    anchors, keys, ids, sizes = [], [], [], []
    for body in bodies:
        packed, key, owners = exchange.split_parts(body, 3)
        anchor = exchange.unpack_sorted(packed, bits, _LOW_ANCHOR)
        wide = np.zeros((len(anchor), 8), np.uint8)
        wide[:, :_CONTEXT] = np.frombuffer(key, np.uint8).reshape(-1, _CONTEXT)
        anchors.append(anchor)
        keys.append(wide.reshape(-1).view("<u8"))
        ids.append(exchange.unpack_owners(owners, len(anchor)))
        sizes.append(len(anchor))
    anchor, key, doc = map(np.concatenate, (anchors, keys, ids))
    order = np.lexsort((key, anchor))
    a, k, d = anchor[order], key[order], doc[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
    new = new_anchor | np.concatenate([[True], k[1:] != k[:-1]])
    least = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
    contexts = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
    code = np.where(least < d, _EARLIER, np.where(contexts > MANY, _MANY, np.where(contexts > 1, _SHARED, _NONE)))
    out = np.empty(len(code), np.uint8)
    out[order] = code
    ends = np.cumsum(sizes)
    return [
        exchange.join_parts(exchange.flags_to_bytes(part & 1), exchange.flags_to_bytes(part >> 1))
        for part in (out[e - s : e] for s, e in zip(sizes, ends, strict=True))
    ]


def _pack_spans(context: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Spans, each with the first byte of its context (which no other context of the chunk has)."""
    return np.stack([context, start, end]).astype(np.int64).tobytes()


def _unpack_spans(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.int64).reshape(3, -1)


def _resolve(table: pa.Table, answers: list[tuple[int, bytes]], window: int, bits: int) -> pa.Table:
    """What a chunk knows now: spans that go and places of equal contexts (to itself), and contexts to compare (to their buckets)."""
    c = _Contexts(table, window)
    got = dict(answers)
    code = np.zeros(len(c.top), np.uint8)
    for bucket, a, b, _ in c.buckets(bits):
        low, high = (exchange.flags_from_bytes(x, b - a) for x in exchange.split_parts(got[bucket], 2))
        code[a:b] = low + 2 * high.astype(np.uint8)
    gone = (code[c.number] == _EARLIER) | (c.rank > c.rank[c.top[c.number]])
    start, end = [c.start[gone]], [c.end[gone]]
    text = c.data.tobytes()
    # Of equal contexts one is sent; what goes of it goes of the others in its document, too.
    first = c.rank == c.rank[c.top[c.number]]
    equal = np.flatnonzero(first & (code[c.number] == _SHARED) & (c.top[c.number] != np.arange(len(c.number))))
    copies = np.stack([c.start[c.top[c.number[equal]]], c.start[equal]])
    copied: list[tuple[int, int]] = []
    sent: dict[int, list[tuple[int, int, int, int]]] = {}
    for i in c.top[code == _SHARED].tolist():
        anchor = int(c.anchor[i])
        context = (int(c.start[i]), int(c.end[i]), int(c.rank[i]), anchor)
        sent.setdefault(anchor >> (48 - bits), []).append(context)
    # Single windows of anchors with many contexts: the earliest document's of each, later ones go at once.
    windows: dict[bytes, tuple[int, int]] = {}
    later = []
    many = np.flatnonzero(first & (code[c.number] == _MANY))
    for i in many[np.argsort(c.rank[many], kind="stable")].tolist():
        for s in range(int(c.start[i]), int(c.end[i]) - window + 1):
            known = windows.setdefault(text[s : s + window], (int(c.rank[i]), s))
            if known[1] == s:
                anchor = int.from_bytes(hashlib.blake2b(text[s : s + window], digest_size=6).digest(), "big")
                context = (s, s + window, int(c.rank[i]), anchor)
                sent.setdefault(anchor >> (48 - bits), []).append(context)
            elif known[0] < c.rank[i]:
                later.append((s, s + window))
            else:
                copied.append((known[1], s))
    if later:
        for part, x in zip((start, end), np.array(later, np.int64).T, strict=True):
            part.append(x)
    copies = np.concatenate([copies, np.array(copied, np.int64).reshape(-1, 2).T], axis=1)
    chunk = table["chunk"][0].as_py()
    start, end = np.concatenate(start), np.concatenate(end)
    rows = [(-1 - chunk, chunk, exchange.join_parts(_pack_spans(start, start, end), copies.astype(np.int64).tobytes()))]
    for bucket, contexts in sent.items():
        s, e, k, anchor = np.array(contexts, np.int64).T
        body = b"".join(text[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True))
        rows.append((bucket, chunk, exchange.join_parts(np.stack([s, e, c.earliest[k], anchor]).tobytes(), body)))
    return pa.table([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), exchange.MESSAGE_TYPES, strict=True)], schema=exchange.MESSAGE_TYPES)


class SuffixArray:
    """The suffixes of several strings that begin a window, in order, with common prefix lengths."""

    def __init__(self, strings: list[bytes], window: int):
        sizes = np.array([len(x) for x in strings])
        self.longest = int(sizes.max())
        counts = sizes - window + 1
        self.string = np.repeat(np.arange(len(strings)), counts)
        self.start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        width = -(-self.longest // 8) * 8
        flat = np.frombuffer(b"".join(strings) + bytes(width), np.uint8)
        at = (np.cumsum(sizes) - sizes)[self.string] + self.start
        self.before = np.where(self.start > 0, flat[at - 1].astype(np.int16), np.int16(-1))
        self.length = sizes[self.string] - self.start
        # Suffixes as rows of big-endian numbers, zero after their end.
        rows = np.lib.stride_tricks.sliding_window_view(flat, width)[at].copy()
        rows[np.arange(width) >= self.length[:, None]] = 0
        numbers = rows.view(">u8").astype(np.uint64)
        self.order = np.lexsort((self.length, *numbers.T[::-1]))
        rows = rows[self.order]
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(1), differ.argmax(1), width)
        length = self.length[self.order]
        self.common = np.minimum(common, np.minimum(length[1:], length[:-1]))

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, from, to): intervals of the order with a common prefix that no byte to the left or right extends.

        A stack holds the open intervals, each within the one below it; an interval closes where the common
        prefix gets shorter. ``change[i]`` is the last place up to i at which the byte before a suffix differs
        from its neighbour's, so an interval is diverse to the left if that place lies inside it.
        """
        before = self.before[self.order]
        new = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] < 0)])
        change = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        high = np.flatnonzero(self.common >= least)
        if not len(high):
            return
        runs = np.split(high, np.flatnonzero(np.diff(high) > 1) + 1)
        common, change = self.common.tolist(), change.tolist()
        for run in runs:
            stack = [(common[run[0]], int(run[0]))]
            for i in [*run[1:].tolist(), -1]:
                now = common[i] if i >= 0 else 0
                to = i if i >= 0 else int(run[-1]) + 1
                left = to
                while stack and stack[-1][0] > now:
                    length, left = stack.pop()
                    if change[to] > left:
                        yield length, left, to
                if now and (not stack or stack[-1][0] < now):
                    stack.append((now, left))


def repeats_to_remove(strings: list[bytes], docs: np.ndarray, window: int) -> np.ndarray:
    """(string, start, end) of every occurrence of a maximal repeat after that of the earliest document."""
    array = SuffixArray(strings, window)
    string = array.string[array.order]
    doc = docs[string]
    start = array.start[array.order]
    out = []
    for length, a, b in array.maximal_repeats(window):
        occurrences = slice(a, b + 1)
        d = doc[occurrences]
        late = np.flatnonzero(d > d.min()) + a
        if len(late):
            out.append(np.stack([string[late], start[late], start[late] + length]))
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


def _by_anchor(strings: list[bytes], docs: np.ndarray, anchors: np.ndarray, window: int) -> np.ndarray:
    """``repeats_to_remove`` of strings that can only repeat each other where their anchors are equal."""
    order = np.argsort(anchors, kind="stable")
    suffixes = np.cumsum([len(strings[i]) - window + 1 for i in order])
    ends = np.concatenate([np.flatnonzero(np.diff(anchors[order])) + 1, [len(order)]])
    out, begin, done = [], 0, 0
    for k, end in enumerate(ends):
        if k + 1 == len(ends) or suffixes[ends[k + 1] - 1] - done > _SUFFIXES:
            part = order[begin:end]
            string, a, b = repeats_to_remove([strings[i] for i in part], docs[part], window)
            out.append(np.stack([part[string], a, b]))
            begin, done = end, suffixes[end - 1]
    return np.concatenate(out, axis=1)


def _compare(key: tuple, table: pa.Table, window: int) -> pa.Table:
    """Contexts of one bucket compared; spans that a chunk sent itself pass through."""
    if key[0].as_py() < 0:
        return table.select(["bucket", "chunk", "body"])
    chunks, heads, strings, sizes = [], [], [], []
    for chunk, body in zip(table["chunk"].to_pylist(), table["body"].to_pylist(), strict=True):
        head, data = exchange.split_parts(body, 2)
        head = np.frombuffer(head, np.int64).reshape(4, -1)
        at = np.concatenate([[0], np.cumsum(head[1] - head[0])]).tolist()
        strings += [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        heads.append(head)
        chunks.append(chunk)
        sizes.append(head.shape[1])
    begin, _, doc, anchor = np.concatenate(heads, axis=1)
    string, start, end = _by_anchor(strings, doc, anchor, window)
    of = np.repeat(np.arange(len(chunks)), sizes)[string]
    out = []
    for k, chunk in enumerate(chunks):
        mine = of == k
        s = string[mine]
        out.append((key[0].as_py(), chunk, _pack_spans(begin[s], begin[s] + start[mine], begin[s] + end[mine])))
    columns = [pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), exchange.MESSAGE_TYPES, strict=True)]
    return pa.table(columns, schema=exchange.MESSAGE_TYPES)


def _with_copies(spans: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Spans of contexts, and those of all ``copies`` (context, place), which are in the order of contexts.

    A context is shorter than two windows, so its spans overlap and are one from the first byte to the last.
    """
    if not spans.shape[1] or not copies.shape[1]:
        return spans
    context, start, end = spans[:, np.argsort(spans[0], kind="stable")]
    at = np.flatnonzero(np.diff(context, prepend=-1))
    context, start, end = context[at], np.minimum.reduceat(start, at), np.maximum.reduceat(end, at)
    low, high = (np.searchsorted(copies[0], context, side) for side in ("left", "right"))
    of = np.repeat(np.arange(len(context)), high - low)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    place = copies[1, low[of] + nth]
    shift = place - context[of]
    return np.concatenate([spans, np.stack([place, start[of] + shift, end[of] + shift])], axis=1)


def _finish(table: pa.Table, answers: list[tuple[int, bytes]], digest: bool) -> pa.Table:
    data, bounds = text_bytes(table["text"])
    cover = np.zeros(len(data) + 1, np.int32)
    copies = np.zeros((2, 0), np.int64)
    for bucket, body in answers:  # the chunk's own value, of the least bucket, comes first
        if bucket < 0:
            body, places = exchange.split_parts(body, 2)
            spans, copies = _unpack_spans(body), np.frombuffer(places, np.int64).reshape(2, -1)
            copies = copies[:, np.argsort(copies[0], kind="stable")]
        else:
            spans = _with_copies(_unpack_spans(body), copies)
        np.add.at(cover, spans[1], 1)
        np.add.at(cover, spans[2], -1)
    removed = np.cumsum(cover)[:-1] > 0
    gone = np.concatenate([[0], np.cumsum(removed)])
    begins = removed.copy()
    begins[1:] &= ~removed[:-1]
    inner = bounds[:-1][np.diff(bounds) > 0]
    begins[inner] = removed[inner]
    started = np.concatenate([[0], np.cumsum(begins)])
    spans = started[bounds[1:]] - started[bounds[:-1]]
    counts = [table["doc_id"], pa.array(np.diff(bounds)), pa.array(gone[bounds[1:]] - gone[bounds[:-1]])]
    pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    if digest:
        shas = [hashlib.sha256(data[a:b][~removed[a:b]].tobytes()).hexdigest() for a, b in pairs]
        return pa.table([*counts, pa.array(spans), pa.array(shas, pa.string())], names=[p.split()[0] for p in DIGEST.split(", ")])
    ends = removed.copy()
    ends[:-1] &= ~removed[1:]
    ends[inner + np.diff(bounds)[np.diff(bounds) > 0] - 1] = removed[inner + np.diff(bounds)[np.diff(bounds) > 0] - 1]
    base = np.repeat(bounds[:-1], spans)
    both = pa.StructArray.from_arrays(
        [pa.array(np.flatnonzero(begins) - base), pa.array(np.flatnonzero(ends) + 1 - base)], ["start", "end"]
    )
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans)]).astype(np.int32)), both)
    texts = pa.array([_whole_characters(data[a:b], removed[a:b]) for a, b in pairs], pa.string())
    return pa.table([*counts, lists, texts], names=["doc_id", "n_bytes", "n_removed", "spans", "text"])


def _whole_characters(data: np.ndarray, removed: np.ndarray) -> str:
    """The characters of which any byte stays."""
    if not len(data):
        return ""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    stays = np.logical_or.reduceat(~removed, first)
    return data[np.repeat(stays, np.diff(np.concatenate([first, [len(data)]])))].tobytes().decode("utf-8")


def remove_repeated_bytes(
    docs: DataFrame,
    window: int = WINDOW,
    chunk_bytes: int = exchange.CHUNK_BYTES,
    digest: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Remove every byte that a string of ``window`` bytes covers which also starts in an earlier document.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes) and text (what is left); with
    ``digest`` the number of spans and the SHA-256 of the bytes left. Columns named in ``carry`` (other than
    those) follow.
    """
    chunked, chunks = exchange.in_chunks(docs, chunk_bytes, carry)
    bits = exchange.bucket_bits(chunks)
    asked = exchange.ask(chunked, lambda table: _emit(table, window, bits))
    answers = exchange.answer(asked, lambda bodies: _reply(bodies, bits))

    def resolve(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return exchange.MESSAGE_TYPES.empty_table()
        pairs = list(zip(got["bucket"].to_pylist(), got["body"].to_pylist(), strict=True))
        return _resolve(exchange.sorted_chunk(table), pairs, window, bits)

    resolved = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(resolve, exchange.MESSAGES)
    compared = resolved.groupBy("bucket").applyInArrow(lambda key, table: _compare(key, table, window), exchange.MESSAGES)
    kinds = "".join(f", {name} {chunked.schema[name].dataType.simpleString()}" for name in carry)

    def finish(table: pa.Table, got: list[tuple[int, bytes]]) -> pa.Table:
        done = _finish(table, got, digest)
        for name in carry:
            done = done.append_column(name, table[name])
        return done

    return exchange.finish(chunked, compared, finish, (DIGEST if digest else SCHEMA) + kinds)
