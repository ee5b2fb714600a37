"""Byte-level BPE encoding and decoding, by recursive DuckDB queries in each partition.

Texts are cut by the tokenizer's pattern; each different piece is encoded once. A piece that is a token is its
own code. All others become rows (place, piece, token), one per byte, and a recursive query joins neighbouring
tokens with the merge table and contracts the leftmost pair of least rank of every piece, until no piece has a
pair that merges. Ordered aggregation over the last rows gives each piece's ids, and the bytes they stand for. A
text is its pieces' ids one after another.

Pieces over ``_LONG_PIECE`` bytes (rules, padding) take a second query with fewer, larger steps: where no pair
with the merged token ranks below it, the next leftmost pair of least rank is the next place of the same pair, so
all of those places are contracted in one step, leftmost first. Pairs that make any other token are contracted
one at a time there too; the results of both queries are the same.

Rows of any kind: a null or empty text has no ids; long texts are cut and hashed part by part; a fixed number of
known pieces is remembered from batch to batch, and a forgotten piece is encoded again; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.quality import slices

#: Pieces in each of the two generations of known pieces, and those encoded by one query.
_REMEMBERED = 300_000
_AT_ONCE = 20_000
_LONG_TEXT = 2_000_000
_LONG_PIECE = 256
_PIECES = 200_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

#: Contracts one pair of each piece per step, until nothing merges. ``start`` holds (place, piece, token) and
#: ``merges`` (pair, rank), where a pair is (first << 20) | second. Places run over all pieces.
SHORT = """
WITH RECURSIVE state(place, piece, token, step) AS (
  SELECT place, piece, token, 0 FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT *, (token << 20) | lead(token) OVER w AS pair, lead(piece) OVER w AS next_piece, lag(place) OVER w AS previous
     FROM state WINDOW w AS (ORDER BY place)),
   ranked AS (
     SELECT p.place, p.piece, p.token, p.step, p.previous, (m.rank << 32) | p.place AS key
     FROM pairs p LEFT JOIN merges m ON m.pair = p.pair AND p.next_piece = p.piece),
   best AS (
     SELECT piece, min(key) AS key FROM ranked WHERE key IS NOT NULL GROUP BY piece)
   SELECT r.place, r.piece, CASE WHEN r.key = b.key THEN b.key >> 32 ELSE r.token END, step + 1
   FROM ranked r JOIN best b ON b.piece = r.piece
   WHERE r.previous IS DISTINCT FROM b.key & 4294967295)),
"""

#: The same, contracting equal pairs together where that is safe. In a run of overlapping pairs (a token three
#: times or more often) every second pair counts, from the left.
LONG = """
WITH RECURSIVE state(place, piece, token, step) AS (
  SELECT place, piece, token, 0 FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT *, (token << 20) | lead(token) OVER w AS pair FROM state WINDOW w AS (PARTITION BY piece ORDER BY place)),
   ranked AS (
     SELECT p.*, m.rank, m.together, min(m.rank) OVER (PARTITION BY p.piece) AS least
     FROM pairs p LEFT JOIN merges m ON m.pair = p.pair),
   marked AS (
     SELECT *, rank IS NOT DISTINCT FROM least AS hit, row_number() OVER w AS nth,
            lag(rank) OVER w IS NOT DISTINCT FROM least AS hit_before
     FROM ranked WHERE least IS NOT NULL WINDOW w AS (PARTITION BY piece ORDER BY place)),
   runs AS (
     SELECT *, CASE WHEN hit THEN nth - max(CASE WHEN hit AND NOT hit_before THEN nth END)
       OVER (PARTITION BY piece ORDER BY place) END AS in_run
     FROM marked),
   taken AS (
     SELECT *, hit AND in_run % 2 = 0
       AND (together OR nth = min(CASE WHEN hit THEN nth END) OVER (PARTITION BY piece)) AS merge FROM runs),
   after AS (
     SELECT *, coalesce(lag(merge) OVER (PARTITION BY piece ORDER BY place), false) AS swallowed FROM taken)
   SELECT place, piece, CASE WHEN merge THEN least ELSE token END, step + 1 FROM after WHERE NOT swallowed)),
"""

#: Ids and decoded bytes (as hex digits) of every piece, from the rows of its last step.
ENDS = """
ends AS (SELECT piece, max(step) AS step FROM state GROUP BY piece)
SELECT s.piece, list(s.token ORDER BY s.place) AS ids, string_agg(hex(v.bytes), '' ORDER BY s.place) AS decoded
FROM state s JOIN ends e ON e.piece = s.piece AND e.step = s.step JOIN vocabulary v ON v.token = s.token
GROUP BY s.piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base 64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens that makes a token, its rank, and whether equal pairs may be contracted together."""
    rows = [
        (ranks[token[:i]], ranks[token[i:]], rank)
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    a, b, rank = (np.array([r[k] for r in rows], np.int32) for k in range(3))
    # The least rank among the pairs that have a token as a part.
    next_rank = np.full(max(ranks.values(), default=0) + 1, np.iinfo(np.int32).max, np.int32)
    np.minimum.at(next_rank, a, rank)
    np.minimum.at(next_rank, b, rank)
    pair = (a.astype(np.int64) << 20) | b
    return pa.table({"pair": pair, "rank": rank.astype(np.int64), "together": next_rank[rank] > rank})


class Coder:
    """Encodes pieces with one DuckDB connection; made once in each Python worker."""

    _of: dict[str, Coder] = {}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False})
        vocabulary = pa.table(
            {"token": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())}
        )
        for name, rows in (("merges", merge_table(ranks)), ("vocabulary", vocabulary)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    @classmethod
    def of(cls, key: str, ranks: dict[bytes, int], pattern: str) -> Coder:
        if key not in cls._of:
            cls._of[key] = cls(ranks, pattern)
        return cls._of[key]

    @classmethod
    def forget(cls) -> None:
        """Give back the memory of all coders of this worker; the next task makes its own."""
        for coder in cls._of.values():
            coder.db.close()
        cls._of.clear()

    def learn(self, pieces: Iterable[str]) -> None:
        """Have all these pieces among the known ones, encoding those that are new."""
        if len(self.known) > _REMEMBERED:
            self.known, self.older = {}, self.known
        short, long = [], []
        for piece in set(pieces).difference(self.known):
            if (old := self.older.get(piece)) is not None:
                self.known[piece] = old
                continue
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is None:
                (short if len(data) <= _LONG_PIECE else long).append((piece, data))
            else:
                self.known[piece] = (rank.to_bytes(4, "little"), data)
        for sql, hard in ((SHORT, short), (LONG, long)):
            for i in range(0, len(hard), _AT_ONCE):
                self._encode(hard[i : i + _AT_ONCE], sql)

    def _encode(self, hard: list[tuple[str, bytes]], sql: str) -> None:
        sizes = np.array([len(data) for _, data in hard])
        start = pa.table(
            {
                "place": np.arange(sizes.sum()),
                "piece": np.repeat(np.arange(len(hard), dtype=np.int32), sizes),
                "token": self.byte[np.frombuffer(b"".join(data for _, data in hard), np.uint8)],
            }
        )
        self.db.register("start", start)
        got = self.db.sql(sql + ENDS).to_arrow_table()
        self.db.unregister("start")
        ids = got["ids"].combine_chunks()
        flat = ids.flatten().to_numpy().astype("<u4").tobytes()
        bounds = (np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]) * 4).tolist()
        for k, (number, decoded) in enumerate(zip(got["piece"].to_pylist(), got["decoded"].to_pylist(), strict=True)):
            self.known[hard[number][0]] = (flat[bounds[k] : bounds[k + 1]], bytes.fromhex(decoded))

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in lists of bounded length for long texts."""
        if len(text) <= _LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while part := [m[0] for m in islice(found, _PIECES)]:
            yield part

    def encode(self, texts: list[str]) -> Iterator[Iterator[tuple[bytes, bytes]]]:
        """For each text its ids (4 bytes each, little-endian) and decoded bytes, part by part."""
        cut = [self.pattern.findall(t) if len(t) <= _LONG_TEXT else None for t in texts]
        self.learn(chain.from_iterable(c for c in cut if c))
        for text, part in zip(texts, cut, strict=True):
            yield (self._joined(p) for p in ([part] if part is not None else self.parts(text)))

    def _joined(self, part: list[str]) -> tuple[bytes, bytes]:
        # A long text may have pushed out what was learnt for the texts after it.
        if not all(map(self.known.__contains__, part)):
            self.learn(part)
        ids, decoded = zip(*map(self.known.__getitem__, part), strict=True) if part else ((), ())
        return b"".join(ids), b"".join(decoded)


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False, remember: bool = True
) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns doc_id, n_tokens, ids and decoded, or with ``digest`` the SHA-256 of the ids and of the decoded bytes.
    ``ranks_path`` is read by the driver; the vocabulary, of fixed size, is broadcast. With ``remember`` a worker keeps
    the pieces it knows from one task to the next, some 200 MB; without, it makes room for the jobs that follow.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = hashlib.sha256(f"{ranks_path}\n{pattern}\n{len(ranks.value)}".encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(key, ranks.value, pattern)
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part["text"].to_pylist()]
                rows = [_row(parts, digest) for parts in coder.encode(texts)]
                counts, ids, decoded = zip(*rows, strict=True)
                if digest:
                    kinds = (pa.string(), pa.string())
                else:
                    kinds = (pa.list_(pa.int32()), pa.string())
                yield pa.record_batch(
                    [part["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, kinds[0]), pa.array(decoded, kinds[1])],
                    [name.split()[0] for name in (DIGEST if digest else SCHEMA).split(", ")],
                )
        if not remember:
            del coder
            Coder.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(code, DIGEST if digest else SCHEMA)


def _row(parts: Iterator[tuple[bytes, bytes]], digest: bool):
    if digest:
        n, ids_sha, decoded_sha = 0, hashlib.sha256(), hashlib.sha256()
        for ids, decoded in parts:
            n += len(ids) // 4
            ids_sha.update(ids)
            decoded_sha.update(decoded)
        return n, ids_sha.hexdigest(), decoded_sha.hexdigest()
    parts = list(parts)
    ids = np.frombuffer(b"".join(p[0] for p in parts), "<u4").astype(np.int32)
    return len(ids), ids, b"".join(p[1] for p in parts).decode("utf-8")
