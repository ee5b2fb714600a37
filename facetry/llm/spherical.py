"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes it if the inner product with it exceeds a threshold, that is, if it lies
in a cap around the direction. Directions are products: after a random rotation the dimensions are cut into
blocks, each block has a code of random unit vectors, and a direction takes one of each. All exceeding
directions of a vector are found by list decoding: partial sums over the blocks, cut off where the best rest
cannot reach the threshold. The number of directions follows the number of vectors, so that a filter has about
``BUCKET`` of them whatever the size of the table, and each vector passes about ``LISTED`` filters.

Equal vectors are one class with a count. Classes join on filters; a sketch of 128 signs tells which members of
a filter can have a partner at all, and only those fetch their vectors. Their cosines are computed in double
precision, in square cells of bounded size. A pair is counted in the first filter that both pass, so links are
counted without listing pairs, and each cell passes on one row per member: its links, and the smallest member it
is connected with in the cell, from which components follow.

Rows of any kind: null vectors, empty ones, zero vectors and vectors with null or non-finite components link with
nothing; vectors of different length are not compared; rows that share a vec_id are counted as vectors each, and
come back as one row each; a null vec_id links with nothing and has a null component; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.llm.cells import in_cells
from facetry.llm.components import connected_components, stored

LEAST_COSINE = 0.95
LISTED = 32
LEAST_LISTED = 16
BUCKET = 128
BLOCK = 1024
#: Signs that a pair at the threshold may have different: seven deviations above the mean.
SIGNS = 128
MOST_DIFFERENT = math.ceil(
    SIGNS * math.acos(LEAST_COSINE) / math.pi + 7 * math.sqrt(SIGNS * math.acos(LEAST_COSINE) / math.pi)
)


@dataclass(frozen=True)
class Code:
    """How many blocks and code words a table of so many vectors gets."""

    blocks: int
    words: int

    @classmethod
    def for_vectors(cls, n: int) -> Code:
        directions = max(1024.0, LISTED * n / BUCKET)
        blocks = 2
        while directions ** (1 / blocks) > 512:
            blocks += 1
        return cls(blocks, math.ceil(directions ** (1 / blocks)))

    def decoder(self, dimension: int) -> Decoder:
        return Decoder(self, dimension)


class Decoder:
    """The rotation, code words and sign directions for one dimension, the same in every task."""

    def __init__(self, code: Code, dimension: int):
        random = np.random.default_rng([dimension, code.blocks, code.words])
        self.rotation, _ = np.linalg.qr(random.standard_normal((dimension, dimension)))
        self.signs = random.standard_normal((dimension, SIGNS))
        self.blocks = min(code.blocks, dimension)
        self.parts = np.array_split(np.arange(dimension), self.blocks)
        self.codes = []
        for part in self.parts:
            words = random.standard_normal((len(part), code.words))
            self.codes.append(words / np.linalg.norm(words, axis=0))
        share = min(0.5, LISTED / code.words**self.blocks)
        self.threshold = -NormalDist().inv_cdf(share) * math.sqrt(self.blocks / dimension)

    def filters(self, units: np.ndarray) -> list[np.ndarray]:
        """The numbers of all directions that each unit vector exceeds; the nearest if there are too few."""
        turned = units @ self.rotation
        products = [turned[:, part] @ code for part, code in zip(self.parts, self.codes, strict=True)]
        return [self._decode([p[i] for p in products]) for i in range(len(units))]

    def _decode(self, products: list[np.ndarray]) -> np.ndarray:
        least = min(LEAST_LISTED, math.prod(len(p) for p in products))
        threshold = self.threshold
        while True:
            sums, found = np.zeros(1), np.zeros(1, np.int64)
            for k, product in enumerate(products):
                rest = sum(p.max() for p in products[k + 1 :])
                all_sums = sums[:, None] + product[None, :]
                a, b = np.nonzero(all_sums >= threshold - rest)
                sums, found = all_sums[a, b], found[a] * len(product) + b
            if len(found) >= least:
                return np.sort(found)
            threshold -= 0.1 * abs(self.threshold) + 0.01

    def sketch(self, units: np.ndarray) -> np.ndarray:
        return np.packbits(units @ self.signs >= 0, axis=1)


def _vectors(bodies: pa.Array, double: bool) -> np.ndarray:
    kind = np.float64 if double else np.float32
    return np.stack([np.frombuffer(b.as_py(), kind) for b in bodies]).astype(np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _checked(vectors: DataFrame, double: bool) -> DataFrame:
    """vec_id and the bytes of each vector that can link, null for the others."""
    kind = np.float64 if double else np.float32

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies: list[bytes | None] = []
            for vec_id, vector in zip(batch["vec_id"], batch["embedding"], strict=True):
                values = vector.values
                row = None
                if vec_id.is_valid and values is not None and len(values) and not values.null_count:
                    numbers = values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # one zero only
                    if np.isfinite(numbers).all() and numbers.any():
                        row = numbers.tobytes()
                bodies.append(row)
            yield pa.record_batch([batch["vec_id"], pa.array(bodies, pa.binary())], ["vec_id", "body"])

    return vectors.mapInArrow(check, "vec_id bigint, body binary")


def _listed(classes: DataFrame, code: Code, double: bool) -> DataFrame:
    """rep, dimension, filters and sketch of each class."""
    decoders: dict[int, Decoder] = {}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(b.as_py()) for b in batch["body"]], np.int64)
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                units = _unit(_vectors(part["body"], double))
                dimension = units.shape[1]
                if dimension not in decoders:
                    decoders[dimension] = code.decoder(dimension)
                decoder = decoders[dimension]
                yield pa.record_batch(
                    [
                        part["rep"],
                        pa.array([dimension] * part.num_rows, pa.int32()),
                        pa.array(decoder.filters(units), pa.list_(pa.int64())),
                        pa.array([s.tobytes() for s in decoder.sketch(units)], pa.binary()),
                    ],
                    ["rep", "dimension", "filters", "sketch"],
                )

    return classes.select("rep", "body").mapInArrow(decode, "rep bigint, dimension int, filters array<bigint>, sketch binary")


_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _with_partner(listed: DataFrame) -> DataFrame:
    """The classes that have, in some filter, a partner whose sketch is near enough."""
    rows = listed.select("dimension", F.explode("filters").alias("filter"), "rep", "sketch")
    cells = in_cells(rows, ["dimension", "filter"], "rep", BLOCK)

    def look(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["rep"].to_numpy()
        own = table["own"].to_numpy()
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        low, high = key[2].as_py(), key[3].as_py()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        has = np.zeros(len(ids), bool)
        for i in left:
            near = _POPULATION[sketch[right] ^ sketch[i]].sum(1) <= MOST_DIFFERENT
            near &= ids[right] != ids[i]
            if near.any():
                has[i] = True
                has[right[near]] = True
        return pa.table({"rep": ids[has]})

    found = cells.groupBy("dimension", "filter", "low", "high").applyInArrow(look, "rep bigint")
    return found.distinct()


def _same_filter_before(filters: list[np.ndarray], filter_: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows, whether both pass a filter before ``filter_``."""
    rows = np.repeat(np.arange(len(filters)), [len(f) for f in filters])
    flat = np.concatenate(filters)
    before = flat < filter_
    rows, flat = rows[before], flat[before]
    kinds, number, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[number] > 1
    kept = np.cumsum(counts > 1) - 1
    passes = np.zeros((len(filters), int((counts > 1).sum())), np.float32)
    passes[rows[shared], kept[number[shared]]] = 1
    return passes[left] @ passes[right].T > 0


def _links(cells: DataFrame, double: bool, least: float) -> DataFrame:
    """rep, links (in vectors) and top (the smallest class connected in the cell) for each class linked in a cell."""

    def link(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["rep"].to_numpy()
        own = table["own"].to_numpy()
        n = table["n"].to_numpy()
        units = _unit(_vectors(table["body"].combine_chunks(), double))
        filters = [np.asarray(f) for f in table["filters"].to_pylist()]
        low, high = key[2].as_py(), key[3].as_py()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        linked = units[left] @ units[right].T >= least
        linked &= ids[left][:, None] != ids[right][None, :]
        if linked.any():
            linked &= ~_same_filter_before(filters, key[1].as_py(), left, right)
        links = np.zeros(len(ids), np.int64)
        links[left] += linked @ n[right]
        if low != high:
            links[right] += linked.T @ n[left]
        top = ids.copy()
        while True:  # each round every row takes the smallest number among its links
            now = top.copy()
            big = np.iinfo(np.int64).max
            now[left] = np.minimum(now[left], np.where(linked, top[right][None, :], big).min(1, initial=big))
            now[right] = np.minimum(now[right], np.where(linked, now[left][:, None], big).min(0, initial=big))
            if (now == top).all():
                break
            top = now
        some = links > 0
        return pa.table({"rep": ids[some], "links": links[some], "top": top[some]})

    return cells.groupBy("dimension", "filter", "low", "high").applyInArrow(link, "rep bigint, links bigint, top bigint")


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links (other vectors at cosine ``least`` or more), component_id and kept of every vector.

    The filters are made for ``LEAST_COSINE``; a lower ``least`` is refused, as they would lose links.
    """
    if not least >= LEAST_COSINE:
        raise FacetryError(f"least must be {LEAST_COSINE} or more, not {least}")
    double = "double" in vectors.schema["embedding"].dataType.simpleString()
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    checked = stored(_checked(vectors, double), "vectors")
    valid = checked.where("body is not null")
    classes = stored(valid.groupBy("body").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    code = Code.for_vectors(classes.count())
    # A vec_id with several vectors may stand for several classes; each is numbered by its place.
    listed = stored(_listed(classes, code, double), "listed")
    partnered = _with_partner(listed)
    rows = (
        listed.drop("sketch").join(partnered, "rep", "left_semi").join(classes, "rep")
        .withColumn("filter", F.explode("filters"))
    )
    cells = in_cells(rows, ["dimension", "filter"], "rep", BLOCK)
    links = stored(_links(cells, double, least), "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(links.select(F.col("rep").alias("a"), F.col("top").alias("b")))
    known = (
        classes.join(counts, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "body",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    result = checked.join(known, "body", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
