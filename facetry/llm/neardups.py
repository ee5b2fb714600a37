"""MinHash near-dedup: an LSH forest whose trees are sorted orders of signatures.

A document's set is its distinct shingles of five words. Documents with equal sets are one class, which its
smallest id stands for. Each class has ``TREES`` x ``DEPTH`` minhashes; tree t sorts the classes by the
minhashes from place t on, and a region is the classes that share the first ``DEPTH`` of them. Candidates are

1. each class with the smallest of its region, the one that most of its regions agree on: one pair per class;
2. each class with the neighbour of the longest common prefix in any tree's order, where the components that
   these links leave still differ;
3. all pairs in a region whose components differ after that. Signatures tell in which region a pair meets first
   and whether it can be a link at all; the classes of such pairs send their full sets, which are compared in
   square cells of bounded size, where products of incidence matrices count the shared shingles. A cell passes on
   which components its links join, never pairs of documents.

So every pair that shares a region and could link two components is looked at, and no pair inside a component
is. A pair at the threshold shares no region in any of the trees with probability (1 - 0.75 ** 4) ** 32, about
five in a million. Candidates are confirmed on full sets, as 64-bit hashes of the shingles.

Rows of any kind: null and empty texts and texts without words have no shingles, link with nothing and are
kept; texts with fewer words than a shingle have one, their whole sequence; rows that share a doc_id are one
document, linked by any of its texts; a row with a null doc_id is compared with nothing, has a null component
and is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from facetry.errors import FacetryError
from facetry.llm.cells import in_cells
from facetry.llm.components import connected_components, stored
from facetry.llm.quality import slices
from facetry.llm.words import U64, cut, mix, shingles

WIDTH = 5
TREES = 32
DEPTH = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BLOCK = 512
#: Places of a signature that agree in a link: seven deviations below the mean at the threshold.
LEAST_AGREEING = 60
_COLUMNS = 2048

_RANDOM = np.random.default_rng(97)
_FLIP = _RANDOM.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) | U64(1)

SIGNED = "doc_id bigint, n_shingles bigint, set_key binary, signature array<bigint>"


def distinct_shingles(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The set of each text, as sorted hashes."""
    hashes, texts = shingles(cut(column, lower=True), width)
    bounds = np.searchsorted(texts, np.arange(len(column) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """For sets that are not empty: ``TREES`` numbers each, of ``DEPTH`` minhashes of 16 bits."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), TREES * DEPTH), np.uint16)
    for k in range(TREES * DEPTH):
        least = np.minimum.reduceat((flat ^ _FLIP[k]) * _TIMES[k], first)
        out[:, k] = (mix(least) >> U64(48)).astype(np.uint16)
    # The first minhash of a tree is the leading one of its number, so that numbers sort by common prefix.
    return np.ascontiguousarray(out.reshape(len(sets), TREES, DEPTH)[:, :, ::-1]).view("<u8").reshape(len(sets), TREES)


def _set_key(hashes: np.ndarray) -> bytes:
    total = np.add.reduce(mix(hashes), dtype=np.uint64)
    other = np.bitwise_xor.reduce(mix(hashes + U64(0x9E3779B97F4A7C15)))
    return total.tobytes() + other.tobytes() + len(hashes).to_bytes(4, "little")


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Size, key and signature of each document's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                sets = distinct_shingles(part["text"], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                signed: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, minhashes([sets[i] for i in full]).astype(np.int64), strict=True):
                        keys[i], signed[i] = _set_key(sets[i]), row
                yield pa.record_batch(
                    [
                        part["doc_id"],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(signed, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "signature"],
                )

    return docs.mapInArrow(sign, SIGNED)


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    sides = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
    sides = sides.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            for begin, end in slices(batch["text_b"]):
                part = batch.slice(begin, end - begin)
                good = []
                for text, other in zip(part["text_a"], distinct_shingles(part["text_b"], width), strict=True):
                    text = text.as_py()
                    if text != last[0]:  # pairs come in the order of a: its set is made once
                        last = (text, distinct_shingles(pa.array([text], pa.string()), width)[0])
                    common = len(np.intersect1d(last[1], other, assume_unique=True))
                    good.append(common > 0 and 100 * common >= percent * (len(last[1]) + len(other) - common))
                keep = pa.array(good, pa.bool_())
                yield pa.record_batch([part["a"].filter(keep), part["b"].filter(keep)], ["a", "b"])

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint").distinct()


def _regions(classes: DataFrame) -> DataFrame:
    """Classes that share a region with others: tree, key, rep, the one before in the tree's order, and the smallest."""
    trees = classes.where(F.col("signature").isNotNull()).select(
        "rep", "signature", F.posexplode("signature").alias("tree", "key")
    )
    trees = trees.select("tree", "key", "rep", F.expr(f"signature[(tree + 1) % {TREES}]").alias("deeper"))
    order = Window.partitionBy("tree", "key").orderBy("deeper", "rep")
    return (
        trees.select(
            "tree",
            "key",
            "rep",
            F.lag("rep").over(order).alias("before"),
            _common_prefix(F.col("deeper"), F.lag("deeper").over(order)).alias("common"),
            F.lead("rep").over(order).alias("after"),
            F.min("rep").over(Window.partitionBy("tree", "key")).alias("top"),
        )
        .where("before is not null or after is not null")
        .drop("after")
    )


def _common_prefix(a: Column, b: Column) -> Column:
    """How many leading minhashes of 16 bits two numbers share."""
    differ = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(differ, 16 * k) == 0).cast("int") for k in range(DEPTH))


def _pairs(frame: DataFrame, x: str, y: str) -> DataFrame:
    return frame.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _labelled(regions: DataFrame, components: DataFrame) -> DataFrame:
    """The members of regions with their components, a class without links being its own."""
    known = components.withColumnsRenamed({"node": "rep"})
    return regions.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _cross_pairs(table: pa.Table, key: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of the two blocks of a cell, and which pairs of them lie in different components."""
    own, component = table["own"].to_numpy(), table["component"].to_numpy()
    left, right = (np.flatnonzero(own == key[i].as_py()) for i in (2, 3))
    return left, right, component[left][:, None] != component[right][None, :]


def _torn_members(regions: DataFrame, components: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (tree, key, rep, component) with a partner in another component that they meet in no tree before."""
    labelled = _labelled(regions.select("tree", "key", "rep"), components)
    torn = (
        labelled.groupBy("tree", "key")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least < most")
        .select("tree", "key")
    )
    signed = classes.select("rep", "signature")
    cells = in_cells(labelled.join(torn, ["tree", "key"]).join(signed, "rep"), ["tree", "key"], "rep", BLOCK)

    def look(key: tuple, table: pa.Table) -> pa.Table:
        left, right, cross = _cross_pairs(table, key)
        trees = table["signature"].combine_chunks().flatten().to_numpy().reshape(-1, TREES)
        places = trees.astype("<i8").view(np.uint16).reshape(len(trees), TREES * DEPTH)
        tree = key[0].as_py()
        has = np.zeros(len(trees), bool)
        for i, row in zip(left, cross, strict=True):
            rest = right[row]
            new = ~(trees[rest, :tree] == trees[i, :tree]).any(1)
            rest = rest[new]
            near = rest[(places[rest] == places[i]).sum(1) >= LEAST_AGREEING]
            has[near] = True
            has[i] |= len(near) > 0
        names = ["tree", "key", "rep", "component"]
        return pa.table([table[name].filter(pa.array(has)) for name in names], names=names)

    kind = "tree int, key bigint, rep bigint, component bigint"
    return cells.groupBy("tree", "key", "low", "high").applyInArrow(look, kind).distinct()


def _torn_links(members: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) of components that a link between two members of a region joins."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                bodies = [s.tobytes() for s in distinct_shingles(part["text"], width)]
                yield pa.record_batch([part["doc_id"], pa.array(bodies, pa.binary())], ["rep", "body"])

    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(sets_of, "rep bigint, body binary")
    cells = in_cells(members.join(sets, "rep"), ["tree", "key"], "rep", BLOCK)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        left, right, cross = _cross_pairs(table, key)
        component = table["component"].to_numpy()
        sets = [np.frombuffer(body, np.uint64) for body in table["body"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        common = _intersections(sets, left, right)
        union = sizes[left][:, None] + sizes[right][None, :] - common
        x, y = np.nonzero(cross & (common > 0) & (100 * common >= percent * union))
        both = np.unique(np.sort(np.stack([component[left[x]], component[right[y]]], 1), axis=1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return cells.groupBy("tree", "key", "low", "high").applyInArrow(compare, "a bigint, b bigint").distinct()


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``: products of blocks of incidence."""
    flat = np.concatenate(sets)
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, number, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[number] > 1
    member, number = member[shared], (np.cumsum(counts > 1) - 1)[number[shared]]
    order = np.argsort(number, kind="stable")
    member, number = member[order], number[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for begin in range(0, int((counts > 1).sum()), _COLUMNS):
        a, b = np.searchsorted(number, [begin, begin + _COLUMNS])
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[member[a:b], number[a:b] - begin] = 1
        out += (has[left] @ has[right].T).astype(np.int64)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept (doc_id = component_id).

    The signatures are made for ``PERCENT``; a lower ``percent`` is refused, as they would lose links.
    """
    if not percent >= PERCENT:
        raise FacetryError(f"percent must be {PERCENT} or more, not {percent}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(signatures(docs, width), "signed")
    least = signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = signed.join(least, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"),
        F.when(F.col("doc_id") == F.col("rep"), F.col("signature")).alias("signature"),
    )
    classes = stored(classes, "classes")
    tops = classes.where("signature is not null")
    regions = stored(_regions(tops), "regions")
    texts = docs.where("doc_id is not null")
    firsts = regions.groupBy("rep", "top").agg(F.count("*").alias("n")).groupBy("rep")
    firsts = firsts.agg(F.max_by("top", F.struct("n", -F.col("top"))).alias("top"))
    links = stored(confirmed(_pairs(firsts, "rep", "top").distinct(), texts, percent, width), "links")
    components = connected_components(links)

    near = regions.where("before is not null").groupBy("rep")
    near = near.agg(F.max_by("before", F.struct("common", -F.col("before"))).alias("before"))
    near = _labelled(near, components)
    other = components.withColumnsRenamed({"node": "before", "component": "component_before"})
    near = near.join(other, "before", "left").where("component <> coalesce(component_before, before)")
    more = stored(_pairs(near, "rep", "before").distinct(), "pairs")
    if not more.isEmpty():
        links = stored(links.unionByName(confirmed(more, texts, percent, width)), "links")
        components = connected_components(links)

    members = stored(_torn_members(regions, components, tops), "torn")
    last = stored(_torn_links(members, texts, percent, width), "last")
    if not last.isEmpty():
        components = connected_components(links.unionByName(last))
    known = components.withColumnRenamed("node", "rep")
    # One document with several texts has several rows and classes; the smallest component counts.
    result = classes.join(known, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
