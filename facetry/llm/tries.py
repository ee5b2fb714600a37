"""The trie of all beginnings of conversations, with totals of every subtree.

A node is a sequence of turns (role and text) with which at least one conversation begins. Its key is the XOR of 128
random bits for each (place, turn), so the keys of a conversation are running totals (``ordered.running``), its
parent's key takes one step, and a conversation with most of all turns is dealt over many tasks.

Subtree totals come from a *depth-band rollup*. Nodes whose depth is a multiple of ``height`` are *joints*; a band is
what lies between two rows of joints. A node explodes only to its ancestors inside its band and to the joint above,
``height`` rows at most. First each band hands what its nodes hold to the joint above. The joints form a trie of their
own, as deep as there are bands, whose totals are found in the same way (so the number of rounds grows with the
logarithm of the greatest depth). Then a completed joint stands for its whole subtree when its band is rolled up.

Copies of a conversation merge into one path a band, with their number, before paths are opened into nodes. All sums
are pre-aggregated, so a first turn that most conversations share is one row per task.

Rows of any kind: turns follow each other by number (null first), rows of the same number by the MD5 of role and
text; null roles and texts are empty; repeated rows are turns of their own; rows without conv_id belong to no
conversation and are left out; very long texts are hashed and counted whole; conversations of any number of turns;
an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.components import stored
from facetry.llm.ordered import running

WORD = r"[^\x20\x09-\x0D]+"
#: Levels of a band: a node explodes to so many ancestors at most.
HEIGHT = 8
#: Identifiers of conversations that end at one node are hashed in pieces of so many.
PIECE_IDS = 10_000
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place from 0, digest of role and text, and words of the text, for every turn."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.col("turn").isNotNull().cast("int").alias("known"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    ).where("conv_id is not null")
    order = ["known", "turn", "digest"]
    merged = rows.groupBy("conv_id", *order).agg(F.max("words").alias("words"), F.count("*").alias("copies"))
    placed = running(merged, ["conv_id"], order, {"upto": ("sum", "copies")})
    places = F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1)
    return placed.select("conv_id", F.explode(places).alias("place"), "digest", "words")


def _key(first: Column, second: Column) -> Column:
    return F.struct(first.alias("k1"), second.alias("k2"))


def _root() -> Column:
    return _key(F.lit(0).cast("long"), F.lit(0).cast("long"))


def prefix_trie(turns: DataFrame, conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    ``turns`` has conv_id, place (from 0, without gaps), digest and words; ``conversations`` each conv_id once, those
    without turns too.
    """
    bits = [F.xxhash64(F.lit(seed), "place", "digest") for seed in (1, 2)]
    hashed = turns.select("conv_id", "place", "words", bits[0].alias("z1"), bits[1].alias("z2"))
    keyed = running(hashed, ["conv_id"], ["place"], {"k1": ("xor", "z1"), "k2": ("xor", "z2")})
    above = [F.col(f"k{i}").bitwiseXOR(F.col(f"z{i}")) for i in (1, 2)]
    members = keyed.select(
        "conv_id",
        (F.col("place") + 1).alias("depth"),
        _key(F.col("k1"), F.col("k2")).alias("key"),
        _key(*above).alias("parent"),
        "words",
    )
    members = stored(members, "trie_members")

    root = conversations.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    nodes = stored(_nodes(members, height).unionByName(_as_root(root), allowMissingColumns=True), "trie_nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    counted = counted.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    counted = stored(counted.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie_counts")
    deepest = counted.agg(F.max("depth")).first()[0] or 0

    totals = _totals(counted.select("key", "depth", "top", "up", "leaves", "saved"), members, deepest, height)
    last = members.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    ends = conversations.join(last, "conv_id", "left").select(F.coalesce("key", _root()).alias("key"), "conv_id")
    parents = counted.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        counted.select("key", "parent", "conv_id", "depth", "n_convs", "n_children")
        .join(totals, "key")
        .join(_digests(ends), "key", "left")
        .join(parents, "parent", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
    )


def _as_root(row: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return row.select("n_convs", "conv_id", _root().alias("key"), zero.alias("depth"), zero.alias("words"))


def _paths(members: DataFrame, height: int) -> DataFrame:
    """Of every conversation the nodes of each band, from the top: conv_id, path."""
    band = F.floor((F.col("depth") - 1) / height)
    step = F.struct("depth", "key", "parent", F.col("words").cast("long").alias("words"))
    return members.groupBy("conv_id", band.alias("band")).agg(F.sort_array(F.collect_list(step)).alias("path"))


def _nodes(members: DataFrame, height: int) -> DataFrame:
    """Different nodes: key, depth, parent, words, n_convs, conv_id, the joint above (top) and the nodes of the band
    from below it to the node itself (up)."""
    ending = F.element_at("path", -1)["key"].alias("last")
    merged = (
        _paths(members, height)
        .groupBy(ending)
        .agg(F.first("path").alias("path"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    )
    opened = merged.select("n", "conv_id", "path", F.posexplode("path").alias("at", "node")).select(
        "n",
        "conv_id",
        "node.*",
        F.get("path", F.lit(0))["parent"].alias("top"),
        F.slice(F.col("path.key"), F.lit(1), F.col("at") + 1).alias("up"),
    )
    return opened.groupBy("key").agg(
        F.max("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.max("words").alias("words"),
        F.sum("n").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.first("top").alias("top"),
        F.first("up").alias("up"),
    )


def _totals(nodes: DataFrame, members: DataFrame, deepest: int, height: int) -> DataFrame:
    """key, and leaves and saved summed over the subtree of every node.

    ``members`` are the nodes that each conversation passes (conv_id, depth, key, parent, words).
    """
    is_joint = F.col("depth") % height == 0
    home = F.when(is_joint, F.col("key")).otherwise(F.col("top"))
    held = nodes.groupBy(home.alias("key")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    if deepest < height:  # the root is the only joint
        joints = held
    else:
        last = F.element_at("path", -1)
        passed = _paths(members, height).where(last["depth"] % height == 0)
        upper = passed.select(
            "conv_id",
            (last["depth"] / height).cast("long").alias("depth"),
            last["key"].alias("key"),
            F.get("path", F.lit(0))["parent"].alias("parent"),
            F.lit(0).cast("long").alias("words"),
        )
        upper = stored(upper, "trie_joints")
        placed = _nodes(upper, height).select("key", "depth", "top", "up")
        top = nodes.where("depth = 0").select("key", "depth", "top", "up")
        joined = stored(placed.unionByName(top).join(held, "key"), "trie_bands")
        joints = stored(_totals(joined, upper, deepest // height, height), "trie_totals")
    done = joints.select("key", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))
    full = nodes.where("depth > 0").join(done, "key", "left").select(
        F.explode("up").alias("key"),
        F.coalesce("all_leaves", "leaves").alias("leaves"),
        F.coalesce("all_saved", "saved").alias("saved"),
    )
    below = full.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return below.unionByName(joints.where(F.col("key") == _root()).select("key", "leaves", "saved"))


def _digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256: SHA-256 of the conv_ids of each key, in numeric order, joined by commas.

    A digest has to see its text from front to back. The ids are sorted by ranges and written out in pieces, in as many
    tasks as there are ranges; one task then reads the pieces of a key one after the other and holds one at a time.
    """
    ids = ends.select("key.k1", "key.k2", "conv_id")
    blocks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ids = ids.repartitionByRange(blocks, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = sorted_ids.mapInArrow(_pieces, "k1 bigint, k2 bigint, first bigint, text string")
    hashed = (
        pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(
            _hash_pieces, "k1 bigint, k2 bigint, ends_sha256 string"
        )
    )
    return hashed.select(_key(F.col("k1"), F.col("k2")).alias("key"), "ends_sha256")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one key that follow each other, joined by commas, in pieces of bounded length."""
    key, ids = None, []
    rows: list[tuple] = []
    names = ["k1", "k2", "first", "text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def batch() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        made = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        rows.clear()
        return made

    for k1, k2, conv in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        if (k1, k2) != key or len(ids) == PIECE_IDS:
            if ids:
                rows.append((*key, ids[0], ",".join(map(str, ids))))
            key, ids = (k1, k2), []
            if len(rows) == PIECE_IDS or (rows and len(rows[-1][3]) > PIECE_IDS):
                yield batch()
        ids.append(conv)
    if ids:
        rows.append((*key, ids[0], ",".join(map(str, ids))))
    if rows:
        yield batch()


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the pieces of each key, which follow each other in order."""
    key, digest, done = None, None, []
    names = ["k1", "k2", "ends_sha256"]

    def batch() -> pa.RecordBatch:
        made = pa.record_batch([pa.array(c) for c in zip(*done, strict=True)], names)
        done.clear()
        return made

    for k1, k2, _, text in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        if (k1, k2) != key:
            if key is not None:
                done.append((*key, digest.hexdigest()))
            if len(done) == PIECE_IDS:
                yield batch()
            key, digest = (k1, k2), hashlib.sha256()
        else:
            digest.update(b",")
        digest.update(text.encode())
    if key is not None:
        done.append((*key, digest.hexdigest()))
    if done:
        yield batch()
