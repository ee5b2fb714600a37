"""From raw documents to tokens: five stages, each written as Parquet and read by the next.

1. quality: documents that the votes of labelled neighbours reject go.
2. near_duplicates: of each group of near duplicates the document with the smallest id stays.
3. repeats: bytes of 50-byte strings that an earlier document has go; a document of which nothing is left goes.
4. decontamination: documents with passages of the benchmark go.
5. tokens: byte-level BPE ids of what is left, and the text that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.bpe import encode_decode
from facetry.llm.components import stored
from facetry.llm.decontamination import contaminated
from facetry.llm.neardups import near_duplicates
from facetry.llm.quality import THRESHOLD, score_rows
from facetry.llm.suffixes import remove_repeated_bytes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of text that a worker gets at once, and of a chunk of the repeats: stages follow each other in the same workers,
#: whose memory is that of the largest.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * 2**20))
CHUNK_BYTES = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Empty texts score as the labelled sample does on average."""
    spark.conf.set(*BATCH)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_rows(docs.select(*COLUMNS), labels).where(F.col("score") >= THRESHOLD).drop("score")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group. Documents without words or without id all stay."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that earlier ones have; those that had text and lost all of it go."""
    marked = docs.withColumn("given", F.col("text").isNotNull())
    left = remove_repeated_bytes(marked, chunk_bytes=CHUNK_BYTES, carry=("lang", "source", "n_chars", "given"))
    left = left.where("n_removed = 0 or octet_length(text) > 0").withColumn("text", F.when(F.col("given"), F.col("text")))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed.cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Documents without id are compared too, but cannot be named and stay."""
    hits = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select(*COLUMNS).join(hits.select("doc_id").distinct(), "doc_id", "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document."""
    return encode_decode(docs, RANKS, public_tokenizers.PATTERN, remember=False)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate_groups),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL cannot state the classifier and the tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
