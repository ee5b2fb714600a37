"""The queries of this subpackage over the given tables."""

from __future__ import annotations

import public_tokenizers
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.bpe import encode_decode
from facetry.llm.chat import format_windows, read_back
from facetry.llm.components import stored
from facetry.llm.decontamination import contaminated
from facetry.llm.language import score_texts
from facetry.llm.neardups import near_duplicates
from facetry.llm.periods import find_runs
from facetry.llm.quality import score_quality
from facetry.llm.registry import ORACLE, QUERIES, query
from facetry.llm.spherical import near_vectors
from facetry.llm.sql import CHAT_SQL, NEAR_SQL, TRIE_SQL, URLS_SQL, VECTORS_SQL
from facetry.llm.substrings import remove_repeated_windows
from facetry.llm.suffixes import remove_repeated_bytes
from facetry.llm.toxicity import score_toxicity
from facetry.llm.tries import numbered_turns, prefix_trie
from facetry.llm.urls import judge_urls

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf, "documents"), digest=True)


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return encode_decode(table(spark, sf, "documents"), RANKS, PATTERN, digest=True)


@query("op3_spherical_filters", VECTORS_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf, "documents"), digest=True)


@query("op5_brown_classes")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return score_texts(table(spark, sf, "documents"))


@query("op6_quality_votes")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_lsh_forest", NEAR_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query("op8_decontamination")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op9_chat_windows", CHAT_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_back(format_windows(turns)).select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


@query("op10_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op11_url_rules", URLS_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    return judge_urls(table(spark, sf, "pages"), known)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return find_runs(with_planted_periods(table(spark, sf, "documents")), digest=True)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The documents; those whose crc32(doc_id) ends in 0 go on from some word with a repeated passage of their own."""
    number = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    chosen = docs.withColumn("g", F.floor(number / 10)).withColumn("words", F.when(number % 10 == 0, words))
    n, g = F.size("words"), F.col("g")
    begin = F.when(n > 0, F.pmod(g, n)).cast("int")
    period = (1 + F.floor((n - begin) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    unit = F.slice("words", begin + 1, period)
    tail = F.flatten(F.array_repeat(unit, F.ceil((n - begin) / period).cast("int")))
    planted = F.concat(F.slice("words", F.lit(1), begin), F.slice(tail, F.lit(1), n - begin))
    text = F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text"))
    return chosen.select("doc_id", text.alias("text"))


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(*with_shared_beginnings(numbered_turns(table(spark, sf, "conversations"))))


def with_shared_beginnings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations; the first crc32(conv_id) % 4 turns come from the first conversation of each twenty."""
    taken = F.crc32(F.col("conv_id").cast("string")) % 4
    family = F.col("conv_id") - F.pmod("conv_id", F.lit(20))
    turns = stored(turns.withColumn("taken", taken).withColumn("family", family), "turns")
    sizes = turns.groupBy("conv_id", "taken", "family").agg(F.max("place").alias("last"))
    heads = turns.where((F.col("family") == F.col("conv_id")) & (F.col("place") < 3))
    heads = heads.select("family", "place", "digest", "words")
    offered = heads.groupBy("family").agg(F.max("place").alias("offered"))
    begun = F.least("taken", F.coalesce(F.col("offered") + 1, F.lit(0)))
    convs = stored(sizes.join(offered, "family", "left").withColumn("begun", begun), "conversations")
    first = convs.join(heads, "family").where("place < taken").select("conv_id", "place", "digest", "words")
    rest = turns.where("place >= taken").join(convs.select("conv_id", "begun"), "conv_id")
    rest = rest.select("conv_id", (F.col("place") - F.col("taken") + F.col("begun")).alias("place"), "digest", "words")
    return first.unionByName(rest), convs.select("conv_id")


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(ORACLE)
