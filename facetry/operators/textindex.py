"""Word search with an index of letter triples.

Every word of a query stands inside one piece of a text without white space, so its triples of letters do too.  The index
lists, for each triple, the addresses of the rows that have it, in the order of the triples, so a search reads the row
groups of a few of them: the rarest, whose lists are shortest.  Rows on all these lists are read by their address and
tested as ever; the others cannot hold the words.

A list has one entry for each block of 64 rows of a file, with a bit for each row.  Tasks that read texts put the bits of
a block together before anything is shuffled, so a triple that most rows have sends one entry for 64 of them, and one that
few rows have never more than one for each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.errors import FacetryError
from facetry.functions.missing import column
from facetry.functions.text import has_words, words_of
from facetry.operators.addresses import FILE, MOST_ADDRESSES, NUMBER, PLACE, at_addresses, with_address

LETTERS = 3
#: Lists that a search reads at most.
MOST_LISTS = 4
ROW_GROUP_BYTES = 4 * 2**20

BLOCK, BITS = "_block", "_bits"
BLOCK_ROWS = 64
#: Each place with two more letters behind it; one letter at a time is passed.
TRIPLES = r"(?=(\S\S\S))\S"


def _triples(text: Column) -> Column:
    """The different triples of letters inside the pieces of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TRIPLES), F.lit(1)))


def _block() -> Column:
    return F.floor(F.col(NUMBER) / BLOCK_ROWS)


def _bit() -> Column:
    """The bit of a row among those of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(NUMBER) % BLOCK_ROWS).cast("int"))


def triples_of(query: str) -> set[str]:
    """The triples that a text with all words of a query has."""
    return {word[i : i + LETTERS] for word in words_of(query) for i in range(len(word) - LETTERS + 1)}


@dataclass(frozen=True)
class TextIndex:
    """The index of one text column of a table of files; a table that is written anew needs a new one."""

    lists: DataFrame
    sizes: DataFrame
    files: DataFrame
    name: str

    def _shortest(self, triples: set[str]) -> tuple[DataFrame, int, int]:
        """Blocks with rows on all of the shortest lists; how many rows and how many blocks these are at most."""
        # One row for each triple of the query.
        found = self.sizes.where(F.col("triple").isin(list(triples))).collect()
        sizes = {r["triple"]: (r["n"], r["blocks"]) for r in found}
        rarest = sorted(triples, key=lambda t: (sizes.get(t, (0, 0)), t))[:MOST_LISTS]
        entries = self.lists.where(F.col("triple").isin(rarest)).groupBy(PLACE, BLOCK)
        blocks = entries.agg(F.count("*").alias("n"), F.bit_and(BITS).alias(BITS))
        shared = blocks.where((F.col("n") == len(rarest)) & (F.col(BITS) != 0)).drop("n")
        return shared, *map(min, zip(*(sizes.get(t, (0, 0)) for t in rarest), strict=True))

    def _addresses(self, blocks: DataFrame) -> DataFrame:
        rows = F.explode(F.sequence(F.lit(0), F.lit(BLOCK_ROWS - 1)).cast("array<long>"))
        numbered = blocks.select(PLACE, BITS, BLOCK, rows.alias("at")).withColumn(NUMBER, F.col(BLOCK) * BLOCK_ROWS + F.col("at"))
        return numbered.where(F.col(BITS).bitwiseAND(_bit()) != 0).join(self.files, PLACE).select(FILE, NUMBER)

    def candidates(self, triples: set[str]) -> tuple[DataFrame, int] | None:
        """Addresses of the rows on the shortest lists, and how many there are at most; nothing without any list."""
        if not triples:
            return None
        blocks, most, _ = self._shortest(triples)
        return self._addresses(blocks), most

    def search(self, df: DataFrame, query: str) -> DataFrame:
        """Rows of ``df`` whose text holds all words of the query; ``df`` has rows of the table that is indexed."""
        test = has_words(column(self.name), query)
        addressed, triples = with_address(df), triples_of(query)
        if not triples or addressed is None:
            return df.where(test)
        blocks, most, most_blocks = self._shortest(triples)
        if most <= MOST_ADDRESSES:
            rows = at_addresses(addressed, self._addresses(blocks).toArrow()).where(test)
        else:
            # The bits and the test are one condition, so rows that are on no list are not tested.
            same_block = (addressed[PLACE] == blocks[PLACE]) & (_block() == F.col(BLOCK))
            held = F.when(F.col(BITS).bitwiseAND(_bit()) != 0, test)
            blocks = F.broadcast(blocks) if most_blocks <= MOST_ADDRESSES else blocks
            rows = addressed.join(blocks, same_block & held, "left_semi")
        return rows.select(*map(column, df.columns))


def build_text_index(df: DataFrame, name: str, path: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write the index of a text column.

    Texts are read once: the ranges of the order are found from the entries of the lists, not from the texts.  A triple
    that most rows have is dealt over many tasks, as lists are cut by address too.  Files are named by a number; should
    two have the same, their rows are on each other's lists, which the test of a search sorts out.
    """
    addressed = with_address(df)
    if addressed is None:
        raise FacetryError("an index needs the rows of files")
    rows = addressed.select(F.explode(_triples(column(name))).alias("triple"), PLACE, _block().alias(BLOCK), _bit().alias(BITS))
    order = ["triple", PLACE, BLOCK]
    entries = rows.groupBy(*order).agg(F.bit_or(BITS).alias(BITS))
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = entries.repartitionByRange(count, *order).sortWithinPartitions(*order)
    lists.write.option("parquet.block.size", row_group_bytes).parquet(f"{path}/lists")
    written = df.sparkSession.read.parquet(f"{path}/lists")
    sizes = written.groupBy("triple").agg(F.sum(F.bit_count(BITS)).alias("n"), F.count("*").alias("blocks"))
    sizes.write.parquet(f"{path}/sizes")
    addressed.select(PLACE, FILE).distinct().write.parquet(f"{path}/files")


def open_text_index(spark: SparkSession, path: str, name: str) -> TextIndex:
    lists, sizes, files = (spark.read.parquet(f"{path}/{part}") for part in ("lists", "sizes", "files"))
    return TextIndex(lists, sizes, files, name)
