"""Substring search by trigrams: a table of postings says which rows can hold a word, an exact check says which do.

An index is a folder of three tables. ``texts``: the rows as they came, in folders by the task that wrote them, so that
indexing doesn't shuffle texts. ``postings``: a row for each trigram of a row's text, ranged and sorted by trigram and row, so a
search reads the row groups of its trigrams and a trigram that all texts have lies in many files. ``counts``: in how many
postings each trigram stands.

A search takes the rarest trigrams of each word, intersects their postings, reads only the folders in which a candidate
lies, and checks the candidates exactly; where a word's rarest trigram stands in too many rows, a plain scan is cheaper, and gives
the same rows.

Defined results: case doesn't count; a null text holds no word; a word of less than three letters has no trigram, so a
search for it scans; an empty word is in every text; no words find nothing; repeated rows are found as often as they stand there.
Columns of the rows, whatever their names, come back as they were; ``found`` is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.sources.shared import materialise

#: Characters of a text that are taken apart at once: a long text needn't be held as trigrams.
BLOCK = 4096


def trigrams(text: Column) -> Column:
    """The different runs of three characters of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))


def blocks(text: Column) -> Column:
    """A text cut into blocks that overlap by two characters, so that each run of three lies whole in one."""
    last = F.floor(F.greatest(F.length(text) - 3, F.lit(0)) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * BLOCK + 1, F.lit(BLOCK + 2)))


class Substrings:
    """An index at ``path``; made by ``build``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        read = self.spark.read
        if name == "texts":
            read = read.schema(self.spark.read.parquet(f"{self.path}/schema").schema)
        return read.parquet(f"{self.path}/{name}")

    @classmethod
    def build(cls, rows: DataFrame, text: Column, path: str, folders: int = 256) -> Substrings:
        """Index rows by ``text``, a column over theirs. ``folders``: how many the texts lie in at most."""
        index = cls(rows.sparkSession, path)
        kept = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.lower(text).alias("text"), F.monotonically_increasing_id().alias("number"), (F.spark_partition_id() % folders).alias("folder"))
        kept.limit(0).write.parquet(f"{index.path}/schema")  # folders of no rows would have none
        kept.write.partitionBy("folder").parquet(f"{index.path}/texts")
        block = index.table("texts").where(F.col("text").isNotNull()).select("number", "folder", F.explode(blocks(F.col("text"))).alias("block"))
        postings = block.select(F.explode(trigrams(F.col("block"))).alias("gram"), "number", "folder")
        postings.repartitionByRange("gram", "number").sortWithinPartitions("gram", "number").write.parquet(f"{index.path}/postings")
        counts = index.table("postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{index.path}/counts")
        return index

    def _rarest(self, words: list[str], most: int) -> dict[str, list[tuple[int, str]]] | None:
        """The ``most`` rarest trigrams of each word with their counts, none for a word that no text can hold; None if a word has no trigram. Its rows are those of the question."""
        asked = self.spark.createDataFrame([(w,) for w in words], "word string").select("word", F.explode_outer(trigrams(F.col("word"))).alias("gram"))
        grams: dict[str, list[str]] = {}
        for r in asked.collect():
            if r["gram"] is None:
                return None
            grams.setdefault(r["word"], []).append(r["gram"])
        known = self.table("counts").where(F.col("gram").isin(*{g for gs in grams.values() for g in gs}))
        n = {r["gram"]: r["n"] for r in known.collect()}
        return {w: sorted((n[g], g) for g in gs)[:most] if all(g in n for g in gs) else [] for w, gs in grams.items()}

    def candidates(self, rarest: dict[str, list[tuple[int, str]]]) -> DataFrame:
        """(number, folder, words): the rows that have all the trigrams given for a word, with these words."""
        asked = [(w, g, len(gs)) for w, gs in rarest.items() for _, g in gs]
        wanted = self.spark.createDataFrame(asked, "word string, gram string, needed int")
        held = self.table("postings").where(F.col("gram").isin(*{g for _, g, _ in asked})) if asked else self.table("postings").where("false")
        met = held.join(F.broadcast(wanted), "gram").groupBy("number", "folder", "word", "needed").agg(F.countDistinct("gram").alias("have"))
        return met.where("have = needed").groupBy("number", "folder").agg(F.collect_set("word").alias("words"))

    def search(self, words: list[str], most: int = 4, scan_from: float = 0.1) -> DataFrame:
        """The rows whose text holds one of ``words`` or more, with ``found``: which of them, in order.

        ``most``: trigrams of a word that are looked up; ``scan_from``: the share of rows that may be candidates from which on all are read."""
        words = [r[0] for r in self.spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "w string").select(F.lower("w")).distinct().collect()]
        texts = self.table("texts").where(F.col("text").isNotNull())
        rarest = self._rarest(words, most) if words else {}
        if rarest is None or sum(gs[0][0] for gs in rarest.values() if gs) > scan_from * self.table("texts").count():
            met = texts.withColumn("words", F.array(*(F.lit(w) for w in words)))
        else:
            candidates = materialise(self.candidates(rarest), "candidates")
            folders = [r["folder"] for r in candidates.select("folder").distinct().toLocalIterator()]  # bounded by the index's folders
            near = texts.where(F.col("folder").isin(*folders)) if folders else texts.where("false")
            met = near.join(candidates.drop("folder"), "number")
        found = met.withColumn("found", F.array_sort(F.filter("words", lambda w: F.contains(F.col("text"), w))))
        return found.where(F.size("found") > 0).select("row.*", "found")


def scan(rows: DataFrame, text: Column, words: list[str]) -> DataFrame:
    """What ``search`` finds, without an index: all rows are read."""
    spelt = [w.lower() for w in dict.fromkeys(words)]
    if not spelt:
        return rows.withColumn("found", F.array().cast("array<string>")).where("false")
    found = reduce(lambda a, b: F.concat(a, b), (F.when(F.contains(F.lower(text), F.lit(w)), F.array(F.lit(w))).otherwise(F.array().cast("array<string>")) for w in spelt))
    return rows.withColumn("found", F.array_sort(F.array_distinct(found))).where(F.size("found") > 0)
