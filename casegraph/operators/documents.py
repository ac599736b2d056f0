"""Texts of cases gathered from all their tables: facts of every table in one union, one shuffle by case.

Each table gives facts (case_id, section, place, line): lines with the section they belong to and where they stand in it.
However many tables there are, their facts meet in one exchange on the case; a join for each table would shuffle the cases
as often. Lookup tables are joined to a table's rows before, where they are small enough for Spark to send them round.

Defined results: what is missing is ``N/A``; a section without lines has no title and is left out; lines of the same place
are ordered by their text, and equal ones all stay; facts of cases that aren't there are left out; a case without facts
has its head only. A case's text is one value of its row, so its lines are together in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.sources.tables import id_dictionary

MISSING = "N/A"


def shown(value: Column) -> Column:
    """A value as text; N/A for null and for an empty text."""
    text = value.cast("string")
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, text).otherwise(MISSING)


def line(*parts: str | Column) -> Column:
    """A line of words and values; values that are missing are N/A."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else shown(p) for p in parts))


def also(before: str, value: Column, after: str = "") -> Column:
    """A value between words, nothing at all where it is missing."""
    text = value.cast("string")
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.concat(F.lit(before), text, F.lit(after))).otherwise("")


def facts(rows: DataFrame, case_id: str, section: int, text: Column, place: Column | None = None) -> DataFrame:
    """A line for each row, in a section's order by ``place`` as text (null first); a null line is none."""
    where = F.lit(None).cast("string") if place is None else place.cast("string")
    return rows.select(F.col(case_id).alias("case_id"), F.lit(section).alias("section"), where.alias("place"), text.alias("line")).where(F.col("case_id").isNotNull() & F.col("line").isNotNull())


def case_documents(heads: DataFrame, gathered: list[DataFrame], titles: dict[int, str]) -> DataFrame:
    """(case_id, text): the head of each case and its sections, in order of their numbers, with their titles.

    ``heads``: (case_id, line), one row a case; ``gathered``: results of ``facts``; ``titles``: the sections by number, from 1. A title of
    more than one line is kept as it is; an empty line stands before each section."""
    head = heads.where(F.col("case_id").isNotNull()).select("case_id", F.lit(0).alias("section"), F.lit(None).cast("string").alias("place"), F.col("line"))
    every = reduce(lambda a, b: a.unionByName(b), gathered, head)
    lists = every.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("section", "place", "line"))).alias("all"))
    of = lambda k: F.transform(F.filter("all", lambda x: x["section"] == k), lambda x: x["line"])
    sections = [F.when(F.size(of(k)) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(of(k), "\n"))) for k, title in sorted(titles.items())]
    return lists.where(F.size(of(0)) > 0).select("case_id", F.concat_ws("\n", F.get(of(0), F.lit(0)), *sections).alias("text"))


def batches(documents: DataFrame, per_batch: int = 200, title: str = "CASES") -> DataFrame:
    """(batch, text): documents (case_id, text) numbered from 1 in order of their cases, ``per_batch`` in a text with a header.

    Numbers come from ranges of cases, whose counts are summed before, so no task sees more than a range."""
    numbers = id_dictionary(documents, "case_id").select("case_id", (F.col("id") + 1).alias("n"))
    numbered = documents.join(numbers, "case_id").withColumn("batch", F.expr(f"(n - 1) div {per_batch} + 1"))
    body = F.concat(F.lit("=== CASE "), F.col("n"), F.lit(" ===\n"), F.col("text"))
    lists = numbered.groupBy("batch").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.sort_array(F.collect_list(F.struct("n", body.alias("t")))).alias("all"))
    header = F.concat(F.lit(f"=== {title} ===\n=== BATCH "), F.col("batch"), F.lit(" (Cases "), F.col("lo"), F.lit("-"), F.col("hi"), F.lit(") ===\n\n"))
    return lists.select("batch", F.concat(header, F.array_join(F.transform("all", lambda x: x["t"]), "\n===\n\n")).alias("text"))


def lookup_lines(table: DataFrame) -> DataFrame:
    """(line): each row of a lookup table as ``name: value`` pairs, without those that are missing."""
    pairs = [F.when(F.length(F.col(f"`{c}`").cast("string")) > 0, F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in table.columns]
    return table.select(F.concat(F.lit("  "), F.concat_ws(", ", *pairs)).alias("line"))
