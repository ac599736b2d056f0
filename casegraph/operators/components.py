"""Connected components of a table of links: tasks join up their own links, then the graph of what they found shrinks each round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.sources.shared import materialise

#: Links that a task joins up.
LINKS_A_TASK = 500_000
#: Rows of the smaller side are repeated so often, so that a label that a third of all nodes share spans as many tasks.
SALTS = 16


def spread_join(rows: DataFrame, by: str, table: DataFrame, key: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """``rows`` with the row of ``table`` whose ``key`` (unique) is their ``by``: a hot value of ``by`` is dealt to ``salts`` tasks."""
    salted = table.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(salts)))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return dealt.join(salted, (dealt[by] == salted[key]) & (dealt["_salt"] == salted["_salt"]), how).drop("_salt")


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows shuffled to the session's number of tasks, however few bytes they have: for steps that make much of each row."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the nodes of a task's links: the least node that these links lead to."""
    above: dict = {}

    def root(x):
        way = []
        while (up := above.setdefault(x, x)) != x:
            way.append(x)
            x = up
        for w in way:
            above[w] = x
        return x

    kind = pa.null()
    for b in batches:
        kind = b.schema.field("a").type
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                above[max(x, y)] = min(x, y)
    nodes = list(above)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node that it is connected with.

    Links are dealt to tasks of about LINKS_A_TASK by the end that comes first in an order drawn anew each round, and
    each task joins up its own. Where one task is enough, that is the result. Else a node moves to the first of the roots
    that tasks found for it, and the links between its roots make the next, smaller graph: every node that is last among
    its neighbours is gone from it. Where the nodes went is composed, and the least node of each end point names the
    component. Each round is written to the shared folder; nothing is collected."""
    node = dict(links.dtypes)["a"]
    edges = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    moves: list[DataFrame] = []
    while n := edges.count():
        tasks = -(-n // LINKS_A_TASK)
        place = lambda c: F.xxhash64(F.lit(len(moves)), F.col(c))  # noqa: B023, E731
        dealt = edges.repartition(tasks, F.when(place("a") < place("b"), F.col("a")).otherwise(F.col("b"))) if tasks > 1 else edges.repartition(1)
        found = dealt.mapInArrow(_joined_up, f"node {node}, root {node}")
        if tasks == 1:
            moves.append(materialise(found.withColumnRenamed("root", "to"), "moves"))
            break
        roots = materialise(found.groupBy("node").agg(F.min("root").alias("to"), F.collect_set("root").alias("roots")), "moves")  # a root a task at most
        moves.append(roots.select("node", "to"))
        edges = roots.where(F.size("roots") > 1).select("to", F.explode("roots").alias("root")).where("to <> root")
        edges = materialise(edges.select(F.least("to", "root").alias("a"), F.greatest("to", "root").alias("b")).distinct(), "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    at = moves[0]
    if len(moves) == 1:
        return at.withColumnRenamed("to", "component")
    for later in moves[1:]:
        at = spread_join(at, "to", later.select(F.col("node").alias("n"), F.col("to").alias("next")), "n").select("node", F.coalesce("next", "to").alias("to"))
    at = materialise(at, "roots")
    least = at.groupBy("to").agg(F.min("node").alias("component")).withColumnRenamed("to", "root")
    return spread_join(at, "to", least, "root", "inner").select("node", "component")
