import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import graph, persons, resolve
from casegraph.plans import catalogue


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def shared(spark):
    """Persons of cases, rows repeated, nulls among them, and one case with most persons."""
    rnd = random.Random(3)
    seen = [(f"P{rnd.randint(0, 30):02}" if rnd.random() > 0.02 else None, rnd.choice(["hot", None, *"abcdefgh"]) if i % 3 else "hot") for i in range(200)]
    return spark.createDataFrame([*seen, ("P90", "z"), ("P91", "z"), ("P99", "y")], "person_id string, case_id string")


def test_groups_hold_each_edge_once_at_any_size(spark, shared):
    own = {tuple(r) for r in shared.dropna().collect()}
    want = sorted((c, p, q) for p, c in own for q, e in own if c == e and p != q)
    for cell in (3, 20, 500):
        met = graph.groups(shared, "case_id", cell)
        assert rows(graph.ways(met, "case_id")) == want
        pair = {}
        for c, p, q in want:
            pair.setdefault((p, q), []).append(c)
        assert rows(graph.shared_values(met, "case_id")) == sorted((p, q, len(c), min(c)) for (p, q), c in pair.items())
        nodes = shared.where("person_id is not null").select("person_id").distinct()
        edges = graph.co_accused_of(met)
        assert rows(graph.component_sizes(nodes, edges, graph.star(met))) == rows(graph.component_sizes(nodes, edges))
        assert rows(graph.statistics(nodes, edges, graph.star(met), unique=True)) == rows(graph.statistics(nodes, edges))
    assert rows(graph.co_accused(shared), "case_id", "source", "target") == want


def test_edges_are_never_written(spark, sf, monkeypatch):
    """Neither by statistics nor by a traversal: what is written has fewer rows than there are edges."""
    most = catalogue.queries()["co_accused_edges"](spark, sf).count()
    written = {}
    put = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (out := put(df, name), written.update({name: out.count()}))[0])
    monkeypatch.setattr(catalogue, "materialise", lambda df, name: pytest.fail(f"{name} are written"))
    for query in ("graph_stats", "graph_elements", "edge_dedupe"):
        catalogue.queries()[query](spark, sf).count()
    assert set(written) == {"hot", "groups", "front"} and max(written.values()) < most / 4


def test_edges_of_single_ids_need_no_meeting_by_id(spark, shared):
    edges = graph.co_accused(shared).withColumn("edge_type", F.when(F.col("case_id") < "d", "CANDIDATE_MATCH").otherwise(F.col("edge_type"))).withColumn("case_ids", F.array("case_id"))
    some = shared.select("person_id").where("person_id is not null").distinct()
    assert rows(persons.with_edges(some, edges, unique=True)) == rows(persons.with_edges(some, graph.dedupe(edges)))


def test_person_master_pairs_no_records(spark, sf, monkeypatch):
    monkeypatch.setattr(resolve, "pairs", lambda *_, **__: pytest.fail("records of a block are paired"))
    assert catalogue.queries()["person_master"](spark, sf).count() > 0
