"""Whole person documents, merged edges, lookups by role, follow-up questions."""

import pytest
from pyspark.sql import functions as F

from casegraph.operators import dashboard, persons, retrieval

EDGE = "edge_id string, edge_type string, source string, target string, confidence double, case_ids array<string>"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def test_documents_hold_records_edges_flags_and_provenance(spark):
    kind = "source_key string, name string, age int, gender string, role string, case_id string, offence_date string, unit_id string, district_id string"
    records = spark.createDataFrame([("a", "Asha Rao", 30, "F", "accused", "1", "2024-01-02", "u", "d"), ("b", "asha rao", 31, "F", "accused", "2", "2024-01-01", "u", "d"), ("c", "Ravi", None, None, "victim", "1", None, None, None)], kind)
    clustered = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "source_key string, cluster string")
    ids = {r["cluster"]: r["person_id"] for r in persons.resolve.person_documents(records, clustered).collect()}
    edges = spark.createDataFrame([("e1", "CO_ACCUSED", ids["a"], ids["c"], 1.0, ["1"]), ("e1", "CO_ACCUSED", ids["a"], ids["c"], 1.0, ["1"]), ("e2", "CANDIDATE_MATCH", ids["a"], ids["c"], 0.6, None), (None, "CO_ACCUSED", ids["a"], "x", 1.0, None)], EDGE)
    scored = spark.createDataFrame([("a", "b", 0.84, "CONFIRMED"), ("a", "c", 0.6, "UNCONFIRMED")], "a string, b string, score double, decision string")
    docs = {r["cluster"]: r for r in persons.documents(records, clustered, edges, scored, run_id="r1", review=F.size("unconfirmed_edges") > 0).collect()}
    a, c = docs["a"], docs["c"]
    assert [r["source_key"] for r in a["source_records"]] == ["a", "b"] and a["source_records"][0]["name"] == "Asha Rao"
    assert [e["edge_id"] for e in a["confirmed_edges"]] == ["e1"] and [e["edge_id"] for e in a["unconfirmed_edges"]] == ["e2"] and c["confirmed_edges"] == c["unconfirmed_edges"] == []
    assert tuple(a["flags"]) == (True, True) and tuple(c["flags"]) == (False, False)
    assert a["confidence_score"] == 0.84 and c["confidence_score"] is None
    assert tuple(a["roles_summary"])[:4] == (2, 0, 0, 2) and tuple(a["age_range"]) == (30, 31)
    assert a["meta"]["resolution_run_id"] == "r1" and a["meta"]["created_at"] == a["meta"]["last_resolved_at"] and a["schema_version"] == 1


def test_edges_come_in_by_unseen_id(spark):
    old = spark.createDataFrame([("1", "CO_ACCUSED", "a", "b", 1.0, ["x"]), (None, "CO_ACCUSED", "q", "r", 1.0, None)], EDGE)
    new = spark.createDataFrame([("1", "CO_ACCUSED", "a", "b", 0.5, ["y"]), ("2", "CO_ACCUSED", "b", "c", 1.0, None), ("2", "CO_ACCUSED", "b", "a", 1.0, None), (None, "CO_ACCUSED", "d", "e", 1.0, None), ("", "CO_ACCUSED", "d", "e", 1.0, None)], EDGE)
    merged, counts = persons.merge_edges(old, new)
    assert rows(merged, "edge_id", "source", "target", "confidence") == rows(spark.createDataFrame([("1", "a", "b", 1.0), (None, "q", "r", 1.0), ("2", "b", "a", 1.0)], "edge_id string, source string, target string, confidence double"))
    assert rows(counts) == [(1, 4)]
    merged, counts = persons.merge_edges(old, new.where("false"))
    assert merged.count() == 2 and rows(counts) == [(0, 0)]


def test_edges_of_one_id_gather_cases_and_records(spark):
    kind = EDGE + ", source_records array<struct<t:string,id:int>>"
    e = spark.createDataFrame([("1", "CO_ACCUSED", "a", "b", 0.5, ["2", "1"], [("A", 1)]), ("1", "CO_ACCUSED", "a", "b", 0.9, ["2", "3"], [("A", 1), ("A", 0)]), ("1", "CO_ACCUSED", "a", "b", 0.9, None, None), (None, "X", "a", "b", 1.0, None, None)], kind)
    assert rows(persons.gathered(e)) == [("1", "CO_ACCUSED", "a", "b", 0.9, ["1", "2", "3"], [("A", 0), ("A", 1)])]


def test_a_lookup_takes_ten_of_each_role(spark):
    role = lambda lo, hi: spark.range(lo, hi).select("id", F.concat(F.lit("Name "), F.when(F.col("id") % 2 == 0, F.upper(F.lit("x"))).otherwise("x"), F.floor(F.col("id") / 2)).alias("name"))
    roles = {"accused": role(0, 40), "victim": role(100, 104), "complainant": role(0, 4)}
    got = [tuple(r) for r in dashboard.role_search(roles, " NAME ").collect()]
    assert [g[1] for g in got] == ["0", "2", "4", "6", "8", "100", "102"] and got[0] == ("Name X0", "0")
    assert dashboard.role_search(roles, "name", limit=3).count() == 3
    assert dashboard.role_search(roles, "  ").count() == dashboard.role_search(roles, None).count() == 0
    with pytest.raises(ValueError):
        dashboard.role_search(roles, "x' OR '1")


def test_a_follow_up_knows_the_last_question_and_sql(spark):
    kind = "session int, at int, role string, text string, query_context string"
    t = spark.createDataFrame([(1, 1, "user", "first", None), (1, 2, "assistant", "x", "SELECT 1"), (1, 3, "user", "second", None), (1, 4, "assistant", "y", ""), (1, 5, "user", "", None), (2, 1, "user", "alone", "SELECT 9"), (3, 1, "assistant", "z", "SELECT 3")], kind)
    assert rows(retrieval.follow_up(t), "session", "question", "sql") == [(1, "second", "SELECT 1"), (2, "alone", None), (3, None, "SELECT 3")]
    assert [r["hint"] for r in retrieval.follow_up(t).orderBy("session").collect()] == ["Follows second with SELECT 1", None, None]
