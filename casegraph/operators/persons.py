"""Whole person documents: what a cluster's records say, the records themselves, the person's edges, confidence, flags and provenance.

Defined results: a person without edges has empty lists, one without a scored record no confidence; edges without an id
are left out, of those with one id the first by type, source and target stays; edges of types other than CANDIDATE_MATCH are
confirmed. A document's lists are values of its row, so a person's records and edges are together in one task, sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.operators import resolve, sync

# How documents say that they were made.
METHOD, RESOLVED_BY, SCHEMA_VERSION = "phonetic_weighted_score_v1", "personmaster-writer-v1", 1

_RECORD = ("source_key", "role", "case_id", "name", "age", "offence_date", "unit_id", "district_id")
_EDGE = ("edge_type", "source", "target", "edge_id", "confidence", "case_ids")


def _lists(rows: DataFrame, by: str, columns: tuple[str, ...], name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def with_edges(persons: DataFrame, edges: DataFrame, unique: bool = False) -> DataFrame:
    """Persons with ``confirmed_edges`` and ``unconfirmed_edges``: the edges (as ``graph.dedupe`` gives them) that begin at them. ``unique``: no id comes twice, so that edges needn't meet by their ids."""
    candidate = F.upper("edge_type") == "CANDIDATE_MATCH"
    sound = edges.where(F.length("edge_id") > 0)
    if not unique:
        sound = sound.groupBy("edge_id").agg(F.min(F.struct(*(c for c in _EDGE if c != "edge_id"))).alias("e")).select("edge_id", "e.*")
    of = lambda which, name: F.sort_array(F.collect_list(F.when(which, F.struct(*_EDGE)))).alias(name)
    lists = sound.groupBy(F.col("source").alias("person_id")).agg(of(~F.coalesce(candidate, F.lit(True)), "confirmed_edges"), of(candidate, "unconfirmed_edges"))
    out = persons.join(lists, "person_id", "left")
    none = F.expr("filter(array(named_struct('edge_type', '', 'source', '', 'target', '', 'edge_id', '', 'confidence', 0d, 'case_ids', array(''))), x -> false)")
    return out.withColumns({c: F.coalesce(c, none) for c in ("confirmed_edges", "unconfirmed_edges")})


def merge_edges(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Existing edges and those of the new ones whose id wasn't there, the first of each id by type, source and target; and (added, skipped) as one row.

    New edges with a null or empty id are skipped, as are repetitions; existing edges stay as they are, whatever their ids."""
    sound = new.where(F.length("edge_id") > 0)
    first = sound.groupBy("edge_id").agg(F.min_by(F.struct(*(f"`{c}`" for c in new.columns)), F.struct("edge_type", "source", "target", F.xxhash64(*(f"`{c}`" for c in new.columns)))).alias("_e")).select("_e.*")
    added = first.join(existing.where(F.length("edge_id") > 0).select("edge_id").distinct(), "edge_id", "left_anti")
    counts = added.agg(F.count(F.lit(1)).alias("added"), F.lit(1).alias("one")).join(new.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one")), "one")
    return existing.unionByName(added, allowMissingColumns=True), counts.select("added", (F.col("n") - F.col("added")).alias("skipped"))


def gathered(edges: DataFrame) -> DataFrame:
    """One edge an id with the union of its ``case_ids`` and ``source_records`` (arrays, null for none), in order, and its highest confidence."""
    rows = edges.where(F.length("edge_id") > 0)
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast(edges.schema[c].dataType)))))).alias(c)
    one = rows.groupBy("edge_id").agg(F.min(F.struct("edge_type", "source", "target")).alias("e"), F.max("confidence").alias("confidence"), union("case_ids"), union("source_records"))
    return one.select("edge_id", "e.edge_type", "e.source", "e.target", "confidence", "case_ids", "source_records")


def documents(records: DataFrame, clustered: DataFrame, edges: DataFrame, scored: DataFrame, run_id: str | None = None, now: Column | None = None, review: Column | None = None, unique: bool = False) -> DataFrame:
    """One whole document a cluster.

    ``records``: of role tables; ``edges``: between persons, whose ids are those of ``resolve.person_documents``; ``scored``: pairs of records with their
    class, for the confidence; ``review``: a column over the document that says whether a supervisor must look at it (none need by default); ``unique``: no edge's id comes twice."""
    base = resolve.person_documents(records, clustered).drop("records", "source_keys")
    keys = sync.phonetic_keys(records, clustered).withColumnRenamed("phonetic_key", "name_phonetic_key")
    raw = _lists(records.join(clustered, "source_key"), "cluster", _RECORD, "source_records")
    sure = sync.confidences(scored, clustered)[1].withColumnRenamed("confidence", "confidence_score")
    whole = with_edges(base.join(keys, "cluster", "left").join(raw, "cluster", "left").join(sure, "cluster", "left"), edges, unique)
    at = F.current_timestamp() if now is None else now
    return whole.select(
        "cluster", "person_id", F.lit(SCHEMA_VERSION).alias("schema_version"), "name_variants", "name_normalised", "name_phonetic_key", "age_estimate", F.struct(F.col("age_min").alias("min"), F.col("age_max").alias("max")).alias("age_range"), "gender", "source_records",
        F.struct("accused_count", "victim_count", "complainant_count", "total_case_appearances", "first_appearance", "last_appearance").alias("roles_summary"), "confirmed_edges", "unconfirmed_edges", "confidence_score", F.lit(METHOD).alias("resolution_method"),
        F.struct(F.col("repeat_offender"), (F.lit(False) if review is None else F.coalesce(review, F.lit(False))).alias("supervisor_review_pending")).alias("flags"),
        F.struct(at.alias("created_at"), at.alias("last_resolved_at"), F.lit(RESOLVED_BY).alias("resolved_by"), F.lit(run_id).cast("string").alias("resolution_run_id")).alias("meta"),
    )
