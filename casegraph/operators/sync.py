"""From role tables to persons and back: source records, full and incremental reconciliation of ids, confidences, arrests, document versions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casegraph.functions import names, scores
from casegraph.operators import resolve

# Codes of gender; role tables with their roles and the prefixes of their ids; the version documents are brought to.
GENDERS = {"1": "M", "2": "F", "3": "O"}
ROLE_TABLES = {"Accused": ("accused", "A-"), "Victim": ("victim", "V-"), "ComplainantDetails": ("complainant", "C-")}
DOCUMENT_VERSION = 3
#: What a change of makes a record changed.
CHECKED = ["name", "age", "case_id", "unit_id", "district_id"]


def source_records(roles: Mapping[str, tuple[DataFrame, str, str]], cases: DataFrame, units: DataFrame) -> DataFrame:
    """One row a person in a case, of all role tables.

    ``roles``: of a table's name (a key of ROLE_TABLES), the table, its id and its name column; each has case_id, age and
    gender_code. ``cases``: case_id, offence_date, unit_id, lat, lon; ``units``: unit_id, district_id. Rows without a case or the
    case's unit are left out, as inner joins do."""
    place = cases.join(units.select("unit_id", F.col("district_id").cast("string").alias("district_id")), "unit_id")
    known = F.create_map(*(F.lit(x) for kv in GENDERS.items() for x in kv))
    code = F.coalesce(F.col("gender_code").cast("string"), F.lit(""))

    def rows(table: str, df: DataFrame, key: str, name: str) -> DataFrame:
        role, prefix = ROLE_TABLES[table]
        return df.select(
            F.concat(F.lit(f"{table}:{prefix}"), F.col(key).cast("string")).alias("source_key"), F.lit(table).alias("source_table"), F.lit(role).alias("role"),
            F.coalesce(F.col(name), F.lit("")).alias("raw"), F.col("age").cast("double").alias("age"), F.coalesce(known[code], code).alias("gender"), "case_id",
        )

    every = reduce(lambda a, b: a.unionByName(b), (rows(t, *x) for t, x in roles.items()))
    out = every.join(place, "case_id")
    return out.withColumn("name", names.normalise_latin(F.col("raw"))).select("source_key", "source_table", "role", "raw", "name", "age", "gender", F.col("case_id").cast("string").alias("case_id"), F.col("unit_id").cast("string").alias("unit_id"), "district_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("offence_date").cast("string").alias("offence_date"))


def record_key(record: Column) -> Column:
    """The key of a stored record (a struct with table, source_table, role, source_id, row_id): its table, or its role's, and its id; null if either is missing."""
    some = lambda *names: F.coalesce(*(F.when(F.length(record[n]) > 0, record[n]) for n in names))
    by_role = F.create_map(*(F.lit(x) for t, (r, _) in ROLE_TABLES.items() for x in (r, t)))
    return F.concat(F.coalesce(some("table", "source_table"), by_role[F.lower(record["role"])]), F.lit(":"), some("source_id", "row_id"))


def ground_truth(truth: DataFrame, persons: DataFrame) -> DataFrame:
    """Persons (person_id, source_keys) against true identities (source_key, identity): one row of pairwise measures, purity and the share of true records that persons hold."""
    held = persons.select(F.col("person_id").alias("label"), F.explode("source_keys").alias("key"))
    real = truth.select(F.col("source_key").alias("key"), F.col("identity").alias("label"))
    found = real.join(held.select("key").distinct().withColumn("there", F.lit(1)), "key", "left").agg(scores.half_up(F.coalesce(F.count("there") / F.count(F.lit(1)), F.lit(0.0)), 4).alias("coverage"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(resolve.pair_metrics(real, held)).join(one(resolve.purity(real, held)), "one").join(one(found), "one").drop("one")


def confidences(scored: DataFrame, clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of records (source_key, confidence): the mean score of their confirmed pairs; of clusters (cluster, confidence): the mean over their records that have one."""
    confirmed = scored.where(F.col("decision") == "CONFIRMED")
    ends = confirmed.select(F.col("a").alias("source_key"), "score").unionByName(confirmed.select(F.col("b").alias("source_key"), "score"))
    per_record = ends.groupBy("source_key").agg(scores.half_up(F.avg("score"), 2).alias("confidence"))
    per_cluster = clustered.join(per_record, "source_key", "left").groupBy("cluster").agg(scores.half_up(F.avg("confidence"), 2).alias("confidence"))
    return per_record, per_cluster


def last_arrests(records: DataFrame, clustered: DataFrame, arrests: DataFrame) -> DataFrame:
    """(cluster, last_arrest_date): of the arrests (source_key, arrest_date) of a cluster's accused, the latest."""
    accused = records.where(F.col("role") == "accused").select("source_key").join(clustered, "source_key")
    return accused.join(arrests, "source_key").groupBy("cluster").agg(F.max("arrest_date").alias("last_arrest_date"))


def phonetic_keys(records: DataFrame, clustered: DataFrame) -> DataFrame:
    """(cluster, phonetic_key): the commonest key of a cluster's names, the first by source_key among equals."""
    keyed = resolve.with_key(records).join(clustered, "source_key")
    return resolve.commonest(keyed, "cluster", "block_key", "source_key").withColumnRenamed("block_key", "phonetic_key")


def overlaps(clustered: DataFrame, owners: DataFrame) -> DataFrame:
    """(cluster, person_id, overlap): how many of a cluster's records a person holds already."""
    return clustered.join(owners.select("source_key", "person_id"), "source_key").groupBy("cluster", "person_id").agg(F.count(F.lit(1)).alias("overlap"))


def fates(clustered: DataFrame, owners: DataFrame, held: DataFrame) -> DataFrame:
    """(person_id, fate) of every id there was: kept by a cluster, merged into another person, or stale, without a record in any cluster.

    ``held``: the clusters with the ids that ``resolve.keep_ids`` or ``incremental`` gave them."""
    seen = overlaps(clustered, owners).select("person_id").distinct().withColumn("seen", F.lit(True))
    kept = held.select("person_id").distinct().withColumn("kept", F.lit(True))
    every = owners.select("person_id").distinct().join(seen, "person_id", "left").join(kept, "person_id", "left")
    return every.select("person_id", F.when(F.col("kept"), "kept").when(F.col("seen"), "merged").otherwise("stale").alias("fate"))


def incremental(clustered: DataFrame, owners: DataFrame, new_id: Column | None = None) -> DataFrame:
    """(cluster, person_id, claim) of each cluster of changed records; each id goes to one cluster at most.

    An id that overlaps one cluster only claims it first (of several such ids the one with the largest overlap, then the
    least). An id that overlaps several was split: it goes to the one with the largest overlap, then with the least list of
    source keys, unless that is claimed. What is left gets a new id, from its source keys. claim: 'sole', 'split' or 'new'."""
    keys = clustered.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_set(F.col("source_key").cast("string"))), "|").alias("keys"))
    met = overlaps(clustered, owners).join(keys, "cluster")
    met = met.withColumn("clusters", F.count(F.lit(1)).over(Window.partitionBy("person_id")))
    first = lambda df, by, *order: df.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("r = 1").drop("r")
    sole = first(met.where("clusters = 1"), "cluster", F.desc("overlap"), "person_id").select("cluster", "person_id", F.lit("sole").alias("claim"))
    best = first(met.where("clusters > 1"), "person_id", F.desc("overlap"), "keys").join(sole, "cluster", "left_anti")
    split = first(best, "cluster", F.desc("overlap"), "person_id").select("cluster", "person_id", F.lit("split").alias("claim"))
    out = keys.join(sole.unionByName(split), "cluster", "left")
    return out.select("cluster", F.coalesce("person_id", new_id if new_id is not None else scores.crc_id("PM_", F.col("keys"))).alias("person_id"), F.coalesce("claim", F.lit("new")).alias("claim"))


def rebuilt_records(records: DataFrame, held: DataFrame, clustered: DataFrame, old_records: DataFrame, orphans: DataFrame) -> DataFrame:
    """The records of every person that ``held`` names, with ``person_id`` and ``state``: new, changed or unchanged.

    A person has its cluster's records, as they are now, and those that it had before and that are neither in the cluster
    nor orphaned (``old_records``: as records, with person_id). It is unchanged if its keys and all that CHECKED names are."""
    checksum = lambda df: F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CHECKED))  # noqa: E731, ARG005
    now = records.join(clustered, "source_key").join(held.select("cluster", "person_id"), "cluster").drop("cluster")
    cols = [c for c in records.columns if c in old_records.columns]
    # what any cluster holds now isn't an old record of its former person
    rest = old_records.join(held.select("person_id").distinct(), "person_id", "left_semi").join(clustered.select("source_key"), "source_key", "left_anti").join(orphans.select("source_key"), "source_key", "left_anti")
    merged = now.select("person_id", *cols).unionByName(rest.select("person_id", *cols))
    mark = lambda df: df.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("source_key", "_c")).alias("h"), F.sum(F.xxhash64(F.lit(1), "source_key", "_c").cast("decimal(38,0)")).alias("s"))
    after = mark(merged.withColumn("_c", checksum(merged)))
    before = mark(old_records.withColumn("_c", checksum(old_records))).select("person_id", F.col("n").alias("n0"), F.col("h").alias("h0"), F.col("s").alias("s0"))
    same = (F.col("n") == F.col("n0")) & (F.col("h") == F.col("h0")) & (F.col("s") == F.col("s0"))
    state = after.join(before, "person_id", "left").select("person_id", F.when(F.col("n0").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("state"))
    return merged.join(state, "person_id")


def full(records: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A full run: records are scored, clustered by confirmed pairs, and clusters keep or get ids: (clustered, ids, fates)."""
    confirmed = resolve.scored(resolve.pairs(resolve.with_letters(resolve.with_key(records))), least=scores.CONFIRMED)
    clustered = resolve.clusters(records, confirmed)
    ids = resolve.keep_ids(clustered, owners, scores.crc_id("PM_", F.array_join("keys", "|")))
    return clustered, ids, fates(clustered, owners, ids)


def migrate(documents: DataFrame) -> DataFrame:
    """Person documents of any version brought to DOCUMENT_VERSION, with ``changed``: missing counts and flags get their
    defaults, spellings stand once in their order and without empty ones; a document without any has its plain name.

    Fields: person_id, schema_version, name_variants, name_normalised, source_keys, accused_count, victim_count,
    complainant_count, total_case_appearances, repeat_offender, supervisor_review_pending, last_synced_at; a missing column
    is a missing field."""
    have = lambda c, t: F.col(c).cast(t) if c in documents.columns else F.lit(None).cast(t)
    n_records = F.greatest(F.size(have("source_keys", "array<string>")), F.lit(0))
    spellings = F.array_distinct(F.filter(have("name_variants", "array<string>"), lambda v: F.length(v) > 0))
    name = have("name_normalised", "string")
    accused = F.coalesce(have("accused_count", "int"), F.lit(0))
    new = {
        "schema_version": F.greatest(F.coalesce(have("schema_version", "int"), F.lit(1)), F.lit(DOCUMENT_VERSION)), "accused_count": accused, "victim_count": F.coalesce(have("victim_count", "int"), F.lit(0)), "complainant_count": F.coalesce(have("complainant_count", "int"), F.lit(0)),
        "total_case_appearances": F.coalesce(have("total_case_appearances", "int"), n_records), "repeat_offender": F.coalesce(have("repeat_offender", "boolean"), accused >= 2), "supervisor_review_pending": F.coalesce(have("supervisor_review_pending", "boolean"), F.lit(False)),
        "name_variants": F.when(F.size(spellings) > 0, spellings).when(F.length(name) > 0, F.array(name)).otherwise(have("name_variants", "array<string>")), "last_synced_at": F.coalesce(have("last_synced_at", "timestamp"), F.current_timestamp()),
    }
    kinds = {"schema_version": "int", "repeat_offender": "boolean", "supervisor_review_pending": "boolean", "name_variants": "array<string>", "last_synced_at": "timestamp"}
    same = reduce(lambda a, b: a & b, (have(c, kinds.get(c, "int")).eqNullSafe(v) for c, v in new.items() if c != "last_synced_at"), have("last_synced_at", "timestamp").isNotNull())
    return documents.select(*(c for c in documents.columns if c not in new), *(v.alias(c) for c, v in new.items()), (~same).alias("changed"))


def edge_shape(edges: DataFrame) -> DataFrame:
    """Stored edges with ``shape``: canonical (edge_type, target_person_id), semi (with_person_id, type), legacy (with_person_id alone) or invalid."""
    has = lambda c: F.col(c).isNotNull() if c in edges.columns else F.lit(False)
    old = has("with_person_id") & ~has("edge_type")
    return edges.withColumn("shape", F.when(has("edge_type") & has("target_person_id"), "canonical").when(old & has("type"), "semi").when(old, "legacy").otherwise("invalid"))


def convert_edges(edges: DataFrame) -> DataFrame:
    """Candidate edges stored with a person (person_id and what ``edge_shape`` looks at) in one form: edge_type, source, target, confidence, edge_id, shape.

    Older shapes become CANDIDATE_MATCH with a confidence of one half where there is none; their ids don't depend on which end stored them. Invalid ones go."""
    from casegraph.operators.graph import edge_id

    col = lambda c, t="string": F.col(c).cast(t) if c in edges.columns else F.lit(None).cast(t)
    shaped, new = edge_shape(edges).where("shape <> 'invalid'"), F.col("shape") == "canonical"
    out = shaped.select("shape", F.when(new, F.upper(col("edge_type"))).otherwise("CANDIDATE_MATCH").alias("edge_type"), F.col("person_id").alias("source"), F.when(new, col("target_person_id")).otherwise(col("with_person_id")).alias("target"), F.coalesce(col("confidence", "double"), F.lit(0.5)).alias("confidence"), F.when(F.col("shape") != "legacy", col("edge_id")).alias("edge_id"))
    return out.withColumn("edge_id", F.coalesce("edge_id", edge_id(F.col("edge_type"), F.least("source", "target"), F.greatest("source", "target"), F.lit(""))))
