"""Reconciliation as a stream: batches of changed records keep persons up to date, each batch exactly once.

State is a ``Store``: records by key and by block, members and links by cluster, persons by id. A batch looks up the buckets that its
keys, blocks and clusters fall into, scores only pairs with a changed record, relabels only clusters that links or
records came to or went from, and rebuilds only their persons. All tables change with one rename, which puts the batch's number into the ledger
as well; so a batch that is played again after a failure finds either nothing of itself or its number.

Events: the fields of a record (RECORD), ``deleted`` and ``at``, an order of events. Defined results: of the events of a key within a batch the latest
counts (of equal ones by a hash of the row); deleting a record that isn't there and events that change nothing have no
effect; a record without a name is in no block and stays a person of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions import names
from casegraph.operators import incremental, resolve, sync
from casegraph.sources.shared import materialise
from casegraph.sources.store import BUCKETS, Store, Transaction
from casegraph.sources.tables import Conflict
from casegraph.streaming.incremental import each_batch

RECORD = "source_key string, role string, name string, age double, gender string, unit_id string, district_id string, lat double, lon double, case_id string, offence_date string"
_FIELDS = [c.split()[0] for c in RECORD.split(", ")]
_LINK = "cluster string, a string, b string, score double, decision string"


def _rows(change: Transaction, table: str, wanted: DataFrame, schema: str) -> DataFrame:
    """The rows that agree with ``wanted`` in all its columns, from the buckets that they fall into."""
    if not change.has(table):
        return change.store.spark.createDataFrame([], schema)
    found = change.read_for(table, wanted)
    return found.join(wanted.distinct(), wanted.columns, "left_semi").select(*(c.split()[0] for c in schema.split(", ")))


def apply_batch(change: Transaction, events: DataFrame, key: Column | None = None, buckets: int = BUCKETS) -> None:
    """Write what a batch of events makes of the store into ``change``, which the caller commits. ``key``: of a record's block."""
    block = names.phonetic_key(F.col("name")) if key is None else key
    last = events.groupBy("source_key").agg(F.max_by(F.struct(*_FIELDS[1:], "deleted"), F.struct("at", F.xxhash64(*_FIELDS, "deleted"))).alias("r")).select("source_key", "r.*")
    last = materialise(last.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in RECORD.split(", ")), F.coalesce("deleted", F.lit(False)).alias("deleted")), "events")
    blocked = f"{RECORD}, block_key string"
    old = materialise(_rows(change, "records", last.select("source_key"), blocked), "old")
    mark = lambda df: F.xxhash64(*(F.coalesce(df[c].cast("string"), F.lit("\0")) for c in _FIELDS))
    both = last.withColumn("_is", mark(last)).join(old.select("source_key", mark(old).alias("_was")), "source_key", "left")
    changed = materialise(both.where(~F.col("deleted") & (F.col("_was").isNull() | (F.col("_was") != F.col("_is")))).select(*_FIELDS, block.alias("block_key")), "changed")
    removed = both.where(F.col("deleted") & F.col("_was").isNotNull()).select("source_key")
    gone = materialise(removed.unionByName(changed.select("source_key")), "gone")

    fresh = changed.where(F.length("block_key") > 0)
    met = _rows(change, "by_block", fresh.select("block_key"), blocked).join(gone, "source_key", "left_anti").select(*_FIELDS, "block_key").unionByName(fresh)
    links = materialise(incremental.matched(incremental.fresh_pairs(resolve.with_letters(fresh), resolve.with_letters(met))).dropDuplicates(["a", "b"]), "links")

    ends = gone.union(links.select("a")).union(links.select("b")).distinct()
    hit = materialise(_rows(change, "labels", ends, "source_key string, cluster string").select("cluster").distinct(), "hit")
    members = materialise(_rows(change, "members", hit, "cluster string, source_key string, person_id string"), "members")
    held = materialise(_rows(change, "links", hit, _LINK), "held")
    moved = materialise(incremental.relabel(members.select("source_key", "cluster"), held, gone, changed, links), "moved")

    # persons of the clusters that changed: their ids, their records as they are now, their documents
    clustered = moved.select("source_key", "cluster")
    was = moved.where("was is not null").select(F.col("was").alias("cluster")).union(members.join(gone, "source_key", "left_semi").select("cluster")).distinct()
    owners = materialise(members.join(was, "cluster", "left_semi").select("source_key", "person_id"), "owners")
    ids = materialise(sync.incremental(clustered, owners.where("person_id is not null")).select("cluster", "person_id"), "ids")
    now = _rows(change, "records", clustered.select("source_key"), blocked).join(gone, "source_key", "left_anti").select(*_FIELDS, "block_key").unionByName(changed)
    stay = held.join(was, "cluster", "left_semi").select("a", "b", "score", "decision")
    for end in "ab":
        stay = stay.join(gone.withColumnRenamed("source_key", end), end, "left_anti")
    linked = stay.select("a", "b", "score", "decision").unionByName(links).join(clustered.withColumnRenamed("source_key", "a"), "a").select("cluster", "a", "b", "score", "decision")
    linked = materialise(linked, "linked")
    documents = resolve.person_documents(now.drop("block_key"), clustered).drop("person_id").join(ids, "cluster")
    documents = documents.join(person_links(linked, clustered), "cluster", "left").withColumn("supervisor_review_pending", F.coalesce("supervisor_review_pending", F.lit(False)))
    documents = materialise(documents, "documents")

    change.upsert("records", changed, ["source_key"], buckets=buckets, gone=removed)
    change.upsert("by_block", fresh, ["block_key", "source_key"], ["block_key"], buckets, gone=old.join(gone, "source_key", "left_semi").select("block_key", "source_key"))
    change.upsert("labels", clustered, ["source_key"], buckets=buckets, gone=removed)
    change.upsert("members", clustered.join(ids, "cluster").select("cluster", "source_key", "person_id"), ["cluster", "source_key"], ["cluster"], buckets, gone=members.join(was, "cluster", "left_semi").select("cluster", "source_key"))
    change.upsert("links", linked, ["cluster", "a", "b"], ["cluster"], buckets, gone=was)
    change.upsert("persons", documents, ["person_id"], buckets=buckets, gone=owners.where("person_id is not null").select("person_id").distinct())


def person_links(linked: DataFrame, clustered: DataFrame) -> DataFrame:
    """(cluster, match_confidence, supervisor_review_pending): the mean over a cluster's records of their mean score, and whether a link is unconfirmed."""
    per = incremental.record_confidence(linked).join(clustered, "source_key").groupBy("cluster").agg(incremental.mean_of_hundredths("confidence").alias("match_confidence"))
    review = linked.groupBy("cluster").agg(F.max(F.col("decision") == "UNCONFIRMED").alias("supervisor_review_pending"))
    return per.join(review, "cluster", "left")


def reconcile(store: Store, events: DataFrame, batch: int, stream: str = "reconcile", key: Column | None = None, buckets: int = BUCKETS, tries: int = 4) -> bool:
    """Apply a batch once; False if the ledger has it already. After a conflict it starts again from the other writer's state."""
    for left in range(tries - 1, -1, -1):
        change = store.begin()
        if change.applied(stream, batch):
            return False
        apply_batch(change, events, key, buckets)
        try:
            change.commit((stream, batch))
            return True
        except Conflict:
            if not left:
                raise
    return False


def follow(store: Store, events: DataFrame, checkpoint: str, stream: str = "reconcile", buckets: int = BUCKETS):
    """Reconcile a stream of events to the end of what is there now."""
    return each_batch(events, lambda df, batch: reconcile(store, df, batch, stream, buckets=buckets), checkpoint)
