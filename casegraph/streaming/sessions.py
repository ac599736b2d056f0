"""Each user's latest sessions as the state of a stream, which forgets those that ran out.

A turn changes its user's entry in the state store, no table is rewritten. The state holds ``n`` sessions a user at most,
with the time of each one's last turn, in a map whose entries the store drops by itself when they were not written
to for ``hours``. Turns of a batch are condensed before they are shuffled, so a user with a third of all turns sends a row for
each of its sessions and Arrow batch.

Defined results: late turns count if they are the newest of their session; of equal times the lesser session comes first; rows without
user, session or time are left out; a user's rows in an output batch replace its earlier ones, so what has run out leaves a table with the user's next turn, but the state at once.
What comes out is what ``retrieval.recent_sessions`` gives on all turns so far, as long as nothing has run out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

TURNS = "user string, session string, at timestamp"
RECENT = "user string, session string, last timestamp, rank int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _condensed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last turn of each session in a batch."""
    for b in batches:
        last = pa.Table.from_batches([b]).group_by(["user", "session"]).aggregate([("at", "max")])
        yield from last.rename_columns(["user", "session", "at"]).to_batches()


class Recent(StatefulProcessor):
    """Keeps a user's ``n`` latest sessions; ``ttl``: milliseconds after which an untouched one goes, None for never."""

    def __init__(self, n: int, ttl: int | None):
        self.n, self.ttl = n, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("sessions", "session string", "last timestamp", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = {k[0]: v[0] for k, v in self.held.iterator()}
        now = dict(before)
        for part in rows:
            for session, at in part.groupby("session")["at"].max().items():
                at = at.to_pydatetime()
                if session not in now or at > now[session]:
                    now[session] = at
            now = dict(sorted(now.items(), key=lambda x: (-x[1].timestamp(), x[0]))[: self.n])
        for session in before.keys() - now.keys():
            self.held.removeKey((session,))
        for session, at in now.items():
            if before.get(session) != at:
                self.held.updateValue((session,), (at,))
        yield pd.DataFrame({"user": [key[0]] * len(now), "session": list(now), "last": list(now.values()), "rank": range(1, len(now) + 1)})

    def close(self) -> None:
        pass


def recent(turns: DataFrame, n: int = 5, hours: float | None = None) -> DataFrame:
    """(user, session, last, rank) of the users that a batch touches, from a stream of turns (user, session, at)."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    sound = turns.select(F.col("user").cast("string").alias("user"), F.col("session").cast("string").alias("session"), F.col("at").cast("timestamp").alias("at")).dropna()
    ttl = None if hours is None else int(hours * 3_600_000)
    return sound.mapInArrow(_condensed, TURNS).groupBy("user").transformWithStateInPandas(Recent(n, ttl), RECENT, "Update", "None" if ttl is None else "ProcessingTime")


def keep(turns: DataFrame, store, table: str, checkpoint: str, n: int = 5, hours: float | None = None) -> StreamingQuery:
    """Run the stream to the end of what is there now; each batch replaces its users' rows in a keyed table, once even if it is replayed."""

    def apply(rows: DataFrame, batch: int) -> None:
        change = store.begin()
        if change.applied(table, batch):
            return
        rows = rows.persist()
        try:
            # a user's ranks are 1 to how many it has: what lies beyond goes
            gone = rows.groupBy("user").agg(F.max("rank").alias("m")).select("user", F.explode(F.sequence(F.col("m") + 1, F.greatest(F.col("m") + 1, F.lit(n)))).alias("rank"))
            change.upsert(table, rows, ["user", "rank"], by=["user"], gone=gone if change.has(table) else None)
            change.commit((table, batch))
        finally:
            rows.unpersist()

    conf, name = turns.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # with entries that run out Spark would go on with empty batches for ever; the query keeps what it was started with
    try:
        return recent(turns, n, hours).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def stored(spark: SparkSession, checkpoint: str, now: str | None = None) -> DataFrame:
    """(user, session, last): what the state holds after the last batch, without those that have run out by ``now`` (a timestamp; None: by now)."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    state = spark.read.format("statestore").option("stateVarName", "sessions").load(checkpoint)
    timed = "ttlExpirationMs" in state.schema["user_map_value"].dataType.fieldNames()
    live = state.where(F.col("user_map_value.ttlExpirationMs") > F.unix_millis(at)) if timed else state
    return live.select(F.col("key.user").alias("user"), F.col("user_map_key.session").alias("session"), F.col("user_map_value.value.last" if timed else "user_map_value.last").alias("last"))
