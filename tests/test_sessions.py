"""Latest sessions as the state of a stream."""

import time

from pyspark.sql import functions as F

from casegraph.operators import retrieval
from casegraph.sources.store import Store
from casegraph.streaming import incremental, sessions


def turns(spark, n, seed):
    """Users of very different sizes, sessions that come back, equal times, and rows that lack something."""
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(m))
    hot = F.when(draw(0, 3) == 0, F.lit(0)).otherwise(draw(1, 12))
    rows = spark.range(n).select(F.when(draw(5, 50) > 0, hot).cast("string").alias("user"), F.when(draw(6, 50) > 0, draw(2, 9)).cast("string").alias("session"), F.when(draw(7, 50) > 0, F.timestamp_seconds(1_700_000_000 + draw(3, 500))).alias("at"))
    return rows.repartition(3)


def rows(df):
    return sorted(tuple(r) for r in df.select("user", "session", "last", "rank").collect())


def run(spark, folder, store, checkpoint, **options):
    query = sessions.keep(incremental.read_records(spark, folder, sessions.TURNS, 1), store, "recent", checkpoint, **options)
    query.awaitTermination()
    return query


def test_the_stream_keeps_what_a_query_over_all_turns_gives(spark, tmp_path):
    folder, store, checkpoint = str(tmp_path / "in"), Store(spark, str(tmp_path / "store")), str(tmp_path / "c")
    for seed in (0, 100):  # it stops, more turns come, some of them older than those before, and it goes on
        turns(spark, 600, seed).write.mode("append").parquet(folder)
        run(spark, folder, store, checkpoint, hours=1)
        want = rows(retrieval.recent_sessions(spark.read.parquet(folder).dropna(), "user"))
        assert rows(store.read("recent")) == want and max(r[3] for r in want) == 5
    held = sessions.stored(spark, checkpoint)
    assert sorted(tuple(r) for r in held.collect()) == sorted(r[:3] for r in want)
    assert sessions.stored(spark, checkpoint, "2999-01-01").count() == 0
    version = store.version()
    run(spark, folder, store, checkpoint, hours=1)  # nothing new: nothing is written
    assert store.version() == version
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_a_session_that_ran_out_is_gone_without_a_rewrite(spark, tmp_path):
    folder, store, checkpoint = str(tmp_path / "in"), Store(spark, str(tmp_path / "store")), str(tmp_path / "c")
    one = lambda session, at: spark.createDataFrame([("u", session, at)], "user string, session string, at string").select("user", "session", F.col("at").cast("timestamp").alias("at"))
    one("a", "2024-01-01 10:00:00").write.parquet(folder)
    run(spark, folder, store, checkpoint, hours=1 / 3600)
    version = store.version()
    time.sleep(1.5)
    assert sessions.stored(spark, checkpoint).count() == 0 and store.version() == version
    one("b", "2024-01-01 09:00:00").write.mode("append").parquet(folder)  # older, but the other one is gone
    run(spark, folder, store, checkpoint, hours=1 / 3600)
    assert [r[1] for r in rows(store.read("recent"))] == ["b"]


def test_turns_are_condensed_before_they_are_shuffled(spark):
    few = turns(spark, 3000, 7).dropna().coalesce(1).mapInArrow(sessions._condensed, sessions.TURNS)
    assert few.count() <= 12 * 9 and few.groupBy("user", "session").count().where("count > 1").count() == 0


def test_a_batch_that_is_replayed_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    data = spark.createDataFrame([("u", 1, "x")], "user string, rank int, session string")
    for _ in range(2):
        change = store.begin()
        if not change.applied("recent", 0):
            change.upsert("recent", data, ["user", "rank"], by=["user"])
            change.commit(("recent", 0))
    assert store.version() == 1
