"""Keyed tables behind a manifest, clusters kept up to date, reconciliation as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import incremental, resolve
from casegraph.operators.components import components
from casegraph.sources.store import Store
from casegraph.sources.tables import Conflict
from casegraph.streaming import incremental as streams
from casegraph.streaming import reconcile


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def kv(spark, data, schema="k long, v string"):
    return spark.createDataFrame(data, schema)


# ---- keyed tables


def test_an_upsert_of_one_key_rewrites_one_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert("t", kv(spark, [(i, f"a{i}") for i in range(200)]), ["k"], buckets=16)
    before = store.manifest()["tables"]["t"]["folders"]
    store.upsert("t", kv(spark, [(5, "x")]), ["k"])
    after = store.manifest()["tables"]["t"]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.version() == 2
    assert rows(store.lookup("t", k=5)) == [(5, "x")] and store.read("t").count() == 200
    assert len(store.lookup("t", k=5).inputFiles()) == 1  # a lookup opens its bucket only
    store.delete("t", kv(spark, [(5,), (6,), (999,)], "k long"))
    assert store.read("t").count() == 198 and store.lookup("t", k=5).count() == 0


def test_a_reader_between_the_steps_sees_a_whole_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert("t", kv(spark, [(i, "a") for i in range(50)]), ["k"], buckets=4)
    open_reader = store.read("t")
    change = store.begin()
    change.upsert("t", kv(spark, [(i, "b") for i in range(60)]), ["k"])  # all files written, nothing committed
    assert rows(Store(spark, str(tmp_path / "s")).read("t")) == [(i, "a") for i in range(50)] or store.read("t").where("v = 'a'").count() == 50
    change.commit()
    assert store.read("t").where("v = 'b'").count() == 60
    assert open_reader.where("v = 'a'").count() == 50  # the old version's files are still there
    assert store.vacuum(keep=1) == 1 and store.read("t").count() == 60


def test_writers_conflict_by_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert("t", kv(spark, [(i, "a") for i in range(50)]), ["k"], buckets=8)
    one, two = store.begin(), store.begin()
    one.upsert("t", kv(spark, [(5, "one")]), ["k"])
    two.upsert("t", kv(spark, [(5, "two")]), ["k"])
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert rows(store.lookup("t", k=5)) == [(5, "one")]
    bucket = {k: r["b"] for k in (1, 2, 3, 4) for r in kv(spark, [(k, "")]).select(F.pmod(F.xxhash64("k"), F.lit(8)).alias("b")).collect()}
    other = next(k for k in (2, 3, 4) if bucket[k] != bucket[1])
    one, two, reader = store.begin(), store.begin(), store.begin()
    one.upsert("t", kv(spark, [(1, "one")]), ["k"])
    two.upsert("t", kv(spark, [(other, "two")]), ["k"])
    reader.read("t")  # relies on the whole table
    reader.upsert("u", kv(spark, [(1, "sum")]), ["k"])
    one.commit()
    two.commit()  # other buckets: both changes stay
    assert rows(store.lookup("t", k=1)) == [(1, "one")] and rows(store.lookup("t", k=other)) == [(other, "two")]
    with pytest.raises(Conflict):
        reader.commit()
    assert "u" not in store.manifest()["tables"]


def test_batches_count_once_and_rows_of_one_key_become_one(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.upsert("f", kv(spark, [(1, "old", 1), (1, "new", 2), (None, "null", 1)], "k long, v string, at int"), ["k"], buckets=4, latest="at", ledger=("x", 0))
    assert not store.upsert("f", kv(spark, [(1, "again", 9)], "k long, v string, at int"), ["k"], ledger=("x", 0))
    assert rows(store.read("f"), "k", "v") == [(1, "new"), (None, "null")]
    store.upsert("f", kv(spark, [(None, 2.5)], "k long, w double"), ["k"])  # a column more, a null key
    assert rows(store.read("f"), "k", "v", "w") == [(1, "new", None), (None, None, 2.5)]
    store.upsert("f", kv(spark, [], "k long, v string"), ["k"])
    assert store.read("f").count() == 2


# ---- clusters


def from_scratch(spark, keys, links):
    above = {k: k for k in keys}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        above[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_relabel_is_clustering_from_scratch(spark):
    rng = random.Random(3)
    for seed in range(4):
        keys = [f"k{i:02d}" for i in range(60)]
        links = {tuple(sorted(rng.sample(keys, 2))) for _ in range(40)}
        labels = from_scratch(spark, keys, links)
        gone = set(rng.sample(keys, 6 if seed else 0))
        back = set(list(gone)[:3])
        fresh = {f"n{i}" for i in range(4)} | back
        now = [k for k in keys if k not in gone] + sorted(fresh)
        new = {tuple(sorted((f, rng.choice(now)))) for f in fresh for _ in range(2)}
        new = {(a, b) for a, b in new if a != b}
        kept = {(a, b) for a, b in links if a not in gone and b not in gone}
        want = from_scratch(spark, now, kept | new)
        mk = lambda data, *cols: spark.createDataFrame(sorted(data), ", ".join(f"{c} string" for c in cols))
        got = incremental.relabel(mk(labels.items(), "source_key", "cluster"), mk([(a, b, labels[a]) for a, b in links], "a", "b", "cluster"), mk([(k,) for k in gone], "source_key"), mk([(k,) for k in fresh], "source_key"), mk(new, "a", "b"))
        moved = {r["source_key"]: r["cluster"] for r in got.collect()}
        after = {k: moved.get(k, labels.get(k)) for k in now}
        assert after == want
        assert not gone - fresh & set(moved)
        touched = {labels[k] for k in gone} | {labels[e] for link in new for e in link if e in labels}
        assert all(k in fresh or labels[k] in touched for k in moved)  # other clusters are left alone


def people(n=60, seed=1):
    rng = random.Random(seed)
    first, last = ["ravi", "ravee", "mohan", "anita", "aneeta", "suresh"], ["kumar", "rao", "shetty", "raao"]
    return [(f"A:{i:03d}", rng.choice(["accused", "victim", "complainant"]), f"{rng.choice(first)} {rng.choice(last)}", float(rng.randint(20, 60)), rng.choice("MF"), rng.choice("xy"), "d", None, None, f"c{i % 17}", f"2024-01-{i % 28 + 1:02d}") for i in range(n)]


def test_changes_equal_clustering_everything(spark):
    before = spark.createDataFrame(people(), reconcile.RECORD)
    links = incremental.matched(resolve.pairs(resolve.with_key(before)))
    labels = resolve.clusters(before, links)
    linked = links.join(labels.select(F.col("source_key").alias("a"), "cluster"), "a")
    changed = spark.createDataFrame([(r[0], *r[1:3], r[3] + 1, *r[4:]) for r in people()[:5]] + [("B:" + r[0], *r[1:]) for r in people(8, 9)], reconcile.RECORD)
    removed = spark.createDataFrame([("A:040",), ("A:041",), ("none",)], "source_key string")
    after, kept = incremental.apply_changes(before, labels, linked, changed, removed)
    now = before.join(changed.select("source_key").union(removed), "source_key", "left_anti").unionByName(changed)
    scratch = incremental.matched(resolve.pairs(resolve.with_key(now)))
    assert rows(after) == rows(resolve.clusters(now, scratch))
    assert rows(kept, "a", "b", "score", "decision") == rows(scratch, "a", "b", "score", "decision")
    assert {r["decision"] for r in kept.collect()} == {"CONFIRMED", "UNCONFIRMED"}


def test_hot_blocks_are_dealt_to_cells(spark):
    every = spark.createDataFrame([(f"r{i:02d}", "hot") for i in range(50)], "source_key string, block_key string")
    fresh = every.where("source_key < 'r07'")
    want = sorted((a, b) for i in range(50) for j in range(i) for a, b in [(f"r{j:02d}", f"r{i:02d}")] if j < 7)
    for cell in (2000, 8):
        got = incremental.fresh_pairs(fresh, every, cell=cell).select(F.col("a.source_key").alias("a"), F.col("b.source_key").alias("b"))
        assert rows(got) == want


# ---- the stream


def events(spark, data, at):
    return spark.createDataFrame([(*r, False, at) for r in data], f"{reconcile.RECORD}, deleted boolean, at long")


def batches(spark):
    p = people(45)
    gone = [(*r, True, 3) for r in p[3:6]]
    return [
        events(spark, p[:25], 1),
        events(spark, [*p[25:], *((r[0], r[1], "mohan raao", *r[3:]) for r in p[:2])], 2),
        events(spark, [(p[7][0], p[7][1], "zz unlike", *p[7][3:])], 3).unionByName(spark.createDataFrame(gone, f"{reconcile.RECORD}, deleted boolean, at long")),
    ]


STORED = ["cluster", "source_keys", "name_variants", "name_normalised", "age_estimate", "accused_count", "total_case_appearances", "records", "match_confidence", "supervisor_review_pending"]


def test_a_batch_that_fails_before_its_commit_is_played_again(spark, tmp_path, monkeypatch):
    src = tmp_path / "events"
    for i, b in enumerate(batches(spark)):
        b.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    src.mkdir()
    stopped, at_rest = Store(spark, str(tmp_path / "stopped")), Store(spark, str(tmp_path / "rest"))
    stream = lambda: streams.read_records(spark, str(src), f"{reconcile.RECORD}, deleted boolean, at long", 1)

    def put(i):
        file = next((tmp_path / f"part{i}").glob("*.parquet"))
        (src / f"{i}.parquet").write_bytes(file.read_bytes())

    commit, fails = Store.commit, {2: 1}

    def failing(self, manifest, after):
        if self.path.endswith("stopped") and fails.pop(after + 1, 0):
            raise RuntimeError("stopped between write and commit")
        return commit(self, manifest, after)

    monkeypatch.setattr(Store, "commit", failing)
    for i in range(3):
        put(i)
        try:
            reconcile.follow(stopped, stream(), str(tmp_path / "ck"), buckets=4).awaitTermination()
        except Exception as e:
            assert "stopped between" in str(e)
            assert stopped.version() == 1
            reconcile.follow(stopped, stream(), str(tmp_path / "ck"), buckets=4).awaitTermination()
    assert stopped.version() == 3 and not fails
    for i, b in enumerate(batches(spark)):
        assert reconcile.reconcile(at_rest, b, i, buckets=4)
    assert rows(stopped.read("persons"), "person_id", *STORED) == rows(at_rest.read("persons"), "person_id", *STORED)
    assert not reconcile.reconcile(at_rest, batches(spark)[0], 1)  # the ledger has it: nothing changes
    # one full run over the records as they are at the end gives the same persons
    whole = Store(spark, str(tmp_path / "whole"))
    final = at_rest.read("records").drop("block_key").withColumns({"deleted": F.lit(False), "at": F.lit(1).cast("long")})
    reconcile.reconcile(whole, final, 0, buckets=4)
    assert rows(whole.read("persons"), *STORED) == rows(at_rest.read("persons"), *STORED)
    scratch = incremental.matched(resolve.pairs(resolve.with_key(at_rest.read("records"))))
    assert rows(at_rest.read("labels")) == rows(resolve.clusters(at_rest.read("records"), scratch))
    assert rows(components(scratch.select("a", "b")).select("component").distinct()) == rows(scratch.select("a").join(at_rest.read("labels"), F.col("a") == F.col("source_key")).select("cluster").distinct())
    ids = at_rest.read("persons").select("person_id")
    assert ids.count() == ids.distinct().count() == at_rest.read("labels").select("cluster").distinct().count()
    assert rows(at_rest.read("members").select("person_id").distinct()) == rows(ids)
