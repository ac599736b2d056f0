"""Keyed tables in buckets behind one manifest: upserts rewrite the buckets they touch, and one rename commits them all.

A store is a folder of several tables. A table's rows lie in buckets by a hash of its bucketing columns (its key, or
part of it), each bucket in a folder of its own. A manifest, a small file numbered by its version, names the folder of every bucket, the
schemas, and a ledger of the batches that were applied. Writers put new folders beside the old ones; what counts is the
newest manifest, which comes by renaming a finished file to a name that no one has taken. So a reader always sees a whole table,
several tables change together or not at all, a writer that dies leaves only folders that no manifest names, and of two
writers that began from one version the second gets ``Conflict``, unless it touched other buckets only, in which case its
change is put on top of the first one's.

Defined results: rows of one key within an upsert become one row, the greatest by ``latest`` (then by a hash of the row);
a null in a key is a value like any other; a missing column is null, a new one is null in the rows there were; an empty upsert
makes the table and changes no bucket.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casegraph.sources.shared import materialise
from casegraph.sources.tables import Conflict

BUCKETS = 64


def bucket_of(columns: list[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _anti(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that agree with none of ``keys`` in its columns; nulls agree."""
    named = keys.select(*(F.col(c).alias(f"_{c}") for c in keys.columns))
    return rows.join(named, reduce(lambda a, b: a & b, (rows[c].eqNullSafe(named[f"_{c}"]) for c in keys.columns)), "left_anti")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest manifest's number, 0 before the first."""
        folder = self._at(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if not n:
            return {"version": 0, "tables": {}, "ledger": {}}
        stream = self._fs.open(self._at(f"{self.path}/manifests/{n:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, manifest: dict, after: int) -> bool:
        """Make ``manifest`` version after + 1; False if another writer has made one."""
        name = self._at(f"{self.path}/manifests/{after + 1:012d}")
        draft = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(name.getParent())
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({**manifest, "version": after + 1}).encode()))
        finally:
            out.close()
        jvm = self.spark.sparkContext._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri() if "://" in self.path else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(draft, name, none)  # fails if the name is taken
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def begin(self) -> Transaction:
        return Transaction(self)

    def read(self, name: str) -> DataFrame:
        return self.begin().read(name)

    def lookup(self, name: str, **key) -> DataFrame:
        """The rows with these values; where they include the bucketing columns, one bucket is read."""
        return self.begin().lookup(name, **key)

    def upsert(self, name: str, rows: DataFrame, key: list[str], by: list[str] | None = None, buckets: int = BUCKETS, latest: str | None = None, ledger: tuple[str, int] | None = None, tries: int = 4) -> bool:
        """Put rows in by their key; makes the table. False if the ledger says that this batch is in already. Starts again after a conflict."""
        for left in range(tries - 1, -1, -1):
            change = self.begin()
            if ledger and change.applied(*ledger):
                return False
            change.upsert(name, rows, key, by, buckets, latest)
            try:
                change.commit(ledger)
                return True
            except Conflict:
                if not left:
                    raise
        return False

    def delete(self, name: str, keys: DataFrame, tries: int = 4) -> None:
        """Remove the rows with these keys; starts again after a conflict, so another writer's rows aren't lost."""
        for left in range(tries - 1, -1, -1):
            change = self.begin()
            change.delete(name, keys)
            try:
                return change.commit()
            except Conflict:
                if not left:
                    raise
        return None

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders and manifests that the newest ``keep`` versions don't need; the number of folders that went. No writer may be at work, as its folders have no manifest yet."""
        newest = self.version()
        held = [self.manifest(v) for v in range(max(1, newest - keep + 1), newest + 1)]
        named = {f.split("/")[0] for m in held for t in m["tables"].values() for f in t["folders"].values()}
        gone = 0
        for sub in ("data", "drafts", "manifests"):
            folder = self._at(f"{self.path}/{sub}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                name = s.getPath().getName()
                if sub == "drafts" or (name not in named if sub == "data" else name.isdigit() and int(name) <= newest - keep):
                    self._fs.delete(s.getPath(), True)
                    gone += sub == "data"
        return gone


class Transaction:
    """Changes from one version of a store. Reads see that version, and what the transaction itself wrote."""

    def __init__(self, store: Store):
        self.store, self.seen = store, store.manifest()
        self.tables = {n: {**t, "folders": dict(t["folders"])} for n, t in self.seen["tables"].items()}
        self.wrote: dict[str, set[str]] = {}
        self.relied: dict[str, set[str]] = {}

    def applied(self, stream: str, batch: int) -> bool:
        return self.seen["ledger"].get(stream, -1) >= batch

    def has(self, name: str) -> bool:
        return name in self.tables

    def _rows(self, name: str, buckets: list[str]) -> DataFrame:
        t = self.tables[name]
        schema = StructType.fromJson(t["schema"])
        paths = [f"{self.store.path}/data/{t['folders'][b]}" for b in buckets if b in t["folders"]]
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """The whole table; a change of it by another writer is then a conflict."""
        self.relied.setdefault(name, set()).add("*")
        return self._rows(name, list(self.tables[name]["folders"]))

    def read_for(self, name: str, wanted: DataFrame) -> DataFrame:
        """The rows of the buckets that rows of ``wanted`` (with the table's bucketing columns) fall into; no other bucket's files are opened."""
        hit = self._touched(name, wanted)
        self.relied.setdefault(name, set()).update(hit)
        return self._rows(name, hit)

    def lookup(self, name: str, **key) -> DataFrame:
        t = self.tables[name]
        rows = self.store.spark.createDataFrame([tuple(key.values())], StructType([StructType.fromJson(t["schema"])[k] for k in key]))
        found = self.read_for(name, rows) if set(t["by"]) <= set(key) else self.read(name)
        return found.where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items())))

    def _touched(self, name: str, rows: DataFrame) -> list[str]:
        t = self.tables[name]
        kinds = {f.name: f.dataType for f in StructType.fromJson(t["schema"])}
        found = rows.select(bucket_of([F.col(c).cast(kinds[c]) for c in t["by"]], t["buckets"]).alias("b")).distinct()
        return [str(r["b"]) for r in found.toLocalIterator()]  # at most ``buckets`` rows

    def _write(self, name: str, rows: DataFrame, buckets: list[str]) -> None:
        t = self.tables[name]
        folder = uuid.uuid4().hex
        dealt = rows.withColumn("_bucket", bucket_of(t["by"], t["buckets"]))
        dealt.repartition(max(1, min(len(buckets), 2 * self.store.spark.sparkContext.defaultParallelism)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.store.path}/data/{folder}")
        fs, at = self.store._fs, self.store._at
        filled = {s.getPath().getName().removeprefix("_bucket=") for s in fs.listStatus(at(f"{self.store.path}/data/{folder}")) if s.isDirectory()}
        for b in buckets:
            if b in filled:
                t["folders"][b] = f"{folder}/_bucket={b}"
            else:
                t["folders"].pop(b, None)
        self.wrote.setdefault(name, set()).update(buckets)

    def upsert(self, name: str, rows: DataFrame, key: list[str], by: list[str] | None = None, buckets: int = BUCKETS, latest: str | None = None, gone: DataFrame | None = None) -> None:
        """Put rows in by their key. ``by``: the bucketing columns of a new table, part of the key; ``buckets``: their number; ``gone``: as ``delete``'s keys, what goes before, in the same rewrite."""
        if name not in self.tables:
            self.tables[name] = {"key": list(key), "by": list(by or key), "buckets": buckets, "schema": StructType([]).jsonValue(), "folders": {}}
        t = self.tables[name]
        have = StructType.fromJson(t["schema"])
        new = {f.name: f for f in rows.schema}
        whole = StructType([*have, *(f for f in rows.schema if f.name not in have.fieldNames())])
        t["schema"] = StructType([type(f)(f.name, f.dataType, True) for f in whole]).jsonValue()
        rows = materialise(rows.select(*((F.col(f"`{f.name}`") if f.name in new else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole)), "upsert")
        hit = self._touched(name, rows)
        if gone is not None:
            gone = materialise(gone.distinct(), "delete")
            hit = list(dict.fromkeys([*hit, *(b for b in self._touched(name, gone) if b in t["folders"])]))
        if not hit:
            self.wrote.setdefault(name, set())
            return
        every = F.struct(*(F.col(f"`{f.name}`") for f in whole))
        order = F.struct(*([F.col(latest)] if latest else []), F.xxhash64(*(f"`{f.name}`" for f in whole)))
        one = rows.groupBy(*t["key"]).agg(F.max_by(every, order).alias("_r")).select("_r.*")
        old = _anti(self._rows(name, hit), one.select(*t["key"]))
        self._write(name, (old if gone is None else _anti(old, gone)).unionByName(one), hit)

    def delete(self, name: str, keys: DataFrame) -> None:
        """Remove the rows that agree with a row of ``keys``, whose columns hold at least the bucketing columns."""
        if name not in self.tables:
            return
        keys = materialise(keys.distinct(), "delete")
        if not (hit := [b for b in self._touched(name, keys) if b in self.tables[name]["folders"]]):
            return
        self._write(name, _anti(self._rows(name, hit), keys), hit)

    def commit(self, ledger: tuple[str, int] | None = None) -> None:
        """One rename makes all changes count, with the batch's number in the ledger. ``Conflict`` if another writer changed a bucket that this one wrote or relied on."""
        base, at = self.seen, self.seen["version"]
        while True:
            tables = {n: {**t, "folders": dict(t["folders"])} for n, t in base["tables"].items()}
            for name, hit in self.wrote.items():
                mine = self.tables[name]
                t = tables.setdefault(name, {**mine, "folders": {}})
                t["schema"] = mine["schema"]
                for b in hit:
                    if b in mine["folders"]:
                        t["folders"][b] = mine["folders"][b]
                    else:
                        t["folders"].pop(b, None)
            if self.store.commit({"tables": tables, "ledger": {**base["ledger"], **({ledger[0]: ledger[1]} if ledger else {})}}, at):
                return
            base = self.store.manifest()
            at = base["version"]
            if ledger and base["ledger"].get(ledger[0], -1) >= ledger[1]:
                raise Conflict(f"{self.store.path}: batch {ledger}")
            for name in {*self.wrote, *self.relied}:
                was, now = self.seen["tables"].get(name), base["tables"].get(name)
                if was == now:
                    continue
                kinds = lambda t: {k: v for k, v in t.items() if k != "folders"} if t else None
                changed = {b for t in (was, now) if t for b in t["folders"] if (was or {"folders": {}})["folders"].get(b) != (now or {"folders": {}})["folders"].get(b)}
                mine = self.wrote.get(name, set()) | self.relied.get(name, set())
                if kinds(was) != kinds(now) or "*" in mine or changed & mine:
                    raise Conflict(f"{self.store.path}: {name}")
