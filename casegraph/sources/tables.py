"""Reading and writing tables: CSV, JSON, text, keyed upserts by directory swap, append-only logs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casegraph.sources.shared import materialise

# Audit columns that exports drop.
AUDIT_COLUMNS = ("CREATORID", "CREATEDTIME", "MODIFIEDTIME")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header and doubled quotes; with a schema, malformed rows are dropped."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return (reader.schema(schema).option("mode", "DROPMALFORMED") if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, without audit columns."""
    df.drop(*AUDIT_COLUMNS).write.mode("overwrite").json(path)


def write_export(df: DataFrame, table: str, path: str, per_document: int = 1000) -> None:
    """JSON documents {table, columns, rows}, one a line, of at most ``per_document`` rows each, without audit columns."""
    rows = df.drop(*AUDIT_COLUMNS)
    chunk = F.floor(F.monotonically_increasing_id() / per_document)  # ids are consecutive within a partition
    dealt = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("r")).withColumn("chunk", chunk)
    docs = dealt.groupBy("chunk").agg(F.collect_list("r").alias("rows")).select(F.lit(table).alias("table"), F.array(*(F.lit(c) for c in rows.columns)).alias("columns"), "rows")
    docs.select(F.to_json(F.struct("table", "columns", "rows"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of documents that ``write_export`` wrote; ``schema`` is that of a row."""
    docs = spark.read.text(path).select(F.from_json("value", f"struct<rows:array<struct<{schema}>>>").alias("d"))
    return docs.select(F.inline("d.rows"))


def capped(df: DataFrame, by: str, most: int) -> DataFrame:
    """The first ``most`` rows in an order, as a scan with a cap gives; the cap is what is asked for."""
    return df.orderBy(by).limit(most)


def write_texts(df: DataFrame, text: str, order: str, path: str, per_file: int = 200) -> None:
    """Text files of about ``per_file`` rows, in order."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(text).write.option("maxRecordsPerFile", per_file).mode("overwrite").text(path)


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't new, and the new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def _fs(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes its paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return at(path).getFileSystem(conf), at


def version(spark: SparkSession, path: str) -> int | None:
    """When the table's folder was put in its place; None without a table."""
    fs, at = _fs(spark, path)
    return fs.getFileStatus(at(f"{path}/_SUCCESS")).getModificationTime() if fs.exists(at(f"{path}/_SUCCESS")) else None


class Conflict(RuntimeError):
    pass


def swap(spark: SparkSession, df: DataFrame, path: str, expected: int | None | str = "any") -> None:
    """Write a table next to the old one, then rename: readers see the old table or the new, never a part.

    ``expected``: the version that ``df`` was made from; Conflict if another writer came first, and nothing is changed."""
    fs, at = _fs(spark, path)
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        df.write.parquet(new)
    except Exception as e:  # the files that it reads may have gone with another writer's swap
        fs.delete(at(new), True)
        if expected != "any" and version(spark, path) != expected:
            raise Conflict(path) from e
        raise
    if expected != "any" and version(spark, path) != expected:
        fs.delete(at(new), True)
        raise Conflict(path)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def upsert(spark: SparkSession, new: DataFrame, path: str, key: str, tries: int = 4) -> None:
    """Replace rows by key in a Parquet table; creates it. After a conflict with another writer it starts again from that one's table."""
    for left in range(tries - 1, -1, -1):
        seen = version(spark, path)
        try:
            return swap(spark, new if seen is None else merged(spark.read.parquet(path), new, key), path, seen)
        except Conflict:
            if not left:
                raise
    return None


def delete_keys(spark: SparkSession, path: str, keys: DataFrame, key: str) -> None:
    swap(spark, spark.read.parquet(path).join(keys.select(key), key, "left_anti"), path)


def append_log(df: DataFrame, path: str) -> None:
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def json_array(column: str, schema: str):
    """A column of JSON that may be an array, a string with one, or an array of strings with objects."""
    c = F.col(column)
    whole = F.from_json(c, f"array<{schema}>")
    unquoted = F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(0))
    inner = F.from_json(unquoted, f"array<{schema}>")
    parts = F.transform(F.from_json(c, "array<string>"), lambda x: F.from_json(x, schema))
    some = lambda a: F.when(F.size(F.filter(a, lambda x: x.isNotNull())) > 0, F.filter(a, lambda x: x.isNotNull()))
    return F.coalesce(some(whole), some(parts), some(inner), F.array().cast(f"array<{schema}>"))


def lookup(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of a keyed table with one key: the filter reaches the files."""
    return spark.read.parquet(path).where(F.col(key) == value)


def live_sessions(sessions: DataFrame, now, hours: float = 1.0) -> DataFrame:
    """Sessions (session, touched_at) that were used within ``hours`` before ``now``."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(0), mins=F.lit(int(hours * 60)))
    return sessions.where(F.col("touched_at") > since)


def touch_session(spark: SparkSession, path: str, turn: DataFrame, now, keep_hours: float = 1.0) -> None:
    """Add turns (session, user, role, text) to a table of sessions, one row each with its turns in order; sessions that ran out go."""
    new = turn.groupBy("session", "user").agg(F.collect_list(F.struct("role", "text")).alias("turns")).withColumn("touched_at", F.lit(now).cast("timestamp"))
    if version(spark, path) is None:
        return swap(spark, new, path)
    old = live_sessions(spark.read.parquet(path), now, keep_hours)
    both = old.unionByName(new).groupBy("session").agg(F.max_by("user", "touched_at").alias("user"), F.transform(F.sort_array(F.collect_list(F.struct("touched_at", "turns"))), lambda x: x["turns"]).alias("t"), F.max("touched_at").alias("touched_at"))
    swap(spark, both.select("session", "user", F.flatten("t").alias("turns"), "touched_at"), path)
    return None


def id_dictionary(rows: DataFrame, key: str) -> DataFrame:
    """(key, id): a number from 0 for each different value, in order and without gaps. Values are ranked within ranges, whose counts are summed before."""
    ranged = materialise(rows.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(key).select(key, F.spark_partition_id().alias("_p")), "ids")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return ranged.withColumn("place", place).join(F.broadcast(before), "_p").select(key, (F.col("before") + F.col("place")).alias("id"))


def composite_orphans(child: DataFrame, keys: dict[str, str], parent: DataFrame) -> DataFrame:
    """Rows whose key of several columns (child's name: parent's) has no row in the parent; a key with a null refers to nothing."""
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in keys))
    return child.where(whole).join(parent.select(*(F.col(p).alias(c) for c, p in keys.items())).distinct(), list(keys), "left_anti")


def out_of_order(rows: DataFrame, earlier: str, later: str) -> DataFrame:
    """Rows whose later date lies before the earlier one; rows that lack one are in order."""
    return rows.where(F.col(later) < F.col(earlier))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose foreign key has no row in the parent; null keys refer to nothing."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
