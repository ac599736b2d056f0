"""Dashboard aggregates over a star schema of cases, places and categories.

Cases carry ``case_id, registered (timestamp), category, district`` after ``star``; filters reach the scan, and a
dimension is joined only if a filter or a label needs it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casegraph.functions.scores import half_up


def safe_text(value: str | None) -> bool:
    """Filter texts may hold letters, digits, white space, _ and - only."""
    return bool(value) and all(c.isascii() and (c.isalnum() or c in "_-" or c.isspace()) for c in value)


def filtered(cases: DataFrame, filters: Mapping[str, str] | None = None, dims: Mapping[str, tuple[DataFrame, str, Column]] | None = None) -> DataFrame:
    """Cases within inclusive dates, whose dimensions' labels contain the filter texts.

    ``dims``: of a filter's name, the dimension, the key that it shares with the cases, and its label. An unsafe text is
    ignored, as is a filter without a dimension."""
    f = filters or {}
    if f.get("start"):
        cases = cases.where(F.col("registered") >= F.lit(f["start"]).cast("timestamp"))
    if f.get("end"):
        cases = cases.where(F.col("registered") <= F.lit(f["end"]).cast("timestamp"))
    for name, (dim, key, label) in (dims or {}).items():
        if safe_text(f.get(name)):
            cases = cases.join(dim.where(F.contains(F.lower(label), F.lit(f[name].lower()))).select(key), key, "left_semi")
    return cases


def chart(rows: DataFrame, label: str, value: str = "value") -> DataFrame:
    """(label, value) with '' and 0 for null."""
    return rows.select(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"), F.coalesce(value, F.lit(0)).cast("long").alias("value"))


def count_by(cases: DataFrame, label: str, limit: int | None = None, order: str = "value") -> DataFrame:
    """Counts of cases by a label. order: 'value' (largest first) or 'label'; both are total orders."""
    counts = chart(cases.groupBy(label).agg(F.count("case_id").alias("value")), label)
    if limit is None:
        return counts
    return counts.orderBy(*([F.desc("value"), "label"] if order == "value" else ["label"])).limit(limit)


def trend(cases: DataFrame, limit: int = 60) -> DataFrame:
    """Counts by day, the oldest ``limit`` days."""
    return count_by(cases.where(F.col("registered").isNotNull()).withColumn("day", F.date_format("registered", "yyyy-MM-dd")), "day", limit, "label")


def seasonal(cases: DataFrame, period: str) -> DataFrame:
    """Counts by month (0 to 11) or weekday (0: Sunday), zeros filled in."""
    n, bucket = (12, F.month("registered") - 1) if period == "month" else (7, F.dayofweek("registered") - 1)
    counts = cases.where(F.col("registered").isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("case_id").alias("value"))
    every = cases.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return every.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("value", F.lit(0)).alias("value"))


def seasonal_insights(cases: DataFrame) -> DataFrame:
    """Peak and least month, mean of the months with cases, weekend uplift in percent, peak to least, busy months."""
    live = cases.where(F.col("registered").isNotNull())
    months = seasonal(live, "month")
    best = months.agg(
        F.max_by("bucket", F.struct("value", -F.col("bucket"))).alias("peak_month"), F.max("value").alias("peak"),
        F.min_by("bucket", F.when(F.col("value") > 0, F.struct("value", "bucket"))).alias("low_month"), F.min(F.when(F.col("value") > 0, F.col("value"))).alias("low"),
        F.avg(F.when(F.col("value") > 0, F.col("value"))).alias("mean"), F.collect_list("value").alias("all"),
    )
    days = live.agg(F.count_if(F.dayofweek("registered").isin(1, 7)).alias("weekend"), F.count(F.lit(1)).alias("n"))
    uplift = (F.col("weekend") / 2) / ((F.col("n") - F.col("weekend")) / 5) * 100 - 100
    one = best.withColumn("one", F.lit(1)).join(days.withColumn("one", F.lit(1)), "one")
    return one.select("peak_month", "low_month", half_up(F.col("mean"), 2).alias("mean"), half_up(uplift, 2).alias("weekend_uplift"), half_up(F.col("peak") / F.col("low"), 2).alias("peak_to_low"), F.size(F.filter("all", lambda v: v > 1.1 * F.col("mean"))).alias("busy_months"))


def summary_cards(cases: DataFrame) -> DataFrame:
    """Totals, numbers of categories and districts, and the first of the days with most cases; empty without cases."""
    days = cases.groupBy(F.date_format("registered", "yyyy-MM-dd").alias("day")).agg(F.count("case_id").alias("n")).agg(F.max_by("day", F.struct("n", -F.unix_date(F.col("day").cast("date")))).alias("peak_day"))
    totals = cases.agg(F.count("case_id").alias("total"), F.countDistinct("category").alias("categories"), F.countDistinct("district").alias("districts"))
    return totals.withColumn("one", F.lit(1)).join(days.withColumn("one", F.lit(1)), "one").drop("one")


def share_of_total(counts: DataFrame) -> DataFrame:
    """Percent of the sum; the sum comes from one aggregate row."""
    total = counts.agg(F.sum("value").alias("total")).withColumn("one", F.lit(1))
    return counts.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("label", "value", half_up(F.col("value") * 100 / F.col("total"), 2).alias("percent"))


def highlighted(counts: DataFrame, n: int = 3, most: int = 20) -> DataFrame:
    """The ``most`` largest counts, with ``top`` true for the first ``n`` of them; a count that is null is left out."""
    live = counts.where(F.col("value").isNotNull())
    return live.orderBy(F.desc("value"), "label").limit(most).withColumn("top", F.row_number().over(Window.orderBy(F.desc("value"), "label")) <= n)


def hotspots(cases: DataFrame, limit: int = 200) -> DataFrame:
    """Located cases, the first by id."""
    return cases.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).orderBy("case_id").limit(limit).select("case_id", "lat", "lon", "category", "registered")


def analytical_trio(cases: DataFrame) -> DataFrame:
    """The ten commonest categories and districts and the newest twelve months, in one table."""
    part = lambda kind, df: df.select(F.lit(kind).alias("kind"), "label", "value")
    months = count_by(cases.withColumn("month", F.date_format("registered", "yyyy-MM")), "month").orderBy(F.desc("label")).limit(12)
    return part("category", count_by(cases, "category", 10)).unionByName(part("month", months)).unionByName(part("district", count_by(cases, "district", 10)))


def distinct_names(rows: DataFrame, needle: str, limit: int = 10) -> DataFrame:
    """Names that contain a text, one for each spelling in lower case (the first by ``ord``), the first ``limit``."""
    hits = rows.where(F.contains(F.lower("name"), F.lit(needle.lower())))
    first = hits.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("ord", "name")).alias("f"))
    return first.orderBy("f.ord", "key").limit(limit).select(F.col("f.name").alias("name"))


def role_search(roles: Mapping[str, DataFrame], term: str | None, each: int = 10, limit: int = 10) -> DataFrame:
    """(name, id): persons of role tables (id, name) whose name contains a text, ``each`` rows of every role by id, one for each spelling in lower case: the first by role, then by id.

    Both limits are what is asked for. Without a text nothing is found; one with other signs than a filter may hold is an error."""
    needle = (term or "").strip()
    if needle and not safe_text(needle):
        raise ValueError("a search term may hold letters, digits and spaces only")
    hits = None
    for place, rows in enumerate(roles.values()):
        some = rows.where(F.contains(F.lower("name"), F.lit(needle.lower())) & F.lit(bool(needle))).orderBy("id", "name").limit(each)
        some = some.select(F.col("id").cast("string").alias("id"), "name", F.struct(F.lit(place).alias("place"), F.col("id").alias("nth")).alias("ord"))
        hits = some if hits is None else hits.unionByName(some)
    first = hits.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("ord", "id", "name")).alias("f"))
    return first.orderBy("f.ord", "key").limit(limit).select("f.name", "f.id")


def top_by_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
