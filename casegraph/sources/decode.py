"""Tolerant decoding of JSON lists of records, with counts of the shapes that were met.

A field may hold a list of objects, a string with such a list, a list of strings that hold objects, or a mixture. It is parsed
once, into VARIANT; records and counts come from the same parse, so that diagnostics cost no second pass.

Defined results: a field that is null, no JSON or no list has no records and no items; an item that is an object counts
in ``objects``; one that is a string in ``stringified``, and also in ``parsed`` if it holds an object, else in ``malformed``;
any other item, null included, in ``malformed``. Order is kept. JSON beyond the size of a variant counts as no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPES = ("total", "objects", "stringified", "parsed", "malformed")


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING or another type's name; null for no variant."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def strict(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; Spark's parser doesn't look beyond the first value.

    What closes a list early is no JSON within an object, and the other way round, so both must parse."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when((F.size(listed) == 1) & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull(), F.get(listed, F.lit(0)))


def items(field: Column) -> Column:
    """The items of a field as an array of variants, empty where it isn't a list."""
    whole = strict(field)
    whole = F.when(_kind(whole) == "STRING", strict(_text(whole))).otherwise(whole)
    return F.coalesce(F.when(_kind(whole) == "ARRAY", F.try_variant_get(whole, "$", "array<variant>")), F.array().cast("array<variant>"))


def decoded(rows: DataFrame, field: str, schema: str | None = None, records: str = "records", shapes: str = "shapes") -> DataFrame:
    """Rows with ``records``: an array of variants, or of structs with ``schema``, and ``shapes``: STRUCT<total, objects, stringified, parsed, malformed>."""
    kind = lambda v: F.coalesce(_kind(v), F.lit("VOID"))
    # each item as what it is, its kind and, of a string, the kind of what it holds
    parsed = F.transform(items(F.col(field)), lambda v: F.struct(kind(v).alias("kind"), F.when(kind(v) == "STRING", strict(_text(v))).otherwise(v).alias("v")))
    seen = F.transform(F.col("_items"), lambda x: F.struct(x["kind"].alias("kind"), kind(x["v"]).alias("holds"), x["v"].alias("v")))
    count = lambda f: F.size(F.filter("_seen", f)).cast("long")
    object_ = lambda x: x["holds"] == "OBJECT"
    shape = {
        "total": F.size("_seen").cast("long"), "objects": count(lambda x: x["kind"] == "OBJECT"), "stringified": count(lambda x: x["kind"] == "STRING"),
        "parsed": count(lambda x: (x["kind"] == "STRING") & object_(x)), "malformed": count(lambda x: ~object_(x)),
    }
    sound = F.transform(F.filter("_seen", object_), lambda x: F.try_variant_get(x["v"], "$", f"struct<{schema}>") if schema else x["v"])
    out = rows.withColumn("_items", parsed).withColumn("_seen", seen)
    return out.withColumns({records: sound, shapes: F.struct(*(c.alias(n) for n, c in shape.items()))}).drop("_items", "_seen")


def diagnostics(rows: DataFrame, by: list[str] | None = None, shapes: str = "shapes") -> DataFrame:
    """The counts of all shapes, summed over rows, or over those of each group."""
    return rows.groupBy(*(by or [])).agg(*(F.coalesce(F.sum(f"{shapes}.{s}"), F.lit(0)).alias(s) for s in SHAPES))
