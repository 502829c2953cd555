"""Column profiles: rows, nulls, distinct values and range of every column.

``column_profile`` is exact.  Counts and ranges are one aggregate per table.
Distinct values travel as (column number, 128-bit hash): each task keeps its
own distinct ones before the shuffle, and only those numbers are sent, whatever
the width of the rows.  Arrays, maps and structs are compared by a canonical
JSON text, in which the order of a map's entries does not count; they have no range.

``sketches`` holds the same as mergeable parts: sums, an HLL sketch and, for
numbers, a KLL sketch of quantiles.  A load adds its own parts with ``merged``,
so that a profile of everything costs a scan of the new rows only.

Zero has one sign.  An empty table has a row per column, with counts of 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake import reference_data as ref

HLL_BITS = 12  # a standard error of 1.6 %
NESTED = (T.ArrayType, T.MapType, T.StructType)


def canonical(value: Column, kind: T.DataType) -> Column:
    """The value with maps as sorted arrays of entries."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(
            canonical(e["key"], kind.keyType).alias("key"), canonical(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.StructType):
        parts = F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), parts)
    return value


def comparable(field: T.StructField) -> Column:
    """A value that hashes alike where the column's values are equal."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, NESTED):  # wrapped, as a text needs an object around it; null stays null
        text = F.to_json(F.struct(canonical(value, field.dataType).alias("v")), {"ignoreNullFields": "false"})
        return F.when(value.isNotNull(), text)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return value + F.lit(0.0).cast(field.dataType)
    return value


def _bounds(field: T.StructField) -> tuple[Column, Column]:
    if isinstance(field.dataType, NESTED + (T.BinaryType,)):
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    value = comparable(field)
    return F.min(value).cast("string"), F.max(value).cast("string")


def _cells(df: DataFrame, more) -> DataFrame:
    """One row per column of counts and range, with further aggregates of ``more(field)``."""
    cells = []
    for i, f in enumerate(df.schema.fields):
        low, high = _bounds(f)
        cells.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("null_count"),
            low.alias("min_value"), high.alias("max_value"), *more(f)))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def _distinct_counts(df: DataFrame) -> DataFrame:
    """position, distinct_count of the columns that hold values."""
    pairs = []
    for i, f in enumerate(df.schema.fields):
        value = comparable(f)
        pairs.append(F.when(F.col(f"`{f.name}`").isNotNull(), F.struct(
            F.lit(i).alias("position"), F.xxhash64(value).alias("h1"), F.xxhash64(F.lit("second"), value).alias("h2"))))
    values = df.select(F.inline(F.array_compact(F.array(*pairs)))).distinct()
    return values.groupBy("position").agg(F.count(F.lit(1)).alias("distinct_count"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def column_profile(tables: dict[str, DataFrame], descriptions: dict[str, str] = ref.COLUMN_DESCRIPTIONS) -> DataFrame:
    """One row per column: type, description, nulls, distinct values, range; exact."""
    parts = []
    for name, df in tables.items():
        about = F.coalesce(*[F.when(F.col("column_name") == c, descriptions[c]) for c in df.columns if c in descriptions],
                           F.lit(""))
        parts.append(_cells(df, lambda f: []).join(_distinct_counts(df), "position", "left").select(
            F.lit(name).alias("table_name"), "column_name", "data_type", about.alias("description"), "row_count",
            "null_count", F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"), "min_value",
            "max_value"))
    return _all(parts)


def sketches(tables: dict[str, DataFrame]) -> DataFrame:
    """Mergeable profile, one row per column; ``numbers`` is the KLL sketch of a numeric column."""
    def more(f: T.StructField) -> list[Column]:
        value = comparable(f)
        hashed = F.when(F.col(f"`{f.name}`").isNotNull(), F.xxhash64(value))
        numeric = isinstance(f.dataType, T.NumericType)
        quantiles = F.kll_sketch_agg_double(value.cast("double")) if numeric else F.lit(None).cast("binary")
        return [F.hll_sketch_agg(hashed, HLL_BITS).alias("values"), quantiles.alias("numbers")]
    return _all([_cells(df, more).drop("position").select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()])


def merged(*parts: DataFrame) -> DataFrame:
    """Sketches of several loads as one.  Numbers are compared as numbers, dates by their text."""
    number = lambda c: F.when(F.col("data_type").rlike("int|decimal|double|float"),
                              F.col(c).try_cast("double"))
    keyed = lambda c: F.when(F.col(c).isNotNull(), F.struct(number(c), F.col(c)))
    return _all(list(parts)).groupBy("table_name", "column_name", "data_type").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.min_by("min_value", keyed("min_value")).alias("min_value"),
        F.max_by("max_value", keyed("max_value")).alias("max_value"),
        F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("numbers").alias("numbers"))


def sketch_profile(parts: DataFrame) -> DataFrame:
    """What the sketches tell: approximate distinct values and, for numbers, the median."""
    return parts.select("table_name", "column_name", "data_type", "row_count", "null_count",
                        F.hll_sketch_estimate("values").alias("distinct_count"), "min_value", "max_value",
                        F.when(F.kll_sketch_get_n_double("numbers") > 0,
                               F.kll_sketch_get_quantile_double("numbers", F.lit(0.5))).alias("median"))
