"""Cells, structs, maps, categories and tables as columns and DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.lineage import global_rank


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# Cells: arrays of any values.

cell = lambda *values: F.array(*(F.parse_json(F.to_json(F.struct(_c(v).alias("x")))) for v in values))
cell_get = lambda c, k, kind="string": F.try_variant_get(F.get(c, _c(k) - 1), "$.x", kind)


def cell_empty(rows: int, cols: int | None = None) -> Column:
    """cell(n) is 1 x n."""
    return F.array_repeat(F.lit(None).cast("variant"), rows * cols if cols is not None else rows)


def cell_put(c: Column, k: int, value) -> Column:
    """C{k} = value, grown with nulls if needed."""
    new = F.parse_json(F.to_json(F.struct(_c(value).alias("x"))))
    size = F.greatest(F.size(c), F.lit(k))
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i == k, new).otherwise(F.get(c, i - 1)))


# Structs.

field = lambda s, name: s[name]
set_field = lambda s, name, value: s.withField(name, _c(value))


def fieldnames(df: DataFrame, column: str) -> list[str]:
    return df.schema[column].dataType.fieldNames()


# Maps.

make_map = lambda keys, values: F.map_from_arrays(F.transform(keys, lambda k: k.cast("string")), values)
is_key = lambda m, k: F.coalesce(F.map_contains_key(m, _c(k).cast("string")), F.lit(False)).cast("double")
keys = lambda m: F.array_sort(F.map_keys(m))
values = lambda m: F.transform(keys(m), lambda k: F.try_element_at(m, k))
remove = lambda m, k: F.map_filter(m, lambda key, _: key != _c(k).cast("string"))
lookup = lambda m, k: F.try_element_at(m, _c(k).cast("string"))


# Categories: codes from 0 in order of first appearance.


def categories(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code): one row per category. Codes are ranks of first places, found by range partitions."""
    first = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    return global_rank(first, [F.col("_first"), F.col(value)], "code").select(value, "code")


def categorical(df: DataFrame, value: str, order: str) -> DataFrame:
    """df with the code of each value."""
    return df.join(categories(df, value, order), value, "left")


# Tables.


def add_row(table: DataFrame, *row) -> DataFrame:
    """A new table with one more row; the number of values must be that of the columns."""
    if len(row) != len(table.columns):
        raise ValueError(f"the table has {len(table.columns)} columns, the row {len(row)} values")
    return table.unionByName(table.sparkSession.createDataFrame([Row(*row)], table.schema))


def with_row_number(table: DataFrame, *order: str) -> DataFrame:
    """The table with _row from 1 in the order given."""
    return global_rank(table, [F.col(o) for o in order], "_row").withColumn("_row", F.col("_row") + 1)


def remove_row(table: DataFrame, k: int, *order: str) -> DataFrame:
    return with_row_number(table, *order).filter(F.col("_row") != k).drop("_row")


def get_row(table: DataFrame, k: int, *order: str) -> DataFrame:
    return with_row_number(table, *order).filter(F.col("_row") == k).drop("_row")


def set_value(table: DataFrame, k: int, column: str, value, *order: str) -> DataFrame:
    kind = table.schema[column].dataType
    return with_row_number(table, *order).withColumn(column, F.when(F.col("_row") == k, F.lit(value)).otherwise(F.col(column)).cast(kind)).drop("_row")


height = lambda table: table.agg(F.count("*").alias("height"))
width = lambda table: len(table.columns)


# Type predicates on schemas.

#: Class names and the Spark types that stand for them.
CLASSES = {
    "double": ("double",), "numeric": ("double", "float", "int", "bigint"), "logical": ("boolean",), "char": ("string",),
    "string": ("array<string>",), "cell": ("array<variant>",), "struct": ("struct",), "Map": ("map",), "containers.Map": ("map",),
    "datetime": ("timestamp_ntz", "timestamp"), "duration": ("interval",), "sparse": ("struct<i",), "ndarray": ("struct<dims",),
}


def isa(df: DataFrame, column: str, kind: str) -> float:
    found = df.schema[column].dataType.simpleString()
    return float(any(found == k or (k in ("struct", "map", "interval", "struct<i", "struct<dims") and (found.startswith(k) or k in found.split("<")[0])) for k in CLASSES.get(kind, ())))


isstruct = lambda df, c: isa(df, c, "struct")
iscell = lambda df, c: isa(df, c, "cell")
isdatetime = lambda df, c: isa(df, c, "datetime")
isduration = lambda df, c: isa(df, c, "duration")
isstring = lambda df, c: isa(df, c, "string")
islogical = lambda df, c: isa(df, c, "logical")
ischar = lambda df, c: isa(df, c, "char")
isndarray = lambda df, c: isa(df, c, "ndarray")
istable = lambda x: float(isinstance(x, DataFrame))
iscategorical = lambda df: float({"code"} <= set(df.columns))


def issparse(x) -> float:
    from ..operators.matrix import Matrix

    return float(isinstance(x, Matrix) and x.sparse)


def isregex(x) -> float:
    import re

    return float(isinstance(x, re.Pattern))
