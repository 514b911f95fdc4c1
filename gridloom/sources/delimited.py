"""Delimited, white-space and binary number files: readers with line order, and writers.

Readers take any path that Spark reads. A line's place is its file's name, the start of the block it was read in, and its order in
that block (monotonically_increasing_id), whatever the order in which Spark packs files and blocks into tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import NUMBER_PREFIX
from ..operators.matrix import Matrix
from ..plans.lineage import global_rank

NAN = float("nan")
#: Delimiters that are looked for, in order of preference.
DELIMITERS = (",", "\t", ";", " ")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the lines that are not blank, numbered from 0."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return global_rank(raw.filter(F.trim("value") != ""), [F.col("_file"), F.col("_block"), F.col("_id")], "line").select("line", "value")


def _number(cell: Column) -> Column:
    """A trimmed cell as a number; text is NaN."""
    return F.coalesce(F.trim(cell).try_cast("double"), F.lit(NAN))


def dlmread(spark: SparkSession, path: str, delimiter: str, first_row: int = 0, first_col: int = 0) -> Matrix:
    """A matrix from delimited text: text is NaN, short rows are filled with 0 at the right, offsets count from 0."""
    quoted = r"\Q" + delimiter + r"\E"
    trimmed = F.trim("value") if delimiter == " " else F.col("value")
    rows = _lines(spark, path).filter(F.col("line") >= first_row).select((F.col("line") - first_row).alias("i"), F.split(trimmed, (quoted + "+") if delimiter == " " else quoted, -1).alias("parts"))
    size = rows.agg(F.count("*").alias("rows"), F.max(F.size("parts")).alias("cols")).first()
    cols = max((size["cols"] or 0) - first_col, 0)
    if not size["rows"] or not cols:
        return Matrix(spark.createDataFrame([], "i long, j long, v double"), 0, 0)
    at = F.sequence(F.lit(0), F.lit(cols - 1))
    cells = F.transform(at, lambda j: F.when(j + first_col < F.size("parts"), _number(F.get(F.col("parts"), j + first_col))).otherwise(F.lit(0.0)))
    out = rows.select("i", F.posexplode(cells).alias("j", "v"))
    return Matrix(out.select("i", F.col("j").cast("long").alias("j"), "v"), size["rows"], cols)


def csvread(spark: SparkSession, path: str, first_row: int = 0, first_col: int = 0) -> Matrix:
    return dlmread(spark, path, ",", first_row, first_col)


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter that the first line has most of."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    count = Counter(first["value"].strip() if first else "")
    return max(DELIMITERS, key=lambda d: (count[d], -DELIMITERS.index(d)))


def readmatrix(spark: SparkSession, path: str, delimiter: str | None = None) -> Matrix:
    return dlmread(spark, path, delimiter or sniff(spark, path))


def dlmwrite(m: Matrix, path: str, delimiter: str = ",", precision: int = 6, one_file: bool = True) -> None:
    """Lines of fixed decimals in row order, as Spark's text files in the folder `path`."""
    cells = m.full().df.select("i", "j", F.format_string(f"%.{precision}f", "v").alias("t"))
    rows = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "t"))).alias("c"))
    lines = rows.select("i", F.array_join(F.transform("c", lambda x: x["t"]), delimiter).alias("value"))
    dealt = lines.coalesce(1).sortWithinPartitions("i") if one_file else lines.repartitionByRange("i").sortWithinPartitions("i")
    dealt.select("value").write.mode("overwrite").text(path)


def csvwrite(path: str, m: Matrix) -> None:
    dlmwrite(m, path, ",")


def writematrix(m: Matrix, path: str, delimiter: str = ",") -> None:
    dlmwrite(m, path, delimiter)


def textscan(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A row per line with columns c1, c2, ... for %d %f %s %c, cut at white space; what can't be read is null."""
    import re

    kinds = re.findall(r"%[-0-9.]*([dfsc])", fmt)
    parts = F.split(F.trim("value"), r"\s+")
    lines = _lines(spark, path)
    cast = {"d": "long", "f": "double"}

    def column(k: int, kind: str) -> Column:
        c = F.get(parts, F.lit(k))
        return (F.regexp_extract(c, NUMBER_PREFIX, 1).try_cast("double").cast(cast[kind]) if kind in cast else F.substring(c, 1, 1) if kind == "c" else c).alias(f"c{k + 1}")

    return lines.select("line", *(column(k, kind) for k, kind in enumerate(kinds)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path)


def fscanf(spark: SparkSession, path: str) -> DataFrame:
    """All numbers of a text file as a column, in order: (k, v)."""
    tokens = _lines(spark, path).select("line", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "t"))
    numbers = tokens.select("line", "at", F.regexp_extract("t", NUMBER_PREFIX, 1).try_cast("double").alias("v")).filter("v is not null")
    return global_rank(numbers, [F.col("line"), F.col("at")], "k").select("k", "v")


def fread(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(path, k, v): doubles of binary files, the first n of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = raw.as_buffer()
                v = np.frombuffer(data, np.float64, data.size // 8)[:n]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(np.arange(len(v))), pa.array(v)], ["path", "k", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, k long, v double")


def fwrite(path: str, values) -> int:
    """Doubles or text to a driver file; the number of items written."""
    with open(path, "wb") as f:
        if isinstance(values, str):
            return f.write(values.encode())
        data = np.asarray(values, np.float64)
        f.write(data.tobytes())
        return data.size


def save(path: str, **values) -> None:
    """Matrices, numbers and texts by name, lossless: one Parquet folder of (name, kind, rows, cols, i, j, v, s)."""
    import functools

    spark = next((v.spark for v in values.values() if isinstance(v, Matrix)), None) or SparkSession.getActiveSession()
    parts = []
    for name, v in values.items():
        head = [F.lit(name).alias("name")]
        if isinstance(v, Matrix):
            parts.append(v.df.select(*head, F.lit("sparse" if v.sparse else "matrix").alias("kind"), F.lit(v.rows).cast("long").alias("rows"), F.lit(v.cols).cast("long").alias("cols"), "i", "j", "v", F.lit(None).cast("string").alias("s")))
            # Dimensions also of matrices without cells.
            parts.append(spark.range(1).select(*head, F.lit("sparse-dims" if v.sparse else "matrix-dims").alias("kind"), F.lit(v.rows).cast("long").alias("rows"), F.lit(v.cols).cast("long").alias("cols"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("string").alias("s")))
        else:
            text = isinstance(v, str)
            parts.append(spark.range(1).select(*head, F.lit("string" if text else "double").alias("kind"), F.lit(1).cast("long").alias("rows"), F.lit(1).cast("long").alias("cols"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(None if text else float(v)).cast("double").alias("v"), F.lit(v if text else None).cast("string").alias("s")))
    functools.reduce(DataFrame.unionByName, parts).write.mode("overwrite").partitionBy("name").parquet(path)


def load(spark: SparkSession, path: str) -> dict:
    """What save() wrote, by name; matrices stay lazy."""
    df = spark.read.schema("name string, kind string, rows long, cols long, i long, j long, v double, s string").parquet(path)
    out: dict = {}
    for r in df.filter(~F.col("kind").isin("matrix", "sparse")).collect():  # a row per name
        if r["kind"].endswith("-dims"):
            cells = df.filter((F.col("name") == r["name"]) & F.col("kind").isin("matrix", "sparse")).select("i", "j", "v")
            out[r["name"]] = Matrix(cells, r["rows"], r["cols"], r["kind"].startswith("sparse"))
        else:
            out[r["name"]] = r["s"] if r["kind"] == "string" else r["v"]
    return out
