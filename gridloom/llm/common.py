"""Pieces that several operators share: lineage cuts, hot-key joins, batch word tables and sampling."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python stage works on at once, whatever the Arrow batch holds (one longer text goes alone).
SLICE_BYTES = 4 << 20
#: Salts of a hot join key.
SALTS = 32
#: Bits of a map that picks rows by number: a prime of 1 MB.
PICK = 8388593


def ready_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; only where it is unset and Spark runs in one process take an own one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if where:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(where)
    elif not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there. With spark.cleaner.referenceTracking.cleanCheckpoints the files go
    when Spark no longer refers to them."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, into: SparkSession | None = None) -> DataFrame:
    """Write df as compressed Parquet under the shared checkpoint folder and read it back (in the session `into`): for rows with
    texts. Gone when the application ends, or by `discard`."""
    spark = df.sparkSession
    ready_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return (into or spark).read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that `written` has made."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join where a key may hold a large part of left's rows: left is dealt by (keys, hash of `by`), right repeated per salt.

    right should be the smaller side, with one row or few per key.
    """
    a = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string"))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3. A null id is never learned from."""
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(3)) == 1, F.lit(True))


def release() -> None:
    """Give what the allocators of this process hold but don't use back to the system: Python workers live on after a stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # in glibc only
        trim(0)


#: What this process keeps from task to task, by what made it.
_kept: dict[tuple, object] = {}


def keep(make: Callable, *given):
    """make(*given), kept for the tasks that follow until another stage asks for its own or none: Python workers serve one stage
    after the other, and tables of several stages would add up."""
    name = (make.__module__, make.__qualname__, given)
    if name not in _kept:
        keep_nothing()
        _kept[name] = make(*given)
    return _kept[name]


def keep_nothing() -> None:
    """Give up what earlier stages left in this process."""
    if _kept:
        _kept.clear()
        gc.collect()
        release()


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Row slices of a batch whose texts hold about `most` bytes; nulls become empty texts. Memory is released after the last."""
    at = batch.schema.get_field_index(column)
    text = batch.column(at)
    text = pc.fill_null(text if pa.types.is_large_string(text.type) else text.cast(pa.large_string()), "")
    batch = batch.set_column(at, column, text)
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(text)), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    release()


def coded_words(text: pa.Array, separators: str = "\n") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets of the rows in the words, word numbers, distinct words): texts cut at spaces, and at `separators` as if spaces."""
    for c in separators:
        text = pc.replace_substring(text, c, " ")
    parts = pc.split_pattern(text, " ")
    coded = parts.flatten().dictionary_encode()
    offsets = np.asarray(parts.offsets) - parts.offsets[0].as_py()
    return offsets.astype(np.int64), np.asarray(coded.indices).astype(np.int64), coded.dictionary


def text_words(text: pa.Array, separators: str = "\n") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The same, with a list of words."""
    offsets, number, words = coded_words(text, separators)
    return offsets, number, words.to_pylist()


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lengths[i]-1, for all i one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def row_bitmap(rows: DataFrame) -> np.ndarray:
    """A map of PICK bits with those of rows' _row set; its size does not grow with them."""
    words = rows.groupBy(F.shiftright(F.pmod(F.col("_row"), F.lit(PICK)).cast("int"), 6).alias("word"))
    words = words.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_row, {PICK}) & 63 as int))")).alias("bits")).toArrow()  # bounded by PICK
    out = np.zeros((PICK >> 6) + 1, np.uint64)
    out[np.asarray(words["word"])] = np.asarray(words["bits"]).view(np.uint64)
    return out


def picked_rows(bitmap: np.ndarray, inside: bool = True, number: str = "_row"):
    """The rows whose bit is set: those the map was made of and a few others. Or with `inside` false, all that surely weren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(number)) % PICK
            is_set = (bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            if (chosen := is_set if inside else ~is_set).any():
                yield batch.filter(pa.array(chosen))

    return run


def without_rows(df: DataFrame, dropped: DataFrame, number: str) -> DataFrame:
    """df without the rows numbered in dropped(_row). Rows that a bitmap of fixed size rules out stay without a shuffle."""
    bitmap = row_bitmap(dropped)
    sure = df.mapInArrow(picked_rows(bitmap, inside=False, number=number), df.schema)
    rest = df.mapInArrow(picked_rows(bitmap, number=number), df.schema)
    return sure.unionByName(rest.join(dropped.withColumnRenamed("_row", number), number, "left_anti").select(*df.columns))


def row_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, h, size) of docs: a hash of each whole row, and the characters of its text."""
    return docs.select("doc_id", F.xxhash64(*docs.columns).alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))


def bounded_sample(keys: DataFrame, most: int, characters: int, seed: str) -> list[tuple[int, int]]:
    """(doc_id, h) of at most `most` different rows of keys(doc_id, h, size) and at most `characters` in all, the same for the same
    data: in order of another hash, without those that no longer fit. Only rows under a hash bound are sorted, half more than asked."""
    order = F.xxhash64(F.lit(seed), "doc_id", "h")
    rows = keys.select("doc_id", "h", "size", order.alias("o"))
    share = 1.5 * most / max(1, rows.agg(F.approx_count_distinct("o")).first()[0])
    if share < 1:
        rows = rows.filter(F.col("o") < int(-(2.0**63) + share * 2.0**64))
    out, left = [], characters
    for r in rows.distinct().orderBy("o", "doc_id", "h").limit(most).collect():
        if r["size"] <= left:
            out.append((r["doc_id"], r["h"]))
            left -= r["size"]
    return out


def sample_texts(docs: DataFrame, chosen: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """The columns of docs and kind of the rows chosen for each kind, rows that repeat once."""
    picked = [(doc_id, h, kind) for kind, rows in chosen.items() for doc_id, h in rows]
    sample = docs.sparkSession.createDataFrame(picked, "doc_id long, h long, kind int")  # bounded by what was asked for
    rows = docs.withColumn("h", F.xxhash64(*docs.columns)).join(F.broadcast(sample), ["doc_id", "h"])
    return rows.dropDuplicates(["doc_id", "h", "kind"]).drop("h")
