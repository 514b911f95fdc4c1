"""Operator 8, Grace hash exact deduplication.

Equal means equal in every character. Three steps:
1. Each input task keeps one row per distinct text of its own, so that a text with many copies crosses the shuffle at most once
   per task, and remembers which document went with which local representative.
2. Representatives are dealt by content hash. A task partitions its share to spill files by hash digits, again and again, until a
   bucket's distinct content fits an open-addressing table, and compares complete content there. Spill files are scratch of one
   task attempt, like Spark's own: nothing else reads them, they are removed when the task ends, and a lost task runs again
   from the shuffle.
3. Members learn their group by a join on the local group's number, a key with no more rows than one input task has.

Defined results: null counts as the empty text; the row with the largest doc_id stays (rows that repeat both doc_id and text share its fate);
a null doc_id sorts below all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Content bytes that a table may hold before its records are partitioned to spill files.
TABLE_BYTES = 64 << 20
FANOUT = 16
NULL_ID = -(2**63)
HEAD = struct.Struct("<QqqqQ")


class ContentTable:
    """Open addressing with linear probing: content -> group number, comparing complete content where hashes agree."""

    def __init__(self):
        self.slots = np.full(1024, -1, np.int64)
        self.hashes: list[int] = []
        self.content: list[bytes] = []
        self.bytes = 0

    def place(self, h: int, content: bytes) -> int:
        slots, mask = self.slots, len(self.slots) - 1
        at = (h ^ (h >> 32)) & mask
        while (g := slots[at]) >= 0:
            if self.hashes[g] == h and self.content[g] == content:
                return int(g)
            at = (at + 1) & mask
        g = len(self.content)
        slots[at] = g
        self.hashes.append(h)
        self.content.append(content)
        self.bytes += len(content) + 64
        if 2 * g > mask:
            self._grow()
        return g

    def _grow(self):
        self.slots = np.full(4 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for g, h in enumerate(self.hashes):
            at = (h ^ (h >> 32)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = g


class Spill:
    """Files of (hash, group, top id, count, content) records, one per hash digit; scratch of one task attempt."""

    def __init__(self, level: int):
        self.level = level
        self.files = [tempfile.TemporaryFile() for _ in range(FANOUT)]

    def add(self, h: int, gid: int, top: int, n: int, content: bytes):
        f = self.files[(h >> (60 - 4 * self.level)) & (FANOUT - 1)]
        f.write(HEAD.pack(h, gid, top, n, len(content)))
        f.write(content)

    def buckets(self):
        for f in self.files:
            f.seek(0)
            yield self._read(f)
            f.close()

    def close(self):
        for f in self.files:
            f.close()

    @staticmethod
    def _read(f):
        while head := f.read(HEAD.size):
            *record, size = HEAD.unpack(head)
            yield *record, f.read(size)


def groups(records, level: int = 0, most: int = TABLE_BYTES):
    """Yield (members, keep, size, digest) per distinct content of (hash, group, top id, count, content) records.

    Copies take no room in the table. Once its distinct content is over `most` bytes, everything seen and everything to come is
    partitioned by the next hash digit; after all digits the table takes what is left (records of one and the same hash).
    """
    table, members = ContentTable(), []
    spill = None
    try:
        for h, gid, top, n, content in records:
            if spill is not None:
                spill.add(h, gid, top, n, content)
                continue
            g = table.place(h, content)
            if g == len(members):
                members.append([])
            members[g].append((gid, top, n))
            if table.bytes > most and level < 16:
                spill = Spill(level)
                for g, content in enumerate(table.content):
                    for m in members[g]:
                        spill.add(table.hashes[g], *m, content)
                table, members = ContentTable(), []
        if spill is None:
            for own, content in zip(members, table.content, strict=True):
                yield [m[0] for m in own], max(m[1] for m in own), sum(m[2] for m in own), hashlib.sha256(content).hexdigest()
        else:
            for bucket in spill.buckets():
                yield from groups(bucket, level + 1, most)
    finally:
        if spill is not None:
            spill.close()


def _texts(part: pa.RecordBatch) -> tuple[list[int], list[bytes]]:
    return np.asarray(part.column("h")).astype(np.uint64).tolist(), part.column("text").cast(pa.large_binary()).to_pylist()


def local_groups(most: int):
    """Input side: rows (doc_id, gid, top, n, h, text); gid is a text's number in a stretch of the task's input, and one row of
    each has the text with its number of rows and largest doc_id. A full table is emptied and a new stretch begins."""
    kinds = {"doc_id": pa.int64(), "gid": pa.int64(), "top": pa.int64(), "n": pa.int64(), "h": pa.int64(), "text": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40

        def emit():
            nonlocal base
            rows = []
            for g, content in enumerate(table.content):
                own = members[g]
                h = table.hashes[g] - 2**64 * (table.hashes[g] >= 2**63)
                rows.append((own[0], base + g, max(NULL_ID if m is None else m for m in own), len(own), h, content))
                rows += [(m, base + g, None, None, None, None) for m in own[1:]]
            base += len(table.content)
            for a in range(0, len(rows), 2000):
                columns = [pa.array(c, k) for c, k in zip(zip(*rows[a : a + 2000], strict=True), kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].cast(pa.string())], list(kinds))

        table, members = ContentTable(), []
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, h, content in zip(part.column("doc_id").to_pylist(), *_texts(part), strict=True):
                    g = table.place(h, content)
                    if g == len(members):
                        members.append([])
                    members[g].append(doc)
                    if table.bytes > most:
                        yield from emit()
                        table, members = ContentTable(), []
        yield from emit()

    return run


def grace(most: int):
    """Table side: rows (gid, keep_id, group_size, text_sha256) for a task's share of the hashes."""
    kinds = {"gid": pa.int64(), "keep_id": pa.int64(), "group_size": pa.int64(), "text_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for part in slices(batch, "text"):
                    h, content = _texts(part)
                    yield from zip(h, *(part.column(c).to_pylist() for c in ("gid", "top", "n")), content, strict=True)

        rows: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

        for members, keep, size, digest in groups(records(), most=most):
            for gid in members:
                rows.append((gid, keep, size, digest))
                if len(rows) >= 10_000:
                    yield out()
                    rows.clear()
        if rows:
            yield out()

    return run


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    local = written(hashed.mapInArrow(local_groups(table_bytes), "doc_id long, gid long, top long, n long, h long, text string"))
    shares = local.filter("n is not null").select("gid", "top", "n", "h", "text").repartition("h")
    found = shares.mapInArrow(grace(table_bytes), "gid long, keep_id long, group_size long, text_sha256 string")
    one = local.select("doc_id", "gid").join(found, "gid")
    keep = F.when(F.col("keep_id") == NULL_ID, F.lit(None)).otherwise(F.col("keep_id"))
    return one.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
