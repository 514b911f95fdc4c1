"""Operator 10, line deduplication over levelled sorted runs of line hashes. DataFrame functions only.

A LineRuns store holds runs: tables of (h1, h2, n, first) with n documents per line key and the first of them, dealt by hash into a fixed number of partitions
and sorted in each, so that runs merge-join without a shuffle or a sort. A batch of documents counts its keys, is
merge-anti-joined with the keys already known to be common, and is added as a run of level 0. Once a level has `fanout` runs they
are compacted into one of the next level. A line key is known by 128 bits of hash.

Defined results: a null or empty text is one empty line; repeated rows count as documents of their own; an empty table gives no
rows; other columns pass through; empty keys (under `least` code points) never count as common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, salted_join, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(lines: Column, least: int) -> Column:
    """struct(h1, h2) of each line's key, null where the key has under `least` code points.

    Keys are stripped of ASCII white space at both ends and A-Z lower-cased; pure ASCII takes the faster way. One array step after
    the other, so that nothing is worked out twice.
    """
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE)))
    keys = F.transform(bare, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))
    return F.transform(keys, lambda x: F.when(F.length(x) >= least, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))))


def distinct_keys(text: Column, least: int) -> Column:
    return F.array_compact(F.array_distinct(line_hashes(lines_of(text), least)))


class LineRuns:
    """Levelled runs of line-key counts."""

    def __init__(self, spark: SparkSession, common: int, fanout: int = 4, partitions: int | None = None):
        self.spark, self.common, self.fanout = spark, common, fanout
        self.partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # A run knows how it is dealt and sorted only if it comes from a fixed plan: runs live in a session without adaptive plans.
        self.own = spark.newSession()
        self.own.conf.set("spark.sql.adaptive.enabled", "false")
        self.own.conf.set("spark.sql.shuffle.partitions", str(self.partitions))
        self.levels: list[list[DataFrame]] = [[]]

    def _run(self, counts: DataFrame) -> DataFrame:
        return cut(counts.repartition(self.partitions, "h1", "h2").sortWithinPartitions("h1", "h2"))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, counts: DataFrame) -> None:
        """A batch's (h1, h2, n, first). Keys that a run already knows as common are left out: their count can change nothing."""
        counts = counts if counts.sparkSession is self.own else written(counts, self.own)
        new = counts.repartition(self.partitions, "h1", "h2")
        for run in self.runs():
            new = new.join(run.filter(F.col("n") >= self.common).hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._run(new))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return self._run(out.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("first")))

    def common_keys(self) -> DataFrame:
        """(h1, h2, first) of the keys found in at least `common` documents."""
        runs = self.runs()
        every = runs[0] if len(runs) == 1 else self._merged(runs)
        return written(every.filter(F.col("n") >= self.common).select("h1", "h2", "first"), self.spark)


def batch_counts(docs: DataFrame, batches: int, least: int) -> DataFrame:
    """(batch, h1, h2, n, first): documents per line key of each batch; every document is in one."""
    keyed = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), F.explode(distinct_keys(F.col("text"), least)).alias("k"))
    return keyed.groupBy("batch", "k.h1", "k.h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def drop_common_lines(docs: DataFrame, common: int = 10, least: int = 1, batches: int = 4, keep_first: bool = False, runs: LineRuns | None = None, added: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
    """docs with the columns `added` (lines, lines dropped, text left): without the lines whose key at least `common` documents have.

    With `keep_first`, such lines stay in the document that brought them first: the smallest doc_id of the earliest batch.
    `runs` may hold earlier corpora; docs are added to it as `batches` batches. Columns of docs named as in `added` are replaced; any
    other column passes through.
    """
    runs = runs or LineRuns(docs.sparkSession, common)
    counts = written(batch_counts(docs.select("doc_id", "text"), batches, least), runs.own)
    for b in range(batches):
        runs.add(counts.filter(F.col("batch") == b).drop("batch"))
    keys = runs.common_keys()
    lines = docs.select("doc_id", F.explode(distinct_keys(F.col("text"), least)).alias("_k")).select("doc_id", "_k.h1", "_k.h2")
    found = salted_join(lines, keys, ["h1", "h2"], F.col("doc_id"))
    if keep_first:
        found = found.filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    own, hits, kept = fresh("_doc", docs), fresh("_common", docs), fresh("_kept", docs)
    hit = found.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("h1", "h2")).alias(hits))
    joined = docs.join(hit, docs["doc_id"].eqNullSafe(hit[own]), "left").drop(own)
    lines_ = lines_of(F.col("text"))
    both = F.arrays_zip(lines_.alias("line"), line_hashes(lines_, least).alias("key"))
    left = F.filter(both, lambda x: ~F.coalesce(F.array_contains(F.col(hits), x["key"]), F.lit(False)))["line"]
    joined = joined.withColumn(kept, F.when(F.col(hits).isNull(), lines_).otherwise(left))
    n_lines, n_dropped, text = added
    whole = F.size(lines_).cast("long")
    new = {n_lines: whole, n_dropped: whole - F.size(kept), text: F.array_join(kept, "\n")}
    return joined.select(*(F.col(c) for c in docs.columns if c not in new), *(v.alias(k) for k, v in new.items()))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, u.line AS line,
    translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
    LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) u),
common AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (common.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (k) GROUP BY doc_id
"""
