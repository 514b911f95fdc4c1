"""Operator 5, exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers floor(scale * x). Candidates are dealt evenly; a task sorts each stretch of its candidates by
length and cuts it into buckets of similar length. For a query with k scores so far, the k-th score over (query length x the
bucket's largest length) is the bucket's local cosine threshold. Over 1, the bucket is skipped. From SHARP on, coordinates prune: a
candidate whose cosine reaches the threshold t has its part on the query's largest coordinate (of the two's directions, f and g)
within g * t -+ sqrt((1 - g^2) * (1 - t^2)), and a sorted list of that coordinate gives the few that are in there. Under SHARP, length prunes: only
candidates of at least k-th score over query length are looked at, a prefix of the bucket. Nothing is multiplied before it is pruned;
what is left is verified by exact products. Query rows are numbered and go in blocks of at most `block`, sent to every task of a pass.

Defined results: vectors null, or with null or non-finite components, or without a vec_id, take no part; vectors of unequal dimension
have no product; ties go to the smaller vec_id; every query row has its own k results, and rows that repeat its vec_id are no
candidates of it; a query without candidates has no rows, nor has an empty table. Components beyond 2^63 / scale are held there, and
products are exact as long as they stay under 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE, K = 1024, 10
#: Queries of one pass over the candidates: a block of 64-dimensional ones takes 2 MB.
BLOCK = 4096
#: Candidates of one bucket, candidates handled at once, and queries of similar reach that are multiplied together.
BUCKET, STRETCH, TOGETHER = 2048, 16384, 128
#: The local cosine threshold from which coordinates prune more than lengths.
SHARP = 0.8


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select("vec_id", whole.alias("v"))


class Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), -(2**63 - 1), np.int64)  # can be negated
        self.id = np.full((queries, k), 2**63 - 1, np.int64)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def merge(self, q: int, score: np.ndarray, vec_id: np.ndarray) -> None:
        k = self.score.shape[1]
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], vec_id])
        if len(s) > 4 * k:  # a cut by score first, as a sort of all is slow
            least = np.partition(s, len(s) - k)[len(s) - k]
            keep = s >= least
            s, i = s[keep], i[keep]
        order = np.lexsort((i, -s))[:k]
        self.score[q], self.id[q] = s[order], i[order]


class Bucket:
    """Candidates by falling length, with lists sorted by a coordinate of their directions as they are asked for."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, norm: np.ndarray):
        self.vectors, self.ids, self.norm = vectors, ids, norm
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def between(self, coordinate: int, low: float, high: float) -> np.ndarray:
        """Rows whose direction has a coordinate in the range."""
        if coordinate not in self.lists:
            part = self.vectors[:, coordinate] / np.maximum(self.norm, 1e-30)
            order = np.argsort(part, kind="stable")
            self.lists[coordinate] = part[order], order
        part, order = self.lists[coordinate]
        return np.sort(order[np.searchsorted(part, low) : np.searchsorted(part, high, side="right")])


def search_bucket(best: Best, queries: np.ndarray, query_ids: np.ndarray, query_norm: np.ndarray, bucket: Bucket) -> int:
    """Score one bucket; returns how many products it took."""
    floor = best.floor()
    # Lengths that a candidate must have; a k-th score that is missing, or not over 0, asks for none.
    reach = np.where(floor > 0, floor / np.maximum(query_norm, 1e-30) * (1 - 1e-9), -1.0)
    upto = np.searchsorted(-bucket.norm, -reach, side="right")
    cosine = reach / max(float(bucket.norm[0]), 1e-30)
    products = 0

    def merge(q: int, rows: np.ndarray, score: np.ndarray) -> None:
        good = (score >= floor[q]) & (bucket.ids[rows] != query_ids[q])
        if good.any():
            best.merge(q, score[good].astype(np.int64), bucket.ids[rows[good]])

    for q in np.flatnonzero((upto > 0) & (cosine >= SHARP)).tolist():
        at = int(np.abs(queries[q]).argmax())
        g, t = float(queries[q, at]) / max(float(query_norm[q]), 1e-30), min(1.0, float(cosine[q]))
        slack = np.sqrt(max(0.0, 1 - g * g) * (1 - t * t)) + 1e-7
        # Towards the direction itself any cosine over t is allowed, so the range is that of all angles up to arccos(t).
        low, high = (-1.0 if g <= -t else g * t - slack), (1.0 if g >= t else g * t + slack)
        rows = bucket.between(at, low, high)
        rows = rows[rows < upto[q]]
        products += len(rows)
        if len(rows):
            merge(q, rows, bucket.vectors[rows] @ queries[q])
    wide = np.flatnonzero((upto > 0) & (cosine < SHARP))
    wide = wide[np.argsort(upto[wide], kind="stable")]
    for a in range(0, len(wide), TOGETHER):
        some = wide[a : a + TOGETHER]
        end = int(upto[some[-1]])
        full = queries[some] @ bucket.vectors[:end].T
        products += full.size
        for i in np.flatnonzero((full >= floor[some][:, None]).any(1)).tolist():
            rows = np.flatnonzero(full[i] >= floor[some[i]])
            merge(int(some[i]), rows, full[i, rows])
    return products


def search(numbers: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Rows (q, query_id, vec_id, score): each query's k best of a task's candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = queries.shape[1]
        best = Best(len(queries), k)
        peak = int(np.abs(queries).max(initial=0))
        norm_q = np.sqrt((queries.astype(float) ** 2).sum(1))
        as_float = queries.astype(float)
        for batch in batches:
            v = batch.column("v")
            batch = batch.filter(pc.equal(pc.list_value_length(v), dim))
            for a in range(0, batch.num_rows, STRETCH):
                part = batch.slice(a, STRETCH)
                cand = np.asarray(part.column("v").flatten()).reshape(-1, dim)
                ids = np.asarray(part.column("vec_id"))
                whole = peak * int(np.abs(cand).max(initial=0)) * dim >= 2**53  # beyond floats: products of integers
                norm = np.sqrt((cand.astype(float) ** 2).sum(1))
                order = np.lexsort((ids, -norm))
                use = cand if whole else cand.astype(float)
                for b in range(0, len(order), BUCKET):
                    rows = order[b : b + BUCKET]
                    search_bucket(best, queries if whole else as_float, query_ids, norm_q, Bucket(use[rows], ids[rows], norm[rows]))
        q, r = np.nonzero(best.id != 2**63 - 1)
        yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(query_ids[q]), pa.array(best.id[q, r]), pa.array(best.score[q, r])], ["q", "query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of every query row against every other row."""
    spark = vectors.sparkSession
    whole = written(integer_vectors(vectors, scale))
    asked = written(whole.filter(is_query).select(F.monotonically_increasing_id().alias("q"), "vec_id", "v", F.size("v").alias("dim")))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    passes: list[DataFrame] = []
    # Each pass brings at most `block` queries to the driver and on to the tasks, and leaves k rows a query.
    for dim in sorted(r["dim"] for r in asked.select("dim").distinct().collect()):
        own, after = asked.filter(F.col("dim") == dim), -1
        while True:
            rows = own.filter(F.col("q") > after).orderBy("q").limit(block).toArrow()
            if not rows.num_rows:
                break
            numbers, ids = np.asarray(rows["q"]), np.asarray(rows["vec_id"])
            queries = np.asarray(rows["v"].combine_chunks().flatten()).reshape(-1, dim)
            found = whole.mapInArrow(search(numbers, ids, queries, k), "q long, query_id long, vec_id long, score long")
            found = found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            last = len(ids) < block
            passes.append(found if last and not passes else written(found))
            after = int(numbers[-1])
            if last:
                break
    if not passes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = passes[0]
    for found in passes[1:]:
        out = out.unionByName(found)
    return out


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
