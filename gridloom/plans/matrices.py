"""Registered queries of matrix operators, with their SQL. The matrix E has a row per embedding and a column per component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linalg as la
from ..operators import matrix as mx
from ..operators.matrix import Matrix
from .elementwise import table

DIM = 64


def embeddings(spark, sf_dir: str) -> Matrix:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return Matrix.from_arrays(df, "vec_id", "embedding", DIM, df.count())


def cells(m: Matrix, digits: int = 6) -> DataFrame:
    return m.df.select("i", "j", (F.round("v", digits) + 0.0).alias("v"))


E = "WITH e AS (SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT count(*) AS r, 64 AS c FROM embeddings) "
#: name: (matrix of E, SQL that gives i, j, v from e and s).
CELLS = {
    "mm_transpose": (lambda e: e.T, "SELECT j AS i, i AS j, v FROM e"),
    "mm_gram": (lambda e: e.T.matmul(e), "SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2"),
    "mm_gram_blocks": (lambda e: la.block_multiply(e.T, e, 64), "SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2"),
    "mm_matvec": (lambda e: e.matmul(e.row(1).T), "SELECT a.i AS i, 0 AS j, sum(a.v * b.v) AS v FROM e a JOIN e b ON b.i = 0 AND a.j = b.j GROUP BY 1"),
    "mm_plus": (lambda e: e.add(e.flipud()), "SELECT a.i, a.j, a.v + b.v AS v FROM e a, s, e b WHERE b.i = s.r - 1 - a.i AND b.j = a.j"),
    "mm_minus": (lambda e: e.subtract(e.flipud()), "SELECT a.i, a.j, a.v - b.v AS v FROM e a, s, e b WHERE b.i = s.r - 1 - a.i AND b.j = a.j"),
    "mm_times": (lambda e: e.times(e.flipud()), "SELECT a.i, a.j, a.v * b.v AS v FROM e a, s, e b WHERE b.i = s.r - 1 - a.i AND b.j = a.j"),
    "mm_divide": (lambda e: e.divide(e.flipud().times(e.flipud()).add(1.0)), "SELECT a.i, a.j, a.v / (b.v * b.v + 1) AS v FROM e a, s, e b WHERE b.i = s.r - 1 - a.i AND b.j = a.j"),
    "mm_scale": (lambda e: e.scale(2.5), "SELECT i, j, v * 2.5 AS v FROM e"),
    "mm_modulo": (lambda e: e.modulo(0.0625), "SELECT i, j, v - trunc(v / 0.0625) * 0.0625 AS v FROM e"),
    "mm_power": (lambda e: e.power(2.0), "SELECT i, j, v * v AS v FROM e"),
    "mm_compare": (lambda e: e.gt(e.flipud()), "SELECT a.i, a.j, CASE WHEN a.v > b.v THEN 1.0 ELSE 0.0 END AS v FROM e a, s, e b WHERE b.i = s.r - 1 - a.i AND b.j = a.j"),
    "mm_negative": (lambda e: e.negative(), "SELECT i, j, -v AS v FROM e"),
    "mm_horzcat": (lambda e: e.horzcat(e.scale(2)), "SELECT i, j, v FROM e UNION ALL SELECT i, j + 64, 2 * v FROM e"),
    "mm_vertcat": (lambda e: e.vertcat(e.scale(2)), "SELECT i, j, v FROM e UNION ALL SELECT i + r, j, 2 * v FROM e, s"),
    "mm_blkdiag": (lambda e: e.blkdiag(Matrix.from_rows(e.spark, [[1, 2], [3, 4]])).to_sparse(), "SELECT i, j, v FROM e WHERE v <> 0 UNION ALL SELECT r + a, 64 + b, w FROM s, (VALUES (0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)) t(a, b, w)"),
    "mm_kron": (lambda e: e.kron(Matrix.from_rows(e.spark, [[1, 2], [3, 4]])), "SELECT 2 * i + a AS i, 2 * j + b AS j, v * w AS v FROM e, (VALUES (0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)) t(a, b, w)"),
    "mm_repmat": (lambda e: e.repmat(2, 3), "SELECT i + a * r AS i, j + b * 64 AS j, v FROM e, s, range(2) x(a), range(3) y(b)"),
    "mm_reshape": (lambda e: e.reshape(e.rows * 2, 32), "SELECT (i * 64 + j) // 32 AS i, (i * 64 + j) % 32 AS j, v FROM e"),
    "mm_column": (lambda e: e.column(), "SELECT i * 64 + j AS i, 0 AS j, v FROM e"),
    "mm_flipud": (lambda e: e.flipud(), "SELECT r - 1 - i AS i, j, v FROM e, s"),
    "mm_fliplr": (lambda e: e.fliplr(), "SELECT i, 63 - j AS j, v FROM e"),
    "mm_rot90": (lambda e: e.rot90(), "SELECT 63 - j AS i, i AS j, v FROM e"),
    "mm_rot270": (lambda e: e.rot90(-1), "SELECT j AS i, r - 1 - i AS j, v FROM e, s"),
    "mm_diag": (lambda e: e.diag(1), "SELECT 0 AS i, i AS j, v FROM e WHERE j - i = 1"),
    "mm_tril": (lambda e: e.tril(-1), "SELECT i, j, CASE WHEN j <= i - 1 THEN v ELSE 0 END AS v FROM e"),
    "mm_triu": (lambda e: e.triu(-1), "SELECT i, j, CASE WHEN j >= i - 1 THEN v ELSE 0 END AS v FROM e"),
    "mm_mpower": (lambda e: e.T.matmul(e).over(10.0).mpower(2), ", g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) / 10 AS v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2) SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY 1, 2"),
    "sp_sparse": (lambda e: e.map(lambda v: F.when(F.abs(v) > 0.1, v).otherwise(0.0)).to_sparse(), "SELECT i, j, v FROM e WHERE abs(v) > 0.1"),
    "sp_add": (lambda e: thin(e).add(thin(e.flipud())), "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM e WHERE abs(v) > 0.1 UNION ALL SELECT r - 1 - i, j, v FROM e, s WHERE abs(v) > 0.1) GROUP BY 1, 2 HAVING sum(v) <> 0"),
    "sp_subtract": (lambda e: thin(e).subtract(thin(e.flipud())), "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM e WHERE abs(v) > 0.1 UNION ALL SELECT r - 1 - i, j, -v FROM e, s WHERE abs(v) > 0.1) GROUP BY 1, 2 HAVING sum(v) <> 0"),
    "sp_scale": (lambda e: thin(e).scale(3), "SELECT i, j, 3 * v AS v FROM e WHERE abs(v) > 0.1"),
    "sp_matvec": (lambda e: thin(e).matmul(mx.ones(e.spark, DIM, 1)), "SELECT i, 0 AS j, sum(v) AS v FROM e WHERE abs(v) > 0.1 GROUP BY 1 HAVING sum(v) <> 0"),
    "sp_full": (lambda e: thin(e).full(), "SELECT i, j, CASE WHEN abs(v) > 0.1 THEN v ELSE 0 END AS v FROM e"),
    "sp_transpose": (lambda e: thin(e).T, "SELECT j AS i, i AS j, v FROM e WHERE abs(v) > 0.1"),
    "sp_matmul": (lambda e: thin(e).T.matmul(thin(e)), "SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i = b.i WHERE abs(a.v) > 0.1 AND abs(b.v) > 0.1 GROUP BY 1, 2 HAVING sum(a.v * b.v) <> 0"),
    "sp_from_cells": (lambda e: mx.sparse(e.spark, e.df.select((F.col("i") % 50 + 1).alias("i"), (F.col("j") + 1).alias("j"), "v"), 50, DIM), "SELECT i % 50 AS i, j, sum(v) AS v FROM e GROUP BY 1, 2 HAVING sum(v) <> 0"),
    "sp_spdiags": (lambda e: mx.spdiags(e, list(range(-31, 33)), e.rows, e.rows), "SELECT i, i + j - 31 AS j, v FROM e, s WHERE i + j - 31 >= 0 AND i + j - 31 < r AND v <> 0"),
    "ix_row": (lambda e: e.row(3), "SELECT 0 AS i, j, v FROM e WHERE i = 2"),
    "ix_col": (lambda e: e.col(5), "SELECT i, 0 AS j, v FROM e WHERE j = 4"),
    "ix_block": (lambda e: e.sub(range(2, e.rows, 3), range(64, 0, -2)), "SELECT (i - 1) // 3 AS i, (63 - j) // 2 AS j, v FROM e, s WHERE i >= 1 AND (i - 1) % 3 = 0 AND i < r - 1 AND (63 - j) % 2 = 0"),
    "ix_element": (lambda e: e.at(130), "SELECT 0 AS i, 0 AS j, v FROM e WHERE i * 64 + j = 129"),
    "ix_linear": (lambda e: e.linear_range(range(5, e.rows * DIM + 200, 7)), "SELECT k AS i, 0 AS j, coalesce(v, 0) AS v FROM (SELECT (a - 5) // 7 AS k, a - 1 AS place FROM range(5, (SELECT r * 64 + 200 FROM s), 7) t(a)) LEFT JOIN e ON e.i * 64 + e.j = place"),
    "ix_assign": (lambda e: e.set(2, 3, 9.5), "SELECT i, j, CASE WHEN i = 1 AND j = 2 THEN 9.5 ELSE v END AS v FROM e"),
    "ix_assign_mask": (lambda e: e.assign_mask(e.lt(0.0), 0.0), "SELECT i, j, CASE WHEN v < 0 THEN 0 ELSE v END AS v FROM e"),
    "scan_cumsum_1": (lambda e: e.cumsum(1), "SELECT i, j, sum(v) OVER (PARTITION BY j ORDER BY i) AS v FROM e"),
    "scan_cumsum_2": (lambda e: e.cumsum(2), "SELECT i, j, sum(v) OVER (PARTITION BY i ORDER BY j) AS v FROM e"),
    "scan_cumsum": (lambda e: e.cumsum(), "SELECT i, j, sum(v) OVER (ORDER BY i, j) AS v FROM e"),
    "scan_cumprod_2": (lambda e: e.add(1.0).cumprod(2), "SELECT i, j, product(1 + v) OVER (PARTITION BY i ORDER BY j) AS v FROM e"),
    "scan_diff": (lambda e: e.flatten().diff(), "SELECT 0 AS i, k - 1 AS j, d AS v FROM (SELECT i * 64 + j AS k, v - lag(v) OVER (ORDER BY i, j) AS d FROM e) WHERE k > 0"),
    "scan_diff2": (lambda e: e.flatten().diff(2), "SELECT 0 AS i, k - 2 AS j, d AS v FROM (SELECT i * 64 + j AS k, v - 2 * lag(v) OVER (ORDER BY i, j) + lag(v, 2) OVER (ORDER BY i, j) AS d FROM e) WHERE k > 1"),
    "mm_hilb": (lambda e: mx.hilb(e.spark, 40), "SELECT a AS i, b AS j, 1 / CAST(a + b + 1 AS DOUBLE) AS v FROM range(40) x(a), range(40) y(b)"),
    "mm_vander": (lambda e: mx.vander(e.row(1)).sub(None, range(33, 65)), "SELECT a.j AS i, b AS j, pow(a.v, 31 - b) AS v FROM e a, range(32) y(b) WHERE a.i = 0"),
    "mm_meshgrid": (lambda e: mx.meshgrid(e.row(1), e.row(2)), "SELECT k AS i, j, v FROM e, range(64) t(k) WHERE i = 0 UNION ALL SELECT j AS i, 64 + k AS j, v FROM e, range(64) t(k) WHERE i = 1"),
    "mm_pascal": (lambda e: mx.pascal(e.spark, 12), "SELECT a AS i, b AS j, round(CAST(factorial(CAST(a + b AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(a AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST(b AS INTEGER)) AS DOUBLE)) AS v FROM range(12) x(a), range(12) y(b)"),
    "mm_eye": (lambda e: mx.eye(e.spark, 64), "SELECT a AS i, b AS j, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS v FROM range(64) x(a), range(64) y(b)"),
    "mm_speye": (lambda e: mx.speye(e.spark, 64, 80), "SELECT a AS i, a AS j, 1.0 AS v FROM range(64) x(a)"),
    "mm_zeros_ones": (lambda e: mx.zeros(e.spark, 30, 20).vertcat(mx.ones(e.spark, 10, 20)), "SELECT a AS i, b AS j, CASE WHEN a < 30 THEN 0.0 ELSE 1.0 END AS v FROM range(40) x(a), range(20) y(b)"),
    "mm_linspace": (lambda e: mx.linspace(e.spark, -3, 7, 1001), "SELECT a AS i, 0 AS j, -3 + 10 * CAST(a AS DOUBLE) / 1000 AS v FROM range(1001) x(a)"),
    "mm_logspace": (lambda e: mx.logspace(e.spark, 0, 2, 101), "SELECT a AS i, 0 AS j, pow(10.0, 2 * CAST(a AS DOUBLE) / 100) AS v FROM range(101) x(a)"),
    "mm_colon": (lambda e: mx.colon(e.spark, 0, 1, 0.05), "SELECT 0 AS i, a AS j, a * 0.05 AS v FROM range(21) x(a)"),
    "mm_magic": (lambda e: mx.magic(e.spark, 16), "SELECT a AS i, b AS j, CAST(CASE WHEN a % 4 = b % 4 OR a % 4 + b % 4 = 3 THEN 256 - (16 * a + b) ELSE 16 * a + b + 1 END AS DOUBLE) AS v FROM range(16) x(a), range(16) y(b)"),
}


def thin(e: Matrix) -> Matrix:
    return e.map(lambda v: F.when(F.abs(v) > 0.1, v).otherwise(0.0)).to_sparse()


#: name: (rows from E, SQL of the same columns).
ROWS = {
    "red_sum": (lambda e: e.sum(), "SELECT sum(v) AS sum FROM e"),
    "red_sum_1": (lambda e: e.sum(1), "SELECT j, sum(v) AS sum FROM e GROUP BY j"),
    "red_sum_2": (lambda e: e.sum(2), "SELECT i, sum(v) AS sum FROM e GROUP BY i"),
    "red_mean": (lambda e: e.mean(), "SELECT avg(v) AS mean FROM e"),
    "red_mean_1": (lambda e: e.mean(1), "SELECT j, avg(v) AS mean FROM e GROUP BY j"),
    "red_prod_2": (lambda e: e.add(1.0).prod(2), "SELECT i, product(1 + v) AS prod FROM e GROUP BY i"),
    "red_std": (lambda e: e.std(), "SELECT stddev_samp(v) AS std FROM e"),
    "red_std_2": (lambda e: e.std(2), "SELECT i, stddev_samp(v) AS std FROM e GROUP BY i"),
    "red_var_1": (lambda e: e.var(1), "SELECT j, var_samp(v) AS var FROM e GROUP BY j"),
    "red_max": (lambda e: e.max(), "SELECT v AS value, i * 64 + j + 1 AS index FROM e ORDER BY v DESC, i, j LIMIT 1"),
    "red_max_1": (lambda e: e.max(1), "SELECT j, v AS value, i + 1 AS index FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY v DESC, i) AS n FROM e) WHERE n = 1"),
    "red_min_2": (lambda e: e.min(2), "SELECT i, v AS value, j + 1 AS index FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY v, j) AS n FROM e) WHERE n = 1"),
    "red_nnz": (lambda e: thin(e).nnz(), "SELECT count(*) AS nnz FROM e WHERE abs(v) > 0.1"),
    "red_trace": (lambda e: e.T.matmul(e).trace(), "SELECT sum(v * v) AS trace FROM e"),
    "red_norm": (lambda e: e.norm(), "SELECT sqrt(sum(v * v)) AS norm FROM e"),
    "red_dot": (lambda e: e.dot(e.flipud()), "SELECT sum(a.v * b.v) AS dot FROM e a, s, e b WHERE b.i = s.r - 1 - a.i AND b.j = a.j"),
    "red_hist": (lambda e: e.hist(10), ", m AS (SELECT min(v) AS lo, max(v) AS hi FROM e) SELECT CAST(b AS INTEGER) AS bin, count(v) AS n FROM range(10) t(b) LEFT JOIN (SELECT v, least(9, floor((v - lo) / ((hi - lo) / 10))) AS k FROM e, m) ON k = b GROUP BY b"),
    "ord_sort_1": (lambda e: e.sort(1), "SELECT row_number() OVER (PARTITION BY j ORDER BY v, i) - 1 AS i, j, v, i + 1 AS index FROM e"),
    "ord_sort_2_desc": (lambda e: e.sort(2, False), "SELECT i, row_number() OVER (PARTITION BY i ORDER BY v DESC, j) - 1 AS j, v, j + 1 AS index FROM e"),
    "ord_sort_vector": (lambda e: e.flatten().sort(), "SELECT 0 AS i, row_number() OVER (ORDER BY v, i, j) - 1 AS j, v, i * 64 + j + 1 AS index FROM e"),
    "ord_find": (lambda e: e.gt(0.1).find(), "SELECT i + 1 AS row, j + 1 AS col FROM e WHERE v > 0.1"),
    "ord_find_k": (lambda e: e.gt(0.1).find(25), "SELECT i + 1 AS row, j + 1 AS col FROM e WHERE v > 0.1 ORDER BY 1, 2 LIMIT 25"),
    "ord_unique": (lambda e: e.map(lambda v: F.round(v, 2) + 0.0).unique(), "SELECT DISTINCT round(v, 2) + 0.0 AS v FROM e"),
    "ix_mask": (lambda e: e.where(e.gt(0.1)), "SELECT row_number() OVER (ORDER BY i, j) - 1 AS k, v FROM e WHERE v > 0.1"),
    "la_gram": (lambda e: la.gram(e.spark.read.parquet(e.source), "embedding", DIM), "SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2"),
}


def _cells(fn):
    return lambda spark, sf_dir: cells(fn(embeddings(spark, sf_dir)))


def _rows(fn):
    def query(spark, sf_dir: str) -> DataFrame:
        e = embeddings(spark, sf_dir)
        e.source = f"{sf_dir}/embeddings.parquet"
        out = fn(e)
        return out.select(*((F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))

    return query



def _oracle(sql: str, columns: list[str], doubles: set[str]) -> str:
    """The SQL with doubles rounded like the query's."""
    lead, main = ("", sql)
    if sql.startswith(","):
        at = sql.rindex(") SELECT ") + 1
        lead, main = sql[:at], sql[at:]
    shown = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" if c in doubles else f"CAST({c} AS BIGINT) AS {c}" if c not in ("bin",) else c for c in columns)
    return f"{E}{lead}, out AS ({main}) SELECT {shown} FROM out"


QUERIES = {n: _cells(f) for n, (f, _) in CELLS.items()} | {n: _rows(f) for n, (f, _) in ROWS.items()}
ORACLES = {n: _oracle(sql, ["i", "j", "v"], {"v"}) for n, (_, sql) in CELLS.items()}
#: Columns of the rows, whole numbers first.
SHAPES = {
    "red_sum": "sum", "red_sum_1": "j sum", "red_sum_2": "i sum", "red_mean": "mean", "red_mean_1": "j mean", "red_prod_2": "i prod", "red_std": "std", "red_std_2": "i std", "red_var_1": "j var",
    "red_max": "value index", "red_max_1": "j value index", "red_min_2": "i value index", "red_nnz": "nnz", "red_trace": "trace", "red_norm": "norm", "red_dot": "dot", "red_hist": "bin n",
    "ord_sort_1": "i j v index", "ord_sort_2_desc": "i j v index", "ord_sort_vector": "i j v index", "ord_find": "row col", "ord_find_k": "row col", "ord_unique": "v", "ix_mask": "k v", "la_gram": "i j v",
}
ORACLES |= {n: _oracle(sql, SHAPES[n].split(), {"sum", "mean", "prod", "std", "var", "value", "trace", "norm", "dot", "v"}) for n, (_, sql) in ROWS.items()}


def flagship(spark, sf_dir: str) -> DataFrame:
    """net = price .* (1 - discount) .* (1 + tax), then sum, mean, std and max by return flag: one scan, one exchange."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", net.alias("net"))
    r = lambda c, n: F.round(c, 2).alias(n)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), r(F.sum("net"), "sum_net"), r(F.avg("net"), "mean_net"), r(F.stddev_samp("net"), "std_net"), r(F.max("net"), "max_net"))


def rand_stats(spark, sf_dir: str) -> DataFrame:
    """Shares of random matrices in their ranges: rows only, as draws differ between engines."""
    u, n, k = mx.rand(spark, 200, 50, 7), mx.randn(spark, 200, 50, 7), mx.randi(spark, 1, 6, 200, 50, 7)
    parts = [("rand", u.df.select(((F.col("v") >= 0) & (F.col("v") < 1)).alias("ok"))), ("randn", n.df.select((F.abs("v") < 8).alias("ok"))), ("randi", k.df.select(F.col("v").isin(*map(float, range(1, 7))).alias("ok")))]
    perm = mx.randperm(spark, 1000).agg((F.count_distinct("v") == 1000).alias("ok"))
    out = None
    for name, df in [*parts, ("randperm", perm)]:
        one = df.agg(F.bool_and("ok").alias("ok"), F.count("*").alias("n")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES |= {"flagship_net_by_flag": flagship, "mm_random": rand_stats}
ORACLES |= {
    "flagship_net_by_flag": "WITH t AS (SELECT l_returnflag, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS net FROM lineitem) SELECT l_returnflag, count(*) AS n, round(sum(net), 2) AS sum_net, round(avg(net), 2) AS mean_net, round(stddev_samp(net), 2) AS std_net, round(max(net), 2) AS max_net FROM t GROUP BY 1",
    "mm_random": "SELECT * FROM (VALUES ('rand', true, 10000), ('randn', true, 10000), ('randi', true, 10000), ('randperm', true, 1)) t(name, ok, n)",
}
