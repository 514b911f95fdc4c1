"""Linear algebra.

Small matrices are packed values, struct<rows, cols, data> row by row, one per row of a DataFrame: decompositions run on each in
Arrow batches, all groups in parallel. Tall matrices stay distributed: QR by a tree of block factors, SVD, PCA and least squares
from it, products by blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = "struct<rows:int,cols:int,data:array<double>>"


def packed(rows, cols, data: Column) -> Column:
    return F.struct(F.lit(rows).cast("int").alias("rows"), F.lit(cols).cast("int").alias("cols"), data.cast("array<double>").alias("data"))


def pack_groups(df: DataFrame, key: list[str], i: str, j: str, v: str, rows: int, cols: int, name: str = "m") -> DataFrame:
    """A packed matrix per group from cells with indices from 0; missing cells are 0. Groups are bounded by rows x cols."""
    cells = df.groupBy(*key, F.col(i).alias("_i"), F.col(j).alias("_j")).agg(F.sum(v).alias("_v"))
    maps = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct((F.col("_i") * cols + F.col("_j")).cast("int"), "_v"))).alias("_c"))
    data = F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda k: F.coalesce(F.try_element_at(F.col("_c"), k), F.lit(0.0)))
    return maps.select(*key, packed(rows, cols, data).alias(name))


# Kernels on numpy arrays.


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L, U, P with P A = L U by partial pivoting."""
    n = len(a)
    u, perm = a.astype(float).copy(), np.arange(n)
    low = np.eye(n)
    for k in range(n):
        p = k + int(np.argmax(np.abs(u[k:, k])))
        if abs(u[p, k]) < 1e-15:
            raise np.linalg.LinAlgError("the matrix is singular")
        if p != k:
            u[[k, p]], perm[[k, p]] = u[[p, k]], perm[[p, k]]
            low[[k, p], :k] = low[[p, k], :k]
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return low, np.triu(u), np.eye(n)[perm]


def svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin U, S, V with A = U S V', values falling; each column of U has its largest entry positive."""
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    turn = np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    turn[turn == 0] = 1
    return u * turn, np.diag(s), (vt * turn[:, None]).T


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thin Q, R with a non-negative diagonal of R."""
    if a.shape[0] < a.shape[1]:
        raise np.linalg.LinAlgError("qr needs at least as many rows as columns")
    q, r = np.linalg.qr(a)
    turn = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * turn, r * turn[:, None]


def eig(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """V, D of a symmetric matrix, values rising; each vector has its largest entry positive."""
    if not np.allclose(a, a.T, atol=1e-10):
        raise np.linalg.LinAlgError("eig needs a symmetric matrix")
    w, v = np.linalg.eigh(a)
    turn = np.sign(v[np.abs(v).argmax(0), np.arange(len(w))])
    turn[turn == 0] = 1
    return v * turn, np.diag(w)


def chol(a: np.ndarray) -> np.ndarray:
    """Upper R with R' R = A."""
    if not np.allclose(a, a.T, atol=1e-10):
        raise np.linalg.LinAlgError("chol needs a symmetric matrix")
    return np.linalg.cholesky(a).T


def cond(a: np.ndarray) -> float:
    s = np.linalg.svd(a, compute_uv=False)
    return float("inf") if s[-1] == 0 else float(s[0] / s[-1])


def rank(a: np.ndarray) -> float:
    s = np.linalg.svd(a, compute_uv=False)
    return float((s > max(a.shape) * np.finfo(float).eps * s[0]).sum()) if s[0] else 0.0


def inverse(a: np.ndarray) -> np.ndarray:
    if cond(a) > 1e15:
        raise np.linalg.LinAlgError("the matrix is singular to working precision")
    return np.linalg.inv(a)


def solve_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares through the pseudo-inverse with the cut-off 1e-15."""
    return np.linalg.lstsq(a, b, rcond=1e-15)[0]


def solve_qr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    q, r = qr(a)
    return np.linalg.solve(r, q.T @ b)


def scaled(a: np.ndarray) -> np.ndarray:
    """Divided by the largest size of an entry."""
    m = np.abs(a).max(initial=0)
    return a / m if m > 0 else a


def balanced(a: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Rows and columns brought to like sums of sizes by powers of two."""
    a = a.astype(float).copy()
    for _ in range(rounds):
        done = True
        for k in range(len(a)):
            c, r = np.abs(np.delete(a[:, k], k)).sum(), np.abs(np.delete(a[k], k)).sum()
            if c > 0 and r > 0:
                f = 2.0 ** np.round(np.log2(np.sqrt(r / c)))
                if f != 1 and (c * f) ** 2 + (r / f) ** 2 < 0.95 * (c * c + r * r):
                    a[:, k] *= f
                    a[k] /= f
                    done = False
        if done:
            break
    return a


# Columns.


def _array(row) -> np.ndarray | None:
    return None if row is None else np.asarray(row["data"], float).reshape(row["rows"], row["cols"])


def _struct(a: np.ndarray) -> dict:
    a = np.atleast_2d(a)
    return {"rows": a.shape[0], "cols": a.shape[1], "data": a.reshape(-1)}


def apply_packed(df: DataFrame, fn: Callable, columns: list[str], out: dict[str, str]) -> DataFrame:
    """df with the results of fn(arrays of `columns`): `out` maps names to PACKED or double. A singular matrix gives nulls."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*df.schema.fields])
    for name, kind in out.items():
        schema = schema.add(name, _parse_datatype_string(kind))
    struct = pa.struct([("rows", pa.int32()), ("cols", pa.int32()), ("data", pa.list_(pa.float64()))])
    kinds = [struct if k == PACKED else pa.float64() for k in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            results: list[list] = [[] for _ in out]
            for args in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                try:
                    got = None if None in args else fn(*map(_array, args))
                except np.linalg.LinAlgError:
                    got = None
                got = got if isinstance(got, tuple) else (got,) * (len(out) if got is None else 1)
                for r, g in zip(results, got, strict=True):
                    r.append(None if g is None else _struct(g) if isinstance(g, np.ndarray) else float(g))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(r, k) for r, k in zip(results, kinds, strict=True))], [*b.schema.names, *out])

    return df.mapInArrow(run, schema)


with_lu = lambda df, m: apply_packed(df, lu, [m], {"l": PACKED, "u": PACKED, "p": PACKED})
with_qr = lambda df, m: apply_packed(df, qr, [m], {"q": PACKED, "r": PACKED})
with_svd = lambda df, m: apply_packed(df, svd, [m], {"u": PACKED, "s": PACKED, "v": PACKED})
with_eig = lambda df, m: apply_packed(df, eig, [m], {"v": PACKED, "d": PACKED})
with_chol = lambda df, m: apply_packed(df, chol, [m], {"r": PACKED})
with_inv = lambda df, m: apply_packed(df, inverse, [m], {"inv": PACKED})
with_det = lambda df, m: apply_packed(df, lambda a: float(np.linalg.det(a)), [m], {"det": "double"})
with_cond = lambda df, m: apply_packed(df, cond, [m], {"cond": "double"})
with_rank = lambda df, m: apply_packed(df, rank, [m], {"rank": "double"})
with_solve = lambda df, a, b: apply_packed(df, np.linalg.solve, [a, b], {"x": PACKED})
with_least = lambda df, a, b: apply_packed(df, solve_least, [a, b], {"x": PACKED})
with_solve_qr = lambda df, a, b: apply_packed(df, solve_qr, [a, b], {"x": PACKED})
with_scaled = lambda df, m: apply_packed(df, scaled, [m], {"scaled": PACKED})
with_balanced = lambda df, m: apply_packed(df, balanced, [m], {"balanced": PACKED})


def well_conditioned(df: DataFrame, m: str, limit: float = 1e12) -> DataFrame:
    return with_cond(df, m).withColumn("well_conditioned", F.col("cond") < limit)


def det2(a, b, c, d) -> Column:
    """Determinant of [a b; c d] as an expression."""
    return a * d - b * c


def det3(m: list[Column]) -> Column:
    a, b, c, d, e, f, g, h, i = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


# Tall matrices: rows of an array column.


def gram(df: DataFrame, vector: str, cols: int) -> DataFrame:
    """Cells (i, j, v) of A'A for rows in an array column: one pass, one partial sum per task, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cols, cols))
        for b in batches:
            x = np.asarray(b.column(0).flatten(), float).reshape(-1, cols)
            total += x.T @ x
        i, j = np.divmod(np.arange(cols * cols), cols)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], ["i", "j", "v"])

    parts = df.select(F.col(vector).cast("array<double>")).mapInArrow(run, "i long, j long, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def tall_r(df: DataFrame, vector: str, cols: int, fanout: int = 16) -> DataFrame:
    """R of a tall matrix as one packed row: R factors of task blocks (cols x cols each) are combined in a tree of `fanout`."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, cols))
        for b in batches:
            x = np.asarray(b.column(0).flatten(), float).reshape(-1, cols)
            for a in range(0, len(x), 8192):
                r = np.linalg.qr(np.vstack([r, x[a : a + 8192]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.reshape(-1)], pa.list_(pa.float64()))], ["x"])

    out = df.select(F.col(vector).cast("array<double>").alias("x")).mapInArrow(factor, "x array<double>")
    n = max(1, df.rdd.getNumPartitions())
    while n > 1:
        n = -(-n // fanout)
        out = out.repartition(n).mapInArrow(factor, "x array<double>")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in factor(batches):
            r = np.asarray(b.column(0).flatten()).reshape(-1, cols)
            r = np.vstack([r, np.zeros((cols - len(r), cols))]) * np.append(np.where(np.diag(r) < 0, -1.0, 1.0), np.ones(cols - len(r)))[:, None]
            yield pa.RecordBatch.from_arrays([pa.array([_struct(r)], pa.struct([("rows", pa.int32()), ("cols", pa.int32()), ("data", pa.list_(pa.float64()))]))], ["r"])

    return out.coalesce(1).mapInArrow(last, f"r {PACKED}")


def tall_singular_values(df: DataFrame, vector: str, cols: int) -> DataFrame:
    """(k, s) of a tall matrix, falling, from its R."""

    def values(a: np.ndarray) -> np.ndarray:
        return np.linalg.svd(a, compute_uv=False)

    return apply_packed(tall_r(df, vector, cols), values, ["r"], {"s": PACKED}).select(F.posexplode("s.data").alias("k", "s"))


def tall_least_squares(df: DataFrame, vector: str, target: str, cols: int) -> DataFrame:
    """x of least |A x - b| as one packed row, from R of [A b]."""

    def back(r: np.ndarray) -> np.ndarray:
        return solve_least(r[:cols, :cols], r[:cols, cols:])

    both = df.select(F.concat(F.col(vector).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("_ab"))
    return apply_packed(tall_r(both, "_ab", cols + 1), back, ["r"], {"x": PACKED}).select("x")


def block_multiply(a, b, block: int = 512):
    """Product of two dense matrices by blocks: cells are gathered to blocks, blocks joined on the inner block and multiplied by
    numpy, products added up by place. Moves each cell once per opposite block instead of once per opposite row."""
    from .matrix import Matrix, ShapeError

    if a.cols != b.rows:
        raise ShapeError("inner dimensions must agree")
    rows, cols = a.rows, b.cols

    def blocks(m, row: str, col: str) -> DataFrame:
        at = m.df.select(F.floor(F.col("i") / block).alias(row), F.floor(F.col("j") / block).alias(col), F.struct((F.col("i") % block * block + F.col("j") % block).cast("int").alias("at"), "v").alias("c"))
        return at.groupBy(row, col).agg(F.collect_list("c.at").alias(f"at_{row}"), F.collect_list("c.v").alias(f"v_{row}"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                one = {n: batch.column(n)[x] for n in batch.schema.names}
                p, q = np.zeros(block * block), np.zeros(block * block)
                p[np.asarray(one["at_bi"].values)] = np.asarray(one["v_bi"].values)
                q[np.asarray(one["at_bk2"].values)] = np.asarray(one["v_bk2"].values)
                got = (p.reshape(block, block) @ q.reshape(block, block)).reshape(-1)
                bi, bj = one["bi"].as_py(), one["bj"].as_py()
                i, j = np.divmod(np.arange(block * block), block)
                i, j = i + bi * block, j + bj * block
                ok = (i < rows) & (j < cols)
                yield pa.RecordBatch.from_arrays([pa.array(i[ok]), pa.array(j[ok]), pa.array(got[ok])], ["i", "j", "v"])

    left, right = blocks(a, "bi", "bk"), blocks(b, "bk2", "bj")
    pairs = left.join(right, F.col("bk") == F.col("bk2"))
    out = pairs.select("bi", "bj", "at_bi", "v_bi", "at_bk2", "v_bk2").mapInArrow(multiply, "i long, j long, v double")
    return Matrix(out.groupBy("i", "j").agg(F.sum("v").alias("v")), rows, cols)


# Compensated sums: each task adds up exactly, in two parts, and the parts of all tasks are added.


def _exact(rows: DataFrame, name: str, add: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = 0.0, 0.0
        for b in batches:
            values = add(*(c.drop_null().to_numpy(zero_copy_only=False) for c in b.columns))
            new = math.fsum([high, low, *values])
            low = math.fsum([high, low, -new, *values])
            high = new
        yield pa.RecordBatch.from_arrays([pa.array([high]), pa.array([low])], ["high", "low"])

    return rows.mapInArrow(run, "high double, low double").agg(F.coalesce(F.sum("high") + F.sum("low"), F.lit(0.0)).alias(name))


def kahan_sum(df: DataFrame, value: Column) -> DataFrame:
    """(sum): a sum without the rounding errors of adding one by one; nulls are left out, an empty table gives 0."""
    return _exact(df.select(value.cast("double").alias("x")), "sum", lambda x: x.tolist())


def compensated_dot(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """(dot): the sum of products of two columns, their rounding errors included; rows with a null are left out."""

    def products(x: np.ndarray, y: np.ndarray) -> list[float]:
        # Each product as its rounded value and what rounding lost (Dekker's splitting).
        p = x * y
        split = 134217729.0
        xh = split * x - (split * x - x)
        yh = split * y - (split * y - y)
        xl, yl = x - xh, y - yh
        return [*p.tolist(), *(((xh * yh - p) + xh * yl + xl * yh) + xl * yl).tolist()]

    rows = df.select(a.cast("double").alias("a"), b.cast("double").alias("b")).filter("a is not null and b is not null")
    return _exact(rows, "dot", products)
