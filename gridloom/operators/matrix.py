"""Lazy matrices as DataFrames of (i long, j long, v double) with known dimensions.

Indices count from 0 inside and from 1 in indexing methods; linear order is row by row. Dense matrices hold every cell; sparse ones
hold what is not zero. Nothing runs before an action; shape errors are raised when the plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import math as fm
from ..plans.lineage import global_rank, prefix_scan

#: Cells up to which the right side of a product is sent to all tasks (24 bytes each).
BROADCAST_CELLS = 100_000


class ShapeError(ValueError):
    pass


def _grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    k = spark.range(rows * cols)
    return k.select(F.expr(f"id div {max(cols, 1)}").alias("i"), F.expr(f"id % {max(cols, 1)}").alias("j"))


class Matrix:
    def __init__(self, df: DataFrame, rows: int, cols: int, sparse: bool = False):
        self.df, self.rows, self.cols, self.sparse = df, rows, cols, sparse
        self.spark = df.sparkSession

    # Making matrices.

    @classmethod
    def of(cls, spark: SparkSession, rows: int, cols: int, value: Column, sparse: bool = False) -> Matrix:
        """A cell is `value` of the columns i and j."""
        if rows < 0 or cols < 0:
            raise ShapeError("dimensions must not be negative")
        return cls(_grid(spark, rows, cols).select("i", "j", value.cast("double").alias("v")), rows, cols, sparse)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: list[list[float]]) -> Matrix:
        """A literal."""
        if len({len(r) for r in rows}) > 1:
            raise ShapeError("rows must have the same length")
        cells = [(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)]
        return cls(spark.createDataFrame(cells, "i long, j long, v double"), len(rows), len(rows[0]) if rows else 0)

    @classmethod
    def from_wide(cls, df: DataFrame, key: str, columns: list[str], rows: int | None = None) -> Matrix:
        """Rows numbered 0, 1, ... by `key` (a dense position) and columns in the order given."""
        cells = df.select(F.col(key).cast("long").alias("i"), F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("j", "v"))
        return cls(cells.select("i", F.col("j").cast("long").alias("j"), "v"), df.count() if rows is None else rows, len(columns))

    @classmethod
    def from_arrays(cls, df: DataFrame, key: str, values: str, cols: int, rows: int) -> Matrix:
        cells = df.select(F.col(key).cast("long").alias("i"), F.posexplode(values).alias("j", "v"))
        return cls(cells.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")), rows, cols)

    def _like(self, df: DataFrame, rows: int | None = None, cols: int | None = None, sparse: bool | None = None) -> Matrix:
        return Matrix(df.select("i", "j", "v"), self.rows if rows is None else rows, self.cols if cols is None else cols, self.sparse if sparse is None else sparse)

    def _same(self, other: Matrix) -> None:
        if (self.rows, self.cols) != (other.rows, other.cols):
            raise ShapeError(f"matrix dimensions must agree: {self.rows}x{self.cols} and {other.rows}x{other.cols}")

    def _square(self) -> None:
        if self.rows != self.cols:
            raise ShapeError("the matrix must be square")

    # Elementwise.

    def map(self, fn: Callable[[Column], Column]) -> Matrix:
        """A function of every cell; of a sparse matrix, of every stored one."""
        return self._like(self.df.withColumn("v", fn(F.col("v")).cast("double")))

    def _sum_of(self, other: Matrix, sign: float, saturate: bool) -> Matrix:
        """One exchange: cells of both sides are added up by place."""
        self._same(other)
        both = self.df.unionByName(other.df.withColumn("v", F.col("v") * sign))
        out = both.groupBy("i", "j").agg(F.sum("v").alias("v"))
        sparse = self.sparse and other.sparse
        if sparse:
            out = out.filter("v <> 0")
        return self._like(out.withColumn("v", fm.saturate(F.col("v"))) if saturate else out, sparse=sparse)

    def add(self, other, saturate: bool = False) -> Matrix:
        return self._sum_of(other, 1.0, saturate) if isinstance(other, Matrix) else self.full().map(lambda v: v + float(other))

    def subtract(self, other, saturate: bool = False) -> Matrix:
        return self._sum_of(other, -1.0, saturate) if isinstance(other, Matrix) else self.full().map(lambda v: v - float(other))

    def pairwise(self, other, fn: Callable[[Column, Column], Column], keep_sparse: bool = False) -> Matrix:
        """A function of the cells at the same place, or of every cell and a number."""
        if not isinstance(other, Matrix):
            return (self if keep_sparse else self.full()).map(lambda v: fn(v, F.lit(float(other))))
        self._same(other)
        if keep_sparse and (self.sparse or other.sparse):
            a, b, sparse = self.df, other.df, True
        else:
            a, b, sparse = self.full().df, other.full().df, False
        joined = a.join(b.withColumnRenamed("v", "w"), ["i", "j"])
        return self._like(joined.select("i", "j", fn(F.col("v"), F.col("w")).cast("double").alias("v")), sparse=sparse)

    times = lambda self, o: self.pairwise(o, lambda a, b: a * b, True)
    divide = lambda self, o: self.pairwise(o, lambda a, b: a / b)
    power = lambda self, o: self.pairwise(o, F.pow)
    modulo = lambda self, o: self.pairwise(o, fm.rem)
    eq = lambda self, o: self.pairwise(o, fm.eq)
    ne = lambda self, o: self.pairwise(o, fm.ne)
    lt = lambda self, o: self.pairwise(o, fm.lt)
    gt = lambda self, o: self.pairwise(o, fm.gt)
    le = lambda self, o: self.pairwise(o, fm.le)
    ge = lambda self, o: self.pairwise(o, fm.ge)
    and_ = lambda self, o: self.pairwise(o, fm.and_)
    or_ = lambda self, o: self.pairwise(o, fm.or_)
    not_ = lambda self: self.full().map(fm.not_)
    negative = lambda self: self.map(lambda v: -v)
    scale = lambda self, s: self.map(lambda v: v * float(s))
    over = lambda self, s: self.map(lambda v: v / float(s))

    # Products.

    def matmul(self, other: Matrix, saturate: bool = False) -> Matrix:
        """Join on the inner index, then sums by place; a right side under BROADCAST_CELLS cells (its dimensions tell) is sent."""
        if self.cols != other.rows:
            raise ShapeError(f"inner dimensions must agree: {self.cols} and {other.rows}")
        b = other.df.select(F.col("i").alias("k"), F.col("j").alias("n"), F.col("v").alias("w"))
        b = F.broadcast(b) if other.rows * other.cols <= BROADCAST_CELLS else b
        joined = self.df.select("i", F.col("j").alias("k"), "v").join(b, "k")
        out = joined.groupBy("i", F.col("n").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
        sparse = self.sparse or other.sparse
        got = Matrix(out.filter("v <> 0") if sparse else out, self.rows, other.cols, sparse)
        return got.map(fm.saturate) if saturate else got

    def mpower(self, p: int) -> Matrix:
        """Matrix power by repeated squaring, p >= 0."""
        self._square()
        out, base = None, self
        while p:
            if p & 1:
                out = base if out is None else out.matmul(base)
            base, p = base.matmul(base) if p > 1 else base, p >> 1
        return out or eye(self.spark, self.rows)

    def kron(self, other: Matrix) -> Matrix:
        """Every cell of one times every cell of the other; the result has as many cells, so the cross join is the output."""
        b = other.df.select(F.col("i").alias("ib"), F.col("j").alias("jb"), F.col("v").alias("w"))
        out = self.df.crossJoin(b).select((F.col("i") * other.rows + F.col("ib")).alias("i"), (F.col("j") * other.cols + F.col("jb")).alias("j"), (F.col("v") * F.col("w")).alias("v"))
        return Matrix(out, self.rows * other.rows, self.cols * other.cols, self.sparse or other.sparse)

    # Shape.

    def transpose(self) -> Matrix:
        return Matrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), self.cols, self.rows, self.sparse)

    T = property(transpose)

    def _moved(self, i: Column, j: Column, rows: int | None = None, cols: int | None = None) -> Matrix:
        return self._like(self.df.select(i.cast("long").alias("i"), j.cast("long").alias("j"), "v"), rows, cols)

    def horzcat(self, other: Matrix) -> Matrix:
        if self.rows != other.rows:
            raise ShapeError("horzcat needs equal row counts")
        return Matrix(self.df.unionByName(other._moved(F.col("i"), F.col("j") + self.cols).df), self.rows, self.cols + other.cols, self.sparse and other.sparse)

    def vertcat(self, other: Matrix) -> Matrix:
        if self.cols != other.cols:
            raise ShapeError("vertcat needs equal column counts")
        return Matrix(self.df.unionByName(other._moved(F.col("i") + self.rows, F.col("j")).df), self.rows + other.rows, self.cols, self.sparse and other.sparse)

    def blkdiag(self, other: Matrix) -> Matrix:
        out = self.df.unionByName(other._moved(F.col("i") + self.rows, F.col("j") + self.cols).df)
        return Matrix(out, self.rows + other.rows, self.cols + other.cols, True).full()

    def repmat(self, m: int, n: int) -> Matrix:
        copies = _grid(self.spark, m, n).select(F.col("i").alias("a"), F.col("j").alias("b"))
        out = self.df.crossJoin(F.broadcast(copies) if m * n <= BROADCAST_CELLS else copies)
        return self._like(out.select((F.col("a") * self.rows + F.col("i")).alias("i"), (F.col("b") * self.cols + F.col("j")).alias("j"), "v"), self.rows * m, self.cols * n)

    def linear(self) -> Column:
        return F.col("i") * self.cols + F.col("j")

    def reshape(self, rows: int, cols: int) -> Matrix:
        if rows * cols != self.rows * self.cols:
            raise ShapeError("reshape must keep the number of elements")
        at = self.linear()
        return self._moved(F.floor(at / cols), at % cols, rows, cols)

    flatten = lambda self: self.reshape(1, self.rows * self.cols)
    column = lambda self: self.reshape(self.rows * self.cols, 1)
    flipud = lambda self: self._moved(self.rows - 1 - F.col("i"), F.col("j"))
    fliplr = lambda self: self._moved(F.col("i"), self.cols - 1 - F.col("j"))

    def rot90(self, k: int = 1) -> Matrix:
        """Counter-clockwise."""
        k %= 4
        i, j = F.col("i"), F.col("j")
        if k == 1:
            return self._moved(self.cols - 1 - j, i, self.cols, self.rows)
        if k == 2:
            return self._moved(self.rows - 1 - i, self.cols - 1 - j)
        return self._moved(j, self.rows - 1 - i, self.cols, self.rows) if k == 3 else self

    def diag(self, k: int = 0) -> Matrix:
        """A vector's square matrix with it on diagonal k, or a matrix's diagonal k as a row."""
        if 1 in (self.rows, self.cols):
            n = self.rows * self.cols
            at = self.linear()
            return Matrix(self._moved(at + max(-k, 0), at + max(k, 0)).df, n + abs(k), n + abs(k), True).full()
        n = max(0, min(self.rows + min(k, 0), self.cols - max(k, 0)))
        on = self.df.filter(F.col("j") - F.col("i") == k)
        return self._like(on.select(F.lit(0).cast("long").alias("i"), F.least("i", "j").alias("j"), "v"), 1, n)

    def tril(self, k: int = 0) -> Matrix:
        return self._part(F.col("j") <= F.col("i") + k)

    def triu(self, k: int = 0) -> Matrix:
        return self._part(F.col("j") >= F.col("i") + k)

    def _part(self, keep: Column) -> Matrix:
        return self._like(self.df.filter(keep)) if self.sparse else self._like(self.df.withColumn("v", F.when(keep, F.col("v")).otherwise(0.0)))

    def full(self) -> Matrix:
        """Every cell, zeros included."""
        if not self.sparse:
            return self
        out = _grid(self.spark, self.rows, self.cols).join(self.df, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
        return Matrix(out, self.rows, self.cols)

    def to_sparse(self) -> Matrix:
        return Matrix(self.df.filter("v <> 0"), self.rows, self.cols, True)

    # Indexing, from 1.

    def at(self, i: int, j: int | None = None) -> Column | Matrix:
        """A(k) or A(i, j) as a 1 x 1 matrix."""
        if j is None:
            i, j = (i - 1) // self.cols + 1, (i - 1) % self.cols + 1
        if not (1 <= i <= self.rows and 1 <= j <= self.cols):
            raise IndexError("index out of bounds")
        return self.sub(range(i, i + 1), range(j, j + 1))

    def sub(self, rows: range | None = None, cols: range | None = None) -> Matrix:
        """A(rows, cols): ranges of indices, None for all. A step of a range is a filter and a shift, no join."""
        df, shape = self.df, []
        for name, r, size in (("i", rows, self.rows), ("j", cols, self.cols)):
            if r is None:
                shape.append(size)
                continue
            if len(r) and not (1 <= min(r) and max(r) <= size):
                raise IndexError("index out of bounds")
            shape.append(len(r))
            if not len(r):
                df = df.filter(F.lit(False))
                continue
            at = F.col(name) - (r.start - 1)
            df = df.filter((F.col(name) >= min(r) - 1) & (F.col(name) <= max(r) - 1) & (at % r.step == 0)).withColumn(name, (at / r.step).cast("long"))
        return self._like(df, *shape)

    row = lambda self, i: self.sub(range(i, i + 1))
    col = lambda self, j: self.sub(None, range(j, j + 1))

    def linear_range(self, r: range) -> Matrix:
        """A(a:s:b) as a column; places outside are 0."""
        at = self.spark.range(len(r)).select("id", (F.col("id") * r.step + (r.start - 1)).alias("at"))
        cells = self.df.select(self.linear().alias("at"), "v")
        out = at.join(cells, "at", "left").select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), F.coalesce("v", F.lit(0.0)).alias("v"))
        return Matrix(out, len(r), 1)

    def where(self, mask: Matrix) -> DataFrame:
        """A(mask) as rows (k, v) in linear order, k from 0; its length is known only when it runs."""
        self._same(mask)
        m = mask.df.filter(fm.truth(F.col("v"))).select("i", "j")
        return global_rank(self.df.join(m, ["i", "j"]), [F.col("i"), F.col("j")], "k").select("k", "v")

    def assign(self, value: float, where: Column) -> Matrix:
        """Cells for which `where` (of i, j, v) holds become value."""
        return self._like(self.full().df.withColumn("v", F.when(where, F.lit(float(value))).otherwise(F.col("v"))), sparse=False)

    def set(self, i: int, j: int, value: float) -> Matrix:
        if not (1 <= i <= self.rows and 1 <= j <= self.cols):
            raise IndexError("index out of bounds")
        return self.assign(value, (F.col("i") == i - 1) & (F.col("j") == j - 1))

    def set_block(self, row: int, col: int, block: Matrix) -> Matrix:
        """A dense matrix with a block put where its first cell goes to (row, col), from 1."""
        if self.sparse or not (1 <= row <= self.rows - block.rows + 1 and 1 <= col <= self.cols - block.cols + 1):
            raise ShapeError("the block does not fit")
        i, j = F.col("i"), F.col("j")
        under = (i >= row - 1) & (i < row - 1 + block.rows) & (j >= col - 1) & (j < col - 1 + block.cols)
        new = block.full().df.select((i + (row - 1)).alias("i"), (j + (col - 1)).alias("j"), "v")
        return Matrix(self.df.filter(~under).select("i", "j", "v").unionByName(new), self.rows, self.cols)

    def set_row(self, k: int, row: Matrix) -> Matrix:
        if row.size() != (1, self.cols):
            raise ShapeError("a row needs a value for each column")
        return self.set_block(k, 1, row)

    def set_col(self, k: int, col: Matrix) -> Matrix:
        if col.size() != (self.rows, 1):
            raise ShapeError("a column needs a value for each row")
        return self.set_block(1, k, col)

    def assign_mask(self, mask: Matrix, value: float) -> Matrix:
        return self.pairwise(mask, lambda v, m: F.when(fm.truth(m), F.lit(float(value))).otherwise(v))

    # Reductions. dim None: all cells; 1: down the columns (rows (j, value)); 2: along the rows (rows (i, value)).

    def _reduce(self, dim: int | None, *aggregates: Column) -> DataFrame:
        if dim not in (None, 1, 2):
            raise ShapeError("dim must be 1 or 2")
        df = self.full().df
        return df.agg(*aggregates) if dim is None else df.groupBy("j" if dim == 1 else "i").agg(*aggregates)

    def sum(self, dim=None) -> DataFrame:
        return self._reduce(dim, F.sum("v").alias("sum"))

    def mean(self, dim=None) -> DataFrame:
        return self._reduce(dim, F.coalesce(F.avg("v"), F.lit(fm.NAN)).alias("mean"))

    def prod(self, dim=None) -> DataFrame:
        return self._reduce(dim, F.coalesce(F.product("v"), F.lit(1.0)).alias("prod"))

    def _extreme(self, dim, largest: bool) -> DataFrame:
        at = self.linear() if dim is None else F.col("i") if dim == 1 else F.col("j")
        s = F.max(F.struct("v", (-at).alias("at"))) if largest else F.min(F.struct("v", at.alias("at")))
        s = s.alias("s")
        out = self._reduce(dim, s)
        keys = [c for c in out.columns if c != "s"]
        return out.select(*keys, F.col("s.v").alias("value"), (F.abs("s.at") + 1).alias("index"))

    def max(self, dim=None) -> DataFrame:
        """value and 1-based index of the first largest."""
        return self._extreme(dim, True)

    def min(self, dim=None) -> DataFrame:
        return self._extreme(dim, False)

    def std(self, dim=None) -> DataFrame:
        return self._reduce(dim, F.coalesce(F.stddev_samp("v"), F.lit(fm.NAN)).alias("std"))

    def var(self, dim=None) -> DataFrame:
        return self._reduce(dim, F.coalesce(F.var_samp("v"), F.lit(fm.NAN)).alias("var"))

    def nnz(self) -> DataFrame:
        return self.df.agg(F.count_if(F.col("v") != 0).alias("nnz"))

    def trace(self) -> DataFrame:
        self._square()
        return self.df.filter("i = j").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("trace"))

    def norm(self) -> DataFrame:
        return self.df.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("norm"))

    def dot(self, other: Matrix) -> DataFrame:
        return self.times(other).df.agg(F.sum("v").alias("dot"))

    def hist(self, bins: int = 10, inclusive: bool = True) -> DataFrame:
        """(bin from 0, n): equal bins from the smallest to the largest; `inclusive` puts the largest into the last bin."""
        ends = self.df.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        x = self.df.crossJoin(F.broadcast(ends))  # one row
        width = (F.col("hi") - F.col("lo")) / bins
        at = F.when(width == 0, 0).otherwise(F.floor((F.col("v") - F.col("lo")) / F.when(width == 0, 1.0).otherwise(width)).cast("int"))
        at = F.least(at, F.lit(bins - 1)) if inclusive else at
        counts = x.select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
        every = self.spark.range(bins).select(F.col("id").cast("int").alias("bin"))
        return every.join(F.broadcast(counts) if bins <= 10_000 else counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    size = lambda self: (self.rows, self.cols)
    numel = lambda self: self.rows * self.cols
    length = lambda self: self.numel() if 1 in (self.rows, self.cols) else max(self.rows, self.cols)
    isempty = lambda self: self.numel() == 0

    # Order.

    def _scan(self, dim, product: bool) -> Matrix:
        if dim is None:
            df = prefix_scan(self.full().df.withColumn("_at", self.linear()), "_at", "v", "_out", product=product)
        else:
            df = prefix_scan(self.full().df, "i" if dim == 1 else "j", "v", "_out", ["j" if dim == 1 else "i"], product)
        return self._like(df.select("i", "j", F.col("_out").alias("v")), sparse=False)

    cumsum = lambda self, dim=None: self._scan(dim, False)
    cumprod = lambda self, dim=None: self._scan(dim, True)

    def diff(self, n: int = 1) -> Matrix:
        """n-th forward difference of a vector: a self equi-join of neighbours, so no single task sees it all."""
        if 1 not in (self.rows, self.cols):
            raise ShapeError("diff needs a vector")
        at, size = "j" if self.rows == 1 else "i", self.numel()
        df = self.full().df
        for _ in range(min(n, size)):
            before = df.select(F.col(at).alias("_b"), F.col("v").alias("_w"))
            df = df.withColumn("_b", F.col(at) - 1).join(before, "_b").select((F.col(at) - 1).alias(at), "i" if at == "j" else "j", (F.col("v") - F.col("_w")).alias("v"))
        left = max(size - n, 0)
        return self._like(df, *((1, left) if self.rows == 1 else (left, 1)), sparse=False)

    def sort(self, dim: int = 1, ascending: bool = True) -> DataFrame:
        """Rows (i, j, v, index): sorted down columns or along rows with 1-based places of origin; a vector as a whole."""
        df = self.full().df
        v = F.col("v") if ascending else F.desc("v")
        if 1 in (self.rows, self.cols):
            ranked = global_rank(df.withColumn("_at", self.linear()), [v, F.col("_at")], "k")
            return ranked.select(F.lit(0).cast("long").alias("i"), F.col("k").alias("j"), "v", (F.col("_at") + 1).alias("index"))
        own, across = ("j", "i") if dim == 1 else ("i", "j")
        nth = F.row_number().over(Window.partitionBy(own).orderBy(v, across)).cast("long") - 1
        out = df.withColumn("_k", nth)
        return out.select(F.col("_k").alias("i") if dim == 1 else F.col("i"), F.col("j") if dim == 1 else F.col("_k").alias("j"), "v", (F.col(across) + 1).alias("index"))

    def find(self, k: int | None = None) -> DataFrame:
        """1-based (row, col) of the first k cells that are not zero, row by row."""
        found = self.df.filter("v <> 0").select((F.col("i") + 1).alias("row"), (F.col("j") + 1).alias("col"))
        return found if k is None else found.orderBy("row", "col").limit(k)

    def unique(self) -> DataFrame:
        return self.full().df.select("v").distinct().orderBy("v")

    # Leaving.

    def to_packed(self) -> DataFrame:
        """One row of rows, cols and data (row by row); for matrices that fit a task."""
        cells = F.array_sort(F.collect_list(F.struct("i", "j", "v")))
        return self.full().df.agg(cells.alias("c")).select(F.lit(self.rows).alias("rows"), F.lit(self.cols).alias("cols"), F.transform("c", lambda x: x["v"]).alias("data"))

    def to_wide(self) -> DataFrame:
        """Rows _i, c1 .. cn."""
        out = self.full().df.groupBy(F.col("i").alias("_i")).pivot("j", list(range(self.cols))).agg(F.first("v"))
        return out.select("_i", *(F.col(str(j)).alias(f"c{j + 1}") for j in range(self.cols)))

    def to_numpy(self):
        """On the driver, for matrices of known small dimensions."""
        import numpy as np

        out = np.zeros((self.rows, self.cols))
        t = self.df.toArrow()
        out[np.asarray(t["i"]), np.asarray(t["j"])] = np.asarray(t["v"])
        return out


# Constructors.


def zeros(spark, r: int, c: int) -> Matrix:
    return Matrix.of(spark, r, c, F.lit(0.0))


def ones(spark, r: int, c: int) -> Matrix:
    return Matrix.of(spark, r, c, F.lit(1.0))


def eye(spark, n: int, m: int | None = None, sparse: bool = False) -> Matrix:
    m = n if m is None else m
    on = Matrix(spark.range(min(n, m)).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")), n, m, True)
    return on if sparse else Matrix.of(spark, n, m, F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))


speye = lambda spark, n, m=None: eye(spark, n, m, True)
rand = lambda spark, r, c, seed=0: Matrix.of(spark, r, c, F.rand(seed))
randn = lambda spark, r, c, seed=0: Matrix.of(spark, r, c, F.randn(seed))
randi = lambda spark, lo, hi, r, c, seed=0: Matrix.of(spark, r, c, F.floor(F.rand(seed) * (hi - lo + 1)) + lo)


def randperm(spark, n: int, k: int | None = None, seed: int = 0) -> DataFrame:
    """k of 1..n in random order, rows (k, v)."""
    order = spark.range(1, n + 1).withColumn("r", F.rand(seed))
    k = n if k is None else min(k, n)
    ranked = order.orderBy("r", "id").limit(k) if k < n else order
    return global_rank(ranked, [F.col("r"), F.col("id")], "k").select("k", F.col("id").cast("double").alias("v"))


def linspace(spark, a: float, b: float, n: int = 100) -> Matrix:
    """An n x 1 column; at least two points."""
    n = max(n, 2)
    return Matrix.of(spark, n, 1, F.lit(float(a)) + F.lit(float(b) - float(a)) * F.col("i") / F.lit(float(n - 1)))


def logspace(spark, a: float, b: float, n: int = 50) -> Matrix:
    return linspace(spark, a, b, n).map(lambda v: F.pow(F.lit(10.0), v))


def colon(spark, a: float, b: float, step: float = 1.0) -> Matrix:
    """a:step:b as a row, from whole multiples of the step; the end is met within a billionth of a step."""
    import math

    if step == 0:
        raise ValueError("the step must not be zero")
    n = max(0, math.floor((b - a) / step + 1e-9) + 1)
    return Matrix.of(spark, 1, n, F.lit(float(a)) + F.col("j") * F.lit(float(step)))


def magic(spark, n: int) -> Matrix:
    """Odd orders by the diagonal rule, multiples of 4 by complements, others by four odd squares with exchanged parts."""
    if n < 1:
        raise ShapeError("magic needs n >= 1")
    if n == 2:
        return eye(spark, 2)
    i, j = F.col("i"), F.col("j")

    def odd(m: int, r: Column, c: Column) -> Column:
        return m * F.pmod(r + c + 1 + m // 2, F.lit(m)) + F.pmod(r + 2 * c + 1, F.lit(m)) + 1

    if n % 2:
        value = odd(n, i, j)
    elif n % 4 == 0:
        k = i * n + j + 1
        cross = (i % 4 == j % 4) | ((i % 4) + (j % 4) == 3)
        value = F.when(cross, n * n + 1 - k).otherwise(k)
    else:
        m, k = n // 2, (n - 2) // 4
        r, c = i % m, j % m
        left = F.when(r == m // 2, (j >= 1) & (j <= k)).otherwise(j < k)
        swap = ((j < m) & left) | (j >= n - k + 1)
        down = (i >= m) != swap
        quarter = F.when(~down & (j < m), 0).when(down & (j >= m), 1).when(~down & (j >= m), 2).otherwise(3)
        value = odd(m, r, c) + quarter * (m * m)
    return Matrix.of(spark, n, n, value)


hilb = lambda spark, n: Matrix.of(spark, n, n, 1.0 / (F.col("i") + F.col("j") + 1))


def pascal(spark, n: int) -> Matrix:
    return Matrix.of(spark, n, n, fm.nchoosek(F.col("i") + F.col("j"), F.least("i", "j")))


def vander(v: Matrix) -> Matrix:
    n = v.numel()
    powers = v.spark.range(n).select(F.col("id").alias("p"))
    x = v.df.select(v.linear().alias("i"), "v").crossJoin(F.broadcast(powers) if n <= BROADCAST_CELLS else powers)
    return Matrix(x.select("i", F.col("p").alias("j"), F.pow("v", F.lit(n - 1) - F.col("p")).alias("v")), n, n)


def meshgrid(x: Matrix, y: Matrix | None = None) -> Matrix:
    """X and Y side by side: ny x 2nx. (mesh_pair gives the two.)"""
    a, b = mesh_pair(x, y)
    return a.horzcat(b)


def mesh_pair(x: Matrix, y: Matrix | None = None) -> tuple[Matrix, Matrix]:
    y = y or x
    nx, ny = x.numel(), y.numel()
    flat, tall = x.reshape(1, nx), y.reshape(ny, 1)
    return flat.repmat(ny, 1), tall.repmat(1, nx)


def sparse(spark, cells: DataFrame, rows: int | None = None, cols: int | None = None) -> Matrix:
    """From 1-based (i, j, v) rows; duplicates add up, zeros go. Dimensions default to the largest indices (one small job)."""
    if rows is None or cols is None:
        most = cells.agg(F.max("i").alias("r"), F.max("j").alias("c")).first()
        rows, cols = rows or most["r"] or 0, cols or most["c"] or 0
    out = cells.groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v")).filter("v <> 0")
    return Matrix(out.select((F.col("i") - 1).cast("long").alias("i"), (F.col("j") - 1).cast("long").alias("j"), "v"), rows, cols, True)


def spdiags(b: Matrix, d: list[int], m: int, n: int) -> Matrix:
    """Column k of b on diagonal d[k]: entry (i, i + d) is b(i, k)."""
    if b.cols != len(d):
        raise ShapeError("spdiags needs a diagonal for each column")
    on = F.element_at(F.array(*(F.lit(x) for x in d)), (F.col("j") + 1).cast("int"))
    out = b.df.withColumn("j", (F.col("i") + on).cast("long")).filter((F.col("j") >= 0) & (F.col("j") < n) & (F.col("i") < m) & (F.col("v") != 0))
    return Matrix(out, m, n, True)


def concat(parts: Iterable[Matrix], down: bool = False) -> Matrix:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.vertcat(p) if down else out.horzcat(p)
    return out
