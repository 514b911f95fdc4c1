"""Arrays of any number of dimensions as rows (k, v): k is the row-major place from 0. Geometry is re-keying of k."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def sub2ind(dims: Sequence[int], subs: Sequence[Column]) -> Column:
    """Place from 0 of subscripts from 0, row-major."""
    out = F.lit(0).cast("long")
    for n, s in zip(dims, subs, strict=True):
        out = out * n + s
    return out


def ind2sub(dims: Sequence[int], k: Column) -> list[Column]:
    """Subscripts from 0 of a place from 0."""
    after = [math.prod(dims[d + 1 :]) for d in range(len(dims))]
    return [F.floor(k / F.lit(step)).cast("long") % n for n, step in zip(dims, after, strict=True)]


class NDArray:
    def __init__(self, df: DataFrame, dims: Sequence[int]):
        self.df, self.dims = df, tuple(dims)

    @classmethod
    def of(cls, spark: SparkSession, dims: Sequence[int], value: Column) -> NDArray:
        return cls(spark.range(math.prod(dims)).select(F.col("id").alias("k"), value.cast("double").alias("v")), dims)

    @classmethod
    def zeros(cls, spark: SparkSession, *dims: int) -> NDArray:
        return cls.of(spark, dims, F.lit(0.0))

    @classmethod
    def ones(cls, spark: SparkSession, *dims: int) -> NDArray:
        return cls.of(spark, dims, F.lit(1.0))

    @classmethod
    def rand(cls, spark: SparkSession, *dims: int, seed: int = 0) -> NDArray:
        return cls.of(spark, dims, F.rand(seed))

    @classmethod
    def from_matrix(cls, m, *dims: int) -> NDArray:
        """The cells of a dense matrix, row by row, as an array of these dimensions."""
        if math.prod(dims) != m.rows * m.cols:
            raise ValueError("the number of elements must stay")
        return cls(m.full().df.select((F.col("i") * m.cols + F.col("j")).alias("k"), "v"), dims)

    def numel(self) -> int:
        return math.prod(self.dims)

    def ndims(self) -> int:
        return len(self.dims)

    def reshape(self, *dims: int) -> NDArray:
        if math.prod(dims) != self.numel():
            raise ValueError("the number of elements must stay")
        return NDArray(self.df, dims)

    def squeeze(self) -> NDArray:
        """Without dimensions of size 1; one is left at least."""
        return NDArray(self.df, [n for n in self.dims if n != 1] or [1])

    def permute(self, *order: int) -> NDArray:
        """Dimensions in a new order, numbered from 1."""
        if sorted(order) != list(range(1, len(self.dims) + 1)):
            raise ValueError("permute needs every dimension once")
        subs, dims = ind2sub(self.dims, F.col("k")), [self.dims[d - 1] for d in order]
        return NDArray(self.df.select(sub2ind(dims, [subs[d - 1] for d in order]).alias("k"), "v"), dims)

    def at(self, *subs: int) -> DataFrame:
        """The element at subscripts from 1."""
        place = 0
        for n, s in zip(self.dims, subs, strict=True):
            if not 1 <= s <= n:
                raise IndexError("a subscript is out of range")
            place = place * n + s - 1
        return self.df.filter(F.col("k") == place).select("v")

    def slice(self, dim: int, index: int) -> NDArray:
        """The part at one index of a dimension, both from 1, without that dimension."""
        if not 1 <= index <= self.dims[dim - 1]:
            raise IndexError("a subscript is out of range")
        subs = ind2sub(self.dims, F.col("k"))
        dims = [n for d, n in enumerate(self.dims) if d != dim - 1]
        rest = [s for d, s in enumerate(subs) if d != dim - 1]
        return NDArray(self.df.filter(subs[dim - 1] == index - 1).select(sub2ind(dims, rest).alias("k"), "v"), dims or [1])
