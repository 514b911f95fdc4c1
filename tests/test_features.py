"""Arrays of many dimensions, compensated sums, block assignment and line order against numpy and plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import linalg as la
from gridloom.operators.matrix import Matrix, ShapeError
from gridloom.operators.ndarray import NDArray, ind2sub, sub2ind
from gridloom.sources import delimited


def numpy_of(a: NDArray) -> np.ndarray:
    out = np.full(a.numel(), np.nan)
    for r in a.df.collect():
        out[r["k"]] = r["v"]
    return out.reshape(a.dims)


def test_arrays(spark):
    a = NDArray.of(spark, (3, 1, 4, 5), F.col("id") * 2)
    want = np.arange(60.0).reshape(3, 1, 4, 5) * 2
    assert np.array_equal(numpy_of(a.permute(4, 2, 1, 3)), want.transpose(3, 1, 0, 2))
    assert np.array_equal(numpy_of(a.squeeze().slice(2, 3)), want.squeeze()[:, 2])
    assert np.array_equal(numpy_of(a.reshape(6, 10)), want.reshape(6, 10))
    assert a.at(3, 1, 2, 5).first()["v"] == want[2, 0, 1, 4] and (a.ndims(), a.numel()) == (4, 60)
    assert NDArray.zeros(spark, 1, 1).squeeze().dims == (1,)
    u = numpy_of(NDArray.rand(spark, 5, 6, seed=3))
    assert ((u >= 0) & (u < 1)).all()
    for bad in (lambda: a.permute(1, 2, 3), lambda: a.reshape(7)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        a.at(4, 1, 1, 1)
    back = spark.range(60).select("id", sub2ind((3, 4, 5), ind2sub((3, 4, 5), F.col("id"))).alias("k"))
    assert back.filter("id <> k").count() == 0


def test_compensated_sums(spark):
    values = [1e16, 1.0, -1e16, 1e-3] * 500 + [None]
    df = spark.createDataFrame([(v, 3.0) for v in values], "x double, y double").repartition(3)
    assert la.kahan_sum(df, F.col("x")).first()["sum"] == pytest.approx(500.5, abs=1e-6)
    pairs = [(1e8 + 1, 1e8 - 1), (-1e8, 1e8), (0.1, 0.2)]
    df = spark.createDataFrame(pairs, "x double, y double").repartition(1)
    assert la.compensated_dot(df, F.col("x"), F.col("y")).first()["dot"] == pytest.approx(-1 + 0.02, abs=1e-9)
    assert la.kahan_sum(df.limit(0), F.col("x")).first()["sum"] == 0
    assert math.fsum([1.0]) == 1.0


def test_blocks_are_put_in_place(spark):
    a = np.arange(20.0).reshape(4, 5)
    m = Matrix.from_rows(spark, a.tolist())
    want = a.copy()
    want[1:3, 2:4] = [[-1, -2], [-3, -4]]
    assert np.array_equal(m.set_block(2, 3, Matrix.from_rows(spark, [[-1, -2], [-3, -4]])).to_numpy(), want)
    assert np.array_equal(m.set_row(4, m.row(1)).to_numpy()[3], a[0])
    assert np.array_equal(m.set_col(5, m.col(1)).to_numpy()[:, 4], a[:, 0])
    with pytest.raises(ShapeError):
        m.set_row(1, m.col(1))
    with pytest.raises(ShapeError):
        m.set_block(4, 5, m)


def test_lines_of_a_folder_are_in_order_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1\n2\n")
    (tmp_path / "b.csv").write_text("".join(f"{k}\n" for k in range(3, 60)))
    got = delimited.csvread(spark, str(tmp_path)).to_numpy().reshape(-1)
    assert got.tolist() == [float(k) for k in range(1, 60)]
