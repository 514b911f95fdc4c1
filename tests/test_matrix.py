import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import math as fm
from gridloom.operators import linalg as la
from gridloom.operators import matrix as mx
from gridloom.operators.matrix import Matrix, ShapeError


def of(spark, a):
    return Matrix.from_rows(spark, np.asarray(a, float).tolist())


def test_arithmetic(spark):
    a, b = of(spark, [[1, 2], [3, 4]]), of(spark, [[5, 6], [7, 8]])
    assert a.add(b).to_numpy().tolist() == [[6, 8], [10, 12]]
    assert b.subtract(a).to_numpy().tolist() == [[4, 4], [4, 4]]
    assert a.matmul(b).to_numpy().tolist() == [[19, 22], [43, 50]]
    assert of(spark, [[5, 8], [10, 15]]).modulo(3).to_numpy().tolist() == [[2, 2], [1, 0]]
    assert a.matmul(b, saturate=True).to_numpy().tolist() == [[19, 22], [43, 50]]


def test_shapes_are_checked_when_planned(spark):
    a, b = of(spark, [[1, 2]]), of(spark, [[1], [2]])
    for act in (lambda: a.add(b), lambda: a.matmul(a), lambda: a.horzcat(b), lambda: a.vertcat(b), lambda: a.reshape(2, 2), lambda: a.trace()):
        with pytest.raises(ShapeError):
            act()
    with pytest.raises(IndexError):
        a.at(1, 3)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 8, 10])
def test_magic(spark, n):
    m = mx.magic(spark, n).to_numpy()
    assert sorted(m.ravel()) == list(range(1, n * n + 1))
    assert len({*m.sum(0), *m.sum(1), np.trace(m), np.trace(m[::-1])}) == 1


def test_reductions(spark):
    m = of(spark, [[1, 2, 3], [4, 5, 6]])
    assert [m.sum().first()[0], m.mean().first()[0], m.max().first()[0], m.min().first()[0], m.prod().first()[0]] == [21, 3.5, 6, 1, 720]
    assert of(spark, [[3, 4], [0, 0]]).norm().first()[0] == 5
    assert of(spark, [[7, 7, 1]]).max().first()["index"] == 1  # the first of ties


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10**6))
def test_properties(spark, r, c, seed):
    a = np.random.default_rng(seed).integers(-5, 6, (r, c)).astype(float)
    m = of(spark, a)
    assert (m.T.T.to_numpy() == a).all()
    assert m.horzcat(m).size() == (r, 2 * c)
    assert m.cumsum().to_numpy()[-1, -1] == pytest.approx(m.sum().first()[0])
    assert sorted(x["v"] for x in m.sort().collect()) == sorted(a.ravel())
    assert (m.to_sparse().add(m).to_numpy() == 2 * a).all()


def test_scan_in_chunks(spark):
    from gridloom.plans.lineage import prefix_scan

    df = spark.range(1000).select(F.col("id").alias("p"), (F.col("id") % 7).cast("double").alias("v"))
    got = [r["s"] for r in prefix_scan(df, "p", "v", "s", chunk=64).orderBy("p").collect()]
    assert got == np.cumsum(np.arange(1000) % 7).tolist()


def test_nan_and_logs(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (-1.0,), (2.0,)], "x double")
    got = [tuple(r) for r in df.select(fm.log("x" and F.col("x")), fm.eq(F.col("x"), F.col("x")), fm.sign(F.col("x")), fm.csch(F.col("x"))).collect()]
    assert str(got[0][0]) == "nan" and got[0][1] == 0.0 and got[0][2] == 0.0
    assert got[1][0] == float("-inf") and got[1][3] == float("inf")
    assert str(got[2][0]) == "nan" and got[3][0] == pytest.approx(np.log(2))


@pytest.mark.parametrize("a", [[[2, 1, 1], [4, 3, 3], [8, 7, 9]], [[4, 12, -16], [12, 37, -43], [-16, -43, 98]], [[2, -1, 0], [-1, 2, -1], [0, -1, 2]]])
def test_decompositions(a):
    a = np.array(a, float)
    low, up, p = la.lu(a)
    assert np.allclose(p @ a, low @ up)
    q, r = la.qr(a)
    assert np.allclose(q @ r, a) and np.allclose(q.T @ q, np.eye(3))
    u, s, v = la.svd(a)
    assert np.allclose(u @ s @ v.T, a)
    if np.allclose(a, a.T):
        assert np.allclose(la.chol(a).T @ la.chol(a), a)
        w, d = la.eig(a)
        assert np.allclose(a @ w, w @ d)
    assert la.cond(np.eye(3)) == 1 and la.rank(np.ones((3, 3))) == 1


def test_singular_groups_give_null(spark):
    df = spark.createDataFrame([(1, (2, 2, [0.0, 1.0, 1.0, 0.0])), (2, (2, 2, [1.0, 1.0, 1.0, 1.0])), (3, None)], f"k int, m {la.PACKED}")
    got = {r["k"]: r["inv"] for r in la.with_inv(df, "m").collect()}
    assert got[1]["data"] == [0, 1, 1, 0] and got[2] is None and got[3] is None


def test_block_product(spark):
    a, b = np.random.default_rng(1).random((37, 50)), np.random.default_rng(2).random((50, 21))
    assert np.allclose(la.block_multiply(of(spark, a), of(spark, b), 16).to_numpy(), a @ b)
