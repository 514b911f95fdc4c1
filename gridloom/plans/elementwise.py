"""Registered queries of the elementwise functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import math as fm


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Input x of a function: (Column of c_acctbal, SQL of it). Account balances run from -1000 to 10000.
X = {
    "wide": (lambda b: b / 1000.0, "c_acctbal / 1000.0"),
    "unit": (lambda b: b / 10000.0, "c_acctbal / 10000.0"),
    "above_one": (lambda b: 1.5 + F.abs(b) / 1000.0, "(1.5 + abs(c_acctbal) / 1000.0)"),
    "positive": (lambda b: 0.25 + F.abs(b) / 1000.0, "(0.25 + abs(c_acctbal) / 1000.0)"),
    "any": (lambda b: F.when(b < 500, F.floor(b / 400)).otherwise(b / 100.0), "CASE WHEN c_acctbal < 500 THEN floor(c_acctbal / 400) ELSE c_acctbal / 100.0 END"),
    "halves": (lambda b: F.floor(b / 10.0) / 2.0, "floor(c_acctbal / 10.0) / 2.0"),
}
#: name: (function, SQL with x, input). Each gives c_custkey, y rounded to 6 digits.
PLAIN = {
    "sin": (fm.sin, "sin(x)", "wide"), "cos": (fm.cos, "cos(x)", "wide"), "tan": (fm.tan, "tan(x)", "unit"),
    "asin": (fm.asin, "asin(x)", "unit"), "acos": (fm.acos, "acos(x)", "unit"), "atan": (fm.atan, "atan(x)", "wide"),
    "sinh": (fm.sinh, "sinh(x)", "unit"), "cosh": (fm.cosh, "cosh(x)", "unit"), "tanh": (fm.tanh, "tanh(x)", "wide"),
    "asinh": (fm.asinh, "asinh(x)", "wide"), "acosh": (fm.acosh, "acosh(x)", "above_one"), "atanh": (fm.atanh, "atanh(x / 2)", "unit"),
    "sech": (fm.sech, "1 / cosh(x)", "unit"), "csch": (fm.csch, "1 / sinh(x)", "positive"), "coth": (fm.coth, "1 / tanh(x)", "positive"),
    "sec": (fm.sec, "1 / cos(x)", "unit"), "csc": (fm.csc, "1 / sin(x)", "above_one"), "cot": (fm.cot, "1 / tan(x)", "above_one"),
    "asec": (fm.asec, "acos(1 / x)", "above_one"), "acsc": (fm.acsc, "asin(1 / x)", "above_one"), "acot": (fm.acot, "pi() / 2 - atan(x)", "wide"),
    "exp": (fm.exp, "exp(x)", "unit"), "expm1": (fm.expm1, "exp(x) - 1", "unit"),
    "log1p": (fm.log1p, "ln(1 + x)", "unit"), "abs": (fm.abs_, "abs(x)", "wide"),
    "floor": (fm.floor, "floor(x)", "wide"), "ceil": (fm.ceil, "ceil(x)", "wide"),
    "round": (fm.round_, "CASE WHEN x < 0 THEN -floor(-x + 0.5) ELSE floor(x + 0.5) END", "halves"),
    "fix": (fm.fix, "trunc(x)", "wide"), "sign": (fm.sign, "CASE WHEN x > 0 THEN 1.0 WHEN x < 0 THEN -1.0 ELSE 0.0 END", "any"),
    "gamma": (fm.gamma, "gamma(x)", "positive"), "gammaln": (fm.gammaln, "lgamma(x)", "positive"),
}
PLAIN["atanh"] = (lambda x: fm.atanh(x / 2), "atanh(x / 2)", "unit")
#: name: functions with values outside the reals; the result is y (null if it is no finite number) and its kind.
GUARDED = {
    "log": (fm.log, "CASE WHEN x > 0 THEN ln(x) END", "any"), "log10": (fm.log10, "CASE WHEN x > 0 THEN log10(x) END", "any"),
    "log2": (fm.log2, "CASE WHEN x > 0 THEN log2(x) END", "any"), "sqrt": (fm.sqrt, "CASE WHEN x >= 0 THEN sqrt(x) END", "any"),
    "inverse": (fm.inverse, "CASE WHEN x <> 0 THEN 1 / x END", "any"),
}
KIND_SQL = {"log": "CASE WHEN x > 0 THEN 'finite' WHEN x = 0 THEN '-inf' ELSE 'nan' END", "sqrt": "CASE WHEN x >= 0 THEN 'finite' ELSE 'nan' END", "inverse": "CASE WHEN x <> 0 THEN 'finite' ELSE 'inf' END"}
KIND_SQL |= {"log10": KIND_SQL["log"], "log2": KIND_SQL["log"]}
#: name: (function of columns, SQL, table, key, inputs): two or more inputs.
PAIRS = {
    "atan2": (fm.atan2, "atan2(x, y)"), "hypot": (fm.hypot, "sqrt(x * x + y * y)"), "mod": (fm.mod, "x - y * floor(x / y)"),
    "rem": (fm.rem, "x - y * trunc(x / y)"), "plus": (lambda x, y: x + y, "x + y"), "minus": (lambda x, y: x - y, "x - y"),
    "times": (lambda x, y: x * y, "x * y"), "divide": (lambda x, y: x / y, "x / y"), "power": (lambda x, y: F.pow(F.abs(x), y / 100), "pow(abs(x), y / 100)"),
    "eq": (lambda x, y: fm.eq(F.floor(x), F.floor(y)), "CASE WHEN floor(x) = floor(y) THEN 1.0 ELSE 0.0 END"),
    "ne": (lambda x, y: fm.ne(F.floor(x), F.floor(y)), "CASE WHEN floor(x) <> floor(y) THEN 1.0 ELSE 0.0 END"),
    "lt": (fm.lt, "CASE WHEN x < y THEN 1.0 ELSE 0.0 END"), "gt": (fm.gt, "CASE WHEN x > y THEN 1.0 ELSE 0.0 END"),
    "le": (fm.le, "CASE WHEN x <= y THEN 1.0 ELSE 0.0 END"), "ge": (fm.ge, "CASE WHEN x >= y THEN 1.0 ELSE 0.0 END"),
    "and": (lambda x, y: fm.and_(F.floor(x), F.floor(y)), "CASE WHEN floor(x) <> 0 AND floor(y) <> 0 THEN 1.0 ELSE 0.0 END"),
    "or": (lambda x, y: fm.or_(F.floor(x), F.floor(y)), "CASE WHEN floor(x) <> 0 OR floor(y) <> 0 THEN 1.0 ELSE 0.0 END"),
    "not": (lambda x, y: fm.not_(F.floor(x)), "CASE WHEN floor(x) = 0 THEN 1.0 ELSE 0.0 END"),
    "xor": (lambda x, y: fm.xor_(F.floor(x), F.floor(y)), "CASE WHEN (floor(x) <> 0) <> (floor(y) <> 0) THEN 1.0 ELSE 0.0 END"),
    "negative": (lambda x, y: -x, "-x"),
    "saturate": (lambda x, y: fm.saturate(x * 1e300) / 1e300, "greatest(least(x, 1.0), -1.0)"),
    "safe_divide": (fm.safe_divide, "x / y"), "safe_sqrt": (lambda x, y: fm.safe_sqrt(x), "CASE WHEN x < 0 THEN 0 ELSE sqrt(greatest(x, 0)) END"),
    "safe_add": (fm.safe_add, "x + y"), "safe_subtract": (fm.safe_subtract, "x - y"), "safe_multiply": (fm.safe_multiply, "x * y"),
    "safe_pow": (lambda x, y: fm.safe_pow(F.abs(x), y / 100), "pow(abs(x), y / 100)"), "safe_exp": (lambda x, y: fm.safe_exp(x / 10), "exp(x / 10)"),
    "safe_log": (lambda x, y: F.greatest(fm.safe_log(x), F.lit(-50.0)), "CASE WHEN x > 0 THEN greatest(ln(x), -50.0) ELSE -50.0 END"),
    "near_equal": (lambda x, y: fm.near_equal(x, y / 10, 1.0).cast("double"), "CASE WHEN abs(x - y / 10) < 1.0 THEN 1.0 ELSE 0.0 END"),
}
NUMBER_THEORY = {
    "gcd": (lambda p, s: fm.gcd(p, s), "CAST(gcd(p_partkey, p_size) AS DOUBLE)"),
    "lcm": (lambda p, s: fm.lcm(p, s), "CAST(lcm(p_partkey, p_size) AS DOUBLE)"),
    "factorial": (lambda p, s: fm.factorial(s % 16), "CAST(factorial(CAST(p_size % 16 AS INTEGER)) AS DOUBLE)"),
    "nchoosek": (lambda p, s: fm.nchoosek(F.lit(12), s % 14), "CASE WHEN p_size % 14 > 12 THEN 0.0 ELSE CAST(factorial(12) / (factorial(CAST(p_size % 14 AS INTEGER)) * factorial(CAST(greatest(12 - p_size % 14, 0) AS INTEGER))) AS DOUBLE) END"),
    "nextpow2": (lambda p, s: fm.nextpow2(p), "CASE WHEN p_partkey <= 1 THEN 0.0 ELSE CAST(length(ltrim(bin(p_partkey - 1), '0')) AS DOUBLE) END"),
    "isprime": (lambda p, s: fm.isprime(p), "CASE WHEN p_partkey < 2 THEN 0.0 WHEN EXISTS (SELECT 1 FROM range(2, 200) r(d) WHERE d * d <= p_partkey AND p_partkey % d = 0) THEN 0.0 ELSE 1.0 END"),
}


def _plain(fn, x: str):
    def query(spark, sf_dir: str) -> DataFrame:
        b = F.col("c_acctbal")
        return table(spark, sf_dir, "customer").select("c_custkey", (F.round(fn(X[x][0](b)), 6) + 0.0).alias("y"))

    return query


def _guarded(fn, x: str):
    def query(spark, sf_dir: str) -> DataFrame:
        y = fn(X[x][0](F.col("c_acctbal")))
        kind = F.when(F.isnan("y"), "nan").when(F.col("y") == fm.INF, "inf").when(F.col("y") == -fm.INF, "-inf").otherwise("finite")
        found = table(spark, sf_dir, "customer").select("c_custkey", y.alias("y"))
        return found.select("c_custkey", F.when(kind == "finite", F.round("y", 6)).alias("y"), kind.alias("kind"))

    return query


def _pair(fn):
    def query(spark, sf_dir: str) -> DataFrame:
        x, y = (F.col("o_totalprice") - 150000) / 10000, F.col("o_custkey") % 97 + 1.5
        return table(spark, sf_dir, "orders").select("o_orderkey", (F.round(fn(x, y), 8) + 0.0).alias("z"))

    return query


def _number(fn):
    def query(spark, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "part").select("p_partkey", fn(F.col("p_partkey"), F.col("p_size")).alias("y"))

    return query


def _erf(fn):
    def query(spark, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "customer").select("c_custkey", F.round(fn(F.col("c_acctbal") / 5000.0), 6).alias("y"))

    return query


def _complex(spark, sf_dir: str) -> DataFrame:
    z = fm.complex_(F.col("c_acctbal") / 1000.0, F.col("c_custkey") % 7 - 3)
    w = fm.complex_(2.0, -1.0)
    s = table(spark, sf_dir, "customer").select("c_custkey", z.alias("z"), fm.complex_multiply(z, w).alias("p"), fm.complex_divide(z, w).alias("q"), fm.conj(z).alias("c"), fm.complex_sin(z).alias("s"))
    r = lambda c: F.round(c, 6) + 0.0
    return s.select(
        "c_custkey", r("z.re").alias("re"), r("z.im").alias("im"), r(fm.complex_abs(F.col("z"))).alias("size"), r(fm.angle(F.col("z"))).alias("angle"),
        r("p.re").alias("p_re"), r("p.im").alias("p_im"), r("q.re").alias("q_re"), r("q.im").alias("q_im"), r("c.im").alias("c_im"), r(F.col("s.re") / F.cosh(F.col("z.im"))).alias("sin_re"),
    )


COMPLEX_SQL = """
WITH t AS (SELECT c_custkey, c_acctbal / 1000.0 AS a, CAST(c_custkey % 7 - 3 AS DOUBLE) AS b FROM customer)
SELECT c_custkey, round(a, 6) AS re, round(b, 6) AS im, round(sqrt(a * a + b * b), 6) AS size, round(atan2(b, a), 6) AS angle,
  round(2 * a + b, 6) AS p_re, round(2 * b - a, 6) AS p_im, round((2 * a - b) / 5, 6) AS q_re, round((2 * b + a) / 5, 6) AS q_im,
  round(-b, 6) + 0.0 AS c_im, round(sin(a), 6) AS sin_re FROM t
"""


def primes(spark, sf_dir: str) -> DataFrame:
    """primes(n) for n the number of parts: numbers without the composites up to it."""
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("n"))
    limit = n.first()["n"]
    return spark.range(2, limit + 1).filter(fm.isprime(F.col("id")) == 1).select(F.col("id").cast("double").alias("p"))


QUERIES, ORACLES = {}, {}
for _n, (_f, _sql, _x) in PLAIN.items():
    QUERIES[f"el_{_n}"] = _plain(_f, _x)
    ORACLES[f"el_{_n}"] = f"WITH t AS (SELECT c_custkey, CAST({X[_x][1]} AS DOUBLE) AS x FROM customer) SELECT c_custkey, round(CAST({_sql} AS DOUBLE), 6) + 0.0 AS y FROM t"
for _n, (_f, _sql, _x) in GUARDED.items():
    QUERIES[f"el_{_n}"] = _guarded(_f, _x)
    ORACLES[f"el_{_n}"] = f"WITH t AS (SELECT c_custkey, CAST({X[_x][1]} AS DOUBLE) AS x FROM customer) SELECT c_custkey, round({_sql}, 6) AS y, {KIND_SQL[_n]} AS kind FROM t"
for _n, (_f, _sql) in PAIRS.items():
    QUERIES[f"op_{_n}"] = _pair(_f)
    ORACLES[f"op_{_n}"] = f"WITH t AS (SELECT o_orderkey, (o_totalprice - 150000) / 10000 AS x, CAST(o_custkey % 97 + 1.5 AS DOUBLE) AS y FROM orders) SELECT o_orderkey, round(CAST({_sql} AS DOUBLE), 8) + 0.0 AS z FROM t"
for _n, (_f, _sql) in NUMBER_THEORY.items():
    QUERIES[f"nt_{_n}"] = _number(_f)
    ORACLES[f"nt_{_n}"] = f"SELECT p_partkey, {_sql} AS y FROM part"
QUERIES |= {"el_erf": _erf(fm.erf), "el_erfc": _erf(fm.erfc), "el_complex": _complex, "nt_primes": primes}
ORACLES |= {"el_complex": COMPLEX_SQL, "nt_primes": "SELECT CAST(n AS DOUBLE) AS p FROM range(2, (SELECT max(p_partkey) + 1 FROM part)) t(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 200) r(d) WHERE d * d <= n AND n % d = 0)"}

#: The series of the error function, summed to where its terms vanish for the values at hand.
ERF_SQL = "list_sum(list_transform(range(0, 60), lambda n: CASE WHEN n % 2 = 0 THEN 1.0 ELSE -1.0 END * pow(c_acctbal / 5000.0, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) * 2 / sqrt(pi())"
ORACLES |= {"el_erf": f"SELECT c_custkey, round({ERF_SQL}, 6) + 0.0 AS y FROM customer", "el_erfc": f"SELECT c_custkey, round(1 - {ERF_SQL}, 6) + 0.0 AS y FROM customer"}
