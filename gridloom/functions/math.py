"""Elementwise mathematics: Column -> Column, with IEEE results where Spark has null or an error.

Real functions give NaN outside their domain; comparisons with NaN are false; results that count are doubles.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
#: Fixed values of the saturating arithmetic.
SATURATION, TINY = 1e300, 1e-15


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _d(x) -> Column:
    return _c(x).cast("double")


def _sign(c: Column) -> Column:
    return F.when(F.isnan(c), 0.0).when(c > 0, 1.0).when(c < 0, -1.0).otherwise(0.0)


def inverse(c) -> Column:
    """1/c; at zero the infinity of c's sign bit."""
    c = _d(c)
    return F.when(c == 0, F.when(F.atan2(c, F.lit(-1.0)) < 0, -INF).otherwise(INF)).otherwise(1.0 / F.when(c == 0, F.lit(None)).otherwise(c))


def _guarded(fn):
    """A logarithm that is -inf at its pole and NaN below."""

    def log_(x, pole: float = 0.0) -> Column:
        c = _d(x)
        return F.when(c.isNull(), F.lit(None)).when(F.isnan(c), NAN).when(c > pole, fn(c)).when(c == pole, -INF).otherwise(NAN)

    return log_


sin = lambda x: F.sin(_d(x))
cos = lambda x: F.cos(_d(x))
tan = lambda x: F.tan(_d(x))
asin = lambda x: F.asin(_d(x))
acos = lambda x: F.acos(_d(x))
atan = lambda x: F.atan(_d(x))
sinh = lambda x: F.sinh(_d(x))
cosh = lambda x: F.cosh(_d(x))
tanh = lambda x: F.tanh(_d(x))
asinh = lambda x: F.asinh(_d(x))
acosh = lambda x: F.acosh(_d(x))
atanh = lambda x: F.atanh(_d(x))
sech = lambda x: 1.0 / F.cosh(_d(x))
csch = lambda x: inverse(F.sinh(_d(x)))
coth = lambda x: inverse(F.tanh(_d(x)))
sec = lambda x: F.sec(_d(x))
csc = lambda x: inverse(F.sin(_d(x)))
cot = lambda x: inverse(F.tan(_d(x)))
asec = lambda x: F.acos(inverse(x))
acsc = lambda x: F.asin(inverse(x))
acot = lambda x: math.pi / 2 - F.atan(_d(x))
atan2 = lambda y, x: F.atan2(_d(y), _d(x))
hypot = lambda x, y: F.hypot(_d(x), _d(y))
exp = lambda x: F.exp(_d(x))
expm1 = lambda x: F.expm1(_d(x))
log = _guarded(F.ln)
log10 = _guarded(F.log10)
log2 = _guarded(F.log2)
sqrt = lambda x: F.sqrt(_d(x))
abs_ = lambda x: F.abs(_d(x))
sign = lambda x: _sign(_d(x))
round_ = lambda x: F.round(_d(x))


def log1p(x) -> Column:
    return _guarded(F.log1p)(x, -1.0)


def _whole(fn):
    """A rounding to whole numbers that keeps NaN, infinities and numbers beyond longs."""

    def rounding(x) -> Column:
        c = _d(x)
        return F.when(F.isnan(c) | (F.abs(c) >= 2.0**53), c).otherwise(fn(c).cast("double"))

    return rounding


floor = _whole(F.floor)
ceil = _whole(F.ceil)
fix = _whole(lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)))


def nextpow2(n) -> Column:
    """The smallest p with 2^p >= n; 0 for n <= 1."""
    c = F.ceil(_d(n)).cast("long")
    return F.when(c <= 1, 0.0).otherwise(F.length(F.bin(c - 1)).cast("double"))


def mod(x, y) -> Column:
    """Floored remainder: the sign is the divisor's. A zero divisor raises."""
    x, y = _d(x), _d(y)
    return x - y * F.floor(x / y)


def rem(x, y) -> Column:
    """Truncated remainder: the sign is the dividend's. A zero divisor raises."""
    return _d(x) % _d(y)


def gcd(a, b) -> Column:
    """Greatest common divisor of whole numbers: 92 Euclid steps are enough for longs."""
    start = F.struct(F.abs(_c(a).cast("long")).alias("a"), F.abs(_c(b).cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(91)), start, step, lambda s: s["a"].cast("double"))


def lcm(a, b) -> Column:
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return F.when((a == 0) | (b == 0), 0.0).otherwise(F.abs(a.cast("double") * b.cast("double")) / gcd(a, b))


def factorial(n) -> Column:
    """n! as a double, 0 <= n <= 170; others raise."""
    n = _c(n).cast("int")
    checked = F.when((n < 0) | (n > 170), F.raise_error(F.lit("factorial needs 0 <= n <= 170")).cast("int")).otherwise(n)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(checked, F.lit(1))), F.lit(1.0), lambda a, i: a * i)


def nchoosek(n, k) -> Column:
    n, k = _c(n).cast("int"), _c(k).cast("int")
    product = F.aggregate(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), F.lit(1.0), lambda a, i: a * (n - i) / (i + 1))
    return F.when(k > n, 0.0).when(k <= 0, 1.0).otherwise(product)


def isprime(n) -> Column:
    n = _c(n).cast("long")
    root = F.floor(F.sqrt(F.greatest(n, F.lit(4)).cast("double")))
    return F.when(n < 2, 0.0).when(n < 4, 1.0).otherwise(F.when(F.exists(F.sequence(F.lit(2).cast("long"), root), lambda i: n % i == 0), 0.0).otherwise(1.0))


def _vectorised(fn):
    def each(v: float | None) -> float | None:
        if v is None or v != v:
            return v
        try:
            return fn(v)
        except OverflowError:
            return INF
        except ValueError:
            return NAN

    def batch(x: pd.Series) -> pd.Series:
        return x.map(each)

    return lambda x: F.pandas_udf(batch, "double")(_d(x))


gamma = _vectorised(math.gamma)
gammaln = _vectorised(math.lgamma)
erf = _vectorised(math.erf)
erfc = _vectorised(math.erfc)


# Complex numbers: struct<re, im>.


def complex_(re, im=0.0) -> Column:
    return F.struct(_d(re).alias("re"), _d(im).alias("im"))


real = lambda z: z["re"]
imag = lambda z: z["im"]
angle = lambda z: F.atan2(z["im"], z["re"])
conj = lambda z: complex_(z["re"], -z["im"])
complex_abs = lambda z: F.hypot(z["re"], z["im"])
complex_negative = lambda z: complex_(-z["re"], -z["im"])
complex_add = lambda a, b: complex_(a["re"] + b["re"], a["im"] + b["im"])
complex_subtract = lambda a, b: complex_(a["re"] - b["re"], a["im"] - b["im"])
complex_multiply = lambda a, b: complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_divide(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    top = complex_multiply(a, conj(b))
    return complex_(top["re"] / size, top["im"] / size)


def complex_exp(z: Column) -> Column:
    size = F.exp(z["re"])
    return complex_(size * F.cos(z["im"]), size * F.sin(z["im"]))


def complex_log(z: Column) -> Column:
    return complex_(log(complex_abs(z)), angle(z))


def complex_power(a: Column, b: Column) -> Column:
    return complex_exp(complex_multiply(b, complex_log(a)))


def complex_sqrt(z: Column) -> Column:
    size, half = F.sqrt(complex_abs(z)), angle(z) / 2
    return complex_(size * F.cos(half), size * F.sin(half))


def complex_sin(z: Column) -> Column:
    return complex_(F.sin(z["re"]) * F.cosh(z["im"]), F.cos(z["re"]) * F.sinh(z["im"]))


def complex_cos(z: Column) -> Column:
    return complex_(F.cos(z["re"]) * F.cosh(z["im"]), -F.sin(z["re"]) * F.sinh(z["im"]))


# Saturating arithmetic and tolerance predicates.


def saturate(x) -> Column:
    """Finite values held within +-1e300; infinities and NaN as they are."""
    c = _d(x)
    return F.when(F.isnan(c) | (F.abs(c) == INF), c).otherwise(F.greatest(F.least(c, F.lit(SATURATION)), F.lit(-SATURATION)))


def _clip(c: Column) -> Column:
    return F.when(F.isnan(c), NAN).otherwise(F.greatest(F.least(c, F.lit(SATURATION)), F.lit(-SATURATION)))


safe_add = lambda a, b: _clip(_d(a) + _d(b))
safe_subtract = lambda a, b: _clip(_d(a) - _d(b))
safe_multiply = lambda a, b: _clip(_d(a) * _d(b))
safe_exp = lambda x: _clip(F.exp(_d(x)))
safe_pow = lambda x, p: _clip(F.pow(_d(x), _d(p)))


def safe_divide(a, b) -> Column:
    """A divisor under 1e-15 gives the signed limit, or NaN for 0/0."""
    a, b = _d(a), _d(b)
    near = F.abs(b) < TINY
    limit = F.when(F.abs(a) < TINY, NAN).when((a > 0) == (b >= 0), SATURATION).otherwise(-SATURATION)
    return F.when(near, limit).otherwise(_clip(a / F.when(near, 1.0).otherwise(b)))


def safe_sqrt(x) -> Column:
    c = _d(x)
    return F.when(c < 0, 0.0).otherwise(F.sqrt(c))


def safe_log(x) -> Column:
    c = _d(x)
    return F.when(c <= 0, -SATURATION).otherwise(F.ln(F.when(c > 0, c)))


near_zero = lambda x, tol=TINY: F.abs(_d(x)) < tol
near_equal = lambda a, b, tol=TINY: F.abs(_d(a) - _d(b)) < tol
is_finite = lambda x: ~F.isnan(_d(x)) & (F.abs(_d(x)) != INF)
is_valid = lambda x: _c(x).isNotNull() & is_finite(x)


# Comparisons with IEEE NaN, as 0/1 doubles, and logical operators.


def _compare(test):
    def comparison(a, b) -> Column:
        a, b = _d(a), _d(b)
        return F.when(F.isnan(a) | F.isnan(b), False).otherwise(test(a, b)).cast("double")

    return comparison


eq = _compare(lambda a, b: a == b)
lt = _compare(lambda a, b: a < b)
gt = _compare(lambda a, b: a > b)
le = _compare(lambda a, b: a <= b)
ge = _compare(lambda a, b: a >= b)
ne = lambda a, b: 1.0 - eq(a, b)
truth = lambda x: F.isnan(_d(x)) | (_d(x) != 0)
and_ = lambda a, b: (truth(a) & truth(b)).cast("double")
or_ = lambda a, b: (truth(a) | truth(b)).cast("double")
not_ = lambda a: (~truth(a)).cast("double")
xor_ = lambda a, b: (truth(a) != truth(b)).cast("double")
logical = truth
