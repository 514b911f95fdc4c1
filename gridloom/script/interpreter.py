"""Runs script trees. Control flow and small values stay on the driver; matrices of over `threshold` cells, and all that come from
files or DataFrames, are lazy Spark matrices; names bound to Columns make Column expressions."""

from __future__ import annotations

import math
import operator
import re

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import math as fm
from ..functions import strings as fs
from ..functions.plotspec import Figures
from ..operators import linalg as la
from ..operators import matrix as mx
from ..operators.matrix import Matrix
from ..sources import delimited, filesystem
from .syntax import Parser, ScriptError

#: Cells from which on a matrix is made by Spark.
THRESHOLD = 10_000


class Handle:
    def __init__(self, name: str, call):
        self.name, self.call = name, call


class Sparse:
    """A small sparse matrix on the driver: its dense values with the mark."""


class Categorical(list):
    """Texts with categories in order of first appearance."""

    @property
    def categories(self) -> list:
        return list(dict.fromkeys(self))


class DateTime(float):
    """Whole seconds since 1970."""


class Duration(float):
    """Seconds."""


class Many(tuple):
    """Several results; in an expression the first counts."""


class Break(Exception):
    pass


class Continue(Exception):
    pass


class Return(Exception):
    pass


def first(v):
    return v[0] if isinstance(v, Many) else v


def scalar(v):
    """A 1 x 1 array as a number."""
    return float(v.reshape(-1)[0]) if isinstance(v, np.ndarray) and v.size == 1 else v


def array(v) -> np.ndarray:
    return np.atleast_2d(np.asarray(v, complex if isinstance(v, complex) else float))


def text_of(v) -> str:
    """As printed: numbers with six decimals, matrix cells with four."""
    v = first(v)
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, DateTime):
        import datetime

        return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=float(v))).strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, Duration):
        return f"{float(v):g} seconds"
    if isinstance(v, int | float):
        return f"{v:.6f}"
    if isinstance(v, complex):
        return f"{v.real:.6f} {'+' if v.imag >= 0 else '-'} {abs(v.imag):.6f}i"
    if isinstance(v, np.ndarray):
        return "\n".join("  ".join(f"{x:.4f}" for x in row) for row in np.atleast_2d(v))
    if isinstance(v, Matrix):
        return text_of(v.to_numpy()) if v.numel() <= THRESHOLD else f"<{v.rows}x{v.cols} matrix>"
    if isinstance(v, str):
        return v
    if isinstance(v, list):
        return "{" + ", ".join(map(text_of, v)) + "}"
    if isinstance(v, dict):
        return "struct(" + ", ".join(f"{k}: {text_of(x)}" for k, x in v.items()) + ")"
    return v.name if isinstance(v, Handle) else "" if v is None else str(v)


def all_of(index) -> bool:
    """A(:, :)."""
    return len(index) == 2 and index[0] is all and index[1] is all


def truth(v) -> bool:
    v = first(v)
    if isinstance(v, np.ndarray):
        return v.size > 0 and bool((v != 0).all())
    if isinstance(v, Matrix):
        return v.numel() > 0 and bool(v.full().df.agg(F.bool_and(F.col("v") != 0).alias("ok")).first()["ok"])
    return bool(v)


COLUMN = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, ".*": operator.mul, "/": operator.truediv, "./": operator.truediv, "%": fm.rem,
    "^": F.pow, ".^": F.pow, "==": fm.eq, "~=": fm.ne, "<": fm.lt, ">": fm.gt, "<=": fm.le, ">=": fm.ge, "&": fm.and_, "|": fm.or_, "&&": fm.and_, "||": fm.or_,
}
MATRIX = {"+": "add", "-": "subtract", ".*": "times", "./": "divide", ".^": "power", "^": "power", "%": "modulo", "==": "eq", "~=": "ne", "<": "lt", ">": "gt", "<=": "le", ">=": "ge", "&": "and_", "|": "or_", "&&": "and_", "||": "or_"}


def _divide(a, b):
    if (np.asarray(b) == 0).any():
        raise ScriptError("division by zero")
    return a / b


NUMPY = {
    "+": operator.add, "-": operator.sub, ".*": operator.mul, "./": _divide, "%": np.fmod, ".^": np.power, "^": np.power, "==": operator.eq, "~=": operator.ne,
    "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "&": lambda a, b: (a != 0) & (b != 0), "|": lambda a, b: (a != 0) | (b != 0),
    "&&": lambda a, b: float(truth(a) and truth(b)), "||": lambda a, b: float(truth(a) or truth(b)),
}
#: Elementwise functions: (numpy function, Column function).
ELEMENTWISE = {n: (getattr(np, p), getattr(fm, n)) for n, p in {"sin": "sin", "cos": "cos", "tan": "tan", "asin": "arcsin", "acos": "arccos", "atan": "arctan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "asinh": "arcsinh", "acosh": "arccosh", "atanh": "arctanh", "exp": "exp", "expm1": "expm1", "log": "log", "log10": "log10", "log2": "log2", "log1p": "log1p", "sqrt": "sqrt", "floor": "floor", "ceil": "ceil", "fix": "trunc", "sign": "sign"}.items()}
ELEMENTWISE |= {
    "abs": (np.abs, fm.abs_), "round": (lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5), fm.round_), "sech": (lambda x: 1 / np.cosh(x), fm.sech), "csch": (lambda x: 1 / np.sinh(x), fm.csch),
    "coth": (lambda x: 1 / np.tanh(x), fm.coth), "sec": (lambda x: 1 / np.cos(x), fm.sec), "csc": (lambda x: 1 / np.sin(x), fm.csc), "cot": (lambda x: 1 / np.tan(x), fm.cot),
    "asec": (lambda x: np.arccos(1 / x), fm.asec), "acsc": (lambda x: np.arcsin(1 / x), fm.acsc), "acot": (lambda x: np.pi / 2 - np.arctan(x), fm.acot),
    "gamma": (np.vectorize(math.gamma), fm.gamma), "gammaln": (np.vectorize(math.lgamma), fm.gammaln), "erf": (np.vectorize(math.erf), fm.erf), "erfc": (np.vectorize(math.erfc), fm.erfc),
    "isprime": (np.vectorize(lambda n: float(n >= 2 and all(n % d for d in range(2, int(n**0.5) + 1)))), fm.isprime), "nextpow2": (np.vectorize(lambda n: float(0 if n <= 1 else math.ceil(n - 1).bit_length() if n == int(n) else int(n).bit_length())), fm.nextpow2),
    "factorial": (np.vectorize(lambda n: float(math.factorial(int(n)))), fm.factorial), "logical": (lambda x: (x != 0).astype(float), lambda c: fm.truth(c).cast("double")),
}
PAIRWISE = {"atan2": (np.arctan2, fm.atan2), "hypot": (np.hypot, fm.hypot), "mod": (np.mod, fm.mod), "rem": (np.fmod, fm.rem), "gcd": (lambda a, b: np.gcd(np.asarray(a, int), np.asarray(b, int)).astype(float), fm.gcd), "lcm": (lambda a, b: np.lcm(np.asarray(a, int), np.asarray(b, int)).astype(float), fm.lcm), "nchoosek": (np.vectorize(lambda n, k: float(math.comb(int(n), int(k)))), fm.nchoosek), "power": (np.power, F.pow)}
REDUCE = {"sum": np.sum, "mean": np.mean, "prod": np.prod, "std": lambda x, axis=None: np.std(x, axis=axis, ddof=1), "var": lambda x, axis=None: np.var(x, axis=axis, ddof=1)}


class Interpreter:
    def __init__(self, spark: SparkSession | None = None, out=print, threshold: int = THRESHOLD):
        self.spark, self.out, self.threshold = spark, out, threshold
        self.constants = {"pi": math.pi, "eps": float(np.finfo(float).eps), "inf": math.inf, "nan": math.nan, "Inf": math.inf, "NaN": math.nan}
        self.globals: dict = {}
        self.names: dict = {}
        self.shared: set[str] = set()
        self.functions: dict[str, tuple] = {}
        self.figures = Figures()
        self.ends: list[tuple[object, int, int]] = []
        self.rng = np.random.default_rng()
        self.builtins = self._builtins()

    # Running.

    def run(self, source: str) -> None:
        for s in Parser(source).program():
            self.execute(s)

    def run_file(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            self.run(f.read())

    def value(self, source: str):
        """The value of one expression."""
        return first(self.eval(Parser(source).expression()))

    def execute(self, s) -> None:
        getattr(self, f"do_{s[0]}")(*s[1:])

    def block(self, body) -> None:
        for s in body:
            self.execute(s)

    def get(self, name: str):
        scope = self.globals if name in self.shared else self.names
        return scope[name] if name in scope else self.constants.get(name)

    def put(self, name: str, value) -> None:
        (self.globals if name in self.shared else self.names)[name] = value

    def has(self, name: str) -> bool:
        return name in (self.globals if name in self.shared else self.names) or name in self.constants

    def do_show(self, e) -> None:
        v = self.eval(e)
        if v is not None:
            self.out(text_of(v))

    def do_assign(self, target, e) -> None:
        self.store(target, first(self.eval(e)))

    def do_many(self, targets, e) -> None:
        v = self.eval(e, len(targets))
        v = v if isinstance(v, Many) else Many((v,))
        if len(v) < len(targets):
            raise ScriptError("not enough results")
        for t, x in zip(targets, v, strict=False):
            if t:
                self.put(t, x)

    def store(self, target, value) -> None:
        kind = target[0]
        if kind == "name":
            self.put(target[1], value)
        elif kind == "field":
            base = self.held(target[1])
            base = base if isinstance(base, dict) else {}
            base[target[2]] = value
            self.store(target[1], base)
        elif kind == "brace":
            cell = self.get(target[1][1]) if target[1][0] == "name" else None
            cell = list(cell) if isinstance(cell, list) else []
            k = int(self.eval(target[2][-1])) if len(target[2]) == 1 else int(self.eval(target[2][1]))
            cell += [None] * (k - len(cell))
            cell[k - 1] = value
            self.store(target[1], cell)
        else:
            self.store_cell(target, value)

    def held(self, target):
        """What a name or field has now, or nothing."""
        if target[0] == "name":
            return self.get(target[1])
        if target[0] == "field":
            base = self.held(target[1])
            return base.get(target[2]) if isinstance(base, dict) else None
        return self.eval(target)

    def store_cell(self, target, value) -> None:
        base = self.eval(target[1])
        if isinstance(base, dict | list) and not isinstance(base, np.ndarray):
            k = first(self.eval(target[2][0]))
            if isinstance(base, list):
                base = list(base) + [None] * (int(k) - len(base))
                base[int(k) - 1] = value
            else:
                base[text_of(k) if isinstance(k, str) else f"{k:g}"] = value
            return self.store(target[1], base)
        index = self.indices(base, target[2])
        if isinstance(base, Matrix):
            if len(index) == 1 and isinstance(index[0], Matrix | np.ndarray):
                return self.store(target[1], base.assign_mask(self.lift(index[0]), value))
            i, j = index if len(index) == 2 else divmod(int(index[0]) - 1, base.cols)
            return self.store(target[1], base.set(int(i), int(j), value) if len(index) == 2 else base.set(i + 1, j + 1, value))
        new = array(base).copy()
        if len(index) == 1:
            if isinstance(index[0], np.ndarray) and index[0].shape == new.shape:
                new[index[0] != 0] = value
            else:
                at = np.asarray(index[0], int).reshape(-1) - 1
                if at.max(initial=0) >= new.size or at.min(initial=0) < 0:
                    raise ScriptError("index out of bounds")
                new.reshape(-1)[at] = np.asarray(value).reshape(-1)
        else:
            rows, cols = (np.arange(n) if k is all else np.asarray(k, int).reshape(-1) - 1 for k, n in zip(index, new.shape, strict=True))
            if rows.max(initial=0) >= new.shape[0] or cols.max(initial=0) >= new.shape[1] or min(rows.min(initial=0), cols.min(initial=0)) < 0:
                raise ScriptError("index out of bounds")
            new[np.ix_(rows, cols)] = value
        self.store(target[1], new)

    def do_if(self, arms, other) -> None:
        for test, body in arms:
            if truth(self.eval(test)):
                return self.block(body)
        self.block(other)

    def do_while(self, test, body) -> None:
        while truth(self.eval(test)):
            try:
                self.block(body)
            except Continue:
                continue
            except Break:
                break

    def do_for(self, var, over, body) -> None:
        v = first(self.eval(over))
        v = v.to_numpy() if isinstance(v, Matrix) else v
        for x in v if isinstance(v, list) else array(v).reshape(-1).tolist():
            self.put(var, x)
            try:
                self.block(body)
            except Continue:
                continue
            except Break:
                break

    def do_switch(self, value, arms, other) -> None:
        v = scalar(first(self.eval(value)))
        for test, body in arms:
            t = first(self.eval(test))
            for c in t if isinstance(t, list) else [t]:
                c = scalar(c)
                same = np.array_equal(v, c) if isinstance(v, np.ndarray) or isinstance(c, np.ndarray) else type(v) is type(c) and v == c or isinstance(v, int | float) and isinstance(c, int | float) and v == c
                if same:
                    return self.block(body)
        self.block(other)

    def do_try(self, body, var, handler) -> None:
        try:
            self.block(body)
        except (Break, Continue, Return):
            raise
        except Exception as e:
            if var:
                self.put(var, str(e))
            self.block(handler)

    def do_break(self) -> None:
        raise Break

    def do_continue(self) -> None:
        raise Continue

    def do_return(self) -> None:
        raise Return

    def do_global(self, names) -> None:
        for n in names:
            self.shared.add(n)
            self.globals.setdefault(n, self.names.pop(n, 0.0))

    def do_function(self, name, args, outs, body) -> None:
        self.functions[name] = (args, outs, body)

    def do_clear(self, names) -> None:
        if not names or names == ["all"]:
            self.names.clear()
            if names:
                self.functions.clear()
        for n in names:
            self.names.pop(n, None)

    def call_function(self, name: str, args: list, nargout: int):
        params, outs, body = self.functions[name]
        names, shared = self.names, self.shared
        self.names, self.shared = {"nargin": float(len(args)), "nargout": float(nargout)}, set()
        try:
            for k, p in enumerate(params):
                if p == "varargin" and k == len(params) - 1:
                    self.names[p] = list(args[k:])
                elif k < len(args):
                    self.names[p] = args[k]
            if len(args) > len(params) and "varargin" not in params:
                raise ScriptError(f"{name} takes at most {len(params)} arguments")
            try:
                self.block(body)
            except Return:
                pass
            found = [self.get(o) for o in outs if self.has(o)]
            return Many(found) if len(found) > 1 else found[0] if found else None
        finally:  # the caller's names come back whatever happens
            self.names, self.shared = names, shared

    # Expressions.

    def eval(self, e, nargout: int = 1):
        return getattr(self, f"ev_{e[0]}")(*e[1:], **({"nargout": nargout} if e[0] in ("call", "name") else {}))

    ev_number = lambda self, v: v
    ev_text = lambda self, v: v
    ev_bool = lambda self, v: v

    def ev_name(self, name, nargout=1):
        return self.get(name) if self.has(name) else self.call(name, [], nargout)

    def ev_end(self):
        if not self.ends:
            raise ScriptError("end outside an index")
        base, k, n = self.ends[-1]
        shape = self.shape(base)
        return float(shape[0] * shape[1] if n == 1 else shape[k])

    def ev_handle(self, name):
        return Handle("@" + name, lambda *a, nargout=1: self.call(name, list(a), nargout))

    def ev_lambda(self, args, body, source):
        kept = dict(self.names)

        def call(*values, nargout=1):
            names, self.names = self.names, kept | dict(zip(args, values, strict=True))
            try:
                return self.eval(body, nargout)
            finally:
                self.names = names

        return Handle(source, call)

    def ev_cell(self, rows):
        return [first(self.eval(x)) for row in rows for x in row]

    def ev_matrix(self, rows):
        made = [[first(self.eval(x)) for x in row] for row in rows]
        if made and all(isinstance(x, str) for row in made for x in row):
            return [x for row in made for x in row]
        if any(isinstance(x, Matrix) for row in made for x in row):
            return mx.concat([mx.concat(map(self.lift, row)) for row in made], True)
        blocks = [np.hstack([array(x) for x in row if not (isinstance(x, np.ndarray) and x.size == 0)] or [np.zeros((0, 0))]) for row in made]
        if len({b.shape[1] for b in blocks}) > 1:
            raise ScriptError("rows must have the same length")
        return np.vstack(blocks) if blocks else np.zeros((0, 0))

    def ev_range(self, a, step, b):
        a, b = scalar(first(self.eval(a))), scalar(first(self.eval(b)))
        step = scalar(first(self.eval(step))) if step else 1.0
        if step == 0:
            raise ScriptError("the step must not be zero")
        n = max(0, math.floor((b - a) / step + 1e-9) + 1)
        if n > self.threshold and self.spark:
            return mx.colon(self.spark, a, b, step)
        return (a + np.arange(n) * step).reshape(1, -1)

    def ev_transpose(self, e):
        v = first(self.eval(e))
        return v.T if isinstance(v, Matrix | np.ndarray) else v

    def ev_unary(self, op, e):
        v = first(self.eval(e))
        if isinstance(v, Column):
            return {"-": lambda: -v, "+": lambda: v, "~": lambda: fm.not_(v)}[op]()
        if isinstance(v, Matrix):
            return {"-": v.negative, "+": lambda: v, "~": v.not_}[op]()
        if op == "~":
            return (v == 0).astype(float) if isinstance(v, np.ndarray) else float(not truth(v))
        return -v if op == "-" else v

    def lift(self, v) -> Matrix:
        return v if isinstance(v, Matrix) else Matrix.from_rows(self.spark, array(v).tolist())

    def ev_binary(self, op, a, b):
        return self.binary(op, first(self.eval(a)), first(self.eval(b)))

    def binary(self, op, a, b):
        if isinstance(a, Column) or isinstance(b, Column):
            return COLUMN[op](a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))
        if isinstance(a, str) or isinstance(b, str):
            if op == "+":
                return text_of(a) + text_of(b)
            if op in ("==", "~="):
                return float((a == b) == (op == "=="))
            raise ScriptError(f"texts have no operator {op}")
        if isinstance(a, list) and op == "+":
            return [*a, *(b if isinstance(b, list) else [b])]
        if isinstance(a, DateTime | Duration) or isinstance(b, DateTime | Duration):
            out = NUMPY[op](float(a), float(b)) if op in NUMPY else {"*": operator.mul, "/": operator.truediv}[op](float(a), float(b))
            if op in ("+", "-"):
                dates = isinstance(a, DateTime) + (1 if op == "+" else -1) * isinstance(b, DateTime)
                return DateTime(math.floor(out)) if dates else Duration(out)
            return out
        a, b = scalar(a), scalar(b)
        if isinstance(a, Matrix) or isinstance(b, Matrix):
            return self.lazy_binary(op, a, b)
        if not isinstance(a, np.ndarray) and not isinstance(b, np.ndarray):
            op = {"*": ".*", "/": "./", "\\": "\\"}.get(op, op)
            if op == "\\":
                return _divide(b, a)
            if op in (".^", "^") and (isinstance(a, complex) or isinstance(b, complex)):
                return a**b
            out = NUMPY[op](a, b)
            return out if isinstance(out, complex) else float(out)
        if op == "*":
            if isinstance(a, np.ndarray) and isinstance(b, np.ndarray):
                if a.shape[1] != b.shape[0]:
                    raise ScriptError("inner dimensions must agree")
                return a @ b
            return a * b
        if op == "/":
            if isinstance(b, np.ndarray):
                raise ScriptError("the right operand of / must be a number")
            return _divide(a, b)
        if op == "\\":
            return np.linalg.solve(array(a), np.broadcast_to(array(b), (len(array(a)), array(b).shape[1])))
        if isinstance(a, np.ndarray) and isinstance(b, np.ndarray) and a.shape != b.shape:
            raise ScriptError("matrix dimensions must agree")
        out = NUMPY[op](a, b)
        return out.astype(float) if isinstance(out, np.ndarray) and out.dtype == bool else out

    def lazy_binary(self, op, a, b):
        if op == "*":
            if isinstance(a, float | int):
                return b.scale(a)
            return a.scale(b) if isinstance(b, float | int) else self.lift(a).matmul(self.lift(b))
        if op == "/":
            return a.over(b)
        if op == "\\":
            return self.packed_call(np.linalg.solve, a, b)
        if isinstance(a, float | int):
            a = Matrix.of(self.spark, b.rows, b.cols, F.lit(float(a)))
        return getattr(self.lift(a), MATRIX[op])(self.lift(b) if isinstance(b, np.ndarray) else b)

    # Indexing and calls.

    def shape(self, v) -> tuple[int, int]:
        v = first(v)
        if isinstance(v, Matrix):
            return v.rows, v.cols
        if isinstance(v, np.ndarray):
            return v.shape[0], v.shape[1]
        return (1, len(v)) if isinstance(v, list | str) else (1, 1)

    def indices(self, base, args) -> list:
        out = []
        for k, a in enumerate(args):
            self.ends.append((base, k, len(args)))
            try:
                v = all if a[0] == "all" else first(self.eval(a))
            finally:
                self.ends.pop()
            out.append(v if v is all or isinstance(v, Matrix) else scalar(v))
        return out

    def ev_brace(self, base, args):
        cell = first(self.eval(base))
        index = self.indices(cell, args)
        return cell[int(index[-1]) - 1]

    def ev_field(self, base, name):
        v = first(self.eval(base))
        if isinstance(v, dict) and name in v:
            return v[name]
        raise ScriptError(f"no field {name}")

    def ev_call(self, target, args, nargout=1):
        if target[0] == "name" and not self.has(target[1]):
            return self.call(target[1], [first(self.eval(a)) for a in args], nargout)
        base = first(self.eval(target))
        if isinstance(base, Handle):
            return base.call(*(first(self.eval(a)) for a in args), nargout=nargout)
        if isinstance(base, dict):
            return base[text_of(first(self.eval(args[0])))]
        return self.index(base, self.indices(base, args))

    def index(self, base, index):
        if isinstance(base, Matrix):
            return self.lazy_index(base, index)
        if isinstance(base, list | str):
            k = index[0]
            return base if k is all else base[int(k) - 1]
        a = array(base)
        if len(index) == 1:
            k = index[0]
            if k is all:
                return a.reshape(-1, 1)
            if isinstance(k, np.ndarray) and k.shape == a.shape and set(np.unique(k)) <= {0.0, 1.0}:
                return a[k != 0].reshape(-1, 1)
            at = np.asarray(k, int).reshape(-1) - 1
            if not isinstance(k, np.ndarray) and not 0 <= at[0] < a.size:
                raise ScriptError("index out of bounds")
            inside = (at >= 0) & (at < a.size)
            out = np.where(inside, a.reshape(-1)[np.clip(at, 0, max(a.size - 1, 0))], 0.0)
            return float(out[0]) if not isinstance(k, np.ndarray) else out.reshape(-1, 1)
        if all_of(index):
            return a.reshape(-1, 1)
        rows, cols = (np.arange(n) if k is all else np.asarray(k, int).reshape(-1) - 1 for k, n in zip(index, a.shape, strict=True))
        for at, n in ((rows, a.shape[0]), (cols, a.shape[1])):
            if len(at) and (at.min() < 0 or at.max() >= n):
                raise ScriptError("index out of bounds")
        return scalar(a[np.ix_(rows, cols)])

    def lazy_index(self, m: Matrix, index):
        def as_range(k, n):
            if k is all:
                return None
            at = np.asarray(k.to_numpy() if isinstance(k, Matrix) else k, int).reshape(-1)
            step = int(at[1] - at[0]) if len(at) > 1 else 1
            if len(at) and not (at == at[0] + step * np.arange(len(at))).all():
                raise ScriptError("indices of large matrices must be ranges")
            return range(int(at[0]), int(at[-1]) + (1 if step > 0 else -1), step) if len(at) else range(0)

        if len(index) == 1:
            if index[0] is all:
                return m.column()
            if isinstance(index[0], Matrix) and (index[0].rows, index[0].cols) == (m.rows, m.cols):
                picked = m.where(index[0])
                return Matrix(picked.select(F.col("k").alias("i"), F.lit(0).cast("long").alias("j"), "v"), picked.count(), 1)
            r = as_range(index[0], m.numel())
            out = m.linear_range(r)
        else:
            out = m.column() if all_of(index) else m.sub(*(as_range(k, n) for k, n in zip(index, m.size(), strict=True)))
        return self.small(out)

    def small(self, m: Matrix):
        """Single cells come to the driver."""
        return float(m.to_numpy()[0, 0]) if m.numel() == 1 else m

    def call(self, name: str, args: list, nargout: int = 1):
        if name in self.functions:
            return self.call_function(name, args, nargout)
        if name in ELEMENTWISE and len(args) == 1:
            return self.elementwise(*ELEMENTWISE[name], args[0])
        if name in PAIRWISE and len(args) == 2:
            return self.pairwise(*PAIRWISE[name], *args)
        if name in self.builtins:
            return self.builtins[name](*args, **({"nargout": nargout} if name in self.wants_count else {}))
        raise ScriptError(f"undefined name {name}")

    def elementwise(self, with_numpy, with_column, v):
        if isinstance(v, Column):
            return with_column(v)
        if isinstance(v, Matrix):
            return v.map(with_column)
        with np.errstate(all="ignore"):
            if isinstance(v, complex):
                return complex(with_numpy(v)) if with_numpy is not np.abs else float(abs(v))
            out = with_numpy(np.asarray(v, float))
        return out if isinstance(v, np.ndarray) else float(out)

    def pairwise(self, with_numpy, with_column, a, b):
        if isinstance(a, Column) or isinstance(b, Column):
            return with_column(a, b)
        if isinstance(a, Matrix) or isinstance(b, Matrix):
            return self.lift(a).pairwise(b if not isinstance(b, np.ndarray) else self.lift(b), with_column)
        out = with_numpy(a, b)
        return out if isinstance(out, np.ndarray) and out.ndim else float(out)

    def packed_call(self, fn, *matrices):
        """A decomposition of lazy matrices: each is packed into one row, so it must fit a task."""
        return fn(*(m.to_numpy() if isinstance(m, Matrix) else array(m) for m in matrices))

    wants_count = {"max", "min", "sort", "size", "lu", "svd", "eig", "qr", "find", "histogram", "hist"}

    def _builtins(self) -> dict:
        from .library import library

        return library(self)


def column(source: str, **names) -> Column:
    """The Column of a script expression over named Columns (names not given are columns of that name)."""

    class Scope(dict):
        def __contains__(self, key):
            return key not in ELEMENTWISE and key not in PAIRWISE

        def __missing__(self, key):
            return F.col(key)

    it = Interpreter()
    it.names = Scope(names)
    for n, v in it.constants.items():
        it.names.setdefault(n, v)
    return it.value(source)


__all__ = ["Interpreter", "ScriptError", "column", "fs", "la", "delimited", "filesystem", "re"]
