"""Builtin functions of scripts, by name."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import functions as F

from ..functions import containers as ct
from ..functions import strings as fs
from ..functions import times as ft
from ..operators import linalg as la
from ..operators import matrix as mx
from ..operators.matrix import Matrix
from ..sources import delimited, filesystem
from . import interpreter as it


def library(me) -> dict:
    spark = me.spark

    def sized(local, lazy):
        """A constructor: local for few cells, by Spark for many."""

        def make(*shape):
            shape = [int(it.scalar(s)) for s in shape]
            n = math.prod(shape) if len(shape) > 1 else shape[0] ** 2
            return lazy(spark, *shape) if n > me.threshold and spark else local(*shape)

        return make

    def both(local, method: str):
        """A function of a matrix: numpy's for local ones, a method of lazy ones."""

        def call(m, *args):
            if isinstance(m, Matrix):
                return getattr(m, method)(*(int(a) if isinstance(a, float) else me.lift(a) for a in args))
            return local(it.array(m), *(int(a) if isinstance(a, float) and a == int(a) else it.array(a) if isinstance(a, np.ndarray | float) else a for a in args))

        return call

    def reduce(name):
        def call(m, dim=None):
            dim = None if dim is None else int(dim)
            if dim not in (None, 1, 2):
                raise it.ScriptError("dim must be 1 or 2")
            if isinstance(m, Matrix):
                rows = getattr(m, name)(dim)
                if dim is None:
                    return float(rows.first()[name])
                key = "j" if dim == 1 else "i"
                zero = F.lit(0).cast("long")
                return Matrix(rows.select((zero if dim == 1 else F.col(key)).alias("i"), (F.col(key) if dim == 1 else zero).alias("j"), F.col(name).alias("v")), *((1, m.cols) if dim == 1 else (m.rows, 1)))
            out = it.REDUCE[name](it.array(m), axis=None if dim is None else dim - 1)
            return float(out) if dim is None else out.reshape((1, -1) if dim == 1 else (-1, 1))

        return call

    def extreme(name):
        pick = {"max": np.argmax, "min": np.argmin}[name]

        def call(m, dim=None, nargout=1):
            dim = None if dim is None else int(dim)
            if isinstance(m, Matrix):
                rows = getattr(m, name)(dim).toPandas()
                if dim is None:
                    return it.Many((float(rows["value"][0]), float(rows["index"][0])))
                rows = rows.sort_values("j" if dim == 1 else "i")
                return it.Many(tuple(rows[c].to_numpy(float).reshape((1, -1) if dim == 1 else (-1, 1)) for c in ("value", "index")))
            a = it.array(m)
            if not a.size:
                raise it.ScriptError(f"{name} of an empty matrix")
            if dim is None:
                k = int(pick(a))
                return it.Many((float(a.reshape(-1)[k]), float(k + 1)))
            k = pick(a, axis=dim - 1)
            v = np.take_along_axis(a, np.expand_dims(k, dim - 1), dim - 1)
            return it.Many((v, (k + 1.0).reshape(v.shape)))

        return call

    def sort(m, dim=1, nargout=1):
        if isinstance(m, Matrix):
            rows = m.sort(int(dim))
            shape = (1, m.numel()) if 1 in m.size() else m.size()
            return it.Many((Matrix(rows.select("i", "j", "v"), *shape), Matrix(rows.select("i", "j", F.col("index").cast("double").alias("v")), *shape)))
        a = it.array(m)
        a, dim = (a.reshape(1, -1), 2) if 1 in a.shape else (a, int(dim))
        k = np.argsort(a, axis=dim - 1, kind="stable")
        return it.Many((np.take_along_axis(a, k, dim - 1), k + 1.0))

    def find(m, k=None, nargout=1):
        if isinstance(m, Matrix):
            rows = m.find(None if k is None else int(k)).orderBy("row", "col").toPandas().to_numpy(float)
        else:
            rows = np.argwhere(it.array(m) != 0)[: None if k is None else int(k)] + 1.0
        return it.Many((rows[:, :1], rows[:, 1:]))

    def magic(n):
        n = int(n)
        if spark is None:
            raise it.ScriptError("magic needs a session")
        m = mx.magic(spark, n)
        return m if n * n > me.threshold else m.to_numpy()

    def pascal(n):
        k = np.arange(int(n))
        return np.vectorize(lambda i, j: float(math.comb(i + j, i)))(k[:, None], k[None, :])

    def diag(a, k=0):
        k = int(k)
        return np.diag(a.reshape(-1), k) if 1 in a.shape else np.diag(a, k).reshape(1, -1)

    def cumulative(fn, method):
        def call(m, dim=None):
            if isinstance(m, Matrix):
                return getattr(m, method)(None if dim is None else int(dim))
            a = it.array(m)
            return fn(a.reshape(-1)).reshape(a.shape) if dim is None else fn(a, axis=int(dim) - 1)

        return call

    def diff(m, n=1):
        if isinstance(m, Matrix):
            return m.diff(int(n))
        a = it.array(m)
        if 1 not in a.shape:
            raise it.ScriptError("diff needs a vector")
        out = np.diff(a.reshape(-1), int(n))
        return out.reshape(1, -1) if a.shape[0] == 1 else out.reshape(-1, 1)

    def reshape(m, *dims):
        dims = [int(d) for d in dims]
        if len(dims) != 2:
            return {"dims": np.array([dims], float), "data": it.array(m).reshape(dims)}
        return m.reshape(*dims) if isinstance(m, Matrix) else it.array(m).reshape(dims)

    def linear_algebra(fn):
        return lambda *m, nargout=1: it.Many(r) if isinstance(r := me.packed_call(fn, *m), tuple) else r

    def text_split(s, d):
        return [s] if not d else s.split(d)

    def strfind(s, p):
        at = [i + 1.0 for i in range(len(s) - len(p) + 1) if s[i : i + len(p)] == p] if p else []
        return np.array(at).reshape(-1, 1) if at else 0.0

    def num2str(x):
        if isinstance(x, np.ndarray | Matrix):
            return it.text_of(x)
        out = f"{x:.6f}"
        return out.rstrip("0").rstrip(".")

    def str2num(s):
        m = re.match(fs.NUMBER_PREFIX, s)
        return float(m.group(1)) if m else 0.0

    def pattern(p, flags=0):
        return re.compile(re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), p), flags)

    def regexp(s, p, option="match", flags=0):
        try:
            found = list(pattern(p, flags).finditer(s))
        except re.error:
            return []
        if option == "match":
            return [m.group() for m in found]
        if option == "start":
            return np.array([[m.start() + 1.0 for m in found]]).T
        if option == "end":
            return np.array([[float(m.end()) for m in found]]).T
        if option == "tokens":
            return [list(m.groups()) or [m.group()] for m in found]
        if option == "split":
            cuts = [0, *(x for m in found for x in m.span()), len(s)]
            return [s[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        raise it.ScriptError(f"unknown option {option}")

    def regexprep(s, p, new):
        try:
            return pattern(p).sub(lambda m: re.sub(r"\$(\d|&)", lambda g: (m.group() if g[1] in "&0" else m.group(int(g[1])) or ""), new), s)
        except re.error:
            return s

    def datetime(s):
        import datetime as dt

        for f in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
            try:
                return it.DateTime((dt.datetime.strptime(s, f) - dt.datetime(1970, 1, 1)).total_seconds())
            except ValueError:
                continue
        raise it.ScriptError(f"no date: {s}")

    def make_map(*args):
        if not args:
            return {}
        k, v = (a if isinstance(a, list) else it.array(a).reshape(-1).tolist() for a in args)
        return {x if isinstance(x, str) else f"{int(x)}": y for x, y in zip(k, v, strict=True)}

    def sparse(*args):
        args = [a for a in args]
        if len(args) == 1:
            return me.lift(args[0]).to_sparse()
        if len(args) == 2:
            return mx.zeros(spark, int(args[0]), int(args[1])).to_sparse()
        i, j, v = (it.array(a).reshape(-1).tolist() for a in args[:3])
        cells = spark.createDataFrame(list(zip(map(int, i), map(int, j), v, strict=True)), "i long, j long, v double")
        return mx.sparse(spark, cells, *map(int, args[3:]))

    def table():
        return {}

    def show(*args):
        for a in args:
            me.out(it.text_of(a))

    def printf(fmt, *args):
        me.out(filesystem.c_format(fmt, *map(it.scalar, args)))

    def fprintf(h, *args):
        if isinstance(h, filesystem.FileHandle):
            return float(h.fprintf(args[0], *map(it.scalar, args[1:])))
        printf(h, *args)
        return None

    def whos():
        for n, v in me.names.items():
            r, c = me.shape(v)
            me.out(f"{n}  {r}x{c}  {type(v).__name__}")

    def isa(v, kind):
        tests = {
            "double": lambda: isinstance(v, float | np.ndarray | Matrix), "numeric": lambda: isinstance(v, float | np.ndarray | Matrix), "char": lambda: isinstance(v, str), "string": lambda: isinstance(v, list) and all(isinstance(x, str) for x in v),
            "cell": lambda: isinstance(v, list), "struct": lambda: isinstance(v, dict), "function_handle": lambda: isinstance(v, it.Handle), "logical": lambda: isinstance(v, bool), "sparse": lambda: isinstance(v, Matrix) and v.sparse, "Map": lambda: isinstance(v, dict), "containers.Map": lambda: isinstance(v, dict),
        }
        return float(kind in tests and tests[kind]())

    def dims_of(v) -> list[int]:
        return [int(x) for x in v["dims"].reshape(-1)] if isinstance(v, dict) and "dims" in v else list(me.shape(v))

    def duration(size):
        return lambda x: it.Duration(it.scalar(x) * size)

    def named(h):
        return h if isinstance(h, it.Handle) else me.ev_handle(str(h).lstrip("@"))

    def set_threshold(n):
        me.threshold = int(n)

    def add_row(t, *row):
        if len(row) != len(t):
            raise it.ScriptError("a row needs a value for each column")
        return {c: np.vstack([it.array(v).reshape(-1, 1), [[x if isinstance(x, float) else 0.0]]]) for (c, v), x in zip(t.items(), row, strict=True)}

    def complex_part(fn):
        return lambda z: fn(complex(z)) if not isinstance(z, np.ndarray) else fn(z)

    one_text = lambda fn: (lambda s: [fn(x) for x in s] if isinstance(s, list) else fn(s))
    fig = me.figures
    flat = lambda v: (v.to_numpy() if isinstance(v, Matrix) else it.array(v)).reshape(-1).tolist()
    curve = lambda fn: (lambda *a: fn(*(x if isinstance(x, str) else flat(x) for x in a)) and None)
    quiet = lambda fn: (lambda *a: fn(*(int(x) if isinstance(x, float) else flat(x) if isinstance(x, np.ndarray) else x for x in a)) and None)
    names = {
        "zeros": sized(lambda r, c=None: np.zeros((r, r if c is None else c)), mx.zeros), "ones": sized(lambda r, c=None: np.ones((r, r if c is None else c)), mx.ones), "eye": sized(np.eye, mx.eye),
        "rand": sized(lambda r, c: me.rng.random((r, c)), mx.rand), "randn": sized(lambda r, c: me.rng.standard_normal((r, c)), mx.randn),
        "randi": lambda *a: me.rng.integers(int(a[0]) if len(a) == 4 else 1, int(a[1]) if len(a) == 4 else int(a[0]), [int(a[-2]), int(a[-1])], endpoint=True).astype(float),
        "randperm": lambda n, k=None: (me.rng.permutation(int(n))[: int(n if k is None else k)] + 1.0).reshape(-1, 1),
        "linspace": lambda a, b, n=100.0: mx.linspace(spark, a, b, int(n)) if n > me.threshold and spark else (a + (b - a) * np.arange(max(int(n), 2)) / (max(int(n), 2) - 1)).reshape(-1, 1),
        "logspace": lambda a, b, n=50.0: (10.0 ** (a + (b - a) * np.arange(max(int(n), 2)) / (max(int(n), 2) - 1))).reshape(-1, 1),
        "magic": magic, "pascal": pascal, "hilb": lambda n: 1.0 / (np.arange(int(n))[:, None] + np.arange(int(n))[None, :] + 1), "vander": lambda v: np.vander(it.array(v).reshape(-1)),
        "meshgrid": lambda x, y=None: np.hstack(np.meshgrid(it.array(x).reshape(-1), it.array(x if y is None else y).reshape(-1))),
        "sparse": sparse, "speye": lambda n, m=None: mx.speye(spark, int(n), None if m is None else int(m)), "spdiags": lambda b, d, m, n: mx.spdiags(me.lift(b), [int(x) for x in it.array(d).reshape(-1)], int(m), int(n)),
        "full": lambda m: m.full().to_numpy() if isinstance(m, Matrix) and m.numel() <= me.threshold else m.full() if isinstance(m, Matrix) else m, "nnz": lambda m: float(m.nnz().first()["nnz"]) if isinstance(m, Matrix) else float(np.count_nonzero(m)), "issparse": lambda m: float(isinstance(m, Matrix) and m.sparse),
        "sum": reduce("sum"), "mean": reduce("mean"), "prod": reduce("prod"), "std": reduce("std"), "var": reduce("var"), "max": extreme("max"), "min": extreme("min"),
        "sort": sort, "find": find, "unique": lambda m: np.unique(m.to_numpy() if isinstance(m, Matrix) else it.array(m)).reshape(1, -1), "cumsum": cumulative(np.cumsum, "cumsum"), "cumprod": cumulative(np.cumprod, "cumprod"), "diff": diff,
        "size": lambda m, nargout=1: it.Many(map(float, dims_of(m))) if nargout > 1 else np.array([dims_of(m)], float), "length": lambda m: float(max(dims_of(m))), "numel": lambda m: float(math.prod(dims_of(m))), "isempty": lambda m: float(math.prod(dims_of(m)) == 0), "ndims": lambda m: float(len(dims_of(m))),
        "transpose": lambda m: m.T, "horzcat": lambda a, b: me.lift(a).horzcat(me.lift(b)) if isinstance(a, Matrix) or isinstance(b, Matrix) else np.hstack([it.array(a), it.array(b)]), "vertcat": lambda a, b: me.lift(a).vertcat(me.lift(b)) if isinstance(a, Matrix) or isinstance(b, Matrix) else np.vstack([it.array(a), it.array(b)]),
        "blkdiag": both(lambda a, b: np.block([[a, np.zeros((len(a), b.shape[1]))], [np.zeros((len(b), a.shape[1])), b]]), "blkdiag"), "kron": both(np.kron, "kron"), "repmat": both(lambda a, m, n: np.tile(a, (m, n)), "repmat"), "reshape": reshape,
        "flipud": both(np.flipud, "flipud"), "fliplr": both(np.fliplr, "fliplr"), "rot90": both(lambda a, k=1: np.rot90(a, k), "rot90"), "diag": both(diag, "diag"), "tril": both(np.tril, "tril"), "triu": both(np.triu, "triu"),
        "trace": lambda m: float(m.trace().first()["trace"]) if isinstance(m, Matrix) else float(np.trace(it.array(m))), "norm": lambda m: float(m.norm().first()["norm"]) if isinstance(m, Matrix) else float(np.sqrt((it.array(m) ** 2).sum())),
        "inv": linear_algebra(la.inverse), "det": linear_algebra(lambda a: float(np.linalg.det(a))), "lu": linear_algebra(la.lu), "qr": linear_algebra(la.qr), "svd": linear_algebra(la.svd), "eig": linear_algebra(la.eig), "chol": linear_algebra(la.chol), "solve": linear_algebra(np.linalg.solve), "cond": linear_algebra(la.cond), "rank": linear_algebra(la.rank), "mpower": lambda a, p: np.linalg.matrix_power(it.array(a), int(p)) if not isinstance(a, Matrix) else a.mpower(int(p)),
        "ndarray": lambda *d: {"dims": np.array([d], float), "data": np.zeros([int(x) for x in d])}, "squeeze": lambda n: {"dims": np.array([[x for x in n["data"].shape if x != 1] or [1]], float), "data": n["data"].squeeze()}, "permute": lambda n, *d: {"dims": n["dims"][:, [int(x) - 1 for x in d]], "data": n["data"].transpose([int(x) - 1 for x in d])},
        "primes": lambda n: np.array([[float(k) for k in range(2, int(n) + 1) if all(k % d for d in range(2, int(k**0.5) + 1))]]), "real": complex_part(lambda z: z.real), "imag": complex_part(lambda z: z.imag), "angle": lambda z: math.atan2(complex(z).imag, complex(z).real), "conj": lambda z: complex(z).conjugate(), "complex": lambda a, b: complex(a, b),
        "strcat": lambda *a: "".join(num if isinstance(x, str) else "".join(x) if isinstance(x, list) else f"{x:.6f}" for x in a for num in [x]), "strcmp": lambda a, b: it.text_of(a) == it.text_of(b), "strcmpi": lambda a, b: it.text_of(a).lower() == it.text_of(b).lower(), "strfind": strfind, "strrep": lambda s, a, b: s.replace(a, b) if a else s, "replace": lambda s, a, b: s.replace(a, b, 1) if a else s,
        "strtrim": lambda s: s.strip(" \t\r\n"), "num2str": num2str, "str2num": str2num, "startsWith": lambda s, p: float(s.startswith(p)), "endsWith": lambda s, p: float(s.endswith(p)), "contains": lambda s, p: float(p in s), "join": lambda x, d="": d.join(v if isinstance(v, str) else f"{v:.6f}" for v in (x if isinstance(x, list) else flat(x))), "strjoin": lambda x, d="": d.join(x),
        "split": text_split, "strsplit": lambda s, d=" ": text_split(s, d), "extractBefore": lambda s, k: s[: int(k) - 1] if 1 <= k <= len(s) else "", "extractAfter": lambda s, k: s[int(k) :] if 1 <= k < len(s) else "", "extractBetween": lambda s, a, b: s[int(a) - 1 : int(b)] if 1 <= a <= b <= len(s) else "", "reverse": one_text(lambda s: s[::-1]),
        "upper": one_text(lambda s: re.sub("[a-z]+", lambda m: m[0].upper(), s)), "lower": one_text(lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s)), "strlength": lambda s: np.array([[float(len(x.encode())) for x in s]]).T if isinstance(s, list) else float(len(s.encode())), "sprintf": lambda f, *a: filesystem.c_format(f, *map(it.scalar, a)), "sscanf": lambda s, f="%f": np.array([[float(m[1]) for t in s.split() if (m := re.match(fs.NUMBER_PREFIX, t))]]).T,
        "isletter": lambda s: np.array([[float(bool(re.match("[A-Za-z]", c))) for c in s]]), "isspace": lambda s: np.array([[float(c in " \t\n\x0b\f\r") for c in s]]), "string": lambda *a: [num2str(x) if isinstance(x, float) else it.text_of(x) for x in a], "char": lambda *a: (a[0] if isinstance(a[0], str) else "".join(chr(int(c)) for c in flat(a[0]))) if len(a) == 1 else [x.ljust(max(map(len, a))) for x in a],
        "regexp": regexp, "regexpi": lambda s, p, o="match": regexp(s, p, o, re.I), "regexprep": regexprep, "regexptranslate": lambda kind, s: re.sub(r"([.^$*+?(){}\[\]|\\])", r"\\\1", s), "regex": lambda p: re.compile(p), "regexpattern": fs.regexpattern, "isregex": lambda v: float(isinstance(v, re.Pattern)),
        "struct": lambda *a: dict(zip(a[::2], a[1::2], strict=True)), "fieldnames": lambda s: list(s), "cell": lambda r=0.0, c=1.0: [None] * int(r * c), "table": table, "height": lambda t: float(len(it.array(next(iter(t.values()))).reshape(-1)) if t else 0), "width": lambda t: float(len(t)),
        "addrow": add_row, "removerow": lambda t, k: {c: np.delete(it.array(v).reshape(-1, 1), int(k) - 1, 0) for c, v in t.items()}, "getrow": lambda t, k: [float(it.array(v).reshape(-1)[int(k) - 1]) for v in t.values()], "categorical": lambda c: it.Categorical(x for x in c if isinstance(x, str)), "categories": lambda c: c.categories,
        "Map": make_map, "isKey": lambda m, k: float((k if isinstance(k, str) else f"{int(k)}") in m), "keys": lambda m: sorted(m), "values": lambda m: [m[k] for k in sorted(m)], "remove": lambda m, k: m.pop(k if isinstance(k, str) else f"{int(k)}", None) and None,
        "datetime": datetime, "years": duration(ft.YEAR), "days": duration(ft.DAY), "hours": duration(ft.HOUR), "minutes": duration(ft.MINUTE), "seconds": duration(ft.SECOND), "months": duration(ft.MONTH),
        "isa": isa, "isstruct": lambda v: isa(v, "struct"), "iscell": lambda v: isa(v, "cell"), "istable": lambda v: float(isinstance(v, dict)), "iscategorical": lambda v: float(isinstance(v, it.Categorical)), "isdatetime": lambda v: float(isinstance(v, it.DateTime)), "isduration": lambda v: float(isinstance(v, it.Duration)), "isndarray": lambda v: float(isinstance(v, dict) and "dims" in v), "isstring": lambda v: isa(v, "string"), "islogical": lambda v: isa(v, "logical"), "ischar": lambda v: isa(v, "char"),
        "str2func": named, "func2str": lambda h: h.name, "feval": lambda h, *a: named(h).call(*a), "disp": show, "print": show, "printf": printf, "who": lambda: show(*me.names), "whos": whos,
        "csvread": lambda p, r=0, c=0: delimited.csvread(spark, p, int(r), int(c)), "dlmread": lambda p, d, r=0, c=0: delimited.dlmread(spark, p, d, int(r), int(c)), "readmatrix": lambda p, d=None: delimited.readmatrix(spark, p, d), "csvwrite": lambda p, m: delimited.csvwrite(p, me.lift(m)), "dlmwrite": lambda p, m, d=",", n=6: delimited.dlmwrite(me.lift(m), p, d, int(n)), "writematrix": lambda m, p, d=",": delimited.writematrix(me.lift(m), p, d),
        "textscan": lambda p, f: [list(c) for c in zip(*delimited.textscan(spark, p.path if isinstance(p, filesystem.FileHandle) else p, f).drop("line").collect(), strict=True)], "save": lambda p, *n: delimited.save(p, **{x: me.lift(v) if isinstance(v := me.get(x), np.ndarray) else v for x in n}), "load": lambda p: delimited.load(spark, p),
        "fopen": filesystem.fopen, "fclose": lambda h: h.fclose(), "fprintf": fprintf, "fscanf": lambda h, f="%f": np.array([h.fscanf()]).T, "fread": lambda h, n: np.frombuffer(open(h.path, "rb").read(8 * int(n)), np.float64).reshape(-1, 1), "fwrite": lambda h, v: float(filesystem.fwrite(h.path, v if isinstance(v, str) else flat(v))),
        "dir": filesystem.dir_, **{n: getattr(filesystem, n) for n in ("mkdir", "rmdir", "pwd", "cd", "fullfile", "fileparts", "filesep", "exist", "exists", "isfile", "isfolder", "isdir", "deletefile", "rmfile", "copyfile", "movefile")},
        "enable_gpu": lambda: None, "disable_gpu": lambda: None, "set_gpu_threshold": set_threshold, "gpu_info": lambda: me.out(f"Spark {spark.version}, {spark.sparkContext.defaultParallelism} slots" if spark else "no session"),
        **{n: curve(getattr(fig, n)) for n in ("plot", "scatter", "bar")}, **{n: quiet(getattr(fig, n)) for n in ("figure", "title", "xlabel", "ylabel", "legend", "grid", "hold", "xlim", "ylim", "axis", "clf", "subplot", "close")}, "show": lambda: None,
        "hist": lambda m, bins=10, nargout=1: fig.histogram(me.lift(m), int(bins)), "histogram": lambda m, bins=10, nargout=1: fig.histogram(me.lift(m), int(bins)),
    }
    return names


__all__ = ["library", "ct"]
