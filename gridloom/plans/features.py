"""Registered queries of scripts, files, images, arrays of many dimensions, compensated sums and small factors, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import images as im
from ..operators import linalg as la
from ..operators.matrix import Matrix
from ..operators.ndarray import NDArray, ind2sub, sub2ind
from ..script import Interpreter
from ..sources import delimited
from .elementwise import table
from .lineage import shared_folder
from .matrices import E, cells, embeddings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Scripts. N is the matrix of nation and region keys by nation key, E the lazy matrix of embeddings.

#: name: (script, {variable: SQL of its values as k, num, txt}).
NUM = "SELECT 0 AS k, {} AS num, NULL AS txt FROM nation"
TXT = "SELECT 0 AS k, NULL AS num, {} AS txt"
CONST = "SELECT 0 AS k, {} AS num, NULL AS txt"
SCRIPTS = {
    "sc_logic": ("a = 0;\nfor i = 1:25\n  if N(i,2) == 1 && N(i,1) > 3 || N(i,1) == 0\n    a = a + 1;\n  end\nend", {"a": NUM.format("count(*) FILTER ((n_regionkey = 1 AND n_nationkey > 3) OR n_nationkey = 0)")}),
    "sc_literal": ("A = [N(1,1) N(2,1); N(3,1) N(4,1)]; # a comment\nt = A(2,1) + 10*A(1,2);", {"A": "SELECT n_nationkey AS k, n_nationkey AS num, NULL AS txt FROM nation WHERE n_nationkey < 4", "t": NUM.format("sum(CASE n_nationkey WHEN 2 THEN n_nationkey WHEN 1 THEN 10 * n_nationkey END)")}),
    "sc_end": ("x = N(end,1); y = E(end,1); z = N(end-1,2);", {"x": NUM.format("max(n_nationkey)"), "y": "SELECT 0 AS k, embedding[1] AS num, NULL AS txt FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings)", "z": "SELECT 0 AS k, n_regionkey AS num, NULL AS txt FROM nation WHERE n_nationkey = 23"}),
    "sc_while": ("s = 0; k = 1;\nwhile k <= 25\n  s = s + N(k,1)*N(k,2);\n  k = k + 1;\nend", {"s": NUM.format("sum(n_nationkey * n_regionkey)"), "k": NUM.format("count(*) + 1")}),
    "sc_break_continue": ("s = 0;\nfor i = 1:25\n  if N(i,2) == 0\n    continue;\n  end\n  if N(i,1) > 20\n    break;\n  end\n  s = s + N(i,1);\nend", {"s": NUM.format("sum(n_nationkey) FILTER (n_regionkey <> 0 AND n_nationkey <= 20)")}),
    "sc_function": ("function [a, b, c] = three(x)\n  a = x; b = 2*x; c = 3*x;\nend\nfunction y = fact(n)\n  if n <= 1\n    y = 1;\n    return\n  end\n  y = n * fact(n - 1);\nend\n[p, ~, q] = three(N(5,1));\nt = fact(N(7,1));", {"p": NUM.format("max(n_nationkey) FILTER (n_nationkey = 4)"), "q": NUM.format("3 * max(n_nationkey) FILTER (n_nationkey = 4)"), "t": NUM.format("factorial(CAST(max(n_nationkey) FILTER (n_nationkey = 6) AS INTEGER))")}),
    "sc_global": ("global g\ng = 5;\nfunction y = h(x)\n  global g\n  y = g + x;\nend\nv = h(N(3,1));", {"v": NUM.format("5 + max(n_nationkey) FILTER (n_nationkey = 2)")}),
    "sc_handles": ("k = 3; f = @(x) x*k + 1; k = 100; u = f(N(8,1)); g = @abs; z = g(-N(8,1)); h = str2func(\"floor\"); w = h(2.75); c = func2str(g);", {"u": NUM.format("3 * max(n_nationkey) FILTER (n_nationkey = 7) + 1"), "z": NUM.format("max(n_nationkey) FILTER (n_nationkey = 7)"), "w": CONST.format(2), "c": TXT.format("'@abs'")}),
    "sc_switch_try": ("c = 0;\nfor i = 1:25\n  switch N(i,2)\n    case 1\n      c = c + 1;\n    case 2\n      c = c + 100;\n    otherwise\n      c = c + 10000;\n  end\nend\nm = \"\";\ntry\n  nothing_here(1)\ncatch e\n  m = \"caught\";\nend", {"c": NUM.format("sum(CASE n_regionkey WHEN 1 THEN 1 WHEN 2 THEN 100 ELSE 10000 END)"), "m": TXT.format("'caught'")}),
    "sc_struct": ("s.a = N(6,1); s.b.c = N(7,1); x = s.a + 1; y = s.b.c; n = numel(fieldnames(s));", {"x": NUM.format("max(n_nationkey) FILTER (n_nationkey = 5) + 1"), "y": NUM.format("max(n_nationkey) FILTER (n_nationkey = 6)"), "n": CONST.format(2)}),
    "sc_cells": ("C = {N(3,1), \"x\"}; C{4} = 9; n = numel(C); v = C{1}; w = C{2}; q = [\"a\", \"bc\"]; m = numel(q);", {"n": CONST.format(4), "v": NUM.format("max(n_nationkey) FILTER (n_nationkey = 2)"), "w": TXT.format("'x'"), "m": CONST.format(2)}),
    "sc_texts": ("s = string(N(9,1)); c = char([72 105]); r = regexprep(\"a1b2\", \"[0-9]\", \"#\"); t = sprintf(\"%d-%s\", 7, \"x\");", {"s": TXT.format("CAST(n_nationkey AS VARCHAR)") + " FROM nation WHERE n_nationkey = 8", "c": TXT.format("'Hi'"), "r": TXT.format("'a#b#'"), "t": TXT.format("'7-x'")}),
    "sc_size": ("z = size(E); l = length(E); n = numel(E); e = isempty(E); [r, c] = size(N);", {"z": "SELECT k, CASE k WHEN 0 THEN r ELSE 64 END AS num, NULL AS txt FROM (SELECT count(*) AS r FROM embeddings), range(2) t(k)", "l": "SELECT 0 AS k, greatest(count(*), 64) AS num, NULL AS txt FROM embeddings", "n": "SELECT 0 AS k, 64 * count(*) AS num, NULL AS txt FROM embeddings", "e": CONST.format(0), "r": NUM.format("count(*)"), "c": CONST.format(2)}),
    "sc_lazy": ("A = E .* 2 + 1; s = sum(A); m = mean(E(:,3)); g = E' * E; t = trace(g);", {"s": "SELECT 0 AS k, round(sum(2 * v + 1), 6) AS num, NULL AS txt FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)", "m": "SELECT 0 AS k, round(avg(CAST(embedding[3] AS DOUBLE)), 6) AS num, NULL AS txt FROM embeddings", "t": "SELECT 0 AS k, round(sum(v * v), 6) AS num, NULL AS txt FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"}),
    "sc_solve": ("A = [2 1 -1; -3 -1 2; -2 1 2]; b = [8; -11; -3]; x = A \\ b; d = det(A); r = rank(A);", {"x": "SELECT k, [2, 3, -1][k + 1] AS num, NULL AS txt FROM range(3) t(k)", "d": CONST.format(-1), "r": CONST.format(3)}),
    "sc_ndarray": ("n = ndarray(2,3,4); z = size(n); m = numel(n); p = size(permute(n, 3, 1, 2)); q = size(squeeze(ndarray(1,5,1))); d = ndims(n);", {"z": "SELECT k, k + 2 AS num, NULL AS txt FROM range(3) t(k)", "m": CONST.format(24), "p": "SELECT k, [4, 2, 3][k + 1] AS num, NULL AS txt FROM range(3) t(k)", "q": CONST.format(5), "d": CONST.format(3)}),
}
#: Predicates: (script expression, 1 or 0). Values stand for themselves.
PREDICATES = {
    "isstruct(s)": 1, "isstruct(N)": 0, "iscell(C)": 1, "iscell(t)": 0, "isdatetime(d)": 1, "isdatetime(u)": 0, "isduration(u)": 1, "isduration(d)": 0, "isregex(r)": 1, "isregex(t)": 0,
    "issparse(S)": 1, "issparse(N)": 0, "islogical(true)": 1, "islogical(N)": 0, "ischar(t)": 1, "ischar(N)": 0, "isstring(q)": 1, "isstring(N)": 0, "isndarray(n)": 1, "isndarray(N)": 0,
    "iscategorical(k)": 1, "iscategorical(t)": 0, "istable(s)": 1, "istable(t)": 0, "isa(N, \"double\")": 1, "isa(t, \"char\")": 1, "isa(t, \"double\")": 0, "isempty(zeros(0,0))": 1,
}
GIVEN = "s.a = 1; C = {1, 2}; t = \"txt\"; d = datetime(\"2020-01-01\"); u = days(2); r = regex(\"a+\"); S = sparse(N); q = [\"a\", \"b\"]; n = ndarray(2,3); k = categorical({\"x\", \"y\"});"


def _values(name: str, v) -> list[tuple]:
    if isinstance(v, Matrix):
        v = v.to_numpy()  # results of these scripts are small
    if isinstance(v, str):
        return [(name, 0, None, v)]
    if isinstance(v, list):
        return [(name, k, None if isinstance(x, str) else float(x), x if isinstance(x, str) else None) for k, x in enumerate(v)]
    return [(name, k, round(float(x), 6) + 0.0, None) for k, x in enumerate(np.asarray(v, float).reshape(-1).tolist())]


def run_script(spark, sf_dir: str, source: str, wanted: list[str]) -> DataFrame:
    """(name, k, num, txt): the values of variables after a script has run."""
    it = Interpreter(spark, lambda text: None)
    keys = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()  # 25 nations
    it.put("N", np.array([list(r) for r in keys], float))
    it.put("E", embeddings(spark, sf_dir))
    it.run(source)
    rows = [row for name in wanted for row in _values(name, it.value(name))]
    return spark.createDataFrame(rows, "name string, k int, num double, txt string")


def _script(source: str, wanted: list[str]):
    return lambda spark, sf_dir: run_script(spark, sf_dir, source, wanted)


for _name, (_source, _wanted) in SCRIPTS.items():
    QUERIES[_name] = _script(_source, list(_wanted))
    ORACLES[_name] = " UNION ALL ".join(f"SELECT '{v}' AS name, CAST(k AS INTEGER) AS k, CAST(num AS DOUBLE) AS num, CAST(txt AS VARCHAR) AS txt FROM ({sql})" for v, sql in _wanted.items())
QUERIES["sc_predicates"] = _script(GIVEN, list(PREDICATES))
ORACLES["sc_predicates"] = "SELECT name, 0 AS k, CAST(num AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS txt FROM (VALUES " + ", ".join(f"('{e}', {v})" for e, v in PREDICATES.items()) + ") t(name, num)"


# Files: written to the shared folder and read again. Cells are whole 64ths, which six decimals hold exactly.


def _whole(spark, sf_dir: str) -> Matrix:
    return embeddings(spark, sf_dir).map(lambda v: F.floor(v * 64) / 64)


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _round_trip(write, read):
    def query(spark, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        write(_whole(spark, sf_dir), path)
        return cells(read(spark, path))

    return query


def _text_lines(spark, sf_dir: str) -> str:
    path = _folder(spark)
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderkey", F.format_string("%.2f", F.col("o_orderkey") / 4), "o_orderstatus", F.lit("end")).alias("value"))
    lines.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return path


def _textscan(spark, sf_dir: str) -> DataFrame:
    return delimited.textscan(spark, _text_lines(spark, sf_dir), "%d %f %s %c")


def _fscanf(spark, sf_dir: str) -> DataFrame:
    return delimited.fscanf(spark, _text_lines(spark, sf_dir))


def _save_load(spark, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    delimited.save(path, A=_whole(spark, sf_dir), n=2.5, s="some text")
    back = delimited.load(spark, path)
    rest = spark.createDataFrame([(-1, -1, back["n"]), (-2, -2, float(len(back["s"])))], "i long, j long, v double")
    return cells(back["A"]).unionByName(rest)


QUERIES |= {
    "io_csv": _round_trip(lambda m, p: delimited.csvwrite(p, m), delimited.csvread),
    "io_dlm": _round_trip(lambda m, p: delimited.dlmwrite(m, p, ";"), lambda spark, p: delimited.dlmread(spark, p, ";", 2, 1)),
    "io_folder": _round_trip(lambda m, p: delimited.dlmwrite(m, p, ",", one_file=False), delimited.csvread),
    "io_matrix": _round_trip(lambda m, p: delimited.writematrix(m, p, "\t"), delimited.readmatrix),
    "io_textscan": _textscan, "io_fscanf": _fscanf, "io_save_load": _save_load,
}
_W = E + ", w AS (SELECT i, j, floor(v * 64) / 64 AS v FROM e) "
_CELLS = "SELECT CAST({} AS BIGINT) AS i, CAST({} AS BIGINT) AS j, v + 0.0 AS v FROM w"
for _name in ("io_csv", "io_folder", "io_matrix"):
    ORACLES[_name] = _W + _CELLS.format("i", "j")
ORACLES |= {
    "io_dlm": _W + _CELLS.format("i - 2", "j - 1") + " WHERE i >= 2 AND j >= 1",
    "io_save_load": _W + _CELLS.format("i", "j") + " UNION ALL SELECT -1, -1, 2.5 UNION ALL SELECT -2, -2, 9.0",
    "io_textscan": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line, o_orderkey AS c1, o_orderkey / 4.0 AS c2, o_orderstatus AS c3, 'e' AS c4 FROM orders",
    "io_fscanf": "SELECT row_number() OVER (ORDER BY o_orderkey, n) - 1 AS k, CASE n WHEN 0 THEN o_orderkey ELSE o_orderkey / 4.0 END AS v FROM orders, range(2) t(n)",
}

# Images: a pattern of 40 x 30 pixels in three channels.
P = "WITH p AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(c AS INTEGER) AS c, CAST(trunc(CASE c WHEN 0 THEN x * 255 / 40.0 WHEN 1 THEN y * 255 / 30.0 ELSE (x + y) * 255 / 70.0 END) AS INTEGER) AS v FROM range(40) a(x), range(30) b(y), range(3) k(c)) "
#: name: (image from the pattern, SQL of its pixels).
PICTURES = {
    "pattern": (lambda p: p, "SELECT x, y, c, v FROM p"),
    "gradient": (lambda p: im.gradient(p.spark, 50, 20), "SELECT x, y, 0 AS c, trunc(x * 255 / 49.0) AS v FROM range(50) a(x), range(20) b(y)"),
    "checkerboard": (lambda p: im.checkerboard(p.spark, 40, 24, 8), "SELECT x, y, 0 AS c, CASE WHEN (x // 8 + y // 8) % 2 = 0 THEN 255 ELSE 0 END AS v FROM range(40) a(x), range(24) b(y)"),
    "circle": (lambda p: im.circle(p.spark, 30), "SELECT x, y, 0 AS c, CASE WHEN sqrt((x - 15) * (x - 15) + (y - 15) * (y - 15)) <= 12 THEN 255 ELSE 0 END AS v FROM range(30) a(x), range(30) b(y)"),
    "flip_h": (lambda p: p.flip_horizontal(), "SELECT 39 - x AS x, y, c, v FROM p"),
    "flip_v": (lambda p: p.flip_vertical(), "SELECT x, 29 - y AS y, c, v FROM p"),
    "rotate90": (lambda p: p.rotate90(), "SELECT 29 - y AS x, x AS y, c, v FROM p"),
    "rotate180": (lambda p: p.rotate180(), "SELECT 39 - x AS x, 29 - y AS y, c, v FROM p"),
    "rotate270": (lambda p: p.rotate270(), "SELECT y AS x, 39 - x AS y, c, v FROM p"),
    "crop": (lambda p: p.crop(5, 6, 100, 10), "SELECT x - 5 AS x, y - 6 AS y, c, v FROM p WHERE x >= 5 AND y >= 6 AND y < 16"),
    "resize": (lambda p: p.resize(20, 45), "SELECT a.x, b.y, p.c, p.v FROM range(20) a(x), range(45) b(y), p WHERE p.x = a.x * 2 AND p.y = b.y * 30 // 45"),
    "grayscale": (lambda p: p.grayscale(), "SELECT x, y, 0 AS c, floor(sum(v * CASE c WHEN 0 THEN 0.299 WHEN 1 THEN 0.587 ELSE 0.114 END) + 1e-9) AS v FROM p GROUP BY x, y"),
    "fill": (lambda p: p.fill(7), "SELECT x, y, c, 7 AS v FROM p"),
    "pixel": (lambda p: im.Image(p.at(3, 4), 40, 30, 3), "SELECT x, y, c, v FROM p WHERE x = 3 AND y = 4"),
    "matrix": (lambda p: im.Image.from_matrix(p.to_matrix().scale(2.0), 3), "SELECT x, y, c, least(255, 2 * v) AS v FROM p"),
}


def _picture(fn):
    return lambda spark, sf_dir: fn(im.test_pattern(spark, 40, 30)).df.select(*(F.col(c).cast("int").alias(c) for c in "xycv"))


for _name, (_fn, _sql) in PICTURES.items():
    QUERIES[f"img_{_name}"] = _picture(_fn)
    ORACLES[f"img_{_name}"] = f"{P} SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(c AS INTEGER) AS c, CAST(v AS INTEGER) AS v FROM ({_sql})"

# Arrays of embeddings as vectors x 4 x 16, and rows, columns and blocks put into a matrix.


def _array(fn):
    def query(spark, sf_dir: str) -> DataFrame:
        e = embeddings(spark, sf_dir)
        return fn(NDArray.from_matrix(e, e.rows, 4, 16)).df.select("k", (F.round("v", 6) + 0.0).alias("v"))

    return query


def _places(spark, sf_dir: str) -> DataFrame:
    dims = (20000, 3, 5)
    subs = ind2sub(dims, F.col("o_orderkey") % 300000)
    return table(spark, sf_dir, "orders").select("o_orderkey", *(s.alias(f"s{d}") for d, s in enumerate(subs)), sub2ind(dims, subs).alias("back"))


_A = E + ", a AS (SELECT i, j // 16 AS p, j % 16 AS q, v FROM e) "
_KV = "SELECT CAST({} AS BIGINT) AS k, round(v, 6) + 0.0 AS v FROM a"
QUERIES |= {
    "nd_permute": _array(lambda a: a.permute(3, 1, 2)), "nd_slice": _array(lambda a: a.slice(2, 3)), "nd_reshape": _array(lambda a: a.reshape(a.numel() // 8, 1, 8).squeeze().permute(2, 1)),
    "nd_at": lambda spark, sf_dir: NDArray.from_matrix(embeddings(spark, sf_dir), embeddings(spark, sf_dir).rows, 4, 16).at(5, 2, 7).select((F.round("v", 6) + 0.0).alias("v")),
    "nd_ind2sub": _places, "nd_ones": lambda spark, sf_dir: NDArray.ones(spark, 3, 4, 5).df,
}
ORACLES |= {
    "nd_permute": _A + _KV.format("(q * (SELECT r FROM s) + i) * 4 + p"), "nd_slice": _A + _KV.format("i * 16 + q") + " WHERE p = 2",
    "nd_reshape": E + "SELECT CAST((j % 8) * ((SELECT r FROM s) * 8) + (i * 64 + j) // 8 AS BIGINT) AS k, round(v, 6) + 0.0 AS v FROM e", "nd_at": _A + "SELECT round(v, 6) + 0.0 AS v FROM a WHERE i = 4 AND p = 1 AND q = 6",
    "nd_ind2sub": "SELECT o_orderkey, o_orderkey % 300000 // 15 AS s0, o_orderkey % 300000 // 5 % 3 AS s1, o_orderkey % 300000 % 5 AS s2, o_orderkey % 300000 AS back FROM orders", "nd_ones": "SELECT CAST(k AS BIGINT) AS k, 1.0 AS v FROM range(60) t(k)",
}
PUT = {
    "ix_set_row": (lambda e: e.set_row(3, e.row(1)), "SELECT a.i, a.j, CASE WHEN a.i = 2 THEN b.v ELSE a.v END AS v FROM e a JOIN e b ON b.i = 0 AND a.j = b.j"),
    "ix_set_col": (lambda e: e.set_col(5, e.col(2)), "SELECT a.i, a.j, CASE WHEN a.j = 4 THEN b.v ELSE a.v END AS v FROM e a JOIN e b ON b.j = 1 AND a.i = b.i"),
    "ix_set_block": (lambda e: e.set_block(2, 3, e.sub(range(1, 5), range(1, 7)).scale(2.0)), "SELECT a.i, a.j, coalesce(2 * b.v, a.v) AS v FROM e a LEFT JOIN e b ON b.i = a.i - 1 AND b.j = a.j - 2 AND b.i < 4 AND b.j < 6"),
}


def _put(fn):
    return lambda spark, sf_dir: cells(fn(embeddings(spark, sf_dir)))


for _name, (_fn, _sql) in PUT.items():
    QUERIES[_name] = _put(_fn)
    ORACLES[_name] = f"{E} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 6) + 0.0 AS v FROM ({_sql})"

# Compensated sums, and factors of the 2 x 2 matrices [1, mean x; mean x, mean x^2] of each return flag, x a tenth of the quantity.


def _sums(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    total = la.kahan_sum(rows, F.col("l_extendedprice") * 1e10 + F.col("l_tax"))
    dot = la.compensated_dot(rows, F.col("l_quantity"), F.col("l_extendedprice"))
    return total.select(F.round(F.col("sum") / 1e10, 4).alias("total")).join(dot.select(F.round("dot", 2).alias("dot")))


def _small(spark, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity") / 10
    sums = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg(x).alias("p"), F.avg(x * x).alias("q"), F.avg(F.col("l_extendedprice") / 10000).alias("b0"), F.avg(x * F.col("l_extendedprice") / 10000).alias("b1"))
    return sums.select("l_returnflag", la.packed(2, 2, F.array(F.lit(1.0), "p", "p", "q")).alias("a"), la.packed(2, 1, F.array("b0", "b1")).alias("b"))


_S = "WITH m AS (SELECT l_returnflag, avg(l_quantity / 10) AS p, avg(l_quantity / 10 * l_quantity / 10) AS q, avg(l_extendedprice / 10000) AS b0, avg(l_quantity / 10 * l_extendedprice / 10000) AS b1 FROM lineitem GROUP BY 1), f AS (SELECT *, q - p * p AS det, sqrt((1 - q) * (1 - q) + 4 * p * p) AS gap FROM m) "
_X = ["(q * b0 - p * b1) / det", "(b1 - p * b0) / det"]
#: name: (adds columns, packed column, SQL of its data).
FACTORS = {
    "chol": (lambda d: la.with_chol(d, "a"), "r", ["1", "p", "0", "sqrt(det)"]),
    "lu_l": (lambda d: la.with_lu(d, "a"), "l", ["1", "0", "1 / p", "1"]),
    "lu_u": (lambda d: la.with_lu(d, "a"), "u", ["p", "q", "0", "p - q / p"]),
    "lu_p": (lambda d: la.with_lu(d, "a"), "p", ["0", "1", "1", "0"]),
    "inv": (lambda d: la.with_inv(d, "a"), "inv", ["q / det", "-p / det", "-p / det", "1 / det"]),
    "eig_d": (lambda d: la.with_eig(d, "a"), "d", ["(1 + q - gap) / 2", "0", "0", "(1 + q + gap) / 2"]),
    "svd_s": (lambda d: la.with_svd(d, "a"), "s", ["(1 + q + gap) / 2", "0", "0", "(1 + q - gap) / 2"]),
    "qr_q": (lambda d: la.with_qr(d, "a"), "q", ["1 / sqrt(1 + p * p)", "-p / sqrt(1 + p * p)", "p / sqrt(1 + p * p)", "1 / sqrt(1 + p * p)"]),
    "qr_r": (lambda d: la.with_qr(d, "a"), "r", ["sqrt(1 + p * p)", "(p + p * q) / sqrt(1 + p * p)", "0", "det / sqrt(1 + p * p)"]),
    "scaled": (lambda d: la.with_scaled(d, "a"), "scaled", ["1 / q", "p / q", "p / q", "1"]),
    "least": (lambda d: la.with_least(d, "a", "b"), "x", _X),
    "solve_qr": (lambda d: la.with_solve_qr(d, "a", "b"), "x", _X),
}


def _factor(fn, column: str, n: int):
    return lambda spark, sf_dir: fn(_small(spark, sf_dir)).select("l_returnflag", *((F.round(F.col(column)["data"][k], 5) + 0.0).alias(f"x{k}") for k in range(n)))


def _conditions(spark, sf_dir: str) -> DataFrame:
    out = la.with_rank(la.well_conditioned(_small(spark, sf_dir), "a"), "a")
    return out.select("l_returnflag", F.round("cond", 4).alias("cond"), "well_conditioned", "rank")


for _name, (_fn, _column, _sql) in FACTORS.items():
    QUERIES[f"la_{_name}"] = _factor(_fn, _column, len(_sql))
    ORACLES[f"la_{_name}"] = _S + "SELECT l_returnflag, " + ", ".join(f"round(CAST({x} AS DOUBLE), 5) + 0.0 AS x{k}" for k, x in enumerate(_sql)) + " FROM f"
QUERIES |= {"la_cond": _conditions, "red_compensated": _sums}
ORACLES |= {
    "la_cond": _S + "SELECT l_returnflag, round((1 + q + gap) / (1 + q - gap), 4) AS cond, true AS well_conditioned, 2.0 AS rank FROM f",
    "red_compensated": "SELECT round(fsum(l_extendedprice * 1e10 + l_tax) / 1e10, 4) AS total, round(fsum(l_quantity * l_extendedprice), 2) AS dot FROM lineitem",
}
