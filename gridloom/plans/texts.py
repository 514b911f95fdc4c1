"""Registered queries of strings, regular expressions, times, containers and tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import containers as ct
from ..functions import strings as fs
from ..functions import times as ft
from ..operators import linalg as la
from .elementwise import table


START = "array_to_string(list_transform(range(1, len(string_split(text, 'enen'))), lambda k: length(array_to_string(string_split(text, 'enen')[1:k], 'enen')) + 1), ',')"
END = "array_to_string(list_transform(range(1, len(string_split(text, 'enen'))), lambda k: length(array_to_string(string_split(text, 'enen')[1:k], 'enen')) + 4), ',')"
#: name: (makes a Column of documents, SQL of it).
DOCUMENTS = {
    "strlength": (lambda: fs.strlength(F.col("text")), "CAST(strlen(text) AS DOUBLE)"),
    "upper": (lambda: F.md5(fs.upper(F.col("text"))), "md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'))"),
    "lower": (lambda: F.md5(fs.lower(F.col("text"))), "md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"),
    "contains": (lambda: fs.contains(F.col("text"), "tion"), "CASE WHEN contains(text, 'tion') THEN 1.0 ELSE 0.0 END"),
    "startswith": (lambda: fs.starts_with(F.col("text"), "The"), "CASE WHEN starts_with(text, 'The') THEN 1.0 ELSE 0.0 END"),
    "endswith": (lambda: fs.ends_with(F.col("text"), "."), "CASE WHEN ends_with(text, '.') THEN 1.0 ELSE 0.0 END"),
    "strrep": (lambda: F.md5(fs.strrep(F.col("text"), "the", "<THE>")), "md5(replace(text, 'the', '<THE>'))"),
    "replace_first": (lambda: F.md5(fs.replace(F.col("text"), "the", "<THE>")), "md5(CASE WHEN position('the' IN text) > 0 THEN substr(text, 1, position('the' IN text) - 1) || '<THE>' || substr(text, position('the' IN text) + 3) ELSE text END)"),
    "strfind": (lambda: F.concat_ws(",", F.transform(fs.strfind(F.col("text"), "enen"), lambda i: i.cast("string"))), "coalesce(nullif(array_to_string(list_filter(range(1, length(text) - 2), lambda i: substr(text, i, 4) = 'enen'), ','), ''), '0')"),
    "strtrim": (lambda: F.md5(fs.strtrim(F.concat(F.lit(" \t\n"), F.col("text"), F.lit(" \r\n")))), "md5(trim(text, ' ' || chr(9) || chr(10) || chr(13)))"),
    "reverse": (lambda: F.md5(fs.reverse(F.translate(F.col("text"), "ß", "s"))), "md5(array_to_string(list_reverse(string_split(replace(text, 'ß', 's'), '')), ''))"),
    "extract_before": (lambda: fs.extract_before(F.col("text"), 12), "CASE WHEN length(text) < 12 THEN '' ELSE substr(text, 1, 11) END"),
    "extract_after": (lambda: F.md5(fs.extract_after(F.col("text"), 12)), "md5(CASE WHEN length(text) <= 12 THEN '' ELSE substr(text, 13) END)"),
    "extract_between": (lambda: fs.extract_between(F.col("text"), 5, 15), "CASE WHEN length(text) < 15 THEN '' ELSE substr(text, 5, 11) END"),
    "split": (lambda: F.size(fs.split(F.col("text"), ". ")).cast("long"), "len(string_split(text, '. '))"),
    "strjoin": (lambda: F.md5(fs.strjoin(fs.strsplit(F.col("text")), "_")), "md5(array_to_string(string_split(text, ' '), '_'))"),
    "isletter": (lambda: F.size(F.filter(fs.isletter(F.col("text")), lambda b: b)).cast("long"), "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"),
    "isspace": (lambda: F.size(F.filter(fs.isspace(F.col("text")), lambda b: b)).cast("long"), "length(regexp_replace(text, '[^ \\t\\n\\v\\f\\r]', '', 'g'))"),
    "rx_match_email": (lambda: F.concat_ws(",", fs.regexp(F.col("text"), fs.PATTERNS["email"])), r"array_to_string(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), ',')"),
    "rx_match_ip": (lambda: F.concat_ws(",", fs.regexp(F.col("text"), fs.PATTERNS["ip"])), r"array_to_string(regexp_extract_all(text, '(?:[0-9]{1,3}\.){3}[0-9]{1,3}'), ',')"),
    "rx_numbers": (lambda: F.concat_ws(",", fs.regexp(F.col("text"), fs.PATTERNS["number"])), r"array_to_string(regexp_extract_all(text, '-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?'), ',')"),
    "rx_split_ws": (lambda: F.size(fs.regexp(F.col("text"), r"[ \n]+", "split")).cast("long"), r"len(string_split_regex(text, '[ \n]+'))"),
    "rx_replace": (lambda: F.md5(fs.regexprep(F.col("text"), "([aeiou])n", "<$1>")), r"md5(regexp_replace(text, '([aeiou])n', '<\1>', 'g'))"),
    "rx_icase": (lambda: F.size(fs.regexpi(F.col("text"), "th[ae]")).cast("long"), "len(regexp_extract_all(text, '(?i)th[ae]'))"),
    "rx_tokens": (lambda: F.concat_ws(",", F.transform(fs.regexp(F.col("text"), r"(\d+)@(\w+)", "tokens"), lambda x: F.concat_ws(":", x))), r"array_to_string(list_transform(regexp_extract_all(text, '([0-9]+)@([a-zA-Z0-9_]+)'), lambda x: replace(x, '@', ':')), ',')"),
    "rx_start": (lambda: F.concat_ws(",", F.transform(fs.regexp(F.col("text"), "enen", "start"), lambda i: i.cast("string"))), START),
    "rx_end": (lambda: F.concat_ws(",", F.transform(fs.regexp(F.col("text"), "enen", "end"), lambda i: i.cast("string"))), END),
    "rx_translate": (lambda: F.md5(fs.regexptranslate(F.substring(F.col("text"), 1, 10**9))), r"md5(regexp_replace(text, '([.^$*+?(){}\[\]|\\])', '\\\1', 'g'))"),
    "sscanf": (lambda: F.size(fs.sscanf(F.col("text"))).cast("long"), r"len(list_filter(regexp_extract_all(text, '[^ \t\n\v\f\r]+'), lambda w: regexp_matches(w, '^[+-]?([0-9]|\.[0-9])')))"),
    "strcmp": (lambda: fs.strcmp(F.col("lang"), "en"), "lang = 'en'"),
    "strcmpi": (lambda: fs.strcmpi(F.col("source"), "SRC1"), "lower(source) = 'src1'"),
    "strcat": (lambda: fs.strcat(F.col("lang"), "-", F.col("n_chars"), numeric=(2,)), "lang || '-' || n_chars || '.000000'"),
    "sprintf": (lambda: fs.sprintf("%s has %d characters, %5.2f k", F.col("source"), F.col("n_chars"), F.col("n_chars") / 7.0), "source || ' has ' || n_chars || ' characters, ' || printf('%5.2f', n_chars / 7.0) || ' k'"),
    "char_codes": (lambda: fs.char(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("doc_id") % 26 + 65 + k)), "chr(CAST(doc_id % 26 + 65 AS INTEGER)) || chr(CAST(doc_id % 26 + 66 AS INTEGER)) || chr(CAST(doc_id % 26 + 67 AS INTEGER)) || chr(CAST(doc_id % 26 + 68 AS INTEGER)) || chr(CAST(doc_id % 26 + 69 AS INTEGER))"),
    "char_rows": (lambda: F.concat_ws("|", fs.char_rows(F.col("lang"), F.col("source"))), "rpad(lang, CAST(greatest(length(lang), length(source)) AS INTEGER), ' ') || '|' || rpad(source, CAST(greatest(length(lang), length(source)) AS INTEGER), ' ')"),
    "char_transpose": (lambda: F.concat_ws("|", fs.char_transpose(F.array(F.substring("source", 1, 4), F.lit("abcd")))), "substr(source, 1, 1) || 'a|' || substr(source, 2, 1) || 'b|' || substr(source, 3, 1) || 'c|' || substr(source, 4, 1) || 'd'"),
}
#: name: (makes a Column of orders, SQL of it).
ORDERS = {
    "dt_add_days": (lambda: ft.text(ft.add(F.col("o_orderdate").cast("timestamp_ntz"), ft.days((F.col("o_orderkey") % 1000)))), "strftime(date_trunc('second', o_orderdate) + to_days(CAST(o_orderkey % 1000 AS INTEGER)), '%Y-%m-%d %H:%M:%S')"),
    "dt_add_hours": (lambda: ft.text(ft.add(F.col("o_orderdate").cast("timestamp_ntz"), ft.hours((F.col("o_orderkey") % 1000)) + ft.minutes(7) + ft.seconds(5))), "strftime(date_trunc('second', o_orderdate) + to_seconds(CAST((o_orderkey % 1000) * 3600 + 425 AS BIGINT)), '%Y-%m-%d %H:%M:%S')"),
    "dt_subtract_years": (lambda: ft.text(ft.subtract(F.col("o_orderdate").cast("timestamp_ntz"), ft.years(40))), "strftime(date_trunc('second', o_orderdate) - to_seconds(1262304000), '%Y-%m-%d %H:%M:%S')"),
    "dt_diff_seconds": (lambda: ft.between(F.col("o_orderdate").cast("timestamp_ntz"), ft.datetime("1970-01-01 12:00:00")), "CAST(epoch(date_trunc('second', o_orderdate)) - 43200 AS DOUBLE)"),
    "dt_parse": (lambda: ft.text(ft.datetime(F.date_format(F.col("o_orderdate"), "yyyy-MM-dd"))), "strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00'"),
    "dt_months": (lambda: ft.months((F.col("o_orderkey") % 1000)), "CAST((o_orderkey % 1000) * 2630016.0 AS DOUBLE)"),
    "num2str": (lambda: fs.num2str(F.col("o_totalprice") / 4), "regexp_replace(regexp_replace(printf('%.6f', o_totalprice / 4), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"),
    "str2num": (lambda: fs.str2num(F.concat(F.round(F.col("o_totalprice"), 2).cast("string"), F.lit("abc"))), "o_totalprice"),
    "join_numbers": (lambda: fs.join_numbers(F.array((F.col("o_orderkey") % 1000).cast("double"), F.lit(2.5)), ";"), "(o_orderkey % 1000) || '.000000;2.500000'"),
    "ct_struct": (lambda: F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")).withField("k", F.col("o_orderkey") * 2)["k"], "o_orderkey * 2"),
    "ct_cell": (lambda: F.concat_ws("|", ct.cell_get(ct.cell(F.col("o_orderkey"), F.col("o_orderstatus"), 2.5), 2), ct.cell_get(ct.cell_put(ct.cell(F.col("o_orderkey")), 4, F.col("o_orderstatus")), 4)), "o_orderstatus || '|' || o_orderstatus"),
}


def _column(name: str, key: str, column) -> object:
    return lambda spark, sf_dir: table(spark, sf_dir, name).select(key, column().alias("y"))


def map_query(spark, sf_dir: str) -> DataFrame:
    """Maps of each conversation's roles to their number of turns."""
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    m = counts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("role", "n"))).alias("e")).select("conv_id", ct.make_map(F.col("e.role"), F.col("e.n")).alias("m"))
    return m.select(
        "conv_id", F.concat_ws(",", ct.keys(F.col("m"))).alias("keys"), F.concat_ws(",", F.transform(ct.values(F.col("m")), lambda v: v.cast("string"))).alias("vals"),
        ct.is_key(F.col("m"), "user").alias("has_user"), F.size(ct.remove(F.col("m"), "user")).cast("long").alias("left_over"), ct.lookup(F.col("m"), "user").alias("user_turns"),
    )


MAP_SQL = """
WITH c AS (SELECT conv_id, role, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2)
SELECT conv_id, string_agg(role, ',' ORDER BY role) AS keys, string_agg(CAST(n AS VARCHAR), ',' ORDER BY role) AS vals,
  CASE WHEN count(*) FILTER (role = 'user') > 0 THEN 1.0 ELSE 0.0 END AS has_user, count(*) FILTER (role <> 'user') AS left_over,
  max(n) FILTER (role = 'user') AS user_turns FROM c GROUP BY conv_id
"""


def categories(spark, sf_dir: str) -> DataFrame:
    return ct.categorical(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id").select("event_id", "event_type", "code")


def category_list(spark, sf_dir: str) -> DataFrame:
    return ct.categories(table(spark, sf_dir, "events"), "event_type", "event_id")


def add_row(spark, sf_dir: str) -> DataFrame:
    return ct.add_row(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), 99, "NOWHERE", 1)


def remove_row(spark, sf_dir: str) -> DataFrame:
    return ct.remove_row(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 5, "c_custkey")


def get_row(spark, sf_dir: str) -> DataFrame:
    return ct.get_row(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 5, "c_custkey")


def set_value(spark, sf_dir: str) -> DataFrame:
    return ct.set_value(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 5, "c_acctbal", 1.25, "c_custkey").drop("_row")


def height(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return ct.height(t).withColumn("width", F.lit(ct.width(t)).cast("long"))


def _normal_equations(spark, sf_dir: str) -> DataFrame:
    """Per return flag: A'A and A'b of price ~ [1, quantity, discount], packed."""
    x = F.array(F.lit(1.0), F.col("l_quantity") / 10, F.col("l_discount") * 10)
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", x.alias("x"), (F.col("l_extendedprice") / 10000).alias("b"))
    sums = [F.sum(F.col("x")[i] * F.col("x")[j]) / F.count("*") for i in range(3) for j in range(3)]
    rhs = [F.sum(F.col("x")[i] * F.col("b")) / F.count("*") for i in range(3)]
    return rows.groupBy("l_returnflag").agg(la.packed(3, 3, F.array(*sums)).alias("a"), la.packed(3, 1, F.array(*rhs)).alias("b"))


def solve_groups(spark, sf_dir: str) -> DataFrame:
    out = la.with_solve(_normal_equations(spark, sf_dir), "a", "b")
    return out.select("l_returnflag", *(F.round(F.col("x.data")[k], 5).alias(f"x{k}") for k in range(3)))


def det_groups(spark, sf_dir: str) -> DataFrame:
    out = la.with_det(_normal_equations(spark, sf_dir), "a")
    m = [F.col("a.data")[k] for k in range(9)]
    return out.select("l_returnflag", F.round("det", 6).alias("det"), F.round(la.det3(m), 6).alias("closed"))


def invariants(spark, sf_dir: str) -> DataFrame:
    """Per group the largest deviations of P A = L U, Q R = A, U S V' = A, R' R = A, A V = V D and A inv(A) = I: all near zero."""
    import numpy as np

    def deviations(a):
        low, up, p = la.lu(a)
        q, r = la.qr(a)
        u, s, v = la.svd(a)
        c, (w, d) = la.chol(a), la.eig(a)
        pairs = [(p @ a, low @ up), (q @ r, a), (u @ s @ v.T, a), (c.T @ c, a), (a @ w, w @ d), (a @ la.inverse(a), np.eye(len(a)))]
        return tuple(float(np.abs(x - y).max() < 1e-6) for x, y in pairs) + (la.rank(a),)

    names = ["lu", "qr", "svd", "chol", "eig", "inv", "rank"]
    return la.apply_packed(_normal_equations(spark, sf_dir), deviations, ["a"], dict.fromkeys(names, "double")).select("l_returnflag", *names)


def tall_values(spark, sf_dir: str) -> DataFrame:
    """Sums of squares and of fourth powers of the singular values, their number, and whether they fall; and the values of two columns."""
    rows = table(spark, sf_dir, "embeddings")
    two = la.tall_singular_values(rows.select(F.slice("embedding", 1, 2).alias("x")), "x", 2).groupBy().pivot("k", [0, 1]).agg(F.round(F.first("s"), 5))
    out = la.tall_singular_values(rows, "embedding", 64)
    s2 = F.col("s") * F.col("s")
    out = out.agg(F.round(F.sum(s2), 5).alias("sum_squares"), F.round(F.sum(s2 * s2) / F.sum(s2), 5).alias("fourths"), F.count("*").alias("n"))
    return out.join(two.withColumnsRenamed({"0": "s0", "1": "s1"}))


def tall_fit(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.array(F.lit(1.0), F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("b"))
    out = la.tall_least_squares(rows, "x", "b", 2)
    return out.select(F.round(F.col("x.data")[0], 5).alias("x0"), F.round(F.col("x.data")[1], 5).alias("x1"))


NORMAL_SQL = "WITH t AS (SELECT l_returnflag, l_quantity / 10 AS x1, l_discount * 10 AS x2, l_extendedprice / 10000 AS b FROM lineitem), m AS (SELECT l_returnflag, avg(x1) AS a1, avg(x2) AS a2, avg(x1 * x1) AS a11, avg(x1 * x2) AS a12, avg(x2 * x2) AS a22, avg(b) AS b0, avg(x1 * b) AS b1, avg(x2 * b) AS b2 FROM t GROUP BY 1), d AS (SELECT *, a11 * a22 - a12 * a12 - a1 * (a1 * a22 - a12 * a2) + a2 * (a1 * a12 - a11 * a2) AS det FROM m) "
QUERIES = {}
ORACLES = {
    "ct_map": MAP_SQL,
    "cat_codes": "WITH f AS (SELECT event_type, min(event_id) AS a FROM events GROUP BY 1), c AS (SELECT event_type, row_number() OVER (ORDER BY a) - 1 AS code FROM f) SELECT event_id, event_type, code FROM events JOIN c USING (event_type)",
    "cat_list": "SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type",
    "tbl_addrow": "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NOWHERE', 1",
    "tbl_removerow": "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey <> (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 1 OFFSET 4)",
    "tbl_getrow": "SELECT c_custkey, c_acctbal FROM customer ORDER BY 1 LIMIT 1 OFFSET 4",
    "tbl_setvalue": "SELECT c_custkey, CASE WHEN c_custkey = (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 1 OFFSET 4) THEN 1.25 ELSE c_acctbal END AS c_acctbal FROM customer",
    "tbl_height": "SELECT count(*) AS height, 11 AS width FROM lineitem",
    "la_det3": NORMAL_SQL + "SELECT l_returnflag, round(det, 6) AS det, round(det, 6) AS closed FROM d",
    "la_solve3": NORMAL_SQL + """SELECT l_returnflag,
      round((b0 * (a11 * a22 - a12 * a12) - a1 * (b1 * a22 - a12 * b2) + a2 * (b1 * a12 - a11 * b2)) / det, 5) AS x0,
      round(((b1 * a22 - a12 * b2) - b0 * (a1 * a22 - a12 * a2) + a2 * (a1 * b2 - b1 * a2)) / det, 5) AS x1,
      round(((a11 * b2 - b1 * a12) - a1 * (a1 * b2 - b1 * a2) + b0 * (a1 * a12 - a11 * a2)) / det, 5) AS x2 FROM d""",
    "la_invariants": "SELECT DISTINCT l_returnflag, 1.0 AS lu, 1.0 AS qr, 1.0 AS svd, 1.0 AS chol, 1.0 AS eig, 1.0 AS inv, 3.0 AS rank FROM lineitem",
    "la_tall_svd": """WITH e AS (SELECT vec_id AS i, generate_subscripts(embedding, 1) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
      g AS (SELECT a.j AS p, b.j AS q, sum(a.v * b.v) AS v FROM e a JOIN e b USING (i) GROUP BY 1, 2),
      t AS (SELECT sum(v) FILTER (p = 1 AND q = 1) AS a, sum(v) FILTER (p = 1 AND q = 2) AS b, sum(v) FILTER (p = 2 AND q = 2) AS d FROM g)
      SELECT round((SELECT sum(v) FROM g WHERE p = q), 5) AS sum_squares, round((SELECT sum(v * v) / sum(v) FILTER (p = q) FROM g), 5) AS fourths, 64 AS n,
        round(sqrt((a + d + sqrt((a - d) * (a - d) + 4 * b * b)) / 2), 5) AS s0, round(sqrt((a + d - sqrt((a - d) * (a - d) + 4 * b * b)) / 2), 5) AS s1 FROM t""",
    "la_tall_least_squares": "SELECT round(regr_intercept(l_extendedprice / 10000, l_quantity / 10), 5) AS x0, round(regr_slope(l_extendedprice / 10000, l_quantity / 10), 5) AS x1 FROM lineitem",
}
for _n, _f in (("ct_map", map_query), ("cat_codes", categories), ("cat_list", category_list), ("tbl_addrow", add_row), ("tbl_removerow", remove_row), ("tbl_getrow", get_row), ("tbl_setvalue", set_value), ("tbl_height", height), ("la_det3", det_groups), ("la_solve3", solve_groups), ("la_invariants", invariants), ("la_tall_svd", tall_values), ("la_tall_least_squares", tall_fit)):
    QUERIES[_n] = _f
for _n, (_c, _sql) in DOCUMENTS.items():
    _name = _n if _n.startswith("rx_") else f"str_{_n}"
    QUERIES[_name], ORACLES[_name] = _column("documents", "doc_id", _c), f"SELECT doc_id, {_sql} AS y FROM documents"
for _n, (_c, _sql) in ORDERS.items():
    _name = _n if _n[:3] in ("dt_", "ct_") else f"str_{_n}"
    QUERIES[_name], ORACLES[_name] = _column("orders", "o_orderkey", _c), f"SELECT o_orderkey, {_sql} AS y FROM orders"
