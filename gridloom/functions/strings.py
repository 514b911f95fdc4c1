"""Strings: Column -> Column. Positions count from 1; lengths in bytes where parity asks for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of the pattern library.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "url": r"https?://[a-zA-Z0-9.-]+(?:/[\w./?%&=-]*)?",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}",
    "phone": r"\+?\d{1,3}[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    "date": r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}",
    "time": r"\d{1,2}:\d{2}(?::\d{2})?",
    "number": r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?",
    "word": r"\b\w+\b",
    "whitespace": r"\s+",
}
#: Java's way to write the number that a C reader takes from the front of a text.
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def num_text(x) -> Column:
    """A number inside a concatenation: six decimals."""
    return F.format_string("%.6f", _c(x).cast("double"))


def strcat(*parts, numeric: tuple[int, ...] = ()) -> Column:
    """Parts joined; those at the places in `numeric` are numbers."""
    return F.concat(*(num_text(p) if i in numeric else _c(p) for i, p in enumerate(parts)))


strcmp = lambda a, b: F.coalesce(_c(a) == _c(b), F.lit(False))
strcmpi = lambda a, b: F.coalesce(F.lower(_c(a)) == F.lower(_c(b)), F.lit(False))


def strfind(s, p) -> Column:
    """Start positions of p in s, overlaps included; array(0) if there is none."""
    s, p = _c(s), _c(p)
    last = F.length(s) - F.length(p) + 1
    every = F.when(last >= 1, F.filter(F.sequence(F.lit(1), last), lambda i: F.substring(s, i, F.length(p)) == p)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit(0)))


def strrep(s, old, new) -> Column:
    """All occurrences; an empty `old` gives s back."""
    return F.when(_c(old) == "", _c(s)).otherwise(F.replace(_c(s), _c(old), _c(new)))


def replace(s, old, new) -> Column:
    """The first occurrence only."""
    s, old = _c(s), _c(old)
    at = F.position(old, s)
    return F.when((at > 0) & (old != ""), F.overlay(s, _c(new), at, F.length(old))).otherwise(s)


strtrim = lambda s: F.btrim(_c(s), F.lit(" \t\n\r"))


def num2str(x) -> Column:
    """Six decimals without trailing zeros and point."""
    return F.regexp_replace(F.regexp_replace(num_text(x), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def str2num(s) -> Column:
    """The number at the front of s, 0 if there is none."""
    return F.coalesce(F.regexp_extract(_c(s), NUMBER_PREFIX, 1).try_cast("double"), F.lit(0.0))


starts_with = lambda s, p: F.startswith(_c(s), _c(p)).cast("double")
ends_with = lambda s, p: F.endswith(_c(s), _c(p)).cast("double")
contains = lambda s, p: F.contains(_c(s), _c(p)).cast("double")
join = lambda parts, d="": F.array_join(parts, d)
strjoin = join


def join_numbers(values: Column, d: str) -> Column:
    return F.array_join(F.transform(values, num_text), d)


def split(s, d: str) -> Column:
    """Parts between a literal delimiter, empty ones included."""
    return F.split(_c(s), r"\Q" + d.replace(r"\E", r"\E\\E\Q") + r"\E", -1)


strsplit = lambda s, d=" ": split(s, d)
extract_before = lambda s, pos: F.when((_c(pos) < 1) | (_c(pos) > F.length(_c(s))), "").otherwise(F.substring(_c(s), F.lit(1), _c(pos) - 1))
extract_after = lambda s, pos: F.when((_c(pos) < 1) | (_c(pos) >= F.length(_c(s))), "").otherwise(F.substr(_c(s), _c(pos) + 1))


def extract_between(s, a, b) -> Column:
    """Characters a to b; '' if that is no stretch of s."""
    s, a, b = _c(s), _c(a), _c(b)
    return F.when((a < 1) | (b < a) | (b > F.length(s)), "").otherwise(F.substring(s, a, b - a + 1))


reverse = lambda s: F.reverse(_c(s))
upper = lambda s: F.translate(_c(s), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
lower = lambda s: F.translate(_c(s), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
strlength = lambda s: F.octet_length(_c(s)).cast("double")


def sprintf(fmt: str, *args) -> Column:
    """A C format: whole-number conversions cast to long, others to double, %s to string; width and precision count."""
    import re

    out, cast, kinds = [], list(args), re.findall(r"%[-+ 0#]*\d*(?:\.\d+)?([diuoxXeEfgGcs%])", fmt)
    values = iter(cast)
    for k in kinds:
        if k == "%":
            continue
        v = _c(next(values))
        out.append(v.cast("long") if k in "diuoxX" else v.cast("double") if k in "eEfgG" else F.char(v.cast("int")) if k == "c" and not isinstance(v, str) else v.cast("string"))
    java = re.sub(r"(%[-+ 0#]*\d*(?:\.\d+)?)[iu]", r"\1d", fmt)
    java = re.sub(r"(%[-+ 0#]*\d*(?:\.\d+)?)c", r"\1s", java).replace("\\n", "\n").replace("\\t", "\t")
    return F.format_string(java, *out)


def sscanf(s) -> Column:
    """Numbers among the white-space separated tokens of s."""
    tokens = F.regexp_extract_all(_c(s), F.lit(r"(\S+)"), 1)
    return F.filter(F.transform(tokens, lambda t: F.regexp_extract(t, NUMBER_PREFIX, 1).try_cast("double")), lambda v: v.isNotNull())


characters = lambda s: F.filter(F.split(_c(s), ""), lambda c: c != "")
isletter = lambda s: F.transform(characters(s), lambda c: c.rlike("^[A-Za-z]$"))
isspace = lambda s: F.transform(characters(s), lambda c: c.rlike(r"^[ \t\n\x0b\f\r]$"))


def char(codes: Column) -> Column:
    """Characters of an array of codes."""
    return F.array_join(F.transform(codes, lambda c: F.char(c.cast("long"))), "")


def char_rows(*texts) -> Column:
    """Texts padded with spaces to the longest."""
    every = F.array(*map(_c, texts))
    width = F.array_max(F.transform(every, F.length))
    return F.transform(every, lambda t: F.rpad(t, width, F.lit(" ")))


def char_transpose(rows: Column) -> Column:
    """Rows of equal length turned into columns."""
    width = F.coalesce(F.length(F.get(rows, F.lit(0))), F.lit(0))
    return F.when(width == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: F.array_join(F.transform(rows, lambda r: F.substring(r, i, F.lit(1))), "")))


char_vertcat = lambda a, b: F.concat(a, b)
char_horzcat = lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y))
char_equals = lambda a, b: F.coalesce(a == b, F.lit(False))


# Regular expressions (Java's dialect).


def regexp(s, pattern: str, option: str = "match") -> Column:
    """match: array of matches; tokens: array of arrays of groups; split; start and end: positions from 1, end included."""
    s = _c(s)
    if option == "match":
        return F.regexp_extract_all(s, F.lit(pattern), 0)
    if option == "split":
        return F.split(s, pattern, -1)
    if option == "tokens":
        import re

        n = re.compile(pattern.replace("(?i)", "")).groups
        if not n:
            return F.transform(regexp(s, pattern), lambda m: F.array(m))
        groups = [F.regexp_extract_all(s, F.lit(pattern), k) for k in range(1, n + 1)]
        return F.transform(F.arrays_zip(*(g.alias(f"g{i}") for i, g in enumerate(groups))), lambda z: F.array(*(z[f"g{i}"] for i in range(n))))
    if option in ("start", "end"):
        # Matches and the text between them alternate: positions are running lengths.
        between, found = F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), 0)
        ends = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.aggregate(F.slice(between, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)))
        starts = F.zip_with(ends, found, lambda e, m: e - F.length(m) + 1)
        return F.when(F.size(found) > 0, ends if option == "end" else starts).otherwise(F.array().cast("array<int>"))
    raise ValueError(f"unknown option {option}")


regexpi = lambda s, pattern, option="match": regexp(s, "(?i)" + pattern, option)


def regexprep(s, pattern: str, new: str) -> Column:
    """All matches; $1 and $& in `new` stand for groups and the match."""
    return F.regexp_replace(_c(s), pattern, new.replace("$&", "$0"))


def regexptranslate(s) -> Column:
    """Metacharacters escaped."""
    return F.regexp_replace(_c(s), r"([.^$*+?(){}\[\]|\\])", r"\\$1")


def regexpattern(kind: str) -> str:
    if kind not in PATTERNS:
        raise ValueError(f"unknown pattern {kind}; known: {', '.join(PATTERNS)}")
    return PATTERNS[kind]
