"""Operator 9, format-preserving Feistel pseudonyms for personal data.

Found and validated: payment card numbers (13 to 19 digits with a correct check digit), IBANs (mod 97), social security numbers,
phone numbers, IPv4 addresses, calendar dates, e-mail addresses and 32 to 64 digit hexadecimal secrets after a key word. A value is
permuted by a keyed Feistel network over the numbers of its own format (with cycle walking), and written back in that format:
a card stays a card of its length with a right check digit, an IBAN keeps its country and the places of its letters and digits, a
phone number its calling code, a date stays a date, an address an address. The permutation depends on
the value and key alone, so equal values stay linked across documents however they are written, and unequal values stay apart.
Numbers that fail validation stay as they are. A card, IBAN or phone number that runs on into other text ends at the last separator
up to which it is valid and cuts no other value.

Defined results: a null text stays null with no finds; an empty text stays empty; overlapping kinds go to the first in the order
above at the leftmost place; rows that repeat a doc_id are treated each; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructType, _parse_datatype_string

from .common import fresh, slices

#: The key of the registered query; a real corpus takes its own secret.
KEY = "gridloom-demo-key"
ROUNDS = 10
KINDS = ("email", "iban", "secret", "ipv4", "date", "ssn", "phone", "card")

FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9_%+\-](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9_%+\-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<secret>(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[0-9A-Fa-f]{32,64}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ipv4>(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9]))"
    r"|(?P<date>(?<![0-9/.\-])(?:[0-9]{4}(?P<s1>[-/.])[0-9]{1,2}(?P=s1)[0-9]{1,2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4})(?![0-9]|[/.\-][0-9]))"
    r"|(?P<ssn>(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))"
    r"|(?P<phone>(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9]|-[0-9])|(?<![0-9+])\+[0-9](?:[ .\-]?[0-9]){7,16}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}[ .\-]?\([0-9]{1,4}\)(?:[ .\-]?[0-9]){4,13}(?![0-9]))"
    r"|(?P<card>(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9]))",
    re.ASCII,
)
#: A text without these has nothing to find.
MAY = re.compile(r"[0-9@]")
NUMBER = re.compile("[0-9]+")
#: Calling codes of one and of two digits; all others have three.
CALLING_1 = {"1", "7"}
CALLING_2 = {
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55",
    "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network on the next even number of bits, walked until inside."""

    def __init__(self, size: int, kind: str, key: str):
        self.size = size
        half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
        self.half, self.mask = half, (1 << half) - 1
        self.seed = hashlib.blake2b(f"{kind}:{size}".encode(), key=hashlib.sha256(key.encode()).digest(), digest_size=32).digest()

    def _mix(self, r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes((self.half + 7) // 8, "little"), key=self.seed, salt=bytes([r]), digest_size=32).digest(), "little") & self.mask

    def _once(self, x: int, rounds) -> int:
        a, b = x >> self.half, x & self.mask
        for r in rounds:
            a, b = b, a ^ self._mix(r, b)
        return (b << self.half) | a

    def forward(self, x: int) -> int:
        x = self._once(x, range(ROUNDS))
        while x >= self.size:
            x = self._once(x, range(ROUNDS))
        return x

    def back(self, x: int) -> int:
        x = self._once(x, reversed(range(ROUNDS)))
        while x >= self.size:
            x = self._once(x, reversed(range(ROUNDS)))
        return x


@lru_cache(maxsize=512)
def network(size: int, kind: str, key: str) -> Feistel:
    return Feistel(size, kind, key)


def luhn_digit(body: str) -> int:
    """Check digit of the digits before it."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def put_digits(pattern: str, digits: str) -> str:
    """pattern with its digits replaced, in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def permuted(number: str, kind: str, key: str, back: bool) -> str:
    net = network(10 ** len(number), kind, key)
    return str((net.back if back else net.forward)(int(number))).zfill(len(number))


def in_alphabet(text: str, alphabet: str, kind: str, key: str, back: bool) -> str:
    """A string over an alphabet, permuted among those of its length."""
    n, base = 0, len(alphabet)
    for c in text:
        n = n * base + alphabet.index(c)
    net = network(base ** len(text), kind, key)
    n = (net.back if back else net.forward)(n)
    out = []
    for _ in text:
        n, r = divmod(n, base)
        out.append(alphabet[r])
    return "".join(reversed(out))


def card(s: str, key: str, back: bool) -> str | None:
    digits = re.sub("[ -]", "", s)
    if luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = permuted(digits[:-1], "card", key, back)
    return put_digits(s, body + str(luhn_digit(body)))


def iban(s: str, key: str, back: bool) -> str | None:
    raw = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(raw) <= 34 or number(raw[4:] + raw[:4]) % 97 != 1:
        return None
    body = by_kind(raw[4:], "iban:" + "".join("a" if c.isalpha() else "9" for c in raw[4:]), key, back)
    it = iter(f"{raw[:2]}{98 - number(body + raw[:2] + '00') % 97:02d}{body}")
    return "".join(" " if c == " " else next(it) for c in s)


def ipv4(s: str, key: str, back: bool) -> str | None:
    parts = list(map(int, s.split(".")))
    if max(parts) > 255:
        return None
    net = network(1 << 32, "ipv4", key)
    n = (net.back if back else net.forward)(int.from_bytes(bytes(parts), "big"))
    return ".".join(map(str, n.to_bytes(4, "big")))


def date(s: str, key: str, back: bool) -> str | None:
    """Year first, or day and month in the order that is a date (day first if both are)."""
    sep = re.search("[-/.]", s).group()
    a, b, c = s.split(sep)
    year_first = len(a) == 4
    for order in (("ymd",) if year_first else ("dmy", "mdy")):
        part = dict(zip(order, map(int, (a, b, c)), strict=True))
        try:
            day = datetime.date(part["y"], part["m"], part["d"]).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        net = network(LAST_DAY - FIRST_DAY + 1, "date", key)
        new = datetime.date.fromordinal(FIRST_DAY + (net.back if back else net.forward)(day - FIRST_DAY))
        return sep.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[k] for k in order)
    return None


def ssn(s: str, key: str, back: bool) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [*range(1, 666), *range(667, 900)]
    net = network(len(areas) * 99 * 9999, "ssn", key)
    n = (net.back if back else net.forward)((areas.index(area) * 99 + group - 1) * 9999 + serial - 1)
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def phone(s: str, key: str, back: bool) -> str | None:
    """The calling code stays, and a trunk zero in brackets behind it; the national digits are permuted, however they are grouped."""
    at = 0
    if s[0] == "+":
        digits = re.sub("[^0-9]", "", s[:8])
        code = next((digits[:k] for k, codes in ((1, CALLING_1), (2, CALLING_2)) if digits[:k] in codes), digits[:3])
        left = len(code)
        for at, c in enumerate(s, 1):
            left -= c.isdigit()
            if not left:
                break
        if m := re.compile(r"[ .\-]?\(0\)").match(s, at):
            at = m.end()
    digits = re.sub("[^0-9]", "", s[at:])
    if not 7 <= len(digits) <= 14:
        return None
    return s[:at] + put_digits(s[at:], permuted(digits, "phone", key, back))


def by_kind(text: str, label: str, key: str, back: bool) -> str:
    """Text with its ASCII letters (in one case) permuted as letters and its digits as digits, each at its own place. One permutation
    over all of them together, so that equal shapes with unequal parts stay apart."""
    base = "a" if text.islower() else "A"
    letters, digits = "".join(c for c in text if c.isalpha()), "".join(c for c in text if c.isdigit())
    net = network(26 ** len(letters) * 10 ** len(digits), label, key)
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - ord(base)
    n = n * 10 ** len(digits) + int(digits or 0)
    n, d = divmod((net.back if back else net.forward)(n), 10 ** len(digits))
    out = []
    for _ in letters:
        n, r = divmod(n, 26)
        out.append(chr(ord(base) + r))
    a, b = iter(reversed(out)), iter(str(d).zfill(len(digits)) if digits else "")
    return "".join(next(a) if c.isalpha() else next(b) if c.isdigit() else c for c in text)


def email(s: str, key: str, back: bool) -> str | None:
    """Letters of the local part by letters, digits by digits; domain and punctuation stay. Case is not kept. A local part without
    letters and digits is the only one of its format and stays."""
    local, _, domain = s.rpartition("@")
    low = local.lower()
    kinds = "".join("a" if c.isalpha() else "9" if c.isdigit() else c for c in low)
    return by_kind(low, f"email:{kinds}:{domain.lower()}", key, back) + "@" + domain


def secret(s: str, key: str, back: bool) -> str | None:
    """The hexadecimal digits, in the case in which they stand."""
    m = re.search(r"[0-9A-Fa-f]{32,64}$", s)
    raw = m.group()
    new = in_alphabet(raw.lower(), "0123456789abcdef", "secret", key, back)
    return s[: m.start()] + (new.upper() if raw.upper() == raw else new)


TREAT = {"email": email, "iban": iban, "secret": secret, "ipv4": ipv4, "date": date, "ssn": ssn, "phone": phone, "card": card}


#: Kinds whose pattern may take in what stands behind a value, and the characters at which it then ends.
ENDS = {"card": " -", "iban": " ", "phone": " .-"}


def kind_of(m: re.Match) -> str:
    return m.lastgroup if m.lastgroup in TREAT else "date"


def digit_count(s: str) -> int:
    return sum(c.isdigit() for c in s)


def cuts_another(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a span ends inside another value that begins at one of its separators; of two cards the longer goes first."""
    for q in range(start + 1, end):
        if text[q - 1] in ENDS[kind] and (m := FIND.match(text, q)):
            other = kind_of(m)
            if other in ("card", "ipv4", "date", "ssn") and m.end() > end:
                stop = next((e for e, _ in valid_spans(text, m, "", False) if e > end), None)
                if stop and (other != "card" or kind != "card" or digit_count(text[q:stop]) > digit_count(text[start:end])):
                    return True
    return False


def valid_spans(text: str, m: re.Match, key: str, back: bool) -> Iterator[tuple[int, str]]:
    """(end, pseudonym) of the values that pass validation at the start of a match, longest first: all of it or up to a separator."""
    kind, start = kind_of(m), m.start()
    shorter = (e for e in range(m.end() - 1, start, -1) if text[e] in ENDS.get(kind, ""))
    for e in (m.end(), *shorter):
        if kind == "card" and e < m.end() and digit_count(text[start:e]) < 13 or not text[e - 1].isalnum():
            continue
        new = TREAT[kind](text[start:e], key, back)
        if new is not None:
            yield e, new


def treated(text: str, m: re.Match, key: str, back: bool) -> tuple[int, str | None]:
    """(end, pseudonym) of the longest valid value at a match that cuts no other, or (end of the match, None)."""
    for e, new in valid_spans(text, m, key, back):
        if kind_of(m) not in ENDS or not cuts_another(text, kind_of(m), m.start(), e):
            return e, new
    return m.end(), None


def pseudonymise(text: str, key: str, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with pseudonyms, finds as (start, end, kind) in the text given). back undoes it with the same key."""
    if not MAY.search(text):
        return text, []
    found: list[tuple[int, int, str]] = []
    out, done, at = [], 0, 0
    while m := FIND.search(text, at):
        kind = kind_of(m)
        end, new = treated(text, m, key, back)
        at = end if new is not None else m.start() + 1
        if new is None and kind not in ("card", "iban"):
            at = m.end() if kind == "ipv4" else m.start() + 1
        if new is None and text[m.start()].isdigit():  # go on behind this number, not inside it
            at = NUMBER.match(text, m.start()).end()
        if new is not None:
            found.append((m.start(), end, kind))
            out += [text[done : m.start()], new]
            done = end
    return "".join([*out, text[done:]]), found


def treat_batches(key: str, column: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            at = batch.schema.get_field_index(column)
            missing, done = batch.column(at).is_null().to_pylist(), 0
            for part in slices(batch, column):
                new, number, spans = [], [], []
                for t, none in zip(part.column(at).to_pylist(), missing[done : done + part.num_rows], strict=True):
                    text, found = (None, []) if none else pseudonymise(t, key)
                    new.append(text)
                    number.append(len(found))
                    spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                done += part.num_rows
                columns = [c if i != at else pa.array(new, pa.string()) for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int32()), pa.array(spans, kinds)], names)

    return run


def pseudonymise_documents(docs: DataFrame, key: str = KEY, column: str = "text") -> DataFrame:
    """docs with pseudonyms in the text column, and _n_pii and _pii (finds in the text as it was), which take more underscores where
    docs has such columns (see `fresh`)."""
    number, finds = fresh("_n_pii", docs), fresh("_pii", docs)
    schema = StructType([*docs.schema.fields]).add(number, IntegerType()).add(finds, _parse_datatype_string("array<struct<start:int,end:int,kind:string>>"))
    return docs.mapInArrow(treat_batches(key, column, [*docs.columns, number, finds]), schema)


def op9_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise_documents(docs).withColumnsRenamed({"_n_pii": "n_pii", "_pii": "pii"})
