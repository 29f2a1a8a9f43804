"""Personal data replaced by format-preserving pseudonyms.

A value that passes its kind's validation is mapped by a keyed permutation
of all values of the same format (a Feistel network over the format's index,
walked until it falls inside), so it keeps its length, separators and check
digits, is different under another key, and equal values get equal
pseudonyms in every document.  The work is one pass, without a shuffle.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches

ROUNDS = 10
DEFAULT_KEY = b"set your own key"

#: Candidate shapes, tried in this order at each place; validation follows.
SHAPES = re.compile(r"""(?x)
  (?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
 |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
 |(?<![\d])(?<!\d[.\-])(?:
     (?P<phone>\+\d{1,3}[\x20.-]?(?:\(\d{2,4}\)|\d{2,4})(?:[\x20.-]?\d{2,4}){2,3}|\(\d{3}\)\x20?\d{3}[\x20.-]\d{4}|\d{3}([.-])\d{3}\4\d{4})
    |(?P<card>\d{13,19}|\d{4}([\x20-])\d{4}\6\d{4}\6\d{1,7}|\d{4}([\x20-])\d{6}\7\d{4,5})
    |(?P<ssn>\d{3}-\d{2}-\d{4})
    |(?P<date>\d{4}([-/.])\d{2}\10\d{2}|\d{1,2}([-/.])\d{1,2}\11\d{4})
    |(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})
  )(?![\d])(?!\.\d)
""")
NUMBER_OR_AT = re.compile(r"[0-9@]")


class Feistel:
    """Keyed permutations of range(n), for any n and tweak."""

    def __init__(self, key: bytes):
        self.key = key[:64]

    def _f(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        out, n = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(tweak + bytes([i, n]) + half.to_bytes(size, "big"), key=self.key, digest_size=64).digest()
            n += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: str) -> int:
        if n < 2:
            return x
        bits = ((n - 1).bit_length() + 1) // 2
        t = f"{tweak}/{n}/".encode()
        while True:  # cycle-walking: at most 4 walks on average
            left, right = x >> bits, x & ((1 << bits) - 1)
            for i in range(ROUNDS):
                left, right = right, left ^ self._f(t, i, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def characters(self, s: str, tweak: str) -> str:
        """Permute the letters and digits of ``s`` within their classes."""
        n, x, sizes = 1, 0, []
        for c in s:
            size, base = _class(c)
            sizes.append((size, base))
            x = x * size + (ord(c) - base)
            n *= size
        y = self.permute(x, n, tweak + "/" + "".join({10: "d", 26: "a", 1: "."}[k] for k, _ in sizes))
        out = []
        for size, base in reversed(sizes):
            out.append(chr(base + y % size))
            y //= size
        return "".join(reversed(out))


def _class(c: str) -> tuple[int, int]:
    if "0" <= c <= "9":
        return 10, 48
    if "a" <= c <= "z":
        return 26, 97
    if "A" <= c <= "Z":
        return 26, 65
    return 1, ord(c)


def luhn_digit(body: str) -> str:
    """Check digit that makes body + digit valid."""
    s = 0
    for i, c in enumerate(reversed(body)):
        d = int(c)
        s += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return str(-s % 10)


def _refill(shape: str, chars: str, keep: Callable[[str], bool]) -> str:
    it = iter(chars)
    return "".join(next(it) if keep(c) else c for c in shape)


def _iban_number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))


def _card(v, f):
    d = re.sub(r"\D", "", v)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = f.characters(d[:-1], "card")
    return _refill(v, body + luhn_digit(body), str.isdigit)


def _phone(v, f):
    d = re.sub(r"\D", "", v)
    if not 10 <= len(d) <= 15:
        return None
    code = re.match(r"\+(\d{1,3})(?=[\x20.(-])", v)
    head = code[1] if code else ""  # the country code stays
    return _refill(v, head + f.characters(d[len(head):], "phone"), str.isdigit)


def _ssn(v, f):
    a, b, c = int(v[:3]), int(v[4:6]), int(v[7:])
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    y = f.permute(((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1, len(areas) * 99 * 9999, "ssn")
    y, c = divmod(y, 9999)
    a, b = divmod(y, 99)
    return f"{areas[a]:03d}-{b + 1:02d}-{c + 1:04d}"


_FIRST = dt.date(1900, 1, 1).toordinal()
_DAYS = dt.date(2099, 12, 31).toordinal() - _FIRST + 1


def _date(v, f):
    a, sep, b, c = re.match(r"(\d+)(\D)(\d+)\D(\d+)", v).groups()
    iso = len(a) == 4
    y, m, d = (int(a), int(b), int(c)) if iso else (int(c), int(b), int(a))
    swapped = not iso and m > 12  # month first
    if swapped:
        m, d = d, m
    try:
        day = dt.date(y, m, d).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    n = dt.date.fromordinal(_FIRST + f.permute(day, _DAYS, "date"))
    if iso:
        return f"{n.year}{sep}{n.month:02d}{sep}{n.day:02d}"
    x, z = (n.month, n.day) if swapped else (n.day, n.month)
    return f"{x:0{len(a)}d}{sep}{z:0{len(b)}d}{sep}{n.year}"


def _ip(v, f):
    p = [int(x) for x in v.split(".")]
    if max(p) > 255:
        return None
    y = f.permute(int.from_bytes(bytes(p), "big"), 1 << 32, "ip")
    return ".".join(map(str, y.to_bytes(4, "big")))


def _iban(v, f):
    s = v.replace(" ", "")
    if not 15 <= len(s) <= 34 or _iban_number(s) % 97 != 1:
        return None
    body = f.characters(s[4:], "iban")
    check = 98 - _iban_number(s[:2] + "00" + body) % 97
    return _refill(v, f"{s[:2]}{check:02d}{body}", str.isalnum)


def _email(v, f):
    head, _, top = v.rpartition(".")
    low = head.lower()  # equal addresses in any case stay linked
    return f.characters(low, "email") + "." + top


KINDS = {"email": _email, "iban": _iban, "phone": _phone, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip}


def pseudonyms(text: str, f: Feistel) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of the values in the original (code points)."""
    out, found, at, pos = [], [], 0, 0
    while m := SHAPES.search(text, pos):
        new = KINDS[m.lastgroup](m.group(), f)
        if new is None:  # not valid: go on inside it
            pos = m.start() + 1
            continue
        out += [text[at:m.start()], new]
        found.append((m.lastgroup, m.start(), m.end()))
        at = pos = m.end()
    return "".join(out) + text[at:], found


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, text_col: str = "text") -> DataFrame:
    """All rows of ``docs``; ``text_col`` holds the text with pseudonyms, and
    ``n_found`` (long) and ``found`` (kind:start:end in the original,
    comma-joined) are added, replacing columns of those names.

    Null text stays null with 0 found; texts without a valid value are
    unchanged; repeated rows get equal results; an empty table gives no rows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = Feistel(key)
        for texts in batches:
            rows = []
            for t in texts:
                if not t or not NUMBER_OR_AT.search(t):
                    rows.append((t, 0, ""))
                    continue
                new, found = pseudonyms(t, f)
                rows.append((new, len(found), ",".join(f"{k}:{s}:{e}" for k, s, e in found)))
            yield pd.DataFrame(rows, columns=["t", "n", "f"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, "t string, n long, f string")
    tmp = "_pii"
    while tmp in docs.columns:
        tmp = "_" + tmp
    keep = [c for c in docs.columns if c not in ("n_found", "found")]
    return docs.withColumn(tmp, udf(F.col(text_col))).select(
        *[F.col(f"{tmp}.t").alias(c) if c == text_col else F.col(f"`{c}`") for c in keep],
        F.col(f"{tmp}.n").alias("n_found"), F.col(f"{tmp}.f").alias("found"))
