"""Personal data: values are replaced by format-preserving pseudonyms.

A found value is validated (Luhn for cards, modulo 97 for IBANs, the calendar for dates, the syntax of addresses, area rules for social
security numbers), then its number within its format is permuted by a keyed Feistel network and written back in the same
format, so equal values get equal pseudonyms in every document and a pseudonym is valid again. Letters and digits of mail
names, keys and passwords are permuted within their own kind (small, capital, digit) at their places. Values have no greatest length.

The network works on the integers below the format's size N: two unequal halves a x b >= N, rounds of keyed SHAKE-256, and cycle-walking
back below N, which keeps it a permutation of the format. Values of over 256 letters and digits are taken in pieces of 256, each
under a tweak made of the pieces before it.

What surrounds a value does not hide it: of a run of groups of digits or capitals every start and length is tried, the longest first, until one is valid (a card before its expiry date or check value, an IBAN before a
bank's code). A card of several groups, unless it is all that its run has from there, has three digits at least in each but the last; an IBAN is parted after every fourth character or nowhere.

Not looked for: names and postal addresses; mail addresses with hosts beyond ASCII; passwords within URLs; cards and IBANs glued to other digits or capitals; phone numbers that are bare digits without ``+``, brackets or separators; dates with days or months of one digit or
in words; hexadecimal keys outside of quotes and assignments; values of ``secret``, ``token`` and ``api_key`` that have neither a digit nor quotes.

Defined results: null stays null, empty stays empty, no value found leaves the text as it is. A text of any length is searched whole. Where two
kinds overlap, the first in KINDS wins. Repeated rows give equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import slices

ROUNDS = 10
#: Characters that one permutation takes at most.
PIECE = 256
#: Characters of a kind are permuted among themselves; the last two are the small and capital letters of Latin-1.
KINDS_OF_CHARACTERS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7),
)
HEXADECIMAL = ("0123456789abcdef",)


class Feistel:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permute(self, x: int, n: int, tweak: str) -> int:
        """x in [0, n) to another number there; a bijection for each n and tweak."""
        if n < 2:
            return x
        b = math.isqrt(n - 1) + 1
        a = -(-n // b)
        while True:
            left, right = divmod(x, b)
            for r in range(ROUNDS):
                if r % 2:
                    right = (right + self._round(r, left, n, tweak)) % b
                else:
                    left = (left + self._round(r, right, n, tweak)) % a
            x = left * b + right
            if x < n:
                return x

    def _round(self, r: int, half: int, n: int, tweak: str) -> int:
        size = max(16, (n.bit_length() + 7) // 8 + 8)
        seed = f"{tweak}|{n:x}|{r}|{half:x}".encode()
        return int.from_bytes(hashlib.shake_256(self.key + seed).digest(size), "big")

    def digits(self, s: str, tweak: str) -> str:
        return str(self.permute(int(s), 10 ** len(s), tweak)).zfill(len(s)) if s else s

    def classes(self, s: str, tweak: str, hexadecimal: bool = False) -> str:
        """Permute the letters and digits of s, each within its kind and at its place."""
        out = ""
        for at in range(0, len(s), PIECE):
            out += self._classes(s[at : at + PIECE], f"{tweak}|{hashlib.sha256(out.encode()).hexdigest()}" if at else tweak, hexadecimal)
        return out

    def _classes(self, s: str, tweak: str, hexadecimal: bool) -> str:
        sets = [next((k for k in (HEXADECIMAL if hexadecimal else KINDS_OF_CHARACTERS) if c in k), "") for c in s]
        x, n = 0, 1
        for c, k in zip(s, sets):
            if k:
                x, n = x * len(k) + k.index(c), n * len(k)
        y, out = self.permute(x, n, tweak), []
        for c, k in zip(reversed(s), reversed(sets)):
            if k:
                y, at = divmod(y, len(k))
                c = k[at]
            out.append(c)
        return "".join(reversed(out))


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _spread(form: str, digits: str) -> str:
    """The digits put in the places of the digits of form."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in form)


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def card(m: str, f: Feistel) -> str | None:
    d = _only_digits(m)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = d[0] + f.digits(d[1:-1], "card")
    return _spread(m, body + luhn_digit(body))


def phone(m: str, f: Feistel) -> str | None:
    d = _only_digits(m)
    if not (8 if m[0] == "+" else 10) <= len(d) <= 15:
        return None
    if len(d) < 10 or (m[0] == "+" and d[0] != "1"):  # the country's code stays, of unknown length: its first digit
        return _spread(m, d[0] + f.digits(d[1:], "phone-abroad"))
    head, local = d[:-10], d[-10:]
    if local[0] >= "2" and local[3] >= "2":
        area, exchange, line = int(local[:3]) - 200, int(local[3:6]) - 200, int(local[6:])
        y = f.permute((area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000, "phone")
        local = f"{y // 8_000_000 + 200}{y // 10_000 % 800 + 200}{y % 10_000:04d}"
    else:
        local = f.digits(local, "phone-any")
    return _spread(m, head + local)


def address(m: str, f: Feistel) -> str | None:
    parts = m.split(".")
    if any(len(p) > 3 or int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    y = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, y.to_bytes(4, "big")))


def address6(m: str, f: Feistel) -> str | None:
    if len(m) > 45 or not any("0" <= c <= "9" for c in m):
        return None
    try:
        x = int(ipaddress.IPv6Address(m))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(f.permute(x, 1 << 128, "ipv6"))) if x > 1 else None


def social(m: str, f: Feistel) -> str | None:
    a, g, s = m.split("-")
    if a in ("000", "666") or a >= "900" or g == "00" or s == "0000":
        return None
    areas = 898  # 001-899 without 666
    x = ((int(a) - 1 - (a > "666")) * 99 + int(g) - 1) * 9999 + int(s) - 1
    y, s_ = divmod(f.permute(x, areas * 99 * 9999, "ssn"), 9999)
    a_, g_ = divmod(y, 99)
    a_ = a_ + 1 + (a_ + 1 >= 666)
    return f"{a_:03d}-{g_ + 1:02d}-{s_ + 1:04d}"


def iban(m: str, f: Feistel) -> str | None:
    flat = m.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = f.classes(flat[4:], "iban")
    left = iter(flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(left) for c in m)


def _era(year: int) -> tuple[int, int]:
    """First and last day of the years whose dates are permuted among themselves: 1900 to 2099, else the century."""
    first, last = (1900, 2099) if 1900 <= year < 2100 else (max(1, year // 100 * 100), year // 100 * 100 + 99)
    return datetime.date(first, 1, 1).toordinal(), datetime.date(last, 12, 31).toordinal()


def date(m: str, f: Feistel) -> str | None:
    sep = next(c for c in m if not c.isdigit())
    parts = m.split(sep)
    orders = ("ymd",) if len(parts[0]) == 4 else ("mdy", "dmy") if sep == "/" else ("dmy",)
    for order in orders:
        v = dict(zip(order, map(int, parts)))
        try:
            day = datetime.date(v["y"], v["m"], v["d"]).toordinal()
        except ValueError:
            continue
        first, last = _era(v["y"])
        new = datetime.date.fromordinal(first + f.permute(day - first, last - first + 1, "date"))
        return sep.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[c] for c in order)
    return None


def email(m: str, f: Feistel) -> str | None:
    name, _, host = m.rpartition("@")
    return f"{f.classes(name, 'email|' + host.lower())}@{host}"


_ASSIGNED = re.compile(r"""(?s)(AKIA|[a-zA-Z_]+["']?\s*[:=]\s*["']?|)(.+)""")


def secret(m: str, f: Feistel) -> str | None:
    head, value = _ASSIGNED.fullmatch(m).groups()
    hexadecimal = re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) is not None and any("0" <= c <= "9" for c in value)
    if not hexadecimal:
        return head + f.classes(value, "secret")
    new = f.classes(value.lower(), "secret", hexadecimal=True)
    return head + (new if value == value.lower() else new.upper())


#: A value that is assigned: to the end of its word, without the sentence's punctuation.
_VALUE = r"""[^\s"',;<>]*[^\s"',;<>.:!?)]"""
_SECRETS = [
    r"\bAKIA[A-Z0-9]{16}\b", r'(?<=")(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?=")',
    rf"""\b(?i:password|passwd|pwd)["']?\s{{0,3}}[:=]\s{{0,3}}["']?(?=[^\s"',;<>]{{8}}){_VALUE}""",
]
_NAMED = re.compile(r"""\b(?i:secret|token|api_?key)["']?\s{0,3}[:=]\s{0,3}(["']?)""")
_RUN = re.compile(r"""[^\s"',;<>]*""")
_LAST_DIGIT = re.compile(r"(?s).*[0-9]")
#: kind, pattern, pseudonym (None: not valid, left alone). The first to match at a place wins. No pattern starts within a run that it could have started with.
KINDS: list[tuple[str, str, Callable[[str, Feistel], str | None]]] = [
    ("email", r"(?<![\w.%+\-])[\w.%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}+(?![A-Za-z0-9\-])", email),
    ("secret", "|".join(_SECRETS), secret),
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?: [A-Z0-9]++)*+\b", iban),
    (
        "date",
        r"(?<![0-9\-/.])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2})(?![0-9\-/]|\.[0-9])",
        date
    ),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])", address),
    ("ip6", r"(?<![\w:.])(?=[0-9A-Fa-f]*+:[0-9A-Fa-f]*+:)[0-9A-Fa-f:]++(?![\w:])", address6),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])", social),
    (
        "phone",
        r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9])",
        phone
    ),
    ("card", r"(?<![0-9])[0-9]++(?:[ \-][0-9]++)*+", card),
]
NAMES = [k for k, _, _ in KINDS]
_PATTERNS = [re.compile(p) for _, p, _ in KINDS]
Span = tuple[int, int, str]


def _named(text: str) -> Iterator[tuple[int, int]]:
    """Values that a name announces: after a quote, or with a digit. A run of characters is looked at once, however many names it holds."""
    end = last = value_end = taken = 0
    for m in _NAMED.finditer(text):
        at = m.end()
        if m.start() < taken:
            continue
        if at >= end or end == 0:
            end = _RUN.match(text, at).end()
            digit = _LAST_DIGIT.match(text, at, end)
            last = digit.end() - 1 if digit else -1
            value_end = at + len(text[at:end].rstrip(".:!?)"))
        if end - at >= 8 and value_end > at and (m[1] or last >= at):
            taken = value_end
            yield m.start(), value_end


def _secrets(text: str, value: Callable[[str], str | None]) -> Iterator[Span]:
    found = [m.span() for m in _PATTERNS[NAMES.index("secret")].finditer(text)] + list(_named(text))
    end = 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= end and (new := value(text[a:b])) is not None:
            end = b
            yield a, b, new


def _in_groups(pattern: re.Pattern, most: int, fits: Callable[[list[str], bool], bool]):
    """A finder of values that are groups of a run: all that are valid of each start and length, the longest of most characters first. Of those that overlap the first that no other kind crosses takes its place."""

    def find(text: str, value: Callable[[str], str | None]) -> Iterator[Span]:
        for m in pattern.finditer(text):
            groups = list(_GROUP.finditer(text, *m.span()))
            sizes = [g.end() - g.start() for g in groups]
            for i in range(len(groups)):
                j, total = i, 0
                while j < len(groups) and total + sizes[j] <= most:
                    total += sizes[j]
                    j += 1
                longest = j
                while j > i:
                    a, b = groups[i].start(), groups[j - 1].end()
                    if fits([g[0] for g in groups[i:j]], j == longest) and (new := value(text[a:b])) is not None:
                        yield a, b, new
                    j -= 1

    return find


def _card_groups(groups: list[str], longest: bool) -> bool:
    return sum(map(len, groups)) >= 13 and (longest or all(len(g) >= 3 for g in groups[:-1]))


def _iban_groups(groups: list[str], longest: bool) -> bool:
    return sum(map(len, groups)) >= 15 and _IBAN_HEAD.match(groups[0]) is not None and all(len(g) % 4 == 0 for g in groups[:-1])


_GROUP, _IBAN_HEAD = re.compile("[A-Z0-9]+"), re.compile("[A-Z]{2}[0-9]{2}")


def _each(pattern: re.Pattern):
    def find(text: str, value: Callable[[str], str | None]) -> Iterator[Span]:
        for m in pattern.finditer(text):
            if (new := value(m[0])) is not None:
                yield m.start(), m.end(), new

    return find


_FINDERS = [_each(p) for p in _PATTERNS]
_FINDERS[NAMES.index("secret")] = _secrets
_FINDERS[NAMES.index("iban")] = _in_groups(_PATTERNS[NAMES.index("iban")], 34, _iban_groups)
_FINDERS[NAMES.index("card")] = _in_groups(_PATTERNS[NAMES.index("card")], 19, _card_groups)
_HINT = re.compile("[0-9@:=]")


class Pseudonymizer:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.value = lru_cache(maxsize=50_000)(self._value)

    def _value(self, kind: int, found: str) -> str | None:
        return KINDS[kind][2](found, self.feistel)

    def __call__(self, text: str | None) -> tuple[str | None, list[int]]:
        """The text with pseudonyms, and how many values of each kind it had."""
        counts = [0] * len(KINDS)
        if not text or not _HINT.search(text):
            return text, counts
        spans: list[tuple[int, int, int, str]] = []
        for kind, find in enumerate(_FINDERS):
            if kind == 0 and "@" not in text:
                continue
            spans += [(kind, a, b, new) for a, b, new in find(text, partial(self.value, kind))]
        if not spans:
            return text, counts
        taken, out, end = [], [], 0
        starts: list[int] = []
        for kind, a, b, new in spans:  # in the order of kinds: an earlier kind keeps its place
            i = bisect.bisect_right(starts, a)
            if (i == 0 or taken[i - 1][2] <= a) and (i == len(taken) or taken[i][1] >= b):
                starts.insert(i, a)
                taken.insert(i, (kind, a, b, new))
        for kind, a, b, new in taken:
            out += [text[end:a], new]
            end = b
            counts[kind] += 1
        return "".join([*out, text[end:]]), counts


def pseudonymize(docs: DataFrame, secret_key: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with pseudonyms, n_values, and n_<kind> for each of KINDS."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = rows.select("*").schema.add("n_values", "integer")
    for name in NAMES:
        schema = schema.add(f"n_{name}", "integer")

    def run(batches):
        change = Pseudonymizer(secret_key)
        for batch in slices(batches, "text"):
            found = [change(t) for t in batch.column("text").to_pylist()]
            counts = [c for _, c in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), pa.array([t for t, _ in found], pa.string()), pa.array([sum(c) for c in counts], pa.int32()),
                    *(pa.array([c[i] for c in counts], pa.int32()) for i in range(len(KINDS)))
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key).withColumnRenamed("text", text)
