"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation within each value's format.

Kinds: e-mail addresses, phone numbers, IPv4 addresses, payment cards (Luhn), IBANs (mod 97), US social security
numbers, dates, and secrets (access key ids, values after password, token or key).  A value is replaced only if it is
valid for its kind.  The permutation depends on key and kind alone, so equal values get equal pseudonyms in all
documents and different values of a format different ones; lengths, separators and check digits stay valid.  Decimal
digits of any script count by their value, and those put in their places are of the same script.  The
permutation is one step along a keyed cycle through all values of the format, so that none stays as it is.

Phone numbers are North American ones with separators, French ones in five pairs, and those with + and a country code
whose number of digits the code allows.  Days and months have one or two digits.  Values after password, passwd, pwd,
token, secret or api key (any case) follow = or :, at most one blank on either side, and a quote or none; after a colon
without a quote those of the last three need a digit.  Left out, since nothing tells them from other numbers or words:
phone numbers without separators or country code, other national forms, dates with month names or two-digit years.
"""
from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


class Permutation:
    """Keyed bijections of numbers below a bound and of strings over an alphabet."""

    def __init__(self, key: bytes, kind: str):
        self.key, self.kind = hashlib.blake2b(key, digest_size=32).digest(), kind.encode()

    def _noise(self, turn: int, size: int, other: int) -> int:
        message = b"%s|%d|%d|%d" % (self.kind, turn, size, other)
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=16).digest(), "big")

    def pair(self, left: int, right: int, a: int, b: int) -> tuple[int, int]:
        """Feistel network on (left below a, right below b)."""
        for turn in range(0, ROUNDS, 2):
            left = (left + self._noise(turn, a * b, right)) % a
            right = (right + self._noise(turn + 1, a * b, left)) % b
        return left, right

    def unpair(self, left: int, right: int, a: int, b: int) -> tuple[int, int]:
        """What ``pair`` leads to (left, right) from."""
        for turn in range(ROUNDS - 2, -2, -2):
            right = (right - self._noise(turn + 1, a * b, left)) % b
            left = (left - self._noise(turn, a * b, right)) % a
        return left, right

    def cycle(self, value: int, a: int, b: int) -> int:
        """One step along a keyed cycle through range(a * b): the Feistel network leads to a place, one is added, and
        the network leads back.  A permutation without a fixed point."""
        left, right = self.pair(value // b, value % b, a, b)
        left, right = self.unpair(*divmod((left * b + right + 1) % (a * b), b), a, b)
        return left * b + right

    def number(self, value: int, bound: int) -> int:
        """A permutation of range(bound): the cycle of the smallest grid that holds it, walked until inside."""
        a = max(1, int(bound ** 0.5))
        b = -(-bound // a)
        while True:
            value = self.cycle(value, a + (a * b < bound), b)
            if value < bound:
                return value

    def text(self, value: str, alphabet: str) -> str:
        """A permutation of the strings of this length over ``alphabet``."""
        r, n = len(alphabet), len(value)
        number = 0
        for c in value:
            number = number * r + alphabet.index(c)
        low = n // 2
        number, out = self.cycle(number, r ** (n - low), r**low), []
        for _ in range(n):
            number, k = divmod(number, r)
            out.append(alphabet[k])
        return "".join(reversed(out))


_FOREIGN = re.compile(r"[^\D0-9]+")


def _decimal(text: str) -> str:
    """``text`` with its decimal digits of all scripts as 0-9; places stay."""
    return text if text.isascii() else _FOREIGN.sub(lambda m: "".join(str(int(c)) for c in m.group()), text)


def _as_written(new: str, old: str) -> str:
    """``new`` with its digits in the scripts of ``old``: place by place, or that of the first digit if lengths differ."""
    zeros = [ord(c) - int(c) if c.isdecimal() else ord("0") for c in old]
    if len(new) != len(old):
        zeros = [next(z for c, z in zip(old, zeros) if c.isdecimal())] * len(new)
    return "".join(chr(z + int(c)) if c in DIGITS else c for c, z in zip(new, zeros))


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


AMERICAN = r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"


def _by_class(p: Permutation, value: str) -> str:
    """Lower-case letters, upper-case letters and digits permuted, each among themselves, in their places."""
    for alphabet in (LOWER, UPPER, DIGITS):
        own = "".join(c for c in value if c in alphabet)
        new = iter(p.text(own, alphabet) if own else "")
        value = "".join(next(new) if c in alphabet else c for c in value)
    return value


def email(p: Permutation, value: str) -> str | None:
    name, _, top = value.rpartition(".")
    return f"{_by_class(p, name)}.{top}"


#: Fixed value: digits after each country code; a code with one of the heads below has three digits, and 6 to 12 follow.
NATIONAL = {(10, 10): "1 7 30 52 58 90 91 98", (9, 9): "27 31 33 34 40 41 48 56 61 66 93 94 351 380 420 421", (8, 8): "45 47 65", (8, 9): "32 36 51 971 972", (9, 10): "44 81 84 92",
            (8, 10): "20 57 60 63 64 82", (7, 10): "46 95 353", (10, 11): "54 55 86", (6, 11): "39 358", (6, 13): "43 49", (8, 12): "62", (6, 8): "53"}
LONG_CODES = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99"


def _country_numbers() -> str:
    """The pattern of + with a country code and as many digits as it allows, two separators at most before each."""
    known = {c for codes in NATIONAL.values() for c in codes.split()}
    other = [f"{head}{k}" for head in LONG_CODES.split() for k in range(10) if f"{head}{k}" not in known]
    forms = [*((codes.split(), low, high) for (low, high), codes in NATIONAL.items()), (other, 6, 12)]
    each = "|".join(rf"(?:{'|'.join(codes)})(?: ?\(0\))?(?:[ ./()-]{{0,2}}\d){{{low},{high}}}" for codes, low, high in forms)
    return rf"(?<![\w+])\+(?:{each})(?![0-9A-Za-z])"


_COUNTRY = re.compile(rf"\+({'|'.join(sorted((c for codes in NATIONAL.values() for c in codes.split()), key=len, reverse=True))}|\d{{3}})(?: ?\(0\))?")


def phone(p: Permutation, value: str) -> str | None:
    if not re.fullmatch(AMERICAN, value):
        head = _COUNTRY.match(value)
        shape = value[head.end():] if head else value[1:]
        digits = re.sub(r"\D", "", shape)
        own = Permutation(p.key, f"{p.kind.decode()} {head[1] if head else 0}")
        return value[:len(value) - len(shape)] + _fill(shape, own.text(digits, DIGITS))
    head = re.match(r"\+?1[ .-]?(?=\D*\d{3})", value)
    rest = value[head.end():] if head else value
    digits = re.sub(r"\D", "", rest)
    return value[:len(value) - len(rest)] + _fill(rest, p.text(digits, DIGITS)) if len(digits) == 10 else None


def ipv4(p: Permutation, value: str) -> str | None:
    parts = value.split(".")
    if any(int(x) > 255 or x != str(int(x)) for x in parts):
        return None
    n = p.number(int.from_bytes(bytes(map(int, parts)), "big"), 2**32)
    return ".".join(map(str, n.to_bytes(4, "big")))


def card(p: Permutation, value: str) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not luhn(digits):
        return None
    body = digits[0] + p.text(digits[1:-1], DIGITS)       # the leading digit names the kind of card
    return _fill(value, body + next(c for c in DIGITS if luhn(body + c)))


def iban(p: Permutation, value: str) -> str | None:
    flat = value.replace(" ", "")
    as_number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if as_number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _by_class(p, flat[4:])
    out = iter(f"{flat[:2]}{98 - as_number(body + flat[:2] + '00') % 97:02d}{body}")
    return "".join(next(out) if c != " " else c for c in value)


def ssn(p: Permutation, value: str) -> str | None:
    def valid(x: str) -> bool:
        return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
    digits = value.replace("-", "")
    if not valid(digits):
        return None
    digits = p.text(digits, DIGITS)
    while not valid(digits):            # the cycle leads back to a valid number
        digits = p.text(digits, DIGITS)
    return _fill(value, digits)


def date(p: Permutation, value: str) -> str | None:
    parts = re.split(r"([-/.])", value)
    year_first = len(parts[0]) == 4
    y, m, d = (parts[0], parts[2], parts[4]) if year_first else (parts[4], parts[2], parts[0])
    if not year_first and int(m) > 12:  # month first
        m, d, parts = d, m, [*parts, "us"]
    try:
        day = dt.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = dt.date.fromordinal(FIRST_DAY + p.number(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
    short = 1 in (len(m), len(d))
    month, day_of = (f"{x:0{1 if short and was[0] != '0' else 2}d}" for x, was in ((new.month, m), (new.day, d)))
    order = [str(new.year), month, day_of] if year_first else [day_of, month, str(new.year)]
    if parts[-1] == "us":
        order = [month, day_of, str(new.year)]
    return parts[1].join(order)


def secret(p: Permutation, value: str) -> str | None:
    head, body = (value[:4], value[4:]) if re.fullmatch(r"AKIA[0-9A-Z]+", value) else ("", value)
    if head:
        return head + p.text(body, DIGITS + UPPER)
    return p.text(body, HEX) if set(body) <= set(HEX) else _by_class(p, body)


def _lead_ins() -> str:
    """Look-behinds for what stands before a secret; the first rules most places out."""
    marks = [f"{a}[=:]{b}" for a in ("", " ") for b in ("", " ")]
    before = lambda names, tails: "|".join(f"(?<={name}{tail})" for name in names for tail in tails)
    words, keys = ["password", "passwd", "pwd"], ["token", "secret", "apikey", "api[_ -]key"]
    quoted = [f"{m}[\"']" for m in marks]
    any_value = "|".join([before(words, [*marks, *quoted]), before(keys, [*(m.replace("[=:]", "=") for m in marks), *quoted])])
    return rf"(?:(?<=[=:])|(?<=[=:] )|(?<=[=:][\"'])|(?<=[=:] [\"']))(?i:{any_value}|(?:{before(keys, [m.replace('[=:]', ':') for m in marks])})(?=[A-Za-z_\-]*[0-9]))[0-9A-Za-z_\-]{{6,}}"


#: Kind, what replaces it, and its pattern; earlier ones win where two begin together.
KINDS: tuple[tuple[str, Callable, str], ...] = (
    ("secret", secret, r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|" + _lead_ins()),
    ("email", email, r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("iban", iban, r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("card", card, r"(?<![0-9A-Za-z.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![0-9A-Za-z])"),
    ("phone", phone, rf"(?<![0-9A-Za-z]){AMERICAN}(?![0-9A-Za-z])|{_country_numbers()}|" + r"(?<![0-9A-Za-z+.-])0[1-9](?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4})(?![0-9A-Za-z]|[.-]\d)"),
    ("ssn", ssn, r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])"),
    ("date", date, r"(?<![0-9A-Za-z.-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![0-9A-Za-z-]|\.\d)"),
    ("ipv4", ipv4, r"(?<![0-9A-Za-z.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.\d)"),
)


class Pseudonyms:
    """Finds and replaces values under one key."""

    def __init__(self, key: bytes):
        self.kinds = {kind: (make, Permutation(key, kind)) for kind, make, _ in KINDS}
        self.patterns = [(kind, re.compile(pattern).match) for kind, _, pattern in KINDS]
        self.find = re.compile("|".join(f"(?:{_named(pattern, kind)})" for kind, _, pattern in KINDS)).search
        self.hint = re.compile(r"[0-9@]|AKIA|(?i:passw|pwd|token|secret|api[_ -]?key)").search      # one is in every value or before it

    def value(self, kind: str, text: str) -> str | None:
        """The pseudonym; None if ``text`` is not valid for the kind."""
        make, p = self.kinds[kind]
        plain = _decimal(text)
        new = make(p, plain)
        return new if new is None or plain == text else _as_written(new, text)

    def _valid(self, plain: str, text: str, at: int):
        """(kind, end, pseudonym) of the kinds with a valid value at this place; ``plain`` is ``text`` in digits 0-9."""
        for kind, match in self.patterns:
            if (m := match(plain, at)) and (new := self.value(kind, text[at:m.end()])) is not None:
                yield kind, m.end(), new

    def text(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """(text with pseudonyms, (kind, begin, end) of the values in the given text, by code points)."""
        if not text:
            return text, []
        plain = _decimal(text)
        if not self.hint(plain):
            return text, []
        out, spans, at, m = [], [], 0, self.find(plain)
        while m:
            found = next((x for x in self._valid(plain, text, m.start())), None)
            if found:
                kind, end, new = found
                out += [text[at:m.start()], new]
                spans.append((kind, m.start(), end))
                at = end
            m = self.find(plain, at if found else m.start() + 1)
        return "".join([*out, text[at:]]), spans


def _named(pattern: str, kind: str) -> str:
    """A pattern whose separator groups have names, so that patterns can be joined."""
    for k in (1, 2):
        for separators in ("([-/.])", "([ -])"):
            if separators in pattern and rf"\{k}" in pattern:
                pattern = pattern.replace(separators, f"(?P<{kind}{k}>{separators[1:-1]})", 1).replace(rf"\{k}", f"(?P={kind}{k})")
                break
    return pattern


_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("pii", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def pseudonymized(text: Column, key: bytes) -> Column:
    """struct(text, pii: array of (kind, begin, end)) for a text column; a null text stays null with no spans."""
    made: dict[int, Pseudonyms] = {}

    @F.pandas_udf(_SCHEMA)
    def replace(values: pd.Series) -> pd.DataFrame:
        own = made.setdefault(0, Pseudonyms(key))
        found = [own.text(x) for x in values]
        return pd.DataFrame({"text": [t for t, _ in found], "pii": [[{"kind": k, "begin": a, "end": b} for k, a, b in spans] for _, spans in found]})

    return replace(text.cast("string"))


def pseudonymize(documents: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``documents`` with its text column replaced and a column ``pii`` of what was found, in a row each.

    A null text stays null, an empty text empty, both with an empty ``pii``; repeated rows get equal results; other
    columns are kept (one named ``pii`` is replaced); an empty table gives an empty result.
    """
    return documents.withColumn(text, pseudonymized(F.col(f"`{text}`"), key)).withColumns({"pii": F.col(f"`{text}`.pii"), text: F.col(f"`{text}`.text")})
