"""Format-preserving pseudonyms for personal data.

Method: each kind of value is found by its form and validated, read as a number below the count of valid values of that
form, permuted by a keyed Feistel network (with cycle walking, so that it stays a permutation of just these values) and
written back in the same form. Equal values get equal pseudonyms in every document, so links survive; the key alone
leads back, see :func:`Pseudonyms.undo`.

Kinds: payment cards (13 to 19 digits, Luhn), IBANs (mod 97), US social security numbers (valid areas), telephone numbers in
international or bracketed form (up to three stray marks between their parts are taken along), IPv4 addresses, calendar dates of 1900-2099 in year-first, day-first with dots, or
month-first with slashes, and the local part of e-mail addresses. Separators, lengths, letter case, check digits
and country prefixes stay. Numbers that fail validation are left alone.

One Arrow pass over whole texts; nothing is shuffled.

Defined results: null and empty texts come back as they are with no findings; where kinds overlap, the first found
from the left wins, longer forms before shorter; repeated rows are treated alike; an empty table gives no rows; further
columns are ignored by :func:`pseudonymise_documents`.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import small

#: The session's setting that holds the key; there is no default.
KEY_CONF = "spark.turnwise.pii.key"
ROUNDS = 8
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
SCHEMA = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string"

_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY

# Forms by kind, in order of precedence where several start at the same place. Each must stand alone: no letter, digit or
# joined part at either side.
_FORM = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?=[A-Za-z0-9.-]{3,255}(?![A-Za-z0-9-]))(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])(?:(?:\+[0-9]{1,3}[^\w\s(+]{0,3}[\x20.-]?)?\([0-9]{2,4}\)[^\w\s]{0,3}[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,5})(?![\w-])",
    "card": r"(?<![\w.-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\w-])",
    "ip": r"(?<![\w.-])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w-]|\.[0-9])",
    "date": r"(?<![\w./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![\w/-])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
}
_SINGLE = {kind: re.compile(form) for kind, form in _FORM.items()}
_FORMS = re.compile("|".join(_FORM.values()))
# Every form holds a digit beside another digit, a bracket or a separator, or an at sign; most texts hold neither.
_MAYBE = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _refill(form: str, chars: str) -> str:
    """``form`` with its digits replaced by ``chars``, in order."""
    it = iter(chars)
    return "".join([next(it) if c.isdigit() else c for c in form])


class Pseudonyms:
    """Keyed permutations of the valid values of each kind."""

    def __init__(self, key: str, cache: int = 200_000):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.known: dict[tuple[str, str], str | None] = {}
        self.cache = cache

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        h = hashlib.blake2b(half.to_bytes((bits + 7) // 8 + 1, "big") + bytes([i]) + tweak, key=self.key, digest_size=(bits + 7) // 8 + 8)
        return int.from_bytes(h.digest(), "big") & ((1 << bits) - 1)

    def permute(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """A permutation of range(size): a balanced Feistel network over the next even number of bits, walked until inside."""
        if size < 2:
            return value
        bits = (max(2, (size - 1).bit_length()) + 1) // 2
        mask, t = (1 << bits) - 1, tweak.encode()
        while True:
            left, right = value >> bits, value & mask
            if back:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(t, i, left, bits), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ self._round(t, i, right, bits)
            value = left << bits | right
            if value < size:
                return value

    def card(self, form: str, back: bool = False) -> str | None:
        """All digits but the check digit are permuted; it is computed anew."""
        digits = re.sub(r"\D", "", form)
        if not 13 <= len(digits) <= 19 or not luhn(digits) or not digits.strip("0"):
            return None
        n = len(digits) - 1
        body = str(self.permute(int(digits[:-1]), 10**n, f"card{n}", back)).zfill(n)
        return _refill(form, body + next(c for c in "0123456789" if luhn(body + c)))

    def iban(self, form: str, back: bool = False) -> str | None:
        """The digits of the account part are permuted; country and letters stay, check digits are computed anew."""
        text = form.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(text) <= 34 or number(text[4:] + text[:4]) % 97 != 1:
            return None
        places = [i for i, c in enumerate(text) if i >= 4 and c.isdigit()]
        if not places:
            return None
        shape = text[:2] + "".join("#" if c.isdigit() else c for c in text[4:])
        new = iter(str(self.permute(int("".join(text[i] for i in places)), 10 ** len(places), "iban" + shape, back)).zfill(len(places)))
        body = "".join(next(new) if c.isdigit() else c for c in text[4:])
        check = str(98 - number(body + text[:2] + "00") % 97).zfill(2)
        it = iter(text[:2] + check + body)
        return "".join(" " if c == " " else next(it) for c in form)

    def ssn(self, form: str, back: bool = False) -> str | None:
        area, group, serial = map(int, form.split("-"))
        if area in (0, 666) or area >= 900 or group == 0 or serial == 0:
            return None
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(self.permute(value, 898 * 99 * 9999, "ssn", back), 9999)
        area, group = divmod(value, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, form: str, back: bool = False) -> str | None:
        """The digits after the country prefix are permuted."""
        m = re.match(r"\+[0-9]{1,3}(?![0-9])|\+[0-9]", form)
        prefix, rest = (m[0], form[m.end() :]) if m else ("", form)
        digits = re.sub(r"\D", "", rest)
        if not 7 <= len(digits) <= 14:
            return None
        new = self.permute(int(digits), 10 ** len(digits), f"phone{prefix}/{len(digits)}", back)
        return prefix + _refill(rest, str(new).zfill(len(digits)))

    def ip(self, form: str, back: bool = False) -> str | None:
        parts = form.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = self.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, form: str, back: bool = False) -> str | None:
        sep = form[2] if form[2] in "./" else "-"
        a, b, c = map(int, form.split(sep))
        y, m, d = {"-": (a, b, c), ".": (c, b, a), "/": (c, a, b)}[sep]
        try:
            day = datetime.date(y, m, d).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        new = datetime.date.fromordinal(self.permute(day, _DAYS, "date", back) + _FIRST_DAY)
        return new.strftime({"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%m/%d/%Y"}[sep])

    def email(self, form: str, back: bool = False) -> str | None:
        """Each letter and digit of the local part stays one of its class; the domain stays."""
        local, _, domain = form.partition("@")
        value, size = 0, 1
        radix = [(10, 48) if c.isdigit() else (26, 97) if c.islower() else (26, 65) if c.isupper() else (1, ord(c)) for c in local]
        for c, (r, base) in zip(local, radix, strict=True):
            value, size = value * r + ord(c) - base, size * r
        shape = "".join("d" if r == 10 else "a" if base == 97 else "A" if base == 65 else chr(base) for r, base in radix)
        value, out = self.permute(value, size, f"email{shape}@{domain.lower()}", back), []
        for r, base in reversed(radix):
            value, digit = divmod(value, r)
            out.append(chr(base + digit))
        return "".join(reversed(out)) + "@" + domain

    def swap(self, kind: str, form: str, back: bool = False) -> str | None:
        """The pseudonym of a value, or None if it isn't valid; ``back`` undoes it."""
        if back:
            return getattr(self, kind)(form, True)
        key = (kind, form)
        if key not in self.known:
            if len(self.known) >= self.cache:
                self.known.clear()
            self.known[key] = getattr(self, kind)(form)
        return self.known[key]

    def text(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """(the text with pseudonyms, findings as kind, start, end in the given text)."""
        if not _MAYBE.search(text):
            return text, []
        out, found, pos, at = [], [], 0, 0
        while m := _FORMS.search(text, at):
            for kind, form in _SINGLE.items():
                one = form.match(text, m.start())
                new = one and self.swap(kind, one[0], back)
                if new is not None:
                    out += [text[pos : one.start()], new]
                    found.append((kind, one.start(), one.end()))
                    pos = at = one.end()
                    break
            else:
                at = _after(text, m)
        return "".join(out) + text[pos:], found

    def undo(self, text: str) -> str:
        """The text whose pseudonyms these are."""
        return self.text(text, True)[0]


def _after(text: str, m: re.Match) -> int:
    """Where to look on after a form that failed validation: past its first run of digits or letters."""
    i = m.start() + 1
    while i < m.end() and text[i].isalnum():
        i += 1
    return i


def session_key(docs: DataFrame) -> str:
    """The key that the session's ``KEY_CONF`` names."""
    key = docs.sparkSession.conf.get(KEY_CONF, None)
    if not key:
        raise ValueError(f"set {KEY_CONF} to a secret key")
    return key


def pseudonymise_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """One row per document (``doc_id``, ``text``): its text with pseudonyms, counts by kind and spans in the old text.

    Without ``key``, the session's is used.
    """
    key = key or session_key(docs)

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = Pseudonyms(key)
        for batch in small(batches):
            texts, spans = [], []
            counts: list[list[int]] = [[] for _ in KINDS]
            for item in batch.column(1):
                text = item.as_py()
                new, found = (text, []) if text is None else names.text(text)
                texts.append(new)
                spans.append(",".join(f"{k}:{a}:{b}" for k, a, b in found))
                kinds = [k for k, _, _ in found]
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(kinds.count(k))
            cols = [pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "text", *(f"n_{k}" for k in KINDS), "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
