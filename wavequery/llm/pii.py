"""Personal data: format-preserving Feistel pseudonyms.

Found: e-mail addresses (local part of at most 64 characters, labels of at most
63, domain of at most 253), IPv4 addresses, phone numbers (any digits but zeros alone), payment cards
(Luhn), IBANs (modulo 97), social security and taxpayer numbers (areas 001 to 999 without 666, groups
from 01, serial numbers from 0001) and dates that exist.  A value is
taken as a number below the size of its format (digits stay digits, letters
letters of their case, a date a date of 1900-2099 whose day and month are written
with as many digits, an address an address, check digits are made anew) and
permuted by a keyed Feistel network; numbers outside the format are permuted
again until they fall inside (cycle walking).  So equal values get equal
pseudonyms in every document, different ones different, and who holds the key
can turn them back (``Cipher.back``).  There is no default key.

Edge cases: null text is empty; texts without findings stay as they are; values
that fail their check (month 13, octet 256, area code 000, wrong check digit,
parts too long) stay; very long texts are searched whole, in time and memory
proportional to them; repeated rows are treated each; rows without a doc_id
like any other; an empty table gives an empty result; other columns are kept by
``pseudonymise``, those named as its own replaced.  Spans count code points of
the given text.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, read_documents, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUNDS = 8

#: The setting that holds the key of ``op7_pii_pseudonyms``.
KEY_SETTING = "spark.wavequery.pii.key"

LOCAL, LABEL, DOMAIN = 64, 63, 253
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

KINDS = ("email", "iban", "date", "phone", "ssn", "ip", "card")
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,{LOCAL}}}@(?:[A-Za-z0-9-]{{1,{LABEL}}}\.)+[A-Za-z]{{2,{LABEL}}}")
NUMBER = re.compile(
    r"""(?=[0-9+(A-Z])(?:(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])
    |(?<![0-9.\-/])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?P<mark>[./])[0-9]{1,2}(?P=mark)[0-9]{4})(?![0-9\-/]|\.[0-9])
    |(?<![0-9+.])(?P<phone>(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4})(?![0-9]|[.-][0-9])
    |(?<![0-9.-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])
    |(?<![0-9.])(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![0-9]|\.[0-9])
    |(?<![0-9])(?P<card>[0-9](?:[\x20-]?[0-9]){12,18})(?![0-9]))""",
    re.X,
)


def _luhn(digits: str) -> int:
    """The check digit that these digits need."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 if k % 2 else 2)
        total += x - 9 if x > 9 else x
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


class Cipher:
    """A keyed permutation of the values of each kind."""

    def __init__(self, key: bytes) -> None:
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = hashlib.sha256(key).digest()

    def _round(self, kind: str, size: int, i: int, half: int, bits: int) -> int:
        data = self.key + f"{kind}:{size:x}:{i}:{half:x}".encode()
        return int.from_bytes(hashlib.shake_256(data).digest(bits // 8 + 8), "big") & ((1 << bits) - 1)

    def permute(self, kind: str, value: int, size: int, back: bool = False) -> int:
        """A permutation of 0 .. size - 1."""
        if size < 2:
            return value
        bits = max(1, -(-(size - 1).bit_length() // 2))
        mask = (1 << bits) - 1
        while True:
            a, b = value >> bits, value & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    a, b = b ^ self._round(kind, size, i, a, bits), a
                else:
                    a, b = b, a ^ self._round(kind, size, i, b, bits)
            value = a << bits | b
            if value < size:
                return value

    def characters(self, kind: str, text: str, back: bool = False) -> str:
        """Digits and letters permuted as one number, all else kept."""
        bases = [(48, 10) if "0" <= c <= "9" else (65, 26) if "A" <= c <= "Z" else (97, 26) if "a" <= c <= "z" else None for c in text]
        value, size = 0, 1
        for c, x in zip(text, bases):
            if x:
                value, size = value * x[1] + ord(c) - x[0], size * x[1]
        value = self.permute(kind, value, size, back)
        out = []
        for c, x in zip(reversed(text), reversed(bases)):
            if x:
                value, r = divmod(value, x[1])
                c = chr(x[0] + r)
            out.append(c)
        return "".join(reversed(out))

    def pseudonym(self, kind: str, text: str, back: bool = False) -> str | None:
        """What stands for a value; None if it is no valid one."""
        if kind == "email":
            local, _, domain = text.partition("@")
            host, _, top = domain.rpartition(".")
            if len(domain) > DOMAIN:
                return None
            return f"{self.characters('local', local, back)}@{self.characters('host', host, back)}.{top}"
        if kind == "ip":
            octets = [int(x) for x in text.split(".")]
            if max(octets) > 255:
                return None
            n = self.permute(kind, int.from_bytes(bytes(octets), "big"), 1 << 32, back)
            return ".".join(str(x) for x in n.to_bytes(4, "big"))
        if kind == "date":
            iso = "-" in text
            parts = re.split(r"[-./]", text)
            y, m, d = map(int, parts if iso else parts[::-1])
            swap = not iso and m > 12  # month first
            if swap:
                m, d = d, m
            try:
                day = datetime.date(y, m, d).toordinal()
            except ValueError:
                return None
            if not FIRST_DAY <= day <= LAST_DAY:
                return None
            # A date is permuted among those that the same writing can hold.
            widths = [len(x) for x in (parts[1:] if iso else parts[:2])]

            def fits(x: datetime.date) -> bool:
                both = (x.month, x.day) if iso or swap else (x.day, x.month)
                return (not swap or x.day > 12) and all(w == 2 or n < 10 for n, w in zip(both, widths))

            new = self.permute(kind, day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, back)
            while not fits(datetime.date.fromordinal(FIRST_DAY + new)):
                new = self.permute(kind, new, LAST_DAY - FIRST_DAY + 1, back)
            x = datetime.date.fromordinal(FIRST_DAY + new)
            if iso:
                return f"{x.year:04d}-{x.month:02d}-{x.day:02d}"
            mark = text[-5]
            a, b = (x.month, x.day) if swap else (x.day, x.month)
            return f"{a:0{widths[0]}d}{mark}{b:0{widths[1]}d}{mark}{x.year:04d}"
        if kind == "card":
            digits = re.sub(r"\D", "", text)
            if _luhn(digits[:-1]) != int(digits[-1]):
                return None
            body = f"{self.permute(f'card{len(digits)}', int(digits[:-1]), 10 ** (len(digits) - 1), back):0{len(digits) - 1}d}"
            new = iter(body + str(_luhn(body)))
            return re.sub(r"\d", lambda m: next(new), text)
        if kind == "iban":
            plain = text.replace(" ", "")
            if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
                return None
            rest = self.characters("iban" + plain[:2], plain[4:], back)
            new = iter(plain[:2] + _iban_check(plain[:2], rest) + rest)
            return "".join(c if c == " " else next(new) for c in text)
        if kind == "ssn":  # areas 001 to 999 without 666 (from 900 on: taxpayer numbers), groups from 01, serial numbers from 0001
            area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
            if area in (0, 666) or not group or not serial:
                return None
            n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
            n = self.permute(kind, n, 998 * 99 * 9999, back)
            area = n // 9999 // 99
            return f"{area + 1 + (area >= 665):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
        if kind == "phone":
            m = re.match(r"\+[0-9]{1,3}[ .-]?", text)
            head = m[0] if m else ""
            rest = text[len(head) :]
            if not int(re.sub(r"\D", "", rest)):
                return None
            while True:  # a number of zeros alone is none
                rest = self.characters("phone", rest, back)
                if int(re.sub(r"\D", "", rest)):
                    return head + rest
        return self.characters(kind, text, back)


def replace(text: str, cipher: Cipher, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the spans that were replaced."""
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)] if "@" in text else []
    found += [(m.start(), m.end(), next(k for k in KINDS[1:] if m[k] is not None)) for m in NUMBER.finditer(text)]
    out, spans, at = [], [], 0
    for start, end, kind in sorted(found):
        if start >= at and (new := cipher.pseudonym(kind, text[start:end], back)) is not None:
            out += [text[at:start], new]
            at = end
            spans.append((start, end, kind))
    return "".join(out) + text[at:] if spans else text, spans


def pseudonymise(docs: DataFrame, key: bytes, col: str = "text") -> DataFrame:
    """All columns of ``docs`` with pseudonyms in ``col``, then n_found and
    spans (kind:start:end, joined by commas); columns of these names in ``docs``
    are replaced."""
    docs = docs.drop("n_found", "spans")
    names = docs.columns
    at = names.index(col)
    docs = docs.withColumn(col, text_or_empty(col))

    def rows(batch):
        cipher = Cipher(key)
        texts, counts, spans = [], [], []
        for text in batch.column(at).to_pylist():
            new, found = replace(text, cipher)
            texts.append(new)
            counts.append(len(found))
            spans.append(",".join(f"{kind}:{a}:{b}" for a, b, kind in found))
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(spans, pa.string())], [*names, "n_found", "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, rows, f"{schema}, n_found long, spans string")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """``key``: by default that of the setting; without either this is an error."""
    key = key or spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: set {KEY_SETTING}")
    return pseudonymise(read_documents(spark, sf_dir).select("doc_id", "text"), key.encode())
