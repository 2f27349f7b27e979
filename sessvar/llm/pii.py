"""Format-preserving pseudonyms for personal data and secrets.

A value that its validator accepts is written as digits of mixed bases (a decimal place, a letter, a
day number), put through a keyed Feistel permutation of all values of that format, and written back
with its separators and case. Check digits are made anew, dates stay dates, addresses stay addresses.
The permutation depends on the key and the kind alone, so equal values stay linked across documents,
different ones stay apart, and whoever has the key can invert it.

Odd input is handled as :mod:`.common` states, but for what is said here.
"""

from __future__ import annotations

import bisect
import datetime as dt
import functools
import hashlib
import hmac
import ipaddress
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Production parameters. The key here is for the tables of this repository; give your own.
KEY = b"synthetic tables only"
ROUNDS = 10
#: Longer values are permuted in parts of so many places, each with its own tweak.
MOST_PLACES = 128


def _draw(key: bytes, tweak: str, r: int, value: int, size: int) -> int:
    text = f"{tweak}|{size}|{r}|{value}".encode()
    return int.from_bytes(hmac.digest(key, text, "sha256"), "big") % size


def feistel(value: int, a: int, b: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of range(a * b): halves of sizes ``a`` and ``b`` are added to in turn."""
    left, right = divmod(value, b)
    for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        sign = -1 if inverse else 1
        if r % 2:
            right = (right + sign * _draw(key, tweak, r, left, b)) % b
        else:
            left = (left + sign * _draw(key, tweak, r, right, a)) % a
    return left * b + right


def permuted(value: int, size: int, halves: tuple[int, int], key: bytes, tweak: str, inverse: bool = False) -> int:
    """The same for range(size), ``size`` at most the product of the halves: walked until back in range."""
    while True:
        value = feistel(value, *halves, key, tweak, inverse)
        if value < size:
            return value



#: The letters and digits that places may hold.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def places(text: str, key: bytes, tweak: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER), inverse: bool = False) -> str:
    """Permutes the places that an alphabet covers, each within its alphabet; other characters stay."""
    alphabet_of = {c: a for a in alphabets for c in a}
    mine = [(i, alphabet_of[c]) for i, c in enumerate(text) if c in alphabet_of]
    if not mine:
        return text
    if len(mine) > MOST_PLACES:  # so that numbers stay of bounded size
        ends = [0, *(mine[k][0] for k in range(MOST_PLACES, len(mine), MOST_PLACES)), len(text)]
        return "".join(places(text[a:b], key, f"{tweak}|{k}", alphabets, inverse) for k, (a, b) in enumerate(itertools.pairwise(ends)))
    half = len(mine) // 2
    sizes = [1, 1]
    value = 0
    for n, (i, a) in enumerate(mine):
        value = value * len(a) + a.index(text[i])
        sizes[n >= half] *= len(a)
    shape = "".join(str(len(a)) for _, a in mine)
    value = feistel(value, *sizes, key, f"{tweak}|{shape}", inverse)
    out = list(text)
    for i, a in reversed(mine):
        value, d = divmod(value, len(a))
        out[i] = a[d]
    return "".join(out)


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _refilled(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in shape)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _card_valid(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1] and len(set(digits)) > 1


def _card(text: str, key: bytes, inverse: bool) -> str:
    payload = places(_digits(text)[:-1], key, "card", inverse=inverse)
    return _refilled(text, payload + luhn_digit(payload))


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4]


def _iban(text: str, key: bytes, inverse: bool) -> str:
    plain = text.replace(" ", "")
    account = places(plain[4:], key, "iban" + plain[:2], inverse=inverse)
    rest = iter(plain[:2] + _iban_check(plain[:2], account) + account)
    return "".join(c if c == " " else next(rest) for c in text)


def _ssn_valid(text: str) -> bool:
    area, group, serial = text[:3], text[4:6], text[7:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _ssn(text: str, key: bytes, inverse: bool) -> str:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value = feistel(value, 898, 99 * 9999, key, "ssn", inverse)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"


def _phone_valid(text: str) -> bool:
    return 8 <= len(_digits(text)) <= 15


def _phone(text: str, key: bytes, inverse: bool) -> str:
    """What stays: the country code after a plus sign, where a separator ends it, else that sign's first digit; a national number's leading zero."""
    code = re.match(r"\+\d{1,3}(?=[ (.-])|\+\d(?=\d*$)|0", text)
    start = code.end() if code else 0
    return text[:start] + _refilled(text[start:], places(_digits(text[start:]), key, "phone" + text[:start], inverse=inverse))


def _ip_valid(text: str) -> bool:
    return all(len(p) == len(str(int(p))) and int(p) < 256 for p in text.split("."))


def _ip(text: str, key: bytes, inverse: bool) -> str:
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    return ".".join(map(str, feistel(value, 1 << 16, 1 << 16, key, "ip", inverse).to_bytes(4, "big")))


def _ipv6_valid(text: str) -> bool:
    try:
        return text.count(":") > 1 and bool(re.search(r"\d", text)) and ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def _ipv6(text: str, key: bytes, inverse: bool) -> str:
    """Groups keep their lengths, and digits and letters their places, so the result is an address of the same shape."""
    return places(text, key, "ipv6", (DIGITS, "abcdef", "ABCDEF"), inverse)


#: Dates permute within the days of two centuries.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


@functools.cache
def _days(month_first: bool, widths: tuple[int, int]) -> list[dt.date]:
    """The days that a format can write: a field of one place holds 1 to 9, and what can be read day first is not month first."""
    every = (FIRST_DAY + dt.timedelta(k) for k in range((LAST_DAY - FIRST_DAY).days + 1))
    fields = (lambda d: (d.month, d.day)) if month_first else (lambda d: (d.day, d.month))
    return [d for d in every if all(w > 1 or f < 10 for w, f in zip(widths, fields(d), strict=True)) and not (month_first and d.day < 13)]


def _day(text: str) -> tuple[dt.date | None, bool, Callable[[dt.date], str]]:
    """The day, whether it is written month first, and how its format writes a day. Year first, else day first, else month first."""
    a, sep, b, _, c = re.split(r"([-/.])", text)
    if len(a) == 4:
        orders = ((False, (a, b, c), lambda d: f"{d.year:04d}{sep}{d.month:02d}{sep}{d.day:02d}"),)
    else:
        shape = lambda x, y, d: f"{x:0{len(a)}d}{sep}{y:0{len(b)}d}{sep}{d.year:04d}"
        orders = ((False, (c, b, a), lambda d: shape(d.day, d.month, d)), (True, (c, a, b), lambda d: shape(d.month, d.day, d)))
    for month_first, parts, written in orders:
        try:
            return dt.date(*map(int, parts)), month_first, written
        except ValueError:
            pass
    return None, False, str


def _date_valid(text: str) -> bool:
    day, *_ = _day(text)
    return day is not None and FIRST_DAY <= day <= LAST_DAY


def _date(text: str, key: bytes, inverse: bool) -> str:
    """Within the days that the text's format can write."""
    day, month_first, written = _day(text)
    a, b = re.split(r"[-/.]", text)[:2]
    widths = (2, 2) if len(a) == 4 else (len(a), len(b))
    days, tweak = _days(month_first, widths), "date" if not month_first and widths == (2, 2) else f"date{'m' * month_first}{widths[0]}{widths[1]}"
    half = int(len(days) ** 0.5) + 1
    return written(days[permuted(bisect.bisect_left(days, day), len(days), (half, half), key, tweak, inverse)])


def _email(text: str, key: bytes, inverse: bool) -> str:
    """The part before the sign is permuted, the domain stays."""
    name, _, domain = text.rpartition("@")
    return places(name, key, "email" + domain.lower(), inverse=inverse) + "@" + domain


def _secret(text: str, key: bytes, inverse: bool) -> str:
    hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)
    alphabets = ((DIGITS + "abcdef",) if text == text.lower() else (DIGITS + "ABCDEF",)) if hexadecimal else (DIGITS, LOWER, UPPER)
    return places(text, key, "secret", alphabets, inverse)


def _access_key(text: str, key: bytes, inverse: bool) -> str:
    return text[:4] + places(text[4:], key, "access key", (UPPER + "234567",) if re.fullmatch(r"[A-Z2-7]+", text[4:]) else (DIGITS + UPPER,), inverse)


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds candidates (its group ``v`` if it has one), ``valid`` decides, ``pseudonym`` permutes."""

    name: str
    pattern: str
    pseudonym: Callable[[str, bytes, bool], str]
    valid: Callable[[str], bool] = lambda text: True


#: In this order where candidates start at one place. Runs without a bound are possessive and begin where no run goes before them,
#: so that no place of a long token is tried twice.
KINDS = (
    Kind("email", r"(?<![\w.+%-])[\w.+%-]++@(?:[^\W_][\w-]*+(?<=[^\W_])\.)+[^\W\d_]{2,}", _email, lambda text: bool(re.search(r"[^\W_]", text.rpartition("@")[0]))),
    Kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", _access_key),
    Kind("secret", r"(?i:(?<![a-z])(?:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*[\"']?)(?P<v>[A-Za-z0-9_+/-]{12,})", _secret, lambda text: bool(re.search(r"\d", text))),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", _iban, _iban_valid),
    Kind("ipv6", r"(?<![\w:.])[0-9A-Fa-f:]{3,39}+(?![\w:])", _ipv6, _ipv6_valid),
    Kind("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", _ip, _ip_valid),
    Kind("date", r"(?<![\d./-])(?:\d{4}(?P<s>[-/.])\d{2}(?P=s)\d{2}|\d{1,2}(?P<t>[-/.])\d{1,2}(?P=t)\d{4})(?![./-]?\d)", _date, _date_valid),
    Kind("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn, _ssn_valid),
    Kind("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<!\d[ .-])0(?:\d{2,4}(?P<s>[ -])\d{3,4}(?P=s)\d{3,4}|\d{4}[ -]\d{6})(?![ .-]?\d)|\+[1-9]\d{7,14})(?!\d)", _phone, _phone_valid),
    Kind("card", r"(?<![\d.-])(?:\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}(?P<t>[ -])\d{6}(?P=t)\d{5})(?![.-]?\d)", _card, _card_valid),
)


def _compiled() -> list[tuple[Kind, re.Pattern]]:
    return [(k, re.compile(k.pattern)) for k in KINDS]


def _accepted(kind: Kind, value: str) -> str | None:
    """The candidate, if it is valid; of a telephone number, which a next number may follow, the longest part up to a separator that is."""
    while not kind.valid(value):
        ends = [m.start() for m in re.finditer(r"[ .-]+", value)] if kind.name == "phone" else []
        if not ends:
            return None
        value = value[: ends[-1]]
    return value


def pseudonymised(text: str, key: bytes = KEY, inverse: bool = False, compiled: list | None = None) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with its values replaced; (kind, start, end, what stands there now) of each in the old text."""
    found = []
    if "@" not in text and not re.search(r"\d", text):
        return text, found
    for rank, (kind, pattern) in enumerate(compiled or _compiled()):
        if kind.name == "email" and "@" not in text or kind.name == "ipv6" and text.count(":") < 2 or kind.name == "phone" and not re.search(r"\d[)]? ?[.-]?\d", text):
            continue
        group = "v" if "?P<v>" in kind.pattern else 0
        at = 0
        while m := pattern.search(text, at):
            start, value = m.start(group), _accepted(kind, m[group])
            if value is None:
                at = m.start() + 1  # another candidate may begin within this one
            else:
                found.append((start, rank, start + len(value), kind, value))
                at = start + len(value)
    out, spans, at = [], [], 0
    for start, _, end, kind, value in sorted(found, key=lambda f: f[:3]):
        if start < at:
            continue  # inside a value already replaced
        new = kind.pseudonym(value, key, inverse)
        out += [text[at:start], new]
        spans.append((kind.name, start, end, new))
        at = end
    return "".join([*out, text[at:]]), spans


SCHEMA = "doc_id long, text string, n_values long, spans array<struct<kind:string,start:long,end:long,pseudonym:string>>"


def pseudonyms(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, the whole text with pseudonyms, how many values it had, and where. A null text gives an empty one; no row is shuffled."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled()
        for batch in batches:
            for part in common.slices([batch]):
                done = [pseudonymised(t, key, compiled=compiled) for t in part.column(1).to_pylist()]
                spans = [[dict(zip(("kind", "start", "end", "pseudonym"), s, strict=True)) for s in found] for _, found in done]
                yield pa.record_batch([part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, span)], names=["doc_id", "text", "n_values", "spans"])

    return common.texts(docs).mapInArrow(work, SCHEMA)


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data and secrets replaced."""
    return pseudonyms(common.documents(spark, sf_dir))
