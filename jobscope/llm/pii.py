"""Format-preserving pseudonyms for personal data: each validated value is permuted, under a key, within its own format.

A value becomes a number of its format's domain (card numbers of that length and network, telephone numbers, calendar
days, addresses, ...), a keyed Feistel network permutes the domain, and the number it gives is written in the same
layout, with separators, case and check digits as they must be. Equal values get equal pseudonyms in every document,
different values different ones, and whoever has the key can undo it. What is permuted is the value and not its spelling: a
telephone number with or without the country's 1, a day in any layout, a card or IBAN with or without spaces and an address
in any case keep one pseudonym, each in its own spelling; so do +49 and 0049, and an IPv6 address with or without its zeros. Hosts of mail addresses, countries
of IBANs and telephones, first digits of cards, zeros of IPv6 addresses, and of a day whether its number is over 12 (which tells a month-first layout) and whether it or its month
has one digit (which tells a layout without zeros) stay as they are. A day first and a month first date can't be
told apart where both are possible; it is read day first. Of a card or IBAN with more digits or capitals behind
it, the longest reading that passes its check is taken; where a pseudonym and what follows happen to pass as one, only the spans tell.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import re
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .words import map_texts

ROUNDS = 10
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@functools.lru_cache(maxsize=1 << 16)
def permuted(n: int, size: int, key: str, tweak: str, inverse: bool = False) -> int:
    """n's place in a keyed permutation of range(size): a balanced Feistel network on the least even number of bits that
    holds ``size``, walked until it falls in the range again."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    while True:
        left, right = n >> half, n & mask
        for r in order:
            if inverse:
                left, right = right, left
            data = b"%d|%d|%s|" % (r, size, tweak.encode()) + right.to_bytes(width, "big")
            out = b"".join(hashlib.blake2b(data, key=key.encode()[:64], person=b"%d" % i).digest() for i in range(-(-width // 64)))
            left ^= int.from_bytes(out[:width], "big") & mask
            if not inverse:
                left, right = right, left
        n = left << half | right
        if n < size:
            return n


class Scrambler:
    """Pseudonyms of values under one key."""

    def __init__(self, key: str, inverse: bool = False):
        self.key, self.inverse = key, inverse

    def number(self, n: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda n: True) -> int:
        while True:
            n = permuted(n, size, self.key, tweak, self.inverse)
            if valid(n):
                return n

    def characters(self, text: str, alphabets: list[str], tweak: str, valid: Callable[[str], bool] | None = None) -> str:
        """Permutes the characters that have an alphabet of more than one, as one number of mixed radix; with ``valid`` among the texts that it holds for."""
        n, size = 0, 1
        for c, a in zip(text, alphabets):
            if len(a) > 1:
                n, size = n * len(a) + a.index(c), size * len(a)

        def written(n: int) -> str:
            out = []
            for c, a in zip(reversed(text), reversed(alphabets)):
                if len(a) > 1:
                    n, d = divmod(n, len(a))
                    c = a[d]
                out.append(c)
            return "".join(reversed(out))

        if size == 1:
            return text
        return written(self.number(n, size, f"{tweak}{len(text)}", (lambda n: valid(written(n))) if valid else lambda n: True))

    # each takes the text matched and returns its pseudonym, or None if it isn't valid

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn(digits[:-1]) != digits[-1]:
            return None
        body = self.characters(digits[:-1], [digits[0]] + [DIGITS] * (len(digits) - 2), "card" + digits[0])
        return _laid_out(text, body + luhn(body))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        body = self.characters(plain[4:], [DIGITS if c.isdigit() else UPPER for c in plain[4:]], "iban" + plain[:2])
        it = iter(plain[:2] + iban_check(plain[:2], body) + body)
        return "".join(c if c == " " else next(it) for c in text)

    def ssn(self, text: str) -> str | None:
        n = int(re.sub(r"\D", "", text))
        if not _is_ssn(n):
            return None
        return _laid_out(text, f"{self.number(n, 10**9, 'ssn', _is_ssn):09d}")

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        national = len(digits) == 10 or len(digits) == 11 and digits[0] == "1"
        if national and digits[-10] in "23456789" and digits[-7] in "23456789":
            alphabets = ["23456789", DIGITS, DIGITS] * 2 + [DIGITS] * 4
            return _laid_out(text, digits[:-10] + self.characters(digits[-10:], alphabets, "phone"))
        if text[0] != "+" and not text.startswith("00"):
            return None
        abroad = digits[2:] if text[0] != "+" else digits
        if not 8 <= len(abroad) <= 15 or abroad[0] == "0":
            return None
        kept = 1 if abroad[0] in "17" else 2  # the country, or the first two digits of three
        new = self.characters(abroad[kept:], [DIGITS] * (len(abroad) - kept), "phone" + abroad[:kept])
        return _laid_out(text, digits[: len(digits) - len(abroad) + kept] + new)

    def address(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        n = self.number(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, n.to_bytes(4, "big")))

    def address6(self, text: str) -> str | None:
        try:
            there = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        plain = there.compressed
        starts = [i for i, c in enumerate(plain) if c != ":" and (i == 0 or plain[i - 1] == ":")]
        alphabets = [c if c == ":" or c == "0" and i in starts else HEX[1:] if i in starts else HEX for i, c in enumerate(plain)]
        shape = "".join(c if len(a) == 1 else "x" for c, a in zip(plain, alphabets))
        cased = lambda x: bool(re.search("[a-f]", x))  # noqa: E731  letters tell capitals from small ones, so they come from letters
        groups = ipaddress.IPv6Address(self.characters(plain, alphabets, "ip6" + shape, lambda x: cased(x) == cased(plain))).exploded.split(":")
        before, gap, after = text.partition("::")
        left, right = before.split(":") if before else [], after.split(":") if after else []
        told = [[g.lstrip("0").zfill(len(part)) for part, g in zip(parts, part_groups)] for parts, part_groups in ((left, groups), (right, groups[len(groups) - len(right) :]))]
        out = ":".join(told[0]) + gap + ":".join(told[1])
        return out.upper() if text.upper() == text and text.lower() != text else out

    def date(self, text: str) -> str | None:
        sep = re.search(r"\D", text)[0]
        parts = text.split(sep)
        bare = any(len(x) == 1 for x in parts)
        if bare and any(x[0] == "0" for x in parts):
            return None  # neither with zeros nor without
        a, b, c = map(int, parts)
        if len(parts[0]) == 4:
            layout, day = "ymd", _day(a, b, c)
        else:
            layout, day = "dmy", _day(c, b, a)
            if day is None and sep == "/":  # only what can't be day first is read month first
                layout, day = "mdy", _day(c, a, b)
        if day is None:
            return None
        kind_of = lambda d: (d.day > 12, d.day < 10 or d.month < 10)
        kind = kind_of(datetime.date.fromordinal(day))
        n = self.number(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "day", lambda n: kind_of(datetime.date.fromordinal(n + FIRST_DAY)) == kind)
        d = datetime.date.fromordinal(n + FIRST_DAY)
        y, m, d = f"{d.year:04d}", *(str(x) if bare else f"{x:02d}" for x in (d.month, d.day))
        return sep.join({"ymd": (y, m, d), "dmy": (d, m, y), "mdy": (m, d, y)}[layout])

    def email(self, text: str) -> str | None:
        name, _, host = text.partition("@")
        new = self.characters(name.lower(), [_class_of(c) for c in name.lower()], "email")
        return f"{''.join(n.upper() if c in UPPER else n for c, n in zip(name, new))}@{host}"

    def secret(self, text: str) -> str | None:
        head = re.match(_SECRET_HEAD, text)[0]
        body = text[len(head) :]
        if head == "AKIA":
            return head + self.characters(body, [UPPER + DIGITS] * len(body), "key")
        for alphabet in (HEX, HEX.upper()):
            if set(body) <= set(alphabet):
                return head + self.characters(body, [alphabet] * len(body), "hex")
        kinds = [DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER for c in body]
        shape = "".join("0aA"[(DIGITS, LOWER, UPPER).index(k)] for k in kinds)
        return head + self.characters(body, kinds, "word" + shape, lambda x: not (set(x) <= set(HEX) or set(x) <= set(HEX.upper())))


def luhn(body: str) -> str:
    """The check digit of a number without it."""
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _is_ssn(n: int) -> bool:
    area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _day(y: int, m: int, d: int) -> int | None:
    try:
        n = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    return n if FIRST_DAY <= n <= LAST_DAY else None


def _class_of(c: str) -> str:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else c


def _laid_out(text: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


_SECRET_NAMES = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)"
_SECRET_HEAD = rf"AKIA|{_SECRET_NAMES}\s?[:=]\s?[\"']?"
#: One pattern for each kind, all starting where a word starts, so that long runs cost no more than their length.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    # a value of letters only is a secret if it is hexadecimal, after = or in quotes; else a word may follow the name
    "secret": r"\bAKIA[A-Z0-9]{16}(?![A-Z0-9])|\b" + _SECRET_NAMES + r"\s?(?:=\s?(?:[0-9a-f]{8,64}|[0-9A-F]{8,64})|[:=]\s?[\"'](?:[0-9a-f]{8,64}|[0-9A-F]{8,64})|[:=]\s?[\"']?(?=[A-Za-z]{0,63}[0-9])[A-Za-z0-9]{8,64})(?![0-9A-Za-z])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "date": r"(?<![\w.\-/])(?:[0-9]{4}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|[0-9]{1,2}(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.|-[0-9]{1,2}-)[0-9]{4})(?:(?=T[0-9]{2}:)|(?![\w\-/]))",
    "address": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\w)",
    "address6": r"(?<![\w:.])(?=[A-Fa-f:]{0,38}[0-9])(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:.])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "card": r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "phone": r"(?<![\w+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-]?[0-9]{2,4})?|(?:\+|00)[1-9][0-9]{0,14}(?:[ .-]?\(?[0-9]{1,12}\)?){0,6})(?![\w-])",
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()), re.ASCII)
_LATER = {k: [re.compile(f"(?P<{o}>{KINDS[o]})", re.ASCII) for o in list(KINDS)[i + 1 :] if o in ("card", "phone")] for i, k in enumerate(KINDS)}
_MAYBE = re.compile(f"[0-9@]|AKIA|{_SECRET_NAMES}")


def pseudonymized(text: str | None, key: str, inverse: bool = False) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with its personal data replaced, and (start, end, kind) of what was replaced, in the text given."""
    if not text or not _MAYBE.search(text):
        return text, []
    with_key, spans, out, at, done = Scrambler(key, inverse), [], [], 0, 0
    while m := _ANY.search(text, at):
        kind, found = m.lastgroup, _read(m[0], m.lastgroup, with_key)
        for other in _LATER[kind] if found is None else ():  # what isn't valid as one kind may be as another
            if n := other.match(text, m.start()):
                kind, found = n.lastgroup, _read(n[0], n.lastgroup, with_key)
                if found is not None:
                    break
        if found is None:
            at = m.start() + 1  # another value may start within what isn't valid
            continue
        length, new = found
        out += [text[done : m.start()], new]
        spans.append((m.start(), m.start() + length, kind))
        at = done = m.start() + length
    return "".join([*out, text[done:]]), spans


def _read(text: str, kind: str, with_key: Scrambler) -> tuple[int, str] | None:
    """(how much of a match is a value, its pseudonym), the longest reading that is valid."""
    for end in _ends(text, kind):
        new = getattr(with_key, kind)(text[:end])
        if new is not None:
            return end, new
    return None


def _ends(text: str, kind: str) -> list[int]:
    """Where a match may end: at its end; a card or IBAN, which may have taken in the words after it, also before a separator, and only where its
    check passes. The checks of all ends are sums and remainders of one walk over the match."""
    if kind not in ("card", "iban"):
        return [len(text)]
    ends = []
    if kind == "card":
        sums, n = [0, 0], 0  # with every second digit doubled, from the first or from the second on
        for i, c in enumerate(text):
            if c in " -":
                if n >= 13 and sums[n % 2] % 10 == 0:
                    ends.append(i)
                continue
            d = ord(c) - 48
            twice = 2 * d - 9 if d > 4 else 2 * d
            sums[n % 2], sums[1 - n % 2] = sums[n % 2] + twice, sums[1 - n % 2] + d
            n += 1
        if n >= 13 and sums[n % 2] % 10 == 0:
            ends.append(len(text))
    else:
        country, left, n = int(text[0], 36) * 100 + int(text[1], 36), 0, 0
        check = lambda: n >= 11 and 98 - (left * 10_000 + country) * 100 % 97 == int(text[2:4])  # noqa: E731  15 characters: the shortest country's
        for i, c in enumerate(text[4:], 4):
            if c == " ":
                if check():
                    ends.append(i)
                continue
            left = (left * 10 + ord(c) - 48 if c <= "9" else left * 100 + ord(c) - 55) % 97
            n += 1
        if check():
            ends.append(len(text))
    return ends[::-1]


#: The session's setting that holds the secret, and the published key that stands in, with a warning, where it is unset.
KEY_SETTING, DEFAULT_KEY = "spark.jobscope.pseudonym.key", "jobscope"


def session_key(spark: SparkSession) -> str:
    """The secret in KEY_SETTING. Without one pseudonyms are made with a key that anybody can read here and undo, which does for tests."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms are made with a published key and protect nobody", stacklevel=2)
    return key or DEFAULT_KEY


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text (whole, with pseudonyms), found (how many values), spans (start, end, kind in the input text) of every row.

    A null text stays null and an empty one empty; texts of any length are read whole. Numbers that fail their check (digit
    sums, calendar, ranges) stay. Repeated rows give equal rows, an empty table none. Columns other than doc_id and text
    aren't read, so their names may be any. ``key``: :func:`session_key`'s unless given.
    """
    key = key or session_key(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(texts):
        both = [pseudonymized(t, key) for t in texts]
        spans = pa.array([[dict(zip(("start", "end", "kind"), s)) for s in spans] for _, spans in both], kind)
        return range(len(texts)), {"text": [t for t, _ in both], "found": [len(s) for _, s in both], "spans": spans}

    return map_texts(docs, run, "text string, found int, spans array<struct<start: int, end: int, kind: string>>")


def replace_private(docs: DataFrame, key: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with pseudonyms in ``text``, and ``n_chars``, if there is one, in step with it.

    A null text and its n_chars stay as they are; otherwise as in :func:`pseudonymize`.
    """
    key = key or session_key(docs.sparkSession)
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = [pseudonymized(t.as_py(), key)[0] for t in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            if chars is not None:
                old = batch.column(chars)
                columns[chars] = pa.array([n.as_py() if t is None else len(t) for t, n in zip(texts, old)], old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
