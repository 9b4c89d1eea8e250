"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Values are found by pattern and then validated: cards by their check digit,
IBANs by their remainder, IPv4 addresses by their octets, dates by the calendar,
phone numbers and social security numbers by their shape, e-mail addresses by
their parts.  The significant part of a valid value is read as a number below
N, permuted below N by the key, and written back in the value's own format, so
it stays valid.  Equal values get equal pseudonyms in every document and every
notation; whoever holds the key can reverse them.

The permutation is E^-1(E(x) + 1 mod N), E a Feistel network with cycle
walking: one cycle over all N values, so no value is ever its own pseudonym.

A card or IBAN may stand next to other groups of digits or capitals.  In a run
of such groups every place that may hold one is tried, the usual notations
first, and the rest of the run again after a find.  A pseudonym that would make
a place tried before it valid is permuted once more, so the way back finds the
same places; only there does a value get another pseudonym than elsewhere.

Documents are handled one by one in Arrow batches, without a shuffle; texts
without a digit or '@' never leave the JVM.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 10
DEFAULT_KEY = "change-me"     # production runs pass their own secret
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
MAX_CACHED = 50_000           # pseudonyms remembered per task

SCHEMA = "text string, n_found int, spans array<struct<kind:string,start:int,end:int>>"


class Feistel:
    """Keyed permutation of range(n) for any n, by domain (`tweak`)."""

    def __init__(self, key: str, tweak: str, n: int):
        self.n, self.key = n, hashlib.blake2b(f"{key}\x1f{tweak}\x1f{n}".encode(), digest_size=32).digest()
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1

    def _f(self, i: int, x: int) -> int:
        data = bytes([i]) + x.to_bytes((self.half + 7) // 8, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=(self.half + 7) // 8)
                              .digest(), "big") & self.mask

    def _once(self, x: int, rounds) -> int:
        a, b = x >> self.half, x & self.mask
        for i in rounds:
            a, b = b, a ^ self._f(i, b)
        return a << self.half | b

    def encrypt(self, x: int) -> int:
        while True:
            x = self._once(x, range(ROUNDS))
            if x < self.n:
                return x

    def decrypt(self, x: int) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            x = self._once(b << self.half | a, reversed(range(ROUNDS)))
            x = (x & self.mask) << self.half | x >> self.half
            if x < self.n:
                return x

    def pseudonym(self, x: int) -> int:
        return self.decrypt((self.encrypt(x) + 1) % self.n)

    def original(self, y: int) -> int:
        return self.decrypt((self.encrypt(y) - 1) % self.n)


def luhn_digit(digits: str) -> str:
    """The digit that makes `digits` + digit pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, body: str) -> str:
    rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return f"{98 - rest:02d}"


def put_digits(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


# Groups of digits that cards are printed in, by how soon they are tried (a lone group comes first).
CARD_SHAPES = {(4, 4, 4, 4): 2, (4, 6, 5): 2, (4, 6, 4): 2, (4, 4, 4, 4, 3): 3}
CARD_GROUPS = 5               # in a longer row of groups these are tried: see Pseudonyms._card_places
# Length of the IBANs of each country; other lengths are tried after it.
IBAN_LENGTH = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CR CH HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC"}.items() for c in cs.split()}
LONGEST_PLACE = 50            # above the characters of any card or IBAN

_ALPHABETS = ((string.digits, string.digits), (string.ascii_lowercase,) * 2,
              (string.ascii_uppercase, string.ascii_lowercase))


class Pseudonyms:
    """Per-kind detection, validation and permutation under one key."""

    # Fixed shapes of the values (digits are ASCII only).
    EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
    IPV4 = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])")
    # Runs of groups in which IBANs and cards are looked for.
    IBAN_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*(?: [A-Z0-9]+)*(?![A-Za-z0-9])")
    CARD_RUN = re.compile(r"(?<![\w.])(?=[0-9](?:[ -]?[0-9]){12})[0-9]+(?:[ -][0-9]+)*(?!\w|\.[0-9])")
    SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
    DATE = re.compile(r"(?<![\w./-])(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})"
                      r"|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?![\w/-]|\.[0-9])")
    PHONE = re.compile(r"(?<![\w.])(?:\+([0-9]{1,3})[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])"
                       r"[0-9]{3,4}[ .-]?[0-9]{3,4}(?:[ .-]?[0-9]{2,4})?(?![\w]|[.-][0-9])"
                       r"|(?<![\w.])\+[0-9]{8,15}(?!\w)")

    def __init__(self, key: str = DEFAULT_KEY):
        self.key, self.nets, self.seen, self.days = key, {}, {}, {}

    def _permute(self, kind: str, x: int, n: int, back: bool) -> int:
        net = self.nets.get((kind, n))
        if net is None:
            if len(self.nets) >= MAX_CACHED:
                self.nets.clear()
            net = self.nets[kind, n] = Feistel(self.key, kind, n)
        return net.original(x) if back else net.pseudonym(x)

    def _digits(self, kind: str, digits: str, back: bool) -> str:
        return f"{self._permute(kind, int(digits), 10 ** len(digits), back):0{len(digits)}d}"

    # Each method returns the replaced value, or None if the value is not valid.

    def email(self, value: str, back=False) -> str | None:
        local, _, domain = value.rpartition("@")
        name, _, tld = domain.rpartition(".")
        if local.startswith(".") or ".." in value or not any(c.isalnum() for c in local):
            return None
        shape = f"{local}@{name}"
        # Letters of either case share an alphabet, so notations of one address stay linked.
        sets = [next((s for a, s in _ALPHABETS if c in a), "") for c in shape]
        x, n = 0, 1
        for c, s in zip(shape.lower(), sets):
            if s:
                x, n = x * len(s) + s.index(c), n * len(s)
        y, out = self._permute("email:" + ",".join(str(len(s)) for s in sets), x, n, back), []
        for c, s in zip(reversed(shape), reversed(sets)):
            if s:
                y, r = divmod(y, len(s))
                c = s[r].upper() if c.isupper() else s[r]
            out.append(c)
        return "".join(reversed(out)) + "." + tld

    # Places depend on the groups only, not on their digits or letters; `order` may ask for more.

    @staticmethod
    def card_valid(value: str, order: int = 0) -> bool:
        if value[0] not in ("6" if order == 1 else "23456"):
            return False
        d = re.sub("[ -]", "", value)
        return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1]

    @staticmethod
    def iban_valid(value: str, order: int = 1) -> bool:
        v = value.replace(" ", "")
        return (15 <= len(v) <= 34 and (order > 0 or IBAN_LENGTH.get(v[:2]) == len(v))
                and iban_check(v[:2], v[4:]) == v[2:4])

    def card(self, value: str, back=False) -> str | None:
        if not self.card_valid(value):
            return None
        d = re.sub("[ -]", "", value)
        # The issuer class (first digit) stays, the check digit follows.
        body = d[0] + self._digits("card" + d[0], d[1:-1], back)
        return put_digits(value, body + luhn_digit(body))

    def iban(self, value: str, back=False) -> str | None:
        if not self.iban_valid(value):
            return None
        v = value.replace(" ", "")
        country, body = v[:2], v[4:]
        sets = [string.digits if c.isdigit() else string.ascii_uppercase for c in body]
        x, n = 0, 1
        for c, s in zip(body, sets):
            x, n = x * len(s) + s.index(c), n * len(s)
        y, out = self._permute("iban:" + "".join("d" if s is string.digits else "a" for s in sets),
                               x, n, back), []
        for s in reversed(sets):
            y, r = divmod(y, len(s))
            out.append(s[r])
        new = "".join(reversed(out))
        it = iter(country + iban_check(country, new) + new)
        return "".join(" " if c == " " else next(it) for c in value)

    def ipv4(self, value: str, back=False) -> str | None:
        octets = [int(o) for o in value.split(".")]
        if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in value.split(".")):
            return None
        x = int.from_bytes(bytes(octets), "big")
        return ".".join(map(str, self._permute("ipv4", x, 1 << 32, back).to_bytes(4, "big")))

    def ssn(self, value: str, back=False) -> str | None:
        area, group, serial = (int(p) for p in value.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        areas = area - 1 - (area > 666)
        y = self._permute("ssn", (areas * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, back)
        y, serial = divmod(y, 9999)
        area, group = divmod(y, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def date(self, value: str, back=False) -> str | None:
        y, s, m, d, d2, s2, m2, y2 = self.DATE.fullmatch(value).groups()
        iso, sep = y is not None, s or s2
        parts = [y, m, d] if iso else [y2, m2, d2]
        swapped = not iso and int(parts[1]) > 12     # month first
        if swapped:
            parts[1], parts[2] = parts[2], parts[1]
        try:
            day = datetime.date(*map(int, parts))
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        # Days up to 12 and later days are permuted apart, so day and month never change places.
        days = self._days(day.day > 12)
        new = days[self._permute(f"date{day.day > 12}", bisect.bisect_left(days, day), len(days), back)]
        if iso:
            return f"{new.year:04d}{sep}{new.month:02d}{sep}{new.day:02d}"
        a, b = (new.month, new.day) if swapped else (new.day, new.month)
        return f"{a:02d}{sep}{b:02d}{sep}{new.year:04d}"

    def _days(self, late: bool) -> list[datetime.date]:
        if late not in self.days:
            each = map(datetime.date.fromordinal,
                       range(FIRST_DAY.toordinal(), LAST_DAY.toordinal() + 1))
            self.days[late] = [d for d in each if (d.day > 12) == late]
        return self.days[late]

    def phone(self, value: str, back=False) -> str | None:
        code = re.match(r"\+([0-9]{1,3})(?=[ .(-])", value)
        head, rest = (value[:code.end()], value[code.end():]) if code else ("", value)
        digits = re.sub("[^0-9]", "", rest)
        plain = not code and value[0] != "+"     # no country code: more evidence is asked for
        if not 7 <= len(digits) <= 15 or plain and (len(digits) < 9 or not set("(-.") & set(value)):
            return None
        return head + put_digits(rest, self._digits("phone" + head, digits, back))

    KINDS = ("email", "iban", "ipv4", "date", "ssn", "card", "phone")   # first match wins

    def replace(self, kind: str, value: str, back=False) -> str | None:
        k = (kind, value, back)
        if k not in self.seen:
            if len(self.seen) >= MAX_CACHED:
                self.seen.clear()
            self.seen[k] = getattr(self, kind)(value, back)
        return self.seen[k]

    def _card_places(self, text: str, start: int, end: int):
        """(order, start, end) of the places in a run of digit groups that may hold a card.

        Up to CARD_GROUPS groups all rows of groups with 13-19 digits are tried;
        of more groups the longest row from the left or at the end of the run,
        and rows of equal groups between others.
        """
        groups = [m.span() for m in re.compile("[0-9]+").finditer(text, start, end)]
        size = [e - s for s, e in groups]
        left = 0                                          # where the longest row from the left starts
        for i, (s, _) in enumerate(groups):
            n, ends = 0, []
            for j in range(i, len(groups)):
                n += size[j]
                if n > 19:
                    break
                if n >= 13:
                    ends.append(j)
            first = i == left
            if first:
                left = ends[-1] + 1 if ends else i + 1
            for j in ends:
                shape = tuple(size[i:j + 1])
                order = 0 if i == j else CARD_SHAPES.get(shape, 4)
                if order == 3:
                    yield 1, s, groups[j][1]              # for issuers with longer numbers
                alike = (len(set(shape)) == 1 and (i == 0 or size[i - 1] != size[i])
                         and (j + 1 == len(groups) or size[j + 1] != size[j]))
                last = j + 1 == len(groups) and (i == 0 or sum(size[i - 1:]) > 19)
                if len(shape) <= CARD_GROUPS or first and j == ends[-1] or alike or last:
                    yield order, s, groups[j][1]

    def _iban_places(self, text: str, start: int, end: int):
        """(order, start, end) of the places in a run of groups that may hold an IBAN."""
        groups = [m.span() for m in re.compile("[A-Z0-9]+").finditer(text, start, end)]
        for i, (s, _) in enumerate(groups):
            if not re.compile("[A-Z]{2}[0-9]{2}").match(text, s):
                continue
            n = 0
            for b, e in (groups[j] for j in range(i, len(groups))):
                n += e - b
                if n > 34:
                    break
                if n >= 15 and self.IBAN.fullmatch(text[s:e]):
                    yield 0, s, e                         # if the length is that of the country
                    yield 1, s, e

    def _in_runs(self, kind: str, text: str, taken: list[tuple[int, int]], back: bool):
        """Cards or IBANs outside the places in `taken` (sorted), as (start, end, kind, new value)."""
        places, valid = getattr(self, f"_{kind}_places"), getattr(self, f"{kind}_valid")
        for run in getattr(self, f"{kind.upper()}_RUN").finditer(text):
            a, b = run.span()
            used = bytearray(b - a)
            k = max(0, bisect.bisect_left(taken, (a, a)) - 1)
            while k < len(taken) and taken[k][0] < b:
                for at in range(max(a, taken[k][0]), min(b, taken[k][1])):
                    used[at - a] = 1
                k += 1
            chosen, failed = [], {}                       # failed: start -> (end, order)
            for order, s, e in sorted(places(text, a, b), key=lambda p: (p[0], p[1], -p[2])):
                if 1 in used[s - a:e - a]:
                    continue
                if not valid(text[s:e], order):
                    failed.setdefault(s, []).append((e, order))
                    continue
                used[s - a:e - a] = b"\1" * (e - s)
                chosen.append((s, e, [(p, q, o) for p in range(max(a, s - LONGEST_PLACE), e)
                                      for q, o in failed.get(p, ()) if q > s]))
            now = list(text[a:b]) if chosen else []
            for s, e, before in reversed(chosen) if back else chosen:
                new = text[s:e]
                while True:
                    new = self.replace(kind, new, back)
                    now[s - a:e - a] = new
                    if not any(valid("".join(now[p - a:q - a]), o) for p, q, o in before):
                        break
                yield s, e, kind, new

    def rewrite(self, text: str, back=False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with all valid values replaced, and their spans in the given text."""
        found, taken = [], []
        for kind in self.KINDS:
            if kind == "email" and "@" not in text:
                continue
            if kind in ("card", "iban"):
                found += self._in_runs(kind, text, taken, back)
                taken = sorted((s, e) for s, e, _, _ in found)
                continue
            for m in getattr(self, kind.upper()).finditer(text):
                k = bisect.bisect_left(taken, (m.end(),))
                if k and taken[k - 1][1] > m.start():
                    continue
                new = self.replace(kind, m.group(), back)
                if new is not None:
                    found.append((m.start(), m.end(), kind, new))
            taken = sorted((s, e) for s, e, _, _ in found)
        found.sort()
        out, at = [], 0
        for s, e, _, new in found:
            out += [text[at:s], new]
            at = e
        return "".join(out) + text[at:], [(k, s, e) for s, e, k, _ in found]


def pseudonymise(text: Column, key: str = DEFAULT_KEY, back: bool = False) -> Column:
    """Struct of the rewritten text, the number of values, and their spans in `text`.

    `back=True` reverses pseudonyms under the same key.  Defined cases: a null
    text stays null with 0 values; an empty text stays empty; invalid values
    (wrong check digit, impossible date, octet above 255) stay as they are;
    spans never overlap, and a place that two patterns fit goes to the kind
    named first in `Pseudonyms.KINDS`.  A day and month both up to 12 read as
    day first; days and months come back with two digits.  Dates outside
    1900-2099 stay.
    """
    @F.pandas_udf(SCHEMA)
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = Pseudonyms(key)
        for texts in batches:
            rows = []
            for t in texts:
                if not isinstance(t, str):
                    rows.append((None, 0, []))
                else:
                    new, spans = p.rewrite(t, back)
                    rows.append((new, len(spans),
                                 [{"kind": k, "start": s, "end": e} for k, s, e in spans]))
            yield pd.DataFrame(rows, columns=["text", "n_found", "spans"])

    found = rewrite(F.when(text.rlike("[0-9@]"), text))
    return F.struct(F.coalesce(found["text"], text).alias("text"),
                    found["n_found"].alias("n_found"), found["spans"].alias("spans"))
