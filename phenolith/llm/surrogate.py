"""Surrogates for personal data: keyed, type-consistent replacements.

Entities are found by form (addresses of mail and hosts, telephone, card, bank
and social-security numbers, credentials, dates of birth after a word that says so) and names by title or by a list of
given names; the parts of a name so found are then replaced wherever the text
has them, as kinds ``name`` and ``surname``.  Each is replaced by the next element of a keyed cycle over all
strings of its format: a Feistel network over mixed radices, whose digits keep
the class of every character (decimal digit, case, vowel or consonant, script; letters of
scripts without an alphabet here their block of code points),
numbered, stepped by one and numbered back.  Such a map is one to one and has no
fixed point, so different entities stay different, the same entity is the same
everywhere in a corpus, and no entity with a digit or letter stays as it was; elements of another kind
(a public address for a private one, a listed name for an unlisted one) are
stepped over, which keeps all that.  Given names take their surrogate from
the list of their gender and script; unlisted ones keep their last letter, which
often carries gender.  Card and bank numbers get check digits that hold or fail
as before.

No state is shared: tasks need the key alone.  Each text's surrogates are checked to be distinct where the
entities are, ``collisions`` checks a corpus.  Defined results: a masked secret (``****``) is none; a null text
stays null and has no entities; an empty one stays empty; entities that overlap
are taken from the left, the longest first; other columns stay as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolith.llm.kernel import LETTERS, buffers, slices, words

#: Given names by script and gender, family names by script, titles by gender.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Barbara Carla Carmen Caroline Charlotte Clara Claudia Elena Elisabeth Emily Emma Eva Grace Hannah Helen Ingrid Isabel Jane Jessica Julia Karen Laura Linda Lisa Lucy Margaret Maria Martha Mary Monica Nancy Nicole Olivia Patricia Rosa Sarah Sophie Susan Teresa Ursula Victoria".split(),
    ("latin", "m"): "Adam Albert Alexander Andrew Anthony Antonio Benjamin Bruno Carlos Charles Christian Daniel David Edward Felix Francisco Frank George Hans Henry Hugo James Jean John Joseph Juan Karl Kevin Lucas Luis Mark Martin Michael Oliver Oscar Paul Peter Philip Pierre Richard Robert Stephen Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Галина Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Борис Владимир Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}
FAMILY = {
    "latin": "Adams Baker Becker Bernard Brown Carter Clark Collins Cooper Davis Dubois Durand Evans Fischer Garcia Gomez Green Hall Harris Hernandez Hill Hoffmann Hughes Jackson Johnson Jones King Klein Lambert Laurent Lewis Lopez Martinez Meyer Miller Mitchell Moore Moreau Morris Nelson Parker Perez Phillips Roberts Robinson Rodriguez Rousseau Sanchez Schmidt Schneider Schulz Scott Simon Smith Taylor Thompson Torres Turner Wagner Walker Weber White Wilson Wright Young".split(),
    "cyrillic": "Волков Иванов Козлов Кузнецов Лебедев Морозов Новиков Петров Смирнов Соколов".split(),
}
TITLES = {"m": "Mr Sir Herr Monsieur Señor Sr Mister Lord господин".split(), "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Lady госпожа".split(), "": "Dr Prof Professor Doctor".split()}
CREDENTIALS = "password passwd pwd secret token api_key apikey api-key access_key access-key".split()

#: Words that a date of birth follows.
BIRTH = ["born on", "born", "date of birth", "dob", "birthday", "geboren am", "geb.", "né le", "née le", "nacido el", "nacida el"]

_GENDER = {n: (s, g) for (s, g), names in GIVEN.items() for n in names}
_FAMILY = {n: s for s, names in FAMILY.items() for n in names}
_TITLE = {t: g for g, ts in TITLES.items() for t in ts}
_NAME = r"[A-ZÀ-ÖØ-ÞĀ-ŽА-Я][\w'’]*[^\W\d_](?:-[A-ZÀ-ÖØ-ÞА-Я]\w+)?"
#: Telephone numbers grouped as in Europe: after a country code other than 1, with a trunk 0 (pairs, or an area and a number), and Spanish ones.
_NATIONAL = r"(?<![\w.+\-])(?:" + "|".join([
    r"\+(?!1\b)\d{1,3}(?:[ .\-]?\(0\))?(?:[ .\-]\(?\d{1,8}\)?){2,5}",
    r"0\d(?:[ .\-]\d{2}){4}",
    r"(?:\(0\d{1,4}\) ?|0\d{1,4}[ /\-])\d{5,8}",
    r"(?:\(0\d{1,4}\) ?|0\d{1,4}[ /\-])\d{2,4}(?:[ \-]\d{2,4}){1,3}",
    r"[6-9]\d(?: \d{3})(?: \d{2}){2}|[6-9]\d{2}(?: \d{2}){3}",
]) + r")(?![\w\-]|\.\d)"
#: Each kind's form, earlier ones first where two begin at one place.
_FORMS = [
    r"(?P<mail>(?<![\w.%+\-])[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+)",
    r"(?P<host>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))",
    r"(?P<host6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[23][0-9A-Fa-f]{3}|[Ff][CDEcde][0-9A-Fa-f]{2})(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:]))",
    r"(?P<birth>(?i:(?<!\w)(?:" + "|".join(map(re.escape, BIRTH)) + r"))(?P<span>[:\s]{1,3})(?P<date>\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./\-]\d{1,2}[./\-]\d{4})(?!\w))",
    r"(?P<secret>(?i:(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, CREDENTIALS)) + r"))(?P<lead>\s?[=:]\s?[\"']?)(?P<value>[^\s\"']{4,}))",
    r"(?P<access>(?<!\w)AKIA[0-9A-Z]{12,20}(?!\w))",
    r"(?P<bank>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
    r"(?P<social>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))",
    r"(?P<card>(?<![\w.+])\d(?:[ \-]?\d){12,18}(?!\w))",
    r"(?P<phone>" + _NATIONAL + r"|(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![\w\-]|\.\d)|(?<!\w)\+\d{7,15}(?!\w))",
    r"(?P<person>(?<!\w)(?P<title>" + "|".join(sorted(_TITLE, key=len, reverse=True)) + rf")(?P<gap>\.? +)(?P<named>{_NAME}(?: +{_NAME})?))",
    r"(?P<given>(?<!\w)(?:" + "|".join(sorted(_GENDER, key=len, reverse=True)) + rf") +{_NAME})",
]
_ENTITY = re.compile("|".join(_FORMS))
KINDS = ("host6", "birth", "mail", "secret", "access", "bank", "social", "phone", "card", "host", "person", "given")

_ALPHABETS = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "çñßřšžłđ"]
_CLASS = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
#: First and last letters of scripts that are numbered by code point (hiragana, katakana, ideographs, Hangul, Hebrew, Arabic, Devanagari, Thai, Georgian, Armenian).
_BLOCKS = [(0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x05D0, 0x05EA), (0x0621, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x10D0, 0x10F0), (0x0561, 0x0586)]
_LOWER = {u: l for u, l in zip("AEIOU", "aeiou", strict=True)} | {c: c.lower() for c in _ALPHABETS[4]}
_HEX = {c: (a, i) for a in ("0123456789", "abcdef", "ABCDEF") for i, c in enumerate(a)}
_HIGH = "23456789"  # leading digits of an area or exchange keep to one side of 2
_LEAD = {c: ("01", i) for i, c in enumerate("01")} | {c: (_HIGH, i) for i, c in enumerate(_HIGH)}


@lru_cache(4096)
def _block(c: str) -> tuple[str, int] | None:
    """The letters of a character's script and its place among them, where code points number it."""
    return next(((_letters(lo, hi), ord(c) - lo) for lo, hi in _BLOCKS if lo <= ord(c) <= hi), None)


@lru_cache(None)
def _letters(lo: int, hi: int) -> str:
    return "".join(map(chr, range(lo, hi + 1)))


class Cycle:
    """The keyed cycle over tuples of digits of given radices."""

    def __init__(self, key: bytes, kind: str):
        self.key, self.kind = hashlib.blake2b(key, digest_size=32).digest(), kind.encode()[:16]
        self.rings: dict[int, list[int]] = {}

    def _f(self, i: int, radices: tuple[int, ...], x: int, of: int) -> int:
        data = repr((i, radices, x)).encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, person=self.kind, digest_size=32).digest(), "big") % of

    def _feistel(self, a: int, b: int, na: int, nb: int, radices: tuple[int, ...], back: bool) -> tuple[int, int]:
        for i in reversed(range(8)) if back else range(8):
            if i % 2:
                b = (b + (-1 if back else 1) * self._f(i, radices, a, nb)) % nb
            else:
                a = (a + (-1 if back else 1) * self._f(i, radices, b, na)) % na
        return a, b

    def _ring(self, n: int) -> list[int]:
        """What follows each of n numbers in a keyed round."""
        if n not in self.rings:
            order = sorted(range(n), key=lambda i: self._f(i, (n,), 0, 1 << 64))
            self.rings[n] = [b for _, b in sorted(zip(order, [*order[1:], order[0]], strict=True))]
        return self.rings[n]

    def next(self, digits: list[int], radices: tuple[int, ...]) -> list[int]:
        if len(radices) == 1:  # no halves to mix
            return [self._ring(radices[0])[digits[0]]]
        half = (len(radices) + 1) // 2
        na, nb = _product(radices[:half]), _product(radices[half:])
        a, b = self._feistel(_number(digits[:half], radices[:half]), _number(digits[half:], radices[half:]), na, nb, radices, False)
        a, b = divmod((a * nb + b + 1) % (na * nb), nb)
        a, b = self._feistel(a, b, na, nb, radices, True)
        return _digits(a, radices[:half]) + _digits(b, radices[half:])

    def text(self, s: str, lead: tuple[int, ...] = (), fixed: tuple[int, ...] = (), fold: bool = False, classes: dict = _CLASS) -> str:
        """The string after s among those of its format; ``lead`` digits keep to one side of 2,
        ``fixed`` places stay, ``fold`` numbers upper and lower case alike."""
        at, digits, radices, sets = [], [], [], []
        for i, c in enumerate(s):
            low = _LOWER.get(c, c) if fold else c
            known = _LEAD.get(c) if i in lead else classes.get(low) or _block(low)
            if known and i not in fixed:
                at.append(i)
                digits.append(known[1])
                radices.append(len(known[0]))
                sets.append((known[0], low != c))
        if not at:
            return s
        out = list(s)
        for i, d, (alphabet, upper) in zip(at, self.next(digits, tuple(radices)), sets, strict=True):
            out[i] = alphabet[d].upper() if upper else alphabet[d]
        return "".join(out)


def _product(x: tuple[int, ...]) -> int:
    out = 1
    for r in x:
        out *= r
    return out


def _number(digits: list[int], radices: tuple[int, ...]) -> int:
    out = 0
    for d, r in zip(digits, radices, strict=True):
        out = out * r + d
    return out


def _digits(x: int, radices: tuple[int, ...]) -> list[int]:
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` + it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _bank_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _host_kind(o: tuple[int, ...]) -> str:
    if o[0] == 10 or o[:2] == (192, 168) or (o[0] == 172 and 16 <= o[1] < 32):
        return f"private {o[0]}"
    return "special" if o[0] in (0, 127) or o[0] >= 224 or o[:2] == (169, 254) else "public"


def _refill(form: str, chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in form)


_DAYS = range(datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 2).toordinal())  # 150 x 487 days


class Surrogates:
    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = key
        self.cycle = {k: Cycle(key, k) for k in (*KINDS, "domain", "name", "family")}
        self.order = {k: self._ring(k, names) for k, names in [*GIVEN.items(), *FAMILY.items()]}
        self.replace = lru_cache(100_000)(self._replace)

    def _ring(self, kind, names: list[str]) -> dict[str, str]:
        keyed = sorted(names, key=lambda n: hashlib.blake2b(repr((kind, n)).encode(), key=self.key[:64]).digest())
        return dict(zip(keyed, [*keyed[1:], keyed[0]], strict=True))

    def _replace(self, kind: str, s: str) -> str:
        return getattr(self, f"_{kind}")(s)

    def _mail(self, s: str) -> str:
        local, _, domain = s.rpartition("@")
        *labels, top = domain.split(".")
        return self.cycle["mail"].text(local, fold=True) + "@" + ".".join([x if x.lower() == "example" else self.cycle["domain"].text(x, fold=True) for x in labels] + [top])

    def _secret(self, s: str) -> str:
        return self.cycle["secret"].text(s, classes=_HEX if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s) else _CLASS)

    def _access(self, s: str) -> str:
        return self.cycle["access"].text(s, fixed=(0, 1, 2, 3))

    def _social(self, s: str) -> str:
        return self.cycle["social"].text(s)

    def _phone(self, s: str) -> str:
        digits = re.sub(r"\D", "", s)
        code = len(re.sub(r"\D", "", re.match(r"\+\d{1,3}(?=[ .\-(])|", s)[0])) or (max(0, len(digits) - 10) if s[0] == "+" else 0)
        code += digits[code : code + 1] == "0" and len(digits) - code > 8  # a trunk 0 stays, so both ways to write a number agree
        own = digits[code:]
        lead = (0, 3) if len(own) == 10 else (0,)
        return _refill(s, digits[:code] + self.cycle["phone"].text(own, lead))

    def _card(self, s: str) -> str:
        digits = re.sub(r"\D", "", s)
        body = self.cycle["card"].text(digits[:-1], fixed=(0,))
        return _refill(s, body + str((luhn(body) + int(digits[-1]) - luhn(digits[:-1])) % 10))

    def _bank(self, s: str) -> str:
        plain = s.replace(" ", "")
        country, check, body = plain[:2], int(plain[2:4]), plain[4:]
        new = self.cycle["bank"].text(body)
        shift = (check - _bank_check(country, body)) % 100
        return _refill(s, f"{country}{(_bank_check(country, new) + shift) % 100:02d}{new}")

    def _host(self, s: str) -> str:
        """Private and special addresses change within their own net, public ones among the public."""
        now = tuple(int(x) for x in s.split("."))
        kind = _host_kind(now)
        if kind == "public":
            while True:
                now = tuple(self.cycle["host"].next(list(now), (256,) * 4))
                if _host_kind(now) == kind:
                    return ".".join(map(str, now))
        if now[0] == 172:
            second, *rest = self.cycle["host"].next([now[1] - 16, *now[2:]], (16, 256, 256))
            return ".".join(map(str, (172, 16 + second, *rest)))
        kept = 2 if now[:2] in ((192, 168), (169, 254)) else 1
        return ".".join(map(str, (*now[:kept], *self.cycle["host"].next(list(now[kept:]), (256,) * (4 - kept)))))

    def _host6(self, s: str) -> str:
        """Digits change within their kind and case; the first group, which tells the kind of net, stays."""
        return self.cycle["host6"].text(s, fixed=tuple(range(s.index(":"))), classes=_HEX)

    def _birth(self, s: str) -> str:
        """Another day of the two centuries from 1900, written alike; dates that aren't any change digit by digit."""
        a, x, b, y, c = re.match(r"(\d+)(\D)(\d+)(\D)(\d+)", s).groups()
        place = (0, 1, 2) if len(a) == 4 else (2, 0, 1) if x == "/" and int(b) > 12 else (2, 1, 0)  # of year, month and day
        given = [int((a, b, c)[p]) for p in place]
        try:
            day = datetime.date(*given).toordinal() - _DAYS.start
        except ValueError:
            day = -1
        if not 0 <= day < len(_DAYS):
            return self.cycle["birth"].text(s)
        high, low = self.cycle["birth"].next([*divmod(day, 487)], (len(_DAYS) // 487, 487))
        new = datetime.date.fromordinal(_DAYS.start + high * 487 + low)
        out = ["", "", ""]
        for p, v in zip(place, (new.year, new.month, new.day), strict=True):
            out[p] = f"{v:0{4 if v > 31 else len((a, b, c)[p])}d}"
        return f"{out[0]}{x}{out[1]}{y}{out[2]}"

    def _name(self, s: str) -> str:
        if s in _GENDER:
            return self.order[_GENDER[s]][s]
        return self._unlisted(s, "name")

    def _surname(self, s: str) -> str:
        return self.order[_FAMILY[s]][s] if s in _FAMILY else self._unlisted(s, "family")

    def _unlisted(self, s: str, kind: str) -> str:
        fixed = (len(s) - 1,) if kind == "name" and len(s) > 2 else ()
        now = s
        while True:
            now = self.cycle[kind].text(now, fixed=fixed)
            if now not in _GENDER and now not in _FAMILY:
                return now

    def _given(self, s: str) -> str:
        first, gap, last = re.match(r"(\S+)( +)(.+)", s).groups()
        return self.replace("name", first) + gap + "-".join(self.replace("surname", x) for x in last.split("-"))

    def _person(self, s: str) -> str:
        """A titled name: with two parts a given and a family name, else a family name unless listed."""
        m = re.match(r"(\S+)( +)(.+)", s)
        if m:
            return self.replace("name", m[1]) + m[2] + "-".join(self.replace("surname", x) for x in m[3].split("-"))
        return self.replace("name", s) if s in _GENDER else "-".join(self.replace("surname", x) for x in s.split("-"))

    def apply(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with surrogates, and (kind, start, length, surrogate) of each entity in the original."""
        found = []
        for m in _ENTITY.finditer(text):
            kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k] is not None)
            start, end = m.span(kind)
            if kind == "secret":
                start, end = m.span("value")
                while end - start > 4 and text[end - 1] in ".,;)]}":
                    end -= 1
            elif kind == "mail":
                while text[end - 1] in "-_":
                    end -= 1
            elif kind == "person":
                start, end = m.span("named")
            elif kind == "birth":
                start, end = m.span("date")
            elif kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                continue
            elif kind == "host" and any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in m[0].split(".")):
                continue
            if (new := self.replace(kind, text[start:end])) != text[start:end]:
                found.append((kind, start, end - start, new))
        found += self._mentions(text, found)
        found.sort(key=lambda f: f[1])
        self._check(text, found)
        out, at = [], 0
        for _, start, length, new in found:
            out += [text[at:start], new]
            at = start + length
        return ("".join(out) + text[at:] if found else text), found

    @staticmethod
    def _check(text: str, found: list[tuple[str, int, int, str]]) -> None:
        """Different entities have different surrogates, and an entity has one."""
        there: dict[tuple[str, str], str] = {}
        back: dict[tuple[str, str], str] = {}
        for kind, start, length, new in found:
            old = text[start : start + length]
            if there.setdefault((kind, old), new) != new or back.setdefault((kind, new), old) != old:
                raise ValueError(f"surrogates of kind {kind} collide")

    def _mentions(self, text: str, found: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
        """Bare given and family names of the persons found, wherever else the text has them, with the surrogates they have there."""
        kinds: dict[str, str] = {}
        for kind, start, length, _ in found:
            if kind in ("person", "given"):
                first, *last = text[start : start + length].split()
                if last or first in _GENDER:
                    kinds.setdefault(first, "name")
                for x in last or [first]:
                    kinds.setdefault(x, "surname")
        if not kinds:
            return []
        taken = np.zeros(len(text), bool)
        for _, start, length, _ in found:
            taken[start : start + length] = True
        names = re.compile(r"(?<![\w\-])(?:" + "|".join(map(re.escape, sorted(kinds, key=len, reverse=True))) + r")(?![\w\-])")
        new = lambda x: "-".join(self.replace("surname", y) for y in x.split("-")) if kinds[x] == "surname" else self.replace("name", x)
        return [(kinds[m[0]], m.start(), m.end() - m.start(), new(m[0])) for m in names.finditer(text) if not taken[m.start() : m.end()].any()]


def _trigger_words() -> np.ndarray:
    w = words(pa.array([" ".join([*_TITLE, *_GENDER, *CREDENTIALS, "akia"])]), LETTERS)
    return np.unique(w.hash)


def _may_hold(col: pa.Array, triggers: np.ndarray) -> np.ndarray:
    """Texts with a digit, an @, or a word that names or credentials begin with."""
    raw, off = buffers(col)
    sign = np.concatenate(([0], np.cumsum(((raw >= 48) & (raw < 58)) | (raw == 64))))
    out = sign[off[1:]] > sign[off[:-1]]
    w = words(col, LETTERS)
    small = np.zeros(1 << 16, bool)
    small[(triggers & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(small[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
    at = at[np.isin(w.hash[at], triggers)]
    out[np.searchsorted(w.first[1:], at, "right")] = True
    return out


ENTITIES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("surrogate", T.StringType())]))


def pseudonymize(df: DataFrame, key: bytes, *, text: str = "text", entities: str | None = "entities") -> DataFrame:
    """``df`` with surrogates in ``text`` and, unless None, a column of the entities found
    (places are in the original text); a column of that name is replaced."""
    fields = [f for f in df.schema.fields if f.name != entities]
    fields = [T.StructField(f.name, T.StringType()) if f.name == text else f for f in fields]
    schema = T.StructType(fields + ([T.StructField(entities, ENTITIES)] if entities else []))
    kept = df.select(*[F.col(f"`{f.name}`").cast("string") if f.name == text else F.col(f"`{f.name}`") for f in fields])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, triggers = Surrogates(key), _trigger_words()
        for b in slices(batches, text):
            i = b.schema.get_field_index(text)
            col = b.column(i)
            may = _may_hold(col, triggers)
            found: list[list] = [[] for _ in range(b.num_rows)]
            if may.any():
                new = col.to_pylist()
                for r in np.flatnonzero(may).tolist():
                    if new[r]:
                        new[r], hits = maker.apply(new[r])
                        found[r] = [dict(zip(("kind", "start", "length", "surrogate"), h, strict=True)) for h in hits]
                col = pa.array(new, pa.string())
            cols = [col if j == i else b.column(j) for j in range(b.num_columns)]
            names = list(b.schema.names)
            if entities:
                cols.append(pa.array(found, kind))
                names.append(entities)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return kept.mapInArrow(run, schema)


def collisions(df: DataFrame, entities: str = "entities", text: str = "text") -> DataFrame:
    """Surrogates that stand for more than one entity; ``df`` holds original texts beside ``entities``."""
    one = df.select(text, F.explode(entities).alias("e")).select("e.kind", "e.surrogate", F.substring(F.col(text), F.col("e.start") + 1, F.col("e.length")).alias("original"))
    return one.groupBy("kind", "surrogate").agg(F.countDistinct("original").alias("n")).filter("n > 1")
