"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Every kind of entity has a finite set of values of one format (so many letters
and digits in these places; the given names of one gender and script), and the
surrogate is the next value on one secret cycle through that set: a keyed
permutation, one step on, and the permutation undone.  So two entities of one
format never share a surrogate, none is its own, and an entity has the same
surrogate in every document, without a table of entities and whatever its
spelling in case or separators.  ``collisions`` checks that on the entities of a
whole corpus; of entities that still share one, all but the first go further
round the cycle until none does.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import math
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.shared import released, small_batches, stored

# Common given names by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Barbara Camille Carla Carmen Charlotte Chloe Claudia Elena Elisabeth Emily Emma Eva Hannah Helen Ines Isabel Jane Jennifer Julia Karen Laura Linda Lucia Maria Marie Martina Mary Olivia Patricia Petra Rosa Sarah Sofia Sophie Susan Teresa Ursula".split(),
    ("m", "latin"): "Adam Alexander Antonio Carlos Charles Daniel David Edward Felix Francisco George Hans Henri Jack James Jean John Jorge Jose Juan Karl Klaus Louis Luis Manuel Mark Martin Michael Miguel Oliver Patrick Paul Peter Philippe Pierre Richard Robert Thomas Walter William".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("f", "greek"): "Άννα Βασιλική Ελένη Ζωή Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Στέλιος".split(),
}
# Titles that tell a person's name, by gender; "" is either.
TITLES = {"Mrs": "f", "Ms": "f", "Miss": "f", "Madame": "f", "Mme": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Госпожа": "f", "Mr": "m", "Sir": "m", "Monsieur": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Dr": "", "Prof": ""}
_GENDER = {n: k for k, names in GIVEN.items() for n in names}
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "digit": "0123456789"}
_CLASS = {c: (alphabet, i) for alphabet in _LETTERS.values() for i, c in enumerate(alphabet)}


class Cycle:
    """A keyed cycle through the tuples of digits with given radices (an unbalanced Feistel network and a count)."""

    ROUNDS = 8

    def __init__(self, key: bytes, kind: str, steps: int = 1) -> None:
        self.key, self.kind, self.steps = key, kind.encode(), steps

    def _shift(self, r: int, left: tuple[int, ...], radices: tuple[int, ...]) -> list[int]:
        message = b"%s|%d|%r|%r" % (self.kind, r, left, radices)
        stream = int.from_bytes(hmac.new(self.key, message, hashlib.sha256).digest() + hashlib.sha512(self.key + message).digest(), "big")
        out = []
        for k, radix in enumerate(radices):
            if k and k % 20 == 0:
                stream = int.from_bytes(hashlib.sha512(self.key + message + b"%d" % k).digest(), "big")
            stream, x = divmod(stream, radix)
            out.append(x)
        return out

    def _permute(self, digits: list[int], radices: list[int], sign: int) -> list[int]:
        if len(digits) == 1:
            # One digit is walked through as two of a slightly larger range, else nothing would be keyed.
            n = radices[0]
            low = math.isqrt(max(0, n - 1)) + 1
            x = digits[0]
            while True:
                high_low = self._permute(list(divmod(x, low)), [-(-n // low), low], sign)
                x = high_low[0] * low + high_low[1]
                if x < n:
                    return [x]
        half = len(digits) // 2
        d = list(digits)
        for r in range(self.ROUNDS) if sign > 0 else reversed(range(self.ROUNDS)):
            fixed, moved = (slice(0, half), slice(half, None)) if r % 2 else (slice(half, None), slice(0, half))
            shift = self._shift(r, tuple(d[fixed]), tuple(radices[moved]))
            d[moved] = [(x + sign * s) % m for x, s, m in zip(d[moved], shift, radices[moved], strict=True)]
        return d

    def next(self, digits: list[int], radices: list[int]) -> list[int]:
        d = self._permute(digits, radices, 1)
        for _ in range(self.steps):
            for k in reversed(range(len(d))):
                d[k] = (d[k] + 1) % radices[k]
                if d[k]:
                    break
        return self._permute(d, radices, -1)

    def within(self, digits: list[int], radices: list[int], member: Callable[[list[int]], bool]) -> list[int]:
        """The next on the cycle that is a member of the same class as digits, which is one."""
        d = self.next(digits, radices)
        while not member(d):
            d = self.next(d, radices)
        return d


def _luhn(digits: list[int]) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


@functools.cache
def _block(c: str) -> tuple[str, int] | None:
    """The alphabet of a letter or digit, which is of c's own script and kind, and c's place in it; None for other characters.

    Letters beyond the stated alphabets are those of their script (the first word
    of the Unicode name) with the same category, and, of two cases, the lower ones
    whose upper case is one letter that leads back.
    """
    if c in _CLASS:
        return _CLASS[c]
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return None
    alphabet = _scripts().get(_script(c), c)
    return (alphabet, alphabet.index(c)) if c in alphabet else None


def _script(c: str) -> tuple[str, str, bool]:
    upper = c.upper()
    return unicodedata.name(c, "?").split(" ")[0].split("-")[0], unicodedata.category(c), len(upper) == 1 and upper != c and upper.lower() == c


@functools.cache
def _scripts() -> dict[tuple[str, str, bool], str]:
    found: dict[tuple[str, str, bool], list[str]] = {}
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        # Lower-case and caseless characters only: capitals are respelt.
        if unicodedata.category(c)[0] in "LN" and c == c.lower() and c not in _CLASS:
            found.setdefault(_script(c), []).append(c)
    return {k: "".join(v) for k, v in found.items()}


def _plain(c: str) -> str:
    """c in lower case, where that is one letter that leads back to c."""
    low = c.lower()
    return low if len(low) == 1 and low.upper() == c else c


def _respell(template: str, letters: Iterator[str]) -> str:
    """letters in the places, and in the case, of those of the template that have a class."""
    out = []
    for c in template:
        if _block(_plain(c)):
            x = next(letters)
            out.append(x.upper() if c != _plain(c) else x)
        else:
            out.append(c)
    return "".join(out)


def _format_next(cycle: Cycle, text: str) -> str:
    """The surrogate of text among those with letters and digits of the same alphabets in the same places."""
    chars = [b for c in text if (b := _block(_plain(c)))]
    if not chars:
        return "*" * len(text)
    new = cycle.next([i for _, i in chars], [len(a) for a, _ in chars])
    return _respell(text, iter([a[i] for (a, _), i in zip(chars, new, strict=True)]))


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    canonical: str


_HOST = re.compile(r"@(?:[\w-]+\.)+[^\W\d_]{2,}")
_IP4 = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")
_IP6 = re.compile(r"(?<![\w:])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{6,39}(?![\w:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-]|\.\d)")
_NUMERAL = re.compile(r"\d")
_NAME = r"[^\W\d_a-zа-яα-ω][\w'’-]+"
_TITLED = re.compile(rf"\b(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? (?P<name>{_NAME}(?: {_NAME}){{0,2}})")
_GIVEN = re.compile(rf"\b(?P<given>{'|'.join(sorted(_GENDER, key=len, reverse=True))}) (?P<name>{_NAME})")
_HINTS = tuple(TITLES) + tuple(_GENDER)


def _addresses(text: str) -> Iterator[Entity]:
    """Mail addresses: a host after an "@", and what stands before it; each character is read once, however long a run of letters."""
    last = 0
    for m in _HOST.finditer(text):
        start = at = m.start()
        while start > last and (text[start - 1].isalnum() or text[start - 1] in "_.+%'-"):
            start -= 1
        own = text[start:at]
        if any(c.isalnum() or c == "_" for c in own[own.rfind("'") + 1 :]):
            yield Entity(start, m.end(), "email", text[start : m.end()].lower())
            last = m.end()
        else:
            last = at


def _numbers(text: str) -> Iterator[Entity]:
    if "." in text:
        for m in _IP4.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                yield Entity(*m.span(), "ip4", ".".join(str(int(x)) for x in m[0].split(".")))
    if "::" in text or text.count(":") > 4:
        for m in _IP6.finditer(text):
            try:
                yield Entity(*m.span(), "ip6", ipaddress.IPv6Address(m[0]).exploded)
            except ValueError:
                continue
    for m in _IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            yield Entity(*m.span(), "iban", code)
    for m in _SSN.finditer(text):
        yield Entity(*m.span(), "ssn", m[0])
    for m in _CARD.finditer(text):
        yield Entity(*m.span(), "card", re.sub(r"\D", "", m[0]))
    for m in _PHONE.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        # A bare run of digits is no phone number: a plus sign, brackets or separators tell one.
        if 9 <= len(digits) <= 15 and (m[0][0] in "+(" or "(" in m[0] or len(re.findall(r"[ .-]", m[0])) >= 2):
            yield Entity(*m.span(), "phone", ("+" if m[0][0] == "+" else "") + digits)


def detect(text: str) -> list[Entity]:
    """Entities of a text, left to right; of those that overlap the one that begins first, then the longer, stays."""
    found: list[Entity] = []
    if "@" in text:
        found += _addresses(text)
    if _NUMERAL.search(text):
        found += _numbers(text)
    if any(h in text for h in _HINTS):
        for pattern in (_TITLED, _GIVEN):
            for m in pattern.finditer(text):
                at = m.start("given") if pattern is _GIVEN else m.start("name")
                for word in re.finditer(r"[\w'’-]+", text[at : m.end()]):
                    name = word[0]
                    title = m.groupdict().get("title")
                    gender, script = _GENDER.get(name.capitalize(), ("", ""))
                    kind = f"given:{gender}:{script}" if gender and (not title or TITLES[title] in ("", gender)) else "family"
                    found.append(Entity(at + word.start(), at + word.end(), kind, name.capitalize() if kind != "family" else name.lower()))
        # Every later or earlier whole-word mention of a name of this text is that name too.
        names = {text[e.start : e.end]: e for e in found if e.kind == "family" or e.kind.startswith("given:")}
        if names:
            for m in re.finditer(r"[\w'’-]+", text):
                e = names.get(m[0]) or names.get(re.sub(r"['’]s$", "", m[0]))
                if e is not None:
                    found.append(Entity(m.start(), m.start() + e.end - e.start, e.kind, e.canonical))
    found.sort(key=lambda e: (e.start, -e.end))
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def surrogate(key: bytes, entity: Entity, spelt: str, steps: int = 1) -> str:
    """What replaces ``spelt``, a spelling of the entity: so many steps on its cycle."""
    kind = entity.kind
    cycle = Cycle(key, kind, steps)
    if kind == "email":
        local, _, domain = spelt.partition("@")
        name, _, top = domain.rpartition(".")
        return f"{_format_next(cycle, local + '@' + name)}.{top}"
    if kind == "ip4":
        digits = [int(x) for x in entity.canonical.split(".")]
        group = _ip_group(digits)
        return ".".join(map(str, cycle.within(digits, [256] * 4, lambda d: _ip_group(d) == group)))
    if kind == "ip6":
        digits = [int(x, 16) for x in entity.canonical.split(":")]
        return ipaddress.IPv6Address(":".join(f"{x:x}" for x in digits[:1] + cycle.next(digits[1:], [65536] * 7))).compressed
    if kind == "iban":
        digits = [int(c, 36) for c in entity.canonical[4:]]
        radices = [10 if c.isdigit() else 26 for c in entity.canonical[4:]]
        new = cycle.next([x if r == 10 else x - 10 for x, r in zip(digits, radices, strict=True)], radices)
        body = "".join(str(x) if r == 10 else chr(65 + x) for x, r in zip(new, radices, strict=True))
        check = 98 - int("".join(str(int(c, 36)) for c in body + entity.canonical[:2] + "00")) % 97
        return _refill(spelt, entity.canonical[:2] + f"{check:02d}" + body)
    if kind in ("card", "ssn", "phone"):
        digits = [int(c) for c in entity.canonical if c.isdigit()]
        keep = 1 if kind == "phone" and entity.canonical[0] == "+" else 0  # the country's zone
        if kind == "card":
            valid = _luhn(digits)
            new = cycle.within(digits, [10] * len(digits), lambda d: _luhn(d) == valid)
        else:
            new = digits[:keep] + Cycle(key, f"{kind}:{keep and digits[0]}", steps).next(digits[keep:], [10] * (len(digits) - keep))
        return _refill(spelt, "".join(map(str, new)))
    if kind.startswith("given:"):
        pool = GIVEN[tuple(kind.split(":")[1:])]
        new = pool[cycle.next([pool.index(entity.canonical)], [len(pool)])[0]]
        return new.upper() if spelt.isupper() and len(spelt) > 1 else new
    return _format_next(cycle, spelt)


def _ip_group(d: list[int]) -> int:
    address = ipaddress.IPv4Address(bytes(d))
    return 0 if address.is_global else 1 + (address.is_private and not address.is_loopback) if not address.is_multicast else 3


def _refill(template: str, chars: str) -> str:
    """chars in the places of the template's letters and digits."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in template)


def entity_id(key: bytes, kind: str, canonical: str) -> str:
    """A keyed hash that stands for an entity wherever it occurs."""
    return hmac.new(key, f"{kind}|{canonical}".encode(), hashlib.sha256).hexdigest()[:32]


def replace(key: bytes, text: str, further: Mapping[str, int] | None = None, make: Callable[[bytes, Entity, str, int], str] = surrogate) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and (start, end, kind, canonical, surrogate) of each entity in the old text.

    ``further`` has the steps, beyond the first, of those entities that go on round their cycle, by ``entity_id``.
    """
    out, at, found = [], 0, []
    for e in detect(text):
        steps = 1 + (further.get(entity_id(key, e.kind, e.canonical), 0) if further else 0)
        new = make(key, e, text[e.start : e.end], steps)
        out += [text[at : e.start], new]
        at = e.end
        found.append((e.start, e.end, e.kind, e.canonical, new))
    return "".join([*out, text[at:]]), found


_FOUND = "array<struct<start:int,end:int,kind:string,entity:string,surrogate:string>>"
MOST_CLASHES = 10_000  # entities whose further steps are sent to all tasks; beyond them rows meet these in a join
MOST_STEPS = 100  # rounds after which a format has no surrogate left


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True, make: Callable[[bytes, Entity, str, int], str] = surrogate) -> DataFrame:
    """doc_id, text with surrogates, and ``entities`` of every row.

    entities has start, end (code points of the old text), kind, a keyed hash of
    the entity (the same wherever it occurs) and its surrogate.  Null text stays
    null and has none; empty texts, repeated rows and null ids are rows like
    others; other columns are not read.  An empty table gives an empty one.
    With check, the result is stored and all its entities are held against each
    other; of those that share a surrogate all but the one with the least hash
    take a further step on their cycles, in all texts, until none share one;
    only where a format has fewer surrogates than there are entities is that an error.
    ``make`` gives an entity's surrogate after so many steps.
    """
    small_batches(docs.sparkSession)
    secret = key.encode()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))

    def made(rows: DataFrame, further: dict[str, int] | None) -> DataFrame:
        """With the steps given, or else those in the rows' own column ``steps``."""

        def replaced(texts: pa.Array, steps: list[dict[str, int]]) -> pa.Array:
            new = [(None, []) if t is None else replace(secret, t, s, make) for t, s in zip(texts.to_pylist(), steps, strict=True)]
            marks = [[{"start": s, "end": e, "kind": k, "entity": entity_id(secret, k, c), "surrogate": n} for s, e, k, c, n in found] for _, found in new]
            return pa.StructArray.from_arrays([pa.array([t for t, _ in new], pa.string()), pa.array(marks, kind)], ["text", "entities"])

        @F.arrow_udf(f"struct<text:string,entities:{_FOUND}>")
        def run(text: pa.Array) -> pa.Array:
            return replaced(text, [further] * len(text))

        @F.arrow_udf(f"struct<text:string,entities:{_FOUND}>")
        def run_joined(text: pa.Array, steps: pa.Array) -> pa.Array:
            return replaced(text, [{x["entity"]: x["n"] for x in own or []} for own in steps.to_pylist()])

        text = F.col(text_col).cast("string")
        return rows.select(F.col(id_col).alias("doc_id"), (run(text) if further is not None else run_joined(text, F.col("__steps"))).alias("r")).select("doc_id", "r.text", "r.entities")

    if not check:
        return made(docs, {})
    further: dict[str, int] = {}
    while True:
        out = stored(made(docs, dict(further)), "surrogates")
        clashing = [r["entity"] for r in clashes(out.select(F.inline("entities"))).limit(MOST_CLASHES + 1).collect()]
        if not clashing:
            return out
        if len(further.keys() | set(clashing)) > MOST_CLASHES:
            return _by_join(docs.select(id_col, text_col), out, further, secret, made, text_col)
        for e in clashing:
            further[e] = further.get(e, 0) + 1
        _bounded(max(further.values()))
        released(out)


def _bounded(steps: int) -> None:
    if steps > MOST_STEPS:
        raise ValueError("a format has fewer surrogates than entities")


def _by_join(docs: DataFrame, out: DataFrame, further: dict[str, int], secret: bytes, made: Callable[[DataFrame, None], DataFrame], text_col: str) -> DataFrame:
    """The same rounds for any number of clashes: further steps are a table, and each row gets those of its own entities by a join."""

    @F.arrow_udf("array<string>")
    def entities(text: pa.Array) -> pa.Array:
        return pa.array([sorted({entity_id(secret, e.kind, e.canonical) for e in detect(t)}) if t else [] for t in text.to_pylist()], pa.list_(pa.string()))

    # Stored, so that a row's number stays its own.
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__has", entities(F.col(text_col).cast("string"))), "rows")
    has = rows.select("__row", F.explode("__has").alias("entity"))
    steps = docs.sparkSession.createDataFrame(list(further.items()), "entity string, n int")
    for k in range(MOST_STEPS + 1):
        _bounded(k)
        more = clashes(out.select(F.inline("entities"))).withColumn("n", F.lit(1))
        steps = stored(steps.unionByName(more).groupBy("entity").agg(F.sum("n").cast("int").alias("n")), "steps")
        own = has.join(steps, "entity").groupBy("__row").agg(F.collect_list(F.struct("entity", "n")).alias("__steps"))
        last, out = out, stored(made(rows.join(own, "__row", "left"), None), "surrogates")
        released(last)
        if not clashes(out.select(F.inline("entities"))).limit(1).count():
            return out


def _plain_pairs(entities: DataFrame) -> DataFrame:
    """Distinct (kind, entity, surrogate), the surrogate without case and separators."""
    plain = F.when(F.col("kind").isin("phone", "card", "ssn", "iban"), F.regexp_replace("surrogate", r"[^+\w]", "")).otherwise(F.lower("surrogate"))
    return entities.select("kind", "entity", plain.alias("surrogate")).distinct()


def clashes(entities: DataFrame) -> DataFrame:
    """entity: all but the least of those that share a (kind, surrogate)."""
    least = _plain_pairs(entities).groupBy("kind", "surrogate").agg(F.min("entity").alias("least"), F.max("entity").alias("most")).where("least <> most")
    return _plain_pairs(entities).join(least, ["kind", "surrogate"]).where("entity <> least").select("entity").distinct()


def collisions(entities: DataFrame) -> DataFrame:
    """(kind, surrogate) that stand for two entities or more; of ``entities`` (kind, entity, surrogate), any number of rows.

    Spellings differ, so surrogates are compared without case and separators.
    Counts are combined before the shuffle, an entity in a third of all rows too.
    """
    return _plain_pairs(entities).groupBy("kind", "surrogate").agg(F.count("*").alias("n_entities")).where("n_entities > 1")
