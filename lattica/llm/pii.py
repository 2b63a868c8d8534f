"""Surrogates for personal data and secrets.

Detected entities are replaced by others of the same type, script and format. Whatever has a format (addresses, numbers,
keys) is enciphered sign by sign: a keyed Feistel network over the mixed-radix number that its free signs make, which
is a bijection, so unlike entities stay unlike and equal ones stay equal in all documents without any shared table.

A name is found by a title or a known given name in front of it; in the text that has one, its later and earlier mentions without
a title, in full or in part, are found as well. Its family name is drawn by key alone, so "Mr Smith", "Peter Smith" and "Smith"
share the new one; a given name is drawn for the whole name, from a list of its gender and script. Letters of scripts without lists are
enciphered among their like.

All pairs of entity and surrogate then meet in a collision check: entities that share a surrogate, keep their own, or would bear
the name or number of another real one, are drawn again (of those that share one, all but the smallest) until none do.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage, text_slices

# Titles and the gender they tell, given names to draw from (the third gender is an unknown one), and syllables of family names.
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Господин": "m", "Госпожа": "f",
    "Κύριος": "m", "Κυρία": "f", "Dr": "", "Prof": "", "Doctor": "", "Professor": "", "Docteur": "", "Доктор": "", "Профессор": "", "Δρ": "",
}
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul", "Robin", "Simon", "Tomas", "Victor"],
    ("f", "latin"): ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sophia", "Teresa", "Vera"],
    ("", "latin"): ["Alex", "Andrea", "Charlie", "Dominique", "Gabi", "Kim", "Luca", "Nikita", "Robin", "Sam", "Sascha", "Toni"],
    ("m", "cyrillic"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Павел"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"],
    ("", "cyrillic"): ["Женя", "Саша", "Валя", "Слава", "Шура"],
    ("m", "greek"): ["Αλέξανδρος", "Βασίλης", "Γιώργος", "Δημήτρης", "Κώστας", "Λεωνίδας", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"],
    ("f", "greek"): ["Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"],
    ("", "greek"): ["Άρης", "Χάρις", "Φώτης", "Αλέξης"],
}
#: Given names that, in front of another capitalised word, make a name without a title.
KNOWN = {
    **{n: g for (g, _), names in GIVEN.items() if g for n in names},
    **dict.fromkeys(["James", "John", "Peter", "Thomas", "William", "Michael", "Robert", "Hans", "Jürgen", "Pierre", "Jean", "José", "Juan", "Carlos"], "m"),
    **dict.fromkeys(["Anna", "Mary", "Elizabeth", "Susan", "Sarah", "Jane", "Ursula", "Claudia", "Marie", "Camille", "Carmen", "Lucía"], "f"),
}
SYLLABLES = {
    "latin": ["ba", "den", "fo", "gar", "hil", "jo", "ka", "lin", "mor", "ne", "pol", "ras", "sen", "tor", "va", "wel"],
    "cyrillic": ["ба", "ден", "фо", "гар", "зил", "жо", "ка", "лин", "мор", "не", "пол", "рас", "сен", "тор", "ва", "вел"],
    "greek": ["βα", "δεν", "φο", "γαρ", "ζιλ", "ρο", "κα", "λιν", "μορ", "νε", "πολ", "ρας", "σεν", "τορ", "θα", "χελ"],
}
PARTICLES = {"van", "von", "der", "den", "de", "da", "di", "du", "del", "della", "la", "le", "el", "zu", "y"}

_PATTERNS = [
    ("secret", re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{14,17}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?(?P<value>(?=[^\s\"']*\d)[^\s\"']{6,})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,}(?![A-Za-z0-9])")),
    ("email", re.compile(r"[A-Za-z0-9](?:[\w.+%-]*\w)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("phone", re.compile(r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)")),
    ("phone", re.compile(r"(?<![\w+])\+[2-9]\d{0,2}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)")),
    ("phone", re.compile(r"(?<![\w.+-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.+-])\d{3}-\d{3}-\d{4}(?![\d-])")),
    ("card", re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")),
]
_ANY_DIGIT = re.compile(r"\d")
_PART = re.compile(r"[^\W\d_](?:\.|[^\W\d_]+(?:[-'’][^\W\d_]+)*)")
_TITLED = re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? ")
_GIVEN_FIRST = re.compile(rf"(?<!\w)(?=(?:{'|'.join(sorted(KNOWN, key=len, reverse=True))}) )")


def _hints() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in [*TITLES, *KNOWN]:
        found.add_word(word + " ", word)
        found.add_word(word + ".", word)
    found.make_automaton()
    return found


_HINTS = _hints()


class Entity(NamedTuple):
    kind: str
    begin: int
    end: int
    value: str
    gender: str = ""
    family: str = ""  # of a name: the family name behind it, "" where it has none


def detect(text: str) -> list[Entity]:
    """Entities in order, none overlapping another; earlier patterns go first, and names last."""
    digit, mail = _ANY_DIGIT.search(text), "@" in text
    named = next(_HINTS.iter(text), None) is not None
    if not (digit or mail or named):
        return []
    found: list[Entity] = []

    def add(kind: str, begin: int, end: int, gender: str = "", family: str = "") -> bool:
        free = all(end <= e.begin or begin >= e.end for e in found)
        if free:
            found.append(Entity(kind, begin, end, text[begin:end], gender, family))
        return free

    for kind, pattern in _PATTERNS:
        if mail if kind == "email" else digit or "AKIA" in text:
            for m in pattern.finditer(text):
                add(kind, *(m.span("value") if "value" in pattern.groupindex else m.span()))
    if named:
        _add_names(text, add)
    return sorted(found, key=lambda e: e.begin)


def _capitalised(text: str, at: int) -> list[str]:
    """The words from a place on, up to the last capitalised one, four such words at most; particles may stand between."""
    words: list[str] = []
    last = n = 0
    while n < 4 and (m := _PART.match(text, at)) and len(words) < 10:
        if not m[0][0].islower():
            last, n = len(words) + 1, n + 1
        elif m[0] not in PARTICLES or not n:
            break
        words.append(m[0])
        at = m.end() + 1
        if text[at - 1 : at] != " ":
            break
    return words[:last]


def _add_names(text: str, add) -> None:
    people: list[tuple[str, str, list[str]]] = []  # gender, family name, all words
    for pattern in (_TITLED, _GIVEN_FIRST):
        for m in pattern.finditer(text):
            begin = m.end()
            words = _capitalised(text, begin)
            if not words or (pattern is _GIVEN_FIRST and len(words) < 2):
                continue
            gender = TITLES[m["title"]] if pattern is _TITLED else ""
            gender = gender or KNOWN.get(words[0], "")
            family = words[-1] if len(words) > 1 or words[0] not in KNOWN else ""
            if add("name", begin, begin + len(" ".join(words)), gender, family):
                people.append((gender, family, words))
    mentions: dict[str, tuple[str, str]] = {}
    for gender, family, words in people:
        # a name without its title, its first and last word, and either alone
        for mention in (" ".join(words), f"{words[0]} {words[-1]}", family, words[0]):
            if len(mention) > 2:
                mentions.setdefault(mention, (gender, family))
    if mentions:
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(mentions, key=len, reverse=True)))})(?!\w)", text):
            add("name", *m.span(), *mentions[m[0]])


def canonical(e: Entity) -> str:
    """What makes two mentions of a number or address the same entity: its digits (with the country's code in North America), or its lower-cased signs."""
    if e.kind in ("phone", "card", "ssn"):
        digits = re.sub(r"\D", "", e.value)
        return "1" + digits if e.kind == "phone" and len(digits) == 10 and "+" not in e.value else digits
    if e.kind == "iban":
        return e.value.replace(" ", "")
    return e.value.lower() if e.kind == "email" else e.value


def parts(e: Entity) -> list[tuple[str, str]]:
    """(kind, entity) of what is replaced in a mention: itself, or of a name each word; ("", word) where a word stays."""
    if e.kind != "name":
        return [(e.kind, canonical(e))]
    words = e.value.split(" ")
    out = []
    for word in words:
        if word in PARTICLES:
            out.append(("", word))
        else:
            out.append(("name", f":{word}") if word == e.family else ("given", f"{e.gender}:{word}:{e.family}"))
    return out


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, repr(parts).encode(), hashlib.sha256).digest(), "big")


def _encipher(key: bytes, context: tuple, digits: list[int], radixes: list[int]) -> list[int]:
    """A bijection of mixed-radix numbers: rounds that add keyed numbers of one half to the other. One sign alone is shifted."""
    half = len(digits) // 2
    sides = [(0, half), (half, len(digits))]
    values, sizes = [], []
    for a, b in sides:
        value = size = 1
        value = 0
        for d, r in zip(digits[a:b], radixes[a:b], strict=True):
            value, size = value * r + d, size * r
        values.append(value)
        sizes.append(size)
    for k in range(8):
        to, of = k % 2, 1 - k % 2
        values[to] = (values[to] + _number(key, *context, k, values[of])) % sizes[to]
    out: list[int] = []
    for (a, b), value in zip(sides, values, strict=True):
        part = []
        for r in reversed(radixes[a:b]):
            value, d = divmod(value, r)
            part.append(d)
        out += part[::-1]
    return out


_HIGH = "23456789"
_LOW, _UP, _TEN, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def _same_format(key: bytes, kind: str, text: str, attempt: int, hexadecimal: bool = False, high: tuple[int, ...] = ()) -> str:
    """Letters become letters of their case and digits digits; all other signs stay, and with them the format's domain.

    Digits from 2 to 9 at the places `high` stay among those."""
    sets = [_HEX if hexadecimal and c in _HEX else next((s for s in (_TEN, _LOW, _UP) if c in s), "") for c in text]
    for k in high:
        if text[k] in _HIGH:
            sets[k] = _HIGH
    free = [k for k, s in enumerate(sets) if s]
    if not free:
        return text
    shape = "".join(s[0] if s else c for c, s in zip(text, sets, strict=True))
    new = _encipher(key, (kind, shape, attempt), [sets[k].index(text[k]) for k in free], [len(sets[k]) for k in free])
    out = list(text)
    for k, d in zip(free, new, strict=True):
        out[k] = sets[k][d]
    return "".join(out)


def _check_digit(digits: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - k % 2), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_digits(country: str, account: str) -> int:
    """The check digits of a valid account number, from 2 to 98."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _script(word: str) -> str:
    name = unicodedata.name(next((c for c in word if c.isalpha()), "x"), "")
    return next((s for s in SYLLABLES if name.startswith(s.upper())), "other")


@cache
def _like(c: str) -> str:
    """Letters of the same kind and case among the 64 code points around c."""
    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(first, first + 64)) if x.isalpha() and unicodedata.category(x) == unicodedata.category(c))


def _in_script(key: bytes, kind: str, entity: str, word: str, attempt: int) -> str:
    """A word of a script without lists: each letter becomes one of its like; later draws add letters."""
    longer = word + word[-1] * (attempt // 2)
    sets = [_like(c) if c.isalpha() else "" for c in longer]
    free = [k for k, x in enumerate(sets) if x]
    new = _encipher(key, (kind, "".join(x[0] if x else c for c, x in zip(longer, sets, strict=True)), attempt), [sets[k].index(longer[k]) for k in free], [len(sets[k]) for k in free])
    out = list(longer)
    for k, d in zip(free, new, strict=True):
        out[k] = sets[k][d]
    return "".join(out)


def _family(key: bytes, entity: str, attempt: int, syllables: int) -> str:
    """Of an entity `gender:name`: drawn syllables, one more with every attempt, with the name's hyphens and capitals."""
    name = entity.partition(":")[2]
    script = _script(name)
    if script == "other":
        return _in_script(key, "name", entity, name, attempt)
    draw, out = _number(key, "name", entity, attempt), []
    pieces = re.split("([-'’ ])", name)
    for piece in pieces:
        if piece in "-'’ ":
            out.append(piece)
            continue
        new = ""
        for _ in range(syllables + attempt):
            draw, k = divmod(draw, len(SYLLABLES[script]))
            new += SYLLABLES[script][k]
        draw = _number(key, "more", entity, attempt, len(out))
        out.append(new.upper() if len(piece) > 1 and piece.isupper() else new.capitalize())
    return "".join(out)


def _given(key: bytes, entity: str, attempt: int) -> str:
    """Of an entity `gender:given:family`: a given name of the gender and script, two or more in later draws; an initial for an initial."""
    gender, given, _ = entity.split(":", 2)
    script = _script(given)
    if script == "other":
        return _in_script(key, "given", entity, given, attempt)
    draw, names = _number(key, "given", entity, attempt), []
    for _ in range(1 + attempt // 4):
        draw, k = divmod(draw, len(GIVEN[gender, script]))
        names.append(GIVEN[gender, script][k])
    if given.endswith("."):
        return ".".join(n[0] for n in names) + "."
    return "-".join(names).upper() if len(given) > 1 and given.isupper() else "-".join(names)


#: Draws after which a secret's surrogate may be longer than it, and a surrogate may equal another real entity.
CROWDED = 16
#: Draws after which the collision check gives up.
MOST_DRAWS = 64


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, syllables: int = 6) -> str:
    """The replacement of a canonical entity."""
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        return _same_format(key, "email", local, attempt) + "@" + ".".join([*(_same_format(key, "domain", x, attempt) for x in labels[:-1]), labels[-1]])
    if kind == "card":
        if _check_digit(entity[:-1]) == entity[-1]:
            body = entity[0] + _same_format(key, "card", entity[1:-1], attempt)
            return body + _check_digit(body)
        body = entity[0] + _same_format(key, "card-unchecked", entity[1:], attempt)
        while _check_digit(body[:-1]) == body[-1]:  # walk on until it is no valid number either: still a bijection
            body = entity[0] + _same_format(key, "card-unchecked", body[1:], attempt)
        return body
    if kind == "phone":
        fixed = max(0, len(entity) - 10)
        high = (0, 3) if len(entity) - fixed == 10 and entity[:fixed] in ("", "1") else ()  # area and exchange codes of ten-digit numbers
        return entity[:fixed] + _same_format(key, f"phone{entity[:fixed]}", entity[fixed:], attempt, high=high)
    if kind == "iban":
        country, digits, account = entity[:2], entity[2:4], entity[4:]
        new = _same_format(key, "iban" + country, account, attempt)
        off = (int(digits) - _iban_digits(country, account)) % 97  # 0 where the number is valid, which it then stays
        return f"{country}{(_iban_digits(country, new) + off - 2) % 97 + 2:02d}{new}"
    if kind == "ip":
        octets = [int(x) for x in entity.split(".")]
        return ".".join(map(str, _encipher(key, ("ip", attempt), octets, [256] * 4)))
    if kind == "name":
        return _family(key, entity, attempt, syllables)
    if kind == "given":
        return _given(key, entity, attempt)
    if kind == "secret" and attempt >= CROWDED:  # so short a secret has no free signs left
        return surrogate(key, kind, entity, attempt - CROWDED) + f"{_number(key, kind, entity, attempt) % 10**4:04d}"
    if entity.startswith("AKIA"):
        return "AKIA" + _same_format(key, "AKIA", entity[4:], attempt)
    return _same_format(key, "secret", entity, attempt, hexadecimal=bool(re.fullmatch("[0-9a-f]+", entity)))


def _rendered(e: Entity, new: str) -> str:
    """The surrogate of a number or address in the mention's own punctuation and case."""
    if e.kind in ("phone", "card", "ssn", "iban"):
        n = sum(c.isalnum() for c in e.value)
        signs = iter(new[len(new) - n :])
        return "".join(next(signs) if c.isalnum() else c for c in e.value)
    if e.kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(e.value, new, strict=True))
    return new


def replace(text: str, key: bytes, drawn_again: dict[tuple[str, str], int], syllables: int = 6) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (kind, begin, end, surrogate) of each entity by its place in the old text."""
    out, at, done = [], 0, []
    for e in detect(text):
        new = " ".join(surrogate(key, kind, known, drawn_again.get((kind, known), 0), syllables) if kind else known for kind, known in parts(e))
        new = _rendered(e, new)
        out += [text[at : e.begin], new]
        at = e.end
        done.append((e.kind, e.begin, e.end, new))
    return "".join([*out, text[at:]]) if done else text, done


#: Entities drawn again that are broadcast; were there more, each text brings its own.
MOST_DRAWN_AGAIN = 100_000
#: Least syllables of a drawn family name.
LEAST_SYLLABLES = 2


def _drawn_again(entities: DataFrame, key: bytes, syllables: int) -> DataFrame:
    """(kind, entity, attempt) of entities (kind, entity) drawn more than once, so that no two of a kind (of given names: of a family name) share a surrogate, none keeps its own, and none bears another real one's."""

    def draw(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            kinds, names, attempts = (batch.column(c).to_pylist() for c in ("kind", "entity", "attempt"))
            new = [surrogate(key, k, x, n, syllables) for k, x, n in zip(kinds, names, attempts, strict=True)]
            own = [x.split(":")[1] if k in ("name", "given") else x for k, x in zip(kinds, names, strict=True)]
            scope = [x.split(":", 2)[2] if k == "given" else "" for k, x in zip(kinds, names, strict=True)]
            columns = [*(batch.column(c) for c in ("kind", "entity", "attempt")), *(pa.array(c, pa.string()) for c in (scope, own, new))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "entity", "attempt", "scope", "own", "surrogate"])

    state = entities.select("kind", "entity", F.lit(0).alias("attempt"))
    for _ in range(MOST_DRAWS):
        drawn = stage(state.mapInArrow(draw, "kind string, entity string, attempt int, scope string, own string, surrogate string"), "surrogates")
        new = drawn.select("kind", "scope", F.col("surrogate").alias("value"), "entity", F.lit(False).alias("real"))
        real = drawn.filter("kind <> 'given'").select("kind", "scope", F.col("own").alias("value"), F.lit(None).cast("string").alias("entity"), F.lit(True).alias("real"))
        groups = new.unionAll(real).groupBy("kind", "scope", "value").agg(F.min("entity").alias("smallest"), F.max("entity").alias("largest"), F.max("real").alias("real"))
        groups = groups.filter("smallest < largest or smallest is not null and real").withColumnRenamed("value", "surrogate")
        own = drawn.filter("kind = 'given' and surrogate = own").select("kind", "entity")
        taken = drawn.join(groups, ["kind", "scope", "surrogate"]).filter(f"entity <> smallest or surrogate = own or real and attempt < {CROWDED}").select("kind", "entity")
        clash = stage(taken.unionAll(own).distinct(), "clashes")
        if clash.isEmpty():
            return drawn.filter("attempt > 0").select("kind", "entity", "attempt")
        state = drawn.join(clash.withColumn("again", F.lit(1)), ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise RuntimeError("the surrogates of a kind are used up")


def _collisions(entities: DataFrame, key: bytes, syllables: int = 6) -> tuple[dict[tuple[str, str], int], int]:
    """Draws of entities (kind, entity) beyond the first, for tables of which few are drawn again; and the syllables of a family name's first draw."""
    used = max(LEAST_SYLLABLES, syllables)
    return {(r.kind, r.entity): r.attempt for r in _drawn_again(entities, key, used).collect()}, used


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", syllables: int = 6) -> DataFrame:
    """docs with text_col rewritten and `entities` (kind, begin, end, surrogate; places in the old text) appended.

    Every column and row of docs stays; null text stays null and empty text empty, both without entities. An entity gets the
    same surrogate in every document; with this key it is the same in another table too, unless the entity is drawn again in one of them because it
    clashes there. Texts without entities are unchanged, texts of any length are searched whole. A column of docs that is called
    `entities` stays as it is, before the new one.
    """
    spark = docs.sparkSession
    at, names = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    texts = plain.select(F.col(names[at]).alias("text")).filter("text is not null")

    def mentions(batches):
        for batch in text_slices(batches):
            found = sorted({p for t in batch.column("text").to_pylist() for e in detect(t) for p in parts(e) if p[0]})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], ["kind", "entity"])

    entities = stage(texts.mapInArrow(mentions, "kind string, entity string").distinct(), "entities")
    again = stage(_drawn_again(entities, key, max(LEAST_SYLLABLES, syllables)), "drawn-again")
    few = again.limit(MOST_DRAWN_AGAIN + 1).count() <= MOST_DRAWN_AGAIN
    held = spark.sparkContext.broadcast({(r.kind, r.entity): r.attempt for r in again.collect()} if few else {})  # MOST_DRAWN_AGAIN rows at most
    if not few:
        digest = lambda c: F.sha2(F.col(c), 256)

        def each(batches):
            for batch in batches:
                rows = [(d, *p) for d, t in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True) for p in sorted({p for e in detect(t) for p in parts(e) if p[0]})]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["digest", "kind", "entity"])

        named = texts.withColumn("digest", digest("text")).mapInArrow(each, "digest string, kind string, entity string").distinct()
        draws = named.join(again, ["kind", "entity"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("draws"))  # of one text's entities
        plain = plain.withColumn("digest", digest(names[at])).join(stage(draws, "draws-of-texts"), "digest", "left").select(*names, "draws")

    def rewrite(batches):
        for batch in batches:
            texts_, spans = [], []
            own = batch.column("draws").to_pylist() if not few else [None] * batch.num_rows
            for t, draws in zip(batch.column(at).to_pylist(), own, strict=True):
                table = held.value if few else {(d["kind"], d["entity"]): d["attempt"] for d in draws or ()}
                new, done = (t, []) if t is None else replace(t, key, table, max(LEAST_SYLLABLES, syllables))
                texts_.append(new)
                spans.append([{"kind": k, "begin": a, "end": b, "surrogate": s} for k, a, b, s in done])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
            columns = [pa.array(texts_, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*names, "entities"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    out = plain.mapInArrow(rewrite, f"{schema}, entities array<struct<kind:string,begin:int,end:int,surrogate:string>>")
    return out.toDF(*docs.columns, "entities")
