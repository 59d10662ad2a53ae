"""PII: detected entities get surrogates.

Detection finds e-mail addresses, telephone numbers, payment cards (13 to 19 digits), IBANs,
social security numbers, IPv4 and IPv6 addresses, and names of persons (after one
or more titles, or a known given name before a capitalised word).  Spellings:

* telephone numbers in groups of 2-4, 3-4 and 3-4 digits parted by space, dot
  or hyphen, the first also in brackets, with or without "+" and a country code;
  behind a country code, with or without "(0)", also an area code and 4 to 9
  digits or two-digit groups (+49 30 1234567, +33 6 12 34 56 78); without one, if
  they begin with 0, five groups of two digits (06 12 34 56 78), or an area code in
  brackets or before space, hyphen or slash (030/1234567).  Numbers written
  without any break and without "+" are not found;
* cards without breaks, in fours or as 4-6-5 and 4-6-4;
* IPv6 addresses with all groups, or with "::" if they begin as global, local
  or multicast addresses do (2xxx, 3xxx, fcxx to ffxx) and hold a digit; not "::1".
  A surrogate is drawn
by a key (HMAC of type, normal form and attempt), so that one entity has one
surrogate wherever it occurs, in any spelling, and nobody without the key can
go back.  It keeps the type and the look: digits stay digits and letters
letters of the same script and case, punctuation stays, cards keep a valid check
digit if they had one, IBANs get valid ones, addresses stay in range, an e-mail
keeps the shape of its local part and the labels of its domain but the owner's,
given names keep gender and script.

Two entities of one type must not share a surrogate, and no surrogate may be an
entity of the corpus.  Both are checked over the whole corpus: entities are
counted, their surrogates compared by joins on hashes, and all but the first of
a clash draw again, until none clashes.  From attempt ``LEAVE_LOOK`` on the look
is left: surrogates are made longer with each attempt (IPv6 addresses are drawn
from all there are), so that there are always more of them than entities, also
where the look allows few or only the entity itself.  Only entities that had to draw again
are remembered; texts are replaced where they lie, with the attempts that
their entities need beside them.

Defined results: a null text stays null; a text without entities stays as it
is; of overlapping detections the first type in the order of ``TYPES`` wins;
repeated rows get equal texts; null doc_ids are carried through; extra columns
are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from folioscan.llm.common import stored

TRUNK = "(0)"  # not dialled behind a country code
REDRAWN = "_surrogate_redraws"
LEAVE_LOOK = 4  # the first attempt whose surrogates need not look like the entity

# Given names by script and gender; family names are made of syllables.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Beatrice Camille Carmen Caroline Charlotte Claudia Diana Eleanor Elena Elisabeth Emily Emma Eva "
                    "Francesca Hannah Helen Ingrid Isabel Jessica Johanna Julia Karen Katharina Laura Linda Louise Lucia Manon Margaret Maria "
                    "Marie Martina Mary Monica Nadia Natalie Olivia Patricia Paula Rebecca Sandra Sarah Sofia Stephanie Susan Teresa Ursula "
                    "Valerie Victoria",
    ("latin", "m"): "Adrian Albert Alexander Andreas Anthony Antoine Antonio Benjamin Carlos Charles Christian Daniel David Edward Emil "
                    "Felix Fernando Francisco Frank Frederic George Gerard Hans Henry Hugo James Javier Jean Johannes John Jonas Jorge "
                    "Joseph Juan Karl Klaus Lucas Louis Manuel Marco Martin Matthias Michael Miguel Nicolas Oliver Oscar Pablo Patrick "
                    "Paul Peter Philippe Pierre Rafael Richard Robert Samuel Sebastian Simon Stefan Thomas Victor Walter William Wolfgang",
    ("cyrillic", "f"): "Анна Ольга Мария Елена Наталья Ирина Татьяна Светлана Екатерина Людмила Галина Дарья Полина Ксения",
    ("cyrillic", "m"): "Иван Сергей Алексей Дмитрий Андрей Николай Михаил Владимир Павел Борис Олег Юрий Максим Степан",
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Άννα Ιωάννα Δήμητρα",
    ("greek", "m"): "Γιώργος Δημήτρης Κωνσταντίνος Ιωάννης Νικόλαος Παναγιώτης Βασίλης Χρήστος",
}
SYLLABLES = {
    "latin": "ba be bo da de di fa fe ga go ha he ho ka ke ko la le li lo ma me mi mo na ne no pa pe po ra re ri ro sa se si so ta te ti "
             "to va ve vi wa we wi za zo",
    "cyrillic": "ба бе бо ва ве да де ди га го ка ко ла ле ли ма ме мо на не но па по ра ре ро са се со та те ти ви зо",
    "greek": "βα γα δε ζο θα κα κο λα λε λι μα με μο να νε πα πο ρα ρε ρο σα σε σο τα τε τι φα χο",
}
ENDINGS = {"latin": ("son", "ler", "mann", "ton", "ez", "ier", "berg", "ford"), "cyrillic": ("ов", "ев", "ин", "енко"), "greek": ("ίδης", "άκης", "όπουλος")}
GIVEN_ENDINGS = {("latin", "f"): ("na", "ra", "la"), ("latin", "m"): ("no", "ro", "lo"), ("cyrillic", "f"): ("на", "ла"),
                 ("cyrillic", "m"): ("н", "р"), ("greek", "f"): ("νη", "ρα"), ("greek", "m"): ("νος", "ρης")}
TITLES = {
    "mr": "m", "mister": "m", "herr": "m", "herrn": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m", "sir": "m",
    "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "mademoiselle": "f", "señora": "f", "sra": "f", "doña": "f",
    "г-н": "m", "господин": "m", "г-жа": "f", "госпожа": "f", "κύριος": "m", "κυρία": "f", "dr": "", "prof": "", "doctor": "", "professor": "",
}
ALPHABETS = {"CYRILLIC": "абвгдежзиклмнопрстуфхцчшщыэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}
_UPPER = r"[^\W\d_a-zß-öø-ÿа-яёα-ώ]"
_NAME = rf"{_UPPER}[^\W\d_]+(?:-{_UPPER}[^\W\d_]+)?"

# In the order in which they win.
TYPES = {
    "email": r"\w[\w.%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
            r"|(?<![0-9A-Za-z:.])(?=[23][0-9A-Fa-f]{3}:|[Ff][C-Fc-f][0-9A-Fa-f]{2}:)(?=[A-Fa-f:]*[0-9])"
            r"(?:(?=(?:[0-9A-Fa-f]{1,4}::?){1,6}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:]))(?:[0-9A-Fa-f]{1,4}:)+(?::[0-9A-Fa-f]{1,4})+"
            r"|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![0-9A-Za-z:]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"
             r"|(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?[0-9]{6,12}(?![0-9])"
             # +33 6 12 34 56 78, +41 44 123 45 67; +49 30 1234567, +49 (0)30/123456-78
             r"|(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\([0-9]{1,5}\)|[0-9]{1,5})[ ./-]?"
             r"(?:[0-9]{2,3}(?:[ .-][0-9]{2}){2,4}|[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{4,9}(?:-[0-9]{1,4})?)(?![0-9A-Za-z])"
             # 06 12 34 56 78
             r"|(?<![0-9A-Za-z.])(?<![0-9]{2}[ /:-])0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})(?![0-9A-Za-z]|[ .:/-][0-9])"
             # 030/1234567, 0171 1234567, (030) 123 45 67
             r"|(?<![0-9A-Za-z./-])(?:\(0[1-9][0-9]{1,4}\)(?: ?/ ?| |)|0[1-9][0-9]{1,4}(?: ?/ ?|[ -]))"
             r"(?:[0-9]{5,8}(?:-[0-9]{1,4})?|[0-9]{2,4}(?: [0-9]{2,4}){1,3})(?![0-9A-Za-z]|[./-][0-9])",
}
_DETECT = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in TYPES.items()))
_HAS_DETAIL = re.compile(r"[0-9@]")
_BEFORE_NAME = re.compile(rf" (?={_UPPER})")
_NAMES = re.compile(rf" {_NAME}(?: {_NAME})?(?!\w)")
_WORD = re.compile(rf" ({_UPPER}[^\W\d_]+(?:-[^\W\d_]+)?)(?!\w)\.?")
_FIRST = {n for names in GIVEN.values() for n in names.split()}


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    text: str


def _name_end(text: str, at: int) -> int:
    """Where the name behind ``at`` ends, further titles stepped over; 0 if only titles remain."""
    while (word := _WORD.match(text, at)) and word[1].lower() in TITLES:
        at = word.end()
    names = _NAMES.match(text, at)
    if not names:
        return 0
    last = names.group().rsplit(" ", 1)[1]
    # A title behind the name belongs to the next one.
    return names.end() - (len(last) + 1 if last.lower() in TITLES else 0)


def _persons(text: str) -> Iterator[Entity]:
    """A title or a known given name, and the capitalised words behind it."""
    at = 0
    for space in _BEFORE_NAME.finditer(text):
        end = space.start()
        begin = text.rfind(" ", at, end)
        # A line break only matters behind that space; further back, each word would search its whole line.
        begin = max(text.rfind("\n", max(begin, at), end), begin) + 1
        begin = max(begin, at)
        word = text[begin:end].lstrip("([{\"'«„“‚‘")
        begin = end - len(word)
        if word in _FIRST or word.rstrip(".").lower() in TITLES:
            stop = _name_end(text, end)
            if stop:
                yield Entity(begin, stop, "person", text[begin:stop])
                at = stop


def detect(text: str) -> list[Entity]:
    """Entities in order, none overlapping."""
    found = [Entity(m.start(), m.end(), m.lastgroup, m.group()) for m in _DETECT.finditer(text)] if _HAS_DETAIL.search(text) else []
    bounds = [e.start for e in found]
    for person in _persons(text):
        i = bisect_right(bounds, person.start)
        if (not i or found[i - 1].end <= person.start) and (i == len(found) or found[i].start >= person.end):
            found.insert(i, person)
            bounds.insert(i, person.start)
    return found


def _names(text: str) -> list[str]:
    return [w for w in text.replace(".", " ").split() if w.lower() not in TITLES]


def normal(kind: str, text: str) -> str:
    """What all spellings of an entity have in common."""
    if kind in ("email", "ipv4"):
        return text.lower()
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).compressed
    if kind == "person":
        return " ".join(_names(text)).lower()
    if kind == "phone":
        text = text.replace(TRUNK, "") if text.startswith("+") else text
        return ("+" if text.startswith("+") else "") + "".join(c for c in text if c.isdigit())
    return "".join(c for c in text if c.isalnum()).upper()


class Draw:
    """A stream of numbers from a key and what is to be replaced."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.parts, self.block, self.rest = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.rest) < 8:
            self.rest += hmac.digest(self.key, self.parts + b"\x1f%d" % self.block, hashlib.sha256)
            self.block += 1
        value, self.rest = self.rest[:8], self.rest[8:]
        return int.from_bytes(value, "big") % n

    def pick(self, options):
        return options[self.below(len(options))]


def _script(text: str) -> str:
    for c in text:
        name = unicodedata.name(c, "")
        if name.startswith("CYRILLIC"):
            return "cyrillic"
        if name.startswith("GREEK"):
            return "greek"
    return "latin"


@lru_cache(maxsize=1)
def _gender_of() -> dict[str, str]:
    return {n.lower(): gender for (_, gender), names in GIVEN.items() for n in names.split()}


def _like(model: str, word: str) -> str:
    return word.upper() if model.isupper() and len(model) > 1 else word.lower() if model.islower() else word[:1].upper() + word[1:]


def _letters(text: str, draw: Draw) -> str:
    """Digits for digits, letters for letters of a script; case and the rest as they are."""
    out = []
    for c in text:
        if c.isdigit():
            out.append("0123456789"[draw.below(10)])
        elif c.isalpha():
            new = draw.pick(ALPHABETS.get(unicodedata.name(c, "").split(" ")[0], "abcdefghijklmnopqrstuvwxyz"))
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _filled(text: str, digits: str) -> str:
    """``digits`` in the places of the letters and digits of ``text``, what is left behind it."""
    new = iter(digits)
    return "".join(next(new) if c.isalnum() else c for c in text) + "".join(new)


def luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    doubled = [int(c) * (2 - i % 2) for i, c in enumerate(reversed(digits))]
    return -sum(d // 10 + d % 10 for d in doubled) % 10


def _made(script: str, draw: Draw, endings: tuple[str, ...], syllables: int) -> str:
    return "".join(draw.pick(SYLLABLES[script].split()) for _ in range(syllables)) + draw.pick(endings)


def _longer(attempt: int) -> int:
    """By how much a surrogate is made longer."""
    return max(0, attempt - LEAVE_LOOK + 1)


def person_gender(text: str) -> str:
    words = [w.lower() for w in text.replace(".", " ").split()]
    for w in words:
        if TITLES.get(w):
            return TITLES[w]
    return next((_gender_of()[w] for w in words if w in _gender_of()), "")


def _person(text: str, key: bytes, attempt: int, gender: str) -> str:
    """New words for all but titles.  A family name follows the family name
    alone, so that it is the same with and without the given name; a given name
    follows the whole.  After a few attempts given names are made up too, and
    what is drawn again gets longer."""
    names = _names(text)
    script = _script(text)
    alone = len(names) == 1
    family = _made(script, Draw(key, "family", names[-1].lower(), attempt if alone else 0), ENDINGS[script],
                   4 + (_longer(attempt) if alone else 0))
    draw = Draw(key, "given", " ".join(names).lower(), gender, attempt)
    sex = gender or draw.pick("fm")
    longer = _longer(attempt)
    given = _made(script, draw, GIVEN_ENDINGS[script, sex], 2 + longer) if longer else draw.pick(GIVEN[script, sex].split())
    out, seen = [], 0
    for word in re.split(r"( |\.)", text):
        if word in (" ", ".", "") or word.lower() in TITLES:
            out.append(word)
        else:
            seen += 1
            out.append(_like(word, given if seen == 1 and not alone else family))
    return "".join(out)


def surrogate(kind: str, text: str, key: bytes, attempt: int = 0, gender: str = "") -> str:
    """The replacement of one spelling of an entity."""
    draw = Draw(key, kind, normal(kind, text), attempt)
    longer = _longer(attempt)
    digits_more = lambda: "".join(str(draw.below(10)) for _ in range(longer))
    if kind == "email":
        local, domain = text.split("@")
        labels = domain.split(".")
        # Of the domain, what is its owner's: not its last label, nor example.com and the like.
        own = Draw(key, "domain", domain.lower())
        labels = [_letters(x, own) if i < max(1, len(labels) - 1) and x.lower() != "example" else x for i, x in enumerate(labels)]
        # Cut, as a local part has 64 characters at most.
        local = _letters(local[:40], draw) + _letters("aa" * longer, draw) if longer else _letters(local, draw)
        return local + "@" + ".".join(labels)
    if kind == "ipv4":
        return ".".join(str(draw.below(254) + 1 if i in (0, 3) else draw.below(256)) for i in range(4 + longer))
    if kind == "ipv6":
        if longer:
            return ":".join(f"{draw.below(1 << 16):x}" for _ in range(8))
        # Zero groups stay, as "::" may stand for them; the others keep their number of digits, the first its kind of address.
        groups = [f"{int(g, 16):x}" for g in ipaddress.IPv6Address(text).exploded.split(":")]
        new = ["0" if g == "0" else f"{draw.below(15 << 4 * (len(g) - 1)) + (1 << 4 * (len(g) - 1)):x}" for g in groups]
        if len(groups[0]) == 4:
            new[0] = groups[0][:2] + f"{draw.below(256):02x}"
        before, _, after = text.partition("::")
        parts = [half.split(":") if half else [] for half in (before, after)]
        parts = [[x.zfill(len(g)) for g, x in zip(p, q)] for p, q in zip(parts, (new, new[8 - len(parts[1]):]))]
        out = "::".join(":".join(p) for p in parts) if "::" in text else ":".join(parts[0])
        return out.upper() if text.isupper() else out
    if kind == "card":
        digits = normal(kind, text)
        new = digits[0] + "".join(str(draw.below(10)) for _ in digits[2:]) + digits_more()
        checked = luhn(digits[:-1]) == int(digits[-1])
        last = luhn(new) if checked else (luhn(new) + 1 + draw.below(9)) % 10
        return _filled(text, new + str(last))
    if kind == "ssn":
        area = draw.below(898) + 1
        return f"{area if area != 666 else 899:03d}-{draw.below(99) + 1:02d}-{draw.below(9999) + 1:04d}" + digits_more()
    if kind == "iban":
        whole = normal(kind, text)
        body = _letters(whole[4:], draw).upper() + digits_more()
        number = int("".join(str(int(c, 36)) for c in body + whole[:2] + "00"))
        return _filled(text, whole[:2] + f"{98 - number % 97:02d}" + body)
    if kind == "phone":
        # The first digit after a plus stays, and so does a first zero, no second behind it; all spellings have the same digits.
        digits = normal(kind, text).lstrip("+")
        plus = text.startswith("+")
        zero = not plus and digits[0] == "0"
        kept = plus or zero
        drawn = [draw.below(9) + 1 if zero and not i else draw.below(10) for i in range(len(digits) - kept)]
        new = iter(digits[:kept] + "".join(map(str, drawn)))
        parts = text.split(TRUNK) if plus else [text]
        return TRUNK.join("".join(next(new) if c.isdigit() else c for c in part) for part in parts) + digits_more()
    return _person(text, key, attempt, gender)


def identified(found: list[Entity]) -> list[tuple[str, str, str]]:
    """(kind, entity, gender) of each: an entity is its normal form, a person's
    with the gender.  A gender that a name has anywhere in the document holds
    for the name throughout it."""
    known: dict[str, str] = {}
    for e in found:
        if e.kind == "person" and person_gender(e.text):
            known.setdefault(normal(e.kind, e.text), person_gender(e.text))
    out = []
    for e in found:
        form = normal(e.kind, e.text)
        gender = known.get(form, "") if e.kind == "person" else ""
        out.append((e.kind, f"{form}/{gender}" if gender else form, gender))
    return out


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> tuple[str, list[Entity]]:
    """A text with surrogates, and the entities that were replaced."""
    found = detect(text)
    out, at = [], 0
    for e, (kind, entity, gender) in zip(found, identified(found)):
        out += [text[at:e.start], surrogate(kind, e.text, key, attempts.get((kind, entity), 0) if attempts else 0, gender)]
        at = e.end
    return "".join(out) + text[at:], found


def _entity_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            found = detect(text)
            rows += dict.fromkeys((doc, *named, e.text) for e, named in zip(found, identified(found)))
        names = ["doc", "kind", "entity", "gender", "spelling"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string() if i else pa.int64()) for i in range(5)], names)


def entities(docs: DataFrame) -> DataFrame:
    """doc, kind, entity, gender, spelling of all that is found, once a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("text IS NOT NULL")
    return rows.mapInArrow(_entity_batches, "doc long, kind string, entity string, gender string, spelling string")


def _drawer(key: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The normal form of each entity's surrogate."""
    def run(batches):
        for batch in batches:
            names = ["kind", "entity", "gender", "spelling", "attempt"]
            columns = [batch.column(c) for c in names]
            drawn = [normal(kind, surrogate(kind, spelling, key, attempt, gender))
                     for kind, _, gender, spelling, attempt in zip(*(c.to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(drawn, pa.string())], [*names, "drawn"])

    return run


def collisions(found: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, attempt of the entities whose first surrogate another
    entity has too, or is itself an entity of the corpus."""
    known = stored(found.groupBy("kind", "entity").agg(F.min("gender").alias("gender"), F.min("spelling").alias("spelling")), "entities")
    schema = "kind string, entity string, gender string, spelling string, attempt int, drawn string"
    final = stored(known.withColumn("attempt", F.lit(0)).mapInArrow(_drawer(key), schema), "drawn")
    while True:  # ends, as surrogates get longer from round to round
        # The first by (attempt, entity) keeps its surrogate; the others, and what is an entity, draw again.
        first = final.groupBy("kind", "drawn").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count("*").alias("n"))
        clash = (final.join(first.where("n > 1"), ["kind", "drawn"]).where("entity <> first.entity").select("kind", "entity")
                 .unionByName(final.join(known.select("kind", F.substring_index("entity", "/", 1).alias("drawn")), ["kind", "drawn"], "left_semi").select("kind", "entity")))
        clash = stored(clash.distinct(), "clashes")
        if not clash.limit(1).count():
            return final.where("attempt > 0").select("kind", "entity", "attempt")
        again = final.join(clash, ["kind", "entity"], "left_semi").withColumn("attempt", F.col("attempt") + 1).drop("drawn")
        final = stored(final.join(clash, ["kind", "entity"], "left_anti").unionByName(again.mapInArrow(_drawer(key), schema)), "drawn")


def _replacer(key: bytes, columns: list[str], count: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for text, again in zip(batch.column("text").to_pylist(), batch.column(REDRAWN).to_pylist()):
                attempts = {(a["kind"], a["entity"]): a["attempt"] for a in again} if again else None
                new, found = (None, []) if text is None else replaced(text, key, attempts)
                texts.append(new)
                counts.append(len(found))
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            if count:
                arrays.append(pa.array(counts, pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *["n_entities"] * count])

    return run


def with_surrogates(docs: DataFrame, key: bytes, count: bool = False) -> DataFrame:
    """``docs`` with replaced texts, and ``n_entities`` if ``count``."""
    found = stored(entities(docs), "occurrences")
    again = stored(collisions(found, key), "redrawn")
    # Stored, so that Spark knows its size: a small table is broadcast, a large one joined.
    by_doc = stored(found.join(again, ["kind", "entity"]).groupBy(F.col("doc").alias("_doc")).agg(
        F.collect_set(F.struct("kind", "entity", "attempt")).alias(REDRAWN)), "redrawn-by-document")
    rows = docs.join(by_doc, docs["doc_id"].cast("long").eqNullSafe(by_doc["_doc"]), "left").select(*[docs[c] for c in docs.columns], REDRAWN)
    schema = T.StructType([*docs.schema.fields, *[T.StructField("n_entities", T.IntegerType())] * count])
    return rows.mapInArrow(_replacer(key, docs.columns, count), schema)


def mask_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with replaced texts; n_chars, if there, counts them anew."""
    rows = with_surrogates(docs, key)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows
