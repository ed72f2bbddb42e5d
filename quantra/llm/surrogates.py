"""PII: keyed, type-consistent surrogates for detected entities.

Entities: e-mail addresses, phone, card and social security numbers, IPv4 and IPv6 addresses, IBANs, access keys (by their form, or as the value of a
name like token or password), dates of birth and street addresses in their usual wording, and names: after a title (which gives the gender; Latin,
Cyrillic, Greek and Han script), or a known given name with a surname. Later mentions of such a surname count too, so a text with `Mr Green` loses
`Green tea` as well. Each entity has a canonical value, so that one written in two ways keeps one surrogate (coreference), and the
surrogate is rendered in the format of each occurrence. A surrogate is a function of the key, the kind, the value and an attempt number; it keeps
gender, script, length, separators, country codes and valid check digits. Addresses of one mail domain keep one domain.

Distinctness is checked over the whole corpus: all distinct entities get their surrogate of attempt 0; one that equals an entity of the corpus,
or that an entity earlier in order holds, is tried again with the next attempt, until none collides. From the fourth attempt on surrogates grow
longer, so that small spaces don't run out; what is still open after MOST_ROUNDS draws, as in formats that cannot grow, gets the numbers of its format that are left. Mail domains are settled before
the addresses. Dates need no draws: the dates of a format and decade change places, so no two share a surrogate and none keeps its own; a corpus with many of them has all dates, so a surrogate may be
another entity's date. Only entities with an attempt over 0 (few) travel back to their documents, so the texts are never shuffled for it.

Not found: names with neither a title nor a known given name, initials (kept as they are), and addresses or numbers in other wordings.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantra.llm.common import row_key, small, stored

#: Titles and the gender of the names after them.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "господин": "m", "г-н": "m", "κύριος": "m", "κ.": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Señorita": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "госпожа": "f", "г-жа": "f", "κυρία": "f", "κα.": "f",
    "Dr": "n", "Prof": "n", "Professor": "n", "Doctor": "n",
}
#: Titles after a name in Han script, and surnames they follow.
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f"}
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高梁郑谢宋唐许韩冯邓曹彭曾肖田董袁潘蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖"
#: Common given names, which make a following capitalised word a surname.
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Mark Paul Steven Andrew Kenneth George Peter Hans Klaus Jürgen Wolfgang Stefan Thomas Michel Pierre Jean Jacques Philippe Nicolas José Juan Carlos Luis Miguel Antonio Javier Pedro Ivan Dmitri Ahmed Mohammed Ali Иван Пётр Сергей Дмитрий Алексей Γιώργος Νίκος",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Emily Emma Jane Anna Laura Julia Ursula Monika Petra Sabine Claudia Marie Isabelle Sophie Nathalie Catherine Camille María Carmen Ana Isabel Lucía Elena Sofía Marta Olga Natalia Fatima Aisha Мария Анна Елена Ольга Наталья Μαρία Ελένη",
}
GENDER = {name: g for g, names in GIVEN.items() for name in names.split()}
#: Country calling codes of one and two digits; all others have three.
CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}
_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ", "a-zß-öø-ÿа-яёα-ωάέήίόύώς"
_WORD = rf"(?:(?:[{_UP}]['’])?[{_UP}][{_LOW}]+(?:[-'’][{_UP}][{_LOW}]+)?|(?:[{_UP}]['’])?[{_UP}]{{2,}})"
_PARTICLE = r"(?:de|la|las|los|del|di|da|dos|du|le|van|der|den|von|zu|bin|al)"
_NAMES = rf"(?:[{_UP}]\.[  ]?)*{_WORD}(?:[  ](?:{_PARTICLE}[  ])*(?:[{_UP}]\.[  ])?{_WORD}){{0,2}}"
_TITLE = "|".join(re.escape(x) for t in sorted(TITLES, key=len, reverse=True) for x in dict.fromkeys((t, t.upper())))
NAME = re.compile(rf"(?<!\w)(?P<title>{_TITLE})\.?[  ](?P<words>(?:(?:{_PARTICLE}[  ])*){_NAMES})(?!\w)")
FULL = re.compile(rf"(?<!\w)(?P<given>[{_UP}][{_LOW}]+)(?=[  ](?P<rest>(?:[{_UP}]\.[  ])?(?:{_PARTICLE}[  ])*{_WORD})(?!\w))")
HAN = re.compile(rf"(?P<name>[{HAN_SURNAMES}][\u4e00-\u9fff]{{0,2}}?)(?P<title>{'|'.join(HAN_TITLES)})")
EMAIL = re.compile(r"(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
NUMBER = re.compile(
    r"(?<![\w.+-])(?:(?P<ip>\d{1,3}(?:\.\d{1,3}){3})|(?P<ssn>\d{3}-\d{2}-\d{4})|(?P<card>\d(?:[ -]?\d){12,18})"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}))(?!\w|[.-]\d)"
)
CALLED = re.compile(r"(?i:\b(?:tel|phone|mobile|fax|call)\w*\.?(?: at| on)?[: ]+)(?P<phone>\d{10})(?!\w|[.-]\d)")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SECRET = re.compile(r"(?<!\w)(?:(?:AKIA|ASIA)[A-Z0-9]{16}|sk-[A-Za-z0-9_-]{20,}|gh[opsu]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![\w-])")
ASSIGNED = re.compile(r"""(?i:\b\w*(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)["']?[ \t]{0,3}[=:][ \t]{0,3})(?P<q>["']?)(?P<value>[^\s"']{8,}?)(?=(?P=q)(?:[\s.,;!?)\]}]|["']|$))""")
BORN = re.compile(r"(?i:\b(?:born(?: on)?|dob|date of birth|geboren(?: am)?|née? le|nacid[oa] el)[: ]+)(?P<date>\d{1,4}[./-]\d{1,2}[./-]\d{1,4})(?!\w)")
STREET = re.compile(rf"(?<!\w)(?P<a>\d{{1,5}} {_WORD}(?: {_WORD}){{0,2}}) (?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)(?!\w)|(?<!\w)(?P<b>[{_UP}][{_LOW}]+)(?:straße|strasse|str\.|weg|platz|gasse) \d{{1,4}}(?!\w)")


#: What a text must have for a detector to look at it (in lower case).
DIGIT = re.compile(r"\d")
SIGNS = {
    "called": ("tel", "phone", "mobile", "fax", "call"),
    "secret": ("akia", "asia", "sk-", "gho_", "ghp_", "ghs_", "ghu_", "xox"),
    "assigned": ("token", "secret", "passw", "pwd", "key"),
    "born": ("born", "dob", "date of birth", "geboren", "né le", "née le", "nacid"),
    "street": (" street", " st", " road", " rd", " av", " lane", " ln", " drive", " boulevard", " blvd", " court", " square", "straße", "strasse", "str.", "weg", "platz", "gasse"),
}


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    value: str


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def script(word: str) -> str:
    first = ord(word[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "han" if 0x4E00 <= first < 0xA000 else "latin"


def country(digits: str) -> str:
    """The calling code that an international number begins with."""
    return next((digits[:k] for k in (1, 2) if digits[:k] in CODES), digits[:3])


def e164(written: str) -> str:
    """Ten digits without a country code are a number of the North American plan."""
    digits = re.sub(r"\D", "", written)
    return f"+{digits}" if written[0] == "+" or len(digits) != 10 else f"+1{digits}"


def _named(words: str, at: int, gender: str) -> list[Entity]:
    """The parts of a name: all but the last are given names; particles and initials are left as they are."""
    parts = [(m.start() + at, m[0]) for m in re.finditer(r"[^  ]+", words) if not re.fullmatch(rf"{_PARTICLE}|[{_UP}]\.", m[0])]
    out = []
    for k, (start, part) in enumerate(parts):
        last = k == len(parts) - 1
        kept = gender if not last or script(part) == "cyrillic" else "-"
        out.append(Entity(start, start + len(part), f"{'surname' if last else 'given'}:{kept}:{script(part)}", part.lower()))
    return out


def _names(text: str) -> list[Entity]:
    found: list[Entity] = []
    surnames: dict[str, str] = {}
    known = [_named(m["words"], m.start("words"), TITLES.get(m["title"]) or next(g for t, g in TITLES.items() if t.upper() == m["title"])) for m in (NAME.finditer(text) if any(t in text or t.upper() in text for t in TITLES) else ())]
    known += [_named(f"{m['given']} {m['rest']}", m.start(), GENDER[m["given"]]) for m in FULL.finditer(text) if m["given"] in GENDER]
    for parts in known:
        found += parts
        last = text[parts[-1].start : parts[-1].end] if parts else ""
        if len(last) > 2:
            surnames[last] = parts[-1].kind
    for word, kind in surnames.items():  # later mentions without a title
        found += (Entity(m.start(), m.end(), kind, word.lower()) for m in re.finditer(rf"(?<!\w){re.escape(word)}(?!\w)", text))
    if any(t in text for t in HAN_TITLES):
        found += (Entity(m.start(), m.end("name"), f"surname:{HAN_TITLES[m['title']]}:han", m["name"]) for m in HAN.finditer(text))
    return found


def _signs(low: str, kind: str) -> bool:
    return any(x in low for x in SIGNS[kind])


def _numbers(text: str, low: str) -> list[Entity]:
    found: list[Entity] = []
    digits = DIGIT.search(text) is not None
    for m in NUMBER.finditer(text) if digits else ():
        kind, written = m.lastgroup, re.sub(r"\D", "", m[0])
        if kind == "ip" and all(int(x) < 256 for x in m[0].split(".")):
            found.append(Entity(m.start(), m.end(), kind, ".".join(str(int(x)) for x in m[0].split("."))))
        elif kind == "ssn" or kind == "card" and luhn(written):
            found.append(Entity(m.start(), m.end(), kind, written))
        elif kind == "phone" and 7 <= len(written) <= 15:
            found.append(Entity(m.start(), m.end(), kind, e164(m[0])))
    found += (Entity(*m.span("phone"), "phone", e164(m["phone"])) for m in (CALLED.finditer(text) if digits and _signs(low, "called") else ()))
    found += (Entity(m.start(), m.end(), "iban", m[0].replace(" ", "")) for m in (IBAN.finditer(text) if digits else ()) if iban_ok(m[0].replace(" ", "")))
    for m in IPV6.finditer(text) if text.count(":") > 1 else ():
        if ":" in m[0].strip(":"):
            try:
                found.append(Entity(m.start(), m.end(), "ipv6", str(ipaddress.IPv6Address(m[0]))))
            except ValueError:
                continue
    return found


def _secret(value: str) -> str:
    """Hexadecimal values are one whatever their case."""
    return value.lower() if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else value


def detect(text: str) -> list[Entity]:
    """The entities of a text, by start; of overlapping ones the first (the longer on ties)."""
    low = text.lower()
    found = _numbers(text, low) + _names(text)
    if "@" in text:
        found += (Entity(m.start(), m.end(), "email", m[0].lower()) for m in EMAIL.finditer(text))
    if _signs(low, "secret"):
        found += (Entity(m.start(), m.end(), "secret", m[0]) for m in SECRET.finditer(text))
    if ("=" in text or ":" in text) and _signs(low, "assigned"):
        found += (Entity(*m.span("value"), "secret", _secret(m["value"])) for m in ASSIGNED.finditer(text))
    if _signs(low, "born"):
        found += (Entity(*m.span("date"), "date", m["date"]) for m in BORN.finditer(text))
    if DIGIT.search(text) and _signs(low, "street"):
        found += (Entity(*m.span(m.lastgroup), "street", m[m.lastgroup].lower()) for m in STREET.finditer(text))
    out: list[Entity] = []
    for e in sorted(set(found), key=lambda e: (e.start, -e.end, e.kind)):
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


#: Attempts that are drawn; later ones are numbers of a format.
MOST_ROUNDS = 80


class Draw:
    """A keyed stream of choices."""

    def __init__(self, key: bytes, *parts: object) -> None:
        digest = hashlib.blake2b("\x00".join(map(str, parts)).encode(), key=key, digest_size=64).digest()
        self.state = int.from_bytes(digest)

    def below(self, n: int) -> int:
        if self.state < n << 64:
            self.state = int.from_bytes(hashlib.blake2b(self.state.to_bytes(65), digest_size=64).digest())
        self.state, out = divmod(self.state, n)
        return out

    def pick(self, options):
        return options[self.below(len(options))]


class Place(Draw):
    """The choices of the n-th surrogate of a format, in the order of its numbers."""

    def __init__(self, n: int) -> None:
        self.state = n

    def below(self, n: int) -> int:
        self.state, out = divmod(self.state, n)
        return out


class Room(Draw):
    """Counts the surrogates of a format."""

    def __init__(self) -> None:
        self.state = 1

    def below(self, n: int) -> int:
        self.state *= n
        return 0


#: Syllables of made-up names by script: consonants, vowels, endings by gender.
SOUNDS = {
    "latin": ("bdfgklmnprstv", "aeiou", {"f": ("a", "ia", "ina"), "m": ("n", "r", "s"), "n": ("el", "en", "in"), "-": ("er", "man", "ton")}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"f": ("а", "ина", "ова"), "m": ("н", "р", "ов"), "n": ("ин", "ен", "ан"), "-": ("ко", "ук", "ян")}),
    "greek": ("βγδζκλμνπρστ", "αειου", {"f": ("α", "η", "ια"), "m": ("ος", "ης", "ας"), "n": ("ις", "ω", "ι"), "-": ("ου", "ιδης", "ακης")}),
}


def _same_class(draw: Draw, char: str) -> str:
    if char.isdigit():
        return str(draw.below(10))
    if "a" <= char <= "z":
        return chr(97 + draw.below(26))
    if "A" <= char <= "Z":
        return chr(65 + draw.below(26))
    return char if not char.isalnum() else chr(97 + draw.below(26))


def _word(draw: Draw, size: int, letters: str, gender: str) -> str:
    consonants, vowels, endings = SOUNDS[letters]
    return "".join(draw.pick(consonants) + draw.pick(vowels) for _ in range(size)) + draw.pick(consonants) + draw.pick(endings[gender])


def _hex(draw: Draw, char: str) -> str:
    return draw.pick("0123456789abcdef") if char.isalnum() else char


def _permuted(key: bytes, shape: str, x: int, n: int, back: bool = False) -> int:
    """A keyed permutation of range(n), or its inverse: four Feistel rounds over a square, walked until it is in the range."""
    side = math.isqrt(n - 1) + 1
    mix = lambda k, v: int.from_bytes(hashlib.blake2b(f"{shape}\x00{k}\x00{v}".encode(), key=key, digest_size=8).digest()) % side
    while True:
        a, b = divmod(x, side)
        for k in range(4):
            a, b = ((b - mix(3 - k, a)) % side, a) if back else (b, (a + mix(k, b)) % side)
        x = a * side + b
        if x < n:
            return x


def _order(p: int, q: int, year: int) -> str:
    """Which of two numbers may be the day and which the month of a date, if any."""
    days = lambda month: 29 if month == 2 and (year % 400 == 0 or year % 4 == 0 and year % 100) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]
    if 1 <= p <= 12 and 1 <= q <= 12:
        return "either"
    return "day" if 1 <= q <= 12 < p <= days(q) else "month" if 1 <= p <= 12 < q <= days(p) else "none"


def other_date(key: bytes, value: str) -> str:
    """The date that takes this one's place: a keyed cycle through all dates of its format, order of day and month, and decade. What is no date goes through what is none."""
    parts, lengths = re.findall(r"\d+", value), [len(x) for x in re.findall(r"\d+", value)]
    at = 0 if lengths[0] == 4 != lengths[2] else 2  # the year's place
    whole = lambda x: (x[at], *(v for k, v in enumerate(x) if k != at))
    year, p, q = whole([int(x) for x in parts])
    order = _order(p, q, year)
    shape, decade = f"{re.sub(r'\d', '0', value)}|{order}", year // 10 * 10
    if order == "none":
        x, n = int("".join(parts)), 10 ** sum(lengths)
    else:
        x, n, shape = (year - decade << 10) + (p << 5) + q, 10 << 10, f"{shape}|{decade}"
    while True:
        x = _permuted(key, shape, (_permuted(key, shape, x, n) + 1) % n, n, back=True)
        if order == "none":
            digits = iter(f"{x:0{sum(lengths)}d}")
            made = ["".join(next(digits) for _ in range(size)) for size in lengths]
        else:
            y, *rest = decade + (x >> 10), x >> 5 & 31, x & 31
            made = [f"{v:0{size}d}" for v, size in zip([*rest[:at], y, *rest[at:]], lengths)]
        y, p, q = whole([int(v) for v in made])
        if _order(p, q, y) == order and [len(v) for v in made] == lengths:
            numbers = iter(made)
            return re.sub(r"\d+", lambda _: next(numbers), value)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0, outer: int = 0, draw: Draw | None = None) -> str:
    """The canonical surrogate of a canonical value: drawn, or from MOST_ROUNDS on that number of its format. outer: the attempt at which an address's domain was settled."""
    draw = draw or (Draw(key, kind, value, attempt) if attempt < MOST_ROUNDS else Place(attempt - MOST_ROUNDS))
    longer = min(attempt, MOST_ROUNDS) // 4
    if kind == "domain":
        labels = value.split(".")
        shaped = ["".join(_same_class(draw, c) for c in x) for x in labels[:-1]]
        return ".".join([shaped[0] + "".join(_same_class(draw, "a") for _ in range(longer)), *shaped[1:], labels[-1]])
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return "".join(_same_class(draw, c) for c in local + "a" * longer) + "@" + surrogate(key, "domain", domain, outer)
    if kind == "ip":
        octets = value.split(".")
        keep = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] or octets[0] == "172" and 16 <= int(octets[1]) < 32 else 0
        head = octets[:keep] if keep < 2 or not longer else ["10"]  # the larger private net where the own is full
        public = [str(draw.pick([x for x in range(1, 224) if x not in (10, 127, 172, 192)]))] if not keep else []
        head = head + public
        return ".".join([*head, *(str(1 + draw.below(254)) for _ in range(4 - len(head)))])
    if kind == "ipv6":
        groups = ipaddress.IPv6Address(value).exploded.split(":")
        return str(ipaddress.IPv6Address(":".join([groups[0], *("".join(_hex(draw, c) for c in g) if g != "0000" else g for g in groups[1:-1]), f"{1 + draw.below(65535):04x}"])))
    if kind == "card":
        body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "ssn":
        area = draw.pick([x for x in range(1, 900) if x != 666])
        return f"{area:03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "phone":
        code = country(value[1:])
        return f"+{code}{2 + draw.below(8)}" + "".join(str(draw.below(10)) for _ in value[len(code) + 2 :])
    if kind == "iban":
        body = "".join(_same_class(draw, c) for c in value[4:])
        return next(x for n in range(2, 99) if iban_ok(x := f"{value[:2]}{n:02d}{body}"))
    if kind == "secret":
        head = next((h for h in ("AKIA", "ASIA", "sk-", "ghp_", "gho_", "ghs_", "ghu_") if value.startswith(h)), "")
        one = _hex if re.fullmatch(r"[0-9a-f]+", value) else _same_class
        return head + "".join(one(draw, c) for c in value[len(head) :])
    if kind == "date":
        return other_date(key, value)
    if kind == "street":
        number, _, name = value.rpartition(" ") if not value[0].isdigit() else value.partition(" ")
        return "".join(str(1 + draw.below(9)) for _ in number) + " " * bool(number) + _word(draw, max(1, min(4, len(name) // 3)) + longer, "latin", "-")
    _, gender, letters = kind.split(":")
    if letters == "han":
        return "".join(draw.pick(HAN_SURNAMES) for _ in range(len(value) + longer))
    return _word(draw, max(1, min(4, len(value) // 3)) + longer, letters, gender)


def rendered(original: str, kind: str, made: str) -> str:
    """The surrogate in the format of this occurrence: its separators, or its case."""
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(made.lstrip("+")[-sum(map(str.isalnum, original)) :])  # a number without its country code has the last digits
        return "".join(next(chars) if c.isalnum() else c for c in original)
    if kind in ("ip", "date"):
        return made
    if kind == "secret":
        return made.upper() if original.isupper() and made.islower() else made
    if original.isupper():
        return made.upper()
    return made if kind in ("email", "ipv6") else re.sub(r"[^\W\d_]", lambda m: m[0].upper(), made, count=1)


FOUND = "doc_id long, row_key long, kind string, value string"


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["row_key"].to_pylist(), batch["text"]):
            found = {(e.kind, e.value) for e in detect(text.as_py() or "")}
            found |= {("domain", value.rpartition("@")[2]) for kind, value in found if kind == "email"}
            rows += [(doc_id, key, *x) for x in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "row_key", "kind", "value"])


def _made(key: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, *x) for x in zip(*(batch[k].to_pylist() for k in ("kind", "value", "attempt", "outer")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "made"])

    return rows


#: Kinds whose surrogates may be entities of the corpus; numbers of a format that a row deals at once.
LOOSE, SLICE = ("date",), 1 << 16


def _settled(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, outer, made) of (kind, value, outer): the first attempts at which no two of a kind share a surrogate and none is an entity of the corpus."""
    now = entities.withColumn("attempt", F.lit(0).cast("long")).select("kind", "value", "attempt", "outer")
    real = entities.where(~F.col("kind").isin(*LOOSE)).select("kind", F.col("value").alias("made"), F.lit(True).alias("real"))
    for _ in range(MOST_ROUNDS):
        made = stored(now.mapInArrow(_made(key), "kind string, value string, attempt long, outer int, made string"), "surrogates")
        held = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "value")).alias("first"))
        judged = made.join(held, ["kind", "made"]).join(real, ["kind", "made"], "left")
        taken = (F.col("first.value") != F.col("value")) | F.coalesce("real", F.lit(False))
        again = stored(judged.where(taken).select("kind", "value", F.lit(1).alias("more")), "collisions")
        if again.isEmpty():
            return made
        now = made.join(again, ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"), "outer")
    done = made.join(again, ["kind", "value"], "left_anti")
    return done.unionByName(_placed(made.join(again, ["kind", "value"], "left_semi"), done.select("kind", "made").unionByName(real.select("kind", "made")).distinct(), key))


def _shaped(key: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, value, outer in zip(*(batch[k].to_pylist() for k in ("kind", "value", "outer"))):
                surrogate(key, kind, value, MOST_ROUNDS, outer, room := Room())
                first, last = (surrogate(key, kind, value, MOST_ROUNDS + n, outer) for n in (0, room.state - 1))
                turn = hashlib.blake2b(f"{kind}\x00{value}".encode(), key=key, digest_size=16).hexdigest()
                out.append((kind, value, outer, f"{first} {last}", min(room.state, 1 << 62), turn))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], ["kind", "value", "outer", "shape", "room", "turn"])

    return rows


def _counted(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with n, their place from 0 in their kind and shape by `order`: sorted over tasks, whose sizes are summed, so that a large shape is no single task's."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_rows = stored(rows.orderBy("kind", "shape", order).withColumn("task", F.spark_partition_id()).withColumn("place", place), name)
    before = F.sum("count").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = sorted_rows.groupBy("task").count().select("task", F.coalesce(before, F.lit(0)).alias("before"))  # a row a task
    every = sorted_rows.join(F.broadcast(tasks), "task").withColumn("n", F.col("before") + F.col("place")).drop("task", "place", "before")
    return every.join(every.groupBy("kind", "shape").agg(F.min("n").alias("first")), ["kind", "shape"]).withColumn("n", F.col("n") - F.col("first")).drop("first")


def _placed(rest: DataFrame, taken: DataFrame, key: bytes) -> DataFrame:
    """What no draw found a place for, dealt to the free numbers of each format, in an order that the key gives. Of as many numbers as are taken or wanted enough are free, so no more are looked at;
    an error only where a format has fewer."""
    rest = stored(rest.select("kind", "value", "outer").mapInArrow(_shaped(key), "kind string, value string, outer int, shape string, room long, turn string"), "unplaced")
    taken = stored(taken, "taken")
    wanted = rest.groupBy("kind", "shape").agg(F.count("*").alias("wanted"), F.min("room").alias("room"), F.min(F.struct("value", "outer")).alias("one"))
    sizes = wanted.join(taken.groupBy("kind").agg(F.count("*").alias("taken")), "kind", "left").withColumn("upto", F.least("room", F.col("wanted") + F.coalesce("taken", F.lit(0))))
    slices = sizes.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("upto") - 1) / SLICE)))).repartition(int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shape", "slice")
    numbers = slices.withColumn("at", F.explode(F.sequence(F.col("slice") * SLICE, F.least((F.col("slice") + 1) * SLICE, "upto") - 1)))
    made = numbers.select("kind", "one.value", (F.col("at") + MOST_ROUNDS).alias("attempt"), "one.outer", "shape").mapInArrow(_made(key), "kind string, value string, attempt long, outer int, shape string, made string")
    free = made.join(taken, ["kind", "made"], "left_anti").groupBy("kind", "made").agg(F.min(F.struct("shape", "attempt")).alias("f")).select("kind", "made", "f.*")
    placed = stored(_counted(rest.drop("room"), "turn", "turns").join(_counted(free, "attempt", "free"), ["kind", "shape", "n"]).select("kind", "value", "attempt", "outer", "made"), "placed")
    lost = rest.join(placed, ["kind", "value"], "left_anti").select("kind", "value").limit(5).collect()
    if lost:
        raise ValueError(f"formats with fewer surrogates than entities: {[tuple(x) for x in lost]}")
    return placed


def assignments(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, outer, made) for every distinct entity: mail domains first, then addresses within their domains and all others."""
    entities = stored(found.select("kind", "value").distinct().withColumn("outer", F.lit(0)), "entities")
    domains = _settled(entities.where("kind = 'domain'"), key)
    moved = domains.where("attempt > 0").select(F.col("value").alias("domain"), F.col("attempt").cast("int").alias("__outer"))
    rest = entities.where("kind <> 'domain'").withColumn("domain", F.when(F.col("kind") == "email", F.substring_index("value", "@", -1)))
    rest = rest.join(moved, "domain", "left").select("kind", "value", F.coalesce("__outer", "outer").alias("outer"))
    return domains.unionByName(_settled(rest, key))


def _replaced(key: bytes, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for text, tries in zip(batch["text"].to_pylist(), batch["__tries"].to_pylist()):
                attempts = {(x["kind"], x["value"]): (x["attempt"], x["outer"]) for x in tries or ()}
                parts, spans, at, size = [], [], 0, 0
                for e in detect(text) if text else ():
                    new = rendered(text[e.start : e.end], e.kind, surrogate(key, e.kind, e.value, *attempts.get((e.kind, e.value), ())))
                    parts += [text[at : e.start], new]
                    size += e.start - at
                    spans.append({"kind": e.kind, "start": size, "length": len(new)})
                    size, at = size + len(new), e.end
                texts.append(None if text is None else "".join([*parts, text[at:]]))
                found.append(spans)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if k == "text" else batch[k] for k in names), pa.array(found, kind)], [*names, "surrogates"])

    return rows


#: The session's setting that holds the key, and what stands for it where it is unset, as in tests: whoever knows a key can rebuild its surrogates.
KEY_SETTING, OPEN_KEY = "quantra.pii.key", b"no secret"


def session_key(spark) -> bytes:
    return (spark.conf.get(KEY_SETTING, None) or "").encode() or OPEN_KEY


def replace_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs (doc_id long, text string) with surrogates in the text: doc_id, text, surrogates (kind, start and length of each in the new text).

    Null texts stay null and empty ones empty; very long ones are rewritten whole; repeated rows and rows without doc_id are each rewritten. An empty table
    gives an empty result. Other columns are ignored, whatever their names. The same key and corpus give the same result; without one, the session's quantra.pii.key counts.
    """
    key = key or session_key(docs.sparkSession)
    texts = docs.select("doc_id", "text", row_key().alias("row_key"))
    found = stored(texts.where("text IS NOT NULL").mapInArrow(_detected, FOUND), "found")
    retried = stored(assignments(found, key).where("attempt > 0 OR outer > 0").select("kind", "value", "attempt", "outer"), "retried")
    tries = found.join(small(retried, 100_000), ["kind", "value"]).distinct().groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("kind", "value", "attempt", "outer")).alias("__tries"))
    tries = small(stored(tries.withColumnsRenamed({"doc_id": "__id", "row_key": "__key"}), "tries"), 100_000)
    joined = texts.join(tries, texts.doc_id.eqNullSafe(tries["__id"]) & (texts.row_key == tries["__key"]), "left").select("doc_id", "text", "__tries")
    return joined.mapInArrow(_replaced(key, ["doc_id", "text"]), "doc_id long, text string, surrogates array<struct<kind:string,start:int,length:int>>")


def op2_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    got = replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "text", F.size("surrogates").cast("long").alias("n_surrogates"), "surrogates")
