"""Personal data, each entity replaced by a keyed surrogate of its type and format.

A surrogate is the image of the entity under a keyed permutation of all strings of its format: letters stay letters of
their script and kind (vowels for vowels, so that names can be read; a last letter stays, and with it the gender that it
shows; in scripts that aren't listed, letters of the same block and category), digits stay digits, card and account numbers
keep right check digits, addresses of machines and dates stay valid, signs stay. Names that are listed by script, gender and
length are permuted among these, all others among the strings that aren't listed. So equal
entities get equal surrogates in every document, different ones different surrogates, without a table of what was seen:
the permutation can't collide. It also has no fixed point: it is a shift by a keyed step, seen through another permutation.
What has nothing to permute, such as signs only, gets a keyed label instead, so nothing that was found stays in clear.
Spelling variants of an entity share their letters and digits and so their surrogate's: case, and in a phone number every
sign between the digits, as it is permuted over its country's code and bare digits and then filled into its format again (a
North American number without a code counts as one with +1; a "(0)" stays). The words of a name found with a title, as many
as there are, are replaced wherever the document has them, its initials there only; joining words (van, de la) stay.
``entities`` lists what was found; ``collisions`` checks distinctness over a whole corpus.

Found are: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card and bank account numbers (IBAN) with right check
digits, social security numbers, long hexadecimal secrets, values behind words such as token or password, dates behind words
of birth, street names with a number, and names behind a title.

A null text stays null and an empty one empty; both have no entities. Repeated rows stay. A null id changes nothing.
"""

from __future__ import annotations

import datetime
import ipaddress
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, replace_rows, spread

# Letters that may stand for each other, by script and kind.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûüœ", "çñýÿßðþšžčřłśźćń",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
)
CLASS_OF = {c: (x, i) for x in CLASSES for i, c in enumerate(x)}
# Given names of women and of men, and family names; those of one length stand for each other.
LISTED = (
    "Anna Emma Ella Nora Rosa Vera Lena Lisa Dora Maria Clara Julia Laura Paula Sofia Elena Diana Carla Teresa Amanda Monica Angela Helena Claudia Martina Barbara Antonia Roberta",
    "Karl Paul Hans Mark John Ivan Erik Peter David Simon James Oscar Henry Jakob Martin Thomas Daniel Robert Walter Samuel Michael Charles Richard Antonio Giovanni Benjamin",
    "Wolf Bauer Weber Meyer Klein Braun Smith Jones Brown Lopez Perez Rossi Silva Becker Müller Wagner Miller Wilson Taylor Garcia Torres Moreno Martin Schmidt Fischer Schwarz Johnson Roberts Bernard Dubois Hoffmann Williams Anderson Martinez Gonzalez",
    "Анна Вера Нина Инна Мария Елена Ольга Ирина Галина Марина Полина Татьяна Наталья", "Иван Пётр Олег Юрий Павел Семён Антон Роман Максим Андрей Сергей Михаил Николай", "Иванов Петров Орлов Козлов Волков Смирнов Соколов Попов Лебедев Морозов",
)
HEX = "0123456789abcdef"


@lru_cache(4096)
def alphabet(c: str) -> tuple[str, int] | None:
    """What a lower-case letter or digit may become, and its place there: its class, or its like in its block of 128."""
    if c in CLASS_OF:
        return CLASS_OF[c]
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return None
    block = [x for x in map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1)) if unicodedata.category(x) == kind and x not in CLASS_OF and x.lower() == x]
    return ("".join(block), block.index(c)) if c in block else None


def _listed() -> dict[str, tuple[tuple[str, ...], int]]:
    out: dict[str, tuple[tuple[str, ...], int]] = {}
    for names in LISTED:
        for n in range(3, 10):
            own = tuple(x for x in names.lower().split() if len(x) == n and x not in out)
            if len(own) > 1:
                out |= {x: (own, k) for k, x in enumerate(own)}
    return out


LISTED_NAMES = _listed()
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Monsieur", "Madame", "Mme", "Mlle", "Signor", "Signora", "Господин", "Госпожа", "Κύριος", "Κυρία")

EMAIL = re.compile(r"(?<![\w.+-])[\w][\w.+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w@])")
NUMBER = re.compile(
    r"(?<![\w.+])(?:"
    r"(?P<ip>(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?![\w])|\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w])|\d{3}[.-]\d{3}[.-]\d{4}(?![\w]))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>\d(?:[ -]?\d){12,18}(?![\w]))"
    r")"
)
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9a-fA-F:]*\d)(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?)(?![\w:])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
BORN = re.compile(r"(?i)\b(?:born(?: on)?|dob|date of birth|birth ?date|birthday|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)\b[ \xa0]?:?[ \xa0]?(\d{4}([-./])\d{1,2}\2\d{1,2}|\d{1,2}([-./])\d{1,2}\3\d{4})(?!\w)")
STREET = re.compile(r"(?<![\w.,])(?:\d{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square|Court)|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|gasse|allee|platz) \d{1,4}[a-z]?)(?!\w)")
STREET_KIND = re.compile(r"Street|Avenue|Road|Lane|Drive|Boulevard|Square|Court|straße|strasse|gasse|allee|platz")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 47_482  # to the end of 2029
SECRET = re.compile(r"(?<![\w])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?![\w])")
BEHIND = re.compile(r"(?i)\b(?:token|secret|passwor[dt]|passwd|pwd|api[ _-]?key|access[ _-]?key)\b\s*[=:]\s*([\"']?)([^\s\"'&%*$#]{6,})\1")
UPPER = f"[{re.escape(''.join(c for c in map(chr, range(1 << 16)) if c.isupper()))}]"
LETTER = r"[^\W\d_]"
# Words that join the parts of a name, and the codes of countries with fewer than three digits.
JOINING = "de del della dello dei degli di da do dos das du des la las le los van von vom zu zum zur der den ter ten te af av al el bin ibn ben bint abu y e i".split()
CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
WORD = rf"(?:{UPPER}{LETTER}?['’]{LETTER}{{2,}}|{UPPER}{LETTER}+(?:['’]{UPPER}{LETTER}*)*)"
PART = rf"(?:(?:d|l|dell|dall|all)['’])?(?!(?:{'|'.join(TITLES)})\.?[ \xa0]{UPPER})(?:{WORD}|{UPPER}(?:\.|(?=[ \xa0]{UPPER})))"
JOINED = rf"(?:(?:{'|'.join(JOINING)})[ \xa0])*"
# Behind a title: up to three words of any case (of these the capitalised ones count), and all parts of a capitalised name.
NAME = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.?[ \xa0](?=((?:[^\W\d_a-zà-þ][^\W\d_]+)(?:[  -][^\W\d_][^\W\d_]+){{0,2}})?)(?=({JOINED}{PART}(?:(?:(?<=\.)[ \xa0-]?|[ \xa0-]){JOINED}{PART})*)?)")
NAME_PART = re.compile(rf"(?<![^\W_])(?:({WORD})|({UPPER})(?!\w))")
DIGITS = re.compile(r"\d")


def luhn(digits: str) -> int:
    """The check digit that should follow."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 - k % 2)
        total += x - 9 * (x > 9)
    return -total % 10


def remainder97(plain: str) -> int:
    """Of an account number's characters as a number, letters counting from 10 on."""
    return int("".join(str(int(c, 36)) for c in plain)) % 97


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(20_000)(self._of)

    def __reduce__(self):
        return Surrogates, (self.key,)

    def _draw(self, *what: object) -> int:
        return int.from_bytes(blake2b(repr(what).encode(), key=self.key, digest_size=32).digest())

    def permuted(self, kind: str, places: list[tuple[int, int]]) -> list[int]:
        """Digits (value, base) of a mixed-radix number -> those of its image under the permutation for these bases."""
        shape = tuple(b for _, b in places)
        half = len(shape) // 2
        left_n = right_n = 1
        left = right = 0
        for k, (v, b) in enumerate(places):
            if k < half:
                left, left_n = left * b + v, left_n * b
            else:
                right, right_n = right * b + v, right_n * b
        n = left_n * right_n
        if n < 2:
            return [v for v, _ in places]

        def turn(a: int, b: int, rounds: range, sign: int) -> tuple[int, int]:
            for r in rounds:
                if r % 2:
                    b = (b + sign * self._draw(kind, shape, r, a)) % right_n
                else:
                    a = (a + sign * self._draw(kind, shape, r, b)) % left_n
            return a, b

        a, b = turn(left, right, range(8), 1)
        x = (a * right_n + b + 1 + self._draw(kind, shape) % (n - 1)) % n
        a, b = turn(*divmod(x, right_n), range(7, -1, -1), -1)
        x, out = a * right_n + b, []
        for base in reversed(shape):
            x, v = divmod(x, base)
            out.append(v)
        return out[::-1]

    def spelled(self, kind: str, text: str, keep_last: bool = False) -> str:
        """Letters and digits permuted within their classes, case and signs as they were."""
        at = [(k, *a) for k, c in enumerate(text) if len(c.lower()) == 1 and (a := alphabet(c.lower()))]
        if keep_last and len(at) > 1 and at[-1][1] != CLASSES[0]:
            _, of, place = at.pop()
            kind = f"{kind}{(CLASSES.index(of) if of in CLASSES else of, place)}"
        out = list(text)
        for (k, of, _), v in zip(at, self.permuted(kind, [(i, len(of)) for _, of, i in at]), strict=True):
            x = of[v]
            out[k] = x.upper() if text[k].isupper() and len(x.upper()) == 1 else x
        return "".join(out)

    def named(self, word: str) -> str:
        """A listed name by another of its list, any other by one that isn't listed: so neither can take the other's."""
        got = LISTED_NAMES.get(word.lower())
        if got is not None:
            own, place = got
            new = own[self.permuted(f"listed{own[0]}", [(place, len(own))])[0]]
            return new.upper() if word.isupper() else new.capitalize() if word[0].isupper() else new
        new = self.spelled("name", word, keep_last=True)
        while new.lower() in LISTED_NAMES:
            new = self.spelled("name", new, keep_last=True)
        return new

    def dated(self, text: str) -> str:
        """Another day of the same years, written alike. Of day and month the first is the day with dots, else the second if both could be."""
        sign = next(c for c in text if not c.isdigit())
        parts = text.split(sign)
        year = 0 if len(parts[0]) == 4 else 2
        x, y = (int(p) for k, p in enumerate(parts) if k != year)
        day_first = not year == 0 and (x > 12 or y <= 12 and sign == ".")
        day, month = (x, y) if day_first else (y, x)
        try:
            place = datetime.date(int(parts[year]), month, day).toordinal() - FIRST_DAY
        except ValueError:
            return self.spelled("date", text)
        if not 0 <= place < DAYS:
            return self.spelled("date", text)
        new = datetime.date.fromordinal(FIRST_DAY + self.permuted("date", [(place, DAYS)])[0])
        rest = iter([new.day, new.month] if day_first else [new.month, new.day])
        return sign.join(str(new.year) if k == year else f"{next(rest):0{len(p)}d}" for k, p in enumerate(parts))

    def _of(self, kind: str, text: str) -> str:
        new = self._surrogate(kind, text)
        # Nothing to permute in it: a keyed label, long enough not to collide.
        return new if new != text else f"[{kind}-{blake2b(text.lower().encode(), key=self.key, digest_size=10).hexdigest()}]"

    def _surrogate(self, kind: str, text: str) -> str:
        if kind == "ip" and ":" in text:
            digits = ipaddress.IPv6Address(text).exploded.replace(":", "")
            got = "".join(HEX[v] for v in self.permuted("ipv6", [(HEX.index(c), 16) for c in digits]))
            new = ipaddress.IPv6Address(int(got, 16))
            out = new.compressed if "::" in text else ":".join(f"{int(x, 16):x}" for x in new.exploded.split(":"))
            return out.upper() if text != text.lower() else out
        if kind == "iban":
            plain = text.replace(" ", "")
            body = self.spelled(f"iban{plain[:2]}{len(plain)}", plain[4:]).upper()
            new = iter(plain[:2] + f"{98 - remainder97(body + plain[:2] + '00'):02d}" + body)
            return "".join(c if c == " " else next(new) for c in text)
        if kind == "date":
            return self.dated(text)
        if kind == "street" and (kept := STREET_KIND.search(text)):
            parts = re.split(r"(\d+)", text[: kept.start()] + "\0" + text[kept.end() :])
            number = lambda x: "".join(str(v + (b == 9)) for v, b in self._number(x))
            return "".join(number(x) if k % 2 else self.spelled("street", x) for k, x in enumerate(parts)).replace("\0", kept[0])
        if kind == "ip":
            octets = [int(x) for x in text.split(".")]
            first = (octets[0] - 1, 223) if 0 < octets[0] < 224 else (max(0, octets[0] - 223), 33)
            got = self.permuted("ip", [first, *((x, 256) for x in octets[1:])])
            got[0] = got[0] + 1 if first[1] == 223 else got[0] + 223 if got[0] else 0
            return ".".join(map(str, got))
        if kind == "card":
            digits = [c for c in text if c.isdigit()]
            got = [digits[0], *map(str, self.permuted("card" + digits[0], [(int(c), 10) for c in digits[1:-1]]))]
            return self._refilled(text, [*got, str(luhn("".join(got)))])
        if kind in ("phone", "ssn"):
            # The code of the country stays; numbers (and in North America their exchanges) that begin with 2 to 9 still do.
            digits, code, kept, starts = re.sub(r"\D", "", text), "", "", ()
            if kind == "phone":
                code = next((digits[:n] for n in (1, 2) if digits[:n] in CODES), digits[:3]) if text[0] == "+" else "1"
                kept = code + "0" * ("(0)" in text) if text[0] == "+" else ""
                starts = (0, 3) if code == "1" else (0,)
            places = [(int(c), 10) if k not in starts else (int(c) - 2, 8) if c > "1" else (int(c), 2) for k, c in enumerate(digits[len(kept) :])]
            got = self.permuted(f"{kind}{code}", places)
            return self._refilled(text, [*kept, *(str(v + 2 * (b == 8)) for v, (_, b) in zip(got, places, strict=True))])
        if kind == "secret" and SECRET.fullmatch(text):
            got = "".join(HEX[v] for v in self.permuted("hex", [(HEX.index(c), 16) for c in text.lower()]))
            return got.upper() if text.upper() == text else got
        if kind == "email":
            local, domain = text.rsplit("@", 1)
            name, _, top = domain.rpartition(".")
            # Domains that are set aside for examples show no one.
            kept = re.search(r"(?i)(?:^|\.)example$", name)
            return self.spelled("email", f"{local}@{name[: kept.start()] if kept else name}") + (name[kept.start() :] if kept else "") + "." + top
        if kind == "name":
            return " ".join(self.named(w) for w in text.split(" "))
        return self.spelled(kind, text)

    def _number(self, digits: str) -> list[tuple[int, int]]:
        """Digits of a number that doesn't begin with 0, with what each can be."""
        places = [(int(c) - 1, 9) if k == 0 and c != "0" else (int(c), 10) for k, c in enumerate(digits)]
        return list(zip(self.permuted("number", places), (b for _, b in places), strict=True))

    @staticmethod
    def _refilled(text: str, digits: list[str]) -> str:
        given = iter(digits)
        return "".join(next(given) if c.isdigit() else c for c in text)


def _is_ipv6(text: str) -> bool:
    """An address of some machine: not the own one, nor what isn't one."""
    try:
        a = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return not (a.is_loopback or a.is_unspecified)


def found(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order and apart; of those that overlap the first, of those the longest."""
    out = []
    if "@" in text:
        out += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if DIGITS.search(text):
        for m in NUMBER.finditer(text):
            kind = m.lastgroup
            if kind == "ip" and not all(x == str(int(x)) and int(x) < 256 for x in m[0].split(".")):
                continue
            if kind == "card":
                digits = re.sub(r"\D", "", m[0])
                if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) < 2:
                    continue
            if m[0].isascii():
                out.append((*m.span(), kind))
        out += [(*m.span(), "secret") for m in SECRET.finditer(text)]
        for m in IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and remainder97(plain[4:] + plain[:4]) == 1:
                out.append((*m.span(), "iban"))
        out += [(*m.span(1), "date") for m in BORN.finditer(text)]
        out += [(*m.span(), "street") for m in STREET.finditer(text)]
        if ":" in text:
            out += [(*m.span(), "ip") for m in IPV6.finditer(text) if _is_ipv6(m[0])]
    if "=" in text or ":" in text:
        out += [(*m.span(2), "secret") for m in BEHIND.finditer(text)]
    if any(t in text for t in TITLES):
        names, titled = set(), set()
        for m in NAME.finditer(text):
            titled |= {w for w in re.split(r"[  -]", m[1] or "") if len(w) > 1 and w[0].isupper()}
            for part in NAME_PART.finditer(m[2] or ""):
                if part[1]:
                    names.add(part[1])
                else:
                    out.append((m.start(2) + part.start(), m.start(2) + part.end(), "name"))
        names |= titled - set(TITLES)
        if names:
            word = re.compile(rf"(?<!\w)(?:{'|'.join(re.sub("['’]", "['’]", re.escape(w)) for w in sorted(names, key=lambda w: (-len(w), w)))})(?!\w)")
            out += [(*m.span(), "name") for m in word.finditer(text)]
    apart, last = [], 0
    for s, e, kind in sorted(out, key=lambda x: (x[0], -x[1], x[2])):
        if s >= last:
            apart.append((s, e, kind))
            last = e
    return apart


def replaced(text: str, spans: list[tuple[int, int, str]], of: Surrogates) -> str:
    parts, at = [], 0
    for s, e, kind in spans:
        parts += [text[at:s], of.of(kind, text[s:e])]
        at = e
    return "".join(parts) + text[at:]


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text with its entities replaced, n_entities, kinds as kind:count by name) for each row."""
    of = Surrogates(key)
    own = spread(docs.select("doc_id", "text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = batch.column(1).to_pylist()
        spans = [found(t) if t else [] for t in texts]
        kinds = [Counter(k for *_, k in s) for s in spans]
        return pa.table({
            "doc_id": batch.column(0),
            "text": pa.array([replaced(t, s, of) if s else t for t, s in zip(texts, spans, strict=True)], pa.string()),
            "n_entities": pa.array(map(len, spans), pa.int64()),
            "kinds": pa.array([",".join(f"{k}:{c[k]}" for k in sorted(c)) for c in kinds], pa.string()),
        })

    return map_arrow(own, run, f"doc_id {kind}, text string, n_entities long, kinds string")


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """docs, all columns, with the entities of ``text`` replaced; n_chars, if there is one, follows a text that has changed."""
    of = Surrogates(key)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column("text").to_pylist()
        new = [replaced(t, s, of) if t and (s := found(t)) else t for t in old]
        names = batch.schema.names
        out = batch.set_column(names.index("text"), batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))
        if "n_chars" in names:
            field = batch.schema.field("n_chars")
            n = [len(b) if a != b else c for a, b, c in zip(old, new, batch.column("n_chars").to_pylist(), strict=True)]
            out = out.set_column(names.index("n_chars"), field, pa.array(n, field.type))
        return out

    return replace_rows(docs, run)


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, kind, start, end, entity, surrogate) for each entity found; places count characters from 0."""
    of = Surrogates(key)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.Table | None:
        rows = [(k, kind, s, e, t[s:e], of.of(kind, t[s:e])) for k, t in enumerate(batch.column(1).to_pylist()) if t for s, e, kind in found(t)]
        if not rows:
            return None
        k, *cols = zip(*rows, strict=True)
        return pa.table([batch.column(0).take(pa.array(k)), *map(pa.array, cols)], names=["doc_id", "kind", "start", "end", "entity", "surrogate"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, kind string, start long, end long, entity string, surrogate string")


def collisions(listed: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one entity of a kind (without regard to case): there should be none."""
    pairs = listed.select("kind", F.lower("entity").alias("entity"), F.lower("surrogate").alias("surrogate")).distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count("*").alias("n_entities")).where("n_entities > 1")
