"""Personal data replaced by surrogates of the same kind.

Entities are detected in whole texts. Each distinct value gets a surrogate from a keyed hash that keeps
its kind and format: digits become digits, letters letters of the same case and script, separators
stay; card and IBAN check digits are right again, addresses keep their range, names keep gender
and script. The same value has the same surrogate everywhere (coreference): family names are replaced
word by word, so that "Mr Smith" and "Mr John Smith" share theirs, and hex keys alike wherever they
stand. A name that a title announces is replaced wherever else its document holds it, in full or as
the family name. Names are whole words of any script, with inner capitals, apostrophes, particles
("van", which stay) or in capitals only. Persons that no title announces in their document are not found.

Distinctness is checked over the whole corpus: surrogates that two values share, or that some
document holds as a real value, are drawn again with the next attempt until none is left. From
attempt ``OWN_FORMAT`` on the format gives way: texts and numbers get one more sign per attempt,
private addresses move to 10.0.0.0/8 and then to public ones, so that a full format ends nothing. The
few values that needed a further attempt travel to the documents that hold them by a join; all
others are computed where the text lies.

Defined results: NULL texts stay NULL, texts without entities stay as they are; repeated rows are
each replaced alike; an empty table gives an empty result; columns other than id and text are not
read.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import string
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import picked
from panelwright.runtime import stage

KEY = b"surrogates of this corpus"
#: Attempts within a value's own format; further ones widen it.
OWN_FORMAT = 8

# Names by gender and script, and titles that announce a person of a gender.
#: x: a title of any gender, whose given names are told apart by themselves where they are known.
NAMES = {
    ("f", "latin"): "Alice Anna Carla Clara Diana Elena Emma Eva Greta Helen Ida Julia Laura Lena Lucia Maria Marta Nina Nora Olga Paula Rosa Sara Sofia Vera".split(),
    ("m", "latin"): "Adam Alan Bruno Carl David Eric Felix Frank Georg Hugo Ivan Jan Karl Leo Luis Marco Martin Max Nico Oscar Paul Peter Simon Thomas Viktor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Полина Раиса София".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Иван Карл Лев Максим Никита Олег Павел Роман".split(),
    ("f", "greek"): "Άννα Βασιλική Δήμητρα Ειρήνη Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία".split(),
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Θωμάς Κώστας Λουκάς Μάρκος Νίκος Πέτρος Στέφανος".split(),
}
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Don": "m", "Doña": "f", "господин": "m", "госпожа": "f",
    "Lord": "m", "Lady": "f", "Signor": "m", "Signora": "f", "Dr": "x", "Dra": "f", "Doctor": "x", "Doktor": "x", "Prof": "x", "Professor": "x",
    "доктор": "x", "профессор": "x", "κύριος": "m", "κυρία": "f",
}
SYLLABLES = {"latin": "ba be bo da de do fa ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va vi zo".split(), "cyrillic": "ба бе бо ва ве во да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то".split(), "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε".split()}
#: Words inside names that stay as they are.
PARTICLES = frozenset("al bin da das de del della den der di do dos du el ibn la las le los ten ter van von y zu".split())

MARKS = "".join(c for c in map(chr, range(0x300, 0x3000)) if unicodedata.category(c).startswith("M"))
#: A whole word of any script with its marks, hyphens and apostrophes.
WORD = rf"[^\W\d_](?:[^\W\d_]|['’ʼ\u200c\u200d{MARKS}-])*+(?!\w)"
PATTERNS = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "phone": re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"),
    "ip": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "cloud_key": re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api_key))(?:\s*[=:]\s*)[\"']?([^\s\"',;]{6,})"),
    "hex_key": re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])"),
    "national": re.compile(r"(?<![\w+.-])(?:\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}([.-])\d{3}\1\d{4}|0\d{1,4}[ /-]\d{3,4}[ -]?\d{3,4})(?![\w-]|\.\d)"),
    "person": re.compile(rf"(?<!\w)(?:(?:{'|'.join(TITLES)})\.? )+(?=((?:[^\W\d_]\. |{WORD} ){{0,6}}{WORD}))"),
}
NAME_WORD = re.compile(rf"(?<!\w){WORD}")
POSSESSIVE = re.compile("(?:['’][sS])?['’-]*$")
#: Country codes of one and two digits; all others have three.
COUNTRY = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "phone": "+", "cloud_key": "A"}


def _luhn(digits: str) -> int:
    """Check digit that follows ``digits``."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _valid(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(int(p) < 256 for p in value.split("."))
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return len(set(digits)) > 1 and (len(digits) == 16 or _luhn(digits[:-1]) == int(digits[-1]))
    return True


def _of_name(word: str) -> bool:
    """Whether a word can be a name: it holds a capital, or begins with a letter of a script without case."""
    return any(c.isupper() or c.istitle() for c in word) or not word[0].islower()


def _name_length(words: str) -> int:
    """Length of the name at the beginning of some words: up to three words of a name, with particles before them."""
    length, at, names = 0, 0, 0
    for word in words.split(" "):
        at += len(word)
        if _of_name(word):
            length, names = at, names + 1
        elif word not in PARTICLES:
            break
        if names == 3 or not word.endswith(".") and POSSESSIVE.search(word).start() < len(word):
            break
        at += 1
    return length if not words[:length].endswith(".") else length - 1


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in order, not overlapping; the first kind above wins, mentions of names found come last."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []

    def take(start: int, end: int, kind: str) -> None:
        k = bisect.bisect(taken, (start, end))
        if (not k or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
            taken.insert(k, (start, end, kind))

    digits = any(c.isdigit() for c in text)
    for kind, pattern in PATTERNS.items():
        if kind in NEEDS and NEEDS[kind] not in text or kind in ("phone", "national", "ip", "card", "ssn", "iban", "hex_key") and not digits:
            continue
        for m in pattern.finditer(text):
            start, end = m.span(1 if kind in ("secret", "person") else 0)
            kind_found = "phone" if kind == "national" else kind
            if kind == "person":
                end = start + _name_length(text[start:end])
                if end == start:
                    continue
                end = start + POSSESSIVE.search(text[start:end]).start()
                genders = [TITLES[t.rstrip(".")] for t in text[m.start() : start].split()]
                kind_found = f"person_{next((g for g in genders if g != 'x'), 'x')}"
            elif kind == "secret" and (key := PATTERNS["hex_key"].match(text, start, end)) and not text[key.end() : end].strip(")]}>."):
                end = key.end()
            if _valid(kind, text[start:end]):
                take(start, end, kind_found)
    named: dict[str, dict[str, str]] = {}
    for start, end, kind in taken:
        if kind.startswith("person_"):
            name = text[start:end]
            for form in {name, name.split(" ")[-1], name.upper(), name.split(" ")[-1].upper()}:
                forms = named.setdefault(form.split(" ")[0].rstrip("."), {})
                if forms.get(form, "person_x") == "person_x":
                    forms[form] = kind
    if named:
        for m in NAME_WORD.finditer(text):
            word = m[0][: POSSESSIVE.search(m[0]).start()]
            for form in sorted(named.get(word, ()), key=len, reverse=True):
                end = m.start() + len(form)
                if text.startswith(form, m.start()) and not re.match(r"\w", text[end : end + 1]):
                    take(m.start(), end, named[word][form])
                    break
    return taken


class Stream:
    """Numbers below a bound from a keyed hash of kind, value and attempt."""

    def __init__(self, kind: str, value: str, attempt: int, key: bytes = KEY) -> None:
        self.seed = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode(), hashlib.sha256).digest()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left += hashlib.sha256(self.seed + self.block.to_bytes(8, "big")).digest()
            self.block += 1
        out, self.left = int.from_bytes(self.left[:8], "big") % n, self.left[8:]
        return out


_ALPHABETS = [string.digits, string.ascii_lowercase, string.ascii_uppercase, "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"]


#: Signs that a secret made of signs only can hold.
SIGNS = "!#$%&*+-/<=>?^_|~"


def _alphabet(c: str) -> str | None:
    """The letters or digits that can stand for ``c``; None for other signs."""
    alphabet = next((a for a in _ALPHABETS if c in a), None)
    if alphabet is None and c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(chr(zero + k) for k in range(10))
    if alphabet is None and c.isalpha():
        return _ALPHABETS[2 if c.isupper() else 1]
    return alphabet


def _alike(text: str, stream: Stream, signs: str | None = None) -> str:
    """Every letter and digit replaced within its alphabet; the rest stays, or is drawn from ``signs`` where there is nothing else."""
    alphabets = [_alphabet(c) for c in text]
    if signs and not any(alphabets):
        alphabets = [signs] * len(text)
    return "".join(a[stream.below(len(a))] if a else c for c, a in zip(text, alphabets, strict=True))


def canonical(kind: str, value: str) -> str:
    """Values that mean the same have one form: spelling of separators and case aside."""
    if kind in ("card", "phone"):
        return re.sub(r"[^\d+]", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "email":
        return value.lower()
    return value


def _formatted(plain: str, like: str) -> str:
    """The letters and digits of ``plain`` in the places that they have in ``like``, what is left at the end."""
    signs = iter(plain)
    return "".join([*(next(signs) if c.isalnum() or c == "+" else c for c in like), *signs])


def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The replacement of a value in the value's own format."""
    plain = canonical(kind, value)
    stream = Stream(kind, plain, attempt, key)
    more = max(0, attempt - OWN_FORMAT + 1)
    if kind == "email":
        local, _, domain = plain.rpartition("@")
        labels = domain.split(".")
        by_domain = Stream("domain", domain, 0, key)
        return _alike(local + "a" * more, stream, string.ascii_lowercase) + "@" + ".".join([*(_alike(x, by_domain) for x in labels[:-1]), labels[-1]])
    if kind == "phone":
        code = COUNTRY.match(plain)
        keep = len(code[0]) if code else int(plain[0] in "+0")
        return _formatted(plain[:keep] + _alike(plain[keep:] + "0" * more, stream), value)
    if kind == "card":
        body = plain[:1] + _alike(plain[1:-1] + "0" * more, stream)
        return _formatted(body + str(_luhn(body)), value)
    if kind == "iban":
        body = _alike(plain[4:] + "0" * more, stream)
        number = "".join(str(int(c, 36)) for c in body + plain[:2] + "00")
        return _formatted(f"{plain[:2]}{98 - int(number) % 97:02d}{body}", value)
    if kind == "ip":
        private = ipaddress.ip_address(".".join(str(int(p)) for p in plain.split("."))).is_private
        parts = plain.split(".")
        if private and more:
            parts, private = ["10", *parts[1:]], attempt < 8 * OWN_FORMAT
        keep = (1 if more else 2) if private else 0
        return ".".join(p if k < keep else str(11 + stream.below(89) if k == 0 else 1 + stream.below(254)) for k, p in enumerate(parts))
    if kind == "cloud_key":
        return plain[:4] + _alike(plain[4:], stream)
    if kind == "hex_key" or kind == "secret" and re.fullmatch(r"[0-9a-f]+", plain):
        return "".join("0123456789abcdef"[stream.below(16)] for _ in plain + "0" * more)
    if kind == "family" and not _script(plain):
        return _neighbours(plain + plain[-1] * more, stream)
    if kind == "family":
        syllables = SYLLABLES[_script(plain)]
        return "".join(syllables[stream.below(len(syllables))] for _ in range(3 + min(attempt, 2) + more)).capitalize()
    return _alike(plain + "0" * more, stream, SIGNS if kind == "secret" else None)


def _script(name: str) -> str:
    """Script of a name that has names and syllables of its own; empty for others."""
    found = {unicodedata.name(c, "").split(" ")[0].lower() for c in name if c.isalpha()}
    return next((script for script in SYLLABLES if script in found), "")


def _neighbours(name: str, stream: Stream) -> str:
    """Every letter replaced by one of its kind near it in its script; marks go."""
    out = []
    for c in name:
        kind = unicodedata.category(c)
        near = [x for x in map(chr, range(ord(c) & ~63, (ord(c) & ~63) + 64)) if unicodedata.category(x) == kind] if c.isalpha() else [c]
        out.append("" if kind.startswith("M") else near[stream.below(len(near))])
    return "".join(out)


def _plain(word: str) -> str:
    """A word of a name in its usual spelling, where it stands in capitals only."""
    return word.title() if len(word) > 1 and word.isupper() else word


def _given(kind: str, value: str, attempt: int, key: bytes) -> str:
    """Given name that stands for the first word of a full name, seeded by that word; in a wider format several."""
    given, script = value.split(" ")[0], _script(value)
    if not script:
        return _neighbours(given + given[-1] * max(0, attempt - OWN_FORMAT + 1), Stream("given", given, attempt, key))
    known = [g for g in "fm" if given in NAMES[g, script]]
    genders = [kind[-1]] if kind[-1] in "fm" else known or ["f", "m"]
    names = [n for g in genders for n in NAMES[g, script]]
    stream = Stream("given", given, attempt, key)
    return " ".join(names[stream.below(len(names))] for _ in range(1 + max(0, attempt - OWN_FORMAT + 1)))


def units(kind: str, value: str) -> list[tuple[str, str]]:
    """What surrogates are drawn for, as (kind, canonical value): the value itself, or the parts of a person's name."""
    if kind.startswith("person_"):
        given, *rest = words = [_plain(w) for w in value.split(" ") if w not in PARTICLES]
        return [*([(kind, " ".join(words))] if rest else []), *(("family", w) for w in rest or [given])]
    if kind == "secret" and re.fullmatch("[0-9a-f]+", value):
        kind = "hex_key"
    return [(kind, canonical(kind, value))]


def replacement(kind: str, value: str, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> str:
    """The surrogate of an entity from those of its units."""
    out = []
    for unit in units(kind, value):
        attempt = attempts.get(unit, 0)
        if unit[0].startswith("person_"):
            out.append(_given(*unit, attempt, key))
        else:
            out.append(surrogate(unit[0], unit[1] if unit[0] == "family" else value, attempt, key))
    if not kind.startswith("person_"):
        return out[0]
    names, words = iter(out), value.split(" ")
    return " ".join(w if w in PARTICLES else next(names).upper() if _plain(w) != w else next(names) for w in words)


def replaced(text: str | None, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds replaced."""
    found = entities(text)
    if not found:
        return text, []
    out, at = [], 0
    for start, end, kind in found:
        out += [text[at:start], replacement(kind, text[start:end], attempts, key)]
        at = end
    return "".join([*out, text[at:]]), [kind for _, _, kind in found]


def _mark(kind: str, value: str, attempt: int, key: bytes) -> str:
    """What must differ between the units of a kind. Family names differ already, so full names need another given name per family only."""
    if kind.startswith("person_"):
        return "\t" + _given(kind, value, attempt, key) + " " + value.split(" ", 1)[1]
    return canonical(kind, surrogate(kind, value, attempt, key))


def _mentions(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``text_hash``, ``kind`` and canonical ``value`` of every different unit of a document's entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, values = [], [], []
            for k, t in enumerate(batch.column("text")):
                text = t.as_py()
                for kind, value in sorted({unit for a, b, kind in entities(text) for unit in units(kind, text[a:b])}):
                    at.append(k)
                    kinds.append(kind)
                    values.append(value)
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(place), batch.column("text_hash").take(place), pa.array(kinds, pa.string()), pa.array(values, pa.string())],
                names=["doc_id", "text_hash", "kind", "value"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, kind string, value string")


def _drawn(values: DataFrame, key: bytes) -> DataFrame:
    """``values`` (kind, value, attempt) with the canonical form of their surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [
                _mark(kind, value, attempt, key)
                for kind, value, attempt in zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], names=["kind", "value", "attempt", "drawn"])

    return values.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, drawn string")


def attempts(values: DataFrame, key: bytes = KEY) -> DataFrame:
    """Attempt per distinct (kind, value) at which all surrogates are distinct and none is a real value."""
    now = stage(_drawn(values.select("kind", "value").distinct().withColumn("attempt", F.lit(0)), key))
    while True:
        now = now.withColumn("space", F.regexp_replace("kind", "^person_.", "person"))  # full names differ whatever the title
        first = now.groupBy("space", "drawn").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        shared = now.join(first, ["space", "drawn"]).where("value != first").select("kind", "value")
        real = now.select("kind", F.col("value").alias("drawn"))
        existing = now.join(real, ["kind", "drawn"], "left_semi").select("kind", "value")
        again = stage(shared.union(existing).distinct())
        if again.isEmpty():
            return now.select("kind", "value", "attempt")
        stay = now.join(again, ["kind", "value"], "left_anti")
        redrawn = _drawn(now.join(again, ["kind", "value"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        now = stage(stay.select("kind", "value", "attempt", "drawn").union(redrawn))


def pseudonymized(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Per document ``doc_id``, ``text`` with surrogates, ``n_entities`` and their ``kinds`` in order."""
    rows = picked(docs, doc_id="doc_id", text="text").withColumn("text_hash", F.xxhash64("text"))
    found = stage(_mentions(rows))
    further = stage(attempts(found, key).where("attempt > 0"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if further.isEmpty():
        rows = rows.withColumn("redrawn", F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))
    else:
        held = found.join(further, ["kind", "value"]).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        held = stage(held.agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("redrawn")))
        rows = rows.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, again in zip(batch.column("text"), batch.column("redrawn").to_pylist(), strict=True):
                known = {(e["kind"], e["value"]): e["attempt"] for e in again or ()}
                out.append(replaced(t.as_py(), known, key))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([t for t, _ in out], pa.string()),
                    pa.array([len(k) for _, k in out], pa.int64()),
                    pa.array([k for _, k in out], pa.list_(pa.string())),
                ],
                names=["doc_id", "text", "n_entities", "kinds"],
            )

    return rows.select("doc_id", "text", "redrawn").mapInArrow(run, f"doc_id {kind}, text string, n_entities long, kinds array<string>")
