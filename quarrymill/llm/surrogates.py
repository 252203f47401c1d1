"""Surrogates for personal data: detected entities are replaced by keyed values of their type and form.

A surrogate is a function of the key, the type, the entity's normal form and an attempt number, so an entity has the same one
in every document (coreference), in whatever format it is written there. It keeps digits digits, letters letters, case,
length and punctuation; the country code of a phone number, the first digit and check digit of a card number, the digits of each part of an
address, the country and check digits of an IBAN, the top-level domain; of names the script and the gender (of scripts
without a list of names, the letters' script, letter by letter).

Persons are found by a title of TITLES and, in the same text, by any part of a name that has a title there; names that have
none anywhere in the text stay. Each part of a name is an entity, a given or a family name, so a person has the same name with
every title and with none, and by one part alone. A given name has the gender that the titles before it have more often in
the corpus; before Dr and the like, the gender of its form. Initials are exchanged by a keyed permutation.

All entities of the corpus are checked: where two get one surrogate, or a surrogate is itself an entity of the
corpus, all but one move to the next attempt, until none is left. Only those on later attempts, or of another gender than their
form has, need a table.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import documents, dropped, written
from .tokens import slices

#: Entities that need a later attempt: up to this number they are broadcast, more are joined per document.
BROADCAST_LATER = 200_000
#: Attempts after which a surrogate may be longer than its entity, and an address have other numbers of digits (the form has too
#: few values).
GROW = 12
TITLES = {"m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Sir", "господин", "κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "госпожа", "κυρία"), "": ("Dr", "Prof")}
#: Given names by script and gender; family names are made of syllables.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Katja Laura Maria Nina Olga Paula Rosa Sara Teresa Vera".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μιχάλης Νίκος Πέτρος Σταύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
}
SYLLABLES = {"latin": "ba bel bor den dor fal gar hem kal lan len mar mon nor pel ran ros sel tan vel win zor".split(), "cyrillic": "ба бел бор вен гор дан кал лан мар нов пел рос сел тан".split(), "greek": "βα γαρ δελ καλ λαν μαρ νικ παλ ρος σελ ταν φιλ".split()}
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
#: Words in lower case that may stand within a name, and stay.
PARTICLES = "de del della di da dos das do du la le van von der den zu zur ter ten bin ibn al el y e af av".split()
#: Endings of made given names, and last letters by which a given name that is in no list counts as a woman's.
ENDINGS = {("latin", "m"): "o us an in or".split(), ("latin", "f"): "a ia ine ella e".split(), ("cyrillic", "m"): "ан ид ор ей".split(), ("cyrillic", "f"): "а ия ина ея".split(), ("greek", "m"): "ος ης ας".split(), ("greek", "f"): "α η ία".split()}
_FEMALE = frozenset("aeáéаяαηή")
#: Combining marks, which belong to the letter before them.
_MARKS = "".join(chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Mc"))
_FIRST = r"[^\W\d_a-zà-öø-ÿа-яα-ω]"
_PART = rf"(?:{_FIRST}\.(?=[ \xa0-])|[\u4e00-\u9fff]{{1,4}}|{_FIRST}(?:[^\W\d_]|[{_MARKS}]|['’](?=[^\W\d_]))*)"
_JOIN = rf"[ \xa0-](?:(?:{'|'.join(PARTICLES)})[ \xa0])*(?:[dl]['’])?"
_PERSON = re.compile(rf"\b({_TITLE})(\.?[ \xa0])({_PART}(?:{_JOIN}{_PART})*)")
_PARTS = re.compile(_PART)
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_LOCAL, _DOMAIN = frozenset("._%+-'’"), re.compile(r"@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.[^\W\d_]{2,24}")
_NUMBERS = (
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z(+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9])")),
)
KINDS = ("email", "iban", "ip", "ssn", "card", "phone", "person")


def mentions(text: str) -> list[tuple[int, int, str, list[tuple]]]:
    """(start, end, kind, parts), ascending and without overlap: earlier kinds of KINDS first. parts: (start, end, kind, normal form,
    gender of the title) of what has a surrogate: of a person each part of the name, of others the whole."""
    found: list[tuple] = []
    taken: set[int] = set()

    def add(start: int, end: int, kind: str, parts: list[tuple] | None = None) -> bool:
        if any(i in taken for i in range(start, end)):
            return False
        taken.update(range(start, end))
        found.append((start, end, kind, [(start, end, kind, normal(kind, text[start:end]), "")] if parts is None else parts))
        return True

    at = text.find("@")
    while at >= 0:
        if right := _DOMAIN.match(text, at):
            start = at
            quoted = text.rfind('"', max(0, text.rfind("\n", 0, at) + 1), at - 1) if text[at - 1 : at] == '"' else -1
            if quoted >= 0:
                start = quoted
            else:
                while start and (text[start - 1] in _LOCAL or text[start - 1].isalnum()):
                    start -= 1
                while start < at and not text[start].isalnum():  # the first is a letter or digit
                    start += 1
            if start < at:
                add(start, right.end(), "email")
        at = text.find("@", at + 1)
    if re.search("[0-9]", text):
        for kind, pattern in _NUMBERS:
            for m in pattern.finditer(text):
                add(m.start(), m.end(), kind)
    role: dict[str, str] = {}
    for m in _PERSON.finditer(text):
        own = [p.span() for p in _PARTS.finditer(text, *m.span(3))]
        full = [x for x in own if text[x[1] - 1] != "."]
        parts = [(a, b, "initial" if text[b - 1] == "." else "given" if len(own) > 1 and a == own[0][0] else "family", text[a:b].lower(), _GENDER[m[1]]) for a, b in own]
        if add(m.start(), m.end(), "person", parts):
            for a, b in full:
                kind = next(k for x, _, k, _, _ in parts if x == a)
                if b - a > 1 or text[a:b] > "\u02ff":  # one Latin letter alone tells no name
                    role.setdefault(text[a:b].lower(), kind)
    if role:
        names = "|".join(map(re.escape, sorted(role, key=len, reverse=True)))
        for m in re.finditer(rf"(?<![^\W\d_])(?:{names})(?:[ \xa0-](?:{names}))*(?![^\W\d_])", text, re.I):
            own = [(p.start(), p.end()) for p in re.finditer(names, m[0], re.I)]
            if all(m[0][a] == m[0][a].upper() for a, _ in own):
                add(m.start(), m.end(), "person", [(m.start() + a, m.start() + b, role.get(m[0][a:b].lower(), "family"), m[0][a:b].lower(), "") for a, b in own])
    return sorted(found)


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of mentions()."""
    return [x[:3] for x in mentions(text)]


def normal(kind: str, value: str) -> str:
    """The form by which mentions are the same entity."""
    if kind in ("email", "given", "family", "initial"):
        return value.lower()
    if kind == "ip":
        return value
    return re.sub(r"[^0-9A-Z]" if kind == "iban" else r"[^0-9]", "", value)


class Stream:
    """Numbers from an HMAC of the key."""

    def __init__(self, key: bytes, *of):
        self.key, self.of, self.k, self.left = key, "\0".join(map(str, of)).encode(), 0, 0
        self.bits = 0

    def below(self, n: int) -> int:
        if self.left < 64:
            self.bits = int.from_bytes(hmac.new(self.key, self.of + self.k.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.k, self.left = self.k + 1, 256
        out = self.bits % n
        self.bits, self.left = self.bits // n, self.left - n.bit_length()
        return out


def _like(text: str, s: Stream) -> str:
    """Other letters and digits in the places of letters and digits."""
    letters = lambda c: "abcdefghijklmnopqrstuvwxyz" if c.isascii() else _letters(c) or c
    return "".join(str(s.below(10)) if c.isdigit() else letters(c)[s.below(len(letters(c)))] if c.isalpha() else c for c in text)


def luhn(digits: str) -> int:
    """The check digit of the digits before it."""
    return -sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits))) % 10


def script(name: str) -> str | None:
    """Of those that have lists of names; None: another, whose letters are replaced one by one."""
    c = next((c for c in name if c.isalpha()), "a")
    known = unicodedata.name(c, "").split(" ")[0].lower()
    return known if known in SYLLABLES else None


@lru_cache(4096)
def _letters(c: str) -> str:
    """The letters of c's script and category in its block (128 code points, for Han all common ones)."""
    if "\u4e00" <= c <= "\u9fff":
        return "".join(map(chr, range(0x4E00, 0xA000)))
    same = lambda x: (unicodedata.category(x), unicodedata.name(x, "").split(" ")[0])
    start = ord(c) & ~127
    return "".join(x for x in map(chr, range(start, start + 128)) if same(x) == same(c))


def _spelt(part: str, s: Stream, more: int) -> str:
    """Other letters of the same script in the places of letters, and `more` further ones; marks stay."""
    out = "".join(_letters(c)[s.below(len(_letters(c)))] if c.isalpha() else c for c in part)
    last = next(c for c in reversed(part) if c.isalpha())
    return out + "".join(_letters(last)[s.below(len(_letters(last)))] for _ in range(more))


def form_gender(name: str) -> str:
    """The gender that a given name's form has: that of a list, else by its last letter."""
    for (_, gender), names in GIVEN.items():
        if name.capitalize() in names:
            return gender
    return "f" if name[-1:] in _FEMALE else "m"


@lru_cache(4096)
def _cycle(key: bytes, c: str) -> dict[str, str]:
    """A keyed permutation of the letters of c's script that leaves none in its place (but where there is one alone)."""
    order = sorted(_letters(c), key=lambda x: hmac.new(key, x.encode(), hashlib.sha256).digest())
    return dict(zip(order, [*order[1:], order[0]])) if order else {}


def surrogate(key: bytes, kind: str, value: str, attempt: int, gender: str = "") -> str:
    """The surrogate's normal form for an entity's normal form. gender: of a given name, where titles tell it."""
    if kind == "initial":
        return _cycle(key, value[0].upper()).get(value[0].upper(), value[0]).lower() + "."
    s = Stream(key, kind, value, attempt)
    more = "".join(str(s.below(10)) for _ in range(max(0, attempt - GROW + 1)))
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        d = Stream(key, "domain", domain)  # mailboxes of one domain stay together
        return _like(local, s) + more + "@" + ".".join([*(_like(x, d) for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        # as many digits in each part; networks 10 and 127 stay in theirs
        low, high = (0, 0, 10, 100), (0, 9, 99, 255)
        parts = [s.below(256) if attempt >= GROW else low[len(p)] + s.below(high[len(p)] - low[len(p)] + 1) for p in value.split(".")]
        first = value.split(".")[0]
        return ".".join([first if first in ("10", "127") else str(max(1, parts[0])), *map(str, parts[1:])])
    if kind in ("given", "family"):
        own, longer = script(value), max(0, attempt - GROW)
        if not own:
            return _spelt(value, s, longer).lower()
        sex = gender or form_gender(value)
        if kind == "given" and not attempt:
            return GIVEN[own, sex][s.below(len(GIVEN[own, sex]))].lower()
        made = "".join(SYLLABLES[own][s.below(len(SYLLABLES[own]))] for _ in range((2 if kind == "given" else 3) + longer))
        return made + (ENDINGS[own, sex][s.below(len(ENDINGS[own, sex]))] if kind == "given" else "")
    if kind == "card":
        body = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        check = luhn(body)
        return body + str(check if luhn(value[:-1]) == int(value[-1]) else (check + 1 + s.below(9)) % 10)
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[s.below(26)] for c in value[4:])
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return value[:2] + f"{98 - number % 97:02d}" + body
    keep = max(0, len(value) - 10) if kind == "phone" else 0
    return value[:keep] + "".join(str(2 + s.below(8)) if k == 0 else str(s.below(10)) for k in range(len(value) - keep)) + more


def render(kind: str, written_as: str, new: str) -> str:
    """The surrogate in the format of a mention."""
    if kind == "email":
        out = "".join(n.upper() if o.isupper() else n for o, n in zip(written_as, new)) + new[len(written_as) :]
        return out
    if kind in ("given", "family", "initial"):
        letters = [c for c in written_as if c.isalpha()]
        return new.upper() if len(letters) > 1 and all(c == c.upper() != c.lower() for c in letters) else new[:1].upper() + new[1:]
    if kind == "ip":
        return new
    rest = iter(new)
    return "".join(next(rest) if c.isalnum() else c for c in written_as) + "".join(rest)


def entities(docs: DataFrame) -> DataFrame:
    """kind, value (normal form) and gender of all entities of the corpus, each once. gender: of a given name, that of most titles
    before it, where it isn't that of its form; else ''."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = Counter()
                for t in part.column(1).to_pylist():
                    for _, _, _, parts in mentions(t):
                        found.update((kind, value, gender) for _, _, kind, value, gender in parts if kind != "initial")
                if found:
                    rows = sorted(found)
                    cols = [[k for k, _, _ in rows], [v for _, v, _ in rows], [found[r] * (r[2] == "m") for r in rows], [found[r] * (r[2] == "f") for r in rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["kind", "value", "m", "f"])

    @F.pandas_udf("string")
    def decided(kind: pd.Series, value: pd.Series, m: pd.Series, f: pd.Series) -> pd.Series:
        told = ["" if k != "given" or a == b or form_gender(v) == ("m" if a > b else "f") else "m" if a > b else "f" for k, v, a, b in zip(kind, value, m, f)]
        return pd.Series(told, dtype=object)

    counted = documents(docs).mapInArrow(run, "kind string, value string, m long, f long").groupBy("kind", "value").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    return counted.select("kind", "value", decided("kind", "value", "m", "f").alias("gender"))


def settled(found: DataFrame, key: bytes) -> DataFrame:
    """kind, value, gender, attempt: the first attempts (each row's least) that leave all surrogates distinct and none an entity.

    Each round has the rows that are still open alone. Of those that get one surrogate the first value keeps it, unless it is an
    entity or a settled row has it; that first one is found by an aggregation, so a surrogate that very many rows get in the first
    round (the lists of given names are short) is one row a task, and the joins are of written tables, which Spark can split."""

    @F.pandas_udf("string")
    def made(kind: pd.Series, value: pd.Series, attempt: pd.Series, gender: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, int(a), g) for k, v, a, g in zip(kind, value, attempt, gender)], dtype=object)

    open_ = written(found.select("kind", "value", F.col("gender") if "gender" in found.columns else F.lit("").alias("gender")), "entities")
    real, done, attempt = open_.select("kind", F.col("value").alias("new")), None, 0
    while True:
        rows = written(open_.withColumn("attempt", F.lit(attempt)).withColumn("new", made("kind", "value", "attempt", "gender")), "surrogates")
        first = rows.groupBy("kind", "new").agg(F.min("value").alias("first")).join(real, ["kind", "new"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        first = written(first, "surrogates")
        judged = written(rows.join(first, ["kind", "new"], "left").withColumn("good", F.coalesce(F.col("first") == F.col("value"), F.lit(False))).drop("first"), "surrogates")
        dropped(rows, first, release=False)
        good = judged.where("good").drop("good")
        done = good if done is None else done.unionByName(good)
        if not judged.where("not good").limit(1).count():
            return done.select("kind", "value", "gender", "attempt")
        open_, attempt = judged.where("not good").select("kind", "value", "gender"), attempt + 1


def pseudonymised(docs: DataFrame, key: bytes | str) -> DataFrame:
    """doc_id, n_entities, kinds (each found kind:start:end in the original, comma-joined) and text with surrogates.

    Mailboxes: letters and digits of any script, the signs . _ % + - and apostrophes, or a quoted string, before @ and a domain of any
    script. A title before Han characters takes the whole run of them for the name. Numbers that stand together without a sign
    or a country code are no phones. A text's work grows with its length times the number of its titled names.

    Null text: stays null, no entities. Null doc_id and repeated rows: each has its row. Equal entities have equal surrogates
    in all documents, different ones different. key: the caller's secret; whoever has it can find which surrogate an entity has."""
    key = key.encode() if isinstance(key, str) else key
    later = settled(entities(docs), key).where("attempt > 0 or gender != ''")
    rows = later.limit(BROADCAST_LATER + 1).collect()
    if len(rows) > BROADCAST_LATER:
        return _joined(docs, key, later)
    shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.value): (r.attempt, r.gender) for r in rows})

    def run(batches):
        attempts = shared.value
        for batch in batches:
            for part in slices(batch):
                out = [replaced(t, key, attempts) for t in part.column(1).to_pylist()]
                yield _result(part.column(0), out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


RESULT = "doc_id long, n_entities long, kinds string, text string"


def _result(ids, out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([len(f) for f, _ in out], pa.int64()), pa.array([",".join(f"{k}:{a}:{b}" for a, b, k in f) for f, _ in out], pa.string()), pa.array([t for _, t in out], pa.string())], names=["doc_id", "n_entities", "kinds", "text"])


def replaced(text: str | None, key: bytes, later: dict) -> tuple[list[tuple[int, int, str]], str | None]:
    """The mentions of a text, and the text with surrogates. later: (attempt, gender) by (kind, normal form)."""
    found = mentions(text) if text else []
    out, at = [], 0
    for _, _, _, parts in found:
        for start, end, kind, value, _ in parts:
            out += [text[at:start], render(kind, text[start:end], surrogate(key, kind, value, *later.get((kind, value), (0, ""))))]
            at = end
    return [x[:3] for x in found], "".join([*out, text[at:]]) if found else text


def _joined(docs: DataFrame, key: bytes, later: DataFrame) -> DataFrame:
    """As pseudonymised(), where the later attempts are too many to broadcast: each document gets those of its own entities."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def named(batches):
        for batch in batches:
            for part in slices(batch):
                for o, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = sorted({(k, v) for _, _, _, parts in mentions(t) for _, _, k, v, _ in parts}) if t else []
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array([o] * len(own), pa.int64()), pa.array([k for k, _ in own]), pa.array([v for _, v in own])], names=["hash", "kind", "value"])

    keyed = rows.withColumn("hash", F.xxhash64("doc_id", "text"))
    found = keyed.select("hash", "text").mapInArrow(named, "hash long, kind string, value string").distinct()
    own = found.join(later, ["kind", "value"]).groupBy("hash").agg(F.collect_list(F.struct("kind", "value", "attempt", "gender")).alias("own"))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = [replaced(t, key, {(x["kind"], x["value"]): (x["attempt"], x["gender"]) for x in a or ()}) for t, a in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield _result(part.column(0), out)

    return keyed.join(own, "hash", "left").select("doc_id", "text", "own").mapInArrow(run, RESULT)
