"""Keyed surrogates for personal data: consistent by type, script, gender and format, distinct and coreferent.

Emails, phone numbers, IP addresses, card numbers, social security numbers, account numbers (IBAN) and names after a title, after
words that introduce one, or that begin with a common given name are found where texts are read. Every entity has a canonical form
(digits alone, lower-case address, one part of a person's name), and its surrogate is a function of a secret key, its kind and that
form, drawn anew in the spelling that stands in the text:

* numbers keep their length, signs, leading part and the truth of their check digit; they go through a keyed permutation of
  digits, so different numbers of a kind never meet;
* letters and digits of addresses are redrawn class by class (case, script and accents stay); top-level domains stay;
* names are replaced name by name from lists of the same gender and script, or by syllables once a list is used up, so a person
  with and without first name stays one.

Spark gathers the distinct entities of all documents and checks the surrogates: if two entities of a kind got one surrogate, or
one got what is itself an entity of the corpus, all but the least draw again, until none collide. Redrawn ones are few; up to
`BROADCAST_ROWS` of them are broadcast, and beyond that they reach their documents by a join.

Null texts stay null; empty ones are empty. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstrand.llm import common

BROADCAST_ROWS = 200_000
#: Share of a space of numbers beyond which surrogates may be numbers of the corpus; rounds of redrawing, of which each settles most.
DENSE, ROUNDS = 4, 80

#: Read from an at sign to the right, and (turned round) to the left, so that no text is walked through again and again.
_DOMAIN, _LOCAL = re.compile(r"@\w[\w-]*(?:\.\w[\w-]*)+"), re.compile(r"\w[\w.+-]*")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
_CARD = re.compile(r"(?<![\w])\d(?:[ -]?\d){12,18}(?![\w])")
_PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,5}){1,3}(?!\w)|(?<![\w+])\+\d{9,15}(?!\w)")
_DIGITS = re.compile(r"\d")
_COUNTRY = re.compile(r"\+(\d{1,3})[ .(-]")

# Titles by gender, and names by gender and script from which surrogates are drawn first.
TITLES = {
    "m": "Mr Mister Sir Herr Herrn Monsieur M Señor Sr Don Господин Г-н Κύριος",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Doña Госпожа Г-жа Κυρία",
    "n": "Dr Prof Professor",
}
INTRODUCING = "name is|names are|called|Name:|name:|Contact:|contact:|Dear|Signed,|Regards,|regards,|Sincerely,|heiße|heißt|Liebe|Lieber|s'appelle|m'appelle|Cher|Chère|llamo|llama|Querido|Querida"
COMMON_GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Peter Hans Klaus Jürgen Wolfgang Stefan Jean Pierre Michel Philippe Jacques José Juan Luis Carlos Miguel Pedro".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Emily Jane Alice Helen Ursula Monika Petra Sabine Renate Marie Nathalie Isabelle Sylvie Catherine Carmen Josefa Isabel Pilar Dolores Lucía".split(),
}
GIVEN = {
    ("m", "LATIN"): "Adam Bruno Conrad David Emil Felix Gabriel Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul Quentin Robert Simon Thomas Victor Walter".split(),
    ("f", "LATIN"): "Anna Bella Clara Diana Emma Flora Greta Helena Ines Julia Karla Laura Maria Nora Olga Paula Rosa Sara Teresa Vera Wanda Zoe".split(),
    ("n", "LATIN"): "Alex Andrea Charlie Dominique Eden Francis Gale Jamie Kim Lee Morgan Nico Robin Sam Toni".split(),
    ("m", "CYRILLIC"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид Максим Никита".split(),
    ("f", "CYRILLIC"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина".split(),
    ("m", "GREEK"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λουκάς Μάρκος Νίκος Πέτρος".split(),
    ("f", "GREEK"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
FAMILY = {
    "LATIN": "Abbott Berger Costa Dumont Ellis Fischer Garcia Hansen Ibarra Jensen Keller Lambert Moreau Novak Olsen Petit Quinn Rossi Sander Torres Ulrich Vidal Weber York Zeller".split(),
    "CYRILLIC": "Антонов Белов Волков Громов Давыдов Ершов Жуков Зайцев Ильин Комаров Лебедев Морозов".split(),
    "GREEK": "Αγγελής Βλάχος Γεωργίου Δούκας Ζαχαρίου Ιωάννου Καρράς Λάμπρου Μελάς Νικολάου".split(),
}
SYLLABLES = {
    "LATIN": "ba be bi bo da de di do fa fe ga ge ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te va ve".split(),
    "CYRILLIC": "ба бе во га де жи зо ка ле ми но па ре си то ха че ша".split(),
    "GREEK": "βα γε δι ζο θα κε λι μο να πε ρι σο τα φε χι".split(),
}
# Letters with marks of the Latin script, which replace one another.
MARKED = "àáâäåçèéêëíîïñóôöùúûüý"

_GENDER = {t: g for g, names in TITLES.items() for t in names.split()}
_COMMON = {n: g for g, names in COMMON_GIVEN.items() for n in names}
_ONE_OF = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
_PART = r"[^\W\d_a-z]\w+(?:-[^\W\d_a-z]\w+){0,3}"
_TITLED = re.compile(rf"(?<!\w)({_ONE_OF(_GENDER)})\.?[ \xa0]+({_PART}(?:[ \xa0]{_PART}){{0,2}})")
_INTRODUCED = re.compile(rf"(?<!\w)(?:{INTRODUCING})[ \xa0]({_PART}[ \xa0]{_PART})(?!\w)")
_GIVEN_FIRST = re.compile(rf"(?<![\w-])((?:{_ONE_OF(_COMMON)})(?:-{_PART})?[ \xa0](?:[A-Z]\.[ \xa0])?{_PART})(?!\w)")
_WORD = re.compile(r"\w+")

ENTITY = "kind string, form string"


def script_of(name: str) -> str:
    """The script of the first letter; names of scripts without a list count as Latin."""
    word = unicodedata.name(name[:1], "LATIN").split()[0]
    return word if word in SYLLABLES else "LATIN"


def luhn(digits: str) -> int:
    """What has to be added to the last digit for the check to hold, modulo 10."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, body: str) -> str:
    """The two check digits of an account number."""
    return str(98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97).zfill(2)


def people(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, name) of every part of a person's name that something tells to be one, in order."""
    parts: list[tuple[int, int, str, str, str]] = []
    for pattern in (_TITLED, _INTRODUCED, _GIVEN_FIRST):
        for m in pattern.finditer(text):
            names = [n for n in re.finditer(r"[^ \xa0-]+", m[m.lastindex]) if not n[0].endswith(".")]
            gender = _GENDER[m[1]] if pattern is _TITLED else _COMMON.get(names[0][0], "n")
            last = m[m.lastindex].replace("\xa0", " ").rfind(" ") + 1
            for n in names:
                role = "family" if n.start() >= last else "given"
                parts.append((m.start(m.lastindex) + n.start(), m.start(m.lastindex) + n.end(), role, gender, n[0]))
    parts.sort()
    gender_of: dict[str, str] = {}
    for _, _, role, gender, name in parts:
        if role == "given" and gender != "n":
            gender_of.setdefault(name.casefold(), gender)
    out = []
    for start, end, role, gender, name in parts:
        if gender == "n":
            gender = gender_of.get(name.casefold(), "n")
        out.append((start, end, f"family:{script_of(name)}" if role == "family" else f"given:{gender}:{script_of(name)}", name))
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) in order, without overlaps; parts of names are an entity each."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def add(start: int, end: int, kind: str, form: str) -> None:
        if taken.find(1, start, end) < 0:
            found.append((start, end, kind, form))
            taken[start:end] = b"\x01" * (end - start)

    at = text.find("@")
    before = 0
    while at >= 0:
        local, domain = _LOCAL.match(text[before:at][::-1]), _DOMAIN.match(text, at)
        if local and domain:
            add(at - local.end(), domain.end(), "email", text[at - local.end() : domain.end()].lower())
        before, at = at + 1, text.find("@", at + 1)
    if _DIGITS.search(text):
        for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            for m in pattern.finditer(text):
                form = re.sub(r"[^0-9A-Z.]" if kind in ("iban", "ip") else r"\D", "", m[0])
                if kind == "phone":
                    if not 7 <= len(form) <= 15:
                        continue
                    country = _COUNTRY.match(m[0])
                    form = f"{country[1]}-{form[len(country[1]) :]}" if country else f"-{form}"
                add(m.start(), m.end(), kind, form)
    known: dict[str, str] = {}
    for start, end, kind, name in people(text):
        add(start, end, kind, name.casefold())
        known.setdefault(name, kind)
    if known:
        for m in _WORD.finditer(text):
            if m[0] in known:
                add(m.start(), m.end(), known[m[0]], m[0].casefold())
    return sorted(found)


def space_of(kind: str, form: str) -> tuple[str, float]:
    """The finite space in which a number's surrogates lie, with its size; other kinds have room without end."""
    if kind == "ip":
        return f"ip {form.partition('.')[0]}", 2.0**24
    if kind == "ssn":
        return f"ssn {len(form)}", 10.0 ** len(form)
    if kind == "card":
        return f"card {form[0]} {len(form)} {luhn(form)}", 10.0 ** (len(form) - 2)
    if kind == "phone":
        country, _, rest = form.partition("-")
        return f"phone {country} {len(rest)}", 10.0 ** len(rest)
    return "", math.inf


class Keyed:
    """Surrogates under a key. `tries` counts how often an entity had to draw again."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _number(self, *parts: object) -> int:
        return int.from_bytes(hmac.digest(self.key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256))

    def _permuted(self, kind: str, digits: str, tries: int) -> str:
        """A permutation of the digit strings of this length: an unbalanced Feistel network, applied again for every try."""
        if len(digits) < 2:
            return str((int(digits) + self._number(kind, "one", tries)) % 10) if digits else ""
        half = len(digits) // 2
        for turn in range(tries + 1):
            left, right = digits[:half], digits[half:]
            for step in range(4):
                right = str((int(right) + self._number(kind, len(digits), turn, step, "r", left)) % 10 ** len(right)).zfill(len(right))
                left = str((int(left) + self._number(kind, len(digits), turn, step, "l", right)) % 10 ** len(left)).zfill(len(left))
            digits = left + right
        return digits

    def _redrawn(self, text: str, *seed: object) -> str:
        """Every letter and digit anew, within its class."""
        number, out = self._number(*seed), []
        for i, c in enumerate(text):
            if i % 24 == 23:
                number = self._number(*seed, i)
            low = c.lower()
            pool = "0123456789" if c.isdecimal() else "abcdefghijklmnopqrstuvwxyz" if low.isascii() and low.isalpha() else MARKED if low in MARKED else "".join(SYLLABLES[script_of(low)]) if c.isalpha() else ""
            if pool:
                number, k = divmod(number, len(pool))
                out.append(pool[k].upper() if c.isupper() else pool[k])
            else:
                out.append(c)
        return "".join(out)

    def form(self, kind: str, form: str, tries: int = 0) -> str:
        """The canonical form of the surrogate."""
        if kind == "card":
            return self._card(form, tries)
        if kind == "phone":
            country, _, rest = form.partition("-")
            return f"{country}-{self._permuted(kind, rest, tries)}"
        if kind == "ssn":
            return self._permuted(kind, form, tries)
        if kind == "ip":
            first, *rest = form.split(".")
            low = sum(int(x) << (16 - 8 * i) for i, x in enumerate(rest))
            for _ in range(tries + 1):
                low = self._octets(first, low)
            return ".".join([first, *(str(low >> (16 - 8 * i) & 255) for i in range(3))])
        if kind == "iban":
            body = self._redrawn(form[4:], kind, form, tries)
            return form[:2] + (iban_check(form[:2], body) if form[2:4] == iban_check(form[:2], form[4:]) else self._permuted(kind, form[2:4], tries)) + body
        if kind == "email":
            name, _, domain = form.rpartition("@")
            labels = domain.split(".")
            longer = "x" * (tries // 3)
            return self._redrawn(name + longer, kind, form, tries) + "@" + ".".join([*(self._redrawn(x, "domain", domain, i) for i, x in enumerate(labels[:-1])), labels[-1]])
        sort, *detail = kind.split(":")
        names = FAMILY.get(detail[0], ()) if sort == "family" else GIVEN.get(tuple(detail), ())
        number = self._number(kind, form, tries)
        if tries < 2 and names:
            return names[number % len(names)].casefold()
        parts, syllables = [], SYLLABLES[detail[-1]]
        for _ in range(3 + tries // 3):
            number, k = divmod(number, len(syllables))
            parts.append(syllables[k])
        return "".join(parts)

    def _octets(self, first: str, low: int) -> int:
        left, right = low >> 12, low & 4095
        for step in range(6):
            left, right = right, (left + self._number("ip", first, step, right)) % 4096
        return left << 12 | right

    def _card(self, form: str, tries: int) -> str:
        payload = form[0] + self._permuted("card", form[1:-1], tries)
        off = luhn(form)
        return next(payload + str(d) for d in range(10) if luhn(payload + str(d)) == off)

    def spelled(self, kind: str, written: str, surrogate: str) -> str:
        """A surrogate's canonical form as the entity is written: its signs, spaces and case."""
        if kind in ("card", "phone", "ssn", "iban"):
            signs = iter(c for c in surrogate if c.isalnum())
            return "".join(next(signs, "") if c.isalnum() else c for c in written)
        if kind == "email":
            return "".join(s.upper() if i < len(written) and written[i].isupper() else s for i, s in enumerate(surrogate))
        if kind == "ip":
            return surrogate
        return surrogate.upper() if len(written) > 1 and written.isupper() else surrogate[:1].upper() + surrogate[1:]


def _redraws(found: DataFrame, keyed: Keyed) -> DataFrame:
    """(kind, form, tries) of the distinct entities that must draw again to be distinct from all others and from the corpus."""
    spaced = "space string, size double"

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                spaces = [space_of(*row) for row in zip(batch.column("kind").to_pylist(), batch.column("form").to_pylist(), strict=True)]
                columns = [pa.array([s[0] for s in spaces], pa.string()), pa.array([s[1] for s in spaces], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("form"), *columns], ["kind", "form", "space", "size"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(c).to_pylist() for c in ("kind", "form", "tries")]
                names = pa.array([keyed.form(*row) for row in zip(*columns, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "form", "tries")), names], ["kind", "form", "tries", "name"])

    #: Spaces are told apart by kind, length and leading part, so there are few.
    placed = common.materialise(found.mapInArrow(sized, f"{ENTITY}, {spaced}"))
    dense = placed.where("space <> ''").groupBy("space").agg(F.count("*").alias("n"), F.first("size").alias("size")).where(F.col("n") * DENSE > F.col("size"))
    state = common.materialise(placed.join(F.broadcast(dense.select("space")), "space", "left_anti").select("kind", "form").withColumn("tries", F.lit(0)))
    real = state.select("kind", F.col("form").alias("name"), F.lit(True).alias("real"))
    for _ in range(ROUNDS):
        drawn_ = common.materialise(state.mapInArrow(drawn, f"{ENTITY}, tries int, name string"))
        shared = drawn_.groupBy("kind", "name").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("tries"), "form")).alias("first"))
        bad = shared.join(real, ["kind", "name"], "left").where("n > 1 or real").select("kind", "name", F.when(F.col("real").isNull(), F.col("first.form")).alias("winner"))
        bad = common.materialise(bad)
        if not bad.head(1):
            return drawn_.where("tries > 0").select("kind", "form", "tries")
        again = (F.col("bad.name").isNotNull() & ~F.coalesce(F.col("form") == F.col("winner"), F.lit(False))).cast("int")
        state = drawn_.alias("d").join(bad.alias("bad"), ["kind", "name"], "left").select("kind", "form", (F.col("tries") + again).cast("int").alias("tries"))
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def _lookups(found: DataFrame, keyed: Keyed) -> DataFrame:
    """(kind, form, now, tries) of the entities (kind, form, n) whose surrogate is of another kind `now` than told, or was drawn again."""
    part = lambda i: F.split("kind", ":").getItem(i)
    given = found.where(F.col("kind").startswith("given:")).select("form", part(1).alias("gender"), part(2).alias("script"), "n")
    told = given.where("gender <> 'n'").groupBy("form", "script").agg(F.max_by("gender", F.struct("n", "gender")).alias("gender"))
    named = told.select(F.concat(F.lit("given:n:"), "script").alias("kind"), "form", F.concat_ws(":", F.lit("given"), "gender", "script").alias("_told"))
    rows = common.materialise(found.select("kind", "form").join(named, ["kind", "form"], "left").select("kind", "form", F.coalesce("_told", "kind").alias("now")))
    redraws = _redraws(rows.select(F.col("now").alias("kind"), "form").distinct(), keyed).select(F.col("kind").alias("now"), "form", "tries")
    joined = rows.join(redraws, ["now", "form"], "left").where("now <> kind or tries is not null")
    return joined.select("kind", "form", "now", F.coalesce("tries", F.lit(0)).alias("tries"))


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, n_entities, spans, text) for every row of `docs` (doc_id, text); spans: kind:start:end of what was replaced, by commas."""
    keyed = Keyed(key)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            pairs = Counter(p for t in batch.column("text").to_pylist() if t for p in {e[2:] for e in entities(t)})
            columns = [pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(pairs.values()), pa.int64())], ["kind", "form", "n"])

    counted = rows.select("text").mapInArrow(gathered, f"{ENTITY}, n long").groupBy("kind", "form").agg(F.sum("n").alias("n"))
    lookups = common.materialise(_lookups(common.materialise(counted), keyed))
    few = lookups.count() <= BROADCAST_ROWS
    known = {(r["kind"], r["form"]): (r["now"], r["tries"]) for r in lookups.toLocalIterator()} if few else {}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            counts, spans, texts = [], [], []
            own = batch.column("own").to_pylist() if "own" in batch.schema.names else [None] * batch.num_rows
            for text, more in zip(batch.column("text").to_pylist(), own, strict=True):
                known = {(m["kind"], m["form"]): (m["now"], m["tries"]) for m in more} if more else shared.value
                parts, at, listed = [], 0, []
                for start, end, kind, form in entities(text) if text else ():
                    now, tries = known.get((kind, form), (kind, 0))
                    parts += [text[at:start], keyed.spelled(now, text[start:end], keyed.form(now, form, tries))]
                    listed.append(f"{kind.partition(':')[0]}:{start}:{end}")
                    at = end
                counts.append(len(listed))
                spans.append(",".join(listed))
                texts.append(None if text is None else "".join([*parts, text[at:]]))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_entities", "spans", "text"])

    if not few:
        rows = _with_lookups(rows, lookups)
    return rows.mapInArrow(replaced, "doc_id long, n_entities long, spans string, text string")


def _with_lookups(rows: DataFrame, lookups: DataFrame) -> DataFrame:
    """The rows with the lookups that concern their own entities, in column own."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = [(k, *e) for k, t in zip(batch.column("print").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for e in {e[2:] for e in entities(t)}]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["print", "kind", "form"])

    rows = rows.withColumn("print", F.xxhash64("text"))
    concerned = rows.select("print", "text").mapInArrow(listed, f"print long, {ENTITY}").distinct().join(lookups, ["kind", "form"])
    own = concerned.groupBy("print").agg(F.collect_list(F.struct("kind", "form", "now", "tries")).alias("own"))
    return rows.join(own, "print", "left").select("doc_id", "text", "own")
