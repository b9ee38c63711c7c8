"""Personal data replaced by keyed surrogates.

Detected entities (e-mail addresses, phone numbers, IP addresses, card and
account numbers, national ids, IBANs, secrets, and names of persons) get
replacements of the same type and format: digits stay digits, letters stay in
their script and case, an IP address stays one, a number that passes the Luhn
check still does, a given name keeps gender and script, a name its capitals.

Coreference: a surrogate is a function of a secret key, the type and the
entity's identity (HMAC-SHA-256), laid over the format at hand.  The identity
(:func:`identity`) leaves out what only formats a value: the case of names and
e-mail addresses, the separators of numbers, IBANs and phone numbers.  Names
are replaced part by part, so that "Anna Schmidt" and "Frau Schmidt" keep the
same surname; a surname found once in a text is replaced wherever that text has
it, also alone.  A given name has one gender in the whole corpus, that of most
of its mentions (title or listed name; none where they tie), so "Dr Chris
Miller" and "Mr Chris Miller" stay one person.

Distinctness is checked over the whole corpus: all identities propose a
surrogate, and a proposal is accepted if no other of its type has it and it is
itself no entity of the corpus; the others propose again with the next attempt
number.  Given names and surnames are checked together.  What may be proposed
widens with the attempt for every type (more letters or digits, letters for a
secret's symbols, in the end an IPv6 address for an IP address), so the rounds
end whatever the entities are.  Only entities with an attempt above 0, or with
another gender than their mention says, have to be known when texts are
rewritten: up to ``broadcast_rows`` of them are broadcast, more are joined.

Defined cases: a null text stays null; texts without entities stay as they
are, to the byte; repeated rows are rewritten alike; other columns pass
through if named in ``carry``.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import column, fresh_name, slices, staged

# ------------------------------------------------------------------ detection

#: fixed values: common given names by script and gender
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Sophie Emma Julia Clara Elena Lucia Marie Camille Ingrid "
                    "Helga Sabine Carmen Isabel Alice Mary Linda Susan Karen Emily".split(),
    ("latin", "m"): "Peter Paul Thomas Michael John James Robert David Hans Klaus Stefan Carlos "
                    "Miguel Pedro Pierre Jacques Michel Luis Mark Andrew Daniel Martin".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Βασιλική".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Ιωάννης Παύλος".split(),
}
#: fixed values: titles that announce a person, by gender
TITLES = {"f": "Mrs Ms Miss Frau Mme Mlle Madame Señora Sra Госпожа Κυρία".split(),
          "m": "Mr Herr Monsieur Señor Sr Господин Κύριος".split(),
          "u": "Dr Prof".split()}

_GENDER_OF = {n: g for (_, g), names in GIVEN.items() for n in names}
_TITLE_OF = {t: g for g, ts in TITLES.items() for t in ts}


def _chars(*categories: str, end: int = 0x10000) -> str:
    """The characters of some Unicode categories, as the inside of a class."""
    codes = [c for c in range(end) if unicodedata.category(chr(c)) in categories]
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if c + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


_UPPER, _LOWER = _chars("Lu", "Lt"), _chars("Ll") + "\u0300-\u036f"
#: one word of a name: McDonald, O'Neil, Wałęsa; names may be joined by hyphens
_HUMPS = rf"[{_UPPER}](?:['’][{_UPPER}])?[{_LOWER}]+(?:[{_UPPER}][{_LOWER}]+)*"
_HYPHENS = "-‐‑"
_CAP = rf"{_HUMPS}(?:[{_HYPHENS}]{_HUMPS})*"
#: a surname in capitals only: MÜLLER, O'NEIL
_CAPITALS = rf"[{_UPPER}]['’]?[{_UPPER}]{{2,}}(?:[{_HYPHENS}][{_UPPER}]{{2,}})*"
_SURNAME = rf"(?:{_CAP}|{_CAPITALS})"
_NAMES = "|".join(sorted(_GENDER_OF, key=len, reverse=True))
_TITLE = "|".join(sorted(_TITLE_OF, key=len, reverse=True))

#: in order of precedence; where a group is named, only that group is replaced
PATTERNS = (
    ("email", re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")),
    ("secret", re.compile(r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)"
                          r"[\"']?\s*[=:]\s*[\"']?(?P<v>[^\s\"',;]{6,})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]"
                          r"{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9-]{20,})")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"
                        r"(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}"
                      r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)")),
    # the first group of an IPv6 address has three digits or more, one of them decimal
    ("ip", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?=[0-9A-Fa-f]{3})(?:"
                      r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
                      r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}"
                      r"|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:])")),
    ("phone", re.compile(r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)")),
    ("phone", re.compile(r"(?<![\d.+-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w.+])\(0\d{1,4}\) ?\d{3,8}(?:[ -]\d{2,6}){0,2}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w.+-])0\d{2,4}(?:[ -]\d{5,8}|/\d{6,8})(?![\d-])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("number", re.compile(r"(?<![\d.])\d{4}(?:[ -]\d{4}){2,3}[ -]\d{1,7}(?![\d-])")),
    ("number", re.compile(r"(?<!\d)\d{9,}(?!\d)")),
)
_PERSON = re.compile(rf"\b(?:(?P<t>{_TITLE})\.?\s+(?P<a>{_SURNAME})(?:[  ](?P<b>{_SURNAME}))?"
                     rf"|(?P<g>{_NAMES})[  ](?P<s>{_SURNAME}))\b")
_WORD, _PART = re.compile(rf"\b{_SURNAME}\b"), re.compile(rf"\b{_HUMPS}\b")
#: the digits of the patterns: \d is any script's
_DIGIT = _chars("Nd", end=0x110000)
#: any text with an entity matches this (a cheap test over whole batches): the
#: shortest of the numbers, a phone number like +123456, has six digits, and
#: (?i) folds the letters that it folds in the patterns
_MAYBE = (rf"@|[{_DIGIT}][{_DIGIT} .()-]{{4,}}[{_DIGIT}]|(?i:token|secret|passw|pwd|key)|"
          r"A[KS]IA|gh[pousr]_|xox|sk-|"
          r"[0-9A-Fa-f]{3}:[0-9A-Fa-f:]*:|"
          rf"[0-9a-f]{{32}}|[A-Z]{{2}}[{_DIGIT}]{{2}}|" + _TITLE + "|" + _NAMES)


def detect(text: str) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, type) of the entities, in order.  A surname that
    a title or a given name announces is one wherever the text has it, also in
    capitals; the type of a given name tells the gender of this mention."""
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            a, b = m.span("v") if "v" in pattern.groupindex else m.span()
            taken.append((a, b, kind))
    for m in _PERSON.finditer(text):
        if m["t"]:
            g = _TITLE_OF[m["t"]]
            first = m["a"] if m["b"] or m["a"] in _GENDER_OF else None
            if first:
                taken.append((*m.span("a"), "given_" + (g if g != "u" else
                                                        _GENDER_OF.get(first, "u"))))
            if m["b"] or not first:
                taken.append((*m.span("b" if m["b"] else "a"), "surname"))
        else:
            taken.append((*m.span("g"), "given_" + _GENDER_OF[m["g"]]))
            taken.append((*m.span("s"), "surname"))
    surnames = {text[a:b].lower() for a, b, kind in taken if kind == "surname"}
    if surnames:
        for m in _WORD.finditer(text):
            whole = m[0].lower() in surnames
            taken += [(*p.span(), "surname") for p in ([m] if whole else _PART.finditer(
                text, *m.span())) if p[0].lower() in surnames]
    out: list[tuple[int, int, str]] = []
    for order, span in sorted(enumerate(taken), key=lambda x: (x[1][0], x[0])):
        if out and span[0] < out[-1][1]:  # spans overlap: the earlier pattern's stays
            if order < last:
                out[-1], last = span, order
            continue
        out.append(span)
        last = order
    return out


# ----------------------------------------------------------------- surrogates

def part_of(kind: str) -> str:
    """The type without a mention's gender."""
    return kind.partition("_")[0]


def _head(phone: str) -> str:
    """The country code of a phone number, if something sets it off."""
    country = re.match(r"\+\d{1,3}(?=[ .(-])", phone)
    return country[0] if country else "+" if phone[0] == "+" else ""


def identity(kind: str, value: str) -> str:
    """What formats of one entity have in common."""
    if part_of(kind) in ("given", "surname", "email"):
        low = value.lower()
        low = low if len(low) == len(value) else value  # few capitals are two small letters
        return low if kind == "email" else re.sub(f"[{_HYPHENS}]", "-", low.replace("’", "'"))
    if kind in ("iban", "number"):
        return re.sub("[ -]", "", value)
    if kind == "phone":
        head = _head(value)
        return head + re.sub(r"[ .()/-]", "", value[len(head):])
    return value.lower() if kind == "ip" else value


class _Stream:
    """Numbers below a bound from HMAC-SHA-256 in counter mode."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.mac = hmac.new(key, f"{part_of(kind)}\0{attempt}\0{identity(kind, value)}".encode(),
                            hashlib.sha256)
        self.seed, self.n, self.pool = self.mac.digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        v, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return v * n >> 32

    def pick(self, items):
        return items[self.below(len(items))]


#: letters a character may turn into: the lower and upper case of its script
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
              "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
              "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def _script(c: str) -> int:
    return 2 if "Ѐ" <= c <= "ӿ" else 4 if "Ͱ" <= c <= "Ͽ" else 0


def _letter(c: str, r: _Stream) -> str:
    if "一" <= c <= "龥":
        return chr(0x4E00 + r.below(0x9FA5 - 0x4E00))
    return r.pick(_ALPHABETS[_script(c) + c.isupper()])


#: every so many attempts a value gets one more character
LONGER = 8
#: from this attempt on the symbols of a secret turn into letters
SYMBOLS = 4
#: from this attempt on an IP address becomes one of the IPv6 examples' range
IPV6 = 32


def _shaped(value: str, r: _Stream, hexa: bool = True) -> str:
    """Digits for digits, letters for letters of one script and case; a value
    of hexadecimal digits stays one if ``hexa``."""
    hexa = hexa and re.fullmatch(r"[0-9a-f]{8,}", value) and not value.isdigit()
    return "".join(r.pick("0123456789abcdef") if hexa else _digit(c, r.below(10)) if c.isdigit()
                   else _letter(c, r) if c.isalpha() else c for c in value)


def _digit(c: str, n: int) -> str:
    """The digit ``n`` in the script of the digit ``c``."""
    return chr(ord(c) - int(c) + n) if c.isdecimal() else str(n)


def _luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4)
               for i, d in enumerate(reversed(digits))) % 10


def _number(value: str, r: _Stream, attempt: int) -> str:
    out, kept = [], False
    for c in value + "0" * (attempt // LONGER):
        if c.isdigit() and not kept:  # the issuer's digit stays
            out.append(c)
            kept = True
        else:
            out.append(_digit(c, r.below(10)) if c.isdigit() else c)
    old = [int(c) for c in value if c.isdigit()]
    if _luhn(old) == 0:
        new = [int(c) for c in out if c.isdigit()]
        last = max(i for i, c in enumerate(out) if c.isdigit())
        out[last] = _digit(out[last], (new[-1] - _luhn(new)) % 10)
    return "".join(out)


def _hex_digit(c: str, before: str, r: _Stream) -> str:
    """A digit for one of an IPv6 address; groups start with none but 1 to f."""
    return c if c == ":" else r.pick("123456789abcdef" if before == ":" else "0123456789abcdef")


def _ip(value: str, r: _Stream, attempt: int) -> str:
    if ":" in value and attempt < LONGER:
        new = "".join(_hex_digit(c, before, r) for before, c in zip(":" + value, value))
        return new.upper() if value != value.lower() else new
    if ":" in value or attempt >= IPV6:
        return "2001:db8:" + ":".join(f"{r.below(1 << 16):x}" for _ in range(6))
    low_high = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
    out = []
    for part in value.split("."):
        lo, hi = low_high[len(part)] if attempt < LONGER else (1, 254)
        out.append(str(lo + r.below(hi - lo + 1)))
    return ".".join(out)


def _phone(value: str, r: _Stream, attempt: int) -> str:
    head = _head(value)
    return head + _shaped(value[len(head):] + "0" * (attempt // LONGER), r)


def _secret(value: str, r: _Stream, attempt: int) -> str:
    known = re.match(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-", value)
    head = known[0] if known else ""
    body = value[len(head):]
    kept = [c.isdigit() or c.isalpha() for c in body]
    if attempt >= (SYMBOLS if any(kept) else 1):
        body = "".join(c if k else "x" for c, k in zip(body, kept))
    return head + _shaped(body + "a" * (attempt // LONGER), r)


def _email(value: str, r: _Stream, attempt: int) -> str:
    local, domain = value.rsplit("@", 1)
    host, _, top = domain.rpartition(".")
    extra = "".join(r.pick(_ALPHABETS[0]) for _ in range(attempt // LONGER))
    reserved = re.fullmatch(r"(?i)(.*?\.)?example\.(com|org|net)", domain)
    new = _shaped(reserved[1] or "", r, False) + domain[len(reserved[1] or ""):] if reserved \
        else _shaped(host, r, False) + "." + top
    return f"{_shaped(local, r, False)}{extra}@{new}"


_SYLLABLES = ({0: ("ba be bi bo da de di do fa fe ga go ha he ka ke ko la le li lo ma me mi mo na ne "
                   "ni no pa pe ra re ri ro sa se si so ta te ti to va ve wi zo").split(),
               2: "ба бо ва ве га да ди ка ко ла ле ли ма ми на но па ра ро са со та ти".split(),
               4: "βα βο γα δα δι κα κο λα λε λι μα μι να νο πα ρα ρο σα σο τα τι".split()})
_ENDS = {0: "n r s ll rt nd".split(), 2: "нов рин ков ров".split(), 4: "ς κης δης λος".split()}


#: stems and, by gender, ends of given names
_STEMS = {0: "al bel cor dor el fel gal hel ir jos kal lor mar nor ol pet ros sel tam ur val wil".split(),
          2: "ал бор вал гал дар ел зор ил кир лад мил ник ол рад свет тих".split(),
          4: "αλ βασ γαλ δαμ ελ ζην θαλ καλ λυδ μελ νικ ξεν παν ρομ σελ φιλ".split()}
_GIVEN_ENDS = {0: {"f": "ina ela ia ana isa inda etta ora".split(),
                   "m": "an o in ard us bert win mund".split(), "u": "e is y ori en il".split()},
               2: {"f": "ина ана ея ила ислава".split(), "m": "ий ан ислав имир ей".split(),
                   "u": "я и о е".split()},
               4: {"f": "ινα ια ανη ιδα ονη".split(), "m": "ος ης ων ανος ιππος".split(),
                   "u": "ι ο ε".split()}}
#: given names to choose from at first, listed ones and regular ones
_POOL = {(s, g): [*itertools.chain(*(GIVEN[name, x] for x in ("fm" if g == "u" else g))),
                  *(a + b for a in _STEMS[s] for b in _GIVEN_ENDS[s][g])]
         for s, name in ((0, "latin"), (2, "cyrillic"), (4, "greek")) for g in "fmu"}


def _like(value: str, word: str) -> str:
    """``word`` with the capitals of ``value``."""
    if len(value) > 1 and value.isupper():
        return word.upper()
    word = word.lower()
    return "".join(c.upper() if value[i:i + 1].isupper() else c for i, c in enumerate(word))


def _built(value: str, r: _Stream, attempt: int) -> str:
    s = _script(value[0])
    particle = r.pick(_ALPHABETS[s]) + value[1] if value[1:2] in ("'", "’") else ""
    n = 2 + r.below(2) + attempt // 3
    word = "".join(r.pick(_SYLLABLES[s]) for _ in range(n)) + r.pick(_ENDS[s])
    return _like(value, particle + word)


def _given(value: str, gender: str, r: _Stream, attempt: int) -> str:
    s = _script(value[0])
    more = attempt // 3
    if more:
        name = r.pick(_STEMS[s]) + "".join(r.pick(_SYLLABLES[s]) for _ in range(more)) \
            + r.pick(_GIVEN_ENDS[s][gender])
    else:
        name = r.pick(_POOL[s, gender])
    return _like(value, name)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The replacement that ``value`` proposes at its ``attempt``."""
    r = _Stream(key, kind, value, attempt)
    if kind == "email":
        return _email(value, r, attempt)
    if kind == "ip":
        return _ip(value, r, attempt)
    if kind == "phone":
        return _phone(value, r, attempt)
    if kind == "number":
        return _number(value, r, attempt)
    if kind == "iban":
        return value[:2] + _shaped(value[2:] + "0" * (attempt // LONGER), r)
    if kind == "surname":
        return "".join(p if p in _HYPHENS else _built(p, r, attempt)
                       for p in re.split(f"([{_HYPHENS}])", value))
    if kind.startswith("given_"):
        return _given(value, kind[-1], r, attempt)
    if kind == "secret":
        return _secret(value, r, attempt)
    return _shaped(value + "0" * (attempt // LONGER), r)


# ------------------------------------------------------------------ Spark side

def _candidates(texts: pa.Array):
    """Indexes of the texts that may hold an entity."""
    hit = pc.match_substring_regex(texts.fill_null(""), _MAYBE)
    return pc.indices_nonzero(hit).to_pylist()


def _entities():
    """Arrow kernel: the distinct (type, value) of a batch and how often it has
    them."""
    def run(batches):
        for batch in batches:
            found = Counter()
            for part in slices(batch, 0):
                texts = column(part, 0)
                for i in _candidates(texts):
                    t = texts[i].as_py()
                    found.update((k, t[a:b]) for a, b, k in detect(t))
            if found:
                rows = [(k, v, n) for (k, v), n in sorted(found.items())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(),
                                                                 pa.int64()))],
                    ["kind", "value", "n"])
    return run


def _with_column(schema: str, of):
    """Arrow kernel: ``of(row)`` as one more string column."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in names[:-1]))
            cols = [batch.column(c) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([of(*row) for row in rows], pa.string())], names)
    return run


def _identified(entities: DataFrame) -> DataFrame:
    schema = "kind string, value string, n long, ident string"
    return entities.mapInArrow(_with_column(schema, lambda k, v, n: identity(k, v)), schema)


def _proposals(left: DataFrame, key: bytes) -> DataFrame:
    """What every identity proposes, and the identity of that."""
    schema = "part string, ident string, as_kind string, value string, attempt int, made string"
    return left.select("part", "ident", "as_kind", "value", "attempt").mapInArrow(
        _with_column(schema, lambda p, i, k, v, n: identity(k, surrogate(key, k, v, n))), schema)


def _in_group(*columns: str) -> list:
    """Those columns and the types whose surrogates must differ: all parts of
    names are one."""
    name = F.when(F.col("part").isin("given", "surname"), "name").otherwise(F.col("part"))
    return [name.alias("among"), *columns]


def resolved(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, as_kind, attempt) for every (kind, value, n): the type
    with the gender of the name in the whole corpus, and the attempt whose
    surrogate no other identity has and that is no entity itself."""
    entities = staged(_identified(entities.groupBy("kind", "value").agg(F.sum("n").alias("n")))
                      .withColumn("part", F.substring_index("kind", "_", 1)), "entities")
    votes = lambda g: F.sum(F.when(F.col("kind") == "given_" + g, F.col("n"))
                            .otherwise(0))
    people = staged(
        entities.groupBy("part", "ident").agg(
            F.min("value").alias("value"), F.min("kind").alias("as_kind"),
            votes("f").alias("f"), votes("m").alias("m"))
        .withColumn("as_kind", F.when(F.col("part") != "given", F.col("as_kind"))
                    .when(F.col("f") > F.col("m"), "given_f")
                    .when(F.col("m") > F.col("f"), "given_m").otherwise("given_u"))
        .drop("f", "m"), "identities")
    taken = people.select(*_in_group(F.col("ident").alias("made")))
    left, done = people.withColumn("attempt", F.lit(0)), None
    while True:
        made = staged(_proposals(left, key).select("*", _in_group()[0]), "proposals")
        first = made.groupBy("among", "made").agg(
            F.min(F.struct("part", "ident")).alias("first")).select("among", "made", "first.*")
        free = first.join(taken, ["among", "made"], "left_anti")
        good = staged(made.join(free, ["among", "made", "part", "ident"], "left_semi"),
                      "surrogates")
        done = good if done is None else done.unionByName(good)
        left = made.join(good.select("part", "ident"), ["part", "ident"], "left_anti") \
            .withColumn("attempt", F.col("attempt") + 1)
        if not left.head(1):
            break
        taken = taken.unionByName(good.select("among", "made"))
    return entities.join(done.select("part", "ident", "as_kind", "attempt"), ["part", "ident"]) \
        .select("kind", "value", "as_kind", "attempt")


def surrogate_attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, as_kind, attempt, made) for distinct (kind, value) that
    count as one mention each: distinct surrogates, none of them an entity."""
    schema = "kind string, value string, as_kind string, attempt int, made string"
    got = resolved(entities.select("kind", "value").distinct().withColumn("n", F.lit(1)), key)
    return got.mapInArrow(_with_column(schema, lambda k, v, a, n: surrogate(key, a, v, n)), schema)


_REPLACED = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                      T.StructField("end", T.LongType()),
                                      T.StructField("kind", T.StringType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _rewrite(key: bytes, text: int, attempts_of, own: int | None):
    """Arrow kernel: the text replaced in place, and the spans of the
    surrogates as a last column.  Attempts come from the broadcast or, if
    there is one, from the column ``own`` (which is dropped)."""
    def run(batches):
        later = attempts_of.value if attempts_of is not None else {}
        for batch in batches:
            for part in slices(batch, text):
                texts = column(part, text)
                new, spans = {}, [[] for _ in range(part.num_rows)]
                for i in _candidates(texts):
                    t = texts[i].as_py()
                    if t is None:
                        continue
                    mine = later if own is None else {
                        (x["kind"], x["value"]): (x["as_kind"], x["attempt"])
                        for x in column(part, own)[i].as_py() or ()}
                    out, end, size = [], 0, 0
                    for a, b, kind in detect(t):
                        as_kind, attempt = mine.get((kind, t[a:b]), (kind, 0))
                        s = surrogate(key, as_kind, t[a:b], attempt)
                        out += [t[end:a], s]
                        size += a - end
                        spans[i].append({"start": size, "end": size + len(s), "kind": kind})
                        size, end = size + len(s), b
                    if spans[i]:
                        new[i] = "".join(out) + t[end:]
                cols = list(part.columns)
                if new:
                    where = pa.array([i in new for i in range(part.num_rows)])
                    vals = pa.array([new[i] for i in sorted(new)], texts.type)
                    cols[text] = pc.replace_with_mask(texts, where, vals)
                if own is not None:
                    del cols[own]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, _SPANS)],
                                                 [str(i) for i in range(len(cols) + 1)])
    return run


def pseudonymised(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text",
                  carry: tuple[str, ...] = (), broadcast_rows: int = 200_000):
    """(documents with their text rewritten and a column of the surrogates'
    spans, that column's name): rows keep ``id_col``, ``text_col``, ``carry``."""
    spark = docs.sparkSession
    keep = list(dict.fromkeys([id_col, text_col, *carry]))
    base, text = docs.select(*keep), keep.index(text_col)
    entities = docs.select(text_col).mapInArrow(_entities(), "kind string, value string, n long")
    later = staged(resolved(entities, key).where("attempt > 0 or as_kind <> kind"), "attempts")
    name = fresh_name(keep, "surrogates")
    schema = T.StructType([*base.schema.fields, T.StructField(name, _REPLACED)])
    if later.limit(broadcast_rows + 1).count() <= broadcast_rows:
        sent = spark.sparkContext.broadcast({(r["kind"], r["value"]): (r["as_kind"], r["attempt"])
                                             for r in later.collect()})
        return base.mapInArrow(_rewrite(key, text, sent, None), schema), name
    row, own = fresh_name(keep, "row"), fresh_name(keep, "attempts")
    keyed = base.withColumn(row, F.xxhash64(id_col, text_col))
    per_row = (keyed.select(text_col, row).mapInArrow(
        _entities_by_row(), "kind string, value string, row long")
        .join(later, ["kind", "value"]).groupBy("row")
        .agg(F.collect_set(F.struct("kind", "value", "as_kind", "attempt")).alias(own))
        .withColumnRenamed("row", row))
    joined = keyed.join(per_row, row, "left").select(*keep, own)
    return joined.mapInArrow(_rewrite(key, text, None, len(keep)), schema), name


def _entities_by_row():
    """Arrow kernel over (text, row): the distinct entities of every row."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                texts, rows = column(part, 0), column(part, 1)
                found = [(k, v, rows[i].as_py()) for i in _candidates(texts)
                         for k, v in sorted({(k, texts[i].as_py()[a:b])
                                             for a, b, k in detect(texts[i].as_py())})]
                if found:
                    kinds, values, ids = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kinds), pa.array(values), pa.array(ids, pa.int64())],
                        ["kind", "value", "row"])
    return run


def private_documents(docs: DataFrame, key: bytes, *, id_col: str = "doc_id",
                      text_col: str = "text", length_col: str | None = None, **options):
    """The documents with their text rewritten (and its length in
    ``length_col``), columns as they were."""
    out, _ = pseudonymised(docs, key, id_col=id_col, text_col=text_col,
                           carry=tuple(docs.columns), **options)
    if length_col is not None:
        out = out.withColumn(length_col, F.length(text_col).cast(
            docs.schema[length_col].dataType))
    return out.select(*docs.columns)
