"""Replaces personal data by keyed surrogates of the same type and format.

Found: e-mail addresses, phone numbers (with a calling code, in groups of three and four,
or national ones with a leading 0), card, bank account (IBAN) and social security
numbers, IPv4 and IPv6 addresses, access keys and tokens by prefix, private key blocks,
passwords after that word, and personal names by title, by a listed given name, or by
what stands before them ("my name is", "Name:"); later in a text the family name alone
is the same person. Card and account numbers count by their check digits. An entity's canonical
form (digits of a number, lower case of an address) is replaced as follows, so that
one entity has one surrogate everywhere and two never share one:

* runs of digits and letters go through a keyed permutation of all runs of their
  length and alphabet (a Feistel network with HMAC rounds, walked until the value
  is valid again), and the characters are put back in the original's layout: case,
  punctuation, spaces and groups stay;
* hosts keep their last label (and ``example`` before it), the others are permuted;
* secrets of more than 40 characters go through a keyed stream instead;
* names go through a keyed permutation of the list of given names of their gender
  and script, other words of a name through one of all letter runs of their script
  and layout: accents stay where they are, as do hyphens, apostrophes, ς and ß;

A permutation keeps distinct entities distinct and changes each. ``checked`` verifies
on the whole corpus that an entity has one surrogate and a surrogate one entity, and
repairs what is not so. A surrogate may by chance be
another entity of the corpus; ``collisions`` lists these.
"""

from __future__ import annotations

import functools
import hmac
import ipaddress
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.util import fresh, release_memory, stage

KEY = b"panelcast-surrogates-1"
ROUNDS = 6
#: Turns in which entities that share a surrogate draw again.
TURNS = 20
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
UPPER_DIGITS = UPPER + DIGITS
#: Given names by gender and script, for detection and as surrogates.
NAMES = {
    ("f", "latin"): "Anna Emma Laura Maria Julia Sarah Elena Sofia Clara Helen Alice Nina Marie Camille Ingrid Petra".split(),
    ("m", "latin"): "Peter John David Paul Thomas Martin Daniel Simon Lukas Carlos Pierre Jean Miguel Stefan Oliver Robert".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Γεωργία Δήμητρα Ιωάννα".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Κώστας Γιάννης Νίκος Παναγιώτης Βασίλης Χρήστος".split(),
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Mme", "Frau", "Sra", "Señora", "Madame"], "m": ["Mr", "Sir", "Herr", "Sr", "Señor", "Monsieur"], "": ["Dr", "Prof"]}
_OF = {n: k for k, v in NAMES.items() for n in v}
#: Letters that change among themselves; those of other letters follow from their code block.
_ALPHABETS = (LOWER, "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψω", "άέήίόύώϊϋ")
#: Calling codes: North America, Russia, those of two digits, and all others of three.
_COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")
#: A number of so many digits without a calling code has this one.
NATIONAL, HOME = 10, "1"
_LISTED = {n.lower(): n for n in _OF}
_FAMILY = r"(?:\p{Lu}(?:[-'’]?(?!(?<=['’])s\b)[\p{L}\p{M}])+)"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_GIVEN = "|".join(sorted(_OF, key=len, reverse=True))
#: Capitalised words and initials before them; a title before another name is not one of them.
_WORD = rf"(?:(?P<name>\p{{Lu}})\.? )*(?!(?:{_TITLE})\.? \p{{Lu}})(?P<name>{_FAMILY})"
_PATTERN = regex.compile(
    r"(?P<key_block>(?<=-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s{0,4})[A-Za-z0-9+/][A-Za-z0-9+/=\s]{14,}[A-Za-z0-9+/=])"
    r"|(?P<token>(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9]))"
    r"|(?P<password>(?<=\b[Pp]ass(?:word|wd)(?:: ?|=))(?=\S*[A-Za-z])(?=\S*[0-9])[^\s,;\"'<>]{6,})"
    r"|(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24})"
    r"|(?P<access_key>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?|[A-Z0-9]{11,30})(?![A-Za-z0-9]))"
    r"|(?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]))"
    r"|(?P<ip>(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?!\.?[0-9]))"
    r"|(?P<card>(?<![0-9-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9-]))"
    r"|(?P<card15>(?<![0-9-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9-]))"
    r"|(?P<phone>(?<![\w.])0[1-9][0-9]{1,4}[ /-][0-9]{5,9}(?!\w)|(?<![\w.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w.])\+[0-9][0-9 ]{7,16}[0-9](?!\w))"
    rf"|(?P<person>\b(?:(?:(?:{_TITLE})\.? )+|(?P<name>{_GIVEN}) ){_WORD}(?: {_WORD})*\b)"
    rf"|(?<=\b[Mm]y name is )(?P<person>{_WORD}(?: {_WORD})*\b)|(?<=\b[Nn]ame: )(?P<person>{_WORD}(?: {_WORD})+\b)"
)
#: Each entity holds one of these pieces wherever it stands, so a text without them holds nothing.
_SIGNS = re.compile(r"[@0-9]|A[KS]IA|::|PRIVATE KEY|gh[pousr]_|github_pat|glpat-|sk-|xox|AIza")
#: Kinds in the order in which a match is looked up, and what a match must be to count.
_KINDS = ("key_block", "token", "password", "email", "access_key", "ssn", "iban", "ip6", "ip", "card", "card15", "phone", "person")
_SECRETS, STREAM = ("key_block", "token", "password"), 40
_PREFIX = re.compile(r"gh[pousr]_|github_pat_|glpat-|sk-|xox[abprs]-|AIza|")
_HEADS = re.compile("[Mm]y name is |[Nn]ame: |" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in ws if w[0] == c)})" for ws in [[t + r"\.? " for t in _TITLE.split("|")] + [g + " " for g in _OF]] for c in sorted({w[0] for w in ws})))


def _round(key: bytes, tag: str, i: int, value: int) -> int:
    return int.from_bytes(hmac.digest(key, f"{tag}|{i}|{value}".encode(), "sha256")[:16], "big")


def permute(value: int, size: int, tag: str, key: bytes = KEY, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a Feistel network on the next square, walked back into the range."""
    if size < 2:
        return value
    side = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, side)
        for i in range(ROUNDS):
            if back:
                a, b = (b - _round(key, tag, ROUNDS - 1 - i, a)) % side, a
            else:
                a, b = b, (a + _round(key, tag, i, b)) % side
        value = a * side + b
        if value < size:
            return value


def others(value: int, size: int, tag: str, key: bytes = KEY) -> Iterator[int]:
    """All other values of range(size) in the keyed order after ``value``, then ``value``: the first is a permutation without fixed points."""
    at = permute(value, size, tag, key)
    for i in range(1, size + 1):
        yield permute((at + i) % size, size, tag, key, back=True)


def _number(s: str, alphabet: str) -> int:
    v = 0
    for c in s:
        v = v * len(alphabet) + alphabet.index(c)
    return v


def _string(v: int, n: int, alphabet: str) -> str:
    out = []
    for _ in range(n):
        v, r = divmod(v, len(alphabet))
        out.append(alphabet[r])
    return "".join(reversed(out))


def permute_run(s: str, alphabet: str, tag: str, key: bytes = KEY, ok=lambda s: True) -> str:
    """The next run of the same length over ``alphabet`` that is ``ok``, as ``s`` must be; ``s`` itself only if no other is."""
    runs = others(_number(s, alphabet), len(alphabet) ** len(s), f"{tag}|{len(s)}", key)
    return next(r for r in (_string(v, len(s), alphabet) for v in runs) if ok(r))


def _luhn(s: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def _fill(layout: str, chars: str, slots) -> str:
    it = iter(chars)
    return "".join(next(it) if slots(c) else c for c in layout)


@functools.cache
def _alphabet(c: str) -> str:
    """The letters that may stand for a lower-case or caseless letter; none for signs, marks, ς, ß and the like, which stay."""
    own = next((a for a in _ALPHABETS if c in a), None)
    if own:
        return own
    at = ord(c) & ~127
    script = lambda x: unicodedata.name(x, "").split(" ")[0]
    fits = lambda x: x.isalpha() and script(x) == script(c) and x.islower() == c.islower() and (x.upper().lower() == x != x.upper() if x.islower() else x.upper() == x == x.lower())
    own = "".join(x for x in map(chr, range(at, at + 128)) if fits(x) and not any(x in a for a in _ALPHABETS))
    return own if c in own else ""


def _lower(s: str) -> list[str]:
    """Lower case letter by letter; capitals without a lower-case letter of their own stay."""
    return [c.lower() if c.lower().upper() == c else c for c in s]


def _runs(low: list[str], alphabets: list[str], tag: str, key: bytes) -> list[str]:
    """The letters of each alphabet permuted as one run; signs stay in place.

    A run's tag holds the shape and the runs before it, so equal runs in different
    words part ways, and different words stay different.
    """
    out, before = list(low), tag + "|" + "".join(a[:1] or c for c, a in zip(low, alphabets, strict=True))
    for alphabet in sorted(set(alphabets) - {""}):
        slots = [i for i, a in enumerate(alphabets) if a == alphabet]
        run = "".join(low[i] for i in slots)
        for i, c in zip(slots, permute_run(run, alphabet, before, key), strict=True):
            out[i] = c
        before += "|" + run
    return out


def _cased(new: str | list[str], own: str) -> str:
    return "".join(c.upper() if i < len(own) and own[i].isupper() else c for i, c in enumerate(new))


def _email(s: str, key: bytes) -> str:
    local, host = s.rsplit("@", 1)
    low = _lower(local)
    local = _cased(_runs(low, [DIGITS if c in DIGITS else _alphabet(c) for c in low], "email", key), local)
    stays = re.search(r"((?:^|\.)example)?\.[A-Za-z]+$", host, re.I)[0]
    low = _lower(host[: len(host) - len(stays)])
    new = _runs(low, [DIGITS if c in DIGITS else LOWER if c in LOWER else "" for c in low], f"host|{stays.lower()}", key)
    return f"{local}@{_cased(new, host[: len(host) - len(stays)])}{stays}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(s: str, key: bytes) -> str:
    """Another account of the same country and form, with its check digits."""
    own = s.replace(" ", "")
    low = own[4:].lower()
    body = "".join(_runs(list(low), [DIGITS if c in DIGITS else LOWER for c in low], f"iban|{own[:2]}", key)).upper()
    check = 98 - _mod97(own[:2] + "00" + body)
    return _fill(s, f"{own[:2]}{check:02d}{body}", str.isalnum)


def _secret(s: str, tag: str, key: bytes) -> str:
    """Letters for letters and digits for digits; a known prefix and signs stay."""
    head = _PREFIX.match(s)[0] if tag == "token" else ""
    body = s[len(head) :]
    if sum(c.isalnum() for c in body) <= STREAM:
        low = _lower(body)
        return head + _cased(_runs(low, [DIGITS if c in DIGITS else _alphabet(c) for c in low], f"{tag}|{head}", key), body)
    seed, out, pool = hmac.digest(key, f"{tag}|{body}".encode(), "sha256"), [], b""
    for i, c in enumerate(body):
        if i % 32 == 0:
            pool = hmac.digest(seed, str(i).encode(), "sha256")
        a = DIGITS if c in DIGITS else UPPER if c in UPPER else LOWER if c in LOWER else c
        out.append(a[pool[i % 32] % len(a)])
    return head + "".join(out)


def surrogate(kind: str, s: str, key: bytes = KEY) -> str:
    """The surrogate of one entity; person names come in parts, ``given`` and ``family``."""
    if kind == "email":
        return _email(s, key)
    if kind == "access_key":
        return s[:4] + permute_run(s[4:], UPPER_DIGITS, f"key|{s[:4]}", key)
    if kind in _SECRETS:
        return _secret(s, kind, key)
    if kind == "iban":
        return _iban(s, key)
    if kind == "ip6":
        v = next(others(int(ipaddress.IPv6Address(s)), 1 << 128, "ip6", key))
        return str(ipaddress.IPv6Address(v)) if "::" in s else ipaddress.IPv6Address(v).exploded
    digits = "".join(c for c in s if c.isdigit())
    if kind == "ssn":
        fine = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        return _fill(s, permute_run(digits, DIGITS, "ssn", key, fine if fine(digits) else lambda d: not fine(d)), str.isdigit)
    if kind == "card":
        good, head = _luhn(digits), digits[: 2 if len(digits) == 15 else 1]
        return _fill(s, head + permute_run(digits[len(head) :], DIGITS, f"card|{head}", key, lambda d: _luhn(head + d) == good), str.isdigit)
    if kind == "ip":
        v = 0
        for part in s.split("."):
            v = v * 256 + int(part)
        v = next(others(v, 1 << 32, "ip", key))
        return ".".join(str(v >> b & 255) for b in (24, 16, 8, 0))
    if kind == "phone":
        # country codes are free of prefixes, so permutations of different tags do not overlap
        plus, code = s[0] == "+", ""
        if plus and len(digits) >= 7:
            code = _COUNTRY.match(digits)[0]
        elif len(digits) == NATIONAL:
            plus, digits = True, HOME + digits
            code = HOME
        new = code + permute_run(digits[len(code) :], DIGITS, f"phone|{plus}|{code}", key)
        return _fill(s, new if s[0] == "+" or not code else new[len(HOME) :], str.isdigit)
    if kind == "given":
        own = _LISTED[s.lower()]
        names = NAMES[_OF[own]]
        new = names[next(others(names.index(own), len(names), f"given|{_OF[own]}", key))]
        return new if s == own else new.upper()
    low = _lower(s)
    alphabets = [_alphabet(c) for c in low]
    new = _runs(low, alphabets, "family", key)
    while "".join(new) in _LISTED:  # these stand for given names
        new = _runs(new, alphabets, "family", key)
    if new == low:  # no letter that could change
        new = list(_string(int.from_bytes(hmac.digest(key, f"family|{s}".encode(), "sha256"), "big"), max(len(low), 12), LOWER))
    return _cased(new, s)


def _name_part(word: str) -> str:
    """Listed names, as listed or in capitals, change among themselves."""
    return "given" if _LISTED.get(word.lower()) in (word, word.title()) and word in (word.title(), word.upper()) else "family"


def find(text: str) -> Iterator[tuple[str, int, int, list[tuple[str, int, int]]]]:
    """(kind, start, end, parts) of every entity; parts are the pieces to replace."""
    if not _SIGNS.search(text) and not _HEADS.search(text):
        return
    found, families = [], set()
    for m in _PATTERN.finditer(text):
        kind = next(k for k in _KINDS if m[k] is not None)
        if kind == "person":
            parts = [(_name_part(text[a:b]), a, b) for a, b in sorted(m.spans("name"))]
            families |= {text[a:b] for k, a, b in parts[-1:] if k == "family" and b - a > 2}
            found.append((kind, m.start(), m.end(), parts))
        elif _counts(kind, m[0]):
            kind = "card" if kind == "card15" else kind
            found.append((kind, m.start(), m.end(), [(kind, m.start(), m.end())]))
    if families:  # a family name alone is the person named before
        spans = [(s, e) for _, s, e, _ in found]
        first = min(s for k, s, *_ in found if k == "person")
        for m in regex.finditer(rf"(?<![\p{{L}}\p{{M}}'’-])(?:{'|'.join(map(re.escape, sorted(families)))})(?![\p{{L}}\p{{M}}-])", text, pos=first):
            if not any(s < m.end() and m.start() < e for s, e in spans):
                found.append(("person", m.start(), m.end(), [("family", m.start(), m.end())]))
        found.sort(key=lambda f: f[1])
    yield from found


def _counts(kind: str, s: str) -> bool:
    """Whether what looks like an entity is one: its check digits are right, or it parses."""
    if kind == "iban":
        own = s.replace(" ", "")
        return 15 <= len(own) <= 34 and _mod97(own) == 1
    if kind == "card15":
        return _luhn("".join(c for c in s if c.isdigit()))
    if kind == "ip6":
        try:
            return int(ipaddress.IPv6Address(s)) > 1
        except ValueError:
            return False
    return True


def _part(kind: str, own: str, key: bytes, cache: dict) -> str:
    if (kind, own) not in cache:
        if len(cache) > 100_000:
            cache.clear()
        cache[kind, own] = surrogate(kind, own, key)
    return cache[kind, own]


def replace(text: str, key: bytes, cache: dict, repairs: dict | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates and (kind, canonical entity, canonical surrogate) of each entity.

    ``repairs``: canonical surrogates by (kind, canonical entity) that go before the entity's own.
    """
    out, at, found = [], 0, []
    for kind, s, e, parts in find(text):
        own = [text[a:b] for _, a, b in parts]
        entity = canonical(kind, " ".join(own))
        fixed = (repairs or {}).get((kind, entity))
        new = [_part(k, o, key, cache) for (k, *_), o in zip(parts, own, strict=True)] if fixed is None else laid_out(kind, own, fixed)
        p = s
        for (_, a, b), n in zip(parts, new, strict=True):
            out += [text[at:p], text[p:a], n]
            at = p = b
        out.append(text[p:e])
        at = e
        found.append((kind, entity, canonical(kind, " ".join(new))))
    out.append(text[at:])
    return "".join(out), found


def laid_out(kind: str, own: list[str], fixed: str) -> list[str]:
    """A canonical surrogate in the layout of a mention's parts."""
    if kind == "person":
        return fixed.split(" ")
    if kind in ("phone", "card", "ssn"):
        digits = "".join(c for c in fixed if c.isdigit())
        return [_fill(own[0], digits[len(digits) - sum(map(str.isdigit, own[0])) :], str.isdigit)]
    if kind == "iban":
        return [_fill(own[0], fixed, str.isalnum)]
    if kind == "email":
        local, host = fixed.rsplit("@", 1)
        return ["".join(c.upper() if o.isupper() else c for c, o in zip(local, own[0], strict=False)) + "@" + host]
    return [fixed]


def canonical(kind: str, s: str) -> str:
    """What makes two mentions one entity; of a person, the words of the name without titles."""
    if kind in ("phone", "card", "ssn"):
        digits = "".join(c for c in s if c.isdigit())
        home = kind == "phone" and s[0] != "+" and len(digits) == NATIONAL
        return f"+{HOME}{digits}" if home else ("+" if s[0] == "+" else "") + digits
    if kind == "ip":
        return ".".join(str(int(x)) for x in s.split("."))
    if kind == "ip6":
        return ipaddress.IPv6Address(s).exploded
    if kind == "iban":
        return s.replace(" ", "")
    return s.lower() if kind == "email" else s


_ENTITIES = "array<struct<kind:string,entity:string,surrogate:string>>"


def _run(key: bytes):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))

    def part(col: pa.Array, repairs: pa.Array | None, cache: dict) -> pa.StructArray:
        texts, kinds = [], []
        for t, r in zip(col.to_pylist(), [None] * len(col) if repairs is None else repairs.to_pylist(), strict=True):
            fixed = {(x["kind"], x["entity"]): x["surrogate"] for x in r or []}
            new, found = (None, []) if t is None else replace(t, key, cache, fixed)
            texts.append(new)
            kinds.append([{"kind": k, "entity": e, "surrogate": s} for k, e, s in found])
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(kinds, kind)], ["text", "entities"])

    def run(col: pa.Array, repairs: pa.Array | None = None) -> pa.Array:
        cache: dict = {}
        out = pa.concat_arrays([part(col.slice(i, 500), None if repairs is None else repairs.slice(i, 500), cache) for i in range(0, max(len(col), 1), 500)])
        release_memory()
        return out

    return run


def pseudonymise(text: Column, key: bytes = KEY, repairs: Column | None = None) -> Column:
    """struct(text, entities) of a whole text; a null text stays null and has no entities."""
    run = _run(key)
    kind = f"struct<text:string,entities:{_ENTITIES}>"

    @F.arrow_udf(kind)
    def apply(col: pa.Array) -> pa.Array:
        return run(col)

    @F.arrow_udf(kind)
    def repaired(col: pa.Array, fixed: pa.Array) -> pa.Array:
        return run(col, fixed)

    return apply(text) if repairs is None else repaired(text, repairs)


def _again(kind: str, entity: str, key: bytes, turn: int) -> str:
    """Another canonical surrogate of a canonical entity, by a key of this turn."""
    k = hmac.digest(key, f"repair|{turn}".encode(), "sha256")
    if kind == "person":
        return " ".join(surrogate(_name_part(w), w, k) for w in entity.split(" "))
    return canonical(kind, surrogate(kind, entity, k))


def _drawn(key: bytes, turn: int):
    """``_again`` over columns."""

    @F.arrow_udf("string")
    def again(kind: pa.Array, entity: pa.Array) -> pa.Array:
        return pa.array([_again(k, e, key, turn) for k, e in zip(kind.to_pylist(), entity.to_pylist(), strict=True)], pa.string())

    return again


def conflicts(e: DataFrame) -> DataFrame:
    """Of distinct (kind, entity, surrogate): entities of several surrogates and surrogates of several entities, (kind, what, value, n)."""
    of = lambda c: e.groupBy("kind", F.col(c).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select("kind", F.lit(c).alias("what"), "value", "n")
    return of("entity").unionByName(of("surrogate"))


def repairs(e: DataFrame, key: bytes = KEY) -> DataFrame | None:
    """(kind, entity, surrogate) of the entities whose surrogate must change, None if there is no conflict.

    An entity of several surrogates gets the smallest of them. Of the entities that
    share a surrogate the smallest keeps it, the others draw again by other keys until
    theirs is free; an error is raised if some find none in TURNS turns.
    """
    if not conflicts(e).limit(1).count():
        return None
    m = e.groupBy("kind", "entity").agg(F.min("surrogate").alias("surrogate"), F.count("*").alias("n")).withColumn("turn", F.lit(0))
    for turn in range(1, TURNS + 1):
        keeps = m.groupBy("kind", "surrogate").agg(F.min(F.struct("turn", "entity"))["entity"].alias("keeper"))
        m = stage(m.join(keeps, ["kind", "surrogate"]), "mapping")
        lost = F.col("entity") != F.col("keeper")
        if not m.where(lost).limit(1).count():
            return m.where("n > 1 OR turn > 0").select("kind", "entity", "surrogate")

        kept = m.where(~lost).select("kind", "entity", "surrogate", "n", "turn")
        m = kept.unionByName(m.where(lost).select("kind", "entity", _drawn(key, turn)("kind", "entity").alias("surrogate"), "n", F.lit(turn).alias("turn")))
    raise RuntimeError(f"entities without a surrogate of their own after {TURNS} turns")


def checked(docs: DataFrame, text_col: str = "text", key: bytes = KEY, entities_col: str = "pii_entities") -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced, and ``entities_col``, which ``docs`` must not have.

    All distinct (kind, entity, surrogate) are checked in both directions; texts that
    hold an entity of ``repairs`` are replaced again by these. Null texts stay null and
    hold no entity; repeated rows come out alike; an empty table gives no rows.
    """
    text, names = F.col(text_col).cast("string"), [*docs.columns, entities_col]
    got, text_key, fixed = (fresh(c, names) for c in ("_pii", "_pii_key", "_pii_repairs"))
    new = lambda df, p: df.withColumn(got, p).withColumns({text_col: F.col(got)["text"], entities_col: F.col(got)["entities"]}).drop(got)
    keyed = docs.withColumn(text_key, F.sha2(text, 256))
    d = stage(new(keyed, pseudonymise(text, key)), "surrogates")
    mentions = d.select(F.col(text_key).alias("at"), F.explode(entities_col).alias("e")).select("at", "e.*")
    fixes = repairs(stage(mentions.drop("at").distinct(), "entities"), key)
    if fixes is None:
        return d.drop(text_key)
    hit = mentions.select(F.col("at").alias(text_key), "kind", "entity").distinct().join(fixes, ["kind", "entity"])
    hit = stage(hit.groupBy(text_key).agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias(fixed)), "repairs")
    d = new(keyed.join(hit, text_key, "left"), pseudonymise(text, key, F.col(fixed)))
    return d.select(*docs.columns, entities_col)


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """(id, text, n_entities, kinds): every row with its text's entities replaced and counts by kind ("email:2,ip:1").

    Texts without entities come back unchanged; null texts stay null; repeated rows
    get equal texts; an empty table gives no rows; other columns are ignored.
    """
    d = checked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", key)
    kinds = F.transform("pii_entities", lambda e: e["kind"])
    counts = F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.concat(k, F.lit(":"), F.size(F.filter(kinds, lambda x: x == k)).cast("string")))
    return d.select(F.col("id").alias(id_col), "text", F.size("pii_entities").alias("n_entities"), F.array_join(counts, ",").alias("kinds"))


def collisions(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """What ``checked`` repairs, and surrogates that are another entity of the corpus (n = 0), which it leaves: (kind, what, value, n)."""
    e = docs.select(F.explode(pseudonymise(F.col(text_col).cast("string"), key)["entities"]).alias("e")).select("e.*").distinct()
    real = e.select("kind", F.col("entity").alias("surrogate")).distinct()
    met = e.select("kind", "surrogate").distinct().join(real, ["kind", "surrogate"], "left_semi")
    return conflicts(e).unionByName(met.select("kind", F.lit("surrogate").alias("what"), F.col("surrogate").alias("value"), F.lit(0).cast("long").alias("n")))
