"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, schemes, digits that continue a number,
and cues such as ``IBAN`` or ``Street``.  At each anchor a small deterministic parser of its kind expands to
the left and right and validates what it got.  Base kinds are email, ip, card (Luhn) and phone; iban
(mod 97), account, login (user and password in a URL) and address (number, name, street word) are added.

Spans are code points, end exclusive.  Within a kind they don't overlap: a parser never looks to the left of its
last match, also of one that failed validation.  Defined results: a null text counts as empty and has no spans; every row is
on its own, repeated ones too; ``masked`` lets all other columns through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quarterlight.llm.common import map_batches, map_rows

KINDS = ("email", "ip", "card", "phone", "iban", "account", "login", "address")
BASE = KINDS[:4]
DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
STREETS = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ -]?(?:[Nn]umber|[Nn]o\.?))?[ :#]{1,3}([0-9]{6,17})(?![0-9A-Za-z])")
_LOGIN = re.compile(r"[^\s/@:]{1,64}:[^\s/@]{1,128}@[A-Za-z0-9.-]{1,253}")
_PLACE = re.compile(r"(?:, [A-Z][a-z]+(?: [A-Z][a-z]+){0,3})?(?:,? [A-Z]{2})?(?: [0-9]{5})?")

Parser = Callable[[str, int, int], tuple[int, int, bool] | None]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def email(text: str, at: int, low: int):
    """``at``: the sign; the local part goes back as far as it may, the domain forward."""
    start = at
    while start > low and text[start - 1] in LOCAL:
        start -= 1
    m = _DOMAIN.match(text, at + 1) if start < at else None
    return m and (start, m.end(), True)


def ip(text: str, dot: int, low: int):
    start = dot
    while start > low and text[start - 1] in DIGITS:
        start -= 1
    m = _IP.match(text, start) if start < dot else None
    return m and (start, m.end(), all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))))


def card(text: str, first: int, low: int):
    m = _CARD.match(text, first)
    digits = m[0].replace(" ", "").replace("-", "") if m else ""
    return m and (first, m.end(), 16 <= len(digits) <= 19 and luhn(digits))


def phone(text: str, plus: int, low: int):
    m = _PHONE.match(text, plus)
    return m and (plus, m.end(), 8 <= sum(c in DIGITS for c in m[0]) <= 15)


def iban(text: str, cue: int, low: int):
    m = _IBAN.match(text, cue + 4)
    if not m:
        return None
    code = m[1].replace(" ", "")
    number = "".join(str(int(c, 36)) for c in code[4:] + code[:4])
    return m.start(1), m.end(1), int(number) % 97 == 1


def account(text: str, cue: int, low: int):
    m = _ACCOUNT.match(text, cue + 7)
    return m and (m.start(1), m.end(1), True)


def login(text: str, colon: int, low: int):
    start = colon
    while start > low and text[start - 1].isascii() and text[start - 1].isalnum():
        start -= 1
    m = _LOGIN.match(text, colon + 3) if start < colon else None
    return m and (start, m.end(), True)


def address(text: str, cue: int, low: int):
    """A house number and one to four capitalised words before the street word; town, state and code after it."""
    words = text[max(low, cue - 80) : cue].split(" ")
    if not words or words[-1] != "":
        return None
    for n in range(2, min(6, len(words))):
        number, names = words[-n - 1], words[-n:-1]
        if not all(w.isalpha() and w[0].isupper() for w in names):
            return None
        if number.isascii() and number.isdigit() and len(number) <= 5:
            start = cue - sum(map(len, names)) - len(names) - len(number) - 1
            end = next(cue + len(s) for s in STREETS if text.startswith(s, cue))
            return start, _PLACE.match(text, end).end(), True
    return None


PARSERS: dict[str, Parser] = {
    "email": email, "ip": ip, "card": card, "phone": phone, "iban": iban, "account": account, "login": login, "address": address,
}


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Each anchor with its kind; the parser starts at the anchor's first character (for ip at its dot)."""
    cues = {"@": "email", "+": "phone", "://": "login", "IBAN": "iban", "account": "account", "Account": "account"}
    cues |= {s: "address" for s in STREETS} | {"." + d: "ip" for d in DIGITS}
    cues |= {a + sep + b: "card" for a in DIGITS for b in DIGITS for sep in ("", " ", "-")}
    automaton = ahocorasick.Automaton()
    for cue, kind in cues.items():
        automaton.add_word(cue, (kind, len(cue)))
    automaton.make_automaton()
    return automaton


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Valid spans by kind, in order."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    seen = dict.fromkeys(KINDS, 0)
    for end, (kind, size) in anchors().iter(text):
        at = end - size + 1
        if at < seen[kind]:
            continue
        got = PARSERS[kind](text, at, seen[kind])
        if got:
            seen[kind] = got[1]
            if got[2]:
                found[kind].append(got[:2])
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of their spans, all spans as text, number of added spans."""

    def run(rows):
        for doc_id, text in rows:
            found = spans(text or "")
            listed = {k: [f"{k}:{a}:{b}" for a, b in found[k]] for k in KINDS}
            base = ",".join(x for k in BASE for x in listed[k])
            every = ",".join(x for k in KINDS for x in listed[k])
            counts = [len(found[k]) for k in BASE]
            yield doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), every, sum(len(found[k]) for k in KINDS[4:])

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return map_rows(docs.select("doc_id", "text"), run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in square brackets; all columns come through."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        cuts = sorted((a, -b, k) for k, found in spans(text).items() for a, b in found)
        out, at = [], 0
        for a, b, kind in cuts:
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, -b)
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            kind = batch.schema.field(k)
            yield batch.set_column(k, kind, pa.array([clean(t) for t in batch.column(k).to_pylist()], kind.type))

    return map_batches(docs, run, docs.schema)
