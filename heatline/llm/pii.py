"""Personal data: cues found by an Aho-Corasick automaton, expanded to spans by small deterministic parsers.

The automaton runs once over each text and stops at at-signs, digits, plus signs, schemes and identifier cues. At each
cue a parser looks left or right of it, so the cost is linear in the text, and no pattern is searched over it whole.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns; a match that fails its
check (parts of an address over 255, digit count, Luhn sum) is dropped and not tried again further right. Added kinds:
login (user part of a URL with a password), iban (mod-97 checked), account (digits after an account cue) and secret
(the value after a password or token cue).

Null and empty texts give zero counts and empty spans. Repeated rows each give their own row; columns besides the id
and the text are not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "login", "iban", "account", "secret")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"://([^\s/@:]+:[^\s/@]+)@")
_IBAN = re.compile(r"[:\s#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: (?:no|nr|number|nummer|numéro|número)\b)?[.:#\s]{1,4}([0-9][0-9-]{4,18}[0-9])(?![0-9])")
_SECRET = re.compile(r"\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_+/.-]{8,})")

#: Identifier cues in the languages of the texts; each is looked for in lower case, in capitals and with one capital.
_CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "kontonummer", "konto", "compte", "cuenta", "conto", "conta", "rekening"),
    "secret": ("password", "passwd", "passwort", "kennwort", "mot de passe", "contraseña", "senha", "wachtwoord", "token", "secret", "api_key", "apikey", "api-key"),
}


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def automaton():
    """Cue -> what kind of parser it calls for."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("+", ("+", 1))
    found.add_word("://", ("://", 3))
    for d in "0123456789":
        found.add_word(d, ("0", 1))
    for kind, cues in _CUES.items():
        for cue in {c for cue in cues for c in (cue, cue.upper(), cue.capitalize())}:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def spans(text: str, cues) -> list[tuple[int, int, int]]:
    """(start, number of the kind in KINDS, end) of all spans, sorted; code points, end exclusive."""
    found: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = 0
    for last, (cue, n) in cues.iter(text):
        at = last - n + 1
        if cue == "0":
            if at and text[at - 1] in "0123456789" and text[at - 1].isascii():
                continue
            if at >= ip_end and (m := _IP.match(text, at)):
                ip_end = m.end()
                if all(len(p) < 4 and int(p or 0) < 256 for p in (x.lstrip("0") for x in m[0].split("."))):
                    found.append((at, 1, ip_end))
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, card_end))
        elif cue == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append((start, 0, email_end))
        elif cue == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((at, 3, phone_end))
        elif cue == "://":
            if m := _LOGIN.match(text, at):
                found.append((m.start(1), 4, m.end(1)))
        elif cue == "iban":
            if (m := _IBAN.match(text, last + 1)) and _mod97(m[1]):
                found.append((m.start(1), 5, m.end(1)))
        elif cue == "account":
            if m := _ACCOUNT.match(text, last + 1):
                found.append((m.start(1), 6, m.end(1)))
        elif (m := _SECRET.match(text, last + 1)) and any(c.isdigit() for c in m[1]):
            found.append((m.start(1), 7, m.end(1)))
    return sorted(set(found))


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in found])


_OUT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cues = automaton()
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            all_ = spans(text or "", cues)
            base = [x for x in all_ if x[1] < 4]
            kinds = [x[1] for x in base]
            rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_), len(all_) - len(base)))
        cols = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types))], [batch.schema.names[0], *(x.split()[0] for x in _OUT.split(", "))])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans.

    A narrow map over the scan: no shuffle, and memory bounded by one Arrow batch."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_scan, f"`{id_col}` {kind}, {_OUT}")
