"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches of their patterns which
pass their check (parts of an address, Luhn, number of digits); they are always reported.  Added
kinds are reported when their score reaches `threshold`: iban (country's length and mod-97), routing (nine
digits weighted 3, 7, 1, mod 10), sin (nine digits, Luhn), dni (eight digits and their letter, mod 23) and
id_number (three groups of digits).  A score starts at the kind's own, rises if a checksum confirmed it or a
context word of the kind, as a whole word or its plural, stands within `window` characters, and falls next to
words such as "example" or "test".  An iban suffices without context, but not in doubt; the others need it.

All searches are linear in the text: patterns are tried only where an at sign, a plus sign or a run
of digits stands.

Nulls and ties: a null text is an empty one; a null id is kept; repeated rows are scanned as often
as they occur; columns other than id and text are ignored; an empty table gives no rows.  Positions
are code points, ends exclusive.  Very long texts are scanned whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "id_number", "routing", "sin", "dni")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_LOCAL_SET = frozenset(_LOCAL)
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_GROUPED = re.compile(r"[0-9]{3}([ -])[0-9]{3}\1[0-9]{3}(?![0-9A-Za-z-])")
_WORDS = re.compile(r"[^\W_]+")
_ID_NUMBER = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

# A kind's own score, and the words that raise it.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.6, "iban": 0.4, "id_number": 0.3, "routing": 0.2, "sin": 0.2, "dni": 0.2}
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "id_number": ("ssn", "social security", "id number", "national id"),
    "routing": ("routing", "aba", "transit number"),
    "sin": ("sin", "social insurance"),
    "dni": ("dni", "nif", "documento nacional"),
}
#: Kinds that a checksum has confirmed.
_CONFIRMED = frozenset(("card", "iban", "routing", "sin", "dni"))
# Fixed value: the letter of an eight-digit number, by its rest mod 23.
_DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
DOUBT = ("example", "test", "dummy", "sample", "placeholder")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        # the local part is the run before the sign; it always matches if it isn't empty
        if at > end and text[at - 1] in _LOCAL_SET and (m := _DOMAIN.match(text, at + 1)):
            start = end + len(text[end:at].rstrip(_LOCAL))
            end = m.end()
            yield "email", start, end
        at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _numbers(text: str):
    """Kinds that begin with a run of digits (iban: two letters before it)."""
    ip = card = iban = 0
    for run in _DIGITS.finditer(text):
        at = run.start()
        if at >= ip and (m := _IP.match(text, at)):
            ip = m.end()
            if all(map(_small, m.groups())):
                yield "ip", at, ip
        if at >= card and (m := _CARD.match(text, at)):
            card = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", at, card
        if at - 2 >= iban and (n := IBAN_LENGTHS.get(text[at - 2 : at])) and (m := _IBAN.match(text, at - 2)) and not text[at - 3 : at - 2].isalnum():
            kept, length = "", 0
            for c in m[0]:
                if len(kept) == n:
                    break
                kept += c.strip()
                length += 1
            if len(kept) == n and not text[at - 2 + length : at - 1 + length].isalnum() and mod97(kept):
                iban = at - 2 + length
                yield "iban", at - 2, iban
        end = run.end()
        if text[at - 1 : at].isalnum() or text[at - 1 : at] in ("-", "."):
            continue
        if end - at == 3 and (m := _ID_NUMBER.match(text, at)):
            yield "id_number", at, m.end()
        if end - at == 9 and not text[end : end + 1].isalnum():
            if sum(int(c) * w for c, w in zip(run[0], (3, 7, 1) * 3)) % 10 == 0:
                yield "routing", at, end
            if luhn(run[0]):
                yield "sin", at, end
        if end - at == 3 and (m := _GROUPED.match(text, at)) and luhn(m[0][:3] + m[0][4:7] + m[0][8:]):
            yield "sin", at, m.end()
        if end - at == 8 and text[end : end + 1] == _DNI_LETTERS[int(run[0]) % 23] and not text[end + 1 : end + 2].isalnum():
            yield "dni", at, end + 1


def _phones(text: str):
    end = 0
    at = text.find("+")
    while at >= 0:
        if at >= end and (m := _PHONE.match(text, at)):
            end = m.end()
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", at, end
        at = text.find("+", max(at + 1, end))


def score(text: str, kind: str, start: int, end: int, window: int) -> float:
    # whole words, also where the window cuts one off
    left = max(0, start - window)
    while left and text[left - 1].isalnum() and text[left].isalnum() and start - left < 2 * window:
        left -= 1
    right = min(len(text), end + window)
    while right < len(text) and text[right - 1].isalnum() and text[right].isalnum() and right - end < 2 * window:
        right += 1
    around = f" {' '.join(_WORDS.findall(text[left:start].lower()))} | {' '.join(_WORDS.findall(text[end:right].lower()))} "
    value = SCORES[kind] + 0.2 * (kind in _CONFIRMED)
    value += 0.2 * any(f" {w} " in around or f" {w}s " in around for w in CONTEXT[kind])
    value -= 0.2 * any(f" {w} " in around or f" {w}s " in around for w in DOUBT)
    return round(min(1.0, max(0.0, value)), 2)


def spans(text: str | None, threshold: float = 0.5, window: int = 40) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of base spans and of added ones of enough score, by start, then kind."""
    text = text or ""
    order = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}
    found = [(k, a, b, score(text, k, a, b, window)) for f in (_emails, _numbers, _phones) for k, a, b in f(text)]
    return sorted((s for s in found if s[0] in BASE_KINDS or s[3] >= threshold), key=lambda s: (s[1], order[s[0]]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find_pii(documents: DataFrame, threshold: float = 0.5, window: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans, an array of (kind, start, end, score)."""

    def scan(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(t, threshold, window)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return id_and_text(documents, id_col, text_col).mapInArrow(scan, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")


def digest(found: DataFrame, base_kinds: tuple[str, ...] = BASE_KINDS) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*base_kinds))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *map(count, base_kinds), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), scores)
