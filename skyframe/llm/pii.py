"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust the score.

Proposals are leftmost and non-overlapping for each kind and are not retried when a validator rejects them, but for IBANs. The
searches run in time linear in the text: an address is looked for only around an ``@``, runs of digits are entered
only at their start."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from skyframe.llm.common import map_batches

SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*")
AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Characters of an IBAN by country (ISO 13616 registry).
IBAN_LENGTH = {country: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for country in names.split()}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
#: Words that make a kind likelier or less likely when they stand within ``NEAR`` code points of a span.
NEAR = 48
CONTEXT = {
    "email": (("mail", "email", "e-mail", "contact", "correo", "courriel"), ("example", "noreply", "no-reply")),
    "ip": (("ip", "address", "host", "server", "adresse"), ("version", "release", "section", "chapter")),
    "card": (("card", "visa", "mastercard", "amex", "credit", "carte", "tarjeta", "karte"), ("order", "tracking", "isbn", "serial")),
    "phone": (("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"), ("version", "id", "range")),
    "iban": (("iban", "account", "bank", "konto", "cuenta", "compte"), ("serial", "model")),
    "ssn": (("ssn", "social", "security"), ("part", "serial", "model")),
}
#: Score of a confirmed span before its context is looked at, by kind.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.75, "iban": 0.95, "ssn": 0.5}
WORDS = {kind: tuple(re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, side)) + r")(?!\w)") for side in sides)
         for kind, sides in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: country and check digits to the end, letters as 10 to 35, remainder 1."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        # the longest run of local characters that ends before this @ and begins after the last match
        start = at
        while start > end and LOCAL_RUN.fullmatch(text, block := max(end, start - 64), start):
            start = block
        if start > end:
            run = LOCAL.search(text, max(end, start - 64), start)
            start = run.start() if run else start
        found = AFTER_AT.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposal may run on into capital words and numbers, so its parts that end before a blank or another sign are tried:
    the one of the country's length first, then the longest; in a country of the registry only that one and the whole run.
    A rejected proposal is searched again after its start."""
    m = IBAN.search(text)
    while m:
        start, last = m.start(), m.end()
        ends = [e for e in range(last, start + 14, -1) if text[e - 1] != " " and not ALNUM.match(text, e)]
        length = IBAN_LENGTH.get(text[start:start + 2])
        parts = [(e, text[start:e].replace(" ", "")) for e in ends]
        if length:
            parts = [x for x in parts if len(x[1]) == length] + parts[:1]
        end = next((e for e, bare in parts if 15 <= len(bare) <= 34 and mod97(bare)), None)
        if end:
            yield start, end
        m = IBAN.search(text, end or start + 1)


ALNUM = re.compile("[A-Za-z0-9]")


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans by kind in the order of ``KINDS``, then by start."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or "0") <= 255 for part in m.groups()):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end()


def scored(text: str) -> list[dict]:
    out = []
    for kind, start, end in proposals(text):
        near = f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}".lower()
        score = PRIOR[kind]
        score += 0.5 * (1 - score) * bool(WORDS[kind][0].search(near)) - 0.3 * score * bool(WORDS[kind][1].search(near))
        out.append({"kind": kind, "start": start, "end": end, "score": round(score, 6)})
    return out


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row: kind, start and end in code points (end exclusive) and a score between 0 and 1,
    by kind as in ``KINDS`` and then by start. Null and empty texts have none; null or repeated ids pass through; no
    rows: no rows. Columns besides ``doc_id`` and ``text`` are not read."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(texts, lambda batch: {"doc_id": batch.column(0), "spans": [scored(t) for t in batch.column(1).to_pylist()]}, SCHEMA)
