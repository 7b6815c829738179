"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order of reports, and what they are made of.
ORDER = ("email", "ip", "card", "phone", "iban")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Each of these starts at the start of a run of digits wherever it matches at all, so the
# lookbehind changes no match and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Lengths of account numbers by country; an end that gives this length is tried first.
_IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
        "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
        "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_DIGIT = re.compile("[0-9]")
#: Score of a confirmed span without context, and what a context word nearby adds.
BASE_SCORE = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9}
BONUS = 0.2
#: Characters before a span that are searched for context words.
WINDOW = 40
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Non-overlapping account numbers: at each start a run of words, of 15 to 34 characters without spaces, that passes
    mod-97: the one of the country's length, else the longest."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        ends = [m.end(), *(i for i in range(m.end() - 1, m.start(), -1) if text[i] == " ")]
        runs = [(end, text[m.start() : end].replace(" ", "")) for end in ends]
        for end, value in sorted(runs, key=lambda x: len(x[1]) != _IBAN_LENGTH.get(x[1][:2])):
            if len(value) >= 15 and mod97(value):
                yield m.start(), end
                at = end
                break


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each @ outwards in linear time."""
    low = 0
    at = text.find("@")
    while at >= 0:
        local = text[low:at]
        start = at - (len(local) - len(local.rstrip(_LOCAL)))
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        at = text.find("@", low)


def find(text: str) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, kind, score) of a text, by start, then kind; code points, end exclusive.

    An empty text has none. Kinds may overlap each other; within a kind spans never do.
    """
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for kind, pattern, least, most, check in (("card", _CARD, 14, 19, luhn), ("phone", _PHONE, 10, 15, None)):
            for m in pattern.finditer(text):
                digits = re.sub("[^0-9]", "", m[0])
                if least <= len(digits) <= most and (check is None or check(digits)):
                    out.append((m.start(), m.end(), kind))
        out += [(s, e, "iban") for s, e in ibans(text)]
    return [(s, e, k, score(text, s, k)) for s, e, k in sorted(out, key=lambda x: (x[0], ORDER.index(x[2])))]


def score(text: str, start: int, kind: str) -> float:
    before = re.findall(r"\w+", text[max(0, start - WINDOW) : start].lower())
    near = any(w.startswith(c) if len(c) > 2 else w == c for w in before for c in CONTEXT[kind])
    return min(1.0, BASE_SCORE[kind] + BONUS * near)


def redacted(text: str, found: list[tuple[int, int, str, float]], least: float = 0.0) -> str:
    """The text with each span of at least the score replaced by its kind in angle brackets."""
    out, at = [], 0
    for s, e, k, v in found:
        if s >= at and v >= least:
            out += [text[at:s], f"<{k}>"]
            at = e
    return "".join([*out, text[at:]])


SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """Rows (doc_id, spans), and redacted text if asked for; one for each row of ``docs``.

    Works row by row without a shuffle, so ids may repeat or be null. A null text counts as empty.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            found = [find(t) for t in texts]
            spans = pa.array([[{"start": s, "end": e, "kind": k, "score": v} for s, e, k, v in f] for f in found], kind)
            more = [pa.array([redacted(t, f) for t, f in zip(texts, found, strict=True)], pa.string())] * redact
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, *more], names=["doc_id", "spans", *["redacted"] * redact])

    schema = f"doc_id long, spans {SPANS}" + ", redacted string" * redact
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
