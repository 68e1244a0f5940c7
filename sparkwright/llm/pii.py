"""Personal data: expressions propose spans, validators confirm them, words nearby adjust a score.

Base kinds (email, ip, card, phone) stand whatever their score; iban and national_id are further kinds, reported only when
their validator confirms them and, for national_id, when a context word stands nearby.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.text import give_back

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id")
#: Base score, and what a validator and a context word add.
SCORE = {"email": 0.8, "ip": 0.5, "card": 0.3, "phone": 0.4, "iban": 0.3, "national_id": 0.1}
CHECKED = {"card": 0.4, "iban": 0.5, "ip": 0.1, "phone": 0.1, "national_id": 0.2}
CONTEXT, NEAR, REPORT = 0.2, 48, 0.5
#: Words that make a kind likelier in the NEAR characters before and after a span.
WORDS = {
    "email": r"mail|contact|address|write",
    "ip": r"\bip\b|host|server|login|address",
    "card": r"card|visa|master|credit|debit|payment|amex",
    "phone": r"phone|tel|call|mobile|fax|cell",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "national_id": r"\bssn\b|social security|national id",
}
_NEAR = {kind: re.compile(words, re.I) for kind, words in WORDS.items()}

#: Characters of an IBAN by country, of ISO 13616's registry.
IBAN_LENGTHS = dict(
    pair.split(":") for pair in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 "
        "GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 "
        "MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 "
        "SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20"
    ).split()
)
#: By length: groups of four, each after at most one space, that no letter or digit follows.
_IBAN_OF = {n: re.compile(rf"[A-Z0-9]{{4}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"(?![A-Za-z0-9])") for n in map(int, IBAN_LENGTHS.values())}

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The checksum of payment cards: every second digit from the right doubled, digits summed, a multiple of ten."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters to the end, letters as 10 to 35, remainder 1 of 97."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def small(part: str) -> bool:
    """Whether a run of digits is at most 255, whatever zeros it begins with."""
    digits = part.lstrip("0") or "0"
    return len(digits) <= 3 and int(digits) <= 255


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost candidates of their own country's length, so what stands behind them is no part of them."""
    at = 0
    while begin := _IBAN.search(text, at):
        length = IBAN_LENGTHS.get(begin[0][:2])
        found = _IBAN_OF[int(length)].match(text, begin.start()) if length else None
        if found and mod97(found[0].replace(" ", "")):
            yield found.span()
            at = found.end()
        else:
            at = begin.start() + 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: an at sign decides its own match, so only the text around it is read."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, confirmed by its validator)."""
    for start, end in _emails(text):
        yield "email", start, end, True
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), all(map(small, m.groups()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield "card", m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 9 <= sum(c.isdigit() for c in m[0]) <= 15
    for start, end in _ibans(text):
        yield "iban", start, end, True
    for m in _NATIONAL.finditer(text):
        area, group, serial = m[0].split("-")
        yield "national_id", m.start(), m.end(), area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def find(text: str) -> list[Span]:
    """All spans of a text in the order of KINDS, then of start; positions count characters, ends are exclusive."""
    out = []
    for kind, start, end, ok in _proposed(text):
        if not ok:
            continue
        near = _NEAR[kind].search(text[max(0, start - NEAR) : start]) or _NEAR[kind].search(text[end : end + NEAR])
        score = min(1.0, SCORE[kind] + CHECKED.get(kind, 0) + (CONTEXT if near else 0))
        if kind in BASE or score >= REPORT:
            out.append(Span(kind, start, end, round(score, 3)))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first covers them all."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_column(text: F.Column | str) -> F.Column:
    """The spans of a text column as an array of structs; null counts as empty."""

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            yield pa.array([[vars(s) for s in find(t or "")] for t in batch.to_pylist()], type=kind)

    return spans(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row.

    Nulls and empty texts have no spans; repeated rows and null ids stay rows of their own; an empty table gives no rows. Texts
    of any length are read whole, in time that grows with the length. Spans of different kinds may overlap or be equal; all
    are reported, in order of kind and start. Other columns, whatever their names, are left alone.
    """
    return docs.select(F.col(id_col).alias("doc_id"), spans_column(text_col).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind, and its length where there is a column for it.

    A null text stays null and an empty one empty; its length stays as given where the text is null. Repeated rows are cleaned
    each for itself, an empty table gives none, and texts of any length are read whole. Where spans overlap, the first, of two
    that begin together the longer, names what is taken out. Other columns, whatever their names, are kept.
    """

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for batch in batches:
            yield pa.array([t if t is None else redacted(t, find(t)) for t in batch.to_pylist()], pa.string())

    done = docs.select(*(clean(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns))
    return done.select(*(F.coalesce(F.length(text_col).cast(kind), F.col(c)).alias(c) if c == length_col else F.col(c) for c, kind in docs.dtypes))
