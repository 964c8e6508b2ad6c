"""Personal data in whole texts: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Four kinds form the base (email, ip, card, phone) and are kept as they match and pass their tests. The others start with a score for their pattern,
gain ``CHECKED`` if a checksum confirms them (and are dropped if it denies them) and ``NEAR`` if a word of their kind stands near, and lose ``AGAINST``
if a word stands near that speaks of other numbers (orders, versions, books); they count from ``THRESHOLD`` on:

* ``iban``: a country's letters and length, confirmed by mod-97;
* ``national_id``: Spanish DNI and NIE (letter by mod-23), French NIR (key by mod-97), German tax number (mod-11,10), United States number by its ranges;
* ``account_card``: card numbers of 13 to 19 digits with Luhn's sum that the base misses: a block that other digits stand next to (the base joins them over a space), or grouped by other signs;
* ``local_phone``: telephone numbers without a country's code.

An added span that overlaps a base span, or an added one with a higher score (then: an earlier start), is left out. All patterns have one place to start in a run
of characters and a bounded or possessive length, so time grows with the text alone, whatever it is made of.

Nulls and odd rows: a null text is empty and has no spans. Repeated rows and null ids are each judged. Empty tables give no rows. ``found`` and ``redacted`` keep all columns of
their input; ``spans`` and ``redacted_text`` are added (a column of that name is replaced), ``text`` must be there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "account_card", "local_phone")
THRESHOLD = 0.6
CHECKED, NEAR, AGAINST = 0.35, 0.3, 0.35
#: Characters before and after a span in which words are looked for.
BEFORE, AFTER = 50, 20

#: Words that speak for a kind (English, German, French, Spanish), and words that speak against any.
CONTEXT = {
    "iban": "iban bank account konto bankverbindung überweisung compte virement cuenta transferencia bic swift",
    "national_id": "ssn social security tax steuer steuernummer identifikationsnummer idnr nir sécurité sociale insee dni nie nif documento identidad passport id",
    "account_card": "card credit debit visa mastercard amex karte kreditkarte carte bancaire crédit tarjeta crédito",
    "local_phone": "phone telephone tel call mobile cell fax telefon handy anrufen téléphone portable appeler teléfono móvil llamar",
}
CONTRARY = "order version isbn issn invoice tracking sku serial build commit bestellung rechnung commande facture pedido factura"
#: Letters of an IBAN's country and its length.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24}
#: Fixed value: control letters of Spanish numbers, by the rest modulo 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is matched from its first or not at all: from within it the pattern meets the same end.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}+(?![0-9A-Za-z])")
_GROUPED = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -./]{1,2}[0-9]{4}){2}[ -./]{1,2}[0-9]{1,7}(?![0-9A-Za-z])")
_BLOCK = re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{14,19}(?![0-9A-Za-z])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /.-]|[0-9]{3}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z.-]?[0-9A-Za-z])")
_DNI = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-Z](?![0-9A-Za-z])")
_NIR = re.compile(r"(?<![0-9A-Za-z])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]|[2-9][0-9]) ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9A-Za-z])")
_TAX = re.compile(r"(?<![0-9A-Za-z])[1-9][0-9](?: ?[0-9]{3}){3}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
_NUMBER = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

_NEAR = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}
_CONTRARY = frozenset(CONTRARY.split())


class Span(NamedTuple):
    """Code points of a text, the end exclusive."""

    kind: str
    start: int
    end: int
    score: float


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(number: str) -> bool:
    own = [int(c) for c in reversed(number)]
    return (sum(own[::2]) + sum(d * 2 - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def mod_97(iban: str) -> bool:
    """A country's length, and rest 1 of the number with letters as 10 to 35 and the head at its end."""
    if len(iban) != IBAN_LENGTHS.get(iban[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def dni(number: str) -> bool:
    own = number.replace("-", "")
    return DNI_LETTERS[int(own[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == own[-1]


def nir(number: str) -> bool:
    own = digits(number)
    return 97 - int(own[:13]) % 97 == int(own[13:])


def tax_number(number: str) -> bool:
    """German tax number: of the first ten digits one stands two or three times; the last is the check of ISO 7064 mod 11,10."""
    own = [int(c) for c in digits(number)]
    if max(map(own[:10].count, own[:10])) not in (2, 3):
        return False
    rest = 10
    for d in own[:10]:
        rest = ((rest + d) % 10 or 10) * 2 % 11
    return (11 - rest) % 10 == own[10]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``[A-Za-z0-9._%+-]+@...`` would match from the left, but from the signs outwards: every local part is read once."""
    last = 0
    for m in _EMAIL.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def base_spans(text: str) -> list[Span]:
    out = [Span("email", a, b, 1.0) for a, b in emails(text)] if "@" in text else []
    if not _NUMBER.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(Span("ip", m.start(), m.end(), 1.0))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(own := digits(m[0])) <= 19 and luhn(own):
            out.append(Span("card", m.start(), m.end(), 1.0))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits(m[0])) <= 15:
                out.append(Span("phone", m.start(), m.end(), 1.0))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def proposals(text: str) -> Iterator[tuple[str, int, int, float]]:
    """kind, start, end and the score of pattern and checksum; none that a checksum denies."""
    for m in _IBAN.finditer(text):
        end = m.end()
        # Upper-case words after the number can look like its end; the country says how long it is.
        length, n = IBAN_LENGTHS.get(m[0][:2], 0), 0
        for i, c in enumerate(m[0]):
            n += c != " "
            if n == length:
                end = m.start() + i + 1
                break
        if mod_97(text[m.start() : end].replace(" ", "")) and not text[end : end + 1].isalnum():
            yield "iban", m.start(), end, 0.4 + CHECKED
    for pattern, passes, score in ((_DNI, dni, 0.2), (_NIR, nir, 0.3), (_TAX, tax_number, 0.1)):
        for m in pattern.finditer(text):
            if passes(m[0]):
                yield "national_id", m.start(), m.end(), score + CHECKED
    for m in _SSN.finditer(text):
        yield "national_id", m.start(), m.end(), 0.4
    for pattern, score in ((_BLOCK, 0.25), (_GROUPED, 0.15)):
        for m in pattern.finditer(text):
            if 13 <= len(own := digits(m[0])) <= 19 and luhn(own):
                yield "account_card", m.start(), m.end(), score + CHECKED
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(digits(m[0])) <= 12:
            yield "local_phone", m.start(), m.end(), 0.35


def in_context(text: str, kind: str, start: int, end: int) -> float:
    """What nearby words add to a score or take from it."""
    words = {w.lower() for w in _WORD.findall(text, max(0, start - BEFORE), start)} | {w.lower() for w in _WORD.findall(text, end, end + AFTER)}
    return NEAR * bool(words & _NEAR[kind]) - AGAINST * bool(words & _CONTRARY)


def personal_spans(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """Base spans and those that the method adds, by start, then kind."""
    text = text or ""
    out = base_spans(text)
    if not _NUMBER.search(text):
        return out
    added = [Span(kind, a, b, round(score + in_context(text, kind, a, b), 6)) for kind, a, b, score in proposals(text)]
    added = [s for s in added if s.score >= threshold]
    if added:
        taken: list[tuple[int, int]] = []  # parts of the text in order, none of which overlap
        for s in out:  # base spans of several kinds can overlap
            if taken and s.start < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(taken[-1][1], s.end))
            else:
                taken.append((s.start, s.end))
        for s in sorted(added, key=lambda s: (-s.score, s.start, s.end, KINDS.index(s.kind))):
            k = bisect_right(taken, (s.start, len(text) + 1))
            if (k == 0 or taken[k - 1][1] <= s.start) and (k == len(taken) or s.end <= taken[k][0]):
                taken.insert(k, (s.start, s.end))
                out.append(s)
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def found(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end (code points, end exclusive) and score of all personal data in ``text``."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s._asdict() for s in personal_spans(t, threshold)])

    return docs.withColumn("spans", spans(F.col("text").cast("string")))


def redacted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``redacted_text``: each stretch of personal data replaced by its first kind in brackets."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            parts, at = [], 0
            for s in personal_spans(text, threshold):
                if s.start >= at:
                    parts += [text[at : s.start], f"[{s.kind}]"]
                at = max(at, s.end)
            return text if text is None else "".join(parts) + text[at:]

        return texts.map(one)

    return docs.withColumn("redacted_text", masked(F.col("text").cast("string")))


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joined = lambda spans: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)
    for batch in batches:
        counts, shas, alls = [], [], []
        for text in batch.column("text"):
            spans = personal_spans(text.as_py())
            base = [s for s in spans if s.kind in BASE]
            counts.append([sum(s.kind == k for s in base) for k in BASE])
            shas.append(sha256(joined(base).encode()).hexdigest())
            alls.append(joined(spans))
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(shas, pa.string()), pa.array(alls, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, hash of the base spans and all spans as ``kind:start:end``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_digest, DIGEST)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
