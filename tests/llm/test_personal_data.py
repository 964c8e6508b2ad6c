import re
import time
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm.personal_data import BASE, base_spans, digests, dni, found, luhn, mod_97, nir, personal_spans, redacted, tax_number

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(number):
    total = 0
    for i, c in enumerate(number[::-1]):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(n) <= 19 and brute_luhn(n), "phone": 10 <= len(n) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


@settings(max_examples=3000, deadline=None)
@given(st.one_of(st.text("a1.@-_+ 5", max_size=40), st.text("0123456789.- +()", max_size=60), st.text("é9@.xA%\n 0", max_size=40)))
def test_base_is_what_the_patterns_match(text):
    assert [s[:3] for s in base_spans(text)] == brute(text)
    assert [s[:3] for s in personal_spans(text) if s.kind in BASE] == brute(text)


TEXTS = {
    "Pay to DE89 3704 0044 0532 0130 00 NOW": [("iban", "DE89 3704 0044 0532 0130 00")],
    "GB82WEST12345698765432, thanks": [("iban", "GB82WEST12345698765432")],
    "GB82WEST12345698765433, thanks": [],  # mod-97 denies it
    "My SSN is 536-22-1234.": [("national_id", "536-22-1234")],
    "part 536-22-1234 of the machine": [],
    "DNI: 12345678Z": [("national_id", "12345678Z")],
    "DNI: 12345678A": [],
    "numéro de sécurité sociale 1 85 05 78 006 080 95": [("national_id", "1 85 05 78 006 080 95")],
    "Steuer-ID 86095742719": [("national_id", "86095742719")],
    "order 86095742719 tax": [],  # a contrary word
    "visa card 4111.1111.1111.1111": [("account_card", "4111.1111.1111.1111")],
    "4111.1111.1111.1112 is no card": [],
    "card 4111 1111 1111 1111": [("card", "4111 1111 1111 1111")],
    "call me: (030) 901 820 today": [("local_phone", "(030) 901 820")],
    "tel 555-017-7713": [("local_phone", "555-017-7713")],
    "in 1999-2001 and 2005-2007 we saw 10 000 of 12 000": [],
    "version 1.2.3.4, mail a.b+c@mail.example.com": [("ip", "1.2.3.4"), ("email", "a.b+c@mail.example.com")],
    "": [],
    None: [],
}


@pytest.mark.parametrize("text", TEXTS)
def test_checksums_and_context(text):
    assert [(s.kind, text[s.start : s.end]) for s in personal_spans(text)] == TEXTS[text]


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and mod_97("FR1420041010050500013M02606") and not mod_97("XX1420041010050500013M02606")
    assert dni("X1234567L") and not dni("X1234567M") and nir("255081416802538") and not nir("255081416802539") and tax_number("86095742719") and not tax_number("86095742718")
    assert all(luhn(str(n)) == brute_luhn(str(n)) for n in range(2000))


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "a@b." * 80_000, "+1 " * 100_000, "+" * 300_000, "1 " * 150_000, "DE89 " * 60_000, "(030) " * 50_000, "A1" * 150_000, "12-" * 100_000])
def test_time_grows_with_the_text_alone(text):
    began = time.time()
    personal_spans(text)
    assert time.time() - began < 5


ROWS = [(1, "write to é x@y.zz or +1 (017) 555-7713"), (2, None), (3, ""), (3, ""), (None, "97.51.17.173 4111111111111111"), (4, "clean text " * 50_000), (5, "iban DE89370400440532013000")]


def test_rows_and_columns(spark):
    docs = spark.createDataFrame([(i, t, "old", 7, 1) for i, t in ROWS], "doc_id long, text string, spans string, n_ip int, kind int")
    got = sorted(map(tuple, digests(docs).collect()), key=repr)
    want = []
    for i, t in ROWS:
        base = brute(t or "")
        joined = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        want.append((i, *(sum(k == x[0] for x in base) for k in BASE), sha256(joined(base).encode()).hexdigest(), joined(s[:3] for s in personal_spans(t))))
    assert got == sorted(want, key=repr)
    kept = found(docs)
    assert kept.columns == docs.columns and {r.doc_id: [s.kind for s in r.spans] for r in kept.collect()}[5] == ["iban"]
    texts = [r.redacted_text for r in redacted(docs).orderBy("doc_id").collect()]
    assert texts[0] == "[ip] [account_card]" and texts[1] == "write to é [email] or [phone]" and texts[2] is None and texts[-1] == "iban [iban]"
    assert digests(docs.limit(0)).count() == 0
