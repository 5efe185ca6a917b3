import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from saffron.llm import pii
from tests.conftest import MEDIUM
from tests.llm.rows import docs


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    found = []
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(d := re.sub("[^0-9]", "", t)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15),
    }
    for place, (kind, (pattern, good)) in enumerate(patterns.items()):
        found += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if good(m[0])]
    return [x for *_, x in sorted(found)]


def base(text):
    return [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.find(text) if k < 4]


@pytest.mark.parametrize(
    "text",
    [
        "a@b", "a@b.c", "a@@b.c", "a@b.c@d.e", ".@-.-", "x@y..z", "a@b.c.", "me@a.b-c.d,you@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "01.002.0003.4", "1..2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111",
        "4111  1111", "+1 (555) 123-4567", "+123456789", "+12345678", "++1 555 123 4567", "+1 2", "+1+2345678901", "+49 (0)30 1234567)", "0" * 19, "0" * 20, "5 5 5 5 5 5 5 5 5 5 5 5", "%+-@x.y",
    ],
)
def test_base_spans_of_single_cases(text):
    assert base(text) == brute(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@+-% 0123456789()é\n", max_size=70))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == brute(text)


def test_spans_of_documents(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    have = {r["doc_id"]: r for r in pii.spans(df).collect()}
    for r in df.collect():
        want = brute(r["text"] or "")
        row = have[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(x.startswith(k) for x in want) for k in pii.BASE]
        assert set(want) <= set(row["spans"].split(","))


def test_the_method_adds_logins_and_accounts():
    text = "see ftp://user:pw@host.example/x, IBAN DE89 3704 0044 0532 0130 00 and account: 12345678; IBAN DE00 3704 0044 0532 0130 00"
    kinds = [pii.KINDS[k] for _, k, _ in pii.find(text)]
    assert kinds.count("login") == 1 and kinds.count("account") == 2
    assert pii.masked("mail me@a.example now") == "mail <EMAIL> now"


@pytest.mark.parametrize(
    "text, want",
    [
        ('of token = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638" the', ["e7fbfec6a80404dc513b99d3fdbf2a6e53400638"]),
        ('TOKEN = "9233A8ECF7C5B09FE59012345"', ["9233A8ECF7C5B09FE59012345"]),
        ("API_KEY: abcd1234efgh5678.", ["abcd1234efgh5678"]),
        ('{"client_secret": "Zm9vYmFyMTIzNDU2Nzg5MA==", "password": "hunter2"}', ["Zm9vYmFyMTIzNDU2Nzg5MA==", "hunter2"]),
        ("token=pwd=abc123", ["abc123"]),
        ("the key: a word, a token = short1, secret = nodigitsinherewhatsoever", []),
        ("token", []), ("token = ", []), ("key e7fbfec6a80404dc513b99d3", []),
    ],
)
def test_the_method_adds_secrets(text, want):
    assert [text[s:e] for s, k, e in pii.find(text) if pii.KINDS[k] == "secret"] == want
    assert base(text) == brute(text)


def test_secrets_of_long_texts_take_linear_time():
    for part in ("token=", "token = ", "key" + " " * 50, "secret:." , "pwd=a1"):
        assert pii.find(part * (400_000 // len(part))) is not None
    assert pii.masked('my token = "' + "a1b2" * 10 + '" stays') == 'my token = "<SECRET>" stays'


def test_odd_rows(spark):
    df = docs(spark, clash=True)
    assert pii.spans(df).count() == df.count()
    assert pii.mask(df).columns == df.columns and pii.mask(df).count() == df.count()
    assert pii.masked(None) is None and pii.find(None) == [] and pii.masked("") == ""
    assert pii.spans(docs(spark, [])).count() == 0
