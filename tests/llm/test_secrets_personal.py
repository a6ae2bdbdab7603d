"""Secrets and personal data."""

import base64
import json
import re

import pytest
from pyspark.sql import functions as F

from tertulia.llm import personal, secrets


def der(tag, content):
    size = len(content)
    head = bytes([size]) if size < 128 else bytes([0x80 | 2]) + size.to_bytes(2, "big")
    return bytes([tag]) + head + content


KEY = der(0x30, der(0x02, b"\0") + der(0x30, der(0x06, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01") + b"\x05\0") + der(0x04, b"k" * 200))
SSH = b"".join(len(p).to_bytes(4, "big") + p for p in (b"ssh-ed25519", b"p" * 32))
B64 = lambda b: base64.b64encode(b).decode()
URL = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
TOKEN = f"{URL({'alg': 'HS256', 'typ': 'JWT'})}.{URL({'sub': '1'})}.c2lnbmF0dXJlLWJ5dGVz"
PEM = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", B64(KEY))) + "\n-----END PRIVATE KEY-----"


def kinds(text):
    return [k for k, _, _ in secrets.all_spans(text)]


def test_structures_are_confirmed():
    assert kinds(PEM)[0] == "pem"
    assert kinds(f"x {B64(KEY)} y") == ["key"] and kinds(KEY.hex()) == ["hex", "key"]
    assert kinds(f"ssh {B64(SSH)}") == ["ssh"]
    assert kinds(f"bearer {TOKEN}") == ["signed"]


@pytest.mark.parametrize(
    "text",
    [
        "", "plain words only", B64(b"just some words that are no key at all, and long enough"), B64(KEY[:-1]), "A" * 500,
        TOKEN.replace("eyJ", "eyK"), f"{URL([1])}.{URL({})}.x", PEM.replace(B64(KEY)[8:12], "!!!!"),
        "-----BEGIN PRIVATE KEY-----\n-----END PRIVATE KEY-----", B64(der(0x30, b"\x13\x05hello" * 5)), "ſecret: abcdefgh",
    ],
)
def test_what_only_looks_like_one_is_not_reported(text):
    assert kinds(text) == []


def test_base_spans():
    text = "é password=abcdef Secret: 'hunter22' api_key=short token x AKIA" + "A1" * 8 + " AKIAXX " + "0a" * 12 + " " + "f" * 23
    found = [(k, text[a:b]) for k, a, b in secrets.base_spans(text)]
    assert found == [
        ("assign", "password=abcdef"),
        ("assign", "Secret: 'hunter22"),
        ("access", "AKIA" + "A1" * 8),
        ("hex", "0a" * 12),
    ]


def test_deep_and_long_inputs():
    nested = b""
    for _ in range(60):
        nested = der(0x30, nested + b"\x05\0")
    assert not secrets.is_key_encoding(nested)
    assert kinds("Ab0" * 200_000) == []


def test_redaction(spark):
    rows = [(1, f"é password=abcdef{'0' * 30} end"), (1, None), (None, ""), (2, "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secret_spans", F.lit("clash"))
    out = secrets.with_redacted(secrets.with_secret_spans(df)).select("doc_id", "text").collect()
    assert [tuple(r) for r in out] == [(1, "é [SECRET] end"), (1, None), (None, ""), (2, "clean")]
    assert secrets.with_secret_spans(df.limit(0)).count() == 0
    assert secrets.merged([(5, 9), (0, 3), (3, 4), (6, 7)]) == [(0, 4), (5, 9)]


def plain(text):
    """Base spans by Python's engine."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in reversed(re.sub("[^0-9]", "", m[0]))]
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


PERSONAL = [
    None, "", "nothing here", "é a@b.co, x@y and ab@c.d.e-f.org+k@l.mn a@b@c.de", "1.2.3.4.5 256.1.1.1 0000255.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111123", "+1 (988) 555-2485 +12 +1 2 3 4 5 6 7 8) +1234567890123456",
    "card 4041894974608795 from 42.144.35.254, bosbt.42@mail8.example.com", "user@host.com " * 300, "9" * 20_000,
    "a." * 20_000, "1.1.1.1 " * 600, "x" * 50_000 + "@a.b", "+1 " + " " * 5000, "👍" * 10 + " 10.0.0.1",
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame(list(enumerate([*PERSONAL, PERSONAL[7]])), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = personal.personal_spans(df).orderBy("doc_id").collect()
    for r, text in zip(got, [*PERSONAL, PERSONAL[7]], strict=True):
        assert [(s.kind, s.start, s["end"]) for s in r.spans if s.base] == plain(text or ""), (text or "")[:60]


def test_added_spans(spark):
    texts = ["social security ssn 123-45-6789", "dear Mr. John Smith", "iban DE89 3704 0044 0532 0130 00", "section 123-45-678"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in personal.personal_spans(df).collect()}
    assert got[3] == [] and all(not base for spans in got.values() for _, base in spans)
    assert ("iban", False) in got[2]


def test_reliabilities_follow_the_votes():
    # kind 0: form and context agree, the gazetteer contradicts both at random
    cells = [(0, (1, v, 1), 0, 200) for v in (0, 1)] + [(0, (0, v, 0), 0, 200) for v in (0, 1)]
    truth = personal.posteriors(cells)
    assert min(truth[:2]) > 0.9 and max(truth[2:]) < 0.1
    model = personal.train(cells, truth)
    assert model.margin(0, (1, 0, 1), 0) > 0 > model.margin(0, (0, 1, 0), 0)
    assert personal.posteriors([]) == [] and personal.train([], []).bias == [0.0] * len(personal.KINDS)


def test_no_documents(spark):
    assert personal.personal_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("header", ['{"alg":"HS256"}', '{ "alg": "HS256" }', '{\n"alg": "HS256"}', '\t{"alg": "none"}'])
def test_signed_tokens_however_their_header_begins(header):
    parts = [base64.urlsafe_b64encode(x.encode()).decode().rstrip("=") for x in (header, '{ "sub": 1 }', "signature")]
    token = ".".join(parts)
    assert secrets.all_spans(f"see {token} there") == [("signed", 4, 4 + len(token))]
    assert secrets.all_spans(f"see x{token[1:]} there") == []


def test_markers_without_an_end_take_linear_time():
    import time

    text = "-----BEGIN A-----\n" * 60_000  # 1 MB
    start = time.process_time()
    assert secrets.all_spans(text) == []
    assert time.process_time() - start < 2
