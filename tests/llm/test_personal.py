"""Personal data: base findings against plain regular expressions, added kinds, awkward tables."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm import personal
from staylens.llm.queries import op11_personal_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    """The base findings by regular expressions over the whole text."""
    digits = lambda s: [int(c) for c in s if c in "0123456789"]

    def checked(ds):
        twice = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(ds[::-1])]
        return 16 <= len(ds) <= 19 and sum(twice) % 10 == 0

    out = [("email", m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", m.span()) for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                   for p in m[0].split("."))]
    out += [("card", m.span()) for m in CARD.finditer(text) if checked(digits(m[0]))]
    out += [("phone", m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return [f"{k}:{a}:{b}" for k, (a, b) in out]


def mine(text):
    return [(personal.KINDS[k], a, b) for k, a, b in personal.SpanFinder()(text)]


def base(text):
    return [f"{k}:{a}:{b}" for k, a, b in mine(text) if k in personal.BASE]


@settings(max_examples=400, deadline=None)
@given(st.one_of(
    st.text(alphabet="a1.@+-% (é😀", max_size=40),
    st.text(alphabet="0123 -.+()", max_size=60),
    st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "256.1.1.1",
                              "a.b@c.de", "+1 (017) 555-7713", ".", "@", " ", "-", "+", "7", "é",
                              "😀", "x@y", "00000000001.2.3.4", "://u@"]), max_size=12).map("".join)))
def test_base_findings_equal_regular_expressions(text):
    assert base(text) == brute(text)


def test_added_kinds():
    found = lambda t: [(k, t[a:b]) for k, a, b in mine(t) if k not in personal.BASE]
    assert found("josé@ejemplo.es") == [("email_alt", "josé@ejemplo.es")]
    assert found("write jo [at] mail [dot] org.") == [("email_alt", "jo [at] mail [dot] org")]
    assert found("ftp://ann:pw@host.net/x") == [("login", "ftp://ann:pw@host.net")]
    assert found("see https://host.net/a@b") == []
    assert found("IBAN: GB82 WEST 1234 5698 7654 32 now") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found("IBAN GB82 WEST 1234 5698 7654 33") == []
    assert found("Kontonummer: 1234567890 und") == [("account", "1234567890")]
    assert found("SSN 078-05-1120, account of 12 people") == [("account", "078-05-1120")]
    assert found("accounts 1234567, on account 99") == []


def test_long_texts_are_read_in_linear_time():
    for piece in ("a", "a@", "1.", "1 ", "+1(", "://a", "1-", "@a.", "IBAN ", "[at]a", "account 1"):
        start = time.time()
        text = piece * (400_000 // len(piece))
        personal.SpanFinder()(text)
        assert time.time() - start < 10
    assert base("9" * 5000 + ".1.1.1") == []


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None), (1, ""), (None, "a@b.cd"), (2, "x" * 100_000 + " é a@b.cd 1.2.3.4"),
            (2, "x" * 100_000 + " é a@b.cd 1.2.3.4"), (3, "😀 +49 30 1234567")]
    return spark.createDataFrame([(i, t, "k", 1, None) for i, t in rows],
                                 "doc_id long, text string, kind string, spans int, email string")


def test_awkward_tables(spark, awkward):
    got = [tuple(r) for r in personal.span_digests(awkward).collect()]
    want = []
    for r in awkward.collect():
        found = brute(r["text"] or "")
        counts = [sum(s.startswith(k + ":") for s in found) for k in personal.BASE]
        want.append((r["doc_id"], *counts,
                     hashlib.sha256(",".join(found).encode()).hexdigest(), ",".join(found)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert personal.span_digests(awkward.limit(0)).count() == 0
    cut = personal.redact(awkward)
    assert cut.columns == awkward.columns
    texts = sorted(str(r["text"])[-30:] for r in cut.collect())
    assert texts == sorted(["None", "", "[email]", *["xxxxxxxxxxxx é [email] [ip]"[-30:].rjust(
        30, "x")] * 2, "😀 [phone]"])


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in
             spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_personal_data(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r["n_email"] for r in rows) > 0
    for r in rows:
        found = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert set(found) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in personal.BASE] == [
            sum(s.startswith(k + ":") for s in found) for k in personal.BASE]
