"""Secret scans of crowded and odd texts against spans found one by one."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import secrets


def spans_in(text: str):
    found = []
    for number, (kind, pattern, group, least) in enumerate(secrets.RULES):
        found += [(m.start(), number, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(found)


def masked(text: str) -> str:
    at, out = 0, ""
    for start, _, end, _ in spans_in(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def texts():
    deal, words = random.Random(7), ["token=", "api_key: 'abc.def12'", "AKIA" + "Q1" * 9, "0123456789abcdef" * 2, "été", "😀", "\n", " ", "x", "password=AKIA" + "7" * 20, "secret = " + "a1" * 15, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "ghp_" + "k" * 36, "word " * 300]
    return [None, "", " ", "😀" * 1023 + "token=abcdef", "é" * 1024 + "token=abcdef" + "é" * 2049] + ["".join(deal.choice(words) for _ in range(deal.randrange(1, 60))) for _ in range(120)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "own", len(t or "")) for k, t in enumerate(texts())]
    rows += [(3, rows[3][1], "again", 1), (None, "token=abcdef", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars int")


def test_scan_is_brute_force(odd):
    want = sorted((r.doc_id is None, r.doc_id, ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans_in(r.text or ""))) for r in odd.collect())
    got = secrets.secret_scan(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.spans) for r in got) == want
    base = {",".join(f"{k}:{a}:{b}" for a, n, b, k in spans_in(r.text or "") if n < secrets.BASE) for r in odd.collect()}
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b.encode()).hexdigest() for b in base}


@pytest.mark.parametrize("few", [20_000, 0])
def test_redacted_is_brute_force(odd, monkeypatch, few):
    monkeypatch.setattr(secrets, "BROADCAST_BLOBS", few)
    out = secrets.redacted(odd)
    assert out.columns == odd.columns and out.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.spans or "")
    for r, new in zip(sorted(odd.collect(), key=order), sorted(out.collect(), key=order), strict=True):
        assert new.spans == r.spans and new.text == (None if r.text is None else masked(r.text))
        assert new.n_chars == (len(new.text) if r.text is not None and spans_in(r.text) else r.n_chars)


def test_a_text_of_many_secrets(spark):
    n = 32_000
    text = "".join(f"token={k:08d}é and " for k in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert secrets.secret_scan(docs).select("n_assign", F.length("spans").alias("n")).first() == (n, len(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans_in(text))))
    assert secrets.redacted(docs).first().text == masked(text)
    assert time.time() - began < 20


def test_no_rows(spark, odd):
    assert secrets.secret_scan(odd.limit(0)).count() == 0 and secrets.redacted(odd.limit(0)).count() == 0
