"""Markov spans against a plain loop over the same ratios, and how many random strings are found by length."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from barspark.llm import secrets

RUN = re.compile(r"[A-Za-z0-9+_-]+")


def plain(text, base, ratios):
    """Spans of rank 3 of a text, as (start, end)."""
    out = []
    for m in RUN.finditer(text):
        run = m[0].lower()
        total = sum(ratios[128 * ord(a) + ord(b)] for a, b in zip(run, run[1:]))
        if len(run) >= secrets.LEAST_TOKEN and re.search("[a-z]", run) and total >= secrets.PRIOR and not any(s < m.end() and m.start() < e for s, e in base):
            out.append((m.start(), m.end()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    some = lambda al, n: "".join(rng.choice(al) for _ in range(n))
    common = ["ordinary", "identifier", "settings", "reader_of_files", "understanding", "well-being", "ünïcode", "configuration"]
    out = []
    for k in range(400):
        words = [rng.choice(common) for _ in range(12)]
        if k % 2 == 0:
            words.insert(rng.randrange(12), f"token = {some('0123456789abcdef', 32)}")
        if k % 3 == 0:
            words.insert(rng.randrange(12), f"path/{some(string.ascii_letters + string.digits, 12 + k % 30)}=")
        out.append(" ".join(words))
    out += ["password:" + some(string.ascii_letters, 20) + "/" + some(string.ascii_letters, 20), "1234567890123456", "-" * 40, "☃" * 50 + some(string.ascii_lowercase, 30)]
    # More spans than a block of the running sums holds, some beside and some apart from others.
    out.append(" ".join(f"secret={some('0123456789abcdef', 24)} {'x/' + some(string.ascii_lowercase, 24) if k % 10 == 0 else rng.choice(common)}" for k in range(700)))
    return out


def test_markov_spans_equal_a_plain_loop(spark, texts, monkeypatch):
    kept = []
    train = secrets.train
    monkeypatch.setattr(secrets, "train", lambda *a: kept.append(train(*a)) or kept[-1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_spans(df).collect()}
    assert len(kept) == 1
    for i, t in enumerate(texts):
        base = [(s.start, s.end) for s in got[i] if s.rank < 3]
        assert [(s.start, s.end) for s in got[i] if s.rank == 3] == plain(t, base, kept[0]), t[:200]
        assert got[i] == sorted(got[i])
    # The last text's random strings are also samples of ordinary identifiers, so not all of them are found.
    ranks = [s.rank for s in got[len(texts) - 1]]
    assert ranks.count(3) > 30 and ranks.count(0) == 700


def test_recall_by_length_and_clean_documents(spark):
    rng = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = [(-1 - k, n, f"see path/{''.join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))} there") for k, n in enumerate(n for n in (12, 16, 20, 32) for _ in range(100))]
    planted = spark.createDataFrame([(i, t) for i, _, t in made], "doc_id long, text string")
    out = secrets.secret_spans(docs.unionByName(planted)).where(F.exists("spans", lambda x: x["rank"] == 3))
    hits = {r.doc_id for r in out.select("doc_id").collect()}
    share = {n: sum(i in hits for i, m, _ in made if m == n) / 100 for n in (12, 16, 20, 32)}
    assert share[12] >= 0.75 and share[16] >= 0.9 and share[20] >= 0.95 and share[32] == 1.0, share
    assert not [i for i in hits if i >= 0]
