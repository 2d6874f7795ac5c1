from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from roadlens.llm import personal_data as pd

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c))))
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        if {"email": "@", "ip": "."}.get(kind, "") not in (text or ""):
            continue  # the plain pattern takes quadratic time on long runs
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) < 256 for p in m.group().split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def agree(df):
    rows = pd.report(df).collect()
    expected = Counter((r.doc_id, hashlib.sha256(",".join(brute(r.text)).encode()).hexdigest()) for r in df.collect())
    assert Counter((r.doc_id, r.base_sha256) for r in rows) == expected
    for r in rows:
        spans = [s for s in r.spans.split(",") if s]
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_base_spans_are_exact(docs, odd):
    agree(docs)
    agree(odd)


def test_base_spans_on_noise(spark):
    rng = random.Random(5)
    parts = ["a", "@", ".", "-", " ", "+", "(", ")", "1", "23", "255", "4539578763621486", "b.c", "%", "é", "😀", "\n", "256"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(800)]
    rows += [(900, "9" * 200_000), (901, "a." * 100_000), (902, "a@" + "b." * 50_000 + "c"), (903, "1." * 20_000 + "1"),
             (904, "+1" + " 2" * 100_000), (905, "x" * 5_000 + "@")]
    agree(spark.createDataFrame(rows, "doc_id long, text string"))


def test_added_spans(spark):
    texts = ['the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" is here', "call me: 555 123 4567 today",
             "see version 123.456.7890 of it", "write to jane.doe [at] mail [dot] org please"] * 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = [r.spans for r in pd.report(df).orderBy("doc_id").limit(4).collect()]
    assert spans[0] == "secret:13:53"
    assert spans[1].startswith("phone:9:")
    assert spans[3].startswith("email:9:")


def test_reliabilities_find_good_labelers():
    rng = random.Random(3)
    counts: Counter = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        cast = tuple((1 if truth else -1) * (1 if rng.random() < a else -1) for a in (0.95, 0.9, 0.85, 0.6, 0.55))
        counts[("email", cast)] += 1
    post, share, chance = pd.reliabilities([(k, v, n) for (k, v), n in sorted(counts.items())])
    assert abs(share[0] - 0.4) < 0.1
    yes = chance[:, 1, 2]
    assert yes[0] > yes[3] and yes[1] > yes[4]


def test_redaction(spark, odd, empty, clashing):
    df = spark.createDataFrame([(1, "ä mail a@b.cd, ip 1.2.3.4 😀 end"), (2, None), (3, "none")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pd.redacted(df).collect()}
    assert out == {1: "ä mail [EMAIL], ip [IP] 😀 end", 2: None, 3: "none"}
    assert pd.redacted(odd).count() == odd.count()
    assert pd.report(empty).count() == pd.redacted(empty).count() == 0
    assert pd.redacted(clashing.drop("_key", "_hash")).columns == clashing.drop("_key", "_hash").columns
    assert pd.report(clashing).count() == odd.count()


def test_no_python_on_the_executors(docs):
    plan = pd.candidates(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None


def test_spelled_addresses_in_capitals(spark):
    text = "JOHN (AT) SITE (DOT) COM"
    rows = spark.createDataFrame([(1, text), (2, text.lower()), (3, "AT HOME")], "doc_id long, text string")
    found = pd.candidates(rows, "doc_id", "text").filter("kind = 'email'").select("match").collect()
    assert sorted(r.match for r in found) == sorted([text, text.lower()])
