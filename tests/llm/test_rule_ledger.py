from __future__ import annotations

import re

from roadlens.llm import rule_ledger as rl

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(i + j for i in places for j in range(8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines),
            len(lines) - len(set(lines)), len(covered), sum("A" <= c <= "Z" for c in text),
            sum("A" <= c <= "Z" or "a" <= c <= "z" for c in text), sum(a == b for a, b in zip(w, w[1:])))


def test_measures_are_those_of_brute_force(docs, odd):
    for df in (docs, odd):
        rows = df.collect()
        expected = sorted(((r.doc_id or 0, *brute(r.text)) for r in rows))
        found = sorted((r.doc_id or 0, *[r[m] for m in rl.MEASURES]) for r in rl.ledger(df).collect())
        assert found == expected


def test_policies_read_the_mask(docs):
    rows = rl.ledger(docs)
    assert rows.filter(rl.passes(rl.BASE)).count() >= rows.filter(rl.passes(rl.STANDARD)).count() > 0


def test_ablations_match_policies(docs):
    rows = rl.ledger(docs).cache()
    kept = rows.filter(rl.passes(rl.STANDARD)).count()
    for r in rl.ablations(rows, rl.STANDARD).collect():
        without = rl.Policy("x", tuple(n for n in rl.STANDARD.rules if n != r.rule))
        assert rows.filter(rl.passes(without)).count() == r.kept_without == kept + r.only_this


def test_empty_and_clashing(empty, clashing):
    assert rl.ledger(empty).count() == 0
    out = rl.with_ledger(clashing)
    assert out.count() == clashing.count()
    assert out.filter("n_words < 0 OR failures < 0").count() == 0
