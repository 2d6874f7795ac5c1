from __future__ import annotations

import corpus_pipeline
from roadlens.llm import cutting_stock, jaccard_join, longest_previous, rule_ledger
from roadlens.llm.storage import written
from tests.llm.test_cutting_stock import check, direct
from tests.llm.test_jaccard_join import brute as near
from tests.llm.test_longest_previous import brute as repeated
from tests.llm.test_personal_data import brute as personal

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, docs):
    steps = dict(corpus_pipeline.STAGES)
    now, schema = docs, docs.schema
    out = written(steps["quality_rules"](spark, now, FOLDER), "a")
    keep = {r.doc_id for r in rule_ledger.ledger(now).filter(rule_ledger.passes(rule_ledger.STANDARD)).collect()}
    assert {r.doc_id for r in out.collect()} == keep and out.schema == schema

    now, out = out, written(steps["ngram_jaccard_join"](spark, out, FOLDER), "b")
    rows = [(r.doc_id, r.text) for r in now.collect()]
    assert {r.doc_id for r in out.collect()} == {k for k, _, c in near(rows, 5, 80) if k == c}

    now, out = out, written(steps["suffix_array_dedup"](spark, out, FOLDER), "c")
    expected = {k: kept.decode("utf-8", "ignore") for k, _, _, _, kept in repeated(
        [(r.doc_id, r.text) for r in now.collect()], longest_previous.SPAN)}
    assert {r.doc_id: r.text for r in out.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in out.collect()) and out.columns == docs.columns

    now, out = out, written(steps["personal_data"](spark, out, FOLDER), "d")
    after = {r.doc_id: r.text for r in out.collect()}
    for r in now.collect():
        found = personal(r.text)
        assert (after[r.doc_id] == r.text) or "[" in after[r.doc_id]
        for span in found:
            kind, start, end = span.split(":")
            assert f"[{kind.upper()}]" in after[r.doc_id] or len(found) > 1
    assert out.columns == docs.columns

    placed = steps["packing"](spark, out, FOLDER).collect()
    assert check(placed, direct(after), cutting_stock.LENGTH) == 0


def test_run_and_odd_rows(spark, odd, empty):
    for df in (odd, empty, odd.selectExpr("*", "'x' AS class", "'y' AS block")):
        now = df
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, FOLDER), name)
            if name != "packing":
                assert now.columns == df.columns
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert jaccard_join.SHINGLE == 4
