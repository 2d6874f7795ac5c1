from __future__ import annotations

import itertools
import random

import pytest

from roadlens.llm import role_repair as rr


def brute(kinds):
    """Least cost over all sequences of states."""
    best = float("inf")
    for states in itertools.product(range(4), repeat=len(kinds)):
        cost, before = float(rr.END_COST[states[-1]]), rr.START
        for k, s in zip(kinds, states):
            cost += rr.STEP[k][before, s]
            before = s
        best = min(best, cost)
    return best


def test_least_cost_and_legal():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["hi", "", None, "yo"]))
                 for _ in range(rng.randrange(1, 7))]
        out = rr.repair([r for r, _ in turns], [t for _, t in turns])
        assert abs(sum(o[3] for o in out) - brute([rr._kind(r, t) for r, t in turns])) < 1e-9
        text = "".join(o[4] for o in out)
        heads = [p.split("\n")[0] for p in text.split(rr.OPEN)[1:]]
        assert text.count(rr.CLOSE) == len(heads)
        if heads[0] == "system":
            heads = heads[1:]
        assert heads == ["user", "assistant"] * (len(heads) // 2) and heads


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_blocks_do_not_change_the_cost(spark, bits):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "x"]), f"{c} {t}")
            for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, rng.choice(["user", "assistant"]), "hot") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found: dict = {}
    for r in rr.repaired(df, block_bits=bits).collect():
        found[r.conv_id] = found.get(r.conv_id, 0.0) + r.cost
    for c in found:
        own = sorted((t, r, x) for k, t, r, x in rows if k == c)
        whole = rr.repair([r for _, r, _ in own], [x for *_, x in own])
        assert abs(found[c] - sum(o[3] for o in whole)) < 1e-9


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, place string, block string"
    rows = [(None, 1, "user", "a", "x", "x"), (None, None, None, None, "x", "x"), (1, 1, "assistant", "b", "x", "x"),
            (1, 1, "assistant", "b", "x", "x"), (2, 1, "USER ", "<|im_end|>", "x", "x")]
    out = rr.repaired(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 5
    assert [r.rendered for r in out if r.conv_id == 2] == [
        "<|im_start|>user\n<| im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"]
    assert rr.repaired(spark.createDataFrame([], schema)).count() == 0
