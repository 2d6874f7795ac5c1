from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from roadlens.llm import structure_repair as sr
from roadlens.llm.queries import damaged, op11
from tests.llm.conftest import FOLDER

WHITE = " \t\n\x0b\f\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def order(turn, role, text):
    return turn is not None, turn or 0, role, text


def with_faults(turns):
    """Turns in order and their faults."""
    out, seen = [], set()
    for turn, role, text in sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns),
                                   key=lambda r: order(*r)):
        kept = text.rstrip(WHITE)
        fault = ("blank" if not kept else "duplicate" if (role, text) in seen
                 else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(turns):
    """Least (cost, audit, repaired) by forward search over whole audits."""
    best = {"": (0, "", ())}

    def offer(to, state, found):
        if state not in to or found < to[state]:
            to[state] = found

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit, said) in list(states.items()):
                offer(states, NEXT[state], (cost + 3, audit + "I", (*said, ({"u": "user", "a": "assistant"}[NEXT[state]], ""))))
        return states

    for _, role, text, fault in turns:
        after, more = {}, 3 * (fault == "truncated")
        for state, (cost, audit, said) in inserted(best).items():
            offer(after, state, (cost + 4, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            first = role[:1]
            if first == NEXT[state] or first == "s" and state == "":
                offer(after, first, (cost + more, audit + "K", (*said, (role, text))))
            to = NEXT[state]
            offer(after, to, (cost + 3 + more, audit + "R", (*said, ({"u": "user", "a": "assistant"}[to], text))))
        best = after
    return min(best[s] for s in ("", "a") if s in inserted(best))


def everything(turns, most=2):
    """Least (cost, audit) by trying all edits."""
    best = None
    per = [[("D",)] + ([] if f in ("blank", "duplicate") else [("K",), ("R", "user"), ("R", "assistant")]) for *_, f in turns]
    gaps = [g for k in range(most + 1) for g in itertools.product(("u", "a"), repeat=k)]
    for edits in itertools.product(*per):
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            audit, initials, cost = "", "", 0
            for i, gap in enumerate(inserts):
                audit, initials, cost = audit + "I" * len(gap), initials + "".join(gap), cost + 3 * len(gap)
                if i < len(turns):
                    edit, (_, role, _, fault) = edits[i], turns[i]
                    audit += edit[0]
                    cost += {"D": 4, "K": 0, "R": 3}[edit[0]] + 3 * (fault == "truncated" and edit[0] != "D")
                    initials += "" if edit[0] == "D" else role[:1] or "?" if edit[0] == "K" else edit[1][0]
            if (best is None or (cost, audit) < best) and re.fullmatch("(s?(ua)+)?", initials):
                best = cost, audit
    return best


def report(turns):
    turns = with_faults(turns)
    cost, audit, said = cheapest(turns) if turns else (0, "", ())
    numbers = [t for t, *_ in turns if t is not None]
    faults = [f for *_, f in turns]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, faults.count("blank"),
            faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


def damage(turns):
    out = []
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(name.encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def made(rng, n):
    return [(t, r, (x or "") or None) for t, r, x in
            ((rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
              rng.choice(["a.", "b!", "c?", "cut", "", " \t", "x. ", "y", "z.\n", "w."])) for _ in range(n))]


def grouped(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_search_itself_against_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        turns = with_faults(made(rng, rng.randrange(1, 4)))
        assert cheapest(turns)[:2] == everything(turns)


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(2)
    rows = [(c, *t) for c in [None, *range(300)] for t in made(rng, rng.randrange(1, 12))]
    rows += [(1000, i % 900, rng.choice(["user", "assistant"]), f"line {i % 700}.") for i in range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)


@pytest.mark.parametrize("held", [sr.HELD_BYTES, 1])
def test_summaries_against_search(conversations, held):
    rows, df = conversations
    got = found(sr.summaries(df, held_bytes=held))
    assert got == {c: report(t) for c, t in grouped(rows).items()}


def test_state_crosses_batches(spark, conversations):
    rows, df = conversations
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(sr.summaries(df, held_bytes=200)) == {c: report(t) for c, t in grouped(rows).items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_rows(conversations):
    rows, df = conversations
    out = sorted((r for r in sr.repaired(df, held_bytes=5000).collect()), key=lambda r: (repr(r.conv_id), r.place))
    for conv, turns in grouped(rows).items():
        own = [r for r in out if r.conv_id == conv]
        want = report(turns)
        assert [r.place for r in own] == list(range(len(own)))
        assert "".join(r.edit for r in own) == want[6] and sum(r.cost for r in own) == want[5]
        said = [(r.role, r.text) for r in own if r.edit != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in said))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest() == want[7]


def test_query(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    hurt = grouped(damage(turns))
    assert found(op11(spark, FOLDER)) == {c: report(hurt.get(c, [])) for c in {t[0] for t in turns}}


def test_damage(spark):
    rng = random.Random(6)
    turns = [(rng.choice([None, *range(9)]), rng.choice([None, *range(99)]), rng.choice([None, "user"]),
              rng.choice([None, "a. b! c", "d"])) for _ in range(800)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert sorted(map(repr, map(tuple, damaged(df).collect()))) == sorted(map(repr, damage(turns)))


def test_dropped_empty_and_clashing(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    schema = "conv_id long, turn long, role string, text string, conv string, fault string, place string, _conv string"
    df = spark.createDataFrame([(gone, 0, "user", "hi.", "x", "x", "x", "x")], schema)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(op11(spark, str(tmp_path))) == {gone: nothing}
    assert found(sr.summaries(df)) == {gone: report([(0, "user", "hi.")])}
    assert sr.summaries(df.limit(0)).count() == sr.repaired(df.limit(0)).count() == 0


def test_long_texts(spark):
    turns = [(i, ("user", "assistant")[i % 2], "word " * 100_000 + f"{i}.") for i in range(6)]
    df = spark.createDataFrame([(1, *t) for t in turns], "conv_id long, turn long, role string, text string")
    assert found(sr.summaries(df, held_bytes=1 << 20)) == {1: report(turns)}
