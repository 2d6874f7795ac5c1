"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn followed by user and assistant turns in
alternation, from a user turn to an assistant turn. For every turn as given, dynamic
programming over the automaton of legal turns chooses whether it is kept, gets another
role, is merged into the turn before, or is preceded by an inserted empty turn, such that
the whole conversation is repaired at the least cost; then the turns are rendered.

A turn acts on the automaton's few states as a small (min, +) matrix. Rows are sorted by
conversation and turn into blocks of fixed size; matrices of blocks multiply, so a
conversation of any length is repaired block by block, and no task holds it whole: only
its blocks' matrices (one per ``BLOCK`` turns) meet. Rendered fragments come one per turn;
in order they make the conversation's text.

Null texts are empty; unknown or null roles must be given another; rows with a null
``conv_id`` are one conversation. Turns with equal numbers follow their role and text.
Repeated rows are turns like others. An empty table gives an empty result."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.storage import let_workers_import, written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # state: role of the last turn
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, GUESS, MERGE, MERGE_BLANK, INSERT = 3.0, 1.0, 1.0, 0.25, 2.0
BLOCK_BITS = 10
BLANK = r"\A[\x20\x09-\x0D]*\z"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _role_cost(role: int, to: int) -> float:
    """Cost of giving ``to`` (a state) to a turn of ``role`` (a state, 0 for unknown)."""
    return 0.0 if role == to else GUESS if role == START else RELABEL


def _actions(role: int, blank: bool) -> dict[tuple[int, int], tuple[float, str, int]]:
    """Cheapest action from state to state: cost, name and the role of an inserted turn (0: none)."""
    best: dict[tuple[int, int], tuple[float, str, int]] = {}

    def offer(before: int, after: int, cost: float, name: str, inserted: int) -> None:
        if (before, after) not in best or cost < best[before, after][0]:
            best[before, after] = (cost, name, inserted)

    for state in range(4):
        if state != START:
            offer(state, state, (MERGE_BLANK if blank else MERGE) + _role_cost(role, state) * (not blank), "merge", 0)
        for to in LEGAL[state]:
            offer(state, to, _role_cost(role, to), "keep" if role == to else "relabel", 0)
            for then in LEGAL[to]:
                offer(state, then, INSERT + _role_cost(role, then), "keep" if role == then else "relabel", to)
    return best


ACTIONS = {(r, b): _actions(r, b) for r, b in product(range(4), (False, True))}
STEP = {}
for kind, table in ACTIONS.items():
    STEP[kind] = np.full((4, 4), np.inf)
    for (i, j), (cost, _, _) in table.items():
        STEP[kind][i, j] = cost
# cost of the empty turns that a conversation still needs at its end, and their roles
ENDING = {START: (USER, ASSISTANT), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
END_COST = np.array([INSERT * len(ENDING[s]) for s in range(4)])


def _kind(role: str | None, text: str | None) -> tuple[int, bool]:
    name = (role or "").strip().lower()
    return (ROLES.index(name) + 1 if name in ROLES else START), not (text or "").strip(" \t\n\r\f\v")


def matrix(kinds: list[tuple[int, bool]]) -> np.ndarray:
    """Least costs from state to state over some turns."""
    out = STEP[kinds[0]]
    for k in kinds[1:]:
        out = (out[:, :, None] + STEP[k][None]).min(1)
    return out


def path(kinds: list[tuple[int, bool]], start: int, end: int | None) -> list[int]:
    """States after each turn on a cheapest way from ``start`` to ``end`` (None: the best ending)."""
    cost = [np.where(np.arange(4) == start, 0.0, np.inf)]
    for k in kinds:
        cost.append((cost[-1][:, None] + STEP[k]).min(0))
    state = int((cost[-1] + END_COST).argmin()) if end is None else end
    states = [state]
    for at in range(len(kinds) - 1, 0, -1):
        state = int((cost[at] + STEP[kinds[at]][:, state]).argmin())
        states.append(state)
    return states[::-1]


def _empty(role: int) -> str:
    return f"{OPEN}{ROLES[role - 1]}\n{CLOSE}"


def repair(roles: list, texts: list, start: int = START, end: int | None = None, last: bool = True):
    """Per turn: role, action, inserted role, cost and rendered fragment."""
    kinds = [_kind(r, t) for r, t in zip(roles, texts, strict=True)]
    before, out = start, []
    states = path(kinds, start, end)
    for i, (kind, text, state) in enumerate(zip(kinds, texts, states, strict=True)):
        cost, action, inserted = ACTIONS[kind][before, state]
        body = (text or "").replace("<|im_", "<| im_")
        if action == "merge":
            fragment = "\n" + body if body else ""
        else:
            fragment = ("" if before == START else CLOSE) + (_empty(inserted) if inserted else "")
            fragment += f"{OPEN}{ROLES[state - 1]}\n{body}"
        if last and i == len(kinds) - 1:
            fragment += CLOSE + "".join(map(_empty, ENDING[state]))
            cost += float(END_COST[state])
        out.append((ROLES[state - 1], action, ROLES[inserted - 1] if inserted else None, cost, fragment))
        before = state
    return out


def _segments(table: pa.Table):
    """Rows of a block in order, and the ranges of its conversations."""
    table = table.sort_by("place")
    keys = table.column("conv").to_pylist()
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return table, list(zip(cuts[:-1], cuts[1:], strict=True)) if keys else []


def _borders(table: pa.Table) -> pa.Table:
    """Matrices of a block's first and last conversation, which other blocks may continue."""
    table, found = _segments(table)
    roles, texts = table.column("role").to_pylist(), table.column("blank").to_pylist()
    rows = []
    for segment in sorted({0, len(found) - 1}):
        lo, hi = found[segment]
        costs = matrix([_kind(r, t) for r, t in zip(roles[lo:hi], texts[lo:hi], strict=True)])
        rows.append((table.column("conv")[lo].as_py(), table.column("block")[0].as_py(), segment, costs.ravel().tolist()))
    return pa.table({"conv": pa.array([r[0] for r in rows], table.schema.field("conv").type),
                     "block": pa.array([r[1] for r in rows], pa.int64()),
                     "segment": pa.array([r[2] for r in rows], pa.int64()),
                     "costs": pa.array([r[3] for r in rows], pa.list_(pa.float64()))})


def _chain(table: pa.Table) -> pa.Table:
    """States at the borders of a conversation's segments."""
    table = table.sort_by("block")
    steps = [np.array(c).reshape(4, 4) for c in table.column("costs").to_pylist()]
    cost = [np.array([0.0, np.inf, np.inf, np.inf])]
    for step in steps:
        cost.append((cost[-1][:, None] + step).min(0))
    ends = [int((cost[-1] + END_COST).argmin())]
    for at in range(len(steps) - 1, 0, -1):
        ends.append(int((cost[at] + steps[at][:, ends[-1]]).argmin()))
    ends = ends[::-1]
    n = len(steps)
    return pa.table({"block": table.column("block"), "segment": table.column("segment"),
                     "start": pa.array([START, *ends[:-1]], pa.int64()), "end": pa.array(ends, pa.int64()),
                     "last": pa.array([i == n - 1 for i in range(n)])})


def _repaired(table: pa.Table, said: pa.Table) -> pa.Table:
    table, found = _segments(table)
    borders = {r["segment"]: r for r in said.to_pylist()}
    roles, texts = table.column("role").to_pylist(), table.column("text").to_pylist()
    out = []
    for segment, (lo, hi) in enumerate(found):
        at = borders.get(segment, {"start": START, "end": None, "last": True})
        out += repair(roles[lo:hi], texts[lo:hi], at["start"], at["end"], at["last"])
    kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())
    return pa.table({"conv": table.column("conv"), "turn": table.column("turn"), "place": table.column("place"),
                     **{n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(
                         zip(("role", "action", "inserted", "cost", "rendered"), kinds, strict=True))}})


def repaired(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per turn: conversation, turn, ``place`` (a number that rises with the order of
    turns), new ``role``, ``action``, ``inserted``, ``cost`` and the ``rendered`` fragment."""
    let_workers_import(df.sparkSession)
    rows = df.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                     F.col(text).alias("text"))
    order = ["conv", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "turns")
    rows = rows.withColumn("block", F.shiftright("place", block_bits))
    blank = F.when(F.coalesce("text", F.lit("")).rlike(BLANK), "").otherwise("x")
    kind = rows.schema["conv"].dataType.simpleString()
    borders = rows.select("block", "place", "conv", "role", blank.alias("blank"))
    borders = borders.groupBy("block").applyInArrow(
        _borders, f"conv {kind}, block long, segment long, costs array<double>")
    said = borders.groupBy("conv").applyInArrow(
        _chain, "block long, segment long, start long, end long, last boolean")
    turns = rows.schema["turn"].dataType.simpleString()
    out = rows.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(
        _repaired, f"conv {kind}, turn {turns}, place long, role string, action string, inserted string, "
                   "cost double, rendered string")
    return out.withColumnRenamed("conv", conversation).withColumnRenamed("turn", turn)
