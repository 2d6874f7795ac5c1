"""Conversation structure repair as a secondary-sorted stream.

A legal conversation's role initials are ``(s?(ua)+)?``. Turns are kept (cost 0), given the
role user or assistant (3) or deleted (4, the only choice for blank and duplicate ones), empty
user and assistant turns are inserted anywhere (3), and every truncated turn that stays adds 3.
Of the cheapest repairs the one whose edits, as initials D, I, K, R in order, are least in
ASCII is taken.

Rows are dealt by conversation and sorted by turn from the last to the first, so one pass of
dynamic programming knows, at every turn and for every state of the automaton, the cost of the
cheapest continuation, and can note its least first edit: two bits a state, one byte a turn.
The state (four costs) is carried across Arrow batches. When the stream leaves a conversation,
the notes are read back from the first turn to the last and the edits come out in order.
Turns that wait for this are held as Arrow batches, notes as bytes; beyond ``HELD_BYTES`` both
go to scratch files of the task, which vanish when they are closed, so a giant conversation
takes bounded memory. Nothing but the task reads them, and a retry writes its own.

Faults of a turn, the first of: ``blank`` (no character but white space), ``duplicate`` (role
and text occur in an earlier turn), ``truncated`` (last such character is not ``.``, ``!`` or
``?``). Earlier turns are found by an aggregate over digests, not by a set in the stream.

Null roles and texts are one space each, so such texts are blank and such roles illegal. Null
turns come first. Rows of equal turn are ordered by role and text, and repeated rows are
turns like others. Rows with a null conversation are one conversation. An empty table gives
an empty result."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.storage import let_workers_import

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # initial of the last turn
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
WRITTEN = {state: next(x for x in follows if x != SYSTEM) for state, follows in FOLLOWS.items()}
LEGAL = ("su", "ua", "au")
EDITS = "DIKR"  # in ASCII order; a note is the place of the edit here
WHITE = " \t\n\x0b\f\r"
HELD_BYTES = 64 << 20
OUT_ROWS = 8192


def _step(costs: tuple[int, ...], initial: int, faulty: bool, truncated: bool) -> tuple[tuple[int, ...], int]:
    """Costs from each state on before a turn, given those behind it, and the noted edits."""
    more = TRUNCATED if truncated else 0
    best, edits = [0] * 4, [0] * 4
    # an insertion leads to another state before the same turn: settle the others first
    for state in range(4):
        options = [(DELETE + costs[state], 0)]
        if not faulty:
            if initial in FOLLOWS[state]:
                options.append((KEEP + more + costs[initial], 2))
            options.append((REROLE + more + costs[WRITTEN[state]], 3))
        best[state], edits[state] = min(options)
    for _ in range(3):  # no cheapest way inserts more than three turns at one place
        for state in range(4):
            cost = INSERT + best[WRITTEN[state]]
            if (cost, 1) < (best[state], edits[state]):
                best[state], edits[state] = cost, 1
    return tuple(best), edits[0] | edits[1] << 2 | edits[2] << 4 | edits[3] << 6


ENDING = (0, INSERT * 2, INSERT, 0)  # what the end of the conversation still costs from each state


class Steps:
    """Steps seen so far. Costs are kept relative to their least, so there are few."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def __call__(self, costs, initial, faulty, truncated):
        key = (costs, initial, faulty, truncated)
        found = self.known.get(key)
        if found is None:
            after, note = _step(costs, initial, faulty, truncated)
            least = min(after)
            found = self.known[key] = (tuple(c - least for c in after), note)
        return found


class Held:
    """Turns of one conversation from the last to the first, and a note each."""

    def __init__(self, limit: int):
        self.limit, self.size, self.rows = limit, 0, 0
        self.batches: list = []  # record batches, or places in the file
        self.notes = bytearray()
        self.file = self.note_file = None

    def add(self, batch: pa.RecordBatch, notes: bytes) -> None:
        self.rows += len(batch)
        self.notes += notes
        self.batches.append(batch)
        self.size += batch.get_total_buffer_size() + len(notes)
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file, self.note_file = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        for i, batch in enumerate(self.batches):
            if isinstance(batch, pa.RecordBatch):
                begin = self.file.tell()
                with pa.ipc.new_stream(self.file, batch.schema) as sink:
                    sink.write_batch(batch)
                self.batches[i] = (begin, self.file.tell() - begin)
        self.note_file.write(self.notes)
        self.notes, self.size = bytearray(), 0

    def forward(self) -> Iterator[tuple[pa.RecordBatch, bytes]]:
        """Batches and notes from the first turn to the last."""
        if self.file is not None:
            self._spill()
        end = self.rows
        for batch in reversed(self.batches):
            if not isinstance(batch, pa.RecordBatch):
                begin, size = batch
                self.file.seek(begin)
                batch = pa.ipc.open_stream(self.file.read(size)).read_next_batch()
            begin = end - len(batch)
            if self.file is not None:
                self.note_file.seek(begin)
                notes = self.note_file.read(len(batch))
            else:
                notes = bytes(self.notes[begin:end])
            yield batch.take(pa.array(np.arange(len(batch) - 1, -1, -1))), notes[::-1]
            end = begin

    def close(self) -> None:
        for file in (self.file, self.note_file):
            if file is not None:
                file.close()


def _edits(held: Held) -> Iterator[tuple]:
    """Rows of the repaired conversation in order: turn, edit, given role, role, text, fault, cost."""
    state = START
    for batch, notes in held.forward():
        turns, roles, texts, faults = (batch.column(c).to_pylist() for c in ("turn", "role", "text", "fault"))
        for turn, role, text, fault, note in zip(turns, roles, texts, faults, notes, strict=True):
            while (edit := EDITS[note >> 2 * state & 3]) == "I":
                state = WRITTEN[state]
                yield None, "I", None, ROLE_OF[state], "", None, INSERT
            more = TRUNCATED if fault == "truncated" else 0
            if edit == "D":
                yield turn, edit, role, None, None, fault, DELETE
            elif edit == "K":
                state = STATE_OF[role[:1]]
                yield turn, edit, role, role, text, fault, KEEP + more
            else:
                state = WRITTEN[state]
                yield turn, edit, role, ROLE_OF[state], text, fault, REROLE + more
    while state not in (START, ASSISTANT):
        state = WRITTEN[state]
        yield None, "I", None, ROLE_OF[state], "", None, INSERT


def _with_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches and the faults of their rows, where all rows but the first of several equal ones
    (the last that streams) are duplicates."""
    named = ("conv", "turn", "role", "text")
    held = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            yield held, _faults(held, tuple(batch.column(c)[0].as_py() for c in named))
        held = batch
    if held is not None:
        yield held, _faults(held, None)


def _faults(batch: pa.RecordBatch, beyond: tuple | None) -> list:
    faults = batch.column("fault").to_pylist()
    turns, roles = batch.column("turn").to_pylist(), batch.column("role").to_pylist()
    for i in range(len(batch)):
        if faults[i] == "blank":
            continue
        if i + 1 == len(batch):
            same = beyond is not None and beyond == tuple(batch.column(c)[i].as_py() for c in ("conv", "turn", "role", "text"))
        else:
            same = (turns[i] == turns[i + 1] and roles[i] == roles[i + 1]
                    and all(batch.column(c)[i].as_py() == batch.column(c)[i + 1].as_py() for c in ("conv", "text")))
        if same:
            faults[i] = "duplicate"
    return faults


def stream(batches: Iterator[pa.RecordBatch], limit: int = HELD_BYTES) -> Iterator[tuple]:
    """Per conversation its key and an iterator over its edits, which must be read to its end
    before the next. ``batches`` are sorted by conversation, and from the last turn back."""
    steps, held, key, costs = Steps(), None, None, ENDING
    for batch, faults in _with_copies(batches):
        batch = batch.set_column(batch.schema.get_field_index("fault"), "fault", pa.array(faults, pa.string()))
        keys, roles = batch.column("conv").to_pylist(), batch.column("role").to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held is None or keys[lo] != key:
                if held is not None:
                    yield key, _edits(held)
                    held.close()
                held, key, costs = Held(limit), keys[lo], ENDING
            notes = bytearray()
            for role, fault in zip(roles[lo:hi], faults[lo:hi], strict=True):
                costs, note = steps(costs, STATE_OF.get(role[:1], -1), fault in ("blank", "duplicate"),
                                    fault == "truncated")
                notes.append(note)
            held.add(batch.slice(lo, hi - lo), bytes(notes))
    if held is not None:
        yield key, _edits(held)
        held.close()


def sorted_turns(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Columns conv, turn, role, text and ``fault``, dealt by conversation and sorted from the
    last turn to the first.

    Only digests that a conversation has at several turns come back from the aggregate and are
    joined; equal rows of one turn lie side by side and are left to the stream."""
    rows = df.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"),
                     F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    kept = F.rtrim("text", F.lit(WHITE))
    spoken = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    rows = rows.withColumn("digest", F.when(kept != "", F.unhex(F.sha2(spoken, 256))))
    order = F.struct("turn")
    first = (rows.filter(F.col("digest").isNotNull())
             .groupBy(F.col("conv").alias("_conv"), F.col("digest").alias("_digest"))
             .agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
             .filter(F.col("_first") < F.col("_last")).drop("_last"))
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    fault = (F.when(kept == "", "blank").when(order > F.col("_first"), "duplicate")
             .when(~F.substring(kept, -1, 1).isin(".", "!", "?"), "truncated"))
    rows = rows.select("conv", "turn", "role", "text", fault.alias("fault"))
    return rows.repartition("conv").sortWithinPartitions(
        "conv", F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc())


def repaired(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per edit: conversation, ``place`` (0, 1, .. in order), turn, ``edit`` (K, R, D or I),
    ``given_role``, role and text after repair (null: deleted), ``fault`` and ``cost``."""
    rows = sorted_turns(df, conversation, turn, role, text)
    kinds = {"conv": rows.schema["conv"].dataType.simpleString(), "place": "bigint",
             "turn": rows.schema["turn"].dataType.simpleString(), "edit": "string", "given_role": "string",
             "role": "string", "text": "string", "fault": "string", "cost": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def watched():
            for batch in batches:
                if not types:
                    named = {"conv": batch.schema.field("conv").type, "turn": batch.schema.field("turn").type,
                             "place": pa.int64(), "cost": pa.int64()}
                    types.extend(named.get(name, pa.string()) for name in kinds)
                yield batch

        def made(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], list(kinds))

        out: list[tuple] = []
        size = 0
        for key, edits in stream(watched(), held_bytes):
            for place, edit in enumerate(edits):
                out.append((key, place, *edit))
                size += len(edit[4] or "")
                if len(out) >= OUT_ROWS or size > held_bytes:
                    yield made(out)
                    out, size = [], 0
        if out:
            yield made(out)

    let_workers_import(df.sparkSession)
    out = rows.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))
    return out.withColumnsRenamed({"conv": conversation, "turn": turn, "role": role, "text": text})


class Summary:
    """What is reported of one conversation, from its edits in order."""

    def __init__(self):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.first = self.last = self.role = None
        self.turns = self.illegal = self.cost = 0
        self.audit = bytearray()
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, turn, edit, given, role, text, fault, cost) -> None:
        self.audit += edit.encode()
        self.cost += cost
        if fault is not None:
            self.counts[fault] += 1
        if given is not None:
            if self.role is not None:
                self.illegal += self.role[:1] + given[:1] not in LEGAL
            self.role = given
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if role is not None:
            self.hash.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, *self.counts.values(), self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest())


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def summaries(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text", held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per conversation: the ``gaps`` in its turns, its faults, its ``illegal`` neighbours,
    the ``cost``, the edits' initials (``audit``) and the digest of the repaired conversation."""
    rows = sorted_turns(df, conversation, turn, role, text)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def watched():
            for batch in batches:
                types[:] = types or [batch.schema.field("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield batch

        def made(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)],
                ["conv", *NUMBERS, "audit", "repaired_sha256"])

        out: list[tuple] = []
        for key, edits in stream(watched(), held_bytes):
            summary = Summary()
            for edit in edits:
                summary.add(*edit)
            out.append((key, *summary.row()))
            if len(out) >= OUT_ROWS:
                yield made(out)
                out = []
        if out:
            yield made(out)

    let_workers_import(df.sparkSession)
    numbers = ", ".join(f"{name} bigint" for name in NUMBERS)
    out = rows.mapInArrow(run, f"conv {kind}, {numbers}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("conv", conversation)
