"""Conversation structure repair by weighted finite-state composition.

A conversation's rows are an input acceptor, the edits a transducer, and the
roles' grammar an acceptor.  Their composition is built lazily, only where it
can be reached from the start; weights are (cost, labels) pairs, compared by
cost and then by label string.  The shortest path is found from the end of the
rows backwards: labels are then added in front, which keeps the order of
strings, and as the edits out of one state differ in their labels, the first
label alone decides between paths of one cost.

Rows of a conversation meet in one task, which holds one conversation at a
time: a conversation is a record here, as a text is elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\v\f\r"
#: Faults of a row, in the order in which they count.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Conversations of at most so many rows share repairs by their signature.
SHARED_ROWS = 64


@dataclass(frozen=True)
class Grammar:
    """A deterministic acceptor of role initials: ``arcs[state]`` maps an
    initial to the next state."""

    arcs: tuple[tuple[tuple[str, int], ...], ...]
    start: int
    finals: frozenset[int]


#: (s?(ua)+)?
ROLES = Grammar(arcs=((("s", 1), ("u", 2)), (("u", 2),), (("a", 3),), (("u", 2),)), start=0, finals=frozenset({0, 3}))


@dataclass(frozen=True)
class Edits:
    """Costs of the edits, and the roles that Rerole and Insert may write by
    their initials.  A state of the grammar may accept one of them at most, so
    that an edit's label says what it does."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    roles: tuple[tuple[str, str], ...] = (("u", "user"), ("a", "assistant"))


def shortest_edits(rows: tuple[tuple[str, int], ...], grammar: Grammar, edits: Edits) -> tuple[int, str] | None:
    """(cost, labels) of the cheapest path for rows of (initial, fault), ties
    by the least label string; None if no path is accepted."""
    arcs = [dict(a) for a in grammar.arcs]
    written = [next(((s, t) for s, t in a.items() if s in dict(edits.roles)), None) for a in arcs]

    def steps(row: tuple[str, int], state: int) -> list[tuple[int, str, int]]:
        """Edits of a row: (cost, label, next state)."""
        initial, fault = row
        out = [(edits.delete, "D", state)]
        if fault in (BLANK, DUPLICATE):
            return out
        extra = edits.truncated if fault == TRUNCATED else 0
        if initial in arcs[state]:
            out.append((extra, "K", arcs[state][initial]))
        if written[state]:
            out.append((edits.rerole + extra, "R", written[state][1]))
        return out

    def closed(states: set[int]) -> set[int]:
        """With the states that insertions lead to."""
        todo = list(states)
        while todo:
            to = written[todo.pop()]
            if to and to[1] not in states:
                states.add(to[1])
                todo.append(to[1])
        return states

    reached = [closed({grammar.start})]
    for row in rows:
        reached.append(closed({to for state in reached[-1] for _, _, to in steps(row, state)}))

    policy: list[dict[int, tuple[str, int]]] = []
    after: dict[int, int] = {}
    for i in range(len(rows), -1, -1):
        best: dict[int, tuple[int, str, int]] = {}
        for state in reached[i]:
            options = [(0, "", state)] if i == len(rows) and state in grammar.finals else []
            if i < len(rows):
                options = [(cost + after[to], label, to) for cost, label, to in steps(rows[i], state) if to in after]
            if options:
                best[state] = min(options)
        changed = True
        while changed:  # insertions stay at the row; each costs something, so this ends
            changed = False
            for state in reached[i]:
                to = written[state]
                if to and to[1] in best:
                    option = (edits.insert + best[to[1]][0], "I", to[1])
                    if state not in best or option < best[state]:
                        best[state], changed = option, True
        policy.append({s: (label, to) for s, (_, label, to) in best.items()})
        after = {s: cost for s, (cost, _, _) in best.items()}
    if grammar.start not in after:
        return None
    policy.reverse()
    labels, at, state = [], 0, grammar.start
    while True:
        label, to = policy[at][state]
        if not label:
            return after[grammar.start], "".join(labels)
        labels.append(label)
        at, state = at + (label != "I"), to


_shared = lru_cache(maxsize=1 << 16)(shortest_edits)


def repaired(rows: list[tuple[str, str]], labels: str, grammar: Grammar, edits: Edits) -> list[tuple[str, str]]:
    """The rows (role, text) that a label string makes."""
    out, at, state = [], 0, grammar.start
    for label in labels:
        role, text = rows[at] if label != "I" else ("", "")
        at += label != "I"
        if label == "D":
            continue
        if label != "K":
            role = next(name for initial, name in edits.roles if initial in dict(grammar.arcs[state]))
        state = dict(grammar.arcs[state])[role[:1]]
        out.append((role, text))
    return out


LEGAL = frozenset({"su", "ua", "au"})


def _examine(conv_id, rows: list[tuple], grammar: Grammar, edits: Edits) -> dict:
    """rows: (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault = BLANK if not bare else DUPLICATE if (role, text) in seen else TRUNCATED if bare[-1] not in ".!?" else SOUND
        seen.add((role, text))
        faults.append(fault)
    signature = tuple((role[:1], fault) for (_, role, _), fault in zip(rows, faults, strict=True))
    found = (_shared if len(rows) <= SHARED_ROWS else shortest_edits)(signature, grammar, edits)
    cost, labels = found or (None, None)
    return {
        "conv_id": conv_id,
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": faults.count(BLANK),
        "duplicate": faults.count(DUPLICATE),
        "truncated": faults.count(TRUNCATED),
        "illegal": sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:])),  # noqa: B905, RUF007
        "cost": cost,
        "audit": labels,
        "repaired": [{"role": r, "text": t} for r, t in repaired([(r, t) for _, r, t in rows], labels or "", grammar, edits)],
    }


def _stream(schema: pa.Schema, grammar: Grammar, edits: Edits, most: int = 4 << 20):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        held: list[tuple] = []
        present: tuple | None = None
        for frame in frames:
            columns = [frame.column(frame.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "present", "turn", "role", "text")]
            for conv_id, there, turn, role, text in zip(*columns, strict=True):
                if present != (conv_id,):
                    if present is not None:
                        out.append(_examine(present[0], held, grammar, edits))
                    present, held = (conv_id,), []
                if there:
                    held.append((turn, role, text))
                    size += len(text) + 64
            if size > most:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if present is not None:
            out.append(_examine(present[0], held, grammar, edits))
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repair_conversations(rows: DataFrame, grammar: Grammar = ROLES, edits: Edits | None = None) -> DataFrame:
    """Returns for each conversation ``conv_id``, the counts ``gaps, blank,
    duplicate, truncated, illegal`` of its rows, the ``cost`` and ``audit`` of
    the cheapest repair and the ``repaired`` rows, an array of (role, text).

    ``rows``: (conv_id, turn, role, text) and, if there is one, a boolean
    ``present``; a row that isn't present only names its conversation.  Rows
    are taken by turn, nulls first, ties by role and then text, so repeated
    rows stand side by side.  Null roles and texts count as one space.

    A conversation without rows present has zeros and no repaired row; null
    conv_ids are one conversation; texts may have any length; an empty table
    gives an empty one; other columns are ignored.  A grammar that accepts no
    edit of a conversation leaves its cost and audit null.
    """
    there = F.coalesce(F.col("present"), F.lit(False)) if "present" in rows.columns else F.lit(True)
    own = rows.select("conv_id", there.alias("present"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    kind = own.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    fields = ", ".join(f"{c} long" for c in counts)
    return ordered.mapInArrow(_stream(schema, grammar, edits or Edits()), f"conv_id {kind.simpleString()}, {fields}, audit string, repaired array<struct<role:string,text:string>>")
