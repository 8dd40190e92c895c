"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn. A message
may keep its role, take another, be merged into the turn before it, or have an empty turn
put in before it; dynamic programming over the automaton finds the cheapest repair, which
is then rendered.

The cost of a chunk of messages from each state to each is a small matrix, and matrices
multiply. So a long conversation is cut into chunks by turn: their matrices, combined in
order, give the state in which each chunk begins, and chunks are then repaired apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
START = 3
#: Legal next turns of each state; a state is the role of the last turn, or START.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
#: What each repair costs, and turns in a chunk.
RELABEL, MERGE, INSERT, CHUNK = 1.0, 0.6, 0.8, 1024
NAMES = ("keep", "merge", "insert")


def moves(role: int | None) -> list[tuple[int, int, float, int, int]]:
    """(state, new state, cost, how, inserted role) for a message of a role (None: unknown), best first among equals."""
    out = []
    for new in range(3):
        cost = 0.0 if new == role else RELABEL
        for state in range(4):
            if new in NEXT[state]:
                out.append((state, new, cost, 0, -1))
            if new == state:
                out.append((state, new, cost + MERGE, 1, -1))
            for between in NEXT[state]:
                if new in NEXT[between]:
                    out.append((state, new, cost + INSERT, 2, between))
    return sorted(out, key=lambda m: (m[2], m[3], m[1], m[4]))


MOVES = {r: moves(r) for r in (0, 1, 2, None)}


def _role(name) -> int | None:
    return ROLES.index(name) if name in ROLES else None


def chunk_costs(roles: list[int | None]) -> np.ndarray:
    """Least cost from each state to each over the messages."""
    at = np.full((4, 4), np.inf)
    np.fill_diagonal(at, 0)
    for r in roles:
        new = np.full((4, 4), np.inf)
        for state, to, cost, _, _ in MOVES[r]:
            new[:, to] = np.minimum(new[:, to], at[:, state] + cost)
        at = new
    return at


def repair(roles: Sequence[int | None], begin: int, end: int | None) -> list[tuple[int, int, int]]:
    """(role, how, inserted role) for each message on the cheapest way from begin to end (None: any)."""
    cost = [np.inf] * 4
    cost[begin] = 0.0
    back = []
    for r in roles:
        new, came = [np.inf] * 4, [None] * 4
        for m in MOVES[r]:
            if cost[m[0]] + m[2] < new[m[1]]:
                new[m[1]], came[m[1]] = cost[m[0]] + m[2], m
        cost = new
        back.append(came)
    state = end if end is not None else int(np.argmin(cost))
    out = []
    for came in reversed(back):
        m = came[state]
        out.append((m[1], m[3], m[4]))
        state = m[0]
    return out[::-1]


#: Conversations of few messages have few sequences of roles, so their repairs are remembered.
SHORT = 16
_remembered = lru_cache(maxsize=1 << 15)(lambda roles: repair(roles, START, None))


def _open(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


CLOSE = "<|im_end|>\n"
#: Rows and characters after which a worker hands on what it has rendered.
ROWS, SIZE = 20_000, 8_000_000


def _same(a, b) -> bool:
    """Whether two keys are equal; nulls are, and so are NaNs."""
    return a == b or (a != a and b != b)


def _rendered(messages: list[tuple], edge: tuple | None):
    """The output rows, less the conversation, of a chunk's (turn, role, text) messages in order.

    edge is (begin, end, final, seq) for a chunk of several, None for a whole conversation.
    """
    begin, end, final, seq = edge or (START, None, True, 0)
    roles = tuple(_role(m[1]) for m in messages)
    steps = _remembered(roles) if edge is None and len(roles) <= SHORT else repair(roles, begin, end)
    state, last = begin, len(steps) - 1
    for i, ((new, how, between), (turn, source, text)) in enumerate(zip(steps, messages, strict=True)):
        if how == 2:
            yield seq, turn, ROLES[between], None, "insert", INSERT, (CLOSE if state != START else "") + _open(between)
            seq, state = seq + 1, between
        own = roles[i] == new
        lead = "\n" if how == 1 else (CLOSE if state != START else "") + _open(new)
        action = NAMES[how if how == 1 else 0] + ("" if own else "+relabel")
        yield seq, turn, ROLES[new], source, action, (MERGE if how == 1 else 0.0) + (0.0 if own else RELABEL), lead + text + (CLOSE if final and i == last else "")
        seq, state = seq + 1, new


def repaired(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per message and per inserted turn: conv, seq, turn, role, source_role, action, cost, rendered.

    Messages are taken in order of turn (null first), then role and text. `rendered`, in
    order of seq (which may leave numbers out in long conversations), makes up the conversation: each piece closes the turn before it unless it
    is merged into it, and the last one closes its own. action is keep, merge or insert,
    with "+relabel" for a message that took another role; a role that is none of the three
    (null too) always does. Merged texts are set apart by a line feed. Null texts are
    empty. Repeated rows are messages of their own. Rows with a null conversation make one
    conversation. Other columns are ignored; no rows give no rows.
    """
    turn = F.col(turn_col).cast("long")
    # Integers throughout: turns may be nanoseconds. No real part is as low as the one of null turns.
    part = F.expr(f"cast(`{turn_col.replace('`', '``')}` as bigint) div {chunk}") - F.when((turn < 0) & (turn % chunk != 0), 1).otherwise(0)
    rows = conversations.select(F.col(conv_col).alias("conv"), turn.alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(part, F.lit(-(1 << 63))).alias("part"))
    kind = conversations.schema[conv_col].dataType.simpleString()
    order = ["turn", "role", "text"]

    # Where chunks begin and end, for conversations of several.
    spread = rows.groupBy("conv").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last").select("conv")
    several = rows.join(spread, rows["conv"].eqNullSafe(spread["conv"]), "left_semi")

    def costs(key, frame: pd.DataFrame) -> pd.DataFrame:
        roles = frame.sort_values(["turn", "role"], na_position="first")["role"]
        return pd.DataFrame({"conv": frame["conv"].iloc[:1], "part": frame["part"].iloc[:1], "messages": [len(roles)], "costs": [chunk_costs([_role(r) for r in roles]).ravel().tolist()]})

    def states(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        at, ways = np.array([np.inf, np.inf, np.inf, 0.0]), []
        for m in frame["costs"]:
            way = at[:, None] + np.array(m).reshape(4, 4)
            ways.append(way.argmin(0))
            at = way.min(0)
        ends = [int(at.argmin())]
        for way in reversed(ways):
            ends.append(int(way[ends[-1]]))
        ends = ends[::-1]
        before = 2 * (frame["messages"].cumsum() - frame["messages"])  # each message makes two rows at most
        return pd.DataFrame({"conv": frame["conv"], "part": frame["part"], "begin": ends[:-1], "end": ends[1:], "final": [False] * (len(frame) - 1) + [True], "seq": before})

    # Texts only order messages of equal turn and role, which costs do not tell apart.
    matrices = several.select("conv", "part", "turn", "role").groupBy("conv", "part").applyInPandas(costs, f"conv {kind}, part long, messages long, costs array<double>")
    edges = matrices.groupBy("conv").applyInPandas(states, f"conv {kind}, part long, begin int, end int, final boolean, seq long")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("begin", "int"), ("end", "int"), ("final", "boolean"), ("seq", "long"))]
    heads = edges.select("conv", "part", F.lit(0).alias("after"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))], "begin", "end", "final", "seq")
    # One exchange: where a chunk begins and ends comes in as a row before its messages.
    dealt = rows.select("conv", "part", F.lit(1).alias("after"), *order, *nothing).union(heads).repartition("conv", "part").sortWithinPartitions("conv", "part", "after", *order)

    def mend(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
        names = ["conv", "seq", "turn", "role", "source_role", "action", "cost", "rendered"]
        convs, out, size, conv_type = [], [], 0, None
        conv, part, edge, held = None, None, None, []

        def close():
            nonlocal size
            for row in _rendered(held, edge):
                convs.append(conv)
                out.append(row)
                size += len(row[-1])

        def handed():
            nonlocal convs, out, size
            cols = list(zip(*out, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(convs, conv_type), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)
            convs, out, size = [], [], 0
            return batch

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for c, p, after, turn, role, text, begin, end, final, seq in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if part is None or p != part or not _same(c, conv):
                    if held:
                        close()
                        if len(out) > ROWS or size > SIZE:
                            yield handed()
                    conv, part, edge, held = c, p, None, []
                if after:
                    held.append((turn, role, text))
                else:
                    edge = begin, end, final, seq
        if held:
            close()
        if out:
            yield handed()

    out = dealt.mapInArrow(mend, f"conv {kind}, seq long, turn long, role string, source_role string, action string, cost double, rendered string")
    return out.withColumnRenamed("conv", conv_col)
