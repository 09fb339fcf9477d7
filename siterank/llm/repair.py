"""Conversation structure repair by iterative-deepening A*.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turns, ending with the assistant.
Edits are judged by a price list:

=========  ====  ==========================================================
edit       cost  effect
=========  ====  ==========================================================
``D``      2     delete the row (the only edit for a blank or repeated row)
``I``      5     insert an empty user or assistant row, anywhere
``K``      0     keep the row as it is
``R``      1     give the row the role user or assistant
=========  ====  ==========================================================

and a truncated row that stays (``K`` or ``R``) adds 5.  The cheapest edit string is
searched by IDA*: a depth-first search that tries the edits in ASCII order
``D < I < K < R`` under a cost bound, which grows to the smallest cost that went
beyond it until a path accepts.  A table keeps for every failed state (row, grammar
state) the least cost it still needs, so a state is not searched again with a cost
that failed before, and the bound of the next round starts from what was learned.
The first accepting path of the last round is the cheapest, and among the cheapest
the least in ASCII order, since a path is tried before its extensions and the edits
in ASCII order.

Conversations are the unit of work: rows are hashed to tasks by conversation and
sorted there, and a task streams through its conversations one at a time, with memory
in proportion to the rows of one conversation.

Fixed values of the contract: damage codes by ``crc32('conv_id:turn') % 20`` (0 drops,
1 empties the text, 2 removes ``.!?``, 3 repeats the row, 4 sets the role user), white
space ``\\x20\\x09-\\x0D``, sentence ends ``.!?``, legal adjacent initials su, ua, au.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
LEGAL = {"su", "ua", "au"}
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
ENDS = ".!?"

# Grammar states: nothing yet (accepting), after the system turn, after user, after assistant (accepting).
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
ACCEPTING = (START, ASSISTANT)
#: The state after a user or assistant row that the grammar wants next.
WANTED = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: What keeping a row with this initial does in each state.
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}

SCHEMA = (
    "conv_id long, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with ``_gone`` for dropped ones (their conversation still counts).

    The damage of a row is ``crc32('conv_id:turn') % 20`` with a null part written as one
    space.  Only ``conv_id, turn, role, text`` are read; other columns are left out.
    """
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), F.lit(" ")),
    )
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    ).withColumn("_damage", F.pmod(F.crc32(key.cast("binary")), F.lit(20)))
    d = F.col("_damage")
    return rows.select(
        "conv_id",
        "turn",
        F.when(d == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (d == 0).alias("_gone"),
        F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )


def initial(role: str | None) -> str:
    return role[:1] if role else ""


def faults(roles: list, texts: list) -> list[str | None]:
    """The first fault of every row: blank, duplicate, truncated or None."""
    seen, found = set(), []
    for role, text in zip(roles, texts):
        visible = [m.group() for m in VISIBLE.finditer(text)] if text is not None else []
        if not visible:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        elif visible[-1] not in ENDS:
            found.append("truncated")
        else:
            found.append(None)
        seen.add((role, text))
    return found


def edits(initials: list[str], must_go: list[bool], truncated: list[bool], i: int, state: int):
    """The edits out of (row i, state) in ASCII order: (letter, cost, next row, next state, role)."""
    n = len(initials)
    out = []
    if i < n:
        out.append(("D", DELETE, i + 1, state, None))
    nxt, role = WANTED[state]
    out.append(("I", INSERT, i, nxt, role))
    if i < n and not must_go[i]:
        extra = TRUNCATED if truncated[i] else 0
        kept = KEPT.get((initials[i], state))
        if kept is not None:
            out.append(("K", KEEP + extra, i + 1, kept, ""))
        out.append(("R", REROLE + extra, i + 1, nxt, role))
    return out


def search(initials: list[str], must_go: list[bool], truncated: list[bool]) -> tuple[int, list[tuple[str, str | None]]]:
    """IDA*: the cheapest edits, least in ASCII order among those; (cost, [(letter, role)]).

    A role of ``""`` keeps the row's own role, None deletes it.
    """
    n = len(initials)
    # Admissible start: the least any edit of a row can cost.  A row that must go costs
    # 2, a truncated one 2 at least (deleted, or kept for 5), one without a role the
    # grammar knows 1 at least (reroled or deleted).  Without a row left to keep, an
    # unfinished state needs one or two inserts.
    least_after, free_after = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        if must_go[i] or truncated[i]:
            least = DELETE
        else:
            least = 0 if initials[i] in ("s", "u", "a") else min(DELETE, REROLE)
        least_after[i] = least_after[i + 1] + least
        free_after[i] = free_after[i + 1] + (not must_go[i])
    finish = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
    learned: dict[tuple[int, int], int] = {}

    def estimate(i: int, state: int) -> int:
        static = least_after[i] + (finish[state] if free_after[i] == 0 else 0)
        return max(static, learned.get((i, state), 0))

    bound = estimate(0, START)
    while True:
        # Frames: row, state, cost so far, edits of the state, next edit, least f beyond the bound.
        stack = [[0, START, 0, None, 0, None]]
        path: list[tuple[str, str | None]] = []
        beyond = None
        while stack:
            frame = stack[-1]
            i, state, g, out, k, least = frame
            if out is None:
                f = g + estimate(i, state)
                if f > bound or (i == n and state in ACCEPTING):
                    stack.pop()
                    if f <= bound:
                        return g, path
                    if stack:
                        path.pop()
                        parent = stack[-1]
                        parent[5] = f if parent[5] is None else min(parent[5], f)
                    beyond = f
                    continue
                out = frame[3] = edits(initials, must_go, truncated, i, state)
            if k < len(out):
                frame[4] = k + 1
                letter, cost, ni, ns, role = out[k]
                path.append((letter, role))
                stack.append([ni, ns, g + cost, None, 0, None])
                continue
            # Every edit failed: remember what this state needs at least.
            stack.pop()
            if least is not None:
                learned[(i, state)] = max(learned.get((i, state), 0), least - g)
            if stack:
                path.pop()
                parent = stack[-1]
                if least is not None:
                    parent[5] = least if parent[5] is None else min(parent[5], least)
            beyond = least
        bound = beyond


def repair_one(conv_id, rows: list[tuple]) -> dict:
    """One conversation's row of the result from its rows after damage, in order."""
    turns = [t for t, _, _ in rows if t is not None]
    roles = [r for _, r, _ in rows]
    texts = [t for _, _, t in rows]
    found = faults(roles, texts)
    initials = [initial(r) for r in roles]
    illegal = sum(1 for a, b in zip(initials, initials[1:]) if a + b not in LEGAL)
    cost, path = search(initials, [f in ("blank", "duplicate") for f in found], [f == "truncated" for f in found])
    repaired, i = [], 0
    for letter, role in path:
        if letter == "I":
            repaired.append(f"{role}:")
            continue
        if letter != "D":
            repaired.append(f"{role or roles[i]}:{texts[i]}")
        i += 1
    return {
        "conv_id": conv_id,
        "rows": len(rows),
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": found.count("blank"),
        "duplicate": found.count("duplicate"),
        "truncated": found.count("truncated"),
        "illegal": illegal,
        "cost": cost,
        "audit": "".join(letter for letter, _ in path),
        "repaired_sha256": hashlib.sha256("\n".join(repaired).encode("utf-8")).hexdigest(),
    }


def _value(x):
    """None for a missing value of any kind, else the value."""
    return None if x is None or (isinstance(x, float) and x != x) or x is pd.NA else x


def repair_stream(frames):
    """Rows sorted by conversation, then turn, role and text (nulls first), to results.

    A conversation may go on from one batch to the next; it is held until its last row.
    """
    key, held, started = None, [], False
    for frame in frames:
        out = []
        columns = [frame[c].tolist() for c in ("conv_id", "turn", "role", "text", "_gone")]
        for conv_id, turn, role, text, gone in zip(*columns):
            conv_id = _value(conv_id)
            conv_id = None if conv_id is None else int(conv_id)
            if started and conv_id != key:
                out.append(repair_one(key, held))
                held = []
            key, started = conv_id, True
            if not gone:
                turn = _value(turn)
                held.append((None if turn is None else int(turn), _value(role), _value(text)))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS).astype({"conv_id": "Int64"})
    if started:
        yield pd.DataFrame([repair_one(key, held)], columns=COLUMNS).astype({"conv_id": "Int64"})


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation id of the input (null is one conversation).

    Rows are ordered by turn, nulls first, then role and text (nulls first); equal rows
    are interchangeable.  Faults are taken on the rows after damage: a blank row has no
    character outside ASCII white space (null text is blank), a duplicate has role and
    text of an earlier row (nulls equal), a truncated one ends in anything but ``.!?``.
    Only a row's first fault counts.  A role's initial is its first character; a null
    or empty role has none, so it is never legal next to another and must be reroled or
    deleted.  ``gaps`` counts missing turns between the least and largest non-null turn,
    0 without any.  ``cost`` and ``audit`` are those of the search; ``repaired_sha256``
    is the SHA-256 of ``role:text`` of the repaired rows joined by newlines (inserted
    rows have empty text), of the empty string when no row stays.  Extra input columns
    are not read.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    damaged = damage(conversations).repartition("conv_id").sortWithinPartitions(*order)
    return damaged.mapInPandas(repair_stream, SCHEMA)
