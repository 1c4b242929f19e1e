"""Chat formatting by minimum-cost role repair.

A legal conversation is: at most one leading system turn, then user and assistant in alternation, ending with the
assistant. Dynamic programming over that automaton gives every input turn a role and an action of least total cost:

* keep it as a new turn (0), relabel it (2), merge it into the open turn of the same role (1),
* insert an empty turn where the automaton needs one in between or at the end (3 each).

Cost to go is computed backwards; forwards, among equal totals the turn's own role is preferred, then user,
assistant, system: the repair does not depend on how rows are partitioned.

Scale: turns are range-partitioned and sorted by (conversation, turn), so one conversation may span any number of
partitions. A segment of a conversation acts on cost to go as a 4x4 min-plus matrix; only the first and the last
conversation of each partition are carried over its edge (at most two small rows a partition reach the driver).

Defined results: null or unknown role: it has to be relabelled; null text: empty; rows with equal (conversation,
turn): ordered by a hash of role and text; null turn: first; null conversation id: one conversation of its own; empty table: no
rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.session import partitions, staged

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
#: States: 0 before the first turn, else 1 + index of the open turn's role.
STATES = 4
#: NEEDS[state][role]: roles of the empty turns between a state and a new turn of that role; None: unreachable.
NEEDS = (
    ((), (), (1,)),
    (None, (), (1,)),
    (None, (2,), ()),
    (None, (), (1,)),
)
#: Empty turns that close a conversation.
CLOSING = ((1, 2), (1, 2), (2,), ())
END = np.array([INSERT * len(x) for x in CLOSING])
ROWS_PER_PARTITION = 50_000
SCHEMA = "conv_id long, turn long, ord long, role_in string, role_out string, action string, n_inserted int, cost double, fragment string"


def step_costs(role: int) -> np.ndarray:
    """[state, next state] for a turn of this role (-1: unknown)."""
    costs = np.full((STATES, STATES), np.inf)
    for state in range(STATES):
        for label in range(3):
            price = 0.0 if label == role else RELABEL
            if state == label + 1:
                costs[state, label + 1] = price + MERGE
            elif NEEDS[state][label] is not None:
                costs[state, label + 1] = price + INSERT * len(NEEDS[state][label])
    return costs


COSTS = {role: step_costs(role) for role in (-1, 0, 1, 2)}
PREFERENCE = {role: sorted(range(3), key=lambda q: (q != role, (1, 2, 0).index(q))) for role in (-1, 0, 1, 2)}


def matrix(roles: np.ndarray) -> np.ndarray:
    """Min-plus product of the turns' matrices."""
    out = np.where(np.eye(STATES, dtype=bool), 0.0, np.inf)
    for role in roles[::-1]:
        out = (COSTS[role][:, :, None] + out[None, :, :]).min(axis=1)
    return out


def to_go(roles: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Cost to go before each turn and after the last."""
    values = [after]
    for role in roles[::-1]:
        values.append((COSTS[role] + values[-1][None, :]).min(axis=1))
    return values[::-1]


def walk(roles: np.ndarray, values: list[np.ndarray], state: int) -> list[int]:
    """States after each turn on the preferred cheapest path."""
    path = []
    for role, after in zip(roles, values[1:]):
        best = min(COSTS[role][state, q + 1] + after[q + 1] for q in range(3))
        state = next(q + 1 for q in PREFERENCE[role] if COSTS[role][state, q + 1] + after[q + 1] == best)
        path.append(state)
    return path


def opened(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSE = "<|end|>\n"


def rendered(state: int, label: int, text: str, last: bool) -> tuple[str, int]:
    """The turn's part of the rendered conversation, and how many empty turns it holds."""
    if state == label + 1:
        out, empty = "\n\n" + text, ()
    else:
        empty = NEEDS[state][label]
        out = (CLOSE if state else "") + "".join(opened(r) + CLOSE for r in empty) + opened(label) + text
    if last:
        out += CLOSE + "".join(opened(r) + CLOSE for r in CLOSING[label + 1])
        empty = (*empty, *CLOSING[label + 1])
    return out, len(empty)


def segments(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[tuple[int, int]]]:
    """Rows in order, their role numbers, and the (begin, end) of each conversation's part."""
    rows = rows.sort_values("ord", kind="stable").reset_index(drop=True)
    roles = rows["role"].map({r: i for i, r in enumerate(ROLES)}).fillna(-1).astype(int).to_numpy()
    conv = rows["conv_id"].astype("Int64")
    new = (conv != conv.shift()).fillna(True).to_numpy(bool) & ~(conv.isna() & conv.shift().isna() & (np.arange(len(rows)) > 0)).to_numpy(bool)
    edges = [*np.flatnonzero(new), len(rows)]
    return rows, roles, list(zip(edges[:-1], edges[1:]))


def edge_matrices(rows: pd.DataFrame) -> pd.DataFrame:
    rows, roles, parts = segments(rows)
    keep = sorted({0, len(parts) - 1})
    return pd.DataFrame([(int(rows["pid"][0]), k, None if pd.isna(rows["conv_id"][parts[k][0]]) else int(rows["conv_id"][parts[k][0]]), matrix(roles[slice(*parts[k])]).ravel().tolist()) for k in keep], columns=["pid", "seg", "conv_id", "costs"]).astype({"conv_id": "Int64"})


def repair(conversations: DataFrame) -> DataFrame:
    """One row per input turn of (conv_id, turn, role, text); its fragments in the order of ord are the rendered text."""
    spark = conversations.sparkSession
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("role_in"))
    n = max(partitions(spark), math.ceil(conversations.count() / ROWS_PER_PARTITION))
    # Ties are told apart by a hash, so that the bounds of the ranges that Spark samples hold no texts.
    turns = turns.withColumn("tie", F.xxhash64("role_in", "text"))
    order = ["conv_id", "turn", "tie"]
    dealt = staged(turns.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("ord", 33)))

    edges: dict[int, list] = {}
    for r in dealt.select("pid", "ord", "conv_id", "role").groupBy("pid").applyInPandas(edge_matrices, "pid long, seg int, conv_id long, costs array<double>").collect():  # two a partition
        edges.setdefault(r.pid, []).append(r)
    chain = [(r.pid, r.seg, r.conv_id, np.array(r.costs).reshape(STATES, STATES)) for pid in sorted(edges) for r in sorted(edges[pid], key=lambda r: r.seg)]
    after: dict[tuple[int, int], np.ndarray] = {}
    value = END
    for k in range(len(chain) - 1, -1, -1):
        pid, seg, conv, costs = chain[k]
        goes_on = k + 1 < len(chain) and chain[k + 1][2] == conv and chain[k + 1][0] != pid
        value = value if goes_on else END
        after[pid, seg] = value
        value = (costs + value[None, :]).min(axis=1)

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        rows, roles, parts = segments(rows)
        pid, out = int(rows["pid"][0]), []
        for k in sorted({0, len(parts) - 1}):
            own = roles[slice(*parts[k])]
            values = to_go(own, after[pid, k])
            out.append((pid, k, [walk(own, values, s)[-1] for s in range(STATES)]))
        return pd.DataFrame(out, columns=["pid", "seg", "exits"])

    linked = [k for k in range(1, len(chain)) if chain[k][2] == chain[k - 1][2] and chain[k][0] != chain[k - 1][0]]
    entry: dict[tuple[int, int], int] = {}
    if linked:
        pids = sorted({chain[k + d][0] for k in linked for d in (-1, 0)})
        maps = {(r.pid, r.seg): r.exits for r in dealt.select("pid", "ord", "conv_id", "role").filter(F.col("pid").isin(pids)).groupBy("pid").applyInPandas(exits, "pid long, seg int, exits array<int>").collect()}
        for k in linked:
            before = chain[k - 1][:2]
            entry[chain[k][:2]] = maps[before][entry.get(before, 0)]

    def repaired(rows: pd.DataFrame) -> pd.DataFrame:
        rows, roles, parts = segments(rows)
        pid, out = int(rows["pid"][0]), []
        texts, turns, ords, given = (rows[c].tolist() for c in ("text", "turn", "ord", "role_in"))
        goes_on = {(chain[k - 1][:2]) for k in linked}
        for k, (begin, end) in enumerate(parts):
            own = roles[begin:end]
            state = entry.get((pid, k), 0)
            conv = rows["conv_id"][begin]
            path = walk(own, to_go(own, after.get((pid, k), END)), state)
            for i, now in zip(range(begin, end), path):
                label = now - 1
                last = i == end - 1 and (pid, k) not in goes_on
                text, n_inserted = rendered(state, label, texts[i], last)
                changed, merged = bool(label != roles[i]), bool(state == now)
                action = "+".join(["relabel"] * changed + ["merge"] * merged) or "keep"
                cost = RELABEL * changed + MERGE * merged + INSERT * n_inserted
                out.append((None if pd.isna(conv) else int(conv), turns[i], ords[i], given[i], ROLES[label], action, n_inserted, cost, text))
                state = now
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"conv_id": "Int64", "turn": "Int64"})

    return dealt.groupBy("pid").applyInPandas(repaired, SCHEMA)


def rendered_conversations(repaired: DataFrame) -> DataFrame:
    """(conv_id, n_turns, cost, rendered): for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "fragment")))
    return repaired.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda x: x.fragment), "").alias("rendered"))
