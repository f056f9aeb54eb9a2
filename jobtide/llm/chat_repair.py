"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with
the assistant. Dynamic programming over the states of that automaton finds the cheapest
repair: a turn may keep its role, take another one (``RELABEL``, or ``UNKNOWN`` if its role is not one of the three), be merged into the turn before it (``MERGE``, and the cost of
relabelling if the roles differ), and empty turns may be inserted before it or at the end (``INSERT``
each). Of equally cheap repairs the one with the smaller earlier state, looking back from the
end, is taken; a merge goes before an insertion.

Costs of a run of turns from any state to any state are a small matrix, and runs are joined by
adding and taking minima. A conversation of more than ``block`` turns is therefore
cut into blocks: their matrices, one row for each block, give the state that each block starts and ends
with, and all blocks are repaired in parallel. Rows are put in order by ranges, so a
conversation with a third of all rows lies in many tasks.

Defined cases: a null or blank role is unknown, roles ignore case and surrounding blanks; a null or empty text
is an empty turn and stays; turns are ordered by turn (null first), then role and text, so
repeated rows follow each other and are merged; rows with a null conversation id form one conversation; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.common import store

ROLES = ["start", "system", "user", "assistant"]
MERGE, INSERT, RELABEL, UNKNOWN = 1, 2, 3, 1
NEVER = 10**9
#: Empty turns to insert between a state and a turn; a system turn can only come first.
GAP = {(0, 1): [], (0, 2): [], (0, 3): [2], (1, 2): [], (1, 3): [2], (2, 3): [], (2, 2): [3], (3, 2): [], (3, 3): [2]}
#: Empty turns that complete a conversation.
FINISH = {0: [], 1: [2, 3], 2: [3], 3: []}


def moves(role: int) -> dict[tuple[int, int], tuple[int, str]]:
    """``(state, next state)``: cost and action of a turn with this role (0: unknown)."""
    out = {}
    for after in (1, 2, 3):
        relabel = 0 if role == after else RELABEL if role else UNKNOWN
        for before in range(4):
            best = None
            if (before, after) in GAP:
                best = (relabel + INSERT * len(GAP[before, after]), "relabel" if relabel else "keep")
            if before == after and (best is None or MERGE + relabel <= best[0]):
                best = (MERGE + relabel, "merge")
            if best:
                out[before, after] = best
    return out


MOVES = [moves(role) for role in range(4)]


def forward(roles: list[int], costs: list[int]) -> list[list[int]]:
    """Least cost of each state after each turn, from the costs before the first."""
    out = [costs]
    for role in roles:
        now = [NEVER] * 4
        for (a, b), (cost, _) in MOVES[role].items():
            now[b] = min(now[b], costs[a] + cost)
        costs = now
        out.append(now)
    return out


def repair(roles: list[int], start: int = 0, end: int | None = None) -> list[tuple[int, str, list[int]]]:
    """New role, action and inserted roles of each turn; ``end`` None: the conversation ends here."""
    table = forward(roles, [0 if s == start else NEVER for s in range(4)])
    if end is None:
        end = min(range(4), key=lambda s: (table[-1][s] + INSERT * len(FINISH[s]), s))
    state, back = end, []
    for t in range(len(roles) - 1, -1, -1):
        before = min((a for a, b in MOVES[roles[t]] if b == state), key=lambda a: (table[t][a] + MOVES[roles[t]][a, state][0], a))
        action = MOVES[roles[t]][before, state][1]
        back.append((state, action, [] if action == "merge" else GAP[before, state]))
        state = before
    return back[::-1]


def number(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else 0


def join_blocks(matrices: list[list[list[int]]]) -> list[tuple[int, int]]:
    """State before and after each block of a conversation, from the blocks' cost matrices."""
    costs = [[0, NEVER, NEVER, NEVER]]
    for m in matrices:
        costs.append([min(costs[-1][a] + m[a][b] for a in range(4)) for b in range(4)])
    state = min(range(4), key=lambda s: (costs[-1][s] + INSERT * len(FINISH[s]), s))
    out = []
    for t in range(len(matrices) - 1, -1, -1):
        before = min(range(4), key=lambda a: (costs[t][a] + matrices[t][a][state], a))
        out.append((before, state))
        state = before
    return out[::-1]


def header(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


def placed(turns: DataFrame, conv: str, turn: str, role: str, text: str, block: int) -> DataFrame:
    """The turns with their place in the conversation, and the block and work group they belong to."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
                        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("conv"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = store(rows.repartitionByRange(parts, "conv", "turn", "role", F.xxhash64("text")).sortWithinPartitions(
        "conv", "turn", "role", F.xxhash64("text"), "text").withColumn("part", F.spark_partition_id()).withColumn(
        "pos", F.monotonically_increasing_id()), "chat-order")
    counts = sorted_.groupBy("part", "conv").count()
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "conv", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset"),
                            F.sum("count").over(Window.partitionBy("conv")).alias("turns"))
    nth = F.row_number().over(Window.partitionBy("part", "conv").orderBy("pos")) - 1
    at = (F.col("offset") + F.col("nth")).alias("at")
    numbered = sorted_.withColumn("nth", nth).join(offsets, ["part", "conv"]).select("conv_id", "conv", "turn", "role", "text", at, "turns")
    groups = max(1, -(-sorted_.count() // block))
    unit = F.floor(F.col("at") / block)
    return numbered.withColumn("unit", unit).withColumn("work", F.pmod(F.xxhash64("conv", "unit"), F.lit(groups)))


def block_states(rows: DataFrame) -> DataFrame:
    """``(conv, unit, before, after)`` for the blocks of conversations of several blocks."""
    def matrix(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (conv, unit), part in frame.groupby(["conv", "unit"], sort=False):
            roles = [number(r) for r in part.sort_values("at")["role"]]
            costs = [forward(roles, [0 if s == a else NEVER for s in range(4)])[-1] for a in range(4)]
            out.append((conv, unit, [min(c, NEVER) for line in costs for c in line]))
        return pd.DataFrame(out, columns=["conv", "unit", "costs"])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("unit")
        states = join_blocks([[list(c[4 * a : 4 * a + 4]) for a in range(4)] for c in frame["costs"]])
        return pd.DataFrame({"conv": frame["conv"].values, "unit": frame["unit"].values,
                             "before": [a for a, _ in states], "after": [b for _, b in states]})

    costs = rows.select("conv", "unit", "at", "role", "work").groupBy("work").applyInPandas(
        matrix, "conv string, unit long, costs array<long>")
    return costs.groupBy("conv").applyInPandas(joined, "conv string, unit long, before int, after int")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 block: int = 4096) -> DataFrame:
    """``(conv_id, at, turn, role, new_role, action, inserted, cost, rendered)`` for each row.

    ``at`` is the row's place in its conversation. ``action`` is keep, relabel or merge; ``inserted``
    lists the empty turns put before the row, and those after it if it is the last. The
    ``rendered`` texts of a conversation, in order of ``at``, make up the repaired conversation.
    """
    rows = store(placed(turns, conv, turn, role, text, block), "chat-turns")
    long_ = rows.where(F.col("turns") > block)
    states = block_states(long_)
    kinds = dict(rows.dtypes)

    def repaired(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["conv", "unit", "at"]).reset_index(drop=True)
        out = []
        for _, part in frame.groupby(["conv", "unit"], sort=False):
            roles = [number(r) for r in part["role"]]
            first, final = part["before"].iloc[0], part["after"].iloc[0]
            many = not pd.isna(first)
            steps = repair(roles, int(first) if many else 0, int(final) if many else None)
            ends = part["at"].iloc[-1] + 1 == part["turns"].iloc[-1]
            for n, ((new, action, gap), was, body) in enumerate(zip(steps, roles, part["text"])):
                tail = FINISH[new] if ends and n + 1 == len(steps) else []
                cost = INSERT * (len(gap) + len(tail)) + MERGE * (action == "merge") + (0 if was == new else RELABEL if was else UNKNOWN)
                shown = "".join(header(g) + "\n" for g in gap) + ("" if action == "merge" else header(new))
                shown += (body or "") + "\n" + "".join(header(g) + "\n" for g in tail)
                out.append((ROLES[new], action, [ROLES[g] for g in [*gap, *tail]], cost, shown))
        done = pd.DataFrame(out, columns=["new_role", "action", "inserted", "cost", "rendered"])
        return pd.concat([frame[["conv_id", "at", "turn", "role"]], done], axis=1)

    # Ids travel as text: pandas would turn long ids with nulls into floating point.
    schema = ("conv_id string, at long, turn string, role string, new_role string, action string, "
              "inserted array<string>, cost long, rendered string")
    known = rows.join(states, ["conv", "unit"], "left").withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    return known.groupBy("work").applyInPandas(repaired, schema).withColumns({c: F.col(c).cast(kinds[c]) for c in ("conv_id", "turn")})
