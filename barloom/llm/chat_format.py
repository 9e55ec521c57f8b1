"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in alternation, ending with the
assistant. Dynamic programming over this automaton chooses, at least cost, which turns to relabel, which
to merge with the turn before and where to insert empty turns. The repaired sequence is then rendered.

All turns are range-sorted by conversation and turn, and the sorted rows are cut into blocks of ``BLOCK_TURNS``.
A block's work is a small matrix, the least cost from each state before it to each state after it; the matrices
of a conversation are combined first, which fixes the states at the block borders, and then each block is
repaired by itself. So no task holds a conversation, however long and however its turns are numbered; the result
has a row per turn with its part of the rendering, in order, and ``rendered_conversations`` joins them.

Defined cases: roles are compared trimmed and in lower case; null or unknown roles are relabelled at a
lower cost; null texts are empty; turns with equal numbers are ordered by role and text, and turns without a
number come last; a null conv_id is a conversation of its own; ids keep their type. Turns that agree in
conversation, number, role and the first ``PREFIX`` code points of a longer text are sorted by one task. An empty
table gives an empty result. Only conv_id, turn, role and text are looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shuffle_width

ROLES = ("system", "user", "assistant")
START, AFTER = 0, {"system": 1, "user": 2, "assistant": 3}  # states: nothing yet, or after a turn of a role
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2.0, 0.5, 1.0, 1.5
BLOCK_TURNS, PREFIX, PART_CHARS = 1024, 256, 1 << 20
_INF = 1e18


def _steps() -> list[tuple[int, int, int, float, tuple[int, ...], bool]]:
    """(state, role, next state, cost, inserted roles, merged) for every legal step."""
    out = []
    for state in range(4):
        for role, name in enumerate(ROLES):
            after = AFTER[name]
            if state == after:
                out.append((state, role, after, MERGE, (), True))
                if name != "system":  # or keep it apart with the other role's empty turn between
                    out.append((state, role, after, INSERT, (3 - role,), False))
            elif name == "system":
                if state == START:
                    out.append((state, role, after, 0.0, (), False))
            elif name == "user" or state == AFTER["user"]:
                out.append((state, role, after, 0.0, (), False))
            else:
                out.append((state, role, after, INSERT, (1,), False))
    return out


STEPS = _steps()
#: What must be inserted at the end of a conversation in each state, and its cost.
ENDING: dict[int, tuple[tuple[int, ...], float]] = {0: ((), 0.0), 1: ((1, 2), 2 * INSERT), 2: ((2,), INSERT), 3: ((), 0.0)}


def known_role(role: object) -> int:
    name = role.strip().lower() if isinstance(role, str) else ""
    return ROLES.index(name) if name in ROLES else -1


def _label_cost(have: int, want: int) -> float:
    return 0.0 if have == want else RELABEL_UNKNOWN if have < 0 else RELABEL


def _step_matrices() -> dict[int, np.ndarray]:
    step = {}
    for have in (-1, 0, 1, 2):
        step[have] = np.full((4, 4), _INF)
        for state, role, after, c, _, _ in STEPS:
            step[have][state, after] = min(step[have][state, after], c + _label_cost(have, role))
    return step


STEP_COST = _step_matrices()


def block_matrix(roles: list[int]) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    cost = np.full((4, 4), _INF)
    np.fill_diagonal(cost, 0.0)
    for have in roles:
        cost = (cost[:, :, None] + STEP_COST[have][None]).min(1)
    return cost


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """The states before each block and after the last on a least-cost path; lower states win ties."""
    best = [np.array([0.0, _INF, _INF, _INF])]
    for m in matrices:
        best.append((best[-1][:, None] + m).min(0))
    end = best[-1] + np.array([ENDING[s][1] for s in range(4)])
    states = [int(end.argmin())]
    for m, before in zip(matrices[::-1], best[-2::-1], strict=True):
        states.append(int((before + m[:, states[-1]]).argmin()))
    return states[::-1]


def repair_turns(roles: list[int], entry: int, leave: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """For each turn its role, the roles inserted before it and whether it is merged, from state to state."""
    cost, back = np.full(4, _INF), []
    cost[entry] = 0.0
    for have in roles:
        now, how = np.full(4, _INF), [None] * 4
        for state, role, after, c, inserted, merged in STEPS:
            total = cost[state] + c + _label_cost(have, role)
            if total < now[after]:
                now[after], how[after] = total, (state, role, inserted, merged)
        cost = now
        back.append(how)
    out, state = [], leave
    for how in back[::-1]:
        state, role, inserted, merged = how[state]
        out.append((role, inserted, merged))
    return out[::-1]


def _opened(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSED = "\n<|end|>\n"


def escaped(text: str) -> str:
    """Texts can't open or close turns."""
    return text.replace("<|", "< |")


def _render(texts: list, repaired: list, first: bool, ending: tuple[int, ...] | None) -> list[str]:
    parts = []
    for i, (text, (role, inserted, merged)) in enumerate(zip(texts, repaired, strict=True)):
        if merged:
            head = "\n"
        else:
            head = ("" if first and i == 0 else CLOSED) + "".join(_opened(r) + CLOSED for r in inserted) + _opened(role)
        parts.append(head + escaped(text if isinstance(text, str) else ""))
    if ending is not None:
        parts[-1] += CLOSED + "".join(_opened(r) + CLOSED for r in ending)
    return parts


GROUP_TURNS = 8192


def _runs(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """Where each (key, block) of a sorted frame starts and stops."""
    key, block = pdf["key"].to_numpy(), pdf["block"].to_numpy()
    new = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
    edges = [0, *new.tolist(), len(pdf)]
    return list(zip(edges, edges[1:], strict=False))


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["key", "block", "position"], kind="stable", ignore_index=True)


def _sorted_turns(turns: DataFrame, block_turns: int) -> DataFrame:
    """The turns with key, position in the order of conversations and turns, and block; written in that order."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    rows = turns.select("conv_id", F.col("turn").cast("long"), F.col("role"), F.col("text"), key.alias("key"))
    # Equal turns are equal rows where the text is short, so chance may part them; only then.
    short = F.coalesce(F.length("text"), F.lit(0)) <= PREFIX
    rows = rows.withColumns({"start": F.substring("text", 1, PREFIX), "chance": F.when(short, F.rand(7)).otherwise(0.0)})
    order = [F.col("key"), *(F.col(c).asc_nulls_last() for c in ("turn", "role", "start"))]
    dealt = rows.repartitionByRange(shuffle_width(turns.sparkSession), *order, F.col("chance"))
    dealt = dealt.sortWithinPartitions(*order, F.col("text").asc_nulls_last(), F.col("chance")).drop("start", "chance")
    dealt = dealt.withColumn("position", F.monotonically_increasing_id())
    return dealt.withColumn("block", F.floor(F.col("position") / block_turns).cast("long"))


def repair_conversations(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row per turn: conv_id, turn, place in its block, role, new_role, action, inserted roles and rendered part.

    The parts of a conversation, in order of block and place, joined without separator, are its rendering.
    Blocks number the sorted rows of all conversations; a conversation's are in order but needn't start at 0.
    They are dealt by hash into groups of about ``GROUP_TURNS`` turns, so that a task's Python call has
    many short conversations or a few blocks of a long one.
    """
    keyed = materialize(_sorted_turns(turns, block_turns), "turns")
    id_type = turns.schema["conv_id"].dataType.simpleString()
    groups = max(1, -(-keyed.count() // GROUP_TURNS))

    def dealt(df: DataFrame, *by: str):
        return df.withColumn("group", F.pmod(F.xxhash64(*by), F.lit(groups))).groupBy("group")

    def matrices(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        roles = [known_role(r) for r in pdf["role"]]
        found = [(pdf["key"][a], pdf["block"][a], block_matrix(roles[a:b]).ravel().tolist()) for a, b in _runs(pdf)]
        return pd.DataFrame(found, columns=["key", "block", "costs"])

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "block"], ignore_index=True)
        rows, key, costs = [], pdf["key"].tolist(), pdf["costs"].tolist()
        edges = [i for i in range(len(key)) if i == 0 or key[i] != key[i - 1]] + [len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            states = border_states([np.array(c).reshape(4, 4) for c in costs[a:b]])
            rows += [(states[i], states[i + 1], i == b - a - 1) for i in range(b - a)]
        entry, leave, last = zip(*rows, strict=True)
        return pdf[["key", "block"]].assign(entry=entry, leave=leave, last=last)

    def repaired(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        roles, texts = [known_role(r) for r in pdf["role"]], pdf["text"].tolist()
        entry, leave, last = pdf["entry"].tolist(), pdf["leave"].tolist(), pdf["last"].tolist()
        steps, after, rendered, place = [], [], [], []
        for a, b in _runs(pdf):
            own = repair_turns(roles[a:b], entry[a], leave[a])
            ending = ENDING[leave[a]][0] if last[a] else None
            steps += own
            after += [[] for _ in range(b - a - 1)] + [[ROLES[r] for r in ending or ()]]
            rendered += _render(texts[a:b], own, entry[a] == START, ending)
            place += range(b - a)
        return pd.DataFrame(
            {
                "key": pdf["key"], "turn": pdf["turn"].astype("Int64"), "block": pdf["block"],
                "place": place, "role": pdf["role"], "new_role": [ROLES[r] for r, _, _ in steps],
                "merged": [m for _, _, m in steps],
                "relabelled": [h != r for h, (r, _, _) in zip(roles, steps, strict=True)],
                "inserted_before": [[ROLES[x] for x in i] for _, i, _ in steps], "inserted_after": after,
                "rendered": rendered,
            }
        )

    blocks = dealt(keyed, "key", "block").applyInPandas(matrices, "key string, block long, costs array<double>")
    states = dealt(blocks, "key").applyInPandas(borders, "key string, block long, entry int, leave int, last boolean")
    states = materialize(states, "borders")
    done = dealt(keyed.drop("conv_id").join(states, ["key", "block"]), "key", "block").applyInPandas(
        repaired,
        "key string, turn long, block long, place int, role string, new_role string, merged boolean, "
        "relabelled boolean, inserted_before array<string>, inserted_after array<string>, rendered string",
    )
    conv_id = F.when(F.col("key") != "null", F.substring("key", 2, (1 << 31) - 1)).cast(id_type)
    return done.withColumn("key", conv_id).withColumnRenamed("key", "conv_id")


def rendered_conversations(repaired: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``(conv_id, part, text, turns)``: each conversation's rendering, in numbered parts where it is long.

    A part ends with the block that reaches ``part_chars`` code points; parts joined in order lose nothing.
    """
    joined = lambda by, text: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(by, text))), lambda x: x[text]), ""
    ).alias("text")
    blocks = repaired.groupBy("conv_id", "block").agg(joined("place", "rendered"), F.count("*").alias("turns"))
    along = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text")).over(along), F.lit(0))
    parted = blocks.withColumn("part", F.floor(before / part_chars).cast("int"))
    return parted.groupBy("conv_id", "part").agg(joined("block", "text"), F.sum("turns").alias("turns"))
