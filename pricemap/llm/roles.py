"""Chat formatting with minimum-cost role repair.

Legal conversations are those of an automaton: an optional system turn, then user and assistant turns in
alternation, the last one the assistant's.  Dynamic programming picks, turn by turn, the output role
(a relabel costs), whether the turn is merged into the one before, and where an empty turn is put in, so
that the whole costs least.  The cost of a stretch of turns is a (min, +) matrix from the state before to the
state after, and matrices of consecutive stretches multiply; so a conversation of any length is cut into
stretches that tasks handle apart, whose matrices are combined into the states at their edges.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemap.llm.store import saved

#: States: what the last output turn is.  START comes before any turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = ("start", "system", "user", "assistant")
#: Role names that count as another spelling, at no cost.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
INF = float("inf")
#: Turns that one stretch holds at most, about.
STRETCH_TURNS = 50_000


@dataclass(frozen=True)
class Costs:
    """Costs of the repairs; ties go to a merge, then a relabel, then an insertion."""

    merge: float = 1.0
    insert: float = 1.5
    relabel: float = 2.0
    unknown: float = 0.5
    next_roles: dict = field(default_factory=lambda: {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)})
    final: tuple = (ASSISTANT,)


def role_state(role: str | None) -> int | None:
    """State of a role name; None if the name says nothing."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return STATES.index(name) if name in STATES[1:] else None


def moves(costs: Costs) -> dict[tuple[int, int], tuple[float, tuple[int, ...], bool]]:
    """For each (state, output role of the next turn): (cost, states of empty turns put in before, merged)."""
    out = {}
    for a in range(4):
        # shortest way over empty turns to each state from which a role may follow
        ways, edge = {a: ()}, [a]
        while edge:
            grown = []
            for s in edge:
                for t in costs.next_roles.get(s, ()):
                    if t != SYSTEM and t not in ways:
                        ways[t] = (*ways[s], t)
                        grown.append(t)
            edge = grown
        for b in (SYSTEM, USER, ASSISTANT):
            best = (costs.merge, (), True) if a == b else (INF, (), False)
            for s, way in ways.items():
                price = costs.insert * len(way)
                if b in costs.next_roles.get(s, ()) and price < best[0]:
                    best = (price, way, False)
            out[a, b] = best
    return out


def turn_cost(observed: int | None, given: int, costs: Costs) -> float:
    return costs.unknown if observed is None else 0.0 if observed == given else costs.relabel


def stretch_matrix(observed: list[int | None], costs: Costs, table=None) -> np.ndarray:
    """Least cost from each state before the stretch to each state after it."""
    table = table or moves(costs)
    m = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for own in observed:
        step = np.full((4, 4), INF)
        for (a, b), (price, _, _) in table.items():
            step[a, b] = price + turn_cost(own, b, costs)
        m = (m[:, :, None] + step[None]).min(axis=1)
    return m


def best_roles(observed: list[int | None], first: int, last: int, costs: Costs, table=None) -> list[int]:
    """Output roles of the turns on the cheapest way between two states; the lower state on ties."""
    table = table or moves(costs)
    cost, back = {first: 0.0}, []
    for own in observed:
        new, came = {}, {}
        for b in (SYSTEM, USER, ASSISTANT):
            for a in sorted(cost):
                c = cost[a] + table[a, b][0] + turn_cost(own, b, costs)
                if c < new.get(b, INF):
                    new[b], came[b] = c, a
        cost = new
        back.append(came)
    out, state = [], last
    for came in reversed(back):
        out.append(state)
        state = came[state]
    return out[::-1]


def final_state(cost: np.ndarray, costs: Costs, table=None) -> tuple[int, tuple[int, ...]]:
    """(state after the last turn, empty turns to add) of the cheapest legal end."""
    table = table or moves(costs)
    best = (INF, START, ())
    for s in range(4):
        if not np.isfinite(cost[s]):
            continue
        if s in costs.final:
            best = min(best, (cost[s], s, ()))
        for end in costs.final:
            price, way, merged = table[s, end]
            if not merged and np.isfinite(price):
                best = min(best, (cost[s] + price + costs.insert, s, (*way, end)))
    return best[1], best[2]


def repair(turns: list[tuple[str | None, str | None]], costs: Costs = Costs()) -> list[dict]:
    """The repaired turns of one conversation given whole: role, text, n_merged, relabelled, inserted."""
    if not turns:
        return []
    table, observed = moves(costs), [role_state(r) for r, _ in turns]
    end, added = final_state(stretch_matrix(observed, costs, table)[START], costs, table)
    roles = best_roles(observed, START, end, costs, table)
    out = _turns(turns, observed, roles, START, table)
    return out + [_empty(s) for s in added]


def _empty(state: int) -> dict:
    return {"role": STATES[state], "text": "", "n_merged": 0, "relabelled": False, "inserted": True}


def _turns(turns, observed, roles, state, table) -> list[dict]:
    """Output turns of a stretch; a first one that merges into the turn before it has ``joins``."""
    out = []
    for (_, text), own, role in zip(turns, observed, roles):
        _, way, merged = table[state, role]
        out += [_empty(s) for s in way]
        if merged and out and not out[-1]["inserted"]:
            out[-1]["text"] += "\n\n" + (text or "")
            out[-1]["n_merged"] += 1
            out[-1]["relabelled"] |= own != role
        else:
            out.append({"role": STATES[role], "text": text or "", "n_merged": 1, "relabelled": own != role, "inserted": False, "joins": merged})
        state = role
    return out


def repair_conversations(conversations: DataFrame, costs: Costs = Costs(), partitions: int | None = None) -> DataFrame:
    """Repaired turns of every conversation (conv_id, turn, role, text).

    Turns are ordered by turn (nulls first), then role and a hash of the text, so ties and repeated
    rows have one order.  Null texts are empty, null and unknown roles fit any role at a small cost, rows with a null
    conv_id are one conversation; an empty table gives no rows; other columns are not read.

    The rows are sorted by range over all columns, so a long conversation spans several partitions;
    each partition is a stretch, and only one matrix per stretch is brought together.
    """
    spark = conversations.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // STRETCH_TURNS))
    keys = [*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")), F.xxhash64("text")]
    rows = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    ordered = ordered.withColumn("place", F.monotonically_increasing_id())
    ordered = saved(ordered, "turns")
    table = moves(costs)

    def stretches(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        own = [_matrix_row(conv, key[0], g, costs, table) for conv, g in _by_conversation(pdf)]
        return pd.DataFrame(own, columns=["conv_id", "part", "matrix"])

    edges = ordered.select("conv_id", "part", "place", "role")
    # only conversations that lie in several partitions need their stretches' matrices
    spans = edges.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select(F.col("conv_id").alias("c"))
    cut = edges.join(spans.hint("merge"), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    matrices = saved(cut.groupBy("part").applyInPandas(stretches, "conv_id long, part int, matrix array<double>"), "stretches")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.array(m, dtype=float).reshape(4, 4) for m in pdf.sort_values("part")["matrix"]]
        fore = [np.where(np.arange(4) == START, 0.0, INF)]
        for m in own:
            fore.append((fore[-1][:, None] + m).min(axis=0))
        end, added = final_state(fore[-1], costs, table)
        bounds = [end]
        for k in range(len(own) - 1, -1, -1):
            bounds.append(int(np.argmin(fore[k] + own[k][:, bounds[-1]])))
        bounds = bounds[::-1]
        parts = pdf["part"].sort_values().tolist()
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0], "part": parts, "enter": bounds[:-1], "leave": bounds[1:], "is_last": [k == len(parts) - 1 for k in range(len(parts))]}).astype({"conv_id": "Int64"})

    bounds = matrices.groupBy("conv_id").applyInPandas(states, "conv_id long, part int, enter int, leave int, is_last boolean")
    bounds = saved(bounds, "stretch-states")

    def render(key, pdf: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        known = {None if pd.isna(r.conv_id) else int(r.conv_id): r for r in edge.itertuples()}
        out = []
        for conv, g in _by_conversation(pdf):
            turns = list(zip(g["role"], g["text"]))
            first_place = int(g["place"].iloc[0])
            if conv in known:
                r = known[conv]
                observed = [role_state(x) for x, _ in turns]
                made = _turns(turns, observed, best_roles(observed, r.enter, r.leave, costs, table), r.enter, table)
                if r.is_last and r.leave not in costs.final:
                    _, added = final_state(np.where(np.arange(4) == r.leave, 0.0, INF), costs, table)
                    made += [_empty(s) for s in added]
            else:
                made = repair(turns, costs)
            out += [(conv, key[0], first_place, k, t["role"], t["text"], t["n_merged"], t["relabelled"], t["inserted"], bool(t.get("joins", False)), conv in known) for k, t in enumerate(made)]
        frame = pd.DataFrame(out, columns=["conv_id", "part", "place", "k", "role", "text", "n_merged", "relabelled", "inserted", "joins", "spans"])
        frame["conv_id"] = frame["conv_id"].astype("Int64")
        return frame

    made_schema = "conv_id long, part int, place long, k long, role string, text string, n_merged long, relabelled boolean, inserted boolean, joins boolean, spans boolean"
    return ordered.groupBy("part").cogroup(bounds.groupBy("part")).applyInPandas(render, made_schema)


def _by_conversation(pdf: pd.DataFrame):
    """(conv_id or None, rows) of consecutive rows."""
    own = pdf["conv_id"]
    change = np.flatnonzero((own.ne(own.shift()) & ~(own.isna() & own.shift().isna())).to_numpy())
    for a, b in zip(change, [*change[1:], len(pdf)]):
        first = own.iloc[a]
        yield (None if pd.isna(first) else int(first)), pdf.iloc[a:b]


def _matrix_row(conv, part, g: pd.DataFrame, costs: Costs, table) -> tuple:
    return conv, part, stretch_matrix([role_state(r) for r in g["role"]], costs, table).ravel().tolist()


def rendered(repaired: DataFrame) -> DataFrame:
    """Output turns (conv_id, out_turn, role, text, n_merged, relabelled, inserted).

    Conversations within one partition are numbered already; of the others, a turn that was cut at a
    partition's edge is put together, and the numbers follow from one count per stretch.
    """
    names = ["conv_id", "out_turn", "role", "text", "n_merged", "relabelled", "inserted"]
    repaired = saved(repaired, "repaired")
    whole = repaired.filter("not spans").withColumn("out_turn", F.col("k")).select(*names)
    cut = repaired.filter("spans")
    head = F.col("joins") & (F.col("k") == 0)
    counts = cut.groupBy("conv_id", "part").agg(F.sum(F.when(head, 0).otherwise(1)).alias("n"), F.max(head.cast("int")).alias("joined"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("joined")).alias("offset"))
    # at most two such conversations end in a partition, so the offsets are as few as the partitions
    numbered = cut.join(F.broadcast(offsets), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("out_turn", F.col("offset") + F.col("k"))
    joined = numbered.groupBy("conv_id", "out_turn").agg(
        F.min_by("role", F.struct("part", "k")).alias("role"),
        F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "text"))), lambda x: x["text"])).alias("text"),
        F.sum("n_merged").alias("n_merged"),
        F.max("relabelled").alias("relabelled"),
        F.max("inserted").alias("inserted"),
    )
    return whole.unionByName(joined.select(*names))


def format_chats(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Repaired and rendered turns, one row each, with the turn's rendering in ``rendered``."""
    turns = rendered(repair_conversations(conversations, costs))
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))
