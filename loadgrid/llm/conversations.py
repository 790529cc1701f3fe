"""Conversation structure repair by square-root checkpointed dynamic programming.

A conversation's rows are edited at least cost so that their roles read (system? (user assistant)+)?. The state before a
row is what has been emitted so far (nothing, or the last role), so a vector of four costs says what the rest costs at
least from each state. Vectors run backward over the rows, and only those at every sqrt(n)-th row are stored. The walk
forward recomputes one block of them at a time, and takes among the edits that meet the vector exactly (the tight ones)
the first by ASCII; so the audit is the least of all cheapest ones.

Rows are numbered over the whole table and cut into pieces of PIECE rows, whatever conversations they belong to. A
conversation that lies in several pieces, be it a third of all rows, is never gathered: each of its pieces gives the
least costs from state to state, a fold of these (16 numbers a piece) gives the vectors at the cuts, then each piece
tells where the walk leaves it from each state, and a fold of that gives the state in which each piece begins. Only the
SHA-256 of the repaired text is sequential by nature: a task streams a conversation's lines into it, holding one batch.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loadgrid.llm.common import written
from loadgrid.operators.ranks import with_rank

#: Rows that one task edits at a time.
PIECE = 4096
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FAR = 2**40
#: States: nothing emitted, after system, after user, after assistant. What an inserted or reroled row leads to:
NEXT = (2, 2, 3, 2)
#: Costs of the rest where no row is left.
END = (0, 2 * INSERT, INSERT, 0)
ROLE = {2: "user", 3: "assistant"}
#: Role initials by number: s, u, a, any other. Where a kept row leads to from each state, -1 being nowhere.
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))


def _before(row: tuple[int, int], after: tuple) -> tuple:
    """Costs before a row (role number, fault: 0 none, 1 truncated, 2 to be deleted), from those behind it."""
    role, fault = row
    h = [DELETE + c for c in after]
    if fault < 2:
        extra = TRUNCATED * fault
        for q in range(4):
            to = KEPT[role][q]
            h[q] = min(h[q], after[NEXT[q]] + REROLE + extra, after[to] + extra if to >= 0 else FAR)
    user, assistant = min(h[2], INSERT + h[3]), min(h[3], INSERT + h[2])
    return min(h[0], INSERT + user), min(h[1], INSERT + user), user, assistant


def _back(rows: list, after: tuple) -> tuple:
    for row in reversed(rows):
        after = _before(row, after)
    return after


def walk(rows: list[tuple[int, int]], state: int, after: tuple, last: bool):
    """The tight edits of rows from a state on, `after` being the costs behind them: yields for each row (letters, roles
    inserted before it, its role's new name, None if kept or "" if deleted, cost), and returns the state it ends in.
    With last, rows end the conversation, and one more entry has what is inserted behind them."""
    n = len(rows)
    block = max(1, isqrt(n - 1) + 1) if n else 1
    # checkpoints: costs before rows 0, block, 2 * block, ...
    stored = [after]
    for at in range((n - 1) // block * block, 0, -block):
        stored.append(_back(rows[at : at + block], stored[-1]))
    for at in range(0, n, block):
        own = rows[at : at + block]
        costs = [stored.pop()]
        for row in reversed(own):
            costs.append(_before(row, costs[-1]))
        costs.reverse()
        for k, (role, fault) in enumerate(own):
            letters, inserted, cost = "", [], 0
            while True:
                need, extra, to = costs[k][state], TRUNCATED * fault, KEPT[role][state]
                if need == DELETE + costs[k + 1][state]:
                    yield letters + "D", inserted, "", cost + DELETE
                    break
                if need == INSERT + costs[k][NEXT[state]]:
                    state = NEXT[state]
                    letters, cost = letters + "I", cost + INSERT
                    inserted.append(ROLE[state])
                    continue
                if fault < 2 and to >= 0 and need == extra + costs[k + 1][to]:
                    state = to
                    yield letters + "K", inserted, None, cost + extra
                else:
                    state = NEXT[state]
                    yield letters + "R", inserted, ROLE[state], cost + REROLE + extra
                break
    if last:
        inserted = []
        while state in (1, 2):
            state = NEXT[state]
            inserted.append(ROLE[state])
        yield "I" * len(inserted), inserted, "", INSERT * len(inserted)
    return state


def end_state(rows: list, state: int, after: tuple) -> int:
    steps = walk(rows, state, after, False)
    while True:
        try:
            next(steps)
        except StopIteration as e:
            return e.value


def _pieces(table: pa.Table):
    """(slice of a piece's rows in order, by conversation, their columns)."""
    table = table.sort_by("rank")
    convs = table.column("conv").to_pylist()
    rows = list(zip(table.column("initial").to_pylist(), table.column("fault").to_pylist(), strict=True))
    begins = [0, *(k for k in range(1, len(convs)) if convs[k] != convs[k - 1])]
    for a, b in zip(begins, [*begins[1:], len(convs)], strict=True):
        yield table, a, b, rows[a:b]


def _summed(table: pa.Table) -> pa.Table:
    """Least costs from state to state over each conversation's rows of a piece."""
    out = []
    for t, a, _, rows in _pieces(table):
        columns = [_back(rows, tuple(0 if q == end else FAR for q in range(4))) for end in range(4)]
        out.append((t.column("conv")[a].as_py(), t.column("piece")[a].as_py(), [min(columns[end][q], FAR) for q in range(4) for end in range(4)]))
    return pa.table({"conv": pa.array([r[0] for r in out], table.schema.field("conv").type), "piece": pa.array([r[1] for r in out], pa.int64()), "costs": pa.array([r[2] for r in out], pa.list_(pa.int64()))})


def _cut_costs(table: pa.Table) -> pa.Table:
    """Costs behind each piece of a conversation, from the last piece to the first."""
    table = table.sort_by([("piece", "descending")])
    after, out = END, []
    for costs in table.column("costs").to_pylist():
        out.append(list(after))
        after = tuple(min(costs[4 * q + end] + after[end] for end in range(4)) for q in range(4))
    return table.select(["conv", "piece"]).append_column("after", pa.array(out, pa.list_(pa.int64())))


def _left(table: pa.Table) -> pa.Table:
    """The state in which the walk leaves each conversation's rows of a piece, from each state."""
    out = []
    for t, a, _, rows in _pieces(table):
        after = tuple(t.column("after")[a].as_py())
        out.append((t.column("conv")[a].as_py(), t.column("piece")[a].as_py(), list(after), [end_state(rows, q, after) for q in range(4)]))
    return pa.table(
        {"conv": pa.array([r[0] for r in out], table.schema.field("conv").type), "piece": pa.array([r[1] for r in out], pa.int64()), "after": pa.array([r[2] for r in out], pa.list_(pa.int64())), "leaves": pa.array([r[3] for r in out], pa.list_(pa.int32()))}
    )


def _entered(table: pa.Table) -> pa.Table:
    """The state in which each piece of a conversation begins, from the first piece to the last."""
    table = table.sort_by("piece")
    state, out = 0, []
    for leaves in table.column("leaves").to_pylist():
        out.append(state)
        state = leaves[state]
    last = np.arange(len(out)) == len(out) - 1
    return table.select(["conv", "piece", "after"]).append_column("state", pa.array(out, pa.int32())).append_column("last", pa.array(last))


_EDITS = "rank long, letters string, before array<string>, role string, behind array<string>, cost long"


def _edited(table: pa.Table) -> pa.Table:
    out = []
    for t, a, b, rows in _pieces(table):
        after = t.column("after")[a].as_py()
        last = after is None or t.column("last")[a].as_py()
        steps = list(walk(rows, t.column("state")[a].as_py() or 0, tuple(after or END), last))
        more, behind, _, extra = steps.pop() if last else ("", [], "", 0)
        for k, (letters, before, role, cost) in enumerate(steps):
            end = k == b - a - 1
            out.append((t.column("rank")[a + k].as_py(), letters + more * end, before, role, behind if end else [], cost + extra * end))
    kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.int64())
    return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["rank", "letters", "before", "role", "behind", "cost"])


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy): rows with faults by crc32 of conversation and turn; nulls count as one space."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(as_text(conv), F.lit(":"), as_text(turn)).cast("binary")) % 20
    read = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), code.alias("code"))
    faulty = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return read.where("code <> 0").select("conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), faulty.alias("text"), F.explode(copies).alias("copy"))


def _faults(ranked: DataFrame) -> DataFrame:
    """(rank, piece, conv, turn, initial, kind, fault): rows without their texts, faults found."""
    # role and text by 128 bits; the length keeps them apart
    name = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    slim = written(ranked.select("rank", "conv", "turn", F.substring("role", 1, 1).alias("initial"), F.substring(bare, -1, 1).alias("end"), name.alias("name")))
    repeated = slim.groupBy("name").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    kind = F.when(F.col("end") == "", "blank").when(F.col("first") < F.col("rank"), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    found = slim.join(repeated, "name", "left").select("rank", F.floor(F.col("rank") / PIECE).alias("piece"), "conv", "turn", "initial", kind.alias("kind"))
    return written(found.withColumn("fault", F.when(F.col("kind").isNull(), 0).when(F.col("kind") == "truncated", 1).otherwise(2)))


def _number(initial: Column) -> Column:
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def _edits(slim: DataFrame) -> DataFrame:
    """The edit of each row, with what is inserted before and, at a conversation's end, behind it."""
    kind = slim.schema["conv"].dataType.simpleString()
    rows = slim.select("rank", "piece", "conv", _number(F.col("initial")).alias("initial"), "fault")
    wide = written(slim.groupBy(F.col("conv").alias("c")).agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low < high").select("c"))
    contexts = None
    if not wide.isEmpty():
        # at most two conversations of a piece lie in others too
        cut = written(rows.join(wide, F.col("conv").eqNullSafe(F.col("c"))).drop("c"))
        costs = cut.groupBy("piece").applyInArrow(_summed, f"conv {kind}, piece long, costs array<long>")
        after = written(costs.groupBy("conv").applyInArrow(_cut_costs, f"conv {kind}, piece long, after array<long>"))
        at = after.withColumnsRenamed({"conv": "c", "piece": "p"})
        known = cut.join(at, (F.col("piece") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c"))).drop("c", "p")
        left = known.groupBy("piece").applyInArrow(_left, f"conv {kind}, piece long, after array<long>, leaves array<int>")
        contexts = written(left.groupBy("conv").applyInArrow(_entered, f"conv {kind}, piece long, after array<long>, state int, last boolean")).withColumnsRenamed({"conv": "c", "piece": "p"})
        rows = rows.join(contexts, (F.col("piece") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")), "left").drop("c", "p")
    else:
        rows = rows.withColumns({"after": F.lit(None).cast("array<long>"), "state": F.lit(None).cast("int"), "last": F.lit(None).cast("boolean")})
    return rows.groupBy("piece").applyInArrow(_edited, _EDITS)


def _streamed(batches):
    """(conv, cost, audit, repaired_sha256) of conversations whose lines come one after the other; a null line has no text."""
    names = ["conv", "cost", "audit", "repaired_sha256"]
    conv, cost, letters, digest, empty, begun = None, 0, [], None, True, False
    for b in batches:
        out = []
        for c, price, letter, lines in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if not begun or c != conv:
                if begun:
                    out.append((conv, cost, "".join(letters), digest.hexdigest()))
                conv, cost, letters, digest, empty, begun = c, 0, [], hashlib.sha256(), True, True
            cost += price
            letters.append(letter)
            if lines is not None:
                digest.update((lines if empty else "\n" + lines).encode("utf-8", "surrogatepass"))
                empty = False
        kind = b.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string())], names)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([cost], pa.int64()), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])], names)


def edited(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, faults) of rows (conv, turn, role, text, copy). turns has a row for each given one: rank in its conversations'
    order, conv, letters of its edits, lines, the repaired `role:text` lines in its place (null if none), and cost."""
    ranked = written(with_rank(rows, ["conv", "turn", "role", "text", "copy"]))
    slim = _faults(ranked)
    edits = _edits(slim).withColumnRenamed("role", "new_role")
    own = F.when(F.col("new_role").isNull(), F.array(F.concat("role", F.lit(":"), "text"))).when(F.col("new_role") == "", F.array().cast("array<string>")).otherwise(F.array(F.concat("new_role", F.lit(":"), "text")))
    with_colon = lambda c: F.transform(c, lambda r: F.concat(r, F.lit(":")))
    lines = F.concat(with_colon("before"), own, with_colon("behind"))
    turns = ranked.join(edits, "rank").withColumn("lines", lines)
    return turns.select("rank", "conv", "letters", F.when(F.size("lines") > 0, F.array_join("lines", "\n")).alias("lines"), "cost"), slim


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): faults and cheapest repair of each conversation.

    rows are (conv, turn, role, text, copy) without nulls in role and text, ids (conv) all conversations to report. A
    conversation's rows go by turn, nulls first, then by role and text. A null id is a conversation of its own. One
    without rows has zeros, an empty audit and the hash of an empty string. Gaps beyond 64 bits are null.
    """
    turns, slim = edited(rows)
    kind = slim.schema["conv"].dataType.simpleString()
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    by_turn = slim.groupBy("conv", "turn").agg(*(count(k) for k in ("blank", "duplicate", "truncated")))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = F.coalesce(wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count("turn")), wide(F.lit(0)))
    faults = by_turn.groupBy("conv").agg(gaps.try_cast("long").alias("gaps"), *(F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")))
    later = slim.select((F.col("rank") - 1).alias("rank"), F.col("conv").alias("c"), F.col("initial").alias("next"))
    pairs = slim.join(later, "rank").where(F.col("conv").eqNullSafe(F.col("c")) & ~F.concat("initial", "next").isin("su", "ua", "au"))
    illegal = pairs.groupBy("conv").agg(F.count("*").alias("illegal"))
    repaired = turns.repartition("conv").sortWithinPartitions("conv", "rank").select("conv", "cost", "letters", "lines").mapInArrow(_streamed, f"conv {kind}, cost long, audit string, repaired_sha256 string")
    found = ids.select(F.col("conv").alias("conv_id")).distinct()
    for part in (faults, illegal, repaired):
        part = part.withColumnRenamed("conv", "__conv")
        found = found.join(part, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("audit").isNotNull(), F.col("gaps")).otherwise(0).alias("gaps")
    return found.select("conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repair_damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """report() of rows after damaged(); an empty table gives no rows, and other columns are ignored."""
    return report(damaged(rows, conv, turn, role, text), rows.select(F.col(conv).alias("conv")))
