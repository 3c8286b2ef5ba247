"""Operator 9: chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, user first, assistant
last. Over this automaton each given turn is kept, merged into the turn before, relabelled, or preceded by empty turns;
the cheapest sequence of these actions is found by dynamic programming, and the repaired turns are rendered.

A turn's best actions between two states depend on its role alone, so a run of turns is one matrix of least costs between
states (the minimum takes the place of the sum, the sum that of the product). Long conversations are cut into chunks of
bounded size: each chunk gives its matrix, a conversation's matrices are combined in order into the state in which each
chunk begins and ends, and then every chunk chooses its actions by itself. No conversation is held as a whole.

Result: one row for each given turn, in order of position; the fragments ``rendered`` of a conversation, one after another,
are its rendered text. Empty turns that were inserted are part of the fragment of the turn that follows, or of the
last turn at the end.

Defined cases: a null text is an empty text; a role that is null or unknown, after trimming and lower-casing, can only be
merged or relabelled; null turns come last and null conversation ids form one conversation; equal turns are ordered by role
and then text hash; among equal costs, keeping comes before merging, relabelling and inserting; an empty table gives no
rows. Marker strings inside texts are broken by a space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import or_empty, small_batches, written

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, MERGE_OTHER, RELABEL, INSERT, CLOSE = 1.0, 2.5, 2.0, 3.0, 1.0
CHUNK = 4096
NEVER = float("inf")


@lru_cache(maxsize=8)
def choices(role: str) -> list[list[tuple[float, str, tuple[int, ...]]]]:
    """choices(role)[a][b]: cost, action and states of inserted turns that lead from state a to state b over one turn."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    table = [[(NEVER, "", ())] * 4 for _ in range(4)]

    def offer(a: int, b: int, cost: float, action: str, inserted: tuple[int, ...]) -> None:
        if cost < table[a][b][0]:
            table[a][b] = (cost, action, inserted)

    for a in range(4):
        for inserted in ((), *((m,) for m in MOVES[a]), *((m, n) for m in MOVES[a] for n in MOVES[m])):
            at = inserted[-1] if inserted else a
            for b in MOVES[at]:
                offer(a, b, INSERT * len(inserted) + (0.0 if b == own else RELABEL), "keep" if b == own else "relabel", inserted)
        if a != START:
            offer(a, a, MERGE if a == own else MERGE_OTHER, "merge", ())
    return table


def _matrix(roles: list[str]) -> list[list[float]]:
    out = [[0.0 if a == b else NEVER for b in range(4)] for a in range(4)]
    for role in roles:
        step = choices(role)
        out = [[min(row[m] + step[m][b][0] for m in range(4)) for b in range(4)] for row in out]
    return out


def _closing(state: int) -> tuple[float, tuple[int, ...]]:
    """Cost and inserted turns that make a conversation legal which stops in this state."""
    if state == ASSISTANT:
        return 0.0, ()
    return (CLOSE, (ASSISTANT,)) if state == USER else (INSERT + CLOSE, (USER, ASSISTANT))


def ends_of_chunks(matrices: list[list[list[float]]]) -> list[tuple[int, int]]:
    """State at the begin and end of each chunk of a conversation, on a cheapest path."""
    costs = [[0.0, NEVER, NEVER, NEVER]]
    for m in matrices:
        costs.append([min(costs[-1][a] + m[a][b] for a in range(4)) for b in range(4)])
    state = min(range(4), key=lambda s: (costs[-1][s] + _closing(s)[0], -s))
    out = []
    for k in range(len(matrices) - 1, -1, -1):
        before = min(range(4), key=lambda a: costs[k][a] + matrices[k][a][state])
        out.append((before, state))
        state = before
    return out[::-1]


def repair(roles: list[str], begin: int, end: int) -> list[tuple[int, int, str, tuple[int, ...], float]]:
    """(state before, state after, action, inserted, cost) of each turn of a chunk, on a cheapest path between two states."""
    costs = [[0.0 if s == begin else NEVER for s in range(4)]]
    for role in roles:
        step = choices(role)
        costs.append([min(costs[-1][a] + step[a][b][0] for a in range(4)) for b in range(4)])
    out, state = [], end
    for k in range(len(roles) - 1, -1, -1):
        step = choices(roles[k])
        before = min(range(4), key=lambda a: costs[k][a] + step[a][state][0])
        cost, action, inserted = step[before][state]
        out.append((before, state, action, inserted, cost))
        state = before
    return out[::-1]


def _open(state: int, role: int) -> str:
    return ("" if state == START else "<|end|>\n") + f"<|{ROLES[role - 1]}|>\n"


def render(before: int, after: int, action: str, inserted: tuple[int, ...], text: str) -> str:
    text = text.replace("<|", "< |")
    if action == "merge":
        return "\n\n" + text
    out, state = "", before
    for role in (*inserted, after):
        out += _open(state, role)
        state = role
    return out + text


def render_end(state: int) -> str:
    out = ""
    for role in _closing(state)[1]:
        out += _open(state, role)
        state = role
    return out + "<|end|>\n"


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
    """Runs of rows with equal first columns; the input is sorted by them."""
    held: list[dict] = []
    for batch in batches:
        names = batch.schema.names[:keys]
        for row in batch.to_pylist():
            if held and any(held[0][n] != row[n] for n in names):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def repair_roles(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """conv_id, turn, position, role, new_role, action, n_inserted, cost and rendered of each turn."""
    spark = turns.sparkSession
    small_batches(spark)
    rows = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), or_empty(text).alias("text"))
    order = [F.asc_nulls_last("conv_id"), F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.xxhash64("text")]
    conv, at = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            position = pa.array(range(base + n, base + n + batch.num_rows), pa.int64())
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, position], [*batch.schema.names, "position"])

    # Positions grow with the order over all partitions; a chunk is a run of a conversation within one of them.
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # told outright: rows are small, their work isn't
    ranges = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    placed = written(ranges.mapInArrow(numbered, f"conv_id {conv}, turn {at}, role string, text string, position long"), "chat-turns")
    placed = placed.withColumn("chunk", F.floor(F.col("position") / chunk))
    clean = F.lower(F.trim(F.coalesce("role", F.lit(""))))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            flat = [x for row in _matrix([g["clean"] for g in group]) for x in row]
            yield pa.RecordBatch.from_pylist([{"conv_id": group[0]["conv_id"], "chunk": group[0]["chunk"], "costs": flat}], pa.schema([("conv_id", batch_type), ("chunk", pa.int64()), ("costs", pa.list_(pa.float64()))]))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 1):
            found = ends_of_chunks([[g["costs"][4 * a : 4 * a + 4] for a in range(4)] for g in group])
            out = [{"conv_id": g["conv_id"], "chunk": g["chunk"], "begin": b, "end": e, "last": k == len(group) - 1} for k, (g, (b, e)) in enumerate(zip(group, found, strict=True))]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", batch_type), ("chunk", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("last", pa.bool_())]))

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            out = []
            for g, (before, after, action, inserted, cost) in zip(group, repair([g["clean"] for g in group], group[0]["begin"], group[0]["end"]), strict=True):
                out.append({"conv_id": g["conv_id"], "turn": g["turn"], "position": g["position"], "role": g["role"], "new_role": ROLES[after - 1], "action": action, "n_inserted": len(inserted), "cost": cost, "rendered": render(before, after, action, inserted, g["text"])})
            if group[0]["last"]:
                out[-1]["rendered"] += render_end(group[0]["end"])
                out[-1]["n_inserted"] += len(_closing(group[0]["end"])[1])
                out[-1]["cost"] += _closing(group[0]["end"])[0]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", batch_type), ("turn", turn_type), ("position", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("n_inserted", pa.int64()), ("cost", pa.float64()), ("rendered", pa.string())]))

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type, turn_type = (to_arrow_type(rows.schema[c].dataType) for c in ("conv_id", "turn"))
    sort = [F.asc_nulls_last("conv_id"), F.col("chunk"), F.col("position")]
    roles = placed.select("conv_id", "chunk", "position", clean.alias("clean")).repartition(n_parts, "conv_id", "chunk").sortWithinPartitions(*sort).drop("position")
    costs = roles.mapInArrow(matrices, f"conv_id {conv}, chunk long, costs array<double>")
    ends = costs.repartition(n_parts, "conv_id").sortWithinPartitions(F.asc_nulls_last("conv_id"), "chunk").mapInArrow(states, f"conv_id {conv}, chunk long, begin long, end long, last boolean")
    ends = written(ends.withColumnsRenamed({"conv_id": "conv", "chunk": "part"}), "chat-ends")
    both = placed.withColumn("clean", clean).join(ends, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("chunk") == F.col("part")))
    both = both.select("conv_id", "chunk", "position", "turn", "role", "clean", "text", "begin", "end", "last")
    return both.repartition(n_parts, "conv_id", "chunk").sortWithinPartitions(*sort).mapInArrow(
        repaired, f"conv_id {conv}, turn {at}, position long, role string, new_role string, action string, n_inserted long, cost double, rendered string"
    )


def op9_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
