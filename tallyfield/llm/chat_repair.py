"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turn, the
assistant last. Where roles break that order, dynamic programming over this automaton
finds the cheapest mending: a turn may be merged into the message before it, get another
role, or have empty messages put in before it. The repaired messages are then rendered.

The conversation's cost is a path through a product of one small (min, +) matrix a turn.
Such products can be cut anywhere: turns are dealt out in order over ranges of about equal
size, each range's piece of a conversation becomes one matrix, and from these few matrices
the best state at every cut is found. Roles alone go through this, and through the choice of
each turn's step, which is one byte a turn; the texts then pass by in the same order, a batch
at a time, and take their steps. A conversation may therefore be longer than any task's
memory, and a task never holds more than a batch of texts.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import range_number

from .common import only, ship_package, ticked, written

ROLES = ("system", "user", "assistant")
START, END = "<|im_start|>", "<|im_end|>"
# Costs, in order of preference where sums are equal: merge, other role, empty message.
MERGE, EMPTY = 2, 6
RELABEL = {
    ("user", "assistant"): 4,
    ("assistant", "user"): 4,
    ("user", "system"): 9,
    ("assistant", "system"): 9,
    ("system", "user"): 5,
    ("system", "assistant"): 7,
    (None, "user"): 3,
    (None, "assistant"): 3,
    (None, "system"): 5,
}
# State 0 is the beginning; 1, 2, 3 follow a message of ROLES.
STATES = 4
_FAR = 1 << 60
_NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}

# Turns whose steps lie in one row.
STEPS = 8192
# A step as a byte: the state after it, the state before it, and whether a conversation begins or ends.
_BEFORE, _OPENS, _CLOSES = 2, 16, 32

_SCHEMA = (
    "action string, new_role string, put_in array<string>, closes boolean, rendered string"
)


def repair(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per turn: its conversation, turn and role, and what becomes of it.

    `action` is 'keep', 'relabel', 'merge' or 'merge, relabel'; `new_role` the role of its
    message; `put_in` the roles of empty messages before it; `closes` whether the
    conversation ends here. `rendered` is its piece of the output: the pieces of a
    conversation, in order, are the whole. After a turn that closes, an empty assistant
    message follows within the piece if the repaired sequence needs one.

    Turns are ordered by number, NULL first; turns of one number by role and text. Roles are
    compared in lower case without blanks around; NULL and unknown ones must get another.
    NULL text is empty. Rows without a conversation are one conversation. Every row comes
    back, also one that repeats. Of equally cheap mendings one is given; in a conversation
    that spans ranges it may depend on the cuts. Other columns of `turns` count for nothing,
    whatever their names. The turns are read several times, mostly without their texts.
    """
    spark = turns.sparkSession
    ship_package(spark)
    rows = only(turns, conversation=conversation, turn=turn, role=role, text=text)
    rows = rows.withColumn("mark", F.xxhash64("text"))
    names = ["conversation", "turn", "role", "mark"]
    order = [F.col(c) for c in names]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.withColumn("part", range_number(rows, order, parts=parts))
    keys = numbered.drop("text").withColumn("name", F.col("conversation").cast("string"))
    keys = keys.repartitionById(parts, F.col("part")).sortWithinPartitions(*order)
    steps = written(_chosen(keys, _states_at_cuts(_edge_pieces(keys))))
    nothing = F.lit(None)
    # The steps of a stretch of turns come just ahead of its first turn.
    ahead = steps.withColumns({"text": nothing.cast("string"), "late": F.lit(0)})
    told = numbered.withColumns({"steps": nothing.cast("binary"), "at": F.lit(0).cast("bigint"), "late": F.lit(1)})
    told = ahead.unionByName(told).repartitionById(parts, F.col("part"))
    told = told.sortWithinPartitions(*order, "late", "at").drop("mark", "part", "at")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo, done = bytearray(), 0
        for batch in batches:
            found, at = [], []
            columns = (batch.column(c).to_pylist() for c in ("role", "text", "steps"))
            for i, (said, content, codes) in enumerate(zip(*columns)):
                if codes is not None:
                    todo, done = todo[done:] + codes, 0
                    continue
                at.append(i)
                found.append(mended(said, content, todo[done]))
                done += 1
            if found:
                own = batch.select(["conversation", "turn", "role"]).take(pa.array(at, pa.int64()))
                columns = [pa.array(c, t) for c, t in zip(zip(*found), _KINDS)]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=out)

    out = [conversation, turn, role, "action", "new_role", "put_in", "closes", "rendered"]
    return told.mapInArrow(
        mend,
        f"{ticked(conversation)} {kinds['conversation']}, {ticked(turn)} {kinds['turn']}, "
        f"{ticked(role)} {kinds['role']}, {_SCHEMA}",
    )


_KINDS = (pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string())


def _chosen(keys: DataFrame, cuts: dict[tuple[int, str], tuple[int | None, int | None]]) -> DataFrame:
    """The steps of all turns, a byte each: rows of up to STEPS turns, with the columns of the first
    of them and the number of the row in its range as `at`."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: list[pa.RecordBatch] = []
        codes = bytearray()
        path, name, part, n = None, None, None, 0
        for batch in batches:
            names, roles = batch.column("name").to_pylist(), batch.column("role").to_pylist()
            for i, (own, role) in enumerate(zip(names, roles)):
                if n % STEPS == 0:
                    firsts.append(batch.take(pa.array([i])))  # a copy, not the batch
                if path is None or own != name:
                    if path is not None:
                        enters = cuts.get((part, "first"), (None, None))[0] if not codes else None
                        codes += path.codes(enters, None)
                    else:
                        part = batch.column("part")[0].as_py()
                    name = own
                    path = Path(cuts.get((part, "first"), (None, None))[0] if not codes else None)
                path.add(_plain(role))
                n += 1
        if path is None:
            return
        alone = not codes
        enters = cuts.get((part, "first"), (None, None))[0] if alone else None
        codes += path.codes(enters, cuts.get((part, "last"), (None, None))[1])
        stretches = [bytes(codes[i : i + STEPS]) for i in range(0, len(codes), STEPS)]
        table = pa.Table.from_batches(firsts).drop_columns(["name"]).combine_chunks()
        table = table.append_column("steps", pa.array(stretches, pa.binary()))
        table = table.append_column("at", pa.array(range(len(stretches)), pa.int64()))
        yield from table.to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in keys.schema.fields if f.name != "name"}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return keys.mapInArrow(choose, f"{schema}, steps binary, at bigint")


def _pieces(keys: list) -> Iterator[tuple[int, int]]:
    """Where each conversation begins and ends within a partition."""
    start = 0
    for _, group in itertools.groupby(keys):
        stop = start + sum(1 for _ in group)
        yield start, stop
        start = stop


def _edge_pieces(placed: DataFrame) -> list[dict]:
    """Of each partition, the first and the last conversation's piece as one matrix: at
    most two rows a partition are collected, whatever the size of the data."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[dict] = []
        for batch in batches:
            keys, roles = batch.column("name").to_pylist(), batch.column("role").to_pylist()
            for start, stop in _pieces(keys):
                if not edges or edges[-1]["key"] != keys[start]:
                    del edges[1:]  # only the first and the last piece count
                    part = batch.column("part")[0].as_py()
                    edges.append({"part": part, "key": keys[start], "matrix": _identity()})
                for role in roles[start:stop]:
                    edges[-1]["matrix"] = _times(edges[-1]["matrix"], _matrix(_plain(role)))
        if edges:
            for i, edge in enumerate(edges):
                edge["last"] = i > 0 or len(edges) == 1
                edge["first"] = i == 0
                edge["matrix"] = edge["matrix"].ravel().tolist()
            yield pa.RecordBatch.from_pylist(edges, schema=_EDGES)

    found = placed.select("part", "name", "role").mapInArrow(
        matrices, "part int, key string, matrix array<bigint>, first boolean, last boolean"
    )
    return sorted((row.asDict() for row in found.collect()), key=lambda e: (e["part"], not e["first"]))


_EDGES = pa.schema(
    [
        ("part", pa.int32()),
        ("key", pa.string()),
        ("matrix", pa.list_(pa.int64())),
        ("first", pa.bool_()),
        ("last", pa.bool_()),
    ]
)


def _states_at_cuts(edges: list[dict]) -> dict[tuple[int, str], tuple[int | None, int | None]]:
    """For each partition's edge pieces the states they enter and leave with; None where
    the conversation begins or ends there."""
    cuts: dict[tuple[int, str], tuple[int | None, int | None]] = {}
    i = 0
    while i < len(edges):
        run = [edges[i]]
        # A conversation goes on if it is last in one partition and first in the next.
        while i + 1 < len(edges) and run[-1]["last"] and edges[i + 1]["first"] and edges[i + 1]["key"] == run[-1]["key"]:
            i += 1
            run.append(edges[i])
        i += 1
        if len(run) == 1:
            continue
        matrices = [np.array(e["matrix"]).reshape(STATES, STATES) for e in run]
        costs = [_begin()]
        for matrix in matrices:
            costs.append((costs[-1][:, None] + matrix).min(axis=0))
        states = [int(np.argmin(costs[-1] + _ending()))]
        for before, matrix in zip(reversed(costs[:-1]), reversed(matrices)):
            states.append(int(np.argmin(before + matrix[:, states[-1]])))
        states.reverse()
        for j, edge in enumerate(run):
            enters = states[j] if j else None
            leaves = states[j + 1] if j + 1 < len(run) else None
            for name in ("first", "last"):
                if edge[name]:
                    cuts[edge["part"], name] = (enters, leaves)
    return cuts


def _plain(role: str | None) -> str | None:
    name = (role or "").strip().lower()
    return name if name in ROLES else None


@functools.cache
def _steps(role: str | None) -> tuple[tuple[int, int, int, bool, tuple[str, ...]], ...]:
    """All ways to take a turn: state before, state after, cost, merged, empty messages."""
    ways = []
    for before in range(STATES):
        for after in range(1, STATES):
            name = ROLES[after - 1]
            relabel = 0 if name == role else RELABEL[role, name]
            if after == before:
                ways.append((before, after, relabel + MERGE, True, ()))
            # Up to two empty messages lead from any state to any legal next one.
            for between in ((), *((s,) for s in (1, 2, 3)), *itertools.product((1, 2, 3), repeat=2)):
                path = (before, *between, after)
                if all(b in _NEXT[a] for a, b in itertools.pairwise(path)):
                    names = tuple(ROLES[s - 1] for s in between)
                    ways.append((before, after, relabel + EMPTY * len(between), False, names))
    best = {}
    for way in sorted(ways, key=lambda w: (w[2], len(w[4]), not w[3], w[4])):
        best.setdefault(way[:2], way)
    return tuple(best.values())


@functools.cache
def _matrix(role: str | None) -> np.ndarray:
    matrix = np.full((STATES, STATES), _FAR, dtype=np.int64)
    for before, after, cost, *_ in _steps(role):
        matrix[before, after] = cost
    return matrix


def _identity() -> np.ndarray:
    return np.where(np.eye(STATES, dtype=bool), 0, _FAR)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), _FAR)


def _begin() -> np.ndarray:
    return np.array([0, _FAR, _FAR, _FAR], dtype=np.int64)


def _ending() -> np.ndarray:
    """What it costs to end: nothing after the assistant, else empty messages."""
    return np.array([0, 2 * EMPTY, EMPTY, 0], dtype=np.int64)


class Path:
    """The cheapest ways to every state, turn by turn, in a few bytes a turn."""

    def __init__(self, enters: int | None = None) -> None:
        self.cost = [_FAR] * STATES
        self.cost[0 if enters is None else enters] = 0
        # For each turn and state after it the state before.
        self.back = bytearray()

    def add(self, role: str | None) -> None:
        after, before = [_FAR] * STATES, [0] * STATES
        # Equal sums: the smaller state.
        for step in _steps(role):
            total = self.cost[step[0]] + step[2]
            if total < after[step[1]] or (total == after[step[1]] < _FAR and step[0] < before[step[1]]):
                after[step[1]], before[step[1]] = total, step[0]
        self.cost = after
        self.back += bytes(before)

    def end(self, leaves: int | None = None) -> tuple[int, int]:
        """Cost and last state."""
        if leaves is not None:
            return self.cost[leaves], leaves
        ends = [c + e for c, e in zip(self.cost, _ending().tolist())]
        return min(ends), ends.index(min(ends))

    def codes(self, enters: int | None, leaves: int | None) -> bytearray:
        """The steps of all turns, see `mended`."""
        state = self.end(leaves)[1]
        n = len(self.back) // STATES
        codes = bytearray(n)
        for i in range(n - 1, -1, -1):
            before = self.back[STATES * i + state]
            codes[i] = state | before << _BEFORE
            state = before
        if enters is None:
            codes[0] |= _OPENS
        if leaves is None:
            codes[-1] |= _CLOSES
        return codes


def cheapest(
    roles: list[str | None], enters: int | None = None, leaves: int | None = None
) -> tuple[int, list[tuple[int, int, int, bool, tuple[str, ...]]], int]:
    """Cost, the step of every turn and the last state."""
    path = Path(enters)
    for role in roles:
        path.add(_plain(role))
    total, last = path.end(leaves)
    steps = [_step(_plain(role), code) for role, code in zip(roles, path.codes(enters, leaves))]
    return total, steps, last


@functools.cache
def _step(role: str | None, code: int) -> tuple[int, int, int, bool, tuple[str, ...]]:
    before, after = code >> _BEFORE & 3, code & 3
    return next(step for step in _steps(role) if step[:2] == (before, after))


def mended(role: str | None, text: str | None, code: int) -> tuple[str, str, list[str], bool, str]:
    """The output columns of one turn and its step."""
    plain = _plain(role)
    _, after, _, merged, between = _step(plain, code)
    name, closes = ROLES[after - 1], bool(code & _CLOSES)
    if merged:
        piece = "\n" + (text or "")
    else:
        piece = "" if code & _OPENS else f"{END}\n"
        piece += "".join(f"{START}{r}\n{END}\n" for r in between)
        piece += f"{START}{name}\n{text or ''}"
    if closes:
        piece += f"{END}\n"
        missing = {1: ("user", "assistant"), 2: ("assistant",)}.get(after, ())
        piece += "".join(f"{START}{r}\n{END}\n" for r in missing)
    action = ", ".join(x for x in ("merge" if merged else "", "" if plain == name else "relabel") if x) or "keep"
    return action, name, list(between), closes, piece


def repaired(
    roles: list[str | None], texts: list[str | None], enters: int | None, leaves: int | None
) -> list[tuple[str, str, list[str], bool, str]]:
    """The output columns of a piece of a conversation."""
    path = Path(enters)
    for role in roles:
        path.add(_plain(role))
    return [mended(r, t, c) for r, t, c in zip(roles, texts, path.codes(enters, leaves))]
