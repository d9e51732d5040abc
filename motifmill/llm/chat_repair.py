"""Repair of conversations by a rank-convergence parallel Viterbi search.

The roles' initials of a conversation must read `(s?(ua)+)?`. Turns are kept, given another role, deleted, or inserted, and the search
over the four states of that automaton finds the cheapest edits. Its recursion runs backwards: V(i, s) is the least cost of the turns
from i on in state s. Conversations are cut into chunks of at most 2**CHUNK_BITS turns, whatever their length:

1. Every chunk starts from a speculative vector, that of a conversation's end, so whole conversations are done at once.
2. In a fix-up pass a chunk whose right neighbour came out with another vector reruns from that one, until the new vectors differ from
   the old ones by a constant only; the rest of the chunk is then shifted by it. Passes go on until all neighbours agree. A pass deals
   with runs of neighbouring chunks one after another (64, then 4096), so that even turns that never converge take few passes.
3. The backward costs, stitched together, drive the tracing: in each state the edit whose letter is least (D, I, K, R) of those that keep
   the cost is taken. Chunks are traced from all entry states, entries are stitched by the same passes, and only then edits are written.

A chunk is one byte a turn in these passes; texts meet the edits once, at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import small_batches, stored

#: Turns of a chunk as a power of two, and chunks that the first and the other fix-up passes deal with one after another.
CHUNK_BITS = 9
RUNS = (64, 4096)
#: Costs of the edits, and of a cut-off turn that isn't deleted.
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: Chunks that are searched together.
SIDE_BY_SIDE = 1024
#: Letters of a text whose order decides in which partition of the sort a turn goes; within it the whole text counts.
ORDER_LETTERS = 64
SPACES = " \t\n\x0b\x0c\r"

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a; role classes: 0 s, 1 u, 2 a, 3 other
_NEXT = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}
_ASKED = np.array([2, 2, 3, 2])  # the state after an inserted or reroled turn
_FAR = 1 << 40
_END = np.array([0, 2 * INSERT, INSERT, 0])
_KEEP = np.array([[_NEXT[s].get(c, -1) for s in range(4)] for c in range(4)])
#: Edits in the order of their letters.
D, I, K, R = range(4)  # noqa: E741


def _closure() -> np.ndarray:
    out = np.full((4, 4), _FAR)
    for s in range(4):
        at, cost = s, 0
        for _ in range(4):
            out[s, at] = min(out[s, at], cost)
            at, cost = _ASKED[at], cost + INSERT
    return out


def _edits() -> np.ndarray:
    """Least cost of one turn's edit by code (role class + 4 x kind), state and next state, inserts before it included."""
    out = np.full((12, 4, 4), _FAR)
    for code in range(12):
        role, kind = code % 4, code // 4
        for s in range(4):
            out[code, s, s] = DELETE
            if kind < 2:
                out[code, s, _ASKED[s]] = min(out[code, s, _ASKED[s]], REROLE + CUT_OFF * kind)
                if _KEEP[role, s] >= 0:
                    out[code, s, _KEEP[role, s]] = min(out[code, s, _KEEP[role, s]], CUT_OFF * kind)
    return (_closure()[None, :, :, None] + out[:, None, :, :]).min(2)


_STEP = _edits()


class _Batch:
    """Chunks side by side, the longest first, so that those still running are a prefix."""

    def __init__(self, codes: list[np.ndarray]):
        self.size = np.fromiter(map(len, codes), np.int64, len(codes))
        self.order = np.argsort(-self.size, kind="stable")
        self.sorted = self.size[self.order]
        width = int(self.size.max(initial=0))
        self.codes = np.zeros((width, len(codes)), np.int64)
        for i, o in enumerate(self.order.tolist()):
            self.codes[: len(codes[o]), i] = codes[o]

    def running(self, step: int) -> int:
        return int(np.searchsorted(-self.sorted, -step, "left"))

    def backward(self, ends: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The vectors at the chunks' starts, and with `keep` those at every turn: (turn, chunk, state)."""
        now, width = ends[self.order].copy(), len(self.codes)
        every = np.zeros((width + 1, len(now), 4), np.int64) if keep else None
        if keep:
            every[self.sorted, np.arange(len(now))] = now
        for i in range(width - 1, -1, -1):
            n = self.running(i)
            now[:n] = (_STEP[self.codes[i, :n]] + now[:n, None, :]).min(2)
            if keep:
                every[i, :n] = now[:n]
        out = np.empty_like(now)
        out[self.order] = now
        return out, every

    def forward(self, ends: np.ndarray, entry: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Traces (chunk, entry state) columns of `entry`: the states after the chunks, and with `keep` each turn's edit code
        (state + 4 x inserts before + 16 x edit) of the first column."""
        _, every = self.backward(ends, keep=True)
        state, out = entry[self.order].copy(), np.zeros((len(self.codes), len(entry)), np.int8)
        for i in range(len(self.codes)):
            n = self.running(i)
            role, kind = self.codes[i, :n, None] % 4, self.codes[i, :n, None] // 4
            here, after, first = every[i, :n], every[i + 1, :n], state[:n].copy()
            at, inserts, edit = first.copy(), np.zeros_like(first), np.full_like(first, -1)
            cost = lambda table, s: np.take_along_axis(table, s, 1)
            for _ in range(4):
                open_ = edit < 0
                edit = np.where(open_ & (DELETE + cost(after, at) == cost(here, at)), D, edit)
                more = (edit < 0) & (INSERT + cost(here, _ASKED[at]) == cost(here, at))
                keeps = _KEEP[role, at]
                kept = (edit < 0) & ~more & (kind < 2) & (keeps >= 0) & (CUT_OFF * kind + cost(after, np.maximum(keeps, 0)) == cost(here, at))
                edit = np.where(kept, K, np.where((edit < 0) & ~more & ~kept, R, edit))
                at, inserts = np.where(more, _ASKED[at], at), inserts + more
            state[:n] = np.where(edit == D, at, np.where(edit == K, _KEEP[role, at], _ASKED[at]))
            out[i, :n] = (first + 4 * inserts + 16 * edit)[:, 0]
        exits, place = np.empty_like(state), np.empty(len(state), np.int64)
        exits[self.order], place[self.order] = state, np.arange(len(state))
        return exits, [out[:m, p] for m, p in zip(self.size.tolist(), place.tolist(), strict=True)] if keep else []


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SIDE_BY_SIDE):
            yield b.slice(at, SIDE_BY_SIDE)


def _lists(column: pa.Array) -> list[np.ndarray]:
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _normal(v: np.ndarray) -> np.ndarray:
    return v - v[:, 3:]


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        v, _ = _Batch(_lists(b.column("codes"))).backward(np.repeat(_END[None], b.num_rows, 0))
        own = [pa.array([_END.tolist()] * b.num_rows), pa.array(_normal(v).tolist()), pa.array(v[:, 3]), b.column("codes")]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("rank"), b.column("chunks"), *own], _NAMES)


def _rerun(codes: np.ndarray, old: np.ndarray, new: np.ndarray, old_out: np.ndarray, old_cost: int) -> tuple[np.ndarray, int]:
    """The outcome of a chunk from the vector `new`, given that from `old`: both run until they differ by a constant."""
    a, b = old.copy(), new.copy()
    for code in codes[::-1]:
        gap = b - a
        if (gap == gap[0]).all():
            return old_out, old_cost + int(gap[0])
        a, b = (_STEP[code] + a[None, :]).min(1), (_STEP[code] + b[None, :]).min(1)
    return b - b[3], int(b[3])


def _stitch(state: DataFrame, forward: bool, redo: Callable[[dict, np.ndarray], tuple[list[int], int]]) -> DataFrame:
    """Fix-up passes over (key, rank, chunks, inp, out, cost, data) until each chunk's `inp` is its neighbour's `out` (that of the
    chunk before if `forward`, else that after)."""
    side = -1 if forward else 1

    def fix(key: tuple, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ascending=forward)
        given = list(edges["edge"].iloc[0]) if len(edges) else None
        out = []
        for row in rows.to_dict("records"):
            if given is not None and list(row["inp"]) != given:
                row["out"], row["cost"] = redo(row, np.array(given))
                row["inp"] = given
            given = list(row["out"])
            out.append(row)
        return pd.DataFrame(out, columns=rows.columns)

    for turn in range(1 << 30):
        found = state.select("key", (F.col("rank") - side).alias("rank"), F.col("out").alias("edge"))
        if state.select("key", "rank", "inp").join(found, ["key", "rank"]).where("inp <> edge").isEmpty():
            return state
        width = RUNS[min(turn, len(RUNS) - 1)]
        run = F.floor(F.col("rank") / width).cast("long")
        last = (F.col("rank") % width) == (width - 1 if forward else 0)
        edges = state.where(last).select("key", (run - side).alias("run"), F.col("out").alias("edge"))
        names = [c for c in state.columns]
        state = stored(state.withColumn("run", run).groupBy("key", "run").cogroup(edges.groupBy("key", "run")).applyInPandas(_without_run(fix, names), state.schema), "fixed")
    return state


def _without_run(fix: Callable, names: list[str]) -> Callable:
    def call(key: tuple, rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        return fix(key, rows[names], edges)

    return call


def _vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(len(column), -1)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each chunk for all four entries. Speculation: a chunk is entered after an assistant's turn."""
    for b in _slices(batches):
        n = b.num_rows
        exits, _ = _Batch(_lists(b.column("data"))).forward(_vectors(b.column("inp")), np.repeat(np.arange(4)[None], n, 0))
        guess = np.where(b.column("rank").to_numpy() > 0, 3, 0)
        own = [pa.array(guess[:, None].tolist()), pa.array(exits[np.arange(n), guess][:, None].tolist()), pa.array(np.zeros(n, np.int64)), pa.array(exits.tolist(), pa.list_(pa.int8()))]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("rank"), b.column("chunks"), *own], _NAMES)


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        exits, edits = _Batch(_lists(b.column("data"))).forward(_vectors(b.column("inp")), b.column("entry").to_numpy()[:, None], keep=True)
        rank, out = b.column("rank").to_numpy(), _vectors(b.column("out"))
        ended = np.where(rank == b.column("chunks").to_numpy() - 1, exits[:, 0], 0).astype(np.int32)
        own = [pa.array(b.column("cost").to_numpy() + np.where(rank == 0, out[:, 0], 0)), pa.array(ended), pa.array([e.tolist() for e in edits], pa.list_(pa.int8()))]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("rank"), b.column("chunks"), *own], ["key", "rank", "chunks", "cost", "ended", "edits"])


_NAMES = ["key", "rank", "chunks", "inp", "out", "cost", "data"]
_STATE = "key string, rank long, chunks long, inp array<long>, out array<long>, cost long, data array<tinyint>"


def _plain(row: dict, given: np.ndarray) -> tuple[list[int], int]:
    out, cost = _rerun(np.array(row["data"], np.int64), np.array(row["inp"]), given, np.array(row["out"]), int(row["cost"]))
    return out.tolist(), cost


def _looked_up(row: dict, given: np.ndarray) -> tuple[list[int], int]:
    return [int(row["data"][int(given[0])])], 0


def search(chunks: DataFrame) -> DataFrame:
    """chunks: (key, rank, chunks, codes): a conversation's turns as codes, in chunks numbered from 0. For each chunk: (key, rank,
    chunks, cost, ended, edits): its part of the least cost, the state after the last chunk (else 0) and the turns' edit codes."""
    small_batches(chunks.sparkSession)
    state = stored(chunks.select("key", "rank", "chunks", "codes").mapInArrow(_speculate, _STATE), "vectors")
    single = state.where("chunks = 1").withColumn("entry", F.lit(0).cast("long"))
    several = _stitch(stored(state.where("chunks > 1"), "vectors"), False, _plain)
    entries = _stitch(stored(several.mapInArrow(_exits, _STATE), "exits"), True, _looked_up)
    several = several.join(entries.select("key", "rank", F.col("inp")[0].alias("entry")), ["key", "rank"])
    return single.unionByName(several).mapInArrow(_traces, "key string, rank long, chunks long, cost long, ended int, edits array<tinyint>")


def _inserted(state: int, n: int) -> list[str]:
    roles = []
    for _ in range(n):
        roles.append("user" if _ASKED[state] == 2 else "assistant")
        state = _ASKED[state]
    return roles


def _of_code(code: Column, value: Callable[[int, int, int], list[str] | str | None]) -> Column:
    """A constant for each edit code, from its state, inserts and edit."""
    values = [value(c % 4, c // 4 % 4, c // 16) for c in range(64)]
    return F.get(F.array(*[F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v).cast("string") for v in values]), code.cast("int"))


def _rerole(state: int, inserts: int, edit: int) -> str | None:
    for _ in range(inserts):
        state = _ASKED[state]
    return _inserted(state, 1)[0] if edit == R else None


def _key() -> Column:
    """A conversation's id as text that isn't null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")


def laid_out(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns: (conv_id, turn, role, text), no nulls in role and text. Two stored tables with a row for each:

    - (key, conv_id, at, role, text): `at` ascends by conversation, turn (null first), role and text;
    - (key, at, turn, role_class, fault): the first fault, `blank`, `duplicate` (of an earlier turn's role and text), `truncated` or null.
    """
    order = ["key", F.col("turn").asc_nulls_first(), "role"]
    laid = turns.select("conv_id", _key(), "turn", "role", "text")
    laid = laid.repartitionByRange(*order, F.substring("text", 1, ORDER_LETTERS)).sortWithinPartitions(*order, "text")
    laid = stored(laid.withColumn("at", F.monotonically_increasing_id()), "turns")
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    facts = laid.select(
        "key", "at", "turn", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("role_class"), (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"), F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("same"),
    )
    facts = stored(facts, "facts")
    seen = facts.where("not blank").groupBy("key", "same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = facts.where("not blank").select("key", "same", "at").join(stored(seen, "seen"), ["key", "same"]).where("at > first").select("at", F.lit(True).alias("later"))
    fault = F.when(F.col("blank"), "blank").when(F.col("later"), "duplicate").when(F.col("cut"), "truncated")
    return laid, stored(facts.join(stored(later, "later"), "at", "left").select("key", "at", "turn", "role_class", fault.alias("fault")), "faults")


def chunked(faults: DataFrame) -> DataFrame:
    """(key, cell, rank, chunks, codes, blank, duplicate, truncated): chunks of neighbouring turns with their numbers of faults."""
    fault = lambda name: F.sum((F.coalesce(F.col("fault"), F.lit("")) == name).cast("long")).alias(name)
    code = (F.col("role_class") + F.when(F.col("fault") == "truncated", 4).when(F.col("fault").isNotNull(), 8).otherwise(0)).cast("tinyint")
    members = F.sort_array(F.collect_list(F.struct("at", code.alias("code"))))  # at most 2**CHUNK_BITS
    chunks = faults.groupBy("key", F.shiftright("at", CHUNK_BITS).alias("cell")).agg(F.transform(members, lambda x: x["code"]).alias("codes"), fault("blank"), fault("duplicate"), fault("truncated"))
    return stored(numbered(chunks, ["key"], "cell", name="rank", size="chunks"), "chunks")


def illegal_pairs(chunks: DataFrame) -> DataFrame:
    """(key, illegal) of every chunk, and of the turns on both sides of two chunks: neighbours that are no su, ua or au."""
    bad = lambda a, b: (~(a % 4 * 10 + b % 4).isin(1, 12, 21)).cast("long")
    after = F.slice("codes", F.lit(2), F.size("codes"))
    flags = F.zip_with("codes", after, lambda a, b: F.coalesce(bad(a, b), F.lit(0).cast("long")))
    inside = chunks.select("key", F.aggregate(flags, F.lit(0).cast("long"), lambda x, y: x + y).alias("illegal"))
    several = chunks.where("chunks > 1")
    heads = several.select("key", (F.col("rank") - 1).alias("rank"), F.col("codes")[0].alias("head"))
    across = several.select("key", "rank", F.element_at("codes", -1).alias("last")).join(heads, ["key", "rank"])
    return inside.unionByName(across.select("key", bad(F.col("last"), F.col("head")).alias("illegal")))


def repaired_chunks(laid: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, rank, chunks, cost, turns): the turns of each chunk in order as (edit, role, text, at); deleted ones have no role, inserted
    ones no `at`."""
    found = stored(search(chunks), "edits").join(chunks.select("key", "rank", "cell"), ["key", "rank"])
    rows = laid.groupBy("key", F.shiftright("at", CHUNK_BITS).alias("cell")).agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("rows"))
    turn = lambda edit, role, text, at: F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"), at.alias("at"))
    new = lambda roles: F.transform(roles, lambda x: turn(F.lit("I"), x, F.lit(""), F.lit(None).cast("long")))

    def of_row(row: Column, code: Column) -> Column:
        letter = _of_code(code, lambda s, n, e: "DIKR"[e])
        role = F.when(letter == "K", row["role"]).otherwise(_of_code(code, _rerole))
        return F.concat(new(_of_code(code, lambda s, n, e: _inserted(s, n))), F.array(turn(letter, role, row["text"], row["at"])))

    ends = F.get(F.array(*[F.array(*map(F.lit, _inserted(s, int(_END[s]) // INSERT))).cast("array<string>") for s in range(4)]), F.col("ended"))
    turns = F.concat(F.flatten(F.zip_with("rows", "edits", of_row)), new(ends))
    return rows.join(found, ["key", "cell"]).select("key", "rank", "chunks", "cost", turns.alias("turns"))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, chunk, place, edit, role, text), ordered by chunk and place within a conversation. `edit` is
    K (kept), R (another role) or I (inserted)."""
    laid, faults = laid_out(turns)
    ids = laid.groupBy("key").agg(F.max("conv_id").alias("conv_id"))
    out = repaired_chunks(laid, chunked(faults)).select("key", F.col("rank").alias("chunk"), F.posexplode("turns").alias("place", "turn"))
    return out.where("turn.role is not null").join(ids, "key").select("conv_id", "chunk", "place", "turn.edit", "turn.role", "turn.text")


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the newline-joined payloads of each key, which come in order; null payloads have no lines."""
    key, state, begun = None, None, False
    give = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], ["key", "repaired_sha256"])
    for b in batches:
        for k, payload in zip(b.column("key").to_pylist(), b.column("payload"), strict=True):
            if k != key:
                if key is not None:
                    yield give()
                key, state, begun = k, sha256(), False
            if payload.is_valid:
                state.update((b"\n" if begun else b"") + payload.as_py().encode())
                begun = True
    if key is not None:
        yield give()


def repair(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations` (null is one): (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), from the faults in `turns` (conv_id, turn, role, text; no null role or text) and their cheapest repair.

    Of equally cheap repairs the one with the ASCII-least audit counts. Turns of the same number are ordered by role and text; equal
    ones repeat each other. A role whose initial is no s, u or a can't be kept. Without turns: zeros, an empty audit, and the digest of
    nothing; an empty table gives no rows. Other columns of the tables aren't read.

    Scale: a conversation of any length is spread over chunks; only its digest (SHA-256 can't be computed in parts) streams through
    one task, and its audit is one value. Turns that are equal in number, role and their text's first ORDER_LETTERS letters are
    sorted by one task.
    """
    small_batches(turns.sparkSession)
    laid, faults = laid_out(turns)
    chunks = chunked(faults)
    all_edits = F.array_join(F.transform("turns", lambda x: x["edit"]), "")
    lines = F.transform(F.filter("turns", lambda x: x["role"].isNotNull()), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    pieces = stored(repaired_chunks(laid, chunks).select("key", "rank", "chunks", "cost", all_edits.alias("audit"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("payload")), "pieces")
    several = pieces.where("chunks > 1").select("key", "rank", "payload").repartition("key").sortWithinPartitions("key", "rank")
    digests = several.select("key", "payload").mapInArrow(_streamed_digests, "key string, repaired_sha256 string")
    whole = F.when(F.col("chunks") == 1, F.sha2(F.coalesce("payload", F.lit("")), 256))
    parts = [
        conversations.select("conv_id").distinct().withColumn("key", _key()), faults.select("key", "turn").distinct(), chunks.select("key", "blank", "duplicate", "truncated"), illegal_pairs(chunks),
        pieces.select("key", "cost", "rank", "audit", whole.alias("repaired_sha256")), digests,
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)
    audits = F.sort_array(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("rank", "audit"))))
    return every.groupBy("key").agg(
        F.max("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *map(total, ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(audits, lambda x: x["audit"]), "").alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    ).drop("key")


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with planted faults by crc32(`conv_id:turn`) % 20: 0 is dropped, 1 loses its text, 2 its `.`, `!` and `?`, 3 comes
    twice, 4 becomes a user's. A null role, text, or part of that key is one space."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat_ws(":", spaced["conv_id"], spaced["turn"])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced["text"], ".!?", "")).otherwise(spaced["text"])
    rows = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced["role"]).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("__copy")).drop("__copy")
