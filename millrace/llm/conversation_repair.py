"""Conversation structure repair: which turns to keep, rerole, delete or insert, at least cost, so that roles alternate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_saved, saved, sent_if_small

#: Turns of a conversation that one step of a task holds, and blocks (or groups of blocks) that one group of the
#: tree over a long conversation holds; results hang on neither.
BLOCK = 512
#: What ends a sentence; what counts as white space.
ENDS, BLANKS = ".!?", " \t\n\x0b\f\r"
#: Costs of edits, and what a truncated turn adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What the repaired roles have reached: nothing, a system turn, a user's turn, an assistant's turn.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The turn that may follow each state without an insert; at most one insert stands between two kept turns.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What each state still needs at the end: (cost, edits).
_CLOSING = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
_LEGAL = {"su", "ua", "au"}
KEY = ("conv_id", "turn", "role", "text")

COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
#: A repaired block; {} is the type of conv_id.
PIECES = f"conv_id {{}}, block long, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, first string, last string, audit string, turns array<struct<edit: string, role: string, text: string>>"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 dropped, 2 repeated) after the damage that crc32(`conv_id:turn`) % 20 names; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(space("text"), ENDS, "")).otherwise(space("text"))
    return turns.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


# One block of turns


def _step(initial: str, truncated: bool) -> dict:
    """A turn that may stay, as state -> [(next state, cost less a deletion, edits)]: deleted, kept or reroled, with the insert that its role pair needs."""
    out = {}
    for was in STATES:
        ways = [(was, 0, "D")]
        for to in (SYSTEM, USER, ASSISTANT):
            keep = initial == {SYSTEM: "s", USER: "u", ASSISTANT: "a"}[to]
            if to == SYSTEM and (not keep or was != NOTHING):
                continue
            insert = to != SYSTEM and _NEXT[was] != to
            cost = insert * INSERT + (not keep) * REROLE + truncated * TRUNCATED - DELETE
            ways.append((to, cost, "I" * insert + "RK"[keep]))
        out[was] = ways
    return out


_STEPS = {(i, t): _step(i, t) for i in ("s", "u", "a", "") for t in (False, True)}


def fold(steps: Iterable[dict], start: int) -> tuple[dict, list]:
    """({state: (cost, rank)}, back) of the cheapest ways from start through all steps; equal costs go to the least edits.

    Each state keeps the running minimum of what it costs to be there. No list of edits is the beginning of another at
    the same step, so lists are compared by the rank of what they come from, then by the step's own edits (or its rank).
    """
    best, back = {start: (0, 0)}, []
    for step in steps:
        found: dict = {}
        for was, (cost, rank) in best.items():
            for to, more, edits in step[was]:
                way = (cost + more, rank, edits, was)
                if to not in found or way < found[to]:
                    found[to] = way
        order = sorted(found, key=lambda s: found[s][1:3])
        best = {s: (found[s][0], i) for i, s in enumerate(order)}
        back.append({s: found[s][2:] for s in order})
    return best, back


def path(back: list, end: int) -> list:
    """(state before, edits) of every step on the way to end."""
    out = []
    for ways in reversed(back):
        edits, end = ways[end]
        out.append((end, edits))
    return out[::-1]


def ending(best: dict) -> tuple[int, int]:
    """(state, cost) where it is cheapest to end, closing inserts included."""
    ways = [(cost + _CLOSING[s][0], rank, _CLOSING[s][1], s) for s, (cost, rank) in best.items()]
    cost, _, _, s = min(ways)
    return s, cost


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a text: b(lank), d(uplicate), t(runcated) or none."""
    left = text.rstrip(BLANKS)
    return "b" if not left else "d" if seen else "t" if left[-1] not in ENDS else ""


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def steps_of(turns: list[tuple[str, str]]) -> list[dict]:
    """Steps of the (role initial, fault) that may stay; others only add to the sum of deletions."""
    return [_STEPS[i, f == "t"] for i, f in turns if f not in ("b", "d")]


def block_matrix(turns: list[tuple[str, str]]) -> dict:
    """state -> [(next state, cost, rank)] of a whole block: what fold() takes as one step."""
    steps, deleted = steps_of(turns), DELETE * len(turns)
    return {s: [(to, cost + deleted, rank) for to, (cost, rank) in fold(steps, s)[0].items()] for s in STATES}


def repaired_turns(rows: list[tuple[str, str]], faults: list[str], start: int, end: int | None) -> tuple[list, str, int, int]:
    """(repaired turns, edits, cost, state at the end) of a block between two states, or from start to the best end."""
    best, back = fold(steps_of([(_initial(r), f) for (r, _), f in zip(rows, faults, strict=True)]), start)
    last = end is None
    if last:
        end, _ = ending(best)
    ways = iter(path(back, end))
    out, edits, state = [], [], start
    for (role, text), fault in zip(rows, faults, strict=True):
        own = "D" if fault in ("b", "d") else next(ways)[1]
        edits.append(own)
        if own[0] == "I":
            state = _NEXT[state]
            out.append(("I", _ROLES[state], ""))
        if own[-1] == "R":
            state = _NEXT[state]
            out.append(("R", _ROLES[state], text))
        elif own[-1] == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            out.append(("K", role, text))
    cost = best[end][0] + DELETE * len(rows)
    if last:
        cost += _CLOSING[end][0]
        edits.append(_CLOSING[end][1])
        for _ in _CLOSING[end][1]:
            state = _NEXT[state]
            out.append(("I", _ROLES[state], ""))
    return out, "".join(edits), cost, end


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _told(rows: list[tuple[str, str]], faults: list[str], start: int, end: int | None) -> tuple:
    """The counts, ends, edits and repaired turns of a block, as PIECES has them after gaps."""
    out, audit, cost, _ = repaired_turns(rows, faults, start, end)
    initials = [role[:1] for role, _ in rows]
    ends = (initials[0], initials[-1]) if rows else (None, None)
    return (*[faults.count(f) for f in "bdt"], illegal_pairs(initials), cost, *ends, audit, [{"edit": e, "role": r, "text": x} for e, r, x in out])


# Conversations of one block


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _groups(parts: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """(key, columns as lists) of each run of rows with equal first columns."""
    key, held = None, None
    for part in parts:
        columns = [c.to_pylist() for c in part.columns]
        for row in zip(*columns, strict=True):
            if held is None or row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _arrow(text: str) -> pa.Schema:
    """For use on the driver, which has the parser."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(text))


def _short(rows: DataFrame) -> DataFrame:
    """Conversations of at most a block, dealt by conv_id and read in order, one at a time."""
    ddl = PIECES.format(_kind(rows, "conv_id"))
    schema = _arrow(ddl)

    def one(key: tuple, held: list) -> tuple:
        turns = [(turn, role, text) for turn, role, text, copies in held for _ in range(copies)]
        seen, faults = set(), []
        for _, role, text in turns:
            faults.append(fault_of(text, (role, text) in seen))
            seen.add((role, text))
        return (*key, 0, _gaps([t for t, _, _ in turns]), *_told([t[1:] for t in turns], faults, NOTHING, None))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((one(key, held) for key, held in _groups(parts, 1)), schema)

    dealt = rows.select(*KEY, "copies").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(run, ddl)


# Conversations of many blocks


def _numbered(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(conv_id, block, at, role, text, seen of every turn; gaps per conv_id): places come from counts per range part, so that no task holds a conversation.

    Equal rows are one row with their number until they have places, so many of them stand in nobody's way.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, earlier = F.col("turn").asc_nulls_first(), (Window.unboundedPreceding, -1)
    counted = rows.where("copies > 0").groupBy(*KEY).agg(F.sum("copies").alias("copies"))
    dealt = saved(counted.repartitionByRange(parts, F.col("conv_id"), first, F.col("role"), F.substring("text", 1, 256)).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("conv_id", "part").orderBy(first, "role", "text").rowsBetween(*earlier)
    base = dealt.groupBy(F.col("conv_id").alias("_conv"), F.col("part").alias("_part")).agg(F.sum("copies").alias("n"))  # one row per range part
    base = base.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("_conv").orderBy("_part").rowsBetween(*earlier)), F.lit(0)))
    placed = dealt.withColumn("in_part", F.coalesce(F.sum("copies").over(own), F.lit(0))).join(base, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    placed = saved(placed.select(*KEY, "copies", (F.col("base") + F.col("in_part")).alias("at")))
    drop_saved(dealt)
    least = placed.groupBy(F.col("conv_id").alias("_conv"), "role", F.sha2("text", 256).alias("digest")).agg(F.min("at").alias("_at")).select("_conv", "_at", F.lit(True).alias("new"))
    marked = placed.join(least, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("at") == F.col("_at")), "left")
    each = marked.select("conv_id", "role", "text", "new", F.posexplode(F.sequence(F.col("at"), F.col("at") + F.col("copies") - 1)).alias("k", "at"))
    turns = saved(each.select("conv_id", F.floor(F.col("at") / block).cast("long").alias("block"), "at", "role", "text", (F.col("new").isNull() | (F.col("k") > 0)).alias("seen")))
    gaps = saved(placed.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")))
    drop_saved(placed)
    return turns, gaps


_MATRIX = "costs array<long>, ranks array<long>"


def _flat(matrix: dict) -> tuple[list, list]:
    cells = {(s, to): (cost, rank) for s in STATES for to, cost, rank in matrix[s]}
    return tuple([cells.get((s, to), (None, None))[i] for s in STATES for to in STATES] for i in (0, 1))


def _unflat(costs: list, ranks: list) -> dict:
    return {s: [(to, costs[4 * s + to], ranks[4 * s + to]) for to in STATES if costs[4 * s + to] is not None] for s in STATES}


def _columns(parts: Iterator[pa.RecordBatch], *names: str) -> list[tuple]:
    """The rows of one bounded group, in order of their first column."""
    return sorted(zip(*[c.to_pylist() for c in pa.Table.from_batches(parts).select(names).columns], strict=True), key=lambda row: row[0])


def _long(rows: DataFrame, block: int) -> DataFrame:
    """Conversations of many blocks: a block is a matrix of costs between states, matrices multiply up a tree, and the best way comes down it.

    Each group holds at most `block` turns or matrices. The number of levels is the logarithm of the longest conversation.
    """
    conv = _kind(rows, "conv_id")
    nodes, ways, pieces = f"conv_id {conv}, node long, {_MATRIX}", f"conv_id {conv}, node long, came int, went int", PIECES.format(conv)
    of_nodes, of_ways, of_pieces = _arrow(nodes), _arrow(ways), _arrow(pieces)
    turns, gaps = _numbered(rows, block)
    keys = lambda key: tuple(k.as_py() for k in key)

    def leaf(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = block_matrix([(_initial(r), fault_of(x, s)) for _, r, x, s in _columns(parts, "at", "role", "text", "seen")])
        yield from _batches(iter([(*keys(key), *_flat(matrix))]), of_nodes)

    def product(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [_unflat(c, r) for _, c, r in _columns(parts, "node", "costs", "ranks")]
        matrix = {s: [(to, cost, rank) for to, (cost, rank) in fold(steps, s)[0].items()] for s in STATES}
        yield from _batches(iter([(*keys(key), *_flat(matrix))]), of_nodes)

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            best = [_unflat(c, r)[NOTHING] for c, r in zip(part["costs"].to_pylist(), part["ranks"].to_pylist(), strict=True)]
            ends = [ending({to: (cost, rank) for to, cost, rank in way})[0] for way in best]
            yield pa.RecordBatch.from_arrays([part["conv_id"], part["node"], pa.array([NOTHING] * len(ends), pa.int32()), pa.array(ends, pa.int32())], schema=of_ways)

    def spread(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _columns(parts, "node", "costs", "ranks", "came", "went")
        _, back = fold([_unflat(c, r) for _, c, r, _, _ in held], held[0][3])
        states = [s for s, _ in path(back, held[0][4])] + [held[0][4]]
        yield from _batches(((keys(key)[0], row[0], a, b) for row, a, b in zip(held, states, states[1:], strict=False)), of_ways)

    def piece(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _columns(parts, "at", "role", "text", "seen", "came", "went")
        faults = [fault_of(x, s) for _, _, x, s, _, _ in held]
        yield from _batches(iter([(*keys(key), 0, *_told([h[1:3] for h in held], faults, held[0][4], held[0][5]))]), of_pieces)

    up = F.floor(F.col("node") / max(block, 2)).cast("long")
    levels = [saved(turns.groupBy("conv_id", "block").applyInArrow(leaf, nodes))]
    while not levels[-1].where("node > 0").isEmpty():
        levels.append(saved(levels[-1].groupBy("conv_id", up.alias("above")).applyInArrow(product, nodes)))
    chosen = saved(levels[-1].mapInArrow(choose, ways))
    for level in levels[-2::-1]:
        above = chosen.select(F.col("conv_id").alias("_conv"), F.col("node").alias("_node"), "came", "went")
        below = level.withColumn("above", up).join(above, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("above") == F.col("_node")))
        then = saved(below.drop("_conv", "_node").groupBy("conv_id", "above").applyInArrow(spread, ways))
        drop_saved(chosen)
        chosen = then
    ends = levels[0].groupBy(F.col("conv_id").alias("_c")).agg(F.max("node").alias("_last"))
    found = saved(chosen.join(ends, F.col("conv_id").eqNullSafe(F.col("_c"))).select(F.col("conv_id").alias("_conv"), F.col("node").alias("_block"), "came", F.when(F.col("node") < F.col("_last"), F.col("went")).alias("went")))
    for done in (*levels, chosen):
        drop_saved(done)
    fed = turns.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")
    own = gaps.select(F.col("conv_id").alias("_conv"), F.col("gaps").alias("_gaps"))
    told = fed.groupBy("conv_id", "block").applyInArrow(piece, pieces).join(own, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == 0), "left")
    return told.withColumn("gaps", F.coalesce("_gaps", "gaps")).drop("_conv", "_gaps")


# All conversations


def _pieces(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """(conversations of at most `block` turns, a row each; longer ones, a row per block, None without any)."""
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).where(F.col("n") > block).select(F.col("conv_id").alias("_conv"))
    large = saved(sizes)
    if large.isEmpty():
        return _short(rows), None
    large, same = sent_if_small(large), F.col("conv_id").eqNullSafe(F.col("_conv"))
    return _short(rows.join(large, same, "left_anti")), _long(rows.join(large, same, "left_semi"), block)


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired turns: per conversation, or per block of a long one, conv_id, block, the repaired turns with the edit (K, R or I) of each, the edits (D too) in order, and the counts.

    A null role or text is one space; rows of one conversation go by turn (nulls first), then role, then text; null conv_ids
    are one conversation. A role that is not of s, u or a at its beginning can only be reroled or deleted. Repeated rows are duplicates. Columns besides the four are ignored.
    A state's list of edits is compared by rank, so the result hangs neither on `block` nor on partitions. No task holds more than `block` turns of a conversation at once.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    short, long = _pieces(turns.select("conv_id", "turn", space("role"), space("text"), F.lit(1).alias("copies")), block)
    return short if long is None else short.unionByName(long)


def repair_table(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation, damaged first.

    A conversation of which no row is left has zeros, an empty audit and the digest of nothing; an empty table gives no
    rows. Ties, nulls and repeated rows as in repaired(). The digest of a long conversation is taken over its blocks in
    order, as a stream: SHA-256 has no way to put digests together.
    """
    short, long = _pieces(damaged(turns), block)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = short.select("conv_id", "gaps", *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    if long is None:
        return out
    ddl = f"conv_id {_kind(turns, 'conv_id')}, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    schema = _arrow(ddl)

    def digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            key = sums = None
            for part in parts:
                for conv, _, first, last, n, text, audit, *counts in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if sums is None or conv != key:
                        if sums:
                            yield (key, *sums, "".join(audits), digest.hexdigest())
                        key, sums, audits, digest, before, any_yet = conv, [0] * len(counts), [], hashlib.sha256(), None, False
                    sums = [a + b for a, b in zip(sums, counts, strict=True)]
                    sums[4] += before is not None and before + first not in _LEGAL
                    before = last
                    audits.append(audit)
                    if n:
                        digest.update(("\n" if any_yet else "").encode() + text.encode())
                        any_yet = True
            if sums:
                yield (key, *sums, "".join(audits), digest.hexdigest())

        return _batches(rows(), schema, 16)

    told = long.select("conv_id", "block", "first", "last", F.size("turns").alias("n"), lines.alias("text"), "audit", "gaps", *COUNTS)
    return out.union(told.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(digests, ddl))
