"""Repaired conversations against every way to edit them, and against a search over states where there are too many ways."""

import hashlib
import random
import re
import zlib
from functools import cache
from itertools import product

import pytest
from pyspark.sql import types as T

from millrace.llm import conversation_repair as repair

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SPACE = " \t\n\x0b\f\r"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    key = lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1], r[2])
    return {conv: sorted(own, key=key) for conv, own in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        left = text.strip(SPACE)
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by suffixes: whole lists of edits are compared as texts."""
    faults, n = faults_of(rows), len(rows)
    nxt = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserts):
        ways = []
        if i == n and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 2:
            for c in "ua":
                if c in nxt[state]:
                    cost, audit, lines = best(i, c, inserts + 1)
                    ways.append((cost + 3, "I" + audit, (names[c] + ":", *lines)))
        if i < n:
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role and role[0] in nxt[state]:
                    cost, audit, lines = best(i + 1, role[0], 0)
                    ways.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                for c in "ua":
                    if c in nxt[state]:
                        cost, audit, lines = best(i + 1, c, 0)
                        ways.append((cost + more + 3, "R" + audit, (f"{names[c]}:{text}", *lines)))
        return min(ways) if ways else (1 << 40, "", ())

    for i in range(n, -1, -1):  # from the end, so that no call goes deep
        for state, inserts in product(nxt, (2, 1, 0)):
            best(i, state, inserts)
    return best(0, "", 0)


def table(rows):
    out = {}
    for conv, own in damage(rows).items():
        turns = {t for t, _, _ in own if t is not None}
        faults = faults_of(own)
        initials = [r[:1] for _, r, _ in own]
        cost, audit, lines = cheapest(tuple(own))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def every_way(rows):
    """(cost, audit) over all edits of a few turns, judged by the pattern of their initials."""
    faults, best = faults_of(rows), None
    for inserts in product(("", "I", "II"), repeat=len(rows) + 1):
        for edits in product("DKR", repeat=len(rows)):
            if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults, strict=True)):
                continue
            audit = inserts[0] + "".join(e + i for e, i in zip(edits, inserts[1:], strict=True))
            cost = 3 * audit.count("I") + 3 * audit.count("R") + 4 * audit.count("D") + 3 * sum(e != "D" and f == "truncated" for e, f in zip(edits, faults, strict=True))
            if best and (cost, audit) >= best:
                continue
            kept = iter([r for (_, r, _), e in zip(rows, edits, strict=True) if e == "K"])
            slots = [next(kept)[:1] if e == "K" else "." for e in audit if e != "D"]
            fits = any(all(s in (".", c) for s, c in zip(slots, want, strict=True)) for want in patterns(len(slots)) if not (want[:1] == "s" and slots[0] == "."))
            if fits:
                best = (cost, audit)
    return best


def patterns(n):
    return [w for w in ("ua" * (n // 2), "s" + "ua" * ((n - 1) // 2) if n > 2 else "-") if len(w) == n and re.fullmatch("(s?(ua)+)?", w)]


def made(seed, convs=40, most=9):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", "Well...", "Go on!", "and then", "...", "So."]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", None, ""]
    return [(c if c else None, r.choice([i, i, i, None, i - 1]), r.choice(roles), r.choice([*texts, None])) for c in range(convs) for i in range(r.randrange(1, most))]


def got(df):
    names = ("gaps", *repair.COUNTS, "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[c] for c in names) for r in df.collect()}


def test_search_over_states_is_every_way():
    for rows in damage(made(3, 60, 5)).values():
        if len(rows) <= 4:
            assert cheapest(tuple(rows))[:2] == every_way(rows)


@pytest.mark.parametrize("block", [2, 3, 7, 512])
def test_any_block_gives_the_same(spark, block):
    rows = made(5, 60, 30) + made(6, 3, 300)
    want = table(rows)
    out = repair.repair_table(spark.createDataFrame(rows, SCHEMA), block)
    assert got(out) == want and out.count() == len(want)


def test_given_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(repair.repair_table(turns)) == table([tuple(r[c] for c in repair.KEY) for r in turns.collect()])


def test_one_long_conversation(spark):
    r = random.Random(9)
    rows = [(1, i, r.choice(["user", "assistant"]), r.choice(["Same.", f"t{i}.", f"t{i}", ""])) for i in range(4_000)] + [(1, 7, "user", "Same.")] * 900 + [(2, 0, "user", "Hi.")]
    assert got(repair.repair_table(spark.createDataFrame(rows, SCHEMA), 40)) == table(rows)


def test_repaired_turns_alternate(spark):
    rows = [r for r in made(8, 30, 12)]
    for block in (3, 512):
        out = repair.repaired(spark.createDataFrame(rows, SCHEMA), block).orderBy("conv_id", "block").collect()
        roles: dict = {}
        for r in out:
            roles[r.conv_id] = roles.get(r.conv_id, "") + "".join(t.role[:1] for t in r.turns)
        assert set(roles) == {r[0] for r in rows} and all(re.fullmatch("(s?(ua)+)?", s) for s in roles.values())


def test_odd_tables(spark):
    assert repair.repair_table(spark.createDataFrame([], SCHEMA)).collect() == []
    dropped = next(i for i in range(1_000) if zlib.crc32(f"1:{i}".encode()) % 20 == 0)
    gone = spark.createDataFrame([(1, dropped, "user", "Hi.")], SCHEMA)
    assert got(repair.repair_table(gone)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    rows = [(None, None, None, None), (None, None, None, None), (4, 1, "user", "x" * 300_000), (4, 2, "assistant", "Same."), (4, 2, "assistant", "Same."), (5, None, "system", "A.")]
    wide = spark.createDataFrame([(*r, "extra", 9, 1) for r in rows], T.StructType([*SCHEMA.fields, T.StructField("block", T.StringType()), T.StructField("copies", T.LongType()), T.StructField("n", T.LongType())]))
    assert got(repair.repair_table(wide)) == table(rows) == got(repair.repair_table(wide, 1))
    named = wide.withColumn("conv_id", wide.conv_id.cast("string"))
    assert {r.conv_id: r.audit for r in repair.repair_table(named).collect()} == {None if k is None else str(k): v[6] for k, v in table(rows).items()}
