"""Conversation repair, against SQL and against a search over all edits."""

import hashlib
import heapq
import random
import zlib
from itertools import groupby

import pytest
from compare import assert_same

from codonflow.llm import queries, repair

TOP = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def hurt(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(rows, faults):
    """The least cost, by Dijkstra over (rows passed, last role): every edit is tried."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        if i == len(rows) and state in ("", "a"):
            return cost, audit, made
        more = [(cost + 5, audit + "I", i, "a" if state == "u" else "u", (*made, ("assistant:" if state == "u" else "user:")))]
        if i < len(rows):
            role, text = rows[i][2:]
            more.append((cost + 2, audit + "D", i + 1, state, made))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                if role[:1] and role[0] in legal:
                    more.append((cost + extra, audit + "K", i + 1, role[0], (*made, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in legal:
                        more.append((cost + extra + 1, audit + "R", i + 1, new[0], (*made, f"{new}:{text}")))
        for m in more:
            heapq.heappush(heap, m)
    raise AssertionError("no edits repair it")


def exact(rows, faults):
    """Cost, audit and repaired rows: all suffixes from the end, compared as strings."""
    def go(i, state, inserts):
        key = (i, state, inserts)
        if key in memo:
            return memo[key]
        out = (0, "", ()) if i == len(rows) and state in ("", "a") else (10**9, "~", ())
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if inserts < 3:
            c, t, m = go(i, legal[-1], inserts + 1)
            out = min(out, (c + 5, "I" + t, (("user:" if legal[-1] == "u" else "assistant:"), *m)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, t, m = go(i + 1, state, 0)
            out = min(out, (c + 2, "D" + t, m))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 * (faults[i] == "truncated")
                if role[:1] and role[0] in legal:
                    c, t, m = go(i + 1, role[0], 0)
                    out = min(out, (c + extra, "K" + t, (f"{role}:{text}", *m)))
                new = "user" if legal[-1] == "u" else "assistant"
                c, t, m = go(i + 1, new[0], 0)
                out = min(out, (c + extra + 1, "R" + t, (f"{new}:{text}", *m)))
        memo[key] = out
        return out

    memo = {}
    return go(0, "", 0)


def brute(all_rows, damage=True):
    ids = {r[0] for r in all_rows}
    rows = list(hurt(all_rows)) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in all_rows]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    out = {i: (i, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in ids}
    for conv, group in groupby(sorted(rows, key=order), key=lambda r: r[0]):
        group, seen, faults = list(group), set(), []
        for r in group:
            words = r[3].strip(SPACES)
            faults.append("blank" if not words else "duplicate" if r[2:] in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add(r[2:])
        turns = {r[1] for r in group if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        cost, audit, made = exact(group, faults)
        if len(group) < 8:
            assert cheapest(group, faults)[0] == cost
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return sorted(out.values(), key=str)


def repaired(df, **options):
    return sorted((tuple(r) for r in repair.repair_conversations(df, **options).collect()), key=str)


def chat(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "usher", "Assistant"]
    texts = ["Yes.", "No!", "Why?", "and so", "", " \n", "Well. ", "Ok.\t", "é…", "?"]
    return [(conv, rng.choice([None, t, t, t, t + 1]), rng.choice(roles), rng.choice(texts) + (str(rng.randrange(30)) + rng.choice(["", "."]) if rng.random() < 0.6 else "")) for t in range(n)]


def test_repair_equals_sql(spark, duck):
    assert_same(queries.op12_conversation_repair(spark, TOP), duck, queries.OP12_SQL)


@pytest.mark.parametrize(("block", "damage"), [(512, True), (3, False), (1, True)])
def test_repair_equals_brute_force(spark, block, damage):
    """Blocks of one and three rows put long conversations together from many."""
    rng = random.Random(block)
    rows = [r for conv in range(250) for r in chat(rng, conv if conv else None, rng.randint(1, 9))]
    rows += [r for conv in range(900, 904) for r in chat(rng, conv, 60)] + [(950, 1, "user", None), (951, None, None, "x.")]
    rng.shuffle(rows)
    assert repaired(spark.createDataFrame(rows, SCHEMA), block=block, damage=damage) == brute(rows, damage)


def test_repair_of_odd_rows(spark):
    long = "word " * 50_000
    rows = [(None, None, None, None), (None, None, None, None), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 5, "assistant", long), (1, 5, "assistant", long), (2, 0, "", ""), (3, 7, "\t", " "), (3, 9, "a", ".")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block", "2 AS place", "'x' AS sig", "3 AS cost", "'y' AS audit", "'z' AS _conv", "0 AS kind")
    assert repaired(df) == brute(rows) and repaired(df, damage=False) == brute(rows, False)
    assert repaired(df.limit(0)) == []


def test_suffixes_are_shared():
    """Sorted reversed signatures make each distinct suffix one node."""
    rng = random.Random(1)
    signs = sorted({"".join(rng.choice("suaX") for _ in range(6)) for _ in range(400)})
    made = []
    whole = repair.preceded
    try:
        repair.preceded = lambda sign, after: made.append(sign) or whole(sign, after)
        found = list(repair.solve((False, s) for s in signs))
    finally:
        repair.preceded = whole
    assert len(made) == len({s[:k] for s in signs for k in range(1, 7)}) < 6 * len(signs)
    assert all(len(costs) == 4 for costs, _ in found)
