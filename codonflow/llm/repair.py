"""Conversation repair: the cheapest edits that give every conversation a legal order of roles.

A row's symbol is its role and its fault, a conversation's signature the string of its symbols. Signatures
that end alike share an automaton read from the end: a node is a distinct suffix, made once for all
conversations. Distinct signatures are dealt to tasks by ranges of their reversed text, so that those which
share a suffix follow one another, and a node is kept as long as the next signature still passes through it.
For each node and grammar state, a node holds the cost to go and the best audit suffix.

A conversation may be of any length: its rows are cut into blocks, inner blocks are solved for every pair of
entry and exit states, and blocks are put together from the last to the first by costs alone. That is enough
for ties too: the audits of a block from one state to two others differ within the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonflow.llm.common import discard, pack, parts, stored, tidy, to_arrow

SPACES = " \t\n\x0b\x0c\r"
#: Rows of a block.
BLOCK = 512
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a row of each role initial; roles begin (s?(ua)+)?, and a conversation may end in START or ASSISTANT.
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state after an inserted row, and its role; a rerole goes there too.
NEXT, MADE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
KEEP, REROLE, DELETE, TRUNCATED, INSERT = 0, 1, 2, 5, 5
NEVER = 1 << 40
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

Values = list[tuple[int, str]]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that a CRC-32 of ``conv_id:turn`` decides; nulls are one space, also there."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _numbered(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with block and place, which put each conversation's rows in order.

    Rows are sorted over all tasks by conversation, turn (nulls first), role and text, so that a long
    conversation is spread over several; texts that begin alike are only then kept in one.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    state = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("whole")
    schema = f"conv_id {kind}, turn long, role string, text string, state string, print binary, block long, place int"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place, last = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            blocks, places = [], []
            for conv in b.column(0).to_pylist():
                if last != (conv,) or place == block:
                    number, place, last = number + 1, 0, (conv,)
                blocks.append(number)
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], schema=arrow)

    order = ["conv_id", "turn", "role"]
    spread = rows.repartitionByRange(parts(rows.sparkSession), *order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    seen = spread.withColumns({"state": state, "print": F.unhex(F.md5(F.col("text").cast("binary")))})
    return stored(seen.mapInArrow(run, schema), "conversation-rows")


def _signatures(rows: DataFrame) -> DataFrame:
    """conv_id, block, sig, inner (not the last block of its conversation) and the faults of each block.

    A symbol is X for a row that has to go (blank, or role and text seen earlier in the conversation), else
    the role's initial (o for others), in capitals if the text is truncated. No text is read.
    """
    slim = rows.select("conv_id", "block", "place", "role", "state", "print")
    at = F.struct("block", "place")
    first = slim.groupBy("conv_id", "role", "print").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("print").alias("_print"), "first")
    both = slim.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("print") == F.col("_print")), "left")
    fault = F.when(F.col("state") == "blank", "blank").when(F.coalesce(at > F.col("first"), F.lit(False)), "duplicate").otherwise(F.col("state"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    sign = F.when(F.col("fault").isin("blank", "duplicate"), "X").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    marked = both.withColumn("fault", fault).withColumn("sign", sign)
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    out = marked.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("place", "sign"))).alias("s"), count("blank"), count("duplicate"), count("truncated"))
    later = F.lead("block").over(Window.partitionBy("conv_id").orderBy("block"))
    return stored(out.select("conv_id", "block", F.array_join(F.transform("s", lambda x: x["sign"]), "").alias("sig"), later.isNotNull().alias("inner"), "blank", "duplicate", "truncated"), "signatures")


def inserted(values: Values) -> Values:
    """Each state's best value with up to two inserts before (a third would come back to a state it left)."""
    out = []
    for q in range(4):
        best, state = values[q], q
        for k in (1, 2):
            state = NEXT[state]
            best = min(best, (k * INSERT + values[state][0], k * "I" + values[state][1]))
        out.append(best)
    return out


def preceded(sign: str, after: Values) -> Values:
    """Values of the node that ``sign`` leads from: the row's cheapest edit, after any inserts; ties go to the least audit."""
    letter, base = sign.lower(), TRUNCATED if sign != "X" and sign.isupper() else 0
    out = []
    for q in range(4):
        cost, rest = after[q]
        best = (cost + DELETE, "D" + rest)
        if sign != "X":
            if letter in STEPS[q]:
                cost, rest = after[STEPS[q][letter]]
                best = min(best, (cost + KEEP + base, "K" + rest))
            cost, rest = after[NEXT[q]]
            best = min(best, (cost + REROLE + base, "R" + rest))
        out.append(best)
    return inserted(out)


#: What may come after a signature: the end of the conversation, or, for an inner block, each state to leave it in.
ENDS: dict[bool, list[Values]] = {
    False: [inserted([(0, ""), (NEVER, ""), (NEVER, ""), (0, "")])],
    True: [[(0 if q == leave else NEVER, "") for q in range(4)] for leave in range(4)],
}


def solve(reversed_signs: Iterator[tuple[bool, str]]) -> Iterator[tuple[list[int], list[str]]]:
    """Costs and audits of sorted reversed signatures, by entry state and, for inner blocks, exit state.

    ``path`` holds the nodes of the current signature from the end on; those that the next one shares stay.
    """
    path: list[list[Values]] = []
    kind, last = None, ""
    for inner, text in reversed_signs:
        if inner != kind:
            kind, last, path = inner, "", [ENDS[inner]]
        same = 0
        while same < min(len(text), len(last)) and text[same] == last[same]:
            same += 1
        del path[same + 1 :]
        for sign in text[same:]:
            path.append([preceded(sign, after) for after in path[-1]])
        last = text
        flat = [values[q] for q in range(4) for values in path[-1]]
        yield [c if c < NEVER else None for c, _ in flat], [t if c < NEVER else None for c, t in flat]


def _solved(signed: DataFrame) -> DataFrame:
    """inner, sig, costs and audits of each distinct signature."""
    schema = "inner boolean, back string, costs array<long>, audits array<string>"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[bool, str]]:
            for b in batches:
                for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    asked.append(x)
                    yield x

        asked: list[tuple[bool, str]] = []
        done: list[tuple] = []
        for found in solve(pairs()):
            done.append((*asked.pop(), *found))
            if len(done) == 256:
                yield pack(dict(zip(arrow.names, zip(*done, strict=True), strict=True)), arrow)
                done = []
        if done:
            yield pack(dict(zip(arrow.names, zip(*done, strict=True), strict=True)), arrow)

    distinct = signed.select("inner", F.reverse("sig").alias("back")).distinct()
    dealt = distinct.repartitionByRange(parts(signed.sparkSession), "inner", "back").sortWithinPartitions("inner", "back")
    return stored(dealt.mapInArrow(run, schema).select("inner", F.reverse("back").alias("sig"), "costs", "audits"), "solved")


def _leaving(blocks: DataFrame) -> DataFrame:
    """``blocks`` of long conversations with exits: by entry state, the state in which to leave an inner block; from the last block back."""
    schema = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}, block long, exits array<int>"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        togo: list[int] = []
        for b in batches:
            exits = []
            for inner, costs, audits in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if inner:
                    found = [min(((costs[4 * q + e] + togo[e], audits[4 * q + e], e) for e in range(4) if costs[4 * q + e] is not None and togo[e] < NEVER), default=(NEVER, "", 0)) for q in range(4)]
                    togo = [f[0] for f in found]
                    exits.append([f[2] for f in found])
                else:
                    togo = [NEVER if c is None else c for c in costs]
                    exits.append([0] * 4)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(exits, arrow.field("exits").type)], schema=arrow)

    dealt = blocks.select("conv_id", "block", "inner", "costs", "audits").repartition(parts(blocks.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    return dealt.mapInArrow(run, schema)


def _walked(blocks: DataFrame) -> DataFrame:
    """conv_id, block, cost, audit of each block of long conversations (with exits), from the first block on."""
    schema = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}, block long, cost long, audit string"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = START
        for b in batches:
            out = []
            for inner, costs, audits, exits in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                at = 4 * state + exits[state] if inner else state
                out.append((costs[at], audits[at]))
                state = exits[state] if inner else START
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c for c, _ in out], pa.int64()), pa.array([t for _, t in out], arrow.field("audit").type)], schema=arrow)

    dealt = blocks.select("conv_id", "block", "inner", "costs", "audits", "exits").repartition(parts(blocks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block")
    return dealt.mapInArrow(run, schema)


class _Fold:
    """The figures of one conversation, while its rows go by in order."""

    def __init__(self) -> None:
        self.figures = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.audits: list[str] = []
        self.turns, self.low, self.high, self.before = 0, None, None, None
        self.state, self.made, self.hash, self.todo = START, 0, hashlib.sha256(), iter("")

    def block(self, audit: str, counts: dict[str, int]) -> None:
        self.audits.append(audit)
        self.todo = iter(audit)
        for k, v in counts.items():
            self.figures[k] += v

    def add(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.made else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.made += 1
        self.state = STEPS[self.state][role[0]]

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.figures["illegal"] += 1
        self.before = role[:1]
        for edit in self.todo:
            if edit == "K":
                self.add(role, text)
            elif edit != "D":
                self.add(MADE[self.state], "" if edit == "I" else text)
            if edit != "I":
                return

    def end(self) -> dict[str, int | str]:
        for _ in self.todo:  # inserts after the last row
            self.add(MADE[self.state], "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.figures, "audit": "".join(self.audits), "repaired_sha256": self.hash.hexdigest()}


def _folded(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The result row of each conversation, from its rows and its blocks' audits. A task holds no more of them than a batch."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    arrow, counted = to_arrow(schema), ("blank", "duplicate", "truncated", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fold, out = None, None, []
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                for conv_id, _, place, turn, role, text, audit, *counts in zip(*whole.slice(at, 1024).to_pydict().values(), strict=True):
                    if last != (conv_id,):
                        if fold:
                            out.append({"conv_id": last[0], **fold.end()})
                        last, fold = (conv_id,), _Fold()
                    if place < 0:
                        fold.block(audit, dict(zip(counted, counts, strict=True)))
                    else:
                        fold.row(turn, role, text)
                if out:
                    yield pack({n: [x[n] for x in out] for n in arrow.names}, arrow)
                    out = []
        if fold:
            yield pack({n: [v] for n, v in {"conv_id": last[0], **fold.end()}.items()}, arrow)

    none = lambda kind: F.lit(None).cast(kind)
    text = rows.select("conv_id", "block", "place", "turn", "role", "text", none("string").alias("audit"), *[none("long").alias(c) for c in counted])
    heads = blocks.select("conv_id", "block", F.lit(-1).alias("place"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), "audit", *counted)
    dealt = text.unionByName(heads).repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block", "place")
    return dealt.mapInArrow(run, schema)


@tidy
def repair_conversations(rows: DataFrame, damage: bool = True, block: int = BLOCK) -> DataFrame:
    """A row for each conv_id of ``rows`` (conv_id, turn, role, text): its faults, and the cheapest edits that repair it.

    ``damage`` damages the rows first. A conversation's rows are taken by turn (nulls first; ties by role,
    then text). Faults are blank, duplicate (role and text seen earlier), truncated (the last character that
    is no space is not one of ``.!?``); a row's first one counts. Keep costs 0, Rerole 1, Delete 2, Insert 5,
    and a truncated row that stays 5; blank and duplicate rows must go. ``audit`` has the edits' initials in
    order, of equally cheap ones the least in ASCII, so that the initials of the roles left are
    ``(s?(ua)+)?``; a role without an initial is never kept. gaps counts missing turn numbers between the
    least and the greatest. ``repaired_sha256`` is the digest of the repaired ``role:text`` lines.

    A null role or text is one space. A null conv_id is a conversation like any other; further columns,
    whatever their names, play no part. Repeated rows are duplicates of the first. Texts count as a whole.
    An empty table gives no rows, and a conversation without rows after the damage zeros, an empty audit and
    the digest of nothing.

    A conversation's digest can only be taken in order, so its rows pass through one task, one after the
    other; everything else is spread over tasks however long a conversation is.
    """
    ids = rows.select("conv_id").distinct()
    rows = rows.select("conv_id", "turn", "role", "text")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    numbered = _numbered(damaged(rows) if damage else rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text")), block)
    signed = _signatures(numbered)
    solved = _solved(signed)
    found = signed.join(solved, ["inner", "sig"])
    many = signed.filter("inner").select(F.col("conv_id").alias("_conv")).distinct()
    tables = ["conv_id", "block", "blank", "duplicate", "truncated"]
    first = found.join(many, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_anti")
    heads = first.select(*tables, F.get("costs", F.lit(START)).alias("cost"), F.get("audits", F.lit(START)).alias("audit"))
    long = stored(found.join(many, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi"), "long")
    scratch = [long]
    if not long.isEmpty():
        left = stored(_leaving(long), "exits")
        walked = stored(_walked(long.join(left.drop("conv_id"), "block")), "walked")
        heads = heads.unionByName(long.select(*tables).join(walked.drop("conv_id"), "block"))
        scratch += [left, walked]
    out = stored(_folded(numbered, heads), "repaired")
    discard(numbered, signed, solved, *scratch)
    named = out.withColumnRenamed("conv_id", "_conv")
    out = ids.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(EMPTY_HASH))})
