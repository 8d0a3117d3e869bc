"""Grammar decoding of long sequences window by window, by max-plus transfer matrices.

A window's matrix says, for each state before it and each state at its end, the best score of a path in
between. Matrices are made where the scores are, so scores never leave their task; what is exchanged of a
window is its matrix and its candidate paths, which agree everywhere but near its ends. An ordered
max-plus reduction over a sequence's windows then picks one path of each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codonflow.functions.labels import TRANSITIONS
from codonflow.operators.decode import FORBIDDEN, STATES, cached_model, log_probabilities, model_input
from codonflow.operators.keys import keyed

#: Scores below this hold a forbidden transition.
LOST = FORBIDDEN / 2
TRANSFER = "gain array<double>, heads array<string>, core string, tails array<string>"
DIGITS = np.arange(ord("0"), ord("0") + STATES, dtype=np.uint8)


def predecessors(allowed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and the second state that may come before each state, and what the second one costs (nothing, or forbidden where there is none)."""
    before = [sorted(a for a, b in allowed if b == s) for s in range(STATES)]
    if not all(1 <= len(x) <= 2 for x in before):
        raise ValueError("each state needs one or two states before it")
    second = np.array([x[-1] for x in before])
    return np.array([x[0] for x in before]), second, np.array([0.0 if len(x) == 2 else FORBIDDEN for x in before])


def transfer(scores: np.ndarray, first: np.ndarray, allowed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Gains [windows, before, end] and paths [length, windows, before, end] of windows of one length (scores: [windows, length, 6]).

    In a ``first`` window of a sequence any state may begin; it has one row, ``before`` 0. Ties take the
    lowest state, from the end backwards.
    """
    one, two, cost = predecessors(allowed)
    step = np.full((STATES, STATES), FORBIDDEN)
    for a, b in allowed:
        step[a, b] = 0.0
    n, length, _ = scores.shape
    begin = np.full((STATES, STATES), FORBIDDEN)
    begin[0] = 0.0
    score = np.where(first[:, None, None], begin, step) + scores[:, 0, None, :]
    back = np.zeros((length, n, STATES, STATES), dtype=bool)
    for t in range(1, length):
        a, b = score[:, :, one], score[:, :, two] + cost
        np.greater(b, a, out=back[t])
        score = np.maximum(a, b) + scores[:, t, None, :]
    paths = np.empty((length, n, STATES, STATES), dtype=np.uint8)
    state = np.broadcast_to(np.arange(STATES), (n, STATES, STATES))
    for t in range(length - 1, -1, -1):
        paths[t] = state
        state = np.where(np.take_along_axis(back[t], state, 2), two[state], one[state])
    return score, paths


def packed(gain: np.ndarray, paths: np.ndarray) -> tuple[list[float], list[str], str, list[str]]:
    """One window's gains and its paths as what is theirs alone at both ends and the longest stretch that all possible ones share."""
    possible = gain.ravel() > LOST
    flat = paths.reshape(len(paths), -1)
    some = flat[:, possible]
    same = np.concatenate([[False], (some == some[:, :1]).all(1), [False]])
    edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    low, high = max(edges.tolist(), key=lambda e: e[1] - e[0], default=(0, 0))
    text = DIGITS[flat]
    cut = lambda rows: [rows[:, k].tobytes().decode("ascii") if possible[k] else "" for k in range(flat.shape[1])]
    return gain.ravel().tolist(), cut(text[:low]), text[low:high, int(possible.argmax())].tobytes().decode("ascii"), cut(text[high:])


def joined(windows: list[tuple[list[float], list[str], str, list[str]]]) -> str:
    """The best path of a sequence from its windows in order, equal to decoding it as a whole."""
    total, chosen = None, []
    for gain, heads, core, tails in windows:
        g = np.array(gain).reshape(STATES, STATES)
        if total is None:
            total, before = g[0], [0] * STATES
        else:
            reach = total[:, None] + g
            total, before = reach.max(0), []
            for e in range(STATES):
                ties = np.flatnonzero(reach[:, e] == total[e])
                path = lambda s, e=e: (heads[STATES * s + e] + core + tails[STATES * s + e])[::-1]  # noqa: B023, E731
                before.append(int(ties[0]) if len(ties) == 1 else int(min(ties, key=lambda s: (path(s), s))))
        chosen.append(before)
    state, out = int(total.argmax()), []
    for (_, heads, core, tails), before in zip(reversed(windows), reversed(chosen), strict=True):
        at = STATES * before[state] + state
        out.append(heads[at] + core + tails[at])
        state = before[state]
    return "".join(reversed(out))


def _transfers(scores: list[np.ndarray], first: np.ndarray, allowed: list[tuple[int, int]]) -> list[tuple]:
    """Packed transfers of windows of any lengths, those of one length together."""
    out: list[tuple | None] = [None] * len(scores)
    lengths = np.array([len(s) for s in scores])
    for n in set(lengths.tolist()) - {0}:
        at = np.flatnonzero(lengths == n)
        gain, paths = transfer(np.stack([scores[i] for i in at]), first[at], allowed)
        for k, i in enumerate(at):
            out[i] = packed(gain[k], paths[:, k])
    return out


def _batch(b: pa.RecordBatch, kept: list[str], found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[None if f is None else f[i] for f in found] for i in range(4)]
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, schema.field(len(kept) + i).type) for i, c in enumerate(columns))], schema=schema)


def score_transfers(windows: DataFrame, make_predict_fn: Callable, width: int, batch_size: int = 64, transitions: str = "reference") -> DataFrame:
    """``windows`` (x as a string of digits) without x, with the transfer of each window. The model sees each window once, and no score leaves the task."""
    name, allowed, kept = uuid.uuid4().hex, TRANSITIONS[transitions], [c for c in windows.columns if c not in ("x", "y")]
    schema = T.StructType([*[windows.schema[c] for c in kept], *T.StructType.fromDDL(TRANSFER).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = cached_model(name, make_predict_fn)
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                b = whole.slice(at, batch_size)
                scores = np.asarray(predict(model_input(b.column("x"), width)), dtype=np.float64).reshape(-1, STATES)
                first = b.column("chunk_idx").to_numpy() == 0
                yield _batch(b, kept, _transfers(list(log_probabilities(scores).reshape(b.num_rows, width, STATES)), first, allowed), arrow)

    return windows.select(*kept, "x").mapInArrow(run, schema)


def window_transfers(scored: DataFrame, scores: str = "logits", index: str = "chunk_idx", transitions: str = "reference", normalise: bool = False) -> DataFrame:
    """The same of windows that have flat scores, array<double> with six for each base; windows may differ in length."""
    allowed, kept = TRANSITIONS[transitions], [c for c in scored.columns if c != scores]
    schema = T.StructType([*[scored.schema[c] for c in kept], *T.StructType.fromDDL(TRANSFER).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                rows = [np.array(x or [], dtype=np.float64).reshape(-1, STATES) for x in b.column(scores).to_pylist()]
                rows = [log_probabilities(r) if normalise and len(r) else r for r in rows]
                yield _batch(b, kept, _transfers(rows, b.column(index).to_numpy() == 0, allowed), arrow)

    return scored.mapInArrow(run, schema)


def reduce_transfers(transfers: DataFrame, key: str = "tx_id", index: str = "chunk_idx", length: str | None = None) -> DataFrame:
    """(species,) key and labels, a string of digits, of each sequence from its windows' transfers; cut to the sum of ``length`` if given.

    Windows are numbered from 0. The exchange brings a sequence's windows together in order.
    """
    keys = keyed(transfers, key)
    schema = T.StructType([*[transfers.schema[k] for k in keys], T.StructField("labels", T.StringType())])
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, windows, size, out = None, [], 0, []

        def close() -> None:
            if own is not None:
                labels = joined(windows) if windows else ""
                out.append((*own, labels[:size] if length else labels))

        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in whole.slice(at, 64).columns), strict=True):
                    if own != row[:n]:
                        close()
                        own, windows, size = row[:n], [], 0
                    size += row[n] or 0
                    if row[n + 1] is not None:
                        windows.append(row[n + 1 :])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    count = int(transfers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own_length = (F.col(length) if length else F.lit(0)).cast("long").alias("_size")
    dealt = transfers.repartition(count, *keys).sortWithinPartitions(*keys, index).select(*keys, own_length, "gain", "heads", "core", "tails")
    return dealt.mapInArrow(run, schema)
