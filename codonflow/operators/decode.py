"""Batch scoring with a supplied model, and decoding of its scores under a label grammar."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codonflow.functions.labels import PAD, TRANSITIONS, argmax
from codonflow.operators.keys import keyed

FORBIDDEN = -1e30
STATES, CHANNELS = 6, 6


def model_input(x: pa.Array, width: int) -> np.ndarray:
    """float32 [n, width, 6] of windows as strings of digits: one-hot, padding all zeros."""
    hot = np.eye(CHANNELS, dtype=np.float32)
    hot[PAD] = 0.0
    codes = np.frombuffer("".join(x.to_pylist()).encode("ascii"), dtype=np.uint8).reshape(len(x), width) - ord("0")
    return hot[codes]


_models: dict[str, Callable] = {}


def cached_model(name: str, make_predict_fn: Callable) -> Callable:
    """One model for each Python worker, the last that was asked for."""
    if name not in _models:
        _models.clear()
        _models[name] = make_predict_fn()
    return _models[name]


def score_windows(windows: DataFrame, make_predict_fn: Callable, width: int, batch_size: int = 64, summary: tuple[str, Callable[[np.ndarray], list]] | None = None) -> DataFrame:
    """``windows`` (x as a string of digits) with logits, array<double> of width * 6 values, six for each base.

    ``make_predict_fn()`` is called once for each Python worker and returns f(one-hot float array
    [n, width, 6], padding all zeros) -> [n, width, 6] or [n, width * 6].

    ``summary``, columns as DDL and a function of a batch's scores [n, width, 6] that makes them, takes the
    place of logits: where only figures of the scores are asked for, 48 bytes a base stay in the worker.
    """
    name = uuid.uuid4().hex
    added = T.StructType.fromDDL(summary[0]).fields if summary else [T.StructField("logits", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*windows.schema.fields, *added])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = cached_model(name, make_predict_fn)
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                b = whole.slice(at, batch_size)
                scores = np.asarray(predict(model_input(b.column("x"), width)), dtype=np.float64).reshape(-1)
                if summary:
                    made = summary[1](scores.reshape(b.num_rows, width, STATES))
                    yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(v, arrow.field(f.name).type) for v, f in zip(made, added, strict=True)]], schema=arrow)
                    continue
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * (width * STATES)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, scores).cast(arrow.field("logits").type)], schema=arrow)

    return windows.mapInArrow(run, schema)


def log_probabilities(scores: np.ndarray) -> np.ndarray:
    top = scores - scores.max(1, keepdims=True)
    return top - np.log(np.exp(top).sum(1, keepdims=True))


def decode_batch(emissions: list[np.ndarray], allowed: list[tuple[int, int]]) -> list[np.ndarray]:
    """Best state path of each [length, 6] log-score array; starts anywhere, ties go to the lowest state.

    All sequences advance together; those that have ended keep their last scores.
    """
    step = np.full((STATES, STATES), FORBIDDEN)
    for a, b in allowed:
        step[a, b] = 0.0
    length = np.array([len(e) for e in emissions])
    longest = int(length.max(initial=0))
    if not longest:
        return [np.zeros(0, dtype=np.int8) for _ in emissions]
    data = np.zeros((longest, len(emissions), STATES))
    for i, e in enumerate(emissions):
        data[: len(e), i] = e
    score, back = data[0].copy(), np.zeros((longest, len(emissions), STATES), dtype=np.int8)
    for t in range(1, longest):
        reach = score[:, :, None] + step
        back[t] = reach.argmax(1)
        score = np.where((t < length)[:, None], reach.max(1) + data[t], score)
    state = score.argmax(1)
    out = np.zeros((longest, len(emissions)), dtype=np.int8)
    for t in range(longest - 1, -1, -1):
        live = t < length
        out[t, live] = state[live]
        if t:
            state = np.where(live, back[t, np.arange(len(state)), state], state)
    return [out[:n, i] for i, n in enumerate(length)]


def constrained_decode(stitched: DataFrame, key: str = "seq_id", scores: str = "logits", transitions: str = "reference", batch_bases: int = 500_000, normalise: bool = False) -> DataFrame:
    """(key, labels) from log-scores, by the named transition table.

    Scores are array<array<double>> or, flat, array<double> with six values for each base; ``normalise``
    makes them log-probabilities first. The recurrence is sequential in a sequence, so this is an Arrow
    function; sequences are sorted by length and go through it in groups of at most ``batch_bases`` padded
    positions. An empty array gives an empty one.
    """
    allowed, keys = TRANSITIONS[transitions], keyed(stitched, key)
    flat = dict(stitched.dtypes)[scores] == "array<double>"
    schema = T.StructType([*[stitched.schema[k] for k in keys], T.StructField("labels", T.ArrayType(T.ByteType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ends = np.cumsum(size)
            values = lists.flatten()
            data = (values if flat else values.flatten()).to_numpy(zero_copy_only=False).astype(float).reshape(-1, STATES)
            if normalise and len(data):
                data = log_probabilities(data)
            if flat:
                ends = ends // STATES
            rows = np.split(data, ends[:-1]) if len(ends) else []
            order, out, group = np.argsort([len(r) for r in rows], kind="stable"), [None] * len(rows), []

            def flush(group: list[int]) -> None:
                for i, path in zip(group, decode_batch([rows[i] for i in group], allowed), strict=True):  # noqa: B023
                    out[i] = path  # noqa: B023

            for i in order:
                if group and (len(group) + 1) * len(rows[i]) > batch_bases:
                    flush(group)
                    group = []
                group.append(int(i))
            if group:
                flush(group)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in out])]).astype(np.int32)
            labels = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out) if out else np.zeros(0), type=pa.int8()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], labels.cast(arrow.field("labels").type)], schema=arrow)

    return stitched.select(*keys, F.col(scores).alias("_scores")).mapInArrow(run, schema)


def argmax_decode(rows: DataFrame, scores: str = "logits") -> DataFrame:
    """Rows with their most likely class, without grammar."""
    return rows.withColumn("predicted", argmax(F.col(scores)))


def confusion_cells(windows: DataFrame, make_predict_fn: Callable, width: int, batch_size: int = 64, transitions: str = "reference", by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) t, p, n: positions of each true and decoded class, padding left out, from windows with x and y as strings of digits.

    One pass scores, decodes and counts: the model sees each window once, and a task gives at most 36 cells
    for each ``by``.
    """
    name, allowed = uuid.uuid4().hex, TRANSITIONS[transitions]
    schema = T.StructType([*[windows.schema[c] for c in by], *T.StructType.fromDDL("t int, p int, n long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict, cells = cached_model(name, make_predict_fn), {}
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                b = whole.slice(at, batch_size)
                scores = np.asarray(predict(model_input(b.column("x"), width)), dtype=np.float64).reshape(-1, STATES)
                paths = np.concatenate(decode_batch(list(log_probabilities(scores).reshape(b.num_rows, width, STATES)), allowed)).reshape(b.num_rows, width)
                x, y = (np.frombuffer("".join(b.column(c).to_pylist()).encode("ascii"), dtype=np.uint8).reshape(b.num_rows, width) - ord("0") for c in ("x", "y"))
                owners = list(zip(*(b.column(c).to_pylist() for c in by), strict=True)) if by else [()] * b.num_rows
                for i, owner in enumerate(owners):
                    real = x[i] != PAD
                    cells[owner] = cells.get(owner, 0) + np.bincount(y[i][real].astype(np.int64) * STATES + paths[i][real], minlength=STATES * STATES)
        rows = [(*owner, k // STATES, k % STATES, int(n)) for owner, count in cells.items() for k, n in enumerate(count) if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return windows.select(*by, "x", "y").mapInArrow(run, schema)
