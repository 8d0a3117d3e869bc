"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, feature after feature, and summed into one lookup table for each
feature; then the strongest pairs of features get tables of their own. Scoring adds table entries.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonflow.llm.common import crc_fold, pack, to_arrow

FEATURES = ["log_chars", "log_words", "word_length", "distinct_words", "top_word", "distinct_pairs", "letters", "upper", "digits", "spaces", "symbols", "stops", "bars", "brackets", "high_bytes", "entropy", "log_lines", "line_length", "distinct_lines", "ended_lines", "letterless_words", "capital_words", "long_words", "short_words"]
SCORED = "doc_id long, score double"


def features(text: str) -> list[float]:
    """Figures about the whole text, in the order of FEATURES; all finite, zeros for an empty text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = max(1, len(raw))
    c = np.bincount(raw, minlength=256).astype(float)
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    upper, lower, high = c[65:91].sum(), c[97:123].sum(), c[128:].sum()
    p = c[c > 0] / n
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()), len(counts) / m, max(counts.values(), default=0) / m,
        len(set(zip(words, words[1:], strict=False))) / m, (upper + lower + high) / n, upper / n, c[48:58].sum() / n, (c[32] + c[9:14].sum()) / n,
        c[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 126]].sum() / n, c[[33, 44, 46, 58, 59, 63]].sum() / n, c[124] / n, c[[40, 41, 91, 93, 123, 125]].sum() / n, high / n, float(-(p * np.log2(p)).sum()),
        np.log1p(len(lines)), len(text) / k, len(set(lines)) / k, sum(x.rstrip()[-1:] in ".!?" for x in lines) / k, sum(not any(map(str.isalpha, w)) for w in counts) / max(1, len(counts)),
        sum(w[:1].isupper() for w in counts) / max(1, len(counts)), float((lengths > 15).mean()), float((lengths < 3).mean()),
    ]


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), dtype=int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (i, j), t in self.pairs.items():
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -35, 35)))


def _steps(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """A shallow tree on one feature's histogram: best splits of cumulative sums, one after another; its value in each bin."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + smooth)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            if b - a > 1:
                mid = np.arange(a + 1, b)
                v = gain(a, mid) + gain(mid, b) - gain(a, b)
                i = int(v.argmax())
                if v[i] > best[0]:
                    best = (v[i], (a, int(mid[i]), b))
        if best[1] is None:
            break
        a, m, b = best[1]
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """The best cut of a pair's histogram into four; (gain, values)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    if not a.size:
        return 0.0, np.zeros_like(g)
    gs = [a, cg[:-1, -1:] - a, cg[-1:, :-1] - a, cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + a]
    hs = [b, ch[:-1, -1:] - b, ch[-1:, :-1] - b, ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + b]
    gain = sum(x * x / (y + smooth) for x, y in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for (rows, cols), x, y in zip([(slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))], gs, hs, strict=True):
        out[rows, cols] = x[i, j] / (y[i, j] + smooth)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, edges: list[np.ndarray], rounds: int = 60, n_pairs: int = 6, rate: float = 0.15, leaves: int = 4, smooth: float = 4.0) -> AdditiveModel:
    """Cyclic boosting of ``rounds`` trees for each feature, then for each of the ``n_pairs`` best pairs."""
    model = AdditiveModel(edges, tables=[np.zeros(len(e) + 1) for e in edges])
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    model.intercept = float(np.log(prior / (1 - prior)))
    b, m = model.bins(x), np.full(len(y), model.intercept)
    size = [len(e) + 1 for e in edges]
    for _ in range(rounds):
        for j in range(len(edges)):
            p = 1 / (1 + np.exp(-m))
            step = rate * _steps(np.bincount(b[:, j], y - p, size[j]), np.bincount(b[:, j], p * (1 - p), size[j]), leaves, smooth)
            model.tables[j] += step
            m += step[b[:, j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, at = 1 / (1 + np.exp(-m)), b[:, i] * size[j] + b[:, j]
        return tuple(np.bincount(at, v, size[i] * size[j]).reshape(size[i], size[j]) for v in (y - p, p * (1 - p)))

    ranked = sorted(((_quadrants(*grid(i, j), smooth)[0], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)
    for _, i, j in ranked[:n_pairs]:
        model.pairs[i, j] = np.zeros((size[i], size[j]))
    for _ in range(rounds // 2):
        for (i, j), t in model.pairs.items():
            step = rate * _quadrants(*grid(i, j), smooth)[1]
            t += step
            m += step[b[:, i], b[:, j]]
    return model


def average(models: list[AdditiveModel]) -> AdditiveModel:
    out = AdditiveModel(models[0].edges, sum(m.intercept for m in models) / len(models))
    out.tables = [sum(t) / len(models) for t in zip(*(m.tables for m in models), strict=True)]
    for m in models:
        for k, t in m.pairs.items():
            out.pairs[k] = out.pairs.get(k, 0) + t / len(models)
    return out


def _featured(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, y, text) with an array column x."""
    schema = "doc_id long, y double, x array<double>"
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pack({"doc_id": b.column(0), "y": b.column(1), "x": [features(t or "") for t in b.column(2).to_pylist()]}, arrow)

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000, bags: int = 4, bins: int = 32) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled rows, those with the smallest hash of the id (a bounded sample; the bound is this parameter).

    Each of ``bags`` models is fitted in a task of its own on a different (bags - 1) / bags of the sample;
    their tables are averaged. Rows with a null id or label are not learnt from. Without rows of both
    labels every document gets the share of label 1 (0.5 if there are no labels).
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("doc_id is not null and y is not null")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _featured(text.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows).cache()
    share = sample.agg(F.count("*"), F.avg("y")).first()
    prior = 0.5 if not share[0] else float(share[1])
    if prior in (0.0, 1.0) or not share[0]:
        sample.unpersist()
        q = min(max(prior, 0.01), 0.99)
        return AdditiveModel([], float(np.log(q / (1 - q))))
    cuts = [i / bins for i in range(1, bins)]
    found = sample.agg(*[F.percentile_approx(F.col("x")[j], cuts, 1000).alias(f"q{j}") for j in range(len(FEATURES))]).first()
    edges = [np.unique(np.array(q)) for q in found]

    def fit_bag(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "y"])
        model = fit(np.array(pdf["x"].tolist()), pdf["y"].to_numpy(), edges)
        return pd.DataFrame({"bag": [key[0]], "model": [pickle.dumps(model)]})

    bagged = sample.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(bags)) != F.col("bag"))
    fitted = bagged.groupBy("bag").applyInPandas(fit_bag, "bag int, model binary").collect()  # one small model a bag
    sample.unpersist()
    return average([pickle.loads(r["model"]) for r in sorted(fitted, key=lambda r: r["bag"])])


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null texts score as empty ones. No shuffle."""
    arrow, shared = to_arrow(SCORED), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([features(t or "") for t in b.column(1).to_pylist()])
                yield pack({"doc_id": b.column(0), "score": shared.value.score(x)}, arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only labels of ids whose crc32 is not ``held`` modulo ``folds`` are learnt. Null ids are hashed as the
    empty text and scored like others; repeated rows and equal texts are scored each, alike; a very long text
    counts as a whole; an empty table gives no rows.
    """
    model = train(docs, labels.filter(crc_fold("doc_id", folds) != held), **options)
    out = score(docs, model)
    return out.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 3, held: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``.

    Null texts are judged as empty ones, null ids and repeated rows like any other; an empty table stays empty.
    """
    model = train(docs, labels.filter(crc_fold("doc_id", folds) != held))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([features(t or "") for t in b.column("text").to_pylist()])
                yield b.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
