import itertools
import random
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from codonflow.functions import labels as fn
from codonflow.operators import decode, geneset, intervals, labeling, maxplus, metrics, orf, runlog, windows
from codonflow.plans import pipelines
from codonflow.plans.queries import demo_scorer

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import tests


def seqs(spark, rows):
    return spark.createDataFrame(rows, "tx_id string, seq string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "tx_id string, length long, orf_start long, orf_end long")


def test_encode_and_one_hot(spark):
    got = seqs(spark, [("a", "acGTNnUx-"), ("b", "")]).select(fn.encode(F.col("seq")).alias("c"), fn.one_hot(fn.encode(F.col("seq")), 5).alias("h")).collect()
    assert got[0]["c"] == [0, 1, 2, 3, 4, 4, 4, 4, 4] and got[0]["h"][1] == [0, 1, 0, 0, 0]
    assert got[1]["c"] == [] and got[1]["h"] == []
    blank = spark.range(1).select(fn.one_hot(F.array(F.lit(5), F.lit(2)), 6, blank=5).alias("h")).first()["h"]
    assert blank == [[0] * 6, [0, 0, 1, 0, 0, 0]]


def test_tiles(spark):
    got = windows.tile_windows(windows.pair_with_labels(seqs(spark, [("a", "ACGTACGTAC"), ("b", "ACGT"), ("e", "")]), labels(spark, [("a", 10, 0, 9), ("b", 4, None, None), ("e", 0, None, None)]))[0], 4)
    rows = [(r["tx_id"], r["chunk_idx"], r["real_len"], r["x"], r["y"]) for r in got.orderBy("tx_id", "chunk_idx").collect()]
    assert rows == [("a", 0, 4, [0, 1, 2, 3], [1, 2, 3, 4]), ("a", 1, 4, [0, 1, 2, 3], [2, 3, 4, 2]), ("a", 2, 2, [0, 1, 5, 5], [5, 0, 0, 0]), ("b", 0, 4, [0, 1, 2, 3], [0, 0, 0, 0])]


def test_length_mismatch(spark):
    pair = (seqs(spark, [("a", "ACGT"), ("b", "AC")]), labels(spark, [("a", 4, None, None), ("b", 9, None, None)]))
    with pytest.raises(Exception, match="differ in length: b"):
        windows.pair_with_labels(*pair)[0].collect()
    kept, rejects = windows.pair_with_labels(*pair, strict=False)
    assert [r["tx_id"] for r in kept.collect()] == ["a"] and [r["tx_id"] for r in rejects.collect()] == ["b"]


def test_stitch_undoes_tiling(spark):
    rng = random.Random(1)
    rows = [(f"t{i}", "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 40)))) for i in range(30)]
    tiled = windows.tile_sequences(seqs(spark, rows), 7).withColumn("x", F.slice("x", F.lit(1), F.col("real_len")))
    got = {r["tx_id"]: "".join("ACGTN"[c] for c in r["x"]) for r in windows.stitch(tiled, "tx_id", "chunk_idx", "x").collect()}
    assert got == dict(rows)


def test_store_prunes_species(spark, tmp_path):
    df = windows.tile_sequences(seqs(spark, [("a", "ACGT")]), 4).withColumn("species", F.lit("s1"))
    windows.write_windows(df.unionByName(df.withColumn("species", F.lit("s2"))), str(tmp_path / "w"))
    one = windows.read_windows(spark, str(tmp_path / "w"), ["s2"])
    assert one.count() == 1
    assert "PartitionFilters: []" not in one._jdf.queryExecution().toString()


def test_training_batches_are_full_and_seeded(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    get = lambda seed: sorted(tuple(r) for r in windows.training_batches(df, ["k"], 16, 4, seed).select("shard", "batch", "place", "k").collect())
    assert get("1") == get("1") != get("2")
    sizes = {k: len(list(v)) for k, v in itertools.groupby(get("1"), key=lambda r: r[:2])}
    assert set(sizes.values()) == {16}
    assert windows.training_batches(df, ["k"], 16, 4, drop_remainder=False).count() == 500


def test_decode_is_the_best_allowed_path():
    rng = np.random.default_rng(4)
    for name in ("reference", "label_cycle"):
        allowed = set(fn.TRANSITIONS[name])
        data = [rng.normal(size=(n, 6)) for n in (0, 1, 2, 5, 6)]
        for e, path in zip(data, decode.decode_batch(data, fn.TRANSITIONS[name]), strict=True):
            paths = [p for p in itertools.product(range(6), repeat=len(e)) if all(x in allowed for x in itertools.pairwise(p))]
            best = max(paths, key=lambda p: sum(e[i, s] for i, s in enumerate(p)))
            assert tuple(path) == best


def test_decode_ties_take_the_lowest_state():
    assert decode.decode_batch([np.zeros((3, 6))], fn.TRANSITIONS["reference"])[0].tolist() == [0, 0, 0]


def test_decode_groups_of_any_size_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=(int(n), 6)).tolist()) for i, n in enumerate(rng.integers(0, 30, 40))]
    df = spark.createDataFrame(rows, "seq_id long, logits array<array<double>>")
    a, b = ({r["seq_id"]: r["labels"] for r in decode.constrained_decode(df, batch_bases=n).collect()} for n in (50, 100_000))
    assert a == b and all(len(a[i]) == len(x) for i, x in rows)


def test_scores_equal_the_model(spark):
    tiled = windows.tile_sequences(seqs(spark, [("a", "ACGTACGTACC"), ("b", "TTTT")]), 5, text=True)
    for r in decode.score_windows(tiled, demo_scorer, 5, batch_size=2).collect():
        hot = np.array([[float(c == k) if c != fn.PAD else 0.0 for k in range(6)] for c in map(int, r["x"])])
        assert np.allclose(np.array(r["logits"]), demo_scorer()(hot[None])[0].reshape(-1))


def test_padding_carries_no_signal(spark):
    x = decode.model_input(pa.array(["0125", "4555"]), 4)
    assert x.shape == (2, 4, 6) and x.sum() == 4 and x[:, :, 5].sum() == 0 and x[0, 2, 2] == 1


def perfect():
    """Scores that give away the label: bases A C G T stand for IR START coding STOP in these tests."""
    def predict(x):
        base = np.where(np.asarray(x).sum(-1) > 0, np.asarray(x).argmax(-1), 5)
        out = np.zeros((*base.shape, 6))
        for k, state in ((0, 0), (1, 1), (3, 5)):
            out[..., state][base == k] = 9.0
        out[..., 2:5][base == 2] = 5.0
        return out.reshape(len(out), -1)

    return predict


def test_annotate_and_predict(spark):
    exons = spark.createDataFrame([("t", "c", "+", 100, 106, 0), ("t", "c", "+", 200, 210, 1), ("no_seq", "c", "+", 0, 5, 0)], "tid string, contig string, strand string, start long, end long, line_no long")
    seq = seqs(spark, [("t", "AACGGGGGGTAAAAAA"), ("no_exons", "AACGGGTA")])
    lines = [r["line"].split("\t") for r in pipelines.annotate(exons, perfect, seq, width=6).orderBy("start").collect()]
    assert [(x[3], x[4], x[7]) for x in lines] == [("103", "106", "0"), ("201", "204", "1")]
    tiled = windows.tile_windows(windows.pair_with_labels(seq.filter("tx_id = 't'"), labels(spark, [("t", 16, 2, 11)]))[0].withColumn("species", F.lit("s")), 6)
    ref, pred, summary = pipelines.predict(tiled, exons, perfect, 6)
    assert ref.count() == 2 and pred.count() == 2
    assert [tuple(r) for r in summary.select("species", "transcripts", "reference_cds", "predicted_cds").collect()] == [("s", 1, 2, 2)]


def test_evaluate_positions_counts_every_window(spark):
    tiled = windows.tile_windows(windows.pair_with_labels(seqs(spark, [("t", "AACGGGGGGGTAAAAA")]), labels(spark, [("t", 16, 2, 11)]))[0], 6)
    got = pipelines.evaluate_positions(tiled, perfect, 6).filter("predictor = 'model'").collect()
    assert sum(r["tp"] + r["fn"] for r in got) == 16


def test_two_species_with_equal_ids(spark):
    """Labels, windows, predictions and accuracy of each species are those of the species alone."""
    columns = "species string, tid string, contig string, strand string, start long, end long, line_no long"
    exons = spark.createDataFrame([("s1", "t", "c", "+", 100, 112, 0), ("s2", "t", "c", "+", 500, 512, 0)], columns)
    cds = spark.createDataFrame([("s1", "r", "c", "+", 102, 111, 0), ("s2", "r", "c", "+", 900, 909, 0)], columns.replace("tid", "rid"))
    got = {(r["species"], r["tid"]): (r["category"], r["length"], r["orf_start"]) for r in labeling.label_transcripts(exons, cds).collect()}
    assert got == {("s1", "t"): ("kept_single", 12, 2), ("s2", "t"): ("ir_only", 12, None)}
    seq = spark.createDataFrame([("s1", "t", "AACGGGGGGGTA"), ("s2", "t", "AAAAAAAAAAAA")], "species string, tx_id string, seq string")
    store = spark.createDataFrame([("s1", "t", 12, 2, 11), ("s2", "t", 12, None, None)], "species string, tx_id string, length long, orf_start long, orf_end long")
    tiled = pipelines.make_windows(seq, store, 5)
    assert tiled.count() == 6
    paths = {r["species"]: len(r["labels"]) for r in pipelines.decode_windows(tiled, perfect, 5).collect()}
    assert paths == {"s1": 12, "s2": 12}
    ref, pred, summary = pipelines.predict(tiled, exons, perfect, 5)
    assert {r["species"]: r["line"].split("\t")[3] for r in ref.collect()} == {"s1": "103"}
    assert {r["species"]: r["reference_cds"] for r in summary.collect()} == {"s1": 1, "s2": 0} and pred.count() <= 1
    whole = pipelines.evaluate_positions(tiled, perfect, 5).filter("predictor = 'model'").collect()
    assert sum(r["tp"] + r["fn"] for r in whole) == 24
    each = pipelines.evaluate_positions(tiled, perfect, 5, by=("species",)).filter("predictor = 'model'").collect()
    assert {s: sum(r["tp"] + r["fn"] for r in each if r["species"] == s) for s in ("s1", "s2")} == {"s1": 12, "s2": 12}


def test_windows_are_stored_in_order(spark, tmp_path):
    rows = [(f"t{i:02}", "ACGTACGTAC" * (i % 3 + 1)) for i in range(30)]
    df = windows.tile_sequences(seqs(spark, rows), 4).withColumn("species", F.lit("s"))
    windows.write_windows(df.repartition(7, "chunk_idx"), str(tmp_path / "w"))
    files = sorted((tmp_path / "w" / "species=s").glob("*.parquet"))
    read = [[(r["tx_id"], r["chunk_idx"]) for r in pq.read_table(f, columns=["tx_id", "chunk_idx"]).to_pylist()] for f in files]
    assert all(x == sorted(x) for x in read) and sorted(sum(read, [])) == sorted((r["tx_id"], r["chunk_idx"]) for r in df.collect())
    assert len({t for x in read for t, _ in x}) == sum(len({t for t, _ in x}) for x in read)


def test_label_text_equals_label_arrays(spark):
    cases = [(n, a, b) for n in (0, 1, 5, 9) for a in (None, -7, -1, 0, 2, 8) for b in (None, 1, 3, 6, 9, 14) if (a is None) == (b is None) and (a is None or a < b)]
    df = spark.createDataFrame(cases, "n int, a long, b long")
    for r in df.select("*", fn.label_string(F.col("n"), F.col("a"), F.col("b")).alias("text"), fn.dense_labels(F.col("n"), F.col("a"), F.col("b")).alias("items")).collect():
        assert r["text"] == "".join(map(str, r["items"])), r


def test_epochs_repeat_in_other_orders(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = windows.training_batches(df, ["k"], 10, epochs=2).collect()
    orders = {e: [r["k"] for r in sorted((r for r in got if r["epoch"] == e), key=lambda r: (r["shard"], r["batch"], r["place"]))] for e in (0, 1)}
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(100)) and orders[0] != orders[1]


def test_interleaved_batches_hold_many_sources(spark):
    rng = random.Random(5)
    sizes = {f"s{i:02}": rng.randint(1, 40) for i in range(70)} | {None: 25}
    df = spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "source string, k long")
    total = sum(sizes.values())

    def order(**given):
        got = windows.interleaved_batches(df, "source", ["k"], 16, drop_remainder=False, **{"cycle": 16, "cells": 3, **given}).collect()
        out = {}
        for r in got:
            out.setdefault(r["epoch"] if given.get("epochs") else 0, []).append((r["batch"] * 16 + r["place"], r["source"], r["k"]))
        return {e: sorted(v) for e, v in out.items()}

    one = order()[0]
    assert [p for p, *_ in one] == list(range(total))  # gapless
    assert sorted(((s or "", k) for _, s, k in one)) == sorted((s or "", i) for s, n in sizes.items() for i in range(n))
    assert total // 16 > max(sizes.values())  # no source is longer than a lane
    for b in range(total // 16):
        assert len({s for _, s, _ in one[16 * b : 16 * b + 16]}) == 16
    # A source is open from its first row to its last; at most a cycle of them are open in a round.
    place = {}
    for p, s, _ in one:
        place.setdefault(s, []).append(p // 16)
    wrapped = sum(max(v) - min(v) + 1 > len(v) for v in place.values())
    assert wrapped <= 15  # at most one source goes on in the next lane at each of the 15 cuts
    assert order(cells=1)[0] == one == order(cells=50)[0] and order(seed="8")[0] != one
    twice = order(epochs=2)
    assert sorted(x[1:] for x in twice[0] if x[1]) == sorted(x[1:] for x in twice[1] if x[1]) and twice[0] == one != twice[1]
    assert [s for _, s, _ in twice[0][:16]] != [s for _, s, _ in twice[1][:16]]
    full = windows.interleaved_batches(df, "source", ["k"], 16, cycle=16).groupBy("batch").count().collect()
    assert len(full) == total // 16 and {r["count"] for r in full} == {16}


def test_interleaving_a_long_source_few_sources_and_none(spark, tmp_path):
    rows = [("long", i) for i in range(600)] + [(f"s{j}", i) for j in range(30) for i in range(10)]
    df = spark.createDataFrame(rows, "source string, k long").withColumn("batch_note", F.lit("x"))
    got = windows.interleaved_batches(df, "source", ["k"], 30, cycle=10, cells=4)
    windows.write_batches(got, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == 900 and back.columns == got.columns
    shares = [r["n"] for r in back.groupBy("batch").agg(F.count(F.when(F.col("source") == "long", 1)).alias("n")).collect()]
    assert min(shares) >= 18 and max(shares) <= 21  # two thirds of each batch, in every batch
    for f in sorted((tmp_path / "b").glob("*.parquet")):
        read = [(r["batch"], r["place"]) for r in pq.read_table(f, columns=["batch", "place"]).to_pylist()]
        assert read == sorted(read)
    few = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "source string, k long")
    rest = windows.interleaved_batches(few, "source", ["k"], 2, drop_remainder=False)
    assert sorted((r["batch"], r["place"]) for r in rest.collect()) == [(0, 0), (0, 1), (1, 0)]
    assert windows.interleaved_batches(few, "source", ["k"], 2).count() == 2
    assert windows.interleaved_batches(few.limit(0), "source", ["k"], 2, epochs=2).count() == 0


def test_loci_over_many_bins(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["a", "b", None]), "+", s, s + rng.choice([3, 40, 900])) for i, s in enumerate(rng.randint(0, 5000) for _ in range(60))]
    df = spark.createDataFrame(rows, "tid long, contig string, strand string, span_start long, span_end long")
    plain = {}
    for c in ("a", "b", None):
        end, n = None, 0
        for t, _, _, s, e in sorted((r for r in rows if r[1] == c), key=lambda r: (r[3], r[4], r[0])):
            n += end is None or s >= end
            end = e if end is None else max(end, e)
            plain[t] = n
    for width in (50, 1000, 100_000):
        assert {r["tid"]: r["locus"] for r in intervals.locus_clusters(df, width).collect()} == plain


def test_metric_edge_cases(spark):
    rows = spark.createDataFrame([([1.0, 1.0, 0.0, 0.0, 0.0, 0.0], 0, False), ([0.0, 0.0, 0.0, 0.0, 0.0, 9.0], 3, True)], "logits array<double>, true_class int, pad boolean")
    prf = {(r["predictor"], r["class_id"]): r for r in metrics.class_prf(metrics.confusion_counts(rows)).collect()}
    assert len(prf) == 12 and prf["model", 0]["f1"] == 1.0 and prf["model", 5]["f1"] == 0.0
    assert abs(metrics.masked_accuracy(rows).first()["accuracy"] - 1) < 1e-6


def test_gene_set_tolerance_and_nan(spark):
    cols = "species string, tid string, contig string, strand string, start long, end long"
    ref = spark.createDataFrame([("s", "r", "c", "+", 100, 200), ("s", "r", "c", "+", 300, 400), ("lone", "q", "c", "+", 0, 10)], cols)
    near = spark.createDataFrame([("s", "p", "c", "+", 97, 200), ("s", "p", "c", "+", 300, 403)], cols)
    far = spark.createDataFrame([("s", "p", "c", "+", 96, 200), ("s", "p", "c", "+", 300, 400)], cols)
    levels, average = pipelines.evaluate_gene_sets({"near": near, "far": far}, ref)
    got = {(r["gene_set"], r["level"], r["species"]): (r["sn"], r["pr"]) for r in levels.collect()}
    assert got["near", "exon", "s"] == got["near", "transcript", "s"] == got["near", "gene", "s"] == (100.0, 100.0)
    assert got["far", "exon", "s"] == (50.0, 50.0) and got["far", "transcript", "s"] == (0.0, 0.0)
    assert got["near", "gene", "lone"][0] == 0.0 and got["near", "gene", "lone"][1] != got["near", "gene", "lone"][1]
    assert {(r["gene_set"], r["level"]): r["sn"] for r in average.collect()}["near", "gene"] == 100.0
    twice = geneset.union_gene_sets({"x": near.unionByName(near.withColumn("tid", F.lit("p2")))}, distinct=True)
    assert [r["tid"] for r in twice.select("tid").distinct().collect()] == ["p"]


def test_run_logs(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, 0.5, 0.6, 0.5, 0.7, 0.7])] + [("b", 0, float("nan")), ("b", 1, 2.0)]
    log = spark.createDataFrame(rows, "run string, epoch long, val_loss double")
    assert sorted(tuple(r) for r in runlog.best_epochs(log).collect()) == [("a", 1, 2, 0.5), ("b", 1, 2, 2.0)]
    assert [tuple(r) for r in runlog.early_stop(log.filter("run = 'a'"), 3).collect()] == [("a", 4)]
    steps = runlog.plateau_steps(log.filter("run = 'a'"), 2, 0.1, 1e-3, 1e-2).collect()
    assert [(r["epoch"], round(r["lr"], 9)) for r in steps] == [(3, 1e-3)]
    report = {r["run"]: r for r in pipelines.run_report(log).collect()}
    assert report["a"]["best_epoch"] == 1 and report["b"]["lr_steps"] == [] and set(report) == {"a", "b"}


@pytest.mark.parametrize("name", ["reference", "label_cycle"])
@pytest.mark.parametrize("width", [1, 2, 7, 50])
def test_windows_decode_like_whole_sequences(name, width):
    """Ties included: scores of few whole values tie often, and their sums are exact."""
    rng = np.random.default_rng(width)
    allowed = fn.TRANSITIONS[name]
    for n in (1, 2, 5, 13, 50, 121):
        for values in (2, 3, 1000):
            data = [rng.integers(0, values, (n, 6)).astype(float) for _ in range(6)]
            want = ["".join(map(str, p)) for p in decode.decode_batch(data, allowed)]
            for e, path in zip(data, want, strict=True):
                parts = [e[i : i + width] for i in range(0, n, width)]
                made = maxplus._transfers(parts, np.arange(len(parts)) == 0, allowed)
                assert maxplus.joined(made) == path


def test_paths_of_a_window_are_packed_by_what_they_share():
    rng = np.random.default_rng(1)
    data = decode.log_probabilities(3 * rng.normal(size=(2000, 6)))
    gain, heads, core, tails = maxplus._transfers([data], np.array([False]), fn.TRANSITIONS["label_cycle"])[0]
    assert len(gain) == 36 and len(core) > 1900 and max(map(len, heads)) + max(map(len, tails)) == 2000 - len(core)


def test_each_window_is_scored_once_and_scores_are_not_exchanged(spark, tmp_path):
    def make():
        whole = perfect()

        def predict(x):
            with open(f"{tmp_path}/calls", "a") as f:
                f.write("x" * len(x))
            return whole(x)

        return predict

    seq = seqs(spark, [(f"t{i}", "AACGGGGGGGTAAAAAACGGGGTA"[: 12 + i]) for i in range(12)])
    stored = labels(spark, [(f"t{i}", 12 + i, 2, 11) for i in range(12)])
    tiled = windows.tile_windows(windows.pair_with_labels(seq, stored)[0], 6)
    count = tiled.count()
    got = pipelines.evaluate_positions(tiled, make, 6).filter("predictor = 'model'").collect()
    assert (tmp_path / "calls").stat().st_size == count and sum(r["tp"] + r["fn"] for r in got) == sum(range(12, 24))
    (tmp_path / "calls").unlink()
    decoded = pipelines.decode_windows(tiled, make, 6)
    whole = windows.stitch(decode.score_windows(pipelines._text(tiled, "x"), perfect, 6), "tx_id", "chunk_idx", "logits")
    want = {r["tx_id"]: "".join(map(str, r["labels"])) for r in decode.constrained_decode(whole, "tx_id", normalise=True).collect()}
    got = {r["tx_id"]: r["labels"] for r in decoded.collect()}
    assert got == {k: v[: len(got[k])] for k, v in want.items()} and len(got["t5"]) == 17
    assert (tmp_path / "calls").stat().st_size == count
    plan = decoded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "logits" not in plan
    rows = decode.score_windows(pipelines._text(tiled, "x", "y"), perfect, 6)
    flat = decode.constrained_decode(rows.withColumn("w", F.concat_ws(":", "tx_id", "chunk_idx")).select("w", "logits"), "w", normalise=True)
    old = rows.withColumn("w", F.concat_ws(":", "tx_id", "chunk_idx")).join(flat, "w").select(F.inline(F.arrays_zip(fn.pad_mask(fn.digits(F.col("x"))).alias("pad"), fn.digits(F.col("y")).alias("true_class"), F.col("labels").alias("predicted"))))
    columns = ["predictor", "class_id", "tp", "fp", "fn"]
    assert sorted(tuple(r) for r in metrics.confusion_counts(old, F.col("predicted")).select(*columns).collect()) == sorted(tuple(r) for r in pipelines.evaluate_positions(tiled, perfect, 6).select(*columns).collect())


def test_orfs_in_packed_labels(spark):
    """Equal to the row form on random labels; nothing is exchanged."""
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choices("012345", [1, 3, 2, 2, 2, 3], k=rng.randint(0, 80))) for _ in range(200)] + ["", "15", "5", "1", "115", "1" + "234" * 5000 + "5", None]
    df = spark.createDataFrame(list(enumerate(texts)), "tx_id long, labels string")
    found = orf.find_orfs(df)
    long = df.filter("labels != ''").select("tx_id", fn.digits(F.col("labels")).alias("labels"))
    want = sorted(tuple(r) for r in orf.extract_orfs(orf.explode_labels(long), "tx_id").collect())
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 300
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
