"""What a query makes of a text is made once, and no more leaves a worker than is asked for."""

import numpy as np

from codonflow.operators import decode, windows
from codonflow.plans import fixtures as fx
from codonflow.plans.queries import QUERIES

TOP = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_composition_encodes_a_sequence_once(spark):
    df = windows.composition(spark.createDataFrame([("a", "ACGTNxacgtA"), ("b", ""), ("c", None)], "tx_id string, seq string"))
    assert {tuple(r) for r in df.filter("tx_id != 'c'").collect()} == {("a", k, n) for k, n in enumerate((3, 2, 2, 2, 2))} | {("b", k, 0) for k in range(5)}
    assert plan(windows.composition(fx.sequences(spark, TOP))).count("regexp_replace(") == 1


def test_summary_of_scores_takes_the_place_of_logits(spark):
    rows = spark.createDataFrame([("a", "01234"), ("b", "44555")], "tx_id string, x string")
    scored = decode.score_windows(rows, lambda: lambda x: np.cumsum(x, axis=1), 5, summary=("n int, top double", lambda s: ([s.shape[1]] * len(s), s.max((1, 2)))))
    assert [tuple(r) for r in scored.orderBy("tx_id").collect()] == [("a", "01234", 5, 1.0), ("b", "44555", 5, 2.0)]
    assert "logits" not in plan(QUERIES["score_windows"](spark, TOP))


def test_lengths_need_no_bases(spark):
    assert "translate(" not in plan(fx.contig_lengths(spark, TOP)) and "translate(" not in plan(fx.seq_labels(spark, TOP))
    assert plan(QUERIES["splice_sequence"](spark, TOP)).count("translate(text") == 0
