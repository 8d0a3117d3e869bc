"""Overlaps that are told without pairs, with further equal columns for some tests; exons dealt to a given number of parts."""

import random

from pyspark.sql import functions as F

from codonflow.operators import intervals
from codonflow.plans import fixtures


def test_further_columns_equal_all_against_all(spark):
    for seed, width in ((1, 7), (2, 64), (3, 100_000)):
        rng = random.Random(seed)
        rows = lambda n: [(i, rng.choice(["a", "b", None]), rng.choice(["+", "-", None]), at := rng.randrange(-500, 500), at + rng.choice([0, 1, 5, 50, 900]), rng.choice([True, False, None])) for i in range(n)]
        left, right = rows(120), rows(25)
        a = spark.createDataFrame(left, "id int, c string, d string, s long, e long, x boolean").drop("x")
        b = spark.createDataFrame(right, "rid int, c string, d string, rs long, re long, odd boolean").drop("rid")
        got = intervals.overlapped(a, b, ["c"], ("s", "e", "rs", "re"), {"any": F.lit(True), "same": F.lit(True), "odd_same": F.col("odd")}, width, {"same": ["d"], "odd_same": ["d"]}).collect()
        want = []
        for i, c, d, s, e, _ in left:
            if s < e:
                over = [(y[2] == d and d is not None, y[5]) for y in right if c is not None and y[1] == c and y[3] < y[4] and y[3] < e and s < y[4]]
                want.append((i, c, d, s, e, bool(over), any(z for z, _ in over), any(z and o for z, o in over)))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_exons_are_dealt_to_a_given_number_of_parts(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(60)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    exons = fixtures.tx_exon(spark, str(tmp_path))
    assert exons.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and exons.count() == 60
