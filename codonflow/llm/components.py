"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonflow.llm.common import discard, parts, stored

ROWS_A_TASK = 100_000


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b: long) to (node, root): every node that has a link, with the smallest node it reaches.

    Each step keeps at most one row for each link; intermediate tables are stored in the shared folder.
    A small table is worked on in few tasks. Self-links are ignored. An empty table gives an empty result.
    The number of steps grows with the logarithm of the longest chain; beyond ``max_rounds`` it is an error.
    """
    pairs = links.filter("a != b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    pairs = stored(pairs, "links")
    before, most = tuple(pairs.agg(F.count("*"), F.lit(0)).first()), parts(pairs.sparkSession)
    tasks = -(-before[0] // ROWS_A_TASK) or 1
    few = lambda df: df.coalesce(tasks) if tasks < most else df
    for _ in range(max_rounds if before[0] else 0):
        last, pairs = pairs, few(pairs)
        both = pairs.select(F.col("high").alias("node"), F.col("low").alias("other")).union(pairs.select("low", "high"))
        least = few(both.groupBy("node").agg(F.least("node", F.min("other")).alias("least")))
        large = few(both.filter("other > node").join(least, "node")).select(F.col("other").alias("high"), F.col("least").alias("low"))
        large = few(large.union(least.filter("node != least").select("node", "least")).distinct())
        lows = few(large.groupBy("high").agg(F.min("low").alias("least")))
        small = few(large.join(lows, "high")).filter("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        pairs = stored(few(small.union(lows.select("high", "least")).distinct()), "links")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        discard(last)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} steps")
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("root")).union(pairs.select(F.col("low"), F.col("low")).distinct())
