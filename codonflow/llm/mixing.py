"""Mixing sources to target weights by hash-random keys and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonflow.llm.common import WORD, parts, stored, tidy

MAX_EPOCHS = 3
RANGES_A_BLOCK = 32


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by repeating ``weights``; no target above ``max_epochs`` sizes, the excess reshared by weight.

    Sources go by code point, null last. A source without words gets target 0.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    cap = [max_epochs * n for _, n in order]
    left, open_, out = share * sum(n for _, n in order), set(range(len(order))), [0.0] * len(order)
    while open_:
        total = sum(weight[i] for i in open_)
        over = {i for i in open_ if left * weight[i] / total > cap[i]}
        for i in over or open_:
            out[i] = float(cap[i]) if over else left * weight[i] / total
        if not over:
            break
        left -= sum(cap[i] for i in over)
        open_ -= over
    return [(s, n, t) for (s, n), t in zip(order, out, strict=True)]


@tidy
def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: int = MAX_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often each document is taken so that every source meets its share of all words.

    Returns doc_id, size (words of the whole text; null: 0), source_size, target, epochs, taken, then
    ``carry`` (columns that clash with these names are left out). A source repeats whole epochs, and in
    the last one takes documents in the order of a seeded hash key until the prefix sum of their sizes
    is as near its budget as whole documents allow (within half the document at the cut). Equal seeds
    give equal mixes. Null is a source of its own; documents without words have size 0 and are taken
    with their neighbours in key order. The key depends on seed, id, source and text, so reruns agree however
    the table is split; rows that are equal in all of these are separate documents with tied keys, and any
    of them is taken first. A very long text counts with all its words. An empty table gives an empty result.

    One row for each source (its size) is collected, nothing that grows with the documents.
    """
    spark = docs.sparkSession
    own = ["doc_id", "size", "source_size", "target", "epochs", "taken"]
    extra = {f"_p{i}": c for i, c in enumerate(carry) if c not in own}  # under names that cannot clash
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("_source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string")).alias("_key"), *[F.col(c).alias(p) for p, c in extra.items()])
    rows = stored(rows, "mix")
    totals = rows.groupBy("_source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    n_rows = {r["_source"]: r["n"] for r in totals}
    all_rows = max(1, sum(n_rows.values()))
    plan = [(i, s, n, t, max(1, -(-8 * parts(spark) * n_rows[s] // all_rows))) for i, (s, n, t) in enumerate(targets([(r["_source"], r["size"]) for r in totals], weights, share, max_epochs))]
    # Stored, so that Spark knows its size: it is broadcast while it is small.
    plan_df = stored(spark.createDataFrame(plan, "_sid int, _source string, source_size long, target double, _ranges long"), "mix-plan")
    rows = rows.join(plan_df, rows["_source"].eqNullSafe(plan_df["_source"])).drop("_source")
    unit = F.shiftrightunsigned("_key", 33).cast("double") / F.lit(float(1 << 31))  # uniform, so equal ranges of it are even
    rows = rows.withColumn("_range", F.floor(unit * F.col("_ranges")))
    sums = rows.groupBy("_sid", "_range").agg(F.sum("size").alias("_sum"))  # 8 x shuffle partitions + sources rows
    # Offsets of ranges in two levels, so that no task sums all ranges of a source.
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.withColumn("_block", F.floor(F.col("_range") / RANGES_A_BLOCK)), "range-sums")
    blocks = sums.groupBy("_sid", "_block").agg(F.sum("_sum").alias("_sum"))
    blocks = blocks.select("_sid", "_block", F.coalesce(F.sum("_sum").over(before("_sid", "_block")), F.lit(0)).alias("_base"))
    sums = sums.withColumn("_own", F.coalesce(F.sum("_sum").over(before("_sid", "_block", "_range")), F.lit(0))).join(blocks, ["_sid", "_block"])
    sums = sums.select("_sid", "_range", (F.col("_base") + F.col("_own")).alias("_offset"))
    within = Window.partitionBy("_sid", "_range").orderBy(F.shiftrightunsigned("_key", 33), "_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_upto", F.sum("size").over(within)).join(sums, ["_sid", "_range"])
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.col("target") - full * F.col("source_size")
    middle = F.col("_offset") + F.col("_upto") - F.col("size") / 2.0
    epochs = full + F.when((budget > 0) & (middle <= budget), 1).otherwise(0)
    return rows.withColumn("epochs", epochs.cast("int")).select("doc_id", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"), *[F.col(p).alias(c) for p, c in extra.items()])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each repeated as often as ``mix`` takes it, with the columns of ``docs``.

    Nulls, empty texts, ties and repeated rows are as in ``mix``. An empty table stays empty.
    """
    renamed = [f"_c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, renamed, strict=True))
    names = {k: own[options.pop(k, v)] for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    out = mix(docs.toDF(*renamed), carry=tuple(renamed), **names, **options)
    out = out.filter("epochs > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("epochs"))))
    return out.select(*[F.col(r).alias(c) for c, r in own.items()])
