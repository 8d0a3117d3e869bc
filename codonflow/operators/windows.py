"""Windows for training and scoring: pairing with labels, tiling, stitching, batching, storing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonflow.functions.labels import PAD, code_string, digits, label_string
from codonflow.operators.keys import keyed, shared

WIDTH = 9_999


def pair_with_labels(sequences: DataFrame, labels: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sequences with a label row, and the rejects whose lengths differ. If ``strict``, such a row is an error when read."""
    both = sequences.join(labels, shared(sequences, labels, "tx_id"))
    equal = F.length("seq") == F.col("length")
    rejects = both.filter(~equal).select(*keyed(both, "tx_id"), F.length("seq").alias("seq_length"), "length")
    if strict:
        told = F.raise_error(F.concat(F.lit("sequence and labels differ in length: "), F.col("tx_id")))
        return both.withColumn("length", F.when(equal, F.col("length")).otherwise(told.cast("long"))), rejects
    return both.filter(equal), rejects


def tile_text(paired: DataFrame, width: int = WIDTH) -> DataFrame:
    """Non-overlapping windows (tx_id, chunk_idx, real_len, x, y), the last one padded; x and y are strings of digits.

    A sequence is cut in one pass. Labels are made for one window at a time from the ORF interval; the whole
    label array never exists. An empty sequence gives no window.
    """
    pieces = F.regexp_extract_all(code_string(F.col("seq")), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    cut = paired.select(*keyed(paired, "tx_id"), "orf_start", "orf_end", F.posexplode(pieces).alias("_k", "_x"))
    start, real = F.col("_k").cast("long") * width, F.length("_x")
    y = F.rpad(label_string(real, F.col("orf_start") - start, F.col("orf_end") - start), width, "0")
    return cut.select(*keyed(cut, "tx_id"), F.col("_k").cast("long").alias("chunk_idx"), real.alias("real_len"), F.rpad("_x", width, str(PAD)).alias("x"), y.alias("y"))


def tile_windows(paired: DataFrame, width: int = WIDTH) -> DataFrame:
    """The same windows with x and y as array<tinyint>."""
    return tile_text(paired, width).withColumns({c: digits(F.col(c)) for c in ("x", "y")})


def without_labels(sequences: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return sequences.withColumns({"orf_start": none, "orf_end": none})


def tile_sequences(sequences: DataFrame, width: int = WIDTH, text: bool = False) -> DataFrame:
    """Windows of sequences without labels; x is a string of digits if ``text``."""
    return (tile_text if text else tile_windows)(without_labels(sequences), width).drop("y")


def stitch(windows: DataFrame, key: str, index: str, values: str, length: str | None = None) -> DataFrame:
    """Concatenate the ``values`` arrays or strings of each key (of a species, if there is one) by ``index``, cut to ``length`` if given."""
    keys = keyed(windows, key)
    parts = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(values).alias("v"))))
    out = windows.groupBy(*keys).agg(parts.alias("_parts"), *([F.max(length).alias("_n")] if length else []))
    text = dict(windows.dtypes)[values] == "string"
    items = F.transform("_parts", lambda p: p["v"])
    whole = F.array_join(items, "") if text else F.flatten(items)
    if length:
        whole = (F.substring if text else F.slice)(whole, F.lit(1), F.col("_n").cast("int"))
    return out.select(*keys, whole.alias(values))


#: Windows of a training shard where its number is not given.
SHARD_ROWS = 1_000_000


def training_batches(windows: DataFrame, keys: list[str], batch_size: int, shards: int | None = None, seed: str = "7", drop_remainder: bool = True, epochs: int = 1) -> DataFrame:
    """``windows`` with shard, batch and place: seeded random order in shards, no window over the whole table.

    The order depends on the seed and the keys only. Unless given, the number of shards is that of
    ``SHARD_ROWS`` rows each. More than one of ``epochs`` repeats all windows, each time in another order,
    with a column epoch.
    """
    if epochs > 1:
        again = lambda e: training_batches(windows, keys, batch_size, shards, f"{seed}/{e}", drop_remainder).withColumn("epoch", F.lit(e))
        return reduce(DataFrame.unionByName, map(again, range(epochs)))
    shards = shards or max(1, -(-windows.count() // SHARD_ROWS))
    h = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    shard = F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % shards
    w = Window.partitionBy("shard").orderBy("_h", *keys)
    out = windows.withColumns({"_h": h, "shard": shard}).withColumn("_row", F.row_number().over(w) - 1)
    out = out.withColumns({"batch": F.floor(F.col("_row") / batch_size), "place": F.col("_row") % batch_size})
    if drop_remainder:
        full = out.groupBy("shard").agg(F.floor(F.count("*") / batch_size).alias("_full"))
        out = out.join(full, "shard").filter(F.col("batch") < F.col("_full")).drop("_full")
    return out.drop("_h", "_row")


def interleaved_batches(windows: DataFrame, source: str, keys: list[str], batch_size: int, cycle: int = 32, seed: str = "7", drop_remainder: bool = True, epochs: int = 1, cells: int | None = None) -> DataFrame:
    """``windows`` with batch and place, drawn in turn from at most ``cycle`` sources at a time.

    Sources and the rows of each stand in seeded random order, end to end. This row of rows is cut into
    ``cycle`` lanes of equal length, and a round takes the next row of every lane: where a source ends, the
    next one begins in its lane. So each batch has rows of as many sources as ``cycle`` and its size allow, as
    long as no source is longer than a lane; a longer one fills several lanes and is spread evenly. More than
    one of ``epochs`` repeats all windows with a column epoch, sources and rows in another order each time.

    A row's place is the sum of what comes before its cell plus its number in it; a cell is a range of hashes
    of one source, so that a source with most of the rows is numbered in many tasks. Sums over sources take
    one row a source and epoch. Unless given, ``cells`` a source are as many as ``SHARD_ROWS`` rows each ask
    for. A null source is one of its own; rows with equal keys and source are in any order among themselves.
    """
    sizes = windows.groupBy(source).agg(F.count("*").alias("n")).agg(F.count("*").alias("sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    n = sizes["rows"]
    lanes = max(1, min(cycle, sizes["sources"], n))
    short, longer = max(1, n // lanes), n % lanes
    cells = cells or max(1, -(-n // SHARD_ROWS))
    hashed = lambda *names: F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), *[F.col(c).cast("string") for c in names]))
    rows = windows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumns({"_s": hashed(source), "_r": hashed(*keys)})
    rows = rows.withColumn("_cell", F.floor(F.conv(F.substring("_r", 1, 7), 16, 10).cast("long") * cells / (1 << 28)))
    counts = rows.groupBy("epoch", "_s", "_cell").agg(F.count("*").alias("n"))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("epoch", "_s").agg(F.sum("n").alias("n"))
    sums = sums.select("_s", F.coalesce(F.sum("n").over(before(["epoch"], "_s")), F.lit(0)).alias("_source"))
    starts = counts.select("_s", "_cell", F.coalesce(F.sum("n").over(before(["_s"], "_cell")), F.lit(0)).alias("_inner"))
    starts = starts.join(sums, "_s").select("_s", "_cell", (F.col("_source") + F.col("_inner")).alias("_start"))
    inside = Window.partitionBy("_s", "_cell").orderBy("_r", *keys)
    at = rows.withColumn("_i", F.row_number().over(inside) - 1).join(starts, ["_s", "_cell"]).withColumn("_at", F.col("_start") + F.col("_i"))
    head = longer * (short + 1)  # rows in lanes that have one row more than others
    rest = F.col("_at") - head
    lane = F.when(rest < 0, F.floor(F.col("_at") / (short + 1))).otherwise(longer + F.floor(rest / short))
    turn = F.when(rest < 0, F.col("_at") % (short + 1)).otherwise(rest % short)
    out = at.withColumn("_at", turn * lanes + lane).withColumns({"batch": F.floor(F.col("_at") / batch_size), "place": F.col("_at") % batch_size})
    if drop_remainder:
        out = out.filter(F.col("batch") < n // batch_size)
    return out.drop("_s", "_r", "_cell", "_i", "_start", "_at", *([] if epochs > 1 else ["epoch"]))


def write_batches(batched: DataFrame, path: str) -> None:
    """Parquet of batches for a trainer: files hold ranges of batches (of a shard and an epoch), in the order of reading."""
    order = [*(c for c in ("epoch", "shard") if c in batched.columns), "batch"]
    count = int(batched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    batched.repartitionByRange(count, *order).sortWithinPartitions(*order, "place").write.parquet(path)


def composition(sequences: DataFrame) -> DataFrame:
    """Bases of each channel in each sequence, long form. A sequence is encoded once: the variable of the outer function stands for its codes."""
    def counts(codes: Column) -> Column:
        n = lambda k: F.length(codes) - F.length(F.replace(codes, F.lit(str(k)), F.lit("")))
        return F.array(*[F.struct(F.lit(k).alias("code"), n(k).cast("long").alias("n")) for k in range(5)])

    return sequences.select(*keyed(sequences, "tx_id"), F.inline(F.flatten(F.transform(F.array(code_string(F.col("seq"))), counts))))


def write_windows(windows: DataFrame, path: str) -> None:
    """Parquet, one folder a species, so that reading a species prunes the rest.

    Files hold ranges of transcript ids, sorted by id and window, whatever the order of the input.
    """
    order = ["species", "tx_id", "chunk_idx"]
    count = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows.repartitionByRange(count, "species", "tx_id").sortWithinPartitions(*order).write.partitionBy("species").parquet(path)


def read_windows(spark: SparkSession, path: str, species: list[str] | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Stored windows: all, those of ``species``, or those of the species that a ``manifest`` (species, path) names.

    A manifest's species are known when the query runs; the folders of others are pruned then and not read.
    """
    df = spark.read.parquet(path)
    df = df.withColumn("species", F.col("species").cast("string")) if dict(df.dtypes)["species"] != "string" else df
    if species is not None:
        df = df.filter(F.col("species").isin(species))
    if manifest is not None:
        df = df.join(manifest.select("species").filter("species != ''").distinct(), "species", "left_semi")
    return df
