"""Helpers shared by the corpus operators: scratch tables, input selection, small maths."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the one that the cluster names in ``spark.checkpoint.dir``; only where that is unset and Spark
    runs on one machine, as in tests, a local folder is created and recorded there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="codonflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def one_off_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of actions in this block go when the action ends, as nothing reads them again."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that run actions of their own before they return a DataFrame."""
    @wraps(f)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        with one_off_shuffles(df.sparkSession):
            return f(df, *args, **options)

    return run


def stored(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with one_off_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def bucketed(df: DataFrame, tag: str, key: str) -> DataFrame:
    """The same as a table by hash of ``key``: joins and groupings on it then read it without an exchange."""
    spark = df.sparkSession
    name, path = f"{tag}_{uuid.uuid4().hex}", new_path(spark, tag)
    with one_off_shuffles(spark):
        df.write.bucketBy(parts(spark), key).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._stored_at, out._table = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` or ``bucketed`` wrote; nothing that is still to run may read it."""
    for df in tables:
        spark = df.sparkSession
        if hasattr(df, "_table"):
            spark.sql(f"DROP TABLE IF EXISTS {df._table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over dicts of column lists, at most ``rows`` rows at a time; ``fn`` returns a dict of output columns."""
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pack(fn(batch.slice(at, rows).to_pydict()), arrow)

    return df.mapInArrow(run, schema)


def to_arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def pack(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_fold(id_col: str, folds: int) -> F.Column:
    """Unsigned CRC-32 of the id's decimal text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)
