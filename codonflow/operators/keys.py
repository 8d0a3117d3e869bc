"""Keys of tables that may hold several species."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPECIES = "species"


def keyed(df: DataFrame, *names: str) -> list[str]:
    """``names``, with the species before them if ``df`` has it: ids are unique within a species only."""
    return [*([SPECIES] if SPECIES in df.columns else []), *names]


def shared(a: DataFrame, b: DataFrame, *names: str) -> list[str]:
    """The same for a join: the species counts if both sides have it."""
    return [*([SPECIES] if SPECIES in a.columns and SPECIES in b.columns else []), *names]


def read_lines(spark: SparkSession, paths: str | list[str], root: str | None = None, **options) -> DataFrame:
    """Text lines (value) of files, with the species of ``species=<name>`` folders as a column if there are such.

    ``root`` is the folder that holds them; it is only needed where ``paths`` are patterns that do not name
    one of these folders.
    """
    several = [paths] if isinstance(paths, str) else paths
    marked = [p.split(f"/{SPECIES}=")[0] for p in several if f"/{SPECIES}=" in p]
    root = root or (marked[0] if marked else None)
    raw = spark.read.options(**options, **({"basePath": root} if root else {})).text(several)
    return raw.withColumn(SPECIES, raw[SPECIES].cast("string")) if SPECIES in raw.columns else raw
