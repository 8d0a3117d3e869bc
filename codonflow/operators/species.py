"""Species lists: sectioned tables, splits, pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonflow.functions.labels import path_key

#: Fixed values of the table format.
HEADER = r"\\multicolumn\{10\}\{l\}\{\\textbf\{(Training|Test|Validation)\}\}"
CELL = r"\\textit\{([^}]+)\}\s*&\s*([A-Z]{3}\\_[0-9]+\.[0-9]+)\s*&\s*[^&]+&\s*([A-Za-z]+)"
SPLITS = {"Training": "training", "Test": "test", "Validation": "val"}
SOURCES = ("RefSeq", "BRAKER")


def fill_sections(lines: DataFrame, is_header: F.Column, value: F.Column, by: list[str], order: str = "line_no") -> DataFrame:
    """Lines below a header with its value as ``section``; headers and lines before the first are dropped."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("_head", is_header).withColumn("section", F.last(F.when(F.col("_head"), value), ignorenulls=True).over(w))
    return out.filter(~F.col("_head") & F.col("section").isNotNull()).drop("_head")


def split_table(lines: DataFrame) -> DataFrame:
    """name, accession, annotation, split, line_no, place of every species cell in table lines (path, line_no, line)."""
    found = F.regexp_extract("line", HEADER, 1)
    filled = fill_sections(lines, found != "", found, ["path"])
    names = [F.regexp_extract_all(F.col("line"), F.lit(CELL), F.lit(i)) for i in (1, 2, 3)]
    cells = filled.select("section", "line_no", F.posexplode(F.arrays_zip(*[x.alias(n) for x, n in zip(names, ("a", "b", "c"), strict=True)])).alias("place", "cell"))
    mapping = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    return cells.select(F.trim("cell.a").alias("name"), F.replace("cell.b", F.lit("\\_"), F.lit("_")).alias("accession"), F.trim("cell.c").alias("annotation"), mapping[F.col("section")].alias("split"), "line_no", "place")


def split_leak_guard(species: DataFrame) -> DataFrame:
    """Without validation species whose name is also in another split."""
    others = species.filter("split != 'val'").select("name").distinct()
    val = species.filter("split = 'val'").join(others, "name", "left_anti")
    return species.filter("split != 'val'").unionByName(val.select(*species.columns))


def species_splits(lines: DataFrame) -> DataFrame:
    return split_leak_guard(split_table(lines))


def split_counts(species: DataFrame) -> DataFrame:
    return species.groupBy("split", "annotation").agg(F.count("*").alias("n"))


def valid_sources(species: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Species with a known annotation source, and the rejects."""
    good = F.col("annotation").isin(*SOURCES)
    return species.filter(good), species.filter(~good | F.col("annotation").isNull())


def pending(requested: DataFrame, done: DataFrame, available: DataFrame) -> DataFrame:
    """Requested names that are not done and whose inputs are there."""
    return requested.join(done.select("name"), "name", "left_anti").join(available.select("name"), "name", "left_semi")


def with_path_key(species: DataFrame) -> DataFrame:
    return species.withColumn("key", path_key(F.col("name")))
