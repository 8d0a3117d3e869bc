"""What is there on disk: inputs and outputs of each species, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The species in a path.
SPECIES_FOLDER = r"/species=([^/]+)/"


def listing(spark: SparkSession, root: str, glob: str = "*", species: str = SPECIES_FOLDER) -> DataFrame:
    """species, path and bytes of the files below ``root`` whose names match ``glob``; of a missing folder none.

    The species is what ``species``, a pattern with one group, finds in the path; files without one are left
    out. No content is read.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, length long")
    raw = F.regexp_extract("path", species, 1)
    name = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return files.select(name.alias("species"), "path", F.col("length").alias("bytes")).filter("species != ''")


def inventory(spark: SparkSession, kinds: dict[str, tuple[str, str]], species: str = SPECIES_FOLDER) -> DataFrame:
    """species, kind, path and bytes of all files of several kinds: name to (root, glob)."""
    found = [listing(spark, root, glob, species).withColumn("kind", F.lit(kind)) for kind, (root, glob) in kinds.items()]
    return reduce(DataFrame.unionByName, found).select("species", "kind", "path", "bytes")


def siblings(found: DataFrame, kinds: list[str]) -> DataFrame:
    """One row a species with the sorted paths of each of ``kinds``, null where there is none: the inputs that belong together."""
    paths = F.array_sort(F.collect_list("path"))
    wide = found.groupBy("species").pivot("kind", kinds).agg(paths)
    return wide.select("species", *[F.when(F.size(k) > 0, F.col(k)).alias(k) for k in kinds])


def pending(found: DataFrame, requested: DataFrame | None, inputs: list[str], output: str) -> tuple[DataFrame, DataFrame]:
    """Species to process, with their input paths, and those that wait: species and missing kind.

    Requested are the names in ``requested`` (species), or all that have any input. Those with a file of
    kind ``output`` are done.
    """
    wide = siblings(found, [*inputs, output])
    asked = wide if requested is None else requested.select("species").distinct().join(wide, "species", "left")
    todo = asked.filter(F.col(output).isNull())
    lacking = F.filter(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in inputs]), lambda k: k.isNotNull())
    todo = todo.withColumn("_lacking", lacking)
    ready = todo.filter(F.size("_lacking") == 0).select("species", *inputs)
    return ready, todo.select("species", F.explode("_lacking").alias("missing"))
