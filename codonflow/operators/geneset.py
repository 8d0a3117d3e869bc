"""Accuracy of gene sets against a reference on exon, transcript and locus level.

Inputs are exon tables (species, tid, contig, strand, start, end), the predictions with a gene_set column;
each level also takes both as one table, in which the reference's gene_set is null. Names of
sets are collected where they are not given.
Free ends (those of a transcript's outer exons) may differ by up to ``tolerance`` bases, all other ends must
be equal. Results are percent with two decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonflow.functions.labels import f1_or_nan


def union_gene_sets(sets: dict[str, DataFrame], distinct: bool = False) -> DataFrame:
    """The sets one below the other, tagged with gene_set; optionally without equal structures in a set."""
    out = None
    for name, df in sets.items():
        tagged = df.withColumn("gene_set", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    if not distinct:
        return out
    shape = out.groupBy("gene_set", "species", "tid").agg(F.first("contig").alias("contig"), F.first("strand").alias("strand"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"))
    first = shape.groupBy("gene_set", "species", "contig", "strand", "exons").agg(F.min("tid").alias("tid"))
    return out.join(first.select("gene_set", "species", "tid"), ["gene_set", "species", "tid"], "left_semi")


PLACE = ["species", "contig", "strand"]
UNIT = ["tid", "species", "mask"]
#: Sets that share a mask; more are compared in several rounds.
SETS = 60
#: Bases of a part of a contig, which a task looks at together.
PART = 100_000


def _bit(i: int) -> Column:
    return F.lit(1 << i).cast("long")


def _levels(reference: DataFrame, predictions: DataFrame | None, sets: list[str] | None, rates: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """``rates`` of the exons of all sets and of the reference as one table: bit 0 of mask is the reference, bit i the set i."""
    both, cols = reference, ["species", "tid", "contig", "strand", "start", "end"]
    if predictions is not None:
        kind = predictions.schema["gene_set"].dataType
        both = reference.select(F.lit(None).cast(kind).alias("gene_set"), *cols).unionByName(predictions.filter("gene_set is not null").select("gene_set", *cols))
    if sets is None:
        sets = sorted(r[0] for r in (both if predictions is None else predictions).select("gene_set").filter("gene_set is not null").distinct().collect())  # a handful of set names
    out = None
    for k in range(0, max(len(sets), 1), SETS):
        names, mask = sets[k : k + SETS], F.when(F.col("gene_set").isNull(), _bit(0))
        for i, name in enumerate(names, 1):
            mask = mask.when(F.col("gene_set") == name, _bit(i))
        rows = rates(both.select(mask.alias("mask"), *cols).filter("mask is not null"), names)
        out = rows if out is None else out.unionByName(rows)
    return out


def _rates(found: DataFrame, names: list[str]) -> DataFrame:
    """gene_set, species, sn, pr, f1 from how many units n of each (species, mask) have partners in near, a mask too."""
    counts = found.groupBy("species", "mask", "near").agg(F.sum("n").alias("n"))
    has = lambda c, i: F.col(c).bitwiseAND(_bit(i)) != 0
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    one = lambda i, name: F.struct(F.lit(name).alias("gene_set"), total(has("mask", i)).alias("n"), total(has("mask", i) & has("near", 0)).alias("k"), total(has("mask", 0) & has("near", i)).alias("k_ref"))
    rows = counts.groupBy("species").agg(total(has("mask", 0)).alias("n_ref"), F.array(*[one(i, name) for i, name in enumerate(names, 1)]).alias("_sets"))
    rows = rows.select("species", "n_ref", F.inline("_sets")) if names else rows.select("species", "n_ref", F.lit("").alias("gene_set"), *[F.lit(0).cast("long").alias(c) for c in ("n", "k", "k_ref")]).limit(0)
    occurs = F.sum("n").over(Window.partitionBy("gene_set")) > 0  # one row a species and set
    rows = rows.withColumn("_occurs", occurs).filter("_occurs and (n_ref > 0 or n > 0)")
    percent = lambda k, n: F.when(F.col(n) > 0, F.round(100.0 * (F.col(k) / F.nullif(F.col(n), F.lit(0))), 2)).otherwise(F.lit(float("nan")))
    out = rows.select("gene_set", "species", percent("k_ref", "n_ref").alias("sn"), percent("k", "n").alias("pr"))
    return out.withColumn("f1", f1_or_nan(F.col("sn"), F.col("pr")))


def _known(near: Column) -> Column:
    """Nothing is near what has no place."""
    return F.when(F.col("species").isNotNull() & F.col("contig").isNotNull() & F.col("strand").isNotNull(), near).otherwise(_bit(0) * 0)


def _exon_units(both: DataFrame, tolerance: int) -> DataFrame:
    """species, mask, near, n of the distinct exons; mask tells where an exon is, near where a partner is.

    Exons are sorted by a free end, with the other end as a key, and masks are put together over a frame of
    the tolerance. An exon with two free ends goes to each key in reach of its end, and is counted at its own.
    """
    w = Window.partitionBy(*UNIT)
    left, right = F.col("start") == F.min("start").over(w), F.col("end") == F.max("end").over(w)
    exons = both.select("mask", *PLACE, "start", "end", left.alias("left_free"), right.alias("right_free"))
    left, right = F.col("left_free"), F.col("right_free")
    reach = F.when(left & right, F.sequence(F.lit(-tolerance).cast("long"), F.lit(tolerance).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    slide = F.when(left, F.col("start")).when(right, F.col("end")).otherwise(F.col("start") * (tolerance + 1))
    fixed = F.when(right & ~left, F.col("start")).otherwise(F.col("end") + F.col("_off"))
    keys = ["_fixed", *PLACE, "left_free", "right_free"]
    copies = exons.withColumn("_off", F.explode(reach)).select("mask", *PLACE, "left_free", "right_free", "_off", fixed.alias("_fixed"), slide.alias("_slide"))
    units = copies.repartition(*keys).groupBy(*keys, "_slide", "_off").agg(F.bit_or("mask").alias("mask"))
    near = F.bit_or("mask").over(Window.partitionBy(*keys).orderBy("_slide").rangeBetween(-tolerance, tolerance))
    return units.withColumn("near", _known(near)).filter("_off = 0").select("species", "mask", "near", F.lit(1).cast("long").alias("n"))


def _chains(both: DataFrame) -> DataFrame:
    """Each transcript's place, its span as start and end, and its introns: their number and a digest of 128 bits."""
    w = Window.partitionBy(*UNIT).orderBy("start", "end")
    rows = both.withColumns({"_before": F.lag("end").over(w), "_i": F.row_number().over(w)})
    digest = lambda seed: F.coalesce(F.bit_xor(F.when(F.col("_i") > 1, F.xxhash64(F.lit(seed), "_i", "_before", "start"))), F.lit(0).cast("long"))
    return rows.groupBy(*UNIT).agg(F.first("contig").alias("contig"), F.first("strand").alias("strand"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("_i").alias("_n"), digest(1).alias("_h"), digest(2).alias("_g"))


def _matched(both: DataFrame, tolerance: int, reach: bool) -> DataFrame:
    """species, contig, strand, _part, mask, start, end, n, near of transcripts, equal ones once with their number n.

    Transcripts with equal intron chains and outer ends within tolerance are partners. All sets and the
    reference are dealt once, by the part of a contig in which they start. With ``reach`` a transcript also
    has a row, with a null start, in each later part into which it reaches.
    """
    tx, at = _chains(both), lambda x: F.floor(x / PART)
    chain = ["_h", "_g", "_n"]
    part = [*PLACE, "_part"]
    # Even numbers are parts for partners, odd ones those into which a transcript reaches.
    low, near, far = at(F.col("start") - tolerance), at(F.col("start") + tolerance), at(F.col("end") - 1)
    high = F.greatest(near, far) if reach else near
    numbers = F.when(low == high, F.array(2 * low)).otherwise(F.sequence(2 * low, 2 * high + 1))
    rows = tx.withColumn("_number", F.explode(numbers)).withColumns({"_part": F.shiftright("_number", 1), "_beyond": F.col("_number").bitwiseAND(F.lit(1).cast("long")) == 1})
    beyond, home = F.col("_beyond"), at(F.col("start"))
    rows = rows.filter(F.when(beyond, F.lit(reach) & (F.col("_part") > home) & (F.col("_part") <= far)).otherwise(F.col("_part") <= near))
    copies = rows.select("mask", *PLACE, *[F.when(~beyond, F.col(c)).alias(c) for c in (*chain, "start")], "end", "_part", (beyond | (F.col("_part") == home)).alias("own"))
    kinds = copies.repartition(*part).groupBy(*chain, *part, "mask", "start", "end", "own").agg(F.count("*").alias("n"))
    others = F.collect_list(F.struct("end", "mask")).over(Window.partitionBy(*chain, *part).orderBy("start").rangeBetween(-tolerance, tolerance))
    here = kinds.withColumn("_others", others).filter("own")
    near = F.aggregate(F.filter("_others", lambda o: F.abs(o["end"] - F.col("end")) <= tolerance), F.lit(0).cast("long"), lambda m, o: m.bitwiseOR(o["mask"]))
    return here.withColumn("near", _known(near)).select(*part, "mask", "start", "end", "n", "near")


def _transcripts(matched: DataFrame) -> DataFrame:
    return matched.filter("start is not null").select("species", "mask", "near", "n")


def _loci(matched: DataFrame) -> DataFrame:
    """species, mask, near, n of the loci: those that end in their part are counted there, those that go on by the part in which they began.

    A span without bases overlaps nothing after it, so each that is not inside a locus is one of its own.
    """
    part = ["_part", *PLACE, "mask"]
    w = Window.partitionBy(*part).orderBy("start", "end")  # what reaches in from earlier parts, with a null start, comes first
    new = F.col("start").isNotNull() & F.coalesce(F.col("start") >= F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    met = F.when(F.col("start").isNull(), 0).when(F.col("mask") == 1, F.shiftright("near", 1) * 2).otherwise(F.col("near").bitwiseAND(_bit(0)))
    rows = matched.select(*part, "start", "end", "n", met.cast("long").alias("near"), new.cast("int").alias("_new"))
    rows = rows.withColumn("_own", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    begun = F.when(F.col("_new") == 0, 0).when(F.col("end") <= F.col("start"), F.col("n")).otherwise(1)
    loci = rows.groupBy(*part, "_own").agg(F.max(begun).cast("long").alias("n"), F.bit_or("near").alias("near"), F.coalesce(F.max("end") <= F.min("start"), F.lit(False)).alias("_empty"))
    last = F.max("_own").over(Window.partitionBy(*part))
    role = F.when(F.col("_own") == 0, 0).when((F.col("_own") == last) & ~F.col("_empty"), 2).otherwise(1)  # goes on from before, goes on, ends here
    ends = loci.withColumn("_role", role).groupBy(*part, "_role", "near").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("mask", *PLACE).orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    began = F.last(F.when(F.col("_role") > 0, F.col("_part")), True).over(earlier)
    ends = ends.withColumn("_at", F.when(F.col("_role") == 0, began).when(F.col("_role") == 2, F.col("_part")))
    whole = ends.groupBy("mask", *PLACE, "_at", F.when(F.col("_role") == 1, F.col("near")).alias("_kind")).agg(F.bit_or("near").alias("near"), F.sum("n").alias("n"))
    return whole.select("species", "mask", "near", "n")


def exon_level(reference: DataFrame, predictions: DataFrame | None = None, tolerance: int = 3, sets: list[str] | None = None) -> DataFrame:
    """gene_set, species, sn, pr, f1 over distinct exons."""
    return _levels(reference, predictions, sets, lambda both, names: _rates(_exon_units(both, tolerance), names))


def transcript_level(reference: DataFrame, predictions: DataFrame | None = None, tolerance: int = 3, sets: list[str] | None = None) -> DataFrame:
    """gene_set, species, sn, pr, f1 over transcripts: equal intron chains, outer ends within tolerance."""
    return _levels(reference, predictions, sets, lambda both, names: _rates(_transcripts(_matched(both, tolerance, reach=False)), names))


def locus_level(reference: DataFrame, predictions: DataFrame | None = None, tolerance: int = 3, sets: list[str] | None = None) -> DataFrame:
    """gene_set, species, sn, pr, f1 over loci (chains of overlapping transcripts on a strand) with at least one matched transcript."""
    return _levels(reference, predictions, sets, lambda both, names: _rates(_loci(_matched(both, tolerance, reach=True)), names))


def all_levels(reference: DataFrame, predictions: DataFrame | None = None, tolerance: int = 3, sets: list[str] | None = None) -> DataFrame:
    """Long table gene_set, species, level, sn, pr, f1. Transcripts and loci read the same exchange."""
    def rates(both: DataFrame, names: list[str]) -> DataFrame:
        matched, out = _matched(both, tolerance, reach=True), None
        for level, found in (("exon", _exon_units(both, tolerance)), ("transcript", _transcripts(matched)), ("gene", _loci(matched))):
            rows = _rates(found, names).withColumn("level", F.lit(level))
            out = rows if out is None else out.unionByName(rows)
        return out

    return _levels(reference, predictions, sets, rates)


def accuracy_average(levels: DataFrame) -> DataFrame:
    """Mean sensitivity and precision of each gene set and level over species; pairs with a NaN are left out."""
    known = levels.filter(~F.isnan("sn") & ~F.isnan("pr"))
    return known.groupBy("gene_set", "level").agg(F.avg("sn").alias("sn"), F.avg("pr").alias("pr"))


def species_subset(found: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The asked species (name, place) that were found, in asked order, and those that were not."""
    return asked.join(found.select("name").distinct(), "name", "left_semi").orderBy("place"), asked.join(found, "name", "left_anti").orderBy("place")
