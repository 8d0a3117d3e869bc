import random

import pytest
from compare import assert_same
from pyspark.sql import functions as F

from codonflow.functions import labels as fn
from codonflow.operators import intervals, labeling, orf
from codonflow.plans.queries import QUERIES, SQL


def frames(spark, exons, cds, stops=()):
    tx = [(t, c, s, a, b, i) for i, (t, c, s, a, b) in enumerate(exons)]
    return (
        spark.createDataFrame(tx, "tid string, contig string, strand string, start long, end long, line_no long"),
        spark.createDataFrame(list(cds), "rid string, contig string, strand string, start long, end long"),
        spark.createDataFrame(list(stops), "rid string, start long, end long"),
    )


def label(spark, exons, cds, stops=()):
    tx, ref, stop = frames(spark, exons, cds, stops)
    return {r["tid"]: r for r in labeling.label_transcripts(tx, ref, stop, bin_width=50).collect()}


def dense(spark, n, a=None, b=None):
    return spark.createDataFrame([(n, a, b)], "n long, a long, b long").select(fn.dense_labels(F.col("n"), F.col("a"), F.col("b")).alias("x")).first()["x"]


def test_dense_labels(spark):
    assert dense(spark, 13, 3, 12) == [0, 0, 0, 1, 2, 3, 4, 2, 3, 4, 2, 5, 0]
    assert dense(spark, 5) == [0] * 5
    assert dense(spark, 0) == []


def test_kept_on_both_strands(spark):
    got = label(spark, [("t1", "c", "+", 100, 200), ("t2", "c", "-", 500, 600)], [("r1", "c", "+", 120, 135), ("r2", "c", "-", 510, 519)])
    assert (got["t1"]["category"], got["t1"]["orf_start"], got["t1"]["orf_end"]) == ("kept_single", 20, 35)
    assert (got["t2"]["category"], got["t2"]["orf_start"], got["t2"]["orf_end"]) == ("kept_single", 81, 90)


def test_dropped_and_negative(spark):
    exons = [("none", "c", "+", 0, 50), ("anti", "c", "+", 100, 200), ("over", "c", "+", 300, 400), ("part", "c", "+", 500, 600), ("dot", "c", ".", 700, 800)]
    cds = [("r1", "c", "-", 110, 140), ("r2", "c", "+", 380, 410), ("r3", "c", "+", 510, 530), ("r4", "c", "+", 710, 740), ("r5", "other", "+", 0, 30)]
    got = {k: v["category"] for k, v in label(spark, exons, cds).items()}
    assert got == {"none": "ir_only", "anti": "dropped_antisense_only", "over": "dropped_not_contained", "part": "dropped_ref_partial", "dot": "dropped_antisense_only"}
    assert label(spark, [("d", "c", ".", 0, 90)], [("r", "c", ".", 9, 30)])["d"]["category"] == "kept_single"


def test_cds_inside_an_intron_counts_as_overlap(spark):
    got = label(spark, [("t", "c", "+", 0, 50), ("t", "c", "+", 150, 200)], [("r", "c", "+", 80, 110)])
    assert got["t"]["category"] == "dropped_not_contained"


def test_introns_must_match(spark):
    exons = [("t", "c", "+", 0, 50), ("t", "c", "+", 150, 200)]
    assert label(spark, exons, [("r", "c", "+", 41, 50), ("r", "c", "+", 150, 159)])["t"]["orf_start"] == 41
    assert label(spark, exons, [("r", "c", "+", 41, 47), ("r", "c", "+", 150, 159)])["t"]["category"] == "dropped_not_contained"


def test_longest_then_smallest_id(spark):
    exons = [("t", "c", "+", 0, 300)]
    got = label(spark, exons, [("b", "c", "+", 0, 30), ("a", "c", "+", 60, 90), ("z", "c", "+", 120, 129)])["t"]
    assert (got["category"], got["chosen_ref"], got["orf_start"]) == ("kept_multi", "a", 60)


def test_touching_stop_codon_merges(spark):
    _, ref, stop = frames(spark, [], [("r", "c", "+", 10, 61)], [("r", 61, 64), ("lost", 5, 8)])
    got = labeling.references(ref, stop).collect()
    assert [(r["rid"], r["cds_len"], len(r["cds"]), r["has_stop_codon"], r["complete"]) for r in got] == [("r", 54, 1, True, True)]


def test_last_line_gives_the_place(spark):
    tx, _, _ = frames(spark, [("t", "c1", "+", 0, 10), ("t", "c2", "-", 20, 30)], [])
    got = labeling.transcripts(tx).first()
    assert (got["contig"], got["strand"], got["mixed_places"]) == ("c2", "-", True)


def test_empty_tables(spark):
    assert label(spark, [], []) == {}
    assert label(spark, [("t", "c", "+", 0, 9)], [])["t"]["category"] == "ir_only"


def test_projection_equals_a_walk_over_bases(spark):
    rng, exons, cds, expect = random.Random(3), [], [], {}
    for k in range(150):
        contig, strand, at, own = f"c{k}", rng.choice("+-"), 0, []
        for _ in range(rng.randint(1, 4)):
            at += rng.randint(1, 8)
            own.append((at, at + rng.randint(3, 15)))
            at = own[-1][1]
        bases = [p for a, b in own for p in range(a, b)]
        i = rng.randrange(len(bases))
        part = bases[i : i + 3 * rng.randint(1, 6)]
        if rng.random() < 0.4:
            part = sorted({p + rng.randint(-1, 1) for p in part})
        runs = []
        for p in part:
            if runs and runs[-1][1] == p:
                runs[-1][1] = p + 1
            else:
                runs.append([p, p + 1])
        exons += [(f"t{k}", contig, strand, a, b) for a, b in own]
        cds += [(f"r{k}", contig, strand, a, b) for a, b in runs]
        places = [bases.index(p) if p in bases else None for p in part]
        fits = None not in places and places == list(range(places[0], places[0] + len(places)))
        ok = fits and len(part) >= 6 and len(part) % 3 == 0
        first = places[0] if ok else None
        expect[f"t{k}"] = None if not ok else first if strand == "+" else len(bases) - first - len(part)
    got = label(spark, exons, cds)
    assert {k: v["orf_start"] for k, v in got.items()} == expect
    assert any(v is not None for v in expect.values()) and any(v is None for v in expect.values())


def test_overlap_join_across_bins(spark):
    rng = random.Random(5)
    make = lambda n: [(i, rng.choice("xy"), s := rng.randint(0, 400), s + rng.randint(0, 250)) for i in range(n)]
    a, b = make(60), make(60)
    left = spark.createDataFrame(a, "a int, contig string, s long, e long")
    right = spark.createDataFrame(b, "b int, contig string, s2 long, e2 long")
    got = [(r["a"], r["b"]) for r in intervals.overlap_join(left, right, ["contig"], ("s", "e", "s2", "e2"), 64).collect()]
    assert sorted(got) == sorted((i, j) for i, c, s, e in a for j, d, t, f in b if c == d and s < f and t < e and s < e and t < f)
    assert len(got) == len(set(got))


def test_orfs_come_back_from_labels(spark):
    rows = [("a", 40, 4, 16), ("b", 9, 0, 9), ("c", 12, None, None)]
    df = spark.createDataFrame(rows, "tx_id string, n long, s long, e long").select("tx_id", fn.dense_labels(F.col("n"), F.col("s"), F.col("e")).alias("labels"))
    long = orf.explode_labels(df)
    got = orf.extract_orfs(long, "tx_id").collect()
    assert sorted(tuple(r) for r in got) == [("a", 4, 16), ("b", 0, 9)]
    bad = [tuple(r) for r in orf.transition_audit(long, "reference", "tx_id").collect()]
    assert bad == [(2, 5, 2)]  # one forbidden pair an ORF, E1 to STOP
    assert orf.transition_audit(long, "label_cycle", "tx_id").count() == 0


def test_extraction_takes_a_frame_without_coding_bases_and_restarts(spark):
    labels = [1, 5, 0, 1, 2, 1, 4, 4, 5, 5, 1, 0, 5]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(labels)], "seq_id string, pos long, label int")
    assert sorted(tuple(r)[1:] for r in orf.extract_orfs(df).collect()) == [(0, 2), (5, 9)]


def test_segments_on_both_strands(spark):
    tx, _, _ = frames(spark, [("p", "c", "+", 0, 10), ("p", "c", "+", 20, 30), ("m", "c", "-", 0, 10), ("m", "c", "-", 20, 30)], [])
    orfs = spark.createDataFrame([("p", 4, 13), ("m", 4, 13)], "tid string, orf_start long, orf_end long")
    seg = orf.orf_segments(orfs, tx)
    got = sorted((r["tid"], r["start"], r["end"], r["frame"], r["phase"]) for r in seg.collect())
    assert got == [("m", 7, 10, 0, 0), ("m", 20, 26, 0, 0), ("p", 4, 10, 0, 0), ("p", 20, 23, 0, 0)]
    lines = [r["line"] for r in orf.gtf_lines(seg, "s").orderBy("tid", "start").collect()]
    assert lines[0] == 'c\ts\tCDS\t8\t10\t.\t-\t0\ttranscript_id "m"; gene_id "m";'
    shifted = orf.orf_segments(spark.createDataFrame([("p", 5, 14)], "tid string, orf_start long, orf_end long"), tx)
    assert sorted((r["frame"], r["phase"]) for r in shifted.collect()) == [(0, 0), (2, 1)]


def test_hot_bin_is_split(spark):
    """One bin with 10^4 left and 300 right rows: shares are even, and pairs those of the plain join."""
    left = spark.range(10_000).selectExpr("id AS a", "'c' AS contig", "(id * 7) % 900 AS s", "(id * 7) % 900 + 1 + id % 5 AS e").unionByName(spark.createDataFrame([(-1, "c", 5000, 5010), (-2, None, 0, 9)], "a long, contig string, s long, e long"))
    right = spark.range(300).selectExpr("id AS b", "'c' AS contig", "id * 3 AS s2", "id * 3 + 4 AS e2")
    bounds = ("s", "e", "s2", "e2")
    pairs = lambda **o: sorted(((r["a"], r["b"]) for r in intervals.overlap_join(left, right, ["contig"], bounds, 1000, **o).collect()), key=str)
    plain = pairs()
    assert pairs(split_pairs=100_000) == plain and len(plain) > 10_000
    assert pairs(split_pairs=100_000, keep_left=True) == pairs(keep_left=True)
    bins = [df.selectExpr("contig", "0 AS _bin") for df in (left.filter("a >= 0"), right)]
    assert intervals.bin_shares(*bins, ["contig", "_bin"], 100_000).first()["_shares"] == 30
    joined = intervals.overlap_join(left, right, ["contig"], bounds, 1000, split_pairs=100_000)
    sizes = left.filter("a >= 0").groupBy(F.pmod(F.xxhash64("a", "contig", "s", "e"), F.lit(30))).count().agg(F.max("count"), F.min("count")).first()
    assert sizes[0] < 2 * sizes[1] and "_share" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_interval_arrays_do_not_go_through_the_bins(spark):
    tx, ref, _ = frames(spark, [("t", "c", "+", 0, 900)], [("r", "c", "+", 9, 30)])
    plan = labeling.candidates(labeling.transcripts(tx), labeling.references(ref), 50)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(joins) >= 2 and all("exons" not in line and "cds" not in line for line in joins)


def test_overlapped_equals_brute_force(spark):
    rng = random.Random(9)
    place = lambda: rng.choice(["x", "y", None])
    a = [(i, place(), s := rng.randint(0, 900), s + rng.randint(0, 60)) for i in range(200)]
    b = [(place(), s := rng.randint(0, 900), s + (rng.randint(0, 30) if k % 10 else 300), k % 3 == 0) for k in range(60)]
    left = spark.createDataFrame(a, "a int, contig string, s long, e long")
    right = spark.createDataFrame(b, "contig string, s2 long, e2 long, odd boolean")
    got = intervals.overlapped(left, right, ["contig"], ("s", "e", "s2", "e2"), {"any": F.lit(True), "some": F.col("odd")}, 64).collect()
    meets = lambda c, s, e, odd: any(c == d and s < f and t < e and t < f and (o or not odd) for d, t, f, o in b if c)
    assert sorted((r["a"], r["any"], r["some"]) for r in got) == [(i, meets(c, s, e, False), meets(c, s, e, True)) for i, c, s, e in a if s < e]
    assert len({(r["any"], r["some"]) for r in got}) == 3


def test_long_references_take_one_row(spark):
    """A reference of 10^13 bases would be cut into 2 * 10^11 bins."""
    far = 10**13
    exons = [("t", "c", "+", 100, 200), ("u", "c", "-", 300, 400), ("v", "d", "+", 100, 200), ("w", "c", "+", 600, 700)]
    cds = [("long", "c", "+", 0, 9), ("long", "c", "+", far, far + 10), ("in", "c", "+", 120, 135)]
    got = {k: (v["category"], v["chosen_ref"]) for k, v in label(spark, exons, cds).items()}
    assert got == {"t": ("kept_single", "in"), "u": ("dropped_antisense_only", None), "v": ("ir_only", None), "w": ("dropped_ref_partial", None)}


@pytest.fixture(scope="module")
def far_ids(spark, tmp_path_factory):
    """Order keys so far apart that references a and b of the fixture share ids and reach over 20 million bases."""
    top = tmp_path_factory.mktemp("far")
    rows = [(t + far, n) for far in (0, 1_000_000) for t in range(300) if not far or (t + far) % 11 for n in range(1, 2 + t % 4)]
    spark.createDataFrame(rows, "l_orderkey int, l_linenumber int").write.parquet(f"{top}/lineitem.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["label_category", "label_stats_by_species", "longest_cds", "gtf_lines", "species_summary"])
def test_shared_ids_equal_sql(spark, far_ids, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{far_ids}/lineitem.parquet/*.parquet'")
    assert_same(QUERIES[name](spark, far_ids), con, SQL[name])
