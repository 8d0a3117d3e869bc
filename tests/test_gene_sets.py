"""Gene-set accuracy: equal to a plain walk, and made from one pass over the exons."""

import random

from codonflow.operators import geneset
from codonflow.plans.queries import QUERIES

TOP = "/root/testdata/sf0.001"
COLS = "species string, tid long, contig string, strand string, start long, end long"


def transcripts(rng, n, far):
    out = []
    for tid in range(n):
        at, long = rng.randrange(far), rng.choice([0, 0, 0, 150_000, 320_000])
        spans = [(at + 40 * k, at + 40 * k + 20) for k in range(rng.randrange(1, 4))]
        spans += [(at + long, at + long + 20)] if long else []
        out.append((rng.choice("st"), tid, rng.choice("cd"), rng.choice("+-"), spans))
    return out


def shaken(rng, rows):
    """Some left out, some again under another id, outer ends moved by up to five bases."""
    out = []
    for s, tid, c, d, spans in rows:
        for copy in range(rng.choice([0, 1, 1, 2])):
            (a, b), (y, z) = spans[0], spans[-1]
            moved = [(a - rng.randrange(6), b)] + spans[1:]
            moved[-1] = (moved[-1][0], moved[-1][1] + rng.randrange(6))
            out.append((s, tid + 1000 * copy, c, d, moved))
    return out


def walk(ref, sets):
    def exons(rows):
        return {(s, c, d, a == min(x for x, _ in e), b == max(y for _, y in e), a, b) for s, _, c, d, e in rows for a, b in e}

    def near_exon(x, y):
        return x[:5] == y[:5] and abs(x[5] - y[5]) <= 3 * x[3] and abs(x[6] - y[6]) <= 3 * x[4]

    def tx(rows):
        return [(s, c, d, tuple((e[i][1], e[i + 1][0]) for i in range(len(e) - 1)), e[0][0], e[-1][1], tid) for s, tid, c, d, e in rows]

    def near_tx(x, y):
        return x[:4] == y[:4] and abs(x[4] - y[4]) <= 3 and abs(x[5] - y[5]) <= 3

    def loci(rows):
        out, end, place, n = {}, None, None, 0
        for x in sorted(rows, key=lambda x: (x[:3], x[4], x[5], x[6])):
            fresh = x[:3] != place or x[4] >= end
            n, end, place = n + fresh, x[5] if fresh else max(end, x[5]), x[:3]
            out[x] = n
        return out

    want = {}
    for name, rows in sets.items():
        for species in "st":
            mine = [[r for r in side if r[0] == species] for side in (ref, rows)]
            e, t = [sorted(exons(m)) for m in mine], [tx(m) for m in mine]
            hit = lambda units, near: [{x for x in units[k] if any(near(x, y) for y in units[1 - k])} for k in (0, 1)]  # noqa: E731, B023
            at, found = [loci(u) for u in t], hit(t, near_tx)
            share = lambda k, n: round(100 * k / n, 2)
            want[name, species, "exon"] = tuple(share(len(h), len(u)) for h, u in zip(hit(e, near_exon), e, strict=True))
            want[name, species, "transcript"] = tuple(share(len(h), len(u)) for h, u in zip(found, t, strict=True))
            want[name, species, "gene"] = tuple(share(len({m[x] for x in h}), len(set(m.values()))) for h, m in zip(found, at, strict=True))
    return want


def frame(spark, rows):
    return spark.createDataFrame([(s, t, c, d, a, b) for s, t, c, d, e in rows for a, b in e], COLS)


def test_levels_equal_a_plain_walk(spark):
    """Copies, moved ends, single exons, and loci over several parts of a contig."""
    for seed, far in ((1, 2_000), (2, 900_000)):
        rng = random.Random(seed)
        ref = transcripts(rng, 120, far)
        sets = {name: shaken(rng, ref) + [(s, t + 5000, c, d, e) for s, t, c, d, e in transcripts(rng, 20, far)] for name in ("x", "y")}
        both = geneset.union_gene_sets({k: frame(spark, v) for k, v in sets.items()})
        got = {(r["gene_set"], r["species"], r["level"]): (r["sn"], r["pr"]) for r in geneset.all_levels(frame(spark, ref), both).collect()}
        assert got == walk(ref, sets)


def test_spans_without_bases_are_loci_of_their_own(spark):
    ref = spark.createDataFrame([("s", t, "c", "+", a, b) for t, a, b in ((1, 0, 10), (2, 5, 5), (3, 10, 10), (4, 10, 10), (5, 10, 12))], COLS)
    far = spark.createDataFrame([("s", 1, "c", "+", 12, 12)], COLS)
    row = geneset.locus_level(ref, far.selectExpr("'x' as gene_set", "*"), 2).first()
    assert (row["sn"], row["pr"]) == (75.0, 100.0)


def test_many_sets_take_several_rounds(spark):
    ref = frame(spark, [("s", 1, "c", "+", [(0, 10)])])
    both = geneset.union_gene_sets({f"x{k}": ref for k in range(geneset.SETS + 2)})
    assert [tuple(r)[2:4] for r in geneset.exon_level(ref, both).collect()] == [(100.0, 100.0)] * (geneset.SETS + 2)


def test_exons_are_read_once_for_all_sets(spark):
    """One scan a level, and no join."""
    plan = lambda name: QUERIES[name](spark, TOP)._jdf.queryExecution().optimizedPlan().toString()
    for name, scans in (("exon_level_acc", 1), ("transcript_level_acc", 1), ("locus_level_acc", 1), ("accuracy_avg", 3)):
        text = plan(name)
        assert text.count("Relation") == scans and "Join" not in text
