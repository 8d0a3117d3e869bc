"""Queries over whole texts, against brute force."""

import itertools
import random

import pytest

from codonflow.operators import orf
from codonflow.plans import fixtures as fx
from codonflow.plans import queries as q
from codonflow.sources import sequences

BASE = dict(zip(fx.FROM, fx.TO, strict=True))
CODE = dict(zip("ACGTNacgtn", "0123401234", strict=True))
OTHER = dict(zip("ACGTacgt", "TGCAtgca", strict=True))


def bases(text):
    return "".join(BASE.get(c, c) for c in text)


def codes(seq):
    return "".join(CODE.get(c, "4") for c in seq)


def revcomp(seq):
    return "".join(OTHER.get(c, "N") for c in reversed(seq))


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """A folder with documents beyond 2,000 and 9,999 characters, and the texts."""
    rng = random.Random(3)
    found = {i: "".join(rng.choice("abcdefg tuvABé.😀\n") for _ in range(n)) for i, n in enumerate([0, 5, 299, 2000, 2001, 12_345, 31_000])}
    top = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(found.items()), "doc_id long, text string").write.parquet(f"{top}/documents.parquet")
    return top, found


def test_encode_and_labels_of_whole_texts(spark, texts):
    top, found = texts
    got = {r["tx_id"]: r["codes"] for r in q.QUERIES["nt_encode"](spark, top).collect()}
    assert got == {str(i): codes(bases(t)) for i, t in found.items()}
    got = {r["tx_id"]: r["seq"] for r in q.QUERIES["revcomp"](spark, top).collect()}
    assert got == {str(i): revcomp(bases(t)) for i, t in found.items()}
    got = {r["tx_id"]: r["labels"] for r in q.QUERIES["dense_labels"](spark, top).collect()}
    for i, t in found.items():
        n = len(t)
        orf = 3 * ((n - 10) // 3)
        inner = "1" + "".join(itertools.islice(itertools.cycle("234"), orf - 2)) + "5" if n >= 30 else ""
        assert got[str(i)] == ("0" * (i % 7) + inner + "0" * (n - i % 7 - orf) if n >= 30 else "0" * n)


def test_windows_of_whole_texts(spark, texts):
    top, found = texts
    want = {(str(i), k): codes(bases(t))[k * q.WIDTH : (k + 1) * q.WIDTH] for i, t in found.items() for k in range(-(-len(t) // q.WIDTH))}
    got = {(r["tx_id"], r["chunk_idx"]): r["x"][: r["real_len"]] for r in q.QUERIES["tile_windows"](spark, top).collect()}
    assert got == want
    scored = {(r["tx_id"], r["chunk_idx"]) for r in q.QUERIES["score_windows"](spark, top).collect()}
    assert scored == set(want)


def test_splice_joins_all_exons(spark, texts):
    top, found = texts
    rng = random.Random(4)
    lines = [(tid, k) for tid in range(0, 2500, 3) for k in rng.sample(range(1, 8), rng.randint(1, 7))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long").write.mode("overwrite").parquet(f"{top}/lineitem.parquet")
    want = {}
    for tid in {t for t, _ in lines}:
        contig = bases(found.get(tid % 25, ""))  # one document a contig
        starts = sorted(tid // 50 * 1000 + k * 100 for t, k in lines if t == tid)
        move = starts[0] % max(len(contig) - (starts[-1] + 60 - starts[0]) + 1, 1) - starts[0]
        seq = "".join("".join(c if c in "ACGTacgt" else "N" for c in contig[s + move : s + move + 60]) for s in starts)
        if seq:
            want[tid] = seq if tid % 2 == 0 else revcomp(seq)
    got = {r["tid"]: r["seq"] for r in q.QUERIES["splice_sequence"](spark, top).collect()}
    assert got == want
    assert max(map(len, got.values())) == 420


def test_tiles_of_documents_equal_tiles_of_contigs(spark):
    rng = random.Random(5)
    docs = [(f"c{i % 3}", i, "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 1, 6, 7, 8, 40])))) for i in rng.sample(range(-20, 200), 150)]
    want = {}
    for c, _, s in sorted(docs):
        want[c] = want.get(c, "") + s
    tiles = sequences.document_tiles(spark.createDataFrame(docs, "contig string, d long, seq string"), 7, 10)
    assert {(r["contig"], r["tile"]): r["seq"] for r in tiles.collect()} == {(c, k): s[7 * k : 7 * k + 7] for c, s in want.items() for k in range(-(-len(s) // 7))}


def test_gtf_is_written_by_several_tasks(spark, tmp_path):
    lines = spark.createDataFrame([(i, s, f"{i} {s}") for i in range(200) for s in (5, 1)], "tid long, start long, line string")
    orf.write_gtf(lines, str(tmp_path / "g"))
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "g").glob("part-*"))]
    assert sum(map(bool, parts)) > 1
    assert sum(parts, []) == [f"{i} {s}" for i in sorted(map(str, range(200))) for s in (1, 5)]
