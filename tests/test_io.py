import random

from pyspark.sql import functions as F

from codonflow.operators import labeling, species, windows
from codonflow.sources import annotation, inventory, sequences, tables


def test_features_and_exons(spark, tmp_path):
    (tmp_path / "a.gtf").write_text(
        "# head\n\nc1\tx\ttranscript\t1\t99\t.\t+\t.\ttranscript_id \"T1\";\n"
        'c1\tx\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "T1"; transcript_id "T9";\r\n'
        "c1\tx\texon\t31\n"
        'c1\tx\texon\t31\t40\t.\t+\t.\tgene_id "g;"\n'
    )
    got = annotation.exon_table(annotation.read_features(spark, str(tmp_path / "a.gtf"))).collect()
    assert [(r["tid"], r["contig"], r["start"], r["end"]) for r in got] == [("T1", "c1", 10, 20)]


def test_attribute_dialects(spark):
    texts = ['transcript_id "A"; x "1"', "ID=cds;Parent=B;", 'note "k=v"; transcript_id "C"', "Parent=", "transcript_id=; Parent=D", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(annotation.attribute(F.col("t"), "transcript_id").alias("t"), annotation.attribute(F.col("t"), "Parent").alias("p")).collect()
    assert [tuple(r) for r in got] == [("A", None), (None, "B"), ("C", None), (None, ""), ("", "D"), (None, None)]


def test_reference_tables(spark, tmp_path):
    (tmp_path / "r.gff").write_text("c\tx\tCDS\t1\t9\t.\t+\t0\tID=1;Parent=P\nc\tx\tstop_codon\t10\t12\t.\t+\t0\tParent=P\nc\tx\tstop_codon\t10\t12\t.\t+\t0\tParent=Q\n")
    f = annotation.read_features(spark, str(tmp_path / "r.gff"))
    assert [(r["rid"], r["start"], r["end"]) for r in annotation.ref_cds_table(f).collect()] == [("P", 0, 9)]
    assert [(r["rid"], r["start"], r["end"]) for r in annotation.stop_codon_table(f).collect()] == [("P", 9, 12)]


def test_fasta(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">one some text > more\nACGT\nAC\n\n>two\r\nGG\r\nTT\r\n>one again\nTTT\n>none\n")
    df = sequences.read_fasta(spark, str(tmp_path / "s.fa"))
    assert {r["tx_id"]: r["seq"] for r in df.collect()} == {"one": "TTT", "two": "GGTT", "none": ""}
    kept = spark.createDataFrame([("two",), ("absent",)], "tx_id string")
    assert sequences.write_fasta(df, str(tmp_path / "out"), kept) == 1
    assert {r["tx_id"]: r["seq"] for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()} == {"two": "GGTT"}


def test_splice_over_tiles(spark):
    genome = spark.createDataFrame([("c", "AACCGGTTACGTACGTAA")], "contig string, seq string")
    exons = spark.createDataFrame([("p", "c", "+", 1, 7, 0), ("p", "c", "+", 9, 12, 1), ("m", "c", "-", 1, 7, 0), ("m", "c", "-", 9, 12, 1)], "tid string, contig string, strand string, start long, end long, line_no long")
    got = {r["tid"]: r["seq"] for r in sequences.splice(exons, sequences.genome_tiles(genome, 5), 5).collect()}
    assert got == {"p": "ACCGGTCGT", "m": "ACGACCGGT"}


def test_species_table(spark, tmp_path):
    row = r"\textit{%s} & %s\_%s & 1,0 & %s & 9 \\"
    head = r"\multicolumn{10}{l}{\textbf{%s}} \\"
    lines = [row % ("Too early", "GCF", "1.1", "RefSeq"), head % "Training", row % ("Musca una", "GCF", "2.1", "RefSeq") + " & " + row % ("Musca duo", "GCA", "3.2", "BRAKER"), head % "Test", row % ("Apis tria", "GCF", "4.1", "RefSeq"), head % "Validation", row % ("Apis tria", "GCF", "4.1", "BRAKER"), row % ("Culex quattuor", "GCA", "5.1", "BRAKER")]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "path string, line_no int, line string")
    out = species.species_splits(df)
    got = sorted((r["name"], r["accession"], r["annotation"], r["split"]) for r in out.collect())
    assert got == [("Apis tria", "GCF_4.1", "RefSeq", "test"), ("Culex quattuor", "GCA_5.1", "BRAKER", "val"), ("Musca duo", "GCA_3.2", "BRAKER", "training"), ("Musca una", "GCF_2.1", "RefSeq", "training")]
    tables.write_species(out, str(tmp_path / "species"))
    back = spark.read.option("header", True).csv(str(tmp_path / "species"))
    assert back.count() == 4 and set(back.columns) == {"species", "accession", "annotation", "split"}
    assert species.with_path_key(out).filter("key = 'Musca_una'").count() == 1


def test_species_csv_with_crlf(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes(b"species,accession,annotation\r\nMusca una,GCF_1,RefSeq\r\n")
    assert [tuple(r) for r in tables.read_species(spark, str(tmp_path / "s.csv")).collect()] == [("Musca una", "GCF_1", "RefSeq")]


def test_manifest_logs_labels_reports(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# c\n\nsp\t/a/b\n/only\n")
    assert [tuple(r) for r in tables.read_manifest(spark, str(tmp_path / "m.tsv")).collect()] == [("sp", "/a/b"), (None, "/only")]
    run = tmp_path / "logs" / "run_x"
    run.mkdir(parents=True)
    (run / "log.tsv").write_text("epoch\taccuracy\tloss\tval_accuracy\tval_loss\n0\t0.1\t1.0\t0.2\t0.9\n1\t0.1\t1.0\t0.2\t0.8\n")
    assert [(r["run"], r["val_loss"]) for r in tables.read_run_logs(spark, f"{tmp_path}/logs/*").orderBy("epoch").collect()] == [("run_x", 0.9), ("run_x", 0.8)]
    labelled = spark.createDataFrame([("a", "kept_single", 12, 2, 11), ("b", "ir_only", 3, None, None), ("c", "dropped_ref_partial", 4, None, None)], "tid string, category string, length long, orf_start long, orf_end long")
    tables.write_labels(labelled, str(tmp_path / "labels"))
    got = {r["tid"]: r["labels"] for r in tables.read_labels(spark, str(tmp_path / "labels"), dense=True).collect()}
    assert got == {"a": [0, 0, 1, 2, 3, 4, 2, 3, 4, 2, 5, 0], "b": [0, 0, 0]}
    tables.write_report(spark.createDataFrame([("x", 0.5)], "k string, v double"), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), sep="\t", header=True).first()["v"] == "0.500000"


def test_fasta_straight_to_tiles(spark, tmp_path):
    """Lines of unequal length, contigs over many input splits, equal ids, empty records and two species."""
    import random

    rng = random.Random(4)
    for name in ("a", "b"):
        folder = tmp_path / f"species={name}"
        folder.mkdir()
        for f in range(2):
            out = ["", "ACGT"] if f else []  # bases before any header belong to no record
            for c in [f"chr{f}", f"alt{f} some words", "twice", "none", f"last{f}"]:
                bases = "".join(rng.choice("ACGTN") for _ in range(0 if c == "none" else rng.choice([3, 700, 5000])))
                out.append(f">{c}")
                while bases:
                    n = rng.choice([1, 7, 60, 61, 400])
                    out.append(bases[:n] + rng.choice(["", "\r", " "]))
                    bases = bases[n:]
            (folder / f"g{f}.fa").write_text("\n".join(out) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    whole = sequences.read_fasta(spark, str(tmp_path)).withColumnRenamed("tx_id", "contig")
    rows = lambda df: sorted(tuple(r) for r in df.select("species", "contig", "tile", "seq").collect())
    want = rows(sequences.genome_tiles(whole.filter("contig != ''"), 128))
    before = spark.conf.get(key)
    for split in ("997", "64", before):
        spark.conf.set(key, split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if split != before else "4194304")
        got = sequences.fasta_tiles(spark, str(tmp_path), 128)
        assert rows(got) == want, split
        if split == "997":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.files.openCostInBytes", "4194304")
    assert {r[0] for r in want} == {"a", "b"} and max(len(r[3]) for r in want) == 128
    assert rows(sequences.fasta_tiles(spark, f"{tmp_path}/species=a/*.fa", 128)) == [r for r in want if r[0] == "a"]


def test_species_stay_apart_from_files_to_the_store(spark, tmp_path):
    """Two species with equal transcript ids, through annotation files, sequences, labels and the label store."""
    for name, end, seq in (("a", 12, "ACGTACGTACGT"), ("b", 30, "T" * 30)):
        folder = tmp_path / f"in/species={name}"
        folder.mkdir(parents=True)
        (folder / "tx.gtf").write_text(f'c\tx\texon\t1\t{end}\t.\t+\t.\ttranscript_id "t1";\nc\tx\texon\tnine\t12\t.\t+\t.\ttranscript_id "t2";\n')
        (folder / "tx.fa").write_text(f">t1\n{seq}\n")
    features = annotation.read_features(spark, f"{tmp_path}/in/*/*.gtf", root=f"{tmp_path}/in")
    assert sorted((r["species"], r["end"]) for r in annotation.exon_table(features).filter("tid = 't1'").collect()) == [("a", 12), ("b", 30)]
    assert {(r["species"], r["feature"]) for r in annotation.unplaced(features).collect()} == {("a", "exon"), ("b", "exon")}
    good, rejects = labeling.placed(annotation.exon_table(features))
    assert sorted(tuple(r) for r in rejects.collect()) == [("a", "t2", 1, 1), ("b", "t2", 1, 1)]
    labelled = labeling.label_transcripts(good, annotation.ref_cds_table(features))
    tables.write_labels(labelled, f"{tmp_path}/labels")
    back = tables.read_labels(spark, f"{tmp_path}/labels")
    assert sorted((r["species"], r["tid"], r["length"]) for r in back.collect()) == [("a", "t1", 12), ("b", "t1", 30)]
    seqs = sequences.read_fasta(spark, f"{tmp_path}/in/*/*.fa", root=f"{tmp_path}/in")
    assert sorted(tuple(r) for r in seqs.collect()) == [("a", "t1", "ACGTACGTACGT"), ("b", "t1", "T" * 30)]
    assert {(r["species"], r["code"], r["n"]) for r in windows.composition(seqs).filter("n > 0").collect()} == {("a", k, 3) for k in range(4)} | {("b", 3, 30)}
    paired, bad = windows.pair_with_labels(seqs, back.withColumnRenamed("tid", "tx_id"))
    assert paired.count() == 2 and bad.count() == 0


def test_inventory_of_a_folder_tree(spark, tmp_path):
    for path in ("win/species=a/p0.parquet", "win/species=b/p0.parquet", "win/species=b/p1.parquet", "win/species=E%20coli/p0.parquet", "gtf/species=a/tx.gtf", "gtf/species=c/tx.gtf", "gtf/species=b/tx.gtf", "gtf/species=b/notes.txt", "gtf/stray.gtf", "out/species=b/prediction.gtf"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x" * 7)
    kinds = {"windows": (f"{tmp_path}/win", "*.parquet"), "exons": (f"{tmp_path}/gtf", "*.gtf"), "done": (f"{tmp_path}/out", "*.gtf"), "none": (f"{tmp_path}/absent", "*")}
    found = inventory.inventory(spark, kinds)
    assert sorted((r["species"], r["kind"], r["bytes"]) for r in found.collect()) == sorted([("a", "windows", 7), ("b", "windows", 7), ("b", "windows", 7), ("E coli", "windows", 7), ("a", "exons", 7), ("b", "exons", 7), ("c", "exons", 7), ("b", "done", 7)])
    read = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line]
    assert read and all("content" not in line.split("ReadSchema")[1] for line in read)
    ready, waiting = inventory.pending(found, None, ["windows", "exons"], "done")
    assert [(r["species"], len(r["windows"]), r["exons"][0].split("/")[-1]) for r in ready.collect()] == [("a", 1, "tx.gtf")]
    assert sorted(tuple(r) for r in waiting.collect()) == [("E coli", "exons"), ("c", "windows")]
    asked = spark.createDataFrame([("a",), ("b",), ("new",)], "species string")
    ready, waiting = inventory.pending(found, asked, ["windows", "exons"], "done")
    assert [r["species"] for r in ready.collect()] == ["a"] and sorted(tuple(r) for r in waiting.collect()) == [("new", "exons"), ("new", "windows")]
    both = {r["species"]: (r["windows"] and len(r["windows"]), r["exons"] is not None) for r in inventory.siblings(found, ["windows", "exons"]).collect()}
    assert both == {"a": (1, True), "b": (2, True), "c": (None, True), "E coli": (1, False)}


def test_windows_read_by_manifest(spark, tmp_path):
    rows = [(s, "t", 0, 4, "0123") for s in ("a", "b", "c", "d", "e")]
    windows.write_windows(spark.createDataFrame(rows, "species string, tx_id string, chunk_idx long, real_len int, x string"), f"{tmp_path}/w")
    (tmp_path / "m.tsv").write_text("# two of five\nb\tx/b\nd\tx/d\nd\ty/d\n\n")
    got = windows.read_windows(spark, f"{tmp_path}/w", manifest=tables.read_manifest(spark, f"{tmp_path}/m.tsv"))
    assert sorted(r["species"] for r in got.collect()) == ["b", "d"]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString().lower()


def test_bucketed_stores_join_and_stitch_without_an_exchange(spark, tmp_path):
    """Equal ids in two species; the second species arrives later."""
    import random

    rng = random.Random(6)
    names = {k: f"{k}_{tmp_path.name.replace('-', '_')}" for k in ("seqs", "labels", "windows")}
    seqs = [(s, f"t{i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40)))) for s in ("a", "b") for i in range(60)] + [("a", None, "ACGT")]
    found = [(s, t, "kept_single" if len(x) % 2 else "ir_only", len(x), *((1, len(x)) if len(x) % 2 else (None, None))) for s, t, x in seqs if t] + [("a", "dropped", "dropped_ref_partial", 4, None, None)]
    plain = spark.createDataFrame(seqs, "species string, tx_id string, seq string")
    labels = spark.createDataFrame(found, "species string, tid string, category string, length long, orf_start long, orf_end long")
    for mode, s in (("errorifexists", "a"), ("append", "b")):
        own = F.col("species") == s
        tables.store_bucketed(plain.filter(own).repartition(7), names["seqs"], buckets=5, path=f"{tmp_path}/seqs", mode=mode)
        tables.store_labels(labels.filter(own), names["labels"], 5, mode=mode)
    assert len(list((tmp_path / "seqs").glob("*.parquet"))) <= 10  # a file a bucket and write
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        tiled = windows.tile_text(windows.pair_with_labels(spark.table(names["seqs"]), spark.table(names["labels"]))[0], 8)
        rows = sorted(tuple(r) for r in tiled.collect())
        assert "Exchange" not in tiled._jdf.queryExecution().executedPlan().toString()
        want = windows.tile_text(windows.pair_with_labels(plain, labels.filter("category != 'dropped_ref_partial'").drop("category").withColumnRenamed("tid", "tx_id"))[0], 8)
        assert rows == sorted(tuple(r) for r in want.collect()) and {r[0] for r in rows} == {"a", "b"}
        tables.store_bucketed(tiled, names["windows"], buckets=5, order=("chunk_idx",))
        stitched = windows.stitch(spark.table(names["windows"]).withColumn("x", F.expr("left(x, real_len)")), "tx_id", "chunk_idx", "x")
        whole = {(r["species"], r["tx_id"]): "".join("ACGT"[int(c)] for c in r["x"]) for r in stitched.collect()}
        assert "Exchange" not in stitched._jdf.queryExecution().executedPlan().toString()
        assert whole == {(s, t): x for s, t, x in seqs if t}
        tables.store_bucketed(plain.limit(0), names["seqs"], buckets=5, path=f"{tmp_path}/seqs", mode="append")
        assert spark.table(names["seqs"]).filter("tx_id is null").count() == 1
    finally:
        spark.conf.set(key, before)
        for name in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_attribute_equals_a_walk_over_chunks_and_is_compiled(spark):
    rng = random.Random(4)
    parts = ["k", "k", "kk", "x", " ", " ", "=", ";", ";", '"', "v", "k=", "k ", '; k "a b"', "=v"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + [None]

    def walk(text):
        for c in (text or "").split(";"):
            c = c.strip(" ")
            sep = "=" if "=" in c and " " not in c.split("=")[0] else " "
            name, found, value = c.partition(sep)
            if found and name.strip(" ") == "k":
                return value.strip(" ").strip('"')
        return None

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    out = df.select("i", "t", annotation.attribute(F.col("t"), "k").alias("k"))
    got = {r["i"]: r["k"] for r in out.collect()}
    assert got == {i: walk(t) for i, t in enumerate(texts)} and len(set(got.values())) > 20
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
