from pyspark.sql import functions as F

from codonflow.operators import labeling
from codonflow.streaming.incremental import ARRIVAL, label_arrivals, label_manifests


def test_stream_equals_batch_and_counts_each_file_once(spark, tmp_path):
    ref = spark.createDataFrame([("r", "c", "+", 10, 22)], "rid string, contig string, strand string, start long, end long")

    def label(df):
        tx = df.withColumn("tid", F.concat_ws(":", "species", "tid"))
        return labeling.label_transcripts(tx, ref, bin_width=50)

    def arrive(name, start):
        spark.createDataFrame([(name, "t", "c", "+", start, start + 40, 0)], ARRIVAL).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        label_arrivals(spark, f"{tmp_path}/in/*", label, f"{tmp_path}/out", f"{tmp_path}/cp", 1, f"{tmp_path}/stats", f"{tmp_path}/manifest").awaitTermination()
        return sorted((r["tid"], r["category"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    arrive("s1", 0)
    assert run() == [("s1:t", "kept_single")]
    arrive("s2", 500)
    got = run()
    assert got == [("s1:t", "kept_single"), ("s2:t", "ir_only")] == run()
    batch = label(spark.read.schema(ARRIVAL).parquet(f"{tmp_path}/in/*"))
    assert sorted((r["tid"], r["category"]) for r in batch.collect()) == got
    assert sorted((r["category"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/stats").collect()) == [("ir_only", 1), ("kept_single", 1)]
    manifest = spark.read.parquet(f"{tmp_path}/manifest").collect()
    assert sorted((r["species"], r["transcripts"]) for r in manifest) == [("s1", 1), ("s2", 1)] and all(f"/{r['species']}/" in r["path"] for r in manifest)


def test_manifests_of_species_that_come_again(spark, tmp_path):
    """Restarts, repeats and resends give what the batch operator gives for the newest files of each species."""
    import time

    ref = spark.createDataFrame([("r", s, "c", "+", 10, 22) for s in ("a", "b", "c")], "rid string, species string, contig string, strand string, start long, end long")
    label = lambda tx: labeling.label_transcripts(tx, ref, bin_width=50)
    (tmp_path / "in").mkdir()
    (tmp_path / "gtf").mkdir()

    def send(number, named):
        lines = ["# manifest", ""]
        for species, spans in named.items():
            for k, (low, high) in enumerate(spans):
                path = tmp_path / f"gtf/{species}-{number}-{k}.gtf"
                path.write_text(f'c\tx\texon\t{low + 1}\t{high}\t.\t+\t.\ttranscript_id "t{k}";\n')
                lines.append(f"{species}\t{path}")
        (tmp_path / f"in/{number}.tsv").write_text("\n".join(lines) + "\n")
        time.sleep(1.1)

    def run():
        label_manifests(spark, f"{tmp_path}/in", label, f"{tmp_path}/out", f"{tmp_path}/cp", 1, f"{tmp_path}/stats").awaitTermination()
        got = sorted((r["species"], r["tid"], r["category"], r["length"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        counts = sorted((r["species"], r["category"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/stats").collect())
        assert counts == sorted({(s, c, sum(x[0] == s and x[2] == c for x in got)) for s, _, c, _ in got})
        return got

    send(1, {"a": [(0, 40), (500, 520)], "b": [(0, 30)]})
    first = [("a", "t0", "kept_single", 40), ("a", "t1", "ir_only", 20), ("b", "t0", "kept_single", 30)]
    assert run() == first == run()
    send(2, {"a": [(600, 700)], "c": [(12, 30)]})
    send(3, {"c": [(0, 35)]})
    assert run() == [("a", "t0", "ir_only", 100), ("b", "t0", "kept_single", 30), ("c", "t0", "kept_single", 35)] == run()
