"""Annotation-shaped tables derived from the given tables, with the same expressions in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BIN = 1_000
POSITIONS = 11  # of six values in a vector of 64
LOWER = "abcdefghijklmnopqrstuvwxyz"
FROM, TO = LOWER + LOWER.upper(), "acgt" * 6 + "ac" + "ACGT" * 6 + "AC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tx_exon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exons, dealt by transcript once: what then groups or orders by transcript needs no other exchange.

    The number of parts is given, as all work by transcript is done in them: lines are short, and parts put
    together by their size leave some cores, or in a union all but one, without work.
    """
    cores = spark.sparkContext.defaultParallelism
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores), 8 * cores)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("tid"), F.col("l_linenumber").cast("long").alias("line_no")).repartition(parts, "tid").distinct()
    start = F.floor(F.col("tid") / 50) * 1000 + F.col("line_no") * 100
    return rows.select("tid", F.concat(F.lit("chr"), F.col("tid") % 25).alias("contig"), F.when(F.col("tid") % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start"), (start + 60).alias("end"), "line_no")


def _ends(exons: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("tid")
    return exons.withColumns({"is_first": F.col("start") == F.min("start").over(w), "is_last": F.col("start") == F.max("start").over(w)})


def _cut_a() -> F.Column:
    """A row of references a from a row of exons with ends."""
    tid = F.col("tid")
    flipped = F.when(F.col("strand") == "+", "-").otherwise("+")
    cut = 12 - F.when(tid % 13 == 0, 1).otherwise(0) - F.when(tid % 17 == 0, 99).otherwise(0)
    start = F.col("start") + F.when(F.col("is_first"), 12).otherwise(0)
    end = (F.col("end") - F.when(F.col("is_last"), cut).otherwise(0)).cast("long")
    return F.struct((tid + 1_000_000).alias("rid"), "contig", F.when(tid % 11 == 0, flipped).otherwise(F.col("strand")).alias("strand"), start.alias("start"), end.alias("end"))


def _ref_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends(tx_exon(spark, sf_dir).filter(F.col("tid") % 5 < 2)).select(_cut_a().alias("a"), "is_first", "is_last").select("a.*", "is_first", "is_last")


def ref_cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References a and b, from one pass over the exons of both."""
    tid = F.col("tid")
    b = F.struct((tid + 2_000_000).alias("rid"), "contig", "strand", (F.col("start") + 15).alias("start"), (F.col("end") - 15).alias("end"))
    both = F.array(F.when(tid % 5 < 2, _cut_a()), F.when((tid % 4 == 0) & F.col("is_first"), b))
    return _ends(tx_exon(spark, sf_dir).filter((tid % 5 < 2) | (tid % 4 == 0))).select(F.inline(both)).filter("rid is not null")


def stop_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    forward = F.col("strand") == "+"
    at = _ref_a(spark, sf_dir).filter((forward & F.col("is_last")) | (~forward & F.col("is_first")))
    start = F.when(forward, F.col("end")).otherwise(F.col("start") - 3)
    return at.select("rid", start.alias("start"), (start + 3).alias("end"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("tx_id"), F.coalesce("text", F.lit("")).alias("seq"))


def bases(text: F.Column) -> F.Column:
    """As many characters as ``text`` has."""
    return F.translate(text, FROM, TO)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as bases; a null text is empty."""
    return texts(spark, sf_dir).withColumn("seq", bases(F.col("seq")))


def seq_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, d = F.length("seq").cast("long"), F.col("tx_id").cast("long")
    start = F.when(n >= 30, d % 7)
    return texts(spark, sf_dir).select("tx_id", n.alias("length"), start.alias("orf_start"), (start + 3 * F.floor((n - 10) / 3)).alias("orf_end"))


def label_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    kind = F.col("event_type")
    label = F.when(kind == "signup", 1).when(kind == "click", 2).when(kind == "view", F.when(F.col("event_id") % 2 == 0, 3).otherwise(4)).when(kind == "purchase", 5).otherwise(0)
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("seq_id"), pos.cast("long").alias("pos"), label.cast("int").alias("label"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six values a position over the whole vector; the last position is filled with zeros."""
    pos = F.explode(F.sequence(F.lit(0), F.lit(POSITIONS - 1)))
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 6 * POSITIONS - 64))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("seq_id"), "label", filled.alias("embedding"), pos.alias("pos"))
    return rows.select("seq_id", "pos", F.slice("embedding", F.col("pos") * 6 + 1, F.lit(6)).cast("array<double>").alias("logits"), ((F.col("seq_id") + F.col("pos")) % 6).cast("int").alias("true_class"), ((F.col("pos") >= 8) & (F.col("label") % 2 == 0)).alias("pad"))


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "RefSeq").when(F.col("s_suppkey") % 3 == 1, "BRAKER").otherwise("Other")
    split = F.when(F.col("n_regionkey") < 3, "training").when(F.col("n_regionkey") == 3, "test").otherwise("val")
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.concat(F.lit("GCF_"), F.col("s_suppkey")).alias("accession"), kind.alias("annotation"), split.alias("split"), F.col("s_suppkey").cast("long").alias("number"))
    again = rows.filter("split = 'training' and number % 4 = 0").withColumn("split", F.lit("val"))
    return rows.unionByName(again)


def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    return rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    epoch = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("run"), epoch.cast("long").alias("epoch"), F.col("value").cast("double").alias("val_loss"))


def genome_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that make up each contig, joined in the order of d."""
    d = F.col("tx_id").cast("long")
    return texts(spark, sf_dir).select(F.concat(F.lit("chr"), d % 25).alias("contig"), d.alias("d"), "seq")


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences that make up each contig, joined in the order of d."""
    return genome_texts(spark, sf_dir).withColumn("seq", bases(F.col("seq")))


def contig_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome_texts(spark, sf_dir).groupBy("contig").agg(F.sum(F.length("seq").cast("long")).alias("n"))


def genome_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All exons. A transcript moves as a whole, so that it lies in its contig and its exons keep their order and distances; only a contig shorter than the transcript cuts it."""
    from pyspark.sql import Window

    w = Window.partitionBy("tid")
    rows = tx_exon(spark, sf_dir).withColumns({"first": F.min("start").over(w), "last": F.max("end").over(w)})
    rows = rows.join(F.broadcast(contig_lengths(spark, sf_dir)), "contig")
    move = F.col("first") % F.greatest(F.col("n") - F.col("last") + F.col("first") + 1, F.lit(1)) - F.col("first")
    return rows.select("tid", "contig", "strand", (F.col("start") + move).alias("start"), F.least(F.col("end") + move, F.col("n")).alias("end"), "line_no").filter("start < end")


def annotation_lines(rows: DataFrame, feature: str, key: str, attrs: F.Column) -> DataFrame:
    """``rows`` (key, contig, strand, start, end) as lines of an annotation file (value, line_no)."""
    fields = [F.col("contig"), F.lit("fixture"), F.lit(feature), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.col("strand"), F.lit("."), attrs]
    return rows.select(F.concat_ws("\t", *fields).alias("value"), F.struct(F.col(key), F.col("start")).alias("line_no"))


def gene_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Reference exons, and sets a (two thirds) and b (a with outer ends moved)."""
    cols = [F.col("contig").alias("species"), "tid", "contig", "strand", "start", "end"]
    ref = tx_exon(spark, sf_dir)
    a = ref.filter("tid % 3 != 0")
    moved = _ends(a).withColumns({"start": F.col("start") - F.when(F.col("is_first"), F.col("tid") % 6).otherwise(0), "end": F.col("end") + F.when(F.col("is_last"), F.col("tid") % 6).otherwise(0)})
    return ref.select(*cols), {"a": a.select(*cols), "b": moved.select(*cols)}


GENE_SETS = ["a", "b"]


def gene_set_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one table, from one pass over the exons; the reference's gene_set is null."""
    tid, start, end = F.col("tid"), F.col("start"), F.col("end")
    one = lambda name, start, end: F.struct(F.lit(name).cast("string").alias("gene_set"), start.alias("start"), end.alias("end"))
    moved = start - F.when(F.col("is_first"), tid % 6).otherwise(0), end + F.when(F.col("is_last"), tid % 6).otherwise(0)
    sets = F.array(one(None, start, end), F.when(tid % 3 != 0, one("a", start, end)), F.when(tid % 3 != 0, one("b", *moved)))
    return _ends(tx_exon(spark, sf_dir)).select(F.col("contig").alias("species"), "tid", "contig", "strand", F.inline(sets)).filter("start is not null")


SQL = {
    "tx_exon": """SELECT tid, 'chr' || (tid % 25) AS contig, CASE WHEN tid % 2 = 0 THEN '+' ELSE '-' END AS strand,
  (tid // 50) * 1000 + line_no * 100 AS start, (tid // 50) * 1000 + line_no * 100 + 60 AS "end", line_no
  FROM (SELECT DISTINCT l_orderkey::BIGINT AS tid, l_linenumber::BIGINT AS line_no FROM lineitem)""",
    "exon_ends": """SELECT *, start = min(start) OVER (PARTITION BY tid) AS is_first, start = max(start) OVER (PARTITION BY tid) AS is_last FROM tx_exon""",
    "ref_a": """SELECT tid + 1000000 AS rid, contig, CASE WHEN tid % 11 = 0 THEN CASE WHEN strand = '+' THEN '-' ELSE '+' END ELSE strand END AS strand,
  start + CASE WHEN is_first THEN 12 ELSE 0 END AS start,
  "end" - CASE WHEN is_last THEN 12 - (CASE WHEN tid % 13 = 0 THEN 1 ELSE 0 END) - (CASE WHEN tid % 17 = 0 THEN 99 ELSE 0 END) ELSE 0 END AS "end", is_first, is_last
  FROM exon_ends WHERE tid % 5 < 2""",
    "ref_cds": """SELECT rid, contig, strand, start, "end" FROM ref_a
  UNION ALL SELECT tid + 2000000, contig, strand, start + 15, "end" - 15 FROM exon_ends WHERE tid % 4 = 0 AND is_first""",
    "stop_parts": """SELECT rid, CASE WHEN strand = '+' THEN "end" ELSE start - 3 END AS start, CASE WHEN strand = '+' THEN "end" + 3 ELSE start END AS "end"
  FROM ref_a WHERE (strand = '+' AND is_last) OR (strand <> '+' AND is_first)""",
    "sequences": f"""SELECT doc_id::VARCHAR AS tx_id, translate(coalesce(text, ''), '{FROM}', '{TO}') AS seq FROM documents""",
    "seq_labels": """SELECT tx_id, n AS length, s AS orf_start, s + 3 * ((n - 10) // 3) AS orf_end FROM (
  SELECT tx_id, length(seq)::BIGINT AS n, CASE WHEN length(seq) >= 30 THEN tx_id::BIGINT % 7 END AS s FROM sequences)""",
    "label_seq": """SELECT user_id::BIGINT AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 3 ELSE 4 END WHEN 'purchase' THEN 5 ELSE 0 END::INTEGER AS label FROM events""",
    "logits": """SELECT vec_id::BIGINT AS seq_id, pos::INTEGER AS pos, embedding[pos * 6 + 1 : pos * 6 + 6]::DOUBLE[] AS logits,
  ((vec_id + pos) % 6)::INTEGER AS true_class, pos >= 8 AND label % 2 = 0 AS pad FROM (SELECT vec_id, label, list_concat(embedding, [0.0::FLOAT, 0.0::FLOAT]) AS embedding FROM embeddings), range(11) t(pos)""",
    "log_probs": """SELECT *, list_transform(logits, lambda v: v - list_max(logits) - ln(list_sum(list_transform(logits, lambda u: exp(u - list_max(logits)))))) AS lp FROM logits""",
    "classed": """SELECT *, (list_position(logits, list_max(logits)) - 1)::INTEGER AS predicted FROM logits""",
    "base_species": """SELECT s_name AS name, 'GCF_' || s_suppkey AS accession, CASE s_suppkey % 3 WHEN 0 THEN 'RefSeq' WHEN 1 THEN 'BRAKER' ELSE 'Other' END AS annotation,
  CASE WHEN n_regionkey < 3 THEN 'training' WHEN n_regionkey = 3 THEN 'test' ELSE 'val' END AS split, s_suppkey::BIGINT AS number FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "species": """SELECT * FROM base_species UNION ALL SELECT name, accession, annotation, 'val', number FROM base_species WHERE split = 'training' AND number % 4 = 0""",
    "section_lines": """SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)""",
    "run_log": """SELECT user_id::BIGINT AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, value::DOUBLE AS val_loss FROM events""",
    "genome": """SELECT 'chr' || (tx_id::BIGINT % 25) AS contig, string_agg(seq, '' ORDER BY tx_id::BIGINT) AS seq FROM sequences GROUP BY 1""",
    "genome_exons": """SELECT tid, contig, strand, start + move AS start, least("end" + move, n) AS "end", line_no FROM (
  SELECT e.*, n, lo % greatest(n - hi + lo + 1, 1) - lo AS move FROM (SELECT *, min(start) OVER (PARTITION BY tid) AS lo, max("end") OVER (PARTITION BY tid) AS hi FROM tx_exon) e
  JOIN (SELECT contig, length(seq)::BIGINT AS n FROM genome) g ON e.contig = g.contig) WHERE start + move < least("end" + move, n)""",
    "reference_exons": """SELECT contig AS species, tid, contig, strand, start, "end" FROM tx_exon""",
    "predicted_exons": """SELECT 'a' AS gene_set, contig AS species, tid, contig, strand, start, "end" FROM tx_exon WHERE tid % 3 <> 0
  UNION ALL SELECT 'b', contig, tid, contig, strand, start - CASE WHEN is_first THEN tid % 6 ELSE 0 END, "end" + CASE WHEN is_last THEN tid % 6 ELSE 0 END FROM exon_ends WHERE tid % 3 <> 0""",
    "tx": """SELECT tid, arg_max(contig, line_no) AS contig, arg_max(strand, line_no) AS strand, sum("end" - start)::BIGINT AS length, min(start) AS span_start,
  arg_max("end", start) AS span_end, count(*) AS n_exons FROM tx_exon GROUP BY tid""",
    "offsets": """SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY tid ORDER BY CASE WHEN strand = '+' THEN start ELSE -start END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tx_offset FROM tx_exon""",
    "refs": """SELECT rid, any_value(contig) AS contig, any_value(strand) AS strand, sum("end" - start)::BIGINT AS cds_len, min(start) AS ref_start, max("end") AS ref_end,
  sum("end" - start) >= 6 AND sum("end" - start) % 3 = 0 AS complete FROM ref_cds GROUP BY rid""",
    "pairs": """SELECT t.tid, r.rid, t.strand, r.strand AS ref_strand, t.length, r.cds_len, r.complete FROM tx t JOIN refs r ON t.contig = r.contig AND t.span_start < r.ref_end AND r.ref_start < t.span_end""",
    "pieces": """SELECT p.tid, p.rid, CASE WHEN o.strand = '+' THEN o.tx_offset + greatest(o.start, c.start) - o.start ELSE o.tx_offset + o."end" - least(o."end", c."end") END AS a,
  least(o."end", c."end") - greatest(o.start, c.start) AS n FROM pairs p JOIN offsets o ON p.tid = o.tid JOIN ref_cds c ON p.rid = c.rid AND o.start < c."end" AND c.start < o."end" """,
    "projected": """SELECT p.*, q.orf_start, q.orf_end, coalesce(q.bases = p.cds_len AND q.orf_end - q.orf_start = p.cds_len, false) AS contained
  FROM pairs p LEFT JOIN (SELECT tid, rid, sum(n)::BIGINT AS bases, min(a) AS orf_start, max(a + n) AS orf_end FROM pieces GROUP BY tid, rid) q ON p.tid = q.tid AND p.rid = q.rid""",
    "fits": """SELECT *, row_number() OVER (PARTITION BY tid ORDER BY cds_len DESC, rid) AS k, count(*) OVER (PARTITION BY tid) AS n_fit FROM projected WHERE strand = ref_strand AND complete AND contained""",
    "labelled": """SELECT t.tid, CASE WHEN h.n_same IS NULL THEN 'ir_only' WHEN h.n_same = 0 THEN 'dropped_antisense_only' WHEN f.n_fit = 1 THEN 'kept_single' WHEN f.n_fit > 1 THEN 'kept_multi'
    WHEN h.n_partial > 0 THEN 'dropped_ref_partial' ELSE 'dropped_not_contained' END AS category, f.rid AS chosen_ref, t.length, f.orf_start, f.orf_end
  FROM tx t LEFT JOIN (SELECT tid, count(*) FILTER (strand = ref_strand) AS n_same, count(*) FILTER (strand = ref_strand AND NOT complete) AS n_partial FROM projected GROUP BY tid) h ON t.tid = h.tid
  LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON t.tid = f.tid""",
    "orfs": """SELECT seq_id, before_pos AS orf_start, pos + 1 AS orf_end FROM (SELECT *, lag(label) OVER w AS before, lag(pos) OVER w AS before_pos FROM label_seq WHERE label NOT IN (2, 3, 4)
  WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE label = 5 AND before = 1""",
    "segments": """SELECT o.tid, contig, strand, orf_start, orf_end, CASE WHEN strand = '+' THEN start + lo - tx_offset ELSE "end" - (hi - tx_offset) END AS start,
  CASE WHEN strand = '+' THEN start + hi - tx_offset ELSE "end" - (lo - tx_offset) END AS "end", ((lo - orf_start) % 3)::INTEGER AS frame FROM (
  SELECT o.*, l.orf_start, l.orf_end, greatest(l.orf_start, o.tx_offset) AS lo, least(l.orf_end, o.tx_offset + o."end" - o.start) AS hi
  FROM offsets o JOIN labelled l ON o.tid = l.tid WHERE l.orf_start IS NOT NULL) o WHERE lo < hi""",
    "counts": """SELECT predictor, class_id, class_name, count(*) FILTER (t = class_id AND q = class_id) AS tp, count(*) FILTER (t <> class_id AND q = class_id) AS fp, count(*) FILTER (t = class_id AND q <> class_id) AS fn FROM (
  SELECT 'model' AS predictor, true_class AS t, predicted AS q FROM classed WHERE NOT pad UNION ALL SELECT 'all_ir', true_class, 0 FROM classed WHERE NOT pad) r,
  (VALUES (0, 'IR'), (1, 'START'), (2, 'E1'), (3, 'E2'), (4, 'E0'), (5, 'STOP')) c(class_id, class_name) GROUP BY ALL""",
    "loci": """SELECT tid, contig, strand, span_start, span_end, sum(new) OVER (PARTITION BY contig, strand ORDER BY span_start, span_end, tid ROWS UNBOUNDED PRECEDING)::BIGINT AS locus FROM (
  SELECT *, CASE WHEN span_start >= max(span_end) OVER (PARTITION BY contig, strand ORDER BY span_start, span_end, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM tx)""",
    "all_exons": """SELECT 'p' AS side, * FROM predicted_exons UNION ALL SELECT 'r', s.gene_set, r.* FROM reference_exons r, (VALUES ('a'), ('b')) s(gene_set)""",
    "shapes": """SELECT DISTINCT side, gene_set, species, contig, strand, start, "end", start = min(start) OVER w AS lf, "end" = max("end") OVER w AS rf FROM all_exons WINDOW w AS (PARTITION BY side, gene_set, species, tid)""",
    "exon_hits": """SELECT side, gene_set, species, EXISTS (SELECT 1 FROM shapes o WHERE o.side <> s.side AND o.gene_set = s.gene_set AND o.species = s.species AND o.contig = s.contig AND o.strand = s.strand AND o.lf = s.lf AND o.rf = s.rf
  AND abs(o.start - s.start) <= CASE WHEN s.lf THEN 3 ELSE 0 END AND abs(o."end" - s."end") <= CASE WHEN s.rf THEN 3 ELSE 0 END) AS hit FROM shapes s""",
    "chains": """SELECT side, gene_set, species, tid, any_value(contig) AS contig, any_value(strand) AS strand, min(start) AS span_start, max("end") AS span_end,
  list_sort(list(start))[2:] AS starts, list_sort(list("end"))[:-2] AS ends FROM all_exons GROUP BY side, gene_set, species, tid""",
    "chain_hits": """SELECT *, EXISTS (SELECT 1 FROM chains o WHERE o.side <> s.side AND o.gene_set = s.gene_set AND o.species = s.species AND o.contig = s.contig AND o.strand = s.strand AND o.starts = s.starts AND o.ends = s.ends
  AND abs(o.span_start - s.span_start) <= 3 AND abs(o.span_end - s.span_end) <= 3) AS hit FROM chains s""",
    "locus_hits": """SELECT side, gene_set, species, contig, strand, locus, bool_or(hit) AS hit FROM (
  SELECT *, sum(new) OVER (PARTITION BY side, gene_set, species, contig, strand ORDER BY span_start, span_end, tid ROWS UNBOUNDED PRECEDING) AS locus FROM (
  SELECT *, CASE WHEN span_start >= max(span_end) OVER (PARTITION BY side, gene_set, species, contig, strand ORDER BY span_start, span_end, tid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS new FROM chain_hits))
  GROUP BY ALL""",
    "level_rates": """SELECT level, gene_set, species, round(100.0 * avg(hit::INTEGER) FILTER (side = 'r'), 2) AS sn, round(100.0 * avg(hit::INTEGER) FILTER (side = 'p'), 2) AS pr FROM (
  SELECT 'exon' AS level, side, gene_set, species, hit FROM exon_hits UNION ALL SELECT 'transcript', side, gene_set, species, hit FROM chain_hits UNION ALL SELECT 'gene', side, gene_set, species, hit FROM locus_hits) GROUP BY ALL""",
    "levels": """SELECT *, CASE WHEN sn + pr = 0 THEN 'nan'::DOUBLE ELSE 2 * sn * pr / (sn + pr) END AS f1 FROM level_rates""",
}


def with_fixtures(body: str, recursive: bool = False) -> str:
    """``body`` below the fixture definitions that it uses, directly or through others."""
    import re

    def uses(text: str) -> set[str]:
        return {n for n in SQL if re.search(rf"\b{n}\b", text)}

    need, todo = set(), uses(body)
    while todo:
        need |= todo
        todo = {m for n in todo for m in uses(SQL[n])} - need
    head = ",\n".join(f"{n} AS ({q})" for n, q in SQL.items() if n in need)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{',' if body.startswith('+') else ''}\n{body.lstrip('+')}"
