"""The registered queries opN_<name> and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codonflow.llm import bpe, divergence, exact_dedup, minhash, mixing, ngram_join, quality, repair, sharding, suffix_dedup, topk, toxicity, warc
from codonflow.llm.common import read


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.histogram_shards(read(spark, sf_dir, "documents"), shards=40)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("epochs")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=90, lower=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=400, passage_words=51)


def op6_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents"), ranks_path, public_tokenizers.PATTERN, decoded=True))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), k=5)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(read(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minmax_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80, lower=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(read(spark, sf_dir, "conversations"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read(spark, sf_dir, "documents"))


def _components_sql(words: int, percent: int, more: str = "") -> str:
    """Links of all pairs of shingle sets, and the smallest id that links reach."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle})) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = doc_id), doc_id)) AS component_id FROM sets)
SELECT doc_id, n_shingles, component_id{more} FROM found
"""


OP3_SQL = _components_sql(3, 90)
OP11_SQL = _components_sql(4, 80, ", doc_id = component_id AS kept")

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + (5 * i // 4)::INTEGER, 2))::INTEGER // (CASE 5 * i % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)) % 32)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""


#: Best value of each grammar state (start, after s, u, a) with up to two inserts before it.
_INSERTED = """[list_sort([w[1], {'c': 5 + w[3].c, 't': 'I' || w[3].t}, {'c': 10 + w[4].c, 't': 'II' || w[4].t}])[1],
    list_sort([w[2], {'c': 5 + w[3].c, 't': 'I' || w[3].t}, {'c': 10 + w[4].c, 't': 'II' || w[4].t}])[1],
    list_sort([w[3], {'c': 5 + w[4].c, 't': 'I' || w[4].t}, {'c': 10 + w[3].c, 't': 'II' || w[3].t}])[1],
    list_sort([w[4], {'c': 5 + w[3].c, 't': 'I' || w[3].t}, {'c': 10 + w[4].c, 't': 'II' || w[4].t}])[1]]"""


def _edited(q: int) -> str:
    """The cheapest edit of one row in state ``q``: v has the values after it, sign the row's symbol."""
    to = (3, 3, 4, 3)[q]
    keeps = {0: {"s": 2, "u": 3}, 1: {"u": 3}, 2: {"a": 4}, 3: {"u": 3}}[q]
    extra = "CASE WHEN sign = upper(sign) THEN 5 ELSE 0 END"
    options = [f"{{'c': 2 + v[{q + 1}].c, 't': 'D' || v[{q + 1}].t}}"]
    options += [f"{{'c': CASE WHEN lower(sign) = '{k}' THEN {extra} ELSE 1000000000 END + v[{n}].c, 't': 'K' || v[{n}].t}}" for k, n in keeps.items()]
    options.append(f"{{'c': CASE WHEN sign = 'X' THEN 1000000000 ELSE 1 + {extra} END + v[{to}].c, 't': 'R' || v[{to}].t}}")
    return f"list_sort([{', '.join(options)}])[1]"


OP12_SQL = rf"""
WITH RECURSIVE bytes AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT) AS b FROM conversations),
steps AS (SELECT list(t ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i::BIGINT) AS t FROM range(256) r(i))),
kinds AS (SELECT b.*, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(1 + (xor(c, x) & 255))::INTEGER]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM bytes b, steps),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
told AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'whole' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
signs AS MATERIALIZED (
  SELECT conv_id, i, role, text, CASE WHEN fault IN ('blank', 'duplicate') THEN 'X' WHEN fault = 'truncated' THEN upper(l) ELSE l END AS sign
  FROM (SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS l FROM told)),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM told GROUP BY conv_id),
togo(conv_id, i, v) AS (
  SELECT conv_id, n, (SELECT {_INSERTED} FROM (SELECT [{{'c': 0::BIGINT, 't': ''}}, {{'c': 1000000000::BIGINT, 't': ''}}, {{'c': 1000000000::BIGINT, 't': ''}}, {{'c': 0::BIGINT, 't': ''}}] AS w)) FROM figures
  UNION ALL
  SELECT conv_id, i, {_INSERTED} FROM (
    SELECT g.conv_id, g.i - 1 AS i, [{", ".join(_edited(q) for q in range(4))}] AS w FROM togo g JOIN signs s ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND s.i = g.i)),
best AS MATERIALIZED (SELECT conv_id, v[1].c AS cost, v[1].t AS audit FROM togo WHERE i = 0),
walk(conv_id, k, i, q, made, audit) AS (
  SELECT conv_id, 1, 1, 'n', []::VARCHAR[], audit FROM best
  UNION ALL
  SELECT conv_id, k + 1, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN q WHEN e = 'K' THEN substr(role, 1, 1) WHEN q = 'u' THEN 'a' ELSE 'u' END,
    CASE WHEN e = 'D' THEN made ELSE list_append(made, CASE WHEN e = 'K' THEN role WHEN q = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END, audit
  FROM (SELECT w.*, substr(w.audit, w.k, 1) AS e, s.role, s.text FROM walk w LEFT JOIN signs s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i WHERE w.k <= length(w.audit))),
done AS (SELECT conv_id, array_to_string(made, chr(10)) AS made FROM walk WHERE k = length(audit) + 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
dense AS (
  SELECT g.lang, g.source, k.term, v, coalesce(n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k ON k.lang = g.lang JOIN size s ON s.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
likely AS MATERIALIZED (
  SELECT lang, source, term, n, (1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v))::HUGEINT AS p,
    (1 + 1000000000 * (sum(n) OVER (PARTITION BY lang, term) + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v))::HUGEINT AS q FROM dense),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM likely a JOIN likely b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM likely WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM rows) WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_histogram_shards, op2_source_mix, op3_ngram_join, op4_toxicity, op5_suffix_dedup, op6_byte_bpe, op7_top_k, op8_exact_dedup, op9_quality, op10_warc, op11_minmax_dedup, op12_conversation_repair, op13_source_divergence)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": OP3_SQL, "op7_top_k": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op10_warc": OP10_SQL, "op11_minmax_dedup": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_source_divergence": OP13_SQL}
