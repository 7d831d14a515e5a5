"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolake.llm import (
    crosspolytope, dialogue, kdtree, licenses, minhash, mixing, packing, ranked, rules, substring, suffixarray, surrogates,
    toxicity)
from cartolake.llm.common import read


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_vectors(read(spark, sf_dir, "embeddings"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer())


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(read(spark, sf_dir, "documents"))


def op6_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_documents(read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/lang/doc_id; one that opens with a notice serves as its directory's licence file."""
    docs = read(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    opens = F.split("text", licenses.LINE, 2)[0].rlike(licenses.HINT)
    return licenses.scan(docs, is_license_file=opens)


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.remove_repeated_bytes(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.best_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = rules.fit(docs, labels.filter(~held_out(5, 0)))
    return rules.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return dialogue.repair_report(dialogue.damage(conversations), conversations)


QUERIES = {f.__name__: f for f in (
    op1_topk, op2_near_vectors, op3_mix, op4_pack, op5_surrogates, op6_repeated_words, op7_toxicity,
    op8_near_documents, op9_licenses, op10_repeated_bytes, op11_ranked, op12_quality, op13_conversations)}

# Brute force in SQL where a table's whole pairs or windows can be listed.
ORACLE = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
""",
    "op2_near_vectors": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id))::BIGINT AS component_id,
  vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.u = vec_id LEFT JOIN counts ON counts.u = vec_id
""",
    "op8_near_documents": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM pairs JOIN n x ON u = x.doc_id JOIN n y ON v = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::BIGINT AS component_id,
  d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON u = d.doc_id
""",
    "op6_repeated_words": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
hits AS (SELECT doc_id, s FROM windows JOIN (SELECT t FROM windows GROUP BY t HAVING count(*) > 1) USING (t)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM hits),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op10_repeated_bytes": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- Windows are cut from short pieces: the place of a character is found by counting.
pieces AS MATERIALIZED (
  SELECT r, 64 * c AS base, substring(h, 128 * c + 1, 926) AS p
  FROM (SELECT r, h, unnest(range(0, (strlen(h) // 2 - 400) // 64 + 1)) AS c FROM d WHERE strlen(h) >= 800)),
w AS (
  SELECT r, base + i AS s, md5_number(substring(p, 2 * i + 1, 800)) AS t
  FROM (SELECT r, base, p, unnest(range(0, strlen(p) // 2 - 399)) AS i FROM pieces WHERE strlen(p) >= 800)),
hits AS (SELECT r, s FROM w JOIN (SELECT t FROM w GROUP BY t HAVING count(*) > 1) USING (t)),
spans AS (
  SELECT r, min(s) AS a, max(s) + 400 AS b FROM (
    SELECT r, s, sum(CASE WHEN s - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS run
    FROM (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM hits)) GROUP BY r, run),
gaps AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS kept_from FROM spans),
cut AS (
  SELECT r, count(*) AS n, sum(b - a) AS gone, max(b) AS last,
    string_agg(substring(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) AS head
  FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, (strlen(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substring(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
""",
    "op11_ranked": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
docs AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
stat AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, stat GROUP BY term),
items AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM items JOIN weight USING (term) JOIN tf USING (term) JOIN docs USING (r), stat
  WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
""",
}
