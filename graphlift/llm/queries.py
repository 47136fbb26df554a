"""The registered queries of this package and their SQL, on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, encoding, jaccard, language, licenses, packing, secrets, tokens, topk, toxicity, trie, urls
from .common import crc_of, stored, table

VOCABULARY = "byte_bpe_50k.json"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = language.train(docs.select("doc_id", "text", "lang").where(~held_out))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=1024)


def op5_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), size=1024))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> toxicity.Model:
    """Learned from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").where(crc_of(F.col("doc_id")) % 5 != 0))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_of(F.col("doc_id")) % 5 == 0, F.lit(False))
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digest(centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed="2"))


def _op11_sql(rounds: int) -> str:
    """Each round assigns the vectors (a<r>) and moves the centroids (c<r + 1>)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.rid, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c) GROUP BY rid
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (
  SELECT old.c, coalesce(new.v, old.v) AS v FROM c{r} old LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM (
      SELECT a.c, e.j, sum(e.x) AS s, count(*) AS n FROM a{r} a JOIN e USING (rid) GROUP BY a.c, e.j) GROUP BY c
  ) new ON new.c = old.c
)""")
    return f"""
WITH k AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(x, lambda y: floor(256 * y)::BIGINT) AS v FROM k),
e AS (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM v),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < 40),
{", ".join(steps)}
SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.c = a.c
"""


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(trie.ordered_turns(table(spark, sf_dir, "conversations")), "ordered")
    return trie.prefix_trie(trie.rebuilt(turns, group=5, heads=9))


#: crc32 of a text's bytes: each byte is put in, then eight single steps.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({x}) + 1), lambda i:
  [ascii(substr({x}, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

OP12_SQL = f"""
WITH ids AS (SELECT c, {_CRC32.format(x="c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL)),
t AS (
  SELECT conv_id AS c, md5(md5(coalesce(text, '')) || coalesce(role, '')) AS x, strlen(coalesce(text, '')) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT ids.c, 0 AS part, pos, x, bytes FROM ids JOIN t ON t.c = ids.c - ids.c % 5 AND t.pos < ids.h
  UNION ALL SELECT ids.c, 1, pos, x, bytes FROM ids JOIN t ON t.c = ids.c AND t.pos >= ids.h
), m AS (
  SELECT c, row_number() OVER w AS d, md5(string_agg(x, '') OVER (w ROWS UNBOUNDED PRECEDING)) AS p, bytes FROM r WINDOW w AS (PARTITION BY c ORDER BY part, pos)
  UNION ALL SELECT c, 0, '', 0 FROM ids
), l AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS up, lead(p) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM m),
n AS (
  SELECT p, d, min(c) AS c, min(up) AS up, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM l GROUP BY p, d
), k AS (SELECT up AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)),
s AS (
  SELECT m.p, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.bytes) AS saved
  FROM o JOIN m ON m.c = o.c AND m.d <= o.d GROUP BY m.p
)
SELECT o.c AS conv_id, o.d AS depth, par.c AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM o JOIN s USING (p) LEFT JOIN o par ON par.p = o.up
"""


def op13_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encoding_digest(encoding.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_license_scans, op3_language_id, op4_token_counts, op5_exact_topk_search, op6_ngram_jaccard_join, op7_benchmark_decontamination, op8_packing, op9_toxicity, op10_secret_scans, op11_centroid_clustering, op12_conversation_prefix_trie, op13_bpe_encoding_and_decoding)}
ORACLES: dict[str, str] = {"op5_exact_topk_search": OP5_SQL, "op11_centroid_clustering": _op11_sql(5), "op12_conversation_prefix_trie": OP12_SQL}
