"""Queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import annsearch, decontam, hmmlm, langid, licenses, linededup, ngramjoin, nra, prefixtrie, quality, spm, toxicity, whitening
from tidewake.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    net = langid.fit(docs, F.col("doc_id").isNotNull() & ~held_out)
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier one equals or nearly equals."""
    return linededup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return spm.digests(spm.encode(table(spark, sf_dir, "documents"), _tokenizer()))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are alike to 0.8, and how many others each links with."""
    return ngramjoin.join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with the place of each overlap."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every document under a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    scored = hmmlm.score(docs, F.col("doc_id").isNotNull() & ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", nra.scaled("embedding").alias("vector"))
    return nra.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, with its source as host and its language as path."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    scored = quality.score(docs, table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "doc_score", "host_rate", "path_rate", "score", "keep")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered template spans of every document."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~held_out)
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations, rebuilt on shared first turns."""
    return prefixtrie.trie(*prefixtrie.shared_heads(table(spark, sf_dir, "conversations")))


def op12_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every twentieth, by projections."""
    vectors = table(spark, sf_dir, "embeddings")
    return annsearch.nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    """Query name to a function of (spark, sf_dir)."""
    return {
        "op1_language_id": op1_language_id,
        "op2_line_dedup": op2_line_dedup,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_ngram_join": op4_ngram_join,
        "op5_decontaminate": op5_decontaminate,
        "op6_lm_score": op6_lm_score,
        "op7_exact_topk": op7_exact_topk,
        "op8_quality": op8_quality,
        "op9_license_scan": op9_license_scan,
        "op10_toxicity": op10_toxicity,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_ann_search": op12_ann_search,
        "op13_embedding_whitening": op13_embedding_whitening,
    }


_OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
b AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM n UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.d WHERE r.c < b.y),
k AS (SELECT x, count(*) AS k FROM b GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id, coalesce(any_value(k.k), 0) AS n_links FROM n JOIN r ON r.d = n.doc_id LEFT JOIN k ON k.x = n.doc_id GROUP BY 1, 2
"""

_OP7_SQL = """
WITH v AS (
  SELECT vec_id, [floor(x::DOUBLE * 64)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 20
"""

_OP2_SQL = """
WITH rows AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS ln FROM rows WHERE text IS NOT NULL),
every AS (SELECT doc_id, ln, lower(trim(line)) AS l, line FROM raw),
firsts AS (SELECT l, min((doc_id, ln)) AS first, length(l) AS n FROM every WHERE l <> '' GROUP BY l),
long_ AS (SELECT * FROM firsts WHERE n >= 24),
halves AS (
  SELECT l, first, n, h, 0 AS side, left(l, h) AS part FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM long_)
  UNION ALL
  SELECT l, first, n, h, 1 AS side, right(l, h) AS part FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM long_)),
pairs AS (
  SELECT DISTINCT a.l AS l, b.l AS o FROM halves a JOIN halves b USING (h, side, part)
  WHERE b.first < a.first AND abs(a.n - b.n) <= 1),
near AS (
  SELECT DISTINCT l FROM pairs WHERE CASE
    WHEN length(l) = length(o) THEN len([i FOR i IN range(1, length(l) + 1) IF substring(l, i, 1) <> substring(o, i, 1)]) <= 1
    WHEN length(l) < length(o) THEN list_contains([left(o, i - 1) || substring(o, i + 1) FOR i IN range(1, length(o) + 1)], l)
    ELSE list_contains([left(l, i - 1) || substring(l, i + 1) FOR i IN range(1, length(l) + 1)], o) END),
judged AS (
  SELECT e.doc_id, e.ln, e.line, e.l <> '' AND (near.l IS NOT NULL OR f.first < (e.doc_id, e.ln)) AS gone
  FROM every e LEFT JOIN firsts f ON e.l = f.l LEFT JOIN near ON e.l = near.l)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.kept, '') END AS text,
       CAST(coalesce(len(d.ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(j.n, 0) AS INTEGER) AS n_dropped
FROM rows d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT coalesce(gone, false)) AS kept, count(*) FILTER (WHERE gone) AS n
  FROM judged GROUP BY doc_id) j USING (doc_id)
"""

_OP11_SQL = r"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS crc FROM bits WHERE k = 8),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT conv_id, l, xor(list_reduce(list_concat([4294967295::BIGINT], [ord(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM own, crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.l, [])[1:c.h], c.l[c.h + 1:]) AS r
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
paths AS (
  SELECT conv_id, d, len(r) AS length, md5(to_json(r[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(to_json(r[1:d - 1])::VARCHAR) END AS p,
    CASE WHEN d > 0 THEN len(regexp_extract_all(r[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM (SELECT conv_id, r, unnest(range(0, len(r) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, k, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words FROM paths GROUP BY d, k),
kids AS (SELECT d - 1 AS d, p AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (d, k)),
under AS (
  SELECT a.d, a.k, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n - 1) * v.words) AS saved_tokens
  FROM whole v JOIN paths a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY 1, 2),
ends AS (SELECT d, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM paths WHERE d = length GROUP BY 1, 2)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM whole w JOIN under USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN nodes u ON u.d = w.d - 1 AND u.k = w.p
"""


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL with the same rows."""
    return {"op2_line_dedup": _OP2_SQL, "op4_ngram_join": _OP4_SQL, "op7_exact_topk": _OP7_SQL, "op11_prefix_trie": _OP11_SQL}
