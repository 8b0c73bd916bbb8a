"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_dedup as exact
from cairn.llm import bpe, embedding_dedup, html_text, lexical, merkle, mixing, near_dedup, quality, sharding, token_counts, toxicity, vector_search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    held_out = toxicity.held_out(F.col("id"))
    model = toxicity.train(docs.withColumnsRenamed({"doc_id": "id"}), labels.filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, labels: DataFrame) -> tuple:
    """Fitted on the rated rows that op1 may learn from, too."""
    rated = labels.filter(~toxicity.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.train(docs.select(F.col("doc_id").alias("id"), "text"), rated)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_good"), F.col("tails")[1].alias("p_clean"), "kept")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), 40)


def tokenizer() -> tuple[str, str]:
    """Vocabulary file and pattern, as every executor has them installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), *tokenizer()))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), digests=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after its personal data is replaced."""
    docs = token_counts.find_redactions(table(spark, sf_dir, "documents"))
    return token_counts.count_edited(docs, *tokenizer()).select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "chars_encoded_again")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row proven against the manifest's root, a fifth of them tampered with."""
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return vector_search.search(vector_search.build_index(vectors, 20), vectors.filter("vec_id % 20 = 0"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_bpe": op5_bpe,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_html_text": op8_html_text,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_mixing": op10_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_vector_search": op13_vector_search,
}

ORACLES = {
    "op9_embedding_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id""",
    "op6_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE d AS (
  SELECT *, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, coalesce('=' || source, '') AS t FROM documents),
leaves AS (
  SELECT doc_id, t, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS low,
    list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
      lambda h, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, xor(h, b)), 4294967295::BIGINT) AS crc FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY t) AS n FROM leaves),
nodes(t, k, rank, digest, n) AS (
  SELECT t, 0, rank, leaf, n FROM ranked
  UNION ALL SELECT t, k + 1, rank // 16, sha256(string_agg(digest, '' ORDER BY rank)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY t, k, rank // 16, n),
subroots AS (SELECT t, digest, row_number() OVER (ORDER BY t) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(k, rank, digest, n) AS (
  SELECT 0, place, digest, n FROM subroots
  UNION ALL SELECT k + 1, rank // 16, sha256(string_agg(digest, '' ORDER BY rank)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY k, rank // 16, n),
every AS (SELECT 0 AS phase, t, k, rank, digest, n FROM nodes UNION ALL SELECT 1, NULL, k, rank, digest, n FROM tops),
beside AS (
  SELECT phase, t, k, rank, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM every WHERE n > 1 WINDOW w AS (PARTITION BY phase, t, k, rank // 16 ORDER BY rank)),
paths AS (
  SELECT a.t, a.rank, list({'l': b.l, 'h': '', 'r': b.r} ORDER BY b.phase, b.k) AS p FROM ranked a JOIN subroots s ON s.t = a.t
  JOIN beside b ON (b.phase = 0 AND b.t = a.t AND b.rank = a.rank // (16 ** b.k)::BIGINT) OR (b.phase = 1 AND b.rank = s.place // (16 ** b.k)::BIGINT) GROUP BY a.t, a.rank),
proven AS (
  SELECT a.*, s.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root, coalesce(p, []) AS p, CASE WHEN xor(crc, 4294967295::BIGINT) % 5 = 0 THEN low ELSE leaf END AS again
  FROM ranked a JOIN subroots s USING (t) LEFT JOIN paths USING (t, rank))
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(p, lambda x: x.l || x.r)), 'string_agg', '')) AS proof_sha256,
  list_reduce(p, lambda a, x: {'l': '', 'h': sha256(x.l || a.h || x.r), 'r': ''}, {'l': '', 'h': again, 'r': ''}).h AS folded_root, folded_root = root AS verified FROM proven""",
    "op12_lexical_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
corpus AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY ALL), corpus),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50""",
    "op13_vector_search": """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
near AS (
  SELECT q.vec_id AS query_id, o.vec_id, list_reduce(list_transform(list_zip(q.e, o.e), lambda z: z[1] * z[2]), lambda s, x: s + x, 0.0::DOUBLE) AS score
  FROM good q JOIN good o ON q.vec_id % 20 = 0 AND q.vec_id <> o.vec_id AND len(q.e) = len(o.e))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near) WHERE rank <= 20""",
    "op4_sharding": r"""
WITH steps AS (
  SELECT list(list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, n::BIGINT) ORDER BY n) AS step FROM range(256) r(n)),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, strlen(coalesce(text, '')) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, key, size, xor(list_reduce(bytes, lambda h, b: xor(h >> 8, step[(xor(h, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM d, steps),
s AS (
  SELECT *, ('0x' || md5(key)[1:15])::BIGINT AS h, list_transform(range(41), lambda i: -1.0::DOUBLE / ln(least((('0x' || md5(key || '#' || i)[1:15])::BIGINT + 0.5::DOUBLE) / 1152921504606846976::DOUBLE, (1 - power(2, -53))::DOUBLE))) AS scores FROM c),
p AS (SELECT *, (list_position(scores[1:40], list_max(scores[1:40])) - 1)::INT AS shard, (list_position(scores, list_max(scores)) - 1)::INT AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM p""",
    "op2_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * common >= 75 * (n + m - common)),
each_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reached r JOIN each_way l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) ON a = doc_id""",
}
