"""Registered queries of this folder, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tallyfield.llm import license_index
from tallyfield.llm.common import fold, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.brown_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.secret_forest import scan

    return scan(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.media_chunks import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"))


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.toxic_segments import fit, score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 3) != 1))
    return score_toxicity(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted",
        F.size("passages").cast("long").alias("n_passages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tallyfield.llm.byte_bpe import encoded_digests

    return encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN)


def op7_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from tallyfield.llm.lp_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.fuzzy_lines import line_groups

    return line_groups(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op10_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.crf_pii import find_pii, fit

    docs = table(spark, sf_dir, "documents")
    return find_pii(docs, fit(docs))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.merkle_manifest import manifest

    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), marked)


def op12_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.license_index import scan

    return scan(table(spark, sf_dir, "documents")).drop("matches").withColumn("score", F.round("score", 6))


def op13_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyfield.llm.cover_tree import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=moved)


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_brown_lm, op3_secret_forest, op4_media_chunks, op5_toxic_segments, op6_byte_bpe, op7_lp_packing, op8_fuzzy_line_dedup,
                                  op9_exact_dedup, op10_crf_pii, op11_merkle_manifest, op12_license_index, op13_cover_tree)}

ORACLE_SQL = {
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.v) AS component_id, s.doc_id = min(r.v) AS kept
FROM sets s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.s""",
    "op13_cover_tree": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
    "op12_license_index": license_index.oracle_sql(),
    "op11_merkle_manifest": r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, lang, n_chars, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded,
         list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
named AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM fields),
hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(folded) || ':' || folded, '-')) AS forged, xor(crc, 4294967295) % 5 = 0 AS tampered FROM named),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM hashed),
low AS (
  SELECT source AS g, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1
  GROUP BY g, level, pos // 16, n),
subroots AS (
  SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 16, n),
nodes AS (
  SELECT 0 AS tree, coalesce('=' || g, '') AS g, level, pos, n, h FROM low WHERE n > 1
  UNION ALL SELECT 1, '', level, pos, n, h FROM high WHERE n > 1),
siblings AS (
  SELECT a.tree, a.g, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.g = b.g AND a.level = b.level AND a.pos // 16 = b.pos // 16
  GROUP BY a.tree, a.g, a.level, a.pos),
steps AS (
  SELECT x.source, x.pos, 0 AS tree, s.level, l, r FROM leaves x
  JOIN siblings s ON s.tree = 0 AND s.g = coalesce('=' || x.source, '') AND s.pos = x.pos // CAST(pow(16, s.level) AS BIGINT)
  UNION ALL
  SELECT x.source, x.pos, 1, s.level, l, r FROM leaves x JOIN subroots u ON u.g IS NOT DISTINCT FROM x.source
  JOIN siblings s ON s.tree = 1 AND s.pos = u.pos // CAST(pow(16, s.level) AS BIGINT)),
paths AS (
  SELECT source, pos, sha256(string_agg(l || r, '' ORDER BY tree, level)) AS proof, list({'l': l, 'r': r} ORDER BY tree, level) AS path
  FROM steps GROUP BY source, pos),
folded AS (
  SELECT x.doc_id, x.leaf, u.h AS subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
         list_reduce(list_prepend({'l': CASE WHEN tampered THEN forged ELSE leaf END, 'r': ''}, coalesce(p.path, [])),
                     lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''}).l AS folded_root
  FROM leaves x JOIN subroots u ON u.g IS NOT DISTINCT FROM x.source JOIN high t ON t.n = 1
  LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM x.source AND p.pos = x.pos)
SELECT *, folded_root = root AS verified FROM folded""",
}
