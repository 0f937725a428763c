"""Queries of the training-data operators: thin digests over the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: sources weigh 1, 2, 3 in turn and are passed three times at most; in training order."""
    from .mixing import in_order, plan

    found = in_order(plan(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3.0))
    return found.select("doc_id", "size", "source_size", "target", "taken", "positions")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three quarters of them."""
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations: the last answer against a stale one."""
    from .preferences import format_preferences, span_text, stale_answers

    found = format_preferences(*stale_answers(table(spark, sf_dir, "conversations")))
    return found.select("pair_id", "n_common", "prompt", "chosen", span_text("chosen_spans").alias("chosen_spans"), "rejected", span_text("rejected_spans").alias("rejected_spans"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all vectors."""
    from .neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the word tokenizer, in sequences of at most 2048 tokens."""
    import public_tokenizers

    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the byte tokenizer, written as token files and read back."""
    import public_tokenizers

    from .rans import read_token_files, token_folder, write_token_files

    folder = token_folder(spark)
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=0)
    return read_token_files(files, folder)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all documents: 4-word shingles, 4 or fewer differing bits."""
    from .simhash import fingerprint_hex, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), most=4, width=4)
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of equal label, by cosine of 0.98 or more."""
    from .lattice import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op9_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC bundles and read back."""
    from .warc import archive_folder, read_archives, write_archives

    folder = archive_folder(spark)
    bundles = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(bundles, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality selection of all documents towards those labelled good."""
    from .quality import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_source_mixing, op2_language_id, op3_preference_format, op4_nearest_neighbours, op5_best_fit_packing, op6_token_files, op7_simhash_dedup, op8_lattice_dedup, op9_warc_bundles, op10_importance_resampling)}


OP3_SQL = """
WITH c AS (
  SELECT conv_id AS pair_id, turn, role, text,
    max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS final,
    lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS before
  FROM conversations
), sides AS (
  SELECT 'a' AS side, pair_id, turn, role, text FROM c WHERE turn <= final
  UNION ALL
  SELECT 'b', pair_id, turn, role, CASE WHEN role = 'assistant' AND turn = final THEN coalesce(before, '') ELSE text END FROM c WHERE turn <= final
), t AS (
  SELECT side, pair_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY side, pair_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) AS pos
  FROM sides WHERE pair_id IS NOT NULL
), n AS (
  SELECT pair_id, coalesce(min(CASE WHEN differs THEN pos END) - 1, max(pos)) AS n_common FROM (
    SELECT a.pair_id, a.pos, NOT (a.role = b.role AND a.text = b.text) AS differs
    FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.pos = b.pos WHERE a.side = 'a' AND b.side = 'b'
  ) GROUP BY pair_id
), r AS (
  SELECT t.*, n_common, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM t JOIN n USING (pair_id)
), p AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY side, pair_id, pos > n_common ORDER BY pos) AS stop FROM r
)
SELECT pair_id, CAST(any_value(n_common) AS BIGINT) AS n_common,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 'a' AND pos <= n_common), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 'a' AND pos > n_common), '') AS chosen,
  coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY pos) FILTER (WHERE side = 'a' AND pos > n_common AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 'b' AND pos > n_common), '') AS rejected,
  coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY pos) FILTER (WHERE side = 'b' AND pos > n_common AND role = 'assistant'), '') AS rejected_spans
FROM p GROUP BY pair_id
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT d, n, max(page_id) AS response FROM p WHERE n >= 1000 GROUP BY d, n
)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response <> page_id THEN response END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force."""
    return {"op3_preference_format": OP3_SQL, "op9_warc_bundles": OP9_SQL}
