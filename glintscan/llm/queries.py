"""The thin registered queries over the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.llm import bpe, decontam, jaccard, langid, quality, shards, suffix_dedup, tiff, token_counts, toxicity
from glintscan.llm.common import read, remainder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_out(n: int, r: int):
    return F.coalesce(remainder("doc_id", n) == r, F.lit(False)).alias("held_out")


def usable(n: int, r: int):
    return F.coalesce(remainder("doc_id", n) != r, F.lit(False))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), usable(3, 1))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontam.mark(docs, read(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item, width, array_to_string(w[s:s + width - 1], ' ') AS span
  FROM (SELECT item, w, least(len(w), 13) AS width, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, width, s, array_to_string(w[s:s + width - 1], ' ') AS span
  FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS s FROM d, (SELECT DISTINCT width FROM iw))),
h AS (SELECT r, s, width, item FROM dw JOIN iw USING (width, span)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + width)) AS p FROM h) GROUP BY r),
m AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with three edits that its id places: one removes, one adds, one replaces."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    at = lambda salt: (F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.greatest(size, F.lit(1)))).cast("int")
    edit = lambda start, length, new: F.struct(start.alias("start"), (start + length).alias("stop"), F.lit(new).alias("new"))
    edits = F.array(edit(at(1), 7, ""), edit(at(2), 0, " and 3 more words"), edit(at(3), 12, "Changed,\n it's"))
    made = token_counts.count_with_edits(docs, edits, bpe.read_ranks(RANKS), public_tokenizers.PATTERN, keep=["doc_id"])
    return made.select("doc_id", "n_tokens", "n_pretokens", "edited_tokens", "n_encoded", F.crc32(F.col("edited_text").cast("binary")).alias("edited_crc32"))


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store_payloads(read(spark, sf_dir, "documents"), keep=["doc_id"])
    stored = stored.select("doc_id", "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages = tiff.read_pages(stored, keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    tail = F.substring("pixels", -tiff.LINE, tiff.LINE)
    return pages.select("doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, langid.vocabulary(PIECES), usable(4, 2))
    found = langid.detect(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), usable(3, 1))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(RANKS)
    encoded = bpe.encode_documents(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    digest = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))
    decoded = bpe.decode_ids(digest, ranks, public_tokenizers.PATTERN, keep=["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_toxicity, op3_label_shards, op4_suffix_dedup, op5_decontamination, op6_token_counts, op7_tiff, op8_language_id, op9_quality, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL}
