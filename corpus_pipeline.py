"""The corpus pipeline: five stages over `documents`, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents` that they were given, further ones and null ids among them. An empty
table stays empty; texts of any length are read whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.config import shared_folder
from glintscan.llm import bpe, decontam, jaccard, langid, suffix_dedup
from glintscan.llm.queries import PIECES, RANKS


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the identified language in place of the declared one and drops documents that have none: a null text or one without a
    letter.

    The model learns from `lang` of its own input. Where no document has one, nothing can be identified: only texts without a
    letter go, and `lang` stays null.
    """
    model = langid.fit(docs, langid.vocabulary(PIECES), F.lit(True))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.detect(docs, model).filter(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of equal and similar texts: the one of least id, null ids last (see `jaccard.keep_one`).
    Of repeated rows one stays."""
    return jaccard.keep_one(docs)


def whole_characters(text: Column, spans: Column) -> Column:
    """The text without the given spans of bytes, each widened to whole characters."""
    raw = text.cast("binary")

    def inside(place: Column) -> Column:  # a byte that no character starts with
        return F.hex(F.substring(raw, place + 1, F.lit(1))).between("80", "BF")

    def edge(place: Column, step: int) -> Column:
        near = [place + step * k for k in range(4)]
        return F.when(~inside(near[0]), near[0]).when(~inside(near[1]), near[1]).when(~inside(near[2]), near[2]).otherwise(near[3])

    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: edge(s["stop"], 1)))
    ends = F.concat(F.transform(spans, lambda s: edge(s["start"], -1)), F.array(F.octet_length(text)))
    return F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(raw, a + 1, F.greatest(b - a, F.lit(0))).cast("string")), "")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has as well; documents of which nothing is left go.

    A character that a cut has broken is dropped, and nothing else. n_chars follows the text.
    """
    cut = suffix_dedup.remove_repeats(docs)
    kept = whole_characters(F.col("text"), F.col("spans"))
    changed = cut.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(kept)).filter((F.col("n_removed") == 0) | (F.col("text") != ""))
    return changed.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are contaminated with the benchmark."""
    marked = decontam.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.filter(~F.col("contaminated")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of every document."""
    encoded = bpe.encode_documents(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontaminate", decontaminate), ("tokens", tokens)]
#: SQL can't express the learned language model; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What lies between them is written to the session's shared folder: a stage's input goes
    when its output is there, the last one's when the session ends."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path(folder))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            files.delete(path(f"{folder}/{STAGES[k - 1][0]}"), True)
    return STAGES[-1][1](spark, docs, sf_dir)
