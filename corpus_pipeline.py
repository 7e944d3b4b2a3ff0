"""A corpus pipeline: from raw documents to packed training sequences.

STAGES are run in order. Each takes (spark, docs, sf_dir) and works on all documents that the one before kept; run()
writes what each returns to the shared folder as Parquet and rereads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.jaccard import jaccard_join
from lattica.llm.langid import identified
from lattica.llm.packing import packed
from lattica.llm.quality import judged
from lattica.llm.recompress import remove_repeats
from lattica.llm.tables import discard, settled, table

#: A language's least score.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with LEAST_SCORE or more; a null lang becomes the predicted one."""
    sure = identified(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return sure.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no adaptive rule rejects."""
    return judged(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near duplicates. Of rows with one doc_id, one stays; rows
    without a doc_id all stay."""
    others = settled(jaccard_join(docs).where("component_id != doc_id").select("doc_id").distinct(), "duplicates")
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept  # nothing to drop, and so no need to deal out the texts by id
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 35 words or more that occur more than once."""
    cut = remove_repeats(docs, "cut")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, and the sequence and offset of each."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", substring_dedup), ("best_fit_packing", packing)]

#: Language ID, Jaccard groups and packing have no counterpart in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(stage(spark, docs, sf_dir), name)
        if hasattr(before, "_settled_path"):
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
