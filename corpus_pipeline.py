"""The corpus pipeline: quality rules, line dedup, near duplicates, repeated bytes, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.llm.lines import drop_repeated_chunks
from lemmata.llm.ngram_join import ngram_join
from lemmata.llm.packing import pack
from lemmata.llm.quality import quality_rules
from lemmata.llm.storage import stored
from lemmata.llm.suffixes import drop_repeated_bytes

#: SQL cannot express these stages; tests hold the rows against brute force.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts have no words and go. Repeated rows are judged alike, an empty table stays empty, other columns keep their values."""
    return quality_rules(docs, keep_columns=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of lines that occur before them; null and empty texts stay as they are. Rows equal in id and text do not repeat each other, an empty table stays empty, other columns keep their values (n_chars is counted anew)."""
    return _recounted(drop_repeated_chunks(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; texts without words are groups of their own. Rows of one id stay together, those of null ids only where they are their own group; an empty table stays empty, other columns keep their values."""
    kept = ngram_join(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes that repeat from earlier ones; a null text stays null, a text that repeats whole becomes empty. Rows of one id do not cover each other, an empty table stays empty, other columns keep their values (n_chars is counted anew)."""
    return _recounted(drop_repeated_bytes(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a null or empty text is its end token alone. Rows of one id are packed one by one, an empty table gives no pieces, other columns are not read."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("suffixes", suffixes), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are stored and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
