"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    from lemmata.llm.ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC round trip of all pages."""
    from lemmata.llm.warc import read_records, write_archives

    index = write_archives(_table(spark, sf_dir, "pages"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted conversations, digests read back from the formatted turns."""
    from lemmata.llm.chat import chat_digests, turn_records

    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.to_json(F.struct(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant"))).alias("messages"))).alias("record"))
    return chat_digests(turn_records(_table(spark, sf_dir, "conversations")).unionByName(extra))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of all documents along the curve."""
    import public_tokenizers

    from lemmata.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as AVI files, read back."""
    from lemmata.llm.media import read_avi, write_avi

    return read_avi(write_avi(_table(spark, sf_dir, "documents")))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated line chunks."""
    from lemmata.llm.lines import drop_repeated_chunks

    out = drop_repeated_chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"), measures=True)
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_bytes", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of all documents."""
    from lemmata.llm.quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents."""
    from lemmata.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_segments", "top_score", "top_begin", "top_end")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents, and back."""
    import public_tokenizers

    from lemmata.llm.byte_bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes that repeat from earlier ones."""
    from lemmata.llm.suffixes import repeated_bytes

    return repeated_bytes(_table(spark, sf_dir, "documents")).drop("gone", "origin")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, a tenth of which are given loops."""
    from lemmata.llm.runs import looped, periodic_runs

    return periodic_runs(_table(spark, sf_dir, "documents"), loops=looped)


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of all documents by a class-based bigram model and by unigrams."""
    from lemmata.llm.class_lm import class_scores

    out = class_scores(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark texts."""
    from lemmata.llm.importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_warc, op3_chat, op4_packing, op5_media, op6_lines, op7_quality, op8_toxicity, op9_byte_bpe, op10_suffixes, op11_runs, op12_class_lm, op13_resampling)}
