"""The queries op1 to op13: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import alignment, chat, codes, id_files, mixing, mpeg_audio, pieces, pii, quality, secret_scan, vectors, warc
from strandlake.llm.common import table
from strandlake.llm.minhash import near_duplicates
from strandlake.llm.oracles import ORACLES  # noqa: F401  for the entry point


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op2_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(*chat.preference_sides(table(spark, sf_dir, "conversations")))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.stored_features(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, _ = pii.train(docs)
    return pii.digest(pii.detect(docs, weights))


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = id_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return id_files.read(spark, folder)


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(*codes.compress(table(spark, sf_dir, "embeddings")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_chat_preferences": op2_chat_preferences,
    "op3_mpeg_audio": op3_mpeg_audio,
    "op4_secret_scan": op4_secret_scan,
    "op5_pii": op5_pii,
    "op6_id_files": op6_id_files,
    "op7_multi_index": op7_multi_index,
    "op8_quality": op8_quality,
    "op9_mix": op9_mix,
    "op10_minhash": op10_minhash,
    "op11_vector_codes": op11_vector_codes,
    "op12_alignment": op12_alignment,
    "op13_warc": op13_warc,
}
