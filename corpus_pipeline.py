"""Corpus pipeline: quality classifier, near-duplicates, personal data, mixing of sources, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the columns of documents, and any others that docs
has, whatever their names (but dots in them, which mapInArrow does not take). Between stages the rows are written as Parquet and read again, so a lost executor costs one stage at most. Every stage takes an empty
table, and texts of any length whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm import mixing, pieces, pii, quality
from strandlake.llm.common import ordered_columns, plain, stage, table, unused
from strandlake.llm.minhash import near_duplicates

#: Scores below this are rejected.
LEAST_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among docs, doesn't reject.

    Null and empty texts are scored as well, as texts without features; rows without doc_id count like others. Equal texts fare alike.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "score")
    return quality.score(docs, model, column=score).where(F.col(score) >= LEAST_QUALITY).select(*plain(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates (five words, similarity 0.8).

    Of rows with equal doc_id and text one stays. Different texts under one doc_id are documents of their own; the one whose hash is smallest has the doc_id's place in a
    group, the others come after all doc_ids. Null and empty texts resemble nothing; rows without doc_id stay.
    """
    hash_, id_, low, high, node, kept, place = unused(docs, "hash", "id", "low", "high", "node", "kept", "place")
    known = docs.where("doc_id is not null").withColumn(hash_, F.xxhash64("text"))
    of = known.groupBy(F.col("doc_id").alias(id_)).agg(F.min(hash_).alias(low), F.max(hash_).alias(high))
    several = of.where(F.col(low) != F.col(high)).select(id_, low)
    later = F.shiftrightunsigned(F.xxhash64("doc_id", hash_), 2).bitwiseOR(F.lit(1 << 62))
    number = F.when(F.col(low).isNull() | (F.col(hash_) == F.col(low)), F.col("doc_id").cast("long")).otherwise(later)
    rows = known.join(several, known.doc_id == F.col(id_), "left").withColumn(node, number).select(*plain(docs.columns), node)
    rows = stage(rows, "nodes")
    near = near_duplicates(rows.select(F.col(node).alias("doc_id"), "text"), words=5, percent=80)
    chosen = rows.join(near.where("kept").select(F.col("doc_id").alias(kept)).distinct(), F.col(node) == F.col(kept))
    first = F.row_number().over(Window.partitionBy(node).orderBy(*ordered_columns(docs)))
    one = chosen.withColumn(place, first).where(F.col(place) == 1).select(*plain(docs.columns))
    return one.union(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with spans of personal data replaced by their kind; n_chars follows.

    Null and empty texts stay as they are, with their n_chars; texts without personal data too. Equal texts fare alike.
    """
    weights, _ = pii.train(docs)
    out = pii.detect(docs, weights, redact=True, column=unused(docs, "spans")[0])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out.select(*plain(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it doesn't take, and those without words (null and empty texts), go.

    A null source is a source, a null doc_id counts as an id, and equal rows are decided one by one.
    """
    return mixing.mixed(docs)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, ids_crc32, lossless of every row. Null and empty texts have no ids; rows with equal doc_id and text have equal ids."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode(docs.select("doc_id", "source", "text"), model).select("doc_id", "source", "n_tokens", "ids", "ids_crc32", "lossless")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix_sources),
    ("sentencepiece", to_ids),
]

#: SQL can't express the classifier, the flight of the cube method, or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"stage-{name}")
    return docs
