"""What the queries start from: strands and reads that Spark derives from the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.cutting import count_cut_kmers, count_kmers, count_shapes, cut_batches, shape_batches

#: Bases of one strand (28 bytes), and what an item's number is multiplied by to leave room for the numbers of its strands.
LENGTH, ROOM = 112, 1 << 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strands(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each text cut into strands: chunk (0, 1, ...) and strand. Null and empty texts have none.

    Bytes become bases by one look-up of Arrow buffers, whose cost grows with the text; built-in functions take some fifty times as long, as they know
    no base four. Select the columns to keep before, as each strand's row repeats them.
    """
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField("chunk", T.IntegerType()), T.StructField("strand", T.StringType())])
    return df.mapInArrow(lambda batches: cut_batches(batches, text, LENGTH), schema)


def document_strands(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Strands of all documents, with these columns of theirs."""
    return strands(table(spark, sf_dir, "documents").select(*columns, "text"))


def kmer_counts(strands_: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(group, k, kmer, n) of strands (group, strand), counted within each batch first."""
    kind = dict(strands_.dtypes)["group"]
    n = strands_.select("group", "strand").mapInArrow(lambda batches: count_kmers(batches, ks), f"group {kind}, k int, kmer string, n long")
    return n.groupBy("group", "k", "kmer").agg(F.sum("n").alias("n"))


def strand_shapes(df: DataFrame, text: str = "text") -> DataFrame:
    """Like strands(), with each strand's run (longest of one base), gc (how many G and C) and length in place of its letters."""
    whole = [T.StructField(c, T.IntegerType()) for c in ("chunk", "run", "gc", "length")]
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), *whole])
    return df.mapInArrow(lambda batches: shape_batches(batches, text, LENGTH), schema)


def shape_counts(texts: DataFrame) -> DataFrame:
    """(group, run, gc, length, n) of the strands of texts (group, text), counted within each batch first."""
    n = texts.select("group", "text").mapInArrow(lambda batches: count_shapes(batches, LENGTH), f"group {dict(texts.dtypes)['group']}, run int, gc int, length int, n long")
    return n.groupBy("group", "run", "gc", "length").agg(F.sum("n").alias("n"))


def text_kmer_counts(texts: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """What kmer_counts() gives for the strands of texts (group, text), for k of at most 5, without their letters."""
    n = texts.select("group", "text").mapInArrow(lambda batches: count_cut_kmers(batches, ks, LENGTH), f"group {dict(texts.dtypes)['group']}, k int, kmer string, n long")
    return n.groupBy("group", "k", "kmer").agg(F.sum("n").alias("n"))


def benchmark_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strands(table(spark, sf_dir, "benchmark").select("item_id", "text")).withColumn("strand_id", F.col("item_id") * ROOM + F.col("chunk"))


_PAIRS = "lower(substr(h, i * 56 + 1, 56))"
for _n in range(16):
    _PAIRS = f"replace({_PAIRS}, '{_n:x}', '{'ACGT'[_n >> 2] + 'ACGT'[_n & 3]}')"

SQL_STRANDS = f"""strands AS (SELECT doc_id, lang, source, i AS chunk, {_PAIRS} AS strand FROM (
SELECT doc_id, lang, source, hex(encode(text)) AS h, unnest(range(CAST((length(hex(encode(text))) + 55) // 56 AS BIGINT))) AS i FROM documents WHERE length(text) > 0))"""
SQL_BENCH = f"""strands AS (SELECT item_id, item_id * {ROOM} + i AS strand_id, i AS chunk, {_PAIRS} AS strand FROM (
SELECT item_id, hex(encode(text)) AS h, unnest(range(CAST((length(hex(encode(text))) + 55) // 56 AS BIGINT))) AS i FROM benchmark WHERE length(text) > 0))"""
SQL_GC = "(length(strand) - length(translate(strand, 'GC', '')))::DOUBLE / greatest(1, length(strand))"
SQL_RUN = "coalesce(list_max(list_transform(regexp_extract_all(strand, 'A+|C+|G+|T+|N+'), lambda x: length(x))), 0)"


def sql_uniform(*keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8) AS BIGINT) / 4294967296.0"


#: Queries and their SQL, by name; filled by the modules of this package.
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put
