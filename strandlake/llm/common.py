"""Helpers shared by the training-data operators: staging, Arrow column maps, prefix sums, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.sources.scratch import shared_dir

#: Rows of documents that one slice of an Arrow batch holds while Python works on it; bounds a worker's memory.
SLICE_ROWS = 512
#: Text bytes after which a slice is cut earlier.
SLICE_BYTES = 1 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to a fresh Parquet table in the shared folder and return a DataFrame over it (lineage ends there)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most SLICE_ROWS rows and, where a text column is named, about SLICE_BYTES of it."""
    if text is None or batch.num_rows == 0:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
        return
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or total + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def with_arrow_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable], whole: bool = False) -> DataFrame:
    """df with columns computed in Python from one text column.

    make() runs once per task and returns f(list of texts, or the whole part of a batch) -> list of columns as Python lists or Arrow arrays, in the
    order of fields.
    A column of df whose name (in any case) equals a new one's is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType([*kept, *fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(fields))
    names = [f.name for f in kept]

    def run(batches):
        f = None
        for batch in batches:
            for b in slices(batch, text):
                f = f or make()
                got = f(b if whole else b.column(text).to_pylist())
                cols = [c if isinstance(c, pa.Array) else pa.array(c, type=t.type) for c, t in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *cols], names=[*names, *arrow.names])

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has in any case: these, with underscores before them as needed."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def plain(columns: list[str]) -> list[Column]:
    """Columns by name, whatever signs are in it."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def ordered_columns(df: DataFrame) -> list[Column]:
    """Sort keys of all columns that have an order (maps and variants have none), nulls last."""
    return [c.asc_nulls_last() for c, (_, kind) in zip(plain(df.columns), df.dtypes) if "map<" not in kind and "variant" not in kind]


def running_start(df: DataFrame, key: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """df (key: 0, 1, 2, ...) with the sum of value over all smaller keys, in two levels so that no window sees all rows."""
    df = df.withColumn("__block", F.floor(F.col(key) / block))
    totals = df.groupBy("__block").agg(F.sum(value).alias("__sum"))
    before = totals.select("__block", (F.sum("__sum").over(Window.orderBy("__block")) - F.col("__sum")).alias("__before"))
    inner = Window.partitionBy("__block").orderBy(key)
    out_df = df.join(before, "__block").withColumn(out, F.col("__before") + F.sum(value).over(inner) - F.col(value))
    return out_df.drop("__block", "__before")


def running_sums(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """df in a total order, as a staged table with sums over all rows up to and with each one: within ranges of the order, after those of the ranges before.

    The only window without a partition sees a row for each range.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part").agg(*(F.sum(v).alias(f"__{n}") for n, v in sums.items()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums))
    inner = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.select("*", *(F.sum(v).over(inner).alias(n) for n, v in sums.items()))
    out = stage(within.join(totals, "__part").select(*df.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums)), "summed")
    unstage(ranged)
    return out


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), as a staged table; component is the smallest node reachable.

    Alternating large-star and small-star steps; each result is written to the shared folder, so no lineage grows and a lost
    executor costs a step at most. Edges between a hub and its nodes are aggregated with a combining min, never collected; the minima are a table of
    their own, so that Spark can split a hub's edges in the join with it.
    """

    def sign(df):
        return df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()

    given = stage(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "cc")
    now = given.where("u <> v")
    known = sign(now)
    for _ in range(max_rounds):
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        hubs = stage(both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m")), "hubs")
        large = both.join(hubs, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        low = down.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = down.select(F.col("u").alias("x"), "v").join(low, "x")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
        after = stage(after.distinct(), "cc")
        before, known = known, sign(after)
        unstage(hubs)
        if hasattr(now, "staged_at"):
            unstage(now)
        now = after
        if before == known:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    alone = given.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = stage(stars.union(alone.join(stars, "node", "left_anti")), "parts")
    unstage(given)
    unstage(now)
    return out


def crc_text(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))
