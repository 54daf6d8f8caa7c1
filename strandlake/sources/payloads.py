"""Payload files, profiles, results and read clusters as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# First bytes of file kinds, in hex.
MAGIC = (("pdf", "255044462D"), ("png", "89504E47"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("webp", "52494646"))


def sniff_kind(content: Column) -> Column:
    """Kind of a payload by its first bytes; text if it is valid UTF-8, else binary."""
    out = None
    for kind, magic in MAGIC:
        hit = F.hex(F.substring(content, 1, len(magic) // 2)) == magic
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(F.is_valid_utf8(content.cast("string")), "text").otherwise("binary")


def read_payloads(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """path, content cut to max_bytes, kind, n_bytes of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.substring("content", 1, max_bytes).alias("content"), F.col("length").alias("n_bytes")).withColumn("kind", sniff_kind(F.col("content")))


#: Fields of a channel profile; others are refused.
PROFILE = "name string, description string, technology string, sub_rate double, ins_rate double, del_rate double, homopolymer_factor double, end_factor double, dropout_rate double, gc_dropout_factor double, coverage_mean double, coverage_dispersion double, storage_years double, decay_per_year double, synthesis_usd_per_base double, sequencing_usd_per_read double, calibrated_from string, homopolymer_run_factors array<double>, read_quality_spread double, malformed_read_rate double, position_rate_spread double, context_table string"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of one or more JSON files. Unknown fields and broken files raise."""
    found = spark.read.option("multiLine", True).json(path).columns
    known = {f.split()[0] for f in PROFILE.split(", ")}
    if extra := sorted(set(found) - known):
        raise ValueError(f"unknown profile fields: {', '.join(extra)}")
    return spark.read.schema(PROFILE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_profiles(profiles: DataFrame, path: str) -> None:
    """A JSON file for each profile; fields that are null are left out."""
    profiles.write.option("maxRecordsPerFile", 1).json(path)


def read_context_table(spark: SparkSession, path: str, k: int = 5) -> DataFrame:
    """(err_type, kmer_id, mult) of a JSON file with a list of 4 ** k multipliers for each error type. Wrong lengths and negative values raise."""
    raw = spark.read.schema("sub array<double>, ins array<double>, del array<double>").option("multiLine", True).json(path)
    kinds = F.array(*(F.struct(F.lit(c).alias("err_type"), F.col(c).alias("m")) for c in ("sub", "ins", "del")))
    long = raw.select(F.explode(kinds).alias("t")).select("t.err_type", F.assert_true(F.size("t.m") == 4**k, "wrong length").alias("ok"), F.posexplode("t.m").alias("kmer_id", "mult"))
    checked = F.when(F.col("mult") >= 0, F.col("mult")).otherwise(F.raise_error(F.lit("negative multiplier")))
    return long.where("ok is null").select("err_type", "kmer_id", checked.alias("mult"))


def read_delimited_clusters(spark: SparkSession, centers: str, clusters: str) -> DataFrame:
    """(cluster, reference, read_no, read) of text files: one reference a line, and sections of reads that lines of = open.

    Lines are in the order of files and of bytes within one; sections may cross files and blocks. A cluster without reads has one row with nulls.
    Different numbers of references and sections raise.
    """
    refs = _counted(_lines(spark, centers).where("value <> ''"), F.lit(1)).select((F.col("count") - 1).alias("cluster"), F.trim("value").alias("reference"))
    lines = _counted(_lines(spark, clusters), F.col("value").startswith("=").cast("int")).withColumn("cluster", F.col("count") - 1)
    reads = lines.where(~F.col("value").startswith("=") & (F.trim("value") != ""))
    reads = reads.select("cluster", (F.row_number().over(Window.partitionBy("cluster").orderBy("file", "block", "line")) - 1).alias("read_no"), F.trim("value").alias("read"))
    n_refs, n_sections = refs.count(), lines.where(F.col("value").startswith("=")).count()
    if n_refs != n_sections:
        raise ValueError(f"{n_refs} references but {n_sections} clusters")
    return refs.join(reads, "cluster", "left").select("cluster", "reference", "read_no", "read")


def read_starred_clusters(spark: SparkSession, path: str, complete_only: bool = False) -> DataFrame:
    """(cluster, reference, read_no, read) of text files of records: a reference, a line of *, reads, two empty lines. Records are split by Spark's reader, so a large
    file is read in parallel; clusters count from 0 in the order of files and of places in them, and a cluster without reads has one row with nulls.

    A last record that no empty lines end may be cut: it counts, unless complete_only. A record without its line of * is none.
    """
    r = _lines(spark, path, "\n\n\n")
    sizes = r.groupBy("file").agg(F.max("size").alias("size"), F.sum(F.octet_length("value") + 3).alias("ended"), F.max(F.struct("block", "line")).alias("last"))
    r = r.join(sizes.select("file", "last", (F.col("ended") > F.col("size")).alias("open")), "file")
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    good = F.element_at(lines, 2).startswith("*")
    if complete_only:
        good &= ~(F.col("open") & (F.struct("block", "line") == F.col("last")))
    r = _counted(r.select("file", "block", "line", lines.alias("l"), F.coalesce(good, F.lit(False)).alias("good")), F.col("good").cast("int"))
    split = r.where("good").select((F.col("count") - 1).alias("cluster"), "l")
    return split.select("cluster", F.element_at("l", 1).alias("reference"), F.posexplode_outer(F.slice("l", F.lit(3), F.greatest(F.size("l") - 2, F.lit(0)))).alias("read_no", "read"))


def write_starred_clusters(reads: DataFrame, key: str, path: str, cut: bool = False) -> None:
    """Text files in the same form from reads (key, reference, read_no, read) in the order of key; a null read is a cluster without reads. A cluster's reads stand in one
    record, as the format has it. cut: the last record lacks the lines that end it."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("read").isNotNull(), F.struct("read_no", "read")))), lambda x: x.read), "\n")
    r = reads.groupBy(key, "reference").agg(text.alias("text"))
    end = F.lit("\n\n")
    if cut:
        r = r.crossJoin(F.broadcast(r.agg(F.max(key).alias("__last"))))  # one row
        end = F.when(F.col(key) < F.col("__last"), end).otherwise("")
    body = F.concat("reference", F.lit("\n*****************************"), F.when(F.col("text") != "", F.concat(F.lit("\n"), "text")).otherwise(""), end)
    r.repartitionByRange(key).sortWithinPartitions(key).select(body.alias("value")).write.text(path)


def write_context_table(table: DataFrame, path: str) -> None:
    """One JSON file of a table (err_type, kmer_id, mult), multipliers to four decimal places; a table has 4 ** k of them for each error type."""
    lists = table.groupBy("err_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("kmer_id", F.round("mult", 4).alias("mult")))), lambda x: x.mult).alias("m"))
    one = lists.groupBy().pivot("err_type", ["sub", "ins", "del"]).agg(F.first("m"))
    one.coalesce(1).write.json(path)


def _lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", separator).text(path).select(*meta, F.monotonically_increasing_id().alias("line"), "value")


def _counted(lines: DataFrame, flag: Column) -> DataFrame:
    """lines with count, the sum of flag up to each: within blocks of files, and over the few totals of blocks."""
    lines = lines.withColumn("flag", flag)
    totals = lines.groupBy("file", "block").agg(F.sum("flag").alias("sum"))
    before = totals.select("file", "block", (F.sum("sum").over(Window.orderBy("file", "block")) - F.col("sum")).alias("before"))
    within = F.sum("flag").over(Window.partitionBy("file", "block").orderBy("line"))
    return lines.join(before, ["file", "block"]).withColumn("count", F.col("before") + within).drop("flag", "before")


def held_out(i: Column) -> Column:
    """Every fifth cluster of a file in order."""
    return i % 5 == 0


def held_out_reference(reference: Column) -> Column:
    """Clusters held out by their reference, so that one reference is never on both sides."""
    return F.crc32(reference.cast("binary")) % 5 == 0


def write_delimited_clusters(reads: DataFrame, key: str, centers: str, clusters: str) -> None:
    """Text files in the same form from reads (key, reference, read_no, read); a null read is a cluster without reads."""
    refs = reads.select(key, "reference").distinct()
    refs.repartitionByRange(key).sortWithinPartitions(key).select("reference").write.text(centers)
    lines = refs.select(key, F.lit(-1).alias("no"), F.lit("=====").alias("value")).union(reads.where("read is not null").select(key, "read_no", "read"))
    lines.repartitionByRange(key).sortWithinPartitions(key, "no").select("value").write.text(clusters)


def save_runs(runs: DataFrame, path: str) -> None:
    """Results (run_id, situation, ...) as JSON, one folder a run."""
    runs.write.partitionBy("run_id").json(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Results without summary files; fields that older files lack are null."""
    return spark.read.option("basePath", path).option("pathGlobFilter", "*.json").json(path).where(~F.col("_metadata.file_name").startswith("summary"))


def run_ids(spark: SparkSession, path: str) -> DataFrame:
    """Runs, newest first by the time of their last change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    run = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(run.alias("run_id")).agg(F.max("modificationTime").alias("changed")).orderBy(F.desc("changed"), "run_id")
