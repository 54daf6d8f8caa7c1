"""Statistics of reading errors, and marks of what differs between two strands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.strands import kmer_ids, pack_marks, runs

#: Reads farther from their strand than this share of its length are outliers; runs from this length on count together; length of a context.
OUTLIER, MAX_RUN, CONTEXT = 0.3, 7, 5


def bases(strands: DataFrame) -> DataFrame:
    """(strand_id, pos, run, kmer) of every base of strands (strand_id, strand), pos from 0; run: length of the run it is in, up to MAX_RUN; kmer: number of the context around it, or -1."""
    run = F.flatten(F.transform(runs(F.col("strand")), lambda r: F.array_repeat(F.least(F.lit(MAX_RUN), r.run), r.run)))
    p = strands.select("strand_id", F.posexplode(F.arrays_zip(run.alias("run"), kmer_ids(F.col("strand"), CONTEXT).alias("kmer"))).alias("pos", "x"))
    return p.select("strand_id", "pos", "x.run", "x.kmer")


def without_outliers(reads: DataFrame, ops: DataFrame) -> DataFrame:
    """reads (strand_id, read_no, strand) with n_edits, the number of their ops (strand_id, read_no); outliers are left out."""
    n = ops.groupBy("strand_id", "read_no").agg(F.count("*").alias("n_edits"))
    r = reads.join(n, ["strand_id", "read_no"], "left").withColumn("n_edits", F.coalesce("n_edits", F.lit(0)))
    return r.where(F.col("n_edits") <= F.floor(F.length("strand") * OUTLIER))


def error_counts(strands: DataFrame, reads: DataFrame, ops: DataFrame) -> DataFrame:
    """(scope, key, tag, events, bases): how often each kind of error meets each position, run length and context, and how many bases were read there.

    strands (strand_id, strand), reads (strand_id, read_no) without outliers, ops (strand_id, read_no, tag, src_pos) of all reads. An insertion after the last base counts for it. Keys that no
    read covers have no row; those without errors of a kind have 0 events. Contexts that reach over a strand's ends don't count.
    """
    at = bases(strands)
    n = reads.groupBy("strand_id").agg(F.count("*").alias("n"))
    kinds = F.array(*(F.struct(F.lit(scope).alias("scope"), F.col(c).cast("long").alias("key")) for scope, c in (("position", "pos"), ("run", "run"), ("context", "kmer"))))
    keyed = lambda df: df.withColumn("k", F.explode(kinds)).where("k.key >= 0")
    read = keyed(at.join(n, "strand_id")).groupBy("k.scope", "k.key").agg(F.sum("n").alias("bases"))
    last = strands.select("strand_id", (F.length("strand") - 1).alias("end"))
    met = ops.join(reads.select("strand_id", "read_no"), ["strand_id", "read_no"], "left_semi").join(last, "strand_id").withColumn("pos", F.least("src_pos", "end"))
    met = keyed(met.groupBy("strand_id", "pos", "tag").agg(F.count("*").alias("e")).join(at, ["strand_id", "pos"])).groupBy("k.scope", "k.key", "tag").agg(F.sum("e").alias("events"))
    every = read.withColumn("tag", F.explode(F.array(*map(F.lit, ("replace", "insert", "delete")))))
    return every.join(met, ["scope", "key", "tag"], "left").select("scope", "key", "tag", F.coalesce("events", F.lit(0)).alias("events"), "bases")


def shared_errors(reads: DataFrame, ops: DataFrame, share: float = 0.2, least: int = 10) -> DataFrame:
    """(tag, hot, places, share, of_errors) for each kind of error: places of strands with at least so many reads at which that share of the reads or more have it; of all such strands'
    places, and of all its errors there (once a read and place).

    reads (strand_id, read_no, strand), ops (strand_id, read_no, tag, src_pos) of all of them; outliers don't count. An insertion after the last base counts for it.
    """
    used = without_outliers(reads, ops).select("strand_id", "read_no", "strand")
    strands = used.groupBy("strand_id").agg(F.count("*").alias("n_reads"), F.first(F.length("strand")).alias("length")).where(F.col("n_reads") >= least)
    met = ops.select("strand_id", "read_no", "tag", "src_pos").join(used.select("strand_id", "read_no"), ["strand_id", "read_no"], "left_semi").join(strands, "strand_id")
    once = met.select("strand_id", "read_no", "tag", "n_reads", F.least("src_pos", F.col("length") - 1).alias("pos")).distinct()
    hits = once.groupBy("strand_id", "tag", "pos").agg(F.count("*").alias("n"), F.first("n_reads").alias("n_reads"))
    hot = F.col("n") >= share * F.col("n_reads")
    by = hits.groupBy("tag").agg(F.count_if(hot).alias("hot"), F.sum("n").alias("errors"), F.coalesce(F.sum(F.when(hot, F.col("n"))), F.lit(0)).alias("shared"))
    by = by.crossJoin(F.broadcast(strands.agg(F.sum("length").cast("long").alias("places"))))  # one row
    return by.select("tag", "hot", "places", F.round(F.col("hot") / F.col("places"), 9).alias("share"), F.round(F.col("shared") / F.col("errors"), 9).alias("of_errors"))


def read_errors(reads: DataFrame) -> list[Column]:
    """Aggregates over reads (strand, n_edits): their number, the mean, deviation and percentiles of errors per base."""
    rate = F.col("n_edits") / F.length("strand")
    shares = F.percentile(rate, F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    return [F.count("*").alias("n_reads"), F.avg(rate).alias("mean"), F.stddev_pop(rate).alias("sd"), shares.alias("percentiles")]


def read_marks(ops: DataFrame, by: list[str], visible: int) -> DataFrame:
    """(by, marks): where a read differs from the decoded strand, in places of the read, from ops (by, tag, src_pos) that turn it into the strand: x a wrong letter, e an extra one, m one missing before
    it (once a place). Only places below visible count."""
    kind = F.when(F.col("tag") == "replace", "x").when(F.col("tag") == "delete", "e").otherwise("m")
    seen = F.collect_set(F.when(F.col("src_pos") < visible, F.struct(F.col("src_pos").cast("int").alias("pos"), kind.alias("kind"))))
    return ops.groupBy(*by).agg(pack_marks(seen).alias("marks"))


def fix_marks(ops: DataFrame, by: list[str], visible: int) -> DataFrame:
    """(by, marks, replaced, total): what turned a draft into the final strand, in places of the latter, from ops (by, tag, src_pos, dest_pos, letter): s a substitution, i an insertion, d a deletion before
    it (the first of a place). replaced: the draft's letters in the order of the marks, - where it had none; total: all edits. Only places below visible are marked."""
    kind = F.when(F.col("tag") == "replace", "s").when(F.col("tag") == "insert", "i").otherwise("d")
    was = F.when(F.col("tag") == "insert", "-").otherwise(F.col("letter"))
    first = ops.groupBy(*by, F.col("dest_pos").cast("int").alias("pos"), kind.alias("kind")).agg(F.min_by(was, "src_pos").alias("was"), F.count("*").alias("n"))
    shown = F.array_sort(F.collect_list(F.when(F.col("pos") < visible, F.struct("pos", "kind", "was"))))
    out = first.groupBy(*by).agg(shown.alias("m"), F.sum("n").alias("total"))
    return out.select(*by, pack_marks(F.transform("m", lambda x: F.struct(x.pos.alias("pos"), x.kind.alias("kind")))).alias("marks"), F.array_join(F.transform("m", lambda x: x.was), "").alias("replaced"), "total")


def trim_marks(packed: Column, visible: int) -> Column:
    """Packed marks without those at or beyond a place."""
    found = F.regexp_extract_all(packed, F.lit("([0-9]+[a-z])"), F.lit(1))
    return F.array_join(F.filter(found, lambda m: F.regexp_extract(m, "[0-9]+", 0).cast("int") < visible), "")
