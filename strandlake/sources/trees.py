"""Results and events as trees: JSON lines, read as VARIANT, lenient to fields that older files lack and strict to fields that nobody knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.frames import let

#: Fields of a run and of one of its iterations; those that came later may be missing, and what stands for them then.
RUN = ("situation", "recovery_target", "n_trials", "iterations", "is_mock")
ITERATION = ("iteration", "metrics", "risky_kmers", "notes", "stage", "min_reads_at_target")
LATER = {"stage": "", "min_reads_at_target": None}
_METRICS = "struct<bits_per_base: double, reads: double>"
_KMERS = "array<array<variant>>"


def known_fields(tree: Column, shown: Column, fields: tuple[str, ...], what: str, later: tuple[str, ...] = ()) -> Column:
    """The fields of a tree (VARIANT) as a map, if it is an object with all of these and no others (later ones may be missing); an error at run time, which tells what is shown, if not."""
    told = lambda text, names: F.raise_error(F.concat(F.lit(f"{what}: {text} "), F.array_join(names, ", ")))
    known, needed = F.array(*map(F.lit, fields)), F.array(*(F.lit(f) for f in fields if f not in later))

    def checked(m: Column) -> Column:
        keys = F.map_keys(m)
        rest = F.when(F.size(F.array_except(keys, known)) > 0, told("unknown fields", F.array_except(keys, known))).when(F.size(F.array_except(needed, keys)) > 0, told("lacks", F.array_except(needed, keys)))
        return F.when(m.isNull(), F.raise_error(F.concat(F.lit(f"{what}: not an object: "), F.coalesce(F.substring(shown, 1, 80), F.lit("null"))))).otherwise(rest.otherwise(m))

    return let(F.try_variant_get(tree, "$", "map<string, variant>"), checked)


def runs(lines: DataFrame, json: str = "value") -> DataFrame:
    """(situation, recovery_target, n_trials, is_mock, iterations) of run results, one JSON object a row; iterations: array of struct(iteration, metrics, risky_kmers (kmer, risk), notes, stage,
    min_reads_at_target). Empty lines are left out. A line is parsed once, and each of its objects becomes a map once."""

    def iteration(m: Column) -> Column:
        kmers = F.transform(F.variant_get(m["risky_kmers"], "$", _KMERS), lambda p: F.struct(F.variant_get(p[0], "$", "string").alias("kmer"), F.variant_get(p[1], "$", "double").alias("risk")))
        later = [F.coalesce(F.try_variant_get(m["stage"], "$", "string"), F.lit(LATER["stage"])).alias("stage"), F.try_variant_get(m["min_reads_at_target"], "$", "double").alias("min_reads_at_target")]
        return F.struct(F.variant_get(m["iteration"], "$", "int").alias("iteration"), F.variant_get(m["metrics"], "$", _METRICS).alias("metrics"), kmers.alias("risky_kmers"), F.variant_get(m["notes"], "$", "string").alias("notes"), *later)

    def run(m: Column) -> Column:
        top = [F.variant_get(m[c], "$", kind).alias(c) for c, kind in (("situation", "string"), ("recovery_target", "double"), ("n_trials", "int"), ("is_mock", "boolean"))]
        each = F.transform(F.try_variant_get(m["iterations"], "$", "array<variant>"), lambda i: let(known_fields(i, F.to_json(i), ITERATION, "iteration", tuple(LATER)), iteration))
        return F.struct(*top, each.alias("iterations"))

    whole = lines.where(F.length(F.trim(json)) > 0).select(let(F.try_parse_json(json), lambda v: let(known_fields(v, F.col(json), RUN, "run"), run)).alias("r"))
    return whole.select("r.*")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return runs(spark.read.text(path))
