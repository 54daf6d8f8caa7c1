"""Experiment tables: searching settings, coverage targets, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_meeting(rates: DataFrame, by: list[str], target: float) -> DataFrame:
    """(by, coverage, before): the least coverage whose rate meets the target, and the one below it; null where none does."""
    w = Window.partitionBy(*by).orderBy("coverage")
    r = rates.withColumn("before", F.lag("coverage").over(w))
    met = r.where(F.col("rate") >= target).groupBy(*by).agg(F.min(F.struct("coverage", "before")).alias("m"))
    return rates.select(*by).distinct().join(met, by, "left").select(*by, "m.coverage", "m.before")


def crossing(rates: DataFrame, by: list[str], target: float) -> DataFrame:
    """(by, needed): coverage at which the rate first crosses the target, by a line between the two points around it."""
    w = Window.partitionBy(*by).orderBy("coverage")
    r = rates.select(*by, "coverage", "rate", F.lag("coverage").over(w).alias("c0"), F.lag("rate").over(w).alias("r0")).where(F.col("rate") >= target)
    line = F.col("c0") + (target - F.col("r0")) * (F.col("coverage") - F.col("c0")) / (F.col("rate") - F.col("r0"))
    at = F.when(F.col("c0").isNull() | (F.col("r0") >= target), F.col("coverage")).otherwise(line)
    return r.groupBy(*by).agg(F.min_by(at, "coverage").alias("needed"))


def rule_verdict(on: Column, off: Column, grid: list[float]) -> Column:
    """Whether a rule pays off by the reads needed with it and without, in whole steps of the grid of reads (a value between two points belongs to the upper one); null means never."""
    steps = grid_step(off, grid) - grid_step(on, grid)
    return F.when(steps >= 1, "pays off").when(steps <= -1, "harmful").otherwise("no measurable benefit")


def crossover_verdict(reads: Column, bits: Column, base_reads: Column, base_bits: Column) -> Column:
    """1 where a codec is better than the default on a channel in reads or density and worse in neither, -1 where it is worse and better in neither or never meets the target, 0 else.

    Reads differ from 0.05 on, bits per base from 0.005 on; a default that never meets the target needs more reads than any that does; unknown densities are equal.
    """
    fewer = F.when(base_reads.isNull(), 1).when(reads < base_reads - 0.05, 1).when(reads > base_reads + 0.05, -1).otherwise(0)
    denser = F.when(bits.isNull() | base_bits.isNull(), 0).when(bits > base_bits + 0.005, 1).when(bits < base_bits - 0.005, -1).otherwise(0)
    return F.when(reads.isNull(), -1).when((fewer + denser > 0) & (fewer * denser >= 0), 1).when((fewer + denser < 0) & (fewer * denser >= 0), -1).otherwise(0)


def single_step(on: Column, off: Column) -> Column:
    """Whether a verdict rests on a gap of one grid step."""
    return F.coalesce(F.abs(on - off).between(0.05, 1.0), F.lit(False))


def pareto_front(points: DataFrame, by: list[str], up: str, down: str) -> DataFrame:
    """points with whether no other has more of up and less of down (or as much of one): a running minimum, no pair of points is compared."""
    better = Window.partitionBy(*by).orderBy(F.desc(up)).rangeBetween(Window.unboundedPreceding, -1)
    level = Window.partitionBy(*by, up)
    best_above = F.min(down).over(better)
    return points.withColumn("front", (best_above.isNull() | (F.col(down) < best_above)) & (F.col(down) == F.min(down).over(level)))


def grid(dims: dict[str, DataFrame]) -> DataFrame:
    """Every combination of the rows of small tables of settings. The number of rows is the product of the tables' sizes, as the search asks."""
    out = None
    for df in dims.values():
        out = df if out is None else out.crossJoin(F.broadcast(df))  # a setting's values are listed by hand
    return out.dropDuplicates()


def select_best(found: DataFrame, by: list[str]) -> DataFrame:
    """Of candidates (by, i, target_met, bits_per_base, strength) the one that meets the target, is densest, strongest, earliest."""
    best = F.max(F.struct("target_met", "bits_per_base", "strength", (-F.col("i")).alias("neg"))).alias("b")
    return found.groupBy(*by).agg(best).select(*by, (-F.col("b.neg")).alias("i"), "b.target_met", "b.bits_per_base", "b.strength")


def grid_step(reads: Column, grid: list[float]) -> Column:
    """Place of the first grid point that is not below reads (a value between two belongs to the upper one); the grid's size where there is none, or reads is null."""
    points = sorted(grid)
    out = F.when(reads.isNull(), len(points))
    for i, g in enumerate(points):
        out = out.when(reads - 1e-9 <= g, i)
    return out.otherwise(len(points))


def matched_verdict(default: Column, tuned: Column, grid: list[float]) -> Column:
    """Whether tuned settings are better at equal density, by whole steps of the grid of reads."""
    steps = grid_step(default, grid) - grid_step(tuned, grid)
    return F.when(steps >= 1, "tuned is better").when(steps <= -1, "harmful").otherwise("no measurable benefit")


def redundancy_verdict(budget: Column, default: Column, default_bits: Column, tuned: Column, tuned_bits: Column, grid: list[float]) -> Column:
    """Whether tuned settings are better: the target within the budget first, then bits per base; where neither meets it, by whole steps of reads."""
    old, new = F.coalesce(default <= budget, F.lit(False)), F.coalesce(tuned <= budget, F.lit(False))
    better = F.when(new & old, tuned_bits > default_bits + 1e-9).when(new, True).when(old, False).otherwise(grid_step(default, grid) - grid_step(tuned, grid) >= 1)
    return F.when(better, "tuned is better").otherwise("default is fine")


def tradeoff(default_bits: Column, tuned_bits: Column, matched: Column, tuned: Column) -> Column:
    """What tuned settings pay and why they win: their density, then whether the default rules reach the target with as few reads at that density."""
    density = F.when(tuned_bits < default_bits - 1e-9, "sparser").when(tuned_bits > default_bits + 1e-9, "denser")
    cause = F.when(matched.isNull() | tuned.isNull(), None).when(matched <= tuned, "settings").otherwise("rules")
    return F.concat_ws(", ", density, cause)


def in_order(name: Column, order: list[str]) -> list[Column]:
    """Sort keys: names of the list by their place in it, then all others by name."""
    place = F.array_position(F.array(*map(F.lit, order)), name)
    return [F.when(place > 0, place).otherwise(len(order) + 1), name]


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    """df with columns rounded, numbers and arrays of numbers alike."""
    kinds = dict(df.dtypes)

    def one(c: str, n: int) -> Column:
        return F.transform(c, lambda x: F.round(x, n)) if kinds[c].startswith("array") else F.round(c, n)

    return df.withColumns({c: one(c, n) for c, n in places.items()})


def per_trial(trials: DataFrame, seeds: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, accuracy, recovered): means of trials (by, seed, accuracy, recovered); an error where a group's trials are not one for each of seeds (seed)."""
    n = seeds.agg(F.count_distinct("seed").alias("expected"))
    t = trials.join(seeds.distinct(), "seed", "left_semi").groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("seed").alias("seeds"), F.avg("accuracy").alias("accuracy"), F.avg("recovered").alias("recovered"))
    t = t.crossJoin(F.broadcast(n))  # one row
    wrong = F.concat(F.lit("per-trial results for "), F.col("n"), F.lit(" trials, expected "), F.col("expected"))
    return t.where(F.when((F.col("n") == F.col("expected")) & (F.col("seeds") == F.col("expected")), True).otherwise(F.raise_error(wrong))).select(*by, "n", "accuracy", "recovered")


def held_out_strand(strand: Column, every: int = 5) -> Column:
    """Whether a strand is held out, by its CRC-32: the same in every file that has it."""
    return F.crc32(F.encode(strand, "UTF-8")) % every == 0
