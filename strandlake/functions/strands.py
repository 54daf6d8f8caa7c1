"""Column functions on strands: strings over A, C, G, T."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: Runs that are looked for one length after another.
SHORT = 8


def gc_fraction(s: Column) -> Column:
    """Share of G and C; 0 for an empty strand."""
    others = F.replace(F.replace(s, F.lit("G"), F.lit("")), F.lit("C"), F.lit(""))
    return (F.length(s) - F.length(others)) / F.greatest(F.lit(1), F.length(s))


def has_run(s: Column, longer_than: int, letters: str = BASES) -> Column:
    """Whether a letter repeats more than so often in a row."""
    return reduce(lambda a, b: a | b, [s.contains(b * (longer_than + 1)) for b in letters])


def max_run_length(s: Column) -> Column:
    """Longest run of one letter; 0 for an empty strand. A null strand gives null."""
    # runs of up to SHORT letters, nearly all there are, by plain searches; the others by their words
    out = F.when(s.isNull(), None)
    for n in range(SHORT + 1):
        out = out.when(~has_run(s, n, BASES + "N"), n)
    return out.otherwise(F.array_max(F.transform(F.regexp_extract_all(s, F.lit("(A+|C+|G+|T+|N+)"), F.lit(1)), F.length)))


def runs(s: Column) -> Column:
    """Array of struct(base, first_pos (from 1), run) of the runs of one letter in a strand, in order; empty for an empty strand."""
    at = lambda i: F.substring(s, i, F.lit(1))
    places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 1) | (at(i) != at(i - 1)))
    each = F.transform(F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.length(s) + 1)).alias("b")), lambda x: F.struct(at(x.a).alias("base"), x.a.alias("first_pos"), (x.b - x.a).alias("run")))
    return F.filter(each, lambda x: x.first_pos.isNotNull())


def codes(s: Column) -> Column:
    """Array of 0 to 3 for A, C, G, T; -1 for anything else."""
    return F.transform(F.split(s, ""), lambda c: F.instr(F.lit(BASES), c) - 1)


def kmer_ids(s: Column, k: int) -> Column:
    """For each position the base-4 number of the k-mer centred there; -1 within k // 2 of the ends and where a letter is unknown."""
    half = k // 2

    def number(i: Column) -> Column:
        digits = [F.instr(F.lit(BASES), F.substring(s, i - half + j, F.lit(1))) - 1 for j in range(k)]
        value = reduce(lambda acc, d: acc * 4 + d, digits)
        known = reduce(lambda a, b: a & b, [d >= 0 for d in digits])
        inside = (i > half) & (i <= F.length(s) - half)
        return F.when(inside & known, value).otherwise(-1)

    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), number)).otherwise(F.array().cast("array<int>"))


def hex_to_bases(h: Column) -> Column:
    """Two bases for each hex digit, high bits first: numbers of up to 14 digits written to the base four."""
    groups = F.regexp_extract_all(h, F.lit("[0-9A-Fa-f]{1,14}"), F.lit(0))
    return F.translate(F.array_join(F.transform(groups, lambda g: F.lpad(F.conv(g, 16, 4), 2 * F.length(g), F.lit("0"))), ""), "0123", BASES)


def bases_to_hex(s: Column) -> Column:
    """Inverse of hex_to_bases for strands of even length."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(2)), F.lit(2)), lambda i: F.substring(s, i, F.lit(2)))
    digit = F.transform(pairs, lambda p: F.conv((F.instr(F.lit(BASES), F.substring(p, 1, 1)) - 1) * 4 + F.instr(F.lit(BASES), F.substring(p, 2, 1)) - 1, 10, 16))
    return F.when(F.length(s) > 0, F.lower(F.array_join(digit, ""))).otherwise(F.lit(""))


def reverse_complement(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGT", "TGCA")


def passes_rules(s: Column, max_homopolymer: int | None = 3, gc_min: float | None = 0.4, gc_max: float | None = 0.6) -> Column:
    """Whether a strand keeps the coding rules; a rule that is None is off, and an empty strand passes."""
    ok = F.lit(True)
    if max_homopolymer is not None:
        ok = ok & ~has_run(s, max_homopolymer)
    if gc_min is not None:
        ok = ok & (gc_fraction(s) >= gc_min)
    if gc_max is not None:
        ok = ok & (gc_fraction(s) <= gc_max)
    return (F.length(s) == 0) | ok


def uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) that is a pure function of its keys, equal in any engine that has MD5."""
    named = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *named).cast("binary")), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def subsample(reads: Column, k: int) -> Column:
    """At most k evenly spaced elements, first and last kept, in order."""
    n = F.size(reads)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(reads, (F.rint(i * (n - 1) / F.lit(k - 1)) + 1).cast("int")))
    return F.when(n <= k, reads).otherwise(at)


def pack_marks(marks: Column) -> Column:
    """Array of struct(pos, kind) as text such as 3x11e25m, by position."""
    return F.array_join(F.transform(F.array_sort(marks), lambda m: F.concat(m.pos.cast("string"), m.kind)), "")


def unpack_marks(packed: Column) -> Column:
    found = F.regexp_extract_all(packed, F.lit("([0-9]+[a-z])"), F.lit(1))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, "[0-9]+", 0).cast("int").alias("pos"), F.substring(m, -1, 1).alias("kind")))


def total_dropout(dropout: Column, decay: Column, years: Column) -> Column:
    return F.least(F.lit(0.99), dropout + decay * years)


def dropout_probability(gc: Column, base: Column, factor: Column) -> Column:
    return F.least(F.lit(0.99), F.greatest(F.lit(0.0), base + factor * F.abs(gc - 0.5) / 0.1))


def write_cost_per_mb(bits_per_base: Column, usd_per_base: Column) -> Column:
    return 8e6 / bits_per_base * usd_per_base


def read_cost_per_mb(bits_per_base: Column, length: Column, reads: Column, usd_per_read: Column) -> Column:
    return 8e6 / bits_per_base / length * reads * usd_per_read


def channels(s: Column, width: int) -> Column:
    """width structs of pos (from 0), a, c, g, t, mask (1 up to the strand's end) and place (0 at the first letter, 1 at the last; 0 behind the end)."""

    def one(i: Column) -> Column:
        inside = i < F.length(s)
        letters = [(F.substr(s, i + 1, F.lit(1)) == b).cast("int").alias(b.lower()) for b in BASES]
        return F.struct(i.alias("pos"), *letters, inside.cast("int").alias("mask"), F.when(inside, i / F.greatest(F.lit(1), F.length(s) - 1)).otherwise(0.0).alias("place"))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), one)


def distance_within(a: Column, b: Column, most: Column) -> Column:
    """Edit distance where it is at most most, else most + 1. Spark's bounded distance takes a constant only, so lengths that differ by more are told apart first."""
    return F.when(F.abs(F.length(a) - F.length(b)) > most, most + 1).otherwise(F.least(F.levenshtein(a, b), most + 1))
