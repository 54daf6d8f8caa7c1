"""Numbers, settings and findings as text. Column functions only; a null number gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, places: int, signed: bool = False) -> Column:
    """x with so many decimals, halves to the even digit as the double's exact value has it; with its sign if asked."""
    digits = "0." + "0" * places if places else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(f"+{digits};-{digits}" if signed else digits))


def percent(x: Column) -> Column:
    return F.concat(fixed(x * 100, 0), F.lit("%"))


def small(x: Column) -> Column:
    """Two decimals from 0.01 on (and for 0), two significant digits below, as a power of ten below 0.0001."""
    power = F.lower(F.call_function("format_number", x.cast("double"), F.lit("0.#E00")))
    short = F.call_function("format_number", x.cast("double"), F.when(x < 9.95e-4, "0.#####").otherwise("0.####"))
    return F.when((x >= 0.01) | (x == 0), fixed(x, 2)).when(x < 9.95e-5, power).otherwise(short)


def gc_setting(low: Column, high: Column) -> Column:
    """Bounds of the G+C share; a null bound is open, two of them are no rule."""
    text = F.concat(F.coalesce(fixed(low * 100, 0), F.lit("0")), F.lit(" to "), F.coalesce(fixed(high * 100, 0), F.lit("100")), F.lit("%"))
    return F.when(low.isNull() & high.isNull(), "off").otherwise(text)


def share_setting(x: Column) -> Column:
    return F.coalesce(percent(x), F.lit("off"))


def risk_setting(x: Column) -> Column:
    return F.coalesce(F.concat(F.lit("risk ≤ "), small(x)), F.lit("off"))


def whole_setting(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("off"))


def changes(settings: list[tuple[str, Column, Column]]) -> Column:
    """What differs between old and new settings (label, old, new, as text), in order, as an array of phrases."""

    def phrase(label: str, old: Column, new: Column) -> Column:
        turned = F.when(new == "off", f"{label} switched off").when(old == "off", F.concat(F.lit(f"{label} on ("), new, F.lit(")")))
        return F.when(old != new, turned.otherwise(F.concat(F.lit(f"{label} "), old, F.lit(" → "), new)))

    return F.array_compact(F.array(*(phrase(*s) for s in settings)))


def rule_name(rule: Column) -> Column:
    """A rule's name in words; names of no known form stay."""
    part = lambda pattern, i=1: F.regexp_extract(rule, pattern, i)
    run, gc, spare = r"^\s*max_homopolymer\s*=\s*(\d+)\s*$", r"^\s*gc\s*([\d.]+)\s*-\s*([\d.]+)\s*$", r"^\s*redundancy\s*([\d.]+)\s*vs\s*tuned\s*$"
    share = lambda pattern, i=1: percent(F.try_to_number(part(pattern, i), F.lit("9999999999.999999")).cast("double"))
    out = F.when(rule.rlike(run), F.concat(F.lit("No run of more than "), part(run), F.lit(" identical letters")))
    out = out.when(rule.rlike(gc), F.concat(F.lit("G+C share between "), share(gc), F.lit(" and "), share(gc, 2)))
    out = out.when(rule.rlike(spare), F.concat(F.lit("Fixed "), share(spare), F.lit(" spare strands")))
    return out.when(rule.startswith("tuned codec"), F.concat(F.upper(F.substring(rule, 1, 1)), F.substr(rule, F.lit(2)))).otherwise(rule)


def reads_text(x: Column) -> Column:
    return F.coalesce(fixed(x, 1), F.lit("target not met"))


def rule_effect(rule: Column, on: Column, off: Column, bits_on: Column, bits_off: Column) -> Column:
    """What a rule costs and brings: reads with it and without (null: the target is never met), and bits per base where they differ by 0.005."""
    at = F.coalesce(F.concat(F.lit(" at "), fixed(bits_on, 2), F.lit(" bits per base")), F.lit(""))
    equal_density = F.concat(F.lit("Reads needed"), at, F.lit(": default rules "), reads_text(on), F.lit(", tuned codec "), reads_text(off))
    before = F.when(rule.contains("tuned"), "With the tuned value instead: ").otherwise("Switching this rule off: ")
    same = F.when(F.abs(on - off) < 0.05, F.concat(F.lit("reads needed stay at "), fixed(on, 1)))
    reads = F.coalesce(same, F.concat(F.lit("reads needed "), reads_text(on), F.lit(" to "), reads_text(off)))
    bits = F.when(F.abs(bits_on - bits_off) >= 0.005, F.concat(F.lit(", bits per base "), fixed(bits_on, 2), F.lit(" to "), fixed(bits_off, 2)))
    return F.when(rule.startswith("tuned codec"), equal_density).otherwise(F.concat(before, reads, F.coalesce(bits, F.lit(""))))


def trade(channel: Column, name: Column, reads: Column, bits: Column, other: Column, other_reads: Column, other_bits: Column) -> Column:
    """A sentence on one codec against another on a channel: reads (null: the target is never met) and density together, joined by what they say of it."""
    same = F.abs(reads - other_reads) < 0.05
    first = F.when(reads.isNull(), "never reaches the recovery target")
    first = first.when(other_reads.isNull(), F.concat(F.lit("reaches the target at "), fixed(reads, 1), F.lit(" reads where "), other, F.lit(" never does")))
    first = first.when(same, F.concat(F.lit("needs the same "), fixed(reads, 1), F.lit(" reads as "), other))
    first = first.otherwise(F.concat(F.lit("needs "), fixed(reads, 1), F.lit(" reads instead of "), fixed(other_reads, 1)))
    fewer = F.when(reads.isNull(), False).when(other_reads.isNull(), True).when(~same, reads < other_reads)
    ratio = F.when(other_bits != 0, bits / other_bits - 1)
    even = F.abs(ratio) < 0.01
    figures = F.concat(F.lit(" per letter ("), fixed(bits, 2), F.lit(" vs "), fixed(other_bits, 2), F.lit(" bits per base)"))
    second = F.when(even, "at the same density").otherwise(F.concat(F.lit("stores "), percent(F.abs(ratio)), F.when(ratio > 0, " more").otherwise(" less"), figures))
    denser = F.when(~even, ratio > 0)
    joint = F.when(F.coalesce(fewer != denser, F.lit(False)), " but ").otherwise(" and ")
    return F.concat(F.lit("On "), channel, F.lit(", "), name, F.lit(" "), first, F.coalesce(F.concat(joint, second), F.lit("")), F.lit("."))


def paired_finding(diff: Column, low: Column, high: Column) -> Column:
    """A sentence on a paired difference in failures (shares) and its interval, whose ends may come in either order."""
    low, high = F.least(low, high) * 100, F.greatest(low, high) * 100
    ends = lambda a, b, signed=False: F.concat(F.lit(" (95% CI "), fixed(a, 2, signed), F.lit(" to "), fixed(b, 2, signed), F.lit(" points)."))
    moved = lambda verb, by: F.concat(F.lit(f"The learned scorer {verb} strand failures by "), fixed(by, 2), F.lit(" points"))
    none = F.concat(F.lit("No measurable difference in strand failures"), ends(low, high, True))
    return F.when((low <= 0) & (high >= 0), none).when(high < 0, F.concat(moved("cuts", -diff * 100), ends(-high, -low))).otherwise(F.concat(moved("raises", diff * 100), ends(low, high)))


def stage_name(stage: Column, later: Column) -> Column:
    """Name of a step of a search by its stage; later: steps of its run from the second alternation on. Empty stages have none, others stay."""
    n = F.regexp_extract(F.trim(stage), r"^alternation\s*(\d+)$", 1)
    loop = F.when(later <= 1, "E: loop").otherwise(F.concat(F.lit("E: loop "), n.try_cast("int").cast("string")))
    named = F.when(F.trim(stage) == "tier1", "C: rules audited").when(n == "", F.trim(stage)).when(n.try_cast("int") == 0, "D: + learned").otherwise(loop)
    return F.when(F.trim(stage) != "", named)
