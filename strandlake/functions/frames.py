"""Strands that carry a seed, a checksum and a value, as column functions: building them, and parsing them with a reason where they are rejected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.strands import BASES, bases_to_hex, hex_to_bases, uniform

#: The checksum's polynomial, what it starts from; bytes of a seed and of the checksum.
POLYNOMIAL, START, SEED_BYTES, CHECK_BYTES = 0x1021, 0xFFFF, 4, 2


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it (also within lambdas, where Spark computes a common expression each time)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _table() -> list[int]:
    out = []
    for b in range(256):
        r = b << 8
        for _ in range(8):
            r = (r << 1 ^ POLYNOMIAL if r & 0x8000 else r << 1) & 0xFFFF
        out.append(r)
    return out


def crc16(data: Column) -> Column:
    """CRC-16 of the bytes of a binary column (polynomial 0x1021, from 0xFFFF, not reflected): a fold over the bytes with a table of 256 remainders. Null gives null."""
    remainders = F.array(*map(F.lit, _table()))
    # bytes as numbers: two hexadecimal digits each, cut by one expression
    digits = F.regexp_extract_all(F.hex(data), F.lit("[0-9A-F]{2}"), F.lit(0))

    def step(crc: Column, pair: Column) -> Column:
        place = F.shiftright(crc, 8).bitwiseXOR(F.conv(pair, 16, 10).cast("int"))
        return F.shiftleft(crc, 8).bitwiseAND(0xFFFF).bitwiseXOR(F.get(remainders, place))

    return F.aggregate(digits, F.lit(START), step)


def xor_hex(a: Column, b: Column) -> Column:
    """Exclusive or of two hexadecimal strings of equal length, in lower case, fourteen digits at a time."""
    parts = [F.regexp_extract_all(s, F.lit("[0-9A-Fa-f]{1,14}"), F.lit(0)) for s in (a, b)]

    def limb(x: Column, y: Column) -> Column:
        value = F.conv(x, 16, 10).cast("bigint").bitwiseXOR(F.conv(y, 16, 10).cast("bigint"))
        return F.lpad(F.lower(F.hex(value)), F.length(x), F.lit("0"))

    return F.array_join(F.zip_with(*parts, limb), "")


def _mask(seed: Column, digits: int) -> Column:
    """So many hexadecimal digits that depend on the seed: what whitens a frame's checksum and value, so that equal values under other seeds look different."""
    blocks = [F.md5(F.concat_ws("|", seed, F.lit(str(i))).cast("binary")) for i in range(-(-digits // 32))]
    return F.substring(F.concat(*blocks), 1, digits)


def framed(seed: Column, value: Column, size: int) -> Column:
    """The strand of a seed (a number below 2^32) and a value of so many bytes, given in hexadecimal digits."""
    head = F.lpad(F.lower(F.hex(seed.cast("bigint"))), 2 * SEED_BYTES, "0")
    check = F.lpad(F.lower(F.hex(crc16(F.unhex(F.concat(head, value))).cast("bigint"))), 2 * CHECK_BYTES, "0")
    return let(F.concat(head, xor_hex(F.concat(check, value), _mask(seed, 2 * (CHECK_BYTES + size)))), hex_to_bases)


def parsed(strand: Column, size: int, seeds: int) -> Column:
    """struct(reason, seed, value) of a strand: reason is null, and seed and value (hexadecimal) are there, where it is well formed.

    Else the first that holds of: length (not that of a value of so many bytes; a null strand too), letter (one that is no base), seed (not below seeds), checksum.
    """
    right = F.length(strand) == 4 * (SEED_BYTES + CHECK_BYTES + size)
    plain = F.length(F.translate(strand, BASES, "")) == 0
    nothing = F.lit(None)

    def told(reason: Column, seed: Column = nothing, value: Column = nothing) -> Column:
        return F.struct(reason.cast("string").alias("reason"), seed.cast("bigint").alias("seed"), value.cast("string").alias("value"))

    def opened(h: Column) -> Column:
        head = F.substring(h, 1, 2 * SEED_BYTES)
        return let(F.conv(head, 16, 10).cast("bigint"), lambda seed: F.when(seed >= seeds, told(F.lit("seed"))).otherwise(checked(h, head, seed)))

    def checked(h: Column, head: Column, seed: Column) -> Column:
        rest = xor_hex(F.substring(h, 2 * SEED_BYTES + 1, 2 * (CHECK_BYTES + size)), _mask(seed, 2 * (CHECK_BYTES + size)))

        def compared(r: Column) -> Column:
            value = F.substring(r, 2 * CHECK_BYTES + 1, 2 * size)
            agrees = crc16(F.unhex(F.concat(head, value))) == F.conv(F.substring(r, 1, 2 * CHECK_BYTES), 16, 10).cast("int")
            return F.when(agrees, told(nothing, seed, value)).otherwise(told(F.lit("checksum")))

        return let(rest, compared)

    return F.when(F.coalesce(right, F.lit(False)), F.when(plain, let(bases_to_hex(strand), opened)).otherwise(told(F.lit("letter")))).otherwise(told(F.lit("length")))


def first_reaching(cdf: Column, u: Column) -> Column:
    """Place (from 1) of the first of rising numbers that is not below u, the last place if none is: by halving."""
    return let(u, lambda drawn: _first_reaching(cdf, drawn))


def _first_reaching(cdf: Column, drawn: Column) -> Column:
    n = F.size(cdf)
    halves = F.sequence(F.lit(1), F.ceil(F.log2(n.cast("double"))).cast("int") + 1)
    start = F.struct(F.lit(0).alias("lo"), (n - 1).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        below = F.get(cdf, mid) < drawn
        return F.struct(F.when(below & (s.lo < s.hi), mid + 1).otherwise(s.lo).alias("lo"), F.when(below, s.hi).otherwise(mid).alias("hi"))

    return F.aggregate(halves, start, halve, lambda s: s.lo + 1)


def neighbours(seed: Column, n: Column, cdf: Column) -> Column:
    """The chunks (of 0 to n - 1, ascending) that a seed joins: a degree by the distribution's inverse, then so many different chunks by draws without replacement.

    Each step draws from one more chunk than the step before and takes that last one where the drawn one is taken already, so no draw is repeated. Draws are keyed by seed, n and step.
    """
    degree = F.least(first_reaching(cdf, uniform(seed, n, "degree")), n)

    def draw(chosen: Column, j: Column) -> Column:
        return let(F.floor(uniform(seed, n, j) * (j + 1)).cast("int"), lambda t: F.array_append(chosen, F.when(F.array_contains(chosen, t), j).otherwise(t)))

    return F.array_sort(let(degree, lambda d: F.aggregate(F.sequence(n - d, n - 1), F.array().cast("array<int>"), draw)))
