"""Fountain codec: bytes to strands and back, through an erasure code over bits.

A payload is cut into chunks of equal length. Each strand carries the exclusive or of a few chunks that its seed chooses, the seed, and a checksum; enough
strands, whichever they are, give the chunks back by peeling and, where that stops, elimination. Strands are rows: encoding is a generated
table joined with the chunks and aggregated; recovery groups by file, whose strands one task solves.
"""

from __future__ import annotations

import hashlib
import zlib
from binascii import crc_hqx
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.strands import BASES, passes_rules
from strandlake.sources.scratch import written

#: Parameters of the degree distribution, bytes of a seed and of its checksum.
C, DELTA, SEED_BYTES, CHECK_BYTES = 0.1, 0.5, 4, 2
#: Seeds that a slot tries before the rules count as too strict.
MOST_TRIES = 20000


def soliton_weights(n: int, c: float = C, delta: float = DELTA) -> list[float]:
    """Cumulative robust soliton distribution over degrees 1 to n; the last is 1."""
    r = c * log(n / delta) * sqrt(n)
    pivot = min(n, max(1, round(n / r))) if r > 0 else n
    weights = []
    for d in range(1, n + 1):
        ideal = 1 / n if d == 1 else 1 / (d * (d - 1))
        extra = r / (d * n) if d < pivot else max(0.0, r * log(r / delta) / n) if d == pivot and r > 0 else 0.0
        weights.append(ideal + extra)
    total, seen, out = sum(weights), 0.0, []
    for w in weights:
        seen += w
        out.append(seen / total)
    out[-1] = 1.0
    return out


def soliton_table(sizes: DataFrame) -> DataFrame:
    """(n, cdf) for each number of chunks of sizes (n): the cumulative distribution over degrees 1 to n, to nine places."""
    n, d = F.col("n").cast("double"), F.col("d")
    p = sizes.withColumn("s", C * F.log(n / DELTA) * F.sqrt(n)).withColumn("d", F.explode(F.sequence(F.lit(1), F.col("n"))))
    pivot = F.least(n, F.greatest(F.lit(1.0), F.rint(n / F.col("s"))))
    ideal = F.when(d == 1, 1 / n).otherwise(1 / F.nullif(d * (d - 1), F.lit(0)))
    extra = F.when(d < pivot, F.col("s") / (d * n)).when(d == pivot, F.greatest(F.lit(0.0), F.col("s") * F.log(F.col("s") / DELTA) / n)).otherwise(0.0)
    by = Window.partitionBy("n")
    w = p.withColumn("w", ideal + extra).select("n", "d", F.round(F.sum("w").over(by.orderBy("d")) / F.sum("w").over(by), 9).alias("c"))
    return w.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda x: x.c).alias("cdf"))


_weights = lru_cache(maxsize=64)(soliton_weights)


def chunks_of_seed(seed: int, n: int) -> list[int]:
    """Chunks that a seed joins: a degree by the distribution and so many distinct chunks, all from a keyed hash."""
    stream = int.from_bytes(hashlib.blake2b(seed.to_bytes(SEED_BYTES, "big") + n.to_bytes(4, "big"), digest_size=64).digest(), "big")
    stream, u = divmod(stream, 1 << 32)
    degree = bisect_left(_weights(n), (u + 1) / 2**32) + 1
    picked: set[int] = set()
    state = stream
    while len(picked) < degree:
        if state < n << 32:
            state = int.from_bytes(hashlib.blake2b(f"{seed}:{n}:{len(picked)}:{state}".encode(), digest_size=64).digest(), "big")
        state, i = divmod(state, n)
        picked.add(i)
    return sorted(picked)


def to_strand(seed: int, value: bytes) -> str:
    head = seed.to_bytes(SEED_BYTES, "big")
    data = _mask(head, b"whiten") + _mask(crc_hqx(head + value, 0xFFFF).to_bytes(CHECK_BYTES, "big") + value, b"whiten" + head)
    return "".join(BASES[b >> s & 3] for b in data for s in (6, 4, 2, 0))


def from_strand(strand: str | None, size: int) -> tuple[int, bytes] | None:
    """Seed and value; None for a wrong length, a foreign letter or a wrong checksum."""
    if strand is None or len(strand) != 4 * (SEED_BYTES + CHECK_BYTES + size) or strand.strip(BASES):
        return None
    if any(c not in BASES for c in strand):
        return None
    digits = [BASES.index(c) for c in strand]
    data = bytes(digits[i] << 6 | digits[i + 1] << 4 | digits[i + 2] << 2 | digits[i + 3] for i in range(0, len(digits), 4))
    head = _mask(data[:SEED_BYTES], b"whiten")
    rest = _mask(data[SEED_BYTES:], b"whiten" + head)
    check, value = rest[:CHECK_BYTES], rest[CHECK_BYTES:]
    return (int.from_bytes(head, "big"), value) if crc_hqx(head + value, 0xFFFF) == int.from_bytes(check, "big") else None


def _mask(data: bytes, key: bytes) -> bytes:
    """Whitening, its own inverse. What follows a seed is whitened by it, so that each try is another strand even where all carry one chunk."""
    key = hashlib.shake_128(key).digest(len(data))
    return bytes(a ^ b for a, b in zip(data, key))


def solve(equations: dict[int, bytes], n: int, size: int) -> list[bytes] | None:
    """Values of n chunks from equations (seed: exclusive or of its chunks); None if they don't determine all."""
    rows = [(set(chunks_of_seed(s, n)), int.from_bytes(v, "big")) for s, v in sorted(equations.items())]
    using: dict[int, set[int]] = {}
    for i, (cs, _) in enumerate(rows):
        for c in cs:
            using.setdefault(c, set()).add(i)
    known: dict[int, int] = {}
    todo = [i for i, (cs, _) in enumerate(rows) if len(cs) == 1]
    while todo:
        cs, v = rows[todo.pop()]
        if len(cs) != 1:
            continue
        (c,) = cs
        known[c] = v
        for j in using[c]:
            other, w = rows[j]
            if c in other:
                other.discard(c)
                rows[j] = (other, w ^ v)
                if len(other) == 1:
                    todo.append(j)
    if len(known) < n:
        pivots: dict[int, tuple[int, int]] = {}
        for cs, v in sorted(((sum(1 << c for c in cs), v) for cs, v in rows if cs), key=lambda r: r[0].bit_count()):
            while cs and (top := cs.bit_length() - 1) in pivots:
                cs, v = cs ^ pivots[top][0], v ^ pivots[top][1]
            if cs:
                pivots[cs.bit_length() - 1] = (cs, v)
        for top in sorted(pivots):
            cs, v = pivots[top]
            rest = cs ^ 1 << top
            while rest:
                c = rest.bit_length() - 1
                if c not in known:
                    return None
                v, rest = v ^ known[c], rest ^ 1 << c
            known[top] = v
    return [known[c].to_bytes(size, "big") for c in range(n)] if len(known) == n else None


def chunked(files: DataFrame, size: int) -> DataFrame:
    """(file_id, n_chunks, n_bytes, chunk, value) of files (file_id, content): a checksum, the content, zeros to a whole chunk."""
    # cut by one expression, so that the work grows with the file
    framed = F.concat(F.lpad(F.hex(F.crc32("content")), 8, "0"), F.hex("content"))
    parts = F.transform(F.regexp_extract_all(framed, F.lit(f"[0-9A-F]{{1,{2 * size}}}"), F.lit(0)), lambda h: F.unhex(F.rpad(h, 2 * size, "0")))
    n = F.octet_length("content")
    return files.select("file_id", F.ceil((n + 4) / size).cast("int").alias("n_chunks"), n.alias("n_bytes"), F.posexplode(parts).alias("chunk", "value"))


def encode(files: DataFrame, size: int = 20, redundancy: float = 0.5, tries: int = 8, max_homopolymer: int | None = None, gc_min: float | None = None, gc_max: float | None = None) -> DataFrame:
    """(file_id, n_chunks, n_bytes, slot, seed, strand): ceil(n_chunks * (1 + redundancy)) strands for each file; all keep the rules, and together they
    give the file back.

    Each slot takes the first seed whose strand keeps the rules. It tries so many seeds; slots without a strand try twice as many new ones, and so on.
    Where a file's strands don't determine its chunks, strands that add nothing are exchanged for those of new seeds. A ValueError after MOST_TRIES.
    Rounds run, and are written to the shared folder, when this is called.
    """
    chunks = chunked(files, size)
    plan = chunks.select("file_id", "n_chunks", "n_bytes").distinct()
    n_slots = F.ceil(F.col("n_chunks") * (1 + redundancy)).cast("int")
    ok = passes_rules(F.col("strand"), max_homopolymer, gc_min, gc_max)
    left = plan.withColumn("slot", F.explode(F.sequence(F.lit(0), n_slots - 1)))
    done, before, n = None, 0, tries
    while True:
        best = written(_first_strands(left, chunks, size, n_slots, before, n, ok), "strands")
        good = best.where("bad = 0").drop("bad")
        done = good if done is None else done.union(good)
        before += n
        again = best.where("bad = 1").select("file_id", "slot")
        n_again, n = again.count(), 2 * n
        if not n_again:
            again = written(_redundant(done.join(plan, "file_id")), "redundant")
            n_again, n = again.count(), tries
            if not n_again:
                return done.join(plan, "file_id").select("file_id", "n_chunks", "n_bytes", "slot", "seed", "strand")
            done = written(done.join(again, ["file_id", "slot"], "left_anti"), "strands")
        if before >= MOST_TRIES:
            raise ValueError(f"{n_again} strands don't keep the rules, or add nothing, in {MOST_TRIES} tries (max_homopolymer={max_homopolymer}, gc_min={gc_min}, gc_max={gc_max}): too strict")
        left, n = again.join(plan, "file_id"), min(n, MOST_TRIES - before)


def redundant(seeds: list[int], n: int) -> list[int]:
    """Places of strands that add nothing to the others, as many as these lack to determine all n chunks."""
    if solve(dict.fromkeys(seeds, b""), n, 0) is not None:
        return []
    pivots: dict[int, int] = {}
    idle = []
    for i, s in enumerate(seeds):
        cs = sum(1 << c for c in chunks_of_seed(s, n))
        while cs and (top := cs.bit_length() - 1) in pivots:
            cs ^= pivots[top]
        if cs:
            pivots[top] = cs
        else:
            idle.append(i)
    return idle[: n - len(pivots)]


def _redundant(strands: DataFrame) -> DataFrame:
    """(file_id, slot) of strands (file_id, n_chunks, slot, seed) to exchange; a file's seeds meet in one task, as its strands do in recover()."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("slot").reset_index(drop=True)
        return g.loc[redundant(g["seed"].tolist(), int(g["n_chunks"].iloc[0])), ["file_id", "slot"]]

    file_type = dict(strands.dtypes)["file_id"]
    return strands.select("file_id", "n_chunks", "slot", "seed").groupBy("file_id").applyInPandas(run, f"file_id {file_type}, slot int")


def _first_strands(slots: DataFrame, chunks: DataFrame, size: int, n_slots: Column, before: int, tries: int, ok: Column) -> DataFrame:
    """(file_id, slot, bad, seed, strand): of the next so many seeds of each slot, after so many before, the first whose strand is ok; bad is 1 where none is."""
    attempts = slots.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    seeds = attempts.withColumn("seed", n_slots.cast("long") * before + F.col("slot").cast("long") * tries + F.col("attempt"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, chunk = [], []
            for i, (s, n) in enumerate(zip(b.column("seed").to_pylist(), b.column("n_chunks").to_pylist())):
                cs = chunks_of_seed(s, n)
                row += [i] * len(cs)
                chunk += cs
            t = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([t.column("file_id"), t.column("seed"), pa.array(chunk, pa.int32())], names=["file_id", "seed", "chunk"])

    file_type = dict(slots.dtypes)["file_id"]
    graph = seeds.select("file_id", "seed", "n_chunks").mapInArrow(edges, f"file_id {file_type}, seed long, chunk int")
    # values as 64-bit limbs, so that the exclusive or is an aggregate of Spark's
    limbs = range(0, size, 7)
    joined = graph.join(chunks.select("file_id", "chunk", *(F.conv(F.hex(F.substring("value", i + 1, 7)), 16, 10).cast("long").alias(f"l{i}") for i in limbs)), ["file_id", "chunk"])
    sums = joined.groupBy("file_id", "seed").agg(*(F.bit_xor(f"l{i}").alias(f"l{i}") for i in limbs))
    value = F.unhex(F.concat(*(F.lpad(F.hex(f"l{i}"), 2 * min(7, size - i), "0") for i in limbs)))

    def strands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [to_strand(s, v) for s, v in zip(b.column("seed").to_pylist(), b.column("value").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("seed"), pa.array(out, pa.string())], names=["file_id", "seed", "strand"])

    made = sums.select("file_id", "seed", value.alias("value")).mapInArrow(strands, f"file_id {file_type}, seed long, strand string")
    slot = F.floor((F.col("seed") - n_slots.cast("long") * before) / tries).cast("int")
    made = made.join(chunks.select("file_id", "n_chunks").distinct(), "file_id").withColumn("slot", slot)
    ranked = made.groupBy("file_id", "slot").agg(F.min(F.struct((~ok).cast("int").alias("bad"), "seed", "strand")).alias("b"))
    return ranked.select("file_id", "slot", "b.bad", "b.seed", "b.strand")


def recover_bytes(strands: list[str | None], n_chunks: int, n_bytes: int, size: int) -> bytes | None:
    """A file from its strands; None if it is not exactly the one encoded. Damaged strands drop out by their checksum, the first copy of a seed counts."""
    equations: dict[int, bytes] = {}
    for s in strands:
        if (got := from_strand(s, size)) is not None:
            equations.setdefault(*got)
    chunks = solve(equations, n_chunks, size)
    if chunks is None:
        return None
    data = b"".join(chunks)[: 4 + n_bytes]
    return data[4:] if zlib.crc32(data[4:]) == int.from_bytes(data[:4], "big") else None


def recover(strands: DataFrame, size: int = 20) -> DataFrame:
    """(file_id, content) for each file of strands (file_id, n_chunks, n_bytes, slot, strand); content is null where a file can't be had back exactly.

    A file's strands meet in one task: files are of bounded size by the codec's seed space, and large payloads are cut into files first.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("slot")
        out = recover_bytes(list(g["strand"]), int(g["n_chunks"].iloc[0]), int(g["n_bytes"].iloc[0]), size)
        return pd.DataFrame({"file_id": [g["file_id"].iloc[0]], "content": [out]})

    file_type = dict(strands.dtypes)["file_id"]
    return strands.select("file_id", "n_chunks", "n_bytes", "slot", "strand").groupBy("file_id").applyInPandas(run, f"file_id {file_type}, content binary")


def peel(edges: DataFrame) -> DataFrame:
    """(chunk, round) of the chunks that peeling frees in each round, from edges (eq, chunk): an equation with one unknown chunk gives it.

    Each round is an aggregate and a join over what is left of all systems at once, written to the shared folder; a round that frees nothing is the last.
    """
    freed, left, r = None, written(edges.distinct(), "edges"), 1
    while True:
        single = left.groupBy("eq").agg(F.count("*").alias("n"), F.min("chunk").alias("chunk")).where("n = 1").select("chunk").distinct()
        found = written(single.withColumn("round", F.lit(r)), "freed")
        freed = found if freed is None else freed.union(found)
        if not found.limit(1).count():
            return freed
        left, r = written(left.join(found, "chunk", "left_anti"), "edges"), r + 1
