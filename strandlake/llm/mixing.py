"""Mixing sources to target weights by balanced sampling with the cube method.

A source with target t and size s takes every document floor(t / s) times, and once more with probability frac(t / s). Which documents
are taken once more is decided by the flight of the cube method: three undecided documents at a time move along the direction that
leaves both their expected number and their expected words as they are, until one of them is in or out. This runs in blocks of a
source, chosen by a hash of the row; at most two documents of a block stay undecided. These form new blocks, until a source has only
one: its last two are landed so that the words come nearest to the target, and exchanges bring them nearer while the number of documents stays
within one of what is expected.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import ordered_columns, plain, running_sums, stage, unstage, unused

#: Weights of sources in the order of their names, repeating (fixed values); a source's words are taken this often at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Undecided documents of one block; a task never holds more than a few such blocks.
BLOCK = 4096
#: Words, for sizes.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of the sources in sizes (source, source_size), as a staged table.

    Sources count in the order of their code points, null last. Words above MOST times a source's size go to the others by weight:
    with the sources in the order of size / weight, the capped ones are a prefix, and the level that the rest share follows from sums.
    """
    n = len(WEIGHTS)
    numbered = running_sums(sizes, [F.col("source").asc_nulls_first()], {"k": F.lit(1)})
    # null comes last, so those before it keep their numbers and it takes the last one
    nulls = sizes.agg(F.count_if(F.col("source").isNull()).alias("nulls"), F.count("*").alias("sources"))
    named = numbered.crossJoin(F.broadcast(nulls)).withColumn("k", F.when(F.col("source").isNull(), F.col("sources")).otherwise(F.col("k") - F.col("nulls"))).drop("nulls", "sources")  # one row
    named = named.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("k") - 1) % n + 1).cast("int")).cast("double")).withColumn("ratio", F.col("source_size") / F.col("w"))
    ran = running_sums(named, ["ratio", "k"], {"s_to": F.col("source_size"), "w_to": F.col("w")})
    all_ = ran.agg(F.sum("source_size").alias("total"), F.sum("w").alias("ws"))
    # the level if this source and those after it share what the capped ones before leave
    level = (F.col("total") - MOST * (F.col("s_to") - F.col("source_size"))) / (F.col("ws") - F.col("w_to") + F.col("w"))
    fits = F.col("w") * level <= MOST * F.col("source_size")
    first = ran.crossJoin(F.broadcast(all_)).agg(F.min(F.when(fits, F.struct("ratio", "k", level.alias("level")))).alias("first"))  # one row, as is the next
    out = ran.crossJoin(F.broadcast(first)).select("source", "source_size", F.least(F.col("w") * F.col("first.level"), MOST * F.col("source_size").cast("double")).alias("target"))
    out = stage(out, "targets")
    for t in (numbered, ran):
        unstage(t)
    return out


def flight(p: list[float], x: list[int], draw) -> list[float]:
    """Move probabilities p along directions that keep sum(p) and sum(p * x), until at most two are neither 0 nor 1."""
    eps = 1e-9
    p = list(p)
    open_ = []
    for i, v in enumerate(p):
        if not eps < v < 1 - eps:
            p[i] = float(v >= 0.5)
            continue
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = [float(x[b] - x[c]), float(x[c] - x[a]), float(x[a] - x[b])]
            if not any(u):
                u = [1.0, -1.0, 0.0]  # equal sizes: any exchange keeps both
            up = min((1 - p[j]) / d if d > 0 else p[j] / -d for j, d in zip(open_, u) if d)
            down = min(p[j] / d if d > 0 else (1 - p[j]) / -d for j, d in zip(open_, u) if d)
            step = up if draw() * (up + down) < down else -down
            for j, d in zip(open_, u):
                p[j] = min(1.0, max(0.0, p[j] + step * d))
            still = [j for j in open_ if eps < p[j] < 1 - eps]
            for j in open_:
                if j not in still:
                    p[j] = float(p[j] >= 0.5)
            open_ = still
    return p


def landing(p: list[float], x: list[int], words: float) -> list[float]:
    """Decide the last few undecided so that the total comes nearest to words; then exchange decisions until no exchange brings it nearer.

    An exchange takes one document for another, or takes or leaves a single one where the number of documents stays within one of sum(p)
    (or comes nearer to it), so that both totals are held: words as near as exchanges get them, documents to less than two.
    """
    undecided = [i for i, v in enumerate(p) if 0 < v < 1]
    number = sum(p)
    settled = [sum(p[i] * x[i] for i in range(len(p)) if i not in undecided), sum(v for i, v in enumerate(p) if i not in undecided)]

    def off(c):
        return abs(settled[0] + sum(v * x[i] for v, i in zip(c, undecided)) - words), abs(settled[1] + sum(c) - number), c

    taken = np.array(p)
    for i, v in zip(undecided, min(product((0, 1), repeat=len(undecided)), key=off)):
        taken[i] = v
    size = np.array(x, dtype=np.float64)
    order = np.argsort(size, kind="stable")
    over = float(taken @ size) - words
    while True:  # each exchange brings whole words
        inside, outside = order[taken[order] > 0], order[taken[order] == 0]
        more = len(inside) - number
        ways = []
        if len(inside) and abs(more - 1) <= max(1, abs(more)):
            ways.append(_nearest(over - size[inside], lambda k: [inside[k]]))
        if len(outside) and abs(more + 1) <= max(1, abs(more)):
            ways.append(_nearest(over + size[outside], lambda k: [outside[k]]))
        if len(inside) and len(outside):
            # for each document taken, the sizes on both sides of what would bring the total to words
            at = np.searchsorted(size[outside], size[inside] - over)
            for there in (np.maximum(at - 1, 0), np.minimum(at, len(outside) - 1)):
                ways.append(_nearest(over - size[inside] + size[outside[there]], lambda k, there=there: [inside[k], outside[there[k]]]))
        best, new, flips = min(ways, key=lambda w: w[0], default=(0.0, 0.0, None))
        if flips is None or best >= abs(over) - 1e-9:
            return taken.tolist()
        over = new
        taken[flips] = 1 - taken[flips]


def _nearest(totals: np.ndarray, flips) -> tuple:
    """(distance, total, documents to flip) of the total nearest to 0, the first on a tie."""
    k = int(np.argmin(np.abs(totals)))
    return abs(float(totals[k])), float(totals[k]), flips(k)


def _drawn(seed: int, key: str):
    """Uniform numbers that depend on seed and key only."""
    state = hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest()
    n = int.from_bytes(state, "big")

    def draw() -> float:
        nonlocal n
        n = (n * 6364136223846793005 + 1442695040888963407) % 2**64
        return (n >> 11) / 2**53

    return draw


def balanced_extra(units: DataFrame, seed: int = 7, staged: list | None = None) -> DataFrame:
    """(row, extra 0 or 1) for units (row, source, size, p): extra is 1 with probability p, balanced within each source.

    Rows with p of 0 or 1 are decided at once. row must be unique. staged: gets the tables that the result reads.
    """
    undecided = units.where("p > 0 and p < 1")
    done = units.where("not (p > 0 and p < 1)").select("row", F.col("p").alias("extra"))
    level = 0
    while True:
        counts = undecided.groupBy("source").agg(F.count("*").alias("n"))
        blocks = counts.select(F.col("source").alias("s"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
        keyed = undecided.join(blocks, F.col("source").eqNullSafe(F.col("s"))).withColumn("last", F.col("blocks") == 1)
        keyed = keyed.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed + level)), "blocks"))

        round_seed = seed + level

        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("row", ignore_index=True)
            order = sorted(range(len(g)), key=lambda i: hashlib.blake2b(f"{seed}:{g.row[i]}".encode(), digest_size=8).digest())
            p, x = [float(g.p[i]) for i in order], [int(g["size"][i]) for i in order]
            p = flight(p, x, _drawn(round_seed, f"{g.source[0]}:{g.block[0]}"))
            if g["last"][0]:
                p = landing(p, x, sum(float(g.p[i]) * s for i, s in zip(order, x)))
            return g.iloc[order].assign(p=p)[["row", "source", "size", "p"]]

        moved = stage(keyed.groupBy("source", "block").applyInPandas(run, "row string, source string, size long, p double"), "cube")
        if staged is not None:
            staged.append(moved)
        done = done.union(moved.where("p = 0 or p = 1").select("row", F.col("p").alias("extra")))
        undecided = moved.where("p > 0 and p < 1")
        level += 1
        if undecided.limit(1).count() == 0:
            return done.select("row", F.col("extra").cast("int").alias("extra"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, i for every row of docs (doc_id, text, source).

    size: words of the text (null: 0). taken: words the mix takes of the document, repeats counted, at most MOST times its size. Rows
    without words take 0. Equal rows may fare differently but are told apart by a counter, so that reruns agree; a null doc_id counts
    as an id; long texts count whole; other columns are not read, whatever their names. A table without words has targets of 0, an empty one no rows.
    The result is a staged table.
    """
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"))
    groups = stage(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    rows = groups.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    by = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(by)
    used = [groups, goal]
    goal = goal.withColumnRenamed("source", "s")
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("row", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "i", "size", F.coalesce("source", F.lit("\0null"))))
    whole = F.when(F.col("rate") - F.floor("rate") > 1 - 1e-9, F.ceil("rate")).otherwise(F.floor("rate"))
    part = F.when((F.col("rate") - whole) > 1e-9, F.col("rate") - whole).otherwise(0.0)
    rows = stage(rows.withColumn("whole", whole).withColumn("p", F.when(F.col("size") > 0, part).otherwise(0.0)), "rates")
    used.append(rows)
    extra = balanced_extra(rows.select("row", "source", "size", "p"), seed, used)
    copies = (F.col("whole") + F.col("extra")).cast("int")
    out = stage(rows.join(extra, "row").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), "source", "i"), "mix")
    for t in used:
        unstage(t)
    return out


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with its columns whatever their names; rows without words (null and empty texts among them) go.

    Of rows with equal doc_id, source and number of words, the mix decides for the first, second, ... in the order of their texts and then of their further columns (but
    for maps, which have no order). An empty table gives no rows.
    """
    words, nth, copy, *names = unused(docs, "words", "nth", "copy", "doc_id", "source", "size", "i", "copies")
    of_id, of_source, of_size, i, copies = names
    taken = mix(docs, seed).where("taken > 0").select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "source", "size", "i", "copies"), names)))
    same = Window.partitionBy("doc_id", "source", words).orderBy("text", *ordered_columns(docs))
    rows = docs.withColumn(words, word_count()).where(F.col(words) > 0).withColumn(nth, F.row_number().over(same))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & F.col("source").cast("string").eqNullSafe(F.col(of_source)) & (F.col(words) == F.col(of_size)) & (F.col(nth) == F.col(i))
    return rows.join(taken, match).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*plain(docs.columns))
