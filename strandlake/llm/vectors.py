"""Near-duplicate vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the pairs of codes are the cells of a grid. A vector visits cells in the order of
its distance to them (the sum over both halves) until as many are seen as reach the target recall, and what is in them with the same
label is verified by cosine in double precision.

The codebooks are trained on a bounded sample that grows with the number of codes; all vectors are indexed and all are queries. The number of cells to visit is measured on
other sampled vectors, which the codebooks were not fitted to, against brute force: for each a partner at exactly the least similarity, the hardest case, is drawn.

Equal vectors of a label are one class. Classes meet in tasks of (label, first code), in blocks of bounded size on both sides, so a dense group
is spread over many tasks; a task returns counts, and a spanning forest in place of all links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import connected_components, stage, unstage

#: Codes of a half, at most: an eighth of the square root of the number of vectors up to there (some 64 vectors to a cell), which 268 million reach.
CODES = 2048
#: Sampled vectors the codebooks are trained on: so many for each code, and at least; those that visits are measured on; passes; share of the hardest pairs that the visited cells hold.
PER_CODE, LEAST, HELD_OUT, PASSES, RECALL = 40, 4096, 4096, 12, 0.97
#: Most rows of one block of members, and of visitors.
MEMBERS, VISITORS = 2048, 4096


def codebook(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of k-means over the rows of h."""
    rng = np.random.default_rng(seed)
    c = h[rng.choice(len(h), min(k, len(h)), replace=False)]
    for _ in range(PASSES):
        near = np.concatenate([((c**2).sum(1) - 2 * h[at : at + VISITORS] @ c.T).argmin(1) for at in range(0, len(h), VISITORS)])
        n = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, column, len(c)) for column in h.T], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def codes_for(count: int) -> int:
    """Codes of each half for so many vectors."""
    return int(min(CODES, max(2, 2 ** np.ceil(np.log2(max(2.0, np.sqrt(count) / 8))))))


def sample_rows(count: int) -> int:
    """Vectors to draw for an index of so many."""
    return max(LEAST, PER_CODE * codes_for(count)) + HELD_OUT


class Index:
    """Codebooks for two halves, and how many cells a query visits. Of the sample a part trains the codebooks, the rest (at most HELD_OUT, a third) tells the visits."""

    def __init__(self, sample: np.ndarray, count: int, least: float, seed: int = 11):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.half = max(1, x.shape[1] // 2)
        rng = np.random.default_rng(seed)
        held = min(HELD_OUT, len(x) // 3)
        apart = rng.permutation(len(x))
        fresh, fitted = (x[apart[:held]] if held else x), x[apart[held:]]
        self.books = [codebook(h, codes_for(count), seed + i) for i, h in enumerate((fitted[:, : self.half], fitted[:, self.half :]))]
        u = rng.normal(size=fresh.shape)
        u -= (u * fresh).sum(1, keepdims=True) * fresh
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
        rank = []
        for at in range(0, len(fresh), 1024):
            v = fresh[at : at + 1024]
            a, b = self.distances(v), [d.argmin(1) for d in self.distances(least * v + np.sqrt(1 - least**2) * u[at : at + 1024])]
            r = np.arange(len(v))
            own = a[0][r, b[0]] + a[1][r, b[1]]
            # cells that are nearer than the partner's: for each code of one half, those of the other within what is left
            rank += [np.searchsorted(np.sort(q), o - p).sum() + 1 for p, q, o in zip(a[0], a[1], own)]
        self.visits = int(np.quantile(rank, RECALL, method="higher"))

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [(c**2).sum(1) - 2 * h @ c.T for h, c in zip((x[:, : self.half], x[:, self.half :]), self.books)]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cell of each unit vector, and the nearest cells in no order.

        Multi-sequence traversal: with both lists of codes sorted by distance, the cell at places (a, b) comes after all that are at or before a and b
        in both, so the first t cells have (a + 1) * (b + 1) <= t.
        """
        d = self.distances(x)
        order = [v.argsort(1) for v in d]
        t = min(self.visits, d[0].shape[1] * d[1].shape[1])
        rows = np.minimum(t // np.arange(1, min(t, d[0].shape[1]) + 1), d[1].shape[1])
        a = np.repeat(np.arange(len(rows)), rows)
        b = np.arange(len(a)) - np.repeat(np.cumsum(rows) - rows, rows)
        i, j = order[0][:, a], order[1][:, b]
        total = np.take_along_axis(d[0], i, 1) + np.take_along_axis(d[1], j, 1)
        pick = np.argpartition(total, t - 1, axis=1)[:, :t] if total.shape[1] > t else np.tile(np.arange(total.shape[1]), (len(x), 1))
        width = len(self.books[1])
        cells = np.take_along_axis(i, pick, 1) * width + np.take_along_axis(j, pick, 1)
        return order[0][:, 0] * width + order[1][:, 0], cells


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for nodes of links a - b that aren't the smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    low = np.arange(len(nodes))
    while True:
        m = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == low).all():
            return nodes[low != np.arange(len(low))], nodes[low[low != np.arange(len(low))]]
        low = new


def _meet(width: int, least: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        q, m = g[g["visits"]], g[~g["visits"]]
        out = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64"), "n": pd.Series(dtype="int64")})
        if not len(q) or not len(m):
            return out
        unit = [np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (q, m)]
        unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in unit]
        q_id, m_id = q["id"].to_numpy(), m["id"].to_numpy()
        q_n, m_n = q["n"].to_numpy(), m["n"].to_numpy()
        q_cell, m_cell = q["cell"].to_numpy(), m["cell"].to_numpy()
        q_all, m_all = np.stack(q["cells"].to_numpy()), np.stack(m["cells"].to_numpy())
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for cell in np.unique(m_cell):
            members, visitors = np.flatnonzero(m_cell == cell), np.flatnonzero((q_all == cell).any(1))
            for part in range(0, len(visitors), 512):
                v = visitors[part : part + 512]
                i, j = np.nonzero(unit[0][v] @ unit[1][members].T >= least)
                i, j = v[i], members[j]
                other = q_id[i] != m_id[j]
                if other.any():
                    found.append((i[other], j[other]))
        if not found:
            return out
        i, j = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        mutual = np.concatenate([(m_all[j[k : k + 65536]] == q_cell[i[k : k + 65536], None]).any(1) for k in range(0, len(i), 65536)])
        mine = np.bincount(i, m_n[j], len(q_id))
        theirs = np.bincount(j[~mutual], q_n[i[~mutual]], len(m_id))  # they don't visit this one, so it counts for them here
        a, b = _forest(q_id[i], m_id[j])
        ids = np.concatenate([q_id[mine > 0], m_id[theirs > 0], a])
        n = np.concatenate([mine[mine > 0], theirs[theirs > 0], np.zeros(len(a))]).astype(np.int64)
        return pd.DataFrame({"a": ids, "b": pd.array([None] * (len(ids) - len(a)) + b.tolist(), dtype="Int64"), "n": n})

    return run


def near_vectors(table: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of table (vec_id, embedding, label).

    Links: equal labels and cosine of at least least. Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components link
    with nothing, nor do rows without label or vec_id (a null vec_id has a null component and is kept). Very long vectors are compared whole. Repeated rows link with each other; a
    vec_id on several rows is one node. Doubles are compared as they are, and as long as given; other columns are not read, whatever their names. An empty table gives no rows. The
    result is a staged table.
    """
    kind = "array<double>" if "double" in dict(table.dtypes)["embedding"] else "array<float>"
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), F.col("label").cast("long"))
    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
    fine &= F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.where(fine)
    dims = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = [F.col("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    if dims is None:
        return rows.select(*out)
    good = good.where(F.size("embedding") == dims.d)
    classes = stage(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vectors")
    count = classes.count()
    # about twice the sample goes to the sort, so that what tasks send doesn't grow with their number
    rows_drawn = sample_rows(count)
    share = min(1.0, 2 * rows_drawn / max(1, count))
    drawn = classes.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    sample = drawn.select("embedding").orderBy(F.xxhash64("id", "label"), "id").limit(rows_drawn).toArrow().column("embedding").combine_chunks()
    index = Index(sample.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sample), -1), count, least)
    width = len(index.books[1])

    def place(batches):
        for p in batches:
            if len(p):
                x = np.stack(p["embedding"].to_numpy()).astype(np.float64)
                cell, cells = index.cells(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield p.assign(cell=cell, cells=list(cells))

    placed = stage(classes.mapInPandas(place, f"label long, embedding {kind}, id long, n long, cell long, cells array<long>"), "placed")
    first = F.floor(F.col("cell") / width)
    visits = placed.withColumn("i", F.explode(F.array_distinct(F.transform("cells", lambda c: F.floor(c / width))))).withColumn("visits", F.lit(True))
    members = placed.withColumn("i", first).withColumn("visits", F.lit(False))
    # how many blocks each (label, first code) has on both sides; small ones have one
    def blocks(side, most, name):
        return side.groupBy("label", "i").agg(F.ceil(F.count("*") / most).alias(name))

    # a table of its own, so that Spark can split a code of very many vectors in the joins
    size = stage(blocks(members, MEMBERS, "mb").join(blocks(visits, VISITORS, "vb"), ["label", "i"]), "blocks")
    both = visits.join(size, ["label", "i"]).withColumn("v", F.pmod(F.xxhash64("id"), "vb")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    both = both.unionByName(members.join(size, ["label", "i"]).withColumn("m", F.pmod(F.xxhash64("id", F.lit(1)), "mb")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))))
    met = stage(both.select("label", "i", "v", "m", "visits", "id", "n", "embedding", "cell", "cells").groupBy("label", "i", "v", "m").applyInPandas(_meet(width, least), "a long, b long, n long"), "met")
    links = met.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    parts = connected_components(met.where("b is not null").select("a", "b").union(classes_twice(good)))
    ids = classes.withColumnRenamed("n", "copies").join(links, F.col("id") == F.col("a"), "left").join(parts, F.col("id") == F.col("node"), "left")
    ids = ids.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    known = good.join(ids, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    rest = rows.where(~fine | (F.size("embedding") != dims.d)).select(*out)
    out = stage(known.union(rest), "near")
    for t in (classes, placed, size, met, parts):
        unstage(t)
    return out


def classes_twice(good: DataFrame) -> DataFrame:
    """Links (a, b) between a vec_id and its classes' smallest ones, for a vec_id on rows of several vectors."""
    reps = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("a"))
    several = good.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1")
    return good.join(several, "vec_id").join(reps, ["label", "embedding"]).where("a <> vec_id").select("a", F.col("vec_id").alias("b"))
