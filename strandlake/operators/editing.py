"""Fewest edits between strings: scripts for many pairs at once, as rows, and dense rows for every place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of the tables of costs that are filled together.
CELLS = 1 << 22
TAGS = ("replace", "delete", "insert")


def _codes(texts: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), np.uint32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return out


def _scripts(a: list[str], b: list[str]) -> tuple[np.ndarray, ...]:
    """(row, tag, place in a, place in b) of pairs of similar lengths, all tables filled together, a row of each at a time."""
    n, m = (np.array([len(x) for x in t]) for t in (a, b))
    x, y = _codes(a, max(1, n.max())), _codes(b, max(1, m.max()))
    cost = np.empty((n.max() + 1, len(a), m.max() + 1), np.int32)
    steps = np.arange(m.max() + 1, dtype=np.int32)
    cost[0] = steps
    for i in range(1, n.max() + 1):
        row = cost[i]
        row[:, 0] = i
        if m.max():
            np.minimum(cost[i - 1, :, 1:] + 1, cost[i - 1, :, :-1] + (y[:, : m.max()] != x[:, i - 1, None]), out=row[:, 1:])
        row -= steps
        np.minimum.accumulate(row, axis=1, out=row)  # insertions run along the row
        row += steps
    i, j, live = n.copy(), m.copy(), np.flatnonzero(n + m > 0)
    rows, tags, src, dest = [], [], [], []
    while len(live):
        u, v = i[live], j[live]
        here = cost[u, live, v]
        both = (u > 0) & (v > 0)
        differ = x[live, np.maximum(u, 1) - 1] != y[live, np.maximum(v, 1) - 1]
        slant = both & (here == cost[np.maximum(u, 1) - 1, live, np.maximum(v, 1) - 1] + differ)
        up = ~slant & (u > 0) & (here == cost[np.maximum(u, 1) - 1, live, v] + 1)
        u, v = u - (slant | up), v - (slant | ~up)
        i[live], j[live] = u, v
        edit = ~slant | differ
        rows.append(live[edit])
        tags.append(np.where(slant, 0, np.where(up, 1, 2))[edit])
        src.append(u[edit])
        dest.append(v[edit])
        live = live[(u > 0) | (v > 0)]
    cols = [np.concatenate(c[::-1]) if c else np.zeros(0, np.int64) for c in (rows, tags, src, dest)]
    order = np.argsort(cols[0], kind="stable")
    return tuple(c[order] for c in cols)


def edit_scripts(a: list[str], b: list[str]) -> tuple[np.ndarray, ...]:
    """(row, tag, place in a, place in b) for pairs of strings: the number of a pair and of a tag, in the order of pairs and places.

    Ties: a match or replacement before a deletion before an insertion, from the ends back. Pairs are taken by length, so that tables of similar size are filled together.
    """
    n, m = (np.array([len(x) for x in t], np.int64) for t in (a, b))
    order = np.lexsort((m, n))
    out, at = [], 0
    while at < len(order):
        stop, wide = at, 0
        while stop < len(order) and (stop == at or (stop - at + 1) * (n[order[stop]] + 1) * max(wide, m[order[stop]] + 1) <= CELLS):
            wide = max(wide, m[order[stop]] + 1)
            stop += 1
        part = order[at:stop]
        row, *rest = _scripts([a[i] for i in part], [b[i] for i in part])
        out.append((part[row], *rest))
        at = stop
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    cols = [np.concatenate(c) for c in zip(*out)]
    order = np.argsort(cols[0], kind="stable")
    return tuple(c[order] for c in cols)


def edit_script(a: str, b: str) -> list[tuple[str, int, int]]:
    """Fewest edits from a to b as (tag, place in a, place in b)."""
    _, tags, src, dest = edit_scripts([a], [b])
    return [(TAGS[t], int(s), int(d)) for t, s, d in zip(tags, src, dest)]


def edit_operations(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with a row for each edit (tag, src_pos, dest_pos) from column a to column b; equal pairs have none, nulls count as empty."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("tag", T.StringType()), T.StructField("src_pos", T.IntegerType()), T.StructField("dest_pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(TAGS)
        for batch in batches:
            row, tag, src, dest = edit_scripts(*(batch.column(c).fill_null("").to_pylist() for c in (a, b)))
            kept = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, names.take(pa.array(tag, pa.int64())), pa.array(src, pa.int32()), pa.array(dest, pa.int32())], names=[*batch.schema.names, "tag", "src_pos", "dest_pos"])

    return pairs.mapInArrow(run, schema)


def dense_classes(pairs: DataFrame, ops: DataFrame, by: list[str], a: str) -> DataFrame:
    """(by, pos, class, before) for every place of column a of pairs (by, a), from ops (by, tag, src_pos, letter) of their edits.

    class: = where the place is kept, the letter that replaces it, or - where it goes; before: the first letter that comes in before it, or null. The place after the last has
    class null, and before what comes in at the end. ops without edits of a pair leave it all =. A row for each place of each pair: strings of bounded length.
    """
    first = F.min_by(F.when(F.col("tag") == "insert", F.col("letter")), F.when(F.col("tag") == "insert", F.col("dest_pos")))
    said = F.max(F.when(F.col("tag") == "replace", F.col("letter")).when(F.col("tag") == "delete", F.lit("-")))
    met = ops.groupBy(*by, F.col("src_pos").alias("pos")).agg(said.alias("said"), first.alias("before"))
    places = pairs.select(*by, a).withColumn("pos", F.explode(F.sequence(F.lit(0), F.length(a))))
    joined = places.join(met, [*by, "pos"], "left")
    return joined.select(*by, "pos", F.when(F.col("pos") < F.length(a), F.coalesce("said", F.lit("="))).alias("class"), "before")
