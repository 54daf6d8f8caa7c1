"""Vector code compression: a vector is cut into equal parts, and each part is stored as the number of the nearest entry of its position's codebook.

Components are integers (floor(SCALE * x)), so assignments, sums and entries are exact and don't depend on partitions. Codebooks are trained on all vectors by
alternating assignment and averaging. Norm-of-sum bounds save most of the distances:

* The codebook of every round is retained. For each part of each vector and each group of entries there is a bound, a distance that no entry of
  the group but the part's own was nearer than in the round of the bound's stamp.
* In a later round an entry is nearer by at most its net displacement, the norm of the sum of its moves since the stamp: one difference of two retained entries. Bounds that
  are lowered by each round's drift lose the sum of the norms instead, which is never less (`drifted` measures that form).
* Only groups whose lowered bound reaches the exact distance to the own entry are scanned again, exactly; their bounds get the round's stamp.

Vectors and bounds lie in blocks of rows, a table in the shared folder for each round: a task sees one block at a time, and a lost executor costs that round's blocks. What
reaches the driver is sums and counts of entries (parts x entries, added up by Spark) and the first vectors that the codebooks start from.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import stage, unstage

#: Integers of a unit; parts of a vector; entries of a codebook; rounds of training.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Entries that share a bound; vectors of a block.
GROUP, BLOCK = 4, 2048
#: Components of at least this size are an error, as squares would leave 64 bits.
MOST = 1 << 15
#: What bounds give way to rounding of square roots, and of 32-bit storage.
SLACK, NARROW = 1e-12, 2.0**-23


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to integer entries."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(2)


def net(history: np.ndarray, now: int, group: int) -> np.ndarray:
    """[stamp, group]: most that an entry of the group has moved net from the stamp's round to now."""
    moved = np.sqrt(((history[now] - history[: now + 1]) ** 2).sum(2).astype(np.float64)) * (1 + SLACK)
    pad = -moved.shape[1] % group
    return np.pad(moved, ((0, 0), (0, pad))).reshape(now + 1, -1, group).max(2)


def drifted(history: np.ndarray, now: int, group: int) -> np.ndarray:
    """The same by accumulated drifts, the looser form: moves of each round added up. For comparison."""
    steps = np.sqrt(((history[1 : now + 1] - history[:now]) ** 2).sum(2).astype(np.float64))
    moved = np.concatenate([steps[::-1].cumsum(0)[::-1], np.zeros_like(history[:1, :, 0], np.float64)]) * (1 + SLACK)
    pad = -moved.shape[1] % group
    return np.pad(moved, ((0, 0), (0, pad))).reshape(now + 1, -1, group).max(2)


class Part:
    """One part position of a block: rows of integers, the entry each is assigned to, bounds and stamps by group, distances computed so far."""

    def __init__(self, x: np.ndarray, own: np.ndarray, bound: np.ndarray, stamp: np.ndarray):
        self.x, self.own, self.bound, self.stamp, self.scans = x, own, bound, stamp, np.zeros(len(x), np.int64)

    @classmethod
    def first(cls, x: np.ndarray, entries: np.ndarray, group: int) -> Part:
        n, groups = len(x), -(-len(entries) // group)
        p = cls(x, np.zeros(n, np.uint8), np.zeros((n, groups), np.float32), np.zeros((n, groups), np.uint8))
        p._scan(np.arange(n), np.ones((n, groups), bool), entries, 0, group)
        return p

    def _scan(self, rows: np.ndarray, open_: np.ndarray, entries: np.ndarray, now: int, group: int) -> None:
        """Exact distances of rows to the entries of their open groups; rows that change their entry have all groups scanned."""
        k = len(entries)
        wide = np.repeat(open_, group, 1)[:, :k]
        d = np.full((len(rows), k), np.iinfo(np.int64).max)
        i, j = np.nonzero(wide)
        d[i, j] = ((self.x[rows[i]] - entries[j]) ** 2).sum(1)
        r, mine = np.arange(len(rows)), self.own[rows].astype(np.int64)
        d[r, mine] = ((self.x[rows] - entries[mine]) ** 2).sum(1)
        self.scans[rows] += wide.sum(1)
        best = d.argmin(1)  # the lowest index of equal ones
        moved = best != mine
        again = np.flatnonzero(moved & ~open_.all(1))
        if len(again):
            d[again] = squared(self.x[rows[again]], entries)
            self.scans[rows[again]] += k
        open_ = open_ | moved[:, None]
        self.own[rows] = best
        d[r, best] = np.iinfo(np.int64).max
        low = np.pad(d, ((0, 0), (0, open_.shape[1] * group - k)), constant_values=np.iinfo(np.int64).max).reshape(len(rows), -1, group).min(2)
        low = (np.sqrt(low.astype(np.float64)) * (1 - NARROW)).astype(np.float32)
        self.bound[rows] = np.where(open_, low, self.bound[rows])
        self.stamp[rows] = np.where(open_, now, self.stamp[rows])

    def step(self, history: np.ndarray, now: int, group: int, moves=net) -> None:
        """Assign to the entries of round now, by bounds where they tell."""
        entries = history[now]
        mine = np.sqrt(((self.x - entries[self.own]) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        self.scans += 1
        lowered = self.bound * (1 - NARROW) - np.take_along_axis(moves(history, now, group), self.stamp, 0)
        open_ = lowered <= mine[:, None]
        rows = np.flatnonzero(open_.any(1))
        if len(rows):
            self._scan(rows, open_[rows], entries, now, group)

    def errors(self, entries: np.ndarray) -> np.ndarray:
        return ((self.x - entries[self.own]) ** 2).sum(1)

    def sums(self, k: int) -> np.ndarray:
        """[entry, component and, last, count], exact."""
        out = np.zeros((k, self.x.shape[1] + 1), np.int64)
        np.add.at(out[:, :-1], self.own, self.x)
        out[:, -1] = np.bincount(self.own, minlength=k)
        return out


def averaged(entries: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries of the next round, [part, entry, component]: floors of means; unused ones stay."""
    n = sums[..., -1:]
    return np.where(n > 0, sums[..., :-1] // np.maximum(n, 1), entries)


def _integers(vectors: pa.Array, width: int) -> np.ndarray:
    x = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(vectors), width)
    if len(x) and np.abs(x).max() >= SCALE * MOST:
        raise OverflowError(f"components of {MOST} and more can't be compressed")
    return x.astype(np.int32)


_KEYS = [("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64()))]
_STATE = "vec_id array<long>, label array<long>, x binary, own binary, bound binary, stamp binary, scans binary, sums array<long>"
_STATE_ARROW = pa.schema([*_KEYS, *((n, pa.binary()) for n in ("x", "own", "bound", "stamp", "scans")), ("sums", pa.list_(pa.int64()))])


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, parts: list[Part], scans: np.ndarray, k: int) -> pa.RecordBatch:
    packed = [np.stack([getattr(p, name) for p in parts], 1).tobytes() for name in ("own", "bound", "stamp")]
    values = [[ids], [labels], [x.tobytes()], *([v] for v in packed), [scans.astype(np.int32).tobytes()], [np.stack([p.sums(k) for p in parts]).ravel()]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _STATE_ARROW)], schema=_STATE_ARROW)


def _opened(b: pa.RecordBatch, i: int, width: int, count: int, groups: int) -> tuple[pa.Array, pa.Array, np.ndarray, list[Part], np.ndarray]:
    """The block in row i of b: ids, labels, integers, parts, distances so far."""
    raw = {c: b.column(c)[i].as_py() for c in ("x", "own", "bound", "stamp", "scans")}
    x = np.frombuffer(raw["x"], np.int32).reshape(-1, width)
    n = len(x)
    own, bound, stamp = (np.frombuffer(raw[c], t).reshape(shape) for c, t, shape in (("own", np.uint8, (n, count)), ("bound", np.float32, (n, count, groups)), ("stamp", np.uint8, (n, count, groups))))
    wide = x.astype(np.int64).reshape(n, count, -1)
    parts = [Part(wide[:, p], own[:, p].copy(), bound[:, p].copy(), stamp[:, p].copy()) for p in range(count)]
    return b.column("vec_id")[i].values, b.column("label")[i].values, x, parts, np.frombuffer(raw["scans"], np.int32).astype(np.int64)


def _usable(table: DataFrame, parts: int) -> DataFrame:
    kind = "array<double>" if "double" in dict(table.dtypes)["embedding"] else "array<float>"
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), F.col("label").cast("long"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & F.coalesce(finite, F.lit(False)))


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, group: int = GROUP, moves=net) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): vec_id, label, codes (array<int>), error, scans of each kept vector of table (vec_id, embedding, label), a staged table; and the final
    codebooks, [part, entry, component].

    error is the squared distance to the decoded vector, scans the number of exact distances that were computed for it (parts x entries x (rounds + 1) without bounds).
    Vectors that are null, empty, hold null or non-finite components, or whose length isn't that of the smallest vec_id's (a multiple of parts) are dropped. Codebooks start
    as the parts of the vectors with the smallest vec_ids (a null vec_id comes last; equal ones in the order of their vectors, each row its own entry); with fewer vectors
    they have fewer entries. Repeated rows count each. Null labels are kept. Other columns are not read, whatever their names. Components of MOST and more are
    an error. Very long vectors need no more than a block's memory. An empty table gives no rows and empty codebooks.
    """
    if entries > 256:
        raise ValueError("a code is one byte")
    spark = table.sparkSession
    good = _usable(table, parts)
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    lead = good.orderBy(*order).limit(1).collect()
    if not lead:
        empty = spark.createDataFrame([], "vec_id long, label long, codes array<int>, error long, scans long")
        return stage(empty, "codes"), np.zeros((parts, 0, 0), np.int64)
    width = len(lead[0].embedding)
    good = good.where(F.size("embedding") == width)
    start = good.orderBy(*order).limit(entries).collect()
    book = _integers(pa.array([r.embedding for r in start], pa.list_(pa.float64())), width).astype(np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    k, groups = book.shape[1], -(-book.shape[1] // group)
    history = book[:, None]  # [part, round, entry, component]

    def begin(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = _integers(b.column("embedding"), width)
                wide = x.astype(np.int64).reshape(len(x), parts, -1)
                made = [Part.first(wide[:, p], history[p, 0], group) for p in range(parts)]
                yield _block(b.column("vec_id"), b.column("label"), x, made, sum(p.scans for p in made), k)

    state = stage(good.mapInArrow(begin, _STATE), "codes-0")
    for now in range(1, rounds + 1):
        totals = state.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros(parts * k * (width // parts + 1), np.int64)
        sums[[r["at"] for r in totals]] = [r.v for r in totals]
        history = np.concatenate([history, averaged(history[:, -1], sums.reshape(parts, k, -1))[:, None]], 1)

        def step(batches, history=history, now=now):
            for b in batches:
                for i in range(b.num_rows):
                    ids, labels, x, made, scans = _opened(b, i, width, parts, groups)
                    for p, part in enumerate(made):
                        part.step(history[p], now, group, moves)
                    scans += sum(part.scans for part in made)
                    if now < rounds:
                        yield _block(ids, labels, x, made, scans, k)
                    else:
                        own = np.stack([part.own for part in made], 1).astype(np.int32)
                        codes = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, parts), pa.int32()), pa.array(own.ravel()))
                        error = sum(part.errors(history[p, now]) for p, part in enumerate(made))
                        yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(error), pa.array(scans)], names=["vec_id", "label", "codes", "error", "scans"])

        schema = _STATE if now < rounds else "vec_id long, label long, codes array<int>, error long, scans long"
        after = stage(state.mapInArrow(step, schema), f"codes-{now}")
        unstage(state)
        state = after
    return state, history[:, -1]


def decode(rows: DataFrame, books: np.ndarray, code: str = "codes") -> DataFrame:
    """rows with decoded, the vector that its codes stand for (floats; the middle of each integer's cell)."""
    book = F.array(*(F.array(*(F.array(*(F.lit((int(v) + 0.5) / SCALE) for v in e)) for e in part)) for part in books))
    return rows.withColumn("decoded", F.flatten(F.transform(code, lambda c, p: F.get(F.get(book, p), c))))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error (errors of the same label added up; nulls together), codebooks_sha256."""
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label"))
    # a table of its own, so that Spark can split a label of very many vectors in the join
    sums = stage(rows.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error")), "labels")
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0"))))
    return rows.withColumn("key", key).join(sums, "key").select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL without bounds: every distance in every round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT x.i, x.p, min_by(b.e, (list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e)) AS e FROM x JOIN b{r} b ON b.p = x.p GROUP BY 1, 2)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT p, e, list(s::BIGINT ORDER BY j) AS v FROM (SELECT a.p, a.e, j, (sum(x.v[j]) - ((sum(x.v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS s FROM a{r} a JOIN x ON x.i = a.i AND x.p = a.p, (SELECT unnest(range(1, (SELECT w FROM d) + 1)) AS j) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)")
    last = rounds
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i, vec_id, label, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
d AS (SELECT len(v) // {parts} AS w FROM k LIMIT 1),
x AS MATERIALIZED (SELECT i, p, v[p * w + 1:(p + 1) * w] AS v FROM k, d, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, i - 1 AS e, v FROM x WHERE i <= {entries}),
{", ".join(steps)},
f AS (SELECT a.i, a.p, a.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS q FROM a{last} a JOIN x ON x.i = a.i AND x.p = a.p JOIN b{last} b ON b.p = a.p AND b.e = a.e),
g AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(q)::BIGINT AS error FROM f GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{last}) AS codebooks_sha256 FROM k JOIN g USING (i)
"""


ORACLE = _oracle()
