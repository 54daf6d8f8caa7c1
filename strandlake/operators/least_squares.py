"""Least squares over all rows: the sums of one aggregate, a small solve for each group, and the scorer applied back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(rows: DataFrame, by: list[str], features: dict[str, Column], y: Column, times: Column | None = None) -> DataFrame:
    """(by, n, weights): for each group the weights, in the order of features, whose sum of products is nearest to y in squares.

    One aggregate gives the Gram matrix of the features and their products with y; its size depends on the number of features only. Rows with a null or non-finite
    feature or y are left out; where the matrix is singular, the weights are the shortest that fit. A row stands for times rows that are equal in all of these.
    """
    names, k = list(features), len(features)
    kept = rows.select(*by, *(c.cast("double").alias(n) for n, c in features.items()), y.cast("double").alias("__y"), (F.lit(1) if times is None else times).cast("long").alias("__times"))
    fine = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (*names, "__y")]
    for c in fine:
        kept = kept.where(c)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.sum(F.col(names[i]) * F.col(names[j]) * F.col("__times")).alias(f"g{i}_{j}") for i, j in pairs] + [F.sum(F.col(n) * F.col("__y") * F.col("__times")).alias(f"b{i}") for i, n in enumerate(names)]
    gram = kept.groupBy(*by).agg(F.sum("__times").alias("n"), *sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                value = lambda name: b.column(name)[r].as_py()  # noqa: B023, E731  used within this turn
                g = np.zeros((k, k))
                for i, j in pairs:
                    g[i, j] = g[j, i] = value(f"g{i}_{j}")
                scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
                out.append((np.linalg.lstsq(g / scale / scale[:, None], np.array([value(f"b{i}") for i in range(k)]) / scale, rcond=1e-13)[0] / scale).tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), b.column("n"), pa.array(out, pa.list_(pa.float64()))], names=[*by, "n", "weights"])

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by)
    return gram.mapInArrow(run, f"{kinds}, n long, weights array<double>")


def predicted(features: dict[str, Column], weights: Column) -> Column:
    """The score of a row, at least 0 and at most 1."""
    total = sum((c.cast("double") * F.get(weights, F.lit(i)) for i, c in enumerate(features.values())), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
