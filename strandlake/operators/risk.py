"""A learned scorer of strands: logistic regression on k-mer features, fitted by Spark ML over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.cutting import CODE

#: Longest k-mers, longest run told apart, and the penalty of the fit.
MAX_K, MAX_RUN, PENALTY = 4, 10, 1e-3


def feature_row(strand: str) -> np.ndarray:
    """Frequencies of k-mers for k of 1 to MAX_K, the longest run as one of MAX_RUN + 1 indicators, GC, its square, and the length in hundreds."""
    codes = CODE[np.frombuffer(strand.encode(), np.uint8)].astype(np.int64)
    parts = []
    for k in range(1, MAX_K + 1):
        n = max(0, len(codes) - k + 1)
        number = sum((codes[j : j + n] * 4 ** (k - 1 - j) for j in range(k)), np.zeros(n, np.int64))
        known = np.logical_and.reduce([codes[j : j + n] < 4 for j in range(k)]) if n else np.zeros(0, bool)
        parts.append(np.bincount(number[known], minlength=4**k) / max(1, n))
    starts = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes)) if len(codes) else np.zeros(1, int)
    run = np.zeros(MAX_RUN + 1)
    run[min(MAX_RUN, int(np.diff(starts).max(initial=0)))] = 1
    gc = float(((codes == 1) | (codes == 2)).mean()) if len(codes) else 0.0
    return np.concatenate([*parts, run, [gc, gc * gc, len(codes) / 100]])


def with_features(strands: DataFrame) -> DataFrame:
    """strands (strand, ...) with features, an array; a null strand counts as empty."""
    schema = T.StructType([*strands.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [feature_row(s or "") for s in b.column("strand").to_pylist()]
            values = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            width = len(rows[0]) if rows else 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), values)
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "features"])

    return strands.mapInArrow(run, schema)


def fit(strands: DataFrame) -> LogisticRegressionModel:
    """Scorer from strands (strand, risk from 0 to 1): each counts for both outcomes, weighted by its risk; missing risks are left out. Features are standardised."""
    rows = with_features(strands.where(F.col("risk").isNotNull() & ~F.isnan("risk")).select("strand", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("risk"))).alias("risk")))
    both = rows.select(array_to_vector("features").alias("features"), F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("risk").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("risk")).alias("w")))).alias("o"))
    both = both.select("features", "o.y", "o.w").where("w > 0")
    return LogisticRegression(labelCol="y", weightCol="w", regParam=PENALTY, standardization=True, maxIter=60).fit(both)


def score(strands: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """strands with risk_score, the probability of failure."""
    rows = with_features(strands).withColumn("__f", array_to_vector("features"))
    scored = model.setFeaturesCol("__f").transform(rows)
    return scored.select(*strands.columns, vector_to_array("probability")[1].alias("risk_score"))
