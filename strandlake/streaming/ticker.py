"""The event stream: running totals, passes, and windows on event time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key long, event_id long, done long, total double"
STATE = "done long, total double, last long"


def running_totals(events: DataFrame) -> DataFrame:
    """Totals of each key up to each event, over a table."""
    w = Window.partitionBy("key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.select("key", "event_id", F.count("*").over(w).alias("done"), F.sum("value").over(w).alias("total"))


def _in_order(parts: Iterator[pd.DataFrame], last: int, key: tuple) -> pd.DataFrame:
    """Rows of a key in one batch by event_id; an event that should have come in an earlier batch is an error, as what it changes has been given out."""
    rows = pd.concat(list(parts)).sort_values("event_id", ignore_index=True)
    if rows["event_id"].iloc[0] <= last:
        raise ValueError(f"event {rows['event_id'].iloc[0]} of key {key[0]} came after event {last}")
    return rows


def running_totals_stream(events: DataFrame) -> DataFrame:
    """The same over a stream (key, event_id, value), with each key's totals and last event as state. A key's events come in batches in the order of event_id, as
    a recording or a log gives them; within a batch they may come in any."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, total, last = state.get if state.exists else (0, 0.0, -(2**63))
        rows = _in_order(parts, last, key)
        n = rows["value"].fillna(0.0)
        out = pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "done": done + rows.index + 1, "total": total + n.cumsum()})
        state.update((int(done + len(rows)), float(total + n.sum()), int(rows["event_id"].iloc[-1])))
        yield out

    return events.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def passes_stream(events: DataFrame, size: int = 10) -> DataFrame:
    """(key, pass, last_event, total) of each complete pass of so many events of a key, over a stream (key, event_id, value) in the order of event_id. The state is the
    pass that is not complete: its number, events, sum and last event."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, done, total, last = state.get if state.exists else (0, 0, 0.0, -(2**63))
        rows = _in_order(parts, last, key)
        at = done + rows.index
        g = rows.assign(value=rows["value"].fillna(0.0), number=number + at // size).groupby("number").agg(n=("event_id", "size"), last_event=("event_id", "max"), total=("value", "sum"))
        if done and len(g):
            g.loc[number, "n"] += done
            g.loc[number, "total"] += total
        full = g[g["n"] == size].reset_index()
        part = g[g["n"] < size]
        number += len(full)
        n, sum_ = (int(part["n"].iloc[0]), float(part["total"].iloc[0])) if len(part) else (0, 0.0)
        state.update((int(number), n, sum_, int(rows["event_id"].iloc[-1])))
        yield pd.DataFrame({"key": key[0], "pass": full["number"], "last_event": full["last_event"], "total": full["total"]})

    return events.groupBy("key").applyInPandasWithState(step, "key long, pass long, last_event long, total double", "number long, n long, total double, last long", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window of event time; works on tables and streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def replay(spark: SparkSession, path: str, schema: str, files_per_step: int = 1) -> DataFrame:
    """A recording (JSON lines) as a stream, so many files a step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).json(path)


def record(events: DataFrame, path: str, checkpoint: str):
    """Write a stream as JSON lines until it has no more; returns the query."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a pass gives: an event for each strand (t: s), in order, and one at its end (t: file).
PASS_OUT = "t string, key long, pass timestamp, i int, n int, event_id long, drop boolean, ok boolean, done int, oks int, drops int"


def pass_events(rows: pd.DataFrame) -> pd.DataFrame:
    """The events of passes from their strands (key, pass, ts, event_id, reads, ok): one for each in the order of ts and event_id, with the totals so far, and one for the file.

    A strand without reads is a dropout and never ok; a file is ok if all its strands are.
    """
    rows = rows.sort_values(["key", "pass", "ts", "event_id"], ignore_index=True)
    drop = rows["reads"].eq(0)
    ok = rows["ok"].astype(bool) & ~drop
    out = pd.DataFrame({"t": "s", "key": rows["key"], "pass": rows["pass"], "event_id": rows["event_id"].astype("Int64"), "drop": drop, "ok": ok})
    each = out.groupby(["key", "pass"], sort=False, dropna=False)
    i = each.cumcount()
    out = out.assign(i=i, n=each["ok"].transform("size"), done=i + 1, oks=each["ok"].cumsum(), drops=each["drop"].cumsum())
    end = out[out["done"] == out["n"]]
    end = end.assign(t="file", i=end["n"], event_id=pd.NA, drop=False, ok=end["oks"] == end["n"]).astype({"event_id": "Int64"})
    return pd.concat([out, end], ignore_index=True)[["t", "key", "pass", "i", "n", "event_id", "drop", "ok", "done", "oks", "drops"]]


def _events_of_passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PASS_OUT of batches (key, pass, strands), all passes of a batch at once; a pass goes by its place in the batch, as keys may be null."""
    kinds = {"i": pa.int32(), "n": pa.int32(), "event_id": pa.int64(), "drop": pa.bool_(), "ok": pa.bool_(), "done": pa.int32(), "oks": pa.int32(), "drops": pa.int32()}
    for b in batches:
        strands = b.column("strands")
        ts, event_id, reads, ok = strands.flatten().flatten()
        rows = pd.DataFrame({
            "key": np.asarray(pc.list_parent_indices(strands)), "pass": 0, "ts": np.asarray(ts.cast(pa.int64())), "event_id": event_id.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
            "reads": np.asarray(pc.fill_null(reads, -1)), "ok": np.asarray(pc.fill_null(ok, False)),
        })
        out = pass_events(rows)
        at = pa.array(out["key"].to_numpy(), pa.int64())
        columns = {"t": pa.array(out["t"], pa.string()), "key": b.column("key").take(at), "pass": b.column("pass").take(at), **{c: pa.array(out[c], kind) for c, kind in kinds.items()}}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def strand_events_stream(strands: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """A stream of pass_events() from strands (key, ts, event_id, reads, ok); a pass is a key's window of event time.

    Strands of a pass wait in the state of one aggregate until the watermark has reached the pass's end; then all its events are given out and the state is dropped. Strands may come in any
    order before that; later ones are dropped, as their pass is out already. What is kept is the open passes only. Nothing runs in Python for a single pass, only for batches of closed ones.
    """
    s = strands.withWatermark("ts", late)
    passes = s.groupBy("key", F.window("ts", size).alias("w")).agg(F.collect_list(F.struct("ts", "event_id", "reads", "ok")).alias("strands"))
    return passes.select("key", F.col("w.start").alias("pass"), "strands").mapInArrow(_events_of_passes, PASS_OUT)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps open passes outside the heap, for streams that start within."""
    name, was = "spark.sql.streaming.stateStore.providerClass", None
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)
