"""Events by strand and by pass: files in any order give what one batch gives; late strands; open passes."""

import random
from datetime import datetime, timedelta

import pandas as pd

from strandlake.streaming import ticker

SCHEMA = "key long, ts timestamp, event_id long, reads int, ok boolean"
START = datetime(2024, 1, 1)


def streamed(spark, folder, files, late):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/f{i}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    with ticker.rocksdb(spark):
        q = ticker.strand_events_stream(source, "1 day", late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(ticker.PASS_OUT).parquet(f"{folder}/out")


def plain(rows):
    out, days = [], {}
    for r in rows:
        days.setdefault((r[0], r[1].date()), []).append(r)
    for (key, day), strands in days.items():
        done = oks = drops = 0
        strands.sort(key=lambda r: (r[1], r[2]))
        for i, (_, _, event, reads, ok) in enumerate(strands):
            good = ok and reads > 0
            done, oks, drops = done + 1, oks + good, drops + (reads == 0)
            out.append(("s", key, day, i, len(strands), event, reads == 0, good, done, oks, drops))
        out.append(("file", key, day, done, done, None, False, oks == done, done, oks, drops))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r.t, r.key, r["pass"].date(), r.i, r.n, r.event_id, r.drop, r.ok, r.done, r.oks, r.drops) for r in df.collect()), key=repr)


def test_shuffled_files_give_what_a_batch_gives(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(5), START + timedelta(hours=rng.randrange(72)), i, rng.randrange(3), rng.random() < 0.8) for i in range(150)]
    rng.shuffle(rows)
    end = [(99, START + timedelta(days=90), 10**6, 1, True)]  # takes the watermark beyond all passes
    got = shown(streamed(spark, str(tmp_path), [rows[0::3], rows[1::3], rows[2::3], end], "60 days"))
    assert got == plain(rows) and any(r[6] for r in got)


def test_open_passes_wait_and_late_strands_are_left_out(spark, tmp_path):
    a, b = (1, START + timedelta(hours=5), 1, 2, True), (1, START + timedelta(hours=6), 2, 0, True)
    later = (1, START + timedelta(days=2), 3, 2, True)
    too_late = (1, START + timedelta(hours=7), 4, 2, True)
    got = shown(streamed(spark, str(tmp_path), [[b, a], [later], [later[:2] + (5, 1, True)], [too_late]], "1 hour"))
    assert got == plain([a, b])


def test_one_pass():
    rows = pd.DataFrame([(1, START, START, 5, 1, True), (1, START, START, 4, 0, True)], columns=["key", "pass", "ts", "event_id", "reads", "ok"])
    out = ticker.pass_events(rows)
    assert out["t"].tolist() == ["s", "s", "file"] and out["drop"].tolist() == [True, False, False] and out["ok"].tolist() == [False, True, False] and out["oks"].tolist() == [0, 1, 1]


def test_passes_of_one_call_are_apart():
    kinds = ["key", "pass", "ts", "event_id", "reads", "ok"]
    rows = pd.DataFrame([(2, START, START, 7, 1, True), (1, START, START, 5, 1, True), (1, START, START, 4, 0, True), (1, START + timedelta(1), START, 6, 1, False)], columns=kinds)
    got = ticker.pass_events(rows)
    each = [ticker.pass_events(part[kinds]) for part in (rows[1:3], rows[3:], rows[:1])]
    shape = lambda df: sorted(df.astype(object).where(df.notna(), None).itertuples(index=False, name=None), key=repr)
    assert shape(got) == shape(pd.concat(each)) and got["n"].tolist().count(2) == 3
