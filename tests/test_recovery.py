"""Recovery of files whose strands are lost in part or whole."""

import hashlib

from strandlake import catalog


def lost(item, slot):
    return int(hashlib.md5(f"{item}|{slot}|lost|3".encode()).hexdigest()[:8], 16) / 2**32 < 0.1


def test_a_file_that_lost_all_strands_has_a_row(spark, tmp_path):
    gone = next(i for i in range(10**6) if all(lost(i, slot) for slot in range(3)))
    whole = next(i for i in range(10**6) if not any(lost(i, slot) for slot in range(3)))
    spark.createDataFrame([(gone, "ab"), (whole, "cd")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.file_id: r.exact for r in catalog.queries()["c5_e1_recover"](spark, str(tmp_path)).collect()}
    assert got == {gone: False, whole: True}
