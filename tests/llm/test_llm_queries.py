"""The numbered queries: names, columns, one row for each row of the table; the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from strandlake.llm.common import table
from strandlake.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op3": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op4": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op5": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op6": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op11": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
    "op12": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op7": {"vec_id", "n_links", "component_id", "kept"},
    "op8": {"doc_id", "held_out", "score", "predicted"},
    "op9": {"doc_id", "size", "source_size", "target", "taken"},
    "op10": {"doc_id", "n_shingles", "component_id", "kept"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    op = name.split("_")[0]
    assert COLUMNS.get(op, set()) <= set(df.columns)
    source, key = ("embeddings", "vec_id") if op in ("op7", "op11") else ("pages", "page_id") if op == "op13" else ("conversations", "pair_id") if op == "op2" else ("documents", "doc_id")
    rows = table(spark, sf_dir, source)
    assert df.count() == (rows.select("conv_id").distinct().count() if op == "op2" else rows.count())
    assert df.select(key).distinct().count() == df.count()


def test_chat_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    r = con.execute(ORACLES["op2_chat_preferences"])
    cols = [d[0] for d in r.description]
    got = [tuple(x[c] for c in cols) for x in QUERIES["op2_chat_preferences"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(r.fetchall())


def test_pipeline(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.where("not lossless").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "sentencepiece"]
