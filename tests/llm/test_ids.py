"""Token ids in files: ids equal the library's, blocks and index ascend, documents are found again."""

import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from strandlake.llm import id_files

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_library():
    t, e = Tokenizer.from_file(WORDS), id_files.Encoder(WORDS)
    rng = random.Random(3)
    letters = "abcXYZ 019 '''\"<|>startoftextendof \t\n\r\x0b\x0c\x1c\x85\xa0éÉßİıſK̈́ååñ½²ªµ×÷漢😀ǅﬁ́̈"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["<|startoftext|>a<|endoftext|>b", "don't I'LL 'S '''s we'RE", "x" * 30000, "É" * 500, "'" * 300, "", None]
    for _ in range(2):  # new words, then remembered ones
        for text, ids in zip(texts, e.encode(pa.array(texts), 7)):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids + [7]


def test_files_are_in_order(spark, monkeypatch):
    monkeypatch.setattr(id_files, "BLOCK_ROWS", 5)
    monkeypatch.setattr(id_files, "RANGE_ROWS", 40)
    monkeypatch.setattr(id_files, "INDEX_ROWS", 100)
    rng = random.Random(12)
    rows = [(rng.randrange(500), f"text {rng.randrange(9)} " * rng.randrange(30), "x") for _ in range(400)] + [(77, f"again {i % 3}", "y") for i in range(100)] + [(None, "none", None)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, block string")
    folder = id_files.write(d, WORDS)
    files = sorted(f for f in os.listdir(folder + "/blocks") if f.endswith(".parquet"))
    tables = [pq.read_table(f"{folder}/blocks/{f}") for f in files]
    ids = [i if i is not None else -1 for t in tables for block in t.column("doc_ids").to_pylist() for i in block]
    assert len(files) > 3 and len(ids) == len(rows) and ids == sorted(ids)
    numbers = [n for t in tables for n in t.column("block_no").to_pylist()]
    assert numbers == sorted(set(numbers))
    got = id_files.read(spark, folder).orderBy("start").collect()
    t, start, whole = Tokenizer.from_file(WORDS), 0, {}
    for i, text, _ in rows:
        whole.setdefault(i, []).append(zlib.crc32(np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4").tobytes()))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        whole[r.doc_id].remove(r.ids_crc32)
    assert not any(whole.values()) and [r.doc_id if r.doc_id is not None else -1 for r in got] == ids
    expected = [t.encode(x, add_special_tokens=False).ids + [1] for i, x, _ in rows if i == 77]
    assert sorted(x.tolist() for x in id_files.lookup(spark, folder, 77)) == sorted(expected)
    assert id_files.lookup(spark, folder, 10**6) == []


def test_very_long_text_and_no_rows(spark):
    t, long = Tokenizer.from_file(WORDS), "Ünïcode word's 123, " * 40000
    d = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    folder = id_files.write(d, WORDS)
    first, second = id_files.read(spark, folder).orderBy("start").collect()
    ids = t.encode(long, add_special_tokens=False).ids + [1]
    assert (first.n_tokens, second.start) == (len(ids), len(ids)) and id_files.lookup(spark, folder, 1)[0].tolist() == ids
    empty = id_files.write(d.limit(0), WORDS)
    assert id_files.read(spark, empty).count() == 0 and id_files.lookup(spark, empty, 1) == []
