"""Each stage of the pipeline on odd rows and against a plain computation; the whole of it on the smallest tables."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from strandlake.llm import mixing, pieces, pii, quality
from strandlake.llm.common import table
from test_near import components, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, taken string, ids string, Score double, size string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    base = [word() for _ in range(60)]
    near = [*base[:30], "changed", *base[31:]]
    texts = [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += [" ".join(base), " ".join(near), " ".join(base), None, None, "", "", " \n", "mail a.b@c.example.com now", "w " * 60000]
    out = [(i, t, "en", ("a", "b", None)[i % 3], len(t) if t is not None else None, True, "x", "y", "z", 0.5, "s") for i, t in enumerate(texts)]
    out += [(None, "no id", "en", "a", 5, None, None, None, None, None, None)] * 2
    out += [out[3], (5, "another text under five", None, "a", 3, None, None, None, None, None, None), (6, " ".join(base), None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name,f", P.STAGES)
def test_empty_table_and_columns(spark, docs, sf_dir, name, f):
    out = f(spark, docs.limit(0), sf_dir)
    assert out.count() == 0
    if name != "sentencepiece":
        assert out.columns == docs.columns and f(spark, docs, sf_dir).dtypes == docs.dtypes


@pytest.mark.parametrize("name,f", P.STAGES[:-1])
def test_columns_of_the_same_names(spark, docs, sf_dir, name, f):
    clash = {n: F.lit(n) for n in ("hash", "node", "words", "nth", "copy", "kept", "place", "copies", "spans", "pii_spans", "i", "__score", "__hash", "__words")}
    wide = docs.withColumns(clash)
    out = f(spark, wide, sf_dir)
    got = [r.asDict() for r in out.collect()]
    assert out.columns == wide.columns and got and all(r[n] == n for r in got for n in clash)
    assert Counter(r["doc_id"] for r in got) == Counter(r.doc_id for r in f(spark, docs, sf_dir).collect())


def test_mixing_decides_for_rows_by_their_further_columns(spark, docs, sf_dir):
    rows = [(i // 4, "w " * (1 + i // 4 % 5), f"l{i % 4}", "ab"[i % 8 // 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    runs = [Counter(map(tuple, P.mix_sources(spark, d, sf_dir).collect())) for d in (docs, docs.orderBy(F.desc("lang")), docs.repartition(7))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 100


def key(r):
    return tuple(map(repr, r))


def test_quality_stage(spark, docs, rows, sf_dir):
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    expected = [r for r in rows if model.scores([r[1]])[0] >= P.LEAST_QUALITY]
    assert Counter(map(key, P.keep_quality(spark, docs, sf_dir).collect())) == Counter(map(key, expected))


def test_near_duplicate_stage(spark, docs, rows, sf_dir):
    got = P.drop_near_duplicates(spark, docs, sf_dir).collect()
    distinct = {(r[0], r[1]): r for r in sorted(rows, key=key) if r[0] is not None}
    order = sorted(distinct, key=lambda k: (k[0], k[1] or ""))
    group = components({i: shingles(distinct[k][1], 5) for i, k in enumerate(order)})
    members = {}
    for i, k in enumerate(order):
        members.setdefault(group[i], set()).add(k)
    kept = [(r.doc_id, r.text) for r in got if r.doc_id is not None]
    assert len(kept) == len(set(kept)) == len(members) and all(len(m & set(kept)) == 1 for m in members.values())
    assert (40, rows[40][1]) in kept or (6, rows[40][1]) in kept  # base, its copy, the near one, and the one under six are a group
    assert {(5, rows[5][1]), (5, "another text under five"), (6, rows[6][1])} <= set(kept)
    assert sum(r.doc_id is None for r in got) == 2


def test_redaction_stage(spark, docs, rows, sf_dir):
    weights, _ = pii.train(docs)
    expected = []
    for r in rows:
        text = r[1] and pii.redacted(r[1], pii.find_spans(r[1], weights))
        expected.append((r[0], text, *r[2:4], r[4] if text is None else len(text), *r[5:]))
    got = P.redact(spark, docs, sf_dir).collect()
    assert Counter(map(key, got)) == Counter(map(key, expected)) and any(r.text == "mail [EMAIL] now" for r in got)


def test_mixing_stage(spark, docs, rows, sf_dir):
    got = Counter(map(key, P.mix_sources(spark, docs, sf_dir).collect()))
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    assert set(got) <= {key(r) for r in rows if size(r)}
    by = Counter()
    for r in rows:
        by[r[3]] += size(r)
    names = sorted(x for x in by if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    # targets by repeated resharing
    target, free = {}, set(names)
    while True:
        left = sum(by.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * by[s] + 1e-9}
        if not over:
            target |= share
            break
        target |= {s: 3 * by[s] for s in over}
        free -= over
    copies = Counter(map(key, rows))
    taken = Counter()
    for r in {key(r): r for r in rows}.values():
        n, rate = got[key(r)], target[r[3]] / by[r[3]] if by[r[3]] else 0
        taken[r[3]] += n * size(r)
        if size(r):  # each copy is taken floor or ceil of the rate times, except for those exchanged in landing
            assert 0 <= n <= 3 * copies[key(r)] and abs(n - rate * copies[key(r)]) <= copies[key(r)] + 1e-9
    assert all(abs(taken[s] - target[s]) <= 0.1 * target[s] + 60 for s in names if s != rows[49][3])
    assert got == Counter(map(key, P.mix_sources(spark, docs.repartition(5), sf_dir).collect()))


def test_ids_stage(spark, docs, rows, sf_dir):
    m = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    got = P.to_ids(spark, docs, sf_dir).collect()
    assert len(got) == len(rows) and all(r.lossless and r.n_tokens == len(r.ids) for r in got)
    assert Counter((r.doc_id, r.source, pieces.decode_ids(m, r.ids)) for r in got) == Counter((r[0], r[3], r[1] or "") for r in rows)


def test_whole_pipeline_step_by_step(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = [r for r in docs.collect() if model.scores([r.text])[0] >= P.LEAST_QUALITY]
    group = components({r.doc_id: shingles(r.text, 5) for r in rows})
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    weights, _ = pii.train(spark.createDataFrame(rows, docs.schema))
    rows = {r.doc_id: (r.source, r.text and pii.redacted(r.text, pii.find_spans(r.text, weights))) for r in rows}
    mixed = {r.doc_id: r for r in mixing.mix(spark.createDataFrame([(i, *x) for i, x in rows.items()], "doc_id long, source string, text string")).collect()}
    out = P.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in out) == Counter({i: r.taken // r.size for i, r in mixed.items() if r.taken})
    m = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert all(r.lossless and pieces.decode_ids(m, r.ids) == rows[r.doc_id][1] for r in out)
