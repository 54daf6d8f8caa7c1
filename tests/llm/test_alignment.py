"""Token alignment and its counts against a brute-force version on whole texts with both libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from strandlake.llm import alignment
from strandlake.llm.common import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "\n", "\n\nx y", "x \n y", "▁", "a ▁ b", "<s> a </s>", "<|endoftext|> b", "a\tb c", "é è 日本語 の 日", "😀 😀x", "x" * 3000, "́ a",
    "a\x00b c", "a 　b c", "it's we'll don't", "a \x85 b", "   x y ", "1234 5678", " ".join(["w"] * 3000), "\x1c a b\x1d c", "a b", "a b",
]


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(texts):
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_of_letter()
    a.encode_special_tokens = True
    names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    piece = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    rows, docs = [], Counter()
    for text in texts:
        row = None
        if text:
            e, ids = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            left, right, raw = [bytes(letters[c] for c in t) for t in e.tokens], [piece[i] for i in ids], (" " + text).encode()
            if b"".join(left) == raw == b"".join(right):
                x, y = spans(left), spans(right)
                cuts = {s[1] for s in x} & {s[1] for s in y}
                groups, group = [], ([], [])
                moves = sorted([(s[1], 0, i) for s, i in zip(x, e.ids)] + [(s[1], 1, i) for s, i in zip(y, ids)])
                for k, (end, side, i) in enumerate(moves):
                    group[side].append(i)
                    if end in cuts and (k + 1 == len(moves) or moves[k + 1][0] > end):
                        groups.append("|".join(",".join(map(str, g)) for g in group))
                        group = ([], [])
                linked, j0 = [], 0
                for i, s in enumerate(x):
                    while y[j0][1] <= s[0]:
                        j0 += 1
                    j = j0
                    while j < len(y) and y[j][0] < s[1]:
                        linked.append((e.ids[i], ids[j]))
                        j += 1
                docs.update(set(linked))
                row = len(x), len(y), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest()
        rows.append(row)
    best = Counter()
    for (p, _), n in docs.items():
        best[p] = max(best[p], n)
    return [(0,) * 6 + ("",) if r is None else (*r[:3], len(r[3]), sum(docs[k] == best[k[0]] for k in r[3]), sum(docs[k] for k in r[3]), r[4]) for r in rows]


def compare(spark, texts, **less):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, N_a string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(df, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_documents_and_odd_texts(spark, sf_dir):
    compare(spark, [r.text for r in table(spark, sf_dir, "documents").select("text").limit(60).collect()] + ODD)


def test_random_texts_in_small_slices(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["a", "the", " ", " ", "  ", "\n", "Ärger", "don't", "123", "<s>", "😀", ".", "...", "\t", "x" * 80, "ing", " ", "日本", "'s"]
    monkeypatch.setattr(alignment, "SLICE_BYTES", 200)
    monkeypatch.setattr(alignment, "BATCH", 64)
    compare(spark, ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(300)])


def test_groups_are_slices_of_shared_ends():
    assert alignment.groups([2, 3, 7], [1, 3, 5, 7]) == ([2, 3], [2, 4]) and alignment.groups([4], [4]) == ([1], [1])
    for a, b, want in (([2, 3], [1, 3], [(0, 0), (0, 1), (1, 1)]), ([7], [5, 7], [(0, 0), (0, 1)]), ([1, 2], [1, 2], [(0, 0), (1, 1)])):
        assert list(zip(*(x.tolist() for x in alignment.links(np.array(a), np.array(b))[:2]))) == want


def test_empty_table_and_repeated_rows(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    rows = alignment.align(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b")], "doc_id long, text string"), A, B).collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1 and rows[0].count_sum == 3 * rows[0].n_links
