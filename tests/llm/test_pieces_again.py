"""Merge-dropout against an agenda written anew; words with one hash; long texts and empty tables."""

import random

import numpy as np
import public_tokenizers

from strandlake.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def plain(m, text, key, dropout, seed):
    """All candidates of all words in a list, the best first; the keyed draw of a candidate decides when its turn comes."""
    u64 = 2**64 - 1

    def mixed(x):
        x &= u64
        x ^= x >> 31
        x = x * 0xD6E8FEB86659FD93 & u64
        x ^= x >> 29
        x = x * 0xC2B2AE3D27D4EB4F & u64
        return x ^ x >> 32

    words, full = [], " " + text if text else ""
    for i, c in enumerate(full):
        known = m.symbol[ord(c)] >= 0
        if not words or not known or not words[-1][1] or (c == " " and full[i - 1] != " "):
            words.append(["", known])
        words[-1][0] += c
    out = []
    for nth, (w, known) in enumerate(words):
        if not known:
            out += [int(m.byte[b]) for b in w.encode()]
            continue
        draw = mixed(mixed(mixed((key or 0) + 1) + seed) + nth)
        parts = [(i, i + 1, int(m.symbol[ord(c)])) for i, c in enumerate(w)]
        skipped = set()
        while True:
            turns = sorted((m.pairs[a[2] * m.n + b[2]], a[0], j) for j, (a, b) in enumerate(zip(parts, parts[1:])) if a[2] * m.n + b[2] in m.pairs and (a[0], b[0], b[1]) not in skipped)
            if not turns:
                break
            rank, _, j = turns[0]
            a, b = parts[j], parts[j + 1]
            if mixed(draw + (a[0] << 42) + (b[0] << 21) + b[1]) < int(dropout * 2**64):
                skipped.add((a[0], b[0], b[1]))
            else:
                parts[j : j + 2] = [(a[0], b[1], int(m.by_rank[rank]))]
        out += [p[2] for p in parts]
    return out


def test_equals_plain_agenda():
    m, rng = pieces.load(MODEL), random.Random(1)
    texts = ["".join(rng.choice(["the ", "inter", "nation", "al", " ", "  ", "é", "漢", "ing", "qu", ".", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(120)] + ["internationalisation" * 6]
    for dropout in (0.0, 0.1, 0.5):
        got = pieces.encode_texts(m, texts, list(range(len(texts))), dropout, 3)
        for i, t in enumerate(texts):
            assert got[i].tolist() == plain(m, t, i, dropout, 3) == pieces.encode_slowly(m, t, i, dropout, 3).tolist()


def test_words_with_one_hash_are_encoded_again(spark, monkeypatch):
    monkeypatch.setattr(pieces, "mix", lambda x: x & np.uint64(0))  # all words, and all draws, are one
    m = pieces.load(MODEL)
    texts = ["several different words", "several", None, ""]
    fast = pieces.encode_texts(m, texts, [1, 2, 3, 4], 0.0)
    assert pieces.decode_ids(m, fast[0].tolist()) != texts[0]
    slow = pieces.encode_slowly(m, texts[0], 1, 0.0)
    assert pieces.decode_ids(m, slow.tolist()) == texts[0]


def test_long_texts_and_no_rows(spark):
    long = "Ünusual wörds, again and again. " * 8000
    d = spark.createDataFrame([(1, long, 0), (1, long, 0), (2, None, 1), (None, "x" * 5000, 2)], "doc_id long, text string, IDS int")
    rows = pieces.encode(d, MODEL).collect()
    assert all(r.lossless for r in rows) and len({tuple(r.ids) for r in rows if r.doc_id == 1}) == 1
    assert pieces.encode(d.limit(0), MODEL).count() == 0 and "IDS" not in pieces.encode(d, MODEL).columns
