"""Personal data, secrets, quality, mixing, ids, media and chat on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import chat, id_files, mixing, mpeg_audio, pieces, pii, quality, secret_scan

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " ", "a  b\n\tc", "é ü 漢字 😀", "token = \"abcdef0123456789\"", "x" * 3000, "same text here", "same text here", "a▁b", "mail a.b@c.example.com or +1 (743) 555-3824"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src" if i % 2 else None, "clash", 1.0) for i, t in enumerate(TEXTS)] + [(None, "no id", "src", "clash", 2.0), (3, "again 3", "src", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, ids double")


def test_pii_base_spans_equal_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123456789. -+()@ab.") for _ in range(rng.randint(0, 80))) for _ in range(5000)]
    texts += ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "256.1.1.1", "1" * 5000, "a@b@c.d+y@e.f"]
    for t in texts:
        expected = [(0, *m.span()) for m in email.finditer(t)] + [(1, *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        expected += [(2, *m.span()) for m in card.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        expected += [(3, *m.span()) for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]
        assert sorted(expected) == sorted(pii.candidates(t)[0])


def test_pii_columns_and_redaction(docs):
    weights, told = pii.train(docs)
    out = pii.detect(docs, weights, redact=True)
    assert set(out.columns) == {*docs.columns, "pii_spans"} and out.count() == docs.count()
    row = out.where("doc_id = 10").first()
    assert row.text == "mail [EMAIL] or [PHONE]"
    digest = pii.digest(pii.detect(docs, weights)).where("doc_id = 10").first()
    assert (digest.n_email, digest.n_phone) == (1, 1) and digest.base_sha256 == hashlib.sha256(digest.spans.encode()).hexdigest()
    assert pii.detect(docs.limit(0), weights).count() == 0 and pii.train(docs.limit(0))[1] == {}


def test_pii_learning_adds_likely_spans():
    good, bad = "please call me: (743) 555-3824 thanks", "version 043 155-3824x"
    counts = {}
    for t, n in ((good, 50), (bad, 50), ("write to a.b@c.example.com now", 50)):
        for s in sum(pii.candidates(t), []):
            counts[pii.pattern(t, *s)] = n
    w, told = pii.fit(counts)
    assert any(k == 5 for k, *_ in pii.find_spans(good, w))
    assert 0 < told["phone_local"]["share"] < 1


def test_secrets_equal_patterns():
    rules = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    checks = [lambda m: len(m[2]) >= 12, lambda m: len(m[0]) >= 18, lambda m: len(m[0]) >= 16]
    parts = ["token", "secret", "password", "PassWd", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "0123abcdef", "é", "x", "==", "-", "AKIAAKIA", "f00", "\n", "K"]
    rng = random.Random(2)
    s = secret_scan.scanner()
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        expected = sorted((m.start(), m.end(), k) for k, r in enumerate(rules) for m in r.finditer(t) if checks[k](m))
        assert [x for x in s.spans(t) if x[2] < 3] == expected


def test_secret_columns(docs):
    out = secret_scan.digest(secret_scan.scan(docs))
    assert out.count() == docs.count()
    row = out.where("doc_id = 5").first()
    assert row.n_assign == 1 and row.n_hex == 1 and row.spans.startswith("assign:0:")
    key = "-----BEGIN RSA PRIVATE KEY-----"
    assert [secret_scan.RULES[r].name for *_, r in secret_scan.scanner().spans("é " + key)] == ["private_key"]


def test_quality_learns_and_scores(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word() + ("!!" if i % 4 == 0 else "") for _ in range(60)), int(i % 4 != 0)) for i in range(400)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.train(d, labels)
    scored = quality.score(d, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r.held]
    assert held and sum((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.95
    out = quality.score(docs, model)  # docs has a column score already
    assert dict(out.dtypes)["score"] == "double" and out.where("score is null or score < 0 or score > 1").count() == 0
    empty = quality.train(d.limit(0), labels)
    assert np.isfinite(empty.scores(["", None, "x"])).all()


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 200)), None if i % 10 == 0 else "big" if i % 3 else f"s{i % 4}") for i in range(1200)]
    d = spark.createDataFrame([*rows, (7, "w w", "big"), (7, "w w", "big"), (None, "w", "s1"), (8, None, "s1")], "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == d.count()
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.source_size, r.target, 0])[2] += r.taken
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[1] for v in by.values()) - min(total, 3 * total)) < 1e-6 * total
    assert all(abs(t - taken) <= max(60, 0.01 * t) for _, t, taken in by.values())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()), key=repr)
    assert mixing.mixed(d).columns == d.columns and mixing.mix(d.limit(0)).count() == 0


def test_targets_of_capped_sources(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 5)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a and null are capped at three times their size; b and c share the rest 2 to 1
    assert got["a"] == 30 and got[None] == 15 and abs(got["b"] - 2 * (1515 - 45) / 3) < 1e-9 and abs(got["c"] - (1515 - 45) / 3) < 1e-9


def test_flight_keeps_totals():
    rng = random.Random(8)
    p, x = [rng.random() for _ in range(500)], [rng.randint(1, 1000) for _ in range(500)]
    q = mixing.flight(p, x, rng.random)
    assert sum(0 < v < 1 for v in q) <= 2
    assert abs(sum(q) - sum(p)) < 1e-6 and abs(sum(a * b for a, b in zip(q, x)) - sum(a * b for a, b in zip(p, x))) < 1e-3


def test_pieces_equal_library_and_round_trip(docs):
    m, sp = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t for t in TEXTS if t is not None and "▁" not in t]
    assert [x.tolist() for x in pieces.encode_texts(m, texts, [1] * len(texts), 0.0)] == [sp.encode(t) for t in texts]
    long_way = pieces.LONG
    a = pieces.encode_texts(m, texts, list(range(len(texts))), 0.3, 9)
    try:
        pieces.LONG = 2  # every word by an agenda of its own
        b = pieces.encode_texts(m, texts, list(range(len(texts))), 0.3, 9)
    finally:
        pieces.LONG = long_way
    assert [x.tolist() for x in a] == [x.tolist() for x in b]
    out = pieces.encode(docs, MODEL)
    assert out.count() == docs.count() and out.where("not lossless").count() == 0
    assert dict(out.dtypes)["ids"] == "array<int>"  # the column of that name was replaced
    varied = {tuple(pieces.encode_texts(m, ["international communication"], [k])[0].tolist()) for k in range(40)}
    assert len(varied) > 1


def test_pieces_drop_out_by_occurrence():
    m = pieces.load(MODEL)
    text = "international " * 4000
    plain = pieces.encode_texts(m, ["international"], [1], 0.0)[0].tolist()
    ids = pieces.encode_texts(m, [text], [5])[0].tolist()
    assert pieces.decode_ids(m, ids) == text
    seen, word = {}, []
    for i in ids:  # a word starts with its space
        if m.text[i][:1] == b" " and word:
            seen[tuple(word)] = seen.get(tuple(word), 0) + 1
            word = []
        word.append(i)
    assert len(seen) > 20
    merges = len(" international") - len(plain)
    assert seen[tuple(plain)] / 4000 > (1 - pieces.DROPOUT) ** merges  # other merges lead to the same pieces as well
    memo, texts, keys = pieces.Memo(), [text[:700], "a communication, " * 50, None, text[:700]], [1, 2, 3, 4]
    first, again = (pieces.encode_texts(m, texts, keys, 0.2, 3, memo=memo) for _ in range(2))
    long_way = pieces.LONG
    try:
        pieces.LONG = 2  # nothing is remembered
        b = pieces.encode_texts(m, texts, keys, 0.2, 3)
    finally:
        pieces.LONG = long_way
    assert [x.tolist() for x in first] == [x.tolist() for x in again] == [x.tolist() for x in b]
    assert first[0].tolist() != first[3].tolist()


def test_id_files(spark, docs):
    t = Tokenizer.from_file(WORDS)
    d = docs.select("doc_id", "text")
    folder = id_files.write(d, WORDS)
    got = id_files.read(spark, folder).orderBy("start").collect()
    assert len(got) == d.count() and got[0].doc_id is None
    expected = {}
    for r in d.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for r in got:
        assert (r.n_tokens, r.ids_crc32) in expected[r.doc_id] and r.start == start
        start += r.n_tokens
    assert [x.tolist() for x in id_files.lookup(spark, folder, 4)] == [t.encode(TEXTS[4], add_special_tokens=False).ids + [1]]
    assert id_files.read(spark, id_files.write(d.limit(0), WORDS)).count() == 0


def test_media(spark, docs):
    out = {r.doc_id: r for r in mpeg_audio.stored_features(docs).collect() if r.doc_id != 3}
    for i, t in enumerate(TEXTS):
        if i != 3:
            n, payload = mpeg_audio.padded(t)
            assert out[i].n_bytes == n and out[i].payload_bytes == len(payload) and out[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and out[i].tail_crc32 == zlib.crc32(payload[-16:])
    assert out[7].feature == out[8].feature and out[7].media_sha256 == out[8].media_sha256
    assert mpeg_audio.stored_features(docs.limit(0)).count() == 0
    rng = random.Random(9)
    data = mpeg_audio.pack(rng.randbytes(20000))
    s = mpeg_audio.parse(data)
    assert s.samples == 1152 * len(s.body) and s.table["frames"] == len(s.body) and s.damaged == s.skipped == 0
    cut = s.offsets[4]
    torn = mpeg_audio.parse(data[:cut] + b"\xff\xfbjunk" + data[cut:])
    assert torn.skipped == 6 and len(torn.offsets) == len(s.offsets)
    flipped = bytearray(data)
    flipped[cut + 12] ^= 64
    assert mpeg_audio.parse(bytes(flipped)).damaged == 1


def test_media_holds_tag_at_each_place():
    for n in (192, 384):
        for at in range(n - 2):
            payload = (b"x" * at + b"TAG").ljust(n, b"y")
            s = mpeg_audio.parse(data := mpeg_audio.pack(payload))
            assert mpeg_audio.unpack(data, s) == payload and s.skipped == 0 and set(s.tags) == {"payload"}
    tag = b"TAG" + b"title".ljust(30, b"\0") + b"artist".ljust(30, b"\0") + bytes(65)
    data = mpeg_audio.pack(b"x" * 500)
    for whole in (data, data[:-9], data + b"junk"):  # the tag counts after whole frames, after a cut one, and after bytes of no frame
        s = mpeg_audio.parse(whole + tag)
        assert (s.tags["TIT2"], s.tags["TPE1"]) == ("title", "artist") and len(s.body) == len(mpeg_audio.parse(whole).body)


def test_media_checksums_of_layers_one_and_two():
    def crc(bits):
        v = 0xFFFF
        for b in bits:
            v = (v << 1 & 0xFFFF) ^ (0x8005 if (v >> 15) ^ int(b) else 0)
        return v

    rng = random.Random(5)
    # header, allocations by hand (bits of each band, channels that share it) and whether scale factors are chosen
    kinds = [
        (bytes([0xFF, 0xFE, 0x80, 0xC0]), [(4, 1)] * 32, False),  # layer I, mono
        (bytes([0xFF, 0xFE, 0x80, 0x50]), [(4, 1)] * 16 + [(4, 2)] * 24, False),  # layer I, joint stereo from band 8
        (bytes([0xFF, 0xFC, 0xA0, 0x00]), [(4, 1)] * 22 + [(3, 1)] * 24 + [(2, 1)] * 14, True),  # layer II, stereo, 192 kbit/s: 30 bands
        (bytes([0xFF, 0xFC, 0x80, 0x40]), [(4, 1)] * 8 + [(4, 2)] * 7 + [(3, 2)] * 12 + [(2, 2)] * 4, True),  # layer II, joint stereo from band 4, 128 kbit/s: 27 bands
        (bytes([0xFF, 0xFC, 0x10, 0xC0]), [(4, 1)] * 2 + [(3, 1)] * 6, True),  # layer II, mono, 32 kbit/s: 8 bands
        (bytes([0xFF, 0xF4, 0x80, 0xC0]), [(4, 1)] * 4 + [(3, 1)] * 7 + [(2, 1)] * 19, True),  # MPEG-2 layer II, mono
    ]
    for head, allocations, chosen in kinds:
        h = mpeg_audio.header(head)
        bits, extra = "", 0
        for n, channels in allocations:
            v = rng.randrange(1 << n) * rng.randrange(2)
            bits += f"{v:0{n}b}"
            extra += 2 * channels * (v > 0)
        bits += "".join(rng.choice("01") for _ in range(extra * chosen))
        value = crc(f"{int.from_bytes(head[2:], 'big'):016b}" + bits)
        body = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
        frame = (head + value.to_bytes(2, "big") + body).ljust(h.size, b"\xaa")
        assert len(frame) == h.size
        s = mpeg_audio.parse(frame * 3)
        assert (len(s.offsets), s.checked, s.damaged) == (3, 3, 0)
        flipped = bytearray(frame * 3)
        flipped[h.size + 6 + (len(bits) - 1) // 8] ^= 0x80 >> (len(bits) - 1) % 8
        assert mpeg_audio.parse(bytes(flipped)).damaged == 1


def test_chat_pairs(spark):
    schema = "pair_id long, turn long, role string, text string, extra int"
    c = spark.createDataFrame([(1, 0, "user", "hi", 1), (1, 1, "assistant", "yes", 1), (2, 0, "user", None, 1), (3, 0, "user", "q", 1), (3, 0, "user", "q", 1), (None, 0, "user", "z", 1)], schema)
    r = spark.createDataFrame([(1, 0, "user", "hi", 1), (1, 1, "assistant", "no!", 1), (4, 0, "assistant", "é", 1), (3, 0, "user", "q", 1)], schema)
    got = {x.pair_id: x for x in chat.format_pairs(c, r).collect()}
    one = got[1]
    assert one.prompt_turns == 1 and one.prompt == "<|user|>\nhi<|end|>\n" and one.chosen == "<|assistant|>\nyes<|end|>\n"
    a, b = map(int, one.rejected_mask.split(":"))
    assert one.rejected[a:b] == "no!<|end|>\n"
    assert got[2].rejected == "" and got[2].chosen == "<|user|>\n<|end|>\n" and got[2].chosen_mask == ""
    assert got[3].prompt_turns == 1 and got[3].rejected == "" and got[4].prompt == "" and None in got
    assert chat.format_pairs(c.limit(0), r.limit(0)).count() == 0
