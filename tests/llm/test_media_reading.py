"""Reading of media that pack() did not make, that are empty, null or torn."""

import random

from strandlake.llm import mpeg_audio
from strandlake.llm.queries import op3_mpeg_audio

SCHEMA = "doc_id long, n_bytes long, media binary"


def test_any_bytes_can_be_read(spark):
    rng = random.Random(4)
    whole = mpeg_audio.pack(b"payload" * 300)
    frames = whole[mpeg_audio.parse(whole).offsets[1] :]  # no tag, no table
    tag = b"ID3\4\0\0" + mpeg_audio._synchsafe(30) + b"TXXX" + mpeg_audio._synchsafe(12) + b"\0\0\3payload\0abc" + bytes(8)
    media = [None, b"", b"\xff", b"ID3", b"TAG", b"x" * 1000, frames, tag + frames, whole[:700], whole[300:], *(rng.randbytes(2000) for _ in range(20)), *(bytes([0xFF, 0xFA, rng.randrange(256), 0xC0]) * 200 for _ in range(20))]
    rows = {r.doc_id: r for r in mpeg_audio.read(spark.createDataFrame([(i, 7, m) for i, m in enumerate(media)], SCHEMA)).collect()}
    assert len(rows) == len(media)
    assert rows[0].media_sha256 is None and rows[0].offsets is None
    assert (rows[1].n_frames, rows[1].seconds, rows[1].offsets, rows[1].payload_bytes, rows[1].media_bytes) == (0, 0.0, [], None, 0)
    assert rows[5].n_frames == 0 and "skipped=1000" in rows[5].feature
    assert rows[6].n_frames == 3 and rows[6].payload_sha256 is None and "table=bad" in rows[6].feature
    assert rows[7].n_frames == 3 and rows[7].payload_bytes is None
    assert mpeg_audio.read(spark.createDataFrame([], SCHEMA)).count() == 0


def test_offsets_lead_to_frames(spark, sf_dir):
    docs = spark.createDataFrame([(1, "seek " * 3000, 5), (2, None, 6), (2, None, 6)], "doc_id long, text string, offsets int")
    stored = {r.doc_id: bytes(r.media) for r in mpeg_audio.store(docs).collect()}
    for r in mpeg_audio.stored_features(docs).collect():
        assert len(r.offsets) == r.n_frames + 1  # the table's frame comes first
        assert all(mpeg_audio.header(stored[r.doc_id][o : o + 4]) for o in r.offsets) and r.seconds == r.samples / r.sample_rate
    assert "offsets" in op3_mpeg_audio(spark, sf_dir).columns
