"""Media columns: MPEG audio.

parse() walks a stream of any MPEG audio version and layer: it skips and reads ID3 tags, finds the first header that another one follows,
reads the variable-bitrate table, verifies each frame's checksum, and resynchronises after damage. It stores the exact number of samples
and every frame's offset, so that any second can be sought without reading what is before.

pack() writes bytes losslessly: a valid layer III stream of silent frames, whose space for main data carries the payload as ancillary data,
with a tag that holds its length, a variable-bitrate table and checksums. unpack() gives the payload back. The unit is the frame.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import slices, stage

# Fixed values of the format: kbit/s by index for MPEG-1 layers I, II, III and MPEG-2 layers I, II and III; Hz; samples in a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
UNIT = 192


@dataclass(frozen=True)
class Header:
    version: int  # as in the header: 3 MPEG-1, 2 MPEG-2, 0 MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        return ((17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)) if self.layer == 3 else 0


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """Header in four bytes; None if they are none (free bitrate is not taken)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    index, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    kbps = BITRATES[(1, layer) if version == 3 else (2, min(layer, 2))][index]
    hertz = RATES[version][rate]
    pad = raw[2] >> 1 & 1
    if layer == 1:
        size, samples = (12000 * kbps // hertz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * 1000 * kbps // hertz + pad
    return Header(version, layer, not raw[1] & 1, kbps, hertz, raw[3] >> 6 == 3, size, samples)


_CRC = [0] * 256
for _i in range(256):
    _v = _i << 8
    for _ in range(8):
        _v = (_v << 1 ^ (0x8005 if _v & 0x8000 else 0)) & 0xFFFF
    _CRC[_i] = _v


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, all ones first."""
    v = 0xFFFF
    for b in data:
        v = (v << 8 & 0xFFFF) ^ _CRC[v >> 8 ^ b]
    return v


def _crc_bits(data: bytes, n: int) -> int:
    """crc16 of the first n bits."""
    v = crc16(data[: n // 8])
    for i in range(n % 8):
        v = v << 1 ^ (0x8005 if (v >> 15 ^ data[n // 8] >> 7 - i) & 1 else 0)
    return v & 0xFFFF


def _bands(h: Header, mode: int) -> tuple[int, ...]:
    """Bits of an allocation in each band (layers I and II)."""
    if h.layer == 1:
        return (4,) * 32
    if h.version != 3:
        return (4,) * 4 + (3,) * 7 + (2,) * 19
    kbps = h.kbps if mode == 3 else h.kbps // 2
    if kbps < 56:
        return (4,) * 2 + (3,) * (10 if h.rate == 32000 else 6)
    return (4,) * 11 + (3,) * 12 + (2,) * (7 if kbps >= 96 and h.rate != 48000 else 4)


def checksum(frame: bytes, h: Header) -> int:
    """What a protected frame's checksum must be: over half the header and the side information (layer III), the allocations (layer I), or these and
    the choices of scale factors (layer II)."""
    if h.layer == 3:
        return crc16(frame[2:4] + frame[6 : 6 + h.side])
    mode, both = frame[3] >> 6, 4 * (frame[3] >> 4 & 3) + 4  # joint stereo has one allocation for two channels from this band on
    channels = 1 if mode == 3 else 2
    bits, at, chosen = int.from_bytes(frame[6 : 6 + 48].ljust(48, b"\0"), "big"), 0, 0
    for i, n in enumerate(_bands(h, mode)):
        for _ in range(1 if channels == 1 or mode == 1 and i >= both else 2):
            if bits >> 384 - at - n & (1 << n) - 1:
                chosen += channels if mode == 1 and i >= both else 1
            at += n
    return _crc_bits(frame[2:4] + frame[6 : 6 + 48].ljust(48, b"\0"), 16 + at + (2 * chosen if h.layer == 2 else 0))


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of each frame, the table's included
    samples: int = 0  # without the table's frame
    rate: int = 0
    checked: int = 0
    damaged: int = 0  # frames whose checksum is wrong
    skipped: int = 0  # bytes that belong to no frame or tag
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None  # of a variable bitrate: frames, bytes, toc
    body: list[tuple[int, int]] = field(default_factory=list)  # where each frame's main data is
    kbps: set = field(default_factory=set)

    @property
    def seconds(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _tag(data: bytes, at: int, tags: dict[str, str]) -> int:
    """End of an ID3v2 tag at a place; its text frames go to tags."""
    size = (data[at + 6] & 127) << 21 | (data[at + 7] & 127) << 14 | (data[at + 8] & 127) << 7 | data[at + 9] & 127
    end, p, plain = at + 10 + size, at + 10, data[at + 3] < 4
    while p + 10 <= min(end, len(data)) and data[p]:
        raw = data[p + 4 : p + 8]
        n = int.from_bytes(raw, "big") if plain else sum((b & 127) << 21 - 7 * i for i, b in enumerate(raw))
        name, body = data[p : p + 4].decode("latin-1"), data[p + 10 : p + 10 + n]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            if name == "TXXX":
                name, _, text = text.partition("\0")
            tags[name] = text
        p += 10 + n
    return end + (10 if data[at + 5] & 16 else 0)


def _vbr(data: bytes, at: int, h: Header) -> dict | None:
    x = at + 4 + 2 * h.protected + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(data[x + 4 : x + 8], "big")
        p, out = x + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[p : p + 4], "big")
                p += 4
        if flags & 4:
            out["toc"] = data[p : p + 100]
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        return {"bytes": int.from_bytes(data[x + 10 : x + 14], "big"), "frames": int.from_bytes(data[x + 14 : x + 18], "big")}
    return None


def parse(data: bytes) -> Stream:
    """Everything about a stream; damaged or foreign bytes are skipped and counted, never an error."""
    out = Stream()
    at, stop = 0, len(data)
    last = stop - 128 if data[max(0, stop - 128) : stop - 125] == b"TAG" else stop  # an ID3v1 tag, unless a frame holds this place
    locked = None
    while at < stop:
        if data[at : at + 3] == b"ID3" and at + 10 <= stop:
            at = _tag(data, at, out.tags)
            continue
        h = header(data[at : at + 4])
        fits = h is not None and at + h.size <= stop
        if fits and (locked is None or (h.version, h.layer, h.rate) != locked or at <= last < at + h.size):
            # a first header, one after damage, or one whose frame holds what looks like a tag, counts only if another follows, or the end
            after = at + h.size
            nxt = header(data[after : after + 4])
            fits = after in (last, stop) or data[after : after + 3] == b"ID3" or (nxt is not None and (nxt.version, nxt.layer, nxt.rate) == (h.version, h.layer, h.rate))
        if not fits and at == last:
            for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
                if value := data[at + a : at + b].decode("latin-1").rstrip("\0 "):
                    out.tags[name] = value
            break
        if not fits:
            ahead = data.find(b"\xff", at + 1, stop)
            tag = data.find(b"ID3", at + 1, ahead if ahead >= 0 else stop)
            ahead = tag if tag >= 0 else ahead if ahead >= 0 else stop
            if at < last < ahead:
                ahead = last
            out.skipped += ahead - at
            at, locked = ahead, None
            continue
        locked = (h.version, h.layer, h.rate)
        start = at + 4
        if h.protected:
            start += 2
            out.checked += 1
            if checksum(data[at : at + h.size], h) != int.from_bytes(data[at + 4 : at + 6], "big"):
                out.damaged += 1
        start += h.side
        table = _vbr(data, at, h) if not out.offsets else None
        if table is not None:
            out.table = table
        else:
            out.samples += h.samples
            out.body.append((start, at + h.size))
        out.offsets.append(at)
        out.kbps.add(h.kbps)
        out.rate = h.rate
        at += h.size
    return out


def _frame(index: int, body: bytes, pad: bool = False) -> bytes:
    """A silent mono MPEG-1 layer III frame at 44.1 kHz with checksum; body fills its main data."""
    head = bytes([0xFF, 0xFA, index << 4 | pad << 1, 0xC0])
    side = bytes(17)
    size = header(head).size
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side + body.ljust(size - 23, b"\0")


_ROOM = {i: header(bytes([0xFF, 0xFA, i << 4, 0xC0])).size - 23 for i in range(1, 15)}


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def pack(payload: bytes) -> bytes:
    """A stream that carries payload."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        index = next((i for i, room in _ROOM.items() if room >= left), 14)
        frames.append(_frame(index, payload[at : at + _ROOM[index]]))
        at += _ROOM[index]
    sizes = [len(f) for f in frames]
    first = len(_frame(6, b""))
    total = first + sum(sizes)
    toc, seen, k = bytearray(), first, 0
    for percent in range(100):
        while k < len(sizes) and k * 100 < percent * len(sizes):
            seen += sizes[k]
            k += 1
        toc.append(min(255, seen * 256 // total))
    vbr = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + bytes(toc)
    text = b"\3payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + _synchsafe(len(tag)) + tag + _frame(6, vbr) + b"".join(frames)


def unpack(data: bytes, stream: Stream | None = None) -> bytes | None:
    """The payload of a stream of pack(); None for one without its tag, or with less main data than that says."""
    s = stream or parse(data)
    length, raw = s.tags.get("payload", ""), b"".join([data[a:b] for a, b in s.body])
    return raw[: int(length)] if length.isascii() and length.isdecimal() and int(length) <= len(raw) else None


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of a text's bytes, and these with spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for every row of docs (doc_id, text); null texts count as empty, equal texts (repeated rows too) have equal media.

    Long texts are stored whole, in as many frames as they need. An empty table gives no rows. Other columns are not read, whatever their names."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                made = [padded(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([pack(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, samples long, sample_rate int, seconds double, offsets array<long>"


def read(media: DataFrame) -> DataFrame:
    """What the stored streams of media (doc_id, n_bytes, media) hold: payload digests, exact duration, frame offsets, and a feature string.

    Any bytes can be read. Null media have null in all columns but doc_id and n_bytes. Foreign streams, and bytes without a frame, have null payload columns; the others
    say what was found (no frames: 0 samples, 0 seconds, no offsets). Rows are taken one by one: equal media have equal values.
    """

    def one(doc, n, data):
        if data is None:
            return (doc, n, *[None] * 11)
        s = parse(data)
        payload = unpack(data, s)
        good = s.table is not None and s.table.get("frames") == len(s.body) and s.table.get("bytes") == len(data) - s.offsets[0]
        feature = f"frames={len(s.body)};samples={s.samples};rate={s.rate};kbps={min(s.kbps, default=0)}-{max(s.kbps, default=0)};checked={s.checked};damaged={s.damaged};skipped={s.skipped};table={'ok' if good else 'bad'}"
        held = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        return (doc, n, *held, len(data), hashlib.sha256(data).hexdigest(), feature, len(s.body), s.samples, s.rate, s.seconds, s.offsets)

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64())]
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            for b in slices(batch, "media"):
                rows = [one(*r) for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return media.mapInArrow(run, READ)


def stored_features(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored table back, and give what it holds."""
    return read(stage(store(docs), "media"))
