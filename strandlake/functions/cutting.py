"""Texts to strands in Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The four bases of each byte, high bits first.
FOUR = np.array([[ord("ACGT"[b >> s & 3]) for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)
#: Bytes of text that are cut at a time.
PART = 1 << 20


def _cuts(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: their bytes, and for each strand of so many bytes its row, number, start and stop. Null and empty texts have none."""
    column = column.cast(pa.binary())
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    n_bytes = np.diff(bounds)
    if column.null_count:
        n_bytes[np.asarray(column.is_null())] = 0
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = np.repeat(np.arange(len(column)), -(-n_bytes // size))
    chunk = np.arange(len(row)) - np.searchsorted(row, row)
    start = bounds[:-1][row] + chunk * size
    return raw, row, chunk, start, np.minimum(start + size, (bounds[:-1] + n_bytes)[row])


def cut_batches(batches: Iterator[pa.RecordBatch], text: str, length: int) -> Iterator[pa.RecordBatch]:
    """A row for each strand of so many bases (the last may be shorter) of each text, with its number and the other columns; in parts of bounded size."""
    size = length // 4
    for batch in batches:
        others = [i for i, n in enumerate(batch.schema.names) if n != text]
        raw, row, chunk, start, stop = _cuts(batch.column(text), size)
        step = max(1, PART // size)
        for i in range(0, len(row), step):
            a, n = start[i : i + step], (stop - start)[i : i + step]
            ends = np.append(0, np.cumsum(n))
            at = np.repeat(a - ends[:-1], n) + np.arange(ends[-1])
            made = pa.StringArray.from_buffers(len(a), pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(FOUR[raw[at]].tobytes()))
            which = pa.array(row[i : i + step])
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(which) for j in others), pa.array(chunk[i : i + step].astype(np.int32)), made], names=[*(batch.schema.names[j] for j in others), "chunk", "strand"])


#: Of each byte: how many of its bases are G or C, and the runs of one base at its start, at its end and within.
GC_OF = np.isin(FOUR, [ord("G"), ord("C")]).sum(1).astype(np.uint8)
_SAME = FOUR[:, 1:] == FOUR[:, :-1]
HEAD, TAIL = (1 + np.cumprod(s, 1).sum(1).astype(np.uint8) for s in (_SAME, _SAME[:, ::-1]))
WITHIN = np.maximum.reduce([HEAD, TAIL, np.where(_SAME[:, 1], 2, 1).astype(np.uint8)])


def shapes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest run of one base and the number of G and C of each strand, from its bytes: a step for each of the size bytes, over all strands at once."""
    longest, tail, gc, last = (np.zeros(len(start), np.uint8 if size < 64 else np.int32) for _ in range(4))
    whole = len(raw) - 1
    for k in range(size):
        here = start + k < stop
        b = raw[np.minimum(start + k, whole)]
        # a byte goes on with the run before it if its first base is the last one's
        on = np.where((b >> 6) == last, tail, 0) + HEAD[b] if k else HEAD[b]
        longest = np.where(here, np.maximum.reduce([longest, on, WITHIN[b]]), longest)
        tail = np.where(HEAD[b] == 4, on, TAIL[b]).astype(tail.dtype)
        gc += np.where(here, GC_OF[b], 0).astype(gc.dtype)
        last = b & 3
    return longest.astype(np.int32), gc.astype(np.int32)


def shape_batches(batches: Iterator[pa.RecordBatch], text: str, length: int) -> Iterator[pa.RecordBatch]:
    """Like cut_batches(), with each strand's longest run, number of G and C, and length in place of its letters."""
    size = length // 4
    for batch in batches:
        others = [i for i, n in enumerate(batch.schema.names) if n != text]
        raw, row, chunk, start, stop = _cuts(batch.column(text), size)
        step = max(1, PART // size)
        for i in range(0, len(row), step):
            a, z = start[i : i + step], stop[i : i + step]
            which = pa.array(row[i : i + step])
            made = [chunk[i : i + step].astype(np.int32), *shapes(raw, a, z, size), (4 * (z - a)).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(which) for j in others), *map(pa.array, made)], names=[*(batch.schema.names[j] for j in others), "chunk", "run", "gc", "length"])


def count_shapes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(group, run, gc, length, n) of batches (group, text): how many of a batch's strands have a shape."""
    for batch in batches:
        groups = batch.column("group").dictionary_encode(null_encoding="encode")
        for b in shape_batches(iter([pa.RecordBatch.from_arrays([groups.indices, batch.column("text")], names=["group", "text"])]), "text", length):
            parts, wide = [np.asarray(b.column(c)).astype(np.int64) for c in ("group", "run", "gc", "length")], length + 1
            key, n = np.unique(((parts[0] * wide + parts[1]) * wide + parts[2]) * wide + parts[3], return_counts=True)
            out = []
            for _ in range(3):
                key, rest = np.divmod(key, wide)
                out.append(pa.array(rest.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(key)), *out[::-1], pa.array(n)], names=["group", "run", "gc", "length", "n"])


def count_cut_kmers(batches: Iterator[pa.RecordBatch], ks: tuple[int, ...], length: int) -> Iterator[pa.RecordBatch]:
    """(group, k, kmer, n) of batches (group, text): what count_kmers() gives for the texts' strands, for k of at most 5, from how often each byte and each pair of bytes that follow
    one another within a strand occurs: a k-mer lies within two bytes."""
    if max(ks) > 5:
        raise ValueError(f"k-mers of {max(ks)} letters don't lie within two bytes")
    size = length // 4
    for batch in batches:
        groups = batch.column("group").dictionary_encode(null_encoding="encode")
        raw, row, _, start, stop = _cuts(batch.column("text"), size)
        group = np.asarray(groups.indices)[row]
        order = np.argsort(group, kind="stable")
        borders = np.searchsorted(group[order], np.arange(len(groups.dictionary) + 1))
        out: list[tuple] = []
        for g in range(len(groups.dictionary)):
            single, double = np.zeros(1 << 8, np.int64), np.zeros(1 << 16, np.int64)
            mine = order[borders[g] : borders[g + 1]]
            a, z = start[mine], stop[mine]
            step = max(1, PART // size)
            for i in range(0, len(a), step):
                n = (z - a)[i : i + step]
                ends = np.cumsum(n)
                b = raw[np.repeat(a[i : i + step] - (ends - n), n) + np.arange(ends[-1])].astype(np.uint16)
                single += np.bincount(b, minlength=1 << 8)
                pairs = (b[:-1] << 8) | b[1:]
                pairs = np.delete(pairs, ends[:-1] - 1)
                double += np.bincount(pairs, minlength=1 << 16)
            which = [(bases, np.flatnonzero(seen), seen[seen > 0]) for bases, seen in ((4, single), (8, double))]
            for k in ks:
                found = np.zeros(4**k, np.int64)
                for bases, at_all, seen in which:
                    for at in range(4):
                        if at + k <= bases and (bases == 4 or at + k > 4):
                            np.add.at(found, at_all >> 2 * (bases - at - k) & (4**k - 1), seen)
                out += [(g, k, "".join("ACGT"[x >> 2 * p & 3] for p in range(k - 1, -1, -1)), c) for x, c in enumerate(found.tolist()) if c]
        g, k, words, c = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(g, pa.int32())), pa.array(k, pa.int32()), pa.array(words, pa.string()), pa.array(c, pa.int64())], names=["group", "k", "kmer", "n"])


#: The code of each byte: 0 to 3 for A, C, G, T; 4 for all others.
CODE = np.full(256, 4, np.uint8)
CODE[[ord(b) for b in "ACGT"]] = range(4)


def count_kmers(batches: Iterator[pa.RecordBatch], ks: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(group, k, kmer, n) of batches (group, strand): how often each k-mer over A, C, G, T is in a batch's strands of a group; k-mers don't cross strands."""
    for batch in batches:
        column, groups = batch.column("strand"), batch.column("group").dictionary_encode(null_encoding="encode")
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        codes = CODE[np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]].astype(np.int64)
        group = np.repeat(np.asarray(groups.indices), np.diff(bounds))
        # bases from each place to its strand's end
        room = np.repeat(bounds[1:] - bounds[0], np.diff(bounds)) - np.arange(len(codes))
        out: list[tuple] = []
        for k in ks:
            n = max(0, len(codes) - k + 1)
            number, known = np.zeros(n, np.int64), room[:n] >= k
            for j in range(k):
                number = number * 4 + codes[j : j + n]
                known &= codes[j : j + n] < 4
            seen = np.bincount(group[:n][known] * 4**k + number[known])
            out += [(g, k, i, c) for g, i, c in zip(*(x.tolist() for x in (*divmod(np.flatnonzero(seen), 4**k), seen[seen > 0])))]
        g, k, i, c = zip(*out) if out else ((), (), (), ())
        words = ["".join("ACGT"[x >> 2 * p & 3] for p in range(y - 1, -1, -1)) for x, y in zip(i, k)]
        yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(g, pa.int32())), pa.array(k, pa.int32()), pa.array(words, pa.string()), pa.array(c, pa.int64())], names=["group", "k", "kmer", "n"])
