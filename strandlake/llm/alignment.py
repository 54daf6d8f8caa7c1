"""Alignment of the tokens of two tokenizers on the same bytes, and counts of linked ids over the corpus.

Both id lists of a text are turned into cumulative byte ends. A dictionary of each leads from an end to its index; the sorted intersection of both key sets cuts the lists
into groups, and within each slice the overlapping occurrences are expanded to links.

Neither vocabulary joins text across a single space between other characters (`Pair` checks the one, the other cuts there by its pattern). So a text is cut at those
spaces, each unit is encoded and aligned once and remembered, and a document's groups are those of its units, one after another.

Counts: each slice of documents (about SLICE_BYTES of text, or one longer document) gives its distinct id pairs with the number of its documents that hold them; these are added up by
pair, and the highest of each first id is found. Every slice then gets the counts of its own pairs back and adds them up for its documents. So what is shuffled is a row for
each distinct pair of a slice, not for each link of a document; nothing is broadcast, and a task holds one slice.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import stage, unstage

#: Text of a slice at most, if it has more than one document; rows of it.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 4096
#: Units that a worker remembers, and the longest that it does; bytes of new units that are encoded at once.
MEMO, LONGEST, BATCH = 1 << 18, 64, 1 << 15
CUT = re.compile(r"(?<=\S) (?=\S)")
MARK = "▁"
_BITS = 32


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest as letters from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def groups(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each list end at or before each end that both share, in order: where slices of both lists are cut."""
    at_a, at_b = dict(zip(a, range(1, len(a) + 1))), dict(zip(b, range(1, len(b) + 1)))
    shared = sorted(at_a.keys() & at_b.keys())
    return list(map(at_a.__getitem__, shared)), list(map(at_b.__getitem__, shared))


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of all pairs of tokens whose byte ranges overlap, and where each overlap ends; a and b are cumulative ends.

    Within a slice every end of either list closes one overlap: of the tokens that cover the byte before it.
    """
    ends = np.union1d(a, b)
    return np.searchsorted(a, ends), np.searchsorted(b, ends), ends


class Unit(NamedTuple):
    """Groups of a unit as text, numbers of tokens and groups, and the linked ids (first id << 32 | second id, one for each link)."""

    text: str
    n_a: int
    n_b: int
    n_groups: int
    pairs: np.ndarray


class Pair:
    """A byte-level vocabulary and one of pieces, with the bytes of every token."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        letters = byte_of_letter()
        self.bytes_a = [bytes(letters[c] for c in self.a.id_to_token(i)) if all(c in letters for c in self.a.id_to_token(i) or "") else b"" for i in range(self.a.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in names):
            raise ValueError("a vocabulary with pieces across spaces")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # an id and what comes after it in the text of groups
        self.written = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"]
        self.known: dict[str, Unit | None] = {}

    def _aligned(self, raw: bytes, stops: np.ndarray) -> list[Unit] | None:
        """Units of bytes that begin with a space, cut where stops (the last is their length) tell; None if tokens of either vocabulary don't give the bytes back, or cross a stop."""
        text = raw.decode()
        a, b = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64), np.array(self.b.encode(text[1:]), np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != raw:
            return None
        ends_a, ends_b = self.length_a[a].cumsum(), self.length_b[b].cumsum()
        to_a, to_b = (np.array(x, np.int64) for x in groups(ends_a.tolist(), ends_b.tolist()))
        last = np.searchsorted(ends_a[to_a - 1], stops)  # the group that ends at each stop
        if (ends_a[to_a[last] - 1] != stops).any():
            return None
        # groups as text: first ids of a group, then second ids; each has its place among all
        group_a, group_b = np.searchsorted(to_a, np.arange(len(a)), side="right"), np.searchsorted(to_b, np.arange(len(b)), side="right")
        before_b = np.concatenate([[0], to_b[:-1]])
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b[group_a]] = 3 * a
        order[to_a - 1 + before_b] += 1
        order[np.arange(len(b)) + to_a[group_b]] = 3 * b
        order[to_a + to_b - 1] += 2
        words = list(map(self.written.__getitem__, order.tolist()))
        x, y, closed = links(ends_a, ends_b)
        pairs = a[x] << _BITS | b[y]
        cut = np.searchsorted(closed, stops, side="right").tolist()
        up_a, up_b, up_g = to_a[last].tolist(), to_b[last].tolist(), (last + 1).tolist()
        out, p, q, g, k = [], 0, 0, 0, 0
        for u, v, h, c in zip(up_a, up_b, up_g, cut):
            out.append(Unit("".join(words[p + q : u + v])[:-1], u - p, v - q, h - g, pairs[k:c]))
            p, q, g, k = u, v, h, c
        return out

    def _alone(self, word: str) -> Unit | None:
        raw = f" {word}".encode()
        return (self._aligned(raw, np.array([len(raw)])) or [None])[0]

    def _learn(self, words: list[str]) -> list[Unit | None]:
        """Units of words (each without the space that comes before it): those without white space at their ends together, all others one by one."""
        out: list[Unit | None] = [None] * len(words)
        part: list[int] = []
        size = 0
        for i, w in enumerate(words):
            if not w or w[0].isspace() or w[-1].isspace() or MARK in w:
                out[i] = self._alone(w)
                continue
            part.append(i)
            size += len(w)
            if size >= BATCH:
                self._together(words, part, out)
                part, size = [], 0
        if part:
            self._together(words, part, out)
        return out

    def _together(self, words: list[str], part: list[int], out: list[Unit | None]) -> None:
        raw = [f" {words[i]}".encode() for i in part]
        made = self._aligned(b"".join(raw), np.cumsum([len(r) for r in raw])) or [self._alone(words[i]) for i in part]
        for i, u in zip(part, made):
            out[i] = u

    def units(self, unique: list[str]) -> list[Unit | None]:
        """The unit of each of different words; short ones are remembered while there is room."""
        out = list(map(self.known.get, unique))
        new = [i for i, u in enumerate(out) if u is None and unique[i] not in self.known]
        for i, u in zip(new, self._learn([unique[i] for i in new])):
            out[i] = u
            if len(unique[i]) <= LONGEST and len(self.known) < MEMO:
                self.known[unique[i]] = u and u._replace(pairs=u.pairs.copy())
        return out


@lru_cache(maxsize=2)
def pair(byte_level: str, pieces: str) -> Pair:
    """One for all tasks of a worker."""
    return Pair(byte_level, pieces)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start and length."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _aligned(p: Pair, texts: list[str | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: columns by document; distinct pairs, number of documents with each; and by document the end, places of its pairs among them, and how often."""
    words, ends = [], []
    for t in texts:
        if t:
            words += CUT.split(t)
        ends.append(len(words))
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    units = p.units(list(number))
    which = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    fine = np.array([u is not None for u in units], bool)
    none = Unit("", 0, 0, 0, np.zeros(0, np.int64))
    units = [u or none for u in units]
    of_doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    kept = np.bincount(of_doc, minlength=len(ends)) > 0  # documents with tokens
    kept[of_doc[~fine[which]]] = False
    many = np.array([len(u.pairs) for u in units], np.int64)
    distinct, place = np.unique(np.concatenate([u.pairs for u in units]) if units else np.zeros(0, np.int64), return_inverse=True)
    counted = kept[of_doc]
    which_kept, doc_kept = which[counted], of_doc[counted]
    sums = [np.bincount(doc_kept, np.array(v, np.int64)[which_kept], len(ends)).astype(np.int64) if units else np.zeros(len(ends), np.int64) for v in ([u.n_a for u in units], [u.n_b for u in units], [u.n_groups for u in units], many)]
    cols: dict[str, list] = dict(zip(("n_a", "n_b", "n_groups", "n_links"), (v.tolist() for v in sums)))
    texts_of, sha, start = [u.text for u in units], [], 0
    for end, fits in zip(ends, kept.tolist()):
        sha.append(hashlib.sha256(";".join([texts_of[i] for i in which[start:end].tolist()]).encode()).hexdigest() if fits else "")
        start = end
    cols["groups_sha256"] = sha
    size = max(1, len(distinct))
    lengths = many[which_kept]
    keys = np.repeat(doc_kept, lengths) * size + place[_runs((np.cumsum(many) - many)[which_kept], lengths)]
    both, often = np.unique(keys, return_counts=True)
    doc, place = both // size, both % size
    docs = np.bincount(place, minlength=len(distinct))
    if (docs == 0).any():  # pairs of documents that have no alignment only
        left = np.flatnonzero(docs)
        distinct, docs, place = distinct[left], docs[left], np.searchsorted(left, place)
    return cols, distinct, docs, np.searchsorted(doc, np.arange(len(ends)), side="right"), place, often


_DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
_SLICED = "slice string, " + ", ".join(f"{c} array<long>" for c in _DOC) + ", groups_sha256 array<string>, ends array<int>, places binary, often binary, pairs array<long>, docs array<int>"
_SLICED_ARROW = pa.schema([("slice", pa.string()), *((c, pa.list_(pa.int64())) for c in _DOC), ("groups_sha256", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())), ("places", pa.binary()), ("often", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))])
_RESULT = [*_DOC, "n_best", "count_sum", "groups_sha256"]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= SLICE_ROWS or total + n > SLICE_BYTES):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows:
        yield batch.slice(start)


def align(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text; other columns are not read, whatever their names), from staged tables.

    byte_level and pieces are the files of both vocabularies. A text that is null or empty, or whose tokens of either vocabulary don't give its bytes back (a literal U+2581), has
    no tokens: zeros, and an empty groups_sha256. Rows are documents of their own: repeated rows and rows with a null doc_id count each. Very long texts are one slice. An
    empty table gives no rows.
    """

    def encode(batches):
        p = None
        for batch in batches:
            for b in _slices(batch):
                p = p or pair(byte_level, pieces)
                cols, distinct, held, ends, places, often = _aligned(p, b.column("text").to_pylist())
                values = [uuid.uuid4().hex, b.column("doc_id"), *(cols[c] for c in (*_DOC[1:], "groups_sha256")), ends, np.diff(places, prepend=0).astype("<i4").tobytes(), often.astype("<i4").tobytes(), distinct, held]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SLICED_ARROW)], schema=_SLICED_ARROW)

    sliced = stage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, _SLICED), "aligned")
    asks = sliced.select("slice", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select("slice", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = asks.groupBy("pair").agg(F.sum("docs").alias("n"))
    first = F.shiftright("pair", _BITS)
    counts = stage(counts.withColumn("first", first), "pair-counts")
    highest = counts.groupBy("first").agg(F.max("n").alias("highest"))
    # a table of its own, so that Spark can split a pair of very many slices in the join
    known = stage(counts.join(highest, "first").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-best")
    told = asks.join(known, "pair").groupBy("slice").agg(F.collect_list(F.struct("place", "n", "best")).alias("told"))
    whole = sliced.drop("pairs", "docs").join(told, "slice", "left")

    def add_up(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                row = {c: b.column(c)[0] for c in b.schema.names}
                ends = np.asarray(row["ends"].values)
                n, best = np.zeros(0, np.int64), np.zeros(0, bool)
                if row["told"].is_valid and len(row["told"]):
                    got = row["told"].values
                    at = np.asarray(got.field("place"))
                    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                    n[at], best[at] = np.asarray(got.field("n")), got.field("best").to_numpy(zero_copy_only=False)
                places, often = np.cumsum(np.frombuffer(row["places"].as_py(), "<i4")), np.frombuffer(row["often"].as_py(), "<i4").astype(np.int64)
                sums = [np.concatenate([[0], np.cumsum(v)])[np.concatenate([[0], ends])] for v in (best[places] * often, n[places] * often)]
                cols = [row[c].values for c in _DOC] + [pa.array(np.diff(s), pa.int64()) for s in sums] + [row["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays(cols, names=_RESULT)

    out = stage(whole.mapInArrow(add_up, ", ".join(f"{c} long" for c in _RESULT[:-1]) + ", groups_sha256 string"), "linked")
    for t in (sliced, counts, known):
        unstage(t)
    return out
