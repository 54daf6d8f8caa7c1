"""Subword encoding and decoding with a SentencePiece BPE model, with seeded merge-dropout.

Adjacent symbols that form a piece are candidates on an agenda, best score first, then leftmost. When a candidate's turn comes, a keyed
hash of (seed, document, place of the word in it, its borders) may skip it for good; without dropout the result is the library's own. Every
occurrence of a word has draws of its own; every result depends on the seed and the document only, not on partitions or order. All segmentations
decode to the text they come from: characters that the model lacks, and the mark that stands for a space, are written as byte pieces.

A slice of documents is cut into words (a run of spaces and what follows) at once. The distinct ones are merged without dropout, together in
arrays, one merge a word and round, and the merges of each are remembered. An occurrence none of whose merges its draws skip has that result, as no other
candidate's turn would have come; all others are merged under their draws. Long words, of which there are few, go through an agenda of their own.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandlake.llm.common import with_arrow_columns
from strandlake.llm.shingles import mix

#: Share of candidates that are skipped, and symbols from which a word has an agenda of its own; words that a task remembers, and words that
#: are merged together.
DROPOUT, LONG = 0.1, 48
MEMO, BLOCK = 1 << 17, 1 << 14
SPACE, MARK = 0x20, 0x2581
NONE = np.int64(1) << np.int64(62)
_PLACE = np.int64(24)  # bits of a place in a word below the rank


class Model:
    """Pieces, byte pieces and merges of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.text = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(chr(MARK), " ").encode() for i in range(n)]
        self.symbol = np.full(0x110000, -1, np.int64)
        for p, i in plain.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[SPACE], self.symbol[MARK] = self.symbol[MARK], -1
        order = sorted(plain.values(), key=lambda i: (-sp.get_score(i), i))
        self.by_rank = np.array(order, np.int64)
        rank = {i: r for r, i in enumerate(order)}
        pairs = {}
        for p, i in plain.items():
            for cut in range(1, len(p)):
                if p[:cut] in plain and p[cut:] in plain:
                    pairs[plain[p[:cut]] * n + plain[p[cut:]]] = rank[i]
        self.n = n
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()] + [0], np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def _borders(start, mid, end):
    """A candidate's borders in one number."""
    return (start.astype(np.uint64) << np.uint64(42)) + (mid.astype(np.uint64) << np.uint64(21)) + end.astype(np.uint64)


def _skips(key, start, mid, end, limit: np.uint64):
    """Whether the keyed hash skips the candidate with these borders."""
    return mix(key + _borders(start, mid, end)) < limit


def _mix_one(x: int) -> int:
    """mix of one number."""
    x &= 2**64 - 1
    x ^= x >> 31
    x = x * 0xD6E8FEB86659FD93 & 2**64 - 1
    x ^= x >> 29
    x = x * 0xC2B2AE3D27D4EB4F & 2**64 - 1
    return x ^ x >> 32


def _priority(m: Model, left, right, key, start, mid, end, limit):
    pair = left * m.n + right
    at = np.searchsorted(m.keys, pair)
    hit = m.keys[np.minimum(at, len(m.keys) - 1)] == pair
    if limit:
        hit[hit] = ~_skips(key[hit], start[hit], mid[hit], end[hit], limit)
    return np.where(hit, (m.ranks[at] << _PLACE) + start, NONE)


def _agenda(m: Model, symbols: list[int], key: int, limit: int) -> list[int]:
    """One word by an agenda in the form of a heap."""
    n = len(symbols)
    symbol, end, before, alive = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    todo: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (r := m.pairs.get(symbol[a] * m.n + symbol[b])) is not None:
            if not limit or _mix_one(key + (a << 42) + (b << 21) + end[b]) >= limit:
                heapq.heappush(todo, (r, a, b, end[b]))

    for i in range(n - 1):
        offer(i)
    while todo:
        r, a, b, e = heapq.heappop(todo)
        if not (alive[a] and b < n and alive[b] and end[a] == b and end[b] == e):
            continue
        symbol[a], end[a], alive[b] = int(m.by_rank[r]), e, False
        if e < n:
            before[e] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [symbol[i] for i in range(n) if alive[i]]


def _merge(m: Model, sym: np.ndarray, off: np.ndarray, size: np.ndarray, key: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged symbols of many words (flat, first symbol of each at off), how many each has, and the borders of its merges in order (flat, as many
    as it has fewer symbols)."""
    done: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    steps: list[np.ndarray] = []
    by: list[np.ndarray] = []
    n_words = len(off)
    ids = np.arange(n_words)
    count = size.copy()
    word = np.repeat(np.arange(len(off)), count)
    start = np.arange(len(sym)) - off[word]
    comp = np.full(len(sym), NONE)
    i = np.flatnonzero(word[:-1] == word[1:]) if len(sym) > 1 else np.zeros(0, int)
    last = start[i + 1] + 1
    comp[i] = _priority(m, sym[i], sym[i + 1], key[word[i]], start[i], start[i + 1], last, limit)
    while len(off):
        best = np.minimum.reduceat(comp, off)
        over = best == NONE
        if over.any():
            gone = np.repeat(over, count)
            done.append(sym[gone])
            owner.append(np.repeat(ids[over], count[over]))
            sym, start, comp = sym[~gone], start[~gone], comp[~gone]
            live = ~over
            ids, count, size, key, best = ids[live], count[live], size[live], key[live], best[live]
            off = np.cumsum(count) - count
            if not len(off):
                break
        w = np.flatnonzero(comp == np.repeat(best, count))
        stop = np.where(w + 2 < off + count, start[np.minimum(w + 2, len(start) - 1)], size)
        steps.append(_borders(start[w], start[w + 1], stop))
        by.append(ids)
        sym[w] = m.by_rank[best >> _PLACE]
        keep = np.ones(len(sym), bool)
        keep[w + 1] = False
        sym, start, comp = sym[keep], start[keep], comp[keep]
        k = np.arange(len(off))
        w -= k
        count = count - 1
        off = np.cumsum(count) - count
        end = off + count
        border = np.append(start, 0)
        for j, has in ((w, w + 1 < end), (w - 1, w > off)):  # the pairs with the new symbol
            a, q = j[has], k[has]
            stop = np.where(a + 2 < end[q], border[np.minimum(a + 2, len(start))], size[q])
            comp[a] = _priority(m, sym[a], sym[a + 1], key[q], start[a], start[a + 1], stop, limit)
        lone = w[w + 1 == end]
        comp[lone] = NONE
    flat, whose, path = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done, owner, steps))
    turn = np.argsort(np.concatenate(by), kind="stable") if by else np.zeros(0, np.int64)
    return flat[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=n_words), path.astype(np.uint64)[turn]


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at, at + 1, ... for each of many runs of n."""
    return np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())


class Memo:
    """Segmentations without dropout of the first MEMO words met, and their merges, for one model (some 15 MB when full)."""

    def __init__(self):
        self.keys, self.pool, self.steps = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
        #: Where a word's ids are and how many, and the same for its merges.
        self.at, self.n, self.path_at, self.path_n = (np.zeros(0, np.int64) for _ in range(4))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and their places."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def add(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray, pool: np.ndarray, path_at: np.ndarray, path_n: np.ndarray, steps: np.ndarray) -> None:
        free = MEMO - len(self.keys)
        keys, at, n, path_at, path_n = keys[:free], at[:free], n[:free], path_at[:free], path_n[:free]
        if len(keys):
            order = np.argsort(np.append(self.keys, keys))
            self.keys = np.append(self.keys, keys)[order]
            self.at, self.n = np.append(self.at, len(self.pool) + np.cumsum(n) - n)[order], np.append(self.n, n)[order]
            self.path_at, self.path_n = np.append(self.path_at, len(self.steps) + np.cumsum(path_n) - path_n)[order], np.append(self.path_n, path_n)[order]
            self.pool, self.steps = np.append(self.pool, pool[_spread(at, n)]), np.append(self.steps, steps[_spread(path_at, path_n)])


def _limit(dropout: float) -> np.uint64:
    return np.uint64(min(int(dropout * 2**64), 2**64 - 1)) if dropout > 0 else np.uint64(0)


def _words(m: Model, texts: list[str | None], keys: list[int | None], seed: int) -> tuple[np.ndarray, ...] | None:
    """Code points and symbols of all texts, where their words begin, how long each is, whose it is, whether it is a character that the model lacks, and what its draws are."""
    full = [" " + t if t else "" for t in texts]
    cp = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(cp):
        return None
    lengths = np.array([len(t) for t in full])
    first = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(texts)), lengths)
    sym = m.symbol[cp]
    odd = sym < 0
    space = cp == SPACE
    cut = odd.copy()  # a word starts here
    cut[1:] |= odd[:-1] | (space[1:] & ~space[:-1])
    cut[first[lengths > 0]] = True
    off = np.flatnonzero(cut)
    owner = doc[off]
    # the draws: a hash of the seed, the document and the word's place there
    number = np.array([(k or 0) & (2**64 - 1) for k in keys], np.uint64)
    nth = (np.arange(len(off)) - np.searchsorted(owner, owner)).astype(np.uint64)
    draw = mix(mix(mix(number + np.uint64(1)) + np.uint64(seed))[owner] + nth)
    return cp, sym, off, np.diff(off, append=len(cp)), owner, odd[off], draw


def _bytes_of(m: Model, cp: int) -> np.ndarray:
    return m.byte[np.frombuffer(chr(cp).encode("utf-8", "surrogatepass"), np.uint8)]


def encode_slowly(m: Model, text: str | None, key: int | None, dropout: float = DROPOUT, seed: int = 0) -> np.ndarray:
    """Ids of one text, each word by an agenda of its own; nothing is remembered, and no word is told from others by a hash."""
    if (w := _words(m, [text], [key], seed)) is None:
        return np.zeros(0, np.int32)
    cp, sym, off, size, _, odd, draw = w
    limit = int(_limit(dropout))
    parts = [_bytes_of(m, int(cp[a])) if o else _agenda(m, sym[a : a + n].tolist(), int(d), limit) for a, n, o, d in zip(off, size, odd, draw)]
    return np.concatenate(parts).astype(np.int32)


def encode_texts(m: Model, texts: list[str | None], keys: list[int | None], dropout: float = DROPOUT, seed: int = 0, memo: Memo | None = None) -> list[np.ndarray]:
    """Ids of each text. keys: a number for each document, on which its draws depend. memo: kept from call to call with the same model."""
    limit = _limit(dropout)
    if (w := _words(m, texts, keys, seed)) is None:
        return [np.zeros(0, np.int32) for _ in texts]
    cp, sym, off, size, owner, odd, draw = w
    # what a word is: a hash of its characters
    place = np.arange(len(cp)) - np.repeat(off, size)
    power = np.cumprod(np.full(int(size.max()), np.uint64(0x9E3779B97F4A7C15)))
    h = mix(np.add.reduceat(mix(cp.astype(np.uint64) + np.uint64(1)) * power[place], off) + size.astype(np.uint64))
    found, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    u_off, u_size = off[index], size[index]
    memo = memo or Memo()
    known, place = memo.find(found)
    got_len, got_at, path_len, path_at = (np.zeros(len(found), np.int64) for _ in range(4))
    got_len[known], got_at[known] = memo.n[place[known]], memo.at[place[known]]
    path_len[known], path_at[known] = memo.path_n[place[known]], memo.path_at[place[known]]
    pool, steps = [memo.pool], [memo.steps]
    base, path_base = len(memo.pool), len(memo.steps)

    def blocks(which: np.ndarray):
        return (which[i : i + BLOCK] for i in range(0, len(which), BLOCK))

    def put(which, count, ids, lens, ats) -> None:
        nonlocal base
        lens[which] = count
        ats[which] = base + np.cumsum(count) - count
        pool.append(ids.astype(np.int32))
        base += len(ids)

    def merged(of_off, of_size, key, limit):
        return _merge(m, sym[_spread(of_off, of_size)], np.cumsum(of_size) - of_size, of_size, key, limit)

    u_odd, u_long = odd[index], u_size >= LONG
    for p in blocks(np.flatnonzero(~u_odd & ~u_long & ~known)):
        flat, count, path = merged(u_off[p], u_size[p], found[p], np.uint64(0))
        put(p, count, flat, got_len, got_at)
        path_len[p] = u_size[p] - count
        path_at[p] = path_base + np.cumsum(path_len[p]) - path_len[p]
        steps.append(path)
        path_base += len(path)
    for i in np.flatnonzero(u_odd & ~known):
        ids = _bytes_of(m, int(cp[u_off[i]]))
        put(np.array([i]), np.array([len(ids)]), ids, got_len, got_at)
    if not limit:
        for i in np.flatnonzero(~u_odd & u_long):
            ids = np.array(_agenda(m, sym[u_off[i] : u_off[i] + u_size[i]].tolist(), 0, 0), np.int64)
            put(np.array([i]), np.array([len(ids)]), ids, got_len, got_at)
    fresh = ~known & ~u_long
    path = np.concatenate(steps)
    memo.add(found[fresh], got_at[fresh], got_len[fresh], np.concatenate(pool), path_at[fresh], path_len[fresh], path)
    n, at = got_len[inverse], got_at[inverse]
    if limit:
        for p in blocks(np.flatnonzero(path_len[inverse] > 0)):
            turns = path_len[inverse[p]]
            skipped = mix(np.repeat(draw[p], turns) + path[_spread(path_at[inverse[p]], turns)]) < limit
            p = p[np.logical_or.reduceat(skipped, np.cumsum(turns) - turns)]
            if len(p):
                flat, count, _ = merged(off[p], size[p], draw[p], limit)
                put(p, count, flat, n, at)
        for i in np.flatnonzero(u_long[inverse] & ~odd):
            ids = np.array(_agenda(m, sym[off[i] : off[i] + size[i]].tolist(), int(draw[i]), int(limit)), np.int64)
            put(np.array([i]), np.array([len(ids)]), ids, n, at)
    out = np.concatenate(pool)[_spread(at, n)]
    per_doc = np.bincount(owner, n, len(texts)).astype(np.int64)
    return np.split(out, np.cumsum(per_doc)[:-1])


def decode_ids(m: Model, ids) -> str:
    """The text of ids; bytes that form no character become U+FFFD."""
    raw = b"".join([m.text[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _memo(model: str) -> Memo:
    """One for all tasks of a worker."""
    return Memo()


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())]


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id", dropout: float = DROPOUT, seed: int = 0) -> DataFrame:
    """docs with n_tokens, ids, ids_crc32 (of the ids as little-endian 32-bit numbers) and lossless (decoding gives the text).

    Null and empty texts have no ids and are lossless; long ones are taken whole. A null key counts as 0; rows with equal key and text have equal ids. Columns of docs with
    the name of a new one are replaced. An empty table gives no rows. A text that does not come back, as where two of its words have one hash, is encoded again word by word.
    """

    def make():
        m, memo = load(model), _memo(model)

        def f(b):
            texts, keys = b.column(text).to_pylist(), b.column(key).to_pylist()
            ids = encode_texts(m, texts, keys, dropout, seed, memo=memo)
            good = [decode_ids(m, x.tolist()) == (t or "") for t, x in zip(texts, ids)]
            for i, t in enumerate(texts):
                if not good[i]:  # two words with one hash
                    ids[i] = encode_slowly(m, t, keys[i], dropout, seed)
                    good[i] = decode_ids(m, ids[i].tolist()) == t
            n = np.array([len(x) for x in ids])
            offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()), type=pa.list_(pa.field("element", pa.int32(), False)))
            return [n.tolist(), lists, [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], good]

        return f

    return with_arrow_columns(docs, text, FIELDS, make, whole=True)
