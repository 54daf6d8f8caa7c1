"""Token ids in files: one frame of zstandard for each document, with one dictionary for all.

A data set is a folder with three Parquet tables, written by Spark to any file system it can write to:
  dictionary  one row: the dictionary and its hash (the first 16 hex digits of its SHA-256)
  blocks      one row for each block, in ascending order of block_no within and across files (part-00000 first): its number, the dictionary's hash, the doc_ids, the numbers of ids, where
              each begins within the block, and a container: the magic bytes, that hash, the number of frames, an index of their ends (32-bit) and ids (32-bit), then the
              frames. Blocks ascend with doc_id, and so do the frames of a block; block numbers have gaps
  index       one row for each document, in the same order: doc_id, block, place in it, first id's number in the whole, number of ids
Ids are little-endian 32-bit numbers before compression. A document is read from its block's index and its own frame; the statistics of the sorted
files let a reader skip all row groups but those that may hold it.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import running_start, shared_dir, slices, stage, unstage

MAGIC = b"SLID1\0\0\0"
#: Documents whose ids train the dictionary, at most (those whose doc_id hashes lowest); the dictionary's bytes.
SAMPLE_ROWS, DICTIONARY_BYTES = 2000, 64 << 10
LEVEL = 3
#: Documents of a block at most, and of a range of doc_id on average; rows of the index in one file on average.
BLOCK_ROWS, RANGE_ROWS, INDEX_ROWS = 256, 4096, 1 << 20
#: Words, and pieces of words, whose ids a worker remembers; pieces encoded as one text (the library's results are large).
MEMO, BATCH = 1 << 18, 128
#: Words that are cut into pieces here; all others, and those with a special token's first two characters, go whole through the library. The pieces are
#: those of the vocabulary's own pattern, on characters where lower case and classes are beyond doubt.
PLAIN = r"\A[\x09-\x0D!-~À-ÖØ-öø-ÿ]*\z"
PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+)"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts by one vocabulary, with what a worker remembers of words and of their pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.cut = _tokenizer(path), Tokenizer.from_file(path)
        # pieces come cut and in lower case; each ends with an id of a word's end
        self.cut.normalizer = normalizers.Sequence([])
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for v, i in vocabulary.items() if v.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}

    def _slowly(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _of(self, values: pa.Array, known: dict[str, bytes], learn: Callable[[pa.Array], list[bytes]]) -> pa.Array:
        """Ids of each of values; those of new ones are learned, and remembered while there is room."""
        d = values.dictionary_encode()
        unique = d.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(known.get, unique))
        new = [i for i, x in enumerate(got) if x is None]
        for i, x in zip(new, learn(d.dictionary.take(pa.array(new, pa.int64())))):
            got[i] = x
            if len(known) < MEMO:
                known[unique[i]] = x
        return pa.array(got, pa.binary()).take(d.indices)

    @staticmethod
    def _joined(lists: pa.ListArray, ids: pa.Array) -> list[bytes]:
        """The ids of each list's items, one after another."""
        ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32)
        at = ends[np.asarray(lists.offsets)].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]

    def _learn_pieces(self, pieces: pa.Array) -> list[bytes]:
        new, out = pieces.to_numpy(zero_copy_only=False).tolist(), []
        for at in range(0, len(new), BATCH):
            part = new[at : at + BATCH]
            ids = np.array(self.cut.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stop = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            # one by one, if pieces and word ends don't match
            out += [raw[a:b] for a, b in zip([0, *stop], stop)] if len(stop) == len(part) else map(self._slowly, part)
        return out

    def _learn_words(self, words: pa.Array) -> list[bytes]:
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        low = pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), r"[\x09-\x0D]+", " ")
        cut = pc.split_pattern(pc.replace_substring_regex(low, PIECES, r"\1 "), " ")
        found = iter(self._joined(cut, self._of(cut.values, self.pieces, self._learn_pieces)))
        return [next(found) if p else self._slowly(w) for w, p in zip(words.to_pylist(), plain.to_pylist())] if len(low) < len(words) else list(found)

    def encode(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """Ids of whole texts (32-bit, little-endian) without special tokens, each with the end id. Null counts as empty.

        The vocabulary drops white space and never joins what it separates, so words between spaces are encoded one by one and remembered.
        """
        words, end = pc.split_pattern(texts.fill_null(""), " "), struct.pack("<I", end_id)
        return [x + end for x in self._joined(words, self._of(words.values, self.words, self._learn_words))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from a bounded sample of documents; empty if these are too few for one."""
    # about twice the sample goes to the sort, so that what tasks send doesn't grow with their number
    share = min(1.0, 2 * SAMPLE_ROWS / max(1, docs.count()))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    rows = drawn.where("text is not null").orderBy(F.xxhash64("doc_id"), "text").limit(SAMPLE_ROWS).collect()
    samples = encoder(tokenizer).encode(pa.array([r.text for r in rows], pa.string()), end_id)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()[:16]


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def pack(frames: list[bytes], counts: list[int], dict_hash: str) -> bytes:
    ends = np.cumsum([len(f) for f in frames]).astype("<u4")
    return b"".join([MAGIC, dict_hash.encode(), struct.pack("<I", len(frames)), ends.tobytes(), np.array(counts, "<u4").tobytes(), *frames])


def open_block(block: bytes, dict_hash: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Ends and id counts of a block's frames, and where the first begins."""
    if block[:8] != MAGIC or block[8:24].decode() != dict_hash:
        raise ValueError("not a block, or one of another dictionary")
    n = struct.unpack_from("<I", block, 24)[0]
    return np.frombuffer(block, "<u4", n, 28), np.frombuffer(block, "<u4", n, 28 + 4 * n), 28 + 8 * n


def read_frame(block: bytes, place: int, dictionary: bytes) -> np.ndarray:
    """Ids of one document of a block; nothing else of it is decompressed."""
    ends, _, base = open_block(block, dictionary_hash(dictionary))
    start = int(ends[place - 1]) if place else 0
    return np.frombuffer(_decompressor(dictionary).decompress(block[base + start : base + int(ends[place])]), "<u4")


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> str:
    """Write the ids of docs (doc_id, text; other columns are not read) and return the data set's folder.

    Rows are in the order of doc_id (null first), those of one doc_id in the order of a hash of their frames. Null texts count as empty and have the
    end id only; long ones are one frame like any other. An empty table gives a data set without blocks.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    name = dictionary_hash(dictionary)
    spark.createDataFrame([(name, bytearray(dictionary))], "hash string, dictionary binary").write.parquet(f"{folder}/dictionary")

    def encode(batches):
        c = None
        for batch in batches:
            for b in slices(batch, "text"):
                c = c or _compressor(dictionary)
                ids = encoder(tokenizer).encode(b.column("text"), end_id)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(c.compress, ids), pa.binary())], names=["doc_id", "n_tokens", "frame"])

    frames = stage(docs.mapInArrow(encode, "doc_id long, n_tokens long, frame binary"), "frames")
    # ranges of doc_id of about RANGE_ROWS rows; a doc_id on very many rows gets ranges of its own by the frame's hash
    n = frames.count()
    parts = max(1, -(-n // RANGE_ROWS))
    ranged = frames.withColumn("h", F.xxhash64("frame", "n_tokens")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    ranged = ranged.withColumn("part", F.spark_partition_id()).drop("h")
    size = BLOCK_ROWS

    def blocks(batches):
        number, part, ids, counts, made = 0, None, [], [], []

        def flush():
            starts = (np.cumsum(counts) - counts).tolist()
            cols = [([(part << 20) + number], pa.int64()), ([name], pa.string()), ([part], pa.int32()), ([sum(counts)], pa.int64()), ([ids], pa.list_(pa.int64())), ([counts], pa.list_(pa.int64())), ([starts], pa.list_(pa.int64())), ([pack(made, counts, name)], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(*c) for c in cols], names=["block_no", "dictionary", "part", "n_tokens", "doc_ids", "counts", "starts", "block"])

        for b in batches:
            for d, n, f, p in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame", "part"))):
                part = p
                ids.append(d)
                counts.append(n)
                made.append(f)
                if len(made) == size:
                    yield flush()
                    number, ids, counts, made = number + 1, [], [], []
        if made:
            yield flush()

    # each task writes its range as it comes, so files and rows are in the order of doc_id
    ranged.mapInArrow(blocks, "block_no long, dictionary string, part int, n_tokens long, doc_ids array<long>, counts array<long>, starts array<long>, block binary").write.option("compression", "none").parquet(f"{folder}/blocks")
    made = spark.read.parquet(f"{folder}/blocks").drop("block")
    # where each block's ids begin: sums of ranges in two levels, then within a range
    ranges = running_start(made.groupBy("part").agg(F.sum("n_tokens").alias("sum")), "part", "sum", "before").drop("sum")
    within = F.expr("sum(n_tokens) OVER (PARTITION BY part ORDER BY block_no) - n_tokens")
    first = made.select("block_no", "part", within.alias("within")).join(ranges, "part").select("block_no", (F.col("before") + F.col("within")).alias("first"))
    each = made.join(first, "block_no").select("block_no", "first", F.posexplode(F.arrays_zip("doc_ids", "counts", "starts")).alias("place", "d"))
    each = each.select("d.doc_ids", "block_no", "place", (F.col("first") + F.col("d.starts")).alias("start"), F.col("d.counts").alias("n_tokens")).withColumnRenamed("doc_ids", "doc_id")
    each.repartitionByRange(max(1, -(-n // INDEX_ROWS)), "block_no", "place").sortWithinPartitions("block_no", "place").write.parquet(f"{folder}/index")
    unstage(frames)
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_bytes (of the frame), block_no, place, read from a data set's files; ids are decompressed frame by frame."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if dictionary_hash(dictionary) != row.hash:
        raise ValueError("the dictionary is damaged")

    def run(batches):
        for whole in batches:
            for i in range(whole.num_rows):
                b, d = whole.slice(i, 1), _decompressor(dictionary)
                number, block = b.column("block_no")[0].as_py(), b.column("block")[0].as_py()
                ends, counts, base = open_block(block, row.hash)
                crcs, start = [], 0
                for n, end in zip(counts.tolist(), ends.tolist()):
                    raw = d.decompress(block[base + start : base + end])
                    if len(raw) != 4 * n:
                        raise ValueError("a frame and its count differ")
                    crcs.append(zlib.crc32(raw))
                    start = end
                k = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array([number] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(crcs, pa.int64()), pa.array(np.diff(ends.astype(np.int64), prepend=0))], names=["block_no", "place", "ids_crc32", "n_bytes"])

    frames = spark.read.parquet(f"{folder}/blocks").mapInArrow(run, "block_no long, place int, ids_crc32 long, n_bytes long")
    return spark.read.parquet(f"{folder}/index").join(frames, ["block_no", "place"]).select("doc_id", "start", "n_tokens", "ids_crc32", "n_bytes", "block_no", "place")


def lookup(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of one document (of each row with its doc_id): its rows of the index first, then only their blocks, then only its frames."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first().dictionary)
    rows = spark.read.parquet(f"{folder}/index").where(F.col("doc_id") == doc_id).orderBy("start").collect()
    numbers = sorted({r.block_no for r in rows})
    held = spark.read.parquet(f"{folder}/blocks").where(F.col("block_no").isin(numbers)).select("block_no", "block").collect() if numbers else []
    blocks = {r.block_no: bytes(r.block) for r in held}
    return [read_frame(blocks[r.block_no], r.place, dictionary) for r in rows]
