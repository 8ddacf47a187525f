"""Token ids in binary files: a shared zstandard dictionary, one frame for each document.

``write`` sorts documents by doc_id, encodes them and stores blocks of documents.  A block is a
row of a Parquet table (so that Spark's commit protocol guards it and any store that Spark writes
to will do) and holds one binary value:

    magic "TMK1", 16 bytes of the dictionary's hash, number of documents (uint32),
    doc_ids (int64 each), counts of ids (uint32 each), offsets of frames (uint32 each, and the end),
    frames

A frame is the zstandard compression of a document's ids, as little-endian unsigned 16-bit integers
if the vocabulary allows it and else 32-bit.  The dictionary is trained on the serialized ids of a
bounded sample and stored next to the blocks; a reader refuses frames of another dictionary.  Any
document can be read alone: its offset leads to its frame.

Defined results: a null text counts as empty (the end id alone); documents without doc_id come
first; very long texts are encoded whole; repeated rows are stored as often as they come; an empty table
gives no blocks; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch

MAGIC = b"TMK1"
END_ID = 2
BLOCKS = "part int, seq long, n_docs long, n_ids long, body binary"
INDEX = "part int, seq long, within long, doc_id long, n_tokens long, ids_crc32 long"
#: Characters that follow a word; the splitting pattern puts a run of them into a piece of its own.
MARKS = b".,;:!?*%&#$|)"
#: White space that is neither a space nor a line end.
ODD_SPACE = np.isin(np.arange(256), list(b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"))


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The byte-level splitting pattern never joins characters across the start of a single space or of
    a single line end, so the chunks between them are encoded one by one, and ids of chunks seen
    before come from a cache of two generations, each of at most ``most`` chunks.  Texts with other
    runs of white space, with a special token's string or with characters of 4 bytes or of unusual
    scripts go to the library as they are.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code = "I" if self.wide else "H"
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_raw = self._ids("\n")
        (self.line,) = np.frombuffer(self.line_raw, self.code)
        self.known_marks: dict[bytes, bytes] = {}
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def chunks(self, raw: bytes) -> list[bytes] | None:
        """The chunks of a text in UTF-8, each with the line end before it, if any; None where they can't be told apart."""
        seen = np.frombuffer(raw, np.uint8)
        if seen.max() >= 0xC9 or ODD_SPACE[seen].any() or b"\xc2\xa0" in raw or b"\xc2\x85" in raw or any(s in raw for s in self.special):
            return None
        out = raw.replace(b"\n", b" \n").split(b" ")
        return None if b"" in out or b"\n" in out else out

    def _marks(self, marks: bytes) -> bytes:
        ids = self.known_marks.get(marks)
        if ids is None:
            if len(self.known_marks) > 10_000:
                self.known_marks = {}
            ids = self.known_marks[marks] = self._ids(marks.decode())
        return ids

    def _learn(self, missing: set[bytes]) -> None:
        new, old = self.new, self.old
        unseen, ended = [], []
        for c in missing:
            ids = old.get(c)
            if ids is not None:
                new[c] = ids
                continue
            base = c.rstrip(MARKS)
            if len(base) < len(c) and (base[-1:].isalnum() or base[-2:-1] == b"\xc3" and base[-2:].decode().isalpha()):  # the pattern splits a letter or digit from the marks after it
                marks = self._marks(c[len(base) :])
                ids = new.get(base) or old.get(base)
                if ids is None:
                    unseen.append(base)
                    ended.append((c, base, marks))
                else:
                    new[c] = ids + marks
            else:
                unseen.append(c)
        if not unseen:
            return
        # All at once, with line ends between: a line end is one id, and no chunk holds another.
        joined = b"\n".join([c[1:] if c[:1] == b"\n" else b" " + c for c in unseen])
        ids = np.array(self.tokenizer.encode_batch_fast([joined.decode()], add_special_tokens=False)[0].ids, self.code)
        ends = np.append(np.flatnonzero(ids == self.line), len(ids)).tolist()
        raw, width, at = ids.tobytes(), ids.itemsize, 0
        for c, end in zip(unseen, ends):
            body = raw[at * width : end * width]
            new[c] = self.line_raw + body if c[:1] == b"\n" else body
            at = end + 1
        for c, base, marks in ended:
            new[c] = new[base] + marks

    def serialized(self, raw: bytes) -> bytes:
        """The ids of a text in UTF-8, as little-endian integers of the width that the vocabulary needs."""
        parts = self.chunks(raw) if raw else None
        if parts is None:
            return self._ids(raw.decode("utf-8", "surrogatepass"))
        rest = parts[1:]
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        found = list(map(self.new.get, rest))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            self._learn({rest[i] for i in gaps})
            for i in gaps:
                found[i] = self.new[rest[i]]
        return self._ids(parts[0].decode()) + b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.serialized(text.encode("utf-8", "surrogatepass")), self.code).astype(np.uint32)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, so that its cache serves all tasks there."""
    return Encoder(path)


def serialized(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary from serialized id arrays; the samples themselves where there are too few to train on."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"\0" * 8


def _loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(dictionary)


def pack(docs: list[tuple[int | None, bytes]], dictionary: bytes, compressor: zstandard.ZstdCompressor, wide: bool) -> bytes:
    """A block of documents: doc_id and serialized ids each."""
    frames = [compressor.compress(ids) for _, ids in docs]
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u4")
    head = MAGIC + hashlib.sha256(dictionary).digest()[:16] + struct.pack("<IB", len(docs), wide)
    missing = np.iinfo(np.int64).min
    return b"".join([head, np.array([missing if d is None else d for d, _ in docs], "<i8").tobytes(), np.array([len(x) >> (2 if wide else 1) for _, x in docs], "<u4").tobytes(), offsets.tobytes(), *frames])


class Block:
    """A block's index; documents are read one by one."""

    def __init__(self, body: bytes, dictionary: bytes, decompressor: zstandard.ZstdDecompressor | None = None):
        if body[:4] != MAGIC or body[4:20] != hashlib.sha256(dictionary).digest()[:16]:
            raise ValueError("not a block of this dictionary")
        n, self.wide = struct.unpack("<IB", body[20:25])
        self.doc_ids = np.frombuffer(body, "<i8", n, 25)
        self.counts = np.frombuffer(body, "<u4", n, 25 + 8 * n)
        self.offsets = np.frombuffer(body, "<u4", n + 1, 25 + 12 * n)
        self.body, self.start = body, 25 + 16 * n + 4
        self.reader = decompressor or zstandard.ZstdDecompressor(dict_data=_loaded(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        frame = self.body[self.start + int(self.offsets[i]) : self.start + int(self.offsets[i + 1])]
        out = np.frombuffer(self.reader.decompress(frame), "<u4" if self.wide else "<u2")
        if len(out) != self.counts[i]:
            raise ValueError("a frame has another number of ids than the index")
        return out


def sample_ids(docs: DataFrame, path: str, n_docs: int = 500) -> list[bytes]:
    """Serialized ids of the n_docs documents whose doc_id has the smallest hash; the bound is a parameter."""
    chosen = [r.doc_id for r in docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs).collect()]
    if not chosen:
        return []
    texts = docs.where(F.col("doc_id").isin(chosen)).select(F.coalesce(F.col("text"), F.lit("")).alias("text")).orderBy(F.xxhash64("text")).limit(2 * n_docs)
    e = encoder(path)
    end = serialized(np.array([END_ID]), e.wide)
    return [e.serialized(r.text.encode("utf-8", "surrogatepass")) + end for r in texts.toLocalIterator()]


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = END_ID, block_bytes: int = 1 << 20, parts: int | None = None) -> None:
    """Encode all documents and store them below path, in ascending order of doc_id by (part, seq)."""
    spark = docs.sparkSession
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    dictionary = train_dictionary(sample_ids(docs, tokenizer))
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary)], "hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # 64 KB at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, held, size, seq = encoder(tokenizer), [], 0, 0
        end, width = serialized(np.array([end_id]), e.wide), 4 if e.wide else 2
        compressor = zstandard.ZstdCompressor(level=3, dict_data=_loaded(shared.value), write_content_size=True)
        part = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            body = pack(held, shared.value, compressor, e.wide)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([sum(len(x) for _, x in held) // width], pa.int64()), pa.array([body], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "body"])

        for b in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((doc_id, e.serialized(raw) + end))
                size += len(held[-1][1])
                if size >= block_bytes:
                    yield block()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield block()

    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(each, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stored document: doc_id, start (ids of all before it), n_tokens, ids_crc32."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_loaded(shared.value))
        for b in batches:
            for part, seq, body in zip(*(b.column(k).to_pylist() for k in range(3))):
                block = Block(body, shared.value, decompressor)
                n = len(block)
                crc = [zlib.crc32(block.ids(i).astype("<u4").tobytes()) for i in range(n)]
                ids = pa.array(block.doc_ids, pa.int64(), mask=block.doc_ids == np.iinfo(np.int64).min)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, seq), pa.int64()), pa.array(np.cumsum(block.counts, dtype=np.int64) - block.counts, pa.int64()), ids, pa.array(block.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "seq", "within", "doc_id", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # A row for each block, a few for a part: the first sum runs within parts, the second over the parts alone.
    sizes = blocks.select("part", "seq", "n_ids")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = by_part.withColumn("part_start", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("block_start"))
    docs = blocks.select("part", "seq", "body").mapInArrow(each, INDEX)
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write to the shared folder and read back."""
    path = scratch(docs.sparkSession, "ids")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
