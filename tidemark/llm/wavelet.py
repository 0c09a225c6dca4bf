"""Operator 1: token ids in wavelet-matrix shards.

A shard is one byte string, its own file image: header, document ids and offsets, and one
bit-plane per bit of a token id, compressed. Planes are stored from the highest bit down; each
next plane holds the tokens stably split by the bit before, so rank and select on the planes give
access, counting and occurrence lookup without decoding the shard.

Edge cases: a null or empty text has only the end id; null doc_ids sort first; rows with equal
doc_id are ordered by text; an empty table makes no shards; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.word_pieces import Encoder, pieces
from tidemark.llm.words import Hasher, slices
from tidemark.session import scratch_path

MAGIC = b"WVM1"
HEADER = struct.Struct("<4sBQQQ")
END_ID = 1
SHARD_TOKENS = 1 << 20
SLICE = 4 << 20
BLOCK = 512  # bits between two entries of a rank directory
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class WaveletMatrix:
    """Succinct sequence of ints below ``2 ** bits`` with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes
        self.directory, self.zeros = [], []
        step = BLOCK // 8
        for plane in planes:
            padded = np.zeros(-(-max(plane.size, 1) // step) * step, np.uint8)
            padded[: plane.size] = plane
            per_block = _ONES[padded].reshape(-1, step).sum(axis=1, dtype=np.int64)
            self.directory.append(np.concatenate(([0], np.cumsum(per_block))))
            self.zeros.append(n - int(self.directory[-1][-1]))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        current, planes = ids, []
        for level in range(bits - 1, -1, -1):
            one = ((current >> level) & 1).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            # taking by position is faster than by a mask of bits that change often
            current = np.concatenate((current[np.flatnonzero(~one)], current[np.flatnonzero(one)]))
        return cls(ids.size, planes)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        lo, plane = block * BLOCK // 8, self.planes[level]
        count = int(self.directory[level][block]) + int(_ONES[plane[lo : i >> 3]].sum())
        if i & 7:
            count += int(_ONES[plane[i >> 3] & ((1 << (i & 7)) - 1)])
        return count

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) given bit of a plane."""
        ones = self.directory[level]
        counts = ones if bit else np.arange(ones.size) * BLOCK - ones
        block = int(np.searchsorted(counts, k, side="right")) - 1
        lo = block * BLOCK // 8
        bits = np.unpackbits(self.planes[level][lo : lo + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def _step(self, level: int, bit: int, i: int) -> int:
        ones = self._ones(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, i)
            value = value << 1 | bit
            i = self._step(level, bit, i)
        return value

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            lo, hi = self._step(level, bit, lo), self._step(level, bit, hi)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a symbol in positions [lo, hi)."""
        if symbol >> len(self.planes):
            return 0
        lo, hi = self._range(symbol, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = symbol >> (len(self.planes) - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self, dtype=np.uint32) -> np.ndarray:
        """All values: undo the stable splits from the last plane to the first."""
        bits = len(self.planes)
        values = np.zeros(self.n, dtype)
        for level in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, dtype)
            zeros = self.zeros[level]
            above[np.flatnonzero(~one)] = values[:zeros]
            above[np.flatnonzero(one)] = values[zeros:] | dtype(1 << (bits - 1 - level))
            values = above
        return values


def pack_shard(ids: np.ndarray, doc_ids: list, sizes: np.ndarray, bits: int) -> bytes:
    """One shard file: ``sizes[i]`` tokens belong to ``doc_ids[i]`` (None allowed)."""
    matrix = WaveletMatrix.build(ids, bits)
    null = np.fromiter((d is None for d in doc_ids), np.uint8, len(doc_ids))
    docs = np.fromiter((d or 0 for d in doc_ids), "<i8", len(doc_ids))
    body = b"".join([docs.tobytes(), null.tobytes(), sizes.astype("<i8").tobytes()])
    body += b"".join(p.tobytes() for p in matrix.planes)
    packed = zstandard.ZstdCompressor(level=1).compress(body)
    return HEADER.pack(MAGIC, bits, len(doc_ids), ids.size, len(body)) + packed


def open_shard(blob: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """(doc_ids, token offsets of the documents, matrix) of a shard file."""
    magic, bits, n_docs, n, size = HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a wavelet shard")
    body = zstandard.ZstdDecompressor().decompress(memoryview(blob)[HEADER.size :], max_output_size=size)
    docs = np.frombuffer(body, "<i8", n_docs)
    null = np.frombuffer(body, np.uint8, n_docs, 8 * n_docs)
    sizes = np.frombuffer(body, "<i8", n_docs, 9 * n_docs)
    at, step = 17 * n_docs, -(-n // 8)
    planes = [np.frombuffer(body, np.uint8, step, at + i * step) for i in range(bits)]
    ids = [None if z else d for d, z in zip(docs.tolist(), null.tolist())]
    return ids, np.concatenate(([0], np.cumsum(sizes))), WaveletMatrix(n, planes)


_LOADED: dict[str, Encoder] = {}


def _word_encoder(vocabulary: str) -> Encoder:
    """Encoder with a cache of the ids of pieces of words. The vocabulary never joins across white
    space. A Python worker keeps it for its later tasks."""
    if vocabulary not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[vocabulary] = Encoder(vocabulary)
    return _LOADED[vocabulary]


def write_shards(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every text, append ``end_id`` and write shards in ascending doc_id order.

    Documents are range-partitioned on doc_id, so partition p's documents come before those of
    p + 1; a task cuts its run of documents into shards of about ``shard_tokens`` tokens. Rows
    of the written table: (part, shard, n_tokens, blob).
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(parts, "doc_id")
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        doc_ids, chunks, sizes, held, shard, part = [], [], [], 0, 0, 0

        def flush():
            nonlocal doc_ids, chunks, sizes, held, shard
            blob = pack_shard(np.concatenate(chunks), doc_ids, np.concatenate(sizes), encoder.bits)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()),
                 pa.array([held], pa.int64()), pa.array([blob], pa.binary())],
                ["part", "shard", "n_tokens", "blob"],
            )
            doc_ids, chunks, sizes, held, shard = [], [], [], 0, shard + 1
            return row

        for batch in batches:
            if encoder is None:
                encoder = _word_encoder(vocabulary)
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for lo, hi, texts in slices(batch.column(1), SLICE):
                parts = pieces(texts, encoder.added)
                keys = Hasher(parts.data, False).of(parts.start, parts.end)
                flat, bounds = encoder.ids(keys, parts.data, parts.start, parts.end)
                ends = bounds[parts.first[1:]]
                chunks.append(np.insert(flat, ends, end_id))
                sizes.append(np.diff(np.concatenate(([0], ends))) + 1)
                doc_ids += batch.column(0).slice(lo, hi - lo).to_pylist()
                held += chunks[-1].size
                if held >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered.mapInArrow(run, "part int, shard int, n_tokens bigint, blob binary").write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, base): tokens before each shard. Totals go per part first, so the one
    ordered pass sees as many rows as there are partitions, whatever the corpus."""
    sizes = shards.select("part", "shard", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("_p"))
    inside = sizes.withColumn("_s", before(Window.partitionBy("part").orderBy("shard")))
    return inside.join(parts, "part").select("part", "shard", (F.col("_p") + F.col("_s")).alias("base"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, decoded from the shards: doc_id, start, n_tokens, ids_crc32, part, shard."""
    shards = spark.read.schema("part int, shard int, n_tokens bigint, blob binary").parquet(path)
    out = "doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint, part int, shard int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, bounds, matrix = open_shard(batch.column(2)[i].as_py())
                ids = matrix.decode(np.uint16 if len(matrix.planes) <= 16 else np.uint32).astype("<u4", copy=False)
                n = len(doc_ids)
                crc = [zlib.crc32(ids[bounds[j] : bounds[j + 1]].tobytes()) for j in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)),
                     pa.array(crc, pa.int64()), *(pa.array(np.full(n, batch.column(k)[i].as_py(), np.int32)) for k in (0, 1))],
                    ["doc_id", "first", "n_tokens", "ids_crc32", "part", "shard"],
                )

    docs = shards.select("part", "shard", "blob").mapInArrow(run, out)
    return docs.join(shard_starts(shards), ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "part", "shard"
    )


def wavelet_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the shards to the shared folder and return what they hold, read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "wavelet")
    write_shards(docs, path, vocabulary)
    return read_tokens(spark, path)
