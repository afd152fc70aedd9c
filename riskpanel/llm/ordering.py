"""Token sequences in training order: a keyed permutation gives every sequence its slot, and slots fill shards of fixed stride."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.bpe import CODECS, _codec, share_codec
from riskpanel.llm.common import map_rows, shared_folder, table, text_rows, texts, written
from riskpanel.llm.windows import mixed

STRIDE = 256
SHARD_SEQUENCES = 8192
PAD = 50_256
SEED = 20_240_601
ROUNDS = 6


def permuted(index: np.ndarray, size: int, seed: int = SEED) -> np.ndarray:
    """Slot of each index below `size`: a Feistel network over the next even number of bits, walked until it is inside.

    The network is a bijection of its power of two, so following it from an index below `size` comes back below `size`,
    and no two indexes meet.
    """
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = [np.uint64(xxhash.xxh3_64_intdigest(struct.pack("<qq", seed, r))) for r in range(ROUNDS)]
    out = index.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for key in keys:
            left, right = right, left ^ (mixed(right ^ key) & mask)
        out[open_] = (left << half) | right
        open_ = open_[out[open_] >= size]
    return out.astype(np.int64)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, stride: int) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit), n_tokens, and where the sequences of the row begin in its task."""
    shared = share_codec(docs.sparkSession, ranks_path, pattern, "H")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, at = _codec(shared), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, counts, first = [], [], []
            for packed in codec.encode_all(texts(batch)):
                ids.append(packed)
                counts.append(len(packed) // 2)
                first.append(at)
                at += -(-counts[-1] // stride)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array(first, pa.int64()), pa.array([part] * len(ids), pa.int64())],
                ["doc_id", "ids", "n_tokens", "first", "part"])

    return map_rows(text_rows(docs), work, "doc_id long, ids binary, n_tokens long, first long, part long", CODECS)


def training_order(docs: DataFrame, ranks_path: str, pattern: str, path: str, stride: int = STRIDE, shard_sequences: int = SHARD_SEQUENCES,
                   pad: int = PAD, seed: int = SEED) -> DataFrame:
    """Write all sequences below `path` in slot order and return the table that was written.

    Columns: shard, slot, doc_id, seq_no, n_tokens, tokens (stride 16-bit ids, padded). Each shard is one file that
    holds the slots from shard * shard_sequences on, in order, one record of fixed size a slot, so reading goes on at any
    slot. The permutation depends on the seed and the number of sequences only. Null and empty texts have no
    sequence; repeated rows have sequences of their own; an empty table writes no shard. An id beyond 16 bits raises. A
    very long text is many sequences; other columns are not read.
    """
    spark = docs.sparkSession
    rows = written(encoded(docs, ranks_path, pattern, stride), shared_folder(spark), "encoded", "zstd")
    sizes = rows.groupBy("part").agg(F.sum(F.ceil(F.col("n_tokens") / stride)).cast("long").alias("n")).orderBy("part").collect()  # a row for each task
    total = sum(r["n"] for r in sizes)
    starts = dict(zip((r["part"] for r in sizes), np.cumsum([0] + [r["n"] for r in sizes]).tolist()))
    filler = struct.pack("<H", pad)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_tokens").to_numpy()
            counts = -(-sizes // stride)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            base = np.array([starts[p] for p in batch.column("part").to_pylist()], np.int64) + batch.column("first").to_numpy()
            slots = permuted(base[owner] + within, total, seed)
            left = np.minimum(sizes[owner] - within * stride, stride)
            data = b"".join(ids + filler * int(gap) for ids, gap in zip(batch.column("ids").to_pylist(), counts * stride - sizes))
            records = pa.Array.from_buffers(pa.binary(2 * stride), len(owner), [None, pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array((slots // shard_sequences).astype(np.int32)), pa.array(slots), batch.column("doc_id").take(pa.array(owner)),
                 pa.array(within.astype(np.int32)), pa.array(left.astype(np.int32)), records], ["shard", "slot", "doc_id", "seq_no", "n_tokens", "tokens"])

    placed = map_rows(rows.select("doc_id", "ids", "n_tokens", "first", "part"), work,
                      "shard int, slot long, doc_id long, seq_no int, n_tokens int, tokens binary")
    shards = max(1, -(-total // shard_sequences))
    placed = placed.repartitionById(shards, "shard").sortWithinPartitions("slot")
    placed.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    out = training_order(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                         f"{shared_folder(spark)}/shards")
    return out.select("doc_id", "seq_no", "slot", "shard", "n_tokens", F.crc32("tokens").alias("tokens_crc32"))
