"""Removal of word runs that already stand in an earlier document.

Documents are dealt into blocks by ranges of doc_id. A window of words goes if it starts in an earlier block, or in the
same block under a smaller doc_id. Blocks send each distinct window hash once, packed and sorted, so a passage that every
document repeats costs one entry a block and not one a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.common import map_rows, partitions, table, text_rows
from riskpanel.llm.windows import mixed, window_hashes, word_hashes

WINDOW = 13
#: Text bytes of a block of documents (one task's group) and of a bucket of hashes.
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 24 << 20
LAST = np.iinfo(np.int64).max


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes by byte planes: the high planes hardly vary and compress away."""
    planes = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64)


def ids_of(column) -> np.ndarray:
    """doc_id values; a null id counts as the largest."""
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)


def _announce(bounds: np.ndarray, buckets: int, window: int):
    """Distinct (block, hash) of what a task has read, packed by bucket of the hash."""
    def flush(blocks: list, hashes: list) -> Iterator[pa.RecordBatch]:
        block, value = np.concatenate(blocks), np.concatenate(hashes)
        bucket = (mixed(value) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.lexsort((value, block, bucket))
        block, value, bucket = block[order], value[order], bucket[order]
        fresh = np.r_[True, (value[1:] != value[:-1]) | (block[1:] != block[:-1])]
        block, value, bucket = block[fresh], value[fresh], bucket[fresh]
        starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (bucket[1:] != bucket[:-1])])
        ends = np.r_[starts[1:], len(value)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts].astype(np.int64)), pa.array(block[starts]), pa.array([pack(value[a:b]) for a, b in zip(starts, ends)], pa.binary())],
            ["bucket", "block", "hashes"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, hashes, held = [], [], 0
        for batch in batches:
            block_of = np.searchsorted(bounds, ids_of(batch.column("doc_id")), side="left")
            for block, text in zip(block_of, batch.column("text").cast(pa.binary())):
                found = np.unique(window_hashes(word_hashes((text.as_py() or b"").split()), window))
                if len(found):
                    blocks.append(np.full(len(found), block, np.int64))
                    hashes.append(found)
                    held += len(found)
                if held >= BLOCK_BYTES // 6:
                    yield from flush(blocks, hashes)
                    blocks, hashes, held = [], [], 0
        if held:
            yield from flush(blocks, hashes)

    return work


def _answer(group: pa.Table) -> pa.Table:
    """For one bucket: the hashes that each block shares with an earlier block."""
    parts = [unpack(v.as_py()) for v in group.column("hashes")]
    value = np.concatenate(parts)
    block = np.repeat(group.column("block").to_numpy(), [len(p) for p in parts])
    del parts
    order = np.lexsort((block, value))
    value, block = value[order], block[order]
    starts = runs(value)
    first = np.repeat(block[starts], np.diff(np.r_[starts, len(value)]))
    late = np.flatnonzero(block > first)
    late = late[np.lexsort((value[late], block[late]))]
    value, block = value[late], block[late]
    starts = runs(block)
    ends = np.r_[starts[1:], len(block)].astype(np.int64)
    return pa.table({"block": pa.array(block[starts], pa.int64()),
                     "hashes": pa.array([pack(np.unique(value[a:b])) for a, b in zip(starts, ends)], pa.binary())})


def _remove(window: int):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(docs: pa.Table, known: pa.Table) -> pa.Table:
        ids = ids_of(docs.column("doc_id").combine_chunks()) if docs.num_rows else np.empty(0, np.int64)
        earlier = np.unique(np.concatenate([np.empty(0, np.uint64), *(unpack(v.as_py()) for v in known.column("hashes"))]))
        column = docs.column("text").cast(pa.binary())
        found = [window_hashes(word_hashes((v.as_py() or b"").split()), window) for v in column]
        rank = np.unique(ids, return_inverse=True)[1]
        value = np.concatenate([np.empty(0, np.uint64), *found])
        owner = np.repeat(rank, [len(f) for f in found])
        order = np.lexsort((owner, value))
        starts = runs(value[order])
        first = np.repeat(owner[order][starts], np.diff(np.r_[starts, len(value)]))
        gone = np.zeros(len(value), bool)
        gone[order] = owner[order] > first
        if len(earlier):
            at = np.minimum(np.searchsorted(earlier, value), len(earlier) - 1)
            gone |= earlier[at] == value
        counts, removed, kept, at = [], [], [], 0
        for hashes, v in zip(found, column):
            words = (v.as_py() or b"").split()
            hit = np.flatnonzero(gone[at:at + len(hashes)])
            at += len(hashes)
            spans = []
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > window) + 1
                spans = [(int(a), int(b)) for a, b in zip(hit[np.r_[0, cut]], hit[np.r_[cut - 1, len(hit) - 1]] + window)]
            left, position = [], 0
            for a, b in spans:
                left += words[position:a]
                position = b
            counts.append(len(words))
            removed.append([{"start": a, "end": b} for a, b in spans])
            kept.append(b" ".join(left + words[position:]))
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "removed": pa.array(removed, kind),
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    return work


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, removed (maximal intervals of word positions, end exclusive), kept_text for every row.

    A window of `window` words goes if the same words also start in a document with a smaller doc_id. Null and empty
    texts have no words. Rows with the same doc_id are one document here: they never remove from each other. A null
    doc_id counts as the largest. Texts shorter than the window lose nothing. An empty table gives an empty table.
    Hashes have 64 bits: over n windows a false repeat is expected n * n / 2**65 times.
    """
    spark, rows = docs.sparkSession, text_rows(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, max(10_000, 20 * blocks))).first()[0] if cuts else None
    bounds = np.unique(np.array(bounds or [], np.int64))
    shared = map_rows(rows, _announce(bounds, buckets, window), "bucket long, block long, hashes binary")
    known = shared.repartition(max(buckets, partitions(spark)), "bucket").groupBy("bucket").applyInArrow(_answer, "block long, hashes binary")

    @F.pandas_udf("long")
    def block_of(doc_id):
        import pandas as pd
        return pd.Series(np.searchsorted(bounds, doc_id.fillna(LAST).astype("int64").to_numpy(), side="left").astype("int64"))

    dealt = rows.withColumn("block", block_of(F.coalesce("doc_id", F.lit(int(LAST)))))
    return (dealt.repartition(max(blocks, partitions(spark)), "block").groupBy("block")
            .cogroup(known.repartition(max(blocks, partitions(spark)), "block").groupBy("block"))
            .applyInArrow(_remove(window), "doc_id long, n_words long, removed array<struct<start: int, end: int>>, kept_text string"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with w as (
  select doc_id, case when text is null then [] else regexp_extract_all(text, '[^\x20\x09-\x0D]+') end as words from documents),
s as (
  select doc_id, unnest(range(1, len(words) - 11)) as p, words from w where len(words) >= 13),
g as (select doc_id, p, array_to_string(words[p:p + 12], ' ') as t from s),
f as (select t, min(doc_id) as first_id from g group by t),
hit as (select distinct g.doc_id, g.p + k.k as p from g join f using (t), (select unnest(range(0, 13)) as k) k where g.doc_id > f.first_id),
kept as (
  select w.doc_id, u.p, w.words[u.p] as word from w, lateral (select unnest(range(1, len(w.words) + 1)) as p) u
  where not exists (select 1 from hit where hit.doc_id = w.doc_id and hit.p = u.p)),
k as (select doc_id, count(*) as n_kept, string_agg(word, ' ' order by p) as t from kept group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n_kept, 0) as bigint) as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from w left join k using (doc_id)
"""
