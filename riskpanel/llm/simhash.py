"""Near-duplicates by SimHash: fingerprints of 64 bits, compared exactly in tiles ordered by their population counts.

Two fingerprints that differ in at most `radius` bits agree in one of radius + 1 words, so fingerprints meet in a bucket
for each word's value. In a bucket they lie in tiles by population count; tiles whose counts differ by more than the
radius are never held against each other, the others are compared by exclusive-or and bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.common import looked_up, map_rows, partitions, shared_folder, table, text_rows, written
from riskpanel.llm.neardup import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints of one population count in a large bucket that make a tile; smaller buckets are one group.
TILE = 4096
#: Rows of a tile that are held at once against the fingerprints within reach.
ROWS = 256
#: Shingle hashes whose bits are spread out at once.
SPREAD = 65_536
_HASH = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingles(words: list[bytes], length: int = SHINGLE) -> Iterator[bytes]:
    """Runs of `length` words joined by spaces, repeats included; all words if there are fewer; none of none."""
    if not words:
        return iter(())
    return map(b" ".join, zip(*(words[i:] for i in range(min(length, len(words))))))


def fingerprint(text: bytes, length: int = SHINGLE) -> int:
    """Each bit is set if more than half of the shingle hashes have it."""
    hashes = np.fromiter(map(_HASH, shingles(text.lower().split(), length)), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SPREAD):
        some = hashes[at:at + SPREAD]
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(v.as_py() or b"", length) for v in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "node"])

    return work


def _cuts(radius: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of radius + 1 words that make up 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _spanning(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that join all fingerprints of `left` and `right` (or of `left` alone) with at most `radius` bits apart: no
    link whose ends earlier ones join already. Both sides are brought into the order of their population counts."""
    left = left[np.argsort(np.bitwise_count(left), kind="stable")]
    alone = right is None
    right = left if alone else right[np.argsort(np.bitwise_count(right), kind="stable")]
    ones, reach = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    every = left if alone else np.concatenate([left, right])
    label, shift, links = np.arange(len(every)), 0 if alone else len(left), []
    for at in range(0, len(left), ROWS):
        tile = left[at:at + ROWS]
        low = np.searchsorted(reach, ones[at] - radius, "left")
        high = np.searchsorted(reach, ones[at + len(tile) - 1] + radius, "right")
        if alone:
            low = max(low, at)
        for begin in range(low, high, TILE):
            some = right[begin:min(high, begin + TILE)]
            hits = np.bitwise_count(tile[:, None] ^ some[None, :]) <= radius
            for r in np.flatnonzero(hits.any(axis=1)):
                other = np.flatnonzero(hits[r]) + begin + shift
                own = at + r
                for c in other[label[other] != label[own]]:
                    if label[c] != label[own]:
                        links.append((int(every[own]), int(every[c])))
                        label[label == label[c]] = label[own]
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((bucket, i, j), fingerprints, sides) of rows that come sorted by (bucket, i, j)."""
    key, nodes, sides = None, [], []
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j", "node", "side")]
        if not batch.num_rows:
            continue
        keys = np.stack(columns[:3], axis=1)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
            now = tuple(keys[a].tolist())
            if now != key:
                if nodes:
                    yield key, np.concatenate(nodes), np.concatenate(sides)
                key, nodes, sides = now, [], []
            nodes.append(columns[3][a:b])
            sides.append(columns[4][a:b])
    if nodes:
        yield key, np.concatenate(nodes), np.concatenate(sides)


def _links(radius: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for (_, i, j), nodes, sides in _groups(batches):
            values = nodes.view(np.uint64)
            found += _spanning(values, None, radius) if i == j else _spanning(values[sides == 0], values[sides == 1], radius)
            if len(found) >= SPREAD:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    return work


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(found, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])


def _tile(ones: Column, part: Column) -> Column:
    return ones.cast("long") * (1 << 32) + part


def links(nodes: DataFrame, radius: int, folder: str) -> DataFrame:
    """(a, b): links between distinct fingerprints that join whatever reaches each other within `radius` bits."""
    spark = nodes.sparkSession
    words = F.array(*(F.struct(F.lit(k).alias("word"), F.shiftrightunsigned("node", a).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1)).alias("value"))
                      for k, (a, size) in enumerate(_cuts(radius))))
    entries = nodes.select("node", F.explode(words).alias("w")).select("node", F.xxhash64("w.word", "w.value").alias("bucket"), F.bit_count("node").alias("ones"))
    entries = written(entries, folder, "entries")
    tiles = entries.groupBy("bucket", "ones").agg(F.count("*").alias("size"))
    tiles = tiles.groupBy("bucket").agg(F.sum("size").alias("n"), F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("size") / TILE).cast("int")))).alias("parts"))
    tiles = tiles.filter("n > 1").withColumn("parts", F.when(F.col("n") > TILE, F.col("parts")))
    known = looked_up(entries, tiles, "bucket", entries.count()).filter("n is not null")
    own = _tile(F.col("ones"), F.pmod(F.xxhash64("node"), F.element_at("parts", F.col("ones"))))
    reach = F.filter(F.sequence(F.col("ones") - radius, F.col("ones") + radius), lambda o: F.map_contains_key("parts", o))
    others = F.flatten(F.transform(reach, lambda o: F.transform(F.sequence(F.lit(0), F.element_at("parts", o) - 1), lambda part: _tile(o, part))))
    meet = F.transform(others, lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j"), (own > t).cast("int").alias("side")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side")))
    dealt = known.select("bucket", "node", F.explode(F.when(F.col("parts").isNull(), one).otherwise(meet)).alias("m"))
    dealt = dealt.select("bucket", "m.i", "m.j", "m.side", "node")
    ordered = dealt.repartition(partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return map_rows(ordered, _links(radius), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, radius: int = RADIUS, length: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row: the least doc_id that links reach.

    Null and blank texts have the fingerprint zero and are linked like any other. Repeated rows have equal fingerprints; every row is
    returned. A null doc_id counts as larger than any other: its component is null only if no id is reachable. Texts have any
    length. An empty table gives an empty table. Other columns are not read.
    """
    folder = shared_folder(docs.sparkSession)
    signed = written(map_rows(text_rows(docs), _fingerprints(length), "doc_id long, node long"), folder, "signed")
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), folder, "nodes")
    roots = components(written(links(nodes.select("node"), radius, folder), folder, "links"), folder, "near")
    ids = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("rows"))
    named = ids.join(least.filter("rows > 1"), "root").select("node", "n", "component_id")
    out = looked_up(signed, named, "node", signed.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
