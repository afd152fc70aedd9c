"""Near-duplicates by min-max hashing: each permutation gives its minimum and its maximum to the signature.

Texts with the same shingle set are one node. Bands of signature values put nodes into buckets. First every node is held
against one pivot of each of its buckets, which joins most large groups at a cost linear in their size. What is then still
apart in a bucket is compared by sketches in blocks, and pairs that can reach the threshold are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.common import map_rows, partitions, shared_folder, table, text_rows, written
from riskpanel.llm.windows import window_hashes, word_hashes

SHINGLE = 5
PERCENT = 75
BANDS = 32
ROWS = 3
PERMUTATIONS = BANDS * ROWS // 2
#: Sketch agreement below which a pair is not confirmed: at a true similarity of PERCENT, 4.5 standard deviations below it.
SKETCH_SHARE = 0.55
#: Rows of a block of sketches in one bucket.
BLOCK = 1024
_FACTORS = np.array([int.from_bytes(hashlib.sha256(f"factor {i}".encode()).digest()[:8], "little") | 1 for i in range(PERMUTATIONS)], np.uint64)
_ORDER = np.argsort([hashlib.sha256(f"value {i}".encode()).digest() for i in range(BANDS * ROWS)], kind="stable")


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words of the lower-cased text; all its words if there are fewer."""
    words = word_hashes(text.lower().split())
    return np.unique(window_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def signature(items: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the items under each permutation, dealt to the bands in a fixed mixed order."""
    low, high = np.empty(PERMUTATIONS, np.uint64), np.empty(PERMUTATIONS, np.uint64)
    for i, factor in enumerate(_FACTORS):
        x = items * factor
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        low[i], high[i] = x.min(), x.max()
    return np.concatenate([low, high])[_ORDER]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, counts, sketches, bands = [], [], [], []
        for v in batch.column("text").cast(pa.binary()):
            items = shingles(v.as_py() or b"")
            counts.append(len(items))
            nodes.append(hashlib.md5(items.astype("<u8").tobytes()).digest() if len(items) else None)
            if len(items):
                values = signature(items)
                sketches.append((values & np.uint64(0xFFFF)).astype("<u2").tobytes())
                rows = values.reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    key = (key ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
                bands.append(key.astype("<u8").tobytes())
            else:
                sketches.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array(sketches, pa.binary()),
             pa.array(bands, pa.binary())], ["doc_id", "text_key", "node", "n_shingles", "sketch", "bands"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i8")
        each = np.repeat(np.arange(batch.num_rows), BANDS)
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(each)), pa.array(keys.astype(np.int64))], ["node", "bucket"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(v.as_py() or b"") for v in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([hashlib.md5(x.astype("<u8").tobytes()).digest() for x in found], pa.binary()),
             pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], ["node", "items"])


def _confirm(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(left.as_py(), "<u8"), np.frombuffer(right.as_py(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return work


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    left, right = sets.select(F.col("node").alias("a"), F.col("items").alias("x")), sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.filter(100 * F.least(F.length("x"), F.length("y")) >= percent * F.greatest(F.length("x"), F.length("y")))
    return map_rows(both.select("a", "b", "x", "y"), _confirm(percent), "a binary, b binary")


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root): the least node that each linked node reaches, by alternating large-star and small-star rounds."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), folder, f"{name}-0")
    before, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").filter("v <> m").withColumnsRenamed({"v": "u", "m": "v"})
        step += 1
        edges = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), folder, f"{name}-{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if now == before and now[0] == now[2]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _passing(bucket: int, nodes: list, roots: list, sides: list, sketches: list, bands: list) -> list[tuple[int, int, int]]:
    """(agreement, row, column) of a block's pairs that are in different components, whose sketches agree enough, and that
    share no earlier band: each pair is looked at in one bucket only."""
    if len(nodes) < 2 or len(set(roots)) < 2:
        return []
    values = np.frombuffer(b"".join(sketches), "<u2").reshape(len(nodes), -1)
    keys = np.frombuffer(b"".join(bands), "<i8").reshape(len(nodes), -1)
    earlier = keys[:, :np.flatnonzero(keys[0] == bucket)[0]]
    _, root = np.unique(np.array(roots, dtype=object), return_inverse=True)
    side = np.array(sides)
    rows = np.flatnonzero(side == 0)
    columns = np.flatnonzero(side == 1) if (side == 1).any() else rows
    out, least = [], SKETCH_SHARE * values.shape[1]
    for r in rows:
        other = columns[(root[columns] != root[r]) & ((columns > r) | (side[columns] == 1))]
        agree = (values[other] == values[r]).sum(axis=1)
        other, agree = other[agree >= least], agree[agree >= least]
        fresh = ~(earlier[other] == earlier[r]).any(axis=1)
        out += [(int(n), int(r), int(c)) for n, c in zip(agree[fresh], other[fresh])]
    return out


def _each_block(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[list]]]:
    """The rows of one (bucket, i, j) after another; they come sorted, so one block is held at a time."""
    key, held = None, [[] for _ in columns]
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", *columns))):
            if row[:3] != key:
                if key is not None:
                    yield key, held
                key, held = row[:3], [[] for _ in columns]
            for values, value in zip(held, row[3:]):
                values.append(value)
    if key is not None:
        yield key, held


_ENTRY = ("node", "root", "side", "sketch", "bands")


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block that have a passing pair."""
    for (bucket, i, j), held in _each_block(batches, _ENTRY):
        keep = sorted({x for _, r, c in _passing(bucket, *held) for x in (r, c)})
        if keep:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v] * len(keep), kind) for v, kind in ((bucket, pa.int64()), (i, pa.int32()), (j, pa.int32()))]
                + [pa.array([column[k] for k in keep], kind) for column, kind in zip(held, (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()))],
                ["bucket", "i", "j", *_ENTRY])


def _linked(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each block, confirmed on full sets. A pair that confirmed links of the block join already is passed over."""
        for (bucket, _, _), (*held, items) in _each_block(batches, (*_ENTRY, "items")):
            nodes, roots = held[0], held[1]
            parent: dict = {}

            def find(x):
                while parent.get(x, x) != x:
                    parent[x] = x = parent.get(parent[x], parent[x])
                return x

            a, b = [], []
            for _, r, c in sorted(_passing(bucket, *held), reverse=True):
                left, right = find(roots[r]), find(roots[c])
                if left != right:
                    x, y = np.frombuffer(items[r], "<u8"), np.frombuffer(items[c], "<u8")
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        parent[left] = right
                        a.append(min(nodes[r], nodes[c]))
                        b.append(max(nodes[r], nodes[c]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return work


def rest_links(entries: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket, each bucket in blocks of about BLOCK rows.

    Sketches first say which rows of a block can have a link at all; only those fetch their sets. What a task returns
    joins components, so its rows grow with the nodes and not with their pairs.
    """
    spark = entries.sparkSession
    now = entries.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    split = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high")
    split = split.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    now = now.join(split, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sides = F.flatten(F.array(
        F.transform(F.sequence("part", F.col("parts") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
        F.filter(F.transform(F.sequence(F.lit(0), "part"), lambda i: F.struct(i.alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"))), lambda x: x["i"] < x["j"])))
    dealt = now.join(nodes.select("node", "sketch", "bands"), "node").select("bucket", "node", "root", "sketch", "bands", F.explode(sides).alias("s"))
    dealt = dealt.select("bucket", "s.i", "s.j", "node", "root", "s.side", "sketch", "bands")
    blocked = dealt.repartition(partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    needed = map_rows(blocked, _needed, "bucket long, i int, j int, node binary, root binary, side int, sketch binary, bands binary")
    filled = needed.join(sets.select("node", "items"), "node").repartition(partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return map_rows(filled, _linked(percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id, kept for every row.

    Null and blank texts have an empty set, are linked with nothing and stay. Repeated rows have equal sets and so are one
    node: each is reported, and rows that share the least doc_id are all kept. A null doc_id counts as larger than
    any other; it is its own component if no id is reachable. Empty tables give empty tables. Other columns are not read.
    Bands and the sketch cut are set for PERCENT, where a pair is missed with the chances that the README states; a
    higher threshold misses fewer, a lower one raises.
    """
    if percent < PERCENT:
        raise ValueError(f"bands are set for {PERCENT} percent and more, not {percent}")
    spark, rows = docs.sparkSession, text_rows(docs)
    folder = shared_folder(spark)
    signed = written(map_rows(rows.withColumn("text_key", F.xxhash64("text")), _signatures, "doc_id long, text_key long, node binary, n_shingles long, sketch binary, bands binary"), folder, "signed")
    nodes = signed.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = written(nodes, folder, "nodes")
    entries = map_rows(nodes.select("node", "bands"), _entries, "node binary, bucket long")
    pivots = entries.groupBy("bucket").agg(F.min_by("node", F.xxhash64("node", "bucket")).alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    entries = written(entries.join(pivots, "bucket").select("bucket", "node", "pivot"), folder, "entries")
    pairs = entries.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    wanted = nodes.join(entries.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("id"))
    texts = rows.join(wanted.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = map_rows(texts.select("text"), _sets, "node binary, items binary").join(wanted.select("node"), "node", "left_semi")
    sets = written(sets.dropDuplicates(["node"]), folder, "sets")
    first = written(confirmed(pairs, sets, percent), folder, "first")
    roots = components(first, folder, "near")
    rest = written(rest_links(entries, roots, nodes, sets, percent), folder, "rest")
    links = first.unionByName(rest)
    roots = components(links, folder, "all")
    ids = nodes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(least, "root").select("node", "component_id")
    out = signed.select("doc_id", "text_key", "node", "n_shingles").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
p as (select doc_id, words, least(len(words), 5) as k, unnest(range(1, len(words) - least(len(words), 5) + 2)) as i from w where len(words) > 0),
s as (select distinct doc_id, array_to_string(words[i:i + k - 1], ' ') as t from p),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select doc_id, md5(string_agg(t, '|' order by t)) as set_id from s group by doc_id),
r as (select set_id, min(doc_id) as rep from c group by set_id),
m as (select c.doc_id, rep from c join r using (set_id)),
sr as (select s.* from s where doc_id in (select rep from r)),
j as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from sr a join sr b on a.t = b.t and a.doc_id < b.doc_id group by all),
e as (
  select a, b from j join n x on a = x.doc_id join n y on b = y.doc_id where 100 * shared >= 75 * (x.n + y.n - shared)),
both_ways as (select a, b from e union all select b, a from e),
walk as (
  select distinct rep as a, rep as b from m union select walk.a, both_ways.b from walk join both_ways on walk.b = both_ways.a),
least_of as (select a as rep, min(b) as low from walk group by a)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(low, w.doc_id) as component_id,
  w.doc_id = coalesce(low, w.doc_id) as kept
from w left join n using (doc_id) left join m using (doc_id) left join least_of using (rep)
"""
