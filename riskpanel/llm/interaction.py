"""How document filters overlap: sorted posting lists of failing documents, merged by galloping.

Documents of a part are cut into segments of an id range each. A segment keeps one sorted list of failing positions for
each filter. Unions and differences of these lists, summed over segments, give what every filter order does at every step.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.llm.common import looked_up, map_rows, shared_folder, table, text_bytes, written

#: Distinct documents of a segment, at most.
SEGMENT = 65_536
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = b"#$%&*|"
_CONTINUED = bytes(range(0x80, 0xC0))


def _without(text: bytes, gone: bytes) -> int:
    return len(text.translate(None, gone))


#: Filters that see one text at a time: (text as UTF-8, its words) -> whether it fails.
TEXT_FILTERS: dict[str, Callable[[bytes, list[bytes]], bool]] = {
    "A": lambda text, words: len(words) < 100,
    "B": lambda text, words: 100 * len(set(words)) < 80 * len(words),
    "C": lambda text, words: 100 * (len(text) - _without(text, _CAPITALS)) > 10 * _without(text, _CONTINUED),
    "D": lambda text, words: _without(text, _MARKS) < len(text),
}
#: The filter that fails a text which a smaller doc_id has too.
COPIES = "E"


def gallop(values: list[int], at: int, bound: int) -> int:
    """First position from `at` on whose value is not below `bound`, in strides that double."""
    step, high, n = 1, at, len(values)
    while high < n and values[high] < bound:
        at, high, step = high + 1, high + step, 2 * step
    return bisect_left(values, bound, at, min(high, n))


def union(lists: list[list[int]]) -> list[int]:
    """Sorted union of sorted lists: the list with the least head gives its run up to the least head of the others."""
    live = [[values[0], values, 0] for values in lists if values]
    out: list[int] = []
    while len(live) > 1:
        least = min(live, key=itemgetter(0))
        bound = min(entry[0] for entry in live if entry is not least)
        head, values, at = least
        if head == bound:  # another list holds it too and will give it
            end = at + 1
        else:
            end = gallop(values, at, bound)
            out += values[at:end]
        if end == len(values):
            live = [entry for entry in live if entry is not least]
        else:
            least[0], least[2] = values[end], end
    for _, values, at in live:
        out += values[at:]
    return out


def difference(values: list[int], gone: list[int]) -> list[int]:
    """Values of the first sorted list that the second lacks."""
    out: list[int] = []
    i = j = 0
    while i < len(values) and j < len(gone):
        if values[i] < gone[j]:
            end = gallop(values, i, gone[j])
            out += values[i:end]
            i = end
        elif values[i] == gone[j]:
            i, j = i + 1, j + 1
        else:
            j = gallop(gone, j, values[i])
    return out + values[i:]


def _flags(filters: dict):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, keys = [], []
            for text in text_bytes(batch):
                words = text.split()
                masks.append(sum(bool(fails(text, words)) << i for i, fails in enumerate(filters.values())))
                keys.append(hashlib.md5(text, usedforsecurity=False).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "part", "mask", "text_key"])

    return work


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict | None = None) -> DataFrame:
    """part, doc_id, mask (bit i: fails the filter i; the last one: a copy), good, toxic, n (rows alike in all of these)."""
    filters = TEXT_FILTERS if filters is None else filters
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").alias("text"))
    seen = written(map_rows(rows, _flags(filters), "doc_id long, part string, mask int, text_key binary"), folder, "flags")
    first = seen.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    known = looked_up(seen, first, "text_key", seen.count())
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.col("doc_id").isNull() & F.col("first_id").isNotNull()).cast("int")
    known = known.select("doc_id", "part", F.col("mask").bitwiseOR(F.shiftleft(copy, len(filters))).alias("mask"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = known.filter("doc_id is not null").join(marks, "doc_id", "left")
    nameless = known.filter("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    both = named.unionByName(nameless)
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    return both.groupBy("part", "doc_id", "mask", *flags).agg(F.count("*").alias("n"))


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[tuple]]]:
    """Runs of one part of up to `size` rows, from rows that come sorted by part and doc_id."""
    part, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("part", "doc_id", "mask", "good", "toxic", "n")]
        for row in zip(*columns):
            if held and (row[0] != part or len(held) == size):
                yield part, held
                held = []
            part = row[0]
            held.append(row[1:])
    if held:
        yield part, held


_POSTINGS = "part string, ids array<long>, n array<long>, good array<int>, toxic array<int>, failing array<array<int>>"


def _lists(filters: int, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _segments(batches, size):
            ids, masks, good, toxic, n = (np.array(c) if k else list(c) for k, c in enumerate(zip(*rows)))
            yield pa.RecordBatch.from_arrays([
                pa.array([part]), pa.array([ids], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())),
                pa.array([np.flatnonzero(good)], pa.list_(pa.int32())), pa.array([np.flatnonzero(toxic)], pa.list_(pa.int32())),
                pa.array([[np.flatnonzero(masks >> f & 1) for f in range(filters)]], pa.list_(pa.list_(pa.int32())))],
                ["part", "ids", "n", "good", "toxic", "failing"])

    return work


def postings(failed: DataFrame, filters: int, size: int = SEGMENT) -> DataFrame:
    """One row for each part and id range: its ids in order, how many rows each stands for, and sorted lists of positions
    in them: of good and of toxic documents, and for each filter of those that fail it."""
    ranged = failed.repartitionByRange("part", "doc_id").sortWithinPartitions("part", "doc_id")
    return map_rows(ranged, _lists(filters, size), _POSTINGS)


def _sizes(filters: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For every filter and every set of earlier filters: what the filter removes, and what then is left."""
        every = range(1 << filters)
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n"], np.int64)
                good, toxic = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                good[row["good"]], toxic[row["toxic"]] = n[row["good"]], n[row["toxic"]]
                failing, unions, left = row["failing"], [[]], [int(n.sum())]
                for chosen in every[1:]:
                    last = chosen.bit_length() - 1
                    unions.append(union([unions[chosen ^ 1 << last], failing[last]]))
                    left.append(left[0] - int(n[unions[-1]].sum()))
                out = []
                for f in range(filters):
                    for before in every:
                        if not before >> f & 1:
                            gone = np.array(difference(failing[f], unions[before]), np.int64)
                            out.append((row["part"], f, before, left[before | 1 << f], *(int(w[gone].sum()) for w in (n, good, toxic))))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 ["part", "filter", "before", "kept", "removed", "good_lost", "toxic_lost"])

    return work


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang", filters: dict | None = None, copies: str = COPIES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each
    part, order of the filters (those of `filters`, then `copies`) and step of it.

    A null part is the empty string, a null text is empty. Every row is a document, repeated rows too. A null doc_id
    counts as larger than any other and has no label; a document with several labels is good, or toxic, if one says so.
    Rows that share the least doc_id of a text are no copies. Texts are equal if their 128-bit digests are. A part with no
    failing document has its rows, with zeros. An empty table of documents gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    filters = TEXT_FILTERS if filters is None else filters
    names = [*filters, copies]
    folder = shared_folder(spark)
    failed = written(failures(docs, labels, part, filters), folder, "failed")
    kept = written(postings(failed, len(names)), folder, "postings")
    sizes = map_rows(kept, _sizes(len(names)), "part string, filter int, before int, kept long, removed long, good_lost long, toxic_lost long")
    sizes = sizes.groupBy("part", "filter", "before").agg(*(F.sum(c).alias(c) for c in ("kept", "removed", "good_lost", "toxic_lost")))
    same = Window.partitionBy("part", "filter")
    others = (1 << len(names)) - 1 - F.expr("shiftleft(1, filter)")
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names)))), F.bit_count("before") + 1)
    sizes = sizes.withColumns({
        "failing": F.max(F.when(F.col("before") == 0, F.col("removed"))).over(same),
        "unique_fails": F.max(F.when(F.col("before") == others, F.col("removed"))).over(same),
        "shapley": F.sum(F.col("removed") * orders).over(same)})
    steps = [("".join(names[f] for f in order), k + 1, f, sum(1 << g for g in order[:k])) for order in permutations(range(len(names))) for k, f in enumerate(order)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    out = sizes.join(F.broadcast(steps), ["filter", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
                      "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
with x as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    cast(len(words) < 100 as int) + 2 * cast(100 * len(list_distinct(words)) < 80 * len(words) as int)
    + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as int)
    + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(x.doc_id > min(x.doc_id) over (partition by t) as int) as mask
  from x left join l on x.doc_id = l.doc_id),
m as (
  select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
e as (select i, substr('ABCDE', i + 1, 1) as letter, 1 << i as bit from (select unnest(range(0, 5))::int as i)),
o as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from e a, e b, e c, e d, e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
  from o, (select unnest(range(1, 6))::int as step)),
r as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter ((mask & (before | bit)) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter ((mask & bit) > 0 and (mask & before) = 0), 0)::bigint as removed,
    coalesce(sum(n) filter ((mask & bit) > 0 and (mask & before) > 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter ((mask & bit) > 0 and (mask & before) = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter ((mask & bit) > 0 and (mask & before) = 0), 0)::bigint as toxic_lost
  from m, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, bit))::bigint as shapley
from r
"""
