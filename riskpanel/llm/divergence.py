"""How the word use of sources differs within a language: exact integer divergences from sparse term counts.

One translate call lowers letters and blanks separators, split and a Counter for each document give its terms. Only terms
that a source has are ever stored; those that it lacks have one common probability, so that their part of a sum over the
whole vocabulary follows from how often each probability occurs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.llm.common import map_rows, partitions, shared_folder, table, text_bytes, written

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
#: Entries and text bytes that a task gathers before it sends them on.
HELD_ENTRIES = 600_000
HELD_BYTES = 64 << 20
#: Sources of a language that one group of a term holds; more are dealt into buckets, and groups hold two of these.
BUCKET = 256
#: Pair values that numpy handles at once.
CELLS = 1 << 21
#: Letters lower-cased, all other bytes below 0x80 blanked, the rest as it is.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Counter:
    """How often each term of a text occurs."""
    return Counter(text.translate(TABLE).split())


def _flush(held: dict, documents: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), counts in held.items():
        words = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(words) + 1)), pa.array([source] * (len(words) + 1)), pa.array([*words, None], pa.binary()).cast(pa.string()),
             pa.array([*counts.values(), 0], pa.int64()), pa.array([*map(documents[lang, source].__getitem__, words), 0], pa.int64())],
            ["lang", "source", "term", "n", "documents"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by (lang, source), and a row without a term for the group itself."""
    held, documents, entries, size = defaultdict(Counter), defaultdict(Counter), 0, 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), text_bytes(batch)):
            found = terms(text)
            held[lang, source].update(found)
            documents[lang, source].update(found.keys())
            entries, size = entries + len(found), size + len(text)
            if size >= HELD_BYTES or entries >= HELD_ENTRIES and sum(map(len, held.values())) >= HELD_ENTRIES:
                yield from _flush(held, documents)
                held, documents, entries, size = defaultdict(Counter), defaultdict(Counter), 0, 0
            elif entries >= HELD_ENTRIES:  # mostly terms seen before
                entries = 0
    yield from _flush(held, documents)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), documents (that have it); and for each (lang, source) a row with a null term."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = map_rows(rows, _count, "lang string, source string, term string, n long, documents long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _probability(n: str, total: str) -> Column:
    """1 + floor(10^9 (n + 1) / total), in decimals, since the product can pass 64 bits."""
    return F.expr(f"1 + (cast({n} + 1 as decimal(20, 0)) * cast(1000000000 as decimal(10, 0))) div cast({total} as decimal(20, 0))")


def _excess(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1, so the square fits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def weighted(counts: DataFrame, least: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cells, groups): the kept terms that groups have with their probabilities p there and q in the language, and every
    group with its language's vocabulary size and the probability `zero` of a kept term that it lacks."""
    named = counts.filter("term is not null")
    same = Window.partitionBy("lang", "term")
    kept = named.withColumns({"lang_n": F.sum("n").over(same), "held_by": F.sum("documents").over(same), "place": F.row_number().over(same.orderBy("source"))})
    cells = written(kept.filter(F.col("held_by") >= least).select("lang", "source", "term", "n", "lang_n", (F.col("place") == 1).cast("long").alias("first")), folder, "cells")
    langs = cells.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("n").alias("lang_total"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "terms", "lang_total"])
    groups = groups.withColumn("zero", F.when(F.col("terms") > 0, _probability("0L", "greatest(total + terms, 1L)")))
    groups = written(groups, folder, "groups")
    cells = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "zero", _probability("n", "(total + terms)").alias("p"), _probability("lang_n", "(lang_total + terms)").alias("q"))
    return written(cells, folder, "weighted"), groups


def distinctive_terms(cells: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source uses more than its language, furthest first."""
    found = cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), _excess("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _floor(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _changed(rows: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns; the first does."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for name in columns:
        column = rows.column(name).combine_chunks()
        out[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return out


class _Sums:
    """Pair sums of one (lang, i, j) as a matrix over the sources seen so far."""

    def __init__(self, key: tuple):
        self.key, self.names, self.values = key, {}, np.zeros((0, 0), np.int64)

    def add(self, rows: pa.Table, starts: np.ndarray) -> None:
        """What the common terms of each pair change against the sums that take one of the two at its `zero`."""
        source = rows.column("source").combine_chunks().dictionary_encode()
        code = np.array([self.names.setdefault(s, len(self.names)) for s in source.dictionary.to_pylist()], np.int64)[source.indices.to_numpy()]
        if len(self.names) > len(self.values):
            grown = np.zeros((2 * len(self.names),) * 2, np.int64)
            grown[:len(self.values), :len(self.values)] = self.values
            self.values = grown
        side, p, zero = (rows.column(c).to_numpy() for c in ("side", "p", "zero"))
        flat, width = self.values.reshape(-1), len(self.values)
        lengths = np.diff(np.r_[starts, len(p)])
        for size in np.unique(lengths[lengths > 1]):
            here = starts[lengths == size]
            for cut in range(0, len(here), step := max(1, CELLS // int(size * size))):
                at = here[cut:cut + step, None] + np.arange(size)
                x, y, zx, zy = p[at][:, :, None], p[at][:, None, :], zero[at][:, :, None], zero[at][:, None, :]
                value = _floor(x, y) - _floor(x, zy) - _floor(zx, y) + _floor(zx, zy)
                if self.key[1] != self.key[2]:
                    value[side[at][:, :, None] == side[at][:, None, :]] = 0
                np.add.at(flat, (code[at][:, :, None] * width + code[at][:, None, :]).ravel(), value.ravel())

    def result(self) -> pa.RecordBatch:
        a, b = np.nonzero(self.values)
        names = pa.array(list(self.names), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([self.key[0]] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(self.values[a, b])],
                                          ["lang", "source", "other", "value"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair sums over common terms by (lang, i, j), from rows that come sorted by (lang, i, j, term)."""
    group = ("lang", "i", "j")
    held, rest = None, None
    for batch in chain((b for b in batches if b.num_rows), (None,)):
        rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rows is None:
            return
        starts = np.flatnonzero(_changed(rows, (*group, "term")))
        if batch is not None:  # the last term may go on in the next batch
            rest, rows, starts = rows.slice(starts[-1]), rows.slice(0, starts[-1]), starts[:-1]
        cuts = np.flatnonzero(_changed(rows, group))
        for a, b in zip(cuts, np.r_[cuts[1:], rows.num_rows]):
            key = tuple(rows.column(c)[int(a)].as_py() for c in group)
            if held is None or held.key != key:
                if held is not None:
                    yield held.result()
                held = _Sums(key)
            held.add(rows.slice(a, b - a), starts[(starts >= a) & (starts < b)] - a)
    if held is not None:
        yield held.result()


def source_pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value, rank: the sum of excesses over all kept terms.

    Over a vocabulary of V terms a sum is V f(zero, zero), plus for the terms of each side alone what their own
    probabilities change against the other's zero, plus for common terms what remains. The first two parts need only how
    often each probability occurs in a source; the last is summed in tasks over runs of terms.
    """
    spark = cells.sparkSession
    own = groups.select("lang", "source", "zero", "terms")
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    pairs = own.join(other, "lang").filter("source <> other")
    base = pairs.select("lang", "source", "other", F.when(F.col("terms") > 0, F.expr("terms * (((zero - other_zero) * (zero - other_zero)) div other_zero)")).otherwise(0).alias("value"))
    often = cells.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("n"))
    sided = often.join(other, "lang").filter("source <> other")
    there = (_excess("p", "other_zero") - _excess("zero", "other_zero")) * F.col("n")
    back = (_excess("other_zero", "p") - _excess("other_zero", "zero")) * F.col("n")
    alone = sided.select("lang", F.inline(F.array(
        F.struct(F.col("source"), F.col("other"), there.alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("other"), back.alias("value")))))

    buckets = groups.groupBy("lang").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("buckets"))
    dealt = cells.join(buckets, "lang").withColumn("bucket", F.pmod(F.xxhash64("source"), F.col("buckets")).cast("int"))
    sides = F.flatten(F.array(
        F.transform(F.sequence("bucket", F.col("buckets") - 1), lambda j: F.struct(F.col("bucket").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
        F.filter(F.transform(F.sequence(F.lit(0), "bucket"), lambda i: F.struct(i.alias("i"), F.col("bucket").alias("j"), F.lit(1).alias("side"))), lambda x: x["i"] < x["j"])))
    dealt = dealt.select("lang", "source", "term", "p", "zero", F.explode(sides).alias("s")).select("lang", "s.i", "s.j", "term", "source", "s.side", "p", "zero")
    sorted_terms = dealt.repartition(partitions(spark), "lang", "i", "j", "term").sortWithinPartitions("lang", "i", "j", "term")
    common = map_rows(sorted_terms, _shared, "lang string, source string, other string, value long").filter("source <> other")

    parts = base.unionByName(alone).unionByName(common)
    # exact beyond 64 bits on the way; the whole sum fits
    total = parts.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.withColumn("rank", F.row_number().over(order))


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank for every (lang, source) group.

    Null text, lang and source are empty strings. Every row counts as a document, repeated rows too; doc_id is not read.
    A group without terms takes part in pairs; where a language keeps no term, all its pairs have the value 0. Ties are
    ranked by the bytes of the item. Terms have any length. An empty table gives an empty table; other columns are not read.
    """
    folder = shared_folder(docs.sparkSession)
    counts = written(term_counts(docs), folder, "counts")
    cells, groups = weighted(counts, least, folder)
    found = distinctive_terms(cells, top).withColumn("part", F.lit("term"))
    both = source_pairs(cells, groups).withColumn("part", F.lit("pair")).unionByName(found)
    return both.select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
t as (select id, lang, source, unnest(terms) as term from d),
k as (
  select lang, term, count(*)::hugeint as n from t group by lang, term having count(distinct id) >= 3),
l as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as n from t semi join k using (lang, term) group by all),
gt as (select lang, source, sum(n)::hugeint as total from c group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(gt.total, 0) + l.v) as p,
    1 + 1000000000::hugeint * (k.n + 1) // (l.total + l.v) as q
  from g join l using (lang) join k using (lang) left join c using (lang, source, term) left join gt using (lang, source)),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every_pair as (
  select a.lang, a.source, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
words as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from every_pair
union all
select lang, source, 'term', item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from words
qualify rank <= 200
"""
