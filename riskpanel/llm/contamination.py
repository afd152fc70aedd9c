"""Benchmark passages in documents by winnowed fingerprints. DataFrame functions only.

A window of t words has t - k + 1 runs of k words; the least of their hashes is the window's fingerprint. Equal windows have
equal fingerprints, so joining fingerprints finds every shared window; the windows behind a hit are then compared as words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.common import ascii_lower, shared_folder, table, written
from riskpanel.llm.lines import gram_hashes

WINDOW = 13
GRAM = 5
#: What stands between words once A-Z are lower case.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document is contaminated if hit words times this reach its words.
RATIO = 20


def split_words(text: Column) -> Column:
    """Lower-case words; none for null. Plain lower() does the same where all characters are ASCII, and is faster."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    parts = F.split(low, BREAKS)
    return F.filter(parts, lambda w: w != "")


def fingerprints(words: Column, grams: Column, length: int) -> Column:
    """The fingerprint of each window of `length` words, by the position where it starts."""
    w = length - min(GRAM, length) + 1
    n = F.size(grams)
    return F.when(n >= w, F.transform(F.slice(grams, 1, F.greatest(n - (w - 1), F.lit(0))), lambda x, i: F.least(
        x, *(F.get(grams, i + j) for j in range(1, w))) if w > 1 else x)).otherwise(F.array().cast("array<bigint>"))


def fingerprint_runs(rows: DataFrame, length: int) -> DataFrame:
    """Neighbouring windows mostly share a fingerprint: one row for each run of them, with its first and last start."""
    keys = [c for c in rows.columns if c != "words"]
    cut = rows.withColumn("grams", gram_hashes(F.col("words"), min(GRAM, length)))
    cut = cut.select(*keys, fingerprints(F.col("words"), F.col("grams"), length).alias("prints"))
    starts = F.array_compact(F.transform("prints", lambda x, i: F.when(~F.get(F.col("prints"), i - 1).eqNullSafe(x), i)))
    cut = cut.withColumn("starts", starts)
    runs = F.transform("starts", lambda s, j: F.struct(
        F.get(F.col("prints"), s).alias("print"), s.alias("first"), (F.coalesce(F.get(F.col("starts"), j + 1), F.size("prints")) - 1).alias("last")))
    return cut.select(*keys, F.explode(runs).alias("run")).select(*keys, F.lit(length).alias("length"), "run.*")


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, length, window: runs of WINDOW words of each item, or all its words if there are fewer."""
    rows = items.select(F.col("item_id"), split_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    rows = rows.select("item_id", length.alias("length"), "words", F.explode(starts).alias("start"))
    return rows.select("item_id", "length", F.slice("words", F.col("start"), F.col("length")).alias("words")).distinct()


def contamination(docs: DataFrame, items: DataFrame, ratio: int = RATIO) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items (sorted as strings, comma-joined), contaminated for every row.

    A null text has no words; an item without words has no window and one of fewer than WINDOW words is one window. An
    item with a null id marks words but is not listed. Rows with the same doc_id and text are the same document and each
    get its result. Empty tables give no hits or no rows. Other columns are not read, so none can clash.
    """
    folder = shared_folder(docs.sparkSession)
    windows = written(benchmark_windows(items), folder, "windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # WINDOW numbers at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    cut = rows.select("doc_id", "text_key", split_words(F.col("text")).alias("words"))
    counts = cut.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
    if not lengths:
        none = counts.select("doc_id", "text_key").filter("false")
        marked = none.select("*", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"))
    else:
        marked = _marked(rows, cut, windows, lengths, folder)
    marked = marked.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    out = counts.join(marked, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "text_key", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"), ((hit > 0) & (ratio * hit >= F.col("n_words"))).alias("contaminated"))


def _marked(rows: DataFrame, cut: DataFrame, windows: DataFrame, lengths: list[int], folder: str) -> DataFrame:
    """Per document with a hit: marked words and items."""
    wanted = windows.select("length", "words").distinct()
    prints = reduce(DataFrame.unionByName, [
        fingerprint_runs(wanted.filter(F.col("length") == n).select("words"), n).select("length", "print").distinct() for n in lengths])
    prints = written(prints, folder, "prints")
    # no hint: Spark broadcasts the prints if their files are small, and shuffles both sides otherwise
    hits = reduce(DataFrame.unionByName, [fingerprint_runs(cut, n) for n in lengths]).join(prints, ["length", "print"], "left_semi")
    hits = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("length", "first", "last")).alias("runs"))
    hits = written(hits, folder, "hits")
    again = rows.join(hits.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"}),
                      F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")))
    starts = F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda i: F.struct(r["length"].alias("length"), i.alias("start")))))
    again = again.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", split_words(F.col("text")).alias("words"), "runs")
    again = again.select("doc_id", "text_key", "words", F.array_distinct(starts).alias("starts"))
    window = F.transform("starts", lambda w: F.struct(  # built before exploding, so that no row carries all words
        w["start"].alias("start"), (w["start"] + w["length"]).alias("end"), F.concat_ws(" ", F.slice("words", w["start"] + 1, w["length"])).alias("window")))
    spans = again.select("doc_id", "text_key", F.explode(window).alias("w")).select("doc_id", "text_key", "w.*")
    named = windows.select(F.concat_ws(" ", "words").alias("window"), F.col("item_id").cast("string").alias("item_id"))
    found = spans.join(named, "window").groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n")),
        lambda a: a["n"])
    return found.select("doc_id", "text_key", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
bs as (select item_id, words, least(len(words), 13) as n, unnest(range(1, len(words) - least(len(words), 13) + 2)) as p from b where len(words) > 0),
bw as (select distinct item_id, n, array_to_string(words[p:p + n - 1], ' ') as t from bs),
ds as (select doc_id, words, l.n, unnest(range(1, len(words) - l.n + 2)) as p from d, (select distinct n from bw) l where len(words) >= l.n),
dw as (select doc_id, n, p, array_to_string(words[p:p + n - 1], ' ') as t from ds),
hit as (select doc_id, dw.n, p, item_id from dw join bw using (t)),
w as (select doc_id, count(distinct p + k.k) as n_hit from hit, (select unnest(range(0, 13)) as k) k where k.k < hit.n group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by doc_id)
select d.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join w using (doc_id) left join i using (doc_id)
"""
