"""Quality rules: counts per text, and lines that too many documents of one host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.common import SPACE, shared_folder, table, written

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: A line goes where at least this many documents of its host have it, and at least this share of the host's documents.
LINE_DOCS = 20
LINE_SHARE = 0.01
#: A document is depleted with fewer words left than this, or less than this share of them.
WORDS_LEFT = 10
SHARE_LEFT = 0.1
GRAM = 5


def split_words(text: Column) -> Column:
    """Words of a text without nulls; none if it is blank."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACE}+"))


def gram_hashes(words: Column, k: int) -> Column:
    """A hash for each run of k words, by the position where it starts."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.slice(words, 1, F.greatest(n - (k - 1), F.lit(0))), lambda w, i: F.xxhash64(
        w, *(F.get(words, i + j) for j in range(1, k))))).otherwise(F.array().cast("array<bigint>"))


def sorted_grams(grams: Column) -> Column:
    """Hashes with their positions, sorted, if any hash occurs twice: sorting keeps long texts cheap."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), pairs)


def repeated_words(pairs: Column) -> Column:
    """Words inside runs of GRAM words that a text holds twice or more, from a column of sorted_grams."""
    starts = F.transform(pairs, lambda x, j: F.when(
        F.get(pairs, j - 1)["g"].eqNullSafe(x["g"]) | F.get(pairs, j + 1)["g"].eqNullSafe(x["g"]), x["i"]))
    return F.aggregate(
        F.sort_array(F.array_compact(starts)), F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + GRAM).alias("end"), (a["n"] + p + GRAM - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_key and the counts of every row's own text."""
    rows = text_keys(docs).withColumn("text", F.coalesce("text", F.lit("")))
    cut = rows.select("doc_id", "host", "text", split_words(F.col("text")).alias("words"),
                      F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    # each array is a column of its own: an expression inside a lambda would be computed anew for every element
    grams = cut.withColumn("grams", gram_hashes(F.col("words"), GRAM)).withColumn("pairs", sorted_grams(F.col("grams")))
    again = F.coalesce(repeated_words(F.col("pairs")), F.lit(0).cast("long"))
    counted = grams.select(
        "doc_id", "host", F.xxhash64("text").alias("text_key"), F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), again.alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as one blank and none at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), f"{SPACE}+", " "), "[0-9]", "0"))


def text_keys(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_key and text; a null host is the host ''."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"), F.col("text").cast("string").alias("text"))


def host_texts(docs: DataFrame) -> DataFrame:
    """host, text_key, copies, docs: rows and distinct documents that hold each text with a word; rows without an id are documents of their own."""
    rows = text_keys(docs).filter(F.btrim("text", F.lit(SPACES)) != "").groupBy("host", "text_key", "doc_id").agg(F.count("*").alias("rows"))
    return rows.groupBy("host", "text_key").agg(
        F.sum("rows").alias("copies"), F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(1)).alias("docs"))


def host_lines(docs: DataFrame) -> DataFrame:
    """host, text_key, line, n, hits: each distinct line of each text of a host, its number of words, and how often the text's rows hold it."""
    lines = F.filter(F.transform(F.split("text", "\n"), normal_line), lambda x: x != "")
    each = text_keys(docs).select("host", "text_key", F.explode(F.transform(lines, lambda x: F.struct(
        F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("n")))).alias("x"))
    return each.groupBy("host", "text_key", "x.line").agg(F.max("x.n").alias("n"), F.count("*").alias("hits"))


def lost_lines(docs: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """host, text_key, lost, gone: texts with lines over the limits, the words in them and the hashes of these lines.

    Texts travel by their hash. Copies of a text are one entry with their number, so that neither a hot host nor a group
    of copies makes the shuffles larger; the counts are of documents all the same.
    """
    folder = shared_folder(docs.sparkSession)
    texts, lines = written(host_texts(docs), folder, "texts"), written(host_lines(docs), folder, "lines")
    copied = texts.filter(F.col("copies") > 1)
    hosts = texts.groupBy("host").agg(F.sum("docs").alias("all_docs"))
    known = lines.join(copied, ["host", "text_key"], "left")
    seen = known.groupBy("host", "line").agg(F.sum(F.coalesce("docs", F.lit(1))).alias("seen")).filter(F.col("seen") >= line_docs)
    common = seen.join(hosts, "host").filter(F.col("seen") >= F.col("all_docs") * line_share).select("host", "line")
    hit = lines.join(common, ["host", "line"]).groupBy("host", "text_key").agg(F.sum(F.col("n") * F.col("hits")).alias("lost"), F.collect_list("line").alias("gone"))
    # every row of a text holds a line equally often
    return hit.join(copied, ["host", "text_key"], "left").select("host", "text_key", F.expr("lost div coalesce(copies, 1)").alias("lost"), "gone")


def line_rules(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """doc_id, the counts of each text, base_failed, words_left, depleted and kept for every row.

    A line goes where `line_docs` documents and `line_share` of the documents of a host have it; a document that loses
    lines and keeps fewer than WORDS_LEFT words, or less than SHARE_LEFT of them, is depleted. Documents are counted,
    copies of a text too; repeated rows (same id and text) count once and are repeated in the result. Null and empty
    texts have no words and fail the base rule. A null host is a host of its own. An empty table gives an empty table.
    Extra columns are not read.
    """
    out = text_counts(docs).join(lost_lines(docs, line_docs, line_share).drop("gone"), ["host", "text_key"], "left")
    out = out.withColumn("words_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    depleted = (F.col("words_left") < F.col("n_words")) & ((F.col("words_left") < WORDS_LEFT) | (F.col("words_left") < SHARE_LEFT * F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left",
                      depleted.alias("depleted"), (~F.col("base_failed") & ~depleted).alias("kept"))


def remove_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """`docs` without the depleted documents, and in the others' texts without the lines over the limits.

    Limits are those of line_rules. Kept lines stay as they are, in order; null, empty and blank texts stay. Rows, ids and
    all other columns stay, of any name. An empty table gives an empty table.
    """
    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    keyed = rows.select("row", F.coalesce(F.col("row.source").cast("string"), F.lit("")).alias("host"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    found = keyed.join(lost_lines(docs, line_docs, line_share), ["host", "text_key"], "left")
    cut = found.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(normal_line(x)))), "\n")).otherwise(text))
    n_words = F.size(split_words(F.coalesce(text, F.lit(""))))
    rest = n_words - F.col("lost")
    kept = cut.filter(F.col("gone").isNull() | ~((rest < WORDS_LEFT) | (rest < SHARE_LEFT * n_words)))
    return kept.select(*(F.col("left").alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).drop("depleted")


SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
g as (
  select doc_id, p, array_to_string(words[p:p + 4], ' ') as t from (select doc_id, words, unnest(range(1, len(words) - 3)) as p from d where len(words) >= 5)),
many as (select doc_id, t from g group by all having count(*) > 1),
again as (select doc_id, count(distinct g.p + k.k) as n from g join many using (doc_id, t), (select unnest(range(0, 5)) as k) k group by doc_id),
l as (select doc_id, host, text, unnest(string_split(text, chr(10))) as line from d),
lw as (select * from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct line) as n from lw group by doc_id),
n as (
  select host, text, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') as line,
    count(*) as hits
  from l group by all),
c as (
  select host, text, count(*) as copies, count(distinct doc_id) + count(*) - count(doc_id) as docs from d where len(words) > 0 group by all),
h as (
  select host, text, line, docs, (len(line) - len(replace(line, ' ', '')) + 1) * hits / copies as n
  from n join c using (host, text) where line <> ''),
docs as (select host, sum(docs) as all_docs from c group by host),
common as (
  select host, line from (select host, line, sum(docs) as seen from h group by all) join docs using (host)
  where seen >= 20 and seen >= 0.01 * all_docs),
lost as (select host, text, cast(sum(n) as bigint) as n from h join common using (host, line) group by all),
m as (
  select d.doc_id, cast(len(words) as bigint) as n_words, cast(len(array_to_string(words, '')) as bigint) as word_chars,
    cast(len(d.text) - len(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(again.n, 0) as bigint) as n_repeat_words,
    cast(len(words) - coalesce(lost.n, 0) as bigint) as words_left
  from d left join again using (doc_id) left join dup using (doc_id) left join lost on d.host = lost.host and d.text = lost.text)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words_left,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
    and not (words_left < n_words and (words_left < 10 or words_left < 0.1 * n_words)) as kept
from m
"""
