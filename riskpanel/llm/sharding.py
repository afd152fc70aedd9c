"""Shards by extendible hashing: a bucket splits on its next hash bit only while it is too large. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskpanel.llm.common import shared_folder, table, unused, written

#: A shard's limit in bytes of text.
LIMIT = 32 << 20
#: Hash bits: the first come from the key, the rest from the row's number and only matter where one key overflows a shard.
KEY_BITS, ROW_BITS = 36, 24
BITS = KEY_BITS + ROW_BITS
#: Bits of the count that tells rows apart whose hash is the same to the last bit.
OWN_BITS = 31
#: Bits that one round over the rows looks at.
STEP = 8


def keyed(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, bytes, the hash of every row and the carried columns; the number of a row is fixed once this is written."""
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")
    row = F.conv(F.substring(F.md5(F.monotonically_increasing_id().cast("string")), 1, ROW_BITS // 4), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"),
                       F.shiftleft(key, ROW_BITS).bitwiseOR(row).alias("hash"), *carried)


def prefix(depth):
    """The leading `depth` bits of the hash, as a number."""
    return F.expr(f"shiftright(hash, {BITS} - {depth})")


def leaves(rows: DataFrame, base: int, depth: int, limit: int) -> DataFrame:
    """For each prefix of `depth` bits: the least number of bits, from `base`, at which its bucket fits; null if none does.

    A bucket of one row always fits, since a document is not cut.
    """
    fine = rows.groupBy(prefix(depth).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    nodes = fine.select("*", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("level"))
    nodes = nodes.withColumn("node", F.expr(f"shiftright(fine, {depth} - level)"))
    fits = nodes.groupBy("level", "node").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("rows")).filter((F.col("shard_bytes") <= limit) | (F.col("rows") == 1))
    best = nodes.select("fine", "level", "node").join(fits, ["level", "node"]).groupBy("fine").agg(F.min(F.struct("level", "shard_bytes")).alias("leaf"))
    return fine.select("fine").join(best, "fine", "left").select("fine", "leaf.level", "leaf.shard_bytes")


def assign_shards(docs: DataFrame, limit: int = LIMIT, *carried: str) -> DataFrame:
    """doc_id, bytes, shard (the hash prefix as bits), depth, shard_bytes and the carried columns for every row.

    Rows with one key share a shard unless they alone exceed the limit; then the bits of their row numbers split them. A
    row over the limit is a shard of its own, and so is each row of a bucket that is too large with all hash
    bits used. Null texts have no bytes; null ids share the key of the empty string; repeated rows each count; an empty table
    has no shard. Other columns are not read, so none can clash; carried ones need names of their own.
    """
    folder = shared_folder(docs.sparkSession)
    rows = written(keyed(docs, *carried), folder, "rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    base, depth, parts = 0, min(BITS, max(1, -(-total // limit)).bit_length() + 3), []
    while True:
        found = written(leaves(rows, base, depth, limit), folder, f"leaves-{depth}")
        parts.append(rows.join(found.withColumnRenamed("fine", "own"), prefix(depth) == F.col("own")).filter("level is not null").select(
            "doc_id", "bytes", "hash", F.col("level").alias("depth"), "shard_bytes", F.lit(0).alias("own"), *carried))
        left = found.filter("level is null").select("fine")
        if left.isEmpty():
            break
        if depth == BITS:
            number = F.row_number().over(Window.partitionBy("hash").orderBy("doc_id", "bytes"))
            parts.append(rows.join(left, F.col("hash") == F.col("fine"), "left_semi").select(
                "doc_id", "bytes", "hash", F.lit(BITS + OWN_BITS).alias("depth"), F.col("bytes").alias("shard_bytes"), number.alias("own"), *carried))
            break
        rows = written(rows.join(left, prefix(depth) == F.col("fine"), "left_semi"), folder, f"rows-{depth}")
        base, depth = depth + 1, min(BITS, depth + STEP)
    out = reduce(DataFrame.unionByName, parts)
    alone = F.concat(F.lpad(F.conv("hash", 10, 2), BITS, "0"), F.lpad(F.conv("own", 10, 2), OWN_BITS, "0"))
    bits = F.when(F.col("depth") == 0, "").when(F.col("depth") > BITS, alone).otherwise(F.expr(f"substring(lpad(conv(shiftright(hash, {BITS} - depth), 10, 2), depth, '0'), 1, depth)"))
    return out.select("doc_id", "bytes", bits.alias("shard"), "depth", "shard_bytes", *carried)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """All rows of `docs` with their columns, in one folder a shard, named `shard=b` and its bits.

    Rows are told apart by a number of their own, so null and repeated ids each keep their rows. If a column is called
    shard, the folders' name gets an underscore. An empty table writes no shard.
    """
    number, shard = unused(docs, "row_number"), unused(docs, "shard")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), shared_folder(docs.sparkSession), "numbered")
    shards = assign_shards(rows, limit, number).select(number, F.concat(F.lit("b"), F.col("shard")).alias(shard))
    rows.join(shards, number).drop(number).repartition(shard).write.partitionBy(shard).parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select doc_id, cast(coalesce(strlen(text), 0) as bigint) as bytes, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 9) as bigint) as h from documents),
l as (select doc_id, bytes, h, level, h >> (36 - level) as node from d, (select cast(unnest(range(0, 37)) as integer) as level)),
n as (select level, node, sum(bytes) as shard_bytes from l group by all having sum(bytes) <= 33554432 or count(*) = 1),
best as (select doc_id, l.bytes, h, min(l.level) as depth, arg_min(shard_bytes, l.level) as shard_bytes from l join n using (level, node) group by all)
select doc_id, bytes, right(lpad(bin(h), 36, '0'), 36)[1:depth] as shard, cast(depth as integer) as depth, cast(shard_bytes as bigint) as shard_bytes from best
"""
