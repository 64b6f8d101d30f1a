"""Shuffled shards by a two-pass external shuffle.

First pass: a seeded hash of a record's id, text and place in the input scatters the records over buckets, as many as
keep each in memory, and writes them to the shared folder; so no bucket can be hot, whatever ids and texts repeat,
and what a lost executor recomputes cannot disagree with the counts. Second pass: the buckets are counted, and each
is put in order and shuffled by Fisher and Yates (Spark's shuffle() with a seed). The records of all buckets in turn,
with the counts telling where each begins, are dealt to the shards: a run of neighbouring places each, counts at most
one apart (the law `rows`).

Null texts have no bytes. The result is the same for the same input files and seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.common import staged, table

SHARDS = 40
SEED = 20_240
BUCKET_BYTES = 8 << 20


def shuffled(docs: DataFrame, shards: int = SHARDS, *, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, shard, slot): each record of docs whole, its shard (from 0) and its place there, gapless from 0."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    weight = docs.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    buckets = max(1, min(-(-weight // bucket_bytes), 1 << 30))
    mixed = F.xxhash64(F.lit(seed), "doc_id", "text", F.monotonically_increasing_id())
    # the hash places a record in its bucket; its other bits put the bucket in order before the shuffle
    scattered = staged(docs.select(F.pmod(mixed, F.lit(buckets)).cast("int").alias("bucket"), mixed.alias("order"), row.alias("row")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each bucket, so the running sum over them is small
    sizes = staged(scattered.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", "n", before.alias("first")))
    rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = min(buckets, 100_000)  # a task for each bucket, so that a task stays as large at any input
    held = scattered.repartitionById(parts, F.col("bucket")).groupBy("bucket").agg(F.collect_list(F.struct("order", "row")).alias("held"))
    held = held.join(sizes, "bucket").select("first", F.array_sort("held", lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)).alias("held"))
    out = held.select("first", F.posexplode(F.shuffle("held", seed)).alias("at", "r"))
    # the first `more` shards hold one row more than the others
    each, more = divmod(rows, shards)
    place, wide = F.col("place"), more * (each + 1)
    out = out.select(F.col("r.row").alias("row"), (F.col("first") + F.col("at")).alias("place"))
    shard = F.when(place < wide, F.floor(place / (each + 1))).otherwise(more + F.floor((place - wide) / max(1, each))).cast("int")
    out = out.withColumn("shard", shard)
    begin = F.when(F.col("shard") <= more, F.col("shard") * (each + 1)).otherwise(wide + (F.col("shard") - more) * each)
    return out.select("row", "shard", (place - begin).cast("long").alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, **options) -> None:
    """Parquet (row, slot) below folder, a subfolder for each shard, its rows in order of slot."""
    out = shuffled(docs, shards, **options)
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.col("row.text")
    return out.select(
        "row.doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
