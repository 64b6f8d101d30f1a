"""Helpers shared by the corpus operators: staging, table access, Arrow slicing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_FILE = "byte_bpe_50k.json"
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only a session on one machine (master local, as in tests) may go without that setting and gets a folder of its
    own; anywhere else that is an error, as executors do not see each other's local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='terraloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/staged-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here drop their shuffle files when they end: what they write is read from then on."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)


def staged(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df below the shared folder and read it back, which cuts its lineage and frees its shuffle files.

    The folder stays until `discard`, or as long as whoever owns spark.checkpoint.dir keeps it.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with freed_shuffles(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that no later query reads."""
    spark = df.sparkSession
    folders = {x.rsplit("/", 1)[0] for x in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame, *, most: int = 10_000, hot: int = 100_000, how: str = "inner") -> DataFrame:
    """big.join(small, keys, how) where one key may hold any share of big's rows; small has a row for each key at most.

    counts: keys and n, the rows of big with that key. The `most` largest keys of more than `hot` rows, a table of
    bounded size, are dealt to a part for every `hot` rows, and small's row of such a key is repeated for each part.
    Any other key has fewer rows than hot, or less than one in `most` of all rows.
    """
    large = counts.where(F.col("n") > hot).orderBy(F.desc("n"), *keys).limit(most).select(*keys, F.ceil(F.col("n") / hot).cast("int").alias("_parts"))
    large = F.broadcast(large)
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1)))).cast("int")
    left = big.join(large, keys, "left").withColumn("_part", part).drop("_parts")
    right = small.join(large, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at its end gives free memory back to the system: an idle worker lives on beside the next stages."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return out


def give_back() -> None:
    """Return free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of `column` (one row at least)."""
    import numpy as np

    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < len(col):
            end = max(at + 1, int(np.searchsorted(offs, int(offs[at]) + limit, "right")) - 1)
            end = min(end, len(col))
            yield batch.slice(at, end - at)
            at = end
