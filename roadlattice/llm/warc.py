"""Deterministic sharded WARC archives of pages."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import warc_kernel
from .common import materialize

MANIFEST = "shard long, part long, file string, records long, bytes long, sha256 string"
#: What a record's headers weigh beside its payload when shards are measured.
HEAD_BYTES = 400


def _shard_starts(keys: DataFrame, shard_bytes: int, most_shards: int) -> list[tuple]:
    """(page_id, digest) of the first record of each shard but the first. A sampled range partitioning orders the records;
    the partitions' bytes before each, and a running sum within it, give every record its place in the whole, so
    the starts depend on the records alone. The driver gets one number a partition and one pair a shard."""
    ranged = keys.repartitionByRange("page_id", "digest").select(F.spark_partition_id().alias("part"), "page_id", "digest", (F.col("size") + HEAD_BYTES).alias("n"))
    ranged = materialize(ranged, "warc-keys")
    before, total = {}, 0
    for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        before[r.part], total = total, total + r.n
    step = max(shard_bytes, -(-total // most_shards))
    if total <= step:
        return []
    skip = ranged.sparkSession.createDataFrame(list(before.items()), "part int, skip long")  # one row a partition
    order = Window.partitionBy("part").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    placed = ranged.join(F.broadcast(skip), "part").withColumn("at", F.col("skip") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    firsts = placed.groupBy(F.floor(F.col("at") / step).alias("shard")).agg(F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "digest")).alias("f"))
    return sorted({(r.f.known, r.f.page_id or 0, r.f.digest) for r in firsts.where("shard > 0").collect()})


def write_archives(pages: DataFrame, uri: str, *, least_bytes: int = 1000, shard_bytes: int = 64 << 20, most_shards: int = 1 << 16, roll_bytes: int = 8 << 20) -> DataFrame:
    """Write pages(page_id, url, html) as WARC files under ``uri``; returns the manifest, which names the
    complete files (columns shard, part, file, records, bytes, sha256).

    Every page is one record, its payload the html in UTF-8 (null: empty). Of equal payloads of at
    least ``least_bytes`` bytes the record with the greatest page_id is a response and the others
    revisit it. Records are sorted by page_id over all shards (nulls first; ties by digest, then url); a shard is
    a range of about ``shard_bytes`` of payload (more where that made over ``most_shards``), its files are rolled at
    ``roll_bytes`` compressed. Bytes depend on the rows alone, not on partitions: fixed date, headers
    and digests made anew. Compressed records are shuffled once, each to the task of its shard; which of them are
    revisits comes to the same task as a small row ahead of them.

    Rows that repeat a page_id each give a record, of equal record id (those of the greatest page_id are responses
    each). Payloads of any length are written whole. An empty table gives an empty manifest. Other columns are
    ignored, whatever their names.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keys = materialize(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size")), "warc-digests")
    starts = spark.sparkContext.broadcast(_shard_starts(keys, shard_bytes, most_shards))  # most_shards pairs at most

    @F.pandas_udf("int")
    def shard_of(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for known, ids, digests in columns:
            yield pd.Series([bisect_right(starts.value, (bool(k), int(i), d)) for k, i, d in zip(known, ids, digests)], dtype="int32")

    shard = shard_of(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), F.col("digest")).alias("shard")
    equal = keys.where(F.col("size") >= least_bytes)
    heads = equal.groupBy("digest", "size").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null").drop("n")
    revisits = equal.join(heads, ["digest", "size"]).where(~F.col("page_id").eqNullSafe(F.col("head"))).select("page_id", "digest", "size", "head").distinct()
    marks = revisits.select(shard, F.lit(0).alias("is_record"), "page_id", F.lit(None).cast("string").alias("url"), "digest", "size", F.lit(None).cast("binary").alias("member"), F.col("head").alias("refers_to"))
    records = pages.mapInArrow(warc_kernel.recorder, "page_id long, url string, digest string, size long, member binary")
    placed = records.select(shard, F.lit(1).alias("is_record"), "page_id", "url", "digest", "size", "member", F.lit(None).cast("long").alias("refers_to")).union(marks)
    ordered = placed.repartitionById(len(starts.value) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "is_record", "url")
    manifest = ordered.mapInArrow(warc_kernel.writer(uri, roll_bytes), MANIFEST)
    spark._jvm.org.apache.hadoop.fs.Path(uri).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(uri))
    manifest.write.parquet(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    """The page records of the files that the manifest under ``uri`` names, with lengths and digests checked."""
    files = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest").select("file").repartition(spark.sparkContext.defaultParallelism * 2)
    return files.mapInArrow(warc_kernel.reader(uri), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
