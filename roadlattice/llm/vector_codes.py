"""Vector compression: each vector as the numbers of its parts' nearest codebook entries."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codes_kernel
from .common import materialize

#: A label counts as hot if it has more than one row in so many; so there are fewer hot labels than this.
HOT_SHARE = 256


def components(vectors: DataFrame, scale: int = 256, parts: int = 16) -> DataFrame:
    """vec_id, label, embedding -> vec_id, label, x: components as integers floor(scale * x)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(lambda batches: codes_kernel.integers(batches, scale, parts), "vec_id long, label long, x array<long>")


def train(x: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks (parts, entries, components): the parts of the first vectors by id, then means of their members, rounded down.
    A round brings one row for each task, part and entry into the shuffle and parts * entries * components sums to the driver."""
    first = x.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = x.mapInArrow(codes_kernel.summer(x.sparkSession.sparkContext.broadcast(books)), "part long, entry long, dim long, total long, n long").groupBy("part", "entry", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = books.copy()
        for r in sums.collect():
            books[r.part, r.entry, r.dim] = r.total // r.n
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, *, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """embeddings -> vec_id, code, error, label, label_error, codebooks_sha256.

    Each component x becomes the integer floor(scale * x). Vectors are cut into ``parts`` equal parts; a part's code is the
    number of its nearest codebook entry (at most 256 entries), found by a float32 product with error intervals and int64
    distances where these overlap (see codes_kernel.nearest). error is the sum of the parts' squared distances, label_error the
    sum of the errors of equal labels.

    Vectors that are null or empty or hold null or non-finite components are left out. Equally near entries go to the lower number (ties).
    Vectors that share the least ids are taken by their components; null ids come last. Repeated rows each count and get their
    row. Null labels are equal to each other. With fewer vectors than entries the codebooks are smaller; an empty table gives no
    rows. Components beyond 2^25 after scaling are taken as that. All vectors have one length, a multiple of ``parts`` (else an
    error). Other columns are ignored, whatever their names.

    Sums of labels meet their rows without shuffling those of hot labels: fewer than HOT_SHARE labels can have more than that
    share of the rows, and only these are broadcast.
    """
    if entries > 256:
        raise ValueError("codes have two hex digits, so at most 256 entries")
    spark = vectors.sparkSession
    x = components(vectors, scale, parts)
    books = train(x, parts=parts, entries=entries, rounds=rounds)
    digest = F.lit(books_digest(books)).alias("codebooks_sha256")
    coded = materialize(x.mapInArrow(codes_kernel.coder(spark.sparkContext.broadcast(books)), "vec_id long, label long, code string, error long"), "codes")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-sums")
    rows = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > rows
    few = F.broadcast(sums.where(hot).select(F.col("label").alias("hot_label"), F.col("label_error").alias("hot_error"), F.lit(True).alias("hot")))
    others = sums.where(~hot).select(F.col("label").alias("its_label"), "label_error")
    met = coded.join(few, F.col("label").eqNullSafe(F.col("hot_label")), "left")
    columns = ["vec_id", "label", "code", "error", "label_error"]
    spread = met.where(F.col("hot").isNull()).join(others, F.col("label").eqNullSafe(F.col("its_label"))).select(columns)
    return met.where("hot").withColumnRenamed("hot_error", "label_error").select(columns).union(spread).withColumn("codebooks_sha256", digest)
