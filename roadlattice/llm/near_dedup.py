"""MinHash near-duplicate detection: banded candidates, signature check, exact confirmation, components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import materialize
from .components import connected_components

SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"


def sign(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(kernels.signer(bands, rows, width), SIGNED)


def _looks_similar(pairs: DataFrame, sigs: DataFrame, k: int, least: float) -> DataFrame:
    """Signature verification: drops candidate pairs whose minima agree too rarely."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        return pd.Series(kernels.similar(kernels.signature_matrix(x, k), kernels.signature_matrix(y, k)) >= least)

    a, b = (sigs.select(F.col("id").alias(n), F.col("sig").alias(f"sig_{n}")) for n in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").where(near("sig_a", "sig_b")).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = (sets.select(F.col("id").alias(n), F.col("set").alias(f"set_{n}")) for n in ("a", "b"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(kernels.confirmer(percent), "a long, b long")


def _across(shared: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, k: int, least: float, percent: int, block: int, target_block: int) -> DataFrame | None:
    """Links between different components that share a bucket: members outside a bucket's largest component
    meet all its members, in blocks that a task holds one at a time. There signatures pass or drop a pair, the
    first bucket that both share decides it, on the full sets, and one link to a component is enough. Only links
    leave the task. None if no bucket has two components."""
    placed = shared.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    open_buckets = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    placed = materialize(placed.join(open_buckets, "bucket", "left_semi"), "placed")
    if placed.isEmpty():
        return None
    largest = (
        placed.groupBy("bucket", "comp", "n").agg(F.count("*").alias("c")).groupBy("bucket", "n").agg(F.max(F.struct("c", "comp")).alias("top"))
        .select("bucket", F.col("top.comp").alias("top"), F.ceil((F.col("n") - F.col("top.c")) / block).alias("q_chunks"), F.ceil(F.col("n") / target_block).alias("t_chunks"))
    )
    ready = placed.join(largest, "bucket").join(classes.select("id", "sig", "bands"), "id").join(sets, "id")
    queries = (
        ready.where("comp <> top")
        .withColumn("q_chunk", F.expr("pmod(xxhash64(id), q_chunks)"))
        .withColumn("t_chunk", F.explode(F.expr("sequence(0L, t_chunks - 1)")))
        .withColumn("is_query", F.lit(True))
    )
    targets = (
        ready.withColumn("t_chunk", F.expr("pmod(xxhash64(id, 7), t_chunks)"))
        .withColumn("q_chunk", F.explode(F.expr("sequence(0L, q_chunks - 1)")))
        .withColumn("is_query", F.lit(False))
    )
    cols = ["bucket", "q_chunk", "t_chunk", "is_query", "id", "comp", "sig", "bands", "set"]
    blocks = queries.select(cols).union(targets.select(cols)).repartition("bucket", "q_chunk", "t_chunk").sortWithinPartitions("bucket", "q_chunk", "t_chunk", F.desc("is_query"))
    return blocks.mapInArrow(kernels.cross_block(k, least, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, percent: int = 75, width: int = 5, bands: int = 32, rows: int = 4, least: float = 0.58, block: int = 256, target_block: int = 4096) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept.

    1. Texts with equal shingle sets form a class; its least doc_id stands for it. The grouping
       combines before its shuffle, so a third of all rows in one class is no hot spot.
    2. ``bands`` x ``rows`` universal hash minima of each class; equal bands share a bucket. With 4
       rows and 32 bands a pair at similarity 0.75 is missed with probability 5e-6.
    3. Every bucket links its members to its least id (a star, not all pairs); candidates pass the
       signature check (``least``, over four deviations below the limit) and are confirmed on the
       full sets (percent * union <= 100 * intersection).
    4. In buckets that still hold several components, members outside the largest one meet all members
       in bounded blocks, by signature and then on the full sets; only links leave the task. So every
       bucket pair is decided unless its two documents are already in one component, with no cap.
    5. Components by alternating large-star and small-star.

    Null or blank texts have no shingles and link with nothing. A null doc_id links with nothing and
    is kept. Rows that repeat a doc_id count as one document for links (of different texts the
    greatest stands for it in confirmations). A pair at exactly the limit is linked (ties); texts of any length enter
    with all their shingles. An empty table gives no rows. Other columns are ignored, whatever their names. Ids are whole
    numbers.
    """
    k = bands * rows
    signed = materialize(sign(docs, bands, rows, width), "signed")
    classes = materialize(
        signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("bands", "sig"), "doc_id").alias("s")).select("set_key", "id", "s.bands", "s.sig"),
        "classes",
    )
    members = classes.select("id", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(members.join(buckets, "bucket").select("bucket", "id", "head", "n"), "buckets")
    sigs = classes.select("id", "sig")
    wanted = shared.select("id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(wanted, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    sets = materialize(texts.mapInArrow(kernels.setter(width), "id long, set binary"), "sets")
    star = shared.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    edges = materialize(_confirmed(_looks_similar(star, sigs, k, least), sets, percent), "edges")
    comps = materialize(connected_components(edges), "comps")
    more = _across(shared, comps, classes, sets, k, least, percent, block, target_block)
    if more is not None:
        comps = materialize(connected_components(edges.union(materialize(more, "edges"))), "comps")
    reached = (
        classes.select("set_key", "id").join(comps, "id", "left").select("set_key", F.coalesce("comp", "id").alias("component_id"))
    )
    return signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(reached, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """documents without all but one document of each near-duplicate group, that of least doc_id.

    Null ids, null and empty texts stay; rows that repeat a doc_id stay or go together; all columns pass through. Ties,
    long texts and empty tables as in near_duplicates.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
