"""Benchmark decontamination with Wu-Manber search."""

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wu_manber
from .common import materialize, unused

FOUND = "doc_id long, n_words long, spans array<array<long>>, items array<string>"
PLACED = "part long, block long, size long, item string, text string"


class Blocks:
    """The items in blocks of at most block_chars characters of text (one item at least). Tasks number
    the blocks of their rows; only the blocks' sizes come to the driver, which joins neighbours that
    fit into one block. ``load`` reads the items of one of them."""

    def __init__(self, benchmark: DataFrame, block_chars: int):
        def place(batches):
            part, block, room, started = TaskContext.get().partitionId(), 0, block_chars, False
            for batch in batches:
                sizes = [len(t or "") for t in batch.column(1).to_pylist()]
                blocks = []
                for n in sizes:
                    if started and room < n:
                        block, room = block + 1, block_chars
                    started, room = True, room - n
                    blocks.append(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(sizes), pa.int64()), pa.array(blocks, pa.int64()), pa.array(sizes, pa.int64()), batch.column(0), batch.column(1)], names=["part", "block", "size", "item", "text"]
                )

        items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null")
        self.placed = materialize(items.mapInArrow(place, PLACED), "items")
        self.ranges, room = [], 0
        for r in self.placed.groupBy("part", "block").agg(F.sum("size").alias("size")).orderBy("part", "block").collect():
            at = (r["part"], r["block"])
            if self.ranges and r["size"] <= room:
                self.ranges[-1][1], room = at, room - r["size"]
            else:
                self.ranges.append([at, at])
                room = block_chars - r["size"]

    def __len__(self) -> int:
        return len(self.ranges)

    def load(self, k: int) -> list[tuple]:
        if not self.ranges:
            return []
        first, last = (F.struct(F.lit(p).cast("long").alias("part"), F.lit(b).cast("long").alias("block")) for p, b in self.ranges[k])
        return [(r["item"], r["text"]) for r in self.placed.where(F.struct("part", "block").between(first, last)).select("item", "text").collect()]


def _united(rows: DataFrame, blocks: Blocks, width: int) -> DataFrame:
    """row, text -> row, n_words, spans, items: one block of items after the other is read, broadcast, searched
    for, written and let go; the hits are united by row."""
    sc = rows.sparkSession.sparkContext
    texts = rows.select(F.col("row").alias("doc_id"), "text")
    parts = []
    for k in range(len(blocks)):
        shared = sc.broadcast(wu_manber.tables(blocks.load(k), width))
        found = texts.mapInArrow(wu_manber.scanner(shared), FOUND)
        parts.append(materialize(found.where(F.size("spans") > 0) if k else found, "found"))
        shared.unpersist()

    @F.pandas_udf("array<array<bigint>>")
    def merged(spans: pd.Series) -> pd.Series:
        return pd.Series([wu_manber.merged([tuple(x) for x in s]) for s in spans], dtype=object)

    united = reduce(DataFrame.unionAll, parts).groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return united.select("row", "n_words", merged("spans").alias("spans"), "items")


def _judged(found: DataFrame, per_cent: int) -> DataFrame:
    @F.pandas_udf("n_hit long, n_items long, items_sha256 string")
    def summed(spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([wu_manber.totals(s, i) for s, i in zip(spans, items)], columns=["n_hit", "n_items", "items_sha256"])

    return found.withColumn("t", summed("spans", "items")).withColumn("contaminated", (F.col("t.n_hit") > 0) & (F.col("t.n_hit") * 100 >= F.col("n_words") * per_cent))


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, block_chars: int = 20_000_000, per_cent: int = 5) -> DataFrame:
    """documents, benchmark -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A window is ``width`` consecutive words of an item (a shorter item is one window). A document
    word inside any occurrence of a window is hit; a document is contaminated if it has hits and
    they make up ``per_cent`` of its words. Search tables are broadcast one block of items of at
    most ``block_chars`` characters at a time; a larger benchmark makes more passes over the
    documents, whose hits are united by row, so what is broadcast at once never grows.

    Null or wordless texts have no words and are clean. Null item ids and texts are no items.
    Repeated items count once by id. Rows that repeat a doc_id each get their own row. A document with exactly per_cent of
    its words hit is contaminated (ties). Texts of any length are searched whole. Without documents there are no rows, and
    without items all are clean. Other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = Blocks(benchmark, block_chars)
    if len(blocks) > 1:
        rows = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
        found = rows.select("row", "doc_id").join(_united(rows, blocks, width), "row").select("doc_id", "n_words", "spans", "items")
    else:
        found = texts.mapInArrow(wu_manber.scanner(docs.sparkSession.sparkContext.broadcast(wu_manber.tables(blocks.load(0), width))), FOUND)
    return _judged(found, per_cent).select("doc_id", "n_words", "t.n_hit", "t.n_items", "t.items_sha256", "contaminated", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, block_chars: int = 20_000_000, per_cent: int = 5) -> DataFrame:
    """documents without the contaminated ones. With one block of items the rows stay where they are;
    with more, rows are numbered and written, and the numbers of contaminated ones are joined.

    Every row is judged by its own text, so rows with null or repeated ids stay or go each for itself; null and empty texts
    stay; all columns pass through. Ties, long texts and empty tables as in contamination.
    """
    blocks = Blocks(benchmark, block_chars)
    if len(blocks) > 1:
        mark = unused(docs, "row")
        rows = materialize(docs.withColumn(mark, F.monotonically_increasing_id()), "rows")
        found = _united(rows.select(F.col(mark).alias("row"), F.col("text").cast("string").alias("text")), blocks, width)
        bad = _judged(found, per_cent).where("contaminated").select(F.col("row").alias(mark))
        return rows.join(bad, mark, "left_anti").select(docs.columns)
    run = wu_manber.judge(docs.sparkSession.sparkContext.broadcast(wu_manber.tables(blocks.load(0), width)), per_cent)

    @F.pandas_udf("boolean")
    def bad_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(texts)

    return docs.where(~bad_text(F.col("text").cast("string")))
