"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_kernel


def fit(pages: DataFrame, *, sample_pages: int = 400, page_chars: int = 200_000, page_blocks: int = 1000) -> np.ndarray:
    """Weights of the block classifier, fitted on at most ``sample_pages`` pages of at most ``page_chars`` characters: those of
    least hash of id, address and html; those of more than ``page_blocks`` blocks teach nothing. Tasks read their blocks; the driver gets features alone."""
    usable = pages.where(F.length("html") <= page_chars).withColumn("key", F.xxhash64("page_id", "url", "html"))
    n = usable.count()
    if not n:
        return html_kernel.PRIOR
    order = F.pmod("key", F.lit(1 << 40))
    keys = usable.select("key").where(order < F.lit(2.0 * sample_pages / n * (1 << 40))).distinct().orderBy(order, "key").limit(sample_pages)
    chosen = usable.join(F.broadcast(keys), "key").select("key", "html")  # sample_pages keys at most
    rows = chosen.mapInArrow(html_kernel.sampler(page_blocks), "key long, blocks binary").dropDuplicates(["key"]).collect()
    return html_kernel.fit([pickle.loads(bytes(r.blocks)) for r in sorted(rows)])


def main_texts(pages: DataFrame, **fit_args) -> DataFrame:
    """pages -> page_id, url, text, n_chars.

    A page's blocks are labelled together: costs of a classifier (text, links, elements, names; fitted by self-training, see
    html_kernel.fit) are terminal capacities, neighbourhood on the page and in the tree are smoothness edges, and
    the minimum cut separates content from boilerplate. The content blocks, white space turned into
    single spaces, are joined by two line feeds; names count only against what leaves the page an article (html_kernel.wrappers); a page without any gives an empty text. Broken markup is read as browsers
    do (open paragraphs end at the next block, an open head at the first text).

    Null html is empty. A block whose cost and neighbours balance is boilerplate (ties). Pages of any length are read
    whole. Repeated rows each get their row; no page is shuffled. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    texts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = pages.sparkSession.sparkContext.broadcast(fit(texts, **fit_args))  # some eighty numbers
    return texts.mapInArrow(html_kernel.extractor(model), "page_id long, url string, text string, n_chars long")
