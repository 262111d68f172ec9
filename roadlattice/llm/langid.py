"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import langid_kernel
from .common import held_out


def sample(train: DataFrame, per_lang: int, most_langs: int) -> DataFrame:
    """train(doc_id, text, lang) -> lang, text: at most ``per_lang`` rows of each of the ``most_langs`` languages with most
    different rows, those of least hash of id and text; rows that repeat count once. Only hashes are shuffled: about
    twice per_lang of a language pass a threshold on the hash that its number of different rows gives, and the texts of those
    that are chosen stay where they are."""
    key = F.xxhash64("doc_id", "text")
    counts = train.groupBy("lang").agg(F.approx_count_distinct(key).alias("c")).orderBy(F.desc("c"), "lang").limit(most_langs)
    below = counts.select("lang", (F.lit(2.0 * per_lang) / F.col("c") * float(1 << 40)).alias("below"))  # at most most_langs rows
    near = train.select("lang", key.alias("key")).join(F.broadcast(below), "lang").where(F.pmod("key", F.lit(1 << 40)) < F.col("below")).select("lang", "key").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 40)), "key"))
    chosen = near.withColumn("k", place).where(F.col("k") <= per_lang).select("lang", "key")
    # at most most_langs * per_lang rows of two short columns
    return train.withColumn("key", key).join(F.broadcast(chosen), ["lang", "key"]).select("lang", "key", "text")


def fit(train: DataFrame, *, dims: int = 4096, clusters: int = 4, per_lang: int = 400, most_langs: int = 8192) -> tuple:
    """Document frequencies over all rows of train(doc_id, text, lang); centroids from a bounded sample (see sample), clustered
    in one task a language. The driver gets dims counts and most_langs * clusters centroids at most
    (64 KB a language; most_langs is above the number of language codes there are)."""
    sums = {r.dim: r.df for r in train.select("text").mapInArrow(langid_kernel.document_frequencies(dims), "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()}
    n = sums.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([sums.get(i, 0) for i in range(dims)]))).astype(np.float32) + np.float32(0.05)
    few = sample(train.where(F.col("text").rlike("\\p{L}")), per_lang, most_langs)
    vectors = few.mapInArrow(langid_kernel.vectors(train.sparkSession.sparkContext.broadcast(idf)), "lang string, key long, v binary")
    found = vectors.dropDuplicates(["lang", "key"]).groupBy("lang").applyInPandas(langid_kernel.clusterer(clusters), "lang string, cluster long, c binary, reach double").collect()
    langs = sorted({r.lang for r in found})
    found.sort(key=lambda r: (r.lang, r.cluster))
    cents = [np.frombuffer(bytes(r.c), np.float32) for r in found]
    return idf, langs, np.array([langs.index(r.lang) for r in found], int), np.stack(cents) if cents else np.zeros((0, dims), np.float32), np.array([r.reach for r in found], np.float32)


def languages(docs: DataFrame, **fit_args) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score, cosine, rejected.

    Learns from text and lang of rows that are not held out, both not null. Every text is compared as a whole,
    by cosine, with all centroids. score is a logistic function of the lead over the next language.
    A text whose cosine is under half of what nearly all of the nearest centroid's own documents reach is
    ``rejected``; it still carries the nearest language. Null texts and texts without a letter are ``und``
    with score 0, and so is everything if there is nothing to learn from (an empty table gives no rows). Of languages
    equally near the first in order is taken. Texts of any length are read whole. Repeated rows each get their
    row. Other columns are ignored, whatever their names; a null doc_id is not held out. Of more than ``most_langs``
    languages those with fewest rows are not learnt.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out = held_out()
    model = docs.sparkSession.sparkContext.broadcast(fit(texts.where(~out & F.col("lang").isNotNull() & F.col("text").isNotNull()), **fit_args))
    found = texts.select("doc_id", "text").mapInArrow(langid_kernel.classifier(model), "doc_id long, lang_pred string, score double, cosine double, rejected boolean")
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "cosine", "rejected")
