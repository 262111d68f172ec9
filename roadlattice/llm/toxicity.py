"""Toxicity by multiple-instance learning: noisy-or over sentence scores, trained on document labels."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import toxicity_kernel
from .common import held_out


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = 1500, word_chars: int = 40_000) -> tuple[float, dict[str, float]]:
    """Fit on at most ``per_label`` labelled documents of each label (those of least hash of the id, of
    at most ``word_chars`` characters; of rows that repeat an id the least text), from rows that are not held out."""
    usable = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label in (0, 1):
        part = usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.where(F.length("text") <= word_chars).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # at most 2 * per_label rows
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return toxicity_kernel.train([r.text for r in rows], [r.toxic for r in rows])


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, **fit_args) -> DataFrame:
    """documents -> doc_id, held_out, score, predicted, n_sentences, worst, offending.

    score is the noisy-or of the sentence scores; worst and offending give the numbers of the
    sentences (those with words, from 0) with the highest score and with 0.5 or more. Only text
    enters a score. Null and wordless texts score 0. Labels other than 0 and 1 and labels of
    unknown documents are ignored; of contradicting labels of one id the greater counts. Without
    labels of both kinds every sentence scores alike. Of sentences that score alike the first is the worst (ties); a score
    of exactly 0.5 is toxic. Texts of any length are scored whole. A null doc_id is not held out. Repeated rows each get
    their row. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(train_docs, labels, **fit_args))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(toxicity_kernel.scorer(model), "doc_id long, score double, n_sentences long, worst long, offending array<long>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst", "offending")


def keep_civil(docs: DataFrame, labels: DataFrame, **fit_args) -> DataFrame:
    """documents without those predicted toxic; the rows stay where they are.

    Null and empty texts and null ids stay, repeated rows stay or go together, all columns pass through. Ties, long texts
    and labels as in toxicity.
    """
    run = toxicity_kernel.judge(docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **fit_args)))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(texts)

    return docs.where(score(F.col("text").cast("string")) < 0.5)
