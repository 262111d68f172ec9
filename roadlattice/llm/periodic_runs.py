"""Periodic runs of words: where a text repeats a stretch of words three times or more in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs_kernel


def periodic_runs(docs: DataFrame, *, least: int = 24, power: int = 3, rewrite=None) -> DataFrame:
    """documents -> doc_id, n_words, runs (array of start, length, period, by start and period), collapsed.

    A run is a stretch of consecutive words with smallest period q and at least max(least, power * q) words that no
    neighbouring word extends keeping period q. collapsed is the text without what follows a run's first period: the kept
    words joined by one space. Words lie between ASCII white space and are interned as numbers per text; runs are found by
    Main-Lorentz divide and conquer (see runs_kernel.find_runs). ``power`` is 3 or more, ``least`` 4 or more.

    ``rewrite`` takes the checksum of a document's id (-1 for a null id) and its number of words, and gives the number of the
    word that stands at each place, or None to leave the text as it is.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Texts of any length are searched whole:
    time grows with n log n of the stretches that repeat, memory with the text. Runs that start at one place are ordered by period
    (ties). Repeated rows each get their row, null ids stay null. An empty table gives no rows. Other columns are ignored,
    whatever their names. Nothing is shuffled.
    """
    if power < 3 or least < 4:
        raise ValueError("power is 3 or more and least 4 or more")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(-1)).alias("h"), F.col("text").cast("string").cast("binary").alias("text"))
    found = texts.mapInArrow(runs_kernel.detector(least, power, rewrite), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the run with the greatest exponent, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct((r.length / r.period).alias("e"), (-r.start).alias("s"), (-r.period).alias("q"), r.length.alias("length"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))))
    kept = found.withColumn("best", best)
    period = -F.col("best.q")
    return kept.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.q").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
