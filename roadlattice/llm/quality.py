"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SPACE = "\t\n\x0b\x0c\r "
SPACES = "[\\x20\\x09-\\x0D]+"
#: Metric (per mille of words; of lines for dup_lines): the two quantiles, per mille of documents, between which its spread
#: is measured, how many spreads beyond the second a value may lie, and whether a low value fails too (by the mirrored quantiles).
FENCES = {"word_length": (250, 750, 5, True), "symbols": (500, 800, 2, False), "dup_lines": (500, 990, 1, False), "repeats": (500, 990, 1, False)}
#: A group's rows meet its thresholds in so many parts, so that one group's documents are no single task.
SALTS = 16


def base_counts(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Five-word windows are compared by 64-bit hashes within their text. Only texts in which a window
    recurs are looked at more closely: their windows are sorted by hash, and those that equal a
    neighbour cover their words, counted from the gaps between their positions.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim("text", F.lit(SPACE))
    group = [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")]
    words = docs.select("doc_id", *group, text.alias("text")).select("*", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counted = words.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = counted.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.col("n_words") >= 5,
            F.transform(F.slice("h", F.lit(1), F.size("h") - 4), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2), F.get("h", i + 3), F.get("h", i + 4))),
        ).otherwise(F.array().cast("array<long>")).alias("w"),
    )
    again = windows.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("w")) < F.size("w"), F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
    ).drop("w")
    at = again.withColumn(
        "at",
        F.array_sort(F.transform(F.filter(F.transform("sorted", lambda e, k: F.struct(e["i"].alias("i"), ((k > 0) & (F.get("sorted", k - 1)["x"] == e["x"]) | F.coalesce(F.get("sorted", k + 1)["x"] == e["x"], F.lit(False))).alias("twice"))), lambda e: e["twice"]), lambda e: e["i"])),
    ).drop("sorted")
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("at", k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return at.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines")


def bin_of(v: Column) -> Column:
    """Bin of a whole number >= 0: one each below 64, then 32 to the octave (3 % wide)."""
    octave = F.length(F.bin(v)).cast("long") - 6
    return F.when(v < 64, v).otherwise(octave * 32 + F.floor(v / F.pow(F.lit(2.0), octave)).cast("long"))


def lower_edge(b: Column) -> Column:
    octave = F.floor(b / 32).cast("long") - 1
    return F.when(b < 64, b).otherwise(((b - octave * 32) * F.pow(F.lit(2.0), octave)).cast("long"))


def _fences(counts: DataFrame, by: list[str], suffix: str) -> DataFrame:
    """Thresholds from merged sketches. A sketch is a table of bin counts: merging is adding. A quantile is the lower edge
    of the bin that holds it."""
    w = Window.partitionBy(*by, "metric")
    merged = counts.groupBy(*by, "metric", "bin").agg(F.sum("c").alias("c"))
    cum = merged.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("bin")))
    at = lambda m, p: F.min(F.when((F.col("metric") == m) & (F.col("upto") * 1000 >= F.col("n") * p), F.col("bin")))
    marks = cum.groupBy(*by).agg(F.max("n").alias(f"n{suffix}"), *[at(m, p).alias(f"{m}_{p}") for m, (x, y, _, both) in FENCES.items() for p in ((x, y, 1000 - x, 1000 - y) if both and x + y != 1000 else (x, y))])
    out = []
    for m, (x, y, reach, both) in FENCES.items():
        edge = lambda p: lower_edge(F.col(f"{m}_{p}"))  # noqa: E731, B023
        out.append((edge(y) + reach * (edge(y) - edge(x))).alias(f"hi_{m}{suffix}"))
        if both:
            out.append((edge(1000 - y) - reach * (edge(1000 - x) - edge(1000 - y))).alias(f"lo_{m}{suffix}"))
    return marks.select(*by, f"n{suffix}", *out)


def thresholds(base: DataFrame, least_group: int) -> DataFrame:
    """g_lang, g_source -> hi_<metric> and lo_<metric>: the group's own, or if it has fewer than least_group documents, its
    language's, or if that is small too, those of all documents."""
    binned = base.where("not base_failed").select("g_lang", "g_source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(F.col(m)).alias("bin")) for m in FENCES])).alias("b"))
    counts = materialize(binned.groupBy("g_lang", "g_source", "b.metric", "b.bin").agg(F.count("*").alias("c")), "sketches")
    groups = base.select("g_lang", "g_source").distinct()
    for by, suffix in ((["g_lang", "g_source"], "_s"), (["g_lang"], "_l")):
        groups = groups.join(_fences(counts, by, suffix), by, "left")
    every = _fences(counts.withColumn("g_all", F.lit(1)), ["g_all"], "_a")
    groups = groups.withColumn("g_all", F.lit(1)).join(F.broadcast(every), "g_all", "left")  # one row
    names = [f"hi_{m}" for m in FENCES] + [f"lo_{m}" for m, (_, _, _, both) in FENCES.items() if both]
    pick = lambda x: F.when(F.col("n_s") >= least_group, F.col(f"{x}_s")).when(F.col("n_l") >= least_group, F.col(f"{x}_l")).otherwise(F.col(f"{x}_a")).alias(x)
    return groups.select("g_lang", "g_source", *[pick(x) for x in names])


def quality(docs: DataFrame, *, least_group: int = 30) -> DataFrame:
    """documents -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    failed (the adaptive rules that fail).

    base_failed: under 10 words, or over 20 % of the words in recurring five-word windows. The others
    feed, per language and source, sketches of four metrics: bin counts, merged by adding. A value fails beyond
    its group's thresholds, which are quantiles and spreads between quantiles alone (FENCES). Groups of fewer than
    ``least_group`` such documents use the merged sketch of their language, and if that is small too, of all
    documents. The filter joins the thresholds to the counts.

    Null texts have no words and fail. Null lang and source are groups of their own, as are missing columns of these
    names. Repeated rows count each; a value equal to a threshold passes (ties). Texts of any length are counted whole.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    base = materialize(base_counts(docs), "quality").withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    per = lambda a, b: F.floor(F.col(a) * 1000 / F.greatest(F.col(b), F.lit(1))).cast("long")
    base = base.select("*", per("word_chars", "n_words").alias("word_length"), per("n_symbols", "n_words").alias("symbols"), per("n_dup_lines", "n_lines").alias("dup_lines"), per("n_repeat_words", "n_words").alias("repeats"))
    base = base.withColumn("g_lang", F.coalesce("lang", F.lit("\x00"))).withColumn("g_source", F.coalesce("source", F.lit("\x00")))
    limits = thresholds(base, least_group).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(limits, ["g_lang", "g_source", "salt"], "left")
    failed = []
    for m, (_, _, _, both) in FENCES.items():
        bad = F.col(m) > F.col(f"hi_{m}")
        if both:
            bad = bad | (F.col(m) < F.col(f"lo_{m}"))
        failed.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(m)))
    judged = judged.withColumn("failed", F.array_compact(F.array(*failed)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), F.array_join(F.array_sort("failed"), ",").alias("failed"))
