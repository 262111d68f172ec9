"""Line dedup with a log-template tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A token with one of these is a variable field.
VARIABLE = "[0-9@=/\\\\_#]"
WILD = "<*>"
#: A token of a node is constant at one of these shares of its documents; a line has a template for each.
SHARES = (0.5, 0.1, 0.0)
SALTS = 16
#: Columns of the join, of names that no table of documents has.
KEY, DROP = "__line_dedup_key", "__line_dedup_drop"


def tokens(line: Column) -> Column:
    """Tokens between single white space characters of a line; variable fields as the wildcard."""
    found = F.array_remove(F.split(line, "[ \\t\\r\\f\\x0B]"), "")
    return F.when(line.rlike(VARIABLE), F.transform(found, lambda t: F.when(t.rlike(VARIABLE), F.lit(WILD)).otherwise(t))).otherwise(found)


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"))


def _parsed(docs: DataFrame, depth: int, least_tokens: int) -> DataFrame:
    """Each line of least_tokens tokens or more: key, line, node (path in the tree), leaf (whole template),
    its tokens (n) and those that are no wildcards (fixed), raw (the line itself) and body (a digest of all templates of the document, short lines too, which tells documents apart)."""
    text = F.col("text").cast("string")
    lines = docs.select("doc_id", text.alias("text")).where("text is not null").select(_key().alias("key"), F.split("text", "\n").alias("lines"))
    leaves = lines.select(
        "key",
        F.filter(
            F.transform(
                F.transform("lines", lambda x: F.struct(tokens(x).alias("t"), F.xxhash64(F.btrim(x, F.lit(" \t\r\f\x0b"))).alias("raw"))),
                lambda s, i: F.struct(
                    i.alias("line"),
                    F.size(s["t"]).alias("n"),
                    F.size(F.array_remove(s["t"], WILD)).alias("fixed"),
                    F.xxhash64(F.size(s["t"]), F.slice(s["t"], 1, depth)).alias("node"),
                    F.xxhash64(s["t"]).alias("leaf"),
                    s["raw"].alias("raw"),
                ),
            ),
            lambda s: s["n"] > 0,
        ).alias("parsed"),
    )
    rows = leaves.select("key", F.xxhash64(F.sort_array("parsed.leaf")).alias("body"), F.explode("parsed").alias("p"))
    return rows.where(F.col("p.n") >= least_tokens).select("key", "p.line", "p.node", "p.n", "p.fixed", "p.leaf", "p.raw", "body")


def _support(rows: DataFrame, by: str) -> DataFrame:
    """Different documents of each value; two aggregations that combine before they shuffle."""
    return rows.groupBy(by, "body").agg(F.lit(1).alias("one")).groupBy(by).agg(F.count("*").alias("support"))


def _in_parts(df: DataFrame) -> DataFrame:
    """Each row once for every salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))


def recurring_lines(docs: DataFrame, *, depth: int = 3, least_tokens: int = 3, least_support: int = 5, constant: float = 0.6) -> DataFrame:
    """(key, drop): for each document (by key) the numbers of its lines whose template recurs, in order.

    The tree has three levels: token count, the first ``depth`` tokens, the template. Variable
    fields (tokens with a digit or a sign such as @ = / _ #) are wildcards from the start. In a
    node that ``least_support`` different documents share, a token becomes a wildcard too if fewer
    than ``least_support`` of the node's documents, or fewer than a share of them, have it at that
    place. A line has one template for each share in SHARES that leaves ``constant`` of its tokens:
    high shares generalise fields however many lines there are, low ones keep apart the templates of a
    mixed node. Lines with less in common keep their own template if ``constant`` of its tokens
    are no wildcards, and otherwise recur only as they are. A line is dropped if one of its templates
    recurs, that is, lines in ``least_support`` different documents have it. Documents differ by all
    their lines' templates together, in any order: only whole copies of one document (but for variable
    fields) count once and are left to near-duplicate detection.
    """
    rows = materialize(_parsed(docs, depth, least_tokens).withColumn("own", F.when(F.col("fixed") >= F.col("n") * constant, F.col("leaf")).otherwise(F.col("raw"))).drop("n", "fixed", "leaf", "raw"), "lines")
    nodes = materialize(_support(rows, "node").where(F.col("support") >= least_support), "nodes")
    # a frequent node's lines meet it in SALTS parts, so no task gets them all
    shared = materialize(_dealt(rows).join(_in_parts(nodes.select("node")), ["node", "salt"], "left_semi").drop("salt"), "shared_lines")
    marked = shared.groupBy("key").agg(F.collect_set("line").alias("marked"), F.max("body").alias("body"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").select(_key().alias("key"), F.col("text"))
    words = (
        texts.join(marked, "key")
        .select("key", "body", F.split("text", "\n").alias("lines"), "marked")
        .select("key", "body", F.explode(F.transform("marked", lambda i: F.struct(i.alias("line"), F.get("lines", i).alias("text")))).alias("m"))
        .select("key", "body", "m.line", tokens(F.col("m.text")).alias("t"))
        .select("key", "body", "line", F.xxhash64(F.size("t"), F.slice("t", 1, depth)).alias("node"), F.posexplode("t").alias("pos", "token"))
        .select("key", "body", "line", "node", F.xxhash64("pos", "token").alias("word"), (F.col("token") == WILD).alias("wild"))
        .distinct()
    )
    words = materialize(words, "line_words")
    having = words.where("not wild").groupBy("node", "word", "body").agg(F.lit(1).alias("one")).groupBy("node", "word").agg(F.count("*").alias("c")).where(F.col("c") >= least_support)
    common = having.join(nodes, "node").select("node", "word", sum(F.when(F.col("c") >= F.col("support") * share, 1).otherwise(0) for share in SHARES).alias("level"))
    levels = range(1, len(SHARES) + 1)
    shaped = (
        words.join(common, ["node", "word"], "left")
        .groupBy("key", "line", "node")
        .agg(F.count("*").alias("n"), *[F.count(F.when(F.col("level") >= k, 1)).alias(f"n{k}") for k in levels], *[F.bit_xor(F.when(F.col("level") >= k, F.col("word"))).alias(f"shape{k}") for k in levels])
        .select("key", "line", F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"n{k}") >= F.col("n") * constant, F.xxhash64("node", f"shape{k}")) for k in levels]))).alias("templates"))
    )
    templated = shared.select("key", "line", "own", "body").distinct().join(shaped, ["key", "line"])
    templated = templated.select("key", "line", "body", F.explode(F.when(F.size("templates") > 0, F.col("templates")).otherwise(F.array("own"))).alias("template"))
    templated = materialize(templated, "templates")
    often = _in_parts(_support(templated, "template").where(F.col("support") >= least_support).select("template"))
    return _dealt(templated).join(often, ["template", "salt"], "left_semi").groupBy("key").agg(F.sort_array(F.collect_set("line")).alias("drop"))


def _without(lines: Column, drop: Column) -> Column:
    """The lines but those of the ascending numbers in drop: what lies between two of them is one slice, so a long text costs no
    more than its lines."""
    first = lambda k: F.when(k == 0, 1).otherwise(F.get(drop, k - 1) + 2)
    last = lambda k: F.when(k == F.size(drop), F.size(lines)).otherwise(F.get(drop, k))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop)), lambda k: F.slice(lines, first(k), last(k) - first(k) + 1)))


def drop_recurring_lines(docs: DataFrame, **rules) -> DataFrame:
    """documents with text, n_lines and n_dropped: all lines of recurring templates dropped.

    Null texts stay null with no lines; an empty text is one line. Lines of fewer tokens than
    ``least_tokens`` always stay. Repeated rows get equal results and count once. A template in exactly
    ``least_support`` documents recurs (ties). Texts of any length are parsed whole. An empty table gives no rows.
    Other columns pass through, whatever their names (n_lines and n_dropped replace columns of these names).
    """
    gone = recurring_lines(docs, **rules).select(F.col("key").alias(KEY), F.col("drop").alias(DROP))
    text = F.col("text").cast("string")
    lines = F.split(text, "\n")
    joined = docs.withColumn("text", text).withColumn(KEY, _key()).join(gone, KEY, "left")
    kept = F.when(F.col(DROP).isNull(), F.col("text")).otherwise(F.array_join(_without(lines, F.col(DROP)), "\n"))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        kept.alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(DROP), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """documents (same columns) without recurring lines; those that consisted of nothing else go.

    Null and empty texts stay as they are. n_chars, where it is a column, is counted anew for changed texts. Nulls, ties,
    repeated rows, long texts, empty tables and other columns as in drop_recurring_lines.
    """
    out = drop_recurring_lines(docs.drop("n_lines", "n_dropped")).where("n_dropped = 0 or text <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
