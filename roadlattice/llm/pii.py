"""Personal data: base patterns, and identifiers found by bootstrapped contexts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Marks about a match; a text that has these characters gets another one of the private area instead.
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"

#: Java forms of the base patterns. Possessive where what follows can't be part of the run, and no
#: start inside a run that a start at its head has already tried, so that long runs stay linear.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Opaque strings: 16 letters and digits or more, with two groups of digits. Seed entities beside the base kinds.
SECRET = r"(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9]++[A-Za-z]++[0-9])[0-9A-Za-z]{16,}+"
#: A token that may be an identifier: six characters or more, with a digit or an @, or a long run of capitals.
_CORE = "[0-9A-Za-z_+/@.%-]"
TOKEN = rf"(?<!{_CORE})(?={_CORE}*?[0-9@]|[A-Z]{{16}}){_CORE}{{6,}}+"

KINDS = ("email", "ip", "card", "phone")
#: What meets a frequent context or token does so in so many parts.
SALTS = 16
SPAN = "array<struct<start:int,k:int,end:int,kind:string>>"


def parts(text: Column, pattern: str) -> Column:
    """The text split before each match of a pattern; in all parts but the first a mark follows the match."""
    plain = F.when(text.rlike(f"[{_OPEN}{_CLOSE}]"), F.translate(text, _OPEN + _CLOSE, _OTHER * 2)).otherwise(text)
    return F.split(F.regexp_replace(plain, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)


def starts(p: Column, block: int = 128) -> Column:
    """First code points of the matches, by their order. Sums run over blocks of parts and then within each, so what is
    copied stays in proportion to a text's matches."""
    ints = F.array().cast("array<int>")
    size = lambda x: F.length(x) - 1
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 2) / block).cast("int")), lambda b: F.slice(p, b * block + 2, F.lit(block)))
    grown = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + size(y)))
    before = F.aggregate(sums, F.struct(F.length(F.get(p, F.lit(0))).alias("at"), ints.alias("out")), grown, lambda acc: acc["out"])
    within = lambda x, b: F.aggregate(x, F.struct(F.get(before, b).alias("at"), ints.alias("out")), lambda acc, y: grown(acc, size(y)), lambda acc: acc["out"])
    return F.when(F.size(p) < 2, ints).otherwise(F.flatten(F.transform(blocks, within)))


def matches(p: Column, at: Column) -> Column:
    """array<struct<start, value>> of split parts and the matches' starts."""
    return F.transform(at, lambda s, i: F.struct(s.alias("start"), F.substring_index(F.get(p, i + 1), _CLOSE, 1).alias("value")))


def tokens_in_context(p: Column, at: Column) -> Column:
    """array<struct<start, value, left, right>>: matches with up to 60 characters before and 30 behind them, other matches included."""
    plain = lambda i: F.coalesce(F.translate(F.get(p, i), _CLOSE, ""), F.lit(""))
    rest = lambda i: F.substring_index(F.get(p, i), _CLOSE, -1)
    near = lambda i: F.concat(F.when(i > 1, plain(i - 2)).otherwise(F.lit("")), F.when(i > 0, plain(i - 1)).otherwise(F.lit("")), plain(i))
    return F.transform(at, lambda s, i: F.struct(s.alias("start"), F.substring_index(F.get(p, i + 1), _CLOSE, 1).alias("value"), F.right(near(i), F.lit(60)).alias("left"), F.left(F.concat(rest(i + 1), plain(i + 2)), F.lit(30)).alias("right")))


def _spans(found: Column, kind: str, number: int, good=None) -> Column:
    kept = F.filter(found, good) if good else found
    return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("k"), (m["start"] + F.length(m["value"])).alias("end"), F.lit(kind).alias("kind")))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(m["value"], "\\."), lambda p: (F.length(part(p)) <= 3) & (F.concat(F.lit("0"), F.right(part(p), F.lit(3))).cast("int") <= 255))


def _card_ok(m: Column) -> Column:
    d = _digits(m["value"])
    return F.length(d).between(14, 19) & F.call_function("luhn_check", d)


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m["value"])).between(10, 15)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scanned(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    digit = text.rlike("[0-9]")
    sought = {
        "email": (F.contains(text, F.lit("@")), EMAIL),
        "ip": (digit & F.contains(text, F.lit(".")), IP),
        "card": (text.rlike("[0-9][0-9\\x20-]{12}"), CARD),
        "phone": (text.rlike("\\+[0-9]"), PHONE),
        "secret": (digit, SECRET),
        "token": (digit | F.contains(text, F.lit("@")) | text.rlike("[A-Z]{16}"), TOKEN),
    }
    found = docs.select("doc_id", F.coalesce(text.cast("string"), F.lit("")).alias("text")).select("doc_id", *[F.when(test, parts(text, pattern)).otherwise(F.array().cast("array<string>")).alias(k) for k, (test, pattern) in sought.items()])
    placed = found.select("*", *[starts(F.col(k)).alias(f"{k}_at") for k in sought])
    hits = lambda k: matches(F.col(k), F.col(f"{k}_at"))
    spans = placed.select(
        "doc_id",
        _spans(hits("email"), "email", 0).alias("email"),
        _spans(hits("ip"), "ip", 1, _ip_ok).alias("ip"),
        _spans(hits("card"), "card", 2, _card_ok).alias("card"),
        _spans(hits("phone"), "phone", 3, _phone_ok).alias("phone"),
        _spans(hits("secret"), "secret", 4).alias("secret"),
        tokens_in_context(F.col("token"), F.col("token_at")).alias("token"),
    )
    return spans.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.array_sort(F.concat(*KINDS)).alias("base"), "secret", "token")


def _candidates(scanned: DataFrame, cell: int = 64) -> DataFrame:
    """One row for each context of a candidate token: its core, place, context and the kind of seed that it overlaps (found by an
    equi-join on cells of the text). Contexts: the one, two or three pieces before it (a piece is a run of letters or of signs),
    what is before and behind it, what is before it with its shape, and its head with its length."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor((b - 1) / cell))).alias("cell")
    core = F.regexp_extract("m.value", "[0-9A-Za-z](?:.*[0-9A-Za-z])?", 0)
    rows = scanned.select("row", F.explode("token").alias("m")).select("row", core.alias("value"), "m.left", "m.right", (F.col("m.start") + F.instr("m.value", core) - 1).alias("start"))
    rows = rows.where(F.length("value") >= 6).withColumn("end", F.col("start") + F.length("value"))
    rows = rows.select("*", cells(F.col("start"), F.col("end")))
    seeds = scanned.select("row", F.explode(F.concat("base", "secret")).alias("s")).select(F.col("row").alias("s_row"), F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), "s.kind", cells(F.col("s.start"), F.col("s.end")).alias("s_cell"))
    met = rows.join(seeds, (F.col("row") == F.col("s_row")) & (F.col("cell") == F.col("s_cell")) & (F.col("s_start") < F.col("end")) & (F.col("start") < F.col("s_end")), "left")
    marked = met.groupBy("row", "start", "end", "value", "left", "right").agg(F.min("kind").alias("seed"))
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "\\s+", " "), "[0-9]+", "9")
    piece = "(?:[\\p{L}]+|[^\\p{L} ]+) ?"
    before = lambda k: F.regexp_extract("l", f"(?:{piece}){{{k}}}$", 0)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    near = marked.select("row", "start", "end", "value", "seed", tidy(F.col("left")).alias("l"), tidy(F.col("right")).alias("r"))
    near = near.select("row", "start", "end", "value", "seed", *[before(k).alias(f"l{k}") for k in (1, 2, 3)], F.regexp_extract("r", "^ ?(?:[\\p{L}]+|[^\\p{L} ]+)", 0).alias("r1"), shape.alias("shape"))
    named = lambda name, *cols: F.when(F.forall(F.array(*cols), lambda c: c != ""), F.concat_ws("\x1f", F.lit(name), *cols))
    head = F.when(F.length("value") >= 12, F.concat_ws("\x1f", F.lit("head"), F.substring("value", 1, 4), F.length("value").cast("string")))
    contexts = F.array(named("1", F.col("l1")), named("2", F.col("l2")), named("3", F.col("l3")), named("both", F.col("l1"), F.col("r1")), named("shape", F.col("l1"), F.col("shape")), head)
    return near.select("row", "start", "end", "value", "seed", F.explode(F.array_distinct(F.array_compact(contexts))).alias("context"))


def _in_parts(df: DataFrame) -> DataFrame:
    """Each row once for every salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def discovered(candidates: DataFrame, *, least_seeds: int, least_precision: float, rounds: int | None = None) -> DataFrame:
    """(value): tokens that high-confidence contexts point to, by turns of two scores on the graph of
    contexts and tokens, until a turn accepts nothing new. A context is trusted if it has least_seeds known tokens and they
    make up least_precision of all its tokens; a token is accepted if the noisy-or of its trusted contexts'
    precisions, each held below 0.99, reaches least_precision. Graph rows meet the contexts in parts by their token."""
    salt = F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int").alias("salt")
    graph = materialize(candidates.groupBy("context", "value").agg(F.max(F.col("seed").isNotNull()).alias("seed")).select("*", salt), "contexts")
    accepted = materialize(graph.where("seed").select("value").distinct(), "accepted")
    turn = 0
    while rounds is None or turn < rounds:
        marked = graph.join(accepted.withColumn("known", F.lit(1)), "value", "left")
        trusted = marked.groupBy("context").agg(F.count("known").alias("k"), F.count("*").alias("n")).where((F.col("k") >= least_seeds) & (F.col("k") >= F.col("n") * least_precision))
        trusted = _in_parts(trusted.select("context", F.least(F.lit(0.99), F.col("k") / F.col("n")).alias("p")))
        scores = graph.join(trusted, ["context", "salt"]).groupBy("value").agg(F.sum(F.log1p(-F.col("p"))).alias("miss"))
        new = materialize(scores.where(1 - F.exp("miss") >= least_precision).select("value").join(accepted, "value", "left_anti"), "accepted")
        if new.isEmpty():
            break
        accepted, turn = accepted.union(new), turn + 1
    return accepted


def personal_data(docs: DataFrame, *, least_seeds: int = 5, least_precision: float = 0.8, rounds: int | None = None) -> DataFrame:
    """documents -> doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_id, n_spans, base_sha256, spans.

    Base spans are the four patterns, per kind leftmost and not overlapping. Opaque strings are spans of kind ``secret`` and,
    with the base spans, the seeds. Tokens that may be identifiers are looked at with what stands before and behind them;
    contexts and tokens form a graph that is scored until nothing new is found (see discovered). Accepted tokens outside all
    seeds are spans of kind ``id``. spans has all, by start, then kind as listed (email, ip, card, phone, secret, id);
    base spans stay.

    Null texts are empty: zero counts, no spans, the digest of an empty string. Texts of any length are read whole; work is in
    proportion to their matches. A context or token with exactly the least score is taken (ties). Repeated rows each get
    their row and count once in the scores. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    scanned = materialize(_scanned(docs).withColumn("row", F.monotonically_increasing_id()), "scanned")
    candidates = materialize(_candidates(scanned), "candidates")
    values = discovered(candidates, least_seeds=least_seeds, least_precision=least_precision, rounds=rounds)
    left = candidates.where("seed is null").select("row", "start", "end", "value", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")).distinct()
    by_row = left.join(_in_parts(values), ["value", "salt"], "left_semi").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(5).alias("k"), "end", F.lit("id").alias("kind")))).alias("new"))
    joined = scanned.drop("token").join(by_row, "row", "left").withColumn("new", F.coalesce("new", F.array().cast(SPAN)))
    every = F.array_sort(F.concat("base", "secret", "new"))
    counts = [F.size(c).cast("long").alias(n) for c, n in (("secret", "n_secret"), ("new", "n_id"))]
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], *counts, F.size(F.concat("base", "secret", "new")).cast("long").alias("n_spans"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))
