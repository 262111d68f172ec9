"""The corpus operators against plain versions, on small awkward tables."""

import collections
import hashlib
import itertools
import math
import pickle
import random
import re
import time
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadlattice.llm import html_kernel, langid, packing_kernel, toxicity_kernel, warc_kernel
from roadlattice.llm.common import held_out
from roadlattice.llm.components import connected_components
from roadlattice.llm.decontaminate import contamination, decontaminate
from roadlattice.llm.html_text import fit, main_texts
from roadlattice.llm.langid import languages
from roadlattice.llm.line_dedup import dedup_lines, drop_recurring_lines
from roadlattice.llm.near_dedup import deduplicate, near_duplicates
from roadlattice.llm.packing import pack
from roadlattice.llm.pii import discovered, personal_data
from roadlattice.llm.quality import quality
from roadlattice.llm.toxicity import keep_civil, toxicity
from roadlattice.llm.warc import read_archives, write_archives

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang if isinstance(lang, str) or lang is None else lang[i], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "be", "co", "du", "er", "fi"]) for _ in range(r.randint(1, 4))) for _ in range(n))


AWKWARD = [None, "", " \n\t ", "word", "four words are here", "A" * 5000, "x " * 3000, "naïve café straße Σίσυφος", "same line\n" * 9, "12 34", "...!?", "é combining"]


# near-duplicates


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return sets, label


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), k):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def test_near_duplicates(spark):
    base = prose(1, 120)
    texts = [*AWKWARD, *AWKWARD[3:6], base, *[edited(base, k, s) for s, k in enumerate((0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 3, 3, 2, 2))], *[prose(s, 60) for s in range(50, 60)], base.upper()]
    sets, label = brute_components(texts)
    got = {r.doc_id: r for r in near_duplicates(docs(spark, texts)).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, label))]
    assert deduplicate(docs(spark, texts)).count() == len(set(label))


def test_near_duplicates_small_blocks(spark):
    base = prose(2, 80)
    texts = [edited(base, 3 + s % 6, s) for s in range(40)]
    _, label = brute_components(texts)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, texts), block=2, target_block=5).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_near_duplicates_empty_null_ids_and_repeats(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "a b c d e f", 3)], "doc_id long, text string, kept int")
    got = sorted(((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(odd).collect()), key=str)
    assert got == [(-1, None, True), (5, 5, True), (5, 5, True)]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    label = {}
    for a, b in edges:
        x, y = label.get(a, a), label.get(b, b)
        label.update({a: x, b: y})
        label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = {r.id: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    full = {k: got.get(k, k) for k in label}
    groups = lambda d: {frozenset(k for k in d if d[k] == v) for v in d.values()}
    assert groups(full) == groups(label) and all(v == min(k for k in full if full[k] == v) for v in full.values())


# decontamination


def brute_contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    hit, found = set(), set()
    for item, t in items:
        p = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        m = min(13, len(p))
        for k in range(len(p) - m + 1 if p else 0):
            for i in range(len(words) - m + 1):
                if words[i : i + m] == p[k : k + m]:
                    hit |= set(range(i, i + m))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_contamination(spark, block_chars):
    items = [(1, prose(11, 30)), (2, prose(12, 13)), (10, "One, two: THREE"), (3, "solo"), (4, None), (5, "--"), (6, prose(11, 30)), (7, "a a a")]
    texts = [*AWKWARD, prose(11, 30), "x " * 400 + prose(12, 13), "y " + " ".join(prose(11, 30).split()[4:18]) + " z", "one-two three solo", "a a a a a b a a", prose(12, 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contamination(docs(spark, texts), bench, block_chars=block_chars).collect()}
    want = [brute_contamination(t, items) for t in texts]
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for _, r in sorted(got.items())] == want
    kept = {r.doc_id for r in decontaminate(docs(spark, texts), bench, block_chars=block_chars).collect()}
    assert kept == {i for i, w in enumerate(want) if not w[4]}


@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_contamination_by_row(spark, block_chars):
    items = [(i, prose(20 + i, 15)) for i in range(4)]
    bad, clean = [t for _, t in items], [prose(30 + i, 20) for i in range(3)]
    rows = [(None, bad[0]), (None, clean[0]), (7, bad[1]), (7, clean[1]), (7, bad[2] + " and " + bad[3]), (8, clean[2])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r[0] or -1, *r[1:])
    got = sorted(((r.doc_id, *(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))) for r in contamination(d, bench, block_chars=block_chars).collect()), key=key)
    assert got == sorted(((i, *brute_contamination(t, items)) for i, t in rows), key=key)
    kept = sorted(((r.doc_id, r.text) for r in decontaminate(d, bench, block_chars=block_chars).collect()), key=key)
    assert kept == sorted(((i, t) for i, t in rows if t in clean), key=key)


# packing


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_packing_round_trip(spark, name):
    path = public_tokenizers.path(name)
    texts = [*AWKWARD, "don't stop. he'll go... (yes). a.b, c,d 5.5 x). Y! <|endoftext|> end", "İstanbul. ΣΟΦΟΣ. ǅ ß", *[prose(s, 700).replace(" er ", " er. ") for s in range(6)], prose(99, 9000)]
    tok = Tokenizer.from_file(path)
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    rows = pack(docs(spark, texts).repartition(2, "doc_id"), path).collect()
    for i, own in enumerate(ids):
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            piece = b"".join(x.to_bytes(4, "little") for x in own[r.start : r.start + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(piece))
            at += r.length
        assert at == len(own)
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    lengths = []
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        lengths.append(at)
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert max(lengths) <= 2048 and padding < 0.1 * sum(lengths)
    assert pack(docs(spark, []), path).count() == 0


def test_cuts_are_best():
    r = random.Random(5)
    for _ in range(30):
        bounds = sorted({0, *(r.randrange(1, 60) for _ in range(12))})
        while max(b - a for a, b in zip(bounds, bounds[1:])) > 16:
            bounds = sorted({*bounds, *(a + 16 for a, b in zip(bounds, bounds[1:]) if b - a > 16)})
        kinds = [r.randrange(3) for _ in bounds]
        pen = (0, 2, 5)
        price = lambda cuts: sum((0 if (n := b - a) & (n - 1) == 0 else 16 - n) + pen[kinds[bounds.index(b)]] for a, b in zip(cuts, cuts[1:]))  # noqa: E731, B023
        best = {0: 0}
        for b in bounds[1:]:
            best[b] = min(best[a] + price([a, b]) for a in bounds if a < b and b - a <= 16)
        assert price(packing_kernel.choose_cuts(bounds, kinds, 16, pen)) == best[bounds[-1]]


# toxicity and language


def test_toxicity_learns_and_locates(spark):
    texts = [f"{prose(i, 20)}. {'you wretch ' if i % 4 == 0 else ''}{prose(i + 500, 15)}. {prose(i + 900, 9)}." for i in range(240)] + AWKWARD
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)] + [(10**6, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(d, d, labels).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(240))
    assert all(got[i].offending == ([1] if i % 4 == 0 else []) for i in range(240))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[240].score == 0.0
    assert got[7].held_out == (zlib.crc32(b"7") % 5 == 0)
    none = toxicity(d, d, labels.where("false")).collect()
    assert len(none) == len(texts) and not any(r.predicted for r in none)


def test_languages(spark):
    say = {"en": "the with that thing", "de": "und der nicht schön", "fr": "une élève avec été"}
    r = random.Random(4)
    langs = [random.Random(i).choice(list(say)) for i in range(150)]
    texts = [" ".join(r.choice(say[x].split()) for _ in range(30)) for x in langs]
    d = docs(spark, texts + AWKWARD, lang=[*langs, *[None] * len(AWKWARD)])
    got = {x.doc_id: x for x in languages(d).collect()}
    assert all(got[i].lang_pred == langs[i] for i in range(150))
    assert [got[150 + i].lang_pred for i, t in enumerate(AWKWARD) if not re.search(r"[^\W\d_]", t or "")] == ["und"] * 5
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in languages(d.where("lang is null")).collect()} == {"und"}
    assert languages(docs(spark, [])).count() == 0


def test_toxicity_is_the_noisy_or(spark):
    """Scores against a plain noisy-or under the fitted weights, and the fit against a plain gradient."""
    texts = [f"{prose(i, 9)}. {'you wretch ' if i % 3 == 0 else ''}{prose(i + 50, 7)}! {prose(i + 90, 5)}" for i in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]
    bias, weights = toxicity_kernel.train(texts, labels, steps=60)
    sig = lambda z: 1 / (1 + math.exp(-z))

    def plain(text, bias, weights):
        p = [sig(bias + sum(weights.get(w, 0.0) for w in set(re.findall(r"[a-z]+", s)))) for s in re.split(r"[.!?\n]+", text.lower()) if re.search("[a-z]", s)]
        return 1 - math.prod(1 - x for x in p)

    assert all(toxicity_kernel.score_text(t, bias, weights)[0] == pytest.approx(plain(t, bias, weights)) for t in texts)
    # one step moves each weight against the sign of the numeric slope of the loss
    docs_words = [{w for w in re.findall(r"[a-z]+", t.lower())} for t in texts]
    _, first = toxicity_kernel.train(texts, labels, steps=1)

    def loss(ws):
        total = 0.0
        for t, y in zip(texts, labels):
            s = plain(t, -5.0, ws)
            total -= math.log(s if y else 1 - s) * 0.5 / labels.count(y)
        return total

    for w in ["wretch", *sorted(first)[:5]]:
        assert sum(w in d for d in docs_words) >= 6
        slope = (loss({w: 1e-4}) - loss({w: -1e-4})) / 2e-4
        assert first[w] * slope < 0


def test_toxicity_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, 1, "a"), (None, "", 2, "b"), (4, "you wretch. " * 2000, 3, "c"), (4, "you wretch. " * 2000, 3, "c")], "doc_id long, text string, score int, predicted string")
    labels = spark.createDataFrame([(4, 1), (None, 0)], "doc_id long, toxic int")
    got = sorted((r.doc_id or -1, r.held_out, r.n_sentences) for r in toxicity(odd, odd, labels).collect())
    assert got == [(-1, False, 0), (-1, False, 0), (4, zlib.crc32(b"4") % 5 == 0, 2000), (4, zlib.crc32(b"4") % 5 == 0, 2000)]
    assert toxicity(odd.where("false"), odd, labels).count() == 0 and keep_civil(odd, labels).columns == odd.columns


def test_languages_are_the_nearest_centroids(spark):
    """Document frequencies and predictions against plain loops."""
    texts = [prose(i, 25) if i % 2 else prose(i, 25).replace("a", "o").replace("e", "u") for i in range(60)] + ["Ünïcode été 12"]
    rows = [(i, t, "xy"[i % 2]) for i, t in enumerate(texts)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    idf, langs, of, cents, _ = langid.fit(train, dims=512, clusters=2)

    def counts(text):
        data = (" " + re.sub(r"[\W\d_]+", " ", text.lower()) + " ").encode()
        out = collections.Counter()
        for n in range(1, 5):
            for i in range(len(data) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 263 + data[i + k] + 1) % 2**32
                out[((h * 2654435761 + n * 40503) % 2**32 >> 12) % 512] += 1
        return out

    df = collections.Counter(d for t in texts for d in counts(t))
    assert all(float(idf[d]) == pytest.approx(math.log((1 + len(texts)) / (1 + df[d])) + 0.05, abs=1e-5) for d in range(512))
    assert langs == ["x", "y"] and len(cents) == 4 and sorted(of) == [0, 0, 1, 1]
    got = {r.doc_id: r.lang_pred for r in languages(train, dims=512, clusters=2).collect()}
    idf, langs, of, cents, _ = langid.fit(train.where(~held_out()), dims=512, clusters=2)
    for i, t in enumerate(texts):
        v = {d: math.log1p(c) * float(idf[d]) for d, c in counts(t).items()}
        best = max(range(len(cents)), key=lambda k: sum(x * float(cents[k][d]) for d, x in v.items()))
        assert got[i] == langs[of[best]]


def test_decontaminate_keeps_columns_of_any_name(spark):
    words = " ".join(f"w{i}" for i in range(13))
    rows = spark.createDataFrame([(1, words, 77, 1, "s", "x"), (2, "clean words", 88, 2, "s", "y"), (None, None, None, None, None, None)], "doc_id long, text string, __row long, ROW long, spans string, row_ string")
    bench = spark.createDataFrame([(f"b{i}", words if i == 3 else f"other item {i} of the list") for i in range(6)], "item_id string, text string")
    for block_chars in (20_000_000, 40):
        got = decontaminate(rows, bench, block_chars=block_chars)
        assert got.columns == rows.columns and {tuple(r) for r in got.collect()} == {(2, "clean words", 88, 2, "s", "y"), (None,) * 6}


def test_language_sample_is_bounded_and_counts_repeats_once(spark):
    rows = [(i, f"text {i}", "en") for i in range(300)] + [(7, "copy", "fr")] * 200 + [(i, "zz", f"l{i}") for i in range(3)]
    got = collections.Counter(r.lang for r in langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 20, 3).dropDuplicates(["lang", "key"]).collect())
    assert got["en"] == 20 and got["fr"] == 1 and sum(got.values()) == 22


# web pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="page">
<header><a href="/">Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies. Accept all of them now, please, thank you.</div>
<main><article><h1>A  title &amp; more</h1><p>First <b>bold</b>
 paragraph, with words &lt;here&gt; that go on.<p>Second one<br>after a break. It is long enough to be read as text.</p><div class="ad">Buy now! Cheap things for you, today only.</div><ul><li>Item one of the list.</li></ul></article>
<aside>Related: <a href=x>other</a></aside><section id="comments"><p>I am a reader and I disagree with all of this, sadly.</p></section></main>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2024 Example. All rights reserved.</footer></body></html>"""


def test_main_text(spark):
    want = "A title & more\n\nFirst bold paragraph, with words <here> that go on.\n\nSecond one after a break. It is long enough to be read as text.\n\nItem one of the list."
    assert html_kernel.main_text(PAGE) == want
    assert html_kernel.main_text(None) == html_kernel.main_text("<nav>only a menu</nav>") == ""
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (2, None, "", 0)], "page_id long, url string, html string, text int")
    got = main_texts(pages).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in got] == [(want, len(want)), ("", 0), ("", 0)]


def test_main_text_of_open_head_and_options():
    say = "This is the first paragraph of the page, and it is long enough to be read as text."
    body = f"<p>{say}</p><p>{say}</p>"
    want = f"{say}\n\n{say}"
    assert html_kernel.main_text(f"<html><head><title>t</title><meta charset=utf-8><body>{body}</body></html>") == want
    assert html_kernel.main_text(f"<head><script>x</script>{body}") == want
    assert html_kernel.main_text(f"<body><datalist id=d><option>One<option value='2'>Two <b>x</b></datalist>{body}") == want
    assert html_kernel.main_text(f"<body><datalist><option>One{body}") == want


def test_main_text_of_good_and_bad_names():
    say = "This is the first paragraph of the page, and it is long enough to be read as text."
    for names in ("content with-sidebar", "post tag-news"):
        assert html_kernel.main_text(f"<body><div class='{names}'><p>{say}</p><p>{say}</p></div></body>") == f"{say}\n\n{say}"
    assert html_kernel.main_text(f"<body><div class='entry-meta'>{say}</div></body>") == ""


def test_names_about_a_whole_article_do_not_lose_it(spark):
    """Each name below rejects its element beside an article and keeps it where nothing else is one."""
    say = "The council met on Tuesday to settle the plan for the new bridge, which had been delayed twice already. Work could begin in spring."
    article, menu, foot = f"<h1>A bridge at last</h1><p>{say}</p><p>{say}</p>", "<nav><a href=x>Home</a> <a href=y>About</a></nav>", "<footer>Example 2024. All rights reserved.</footer>"
    want = f"A bridge at last\n\n{say}\n\n{say}"
    wrappers = [f"<div class='{c}'>%s</div>" for c in ("popular-science", "overflow-hidden", "search-results", "top", "links")]
    wrappers += ["<form id='aspnetForm'>%s</form>", "<noscript>%s</noscript>", "<form><div class='overflow-hidden'>%s</div></form>", "<fieldset>%s</fieldset>"]
    pages = [f"<html><body>{menu}{w % article}{foot}</body></html>" for w in wrappers] + [f"<html><body>{menu}<article><p>{say}</p></article>{w % article}{foot}</body></html>" for w in wrappers]
    cards = f"<h1>A bridge at last</h1><div class='popular card'><p>{say}</p></div><div class='popular card'><p>{say}</p></div>"
    pages += [f"<body>{menu}<form>{menu}<div class='social'><a href=z>Share it</a></div>{article}</form>{foot}", f"<body>{menu}{cards}{foot}", f"<body>{menu}<nav>{article}</nav>{foot}"]
    got = [r.text for r in main_texts(spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id long, url string, html string")).orderBy("page_id").collect()]
    n = len(wrappers)
    assert got[:n] == [want] * n and got[n : 2 * n] == [say] * n
    assert got[2 * n] == want and got[2 * n + 1].endswith(f"{say}\n\n{say}") and got[2 * n + 2] == ""


def test_fit_of_main_texts_is_bounded_and_does_not_depend_on_order(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>One sentence, number {k}, of the article.</p></article><nav>menu {k}</nav>") for k in range(6)] + [(2, "u", "<p>a" * 50_000)], "page_id long, url string, html string")
    one, two = fit(pages.repartition(3)), fit(pages.orderBy(F.desc("html")).coalesce(1))
    assert (one == two).all() and (one != html_kernel.PRIOR).any()
    (batch,) = html_kernel.sampler(10)([pa.RecordBatch.from_pydict({"key": [1, 2], "html": ["<p>a" * 10, "<p>a" * 11]})])
    assert [len(pickle.loads(x.as_py())) for x in batch.column(1)] == [10, 0]


def test_minimum_cut_is_minimal():
    r = random.Random(6)
    for k in range(80):
        n = r.randint(1, 9)
        w = [r.uniform(-2, 2) for _ in range(n)]
        links = [(i, j, r.choice([0.2, 0.6, 1.0])) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5] if k % 2 else html_kernel.edges([(r.randrange(3), r.randrange(2)) for _ in range(n)])
        price = lambda side: sum(max(-x, 0) if s else max(x, 0) for x, s in zip(w, side)) + sum(c for i, j, c in links if side[i] != side[j])  # noqa: E731, B023
        least = min(price(s) for s in itertools.product([False, True], repeat=n))
        assert price(html_kernel.minimum_cut(w, links)) == pytest.approx(least)
        assert price(html_kernel.max_flow(w, links)) == pytest.approx(least)


def test_minimum_cut_of_a_long_page():
    r = random.Random(8)
    for w in ([1.5 if i % 2 else -1.4 for i in range(8000)], [r.uniform(-2, 2) for _ in range(8000)]):
        began = time.process_time()
        html_kernel.minimum_cut(w, html_kernel.edges([(i // 50 * 10 + r.randrange(5), 0) for i in range(8000)]))
        assert time.process_time() - began < 5


def test_main_text_keeps_what_a_page_shows():
    say = "This is the first paragraph of the page, and it is long enough to be read as text."
    keeps = {
        f"<article><div class='post-header'><h1>A title of some words</h1></div><p>{say}</p><p class='alert'>{say}</p></article>": f"A title of some words\n\n{say}\n\n{say}",
        f"<article><p>{say} <math><mi>x</mi></math> and more.</p><object>{say}</object><video>{say}</video></article>": f"{say} x and more.\n\n{say}{say}",
        f"<article><p>{say}<svg><text>no</text></svg></p><noscript>no</noscript><select><option>no</select><p>{say}<svg>": f"{say}\n\n{say}",
    }
    for page, want in keeps.items():
        assert html_kernel.main_text(page) == want


def generated_page(r, k):
    """A page and its article's text."""
    say = lambda n: prose(r.randrange(10**9), n).capitalize() + "."
    link = lambda: f"<a href=/x>{prose(r.randrange(10**9), 2)}</a>"
    paragraphs = [say(r.randint(8, 60)) for _ in range(r.randint(2, 9))]
    title = say(r.randint(3, 8))
    inside = [f"<h1>{title}</h1>"] + [f"<p>{p[: len(p) // 2]}<b>{p[len(p) // 2 :]}</b></p>" for p in paragraphs]
    inside.insert(r.randint(1, len(inside)), r.choice(["", f"<div class='ad'>{say(9)}</div>", f"<div class='share-buttons'>{link()}</div>", f"<aside><p>{say(20)}</p></aside>"]))
    around = [f"<nav><ul>{''.join(f'<li>{link()}' for _ in range(r.randint(2, 9)))}</ul></nav>", f"<div class='cookie-notice'>{say(12)}</div>", f"<div id='sidebar'><h3>{say(2)}</h3><p>{say(30)}</p></div>"]
    below = [f"<section id='comments'><article class='comment'><p>{say(25)}</p></article></section>", f"<form><label>{say(2)}</label><input></form>", f"<footer>&copy; {say(8)}</footer>", "<script>no()</script>"]
    wrap = r.choice(["<article>{}</article>", "<main><div class='entry-content'>{}</div></main>", "<div class='post'>{}</div>"])
    html = "<html><head><title>t</title>" + r.choice(["", "</head>"]) + "<body>" + "".join(r.sample(around, r.randint(1, 3))) + wrap.format("".join(inside)) + "".join(r.sample(below, r.randint(1, 4))) + "</body></html>"
    return html, "\n\n".join([title, *paragraphs])


def test_main_texts_of_generated_pages(spark):
    r = random.Random(12)
    made = [generated_page(r, k) for k in range(150)]
    pages = spark.createDataFrame([(k, f"u{k}", h, "x") for k, (h, _) in enumerate(made)], "page_id long, url string, html string, text string")
    got = {x.page_id: x.text for x in main_texts(pages).collect()}
    assert [k for k, (_, want) in enumerate(made) if got[k] != want] == []
    assert main_texts(pages.where("false")).count() == 0
    long = "".join(f"<p>{prose(i, 12)}.</p>" for i in range(5000))
    one = main_texts(spark.createDataFrame([(1, "u", f"<article>{long}</article>")], "page_id long, url string, html string")).first()
    assert one.n_chars == len(one.text) == sum(len(prose(i, 12)) + 1 for i in range(5000)) + 2 * 4999


def test_the_cut_on_pages_without_names(spark):
    """The pages of the tables with names taken away: labels with their names are the truth. The cut changes labels, most for the better."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null").orderBy("page_id").collect()]
    weights = html_kernel.fit([html_kernel.blocks(h) for h in pages[:100]])
    right = collections.Counter()
    for html in pages[100:]:
        named = html_kernel.blocks(html)
        truth = {b[0]: side for b, side in zip(named, html_kernel.labelled(named, weights))}
        bare = html_kernel.blocks(re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", html)))
        for b, c, side in zip(bare, html_kernel.costs(bare, weights), html_kernel.labelled(bare, weights)):
            right["sign"] += (c > 0) == truth.get(b[0])
            right["cut"] += side == truth.get(b[0])
            right["changed"] += side != (c > 0)
    assert right["changed"] and right["cut"] > right["sign"]


def test_warc_round_trip(spark, tmp_path):
    big = "ü" * 600
    rows = [(1, "http://a", big), (2, "http://b", big), (9, "x\r\ny", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "a\r\n\r\nb" * 400), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    first = write_archives(pages, f"file://{tmp_path}/one", shard_bytes=2000, roll_bytes=500).orderBy("file").collect()
    again = write_archives(pages.repartition(3), f"file://{tmp_path}/two", shard_bytes=2000, roll_bytes=500).orderBy("file").collect()
    assert first == again and len(first) > 3
    got = {r.page_id: r for r in read_archives(spark, f"file://{tmp_path}/one").collect()}
    for p, _, h in rows:
        data = (h or "").encode()
        copies = p != 9 and h == big
        assert (got[p].payload_bytes, got[p].payload_digest, got[p].record_type, got[p].refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if copies else "response", 9 if copies else None)
    order = [r.file for r in first]
    ids = []
    for f in order:
        with open(tmp_path / "one" / f, "rb") as s:
            ids += [x["page_id"] for d in warc_kernel.members(s, 64) if (x := warc_kernel.parse(d))]
    assert ids == [None, 1, 2, 3, 4, 5, 6, 7, 9]
    empty = f"file://{tmp_path}/none"
    assert write_archives(pages.where("false"), empty).count() == 0 and read_archives(spark, empty).count() == 0


def test_warc_shards_with_an_outlying_id(spark, tmp_path):
    """One far id leaves the others' shards even; bytes don't depend on partitions; other columns don't matter."""
    rows = [(i, f"http://a/{i}", prose(i, 60), "x", 0) for i in [*range(1, 121), 2**40]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, shard string, size int")
    one = write_archives(pages, f"file://{tmp_path}/one", shard_bytes=8000).orderBy("file").collect()
    two = write_archives(pages.repartition(7), f"file://{tmp_path}/two", shard_bytes=8000).orderBy("file").collect()
    assert one == two and len(one) > 5
    assert max(r.records for r in one) <= 2 * min(r.records for r in one[:-1])
    few = write_archives(pages, f"file://{tmp_path}/few", shard_bytes=8000, most_shards=3).collect()
    assert {r.shard for r in few} == {0, 1, 2}
    got = {r.page_id: r for r in read_archives(spark, f"file://{tmp_path}/one").collect()}
    assert all(got[r[0]].payload_digest == hashlib.sha1(r[2].encode()).hexdigest() for r in rows)


def test_warc_of_repeats_and_long_payloads(spark, tmp_path):
    long = prose(3, 200_000)
    rows = [(5, "a", long), (5, "a", long), (4, "b", long), (4, "b", "other" * 300), (None, None, None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_archives(pages, f"file://{tmp_path}/w", shard_bytes=1 << 20)
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in read_archives(spark, f"file://{tmp_path}/w").collect())
    n = len(long)
    assert got == [(-1, 0, "response", None), (-1, 0, "response", None), (4, 1500, "response", None), (4, n, "revisit", 5), (5, n, "response", None), (5, n, "response", None)]


# personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def base_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if ok(m.group())]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(found)]


def test_personal_data(spark):
    texts = [
        *AWKWARD, "mail a@b.c_d@e.f and x@y.z, a.b@c.d.", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 000255.0.0.1", "card 4337166598464399 4111-1111-1111-1111 4111 1111 1111 1112", "call +1 (632) 555-4827. +44 20 7946 0958! +1 2",
        "𝒳 é 10.0.0.1 ü a@b.co", "1 2 3 4 5 6 7 8 9 " * 2000, "9" * 6000, "a@" * 3000, " a@b.co  1.1.1.1", "+1" * 900,
    ]
    got = {r.doc_id: r for r in personal_data(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        kinds = collections.Counter(s.split(":")[0] for s in want)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [kinds[k] for k, *_ in PATTERNS], t[:40]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(","))
    assert personal_data(docs(spark, [])).count() == 0


def test_bootstrapped_identifiers(spark):
    texts = [f"hello my contact: user{i}@mail.org bye" for i in range(12)] + ["hello my contact: ZX-99812-QQ bye", "the price was 129.99.77 today"]
    got = {r.doc_id: r.spans for r in personal_data(docs(spark, texts)).collect()}
    assert got[12] == "id:18:29" and got[13] == ""


def test_identifiers_in_lists_and_unlike_forms(spark):
    """An identifier behind an address, one behind another, and one in a form that no seed has."""
    texts = [f"write to me: user{i}@mail.org ok" for i in range(8)] + ["write to me: QX-77120-ZZ AB-99812-QQ ok"] + [f"sys password = {'abc1' * 4}x{i}9a end" for i in range(8)] + ["sys password = hunter22 end", "only 22.95 dollars"]
    got = [r.spans for r in personal_data(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[8].startswith("id:13:24") and got[17] == "id:15:23" and got[18] == ""


def plain_discovered(pairs, least_seeds, least_precision):
    accepted, by_context, by_value = {v for _, v, s in pairs if s}, collections.defaultdict(set), collections.defaultdict(set)
    for c, v, _ in pairs:
        by_context[c].add(v), by_value[v].add(c)
    while True:
        p = {c: len(vs & accepted) / len(vs) for c, vs in by_context.items() if len(vs & accepted) >= max(least_seeds, least_precision * len(vs))}
        new = {v for v, cs in by_value.items() if 1 - math.prod(1 - min(0.99, p[c]) for c in cs if c in p) >= least_precision} - accepted
        if not new:
            return accepted
        accepted |= new


def test_discovered_is_the_fixpoint(spark):
    for seed in range(3):
        r = random.Random(seed)
        pairs = sorted({(f"c{(v + r.choice([0, 0, 1, 2])) // 3}", f"v{v}", v < 12) for v in range(60) for _ in range(3)})
        pairs += [(f"chain{k}", f"w{v}", v < 6) for k in range(5) for v in range(k * 2, k * 2 + 7)]
        df = spark.createDataFrame([(c, v, "email" if s else None) for c, v, s in pairs], "context string, value string, seed string")
        got = {x.value for x in discovered(df, least_seeds=2, least_precision=0.6).collect()}
        assert got == plain_discovered(pairs, 2, 0.6) and len(got) > 18


def test_personal_data_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, "a", 1), (None, "a@b.co " * 3000, "b", 2), (3, "x", "c", 3), (3, "x", "c", 3)], "doc_id long, text string, row string, n_email int")
    got = sorted((r.doc_id or -1, r.n_email, r.n_spans) for r in personal_data(odd).collect())
    assert got == [(-1, 0, 0), (-1, 3000, 3000), (3, 0, 0), (3, 0, 0)]


# lines and quality


def test_recurring_lines(spark):
    texts = [f"{prose(i, 12)}\nOrder number {i * 37} was shipped on day {i}\n{prose(i + 100, 9)}" for i in range(8)] + [prose(500, 20) + "\n" + prose(501, 20)] * 6 + AWKWARD
    got = {r.doc_id: r for r in drop_recurring_lines(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        left = [x for x in lines if not x.startswith("Order number")]
        assert (got[i].text, got[i].n_lines, got[i].n_dropped) == (None if t is None else "\n".join(left), len(lines), len(lines) - len(left))
    out = dedup_lines(docs(spark, texts))
    assert out.columns == docs(spark, []).columns and out.count() == len(texts)
    assert out.where("doc_id = 0").first().n_chars == len(got[0].text)
    assert drop_recurring_lines(docs(spark, [])).count() == 0


def test_recurring_lines_beside_each_other(spark):
    shared = [prose(600 + i, 20) for i in range(5)]
    texts = ["\n".join([prose(700 + i, 40), *shared]) for i in range(8)] + ["\n".join([prose(800, 30), *(prose(801 + k, 30) for k in range(3))])] * 8
    got = {r.doc_id: r for r in drop_recurring_lines(docs(spark, texts)).collect()}
    assert [(got[i].text, got[i].n_dropped) for i in range(8)] == [(prose(700 + i, 40), 5) for i in range(8)]
    assert all((got[i].text, got[i].n_dropped) == (texts[i], 0) for i in range(8, 16))


@pytest.mark.parametrize("n", [60, 600])
def test_recurring_lines_with_fields_of_words(spark, n):
    r = random.Random(7)
    name = lambda k: "v" + "".join("abcdefghij"[int(c)] for c in str(k))
    texts = [f"{prose(900 + i, 12)}\nThe parcel for our customer {name(r.randrange(40))} was sent from {name(r.randrange(30))} this morning" for i in range(n)]
    assert {r.n_dropped for r in drop_recurring_lines(docs(spark, texts)).collect()} == {1}


def test_recurring_lines_of_wildcards(spark):
    texts = [f"{prose(2000 + i, 12)}\n{i} {i * 7} {i * 3}\nx = {i}\nx = 1 + 1" for i in range(8)]
    assert [r.text for r in drop_recurring_lines(docs(spark, texts)).orderBy("doc_id").collect()] == [x.rpartition("\n")[0] for x in texts]


def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = collections.Counter(wins)
    hit = {i + k for i, x in enumerate(wins) if c[x] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_recurring_lines_of_odd_tables(spark):
    odd = spark.createDataFrame([(i, f"{prose(i, 9)}\nthe same line here", f"k{i}", [i]) for i in range(6)] + [(None, None, "n", [0]), (None, "", "e", [0]), (1, f"{prose(1, 9)}\nthe same line here", "k1", [1]), (9, "\n".join(prose(10_000 + i, 6) for i in range(8000)) + "\nthe same line here", "long", [9])], "doc_id long, text string, key string, drop array<int>")
    got = sorted(((r.doc_id or -1), r.key, r.n_lines, r.n_dropped) for r in drop_recurring_lines(odd).collect())
    assert got == sorted([(i or -1, f"k{i}", 2, 1) for i in range(6)] + [(-1, "n", 0, 0), (-1, "e", 1, 0), (1, "k1", 2, 1), (9, "long", 8001, 1)])
    assert dedup_lines(odd).columns == odd.columns


FENCES = {"word_length": (250, 750, 5, True), "symbols": (500, 800, 2, False), "dup_lines": (500, 990, 1, False), "repeats": (500, 990, 1, False)}


def brute_kept(rows, least_group=30):
    """rows: (lang, source, text) -> verdicts, by the rule as it is stated."""
    base = [brute_base(t) for _, _, t in rows]
    bad = [b[0] < 10 or 100 * b[4] > 20 * b[0] for b in base]
    lines = [max(1, len([x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])) for _, _, t in rows]
    metric = [{"word_length": b[1] * 1000 // max(1, b[0]), "symbols": b[2] * 1000 // max(1, b[0]), "dup_lines": b[3] * 1000 // n, "repeats": b[4] * 1000 // max(1, b[0])} for b, n in zip(base, lines)]
    edge = lambda v: v if v < 64 else (v >> (v.bit_length() - 6)) << (v.bit_length() - 6)

    def quantile(values, p):
        return sorted(map(edge, values))[-(-len(values) * p // 1000) - 1]

    out = []
    for i, (lang, source, _) in enumerate(rows):
        good = [k for k in range(len(rows)) if not bad[k]]
        own = [k for k in good if rows[k][:2] == (lang, source)]
        same = [k for k in good if rows[k][0] == lang]
        pool = own if len(own) >= least_group else same if len(same) >= least_group else good
        keep = not bad[i]
        for m, (x, y, reach, both) in FENCES.items():
            v = [metric[k][m] for k in pool]
            if v:
                hi, lo = quantile(v, y), quantile(v, x)
                keep &= metric[i][m] <= hi + reach * (hi - lo)
                keep &= not both or metric[i][m] >= quantile(v, 1000 - y) - reach * (quantile(v, 1000 - x) - quantile(v, 1000 - y))
        out.append(keep)
    return out


def test_quality_verdicts(spark):
    r = random.Random(3)
    rows = [(r.choice(["en", "en", "de", None]), r.choice(["a", "a", "a", "b", None]), prose(i, r.randint(8, 60)) + r.choice(["", "", "", " # * $", "\nx y z\nx y z", " supercalifragilistic" * 9, " a" * 30])) for i in range(260)]
    rows += [("rare", "a", prose(1, 40)), ("rare", "b", "# " * 12 + prose(2, 12))]
    df = spark.createDataFrame([(i, t, x, y) for i, (x, y, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {q.doc_id: q.kept for q in quality(df).collect()}
    want = brute_kept(rows)
    assert [got[i] for i in range(len(rows))] == want and 0 < sum(want) < len(want)


def test_quality_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, 1, "a"), (5, prose(1, 30), 2, "b"), (5, prose(1, 30), 2, "b"), (6, prose(2, 30000), 3, "c")], "doc_id long, text string, failed int, bin string")
    assert sorted((r.doc_id or -1, r.n_words, r.kept) for r in quality(odd).collect())[:3] == [(-1, 0, False), (5, 30, True), (5, 30, True)]


def test_quality(spark):
    texts = [*AWKWARD, "a b c d e a b c d e f", "p q r s t u v w x y z " * 3, *[prose(i, 80) for i in range(60)], "*** " * 40 + prose(9, 60)]
    got = {r.doc_id: r for r in quality(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        b = brute_base(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0])
    assert all(got[i].kept for i in range(14, 74)) and not got[74].kept and not got[0].kept
    nulls = docs(spark, [prose(1, 40)], lang=None).withColumn("source", F.lit(None).cast("string"))
    assert quality(nulls).count() == 1 and quality(docs(spark, [])).count() == 0
