"""Periodic runs, vector codes and byte-level BPE against plain versions, on small awkward tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_corpus_operators import AWKWARD, docs, prose

from roadlattice.llm import bpe_kernel, codes_kernel, runs_kernel
from roadlattice.llm.byte_bpe import decode, encode, round_trip
from roadlattice.llm.periodic_runs import periodic_runs, run_digests
from roadlattice.llm.vector_codes import vector_codes

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


# periodic runs


def brute_runs(s, least=24, power=3):
    n, best = len(s), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j + q - i >= max(least, power * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in best.items())


def test_runs_of_random_sequences():
    r, found = random.Random(1), 0
    for _ in range(1500):
        least, power, s = r.choice([4, 6, 12, 24]), r.choice([3, 3, 4]), []
        for _ in range(r.randint(1, 12)):
            if r.random() < 0.6:
                p = [r.randint(0, r.choice([1, 2, 5])) for _ in range(r.randint(1, 9))]
                s += (p * 9)[: r.randint(1, 70)]
            elif s and r.random() < 0.5:
                a = r.randrange(len(s))
                s += s[a : a + r.randint(1, 60)] * r.randint(1, 3)
            else:
                s += [r.randint(0, 3) for _ in range(r.randint(1, 20))]
        got = runs_kernel.find_runs(np.array(s[:300]), least, power)
        assert got == brute_runs(s[:300], least, power)
        found += len(got)
    assert found > 500


def test_z_values():
    r = random.Random(2)
    for _ in range(500):
        s = [r.randint(0, 1) for _ in range(r.randint(1, 60))] * r.randint(1, 3)
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert runs_kernel.z_values(np.array(s), len(s)).tolist()[1:] == want[1:]


def plain_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else -1
    if h >= 0 and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark):
    texts = [*AWKWARD, "a b c " * 20, "x " * 200, prose(1, 90) + " " + "p q r s " * 9 + prose(2, 40), *[prose(s, 150) for s in range(40)], "é à " * 14, "x\x1cy " * 30, "k " * 24, "k " * 23]
    table = docs(spark, texts).withColumns({"runs": F.lit(1), "h": F.lit("h"), "collapsed": F.lit(None).cast("string")})
    table = table.union(table.where("doc_id = 13")).union(table.where("doc_id = 12").withColumn("doc_id", F.lit(None).cast("long")))
    got = run_digests(periodic_runs(table, rewrite=runs_kernel.tail_repeats)).collect()
    want = [(i, *plain_runs(i, t)) for i, t in enumerate(texts)]
    want += [want[13], (None, *plain_runs(None, texts[12]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert run_digests(periodic_runs(table.limit(0))).count() == 0


def test_collapsed_text(spark):
    r = periodic_runs(docs(spark, ["start " + "one two three " * 10 + "end"])).first()
    assert (r.collapsed, [tuple(x) for x in r.runs], r.n_words) == ("start one two three end", [(1, 30, 3)], 32)


# vector codes


def test_nearest_with_ties_and_large_numbers():
    r = np.random.default_rng(1)
    for k in range(300):
        m, e, n = int(r.choice([1, 2, 4, 16, 64])), int(r.integers(1, 70)), int(r.integers(1, 50))
        top = int(r.choice([2, 10, 300, 100_000, codes_kernel.LIMIT]))
        c, x = r.integers(-top, top + 1, (e, m)), r.integers(-top, top + 1, (n, m))
        if k % 3 == 0 and e > 2:
            c[e // 2] = c[0]
        if k % 5 == 0:  # nearly equal large entries, which float32 cannot tell apart
            c = np.clip(c[:1] + r.integers(-2, 3, (e, m)), -codes_kernel.LIMIT, codes_kernel.LIMIT)
            x = np.clip(c[r.integers(0, e, n)] + r.integers(-1, 2, (n, m)), -codes_kernel.LIMIT, codes_kernel.LIMIT)
        d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
        index, value = codes_kernel.nearest(x, c)
        assert (index == d.argmin(1)).all() and (value == d.min(1)).all()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0], x[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min((far(v, c), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    total = {}
    for *_, error, label in out:
        total[label] = total.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, total[label], sha) for i, code, error, label in out]


@pytest.mark.parametrize("n", [300, 5])
def test_vector_codes(spark, n):
    r = random.Random(n)
    vector = lambda: [float(np.float32(r.choice([r.gauss(0, 0.2), 0.25, -0.5]))) for _ in range(32)]
    same = vector()
    rows = [(i * 3 % 997, same if i % 3 == 0 else vector(), None if i % 7 == 0 else i % 2) for i in range(n)]
    rows += [(1, None, 1), (2, [], 1), (4, [None] + same[1:], 0), (5, [float("nan")] + same[1:], 0), (7, [float("inf")] + same[1:], 0), rows[0], rows[0]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).withColumns({"x": F.lit(1), "code": F.lit("c"), "hot": F.lit(True)})
    got = [tuple(r) for r in vector_codes(table).drop("label").select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got) == sorted(plain_codes(rows))


def test_vector_codes_of_nothing(spark):
    assert vector_codes(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).count() == 0


# byte-level BPE


def test_byte_bpe_against_tiktoken():
    coder = bpe_kernel.Coder(PATH, PATTERN, 1000)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    r = random.Random(3)
    texts = ["", " ", "  a", "a  b", " a\n\n b \t", "x\x1c y\x85z w", "A" * 3000, "ab" * 700, "日本語テキスト" * 30, "it's 's 'll don't", "é́" * 30, "😀😀 😀", "<|endoftext|> <|x|>", "a  b　　c  d", "࢏ a\U000323b0 1\U00012550"]
    texts += ["".join(r.choice("abcdefghijklmnop") for _ in range(1500)), "".join(chr(r.choice([32, 10, 97, 98, 0x4E00 + r.randrange(5000), 0x1C, 0x85, 39, 115, 48, 46, 0x2028, 0x3000])) for _ in range(2000))]
    texts += ["".join(r.choice(" \n\t.,'aeést1  ") for _ in range(400)) for _ in range(30)]
    ids = coder.encode(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [library.encode_ordinary(t) for t in texts]
    assert coder.decode(ids).to_pylist() == [t.encode() for t in texts]


def test_leftmost_pairs_one_at_a_time():
    """Long words contract equal pairs together where that changes nothing; short ones one after the other."""
    coder = bpe_kernel.Coder(PATH, PATTERN, 0)
    r = random.Random(5)
    words = ["".join(r.choice(["a", "aa", "ab", "ing", "the", "s"]) for _ in range(20)).encode()[:60] for _ in range(200)]
    one = coder.contract(words)
    long, bpe_kernel.LONG = bpe_kernel.LONG, 1
    try:
        assert coder.contract(words) == one
    finally:
        bpe_kernel.LONG = long


def test_unknown_ids_are_an_error():
    coder = bpe_kernel.Coder(PATH, PATTERN, 0)
    with pytest.raises((ValueError, IndexError)):
        coder.decode(pa.array([np.array([5, 50_256], "<u4").tobytes()], pa.binary()))


def test_byte_bpe(spark):
    texts = [*AWKWARD, *[prose(s, 200) for s in range(5)], "same", "same", "x" * 100_000]
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe_kernel.Coder(PATH, PATTERN, 0).ranks, special_tokens={})
    table = docs(spark, texts).withColumns({"ids": F.lit(1), "decoded": F.lit("d")})
    table = table.union(table.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, t or "") for i, t in enumerate(texts)] + [(None, texts[3])]
    want = [(i, len(library.encode_ordinary(t)), sha(np.array(library.encode_ordinary(t), "<u4").tobytes()), sha(t.encode())) for i, t in want]
    got = [tuple(r) for r in round_trip(table, PATH, PATTERN).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    there = encode(table, PATH, PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in decode(there, PATH, PATTERN).collect() if r.doc_id is not None} == {i: t or "" for i, t in enumerate(texts)}
    assert round_trip(table.limit(0), PATH, PATTERN).count() == 0
