"""The pipeline's stages, each on its own input, against plain versions."""

import collections
import re
import zlib

import public_tokenizers
from test_corpus_operators import brute_components, brute_contamination, prose
from tokenizers import Tokenizer

from roadlattice.llm import toxicity_kernel
from roadlattice.llm.toxicity import fit

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def plain_toxicity(spark, docs, sf_dir):
    bias, weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return [r for r in docs.collect() if toxicity_kernel.score_text(r.text, bias, weights)[0] < 0.5]


def plain_line_dedup(rows):
    """(doc_id, text) of what is left: the rule as it is stated, with sets and loops."""
    tokens = lambda x: ["<*>" if re.search(r"[0-9@=/\\\\_#]", t) else t for t in re.split(r"[ \t\r\f\x0b]", x) if t]
    lines = {(r.doc_id, i): (x, tokens(x)) for r in rows if r.text is not None for i, x in enumerate(r.text.split("\n"))}
    body = collections.defaultdict(list)
    for (d, _), (_, t) in lines.items():
        if t:
            body[d].append(" ".join(t))
    body = {d: "\n".join(sorted(x)) for d, x in body.items()}
    lines = {k: v for k, v in lines.items() if len(v[1]) >= 3}
    node = {k: (len(t), *t[:3]) for k, (_, t) in lines.items()}
    support = collections.defaultdict(set)
    for k, n in node.items():
        support[n].add(body[k[0]])
    shared = [k for k in lines if len(support[node[k]]) >= 5]
    having = collections.defaultdict(set)
    for k in shared:
        for p, t in enumerate(lines[k][1]):
            if t != "<*>":
                having[node[k], p, t].add(body[k[0]])
    templates = {}
    for k in shared:
        x, t = lines[k]
        found = set()
        for share in (0.5, 0.1, 0.0):
            shape = tuple((p, w) for p, w in enumerate(t) if w != "<*>" and len(having[node[k], p, w]) >= max(5, len(support[node[k]]) * share))
            if len(shape) >= len(t) * 0.6:
                found.add((node[k], shape))
        templates[k] = found or {" ".join(t) if sum(w != "<*>" for w in t) >= len(t) * 0.6 else ("line", x.strip(" \t\r\f\x0b"))}
    docs_of = collections.defaultdict(set)
    for k, ts in templates.items():
        for t in ts:
            docs_of[t].add(body[k[0]])
    gone = {k for k, ts in templates.items() if any(len(docs_of[t]) >= 5 for t in ts)}
    out = []
    for r in rows:
        if r.text is None:
            out.append((r.doc_id, None))
            continue
        parts = r.text.split("\n")
        text = "\n".join(x for i, x in enumerate(parts) if (r.doc_id, i) not in gone)
        if text or not any((r.doc_id, i) in gone for i in range(len(parts))):
            out.append((r.doc_id, text))
    return out


def check_packing(docs, out):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {d.doc_id for d in docs}
    for d in docs:
        ids, at = tok.encode(d.text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : at]))
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in P.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, SF).collect()
        if name == "toxicity":
            assert sorted(out) == sorted(plain_toxicity(spark, docs, SF)) and len(out) < len(rows)
        if name == "line_dedup":
            assert sorted((r.doc_id, r.text) for r in out) == sorted(plain_line_dedup(rows))
        if name == "near_dedup":
            rows.sort(key=lambda r: r.doc_id)
            _, label = brute_components([r.text for r in rows])
            assert sorted(out) == [r for i, r in enumerate(rows) if label[i] == i] and len(out) < len(rows)
        if name == "decontamination":
            assert sorted(out) == sorted(r for r in rows if not brute_contamination(r.text, items)[4]) and len(out) < len(rows)
        if name == "packing":
            check_packing(rows, out)
        else:
            docs = spark.createDataFrame(out, docs.schema)


def test_stages_of_odd_tables(spark):
    """Nulls, empty and very long texts, repeated rows, further columns, and no rows at all."""
    long = prose(7, 60_000)
    rows = [(None, None, None, 1), (None, "", "en", 2), (3, long, "de", 3), (3, long, "de", 3), (4, prose(9, 40), None, 4), (5, prose(9, 40), None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {None, 3, 4, 5}
        elif name == "near_dedup":
            assert out.columns == docs.columns and sorted(r.row for r in out.collect()) == [1, 2, 3, 3, 4]
        else:
            assert out.columns == docs.columns and sorted(r.row for r in out.collect()) == [1, 2, 3, 3, 4, 5]
        assert stage(spark, docs.where("false"), SF).count() == 0
