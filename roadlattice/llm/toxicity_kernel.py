"""Sentences, their words, and the noisy-or of sentence scores."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

_SENTENCE = re.compile(r"[.!?\n。…]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[list[str]]:
    """Lower-case letter words of each sentence that has any."""
    found = (_WORD.findall(s) for s in _SENTENCE.split(text.lower()))
    return [w for w in found if w]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[str], labels: list[int], *, least_docs: int = 6, steps: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> tuple[float, dict[str, float]]:
    """Bias and word weights of the sentence score, fitted so that the noisy-or of a document's
    sentences predicts its label. Words of fewer than least_docs sample documents carry no weight."""
    docs = [[sorted(set(s)) for s in sentences(t)] for t in texts]
    df: dict[str, int] = {}
    for d in docs:
        for w in {w for s in d for w in s}:
            df[w] = df.get(w, 0) + 1
    vocab = {w: i for i, w in enumerate(sorted(w for w, c in df.items() if c >= least_docs))}
    doc_of, sent_of, word_of, n = [], [], [], 0
    for k, d in enumerate(docs):
        for s in d:
            own = [vocab[w] for w in s if w in vocab]
            sent_of += [n] * len(own)
            word_of += own
            doc_of.append(k)
            n += 1
    y = np.asarray(labels, float)
    if not n or not vocab or y.min() == y.max():
        return (8.0 if len(y) and y.min() == 1 else -8.0), {}
    doc_of, sent_of, word_of = (np.asarray(x, np.int64) for x in (doc_of, sent_of, word_of))
    theta = np.zeros(len(vocab) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(sent_of, theta[word_of], n)
        p = sigmoid(z)
        whole = 1 - np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        slope = np.where(y[doc_of] == 1, -(1 - whole[doc_of]) / np.maximum(whole[doc_of], 1e-9), 1.0) * p * share[doc_of]
        g = np.append(np.bincount(word_of, slope[sent_of], len(vocab)) + ridge * theta[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[-1]), {w: float(theta[i]) for w, i in vocab.items() if abs(theta[i]) > 1e-3}


def score_text(text: str | None, bias: float, weights: dict[str, float]) -> tuple[float, int, int | None, list[int]]:
    """Score, number of sentences, the worst one and those at 0.5 or more."""
    own = sentences(text or "")
    vocab, z, at = weights.keys(), [], []
    for i, s in enumerate(own):
        if known := vocab & s:
            z.append(bias + sum(weights[w] for w in sorted(known)))
            at.append(i)
    p = sigmoid(np.asarray(z, float))
    none = float(np.log1p(-np.minimum(p, 1 - 1e-12)).sum() + np.log1p(-sigmoid(bias)) * (len(own) - len(z)))
    return (min(1.0, max(0.0, -np.expm1(none))) if own else 0.0), len(own), (at[int(np.argmax(p))] if z else None), [a for a, x in zip(at, p) if x >= 0.5]


def scorer(model):
    """mapInArrow: doc_id, text -> doc_id and what score_text gives."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int64()), ("worst", pa.int64()), ("offending", pa.list_(pa.int64()))])

    def run(batches):
        bias, weights = model.value
        for batch in batches:
            rows = [score_text(t.as_py(), bias, weights) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(4))], schema=schema)

    return run


def judge(model):
    """text series -> scores."""

    def run(series):
        import pandas as pd

        bias, weights = model.value
        for texts in series:
            yield pd.Series([score_text(t, bias, weights)[0] for t in texts], dtype=float)

    return run
