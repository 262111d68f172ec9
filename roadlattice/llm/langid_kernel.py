"""Hashed n-gram vectors, centroids and cosine classification."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def counts(text: str, dims: int) -> np.ndarray:
    """Counts of the hashed one- to four-byte n-grams of the lower-case letters, with a space between words."""
    a = np.frombuffer((" " + _OTHER.sub(" ", text.lower()) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    grams, h = [], a + np.uint32(1)
    for n in range(1, 5):
        grams.append(((h * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(12)) & np.uint32(dims - 1))
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(263) + a[n:] + np.uint32(1)
    return np.bincount(np.concatenate(grams).astype(np.int64), minlength=dims)


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(text, len(idf))).astype(np.float32) * idf
    n = np.linalg.norm(v)
    return v / n if n else v


def document_frequencies(dims: int):
    """mapInArrow: text -> (dim, df) sums of the partition; dim -1 has the number of documents."""

    def run(batches):
        df, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                if (text := t.as_py()) and _LETTER.search(text):
                    df += counts(text, dims) > 0
                    n += 1
        if n:
            at = np.nonzero(df)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(df[at], n), pa.int64())], names=["dim", "df"])

    return run


def vectors(idf):
    """mapInArrow: lang, key, text -> lang, key, vector as float32 bytes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([vector(t.as_py(), idf.value).tobytes() for t in batch.column(2)], pa.binary())], names=["lang", "key", "v"])

    return run


def clusterer(k: int):
    """applyInPandas over one language's vectors: its centroids, in an order that does not depend on that of the rows."""

    def run(group):
        import pandas as pd

        rows = sorted(zip(group["key"], group["v"]))
        c, reach = centroids(np.stack([np.frombuffer(bytes(v), np.float32) for _, v in rows]), k)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(c), "cluster": range(len(c)), "c": [x.tobytes() for x in c], "reach": reach.astype(float)})

    return run


def centroids(x: np.ndarray, k: int, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds; with each centroid the least cosine that all but 1 % of its members reach."""
    seeds = [int(np.argmax(x @ x.sum(axis=0)))]
    while len(seeds) < min(k, len(x)):
        far = (x @ x[seeds].T).max(axis=1)
        seeds.append(int(np.argmin(far)))
    c = x[seeds]
    for _ in range(turns):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    sims = x @ c.T
    own = np.argmax(sims, axis=1)
    reach = np.array([np.quantile(sims[own == i, i], 0.01) if (own == i).any() else 1.0 for i in range(len(c))], np.float32)
    return c.astype(np.float32), reach


def classifier(model):
    """mapInArrow: doc_id, text -> doc_id, lang_pred, score, cosine, rejected."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cosine", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        idf, langs, of, cents, reach = model.value
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(langs)))
        for batch in batches:
            n = batch.num_rows
            pred, score, cosine, rejected = ["und"] * n, [0.0] * n, [0.0] * n, [True] * n
            texts = batch.column(1)
            for k in range(0, n, 256):
                rows = [i for i in range(k, min(n, k + 256)) if (t := texts[i].as_py()) and _LETTER.search(t)]
                if not rows or not langs:
                    continue
                sims = np.stack([vector(texts[i].as_py(), idf) for i in rows]) @ cents.T
                best = np.maximum.reduceat(sims[:, order], starts, axis=1)
                top = np.argmax(best, axis=1)
                near = np.argmax(sims, axis=1)
                for j, i in enumerate(rows):
                    first = float(best[j, top[j]])
                    second = float(np.partition(best[j], -2)[-2]) if len(langs) > 1 else 0.0
                    pred[i], cosine[i] = langs[top[j]], first
                    score[i] = float(1 / (1 + np.exp(-20 * (first - second))))
                    rejected[i] = first < 0.5 * float(reach[near[j]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64()), pa.array(rejected, pa.bool_())], schema=schema)

    return run
