"""Nearest codebook entries by float32 screening with error intervals, inside tasks on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Components are held within this, so that squared distances of parts of up to 512 components fit 64 bits.
LIMIT = 1 << 25


def integers(batches, scale: int, parts: int):
    """mapInArrow: vec_id, label, vector -> vec_id, label, components floor(scale * x). Vectors that are null or empty or hold
    null or non-finite components are left out."""
    for batch in batches:
        vectors = batch.column(2)
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is not a number here
        owner = np.repeat(np.arange(len(sizes)), sizes)
        good = sizes > 0
        good[owner[~np.isfinite(x)]] = False
        if (uneven := sizes[good] % parts).any():
            raise ValueError(f"a vector's length is no multiple of {parts} ({int(uneven.max())} components too many)")
        keep = good[owner]
        y = np.clip(np.floor(x[keep] * scale), -LIMIT, LIMIT).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
        mask = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.ListArray.from_arrays(pa.array(offsets), pa.array(y))], names=["vec_id", "label", "x"])


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of int64 x the least index among its nearest int64 entries, and the squared distance.

    A float32 matrix product screens: |c|^2 - 2 x.c, which differs from the squared distance by |x|^2 alone, is known to within
    the bound of rounded sums in any order, (m + 4) u / (1 - (m + 4) u) times |c|^2 + 2 |x| |c| with u = 2^-24. The bound holds
    conversions to float32 too; nothing over- or underflows, as items are integers of at most LIMIT. Every entry whose interval
    reaches the least upper end is measured again in int64.
    """
    n, m = x.shape
    c32, x32 = entries.astype(np.float32), x.astype(np.float32)
    c_norm = (c32 * c32).sum(axis=1)
    value = c_norm - np.float32(2) * (x32 @ c32.T)
    ku = (m + 4) * 2.0**-24
    cn = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 2.0**-40)
    xn = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 2.0**-40)
    slack = ku / (1 - ku) * (1 + 2.0**-20) * (cn * cn + 2 * xn[:, None] * cn)
    value = value.astype(np.float64)
    near = value - slack <= (value + slack).min(axis=1, keepdims=True)
    row, col = np.nonzero(near)  # by row, then index
    distance = ((x[row] - entries[col]) ** 2).sum(axis=1)
    starts = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(distance, starts) if n else distance
    hit = np.flatnonzero(distance == least[row])
    first = hit[np.searchsorted(row[hit], np.arange(n))]
    return col[first], least


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, one column a part. books: parts, entries, components."""
    cut = x.reshape(len(x), len(books), -1)
    both = [nearest(cut[:, j], book) for j, book in enumerate(books)]
    return np.stack([c for c, _ in both], axis=1), np.stack([d for _, d in both], axis=1)


def _rows(batch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def summer(books):
    """mapInArrow: a task's sums and counts for each part and entry, in one row an entry that has members."""

    def run(batches):
        b = books.value
        total, count = np.zeros(b.shape, np.int64), np.zeros(b.shape[:2], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch)
            codes, _ = assigned(x, b)
            cut = x.reshape(len(x), len(b), -1)
            for j in range(len(b)):
                np.add.at(total[j], codes[:, j], cut[:, j])
                count[j] += np.bincount(codes[:, j], minlength=b.shape[1])
        j, e = np.nonzero(count)
        d = b.shape[2]
        part, entry, dim = np.repeat(j, d), np.repeat(e, d), np.tile(np.arange(d), len(j))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (part, entry, dim, total[part, entry, dim], count[part, entry])], names=["part", "entry", "dim", "total", "n"])

    return run


def coder(books):
    """mapInArrow: vec_id, label, x -> vec_id, label, code of two hex digits a part, error."""

    def run(batches):
        b = books.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = assigned(_rows(batch), b)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * len(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([text[i : i + step] for i in range(0, len(text), step)], pa.string()), pa.array(errors.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    return run
