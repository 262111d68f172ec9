"""Main-Lorentz search for periodic runs, inside tasks on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def z_values(s: np.ndarray, upto: int) -> np.ndarray:
    """Z-function at positions 0 to upto: how many items from there on equal the beginning. Position 0 is left 0."""
    n, upto = len(s), min(upto, len(s) - 1)
    z, item = [0] * (upto + 1), s.tolist()
    left = right = 0
    for i in (np.flatnonzero(s[1 : upto + 1] == s[0]) + 1).tolist():
        k = 1
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while k & 7 and i + k < n and item[k] == item[i + k]:
            k += 1
        if not k & 7:
            k = _extended(s, i, k)
        z[i] = k
        if i + k > right:
            left, right = i, i + k
            if right == n:
                return _repeated(np.array(z, np.int64), i, n)
    return np.array(z, np.int64)


def _extended(s: np.ndarray, i: int, k: int) -> int:
    """The first place from k on where s and s from i differ, compared in growing blocks."""
    n, step = len(s) - i, 16
    while k < n:
        same = s[k : min(k + step, n)] == s[i + k : i + min(k + step, n)]
        if not same.all():
            return k + int(same.argmin())
        k, step = min(k + step, n), step * 2
    return n


def _repeated(z: np.ndarray, i: int, n: int) -> np.ndarray:
    """The Z-function beyond i, when all from i to the end equals the beginning: what stands i places before, cut at the end."""
    at, shift = i + 1, i
    while at < len(z):
        m = min(shift, len(z) - at)
        z[at : at + m] = np.minimum(z[at - shift : at - shift + m], n - np.arange(at, at + m))
        at, shift = at + m, shift * 2
    return z


def crossing(s: np.ndarray, lo: int, mid: int, hi: int, least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the repetitions in s[lo:hi] that hold a whole period next to mid, as far as they reach in s[lo:hi]."""
    most = (hi - lo) // power
    u, v = s[lo:mid][::-1], s[mid:hi]  # both read away from the midpoint
    gap = np.array([-1], s.dtype)
    left, right = z_values(u, most), z_values(v, most)  # how far a period holds inside each half
    found = []
    for near, far, own, other, sign in ((u, v, left, right, -1), (v, u, right, left, 1)):  # the whole period lies in near
        m = min(most, len(near))
        q = np.arange(1, m + 1)
        inside = np.zeros(m, np.int64)
        inside[: len(own) - 1] = own[1 : m + 1]
        # beyond the midpoint: far against the last period of near, then against itself
        head = far[:m]
        joined = np.concatenate([head, gap, near[:m][::-1]])
        across = z_values(joined, len(joined) - 1)[len(head) + 1 :][::-1]  # at q - 1: far against near[q-1], near[q-2], ...
        across = np.minimum(across, q)
        beyond = np.zeros(m, np.int64)
        k = min(len(other) - 1, m)
        beyond[:k] = other[1 : k + 1]
        across = np.where((across == q) & (q < len(far)), across + beyond, across)
        length = q + inside + across
        ok = np.flatnonzero(length >= np.maximum(least, power * q))
        if len(ok):
            q, inside, across = q[ok], inside[ok], across[ok]
            a, b = (mid - q - inside, mid + across) if sign < 0 else (mid - across, mid + q + inside)
            _, first = np.unique(a * (hi + 1) + b, return_index=True)  # of equal intervals the smallest period
            found += zip(a[first].tolist(), b[first].tolist(), q[first].tolist())
    return found


def find_runs(s: np.ndarray, least: int = 24, power: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least ``least`` items and ``power`` periods (3 or more), by start.

    Divide and conquer: every run crosses the midpoint of exactly one part that holds it whole, where Z-functions of both
    halves give how far each period reaches. What reaches a part's end and goes on beyond is left to the part above. Equal
    intervals keep the smallest period. Parts that cannot hold a run are passed over: every window of (least + 5) // 3 words of a
    run occurs in it twice, as a run holds at least two periods of window starts.
    """
    width = (least + 5) // 3
    if len(s) < least:
        return []
    later, parts = stretches(s, width)
    best: dict[tuple[int, int], int] = {}
    for lo, hi in parts:
        if hi - lo < least:
            continue
        part, then, n, todo = s[lo:hi], later[lo : hi - width + 1] - lo, hi - lo, [(0, hi - lo)]
        while todo:
            a, b = todo.pop()
            if b - a < least or then[a : b - width + 1].min() > b - width:
                continue
            mid = (a + b) // 2
            todo += [(a, mid), (mid, b)]
            for x, y, q in crossing(part, a, mid, b, least, power):
                if (x == a and x and part[x - 1] == part[x - 1 + q]) or (y == b and y < n and part[y] == part[y - q]):
                    continue
                key = (lo + x, lo + y)
                best[key] = min(best.get(key, q), q)
    return sorted((x, y - x, q) for (x, y), q in best.items())


def stretches(s: np.ndarray, width: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each window of ``width`` items the start of the next one with its hash (beyond all if none), and the parts of s in
    which every window has its hash in common with another. Equal windows hash alike; others only seldom do, which costs time."""
    n = len(s) - width + 1
    x = s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = x[:n].copy()
    for j in range(1, width):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + x[j : n + j]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    first, second = order[:-1][same], order[1:][same]
    later = np.full(n, 2 * len(s), np.int64)
    later[first] = second
    twice = np.zeros(n + 2, np.int8)
    twice[1 + first] = 1
    twice[1 + second] = 1
    edge = np.flatnonzero(np.diff(twice)).tolist()
    return later, [(a, b + width - 1) for a, b in zip(edge[::2], edge[1::2])]


def tail_repeats(h: int, n: int) -> np.ndarray | None:
    """For a checksum h that ends in 0: which word each of n words becomes, so that the text's end repeats."""
    if h < 0 or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def detector(least: int, power: int, rewrite):
    """mapInArrow: doc_id, checksum, text as bytes -> doc_id, n_words, runs, collapsed text."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            counts, offsets, flat, texts = [], [0], [], []
            for h, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or b"").split()
                moved = rewrite(h, len(words)) if rewrite else None
                if moved is not None:
                    words = list(map(words.__getitem__, moved.tolist()))
                n = len(words)
                counts.append(n)
                runs = []
                if n >= least:
                    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
                    runs = find_runs(np.fromiter(map(number.__getitem__, words), np.int64, n), least, power)
                if runs:
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, [a + q for a, _, q in runs], 1)
                    np.add.at(change, [a + m for a, m, _ in runs], -1)
                    words = [w for w, gone in zip(words, np.cumsum(change[:-1]).tolist()) if not gone]
                    flat += runs
                offsets.append(len(flat))
                texts.append(b" ".join(words))
            columns = [pa.array(c, pa.int64()) for c in (zip(*flat) if flat else ((), (), ()))]
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(run_type)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), runs, pa.array(texts, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run
