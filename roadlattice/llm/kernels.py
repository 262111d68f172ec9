"""Small helpers that run inside tasks on Arrow batches: tokens, hashes, minima, vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash

_M64 = (1 << 64) - 1


def mixed(i: int) -> int:
    """The i-th value of a fixed 64-bit sequence (a Weyl step and a multiply-xor finalizer)."""
    z = (i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _M64
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
    return z ^ (z >> 31)


def finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Remembered(dict):
    """A dict that computes what it lacks and starts afresh when it is full."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def word_hashes() -> Remembered:
    return Remembered(xxhash.xxh64_intdigest)


def ascii_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], hashes: Remembered, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows; a shorter text is one window."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < width:
        total = np.uint64(mixed(1000 + n))
        for j in range(n):
            total = total + h[j : j + 1] * np.uint64(mixed(j) | 1)
        return finish(total)
    total = h[: n - width + 1] * np.uint64(mixed(0) | 1)
    for j in range(1, width):
        total = total + h[j : n - width + 1 + j] * np.uint64(mixed(j) | 1)
    return np.unique(finish(total))


def minima(values: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """For each universal hash a*x+b (mod 2^32) its least value over the set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        best = np.minimum(best, (mult * x[k : k + 1024] + add).min(axis=1))
    return best


def signer(bands: int, rows: int, width: int):
    """mapInArrow: doc_id, text -> doc_id, n_shingles, set_key, band keys, one-byte signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        k = bands * rows
        mult = np.array([mixed(2 * i + 5000) & 0xFFFFFFFF | 1 for i in range(k)], np.uint32)[:, None]
        add = np.array([mixed(2 * i + 5001) & 0xFFFFFFFF for i in range(k)], np.uint32)[:, None]
        weight = np.array([mixed(i + 9000) | 1 for i in range(rows)], np.uint64)
        band_no = np.array([mixed(i + 9500) for i in range(bands)], np.uint64)
        hashes = word_hashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            out = [[], [], [], []]
            for t in texts:
                s = shingles(ascii_words(t.as_py() or ""), hashes, width)
                out[0].append(len(s))
                if not len(s):
                    out[1].append(None), out[2].append(None), out[3].append(None)
                    continue
                m = minima(s, mult, add)
                keys = finish((m.reshape(bands, rows).astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64) + band_no)
                out[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                out[2].append(keys.view(np.int64))
                out[3].append((finish(m.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], schema=schema)

    return run


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of one-byte signatures, corrected for chance agreement."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def signature_matrix(column, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, k)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on full sets: percent of the union lies in both."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def setter(width: int):
    """mapInArrow: id, text -> id, shingle set as bytes."""

    def run(batches):
        hashes = word_hashes()
        for batch in batches:
            sets = [shingles(ascii_words(t.as_py() or ""), hashes, width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return run


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def confirmer(percent: int):
    """mapInArrow: a, b, set_a, set_b -> pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            a, b, sa, sb = (batch.column(i) for i in range(4))
            keep = [linked(unpacked(x.as_py()), unpacked(y.as_py()), percent) for x, y in zip(sa, sb)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def cross_block(k: int, least: float, percent: int):
    """mapInArrow over rows sorted by block, queries first: links of a block's queries and members of
    different components. Holds one block's queries at a time and one batch of members."""

    def run(batches):
        block, queries, done = None, [], set()
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = list(zip(c["bucket"].to_pylist(), c["q_chunk"].to_pylist(), c["t_chunk"].to_pylist()))
            is_query, ids, comps = c["is_query"].to_pylist(), c["id"].to_pylist(), c["comp"].to_pylist()
            sigs = signature_matrix(c["sig"].to_pylist(), k)
            bands = np.asarray(c["bands"].flatten()).reshape(len(keys), -1)
            sets = c["set"]
            a, b, i, n = [], [], 0, len(keys)
            while i < n:
                if keys[i] != block:
                    block, queries, done = keys[i], [], set()
                if is_query[i]:
                    queries.append((ids[i], comps[i], sigs[i], bands[i], unpacked(sets[i].as_py())))
                    i += 1
                    continue
                j = i
                while j < n and keys[j] == block and not is_query[j] and j - i < 1024:
                    j += 1
                own = np.array(comps[i:j])
                for q, comp, sig, band, members in queries:
                    near = similar(sigs[i:j], sig)
                    near[own == comp] = -1.0
                    at = np.nonzero(near >= least)[0]
                    if not len(at):
                        continue
                    here = int(np.nonzero(band == block[0])[0][0])
                    at = at[(bands[i + at] == band).argmax(axis=1) == here]
                    for y in at[np.argsort(-near[at], kind="stable")]:
                        other = comps[i + y]
                        if (q, other) not in done and linked(members, unpacked(sets[int(i + y)].as_py()), percent):
                            done.add((q, other))
                            a.append(min(q, ids[i + y])), b.append(max(q, ids[i + y]))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run
