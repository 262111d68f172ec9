"""Multi-pattern search over word sequences: shift tables on blocks of words, suffix buckets, comparison."""

from __future__ import annotations

import hashlib

import pyarrow as pa

#: Bytes that are part of a word map to themselves (A-Z to lower case), all others to a space.
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def norm_words(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def windows(words: list[bytes], width: int) -> list[tuple]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Searcher:
    """All patterns of one length m. The block is the last two words of the search window (one, if
    m is 1). shift[block] is how far the window can move; where it is 0, buckets[block] holds the
    patterns that end so, and the whole window is compared with them."""

    def __init__(self, m: int, shift: dict[bytes, int], buckets: dict[bytes, dict[bytes, list]]):
        self.m, self.size, self.shift, self.buckets = m, min(2, m), shift, buckets

    def find(self, words: list[bytes]):
        """(first word, items) of each window that equals a pattern, in order."""
        m, shift, buckets, n = self.m, self.shift, self.buckets, len(words)
        get, far = shift.get, m - self.size + 1
        i = m - 1
        if self.size == 1:
            while i < n:
                if words[i] in buckets:
                    yield i, buckets[words[i]][words[i]]
                i += 1
            return
        while i < n:
            block = words[i - 1] + b" " + words[i]
            step = get(block, far)
            if step:
                i += step
                continue
            found = buckets[block].get(b" ".join(words[i - m + 1 : i + 1]))
            if found is not None:
                yield i - m + 1, found
            i += 1


def tables(items: list[tuple], width: int) -> list[tuple]:
    """items: (item_id, text) -> (m, shift, buckets) for each pattern length m."""
    by_length: dict[int, dict[tuple, list]] = {}
    for item, text in items:
        for p in windows(norm_words(text or ""), width):
            own = by_length.setdefault(len(p), {}).setdefault(p, [])
            if item not in own:
                own.append(item)
    out = []
    for m, patterns in sorted(by_length.items(), reverse=True):
        size, shift, buckets = min(2, m), {}, {}
        for p, own in patterns.items():
            for end in range(size, m + 1):
                block = b" ".join(p[end - size : end])
                shift[block] = min(shift.get(block, m), m - end)
            buckets.setdefault(b" ".join(p[m - size :]), {})[b" ".join(p)] = own
        out.append((m, shift, buckets))
    return out


def examine(text: str | None, search: list[Searcher]) -> tuple[int, list, set]:
    """Number of words, hit spans and items found in one text."""
    words = norm_words(text or "")
    hits, found = [], set()
    for s in search:
        for at, own in s.find(words):
            hits.append((at, at + s.m))
            found.update(own)
    return len(words), merged(hits), found


def scanner(shared):
    """mapInArrow: doc_id, text -> doc_id, n_words, merged hit spans (start, end), item ids found."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

    def run(batches):
        search = [Searcher(*x) for x in shared.value]
        for batch in batches:
            rows = [examine(t.as_py(), search) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], schema.field(2).type), pa.array([sorted(r[2]) for r in rows], schema.field(3).type)], schema=schema)

    return run


def is_contaminated(n_words: int, n_hit: int, per_cent: int) -> bool:
    return n_hit > 0 and 100 * n_hit >= per_cent * n_words


def judge(shared, per_cent: int):
    """text series -> whether contaminated."""

    def run(series):
        import pandas as pd

        search = [Searcher(*x) for x in shared.value]
        for texts in series:
            seen = [examine(t, search) for t in texts]
            yield pd.Series([is_contaminated(n, sum(b - a for a, b in spans), per_cent) for n, spans, _ in seen], dtype=bool)

    return run


def merged(hits: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def totals(spans: list, items: list) -> tuple[int, int, str]:
    """Hit words, number of items and digest of the item ids of one document."""
    hit = sum(b - a for a, b in merged([tuple(x) for x in spans]))
    ids = sorted(set(items))
    return hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()
