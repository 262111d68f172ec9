"""Byte-level BPE by recursive DuckDB queries, inside tasks on Arrow batches."""

from __future__ import annotations

import base64
import re
import sys
import types

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: A place in a word has so many bits of a key, the word's number those above.
PLACE = 31

#: Rows tok(a, z, id): a token of a word from place a up to place z. Every round the word's pairs of neighbours join the merge
#: table, and the leftmost pair of least rank becomes one token; a word without such a pair is not carried on.
_PAIRS = f"""
    SELECT x.a, x.z AS mid, y.z, m.rank, m.lone, (m.rank << {PLACE}) | (x.a & {(1 << PLACE) - 1}) AS o
    FROM tok x JOIN tok y ON y.a = x.z JOIN merges m ON m.pair = (x.id << 32) | y.id"""
_BEGIN = "WITH RECURSIVE tok(a, z, id, round) AS (SELECT a, z, id, 0 FROM base UNION ALL ("
_END = f"""
), last AS (
  SELECT a >> {PLACE} AS word, max(round) AS round FROM tok GROUP BY 1
)
SELECT list(id ORDER BY a) AS ids FROM tok t JOIN last l ON t.a >> {PLACE} = l.word AND t.round = l.round GROUP BY word ORDER BY word
"""
CONTRACT = f"""{_BEGIN}
  WITH pairs AS ({_PAIRS}
  ), hit AS (
    SELECT a >> {PLACE} AS word, arg_min(a, o) AS a, arg_min(mid, o) AS mid, arg_min(z, o) AS z, min(o) >> {PLACE} AS rank FROM pairs GROUP BY 1
  )
  SELECT t.a, CASE WHEN t.a = h.a THEN h.z ELSE t.z END, CASE WHEN t.a = h.a THEN h.rank ELSE t.id END, t.round + 1
  FROM tok t JOIN hit h ON h.word = t.a >> {PLACE} WHERE t.a <> h.mid){_END}"""

#: For long words: in one round also the equal pairs further right, where nothing of lower rank can arise from the new token.
#: Of pairs that overlap in a chain every second one goes, as the leftmost would be taken first again and again.
CONTRACT_LONG = f"""{_BEGIN}
  WITH pairs AS ({_PAIRS}
  ), best AS (
    SELECT a >> {PLACE} AS word, min(o) AS o FROM pairs GROUP BY 1
  ), equal AS (
    SELECT p.a, p.mid, p.z, p.rank FROM pairs p JOIN best b ON b.word = p.a >> {PLACE} AND p.rank = b.o >> {PLACE} AND (p.o = b.o OR NOT p.lone)
  ), chained AS (
    SELECT *, sum(CASE WHEN a = before THEN 0 ELSE 1 END) OVER (ORDER BY a) AS chain FROM (SELECT *, lag(mid) OVER (ORDER BY a) AS before FROM equal)
  ), hit AS (
    SELECT a, z, rank, mid FROM chained QUALIFY row_number() OVER (PARTITION BY chain ORDER BY a) % 2 = 1
  )
  SELECT t.a, coalesce(h.z, t.z), coalesce(h.rank, t.id), t.round + 1
  FROM tok t JOIN best b ON b.word = t.a >> {PLACE} LEFT JOIN hit h ON h.a = t.a LEFT JOIN hit e ON e.mid = t.a WHERE e.mid IS NULL){_END}"""

#: Pieces of as many bytes or more are long.
LONG = 64
#: Bytes of pieces in one query, more only for one piece.
QUERY_BYTES = 1 << 18

#: The bytes of each sequence of ids, in order.
DECODE = "SELECT unhex(string_agg(hex, '' ORDER BY place)) AS bytes FROM seq JOIN vocabulary USING (id) GROUP BY number ORDER BY number"

# Letters and numbers that Unicode took in after version 16, which rank files' libraries go by.
_LATER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f
12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff
1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
LATER = re.compile("[" + "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in _LATER.split()) + "]")

#: The last byte of white space beyond ASCII, by the bytes before it: \x85 \xa0 \u1680 \u2000-\u200a \u2028 \u2029 \u202f \u205f \u3000.
_WIDE = {(0xC2,): [0x85, 0xA0], (0xE1, 0x9A): [0x80], (0xE2, 0x80): [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF], (0xE2, 0x81): [0x9F], (0xE3, 0x80): [0x80]}
_GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing the pattern's matches: before ASCII white space that follows something else."""
    gap = _GAPS[data]
    after = gap.copy()
    for head, last in _WIDE.items():
        k = len(head)
        at = np.flatnonzero(data[: len(data) - k] == head[0])
        for j in range(1, k):
            at = at[data[at + j] == head[j]]
        after[at[np.isin(data[at + k], last)] + k] = True
    return np.flatnonzero(gap[1:] & ~after[:-1]) + 1


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string or binary column; nulls are empty."""
    column = pa.concat_arrays([pc.fill_null(column.cast(pa.binary()), b"")])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)


def _binary(offsets: np.ndarray, data) -> pa.BinaryArray:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])


def _recoded(offsets: np.ndarray, data: np.ndarray, cuts: np.ndarray, recode) -> pa.BinaryArray:
    """Rows cut further at cuts, each distinct piece recoded once, and put together again as rows."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[cuts] = True
    edges = np.flatnonzero(edge)
    pieces = _binary(edges, data).dictionary_encode()
    done = pa.array(recode(pieces.dictionary), pa.binary()).take(pieces.indices) if len(pieces) else pa.array([], pa.binary())
    at, out = _flat(done)
    return _binary(at[np.searchsorted(edges, offsets)], out)


class Coder:
    """Vocabulary, merge table and remembered words of one rank file; one for each Python process."""

    def __init__(self, path: str, pattern: str, most: int):
        lines = (line.split() for line in open(path, "rb") if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.pattern, self.most, self.known, self.decoded = regex.compile(pattern), most, {}, {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        rows = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.empty(0, np.int64),) * 3
        lone = np.isin(rank, np.concatenate([left[rank < left], right[rank < right]]))  # tokens that may at once join one of lower rank
        self.table("merges", pair=left << 32 | right, rank=rank, lone=lone)
        self.vocabulary = sorted(self.ranks.items(), key=lambda x: x[1])
        self.table("vocabulary", id=[r for _, r in self.vocabulary], hex=[t.hex() for t, _ in self.vocabulary])
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.single < 0).any():
            raise ValueError("the rank file lacks single bytes")
        self.joins = np.zeros(65536, bool)  # byte pairs that stand together in some token
        for t in self.ranks:
            self.joins[[t[i] << 8 | t[i + 1] for i in range(len(t) - 1)]] = True
        self.opens = np.zeros(max(self.ranks.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[r for t, r in self.ranks.items() if t[:1] == b" "]] = True

    def table(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces by merging alone, a part of them in a query."""
        out: dict[bytes, bytes] = {}
        for query, some in ((CONTRACT, [p for p in pieces if len(p) < LONG]), (CONTRACT_LONG, [p for p in pieces if len(p) >= LONG])):
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
            start = 0
            while start < len(some):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + QUERY_BYTES)))
                part = some[start:stop]
                lengths = np.fromiter(map(len, part), np.int64, len(part))
                place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                a = np.repeat(np.arange(len(part)), lengths) << PLACE | place
                self.table("base", a=a, z=a + 1, id=self.single[np.frombuffer(b"".join(part), np.uint8)])
                ids = self.con.sql(query).to_arrow_table()["ids"].combine_chunks()
                flat, at = ids.flatten().to_numpy().astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])).tolist()
                out.update(zip(part, (flat[i:j] for i, j in zip(at, at[1:]))))
                start = stop
        return [out[p] for p in pieces]

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian 32-bit integers. A word of the vocabulary is its own token; others are cut where
        no token reaches across, and their pieces contracted."""
        found = {w: ids for w in words if (ids := self.known.get(w)) is not None}
        rest = [w for w in words if w not in found]
        blobs = [w.encode() for w in rest]
        found |= {w: rank.to_bytes(4, "little") for w, b in zip(rest, blobs) if (rank := self.ranks.get(b)) is not None}
        rest, blobs = [w for w in rest if w not in found], [b for b in blobs if b not in self.ranks]
        if not rest:
            return found
        blob = b"".join(blobs)
        x = np.frombuffer(blob, np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)))
        edge = ~self.joins[x[:-1] << 8 | x[1:]]
        edge[ends[:-1] - 1] = True
        at = np.concatenate([[0], np.flatnonzero(edge) + 1, [len(blob)]])
        own = np.concatenate([[0], np.searchsorted(at, ends)]).tolist()  # the pieces of each word
        at = at.tolist()
        pieces = [blob[i:j] for i, j in zip(at, at[1:])]
        distinct = list(dict.fromkeys(pieces))
        coded = dict(zip(distinct, self.contract(distinct)))
        ids = list(map(coded.__getitem__, pieces))
        new = {w: ids[i] if j == i + 1 else b"".join(ids[i:j]) for w, i, j in zip(rest, own, own[1:])}
        if len(self.known) < self.most:
            self.known.update(new)
        return found | new

    def split(self, chunk: str) -> list[str]:
        """The pattern's matches, with later letters and numbers as what they were in the pattern's Unicode version: unassigned."""
        return [chunk[m.start() : m.end()] for m in self.pattern.finditer(LATER.sub("\U000e0fff", chunk))]

    def chunks(self, chunks: pa.BinaryArray) -> list[bytes]:
        """Ids of distinct chunks of text; only distinct words are contracted."""
        texts = chunks.cast(pa.string()).to_numpy(zero_copy_only=False).tolist()
        split = list(map(self.split if LATER.search(" ".join(texts)) else self.pattern.findall, texts))
        ids = self.words(list(dict.fromkeys(w for found in split for w in found)))
        return [ids[found[0]] if len(found) == 1 else b"".join(map(ids.__getitem__, found)) for found in split]

    def encode(self, column) -> pa.BinaryArray:
        """Ids of texts, as little-endian 32-bit integers."""
        offsets, data = _flat(column)
        return _recoded(offsets, data, chunk_starts(data), self.chunks)

    def sequences(self, pieces: pa.BinaryArray) -> list[bytes]:
        """Bytes of distinct sequences of ids."""
        pieces = pieces.to_numpy(zero_copy_only=False).tolist()
        found = dict.fromkeys(pieces)
        new = [p for p in pieces if p not in self.decoded]
        found.update((p, self.decoded[p]) for p in pieces if p in self.decoded)
        for start in range(0, len(new), 100_000):
            part = new[start : start + 100_000]
            counts = np.fromiter(map(len, part), np.int64, len(part)) // 4
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            self.table("seq", number=np.repeat(np.arange(len(part)), counts), place=place, id=np.frombuffer(b"".join(part), "<u4").astype(np.int64))
            done = self.con.sql(DECODE).to_arrow_table()["bytes"].to_numpy(zero_copy_only=False).tolist()
            if len(done) < len(part):
                raise ValueError("ids that the rank file lacks")
            found.update(zip(part, done))
            if len(self.decoded) < self.most:
                self.decoded.update(zip(part, done))
        return [found[p] for p in pieces]

    def decode(self, column) -> pa.BinaryArray:
        """Bytes of ids: rows are cut before tokens that begin with a space, and distinct pieces decoded."""
        offsets, data = _flat(column)
        return _recoded(offsets, data, 4 * np.flatnonzero(self.opens[data.view("<u4")]), self.sequences)


def coder(path: str, pattern: str, most: int) -> Coder:
    """The process keeps its coders, so that tasks after the first need not build tables and learn frequent words again."""
    kept = sys.modules.setdefault("_byte_bpe_coders", types.ModuleType("_byte_bpe_coders")).__dict__
    if (path, pattern, most) not in kept:
        kept[path, pattern, most] = Coder(path, pattern, most)
    return kept[path, pattern, most]


def _slices(column, limit: int = 1 << 23):
    """Ranges of rows of at most ``limit`` bytes each, or one row."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    yield start, len(lengths)


def encoder(path: str, pattern: str, most: int):
    """mapInArrow: doc_id, text -> doc_id, ids as little-endian 32-bit integers."""

    def run(batches):
        c = coder(path, pattern, most)
        for batch in batches:
            for i, j in _slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], c.encode(batch.column(1)[i:j])], names=["doc_id", "ids"])

    return run


def decoder(path: str, pattern: str, most: int):
    """mapInArrow: doc_id, ids -> doc_id, ids, decoded bytes."""

    def run(batches):
        c = coder(path, pattern, most)
        for batch in batches:
            for i, j in _slices(batch.column(1)):
                ids = batch.column(1)[i:j]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], ids, c.decode(ids)], names=["doc_id", "ids", "decoded"])

    return run


def both_ways(path: str, pattern: str, most: int):
    """mapInArrow: the encoder and then the decoder of its ids, in one process."""
    there, back = encoder(path, pattern, most), decoder(path, pattern, most)
    return lambda batches: back(there(batches))
