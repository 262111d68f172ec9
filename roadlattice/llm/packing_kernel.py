"""Tokens of a stream of documents and the cuts that pack them, for one partition."""

from __future__ import annotations

import re
import sys
import types
import zlib
from array import array
from bisect import bisect_left
from collections import deque
from unicodedata import is_normalized

import pyarrow as pa

from .kernels import Remembered


_SENTENCE_END = re.compile(r"[.!?]\s+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def worker_state() -> dict:
    """What the tasks of one Python worker share."""
    return sys.modules.setdefault("_roadlattice_worker", types.ModuleType("_roadlattice_worker")).__dict__


class WordIds(Remembered):
    """Ids of a piece without spaces, as little-endian uint32 bytes. Lower-case letters alone are one
    pre-token, so they go to the vocabulary's merges at once; a stop behind letters is another one."""

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        super().__init__(self.ids, most)
        self.tok = Tokenizer.from_file(path)
        self.model = Tokenizer.from_file(path).model
        self.model._resize_cache(0)  # this dict remembers more
        self.letters = _byte_letters()

    def ids(self, piece: str) -> bytes:
        if piece.isalpha() and piece.islower():
            word = piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        if piece[-1:] in (".", ",") and piece[:-1].isalpha() and piece.islower():
            return self[piece[:-1]] + self[piece[-1]]
        return self.whole(piece)

    def in_whole(self, text: str) -> tuple[bytes, list[int]]:
        """Ids of a text, and the numbers of ids at the ends of its sentences."""
        found = self.tok.encode(text, add_special_tokens=False)
        begins = [a for a, _ in found.offsets]
        ends = (bisect_left(begins, m.end()) for m in _SENTENCE_END.finditer(text))
        return array("I", found.ids).tobytes(), sorted({e for e in ends if 0 < e < len(begins)})

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()


#: Texts whose ids show whether a tokenizer lowers letters, drops white space and keeps letters, signs and spaces apart.
PROBES = ("The Quick brown. fox, JUMPS over 12 lazy dogs. It's", "a  b\nc\td. e", "naïve Straße über. été", "x.y,z (q) 'r' don't e.g. 3.5% #t", "der die.das und, so. Weiter")


def splits_at_spaces(words: WordIds) -> bool:
    """Whether the ids of the probes are those of their pieces."""
    for text in PROBES:
        pieces = text.lower().replace("\n", " ").replace("\t", " ").split(" ")
        if words.whole(text) != b"".join(words.ids(p) for p in pieces if p):
            return False
    return words.whole("ab. cd") == words.ids("ab") + words.whole(".") + words.ids("cd")


def encoder(path: str, remembered: int = 1_000_000):
    """text -> (ids as little-endian uint32 bytes, token counts at sentence ends).

    Where the vocabulary lowers letters, drops white space and never joins across it, and letters never join
    signs, a text's ids are those of its pieces, each encoded once per worker. Texts whose letters
    lower differently in a context or are not composed are encoded as a whole, and so is every text where probes
    show another tokenizer.
    """
    state, key = worker_state(), f"words {path}"
    if key not in state:
        made = WordIds(path, remembered)
        state[key] = made, splits_at_spaces(made)
    words, apart = state[key]
    get, dot = words.__getitem__, words["."]

    def encode(text: str, end: bytes) -> tuple[bytes, list[int]]:
        if not apart or not text.isascii() and ("Σ" in text or "İ" in text or not is_normalized("NFC", text)):
            ids, ends = words.in_whole(text)
            return ids + end, ends
        parts, ends, n = [], [], 0
        sentences = (text.lower().replace("\n", " ") + " ").split(". ")
        last = len(sentences) - 1
        for k, sentence in enumerate(sentences):
            own = sentence.split(" ")
            if k < last and (tail := own[-1]) and not tail[-1].isalnum():
                own[-1] = tail + "."
                ids = b"".join(map(get, own))
            else:
                ids = b"".join(map(get, own)) + (dot if k < last else b"")
            parts.append(ids)
            n += len(ids) >> 2
            if k < last:
                ends.append(n)
        parts.append(end)
        return b"".join(parts), ends

    return encode


def choose_cuts(bounds: list[int], kinds: list[int], size: int, penalty: tuple[int, int, int], least_power: int = 1) -> list[int]:
    """Cuts among the ascending positions ``bounds`` (first and last are cuts), at most ``size`` apart.

    Cost of a window of n ids: its padding (size - n, none if n is a power of two) and the penalty of
    what it truncates at its end, by kind (0 document end, 1 sentence end, 2 inside a sentence). With
    g(i) = cost(i) + bounds[i] a transition costs g(i) + size - bounds[j], so the best i is the head
    of a queue with rising g over the last ``size`` ids; powers of two from least_power on are looked up
    by position.
    """
    n = len(bounds)
    cost, back = [0] * n, [0] * n
    where = {bounds[0]: 0}
    queue = deque([(bounds[0], 0, bounds[0])])  # g, index, position
    powers = [1 << k for k in range(size.bit_length()) if least_power <= 1 << k < size]
    for j in range(1, n):
        b = bounds[j]
        while queue[0][2] < b - size:
            queue.popleft()
        best, at = queue[0][0] + size - b, queue[0][1]
        if best > 0:
            for p in powers:
                i = where.get(b - p)
                if i is not None and cost[i] < best:
                    best, at = cost[i], i
        cost[j], back[j] = best + penalty[kinds[j]], at
        where[b] = j
        g = cost[j] + b
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j, b))
        if len(where) > 4 * size:
            where = {p: i for p, i in where.items() if p >= b - size}
    cuts, j = [bounds[-1]], n - 1
    while j:
        j = back[j]
        cuts.append(bounds[j])
    return cuts[::-1]


PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def packer(path: str, size: int, end_id: int, horizon: int, penalty: tuple[int, int, int]):
    """mapInArrow: doc_id, text -> pieces. Packs the partition's documents in their order.

    Tokens wait in a buffer of about ``horizon`` windows; then the cuts are chosen and all windows but
    the last few are written, so memory does not grow with the partition.
    """

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(path)
        end = array("I", [end_id]).tobytes()
        base = TaskContext.get().partitionId() << 33
        docs: deque = deque()  # doc_id, ids, ends, first position, number of ids
        begin = filled = seq = 0  # begin: stream position of the next window

        def emit(last: bool):
            nonlocal begin, seq
            marks: dict[int, int] = {}
            for _, _, ends, first, n in docs:
                for e in ends:
                    if begin < first + e:
                        marks[first + e] = 1
                if begin < first + n:
                    marks[first + n] = 0
            if last:  # the rest can end at powers of two, without padding
                tail = filled - begin
                at = begin + tail // size * size
                for k in range(size.bit_length(), -1, -1):
                    if (filled - at) >> k & 1 and at + (1 << k) <= filled:
                        at += 1 << k
                        marks.setdefault(at, 2)
            marks.pop(begin, None)
            bounds, kinds = [begin], [0]
            for p in sorted(marks):
                while p - bounds[-1] > size:  # a sentence longer than a window
                    bounds.append(bounds[-1] + size)
                    kinds.append(2)
                bounds.append(p), kinds.append(marks[p])
            cuts = choose_cuts(bounds, kinds, size, penalty, 1 if last else size // 4)
            stop = len(cuts) if last else max(2, len(cuts) - 4)
            rows = []
            for a, b in zip(cuts, cuts[1:stop]):
                offset = 0
                while docs and docs[0][3] + docs[0][4] <= a:
                    docs.popleft()
                for doc_id, ids, _, first, n in docs:
                    if first >= b:
                        break
                    lo, hi = max(a, first) - first, min(b, first + n) - first
                    rows.append((doc_id, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]), n, base | seq, offset))
                    offset += hi - lo
                seq += 1
                begin = b
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7, schema=PIECES)

        for batch in batches:
            ids_col, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                ids, ends = encode(texts[k].as_py() or "", end)
                n = len(ids) >> 2
                docs.append((ids_col[k].as_py(), ids, ends, filled, n))
                filled += n
                if filled - begin >= horizon * size:
                    yield emit(False)
        if filled > begin:
            yield emit(True)

    return run
