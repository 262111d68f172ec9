"""Order-preserving packing of tokenized documents into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing_kernel


def pack(docs: DataFrame, tokenizer_path: str, *, size: int = 2048, end_id: int = 1, horizon: int = 128, penalty: tuple[int, int, int] = (0, 3, 64)) -> DataFrame:
    """documents -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every partition packs its own documents in their order, so nothing is shuffled; its last sequence
    is cut at powers of two. Window ends are chosen by dynamic programming (see choose_cuts) among
    document and sentence ends: padding costs 1 an id, a cut document ``penalty[1]``, a cut sentence
    ``penalty[2]`` (only where a sentence is longer than a window, and at the partition's end).
    sequence_id is the partition's number and a running number; a task that runs again gives the same.

    Null and empty texts are the end id alone. A null doc_id stays null. Rows that repeat a doc_id are
    packed each. Documents longer than a window are cut, at sentence ends where there are some. Of equally good cuts the
    one that begins the window earliest is taken, which the rows' order fixes (ties). An empty table gives no rows. Other
    columns are ignored, whatever their names.

    Pieces of texts are encoded by themselves where the tokenizer allows it (probes tell, see splits_at_spaces), else whole texts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(packing_kernel.packer(tokenizer_path, size, end_id, horizon, penalty), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
