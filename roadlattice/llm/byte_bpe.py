"""Byte-level BPE: texts to token ids and back, by the ranks of a tiktoken file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_kernel

#: Words that a Python process remembers, of those that are no token.
REMEMBERED = 300_000


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, remembered: int = REMEMBERED) -> DataFrame:
    """documents -> doc_id, ids: the token ids of every whole text, as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` (which must leave white space as the patterns of public byte-level vocabularies do: a match
    that holds white space and something else begins with a single space) is encoded by itself: a match that is a token is that
    token; of others the leftmost pair of neighbours whose joined bytes have the least rank becomes one token, until no pair is
    left. This is done in each task by a recursive DuckDB query over rows of tokens and places (bpe_kernel.CONTRACT), for
    the distinct words of up to 8 MB of text at a time. Special tokens are ordinary text.

    Null and empty texts have no ids. Equal ranks go to the leftmost pair (ties). Texts and words of any length are encoded
    whole. Repeated rows each get their row, null ids stay null; an empty table gives no rows. Other columns are ignored, whatever
    their names. Nothing is shuffled. The rank file must be readable under its path on every executor.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(bpe_kernel.encoder(ranks_path, pattern, remembered), "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, ids -> doc_id, ids, decoded: the bytes of the ids in order, by ordered aggregation in DuckDB. Null ids count as none;
    an id that the file lacks is an error."""
    return encoded.select("doc_id", "ids").mapInArrow(bpe_kernel.decoder(ranks_path, pattern, remembered), "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, remembered: int = REMEMBERED) -> DataFrame:
    """documents -> doc_id, n_tokens, and digests of the ids and of the bytes decoded from them: encode and decode in one process, which
    shares what it remembers. All cases as there; null and empty texts have the digests of nothing."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = texts.mapInArrow(bpe_kernel.both_ways(ranks_path, pattern, remembered), "doc_id long, ids binary, decoded binary")
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.coalesce("ids", F.lit(b"")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
