"""Packing documents into sequences: first-fit decreasing in randomised groups, with a tournament tree of bins."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgauge.llm.common import hide_missing, show_missing, stored

#: Fixed values of the public byte-level vocabulary: its special token and the id that ends a document here.
SPECIAL, SPECIAL_ID, END_ID = "<|endoftext|>", 50256, 0
PIECE_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def byte_bpe(path: str | None = None):
    """The public byte-level BPE of 50,257 ids, from its rank file, as a function from a text to an array of ids."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding(
        "byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}
    )
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, capacity: int, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): every document cut at multiples of the capacity."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = byte_bpe(vocabulary)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(encode(text or ""), END_ID).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(hide_missing("doc_id"), "text").mapInPandas(cut, PIECE_COLUMNS)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; the items come longest first.

    Leaves of the tree are bins in the order of opening, inner nodes hold the largest room below; the way down to the
    first bin with room takes the logarithm of the number of bins.
    """
    n = len(lengths)
    full = int(np.searchsorted(-lengths, -capacity, "right"))
    bins, offsets = np.arange(n), np.zeros(n, np.int64)
    if full == n:
        return bins, offsets
    width = 1 << max(0, (n - full - 1).bit_length())
    room = [capacity] * (2 * width)
    for at in range(full, n):
        need, node = int(lengths[at]), 1
        while node < width:
            node *= 2
            if room[node] < need:
                node += 1
        bins[at], offsets[at] = full + node - width, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, offsets


def pack(
    docs: DataFrame, capacity: int = 1024, group_pieces: int = 8192, seed: int = 5, vocabulary: str | None = None
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one a piece of every row of `docs`.

    A document is its ids and an end id. It is cut at multiples of the capacity, so only its last piece is shorter.
    Pieces are dealt by a seeded hash into groups of about `group_pieces`, each packed by itself; sequence_id holds
    group and bin. A missing or empty text is the end id alone; a missing id stays missing; repeated rows are packed as
    often as they come; an empty table gives an empty one. Other columns are ignored.
    """
    cut = stored(pieces(docs, capacity, vocabulary), "pack-pieces")
    groups = max(1, -(-cut.count() // group_pieces))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["grp"].to_numpy() << 32) + bins, offset=offsets).drop(columns="grp")

    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInPandas(fit, PIECE_COLUMNS + ", sequence_id long, offset long")
    return packed.withColumn("doc_id", show_missing("doc_id"))
