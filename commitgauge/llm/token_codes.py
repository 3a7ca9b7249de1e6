"""Token ids stored as directly addressable codes: any id of a file can be read without decoding a block.

Each id is cut into chunks of ``width`` bits, lowest first. Level 0 holds the lowest chunk of every id, level k + 1
the next chunk of those ids that have one. A bitmap beside each level marks which of its ids go on; a directory of
the bitmap's ones before every 512 bits gives the rank of a position with one popcount of at most 512 bits. Reading
id i: chunk 0 at i; while its bit is set, go to level k + 1 at the rank of the position. A range of ids is read with
one rank and a prefix sum a level.

Files: documents in ascending doc_id (missing first, ties by text) are cut into contiguous ranges by Spark's range
partitioning; each task writes its range as files of whole documents of about ``block_ids`` ids. A file (one binary
value a row of a Parquet table, so that Spark's commit protocol makes writes atomic and retried tasks harmless):

    b"DAC1", u32 documents, u64 ids, u8 width, u8 levels,
    i64 doc_id[documents] (missing: -2**63), u64 start[documents + 1] (ids before each document in the file),
    per level: u64 m, u8 or u16 chunk[m], u64 bitmap words[ceil(m / 64)], u32 ranks[m // 512 + 1]

Ids: the public byte-level BPE of 50,257 ids (``byte_bpe_50k``), its special token's string being that token, with no
special tokens added, then the end id 0. They are taken from the vocabulary's rank file through tiktoken, which gives
the ids of the tokenizers library and its ``byte_bpe_50k.json`` (tests compare every document) at about a quarter of
its work: 100 against 456 CPU seconds a GB of text, measured on one core.

Defined cases: a missing text is empty and holds only the end id; repeated rows are each a document; an empty table
writes no file. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitgauge.llm.common import hide_missing, show_missing
from commitgauge.llm.packing import byte_bpe

#: Fixed value: the id that ends every document.
END_ID = 0
MAGIC = b"DAC1"
SUPER = 512
BLOCK_IDS = 1 << 20
FILE_COLUMNS = "part int, seq long, within long, n_docs long, n_ids long, code binary"
DOC_COLUMNS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def tokenizer(path: str | None = None):
    """The public byte-level BPE as the tokenizers library reads it (its special token's string is that token)."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))


def encode(ids: np.ndarray, width: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels (chunks, bitmap words, ranks) of the ids."""
    ids = ids.astype(np.uint64)
    mask = np.uint64((1 << width) - 1)
    levels = []
    while True:
        more = (ids >> np.uint64(width)) > 0
        chunk = (ids & mask).astype(np.uint8 if width <= 8 else np.uint16)
        bits = np.packbits(more, bitorder="little")
        words = np.zeros((len(bits) + 7) // 8 * 8, np.uint8)
        words[: len(bits)] = bits
        ranks = np.concatenate([[0], np.cumsum(more, dtype=np.uint64)])[::SUPER].astype(np.uint32)
        levels.append((chunk, words.view("<u8"), ranks))
        ids = ids[more] >> np.uint64(width)
        if not len(ids):
            return levels


class Codes:
    """Random access into the levels of one file."""

    def __init__(self, levels, width: int):
        self.levels, self.width = levels, width

    def rank(self, k: int, p: int) -> int:
        """Ones of level k's bitmap before position p."""
        _, words, ranks = self.levels[k]
        block = p // SUPER
        first = block * SUPER // 64
        held = np.unpackbits(words[first : (p + 63) // 64].view(np.uint8), bitorder="little")[: p - first * 64]
        return int(ranks[block]) + int(held.sum())

    def get(self, i: int) -> int:
        value, shift, p = 0, 0, i
        for k, (chunk, words, _) in enumerate(self.levels):
            value |= int(chunk[p]) << shift
            if not (int(words[p // 64]) >> (p % 64)) & 1:
                return value
            p, shift = self.rank(k, p), shift + self.width
        return value

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1, one rank and one prefix sum a level."""
        out = np.zeros(stop - start, np.uint64)
        at = np.arange(stop - start)
        p, shift = start, 0
        for k, (chunk, words, _) in enumerate(self.levels):
            n = len(at)
            if not n:
                break
            out[at] |= chunk[p : p + n].astype(np.uint64) << np.uint64(shift)
            first = p // 64
            bits = np.unpackbits(words[first : (p + n + 63) // 64].view(np.uint8), bitorder="little")
            more = bits[p - first * 64 : p - first * 64 + n].astype(bool)
            if k + 1 < len(self.levels):
                p = self.rank(k, p)
            at, shift = at[more], shift + self.width
        return out


def write_file(doc_ids: list[int], lengths: list[int], ids: np.ndarray, width: int = 8) -> bytes:
    levels = encode(ids, width)
    parts = [
        MAGIC, struct.pack("<IQBB", len(doc_ids), len(ids), width, len(levels)),
        np.asarray(doc_ids, "<i8").tobytes(), np.concatenate([[0], np.cumsum(lengths, dtype=np.uint64)]).astype("<u8").tobytes(),
    ]
    for chunk, words, ranks in levels:
        parts += [struct.pack("<Q", len(chunk)), chunk.astype(chunk.dtype.newbyteorder("<")).tobytes(), words.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(parts)


def read_file(code: bytes) -> tuple[np.ndarray, np.ndarray, Codes]:
    """Doc ids, starts (one more than documents) and the random-access codes of a file."""
    assert code[:4] == MAGIC, "not a file of token codes"
    n_docs, _, width, n_levels = struct.unpack_from("<IQBB", code, 4)
    at = 4 + struct.calcsize("<IQBB")
    doc_ids = np.frombuffer(code, "<i8", n_docs, at)
    starts = np.frombuffer(code, "<u8", n_docs + 1, at + 8 * n_docs)
    at += 8 * n_docs + 8 * (n_docs + 1)
    levels = []
    for _ in range(n_levels):
        (m,) = struct.unpack_from("<Q", code, at)
        at += 8
        dtype = "<u1" if width <= 8 else "<u2"
        chunk = np.frombuffer(code, dtype, m, at)
        at += chunk.nbytes
        n_words = (m + 63) // 64
        words = np.frombuffer(code, "<u8", n_words, at)
        at += 8 * n_words
        ranks = np.frombuffer(code, "<u4", m // SUPER + 1, at)
        at += ranks.nbytes
        levels.append((chunk, words, ranks))
    return doc_ids, starts, Codes(levels, width)


def write_codes(docs: DataFrame, path: str, block_ids: int = BLOCK_IDS, width: int = 8, vocabulary: str | None = None) -> DataFrame:
    """Write the token ids of all documents, in ascending doc_id, as files at ``path``; return their table."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = byte_bpe(vocabulary)
        held_ids, held_lengths, held_docs, seq, part, within, held = [], [], [], 0, None, 0, 0

        def flush():
            ids = np.concatenate(held_ids)
            code = write_file(held_docs, held_lengths, ids, width)
            return pd.DataFrame({
                "part": [part], "seq": [seq], "within": [within], "n_docs": [len(held_docs)], "n_ids": [len(ids)], "code": [code],
            })

        for pdf in batches:
            part = int(pdf["part"].iloc[0]) if len(pdf) else part
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(encode(text if isinstance(text, str) else ""), END_ID).astype(np.uint32)
                held_ids.append(ids)
                held_lengths.append(len(ids))
                held_docs.append(int(doc_id))
                held += len(ids)
                if held >= block_ids:
                    yield flush()
                    held_ids, held_lengths, held_docs, seq, within, held = [], [], [], seq + 1, within + held, 0
        if held_docs:
            yield flush()

    ordered = docs.select(hide_missing("doc_id"), F.col("text").cast("string").alias("text"))
    # Ranges by id alone: the bounds are sampled on the driver, and texts would go there with them.
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    ordered.mapInPandas(blocks, FILE_COLUMNS).write.parquet(path)
    return docs.sparkSession.read.schema(FILE_COLUMNS).parquet(path)


def read_codes(files: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read back from the files, each document through random access."""
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.alias("part_base"))  # one row a task of the writing job: a bounded broadcast
    placed = files.join(F.broadcast(bases), "part")

    def docs_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for base, code in zip(pdf["part_base"] + pdf["within"], pdf["code"]):
                doc_ids, starts, codes = read_file(bytes(code))
                crcs = [zlib.crc32(codes.range(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                yield pd.DataFrame({
                    "doc_id": doc_ids.astype(np.int64), "start": (starts[:-1] + np.uint64(base)).astype(np.int64),
                    "n_tokens": np.diff(starts).astype(np.int64), "ids_crc32": np.asarray(crcs, np.int64),
                })

    read = placed.select("part_base", "within", "code").mapInPandas(docs_of, DOC_COLUMNS)
    return read.select(show_missing("doc_id"), "start", "n_tokens", "ids_crc32")
