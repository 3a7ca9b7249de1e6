"""Token ids as directly addressable codes: exact round trips, random access, and the defined cases."""

import uuid
import zlib

import numpy as np
import pytest

from commitgauge.llm import token_codes
from commitgauge.llm.common import shared_folder

SCHEMA = "doc_id long, text string, code string, part double"


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def brute(rows):
    """Ids by the tokenizer, documents in ascending doc_id (missing first, ties by text)."""
    t = token_codes.tokenizer()
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] or "")
    out, start = [], 0
    for doc_id, text in sorted(rows, key=key):
        ids = np.append(np.asarray(t.encode(text or "", add_special_tokens=False).ids, np.uint32), 0).astype("<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=lambda r: (r[1], r[0] or 0))


def round_trip(spark, rows, block_ids=token_codes.BLOCK_IDS, width=8):
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], SCHEMA).repartition(3)
    path = f"{shared_folder(spark)}/codes-test-{uuid.uuid4().hex}"
    found = token_codes.read_codes(token_codes.write_codes(docs, path, block_ids, width)).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda r: (r[1], r[0] or 0))


def test_round_trip_of_the_documents(spark, documents):
    rows = list(zip(documents.doc_id.tolist(), documents.text))
    assert round_trip(spark, rows, block_ids=5_000) == brute(rows)


def test_round_trip_edges(spark):
    long = "word " * 100_000 + "<|endoftext|> 😀 é <|endoftext|>x"
    rows = [(5, None), (None, "no id"), (3, ""), (3, "same id"), (3, "same id"), (1, long), (1 << 60, "large"), (None, None)]
    assert round_trip(spark, rows, block_ids=64, width=4) == brute(rows)
    empty = spark.createDataFrame([], SCHEMA)
    path = f"{shared_folder(spark)}/codes-test-{uuid.uuid4().hex}"
    assert token_codes.read_codes(token_codes.write_codes(empty, path)).count() == 0


@pytest.mark.parametrize("width", [3, 8, 16])
def test_random_access_reads_any_id(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 50_257, 20_000).astype(np.uint32)
    ids[rng.integers(0, 20_000, 3_000)] = 0
    ids[::97] = (1 << 31) + 7
    _, starts, codes = token_codes.read_file(token_codes.write_file([1, 2], [7_000, 13_000], ids, width))
    assert list(starts) == [0, 7_000, 20_000]
    for i in rng.integers(0, 20_000, 500):
        assert codes.get(int(i)) == ids[i]
    for a in [0, 1, 511, 512, 513, 1023, 19_999]:
        b = min(20_000, a + int(rng.integers(0, 3_000)))
        assert (codes.range(a, b) == ids[a:b]).all()
    assert (codes.range(0, 20_000) == ids).all() and len(codes.range(5, 5)) == 0
