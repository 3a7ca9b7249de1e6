"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed words. The score adds a weight for each term and, for each pair of terms, the product
of their factor vectors, so that words which offend only together are learned as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgauge.llm.common import hide_missing, show_missing

_FOLD = bytes(c + 32 if 65 <= c <= 90 else (c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32) for c in range(256))


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed words; ASCII letters in lower case, any other ASCII mark but digits parts words."""
    found = set((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)) >> np.uint64(1)).astype(np.int64)


def select_terms(rows: list[np.ndarray], y: np.ndarray, least: int, most: int) -> np.ndarray:
    """The terms, in at least `least` rows, that differ most between the classes by chi square; in sorted order."""
    ids, inverse, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    hits = np.bincount(inverse, np.repeat(y, [len(r) for r in rows]), len(ids))
    share = y.mean()
    chi = (hits - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-9)
    chi[n < least] = -1
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(ids[best[chi[best] >= 4]])


def _lookup(known: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the known terms of all rows, each row led by the constant at position 0; and where rows start."""
    out, starts, at = [], [], 0
    for r in rows:
        i = np.searchsorted(known, r)
        i = i[(i < len(known)) & (known[np.minimum(i, len(known) - 1)] == r)] if len(known) else i[:0]
        out += [np.zeros(1, np.int64), i + 1]
        starts.append(at)
        at += 1 + len(i)
    return np.concatenate(out), np.array(starts)


def machine(w: np.ndarray, v: np.ndarray, ids: np.ndarray, starts: np.ndarray):
    """Scores of rows of term positions, with what the gradient needs: sum of w + half of (sum of v)^2 - sum of v^2."""
    f = v[ids]
    s = np.add.reduceat(f, starts)
    z = np.add.reduceat(w[ids], starts) + 0.5 * (s * s - np.add.reduceat(f * f, starts)).sum(axis=1)
    return z, f, s


def fit(rows: list[np.ndarray], y: np.ndarray, factors: int, epochs: int, most_terms: int, seed: int, weight: float = 3.0):
    """Terms, weights and factors, by Adagrad on the logistic loss with shrinking; toxic rows count `weight` times."""
    rng = np.random.default_rng(seed)
    known = select_terms(rows, y, 3, most_terms) if rows else np.empty(0, np.int64)
    w, v = np.zeros(len(known) + 1), rng.normal(0, 0.02, (len(known) + 1, factors))
    v[0] = 0
    gw, gv = np.full_like(w, 0.1), np.full_like(v, 0.1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.01
    w[0] = np.log(share / (1 - share))
    for _ in range(epochs if len(rows) else 0):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            ids, starts = _lookup(known, [rows[i] for i in part])
            z, f, s = machine(w, v, ids, starts)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * np.where(y[part] > 0, weight, 1.0)
            size = np.diff(np.append(starts, len(ids)))
            each = np.repeat(g, size)
            dw = np.bincount(ids, each, len(w)) + 1e-3 * (np.bincount(ids, minlength=len(w)) > 0) * w
            dv = np.zeros_like(v)
            np.add.at(dv, ids, each[:, None] * (np.repeat(s, size, axis=0) - f))
            dv += 1e-3 * v
            dv[0] = 0
            gw += dw * dw
            gv += dv * dv
            w -= 0.3 * dw / np.sqrt(gw)
            v -= 0.05 * dv / np.sqrt(gv)
    return known, w, v


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    may_learn,
    max_rows: int = 20_000,
    factors: int = 8,
    epochs: int = 10,
    most_terms: int = 16_384,
    threshold: float = 0.7,
    seed: int = 9,
) -> DataFrame:
    """Rows (doc_id, score, predicted) of every row of `docs`.

    Learns from the labelled rows, (doc_id, toxic), for which the column `may_learn` of doc_id is true; at most
    `max_rows` of them, first in the order of a hash of the id. The model is fitted in one task on that bounded sample
    and holds at most `most_terms` terms. A text without known terms, missing or empty ones included, gets the base
    rate. Labels that are missing or neither 0 nor 1 are passed over; of several for an id the highest counts. Repeated
    rows are scored alike; a missing id stays missing; without labels every score is the same low rate.
    """
    chosen = labels.filter(may_learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    base = docs.select(hide_missing("doc_id"), "text")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "t": [terms(x) for x in pdf["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        pdf = pd.concat(held).sort_values("doc_id", kind="stable") if held else pd.DataFrame({"t": [], "toxic": []})
        known, w, v = fit(list(pdf["t"]), pdf["toxic"].to_numpy(np.float64), factors, epochs, most_terms, seed)
        yield pd.DataFrame({"known": [known.tobytes()], "w": [w.tobytes()], "v": [v.tobytes()]})

    labelled = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # max_rows rows of two numbers
    labelled = labelled.mapInPandas(featured, "doc_id long, toxic int, t array<long>").repartition(1)
    row = labelled.mapInPandas(learn, "known binary, w binary, v binary").first()
    known, w = np.frombuffer(row["known"], np.int64), np.frombuffer(row["w"], np.float64)
    v = np.frombuffer(row["v"], np.float64).reshape(len(w), factors)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                z, _, _ = machine(w, v, *_lookup(known, [terms(x) for x in pdf["text"]]))
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    scored = base.mapInPandas(score, "doc_id long, score double").withColumn("doc_id", show_missing("doc_id"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
