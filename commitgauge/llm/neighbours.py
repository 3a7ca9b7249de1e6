"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a graph of nearest neighbours is cut into balanced partitions, and a small neural classifier
learns where a vector's neighbours lie. Every vector is filed under its most probable partition; a query is sent to
several most probable ones and reranked there by the exact cosine.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commitgauge.llm.common import stored


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled first, so that no square leaves the range."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int, block: int = 128) -> np.ndarray:
    """The k nearest others of every row."""
    found = []
    for i in range(0, len(x), block):
        near = x[i : i + block] @ x.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -2
        found.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    return np.concatenate(found)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, turns: int, rng) -> np.ndarray:
    """A partition of the graph that keeps neighbours together, each part holding 1.1 times its even share at most.

    Starts from nearest seeds; then every node, the most certain first, takes the part that holds most of its
    neighbours and still has room.
    """
    n, room = len(x), int(np.ceil(1.1 * len(x) / parts))
    seeds = [int(rng.integers(n))]
    far = np.full(n, 2.0)
    for _ in range(parts - 1):
        far = np.minimum(far, 1 - x @ x[seeds[-1]])
        seeds.append(int(np.argmax(far)))
    wish = x @ x[seeds].T
    for turn in range(turns + 1):
        sure = np.sort(wish, axis=1)
        left, part = np.full(parts, room), np.zeros(n, np.int64)
        choices = np.argsort(-wish, axis=1, kind="stable")
        for node in np.argsort(sure[:, -2] - sure[:, -1] if parts > 1 else sure[:, 0], kind="stable"):
            for p in choices[node]:
                if left[p]:
                    part[node], left[p] = p, left[p] - 1
                    break
        if turn < turns:
            one = np.eye(parts, dtype=np.float32)[part]
            wish = sum(one[graph[:, j]] for j in range(graph.shape[1])) + 0.5 * one
    return part


def train_router(x: np.ndarray, soft: np.ndarray, hidden: int, steps: int, rng) -> list[np.ndarray]:
    """A classifier with one hidden layer, fitted to the parts of each row's neighbours by Adam on the cross entropy."""
    d, parts = x.shape[1], soft.shape[1]
    w = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), min(512, len(x)))
        h = np.maximum(x[rows] @ w[0] + w[1], 0)
        g = (probabilities(h @ w[2] + w[3]) - soft[rows]) / len(rows)
        gh = (g @ w[2].T) * (h > 0)
        for i, grad in enumerate((x[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad * grad
            w[i] -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return w


def probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def route(w: list[np.ndarray], x: np.ndarray, several: int) -> np.ndarray:
    """The most probable parts of every row, best first; equal ones by number."""
    return np.argsort(-(np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]), axis=1, kind="stable")[:, :several]


def nearest(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k nearest of the rows but itself, exactly; ties go to the smaller id."""
    v, ids = unit(np.stack(rows["v"])), rows["vec_id"].to_numpy()
    out = []
    for i in range(0, len(queries), 256):
        q, own = unit(np.stack(queries["v"].iloc[i : i + 256])), queries["query_id"].to_numpy()[i : i + 256]
        near = q @ v.T
        near[own[:, None] == ids[None, :]] = -9
        least = np.partition(near, -min(k, len(v)), axis=1)[:, -min(k, len(v))]
        for j in range(len(q)):
            at = np.flatnonzero((near[j] >= least[j] - 1e-9) & (near[j] > -5))
            score = (v[at] * q[j]).sum(axis=1)  # row by row, so that equal vectors get equal scores
            best = np.lexsort((ids[at], -score))[:k]
            out.append(pd.DataFrame({"query_id": own[j], "vec_id": ids[at][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, v) with an id and a vector of the most frequent length whose components are all finite, not all 0."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    good = table.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    )
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.filter(F.size("v") == (sizes[0]["n"] if sizes else -1))


def fitted_router(good: DataFrame, sample: int, parts: int, visit: int, seed: int):
    """Partitions and classifier fitted in one executor task on the first ``sample`` vectors in the order of a hash of
    their ids; the driver receives only the weights. Fewer than 8 sampled vectors a part leave one part (no weights)."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [pdf for pdf in batches if len(pdf)]
        few = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({"v": []})
        if len(few) < 8 * parts:
            yield pd.DataFrame({"weights": [b""], "parts": [1]})
            return
        rng = np.random.default_rng(seed)
        x = unit(np.stack(few["v"]))
        graph = neighbour_graph(x, 10)
        part = balanced_partition(x, graph, parts, 8, rng)
        one = np.eye(parts, dtype=np.float32)[part]
        soft = sum(one[graph[:, j]] for j in range(graph.shape[1])) * (0.8 / graph.shape[1]) + one * 0.2
        w = train_router(x, soft, 64, 1500, rng)
        yield pd.DataFrame({"weights": [pickle.dumps([np.asarray(a, np.float64) for a in w])], "parts": [parts]})

    few = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).repartition(1)
    row = few.mapInPandas(fit, "weights binary, parts int").first()
    if row is None or row["parts"] == 1:
        return None, 1, 1
    return pickle.loads(row["weights"]), parts, visit


def search(
    table: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = 8192,
    parts: int = 64,
    visit: int = 44,
    block: int = 4096,
    seed: int = 3,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of the rows for which the column `is_query` is true.

    `sample` bounds the vectors, first in the order of a hash of their ids, on which partitions and classifier are
    fitted, on the driver; every vector is indexed. Both sides of a partition are cut into blocks of about `block`, so
    that no group grows with a hot partition. Vectors that are missing, all zero, of another length than most, or hold a
    missing or infinite component take no part; so do rows without id. Rows of one id are reduced to one. Ties go to the
    smaller id. No vectors give no rows. `visit` is set for vectors without any structure, whose neighbours lie almost
    anywhere; clustered ones need far fewer parts. Fewer than 8 sampled vectors a part leave one part, searched whole.
    """
    good = stored(usable_vectors(table, id_col, vector_col).dropDuplicates(["vec_id"]), "ann-vectors")
    weights, parts, visit = fitted_router(good, sample, parts, visit, seed)

    def placed(several: int):
        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    where = route(weights, unit(np.stack(pdf["v"])), several) if weights else np.zeros((len(pdf), 1), int)
                    yield pdf.assign(part=list(where.astype("int32")))

        return place

    rows = good.mapInPandas(placed(1), "vec_id long, v array<double>, part array<int>")
    rows = stored(rows.withColumn("part", F.get("part", 0)), "ann-index")
    queries = good.filter(is_query).mapInPandas(placed(visit), "vec_id long, v array<double>, part array<int>")
    queries = queries.select(F.col("vec_id").alias("query_id"), "v", F.explode("part").alias("part"))
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / block).alias("blocks"))
    asked = queries.groupBy("part").agg(F.ceil(F.count("*") / block).alias("groups"))
    shape = F.broadcast(sizes.join(asked, "part"))  # a row a partition
    left = queries.join(shape, "part").withColumn("g", F.pmod(F.xxhash64("query_id"), "groups"))
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = rows.join(shape, "part").withColumn("b", F.pmod(F.xxhash64("vec_id"), "blocks"))
    right = right.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))

    def rerank(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return nearest(asking, held, k)

    key = ["part", "b", "g"]
    near = (
        left.select(*key, "query_id", "v").groupBy(*key)
        .cogroup(right.select(*key, "vec_id", "v").groupBy(*key))
        .applyInPandas(rerank, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
