"""MinHash near-duplicates with sequential Bayesian verification.

Signatures are cut into bands; documents that agree in a band are candidates. A candidate pair is compared batch by
batch: after n hashes with m agreements its similarity has the posterior Beta(m + 1, n - m + 1), and the pair is given
up as soon as the probability of reaching the threshold falls below `miss`. Survivors are verified on full sets.

Joins whose sides grow with the corpus are sort-merge joins at every size, so that small inputs show the plan of large
ones. Signatures keep 8 bits a hash: unequal ones agree by chance once in 256, which only makes the bounds looser.

A document that leads many others, and a group of many copies, is cut into slices before it is joined.

Buckets never emit their pairs. Every document of a bucket is compared with one leader, the hub; linked ones become one
component. Only hubs that still see several components go on: their documents are compared across components within
tasks of bounded size, and only pairs that the bounds keep leave such a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgauge.llm.common import hide_missing, plain_words, show_missing, stored
from commitgauge.llm.graph import components
from commitgauge.operators.joins import hot_join

ROWS, BANDS, BATCH = 5, 48, 48
#: Most documents and about the most shingles in a block of a region.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19


def shingles(words: list[bytes], width: int) -> set:
    """Distinct runs of `width` words; the whole text if it is shorter; nothing without words."""
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """Smallest value of each permutation over the hashes, a block of shingles at a time."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(x), block):
        values = np.multiply.outer(a, x[i : i + block])
        values += b[:, None]
        np.minimum(low, values.min(axis=1), out=low)
    return low


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest agreements of n hashes whose posterior, from a flat prior, still gives the threshold a chance of `miss`.

    P(similarity >= t | m of n) of Beta(m + 1, n - m + 1) is the binomial probability of at most m of n + 1 at t.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def bayes_survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float, batch: int) -> np.ndarray:
    """Positions of the signature pairs that no batch has given up."""
    alive = np.arange(len(a))
    agreed = np.zeros(len(a), np.int64)
    for done in range(0, a.shape[1], batch):
        end = min(done + batch, a.shape[1])
        agreed += (a[alive, done:end] == b[alive, done:end]).sum(axis=1)
        keep = agreed >= least_matches(end, threshold, miss)
        alive, agreed = alive[keep], agreed[keep]
    return alive


def signed(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Rows (doc_id, key, n_shingles, bands, sig): digest of the words, size of the set, band hashes, 8 bits a hash."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = permutations(ROWS * BANDS, seed)
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                w = plain_words(text)
                hashes = shingle_hashes(w, width)
                key = hashlib.md5(b" ".join(w)).digest()
                if len(hashes):
                    sig = signature(hashes, a, b)
                    bands = [
                        xxhash.xxh3_64_intdigest(sig[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63)
                        for i in range(BANDS)
                    ]
                    rows.append((key, len(hashes), bands, sig.astype(np.uint8).tobytes()))
                else:
                    rows.append((key, 0, [], b""))
            out = pd.DataFrame(rows, columns=["key", "n_shingles", "bands", "sig"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return docs.mapInPandas(sign, "doc_id long, key binary, n_shingles long, bands array<long>, sig binary")


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(len(column), ROWS * BANDS)


def _led(pairs: DataFrame) -> DataFrame:
    """Pairs of every leader."""
    return pairs.groupBy("a").agg(F.count("*").alias("n"))


def _likely(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """Pairs (a, b) that the Bayesian bounds keep."""

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = _signatures(pdf["sa"]), _signatures(pdf["sb"])
                yield pdf.iloc[bayes_survivors(x, y, threshold, miss, BATCH)][["a", "b"]]

    sa = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"))
    sb = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    total = pairs.count()
    met = hot_join(pairs, sa, "a", ["b"], _led(pairs), total)
    kept = met.join(sb.hint("merge"), "b").mapInPandas(prune, "a long, b long")
    return stored(kept.distinct(), "dedup-likely", total)


def reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two sets, as sorted distinct hashes, have the Jaccard similarity."""
    if min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and both >= threshold * (len(x) + len(y) - both)


def _confirmed(likely: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for pdf in batches:
            good = []
            for a, ta, tb in zip(pdf["a"], pdf["ta"], pdf["tb"]):
                if (a, ta) != last[0]:
                    last = ((a, ta), shingle_hashes(plain_words(ta), width))
                good.append(reaches(last[1], shingle_hashes(plain_words(tb), width), threshold))
            yield pdf.loc[good, ["a", "b"]]

    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    met = hot_join(likely.join(tb.hint("merge"), "b"), ta, "a", ["b"], _led(likely), likely.count())
    return met.mapInPandas(confirm, "a long, b long").distinct()


def _across(
    met: DataFrame, labels: DataFrame, sigs: DataFrame, texts: DataFrame, width: int, threshold: float, miss: float
) -> DataFrame:
    """Links between two components within the documents that met one hub, apart from those with the hub itself.

    A region is cut into blocks of at most about BLOCK documents and BLOCK_SHINGLES shingles; each pair of blocks is one
    group, so no group exceeds two blocks. Pairs already joined are passed over, and only links leave a group.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, ids, part = _signatures(pdf["sig"]), pdf["doc_id"].to_numpy(), pdf["block"].to_numpy()
        comp, text = pdf["component"].to_numpy().copy(), pdf["text"].to_numpy()
        hub, i, j = pdf["hub"].iloc[0], pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        sets: dict[int, np.ndarray] = {}
        found = []

        def full(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingle_hashes(plain_words(text[k]), width)
            return sets[k]

        for at in left:
            if ids[at] == hub:
                continue
            to = right[(comp[right] != comp[at]) & (ids[right] != hub)]
            to = to[ids[to] > ids[at]] if i == j else to
            if len(to):
                both = np.broadcast_to(sig[at], (len(to), sig.shape[1]))
                to = to[bayes_survivors(both, sig[to], threshold, miss, BATCH)]
            for k in to:
                if comp[k] != comp[at] and reaches(full(at), full(k), threshold):
                    comp[comp == comp[k]] = comp[at]
                    found.append((min(ids[at], ids[k]), max(ids[at], ids[k])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    placed = met.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id")).join(
        sigs.select("doc_id", "n_shingles", "sig").hint("merge"), "doc_id"
    )
    sizes = placed.groupBy("hub").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    still = sizes.filter("n > 1 and lo <> hi").select(
        "hub", "n", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("s") / BLOCK_SHINGLES)).alias("blocks")
    )
    opened = hot_join(placed, still.drop("n"), "hub", ["doc_id"], still, met.count()).join(texts.hint("merge"), "doc_id")
    opened = opened.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks")).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    dealt = opened.select(
        "hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "doc_id", "component", "block", "sig", "text",
    )
    return dealt.groupBy("hub", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.75,
    miss: float = 1e-6,
    seed: int = 11,
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of every row of `docs`; other columns are ignored.

    Two texts are linked if their sets of `width`-word shingles reach the Jaccard similarity `threshold`, which must be
    0.5 or more; component_id is the smallest id reachable over links, kept marks the row with that id. Texts of equal
    words are one node. A missing, empty or blank text has no shingles and no links. Rows that share an id are judged
    by their own texts. A row without id is kept alone, with component_id NULL. An empty table gives an empty one.
    With 48 bands of 5 hashes a pair at 0.75 is missed with probability 2e-6, one at 0.85 with 2e-13.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("doc_id", hide_missing("doc_id"))
    rows = signed(base, width, seed).withColumn("doc_id", show_missing("doc_id"))
    rows = stored(rows, "dedup-signatures")
    nodes = rows.filter("n_shingles > 0 and doc_id is not null")
    alike = (F.first(c).alias(c) for c in ("n_shingles", "bands", "sig"))  # copies have the same
    copies = nodes.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), *alike)
    copies = stored(copies, "dedup-nodes")
    sigs = copies.drop("key", "n")
    n_bands = BANDS * sigs.count()

    bands = sigs.select("doc_id", F.explode("bands").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    hubs = stored(hubs, "dedup-hubs", n_bands)
    met = hot_join(bands, hubs.drop("n"), "key", ["doc_id"], hubs, n_bands).filter("doc_id <> hub")
    pairs = stored(met.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "dedup-pairs", n_bands)
    met = pairs.select(F.col("a").alias("hub"), F.col("b").alias("doc_id"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = base.filter("text is not null").join(wanted.hint("merge"), "doc_id", "left_semi")
    texts = stored(texts, "dedup-texts")
    likely = _likely(pairs, sigs, threshold, miss)
    links = stored(_confirmed(likely, texts, width, threshold), "dedup-links", likely.count())
    labels = stored(components(links, "dedup-components"), "dedup-labels", 2 * links.count())
    across = _across(met, labels, sigs, texts, width, threshold, miss)
    links = stored(links.union(across), "dedup-links", pairs.count())
    labels = stored(components(links, "dedup-components"), "dedup-labels", 2 * links.count())

    classes = copies.select("key", F.col("doc_id").alias("node")).join(labels.hint("merge"), "node", "left")
    classes = classes.select("key", F.coalesce("component", "node").alias("class"))
    plain = rows.select("doc_id", "key", "n_shingles")
    result = hot_join(nodes.select(plain.columns), classes, "key", ["doc_id"], copies, rows.count())
    alone = plain.filter("n_shingles = 0 or doc_id is null").withColumn("class", F.col("doc_id"))
    result = result.unionByName(alone).withColumnRenamed("class", "component_id")
    return result.select("doc_id", "n_shingles", "component_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
