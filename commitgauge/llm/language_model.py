"""Scores from a log-bilinear neural language model, trained in numpy with noise-contrastive estimation.

The model predicts the class of a token from the two tokens before it: the most frequent words are classes of their
own, all others fall into classes by their endings. A context adds the vectors of its two tokens, and a class is
scored by its inner product with that sum; all contexts together are normalised by batched matrix products. Within a
class a word has its smoothed share of the counts, so every token has a normalised probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgauge.llm.common import hide_missing, plain_words, show_missing, stored

#: The end of a text: no word holds a blank.
END = b" end"
#: Most words whose hash and class a task keeps at once.
CACHED = 1 << 20
#: About how many tokens are scored together in one array.
SCORED = 1 << 17


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def ending(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


class Vocabulary:
    """The classes: 0 to tops-1 are the most frequent tokens, the rest endings. `known` are hashes in sorted order."""

    def __init__(self, known, counts, tops, endings, total, distinct, mass):
        self.known, self.counts, self.endings = known, counts, endings
        self.total, self.distinct, self.mass = total, distinct, mass
        self.tops = len(tops)
        self.classes = self.tops + endings
        self.top_class = {int(h): i for i, h in enumerate(tops)}
        self.cache: dict[bytes, tuple[int, int]] = {}

    def code(self, token: bytes) -> tuple[int, int]:
        """Hash and class of a token, kept in a cache of at most CACHED words that a task fills as it reads."""
        h = word_hash(token)
        c = self.top_class.get(h, -1)
        found = (h, c if c >= 0 else self.tops + zlib.crc32(token[-3:]) % self.endings)
        if len(self.cache) >= CACHED:
            self.cache.clear()
        self.cache[token] = found
        return found

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and classes of the tokens; a frequent word is hashed once a task, not once a use."""
        found = list(map(self.cache.get, tokens))
        for i, pair in enumerate(found):
            if pair is None:
                found[i] = self.cache.get(tokens[i]) or self.code(tokens[i])
        hashes, classes = zip(*found) if found else ((), ())
        return np.array(hashes, np.int64), np.array(classes, np.int64)

    def contexts(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes one and two tokens before each; before the text stands a class of its own."""
        led = np.concatenate([np.full(2, self.classes), classes])
        return led[1:-1], led[:-2]


def initial(classes: int, size: int, seed: int, share: np.ndarray) -> list[np.ndarray]:
    """Vectors of the token before, of the one before that, of the predicted class, and its bias."""
    rng = np.random.default_rng(seed)
    draw = lambda n: rng.normal(0, 0.1, (n, size)).astype(np.float32)
    return [draw(classes + 1), draw(classes + 1), draw(classes), np.log(share).astype(np.float32)]


def _summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each index."""
    d = rows.shape[1]
    flat = (index[:, None] * d + np.arange(d)).ravel()
    return np.bincount(flat, rows.ravel(), n * d).reshape(n, d).astype(np.float32)


def nce_step(p, acc, one, two, target, noise, log_kq, rate: float) -> None:
    """One Adagrad step of noise-contrastive estimation; all tokens of the batch share the noise classes."""
    q = p[0][one] + p[1][two]
    up = 1 / (1 + np.exp(np.clip((q * p[2][target]).sum(1) + p[3][target] - log_kq[target], -30, 30)))
    down = -1 / (1 + np.exp(-np.clip(q @ p[2][noise].T + p[3][noise] - log_kq[noise], -30, 30)))
    up, down = up.astype(np.float32), down.astype(np.float32)
    gq = up[:, None] * p[2][target] + down @ p[2][noise]
    gr = _summed(target, up[:, None] * q, len(p[2])) + _summed(noise, down.T @ q, len(p[2]))
    gb = np.bincount(target, up, len(p[3])) + np.bincount(noise, down.sum(0), len(p[3]))
    for i, g in enumerate((_summed(one, gq, len(p[0])), _summed(two, gq, len(p[1])), gr, gb.astype(np.float32))):
        g /= len(target)
        acc[i] += g * g
        p[i] += rate * g / np.sqrt(acc[i])


def log_normalisers(p: list[np.ndarray], block: int = 64) -> np.ndarray:
    """Log of the sum over classes for every pair of contexts, as batched matrix products."""
    n = len(p[0])
    out = np.empty((n, n), np.float32)
    for i in range(0, n, block):
        q = (p[0][i : i + block, None, :] + p[1][None, :, :]).reshape(-1, p[0].shape[1])
        z = q @ p[2].T + p[3]
        top = z.max(axis=1, keepdims=True)
        out[i : i + block] = (np.log(np.exp(z - top).sum(axis=1)) + top[:, 0]).reshape(-1, n)
    return out


def counted(texts: DataFrame, endings: int) -> DataFrame:
    """Rows (h, ending, n) of all tokens, ends of texts included; a task hands on what it counted now and then."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def handed() -> pd.DataFrame:
            rows = [(word_hash(w), ending(w, endings), n) for w, n in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["h", "ending", "n"])

        for pdf in batches:
            for text in pdf["text"]:
                held.update(plain_words(text))
                held[END] += 1
            if len(held) > 300_000:
                yield handed()
        if held:
            yield handed()

    parts = texts.select("text").mapInPandas(count, "h long, ending int, n long")
    return parts.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, tops: int, shortlist: int, endings: int) -> Vocabulary:
    """The bounded part of the counts that every task holds: at most `shortlist` words, by hash.

    Its least count comes from the counts of counts, so nothing is sorted whole.
    """
    of_counts = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    least, held, total, distinct = None, 0, 0, 0
    for n, number in of_counts.toPandas().itertuples(index=False):
        held += int(number)
        total, distinct = total + int(n) * int(number), distinct + int(number)
        if held <= shortlist or least is None:
            least = int(n)
    few = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(shortlist).toPandas()
    few = few.sort_values(["n", "h"], ascending=[False, True]).reset_index(drop=True)
    top = few.head(tops)
    sums = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    mass = np.full(endings, 0.5)
    for e, n, number in sums.itertuples(index=False):
        mass[int(e)] += n + 0.5 * number
    for e, n in zip(top["ending"], top["n"]):
        mass[int(e)] -= n + 0.5
    order = np.argsort(few["h"].to_numpy(np.int64))
    known, n = few["h"].to_numpy(np.int64)[order], few["n"].to_numpy(np.int64)[order]
    full = np.concatenate([top["n"].to_numpy(np.float64) + 0.5, mass])
    return Vocabulary(known, n, top["h"].tolist(), endings, total, distinct, full)


def trained(texts: DataFrame, voc: Vocabulary, size: int, rounds: int, noise: int, batch: int, seed: int) -> list:
    """Parameters after `rounds` of local training and weighted averaging; each round takes its own share of the texts,
    together all of them. Partial sums meet by two levels of groups, so no task gets those of all others."""
    share = voc.mass / voc.mass.sum()
    p = initial(voc.classes, size, seed, share)
    cuts = np.cumsum([a.size for a in p])[:-1]
    log_kq = np.log(noise * share).astype(np.float32)

    def local(now: list[np.ndarray], turn: int):
        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine, acc = [a.copy() for a in now], [np.full_like(a, 2e-5) for a in now]
            rng = np.random.default_rng(seed + turn)
            held: list[tuple] = []
            waiting = seen = 0

            def train(last: bool) -> None:
                nonlocal waiting, seen
                target, one, two = (np.concatenate(x) for x in zip(*held))
                held.clear()
                order = rng.permutation(len(target))
                for i in range(0, len(order), batch):
                    at = order[i : i + batch]
                    drawn = rng.choice(voc.classes, noise, p=share)
                    nce_step(mine, acc, one[at], two[at], target[at], drawn, log_kq, 0.05)
                seen, waiting = seen + len(target), 0

            for pdf in batches:
                for text in pdf["text"]:
                    _, classes = voc.encode([*plain_words(text), END])
                    held.append((classes, *voc.contexts(classes)))
                    waiting += len(classes)
                    if waiting >= 64 * batch:
                        train(False)
            if held:
                train(True)
            if seen:
                flat = np.concatenate([a.ravel() for a in mine]).astype(np.float64) * seen
                yield pd.DataFrame({"p": [flat.tobytes()], "w": [float(seen)]})

        return learn

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["p"])
        return pd.DataFrame({"p": [total.tobytes()], "w": [pdf["w"].sum()]})

    for turn in range(rounds):
        mine = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(rounds)) == turn).select("text")
        parts = mine.mapInPandas(local(p, turn), "p binary, w double")
        parts = parts.withColumn("g", F.spark_partition_id() % 64).groupBy("g").applyInPandas(add, "p binary, w double")
        whole = parts.groupBy().applyInPandas(add, "p binary, w double").first()
        if whole:
            flat = np.frombuffer(whole["p"]) / whole["w"]
            p = [a.reshape(b.shape).astype(np.float32) for a, b in zip(np.split(flat, cuts), p)]
    return p


def language_scores(
    docs: DataFrame,
    may_learn,
    tops: int = 256,
    shortlist: int = 1 << 18,
    endings: int = 128,
    size: int = 16,
    rounds: int = 2,
    noise: int = 32,
    batch: int = 2048,
    seed: int = 17,
) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`; other columns are
    ignored.

    Counts and training take all texts for which the column `may_learn` is true. Scores are log10 probabilities of the
    text with its end: base_score by smoothed word counts, score by the model. A missing or empty text is its end alone.
    Every task holds `shortlist` words at most, by their hashes; the counts of all others are joined by hash. Rows are
    summed by a key of their own, so rows that share an id stay apart; a missing id stays missing. Without training
    texts all tokens are equally likely.
    """
    base = docs.select(hide_missing("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    learning = docs.filter(may_learn).select(hide_missing("doc_id"), "text")
    counts = stored(counted(learning, endings), "lm-counts")
    voc = vocabulary(counts, tops, shortlist, endings)
    p = trained(learning, voc, size, rounds, noise, batch, seed)
    normaliser = log_normalisers(p)
    rest = np.log10(voc.total + 0.5 * (voc.distinct + 1))
    log_mass, tenth = np.log10(voc.mass), np.log(10)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n_of = voc.known, np.log10(voc.counts + 0.5)
        for pdf in batches:
            texts = [[*plain_words(text), END] for text in pdf["text"]]
            rows, ids = pdf["row"].to_numpy(), pdf["doc_id"].to_numpy()
            first = 0
            while first < len(texts):  # texts together, about SCORED tokens at a time
                last, held = first, 0
                while last < len(texts) and (last == first or held + len(texts[last]) <= SCORED):
                    held, last = held + len(texts[last]), last + 1
                yield from _scored(texts[first:last], rows[first:last], ids[first:last], known, n_of)
                first = last

    def _scored(texts, rows, ids, known, n_of):
        """Model and count scores of some texts, with their tokens in one array."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        hashes, classes = voc.encode([t for tokens in texts for t in tokens])
        place = np.arange(len(classes)) - np.repeat(starts, lengths)
        one = np.where(place >= 1, np.roll(classes, 1), voc.classes)
        two = np.where(place >= 2, np.roll(classes, 2), voc.classes)
        z = ((p[0][one] + p[1][two]) * p[2][classes]).sum(1) + p[3][classes] - normaliser[one, two]
        model = np.add.reduceat(z.astype(np.float64), starts) / tenth - np.add.reduceat(log_mass[classes], starts)
        if len(known):
            where = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            met = known[where] == hashes
            own = np.add.reduceat(np.where(met, n_of[where], 0.0), starts)
        else:
            met, own = np.zeros(len(hashes), bool), np.zeros(len(texts))
        n_known = np.add.reduceat(met.astype(np.int64), starts)
        yield pd.DataFrame({
            "row": rows, "doc_id": ids, "h": -rows - 1, "tf": 0, "n_tokens": lengths, "n_known": n_known,
            "base": own - lengths * rest, "model": model + own,
        })
        if not met.all():
            text = np.repeat(np.arange(len(texts)), lengths)[~met]
            h = hashes[~met]
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])])
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, len(h)))
            yield pd.DataFrame({
                "row": rows[text[at]], "doc_id": ids[text[at]], "h": h[at], "tf": tf, "n_tokens": 0, "n_known": 0,
                "base": 0.0, "model": 0.0,
            })

    schema = "row long, doc_id long, h long, tf long, n_tokens long, n_known long, base double, model double"
    parts = base.mapInPandas(score, schema)
    met = parts.join(counts.select("h", F.col("n").alias("c")), "h", "left")
    gain = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    found = F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)
    result = met.groupBy("row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + found).alias("n_known"),
        F.lit(voc.total).cast("long").alias("train_tokens"),
        F.sum(F.col("base") + gain).alias("base_score"),
        F.sum(F.col("model") + gain).alias("score"),
    )
    return result.drop("row").withColumn("doc_id", show_missing("doc_id"))
