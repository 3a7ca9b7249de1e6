"""Multinomial naive Bayes over word counts, as grouped counts and a join with a model of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_A_WORD = r"[^\p{L}\p{N}]+"
#: Stands for the prior; no word is empty.
PRIOR = ""


def words(text: Column) -> Column:
    """Words of letters and digits in lower case; none for a missing text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), lambda w: w != "")


def train_naive_bayes(
    examples: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 12, smoothing: float = 1.0
) -> DataFrame:
    """Rows (word, weights) of the ``features`` most frequent words, and the prior under the empty word.

    ``weights`` holds (label, weight) of every label: the logarithm of the smoothed share of the word among the kept
    words of the label. All labelled rows are counted, before anything moves to one count per label and word. The
    model has at most ``features`` + 1 rows, each as long as there are labels.
    """
    known = examples.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
    counts = known.select("label", F.explode(words(F.col("text"))).alias("word")).groupBy("label", "word").agg(
        F.count(F.lit(1)).alias("n")
    )
    kept = counts.groupBy("word").agg(F.sum("n").alias("_all")).orderBy(F.desc("_all"), "word").limit(features)
    counted = counts.join(F.broadcast(kept.select("word")), "word")
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    totals = sizes.join(counted.groupBy("label").agg(F.sum("n").alias("words")), "label", "left")
    labels = totals.agg(
        F.sort_array(F.collect_list(F.struct("label", "docs", F.coalesce("words", F.lit(0)).alias("words")))).alias("labels"),
        F.sum("docs").alias("docs"),
    )
    per_word = counted.groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by_label")
    ).withColumn("labels", labels.select("labels").scalar()).withColumn("size", kept.agg(F.count(F.lit(1))).scalar())

    def weight(one: Column) -> Column:
        n = F.coalesce(F.element_at("by_label", one["label"]), F.lit(0)) + smoothing
        return F.struct(one["label"].alias("label"), F.log(n / (one["words"] + F.col("size") * smoothing)).alias("weight"))

    def prior(one: Column) -> Column:
        return F.struct(one["label"].alias("label"), F.log(one["docs"] / F.col("docs")).alias("weight"))

    return per_word.select("word", F.transform("labels", weight).alias("weights")).union(
        labels.select(F.lit(PRIOR), F.transform("labels", prior))
    )


def classify(model: DataFrame, df: DataFrame, id_: str, text: str = "text", into: str = "predicted") -> DataFrame:
    """Rows (id, label): the likeliest label of every text; of equal ones, the last in order.

    The model is broadcast: its rows are bounded by ``features`` of the training. Texts stay where they are; one sum
    per id and label moves. Ids have to be unique.
    """
    tokens = df.select(F.col(id_), F.explode(F.array_append(words(F.col(text)), F.lit(PRIOR))).alias("word"))
    weighed = tokens.join(F.broadcast(model), "word").select(id_, F.inline("weights"))
    sums = weighed.groupBy(id_, "label").agg(F.round(F.sum("weight"), 6).alias("_sum"))
    return sums.groupBy(id_).agg(F.max_by("label", F.struct("_sum", "label")).alias(into))
