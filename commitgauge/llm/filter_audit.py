"""Filter interaction audit: which documents each of five filters removes, in every order of the filters.

The exact-copy filter is an existential self-join: a left-semi join on the digest, the exact text and a smaller
doc_id. Its ids are united with those of the other filters' failures, every row gets the bit combination of the
filters it fails, and rows are counted per part and combination. Every count of an order and step follows from those
at most 32 combinations a part, so the 120 orders cost nothing that grows with the table.

Defined cases: a missing text is empty (no words: fails A, passes B, C and D; an empty text is a copy of an earlier
empty one). A missing lang is the part ''. A row without doc_id is never a copy (no id is smaller) nor the earlier
one of a copy. Repeated rows are each a document. A document is good (toxic) when any of its rows in ``labels`` has
quality (toxic) 1. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitgauge.llm.common import words

# Fixed values of the audit: the five filters' letters and their bounds.
LETTERS = "ABCDE"
FEWEST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 3
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Every order of the filters, with each step's filter bit and the bits of the filters before it (600 rows).
ORDERS = [
    ("".join(order), step + 1, 1 << LETTERS.index(order[step]), sum(1 << LETTERS.index(x) for x in order[:step]))
    for order in permutations(LETTERS)
    for step in range(len(LETTERS))
]


def failures(docs: DataFrame) -> DataFrame:
    """Per distinct (doc_id, text digest, part) of ``docs``: the bit combination ``mask`` of the filters its rows fail
    (bit k: letter k of ``LETTERS``) and ``rows``, how many rows of the input it stands for."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w = words(F.col("text"))
    keys = [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("h"),
    ]
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    measured = docs.select(
        *keys, F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), capitals.alias("capitals"),
        F.length(text).alias("points"), text.rlike(SYMBOLS).alias("symbol"),
    )
    plain = measured.select(
        "doc_id",
        "h",
        "part",
        (
            F.when(F.col("n") < FEWEST_WORDS, 1).otherwise(0)
            + F.when(100 * F.col("distinct") < DISTINCT_PERCENT * F.col("n"), 2).otherwise(0)
            + F.when(100 * F.col("capitals") > CAPITALS_PERCENT * F.col("points"), 4).otherwise(0)
            + F.when(F.col("symbol"), 8).otherwise(0)
        ).alias("bits"),
        F.lit(1).alias("row"),
    )
    # E: a row whose text stands under a smaller doc_id; the witness of each text is its smallest id. The text is
    # shuffled once, by digest: the witnesses and the semi-join both keep that partitioning. Texts are compared outside
    # the join keys for that reason. A group of copies is one key; its task streams it against a single witness.
    texts = docs.select(*keys, text.alias("t")).filter("doc_id is not null").repartition("h")
    first = texts.groupBy("h", "t").agg(F.min("doc_id").alias("first"))
    x, y = texts.alias("x"), first.alias("y")
    same_text = ~(F.col("x.t") < F.col("y.t")) & ~(F.col("x.t") > F.col("y.t"))
    copies = x.join(y, (F.col("x.h") == F.col("y.h")) & same_text & (F.col("y.first") < F.col("x.doc_id")), "left_semi")
    copies = copies.select("doc_id", "h", "part", F.lit(16).alias("bits"), F.lit(0).alias("row"))
    # Repeated rows of one id and text fail the same filters: they are one key standing for several rows.
    ids = plain.unionByName(copies)
    return ids.groupBy("doc_id", "h", "part").agg(F.bit_or("bits").alias("mask"), F.sum("row").alias("rows"))


def _labelled(labels: DataFrame, name: str) -> Column:
    return F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(name)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): per part
    and order of the five filters applied left to right, the documents each step keeps and removes; ``shapley`` is what
    the step's filter removes summed over all 120 orders, wherever it stands."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    marks = marks.filter("doc_id is not null").groupBy("doc_id").agg(_labelled(marks, "quality"), _labelled(marks, "toxic"))
    found = failures(docs).join(marks, "doc_id", "left")
    good, toxic = F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    combos = found.groupBy("part", "mask", good, toxic).agg(F.sum("rows").alias("count"))
    steps = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(s).alias("s"), F.lit(b).alias("b"), F.lit(p).alias("p")) for o, s, b, p in ORDERS))
    each = combos.select("part", "mask", "good", "toxic", "count", F.explode(steps).alias("x"))
    fails = (F.col("mask").bitwiseAND(F.col("x.b")) != 0)
    earlier = (F.col("mask").bitwiseAND(F.col("x.p")) != 0)
    removed = fails & ~earlier

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("count")).otherwise(0)).cast("long").alias(name)

    counted = each.groupBy("part", F.col("x.o").alias("filter_order"), F.col("x.s").cast("int").alias("step"), F.col("x.b").alias("bit")).agg(
        total(F.col("mask").bitwiseAND(F.col("x.b") + F.col("x.p")) == 0, "kept"),
        total(removed, "removed"),
        total(fails & earlier, "redundant"),
        total(F.col("mask") == F.col("x.b"), "unique_fails"),
        total(removed & (F.col("good") == 1), "good_lost"),
        total(removed & (F.col("toxic") == 1), "toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit")).cast("long")
    return counted.withColumn("shapley", shapley).drop("bit")
