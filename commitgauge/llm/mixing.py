"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitgauge.llm.common import WORD, stored, words


def water_fill(sources: DataFrame, most_epochs: int = 3, total: float = 1.0) -> DataFrame:
    """Adds (target, capped) to rows with a source's size and weight, one row a source.

    Sources reach their cap of `most_epochs` times their size in the order of cap over weight. Walking in that order,
    a source is capped if its cap lies at or under the level that what is left gives those not yet capped; the others
    share the rest by weight. That is where resharing step by step comes to rest. `total` is the share of all sizes
    that the mix takes, at most `most_epochs`. The window runs over one row a source.
    """
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    caps = sources.withColumn("cap", F.col("source_size") * most_epochs).withColumn(
        "ratio", F.col("cap").cast("double") / F.col("weight")
    )
    walked = caps.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(total))).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    level = (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    walked = walked.withColumn("capped", F.col("ratio") <= level)
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    rest = F.col("weight") * ((F.col("all_size") - used) / free)
    return walked.withColumn(
        "target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest)
    ).drop("cap", "ratio", "all_size", "all_weight", "cap_before", "weight_before")


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3, seed: str = "mix", label: str = "mix"
) -> DataFrame:
    """Rows (doc_id, size, source, source_size, target, taken) of every row of `docs`.

    Sources in the order of code points, a missing one last, weigh `weights`, repeating. Each document is taken as
    often as its source's whole epochs say; the fraction left is filled in the order of md5(seed:doc_id), the document
    at its edge in part. So a source's words come to its rounded target. A missing, blank or empty text has size 0 and
    is taken 0 times; rows that share an id are apart and count by themselves; an empty table gives an empty one. A hot
    source is summed and numbered in 4,096 ranges of that order. Other columns are ignored.
    """
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))).alias("h"),
    )
    rows = rows.withColumn("no_source", F.col("source").isNull()).withColumn(
        "source_key", F.coalesce("source", F.lit(""))
    )
    rows = stored(rows.withColumn("part", F.substring("h", 1, 3)), label)
    key = ["no_source", "source_key"]
    parts = rows.groupBy(*key, "part").agg(F.sum("size").alias("part_size"))
    sources = parts.groupBy(*key).agg(F.sum("part_size").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(Window.orderBy(*key)))
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    sources = water_fill(sources.withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights))), most_epochs)
    whole = F.when(F.col("capped"), F.lit(most_epochs).cast("long")).otherwise(
        F.floor(F.col("target") / F.col("source_size"))
    )
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(F.lit(0).cast("long")))
    part_left = F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size")
    sources = sources.withColumn("part_left", F.when(F.col("capped"), F.lit(0).cast("long")).otherwise(part_left))
    order = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(order), F.lit(0)))
    parts = parts.join(sources.drop("rank", "weight", "capped"), key)
    within = Window.partitionBy(*key, "part").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(parts, [*key, "part"])
    extra = F.greatest(
        F.lit(0).cast("long"), F.least(F.col("size"), F.col("part_left") - F.col("ahead") - F.col("before"))
    )
    return met.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of `documents`: whole copies, and a last copy cut to the words it still takes.

    Documents that the mix takes no word of go. The cut copy holds its first words joined by single blanks. Rows of one
    id and size are taken alike, as often as the one that is taken most.
    """
    kept = mix(docs, **options).filter("taken > 0").groupBy("doc_id", "size").agg(F.max("taken").alias("taken"))
    sized = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    met = sized.join(kept, (sized["doc_id"].eqNullSafe(kept["doc_id"])) & (sized["size"] == kept["size"]))
    met = met.select(*(sized[c] for c in docs.columns), kept["size"], "taken")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    left = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    cut = F.when(left >= F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(words(F.col("text")), F.lit(1), F.greatest(left, F.lit(0))), " ")
    )
    return met.withColumn("text", cut).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )
