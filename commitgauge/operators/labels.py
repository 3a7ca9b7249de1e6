"""Hand-made labels: cleaning, ids, merging, and comparison with predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions import text as X
from commitgauge.operators.commits import bind_libraries
from commitgauge.operators.focus import count_by
from commitgauge.operators.joins import broadcast_if_short


def clean_labels(labels: DataFrame) -> DataFrame:
    """Typed, normalised labels next to the untouched columns; unlabelled rows are dropped."""
    labelled = labels.where(~X.is_missing_text(F.col("label_category")))
    return labelled.withColumns(
        {
            "message": X.clean_text(F.col("message")),
            "diff_preview": X.clean_text(F.col("diff_preview")),
            "cat": X.normalize_label_category(F.col("label_category")),
            "feat": X.parse_bool(F.col("label_is_feature")),
            "sec": X.parse_bool(F.col("label_is_security")),
            "comp": X.label_complexity(F.col("label_complexity")),
            "reas": X.clean_reasoning(F.col("label_reasoning")),
        }
    )


def tail_rewrite(
    df: DataFrame, by: str, ordinal: str, salt: str | None = None, n: int = V.SYNTHETIC_ROWS
) -> DataFrame:
    """Give the last ``n`` rows of every file a synthetic id and flag them.

    Only the smallest ordinal among the last ``n`` rows of a file is looked up
    (Spark keeps at most ``n`` rows per file and task on the way), then every row
    is compared with it where it lies. ``salt`` names a column, by default the file.
    The bounds are one row per file; where the files are few they are broadcast, so
    label rows never move to a hot file, else they are joined by shuffle.
    """
    if "is_synthetic_commit_id" not in df.columns:
        df = df.withColumn("is_synthetic_commit_id", F.lit(False))
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc(ordinal)))
    last = df.select(by, ordinal).withColumn("_rank", rank).where(F.col("_rank") <= n)
    bounds = last.groupBy(by).agg(F.min(ordinal).alias("_bound"))
    joined = df.join(broadcast_if_short(bounds, df.select(by)), by, "left")
    in_tail = F.coalesce(F.col(ordinal) >= F.col("_bound"), F.lit(False))
    new_id = X.synthetic_id(F.col("commit_id"), F.col(salt or by))
    return joined.withColumns(
        {
            "commit_id": F.when(in_tail, new_id).otherwise(F.col("commit_id")),
            "is_synthetic_commit_id": in_tail | F.col("is_synthetic_commit_id").cast("boolean"),
        }
    ).drop("_bound", "synthetic_commit_id")


def merge_labeled(parts: Mapping[str, DataFrame | None]) -> DataFrame:
    """Stack labelled tables under their language; missing parts (None) are skipped."""
    present = {(lang, ""): df for lang, df in parts.items() if df is not None}
    if not present:
        raise ValueError("no labelled table to merge")
    merged = bind_libraries(present, language="language_inferred", library="_library")
    return merged.drop("_library")


def label_counts(labels: DataFrame, label: str = "label_category") -> DataFrame:
    """Rows per label, the missing label included, largest first."""
    return count_by(labels, label).orderBy(F.desc("n"), F.asc_nulls_last(label))


def reason_summary(
    labels: DataFrame, label: str = "label_category", reason: str = "label_reasoning"
) -> DataFrame:
    """Rows and missing reasons per label."""
    return labels.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(X.is_missing_text(F.col(reason))).alias("missing"),
    )


def reasons_by_label(
    labels: DataFrame, label: str = "label_category", reason: str = "label_reasoning"
) -> DataFrame:
    """Every reason beside the totals of its label; groups stay rows, not one list each.

    Totals are one row per distinct label; where the labels are few they are broadcast
    and reason texts never move to a hot label, else they are joined by shuffle.
    """
    known = labels.where(F.col(label).isNotNull())
    totals = reason_summary(labels, label, reason)
    totals = broadcast_if_short(totals, known.select(label))
    return known.join(totals, label).withColumn("is_missing", X.is_missing_text(F.col(reason)))


def gold_vs_model(gold: DataFrame, model: DataFrame, trim: bool = False) -> DataFrame:
    """Labels beside predictions with a match flag per field.

    Security and feature are compared without case. By default blanks around
    them count as a difference; ``trim`` ignores them.
    """

    def same_word(left: str, right: str):
        texts = [F.lower(F.col(c).cast("string")) for c in (left, right)]
        if trim:
            texts = [X.strip(t) for t in texts]
        return texts[0].eqNullSafe(texts[1])

    def number(name: str):
        return F.col(name).cast("string").try_cast("double")

    joined = gold.select(
        "commit_id", "label_category", "label_is_security", "label_is_feature", "label_complexity"
    ).join(
        model.select(
            "commit_id", "model_category", "model_is_security", "model_is_feature", "model_complexity"
        ),
        "commit_id",
    )
    return joined.withColumns(
        {
            "category_match": F.col("label_category").eqNullSafe(F.col("model_category")),
            "is_security_match": same_word("label_is_security", "model_is_security"),
            "is_feature_match": same_word("label_is_feature", "model_is_feature"),
            "complexity_match": number("label_complexity").eqNullSafe(number("model_complexity")),
        }
    )


def agreement(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of matches per field, and distance and bias of the complexity."""
    error = F.col("model_complexity").cast("string").try_cast("double") - F.col(
        "label_complexity"
    ).cast("string").try_cast("double")

    def share(name: str):
        return F.avg(F.col(name).cast("double"))

    return compared.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share("category_match").alias("category_agreement"),
        share("is_security_match").alias("security_agreement"),
        share("is_feature_match").alias("feature_agreement"),
        share("complexity_match").alias("complexity_agreement"),
        F.avg((F.abs(error) <= 1).cast("double")).alias("complexity_within_one"),
        F.avg(F.abs(error)).alias("complexity_mae"),
        F.avg(error).alias("complexity_bias"),
    )


def confusion(compared: DataFrame) -> DataFrame:
    return count_by(compared, "label_category", "model_category")


def category_kappa(compared: DataFrame) -> DataFrame:
    """Cohen's kappa of the category, from the confusion counts."""
    cells = confusion(compared)
    sides = cells.select(
        "n",
        F.explode(
            F.array(
                F.struct(F.col("label_category").alias("category"), F.lit(1).alias("is_label")),
                F.struct(F.col("model_category").alias("category"), F.lit(0).alias("is_label")),
            )
        ).alias("side"),
        F.col("label_category").eqNullSafe(F.col("model_category")).alias("same"),
    )
    per_category = sides.groupBy("side.category").agg(
        F.sum(F.col("n") * F.col("side.is_label")).alias("labelled"),
        F.sum(F.col("n") * (1 - F.col("side.is_label"))).alias("predicted"),
        F.sum(F.when(F.col("same"), F.col("n") * F.col("side.is_label")).otherwise(0)).alias("correct"),
    )
    total = F.sum("labelled").cast("double")
    observed = F.sum("correct") / total
    chance = F.sum(F.col("labelled").cast("double") * F.col("predicted")) / (total * total)
    return per_category.agg(
        observed.alias("observed"), chance.alias("chance"), ((observed - chance) / (1 - chance)).alias("kappa")
    )


def category_totals(compared: DataFrame) -> DataFrame:
    """Labelled, predicted and correct rows per category."""
    both = compared.select(
        F.explode(
            F.array(
                F.struct(F.col("label_category").alias("category"), F.lit(1).alias("labelled"), F.lit(0).alias("predicted"), F.col("category_match").cast("int").alias("correct")),
                F.struct(F.col("model_category").alias("category"), F.lit(0).alias("labelled"), F.lit(1).alias("predicted"), F.lit(0).alias("correct")),
            )
        ).alias("side")
    )
    return both.groupBy("side.category").agg(
        *[F.sum(f"side.{name}").alias(name) for name in ("labelled", "predicted", "correct")]
    )


def majority_vote(votes: DataFrame, item: str = "commit_id", label: str = "label", priority: str = "priority") -> DataFrame:
    """Most frequent label of each item; among equals the one of the voter first in order."""
    counts = votes.groupBy(item, label).agg(
        F.count(F.lit(1)).alias("votes"), F.min(priority).alias("_first")
    )
    order = F.struct("votes", -F.col("_first"), F.col(label))
    return counts.groupBy(item).agg(
        F.max_by(label, order).alias(label), F.max("votes").alias("votes")
    )
