"""Training and applying a text classifier on labelled commits with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_commit_classifier(
    examples: DataFrame,
    text: str = "text",
    label: str = "label",
    features: int = 1 << 12,
    iterations: int = 20,
    regularization: float = 0.01,
) -> PipelineModel:
    """Fit word counts, inverse document frequency and a logistic regression."""
    stages = [
        StringIndexer(inputCol=label, outputCol="_target", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features",
            labelCol="_target",
            predictionCol="_prediction",
            maxIter=iterations,
            regParam=regularization,
        ),
    ]
    return Pipeline(stages=stages).fit(examples.where(F.col(label).isNotNull()))


def batch_classify(model: PipelineModel, df: DataFrame, into: str = "predicted") -> DataFrame:
    """Add the predicted label; every executor classifies its own rows."""
    labels = model.stages[0].labels
    steps = PipelineModel(model.stages[1:])
    names = F.array(*[F.lit(x) for x in labels])
    scored = steps.transform(df)
    return scored.withColumn(into, F.get(names, F.col("_prediction").cast("int"))).select(*df.columns, into)
