"""A Spark ML multi-label tagger (M7, re-aimed).

The original fine-tunes a transformer on one GPU; that is out of scope.
What is data work — class weights from label counts and a per-label binary
model whose scores feed the rank thresholds — is kept, on Spark ML:
``RegexTokenizer -> HashingTF -> IDF`` once, then one ``LogisticRegression``
per label with ``weightCol`` from the class weights (A3).  Training is
distributed by Spark ML; the driver only loops over the (tens of) labels.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import class_weights


class MultiLabelTagger:
    def __init__(self, features: PipelineModel, models: dict[str, LogisticRegressionModel],
                 labels: list[str]):
        self.features = features
        self.models = models
        self.labels = labels

    def transform(self, df: DataFrame, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
        """(id, scores array<double>) in label order."""
        feats = self.features.transform(df.withColumnRenamed(text_col, "_text"))
        out = feats.select(id_col, "features")
        for i, lab in enumerate(self.labels):
            m = self.models[lab].copy()
            m.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}")
            out = m.transform(out).withColumn(f"_s{i}", vector_to_array(f"_p{i}")[1]).drop(
                f"_p{i}", f"_r{i}", f"_y{i}")
        return out.select(id_col, F.array(*[F.col(f"_s{i}") for i in range(len(self.labels))])
                          .alias("scores"))


def fit_tagger(df: DataFrame, text_col: str, labels_col: str, labels: list[str],
               num_features: int = 1 << 16, max_iter: int = 20,
               class_weighting: bool = True) -> MultiLabelTagger:
    """Fit the featuriser once and one weighted logistic model per label."""
    feats = Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="features"),
    ]).fit(df.withColumnRenamed(text_col, "_text"))
    base = feats.transform(df.withColumnRenamed(text_col, "_text")).select("features", labels_col)
    base = base.cache()
    weights = {}
    if class_weighting:
        long = df.select(F.explode(labels_col).alias("label"))
        weights = {r["label"]: r["weight"] for r in class_weights(long).collect()}
    models = {}
    for lab in labels:
        y = F.array_contains(labels_col, lab).cast("double")
        w = float(weights.get(lab) or 1.0)
        d = base.select("features", y.alias("label"),
                        F.when(y == 1.0, F.lit(w)).otherwise(F.lit(1.0)).alias("w"))
        models[lab] = LogisticRegression(maxIter=max_iter, weightCol="w").fit(d)
    base.unpersist()
    return MultiLabelTagger(feats, models, labels)
