"""Baseline classifiers on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from twintable.operators.nearest import fit_space
from twintable.spec import feature_types

TOP_FEATURES = 20


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


@dataclass(frozen=True)
class Classifier:
    """A fitted pipeline and the names of its expanded features."""

    model: PipelineModel
    features: tuple[str, ...]
    n_features: int

    def predict(self, df: DataFrame, target: str) -> DataFrame:
        """``df`` with string columns ``label`` and ``prediction``."""
        scored = self.model.transform(df)
        return scored.select(
            *df.columns, F.col(target).cast("string").alias("label"), F.col("_predicted").alias("prediction")
        )

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def importances(self, spark, top: int = TOP_FEATURES) -> DataFrame:
        """``(feature, importance)`` of a forest, most important first."""
        weights = self.model.stages[-2].featureImportances.toArray().tolist()
        rows = list(zip(self.features, weights))
        table = spark.createDataFrame(rows, "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature").limit(top)


def class_weights(train: DataFrame, target: str) -> DataFrame:
    """``(label, weight)`` with weight n / (classes * class size)."""
    sizes = train.groupBy(F.col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    rows, classes = sizes.select(F.sum("n")).scalar(), sizes.select(F.count(F.lit(1))).scalar()
    return sizes.select("label", (rows / (classes * F.col("n"))).alias("weight"))


def logistic_regression(n_train: int) -> LogisticRegression:
    """L2 penalty of strength 1, which Spark divides by the number of rows."""
    return LogisticRegression(
        family="multinomial",
        regParam=1.0 / max(1, n_train),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=2000,
        tol=1e-8,
    )


def random_forest(seed: int = 42, trees: int = 300, depth: int = 30) -> RandomForestClassifier:
    """A forest of trees as deep as the learner allows, unless ``depth`` says less."""
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, weightCol="_weight"
    )


def fit_classifier(train: DataFrame, target: str, kind: str = "logreg", **options) -> Classifier:
    """Fill gaps, one-hot encode and fit ``logreg`` or ``forest``.

    Numbers fill with the median and text with its most frequent value; text
    values unknown to ``train`` encode as all zeros.
    """
    numeric, categorical = feature_types(train, target)
    space = fit_space(train, target)
    fills = [f"coalesce(cast(`{c}` as double), {space.medians[c]!r}D) AS `_x_{c}`" for c in numeric]
    fills += [f"coalesce(cast(`{c}` as string), {_text(space.modes[c])}) AS `_c_{c}`" for c in categorical]
    filled = SQLTransformer(statement=f"SELECT *, {', '.join(fills)} FROM __THIS__")

    stages = [filled]
    parts = [f"_x_{c}" for c in numeric]
    if categorical:
        index = StringIndexer(
            inputCols=[f"_c_{c}" for c in categorical],
            outputCols=[f"_i_{c}" for c in categorical],
            handleInvalid="keep",
            stringOrderType="alphabetAsc",
        )
        # dropLast leaves out the slot kept for unknown values
        encode = OneHotEncoder(
            inputCols=index.getOutputCols(), outputCols=[f"_o_{c}" for c in categorical], dropLast=True
        )
        stages += [index, encode]
        parts += encode.getOutputCols()
    stages.append(VectorAssembler(inputCols=parts, outputCol="_features"))

    known = train.where(F.col(target).isNotNull()).withColumn("_label_text", F.col(target).cast("string"))
    labels = StringIndexer(inputCol="_label_text", outputCol="_label", stringOrderType="alphabetAsc").fit(known)
    rows = labels.transform(known)
    if kind == "logreg":
        learner = logistic_regression(rows.count())
    elif kind == "forest":
        learner = random_forest(**options)
        # one weight per class, and the label indexer already holds every class
        rows = rows.join(F.broadcast(class_weights(known, target).toDF("_label_text", "_weight")), "_label_text")
    else:
        raise ValueError(f"unknown classifier: {kind}")
    learner = learner.setFeaturesCol("_features").setLabelCol("_label").setPredictionCol("_class")
    stages += [learner, IndexToString(inputCol="_class", outputCol="_predicted", labels=labels.labels)]
    model = Pipeline(stages=stages).fit(rows)

    names = list(numeric)
    if categorical:
        for c, values in zip(categorical, model.stages[1].labelsArray):
            names += [f"{c}_{v}" for v in values]
    return Classifier(model, tuple(names), len(numeric) + len(categorical))
