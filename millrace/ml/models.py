"""Classifiers over Spark ML: features, labels, the estimators by name, and fitted models as bytes."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import feature as X
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import storage, types
from millrace.ml.neighbours import prepared, search
from millrace.registry import PropertyError, col, field_of

FEATURES, LABEL, PREDICTED = "__features", "__label", "__prediction"


@dataclass
class Fitted:
    """A fitted classifier or regressor: where its features come from, its labels, and what predicts.

    `parts` are saved Spark pipelines, `state` is numpy; both by name. It is pickled into the model column.
    """

    name: str
    columns: list[str]
    text: str | None
    labels: list[str] | None
    kind: str
    parts: dict[str, bytes] = field(default_factory=dict)
    state: dict[str, Any] = field(default_factory=dict)

    def dumps(self) -> bytes:
        return pickle.dumps(self)

    @staticmethod
    def loads(raw: bytes) -> Fitted:
        return pickle.loads(raw)  # noqa: S301  models come from this library's own trainers

    def features(self, spark: SparkSession, df: DataFrame) -> DataFrame:
        return storage.model_from_bytes(spark, self.parts["features"]).transform(_numbers(df, self.columns, self.text))

    def predict(self, spark: SparkSession, df: DataFrame) -> DataFrame:
        """df with PREDICTED: the label's text, or a double for regressors."""
        ready = PREDICTORS[self.kind](self, spark, self.features(spark, df))
        if self.labels is None:
            return ready
        names = F.array(*(F.lit(x) for x in self.labels))
        return ready.withColumn(PREDICTED, F.get(names, F.col(PREDICTED).cast("int")))


def _numbers(df: DataFrame, columns: list[str], text: str | None) -> DataFrame:
    """df with the model's inputs in columns of fixed names."""
    if text:
        return df.withColumn("__text", F.coalesce(col(df, text).cast("string"), F.lit("")))
    return df.withColumns({f"__x{i}": col(df, c).cast("double") for i, c in enumerate(columns)})


def feature_stages(n: int, text: bool, counted: bool = True, tfidf: bool = False) -> list:
    if not text:
        return [X.VectorAssembler(inputCols=[f"__x{i}" for i in range(n)], outputCol=FEATURES, handleInvalid="skip")]
    # Tokens of two letters or digits at least.
    cut = [X.RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"(?U)\b\w\w+\b", gaps=False)]
    counts = X.CountVectorizer(inputCol="__words", outputCol="__counts" if tfidf else FEATURES)
    return [*cut, counts, *([X.IDF(inputCol="__counts", outputCol=FEATURES)] if tfidf else [])]


def _pipeline_predict(m: Fitted, spark: SparkSession, df: DataFrame) -> DataFrame:
    return storage.model_from_bytes(spark, m.parts["model"]).transform(df).withColumn(PREDICTED, F.col("prediction"))


def _calibrated_predict(m: Fitted, spark: SparkSession, df: DataFrame) -> DataFrame:
    return storage.model_from_bytes(spark, m.parts["model"]).transform(df).withColumn(PREDICTED, F.col("__final"))


def _scored(m: Fitted, spark: SparkSession, df: DataFrame, score: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """PREDICTED from a numpy function of the feature matrix."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(score(np.stack(x.to_numpy())).astype(float)) if len(x) else pd.Series([], dtype=float)

    return df.withColumn(PREDICTED, run(vector_to_array(FEATURES)))


def _linear_predict(m: Fitted, spark: SparkSession, df: DataFrame) -> DataFrame:
    w, b = m.state["weights"], m.state["bias"]
    return _scored(m, spark, df, lambda x: np.argmax(x @ w.T + b, axis=1))


def _constant_predict(m: Fitted, spark: SparkSession, df: DataFrame) -> DataFrame:
    return df.withColumn(PREDICTED, F.lit(float(m.state["value"])))


def _centroid_predict(m: Fitted, spark: SparkSession, df: DataFrame) -> DataFrame:
    centers = m.state["centers"]
    return _scored(m, spark, df, lambda x: np.argmin(((x[:, None, :] - centers[None]) ** 2).sum(axis=2), axis=1))


def _neighbours_predict(m: Fitted, spark: SparkSession, df: DataFrame) -> DataFrame:
    held = spark.sparkContext.broadcast(m.state["rows"])
    k, vote = m.state["k"], m.labels is not None
    return _scored(m, spark, df, lambda x: search(held.value, x, k, vote))


def _boost_predict(m: Fitted, spark: SparkSession, df: DataFrame) -> DataFrame:
    totals = [F.lit(0.0) for _ in m.labels]
    for i, a in enumerate(m.state["alphas"]):
        got = storage.model_from_bytes(spark, m.parts[f"model{i}"]).transform(df)
        df = got.withColumn(f"__vote{i}", F.col("prediction")).drop("prediction", "rawPrediction", "probability")
        totals = [t + F.when(F.col(f"__vote{i}") == k, F.lit(a)).otherwise(0.0) for k, t in enumerate(totals)]
    votes = F.array(*totals)
    return df.withColumn(PREDICTED, (F.array_position(votes, F.array_max(votes)) - 1).cast("double"))


def fourier(df: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """Random Fourier features of an RBF kernel in place of the features."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        z = np.cos(np.stack(x.to_numpy()) @ w + b) * np.sqrt(2 / len(b))
        return pd.Series(list(z))

    return df.withColumn("__raw", vector_to_array(FEATURES)).withColumn(FEATURES, array_to_vector(run("__raw")))


def _fourier_predict(m: Fitted, spark: SparkSession, df: DataFrame) -> DataFrame:
    return _pipeline_predict(m, spark, fourier(df, m.state["w"], m.state["b"]))


Trainer = Callable[[SparkSession, DataFrame, int], tuple[str, dict[str, Any], dict[str, Any]]]

#: Training rows that a kernel is measured against where no explicit features are known.
LANDMARKS = 256


def landmarks(df: DataFrame, points: np.ndarray, kernel: str, gamma: float, coef0: float, degree: int) -> DataFrame:
    """The kernel of each row with some training rows, in place of the features: a polynomial, or a hyperbolic tangent."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        z = gamma * np.stack(x.to_numpy()) @ points.T + coef0
        return pd.Series(list(np.tanh(z) if kernel == "sigmoid" else z**degree))

    return df.withColumn("__raw", vector_to_array(FEATURES)).withColumn(FEATURES, array_to_vector(run("__raw")))


def _landmarks_predict(m: Fitted, spark: SparkSession, df: DataFrame) -> DataFrame:
    return _pipeline_predict(m, spark, landmarks(df, **m.state))


def landmark_machine(estimator: Callable[[int], Any], kernel: str, gamma: float | None, coef0: float, degree: int) -> Trainer:
    """A linear machine on the kernel with up to LANDMARKS training rows, those of least hash."""

    def fit(spark, df, classes):
        some = df.select(vector_to_array(FEATURES).alias("x")).distinct().orderBy(F.xxhash64("x")).limit(LANDMARKS).collect()
        points = np.array([r["x"] for r in some], dtype=float)
        n, variance = _scale(df)
        state = {"points": points, "kernel": kernel, "gamma": 1.0 / (n * max(variance, 1e-12)) if gamma is None else gamma, "coef0": coef0, "degree": degree}
        return "landmarks", {"model": Pipeline(stages=[estimator(classes)]).fit(landmarks(df, **state))}, state

    return fit


PREDICTORS = {
    "pipeline": _pipeline_predict,
    "calibrated": _calibrated_predict,
    "linear": _linear_predict,
    "constant": _constant_predict,
    "centroid": _centroid_predict,
    "neighbours": _neighbours_predict,
    "boost": _boost_predict,
    "fourier": _fourier_predict,
    "landmarks": _landmarks_predict,
}


def spark_trainer(make: Callable[[int], Any]) -> Trainer:
    """Fits a Spark ML estimator (or list of stages)."""

    def fit(spark: SparkSession, df: DataFrame, classes: int):
        made = make(classes)
        model = Pipeline(stages=made if isinstance(made, list) else [made]).fit(df)
        return "pipeline", {"model": model}, {}

    return fit


def _c(kind: type, **params: Any) -> Any:
    return kind(featuresCol=FEATURES, labelCol=LABEL, **params)


def one_vs_rest(binary: Any, classes: int) -> Any:
    return binary if classes <= 2 else C.OneVsRest(classifier=binary, featuresCol=FEATURES, labelCol=LABEL)


def _majority(spark, df, classes):
    row = df.groupBy(LABEL).count().orderBy(F.desc("count"), LABEL).first()
    return "constant", {}, {"value": row[0]}


def _centroids(spark, df, classes):
    rows = df.groupBy(LABEL).agg(Summarizer.mean(F.col(FEATURES)).alias("m")).orderBy(LABEL).collect()
    return "centroid", {}, {"centers": np.array([r["m"].toArray() for r in rows])}


def neighbours(k: int = 5) -> Trainer:
    """Keeps all different training rows and how often each is there, in the model and so in every worker: 8 bytes a feature and 16 more of each."""

    def fit(spark, df, classes):
        rows = df.groupBy(vector_to_array(FEATURES).alias("x"), LABEL).agg(F.count(F.lit(1)).alias("n")).toArrow().combine_chunks()
        points = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        return "neighbours", {}, {"rows": prepared(points, rows[LABEL].to_numpy().astype(float), rows["n"].to_numpy()), "k": k}

    return fit


def _boost(spark, df, classes, rounds: int = 10):
    """SAMME: trees of depth one, each fitted with more weight on what the ones before got wrong."""
    df = df.withColumn("__w", F.lit(1.0)).persist()
    parts, alphas = {}, []
    for i in range(rounds):
        tree = Pipeline(stages=[_c(C.DecisionTreeClassifier, maxDepth=1, weightCol="__w")]).fit(df)
        got = tree.transform(df)
        wrong = F.col("prediction") != F.col(LABEL)
        total, missed = got.agg(F.sum("__w"), F.sum(F.when(wrong, F.col("__w")).otherwise(0.0))).first()
        error = max(missed / total, 1e-10)
        if error >= 1 - 1 / max(classes, 2):
            break
        alpha = float(np.log((1 - error) / error) + np.log(max(classes, 2) - 1))
        parts[f"model{len(alphas)}"] = tree
        alphas.append(alpha)
        if error <= 1e-10:
            break
        after = got.withColumn("__w", F.col("__w") * F.when(wrong, F.lit(float(np.exp(alpha)))).otherwise(1.0) / F.lit(total)).drop("prediction", "rawPrediction", "probability").persist()
        df.unpersist()
        df = after
    df.unpersist()
    return ("boost", parts, {"alphas": alphas}) if alphas else _majority(spark, df, classes)


def _perceptron(spark, df, classes, epochs: int = 5):
    """Each partition goes over its rows from the mean of all partitions' weights; of each comes one row of weights."""
    data = df.select(vector_to_array(FEATURES).alias("x"), LABEL).persist()
    width = len(data.first()["x"])
    w = np.zeros((classes, width + 1))
    for _ in range(epochs):
        start = w

        def learn(batches, start=start):
            own, n = start.copy(), 0
            for b in batches:
                for x, y in zip(b["x"], b[LABEL], strict=True):
                    x, y, n = np.append(x, 1.0), int(y), n + 1
                    guess = int(np.argmax(own @ x))
                    if guess != y:
                        own[y] += x
                        own[guess] -= x
            if n:
                yield pd.DataFrame({"w": [own.ravel().tolist()], "n": [n]})

        mixed = data.mapInPandas(learn, "w array<double>, n long").select(F.posexplode("w").alias("i", "v"), "n").groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).orderBy("i").collect()
        w = np.array([r["v"] for r in mixed]).reshape(w.shape)
    data.unpersist()
    return "linear", {}, {"weights": w[:, :-1], "bias": w[:, -1]}


def ridge(regs: list[float]) -> Trainer:
    """For each class a ridge regression on 1 and -1; of several strengths the one with the best cross-validated error."""

    def fit(spark, df, classes):
        weights, bias = [], []
        for k in range(max(classes, 1)):
            signed = df.withColumn("__y", F.when(F.col(LABEL) == k, 1.0).otherwise(-1.0))
            lr = LinearRegression(featuresCol=FEATURES, labelCol="__y", elasticNetParam=0.0, regParam=regs[0], solver="l-bfgs", standardization=False)
            if len(regs) > 1:
                lr = CrossValidator(estimator=lr, estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, regs).build(), evaluator=RegressionEvaluator(labelCol="__y"), numFolds=3, seed=1)
                model = lr.fit(signed).bestModel
            else:
                model = lr.fit(signed)
            weights.append(model.coefficients.toArray())
            bias.append(model.intercept)
        return "linear", {}, {"weights": np.array(weights), "bias": np.array(bias)}

    return fit


def fourier_svm(c: float = 1.0, gamma: float | None = None, features: int = 256, seed: int = 1) -> Trainer:
    """An RBF kernel by random Fourier features, then a linear machine."""

    def fit(spark, df, classes):
        n, variance = _scale(df)
        g = gamma if gamma is not None else 1.0 / (n * max(variance, 1e-12))
        rng = np.random.default_rng(seed)
        w, b = rng.normal(0, np.sqrt(2 * g), (n, features)), rng.uniform(0, 2 * np.pi, features)
        svm = _c(C.LinearSVC, regParam=1 / max(c, 1e-9) / 100)
        model = Pipeline(stages=[one_vs_rest(svm, classes)]).fit(fourier(df, w, b))
        return "fourier", {"model": model}, {"w": w, "b": b}

    return fit


def _scale(df: DataFrame) -> tuple[int, float]:
    """Number of features and the variance of all their values."""
    row = df.select(vector_to_array(FEATURES).alias("x")).select(F.size("x").alias("n"), F.explode("x").alias("v")).agg(F.first("n"), F.var_pop("v")).first()
    return int(row[0]), float(row[1] or 0.0)


def _layers(spark, df, classes):
    width = len(df.select(vector_to_array(FEATURES).alias("x")).first()["x"])
    return spark_trainer(lambda n: _c(C.MultilayerPerceptronClassifier, layers=[width, 100, max(n, 2)], maxIter=100, seed=1))(spark, df, classes)


def _logistic_cv(n: int):
    lr = _c(C.LogisticRegression)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1.0, 0.1, 0.01, 0.001]).build()
    return CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy"), numFolds=3, seed=1)


def _logistic_cv_fit(spark, df, classes):
    best = _logistic_cv(classes).fit(df).bestModel
    return "pipeline", {"model": PipelineModel([best])}, {}


def _calibrated(spark, df, classes):
    """Linear machines, and a logistic regression on their margins."""
    base = one_vs_rest(_c(C.LinearSVC), classes).fit(df)
    platt = C.LogisticRegression(featuresCol="rawPrediction", labelCol=LABEL, predictionCol="__final", rawPredictionCol="__logit", probabilityCol="__share").fit(base.transform(df))
    return "calibrated", {"model": PipelineModel([base, platt])}, {}


def _bayes(kind: str) -> Trainer:
    return spark_trainer(lambda n: _c(C.NaiveBayes, modelType=kind))


def _bernoulli(spark, df, classes):
    """Bernoulli models take features of 0 and 1: above 0 is 1."""
    stages = [X.Binarizer(inputCol=FEATURES, outputCol="__ones", threshold=0.0), C.NaiveBayes(modelType="bernoulli", featuresCol="__ones", labelCol=LABEL)]
    return "pipeline", {"model": Pipeline(stages=stages).fit(df)}, {}


#: Trainers by the model's name in operators.
TRAINERS: dict[str, Trainer] = {
    "AdaptiveBoosting": _boost,
    "Bagging": spark_trainer(lambda n: _c(C.RandomForestClassifier, numTrees=10, featureSubsetStrategy="all", seed=1)),
    "BernoulliNaiveBayes": _bernoulli,
    "ComplementNaiveBayes": _bayes("complement"),
    "DecisionTree": spark_trainer(lambda n: _c(C.DecisionTreeClassifier, maxDepth=10, seed=1)),
    "DummyClassifier": _majority,
    "ExtraTree": spark_trainer(lambda n: _c(C.RandomForestClassifier, numTrees=1, maxDepth=10, bootstrap=False, featureSubsetStrategy="sqrt", seed=1)),
    "ExtraTrees": spark_trainer(lambda n: _c(C.RandomForestClassifier, numTrees=50, maxDepth=10, bootstrap=False, seed=1)),
    "GaussianNaiveBayes": _bayes("gaussian"),
    "GradientBoosting": spark_trainer(lambda n: one_vs_rest(_c(C.GBTClassifier, maxDepth=3, maxIter=20, seed=1), n)),
    "KNN": neighbours(),
    "LinearSVM": spark_trainer(lambda n: one_vs_rest(_c(C.LinearSVC), n)),
    "LogisticRegressionCV": _logistic_cv_fit,
    "LogisticRegression": spark_trainer(lambda n: _c(C.LogisticRegression, regParam=0.001)),
    "MultiLayerPerceptron": _layers,
    "MultinomialNaiveBayes": _bayes("multinomial"),
    "NearestCentroid": _centroids,
    "PassiveAggressive": spark_trainer(lambda n: one_vs_rest(_c(C.LinearSVC, regParam=0.01), n)),
    "Perceptron": _perceptron,
    "ProbabilityCalibration": _calibrated,
    "RandomForest": spark_trainer(lambda n: _c(C.RandomForestClassifier, numTrees=50, maxDepth=10, seed=1)),
    "RidgeCV": ridge([0.1, 1.0, 10.0]),
    "Ridge": ridge([1.0]),
    "SDG": spark_trainer(lambda n: one_vs_rest(_c(C.LinearSVC, regParam=0.0001), n)),
    "SVM": fourier_svm(),
}


def fit(spark: SparkSession, df: DataFrame, name: str, trainer: Trainer, target: str, columns: list[str] | None = None, text: str | None = None, counted: bool = True, tfidf: bool = False, regression: bool = False) -> Fitted:
    """Fits a trainer: features are all other columns, those given, or one text column's word counts. Rows with nulls are left out."""
    goal = field_of(df, target).name
    columns = columns or [c for c in df.columns if c != goal]
    if not text:
        for c in columns:
            if types.name_of(field_of(df, c).dataType) not in ("integer", "long", "double", "boolean"):
                raise PropertyError(f"{name}: column {c} is no number")
    y = col(df, goal)
    ready = _numbers(df.where(y.isNotNull()), columns, text)
    features = Pipeline(stages=feature_stages(len(columns), bool(text), counted, tfidf)).fit(ready)
    labels = None
    if regression:
        ready = ready.withColumn(LABEL, F.col(f"`{goal}`").cast("double"))
    else:
        named = ready.withColumn("__goal", F.col(f"`{goal}`").cast("string"))
        index = X.StringIndexer(inputCol="__goal", outputCol=LABEL, stringOrderType="frequencyDesc").fit(named)
        labels, ready = list(index.labels), index.transform(named)
    ready = features.transform(ready).select(FEATURES, LABEL).persist()
    if ready.isEmpty():
        ready.unpersist()
        raise PropertyError(f"{name}: no rows to learn from")
    kind, parts, state = trainer(spark, ready, len(labels or []))
    ready.unpersist()
    saved = {k: storage.model_bytes(spark, p) for k, p in (parts | {"features": features}).items()}
    return Fitted(name, columns, text, labels, kind, saved, state)


def class_metrics(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1 of each actual class, by one grouping of the pairs."""
    pairs = scored.select(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")).groupBy("a", "p").agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("actual", "predicted", "hit"))).where("actual > 0")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    both = F.col("actual") + F.col("predicted")
    return sums.select("label", share("hit", "predicted").alias("precision"), share("hit", "actual").alias("recall"), F.when(both > 0, 2 * F.col("hit") / both).otherwise(0.0).alias("f1"))
