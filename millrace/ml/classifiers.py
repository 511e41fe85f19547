"""Operators that train models, and the one that predicts with them."""

from __future__ import annotations

import logging
from typing import Any

from pyspark.ml import Pipeline
from pyspark.ml import feature as X
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import types
from millrace.ml import models
from millrace.registry import Operator, PropertyError, col, field_of, many, new_name, operator, wire

log = logging.getLogger(__name__)


def model_row(spark: SparkSession, name: str, model: models.Fitted) -> DataFrame:
    return spark.createDataFrame([(name, bytearray(model.dumps()))], "model_name string, model binary")


class _Training(Operator):
    """Fits on port 0 and gives one row: the model's name and its bytes."""

    model = ""

    def fit(self, spark: SparkSession, df: DataFrame) -> models.Fitted:
        if self.countVectorizer and not self.text:
            raise PropertyError(f"{self.name}: no text column to count words of")
        return models.fit(spark, df, self.model, models.TRAINERS[self.model], self.target, text=self.text if self.countVectorizer else None, tfidf=self.tfidfTransformer)

    def run(self, spark, df):
        return model_row(spark, self.model, self.fit(spark, df))


class _TrainAndTest(_Training):
    """Fits on port 0, logs how well it does on port 1, and gives the model's row."""

    def run(self, spark, train, test):
        fitted = self.fit(spark, train)
        scored = fitted.predict(spark, test).withColumn("__actual", col(test, self.target).cast("string"))
        share = scored.agg(F.avg((F.col("__actual") == F.col(models.PREDICTED)).cast("double"))).first()[0]
        log.info("%s: accuracy %s", self.model, share)
        for r in models.class_metrics(scored, "__actual", models.PREDICTED).orderBy("label").collect():
            log.info("%s, class %s: precision %.4f, recall %.4f, f1 %.4f", self.model, r["label"], r["precision"], r["recall"], r["f1"])
        return model_row(spark, self.model, fitted)


def _declare(model: str) -> None:
    fields = {"target": str, "countVectorizer": bool, "text": str, "tfidfTransformer": bool}
    values = {"countVectorizer": False, "text": "", "tfidfTransformer": False}
    for prefix, base, ports in (("Sklearn", _TrainAndTest, 2), ("SklearnTraining", _Training, 1)):
        body = {"__annotations__": dict(fields), "__doc__": base.__doc__, "__module__": __name__, "model": model, "inputs": ports, **values}
        operator(f"{prefix}{model}", "Machine learning")(type(f"{prefix}{model}", (base,), body))


for _name in models.TRAINERS:
    _declare(_name)


def linear_regression(degree: int) -> models.Trainer:
    def fit(spark, df, classes):
        stages = [X.PolynomialExpansion(degree=degree, inputCol=models.FEATURES, outputCol="__poly")] if degree > 1 else []
        stages.append(LinearRegression(featuresCol="__poly" if degree > 1 else models.FEATURES, labelCol=models.LABEL))
        return "pipeline", {"model": Pipeline(stages=stages).fit(df)}, {}

    return fit


def regression_errors(scored: DataFrame, actual: str, predicted: str):
    """mse, mae, r2 in two passes (the mean first)."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    row = scored.where(a.isNotNull() & p.isNotNull()).agg(F.avg((a - p) ** 2), F.avg(F.abs(a - p)), F.var_pop(a)).first()
    return row[0], row[1], None if not row[2] else 1 - row[0] / row[2]


@operator("SklearnLinearRegression", "Machine learning")
class SklearnLinearRegression(Operator):
    """Least squares on polynomial features; logs error and R² on port 1, gives the model's row."""

    inputs = 2
    target: str
    degree: int = 1

    def run(self, spark, train, test):
        fitted = models.fit(spark, train, "LinearRegression", linear_regression(int(self.degree)), self.target, regression=True)
        _, mae, r2 = regression_errors(fitted.predict(spark, test), field_of(test, self.target).name, models.PREDICTED)
        log.info("LinearRegression: mean absolute error %s, R2 %s", mae, r2)
        return model_row(spark, "LinearRegression", fitted)


@operator("SklearnPrediction", "Machine learning")
class SklearnPrediction(Operator):
    """Adds predictions of the model in port 0's first row to the rows of port 1, in the type of the true values if they are there."""

    inputs = 2
    model: str = "model"
    result: str = wire("Output Attribute Name", "prediction")
    groundTruth: str = wire("Ground Truth Attribute Name to Ignore", "")

    def run(self, spark, model, df):
        name = new_name(df, self.result)
        row = model.select(col(model, self.model)).first()
        if row is None or row[0] is None:
            raise PropertyError("SklearnPrediction: no model")
        kind = field_of(df, self.groundTruth).dataType if self.groundTruth else types.SPARK["string"]
        fitted = models.Fitted.loads(bytes(row[0]))
        return fitted.predict(spark, df).select(*(f"`{c}`" for c in df.columns), F.col(models.PREDICTED).cast(kind).alias(name))


class _Advanced(Operator):
    """One model for each row of the hyper-parameter table at port 1, or a single one if all parameters are literals.

    A parameter comes from the table's column `attribute` where parametersSource is set, else from `value`.
    """

    defaults: dict[str, Any] = {}
    regression = False

    def trainer(self, p: dict[str, Any]) -> models.Trainer:
        raise NotImplementedError

    def run(self, spark, train, parameters):
        from_table = [p for p in self.paraList if p.get("parametersSource")]
        fixed = {p["parameter"]: p.get("value") for p in self.paraList if not p.get("parametersSource")}
        rows = [{}]
        if from_table:
            # One model a row, each fitted by a Spark job of its own.
            rows = [{p["parameter"]: r[i] for i, p in enumerate(from_table)} for r in parameters.select(*(col(parameters, p["attribute"]) for p in from_table)).collect()]
        out = []
        for r in rows:
            given = self.defaults | {k: type(self.defaults.get(k, ""))(v) for k, v in (fixed | r).items()}
            fitted = models.fit(spark, train, self.name, self.trainer(given), self.groundTruthAttribute, columns=[field_of(train, f).name for f in self.selectedFeatures], regression=self.regression)
            out.append((bytearray(fitted.dumps()), ", ".join(f"{k}={given[k]}" for k in sorted(fixed | r))))
        return spark.createDataFrame(out, "Model binary, Parameters string")


def _advanced(name: str, make, defaults: dict[str, Any], regression: bool) -> None:
    body = {
        "__annotations__": {"groundTruthAttribute": str, "selectedFeatures": list, "paraList": list}, "__doc__": _Advanced.__doc__, "__module__": __name__,
        "inputs": 2, "selectedFeatures": many(), "paraList": many(), "defaults": defaults, "regression": regression, "trainer": lambda self, p: make(p),
    }
    operator(name, "Machine learning")(type(name, (_Advanced,), body))


def kernel_svc(p: dict[str, Any]) -> models.Trainer:
    gamma = None if p["gamma"] in ("scale", "auto", "") else float(p["gamma"])
    if p["kernel"] == "linear":
        return models.spark_trainer(lambda n: models.one_vs_rest(models._c(models.C.LinearSVC, regParam=1 / max(float(p["C"]), 1e-9) / 100), n))
    if p["kernel"] in ("poly", "sigmoid"):
        svm = lambda n: models.one_vs_rest(models._c(models.C.LinearSVC, regParam=1 / max(float(p["C"]), 1e-9) / 1000, maxIter=30), n)
        return models.landmark_machine(svm, p["kernel"], gamma, float(p["coef0"]), int(p["degree"]))
    if p["kernel"] != "rbf":
        raise PropertyError(f"SVCTrainer: no kernel {p['kernel']!r}; there are linear, poly, rbf and sigmoid")
    return models.fourier_svm(float(p["C"]), gamma)


def kernel_svr(p: dict[str, Any]) -> models.Trainer:
    """Huber regression, linear or on a kernel's features: as in support vector regression, large errors count linearly."""

    def fit(spark, df, classes):
        import numpy as np

        lr = LinearRegression(featuresCol=models.FEATURES, labelCol=models.LABEL, loss="huber", regParam=1 / max(float(p["C"]), 1e-9) / 100, epsilon=max(1.35, 1 + float(p["epsilon"])))
        if p["kernel"] == "linear":
            return "pipeline", {"model": Pipeline(stages=[lr]).fit(df)}, {}
        gamma = None if p["gamma"] in ("scale", "auto", "") else float(p["gamma"])
        if p["kernel"] in ("poly", "sigmoid"):
            return models.landmark_machine(lambda n: lr, p["kernel"], gamma, float(p.get("coef0", 0.0)), int(p.get("degree", 3)))(spark, df, classes)
        if p["kernel"] != "rbf":
            raise PropertyError(f"SVRTrainer: no kernel {p['kernel']!r}; there are linear, poly, rbf and sigmoid")
        n, variance = models._scale(df)
        g = 1.0 / (n * max(variance, 1e-12)) if p["gamma"] in ("scale", "auto", "") else float(p["gamma"])
        rng = np.random.default_rng(1)
        w, b = rng.normal(0, np.sqrt(2 * g), (n, 256)), rng.uniform(0, 2 * np.pi, 256)
        return "fourier", {"model": Pipeline(stages=[lr]).fit(models.fourier(df, w, b))}, {"w": w, "b": b}

    return fit


_advanced("KNNClassifierTrainer", lambda p: models.neighbours(int(p["n_neighbors"])), {"n_neighbors": 5}, False)
_advanced("KNNRegressorTrainer", lambda p: models.neighbours(int(p["n_neighbors"])), {"n_neighbors": 5}, True)
_advanced("SVCTrainer", kernel_svc, {"C": 1.0, "kernel": "rbf", "gamma": "scale", "degree": 3, "coef0": 0.0, "tol": 0.001, "probability": ""}, False)
_advanced("SVRTrainer", kernel_svr, {"C": 1.0, "kernel": "rbf", "gamma": "scale", "degree": 3, "coef0": 0.0, "tol": 0.001, "epsilon": 0.1, "shrinking": "", "verbose": "", "cache_size": 200, "max_iter": -1}, True)
