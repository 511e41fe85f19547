"""Queries of the machine-learning operators: data on which every model must be exact, with the answer in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.ml import models
from millrace.plans.catalog import ORACLE_SQL, QUERIES, query, run, table

# Two classes far apart, each with a feature of its own.
_LARGE = "p_size > 25"
_ROWS = (
    f"CASE WHEN {_LARGE} THEN 1 + cast(p_size AS double) / 50 ELSE 0 END AS a",
    f"CASE WHEN {_LARGE} THEN 0 ELSE 1 + cast(p_size AS double) / 50 END AS b",
    f"CASE WHEN {_LARGE} THEN 'large' ELSE 'small' END AS kind",
)
_KINDS = f"SELECT p_partkey, CASE WHEN {_LARGE} THEN 'large' ELSE 'small' END AS kind FROM part"
_LITERAL = "Ground Truth Attribute Name to Ignore"


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", *_ROWS)


def _fit_and_predict(model: str) -> None:
    """Both forms of a classifier, the one that is tested on port 1 as well and the one that is only trained, over all parts."""

    def f(spark, sf_dir):
        rows = _parts(spark, sf_dir)
        train = rows.drop("p_partkey").persist()
        tested = run(spark, f"Sklearn{model}", train, train, target="kind")
        trained = run(spark, f"SklearnTraining{model}", train, target="kind")
        train.unpersist()
        named = {"tested": tested, "trained": trained}
        out = [run(spark, "SklearnPrediction", m, rows, **{_LITERAL: "kind"}).select(F.lit(form).alias("form"), "p_partkey", "prediction") for form, m in named.items()]
        return out[0].unionAll(out[1])

    QUERIES[f"fit_{model}"] = f
    answer = "(SELECT kind FROM k GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)" if model == "DummyClassifier" else "kind"
    ORACLE_SQL[f"fit_{model}"] = f"WITH k AS ({_KINDS}) SELECT form, p_partkey, {answer} AS prediction FROM k, (VALUES ('tested'), ('trained')) f(form)"


for _m in models.TRAINERS:
    _fit_and_predict(_m)


def _predicted(spark, model, df, truth: str, name: str = "Model"):
    return run(spark, "SklearnPrediction", model, df, model=name, **{_LITERAL: truth})


def _trained(spark, kind: str, df, truth: str, features: list[str], table_of=None, **given):
    from_table = [{"parameter": c, "parametersSource": True, "attribute": c} for c in (table_of.columns if table_of is not None else [])]
    literal = [{"parameter": k, "value": str(v), "parametersSource": False} for k, v in given.items()]
    rows = table_of if table_of is not None else spark.createDataFrame([(1,)], "unused int")
    return run(spark, kind, df, rows, groundTruthAttribute=truth, selectedFeatures=features, paraList=from_table + literal)


@query(f"SELECT p_partkey, kind AS prediction FROM ({_KINDS})")
def trainer_knn_classifier(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    return _predicted(spark, _trained(spark, "KNNClassifierTrainer", rows, "kind", ["a", "b"], n_neighbors=3), rows, "kind").select("p_partkey", "prediction")


@query("SELECT p_partkey, p_size * 2.0::DOUBLE AS prediction FROM part")
def trainer_knn_regressor(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size AS double) AS size", "p_size * 2D AS y")
    return _predicted(spark, _trained(spark, "KNNRegressorTrainer", rows, "y", ["size"], n_neighbors=1), rows, "y").select("p_partkey", "prediction")


@query(f"SELECT kernel, p_partkey, kind AS prediction FROM ({_KINDS}), (VALUES ('linear'), ('rbf'), ('poly'), ('sigmoid')) k(kernel)")
def trainer_svc(spark, sf_dir):
    """A model for each row of the parameter table."""
    kernels = ("linear", "rbf", "poly", "sigmoid")
    rows = _parts(spark, sf_dir)
    found = _trained(spark, "SVCTrainer", rows, "kind", ["a", "b"], spark.createDataFrame([(k,) for k in kernels], "kernel string")).persist()
    parts = [_predicted(spark, found.where(F.col("Parameters") == f"kernel={k}"), rows, "kind").select(F.lit(k).alias("kernel"), "p_partkey", "prediction") for k in kernels]
    return reduce(DataFrame.unionAll, parts)


@query("SELECT p_partkey, true AS close FROM part")
def trainer_svr(spark, sf_dir):
    """Within a fiftieth of the range of the values."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size AS double) AS size", "p_size * 2D AS y")
    out = _predicted(spark, _trained(spark, "SVRTrainer", rows, "y", ["size"], kernel="linear", C=100.0), rows, "y")
    return out.select("p_partkey", (F.abs(F.col("prediction") - F.col("y")) < 2).alias("close"))


def _linear(degree: int, y: str) -> None:
    def f(spark, sf_dir):
        rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size AS double) AS size", "p_retailprice AS price", f"{y} AS y")
        train = rows.drop("p_partkey")
        model = run(spark, "SklearnLinearRegression", train, train, target="y", degree=degree)
        return run(spark, "SklearnPrediction", model, rows, **{_LITERAL: "y"}).select("p_partkey", F.round("prediction", 3).alias("prediction"))

    QUERIES[f"linear_regression_degree_{degree}"] = f
    ORACLE_SQL[f"linear_regression_degree_{degree}"] = f"SELECT p_partkey, round({y}, 3) AS prediction FROM part"


_linear(1, "cast(p_size AS double) * 3 + p_retailprice / 2 - 7")
_linear(2, "cast(p_size AS double) * p_size - 4")


@query("SELECT p_partkey, regexp_extract(p_type, '[^ ]+$') AS prediction FROM part")
def fit_word_counts(spark, sf_dir):
    """A text's words as features: the last word says the class."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_type AS words", "regexp_extract(p_type, '[^ ]+$', 0) AS kind")
    model = run(spark, "SklearnTrainingLogisticRegression", rows.drop("p_partkey"), target="kind", countVectorizer=True, text="words", tfidfTransformer=True)
    return run(spark, "SklearnPrediction", model, rows, **{_LITERAL: "kind"}).select("p_partkey", "prediction")


# Models that others have trained come as functions from texts to results; these stand for them. -----------------------------


def moods(texts: list[str]) -> list:
    share = lambda t: len(t) % 10 / 10
    return [[{"label": "positive", "score": share(t)}, {"label": "neutral", "score": 0.25}, {"label": "negative", "score": 1 - share(t)}] for t in texts]


def first_words(texts: list[str]) -> list:
    return [{"summary_text": t[:20]} for t in texts]


def odd_lengths(texts: list[str]) -> list:
    return [{"label": f"LABEL_{len(t) % 2}", "score": len(t) / 100} for t in texts]


@query("SELECT p_partkey, (length(p_name) % 10) / 10.0::DOUBLE AS good, 0.25::DOUBLE AS plain, round(1 - (length(p_name) % 10) / 10.0::DOUBLE, 4) AS bad FROM part")
def inference_sentiment(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = {"Positive result attribute": "good", "Neutral result attribute": "plain", "Negative result attribute": "bad"}
    return run(spark, "HuggingFaceSentimentAnalysis", rows, attribute="p_name", predictor=moods, **names).drop("p_name")


@query("SELECT doc_id, substr(text, 1, 20) AS summary FROM documents")
def inference_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run(spark, "HuggingFaceTextSummarization", rows, attribute="text", predictor=first_words).drop("text")


@query("SELECT p_partkey, length(p_name) % 2 = 1 AS is_spam, length(p_name) / 100.0::DOUBLE AS score FROM part")
def inference_spam(spark, sf_dir):
    return run(spark, "HuggingFaceSpamSMSDetection", table(spark, sf_dir, "part").select("p_partkey", "p_name"), attribute="p_name", predictor=odd_lengths).drop("p_name")


_IRIS = "1 / (1 + exp(-(-2.5 * (p_size / 10.0::DOUBLE - 3.72666667) / 1.72528903 - 1.5 * (p_size / 20.0::DOUBLE - 1.17619048) / 0.73788937 + 0.5)))"


@query(f"SELECT p_partkey, CASE WHEN {_IRIS} > 0.5 THEN 'Iris-setosa' ELSE 'Not Iris-setosa' END AS \"Species_prediction\", round({_IRIS}, 9) AS \"Species_probability\" FROM part")
def inference_iris(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size AS double) / 10 AS long", "cast(p_size AS double) / 20 AS wide")
    out = run(spark, "HuggingFaceIrisLogisticRegression", rows, petalLengthCmAttribute="long", petalWidthCmAttribute="wide", weights=(-2.5, -1.5, 0.5))
    return out.select("p_partkey", "Species_prediction", F.round("Species_probability", 9).alias("Species_probability"))
