"""Operators that apply pre-trained models to a text column, and the iris regression.

The models aren't part of this library: each operator takes `predictor`, a function from a list of texts to a list of
results, and without one asks the transformers package for its model.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from millrace.registry import Operator, PropertyError, col, new_name, operator, wire


def hub(task: str, model: str, **call) -> Callable[[list[str]], list]:
    """A predictor by the transformers package, loaded once per worker."""
    held: list = []

    def predict(texts: list[str]) -> list:
        if not held:
            try:
                from transformers import pipeline
            except ImportError as e:
                raise RuntimeError(f"{model}: the transformers package isn't installed; give a predictor") from e
            held.append(pipeline(task, model=model))
        return held[0](texts, **call)

    return predict


def predicted(predictor: Callable[[list[str]], list], shape: str, convert: Callable):
    """A column function of a text column; nulls aren't predicted."""

    @F.pandas_udf(shape)
    def run(texts: pd.Series) -> pd.DataFrame:
        there = texts.notna()
        got = iter(predictor(texts[there].tolist()) if there.any() else [])
        rows = [convert(next(got)) if ok else {} for ok in there]
        names = [c.split(" ")[0] for c in shape.split(", ")]
        return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    return run


@operator("HuggingFaceSentimentAnalysis", "Hugging Face")
class HuggingFaceSentimentAnalysis(Operator):
    """Adds how positive, neutral and negative a text is, to four decimals. Results are lists of label and score."""

    attribute: str
    positive: str = wire("Positive result attribute", "huggingface_sentiment_positive")
    neutral: str = wire("Neutral result attribute", "huggingface_sentiment_neutral")
    negative: str = wire("Negative result attribute", "huggingface_sentiment_negative")
    predictor: Callable | None = None

    def run(self, spark, df):
        names = [new_name(df, n) for n in (self.positive, self.neutral, self.negative)]
        model = self.predictor or hub("text-classification", "cardiffnlp/twitter-roberta-base-sentiment-latest", top_k=None, truncation=True)
        f = predicted(model, "positive double, neutral double, negative double", lambda r: {x["label"].lower(): round(float(x["score"]), 4) for x in r})
        out = df.withColumn("__s", f(col(df, self.attribute).cast("string")))
        return out.select(*(f"`{c}`" for c in df.columns), *(F.col(f"__s.{k}").alias(n) for k, n in zip(("positive", "neutral", "negative"), names, strict=True)))


@operator("HuggingFaceTextSummarization", "Hugging Face")
class HuggingFaceTextSummarization(Operator):
    """Adds a summary of a text, of which the model reads its first tokens as far as it can."""

    attribute: str
    result: str = wire("Result attribute name", "summary")
    predictor: Callable | None = None

    def run(self, spark, df):
        name = new_name(df, self.result)
        model = self.predictor or hub("summarization", "facebook/bart-large-cnn", truncation=True)
        f = predicted(model, "summary string", lambda r: {"summary": r if isinstance(r, str) else r["summary_text"]})
        return df.withColumn(name, f(col(df, self.attribute).cast("string"))["summary"])


@operator("HuggingFaceSpamSMSDetection", "Hugging Face")
class HuggingFaceSpamSMSDetection(Operator):
    """Adds whether a message is spam, and the score of that."""

    attribute: str
    spam: str = wire("Spam result attribute", "is_spam")
    score: str = wire("Score result attribute", "score")
    predictor: Callable | None = None

    def run(self, spark, df):
        names = [new_name(df, n) for n in (self.spam, self.score)]
        model = self.predictor or hub("text-classification", "mrm8488/bert-tiny-finetuned-sms-spam-detection", truncation=True)
        f = predicted(model, "spam boolean, score double", lambda r: {"spam": r["label"] == "LABEL_1", "score": float(r["score"])})
        out = df.withColumn("__s", f(col(df, self.attribute).cast("string")))
        return out.select(*(f"`{c}`" for c in df.columns), *(F.col(f"__s.{k}").alias(n) for k, n in zip(("spam", "score"), names, strict=True)))


# Means and deviations of the two features.
MEANS, DEVIATIONS = (3.72666667, 1.17619048), (1.72528903, 0.73788937)


@operator("HuggingFaceIrisLogisticRegression", "Hugging Face")
class HuggingFaceIrisLogisticRegression(Operator):
    """Adds class and probability of an iris being a setosa, from petal length and width: column arithmetic, once the
    weights (of length, of width, and the bias) are given."""

    length: str = wire("petalLengthCmAttribute")
    width: str = wire("petalWidthCmAttribute")
    predictedClass: str = wire("prediction class name", "Species_prediction")
    probability: str = wire("prediction probability name", "Species_probability")
    weights: tuple | None = None

    def run(self, spark, df):
        names = [new_name(df, n) for n in (self.predictedClass, self.probability)]
        if self.weights is None:
            raise PropertyError("HuggingFaceIrisLogisticRegression: the weights of the model are needed")
        a, b, c = self.weights
        x = [(col(df, n).cast("double") - m) / s for n, m, s in zip((self.length, self.width), MEANS, DEVIATIONS, strict=True)]
        p = 1 / (1 + F.exp(-(F.lit(float(a)) * x[0] + F.lit(float(b)) * x[1] + F.lit(float(c)))))
        return df.select("*", F.when(p > 0.5, "Iris-setosa").when(p.isNotNull(), "Not Iris-setosa").alias(names[0]), p.alias(names[1]))
