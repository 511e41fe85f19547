"""Scores of predictions against true values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.ml.models import class_metrics
from millrace.registry import Operator, PropertyError, col, field_of, many, operator

CLASS = {"Accuracy": None, "Precision Score": "precision", "Recall Score": "recall", "F1 Score": "f1"}
ERRORS = ("MSE", "RMSE", "MAE", "R2")


@operator("Scorer", "Machine learning")
class Scorer(Operator):
    """Classification: a row per class of the true values (`class_` before it unless they are text), four decimals, and
    an Overall row for the accuracy if that is asked for. Regression: one row of errors."""

    actualValueColumn: str
    predictValueColumn: str
    isRegression: bool = False
    classificationMetrics: list = many()
    regressionMetrics: list = many()

    def run(self, spark, df):
        a, p = col(df, self.actualValueColumn), col(df, self.predictValueColumn)
        if self.isRegression:
            if unknown := [m for m in self.regressionMetrics if m not in ERRORS]:
                raise PropertyError(f"Scorer: no metric {unknown[0]!r}")
            x, y = a.cast("double"), p.cast("double")
            n, mse = F.count(x), F.avg((x - y) ** 2)
            values = {"MSE": mse, "RMSE": F.sqrt(mse), "MAE": F.avg(F.abs(x - y)), "R2": F.when(F.var_pop(x) > 0, 1 - mse / F.var_pop(x))}
            return df.agg(n.alias("__n"), *(values[m].alias(m) for m in self.regressionMetrics)).where("__n > 0").drop("__n")
        if unknown := [m for m in self.classificationMetrics if m not in CLASS]:
            raise PropertyError(f"Scorer: no metric {unknown[0]!r}")
        text = isinstance(field_of(df, self.actualValueColumn).dataType, T.StringType)
        label = F.col("label") if text else F.concat(F.lit("class_"), F.col("label"))
        pairs = df.select(a.alias("a"), p.alias("p"))
        missing = F.lit(None).cast("double")
        rows = class_metrics(pairs, "a", "p").select(label.alias("Class"), *((missing if CLASS[m] is None else F.round(CLASS[m], 4)).alias(m) for m in self.classificationMetrics))
        if "Accuracy" not in self.classificationMetrics:
            return rows
        hit = F.coalesce((F.col("a").cast("string") == F.col("p").cast("string")).cast("double"), F.lit(0.0))
        overall = pairs.agg(F.round(F.avg(hit), 4).alias("v")).select(F.lit("Overall").alias("Class"), *((F.col("v") if CLASS[m] is None else missing).alias(m) for m in self.classificationMetrics))
        return reduce(lambda x, y: x.unionAll(y), [overall, rows])
