import pytest

from millrace.ml import models
from millrace.registry import PropertyError, load_all, make
from millrace.viz import charts


@pytest.fixture(scope="module")
def train(spark):
    import random

    r = random.Random(2)
    data = []
    for i in range(180):
        k = i % 3
        data.append((r.gauss(9 if k == 1 else 4, 0.6), r.gauss(9 if k == 2 else 4, 0.6), "abc"[k], float(k)))
    return spark.createDataFrame(data, "x double, y double, kind string, n double").coalesce(2).persist()


FAST = ["AdaptiveBoosting", "BernoulliNaiveBayes", "ComplementNaiveBayes", "DecisionTree", "DummyClassifier", "ExtraTree", "GaussianNaiveBayes", "KNN", "LogisticRegression", "MultinomialNaiveBayes", "NearestCentroid", "Perceptron", "ProbabilityCalibration", "RandomForest", "Ridge", "SVM"]


@pytest.mark.parametrize("name", FAST)
def test_classifiers_train_save_and_predict(spark, op, train, name):
    df = train.drop("n")
    model = op(f"SklearnTraining{name}", df, target="kind")
    assert model.columns == ["model_name", "model"] and model.count() == 1
    out = op("SklearnPrediction", model, df, **{"Ground Truth Attribute Name to Ignore": "kind"})
    share = out.where("prediction = kind").count() / df.count()
    assert share >= (0.3 if name in ("DummyClassifier", "BernoulliNaiveBayes", "ComplementNaiveBayes", "MultinomialNaiveBayes") else 0.6 if name in ("AdaptiveBoosting", "Perceptron") else 0.9), share


def test_every_model_has_both_operators():
    assert all(f"Sklearn{m}" in load_all() and f"SklearnTraining{m}" in load_all() for m in models.TRAINERS)
    assert len(models.TRAINERS) == 25


def test_text_regression_and_hyper_parameters(spark, op, train):
    texts = spark.createDataFrame([("good fine day", "p"), ("bad awful day", "n"), ("fine good", "p"), ("awful bad bad", "n")] * 5, "t string, target string")
    model = op("SklearnNearestCentroid", texts, texts, target="target", countVectorizer=True, text="t", tfidfTransformer=True)
    assert op("SklearnPrediction", model, texts).where("prediction = target").count() == 20
    nums = train.select("x", "y", "n")
    model = op("SklearnLinearRegression", nums, nums, target="n", degree=2)
    out = op("SklearnPrediction", model, nums, **{"Ground Truth Attribute Name to Ignore": "n"})
    score = op("Scorer", out, isRegression=True, actualValueColumn="n", predictValueColumn="prediction", regressionMetrics=["MSE", "R2"]).first()
    assert score.R2 > 0.8
    table = spark.createDataFrame([(1,), (7,)], "k int")
    got = op("KNNClassifierTrainer", train, table, groundTruthAttribute="kind", selectedFeatures=["x", "y"], paraList=[{"parameter": "n_neighbors", "attribute": "k", "parametersSource": True}])
    assert [r.Parameters for r in got.collect()] == ["n_neighbors=1", "n_neighbors=7"]
    one = op("SVRTrainer", train, table, groundTruthAttribute="n", selectedFeatures=["x", "y"], paraList=[{"parameter": "kernel", "value": "linear"}])
    assert one.count() == 1
    with pytest.raises(PropertyError):
        op("SklearnTrainingRidge", train, target="n")  # a text among the features


def test_inference_operators(spark, op):
    df = spark.createDataFrame([("free money",), (None,)], "t string")
    spam = op("HuggingFaceSpamSMSDetection", df, attribute="t", predictor=lambda ts: [{"label": "LABEL_1", "score": 0.9} for _ in ts])
    assert [tuple(r) for r in spam.collect()] == [("free money", True, 0.9), (None, None, None)]
    short = op("HuggingFaceTextSummarization", df, attribute="t", predictor=lambda ts: [t[:4] for t in ts])
    assert short.first().summary == "free"
    mood = op("HuggingFaceSentimentAnalysis", df, attribute="t", predictor=lambda ts: [[{"label": "positive", "score": 0.25}] for _ in ts])
    assert mood.first()[1] == 0.25
    iris = spark.createDataFrame([(1.4, 0.2), (5.0, 2.0)], "a double, b double")
    got = op("HuggingFaceIrisLogisticRegression", iris, petalLengthCmAttribute="a", petalWidthCmAttribute="b", weights=(-3.0, -3.0, -2.0)).collect()
    assert [r[2] for r in got] == ["Iris-setosa", "Not Iris-setosa"]


PROPERTIES = {
    "SankeyDiagram": {"Source Attribute": "s", "Target Attribute": "t", "Value Attribute": "x"}, "IcicleChart": {"hierarchy": [{"attributeName": "s"}], "value": "x"}, "HierarchyChart": {"hierarchy": [{"attributeName": "s"}, {"attributeName": "t"}], "value": "x"},
    "TimeSeriesPlot": {"timeColumn": "d", "valueColumn": "x"}, "CandlestickChart": {"date": "d", "open": "x", "high": "x", "low": "y", "close": "y"}, "ContourPlot": {"x": "x", "y": "y", "z": "z", "gridSize": "3"},
    "LineChart": {"lines": [{"xValue": "x", "yValue": "y", "name": "l"}]}, "WaterfallChart": {"xColumn": "s", "yColumn": "x"}, "BarChart": {"value": "x", "fields": "s"}, "RangeSlider": {"Y-axis": "y", "X-axis": "x", "Duplicates": "Sum"},
    "PieChart": {"value": "x", "name": "d"}, "QuiverPlot": {"x": "x", "y": "y", "u": "x", "v": "z"}, "WordCloud": {"textColumn": "s"}, "HTMLVisualizer": {"htmlContentAttrName": "s"}, "URLVisualizer": {"urlContentAttrName": "s"},
    "Scatterplot": {"xColumn": "x", "yColumn": "y", "colorColumn": "s", "hoverName": "t"}, "VolcanoPlot": {"effectColumn": "x", "pvalueColumn": "y"}, "FilledAreaPlot": {"x": "x", "y": "y"}, "DotPlot": {"Count Attribute": "s"},
    "TreePlot": {"Edge List Column": "e"}, "BubbleChart": {"xValue": "x", "yValue": "y", "zValue": "z"}, "BulletChart": {"value": "x", "deltaReference": "1"}, "GanttChart": {"start": "d", "finish": "d", "task": "s"},
    "GaugeChart": {"value": "x", "steps": [{"start": "0", "end": "2"}]}, "ImageVisualizer": {"binaryContent": "b"}, "DumbbellPlot": {"categoryColumnName": "s", "dumbbellStartValue": "one", "dumbbellEndValue": "two", "measurementColumnName": "x", "comparedColumnName": "t", "dots": [{"dotValue": "one"}]},
    "BoxViolinPlot": {"value": "x", "Quartile Method": "exclusive"}, "NetworkGraph": {"source": "s", "destination": "t"}, "Histogram": {"value": "x", "color": "s"}, "Histogram2D": {"xColumn": "x", "yColumn": "y"}, "ScatterMatrixChart": {"Selected Attributes": ["x", "y"], "Color": "s"},
    "HeatMap": {"x": "s", "y": "t", "Values": "x"}, "Scatter3DChart": {"x": "x", "y": "y", "z": "z"}, "FunnelPlot": {"x": "x", "y": "s"}, "TablesPlot": {"includedColumns": [{"attributeName": "s"}]}, "ContinuousErrorBands": {"bands": [{"xValue": "x", "yValue": "y", "yUpper": "x", "yLower": "y"}]},
    "FigureFactoryTable": {"columns": [{"attributeName": "s"}]}, "TernaryPlot": {"firstVariable": "x", "secondVariable": "y", "thirdVariable": "z"}, "Dendrogram": {"xVal": "x", "yVal": "y", "Labels": "s"}, "NestedTable": {"includedColumns": [{"attributeGroup": "g", "originalName": "x", "newName": "n"}]},
}


def test_every_chart_is_covered():
    assert {n for n, c in load_all().items() if issubclass(c, charts.Chart)} == set(PROPERTIES) and len(PROPERTIES) == 40


@pytest.mark.parametrize("name", sorted(PROPERTIES))
def test_charts_draw_and_say_when_they_cannot(spark, name):
    data = [("one", "p", 1.0, 2.0, 3.0, "2020-01-01", "[1, 2]", b"\xff\xd8\xff"), ("two", "q", 2.0, 0.5, 1.0, "2020-01-02", "[1, 3]", b"x"), ("three", "p", 4.0, 1.5, 2.0, "2020-01-03", "nonsense", None)]
    df = spark.createDataFrame(data, "s string, t string, x double, y double, z double, d string, e string, b binary").coalesce(1)
    out = make(name, **PROPERTIES[name]).apply(spark, [[df]])[0]
    assert out.columns == ["html-content"]
    page = out.first()[0]
    assert "not available" not in page
    if not issubclass(load_all()[name], charts._PerRow):
        assert out.count() == 1 and page.startswith("<!DOCTYPE html>")
        assert "not available" in make(name, **PROPERTIES[name]).apply(spark, [[df.limit(0)]])[0].first()[0]


def test_chart_details(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "s string, x double")
    assert "need to aggregate" in make("PieChart", value="x", name="s").html(df)
    assert "must differ" in make("BarChart", value="x", fields="x").html(df)
    for kind, q in (("linear", (1.75, 2.5, 3.25)), ("exclusive", (1.5, 2.5, 3.5)), ("inclusive", (1.5, 2.5, 3.5))):
        r = make("BoxViolinPlot", value="v", **{"Quartile Method": kind}).prepare(spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")).first()
        assert (r.q1, r.median, r.q3) == q
    five = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    assert make("BoxViolinPlot", value="v", **{"Quartile Method": "exclusive"}).prepare(five).first().q1 == 1.5
    assert make("BoxViolinPlot", value="v", **{"Quartile Method": "inclusive"}).prepare(five).first().q1 == 2.0
