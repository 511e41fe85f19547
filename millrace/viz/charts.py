"""Chart operators: prepare() computes the data in Spark, run() draws them into one row of HTML.

prepare() always gives all data, aggregated where the chart is of aggregates. A page holds SHOWN rows at most:
of more, those of least hash are drawn, which doesn't depend on how rows are dealt out, and the page says how
many there are; charts that make sense as a whole only are refused instead.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types
from millrace.functions.quantiles import quantiles
from millrace.registry import Operator, PropertyError, col, field_of, many, operator, wire
from millrace.viz import render

SHOWN = 10_000
#: Nodes that are laid out by springs, and points that are clustered; both need all pairs on the driver.
NODES, CLUSTERED = 1000, 2000
HTML = "html-content"
NO_CHOICE = ("", "No Selection", None)


class Chart(Operator):
    """Base of charts: prepare() gives the data; title and drawing say how they are shown."""

    title = "Chart"
    #: kind of drawing, and the columns of the prepared data for x, y, colour, size
    drawing: tuple = ("points", None, None, None, None)

    def prepare(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def options(self) -> dict[str, Any]:
        return {k: v for k, v in vars(self).items() if isinstance(v, str | int | float | bool | list | dict) and v not in ("", [])}

    def draw(self, rows: list[dict]) -> str:
        kind, *columns = self.drawing
        return render.svg(rows, kind, *columns)

    #: Whether a part of the rows would be another chart.
    whole = False

    def html(self, df: DataFrame) -> str:
        note = ""
        try:
            data = self.prepare(df)
            found = data.limit(SHOWN + 1).collect()
            if len(found) > SHOWN:
                n = data.count()
                if self.whole:
                    raise PropertyError(f"it would have {n} rows, and a page holds {SHOWN}; filter or aggregate them first")
                kept = data.withColumn("__place", F.xxhash64(*data.columns)).orderBy("__place").limit(SHOWN).drop("__place")
                found, note = kept.collect(), f"{SHOWN} of {n} rows are drawn."
            rows = [r.asDict(recursive=True) for r in found]
            if not rows:
                return render.error_page(self.title, "the input table is empty, or none of its rows can be shown.")
            return render.page(self.title, self.draw(rows), rows, self.options(), note)
        except PropertyError as e:
            return render.error_page(self.title, str(e))

    def run(self, spark, df):
        return spark.createDataFrame([(self.html(df),)], T.StructType([T.StructField(HTML, T.StringType())]))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Columns of these names, each once."""
    found = dict.fromkeys(field_of(df, n).name for n in names if n not in NO_CHOICE)
    return df.select(*(col(df, n) for n in found))


def full(df: DataFrame, *names: str) -> DataFrame:
    """Those columns, of rows in which none of them is null."""
    return pick(df, *names).dropna()


def numeric(df: DataFrame, *names: str) -> None:
    for n in names:
        if types.name_of(field_of(df, n).dataType) not in ("integer", "long", "double"):
            raise PropertyError(f"column {n} is no number")


def given(**values: Any) -> None:
    for k, v in values.items():
        if v in NO_CHOICE or v == []:
            raise PropertyError(f"{k} isn't given")


def bins(c: Column, low: float, high: float, n: int) -> Column:
    """Bin 0 to n - 1 of equal width; the upper edge belongs to the last."""
    span = (high - low) or 1.0
    return F.least(F.floor((c - F.lit(low)) / F.lit(span) * n), F.lit(n - 1)).cast("int")


@operator("SankeyDiagram", "Visualization - Basic")
class SankeyDiagram(Chart):
    """Sum of values for each source and target."""

    title = "Sankey diagram"
    source: str = wire("Source Attribute")
    target: str = wire("Target Attribute")
    value: str = wire("Value Attribute")

    def prepare(self, df):
        return df.groupBy(col(df, self.source).alias("source"), col(df, self.target).alias("target")).agg(F.sum(col(df, self.value)).alias("value"))

    whole = True

    def draw(self, rows):
        return render.flows([(r["source"], r["target"], float(r["value"])) for r in rows if (r["value"] or 0) > 0])


class _Hierarchy(Chart):
    """Sums of the positive values at every level of a path of columns; rows with a null on the path are left out."""

    def prepare(self, df):
        given(hierarchy=self.hierarchy, value=self.value)
        path = [field_of(df, h["attributeName"]).name for h in self.hierarchy]
        v = col(df, self.value)
        rows = df.select(*(col(df, p).cast("string").alias(f"level{i}") for i, p in enumerate(path)), F.when(v > 0, v).alias("value")).dropna(subset=[f"level{i}" for i in range(len(path))])
        # A row per node: the levels below it are null, depth says how many aren't.
        levels = [f"level{i}" for i in range(len(path))]
        return rows.rollup(*levels).agg(F.sum("value").alias("value"), F.grouping_id().alias("g")).select(*levels, (len(path) - F.bit_count("g")).cast("int").alias("depth"), "value").where("depth > 0")

    whole = True
    shape = "icicle"

    def draw(self, rows):
        levels = [c for c in rows[0] if c.startswith("level")]
        root: dict[str, Any] = {"name": "", "value": 0, "children": []}
        nodes: dict[tuple, dict] = {(): root}
        for r in sorted(rows, key=lambda r: r["depth"]):
            path = tuple(r[c] for c in levels[: r["depth"]])
            nodes[path] = {"name": path[-1], "value": float(r["value"] or 0), "children": []}
            nodes[path[:-1]]["children"].append(nodes[path])
        return render.shares(root, self.shape)


@operator("IcicleChart", "Visualization - Advanced")
class IcicleChart(_Hierarchy):
    title = "Icicle chart"
    value: str
    hierarchy: list = many()


@operator("HierarchyChart", "Visualization - Advanced")
class HierarchyChart(_Hierarchy):
    title = "Hierarchy chart"
    value: str
    hierarchy: list = many()
    hierarchyChartType: str = "treemap"

    @property
    def shape(self) -> str:
        return "sunburst" if "sunburst" in self.hierarchyChartType.lower() else "treemap"


@operator("TimeSeriesPlot", "Visualization - Basic")
class TimeSeriesPlot(Chart):
    """Values in order of time; texts that are no time are left out."""

    title = "Time series"
    drawing = ("line", "time", "value", "category")
    timeColumn: str
    valueColumn: str
    categoryColumn: str = wire("CategoryColumn", "No Selection")
    facetColumn: str = "No Selection"
    line: str = "line"
    slider: bool = False

    def prepare(self, df):
        f, t = field_of(df, self.timeColumn), col(df, self.timeColumn)
        time = types.parse_timestamp(t) if isinstance(f.dataType, T.StringType) else t.cast("timestamp")
        more = [col(df, n).alias(a) for n, a in ((self.categoryColumn, "category"), (self.facetColumn, "facet")) if n not in NO_CHOICE]
        return df.select(time.alias("time"), col(df, self.valueColumn).alias("value"), *more).dropna().orderBy("time")


@operator("CandlestickChart", "Visualization - Financial")
class CandlestickChart(Chart):
    title = "Candlestick chart"
    drawing = ("line", "date", "close")
    date: str
    open: str
    high: str
    low: str
    close: str

    def prepare(self, df):
        return df.select(*(col(df, getattr(self, n)).alias(n) for n in ("date", "open", "high", "low", "close")))


@operator("ContourPlot", "Visualization - Scientific")
class ContourPlot(Chart):
    """Mean z of each cell of a square grid over x and y; cells without points are filled from their neighbours if gaps are connected."""

    title = "Contour plot"
    x: str
    y: str
    z: str
    gridSize: str = "10"
    connectGaps: bool = True
    coloring: str = wire("Coloring Method", "heatmap")

    def prepare(self, df):
        n = int(self.gridSize)
        if n <= 0:
            raise PropertyError("the grid's size must be positive")
        numeric(df, self.x, self.y, self.z)
        rows = df.select(*(col(df, c).cast("double").alias(a) for c, a in ((self.x, "x"), (self.y, "y"), (self.z, "z")))).dropna()
        low = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if low[0] is None:
            return rows.select(F.lit(0).alias("x_bin"), F.lit(0).alias("y_bin"), "z")
        return rows.groupBy(bins(F.col("x"), low[0], low[1], n).alias("x_bin"), bins(F.col("y"), low[2], low[3], n).alias("y_bin")).agg(F.avg("z").alias("z"))

    def draw(self, rows):
        n = int(self.gridSize)
        grid = np.full((n, n), np.nan)
        for r in rows:
            grid[r["y_bin"], r["x_bin"]] = r["z"]
        while self.connectGaps and np.isnan(grid).any() and not np.isnan(grid).all():
            wide = np.pad(grid, 1, constant_values=np.nan)
            near = np.stack([wide[1:-1, :-2], wide[1:-1, 2:], wide[:-2, 1:-1], wide[2:, 1:-1]])
            count = (~np.isnan(near)).sum(0)
            mean = np.nansum(near, axis=0) / np.maximum(count, 1)
            grid = np.where(np.isnan(grid) & (count > 0), mean, grid)
        return render.cells([[None if np.isnan(v) else float(v) for v in row] for row in grid])


class _Traces(Chart):
    """Traces that lie over each other: of each its number, name, x and y."""

    drawing = ("line", "x", "y", "trace")
    wanted: tuple[str, ...] = ()

    def traces(self) -> list[dict]:
        raise NotImplementedError

    def prepare(self, df):
        lines = self.traces()
        given(lines=lines)
        out = None
        for i, t in enumerate(lines):
            more = [col(df, t[w]).cast("double").alias(a) for w, a in self.wanted]
            part = df.select(F.lit(i).alias("trace"), F.lit(t.get("name") or t["yValue"]).alias("name"), col(df, t["xValue"]).cast("string").alias("x"), col(df, t["yValue"]).cast("double").alias("y"), *more)
            out = part if out is None else out.unionAll(part)
        return out


@operator("LineChart", "Visualization - Basic")
class LineChart(_Traces):
    title = "Line chart"
    yLabel: str = ""
    xLabel: str = ""
    lines: list = many()

    def traces(self):
        return self.lines


@operator("ContinuousErrorBands", "Visualization - Statistical")
class ContinuousErrorBands(_Traces):
    title = "Continuous error bands"
    wanted = (("yUpper", "upper"), ("yLower", "lower"))
    xLabel: str = ""
    yLabel: str = ""
    bands: list = many()

    def traces(self):
        return self.bands


@operator("WaterfallChart", "Visualization - Financial")
class WaterfallChart(Chart):
    title = "Waterfall chart"
    drawing = ("bar", "x", "y")
    xColumn: str
    yColumn: str

    def prepare(self, df):
        return df.select(col(df, self.xColumn).alias("x"), col(df, self.yColumn).alias("y"))


@operator("BarChart", "Visualization - Basic")
class BarChart(Chart):
    """Sum of the value for each field and category; rows with a null are left out."""

    title = "Bar chart"
    drawing = ("bar", "field", "value", "category")
    value: str
    fields: str
    categoryColumn: str = "No Selection"
    horizontalOrientation: bool = False
    pattern: str = ""

    def prepare(self, df):
        if self.value == self.fields:
            raise PropertyError("value and fields must differ")
        keys = [col(df, self.fields).alias("field")] + ([col(df, self.categoryColumn).alias("category")] if self.categoryColumn not in NO_CHOICE else [])
        rows = df.select(*keys, col(df, self.value).alias("value")).dropna()
        return rows.groupBy(*(c for c in rows.columns if c != "value")).agg(F.sum("value").alias("value"))

    def draw(self, rows):
        kind, x, y, c = self.drawing
        return render.svg(rows, kind, x, y, c if c in rows[0] else None)


@operator("RangeSlider", "Visualization - Basic")
class RangeSlider(Chart):
    """y over x, with the rows of one x as they are, their mean or their sum."""

    title = "Range slider"
    drawing = ("line", "x", "y")
    yAxis: str = wire("Y-axis")
    xAxis: str = wire("X-axis")
    duplicates: str = wire("Duplicates", "Nothing")

    def prepare(self, df):
        rows = df.select(col(df, self.xAxis).alias("x"), col(df, self.yAxis).alias("y")).dropna()
        kind = self.duplicates.lower()
        if kind == "nothing":
            return rows.orderBy("x")
        if kind not in ("mean", "sum"):
            raise PropertyError(f"no way {self.duplicates!r} to treat duplicates")
        return rows.groupBy("x").agg((F.avg if kind == "mean" else F.sum)("y").alias("y")).orderBy("x")


@operator("PieChart", "Visualization - Basic")
class PieChart(Chart):
    """Values by name; names must differ."""

    title = "Pie chart"
    drawing = ("ring", "name", "value")
    value: str
    slice: str = wire("name")

    def prepare(self, df):
        rows = df.select(col(df, self.slice).alias("name"), col(df, self.value).alias("value")).dropna()
        if not rows.groupBy("name").count().where("count > 1").isEmpty():
            raise PropertyError("duplicates in the name column, need to aggregate")
        return rows


@operator("QuiverPlot", "Visualization - Scientific")
class QuiverPlot(Chart):
    title = "Quiver plot"
    drawing = ("points", "x", "y")
    x: str
    y: str
    u: str
    v: str

    def prepare(self, df):
        numeric(df, self.x, self.y, self.u, self.v)
        return df.dropna().select(*(col(df, getattr(self, n)).alias(n) for n in ("x", "y", "u", "v")))


# Words that a word cloud leaves out.
CLOUD_STOP = set(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can com could did do does doing down during each else ever few for from "
    "further get had has have having he hence her here hers herself him himself his how however http i if in into is it its itself just k let like me more most my myself no nor not of off on once only "
    "or other otherwise ought our ours ourselves out over own r same shall she should since so some such than that the their theirs them themselves then there therefore these they this those through "
    "to too under until up very was we were what when where which while who whom why with would www you your yours yourself yourselves".split()
)


@operator("WordCloud", "Visualization - Basic")
class WordCloud(Chart):
    """The most frequent words of all texts, without case and stop words."""

    title = "Word cloud"
    drawing = ("bar", "word", "count")
    textColumn: str
    topN: int = 100

    def prepare(self, df):
        if self.topN <= 0:
            raise PropertyError("the number of words must be positive")
        words = F.regexp_extract_all(F.lower(col(df, self.textColumn).cast("string")), F.lit(r"(?U)\w[\w']+"), F.lit(0))
        each = df.select(F.explode(words).alias("word"))
        return each.where(~F.col("word").isin(sorted(CLOUD_STOP))).groupBy("word").count().orderBy(F.desc("count"), "word").limit(self.topN)


class _PerRow(Chart):
    """One row of HTML per row of input."""

    def cell(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def prepare(self, df):
        return df.select(self.cell(df).alias(HTML))

    def run(self, spark, df):
        return self.prepare(df)


@operator("HTMLVisualizer", "Visualization - Media")
class HTMLVisualizer(_PerRow):
    htmlContentAttrName: str

    def cell(self, df):
        return col(df, self.htmlContentAttrName).cast("string")


@operator("URLVisualizer", "Visualization - Media")
class URLVisualizer(_PerRow):
    """A page that frames the URL."""

    urlContentAttrName: str

    def cell(self, df):
        return F.concat(F.lit('<!DOCTYPE html><html lang="en"><body><div class="modal-body"><iframe src="'), col(df, self.urlContentAttrName).cast("string"), F.lit('" frameborder="0" style="height:100vh; width:100%; border:none;"></iframe></div></body></html>'))


class _Points(Chart):
    """Rows in which no shown column is null."""

    shown: tuple[str, ...] = ()

    def names(self) -> list[str]:
        return [getattr(self, s) for s in self.shown if getattr(self, s) not in NO_CHOICE]

    def prepare(self, df):
        return full(df, *self.names())

    def draw(self, rows):
        columns = list(rows[0])
        return render.svg(rows, "points", *(columns + [None] * 2)[:2])


@operator("Scatterplot", "Visualization - Basic")
class Scatterplot(_Points):
    title = "Scatter plot"
    shown = ("xColumn", "yColumn", "colorColumn", "hoverName")
    xColumn: str
    yColumn: str
    alpha: float = 1.0
    colorColumn: str = "No Selection"
    xLogScale: bool = False
    yLogScale: bool = False
    hoverName: str = "No Selection"

    def prepare(self, df):
        points = full(df, self.xColumn, self.yColumn, self.colorColumn)
        if self.hoverName not in NO_CHOICE and self.hoverName not in points.columns:
            keep = [self.xColumn, self.yColumn, *([self.colorColumn] if self.colorColumn not in NO_CHOICE else [])]
            points = pick(df, *keep, self.hoverName).dropna(subset=list(dict.fromkeys(field_of(df, k).name for k in keep)))
        return points


@operator("VolcanoPlot", "Visualization - Scientific")
class VolcanoPlot(Chart):
    """Effect and minus the decimal logarithm of positive p-values."""

    title = "Volcano plot"
    drawing = ("points", "effect", "neg_log10_p")
    effectColumn: str
    pvalueColumn: str

    def prepare(self, df):
        p = col(df, self.pvalueColumn)
        return df.where(p > 0).select(col(df, self.effectColumn).alias("effect"), (-F.log10(p)).alias("neg_log10_p"))


@operator("FilledAreaPlot", "Visualization - Basic")
class FilledAreaPlot(Chart):
    """Areas by group; groups must have nearly the same x values (5 % of them may differ)."""

    title = "Filled area plot"
    x: str
    y: str
    lineGroup: str = "No Selection"
    color: str = "No Selection"
    facetColumn: bool = False
    pattern: str = ""

    def prepare(self, df):
        given(x=self.x, y=self.y)
        if self.facetColumn and self.lineGroup in NO_CHOICE:
            raise PropertyError("a facet needs a line group")
        rows = full(df, self.x, self.y, self.lineGroup, self.color)
        if self.lineGroup not in NO_CHOICE:
            g, x = col(rows, self.lineGroup), col(rows, self.x)
            per = rows.select(g.alias("g"), x.alias("x")).distinct()
            total, groups = per.agg(F.count_distinct("x"), F.count_distinct("g")).first()
            missing = total * groups - per.count()
            if groups and missing > 0.05 * total * groups:
                raise PropertyError("groups have different x values")
        return rows

    def draw(self, rows):
        return render.svg(rows, "line", self.x, self.y, None if self.lineGroup in NO_CHOICE else self.lineGroup)


@operator("DotPlot", "Visualization - Basic")
class DotPlot(Chart):
    """How often each value stands."""

    title = "Dot plot"
    drawing = ("points", "value", "count")
    countAttribute: str = wire("Count Attribute")

    def prepare(self, df):
        return df.groupBy(col(df, self.countAttribute).alias("value")).agg(F.count(F.lit(1)).alias("count"))


@operator("TreePlot", "Visualization - Advanced")
class TreePlot(Chart):
    """Edges from texts of the form [parent, child]; others are left out. Nodes are laid out by depth."""

    title = "Tree plot"
    edgeListColumn: str = wire("Edge List Column")

    def prepare(self, df):
        text = col(df, self.edgeListColumn).cast("string")
        part = r"\s*(?:'([^']*)'|\"([^\"]*)\"|([^\[\],'\"\s][^\[\],'\"]*?))\s*"
        shape = rf"^\s*[\[(]{part},{part}[\])]\s*$"
        side = lambda k: F.coalesce(*(F.nullif(F.regexp_extract(text, shape, k + i), F.lit("")) for i in range(3)))
        return df.where(text.rlike(shape)).select(side(1).alias("parent"), side(4).alias("child")).dropna()

    def draw(self, rows):
        children = {r["child"] for r in rows}
        depth = {r["parent"]: 0 for r in rows if r["parent"] not in children}
        todo = list(depth)
        while todo:
            todo = [r["child"] for r in rows if r["parent"] in todo and r["child"] not in depth and not depth.update({r["child"]: depth[r["parent"]] + 1})]
        deepest, rank = max(depth.values(), default=0) or 1, {}
        for n in sorted(depth, key=lambda n: (depth[n], str(n))):
            rank.setdefault(depth[n], []).append(n)
        places = {n: ((i + 0.5) / len(names), d / deepest) for d, names in rank.items() for i, n in enumerate(names)}
        return render.graph(places, [(r["parent"], r["child"]) for r in rows if r["parent"] in places and r["child"] in places])

    whole = True


@operator("BubbleChart", "Visualization - Basic")
class BubbleChart(_Points):
    title = "Bubble chart"
    xValue: str
    yValue: str
    zValue: str
    enableColor: bool = False
    colorCategory: str = "No Selection"

    def names(self):
        return [self.xValue, self.yValue, self.zValue] + ([self.colorCategory] if self.enableColor and self.colorCategory not in NO_CHOICE else [])

    def draw(self, rows):
        return render.svg(rows, "points", self.xValue, self.yValue, self.colorCategory if self.enableColor else None, self.zValue)


class _Indicator(Chart):
    """One indicator for each row that has a value, with the same reference, threshold and steps."""

    drawing = ("bar", "value", "value")
    limits: tuple[str, str] = ("", "")

    def prepare(self, df):
        given(value=self.value)
        numeric(df, self.value)
        extra = []
        for name, alias in zip(self.limits, ("delta", "threshold"), strict=True):
            text = str(getattr(self, name) or "").strip()
            extra.append(F.lit(float(text) if types._is_double(text) else None).cast("double").alias(alias))
        return df.select(col(df, self.value).cast("double").alias("value"), *extra).where(F.col("value").isNotNull())

    def bands(self) -> list[tuple[float, float]]:
        return [(float(s["start"]), float(s["end"])) for s in self.steps if types._is_double(str(s.get("start", "")).strip()) and types._is_double(str(s.get("end", "")).strip())]

    def options(self):
        return super().options() | {"bands": self.bands()}


@operator("BulletChart", "Visualization - Financial")
class BulletChart(_Indicator):
    title = "Bullet chart"
    limits = ("deltaReference", "thresholdValue")
    value: str
    deltaReference: str = ""
    thresholdValue: str = ""
    steps: list = many()


@operator("GaugeChart", "Visualization - Financial")
class GaugeChart(_Indicator):
    title = "Gauge chart"
    limits = ("delta", "threshold")
    value: str
    delta: str = ""
    threshold: str = ""
    steps: list = many()


@operator("GanttChart", "Visualization - Basic")
class GanttChart(Chart):
    """Tasks with start and finish; rows with a null in one of these, or in the colour, are left out."""

    title = "Gantt chart"
    start: str
    finish: str
    task: str
    color: str = "No Selection"
    pattern: str = ""

    def prepare(self, df):
        need = [self.start, self.finish, *([self.color] if self.color not in NO_CHOICE else [])]
        rows = pick(df, *need, self.task)
        return rows.dropna(subset=list(dict.fromkeys(field_of(df, n).name for n in need)))

    def draw(self, rows):
        return render.svg(rows, "points", self.start, self.task, None if self.color in NO_CHOICE else self.color)


@operator("ImageVisualizer", "Visualization - Media")
class ImageVisualizer(Chart):
    """All images of a binary column in one page."""

    title = "Image visualizer"
    binaryContent: str

    def prepare(self, df):
        c = col(df, self.binaryContent)
        if not isinstance(field_of(df, self.binaryContent).dataType, T.BinaryType):
            raise PropertyError(f"{self.binaryContent} isn't binary")
        head = F.hex(F.substring(c, 1, 3))
        kind = F.when(head == "FFD8FF", "jpeg").when(head == "474946", "gif").otherwise("png")
        return df.where(c.isNotNull()).select(F.concat(F.lit('<img src="data:image/'), kind, F.lit(";base64,"), F.regexp_replace(F.base64(c), r"\s", ""), F.lit('" style="max-width:100%">')).alias("image"))

    def draw(self, rows):
        return "".join(r["image"] for r in rows)


@operator("DumbbellPlot", "Visualization - Basic")
class DumbbellPlot(Chart):
    """For each entity the (greatest) measure at two values of a category, and at the dots' values."""

    title = "Dumbbell plot"
    drawing = ("points", "start", "entity")
    categoryColumnName: str
    dumbbellStartValue: str
    dumbbellEndValue: str
    measurementColumnName: str
    comparedColumnName: str
    dots: list = many()
    showLegends: bool = False

    def prepare(self, df):
        c, m = col(df, self.categoryColumnName).cast("string"), col(df, self.measurementColumnName)
        at = lambda v: F.max(F.when(c == v, m))
        dots = [d["dotValue"] for d in self.dots]
        rows = df.where(c.isin([self.dumbbellStartValue, self.dumbbellEndValue, *dots]))
        out = rows.groupBy(col(df, self.comparedColumnName).alias("entity")).agg(at(self.dumbbellStartValue).alias("start"), at(self.dumbbellEndValue).alias("end"), *(at(d).alias(f"dot_{i}") for i, d in enumerate(dots)))
        return out.where(F.col("start").isNotNull() | F.col("end").isNotNull())


@operator("BoxViolinPlot", "Visualization - Statistical")
class BoxViolinPlot(Chart):
    """Least, quartiles and greatest value, and the count. Linear quartiles interpolate between all values; exclusive
    ones take the medians of the halves without the middle value, inclusive ones with it."""

    title = "Box plot"
    value: str
    quartiles: str = wire("Quartile Method", "linear")
    horizontalOrientation: bool = False
    violinPlot: bool = False

    def prepare(self, df):
        numeric(df, self.value)
        rows = df.select(col(df, self.value).cast("double").alias("v")).dropna()
        kind = self.quartiles.lower()
        size = rows.count()
        if kind == "linear":
            at = [0.25, 0.5, 0.75]
        elif kind in ("inclusive", "exclusive"):
            # Medians of the halves, as places between 0 and 1 of all values.
            half = (size + (1 if kind == "inclusive" else 0)) // 2 if size > 1 else size
            low = (half - 1) / 2 / max(size - 1, 1) if size else 0.0
            at = [low, 0.5, 1 - low if size > 1 else 0.0]
        else:
            raise PropertyError(f"no quartile method {self.quartiles!r}")
        found = [F.lit(q).cast("double").alias(name) for q, name in zip(quantiles(rows, "v", at), ("q1", "median", "q3"), strict=True)]
        return rows.agg(F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("count")).select("min", *found, "max", "count").where("count > 0")

    def draw(self, rows):
        r = rows[0]
        return render.box(*(float(r[k]) for k in ("min", "q1", "median", "q3", "max")), bool(self.horizontalOrientation))


@operator("NetworkGraph", "Visualization - Advanced")
class NetworkGraph(Chart):
    """Different edges between nodes that aren't null, laid out by springs."""

    title = "Network graph"
    source: str
    destination: str
    caption: str = wire("title", "Network graph")

    def prepare(self, df):
        return df.select(col(df, self.source).cast("string").alias("source"), col(df, self.destination).cast("string").alias("destination")).dropna().distinct()

    def nodes(self, df: DataFrame) -> DataFrame:
        e = self.prepare(df)
        return e.select(F.col("source").alias("node")).union(e.select("destination")).distinct()

    def draw(self, rows):
        names = sorted({r["source"] for r in rows} | {r["destination"] for r in rows})
        if len(names) > NODES:
            raise PropertyError(f"it would have {len(names)} nodes, and {NODES} can be laid out; filter them first")
        at = {n: i for i, n in enumerate(names)}
        pairs = np.array([(at[r["source"]], at[r["destination"]]) for r in rows])
        place = np.random.default_rng(1).uniform(-1, 1, (len(names), 2))
        for k in range(50):
            gap = place[:, None] - place[None]
            far = np.maximum((gap**2).sum(2), 1e-4)
            push = (gap / far[..., None]).sum(1) / len(names)
            if len(pairs):
                pull = place[pairs[:, 1]] - place[pairs[:, 0]]
                np.add.at(push, pairs[:, 0], pull)
                np.add.at(push, pairs[:, 1], -pull)
            place += np.clip(push, -1, 1) * 0.1 * (1 - k / 50)
        low, high = place.min(axis=0), place.max(axis=0)
        share = (place - low) / np.maximum(high - low, 1e-9)
        return render.graph({n: (float(x), float(y)) for n, (x, y) in zip(names, share, strict=True)}, [(r["source"], r["destination"]) for r in rows])

    whole = True


@operator("Histogram", "Visualization - Statistical")
class Histogram(Chart):
    """Counts of values in ten equal bins, by colour and facet."""

    title = "Histogram"
    drawing = ("bar", "bin", "count")
    value: str
    color: str = "No Selection"
    separateBy: str = "No Selection"
    marginal: str = ""
    pattern: str = ""
    bins: int = 10

    def prepare(self, df):
        numeric(df, self.value)
        more = [col(df, n).alias(a) for n, a in ((self.color, "color"), (self.separateBy, "facet")) if n not in NO_CHOICE]
        rows = df.select(col(df, self.value).cast("double").alias("v"), *more).where(F.col("v").isNotNull())
        low, high = rows.agg(F.min("v"), F.max("v")).first()
        low, high = low or 0.0, high or 0.0
        width = (high - low or 1.0) / self.bins
        keys = [c for c in rows.columns if c != "v"]
        counted = rows.groupBy(bins(F.col("v"), low, high, self.bins).alias("bin"), *keys).agg(F.count(F.lit(1)).alias("count"))
        return counted.select("bin", (F.lit(low) + F.col("bin") * width).alias("from"), *keys, "count").orderBy("bin")


@operator("Histogram2D", "Visualization - Statistical")
class Histogram2D(Chart):
    """Counts of points in a grid, as they are (density) or as shares (probability) or percent of all."""

    title = "2D histogram"
    xColumn: str
    yColumn: str
    xBins: int = 10
    yBins: int = 10
    normalize: str = "density"

    def prepare(self, df):
        if self.xBins <= 0 or self.yBins <= 0:
            raise PropertyError("the numbers of bins must be positive")
        numeric(df, self.xColumn, self.yColumn)
        rows = df.select(col(df, self.xColumn).cast("double").alias("x"), col(df, self.yColumn).cast("double").alias("y")).dropna()
        e = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("x")).first()
        a, b, c, d = (v or 0.0 for v in e[:4])
        counted = rows.groupBy(bins(F.col("x"), a, b, self.xBins).alias("x_bin"), bins(F.col("y"), c, d, self.yBins).alias("y_bin")).agg(F.count(F.lit(1)).alias("n"))
        area = ((b - a) or 1.0) / self.xBins * (((d - c) or 1.0) / self.yBins)
        n, total = F.col("n"), F.lit(float(e[4] or 1))
        value = {"density": n / (total * area), "probability": n / total, "percent": 100 * n / total}.get(self.normalize.lower())
        if value is None:
            raise PropertyError(f"no normalization {self.normalize!r}")
        return counted.select("x_bin", "y_bin", value.alias("value"))

    def draw(self, rows):
        return render.svg(rows, "points", "x_bin", "y_bin", None, "value")


@operator("ScatterMatrixChart", "Visualization - Statistical")
class ScatterMatrixChart(Chart):
    title = "Scatter matrix"
    selected: list = wire("Selected Attributes", [])
    color: str = wire("Color", "No Selection")

    def prepare(self, df):
        given(attributes=self.selected)
        return pick(df, *self.selected, self.color)

    def draw(self, rows):
        return "".join(render.svg(rows, "points", a, b) for a in self.selected for b in self.selected if a != b)


@operator("HeatMap", "Visualization - Scientific")
class HeatMap(Chart):
    title = "Heat map"
    drawing = ("points", "x", "y", None, "value")
    x: str
    y: str
    value: str = wire("Values")

    def prepare(self, df):
        return df.select(col(df, self.x).alias("x"), col(df, self.y).alias("y"), col(df, self.value).alias("value"))


@operator("Scatter3DChart", "Visualization - Advanced")
class Scatter3DChart(Chart):
    title = "3D scatter chart"
    drawing = ("points", "x", "y", None, "z")
    x: str
    y: str
    z: str

    def prepare(self, df):
        given(x=self.x, y=self.y, z=self.z)
        return df.select(*(col(df, getattr(self, n)).alias(n) for n in "xyz"))


@operator("FunnelPlot", "Visualization - Financial")
class FunnelPlot(Chart):
    title = "Funnel plot"
    drawing = ("bar", "y", "x", None)
    x: str
    y: str
    color: str = "No Selection"

    def prepare(self, df):
        more = [col(df, self.color).alias("color")] if self.color not in NO_CHOICE else []
        return df.select(col(df, self.x).alias("x"), col(df, self.y).alias("y"), *more)


class _Table(Chart):
    def chosen(self) -> list[str]:
        raise NotImplementedError

    def prepare(self, df):
        given(columns=self.chosen())
        return full(df, *self.chosen())

    def draw(self, rows):
        return render.table(rows, list(rows[0]))


@operator("TablesPlot", "Visualization - Basic")
class TablesPlot(_Table):
    title = "Table"
    includedColumns: list = many()

    def chosen(self):
        return [c["attributeName"] for c in self.includedColumns]


@operator("FigureFactoryTable", "Visualization - Basic")
class FigureFactoryTable(_Table):
    title = "Figure factory table"
    fontSize: str = "12"
    fontColor: str = "#000000"
    rowHeight: str = "30"
    columns: list = many()

    def chosen(self):
        for k in ("fontSize", "rowHeight"):
            if not types._is_double(str(getattr(self, k))) or float(getattr(self, k)) < 0:
                raise PropertyError(f"{k} must be a number of 0 or more")
        return [c["attributeName"] for c in self.columns]

    def draw(self, rows):
        return render.table(rows, list(rows[0]), f"font-size:{float(self.fontSize)}px;color:{self.fontColor};line-height:{float(self.rowHeight)}px")


@operator("NestedTable", "Visualization - Basic")
class NestedTable(Chart):
    """Columns under the headings of their groups, renamed; numbers to two decimals."""

    title = "Nested table"
    includedColumns: list = many()

    def prepare(self, df):
        given(columns=self.includedColumns)
        groups: dict[str, list[Column]] = {}
        for c in self.includedColumns:
            f, name = field_of(df, c["originalName"]), (c.get("newName") or "").strip() or c["originalName"]
            v = col(df, f.name)
            groups.setdefault(c["attributeGroup"], []).append((F.round(v, 2) if isinstance(f.dataType, T.DoubleType) else v).alias(name))
        return df.select(*(F.struct(*columns).alias(g) for g, columns in groups.items()))

    def draw(self, rows):
        return render.table([{f"{g} / {k}": v for g, part in r.items() for k, v in (part or {}).items()} for r in rows], [f"{g} / {k}" for g, part in rows[0].items() for k in part])


@operator("TernaryPlot", "Visualization - Scientific")
class TernaryPlot(_Points):
    title = "Ternary plot"
    firstVariable: str
    secondVariable: str
    thirdVariable: str
    colorEnabled: bool = False
    colorDataField: str = "No Selection"

    def names(self):
        return [self.firstVariable, self.secondVariable, self.thirdVariable] + ([self.colorDataField] if self.colorEnabled and self.colorDataField not in NO_CHOICE else [])

    def draw(self, rows):
        out = []
        for r in rows:
            a, b, c = (float(r[n]) for n in self.names()[:3])
            total = (a + b + c) or 1.0
            out.append({"x": (b + c / 2) / total, "y": c / total * 0.866})
        return render.svg(out, "points", "x", "y")


def merges(points: np.ndarray) -> list[tuple[int, int, float]]:
    """Complete-linkage clustering: of each step the two clusters that are joined and their distance; new ones count on."""
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    ids, out = list(range(len(points))), []
    while len(ids) > 1:
        i, j = sorted(map(int, np.unravel_index(np.argmin(gap), gap.shape)))
        out.append((ids[i], ids[j], float(gap[i, j])))
        gap[i] = gap[:, i] = np.maximum(gap[i], gap[j])
        gap[i, i] = np.inf
        gap = np.delete(np.delete(gap, j, 0), j, 1)
        ids[i] = len(points) + len(out) - 1
        del ids[j]
    return out


@operator("Dendrogram", "Visualization - Advanced")
class Dendrogram(Chart):
    """Complete-linkage clustering of labelled points; more than CLUSTERED are refused, as all pairs are looked at."""

    title = "Dendrogram"
    whole = True
    xVal: str
    yVal: str
    labels: str = wire("Labels")
    threshold: str = ""

    def prepare(self, df):
        numeric(df, self.xVal, self.yVal)
        return df.select(col(df, self.xVal).cast("double").alias("x"), col(df, self.yVal).cast("double").alias("y"), col(df, self.labels).cast("string").alias("label")).dropna()

    def clusters(self, df: DataFrame) -> DataFrame:
        """step, left, right, distance, size: the clusters that are joined, points (in order of label, x, y) from 0, then new ones."""
        points = [(r["x"], r["y"]) for r in self.points(self.prepare(df))]
        size, out = [1] * len(points), []
        for k, (a, b, d) in enumerate(merges(np.array(points)) if points else []):
            size.append(size[a] + size[b])
            out.append((k, a, b, d, size[-1]))
        return df.sparkSession.createDataFrame(out, "step int, left int, right int, distance double, size int")

    def points(self, data: DataFrame) -> list:
        found = data.orderBy("label", "x", "y").limit(CLUSTERED + 1).collect()
        if len(found) > CLUSTERED:
            raise PropertyError(f"more than {CLUSTERED} points can't be clustered here; filter or aggregate them first")
        return found

    def draw(self, rows):
        if len(rows) > CLUSTERED:
            raise PropertyError(f"more than {CLUSTERED} points can't be clustered here; filter or aggregate them first")
        rows = sorted(rows, key=lambda r: (r["label"], r["x"], r["y"]))
        return render.joins([r["label"] for r in rows], merges(np.array([[r["x"], r["y"]] for r in rows])))
