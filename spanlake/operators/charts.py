"""Chart series: a data set, one or two dimensions and metrics folded into a small grid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..tables import Tables
from .filters import Filters, narrowed
from .stats import agent_model_stats, agent_stats, error_stats, model_stats, tool_stats
from .timeseries import timeseries_agents, timeseries_models, timeseries_points, timeseries_tools

# how many categories and series a chart shows unless its specification says otherwise
CATEGORIES, SERIES = 12, 8


@dataclass(frozen=True)
class ChartSpec:
    dataset: str
    dimensions: tuple[str, ...]
    metric: str
    secondary: str | None = None
    size: str | None = None
    tail: bool = False  # the last categories of a time axis instead of the first
    categories: int | None = CATEGORIES  # shown at most; None: all of them
    series: int | None = SERIES  # likewise


class Row:
    """Columns of a frame by name; a missing column counts as not given."""

    def __init__(self, columns: list[str]):
        self.columns = set(columns)

    def first(self, *names: str) -> Column | None:
        known = [F.col(n) for n in names if n in self.columns]
        return F.coalesce(*known) if known else None

    def number(self, *names: str) -> Column:
        value = self.first(*names)
        return F.lit(0.0) if value is None else F.coalesce(value.cast("double"), F.lit(0.0))

    def text(self, name: str, default: str = "unknown") -> Column:
        value = self.first(name)
        return F.lit(default) if value is None else F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(default))


def tokens(r: Row) -> Column:
    return r.number("inputTokens") + r.number("outputTokens") + r.number("cacheReadTokens") + r.number("cacheWriteTokens")


def _rate(r: Row, given: str, part: str, whole: str) -> Column:
    value = r.first(given)
    ratio = F.when(r.number(whole) != 0, F.lit(100.0) * r.number(part) / r.number(whole)).otherwise(F.lit(0.0))
    return ratio if value is None else F.coalesce(value, ratio)


def _plain(*names: str) -> dict[str, Callable[[Row], Column]]:
    return {n: (lambda r, n=n: r.number(n)) for n in names}


def _time(r: Row) -> Column:
    return F.col("time")


MIB = 1048576.0


def _overview(t: Tables, p: Filters, bucket: str, dims: tuple[str, ...]) -> DataFrame:
    """Points with running tokens and cost; a range has at most 2000 buckets, so one window holds them."""
    points = timeseries_points(t, p, bucket)
    upto = W.partitionBy(F.lit(0)).orderBy("time").rowsBetween(W.unboundedPreceding, W.currentRow)
    r = Row(points.columns)
    return (points.withColumn("cumTokens", F.sum(tokens(r)).over(upto))
            .withColumn("cumCost", F.sum(F.col("costUsd").cast("decimal(28,6)")).over(upto).cast("double")))


def _agents(t: Tables, p: Filters, bucket: str, dims: tuple[str, ...]) -> DataFrame:
    if "model" in dims:
        return agent_model_stats(t, p)
    return timeseries_agents(t, p, bucket) if "time" in dims else agent_stats(t, p)


def _sessions(t: Tables, p: Filters, bucket: str, dims: tuple[str, ...]) -> DataFrame:
    df = narrowed(t.sessions, p)
    took = F.greatest(F.lit(0.0), (F.unix_millis("ended_at") - F.unix_millis("started_at")).cast("double"))
    return df.select(F.col("started_at").alias("time"), F.col("agent_id").alias("agentId"), "status", F.col("message_count").alias("messageCount"),
                     F.coalesce(took, F.lit(0.0)).alias("durationMs"))


def _models(t: Tables, p: Filters, bucket: str, dims: tuple[str, ...]) -> DataFrame:
    return timeseries_models(t, p, bucket) if "time" in dims else model_stats(t, p)


def _tools(t: Tables, p: Filters, bucket: str, dims: tuple[str, ...]) -> DataFrame:
    return timeseries_tools(t, p, bucket) if {"time", "agent"} & set(dims) else tool_stats(t, p)


def _points(t: Tables, p: Filters, bucket: str, dims: tuple[str, ...]) -> DataFrame:
    return timeseries_points(t, p, bucket)


def _errors(t: Tables, p: Filters, bucket: str, dims: tuple[str, ...]) -> DataFrame:
    if "time" not in dims:
        return error_stats(t, p)
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("errors")) for kind, c in (("Agent", "runErrors"), ("LLM", "llmErrors"), ("Tool / MCP", "toolErrors"))])
    return timeseries_points(t, p, bucket).select("time", F.inline(kinds))


@dataclass(frozen=True)
class DataSet:
    rows: Callable[[Tables, Filters, str, tuple[str, ...]], DataFrame]
    dimensions: dict[str, Callable[[Row], Column]]
    metrics: dict[str, Callable[[Row], Column]]


AGENT = {"agent": lambda r: r.text("agentId")}
MEMORY = {"averageMemoryMiB": lambda r: r.number("averageMemoryBytes") / MIB}
DATASETS: dict[str, DataSet] = {
    "overview": DataSet(_overview, {"time": _time}, {
        **_plain("runs", "runErrors", "llmRequests", "llmErrorRate"), "totalTokens": tokens,
        **_plain("costUsd", "cumTokens", "cumCost", "averageLlmDurationMs", "toolCalls", "toolErrors"), **MEMORY, **_plain("averageCpuPercent", "diskUsedPercent")}),
    "agents": DataSet(_agents, {"time": _time, **AGENT, "model": lambda r: F.concat(r.text("provider"), F.lit("/"), r.text("model"))}, {
        "runs": lambda r: r.number("runs"), "errors": lambda r: r.number("errors", "runErrors"), "durationMs": lambda r: r.number("durationMs", "totalDurationMs"),
        "successRate": lambda r: r.number("successRate") if r.first("successRate") is not None else F.lit(100.0) - r.number("errorRate"),
        "totalTokens": lambda r: r.number("totalTokens") if r.first("totalTokens") is not None else tokens(r),
        **_plain("inputTokens", "outputTokens", "costUsd", "toolCalls", "requests")}),
    "sessions": DataSet(_sessions, {"time": _time, **AGENT, "status": lambda r: r.text("status")}, {
        "sessions": lambda r: F.lit(1.0), "messages": lambda r: r.number("messageCount"), "durationMs": lambda r: r.number("durationMs")}),
    "models": DataSet(_models, {"time": _time, "provider": lambda r: r.text("provider"), "model": lambda r: r.text("model")}, {
        "requests": lambda r: r.number("requests"), "totalTokens": tokens,
        **_plain("inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens", "costUsd", "averageDurationMs"),
        "errorRate": lambda r: _rate(r, "errorRate", "errors", "requests")}),
    "tools": DataSet(_tools, {"time": _time, "source": lambda r: r.text("source", "tool"), "tool": lambda r: r.text("tool"), **AGENT}, {
        **_plain("calls", "errors"), "failureRate": lambda r: _rate(r, "failureRate", "errors", "calls"),
        **_plain("averageDurationMs", "p95DurationMs", "p99DurationMs", "maxDurationMs", "timeouts")}),
    "infrastructure": DataSet(_points, {"time": _time}, {
        **MEMORY, "maxMemoryMiB": lambda r: r.number("maxMemoryBytes") / MIB, **_plain("averageCpuPercent", "diskUsedPercent")}),
    "errors": DataSet(_errors, {"time": _time, "kind": lambda r: r.text("kind"), "category": lambda r: r.text("category")}, _plain("errors", "averageDurationMs")),
}


def checked(spec: ChartSpec) -> DataSet:
    data = DATASETS.get(spec.dataset)
    if data is None:
        raise ValueError(f"unknown data set {spec.dataset}")
    if not 1 <= len(spec.dimensions) <= 2 or any(d not in data.dimensions for d in spec.dimensions):
        raise ValueError(f"unknown dimension in {spec.dimensions}")
    for m in (spec.metric, spec.secondary, spec.size):
        if m is not None and m not in data.metrics:
            raise ValueError(f"unknown metric {m}")
    return data


def _first(rows: DataFrame, n: int | None) -> DataFrame:
    return rows if n is None else rows.limit(n)


def series_of(rows: DataFrame, spec: ChartSpec) -> DataFrame:
    """(categoryRank, category, seriesRank, series, value, secondary, size) of the specified grid of cells, zero-filled.

    Without bounds the grid holds every category and series.  Rows are summed per cell first.  Categories go by time or by total, series by their total over those categories.
    Sums are decimals, so equal totals tie the same way however rows are split.
    """
    data = checked(spec)
    r = Row(rows.columns)
    on_time = spec.dimensions[0] == "time"
    category = data.dimensions[spec.dimensions[0]](r)
    series = data.dimensions[spec.dimensions[1]](r) if len(spec.dimensions) > 1 else F.lit(spec.metric)

    def amount(name: str | None) -> Column:
        value = data.metrics[name](r) if name else F.lit(0.0)
        return F.coalesce(F.sum(value.cast("decimal(28,6)")), F.lit(0))

    cells = rows.groupBy((F.date_format(category, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if on_time else category).alias("category"), series.cast("string").alias("series")).agg(
        amount(spec.metric).alias("value"), amount(spec.secondary).alias("secondary"), amount(spec.size).alias("size")).where("category is not null")
    totals = cells.groupBy("category").agg(F.sum("value").alias("total"))
    order = [F.desc("category") if spec.tail else F.asc("category")] if on_time else [F.desc("total"), F.asc("category")]
    if on_time and spec.tail:
        top = _first(totals.orderBy(*order), spec.categories)
        order = [F.asc("category")]
    else:
        top = _first(totals.orderBy(*order), spec.categories)
    cats = top.withColumn("categoryRank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))).select("category", "categoryRank")
    kept = cells.join(cats, "category")
    lines = (_first(kept.groupBy("series").agg(F.sum("value").alias("total")).orderBy(F.desc("total"), F.asc("series")), spec.series)
             .withColumn("seriesRank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("total"), F.asc("series")))).select("series", "seriesRank"))
    if spec.categories is None or spec.series is None:
        grid = cats.crossJoin(lines)
        return _filled(grid, kept)
    axes = (cats.select(F.struct("categoryRank", "category").alias("c"), F.lit(None).cast("struct<seriesRank:int,series:string>").alias("s"))
            .unionByName(lines.select(F.lit(None).cast("struct<categoryRank:int,category:string>").alias("c"), F.struct("seriesRank", "series").alias("s"))))
    grid = axes.agg(F.collect_list("c").alias("cs"), F.collect_list("s").alias("ss")).select(F.inline("cs"), "ss").select("categoryRank", "category", F.inline("ss"))
    return _filled(grid, kept)


def _filled(grid: DataFrame, kept: DataFrame) -> DataFrame:
    out = grid.join(kept.select("category", "series", "value", "secondary", "size"), ["category", "series"], "left")
    return out.select("categoryRank", "category", "seriesRank", "series", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("value", "secondary", "size")])


def chart_series(t: Tables, spec: ChartSpec, p: Filters = Filters(), bucket: str = "1h") -> DataFrame:
    return series_of(checked(spec).rows(t, p, bucket, spec.dimensions), spec)


# The operators below work on such a grid, whatever its size; without bounds their sums, means and counts are of all cells.

def cumulative(series: DataFrame) -> DataFrame:
    upto = W.partitionBy("series").orderBy("categoryRank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return series.withColumn("value", F.sum(F.col("value").cast("decimal(28,6)")).over(upto).cast("double"))


def waterfall_steps(series: DataFrame) -> DataFrame:
    """Start and end of each category's step on the running total."""
    totals = series.groupBy("categoryRank", "category").agg(F.sum(F.col("value").cast("decimal(28,6)")).alias("_v"))
    upto = W.partitionBy(F.lit(0)).orderBy("categoryRank").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum("_v").over(upto)
    return totals.select("categoryRank", "category", (end - F.col("_v")).cast("double").alias("stepStart"), end.cast("double").alias("stepEnd"))


def histogram(series: DataFrame) -> DataFrame:
    """Counts of cell values in 4 to 10 equal bins."""
    span = series.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_n")).withColumn(
        "_bins", F.least(F.lit(10), F.greatest(F.lit(4), F.ceil(F.sqrt(F.col("_n"))))).cast("int")).withColumn(
        "_w", F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / F.col("_bins")).otherwise(F.lit(1.0)))
    frame = span.select(F.struct("_lo", "_w", "_bins")).scalar()
    bins = span.where("_n > 0").select("_lo", "_w", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)).alias("bin"))
    placed = series.select("value", frame.alias("_f")).select(
        F.least(F.col("_f._bins") - 1, F.greatest(F.lit(0), F.floor((F.col("value") - F.col("_f._lo")) / F.col("_f._w")))).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("count"))
    return bins.join(counts, "bin", "left").select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("upper"),
                                                   F.coalesce("count", F.lit(0)).alias("count"))


def gauge(series: DataFrame) -> DataFrame:
    """Mean of all cells held between 0 and 100, with its level."""
    mean = series.agg((F.sum(F.col("value").cast("decimal(28,6)")).cast("double") / F.greatest(F.lit(1), F.count("*"))).alias("_m"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("_m", F.lit(0.0))))
    return mean.select(value.alias("value"), (F.lit(100.0) - value).alias("rest"), F.when(value >= 85, "good").when(value >= 60, "warning").otherwise("critical").alias("level"))


def points(series: DataFrame, bubble: bool = False) -> DataFrame:
    """Two metrics as x and y, a third as radius; empty points are dropped."""
    size = F.coalesce(F.nullif("size", F.lit(0.0)), "secondary")
    radius = F.greatest(F.lit(4.0), F.least(F.lit(24.0), F.lit(4.0) + F.sqrt(F.abs(size))))
    return series.where("value <> 0 or secondary <> 0").select("series", "category", F.col("value").alias("x"), F.col("secondary").alias("y"), *([radius.alias("r")] if bubble else []))


def radial(series: DataFrame) -> DataFrame:
    return series.select(F.concat("category", F.lit(" · "), "series").alias("label"), "value")
