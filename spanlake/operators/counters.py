"""Counter algebra and hold rules over metric samples.

Samples are rows (ts, metric, labels..., value); a series is one metric with its label columns.
Values are first combined per series and step, then carried to the steps whose look-back holds them,
so the fan-out is per step and not per sample, and no series is ordered as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as _fold

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import previous, running, time_slice
from ..tables import Tables
from .attribution import llm_named
from .filters import Filters, narrowed
from .stats import tool_stats

DAY = 86400
# fixed values: upper bounds of duration buckets in seconds
LATENCY_BOUNDS = (0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)


def deltas(samples: DataFrame, labels: list[str]) -> DataFrame:
    """Increase of each sample over the one before it in its series; after a reset the value itself."""
    key = ["metric", *labels]
    rows = previous(samples, key, ["ts", "value"], time_slice("ts", DAY), {"_before": "value"})
    return rows.where("_before is not null").withColumn("delta", F.when(F.col("value") < F.col("_before"), F.col("value")).otherwise(F.col("value") - F.col("_before")))


def step_of(time: str, step: int) -> Column:
    """The first evaluation instant not before a sample, in epoch seconds."""
    return (F.ceil(F.unix_micros(time) / F.lit(step * 1000000.0)) * step).cast("bigint")


def reach(rows: DataFrame, step: int, look_back: int) -> DataFrame:
    """Each step row at every instant ``at`` whose look-back includes it."""
    if look_back % step:
        raise ValueError("the look-back must be a multiple of the step")
    ahead = F.sequence(F.col("_step"), F.col("_step") + F.lit(look_back - step), F.lit(step).cast("bigint"))
    return rows.select("*", F.explode(ahead).alias("_at"))


def counter_increase(samples: DataFrame, labels: list[str], look_back: int, step: int, by: list[str] | None = None) -> DataFrame:
    """Increase over the look-back at every instant, summed by the given labels (default: all)."""
    by = labels if by is None else by
    per_step = deltas(samples, labels).groupBy("metric", *by, step_of("ts", step).alias("_step")).agg(F.sum("delta").alias("d"))
    return (reach(per_step, step, look_back).groupBy("metric", *by, F.timestamp_seconds("_at").alias("at")).agg(F.sum("d").alias("increase")))


def counter_rate(samples: DataFrame, labels: list[str], look_back: int, step: int, by: list[str] | None = None) -> DataFrame:
    out = counter_increase(samples, labels, look_back, step, by)
    return out.withColumn("rate", F.col("increase") / F.lit(float(look_back))).drop("increase")


def ratio(part: Column, whole: Column, floor: float) -> Column:
    return part / F.greatest(whole, F.lit(floor))


def error_ratio(samples: DataFrame, labels: list[str], look_back: int, step: int, metric: str, failed: Column, floor: float = 0.001) -> DataFrame:
    """Rate of failed requests over the rate of all, the latter held above a floor."""
    rows = deltas(samples.where(F.col("metric") == metric), labels).withColumn("bad", F.when(failed, F.col("delta")).otherwise(F.lit(0.0)))
    per_step = rows.groupBy(step_of("ts", step).alias("_step")).agg(F.sum("bad").alias("bad"), F.sum("delta").alias("total"))
    out = reach(per_step, step, look_back).groupBy(F.timestamp_seconds("_at").alias("at")).agg(F.sum("bad").alias("bad"), F.sum("total").alias("total"))
    return out.select("at", ratio(F.col("bad") / F.lit(float(look_back)), F.col("total") / F.lit(float(look_back)), floor).alias("ratio"))


def gauge_at(samples: DataFrame, labels: list[str], look_back: int, step: int) -> DataFrame:
    """The newest value of each series within the look-back of every instant."""
    newest = F.max(F.struct("ts", "value"))
    per_step = samples.groupBy("metric", *labels, step_of("ts", step).alias("_step")).agg(newest.alias("_v"))
    return (reach(per_step, step, look_back).groupBy("metric", *labels, F.timestamp_seconds("_at").alias("at")).agg(F.max("_v").alias("_v"))
            .select("metric", *labels, "at", F.col("_v.value").alias("value")))


def min_over_time(samples: DataFrame, labels: list[str], look_back: int, step: int) -> DataFrame:
    """The least value of each series within the look-back, such as availability of a gateway."""
    per_step = samples.groupBy("metric", *labels, step_of("ts", step).alias("_step")).agg(F.min("value").alias("v"))
    return reach(per_step, step, look_back).groupBy("metric", *labels, F.timestamp_seconds("_at").alias("at")).agg(F.min("v").alias("value"))


def gauge_latest(samples: DataFrame, labels: list[str], across: str = "instance") -> DataFrame:
    """The newest value of each series, then its sum and maximum over one label."""
    last = samples.groupBy("metric", *labels).agg(F.max(F.struct("ts", "value")).alias("_v"))
    rest = [c for c in labels if c != across]
    return last.groupBy("metric", *rest).agg(F.sum("_v.value").alias("total"), F.max("_v.value").alias("top"))


def duration_histogram(t: Tables, p: Filters = Filters(), bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts of model call durations per upper bound; the last bound is infinite."""
    calls = narrowed(llm_named(t.llm_calls), p).where("duration_ms is not null")
    seconds = F.col("duration_ms") / F.lit(1000.0)
    slot = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        slot = F.when(seconds <= bounds[i], i).otherwise(slot)
    counts = calls.groupBy("provider", "model", "status", slot.alias("_slot")).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("_ms"))
    les = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    spread = counts.select("provider", "model", "status", "n", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))).alias("_le"), "_slot")
    return (spread.groupBy("provider", "model", "status", "_le").agg(F.sum(F.when(F.col("_slot") <= F.col("_le"), F.col("n")).otherwise(0)).alias("count"))
            .select("provider", "model", "status", F.get(les, F.col("_le")).alias("le"), "count"))


def histogram_quantile(histogram: DataFrame, q: float, by: list[str], bounds: tuple[float, ...] = LATENCY_BOUNDS) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds its rank; the highest finite bound beyond it."""
    sums = histogram.groupBy(*by, "le").agg(F.sum("count").alias("n"))
    cells = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))  # one entry per bound
    total = F.element_at("b", -1)["n"].cast("double")
    rank = total * F.lit(q)
    i = F.size(F.filter("b", lambda x: x["n"] < rank))
    lower = F.when(i == 0, F.lit(0.0)).otherwise(F.get("b", i - 1)["le"])
    below = F.when(i == 0, F.lit(0)).otherwise(F.get("b", i - 1)["n"])
    here = F.get("b", i)
    inside = lower + (here["le"] - lower) * (rank - below) / (here["n"] - below)
    value = F.when(total > 0, F.when(i >= len(bounds), F.lit(float(bounds[-1]))).when(here["n"] == below, here["le"]).otherwise(inside))
    return cells.select(*by, value.alias("seconds"))


def slowest_tools(t: Tables, k: int = 10, p: Filters = Filters()) -> DataFrame:
    return (tool_stats(t, p).where("averageDurationMs is not null").select("source", "tool", "calls", "averageDurationMs")
            .orderBy(F.desc("averageDurationMs"), "source", "tool").limit(k))


@dataclass(frozen=True)
class HoldRule:
    """A condition on a metric that must hold for a time before the rule fires."""

    name: str
    kind: str  # gauge, increase or ratio
    metric: str
    severity: str
    limit: float
    hold: int
    look_back: int = 300
    below: bool = False
    by: tuple[str, ...] = ()


# fixed values: the five default rules
HOLD_RULES = (
    HoldRule("gateway_down", "gauge", "gateway_up", "critical", 0, 120, below=True, by=("instance",)),
    HoldRule("high_memory", "gauge", "process_resident_memory_bytes", "warning", 2147483648, 600, by=("instance",)),
    HoldRule("high_llm_error_rate", "ratio", "llm_requests_total", "warning", 0.10, 600),
    HoldRule("tool_error_spike", "increase", "tool_errors_total", "warning", 5, 120),
    HoldRule("dropping_events", "increase", "monitor_events_dropped_total", "warning", 0, 60, look_back=600),
)


def rule_values(samples: DataFrame, labels: list[str], rule: HoldRule, step: int) -> DataFrame:
    rows = samples.where(F.col("metric") == rule.metric)
    if rule.kind == "gauge":
        return gauge_at(rows, labels, rule.look_back, step)
    if rule.kind == "increase":
        return counter_increase(rows, labels, rule.look_back, step, list(rule.by)).withColumnRenamed("increase", "value")
    return error_ratio(rows, labels, rule.look_back, step, rule.metric, F.col("status") == "failed").withColumnRenamed("ratio", "value")


def alert_rules(samples: DataFrame, labels: list[str], rules: tuple[HoldRule, ...] = HOLD_RULES, step: int = 60) -> DataFrame:
    """(rule, severity, instance, active_at, fired_at, last_at): unbroken stretches of a condition at least as long as its hold."""
    parts = []
    for rule in rules:
        values = rule_values(samples, labels, rule, step)
        met = F.col("value") == rule.limit if rule.below else F.col("value") > rule.limit
        instance = F.col("instance") if "instance" in rule.by else F.lit("")
        parts.append(values.where(met).select(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), instance.alias("instance"),
                                              F.lit(rule.hold).alias("hold"), "at").distinct())
    hits = _fold(DataFrame.unionByName, parts)
    key = ["rule", "severity", "hold", "instance"]
    hits = previous(hits, key, ["at"], time_slice("at", DAY), {"_before": "at"})
    opens = F.col("_before").isNull() | (F.unix_seconds("at") - F.unix_seconds("_before") > step)
    hits = running(hits, key, ["at"], time_slice("at", DAY), {"active_at": ("last", F.when(opens, F.col("at")))})
    spans = hits.groupBy(*key, "active_at").agg(F.max("at").alias("last_at"))
    fired = F.timestamp_seconds(F.unix_seconds("active_at") + F.col("hold"))
    return spans.withColumn("fired_at", fired).where("last_at >= fired_at").select("rule", "severity", "instance", "active_at", "fired_at", "last_at")
