"""Prices, traces and chart series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, pricing, trace
from ..operators.charts import ChartSpec
from ..operators.filters import Filters
from .queries_lists import SPANS
from .queries_stats import AGENT_STATS, ALL_CALLS, FIGURES, MODEL_STATS, NAMED, POINTS_ALL, SUMS
from .registry import query
from .shared import ERROR_EVENTS, RUN_AGENTS, RUNS, TOOL_EVENTS

# --- prices ------------------------------------------------------------------------------

ALIASES = {"prov-3|promo": "custom/promo", "prov-3|large": "custom/none"}
PRICES = """pnorm AS (SELECT id, concat(CASE lower(split_part(id,'/',1)) WHEN 'qwen' THEN 'bailian' WHEN 'alibaba' THEN 'bailian' WHEN 'z-ai' THEN 'zai' WHEN 'zhipu' THEN 'zai' ELSE lower(split_part(id,'/',1)) END, '|', lower(substr(id, strpos(id,'/')+1))) AS price_key,
   try_cast(prompt AS DOUBLE) AS p, try_cast(completion AS DOUBLE) AS c FROM price_file WHERE id LIKE '%/%'),
listed AS (SELECT price_key, p::DECIMAL(18,12) AS input_price, c::DECIMAL(18,12) AS output_price FROM pnorm WHERE p IS NOT NULL AND c IS NOT NULL AND NOT (p=0 AND c=0)),
spare(price_key, i, o) AS (VALUES ('bailian|qwen3.7-plus','0.00000032','0.00000128'),('bailian|qwen3-coder-plus','0.00000035','0.0000011'),('bailian|qwen3-coder-next','0.00000011','0.0000008'),
  ('bailian|qwen3-max','0.00000125','0.00000375'),('zai|glm-5.2','0.00000035','0.0000011'),('zai|glm-5-turbo','0.0000012','0.000004'),('zai|glm-5','0.0000006','0.00000192')),
dim AS (SELECT * FROM listed UNION ALL SELECT price_key, i::DECIMAL(18,12), o::DECIMAL(18,12) FROM spare WHERE price_key NOT IN (SELECT price_key FROM listed)),
prices AS (SELECT * FROM dim UNION ALL SELECT 'prov-3|promo', 0.000009::DECIMAL(18,12), 0.00002::DECIMAL(18,12))"""


def price_list(t):
    """The fixture list plus one price a call reaches by its alias only."""
    return pricing.price_dimension(t.price_file)


def aliased(t):
    spark = t.spark
    extra = spark.createDataFrame([("custom/promo", "0.000009", "0.00002")], "price_key string, i string, o string").select(
        "price_key", F.col("i").cast(pricing.PRICE).alias("input_price"), F.col("o").cast(pricing.PRICE).alias("output_price"))
    return price_list(t).unionByName(extra)


query("pricing_dim", lambda t: price_list(t).select("price_key", F.col("input_price").cast("double").alias("input_price"), F.col("output_price").cast("double").alias("output_price")),
      ("price_file",), "SELECT price_key, input_price::DOUBLE AS input_price, output_price::DOUBLE AS output_price FROM dim", (PRICES,))
query("price_calls", lambda t: pricing.price_calls(t, aliased(t), aliases=ALIASES), ("llm_calls", "price_file"), """
SELECT instance_id, call_id, provider, model, (CASE WHEN cost_usd<>0 THEN cost_usd ELSE coalesce((input_tokens+cache_read_tokens)::DECIMAL(18,0)*input_price + output_tokens::DECIMAL(18,0)*output_price + cache_write_tokens::DECIMAL(18,0)*input_price, 0) END)::DOUBLE AS "costUsd"
FROM llm_calls LEFT JOIN prices ON price_key=concat(lower(provider),'|',lower(coalesce(model,'')))
""", (PRICES,))
query("price_total", lambda t: pricing.price_total(t, aliased(t), aliases=ALIASES), ("llm_calls", "price_file"), """
SELECT sum((input_tokens+cache_read_tokens+cache_write_tokens)::DECIMAL(18,0)*input_price + output_tokens::DECIMAL(18,0)*output_price)::DOUBLE AS "totalCost"
FROM llm_calls JOIN prices ON price_key=concat(lower(provider),'|',lower(coalesce(model,'')))
""", (PRICES,))
MODELS = "models AS (" + MODEL_STATS.format(where="TRUE").strip() + ")"
PRICED_COST = """coalesce((("inputTokens"+"cacheReadTokens"+"cacheWriteTokens")::DECIMAL(18,0)*input_price + "outputTokens"::DECIMAL(18,0)*output_price)::DOUBLE, "costUsd")"""
PRICED_MODELS = f"""pm AS (SELECT models.* REPLACE ({PRICED_COST} AS "costUsd") FROM models LEFT JOIN prices ON price_key=concat(lower(provider),'|',lower(model)))"""
query("price_models", lambda t: pricing.price_models(t, aliased(t), aliases=ALIASES), (*ALL_CALLS, "price_file"), "SELECT * FROM pm", (RUN_AGENTS, PRICES, MODELS, PRICED_MODELS))
query("price_agent_models", lambda t: pricing.price_agent_models(t, aliased(t), aliases=ALIASES).select("agentId", "provider", "model", "costUsd"), (*ALL_CALLS, "price_file"), f"""
, am AS (SELECT r.agent_id AS "agentId", {NAMED}, {SUMS} FROM llm_calls l JOIN run_agents r ON r.instance_id=l.instance_id AND r.run_id=l.run_id GROUP BY 1,2,3)
SELECT "agentId", provider, model, {PRICED_COST} AS "costUsd" FROM am LEFT JOIN prices ON price_key=concat(lower(provider),'|',lower(model))
""", (RUN_AGENTS, PRICES))
AGENTS = f"{FIGURES}, agents AS ({AGENT_STATS.format(where='')})"
query("price_agents", lambda t: pricing.price_agents(t, aliased(t), aliases=ALIASES).select("agentId", F.round("costUsd", 6).alias("costUsd")), (*ALL_CALLS, "price_file"), """
SELECT "agentId", round("totalTokens" * (SELECT sum("costUsd"::DECIMAL(38,12))::DOUBLE/sum("inputTokens"+"cacheReadTokens"+"outputTokens") FROM pm), 6) AS "costUsd" FROM agents
""", (RUN_AGENTS, TOOL_EVENTS, PRICES, MODELS, PRICED_MODELS, AGENTS))
TRENDS = f"""tr AS (SELECT strftime(l.started_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS period, {NAMED}, coalesce(r.agent_id,'unknown') AS "agentId", {SUMS}
  FROM llm_calls l LEFT JOIN run_agents r ON r.instance_id=l.instance_id AND r.run_id=l.run_id GROUP BY 1,2,3,4),
ptr AS (SELECT period, provider, model, "agentId", coalesce(("inputTokens"::DECIMAL(18,0)*input_price + "outputTokens"::DECIMAL(18,0)*output_price)::DOUBLE, "costUsd") AS "costUsd" FROM tr LEFT JOIN prices ON price_key=concat(lower(provider),'|',lower(model)))"""
query("price_trends", lambda t: pricing.price_trends(t, aliased(t), aliases=ALIASES).select("period", "provider", "model", "agentId", "costUsd"), (*ALL_CALLS, "price_file"),
      "SELECT * FROM ptr", (RUN_AGENTS, PRICES, TRENDS))
query("price_periods", lambda t: pricing.price_periods(t, aliased(t), "2001-10-20 18:00:00", aliases=ALIASES), (*ALL_CALLS, "price_file"), """
, d AS (SELECT period, sum("costUsd"::DECIMAL(38,12)) AS c, row_number() OVER (ORDER BY period DESC) AS rk FROM ptr WHERE period IS NOT NULL GROUP BY 1)
SELECT coalesce(sum(c) FILTER (WHERE period='2001-10-21'),0)::DOUBLE AS "lastDayCost", coalesce(sum(c) FILTER (WHERE rk<=7),0)::DOUBLE AS "lastWeekCost", coalesce(sum(c) FILTER (WHERE rk<=30),0)::DOUBLE AS "lastMonthCost" FROM d
""", (RUN_AGENTS, PRICES, TRENDS))

# --- traces --------------------------------------------------------------------------------

EDGES = """dspans AS MATERIALIZED (SELECT *, CASE WHEN duration_ms>=0 THEN duration_ms ELSE greatest(0, coalesce((epoch_us(ended_at)-epoch_us(started_at))/1000.0::DOUBLE,0)) END AS dur FROM spans WHERE session_id IS NOT NULL),
druns AS (SELECT instance_id, session_id, 'run' AS kind, run_id AS id, coalesce(nullif(span_id,''),run_id) AS span_id, run_id, started_at,
   CASE WHEN duration_ms>=0 THEN duration_ms ELSE greatest(0, coalesce((epoch_us(ended_at)-epoch_us(started_at))/1000.0::DOUBLE,0)) END AS dur FROM agent_runs),
owned AS (SELECT instance_id, session_id, span_id, max({'run': run, 'at': coalesce(epoch_us(started_at), -4611686018427387904), 'id': id, 'kind': kind}) AS o FROM (
   SELECT instance_id, session_id, span_id, TRUE AS run, started_at, id, kind FROM druns UNION ALL SELECT instance_id, session_id, span_id, FALSE, started_at, id, kind FROM dspans) GROUP BY 1,2,3),
placed AS (SELECT s.instance_id, s.session_id, s.kind, s.id, s.span_id, s.run_id, s.dur, CASE WHEN w.o.kind<>s.kind OR w.o.id<>s.id THEN w.o END AS o
  FROM dspans s LEFT JOIN owned w ON w.instance_id=s.instance_id AND w.session_id=s.session_id AND w.span_id=coalesce(nullif(s.parent_span_id,''), s.run_id, '')),
edges AS (SELECT p.instance_id, p.session_id, p.kind, p.id, p.span_id, p.dur AS duration_ms,
   CASE WHEN p.o IS NOT NULL THEN p.o.kind WHEN h.id IS NOT NULL THEN 'run' ELSE 'unlinked' END AS parent_kind, coalesce(p.o.id, h.id, 'unlinked') AS parent_id
  FROM placed p LEFT JOIN druns h ON h.instance_id=p.instance_id AND h.session_id=p.session_id AND h.run_id=p.run_id)"""
TRACE = (*RUNS, "llm_calls", "tool_calls", "mcp_calls", "retry_events")
query("trace_edges", lambda t: trace.trace_edges(t), TRACE, "SELECT * FROM edges", (SPANS, EDGES))
query("critical_path", lambda t: trace.critical_path(t), TRACE, """
, n AS (SELECT instance_id, session_id, concat(kind,'~',id) AS node, concat(parent_kind,'~',parent_id) AS up, kind, id, span_id, duration_ms AS dur FROM edges
  UNION ALL SELECT instance_id, session_id, concat('run~',id), NULL, kind, id, span_id, dur FROM druns
  UNION ALL SELECT instance_id, session_id, 'unlinked~unlinked', NULL, 'unlinked', 'unlinked', 'unlinked', max(duration_ms) FROM edges WHERE parent_kind='unlinked' GROUP BY 1,2),
walk AS (SELECT instance_id, session_id, node, span_id, dur AS total, 1 AS steps, concat('/', node, '/') AS path FROM n WHERE up IS NULL
  UNION ALL SELECT n.instance_id, n.session_id, n.node, n.span_id, w.total + n.dur, w.steps + 1, concat(w.path, n.node, '/') FROM walk w JOIN n ON n.instance_id=w.instance_id AND n.session_id=w.session_id AND n.up=w.node WHERE w.path NOT LIKE concat('%/', n.node, '/%')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, session_id ORDER BY total DESC, steps, span_id, node) AS rk FROM walk) WHERE rk=1 AND total>0)
SELECT n.instance_id, n.session_id, n.kind, n.id, n.span_id, n.dur AS duration_ms, b.total AS critical_duration_ms FROM best b JOIN n ON n.instance_id=b.instance_id AND n.session_id=b.session_id AND contains(b.path, concat('/', n.node, '/'))
""", ("/*recursive*/ " + SPANS, EDGES))
query("trace_summary", lambda t: trace.trace_summary(t), TRACE, """
SELECT instance_id, session_id, count(*) FILTER (WHERE kind='llm') AS "llmCalls", count(*) FILTER (WHERE kind IN ('tool','mcp')) AS "toolCalls",
  coalesce(sum(input_tokens+output_tokens+cache_read_tokens+cache_write_tokens) FILTER (WHERE kind='llm'),0)::BIGINT AS "totalTokens",
  coalesce(sum(cost_usd::DECIMAL(18,6)) FILTER (WHERE kind='llm'),0)::DOUBLE AS "costUsd", count(*) FILTER (WHERE status='failed') AS errors, count(*) FILTER (WHERE kind='retry') AS retries
FROM spans GROUP BY 1,2
""", (SPANS,))
query("waterfall_layout", lambda t: trace.waterfall_layout(t), TRACE, """
, w AS (SELECT instance_id, session_id, kind, id, epoch_ms(started_at)::DOUBLE AS a, coalesce(epoch_ms(ended_at)::DOUBLE, epoch_ms(started_at) + coalesce(nullif(duration_ms,0),1)) AS z FROM spans),
f AS (SELECT *, min(a) OVER (PARTITION BY instance_id, session_id) AS lo, max(z) OVER (PARTITION BY instance_id, session_id) AS hi FROM w),
g AS (SELECT *, greatest(hi, lo+1)-lo AS span, greatest(0, 1e2*(a-lo)/(greatest(hi, lo+1)-lo)) AS l FROM f)
SELECT instance_id, session_id, kind, id, l AS offset_percent, least(greatest(0.7::DOUBLE, 1e2*(z-a)/span), 1e2-l) AS width_percent FROM g
""", (SPANS,))

# --- chart series -----------------------------------------------------------------------------


def series_sql(source: str, on_time: bool) -> str:
    """CTE ``grid`` from a select of (category, series, value, secondary, size)."""
    order = "category" if on_time else "total DESC, category"
    return f"""src AS ({source}),
cells AS (SELECT {"strftime(category, '%Y-%m-%dT%H:%M:%S.%fZ')" if on_time else "category"} AS category, series, sum(coalesce(value,0)::DECIMAL(28,6)) AS value, sum(coalesce(secondary,0)::DECIMAL(28,6)) AS secondary, sum(coalesce(size,0)::DECIMAL(28,6)) AS size FROM src WHERE category IS NOT NULL GROUP BY 1,2),
cats AS (SELECT category, row_number() OVER (ORDER BY {order})::INT AS "categoryRank" FROM (SELECT category, sum(value) AS total FROM cells GROUP BY 1) QUALIFY "categoryRank"<=12),
kept AS (SELECT cells.*, "categoryRank" FROM cells JOIN cats USING (category)),
slines AS (SELECT series, row_number() OVER (ORDER BY total DESC, series)::INT AS "seriesRank" FROM (SELECT series, sum(value) AS total FROM kept GROUP BY 1) QUALIFY "seriesRank"<=8),
grid AS (SELECT c."categoryRank", c.category, l."seriesRank", l.series, coalesce(k.value,0)::DOUBLE AS value, coalesce(k.secondary,0)::DOUBLE AS secondary, coalesce(k.size,0)::DOUBLE AS size
  FROM cats c CROSS JOIN slines l LEFT JOIN kept k ON k.category=c.category AND k.series=l.series)"""


POINTS_CTE = POINTS_ALL.strip().lstrip(",")
HOST = (*ALL_CALLS, "resource_samples")
OVERVIEW = ChartSpec("overview", ("time",), "totalTokens", "costUsd", "toolCalls")
AGENT_MODELS = ChartSpec("agents", ("agent", "model"), "totalTokens", "costUsd")
MODEL_TIMES = ChartSpec("models", ("time", "model"), "requests")
AGENT_RATES = ChartSpec("agents", ("agent",), "successRate")
TOK = '"inputTokens"+"outputTokens"+"cacheReadTokens"+"cacheWriteTokens"'

SRC = {
    "overview": (OVERVIEW, HOST, (RUN_AGENTS, TOOL_EVENTS, POINTS_CTE, series_sql(f"""SELECT time AS category, 'totalTokens' AS series, ({TOK})::DOUBLE AS value, "costUsd" AS secondary, "toolCalls" AS size FROM points""", True))),
    "agents": (AGENT_MODELS, ALL_CALLS, (RUN_AGENTS, series_sql("""SELECT r.agent_id AS category, concat(coalesce(nullif(l.provider,''),'unknown'),'/',coalesce(nullif(l.model,''),'unknown')) AS series,
      input_tokens+output_tokens+cache_read_tokens+cache_write_tokens AS value, cost_usd AS secondary, 0 AS size FROM llm_calls l JOIN run_agents r ON r.instance_id=l.instance_id AND r.run_id=l.run_id""", False))),
    "sessions": (ChartSpec("sessions", ("agent", "status"), "sessions", "durationMs", "messages"), ("sessions",), (series_sql("""SELECT coalesce(nullif(agent_id,''),'unknown') AS category, status AS series, 1 AS value,
      greatest(0, coalesce(epoch_ms(ended_at)-epoch_ms(started_at),0)) AS secondary, message_count AS size FROM sessions""", False),)),
    "models": (MODEL_TIMES, ("llm_calls",), (series_sql("""SELECT time_bucket(INTERVAL '1 day', started_at) AS category, coalesce(nullif(model,''),'unknown') AS series, 1 AS value, 0 AS secondary, 0 AS size FROM llm_calls""", True),)),
    "tools": (ChartSpec("tools", ("tool", "agent"), "calls", "errors"), ALL_CALLS, (RUN_AGENTS, TOOL_EVENTS, series_sql("""SELECT e.tool AS category, coalesce(r.agent_id,'unknown') AS series, 1 AS value, (e.status='failed')::INT AS secondary, 0 AS size
      FROM tool_events e LEFT JOIN run_agents r ON r.instance_id=e.instance_id AND r.run_id=e.run_id WHERE e.started_at IS NOT NULL""", False))),
    "infrastructure": (ChartSpec("infrastructure", ("time",), "averageMemoryMiB", "diskUsedPercent"), HOST, (RUN_AGENTS, TOOL_EVENTS, POINTS_CTE,
      series_sql("""SELECT time AS category, 'averageMemoryMiB' AS series, "averageMemoryBytes"/1048576.0::DOUBLE AS value, "diskUsedPercent" AS secondary, 0 AS size FROM points WHERE time>=TIMESTAMP '2024-01-01'""", True))),
    "errors": (ChartSpec("errors", ("time", "kind"), "errors"), HOST, (RUN_AGENTS, TOOL_EVENTS, POINTS_CTE, series_sql("""SELECT time AS category, 'Agent' AS series, "runErrors" AS value, 0 AS secondary, 0 AS size FROM points
      UNION ALL SELECT time, 'LLM', "llmErrors", 0, 0 FROM points UNION ALL SELECT time, 'Tool / MCP', "toolErrors", 0, 0 FROM points""", True))),
    "error_categories": (ChartSpec("errors", ("category", "kind"), "errors"), (*ALL_CALLS, "ledger"), (RUN_AGENTS, ERROR_EVENTS, series_sql("""SELECT category, kind AS series, 1 AS value, 0 AS secondary, 0 AS size FROM error_events""", False))),
}
RANGE = {"infrastructure": Filters(start="2024-01-01 00:00:00", end="2024-01-31 00:00:00")}


def grid(t, name):
    return charts.chart_series(t, SRC[name][0], RANGE.get(name, Filters()), "1d")


for _name, (_spec, _tables, _ctes) in SRC.items():
    query(f"series_{_name}", lambda t, name=_name: grid(t, name), _tables, "SELECT * FROM grid", _ctes)

query("series_cumulative", lambda t: charts.cumulative(grid(t, "models")).select("categoryRank", "series", "value"), SRC["models"][1], """
SELECT "categoryRank", series, sum(value::DECIMAL(28,6)) OVER (PARTITION BY series ORDER BY "categoryRank")::DOUBLE AS value FROM grid
""", SRC["models"][2])
query("series_waterfall", lambda t: charts.waterfall_steps(grid(t, "overview")), SRC["overview"][1], """
SELECT "categoryRank", category, (sum(v) OVER (ORDER BY "categoryRank") - v)::DOUBLE AS "stepStart", (sum(v) OVER (ORDER BY "categoryRank"))::DOUBLE AS "stepEnd" FROM (SELECT "categoryRank", category, sum(value::DECIMAL(28,6)) AS v FROM grid GROUP BY 1,2)
""", SRC["overview"][2])
query("series_histogram", lambda t: charts.histogram(grid(t, "agents")), SRC["agents"][1], """
, m AS (SELECT min(value) lo, max(value) hi, least(10, greatest(4, ceil(sqrt(count(*)))))::INT AS k FROM grid), b AS (SELECT lo, (hi-lo)/k AS w, k, unnest(range(0, k))::INT AS bin FROM m),
c AS (SELECT least(m.k-1, greatest(0, floor((value-lo)/((hi-lo)/k))))::INT AS bin, count(*) AS n FROM grid, m GROUP BY 1)
SELECT b.bin, lo+b.bin*w AS lower, lo+(b.bin+1)*w AS upper, coalesce(c.n,0) AS count FROM b LEFT JOIN c ON c.bin=b.bin
""", SRC["agents"][2])
query("series_gauge", lambda t: charts.gauge(charts.chart_series(t, AGENT_RATES, Filters(), "1d")), ALL_CALLS, """
, v AS (SELECT greatest(0, least(100, sum(value::DECIMAL(28,6))::DOUBLE/count(*))) AS v FROM grid)
SELECT v AS value, 1e2-v AS rest, CASE WHEN v>=85 THEN 'good' WHEN v>=60 THEN 'warning' ELSE 'critical' END AS level FROM v
""", (RUN_AGENTS, TOOL_EVENTS, AGENTS, series_sql("""SELECT "agentId" AS category, 'successRate' AS series, "successRate" AS value, 0 AS secondary, 0 AS size FROM agents""", False)))
query("series_bubble", lambda t: charts.points(grid(t, "overview"), True), SRC["overview"][1], """
SELECT series, category, value AS x, secondary AS y, greatest(4, least(24, 4+sqrt(abs(coalesce(nullif(size,0), secondary))))) AS r FROM grid WHERE value<>0 OR secondary<>0
""", SRC["overview"][2])
query("series_scatter", lambda t: charts.points(grid(t, "agents")), SRC["agents"][1], "SELECT series, category, value AS x, secondary AS y FROM grid WHERE value<>0 OR secondary<>0", SRC["agents"][2])
query("series_radial", lambda t: charts.radial(grid(t, "sessions")), SRC["sessions"][1], "SELECT concat(category, ' · ', series) AS label, value FROM grid", SRC["sessions"][2])
