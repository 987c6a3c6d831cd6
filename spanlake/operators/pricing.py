"""Price list and re-pricing of calls, models, agents and trends.

Prices and costs are decimals, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..tables import Tables
from .filters import Filters, narrowed
from .stats import TOKEN_NAMES, agent_model_stats, agent_stats, model_stats
from .timeseries import cost_trends

# fixed values: provider names of the price source and the ones calls carry
PROVIDER_NAMES = {"qwen": "bailian", "alibaba": "bailian", "z-ai": "zai", "zhipu": "zai"}

# fixed values: provider|model of a call -> id in the price source
MODEL_ALIASES = {
    "bailian|qwen3.7-plus": "qwen/qwen3.7-plus",
    "bailian|qwen3-coder-plus": "qwen/qwen3-coder-plus",
    "bailian|qwen3-coder-next": "qwen/qwen3-coder-next",
    "bailian|qwen3-max": "qwen/qwen3-max",
    "zai|glm-5.2": "z-ai/glm-5.2",
    "zai|glm-5-turbo": "z-ai/glm-5-turbo",
    "zai|glm-5": "z-ai/glm-5",
    "openai|gpt-4o": "openai/gpt-4o",
    "openai|gpt-4o-mini": "openai/gpt-4o-mini",
    "openai|o1": "openai/o1",
    "openai|o3-mini": "openai/o3-mini",
    "anthropic|claude-3.5-sonnet": "anthropic/claude-3.5-sonnet",
    "anthropic|claude-3-5-haiku": "anthropic/claude-3-5-haiku",
    "deepseek|deepseek-v4-pro": "deepseek/deepseek-v4-pro",
    "deepseek|deepseek-v4-flash": "deepseek/deepseek-v4-flash",
}

# fixed values: prices per token where the source has none: input, output
FALLBACK_PRICES = {
    "bailian|qwen3.7-plus": ("0.00000032", "0.00000128"),
    "bailian|qwen3-coder-plus": ("0.00000035", "0.0000011"),
    "bailian|qwen3-coder-next": ("0.00000011", "0.0000008"),
    "bailian|qwen3-max": ("0.00000125", "0.00000375"),
    "zai|glm-5.2": ("0.00000035", "0.0000011"),
    "zai|glm-5-turbo": ("0.0000012", "0.000004"),
    "zai|glm-5": ("0.0000006", "0.00000192"),
}

PRICE = "decimal(18,12)"


def price_dimension(raw: DataFrame) -> DataFrame:
    """(price_key, input_price, output_price) from rows (id, prompt, completion) with texts per token.

    Ids without a slash, prices that are no numbers and free models are skipped; missing models get the fallback list.
    """
    spark = raw.sparkSession
    provider = F.lower(F.split_part("id", F.lit("/"), F.lit(1)))
    renamed = F.coalesce(F.create_map(*[F.lit(x) for kv in PROVIDER_NAMES.items() for x in kv])[provider], provider)
    model = F.lower(F.regexp_replace("id", "^[^/]*/", ""))
    number = {c: F.when(F.trim(c) == "", F.lit(0.0)).otherwise(F.expr(f"try_cast({c} as double)")) for c in ("prompt", "completion")}
    rows = (raw.where("contains(id, '/')").select(F.concat(renamed, F.lit("|"), model).alias("price_key"), "id",
                                                  number["prompt"].alias("p"), number["completion"].alias("c"))
            .where("p is not null and c is not null and abs(p) < double('Infinity') and abs(c) < double('Infinity') and not (p = 0 and c = 0)"))
    listed = rows.groupBy("price_key").agg(F.max_by(F.struct("p", "c"), "id").alias("v")).select(
        "price_key", F.col("v.p").cast(PRICE).alias("input_price"), F.col("v.c").cast(PRICE).alias("output_price"))
    spare = spark.createDataFrame([(k, *v) for k, v in FALLBACK_PRICES.items()], "price_key string, i string, o string").select(
        "price_key", F.col("i").cast(PRICE).alias("input_price"), F.col("o").cast(PRICE).alias("output_price"))
    return listed.unionByName(spare.join(listed, "price_key", "left_anti"))


def with_prices(df: DataFrame, prices: DataFrame, aliases: dict[str, str] = MODEL_ALIASES) -> DataFrame:
    """Adds ``input_price`` and ``output_price``: by the row's own provider and model, else by its alias."""
    key = F.concat(F.lower(F.coalesce("provider", F.lit(""))), F.lit("|"), F.lower(F.coalesce("model", F.lit(""))))
    names = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    df = df.withColumn("price_key", key).withColumn("_alias", F.lower(names[F.col("price_key")]))
    other = prices.select(F.lower("price_key").alias("_alias"), F.col("input_price").alias("_i"), F.col("output_price").alias("_o"))
    return (df.join(prices, "price_key", "left").join(other, "_alias", "left")
            .withColumn("input_price", F.coalesce("input_price", "_i")).withColumn("output_price", F.coalesce("output_price", "_o"))
            .drop("_i", "_o", "_alias", "price_key"))


def token_cost(i: str, o: str, r: str | None = None, w: str | None = None) -> Column:
    """Input and cache tokens at the input price, output tokens at the output price; null without a price."""
    def part(name: str, price: str) -> Column:
        return F.col(name).cast("decimal(18,0)") * F.col(price)
    cost = part(i, "input_price") + part(o, "output_price")
    for extra in (r, w):
        if extra:
            cost = cost + part(extra, "input_price")
    return cost


ROW_COST = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
FRAME_COST = ("inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens")


def price_calls(t: Tables, prices: DataFrame, p: Filters = Filters(), aliases: dict[str, str] = MODEL_ALIASES) -> DataFrame:
    """Calls with a cost: the reported one, else the list price, else zero."""
    calls = with_prices(narrowed(t.llm_calls, p), prices, aliases)
    priced = F.coalesce(token_cost(*ROW_COST), F.lit(0))
    return calls.select("instance_id", "call_id", "provider", "model", F.when(F.coalesce("cost_usd", F.lit(0)) != 0, F.col("cost_usd")).otherwise(priced).cast("double").alias("costUsd"))


def price_total(t: Tables, prices: DataFrame, p: Filters = Filters(), aliases: dict[str, str] = MODEL_ALIASES) -> DataFrame:
    """List price of all calls; tokens are summed per model before they are priced."""
    sums = (narrowed(t.llm_calls, p).groupBy("provider", "model").agg(*[F.sum(c).alias(c) for c in ROW_COST]))
    return with_prices(sums, prices, aliases).agg(F.coalesce(F.sum(token_cost(*ROW_COST)), F.lit(0)).cast("double").alias("totalCost"))


def _repriced(df: DataFrame, prices: DataFrame, aliases: dict[str, str], *tokens: str) -> DataFrame:
    df = with_prices(df, prices, aliases)
    return df.withColumn("costUsd", F.coalesce(token_cost(*tokens).cast("double"), "costUsd")).drop("input_price", "output_price")


def price_models(t: Tables, prices: DataFrame, p: Filters = Filters(), aliases: dict[str, str] = MODEL_ALIASES) -> DataFrame:
    return _repriced(model_stats(t, p), prices, aliases, *FRAME_COST)


def price_agent_models(t: Tables, prices: DataFrame, p: Filters = Filters(), aliases: dict[str, str] = MODEL_ALIASES) -> DataFrame:
    return _repriced(agent_model_stats(t, p), prices, aliases, *FRAME_COST)


def price_agents(t: Tables, prices: DataFrame, p: Filters = Filters(), aliases: dict[str, str] = MODEL_ALIASES) -> DataFrame:
    """Agents at the mean cost of a token over all models; cache-write tokens count for agents but not in the mean."""
    models = price_models(t, prices, p, aliases)
    total = models.agg(F.sum(F.col("costUsd").cast("decimal(38,12)")).cast("double").alias("cost"),
                       F.sum(F.expr("inputTokens + cacheReadTokens + outputTokens")).alias("tokens"))
    rate = total.select(F.when(F.col("tokens") > 0, F.col("cost") / F.col("tokens"))).scalar()
    return (agent_stats(t, p).select("*", rate.alias("_rate"))
            .withColumn("costUsd", F.coalesce(F.expr(" + ".join(TOKEN_NAMES)) * F.col("_rate"), "costUsd")).drop("_rate"))


def price_trends(t: Tables, prices: DataFrame, p: Filters = Filters(), period: str = "day", aliases: dict[str, str] = MODEL_ALIASES) -> DataFrame:
    """Cost trends with input and output tokens at list price; cache tokens do not count here."""
    return _repriced(cost_trends(t, p, period), prices, aliases, "inputTokens", "outputTokens")


def price_periods(t: Tables, prices: DataFrame, now: str, p: Filters = Filters(), aliases: dict[str, str] = MODEL_ALIASES) -> DataFrame:
    """Cost of today and of the last 7 and 30 days that have calls, in the zone of the trends."""
    days = (price_trends(t, prices, p, "day", aliases).groupBy("period")
            .agg(F.sum(F.col("costUsd").cast("decimal(38,12)")).alias("cost")))
    today = F.lit(now).cast("timestamp")
    one = days.where("period is not null").select("period", "cost", (F.col("period") == period_of_now(today)).alias("_today"))
    parts = [one.where("_today").agg(F.sum("cost").alias("v")).select(F.lit("lastDayCost").alias("name"), "v")]
    for name, n in (("lastWeekCost", 7), ("lastMonthCost", 30)):
        parts.append(one.orderBy(F.desc("period")).limit(n).agg(F.sum("cost").alias("v")).select(F.lit(name).alias("name"), "v"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("v"))).cast("double"), F.lit(0.0)).alias(n) for n in ("lastDayCost", "lastWeekCost", "lastMonthCost")])


def period_of_now(now: Column) -> Column:
    return F.date_format(now + F.expr("interval 8 hours"), "yyyy-MM-dd")
