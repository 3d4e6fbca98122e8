"""Model calls: prices from a rate card, spend totals, budgets and call rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATES = ["input", "output", "cache_hit", "threshold_tokens", "input_above", "output_above", "per_million_chars"]
#: Rough prices where the card has none, by token and by 1,000 characters: (deepseek, others).
ROUGH_TOKEN = (0.0000002, 0.0000003)
ROUGH_K_CHARS = (0.0002, 0.0003)
PER_CHARACTER = "deepl"


def load_rates(cards: DataFrame, column: str = "card") -> DataFrame:
    """Nested rate cards (provider -> model -> rates, as JSON) to rows; keys that start with _ are notes."""
    rate = "struct<" + ",".join(f"{r}:{'bigint' if r == 'threshold_tokens' else 'double'}" for r in RATES) + ">"
    top = cards.select(F.explode(F.from_json(column, "map<string,string>")).alias("provider", "models")).where(~F.startswith("provider", F.lit("_")))
    models = top.select("provider", F.explode(F.from_json("models", "map<string,string>")).alias("model", "body")).where(~F.startswith("model", F.lit("_")) & F.startswith(F.ltrim("body"), F.lit("{")))
    return models.select("provider", "model", F.from_json("body", rate).alias("r")).select("provider", "model", "r.*")


def effective_rates(rates: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rates with the user's overrides, field by field."""
    mine = overrides.select("provider", "model", *[F.col(r).alias(f"o_{r}") for r in RATES])
    return rates.join(mine, ["provider", "model"], "full").select("provider", "model", *[F.coalesce(f"o_{r}", r).alias(r) for r in RATES])


def price_calls(calls: DataFrame, rates: DataFrame, overrides: DataFrame) -> DataFrame:
    """calls with cost and exact. Cards are small and joined by hash; a call has one row whatever the card."""
    card = effective_rates(rates, overrides).withColumn("rated", F.lit(True))
    c = calls.withColumn("key", F.when(F.col("provider") == PER_CHARACTER, PER_CHARACTER).otherwise(F.col("model")))
    r = c.join(F.broadcast(card.withColumnRenamed("model", "key")), ["provider", "key"], "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    above = F.coalesce(F.col("threshold_tokens").isNotNull() & (zero("prompt_tokens") > F.col("threshold_tokens")), F.lit(False))
    price = lambda name: F.when(above, F.coalesce(f"{name}_above", name)).otherwise(F.col(name))
    million = lambda n: n / F.lit(1_000_000)
    hit = F.col("cache_hit_tokens")
    fresh = million(zero("prompt_tokens")) * price("input")
    split = million(hit) * F.col("cache_hit") + million(zero("prompt_tokens") - hit) * price("input")
    exact_cost = F.when(F.col("cache_hit").isNotNull() & hit.isNotNull(), split).otherwise(fresh) + million(zero("completion_tokens")) * price("output")
    used = F.col("prompt_tokens").isNotNull() | F.col("completion_tokens").isNotNull()
    rough = lambda pair: F.when(F.col("provider") == "deepseek", pair[0]).otherwise(pair[1])
    rated, by_character = F.col("rated").isNotNull(), F.col("provider") == PER_CHARACTER
    cost = (
        F.when(by_character & rated, million(zero("chars")) * F.col("per_million_chars"))
        .when(by_character, F.lit(0.0))
        .when(used & rated, exact_cost)
        .when(used, (zero("prompt_tokens") + zero("completion_tokens")) * rough(ROUGH_TOKEN))
        .otherwise(zero("chars") / 1000 * rough(ROUGH_K_CHARS))
    )
    return r.select(*calls.columns, cost.alias("cost"), (rated & (by_character | used)).alias("exact"))


def spend_totals(spend: DataFrame) -> DataFrame:
    """(chapter_id, cost, calls, estimated): each chapter, and all of them under a null chapter."""
    return spend.rollup("chapter_id").agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"), F.bool_or(~F.col("exact")).alias("estimated"))


def spend_by(spend: DataFrame, column: str) -> DataFrame:
    return spend.groupBy(column).agg(F.sum("cost").alias("cost"), F.count("*").alias("calls"))


def budget_cut(items: DataFrame, limit: float, run: str = "chapter_id", order: tuple[str, ...] = ("ts", "call_id"), slot_seconds: int = 86_400) -> DataFrame:
    """items with `before`, the run's spend before each, and whether it is skipped as that reaches the limit.

    A run is cut into slots of time by the first column of the order: each slot is summed up by itself,
    and starts from what the slots before it have spent, so a long run isn't one task's. Sums are decimal
    inside, so that their order doesn't matter."""
    slot = F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / slot_seconds)
    told = items.withColumn("_slot", slot).withColumn("_cost", F.col("cost").cast("decimal(30,15)"))
    slots = told.groupBy(run, "_slot").agg(F.sum("_cost").alias("_spent"))
    earlier = F.sum("_spent").over(Window.partitionBy(run).orderBy(F.col("_slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
    carried = slots.select(F.col(run).alias("_run"), F.col("_slot").alias("_own"), F.coalesce(earlier, F.lit(0)).alias("_carried"))
    own = F.sum("_cost").over(Window.partitionBy(run, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    met = told.withColumn("_before", own).join(carried, F.col(run).eqNullSafe(F.col("_run")) & F.col("_slot").eqNullSafe(F.col("_own")))
    before = (F.coalesce("_before", F.lit(0)) + F.col("_carried")).cast("double")
    return met.select(*items.columns, before.alias("before")).withColumn("skipped", F.lit(limit > 0) & (F.round("before", 9) >= limit))


def call_rate(calls: DataFrame, limit: int = 12, seconds: int = 60, slack_ms: int = 250) -> DataFrame:
    """calls with the number in the provider's trailing window (a call exactly `seconds` old is out),
    whether one more would exceed the limit, and the wait until then in ms.

    Time is cut into slots as long as the window; a call is looked at in its own slot and, as one that
    came before, in the next, so a provider's calls are spread by time. There it comes and, when it is as old as
    the window, goes: a running sum counts those that are in, however many, and the call after the last that
    went is the oldest. Calls without a time are in no window."""
    size = seconds * 1000
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    own = calls.withColumn("ms", ms).withColumn("slot", F.floor(F.col("ms") / size)).withColumn("own", F.lit(True))
    before = own.where("ms IS NOT NULL").select("provider", "ms", (F.col("slot") + 1).alias("slot"), F.lit(False).alias("own"))
    both = own.unionByName(before, allowMissingColumns=True)
    w = Window.partitionBy("provider", "slot")
    told = both.withColumn("next", F.lead("ms").over(w.orderBy("ms")))
    none = F.lit(None).cast("bigint")
    comes = F.struct(F.col("ms").alias("at"), F.lit(1).alias("n"), none.alias("left"))
    goes = F.struct((F.col("ms") + size).alias("at"), F.lit(-1).alias("n"), F.col("next").alias("left"))
    events = told.withColumn("e", F.explode(F.when(F.col("own"), F.array(comes)).otherwise(F.array(comes, goes)))).drop("next").select("*", "e.*").drop("e")
    upto = w.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("in_window", F.when(F.col("ms").isNotNull(), F.sum("n").over(upto)).otherwise(F.lit(0).cast("bigint")))
    seen = counted.withColumn("oldest", F.coalesce(F.max("left").over(upto), F.min("ms").over(upto))).where("own").drop("at", "n", "left")
    full = F.col("in_window") >= limit
    return seen.withColumn("limited", full).withColumn("wait_ms", F.when(full, size - (F.col("ms") - F.col("oldest")) + slack_ms).otherwise(F.lit(0))).drop("ms", "oldest", "slot", "own")


def registry_check(offered: DataFrame, described: DataFrame, priced: DataFrame) -> DataFrame:
    """(provider, model, offered, described, priced); a per-character provider is priced as a whole."""
    mark = lambda df, name: df.select("provider", "model").distinct().withColumn(name, F.lit(True))
    whole = priced.where(F.col("provider") == PER_CHARACTER).select("provider").distinct().withColumn("whole", F.lit(True))
    every = mark(offered, "offered").join(mark(described, "described"), ["provider", "model"], "full").join(mark(priced, "priced"), ["provider", "model"], "full").join(F.broadcast(whole), "provider", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return every.select("provider", "model", no("offered").alias("offered"), no("described").alias("described"), no(F.coalesce("priced", "whole")).alias("priced"))


def fmt_money(cost: Column) -> Column:
    return F.when(cost == 0, "$0.00").when(cost < 0.01, "<$0.01").otherwise(F.format_string("$%.2f", F.round(cost + 1e-9, 2)))


def fmt_bytes(n: Column) -> Column:
    kb, mb = F.round(n / 1024, 1), F.round(n / (1024 * 1024), 2)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.2f MB", mb))


def fmt_ago(ts: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))) / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    told = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, told(minutes, "m")).when(hours < 24, told(hours, "h")).when(days < 7, told(days, "d")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text
