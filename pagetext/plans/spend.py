"""Queries over model calls, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetext.operators import spend as op
from pagetext.plans.fixtures import SQL, fixture

CALLS, RATES = SQL["f4_calls"], SQL["f5_rates"]
LIMIT = 2.0


def _overrides(rates):
    return rates.where("model = 'gemini-2.5-flash'").select("provider", "model", *[(F.lit(3.0) if r == "output" else F.lit(None)).cast("bigint" if r == "threshold_tokens" else "double").alias(r) for r in op.RATES])


def _priced(spark, d):
    rates = fixture(spark, d, "f5_rates")
    return op.price_calls(fixture(spark, d, "f4_calls"), rates, _overrides(rates))


def price_calls(spark, d):
    return _priced(spark, d).select("call_id", F.round("cost", 12).alias("cost"), "exact")


def spend_totals(spark, d):
    return op.spend_totals(_priced(spark, d)).withColumn("cost", F.round("cost", 6))


def spend_by_model(spark, d):
    return op.spend_by(_priced(spark, d), "model").withColumn("cost", F.round("cost", 6))


def spend_by_feature(spark, d):
    return op.spend_by(_priced(spark, d), "feature").withColumn("cost", F.round("cost", 6))


def budget_cut(spark, d):
    return op.budget_cut(_priced(spark, d), LIMIT).select("call_id", F.round("before", 10).alias("before"), "skipped")


def call_rate(spark, d):
    """Windows of a day here: the given events are minutes apart."""
    return op.call_rate(fixture(spark, d, "f4_calls"), limit=12, seconds=86_400).select("call_id", "in_window", "limited", "wait_ms")


def registry_check(spark, d):
    rates = fixture(spark, d, "f5_rates")
    called = fixture(spark, d, "f4_calls").select("provider", "model").distinct()
    return op.registry_check(called, rates, rates)


def load_rates(spark, d):
    """Cards of many providers and models as nested JSON, one for each size of part, read back."""
    rows = fixture(spark, d, "f5_cards")
    models = rows.groupBy("card", "provider").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(*op.RATES)))).alias("models"))
    cards = models.groupBy("card").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("provider", "models")))).alias("card_json"))
    return op.load_rates(cards, "card_json")


def formats(spark, d):
    now = F.max("ts").over(Window.partitionBy("provider"))
    calls = fixture(spark, d, "f4_calls").withColumn("now", now)
    return calls.select("call_id", op.fmt_money(F.col("chars") / 1000).alias("money"), op.fmt_bytes(F.col("call_id") * 37).alias("size"), op.fmt_ago(F.col("ts"), F.col("now")).alias("ago"), op.escape_html(F.concat(F.lit("<a href=\"x\">'"), "model", F.lit("'&</a>"))).alias("html"))


QUERIES = {f.__name__: f for f in (price_calls, spend_totals, spend_by_model, spend_by_feature, budget_cut, call_rate, registry_check, load_rates, formats)}

_CARD = f"r AS (SELECT provider, model, input, CASE WHEN model = 'gemini-2.5-flash' THEN 3.0::DOUBLE ELSE output END AS output, cache_hit, threshold_tokens, input_above, output_above, per_million_chars FROM ({RATES}))"
_PRICED = f"""{_CARD}, c AS (SELECT *, CASE WHEN provider = 'deepl' THEN 'deepl' ELSE model END AS k FROM ({CALLS})),
j AS (SELECT c.*, r.input, r.output, r.cache_hit, r.per_million_chars, r.model IS NOT NULL AS rated, coalesce(prompt_tokens, 0) AS p, coalesce(completion_tokens, 0) AS q, prompt_tokens IS NOT NULL AS used,
  CASE WHEN r.threshold_tokens IS NOT NULL AND coalesce(prompt_tokens, 0) > r.threshold_tokens THEN coalesce(r.input_above, r.input) ELSE r.input END AS ir,
  CASE WHEN r.threshold_tokens IS NOT NULL AND coalesce(prompt_tokens, 0) > r.threshold_tokens THEN coalesce(r.output_above, r.output) ELSE r.output END AS orr
  FROM c LEFT JOIN r ON c.provider = r.provider AND c.k = r.model),
s AS (SELECT *, CASE WHEN provider = 'deepl' AND rated THEN chars / 1e6 * per_million_chars WHEN provider = 'deepl' THEN 0
  WHEN used AND rated THEN CASE WHEN cache_hit IS NOT NULL AND cache_hit_tokens IS NOT NULL THEN cache_hit_tokens / 1e6 * cache_hit + (p - cache_hit_tokens) / 1e6 * ir ELSE p / 1e6 * ir END + q / 1e6 * orr
  WHEN used THEN (p + q) * CASE WHEN provider = 'deepseek' THEN 2e-7 ELSE 3e-7 END ELSE chars / 1000.0::DOUBLE * CASE WHEN provider = 'deepseek' THEN 2e-4 ELSE 3e-4 END END AS cost, rated AND (provider = 'deepl' OR used) AS exact FROM j)"""

ORACLES = {
    "price_calls": f"WITH {_PRICED} SELECT call_id, round(cost, 12) AS cost, exact FROM s",
    "spend_totals": f"WITH {_PRICED} SELECT chapter_id, round(sum(cost), 6) AS cost, count(*) AS calls, bool_or(NOT exact) AS estimated FROM s GROUP BY ROLLUP (chapter_id)",
    "spend_by_model": f"WITH {_PRICED} SELECT model, round(sum(cost), 6) AS cost, count(*) AS calls FROM s GROUP BY 1",
    "spend_by_feature": f"WITH {_PRICED} SELECT feature, round(sum(cost), 6) AS cost, count(*) AS calls FROM s GROUP BY 1",
    "budget_cut": f"WITH {_PRICED}, b AS (SELECT call_id, coalesce(sum(cost) OVER (PARTITION BY chapter_id ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT call_id, round(before, 10) AS before, round(before, 9) >= {LIMIT} AS skipped FROM b",
    "call_rate": f"""WITH c AS (SELECT call_id, provider, (epoch_us(ts) // 1000) AS ms FROM ({CALLS})), w AS (SELECT call_id, ms, count(*) OVER x AS n, min(ms) OVER x AS oldest FROM c WINDOW x AS (PARTITION BY provider ORDER BY ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW))
SELECT call_id, n AS in_window, n >= 12 AS limited, CASE WHEN n >= 12 THEN 86400000 - (ms - oldest) + 250 ELSE 0 END AS wait_ms FROM w""",
    "registry_check": f"""WITH r AS ({RATES}), o AS (SELECT DISTINCT provider, model FROM ({CALLS}))
SELECT coalesce(o.provider, r.provider) AS provider, coalesce(o.model, r.model) AS model, o.model IS NOT NULL AS offered, r.model IS NOT NULL AS described, r.model IS NOT NULL OR coalesce(o.provider, r.provider) = 'deepl' AS priced FROM o FULL JOIN r ON o.provider = r.provider AND o.model = r.model""",
    "load_rates": f"SELECT provider, model, {', '.join(op.RATES)} FROM ({SQL['f5_cards']}) WHERE NOT starts_with(provider, '_') AND NOT starts_with(model, '_')",
    "formats": f"""WITH c AS (SELECT *, max(ts) OVER (PARTITION BY provider) AS now, call_id * 37 AS n FROM ({CALLS})), m AS (SELECT *, chars / 1000.0::DOUBLE AS cost, CAST(floor(((epoch_us(now) // 1000) - (epoch_us(ts) // 1000)) / 60000) AS BIGINT) AS mi FROM c)
SELECT call_id, CASE WHEN cost = 0 THEN '$0.00' WHEN cost < 0.01 THEN '<$0.01' ELSE '$' || printf('%.2f', round(cost + 1e-9, 2)) END AS money,
  CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024, 1)) || ' KB' ELSE printf('%.2f', round(n / 1048576, 2)) || ' MB' END AS size,
  CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN mi || 'm ago' WHEN mi < 1440 THEN (mi // 60) || 'h ago' WHEN mi < 10080 THEN (mi // 1440) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS ago,
  '&lt;a href=&quot;x&quot;&gt;&#39;' || model || '&#39;&amp;&lt;/a&gt;' AS html FROM m""",
}
