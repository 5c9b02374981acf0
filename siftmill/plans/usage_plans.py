"""Queries over usage events: savings, baselines, costs, cached calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmill.functions import usage as U
from siftmill.functions.scores import ratio
from siftmill.operators import metrics
from siftmill.plans import concept_sql as C
from siftmill.plans import sqltext as q
from siftmill.plans.registry import query
from siftmill.sources import concepts
from siftmill.sources.tables import table

NOW = "2024-01-31"
SAVINGS = """count(*) AS ops, count(*) FILTER (WHERE tokens_remote = 0) AS local_ops, sum(cost_actual)::DOUBLE AS cost_actual, sum(cost_baseline)::DOUBLE AS cost_baseline,
 CAST(sum(tokens_local) AS BIGINT) AS tokens_local, CAST(sum(tokens_baseline) AS BIGINT) AS tokens_baseline, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, CAST(sum(latency_baseline_ms) AS BIGINT) AS latency_baseline_ms,
 (sum(cost_baseline) - sum(cost_actual))::DOUBLE AS saved, count(*) FILTER (WHERE tokens_remote = 0)::DOUBLE / count(*) * 100 AS local_rate,
 CASE WHEN sum(cost_baseline) > 0 THEN (sum(cost_baseline) - sum(cost_actual))::DOUBLE / sum(cost_baseline)::DOUBLE * 100 ELSE 0 END AS savings_pct"""


def _now():
    return F.lit(f"{NOW} 00:00:00").cast("timestamp_ntz")


def _plain(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("cost_actual", "cost_baseline", "saved")})


@query(
    "savings_totals", "AGG27 FUN7",
    f"WITH {C.USAGE} " + " UNION ALL ".join(
        f"SELECT '{p}' AS period, {SAVINGS} FROM u WHERE ts > TIMESTAMP '{NOW}' - INTERVAL {n} DAY" for p, n in (("today", 1), ("week", 7), ("month", 30), ("all", 100000))
    ),
)
def savings_totals(spark, d):
    usage = concepts.usage(spark, d)
    # One scan: an event counts once for every period that holds it.
    periods = F.array_compact(F.array(*[F.when(U.in_period(F.col("ts"), p, _now()), F.lit(p)) for p in ("today", "week", "month", "all")]))
    return _plain(metrics.savings(usage.withColumn("period", F.explode(periods)), "period"))


@query("savings_by_operation", "AGG28", f"WITH {C.USAGE} SELECT operation, {SAVINGS} FROM u GROUP BY operation")
def savings_by_operation(spark, d):
    return _plain(metrics.savings(concepts.usage(spark, d), "operation"))


@query("savings_last_days", "AGG29", f"WITH {C.USAGE} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS ops, (sum(cost_baseline) - sum(cost_actual))::DOUBLE AS saved FROM u GROUP BY day ORDER BY day DESC LIMIT 7")
def savings_last_days(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return _plain(metrics.savings(concepts.usage(spark, d), day)).orderBy(F.desc("day")).limit(7).select("day", "ops", "saved")


@query("savings_daily", "AGG30", f"WITH {C.USAGE} SELECT strftime(ts, '%Y-%m-%d') AS day, {SAVINGS} FROM u GROUP BY day")
def savings_daily(spark, d):
    return _plain(metrics.savings(concepts.usage(spark, d), F.date_format("ts", "yyyy-MM-dd").alias("day")))


@query("savings_cumulative", "AGG30", f"WITH {C.USAGE} SELECT {SAVINGS} FROM u")
def savings_cumulative(spark, d):
    return _plain(metrics.savings(concepts.usage(spark, d)))


OPS = list(U.OPERATION_TOKENS) + ["other"]
_case = lambda i: "CASE op " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in U.OPERATION_TOKENS.items()) + f" ELSE {U.DEFAULT_TOKENS[i]} END"


@query(
    "operation_baselines", "AGG31 STR3",
    f"""WITH e AS (SELECT {q.sql_list(OPS)}[CAST(event_id % {len(OPS)} AS INT) + 1] AS op, greatest({C.K} % 5, 1) AS f, greatest({C.K} * 10, 100) AS l FROM events),
t AS (SELECT op, {_case(0)} + {_case(1)} * f + {_case(2)} * l AS i, {_case(3)} AS o FROM e)
SELECT op AS operation, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
 (sum(i) * 3 + sum(o) * 15)::DOUBLE / 1000000 AS cost_usd, CAST(sum((i + o) * 10) AS BIGINT) AS latency_ms FROM t GROUP BY op""",
)
def operation_baselines(spark, d):
    k = concepts.event_number()
    names = F.array(*[F.lit(o) for o in OPS])
    calls = table(spark, d, "events").select(
        F.element_at(names, (F.col("event_id") % len(OPS)).cast("int") + 1).alias("operation"), (k % 5).alias("files"), (k * 10).alias("lines")
    )
    tin, tout = U.baseline_tokens(F.col("operation"), F.col("files"), F.col("lines"))
    per_call = calls.select("operation", tin.alias("i"), tout.cast("long").alias("o"))
    prices = U.TOKEN_PRICES["medium"]
    return per_call.groupBy("operation").agg(
        F.count("*").alias("calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"),
        ((F.sum("i") * int(prices["input"]) + F.sum("o") * int(prices["output"])) / 1_000_000).alias("cost_usd"),
        F.sum((F.col("i") + F.col("o")) * (1000 // U.TOKENS_PER_SECOND)).alias("latency_ms"),
    )


@query(
    "token_costs", "AGG65",
    f"""WITH t AS (SELECT ['large', 'medium', 'small'][CAST(user_id % 3 AS INT) + 1] AS model, count(*) AS api_calls, sum({C.K} * 100) AS i, sum({C.K} * 20) AS o, sum({C.K} * 5) AS w, sum({C.K} * 50) AS r FROM events GROUP BY 1),
p(model, pi, po, pw, pr) AS (VALUES ('large', 15.0::DOUBLE, 75.0::DOUBLE, 18.75::DOUBLE, 1.5::DOUBLE), ('medium', 3.0, 15.0, 3.75, 0.3), ('small', 0.8, 4.0, 1.0, 0.08))
SELECT model, api_calls, CAST(i + o + w + r AS BIGINT) AS total_tokens, i::DOUBLE / 1000000 * pi AS input_cost, o::DOUBLE / 1000000 * po AS output_cost, w::DOUBLE / 1000000 * pw AS cache_write_cost, r::DOUBLE / 1000000 * pr AS cache_read_cost FROM t JOIN p USING (model)""",
)
def token_costs(spark, d):
    k = concepts.event_number()
    models = F.array(*[F.lit(m) for m in ("large", "medium", "small")])
    sums = table(spark, d, "events").select(F.element_at(models, (F.col("user_id") % 3).cast("int") + 1).alias("model"), k.alias("k")).groupBy("model").agg(
        F.count("*").alias("api_calls"), *[F.sum(F.col("k") * n).alias(c) for c, n in (("input", 100), ("output", 20), ("cache_write", 5), ("cache_read", 50))]
    )
    kinds = ["input", "output", "cache_write", "cache_read"]
    return sums.select(
        "model", "api_calls", sum((F.col(c) for c in kinds[1:]), F.col(kinds[0])).alias("total_tokens"),
        *[(F.col(c) / 1_000_000 * U.price(F.col("model"), c)).alias(f"{c}_cost") for c in kinds],
    )


@query(
    "cached_call_metrics", "AGG35",
    f"""WITH {C.USAGE}, w AS (SELECT * FROM u WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 28 DAY)
SELECT count(*) AS calls, count(*) FILTER (WHERE operation = 'view') AS cache_hits, count(*) FILTER (WHERE operation = 'view')::DOUBLE / count(*) AS hit_rate, sum(k)::DOUBLE / count(*) / 100 AS avg_confidence,
 CAST(sum(tokens_remote) AS BIGINT) AS cost_tokens, count(*) FILTER (WHERE operation NOT IN ('view', 'error'))::DOUBLE / count(*) FILTER (WHERE operation <> 'view') AS success_rate FROM w""",
)
def cached_call_metrics(spark, d):
    recent = concepts.usage(spark, d).filter(F.col("ts") > _now() - F.expr("INTERVAL 28 DAYS"))
    cached = F.col("operation") == "view"
    out = recent.agg(
        F.count("*").alias("calls"), F.count_if(cached).alias("cache_hits"), F.sum("k").alias("k"), F.sum("tokens_remote").alias("cost_tokens"),
        F.count_if(~F.col("operation").isin("view", "error")).alias("ok"),
    )
    n = F.col("calls")
    return out.select(
        "calls", "cache_hits", ratio(F.col("cache_hits"), n).alias("hit_rate"), (F.col("k") / n / 100).alias("avg_confidence"), "cost_tokens",
        ratio(F.col("ok"), n - F.col("cache_hits")).alias("success_rate"),
    )
