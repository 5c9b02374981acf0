"""Time periods, operation estimates and token prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmill.functions.scores import lookup

# Tokens an operation would take without local handling, as
# (input base, input per file, input per line, output). Files count at least 1, lines 100.
OPERATION_TOKENS = {
    "context": (500, 200, 0, 500),
    "check": (800, 0, 4, 300),
    "scan": (2000, 150, 0, 1000),
    "fix": (1500, 0, 4, 500),
    "fix_apply": (2250, 0, 6, 750),
    "query": (3000, 0, 0, 500),
    "lesson": (1500, 0, 0, 300),
    "template": (2000, 0, 0, 800),
    "agent": (5000, 0, 0, 2000),
    "deploy": (3000, 0, 0, 1000),
    "stats": (1000, 0, 0, 200),
    "dismiss": (800, 0, 0, 200),
    "trends": (2000, 0, 0, 500),
    "confidence": (1500, 0, 0, 300),
    "impact": (2500, 0, 0, 600),
    "dashboard": (500, 0, 0, 200),
}
DEFAULT_TOKENS = (2000, 0, 0, 500)
# Price per million tokens by model size.
TOKEN_PRICES = {
    "large": {"input": 15.00, "output": 75.00, "cache_write": 18.75, "cache_read": 1.50},
    "medium": {"input": 3.00, "output": 15.00, "cache_write": 3.75, "cache_read": 0.30},
    "small": {"input": 0.80, "output": 4.00, "cache_write": 1.00, "cache_read": 0.08},
}
TOKENS_PER_SECOND = 100
PERIOD_DAYS = {"today": 1, "week": 7, "month": 30}


def epoch_week(seconds: Column) -> Column:
    return F.floor(seconds / 604800).cast("long")


def in_period(ts: Column, period: str, now: Column) -> Column:
    """True within the period before ``now``; any other period name means all time."""
    days = PERIOD_DAYS.get(period)
    return F.lit(True) if days is None else ts > now - F.make_dt_interval(F.lit(days))


def baseline_tokens(operation: Column, files: Column, lines: Column) -> tuple[Column, Column]:
    """(input, output) tokens of an operation without local handling."""
    f, n = F.greatest(files, F.lit(1)), F.greatest(lines, F.lit(100))

    def coefficient(i: int) -> Column:
        return lookup({k: v[i] for k, v in OPERATION_TOKENS.items()}, operation, F.lit(DEFAULT_TOKENS[i]))

    return coefficient(0) + coefficient(1) * f + coefficient(2) * n, coefficient(3)


def price(model: Column, kind: str) -> Column:
    return lookup({m: p[kind] for m, p in TOKEN_PRICES.items()}, model, F.lit(TOKEN_PRICES["medium"][kind]))
