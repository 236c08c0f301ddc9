"""Retry outcomes over an attempt log (X5) and back-off schedules.

A call stops at its first success, its first non-transient failure, or its
``max_retries``-th attempt, so only the first ``max_retries`` attempts of a
call can matter.  ``row_number() <= max`` lets Spark put a map-side
``WindowGroupLimit`` in front of the shuffle: a call with millions of logged
attempts still ships at most ``max`` rows per map task.  The rest is one
grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import config as C
from faultline.functions.classify import is_transient


#: Retries that a service's own strategy may ask for; bounds what a call ships.
MOST_RETRIES = 20


def delay_ms(i: Column, cfg: C.RetryConfig, rule: Column | None = None) -> Column:
    """Delay after the i-th failed attempt: base * mult^(i-1), optionally capped; ``rule`` overrides where it is set."""
    base, mult = F.lit(float(cfg.base_delay_ms)), F.lit(float(cfg.multiplier))
    if rule is not None:
        base, mult = F.coalesce(rule.getField("base_delay_ms"), base), F.coalesce(rule.getField("multiplier"), mult)
    d = base * F.pow(mult, i - 1)
    if cfg.max_delay_ms is not None:
        d = F.least(d, F.lit(float(cfg.max_delay_ms)))
    return d


def total_backoff_ms(sleeps: Column, cfg: C.RetryConfig, rule: Column | None = None) -> Column:
    """Sum of the first ``sleeps`` delays (a geometric series)."""
    seq = F.sequence(F.lit(1), F.greatest(sleeps, F.lit(1)))
    total = F.aggregate(F.transform(seq, lambda i: delay_ms(i, cfg, rule)), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(sleeps > 0, total).otherwise(F.lit(0.0))


def retry_outcomes(attempts: DataFrame, cfg: C.RetryConfig = C.RetryConfig(), strategies: DataFrame | None = None) -> DataFrame:
    """Per call: tries used, final outcome and total back-off.

    ``attempts`` has (call_id, ord, ok, status_code, message); ``ord`` orders
    the attempts of a call.  With ``strategies`` (service, max_retries,
    base_delay_ms, multiplier; at most MOST_RETRIES retries) it also has the
    service of each attempt, and a call follows the strategy of the service of
    its first one, if that has any."""
    w = Window.partitionBy("call_id").orderBy("ord")
    limit = F.lit(cfg.max_retries)
    if strategies is not None:
        one = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("max_retries", "int"), ("base_delay_ms", "double"), ("multiplier", "double"))])
        rules = strategies.where(F.col("max_retries").between(1, MOST_RETRIES)).groupBy("service").agg(F.min(one).alias("rule"))
        attempts = attempts.join(rules, "service", "left")
        limit = F.coalesce(F.first("rule").over(w)["max_retries"], limit)
    most = cfg.max_retries if strategies is None else max(MOST_RETRIES, cfg.max_retries)
    first = attempts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    first = first.withColumn("limit", limit).filter(F.col("n") <= F.col("limit"))
    tr = is_transient(F.col("message"), F.col("status_code"))
    stop = F.col("ok") | ~tr | (F.col("n") == F.col("limit"))
    x = first.withColumn("transient", tr).withColumn("stop_n", F.when(stop, F.col("n")))
    g = x.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("logged"),
        F.min("stop_n").alias("stop_at"),
        F.min_by(F.struct("ok", "transient"), F.col("stop_n")).alias("s"),
        *([F.min_by("rule", "n").alias("rule")] if strategies is not None else []),
    )
    stopped = F.col("stop_at").isNotNull()
    tries = F.coalesce(F.col("stop_at"), F.col("logged"))
    outcome = (
        F.when(~stopped, F.lit("incomplete"))
        .when(F.col("s.ok"), F.lit("success"))
        .when(~F.col("s.transient"), F.lit("failed"))
        .otherwise(F.lit("max_retries"))
    )
    sleeps = F.when(stopped, tries - 1).otherwise(tries)
    return g.select(
        "call_id",
        tries.cast("int").alias("tries"),
        outcome.alias("outcome"),
        F.round(total_backoff_ms(sleeps.cast("int"), cfg, F.col("rule") if strategies is not None else None), 3).alias("backoff_ms"),
    )


def backoff_schedule(services: DataFrame, strategies: DataFrame | None = None, cfg: C.RetryConfig = C.RetryConfig()) -> DataFrame:
    """(service, retry_no, delay_ms) for every distinct service; a service's
    registered strategy (max_retries, base_delay_ms, multiplier) overrides the
    defaults; of several, the one with the fewest retries and then the shortest
    delays counts.  ``max_retries`` tries mean ``max_retries - 1`` sleeps."""
    s = services.select("service").distinct()
    if strategies is not None:
        one = F.struct("max_retries", "base_delay_ms", "multiplier")
        s = s.join(strategies.groupBy("service").agg(F.min(one).alias("one")), on="service", how="left").select("service", "one.*")
    else:
        s = s.select("service", *[F.lit(None).alias(c) for c in ("max_retries", "base_delay_ms", "multiplier")])
    mx = F.coalesce(F.col("max_retries"), F.lit(cfg.max_retries))
    base = F.coalesce(F.col("base_delay_ms").cast("double"), F.lit(float(cfg.base_delay_ms)))
    mult = F.coalesce(F.col("multiplier").cast("double"), F.lit(float(cfg.multiplier)))
    x = s.select("service", base.alias("b"), mult.alias("m"), F.explode(F.when(mx > 1, F.sequence(F.lit(1), mx - 1)).otherwise(F.array())).alias("retry_no"))
    d = F.col("b") * F.pow(F.col("m"), F.col("retry_no") - 1)
    if cfg.max_delay_ms is not None:
        d = F.least(d, F.lit(float(cfg.max_delay_ms)))
    return x.select("service", F.col("retry_no").cast("int").alias("retry_no"), F.round(d, 3).alias("delay_ms"))
