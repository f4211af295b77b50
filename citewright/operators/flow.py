"""Request flow as window queries over logged calls: pacing, breakers, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pacing(calls: DataFrame, interval: float) -> DataFrame:
    """Calls (host, call_id, arrival, duration) with their start: a call waits for the one before to end
    and for ``interval`` since it began. The recursion has a closed form: with c the sum of
    spacings before a call, it starts at c plus the largest arrival less its own c so far."""
    order = W.partitionBy("host").orderBy("arrival", "call_id")
    spacing = F.greatest(F.lit(float(interval)), F.col("duration"))
    rows = calls.withColumn("c", F.coalesce(F.sum(spacing).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    late = F.max(F.col("arrival") - F.col("c")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("start", late + F.col("c")).drop("c")


def breaker(calls: DataFrame) -> DataFrame:
    """Calls (host, call_id, ts, blocked) with ``skipped``: whether the host refused an earlier call."""
    order = W.partitionBy("host").orderBy("ts", "call_id").rowsBetween(W.unboundedPreceding, -1)
    return calls.withColumn("skipped", F.coalesce(F.max("blocked").over(order), F.lit(False)))


def memo(calls: DataFrame) -> DataFrame:
    """Calls (key, call_id, ts) with ``sent``: only the first of a key goes out."""
    order = W.partitionBy("key").orderBy("ts", "call_id")
    return calls.withColumn("sent", F.row_number().over(order) == 1)


def ttl_cache(calls: DataFrame, seconds: int = 1800) -> DataFrame:
    """Calls (key, call_id, ts) with ``hit``: a call within ``seconds`` of the last before it."""
    before = F.lag("ts").over(W.partitionBy("key").orderBy("ts", "call_id"))
    return calls.withColumn("hit", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp")) <= seconds * 1_000_000, F.lit(False)))


def usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy("request_id").agg(F.count("*").alias("requests"), F.sum("size").alias("characters"), F.max("size").alias("largest"))
