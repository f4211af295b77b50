"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow whose documents arrive in a seeded shuffle, at most ``rounds`` times
over. A copy's virtual finish time is the cumulative size of its flow up to and with it,
divided by the flow's target; the copies are range-sorted by finish time over all flows, and the mix is
cut where the budget is spent. Both cumulative sums take a range partition a task: totals of the partitions, of which there are
as many as the session shuffles to, tell where each starts. Rows that agree in source, id and size are
one counted row before their flow is sorted, so ids that are missing or repeated don't gather in one task.

Defined cases: null or blank texts have size 0 and are never taken; a null source is a source
of its own, ordered last; an empty table gives an empty result; repeated rows are documents
of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

WEIGHTS = (5, 2, 1)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = 3) -> DataFrame:
    """Targets of (source, source_size): shares by weight of the whole, none above ``rounds``
    times its source; the excess goes to the others by weight. The filling level is found
    in one pass over the sources in order of size per weight. Sources are few beside documents."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(rounds)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    seen, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy(F.lit(0))) - F.coalesce(F.sum("cap").over(seen), F.lit(0.0))) / F.sum("weight").over(rest)
    first = F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), level.alias("level")))
    filled = capped.withColumn("first", first).withColumn("first", F.min("first").over(W.partitionBy(F.lit(0))))
    target = F.least("cap", F.col("weight") * F.col("first.level"))  # least() skips a missing level: all at their caps
    return filled.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("size")).withColumn("key", key)
    queued = stage(_queued(rows.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("rows")), weights, rounds), "queue")
    budget = queued.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    copies = queued.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    order = _order(_finish(F.col("round")))
    copies = copies.where(_finish(F.col("round")) <= 2).select(*order)
    names = copies.columns
    copies = stage(_ranged(copies, *names), "mix")
    parts = copies.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect()  # as many as shuffle partitions at most
    # partitions that end inside the budget are taken whole; the one where it runs out is summed up copy by copy
    start, cut = 0, None
    for part, size in parts:
        if start + size > budget:
            spent = F.lit(start) + F.sum("size").over(W.orderBy(*names).rowsBetween(W.unboundedPreceding, 0))
            last = copies.where(F.col("part") == part).withColumn("spent", spent).where(F.col("spent") > budget)
            cut = last.agg(F.min(F.struct(*names)).alias("at")).first()["at"]
            break
        start += size
    times = F.lit(0)
    for r in range(rounds):
        finish = _finish(F.lit(r))
        take = finish <= 2
        if cut is not None:
            kinds = ("double", "boolean", "string", "string", "long", "long", "long")
            take = take & (F.struct(*_order(finish)) < F.struct(*[F.lit(x).cast(t) for x, t in zip(cut, kinds, strict=True)]))
        times = times + F.when((F.col("size") > 0) & take, 1).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


def _finish(round_: Column) -> Column:
    return (F.col("upto") + F.col("source_size") * round_) / F.col("target")


def _order(finish: Column) -> list[Column]:
    """A total order of copies: finish time, then source (null last), shuffle key, id, size, number among equal rows."""
    return [finish.alias("finish"), F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"), F.col("key"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("size"), F.col("nth")]


def _ranged(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` range-partitioned by these columns, with the number of their partition."""
    return rows.repartitionByRange(*by).withColumn("part", F.spark_partition_id())


def _queued(groups: DataFrame, weights: tuple[int, ...], rounds: int) -> DataFrame:
    """Every row of the ``groups`` of equal rows with ``upto``, its flow's cumulative size up to and with it, and its flow's figures."""
    groups = stage(_ranged(groups, "source", "key", "doc_id", "size"), "groups")
    totals = groups.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("rows")).alias("part_size"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    flows = source_targets(totals.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, rounds)
    named = flows.withColumnRenamed("source", "f")
    totals = totals.join(named, F.col("source").eqNullSafe(F.col("f")))
    totals = stage(totals.select(F.col("source").alias("s"), F.col("part").alias("b"), "before", "source_size", "target"), "totals")
    within = W.partitionBy("part", "source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    groups = groups.withColumn("within", F.sum(F.col("size") * F.col("rows")).over(within))
    rows = groups.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("b"))).drop("s", "b", "part")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rows.withColumn("upto", F.col("before") + F.col("within") - F.col("size") * (F.col("rows") - F.col("nth"))).drop("rows", "before", "within")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, rounds: int = 3) -> DataFrame:
    """The mix itself: rows of ``docs``, each as many times as it is taken.

    Rows that repeat id, source and size share what is taken of them as evenly as whole
    copies allow, rounded up."""
    plan = mix_sources(docs, weights, rounds).where("taken > 0")
    times = F.ceil(F.sum(F.col("taken") / F.col("size")) / F.count("*")).cast("int")
    plan = plan.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("flow"), F.col("size").alias("words")).agg(times.alias("times"))
    plan = stage(plan, "plan")  # of two tables, so that a key of many rows can be split
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("n"))
    on = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("flow")) & (F.col("n") == F.col("words"))
    return keyed.join(plan, on).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
