"""Confidence: decay, reinforcement and feedback; ripple penalties; temporal validity. The clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import cut, near

DECAY, BONUS, DAY = 0.05, 0.1, 86_400


def formula(base: Column, decay: Column, days: Column, access: Column, feedback: Column, bonus: float = BONUS) -> Column:
    """base * exp(-decay * days) + bonus * ln(1 + access) + feedback within [-1, 1]; the sum is not clamped."""
    return base * F.exp(-decay * days) + bonus * F.log1p(access) + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), feedback))


def feedback_sums(log: DataFrame) -> DataFrame:
    """entity_id and the clamped sum of its feedback changes."""
    return log.where("reason = 'feedback'").groupBy("entity_id").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(F.col("new_value") - F.col("old_value")))).alias("feedback"))


def live(entities: DataFrame, log: DataFrame, now: int, decay: float = DECAY) -> DataFrame:
    """entity_id, confidence by the formula; the cached column is ignored."""
    days = F.greatest(F.lit(0), F.lit(now) - F.coalesce("created_at", F.lit(0))) / DAY
    joined = entities.join(feedback_sums(log).withColumnRenamed("entity_id", "id"), "id", "left")
    value = formula(F.coalesce("base_confidence", F.lit(1.0)), F.coalesce("decay_rate", F.lit(decay)), days, F.coalesce("access_count", F.lit(0)), F.coalesce("feedback", F.lit(0.0)))
    return joined.select(F.col("id").alias("entity_id"), value.alias("confidence"))


def fold_feedback(entities: DataFrame, feedback: DataFrame, now: int) -> DataFrame:
    """entity_id, confidence, applied after feedback rows (entity_id, seq, amount) in order.

    Each update reads the clamped sum of the earlier actual changes. With a fixed clock the part
    without feedback is constant, so the fold runs over an entity's amounts as an aggregate expression.
    """
    base = live(entities, feedback.select("entity_id", F.lit(0.0).alias("old_value"), F.lit(0.0).alias("new_value"), F.lit("feedback").alias("reason")).limit(0), now)
    lists = feedback.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("seq", "amount"))).alias("steps"))
    total = F.aggregate("steps", F.lit(0.0), lambda s, x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s + x["amount"])))
    return base.join(lists, "entity_id").select("entity_id", (F.col("confidence") + total).alias("confidence"), total.alias("applied"))


def dependents_of(dependencies: DataFrame, entity_id: int) -> DataFrame:
    """entity_id of what depends directly on an entity, each once."""
    rows = dependencies.where((F.col("target_id") == entity_id) & (F.col("dep_type") == "depends_on"))
    return rows.select(F.col("source_id").alias("entity_id")).distinct()


def ripple(dependencies: DataFrame, origin: int, penalty: float, hops: int = 2, factor: float = 0.5) -> DataFrame:
    """entity_id, hop, penalty of what depends on the origin, directly or through one more; the smallest hop counts once.

    A hop computes only the links to what the last one reached.
    """
    links = dependencies.where("dep_type = 'depends_on'").select(F.col("target_id").alias("on"), F.col("source_id").alias("entity_id"))
    frontier, rows = dependencies.sparkSession.range(1).select(F.lit(origin).cast("long").alias("entity_id")), 1
    seen, out = frontier, None
    for h in range(1, hops + 1):
        on = near(frontier.select(F.col("entity_id").alias("on")), rows)
        frontier = cut(links.join(on, "on", "left_semi").select("entity_id").distinct().join(seen, "entity_id", "left_anti"), F.count("*").alias("n"))
        rows = frontier.told["n"]
        seen = seen.unionByName(frontier)
        part = frontier.select("entity_id", F.lit(h).alias("hop"), F.lit(penalty * factor**h).alias("penalty"))
        out = part if out is None else out.unionByName(part)
    return out


def ripple_log(entities: DataFrame, penalties: DataFrame) -> DataFrame:
    """entity_id, old_value, new_value of the cached confidence after penalties, within [0, 1]."""
    return penalties.join(entities.select(F.col("id").alias("entity_id"), F.col("confidence").alias("old_value")), "entity_id").select(
        "entity_id", "old_value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("old_value") - F.col("penalty"))).alias("new_value")
    )


def temporal_validity(valid_from: Column, valid_until: Column, now: int) -> Column:
    """0 before its time, exp(-0.1 * days) after it, else 1; open ends don't limit."""
    late = F.exp(-0.1 * (F.lit(now) - valid_until) / DAY)
    return F.when(valid_from.isNotNull() & (F.lit(now) < valid_from), 0.0).when(valid_until.isNotNull() & (F.lit(now) > valid_until), late).otherwise(1.0)


def dependency_indegree(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy(F.col("target_id").alias("entity_id")).agg(F.count("*").alias("dependents"))
