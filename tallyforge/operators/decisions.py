"""From findings to decisions: severity, priority, tier, and one recommendation of each kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities from least to most; positive stands outside.
LADDER = ("info", "watch", "high", "critical")


def bumped_severity(base: Column, factors: Sequence[Column]) -> Column:
    """One step up the ladder for each factor that holds, to its top at most; positive stays positive."""
    steps = sum((F.coalesce(f, F.lit(False)).cast("int") for f in factors), F.lit(0))
    ladder = F.array(*[F.lit(s) for s in LADDER])
    at = F.coalesce(F.array_position(ladder, base).cast("int"), F.lit(1))
    return F.when(base == "positive", base).otherwise(F.element_at(ladder, F.least(F.greatest(at, F.lit(1)) + steps, F.lit(len(LADDER)))))


def insight_priority(severity: Column, impact: Column, share: Column) -> Column:
    impact, share = F.coalesce(impact, F.lit(0.0)), F.coalesce(share, F.lit(0.0))
    return (
        F.when((severity == "critical") | (impact >= 250) | (share >= 70), "critical")
        .when((severity == "high") | (impact >= 75) | (share >= 60), "warning")
        .when((severity == "watch") | (impact >= 25) | (share >= 55), "monitor")
        .otherwise("informational")
    )


def decision_tier(priority: Column, impact: Column, category: Column, signal: Column, visible: float = 10.0) -> Column:
    """now, monitor or background."""
    impact = F.coalesce(impact, F.lit(0.0))
    calm = F.coalesce(signal.isin("stable_pricing", "improving_consistency"), F.lit(False))
    return (
        F.when(calm, "background")
        .when(priority == "critical", "now")
        .when((priority == "warning") & (impact >= 50), "now")
        .when((category == "concentration") & (priority == "warning") & (impact >= 25), "now")
        .when(category == "stale_pricing", "monitor")
        .when(priority.isin("warning", "monitor"), "monitor")
        .when(impact < visible, "background")
        .otherwise("monitor")
    )


def best_of_each(candidates: DataFrame, limit: int) -> DataFrame:
    """The candidate of most impact for each dedupe_key, then for each title, then the best of these."""
    for key in ("dedupe_key", "title"):
        best = Window.partitionBy(key).orderBy(F.desc("impact"), "candidate_id")
        candidates = candidates.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).drop("_n")
    return candidates.orderBy(F.desc("impact"), "candidate_id").limit(limit)


def merged_alerts(local: DataFrame, library: DataFrame, key: Sequence[str]) -> DataFrame:
    """Both lists, the local alert where both have one."""
    return local.unionByName(library.join(local.select(*key), list(key), "left_anti"))


def visit_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Change of each count (name, n) since the visit before; a count that is missing is zero."""
    both = current.select("name", F.col("n").alias("now")).join(previous.select("name", F.col("n").alias("then")), "name", "full_outer").fillna(0)
    return both.withColumn("change", F.col("now") - F.col("then"))
