"""Decision operators: statuses from supporting and rejecting evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidate_status(support: Column, reject: Column) -> Column:
    """The truth table over whether evidence supports and rejects."""
    return F.when(support & reject, "conflicting").when(support, "supported").when(reject, "rejected").otherwise("unresolved")


def condition_status(subjects: Column, refuted: Column, verified: Column) -> Column:
    return F.when(subjects == 0, "unsupported").when(refuted, "conflicting").when(verified, "verified").otherwise("required")


def law_status(statuses: Column) -> Column:
    """The status of a law from the array of its condition statuses."""
    return (
        F.when(F.exists(statuses, lambda s: s == "conflicting"), "conflicting")
        .when(F.exists(statuses, lambda s: s.isin("required", "unsupported")), "condition-missing")
        .when(F.size(statuses) == 0, "recognized")
        .otherwise("verified")
    )


def resolve(visible: DataFrame, use: str, entity: str, local: Column, depth: Column, available: Column, positive: Column, cap: int = 32) -> DataFrame:
    """Resolution of each use from its visible, asserted bindings.

    If a use has local bindings, only those of greatest depth and, there, latest
    availability count.  Per entity the evidence is positive, negative or both; a
    use is conflicting if an entity has both, established with one positive
    entity, ambiguous with more, else unsupported.  Only the first ``cap`` entities are looked at; where there are
    more, ``truncated`` holds and no entity is named (``evidence.entity_decision`` makes such a use engine-limited).
    """
    from pyspark.sql import Window

    w = Window.partitionBy(use)
    level = F.when(local, F.struct(depth.alias("d"), available.alias("a")))
    top = visible.withColumn("_top", F.max(level).over(w)).filter(F.col("_top").isNull() | (level == F.col("_top")))
    entities = top.groupBy(use, entity).agg(F.bool_or(positive).alias("_yes"), F.bool_or(~positive).alias("_no"))
    ranked = entities.withColumn("_rn", F.row_number().over(w.orderBy(entity)))
    return ranked.groupBy(use).agg(
        F.when(F.bool_or(F.col("_yes") & F.col("_no") & (F.col("_rn") <= cap)), "conflicting")
        .when(F.count_if(F.col("_yes") & (F.col("_rn") <= cap)) == 1, "established")
        .when(F.count_if(F.col("_yes") & (F.col("_rn") <= cap)) > 1, "ambiguous")
        .otherwise("unsupported")
        .alias("status"),
        F.when((F.count_if("_yes") == 1) & (F.count(F.lit(1)) <= cap), F.min(F.when(F.col("_yes"), F.col(entity)))).alias("entity"),
        (F.count(F.lit(1)) > cap).alias("truncated"),
    )
