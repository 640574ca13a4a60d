"""Decisions over evidence: entities, proofs of rival values, retractions, tiers of meaning, hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.operators import relational

#: Rival values of a slot and hypotheses of a subject that are looked at; more of them make the decision engine-limited or the list truncated.
RIVALS, HYPOTHESES = 32, 16
#: Tiers of hypotheses from strongest to weakest.
TIERS = ["explicit", "derived", "supported", "tentative", "contradicted"]
# Predicates whose facts go from one entity to an equal one.
TRANSFERABLE = ["role", "type", "shape", "dimension", "quantity", "unit", "condition"]


def entity_decision(status: Column, truncated: Column) -> Column:
    """The status, or engine-limited where not all entities were looked at."""
    return F.when(truncated, "engine-limited").otherwise(status)


def establishes(polarity: Column, modality: Column, origin: Column) -> Column:
    """Only explicit, asserted, positive evidence establishes."""
    return (polarity == "positive") & (modality == "asserted") & (origin == "explicit")


def transferable(predicate: Column) -> Column:
    return predicate.isin(TRANSFERABLE)


def decide(pieces: DataFrame, slot: str, value: str, complete: str, authority: str, roots: str, conflicting: str, refuted: str, cap: int = RIVALS) -> DataFrame:
    """(slot, status, value) from pieces of evidence; a smaller ``authority`` is stronger, ``roots`` is an array of the sources of a proof.

    Pieces of one value count by their best proof (a complete one, then the
    stronger authority; equal ones add up their roots).  A conflict, then a
    refutation, decides.  One value is established by a complete proof, else partial.  Rivals
    of one authority, none of whose roots another holds in full, are ambiguous; else a single
    complete proof of the strongest authority, or one whose roots strictly hold
    those of all rivals, establishes its value; else the first of them is partial.
    """
    flags = pieces.groupBy(slot).agg(F.bool_or(conflicting).alias("_conflicting"), F.bool_or(refuted).alias("_refuted"))
    rank = F.struct((~F.col(complete)).alias("open"), F.col(authority).alias("authority"))
    best = pieces.withColumn("_best", F.min(rank).over(Window.partitionBy(slot, value))).filter(rank == F.col("_best"))
    one = best.groupBy(slot, value, "_best").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(roots)))).alias("_roots"))
    one = relational.capped(one, [slot], [F.col("_best.authority"), F.col("_best.open"), F.col(value)], cap)
    alternative = F.struct(F.col("_best.authority").alias("authority"), F.col("_best.open").alias("open"), F.col(value).alias("value"), F.col("_roots").alias("roots"))
    given = one.groupBy(slot).agg(F.array_sort(F.collect_list(alternative)).alias("all"), F.bool_or("truncated").alias("_cut"))
    every = F.col("all")
    lacks = lambda a, b: F.size(F.array_except(a["roots"], b["roots"])) > 0
    apart = F.forall(every, lambda a: F.forall(every, lambda b: (a["value"] == b["value"]) | ((a["authority"] == b["authority"]) & lacks(a, b) & lacks(b, a))))
    strongest = F.filter(every, lambda a: ~a["open"] & (a["authority"] == every[0]["authority"]))
    holds_all = F.filter(every, lambda a: ~a["open"] & F.forall(every, lambda b: (a["value"] == b["value"]) | (~lacks(b, a) & lacks(a, b))))
    single = F.size(every) == 1
    ambiguous = ~single & apart
    winner = F.when(F.size(strongest) == 1, strongest[0]["value"]).when(F.size(holds_all) == 1, F.get(holds_all, 0)["value"])
    status = (
        F.when(F.col("_conflicting"), "conflicting")
        .when(F.col("_refuted"), "unsupported")
        .when(F.col("_cut"), "engine-limited")
        .when(single, F.when(~every[0]["open"], "established").otherwise("partial"))
        .when(ambiguous, "ambiguous")
        .when(winner.isNotNull(), "established")
        .otherwise("partial")
    )
    out = given.join(flags, slot).withColumn("status", status).withColumn("_winner", winner)
    return out.select(slot, "status", F.when(F.col("status") == "established", F.when(single, every[0]["value"]).otherwise(F.col("_winner"))).when(F.col("status") == "partial", every[0]["value"]).alias("value"))


def retracted(log: DataFrame, digest: str, order: Column, positive: Column) -> DataFrame:
    """(digest, said, withdrawn) of relations said exactly once and denied afterwards, without being said again."""
    seen = log.groupBy(digest).agg(F.count_if(positive).alias("_n"), F.max(F.when(positive, order)).alias("said"), F.max(F.when(~positive, order)).alias("withdrawn"))
    return seen.filter((F.col("_n") == 1) & (F.col("said") < F.col("withdrawn"))).select(digest, "said", "withdrawn")


def first_tier(candidates: DataFrame, key: str, tier: str, value: str, evidence: str, cap: int = RIVALS) -> DataFrame:
    """(key, tier, status, values): the candidates of the first tier that has any, without those whose evidence another holds strictly.

    Tiers are numbered (what formulas say, then symbols, then structural candidates).
    """
    first = candidates.withColumn("_first", F.min(tier).over(Window.partitionBy(key))).filter(F.col(tier) == F.col("_first"))
    each = first.groupBy(key, tier, value).agg(F.array_distinct(F.flatten(F.collect_list(evidence))).alias(evidence))
    ranked = relational.capped(each, [key], [F.col(value)], cap)
    held = ranked.groupBy(key, tier).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("value"), F.col(evidence).alias("evidence")))).alias("all"), F.bool_or("truncated").alias("_cut"))
    every = F.col("all")
    more = lambda a, b: (F.size(F.array_except(b["evidence"], a["evidence"])) > 0) & (F.size(F.array_except(a["evidence"], b["evidence"])) == 0)
    left = F.filter(every, lambda a: ~F.exists(every, lambda b: more(a, b)))
    status = F.when(F.col("_cut"), "engine-limited").when(F.size(left) == 1, "established").otherwise("ambiguous")
    return held.select(key, tier, status.alias("status"), F.transform(left, lambda a: a["value"]).alias("values"))


def hypotheses(df: DataFrame, subject: list[str], support: str, order: list[str], cap: int = HYPOTHESES) -> DataFrame:
    """The first hypotheses of a subject by tier and a total order, ranked anew, with ``truncated``."""
    tier = F.array_position(F.lit(TIERS).cast("array<string>"), F.col(support))
    return relational.capped(df, subject, [tier, *(F.col(c) for c in order)], cap)


def nearest(points: DataFrame, anchors: DataFrame, keys: list[str], at: str, point_id: str, anchor_id: str) -> DataFrame:
    """(point, anchor, gap): the anchor closest to each point of its key, the earlier one at a tie; one sort, no pairs.

    Of anchors at one place the smallest id before a point and at it counts.
    """
    a = anchors.groupBy(*keys, at).agg(F.min(anchor_id).alias("_anchor")).select(*keys, at, "_anchor", F.lit(None).cast(points.schema[point_id].dataType).alias(point_id))
    both = points.select(*keys, at, F.lit(None).cast(anchors.schema[anchor_id].dataType).alias("_anchor"), point_id).unionByName(a)
    up = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    here = F.when(F.col("_anchor").isNotNull(), F.struct(F.col(at).alias("at"), F.col("_anchor").alias("id")))
    seen = both.withColumn("_before", F.last(here, True).over(up)).withColumn("_after", F.first(here, True).over(down)).filter(F.col(point_id).isNotNull())
    back, ahead = F.col(at) - F.col("_before.at"), F.col("_after.at") - F.col(at)
    take = F.when(F.col("_after").isNull() | (back <= ahead), F.struct(F.col("_before.id").alias("id"), back.alias("gap"))).otherwise(F.struct(F.col("_after.id").alias("id"), ahead.alias("gap")))
    return seen.withColumn("_n", take).select(point_id, F.col("_n.id").alias(anchor_id), F.col("_n.gap").alias("gap"))


def equation_links(formulas: DataFrame, file: str, formula: str, start: str, end: str, entities: str, cap: int = 16) -> DataFrame:
    """(file, formula, earlier, shared, truncated): the latest ``cap`` formulas that end before one begins (or where it does) and share an entity with it.

    Ends and beginnings are sorted together per entity, and only the last ``cap`` + 1 ends before a
    beginning are looked at, which hold all that can be among its latest
    ``cap``; so an entity of every formula makes no square of rows.
    """
    each = formulas.select(file, formula, start, end, F.explode(F.array_distinct(entities)).alias("_entity"))
    ends = each.select(file, "_entity", F.col(end).alias("_at"), F.lit(0).alias("_kind"), formula, F.lit(None).cast(each.schema[start].dataType).alias(start))
    both = ends.unionByName(each.select(file, "_entity", F.col(start).alias("_at"), F.lit(1).alias("_kind"), formula, start))
    sofar = Window.partitionBy(file, "_entity").orderBy("_at", "_kind", formula).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_ended", F.count_if(F.col("_kind") == 0).over(sofar))
    last = Window.partitionBy(file, "_entity").orderBy("_ended").rangeBetween(-cap, 0)
    end_row = F.when(F.col("_kind") == 0, F.struct(F.col("_at").alias("e"), F.col(formula).alias("f")))
    near = both.withColumn("_prev", F.collect_list(end_row).over(last)).filter("_kind = 1").select(file, formula, start, "_entity", F.explode("_prev").alias("_p"))
    pairs = near.filter((F.col("_p.e") <= F.col(start)) & (F.col("_p.f") != F.col(formula))).groupBy(file, formula, F.col("_p.f").alias("earlier"), F.col("_p.e").alias("_end")).agg(F.array_sort(F.collect_set("_entity")).alias("shared"))
    return relational.capped(pairs, [file, formula], [F.desc("_end"), F.desc("earlier")], cap).select(file, formula, "earlier", "shared", "truncated")


def antecedents(clauses: DataFrame, keys: list[str], order: str, start: str, end: str, mentions: str, reach: int = 160, most: int = 8) -> DataFrame:
    """Adds ``antecedent``: the clause before, if it ends at most ``reach`` before this one begins and has one to ``most`` mentions."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(F.struct(F.col(order).alias("i"), F.col(end).alias("e"), F.col(mentions).alias("m"))).over(w)
    out = clauses.withColumn("_b", before)
    return out.withColumn("antecedent", F.when((F.col(start) - F.col("_b.e") <= reach) & F.col("_b.m").between(1, most), F.col("_b.i"))).drop("_b")
