"""Projects of several files: includes, source order, components, trees, cycles, and facts across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.functions import text
from lemmata.operators import graph


def include_targets(includes: DataFrame, documents: DataFrame, path: str = "path", target: str = "target") -> DataFrame:
    """Adds ``included``: the file that a target names, as it is or with .tex behind; null if there is none."""
    spelt = includes.withColumn("_whole", text.include_path(F.col(path), F.col(target)))
    known = documents.select(F.col("path").alias("_path"), F.col("file_id").alias("_id"))
    exact = spelt.join(known, F.col("_whole") == F.col("_path"), "left").withColumnRenamed("_id", "_exact").drop("_path")
    tex = exact.join(known, F.concat("_whole", F.lit(".tex")) == F.col("_path"), "left")
    return tex.withColumn("included", F.coalesce("_exact", "_id")).drop("_whole", "_exact", "_path", "_id")


def _jumped(links: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Linked lists (key, next, values) with the values summed from each row to the end of its list, by doubling the links; rows on a ring are left out."""
    links = graph.stored(links)
    rounds = max(1, links.count().bit_length() + 1)
    far = [F.col("next").getField(k).alias(f"_{k}") for k in key]
    for _ in range(rounds):
        if not links.filter("next is not null").limit(1).count():
            break
        onward = links.select(*(F.col(k).alias(f"_{k}") for k in key), *(F.col(v).alias(f"_{v}") for v in values), F.col("next").alias("_then"))
        live = links.filter("next is not null").select(*links.columns, *far)
        moved = live.join(onward, [f"_{k}" for k in key]).select(*key, F.col("_then").alias("next"), *((F.col(v) + F.col(f"_{v}")).alias(v) for v in values))
        links = graph.stored(moved.unionByName(links.filter("next is null").select(*key, "next", *values)))
    return links.filter("next is null").select(*key, *values)


def _heads(edges: DataFrame, mains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, head), where a head is a main file or one that is not included exactly once, and every other file has the head above it; and the heads that some file includes."""
    files = edges.select("file").unionByName(edges.select(F.col("included").alias("file"))).unionByName(mains.select(F.col("main").alias("file"))).distinct()
    into = edges.groupBy(F.col("included").alias("file")).agg(F.count("*").alias("n"), F.min("file").alias("up"))
    roots = mains.select(F.col("main").alias("file"), F.lit(True).alias("_main")).distinct()
    each = files.join(into, "file", "left").join(roots, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("n"), F.when((F.col("n") == 1) & F.col("_main").isNull(), F.col("up")).alias("up"))
    each = graph.stored(each)
    links = graph.stored(each.select("file", F.coalesce("up", "file").alias("head")))
    for _ in range(max(1, links.count().bit_length() + 1)):
        further = links.select(F.col("file").alias("head"), F.col("head").alias("_next"))
        links, before = graph.stored(links.join(further, "head").select("file", F.col("_next").alias("head"), (F.col("_next") != F.col("head")).alias("moved"))), links
        if not links.filter("moved").limit(1).count():
            break
        links = links.select("file", "head")
    ends = each.filter("up is null").select(F.col("file").alias("head"))
    return links.select("file", "head").join(ends, "head", "left_semi").select("file", "head"), each.filter("up is null and n > 0").select(F.col("file").alias("head"))


def source_tour(mains: DataFrame, includes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(main, file) that each main file reaches, and (main, file, way, parent, offset, downs, arcs): the tour over those with a single way to them.

    A file is entered (way ``down``) and left (``up``); ``downs`` and ``arcs`` count the entries, and all steps, up to and with that one.

    Rows: mains (main), includes (file, offset, included).  No ways are listed: files that are included once hang in trees under the
    others, found by doubling links; a frontier over those others alone tells which a main file reaches and how often; the files with a
    single way form a tree, whose places are ranked along its tour by doubling links again.  Rows grow with the files of each main
    file, rounds with the logarithm of depth and with how often included files lie below one another.  An include of the main file
    itself is not followed; another file on a ring of includes counts as included twice.
    """
    edges = graph.stored(includes.select("file", F.col("offset").cast("bigint").alias("offset"), "included").filter("file <> included"))
    heads, several = _heads(edges, mains)
    heads = graph.stored(heads)
    below = edges.join(several.select(F.col("head").alias("included")), "included", "left_semi")
    steps = graph.stored(below.join(heads, "file").select(F.col("head").alias("src"), F.col("included").alias("dst")).distinct())
    reached = graph.stored(graph.closure_of(mains.select("main", F.col("main").alias("node")).distinct(), steps).select("main", F.col("node").alias("head")))
    # a main file included elsewhere is a head with ways of its own
    files = graph.stored(reached.join(heads, "head").select("main", "file", "head"))
    ways = edges.join(files.select("main", "file"), "file").filter("included <> main").groupBy("main", F.col("included").alias("file")).agg(F.count("*").alias("n"), F.min(F.struct("file", "offset")).alias("by"))
    ways = graph.stored(ways)
    twice = ways.filter("n > 1").select(F.struct("main", "file").alias("node"))
    single = ways.filter("n = 1").select("main", "file", F.col("by.file").alias("parent"), F.col("by.offset").alias("offset"))
    # what lies below a file that is included twice: by heads, whose trees are whole
    own = files.select("main", "file", "head")
    down = single.join(own.filter("file = head").select("main", "file"), ["main", "file"], "left_semi").join(own.select("main", F.col("file").alias("parent"), F.col("head").alias("_over")), ["main", "parent"])
    lost = graph.reached(twice, down.select(F.struct("main", F.col("_over").alias("file")).alias("src"), F.struct("main", "file").alias("dst")))
    lost = graph.stored(lost.select("node.main", F.col("node.file").alias("head")))
    kept = graph.stored(single.join(own, ["main", "file"]).join(lost, ["main", "head"], "left_anti").select("main", "file", "parent", "offset"))
    # the tour of each tree: down to a file and up again
    order = Window.partitionBy("main", "parent").orderBy("offset", "file")
    sides = kept.withColumn("_sibling", F.lead("file").over(order)).withColumn("_first", F.row_number().over(order) == 1)
    first = sides.filter("_first").select("main", F.col("parent").alias("file"), F.col("file").alias("_child"))
    both = sides.join(first, ["main", "file"], "left")
    arc = lambda file, way: F.struct("main", file.alias("file"), F.lit(way).alias("way"))
    goes = F.when(F.col("_child").isNotNull(), arc(F.col("_child"), "down")).otherwise(arc(F.col("file"), "up"))
    comes = F.when(F.col("_sibling").isNotNull(), arc(F.col("_sibling"), "down")).when(F.col("parent") != F.col("main"), arc(F.col("parent"), "up"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tour = both.select("main", "file", F.lit("down").alias("way"), goes.alias("next"), one.alias("downs"), one.alias("arcs")).unionByName(both.select("main", "file", F.lit("up").alias("way"), comes.alias("next"), none.alias("downs"), one.alias("arcs")))
    ranked = _jumped(tour, ["main", "file", "way"], ["downs", "arcs"])  # from there to the end
    sizes = kept.groupBy("main").agg(F.count("*").alias("_n"))
    before = ranked.join(sizes, "main").join(kept, ["main", "file"])
    down = (F.col("way") == "down").cast("int")
    return files.select("main", "file").distinct(), before.select("main", "file", "way", "parent", "offset", (F.col("_n") - F.col("downs") + down).alias("downs"), (2 * F.col("_n") - F.col("arcs") + 1).alias("arcs"))


def source_order(mains: DataFrame, includes: DataFrame) -> DataFrame:
    """(main, file, position): the files of each main file in the order in which their text appears; null for one included twice, and all below it."""
    files, tour = source_tour(mains, includes)
    placed = tour.filter("way = 'down'").select("main", "file", F.col("downs").cast("int").alias("position"))
    placed = placed.unionByName(mains.select("main", F.col("main").alias("file"), F.lit(0).alias("position")).distinct())
    return files.join(placed, ["main", "file"], "left").select("main", "file", "position")


def segments(mains: DataFrame, includes: DataFrame) -> DataFrame:
    """(main, file, since, segment): where the text of each file goes on in the order of its project: from its start, and behind each of its includes.

    Files without a place have no segments.
    """
    _, tour = source_tour(mains, includes)
    starts = tour.filter("way = 'down'").select("main", "file", F.lit(-1).cast("bigint").alias("since"), F.col("arcs").alias("segment"))
    starts = starts.unionByName(mains.select("main", F.col("main").alias("file"), F.lit(-1).cast("bigint").alias("since"), F.lit(0).cast("bigint").alias("segment")).distinct())
    return starts.unionByName(tour.filter("way = 'up'").select("main", F.col("parent").alias("file"), F.col("offset").alias("since"), F.col("arcs").alias("segment")))


def in_order(points: DataFrame, parts: DataFrame, at: str, name: str) -> DataFrame:
    """Points (file, at) for each main file that reaches theirs, with their position ``name`` in its order; a point at an include stands before it."""
    mains_of = parts.select("main", "file").distinct()
    some = points.join(mains_of, "file").withColumn("_since", F.col(at).cast("bigint"))
    rows = some.withColumns({"_kind": F.lit(0), "_segment": F.lit(None).cast("bigint")}).unionByName(parts.select("main", "file", F.col("since").alias("_since"), F.lit(1).alias("_kind"), F.col("segment").alias("_segment")), allowMissingColumns=True)
    w = Window.partitionBy("main", "file").orderBy("_since", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_last", F.last("_segment", ignorenulls=True).over(w)).filter("_kind = 0")
    return found.withColumn(name, order_position(F.col("_last"), F.col(at))).drop("_since", "_kind", "_segment", "_last")


def component_names(edges: DataFrame, mains: DataFrame) -> DataFrame:
    """(node, label): the main file (node) of a component that has one, else its least member."""
    labels = graph.component_labels(edges)
    named = labels.join(mains.select("node"), "node", "left_semi").groupBy("label").agg(F.min("node").alias("_main"))
    return labels.join(named, "label", "left").select("node", F.coalesce("_main", "label").alias("label"))


def tree_faults(nodes: DataFrame) -> DataFrame:
    """(node, fault) of nodes (node, parent) that do not form one tree: dangling parents, roots beyond the first, nodes that no root reaches."""
    present = nodes.select(F.col("node").alias("parent"))
    dangling = nodes.filter("parent is not null").join(present, "parent", "left_anti").select("node", F.lit("dangling-parent").alias("fault"))
    roots = nodes.filter("parent is null").select("node")
    more = roots.filter(F.col("node") != F.lit(roots.agg(F.min("node")).first()[0])).select("node", F.lit("another-root").alias("fault"))
    reached = graph.reached(roots.unionByName(dangling.select("node")), nodes.filter("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst")))
    lost = nodes.select("node").join(reached, "node", "left_anti").select("node", F.lit("unreachable").alias("fault"))
    return dangling.unionByName(more).unionByName(lost)


def ancestors(parents: DataFrame, bridges: DataFrame) -> DataFrame:
    """(concept, ancestor) over parents and bridges (child, parent), for the small tables of packs; a concept is no ancestor of itself unless on a cycle."""
    up = parents.unionByName(bridges).select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()
    steps = up.select(F.col("src").alias("root"), F.col("dst").alias("node"))
    return graph.closure_of(steps, up).select(F.col("root").alias("concept"), F.col("node").alias("ancestor"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node): nodes of a small graph (src, dst) that reach themselves."""
    pairs = ancestors(edges.select(F.col("src").alias("child"), F.col("dst").alias("parent")), edges.limit(0).select(F.col("src").alias("child"), F.col("dst").alias("parent")))
    return pairs.filter("concept = ancestor").select(F.col("concept").alias("node"))


def facts_across(uses: DataFrame, facts: DataFrame, keys: list[str], at: str, since: str, use: str, fact: str) -> DataFrame:
    """(use, fact): the latest fact of each use's keys (component, symbol) that precedes it in the order of the project; none if it or the use has no place.

    One sort per key serves all uses.
    """
    rows = uses.filter(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.col(use), F.lit(None).cast(facts.schema[fact].dataType).alias(fact))
    rows = rows.unionByName(facts.filter(F.col(since).isNotNull()).select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(uses.schema[use].dataType).alias(use), F.col(fact)))
    w = Window.partitionBy(*keys).orderBy("_at", "_kind", fact).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_last", F.last(F.when(F.col("_kind") == 0, F.col(fact)), True).over(w))
    return found.filter("_kind = 1 and _last is not null").select(use, F.col("_last").alias(fact))


def order_position(segment: Column, offset: Column) -> Column:
    """The position of an offset in a file's segment of the project's order."""
    return F.shiftleft(segment.cast("bigint"), 32) + offset


def comment_only(before: Column, after: Column) -> Column:
    """Whether an edit only adds blank or comment lines at the end."""
    added = F.substring(after, F.length(before) + 1, F.length(after))
    lines = F.split(added, "\n")
    return F.startswith(after, before) & F.forall(lines, lambda x: F.trim(x).rlike("^(%.*)?$")) & F.coalesce(F.trim(F.get(lines, 0)).rlike("^(%.*)?$"), F.lit(True))
