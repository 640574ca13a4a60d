"""Closures by semi-naive rounds; only counts reach the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests on one machine), a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not folder:  # one machine, as in tests
        folder = getattr(spark.sparkContext, "_graph_folder", None) or "file://" + tempfile.mkdtemp(prefix="rounds-")
        spark.sparkContext._graph_folder = folder
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """A round's rows as a table in the shared folder, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for work that takes far more time than a row's bytes tell: a table of one small file else is one task."""
    spark = df.sparkSession
    return df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism))


def large(df: DataFrame) -> DataFrame:
    """The table, to be shuffled where it is joined: one that grows with the input may be small as a file and large in memory, so Spark would broadcast it by the file's size."""
    return df.hint("merge")


#: Tasks for each core that ``dealt`` makes.
TASKS = 4
#: Rows up to which a table is broadcast.
SMALL = 1 << 17


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The table, to be broadcast if it is counted to have at most ``most`` rows."""
    return broadcast_few(df, df.limit(most + 1).count(), most)


def broadcast_few(df: DataFrame, rows: int, most: int = SMALL) -> DataFrame:
    """The table of ``rows`` rows, to be broadcast if these are at most ``most``."""
    return F.broadcast(df) if rows <= most else large(df)


def closure_of(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node): the pairs, and all nodes reachable over edges (src, dst) from their nodes, per root; for small tables of roots.

    Each round's new rows are a stored table of their own; what was reached is the union of these.
    """
    names = pairs.columns
    frontier = stored(pairs.distinct())
    found = [frontier]
    steps = edges.select(F.col("src").alias("node"), "dst")
    while True:
        reached_ = found[0]
        for f in found[1:]:
            reached_ = reached_.unionByName(f)
        step = frontier.join(steps, "node").select(*names[:-1], F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(reached_, names, "left_anti"))
        if not frontier.limit(1).count():
            return reached_
        found.append(frontier)
        if len(found) > 16:  # long chains: a union of a few tables, each row rewritten once per so many rounds
            found = [stored(reached_.unionByName(frontier))]


def reached(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): the seeds (node) and all nodes reachable from any of them over edges (src, dst)."""
    return closure_of(seeds.select("node"), edges)


def affected(changed: DataFrame, includes: DataFrame) -> DataFrame:
    """Nodes that include a changed node, over any number of steps, and the changed ones (reverse closure)."""
    reverse = includes.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reached(changed, reverse)


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of undirected edges (src, dst)."""
    both = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("label")))
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("hook"))
        jump = labels.select(F.col("node").alias("hook"), F.col("label").alias("jump"))
        after = stored(hooked.join(jump, "hook").select("node", F.least("hook", "jump").alias("new"), "label"))
        labels = after.select("node", F.col("new").alias("label"))
        if not after.filter("new <> label").limit(1).count():
            return labels


def retract(claims: DataFrame, parents: DataFrame, removed: DataFrame) -> DataFrame:
    """Claims that survive the removal of some: those not derived, over any number of steps, from a removed one."""
    gone = reached(removed.select(F.col("claim").alias("node")), parents.select(F.col("parent").alias("src"), F.col("child").alias("dst"))).select(F.col("node").alias("claim"))
    return claims.join(gone, "claim", "left_anti")
