"""The shared folder for intermediate tables and the session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests on one machine), a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = _local(spark)
    return folder.rstrip("/")


def _local(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not getattr(sc, "_lemmata_folder", None):
        sc._lemmata_folder = "file://" + tempfile.mkdtemp(prefix="lemmata-")
    return sc._lemmata_folder


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lemmata_path = path
    return out


def removed(*tables: DataFrame | None) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_lemmata_path", None)
        if path:
            sc = table.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to differ from all columns (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
