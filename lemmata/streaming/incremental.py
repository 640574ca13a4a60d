"""An analysis kept up to date over batches of changes: versioned tables in a shared folder, and a pointer that names the current ones.

A batch is refused as a whole if it is of another epoch, if its inventory does not go on from the state's, or if a change cannot be
read; nothing changes then.  Otherwise the changes are applied, files are compared by fingerprints, and only files that changed, or that
reach a changed one over includes old or new, are analysed again.  New tables are written beside the old ones before the pointer
moves, so a batch that fails, or a lost executor or driver, leaves the state as it was, and a batch that is delivered twice counts once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lemmata.operators import graph, project
from lemmata.sources import snapshots
from lemmata.streaming import changes as streams

#: Analyses files (file_id) of documents (file_id, path, content) into rows with a file_id; it is given all documents that they reach.
Analysis = Callable[[DataFrame, DataFrame], DataFrame]
_DOCUMENTS = "file_id string, path string, content string, document_version long, fingerprint string"


@dataclass(frozen=True)
class Pointer:
    """What the pointer file holds."""

    version: int
    epoch: int
    inventory: int


@dataclass(frozen=True)
class Outcome:
    """What became of a batch: ``applied``, ``unchanged`` (no file differs), or why it was refused."""

    status: str
    changed: int = 0
    analysed: int = 0


def inputs(documents: DataFrame) -> DataFrame:
    """(src, dst): files and those they include by ``\\input`` or ``\\include``."""
    said = documents.select("file_id", "path", F.explode(F.regexp_extract_all("content", F.lit(r"\\(?:input|include)\{([^{}]+)\}"), 1)).alias("target"))
    found = project.include_targets(said, documents.select("file_id", "path"))
    return found.filter("included is not null").select(F.col("file_id").alias("src"), F.col("included").alias("dst")).distinct()


def fingerprint() -> Column:
    """What of a file an analysis may depend on; comments and blank lines at its end do not count."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?:\n[ \t]*(?:%[^\n]*)?)+$", "")
    return F.sha2(F.to_json(F.struct("path", text.alias("content"))), 256)


class Run:
    """An analysis of a project's documents, its state in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, analyse: Analysis, includes: Callable[[DataFrame], DataFrame] = inputs):
        self.spark, self.folder, self.analyse, self.includes = spark, folder.rstrip("/"), analyse, includes

    @cached_property
    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def pointer(self) -> Pointer | None:
        """The current state, if there is one: the pointer of the largest version that was completed."""
        path, fs = self._files
        found = fs.globStatus(path(f"{self.folder}/pointer-*.json"))
        names = sorted(s.getPath().toString() for s in found) if found else []
        return Pointer(**json.loads(self.spark.read.text(names[-1]).first()[0])) if names else None

    def _point(self, to: Pointer) -> None:
        """Writes a pointer beside its place and renames it, which is one step."""
        path, fs = self._files
        draft = path(f"{self.folder}/draft-{to.version:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(asdict(to)).encode()))
        out.close()
        if not fs.rename(draft, path(f"{self.folder}/pointer-{to.version:012d}.json")):
            raise RuntimeError(f"another run has written version {to.version}")

    def documents(self) -> DataFrame:
        return self.spark.read.schema(_DOCUMENTS).parquet(f"{self.folder}/documents-{self.pointer().version:012d}")

    def facts(self) -> DataFrame:
        """The rows of the analysis of the current documents."""
        return self.spark.read.parquet(f"{self.folder}/facts-{self.pointer().version:012d}")

    def _write(self, to: Pointer, documents: DataFrame, facts: DataFrame) -> None:
        documents.write.mode("overwrite").parquet(f"{self.folder}/documents-{to.version:012d}")
        facts.write.mode("overwrite").parquet(f"{self.folder}/facts-{to.version:012d}")
        self._point(to)

    def reset(self, documents: DataFrame, epoch: int, inventory: int) -> None:
        """Begins anew from documents (file_id, path, content, document_version)."""
        before = self.pointer()
        docs = documents.select("file_id", "path", "content", F.col("document_version").cast("long").alias("document_version")).withColumn("fingerprint", fingerprint())
        self._write(Pointer(before.version + 1 if before else 0, epoch, inventory), docs, self.analyse(docs.drop("fingerprint"), docs.select("file_id")))

    def _fault(self, log: DataFrame, now: Pointer) -> str | None:
        seen = log.agg(
            F.count_if(F.col("epoch").isNull() | (F.col("epoch") != now.epoch)).alias("epoch"),
            F.count_if(F.col("inventory_version").isNull() | (F.col("inventory_version") <= now.inventory)).alias("inventory"),
            F.count_if(
                F.coalesce(~F.col("kind").isin("upsert", "path-change", "remove"), F.lit(True)) | F.col("file_id").isNull()
                | ((F.col("kind") == "upsert") & (F.col("content").isNull() | F.col("path").isNull() | F.coalesce(F.col("document_version") < 0, F.lit(True))))
                | ((F.col("kind") == "path-change") & F.col("path").isNull())
            ).alias("unreadable"),
        ).first()
        return next((f"refused-{name}" for name in ("unreadable", "epoch", "inventory") if seen[name]), None)

    def apply(self, log: DataFrame) -> Outcome:
        """One batch of changes (as ``snapshots.changes`` reads them)."""
        now = self.pointer()
        log = graph.stored(log.select("epoch", "inventory_version", "ordinal", "kind", "file_id", "path", "content", "document_version"))
        if (last := log.agg(F.max("inventory_version")).first()[0]) is None and not log.limit(1).count():
            return Outcome("unchanged")
        if fault := self._fault(log, now):
            return Outcome(fault)
        old = self.documents()
        new = graph.stored(snapshots.apply_changes(old.select("file_id", "path", "content", "document_version"), log, now.epoch).withColumn("fingerprint", fingerprint()))
        both = old.select("file_id", F.col("fingerprint").alias("_before")).join(new.select("file_id", "fingerprint"), "file_id", "full")
        changed = graph.stored(both.filter(~F.col("_before").eqNullSafe(F.col("fingerprint"))).select(F.col("file_id").alias("node")))
        to = Pointer(now.version + 1, now.epoch, last)
        n = changed.count()
        if not n:  # versions and comments only
            self._write(to, new, self.facts())
            return Outcome("unchanged")
        after = graph.stored(self.includes(new))
        affected = graph.stored(graph.affected(changed, self.includes(old).unionByName(after).distinct()).withColumnRenamed("node", "file_id"))
        files = graph.stored(affected.join(new.select("file_id"), "file_id", "left_semi"))
        needed = graph.reached(files.select(F.col("file_id").alias("node")), after).withColumnRenamed("node", "file_id")
        again = self.analyse(new.drop("fingerprint").join(needed, "file_id", "left_semi"), files)
        kept = self.facts().join(affected, "file_id", "left_anti")
        self._write(to, new, kept.unionByName(again.select(*kept.columns)))
        return Outcome("applied", n, files.count())

    def follow(self, log: DataFrame, checkpoint: str) -> StreamingQuery:
        """Applies each micro-batch of a stream of changes; refused batches change nothing, one that comes again does not either."""
        return streams.run_changes(log, lambda batch, _: self.apply(batch), checkpoint)
