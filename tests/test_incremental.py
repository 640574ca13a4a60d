"""The incremental run against a clean one after each of several generated batches, and batches that change nothing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lemmata.operators import definitions
from lemmata.sources import snapshots
from lemmata.streaming.incremental import Run, inputs

DOCS = "file_id string, path string, content string, document_version long"


def analyse(documents, files):
    """Symbols that a file, or one it includes, defines."""
    known = definitions.definitions(documents).select("file_id", "symbol", "description")
    own = known.join(files, "file_id", "left_semi")
    lent = inputs(documents).join(files.withColumnRenamed("file_id", "src"), "src", "left_semi").join(known.withColumnRenamed("file_id", "dst"), "dst")
    return own.unionByName(lent.select(F.col("src").alias("file_id"), "symbol", "description")).distinct()


def rows(df):
    return sorted(tuple(r) for r in df.select("file_id", "symbol", "description").collect())


def _text(rng, k, n):
    return f"Let ${rng.choice('abc')}$ denote {rng.choice(['mass', 'time', 'force'])}. " + "".join(f"\\input{{f{rng.randrange(n)}.tex}} " for _ in range(rng.choice([0, 1, 1, 2])))


def _log(spark, changes):
    lines = [(json.dumps({"epoch": 1, "inventoryVersion": v, "ordinal": i, "kind": kind, "fileId": f, **more}),) for i, (v, kind, f, more) in enumerate(changes)]
    return snapshots.changes(spark.createDataFrame(lines, "value string"))


def test_equals_a_clean_run_after_each_batch(spark, tmp_path):
    rng, n = random.Random(5), 8
    run = Run(spark, f"file://{tmp_path}/state", analyse)
    run.reset(spark.createDataFrame([(f"f{k}", f"f{k}.tex", _text(rng, k, n), 0) for k in range(5)], DOCS), 1, 0)
    for batch in range(1, 4):
        changes = []
        for _ in range(3):
            k = rng.randrange(n)
            kind = rng.choice(["upsert", "upsert", "remove", "path-change"])
            more = {"upsert": {"path": f"f{k}.tex", "content": _text(rng, k, n), "documentVersion": batch}, "remove": {}, "path-change": {"path": f"f{rng.randrange(n)}{k}.tex"}}[kind]
            changes.append((batch, kind, f"f{k}", more))
        outcome = run.apply(_log(spark, changes))
        assert outcome.status in ("applied", "unchanged")
        docs = run.documents().drop("fingerprint")
        assert rows(run.facts()) == rows(analyse(docs, docs.select("file_id")))


def test_refused_batches_change_nothing_and_few_files_are_analysed(spark, tmp_path):
    run = Run(spark, f"file://{tmp_path}/state", analyse)
    run.reset(spark.createDataFrame([("a", "a.tex", "Let $x$ denote mass. \\input{b}", 1), ("b", "b.tex", "Let $y$ denote time.", 1), ("c", "c.tex", "Let $z$ denote force.", 1)], DOCS), 1, 5)
    before, at = rows(run.facts()), run.pointer()
    up = lambda v, f, text, n: (v, "upsert", f, {"path": f"{f}.tex", "content": text, "documentVersion": n})
    for bad, why in (([up(5, "c", "x", 9)], "refused-inventory"), ([up(6, "c", "x", 9), (6, "upsert", "a", {})], "refused-unreadable"), ([up(6, "c", "x", 9), (6, "odd", "a", {})], "refused-unreadable")):
        assert run.apply(_log(spark, bad)).status == why
    other = _log(spark, [up(6, "c", "x", 9)]).withColumn("epoch", F.lit(2).cast("long"))
    assert run.apply(other).status == "refused-epoch"
    assert run.apply(_log(spark, [up(6, "c", "x", 9)]).limit(0)).status == "unchanged"
    assert rows(run.facts()) == before and run.pointer() == at
    note = run.apply(_log(spark, [up(6, "c", "Let $z$ denote force.\n% a note\n", 2)]))
    assert note.status == "unchanged" and run.pointer().inventory == 6 and rows(run.facts()) == before
    done = run.apply(_log(spark, [up(7, "b", "Let $y$ denote energy.", 2)]))
    assert (done.status, done.changed, done.analysed) == ("applied", 1, 2)  # b, and a that includes it
    assert rows(run.facts()) == [("a", "x", "mass"), ("a", "y", "energy"), ("b", "y", "energy"), ("c", "z", "force")]
    assert run.apply(_log(spark, [up(7, "b", "Let $y$ denote energy.", 2)])).status == "refused-inventory"  # delivered twice


def test_a_failing_analysis_leaves_the_state(spark, tmp_path):
    run = Run(spark, f"file://{tmp_path}/state", analyse)
    run.reset(spark.createDataFrame([("a", "a.tex", "Let $x$ denote mass.", 1)], DOCS), 1, 0)

    def broken(documents, files):
        raise RuntimeError("no")

    change = _log(spark, [(1, "upsert", "a", {"path": "a.tex", "content": "Let $x$ denote time.", "documentVersion": 2})])
    with pytest.raises(RuntimeError):
        Run(spark, run.folder, broken).apply(change)
    assert run.pointer().version == 0 and rows(run.facts()) == [("a", "x", "mass")]
    assert run.apply(change).status == "applied" and rows(run.facts()) == [("a", "x", "time")]


def test_follows_a_stream(spark, tmp_path):
    run = Run(spark, f"file://{tmp_path}/state", analyse)
    run.reset(spark.createDataFrame([("a", "a.tex", "Let $x$ denote mass.", 1)], DOCS), 1, 0)
    (tmp_path / "log").mkdir()
    for v, word in ((1, "time"), (2, "force")):
        line = {"epoch": 1, "inventoryVersion": v, "ordinal": 0, "kind": "upsert", "fileId": "a", "path": "a.tex", "content": f"Let $x$ denote {word}.", "documentVersion": v + 1}
        (tmp_path / "log" / f"{v}.json").write_text(json.dumps(line))
        log = snapshots.changes(spark.readStream.schema("value string").text(f"{tmp_path}/log"))
        run.follow(log, f"{tmp_path}/checkpoint").awaitTermination(120)
        assert rows(run.facts()) == [("a", "x", word)]
    assert run.pointer().version == 2
