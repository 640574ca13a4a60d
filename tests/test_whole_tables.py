"""Operators whose registered queries take a part of their rows, as their SQL does, over all rows against brute force."""

from pyspark.sql import functions as F


def test_tightest_container_of_all_rows(spark):
    from lemmata.operators import relational

    rows = [(k, k % 3, k * 7 % 50, (k * 13 % 40)) for k in range(120)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, t long, w long")
    i = e.select("user_id", F.col("t").alias("s"), (F.col("t") + F.col("w")).alias("e"), F.col("event_id").alias("interval_id"))
    got = relational.tightest_container(e, i, ["user_id"], "t", "s", "e", "event_id", F.struct(-(F.col("e") - F.col("s")), "interval_id"))
    want = {k: max(((-w, j) for j, v, s, w in rows if v == u and s <= t < s + w), default=(0, None))[1] for k, u, t, _ in rows}
    assert {r["event_id"]: r["interval_id"] for r in got.collect()} == want


def test_components_of_long_chains(spark):
    from lemmata.operators import graph

    edges = spark.range(1, 300).select(F.col("id").alias("src"), (F.col("id") + 3).alias("dst"))
    assert {r["node"]: r["label"] for r in graph.component_labels(edges).collect()} == {n: (n - 1) % 3 + 1 for n in range(1, 303)}


def test_visible_bindings_of_all_scopes(spark):
    from lemmata.operators import relational

    paths = [[]] + [[a] for a in range(5)] + [[a, b] for a in range(5) for b in range(6)]
    uses = [(k, 1, [k % 5, k % 6]) for k in range(60)]
    b = spark.createDataFrame([(1, p, str(p)) for p in paths], "one int, path array<int>, name string")
    got = relational.visible_bindings(spark.createDataFrame(uses, "use long, one int, use_path array<int>"), b, ["one"], "use_path", "path")
    want = sorted((k, str(p)) for k, _, u in uses for p in paths if u[: len(p)] == p)
    assert sorted((r["use"], r["name"]) for r in got.collect()) == want
