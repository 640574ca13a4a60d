"""Plans that hold where tables are small as files and large in memory."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["interval_deepest", "part_binders", "part_bound_uses"])
def test_what_grows_is_not_broadcast_by_the_size_of_its_file(spark, name):
    assert "BroadcastHashJoin" not in plan(entry.queries()[name](spark, SF))


def test_documents_of_one_small_file_are_parsed_by_several_tasks(spark):
    from lemmata.operators import definitions, parsed
    from lemmata.sources import syntax

    docs = spark.createDataFrame([(f"f{k}", f"Let $x$ denote mass. Then $x = {k}$.") for k in range(64)], "file_id string, content string").coalesce(1)
    for df in (syntax.syntax(docs), definitions.definitions(docs)):
        assert df.rdd.getNumPartitions() > 1
    assert len([f for f in parsed.parsed(docs).trees.inputFiles() if "part-" in f]) > 1


def test_a_formula_is_matched_once_however_many_files_have_it(spark):
    from lemmata.operators import laws, parsed

    def bindings(n: int) -> int:
        docs = parsed.parsed(spark.createDataFrame([(f"f{k}", "Then $F = m a$.") for k in range(n)], "file_id string, content string"))
        return laws.matches(docs.trees, laws.catalogue(docs)).count()

    assert bindings(12) == bindings(1) > 0


def test_descriptions_shared_by_many_rows_are_read_once(spark):
    from lemmata.functions import quantities

    rows = [(k, ("the mass in seconds", "the force", "no such thing", None)[k % 4]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, said string")
    assert quantities.said(df, "said").count() == 4
    got = {r["id"]: (r["kind"], r["unit"], r["code"]) for r in quantities.described(df, "id", "said").collect()}
    want = [("mass", "second", "quantity-unit-dimension-mismatch"), ("force", None, None), (None, None, None), (None, None, None)]
    assert got == {k: want[k % 4] for k in range(40)}


def test_facts_at_a_use_do_not_multiply_by_the_facts_of_its_symbol(spark):
    from lemmata.operators import facts

    def rows(n: int):
        f = [(k, k % 2, [[], [k % 3], [k % 3, k % 5]][k % 3 if k % 7 else 0], k * 7 % 50 if k % 11 else None, (k % 4 == 0, k % 4 == 1, None)[k % 3]) for k in range(n)]
        u = [(k, k % 2, [k % 3, k % 5], k if k % 9 else None) for k in range(90)]
        return f, u, facts.facts_at(spark.createDataFrame(u, "use long, one long, use_path array<int>, pos long"), spark.createDataFrame(f, "fact long, one long, path array<int>, since long, explicit boolean"), ["one"], "use", "pos", "use_path", "path", "since", "explicit", "fact")

    for n in (20, 400):
        f, u, out = rows(n)
        want = []
        for use, one, where, pos in u:
            seen = [x for x in f if x[1] == one and where[: len(x[2])] == x[2] and (not x[2] or x[3] is not None and pos is not None and x[3] <= pos)]
            seen.sort(key=lambda x: (-len(x[2]), {True: 0, False: 1, None: 2}[x[4]], x[3] is None, -(x[3] or 0), x[0]))
            want += [(use, i + 1, x[0], len(seen) > 8) for i, x in enumerate(seen[:8])]
        assert sorted((r["use"], r["rank"], r["fact"], r["truncated"]) for r in out.collect()) == want
    assert "_last#" in plan(out)  # facts are looked up by number, not all of a symbol
