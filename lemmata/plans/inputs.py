"""Queries of the sources: snapshots, change logs and packs whose JSON is set from the driver's tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lemmata.operators import graph
from lemmata.plans.kernel import _t, query
from lemmata.sources import packs, snapshots


def _lines(spark, sf_dir):
    good = F.to_json(F.struct(F.lit(1).alias("epoch"), F.lit(7).alias("inventoryVersion"), F.col("p_brand").alias("projectId"), F.when(F.col("p_partkey") % 100 == 7, "f-1").alias("mainFileId"), F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 2) * 2 + F.when(F.col("p_partkey") % 50 == 1, 0).otherwise(F.col("p_partkey") % 2)).alias("fileId"), F.concat(F.lit("p"), "p_partkey", F.lit(".md")).alias("path"), F.col("p_name").alias("content"), F.when(F.col("p_partkey") % 40 != 3, F.col("p_size")).alias("documentVersion")))
    return _t(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 30 == 4, "{broken").otherwise(good).alias("value"))


@query("""
with d as (select p_brand as project, 'f' || (p_partkey // 2 * 2 + case when p_partkey % 50 = 1 then 0 else p_partkey % 2 end) as file_id, p_partkey as k from part where p_partkey % 30 <> 4)
select null as file_id, 'unreadable' as fault from part where p_partkey % 30 = 4 union all select file_id, 'no-version' from d where k % 40 = 3
union all select file_id, 'duplicate-file' from d group by project, file_id having count(*) > 1
union all select 'f-1', 'missing-main-file' from (select distinct project from d where k % 100 = 7)""")
def snapshot_faults(spark, sf_dir):
    """What is wrong with the lines of a snapshot."""
    return snapshots.snapshot_faults(snapshots.snapshot(_lines(spark, sf_dir)))


_KIND = "case o_orderkey % 5 when 0 then 'remove' when 1 then 'path-change' else 'upsert' end"


@query(f"""
with s as (select c_custkey as f, 'c' || c_custkey as path, c_name as content, 5 as v, -1 as i, 'upsert' as kind from customer where c_custkey % 3 > 0),
l as (select o_custkey as f, 'o' || o_orderkey as path, o_orderpriority as content, (o_orderkey % 11)::int as v, o_orderkey as i, {_KIND} as kind from orders where o_orderkey % 7 <> 6),
a as (select * from s union all select * from l), g as (select *, max(case when kind = 'remove' then i end) over (partition by f) as gone from a),
b as (select *, max(case when kind = 'upsert' then v end) over (partition by f order by i rows between unbounded preceding and 1 preceding) as before from g where gone is null or i > gone),
k as (select * from b where case when kind = 'upsert' then before is null or v > before else before is not null end)
select f::varchar as file_id, max_by(path, i) as path, max_by(content, i) filter (kind = 'upsert') as content, max_by(v, i) filter (kind = 'upsert')::bigint as document_version from k group by f""")
def applied_changes(spark, sf_dir):
    """A state of files after a log of upserts, path changes and removals; changes of another epoch are refused."""
    state = _t(spark, sf_dir, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").cast("string").alias("file_id"), F.concat(F.lit("c"), "c_custkey").alias("path"), F.col("c_name").alias("content"), F.lit(5).cast("long").alias("document_version"))
    change = F.struct(F.when(F.col("o_orderkey") % 7 == 6, 2).otherwise(1).alias("epoch"), F.col("o_orderkey").alias("inventoryVersion"), F.lit(0).alias("ordinal"), F.expr(_KIND).alias("kind"), F.col("o_custkey").cast("string").alias("fileId"), F.concat(F.lit("o"), "o_orderkey").alias("path"), F.col("o_orderpriority").alias("content"), (F.col("o_orderkey") % 11).alias("documentVersion"))
    log = snapshots.changes(_t(spark, sf_dir, "orders").select(F.to_json(change).alias("value")))
    return snapshots.apply_changes(state, log, 1)


@query("""
select s_suppkey, s_name, 7 + s_nationkey as nation from supplier where s_suppkey % 4 = 0 union all select s_suppkey, s_name, s_nationkey from supplier where s_suppkey % 4 <> 0""")
def replaced_index(spark, sf_dir):
    """An index with a part replaced; a second update whose rows refer to nothing changes nothing."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"))
    nations = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key")).unionByName(spark.range(25, 40).select(F.col("id").cast("int").alias("key")))
    update = s.filter("s_suppkey % 4 = 0").withColumn("nation", F.col("nation") + 7)
    out = snapshots.replaced(s, update, "s_suppkey", "nation", nations, "key")
    return snapshots.replaced(out, s.withColumn("nation", F.lit(-1)), "s_suppkey", "nation", nations, "key")


@query("""
select o_orderkey, case when o_custkey % 5 = 0 then 'anew' else 'kept' end as how, '[{"kind":"symbol","text":"' || o_orderstatus || '"},{"kind":"script","text":"' || o_custkey || '"}]' as binding_key from orders""")
def refreshed_bindings(spark, sf_dir):
    """Resolutions of affected binding keys taken anew, the others kept."""
    o = _t(spark, sf_dir, "orders")
    part = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("text"))
    keyed = o.select("o_orderkey", snapshots.binding_key(F.array(part("symbol", "o_orderstatus"), part("script", "o_custkey"))).alias("binding_key"), "o_custkey")
    rows = keyed.select("o_orderkey", F.lit("kept").alias("how"), "binding_key")
    affected = keyed.filter("o_custkey % 5 = 0").select("binding_key").distinct()
    return snapshots.refreshed(rows, rows.withColumn("how", F.lit("anew")), affected, "binding_key")


_NEEDED = "case {k} when 0 then 'nowhere' when 1 then 'pack2' when 2 then 'pack1' when 3 then 'pack4' else 'pack0' end"


def _pack_texts(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").withColumn("k", F.col("n_regionkey")).withColumn("n", F.col("n_nationkey"))
    space = F.concat(F.lit("pack"), "k", F.lit(":"))
    refs = F.array(F.lit("r")).alias("references")
    parents = F.when(F.col("n") % 6 == 5, F.array(F.concat(space, F.lit("absent")))).when(F.col("n") % 6 == 4, F.array(F.lit("elsewhere:c"))).otherwise(F.array().cast("array<string>"))
    concept = F.struct(F.concat(F.lit("c"), "n").alias("id"), F.lit("entity").alias("conceptKind"), F.col("n_name").alias("title"), F.col("n_name").alias("description"), parents.alias("parents"), refs)
    slots = F.create_map(F.lit("result"), F.lit("r"), F.lit("left-factor"), F.lit("a"), F.when(F.col("n") % 4 == 3, "other").otherwise("right-factor"), F.lit("b"))
    means = F.when(F.col("n") % 5 == 2, F.lit("nowhere:c")).otherwise(F.concat(space, F.lit("c"), "n"))
    role = lambda r: F.struct(F.lit(r).alias("id"), means.alias("concept"), F.lit(r).alias("description"))
    subjects = F.when(F.col("n") % 3 == 0, F.array(F.lit("a"))).when(F.col("n") % 11 == 10, F.array(F.lit("a"), F.lit("zz"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    condition = F.struct(F.lit("k").alias("id"), F.when(F.col("n") % 7 == 6, "odd").otherwise("differentiable").alias("kind"), subjects.alias("subjects"), F.lit("k").alias("label"))
    law = F.struct(F.concat(F.lit("l"), "n").alias("id"), F.lit("law").alias("title"), F.lit("law").alias("description"), F.struct(F.lit("binary-product").alias("id"), slots.alias("slots")).alias("archetype"), F.array(role("r"), role("a"), role("b")).alias("roles"), F.array(condition).alias("conditions"), refs)
    by = n.groupBy("k").agg(F.array_sort(F.collect_list(concept)).alias("concepts"), F.collect_list(law).alias("laws"))
    wants = F.when(F.col("k") == 4, F.array(F.lit("cap"))).otherwise(F.array().cast("array<string>"))
    head = [F.lit(13).alias("schemaVersion"), F.concat(F.lit("pack"), "k").alias("packId"), F.when(F.col("k") == 4, "2.1.0").otherwise("1.0.0").alias("packVersion"), F.lit("field").alias("packKind"), F.concat(F.lit("pack"), "k").alias("namespace"), F.lit("t").alias("title"), F.lit("d").alias("description")]
    needs = F.array(F.struct(F.expr(_NEEDED.format(k="k")).alias("packId"), F.lit(1).alias("versionMajor"), wants.alias("requiredCapabilities"))).alias("dependencies")
    gives = F.struct(F.array().cast("array<string>").alias("provides"), F.when(F.col("k") == 2, F.array(F.lit("x"))).otherwise(wants).alias("requires")).alias("capabilities")
    text = F.to_json(F.struct(*head, needs, gives, "concepts", "laws", F.array(F.struct(F.lit("r").alias("id"))).alias("references")))
    text = F.when(F.col("k") == 3, F.regexp_replace(text, '"packKind":', '"sort":')).when(F.col("k") == 2, F.replace(text, F.lit('"archetype":'), F.lit('"note":1,"archetype":'))).otherwise(text)
    return packs.packs(by.select(text.alias("text")), "text")


@query(f"""
with p as (select 'pack' || r_regionkey as id, r_regionkey as k, {_NEEDED.format(k='r_regionkey')} as needed from region), n as (select 'pack' || n_regionkey as id, n_nationkey as n from nation)
select id as pack, 'unknown-dependency' as fault, needed as detail from p where k = 0 union all select id, 'cyclic-dependency', null from p where k in (1, 2) union all select id, 'wrong-major', needed from p where k = 3
union all select id, 'missing-capability', 'cap' from p where k = 4 union all select id, 'wrong-requires', 'x' from p where k = 2 union all select id, 'unknown-field', 'sort' from p where k = 3 union all select id, 'wrong-kind', null from p where k = 3
union all select id, 'unknown-field', 'laws.note' from p where k = 2 union all select id, 'unknown-parent', id || ':absent' from n where n % 6 = 5 group by id union all select id, 'unknown-parent', 'elsewhere:c' from n where n % 6 = 4 group by id
union all select id, 'foreign-parent', 'elsewhere:c' from n where n % 6 = 4 group by id union all select id, 'wrong-slots', 'l' || n from n where n % 4 = 3 union all select id, 'unknown-concept', 'l' || n || '/nowhere:c' from n where n % 5 = 2
union all select id, 'wrong-condition', 'l' || n || '/k' from n where n % 7 = 6 union all select id, 'wrong-arity', 'l' || n || '/k' from n where n % 7 <> 6 and n % 3 = 0 union all select id, 'unknown-subject', 'l' || n || '/k' from n where n % 3 <> 0 and n % 11 = 10""")
def pack_faults(spark, sf_dir):
    """What is wrong with a catalogue of packs."""
    return packs.faults(_pack_texts(spark, sf_dir))


@query("""
select 'pack' || n_regionkey as pack, 'l' || n_nationkey as law, case when n_nationkey % 4 = 3 then 'r = a {right-factor}' else 'r = a b' end as relation from nation""")
def pack_laws(spark, sf_dir):
    """Relations of laws that name an archetype."""
    return packs.laws(_pack_texts(spark, sf_dir)).select("pack", "law", "relation")


@query("""
select case when n_nationkey % 4 = 3 then '#1 = #2 {right-factor}' else '#1 = #2 #3' end as relation, count(*)::bigint as n, min('pack' || n_regionkey || ':l' || n_nationkey) as first from nation group by 1""")
def pack_collisions(spark, sf_dir):
    """Relations that several laws state."""
    return packs.collisions(_pack_texts(spark, sf_dir)).select("relation", F.size("laws").cast("long").alias("n"), F.get("laws", 0).alias("first"))


def _held(k: str, word: str) -> str:
    """A supplier's document: one definition, and for two of three an include of the next one's."""
    return f"'Let $x$ denote ' || {word} || '. ' || case when {k} % 3 > 0 then '\\\\input{{d' || ({k} + 1) || '}}' else '' end"


@query("""
with t as (select s_suppkey as k, case when s_suppkey % 7 = 2 then 'energy' when s_suppkey % 11 = 3 then 'force' else s_name end as word from supplier where s_suppkey % 13 <> 5),
d as (select 'd' || k as file_id, k, word from t)
select file_id, 'x' as symbol, word as description from d union select a.file_id, 'x', b.word from d a join d b on b.k = a.k + 1 where a.k % 3 > 0""")
def incremental_facts(spark, sf_dir):
    """Definitions of files and of what they include, kept up to date over batches of changes; the last batch is refused."""
    import uuid

    from lemmata.operators import definitions
    from lemmata.streaming import incremental

    def analyse(documents, files):
        known = definitions.definitions(documents).select("file_id", "symbol", "description")
        lent = incremental.inputs(documents).join(files.withColumnRenamed("file_id", "src"), "src", "left_semi").join(known.withColumnRenamed("file_id", "dst"), "dst")
        return known.join(files, "file_id", "left_semi").unionByName(lent.select(F.col("src").alias("file_id"), "symbol", "description")).distinct()

    s = _t(spark, sf_dir, "supplier")
    file = F.concat(F.lit("d"), "s_suppkey")
    docs = s.select(file.alias("file_id"), F.concat(file, F.lit(".tex")).alias("path"), F.expr(_held("s_suppkey", "s_name")).alias("content"), F.lit(1).cast("long").alias("document_version"))
    run = incremental.Run(spark, f"{graph.shared_folder(spark)}/incremental-{uuid.uuid4().hex}", analyse)
    run.reset(docs, 1, 0)
    change = lambda v, kind, word: F.struct(F.lit(1).alias("epoch"), F.lit(v).alias("inventoryVersion"), F.lit(0).alias("ordinal"), F.lit(kind).alias("kind"), file.alias("fileId"), F.concat(file, F.lit(".tex")).alias("path"), F.expr(_held("s_suppkey", f"'{word}'")).alias("content"), F.lit(v + 1).alias("documentVersion"))
    for where, row in (("s_suppkey % 11 = 3", change(1, "upsert", "force")), ("s_suppkey % 7 = 2", change(2, "upsert", "energy")), ("s_suppkey % 13 = 5", change(3, "remove", "")), ("s_suppkey > 0", change(3, "upsert", "mass"))):
        run.apply(snapshots.changes(s.filter(where).select(F.to_json(row).alias("value"))))
    return run.facts().select("file_id", "symbol", "description")
