"""Queries of the operators over evidence, facts, projects and cursors, over driver tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lemmata.operators import cursors, decisions, evidence, facts, project
from lemmata.plans.kernel import _t, query


@query("""
with v as (select l_linenumber::bigint * 100 + l_suppkey % 7 as use, l_partkey % (20 + 5 * l_linenumber) as entity, l_returnflag <> 'R' as positive from lineitem),
e as (select use, entity, bool_or(positive) as yes, bool_or(not positive) as no, row_number() over (partition by use order by entity) as rn from v group by use, entity)
select use, case when count(*) > 32 then 'engine-limited' when bool_or(yes and no) then 'conflicting' when count(*) filter (yes) = 1 then 'established' when count(*) filter (yes) > 1 then 'ambiguous' else 'unsupported' end as decision,
  case when count(*) filter (yes) = 1 and count(*) <= 32 then min(case when yes then entity end) end as entity from e group by use""")
def entity_decision(spark, sf_dir):
    """Entity decisions of uses, engine-limited over 32 entities."""
    v = _t(spark, sf_dir, "lineitem").select((F.col("l_linenumber").cast("long") * 100 + F.col("l_suppkey") % 7).alias("use"), (F.col("l_partkey") % (20 + 5 * F.col("l_linenumber"))).alias("entity"), (F.col("l_returnflag") != "R").alias("positive"))
    out = decisions.resolve(v, "use", "entity", F.lit(False), F.lit(0), F.lit(0), F.col("positive"))
    return out.select("use", evidence.entity_decision(F.col("status"), F.col("truncated")).alias("decision"), "entity")


@query("""
with p as (select l_orderkey as slot, l_suppkey % 4 as value, l_linestatus = 'O' as complete, case l_returnflag when 'R' then 0 when 'A' then 1 else 2 end as authority, [l_partkey % 5, 10 + l_linenumber % 3] as roots, l_quantity > 49 as conflicting, l_quantity < 2 as refuted from lineitem),
f as (select slot, bool_or(conflicting) as c, bool_or(refuted) as r from p group by slot),
b as (select *, min(authority + case when complete then 0 else 10 end) over (partition by slot, value) as best from p),
d as (select slot, value, any_value(complete) as complete, any_value(authority) as authority, list_sort(list_distinct(flatten(list(roots)))) as roots from b where authority + case when complete then 0 else 10 end = best group by slot, value),
n as (select slot, count(*) as n, min(authority) as strongest from d group by slot),
x as (select a.slot, a.value, a.authority = b.authority as same, len(list_filter(a.roots, lambda z: not list_contains(b.roots, z))) > 0 as a_more, len(list_filter(b.roots, lambda z: not list_contains(a.roots, z))) > 0 as b_more from d a join d b on a.slot = b.slot and a.value <> b.value),
y as (select slot, bool_and(same and a_more and b_more) as apart from x group by slot),
h as (select d.slot, d.value from d join x on d.slot = x.slot and d.value = x.value where complete group by all having bool_and(a_more and not b_more)),
s as (select d.slot, min(value) as value from d join n using (slot) where complete and authority = strongest group by d.slot having count(*) = 1),
q as (select slot, value, row_number() over (partition by slot order by authority, not complete, value) as rn, complete from d),
w as (select f.slot, c, r, n, apart, coalesce(s.value, h.value) as winner, q.value as head, q.complete as head_complete from f join n using (slot) join q on q.slot = f.slot and rn = 1 left join y using (slot) left join s using (slot) left join (select slot, min(value) as value from h group by slot having count(*) = 1) h using (slot)),
z as (select *, case when c then 'conflicting' when r then 'unsupported' when n = 1 then case when head_complete then 'established' else 'partial' end when apart then 'ambiguous' when winner is not null then 'established' else 'partial' end as status from w)
select slot, status, case when status = 'established' then case when n = 1 then head else winner end when status = 'partial' then head end as value from z""")
def decide_evidence(spark, sf_dir):
    """Which of the rival values of a slot its proofs establish."""
    authority = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    p = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slot"), (F.col("l_suppkey") % 4).alias("value"), (F.col("l_linestatus") == "O").alias("complete"), authority.alias("authority"), F.array(F.col("l_partkey") % 5, 10 + F.col("l_linenumber").cast("long") % 3).alias("roots"), (F.col("l_quantity") > 49).alias("conflicting"), (F.col("l_quantity") < 2).alias("refuted"))
    return evidence.decide(p, "slot", "value", "complete", "authority", "roots", "conflicting", "refuted")


@query("""
with e as (select o_custkey as digest, o_orderkey as pos, o_orderstatus <> 'F' as positive from orders)
select digest, max(pos) filter (positive) as said, max(pos) filter (not positive) as withdrawn from e group by digest having count(*) filter (positive) = 1 and max(pos) filter (positive) < max(pos) filter (not positive)""")
def relation_retraction(spark, sf_dir):
    """Relations said once and withdrawn later."""
    log = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("digest"), "o_orderkey", "o_orderstatus")
    return evidence.retracted(log, "digest", F.col("o_orderkey"), F.col("o_orderstatus") != "F")


@query("""
with c as (select l_orderkey as point, case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end as tier, l_linenumber as value, [l_partkey % 3, l_suppkey % 3, l_linenumber % 3] as e from lineitem),
t as (select *, min(tier) over (partition by point) as first from c), k as (select point, tier, value, list_distinct(flatten(list(e))) as e from t where tier = first group by point, tier, value),
g as (select a.point, a.value from k a join k b on a.point = b.point where len(list_filter(b.e, lambda z: not list_contains(a.e, z))) > 0 and len(list_filter(a.e, lambda z: not list_contains(b.e, z))) = 0),
l as (select k.* from k anti join g on k.point = g.point and k.value = g.value)
select point, tier, case when count(*) = 1 then 'established' else 'ambiguous' end as status, array_to_string(list_sort(list(value)), ',') as "values" from l group by point, tier""")
def meaning_decision(spark, sf_dir):
    """Meanings of the first tier that has candidates, without structurally dominated ones."""
    tier = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    c = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point"), tier.alias("tier"), F.col("l_linenumber").alias("value"), F.array(F.col("l_partkey") % 3, F.col("l_suppkey") % 3, F.col("l_linenumber").cast("long") % 3).alias("e"))
    out = evidence.first_tier(c, "point", "tier", "value", "e")
    return out.select("point", "tier", "status", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("values"))


@query("""
with h as (select l_suppkey as subject, l_orderkey, l_linenumber, case l_linenumber % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 else 5 end as tier, l_quantity::int as start, l_partkey as key from lineitem),
r as (select *, row_number() over (partition by subject order by tier, start, key, l_orderkey, l_linenumber) as rank, count(*) over (partition by subject) as n from h)
select subject, rank::int as rank, l_orderkey, l_linenumber, n > 16 as truncated from r where rank <= 16""")
def ranked_hypotheses(spark, sf_dir):
    """At most 16 hypotheses of a subject, strongest tier first."""
    tiers = F.array(*(F.lit(t) for t in evidence.TIERS))
    h = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), "l_orderkey", "l_linenumber", F.get(tiers, F.col("l_linenumber") % 5).alias("support"), F.col("l_quantity").cast("int").alias("start"), F.col("l_partkey").alias("key"))
    return evidence.hypotheses(h, ["subject"], "support", ["start", "key", "l_orderkey", "l_linenumber"]).select("subject", "rank", "l_orderkey", "l_linenumber", "truncated")


@query("""
with e as (select event_id, user_id, epoch_us(ts) as t, event_type from events), a as (select user_id, t, min(event_id) as anchor from e where event_type = 'view' group by all),
p as (select * from e where event_type = 'error'),
j as (select p.event_id, a.anchor, abs(p.t - a.t) as gap, row_number() over (partition by p.event_id order by abs(p.t - a.t), a.t) as rn from p join a using (user_id))
select p.event_id, j.anchor, j.gap::bigint as gap from p left join j on j.event_id = p.event_id and rn = 1""")
def nearest_anchor(spark, sf_dir):
    """The view closest in time to each error of a user, before or after it."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type")
    views = e.filter("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("anchor"))
    return evidence.nearest(e.filter("event_type = 'error'").select("event_id", "user_id", "t"), views, ["user_id"], "t", "event_id", "anchor")


@query("""
with f as (select o_custkey % 40 as file, o_orderkey * 10 as start, o_orderkey * 10 + o_custkey % 15 as stop, o_orderkey as formula, [o_custkey % 11, 20 + o_orderkey % 7] as es from orders),
p as (select b.file, b.formula, a.formula as earlier, a.stop, list_sort(list_filter(list_distinct(b.es), lambda z: list_contains(a.es, z))) as shared from f a join f b on a.file = b.file and a.stop <= b.start and a.formula <> b.formula and len(list_filter(b.es, lambda z: list_contains(a.es, z))) > 0),
r as (select *, row_number() over (partition by file, formula order by stop desc, earlier desc) as rn from p)
select file, formula, earlier, array_to_string(shared, ',') as shared from r where rn <= 4""")
def equation_links(spark, sf_dir):
    """The latest four earlier formulas that share an entity with each formula."""
    f = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("file"), (F.col("o_orderkey") * 10).alias("start"), (F.col("o_orderkey") * 10 + F.col("o_custkey") % 15).alias("stop"), F.col("o_orderkey").alias("formula"), F.array(F.col("o_custkey") % 11, 20 + F.col("o_orderkey") % 7).alias("es"))
    out = evidence.equation_links(f, "file", "formula", "start", "stop", "es", 4)
    return out.select("file", "formula", "earlier", F.array_join(F.transform("shared", lambda v: v.cast("string")), ",").alias("shared"))


@query("""
with c as (select conv_id, turn, octet_length(encode(text)) as n, len(regexp_extract_all(text, '[A-Z]')) as m from conversations),
o as (select *, sum(n + 100) over (partition by conv_id order by turn) as stop from c),
b as (select *, stop - n as start, lag(stop) over w as pe, lag(m) over w as pm, lag(turn) over w as pt from o window w as (partition by conv_id order by turn))
select conv_id, turn, case when start - pe <= 160 and pm between 1 and 8 then pt end as antecedent from b""")
def clause_antecedents(spark, sf_dir):
    """The clause before, where a pronoun of this one may refer to it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").alias("n"), F.size(F.regexp_extract_all("text", F.lit("[A-Z]"), 0)).alias("m"))
    c = c.withColumn("stop", F.sum(F.col("n") + 100).over(w)).withColumn("start", F.col("stop") - F.col("n"))
    return evidence.antecedents(c, ["conv_id"], "turn", "start", "stop", "m").select("conv_id", "turn", "antecedent")


@query("""
with f as (select s_suppkey as fact, s_suppkey % 6 as symbol, case s_suppkey % 3 when 0 then []::int[] when 1 then [n_regionkey] else [n_regionkey, n_nationkey] end as path, s_suppkey * 7 % 1500 as since, s_suppkey % 2 = 0 as explicit from supplier join nation on s_nationkey = n_nationkey),
u as (select c_custkey as use, c_custkey % 6 as symbol, [n_regionkey, n_nationkey] as path, c_custkey as pos from customer join nation on c_nationkey = n_nationkey),
v as (select use, fact, row_number() over (partition by use order by len(f.path) desc, explicit desc, since desc, fact) as rank, count(*) over (partition by use) > 8 as truncated from u join f using (symbol) where u.path[1:len(f.path)] = f.path and (len(f.path) = 0 or since <= pos))
select use, rank::int as rank, fact, truncated from v where rank <= 8""")
def local_facts(spark, sf_dir):
    """The facts of a symbol that hold at a use: deepest, explicit and latest first, at most eight."""
    n = _t(spark, sf_dir, "nation")
    kind = F.col("s_suppkey") % 3
    path = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 1, F.array("n_regionkey")).otherwise(F.array("n_regionkey", "n_nationkey"))
    f = _t(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("fact"), (F.col("s_suppkey") % 6).alias("symbol"), path.alias("path"), (F.col("s_suppkey") * 7 % 1500).alias("since"), (F.col("s_suppkey") % 2 == 0).alias("explicit"))
    u = _t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("use"), (F.col("c_custkey") % 6).alias("symbol"), F.array("n_regionkey", "n_nationkey").alias("use_path"), F.col("c_custkey").alias("pos"))
    return facts.facts_at(u, f, ["symbol"], "use", "pos", "use_path", "path", "since", "explicit", "fact")


@query("""
select l_orderkey, l_linenumber, p, c_name as source from (select *, ['role','type','shape','dimension','relates','names','unit'][1 + l_linenumber % 7] as p from lineitem) join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
where o_orderstatus <> 'F' and o_orderpriority <> '5-LOW' and c_mktsegment <> 'BUILDING' and p in ('role','type','shape','dimension','unit')""")
def claim_evidence(spark, sf_dir):
    """Claims with establishing evidence whose facts may go to equal entities."""
    names = F.array(*(F.lit(x) for x in ("role", "type", "shape", "dimension", "relates", "names", "unit")))
    claims = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey"), F.get(names, F.col("l_linenumber") % 7).alias("p"))
    proofs = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "negative").otherwise("positive").alias("polarity"), F.when(F.col("o_orderpriority") == "5-LOW", "hedged").otherwise("asserted").alias("modality"))
    sources = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("source"), F.when(F.col("c_mktsegment") == "BUILDING", "derived").otherwise("explicit").alias("origin"))
    rows = facts.claim_rows(claims, proofs, sources, "o_orderkey", "c_custkey")
    return rows.filter(evidence.establishes(F.col("polarity"), F.col("modality"), F.col("origin")) & evidence.transferable(F.col("p"))).select("l_orderkey", "l_linenumber", "p", "source")


@query("""
with recursive e as (select s_suppkey as a, s_suppkey + 10 as b from supplier where s_suppkey + 10 in (select s_suppkey from supplier)), u as (select a, b from e union all select b, a from e),
r(n, m) as (select s_suppkey, s_suppkey from supplier union select r.n, u.b from r join u on r.m = u.a),
f as (select s_suppkey as entity, case when s_suppkey % 3 = 0 then 'shape' when s_suppkey % 3 = 1 then 'dimension' else 'names' end as predicate, 'v' || s_nationkey % 4 as value from supplier),
t as (select r.n as entity, predicate, value, m as proof from r join f on f.entity = r.m where predicate <> 'names' union all select entity, predicate, value, entity from f)
select entity, predicate, value, min(proof) as proof from t group by all""")
def transferred_facts(spark, sf_dir):
    """Facts of entities, and those of equal ones, with the least entity that has each."""
    s = _t(spark, sf_dir, "supplier")
    after = s.select((F.col("s_suppkey")).alias("dst"))
    equal = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 10).alias("dst")).join(after, "dst", "left_semi").select("src", "dst")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "shape").when(F.col("s_suppkey") % 3 == 1, "dimension").otherwise("names")
    f = s.select(F.col("s_suppkey").alias("entity"), kind.alias("predicate"), F.concat(F.lit("v"), F.col("s_nationkey") % 4).alias("value"))
    return facts.transferred(f, equal)


@query("""
with p as (select p_partkey, p_partkey % 12 as j, p_partkey // 12 % 3 as kind from part)
select p_partkey as entity, case when kind = 0 then 'length:1/1' || case when j > 0 then ' time:' || -j || '/1' else '' end when kind = 1 then 'length:1/1' || case when j > 0 then ' time:' || j || '/1' else '' end else 'length:1/1' end as dimension, j::int as round, true as truncated from p where j <= 8
union all select -1, 'time:1/1', 0, true""")
def propagated_dimensions(spark, sf_dir):
    """Dimensions that relations imply along chains of quotients, products and equations, over at most eight rounds."""
    from lemmata.functions import dimensions

    kind = "array<struct<base:string,num:bigint,den:bigint>>"
    one = lambda b: F.array(F.struct(F.lit(b).alias("base"), F.lit(1).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den"))).cast(kind)
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 12).alias("j"), (F.floor(F.col("p_partkey") / 12) % 3).alias("k"))
    given = p.filter("j = 0").select(F.col("p_partkey").alias("entity"), one("length").alias("dimension")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("entity"), one("time").alias("dimension")))
    name = F.when(F.col("k") == 0, "quotient").when(F.col("k") == 1, "product").otherwise("equal")
    relations = p.filter("j > 0").select(F.col("p_partkey").alias("relation"), name.alias("kind"), F.col("p_partkey").alias("result"), (F.col("p_partkey") - 1).alias("left"), F.when(F.col("k") < 2, F.lit(-1).cast("long")).alias("right"))
    out = facts.propagated(given, relations)
    return out.select("entity", dimensions.dimension_text(F.col("dimension")).alias("dimension"), "round", "truncated")


@query("""
with s as (select p_partkey, ['product','quotient','dot','cross','transpose','negate'][1 + p_partkey % 6] as op, (p_partkey // 6 % 3)::int as a, (p_partkey // 18 % 3)::int as b, 1 + p_size % 3 as r, 1 + p_size % 4 as c from part),
k as (select *, ['scalar','vector','matrix'][a + 1] as ka, ['scalar','vector','matrix'][b + 1] as kb, case when a > 0 then r::varchar end as ar, case when a = 2 then c::varchar end as ac, case when b > 0 then c::varchar end as br, case when b = 2 then r::varchar end as bc from s),
t as (select p_partkey, op, case when op = 'product' and ka = 'scalar' then [kb, br, bc] when op = 'product' and kb = 'scalar' then [ka, ar, ac] when op = 'product' and ka = 'matrix' and kb = 'vector' then ['vector', ar, null] when op = 'product' and ka = 'matrix' and kb = 'matrix' then ['matrix', ar, bc]
  when op = 'quotient' and kb = 'scalar' then [ka, ar, ac] when op = 'dot' and ka = 'vector' and kb = 'vector' then ['scalar', null, null] when op = 'cross' and ka = 'vector' and kb = 'vector' then ['vector', ar, null]
  when op = 'transpose' and ka = 'matrix' then ['matrix', ac, ar] when op = 'negate' then [ka, ar, ac] end as x from k)
select p_partkey, op, x[1] as kind, x[2] as "rows", x[3] as "columns" from t""")
def operation_shapes(spark, sf_dir):
    """Shapes of products, quotients and operations on known shapes."""
    ops = F.array(*(F.lit(x) for x in ("product", "quotient", "dot", "cross", "transpose", "negate")))
    kinds = F.array(*(F.lit(x) for x in ("scalar", "vector", "matrix")))
    s = _t(spark, sf_dir, "part").select("p_partkey", F.get(ops, (F.col("p_partkey") % 6).cast("int")).alias("op"), (F.floor(F.col("p_partkey") / 6) % 3).cast("int").alias("a"), (F.floor(F.col("p_partkey") / 18) % 3).cast("int").alias("b"), (1 + F.col("p_size") % 3).cast("string").alias("r"), (1 + F.col("p_size") % 4).cast("string").alias("c"))
    shape = lambda k, r, c: F.struct(F.get(kinds, F.col(k)).alias("kind"), F.when(F.col(k) > 0, F.col(r)).alias("rows"), F.when(F.col(k) == 2, F.col(c)).alias("columns"))
    return s.withColumn("left", shape("a", "r", "c")).withColumn("right", shape("b", "c", "r")).select("p_partkey", "op", facts.shape_of(F.col("op"), F.col("left"), F.col("right")).alias("s")).select("p_partkey", "op", "s.*")


@query("""
with a as (select o_orderkey as relation, o_custkey as function, o_orderkey * 10 as result, o_orderkey * 10 + 1 as argument from orders), g as (select c_custkey as function, c_mktsegment as codomain, 'n' || c_nationkey as domain from customer),
d as (select l_orderkey * 8 + l_linenumber as relation, l_orderkey * 10 as operand, l_orderkey * 80 + l_linenumber as result from lineitem)
select 'codomain' as rule, relation, result as entity, codomain as shape from a join g using (function) union all select 'domain', relation, argument, domain from a join g using (function)
union all select 'trajectory-derivative-shape', d.relation, d.result, codomain from d join a on a.result = d.operand join g using (function)""")
def application_shapes(spark, sf_dir):
    """Shapes of results and arguments of applied functions, and of derivatives of their trajectories."""
    a = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relation"), F.col("o_custkey").alias("function"), (F.col("o_orderkey") * 10).alias("result"), (F.col("o_orderkey") * 10 + 1).alias("argument"))
    g = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("function"), F.col("c_mktsegment").alias("codomain"), F.concat(F.lit("n"), "c_nationkey").alias("domain"))
    d = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("relation"), (F.col("l_orderkey") * 10).alias("operand"), (F.col("l_orderkey") * 80 + F.col("l_linenumber")).alias("result"))
    own = facts.application_facts(a, g).withColumn("rule", F.when(F.col("entity") % 10 == 0, "codomain").otherwise("domain"))
    via = facts.trajectory_derivatives(d, a.select("result", "function"), g.select("function", F.col("codomain").alias("shape"))).withColumn("rule", F.lit("trajectory-derivative-shape"))
    return own.unionByName(via).select("rule", "relation", "entity", "shape")


_ROLES = ["function", "operator", "event", "set", "matrix", "symmetric-matrix", "index", "distribution"]


@query(f"""
with r as (select p_name as symbol, p_brand as scope, p_partkey, {_ROLES!r}[1 + p_size % 8] as role from part), v as (select symbol, scope, role, min(p_partkey) as id from r group by all),
c(a, b) as (values ('function', 'operator'), ('function', 'linear-operator'), ('function', 'random-variable'), ('function', 'distribution'), ('event', 'set'), ('matrix', 'symmetric-matrix')),
d as (select a, b from c union all select b, a from c)
select x.symbol, x.scope, x.id as first, y.id as second, x.role as first_value, y.role as second_value from v x join v y on x.symbol = y.symbol and x.scope = y.scope and x.id < y.id anti join d on d.a = x.role and d.b = y.role""")
def role_conflicts(spark, sf_dir):
    """Roles of one symbol in one scope that cannot stand beside each other."""
    roles = F.array(*(F.lit(x) for x in _ROLES))
    r = _t(spark, sf_dir, "part").select(F.col("p_name").alias("symbol"), F.col("p_brand").alias("scope"), "p_partkey", F.get(roles, F.col("p_size") % 8).alias("role"))
    lineage = spark.createDataFrame([("matrix", "symmetric-matrix")], "ancestor string, descendant string")
    return facts.role_conflicts(r, ["symbol", "scope"], "p_partkey", "role", lineage).select("symbol", "scope", "first", "second", "first_value", "second_value")


@query(f"""
with r as (select p_partkey, {_ROLES!r}[1 + p_size % 8] as role, p_partkey % 5 = 0 as quantity, ['scalar','vector','matrix'][1 + p_partkey % 3] as shape from part)
select p_partkey, case when quantity then shape not in ('scalar', 'vector') when role in ('event', 'set') then true when role in ('operator', 'linear-operator') then shape <> 'matrix' when role = 'index' then shape <> 'scalar' else false end as conflict from r""")
def role_shape_conflicts(spark, sf_dir):
    """Roles and shapes that exclude each other."""
    roles, shapes = (F.array(*(F.lit(x) for x in xs)) for xs in (_ROLES, ("scalar", "vector", "matrix")))
    r = _t(spark, sf_dir, "part")
    return r.select("p_partkey", facts.role_shape_conflict(F.get(roles, F.col("p_size") % 8), F.col("p_partkey") % 5 == 0, F.get(shapes, (F.col("p_partkey") % 3).cast("int"))).alias("conflict"))


@query("""
with f as (select p_partkey as id, 'd' || p_partkey % 7 || '/f' || p_partkey || case when p_partkey % 3 = 0 then '.tex' else '' end as path from part),
i as (select p_partkey as id, 'd' || p_partkey % 7 || '/f' || p_partkey as path, case when p_partkey % 4 = 3 then './gone/x' else '../d' || (p_partkey * 5) % 7 || '/./f' || p_partkey * 5 end as target, p_partkey * 5 as t from part)
select i.id as including, target, case when i.id % 4 = 3 then null else f.id end as included from i left join f on f.id = i.t""")
def include_targets(spark, sf_dir):
    """The files that include targets name, as they are or with .tex behind."""
    p = _t(spark, sf_dir, "part").select("p_partkey")
    path = F.concat(F.lit("d"), F.col("p_partkey") % 7, F.lit("/f"), "p_partkey")
    files = p.select(F.col("p_partkey").alias("file_id"), F.concat(path, F.when(F.col("p_partkey") % 3 == 0, ".tex").otherwise("")).alias("path"))
    target = F.when(F.col("p_partkey") % 4 == 3, "./gone/x").otherwise(F.concat(F.lit("../d"), F.col("p_partkey") * 5 % 7, F.lit("/./f"), F.col("p_partkey") * 5))
    return project.include_targets(p.select(F.col("p_partkey").alias("including"), path.alias("path"), target.alias("target")), files).select("including", "target", "included")


@query("""
with recursive f as (select s_suppkey as id from supplier), e as (select id // 3 as file, id % 3 * 100 as at, id as included from f where id > 4 union all select id // 3, 250, id + 1 from f where id > 4 and id % 7 = 0 and id + 1 in (select id from f)),
m as (select id from f where id <= 4 and id >= 1), r(main, file, key) as (select id, id, []::bigint[] from m union all select r.main, e.included, list_append(r.key, e.at) from r join e on e.file = r.file),
o as (select main, file, min(key) as key, count(*) as n from r group by all)
select main, file, case when n = 1 then row_number() over (partition by main order by (n > 1)::int, key, file) - 1 end::int as position from o""")
def source_order(spark, sf_dir):
    """The place of each file in its project's text; none if it is included twice."""
    f = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    e = f.filter("id > 4").select(F.floor(F.col("id") / 3).alias("file"), (F.col("id") % 3 * 100).alias("offset"), F.col("id").alias("included"))
    twice = f.filter("id > 4 and id % 7 = 0").select(F.floor(F.col("id") / 3).alias("file"), F.lit(250).cast("long").alias("offset"), (F.col("id") + 1).alias("included")).join(f.select(F.col("id").alias("included")), "included", "left_semi").select("file", "offset", "included")
    return project.source_order(f.filter("id between 1 and 4").select(F.col("id").alias("main")), e.unionByName(twice))


@query("""
with recursive e as (select s_suppkey as a, s_suppkey + 7 as b from supplier), u as (select a, b from e union all select b, a from e), r(n, m) as (select a, a from u union select r.n, u.b from r join u on u.a = r.m),
l as (select n, min(m) as label, min(case when m % 10 = 9 then m end) as main from r group by n) select n as node, coalesce(main, label) as label from l""")
def component_names(spark, sf_dir):
    """Components of a project, named by their main file or least member."""
    s = _t(spark, sf_dir, "supplier")
    e = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 7).alias("dst"))
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return project.component_names(e, nodes.filter("node % 10 = 9"))


_TREE = "select p_partkey as node, case when p_partkey = 0 or p_partkey % 97 = 96 then null when p_partkey % 53 = 52 then -5 when p_partkey % 41 = 40 then p_partkey + 1 when p_partkey % 41 = 0 then p_partkey - 1 else p_partkey // 2 end as parent from part"


@query(f"""
with recursive n as ({_TREE}), d as (select node from n where parent is not null and parent not in (select node from n)), q as (select node from n where parent is null),
r(node) as (select node from q union select node from d union select n.node from r join n on n.parent = r.node)
select node, 'dangling-parent' as fault from d union all select node, 'another-root' from q where node <> (select min(node) from q) union all select node, 'unreachable' from n where node not in (select node from r)""")
def tree_faults(spark, sf_dir):
    """What keeps nodes from forming one tree: dangling parents, further roots, cycles."""
    n = F.col("p_partkey")
    parent = F.when((n == 0) | (n % 97 == 96), None).when(n % 53 == 52, F.lit(-5)).when(n % 41 == 40, n + 1).when(n % 41 == 0, n - 1).otherwise(F.floor(n / 2))
    return project.tree_faults(_t(spark, sf_dir, "part").select(n.alias("node"), parent.cast("long").alias("parent")))


@query("""
with recursive p as (select n_nationkey + 100 as c, n_regionkey as p from nation union all select n_regionkey, 50 from nation union all select n_nationkey + 200, n_nationkey + 100 from nation union select 300, 301 union select 301, 302 union select 302, 300 union select n_nationkey + 200, 300 from nation where n_nationkey % 8 = 0),
r(c, a) as (select c, p from p union select r.c, p.p from r join p on p.c = r.a)
select c as concept, a as ancestor, c in (select c from r where c = a) as cyclic from r""")
def concept_ancestors(spark, sf_dir):
    """Ancestors of concepts over parents and bridges, and which concepts lie on a cycle."""
    n = _t(spark, sf_dir, "nation")
    pairs = lambda a, b: n.select(a.cast("int").alias("child"), b.cast("int").alias("parent"))
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    parents = pairs(key + 100, region).unionByName(pairs(region, F.lit(50))).unionByName(pairs(key + 200, key + 100)).distinct()
    cycle = spark.createDataFrame([(300, 301), (301, 302), (302, 300)], "child int, parent int")
    bridges = cycle.unionByName(n.filter("n_nationkey % 8 = 0").select((key + 200).cast("int").alias("child"), F.lit(300).alias("parent")))
    every = parents.unionByName(bridges)
    turning = project.on_cycles(every.select(F.col("child").alias("src"), F.col("parent").alias("dst"))).select(F.col("node").alias("concept"), F.lit(True).alias("cyclic"))
    return project.ancestors(parents, bridges).join(turning, "concept", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


@query("""
with f as (select s_suppkey as fact, s_nationkey as component, s_suppkey % 2 as symbol, case when s_suppkey % 9 = 8 then null else (s_suppkey % 5) * 4294967296 + s_suppkey end as since from supplier),
u as (select c_custkey as use, c_nationkey as component, c_custkey % 2 as symbol, case when c_custkey % 11 = 10 then null else (c_custkey % 5) * 4294967296 + c_custkey end as pos from customer),
j as (select use, fact, row_number() over (partition by use order by since desc, fact desc) as rn from u join f using (component, symbol) where since <= pos)
select use, fact from j where rn = 1""")
def facts_across_files(spark, sf_dir):
    """The latest fact of a symbol before each use in the order of the project's files."""
    def place(k, n):
        return F.when(F.col(k) % n == n - 1, None).otherwise(project.order_position(F.col(k) % 5, F.col(k)))

    f = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fact"), F.col("s_nationkey").alias("component"), (F.col("s_suppkey") % 2).alias("symbol"), place("s_suppkey", 9).alias("since"))
    u = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("use"), F.col("c_nationkey").alias("component"), (F.col("c_custkey") % 2).alias("symbol"), place("c_custkey", 11).alias("at"))
    return project.facts_across(u, f, ["component", "symbol"], "at", "since", "use", "fact")


@query("""
with e as (select p_partkey, p_name as a, case p_partkey % 6 when 0 then p_name || chr(10) || '% note' when 1 then p_name || '  ' when 2 then p_name || ' %' || p_brand when 3 then p_name || chr(10) || 'text' when 4 then 'x' || p_name else p_name end as b, p_partkey % 6 as k from part)
select p_partkey, k not in (3, 4) as comment_only from e""")
def comment_only_edits(spark, sf_dir):
    """Edits that add only comments and blanks, so nothing is analysed again."""
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    after = F.when(k == 0, F.concat(name, F.lit("\n% note"))).when(k == 1, F.concat(name, F.lit("  "))).when(k == 2, F.concat(name, F.lit(" %"), "p_brand")).when(k == 3, F.concat(name, F.lit("\ntext"))).when(k == 4, F.concat(F.lit("x"), name)).otherwise(name)
    return _t(spark, sf_dir, "part").select("p_partkey", project.comment_only(name, after).alias("comment_only"))


@query("""
with e as (select event_id, user_id, epoch_us(ts) // 1000000 as t, event_type, round(value * 1000)::bigint as v from events),
r as (select event_id as rid, user_id, t as s, t + v as e, case event_type when 'view' then 'occurrence' when 'error' then 'selection' else 'application' end as kind from e where v > 0 and event_type <> 'click'),
c as (select event_id as cid, user_id, t as pos from e where event_type = 'click'),
j as (select cid, rid, kind, s, e, (pos = e) as edge, case when kind = 'occurrence' and pos < e then 0 when kind = 'occurrence' then 1 when kind = 'selection' and pos < e then 2 when kind = 'selection' then 3 when pos = e then 4 end as priority from c join r on r.user_id = c.user_id and pos >= s and pos <= e),
k as (select *, rank() over (partition by cid order by priority, case when edge then s - e else e - s end) as rk from j where priority is not null),
g as (select cid, priority, min(rid) as rid, count(distinct (s, e)) as n from k where rk = 1 group by all)
select cid as cursor, rid as range_id, priority::int as priority from g where priority < 2 or n = 1""")
def cursor_owners(spark, sf_dir):
    """The range that owns each cursor."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("t"), "event_type", F.round(F.col("value") * 1000).cast("long").alias("v"))
    kind = F.when(F.col("event_type") == "view", "occurrence").when(F.col("event_type") == "error", "selection").otherwise("application")
    r = e.filter("v > 0 and event_type <> 'click'").select(F.col("event_id").alias("range_id"), "user_id", F.col("t").alias("s"), (F.col("t") + F.col("v")).alias("e"), kind.alias("kind"))
    c = e.filter("event_type = 'click'").select(F.col("event_id").alias("cursor"), "user_id", F.col("t").alias("at"))
    return cursors.owners(c, r, ["user_id"], "cursor", "at", "range_id", "kind", "s", "e")
