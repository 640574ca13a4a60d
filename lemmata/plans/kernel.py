"""Kernel queries: each operator over driver tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.functions import dimensions, text
from lemmata.operators import decisions, graph, relational
from lemmata.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
with c as (select doc_id, list_filter(list_transform(string_split_regex(text, '[.!?;\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') as l from documents),
f as (select doc_id, list_filter(l[1:256], lambda x: octet_length(encode(x)) <= 640) as l, len(l) as n from c),
p as (select doc_id, l, len(l) < n as truncated from f)
select doc_id, (i - 1)::int as clause_idx, l[i] as clause, truncated from p, unnest(range(1, len(l) + 1)) t(i)""")
def clause_segments(spark, sf_dir):
    """Clause segmentation with byte and count bounds."""
    return text.clauses(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query(r"""
select doc_id, len(w)::bigint as words, len(list_distinct(w))::bigint as distinct_words from (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as w from documents)""")
def clause_word_stats(spark, sf_dir):
    """Word events of each document."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"))


_SENTENCES = ["Let x denote mass", "If x denotes mass, stop", "x might denote mass", "x does not denote mass", "As reported, x is mass", "According to A, x is mass", "Were x zero, y would vanish", "We do not assume this", "It is likely to hold", "x could be mass"]
_VALUES = ", ".join(f"({i - 100}, '{s}')" for i, s in enumerate(_SENTENCES))


@query(f"""
with s as (select * from (values {_VALUES}) v(id, clause) union all select conv_id * 1000 + turn, text from conversations),
a as (select id, lower(trim(clause, ' ')) as l from s),
b as (select id, l, case when regexp_matches(l, '{text.COUNTERFACTUALS}') then 'counterfactual' when regexp_matches(l, '{text.CONDITIONS}') then 'conditional' else 'unconditional' end as conditionality from a),
c as (select id, l, conditionality, case when conditionality <> 'unconditional' then 'hypothetical' when regexp_matches(l, '{text.HEDGES}') then 'hedged' when regexp_matches(l, '{text.CITATIONS}') then 'cited' else 'asserted' end as modality, case when regexp_matches(l, '{text.NEGATIONS}') then 'negative' else 'positive' end as polarity from b)
select id::bigint as id, conditionality, modality, polarity, modality = 'asserted' and polarity = 'positive' as establishes from c""")
def discourse_frame(spark, sf_dir):
    """Conditionality, modality and polarity of clauses, over conversations and inlined sentences."""
    inline = spark.createDataFrame([(i - 100, s) for i, s in enumerate(_SENTENCES)], "id long, clause string")
    rows = inline.unionByName(_t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("clause")))
    return rows.select("id", text.frame(F.col("clause")).alias("f")).select("id", "f.*")


@query("select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g'), ' ') as normal from pages")
def normalize_domain_text(spark, sf_dir):
    """Domain text normalisation."""
    return _t(spark, sf_dir, "pages").select("page_id", text.normal_text(F.col("url")).alias("normal"))


_TERMS = ["std", "lg", "standard", "economy polished", "promo", "brushed", "part", "small plated", "steel", "tin"]


@query(f"""
with t as (select unnest({_TERMS!r}) as term), p as (select p_partkey, ' ' || trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' ') || ' ' as s from part)
select p_partkey, term from p, t where contains(s, ' ' || term || ' ')""")
def term_contains_join(spark, sf_dir):
    """Domain term containment as an n-gram equi-join."""
    terms = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    return text.contained_terms(_t(spark, sf_dir, "part"), "p_partkey", F.concat_ws(" ", "p_name", "p_type"), terms, "term")


@query(r"""
select doc_id, a as acronym, count(*)::bigint as n from (select doc_id, unnest(list_filter(string_split_regex(text, '[\s,.;:!?()]+'), lambda w: regexp_matches(w, '^[A-Z][A-Z0-9]{1,11}$'))) as a from documents) group by all""")
def acronym_tokens(spark, sf_dir):
    """Acronym-like tokens of each document."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(text.acronyms(F.col("text"))).alias("acronym")).groupBy("doc_id", "acronym").agg(F.count("*").alias("n"))


@query("""
select p_partkey, upper(array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' '), ' '), lambda w: w <> ''), lambda w: w[1]), '')) as initials from part""")
def initialism(spark, sf_dir):
    """Initials of names, as acronym checks use them."""
    return _t(spark, sf_dir, "part").select("p_partkey", text.initials(F.concat_ws(" ", "p_name", "p_type")).alias("initials"))


@query("""
with s as (select doc_id as id, text as s from documents union all select * from (values (-1, 'a𝛼b'), (-2, '🙂'), (-3, '')) v(id, s))
select id::bigint as id, length(s)::bigint as points, (length(s) + len(list_filter(string_split(s, ''), lambda c: c <> '' and unicode(c) > 65535)))::bigint as units from s""")
def utf16_offsets(spark, sf_dir):
    """Code points and UTF-16 units."""
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("s")).unionByName(spark.createDataFrame([(-1, "a𝛼b"), (-2, "🙂"), (-3, "")], "id long, s string"))
    return rows.select("id", F.length("s").cast("long").alias("points"), text.utf16_length(F.col("s")).cast("long").alias("units"))


@query("""
with e as (select event_id, user_id, epoch_us(ts) as t, value from events),
i as (select user_id, t as s, t + round(value * 60000000)::bigint as e, event_id as interval_id from e),
j as (select p.event_id, i.interval_id, row_number() over (partition by p.event_id order by i.e - i.s, i.interval_id desc) as rn from e p join i on p.user_id = i.user_id and p.t >= i.s and p.t < i.e)
select e.event_id, j.interval_id from e left join j on e.event_id = j.event_id and j.rn = 1""")
def interval_deepest(spark, sf_dir):
    """The tightest interval that holds each point, per user."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    i = e.select("user_id", F.col("t").alias("s"), (F.col("t") + F.round(F.col("value") * 60000000).cast("long")).alias("e"), F.col("event_id").alias("interval_id"))
    out = relational.tightest_container(e, i, ["user_id"], "t", "s", "e", "event_id", F.struct(-(F.col("e") - F.col("s")), "interval_id"))
    return out.select("event_id", "interval_id")


@query("""
with c as (select conv_id, turn, role, sum((role = 'system')::int) over (partition by conv_id order by turn) as breaks from conversations)
select a.conv_id, a.turn as turn_a, b.turn as turn_b from c a join c b on a.conv_id = b.conv_id and b.turn - a.turn between 1 and 2 and a.breaks = b.breaks""")
def block_attachment(spark, sf_dir):
    """Blocks at most two apart with no heading between (a running count of headings replaces the anti-join)."""
    from pyspark.sql import Window

    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum((F.col("role") == "system").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn")).alias("breaks"))
    a = c.select("conv_id", F.col("turn").alias("turn_a"), "breaks")
    b = c.select("conv_id", F.col("turn").alias("turn_b"), "breaks")
    near = a.withColumn("turn_b", F.explode(F.array(F.col("turn_a") + 1, F.col("turn_a") + 2)))
    return near.join(b, ["conv_id", "turn_b", "breaks"]).select("conv_id", "turn_a", "turn_b")


@query("""
select event_id, v as view_id from (select event_id, event_type, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as v from events) where event_type = 'click'""")
def asof_latest_binding(spark, sf_dir):
    """The latest view before each click of a user."""
    e = _t(spark, sf_dir, "events")
    return e.withColumn("view_id", relational.latest_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_id"))).filter("event_type = 'click'").select("event_id", "view_id")


@query("""
with b as (select 1 as one, []::int[] as path, 'root' as name union all select 1, [r_regionkey], 'region ' || r_name from region union all select 1, [n_regionkey, n_nationkey], 'nation ' || n_name from nation),
u as (select c_custkey, [n_regionkey, n_nationkey] as path from customer join nation on c_nationkey = n_nationkey)
select c_custkey, name, len(b.path)::int as depth from u, b where u.path[1:len(b.path)] = b.path""")
def scope_prefix_visible(spark, sf_dir):
    """Bindings visible by scope prefix, as a hash equi-join on exploded prefixes."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    one = F.lit(1).alias("one")
    b = spark.range(1).select(one, F.array().cast("array<int>").alias("path"), F.lit("root").alias("name"))
    b = b.unionByName(r.select(one, F.array("r_regionkey").alias("path"), F.concat(F.lit("region "), "r_name").alias("name")))
    b = b.unionByName(n.select(one, F.array("n_regionkey", "n_nationkey").alias("path"), F.concat(F.lit("nation "), "n_name").alias("name")))
    u = _t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", one, F.array("n_regionkey", "n_nationkey").alias("use_path"))
    return relational.visible_bindings(u, b, ["one"], "use_path", "path").select("c_custkey", "name", F.size("path").alias("depth"))


@query("""
with v as (select l_orderkey as use, l_suppkey % 5 as entity, l_returnflag <> 'R' as positive, l_linestatus = 'O' as loc, l_quantity::int % 4 as d, l_linenumber as a from lineitem),
m as (select use, max(case when loc then d * 1000 + a end) as top from v group by use),
k as (select v.* from v join m using (use) where m.top is null or (loc and d * 1000 + a = m.top)),
e as (select use, entity, bool_or(positive) as yes, bool_or(not positive) as no from k group by all)
select use, case when bool_or(yes and no) then 'conflicting' when count(*) filter (yes) = 1 then 'established' when count(*) filter (yes) > 1 then 'ambiguous' else 'unsupported' end as status, case when count(*) filter (yes) = 1 then min(case when yes then entity end) end as entity, false as truncated from e group by use""")
def resolve_status(spark, sf_dir):
    """Resolution of uses from supporting and rejecting bindings."""
    v = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("use"), (F.col("l_suppkey") % 5).alias("entity"), (F.col("l_returnflag") != "R").alias("positive"), (F.col("l_linestatus") == "O").alias("loc"), (F.col("l_quantity").cast("int") % 4).alias("d"), F.col("l_linenumber").alias("a"))
    return decisions.resolve(v, "use", "entity", F.col("loc"), F.col("d"), F.col("a"), F.col("positive"))


@query("""
select o_orderkey, before as previous_status, o_orderstatus as status from (select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders) where before <> o_orderstatus""")
def lag_conflict(spark, sf_dir):
    """A redeclaration that differs from the latest previous one."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("previous_status", F.lag("o_orderstatus").over(w)).filter("previous_status <> o_orderstatus").select("o_orderkey", "previous_status", F.col("o_orderstatus").alias("status"))


@query("""
with v as (select p_type, p_size, p_brand, min(p_partkey) as id from part group by all)
select a.p_type, a.p_size, a.id as first, b.id as second, a.p_brand as first_value, b.p_brand as second_value from v a join v b on a.p_type = b.p_type and a.p_size = b.p_size and a.id < b.id and a.p_brand <> b.p_brand""")
def pair_conflict(spark, sf_dir):
    """Conflicting values under one key, as pairs of distinct values."""
    return relational.conflict_pairs(_t(spark, sf_dir, "part"), ["p_type", "p_size"], "p_partkey", "p_brand").select("p_type", "p_size", "first", "second", "first_value", "second_value")


@query("""
select o_custkey, o_orderkey, rn::int as rank, n > 8 as truncated from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, count(*) over (partition by o_custkey) as n from orders) where rn <= 8""")
def capped_topk(spark, sf_dir):
    """At most eight rows per key, with a truncation flag."""
    return relational.capped(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 8).select("o_custkey", "o_orderkey", "rank", "truncated")


@query("""
select o_custkey, o_orderkey from (select *, count(*) over (partition by o_custkey) as n from orders) where n <= 12""")
def all_or_nothing_cap(spark, sf_dir):
    """Keys over the cap give no rows rather than some."""
    return relational.all_or_nothing(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 12)


@query("""
select l_orderkey, l_linenumber from (select *, row_number() over (partition by l_orderkey order by case l_returnflag when 'R' then 3 when 'A' then 2 else 1 end desc, l_linenumber) as rn from lineitem) where rn = 1""")
def dedup_priority(spark, sf_dir):
    """One definition per key by priority."""
    priority = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 2).otherwise(1)
    return relational.keep_best(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], [priority.desc(), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber")


@query("""
with recursive e as (select l_suppkey as src, l_suppkey + 3 as dst from lineitem group by all),
b as (select src, dst from e union select dst, src from e), r(node, reach) as (select src, src from b union select r.node, b.dst from r join b on r.reach = b.src)
select node, min(reach) as label from r group by node""")
def component_labels(spark, sf_dir):
    """Connected components by least member."""
    e = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + 3).alias("dst")).distinct()
    return graph.component_labels(e)


@query("""
with recursive i as (select s_suppkey as src, s_suppkey // 2 as dst from supplier union select s_suppkey, s_suppkey // 3 from supplier where s_suppkey % 4 = 0),
r(node) as (select s_suppkey from supplier where s_suppkey in (3, 7) union select i.src from r join i on i.dst = r.node) select node from r""")
def closure_affected(spark, sf_dir):
    """Reverse include closure of changed files."""
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"))
    i = s.select("src", F.floor(F.col("src") / 2).alias("dst")).unionByName(s.filter("src % 4 = 0").select("src", F.floor(F.col("src") / 3).alias("dst"))).distinct()
    return graph.affected(s.filter("src in (3, 7)").select(F.col("src").alias("node")), i)


@query("""select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def dangling_refs(spark, sf_dir):
    """References that name nothing."""
    return relational.dangling(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")), "doc_id", "key")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def mention_semi(spark, sf_dir):
    """Only mentioned occurrences resolve."""
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("""
with i as (select event_id, user_id, epoch_us(ts) as s, epoch_us(ts) + round(value * 1000000)::bigint as e from events)
select event_id from (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as reach from i) where s < reach""")
def ordered_non_overlap(spark, sf_dir):
    """Intervals that overlap an earlier one of their key."""
    i = _t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1000000).cast("long")).alias("e"))
    return relational.overlaps(i, ["user_id"], "s", "e").select("event_id")


@query("""select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def upsert_lww(spark, sf_dir):
    """Last write wins per key."""
    return changes.last_write_wins(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("""
select event_id, coalesce(v > before, true) as accepted from (select event_id, round(value * 100)::bigint as v, max(round(value * 100)::bigint) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from events)""")
def version_fence(spark, sf_dir):
    """Changes accepted only if their version exceeds all before."""
    log = _t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("v"))
    return changes.fenced(log, "user_id", "v", ["ts", "event_id"]).select("event_id", "accepted")


@query("""
with s as (select c_custkey as k, 1 as v, c_name as name from customer), c as (select o_custkey as k, (o_orderkey % 3)::int as v, 'order ' || o_orderkey as name, o_orderstatus = 'F' as gone from orders),
a as (select k, v, name, false as gone from s union all select * from c), r as (select *, row_number() over (partition by k order by v desc, gone desc, name desc) as rn from a)
select k, v from r where rn = 1 and not gone""")
def upsert_state(spark, sf_dir):
    """A batch of upserts and removals against a versioned state."""
    s = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("v"))
    c = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 3).cast("int").alias("v"), (F.col("o_orderstatus") == "F").alias("gone"))
    return changes.upsert(s, c, "k", "v", "gone")


@query("""
with recursive p as (select 'L' || l_orderkey || '-' || l_linenumber as child, 'O' || l_orderkey as parent from lineitem union all select 'O' || o_orderkey, 'C' || o_custkey from orders),
g(claim) as (select 'C' || c_custkey from customer where c_custkey % 5 = 0 union select p.child from g join p on p.parent = g.claim),
c as (select child as claim from p union select 'C' || c_custkey from customer)
select claim from c where claim not in (select claim from g)""")
def retraction_closure(spark, sf_dir):
    """Claims that survive the retraction of some roots."""
    l, o, k = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    parents = l.select(F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber").alias("child"), F.concat(F.lit("O"), "l_orderkey").alias("parent")).unionByName(o.select(F.concat(F.lit("O"), "o_orderkey").alias("child"), F.concat(F.lit("C"), "o_custkey").alias("parent")))
    claims = parents.select(F.col("child").alias("claim")).unionByName(k.select(F.concat(F.lit("C"), "c_custkey").alias("claim"))).distinct()
    return graph.retract(claims, parents, k.filter("c_custkey % 5 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("claim")))


@query("""
select o_orderkey, case when s and r then 'conflicting' when s then 'supported' when r then 'rejected' else 'unresolved' end as status from (select l_orderkey as o_orderkey, bool_or(l_returnflag = 'A') as s, bool_or(l_returnflag = 'R') as r from lineitem group by 1)""")
def candidate_truth_table(spark, sf_dir):
    """Candidate status from supporting and rejecting evidence."""
    flags = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("s"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    return flags.select("o_orderkey", decisions.candidate_status(F.col("s"), F.col("r")).alias("status"))


@query("""
with c as (select l_orderkey, case when l_linenumber % 6 = 0 then 'unsupported' when l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 45 then 'conflicting' when l_linestatus = 'F' then 'verified' else 'required' end as s from lineitem)
select l_orderkey, case when bool_or(s = 'conflicting') then 'conflicting' when bool_or(s in ('required', 'unsupported')) then 'condition-missing' else 'verified' end as status from c group by 1""")
def condition_rollup(spark, sf_dir):
    """Condition statuses rolled up to law statuses."""
    c = _t(spark, sf_dir, "lineitem").select("l_orderkey", decisions.condition_status(F.when(F.col("l_linenumber") % 6 == 0, 0).otherwise(1), (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), F.col("l_linestatus") == "F").alias("s"))
    return c.groupBy("l_orderkey").agg(F.collect_set("s").alias("s")).select("l_orderkey", decisions.law_status(F.col("s")).alias("status"))


@query("""
with e as (select source as pack, (doc_id % 3)::int as rank, (n_chars % 10)::int as specificity, doc_id from documents)
select pack, min(rank) as rank, max(specificity) as specificity, list_sort(list(distinct doc_id))[1:8]::varchar as evidence from e group by pack""")
def domain_support_rank(spark, sf_dir):
    """Domain hypotheses: best rank, largest specificity, at most eight pieces of evidence."""
    e = _t(spark, sf_dir, "documents").select(F.col("source").alias("pack"), (F.col("doc_id") % 3).cast("int").alias("rank"), (F.col("n_chars") % 10).cast("int").alias("specificity"), "doc_id")
    out = e.groupBy("pack").agg(F.min("rank").alias("rank"), F.max("specificity").alias("specificity"), F.slice(F.array_sort(F.collect_set("doc_id")), 1, 8).alias("evidence"))
    return out.withColumn("evidence", F.concat(F.lit("["), F.array_join(F.transform("evidence", lambda x: x.cast("string")), ", "), F.lit("]")))


@query("""
select r_name, sha256('["' || array_to_string(list_sort(list(n_name)), '","') || '"]') as digest from region join nation on r_regionkey = n_regionkey group by r_name""")
def semantic_digest(spark, sf_dir):
    """SHA-256 over sorted JSON keys."""
    j = _t(spark, sf_dir, "region").join(_t(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy("r_name").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("n_name"))), 256).alias("digest"))


@query("""
select 'documents' as counter, count(*)::bigint as n from documents union all select 'distinct texts', count(distinct text) from documents union all select 'orders', count(*) from orders union all select 'lines', count(*) from lineitem""")
def stats_counters(spark, sf_dir):
    """Counters in the manner of analysis statistics."""
    d = _t(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.countDistinct("text").alias("distinct texts"))
    o = _t(spark, sf_dir, "orders").agg(F.count("*").alias("orders"))
    l = _t(spark, sf_dir, "lineitem").agg(F.count("*").alias("lines"))
    rows = [f.select(F.lit(c).alias("counter"), F.col(f"`{c}`").cast("long").alias("n")) for f, cs in ((d, ["documents", "distinct texts"]), (o, ["orders"]), (l, ["lines"])) for c in cs]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
