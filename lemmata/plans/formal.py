"""Queries of claims and readings over documents that are set from the parts, with twins that compute the rows from the row values."""

from __future__ import annotations

from lemmata.operators import claims, readings
from lemmata.plans.generated import _A2, _B2, _DIM_VALUES, _FILE, _docs
from lemmata.plans.kernel import query

_ROWS, _COLUMNS = "(1 + p_size % 4)", "(1 + p_partkey % 3)"
_CLAIMED = f"'Let $A$ denote a ' || {_ROWS} || ' by ' || {_COLUMNS} || ' matrix. Let $x$ denote a ' || {_COLUMNS} || '-dimensional vector. Then $y = A x$, $w = y + u$ and $v = 2 w$.' || case when p_partkey % 3 = 0 then ' Let $z$ denote a ' || ({_ROWS} + 1) || '-dimensional vector. Then $y = z$.' else '' end"


@query(f"""
with t as (select p_partkey, {_FILE} as file_id, {_CLAIMED} as c from part),
v(o, k, p, r, a, b, s) as (values (0, 0, 'product', 'product(A,x)', 'A', 'x', '$y = A'), (0, 1, 'equals', 'y', 'product(A,x)', null, '$y = A'), (0, 0, 'sum', 'sum(y,u)', 'y', null, '$w'), (0, 1, 'sum', 'sum(y,u)', 'u', null, '$w'),
  (0, 2, 'equals', 'w', 'sum(y,u)', null, '$w'), (0, 0, 'product', 'product(2,w)', '2', 'w', '$v'), (0, 1, 'equals', 'v', 'product(2,w)', null, '$v'), (1, 0, 'equals', 'y', 'z', null, '$y = z'))
select file_id, (strpos(c, s) - 1)::int as "at", k::int as ordinal, p as predicate, r as result, a as "left", b as "right" from t, v where o = 0 or p_partkey % 3 = 0""")
def part_claims(spark, sf_dir):
    """Relations that the formulas of the parts' documents claim."""
    return claims.relation_claims(_docs(spark, sf_dir, _CLAIMED)).drop("num", "den")


@query(f"""
with t as (select {_FILE} as file_id, {_ROWS} as r, {_COLUMNS} as c, p_partkey % 3 = 0 as more from part),
e as (select *, case when more then r + 1 else r end as n, case when more then 1 else 0 end as less from t)
select file_id, 'A' as symbol, 'shape' as predicate, 'matrix(' || r || ',' || c || ')' as value, 0 as round, false as truncated from e
union all select file_id, 'x', 'shape', 'vector(' || c || ')', 0, false from e
union all select file_id, 'z', 'shape', 'vector(' || n || ')', 0, false from e where more
union all select file_id, s, 'shape', 'vector(' || n || ')', (k - less)::int, false from e, (values ('y', 2), ('w', 4), ('u', 4), ('v', 6)) v(s, k)""")
def part_derived_facts(spark, sf_dir):
    """Shapes of the symbols of the parts' documents, declared or implied over rounds."""
    return claims.derived_facts(_docs(spark, sf_dir, _CLAIMED)).drop("proof_at")


@query(f"""
with t as (select p_partkey, {_FILE} as file_id, {_CLAIMED} as c from part)
select file_id, (strpos(c, '$y = A') - 1)::int as "at", 'constraint-shape-conflict' as code from t where p_partkey % 3 = 0""")
def part_claim_conflicts(spark, sf_dir):
    """Equations of the parts' documents whose sides have implied shapes that differ."""
    return claims.claim_conflicts(_docs(spark, sf_dir, _CLAIMED))


_FIRST, _SECOND = f"'Let $s$ denote ' || {_A2} || '. Let $'", f"'s$ denote ' || {_B2} || '. Let $'"
_FAULTY = f"{_FIRST} || {_SECOND} || 'm$ denote mass in ' || case p_partkey % 2 when 0 then 'kilograms' else 'seconds' end || '.'"


@query(f"""
with d(kind, l, m, t) as (values {_DIM_VALUES}),
f as (select p_partkey, {_FILE} as file_id, {_A2} as a, {_B2} as b, length({_FIRST}) as p, length({_FIRST} || {_SECOND}) as q from part),
r as (select file_id, p as "at", 'quantity-declaration-dimension-conflict' as code from f join d x on x.kind = a join d y on y.kind = b where (x.l, x.m, x.t) <> (y.l, y.m, y.t)
  union all select file_id, q, 'quantity-unit-dimension-mismatch' from f where p_partkey % 2 = 1),
n as (select file_id, row_number() over (partition by file_id order by "at", code)::int as rank, "at"::int as "at", code from r)
select *, case when code like '%unit%' then 'The unit does not measure the quantity.' else 'The symbol was declared with another dimension before.' end as explanation from n""")
def part_diagnostics(spark, sf_dir):
    """All diagnostics of the parts' documents in order of place, explained."""
    return claims.explained(claims.diagnostics(_docs(spark, sf_dir, _FAULTY)))


_LINKED = """'Let $m$ denote mass. Let $a$ denote acceleration. ' || case p_partkey % 3 when 0 then 'Assume a common frame for all. ' when 1 then 'These are different experiments. ' else '' end || 'Then $F = m a$ for ' || p_name || '. Let $v$ denote velocity. ' || case when p_partkey % 2 = 0 then 'Let $P$ denote power. ' else '' end || 'Then $P = F * v$.'"""
_LINKED_SPARK = _LINKED.replace("F * v", "F \\\\cdot v")
_LINKED_DUCK = _LINKED.replace("F * v", "F \\cdot v")
_CHAIN_ROWS = f"""
t as (select p_partkey, {_FILE} as file_id, {_LINKED_DUCK} as c, p_partkey % 3 as k, p_partkey % 2 = 0 as named from part),
u as (select *, strpos(c, '$F = m') - 1 as f, strpos(c, '$P = F') - 1 as p, case k when 0 then 'verified' when 1 then 'conflicting' else 'condition-missing' end as status from t),
l as (select file_id, f::int as "at", 'classical-mechanics:newton-second-law' as law, 'inferable' as support, status, 0 as hop from u
  union all select file_id, p::int, 'classical-mechanics:mechanical-power', case when named and k = 0 then 'derived' else 'inferable' end, status, case when k = 0 then 1 else 0 end from u where named or k = 0)"""


@query(f"with {_CHAIN_ROWS} select * from l")
def part_law_chains(spark, sf_dir):
    """Laws of the parts' documents, also by the roles that laws of earlier formulas give."""
    return readings.chained(_docs(spark, sf_dir, _LINKED_SPARK)).select("file_id", "at", "law", "support", "status", "hop")


@query(f"""with {_CHAIN_ROWS} select file_id, "at", 1 as rank, 'typed-law' as kind, law as label, case when status = 'conflicting' then 'contradicted' when support = 'derived' then 'derived' else 'tentative' end as support, false as truncated from l""")
def part_interpretations(spark, sf_dir):
    """Ranked hypotheses of the formulas of the parts' documents."""
    return readings.interpretations(_docs(spark, sf_dir, _LINKED_SPARK))


@query(f"""
with {_CHAIN_ROWS},
r as (select file_id, f as "at", 'classical-mechanics:newton-second-law/binding/net-force' as requirement from u union all select file_id, f, 'declaration/F' from u union all select file_id, f, 'classical-mechanics:newton-second-law/condition/same-context' from u where k > 0
  union all select file_id, p, 'declaration/F' from u union all select file_id, p, 'declaration/P' from u where not named
  union all select file_id, p, 'classical-mechanics:mechanical-power/binding/force' from u where named union all select file_id, p, 'classical-mechanics:mechanical-power/condition/same-context' from u where named and k > 0)
select file_id, "at"::int as "at", row_number() over (partition by file_id, "at" order by requirement)::int as rank, requirement, false as truncated from r""")
def part_requirements(spark, sf_dir):
    """What the formulas of the parts' documents lack for an established reading."""
    return readings.requirements(_docs(spark, sf_dir, _LINKED_SPARK))


_FLOW = "'We have $a = b$' || case p_partkey % 6 when 0 then ', hence ' when 1 then ', which gives ' when 2 then '. Substituting, ' when 3 then ', that is, ' when 4 then ' and ' else ', hence perhaps ' end || '$c = d$ for ' || p_name || '.'"


@query(f"""
with t as (select p_partkey, {_FILE} as file_id, {_FLOW} as c from part)
select file_id, 8 as earlier, (strpos(c, '$c') - 1)::int as later, ['consequence', 'consequence', 'substitution', 'restatement'][1 + p_partkey % 6] as kind from t where p_partkey % 6 < 4""")
def part_flows(spark, sf_dir):
    """Formulas of the parts' documents that words between them join."""
    return readings.flows(_docs(spark, sf_dir, _FLOW))


_OUTPUT = "'The map $f$ ' || case p_partkey % 5 when 0 then 'produces the ' when 1 then 'returns a ' when 2 then 'likes the ' when 3 then 'does not return the ' else 'outputs ' end || p_name || ': $y = f(x)$.'"


@query(f"""
with t as (select p_partkey, p_name, {_FILE} as file_id, {_OUTPUT} as c from part)
select file_id, 8 as producer, (strpos(c, '$y') - 1)::int as result, p_name as description from t where p_partkey % 5 in (0, 1, 4)""")
def part_outputs(spark, sf_dir):
    """Descriptions of results that the parts' documents say a map produces."""
    return readings.output_descriptions(_docs(spark, sf_dir, _OUTPUT))
