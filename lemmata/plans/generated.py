"""Domain queries over documents that are set from the rows of the driver's tables; their twins compute the rows without the documents' meaning.

A document is one SQL text expression, read the same way by both sides; the twins use it for positions only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lemmata.functions import formulas, prose, quantities, text
from lemmata.operators import constraints, definitions, laws, navigation, parsed, views
from lemmata.plans.kernel import _t, query

_S = "substr('abcfgkmnpqrstuvwz', 1 + cast(p_partkey % 17 as int), 1)"
_FILE = "'p' || p_partkey || '.md'"


def _docs(spark, sf_dir, content, where="true"):
    return _t(spark, sf_dir, "part").filter(where).selectExpr(f"{_FILE} as file_id", f"{content} as content")


def _kinds(names: list[str], key: str) -> str:
    return "case " + key + " " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


# one definition and one use, in six orders and moods
_DEFINED = f"""case p_partkey % 6 when 0 then 'Let $' || {_S} || '$ denote ' || p_name || '. Inspect $' || {_S} || '$.' when 1 then 'Inspect $' || {_S} || '$. Let $' || {_S} || '$ denote ' || p_name || '.'
  when 2 then 'Let $' || {_S} || '$ perhaps denote ' || p_name || '. See $' || {_S} || '$.' when 3 then 'The ' || p_name || ' is denoted by $' || {_S} || '$. See $' || {_S} || '$.'
  when 4 then 'Here $' || {_S} || '$ designates ' || p_name || ', of course. See $' || {_S} || '$.' else '# ' || p_brand || chr(10) || 'Take $' || {_S} || '$ to be ' || p_name || '.' || chr(10) || '# Next' || chr(10) || 'See $' || {_S} || '$.' end"""
_PLACES = f"with t as (select p_partkey, {_FILE} as file_id, {_S} as symbol, {_DEFINED} as c, p_name from part), u as (select *, strpos(c, '$') as first, length(c) - case when p_partkey % 6 = 1 then 3 + length(' denote ' || p_name) - 0 else 3 end as last from t)"
_USES = """, v as (select *, case p_partkey % 6 when 1 then last when 2 then null else first end as anchor from u),
w as (select file_id, first as use, symbol, case when p_partkey % 6 in (1, 2) then 'unsupported' else 'established' end as status, case when p_partkey % 6 not in (1, 2) then anchor end as definition from v
  union all select file_id, last, symbol, case when p_partkey % 6 in (2, 5) then 'unsupported' else 'established' end, case when p_partkey % 6 not in (2, 5) then anchor end from v)"""


@query(f"{_PLACES}{_USES} select file_id, use::int as use, symbol, status, definition::int as definition from w")
def part_resolutions(spark, sf_dir):
    """Where the symbol of each use of a part's document is defined."""
    return definitions.resolved_uses(_docs(spark, sf_dir, _DEFINED)).select("file_id", "use", "symbol", "status", "definition")


@query(f"""{_PLACES}{_USES} select file_id, symbol, anchor::int as anchor, p_name as description,
  case p_partkey % 6 when 3 then 'passive' when 4 then 'here/designates' when 5 then 'take/to be' else 'let/denote' end as construction, case when p_partkey % 6 = 5 then 1 else 0 end as depth from v where p_partkey % 6 <> 2""")
def part_definitions(spark, sf_dir):
    """Definitions of the parts' documents, by their constructions."""
    return definitions.definitions(_docs(spark, sf_dir, _DEFINED)).select("file_id", "symbol", "anchor", "description", "construction", F.size("scope").alias("depth"))


@query(f"""{_PLACES}{_USES} select file_id, 'used-before-explicit-definition' as code, symbol, first::int as "at" from v where p_partkey % 6 = 1 union all select file_id, 'defined-but-unused', symbol, anchor::int from v where p_partkey % 6 = 5""")
def part_hygiene(spark, sf_dir):
    """Symbols used before their definition, or never where it is seen."""
    return definitions.hygiene(_docs(spark, sf_dir, _DEFINED))


@query(f"""{_PLACES}{_USES} select file_id, definition::int as definition, symbol, use::int as use, use = definition as is_declaration, null as refusal from w where status = 'established'""")
def part_references(spark, sf_dir):
    """All uses of each definition of the parts' documents."""
    return navigation.references(_docs(spark, sf_dir, _DEFINED)).select("file_id", "definition", "symbol", "use", "is_declaration", "refusal")


_RENAMED = f"'Let $' || {_S} || '$ denote ' || p_name || '. Use $' || {_S} || '$ and $' || case p_partkey % 3 when 0 then 'y' else 'x' end || '$.'"


@query(f"""
with t as (select p_partkey, {_S} as s, {_RENAMED} as c, case p_partkey % 5 when 0 then 'y' when 1 then 'two' when 2 then {_S} when 3 then 'x' else 'j' end as new_name from part),
r as (select *, case when new_name = s then 'invalid-replacement' when length(new_name) > 1 then 'invalid-replacement' when strpos(c, '$' || new_name || '$') > 0 then 'capture' end as refusal from t)
select p_partkey as request, refusal, case when refusal is null then '5 ' || (length(c) - 11) end as edits from r""")
def part_renames(spark, sf_dir):
    """Renames of the parts' symbols; a name that the document uses already, defined or not, is refused."""
    p = _t(spark, sf_dir, "part")
    requests = p.selectExpr("p_partkey as request", f"{_FILE} as file_id", "5 as at", f"case p_partkey % 5 when 0 then 'y' when 1 then 'two' when 2 then {_S} when 3 then 'x' else 'j' end as new_name")
    out = navigation.renames(_docs(spark, sf_dir, _RENAMED), requests)
    return out.select("request", "refusal", F.array_join(F.transform("edits", lambda e: e.cast("string")), " ").alias("edits"))


_KINDS = list(quantities.KIND_DIMENSION)
_DIMS = ["length", "duration", "mass", "velocity", "acceleration", "force", "pressure", "energy", "power", "area", "momentum", "density"]
_A, _B, _C = (_kinds(_DIMS, k) for k in ("p_partkey % 12", "p_partkey // 12 % 12", "p_partkey // 144 % 12"))
_A2, _B2, _C2 = (x.replace("p_partkey // 12 % 12", "cast(floor(p_partkey / 12) as bigint) % 12").replace("p_partkey // 144 % 12", "cast(floor(p_partkey / 144) as bigint) % 12") for x in (_A, _B, _C))
_FORMULA = f"'Let $x$ denote ' || {_A2} || '. Let $y$ denote ' || {_B2} || '. Let $z$ denote ' || {_C2} || '. Then $x = y ' || case p_size % 2 when 0 then '' else '/ ' end || 'z$.'"
_DIM_VALUES = ", ".join(f"('{k}', {quantities.KIND_DIMENSION[k].get('length', 0)}, {quantities.KIND_DIMENSION[k].get('mass', 0)}, {quantities.KIND_DIMENSION[k].get('time', 0)})" for k in _DIMS)


@query(f"""
with d(kind, l, m, t) as (values {_DIM_VALUES}),
f as (select p_partkey, {_FILE} as file_id, {_A2} as a, {_B2} as b, {_C2} as c, case p_size % 2 when 0 then 1 else -1 end as sign from part),
j as (select f.*, x.l = y.l + sign * z.l and x.m = y.m + sign * z.m and x.t = y.t + sign * z.t as fits from f join d x on x.kind = a join d y on y.kind = b join d z on z.kind = c),
n as (select file_id, case when a = 'force' and (b = 'mass' and c = 'acceleration' or b = 'acceleration' and c = 'mass') then 'classical-mechanics:newton-second-law' when a = 'momentum' and b = 'mass' and c = 'velocity' then 'classical-mechanics:linear-momentum-definition' end as law, b, c from j where sign = 1)
select file_id, 'canonical' as what, case sign when 1 then 'equals(x,product(y,z))' else 'equals(x,quotient(y,z))' end as value, null as support from j
union all select file_id, 'diagnostic', 'quantity-assignment-dimension-mismatch', null from j where not fits
union all select file_id, 'law', law, 'typed' from n where law is not null and b = 'mass'""")
def part_formulas(spark, sf_dir):
    """Keys, dimension mismatches and laws of formulas over declared quantities; of laws those in their stated form (``a = F/m`` is an equivalent one)."""
    out = laws.formula_facts(_docs(spark, sf_dir, _FORMULA)).filter("what <> 'canonical' or instr(value, '(') > 0")
    return out.filter("what <> 'law' or support = 'typed' and step = 'stated'").select("file_id", "what", "value", "support")


_CHAIN = "'Let $x$ denote length. Let $t$ denote duration. Then $v = x/t$' || case when p_partkey % 3 > 0 then ', $a = v/t$' else '' end || case when p_partkey % 3 > 1 then ' and $b = a + c$' else '' end || '.'"


@query(f"""
with t as (select p_partkey, {_FILE} as file_id from part)
select file_id, s as symbol, d as dimension, r::int as round, false as truncated from t join (values ('x', 'length:1/1', 0, 0), ('t', 'time:1/1', 0, 0), ('v', 'length:1/1 time:-1/1', 1, 0), ('a', 'length:1/1 time:-2/1', 2, 1), ('b', 'length:1/1 time:-2/1', 3, 2), ('c', 'length:1/1 time:-2/1', 3, 2)) v(s, d, r, k) on t.p_partkey % 3 >= k""")
def part_dimensions(spark, sf_dir):
    """Dimensions that the formulas of the parts' documents imply, over rounds."""
    return constraints.derived_dimensions(_docs(spark, sf_dir, _CHAIN))


_SHAPED = "'Let $A$ denote a ' || (1 + p_size % 4) || ' by ' || (1 + p_partkey % 3) || ' matrix. Let $x$ denote a ' || (1 + p_partkey % 4) || '-dimensional vector. Then $y = A x$.'"


@query(f"""select {_FILE} as file_id, 'constraint-product-shape-conflict' as code, (length({_SHAPED}) - 10)::int as "at" from part where 1 + p_partkey % 3 <> 1 + p_partkey % 4""")
def part_shapes(spark, sf_dir):
    """Products of declared shapes that cannot fit."""
    return constraints.shape_diagnostics(_docs(spark, sf_dir, _SHAPED))


_COMPARED = "'Take $k ' || case p_partkey % 5 when 0 then '<' when 1 then '>' when 2 then '=' when 3 then '\\\\ne' else '\\\\le' end || ' n$. Later $n ' || case cast(floor(p_partkey / 5) as bigint) % 5 when 0 then '<' when 1 then '>' when 2 then '=' when 3 then '\\\\ne' else '\\\\le' end || ' k$.'"
_COMPARED_DUCK = _COMPARED.replace("\\\\\\\\", "\\\\").replace("\\\\", "\\")


@query(f"""
with t as (select {_FILE} as file_id, p_partkey % 5 as a, p_partkey // 5 % 5 as b, {_COMPARED_DUCK} as c from part),
x(a, b) as (values (0, 0), (0, 2), (0, 4), (1, 1), (1, 2), (2, 0), (2, 1), (2, 3), (3, 2), (4, 0))
select file_id, 'constraint-comparison-conflict' as code, 'k' as "left", 'n' as "right", 5 as first, (length(c) - length(regexp_extract(c, 'n [^ ]+ k[$][.]$')))::int - 1 as second from t join x using (a, b)""")
def part_comparisons(spark, sf_dir):
    """Comparisons of the parts' documents that exclude each other."""
    return constraints.comparison_conflicts(_docs(spark, sf_dir, _COMPARED))


_LISTED = "'Let $m$, $t$ and $q$ denote ' || p_name || ', time and ' || p_name || case when p_partkey % 2 = 0 then ' respectively' else '' end || case when p_partkey % 5 = 0 then ' and more' else '' end || '. Let $g$ and $h$ be ' || p_name || ' that vary.'"


@query(f"""
with t as (select p_partkey, {_FILE} as file_id, p_name as n from part), ok as (select * from t where p_partkey % 5 <> 0)
select file_id, s as symbol, d as description, 'shared/list' as construction from (select file_id, 'm' as s, n as d from ok union all select file_id, 't', 'time' from ok union all select file_id, 'q', n from ok union all select file_id, 'g', n from t union all select file_id, 'h', n from t)""")
def part_lists(spark, sf_dir):
    """Several symbols defined at once."""
    return definitions.definitions(_docs(spark, sf_dir, _LISTED)).select("file_id", "symbol", "description", "construction")


@query(f"""
with t as (select p_partkey, {_DEFINED} as c from part), u as (select p_partkey, strpos(c, '$') as f from t)
select p_partkey as cursor, rank, kind, f + a as start, f + b as "end" from (select p_partkey, f::int as f from u), (values (1, 'symbol', 0, 1), (2, 'math', -1, 2)) v(rank, kind, a, b)""")
def part_selections(spark, sf_dir):
    """Ranges around a cursor on the first symbol of each document."""
    docs = _docs(spark, sf_dir, _DEFINED)
    cursors = _t(spark, sf_dir, "part").selectExpr("p_partkey as cursor", f"{_FILE} as file_id", f"instr({_DEFINED}, '$') as at")
    return navigation.selections(docs, cursors)


@query(f"""
with d as (select p_partkey as id, {_kinds(_KINDS, 'p_partkey % 29')} as kind, p_size from part)
select id, kind, case when p_size % 3 = 0 then 'metre' when p_size % 3 = 1 then 'newton' end as unit, case when p_size % 3 = 0 and kind <> 'length' or p_size % 3 = 1 and kind <> 'force' then 'quantity-unit-dimension-mismatch' end as code from d""")
def part_quantities(spark, sf_dir):
    """Quantity kinds and units that descriptions of parts state."""
    said = f"'the ' || p_name || ' ' || replace({_kinds(_KINDS, 'p_partkey % 29')}, '-', ' ') || case p_size % 3 when 0 then ' measured in metres' when 1 then ' in N' else '' end"
    return quantities.described(_t(spark, sf_dir, "part").selectExpr("p_partkey as id", f"{said} as description"), "id", "description")


@query("""
select p_partkey, case p_partkey % 5 when 0 then 'matrix' when 1 then 'vector' when 2 then 'matrix' when 3 then 'scalar' end as kind, case p_partkey % 5 when 0 then p_size::varchar when 1 then p_size::varchar when 2 then '?' end as "rows", case p_partkey % 5 when 0 then (p_size + 1)::varchar when 2 then '?' end as "columns" from part""")
def part_shape_texts(spark, sf_dir):
    """Shapes that descriptions of parts state."""
    said = "case p_partkey % 5 when 0 then 'a ' || p_size || ' by ' || (p_size + 1) || ' matrix' when 1 then 'a ' || p_size || '-dimensional state vector' when 2 then 'the ' || p_name || ' matrix' when 3 then 'a scalar ' || p_name else 'the ' || p_name end"
    return _t(spark, sf_dir, "part").selectExpr("p_partkey", f"{said} as d").select("p_partkey", text.shape(F.col("d")).alias("s")).select("p_partkey", "s.*")


@query("""
with p as (select p_partkey, p_size % 5 - 2 as a, 1 + p_size % 3 as d, p_partkey % 7 - 3 as b from part),
x as (select p_partkey, a * 2 + b * d as n, d * 2 as m, a * 2 - b * d as k, gcd(a * 2 + b * d, d * 2) as g, gcd(a * 2 - b * d, d * 2) as h from p)
select p_partkey, case when n = 0 then '' else 'length:' || (n // g)::bigint || '/' || (m // g)::bigint end as product, case when k = 0 then '' else 'length:' || (k // h)::bigint || '/' || (m // h)::bigint end as quotient from x""")
def part_dimension_algebra(spark, sf_dir):
    """Products and quotients of rational powers of length."""
    from lemmata.functions import dimensions

    power = lambda n, d: F.filter(F.array(F.struct(F.lit("length").alias("base"), n.cast("bigint").alias("num"), d.cast("bigint").alias("den"))), lambda e: e["num"] != 0)
    p = _t(spark, sf_dir, "part").select("p_partkey", power(F.col("p_size") % 5 - 2, 1 + F.col("p_size") % 3).alias("l"), power(F.col("p_partkey") % 7 - 3, F.lit(2)).alias("r"))
    return p.select("p_partkey", dimensions.dimension_text(dimensions.combined(F.col("l"), F.col("r"), 1)).alias("product"), dimensions.dimension_text(dimensions.combined(F.col("l"), F.col("r"), -1)).alias("quotient"))


_LAWFUL = """'Let $F$ denote force. Let $m$ denote mass. Let $a$ denote acceleration. ' || case p_partkey % 5 when 0 then 'Assume a common frame for all. ' when 1 then 'They do not share a common frame. ' when 2 then 'These are different experiments. ' when 3 then 'Perhaps a common frame holds. ' else '' end || 'Then $F = m a$ for ' || p_name || '.'"""


@query(f"""
with t as (select p_partkey, {_FILE} as file_id, {_LAWFUL} as c from part)
select file_id, (strpos(c, '$F = m a$') - 1)::int as "at", 'classical-mechanics:newton-second-law' as law, case p_partkey % 5 when 0 then 'verified' when 1 then 'conflicting' when 2 then 'conflicting' else 'condition-missing' end as status from t""")
def part_laws(spark, sf_dir):
    """Statuses of recognised laws from assumptions before them."""
    docs = parsed.parsed(_docs(spark, sf_dir, _LAWFUL))
    found = laws.recognitions(docs).filter("support = 'typed'")
    return laws.with_status(found, docs).select("file_id", "at", "law", "status")


@query(f"""
with t as (select p_partkey, {_LAWFUL} as c from part)
select p_partkey as cursor, 'm' as symbol, 'established' as status, 'mass' as description, 'quantities-units:mass' as concept, (strpos(c, '$F = m a$') - 1)::int as formula, case when p_partkey % 5 = 0 then '' else 'condition:classical-mechanics:newton-second-law/same-context' end as requirements from t""")
def part_views(spark, sf_dir):
    """What is known at a cursor on a factor of each document's formula."""
    cursors = _t(spark, sf_dir, "part").selectExpr("p_partkey as cursor", f"{_FILE} as file_id", f"instr({_LAWFUL}, '$F = m a$') + 4 as at")
    out = views.semantic_view(_docs(spark, sf_dir, _LAWFUL), cursors)
    need = F.filter("requirements", lambda r: r.contains("newton"))
    return out.select("cursor", "symbol", "status", "description", "concept", "formula", F.array_join(need, ",").alias("requirements"))


_SAID = "case p_partkey % 6 when 0 then 'We use ' || p_name || ' (' || i || ') here.' when 1 then 'The ' || i || ' (' || p_name || ') is old.' when 2 then i || ' does not stand for ' || p_name || '.' when 3 then 'Perhaps ' || i || ' means ' || p_name || '.' when 4 then 'We use ' || p_name || ', abbreviated as ' || i || '.' else 'We use ' || p_name || ' (XQZ).' end"


@query(f"""
with t as (select p_partkey, p_name, upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) as i from part), s as (select *, {_SAID} as c from t)
select p_partkey, i as short, p_name as long, case p_partkey % 6 when 2 then 'negative' when 3 then 'hedged' else 'asserted' end as meant from s where p_partkey % 6 < 5""")
def part_acronyms(spark, sf_dir):
    """Short forms and the words whose initials they are."""
    t = _t(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "upper(substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) as i").selectExpr("p_partkey", f"{_SAID} as c")
    return prose.acronyms(t, "p_partkey", "c").select("p_partkey", "short", "long", "meant")


_REFERS = r"'See \\ref{a' || p_partkey || '} and \\eqref{a' || (p_partkey + 1) || '} in ../d' || p_size || '/x.tex. \\label{a' || p_partkey * 2 || '}'"


@query(f"""
select {_FILE} as file_id, 'a' || (p_partkey + k) as target from part, (values (0), (1)) v(k) where p_partkey + k not in (select p_partkey * 2 from part)""")
def dangling_labels(spark, sf_dir):
    """References to labels that no document sets."""
    return prose.dangling_references(_docs(spark, sf_dir, _REFERS))


@query(f"""
with t as (select p_partkey, p_name, p_brand, p_size from part)
select p_partkey, '../d' || p_size || '/x.tex' as path, 'acronym' as kind, p_brand as name, p_name as meaning from t""")
def declared_names(spark, sf_dir):
    """Declared abbreviations and mentioned paths."""
    t = _t(spark, sf_dir, "part").selectExpr("p_partkey", r"'\\newacronym{k}{' || p_brand || '}{' || p_name || '} see ../d' || p_size || '/x.tex' as c")
    return t.select("p_partkey", F.get(prose.path_mentions(F.col("c")), 0).alias("path"), F.explode(prose.declared_names(F.col("c"))).alias("d")).select("p_partkey", "path", "d.*")


def formula_nodes(docs):
    """(file_id, at, node, parent, ordinal, head, text, canonical) of the expressions of documents: an entity per subexpression."""
    import pyarrow as pa

    def row(file_id, at, source):
        tree = formulas.parse(source)
        return [(file_id, at, *n) for n in formulas.nodes(tree)] if tree else []

    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return constraints._mapped(constraints._formulas(docs), ["file_id", "at", "text"], row, "file_id string, at int, node int, parent int, ordinal int, head string, text string, canonical string", kinds)


@query(f"""
with t as (select {_FILE} as file_id, p_size % 2 = 0 as product, {_FORMULA} as c from part), f as (select *, case when product then 'product' else 'quotient' end as h from t)
select file_id, node::int as node, parent::int as parent, case when node = 0 then 'equals' when node = 2 then h else 'sym' end as head, case when node = 0 then 'equals(x,' || h || '(y,z))' when node = 2 then h || '(y,z)' else ['', 'x', '', 'y', 'z'][node + 1] end as canonical
from f, (values (0, null), (1, 0), (2, 0), (3, 2), (4, 2)) v(node, parent)""")
def expression_nodes(spark, sf_dir):
    """Subexpressions of the parts' formulas as rows."""
    out = formula_nodes(_docs(spark, sf_dir, _FORMULA)).filter("head <> 'sym' or at > 0")
    top = out.filter("node = 0 and head = 'equals'").select("file_id", "at")
    return out.join(top, ["file_id", "at"], "left_semi").select("file_id", "node", "parent", "head", "canonical")
