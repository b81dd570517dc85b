"""The graph of parse records. The records are made of ``part`` (files, functions, classes, imports) and ``lineitem`` (calls)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import code_graph
from lodestrata.plans import query
from lodestrata.sources import views as V

#: Four parts in a row are a class and three functions of one file.
_OWN = "(p_partkey - p_partkey % 4)"
_FILE = f"concat('pkg', {_OWN} % 3, '/m', {_OWN} % 13, case {_OWN} % 3 when 0 then '.ts' else '.py' end)"
_IMPORTED = """case p_partkey % 8 when 0 then concat('pkg', p_partkey % 3, '.m', p_partkey * 3 % 13) when 2 then concat('./m', p_partkey * 7 % 13)
  when 4 then concat('pkg', p_partkey % 4, '.m', p_partkey * 11 % 13, '.f', p_partkey % 53) else concat('m', p_partkey * 5 % 17) end"""
_ALIAS = "case when p_partkey % 6 = 0 then concat('f', p_partkey % 53) end"
_RAW = """case l_linenumber % 7 when 0 then concat('self.f', l_suppkey % 53) when 1 then concat('new C', l_partkey % 97) when 2 then concat('C', l_suppkey % 97, '.f', l_partkey % 53)
  when 3 then concat('m', l_suppkey * 3 % 13, '.f', l_partkey % 53) when 4 then concat('super.f', (l_partkey + l_suppkey % 3) % 53) else concat('f', l_suppkey % 71) end"""


def records(spark, d):
    """calls, functions, classes, imports, files."""
    part = V.table(spark, d, "part")
    key = F.col("p_partkey")
    of = part.select("p_partkey", F.expr(_FILE).alias("file"), key.alias("ord"))
    name = lambda kind, n: F.concat(F.lit(kind), (key % n).cast("string"))
    functions = of.filter("p_partkey % 4 <> 0").select(F.concat(F.lit("fn"), key.cast("string")).alias("id"), "file", name("f", 53).alias("name"), F.when(key % 4 < 3, F.concat(F.lit("C"), F.expr(f"{_OWN} % 97").cast("string"))).alias("class_owner"), "ord")
    classes = of.filter("p_partkey % 4 = 0").select(F.concat(F.lit("cls"), key.cast("string")).alias("id"), "file", name("C", 97).alias("name"), F.array(name("C", 89), name("pkg.C", 101)).alias("bases"), "ord")
    imports = of.filter("p_partkey % 2 = 0").select("file", F.expr(_IMPORTED).alias("imported"), F.expr(_ALIAS).alias("alias"), "ord")
    files = of.groupBy("file").agg(F.min("ord").alias("ord"))
    lines = V.table(spark, d, "lineitem").filter("l_partkey % 4 <> 0")
    calls = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("call_id"), F.concat(F.lit("fn"), F.col("l_partkey").cast("string")).alias("caller"), F.expr(_RAW).alias("raw"))
    return calls, functions, classes, imports, files


_SQL = f"""of_ as (select p_partkey, {_FILE} as file from part),
  files_ as (select file, min(p_partkey) as ord, regexp_replace(file, '\\.[^./]*$', '') as stem from of_ group by file),
  imports_ as (select distinct {_FILE} as file, {_IMPORTED} as imported from part where p_partkey % 2 = 0),
  names_ as (select unnest([replace(stem, '/', '.'), stem, split_part(stem, '/', -1)]) as module, file, ord from files_),
  modules_ as (select module, max_by(file, ord) as file from names_ group by module)"""


_DEPENDS = f"""{_SQL},
  tried as (select i.file, imported, f.file as path, e.place from imports_ i cross join (values (1, '.py'), (2, '.ts')) as e(place, ending)
    join files_ f on f.file = ltrim(replace(imported, '.', '/'), './') || ending or (imported like './%' and ending = '.ts' and f.file = split_part(i.file, '/', 1) || '/' || imported[3:] || ending)
    where f.file <> i.file),
  hit as (select file, imported, min_by(path, place) as path from tried group by all),
  named as (select i.file, imported, coalesce(a.file, b.file) as found from imports_ i left join modules_ a on a.module = imported left join modules_ b on b.module = regexp_replace(imported, '\\.[^.]*$', '')),
  depends as (select n.file, n.imported, coalesce(h.path, n.found) as target, case when h.path is not null then 'structural_certain' else 'high_confidence' end as confidence
    from named n left join hit h using (file, imported) where h.path is not null or n.found <> n.file)"""


@query("module_dependencies", f"with {_DEPENDS} select * from depends")
def module_dependencies(spark, d):
    _, _, _, imports, files = records(spark, d)
    return code_graph.dependencies(imports, files)


#: What the rungs look up: for each place a name can be looked for, how many bear it, the first and the last.
_RECORDS = f"""
  fn as (select 'fn' || p_partkey as id, {_FILE} as file, 'f' || p_partkey % 53 as name, case when p_partkey % 4 < 3 then 'C' || {_OWN} % 97 end as owner, p_partkey as ord from part where p_partkey % 4 <> 0),
  cl as (select 'cls' || p_partkey as id, {_FILE} as file, 'C' || p_partkey % 97 as name, ['C' || p_partkey % 89, 'pkg.C' || p_partkey % 101] as bases, p_partkey as ord from part where p_partkey % 4 = 0),
  im as (select {_FILE} as file, {_IMPORTED} as imported, {_ALIAS} as alias, p_partkey as ord from part where p_partkey % 2 = 0),
  bound as (select file, x.name as bound, arg_max(imported, (ord, x.place)) as imported, arg_max({{'v': alias}}, (ord, x.place)).v as alias
    from (select *, unnest([{{'place': 0, 'name': coalesce(alias, split_part(imported, '.', -1))}}, {{'place': 1, 'name': case when alias is not null then imported end}}]) as x from im) where x.name is not null group by all),
  fn_here as (select file, name, count(*) as n, arg_min(id, ord) as a, arg_max(id, ord) as z from fn group by all),
  fn_far as (select name, count(*) as n, arg_min(id, ord) as a, arg_max(id, ord) as z from fn group by all),
  cl_here as (select file, name, count(*) as n, arg_min(id, ord) as a from cl group by all),
  cl_far as (select name, count(*) as n, arg_min(id, ord) as a from cl group by all),
  methods as (select cl.id as class_id, fn.name, count(*) as n, arg_min(fn.id, fn.ord) as a from fn join cl on cl.file = fn.file and cl.name = fn.owner group by all),
  bases as (select id, file, unnest(bases) as base, unnest(range(len(bases))) as place from cl),
  inherits as (select bases.id, base, place, case when h.n = 1 then h.a when h.n is null and g.n = 1 then g.a end as target,
      case when h.n = 1 then 'structural_certain' when h.n > 1 then 'flagged' when g.n = 1 then 'low_confidence' when g.n > 1 then 'flagged' else 'structural_certain' end as confidence
    from bases left join cl_here h on h.file = bases.file and h.name = split_part(base, '.', -1) left join cl_far g on g.name = split_part(base, '.', -1)),
  up as (select id, target, [place] as way, [target] as met from inherits where target is not null
    union all select up.id, i.target, list_append(way, i.place), list_append(met, i.target) from up join inherits i on i.id = up.target where i.target is not null and not list_contains(met, i.target)),
  inherited as (select up.id, m.name, arg_min(m.n, (len(way), way)) as n, arg_min(m.a, (len(way), way)) as a from up join methods m on m.class_id = up.target group by all),
  offers as (select d.file, h.name, arg_min(h.a, o.ord) as a from depends d join (select file, imported, min(ord) as ord from im group by all) o using (file, imported) join fn_here h on h.file = d.target and h.n = 1 group by all),
  names_here as (select distinct file, coalesce(alias, split_part(imported, '.', -1)) as name from im),
  said as (select l_orderkey || '-' || l_linenumber as call_id, 'fn' || l_partkey as caller, {_RAW} as raw from lineitem where l_partkey % 4 <> 0),
  asked as (select said.*, fn.file, fn.owner, fn.name = split_part(regexp_replace(raw, '^new ', ''), '.', -1) as own, split_part(regexp_replace(raw, '^new ', ''), '.', -1) as name,
      case when raw like 'new %' then 'new' when regexp_matches(raw, '^(self|this|super)\\.') then 'receiver' when contains(raw, '.') then 'qualified' else 'bare' end as kind,
      case when kind = 'qualified' then split_part(raw, '.', -2) end as holder from said join fn on fn.id = caller),
  met as (select asked.*, b.imported, b.alias, split_part(b.imported, '.', -1) as symbol,
      case when kind = 'bare' then coalesce(d1.target, d2.target, m2.file, m1.file) else coalesce(d1.target, m1.file) end as means, case when kind = 'bare' and b.alias = asked.name then symbol else asked.name end as sought
    from asked left join bound b on b.file = asked.file and b.bound = coalesce(holder, asked.name) left join depends d1 on d1.file = asked.file and d1.imported = b.imported
    left join depends d2 on d2.file = asked.file and d2.imported = regexp_replace(b.imported, '\\.[^.]*$', '') left join modules_ m1 on m1.module = b.imported left join modules_ m2 on m2.module = regexp_replace(b.imported, '\\.[^.]*$', '')),
  looked as (select met.*, coalesce(i1.n, 0) as i1n, i1.a as i1a, coalesce(i2.n, 0) as i2n, i2.a as i2a, c1.a as c1a, coalesce(c2.n, 0) as c2n, c2.a as c2a, coalesce(c3.n, 0) as c3n, c3.a as c3a,
      coalesce(h.n, 0) - own::int as near, case when h.a = caller then h.z else h.a end as near_id, coalesce(g.n, 0) - own::int as far, case when g.a = caller then g.z else g.a end as far_id,
      coalesce(m1.n, 0) as m1n, m1.a as m1a, coalesce(m2.n, 0) as m2n, m2.a as m2a, coalesce(r.n, 0) as rn, coalesce(m3.n, 0) as m3n, m3.a as m3a, offers.a as offer, names_here.name is not null as too
    from met left join fn_here i1 on i1.file = means and i1.name = sought left join fn_here i2 on i2.file = means and i2.name = symbol left join cl_here c1 on c1.file = means and c1.name = met.name
    left join cl_here c2 on c2.file = met.file and c2.name = met.name left join cl_far c3 on c3.name = met.name left join fn_here h on h.file = met.file and h.name = met.name left join fn_far g on g.name = met.name
    left join cl_here o on o.file = met.file and o.name = met.owner left join methods m1 on m1.class_id = o.a and m1.name = met.name left join inherited m2 on m2.id = o.a and m2.name = met.name
    left join cl_far r on r.name = holder left join methods m3 on m3.class_id = r.a and m3.name = met.name left join offers on offers.file = met.file and offers.name = met.name
    left join names_here on names_here.file = met.file and names_here.name = met.name),
  told as (select *, case
      when kind = 'new' then case when c1a is not null then 'constructor_import' when c2n = 1 then 'constructor_same_file' when c3n = 1 then 'constructor_repository' when c3n > 1 then 'duplicate_constructor_candidates' else 'constructor_target_not_found' end
      when kind = 'receiver' then case when m1n = 1 then 'class_receiver' when m1n > 1 then 'duplicate_method_in_class' when m2n = 1 then 'inheritance_receiver' when far = 1 then 'receiver_repository' when far > 1 then far || '_candidate_definitions' else 'attribute_call_unknown_receiver_type' end
      when kind = 'qualified' then case when i1n = 1 then 'module_qualified' when rn = 1 and m3n = 1 then 'class_qualified' when far = 1 then 'attribute_repository' else 'attribute_call_unknown_receiver_type' end
      when i1n = 1 or (i1n = 0 and i2n = 1) or offer is not null then 'imported_call' when near > 1 then 'duplicate_same_file_candidates' when near = 1 and not too then 'same_file' when near = 1 then 'name_collides_with_local_import'
      when far = 1 then 'repository_unique' when far > 1 then far || '_candidate_definitions' else 'no_matching_definition_found' end as rung from looked),
  rungs as (select call_id, caller, raw, rung, case
      when rung in ('duplicate_constructor_candidates', 'duplicate_method_in_class', 'duplicate_same_file_candidates', 'name_collides_with_local_import') or rung like '%candidate_definitions' then 'ambiguous_call::' || name
      when rung in ('constructor_target_not_found', 'attribute_call_unknown_receiver_type', 'no_matching_definition_found') then 'unresolved_call::' || raw
      when rung = 'constructor_import' then c1a when rung = 'constructor_same_file' then c2a when rung = 'constructor_repository' then c3a when rung = 'class_receiver' then m1a when rung = 'inheritance_receiver' then m2a
      when rung = 'module_qualified' then i1a when rung = 'class_qualified' then m3a when rung = 'imported_call' then case when i1n = 1 then i1a when i1n = 0 and i2n = 1 then i2a else offer end when rung = 'same_file' then near_id else far_id end as target,
      case when target like 'ambiguous_call::%' or target like 'unresolved_call::%' then 'flagged' when rung in ('constructor_repository', 'receiver_repository', 'attribute_repository', 'repository_unique') then 'low_confidence' else 'high_confidence' end as confidence from told)"""


@query("call_rungs", f"with recursive {_DEPENDS}, {_RECORDS} select call_id, caller, raw, target, confidence, rung from rungs")
def call_rungs(spark, d):
    """Every call with its target and what decided; also compared with a plain resolver in tests/test_code_graph.py."""
    return code_graph.resolve_calls(*records(spark, d))


@query(
    "record_edges",
    f"""with recursive {_DEPENDS}, {_RECORDS},
    e as (select 'contains' as relation, 'structural_certain' as confidence, 'parse_record' as provenance from cl union all select 'contains', 'structural_certain', 'parse_record' from fn
      union all select 'imports', 'structural_certain', 'parse_record' from im union all select 'inherits', confidence, 'base:' || base from inherits
      union all select 'depends_on', confidence, case confidence when 'structural_certain' then 'import_path' else 'module_name' end from depends union all select 'calls', confidence, rung from rungs)
    select relation, confidence, provenance, count(*) as edges from e group by all""",
)
def record_edges(spark, d):
    return code_graph.edges(*records(spark, d)).groupBy("relation", "confidence", "provenance").agg(F.count("*").alias("edges"))
