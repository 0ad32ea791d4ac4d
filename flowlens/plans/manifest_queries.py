"""Queries: manifests, files, contigs, containers, outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import paths, values
from flowlens.operators import containers, contigs, files, manifest as mf, outputs, store
from flowlens.operators.lineage import cut, new_path
from flowlens.plans.adapter import Tables
from flowlens.plans.registry import query
from flowlens.sources import documents, inventory as inv

ORDER = "layer, l_partkey, l_suppkey, l_shipdate"


@query("g1_cascade", "manifest", f"select manifest_id, name, arg_max(value, row({ORDER})) as value from v_manifest group by 1, 2")
def _(t: Tables):
    return mf.cascade(t.manifest, ORDER.split(", "))


@query("g1_required_on_top", "manifest", f"""select manifest_id, name, arg_max(value, l) as value from (
    select manifest_id, name, arg_max(value, row({ORDER})) as value, 0 l from v_manifest group by 1, 2
    union all select cast(o_orderkey as varchar), concat('p', o_orderkey % 7), o_orderpriority, 1 from orders where o_orderstatus = 'P') group by 1, 2""")
def _(t):
    required = t.orders.where("o_orderstatus = 'P'").selectExpr(
        "cast(o_orderkey as string) manifest_id", "concat('p', o_orderkey % 7) name", "o_orderpriority value")
    return mf.require_on_top(mf.cascade(t.manifest, ORDER.split(", ")), required)


RECIPES = """select {d} concat('r', p_partkey % 20) as key, concat('p', p_partkey % 7) as name, concat(p_type, '/', p_partkey % 20) as value from {p} where p_size % 2 = {m}"""
WANTED = """select cast(o_orderkey as {s}) manifest_id, i ord, concat('r', (o_orderkey * (i + 1)) % 25) as key from {o}"""


def _recipes(t, m):
    rows = t.spark.sql(RECIPES.format(d="", p="{p}", m=m), p=t.part)
    return rows.groupBy("key", "name").agg(F.min("value").alias("value"))


def _wanted(t):
    return t.spark.sql(WANTED.format(s="string", o="{o} lateral view explode(array(0, 1, 2)) as i"), o=t.orders)


_WANTED_SQL = WANTED.format(s="varchar", o="orders, (select unnest([0, 1, 2]) i)")
_REC = "select key, name, min(value) as value from ({}) group by 1, 2"


@query("g2_recipes", "manifest", f"""with w as ({_WANTED_SQL}), f as ({_REC.format(RECIPES.format(d='', p='part', m=0))}), i as ({_REC.format(RECIPES.format(d='', p='part', m=1))}),
  u as (select manifest_id, row(0, ord::bigint, 0) o_, name, value from w join f using (key) union all select manifest_id, row(0, ord::bigint, 1), name, value from w join i using (key)
    union all select manifest_id, row(1, layer::bigint, 0), name, min(value) from v_manifest group by 1, 2, 3)
  select manifest_id, name, arg_max(value, o_) as value from u group by 1, 2""")
def _(t):
    own = t.manifest.groupBy("manifest_id", "layer", "name").agg(F.min("value").alias("value"))
    return mf.with_recipes(own, _wanted(t), _recipes(t, 0), _recipes(t, 1))


@query("g2_unknown_recipes", "", f"select * from ({_WANTED_SQL}) w where not exists (select 1 from part where concat('r', p_partkey % 20) = w.key)")
def _(t):
    return mf.unknown_recipes(_wanted(t), _recipes(t, 0), _recipes(t, 1))


BATCH = """select cast(l_orderkey as {s}) manifest_id, l_linenumber layer, concat('f', l_linenumber % 3) as name, l_partkey, l_suppkey from {l}"""


@query("g3_stack_batches", "", """with b as (select cast(l_orderkey as varchar) manifest_id, l_linenumber layer, concat('f', l_linenumber % 3) as name, min(l_partkey) p, max(l_suppkey) s
     from lineitem group by 1, 2, 3),
   e as (select manifest_id, layer, name, i, case when i = 0 then concat('a', p) else concat('b', s) end as value from b, (select unnest([0, 1]) i) where i = 0 or layer % 2 = 1)
  select manifest_id, name, row_number() over (partition by manifest_id, name order by layer, i) - 1 pos, value from e where name <> 'f0'
  union all select manifest_id, name, i, value from e where name = 'f0' qualify layer = max(layer) over (partition by manifest_id, name)""")
def _(t):
    rows = t.lineitem.groupBy(
        F.col("l_orderkey").cast("string").alias("manifest_id"), F.col("l_linenumber").alias("layer"), F.expr("concat('f', l_linenumber % 3)").alias("name")
    ).agg(F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    layers = rows.selectExpr(
        "manifest_id", "layer", "name", "case when layer % 2 = 1 then array(concat('a', p), concat('b', s)) end value",
        "case when layer % 2 = 0 then concat('a', p) end scalar")
    return mf.stack_batches(layers, ["f1", "f2"])


ARRAYS = """select cast(o_orderkey as {s}) manifest_id, name, case when name = 'f1' and o_orderkey % 5 = 0 then null
   when name = 'f1' and o_orderkey % 7 = 0 then {a}'x'{b} else {a}concat('s-', o_orderkey % 3), concat('s_', o_custkey % 3), 'q'{b} end as value
 from {o} where not (name = 'f2' and o_orderkey % 4 = 0)"""


def _arrays(t):
    return t.spark.sql(ARRAYS.format(s="string", a="array(", b=")", o="(select *, explode(array('g', 'f1', 'f2', 'other')) name from {o}) o"), o=t.orders)


_ARRAYS_SQL = ARRAYS.format(s="varchar", a="[", b="]", o="(select *, unnest(['g', 'f1', 'f2', 'other']) as name from orders) o")


@query("g4_check_batches", "", f"""with a as ({_ARRAYS_SQL}), w as (select manifest_id, unnest(['f1', 'f2']) as name from (select distinct manifest_id from a))
  select w.manifest_id, w.name, case when a.manifest_id is null then 'missing' when a.value is null then 'not an array' else concat('length ', len(a.value), ' not 3') end reason
  from w left join a using (manifest_id, name) where a.value is null or len(a.value) <> 3""")
def _(t):
    return mf.check_batches(_arrays(t), "g", ["f1", "f2"])


_IDENT = "case when regexp_matches(regexp_replace({v}, '[^A-Za-z0-9_]', '_', 'g'), '^[0-9]') then concat('_', regexp_replace({v}, '[^A-Za-z0-9_]', '_', 'g')) else regexp_replace({v}, '[^A-Za-z0-9_]', '_', 'g') end"


@query("d9_duplicate_groups", "", f"""with g as (select manifest_id, unnest(value) as value from ({_ARRAYS_SQL}) where name in ('g', 'other'))
  select manifest_id, value, count(*) n, 'repeated' reason from g group by 1, 2 having count(*) > 1
  union all select manifest_id, {_IDENT.format(v='value')} v, count(*), 'repeated as identifier' from g group by 1, 2 having count(*) > 1""")
def _(t):
    return mf.duplicate_groups(_arrays(t).where("name in ('g', 'other')").select("manifest_id", F.explode("value").alias("value")))


@query("g5_batch_fan_out", "", f"""with r as (select manifest_id, name, generate_subscripts(value, 1) - 1 pos, unnest(value) as value from ({_ARRAYS_SQL})),
   g as (select manifest_id, pos, {_IDENT.format(v='value')} g from r where name = 'g')
  select manifest_id, concat(name, '_', g) as name, 0 pos, value from r join g using (manifest_id, pos) where name in ('f1', 'f2')
  union all select manifest_id, name, pos, value from r where name not in ('f1', 'f2')
  union all select manifest_id, 'groupby_field', pos, g from g""")
def _(t):
    rows = _arrays(t).select("manifest_id", "name", F.posexplode("value").alias("pos", "value"))
    return mf.fan_out(rows, "g", ["f1", "f2"])


@query("g6_place_batch_outputs", "", f"""with g as (select manifest_id, concat('w', cast(manifest_id as bigint) % 400) workflow, unnest(value) as value from ({_ARRAYS_SQL}) where name = 'g'),
   o as (select distinct concat('w', p_partkey % 400) workflow, concat('out', p_size % 4) as name, p_brand f from part)
  select manifest_id, concat({_IDENT.format(v='value')}, '_', name) output_id, name output_name, concat(value, '/', f) folders from g join o using (workflow)""")
def _(t):
    groups = _arrays(t).where("name = 'g'").select("manifest_id", F.expr("concat('w', cast(manifest_id as bigint) % 400)").alias("workflow"), F.explode("value").alias("value"))
    outs = t.part.selectExpr("concat('w', p_partkey % 400) workflow", "concat('out', p_size % 4) name", "array(p_brand) folders").distinct()
    return mf.place_batch_outputs(groups, outs).withColumn("folders", F.array_join("folders", "/"))


G7_PATH = """case page_id % 6 when 0 then url when 1 then concat('~/', split_part(url, '://', 2)) when 2 then concat('./a/../', split_part(url, '://', 2))
  when 3 then concat('/x//./', split_part(url, '://', 2), '/..') when 4 then '~' else concat('../../../../', page_id, '/./b') end"""


@query("g7_qualify_paths", "", f"""with p as (select page_id, {G7_PATH} path from pages),
   f as (select page_id, path, case when e like '/%' then e else concat('/work/dir/', e) end as full_path from (select page_id, path, case when path = '~' then '/home/u' when path like '~/%' then concat('/home/u', substr(path, 2)) else path end e from p)),
   s as (select *, list_reduce(list_transform(list_filter(string_split(full_path, '/'), lambda x: x not in ('', '.')), lambda x: [x]),
       lambda a, b: case when b = ['..'] then a[1:greatest(len(a) - 1, 0)] else list_concat(a, b) end, cast([] as varchar[])) parts from f)
  select page_id, case when regexp_matches(path, '^[A-z0-9]{{2,}}://') then path else concat('/', array_to_string(parts, '/')) end path from s""")
def _(t):
    rows = t.pages.select("page_id", F.expr(G7_PATH).alias("path"))
    return mf.qualify_paths(rows, "path", F.lit("/work/dir"), F.lit("/home/u"))


G8 = """case page_id % 4 when 0 then concat('{"path":"', url, '"}') when 1 then concat('[{"path":"/a"},{"class":"x"},"', url, '"]') when 2 then concat('"', url, '"') else '[["/n"],[{"path":"/m"}]]' end"""


@query("g8_unwrap_files", "", """select page_id, p.path, p.value, p.reason from (select page_id, unnest(case page_id % 4
    when 0 then [{'path': '', 'value': case when page_id % 3 > 0 then url else concat('{"path":"', url, '"}') end, 'reason': case when page_id % 3 = 0 then 'not a file input' end}]
    when 1 then [{'path': '0', 'value': case when page_id % 3 > 0 then '/a' else '{"path":"/a"}' end, 'reason': case when page_id % 3 = 0 then 'not a file input' end},
      {'path': '1', 'value': '{"class":"x"}', 'reason': case when page_id % 3 = 0 then 'not a file input' else 'no path' end}, {'path': '2', 'value': url, 'reason': null}]
    when 2 then [{'path': '', 'value': url, 'reason': null}]
    else [{'path': '0,0', 'value': '/n', 'reason': null}, {'path': '1,0', 'value': case when page_id % 3 > 0 then '/m' else '{"path":"/m"}' end, 'reason': case when page_id % 3 = 0 then 'not a file input' end}] end) p from pages)""")
def _(t):
    rows = t.pages.select("page_id", F.expr("page_id % 3 > 0").alias("is_file"), F.parse_json(F.expr(G8)).alias("value"))
    return mf.unwrap_files(rows).select("page_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "value", "reason")


G9 = """case event_id % 9 when 0 then 'TRUE' when 1 then 'fAlSe' when 2 then concat('-', event_id) when 3 then cast(cast(value as decimal(10,2)) as {s}) when 4 then 'None'
  when 5 then event_type when 6 then concat(event_id, 'e2') when 7 then '' else cast(event_id as {s}) end"""


@query("g9_infer_values", "", f"""select event_id, case when v = 'None' then 'null' when lower(v) in ('true', 'false') then 'bool' when regexp_matches(v, '^-?[0-9]+$') then 'int'
    when try_cast(v as double) is not null then 'double' else 'text' end kind, case when lower(v) in ('true', 'false') then lower(v) = 'true' end v_bool,
    case when regexp_matches(v, '^-?[0-9]+$') then cast(v as bigint) end v_int,
    case when not regexp_matches(v, '^-?[0-9]+$') and lower(v) not in ('true', 'false') then try_cast(v as double) end v_double, nullif(v, 'None') v_text
  from (select event_id, {G9.format(s='varchar')} v from events)""")
def _(t):
    return t.events.select("event_id", values.infer(F.expr(G9.format(s="string"))).alias("x")).select("event_id", "x.*")


# Files and types built from page addresses. Half of the pages have their companions in the inventory.
FILE_PATH = "concat(split_part(split_part(url, '?', 1), '#', 1), case page_id % 5 when 0 then '.bam' when 1 then '.fasta.gz' when 2 then '.gz' when 3 then '.vcf' else '.odd' end)"
TYPES = "(values ('Bam', 0, {a}'.bam'{b}, {e}), ('BamBai', 1, {a}'.bam'{b}, {a}'.bai'{b}), ('Gz', 2, {a}'.gz'{b}, {e}), ('FastaGz', 3, {a}'.fasta.gz', '.fa.gz', '.gz'{b}, {e}), ('VcfIdx', 4, {a}'.vcf'{b}, {a}'^.idx', '.tbi'{b}))"


def _types(t):
    return t.spark.sql("select * from " + TYPES.format(a="array(", b=")", e="cast(array() as array<string>)") + " as t(type, pos, extensions, companions)")


_TYPES_SQL = TYPES.format(a="[", b="]", e="cast([] as varchar[])") + " t(type, pos, extensions, companions)"
_COMP_SQL = "case when {c} like '^%' then concat(regexp_replace({p}, '([^/])\\.[^./]*$', '\\1'), ltrim({c}, '^')) else concat({p}, {c}) end"
_INV_SQL = f"""select path from (select page_id, {FILE_PATH} path from pages) union all
  select case when page_id % 2 = 0 then concat(path, '.bai') else concat(path, '.tbi') end from (select page_id, {FILE_PATH} path from pages) where page_id % 3 > 0
  union all select regexp_replace(path, '.vcf$', '.idx') from (select page_id, {FILE_PATH} path from pages) where page_id % 5 = 3"""


def _files(t):
    return t.pages.selectExpr("page_id", f"{FILE_PATH} path")


def _inventory(t):
    f = _files(t)
    side = f.where("page_id % 3 > 0").selectExpr("case when page_id % 2 = 0 then concat(path, '.bai') else concat(path, '.tbi') end path")
    return f.select("path").unionByName(side).unionByName(f.where("page_id % 5 = 3").selectExpr("regexp_replace(path, '.vcf$', '.idx') path"))


@query("c9_e5_guess_types", "", f"""with f as (select distinct {FILE_PATH} path from pages), i as ({_INV_SQL}),
   m as (select path, type, pos, companions, max(length(e)) len from (select f.path, t.type, t.pos, t.companions, unnest(t.extensions) e from f, {_TYPES_SQL}) where ends_with(path, e) group by 1, 2, 3, 4),
   n as (select path, type, unnest(companions) c from m),
   lack as (select distinct path, type from n where {_COMP_SQL.format(c='c', p='path')} not in (select path from i)),
   b as (select path, arg_max(type, row(len + 20 * len(companions), -pos)) type, max(len + 20 * len(companions)) score from m where not exists (select 1 from lack l where l.path = m.path and l.type = m.type) group by 1)
  select f.path, b.type, cast(b.score as int) score from f left join b using (path)""")
def _(t):
    return files.guess_types(_files(t), _types(t), _inventory(t))


@query("g11_companions", "", f"""select page_id, type, {_COMP_SQL.format(c='c', p='path')} companion from
   (select page_id, path, f.type, unnest(companions) c from (select page_id, {FILE_PATH} path, case when page_id % 3 = 0 then 'BamBai' else 'VcfIdx' end type from pages) f join {_TYPES_SQL} on t.type = f.type)""")
def _(t):
    typed = _files(t).withColumn("type", F.expr("case when page_id % 3 = 0 then 'BamBai' else 'VcfIdx' end"))
    each = typed.join(_types(t), "type").select("page_id", "type", "path", F.explode("companions").alias("c"))
    return each.select("page_id", "type", paths.companion(F.col("path"), F.col("c")).alias("companion"))


@query("g18_odd_extensions", "", f"""select page_id, path, type from (select page_id, {FILE_PATH} path, case when page_id % 4 = 0 then 'Gz' else 'BamBai' end type from pages)
  where not (type = 'Gz' and ends_with(path, '.gz')) and not (type = 'BamBai' and ends_with(path, '.bam'))""")
def _(t):
    typed = _files(t).withColumn("type", F.expr("case when page_id % 4 = 0 then 'Gz' else 'BamBai' end"))
    return mf.odd_extensions(typed, _types(t)).select("page_id", "path", "type")


@query("c8_missing_files", "", f"""with i as ({_INV_SQL}), f as (select cast(page_id as varchar) manifest_id, {FILE_PATH} path, case when page_id % 4 = 0 then 'VcfIdx' else 'BamBai' end type from pages),
   e as (select manifest_id, type, '[0]' s, path from f union all select manifest_id, type, '[1]', concat(path, '.lost') from f where type = 'VcfIdx'),
   c as (select manifest_id, s, path, unnest(companions) c from e join {_TYPES_SQL} on t.type = e.type)
  select manifest_id, concat('inp', s) as name, path, false secondary from e where path not in (select path from i)
  union all select * from (select manifest_id, concat('inp_', regexp_replace(c, '[\\^.]', '', 'g'), s) as name, {_COMP_SQL.format(c='c', p='path')} p, true from c) where p not in (select path from i)""")
def _(t):
    f = _files(t).withColumn("type", F.expr("case when page_id % 4 = 0 then 'VcfIdx' else 'BamBai' end"))
    inputs = f.select(
        F.col("page_id").cast("string").alias("manifest_id"), F.lit("inp").alias("name"), "type",
        F.expr("case when type = 'VcfIdx' then array(path, concat(path, '.lost')) else array(path) end").alias("value"))
    return mf.missing_files(inputs, "value", _types(t), _inventory(t)).select("manifest_id", "name", "path", "secondary")


@query("c15_input_sizes", "paths", """select cast(m.page_id as varchar) manifest_id, m.value, m.is_file, case when m.is_file then p.size end size
  from (select page_id, split_part(split_part(url, '#', 1), '?', 1) as value, page_id % 3 > 0 is_file from pages) m left join (select path, max(size) size from v_paths group by 1) p on p.path = m.value""")
def _(t):
    inputs = t.pages.selectExpr("cast(page_id as string) manifest_id", "split_part(split_part(url, '#', 1), '?', 1) value", "page_id % 3 > 0 is_file")
    return mf.with_sizes(inputs, t.paths.groupBy("path").agg(F.max("size").alias("size"))).select("manifest_id", "value", "is_file", "size")


@query("g16_cache_keys", "paths", "select id, concat(md5(concat(path, coalesce(case when size % 2 = 0 then cast(size as varchar) end, ''))), '_', regexp_extract(path, '([^/]*)$', 1)) cache_key from v_paths")
def _(t):
    mod = F.expr("case when size % 2 = 0 then cast(size as string) end")
    return t.paths.select("id", paths.cache_key(F.col("path"), mod).alias("cache_key"))


@query("g19_check_types", "", """select cast(o_orderkey as varchar) manifest_id, k.name, k.kind, k.reason from (select o_orderkey, unnest([
    {'name': 'a', 'kind': 'int', 'reason': case when o_orderkey % 4 = 1 then 'not a int' when o_orderkey % 4 = 2 then 'missing' end},
    {'name': 'b', 'kind': 'array', 'reason': case when o_orderkey % 3 = 0 then 'not a array' end}]) k from orders) where k.reason is not null""")
def _(t):
    declared = t.orders.selectExpr("cast(o_orderkey as string) manifest_id", "inline(array(struct('a' as name, 'int' as kind, false as optional), struct('b' as name, 'array' as kind, true as optional), struct('c' as name, 'string' as kind, false as optional)))").withColumn(
        "default", F.when(F.col("name") == "c", F.parse_json(F.lit('"dflt"'))))
    given = t.orders.selectExpr(
        "cast(o_orderkey as string) manifest_id",
        "explode(map('a', case o_orderkey % 4 when 0 then '5' when 1 then '\"x\"' when 2 then 'null' else '7' end, 'b', case when o_orderkey % 3 = 0 then '1' else '[1]' end)) as (name, js)")
    return mf.check_types(declared, given.select("manifest_id", "name", F.parse_json("js").alias("value")))


DECLARED = """select cast(o_orderkey as {s}) manifest_id, name, o_orderkey % 5 <> 0 is_file, o_orderkey % 7 = 0 optional, o_orderkey % 11 = 0 has_default,
  case when name = 'x' and o_orderkey % 2 = 0 then concat('http://s/', o_custkey) end source, o_orderkey, o_custkey from {o}"""


def _declared(t):
    rows = t.spark.sql(DECLARED.format(s="string", o="(select *, explode(array('x', 'y')) name from {o}) o"), o=t.orders)
    return rows.withColumn("sources", F.expr("case when name = 'y' and o_orderkey % 3 > 0 then map('hg19', concat('gs://19/', o_orderkey), 'hg38', concat('gs://38/', o_orderkey)) end"))


_DECL_SQL = DECLARED.format(s="varchar", o="(select *, unnest(['x', 'y']) as name from orders) o")
_SOURCE_SQL = f"""select * from ({_DECL_SQL}) d where is_file and not optional and not has_default and (source is not null or (name = 'y' and o_orderkey % 3 > 0))
   and not exists (select 1 from manifest_in m where m.manifest_id = d.manifest_id and m.name = d.name)"""
_GIVEN_SQL = "manifest_in as (select cast(l_orderkey as varchar) manifest_id, case when l_partkey % 2 = 0 then 'x' else 'y' end as name from lineitem)"


def _sourceable(t):
    given = t.lineitem.selectExpr("cast(l_orderkey as string) manifest_id", "case when l_partkey % 2 = 0 then 'x' else 'y' end name", "'v' value")
    return mf.sourceable(_declared(t), given)


@query("g21_sourceable", "", f"with {_GIVEN_SQL} select manifest_id, name, source from ({_SOURCE_SQL})")
def _(t):
    return _sourceable(t).select("manifest_id", "name", "source")


@query("c13_choose_sources", "", f"""with {_GIVEN_SQL}, w as ({_SOURCE_SQL}), h as (select cast(o_orderkey as varchar) manifest_id, i pos, case when (o_orderkey + i) % 3 = 0 then 'hg38' when (o_orderkey + i) % 3 = 1 then 'hg19' else 'mm10' end hint
     from orders, (select unnest([0, 1]) i)),
   e as (select manifest_id, name, concat('gs://', substr(hint, 3), '/', o_orderkey) source, pos from w join h using (manifest_id) where source is null and hint in ('hg19', 'hg38'))
  select manifest_id, name, source from w where source is not null union all select manifest_id, name, arg_min(source, pos) from e group by 1, 2""")
def _(t):
    hints = t.orders.selectExpr("o_orderkey", "posexplode(array(0, 1)) as (pos, i)").selectExpr(
        "cast(o_orderkey as string) manifest_id", "pos", "case when (o_orderkey + i) % 3 = 0 then 'hg38' when (o_orderkey + i) % 3 = 1 then 'hg19' else 'mm10' end hint")
    return mf.choose_sources(_sourceable(t), hints)


@query("c11_unknown_inputs", "manifest", """select workflow, name, manifest_id from (select concat('w', cast(manifest_id as bigint) % 50) workflow, name, manifest_id from v_manifest) m
  where not exists (select 1 from part where concat('w', p_partkey % 50) = m.workflow and concat('p', p_size % 4) = m.name)""")
def _(t):
    given = t.manifest.selectExpr("concat('w', cast(manifest_id as bigint) % 50) workflow", "name", "manifest_id")
    declared = t.part.selectExpr("concat('w', p_partkey % 50) workflow", "concat('p', p_size % 4) name").distinct()
    return mf.unknown_inputs(given, declared)


@query("c12_undeclared_outputs", "", """with f as (select concat('w', o_orderkey % 60) workflow, concat('o', o_custkey % 6) field, 'Vcf' wanted from orders),
   o as (select workflow, name, min(type) type from (select concat('w', p_partkey % 60) workflow, concat('o', p_size % 5) as name, case p_partkey % 3 when 0 then 'Vcf' when 1 then 'VcfGz' else 'Bam' end type from part) group by 1, 2)
  select f.workflow, field, case when o.type is null then 'not an output' else 'incompatible type' end reason from f left join o on o.workflow = f.workflow and o.name = f.field
  where o.type is null or o.type = 'Bam'""")
def _(t):
    fields = t.orders.selectExpr("concat('w', o_orderkey % 60) workflow", "concat('o', o_custkey % 6) field", "'Vcf' wanted_type")
    outs = t.part.selectExpr("concat('w', p_partkey % 60) workflow", "concat('o', p_size % 5) name", "case p_partkey % 3 when 0 then 'Vcf' when 1 then 'VcfGz' else 'Bam' end type")
    outs = outs.groupBy("workflow", "name").agg(F.min("type").alias("type"))
    return mf.undeclared_outputs(fields, outs, t.spark.sql("select * from values ('VcfGz', 'Vcf'), ('Bam', 'Sam') as t(sub, super)"))


@query("c14_conversion_paths", "", """with recursive e as (select distinct concat('T', s_nationkey) f, concat('T', (s_nationkey * 3 + s_suppkey % 2) % 25) t from supplier),
   p as (select distinct concat('T', o_custkey % 26) guessed, concat('T', o_orderkey % 26) wanted from orders),
   w as (select f start, t here, concat(f, ' -> ', t) path, 1 steps, [f, t] seen from e where f <> t union all
     select w.start, e.t, concat(w.path, ' -> ', e.t), steps + 1, list_append(seen, e.t) from w join e on e.f = w.here where steps < 9 and not list_contains(seen, e.t)),
   b as (select start, here, min(steps) steps, arg_min(path, row(steps, path)) path from w group by 1, 2)
  select p.guessed, p.wanted, b.path, b.steps from p left join b on b.start = p.guessed and b.here = p.wanted where p.guessed <> p.wanted""")
def _(t):
    edges = t.supplier.selectExpr("concat('T', s_nationkey) `from`", "concat('T', (s_nationkey * 3 + s_suppkey % 2) % 25) to")
    pairs = t.orders.selectExpr("concat('T', o_custkey % 26) guessed", "concat('T', o_orderkey % 26) wanted")
    return mf.conversion_paths(pairs, edges)


# --- contigs -----------------------------------------------------------------------------------

REFS = "select concat('w', p_partkey % 20) workflow, concat('ref', p_partkey % 3) ref, concat('chr', p_size % 28) contig from {p}"


def _missing(t):
    used = t.contigs.selectExpr("concat('w', cast(input as bigint) % 20) workflow", "input", "contig")
    return contigs.missing_contigs(used, t.spark.sql(REFS.format(p="{p}"), p=t.part))


_MISSING_SQL = f"""r as (select distinct * from ({REFS.format(p='part')})), u as (select distinct concat('w', cast(input as bigint) % 20) workflow, input, contig from v_contigs),
   m as (select u.workflow, u.input, f.ref, u.contig from u join (select distinct workflow, ref from r) f using (workflow) where not exists (select 1 from r where r.workflow = u.workflow and r.ref = f.ref and r.contig = u.contig))"""


@query("c7_missing_contigs", "contigs", f"with {_MISSING_SQL} select * from m")
def _(t):
    return _missing(t)


@query("d12_missing_summary", "contigs", f"""with {_MISSING_SQL}, l as (select workflow, ref, contig from m group by 1, 2, 3)
  select workflow, ref, count(*) n, case when count(*) < 5 then string_agg(contig, ', ' order by contig) else concat(array_to_string(list(contig order by contig)[1:3], ', '), '...') end examples from l group by 1, 2""")
def _(t):
    return contigs.summarise_missing(_missing(t).select("workflow", "ref", "contig").distinct(), ["workflow", "ref"])


@query("d19_distinct_contigs", "contigs", "select distinct input, contig from v_contigs")
def _(t):
    return contigs.distinct_contigs(t.contigs, ["input"])


_FILES = "select {o} {t}(l_orderkey) input, concat('w', l_suppkey % 10) workflow, concat('chr', l_partkey) contig from {l}"


@query("d19_contig_profile", "", f"""with f as ({_FILES.format(o='', t='', l='lineitem')})
  select workflow, count(distinct contig) contigs, count(contig) intervals, true as within from f group by 1""")
def _(t):
    """The exact counts, and whether those of sketches kept per file and then united are within four standard errors."""
    files = t.spark.sql(_FILES.format(o="", t="", l="{l}"), l=t.lineitem)
    kept = cut(contigs.contig_sketches(files, ["workflow", "input"]))
    guess = contigs.estimate(contigs.unite_sketches(kept, ["workflow"])).withColumnRenamed("contigs", "guess")
    exact = contigs.distinct_contigs(files, ["workflow"]).groupBy("workflow").agg(F.count("contig").alias("contigs"))
    near = F.abs(F.col("guess") - F.col("contigs")) <= F.greatest(F.lit(1), 4 * 1.04 / 2 ** (contigs.SKETCH_LOG / 2) * F.col("contigs"))
    return exact.join(guess, "workflow").select("workflow", "contigs", "intervals", near.alias("within"))


_WANTED = """select distinct path from {p} union select distinct regexp_replace(path, '/[^/]*$', '') from {p}
  union select concat(path, '.bak') from {p} where size % 2 = 0"""


@query("a13_inventory", "paths", f"""with w as ({_WANTED.format(p='v_paths')}), f as (select path, max(size) size from v_paths group by 1),
    u as (select path, unnest(range(1, len(string_split(path, '/')))) i from f),
    d as (select distinct array_to_string(string_split(path, '/')[1:i], '/') path from u)
  select w.path, case when f.path is not null then 'file' when d.path is not null then 'folder' end kind, f.size
  from w left join f using (path) left join d using (path)""")
def _(t):
    found = t.paths.groupBy("path").agg(F.max("size").alias("size"))
    wanted = t.spark.sql(_WANTED.format(p="{p}"), p=t.paths)
    return inv.look_up(wanted, found).select("path", "kind", "size")


@query("u1_modifier_chain", "manifest", f"""select manifest_id, name, concat('/in/', value) as value from (
    select manifest_id, name, arg_max(value, l) as value from (
      select manifest_id, name, arg_max(value, row({ORDER})) as value, 0 l from v_manifest group by 1, 2
      union all select cast(o_orderkey as varchar), concat('p', o_orderkey % 7), o_orderpriority, 1 from orders where o_orderstatus = 'P')
    group by 1, 2) where name <> 'p0'""")
def _(t):
    required = t.orders.where("o_orderstatus = 'P'").selectExpr(
        "cast(o_orderkey as string) manifest_id", "concat('p', o_orderkey % 7) name", "o_orderpriority value")
    return mf.pipeline(t.manifest, [
        lambda m: mf.cascade(m, ORDER.split(", ")), lambda m: mf.require_on_top(m, required),
        lambda m: m.where("name <> 'p0'"), lambda m: m.withColumn("value", F.concat(F.lit("/in/"), "value")),
    ])


_LAYERS = """select s_suppkey, 0 layer, to_json(named_struct('name', s_name, 'nation', s_nationkey)) text from {s}
  union all select s_suppkey, 1, if(s_suppkey % 7 = 0, concat('{{"name": ', s_name), to_json(named_struct('nation', -s_nationkey, 'extra', array(s_suppkey)))) from {s}
    where s_suppkey % 3 <> 0"""


#: Suppliers whose files one task writes.
LAYER_FILES = 1000


@query("a7_layered_inputs", "", """with l as (select cast(s_suppkey as varchar) manifest_id, s_suppkey k, s_name, s_nationkey n from supplier)
  select manifest_id, 0 layer, 'name' as name, to_json(s_name)::varchar as value, cast(null as varchar) reason from l
  union all select manifest_id, 0, 'nation', n::varchar, null from l
  union all select manifest_id, 1, 'nation', (-n)::varchar, null from l where k % 3 <> 0 and k % 7 <> 0
  union all select manifest_id, 1, 'extra', concat('[', k, ']'), null from l where k % 3 <> 0 and k % 7 <> 0
  union all select manifest_id, 1, null, null, case when k % 3 = 0 then 'missing' else 'not a JSON object' end from l where k % 3 = 0 or k % 7 = 0""")
def _(t):
    """Two files for each supplier, written and read in one scan; of a third the second is missing, of others malformed."""
    root = new_path(t.spark, "layers")
    texts = t.spark.sql(_LAYERS, s=t.supplier)
    # The number of tasks follows the files: left to AQE, texts this small all go to one.
    tasks = max(1, -(-t.supplier.count() // LAYER_FILES))
    documents.write_files(texts.repartition(tasks, "s_suppkey"), root, ["s_suppkey", "layer"])
    there = inv.read_inventory(t.spark, root).select(
        F.regexp_extract("path", "s_suppkey=([0-9]+)", 1).alias("manifest_id"),
        F.regexp_extract("path", "layer=([0-9]+)", 1).cast("int").alias("layer"), F.col("path").alias("file"))
    named = t.supplier.selectExpr("cast(s_suppkey as string) manifest_id", "explode(array(0, 1)) layer")
    files = cut(named.join(there, ["manifest_id", "layer"], "left").withColumn("file", F.coalesce("file", F.concat(F.lit(root + "/"), "manifest_id"))))
    rows, bad = documents.read_manifests(t.spark, files, root)
    return rows.withColumn("value", F.to_json("value")).unionByName(bad.drop("file"), allowMissingColumns=True)


# --- containers --------------------------------------------------------------------------------

IMAGE = """case l_partkey % 8 when 0 then concat('tool', l_partkey % 50) when 1 then concat('tool', l_partkey % 50, ':', l_suppkey % 5) when 2 then concat('lib/tool', l_partkey % 50, ':1.', l_suppkey % 5)
  when 3 then concat('quay.io/bio/tool', l_partkey % 50, ':1.14--h', l_suppkey % 5, '_0') when 4 then concat('gcr.io/img', l_suppkey % 5) when 5 then concat('localhost:5000/a/b/t', l_suppkey % 5, '@sha256:', md5(cast(l_suppkey % 5 as {s})))
  when 6 then concat('reg.example.org/x/T', l_suppkey % 5) else concat('t', l_suppkey % 5, '@sha256:ab', l_suppkey % 5) end"""
_PAT = "^([a-z0-9]+(?:[._-][a-z0-9]+)*(?::[0-9]+)?(?:/[a-z0-9]+(?:[._-][a-z0-9]+)*)*)(?::([A-Za-z0-9]+(?:[-.:_A-Za-z0-9]+)*))?(?:@([A-Za-z0-9]+(?:[-.:_A-Za-z0-9]+)*))?"
_DIG = "^([a-zA-Z0-9_+.-]+):([a-zA-Z0-9]+)"
_PARSE_SQL = f"""x as (select distinct {IMAGE.format(s='varchar')} image from lineitem),
   y as (select image, contains(image, '/') sl, contains(image, '@') has_at, case when contains(image, '@') then string_split(image, '@') else string_split(image, ':') end pc from x),
   z as (select image, case when sl then nullif(regexp_extract(image, '{_PAT}', 1), '') else pc[1] end nm,
      case when sl then nullif(regexp_extract(image, '{_PAT}', 2), '') when not (has_at and regexp_matches(pc[2], '{_DIG}')) then pc[2] end tg,
      case when sl then nullif(regexp_extract(image, '{_PAT}', 3), '') when has_at and regexp_matches(pc[2], '{_DIG}') then pc[2] end dg, sl or len(pc) <= 2 okp from y),
   v as (select image, string_split(nm, '/') p, tg, dg, coalesce(okp and nm is not null and (dg is null or regexp_matches(dg, '{_DIG}')), false) valid from z),
   h as (select *, len(p) > 1 and (contains(p[1], '.') or lower(p[1]) like 'localhost%') hosted from v),
   parsed as (select image raw, valid, case when valid and hosted then p[1] end host, case when valid then nullif(array_to_string(p[(case when hosted then 2 else 1 end):len(p) - 1], '/'), '') end repository,
      case when valid then p[-1] end image, case when valid and dg is null then coalesce(tg, 'latest') end tag, case when valid then dg end digest from h)"""


def _images(t):
    return t.lineitem.select(F.expr(IMAGE.format(s="string")).alias("raw"))


@query("h7_h8_h9_image_inventory", "", f"""with {_PARSE_SQL}, q as (select *, concat(concat_ws('/', host, repository, image), coalesce('@' || digest, ':' || tag, '')) ref from parsed)
  select raw, valid, host, repository, image, tag, digest, case when valid then case when coalesce(host, '') = '' then 'dockerhub' when contains(host, 'quay.io') then 'quay' when contains(host, 'gcr') then 'gcr' else 'custom' end end registry,
    case when valid then ref end reference, case when valid then regexp_replace(ref, '[^A-Za-z0-9._-]+', '_', 'g') end file_name from q""")
def _(t):
    return containers.inventory(_images(t), "raw")


DIGESTS = "select concat('TOOL', p_partkey % 50) as image, concat('tool', p_partkey % 50, '@sha256:', min(p_partkey)) pinned from {p} where p_partkey % 50 < 30 group by 1, p_partkey % 50"


@query("b13_images_to_pin", "", f"with {_PARSE_SQL} select raw, tag from parsed where valid and digest is null and lower(raw) not in (select lower(image) from ({DIGESTS.format(p='part')}))")
def _(t):
    return containers.to_pin(_images(t), "raw", t.spark.sql(DIGESTS.format(p="{p}"), p=t.part)).select("raw", "tag")


@query("c5_pin_images", "", f"""with d as ({DIGESTS.format(p='part')}), o as (select concat('t', s_suppkey) tool, concat('Tool', s_suppkey % 50) image from supplier where s_suppkey % 3 = 0),
   l as (select l_orderkey, l_linenumber, l_partkey, concat('t', l_suppkey) tool, {IMAGE.format(s='varchar')} image from lineitem)
  select l_orderkey, l_linenumber, l_partkey, l.tool, coalesce(o.image, l.image) image, coalesce(d.pinned, o.image, l.image) container
  from l left join o on o.tool = l.tool left join d on lower(d.image) = lower(coalesce(o.image, l.image))""")
def _(t):
    tools = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "concat('t', l_suppkey) tool", f"{IMAGE.format(s='string')} image")
    over = t.supplier.where("s_suppkey % 3 = 0").selectExpr("concat('t', s_suppkey) tool", "concat('Tool', s_suppkey % 50) image")
    return containers.pin(tools, over, t.spark.sql(DIGESTS.format(p="{p}"), p=t.part))


@query("d8_tools_by_image", "", f"""with l as (select distinct lower({IMAGE.format(s='varchar')}) image, concat('t', l_suppkey) tool from lineitem), s as (select image, cast(ceil(count(*) / 1000) as bigint) parts from l group by 1)
  select image, ('0x' || substr(md5(tool), 1, 8))::bigint % parts part, parts, count(*) n, string_agg(tool, ',' order by tool) tools from l join s using (image) group by 1, 2, 3""")
def _(t):
    tools = t.lineitem.selectExpr("concat('t', l_suppkey) tool", f"{IMAGE.format(s='string')} image")
    return containers.tools_by_image(tools).withColumn("tools", F.array_join("tools", ","))


# --- outputs -----------------------------------------------------------------------------------


@query("b9_output_values", "", """select cast(o_orderkey as varchar) id, cast(o_custkey as varchar) submission_id, coalesce(nullif(v, ''), nullif(n, '')) as value from
    (select *, case o_orderkey % 3 when 0 then '' when 1 then o_orderpriority end v, case when o_orderkey % 2 = 0 then concat('/new/', o_orderkey) else '' end n from orders)
  where o_custkey in (select c_custkey from customer where c_acctbal > 0) and coalesce(nullif(v, ''), nullif(n, '')) is not null""")
def _(t):
    outs = t.orders.selectExpr(
        "cast(o_orderkey as string) id", "cast(o_custkey as string) submission_id", "case o_orderkey % 3 when 0 then '' when 1 then o_orderpriority end value",
        "case when o_orderkey % 2 = 0 then concat('/new/', o_orderkey) else '' end new_path")
    subs = t.customer.selectExpr("cast(c_custkey as string) id", "case when c_acctbal > 0 then 'completed' else 'failed' end status")
    return outputs.output_values(outs, subs).select("id", "submission_id", "value")


@query("c6_compare_outputs", "", """select o.o_orderkey, n.name, case when r.o is null then 'absent' when r.v = '' then 'empty' else 'ok' end state
  from orders o, (select unnest(['step1', 'step2', 'step9']) as name) n left join
    (select l_orderkey o, concat('step', l_linenumber) s, max(case when l_returnflag = 'R' then '' else l_returnflag end) v from lineitem group by 1, 2) r on r.o = o.o_orderkey and r.s = n.name""")
def _(t):
    declared = t.orders.selectExpr("o_orderkey", "explode(array('step1', 'step2', 'step9')) name")
    returned = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.expr("concat('step', l_linenumber)").alias("name")).agg(
        F.max(F.expr("case when l_returnflag = 'R' then '' else l_returnflag end")).alias("value"))
    return outputs.compare_outputs(declared, returned, ["o_orderkey", "name"]).drop("value")


@query("d10_path_summary", "raw_jobs", """with p as (select submission_id, concat('/out/', submission_id, '/', substr(run_id, 1, 2), '/', run_id, id) path from v_raw_jobs),
   a as (select submission_id, min(path) lo, max(path) hi, count(*) n from p group by 1)
  select submission_id, n paths, case when n = 1 then lo else concat('(multiple) ', substr(lo, 1, list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda i: substr(lo, 1, i) = substr(hi, 1, i)))), '*') end summary from a""")
def _(t):
    rows = t.raw_jobs.selectExpr("submission_id", "concat('/out/', submission_id, '/', substr(run_id, 1, 2), '/', run_id, id) path")
    return outputs.summarise_paths(rows, ["submission_id"], "path")


@query("g14_join_paths", "", """select user_id, event_id, concat_ws('|', event_type, case when event_id % 2 = 0 then concat('/a/', user_id) else 'None' end, 'x', props) joined from events""")
def _(t):
    nested = F.array(F.array(F.col("event_type"), F.expr("case when event_id % 2 = 0 then concat('/a/', user_id) end")), F.array(F.lit("x"), F.col("props")))
    return t.events.select("user_id", "event_id", values.join_nested(F.flatten(nested), "|").alias("joined"))


@query("g14_join_lists", "", """select event_id, concat_ws('|', event_type, user_id, case when event_id % 2 = 0 then 'a' else 'None' end, '', case when user_id % 2 = 0 then 'True' else 'False' end, 'x') joined from events""")
def _(t):
    # Texts, a list in a list in a list, a null, an empty list and a truth value.
    mixed = F.parse_json(F.expr("""concat('["', event_type, '", [', user_id, ', [', if(event_id % 2 = 0, '"a"', 'null'), ', []], ', user_id % 2 = 0, '], "x"]')"""))
    return outputs.join_lists(t.events.select("event_id", mixed.alias("value")), "event_id", "value", "|")


@query("g13_output_parameters", "", """select p_partkey, p_type type, kind, kind in ('file', 'directory') is_copyable, coalesce(ext, ovr, case when kind = 'file' then d.e end) extension,
    case when kind = 'file' then d.c end secondaries from (select *, case p_partkey % 4 when 0 then 'directory' when 1 then 'int' else 'file' end kind, case when p_size % 5 = 0 then '.out' end ext, case when p_size % 7 = 0 then '_x.txt' end ovr from part)
  left join (values ('ECONOMY', '.eco', '.bai'), ('SMALL', '.sml', null), ('LARGE', null, '^.idx')) d(t, e, c) on d.t = p_type""")
def _(t):
    declared = t.part.selectExpr(
        "p_partkey", "p_type type", "case p_partkey % 4 when 0 then 'directory' when 1 then 'int' else 'file' end kind",
        "case when p_size % 5 = 0 then '.out' end extension", "case when p_size % 7 = 0 then '_x.txt' end override")
    types = t.spark.sql("select * from values ('ECONOMY', '.eco', '.bai'), ('SMALL', '.sml', null), ('LARGE', null, '^.idx') as d(type, default_extension, companions)")
    return outputs.output_parameters(declared, types)


# Output elements: four declarations by order number, each with a list of two or a list of lists.
OUTPUTS = """select o_orderkey, concat('out', o_orderkey % 4) output_id, concat('/sub/', o_custkey) output_dir,
  case o_orderkey % 4 when 0 then 'original' when 1 then 'id' else 'given' end name_mode, i, j, concat('/e/', o_orderkey, '/f', i, j, case when o_orderkey % 3 = 0 then '.txt' else '' end) as value,
  case when o_orderkey % 5 = 0 then '.bam' end extension, o_orderkey % 10 <> 0 is_copyable from {o}"""


def _plan(t):
    rows = t.spark.sql(OUTPUTS.format(o="(select *, explode(array(0, 1)) i from {o}) lateral view explode(array(0, 1, 2)) as j where o_orderkey % 2 = 1 or j = 0"), o=t.orders)
    shaped = rows.selectExpr(
        "*", "case when o_orderkey % 2 = 1 then array(i, j) else array(i) end at", "case when o_orderkey % 2 = 1 then array(2, 3) else array(2) end sizes",
        "case o_orderkey % 4 when 2 then array('n0', 'n1') when 3 then array('one') end names",
        "case when o_orderkey % 8 = 1 then array(named_struct('text', 'd', 'list', cast(null as array<string>)), named_struct('text', cast(null as string), 'list', array('s0', 's1'))) "
        "when o_orderkey % 8 = 3 then array(named_struct('text', cast(null as string), 'list', array('a', 'b', 'c', 'd'))) end folders",
        "array('^.bai') secondaries")
    return outputs.plan_outputs(shaped)


_PLAN_SQL = f"""o as (select * from ({OUTPUTS.format(o='(select *, unnest([0, 1]) i from orders) cross join (select unnest([0, 1, 2]) j) where o_orderkey % 2 = 1 or j = 0')})),
  s as (select *, o_orderkey % 4 m, o_orderkey % 8 = 1 tagged, o_orderkey % 2 = 1 deep, is_copyable and name_mode = 'original' orig from o),
  n as (select *, case when orig then regexp_extract(value, '([^/]*)$', 1) else concat(
      case when m = 2 then concat('n', i) when m = 3 then 'one' else output_id end,
      case when deep then case when tagged then concat('_shard-', j) else concat('_shard-', i, '_shard-', j) end else case when m = 2 then '' else concat('_shard-', i) end end,
      coalesce(extension, case when is_copyable and o_orderkey % 3 = 0 then '.txt' end, '')) end file_name, concat(output_dir, case when tagged then concat('/d/s', i) else '' end) folder from s)"""


@query("g12_plan_outputs", "", f"with {_PLAN_SQL} select o_orderkey, i, j, folder, file_name, concat(folder, '/', file_name) new_path from n")
def _(t):
    return _plan(t).select("o_orderkey", "i", "j", "folder", "file_name", "new_path")


@query("g12_plan_companions", "", f"""with {_PLAN_SQL} select o_orderkey, i, j, regexp_replace(value, '([^/])\\.[^./]*$', '\\1') || '.bai' source,
    concat(folder, '/', regexp_replace(file_name, '([^/])\\.[^./]*$', '\\1'), '.bai') new_path from n where is_copyable""")
def _(t):
    plan = _plan(t).withColumn("output_id", F.concat_ws(",", "o_orderkey", "i", "j"))
    return outputs.plan_companions(plan).selectExpr(
        "cast(split_part(output_id, ',', 1) as bigint) o_orderkey", "cast(split_part(output_id, ',', 2) as int) i", "cast(split_part(output_id, ',', 3) as int) j", "source", "new_path")


@query("g12_collisions", "", f"with {_PLAN_SQL} select o_orderkey % 50 grp, concat(folder, '/', file_name) new_path, count(*) n from n group by 1, 2 having count(*) > 1")
def _(t):
    return outputs.collisions(_plan(t).withColumn("grp", F.expr("o_orderkey % 50")), ["grp"])


@query("g15_plan_logs", "jobs", """with j as (select submission_id, run_id, id, shard, unnest(['stdout', 'stderr', 'script']) kind from v_jobs),
   k as (select *, concat('/w/', run_id, '/', id, '/', kind) source from j)
  select submission_id, run_id, id, kind, source, concat('/logs/', id, 'shard-', shard, '_', kind) target from k
  where source in (select concat('/w/', o_orderkey, '/step', o_orderkey % 5 + 1, '/', case o_orderkey % 2 when 0 then 'stdout' else 'script' end) from orders)""")
def _(t):
    jobs = t.jobs.selectExpr(
        "submission_id", "run_id", "id", "shard", *[f"concat('/w/', run_id, '/', id, '/{k}') {k}" for k in ("stdout", "stderr", "script")])
    present = t.orders.selectExpr("concat('/w/', o_orderkey, '/step', o_orderkey % 5 + 1, '/', case o_orderkey % 2 when 0 then 'stdout' else 'script' end) path")
    return outputs.plan_logs(jobs, present, F.lit("/logs"))


@query("g20_scatter_gather", "", """with a as (select event_id n, md5(cast(user_id * 31 + event_id as varchar)) h from events),
   b as (select n // 5 n, md5(string_agg(h, ',' order by n)) h from a group by 1), c as (select n // 5 n, md5(string_agg(h, ',' order by n)) h from b group by 1)
  select cast(n // 5 as bigint) n, md5(string_agg(h, ',' order by n)) hash from c group by 1""")
def _(t):
    return outputs.scatter_gather(t.events.selectExpr("event_id n", "user_id * 31 + event_id value"), width=5, levels=3)


@query("c10_gone_entries", "", """select cast(c_custkey as varchar) id, concat('/out/', c_name) output_dir from customer
  where concat('/out/', c_name) not in (select concat('/out/', c_name) from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F'))""")
def _(t):
    tasks = t.submissions.select("id", "output_dir")
    busy = t.orders.where("o_orderstatus = 'F'").selectExpr("cast(o_custkey as string) id")
    present = tasks.join(busy, "id", "left_semi").select(F.concat("output_dir", F.lit("/runs/log.txt")).alias("path"))
    folders = inv.folders(present).withColumnRenamed("path", "output_dir")
    return store.delete_ids(tasks, folders, "output_dir").select("id", "output_dir")
