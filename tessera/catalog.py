"""Registered queries of the engine, named after the operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import languages as L
from tessera.functions import paths as P
from tessera.operators import graph as G
from tessera.operators import modules as M
from tessera.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The graph of the driver's tables, as SQL.
BASE = """with recursive geo as (select n_nationkey, r_regionkey, r_name as pkg, r_name || '/' || n_name as dir from nation join region on n_regionkey = r_regionkey),
f0 as (select c_custkey as k, c_nationkey as nk, 'c' as p, 'ts' as extension, 'typescript' as language from customer union all select s_suppkey, s_nationkey, 's', 'go', 'go' from supplier),
files as (select dir || '/' || p || k || '.' || extension as id, p || k || '.' || extension as name, language, extension, dir, pkg, p, k, case when k % 5 <> 0 then cast(nk * 2 + k % 2 as int) end as module_id, case when k % 5 = 0 then case when k % 2 = 0 then 'isolated' else 'undersized' end end as reason from f0 join geo on nk = n_nationkey),
sym0 as (select id as file_id, 'o' || o_orderkey as name, o_orderkey as n from orders join files on p = 'c' and k = o_custkey union all select id, 'p' || l_partkey, l_partkey from (select distinct l_suppkey, l_partkey from lineitem) join files on p = 's' and k = l_suppkey),
symbols as (select file_id || '#' || name as id, name, file_id, ['function','method','class','const','type','interface','enum'][n % 7 + 1] as symbol_kind, n % 2 = 0 as exported from sym0),
lines as (select c.id as source, s.id as target, c.id || '#o' || l_orderkey as caller, s.id || '#p' || l_partkey as callee, l_linenumber as line, l_orderkey, l_partkey, l_returnflag = 'R' as re_export from lineitem join orders on l_orderkey = o_orderkey join files c on c.p = 'c' and c.k = o_custkey join files s on s.p = 's' and s.k = l_suppkey),
edges as (select distinct source, target from lines),
ext0 as (select replace(p_brand, '#', '') as name, cast(p_size as varchar) as version from part),
exts as (select distinct case when v > 1 then name || '@' || version else name end as id, name, version from ext0 join (select name, count(distinct version) as v from ext0 group by name) using (name)),
packages as (select r_name as id, r_name as name, ['typescript','javascript','go','rust','java','python'][r_regionkey % 6 + 1] as language from region),
dirs as (select distinct dir as id from files),
nodes as (select id, 'package' as kind, name, null as file_id, language, null::int as module_id, null as reason, null as symbol_kind from packages union all select id, 'directory', split_part(id, '/', -1), null, null, null, null, null from dirs union all select id, 'file', name, id, language, module_id, reason, null from files union all select id, 'symbol', name, file_id, null, null, null, symbol_kind from symbols union all select id, 'external', name, null, null, null, null, null from exts),
outside as (select e.source, e.target, a.dir as sd, b.dir as td, a.pkg as sp, b.pkg as tp from edges e join files a on a.id = e.source join files b on b.id = e.target),
fin as (select target as id, count(distinct sd) as n from outside where sd <> td group by 1), fout as (select source as id, count(distinct td) as n from outside where sd <> td group by 1),
w as (select o.source, o.target, case when o.sd = o.td or greatest(coalesce(fin.n, 0), coalesce(fout.n, 0)) <= 1 then d else greatest(1.0, d / greatest(coalesce(fin.n, 0), coalesce(fout.n, 0))) end as weight from (select *, case when sd = td then 9.0 when sp = tp then 3.0 else 1.0 end as d from outside) o left join fin on fin.id = o.target left join fout on fout.id = o.source),
und as (select least(source, target) as a, greatest(source, target) as b, weight from w where source <> target)
"""


def query(sql: str | None = None, base: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = (BASE if base else "") + sql
        return f

    return add


def raw_imports(t: Tables) -> DataFrame:
    return t.lines().select("source", "target", F.concat(F.lit("m"), "l_partkey").alias("specifier"), "re_export", "line", F.struct("l_orderkey", "line", "l_partkey").alias("ord"))


def edges(t: Tables) -> DataFrame:
    return t.lines().select("source", "target").distinct()


def packages(t: Tables) -> DataFrame:
    from tessera.sources.tables import LANGUAGES, pick

    return t.read("region").select(F.col("r_name").alias("id"), F.col("r_name").alias("name"), pick(LANGUAGES, F.col("r_regionkey")).alias("language"))


def graph_nodes(t: Tables) -> DataFrame:
    return G.nodes(packages(t), G.directories(t.files(), packages(t)), t.files(), t.symbols(), G.externals(t.externals()))


def given(t: Tables) -> DataFrame:
    """A partition to compute with: files by directory."""
    return t.files().select("id", F.col("dir").alias("c"))


def test_paths(t: Tables) -> DataFrame:
    return t.read("part").select(F.concat(F.get(F.array(*map(F.lit, ["src/a", "tests/b", "src/test/c", "x/__tests__/d", "lib/e"])), (F.col("p_partkey") % 5).cast("int")), F.get(F.array(*map(F.lit, [".ts", ".test.tsx", "_test.go", "Test.java", ".rs", "_test.py", ".spec.d.ts", "/conftest.py", "/jest.config.cjs", "/.eslintrc.js", ".py"])), (F.col("p_partkey") % 11).cast("int"))).alias("path")).distinct()


TEST_PATHS = "with t as (select distinct ['src/a','tests/b','src/test/c','x/__tests__/d','lib/e'][p_partkey % 5 + 1] || ['.ts','.test.tsx','_test.go','Test.java','.rs','_test.py','.spec.d.ts','/conftest.py','/jest.config.cjs','/.eslintrc.js','.py'][p_partkey % 11 + 1] as path from part) "
_rx = lambda ps: "|".join(f"(?:{p})" for p in ps).replace("'", "''")


@query("select id, language, case language when 'typescript' then 'npm' else language end as family from files")
def s3_language_lookup(t):
    return t.files().select("id", L.language_of(F.col("extension")).alias("language"), L.family_of(L.language_of(F.col("extension"))).alias("family"))


@query(TEST_PATHS + "select path, regexp_extract(split_part(path, '/', -1), '.\\.([^.]+)$', 1) as extension, regexp_extract(split_part(path, '/', -1), '.\\.([^.]+)$', 1) in ('ts','tsx','js','jsx','mjs','cjs','go','rs','java','py') as eligible from t", base=False)
def s2_eligible_extension(t):
    ext = P.extension(P.basename(F.col("path")))
    return test_paths(t).select("path", ext.alias("extension"), ext.isin(*L.LANGUAGE).alias("eligible"))


@query(TEST_PATHS + f"select path, regexp_matches(path, '{_rx(L.TEST)}') as is_test, regexp_matches(path, '{_rx(L.CONFIG)}') as is_config from t", base=False)
def s16_test_and_config_files(t):
    return test_paths(t).select("path", L.is_test(F.col("path")).alias("is_test"), L.is_config(F.col("path")).alias("is_config"))


@query(TEST_PATHS + "select path from t where not regexp_matches(path, '(^|/)__tests__(/|$)') and not regexp_matches(path, '^src/test(/|$)')", base=False)
def f1_exclude_globs(t):
    return test_paths(t).filter(~P.excluded(F.col("path"), ["**/__tests__/**", "src/test/**"]))


@query("select id, name, kind from nodes where kind in ('directory','file') and (id = 'ASIA' or starts_with(id, 'ASIA/')) or kind = 'package' and id = 'ASIA' or kind = 'symbol' and starts_with(file_id, 'ASIA/')")
def f2_path_filter(t):
    n = graph_nodes(t)
    return n.join(G.matches(n, path="ASIA"), "id", "left_semi").select("id", "name", "kind")


@query("select id from nodes where kind = 'file' and language = 'go' or kind = 'symbol' and ends_with(file_id, '.go') or kind = 'package' and language = 'go' or kind = 'directory' and exists (select 1 from files where files.dir = nodes.id and files.language = 'go')")
def f3_family_path_filter(t):
    return G.matches(graph_nodes(t), path=".", family="go")


@query("select id, kind, case when kind = 'external' then null when kind = 'symbol' then file_id else id end as path, case when kind = 'package' then case when language in ('typescript','javascript') then 'npm' else language end when kind in ('file','symbol') then case when ends_with(file_id, '.ts') then 'npm' else 'go' end when kind = 'directory' then (select string_agg(distinct case language when 'typescript' then 'npm' else language end, ',' order by case language when 'typescript' then 'npm' else language end) from files where dir = nodes.id) else '' end as families from nodes")
def f4_locations(t):
    return G.locations(graph_nodes(t)).select("id", "kind", "path", F.array_join("families", ",").alias("families"))


@query("select d as dir, string_agg(distinct f, ',' order by f) as families from (select case language when 'typescript' then 'npm' else language end as f, unnest([dir, pkg, '.']) as d from files) group by d")
def f5_families_by_directory(t):
    return G.families_by_directory(t.files()).select("dir", F.array_join("families", ",").alias("families"))


@query("select id from symbols where symbol_kind = 'class'")
def f6_symbol_kind(t):
    return G.matches(graph_nodes(t), symbol_kind="class")


@query("select id from nodes where contains(lower(name), '12')")
def f7_search(t):
    return G.matches(graph_nodes(t), search="12")


# The package of a file's region if it is of the file's family.
OWNING = "select p.id from m join files f on f.id = coalesce(m.file_id, m.id) join packages p on p.id = f.pkg and case when p.language in ('typescript','javascript') then 'npm' else p.language end = case f.language when 'typescript' then 'npm' else f.language end"
CLOSED = ", m as (select id, file_id from symbols where symbol_kind = 'enum' and contains(lower(name), '7') and starts_with(file_id, 'AFRICA/')), k as (select id from m union select file_id from m union select f.dir from m join files f on f.id = m.file_id union " + OWNING + ") "


def _kept(t):
    n = graph_nodes(t)
    return G.closure(n, G.matched(n, path="AFRICA", symbol_kind="enum", search="7"))


@query(CLOSED + "select id from k")
def f8_filter_graph_nodes(t):
    return _kept(t)


@query(CLOSED + "select distinct source, target from lines where source in (select id from k) and target in (select id from k)")
def f8_filter_graph_edges(t):
    return G.induced(edges(t), _kept(t))


@query("select id from nodes where (case when kind = 'symbol' then file_id else id end = 'AFRICA' or starts_with(case when kind = 'symbol' then file_id else id end, 'AFRICA/')) and (kind = 'symbol' and ends_with(file_id, '.go') or kind in ('file','package') and language = 'go')")
def f9_view_filter(t):
    return G.view_matches(graph_nodes(t), path="AFRICA", language="go")


@query("select reason, count(*) as n from files where module_id is null group by 1")
def f10_reason_predicate(t):
    return t.files().filter("module_id is null").groupBy("reason").agg(F.count("*").alias("n"))


@query("select id, name as base, extension, dir, pkg || '/' || split_part(dir, '/', 2) as joined, 2 as depth, dir || '|' || pkg || '|.' as up from files")
def p1_p4_path_parts(t):
    i = F.col("id")
    return t.files().select("id", P.basename(i).alias("base"), P.extension(P.basename(i)).alias("extension"), F.array_join(P.container(i), "/").alias("dir"), F.concat_ws("/", P.segments(i)[0], P.segments(i)[1]).alias("joined"), F.size(P.container(i)).alias("depth"), F.array_join(P.ancestors(i), "|").alias("up"))


@query("select source, target, case when sd = td then 2 when sp = tp then 1 else 0 end as n from outside")
def p5_common_prefix(t):
    return edges(t).select("source", "target", P.common_prefix(P.container(F.col("source")), P.container(F.col("target"))).alias("n"))


@query("select split_part(id, '/', 2) as seg, count(*) as n from files group by 1")
def p6_child_segments(t):
    return t.files().groupBy(F.try_element_at(P.segments(F.col("id")), F.lit(2)).alias("seg")).agg(F.count("*").alias("n"))


@query("with s as (select distinct case p_partkey % 4 when 0 then '@' || split_part(p_type, ' ', 1) || '/' || p_size || '/x' when 1 then './' || p_size when 2 then 'P.q-' || p_size || '__R/sub' else '/abs/' || p_size end as spec from part) select spec, case when starts_with(spec, '.') or starts_with(spec, '/') then null when starts_with(spec, '@') then split_part(spec, '/', 1) || '/' || split_part(spec, '/', 2) else split_part(spec, '/', 1) end as package, regexp_replace(lower(spec), '[-_.]+', '_', 'g') as normal from s", base=False)
def p8_p10_package_names(t):
    k = F.col("p_partkey") % 4
    spec = F.when(k == 0, F.concat(F.lit("@"), F.split("p_type", " ")[0], F.lit("/"), "p_size", F.lit("/x"))).when(k == 1, F.concat(F.lit("./"), "p_size")).when(k == 2, F.concat(F.lit("P.q-"), "p_size", F.lit("__R/sub"))).otherwise(F.concat(F.lit("/abs/"), "p_size"))
    return t.read("part").select(spec.alias("spec")).distinct().select("spec", P.package_of_specifier(F.col("spec")).alias("package"), P.normal_name(F.col("spec")).alias("normal"))


@query("with g as (select distinct 'org.a' || p_size || case when p_size % 2 = 0 then '.b.c' else '' end as g from part) select g, case when len(string_split(g, '.')) > 3 then g || '|' || array_to_string(string_split(g, '.')[1:-2], '.') else g end as candidates from g", base=False)
def p11_group_candidates(t):
    g = t.read("part").select(F.concat(F.lit("org.a"), "p_size", F.when(F.col("p_size") % 2 == 0, ".b.c").otherwise("")).alias("g")).distinct()
    return g.select("g", F.array_join(P.group_candidates(F.col("g")), "|").alias("candidates"))


@query("select doc_id, sha256(text) as hash from documents", base=False)
def p13_content_hash(t):
    return t.read("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


@query("select id, case when module_id is null then 'unassigned' else 'module-' || module_id end as region, case when length(id) > 20 then left(id, 19) || '…' else id end as label from files")
def p14_p15_region_and_label(t):
    return t.files().select("id", F.when(F.col("module_id").isNull(), "unassigned").otherwise(F.concat(F.lit("module-"), "module_id")).alias("region"), F.when(F.length("id") > 20, F.concat(F.left("id", F.lit(19)), F.lit("…"))).otherwise(F.col("id")).alias("label"))


@query(", m as (select distinct module_id from files where module_id is not null), r as (select module_id, row_number() over (order by module_id) - 1 as i, count(*) over () as n from m) select module_id, round(320 * cos(2 * pi() * i / n), 6) as x, round(320 * sin(2 * pi() * i / n), 6) as y from r")
def p17_region_anchors(t):
    m = t.files().filter("module_id is not null").select("module_id").distinct()
    w = Window.orderBy("module_id")  # modules, not files
    a = 2 * F.pi() * (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy())
    return m.select("module_id", F.round(320 * F.cos(a), 6).alias("x"), F.round(320 * F.sin(a), 6).alias("y"))


@query("select symbols.id, files.language from symbols left join files on files.id = symbols.file_id")
def j1_symbol_file(t):
    return t.symbols().join(t.files().select(F.col("id").alias("file_id"), "language"), "file_id", "left").select("id", "language")


@query("select id, dir as owner from files")
def j2_nearest_manifest(t):
    p = t.places()
    owners = p.select(F.col("pkg").alias("dir"), F.col("pkg").alias("owner"), F.lit(0).alias("ord")).distinct().union(p.select("dir", F.col("dir").alias("owner"), F.lit(1).alias("ord")))
    return G.nearest(t.files(), owners)


@query("select id, pkg as owner from files")
def j3_owning_package(t):
    return G.nearest(t.files(), packages(t).select(F.col("id").alias("dir"), F.col("id").alias("owner"), F.lit(0).alias("ord")))


@query("select source, target from edges where starts_with(source, 'ASIA/') and starts_with(target, 'ASIA/')")
def j5_induced_edges(t):
    return G.induced(edges(t), t.files().filter("pkg = 'ASIA'"))


@query("select source, target from edges where source <> target and source in (select id from files where module_id is not null) and target in (select id from files where module_id is not null)")
def j6_restricted_edges(t):
    return G.induced(edges(t), t.files().filter("module_id is not null")).filter("source <> target")


@query("select a.module_id as src, b.module_id as dst, count(*) as n from edges join files a on a.id = source join files b on b.id = target where a.module_id <> b.module_id group by 1, 2")
def j7_module_pairs(t):
    m = t.files().filter("module_id is not null").select("id", "module_id")
    e = edges(t).join(m.withColumnsRenamed({"id": "source", "module_id": "src"}), "source").join(m.withColumnsRenamed({"id": "target", "module_id": "dst"}), "target")
    return e.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


DIFF = "with o as (select event_id, props from events where event_id % 3 <> 0), n as (select event_id, case when event_id % 7 = 0 then props || 'x' else props end as props from events where event_id % 5 <> 0), d as (select coalesce(o.event_id, n.event_id) as event_id, case when o.event_id is null then 'new' when n.event_id is null then 'gone' when o.props = n.props then 'unchanged' else 'changed' end as state from o full join n on o.event_id = n.event_id) "


def _old_new(t):
    e = t.read("events")
    return e.filter("event_id % 3 <> 0"), e.filter("event_id % 5 <> 0").withColumn("props", F.when(F.col("event_id") % 7 == 0, F.concat("props", F.lit("x"))).otherwise(F.col("props")))


@query(DIFF + "select * from d", base=False)
def j8_cache_difference(t):
    old, new = _old_new(t)
    h = lambda df: df.select("event_id", F.sha2("props", 256).alias("h"))
    return G.difference(h(old), h(new), "event_id", "h")


@query("select source, case when target in (select id from files where k % 3 <> 0) then target end as target, case when target in (select id from files where k % 3 <> 0) then 'file' else 'unresolved' end as kind from edges")
def j9_dangling_targets(t):
    return G.resolved(edges(t), t.files().filter("k % 3 <> 0"))


@query(", hidden as (select id from symbols where exported) select distinct caller, callee from lines where caller not in (select id from hidden) and callee not in (select id from hidden)")
def j10_hidden_symbols(t):
    return G.without_hidden(t.lines().select("caller", "callee").distinct(), t.symbols().filter("exported"))


@query("select source, target, caller, callee, count(*) as n from lines group by all")
def j11_symbol_links(t):
    calls = t.lines().groupBy("caller", "callee").agg(F.count("*").alias("n"))
    f = lambda c: F.element_at(F.split(c, "#"), 1)
    return calls.withColumns({"source": f("caller"), "target": f("callee")}).join(edges(t), ["source", "target"])


@query("select id as name, case when p = 's' then dir else pkg end as prefix from files")
def j12_longest_prefix(t):
    f = t.files()
    names = f.select(F.when(F.col("p") == "s", F.col("id")).otherwise(F.concat("pkg", F.lit("/x/"), "name")).alias("name"), "id")
    pre = t.places().select(F.col("pkg").alias("prefix")).union(t.places().select(F.col("dir").alias("prefix")))
    return names.join(G.longest_prefix(names, pre), "name").select(F.col("id").alias("name"), "prefix")


@query("select id from dirs")
def g2_directories(t):
    return G.directories(t.files(), packages(t))


@query("select kind, count(*) as n, count(distinct id) as ids from nodes group by 1")
def g3_node_assembly(t):
    return graph_nodes(t).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("select id, kind, name, file_id, language, module_id, reason, symbol_kind from nodes")
def g3_node_rows(t):
    return graph_nodes(t).select("id", "kind", "name", "file_id", "language", "module_id", "reason", "symbol_kind")


@query("select source, target, 'm' || arg_min(l_partkey, (l_orderkey, line, l_partkey)) as specifier, bool_or(re_export) as via_re_export, string_agg(cast(line as varchar), ',' order by l_orderkey, line, l_partkey) as lines from lines group by 1, 2")
def g4_import_merge(t):
    return G.merge_imports(raw_imports(t)).withColumn("lines", F.array_join("lines", ","))


@query("select * from exts")
def g5_externals(t):
    return G.externals(t.externals())


@query("select caller, callee, string_agg(cast(line as varchar), ',' order by line) as lines from (select caller, line, unnest([callee, source || '#o' || (l_orderkey + 1)]) as callee from lines) group by 1, 2")
def g6_call_fan_out(t):
    raw = t.lines().select("caller", "line", F.array("callee", F.concat("source", F.lit("#o"), F.col("l_orderkey") + 1)).alias("candidates"))
    return G.merge_calls(raw).withColumn("lines", F.array_join("lines", ","))


@query(", m as (select id, null as file_id, dir from files where name like '%7.ts') select id from m union select dir from m union " + OWNING)
def g7_ancestor_closure(t):
    n = graph_nodes(t)
    return G.closure(n, n.filter("kind = 'file' and name like '%7.ts'"))


@query("select id from files where k % 10 <> 3")
def g8_skipped_files(t):
    return t.files().join(t.files().filter("k % 10 = 3").select("id"), "id", "left_anti").select("id")


@query("select coalesce(language, 'unknown') as language, count(*) as n from nodes where kind in ('file','external','package') group by 1")
def a1_count_by_language(t):
    return graph_nodes(t).filter("kind in ('file', 'external', 'package')").groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))


@query("select count(*) as files, count(module_id) as assigned, count(*) - count(module_id) as unassigned, count(*) filter (reason = 'isolated') as isolated, count(distinct module_id) as modules, coalesce(max(module_id), -1) as most from files")
def a2_a9_assignment(t):
    return t.files().agg(F.count("*").alias("files"), F.count("module_id").alias("assigned"), F.count_if(F.col("module_id").isNull()).alias("unassigned"), F.count_if(F.coalesce(F.col("reason") == "isolated", F.lit(False))).alias("isolated"), F.countDistinct("module_id").alias("modules"), F.coalesce(F.max("module_id"), F.lit(-1)).alias("most"))


@query("select string_agg(distinct language, ',' order by language) as languages from nodes where kind in ('file','package','external')")
def a3_languages(t):
    return graph_nodes(t).filter("kind in ('file', 'package', 'external')").agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


@query("select coalesce(fin.id, fout.id) as id, coalesce(fin.n, 0) as fan_in, coalesce(fout.n, 0) as fan_out from fin full join fout on fin.id = fout.id")
def a4_fans(t):
    return G.fans(edges(t))


@query("select dir as c, count(*) as size from files group by 1")
def a5_community_sizes(t):
    return given(t).groupBy("c").agg(F.count("*").alias("size"))


EMBED = ", ends as (select a as id, b as o, weight from und union all select b, a, weight from und), emb as (select ends.id, sum(weight) as degree, sum(case when x.dir = y.dir then weight else 0 end) as internal from ends join files x on x.id = ends.id join files y on y.id = ends.o group by 1), size as (select dir, count(*) as n from files group by 1) "


@query(EMBED + "select files.id, files.dir as c, round(coalesce(degree, 0), 6) as degree, round(coalesce(internal, 0), 6) as internal from files left join emb using (id)")
def a6_degrees(t):
    return G.embedded(G.undirected(G.weights(edges(t))), given(t)).select("id", "c", F.round("degree", 6).alias("degree"), F.round("internal", 6).alias("internal"))


@query("select dir, module_id, count(*) as n from files where module_id is not null group by 1, 2")
def a7_modules_by_directory(t):
    return t.files().filter("module_id is not null").groupBy("dir", "module_id").agg(F.count("*").alias("n"))


@query("select module_id, count(distinct pkg) as pkgs, string_agg(distinct pkg, ',' order by pkg) as names from files where module_id is not null group by 1")
def a8_packages_by_module(t):
    return t.files().filter("module_id is not null").groupBy("module_id").agg(F.countDistinct("pkg").alias("pkgs"), F.array_join(F.array_sort(F.collect_set("pkg")), ",").alias("names"))


@query("select kind, count(*) as n from nodes group by 1 union all select 'edge', count(*) from edges")
def a11_counts(t):
    return graph_nodes(t).groupBy("kind").agg(F.count("*").alias("n")).union(edges(t).agg(F.lit("edge"), F.count("*")))


# Modules by the smallest directory of their files, which serves as their name here.
FLOW = ", mn as (select module_id, min(dir) as name from files where module_id is not null group by 1), fr as (select id, case when module_id is null then 'unassigned' else 'module-' || module_id end as region, case when module_id is null then 1 else 0 end as rank, module_id from files union all select id, 'external', 2, null from exts), fc as (select region, row_number() over (order by min(rank), coalesce(min(name), ''), min(module_id)) - 1 as col from fr left join mn using (module_id) group by 1), flow as (select id, region, col, row_number() over (partition by region order by id) - 1 as r from fr join fc using (region)), placed as (select *, cast(60 + 220 * col as double) as x, cast(88 + 58 * r as double) as y from flow) "


def _flow(t):
    names = t.files().filter("module_id is not null").groupBy("module_id").agg(F.min("dir").alias("name"))
    return G.flow(t.files(), G.externals(t.externals()), names)


@query(FLOW + "select region, round(avg(x), 6) as x, round(avg(y), 6) as y, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y from placed group by 1")
def a12_centroids(t):
    return G.boxes(_flow(t))


@query(FLOW + "select * from placed")
def v5_flow_layout(t):
    return _flow(t)


@query("select source, target, string_agg(case when l_orderkey % 3 = 0 then 'line ' || line else 'lines ' || line || '-' || (line + l_orderkey % 3) end, ', ' order by l_orderkey, line, l_partkey) as label from lines group by 1, 2")
def p15_described_locations(t):
    return G.described(t.lines().select("source", "target", F.struct("l_orderkey", "line", "l_partkey").alias("ord"), F.col("line").alias("start_line"), (F.col("line") + F.col("l_orderkey") % 3).alias("end_line")))


@query(", c as (select pkg, split_part(dir, '/', 2) as child, count(*) as n from files group by 1, 2), r as (select *, row_number() over (partition by pkg order by n desc, child) as r from c) select pkg, string_agg(child, '+' order by r) as name from r where r <= 4 group by 1")
def a13_joined_names(t):
    c = t.files().groupBy("pkg", F.element_at(F.split("dir", "/"), 2).alias("child")).agg(F.count("*").alias("n"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("pkg").orderBy(F.desc("n"), "child"))).filter("r <= 4")
    return r.groupBy("pkg").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "child"))), lambda x: x["child"]), "+").alias("name"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_returnflag || case when r > 1 then '#' || r else '' end as varchar) as local_id from (select *, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as r from lineitem)", base=False)
def w1_local_ids(t):
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    r = F.row_number().over(w)
    return t.read("lineitem").withColumn("r", r).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", F.when(F.col("r") > 1, F.concat(F.lit("#"), "r")).otherwise("")).alias("local_id"))


@query("select id, coalesce(module_id, -1) as col, row_number() over (partition by module_id order by id) - 1 as r, 40 + 24 * (row_number() over (partition by module_id order by id) - 1) as y from files")
def w2_p16_rows_in_columns(t):
    r = F.row_number().over(Window.partitionBy("module_id").orderBy("id")) - 1
    return t.files().select("id", F.coalesce("module_id", F.lit(-1)).alias("col"), r.cast("long").alias("r"), (40 + 24 * r).cast("long").alias("y"))


MAJOR = ", v as (select dir, module_id, count(*) as n from files where module_id is not null group by 1, 2), q as (select *, row_number() over x as r, lead(n) over x as s from v window x as (partition by dir order by n desc, module_id)), major as (select dir, case when n = 1 and s = 1 then null else module_id end as m from q where r = 1) "


@query(MAJOR + "select dir, m as module_id from major")
def w3_majority(t):
    return G.majority(t.files())


SPLIT = ", f as (select *, k % 10 as module from files where k % 5 <> 0), wide as (select module from f group by 1 having count(distinct pkg) > 1), pairs as (select distinct module, pkg from f where module in (select module from wide)), fresh as (select *, (select max(module) from f) + row_number() over (order by module, pkg) as id2 from pairs) "


@query(SPLIT + "select f.id, cast(coalesce(id2, f.module) as int) as module_id from f left join fresh on f.module = fresh.module and f.pkg = fresh.pkg")
def w4_m6_package_split(t):
    return G.split_packages(t.files().filter("k % 5 <> 0").withColumn("module_id", (F.col("k") % 10).cast("int")))


@query("select module_id, split_part(dir, '/', 2) || '-' || row_number() over (partition by split_part(dir, '/', 2) order by module_id) as name from (select distinct module_id, dir from files where module_id is not null)")
def w5_n5_ordinal_names(t):
    m = t.files().filter("module_id is not null").select("module_id", F.element_at(F.split("dir", "/"), 2).alias("deep")).distinct()
    return m.select("module_id", F.concat("deep", F.lit("-"), F.row_number().over(Window.partitionBy("deep").orderBy("module_id"))).alias("name"))


@query("select source, target, string_agg(callee, ',' order by r) filter (r <= 20) as first, greatest(count(*) - 20, 0) as more from (select source, split_part(target, '/', 1) as target, callee, row_number() over (partition by source, split_part(target, '/', 1) order by callee) as r from (select distinct source, target, callee from lines)) group by 1, 2")
def w6_v4_first_links(t):
    c = t.lines().select("source", F.element_at(F.split("target", "/"), 1).alias("target"), "callee").distinct()
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("source", "target").orderBy("callee")))
    return r.groupBy("source", "target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= 20, F.struct("r", "callee")))), lambda x: x["callee"]), ",").alias("first"), F.greatest(F.count("*") - 20, F.lit(0)).alias("more"))


@query("select id, row_number() over (order by id, kind) as ord from nodes")
def o1_node_order(t):
    return G.numbered(graph_nodes(t).select("id", "kind"), "id", "kind").select("id", "ord")


@query("select source, target, row_number() over (order by source, target) as ord from edges")
def o2_edge_order(t):
    return G.numbered(edges(t), "source", "target")


@query("select region, row_number() over (order by case when region = 'external' then 2 when region = 'unassigned' then 1 else 0 end, region) as ord from (select distinct case when module_id is null then 'unassigned' else 'module-' || module_id end as region from files union select 'external')")
def o3_o4_column_order(t):
    f = t.files().select(F.when(F.col("module_id").isNull(), "unassigned").otherwise(F.concat(F.lit("module-"), "module_id")).alias("region")).distinct()
    f = f.union(t.spark.sql("select 'external'"))
    rank = F.when(F.col("region") == "external", 2).when(F.col("region") == "unassigned", 1).otherwise(0)
    return f.select("region", F.row_number().over(Window.orderBy(rank, "region")).alias("ord"))


@query("select source, target, round(weight, 6) as weight from w")
def m1_edge_weight(t):
    return G.weights(edges(t)).select("source", "target", F.round("weight", 6).alias("weight"))


@query(", e2 as (select source, target, weight from w union all select target, source, weight + 1 from w where starts_with(source, 'ASIA/')) select least(source, target) as a, greatest(source, target) as b, round(arg_max(weight, (source, target)), 6) as weight from e2 where source <> target group by 1, 2")
def m2_undirected_graph(t):
    w = G.weights(edges(t))
    back = w.filter(F.col("source").startswith("ASIA/")).select(F.col("target").alias("source"), F.col("source").alias("target"), (F.col("weight") + 1).alias("weight"))
    return G.undirected(w.unionByName(back)).select("a", "b", F.round("weight", 6).alias("weight"))


@query()
def m3_louvain(t):
    return M.communities(G.undirected(G.weights(edges(t))).withColumn("repo_id", F.lit("one")))


@query(EMBED + ", deg as (select dir, sum(degree) as d from emb join files using (id) group by 1) select round((select sum(weight) from und join files x on x.id = a join files y on y.id = b where x.dir = y.dir) / (select sum(weight) from und) - (select sum(d * d) from deg) / (4 * power((select sum(weight) from und), 2)), 9) as q")
def m3b_modularity(t):
    return G.modularity(G.undirected(G.weights(edges(t))), given(t))


@query(EMBED + "select files.id, case when coalesce(degree, 0) > 0 and n >= 2 and internal / degree >= 0.5 then files.dir end as module_id, case when coalesce(degree, 0) = 0 then 'isolated' when n < 2 then 'undersized' when internal / degree < 0.5 then 'low-embeddedness' end as reason from files left join emb using (id) join size on size.dir = files.dir")
def m4_classify(t):
    return G.classify(G.undirected(G.weights(edges(t))), given(t), 0.5)


@query("select id, case when k % 4 = 0 then null when k % 4 = 1 then (select max(module_id) from files) + 1 else module_id end as module_id, case when k % 4 = 0 then 'config' when k % 4 = 1 then null else reason end as reason from files")
def m5_test_bucket(t):
    f, k = t.files(), F.col("k") % 4
    bucket = f.agg(F.max("module_id") + 1)
    return f.filter(k > 1).select("id", "module_id", "reason").unionByName(G.bucketed(f.filter(k <= 1), k == 1, bucket))


@query(MAJOR + "select id, case when module_id is null then null else coalesce(m, module_id) end as module_id from files left join major using (dir)")
def m8_reconcile(t):
    return G.reconcile(t.files())


@query("select id, case when n >= 2 then m end as module_id, case when m is null then reason when n < 2 then 'undersized' end as reason from (select id, reason, case when module_id is null then null else module_id * 100 + k % 97 end as m, count(*) over (partition by case when module_id is null then null else module_id * 100 + k % 97 end) as n from files)")
def m9_minimum_size(t):
    return G.minimum_size(t.files().select("id", "reason", (F.col("module_id") * 100 + F.col("k") % 97).cast("int").alias("module_id")))


@query("select count(distinct split_part(id, '/', 1)) = 1 as universal, min(split_part(id, '/', 1)) as first from files where module_id is not null")
def n1_universal_root(t):
    return t.files().filter("module_id is not null").agg((F.countDistinct(F.element_at(F.split("id", "/"), 1)) == 1).alias("universal"), F.min(F.element_at(F.split("id", "/"), 1)).alias("first"))


@query(", c as (select k % 3 as module_id, pkg as child, count(*) as n from files group by 1, 2), r as (select *, row_number() over (partition by module_id order by n desc, child) as r from c) select cast(module_id as int) as module_id, string_agg(child, '+' order by r) as name from r where r <= 4 group by 1")
def n2_child_names(t):
    return G.child_names(t.files().withColumn("module_id", (F.col("k") % 3).cast("int")))


@query()
def n3_n4_settled_names(t):
    """Two modules in each region and one over all regions: the names that the four candidates settle on."""
    from tessera.operators import naming

    regions = t.read("region").select(F.col("r_name").alias("pkg"), F.row_number().over(Window.orderBy("r_name")).alias("rank"))  # regions, not files
    f = t.files().join(F.broadcast(regions), "pkg").select("id", F.when(F.col("k") % 7 == 0, 99).otherwise(F.col("rank") * 2 + F.col("k") % 2).cast("int").alias("module_id"), "pkg", F.col("pkg").alias("pkg_name"))
    return naming.names(f)


@query()
def m7_refine(t):
    """Modules over many directories, split by their own inner edges; the module of a region's files."""
    regions = t.read("region").select(F.col("r_name").alias("pkg"), F.row_number().over(Window.orderBy("r_name")).cast("int").alias("module_id"))  # regions, not files
    f = t.files().drop("module_id", "reason").join(F.broadcast(regions), "pkg").select("id", "module_id", F.lit(None).cast("string").alias("reason"))
    e = edges(t).join(f.select(F.col("id").alias("source"), F.col("module_id").alias("m")), "source").join(f.select(F.col("id").alias("target"), F.col("module_id").alias("n")), "target").filter("m = n").select("source", "target")
    return M.refine(f, G.undirected(G.weights(e)), f.select("module_id").distinct())


@query("select distinct a.module_id as src, b.module_id as dst from edges join files a on a.id = source join files b on b.id = target where a.module_id <> b.module_id")
def r1_module_graph(t):
    return G.module_graph(edges(t), t.files())


ORDER = ", mods as (select module_id as id, min(dir) as name from files where module_id is not null group by 1), deps as (select distinct a.module_id as s, b.module_id as t from edges join files a on a.id = source join files b on b.id = target where a.module_id <> b.module_id), reach(s, t) as (select id, id from mods union select reach.s, deps.t from reach join deps on deps.s = reach.t), comp as (select r.s as id, min(r.t) as c from reach r join reach b on b.s = r.t and b.t = r.s group by 1), comps as (select c, min(name) as nm from comp join mods using (id) group by 1), waits as (select distinct a.c as s, b.c as t from deps join comp a on a.id = deps.s join comp b on b.id = deps.t where a.c <> b.c), walk(placed) as (select cast([] as int[]) union all select list_append(placed, (select arg_min(c, (nm, c)) from comps where not list_contains(placed, c) and not exists (select 1 from waits where waits.s = comps.c and not list_contains(placed, waits.t)))) from walk where len(placed) < (select count(*) from comps)), final as (select placed from walk order by len(placed) desc limit 1) "


@query(ORDER + "select 'one' as repo_id, mods.id, name, comp.c as component, cast(row_number() over (order by list_position((select placed from final), comp.c), name, mods.id) - 1 as int) as ord from mods join comp on comp.id = mods.id")
def r2_r3_module_order(t):
    f = t.files()
    names = f.filter("module_id is not null").groupBy("module_id").agg(F.min("dir").alias("name")).select(F.lit("one").alias("repo_id"), F.col("module_id").alias("id"), "name")
    return M.module_order(names, G.module_graph(edges(t), f).select(F.lit("one").alias("repo_id"), "src", "dst"))


CHAIN = "with recursive e as (select distinct a.l_partkey as source, b.l_partkey as target from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey), walk(id, level) as (select min(source), 0 from e union select target, level + 1 from walk join e on source = id where level < 30) "


@query(CHAIN + "select id, min(level) as level from walk where id is not null group by 1", base=False)
def v1_import_chain_levels(t):
    e = t.chain()
    return G.levels(e, e.agg(F.min("source").alias("id")).filter("id is not null"))


@query()
def v1_import_chain(t):
    e = t.chain()
    return G.chain(e, e.agg(F.min("source").alias("id")).filter("id is not null"))


@query("select distinct id from (select target as id from edges where source = (select min(source) from edges) union select min(source) from edges)")
def v2_neighbourhood(t):
    e = edges(t)
    start = e.agg(F.min("source").alias("id"))
    both = e.union(e.select("target", "source"))
    return both.join(F.broadcast(start), F.col("source") == F.col("id")).select(F.col("target").alias("id")).union(start).distinct()


@query("select id, module_id from files where module_id = 7")
def v3_module_footprint(t):
    return t.files().filter("module_id = 7").select("id", "module_id")


@query("select id, module_id = 7 as highlighted, not coalesce(module_id = 7, false) or not contains(lower(name), '1') as dimmed from files")
def v6_dimmed(t):
    lit = F.coalesce(F.col("module_id") == 7, F.lit(False))
    return t.files().select("id", (F.col("module_id") == 7).alias("highlighted"), (~lit | ~F.lower("name").contains("1")).alias("dimmed"))


@query("select id, kind from nodes where kind in ('file','external')")
def v7_view_scope(t):
    return G.scope(graph_nodes(t), edges(t))[0].select("id", "kind")


@query(", scoped as (select id from nodes where kind in ('file','external')) select source, target from edges where source in (select id from scoped) and target in (select id from scoped)")
def v7_scoped_edges(t):
    return G.scope(graph_nodes(t), edges(t))[1]


@query("select sha256('v1|' || string_agg(n_name || ':' || sha256(n_name || '/' || n_nationkey), ',' order by n_name)) as epoch from nation", base=False)
def i1_epoch(t):
    content = F.concat("n_name", F.lit("/"), F.col("n_nationkey").cast("string"))
    return G.epoch(t.read("nation").select(F.col("n_name").alias("path"), F.sha2(content, 256).alias("content_hash")), "v1")


@query(DIFF + "select state, count(*) as n from d group by 1", base=False)
def i2_changed_files(t):
    return j8_cache_difference(t).groupBy("state").agg(F.count("*").alias("n"))


@query("select event_id, value * case when event_id % 7 = 0 then 2 else 1 end as value from events", base=False)
def i4_merge_fresh(t):
    e = t.read("events").select("event_id", "value")
    fresh = e.filter("event_id % 7 = 0").withColumn("value", F.col("value") * 2)
    return e.join(fresh.select("event_id"), "event_id", "left_anti").unionByName(fresh)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtree and kind filter with ancestor closure."""
    return QUERIES["f8_filter_graph_nodes"](spark, sf_dir)
