"""One query for each family of operators, over the embedded test tables.

``queries`` runs the library's operators; ``oracle_sql`` says the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import render
from ..functions import comments, hashing, identity
from ..operators import closure, declarations, diff, inputs, modules, package_graph, valueflow
from ..sources import modfiles
from . import analyze
from . import embedding as em

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None, base: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _ALL[name] = f
        if sql is not None:
            _SQL[name] = f"with recursive {em.BASE_SQL}\n{sql}" if base else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- the flagship and its parts ------------------------------------------------


def _affected(spark: SparkSession, d: str) -> DataFrame:
    return analyze.affected_symbols(em.symbols(spark, d), em.deps(spark, d))


@_query("affected_packages", "select distinct p.path, p.relative_path, p.name from affected a join owner o on o.id = a.node join packages p on p.path = o.package_path")
def affected_packages(spark: SparkSession, d: str) -> DataFrame:
    return package_graph.in_order(package_graph.affected_packages(_affected(spark, d), em.symbols(spark, d), em.packages(spark, d)))


@_query("changed_symbols", "select id from changed")
def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return diff.changed_symbols(em.symbols(spark, d))


@_query("changed_kind", "select id, kind from changed")
def changed_kind(spark: SparkSession, d: str) -> DataFrame:
    return diff.symbol_changes(em.symbols(spark, d))


@_query("dispatch_filter", "select distinct id from symbols where id like '%::interface-trace::%'")
def dispatch_filter(spark: SparkSession, d: str) -> DataFrame:
    return em.symbols(spark, d).where(identity.is_dispatch("id")).select("id").distinct()


@_query("reverse_edges", "select src, dst from edges")
def reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    return diff.reverse_edges(em.symbols(spark, d), em.deps(spark, d))


@_query("affected_symbols", "select node from affected")
def affected_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _affected(spark, d)


_CYCLE = "catalog::part::"


@_query(
    "affected_symbols_cyclic",
    """with recursive e as (select 5 * (p_partkey // 5) + (p_partkey + 1) % 5 as src, p_partkey as dst from part),
    a as (select p_partkey as node from part where p_partkey % 97 = 0 union select e.dst from a join e on e.src = a.node) select node from a""",
    base=False,
)
def affected_symbols_cyclic(spark: SparkSession, d: str) -> DataFrame:
    part = em.table(spark, d, "part").select(F.col("p_partkey").alias("dst"))
    edges = part.select((F.floor(F.col("dst") / 5) * 5 + (F.col("dst") + 1) % 5).cast("long").alias("src"), "dst")
    return closure.closure(edges, part.where("dst % 97 = 0").select(F.col("dst").alias("node")))


@_query("changed_packages", "select distinct package_path as path from changed join owner using (id)")
def changed_packages(spark: SparkSession, d: str) -> DataFrame:
    s = em.symbols(spark, d)
    return package_graph.changed_packages(diff.changed_symbols(s), s)


_EDGES_SQL = """, placed as materialized (select node, package_path from affected join owner on id = node),
  ends as materialized (select dst, package_path from edges join placed on node = src)
  select distinct ends.package_path as src, y.package_path as dst from ends join placed y on y.node = ends.dst where ends.package_path <> y.package_path"""


@_query("package_edges", _EDGES_SQL)
def package_edges(spark: SparkSession, d: str) -> DataFrame:
    return analyze.analyze(em.packages(spark, d), em.symbols(spark, d), em.deps(spark, d)).edges


@_query("same_tree_empty_diff", "select id from symbols where false")
def same_tree_empty_diff(spark: SparkSession, d: str) -> DataFrame:
    old = em.symbols(spark, d).where("rev = 'old'")
    return diff.changed_symbols(old.unionByName(old.withColumn("rev", F.lit("new"))))


@_query("module_root_injection", "select id from changed union select path || '::package-init::$init' from (select distinct path from packages where path like 'geo/%')")
def module_root_injection(spark: SparkSession, d: str) -> DataFrame:
    s = em.symbols(spark, d)
    return diff.changed_symbols(s, s.where("package_path like 'geo/%'").select("package_path").distinct())


# -- reports -------------------------------------------------------------------

_NEW = "(select * from packages where rev = 'new')"


def _new_packages(spark: SparkSession, d: str) -> DataFrame:
    return em.packages(spark, d).where("rev = 'new'")


@_query("display_names", f"select relative_path || '.' || name as display from {_NEW}")
def display_names(spark: SparkSession, d: str) -> DataFrame:
    return render.names(_new_packages(spark, d))


@_query("dot_nodes", f"""select row_number() over (order by path) as n, path, relative_path || '.' || name as label,
  path in (select package_path from changed join owner using (id)) as changed from {_NEW}""")
def dot_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = em.symbols(spark, d)
    return render.dot_nodes(_new_packages(spark, d), package_graph.changed_packages(diff.changed_symbols(s), s))


@_query("dot_edges", f""", ends as materialized (select dst, package_path from edges join owner on id = src),
  pairs as materialized (select distinct ends.package_path as src, q.package_path as dst from ends join owner q on q.id = ends.dst where ends.package_path <> q.package_path)
  select x.n as a, y.n as b from pairs e join (select row_number() over (order by path) as n, path from {_NEW}) x on x.path = e.src join (select row_number() over (order by path) as n, path from {_NEW}) y on y.path = e.dst""")
def dot_edges(spark: SparkSession, d: str) -> DataFrame:
    s = em.symbols(spark, d)
    everything = s.select(F.col("id").alias("node")).distinct()
    edges = package_graph.package_edges(everything, diff.reverse_edges(s, em.deps(spark, d)), s)
    nodes = render.dot_nodes(_new_packages(spark, d), everything.select(F.col("node").alias("path")).limit(0))
    return render.dot_edges(nodes, edges)


@_query("json_rows", f"""select '{{"path":"' || relative_path || '","name":"' || name || '"}}' as row from {_NEW}""")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return render.json_rows(_new_packages(spark, d))


# -- identities and hashes -----------------------------------------------------


@_query("package_hash", "select rev, path as pkg, hash from packages")
def package_hash(spark: SparkSession, d: str) -> DataFrame:
    files = em.symbols(spark, d).select("rev", F.col("package_path").alias("pkg"), F.col("hash").alias("file_hash"))
    return declarations.package_hashes(files, files.select("rev", "pkg", F.lit("").alias("imported")).limit(0))


@_query("const_hash", "select p_partkey as k, sha256(p_type || chr(0) || p_size) as hash from part", base=False)
def const_hash(spark: SparkSession, d: str) -> DataFrame:
    return em.table(spark, d, "part").select(F.col("p_partkey").alias("k"), hashing.constant_hash("p_type", F.col("p_size").cast("string")).alias("hash"))


@_query("type_shell_hash", "select p_partkey as k, sha256(p_name || chr(0) || p_brand || case when p_size > 25 then '=' else '' end || case when p_size % 2 = 0 then chr(0) || p_type else '' end) as hash from part", base=False)
def type_shell_hash(spark: SparkSession, d: str) -> DataFrame:
    p = em.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("k"), hashing.type_shell_hash("p_name", "p_brand", F.col("p_size") > 25, F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("hash"))


@_query("dispatch_id", """select l_orderkey as k, 'o::' || l_orderkey || '::interface-field::0::' || sha256('p' || chr(0) || string_agg(distinct l_partkey::varchar, chr(0) order by l_partkey::varchar)) as id
  from lineitem group by l_orderkey""", base=False)
def dispatch_id(spark: SparkSession, d: str) -> DataFrame:
    parts = em.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("deps"))
    decl = F.concat(F.lit("o::"), F.col("l_orderkey").cast("string"))
    return parts.select(F.col("l_orderkey").alias("k"), identity.dispatch_id(decl, F.lit("interface-field"), F.lit(0), F.lit("p"), "deps").alias("id"))


@_query("cache_key", "select s_suppkey as k, sha256('v1' || chr(0) || s_name || chr(0) || s_nationkey) as key from supplier", base=False)
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return em.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), hashing.cache_key_column("s_name", F.col("s_nationkey").cast("string")).alias("key"))


@_query("decl_metadata_hash", "select p_partkey as k, case when p_size % 3 = 0 then sha256(p_name || chr(0) || p_brand) else p_name end as hash from part", base=False)
def decl_metadata_hash(spark: SparkSession, d: str) -> DataFrame:
    meta = F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    return em.table(spark, d, "part").select(F.col("p_partkey").alias("k"), hashing.with_metadata("p_name", meta).alias("hash"))


@_query("relative_paths", f"""select path, case when path = 'geo/region' then 'region' when starts_with(path, 'geo/') then substr(path, 5) else path end as relative from {_NEW} where path = 'geo/region'
  union all select path, case when path = 'geo' then 'geo' when starts_with(path, 'geo/') then substr(path, 5) else path end from {_NEW} where path <> 'geo/region'""")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    module = F.when(F.col("path") == "geo/region", F.col("path")).otherwise(F.lit("geo"))
    return _new_packages(spark, d).select("path", identity.relative_path(module, "path").alias("relative"))


@_query("symbol_ids", """select c_custkey as k, case when c_nationkey = 0 then 'crm::init::' || c_mktsegment || '::' || c_custkey
  when c_nationkey % 2 = 1 then 'crm::method::' || c_mktsegment || '.' || c_name else 'crm::func::' || c_name end as id from customer""", base=False)
def symbol_ids(spark: SparkSession, d: str) -> DataFrame:
    c = em.table(spark, d, "customer")
    name = F.when(F.col("c_nationkey") == 0, "init").otherwise(F.col("c_name"))
    receiver = F.when(F.col("c_nationkey") % 2 == 1, F.concat(F.lit("*"), "c_mktsegment"))
    return c.select(F.col("c_custkey").alias("k"), identity.function_id(F.lit("crm"), name, receiver, "c_mktsegment", "c_custkey").alias("id"))


@_query("member_explode", """select 'new' as rev, 'catalog::field::' || p_brand || '.' || coalesce(case when p_size % 4 > 0 then p_name end, '$embed' || pos) as id, 'catalog' as package_path, sha256(p_type) as hash
  from (select *, row_number() over (partition by p_brand order by p_partkey) - 1 as pos from part)""", base=False)
def member_explode(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_name")).alias("name"), F.col("p_type").alias("text"))
    owners = em.table(spark, d, "part").groupBy(F.col("p_brand").alias("owner")).agg(F.array_sort(F.collect_list(item)).alias("members"))
    return declarations.members(owners.select(F.lit("new").alias("rev"), F.lit("catalog").alias("pkg"), F.lit("field").alias("kind"), "owner", "members"))


@_query("value_specs", """select o_orderkey as k, pos, name, case when pos < n then o_orderstatus || pos when n = 1 then o_orderstatus || '0' end as value, case when n = 1 and pos > 0 then pos else 0 end as result_index
  from (select o_orderkey, o_orderstatus, 1 + o_orderkey % 2 as n, unnest(['a', 'b']) as name, unnest([0, 1]) as pos from orders)""", base=False)
def value_specs(spark: SparkSession, d: str) -> DataFrame:
    values = F.when(F.col("o_orderkey") % 2 == 1, F.array(F.concat("o_orderstatus", F.lit("0")), F.concat("o_orderstatus", F.lit("1")))).otherwise(F.array(F.concat("o_orderstatus", F.lit("0"))))
    return declarations.value_specs(em.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.array(F.lit("a"), F.lit("b")).alias("names"), values.alias("values")))


def _decls(spark: SparkSession, d: str) -> DataFrame:
    p = em.table(spark, d, "part")
    return p.select(F.lit("new").alias("rev"), F.col("p_brand").alias("pkg"), F.col("p_type").alias("file"), F.col("p_size").alias("file_ord"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 2 == 0).alias("effectful"))


@_query("init_ordinals", "select p_partkey as pos, row_number() over (partition by p_brand order by p_size, p_partkey) - 1 as init_index from part", base=False)
def init_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return declarations.init_ordinals(_decls(spark, d)).select("pos", "init_index")


@_query("blank_ordinals", "select pos, blank_index from (select p_partkey as pos, p_size, row_number() over (partition by p_brand, p_type order by p_partkey) - 1 as blank_index from part) where p_size % 2 = 0", base=False)
def blank_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return declarations.blank_ordinals(_decls(spark, d)).select("pos", "blank_index")


@_query("last_wins_symbols", "select 'new' as rev, p_brand as id, arg_max(p_type, p_partkey) as package_path, arg_max(p_name, p_partkey) as hash from part group by p_brand", base=False)
def last_wins_symbols(spark: SparkSession, d: str) -> DataFrame:
    p = em.table(spark, d, "part").select(F.lit("new").alias("rev"), F.col("p_brand").alias("id"), F.col("p_type").alias("package_path"), F.col("p_name").alias("hash"), "p_partkey")
    return declarations.unique_symbols(p, "p_partkey")


# -- modules -------------------------------------------------------------------


def _pkg_modules(spark: SparkSession, d: str) -> DataFrame:
    """Brands as packages, the types of their parts as modules."""
    revs = F.explode(F.array(F.lit("old"), F.lit("new"))).alias("rev")
    p = em.table(spark, d, "part").select(revs, F.col("p_brand").alias("package_path"), F.col("p_type").alias("m"), F.col("p_partkey").alias("k"))
    p = p.where("not (rev = 'new' and k % 101 = 7) and not (rev = 'old' and package_path like '%4')")
    return p.groupBy("rev", "package_path").agg(F.array_sort(F.collect_set("m")).alias("modules"), F.array_sort(F.collect_set("m")).alias("sum_keys"))


def _sums(spark: SparkSession, d: str) -> DataFrame:
    revs = F.explode(F.array(F.lit("old"), F.lit("new"))).alias("rev")
    p = em.table(spark, d, "part").select(revs, F.col("p_type").alias("key"), F.col("p_partkey").alias("k"))
    return p.groupBy("rev", "key").agg(F.sha2(F.max(F.when((F.col("rev") == "new") & (F.col("k") % 211 == 5), F.col("k") + 1000000).otherwise(F.col("k"))).cast("string"), 256).alias("value"))


_MODULES_SQL = """with p as (select rev, p_brand as package_path, p_type as m, p_partkey as k from part, (values ('old'), ('new')) r(rev)
    where not (rev = 'new' and p_partkey % 101 = 7) and not (rev = 'old' and p_brand like '%4')),
  pm as (select rev, package_path, list(distinct m order by m) as modules from p group by rev, package_path),
  s as (select rev, p_type as key, sha256(max(case when rev = 'new' and p_partkey % 211 = 5 then p_partkey + 1000000 else p_partkey end)::varchar) as value
    from part, (values ('old'), ('new')) r(rev) group by rev, p_type),
  ck as (select distinct a.package_path from (select distinct package_path, m from p where rev = 'old') a join (select distinct package_path, m from p where rev = 'new') b using (package_path, m)
    join s x on x.rev = 'old' and x.key = m join s y on y.rev = 'new' and y.key = m where x.value <> y.value)
"""


@_query("module_changed_packages", _MODULES_SQL + """select o.package_path from pm o join pm n on o.package_path = n.package_path and o.rev = 'old' and n.rev = 'new'
  where o.modules <> n.modules or o.package_path in (select package_path from ck)""", base=False)
def module_changed_packages(spark: SparkSession, d: str) -> DataFrame:
    config = spark.createDataFrame([("old", "x"), ("new", "x")], "rev string, global_hash string")
    return modules.changed_packages(_pkg_modules(spark, d), _sums(spark, d), config)


@_query("checksum_changed", _MODULES_SQL + "select package_path from ck", base=False)
def checksum_changed(spark: SparkSession, d: str) -> DataFrame:
    return modules.checksum_changes(_pkg_modules(spark, d), _sums(spark, d))


@_query("module_sums_last_wins", """select 'new' as rev, replace(p_brand, ' ', '_') || '@' || p_size as key, arg_max(replace(p_name, ' ', '_'), case when p_partkey % 5 = 0 then 1000000000000 else 0 end + p_partkey) as value
  from part where p_partkey % 7 <> 3 group by all""", base=False)
def module_sums_last_wins(spark: SparkSession, d: str) -> DataFrame:
    word = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    extra = F.when(F.col("p_partkey") % 7 == 3, "fourth")  # a line of four fields counts for nothing
    line = F.concat_ws(" ", word("p_brand"), F.col("p_size").cast("string"), word("p_name"), extra)
    p = em.table(spark, d, "part").select(F.lit("new").alias("rev"), F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0).alias("file_ord"), F.col("p_partkey").alias("line_no"), line.alias("line"))
    return modules.sums_last_wins(p)


@_query("sum_lines", "select 'new' as rev, doc_id % 2 as file_ord, unnest(range(len(string_split(text, chr(10))))) as line_no, unnest(string_split(text, chr(10))) as line from documents", base=False)
def sum_lines(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 1, "m/go.work.sum").otherwise("m/go.sum")
    out = modfiles.sum_lines(em.table(spark, d, "documents").select(F.lit("new").alias("rev"), path.alias("path"), "text"))
    return out.withColumn("line_no", F.col("line_no").cast("long")).withColumn("file_ord", F.col("file_ord").cast("long"))


@_query("module_identity", "select p_partkey as k, p_brand || '@' || p_size || case when p_size % 2 = 0 then '=>' || p_type || '@' || p_partkey else '' end as identity from part", base=False)
def module_identity(spark: SparkSession, d: str) -> DataFrame:
    p = em.table(spark, d, "part")
    text = lambda c: F.col(c).cast("string")
    return p.select(F.col("p_partkey").alias("k"), identity.module_identity("p_brand", text("p_size"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), text("p_partkey")).alias("identity"))


@_query("module_closure", """with recursive i as (select 's' || s_suppkey as a, 'n' || s_nationkey as b from supplier union select 'n' || n_nationkey, 'r' || n_regionkey from nation),
  c as (select a as root, b as x from i where a like 's%' union select root, b from c join i on i.a = c.x)
  select 'new' as rev, root as package_path, string_agg(x || '@v1', ',' order by x || '@v1') as modules from c where x like 'r%' or x like 'n%' group by root""", base=False)
def module_closure(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rev = F.lit("new").alias("rev")
    sup, nat = em.table(spark, d, "supplier"), em.table(spark, d, "nation")
    imports = sup.select(rev, name("s", "s_suppkey").alias("package_path"), name("n", "s_nationkey").alias("imported")).unionByName(
        nat.select(rev, name("n", "n_nationkey").alias("package_path"), name("r", "n_regionkey").alias("imported"))
    )
    empty = F.lit(None).cast("string")
    known = imports.select(rev, F.col("imported").alias("package_path"), F.col("imported").alias("path"), F.lit("v1").alias("version"), empty.alias("replaced_path"), empty.alias("replaced_version"), F.lit(False).alias("main")).distinct()
    out = modules.package_modules(imports, known, sup.select(rev, name("s", "s_suppkey").alias("package_path")))
    return out.select("rev", "package_path", F.array_join("modules", ",").alias("modules"))


@_query("module_config_hash", """select rev, sha256(string_agg(f || chr(0) || v || chr(0), '' order by f || chr(0) || v || chr(0))) as global_hash from (
  select p_brand as rev, p_type as f, coalesce(max_by(nullif(p_name, ''), case when p_size % 2 = 0 then 1000000 else 0 end + p_partkey)) as v from part group by 1, 2) group by rev""".replace("coalesce(max_by(nullif(p_name, ''), case when p_size % 2 = 0 then 1000000 else 0 end + p_partkey))", "max(p_name)"), base=False)
def module_config_hash(spark: SparkSession, d: str) -> DataFrame:
    p = em.table(spark, d, "part").groupBy(F.col("p_brand").alias("rev"), F.col("p_type").alias("field")).agg(F.max("p_name").alias("value"))
    return modules.config_hash(p.withColumn("file", F.lit("go.mod")))


@_query("module_path", "select arg_min(n_name, n_nationkey) as path from nation where n_regionkey = 3", base=False)
def module_path(spark: SparkSession, d: str) -> DataFrame:
    return modules.module_path(em.table(spark, d, "nation").select(F.col("n_name").alias("path"), (F.col("n_regionkey") == 3).alias("main"), F.col("n_nationkey").alias("ord")))


# -- comments, directives, inputs ----------------------------------------------


def _comments(spark: SparkSession, d: str) -> DataFrame:
    """Part names as comments, some of them directives."""
    k = F.col("p_partkey")
    text = F.when(k % 7 == 0, F.concat(F.lit("//go:linkname "), "p_name")).when(k % 7 == 1, F.concat(F.lit("//go:noinline "), "p_name")).when(k % 7 == 2, F.concat(F.lit("//export "), "p_name"))
    text = text.when(k % 7 == 3, F.concat(F.lit("//go:embed "), "p_name")).when(k % 7 == 4, F.concat(F.lit("/* "), "p_name", F.lit(" */"))).otherwise(F.concat(F.lit("// "), "p_name"))
    return em.table(spark, d, "part").select(F.lit("new").alias("rev"), F.col("p_brand").alias("owner"), k.alias("k"), text.alias("comment"), (k % 70 == 4).alias("is_cgo_preamble"))


_COMMENTS_SQL = """with c as (select p_partkey as k, p_brand as owner, p_partkey % 70 = 4 as cgo, case p_partkey % 7 when 0 then 'go:linkname ' || p_name when 1 then 'go:noinline ' || p_name
  when 2 then 'export ' || p_name when 3 then 'go:embed ' || p_name else p_name end as d from part)
"""


@_query("comment_normalize", _COMMENTS_SQL + "select k, d from c", base=False)
def comment_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).select("k", comments.normalized("comment").alias("d"))


@_query("build_directives", _COMMENTS_SQL + "select k from c where k % 7 in (0, 1, 2)", base=False)
def build_directives(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).where(comments.is_build_affecting(comments.normalized("comment"))).select("k")


@_query("package_directives", _COMMENTS_SQL + "select k from c where k % 7 in (0, 2)", base=False)
def package_directives(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).where(comments.is_package_wide(comments.normalized("comment"))).select("k")


@_query("metadata_hash", _COMMENTS_SQL + "select 'new' as rev, owner, sha256(string_agg(d, chr(0) order by d)) as hash from c where k % 7 in (0, 2) or cgo group by owner", base=False)
def metadata_hash(spark: SparkSession, d: str) -> DataFrame:
    return declarations.build_metadata(_comments(spark, d), package_wide=True)


@_query("declaration_metadata", _COMMENTS_SQL + "select 'new' as rev, owner, sha256(string_agg(d, chr(0) order by d)) as hash from c where k % 7 in (0, 1, 2) group by owner", base=False)
def declaration_metadata(spark: SparkSession, d: str) -> DataFrame:
    return declarations.build_metadata(_comments(spark, d), package_wide=False)


_PATTERNS = ("e*/*", "a*", "*/*/p?", "all:b*", "*")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*/(.*)$", 1)
    return em.table(spark, d, "pages").select("page_id", F.lit("web").alias("pkg"), path.alias("file"), F.sha2("html", 256).alias("hash")).where("file <> ''")


_EMBED_SQL = r"""with f as (select page_id, regexp_extract(url, '^[a-z]+://[^/]*/(.*)$', 1) as file, sha256(html) as hash from pages),
  a as (select distinct file, array_to_string(string_split(file, '/')[1:n], '/') as x from (select file, unnest(range(1, len(string_split(file, '/')) + 1)) as n from f where file <> '')),
  p(pattern, r) as (values ('e*/*', '^e[^/]*/[^/]*$'), ('a*', '^a[^/]*$'), ('*/*/p?', '^[^/]*/[^/]*/p[^/]$'), ('all:b*', '^b[^/]*$'), ('*', '^[^/]*$')),
  m as (select distinct pattern, file from a, p where regexp_matches(x, r))
"""


@_query("embed_match", _EMBED_SQL + "select 'web' as pkg, pattern, file from m", base=False)
def embed_match(spark: SparkSession, d: str) -> DataFrame:
    patterns = spark.createDataFrame([("web", p) for p in _PATTERNS], "pkg string, pattern string")
    return inputs.embed_matches(patterns, _paths(spark, d))


@_query("embed_dependencies", _EMBED_SQL + "select distinct 'new' as rev, 'web::var::' || pattern as sym, 'web::embed-file::' || file as dep from m", base=False)
def embed_dependencies(spark: SparkSession, d: str) -> DataFrame:
    declared = spark.createDataFrame([("new", f"web::var::{p}", "web", p) for p in _PATTERNS], "rev string, decl_id string, pkg string, pattern string")
    files = _paths(spark, d).groupBy("pkg", "file").agg(F.max("hash").alias("hash")).withColumn("rev", F.lit("new"))
    return inputs.embed_dependencies(declared, files)[1]


@_query("embed_pattern_split", "select doc_id, unnest(string_split(text, ' ')) as pattern from (select doc_id, 'a* ' || lang || '/x ' || source as text from documents)", base=False)
def embed_pattern_split(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('go:embed "a*" '), "lang", F.lit("/x `"), "source", F.lit("`"))
    return em.table(spark, d, "documents").select("doc_id", F.explode(comments.embed_patterns(text)).alias("pattern"))


_INIT_SQL = """select distinct package_path || '::package-init::$init' as sym, id as dep, rev from symbols where (id like '%::customer::%' and package_path <> 'crm/BUILDING') or id like '%::region::%'
  union select 'geo/nation::package-init::$init', 'geo/region::package-init::$init', rev from (values ('old'), ('new')) r(rev)"""


@_query("init_dependencies", _INIT_SQL)
def init_dependencies(spark: SparkSession, d: str) -> DataFrame:
    s = em.symbols(spark, d)
    kinds = s.withColumn("kind", F.when(F.col("id").contains("::customer::") & (F.col("package_path") != "crm/BUILDING"), "init").otherwise("func"))
    imports = F.when(F.col("path") == "geo/nation", F.array(F.lit("geo/region"), F.lit("elsewhere"))).otherwise(F.array().cast("array<string>"))
    effects = s.where(F.col("id").contains("::region::")).select("rev", "id", "package_path")
    return inputs.initialization(em.packages(spark, d).withColumn("imports", imports), kinds, effects)[1]


@_query("effectful_initializers", "select distinct 'new' as rev, o_orderkey as decl_id from orders join lineitem on l_orderkey = o_orderkey where l_returnflag in ('A', 'R') and l_linestatus = 'F'", base=False)
def effectful_initializers(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", "recv").otherwise("binary")
    literal = F.when(F.col("l_linestatus") != "F", F.lit(1))
    return declarations.effectful_declarations(em.table(spark, d, "lineitem").select(F.lit("new").alias("rev"), F.col("l_orderkey").alias("decl_id"), kind.alias("kind"), literal.alias("enclosing_lit")))


@_query("base_dependencies", "select distinct 'new' as rev, l_orderkey as sym, l_suppkey + 10 as dep from lineitem where l_orderkey <> l_suppkey + 10", base=False)
def base_dependencies(spark: SparkSession, d: str) -> DataFrame:
    line = em.table(spark, d, "lineitem")
    obj = F.concat_ws("/", "l_suppkey")
    uses = line.select(F.lit("new").alias("rev"), F.col("l_orderkey").alias("decl_id"), obj.alias("obj"))
    objects = em.table(spark, d, "supplier").select(F.lit("new").alias("rev"), F.concat_ws("/", "s_suppkey").alias("obj"), (F.col("s_suppkey") + 10).alias("symbol_id"))
    return declarations.base_dependencies(uses, objects)


@_query("content_symbols", "select rev, path || '::package::$content' as id, path as package_path, hash from packages")
def content_symbols(spark: SparkSession, d: str) -> DataFrame:
    return declarations.content_symbols(em.packages(spark, d))


@_query("used_objects", "select distinct 'new' as rev, l_returnflag as pkg, l_partkey as obj from lineitem", base=False)
def used_objects(spark: SparkSession, d: str) -> DataFrame:
    return declarations.used_objects(em.table(spark, d, "lineitem").select(F.lit("new").alias("rev"), F.col("l_returnflag").alias("pkg"), F.col("l_partkey").alias("obj")))


@_query("call_result_used", """with t as (select o_orderkey as call, arg_min(o_custkey + pos, pos) filter (name <> '_') as obj from (
    select o_orderkey, o_custkey, unnest([0, 1]) as pos, unnest([case when o_orderkey % 2 = 0 then '_' else 'x' end, case when o_orderkey % 3 = 0 then '_' else 'y' end]) as name from orders) group by 1)
  select o_orderkey as call, case o_orderkey % 3 when 0 then false when 1 then coalesce(t.obj in (select c_custkey from customer where c_nationkey % 2 = 0), false) else true end as used
  from orders left join t on t.call = o_orderkey""", base=False)
def call_result_used(spark: SparkSession, d: str) -> DataFrame:
    o = em.table(spark, d, "orders")
    k = F.col("o_orderkey")
    calls = o.select(k.alias("call"), F.lit("p").alias("pkg"), F.when(k % 3 == 0, "stmt").when(k % 3 == 1, "assign").otherwise("other").alias("parent_kind"))
    first = F.struct(F.lit(0).alias("pos"), F.when(k % 2 == 0, "_").otherwise("x").alias("name"))
    second = F.struct(F.lit(1).alias("pos"), F.when(k % 3 == 0, "_").otherwise("y").alias("name"))
    targets = o.select(k.alias("call"), "o_custkey", F.explode(F.array(first, second)).alias("t")).select("call", "t.pos", "t.name", (F.col("o_custkey") + F.col("t.pos")).alias("obj"))
    used = em.table(spark, d, "customer").where("c_nationkey % 2 = 0").select(F.lit("p").alias("pkg"), F.col("c_custkey").alias("obj"))
    return declarations.call_results_used(calls, targets, used)


@_query("load_errors_sorted", "select string_agg(n_name, '; ' order by n_name) as message from nation", base=False)
def load_errors_sorted(spark: SparkSession, d: str) -> DataFrame:
    return declarations.load_error(em.table(spark, d, "nation").select(F.col("n_name").alias("message")))


@_query("first_error_by_index", "select arg_min(c_name, c_custkey) as message from customer where c_acctbal < 0", base=False)
def first_error_by_index(spark: SparkSession, d: str) -> DataFrame:
    return declarations.first_error(em.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("message"), F.col("c_custkey").alias("idx")))


# -- value flow ----------------------------------------------------------------
# Parts are types (interfaces where p_size % 5 = 0), orders are expressions whose
# parent is order k // 2, customers are objects, suppliers functions.

_FLOW_SQL = """e as (select o_orderkey as node, o_orderkey // 2 as parent, o_custkey as object, o_orderkey % 7 as kind from orders),
  types as (select p_partkey as t, p_size % 5 = 0 as iface from part),
  bind as (select distinct c_custkey as obj, 1 + c_custkey % 50 as t from customer),
"""


def _expr(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 7 < 3, "paren").otherwise("other")
    return em.table(spark, d, "orders").select(k.alias("node"), F.floor(k / 2).cast("long").alias("parent"), kind.alias("parent_kind"), F.col("o_custkey").alias("object"), (F.lit(1) + k % 40).alias("static_type"))


def _types(spark: SparkSession, d: str) -> DataFrame:
    p = em.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("type_id"), (F.col("p_size") % 5 == 0).alias("is_interface"), F.lit("named").alias("kind"), F.lit(None).cast("long").alias("elem_type_id"))


def _bindings(spark: SparkSession, d: str) -> DataFrame:
    c = em.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("obj"), (F.lit(1) + F.col("c_custkey") % 50).alias("type"))


@_query("expression_types_fallback", "with recursive " + _FLOW_SQL + """named as (select node, t from e join bind on obj = object),
  strong as (select node, t from named union select e.parent, s.t from strong s join e on e.node = s.node and e.kind < 3)
  select node, t as label from strong union select node, 1 + node % 40 from e join types on types.t = 1 + node % 40 and not iface where node not in (select node from strong)""", base=False)
def expression_types_fallback(spark: SparkSession, d: str) -> DataFrame:
    expr = _expr(spark, d)
    none = spark.createDataFrame([], "node long, inner long, type long")
    fits = spark.createDataFrame([], "from_type long, to_type long")
    return valueflow.expression_types(expr.select("node", "object", "static_type"), expr, _bindings(spark, d), _types(spark, d), none, fits)


@_query("type_bindings_two_pass", """with b as (select distinct c_custkey as obj, 1 + c_custkey % 50 as t from customer),
  s as (select c_custkey as obj, c_custkey - 1 as f from customer), one as (select * from b union select s.obj, t from s join b on b.obj = s.f)
  select obj, t as type from (select * from one union select s.obj, t from s join one on one.obj = s.f)""", base=False)
def type_bindings_two_pass(spark: SparkSession, d: str) -> DataFrame:
    stores = em.table(spark, d, "customer").select(F.col("c_custkey").alias("obj"), (F.col("c_custkey") - 1).alias("from_obj"))
    return valueflow.two_pass_bindings(stores, _bindings(spark, d))


@_query("accepted_bindings", """with t as (select p_partkey as t, p_size % 5 = 0 as iface, case when p_partkey % 4 = 0 then p_partkey // 2 else p_partkey end as own from part),
  b as (select distinct o_custkey as obj, l_partkey as type from orders join lineitem on l_orderkey = o_orderkey), fits as (select distinct l_partkey as type, l_suppkey as to_type from lineitem)
  select distinct b.obj, b.type from b join customer on c_custkey = b.obj join t on t.t = 1 + c_nationkey join t i on i.t = t.own and i.iface join fits on fits.type = b.type and fits.to_type = i.t""", base=False)
def accepted_bindings(spark: SparkSession, d: str) -> DataFrame:
    k, line = F.col("type_id"), em.table(spark, d, "lineitem")
    t = _types(spark, d).withColumn("kind", F.when(k % 4 == 0, "slice").otherwise("named")).withColumn("elem_type_id", F.when(k % 4 == 0, F.floor(k / 2).cast("long")))
    bound = em.table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("obj"), F.col("l_partkey").alias("type")).distinct()
    targets = em.table(spark, d, "customer").select(F.col("c_custkey").alias("obj"), (F.lit(1) + F.col("c_nationkey")).alias("type_id"))
    return valueflow.accepted(bound, targets, t, _fits(spark, d))


def _fits(spark: SparkSession, d: str) -> DataFrame:
    """Which type is assignable to which: parts and the suppliers they came from."""
    return em.table(spark, d, "lineitem").select(F.col("l_partkey").alias("from_type"), F.col("l_suppkey").alias("to_type")).distinct()


@_query("field_bindings", "with recursive " + _FLOW_SQL + """fits as (select distinct l_partkey as t, l_suppkey as i from lineitem join types on types.t = l_suppkey and iface),
  st as (select distinct l_suppkey as field, l_orderkey as node from lineitem), rd as (select o_orderkey as node, 1 + o_custkey % 10 as field from orders where o_orderstatus = 'O'),
  named as (select node, t from e join bind on obj = object),
  s1 as (select node, t from named union select e.parent, s.t from s1 s join e on e.node = s.node and e.kind < 3),
  f1 as (select distinct st.field, s1.t from st join s1 using (node) join fits on fits.t = s1.t and fits.i = st.field),
  n2 as (select node, t from named union select rd.node, f1.t from rd join f1 using (field)),
  s2 as (select node, t from n2 union select e.parent, s.t from s2 s join e on e.node = s.node and e.kind < 3)
  select field, t as type from f1 union select st.field, s2.t from st join s2 using (node) join fits on fits.t = s2.t and fits.i = st.field""", base=False)
def field_bindings(spark: SparkSession, d: str) -> DataFrame:
    expr = _expr(spark, d)
    stores = em.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("field"), F.col("l_suppkey").alias("type_id"), F.col("l_orderkey").alias("node")).distinct()
    reads = em.table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("node"), (F.lit(1) + F.col("o_custkey") % 10).alias("field"))
    none = spark.createDataFrame([], "node long, inner long, type long")
    return valueflow.field_bindings(stores, reads, expr.select("node", "object", "static_type"), expr, _bindings(spark, d), _types(spark, d), none, _fits(spark, d))


def _returns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, their targets and returns: open orders call the suppliers of their lines."""
    k = F.col("o_orderkey")
    calls = em.table(spark, d, "orders").where("o_orderstatus = 'O'").select(k.alias("call"), k.alias("callee"), (k % 2).alias("result"))
    targets = em.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("label")).distinct()
    returns = em.table(spark, d, "supplier").select(F.col("s_suppkey").alias("function"), (F.col("s_nationkey") % 2).alias("result"), (F.col("s_suppkey") * 3).alias("node"))
    return calls, targets, returns


@_query("call_result_types", "with recursive " + _FLOW_SQL + """ways as (select node as src, parent as dst from e where kind < 3
    union select s_suppkey * 3, o_orderkey from orders join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey % 2 = o_orderkey % 2 where o_orderstatus = 'O'),
  strong as (select node, t from e join bind on obj = object union select dst, s.t from strong s join ways on src = s.node)
  select node, t as label from strong union select node, 1 + node % 40 from e join types on types.t = 1 + node % 40 and not iface where node not in (select node from strong)""", base=False)
def call_result_types(spark: SparkSession, d: str) -> DataFrame:
    expr = _expr(spark, d)
    none = spark.createDataFrame([], "node long, inner long, type long")
    fits = spark.createDataFrame([], "from_type long, to_type long")
    ways = valueflow.result_edges(*_returns(spark, d))
    return valueflow.expression_types(expr.select("node", "object", "static_type"), expr, _bindings(spark, d), _types(spark, d), none, fits, ways)


@_query("function_targets", "with recursive " + _FLOW_SQL + """base as (select node, 'lit' || node as f from e where node % 11 = 0 union select node, 'fn' || s_suppkey from e join supplier on s_suppkey = object union select node, 'st' || (c_custkey % 13) from e join customer on c_custkey = object),
  r as (select node, f from base union select e.parent, r.f from r join e on e.node = r.node and e.kind < 3) select node, f as label from r""", base=False)
def function_targets(spark: SparkSession, d: str) -> DataFrame:
    expr, literals, named, stores = _function_facts(spark, d)
    return valueflow.function_targets(expr.select("node", "object"), expr, literals, named, stores)


def _function_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Expressions, literals, named functions and stores: every customer holds a function."""
    expr = _expr(spark, d)
    literals = expr.where("node % 11 = 0").select("node", F.concat(F.lit("lit"), F.col("node").cast("string")).alias("label"))
    named = em.table(spark, d, "supplier").select(F.col("s_suppkey").alias("obj"), F.concat(F.lit("fn"), F.col("s_suppkey").cast("string")).alias("function"))
    stores = em.table(spark, d, "customer").select(F.col("c_custkey").alias("obj"), F.concat(F.lit("st"), (F.col("c_custkey") % 13).cast("string")).alias("target"))
    return expr, literals, named, stores


@_query("function_targets_returns")
def function_targets_returns(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: what a call returns depends on what it calls, found on the way."""
    expr, literals, named, stores = _function_facts(spark, d)
    calls, _, returns = _returns(spark, d)
    returns = returns.withColumn("function", F.concat(F.lit("fn"), F.col("function").cast("string")))
    return valueflow.function_targets(expr.select("node", "object"), expr, literals, named, stores, calls, returns)


@_query("conversion_passthrough", "with recursive " + _FLOW_SQL + """r as (select node, object as label from e where node % 10 = 0 union select e.parent, r.label from r join e on e.node = r.node and e.kind < 3) select node, label from r""", base=False)
def conversion_passthrough(spark: SparkSession, d: str) -> DataFrame:
    expr = _expr(spark, d).withColumn("parent_kind", F.when(F.col("parent_kind") == "paren", "convert").otherwise("call"))
    return valueflow.carried(expr, expr.where("node % 10 = 0").select("node", F.col("object").alias("label")))


@_query("indexed_targets_known_key", """select distinct o_orderkey as node, c_name as target from orders join customer on c_nationkey = o_custkey % 25
  where o_orderkey % 3 = 0 or c_custkey % 2 = 0 or o_orderkey % 5 = c_custkey % 5""", base=False)
def indexed_targets_known_key(spark: SparkSession, d: str) -> DataFrame:
    o, c = em.table(spark, d, "orders"), em.table(spark, d, "customer")
    asked = o.select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 25).cast("int").alias("obj"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 5).alias("key"))
    stored = c.select(F.col("c_nationkey").alias("obj"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_custkey") % 5).alias("key"), F.col("c_name").alias("target"))
    return valueflow.indexed_targets(asked, stored)


@_query("positional_args_variadic", """select o_orderkey as call, l_linenumber as node, case when s.s_suppkey % 2 = 0 then least(l_linenumber - 1, 2) else l_linenumber - 1 end as param
  from (select distinct l_orderkey as o_orderkey, l_suppkey, l_linenumber from lineitem) join supplier s on s_suppkey = l_suppkey where s.s_suppkey % 2 = 0 or l_linenumber <= 3""", base=False)
def positional_args_variadic(spark: SparkSession, d: str) -> DataFrame:
    line = em.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").distinct()
    args = line.select(F.col("l_orderkey").alias("call"), F.col("l_suppkey").alias("function"), F.col("l_linenumber").alias("pos"), F.col("l_linenumber").alias("node"), F.lit(1).alias("shift"))
    params = em.table(spark, d, "supplier").select(F.col("s_suppkey").alias("function"), F.explode(F.array(*map(F.lit, range(3)))).alias("pos")).select("function", "pos", F.col("pos").alias("param"), F.lit(3).alias("n"), (F.col("function") % 2 == 0).alias("variadic"))
    return valueflow.call_bindings(args, params).select("call", "node", "param")


@_query("function_holding_types", """with recursive el as (select p_partkey as t, p_partkey // 2 as x, p_size % 3 as via from part), d as (select p_partkey as t from part where p_partkey % 17 = 0
  union select el.t from d join el on el.x = d.t and via > 0) select t as type_id from d union select el.t from el join d on el.x = d.t where via = 0""", base=False)
def function_holding_types(spark: SparkSession, d: str) -> DataFrame:
    p = em.table(spark, d, "part")
    types = p.select(F.col("p_partkey").alias("type_id"), F.when(F.col("p_partkey") % 17 == 0, "signature").otherwise("named").alias("kind"))
    elements = p.select(F.col("p_partkey").alias("type_id"), F.floor(F.col("p_partkey") / 2).cast("long").alias("elem_type_id"), F.when(F.col("p_size") % 3 == 0, "field").otherwise("elem").alias("via"))
    return valueflow.holds_functions(types, elements)


def _methods(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Interface methods, type methods, objects: nations' names as methods."""
    nat = em.table(spark, d, "nation")
    asked = nat.select((F.col("n_regionkey")).alias("type_id"), F.col("n_name").alias("name"), F.lit("").alias("pkg_scope"))
    have = em.table(spark, d, "supplier").join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("type_id"), F.col("n_name").alias("name"), F.lit("").alias("pkg_scope"), F.col("s_name").alias("method_obj"))
    objects = em.table(spark, d, "supplier").select(F.col("s_name").alias("obj"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("m::"), "s_name")).alias("symbol_id"))
    return asked, have, objects


_SELECT_SQL = """with c as (select distinct l_orderkey as o, l_suppkey as t, l_linenumber % 5 as i from lineitem),
  hit as (select distinct o, i, 'm::' || s_name as dep, s_nationkey from c join supplier on s_suppkey = t join nation on n_nationkey = s_nationkey and n_regionkey = i where s_suppkey % 4 <> 0)
"""


@_query("interface_selection", _SELECT_SQL + """, g as (select o, i, list(distinct dep order by dep) as deps from hit group by o, i),
  d as (select o, 'o' || o || '::interface-selection::' || i || '::' || sha256('p' || chr(0) || array_to_string(deps, chr(0))) as id, deps from g)
  select 'new' as rev, 'o' || o as sym, id as dep from d union select 'new', id, unnest(deps) from d""", base=False)
def interface_selection(spark: SparkSession, d: str) -> DataFrame:
    asked, have, objects = _methods(spark, d)
    line = em.table(spark, d, "lineitem")
    candidates = line.select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("label"), (F.col("l_linenumber") % 5).alias("interface")).distinct()
    found = valueflow.concrete_methods(candidates, asked, have, objects)
    rows = found.select(F.lit("new").alias("rev"), F.concat(F.lit("o"), F.col("o").cast("string")).alias("decl_id"), F.col("interface").alias("idx"), F.lit("p").alias("pkg"), "dep")
    return valueflow.dispatch_symbols(rows, "interface-selection")[1].distinct()


@_query("interface_field_dispatch", """select distinct 'new' as rev, l_orderkey as decl_id, l_linenumber as idx, 'p' || n_regionkey as pkg, 'm::' || s_name as dep
  from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey where s_suppkey % 4 <> 0 and l_linenumber % 5 = n_regionkey""", base=False)
def interface_field_dispatch(spark: SparkSession, d: str) -> DataFrame:
    _, have, objects = _methods(spark, d)
    line = em.table(spark, d, "lineitem")
    stored = line.select(F.lit("new").alias("rev"), F.col("l_orderkey").alias("decl_id"), F.col("l_linenumber").alias("idx"), (F.col("l_linenumber") % 5).alias("field"), F.col("l_suppkey").alias("label"))
    uses = em.table(spark, d, "nation").select(F.col("n_regionkey").alias("field"), F.col("n_name").alias("name"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("pkg"))
    return valueflow.field_dispatch(stored, uses, have, objects)


@_query("dependency_fallback", """with c as (select distinct l_orderkey as call, l_suppkey as label from lineitem), m as (select s_suppkey as label, unnest([s_nationkey, s_nationkey + 1]) as dep from supplier),
  t as (select distinct o_orderkey as call, (o_custkey % 25)::int as dep from orders)
  select call, label, dep from c join m using (label) where not exists (select 1 from m n join t on t.call = c.call and t.dep = n.dep where n.label = c.label)""", base=False)
def dependency_fallback(spark: SparkSession, d: str) -> DataFrame:
    calls = em.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("call"), F.col("l_suppkey").alias("label")).distinct()
    methods = em.table(spark, d, "supplier").select(F.col("s_suppkey").alias("label"), F.explode(F.array("s_nationkey", F.col("s_nationkey") + 1)).alias("dep"))
    traced = em.table(spark, d, "orders").select(F.col("o_orderkey").alias("call"), (F.col("o_custkey") % 25).cast("int").alias("dep"))
    return valueflow.dependency_fallback(calls, traced, methods)


@_query("interface_trace", """with recursive b as (select p_partkey as f, p_size % 6 as name, p_partkey % 3 > 0 as keeps from part), m as (select s_suppkey as t, s_nationkey % 6 as name, 10 + s_suppkey % 40 as method from supplier),
  s as (select o_orderkey as root, 1 + o_custkey % 60 as f, 1 + o_custkey % 10 as t, '' as pkg from orders
    union select s.root, m.method, s.t, unnest(['p' || (m.method % 7), s.pkg]) from s join b on b.f = s.f join m on m.t = s.t and m.name = b.name where b.keeps)
  select distinct root, pkg, method from (select s.root, m.method, unnest(['p' || (m.method % 7), s.pkg]) as pkg from s join b on b.f = s.f join m on m.t = s.t and m.name = b.name) where pkg <> ''""", base=False)
def interface_trace(spark: SparkSession, d: str) -> DataFrame:
    o, p, s = (em.table(spark, d, t) for t in ("orders", "part", "supplier"))
    roots = o.select(F.col("o_orderkey").alias("root"), (F.lit(1) + F.col("o_custkey") % 60).alias("function"), (F.lit(1) + F.col("o_custkey") % 10).alias("type"))
    calls = p.select(F.col("p_partkey").alias("function"), (F.col("p_size") % 6).alias("name"), (F.col("p_partkey") % 3 > 0).alias("keeps"))
    methods = s.select(F.col("s_suppkey").alias("type"), (F.col("s_nationkey") % 6).alias("name"), (F.lit(10) + F.col("s_suppkey") % 40).alias("method"))
    owners = methods.select("method").distinct().select("method", F.concat(F.lit("p"), (F.col("method") % 7).cast("string")).alias("pkg"))
    return valueflow.trace_calls(roots, calls, methods, owners)
