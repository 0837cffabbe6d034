"""The relational test tables as two snapshots of a system.

Every row of six tables is a symbol; its key decides in which revision it
exists and whether it was altered, and foreign keys are its dependencies.
``BASE_SQL`` is the same in SQL, as common table expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, package_path, v, k): one row per symbol of either revision."""

    def one(name: str, prefix: str, key: str, package: Column, value: str) -> DataFrame:
        return table(spark, sf_dir, name).select(_id(prefix, key).alias("id"), package.alias("package_path"), F.col(value).alias("v"), F.col(key).cast("long").alias("k"))

    return _union(
        one("region", "geo::region::", "r_regionkey", F.lit("geo/region"), "r_name"),
        one("nation", "geo::nation::", "n_nationkey", F.lit("geo/nation"), "n_name"),
        one("supplier", "supply::supplier::", "s_suppkey", F.concat(F.lit("supply/n"), F.col("s_nationkey").cast("string")), "s_name"),
        one("customer", "crm::customer::", "c_custkey", F.concat(F.lit("crm/"), F.col("c_mktsegment")), "c_name"),
        one("part", "catalog::part::", "p_partkey", F.concat(F.lit("catalog/"), F.col("p_brand")), "p_name"),
        one("orders", "sales::order::", "o_orderkey", F.concat(F.lit("sales/"), F.col("o_orderpriority")), "o_orderstatus"),
    )


def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, id): a dispatch symbol for each type of event."""
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.select("event_type", F.concat(F.lit("events::func::"), "event_type", F.lit("::interface-trace::0::"), F.sha2("event_type", 256)).alias("id"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rev, id, package_path, hash)."""
    k = F.col("k")
    value = F.when(k % 211 == 5, F.concat("v", F.lit("*"))).otherwise(F.col("v"))
    old = F.when(k % 103 != 9, F.struct(F.lit("old").alias("rev"), F.sha2("v", 256).alias("hash")))
    new = F.when(k % 101 != 7, F.struct(F.lit("new").alias("rev"), F.sha2(value, 256).alias("hash")))
    plain = rows(spark, sf_dir).select("id", "package_path", F.explode(F.array(old, new)).alias("s")).where("s is not null").select("s.rev", "id", "package_path", "s.hash")
    revs = F.explode(F.array(*[F.struct(F.lit(r).alias("rev"), F.sha2(F.concat("event_type", F.lit(r)), 256).alias("hash")) for r in ("old", "new")]))
    extra = dispatch(spark, sf_dir).select("id", F.concat(F.lit("events/"), "event_type").alias("package_path"), revs.alias("s"))
    return plain.unionByName(extra.select("s.rev", "id", "package_path", "s.hash"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sym, dep), whatever the revision."""

    def one(name: str, sym: Column, dep: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(sym.alias("sym"), dep.alias("dep"))

    line = table(spark, sf_dir, "lineitem")
    event = dispatch(spark, sf_dir).select(F.col("id").alias("sym"), F.concat(F.lit("geo::region::"), (F.length("event_type") % 5).cast("string")).alias("dep"))
    chosen = table(spark, sf_dir, "orders").where("o_orderkey % 97 = 0").select(_id("sales::order::", "o_orderkey").alias("sym"))
    return _union(
        one("nation", _id("geo::nation::", "n_nationkey"), _id("geo::region::", "n_regionkey")),
        one("supplier", _id("supply::supplier::", "s_suppkey"), _id("geo::nation::", "s_nationkey")),
        one("customer", _id("crm::customer::", "c_custkey"), _id("geo::nation::", "c_nationkey")),
        one("orders", _id("sales::order::", "o_orderkey"), _id("crm::customer::", "o_custkey")),
        line.select(_id("catalog::part::", "l_partkey").alias("sym"), _id("supply::supplier::", "l_suppkey").alias("dep")).distinct(),
        line.select(_id("sales::order::", "l_orderkey").alias("sym"), _id("catalog::part::", "l_partkey").alias("dep")).distinct(),
        event,
        chosen.crossJoin(F.broadcast(dispatch(spark, sf_dir).where("event_type like 'c%'").select(F.col("id").alias("dep")))),
    )


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rev, sym, dep) of the symbols each revision has."""
    have = symbols(spark, sf_dir).select("rev", F.col("id").alias("sym"))
    return uses(spark, sf_dir).join(have, "sym").select("rev", "sym", "dep")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rev, path, name, relative_path, hash, imports)."""
    path = F.col("package_path")
    grouped = symbols(spark, sf_dir).groupBy("rev", path.alias("path")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), "\u0000"), 256).alias("hash"))
    name = F.element_at(F.split("path", "/"), -1)
    return grouped.select("rev", "path", name.alias("name"), F.col("path").alias("relative_path"), "hash", F.array().cast("array<string>").alias("imports"))


BASE_SQL = r"""
src as materialized (
  select 'geo::region::' || r_regionkey as id, 'geo/region' as package_path, r_name as v, r_regionkey::bigint as k from region
  union all select 'geo::nation::' || n_nationkey, 'geo/nation', n_name, n_nationkey from nation
  union all select 'supply::supplier::' || s_suppkey, 'supply/n' || s_nationkey, s_name, s_suppkey from supplier
  union all select 'crm::customer::' || c_custkey, 'crm/' || c_mktsegment, c_name, c_custkey from customer
  union all select 'catalog::part::' || p_partkey, 'catalog/' || p_brand, p_name, p_partkey from part
  union all select 'sales::order::' || o_orderkey, 'sales/' || o_orderpriority, o_orderstatus, o_orderkey from orders),
disp as materialized (select event_type, 'events::func::' || event_type || '::interface-trace::0::' || sha256(event_type) as id from (select distinct event_type from events)),
symbols as materialized (
  select 'old' as rev, id, package_path, sha256(v) as hash from src where k % 103 <> 9
  union all select 'new', id, package_path, sha256(case when k % 211 = 5 then v || '*' else v end) from src where k % 101 <> 7
  union all select rev, id, 'events/' || event_type, sha256(event_type || rev) from disp, (values ('old'), ('new')) r(rev)),
uses as materialized (
  select 'geo::nation::' || n_nationkey as sym, 'geo::region::' || n_regionkey as dep from nation
  union all select 'supply::supplier::' || s_suppkey, 'geo::nation::' || s_nationkey from supplier
  union all select 'crm::customer::' || c_custkey, 'geo::nation::' || c_nationkey from customer
  union all select 'sales::order::' || o_orderkey, 'crm::customer::' || o_custkey from orders
  union all select distinct 'catalog::part::' || l_partkey, 'supply::supplier::' || l_suppkey from lineitem
  union all select distinct 'sales::order::' || l_orderkey, 'catalog::part::' || l_partkey from lineitem
  union all select id, 'geo::region::' || (length(event_type) % 5) from disp
  union all select 'sales::order::' || o_orderkey, d.id from orders, disp d where o_orderkey % 97 = 0 and event_type like 'c%'),
deps as materialized (select s.rev, u.sym, u.dep from uses u join symbols s on s.id = u.sym),
changed as materialized (
  select coalesce(o.id, n.id) as id, case when o.id is null then 'added' when n.id is null then 'removed' else 'modified' end as kind
  from (select * from symbols where rev = 'old') o full join (select * from symbols where rev = 'new') n on o.id = n.id
  where o.hash is distinct from n.hash and not regexp_matches(coalesce(o.id, n.id), '::(interface-trace|interface-selection|interface-field|dependency-interface)::')),
edges as materialized (select distinct d.dep as src, d.sym as dst from deps d join symbols s on s.rev = d.rev and s.id = d.dep),
affected as (select id as node from changed union select e.dst from affected a join edges e on e.src = a.node),
owner as materialized (select id, coalesce(max(package_path) filter (rev = 'new'), max(package_path) filter (rev = 'old')) as package_path from symbols group by id),
packages as materialized (
  select rev, package_path as path, split_part(package_path, '/', -1) as name, package_path as relative_path,
    sha256(string_agg(hash, chr(0) order by hash)) as hash from symbols group by rev, package_path)
"""
