"""One query per operator of the dialect, over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import datetimes as dt
from brindle.functions import dialect as d
from brindle.functions import jsonfn, mathfn, strings
from brindle.operators import aggregates as agg
from brindle.operators import dml, joins, recursion, search, setops, spatial, windows
from brindle.plans import frontend, statements
from brindle.session import register, table
from brindle.sources import catalog, tvf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
T = Callable[[str], DataFrame]
c = F.col


def q(sql: str | None):
    """Register a query that gets a function from table names to frames; its name is the function's."""

    def add(fn: Callable[[SparkSession, T], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(spark, lambda name: table(spark, sf_dir, name))
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def same(name: str, text: str, views: tuple[str, ...], duck: str | None = None) -> None:
    """A query given as SQL text that both engines read, through the dialect's front door."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, views)
        return frontend.sql(spark, text)

    QUERIES[name], SQL[name] = run, duck or text


# --- scans, projection, filter --------------------------------------------------------------------------------------


@q("select n_name, sum_rev as revenue from (select n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) as sum_rev from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on n_nationkey = c_nationkey where o_orderdate >= timestamp '1996-01-01' group by n_name) order by revenue desc, n_name limit 10")
def flagship_revenue(spark, t):
    line = t("lineitem").select("l_orderkey", (c("l_extendedprice") * (1 - c("l_discount"))).alias("rev"))
    o = t("orders").filter(c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    per_customer = line.join(o, c("l_orderkey") == c("o_orderkey")).groupBy("o_custkey").agg(F.sum("rev").alias("rev"))
    named = t("customer").select("c_custkey", "c_nationkey").join(t("nation").select("n_nationkey", "n_name"), c("c_nationkey") == c("n_nationkey"))
    return per_customer.join(named, c("o_custkey") == c("c_custkey")).groupBy("n_name").agg(F.round(F.sum("rev"), 0).alias("revenue")).orderBy(F.desc("revenue"), "n_name").limit(10)


@q("select l_orderkey, l_linenumber, l_quantity * 2 as double_qty, l_returnflag as flag from lineitem where l_quantity > 30 and l_shipdate < timestamp '1997-01-01'")
def scan_filter_project(spark, t):
    return t("lineitem").filter((c("l_quantity") > 30) & (c("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber", (c("l_quantity") * 2).alias("double_qty"), c("l_returnflag").alias("flag"))


@q("select 1 + 2 as three, 'a' || 'b' as ab, 255 as hex_value, cast(null as bigint) as nothing, 1 as yes")
def select_without_from(spark, t):
    return frontend.sql(spark, "select 1 + 2 as three, 'a' || 'b' as ab, 0xFF as hex_value, cast(null as bigint) as nothing, cast(true as int) as yes")


@q("select * from (values (1, 'one'), (2, 'two'), (3, null)) as v(k, name)")
def values_source(spark, t):
    return spark.sql("select * from values (1, 'one'), (2, 'two'), (3, null) as v(k, name)")


same("parameters", "select p_partkey, p_size from part where p_size between 10 and 20 and p_brand = 'Brand#13'", ("part",))


def _parameters(spark, sf_dir):
    register(spark, sf_dir, ("part",))
    return frontend.sql(spark, "select p_partkey, p_size from part where p_size between :low and :high and p_brand = :brand", {"low": 10, "high": 20, "brand": "Brand#13"})


QUERIES["parameters"] = _parameters


@q("select l_orderkey, l_linenumber, cast(l_orderkey // nullif(l_linenumber - 1, 0) as bigint) as whole, l_orderkey % nullif(l_linenumber - 1, 0) as rest, l_quantity / nullif(l_tax, 0) as quotient, cast(l_orderkey as double) + l_linenumber as plus, -l_orderkey as minus, ~l_orderkey as inverted from lineitem")
def arithmetic(spark, t):
    n = c("l_linenumber").cast("bigint") - 1
    return t("lineitem").select("l_orderkey", "l_linenumber", d.divide(c("l_orderkey"), n, integers=True).alias("whole"), d.modulo(c("l_orderkey"), n).alias("rest"), d.divide(c("l_quantity"), c("l_tax")).alias("quotient"), d.add(c("l_orderkey"), c("l_linenumber").cast("bigint")).alias("plus"), (-c("l_orderkey")).alias("minus"), F.bitwise_not(c("l_orderkey")).alias("inverted"))


@q("select 9.223372036854775807e18 + 1 as sum_over, 9.223372036854775807e18 * 2 as product_over, -9.223372036854775807e18 - 10 as difference_over")
def arithmetic_overflow(spark, t):
    big = F.lit(2**63 - 1)
    one = spark.range(1)
    return one.select(d.add(big, F.lit(1).cast("bigint")).alias("sum_over"), d.multiply(big, F.lit(2).cast("bigint")).alias("product_over"), d.subtract(-big, F.lit(10).cast("bigint")).alias("difference_over"))


@q("select o_orderkey, o_orderkey & 255 as low, o_orderkey | 1 as odd, cast(case when o_custkey % 70 >= 64 then 0 when o_custkey % 70 = 63 then (o_orderkey % 2) * -808 else cast((cast(o_orderkey % 2 as hugeint) << cast(o_custkey % 70 as int)) & 18446744073709551615 as hugeint) % 1000 end as bigint) as shifted, o_orderkey >> cast(least(o_custkey % 70, 63) as int) as halved from orders")
def bit_operations(spark, t):
    n = c("o_custkey") % 70
    return t("orders").select("o_orderkey", c("o_orderkey").bitwiseAND(255).alias("low"), c("o_orderkey").bitwiseOR(1).alias("odd"), (d.shift_left(c("o_orderkey") % 2, n) % 1000).alias("shifted"), d.shift_right(c("o_orderkey"), n).alias("halved"))


@q("select c_custkey, cast(c_acctbal is not distinct from nullif(c_acctbal, c_acctbal) as bigint) as never, cast(nullif(c_nationkey, 3) is null as bigint) as is_null, cast(nullif(c_nationkey, 3) in (1, 2, 5) as bigint) as in_list, cast(c_acctbal not between 0 and 5000 as bigint) as outside, cast(c_nationkey = 3 or c_acctbal > 0 as bigint) as either from customer")
def predicates(spark, t):
    n = F.nullif(c("c_nationkey"), F.lit(3))
    return t("customer").select("c_custkey", d.flag(d.same(c("c_acctbal"), F.nullif(c("c_acctbal"), c("c_acctbal")))).alias("never"), d.flag(n.isNull()).alias("is_null"), d.flag(n.isin(1, 2, 5)).alias("in_list"), d.flag(~c("c_acctbal").between(0, 5000)).alias("outside"), d.flag((c("c_nationkey") == 3) | (c("c_acctbal") > 0)).alias("either"))


@q("select p_partkey, cast(lower(p_name) like '%a_e%' as bigint) as liked, cast(p_type glob '*[A-M]*' as bigint) as globbed, cast(regexp_matches(p_brand, '1[0-3]$') as bigint) as matched, cast(p_brand like 'Brand!#%' escape '!' as bigint) as escaped from part")
def like_glob_regexp(spark, t):
    return t("part").select("p_partkey", d.flag(d.like(c("p_name"), "%A_E%")).alias("liked"), d.flag(d.glob(c("p_type"), "*[A-M]*")).alias("globbed"), d.flag(c("p_brand").rlike("1[0-3]$")).alias("matched"), d.flag(d.like(c("p_brand"), "brand!#%", "!")).alias("escaped"))


@q("select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' end as simple, case when o_totalprice > 300000 then 3 when o_totalprice > 100000 then 2 else 1 end as searched from orders")
def case_expressions(spark, t):
    s, p = c("o_orderstatus"), c("o_totalprice")
    return t("orders").select("o_orderkey", F.when(s == "F", "done").when(s == "O", "open").alias("simple"), F.when(p > 300000, 3).when(p > 100000, 2).otherwise(1).alias("searched"))


@q("select l_orderkey, l_linenumber, cast(trunc(l_extendedprice) as bigint) as whole, cast(l_orderkey as varchar) as as_text, coalesce(try_cast(regexp_extract(l_shipmode_like, '^[0-9]+') as bigint), 0) as prefix, case when l_quantity = trunc(l_quantity) then cast(cast(l_quantity as bigint) as varchar) || '.0' end as real_text from (select *, cast(l_linenumber as varchar) || 'x' as l_shipmode_like from lineitem)")
def casts(spark, t):
    return t("lineitem").select("l_orderkey", "l_linenumber", d.cast(c("l_extendedprice"), "BIGINT", "real").alias("whole"), d.cast(c("l_orderkey"), "VARCHAR(10)", "integer").alias("as_text"), d.cast(F.concat(c("l_linenumber").cast("string"), F.lit("x")), "INT", "text").alias("prefix"), d.cast(c("l_quantity"), "TEXT", "real").alias("real_text"))


@q("select count(distinct lower(c_mktsegment)) as folded, count(distinct rtrim(c_mktsegment || '  ')) as trimmed, count(*) filter (where lower(c_mktsegment) = 'building') as building from customer")
def collations(spark, t):
    s = c("c_mktsegment")
    return t("customer").agg(F.count_distinct(d.collate(F.upper(s), "NOCASE")).alias("folded"), F.count_distinct(d.collate(F.concat(s, F.lit("  ")), "RTRIM")).alias("trimmed"), F.count(F.when(d.collate(s, "NOCASE") == "building", 1)).alias("building"))


same("distinct_rows", "select distinct o_orderstatus, o_orderpriority from orders", ("orders",))
same("quoted_names", 'select "n_name" as "the name", [n_regionkey] as region from "nation" where [n_regionkey] == 2', ("nation",), 'select n_name as "the name", n_regionkey as region from nation where n_regionkey = 2')
same("dialect_postfix", "select count(*) as n from orders where nullif(o_orderstatus, 'F') notnull and o_orderpriority glob '1*'", ("orders",), "select count(*) as n from orders where nullif(o_orderstatus, 'F') is not null and o_orderpriority glob '1*'")

# --- joins ----------------------------------------------------------------------------------------------------------

same("join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 200000", ("orders", "customer"))
same("join_comma", "select n_name, r_name from nation, region where n_regionkey = r_regionkey", ("nation", "region"))
same("join_cross", "select r1.r_name as a, r2.r_name as b from region r1 cross join region r2", ("region",))
same("join_left", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 250000", ("customer", "orders"))
same("join_left_ordered", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey order by c_custkey nulls first, o_orderkey nulls first", ("customer", "orders"))
same("join_right", "select c_custkey, o_orderkey from orders right join customer on c_custkey = o_custkey", ("customer", "orders"))
same("join_right_not_first", "select r_name, n_name, s_suppkey from region join nation on n_regionkey = r_regionkey right join supplier on s_nationkey = n_nationkey and r_name = 'ASIA'", ("region", "nation", "supplier"))
same("join_full", "select a.l as l, b.r as r from (select p_partkey as l from part where p_size < 20) a full join (select p_partkey as r from part where p_size > 10) b on a.l = b.r", ("part",))
same("join_self", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", ("nation",))
same("join_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')", ("customer", "orders"))
same("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)", ("customer", "orders"))
same("join_not_in", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)", ("customer", "orders"))
same("join_not_in_null", "select c_custkey from customer where c_custkey not in (select nullif(o_custkey, 1) from orders where o_custkey = 1 or o_custkey = 2)", ("customer", "orders"))
same("join_aggregate", "select n_name, count(*) as n, round(avg(s_acctbal), 4) as mean from supplier join nation on s_nationkey = n_nationkey group by n_name", ("supplier", "nation"))
same("join_derived", "select n_name, k from nation join (select c_nationkey, count(*) as k from customer group by c_nationkey) x on n_nationkey = x.c_nationkey", ("nation", "customer"))


@q("select a.n_nationkey, a.n_name, b.n_nationkey as r_nationkey, b.label from nation a join (select n_nationkey, n_name, 'x' || n_regionkey as label from nation where n_regionkey < 3) b on a.n_nationkey = b.n_nationkey and a.n_name = b.n_name")
def join_natural(spark, t):
    a = t("nation").select("n_nationkey", "n_name")
    b = t("nation").filter("n_regionkey < 3").select("n_nationkey", "n_name", F.concat(F.lit("x"), c("n_regionkey")).alias("label"))
    out = joins.natural(a, b)
    return out.select(a["n_nationkey"], a["n_name"], b["n_nationkey"].alias("r_nationkey"), b["label"])


@q("select o.o_orderkey, l.l_linenumber from orders o join (select l_orderkey as o_orderkey, l_linenumber from lineitem where l_quantity > 45) l using (o_orderkey)")
def join_using(spark, t):
    o = t("orders").select("o_orderkey")
    line = t("lineitem").filter("l_quantity > 45").select(c("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return joins.using(o, line, ["o_orderkey"]).select(o["o_orderkey"], line["l_linenumber"])


@q("select p_partkey, s_suppkey from part join supplier on p_retailprice between s_acctbal - 5 and s_acctbal + 5")
def join_range(spark, t):
    s = t("supplier").select("s_suppkey", (c("s_acctbal") - 5).alias("low"), (c("s_acctbal") + 5).alias("high"))
    return joins.banded(t("part").select("p_partkey", "p_retailprice"), s, "p_retailprice", "low", "high", 10.0, ["p_partkey", "s_suppkey"])


# --- aggregation ----------------------------------------------------------------------------------------------------


@q("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 0) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '2001-09-02' group by all")
def pricing_summary(spark, t):
    return t("lineitem").filter(c("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 0).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


same("agg_ungrouped_empty", "select count(*) as n, sum(o_totalprice) as s, min(o_orderkey) as lo, max(o_orderkey) as hi, avg(o_totalprice) as a from orders where o_orderkey < 0", ("orders",))
same("agg_expressions", "select o_orderpriority, min(o_totalprice * 2) as lo, max(o_custkey + 1) as hi, cast(sum(o_custkey) as bigint) as s, count(nullif(o_orderstatus, 'F')) as not_f, round(sum(o_totalprice) / count(*), 2) as ratio from orders group by o_orderpriority", ("orders",))
same("agg_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15 and max(o_totalprice) > 1000", ("orders",))
same("agg_null_group", "select nullif(o_orderstatus, 'F') as status, count(*) as n from orders group by nullif(o_orderstatus, 'F')", ("orders",))
same("agg_group_ordinal", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2", ("orders",))
same("agg_distinct", "select o_orderstatus, count(distinct o_custkey) as k, cast(sum(distinct o_custkey % 10) as bigint) as s from orders group by o_orderstatus", ("orders",))
same("agg_filter", "select l_returnflag, count(*) filter (where l_quantity > 25) as many, round(sum(l_tax) filter (where l_discount = 0), 4) as tax from lineitem group by l_returnflag", ("lineitem",))
same("agg_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)", ("lineitem",))


@q("select o_orderstatus, coalesce(sum(cast(o_custkey as double)), 0.0) as total, coalesce(sum(cast(o_custkey as double)) filter (where o_orderkey < 0), 0.0) as none from orders group by o_orderstatus")
def agg_total(spark, t):
    return t("orders").groupBy("o_orderstatus").agg(agg.total(c("o_custkey")).alias("total"), agg.total(agg.filtered(c("o_custkey"), c("o_orderkey") < 0)).alias("none"))


@q("select n_regionkey, string_agg(n_name, ',' order by n_name) as names, string_agg(distinct substr(n_name, 1, 1), '/' order by substr(n_name, 1, 1)) as initials from nation group by n_regionkey")
def agg_group_concat(spark, t):
    return t("nation").groupBy("n_regionkey").agg(agg.group_concat(c("n_name")).alias("names"), agg.group_concat(F.substring("n_name", 1, 1), "/", distinct=True).alias("initials"))


@q("select n_regionkey, '[' || string_agg(coalesce(cast(nullif(n_nationkey, 5) as varchar), 'null'), ',' order by n_nationkey) || ']' as keys, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' order by n_name) || '}' as named from nation group by n_regionkey")
def agg_json_groups(spark, t):
    return t("nation").groupBy("n_regionkey").agg(agg.json_group_array(F.nullif(c("n_nationkey"), F.lit(5)), c("n_nationkey")).alias("keys"), agg.json_group_object(c("n_name"), c("n_nationkey")).alias("named"))


@q("select c_nationkey, max(c_acctbal) as best, arg_max(c_custkey, c_acctbal) as who from customer group by c_nationkey")
def agg_representative_row(spark, t):
    return t("customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"), agg.representative(c("c_custkey"), of_max=c("c_acctbal")).alias("who"))


@q("select cast(sum(cast(k as double)) as double) as s from (select 9223372036854775807 as k union all select 5)")
def agg_sum_overflow(spark, t):
    return spark.sql("select * from values (9223372036854775807L), (5L) as v(k)").agg(agg.sum_or_real(c("k")).alias("s"))


# --- windows --------------------------------------------------------------------------------------------------------

_W = "over (partition by o_custkey order by o_orderdate, o_orderkey)"
same("window_ranking", f"select o_orderkey, cast(row_number() {_W} as bigint) as rn, cast(rank() over (partition by o_orderpriority order by o_custkey) as bigint) as rk, cast(dense_rank() over (partition by o_orderpriority order by o_custkey) as bigint) as dr, cast(ntile(4) {_W} as bigint) as tile, percent_rank() over (partition by o_orderpriority order by o_custkey) as pr, cume_dist() over (partition by o_orderpriority order by o_custkey) as cd from orders", ("orders",))
same("window_offsets", f"select o_orderkey, lag(o_orderkey) {_W} as prev, lead(o_orderkey, 2, -1) {_W} as next2, first_value(o_orderkey) {_W} as first_key, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as last_key, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second_key from orders", ("orders",))
same("window_aggregates", "select o_orderkey, count(*) over (partition by o_custkey) as n, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 2) as last3, round(avg(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 1 preceding and 1 following), 4) as near, min(o_totalprice) over (partition by o_custkey order by o_orderkey rows between current row and unbounded following) as least, max(o_orderkey) over (partition by o_custkey) as top from orders", ("orders",))
same("window_range_frame", "select l_orderkey, l_linenumber, count(*) over (partition by l_suppkey order by l_quantity range between 5 preceding and 5 following) as near, count(*) over (partition by l_suppkey order by l_quantity) as up_to_peers from lineitem", ("lineitem",))
same("window_named", "select o_orderkey, cast(row_number() over w as bigint) as rn, sum(o_custkey % 7) over w as s from orders window w as (partition by o_orderpriority order by o_orderkey)", ("orders",), "select o_orderkey, cast(row_number() over w as bigint) as rn, cast(sum(o_custkey % 7) over w as bigint) as s from orders window w as (partition by o_orderpriority order by o_orderkey)")
same("window_over_group", "select o_orderpriority, count(*) as n, cast(rank() over (order by count(*) desc, o_orderpriority) as bigint) as rk from orders group by o_orderpriority", ("orders",))
same("window_in_expression", "select o_orderkey, case when o_totalprice > avg(o_totalprice) over (partition by o_custkey) then 'above' else 'below' end as side from orders", ("orders",))
same("window_limit", "select o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as rn from orders order by o_orderkey limit 50", ("orders",))


@q("select l_orderkey, l_linenumber, count(*) over w as n, cast(sum(l_linenumber) over w as bigint) as s from lineitem window w as (partition by l_suppkey order by l_quantity groups between 1 preceding and 1 following)")
def window_groups_frame(spark, t):
    df, w = windows.groups_frame(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_suppkey"], [c("l_quantity")], -1, 1)
    return df.select("l_orderkey", "l_linenumber", F.count("*").over(w).alias("n"), F.sum("l_linenumber").over(w).alias("s"))


def _exclude(name: str, mode: str) -> None:
    SQL[name] = f"select o_orderkey, cast(sum(o_orderkey) over (partition by o_custkey order by o_orderpriority range between unbounded preceding and current row exclude {mode.lower()}) as bigint) as s from orders"

    def run(spark, sf_dir):
        df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        out = windows.excluding(df, ["o_custkey"], [c("o_orderpriority")], c("o_orderkey"), c("o_orderkey"), lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow), mode, windows.array_sum, "s")
        return out.select("o_orderkey", "s")

    QUERIES[name] = run


for _n, _m in (("window_exclude_current", "CURRENT ROW"), ("window_exclude_group", "GROUP"), ("window_exclude_ties", "TIES"), ("window_exclude_none", "NO OTHERS")):
    _exclude(_n, _m)


@q("select o_orderkey, count(distinct o_orderpriority) over (partition by o_custkey) as kinds, count(*) filter (where o_orderstatus = 'F') over (partition by o_custkey) as done, string_agg(o_orderstatus, ',') over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) as path from orders")
def window_distinct_filter_concat(spark, t):
    w = Window.partitionBy("o_custkey")
    ordered = w.orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t("orders").select("o_orderkey", windows.distinct_count(c("o_orderpriority"), w).alias("kinds"), F.count(F.when(c("o_orderstatus") == "F", 1)).over(w).alias("done"), windows.concat_over(c("o_orderstatus"), ordered).alias("path"))


# --- sort, limit, set operations ------------------------------------------------------------------------------------

same("sort_ordinal_alias", "select c_custkey, c_acctbal * -1 as debt from customer order by 2 desc, c_custkey", ("customer",))
same("sort_limit_offset", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 20 offset 30", ("orders",))
same("limit_comma", "select o_orderkey from orders order by o_orderkey limit 5, 10", ("orders",), "select o_orderkey from orders order by o_orderkey limit 10 offset 5")
same("sort_nulls", "select o_orderkey, nullif(o_orderstatus, 'F') as s from orders order by s asc nulls last, o_orderkey", ("orders",))


@q("select p_partkey, p_name from part order by lower(p_name), p_partkey")
def sort_collate(spark, t):
    return t("part").select("p_partkey", "p_name").orderBy(d.collate(c("p_name"), "NOCASE"), "p_partkey")


@q("select n_nationkey as k from nation union all select c_nationkey from customer")
def set_union_all(spark, t):
    return setops.union_all(t("nation").select(c("n_nationkey").alias("k")), t("customer").select("c_nationkey"))


@q("select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union(spark, t):
    return setops.union(t("customer").select(c("c_nationkey").alias("k")), t("supplier").select("s_nationkey"))


@q("select l_partkey as k from lineitem where l_quantity > 40 intersect select p_partkey from part where p_size > 25")
def set_intersect(spark, t):
    return setops.intersect(t("lineitem").filter("l_quantity > 40").select(c("l_partkey").alias("k")), t("part").filter("p_size > 25").select("p_partkey"))


@q("select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 40")
def set_except(spark, t):
    return setops.except_(t("part").select(c("p_partkey").alias("k")), t("lineitem").filter("l_quantity > 40").select("l_partkey"))


same("set_precedence", "select c_nationkey as k from customer union select s_nationkey from supplier intersect select n_nationkey from nation where n_regionkey = 1 order by k", ("customer", "supplier", "nation"))

# --- subqueries and common table expressions ------------------------------------------------------------------------

same("subquery_scalar", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.8 from orders)", ("orders",))


@q("select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as best, (select count(*) from orders o where o.o_custkey = customer.c_custkey and o.o_totalprice > customer.c_acctbal) as above from customer")
def subquery_correlated(spark, t):
    found = {"best": F.max("o_totalprice"), "above": F.count(F.when(c("o_totalprice") > c("c_acctbal"), 1))}
    return joins.correlated(t("customer").select("c_custkey", "c_acctbal"), t("orders").select("o_custkey", "o_totalprice"), {"c_custkey": "o_custkey"}, found, counts=("above",)).select("c_custkey", "best", "above")


same("subquery_in", "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity = 50)", ("part", "lineitem"))
same("subquery_from", "select avg(n) as mean, min(n) as lo, max(n) as hi, count(*) as k from (select o_custkey, count(*) as n from orders group by o_custkey) x", ("orders",))
same("subquery_compound", "select kind, count(*) as n from (select 'c' as kind, c_custkey as k from customer union all select 's', s_suppkey from supplier) x group by kind", ("customer", "supplier"))
same("cte_plain", "with big(k, v) as (select o_custkey, sum(o_totalprice) from orders group by o_custkey), top as (select k, v from big where v > 1000000) select top.k as k, c_name from top join customer on top.k = c_custkey", ("orders", "customer"))
same("cte_recursive_all", "with recursive r(n, f) as (select 1, 1 union all select n + 1, f * 2 from r where n < 20) select n, f from r", ("region",), "with recursive r(n, f) as (select 1, 1 union all select n + 1, f * 2 from r where n < 20) select n, f from r")


@q("with recursive r(a, b) as (select c_nationkey, c_nationkey from customer union select a, (b * 7 + 3) % 25 from r) select a, b from r")
def cte_recursive_union(spark, t):
    return recursion.recursive_union(t("customer").select(c("c_nationkey").alias("a"), c("c_nationkey").alias("b")), lambda f: f.select("a", ((c("b") * 7 + 3) % 25).alias("b")))


@q("select c_custkey, c_acctbal from customer where c_acctbal < 0")
def view_scan(spark, t):
    t("customer").createOrReplaceTempView("customer")
    db = catalog.Database(spark)
    db.create_view("debtors", "select c_custkey, c_acctbal from customer where c_acctbal < 0")
    return spark.table("debtors")


# --- scalar functions -----------------------------------------------------------------------------------------------


@q("select p_partkey, length(p_name) as n, substr(p_name, 3, 4) as mid, substr(p_name, -3) as tail, upper(p_name) as up, lower(p_type) as low, trim(p_name, 'abcde') as trimmed, replace(p_name, 'a', '<>') as replaced, instr(p_name, 'a') as at, hex(p_brand) as hexed, '''' || replace(p_name, '''', '''''') || '''' as quoted, unicode(p_name) as code, coalesce(nullif(p_size, 1), 0) as size, case when p_size > 25 then 'big' else 'small' end as kind, least(p_size, 20, p_partkey) as lo, greatest(p_size, 20, p_partkey) as hi from part")
def string_functions(spark, t):
    n = c("p_name")
    return t("part").select("p_partkey", F.length(n).cast("bigint").alias("n"), strings.substr(n, 3, 4).alias("mid"), strings.substr(n, -3).alias("tail"), F.upper(n).alias("up"), F.lower("p_type").alias("low"), strings.trim(n, "abcde").alias("trimmed"), strings.replace(n, F.lit("a"), F.lit("<>")).alias("replaced"), strings.instr(n, F.lit("a")).alias("at"), F.hex("p_brand").alias("hexed"), strings.quote(n).alias("quoted"), strings.unicode(n).alias("code"), F.coalesce(F.nullif(c("p_size"), F.lit(1)), F.lit(0)).alias("size"), strings.iif(c("p_size") > 25, F.lit("big"), F.lit("small")).alias("kind"), strings.scalar_min(c("p_size").cast("bigint"), F.lit(20).cast("bigint"), c("p_partkey")).alias("lo"), strings.scalar_max(c("p_size").cast("bigint"), F.lit(20).cast("bigint"), c("p_partkey")).alias("hi"))


@q("select p_partkey, printf('%05d|%8.2f|%s|%-12s|%x', p_partkey, p_retailprice, p_brand, substr(p_name, 1, 6), p_size) as line from part")
def printf_function(spark, t):
    return t("part").select("p_partkey", strings.printf("%05d|%8.2f|%s|%-12s|%x", c("p_partkey"), c("p_retailprice"), c("p_brand"), F.substring("p_name", 1, 6), c("p_size")).alias("line"))


SQL["printf_function"] = "select p_partkey, format('{:05d}|{:8.2f}|{}|{:<12s}|{:x}', p_partkey, p_retailprice, p_brand, substr(p_name, 1, 6), p_size) as line from part"


@q("select chr(955) || chr(65) as letters, 'integer' as t1, 'text' as t2, 'null' as t3, 'real' as t4, '00000000' as zeros, '4142' as back, 'R163' as sound")
def text_literals(spark, t):
    return spark.range(1).select(strings.char(F.lit(955), F.lit(65)).alias("letters"), strings.typeof(F.lit(1)).alias("t1"), strings.typeof(F.lit("x")).alias("t2"), strings.typeof(F.lit(None).cast("string")).alias("t3"), strings.typeof(F.lit(1.5)).alias("t4"), F.hex(strings.zeroblob(F.lit(4))).alias("zeros"), F.hex(strings.unhex(F.lit("41-42"), "-")).alias("back"), strings.soundex(F.lit("Robert")).alias("sound"))


@q("select c_custkey, abs(c_acctbal) as a, cast(round(c_acctbal) as bigint) as r0, cast(trunc(c_acctbal) as bigint) as tr, ceil(c_acctbal) as ce, floor(c_acctbal) as fl, cast(sign(c_acctbal) as bigint) as sg, round(sqrt(abs(c_acctbal)), 6) as sq, round(ln(c_custkey), 9) as l, round(log10(c_custkey), 9) as l10, round(power(c_nationkey, 2.0), 6) as p, round(atan2(c_acctbal, 3.0), 9) as a2, c_custkey % nullif(c_nationkey, 0) as m, round(sin(c_custkey), 9) as s, round(degrees(cos(c_custkey)), 6) as dg from customer")
def math_functions(spark, t):
    b, k = c("c_acctbal"), c("c_custkey")
    return t("customer").select("c_custkey", F.abs(b).alias("a"), mathfn.rounded(b).alias("r0"), mathfn.trunc(b).alias("tr"), mathfn.ceil(b).alias("ce"), mathfn.floor(b).alias("fl"), mathfn.sign(b).alias("sg"), F.round(mathfn.sqrt(F.abs(b)), 6).alias("sq"), F.round(mathfn.ln(k), 9).alias("l"), F.round(mathfn.log10(k), 9).alias("l10"), F.round(F.pow(c("c_nationkey"), F.lit(2.0)), 6).alias("p"), F.round(F.atan2(b, F.lit(3.0)), 9).alias("a2"), mathfn.mod(k, c("c_nationkey")).alias("m"), F.round(mathfn.call("sin", k), 9).alias("s"), F.round(mathfn.call("degrees", mathfn.call("cos", k)), 6).alias("dg"))


@q("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month_start, strftime(o_orderdate + interval 36 hour, '%Y-%m-%d %H:%M:%S') as later, cast(floor(epoch(o_orderdate)) as bigint) as secs, round(epoch(o_orderdate) / 86400 + 2440587.5, 5) as jd, strftime(o_orderdate, '%j') as doy, cast(dayofweek(o_orderdate) as varchar) as dow, strftime(o_orderdate, '%W') as week, strftime(o_orderdate + cast((7 - dayofweek(o_orderdate)) % 7 as int) * interval 1 day, '%Y-%m-%d') as sunday from orders")
def date_functions(spark, t):
    o = c("o_orderdate")
    k = {"kind": "timestamp"}
    return t("orders").select("o_orderkey", dt.date(o, **k).alias("day"), dt.date(o, "start of month", **k).alias("month_start"), dt.datetime(o, "+36 hours", **k).alias("later"), dt.unixepoch(o, **k).alias("secs"), F.round(dt.julianday(o, **k), 5).alias("jd"), dt.strftime("%j", o, **k).alias("doy"), dt.strftime("%w", o, **k).alias("dow"), dt.strftime("%W", o, **k).alias("week"), dt.date(o, "weekday 0", **k).alias("sunday"))


@q("select o_orderkey, strftime(make_date(cast(year(o_orderdate) + month(o_orderdate) // 12 as bigint), cast(month(o_orderdate) % 12 + 1 as bigint), 1) + cast(day(o_orderdate) - 1 as int) * interval 1 day, '%Y-%m-%d') as next_month, strftime(make_date(year(o_orderdate) - 1, month(o_orderdate), 1) + cast(day(o_orderdate) - 1 as int) * interval 1 day, '%Y-%m-%d') as last_year from orders")
def date_month_rollover(spark, t):
    o = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t("orders").select("o_orderkey", dt.date(o, "+1 month").alias("next_month"), dt.date(o, "-1 year").alias("last_year"))


@q("select * from (values ('2000-01-01 12:00:00', '2000-01-01', '1970-01-01 00:00:00', '2000-03-02', cast(null as varchar))) as v(from_jd, from_unix, zero, rolled, bad)")
def date_literals(spark, t):
    return spark.range(1).select(dt.datetime(F.lit(2451545.0), kind="number").alias("from_jd"), dt.date(F.lit(946684800), "unixepoch", kind="number").alias("from_unix"), dt.datetime(F.lit("2440587.5")).alias("zero"), dt.date(F.lit("2000-01-31"), "+1 month").alias("rolled"), dt.date(F.lit("not a date")).alias("bad"))


@q("select event_id, cast(json_valid(props) as bigint) as ok, json_extract_string(props, '$.k') as k_text, cast(json_extract_string(props, '$.k') as bigint) as k, '{\"a\":' || cast(json_extract_string(props, '$.k') as varchar) || ',\"b\":\"' || event_type || '\"}' as made, '[' || event_id || ',\"' || event_type || '\",null]' as arr from events")
def json_functions(spark, t):
    p = c("props")
    return t("events").select("event_id", jsonfn.valid(p).alias("ok"), jsonfn.extract_text(p, "$.k").alias("k_text"), jsonfn.extract(p, "$.k", type_name="bigint").alias("k"), jsonfn.obj(b=c("event_type"), a=jsonfn.extract(p, "$.k", type_name="bigint")).alias("made"), jsonfn.array(c("event_id"), c("event_type"), F.lit(None).cast("string")).alias("arr"))


@q("select event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":' || event_id || '}' as set_z, '{}' as removed, '{\"k\":null,\"x\":1}' as never, 'integer' as kind from events")
def json_mutators(spark, t):
    p = c("props")
    return t("events").select("event_id", jsonfn.upsert(p, "$.z", c("event_id")).alias("set_z"), jsonfn.remove(p, "$.k").alias("removed"), jsonfn.kind(p, "$.k").alias("kind"), jsonfn.insert(jsonfn.overwrite(p, "$.k", F.lit(None).cast("int")), "$.x", F.lit(1)).alias("never"))


# --- table-valued functions -----------------------------------------------------------------------------------------


@q("select g as value, 5 as start, 5000 as stop, 3 as step from generate_series(5, 5000, 3) t(g)")
def generate_series(spark, t):
    return tvf.generate_series(spark, 5, 5000, 3).select("value", *[c(x).cast("int").alias(x) for x in ("start", "stop", "step")])


@q("select event_id, 'k' as key, json_extract_string(props, '$.k') as value from events")
def json_each(spark, t):
    return tvf.json_each_native(t("events"), "props", "event_id")


@q("select event_id, key, value from (select event_id, cast(null as varchar) as key, '{\"k\":' || json_extract_string(props, '$.k') || '}' as value from events union all select event_id, 'k', json_extract_string(props, '$.k') from events)")
def json_tree(spark, t):
    tvf.register(spark)
    t("events").createOrReplaceTempView("events")
    return spark.sql("select event_id, x.key as key, x.value as value from events, lateral json_tree(props) x")


same("lateral_join", "select n_name, x.c_custkey as c_custkey from nation, lateral (select c_custkey from customer where c_nationkey = n_nationkey order by c_acctbal desc, c_custkey limit 2) x", ("nation", "customer"))

# --- user functions -------------------------------------------------------------------------------------------------


@q("select p_partkey, p_size * 2 + 1 as odd from part")
def udf_scalar(spark, t):
    from brindle.sources import udfs

    udfs.scalar(spark, "odd_of", lambda s: s * 2 + 1, "int")
    t("part").createOrReplaceTempView("part")
    return spark.sql("select p_partkey, odd_of(p_size) as odd from part")


@q("select c_nationkey, round(max(c_acctbal) - min(c_acctbal), 2) as spread from customer group by c_nationkey")
def udf_aggregate(spark, t):
    from brindle.sources import udfs

    udfs.aggregate(spark, "spread_of", lambda s: float(s.max() - s.min()), "double")
    t("customer").createOrReplaceTempView("customer")
    return spark.sql("select c_nationkey, round(spread_of(c_acctbal), 2) as spread from customer group by c_nationkey")


# --- search and space -----------------------------------------------------------------------------------------------

_TOKENS = "with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) as pos from documents)"


@q(_TOKENS + " select doc_id as doc from tok where term = 'the' intersect select doc_id from tok where term = 'and' except select doc_id from tok where term = 'idiot'")
def fts_boolean(spark, t):
    return search.match(search.tokens(t("documents"), "doc_id", ["text"]), "the AND and NOT idiot")


@q(_TOKENS + " select distinct a.doc_id as doc from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'of' and b.term = 'the'")
def fts_phrase(spark, t):
    return search.match(search.tokens(t("documents"), "doc_id", ["text"]), '"of the"')


@q(_TOKENS + " select distinct doc_id as doc from tok where term like 'licen%' or term = 'clown'")
def fts_prefix(spark, t):
    return search.match(search.tokens(t("documents"), "doc_id", ["text"]), "licen* OR text:clown")


@q(_TOKENS + ", len as (select doc_id, count(*) as len from tok group by doc_id), s as (select count(*) as n, avg(len) as a from len), tf as (select doc_id, term, count(*) as tf from tok where term in ('license', 'idiot') group by all), df as (select term, count(*) as df from tf group by term) select tf.doc_id as doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) as score from tf join df on tf.term = df.term join len on len.doc_id = tf.doc_id, s group by tf.doc_id")
def fts_bm25(spark, t):
    return search.bm25(search.tokens(t("documents"), "doc_id", ["text"]), ["license", "idiot"]).select("doc", F.round("score", 6).alias("score"))


@q("select a.k as left_key, b.k as right_key from (select s_suppkey as k, s_acctbal as x1, s_acctbal + 40 as x2, s_nationkey * 10.0 as y1, s_nationkey * 10.0 + 15 as y2 from supplier) a join (select p_partkey as k, p_retailprice as x1, p_retailprice + 25 as x2, p_size * 5.0 as y1, p_size * 5.0 + 5 as y2 from part) b on a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2")
def spatial_join(spark, t):
    s = t("supplier").select(c("s_suppkey").alias("k"), c("s_acctbal").alias("x1"), (c("s_acctbal") + 40).alias("x2"), (c("s_nationkey") * 10.0).alias("y1"), (c("s_nationkey") * 10.0 + 15).alias("y2"))
    p = t("part").select(c("p_partkey").alias("k"), c("p_retailprice").alias("x1"), (c("p_retailprice") + 25).alias("x2"), (c("p_size") * 5.0).alias("y1"), (c("p_size") * 5.0 + 5).alias("y2"))
    return spatial.overlap_join(s, p, [("x1", "x2"), ("y1", "y2")], [50.0, 25.0], ("k", "k"))


@q("select l_orderkey, l_linenumber from lineitem where l_quantity >= 10 and l_extendedprice <= 30000 and l_quantity <= 20 and l_extendedprice >= 20000")
def spatial_box(spark, t):
    return t("lineitem").filter(spatial.within([("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice")], [(10, 20), (20000, 30000)])).select("l_orderkey", "l_linenumber")


@q("select p_partkey, round(sqrt(power(p_size - 25, 2) + power(p_retailprice - 1200, 2)), 6) as dist from part order by sqrt(power(p_size - 25, 2) + power(p_retailprice - 1200, 2)), p_partkey limit 15")
def spatial_nearest(spark, t):
    return spatial.nearest(t("part"), "p_partkey", [("p_size", "p_size"), ("p_retailprice", "p_retailprice")], [25.0, 1200.0], 15).select("p_partkey", F.round("dist", 6).alias("dist"))


@q("select vec_id, round(list_distance(cast(embedding as double[]), cast((select embedding from embeddings where vec_id = 7) as double[])), 5) as dist from embeddings order by list_distance(cast(embedding as double[]), cast((select embedding from embeddings where vec_id = 7) as double[])), vec_id limit 10")
def vector_nearest(spark, t):
    e = t("embeddings")
    probe = e.filter("vec_id = 7").select("embedding").first()
    return spatial.nearest_vectors(e, "vec_id", "embedding", list(probe[0]) if probe else [], 10).select("vec_id", F.round("dist", 5).alias("dist"))


# --- table changes --------------------------------------------------------------------------------------------------


@q("select c_custkey, case when c_nationkey = 3 then c_acctbal + 100 else c_acctbal end as c_acctbal from customer")
def dml_update(spark, t):
    return dml.update(t("customer").select("c_custkey", "c_nationkey", "c_acctbal"), {"c_acctbal": c("c_acctbal") + 100}, c("c_nationkey") == 3).select("c_custkey", "c_acctbal")


@q("select c_custkey from customer where not (nullif(c_nationkey, 4) > 10) or nullif(c_nationkey, 4) is null")
def dml_delete(spark, t):
    return dml.delete(t("customer"), F.nullif(c("c_nationkey"), F.lit(4)) > 10).select("c_custkey")


@q("select s_suppkey, case when s_suppkey <= 50 then s_acctbal + 1 else s_acctbal end as s_acctbal from supplier union all select s_suppkey + 100000, 0.0 from supplier where s_suppkey <= 20")
def dml_upsert(spark, t):
    s = t("supplier").select("s_suppkey", "s_acctbal")
    new = s.filter("s_suppkey <= 50").select("s_suppkey", F.lit(1.0).alias("s_acctbal")).unionAll(s.filter("s_suppkey <= 20").select(c("s_suppkey") + 100000, F.lit(0.0)))
    return dml.upsert(s, new, ["s_suppkey"], {"s_acctbal": "old.s_acctbal + excluded.s_acctbal"})


@q("select s_suppkey, case when s_suppkey <= 10 then -1.0 else s_acctbal end as s_acctbal from supplier union all select 100001, 5.0")
def dml_insert_or_replace(spark, t):
    s = t("supplier").select("s_suppkey", "s_acctbal")
    new = s.filter("s_suppkey <= 10").select("s_suppkey", F.lit(-1.0).alias("s_acctbal")).unionAll(spark.sql("select 100001L, 5.0D"))
    return dml.insert_or_replace(s, new, ["s_suppkey"])


@q("select o_orderkey, o_totalprice + coalesce(x.extra, 0) as o_totalprice from orders left join (select l_orderkey, max(l_tax) as extra from lineitem where l_quantity > 40 group by l_orderkey) x on x.l_orderkey = o_orderkey")
def dml_update_from(spark, t):
    extra = t("lineitem").filter("l_quantity > 40").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.max("l_tax").alias("extra"))
    return dml.update_from(t("orders").select("o_orderkey", "o_totalprice"), extra, ["o_orderkey"], {"o_totalprice": "old.o_totalprice + src.extra"})


@q("select (select count(*) from orders where o_custkey not in (select c_custkey from customer)) as orphans, (select count(*) from (select l_orderkey from lineitem group by l_orderkey, l_partkey having count(*) > 1)) as repeated, (select count(*) from lineitem where l_discount > 0.09) as failed_checks, (select count(*) from orders where nullif(o_orderstatus, 'P') is null) as nulls")
def constraint_checks(spark, t):
    orphans = dml.foreign_key_violations(t("orders"), ["o_custkey"], t("customer"), ["c_custkey"]).agg(F.count("*").alias("orphans"))
    repeated = dml.unique_violations(t("lineitem"), ["l_orderkey", "l_partkey"]).agg(F.count("*").alias("repeated"))
    failed = dml.check_violations(t("lineitem"), "l_discount <= 0.09").agg(F.count("*").alias("failed_checks"))
    nulls = dml.not_null_violations(t("orders").withColumn("s", F.nullif(c("o_orderstatus"), F.lit("P"))), ["s"]).agg(F.count("*").alias("nulls"))
    return orphans.crossJoin(repeated).crossJoin(failed).crossJoin(nulls)  # one row each


@q("select n_nationkey, n_name, case when n_regionkey = 2 then null else n_regionkey end as n_regionkey from nation")
def foreign_key_set_null(spark, t):
    return dml.on_delete(t("nation"), ["n_regionkey"], t("region").filter("r_regionkey = 2"), ["r_regionkey"], "SET NULL")


@q("select cid, name, type from (values (0, 'n_nationkey', 'INTEGER'), (1, 'n_name', 'TEXT'), (2, 'n_regionkey', 'INTEGER')) as v(cid, name, type)")
def catalog_table_info(spark, t):
    db = catalog.Database(spark)
    db.create_table_as("nation_copy", t("nation"))
    return db.table_info("nation_copy").select("cid", "name", "type")


@q("select row_number() over (order by o_totalprice, o_orderkey) as id, o_orderkey from orders")
def stable_row_ids(spark, t):
    return catalog.sequence_key(t("orders").select("o_totalprice", "o_orderkey"), "id", [c("o_totalprice"), c("o_orderkey")]).select("id", "o_orderkey")


# --- extensions -----------------------------------------------------------------------------------------------------


@q("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def event_windows(spark, t):
    from brindle.streaming import windows as w

    return w.tumbling(t("events"), "ts", "1 hour", ["event_type"], "value").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@q("with e as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, count(*) as n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start from s group by user_id, k")
def event_sessions(spark, t):
    from brindle.streaming import windows as w

    return w.sessions(t("events"), "ts", "30 minutes", "user_id").select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))

# --- the dialect as SQL text ----------------------------------------------------------------------------------------

same("sql_division", "select l_orderkey, l_linenumber, l_orderkey / l_linenumber as whole, l_orderkey / (l_linenumber - l_linenumber) as nothing, l_extendedprice / l_linenumber as real, 100 * l_orderkey / 7 as scaled from lineitem", ("lineitem",), "select l_orderkey, l_linenumber, cast(l_orderkey // l_linenumber as bigint) as whole, cast(null as bigint) as nothing, l_extendedprice / l_linenumber as real, cast(100 * l_orderkey // 7 as bigint) as scaled from lineitem")
same("sql_division_of_aggregates", "select l_returnflag, sum(l_linenumber) / count(*) as mean, count(*) / 0 as nothing, 7 / 2 as three, 1 / 2.0 as half from lineitem group by l_returnflag", ("lineitem",), "select l_returnflag, cast(sum(l_linenumber) // count(*) as bigint) as mean, cast(null as bigint) as nothing, cast(3 as bigint) as three, cast(0.5 as decimal(8, 6)) as half from lineitem group by l_returnflag")
same("sql_like", "select p_partkey from part where p_name like '%A%' and p_type not like 'STANDARD%'", ("part",), "select p_partkey from part where p_name ilike '%a%' and p_type not ilike 'standard%'")
same("sql_group_concat", "select n_regionkey, group_concat('x') as commas, group_concat(n_regionkey, '; ') as others, group_concat(distinct n_regionkey) as one from nation group by n_regionkey", ("nation",), "select n_regionkey, string_agg('x', ',') as commas, string_agg(cast(n_regionkey as varchar), '; ') as others, cast(n_regionkey as varchar) as one from nation group by n_regionkey")
same("sql_json_operators", "select event_id, props ->> '$.k' as a, json_extract(props, '$.k') as b, props -> 'k' as c from events", ("events",), "select event_id, json_extract_string(props, '$.k') as a, json_extract_string(props, '$.k') as b, cast(json_extract(props, '$.k') as varchar) as c from events")
same("sql_text_functions", "select o_orderkey, substr(o_orderpriority, 0, 3) as s, iif(o_totalprice > 100000, 'hi', 'lo') as k, strftime('%Y-%m', o_orderdate) as m, unicode(o_orderstatus) as u from orders", ("orders",), "select o_orderkey, substr(o_orderpriority, 1, 2) as s, case when o_totalprice > 100000 then 'hi' else 'lo' end as k, strftime(o_orderdate, '%Y-%m') as m, unicode(o_orderstatus) as u from orders")
same("sql_collate", "select c_custkey from customer where c_mktsegment collate nocase = 'building'", ("customer",), "select c_custkey from customer where lower(c_mktsegment) = 'building'")
same("row_values", "select l_orderkey, l_linenumber from lineitem where (l_linenumber, l_returnflag) = (1, 'R')", ("lineitem",))
same("set_mixed_numbers", "select count(*) as n from (select c_nationkey as k from customer union select cast(s_nationkey as double) from supplier) x", ("customer", "supplier"))
same("subquery_outer_order", "select k, n from (select o_custkey as k, count(*) as n from orders group by o_custkey order by 1) x order by n desc, k", ("orders",))


@q("select r_regionkey, r_name from region where r_regionkey = 1 or r_name = 'ASIA'")
def sql_parameter_styles(spark, t):
    t("region").createOrReplaceTempView("region")
    numbered = frontend.sql(spark, "select r_regionkey, r_name from region where r_regionkey = ?2 or r_name = ?1", ["ASIA", 1])
    return numbered.intersect(frontend.sql(spark, "select r_regionkey, r_name from region where r_regionkey = @key or r_name = $name", {"name": "ASIA", "key": 1}))


@q("select * from (values (0, 'r_regionkey'), (1, 'r_name')) as v(cid, name)")
def sql_pragma_table_info(spark, t):
    t("region").createOrReplaceTempView("region")
    return frontend.sql(spark, "pragma table_info(region)").select("cid", "name")


# --- functions that no query above uses -----------------------------------------------------------------------------


@q("select c_custkey, round(tan(x), 9) as tan, round(asin(x), 9) as asin, round(acos(x), 9) as acos, round(atan(x), 9) as atan, round(sinh(x), 9) as sinh, round(cosh(x), 9) as cosh, round(tanh(x), 9) as tanh, round(asinh(x), 9) as asinh, round(acosh(1 + x), 9) as acosh, round(atanh(x), 9) as atanh, round(radians(x), 9) as radians, round(exp(x), 9) as exp, round(log2(1 + x), 9) as log2, round(ln(1 + x), 9) as log, round(pi() * x, 9) as pi from (select c_custkey, abs(c_acctbal) / 20000.0 as x from customer)")
def math_more(spark, t):
    x = F.abs(c("c_acctbal")) / 20000.0
    named = {n: mathfn.call(n, x) for n in ("tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh", "radians")}
    named |= {"acosh": mathfn.call("acosh", 1 + x), "exp": F.exp(x), "log2": mathfn.log2(1 + x), "log": mathfn.log(1 + x), "pi": F.pi() * x}
    return t("customer").select("c_custkey", *[F.round(e, 9).alias(n) for n, e in named.items()])


@q("select * from (values ('2024-01-31 15:30:00', '2024-01-31 04:30:00', '2024-02-07', '2024-02-04', '10:20:30', '2024-01-31 10:00:00', '2024-01-01')) as v(ahead, behind, wednesday, sunday, clock, utc, year_start)")
def date_modifiers(spark, t):
    at = F.lit("2024-01-31 10:00:00")
    return spark.range(1).select(dt.datetime(at, "+05:30").alias("ahead"), dt.datetime(at, "-05:30").alias("behind"), dt.date(F.lit("2024-02-01"), "weekday 3").alias("wednesday"), dt.date(at, "weekday 0").alias("sunday"), dt.time(F.lit("2024-01-31 10:20:30")).alias("clock"), dt.datetime(at, "utc").alias("utc"), dt.date(at, "start of year").alias("year_start"))


@q("select event_id, '{\"a\":[' || event_id || ',2],\"b\":\"x\"}' as small, cast(2 as bigint) as n, '\"' || event_type || '\"' as quoted, '{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":1}' as patched from events")
def json_more(spark, t):
    made = F.concat(F.lit('{ "a" : [ '), c("event_id").cast("string"), F.lit(' , 2 ] , "b" : "x" }'))
    return t("events").select("event_id", jsonfn.minify(made).alias("small"), jsonfn.array_length(made, "$.a").cast("bigint").alias("n"), jsonfn.quote(c("event_type")).alias("quoted"), jsonfn.patch(c("props"), F.lit('{"z":1,"gone":null}')).alias("patched"))


@q("select p_partkey, trim(p_name) as a, ltrim(p_name, 'abcdef') as b, rtrim(p_name, 'abcdef') as c, p_size as d, cast(8 as bigint) as e from part")
def text_more(spark, t):
    n = c("p_name")
    return t("part").select("p_partkey", strings.trim(n).alias("a"), F.ltrim(n, F.lit("abcdef")).alias("b"), F.rtrim(n, F.lit("abcdef")).alias("c"), strings.likely(c("p_size")).alias("d"), F.octet_length(mathfn.randomblob(F.lit(8))).cast("bigint").alias("e"))


# --- table changes that no query above uses --------------------------------------------------------------------------


@q("select cast(p_partkey as bigint) as k, cast(7 as bigint) as v, cast(p_partkey * 2 as bigint) as g from part")
def dml_default_and_generated(spark, t):
    d_ = dml.Definition({"k": dml.Rule("INTEGER"), "v": dml.Rule("INTEGER", default="7"), "g": dml.Rule("INTEGER", generated="k * 2")})
    return dml.shape(t("part").select(c("p_partkey").alias("k")), d_)


@q("select c_custkey, c_acctbal + 1 as now from customer where c_acctbal < 0")
def dml_returning(spark, t):
    hit = t("customer").filter("c_acctbal < 0")
    return dml.returning(dml.update(hit, {"c_acctbal": c("c_acctbal") + 1}), c("c_custkey"), c("c_acctbal").alias("now"))


@q("select * from (values (cast(null as int), 'keep'), (null, 'new'), (1, 'one!'), (2, 'two')) as v(k, name)")
def dml_upsert_null_keys(spark, t):
    old = spark.createDataFrame([(None, "keep"), (1, "one")], "k int, name string")
    new = spark.createDataFrame([(None, "new", 1), (1, "one?", 2), (1, "one!", 3), (2, "two", 4)], "k int, name string, at int")
    return dml.upsert(old.withColumn("at", F.lit(0)), new, ["k"], {"name": "excluded.name"}, order="at").select("k", "name")


# --- changes as SQL text --------------------------------------------------------------------------------------------


def _database(spark, t, *names: str) -> catalog.Database:
    for n in names:
        t(n).createOrReplaceTempView(n)
    return catalog.Database(spark)


@q("select coalesce(o.s_suppkey, n.k) as s_suppkey, coalesce(o.s_name, 'new') as s_name, case when o.s_suppkey is null then 1.0 when n.k is null then o.s_acctbal else o.s_acctbal + 1.0 end as s_acctbal from supplier o full join (select s_suppkey + 5 as k from supplier where s_nationkey < 10) n on o.s_suppkey = n.k")
def sql_text_upsert(spark, t):
    return statements.execute(_database(spark, t, "supplier"), """
        create table text_supplier (s_suppkey integer primary key, s_name text not null, s_acctbal real);
        insert into text_supplier select s_suppkey, s_name, s_acctbal from supplier;
        insert into text_supplier select s_suppkey + 5, 'new', 1.0 from supplier where s_nationkey < 10
            on conflict (s_suppkey) do update set s_acctbal = s_acctbal + excluded.s_acctbal;
        select s_suppkey, s_name, s_acctbal from text_supplier""")


@q("select * from (select o_orderkey, case when o_orderstatus = 'F' then o_totalprice * 2 else o_totalprice end as price from orders) where price >= 50000")
def sql_text_update_delete(spark, t):
    return statements.execute(_database(spark, t, "orders"), """
        create table text_orders as select o_orderkey, o_orderstatus, o_totalprice as price from orders;
        update text_orders set price = price * 2 where o_orderstatus = 'F';
        delete from text_orders where price < 50000;
        select o_orderkey, price from text_orders""")


@q("select s_suppkey, s_nationkey from supplier where s_nationkey not in (select n_nationkey from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA')")
def sql_text_cascade(spark, t):
    return statements.execute(_database(spark, t, "region", "nation", "supplier"), """
        create table text_region (r_regionkey integer primary key, r_name text);
        create table text_nation (n_nationkey integer primary key, n_regionkey integer references text_region (r_regionkey) on delete cascade);
        create table text_seller (s_suppkey integer primary key, s_nationkey integer references text_nation (n_nationkey) on delete cascade);
        insert into text_region select r_regionkey, r_name from region;
        insert into text_nation select n_nationkey, n_regionkey from nation;
        insert into text_seller select s_suppkey, s_nationkey from supplier;
        delete from text_region where r_name = 'ASIA';
        select s_suppkey, s_nationkey from text_seller""")


@q("select c_custkey as k, c_acctbal as v, c_acctbal * 2 as twice from customer where c_nationkey = 3")
def sql_text_returning(spark, t):
    return statements.execute(_database(spark, t, "customer"), """
        create table text_returned (k integer primary key, v real, g real generated always as (v * 2));
        insert into text_returned (k, v) select c_custkey, c_acctbal from customer where c_nationkey = 3 returning k, v, g as twice""")


@q("select p_partkey, p_size from part")
def sql_text_savepoint(spark, t):
    return statements.execute(_database(spark, t, "part"), """
        create table text_part as select p_partkey, p_size from part;
        begin; update text_part set p_size = 0; savepoint s; delete from text_part; rollback to s; rollback;
        select p_partkey, p_size from text_part""")
