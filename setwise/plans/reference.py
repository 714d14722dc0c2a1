"""Queries of the language over the driver tables, each with the SQL that states the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..lang.compiler import query
from ..operators import projection as P
from ..operators import tables
from ..operators.sets import Table
from ..scale import shared_dir
from ..session import table
from ..sources import readers, sinks
from ..sources.catalog import Catalog
from ..streaming import ingest

#: Tables and their keys; lineitem has none, so its rows are numbered where identities are needed.
KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": (), "events": ("event_id",), "documents": ("doc_id",), "embeddings": ("vec_id",),
}


def driver_tables(spark: SparkSession, d: str) -> Callable[[str], Table]:
    def resolve(path: str) -> Table:
        name = path.strip("/")
        return Table(table(spark, d, name), KEYS.get(name, ()))

    return resolve


def run(spark: SparkSession, d: str, text: str, **options) -> DataFrame:
    return query(spark, text, {}, resolve=driver_tables(spark, d), **options)


# name: (query, SQL[, options])
SPECS: dict[str, tuple] = {
    # --- projection, filter, objects -----------------------------------------------------------
    "projection": ("o := //orders {key: o.o_orderkey, total: o.o_totalprice}", "select o_orderkey as key, o_totalprice as total from orders"),
    "projection_with": ("o := //orders {key: o.o_orderkey} with {half: o.o_totalprice / 2}", "select o_orderkey as key, o_totalprice / 2 as half from orders"),
    "object_merge_right_wins": ("c := //customer {k: c.c_custkey, v: 1} with {v: c.c_nationkey}", "select c_custkey as k, cast(c_nationkey as bigint) as v from customer"),
    "filter_and": (
        "l := //lineitem l.l_orderkey where l.l_quantity > 45 & l.l_discount <= 0.02",
        "select l_orderkey as value from lineitem where l_quantity > 45 and l_discount <= 0.02",
    ),
    "filter_or_not": (
        'o := //orders o.o_orderkey where !(o.o_orderstatus = "F") & (o.o_totalprice < 1000 | o.o_orderpriority = "1-URGENT")',
        "select o_orderkey as value from orders where not o_orderstatus = 'F' and (o_totalprice < 1000 or o_orderpriority = '1-URGENT')",
    ),
    "cond_if": (
        'l := //lineitem {k: l.l_orderkey, size: if l.l_quantity > 25 then "large" else "small"}',
        "select l_orderkey as k, case when l_quantity > 25 then 'large' else 'small' end as size from lineitem",
    ),
    "cond_fused_in_reduce": (
        "l := //lineitem sum(if l.l_quantity > 25 then 1 else 0)",
        "select cast(sum(case when l_quantity > 25 then 1 else 0 end) as decimal(38,0)) as value from lineitem",
    ),
    "undefined_drops_row": (
        "l := //lineitem {k: l.l_orderkey, r: l.l_quantity / (l.l_linenumber - 1)}",
        "select l_orderkey as k, l_quantity / (l_linenumber - 1) as r from lineitem where l_linenumber <> 1",
    ),
    "undefined_union": ("(//region).r_name union undefined", "select r_name as value from region"),
    "wrong_type_is_undefined": ("r := //region count(r.r_name + 1)", "select cast(0 as bigint) as value"),
    "equality_of_kinds": ('r := //region {k: r.r_regionkey, same: r.r_name = r.r_regionkey, num: r.r_regionkey = 1.0}', "select cast(r_regionkey as bigint) as k, false as same, r_regionkey = 1 as num from region"),
    "array_build_and_deref": ("r := //region a := [r.r_regionkey, r.r_regionkey * 2] {k: a[0], d: a[1]}", "select cast(r_regionkey as bigint) as k, cast(r_regionkey * 2 as bigint) as d from region"),
    "object_deref_by_name": ('r := //region r["r_name"]', "select r_name as value from region"),
    "user_function": ("f(x, y) := x * y + 1  l := //lineitem  sum(f(l.l_linenumber, l.l_suppkey))", "select cast(sum(l_linenumber * l_suppkey + 1) as decimal(38,0)) as value from lineitem"),
    "import_alias": ("import std::math::*  n := //nation  {k: n.n_nationkey, r: sqrt(n.n_nationkey)}", "select cast(n_nationkey as bigint) as k, sqrt(n_nationkey) as r from nation"),
    "assert_holds": ("o := //orders assert o.o_totalprice > 0 count(o)", "select count(*) as value from orders"),
    # --- joins, crosses, set operations ----------------------------------------------------------
    "identity_join": ("a := (//orders).o_totalprice b := (//orders).o_custkey {p: a, c: b}", "select o_totalprice as p, o_custkey as c from orders"),
    "identity_self_join_filtered": (
        'o := //orders a := o where o.o_orderstatus = "F"  b := o where o.o_totalprice > 1000  {k: a.o_orderkey, t: b.o_totalprice}',
        "select o_orderkey as k, o_totalprice as t from orders where o_orderstatus = 'F' and o_totalprice > 1000",
    ),
    "value_join": (
        "o := //orders c := //customer  o ~ c {k: o.o_orderkey, n: c.c_name} where o.o_custkey = c.c_custkey",
        "select o_orderkey as k, c_name as n from orders join customer on o_custkey = c_custkey",
    ),
    "value_join_3way": (
        "o := //orders c := //customer n := //nation  o ~ c ~ n {k: o.o_orderkey, n: n.n_name} where o.o_custkey = c.c_custkey & c.c_nationkey = n.n_nationkey",
        "select o_orderkey as k, n_name as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    ),
    "theta_join": ("a := //nation r := //region  a ~ r {n: a.n_name, r: r.r_name} where a.n_nationkey < r.r_regionkey", "select n_name as n, r_name as r from nation join region on n_nationkey < r_regionkey"),
    "cross_count": ("a := //nation r := //region a ~ r count([a, r])", "select count(*) as value from nation, region"),
    "self_cross_new": ("n := //nation m := new n  n ~ m count(n.n_nationkey where n.n_regionkey = m.n_regionkey)", "select count(*) as value from nation a join nation b on a.n_regionkey = b.n_regionkey"),
    "relate_restricts": ("n := //nation r := //region (n where n.n_nationkey < 10) ~ r count([n.n_name, r.r_name])", "select count(*) as value from nation, region where n_nationkey < 10"),
    "union_same_source": ("n := //nation k := n.n_nationkey (k where k < 10) union (k where k > 5)", "select cast(n_nationkey as bigint) as value from nation"),
    "union_two_sources": ("count((//nation).n_name union (//region).r_name)", "select (select count(*) from nation) + (select count(*) from region) as value"),
    "union_realigned": ("n := //nation r := //region u := n.n_nationkey union r.r_regionkey  count(u + n.n_regionkey)", "select count(*) as value from nation"),
    "intersect_ids": ("n := //nation k := n.n_nationkey (k where k < 10) intersect (k where k > 5)", "select cast(n_nationkey as bigint) as value from nation where n_nationkey between 6 and 9"),
    "difference_ids": ("n := //nation k := n.n_nationkey k difference (k where k > 5)", "select cast(n_nationkey as bigint) as value from nation where n_nationkey <= 5"),
    "distinct_values": ("distinct((//lineitem).l_returnflag)", "select distinct l_returnflag as value from lineitem"),
    "distinct_objects": ("l := //lineitem distinct({f: l.l_returnflag, s: l.l_linestatus})", "select distinct l_returnflag as f, l_linestatus as s from lineitem"),
    "new_keeps_values": ("count(new (//orders).o_orderkey)", "select count(*) as value from orders"),
    # --- reductions ---------------------------------------------------------------------------------
    "reduce_count": ("count(//lineitem)", "select count(*) as value from lineitem"),
    "reduce_sum": ("import std::math::* roundTo(sum((//lineitem).l_quantity), 2)", "select floor(sum(l_quantity) * 100 + 0.5) / 100 as value from lineitem"),
    "reduce_sum_exact": ("sum((//lineitem).l_orderkey)", "select cast(sum(l_orderkey) as decimal(38,0)) as value from lineitem"),
    "reduce_mean": ("import std::math::* roundTo(mean((//lineitem).l_extendedprice), 4)", "select floor(avg(l_extendedprice) * 10000 + 0.5) / 10000 as value from lineitem"),
    "reduce_min_max": ("l := //lineitem {lo: min(l.l_extendedprice), hi: max(l.l_extendedprice), first: min(l.l_orderkey)}", "select min(l_extendedprice) as lo, max(l_extendedprice) as hi, min(l_orderkey) as first from lineitem"),
    "reduce_min_max_time": ("import std::time::* o := //orders {a: date(minTime(o.o_orderdate)), b: date(maxTime(o.o_orderdate))}", "select strftime(min(o_orderdate), '%Y-%m-%d') as a, strftime(max(o_orderdate), '%Y-%m-%d') as b from orders"),
    "reduce_sum_sq": ("import std::math::* roundTo(sumSq((//lineitem).l_discount), 4)", "select floor(sum(l_discount * l_discount) * 10000 + 0.5) / 10000 as value from lineitem"),
    "reduce_variance": ("import std::math::* l := //lineitem {v: roundTo(variance(l.l_quantity), 6), s: roundTo(stdDev(l.l_quantity), 6)}", "select floor(var_pop(l_quantity) * 1e6 + 0.5) / 1e6 as v, floor(stddev_pop(l_quantity) * 1e6 + 0.5) / 1e6 as s from lineitem"),
    "reduce_geometric_mean": ("import std::math::* roundTo(geometricMean((//lineitem).l_quantity), 6)", "select floor(exp(avg(ln(l_quantity))) * 1e6 + 0.5) / 1e6 as value from lineitem"),
    "reduce_forall_exists": ("l := //lineitem {a: forall(l.l_quantity > 0), e: exists(l.l_quantity > 1000), none: forall((l where l.l_quantity > 1000).l_tax > 5)}", "select bool_and(l_quantity > 0) as a, bool_or(l_quantity > 1000) as e, true as none from lineitem"),
    "reduce_empty": ("l := //lineitem e := l.l_quantity where l.l_quantity > 1000 {n: count(e)}", "select cast(0 as bigint) as n"),
    "reduce_empty_sum_vanishes": ("l := //lineitem sum(l.l_quantity where l.l_quantity > 1000)", "select cast(null as double) as value where false"),
    "median": ("median((//lineitem).l_extendedprice)", "select median(l_extendedprice) as value from lineitem"),
    "mode": ("mode((//lineitem).l_linenumber)", "with c as (select l_linenumber, count(*) as n from lineitem group by 1) select cast(l_linenumber as bigint) as value from c where n = (select max(n) from c)"),
    "count_distinct": ("count(distinct((//lineitem).l_suppkey))", "select count(distinct l_suppkey) as value from lineitem"),
    "filter_by_statistics": ("e := //events  e.event_id where e.value > mean(e.value) + 2 * stdDev(e.value)", "select event_id as value from events where value > (select avg(value) + 2 * stddev_pop(value) from events)"),
    "filtered_distinct_count": (
        'import std::time::* e := //events  count(distinct(e.user_id where e.event_type = "click" & getMillis(e.ts) > getMillis("2024-01-08") & getMillis(e.ts) < getMillis("2024-01-15")))',
        "select count(distinct user_id) as value from events where event_type = 'click' and ts >= timestamp '2024-01-08 00:00:00.001' and ts < timestamp '2024-01-15'",
    ),
    # --- solve ---------------------------------------------------------------------------------------
    "solve_count": ("o := //orders solve 'p {priority: 'p, n: count(o where o.o_orderpriority = 'p)}", "select o_orderpriority as priority, count(*) as n from orders group by 1"),
    "solve_many_reductions": (
        "import std::math::* l := //lineitem solve 'f, 's g := l where l.l_returnflag = 'f & l.l_linestatus = 's "
        "{flag: 'f, status: 's, qty: roundTo(sum(g.l_quantity), 2), price: roundTo(sum(g.l_extendedprice), 2), disc: roundTo(sum(g.l_extendedprice * (1 - g.l_discount)), 2), avg: roundTo(mean(g.l_quantity), 4), n: count(g)}",
        "select l_returnflag as flag, l_linestatus as status, floor(sum(l_quantity) * 100 + 0.5) / 100 as qty, floor(sum(l_extendedprice) * 100 + 0.5) / 100 as price, "
        "floor(sum(l_extendedprice * (1 - l_discount)) * 100 + 0.5) / 100 as disc, floor(avg(l_quantity) * 1e4 + 0.5) / 1e4 as avg, count(*) as n from lineitem group by 1, 2",
    ),
    "solve_multi_source": (
        "o := //orders c := //customer solve 'k {k: 'k, n: count(o where o.o_custkey = 'k), nation: max((c where c.c_custkey = 'k).c_nationkey)}",
        "select c_custkey as k, count(*) as n, cast(max(c_nationkey) as bigint) as nation from customer join orders on o_custkey = c_custkey group by 1",
    ),
    "solve_filter_inside": ("l := //lineitem solve 'f g := l where l.l_returnflag = 'f {f: 'f, n: count(g where g.l_quantity > 49)}", "select l_returnflag as f, count(case when l_quantity > 49 then 1 end) as n from lineitem group by 1"),
    "solve_empty_count_zero": ("l := //lineitem solve 'f g := l where l.l_returnflag = 'f {f: 'f, n: count(g where g.l_quantity > 1000)}", "select distinct l_returnflag as f, cast(0 as bigint) as n from lineitem"),
    "solve_extra_filter": (
        "l := //lineitem solve 'k a := count(l where l.l_suppkey = 'k & l.l_returnflag = \"A\") b := count(l where l.l_suppkey = 'k & l.l_returnflag = \"R\") {k: 'k, ratio: a / b}",
        "select l_suppkey as k, count(case when l_returnflag = 'A' then 1 end) / count(case when l_returnflag = 'R' then 1 end) as ratio from lineitem group by 1 "
        "having count(case when l_returnflag = 'A' then 1 end) > 0 and count(case when l_returnflag = 'R' then 1 end) > 0",
    ),
    "solve_constrained": ("o := //orders c := //customer solve 'k = c.c_custkey {k: 'k, n: count(o where o.o_custkey = 'k)}", "select c_custkey as k, count(*) as n from customer join orders on o_custkey = c_custkey group by 1"),
    "solve_rows_pass": ("n := //nation solve 'r n.n_name where n.n_regionkey = 'r", "select n_name as value from nation"),
    "solve_expression_key": ("import std::time::* o := //orders solve 'y {y: 'y, n: count(o where year(o.o_orderdate) = 'y)}", "select cast(year(o_orderdate) as bigint) as y, count(*) as n from orders group by 1"),
    "solve_inverted_key": ("n := //nation solve 'k {k: 'k, n: count(n where n.n_regionkey = 'k * 2 - 1)}", "select (n_regionkey + 1) / 2 as k, count(*) as n from nation group by 1"),
    "solve_two_level": (
        "o := //orders per := solve 'c {c: 'c, n: count(o where o.o_custkey = 'c)}  per.c where per.n = max(per.n)",
        "with p as (select o_custkey as c, count(*) as n from orders group by 1) select c as value from p where n = (select max(n) from p)",
    ),
    "solve_of_solve": (
        "o := //orders per := solve 'c {c: 'c, n: count(o where o.o_custkey = 'c)}  solve 'n {n: 'n, customers: count(per where per.n = 'n)}",
        "with p as (select o_custkey as c, count(*) as n from orders group by 1) select n, count(*) as customers from p group by 1",
    ),
    "solve_in_function": ("histogram(d) := solve 'k {k: 'k, n: count(d where d = 'k)}  histogram((//lineitem).l_returnflag)", "select l_returnflag as k, count(*) as n from lineitem group by 1"),
    "solve_running_max": (
        "n := distinct((//lineitem).l_quantity) solve 'q m := max(n where n < 'q) {q: (n where n = 'q), before: m}",
        "with d as (select distinct l_quantity as q from lineitem) select q, before from (select q, lag(q) over (order by q) as before from d) where before is not null",
    ),
    "solve_neighbours": (
        "o := //orders t := distinct(o.o_totalprice) solve 'p = t {p: 'p, below: max(t where t < 'p), above: min(t where t > 'p)}",
        "with d as (select distinct o_totalprice as p from orders) select * from (select p, lag(p) over (order by p) as below, lead(p) over (order by p) as above from d) where below is not null and above is not null",
    ),
    "solve_disjunction": (
        "n := //nation solve 'k {k: 'k, n: count(n where n.n_nationkey = 'k | n.n_regionkey = 'k)}",
        "select cast(k as bigint) as k, count(*) as n from (select n_nationkey as k, n_nationkey as i from nation union select n_regionkey, n_nationkey from nation) group by 1",
    ),
    "hourly_funnel": (
        "import std::time::* e := //events r := e where getMillis(e.ts) > getMillis(\"2024-01-03\") & getMillis(e.ts) < getMillis(\"2024-01-10\") solve 'h g := r where dateHour(r.ts) = 'h "
        "{hour: 'h, views: count(g.event_type where g.event_type = \"view\"), clicks: count(g.event_type where g.event_type = \"click\"), buys: count(g.event_type where g.event_type = \"purchase\"), "
        "total: count(g.event_type), users: count(distinct(g.user_id where g.event_type = \"purchase\"))}",
        "select strftime(ts, '%Y-%m-%dT%H') as hour, count(case when event_type = 'view' then 1 end) as views, count(case when event_type = 'click' then 1 end) as clicks, count(case when event_type = 'purchase' then 1 end) as buys, "
        "count(event_type) as total, count(distinct case when event_type = 'purchase' then user_id end) as users from events where ts >= timestamp '2024-01-03 00:00:00.001' and ts < timestamp '2024-01-10' group by 1",
    ),
    # --- functions of whole sets inside a solve run for each key ---------------------------------------------
    "solve_distinct": ("l := //lineitem solve 's g := l where l.l_suppkey = 's {s: 's, parts: count(distinct(g.l_partkey)), qty: sum(distinct(g.l_quantity)), n: count(g)}", "select l_suppkey as s, count(distinct l_partkey) as parts, sum(distinct l_quantity) as qty, count(*) as n from lineitem group by 1"),
    "solve_distinct_values": ("l := //lineitem solve 'f g := l where l.l_returnflag = 'f {f: 'f, n: distinct(g.l_linenumber)}", "select distinct l_returnflag as f, cast(l_linenumber as bigint) as n from lineitem"),
    "solve_new": ("o := //orders solve 'c g := o where o.o_custkey = 'c {c: 'c, n: count(new g.o_totalprice)}", "select o_custkey as c, count(o_totalprice) as n from orders group by 1"),
    "solve_mode": (
        "l := //lineitem solve 's g := l where l.l_suppkey = 's {s: 's, m: mode(g.l_linenumber)}",
        "with c as (select l_suppkey as s, l_linenumber as m, count(*) as n from lineitem group by 1, 2) select s, cast(m as bigint) as m from c where n = (select max(n) from c d where d.s = c.s)",
    ),
    "solve_rank": (
        "import std::stats::* o := //orders solve 'c g := o where o.o_custkey = 'c {k: g.o_orderkey, r: rank(g.o_orderstatus), d: denseRank(g.o_orderstatus), i: indexedRank(g.o_orderstatus)}",
        "select o_orderkey as k, rank() over w - 1 as r, dense_rank() over w - 1 as d, row_number() over (partition by o_custkey order by o_orderstatus, o_orderkey) - 1 as i from orders window w as (partition by o_custkey order by o_orderstatus)",
    ),
    "solve_dummy": ("import std::stats::* n := //nation solve 'r g := n where n.n_regionkey = 'r d := dummy(g.n_nationkey) {k: g.n_nationkey, a: d[0], b: d[1]}", "select cast(n_nationkey as bigint) as k, cast(i = 1 as bigint) as a, cast(i = 2 as bigint) as b from (select n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation)"),
    "solve_smoothing": (
        "import std::math::* import std::stats::* o := //orders solve 'c g := o where o.o_custkey = 'c {k: g.o_orderkey, s: roundTo(simpleExpSmoothing({by: g.o_orderkey, smooth: g.o_totalprice * 0.31830988618379}, 0.3), 3), d: roundTo(doubleExpSmoothing({by: g.o_orderkey, smooth: g.o_totalprice * 0.31830988618379}, {alpha: 0.4, beta: 0.2}), 3)}",
        "with recursive o as (select row_number() over w as i, lead(o_totalprice * 0.31830988618379::double) over w as nx, o_custkey as c, o_orderkey as k, o_totalprice * 0.31830988618379::double as x from orders window w as (partition by o_custkey order by o_orderkey)), "
        "s as (select i, c, k, x as s, x as d, coalesce(nx - x, 0) as b from o where i = 1 union all select o.i, o.c, o.k, 0.3::double * o.x + 0.7::double * s.s, 0.4::double * o.x + 0.6::double * (s.d + s.b), "
        "0.2::double * (0.4::double * o.x + 0.6::double * (s.d + s.b) - s.d) + 0.8::double * s.b from s join o on o.c = s.c and o.i = s.i + 1) select k, floor(s * 1e3 + 0.5) / 1e3 as s, floor(d * 1e3 + 0.5) / 1e3 as d from s",
    ),
    "solve_regression": (
        "import std::math::* import std::stats::* l := //lineitem solve 'f g := l where l.l_returnflag = 'f m := linearRegression(g.l_extendedprice, {q: g.l_quantity}) c := m.model1.coefficients {f: 'f, q: roundTo(c[0].q.estimate, 3), i: roundTo(c[1].estimate, 1), r: roundTo(m.model1.RSquared, 6)}",
        "select l_returnflag as f, floor(regr_slope(l_extendedprice, l_quantity) * 1e3 + 0.5) / 1e3 as q, floor(regr_intercept(l_extendedprice, l_quantity) * 10 + 0.5) / 10 as i, floor(regr_r2(l_extendedprice, l_quantity) * 1e6 + 0.5) / 1e6 as r from lineitem group by 1",
    ),
    "solve_union": ("n := //nation solve 'r g := n where n.n_regionkey = 'r {r: 'r, n: count(distinct(g.n_name union (//region).r_name))}", "select cast(n_regionkey as bigint) as r, count(distinct n_name) + (select count(distinct r_name) from region) as n from nation group by 1"),
    "solve_nested": ("o := //orders solve 'p g := o where o.o_orderpriority = 'p solve 's h := g where g.o_orderstatus = 's {p: 'p, s: 's, n: count(h)}", "select o_orderpriority as p, o_orderstatus as s, count(*) as n from orders group by 1, 2"),
    "solve_nested_reduced": (
        "o := //orders solve 'p g := o where o.o_orderpriority = 'p per := solve 'c {c: 'c, n: count(g where g.o_custkey = 'c)} {p: 'p, customers: count(per), most: max(per.n)}",
        "select p, count(*) as customers, max(n) as most from (select o_orderpriority as p, o_custkey as c, count(*) as n from orders group by 1, 2) group by 1",
    ),
    "solve_whole_group": ("n := //nation solve 'r g := n where n.n_regionkey = 'r g", "select cast(n_nationkey as bigint) as n_nationkey, n_name, cast(n_regionkey as bigint) as n_regionkey from nation"),
    "solve_sliding_window": (
        "import std::stats::* o := //orders t := o with {i: indexedRank(o.o_orderkey)} u := new t  t ~ u {k: t.o_orderkey, step: u.o_totalprice - t.o_totalprice} where u.i = t.i + 1",
        "select * from (select o_orderkey as k, lead(o_totalprice) over (order by o_orderkey) - o_totalprice as step from orders) where step is not null",
    ),
    # --- ranks, order, options ---------------------------------------------------------------------------
    "rank": ("import std::stats::* o := //orders {k: o.o_orderkey, r: rank(o.o_custkey)}", "select o_orderkey as k, rank() over (order by o_custkey) - 1 as r from orders"),
    "dense_rank": ("import std::stats::* o := //orders {k: o.o_orderkey, r: denseRank(o.o_custkey)}", "select o_orderkey as k, dense_rank() over (order by o_custkey) - 1 as r from orders"),
    "indexed_rank": ("import std::stats::* o := //orders {k: o.o_orderkey, r: indexedRank(o.o_orderkey)}", "select o_orderkey as k, row_number() over (order by o_orderkey) - 1 as r from orders"),
    "rank_text": ("import std::stats::* n := //nation {k: n.n_nationkey, r: rank(n.n_name)}", "select cast(n_nationkey as bigint) as k, rank() over (order by n_name) - 1 as r from nation"),
    "top_k": ("import std::stats::* o := //orders o.o_orderkey where rank(neg o.o_totalprice) < 5", "select o_orderkey as value from (select o_orderkey, rank() over (order by -o_totalprice) - 1 as r from orders) where r < 5"),
    "dummy": ("import std::stats::* r := //region d := dummy(r.r_regionkey) {k: r.r_regionkey, a: d[0], b: d[1]}", "select cast(r_regionkey as bigint) as k, cast(r_regionkey = 0 as bigint) as a, cast(r_regionkey = 1 as bigint) as b from region"),
    "options_sort_page": ("o := //orders {k: o.o_orderkey, t: o.o_totalprice}", "select o_orderkey as k, o_totalprice as t from orders order by t desc, k desc limit 10 offset 5", {"sort_on": ["t", "k"], "descending": True, "limit": 10, "skip": 5}),
    "smoothing_simple": (  # beyond 200 steps back, a value weighs less than a double's last digit
        "import std::math::* import std::stats::* o := //orders {k: o.o_orderkey, s: roundTo(simpleExpSmoothing({by: o.o_orderkey, smooth: o.o_totalprice * 0.31830988618379}, 0.3), 3)}",
        "with o as (select row_number() over (order by o_orderkey) as i, o_orderkey as k, o_totalprice * 0.31830988618379::double as x from orders) "
        "select a.k, floor(sum(case when b.i = 1 then 1 else 0.3::double end * 0.7::double ** (a.i - b.i) * b.x) * 1e3 + 0.5) / 1e3 as s from o a join o b on b.i between a.i - 200 and a.i group by a.k",
    ),
    "smoothing_double": (
        "import std::math::* import std::stats::* n := //nation {k: n.n_nationkey, s: roundTo(doubleExpSmoothing({by: n.n_nationkey, smooth: n.n_regionkey}, {alpha: 0.4, beta: 0.2}), 6)}",
        "with recursive o as (select row_number() over (order by n_nationkey) as i, n_nationkey as k, n_regionkey * 1.0::double as x from nation), s as (select a.i, a.k, a.x as s, b.x - a.x as b from o a join o b on a.i = 1 and b.i = 2 union all "
        "select o.i, o.k, 0.4::double * o.x + 0.6::double * (s.s + s.b), 0.2::double * (0.4::double * o.x + 0.6::double * (s.s + s.b) - s.s) + 0.8::double * s.b from s join o on o.i = s.i + 1) select cast(k as bigint) as k, floor(s * 1e6 + 0.5) / 1e6 as s from s",
    ),
    # --- bivariate statistics, models ------------------------------------------------------------------------
    "corr": ("import std::math::* import std::stats::* l := //lineitem roundTo(corr(l.l_quantity, l.l_extendedprice), 8)", "select floor(corr(l_quantity, l_extendedprice) * 1e8 + 0.5) / 1e8 as value from lineitem"),
    "corr_constant_is_empty": ("import std::stats::* l := //lineitem corr(l.l_quantity, l.l_quantity * 0)", "select cast(null as double) as value where false"),
    "cov": ("import std::math::* import std::stats::* l := //lineitem roundTo(cov(l.l_quantity, l.l_extendedprice), 2)", "select floor(covar_pop(l_quantity, l_extendedprice) * 100 + 0.5) / 100 as value from lineitem"),
    "lin_reg": ("import std::math::* import std::stats::* l := //lineitem r := linReg(l.l_quantity, l.l_extendedprice) {slope: roundTo(r.slope, 4), intercept: roundTo(r.intercept, 2)}", "select floor(regr_slope(l_extendedprice, l_quantity) * 1e4 + 0.5) / 1e4 as slope, floor(regr_intercept(l_extendedprice, l_quantity) * 100 + 0.5) / 100 as intercept from lineitem"),
    "log_reg": ("import std::math::* import std::stats::* l := //lineitem r := logReg(l.l_quantity, l.l_extendedprice) {slope: roundTo(r.slope, 3), intercept: roundTo(r.intercept, 2)}", "select floor(regr_slope(l_extendedprice, ln(l_quantity)) * 1e3 + 0.5) / 1e3 as slope, floor(regr_intercept(l_extendedprice, ln(l_quantity)) * 100 + 0.5) / 100 as intercept from lineitem where l_quantity > 0"),
    "grouped_corr": ("import std::math::* import std::stats::* l := //lineitem solve 'f g := l where l.l_returnflag = 'f {f: 'f, c: roundTo(corr(g.l_quantity, g.l_extendedprice), 6)}", "select l_returnflag as f, floor(corr(l_quantity, l_extendedprice) * 1e6 + 0.5) / 1e6 as c from lineitem group by 1"),
    "single_summary": ("import std::math::* s := singleSummary((//lineitem).l_quantity) {n: s.count, lo: s.min, hi: s.max, m: roundTo(s.mean, 6), d: roundTo(s.stdDev, 6)}", "select count(l_quantity) as n, min(l_quantity) as lo, max(l_quantity) as hi, floor(avg(l_quantity) * 1e6 + 0.5) / 1e6 as m, floor(stddev_pop(l_quantity) * 1e6 + 0.5) / 1e6 as d from lineitem"),
    "summary_leaves": ("import std::math::* l := //lineitem s := summary({q: l.l_quantity, p: {t: l.l_tax}}) {a: s.model1.q.count, b: roundTo(s.model1.p.t.mean, 6)}", "select count(*) as a, floor(avg(l_tax) * 1e6 + 0.5) / 1e6 as b from lineitem"),
    "normalize": ("import std::math::* import std::stats::* l := //orders d := {p: l.o_totalprice} n := normalize(d, summary(d)) {k: l.o_orderkey, z: roundTo(n.p, 6)}", "select o_orderkey as k, floor((o_totalprice - (select avg(o_totalprice) from orders)) / (select stddev_pop(o_totalprice) from orders) * 1e6 + 0.5) / 1e6 as z from orders"),
    "denormalize": ("import std::math::* import std::stats::* l := //orders d := {p: l.o_totalprice} s := summary(d) n := denormalize(normalize(d, s), s) {k: l.o_orderkey, z: roundTo(n.p, 2)}", "select o_orderkey as k, floor(o_totalprice * 100 + 0.5) / 100 as z from orders"),
    "linear_regression": (
        "import std::math::* import std::stats::* l := //lineitem m := linearRegression(l.l_extendedprice, {q: l.l_quantity}) c := m.model1.coefficients {q: roundTo(c[0].q.estimate, 3), i: roundTo(c[1].estimate, 1), r: roundTo(m.model1.RSquared, 6)}",
        "select floor(regr_slope(l_extendedprice, l_quantity) * 1e3 + 0.5) / 1e3 as q, floor(regr_intercept(l_extendedprice, l_quantity) * 10 + 0.5) / 10 as i, floor(regr_r2(l_extendedprice, l_quantity) * 1e6 + 0.5) / 1e6 as r from lineitem",
    ),
    "predict_linear_bands": (  # half widths, without the quantile: their squares differ by the residual variance
        "import std::math::* import std::stats::* l := //lineitem m := linearRegression(l.l_extendedprice, {q: l.l_quantity}) p := predictLinear({q: l.l_quantity}, m) "
        "c := p.model1.confidenceInterval w := p.model1.predictionInterval {k: l.l_orderkey, mid: roundTo((c[0] + c[1]) / 2, 1), ratio: roundTo((((w[1] - w[0]) ^ 2) - ((c[1] - c[0]) ^ 2)) / ((c[1] - c[0]) ^ 2), 0)}",
        "with f as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b, count(*) as n, avg(l_quantity) as mx, regr_sxx(l_extendedprice, l_quantity) as sxx from lineitem) "
        "select l_orderkey as k, floor((l_quantity * a + b) * 10 + 0.5) / 10 as mid, floor(1 / (1 / n + (l_quantity - mx) ** 2 / sxx) + 0.5) as ratio from lineitem, f",
    ),
    "predict_linear": (
        "import std::math::* import std::stats::* l := //lineitem m := linearRegression(l.l_extendedprice, {q: l.l_quantity}) p := predictLinear({q: l.l_quantity}, m) {k: l.l_orderkey, f: roundTo(p.model1.fit, 1)}",
        "select l_orderkey as k, floor((l_quantity * (select regr_slope(l_extendedprice, l_quantity) from lineitem) + (select regr_intercept(l_extendedprice, l_quantity) from lineitem)) * 10 + 0.5) / 10 as f from lineitem",
    ),
    "logistic_regression": ('import std::stats::* l := //lineitem m := logisticRegression(if l.l_returnflag = "A" then 1 else 0, {q: l.l_quantity, d: l.l_discount}) c := m.model1.coefficients {q: c[0].q.estimate, d: c[0].d.estimate, i: c[1].estimate}', None),
    "predict_logistic": ('import std::stats::* l := //lineitem m := logisticRegression(if l.l_quantity > 25 then 1 else 0, {t: l.l_extendedprice / 1000}) p := predictLogistic({t: l.l_extendedprice / 1000}, m) {k: l.l_orderkey, f: p.model1.fit}', None),
    "logistic_gradient": (  # at the optimum the gradient vanishes
        'import std::math::* import std::stats::* l := //lineitem y := if l.l_returnflag = "A" then 1 else 0 m := logisticRegression(y, {q: l.l_quantity, d: l.l_discount}) e := y - predictLogistic({q: l.l_quantity, d: l.l_discount}, m).model1.fit '
        "{n: count(e), c: abs(sum(e)) < 0.001, q: abs(sum(e * l.l_quantity)) < 0.01, d: abs(sum(e * l.l_discount)) < 0.001}",
        "select count(*) as n, true as c, true as q, true as d from lineitem",
    ),
    "k_medians": ("import std::stats::* e := //embeddings v := e.embedding m := kMedians({a: v[0], b: v[1]}, 3) {c: m.model1.cluster1, d: m.model1.cluster2}", None),
    "assign_clusters": ("import std::stats::* e := //embeddings f := {a: e.embedding[0], b: e.embedding[1]} m := kMedians(f, 3) x := assignClusters(f, m) {k: e.vec_id, c: x.model1.clusterId}", None),
    "rf_classification": ("import std::stats::* e := //embeddings f := {a: e.embedding[0], b: e.embedding[1]} r := rfClassification({predictors: f, dependent: e.label}, f) {k: e.vec_id, y: r.model1}", None),
    "rf_regression": ("import std::stats::* l := //orders f := {a: l.o_custkey} r := rfRegression({predictors: f, dependent: l.o_totalprice}, f) {k: l.o_orderkey, y: r.model1}", None),
    # --- arrays, sampling ---------------------------------------------------------------------------------------
    "flatten": ("e := //embeddings f := flatten(e.embedding) {k: e.vec_id, x: f}", "select vec_id as k, cast(unnest(embedding) as double) as x from embeddings"),
    "flatten_count": ("count(flatten((//embeddings).embedding))", "select cast(sum(len(embedding)) as bigint) as value from embeddings"),
    "array_equality": ("a := [1, 2] n := //nation count(n where [n.n_regionkey, n.n_regionkey + 1] = a)", "select count(*) as value from nation where n_regionkey = 1"),
    "observe_uniform": ("o := //orders r := observe(o, std::random::uniform(42)) {k: o.o_orderkey, u: r}", None),
    "observe_in_range": (
        "import std::math::* o := //orders r := observe(o, std::random::uniform(7)) {n: count(r), different: count(distinct(r)), inside: forall(r >= 0 & r < 1), middle: abs(mean(r) - 0.5) < 0.02, spread: abs(variance(r) - 1 / 12) < 0.01}",
        "select count(*) as n, count(*) as different, true as inside, true as middle, true as spread from orders",
    ),
    "schema_types": ("import std::type::* c := //customer {a: isNumber(c.c_custkey), b: isString(c.c_name), c: isNull(c.c_name), d: isObject(c), e: isArray(c.c_name), f: isBoolean(c.c_name = \"x\")}", "select true as a, true as b, false as c, true as d, false as e, true as f from customer"),
    # --- infix and mathematics ---------------------------------------------------------------------------------------
    "infix_arithmetic": (
        "l := //lineitem {k: l.l_orderkey, a: l.l_linenumber + l.l_suppkey, s: l.l_linenumber - l.l_suppkey, m: l.l_linenumber * l.l_suppkey, d: l.l_linenumber / l.l_suppkey, n: neg l.l_linenumber}",
        "select l_orderkey as k, l_linenumber + l_suppkey as a, l_linenumber - l_suppkey as s, l_linenumber * l_suppkey as m, l_linenumber / l_suppkey as d, cast(-l_linenumber as bigint) as n from lineitem where l_suppkey <> 0",
    ),
    "infix_mod_sign": (
        "n := //nation x := n.n_nationkey - 12 {k: n.n_nationkey, a: x % 5, b: (neg x) % 5, c: x % neg 5}",
        "with t as (select cast(n_nationkey as bigint) as k, cast(n_nationkey - 12 as bigint) as x from nation) select k, case when x < 0 then x % 5 + 5 else x % 5 end as a, case when -x < 0 then -x % 5 + 5 else -x % 5 end as b, case when x > 0 then x % -5 - 5 else x % -5 end as c from t",
    ),
    "infix_pow_compare": ("n := //nation k := n.n_nationkey {k: k, p: k ^ 2, lt: k < 5, ge: k >= 20, ne: k != 3}", "select cast(n_nationkey as bigint) as k, cast(n_nationkey as double) ** 2 as p, n_nationkey < 5 as lt, n_nationkey >= 20 as ge, n_nationkey <> 3 as ne from nation"),
    "math_trig": (
        "import std::math::* n := //nation x := n.n_nationkey / 10 {k: n.n_nationkey, a: roundTo(sin(x), 9), b: roundTo(cos(x), 9), c: roundTo(tan(x), 6), d: roundTo(atan(x), 9), e: roundTo(sinh(x), 6), f: roundTo(cosh(x), 6), g: roundTo(tanh(x), 9)}",
        "with t as (select cast(n_nationkey as bigint) as k, n_nationkey / 10 as x from nation) select k, floor(sin(x) * 1e9 + 0.5) / 1e9 as a, floor(cos(x) * 1e9 + 0.5) / 1e9 as b, floor(tan(x) * 1e6 + 0.5) / 1e6 as c, floor(atan(x) * 1e9 + 0.5) / 1e9 as d, floor(sinh(x) * 1e6 + 0.5) / 1e6 as e, floor(cosh(x) * 1e6 + 0.5) / 1e6 as f, floor(tanh(x) * 1e9 + 0.5) / 1e9 as g from t",
    ),
    "math_inverse_domain": (
        "import std::math::* n := //nation x := n.n_nationkey / 10 - 1 {k: n.n_nationkey, a: roundTo(asin(x), 9), b: roundTo(acos(x), 9)}",
        "with t as (select cast(n_nationkey as bigint) as k, n_nationkey / 10 - 1 as x from nation) select k, floor(asin(x) * 1e9 + 0.5) / 1e9 as a, floor(acos(x) * 1e9 + 0.5) / 1e9 as b from t where x between -1 and 1",
    ),
    "math_logs": (
        "import std::math::* n := //nation x := n.n_nationkey {k: x, a: roundTo(log(x), 9), b: roundTo(log10(x), 9), c: roundTo(log1p(x), 9), d: roundTo(exp(x / 10), 6), e: roundTo(expm1(x / 10), 6)}",
        "with t as (select n_nationkey as x from nation where n_nationkey > 0) select cast(x as bigint) as k, floor(ln(x) * 1e9 + 0.5) / 1e9 as a, floor(log10(x) * 1e9 + 0.5) / 1e9 as b, floor(ln(1 + x) * 1e9 + 0.5) / 1e9 as c, floor(exp(x / 10) * 1e6 + 0.5) / 1e6 as d, floor((exp(x / 10) - 1) * 1e6 + 0.5) / 1e6 as e from t",
    ),
    "math_roots_domain": ("import std::math::* n := //nation x := n.n_nationkey - 12 {k: n.n_nationkey, r: roundTo(sqrt(x), 9), c: roundTo(cbrt(x), 9)}", "select cast(n_nationkey as bigint) as k, floor(sqrt(n_nationkey - 12) * 1e9 + 0.5) / 1e9 as r, floor(cbrt(n_nationkey - 12) * 1e9 + 0.5) / 1e9 as c from nation where n_nationkey >= 12"),
    "math_rounding": (
        "import std::math::* n := //nation x := (n.n_nationkey - 12) / 4 {k: n.n_nationkey, c: ceil(x), f: floor(x), r: round(x), i: rint(x), a: abs(x), s: signum(x), t: roundTo(x, 1)}",
        "with t as (select cast(n_nationkey as bigint) as k, (n_nationkey - 12) / 4 as x from nation) select k, ceil(x) as c, floor(x) as f, floor(x + 0.5) as r, case when abs(x - floor(x) - 0.5) < 1e-12 then 2 * floor((x + 0.5) / 2) else floor(x + 0.5) end as i, abs(x) as a, cast(sign(x) as double) as s, floor(x * 10 + 0.5) / 10 as t from t",
    ),
    "math_binary": (
        "import std::math::* n := //nation x := n.n_nationkey y := n.n_regionkey - 2 {k: x, a: minOf(x, y), b: maxOf(x, y), h: roundTo(hypot(x, y), 9), t: roundTo(atan2(x, y), 9), s: copySign(x, y), p: pow(x, 2), m: std::math::max(x, 3), l: std::math::min(x, 3)}",
        "with t as (select cast(n_nationkey as double) as x, cast(n_regionkey - 2 as double) as y from nation) select cast(x as bigint) as k, least(x, y) as a, greatest(x, y) as b, floor(sqrt(x * x + y * y) * 1e9 + 0.5) / 1e9 as h, floor(atan2(x, y) * 1e9 + 0.5) / 1e9 as t, case when y < 0 then -x else x end as s, x * x as p, greatest(x, 3) as m, least(x, 3) as l from t",
    ),
    "math_angles": ("import std::math::* n := //nation x := n.n_nationkey {k: x, d: roundTo(toDegrees(x), 6), r: roundTo(toRadians(x), 9), e: IEEEremainder(x, 7)}", "select cast(n_nationkey as bigint) as k, floor(degrees(n_nationkey) * 1e6 + 0.5) / 1e6 as d, floor(radians(n_nationkey) * 1e9 + 0.5) / 1e9 as r, cast(n_nationkey - 7 * round(n_nationkey / 7) as double) as e from nation"),
    "math_exponent_ulp": ("import std::math::* n := //nation x := n.n_nationkey {k: x, e: getExponent(x), u: ulp(x)}", "with t as (select n_nationkey as x from nation where n_nationkey > 0) select cast(x as bigint) as k, floor(log2(x) + 1e-12) as e, 2.0 ** (floor(log2(x) + 1e-12) - 52) as u from t"),
    # --- strings ------------------------------------------------------------------------------------------------------------
    "string_case": ("import std::string::* p := //part {k: p.p_partkey, u: toUpperCase(p.p_name), l: toLowerCase(p.p_brand), t: trim(concat(\"  \", p.p_name)), n: length(p.p_name), e: isEmpty(p.p_name), i: intern(p.p_name)}", "select p_partkey as k, upper(p_name) as u, lower(p_brand) as l, trim(p_name) as t, length(p_name) as n, p_name = '' as e, p_name as i from part"),
    "string_compare": (
        'import std::string::* p := //part {k: p.p_partkey, a: equals(p.p_brand, "Brand#11"), b: equalsIgnoreCase(p.p_brand, "BRAND#11"), c: startsWith(p.p_brand, "Brand#1"), d: endsWith(p.p_brand, "1"), e: compare(p.p_brand, "Brand#11")}',
        "select p_partkey as k, p_brand = 'Brand#11' as a, lower(p_brand) = 'brand#11' as b, starts_with(p_brand, 'Brand#1') as c, suffix(p_brand, '1') as d, "
        "cast(case when p_brand = 'Brand#11' then 0 when p_brand[7] <> '1' then ord(p_brand[7]) - ord('1') when length(p_brand) >= 8 and p_brand[8] <> '1' then ord(p_brand[8]) - ord('1') else length(p_brand) - 8 end as bigint) as e from part",
    ),
    "string_cut": (
        "import std::string::* n := //nation s := n.n_name {k: n.n_nationkey, a: takeLeft(s, 3), b: takeRight(s, 3), c: dropLeft(s, 2), d: dropRight(s, 2), e: takeLeft(s, 100)}",
        "select cast(n_nationkey as bigint) as k, left(n_name, 3) as a, right(n_name, 3) as b, substr(n_name, 3) as c, left(n_name, greatest(length(n_name) - 2, 0)) as d, n_name as e from nation",
    ),
    "string_search": (
        'import std::string::* n := //nation s := n.n_name {k: n.n_nationkey, a: indexOf(s, "N"), b: lastIndexOf(s, "N"), c: codePointAt(s, 1), d: codePointBefore(s, 2), e: editDistance(s, "NATION")}',
        "select cast(n_nationkey as bigint) as k, instr(n_name, 'N') - 1 as a, case when instr(n_name, 'N') = 0 then -1 else length(n_name) - instr(reverse(n_name), 'N') end as b, cast(ord(n_name[2]) as bigint) as c, cast(ord(n_name[2]) as bigint) as d, levenshtein(n_name, 'NATION') as e from nation",
    ),
    "string_regex": (
        'import std::string::* p := //part {k: p.p_partkey, m: matches(p.p_brand, "Brand#[0-9]+"), d: regexMatch(p.p_brand, "(Brand)#([0-9])[0-9]*")[1]}',
        "select p_partkey as k, regexp_full_match(p_brand, 'Brand#[0-9]+') as m, regexp_extract(p_brand, '(Brand)#([0-9])[0-9]*', 2) as d from part where regexp_full_match(p_brand, 'Brand#[0-9][0-9]*')",
    ),
    "string_split": ('import std::string::* e := //events p := split(e.props, ":") {k: e.event_id, a: p[0], q: splitRegex(e.props, "[:}]")[1]}', "select event_id as k, string_split(props, ':')[1] as a, regexp_split_to_array(props, '[:}]')[2] as q from events"),
    "string_numbers": (
        "import std::string::* n := //nation {k: n.n_nationkey, s: numToString(n.n_nationkey), p: parseNum(numToString(n.n_nationkey / 4)), bad: count(parseNum(n.n_name))}",
        "select cast(n_nationkey as bigint) as k, cast(n_nationkey as varchar) as s, n_nationkey / 4 as p, cast(0 as bigint) as bad from nation",
    ),
    # --- time -----------------------------------------------------------------------------------------------------------------
    "time_fractions": (
        "import std::time::* e := //events t := e.ts {k: e.event_id, a: year(t), b: quarter(t), c: monthOfYear(t), d: weekOfYear(t), e: dayOfYear(t), f: dayOfMonth(t), g: dayOfWeek(t), h: hourOfDay(t), i: minuteOfHour(t), j: secondOfMinute(t), m: millisOfSecond(t)}",
        "select event_id as k, year(ts) as a, quarter(ts) as b, month(ts) as c, weekofyear(ts) as d, dayofyear(ts) as e, day(ts) as f, isodow(ts) as g, hour(ts) as h, minute(ts) as i, second(ts) as j, cast(floor(epoch_us(ts) / 1000) as bigint) % 1000 as m from events",
    ),
    "time_forms": (
        "import std::time::* e := //events t := e.ts {k: e.event_id, a: date(t), b: yearMonth(t), c: yearDayOfYear(t), d: monthDay(t), e: dateHour(t), f: dateHourMinute(t), g: dateHourMinuteSecond(t), h: hourMinute(t), i: hourMinuteSecond(t), j: dateHourMin(t), l: hourMin(t)}",
        "select event_id as k, strftime(ts, '%Y-%m-%d') as a, strftime(ts, '%Y-%m') as b, strftime(ts, '%Y-%j') as c, strftime(ts, '%m-%d') as d, strftime(ts, '%Y-%m-%dT%H') as e, strftime(ts, '%Y-%m-%dT%H:%M') as f, strftime(ts, '%Y-%m-%dT%H:%M:%S') as g, strftime(ts, '%H:%M') as h, strftime(ts, '%H:%M:%S') as i, strftime(ts, '%Y-%m-%dT%H:%M') as j, strftime(ts, '%H:%M') as l from events",
    ),
    "time_millis_forms": (
        "import std::time::* e := //events t := e.ts {k: e.event_id, a: dateHourMinuteSecondMillis(t), b: timeWithoutZone(t), c: timeWithZone(t), z: timeZone(t), m: getMillis(t)}",
        "with x as (select event_id, ts, lpad(cast(cast(floor(epoch_us(ts) / 1000) as bigint) % 1000 as varchar), 3, '0') as ms from events) select event_id as k, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || ms as a, strftime(ts, '%H:%M:%S.') || ms as b, strftime(ts, '%H:%M:%S.') || ms || '+00:00' as c, '+00:00' as z, cast(floor(epoch_us(ts) / 1000) as bigint) as m from x",
    ),
    "time_plus": (
        "import std::time::* o := //orders d := o.o_orderdate {k: o.o_orderkey, y: date(yearsPlus(d, 1)), m: date(monthsPlus(d, 1)), w: date(weeksPlus(d, 1)), d: date(daysPlus(d, 31)), h: dateHour(hoursPlus(d, 5)), n: dateHourMinute(minutesPlus(d, 90)), s: dateHourMinuteSecond(secondsPlus(d, 61)), i: getMillis(millisPlus(d, 7))}",
        "select o_orderkey as k, strftime(o_orderdate + interval 1 year, '%Y-%m-%d') as y, strftime(o_orderdate + interval 1 month, '%Y-%m-%d') as m, strftime(o_orderdate + interval 7 day, '%Y-%m-%d') as w, strftime(o_orderdate + interval 31 day, '%Y-%m-%d') as d, strftime(o_orderdate + interval 5 hour, '%Y-%m-%dT%H') as h, strftime(o_orderdate + interval 90 minute, '%Y-%m-%dT%H:%M') as n, strftime(o_orderdate + interval 61 second, '%Y-%m-%dT%H:%M:%S') as s, epoch_ms(o_orderdate) + 7 as i from orders",
    ),
    "time_between": (
        "import std::time::* e := //events a := e.ts b := minTime(e.ts) {k: e.event_id, w: weeksBetween(b, a), d: daysBetween(b, a), h: hoursBetween(b, a), m: minutesBetween(b, a), s: secondsBetween(a, b)}",
        "with x as (select event_id as k, epoch_us(ts) - (select min(epoch_us(ts)) from events) as u from events) select k, u // 604800000000 as w, u // 86400000000 as d, u // 3600000000 as h, u // 60000000 as m, -(u // 1000000) as s from x",
    ),
    "time_between_calendar": (
        "import std::time::* o := //orders a := minTime(o.o_orderdate) b := o.o_orderdate {k: o.o_orderkey, y: yearsBetween(a, b), m: monthsBetween(a, b), i: millisBetween(a, b)}",
        "with x as (select o_orderkey, o_orderdate as b, (select min(o_orderdate) from orders) as a from orders) select o_orderkey as k, datesub('year', a, b) as y, datesub('month', a, b) as m, epoch_ms(b) - epoch_ms(a) as i from x",
    ),
    "time_old_names": (
        "import std::time::* e := //events t := e.ts {k: e.event_id, a: dateHourMinSec(t), b: dateHourMinSecMilli(t), c: hourMinSec(t)}",
        "with x as (select event_id, ts, lpad(cast(cast(floor(epoch_us(ts) / 1000) as bigint) % 1000 as varchar), 3, '0') as ms from events) select event_id as k, strftime(ts, '%Y-%m-%dT%H:%M:%S') as a, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || ms as b, strftime(ts, '%H:%M:%S') as c from x",
    ),
    "time_fuzzy": ('import std::time::* import std::string::* o := //orders s := concat(date(o.o_orderdate), " 10:30:00") {k: o.o_orderkey, a: dateHourMinute(parseDateTimeFuzzy(s))}', "select o_orderkey as k, strftime(o_orderdate, '%Y-%m-%dT') || '10:30' as a from orders"),
    "string_compare_old": (
        'import std::string::* p := //part {k: p.p_partkey, a: compareTo(p.p_brand, "Brand#11"), b: compareIgnoreCase(p.p_brand, "BRAND#11"), c: compareToIgnoreCase(p.p_brand, "BRAND#11")}',
        "with t as (select p_partkey as k, cast(case when p_brand = 'Brand#11' then 0 when p_brand[7] <> '1' then ord(p_brand[7]) - ord('1') when length(p_brand) >= 8 and p_brand[8] <> '1' then ord(p_brand[8]) - ord('1') else length(p_brand) - 8 end as bigint) as e from part) select k, e as a, e as b, e as c from t",
    ),
    "time_season": ("import std::time::* o := //orders {k: o.o_orderkey, s: season(o.o_orderdate)}", "select o_orderkey as k, case when dayofyear(o_orderdate) >= 79 and dayofyear(o_orderdate) < 171 then 'spring' when dayofyear(o_orderdate) >= 171 and dayofyear(o_orderdate) < 265 then 'summer' when dayofyear(o_orderdate) >= 265 and dayofyear(o_orderdate) < 355 then 'fall' else 'winter' end as s from orders"),
    "time_parse": (
        'import std::time::* import std::string::* o := //orders s := date(o.o_orderdate) t := parseDateTime(s, "yyyy-MM-dd") {k: o.o_orderkey, same: getMillis(t) = getMillis(s), z: timeZone(concat(s, "T10:00:00+02:00")), h: hourOfDay(concat(s, "T10:00:00+02:00"))}',
        "select o_orderkey as k, true as same, '+02:00' as z, cast(10 as bigint) as h from orders",
    ),
    "time_zones": ('import std::time::* e := //events t := changeTimeZone(e.ts, "-05:00") {k: e.event_id, h: hourOfDay(t), same: getMillis(t) = getMillis(e.ts), w: weekOfMonth(e.ts), i: hourOfDay(millisToISO(getMillis(e.ts), "+03:00"))}', "select event_id as k, hour(ts - interval 5 hour) as h, true as same, cast(floor((day(ts) + isodow(date_trunc('month', ts)) - 1) / 7) + 1 as bigint) as w, hour(ts + interval 3 hour) as i from events"),
    "time_min_max_of": ("import std::time::* o := //orders {k: o.o_orderkey, a: date(minTimeOf(o.o_orderdate, \"1995-01-01\")), b: date(maxTimeOf(o.o_orderdate, \"1995-01-01\"))}", "select o_orderkey as k, strftime(least(o_orderdate, timestamp '1995-01-01'), '%Y-%m-%d') as a, strftime(greatest(o_orderdate, timestamp '1995-01-01'), '%Y-%m-%d') as b from orders"),
    "time_range": ('import std::time::* o := //orders r := range({start: o.o_orderdate, end: daysPlus(o.o_orderdate, 10), step: "P3D"}) f := flatten(r) {k: o.o_orderkey, d: date(f)}', "select o_orderkey as k, strftime(unnest(range(o_orderdate, o_orderdate + interval 10 day + interval 1 microsecond, interval 3 day)), '%Y-%m-%d') as d from orders"),
}


def _runner(spec: tuple) -> Callable[[SparkSession, str], DataFrame]:
    options = spec[2] if len(spec) > 2 else {}
    return lambda spark, d: run(spark, d, spec[0], **options)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"q_{n}": _runner(s) for n, s in SPECS.items()}
ORACLE: dict[str, str] = {f"q_{n}": s[1] for n, s in SPECS.items() if s[1]}


# --- operators on tables and streams -------------------------------------------------------------


def _cogroup(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return tables.cogroup(c, o, ["k"], lambda: F.lit(0).cast("bigint"), lambda: F.lit(-1).cast("bigint"), lambda: F.col("n"), "n")


def _align(spark: SparkSession, d: str) -> DataFrame:
    """Both halves of the pair, told apart by side."""
    a, b = tables.align(table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v")), ["k"])
    return a.withColumn("side", F.lit("left")).unionByName(b.withColumn("side", F.lit("right")))


def _group_by_n(spark: SparkSession, d: str) -> DataFrame:
    """The place of each row in both of two orders of one table."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    by_name, by_key = tables.group_by_n(n, [[F.col("n_name")], [F.desc("n_nationkey")]])
    at = lambda df, c: df.select("n_nationkey", F.monotonically_increasing_id().alias("_m")).select("n_nationkey", F.row_number().over(Window.orderBy("_m")).alias(c))
    return at(by_name, "by_name").join(at(by_key, "by_key"), "n_nationkey")


def _compact(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "author")
    return tables.compact(docs, ["lang", "author"]).select("doc_id")


def _partition_merge(spark: SparkSession, d: str) -> DataFrame:
    return tables.partition_merge(table(spark, d, "lineitem"), ["l_orderkey"], F.count("*").alias("n"), F.max("l_quantity").alias("most"))


def _concat(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey"), table(spark, d, "region").select(F.col("r_name").alias("name"))
    return tables.concat(n, r, r)


def _unique_sort(spark: SparkSession, d: str) -> DataFrame:
    return tables.sort(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.col("o_custkey")], unique=True, ids=["o_orderkey"])


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects and arrays put together, taken apart and swapped by the row projections."""
    n = table(spark, d, "nation")
    a = P.wrap_object(V.of_column(F.col("n_nationkey"), T.IntegerType()), "k")
    b = P.wrap_object(V.of_column(F.col("n_name"), T.StringType()), "n")
    both = P.inner_object_concat(a, b)
    arr = P.inner_array_concat(P.wrap_array(V.of_column(F.col("n_nationkey"), T.IntegerType())), P.wrap_array(V.of_column(F.col("n_name"), T.StringType())))
    gone = P.object_delete(both, "k")
    swapped = P.array_swap(arr, 1)
    return n.select(F.col("n_nationkey").alias("k"), V.deref(gone, "n").col.alias("n"), V.variant(swapped.items[0]).cast("string").alias("first"), V.variant(swapped.items[1]).cast("int").alias("second"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """orders written as CSV, read back with inferred types into a catalog, and queried through a glob."""
    root = f"{shared_dir(spark)}/catalogs/{uuid.uuid4().hex}"
    sinks.write_csv(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), f"{root}/csv")
    sinks.write_json(table(spark, d, "nation").select("n_nationkey", "n_name"), f"{root}/json")
    c = Catalog(spark, f"{root}/data")
    c.ingest_file("/in/orders", f"{root}/csv")
    good, _ = readers.read_csv(spark, f"{root}/csv")
    c.write("/in/again", good.select("o_orderkey"))
    nation = readers.read_json(spark, f"{root}/json", schema="n_nationkey int, n_name string")[0]
    c.write("/names", nation.select(F.col("n_nationkey").cast("double").alias("o_orderkey")))
    return query(spark, "o := //in/* n := //names {n: count(o.o_orderkey), customers: count(distinct(o.o_custkey)), open: count(o where o.o_orderstatus = \"O\"), nations: count(n)}", {}, resolve=c.resolve)


def _take_range(spark: SparkSession, d: str) -> DataFrame:
    return tables.take_range(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 100, 50)


def _zip(spark: SparkSession, d: str) -> DataFrame:
    return tables.zip_rows(table(spark, d, "nation").select("n_name"), table(spark, d, "customer").select("c_custkey"), [F.col("n_name")], [F.col("c_custkey")])


def _schemas(spark: SparkSession, d: str) -> DataFrame:
    return tables.schemas(table(spark, d, "events").select(F.try_parse_json("props").alias("value")))


def _sample(spark: SparkSession, d: str) -> DataFrame:
    """Two samples of one seed and one of another: their size, that they are rows of the table, and how they agree."""
    o = table(spark, d, "orders")
    a, b, c = (tables.sample(o, 200, seed=s).select("o_orderkey") for s in (5, 5, 6))
    inside = a.join(o, "o_orderkey", "left_semi").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))
    same = a.join(b, "o_orderkey").agg(F.count("*").alias("same"))
    other = a.join(c, "o_orderkey").agg((F.count("*") < 100).alias("others_differ"))
    return inside.crossJoin(same).crossJoin(other)


def _scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.scan(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey")], "total", "sum", F.col("o_custkey"))


def _json_values(spark: SparkSession, d: str) -> DataFrame:
    """A mixed JSON column through the language: the numbers under k, by event type."""
    ev = table(spark, d, "events").select("event_id", "event_type", F.try_parse_json("props").alias("props"))
    return query(spark, "e := //e solve 't g := e where e.event_type = 't {t: 't, n: count(g.props.k), top: max(g.props.k)}", {"/e": Table(ev, ("event_id",))})


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream: counts in windows of an hour."""
    schema = table(spark, d, "events").schema.simpleString()[7:-1].replace(":", " ")
    src = ingest.stream_files(spark, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    agg = ingest.windowed(src, "ts", "1 hour", ["event_type"], [F.count("*").alias("n")])
    out = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/data")

    agg.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/data")


QUERIES.update({
    "q_table_cogroup": _cogroup, "q_table_align": _align, "q_table_take_range": _take_range, "q_table_zip": _zip, "q_table_schemas": _schemas, "q_table_sample": _sample,
    "q_table_group_by_n": _group_by_n, "q_table_compact": _compact, "q_table_partition_merge": _partition_merge, "q_table_concat": _concat, "q_table_unique_sort": _unique_sort, "q_objects": _objects, "q_sources": _sources,
    "q_table_scan": _scan, "q_json_values": _json_values, "q_stream_windows": _stream,
})
ORACLE.update({
    "q_table_cogroup": "with o as (select o_custkey as k, count(*) as n from orders group by 1) select coalesce(c_custkey, k) as k, case when k is null then 0 when c_custkey is null then -1 else n end as n from customer full join o on c_custkey = k",
    "q_table_align": "select c_custkey as k, c_name as v, 'left' as side from customer where c_custkey in (select o_custkey from orders) union all select o_custkey, o_orderstatus, 'right' from orders where o_custkey in (select c_custkey from customer)",
    "q_table_group_by_n": "select n_nationkey, cast(row_number() over (order by n_name) as int) as by_name, cast(row_number() over (order by n_nationkey desc) as int) as by_key from nation",
    "q_table_compact": "select doc_id from documents where lang is not null or author is not null",
    "q_table_partition_merge": "select l_orderkey, count(*) as n, max(l_quantity) as most from lineitem group by 1",
    "q_table_concat": "select n_name as name, n_nationkey from nation union all select r_name, null from region union all select r_name, null from region",
    "q_table_unique_sort": "select min(o_orderkey) as o_orderkey, o_custkey from orders group by o_custkey",
    "q_objects": "select n_nationkey as k, n_name as n, n_name as first, n_nationkey as second from nation",
    "q_sources": "select 2 * count(*) as n, count(distinct o_custkey) as customers, count(case when o_orderstatus = 'O' then 1 end) as open, (select count(*) from nation) as nations from orders",
    "q_table_take_range": "select o_orderkey from orders order by 1 limit 50 offset 100",
    "q_table_zip": "select n_name, c_custkey from (select n_name, row_number() over (order by n_name) as i from nation) join (select c_custkey, row_number() over (order by c_custkey) as i from customer) using (i)",
    "q_table_schemas": "select distinct 'OBJECT<k: BIGINT>' as schema from events where props is not null",
    "q_table_sample": "select least(200, count(*)) as n, least(200, count(*)) as keys, least(200, count(*)) as same, count(*) > 1000 as others_differ from orders",
    "q_table_scan": "select o_orderkey, o_custkey, cast(sum(o_custkey) over (order by o_orderkey) as bigint) as total from orders",
    "q_json_values": "select event_type as t, count(props->>'$.k') as n, max(cast(props->>'$.k' as double)) as top from events group by 1",
    "q_stream_windows": "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2",
})
