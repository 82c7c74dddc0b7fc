"""Registered queries of the engine's own operators, each with the SQL that must give the same rows.

Symbolic queries run through the whole path: lexer, parser, lowering, Catalyst. Floating sums are rounded on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .engine import Engine
from .functions.library import operator
from .operators import dialects, guard, joins, managed, migrate, pipeline, rules, statistics, text
from .sources import files
from .streaming import ingest

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")
NOW = dt.datetime(2024, 1, 20)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, now=NOW)
    for t in TABLES:
        e.register(t, f"{sf_dir}/{t}.parquet")
    return e


def _symbolic(name: str, query: str, sql: str, **parameters: object) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).query(query, **parameters)
    ORACLES[name] = sql


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# Verbs, clauses, outputs

_symbolic("v_select", "*3[customer]::c_custkey,c_name AS name>>oQ", "SELECT c_custkey, c_name AS name FROM customer")
_symbolic("v_select_all", "*[nation]>>oQ", "SELECT * FROM nation")
_symbolic("v_alias", "*3[customer c]::c.c_custkey AS id,c.c_acctbal AS balance", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer")
_symbolic("v_limit", "*10[orders]::o_orderkey,o_totalprice~{o_totalprice DESC,o_orderkey}", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_symbolic("v_limit_offset", "*3[orders]::o_orderkey,o_totalprice~{o_totalprice DESC,o_orderkey}[10,20]>>oQ", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
_symbolic("v_first", "*FIRST[orders]::o_orderkey~{o_orderkey}", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1")
_symbolic("v_last", "*LAST[orders]::o_orderkey~{o_orderkey}", "SELECT max(o_orderkey) AS o_orderkey FROM orders")
_symbolic("v_all", "*ALL[region]::*", "SELECT * FROM region")
_symbolic("v_count", "*COUNT[orders]::*+{o_orderstatus='F'}>>oQ", 'SELECT CAST(count(*) AS BIGINT) AS "count" FROM orders WHERE o_orderstatus = \'F\'')
_symbolic("v_sum", "*SUM[events]::event_id AS total", "SELECT CAST(sum(event_id) AS BIGINT) AS total FROM events")
_symbolic("v_avg", "*AVG[part]::p_size AS mean", "SELECT avg(p_size) AS mean FROM part")
_symbolic("v_min", "*MIN[orders]::o_totalprice AS low", "SELECT min(o_totalprice) AS low FROM orders")
_symbolic("v_max", "*MAX[orders]::o_totalprice AS high", "SELECT max(o_totalprice) AS high FROM orders")
_symbolic("v_distinct", "*DISTINCT[documents]::lang,source", "SELECT DISTINCT lang, source FROM documents")
_symbolic("v_distinct_call", "*3[orders]::DISTINCT(o_orderstatus,o_orderpriority)>>oQ", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_symbolic("v_group_count", "*GROUP_COUNT[events]::event_type", 'SELECT event_type, CAST(count(*) AS BIGINT) AS "count" FROM events GROUP BY 1')
_symbolic("v_filter_block", "*3[customer]::c_custkey,c_acctbal+{c_mktsegment='BUILDING'+c_acctbal>1000}>>oQ", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
_symbolic("v_filter_pipe", "*[customer]::c_custkey|c_mktsegment='BUILDING' OR NOT c_acctbal > 0", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR NOT c_acctbal > 0")
_symbolic("v_filter_arithmetic", "*3[part]::p_partkey+{p_size*2+1>=99}", "SELECT p_partkey FROM part WHERE p_size * 2 + 1 >= 99")
_symbolic("v_like", "*3[part]::p_partkey,p_name+{p_name~'%ring%'}", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'")
_symbolic("v_contains", "*[part]::p_partkey|p_name CONTAINS('widget') OR p_name STARTSWITH('small') OR p_brand ENDSWITH('7')", "SELECT p_partkey FROM part WHERE contains(p_name, 'widget') OR starts_with(p_name, 'small') OR ends_with(p_brand, '7')")
_symbolic("v_in", "*3[orders]::o_orderkey+{o_orderstatus@['F','P']+o_orderpriority@['1-URGENT']}", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT')")
_symbolic("v_between", "*3[orders]::o_orderkey+{o_totalprice<>1000<>50000}", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
_symbolic("v_date_filter", "*3[orders]::o_orderkey+{o_orderdate>'1998-01-01'}", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
_symbolic("v_is_null", "&f=*[orders]::o_custkey,o_orderkey+{o_totalprice>400000};=L[customer+&f f]::c_custkey+{f.o_orderkey IS NULL}", "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
_symbolic("v_recent", "*[events]::event_id|ts RECENT(7d) AND NOT ts OLDER_THAN(5d)", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-13' AND NOT ts < TIMESTAMP '2024-01-15'")
_symbolic("v_between_dates", "*[events]::event_id|ts BETWEEN_DATES('2024-01-02','2024-01-03')", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-03'")
_symbolic("v_parameter", "*[customer]::c_custkey|c_mktsegment = @segment AND c_acctbal < @most", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 500", segment="MACHINERY", most=500)
_symbolic("v_group_by", "*3[orders]::o_orderstatus,COUNT(*) AS n,ROUND(SUM(o_totalprice),2) AS total^{o_orderstatus}>>oQ", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
_symbolic("v_group_expression", "*3[orders]::YEAR(o_orderdate) AS y,COUNT(*) AS n^{YEAR(o_orderdate)}", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
_symbolic("v_having", "*3[orders]::o_custkey,COUNT(*) AS n^{o_custkey}${COUNT(*)>15}", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
_symbolic("v_order_multi", "*3[customer]::c_mktsegment,c_custkey~{c_mktsegment DESC,c_custkey ASC}[25]", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 25")
_symbolic("v_cte", "&big=*3[orders]::o_custkey,o_totalprice+{o_totalprice>300000};=J[customer+&big b]::customer.c_name,b.o_totalprice", "WITH b AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT c_name, o_totalprice FROM customer JOIN b ON c_custkey = o_custkey")
_symbolic("v_scalar_subquery", "*3[orders]::o_orderstatus,ROUND(SUM(o_totalprice) / (*SUM[orders]::o_totalprice>>oQ) * 100,6) AS share^{o_orderstatus}", "SELECT o_orderstatus, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) * 100, 6) AS share FROM orders GROUP BY 1")
_symbolic("v_in_subquery", "*3[orders]::o_orderkey+{o_custkey@*3[customer]::c_custkey+{c_mktsegment='BUILDING'}}", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_symbolic("v_derived", "*3[(*[customer]::c_nationkey AS k UNION ALL *[supplier]::s_nationkey) x]::k,COUNT(*) AS n^{k}", "SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
_symbolic("v_case", "*3[part]::p_partkey,{p_size<10?'small':p_size<30?'medium':'large'} AS size_class", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM part")
_symbolic("v_case_words", "*3[orders]::o_orderkey,CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS code", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 0 END AS code FROM orders")
_symbolic("v_union_all", "*3[customer]::'c' AS kind,COUNT(*) AS n UNION ALL *3[supplier]::'s',COUNT(*)", "SELECT 'c' AS kind, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 's', CAST(count(*) AS BIGINT) FROM supplier")
_symbolic("v_union_distinct", "*3[customer]::c_nationkey AS k UNION *3[supplier]::s_nationkey", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_symbolic("v_union_tables", "=U[nation+nation]::n_name", "SELECT DISTINCT n_name FROM nation")

# Joins

_symbolic("j_inner_fk", "=J[customer+orders]::customer.c_name,orders.o_orderkey>>oQ", "SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
_symbolic("j_left", "&f=*[orders]::o_custkey,o_orderkey+{o_totalprice>400000};=L[customer+&f f]::customer.c_custkey,f.o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
_symbolic("j_right", "&f=*[customer]::c_custkey,c_name+{c_acctbal>9000};=R[&f f+orders]::f.c_name,orders.o_orderkey", "SELECT c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) RIGHT JOIN orders ON c_custkey = o_custkey")
_symbolic("j_full", "&a=*[customer]::c_custkey+{c_acctbal>5000};&b=*[orders]::o_custkey,o_orderkey+{o_totalprice>400000};=F[&a a+&b b]::a.c_custkey,b.o_orderkey", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) FULL JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
_symbolic("j_cross", "=C[nation+region]::n_name,r_name", "SELECT n_name, r_name FROM nation CROSS JOIN region")
_symbolic("j_self", "=S[nation a+nation b]::a.n_name AS one,b.n_name AS two ON{a.n_regionkey=b.n_regionkey+a.n_nationkey<b.n_nationkey}", "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_symbolic("j_natural", "=N[documents+labels]::doc_id,quality", "SELECT doc_id, quality FROM documents NATURAL JOIN labels")
_symbolic("j_theta", "=J[supplier s+nation n]::s.s_suppkey,n.n_nationkey ON{s.s_nationkey>n.n_nationkey+s.s_acctbal>9000}", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey > n_nationkey AND s_acctbal > 9000")
_symbolic("j_three_way", "=J[customer+orders+lineitem]::c_mktsegment,COUNT(*) AS n,ROUND(SUM(l_extendedprice),2) AS total^{c_mktsegment}", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
_symbolic("j_star", "=J[lineitem+orders+customer+nation+region]::r_name,ROUND(SUM(l_extendedprice*(1-l_discount)),2) AS revenue+{o_orderstatus='F'}^{r_name}~{r_name}", "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY 1")
_symbolic("j_filtered", "=J[customer c+orders o]::c.c_name,o.o_totalprice+{o.o_orderstatus='P'+c.c_acctbal>5000}", "SELECT c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND c_acctbal > 5000")


@_query("j_residual", "SELECT s_suppkey AS left_s_suppkey, c_custkey AS right_c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal")
def j_residual(spark, sf_dir):
    out = joins.join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), "s_nationkey", "c_nationkey", condition=lambda a, b: F.col("left_s_acctbal") > F.col("right_c_acctbal"))
    return out.select("left_s_suppkey", "right_c_custkey")


@_query("j_prefixed_full", "SELECT n_name AS left_n_name, r_name AS right_r_name FROM (SELECT * FROM nation WHERE n_regionkey > 1) FULL JOIN region ON n_regionkey = r_regionkey")
def j_prefixed_full(spark, sf_dir):
    return joins.join(table(spark, sf_dir, "nation").where("n_regionkey > 1"), table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey", "FULL", strategy="merge").select("left_n_name", "right_r_name")


@_query("j_chain", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j_chain(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return joins.chain(t("customer"), (t("nation"), "c_nationkey", "n_nationkey"), (t("region"), "n_regionkey", "r_regionkey")).select("c_custkey", "n_name", "r_name")


@_query("j_nulls_match", "SELECT a.k AS left_k, b.k AS right_k FROM (SELECT DISTINCT CASE WHEN n_regionkey > 2 THEN n_regionkey END AS k FROM nation) a JOIN (SELECT DISTINCT CASE WHEN n_regionkey < 4 THEN n_regionkey END AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
def j_nulls_match(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.when(c, F.col("n_regionkey")).alias("k")).distinct() for c in (F.col("n_regionkey") > 2, F.col("n_regionkey") < 4))
    return joins.join(a, b, "k", "k", nulls_match=True)


# Aggregates

_symbolic("a_all", "*3[orders]::COUNT(*) AS n,COUNT(o_custkey) AS c,ROUND(SUM(o_totalprice),2) AS s,ROUND(AVG(o_totalprice),4) AS a,MIN(o_totalprice) AS lo,MAX(o_totalprice) AS hi", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(o_custkey) AS BIGINT) AS c, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
_symbolic("a_count_distinct", "*3[lineitem]::COUNT(DISTINCT l_suppkey) AS s,COUNT(DISTINCT l_partkey) AS p", "SELECT CAST(count(DISTINCT l_suppkey) AS BIGINT) AS s, CAST(count(DISTINCT l_partkey) AS BIGINT) AS p FROM lineitem")
_symbolic("a_conditional", "*3[lineitem]::l_returnflag,COUNT(CASE WHEN l_quantity > 25 THEN 1 END) AS big,ROUND(SUM(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END),2) AS cut^{l_returnflag}", "SELECT l_returnflag, CAST(count(CASE WHEN l_quantity > 25 THEN 1 END) AS BIGINT) AS big, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS cut FROM lineitem GROUP BY 1")
_symbolic("a_stddev_corr", "*3[lineitem]::ROUND(STDDEV(l_quantity),6) AS s,ROUND(CORR(l_quantity,l_extendedprice),6) AS c", "SELECT round(stddev(l_quantity), 6) AS s, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem")
_symbolic("a_ratio", "*3[lineitem]::l_linestatus,ROUND(SUM(l_extendedprice)/NULLIF(SUM(l_quantity),0),6) AS unit^{l_linestatus}", "SELECT l_linestatus, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) AS unit FROM lineitem GROUP BY 1")
_symbolic("a_top_groups", "*3[lineitem]::l_suppkey,ROUND(SUM(l_quantity),2) AS q^{l_suppkey}~{SUM(l_quantity) DESC,l_suppkey}[20]", "SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, 1 LIMIT 20")
_symbolic("a_subtotals_union", "*3[orders]::o_orderstatus AS level,COUNT(*) AS n^{o_orderstatus} UNION ALL *3[orders]::'ALL',COUNT(*)", "SELECT o_orderstatus AS level, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'ALL', CAST(count(*) AS BIGINT) FROM orders")


@_query("a_listagg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def a_listagg(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.expr("listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name)").alias("names"))


@_query("a_library", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(CASE WHEN l_quantity > 1000 THEN 1 END), 0) AS DOUBLE) AS s, round(avg(l_tax), 6) AS a, max(l_discount) AS hi FROM lineitem")
def a_library(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.agg(operator("COUNT").alias("n"), F.round(operator("SUM", F.when(F.col("l_quantity") > 1000, 1)), 4).alias("s"), F.round(operator("AVG", F.col("l_tax")), 6).alias("a"), operator("MAX", F.col("l_discount")).alias("hi"))


@_query("a_histogram", """
WITH v AS (SELECT l_extendedprice AS v FROM lineitem), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v)
SELECT CAST(least(floor((v - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS n FROM v, e GROUP BY 1""")
def a_histogram(spark, sf_dir):
    return statistics.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("bucket", "n")


@_query("a_common_values", "SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def a_common_values(spark, sf_dir):
    return statistics.common_values(table(spark, sf_dir, "orders"), "o_orderpriority", 3)


@_query("a_percentiles", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def a_percentiles(spark, sf_dir):
    out = statistics.percentiles(table(spark, sf_dir, "events"), "value")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


# Windows

_symbolic("w_row_number", "*ROW[customer]::c_custkey,*ROW+{ORDER BY c_acctbal DESC,c_custkey} AS k", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS k FROM customer")
_symbolic("w_partition_row_number", "*3[orders]::o_orderkey,*ROW+{PARTITION BY o_custkey ORDER BY o_orderdate,o_orderkey} AS k", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS k FROM orders")
_symbolic("w_lag", "*3[orders]::o_orderkey,*LAG(o_totalprice,1)+{PARTITION BY o_custkey ORDER BY o_orderdate,o_orderkey} AS before", "SELECT o_orderkey, lag(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
_symbolic("w_lag_agg", "*3[orders]::YEAR(o_orderdate) AS y,ROUND(SUM(o_totalprice),2) AS total,ROUND(*LAG(SUM(o_totalprice),1)+{ORDER BY YEAR(o_orderdate)},2) AS before^{YEAR(o_orderdate)}", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(o_totalprice), 2) AS total, round(lag(sum(o_totalprice), 1) OVER (ORDER BY year(o_orderdate)), 2) AS before FROM orders GROUP BY year(o_orderdate)")
_symbolic("w_running_total", "*3[nation]::n_nationkey,SUM(n_regionkey)+{ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING} AS run", "SELECT n_nationkey, CAST(sum(n_regionkey) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM nation")
_symbolic("w_moving_avg", "*3[orders]::MONTH(o_orderdate) AS m,ROUND(AVG(SUM(o_totalprice))+{ROWS 2 PRECEDING},2) AS mean^{MONTH(o_orderdate)}~{MONTH(o_orderdate)}", "SELECT CAST(month(o_orderdate) AS INTEGER) AS m, round(avg(sum(o_totalprice)) OVER (ORDER BY month(o_orderdate) ROWS 2 PRECEDING), 2) AS mean FROM orders GROUP BY month(o_orderdate)")
_symbolic("w_topn_per_group", "&r=*3[orders]::o_custkey,o_orderkey,*ROW+{PARTITION BY o_custkey ORDER BY o_totalprice DESC,o_orderkey} AS k;*[&r]::o_custkey,o_orderkey|k<=2", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2")
_symbolic("w_ranks", "*3[customer]::c_custkey,*RANK()+{PARTITION BY c_nationkey ORDER BY c_mktsegment} AS r,*DENSE_RANK()+{PARTITION BY c_nationkey ORDER BY c_mktsegment} AS d,*NTILE(4)+{ORDER BY c_custkey} AS q", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INTEGER) AS d, CAST(ntile(4) OVER (ORDER BY c_custkey) AS INTEGER) AS q FROM customer")
_symbolic("w_shares", "*3[nation]::n_nationkey,ROUND(*CUME_DIST()+{ORDER BY n_regionkey},6) AS c,ROUND(*PERCENT_RANK()+{ORDER BY n_regionkey},6) AS p,*LEAD(n_name,1)+{ORDER BY n_nationkey} AS next", "SELECT n_nationkey, round(cume_dist() OVER (ORDER BY n_regionkey), 6) AS c, round(percent_rank() OVER (ORDER BY n_regionkey), 6) AS p, lead(n_name, 1) OVER (ORDER BY n_nationkey) AS next FROM nation")
_symbolic("w_bucket_then_group", "&t=*3[customer]::c_acctbal,*NTILE(5)+{ORDER BY c_acctbal DESC,c_custkey} AS fifth;*[&t]::fifth,COUNT(*) AS n,ROUND(SUM(c_acctbal),2) AS total^{fifth}", "SELECT CAST(fifth AS INTEGER) AS fifth, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM (SELECT c_acctbal, ntile(5) OVER (ORDER BY c_acctbal DESC, c_custkey) AS fifth FROM customer) GROUP BY 1")

# Functions

_symbolic("s_string", "*3[part]::p_partkey,UPPER(p_name) AS u,LOWER(p_brand) AS l,SUBSTRING(p_name,1,4) AS s,CONCAT(p_brand,'/',p_type) AS c,LENGTH(p_name) AS n,REPLACE(p_type,'O','0') AS r,TRIM(p_name) AS t", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, substring(p_name, 1, 4) AS s, p_brand || '/' || p_type AS c, CAST(length(p_name) AS INTEGER) AS n, replace(p_type, 'O', '0') AS r, trim(p_name) AS t FROM part")
_symbolic("s_date", "*3[orders]::o_orderkey,DATE(o_orderdate) AS d,YEAR(o_orderdate) AS y,MONTH(o_orderdate) AS m,DAY(o_orderdate) AS dd,WEEK(o_orderdate) AS w,DAYOFWEEK(o_orderdate) AS dow,DAYNAME(o_orderdate) AS dn,MONTHNAME(o_orderdate) AS mn,DATE_FORMAT(o_orderdate,'%Y-%m') AS ym", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS dd, CAST(week(o_orderdate) AS INTEGER) AS w, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
_symbolic("s_datediff", "*3[orders]::o_orderkey,DATEDIFF('2000-01-01',o_orderdate) AS days,DATE(DATE_SUB(o_orderdate,INTERVAL 7 DAY)) AS week_before", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days, CAST(o_orderdate - INTERVAL 7 DAY AS DATE) AS week_before FROM orders")
_symbolic("s_math", "*3[lineitem]::l_orderkey,l_linenumber,ROUND(l_extendedprice*(1-l_discount),5) AS net,FLOOR(l_quantity/7) AS f,CEIL(l_quantity/7) AS c,ABS(l_discount-0.05) > 0.02 AS far,ROUND(SQRT(l_quantity),6) AS r,GREATEST(l_quantity,25.0) AS g", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 5) AS net, CAST(floor(l_quantity / 7) AS BIGINT) AS f, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, abs(l_discount - 0.05) > 0.02 AS far, round(sqrt(l_quantity), 6) AS r, greatest(l_quantity, 25.0) AS g FROM lineitem")
_symbolic("s_division", "*3[part]::p_partkey,p_size / (p_size - 10) AS q", "SELECT p_partkey, p_size / nullif(p_size - 10, 0) AS q FROM part")
_symbolic("s_coalesce", "=L[customer+orders]::c_custkey,COALESCE(o_orderstatus,'none') AS status ON{c_custkey=o_custkey+o_totalprice>450000}", "SELECT c_custkey, coalesce(o_orderstatus, 'none') AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000")


@_query("p_loose", "SELECT p_partkey, CAST(p_size AS VARCHAR) = '10' AS as_number, lower(p_type) = lower('economy') AS as_text, p_size % 7 AS m FROM part")
def p_loose(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", operator("=", F.col("p_size"), "10.0").alias("as_number"), operator("=", F.col("p_type"), "economy").alias("as_text"), operator("%", F.col("p_size"), 7).cast("int").alias("m"))


@_query("p_similar", """
SELECT p_partkey FROM part WHERE len(list_intersect(list_distinct(string_split(lower(p_name), '')), list_distinct(string_split('ring widget', '')))) >= 0.7 * len(list_distinct(string_split('ring widget', '')))""")
def p_similar(spark, sf_dir):
    return table(spark, sf_dir, "part").where(operator("SIMILAR", F.col("p_name"), "ring widget")).select("p_partkey")


@_query("p_sqlite_functions", "SELECT p_partkey, hex(p_brand) AS h, strpos(p_name, 'r') AS i, greatest(p_size, 25) AS g, CAST(log10(p_retailprice) * 1000 AS BIGINT) AS lg FROM part")
def p_sqlite_functions(spark, sf_dir):
    from .functions.names import call

    c = lambda n, *a: F.expr(call(n, list(a), dialect="sqlite"))
    return table(spark, sf_dir, "part").select("p_partkey", c("hex", "p_brand").alias("h"), c("instr", "p_name", "'r'").cast("long").alias("i"), c("max", "p_size", "25").alias("g"), F.round(c("log", "p_retailprice") * 1000).cast("long").alias("lg"))


# Pipelines, views, rules


@_query("p_pipeline", "SELECT n_name, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 500 AND c_mktsegment != 'MACHINERY' GROUP BY 1")
def p_pipeline(spark, sf_dir):
    p = pipeline.Pipeline("by_nation", ("customer", "nation"), (
        {"type": "JOIN", "left": "customer", "right": "nation", "on": "customer.c_nationkey = nation.n_nationkey"},
        {"type": "FILTER", "condition": "customer.c_acctbal > {least} AND c_mktsegment != '{not}'"},
        {"type": "AGGREGATE", "group_by": ["n_name"], "aggregations": [{"column": "c_custkey", "function": "count", "alias": "customers"}, {"column": "c_acctbal", "function": "sum", "alias": "balance"}]},
        {"type": "SORT", "by": ["balance"], "order": "DESC"},
        {"type": "PROJECT", "columns": ["N_NAME", "customers", "balance"]},
    ), parameters={"least": 500, "not": "MACHINERY"})
    out = pipeline.run(p, {t: table(spark, sf_dir, t) for t in p.source_tables})
    return out.withColumn("balance", F.round("balance", 2))


@_query("p_pipeline_union", "SELECT * FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey >= 2) UNION ALL SELECT * FROM nation")
def p_pipeline_union(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    p = pipeline.Pipeline("twice", ("nation",), ({"type": "FILTER", "condition": "n_regionkey >= 2"}, {"type": "UNION", "tables": ["other"]}))
    return pipeline.run(p, {"nation": n, "other": n})


@_query("p_views", "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' GROUP BY 1")
def p_views(spark, sf_dir):
    views = {
        "per_nation": pipeline.View("per_nation", "SELECT c_nationkey, count(*) AS n FROM builders GROUP BY c_nationkey", ("builders",)),
        "builders": pipeline.View("builders", "SELECT * FROM solvent WHERE c_mktsegment = 'BUILDING'", ("solvent",)),
        "solvent": pipeline.View("solvent", "SELECT * FROM customer WHERE c_acctbal > 0", ("customer",)),
    }
    return pipeline.define_views(spark, views, {"customer": table(spark, sf_dir, "customer")})["per_nation"]


@_query("p_rules", """
SELECT 'c_custkey' AS "column", 'UNIQUE' AS rule, CAST(0 AS BIGINT) AS broken, true AS passed
UNION ALL SELECT 'c_acctbal', 'MIN_VALUE', CAST(count(*) AS BIGINT), count(*) = 0 FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'c_name', 'REGEX_MATCH', CAST(count(*) AS BIGINT), count(*) = 0 FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]+')
UNION ALL SELECT 'c_mktsegment', 'IN_SET', CAST(count(*) AS BIGINT), count(*) = 0 FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT 'c_name', 'MAX_LENGTH', CAST(count(*) AS BIGINT), count(*) = 0 FROM customer WHERE length(c_name) > 10
UNION ALL SELECT 'c_nationkey', 'NOT_NULL', CAST(count(*) AS BIGINT), count(*) = 0 FROM customer WHERE c_nationkey IS NULL""")
def p_rules(spark, sf_dir):
    R = rules.Rule
    return rules.evaluate(table(spark, sf_dir, "customer"), [R("c_custkey", "UNIQUE"), R("c_acctbal", "MIN_VALUE", 0), R("c_name", "REGEX_MATCH", "Customer#[0-9]+"), R("c_mktsegment", "IN_SET", ["BUILDING", "MACHINERY"]), R("c_name", "MAX_LENGTH", 10), R("c_nationkey", "NOT_NULL")])


# Writes, as the rows after them


# Statistics, parity, types, guards


@_query("m_stats", """
SELECT 'o_orderstatus' AS "column", CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(o_orderstatus) AS BIGINT) AS nulls, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS ndv, min(o_orderstatus) AS "min", max(o_orderstatus) AS "max", round(avg(length(o_orderstatus)), 4) AS avg_length FROM orders
UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey), CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR), round(avg(length(CAST(o_custkey AS VARCHAR))), 4) FROM orders""")
def m_stats(spark, sf_dir):
    return statistics.column_statistics(table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey")).withColumn("avg_length", F.round("avg_length", 4))


@_query("m_parity", """
SELECT 'nation' AS "table", 'MATCH' AS data UNION ALL SELECT 'region', 'MISMATCH' UNION ALL SELECT 'customer', 'SOURCE_ONLY' UNION ALL SELECT 'supplier', 'TARGET_ONLY'""")
def m_parity(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    found = statistics.data_parity({"nation": t("nation"), "region": t("region"), "customer": t("customer")}, {"nation": t("nation"), "region": t("region").where("r_regionkey > 0"), "supplier": t("supplier")})
    return spark.createDataFrame([(k, v["data"]) for k, v in found.items()], "table string, data string")


@_query("m_constraint_parity", """
SELECT * FROM (VALUES ('nation', 'foreign_keys', 'MISMATCH'), ('nation', 'identity_column', 'N/A'), ('nation', 'indexes', 'TARGET_ONLY'), ('nation', 'not_null', 'MATCH'),
('nation', 'primary_keys', 'MATCH'), ('nation', 'unique_constraints', 'SOURCE_ONLY')) t("table", "constraint", status)""")
def m_constraint_parity(spark, sf_dir):
    common = {"primary_keys": ["n_nationkey"], "not_null": ["n_nationkey", "n_name"]}
    source = common | {"unique_constraints": [["n_name"]], "foreign_keys": [["n_regionkey", "region", "r_regionkey"]]}
    target = common | {"not_null": ["n_name", "n_nationkey"], "foreign_keys": [["n_regionkey", "region", "r_name"]], "indexes": ["by_name"]}
    found = statistics.constraint_parity({"nation": source}, {"nation": target})
    return spark.createDataFrame([(t, k, s) for t, kinds in found.items() for k, s in kinds.items()], "table string, constraint string, status string")


@_query("m_row_hash", "SELECT n_nationkey, substr(sha256(n_name || ':' || CAST(n_regionkey AS VARCHAR)), 1, 16) AS id FROM nation")
def m_row_hash(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.substring(F.sha2(F.concat_ws(":", "n_name", "n_regionkey"), 256), 1, 16).alias("id"))


@_query("m_types", "SELECT * FROM (VALUES ('varchar(20)', 'varchar(20)'), ('numeric(10,2)', 'decimal(10,2)'), ('timestamptz', 'timestamp'), ('jsonb', 'string')) t(source, spark)")
def m_types(spark, sf_dir):
    return spark.createDataFrame([(s, dialects.from_neutral("spark", dialects.to_neutral("postgres", s))) for s in ("varchar(20)", "numeric(10,2)", "timestamptz", "jsonb")], "source string, spark string")


# Text


@_query("t_bm25", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, len(w) AS n FROM w), c AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
p AS (SELECT doc_id, t, count(*) AS f FROM (SELECT doc_id, unnest(w) AS t FROM w) WHERE t IN ('license', 'work') GROUP BY 1, 2),
q AS (SELECT * FROM p WHERE t IN ('license', 'work')),
d AS (SELECT t, count(*) AS df FROM q GROUP BY 1)
SELECT doc_id AS id, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
FROM q JOIN d USING (t) JOIN l USING (doc_id), c GROUP BY 1 HAVING count(*) = 2 ORDER BY score DESC, id LIMIT 10""".replace("\\\\", "\\"))
def t_bm25(spark, sf_dir):
    return text.TextIndex.build(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").search("License, work!", 10)


@_query("p_search", r"""
SELECT doc_id FROM (SELECT doc_id, lang, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS w FROM documents)
WHERE list_contains(w, 'license') AND list_contains(w, 'work') AND lang = 'en'""")
def p_search(spark, sf_dir):
    return engine(spark, sf_dir).text_index("documents", "text").query("*3[documents]::doc_id+{SEARCH('License, work!')}|lang='en'>>oQ")


@_query("t_vector_topk", """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round((list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) + 1) / 2, 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, id LIMIT 10""")
def t_vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return text.nearest(e, "vec_id", "embedding", [float(x) for x in e.where("vec_id = 0").first()["embedding"]])


@_query("t_chunk_counts")
def t_chunk_counts(spark, sf_dir):
    return text.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


@_query("t_hybrid", r"""
WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, lang, len(w) AS n FROM w), c AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
p AS (SELECT doc_id, t, count(*) AS f FROM (SELECT doc_id, unnest(w) AS t FROM w) WHERE t IN ('the', 'of') GROUP BY 1, 2),
d AS (SELECT t, count(*) AS df FROM p GROUP BY 1),
lex AS (SELECT doc_id AS id, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM p JOIN d USING (t) JOIN l USING (doc_id), c WHERE lang = 'en' GROUP BY 1 HAVING count(*) = 2 ORDER BY score DESC, id LIMIT 100),
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
vec AS (SELECT vec_id AS id, round((list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) + 1) / 2, 6) AS similarity FROM embeddings, q
  WHERE vec_id IN (SELECT id FROM lex) OR (NOT EXISTS (SELECT 1 FROM lex) AND vec_id IN (SELECT doc_id FROM l WHERE lang = 'en')) ORDER BY similarity DESC, id LIMIT 50)
SELECT id, round(0.10 + 0.25 * coalesce(score / nullif((SELECT max(score) FROM lex), 0), 0) + 0.65 * coalesce(similarity, 0), 6) AS score
FROM lex FULL JOIN vec USING (id) ORDER BY score DESC, id LIMIT 10""")
def t_hybrid(spark, sf_dir):
    docs, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    index = text.TextIndex.build(docs.select("doc_id", "text", "lang"), "doc_id", "text")
    vector = [float(x) for x in e.where("vec_id = 0").first()["embedding"]]
    return text.hybrid(index, "the of", e, "vec_id", "embedding", vector, F.col("lang") == "en")


# Events: windows as an extension


@_query("r_window_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def r_window_tumbling(spark, sf_dir):
    return ingest.tumbling(table(spark, sf_dir, "events"), "ts", "1 day", "event_type", value="value")


@_query("r_window_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def r_window_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", "user_id")


# Lookups, migration, streams of documents


@_query("i_repeated", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def i_repeated(spark, sf_dir):
    return migrate.repeated_keys(table(spark, sf_dir, "orders"), "o_custkey")


@_query("m_preflight", "SELECT 'customer.order: reserved word' AS problem UNION ALL SELECT 'customer.balance: precision: decimals become floating point'")
def m_preflight(spark, sf_dir):
    t = migrate.TableDef("customer", (("id", "integer"), ("order", "integer"), ("balance", "numeric(10,2)")))
    return spark.createDataFrame([(p,) for p in migrate.preflight([t], "postgres", "sqlite")], "problem string")


@_query("x_export_sql", """SELECT 'INSERT INTO "r" ("r_regionkey", "r_name") VALUES (' || r_regionkey || ', ''' || r_name || ''');' AS value FROM region""")
def x_export_sql(spark, sf_dir):
    return files.insert_statements(table(spark, sf_dir, "region"), "r")


@_query("x_payload_hash", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS payload, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS hash FROM nation""")
def x_payload_hash(spark, sf_dir):
    return files.packed(table(spark, sf_dir, "nation"))


@_query("t_changed_documents", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def t_changed_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = docs.select(F.col("doc_id").alias("uri"), F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("~"))).otherwise(F.col("text")), 256).alias("hash"))
    return text.changed_documents(known, docs, "doc_id", "text").select("doc_id")


@_query("r_window_sliding", """
SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, CAST(count(*) AS BIGINT) AS n
FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS window_start FROM events, (VALUES (0), (1)) t(k)) GROUP BY 1""")
def r_window_sliding(spark, sf_dir):
    return ingest.sliding(table(spark, sf_dir, "events"), "ts", "2 hours", "1 hour")


# Writes through the language, on a managed copy


def _writable(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    e = Engine(spark, root=scratch.fresh(spark, "managed"), now=NOW)
    for name in names:
        store = managed.ManagedTable(spark, e.root, name)
        store.write(table(spark, sf_dir, name))
        e.register(name, store.read())
    return e


@_query("d_insert", "SELECT * FROM region UNION ALL SELECT 99, 'ATLANTIS' UNION ALL SELECT 98, 'LEMURIA'")
def d_insert(spark, sf_dir):
    e = _writable(spark, sf_dir, "region")
    e.execute("+V[region]::99,ATLANTIS>>oQ;+V[region(r_name,r_regionkey)]::LEMURIA,98>>oQ")
    return e.query("*[region]")


@_query("d_update", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def d_update(spark, sf_dir):
    e = _writable(spark, sf_dir, "customer")
    e.execute("*4[customer]::c_acctbal=0.0,c_mktsegment='DEBT'+{c_acctbal<0}>>oQ")
    return e.query("*[customer]")


@_query("d_delete", "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def d_delete(spark, sf_dir):
    e = _writable(spark, sf_dir, "orders")
    e.execute("-D[orders]+{o_orderstatus='F'+o_totalprice<100000}>>oQ")
    return e.query("*[orders]")


@_query("d_transaction", "SELECT s_suppkey, CASE WHEN s_acctbal < -500 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def d_transaction(spark, sf_dir):
    e = _writable(spark, sf_dir, "supplier")
    e.execute("$1;-D[supplier]+{s_acctbal<0};$3;$1;*4[supplier]::s_acctbal=0.0+{s_acctbal<-500};$2")
    return e.query("*[supplier]::s_suppkey,s_acctbal")


@_query("d_create_defaults", "SELECT r_name, stars, note FROM region JOIN (VALUES (1, 3, 'none'), (2, 3, 'none'), (3, 5, 'seen')) v(id, stars, note) ON r_regionkey = id")
def d_create_defaults(spark, sf_dir):
    e = _writable(spark, sf_dir, "region")
    e.execute("@A[ratings]::id INT !1,label VARCHAR(20) !4,stars INT !5(stars < 6) !6(3),note TEXT !6('none');+V[ratings(id,label)]::1,a;2,b;+V[ratings]::3,c,5,seen")
    return e.query("=J[region r+ratings q]::r.r_name,q.stars,q.note ON{r.r_regionkey=q.id}")


@_query("d_facade", "SELECT p_partkey, p_size + 1 AS p_size FROM part WHERE p_size < 40 UNION ALL SELECT 0, 2")
def d_facade(spark, sf_dir):
    e = _writable(spark, sf_dir, "part")
    e.delete("part", "p_size >= 40")
    e.insert("part", {"p_partkey": 0, "p_size": 1})
    return e.update("part", {"p_size": "p_size + 1"}, "p_size >= 0").select("p_partkey", "p_size")


@_query("d_drop", "SELECT r_name FROM region")
def d_drop(spark, sf_dir):
    e = _writable(spark, sf_dir, "region", "nation")
    e.execute("@3[nation]::>>oQ")
    assert not e.catalog.has("nation")
    return e.query("*[region]::r_name")


# Scripts, batches, modifiers


@_query("v_script", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100")
def v_script(spark, sf_dir):
    script = "-- customers of a segment\n# by name\n*COUNT[customer];\n*[customer]::c_custkey|c_mktsegment='${SEGMENT}' AND c_acctbal > $LEAST"
    return engine(spark, sf_dir).script(script, {"SEGMENT": "BUILDING", "LEAST": "100"})[-1].df


@_query("v_batch", "SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")
def v_batch(spark, sf_dir):
    first, failed, last = engine(spark, sf_dir).batch(["*[nation]::n_name", "*[nowhere]::n_name", "*[region]::r_name"])
    assert isinstance(failed, Exception)
    return first[-1].df.unionAll(last[-1].df)


@_query("v_validate", "SELECT CAST(column_index AS INTEGER) AS position, column_name AS name FROM duckdb_columns() WHERE false UNION ALL SELECT 0, 'o_orderkey' UNION ALL SELECT 1, 'total'")
def v_validate(spark, sf_dir):
    return engine(spark, sf_dir).query("*3[orders]::o_orderkey,SUM(o_totalprice) AS total^{o_orderkey}>>VALIDATE").select("position", "name")


_symbolic("v_group_concat", "*3[nation]::n_regionkey,LENGTH(GROUP_CONCAT(n_name,';')) AS n^{n_regionkey}", "SELECT n_regionkey, CAST(length(string_agg(n_name, ';')) AS INTEGER) AS n FROM nation GROUP BY 1")
_symbolic("s_format", "*3[orders]::o_orderkey,FORMAT(o_totalprice,1) AS shown", "SELECT o_orderkey, format('{:,.1f}', o_totalprice) AS shown FROM orders")


# Operators of the library


@_query("p_operators", """
SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size > 30 AS gt, p_brand <= 'Brand#3' AS le, p_size > 10 AND p_size < 20 AS both, p_size < 5 OR p_size > 45 AS either, NOT p_size > 25 AS negated,
CAST(CAST(p_size + 1 AS DOUBLE) AS VARCHAR) AS plus, p_brand || 'x' AS joined, CAST(p_size - 3 AS DOUBLE) AS minus, CAST(p_size * 2 AS DOUBLE) AS times, p_size / nullif(p_size - 10, 0) AS divided, p_size BETWEEN 5 AND 9 AS between_, p_name ILIKE '%RING%' AS like_ FROM part""")
def p_operators(spark, sf_dir):
    size, brand = F.col("p_size"), F.col("p_brand")
    o = operator
    return table(spark, sf_dir, "part").select(
        "p_partkey", o("==", size, 10).alias("eq"), o("!=", size, 10).alias("ne"), o(">", size, "30").alias("gt"), o("<=", brand, "Brand#3").alias("le"), o("&", size > 10, size < 20).alias("both"),
        o("||", size < 5, size > 45).alias("either"), o("!", size > 25).alias("negated"), o("+", size, 1).alias("plus"), o("+", brand, "x").alias("joined"), o("-", size, 3).alias("minus"), o("*", size, 2).alias("times"),
        o("/", size, size - 10).alias("divided"), o("BETWEEN", size, 5, 9).alias("between_"), o("LIKE", F.col("p_name"), "%RING%").alias("like_"),
    )


def _sqlite(name: str, *args: str):
    from .functions.names import call

    return F.expr(call(name, list(args), dialect="sqlite"))


@_query("s_sqlite_dates", """
SELECT o_orderkey, CAST(o_orderdate + INTERVAL 7 DAY AS DATE) AS week_on, strftime(o_orderdate, '%Y-%m') AS month, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS first_day, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, round(epoch(o_orderdate) / 86400 + 2440587.5, 4) AS julian_day
FROM orders""")
def s_sqlite_dates(spark, sf_dir):
    d = "o_orderdate"
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", _sqlite("date", d, "'+7 days'").alias("week_on"), _sqlite("strftime", "'%Y-%m'", d).alias("month"), _sqlite("datetime", d, "'start of month'").alias("first_day"),
        _sqlite("unixepoch", d).alias("seconds"), F.round(_sqlite("julianday", d), 4).alias("julian_day"),
    )


@_query("s_sqlite_json", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, true AS valid, '[' || n_nationkey || ',' || n_regionkey || ']' AS listed FROM nation")
def s_sqlite_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = n.withColumn("payload", F.to_json(F.struct("n_name", "n_regionkey")))
    return rows.select(
        _sqlite("json_extract", "payload", "'$.n_name'").alias("name"), _sqlite("json_extract", "payload", "'$.n_regionkey'").alias("region"), _sqlite("json_valid", "payload").alias("valid"),
        _sqlite("json_array", "n_nationkey", "n_regionkey").alias("listed"),
    )


@_query("s_sqlite_aggregates", "SELECT n_regionkey, CAST(sum(n_nationkey) AS DOUBLE) AS total, max(n_name) AS last, CAST(length(string_agg(n_name, ',')) AS INTEGER) AS joined FROM nation GROUP BY 1")
def s_sqlite_aggregates(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(_sqlite("total", "n_nationkey").alias("total"), _sqlite("max", "n_name").alias("last"), F.length(_sqlite("group_concat", "n_name")).alias("joined"))


# Sources and sinks: a table written in a format and read back


def _back(spark: SparkSession, df: DataFrame, kind: str, **options: object) -> DataFrame:
    path = scratch.fresh(spark, kind)
    files.write(df, path, kind, **options)
    return files.read(spark, path, kind, schema=", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), **options)


for _kind, _options in {"csv": {}, "tsv": {}, "json": {}, "jsonl": {"compression": "gzip"}, "orc": {}, "parquet": {"compression": "zstd"}, "xml": {"rowTag": "supplier", "rootTag": "suppliers"}}.items():
    QUERIES[f"x_{_kind}"] = lambda spark, sf_dir, k=_kind, o=_options: _back(spark, table(spark, sf_dir, "supplier"), "jsonl" if k == "json" else k, **o)
    ORACLES[f"x_{_kind}"] = "SELECT * FROM supplier"


@_query("x_csv_inferred", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def x_csv_inferred(spark, sf_dir):
    path = scratch.fresh(spark, "inferred")
    files.write(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path, "csv")
    out = files.read(spark, path, "csv")
    assert [t for _, t in out.dtypes] == ["int", "string", "int", "double"]
    return out.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@_query("x_folder", "SELECT r_name, CAST(count(*) AS BIGINT) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def x_folder(spark, sf_dir):
    path = scratch.fresh(spark, "folder")
    files.write(table(spark, sf_dir, "region"), f"{path}/region.csv", "csv")
    files.write(table(spark, sf_dir, "nation"), f"{path}/nation.jsonl", "jsonl")
    e = Engine(spark)
    for name, df in files.folder_tables(spark, path).items():
        e.register(name, df)
    return e.query("=J[region r+nation n]::r.r_name,COUNT(*) AS nations ON{r.r_regionkey=n.n_regionkey}^{r_name}")


@_query("x_pipeline_sink", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS customers FROM customer GROUP BY 1")
def x_pipeline_sink(spark, sf_dir):
    path = scratch.fresh(spark, "sink")
    p = pipeline.Pipeline("segments", ("customer",), ({"type": "AGGREGATE", "group_by": ["c_mktsegment"], "aggregations": [{"column": "c_custkey", "function": "count", "alias": "customers"}]},), output_file=f"{path}/out.csv")
    pipeline.write(p, pipeline.run(p, {"customer": table(spark, sf_dir, "customer")}))
    return files.read(spark, p.output_file, schema="c_mktsegment string, customers long")


@_query("x_chunks", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier")
def x_chunks(spark, sf_dir):
    seen = [(len(c), sum(r["s_suppkey"] for r in c)) for c in engine(spark, sf_dir).execute("*[supplier]::s_suppkey")[0].chunks(64)]
    return spark.createDataFrame([(sum(n for n, _ in seen), sum(t for _, t in seen))], "n long, total long")


# Migration, fingerprints, triggers


@_query("m_migrate", "SELECT 'nation' AS name, CAST(count(*) AS BIGINT) AS n FROM nation UNION ALL SELECT 'region', CAST(count(*) AS BIGINT) FROM region")
def m_migrate(spark, sf_dir):
    path = scratch.fresh(spark, "migration")
    T = migrate.TableDef
    tables = [T("nation", (("n_nationkey", "integer"),), ("region",)), T("region", (("r_regionkey", "integer"),))]
    run = migrate.Migration(spark, lambda t: table(spark, sf_dir, t), lambda t, df: migrate.write_counted(df, f"{path}/{t}"), f"{path}/state.json")
    run.run(tables[1:])
    run.run(tables)  # goes on behind what is done
    return spark.read.parquet(f"{path}/nation").selectExpr("'nation' AS name").unionAll(spark.read.parquet(f"{path}/region").selectExpr("'region'")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@_query("m_fingerprint", "SELECT 'other order' AS copy, true AS same, CAST(count(*) AS BIGINT) AS n FROM customer UNION ALL SELECT 'a row less', false, CAST(count(*) - 1 AS BIGINT) FROM customer UNION ALL SELECT 'a value changed', false, CAST(count(*) AS BIGINT) FROM customer")
def m_fingerprint(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    copies = {"other order": c.repartition(7), "a row less": c.where("c_custkey <> 1"), "a value changed": c.withColumn("c_acctbal", F.when(F.col("c_custkey") == 1, 0.125).otherwise(F.col("c_acctbal")))}
    own = statistics.exact_fingerprint(c)
    return spark.createDataFrame([(k, statistics.exact_fingerprint(df) == own, df.count()) for k, df in copies.items()], "copy string, same boolean, n long")


@_query("p_triggers", "SELECT 'solvent' AS trigger, count_if(c_acctbal < 0) = 0 AS passed, CAST(count(*) AS VARCHAR) AS text FROM customer UNION ALL SELECT 'noted', true, 'customer: ' || count(*) FROM customer")
def p_triggers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    triggers = rules.Triggers([
        rules.Trigger("solvent", "on_ingest", "validate", "customer", (rules.Rule("c_acctbal", "MIN_VALUE", 0),)), rules.Trigger("noted", "on_ingest", "audit_log", template="{table}: {row_count}"),
        rules.Trigger("elsewhere", "on_ingest", "audit_log", "orders", template="never"),
    ])
    n = c.count()
    found = triggers.replay([(rules.Event("e1", "on_ingest", "customer", {"row_count": n}), c)])["results"]
    return spark.createDataFrame([(r["trigger"], r["passed"], r.get("text", str(n))) for r in found], "trigger string, passed boolean, text string")


@_query("p_rules_more", """
SELECT 'p_size' AS "column", 'POSITIVE_INTEGER' AS rule, CAST(count_if(NOT (p_size > 0)) AS BIGINT) AS broken, count_if(NOT (p_size > 0)) = 0 AS passed FROM part
UNION ALL SELECT 'p_retailprice', 'POSITIVE_NUMBER', CAST(count_if(NOT (p_retailprice > 0)) AS BIGINT), count_if(NOT (p_retailprice > 0)) = 0 FROM part
UNION ALL SELECT 'p_name', 'CONTAINS', CAST(count_if(NOT contains(p_name, 'ring')) AS BIGINT), count_if(NOT contains(p_name, 'ring')) = 0 FROM part
UNION ALL SELECT 'p_brand', 'MIN_LENGTH', CAST(count_if(length(p_brand) < 8) AS BIGINT), count_if(length(p_brand) < 8) = 0 FROM part
UNION ALL SELECT 'p_size', 'MAX_VALUE', CAST(count_if(p_size > 45) AS BIGINT), count_if(p_size > 45) = 0 FROM part""")
def p_rules_more(spark, sf_dir):
    R = rules.Rule
    return rules.evaluate(table(spark, sf_dir, "part"), [R("p_size", "POSITIVE_INTEGER"), R("p_retailprice", "POSITIVE_NUMBER"), R("p_name", "CONTAINS", "ring"), R("p_brand", "MIN_LENGTH", 8), R("p_size", "MAX_VALUE", 45)])


# Lookups over the layout that is written for them


@_query("i_point", "SELECT * FROM orders WHERE o_orderkey = 77")
def i_point(spark, sf_dir):
    path = scratch.fresh(spark, "indexed")
    migrate.write_indexed(table(spark, sf_dir, "orders"), path, "o_orderkey", files=8)
    return migrate.point(spark.read.parquet(path), "o_orderkey", 77)


@_query("i_range", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def i_range(spark, sf_dir):
    path = scratch.fresh(spark, "indexed")
    migrate.write_indexed(table(spark, sf_dir, "orders"), path, "o_orderkey", files=8)
    return migrate.between(spark.read.parquet(path), "o_orderkey", 100, 900)


# Retrieval and streams


@_query("t_grounding", r"""
WITH h AS (SELECT doc_id FROM (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') AS w FROM documents) WHERE list_contains(w, 'license') AND list_contains(w, 'work') LIMIT 10)
SELECT CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 3 THEN 'GROUNDED' WHEN count(*) >= 1 THEN 'PARTIAL' ELSE 'UNGROUNDED' END AS status FROM h""")
def t_grounding(spark, sf_dir):
    return text.grounding(t_bm25(spark, sf_dir))


@_query("t_metadata", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND list_has_any([lang, source], ['en', 'web'])")
def t_metadata(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumns({"namespace": F.lit("main"), "tags": F.array("lang", "source")})
    return docs.where(text.metadata_filter(docs, {"namespace": "main", "lang": ["en", "de"], "tags": ["en", "web"]})).select("doc_id")


@_query("t_index_upsert", r"""
SELECT doc_id AS id, CAST(len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS INTEGER) AS length
FROM documents WHERE lang IN ('en', 'fr') AND NOT coalesce(n_chars > 5000, false)""")
def t_index_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    index = text.TextIndex.build(docs.where("lang = 'en'"), "doc_id", "text").upsert(docs.where("lang IN ('en', 'fr')"), "doc_id", "text")
    return index.delete(docs.where("n_chars > 5000"), "doc_id").documents.select("id", "length")


@_query("r_ingest", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 10 GROUP BY 1")
def r_ingest(spark, sf_dir):
    """Files that arrive are judged by rules and sunk batch by batch; the sink is then read."""
    path = scratch.fresh(spark, "ingest")
    files.write(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), f"{path}/in", "csv")
    triggers = rules.Triggers([rules.Trigger("known", "on_ingest", "validate", "events", (rules.Rule("event_id", "NOT_NULL"),))])
    stream = ingest.watch(spark, f"{path}/in", "event_id long, event_type string, value double")
    sink = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")  # noqa: E731  a repeated batch replaces itself
    ingest.on_batches(stream, "events", triggers, f"{path}/checkpoint", sink).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").where("value > 10").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@_query("r_once_per_content", "SELECT DISTINCT sha256(coalesce(text, '')) AS content_hash FROM documents")
def r_once_per_content(spark, sf_dir):
    path = scratch.fresh(spark, "once")
    docs = table(spark, sf_dir, "documents")
    docs.write.parquet(f"{path}/in")  # a stream reads folders only
    stream = spark.readStream.schema(docs.schema).parquet(f"{path}/in").withColumn("at", F.lit(NOW))
    fresh = ingest.once_per_content(stream, "text", "at").select("content_hash")
    fresh.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("content_hash string").parquet(f"{path}/out")


@_query("g_redact", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(?:api[_-]?key|secret|token|password)\b\s*[=:]\s*["'']?[A-Za-z0-9_\-/+=.]{8,}["'']?', '[REDACTED]', 'g'),
  '\bAKIA[0-9A-Z]{16}\b', '[REDACTED]', 'g'), '-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----', '[REDACTED]', 'g'),
  '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED]', 'g'), '\b(?:\d{4}[ -]){3}\d{4}\b', '[REDACTED]', 'g') AS text FROM documents""")
def g_redact(spark, sf_dir):
    return guard.redact(table(spark, sf_dir, "documents").select("doc_id", "text"))
