"""One query for each operator, with the SQL that another engine answers it by."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import codecs, dates
from .functions import exprs as X
from .functions.udf import scalar
from .operators import dml
from .operators.txn import transaction
from .plans import recursion
from .plans.params import Param, QueryDef, indexed
from .plans.query import ascending, cursor, descending, exactly_one, fetch_at_most, fetch_one, row, select
from .sources.shared import shared_dir
from .sources.tables import TableDef, create_as, nested, scan, validate, view
from .streaming.live import file_snapshots, first_row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c, lit = F.col, F.lit


def key(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def optional_priority(df: DataFrame) -> DataFrame:
    """The test tables hold no nulls; this makes some."""
    return df.withColumn("p", F.nullif(c("o_orderpriority"), lit("5-LOW")))


P = "(SELECT *, nullif(o_orderpriority, '5-LOW') AS p FROM orders)"
CUSTOMER = TableDef("customer", T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())]), ("c_custkey",))

# --- sources ---------------------------------------------------------------------------------------------------------


@key("scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(s, d):
    return scan(s, d, "orders", "t0").select("t0.o_orderkey", "t0.o_custkey", "t0.o_totalprice")


@key("from_subquery", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def _(s, d):
    inner = select(F.count("*").alias("n")).from_(scan(s, d, "orders")).group_by("o_custkey").df()
    return select(F.count("*").alias("customers")).from_(inner).group_by("n").df()


@key("scalar_select", "SELECT CAST(1 + 2 AS BIGINT) AS three, 'a' || 'b' AS ab")
def _(s, d):
    return select((lit(1) + lit(2)).cast("bigint").alias("three"), X.concat("a", "b").alias("ab")).df(s)


@key("view_scan", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def _(s, d):
    v = view(scan(s, d, "customer").where("c_acctbal > 0"), "rich_customer")
    return select("c_mktsegment", F.count("*").alias("n")).from_(v).group_by("c_mktsegment").df()


def _folder(s) -> str:
    return f"{shared_dir(s)}/lumenframe/{uuid.uuid4().hex}"


@key("create_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def _(s, d):
    name = CUSTOMER.create(s, f"customer_{uuid.uuid4().hex}", _folder(s))
    CUSTOMER.scan(s, d).where("c_acctbal > 5000").write.insertInto(name)
    return s.table(name)


@key("create_table_if_not_exists", "SELECT CAST(0 AS BIGINT) AS before, count(*) AS after FROM region")
def _(s, d):
    regions = TableDef("region", scan(s, d, "region").schema)
    name = regions.create(s, f"region_{uuid.uuid4().hex}", _folder(s))
    before = s.table(name).agg(F.count("*").alias("before")).first().before
    regions.scan(s, d).write.insertInto(name)
    regions.create(s, name)  # it is there, so nothing happens
    return s.table(name).agg(lit(before).cast("bigint").alias("before"), F.count("*").alias("after"))


@key("ctas", "SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY 1")
def _(s, d):
    return create_as(scan(s, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations")), f"nations_{uuid.uuid4().hex}", _folder(s))


@key("qualified_name", "SELECT r_name FROM region WHERE r_regionkey > 2")
def _(s, d):
    name = f"spark_catalog.default.region_{uuid.uuid4().hex}"
    create_as(scan(s, d, "region"), name, _folder(s))
    return s.table(name).where("r_regionkey > 2").select("r_name")


# --- projection, filter and predicates -------------------------------------------------------------------------------


@key("select_all", "SELECT * FROM nation")
def _(s, d):
    return select("t0.*").from_(scan(s, d, "nation")).df()


@key("project", "SELECT c_custkey AS id, c_acctbal * 2 AS twice FROM customer")
def _(s, d):
    return select(c("c_custkey").alias("id"), (c("c_acctbal") * 2).alias("twice")).from_(scan(s, d, "customer")).df()


@key("row_tuple", "SELECT s_suppkey AS c0, s_name AS c1, s_nationkey AS c2 FROM supplier")
def _(s, d):
    return select(*row(c("s_suppkey"), c("s_name"), c("s_nationkey"))).from_(scan(s, d, "supplier")).df()


@key("project_scalar", "SELECT p_retailprice AS c0 FROM part")
def _(s, d):
    return select(*row(c("p_retailprice"))).from_(scan(s, d, "part")).df()


@key("filter", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
def _(s, d):
    return select("o_orderkey").from_(scan(s, d, "orders")).where(c("o_totalprice") > 400000).df()


@key("filter_and_or", "SELECT p_partkey FROM part WHERE (p_size > 40 AND p_type = 'ECONOMY') OR p_brand = 'Brand#1'")
def _(s, d):
    q = select("p_partkey").from_(scan(s, d, "part")).where(c("p_size") > 40).or_(c("p_brand") == "Brand#1").and_(c("p_type") == "ECONOMY")
    return q.df()


@key("eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    return scan(s, d, "orders").where(X.eq(c("o_orderstatus"), "F")).select("o_orderkey")


@key("neq", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def _(s, d):
    return scan(s, d, "orders").where(X.neq(c("o_orderstatus"), "F")).select("o_orderkey")


@key("eq_nullsafe", f"SELECT o_orderkey, p IS NOT DISTINCT FROM '1-URGENT' AS urgent, p IS NOT DISTINCT FROM NULL AS missing FROM {P}")
def _(s, d):
    df = optional_priority(scan(s, d, "orders"))
    return df.select("o_orderkey", X.eq(c("p"), "1-URGENT", True).alias("urgent"), X.eq(c("p"), lit(None), True).alias("missing"))


@key("neq_nullsafe", f"SELECT o_orderkey FROM {P} WHERE p IS DISTINCT FROM '1-URGENT'")
def _(s, d):
    return optional_priority(scan(s, d, "orders")).where(X.neq(c("p"), "1-URGENT", True)).select("o_orderkey")


@key("compare", f"SELECT o_orderkey, p < '3' AS lt, p <= '3-MEDIUM' AS le, o_totalprice > 1e5 AS gt, o_totalprice >= 2e5 AS ge FROM {P}")
def _(s, d):
    p, t = c("p"), c("o_totalprice")
    return optional_priority(scan(s, d, "orders")).select("o_orderkey", (p < "3").alias("lt"), (p <= "3-MEDIUM").alias("le"), (t > 1e5).alias("gt"), (t >= 2e5).alias("ge"))


@key("between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def _(s, d):
    return scan(s, d, "lineitem").where(c("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber", "l_quantity")


@key("not_between", "SELECT count(*) AS n FROM lineitem WHERE l_quantity NOT BETWEEN 10 AND 12")
def _(s, d):
    return scan(s, d, "lineitem").where(~c("l_quantity").between(10, 12)).agg(F.count("*").alias("n"))


@key("boolean_logic", f"SELECT o_orderkey, NOT (p = '1-URGENT') AS a, (p = '1-URGENT') AND o_orderstatus = 'F' AS b, (p = '1-URGENT') OR o_orderstatus = 'F' AS c FROM {P}")
def _(s, d):
    u, f = c("p") == "1-URGENT", c("o_orderstatus") == "F"
    return optional_priority(scan(s, d, "orders")).select("o_orderkey", (~u).alias("a"), (u & f).alias("b"), (u | f).alias("c"))


@key("is_null", f"SELECT count(*) AS n FROM {P} WHERE p IS NULL")
def _(s, d):
    return optional_priority(scan(s, d, "orders")).where(c("p").isNull()).agg(F.count("*").alias("n"))


@key("not_null", f"SELECT count(*) AS n FROM {P} WHERE p IS NOT NULL")
def _(s, d):
    return optional_priority(scan(s, d, "orders")).where(c("p").isNotNull()).agg(F.count("*").alias("n"))


@key("in_list", f"SELECT o_orderkey, p IN ('1-URGENT', NULL) AS hit FROM {P}")
def _(s, d):
    return optional_priority(scan(s, d, "orders")).select("o_orderkey", X.in_list(c("p"), ["1-URGENT", None]).alias("hit"))


@key("not_in_list", f"SELECT o_orderkey FROM {P} WHERE p NOT IN ('1-URGENT', '2-HIGH')")
def _(s, d):
    return optional_priority(scan(s, d, "orders")).where(X.not_in_list(c("p"), ["1-URGENT", "2-HIGH"])).select("o_orderkey")


@key("in_empty", "SELECT count(*) FILTER (WHERE false) AS inside, count(*) AS outside FROM orders")
def _(s, d):
    df = optional_priority(scan(s, d, "orders"))
    return df.agg(F.count(F.when(X.in_list(c("p"), []), 1)).alias("inside"), F.count(F.when(X.not_in_list(c("p"), []), 1)).alias("outside"))


@key("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(s, d):
    big = scan(s, d, "orders").where("o_totalprice > 450000").select(c("o_custkey").alias("c_custkey"))
    return scan(s, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@key("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(s, d):
    view(scan(s, d, "orders"), "q_orders")
    view(scan(s, d, "customer"), "q_customer")
    return s.sql("SELECT c_custkey FROM q_customer WHERE c_custkey NOT IN (SELECT o_custkey FROM q_orders WHERE o_totalprice > 300000)")


@key("in_cte", "WITH cte0 AS (SELECT p_partkey FROM part WHERE p_size = 7) SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT * FROM cte0)")
def _(s, d):
    cte = scan(s, d, "part").where("p_size = 7").select(c("p_partkey").alias("l_partkey"))
    return scan(s, d, "lineitem").join(cte, "l_partkey", "left_semi").select("l_orderkey", "l_partkey")


@key("not_in_cte", "WITH cte0 AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) SELECT count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT * FROM cte0)")
def _(s, d):
    view(scan(s, d, "supplier"), "q_supplier")
    view(scan(s, d, "lineitem"), "q_lineitem")
    return s.sql("WITH cte0 AS (SELECT s_suppkey FROM q_supplier WHERE s_acctbal > 0) SELECT count(*) AS n FROM q_lineitem WHERE l_suppkey NOT IN (SELECT * FROM cte0)")


@key("like", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%red w_d%'")
def _(s, d):
    return scan(s, d, "part").where(X.like(c("p_name"), "%RED w_d%")).select("p_partkey")


@key("like_escape", "SELECT p_partkey, replace(p_name, ' ', '%') LIKE '%d!%w%' ESCAPE '!' AS hit FROM part")
def _(s, d):
    return scan(s, d, "part").select("p_partkey", X.like(F.replace(c("p_name"), lit(" "), lit("%")), "%D!%w%", "!").alias("hit"))


@key("glob", "SELECT c_custkey FROM customer WHERE c_name GLOB 'Customer#*[13-5]7?'")
def _(s, d):
    return scan(s, d, "customer").where(X.glob(c("c_name"), "Customer#*[13-5]7?")).select("c_custkey")


@key("regexp", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0(12|34)[5-9]$')")
def _(s, d):
    return scan(s, d, "customer").where(X.regexp(c("c_name"), "0(12|34)[5-9]$")).select("c_custkey")


@key("coalesce", f"SELECT o_orderkey, coalesce(p, 'none') AS p FROM {P}")
def _(s, d):
    return optional_priority(scan(s, d, "orders")).select("o_orderkey", F.coalesce("p", lit("none")).alias("p"))


for _name, _sql in {"binary": "p_name = 'red widget'", "nocase": "lower(p_name) = 'red widget'", "rtrim": "rtrim(p_name || '  ') = 'red widget'"}.items():
    @key(f"collate_{_name}", f"SELECT p_partkey FROM part WHERE {_sql}")
    def _(s, d, name=_name):
        left = F.concat("p_name", lit("  ")) if name == "rtrim" else c("p_name")
        right = lit("red widget") if name != "nocase" else lit("RED WIDGET")
        return scan(s, d, "part").where(X.collate(left, name) == X.collate(right, name)).select("p_partkey")


@key("collate_custom", "SELECT p_partkey FROM part WHERE lower(p_name) = 'blue ring'")
def _(s, d):
    return scan(s, d, "part").where(X.collate(c("p_name"), "UNICODE_CI") == X.collate(lit("BLUE ring"), "UNICODE_CI")).select("p_partkey")


# --- joins -----------------------------------------------------------------------------------------------------------


def cust_orders(s, d):
    return scan(s, d, "customer"), scan(s, d, "orders")


@key("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    cu, o = cust_orders(s, d)
    return select("o_orderkey", "c_name").from_(o).join(cu, on=c("o_custkey") == c("c_custkey")).df()


@key("join_theta_range", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey > r_regionkey")
def _(s, d):
    return select("r_name", "n_name").from_(scan(s, d, "region"), "r").join(scan(s, d, "nation"), "n", c("n_regionkey") > c("r_regionkey")).df()


@key("join_left_nullable", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
def _(s, d):
    large = scan(s, d, "orders").where("o_totalprice > 300000")
    return select("c_custkey", "o_orderkey").from_(scan(s, d, "customer")).left_join(large, "o", c("c_custkey") == c("o_custkey")).df()


@key("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(s, d):
    n = scan(s, d, "nation")
    on = (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))
    return select(c("a.n_nationkey").alias("a"), c("b.n_nationkey").alias("b")).from_(n, "a").join(n, "b", on).df()


@key("join_inner_unconstrained", "SELECT r_name, n_name FROM region JOIN nation ON true")
def _(s, d):
    return select("r_name", "n_name").from_(scan(s, d, "region")).join(scan(s, d, "nation")).df()


@key("join_using", "SELECT k, c_name, n FROM (SELECT c_custkey AS k, c_name FROM customer) JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) USING (k)")
def _(s, d):
    cu, o = cust_orders(s, d)
    left, right = cu.select(c("c_custkey").alias("k"), "c_name"), o.groupBy(c("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return select("k", "c_name", "n").from_(left).join(right, using=["k"]).df()


@key("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000")
def _(s, d):
    cu, o = cust_orders(s, d)
    return select("c_custkey", "o_orderkey").from_(cu).left_join(o, on=(c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > 450000)).df()


@key("join_left_using", "SELECT doc_id, lang, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    return select("doc_id", "lang", "toxic").from_(scan(s, d, "documents")).left_join(scan(s, d, "labels"), using=["doc_id"]).df()


@key("join_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def _(s, d):
    on = (c("s_nationkey") == c("n_nationkey")) & (c("s_acctbal") > 5000)
    return select("s_suppkey", "n_name").from_(scan(s, d, "supplier")).right_join(scan(s, d, "nation"), on=on).df()


@key("join_full", "SELECT a.s_suppkey AS a, b.c_custkey AS b FROM (SELECT * FROM supplier WHERE s_suppkey < 50) a FULL JOIN (SELECT * FROM customer WHERE c_custkey BETWEEN 25 AND 90) b ON a.s_suppkey = b.c_custkey")
def _(s, d):
    a, b = scan(s, d, "supplier").where("s_suppkey < 50"), scan(s, d, "customer").where("c_custkey BETWEEN 25 AND 90")
    return select(c("a.s_suppkey").alias("a"), c("b.c_custkey").alias("b")).from_(a, "a").full_join(b, "b", c("a.s_suppkey") == c("b.c_custkey")).df()


@key("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(s, d):
    return select("r_name", "n_name").from_(scan(s, d, "region")).cross_join(scan(s, d, "nation")).df()


@key("join_natural", "SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels")
def _(s, d):
    return select("doc_id", "lang", "quality").from_(scan(s, d, "documents")).natural_join(scan(s, d, "labels")).df()


@key("join_natural_left", "SELECT doc_id, lang, quality FROM documents NATURAL LEFT JOIN labels")
def _(s, d):
    return select("doc_id", "lang", "quality").from_(scan(s, d, "documents")).natural_join(scan(s, d, "labels"), how="left").df()


@key("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
def _(s, d):
    t = scan(s, d, "supplier")
    q = select(c("a.s_suppkey").alias("a"), c("b.s_suppkey").alias("b")).from_(t, "a").join(t, "b", c("a.s_nationkey") == c("b.s_nationkey"))
    return q.where(c("a.s_suppkey") < c("b.s_suppkey")).df()


@key("join_null_safe", f"SELECT a.p AS p, count(*) AS n FROM {P} a JOIN (SELECT DISTINCT p FROM {P}) b ON a.p IS NOT DISTINCT FROM b.p GROUP BY 1")
def _(s, d):
    a = optional_priority(scan(s, d, "orders"))
    j = a.alias("a").join(a.select("p").distinct().alias("b"), X.eq(c("a.p"), c("b.p"), True))
    return j.groupBy(c("a.p").alias("p")).agg(F.count("*").alias("n"))


@key("join_multi", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(s, d):
    q = select("r_name", F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")).from_(scan(s, d, "lineitem"))
    q = q.join(scan(s, d, "orders"), on=c("l_orderkey") == c("o_orderkey")).join(scan(s, d, "customer"), on=c("o_custkey") == c("c_custkey"))
    q = q.join(scan(s, d, "nation"), on=c("c_nationkey") == c("n_nationkey")).join(scan(s, d, "region"), on=c("n_regionkey") == c("r_regionkey"))
    return q.group_by("r_name").df()


# --- aggregation -----------------------------------------------------------------------------------------------------


@key("group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return select("l_returnflag", "l_linestatus", F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).from_(scan(s, d, "lineitem")).group_by("l_returnflag", "l_linestatus").df()


@key("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def _(s, d):
    return select("o_custkey", F.count("*").alias("n")).from_(scan(s, d, "orders")).group_by("o_custkey").having(F.count("*") > 15).df()


AGGREGATES = {
    "count_star": (lambda: F.count("*"), "count(*)"),
    "count": (lambda: F.count("p"), "count(p)"),
    "count_distinct": (lambda: F.count_distinct("p"), "count(DISTINCT p)"),
    "min": (lambda: F.min("p"), "min(p)"),
    "max": (lambda: F.max("p"), "max(p)"),
    "avg": (lambda: F.round(X.avg(c("o_totalprice")), 4), "round(avg(o_totalprice), 4)"),
    "avg_distinct": (lambda: F.round(X.avg(c("o_custkey"), True), 4), "round(avg(DISTINCT o_custkey), 4)"),
    "sum": (lambda: F.sum("o_custkey"), "CAST(sum(o_custkey) AS BIGINT)"),
    "sum_distinct": (lambda: F.sum_distinct("o_custkey"), "CAST(sum(DISTINCT o_custkey) AS BIGINT)"),
    "total": (lambda: F.round(X.total(c("o_totalprice")), 2), "round(coalesce(sum(o_totalprice), 0.0), 2)"),
    "group_concat": (lambda: X.group_concat(c("p")), "string_agg(p, ',' ORDER BY p)"),
    "group_concat_distinct": (lambda: X.group_concat(c("p"), distinct=True), "string_agg(DISTINCT p, ',' ORDER BY p)"),
    "group_concat_sep": (lambda: X.group_concat(c("p"), " | ", True), "string_agg(DISTINCT p, ' | ' ORDER BY p)"),
    "agg_expr": (lambda: F.round(F.sum(c("o_totalprice") * (lit(1) - lit(0.05)) + c("o_custkey")), 2), "round(sum(o_totalprice * (1 - 0.05) + o_custkey), 2)"),
}
for _name, (_fn, _sql) in AGGREGATES.items():
    @key(_name, f"SELECT o_orderstatus, {_sql} AS v FROM {P} GROUP BY o_orderstatus")
    def _(s, d, fn=_fn):
        return optional_priority(scan(s, d, "orders")).groupBy("o_orderstatus").agg(fn().alias("v"))


@key("agg_global", "SELECT count(*) AS n, min(l_shipdate)::DATE::VARCHAR AS first, round(avg(l_discount), 6) AS discount FROM lineitem")
def _(s, d):
    return scan(s, d, "lineitem").agg(F.count("*").alias("n"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first"), F.round(F.avg("l_discount"), 6).alias("discount"))


@key("agg_empty", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, coalesce(sum(o_totalprice), 0.0) AS t, max(o_orderstatus) AS m, avg(o_totalprice) AS a FROM orders WHERE false")
def _(s, d):
    return scan(s, d, "orders").where(lit(False)).agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"), X.total(c("o_totalprice")).alias("t"), F.max("o_orderstatus").alias("m"), F.avg("o_totalprice").alias("a"))


# --- order and limit -------------------------------------------------------------------------------------------------


@key("order_by", f"SELECT p, o_orderkey FROM {P} ORDER BY p ASC NULLS FIRST, o_orderkey DESC")
def _(s, d):
    return select("p", "o_orderkey").from_(optional_priority(scan(s, d, "orders"))).order_by("p", descending("o_orderkey")).df()


@key("order_by_collate", "SELECT p_name, p_partkey FROM part ORDER BY lower(p_name), p_partkey LIMIT 40")
def _(s, d):
    return select("p_name", "p_partkey").from_(scan(s, d, "part")).order_by(ascending(X.collate(c("p_name"), "nocase")), "p_partkey").limit(40).df()


@key("limit", f"SELECT p, o_orderkey FROM {P} ORDER BY p ASC NULLS FIRST, o_orderkey LIMIT 25")
def _(s, d):
    return select("p", "o_orderkey").from_(optional_priority(scan(s, d, "orders"))).order_by("p", "o_orderkey").limit(25).df()


@key("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(s, d):
    return select("o_orderkey", "o_totalprice").from_(scan(s, d, "orders")).order_by(descending("o_totalprice"), "o_orderkey").limit(10).df()


@key("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 20")
def _(s, d):
    return select("c_custkey", "c_acctbal").from_(scan(s, d, "customer")).order_by("c_acctbal", "c_custkey").limit(10).offset(20).df()


@key("offset_only", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
def _(s, d):
    return select("c_custkey").from_(scan(s, d, "customer")).order_by("c_custkey").limit(-1).offset(100).df()


# --- compounds -------------------------------------------------------------------------------------------------------


def _keys(s, d):
    a = select(c("c_nationkey").alias("k")).from_(scan(s, d, "customer")).where(c("c_acctbal") > 9000)
    b = select(c("s_nationkey").alias("k")).from_(scan(s, d, "supplier"))
    return a, b


A, B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier"


@key("union", f"{A} UNION {B}")
def _(s, d):
    a, b = _keys(s, d)
    return a.union(b).df()


@key("union_all", f"{A} UNION ALL {B}")
def _(s, d):
    a, b = _keys(s, d)
    return a.union_all(b).df()


@key("intersect", f"{A} INTERSECT {B}")
def _(s, d):
    a, b = _keys(s, d)
    return a.intersect(b).df()


@key("except", "SELECT n_nationkey AS k FROM nation EXCEPT (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000)")
def _(s, d):
    rich = select("s_nationkey").from_(scan(s, d, "supplier")).where(c("s_acctbal") > 7000)
    return select(c("n_nationkey").alias("k")).from_(scan(s, d, "nation")).except_(rich).df()


@key("compound_chain", f"SELECT k FROM ({A} UNION ALL {B}) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def _(s, d):
    a, b = _keys(s, d)
    return a.union_all(b).intersect(select("n_nationkey").from_(scan(s, d, "nation")).where(c("n_regionkey") == 1)).df()


@key("union_order_by", f"SELECT k FROM ({A} UNION {B}) ORDER BY k DESC LIMIT 5")
def _(s, d):
    a, b = _keys(s, d)
    return a.union(b).order_by(descending("k")).limit(5).df()


@key("union_scalar", "SELECT 1 AS c0 UNION SELECT 2 UNION SELECT 1")
def _(s, d):
    one = lambda v: select(*row(lit(v)))
    return one(1).union(one(2).df(s)).union(one(1).df(s)).df(s)


# --- subqueries and common tables ------------------------------------------------------------------------------------


@key("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
def _(s, d):
    o = scan(s, d, "orders")
    return o.where(c("o_totalprice") > o.agg(F.avg("o_totalprice") * 1.8).scalar()).select("o_orderkey")


@key("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer")
def _(s, d):
    view(scan(s, d, "orders"), "q_orders")
    view(scan(s, d, "customer"), "q_customer")
    return s.sql("SELECT c_custkey, (SELECT max(o_totalprice) FROM q_orders WHERE o_custkey = c_custkey) AS most FROM q_customer")


@key("left_join_subquery", "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def _(s, d):
    sub = scan(s, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return select("c_custkey", "n").from_(scan(s, d, "customer")).left_join(sub, on=c("o_custkey") == c("c_custkey")).df()


SUBTOTAL = "SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS subtotal FROM lineitem GROUP BY l_orderkey"


def subtotals(s, d):
    return scan(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(c("l_extendedprice") * (1 - c("l_discount"))).alias("subtotal"))


@key("cte", f"WITH cte0 AS ({SUBTOTAL}) SELECT o_orderkey, round(subtotal, 4) AS subtotal FROM orders JOIN cte0 ON o_orderkey = l_orderkey WHERE subtotal > 200000")
def _(s, d):
    q = select("o_orderkey", F.round("subtotal", 4).alias("subtotal")).from_(scan(s, d, "orders")).join(subtotals(s, d), on=c("o_orderkey") == c("l_orderkey"))
    return q.where(c("subtotal") > 200000).df()


@key("cte_multi", f"WITH cte0 AS ({SUBTOTAL}), cte1 AS (SELECT o_custkey, sum(subtotal) AS revenue FROM orders JOIN cte0 ON o_orderkey = l_orderkey GROUP BY 1) SELECT c_mktsegment, round(sum(revenue), 3) AS revenue FROM cte1 JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    one = scan(s, d, "orders").join(subtotals(s, d), c("o_orderkey") == c("l_orderkey")).groupBy("o_custkey").agg(F.sum("subtotal").alias("revenue"))
    return one.join(scan(s, d, "customer"), c("o_custkey") == c("c_custkey")).groupBy("c_mktsegment").agg(F.round(F.sum("revenue"), 3).alias("revenue"))


@key("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
def _(s, d):
    return recursion.union_all(s, "t", ["n", "f"], "SELECT 1, CAST(1 AS BIGINT)", "SELECT n + 1, f * (n + 1) FROM t WHERE n < 15", "SELECT n, f FROM t")


@key("recursive_cte_union", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation), r(n) AS (SELECT 0 UNION SELECT b FROM r JOIN e ON a = n) SELECT n FROM r")
def _(s, d):
    edges = scan(s, d, "nation").select(c("n_nationkey").alias("a"), ((c("n_nationkey") * 3 + 1) % 25).alias("b"))
    return recursion.union(s.range(1).select(lit(0).alias("n")), lambda f: f.join(edges, c("a") == c("n")).select(c("b").alias("n")))


@key("cte_scalar", "WITH cte0(value) AS (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) SELECT value, count(*) AS n FROM cte0 GROUP BY 1")
def _(s, d):
    return scan(s, d, "orders").where("o_totalprice > 480000").select(c("o_custkey").alias("value")).groupBy("value").agg(F.count("*").alias("n"))


@key("recursive_cte_scalar", "WITH RECURSIVE t(value) AS (SELECT 1 UNION ALL SELECT value * 2 FROM t WHERE value < 1000) SELECT value FROM t")
def _(s, d):
    return recursion.union_all(s, "t", ["value"], "SELECT 1", "SELECT value * 2 FROM t WHERE value < 1000", "SELECT value FROM t")


@key("cte_materialized", f"WITH cte0 AS MATERIALIZED ({SUBTOTAL}) SELECT count(*) AS n FROM cte0 a JOIN cte0 b ON a.l_orderkey = b.l_orderkey + 1")
def _(s, d):
    subtotals(s, d).write.parquet(folder := _folder(s))
    once = s.read.parquet(folder)
    return once.alias("a").join(once.alias("b"), c("a.l_orderkey") == c("b.l_orderkey") + 1).agg(F.count("*").alias("n"))


# --- arithmetic, strings, casts, conditionals, JSON ------------------------------------------------------------------


EXPRESSIONS = {
    "int_arith": ("part", "p_partkey", lambda: c("p_size") * 3 + c("p_partkey") - 7, "p_size * 3 + p_partkey - 7"),
    "int_div": ("part", "p_partkey", lambda: X.int_div(c("p_partkey") - 900, c("p_size") % 3), "CAST((p_partkey - 900) // nullif(p_size % 3, 0) AS BIGINT)"),
    "int_mod": ("part", "p_partkey", lambda: X.int_mod(c("p_partkey") - 900, (c("p_size") % 4).cast("bigint")), "(p_partkey - 900) % nullif(p_size % 4, 0)"),
    "real_arith": ("lineitem", "l_orderkey", lambda: F.round(X.real_div(c("l_extendedprice") * (1 + c("l_tax")) - 5.0, c("l_discount")), 6), "round((l_extendedprice * (1 + l_tax) - 5.0) / nullif(l_discount, 0), 6)"),
    "unary": ("customer", "c_custkey", lambda: -c("c_acctbal") + F.positive(c("c_acctbal")) * 2, "-c_acctbal + (+c_acctbal) * 2"),
    "bitwise_not": ("customer", "c_custkey", lambda: F.bitwise_not(c("c_custkey")), "~c_custkey"),
    "abs": ("customer", "c_custkey", lambda: F.abs("c_acctbal"), "abs(c_acctbal)"),
    "round": ("customer", "c_custkey", lambda: X.round_half_away(c("c_acctbal"), 1), "round(c_acctbal, 1)"),
    "floor": ("customer", "c_custkey", lambda: X.floor(c("c_acctbal")), "floor(c_acctbal)"),
    "scalar_min": ("part", "p_partkey", lambda: X.scalar_min(c("p_size"), F.nullif(c("p_size") % 7, lit(0)), 5), "CASE WHEN nullif(p_size % 7, 0) IS NOT NULL THEN least(p_size, p_size % 7, 5) END"),
    "scalar_max": ("part", "p_partkey", lambda: X.scalar_max(c("p_size"), F.nullif(c("p_size") % 7, lit(0)), 5), "CASE WHEN nullif(p_size % 7, 0) IS NOT NULL THEN greatest(p_size, p_size % 7, 5) END"),
    "concat": ("orders", "o_orderkey", lambda: X.concat(c("o_orderstatus"), "/", F.nullif(c("o_orderpriority"), lit("5-LOW"))), "o_orderstatus || '/' || nullif(o_orderpriority, '5-LOW')"),
    "printf": ("customer", "c_custkey", lambda: X.printf("%05d|%-8s|%.2f|%%", c("c_custkey"), F.substring("c_mktsegment", 1, 4), F.abs("c_acctbal").cast("int")), "printf('%05d|%-8s|%.2f|%%', c_custkey, substring(c_mktsegment, 1, 4), CAST(CAST(trunc(abs(c_acctbal)) AS INTEGER) AS DOUBLE))"),
    "cast_bool_int": ("customer", "c_custkey", lambda: (c("c_acctbal") > 0).cast("bigint"), "CAST(c_acctbal > 0 AS BIGINT)"),
    "cast_int_real": ("customer", "c_custkey", lambda: c("c_nationkey").cast("double"), "CAST(c_nationkey AS DOUBLE)"),
    "cast_int_text": ("customer", "c_custkey", lambda: c("c_nationkey").cast("string"), "CAST(c_nationkey AS VARCHAR)"),
    "cast_real_int": ("customer", "c_custkey", lambda: X.real_to_int(c("c_acctbal")), "CAST(trunc(c_acctbal) AS BIGINT)"),
    "cast_real_text": ("part", "p_partkey", lambda: c("p_retailprice").cast("string"), "CAST(p_retailprice AS VARCHAR)"),
    "cast_text_int": ("orders", "o_orderkey", lambda: X.text_to_int(F.concat(lit(" "), c("o_orderpriority"))), "CAST(regexp_extract(o_orderpriority, '^([0-9]+)', 1) AS BIGINT)"),
    "cast_text_real": ("part", "p_partkey", lambda: X.text_to_real(F.concat(c("p_retailprice").cast("string"), lit("abc"))), "p_retailprice"),
    "cast_text_blob": ("customer", "c_custkey", lambda: F.hex(c("c_mktsegment").cast("binary")), "hex(c_mktsegment)"),
    "cast_blob_text": ("customer", "c_custkey", lambda: c("c_name").cast("binary").cast("string"), "c_name"),
    "iif": ("orders", "o_orderkey", lambda: X.iif(F.nullif(c("o_orderpriority"), lit("5-LOW")) == "1-URGENT", "now", "later"), "CASE WHEN nullif(o_orderpriority, '5-LOW') = '1-URGENT' THEN 'now' ELSE 'later' END"),
    "case_simple": ("orders", "o_orderkey", lambda: X.case_simple(c("o_orderstatus"), [("F", "filled"), ("O", "open")], "pending"), "CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'pending' END"),
    "case_searched": ("customer", "c_custkey", lambda: X.case_searched([(c("c_acctbal") < 0, "debt"), (c("c_acctbal") > 5000, "rich")]), "CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' END"),
    "json_array_length": ("events", "event_id", lambda: X.json_array_length(F.when(c("user_id") % 2 == 0, F.concat(lit("["), c("props"), lit(", 1, null]"))).otherwise(c("props"))), "CAST(CASE WHEN user_id % 2 = 0 THEN 3 ELSE 0 END AS BIGINT)"),
    "json_array_length_path": ("events", "event_id", lambda: X.json_array_length(F.concat(lit('{"a": [1, '), c("props"), lit("]}")), "$.a"), "CAST(json_array_length('{\"a\": [1, ' || props || ']}', '$.a') AS BIGINT)"),
    "json_valid": ("events", "event_id", lambda: X.json_valid(F.when(c("user_id") % 3 == 0, F.concat(c("props"), lit("}"))).otherwise(c("props"))), "json_valid(CASE WHEN user_id % 3 = 0 THEN props || '}' ELSE props END)"),
}
for _name, (_table, _id, _fn, _sql) in EXPRESSIONS.items():
    @key(_name, f"SELECT {_id}, {_sql} AS v FROM {_table}")
    def _(s, d, table=_table, id=_id, fn=_fn):
        return scan(s, d, table).select(id, fn().alias("v"))


# --- dates -----------------------------------------------------------------------------------------------------------


def event_times(s, d):
    """event_id and the time as text with milliseconds; some values are no time."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    return scan(s, d, "events").select("event_id", F.when(c("event_id") % 50 != 0, text).otherwise("never").alias("x"))


EVENTS = "(SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN date_trunc('millisecond', ts) END AS t FROM events)"
CARRY = "CAST(date_trunc('month', t + INTERVAL ({0}) MONTH) + INTERVAL (day(t) - 1) DAY AS DATE)"
DATES = {
    "date_fn": (lambda: dates.date(c("x")), "strftime(t, '%Y-%m-%d')"),
    "time_fn": (lambda: dates.time(c("x")), "strftime(t, '%H:%M:%S')"),
    "datetime_fn": (lambda: dates.datetime(c("x")), "strftime(t, '%Y-%m-%d %H:%M:%S')"),
    "julian_day": (lambda: F.round(dates.julian_day(c("x")), 6), "round(epoch_us(t) / 86400000000.0 + 2440587.5, 6)"),
    "unix_epoch": (lambda: dates.unix_epoch(c("x")), "CAST(floor(epoch_us(t) / 1000000) AS BIGINT)"),
    "unix_epoch_subsec": (lambda: dates.unix_epoch(c("x"), "subsec"), "epoch_us(t) / 1000000.0"),
    "strftime": (lambda: dates.strftime("%Y/%m/%d %H-%M-%S day %j of %w%%", c("x")), "strftime(t, '%Y/%m/%d %H-%M-%S day %j of %w') || CASE WHEN t IS NOT NULL THEN '%' END"),
    "day_of_year": (lambda: dates.day_of_year(c("x")), "dayofyear(t)"),
    "day_of_week": (lambda: dates.day_of_week(c("x")), "CAST(dayofweek(t) AS BIGINT)"),
    "week_of_year": (lambda: dates.week_of_year(c("x")), "CAST(strftime(t, '%W') AS BIGINT)"),
    "date_modifiers": (lambda: dates.datetime(c("x"), "+3 days", "-2 hours", "+90 minutes", "-1.5 seconds"), "strftime(t + INTERVAL 3 DAY - INTERVAL 2 HOUR + INTERVAL 90 MINUTE - INTERVAL 1500 MILLISECOND, '%Y-%m-%d %H:%M:%S')"),
    "date_add_months": (lambda: F.concat_ws(" ", dates.date(c("x"), "+1 month"), dates.date(c("x"), "start of year", "+30 days", "+1 month"), dates.date(c("x"), "-2 years")),
                        f"concat_ws(' ', strftime({CARRY.format(1)}, '%Y-%m-%d'), CASE WHEN t IS NOT NULL THEN strftime(make_date(CAST(year(t) AS BIGINT), 2, 1) + INTERVAL 30 DAY, '%Y-%m-%d') END, strftime({CARRY.format(-24)}, '%Y-%m-%d'))"),
    "date_start_of": (lambda: F.concat_ws(" ", dates.datetime(c("x"), "start of day"), dates.date(c("x"), "start of month"), dates.date(c("x"), "start of year")),
                      "concat_ws(' ', strftime(date_trunc('day', t), '%Y-%m-%d %H:%M:%S'), strftime(date_trunc('month', t), '%Y-%m-%d'), strftime(date_trunc('year', t), '%Y-%m-%d'))"),
    "date_weekday": (lambda: dates.date(c("x"), "weekday 1"), "strftime(t + INTERVAL ((8 - dayofweek(t)) % 7) DAY, '%Y-%m-%d')"),
    "date_floor": (lambda: dates.date(c("x"), "start of year", "+30 days", "+1 month", "floor"), "CASE WHEN t IS NOT NULL THEN strftime(make_date(CAST(year(t) AS BIGINT), 1, 31) + INTERVAL 1 MONTH, '%Y-%m-%d') END"),
    "date_tz": (lambda: dates.datetime(c("x"), "localtime", "utc"), "strftime(t, '%Y-%m-%d %H:%M:%S')"),
}
for _name, (_fn, _sql) in DATES.items():
    @key(_name, f"SELECT event_id, {_sql} AS v FROM {EVENTS}")
    def _(s, d, fn=_fn):
        return event_times(s, d).select("event_id", fn().alias("v"))


@key("date_parts", f"SELECT event_id, year(t) AS y, month(t) AS m, day(t) AS d, hour(t) AS h, minute(t) AS mi, second(t) AS s FROM {EVENTS}")
def _(s, d):
    x = c("x")
    return event_times(s, d).select("event_id", dates.year(x).alias("y"), dates.month(x).alias("m"), dates.day(x).alias("d"), dates.hour(x).alias("h"), dates.minute(x).alias("mi"), dates.second(x).alias("s"))


@key("codec_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || printf('%03d', CAST((epoch_us(ts) // 1000) % 1000 AS INTEGER)) || 'Z' AS text, CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) AS millis, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 5) AS julian FROM events")
def _(s, d):
    r = codecs.standard()
    ts = c("ts").cast("timestamp")
    enc = lambda k: r.find("timestamp", (k, 1)).encode(ts)
    return scan(s, d, "events").select("event_id", enc("date-text").alias("text"), enc("date-millis").alias("millis"), F.round(enc("date-julian"), 5).alias("julian"))


@key("nested_composite", "SELECT o_orderkey, c_custkey AS customer_c_custkey, c_name AS customer_c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    cu = scan(s, d, "customer").select("c_custkey", "c_name")
    j = scan(s, d, "orders").alias("o").join(cu.alias("e"), c("o_custkey") == c("e.c_custkey"))
    return j.select("o_orderkey", *nested(cu, "e", "customer"))


@key("enum_raw", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def _(s, d):
    codec = codecs.enum_codec(["F", "O", "P"], "status")
    return scan(s, d, "orders").select("o_orderkey", codec.decode(c("o_orderstatus")).alias("o_orderstatus")).where(c("o_orderstatus").isin(codec.encode(lit("F")), codec.encode(lit("P"))))


@key("enum_unknown", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(s, d):
    return scan(s, d, "orders").select("o_orderkey", codecs.checked_enum(c("o_orderstatus"), ["F", "O", "P"], "status").alias("o_orderstatus"))


# --- data-changing statements ----------------------------------------------------------------------------------------


NEW = "(SELECT s_suppkey + 95 AS s_suppkey, 'New' || s_suppkey AS s_name, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey < 10)"


def supplier(s, d):
    t = scan(s, d, "supplier")
    new = t.where("s_suppkey < 10").select((c("s_suppkey") + 95).alias("s_suppkey"), X.concat("New", c("s_suppkey").cast("string")).alias("s_name"), "s_nationkey", (c("s_acctbal") + 1).alias("s_acctbal"))
    return t, new


@key("insert_values", "SELECT * FROM region UNION ALL SELECT 5, 'MOON'")
def _(s, d):
    t = scan(s, d, "region")
    return dml.insert(t, s.range(1).select(lit(5).alias("r_regionkey"), lit("MOON").alias("r_name"))).table


@key("insert_select", f"SELECT * FROM supplier UNION ALL SELECT * FROM {NEW}")
def _(s, d):
    return dml.insert(*supplier(s, d)).table


@key("insert_or_ignore", f"SELECT * FROM supplier UNION ALL SELECT * FROM {NEW} n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(s, d):
    return dml.insert_or(*supplier(s, d), "ignore", ["s_suppkey"]).table


REPLACED = f"SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM {NEW}) UNION ALL SELECT * FROM {NEW}"


@key("insert_or_replace", REPLACED)
def _(s, d):
    return dml.insert_or(*supplier(s, d), "replace", ["s_suppkey"]).table


def _refused(action: str):
    """A batch with a key that exists is refused whole, the table stays; one without goes in."""

    def run(s, d):
        table, new = supplier(s, d)
        try:
            dml.insert_or(table, new.unionByName(table.where("s_suppkey = 1")), action, ["s_suppkey"])
        except dml.ConflictError:
            return dml.insert_or(table, new.withColumn("s_suppkey", c("s_suppkey") + 1_000_000), action, ["s_suppkey"]).table
        return table.limit(0)

    return run


for _action in ("abort", "fail", "rollback"):
    key(f"insert_or_{_action}", "SELECT * FROM supplier UNION ALL SELECT s_suppkey + 1000095, 'New' || s_suppkey, s_nationkey, s_acctbal + 1 FROM supplier WHERE s_suppkey < 10")(_refused(_action))


@key("replace", REPLACED)
def _(s, d):
    return dml.replace(*supplier(s, d), ["s_suppkey"]).table


@key("upsert_nothing", f"SELECT * FROM supplier UNION ALL SELECT * FROM {NEW} n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(s, d):
    return dml.upsert_nothing(*supplier(s, d), ["s_suppkey"]).table


@key("upsert_update", f"SELECT coalesce(t.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(t.s_name, n.s_name) AS s_name, coalesce(t.s_nationkey, n.s_nationkey) AS s_nationkey, CASE WHEN t.s_suppkey IS NULL THEN n.s_acctbal WHEN n.s_suppkey IS NULL THEN t.s_acctbal ELSE t.s_acctbal + n.s_acctbal END AS s_acctbal FROM supplier t FULL JOIN {NEW} n ON t.s_suppkey = n.s_suppkey")
def _(s, d):
    return dml.upsert_update(*supplier(s, d), ["s_suppkey"], {"s_acctbal": c("t.s_acctbal") + c("excluded.s_acctbal")}).table


@key("upsert_update_where", f"SELECT coalesce(t.s_suppkey, n.s_suppkey) AS s_suppkey, CASE WHEN t.s_suppkey IS NULL OR (n.s_suppkey IS NOT NULL AND t.s_acctbal < n.s_acctbal) THEN n.s_name ELSE t.s_name END AS s_name, coalesce(t.s_nationkey, n.s_nationkey) AS s_nationkey, coalesce(t.s_acctbal, n.s_acctbal) AS s_acctbal FROM supplier t FULL JOIN {NEW} n ON t.s_suppkey = n.s_suppkey")
def _(s, d):
    return dml.upsert_update(*supplier(s, d), ["s_suppkey"], {"s_name": c("excluded.s_name")}, c("t.s_acctbal") < c("excluded.s_acctbal")).table


@key("update", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey = 3 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def _(s, d):
    return dml.update(supplier(s, d)[0], {"s_acctbal": c("s_acctbal") * 2}, c("s_nationkey") == 3).table


@key("update_null", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier")
def _(s, d):
    return dml.update(supplier(s, d)[0], {"s_name": lit(None)}, c("s_acctbal") < 0).table


UPDATED_FROM = "SELECT s_suppkey, coalesce(n_name, s_name) AS s_name, s_nationkey, s_acctbal FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 2) ON s_nationkey = n_nationkey"


@key("update_from", UPDATED_FROM)
def _(s, d):
    src = scan(s, d, "nation").where("n_regionkey = 2").select(c("n_nationkey").alias("s_nationkey"), "n_name")
    return dml.update_from(supplier(s, d)[0], src, ["s_nationkey"], {"s_name": c("s.n_name")}).table


@key("update_with_cte", "WITH best AS (SELECT s_nationkey, max(s_acctbal) AS top FROM supplier GROUP BY 1) SELECT s_suppkey, s_name, s.s_nationkey, top AS s_acctbal FROM supplier s JOIN best b ON s.s_nationkey = b.s_nationkey")
def _(s, d):
    t = supplier(s, d)[0]
    best = t.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("top"))
    return dml.update_from(t, best, ["s_nationkey"], {"s_acctbal": c("s.top")}).table


@key("delete", "SELECT * FROM supplier WHERE NOT (s_acctbal < 2000)")
def _(s, d):
    return dml.delete(supplier(s, d)[0], c("s_acctbal") < 2000).table


@key("insert_returning", f"SELECT s_suppkey, s_name FROM {NEW} n")
def _(s, d):
    return dml.insert(*supplier(s, d)).returning("s_suppkey", "s_name")


@key("update_returning", "SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_nationkey = 3")
def _(s, d):
    return dml.update(supplier(s, d)[0], {"s_acctbal": c("s_acctbal") * 2}, c("s_nationkey") == 3).returning("s_suppkey", "s_acctbal")


@key("delete_returning", "SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000")
def _(s, d):
    return dml.delete(supplier(s, d)[0], c("s_acctbal") < 2000).returning("s_suppkey")


# --- execution, parameters, functions --------------------------------------------------------------------------------


def _rows(s, rows, like: DataFrame) -> DataFrame:
    return s.createDataFrame(rows, like.schema)


@key("fetch_one", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1")
def _(s, d):
    df = scan(s, d, "orders").orderBy("o_orderkey").select("o_orderkey", "o_custkey")
    return _rows(s, [fetch_one(df)], df)


@key("fetch_at_most", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
def _(s, d):
    df = scan(s, d, "orders").orderBy("o_orderkey").select("o_orderkey")
    return _rows(s, fetch_at_most(df, 5), df)


@key("cursor", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
def _(s, d):
    df = scan(s, d, "orders").orderBy("o_orderkey").select("o_orderkey")
    return _rows(s, list(islice(cursor(df), 7)), df)  # seven steps of the cursor


@key("static_query", "SELECT p_partkey, p_brand FROM part WHERE p_size = 7")
def _(s, d):
    q = QueryDef("of_size", lambda spark, size: scan(spark, d, "part").where(c("p_size") == size).select("p_partkey", "p_brand"), (Param("size", "int"),))
    return q.df(s, size=7)


@key("static_query_one", "SELECT p_partkey, p_brand FROM part WHERE p_partkey = 7")
def _(s, d):
    part = scan(s, d, "part").select("p_partkey", "p_brand")
    q = QueryDef("one", lambda spark, k: part.where(c("p_partkey") == k), (Param("k", "bigint"),), cardinality="exactlyOne")
    return _rows(s, [q.fetch(s, k=7)], part)


@key("write_command", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def _(s, d):
    folder = _folder(s)
    scan(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).write.parquet(folder)
    return s.read.parquet(folder)


@key("cardinality", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def _(s, d):
    df = scan(s, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name")
    return _rows(s, [exactly_one(df)], df)


@key("bind_named", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND o_custkey < 500")
def _(s, d):
    view(scan(s, d, "orders"), "q_orders")
    q = QueryDef("big", "SELECT o_orderkey FROM q_orders WHERE o_totalprice > :price AND o_orderstatus = :status AND o_custkey < :cust", (Param("price", "double"), Param("status", "string"), Param("cust", "bigint")))
    return q.df(s, price=100000.0, status="F", cust=500)


@key("bind_repeated", "SELECT p_partkey FROM part WHERE p_size = 7 OR p_partkey % 100 = 7")
def _(s, d):
    view(scan(s, d, "part"), "q_part")
    return QueryDef("seven", "SELECT p_partkey FROM q_part WHERE p_size = :n OR p_partkey % 100 = :n", (Param("n", "int"),)).df(s, n=7)


@key("bind_indexed", "SELECT p_partkey FROM part WHERE p_size = 7 AND p_brand = 'Brand#2'")
def _(s, d):
    view(scan(s, d, "part"), "q_part")
    return indexed(s, "SELECT p_partkey FROM q_part WHERE p_size = ? AND p_brand = ?", 7, "Brand#2")


@scalar("vat", "double", 2)
def vat(price, rate):
    return (price * (1 + rate)).round(2)


@key("udf_scalar", "SELECT p_partkey, round(p_retailprice * 1.5, 2) AS v FROM part")
def _(s, d):
    return scan(s, d, "part").select("p_partkey", vat(c("p_retailprice"), lit(0.5)).alias("v"))


@key("udf_registered", "SELECT p_partkey, round(p_retailprice * 1.5, 2) AS v FROM part")
def _(s, d):
    vat.register(s)
    view(scan(s, d, "part"), "q_part")
    return s.sql("SELECT p_partkey, vat(p_retailprice, 0.5D) AS v FROM q_part")


@key("validate_schema", "SELECT s_suppkey, s_name FROM supplier")
def _(s, d):
    df = scan(s, d, "supplier").select("s_suppkey", "s_name")
    return validate(df, T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType())]))


# --- transactions and live queries -----------------------------------------------------------------------------------


@key("txn_commit", "SELECT * FROM (SELECT s_suppkey, s_name, s_nationkey, s_acctbal + CASE WHEN s_nationkey = 3 THEN 1 ELSE 0 END AS s_acctbal FROM supplier) WHERE NOT (s_acctbal < 2000)")
def _(s, d):
    tables = {"supplier": scan(s, d, "supplier")}
    with transaction(tables, _folder(s)) as t:
        t.apply("supplier", dml.update(t.read("supplier"), {"s_acctbal": c("s_acctbal") + 1}, c("s_nationkey") == 3))
        t.apply("supplier", dml.delete(t.read("supplier"), c("s_acctbal") < 2000))
    return tables["supplier"]


class _GaveUp(Exception):
    pass


@key("txn_rollback", "SELECT * FROM supplier")
def _(s, d):
    tables = {"supplier": scan(s, d, "supplier")}
    try:
        with transaction(tables, _folder(s)) as t:
            t.apply("supplier", dml.delete(t.read("supplier"), c("s_acctbal") < 2000))
            raise _GaveUp
    except _GaveUp:
        pass
    return tables["supplier"]


def _live(s, d, query, cut=lambda df: df) -> DataFrame:
    """Suppliers come in two commits; after each one the query's newest snapshot is delivered."""
    folder, t = _folder(s), scan(s, d, "supplier")
    for some in (t.where("s_acctbal >= 5000"), t.where("s_acctbal >= 2000 AND s_acctbal < 5000")):
        some.write.mode("append").parquet(f"{folder}/supplier")
        file_snapshots(s, f"{folder}/supplier", t.schema, query, f"{folder}/progress", lambda n, df: cut(df).write.mode("overwrite").parquet(f"{folder}/snapshot"))
    return s.read.parquet(f"{folder}/snapshot")


def _by_nation(df: DataFrame) -> DataFrame:
    return df.groupBy("s_nationkey").agg(F.count("*").alias("n"))


@key("live_query", "SELECT s_nationkey, count(*) AS n FROM supplier WHERE NOT (s_acctbal < 2000) GROUP BY 1")
def _(s, d):
    return _live(s, d, _by_nation)


@key("live_query_first", "SELECT s_nationkey, count(*) AS n FROM supplier WHERE NOT (s_acctbal < 2000) GROUP BY 1 ORDER BY n DESC, s_nationkey LIMIT 1")
def _(s, d):
    return _live(s, d, _by_nation, first_row(F.desc("n"), "s_nationkey"))


@key("live_query_batch", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1")
def _(s, d):
    folder, orders = _folder(s), f"{d}/orders*.parquet"  # a stream takes a pattern or a folder, not one file
    counts = lambda df: df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    file_snapshots(s, orders, s.read.parquet(orders).schema, counts, f"{folder}/progress", lambda n, df: df.write.mode("overwrite").parquet(f"{folder}/snapshot"))
    return s.read.parquet(f"{folder}/snapshot")


@key("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def _(s, d):
    return select("o_orderkey", "o_custkey", "o_totalprice").from_(scan(s, d, "orders")).where(c("o_orderkey") == 77).df()


@key("page_of_two_joins", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ORDER BY o_orderkey LIMIT 32")
def _(s, d):
    q = select("o_orderkey", "c_name", "n_name").from_(scan(s, d, "orders")).join(scan(s, d, "customer"), on=c("o_custkey") == c("c_custkey")).join(scan(s, d, "nation"), on=c("c_nationkey") == c("n_nationkey"))
    return q.order_by("o_orderkey").limit(32).df()


@key("full_read", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(s, d):
    return scan(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


FLAGSHIP = "SELECT c.c_custkey, c.c_name, ROUND(SUM(l.l_extendedprice*(1-l.l_discount)),2) AS revenue, COUNT(*) AS n FROM {lineitem} l JOIN {orders} o ON l.l_orderkey=o.o_orderkey JOIN {customer} c ON o.o_custkey=c.c_custkey GROUP BY c.c_custkey, c.c_name HAVING COUNT(*)>10 ORDER BY revenue DESC, c.c_custkey LIMIT 10"


@key("flagship", FLAGSHIP.format(lineitem="lineitem", orders="orders", customer="customer"))
def flagship(s, d):
    """Lines are summed by order below the joins, so only a row for each order is shuffled on."""
    lines = scan(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(c("l_extendedprice") * (1 - c("l_discount"))).alias("revenue"), F.count("*").alias("n"))
    orders = scan(s, d, "orders").select("o_orderkey", "o_custkey").join(lines, c("o_orderkey") == c("l_orderkey"))
    by = orders.groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"), F.sum("n").alias("n")).where("n > 10")
    out = by.join(scan(s, d, "customer").select("c_custkey", "c_name"), c("o_custkey") == c("c_custkey"))
    return out.select("c_custkey", "c_name", F.round("revenue", 2).alias("revenue"), "n").orderBy(F.desc("revenue"), "c_custkey").limit(10)
