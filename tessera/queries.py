"""The registered queries: each a request over the star-schema tables, and the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.plans.nodes import agg, ask, case, element, key, keys, m
from tessera.query import Query, collection, nested, source
from tessera.sources.catalog import Policy
from tessera.sources.tpch import catalog
from tessera.streaming.live import Hub

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

orders, customer, lineitem, nation, supplier, part, events = (source(n) for n in "orders customer lineitem nation supplier part events".split())


def add(name: str, query: Query, sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.timeType.enabled", "true")
        return Engine(spark, catalog(sf_dir)).frame(query.request())

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def money(x):
    return x.call("MathRound", 2)


revenue = m("l_extendedprice") * (1.0 - m("l_discount"))

# Rows
add("filter_project", lineitem.where((m("l_returnflag") == "R") & (m("l_quantity") > 30)).select("l_orderkey", "l_linenumber", "l_quantity"), "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30")
add("nav_two_hops", orders.where(m("customer.nation.n_regionkey") == 2).select("o_orderkey", customer=m("customer.c_name"), nation=m("customer.nation.n_name")), "SELECT o_orderkey, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
add("flagship", orders.where(m("o_totalprice") > 100000.0).order_by(m("o_totalprice"), True).then_by(m("o_orderkey")).take(100).select("o_orderkey", "o_totalprice", customer=m("customer.c_name"), nation=m("customer.nation.n_name")), "SELECT o_orderkey, o_totalprice, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
add("top_k", orders.order_by(m("o_totalprice"), True).then_by(m("o_orderkey")).take(20).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("offset_page", orders.order_by(m("o_orderkey")).skip(100).take(50).select("o_orderkey", "o_orderpriority"), "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
add("take_then_filter", orders.order_by(m("o_totalprice"), True).then_by(m("o_orderkey")).take(200).where(m("o_orderstatus") == "F").select("o_orderkey"), "SELECT o_orderkey FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) WHERE o_orderstatus = 'F'")
add("reversed", orders.order_by(m("o_totalprice")).then_by(m("o_orderkey")).reverse().take(10).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
add("default_projection", nation, "SELECT n_nationkey, n_name, n_regionkey FROM nation")
add("computed_leaf", lineitem.select("l_orderkey", net=revenue, size=case(m("l_quantity") > 40, "large", case(m("l_quantity") > 20, "middle", "small")), pages=m("l_linenumber") / 2, rest=m("l_linenumber") % 3, minus=-m("l_linenumber")), "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net, CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 20 THEN 'middle' ELSE 'small' END AS size, l_linenumber // 2 AS pages, l_linenumber % 3 AS rest, -l_linenumber AS minus FROM lineitem")
add("in_set", customer.where(m("c_mktsegment").is_in("BUILDING", "MACHINERY")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
add("not_in_set", customer.where(~m("c_mktsegment").is_in("BUILDING", "MACHINERY")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
add("distinct_paged", part.select("p_brand", "p_type").distinct().order_by(m("p_brand")).then_by(m("p_type")).skip(2).take(10), "SELECT DISTINCT p_brand, p_type FROM part ORDER BY p_brand, p_type LIMIT 10 OFFSET 2")
add("nested_object", orders.where(m("o_totalprice") > 450000.0).select("o_orderkey", buyer=nested("customer", "c_name", "c_acctbal")), "SELECT o_orderkey, {'c_name': c_name, 'c_acctbal': c_acctbal} AS buyer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000")
add("flatten", customer.where(m("c_mktsegment") == "BUILDING").flatten("orders").where(m("o_totalprice") > 300000.0).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000")
add("oftype", events.of_type("purchase").where(m("value") > 100.0).select("event_id", "user_id"), "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 100")
add("collation", part.where(m("p_brand").collate("CaseInsensitive") == "brand#1").select("p_partkey", "p_brand"), "SELECT p_partkey, p_brand FROM part WHERE lower(p_brand) = 'brand#1'")

# Functions
p = m("p_name")
add("string_functions", part.select(
    "p_partkey", up=p.call("StringToUpper"), low=p.call("StringToLower"), n=p.call("StringLength"), has=p.call("StringContains", "1"), starts=p.call("StringStartsWith", "Part"), ends=p.call("StringEndsWith", "7"),
    empty=p.call("StringIsNullOrEmpty"), blank=p.call("StringIsNullOrWhiteSpace"), trimmed=(m("p_brand") + "  ").call("StringTrim"), front=("  " + m("p_brand")).call("StringTrimStart"), back=(m("p_brand") + "  ").call("StringTrimEnd"),
    cut=p.call("StringSubstring", 2), cut2=p.call("StringSubstring", 1, 3), at=p.call("StringIndexOf", "0"), swapped=p.call("StringReplace", "0", "o"), first=p.call("StringFirst"), last=p.call("StringLast"), both=p.call("StringConcat", "/", m("p_brand")), size=m("p_size").call("StringFrom"),
), "SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, CAST(length(p_name) AS INTEGER) AS n, contains(p_name, '1') AS has, starts_with(p_name, 'Part') AS starts, ends_with(p_name, '7') AS ends, p_name = '' AS empty, trim(p_name) = '' AS blank, trim(p_brand || '  ') AS trimmed, ltrim('  ' || p_brand) AS front, rtrim(p_brand || '  ') AS back, substr(p_name, 3) AS cut, substr(p_name, 2, 3) AS cut2, CAST(instr(p_name, '0') - 1 AS INTEGER) AS at, replace(p_name, '0', 'o') AS swapped, left(p_name, 1) AS first, right(p_name, 1) AS last, p_name || '/' || p_brand AS both, CAST(p_size AS VARCHAR) AS size FROM part")
b = m("s_acctbal")
add("math_functions", supplier.select(
    "s_suppkey", a=b.call("MathAbs"), up=b.call("MathCeiling"), down=b.call("MathFloor"), r=b.call("MathRound"), r1=b.call("MathRound", 1), cut=b.call("MathTruncate"), sign=b.call("MathSign"), root=b.call("MathAbs").call("MathSqrt").call("MathRound", 6), square=b.call("MathPow", 2.0).call("MathRound", 2),
    e=(b / 10000.0).call("MathExp").call("MathRound", 6), ln=(b.call("MathAbs") + 1.0).call("MathLog").call("MathRound", 6), lg=(b.call("MathAbs") + 1.0).call("MathLog10").call("MathRound", 6), l2=(b.call("MathAbs") + 1.0).call("MathLog", 2.0).call("MathRound", 6),
    sin=b.call("MathSin").call("MathRound", 6), cos=b.call("MathCos").call("MathRound", 6), tan=(b / 10000.0).call("MathTan").call("MathRound", 6), asin=(b / 20000.0).call("MathAsin").call("MathRound", 6), acos=(b / 20000.0).call("MathAcos").call("MathRound", 6), atan=b.call("MathAtan").call("MathRound", 6),
    atan2=b.call("MathAtan2", 3.0).call("MathRound", 6), hi=b.call("MathMax", 100.0), lo=b.call("MathMin", 100.0), rad=b.call("MathDegreesToRadians").call("MathRound", 6), deg=(b / 10000.0).call("MathRadiansToDegrees").call("MathRound", 6),
), "SELECT s_suppkey, abs(b) AS a, ceil(b) AS up, floor(b) AS down, round(b) AS r, round(b, 1) AS r1, trunc(b) AS cut, CAST(sign(b) AS INTEGER) AS sign, round(sqrt(abs(b)), 6) AS root, round(pow(b, 2), 2) AS square, round(exp(b / 10000), 6) AS e, round(ln(abs(b) + 1), 6) AS ln, round(log10(abs(b) + 1), 6) AS lg, round(log(2, abs(b) + 1), 6) AS l2, round(sin(b), 6) AS sin, round(cos(b), 6) AS cos, round(tan(b / 10000), 6) AS tan, round(asin(b / 20000), 6) AS asin, round(acos(b / 20000), 6) AS acos, round(atan(b), 6) AS atan, round(atan2(b, 3), 6) AS atan2, greatest(b, 100) AS hi, least(b, 100) AS lo, round(radians(b), 6) AS rad, round(degrees(b / 10000), 6) AS deg FROM (SELECT *, s_acctbal AS b FROM supplier)")
ts = m("ts")
add("date_parts", events.select(
    "event_id", y=ts.call("DateYear"), mo=ts.call("DateMonth"), d=ts.call("DateDay"), h=ts.call("DateHour"), mi=ts.call("DateMinute"), s=ts.call("DateSecond"), ms=ts.call("DateMillisecond"), us=ts.call("DateMicrosecond"), ns=ts.call("DateNanosecond"), doy=ts.call("DateDayOfYear"),
    n=ts.call("DateDayNumber"), dow=ts.call("DateDayOfWeek"), day=ts.call("DateDate"), only=ts.call("DateOnlyFromDateTime"), unix=ts.call("UnixSecondsFromOffset"), unix_ms=ts.call("UnixMillisecondsFromOffset"),
    hours=ts.call("DateTimeOfDay").call("TimeSpanHours"), minutes=ts.call("DateTimeOfDay").call("TimeSpanMinutes"), seconds=ts.call("DateTimeOfDay").call("TimeSpanSeconds"), millis=ts.call("DateTimeOfDay").call("TimeSpanMilliseconds"), micros=ts.call("DateTimeOfDay").call("TimeSpanMicroseconds"), nanos=ts.call("DateTimeOfDay").call("TimeSpanNanoseconds"),
), "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(millisecond(ts) % 1000 AS INTEGER) AS ms, CAST(microsecond(ts) % 1000 AS INTEGER) AS us, 0 AS ns, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 719162 AS INTEGER) AS n, CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(ts AS DATE) AS only, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS unix, CAST(epoch_us(ts) // 1000 AS BIGINT) AS unix_ms, CAST(hour(ts) AS INTEGER) AS hours, CAST(minute(ts) AS INTEGER) AS minutes, CAST(second(ts) AS INTEGER) AS seconds, CAST(millisecond(ts) % 1000 AS INTEGER) AS millis, CAST(microsecond(ts) % 1000 AS INTEGER) AS micros, 0 AS nanos FROM events")
o = m("o_orderdate")
add("date_arithmetic", orders.select(
    "o_orderkey", y=o.call("DateAddYears", 1), mo=o.call("DateAddMonths", 1), d=o.call("DateAddDays", 1.5), h=o.call("DateAddHours", 5), mi=o.call("DateAddMinutes", 90), s=o.call("DateAddSeconds", 1.25), ms=o.call("DateAddMilliseconds", 7), only=o.call("DateOnlyFromDateTime").call("DateAddMonths", 2), again=o.call("DateOnlyFromDateTime").call("DateTimeFromDateAndTime", o.call("TimeOnlyFromDateTime")), span=o.call("DateOnlyFromDateTime").call("DateTimeFromDateAndTime", o.call("DateTimeOfDay").call("TimeOnlyFromTimeSpan")),
), "SELECT o_orderkey, o_orderdate + INTERVAL 1 YEAR AS y, o_orderdate + INTERVAL 1 MONTH AS mo, o_orderdate + INTERVAL 36 HOUR AS d, o_orderdate + INTERVAL 5 HOUR AS h, o_orderdate + INTERVAL 90 MINUTE AS mi, o_orderdate + INTERVAL 1250 MILLISECOND AS s, o_orderdate + INTERVAL 7 MILLISECOND AS ms, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS only, CAST(o_orderdate AS TIMESTAMP) AS again, CAST(o_orderdate AS TIMESTAMP) AS span FROM orders")
number = m("c_name").call("StringSubstring", 9)
add("casts", customer.select(
    "c_custkey", i=number.call("Int32From"), l=number.call("Int64From"), d=number.call("DoubleFrom"), f=number.call("DecimalFrom").call("DoubleFrom"), s=(m("c_nationkey")).call("Int64From"), b=m("c_nationkey").call("StringFrom").call("ByteFrom"), h=m("c_nationkey").call("StringFrom").call("Int16From"), g=m("c_nationkey").call("StringFrom").call("SingleFrom").call("DoubleFrom"), t=case(m("c_nationkey") > 5, "true", "false").call("BooleanFrom"), c=m("c_acctbal").call("CompareTo", 5000.0), flag=m("c_nationkey").call("EnumHasFlag", 3), bal=(m("c_acctbal") > 0.0).call("StringFrom"),
), "SELECT c_custkey, CAST(substr(c_name, 10) AS INTEGER) AS i, CAST(substr(c_name, 10) AS BIGINT) AS l, CAST(substr(c_name, 10) AS DOUBLE) AS d, CAST(substr(c_name, 10) AS DOUBLE) AS f, CAST(c_nationkey AS BIGINT) AS s, CAST(c_nationkey AS SMALLINT) AS b, CAST(c_nationkey AS SMALLINT) AS h, CAST(c_nationkey AS DOUBLE) AS g, c_nationkey > 5 AS t, CASE WHEN c_acctbal < 5000 THEN -1 WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS c, (c_nationkey & 3) = 3 AS flag, CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS bal FROM customer")

# Grouping
add("group_simple", lineitem.group_by(m("l_returnflag"), m("l_linestatus")).select("l_returnflag", "l_linestatus", n=agg("Count"), qty=money(agg("Sum", m("l_quantity"))), price=money(agg("Average", m("l_extendedprice"))), low=agg("Min", m("l_discount")), high=agg("Max", m("l_tax"))), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY 1, 2")
add("pricing_summary", lineitem.where(m("l_shipdate") <= __import__("datetime").datetime(1998, 9, 2)).group_by(m("l_returnflag"), m("l_linestatus")).select("l_returnflag", "l_linestatus", sum_qty=money(agg("Sum", m("l_quantity"))), sum_price=money(agg("Sum", m("l_extendedprice"))), sum_net=money(agg("Sum", revenue)), sum_charge=money(agg("Sum", revenue * (1.0 + m("l_tax")))), n=agg("Count")), "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
add("group_composite_computed", orders.group_by(o.call("DateYear"), m("o_orderpriority")).select("o_orderpriority", year=key(0), n=agg("Count"), total=money(agg("Sum", m("o_totalprice")))), "SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority, year(o_orderdate)")
add("group_having", orders.group_by(m("o_custkey")).where(agg("Sum", m("o_totalprice")) / agg("Count") > 250000.0).where(agg("Count") > 5).select("o_custkey", n=agg("Count"), mean=money(agg("Sum", m("o_totalprice")) / agg("Count"))), "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice) / count(*), 2) AS mean FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) / count(*) > 250000 AND count(*) > 5")
add("group_filtered_distinct", events.group_by(m("event_type")).select("event_type", big=agg("Count", where=m("value") > 100.0), users=agg("Count", m("user_id"), distinct=True), late=agg("Max", m("value"), where=m("ts").call("DateDay") > 15), ids=agg("Sum", m("user_id"), distinct=True)), "SELECT event_type, count(*) FILTER (WHERE value > 100) AS big, count(DISTINCT user_id) AS users, max(value) FILTER (WHERE day(ts) > 15) AS late, CAST(sum(DISTINCT user_id) AS BIGINT) AS ids FROM events GROUP BY 1")
add("group_text_join", nation.group_by(m("n_regionkey")).select("n_regionkey", names=agg("Join", m("n_name"), separator=", ")), "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
add("group_through_link", lineitem.group_by(m("supplier.nation.n_name")).select(nation=key(0), n=agg("Count"), net=money(agg("Sum", revenue))), "SELECT n_name AS nation, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
add("count_groups", lineitem.group_by(m("l_returnflag"), m("l_linestatus")).select("l_returnflag", "l_linestatus").count(), "SELECT CAST(count(*) AS INTEGER) AS value FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")

# Terminals
add("count_rows", orders.count(m("o_totalprice") > 200000.0), "SELECT CAST(count(*) AS INTEGER) AS value FROM orders WHERE o_totalprice > 200000")
add("long_count", lineitem.count(long=True), "SELECT count(*) AS value FROM lineitem")
add("any_row", orders.any(m("o_totalprice") > 400000.0), "SELECT count(*) > 0 AS value FROM orders WHERE o_totalprice > 400000")
add("all_rows", orders.all(m("o_totalprice") > 0.0), "SELECT bool_and(o_totalprice > 0) AS value FROM orders")
for fn, sql in {"Sum": "round(sum(c_acctbal), 2)", "Average": "round(avg(c_acctbal), 2)", "Min": "min(c_acctbal)", "Max": "max(c_acctbal)"}.items():
    add(f"whole_{fn.lower()}", customer.aggregate(fn, m("c_acctbal")), f"SELECT {sql} AS value FROM customer")
    if fn in ("Sum", "Average"):
        QUERIES[f"whole_{fn.lower()}"] = (lambda run: lambda s, d: run(s, d).select(F.round("value", 2).alias("value")))(QUERIES[f"whole_{fn.lower()}"])
add("first_row", orders.order_by(m("o_totalprice"), True).then_by(m("o_orderkey")).first(m("o_orderstatus") == "O"), "SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
add("single_row", nation.single(m("n_nationkey") == 7), "SELECT * FROM nation WHERE n_nationkey = 7")
add("last_row", orders.where(m("o_custkey") == 7).order_by(m("o_orderdate")).then_by(m("o_orderkey")).last(or_default=True), "SELECT * FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
add("max_by", supplier.max_by(m("s_acctbal")), "SELECT * FROM supplier ORDER BY s_acctbal DESC LIMIT 1")
add("element_at", part.order_by(m("p_partkey")).element_at(17), "SELECT * FROM part ORDER BY p_partkey LIMIT 1 OFFSET 17")

# Joins and membership
add("join_inner", orders.where(m("o_totalprice") > 300000.0).join(customer, m("o_custkey"), m("c_custkey"), key=("outer", "o_orderkey"), name=("inner", "c_name")), "SELECT o_orderkey AS key, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
add("join_left", customer.join(orders.where(m("o_totalprice") > 400000.0), m("c_custkey"), m("o_custkey"), "Left", name=("outer", "c_name"), key=("inner", "o_orderkey")), "SELECT c_name AS name, o_orderkey AS key FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey")
add("join_right", orders.join(customer, m("o_custkey"), m("c_custkey"), "Right", key=("outer", "o_orderkey"), name=("inner", "c_name")), "SELECT o_orderkey AS key, c_name AS name FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
add("join_composite", lineitem.join(source("lineitem").where(m("l_quantity") > 45.0), keys(m("l_partkey"), m("l_suppkey")), keys(m("l_partkey"), m("l_suppkey")), a=("outer", "l_orderkey"), b=("inner", "l_orderkey")), "SELECT x.l_orderkey AS a, y.l_orderkey AS b FROM lineitem x JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) y ON x.l_partkey = y.l_partkey AND x.l_suppkey = y.l_suppkey")
add("group_join", customer.join(orders, m("c_custkey"), m("o_custkey"), "Group", name=("outer", "c_name"), n=agg("Count"), total=agg("Sum", m("o_totalprice").call("MathRound")), top=agg("Max", m("o_totalprice"))), "SELECT c_name AS name, count(o_orderkey) AS n, coalesce(sum(round(o_totalprice)), 0) AS total, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
add("join_side_topn", customer.join(orders.order_by(m("o_totalprice"), True).then_by(m("o_orderkey")).take(50), m("c_custkey"), m("o_custkey"), name=("outer", "c_name"), key=("inner", "o_orderkey")), "SELECT c_name AS name, o_orderkey AS key FROM customer JOIN (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) ON c_custkey = o_custkey")
add("join_count", orders.join(customer.where(m("c_acctbal") > 0.0), m("o_custkey"), m("c_custkey"), key=("outer", "o_orderkey")).count(), "SELECT CAST(count(*) AS INTEGER) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
add("membership", customer.where(m("c_custkey").in_source("orders", m("o_custkey"), m("o_totalprice") > 400000.0)).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
add("anti_membership", part.where(~m("p_partkey").in_source("lineitem", m("l_partkey"), m("l_quantity") > 49.0)).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
add("membership_value", customer.select("c_custkey", big=m("c_custkey").in_source("orders", m("o_custkey"), m("o_totalprice") > 400000.0)), "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS big FROM customer")

# Sets
a_side, b_side = customer.where(m("c_acctbal") > 5000.0).select(k=m("c_nationkey")), supplier.where(m("s_acctbal") > 5000.0).select(k=m("s_nationkey"))
for name, made, word in (("union", a_side.union(b_side), "UNION"), ("concat", a_side.concat(b_side), "UNION ALL"), ("intersect", a_side.intersect(b_side), "INTERSECT"), ("except", a_side.except_(b_side), "EXCEPT")):
    add(f"set_{name}", made, f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 {word} SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000")

# Collections
big = m("l_quantity") > 40.0
add("collection_rows", orders.select("o_orderkey", any_big=ask("Any", "lineitems", where=big), all_big=ask("All", "lineitems", where=big), n=ask("Count", "lineitems", where=big), qty=ask("Sum", "lineitems", m("l_quantity").call("MathRound")), low=ask("Min", "lineitems", m("l_discount")), high=ask("Max", "lineitems", m("l_discount")), mean=ask("Average", "lineitems", m("l_extendedprice")).call("MathRound", 6)),
    "SELECT o_orderkey, coalesce(bool_or(l_quantity > 40), false) AS any_big, coalesce(bool_and(l_quantity > 40), true) AS all_big, count(*) FILTER (WHERE l_quantity > 40) AS n, coalesce(sum(round(l_quantity)), 0) AS qty, min(l_discount) AS low, max(l_discount) AS high, round(avg(l_extendedprice), 6) AS mean FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
add("collection_filter", orders.where(ask("Count", "lineitems") == 0).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
add("projected_collection", customer.where(m("c_mktsegment") == "BUILDING").select("c_custkey", keys=collection("orders", where=m("o_totalprice") > 200000.0, each=m("o_orderkey"))), "SELECT c_custkey, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_totalprice > 200000), []) AS keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey")
x = element()
add("array_questions", source("embeddings").select("vec_id", any_high=ask("Any", "embedding", where=x > 0.3), all_low=ask("All", "embedding", where=x < 0.5), n=ask("Count", "embedding", where=x > 0.0), total=ask("Sum", "embedding").call("MathRound", 4), high=ask("Max", "embedding"), low=ask("Min", "embedding"), mean=ask("Average", "embedding").call("MathRound", 6)),
    "SELECT vec_id, len(list_filter(embedding, lambda x: x > CAST(0.3 AS FLOAT))) > 0 AS any_high, len(list_filter(embedding, lambda x: x < 0.5)) = len(embedding) AS all_low, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, list_max(embedding) AS high, list_min(embedding) AS low, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean FROM embeddings")


# What needs a catalog or a cursor of its own


def _keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of orders by date, newest first: the first page's cursor gives the seek predicate."""
    engine = Engine(spark, catalog(sf_dir), secret=b"page")
    by_date = orders.order_by(m("o_orderdate"), True).select("o_orderkey", "o_orderdate")
    cursor = engine.execute(by_date.page(25).request())["cursor"]
    found = engine.frame(by_date.page(25, cursor).request())
    return found.limit(25).select("o_orderkey", "o_orderdate")


QUERIES["keyset_page"] = _keyset_page
ORACLES["keyset_page"] = "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25"


def _policied(spark: SparkSession, sf_dir: str) -> Engine:
    def own_segment(ctx: dict) -> Column:
        return F.col("c_mktsegment") != ctx["hidden_segment"]

    return Engine(spark, catalog(sf_dir).with_("customer", policies=(Policy("segment", own_segment),)))


def _policy_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policied(spark, sf_dir).frame(customer.select("c_custkey", "c_mktsegment").request(), {"hidden_segment": "BUILDING"})


def _policy_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policied(spark, sf_dir).frame(orders.select("o_orderkey", name=m("customer.c_name")).request(), {"hidden_segment": "BUILDING"})


QUERIES |= {"policy_root": _policy_root, "policy_link": _policy_link}
ORACLES["policy_root"] = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'"
ORACLES["policy_link"] = "SELECT o_orderkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_name END AS name FROM orders JOIN customer ON o_custkey = c_custkey"


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three independent answers of one batch, one of them refused."""
    engine = Engine(spark, catalog(sf_dir))
    asked = [orders.count().request(), orders.take(5).request(), customer.aggregate("Max", m("c_acctbal")).request()]
    out = [(i, str(x["ok"]["value"]) if "ok" in x else x["error"]) for i, x in enumerate(engine.batch(asked))]
    return spark.createDataFrame(out, "entry int, answer string")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a caller receives them, between the markers."""
    engine = Engine(spark, catalog(sf_dir))
    parts = list(engine.stream(nation.where(m("n_regionkey") == 1).select("n_nationkey", "n_name").request()))
    return spark.createDataFrame([tuple(p["row"].values()) for p in parts if "row" in p], "n_nationkey int, n_name string")


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer of a subscription."""
    live = Hub(Engine(spark, catalog(sf_dir))).subscribe(events.where(m("event_type") == "purchase").count(long=True).request())
    value = next(live)["result"]["value"]
    live.close()
    return spark.createDataFrame([(value,)], "value long")


QUERIES |= {"batch": _batch, "stream": _stream, "live": _live}
ORACLES["batch"] = "SELECT 0 AS entry, CAST(count(*) AS VARCHAR) AS answer FROM orders UNION ALL SELECT 1, 'Validation' UNION ALL SELECT 2, CAST(max(c_acctbal) AS VARCHAR) FROM customer"
ORACLES["stream"] = "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1"
ORACLES["live"] = "SELECT count(*) AS value FROM events WHERE event_type = 'purchase'"
