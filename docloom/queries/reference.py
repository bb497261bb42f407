"""Statements of the dialect over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.engine import Engine
from docloom.session import bounded_broadcast

#: name -> (statement, the same in SQL or None)
STATEMENTS: dict[str, tuple[str, str | None]] = {}


def add(name: str, statement: str, sql: str | None = None) -> None:
    STATEMENTS[name] = (statement, sql)


def engine(spark: SparkSession, sf: str) -> Engine:
    """The tables of a folder, and two with nested fields: orders with their lines, customers with an address."""
    e = Engine(spark, folder=sf)
    t = e.catalog.table

    def orders() -> DataFrame:
        line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
        lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
        return t("orders").join(lines, "o_orderkey", "left")

    def customers() -> DataFrame:
        place = t("nation").join(bounded_broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        place = place.select("n_nationkey", F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).alias("address"))
        return t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_acctbal", "address")

    e.register("orders_nested", orders)
    e.register("customer_nested", customers)
    return e


def run(statement: str, spark: SparkSession, sf: str, **options) -> DataFrame:
    return engine(spark, sf).sql(statement, **options)


# Filters and predicates
add("filter_cmp", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000")
add("filter_or", "SELECT p_partkey FROM part WHERE p_size < 5 OR p_size >= 45", "SELECT p_partkey FROM part WHERE p_size < 5 OR p_size >= 45")
add("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
add("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
add("filter_not_in", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'de')", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'de') OR lang IS NULL")
add("filter_not_equal", "SELECT doc_id FROM documents WHERE source != 'crawl_wide'", "SELECT doc_id FROM documents WHERE source <> 'crawl_wide' OR source IS NULL")
add("filter_like_ci", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%RING%' AND p_type ILIKE '%nomy'", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' AND lower(p_type) LIKE '%nomy'")
add("filter_like_prefix", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'build%'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) LIKE 'build%'")
add("filter_not_like", "SELECT doc_id, lang FROM documents WHERE lang NOT LIKE 'e%'", "SELECT doc_id, lang FROM documents WHERE NOT coalesce(lower(lang) LIKE 'e%', false)")
add("filter_is_null", "SELECT doc_id FROM documents WHERE lang IS NULL", "SELECT doc_id FROM documents WHERE lang IS NULL")
add("filter_is_not_null", "SELECT doc_id FROM documents WHERE NOT lang IS NULL AND text != null", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
add("filter_nor", "SELECT doc_id FROM documents WHERE NOT (lang = 'en' OR lang = 'fr')", "SELECT doc_id FROM documents WHERE NOT coalesce(lang = 'en' OR lang = 'fr', false)")
add("filter_is_true", "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'BU') IS TRUE", "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'BU')")
add("filter_function", "SELECT p_partkey, MOD(p_partkey, 3) AS m FROM part WHERE STRLEN(p_name) > 10", "SELECT p_partkey, p_partkey % 3 AS m FROM part WHERE strlen(p_name) > 10")
add("filter_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < l_linenumber")
add("filter_timestamp", "SELECT o_orderkey FROM orders WHERE o_orderdate > timestamp '1998-01-01 00:00:00'", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
add("filter_date_text", "SELECT o_orderkey FROM orders WHERE '1996-01-01' >= o_orderdate", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'")
add("filter_field_exists", "SELECT doc_id FROM documents WHERE FIELD_EXISTS('lang', true) AND FIELD_EXISTS('nothing', false)", "SELECT doc_id FROM documents WHERE lang IS NOT NULL")
add("filter_nested_path", "SELECT c_custkey, `address.nation` AS nation FROM customer_nested WHERE `address.region` = 'ASIA'", "SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
# Projection
add("project_columns", "SELECT n_nationkey, nation.n_name AS name FROM nation", "SELECT n_nationkey, n_name AS name FROM nation")
add("project_star", "SELECT * FROM region", "SELECT * FROM region")
add("project_star_extra", "SELECT *, UPPER(n_name) AS big, n_regionkey + 1 AS next FROM nation", "SELECT *, upper(n_name) AS big, n_regionkey + 1 AS next FROM nation")
add("project_literals", "SELECT n_nationkey, 1 AS one, 'text' AS word, true AS yes FROM nation", "SELECT n_nationkey, 1 AS one, 'text' AS word, true AS yes FROM nation")
add("project_quoted", 'SELECT "n_name" AS name, "nation.n_regionkey" AS region FROM nation', "SELECT n_name AS name, n_regionkey AS region FROM nation")
add("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS class FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS class FROM orders")
add("cast_types", "SELECT p_partkey, CAST(p_size AS varchar) AS s, CAST(p_retailprice AS int) AS i, CAST(p_size AS double) AS d, CAST(p_partkey AS long) AS l, CAST(p_size AS bool) AS b FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(trunc(p_retailprice) AS INTEGER) AS i, CAST(p_size AS DOUBLE) AS d, CAST(p_partkey AS BIGINT) AS l, p_size <> 0 AS b FROM part")
add("convert_functions", "SELECT p_partkey, TO_STRING(p_size) AS s, TO_DOUBLE(p_size) AS d, TO_INT(p_retailprice) AS i, TO_LONG(p_size) AS l, TO_BOOL(p_name) AS b, CONVERT(p_size, 'double') AS c, ROUND(TO_DOUBLE(TO_DECIMAL(p_retailprice)), 2) AS e FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(p_size AS DOUBLE) AS d, CAST(trunc(p_retailprice) AS INTEGER) AS i, CAST(p_size AS BIGINT) AS l, true AS b, CAST(p_size AS DOUBLE) AS c, round_even(p_retailprice, 2) AS e FROM part")
add("cast_object_text", "SELECT c_custkey, CAST(address AS varchar) AS a FROM customer_nested", """SELECT c_custkey, '{"nation":"' || n_name || '","region":"' || r_name || '"}' AS a FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
add("typeof_names", "SELECT n_nationkey, TYPEOF(n_name) AS a, TYPEOF(n_nationkey) AS b, TYPEOF(null) AS c FROM nation", "SELECT n_nationkey, 'string' AS a, 'int' AS b, 'null' AS c FROM nation")
add("object_id", "SELECT row_no, TO_OBJECTID(id) AS oid FROM (SELECT load_no AS row_no, _id AS id FROM ams360_powerbi_customer) t", "SELECT load_no AS row_no, lower(_id) AS oid FROM ams360_powerbi_customer")
add("coalesce_iif", "SELECT doc_id, IFNULL(lang, 'none') AS l, COALESCE(null, source, 'x') AS s, IIF(n_chars > 500, 'long', 'short') AS k FROM documents", "SELECT doc_id, coalesce(lang, 'none') AS l, coalesce(source, 'x') AS s, CASE WHEN n_chars > 500 THEN 'long' ELSE 'short' END AS k FROM documents")
add("unary_minus", "SELECT o_orderkey, -o_orderkey AS neg FROM orders", "SELECT o_orderkey, -o_orderkey AS neg FROM orders")
# Mathematics
add("math_scalars", "SELECT p_partkey, ABS(-p_size) AS a, CEIL(p_retailprice) AS c, FLOOR(p_retailprice) AS f, ROUND(SQRT(p_size), 6) AS q, ROUND(LN(p_size), 6) AS n, ROUND(LOG10(p_size), 6) AS t, ROUND(LOG(p_size, 2), 6) AS g, POW(p_size, 2) AS w, MOD(p_size, 7) AS m, ROUND(EXP(p_size / 10), 4) AS e FROM part", "SELECT p_partkey, abs(-p_size) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round_even(sqrt(p_size), 6) AS q, round_even(ln(p_size), 6) AS n, round_even(log10(p_size), 6) AS t, round_even(ln(p_size) / ln(2), 6) AS g, pow(p_size, 2) AS w, p_size % 7 AS m, round_even(exp(p_size / 10), 4) AS e FROM part")
add("math_trig", "SELECT n_nationkey, ROUND(SIN(n_nationkey), 6) AS a, ROUND(COS_X, 6) AS b, ROUND(ATAN2(n_nationkey, 2), 6) AS c, ROUND(TANH(n_nationkey / 10), 6) AS d, ROUND(DEGREES_TO_RADIANS(n_nationkey), 6) AS e, ROUND(RADIANS_TO_DEGREES(n_nationkey), 4) AS f, ROUND(ASINH(n_nationkey), 6) AS g, ROUND(ATAN(n_nationkey), 6) AS h FROM (SELECT n_nationkey, TAN(n_nationkey) AS COS_X FROM nation) t".replace("SELECT n_nationkey, ROUND(SIN", "SELECT t.n_nationkey AS n_nationkey, ROUND(SIN"), "SELECT n_nationkey, round_even(sin(n_nationkey), 6) AS a, round_even(tan(n_nationkey), 6) AS b, round_even(atan2(n_nationkey, 2), 6) AS c, round_even(tanh(n_nationkey / 10), 6) AS d, round_even(radians(n_nationkey), 6) AS e, round_even(degrees(n_nationkey), 4) AS f, round_even(asinh(n_nationkey), 6) AS g, round_even(atan(n_nationkey), 6) AS h FROM nation")
add("math_round_bankers", "SELECT p_partkey, ROUND(p_size / 2) AS r, ROUND(p_size / 4, 1) AS s, TRUNC(p_size / 8, 1) AS t FROM part", "SELECT p_partkey, round_even(p_size / 2, 0) AS r, round_even(p_size / 4, 1) AS s, trunc(p_size * 10 / 8) / 10 AS t FROM part")
add("math_infix", "SELECT l_orderkey, l_linenumber, l_linenumber + 2 * 3 AS a, l_linenumber / 4 AS b, (l_linenumber - 5) % 3 AS c, DIVIDE(l_linenumber, 8) AS d, MULTIPLY(l_linenumber, 2, 3) AS e, SUBTRACT(10, l_linenumber) AS f FROM lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber + 6 AS a, l_linenumber / 4 AS b, (l_linenumber - 5) % 3 AS c, l_linenumber / 8 AS d, l_linenumber * 6 AS e, 10 - l_linenumber AS f FROM lineitem")
add("row_functions", "SELECT l_orderkey, l_linenumber, SUM(l_linenumber, l_orderkey) AS s, AVG(l_linenumber, 4, null) AS a, MIN(l_linenumber, 3) AS mi, MAX(l_linenumber, 3) AS ma FROM lineitem", "SELECT l_orderkey, l_linenumber, l_linenumber + l_orderkey AS s, (l_linenumber + 4) / 2 AS a, least(l_linenumber, 3) AS mi, greatest(l_linenumber, 3) AS ma FROM lineitem")
add("compare_functions", "SELECT p_partkey, CMP(p_size, 25) AS c, EQ(p_size, 25) AS e, NE(p_size, 25) AS n, GT(p_size, 25) AS g, GTE(p_size, 25) AS h, LT(p_size, 25) AS l, LTE(p_size, 25) AS m, (p_size = 3) AS i FROM part", "SELECT p_partkey, CAST(sign(p_size - 25) AS INTEGER) AS c, p_size = 25 AS e, p_size <> 25 AS n, p_size > 25 AS g, p_size >= 25 AS h, p_size < 25 AS l, p_size <= 25 AS m, p_size = 3 AS i FROM part")
# Strings
add("string_scalars", "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_name) AS l, CONCAT(c_mktsegment, '-', c_name) AS c, SUBSTR(c_name, 0, 4) AS s, LEFT(c_name, 3) AS f, REPLACE(c_name, '0', 'x') AS r, REPLACE_ALL(c_name, '0', 'x') AS ra, STRLEN(c_name) AS n, STRLEN_CP(c_name) AS m, SUBSTR_CP(c_name, 2, 3) AS scp, SUBSTR_BYTES(c_name, 1, 2) AS sb, BINARY_SIZE(c_name) AS bs FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, c_mktsegment || '-' || c_name AS c, substr(c_name, 1, 4) AS s, left(c_name, 3) AS f, regexp_replace(c_name, '0', 'x') AS r, replace(c_name, '0', 'x') AS ra, CAST(strlen(c_name) AS INTEGER) AS n, CAST(length(c_name) AS INTEGER) AS m, substr(c_name, 3, 3) AS scp, substr(c_name, 2, 2) AS sb, CAST(strlen(c_name) AS INTEGER) AS bs FROM customer")
add("string_pos", "SELECT c_custkey, STRPOS(c_name, '0') AS a, LOCATE('r', c_name) AS b, STARTS_WITH(c_mktsegment, 'AUTO') AS c FROM customer", "SELECT c_custkey, CAST(instr(c_name, '0') AS INTEGER) AS a, CAST(instr(c_name, 'r') AS INTEGER) AS b, starts_with(c_mktsegment, 'AUTO') AS c FROM customer")
add("string_trim", "SELECT parent, TRIM(parent) AS t, LTRIM(parent) AS l, RTRIM(parent) AS r, TRIM(parent, ' o') AS c FROM (SELECT ParentId AS parent FROM flat_offer_history) t".replace("SELECT parent, TRIM", "SELECT t.parent AS parent, TRIM"), "SELECT ParentId AS parent, trim(ParentId) AS t, ltrim(ParentId) AS l, rtrim(ParentId) AS r, trim(ParentId, ' o') AS c FROM flat_offer_history")
add("string_split_join", "SELECT c_custkey, JOIN(SPLIT(c_name, '#'), '/') AS j, SIZE_OF_ARRAY(SPLIT(c_name, '0')) AS n FROM customer", "SELECT c_custkey, replace(c_name, '#', '/') AS j, CAST(len(string_split(c_name, '0')) AS INTEGER) AS n FROM customer")
add("wrap_param", "SELECT c_custkey FROM customer WHERE c_mktsegment = wrapParam('BUILDING')", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
# Dates
add("extract_parts", "SELECT o_orderkey, EXTRACT(year FROM o_orderdate) AS y, EXTRACT(month FROM o_orderdate) AS m, EXTRACT(day FROM o_orderdate) AS d, EXTRACT(hour FROM o_orderdate) AS h, EXTRACT(dow FROM o_orderdate) AS w FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS w FROM orders")
add("date_parts", "SELECT event_id, YEAR(ts) AS y, MONTH(ts) AS mo, DAY_OF_MONTH(ts) AS d, DAY_OF_WEEK(ts) AS w, DAY_OF_YEAR(ts) AS j, ISO_DAY_OF_WEEK(ts) AS iw, ISO_WEEK(ts) AS k, ISO_WEEK_YEAR(ts) AS ky, HOUR(ts) AS h, MINUTE(ts) AS mi, SECOND(ts) AS s, MILLISECOND(ts) AS ms, WEEK(ts) AS wk FROM events", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(dayofweek(ts) + 1 AS INTEGER) AS w, CAST(dayofyear(ts) AS INTEGER) AS j, CAST(isodow(ts) AS INTEGER) AS iw, CAST(week(ts) AS INTEGER) AS k, CAST(isoyear(ts) AS INTEGER) AS ky, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(millisecond(ts) % 1000 AS INTEGER) AS ms, CAST(strftime(ts, '%U') AS INTEGER) AS wk FROM events")
add("date_trunc_units", "SELECT event_id, DATE_TO_STRING(DATE_TRUNC(ts, 'month')) AS m, DATE_TO_STRING(DATE_TRUNC(ts, 'week'), '%Y-%m-%d') AS w, DATE_TO_STRING(DATE_TRUNC(ts, 'hour'), '%H:%M:%S') AS h, DATE_TO_STRING(DATE_TRUNC(ts, 'quarter'), '%Y-%j') AS q FROM events", "SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS m, strftime(ts - INTERVAL 1 DAY * dayofweek(ts), '%Y-%m-%d') AS w, strftime(date_trunc('hour', ts), '%H:%M:%S') AS h, strftime(date_trunc('quarter', ts), '%Y-%j') AS q FROM events")
add("date_add_sub", "SELECT o_orderkey, DATE_TO_STRING(DATE_ADD(o_orderdate, 'month', 1), '%Y-%m-%d') AS a, DATE_TO_STRING(DATE_SUBTRACT(o_orderdate, 'day', 40), '%Y-%m-%d') AS s, DATE_TO_STRING(DATEADD(o_orderdate, 'hour', 30), '%d %H') AS h FROM orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS a, strftime(o_orderdate - INTERVAL 40 DAY, '%Y-%m-%d') AS s, strftime(o_orderdate + INTERVAL 30 HOUR, '%d %H') AS h FROM orders")
add("date_diff_boundary", "SELECT event_id, DATE_DIFF(TO_DATE('2024-01-15T12:30:00Z'), ts, 'day') AS d, DATE_DIFF(TO_DATE('2024-01-15T12:30:00Z'), ts, 'month') AS m, DATE_DIFF(TO_DATE('2024-01-15T12:30:00Z'), ts, 'hour') AS h, DATE_DIFF(TO_DATE('2024-01-15T12:30:00Z'), ts, 'year') AS y FROM events", "SELECT event_id, date_diff('day', TIMESTAMP '2024-01-15 12:30:00', ts) AS d, date_diff('month', TIMESTAMP '2024-01-15 12:30:00', ts) AS m, date_diff('hour', TIMESTAMP '2024-01-15 12:30:00', ts) AS h, date_diff('year', TIMESTAMP '2024-01-15 12:30:00', ts) AS y FROM events")
add("date_from_parts", "SELECT n_nationkey, DATE_TO_STRING(DATE_FROM_PARTS(2020, n_nationkey, 31, 25)) AS p, DATE_TO_STRING(DATE_FROM_ISO_PARTS(2021, n_nationkey + 1, 3), '%Y-%m-%d') AS i FROM nation", "SELECT n_nationkey, strftime(TIMESTAMP '2020-01-01' + INTERVAL 1 MONTH * (n_nationkey - 1) + INTERVAL 30 DAY + INTERVAL 25 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') AS p, strftime(TIMESTAMP '2021-01-04' + INTERVAL 1 DAY * (n_nationkey * 7 + 2), '%Y-%m-%d') AS i FROM nation")
add("date_from_string", "SELECT o_orderkey, DATE_DIFF(DATE_FROM_STRING(CONCAT(DATE_TO_STRING(o_orderdate, '%d/%m/%Y'), ' 05'), '%d/%m/%Y %H'), o_orderdate, 'hour') AS h FROM orders", "SELECT o_orderkey, date_diff('hour', date_trunc('day', o_orderdate) + INTERVAL 5 HOUR, o_orderdate) AS h FROM orders")
add("date_to_parts", "SELECT o_orderkey, p.year AS y, p.day AS d FROM (SELECT o_orderkey, DATE_TO_PARTS(o_orderdate) AS p FROM orders) t", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders")
add("date_arithmetic", "SELECT o_orderkey, (o_orderdate - TO_DATE('1992-01-01T00:00:00Z')) AS ms, DATE_TO_STRING(o_orderdate + 3600000) AS later FROM orders", "SELECT o_orderkey, date_diff('millisecond', TIMESTAMP '1992-01-01', o_orderdate) AS ms, strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.000Z') AS later FROM orders")
# Groups
add("agg_group", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(AVG(l_extendedprice), 2) AS avg_price, MIN(l_discount) AS lo, MAX(l_tax) AS hi, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TO_DATE('1998-09-02') GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round_even(avg(l_extendedprice), 2) AS avg_price, min(l_discount) AS lo, max(l_tax) AS hi, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
add("agg_global", "SELECT COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem", "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem")
add("agg_count_only", "SELECT COUNT(*) AS n FROM orders", "SELECT count(*) AS n FROM orders")
add("agg_forced_group", "SELECT o_orderstatus, COUNT(*) AS n FROM orders", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
add("agg_group_only", "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment", "SELECT DISTINCT c_mktsegment FROM customer")
add("agg_count_nulls", "SELECT source, COUNT(lang) AS n FROM documents GROUP BY source", "SELECT source, count(*) AS n FROM documents GROUP BY source")
add("agg_count_distinct", "SELECT source, COUNT(DISTINCT lang) AS n FROM documents GROUP BY source", "SELECT source, count(DISTINCT lang) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) AS n FROM documents GROUP BY source")
add("agg_arith", "SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(*), 2) AS mean, MAX(o_orderkey) - MIN(o_orderkey) AS span FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round_even(sum(o_totalprice) / count(*), 2) AS mean, max(o_orderkey) - min(o_orderkey) AS span FROM orders GROUP BY 1")
add("agg_round_sum", "SELECT o_orderstatus, SUM(ROUND(o_totalprice, 0)) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, sum(round_even(o_totalprice, 0)) AS s FROM orders GROUP BY 1")
add("agg_conditional", "SELECT SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders", "SELECT CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders")
add("agg_sum_empty", "SELECT SUM(o_totalprice) AS s, COUNT(*) AS n FROM orders WHERE o_orderkey < 0", "SELECT coalesce(sum(o_totalprice), 0) AS s, count(*) AS n FROM orders WHERE o_orderkey < 0")
add("agg_key_expression", "SELECT YEAR(o_orderdate) AS y, CASE WHEN o_totalprice > 100000 THEN 'a' ELSE 'b' END AS k, COUNT(*) AS n FROM orders GROUP BY y, k", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN o_totalprice > 100000 THEN 'a' ELSE 'b' END AS k, count(*) AS n FROM orders GROUP BY 1, 2")
add("having_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 15 ORDER BY n DESC, o_custkey", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
add("distinct_cols", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("distinct_star", "SELECT DISTINCT * FROM region", "SELECT DISTINCT * FROM region")
add("firstn_sorted", "SELECT o_orderstatus, JOIN(first, ',') AS first, JOIN(last, ',') AS last FROM (SELECT o_orderstatus, FIRSTN(3, 'o_orderkey') AS first, LASTN(2, 'o_orderkey') AS last FROM (SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderkey) s GROUP BY o_orderstatus) t".replace("SELECT o_orderstatus, JOIN", "SELECT t.o_orderstatus AS o_orderstatus, JOIN"), "SELECT o_orderstatus, array_to_string((list(o_orderkey ORDER BY o_orderkey))[1:3], ',') AS first, array_to_string((list(o_orderkey ORDER BY o_orderkey))[-2:], ',') AS last FROM orders GROUP BY 1")
# Joins
add("join_nest_inner", "SELECT o_orderkey, SIZE_OF_ARRAY(l) AS n, SUM_ARRAY(l, 'l_quantity') AS q FROM orders INNER JOIN lineitem l ON l.l_orderkey = o_orderkey", "SELECT o_orderkey, CAST(count(*) AS INTEGER) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
add("join_nest_left", "SELECT c_custkey, SIZE_OF_ARRAY(o) AS n FROM customer LEFT JOIN orders o ON o.o_custkey = c_custkey", "SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
add("join_nest_any", "SELECT o_orderkey FROM orders LEFT JOIN lineitem l ON l.l_orderkey = o_orderkey WHERE l.l_quantity = 50", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
add("join_unwind_inner", "SELECT o_orderkey, l.l_linenumber AS line, l.l_quantity AS q FROM orders INNER JOIN lineitem 'l|unwind' ON l.l_orderkey = o_orderkey WHERE l.l_quantity > 45", "SELECT o_orderkey, l_linenumber AS line, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45")
add("join_unwind_left", "SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer c LEFT JOIN orders `o|unwind` ON o.o_custkey = c.c_custkey", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
add("join_first", "SELECT o.o_orderkey AS k, c.c_name AS name FROM orders o INNER JOIN customer 'c|first' ON c.c_custkey = o.o_custkey", "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
add("join_last", "SELECT o.o_orderkey AS k, c.c_name AS name FROM orders o LEFT JOIN customer 'c|last' ON c.c_custkey = o.o_custkey", "SELECT o_orderkey AS k, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
add("join_theta", "SELECT a.n_nationkey AS k, SIZE_OF_ARRAY(b) AS n FROM nation a LEFT JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey < a.n_nationkey", "SELECT a.n_nationkey AS k, CAST(count(b.n_nationkey) AS INTEGER) AS n FROM nation a LEFT JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey < a.n_nationkey GROUP BY 1")
add("join_theta_inner", "SELECT s.s_suppkey AS s, n.n_name AS n FROM supplier s INNER JOIN nation 'n|unwind' ON n.n_nationkey = s.s_nationkey AND n.n_name LIKE '%1'", "SELECT s_suppkey AS s, n_name AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey AND n_name LIKE '%1'")
add("join_subquery", "SELECT c.c_custkey AS k, o.o_totalprice AS p FROM customer c INNER JOIN (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) 'o|unwind' ON o.o_custkey = c.c_custkey", "SELECT c_custkey AS k, o_totalprice AS p FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000")
add("join_three_way", "SELECT c.c_custkey AS k, n.n_name AS n, r.r_name AS r FROM customer c INNER JOIN nation 'n|unwind' ON n.n_nationkey = c.c_nationkey INNER JOIN region 'r|unwind' ON r.r_regionkey = n.n_regionkey", "SELECT c_custkey AS k, n_name AS n, r_name AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
add("join_full", "SELECT s.s_nationkey AS s, n.n_nationkey AS n FROM (SELECT s_nationkey FROM supplier WHERE s_nationkey < 15) s FULL OUTER JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey > 5) n ON n.n_nationkey = s.s_nationkey", "SELECT DISTINCT s_nationkey AS s, n_nationkey AS n FROM (SELECT * FROM supplier WHERE s_nationkey < 15) FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 5) ON n_nationkey = s_nationkey")
add("join_hints_ignored", "SELECT c.c_custkey AS k, n.n_name AS n FROM customer c INNER JOIN (SELECT * FROM nation WHERE n_nationkey > 3) 'n|unwind|optimize|nooptimize' ON n.n_nationkey = c.c_nationkey", "SELECT c_custkey AS k, n_name AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey > 3")
# Sub-queries
add("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
add("in_subquery_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
add("in_subquery_nested", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
add("not_in_subquery", "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'cs')", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'cs' AND e.source IS NOT DISTINCT FROM d.source)")
add("subquery_from", "SELECT t.k AS k, t.n AS n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) t WHERE t.n >= 10", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 10")
# Order and limits
add("order_multi", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey ASC LIMIT 50", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 50")
add("order_unprojected", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, orders.o_orderkey LIMIT 20", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("order_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
add("limit_pair", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
# Sets
add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("union_by_name", "SELECT n_name AS a FROM nation UNION ALL SELECT r_name AS b FROM region", "SELECT n_name AS a, NULL AS b FROM nation UNION ALL SELECT NULL, r_name FROM region")
add("intersect_rows", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey AS x FROM supplier ORDER BY k", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier")
add("except_rows", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
# Windows
add("window_rank", "SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r FROM orders", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS r FROM orders")
add("window_dense_rank", "SELECT o_orderkey, DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey DESC) AS r FROM orders", "SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey DESC) AS INTEGER) AS r FROM orders")
add("window_row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS r FROM orders")
add("window_global", "SELECT o_orderkey, RANK() OVER (ORDER BY o_custkey) AS r, DENSE_RANK() OVER (ORDER BY o_custkey) AS d, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS n FROM orders", "SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) AS r, dense_rank() OVER (ORDER BY o_custkey) AS d, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders")
add("window_offsets", "SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS q, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders", "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INTEGER) AS q, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders")
# Pivots
add("pivot_one", "SELECT 'mean' AS what, \"F\", \"O\", \"P\", \"Z\" FROM (SELECT o_orderstatus, o_totalprice FROM orders) 'p|pivot([max(o_totalprice) as m],o_orderstatus,[F,O,P,Z])'", "SELECT 'mean' AS what, max(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O, max(o_totalprice) FILTER (o_orderstatus = 'P') AS P, CAST(NULL AS DOUBLE) AS Z FROM orders")
add("pivot_multi", "SELECT F.n AS fn, F.m AS fm, O.n AS on_, O.m AS om FROM (SELECT o_orderstatus, o_totalprice FROM orders) 'p|pivot([count(*) as n,min(o_totalprice) as m],o_orderstatus,[F,O])'", "SELECT count(*) FILTER (o_orderstatus = 'F') AS fn, min(o_totalprice) FILTER (o_orderstatus = 'F') AS fm, count(*) FILTER (o_orderstatus = 'O') AS on_, min(o_totalprice) FILTER (o_orderstatus = 'O') AS om FROM orders")
add("unpivot_one", "SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM lineitem) 'u|unpivot(amount,measure,[l_quantity, l_extendedprice, l_tax])'", "SELECT l_orderkey, l_linenumber, measure, amount FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_tax INTO NAME measure VALUE amount)")
add("unpivot_multi", "SELECT l_orderkey, l_linenumber, a, x, b, y FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_extendedprice, l_tax FROM lineitem) 'u|unpivot(x,a,[l_quantity, l_extendedprice])|unpivot(y,b,[l_discount, l_tax])'", "SELECT l_orderkey, l_linenumber, 'l_quantity' AS a, l_quantity AS x, 'l_discount' AS b, l_discount AS y FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice, 'l_tax', l_tax FROM lineitem")
# Arrays
add("array_filter_map", "SELECT o_orderkey, JOIN((SELECT l_linenumber AS `$$ROOT` FROM lines WHERE l_quantity > 25), ',') AS big FROM orders_nested WHERE SIZE_OF_ARRAY(lines) > 0", "SELECT l_orderkey AS o_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) FILTER (l_quantity > 25), '') AS big FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
add("array_slice", "SELECT o_orderkey, SIZE_OF_ARRAY((SELECT * FROM lines LIMIT 2 OFFSET 1)) AS n FROM orders_nested WHERE lines IS NOT NULL", "SELECT o_orderkey, CAST(greatest(least(n - 1, 2), 0) AS INTEGER) AS n FROM (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
add("array_sort", "SELECT o_orderkey, JOIN((SELECT l_quantity AS `$$ROOT` FROM lines ORDER BY l_quantity DESC LIMIT 2), ',') AS top FROM orders_nested WHERE lines IS NOT NULL", "SELECT o_orderkey, array_to_string((list(l_quantity ORDER BY l_quantity DESC))[1:2], ',') AS top FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
add("array_any_path", "SELECT o_orderkey FROM orders_nested WHERE `lines.l_quantity` = 50", "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity = 50")
add("sum_array", "SELECT o_orderkey, SUM_ARRAY(lines, 'l_quantity') AS q, ROUND(AVG_ARRAY(lines, 'l_quantity'), 4) AS a FROM orders_nested WHERE lines IS NOT NULL", "SELECT o_orderkey, sum(l_quantity) AS q, round_even(avg(l_quantity), 4) AS a FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
add("array_access", "SELECT o_orderkey, f.l_linenumber AS f, l.l_linenumber AS l, e.l_linenumber AS e FROM (SELECT o_orderkey, FIRST_IN_ARRAY(lines) AS f, LAST_IN_ARRAY(lines) AS l, ARRAY_ELEM_AT(lines, 1) AS e FROM orders_nested WHERE lines IS NOT NULL) t", "SELECT o_orderkey, min(l_linenumber) AS f, max(l_linenumber) AS l, (list(l_linenumber ORDER BY l_linenumber))[2] AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
add("array_functions", "SELECT n_nationkey, JOIN(ARRAY_RANGE(0, n_nationkey, 3), ',') AS r, JOIN(REVERSE_ARRAY(SPLIT(n_name, 'A')), 'A') AS v, INDEXOF_ARRAY(ARRAY_RANGE(0, 30), n_nationkey) AS i, SIZE_OF_ARRAY(CONCAT_ARRAYS(ARRAY_RANGE(0, 3), ARRAY_RANGE(0, 4))) AS c, SIZE_OF_ARRAY(ZIP_ARRAY(ARRAY_RANGE(0, 3), ARRAY_RANGE(0, n_nationkey))) AS z, IS_ARRAY(SPLIT(n_name, 'A')) AS a FROM nation", "SELECT n_nationkey, coalesce(array_to_string(range(0, n_nationkey, 3), ','), '') AS r, array_to_string(list_reverse(string_split(n_name, 'A')), 'A') AS v, n_nationkey::BIGINT AS i, 7 AS c, CAST(least(3, n_nationkey) AS INTEGER) AS z, true AS a FROM nation")
add("set_ops_arrays", "SELECT n_nationkey, SIZE_OF_ARRAY(SET_UNION(ARRAY_RANGE(0, n_nationkey), ARRAY_RANGE(0, 5))) AS u, SIZE_OF_ARRAY(SET_DIFFERENCE(ARRAY_RANGE(0, n_nationkey), ARRAY_RANGE(0, 5))) AS d, SIZE_OF_ARRAY(SET_INTERSECTION(ARRAY_RANGE(0, n_nationkey), ARRAY_RANGE(0, 5))) AS i, SET_EQUALS(ARRAY_RANGE(0, n_nationkey), ARRAY_RANGE(0, 5)) AS e, SET_IS_SUBSET(ARRAY_RANGE(0, n_nationkey), ARRAY_RANGE(0, 5)) AS s FROM nation", "SELECT n_nationkey, CAST(greatest(n_nationkey, 5) AS INTEGER) AS u, CAST(greatest(n_nationkey - 5, 0) AS INTEGER) AS d, CAST(least(n_nationkey, 5) AS INTEGER) AS i, n_nationkey = 5 AS e, n_nationkey <= 5 AS s FROM nation")
add("array_truth", "SELECT n_nationkey, ALL_ELEMENTS_TRUE(ARRAY_RANGE(0, n_nationkey)) AS a, ANY_ELEMENT_TRUE(ARRAY_RANGE(0, n_nationkey)) AS o FROM nation", "SELECT n_nationkey, n_nationkey = 0 AS a, n_nationkey > 1 AS o FROM nation")
add("unwind_outer", "SELECT o_orderkey, line.l_linenumber AS n FROM (SELECT o_orderkey, UNWIND(lines) AS line FROM orders_nested) t", "SELECT o_orderkey, l_linenumber AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
# Objects
add("object_build", "SELECT c_custkey, o.name AS name, o.seg AS seg FROM (SELECT c_custkey, (SELECT c_name AS name, c_mktsegment AS seg) AS o FROM customer) t", "SELECT c_custkey, c_name AS name, c_mktsegment AS seg FROM customer")
add("merge_objects_root", "SELECT MERGE_OBJECTS((SELECT c_custkey, c_name), address, (SELECT 1 AS one)) AS `$$ROOT` FROM customer_nested", "SELECT c_custkey, c_name, n_name AS nation, r_name AS region, 1 AS one FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("flatten_struct", "SELECT FLATTEN(address, 'at_', true), UNSET(c_acctbal) FROM customer_nested", "SELECT c_custkey, c_name, n_name AS at_nation, r_name AS at_region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("unset_cols", "SELECT *, UNSET(o_totalprice, o_orderdate) FROM orders", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
add("object_arrays", "SELECT c_custkey, SIZE_OF_ARRAY(OBJECT_TO_ARRAY(address)) AS n, JOIN((SELECT v AS `$$ROOT` FROM pairs), '/') AS v FROM (SELECT c_custkey, address, OBJECT_TO_ARRAY(address) AS pairs FROM customer_nested) t", "SELECT c_custkey, 2 AS n, n_name || '/' || r_name AS v FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("array_to_object", "SELECT c_custkey, m.region AS region FROM (SELECT c_custkey, ARRAY_TO_OBJECT(OBJECT_TO_ARRAY(address)) AS m FROM customer_nested) t", "SELECT c_custkey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
add("parse_json_props", "SELECT event_id, TO_LONG(p.k) AS k FROM (SELECT event_id, PARSE_JSON(props) AS p FROM events) t", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
add("parse_json_literal", """SELECT n_nationkey, j.a AS a FROM (SELECT n_nationkey, PARSE_JSON('{"a": 5}') AS j FROM nation) t""", "SELECT n_nationkey, 5::BIGINT AS a FROM nation")

# Places, zones, delimiters and windows of any kind
add("trunc_exact", "SELECT p_partkey, TRUNC(p_retailprice, 1) AS a, TRUNC(-p_retailprice, 1) AS b, TRUNC(p_retailprice, -2) AS c, TRUNC(1.15, 2) AS d, TRUNC(p_retailprice) AS e FROM part", "SELECT p_partkey, CAST(sign(d) * floor(abs(d) * 10) / 10 AS DOUBLE) AS a, CAST(-sign(d) * floor(abs(d) * 10) / 10 AS DOUBLE) AS b, CAST(sign(d) * floor(abs(d) / 100) * 100 AS DOUBLE) AS c, 1.15::DOUBLE AS d, CAST(trunc(d) AS DOUBLE) AS e FROM (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18, 6)) AS d FROM part)")
add("round_by_column", "SELECT p_partkey, ROUND(p_retailprice, n) AS r, TRUNC(p_retailprice, n) AS t FROM (SELECT p_partkey, p_retailprice, MOD(p_size, 3) AS n FROM part) s", "SELECT p_partkey, CASE n WHEN 0 THEN round_even(p_retailprice, 0) WHEN 1 THEN round_even(p_retailprice, 1) ELSE round_even(p_retailprice, 2) END AS r, CASE n WHEN 0 THEN trunc(d) WHEN 1 THEN trunc(d * 10) / 10 ELSE trunc(d * 100) / 100 END::DOUBLE AS t FROM (SELECT p_partkey, p_retailprice, CAST(p_retailprice AS DECIMAL(18, 6)) AS d, p_size % 3 AS n FROM part)")
add("split_by_column", "SELECT n_nationkey, JOIN(SPLIT(n_name, mark), '|') AS parts FROM (SELECT n_nationkey, n_name, SUBSTR(n_name, 1, 1) AS mark FROM nation) t", "SELECT n_nationkey, replace(n_name, substr(n_name, 2, 1), '|') AS parts FROM nation")
add("date_add_zone", "SELECT o_orderkey, DATE_TO_STRING(DATE_ADD(TO_DATE('2021-11-07T05:30:00Z'), 'hour', n, 'America/New_York')) AS h, DATE_TO_STRING(DATE_ADD(TO_DATE('2021-11-06T05:30:00Z'), 'day', n, 'America/New_York')) AS d, DATE_TO_STRING(DATE_SUBTRACT(TO_DATE('2021-11-07T07:30:00Z'), 'minute', 60, 'America/New_York')) AS m FROM (SELECT o_orderkey, MOD(o_orderkey, 5) AS n FROM orders) t", "SELECT o_orderkey, strftime(TIMESTAMP '2021-11-07 05:30:00' + INTERVAL 1 HOUR * (o_orderkey % 5), '%Y-%m-%dT%H:%M:%S.000Z') AS h, strftime(TIMESTAMP '2021-11-06 05:30:00' + INTERVAL 1 DAY * (o_orderkey % 5) + CASE WHEN o_orderkey % 5 >= 2 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S.000Z') AS d, '2021-11-07T06:30:00.000Z' AS m FROM orders")
add("window_offsets_global", "SELECT o_orderkey, LAG(o_orderkey) OVER (ORDER BY o_orderkey) AS a, LEAD(o_custkey, 3) OVER (ORDER BY o_orderkey) AS b, NTILE(7) OVER (ORDER BY o_orderkey) AS t FROM orders", "SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS a, lead(o_custkey, 3) OVER (ORDER BY o_orderkey) AS b, CAST(ntile(7) OVER (ORDER BY o_orderkey) AS INTEGER) AS t FROM orders")
LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_partkey, l_linenumber)"
for pick, at in (("first", "1"), ("last", "-1")):
    add(f"join_{pick}_many", f"SELECT o.o_orderkey AS k, l.l_linenumber AS n, l.l_partkey AS p FROM orders o INNER JOIN {LINES} 'l|{pick}' ON l.l_orderkey = o.o_orderkey", f"SELECT o_orderkey AS k, (list(l_linenumber ORDER BY l_quantity DESC, l_partkey, l_linenumber))[{at}] AS n, (list(l_partkey ORDER BY l_quantity DESC, l_partkey, l_linenumber))[{at}] AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
    add(f"join_{pick}_theta", f"SELECT a.n_nationkey AS k, b.n_nationkey AS n FROM nation a LEFT JOIN (SELECT * FROM nation ORDER BY n_name DESC) 'b|{pick}' ON b.n_regionkey = a.n_regionkey AND b.n_nationkey < a.n_nationkey", f"SELECT a.n_nationkey AS k, (list(b.n_nationkey ORDER BY b.n_name DESC) FILTER (b.n_nationkey IS NOT NULL))[{at}] AS n FROM nation a LEFT JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey < a.n_nationkey GROUP BY 1")
add("join_nest_order", f"SELECT o_orderkey, JOIN((SELECT l_partkey AS `$$ROOT` FROM l), ',') AS parts FROM orders INNER JOIN {LINES} 'l' ON l.l_orderkey = o_orderkey", "SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_quantity DESC, l_partkey, l_linenumber) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
add("join_totals", "SELECT c_custkey, SIZE_OF_ARRAY(o) AS n, SUM_ARRAY(o, 'o_orderkey') AS s, ROUND(AVG_ARRAY(o, 'o_orderkey'), 3) AS a FROM customer LEFT JOIN orders o ON o.o_custkey = c_custkey WHERE SIZE_OF_ARRAY(o) < 12", "SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n, CAST(coalesce(sum(o_orderkey), 0) AS DOUBLE) AS s, round_even(avg(o_orderkey), 3) AS a FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) < 12")
# Names that other queries leave out
add("math_inverse", "SELECT n_nationkey, ROUND(ACOS(n_nationkey / 25), 6) AS a, ROUND(ACOSH(n_nationkey + 1), 6) AS b, ROUND(ASIN(n_nationkey / 25), 6) AS c, ROUND(ATANH(n_nationkey / 26), 6) AS d, ROUND(SINH(n_nationkey / 10), 6) AS e, ROUND(COSH_LIKE, 6) AS f FROM (SELECT n_nationkey, EXP(n_nationkey / 10) AS COSH_LIKE FROM nation) t".replace("SELECT n_nationkey, ROUND(ACOS", "SELECT t.n_nationkey AS n_nationkey, ROUND(ACOS"), "SELECT n_nationkey, round_even(acos(n_nationkey / 25), 6) AS a, round_even(acosh(n_nationkey + 1), 6) AS b, round_even(asin(n_nationkey / 25), 6) AS c, round_even(atanh(n_nationkey / 26), 6) AS d, round_even(sinh(n_nationkey / 10), 6) AS e, round_even(exp(n_nationkey / 10), 6) AS f FROM nation")
add("bool_functions", "SELECT n_nationkey, AND(n_nationkey > 3, n_regionkey = 1, true) AS a, OR(n_nationkey < 3, n_regionkey = 2) AS o, RAND() < 2 AS r FROM nation", "SELECT n_nationkey, n_nationkey > 3 AND n_regionkey = 1 AS a, n_nationkey < 3 OR n_regionkey = 2 AS o, true AS r FROM nation")
add("case_functions", "SELECT doc_id, TO_UPPER(lang) AS u, TO_LOWER(source) AS l FROM documents", "SELECT doc_id, coalesce(upper(lang), '') AS u, coalesce(lower(source), '') AS l FROM documents")
add("now_and_empty", "SELECT n_nationkey, CURRENT_DATE() > TO_DATE('2020-01-01') AS later, GETDATE() >= CURRENT_DATE() AS same, SIZE_OF_ARRAY(OBJECT_TO_ARRAY(EMPTY_OBJECT())) AS n FROM nation", "SELECT n_nationkey, true AS later, true AS same, 0 AS n FROM nation")
add("star_of_table", "SELECT t.n.n_nationkey AS k, t.n.n_name AS name, t.n.n_regionkey AS r FROM (SELECT n.* FROM nation n) t", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation")
add("unwind_several", "SELECT n_nationkey, UNWIND(ARRAY_RANGE(0, 2)) AS a, UNWIND(ARRAY_RANGE(0, n_regionkey)) AS b FROM nation", "SELECT n_nationkey, a::BIGINT AS a, b::BIGINT AS b FROM nation, (VALUES (0), (1)) x(a), LATERAL (SELECT unnest(CASE WHEN n_regionkey > 0 THEN range(0, n_regionkey) ELSE [NULL] END) AS b)")
add("extract_small_parts", "SELECT event_id, EXTRACT(minute FROM ts) AS m, EXTRACT(second FROM ts) AS s, EXTRACT(milliseconds FROM ts) AS ms, EXTRACT(week FROM ts) AS w FROM events", "SELECT event_id, CAST(minute(ts) AS INTEGER) AS m, CAST(floor(second(ts)) AS INTEGER) AS s, CAST(epoch_us(ts) // 1000 % 1000 AS INTEGER) AS ms, CAST(floor((dayofyear(ts) + 7 - (dayofweek(ts) + 1)) / 7) AS INTEGER) AS w FROM events")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(run, statement) for name, (statement, _) in STATEMENTS.items()}
SQL = {name: sql for name, (_, sql) in STATEMENTS.items() if sql}
