"""Parsing, errors, options, and small cases with known results."""

import datetime as dt
import json

import pytest

from docloom.engine import Engine
from docloom.errors import ColumnDoesNotExistError, StatementError, SyntaxProblem, TableDoesNotExistError
from docloom.plans.parser import hints, parse
from docloom.plans.syntax import Binary, Literal, Name


@pytest.fixture(scope="module")
def engine(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Engine(
        spark,
        {
            "orders": frame([(1, "ropes", 6.5, 2, 1, dt.datetime(2021, 3, 1)), (2, "sails", 11.0, 1, 1, None), (3, "ropes", 4.0, 3, 2, dt.datetime(2024, 1, 5)), (4, "ropes", 1.5, 1, None, dt.datetime(2020, 1, 1)), (5, "tar", 2.0, 9, 3, dt.datetime(2022, 1, 1))], "id int, item string, price double, quantity int, customerId int, orderDate timestamp"),
            "inventory": frame([(1, "ropes", 31), (2, "oars", 45), (3, "pumps", 52), (4, "sails", 18), (5, None, None)], "id int, sku string, instock int"),
            "customer-notes": frame([(1, "a", "x"), (1, "b", "y"), (3, "c", "z")], "id int, notes string, date string"),
            "pvt": frame([(v, v + 1, v + 2, None) for v in range(1, 4)], "VendorID int, Emp1 int, Emp2 int, Emp3 int"),
            "costs": frame([(0, 2.0), (0, 9.0), (1, 41.0), (4, 17.0)], "days int, cost double"),
            "left_films": frame([("A", 1957), ("B", 1994), ("C", 2008), ("C", 2008)], "name string, year int"),
            "right_films": frame([("C", 2008), ("D", 1972)], "title string, made int"),
            "people": frame([(1, ("Ueda", "JP"), [(1, 2.0, [(0.5,), (1.5,)]), (2, 1.0, None)]), (2, ("Tete", None), []), (3, None, None)], "id int, Address struct<City: string, Country: string>, Rentals array<struct<filmId: int, staffId: double, Payments: array<struct<Amount: double>>>>"),
            "dotted": frame([(1, 2)], "`a.b` int, c int"),
        },
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tree():
    q = parse("SELECT a.b AS x FROM t WHERE a = 'it''s' AND b <> -2;")
    assert q.items[0].expr == Name(("a", "b")) and q.where == Binary("AND", Binary("=", Name(("a",)), Literal("it's", "'")), Binary("!=", Name(("b",)), Literal(-2)))
    assert parse("select * from a limit 5, 10").offset == 5
    assert hints("p|pivot([sum(a|b)],c,[1])|unwind") == ("p", ["pivot([sum(a|b)],c,[1])", "unwind"])


@pytest.mark.parametrize("text", ["SELECT", "SELECT a FROM", "SELECT a b c FROM t", "SELECT (a FROM t", "SELECT a FROM t WHERE", "SELECT # FROM t", "SELECT CASE END AS x FROM t"])
def test_syntax_errors_name_the_place(text):
    with pytest.raises(SyntaxProblem, match=r"\[Start: Line \d+, Col: \d+\]"):
        parse(text)


@pytest.mark.parametrize(
    "text,message",
    [
        ("", "No statement"), ("SELECT 1 AS a FROM orders; SELECT 2 AS b FROM orders", "one statement"), ("SELECT 1 AS a", "FROM"), ("SELECT nothing(id) AS a FROM orders", "Function not found: nothing"),
        ("SELECT id + 1 FROM orders", "alias"), ("SELECT UPPER(item) FROM orders", "alias is needed for function upper"), ("SELECT COUNT(*) FROM orders", "alias"),
        ("SELECT a.id FROM orders a RIGHT JOIN inventory b ON a.id = b.id", "Join not supported"), ("SELECT id FROM orders, inventory", "Join not supported"), ("SELECT * FROM orders GROUP BY item", "grouped"),
        ("SELECT item, COUNT(*) AS n FROM orders GROUP BY item HAVING COUNT(*) > 1", "HAVING"), ("SELECT id FROM orders WHERE id = (SELECT id FROM inventory)", "Sub query operations not supported"),
        ("SELECT id FROM orders WHERE item IN (SELECT id, sku FROM inventory)", "one column"), ("SELECT ROW_NUMBER() OVER (PARTITION BY id) AS n FROM orders", "ORDER BY"), ("SELECT FIRST_VALUE(id) OVER (ORDER BY id) AS n FROM orders", "Unsupported window function"),
        ("SELECT id FROM (SELECT id FROM orders)", "alias"), ("SELECT SUBSTR(item, 1) AS s FROM orders", "takes 3 arguments"), ("SELECT id FROM left_films INTERSECT ALL SELECT id FROM orders", "not supported"), ("SELECT (SELECT COUNT(*) AS n FROM Rentals) AS x FROM people", "not supported"),
    ],
)
def test_messages(engine, text, message):
    with pytest.raises(StatementError, match=message):
        engine.sql(text)


def test_missing_tables_and_columns(engine):
    with pytest.raises(TableDoesNotExistError):
        engine.sql("SELECT a FROM nowhere")
    with pytest.raises(ColumnDoesNotExistError):
        engine.sql("SELECT nothing FROM orders")


def test_null_rules(engine):
    ids = lambda w, **o: sorted(r[0] for r in rows(engine.sql(f"SELECT id FROM orders WHERE {w}", **o)))
    assert ids("customerId != 1") == [3, 4, 5] and ids("customerId != 1", nulls="sql") == [3, 5]
    assert ids("customerId NOT IN (1, 2)") == [4, 5] and ids("NOT (customerId = 1)") == [3, 4, 5]
    assert ids("customerId IN (1, null)") == [1, 2, 4] and ids("customerId = null") == [4] and ids("customerId > 1") == [3, 5]
    assert ids("item NOT IN (SELECT sku FROM inventory)") == [5]
    assert ids('item = "sails"') == [2] and ids("item LIKE 'ROP%'") == [1, 3, 4] and ids("item LIKE '%_%'") == []


def test_joins(engine):
    nest = {r.id: r for r in engine.sql("SELECT id, n FROM orders LEFT JOIN `customer-notes` n ON n.id = customerId").collect()}
    assert sorted(x.notes for x in nest[1].n) == ["a", "b"] and nest[4].n == [] and nest[3].n == []
    inner = rows(engine.sql("SELECT o.id AS i, n.notes AS t FROM orders o INNER JOIN customer-notes 'n|unwind' ON n.id = o.customerId ORDER BY i, t"))
    assert inner == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (5, "c")]
    assert rows(engine.sql("SELECT o.id AS i, n.notes AS t FROM orders o INNER JOIN customer-notes n ON n.id = o.customerId ORDER BY i, t", unwind_joins=True)) == inner
    first = rows(engine.sql("SELECT id, sku_docs.instock AS s FROM orders INNER JOIN `inventory` AS `sku_docs|first` ON sku = item ORDER BY id"))
    assert first == [(1, 31), (2, 18), (3, 31), (4, 31)]
    star = engine.sql("SELECT * FROM orders INNER JOIN `inventory|first` ON sku = item")
    assert star.columns[-1] == "inventory"
    theta = {r[0]: r[1] for r in rows(engine.sql("SELECT o.id AS i, SIZE_OF_ARRAY(v) AS n FROM orders o LEFT JOIN inventory v ON v.instock < o.price * 10 OR v.sku = o.item"))}
    assert theta == {1: 4, 2: 4, 3: 2, 4: 1, 5: 1}
    full = rows(engine.sql("SELECT o.id AS a, v.id AS b FROM orders o FULL JOIN inventory v ON v.sku = o.item"))
    assert len(full) == 8 and (5, None) in full and (None, 5) in full
    moved = rows(engine.sql("SELECT id, UNWIND(n) AS note FROM orders LEFT JOIN customer-notes n ON n.id = customerId ORDER BY id"))
    assert len(moved) == 7 and dict(moved)[4] is None


def test_alias_nests_a_star(engine):
    assert engine.sql("SELECT * FROM orders o").columns == ["o"]
    assert engine.sql("SELECT o.*, 1 AS one FROM orders o").columns == ["o", "one"]
    assert engine.sql("SELECT * FROM orders o", nest_alias=False).columns[:2] == ["id", "item"]
    assert engine.sql("SELECT t AS `$$ROOT` FROM (SELECT id, item FROM orders) t").columns == ["id", "item"]


def test_sets(engine):
    assert sorted(rows(engine.sql("SELECT name, year FROM left_films INTERSECT SELECT title, made FROM right_films"))) == [("C", 2008)]
    assert sorted(rows(engine.sql("SELECT * FROM left_films EXCEPT SELECT * FROM right_films"))) == [("A", 1957), ("B", 1994)]
    assert len(rows(engine.sql("SELECT item AS product FROM orders UNION ALL SELECT sku AS product FROM inventory"))) == 10
    assert len(rows(engine.sql("SELECT item AS product FROM orders UNION SELECT sku AS product FROM inventory ORDER BY product LIMIT 4"))) == 4


def test_pivots(engine):
    one = engine.sql("SELECT 'mean' AS what, \"0\", \"1\", \"2\" FROM (SELECT days, cost FROM costs) 'p|pivot([avg(cost) as c],days,[0,1,2])'")
    assert rows(one) == [("mean", 5.5, 41.0, None)]
    two = engine.sql("SELECT `0`.n AS n, `4`.s AS s FROM (SELECT * FROM costs) 'p|pivot([count(*) as n, sum(cost) as s],days,[0,4])'")
    assert rows(two) == [(2, 17.0)]
    long = engine.sql("SELECT VendorID, Employee, Orders FROM (SELECT VendorID, Emp1, Emp2, Emp3, unset(_id) FROM pvt) 'u|unpivot(Orders,Employee,[Emp1, Emp2, Emp3])' ORDER BY VendorID, Employee")
    assert rows(long)[:3] == [(1, "Emp1", 2), (1, "Emp2", 3), (1, "Emp3", None)]
    for bad in ("'p|pivot([avg(cost)],days)'", "'p|pivot(avg(cost) as c,days,[0])'", "'p|pivot([upper(cost) as c],days,[0])'", "'u|unpivot(a,b)'"):
        with pytest.raises(StatementError):
            engine.sql(f"SELECT * FROM (SELECT * FROM costs) {bad}")


def test_arrays_and_objects(engine):
    got = rows(engine.sql("SELECT id, (SELECT filmId AS `$$ROOT` FROM Rentals WHERE staffId > 0 ORDER BY filmId DESC LIMIT 1) AS f, SUM_ARRAY(Rentals, 'Payments', 'Amount') AS s FROM people ORDER BY id"))
    assert got == [(1, [2], 2.0), (2, [], 0.0), (3, None, None)]
    inner = rows(engine.sql("SELECT id, (SELECT filmId, (SELECT Amount AS `$$ROOT` FROM Payments) AS paid FROM Rentals) AS r FROM people WHERE id = 1"))
    assert [tuple(x) for x in inner[0][1]] == [(1, [0.5, 1.5]), (2, None)]
    assert engine.sql("SELECT `Address.City` FROM people").schema.simpleString() == "struct<Address:struct<City:string>>"
    assert rows(engine.sql("SELECT `Address.City` AS c FROM people WHERE `Address.Country` IS NULL ORDER BY c DESC")) == [("Tete",), (None,)]
    assert rows(engine.sql("SELECT `a.b` AS x, dotted.c AS y FROM dotted")) == [(1, 2)]
    assert engine.sql("SELECT FLATTEN(Address, 'at_', true), UNSET(Rentals) FROM people").columns == ["id", "at_City", "at_Country"]
    assert engine.sql("SELECT *, UNSET(`Address.City`) FROM people").schema["Address"].dataType.names == ["Country"]
    text = rows(engine.sql("SELECT CAST(Address AS varchar) AS a FROM people WHERE id = 2"))[0][0]
    assert json.loads(text) == {"City": "Tete", "Country": None}
    merged = engine.sql("SELECT (SELECT id, 1 AS one) AS t1, MERGE_OBJECTS(t1, Address, PARSE_JSON('{\"val\": 1}')) AS `$$ROOT` FROM people")
    assert merged.columns == ["id", "one", "City", "Country", "val"]


def test_functions_on_nulls_and_ends(spark, engine):
    one = lambda e: rows(engine.sql(f"SELECT {e} AS v FROM orders LIMIT 1"))[0][0]
    cases = {
        "ROUND(2.5)": 2.0, "ROUND(3.5)": 4.0, "TRUNC(-2.567, 2)": -2.56, "TRUNC(1.15, 2)": 1.15, "TRUNC(4.35, 2)": 4.35, "TRUNC(1e300, 2)": 1e300, "TRUNC(1234.5, -2)": 1200.0, "TRUNC(null, 1)": None, "JOIN(SPLIT('a\\Eb\\Ec', '\\E'), '-')": "a-b-c",
        "DATE_TO_STRING(DATE_ADD(TO_DATE('2021-11-07T05:30:00Z'), 'hour', 1, 'America/New_York'))": "2021-11-07T06:30:00.000Z", "DATE_TO_STRING(DATE_ADD(TO_DATE('2021-11-06T05:30:00Z'), 'day', 2, 'America/New_York'))": "2021-11-08T06:30:00.000Z", "REPLACE('aba', 'a', 'x')": "xba", "REPLACE('abc', 'z', 'x')": "abc", "UPPER(null)": "", "JOIN(SPLIT('a.b.c', '.'), '-')": "a-b-c",
        "ARRAY_ELEM_AT(SPLIT('a,b', ','), -1)": "b", "ARRAY_ELEM_AT(SPLIT('a,b', ','), 5)": None, "INDEXOF_ARRAY(SPLIT('a,b', ','), 'z')": -1, "SIZE_OF_ARRAY(ARRAY_RANGE(5, 5))": 0, "SIZE_OF_ARRAY(ARRAY_RANGE(5, 0, -2))": 3,
        "LOG(8, 2)": pytest.approx(3.0), "SUBSTR('abcd', 1, 2)": "bc", "CMP(1, 2)": -1, "AVG(1, null, 3)": 2.0, "MAX(1, null, 3)": 3, "IFNULL(null, null, 3)": 3, "TYPEOF('x')": "string",
        "WEEK(TO_DATE('2022-01-01T00:00:00Z'))": 0, "WEEK(TO_DATE('2022-01-02T00:00:00Z'))": 1, "DATE_DIFF(TO_DATE('2022-01-01T23:00:00Z'), TO_DATE('2022-01-02T01:00:00Z'), 'day')": 1, "DATE_DIFF(TO_DATE('2022-01-01T23:50:00Z'), TO_DATE('2022-01-02T01:10:00Z'), 'hour')": 2,
        "DATE_TO_STRING(DATE_FROM_PARTS(2020, 14, 1))": "2021-02-01T00:00:00.000Z", "DATE_TO_STRING(DATE_ADD(TO_DATE('2024-01-31T00:00:00Z'), 'month', 1), '%Y-%m-%d')": "2024-02-29", "HOUR(TO_DATE('2024-07-01T00:00:00Z'), 'America/New_York')": 20,
        "DATE_FROM_STRING('nope', null, null, null)": None, "DATE_TO_STRING(DATE_TRUNC(TO_DATE('2024-07-03T00:00:00Z'), 'week'), '%Y-%m-%d')": "2024-06-30", "STRLEN('é')": 2, "STRLEN_CP('é')": 1, "STRPOS('abc', 'c')": 3, "LOCATE('z', 'abc')": 0,
        "ALL_ELEMENTS_TRUE(ARRAY_RANGE(0, 2))": False, "SIZE_OF_ARRAY(ZIP_ARRAY(ARRAY_RANGE(0, 3), ARRAY_RANGE(0, 2)))": 2, "SIZE_OF_ARRAY(ZIP_ARRAY(ARRAY_RANGE(0, 3), ARRAY_RANGE(0, 0)))": 0, "TO_BOOL('false')": True, "wrapParam('a \\'b\\'')": "a 'b'",
    }
    for e, want in cases.items():
        assert one(e) == want, e


def test_order_and_limits(engine):
    assert [r[0] for r in rows(engine.sql("SELECT id FROM orders ORDER BY price DESC LIMIT 2 OFFSET 1"))] == [1, 3]
    assert rows(engine.sql("SELECT id FROM orders", default_limit=2)).__len__() == 2
    with pytest.raises(StatementError):
        engine.sql("SELECT id FROM orders ORDER BY id + 1")


def test_groups(engine):
    assert sorted(rows(engine.sql("SELECT item, COUNT(customerId) AS n, COUNT(DISTINCT customerId) AS d FROM orders GROUP BY item"))) == [("ropes", 3, 3), ("sails", 1, 1), ("tar", 1, 1)]
    ends = rows(engine.sql("SELECT item, FIRSTN(2, 'id') AS f, LASTN(1, 'id') AS l, SUM(price) AS s FROM orders GROUP BY item ORDER BY item"))
    assert ends[0] == ("ropes", [1, 3], [4], 12.0)
    whole = rows(engine.sql("SELECT FIRSTN(2) AS f FROM orders"))
    assert [r.id for r in whole[0][0]] == [1, 2]
    assert rows(engine.sql("SELECT SUM(CASE WHEN item = 'ropes' THEN 1 ELSE 0 END) AS a, ROUND(SUM(price), 0) AS s FROM orders")) == [(3, 25.0)]


def test_ranks(engine):
    got = sorted(rows(engine.sql("SELECT id, RANK() OVER (ORDER BY item) AS r, DENSE_RANK() OVER (ORDER BY item) AS d, ROW_NUMBER() OVER (ORDER BY id DESC) AS n FROM orders")))
    assert got == [(1, 1, 1, 5), (2, 4, 2, 4), (3, 1, 1, 3), (4, 1, 1, 2), (5, 5, 3, 1)]


def test_schema_of_results(engine):
    got = {r["path"]: r for r in engine.result_schema("SELECT id AS k, Address, Rentals FROM people p")}
    assert got["k"]["type"] == "integer" and got["k"]["as"] == "k" and got["Address.City"]["type"] == "string"
    assert got["Rentals"]["isArray"] and got["Rentals.Payments"]["isArray"] and got["Rentals.filmId"]["type"] == "integer" and [r["order"] for r in got.values()] == list(range(len(got)))
    assert engine.result_schema("SELECT orderDate FROM orders")[0]["format"] == "date-time"
    assert engine.result_schema("SELECT o.id, v.sku FROM orders o INNER JOIN inventory 'v|unwind' ON v.sku = o.item")[1]["collectionName"] == "inventory"


def test_quoted_names_after_a_dot():
    q = parse("SELECT c.'First Name' AS n, c.\"Last\" AS l FROM t c WHERE c.'a' = 1")
    assert [i.expr for i in q.items] == [Name(("c", "First Name")), Name(("c", "Last"))] and q.where.left == Name(("c", "a"))


def test_analysis():
    got = Engine.analyze("SELECT o.a, COUNT(*) AS n FROM orders o LEFT JOIN (SELECT x FROM parts) 'p|first' ON p.x = o.a GROUP BY o.a LIMIT 5")
    assert got == {"kind": "aggregate", "collections": ["orders", "parts"], "joins": [("left", "p")], "columns": ["a", "n"], "grouped": True, "limit": 5, "offset": None}
    assert Engine.analyze("SELECT * FROM t")["kind"] == "query"


def test_totals_of_a_joined_side(engine):
    text = "SELECT o.id AS i, SIZE_OF_ARRAY(v) AS n, SUM_ARRAY(v, 'instock') AS s, AVG_ARRAY(v, 'instock') AS a{} FROM orders o LEFT JOIN inventory v ON v.sku = o.item ORDER BY i"
    plain, gathered = engine.sql(text.format("")), engine.sql(text.format(", v AS w"))
    assert rows(plain) == [tuple(r)[:4] for r in gathered.collect()] and rows(plain)[4] == (5, 0, 0.0, None)
    plan = engine.explain(text.format(""))
    assert "collect_list" not in plan and "collect_list" in engine.explain(text.format(", v AS w"))
    assert rows(engine.sql("SELECT o.id AS i, SUM_ARRAY(v, 'sku') AS s FROM orders o LEFT JOIN inventory v ON v.sku = o.item AND o.id < 3 ORDER BY i"))[0] == (1, 0.0)


def test_places_that_are_columns(engine):
    got = rows(engine.sql("SELECT id, ROUND(price / 3, n) AS r, TRUNC(price / 3, n) AS t, TRUNC(-price, -1) AS u FROM (SELECT id, price, CASE WHEN id = 5 THEN null ELSE id - 2 END AS n FROM orders) x ORDER BY id"))
    assert got == [(1, 0.0, 0.0, -0.0), (2, 4.0, 3.0, -10.0), (3, 1.3, 1.3, -0.0), (4, 0.5, 0.5, -0.0), (5, None, None, -0.0)]


def test_simple_statements():
    for text, want in (("SELECT a, b AS c FROM t WHERE x = 1 ORDER BY a LIMIT 3", True), ("SELECT * FROM t", True), ("SELECT a FROM t x", False), ("SELECT COUNT(*) AS n FROM t", False), ("SELECT a FROM t UNION SELECT a FROM u", False), ("SELECT DISTINCT a FROM t", False), ("SELECT a FROM t WHERE a IN (SELECT b FROM u)", False), ("SELECT UNWIND(a) AS b FROM t", False)):
        assert Engine.is_simple(text) is want, text


def test_id_column(spark):
    e = Engine(spark, {"t": spark.createDataFrame([("x", 1)], "_id string, a int")})
    assert e.sql("SELECT * FROM t", unset_id=True).columns == ["a"] and e.sql("SELECT _id, a FROM t", unset_id=True).columns == ["_id", "a"]
    assert e.sql("SELECT *, unset(_id) FROM t").columns == ["a"]


def test_files_as_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", {"k": 1})], "id int, s string, m map<string,int>")
    df.write.json(f"{tmp_path}/j.json")
    df.drop("m").write.orc(f"{tmp_path}/o.orc")
    df.drop("m").write.option("header", "true").csv(f"{tmp_path}/c.csv")
    e = Engine(spark, folder=str(tmp_path))
    assert rows(e.sql("SELECT id, m.k AS k FROM j")) == [(1, 1)] and rows(e.sql("SELECT s FROM o")) == [("a",)] and rows(e.sql("SELECT s FROM c")) == [("a",)]


def test_filters_reach_the_scan(spark, data):
    e = Engine(spark, folder=data)
    plan = e.explain("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "EqualTo(o_orderstatus,F)" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_statement_on_a_stream(spark, tmp_path):
    from docloom.streaming import stream_table, windowed_counts, write_table

    src = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, i), "a" if i % 2 else "b") for i in range(20)], "id int, at timestamp, kind string")
    src.repartition(2).write.parquet(f"file://{tmp_path}/in")
    s = stream_table(spark, f"file://{tmp_path}/in", src.schema, files_per_trigger=1)
    e = Engine(spark, {"s": s})
    for _ in range(2):  # the second run finds nothing new
        write_table(e.sql("SELECT id, UPPER(kind) AS k FROM s WHERE id >= 10"), f"file://{tmp_path}/out", f"{tmp_path.name}-f").awaitTermination()
    assert sorted(rows(spark.read.parquet(f"file://{tmp_path}/out"))) == [(i, "A" if i % 2 else "B") for i in range(10, 20)]
    w = windowed_counts(s, "at", ["kind"], "5 minutes", "1 hour")
    q = w.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cw").start()
    q.awaitTermination()
    assert spark.table("w").groupBy().sum("n").first()[0] == 20


def test_joined_sides_hold_only_what_is_used(spark, data, engine):
    kind = lambda text: engine.sql(text).select("v").schema["v"].dataType.simpleString()
    assert kind("SELECT id, SIZE_OF_ARRAY(v) AS n, v.instock AS s, FIRST_IN_ARRAY(v) AS v FROM orders INNER JOIN inventory v ON v.sku = item") == "struct<id:int,sku:string,instock:int>"
    plan = Engine(spark, folder=data).explain("SELECT o.o_orderkey AS i, SUM_ARRAY(v, 'l_quantity') AS n FROM orders o INNER JOIN lineitem v ON v.l_orderkey = o.o_orderkey")
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    got = engine.sql("SELECT o.id AS i, (SELECT instock AS `$$ROOT` FROM v WHERE sku = 'ropes') AS s FROM orders o INNER JOIN inventory v ON v.sku = o.item ORDER BY i")
    assert rows(got) == [(1, [31]), (2, []), (3, [31]), (4, [31])]


def test_conditions_on_the_joined_side_filter_it_first(spark, data):
    e = Engine(spark, folder=data)
    text = "SELECT c.c_custkey AS k, SIZE_OF_ARRAY(o) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 100000 AND o.o_orderstatus = 'F'"
    got = {r.k: r.n for r in e.sql(text).collect()}
    orders = spark.read.parquet(f"{data}/orders.parquet").where("o_totalprice > 100000 AND o_orderstatus = 'F'").groupBy("o_custkey").count().collect()
    assert sum(got.values()) == sum(r["count"] for r in orders) and len(got) == spark.read.parquet(f"{data}/customer.parquet").count()
    assert "GreaterThan(o_totalprice,100000.0)" in e.explain(text)
