"""The queries p1 to p7 over the tables of a data folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import incremental, nested, profile, references
from docloom.operators.history import Ledger
from docloom.operators.instants import CANONICAL, utc_micros
from docloom.operators.offers import dictionary_for, event_batches, offer_fields
from docloom.operators.wide import WideStore
from docloom.queries import instants_sql, objects_sql
from docloom.session import read_table, table_path, work_path

POLICIES = "ams360_powerbi_basicpolinfo"
PREMIUMS = "ams360_powerbi_policytranpremium"
CUSTOMERS = "ams360_powerbi_customer"
OFFERS = "flat_offer_history"
#: referring table, its field, table referred to, key there
REFERENCES = ((PREMIUMS, "PolId", POLICIES, "PolId"), (POLICIES, "CustId", CUSTOMERS, "CustId"))
NEVER = references.FOREVER
ARRAYS = [("jsonObjValues", "nestedObjArray"), ("jsonObjValues", "nestedStrArray"), ("jsonArray",)]
NUMBER = r"\A-?(?:[0-9]+(?:\.[0-9]{1,4})?|\.[0-9]{1,4})\z"
RULES = {
    POLICIES: [profile.Rule("Status", codes=("A", "C", "D", "N", "R")), profile.Rule("PolType", codes=("B", "C", "H", "M", "P", "S"))],
    PREMIUMS: [profile.Rule("Premium", number=NUMBER)],
}
INSTANTS = ((POLICIES, "PolEffDate"), (PREMIUMS, "EffDate"), (OFFERS, "CreatedDate"), ("function_test_data", "dateAchieved"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def keyed(rows: DataFrame, key: str, at: Column, *also: Column) -> DataFrame:
    """The integer halves of a key, a time, and further columns."""
    return rows.select(references.hex_digits(F.col(key)).alias("h"), at.alias("at"), *also).select("*", *references.halves(F.col("h"))).drop("h")


def orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    """table_name, field_name, row_id, at, k_hi, k_lo of every orphan of REFERENCES, which are swept together."""
    tombs = read_table(spark, sf, "record_tombstones")
    refs, parents, ended = [], [], []
    for table, field, to, key in REFERENCES:
        name = F.lit(table).alias("table_name")
        refs.append(keyed(read_table(spark, sf, table), field, utc_micros(F.col("_dateUpdated")), name, F.lit(field).alias("field_name"), F.col("_id").alias("row_id")))
        # A row without readable arrival never came.
        parents.append(keyed(read_table(spark, sf, to), key, F.coalesce(utc_micros(F.col("_dateUpdated")), F.lit(NEVER)), name))
        ended.append(keyed(tombs.where(F.col("collection_name") == to), "record_key", F.unix_micros(F.col("deleted_at").cast("timestamp")), name))
    return references.orphans(union(refs), union(parents), union(ended), by=("table_name",))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_rows(spark, sf).select("table_name", "field_name", "row_id")


def p1_orphans_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return references.by_period(orphan_rows(spark, sf), ["table_name", "field_name"])


def offer_store(spark: SparkSession, sf: str) -> WideStore:
    fields = offer_fields(read_table(spark, sf, "offer_fields"))
    known = dictionary_for(read_table(spark, sf, "feed_zones"))
    store = WideStore(spark, fields)
    for b in event_batches(read_table(spark, sf, OFFERS), fields, known):
        store.upsert(b.drop("value").withColumnRenamed("written", "value"))
    store.compact()
    return store


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    store = offer_store(spark, sf)
    return store.filled().select(F.col("entity").alias("parent_id"), F.col("attribute").alias("field_name"), "row_id")


def p2_wide(spark: SparkSession, sf: str) -> DataFrame:
    return offer_store(spark, sf).wide().withColumnRenamed("entity", "parent_id")


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """The filled cells of the wide table, one a row: numbers as double, other values as text."""
    wide = p2_wide(spark, sf)
    number = [f.name for f in wide.schema.fields if isinstance(f.dataType, T.NumericType)]
    cells = [F.struct(F.lit(c).alias("field_name"), F.when(F.lit(c not in number), F.col(c).cast("string")).alias("text_value"), (F.col(c).cast("double") if c in number else F.lit(None).cast("double")).alias("number_value")) for c in wide.columns[1:]]
    return wide.select("parent_id", F.inline(F.array(*cells))).where("text_value is not null or number_value is not null")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """The nested records of both tables as JSON text."""
    typed = read_table(spark, sf, "function_test_data").select(F.lit("function_test_data").alias("table_name"), F.col("_id").alias("row_id"), F.to_json(F.struct("jsonObjValues", "jsonArray")).alias("payload"))
    raw = read_table(spark, sf, "function_test_raw").select(F.lit("function_test_raw").alias("table_name"), F.col("_id").alias("row_id"), "payload")
    return typed.unionByName(raw)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.Flat(records(spark, sf), ARRAYS).occurrences.drop("child")


def p3_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct element with the number of its occurrences."""
    flat = nested.Flat(records(spark, sf), ARRAYS)
    nodes = flat.nodes
    n = flat.occurrences.groupBy("child").agg(F.count(F.lit(1)).alias("occurrences"))
    return n.join(nodes, "child").select(F.col("child").alias("node_id"), "node_type", "content", "occurrences")


def offer_ledger(spark: SparkSession, sf: str) -> Ledger:
    fields = offer_fields(read_table(spark, sf, "offer_fields"))
    known = dictionary_for(read_table(spark, sf, "feed_zones"))
    ledger = Ledger(spark)
    for b in event_batches(read_table(spark, sf, OFFERS), fields, known):
        ledger.record(b.withColumnRenamed("version", "valid_from"))
    return ledger


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return offer_ledger(spark, sf).history().select(F.col("entity").alias("parent_id"), F.col("attribute").alias("field_name"), "from_row_id", "to_row_id")


def p4_periods(spark: SparkSession, sf: str) -> DataFrame:
    h = offer_ledger(spark, sf).history()
    return h.select(F.col("entity").alias("parent_id"), F.col("attribute").alias("field_name"), F.col("written").alias("value"), F.timestamp_micros("valid_from").alias("valid_from"), F.timestamp_micros("valid_to").alias("valid_to"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for table, rules in RULES.items():
        p = profile.Profile(spark, table_path(sf, table), rules)
        name = F.lit(table).alias("table_name")
        parts.append(p.breaking_rows(["_id"]).select(name, "column_name", F.lit(0).cast("bigint").alias("load_no"), F.col("_id").alias("row_id")))
        parts.append(p.shifted_loads().select(name, "column_name", F.col("load").alias("load_no"), F.lit("").alias("row_id")))
    return union(parts)


def p5_summary(spark: SparkSession, sf: str) -> DataFrame:
    return union([profile.Profile(spark, table_path(sf, t), rules).summary().select(F.lit(t).alias("table_name"), "*") for t, rules in RULES.items()])


def p5_footers(spark: SparkSession, sf: str) -> DataFrame:
    return union([profile.Profile(spark, table_path(sf, t), rules).footers().select(F.lit(t).alias("table_name"), "*") for t, rules in RULES.items()])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    runs = read_table(spark, sf, "sync_runs")
    parts = []
    for table, key in ((POLICIES, "PolId"), (PREMIUMS, "PolTPId")):
        last = runs.where((F.col("table_name") == table) & (F.col("run_state") == "succeeded")).agg(F.unix_micros(F.max("cutoff_at").cast("timestamp")).alias("c")).first()["c"]
        rows = read_table(spark, sf, table)
        at = utc_micros(F.col("_dateUpdated"))
        then, now = incremental.versions_by_arrival(rows, at, last)
        key_of = F.coalesce(references.hex_digits(F.col(key)), F.trim(key)).alias("key")
        change = [key_of, utc_micros(F.col("ChangedDate")).alias("changed")]
        consumer = incremental.Consumer(spark, work_path(spark, "consumer"), ["key", "changed"])
        # The run before wrote neither its version nor what it had seen; both follow from the times of arrival.
        consumer.adopt(then, rows.where(at < F.lit(last)).select(*change))
        seen = consumer.seen()

        def step(added: DataFrame, gone: DataFrame, change=change, seen=seen, at=at) -> DataFrame:
            new = added.select(*change, at.alias("at"), F.col("_id").alias("row_id"))
            return incremental.first_of_change(new, seen, ["key", "changed"], ["at", "row_id"])

        consumer.run(rows, now, step)
        got = consumer.output()
        parts.append(got.select(F.lit(table).alias("table_name"), "row_id"))
    return union(parts)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for table, field in INSTANTS:
        t = read_table(spark, sf, table).where(F.col(field).isNotNull() & ~F.col(field).rlike(CANONICAL))
        parts.append(t.select(F.lit(table).alias("table_name"), F.col("_id").alias("row_id"), F.lit(field).alias("field_name"), F.col(field).alias("raw"), "feed_code"))
    rows = union(parts)
    d = dictionary_for(read_table(spark, sf, "feed_zones"))
    d.add(rows.select("raw", F.col("feed_code").alias("feed")))
    return d.match(rows, "raw", "feed_code").where(F.col("utc_micros").isNotNull()).drop("raw", "feed_code")


QUERIES = {f.__name__: f for f in (p1_found, p1_orphans_by_month, p2_found, p2_wide, p2_values, p3_found, p3_objects, p4_found, p4_periods, p5_found, p5_summary, p5_footers, p6_found, p7_found)}

#: SQL for those that SQL can express; see tests for the others.
KEY_SQL = """CASE WHEN length(regexp_replace({0}, '[^0-9A-Fa-f]', '', 'g')) = 32 AND regexp_matches({0}, '[1-9A-Fa-f]') THEN upper(regexp_replace({0}, '[^0-9A-Fa-f]', '', 'g')) END"""
UTC_SQL = "epoch_us(CAST(rtrim({0}, 'Z') AS TIMESTAMP))"


def orphan_sql(table: str, field: str, to: str, key: str) -> str:
    return f"""
    SELECT '{table}' AS table_name, '{field}' AS field_name, c.i AS row_id, c.t AS t, c.k AS k FROM (SELECT _id AS i, {KEY_SQL.format(field)} AS k, {UTC_SQL.format("_dateUpdated")} AS t FROM {table}) c
    WHERE c.k IS NOT NULL AND c.i NOT IN (
      SELECT r.i FROM (SELECT _id AS i, {KEY_SQL.format(field)} AS k, {UTC_SQL.format("_dateUpdated")} AS t FROM {table}) r
      JOIN (SELECT DISTINCT {KEY_SQL.format(key)} AS k, {UTC_SQL.format("_dateUpdated")} AS t FROM {to}) p ON p.k = r.k AND p.t <= r.t
      WHERE NOT EXISTS (SELECT 1 FROM (SELECT {KEY_SQL.format("record_key")} AS k, epoch_us(deleted_at) AS t FROM record_tombstones WHERE collection_name = '{to}') d WHERE d.k = r.k AND d.t > p.t AND d.t <= r.t))"""


ORPHANS = " UNION ALL ".join(orphan_sql(*x) for x in REFERENCES)


def first_change_sql(table: str, key: str) -> str:
    return f"""
    SELECT '{table}' AS table_name, row_id FROM (
      SELECT _id AS row_id, {UTC_SQL.format("_dateUpdated")} AS t, row_number() OVER (PARTITION BY {KEY_SQL.format(key)}, {UTC_SQL.format("ChangedDate")} ORDER BY {UTC_SQL.format("_dateUpdated")}, _id) AS n FROM {table})
    WHERE n = 1 AND t >= (SELECT epoch_us(max(cutoff_at)) FROM sync_runs WHERE table_name = '{table}' AND run_state = 'succeeded')"""


def breaking_sql(table: str, r: profile.Rule) -> str:
    good = f"{r.column} IN ({', '.join(repr(c) for c in r.codes)})" if r.codes else f"regexp_full_match({r.column}, '-?(?:[0-9]+(?:\\.[0-9]{{1,4}})?|\\.[0-9]{{1,4}})')"
    rows = f"(SELECT *, {r.column} AS v, ({r.column} IS NULL OR {r.column} IN ('', 'NULL')) AS missing, coalesce({good}, false) AND {r.column} NOT IN ('', 'NULL') AS ok FROM {table})"
    head = f"SELECT '{table}' AS table_name, '{r.column}' AS column_name"
    bad = f"{head}, 0::BIGINT AS load_no, _id AS row_id FROM {rows} WHERE NOT missing AND NOT ok"
    apart = "avg(missing::INT) - (SELECT avg(missing::INT) FROM " + rows + ") >= 0.15"
    if r.codes:
        for c in r.codes:
            share = f"count(*) FILTER (v = '{c}')::DOUBLE / greatest(count(*) FILTER (NOT missing), 1)"
            apart += f" OR abs({share} - (SELECT {share} FROM {rows})) >= 0.15"
    else:
        med = "median(CASE WHEN ok THEN CAST(v AS DOUBLE) END)"
        apart += f" OR {med} >= 5 * (SELECT {med} FROM {rows}) OR {med} * 5 <= (SELECT {med} FROM {rows})"
    return f"{bad} UNION ALL {head}, load_no::BIGINT, '' FROM {rows} GROUP BY load_no HAVING count(*) >= 100 AND ({apart})"


def summary_sql(table: str, r: profile.Rule) -> str:
    good = f"{r.column} IN ({', '.join(repr(c) for c in r.codes)})" if r.codes else f"regexp_full_match({r.column}, '-?(?:[0-9]+(?:\\.[0-9]{{1,4}})?|\\.[0-9]{{1,4}})')"
    rows = f"(SELECT load_no, {r.column} AS v, ({r.column} IS NULL OR {r.column} IN ('', 'NULL')) AS missing, coalesce({good}, false) AS ok FROM {table})"
    figures = "count(*) AS n_rows, count(*) FILTER (missing) AS n_missing, count(DISTINCT v) FILTER (NOT missing) AS n_distinct, count(*) FILTER (NOT missing AND NOT ok) AS n_breaking, min(v) FILTER (NOT missing) AS least, max(v) FILTER (NOT missing) AS greatest"
    head = f"SELECT '{table}' AS table_name, '{r.column}' AS column_name"
    return f"{head}, load_no::BIGINT AS load, false AS is_total, {figures} FROM {rows} GROUP BY load_no UNION ALL {head}, NULL, true, {figures} FROM {rows}"


CONTAINER_SQL = """CASE WHEN json_type({0}) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string({0}, '$')) THEN CASE WHEN json_type(json_extract_string({0}, '$')) IN ('OBJECT', 'ARRAY') THEN json_extract_string({0}, '$')::JSON ELSE {0} END ELSE {0} END ELSE {0} END"""
LISTS_SQL = f"""
WITH texts AS (SELECT _id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM function_test_raw),
roots AS (SELECT _id, {CONTAINER_SQL.format("j")} AS j FROM texts WHERE j IS NOT NULL),
objects AS (SELECT _id, j, {CONTAINER_SQL.format("json_extract(j, '$.jsonObjValues')")} AS o FROM roots),
places AS (
  SELECT _id, 'jsonObjValues.nestedObjArray' AS array_path, json_extract(o, '$.nestedObjArray') AS a FROM objects
  UNION ALL SELECT _id, 'jsonObjValues.nestedStrArray', json_extract(o, '$.nestedStrArray') FROM objects
  UNION ALL SELECT _id, 'jsonArray', json_extract(j, '$.jsonArray') FROM objects),
arrays AS (SELECT _id, array_path, {CONTAINER_SQL.format("a")} AS a FROM places WHERE a IS NOT NULL),
lists AS (SELECT _id, array_path, CASE json_type(a) WHEN 'ARRAY' THEN json_extract(a, '$[*]') WHEN 'OBJECT' THEN [a] WHEN 'VARCHAR' THEN [a] ELSE [] END AS l FROM arrays),
each_raw AS (SELECT _id, array_path, unnest(range(len(l))) AS pos, unnest(l) AS e FROM lists)"""
CHILDREN_SQL = f"""{LISTS_SQL},
typed AS (
  SELECT _id, 'jsonObjValues.nestedObjArray' AS array_path, unnest(range(len(jsonObjValues.nestedObjArray))) AS pos, unnest(jsonObjValues.nestedObjArray) IS NOT NULL AS there FROM function_test_data
  UNION ALL SELECT _id, 'jsonObjValues.nestedStrArray', unnest(range(len(jsonObjValues.nestedStrArray))), unnest(jsonObjValues.nestedStrArray) IS NOT NULL FROM function_test_data
  UNION ALL SELECT _id, 'jsonArray', unnest(range(len(jsonArray))), unnest(jsonArray) IS NOT NULL FROM function_test_data)
SELECT 'function_test_raw' AS table_name, _id AS row_id, array_path, pos FROM each_raw WHERE json_type(e) <> 'NULL'
UNION ALL SELECT 'function_test_data', _id, array_path, pos FROM typed WHERE there"""
ELEMENTS_SQL = f"""{LISTS_SQL}
SELECT e::JSON AS e, true AS nulls FROM each_raw WHERE json_type(e) <> 'NULL'
UNION ALL SELECT e, false FROM (SELECT to_json(unnest(jsonObjValues.nestedObjArray)) AS e FROM function_test_data) WHERE e IS NOT NULL AND e::VARCHAR <> 'null'
UNION ALL SELECT e, false FROM (SELECT to_json(unnest(jsonObjValues.nestedStrArray)) AS e FROM function_test_data) WHERE e IS NOT NULL AND e::VARCHAR <> 'null'
UNION ALL SELECT e, false FROM (SELECT to_json(unnest(jsonArray)) AS e FROM function_test_data) WHERE e IS NOT NULL AND e::VARCHAR <> 'null'"""
SQL: dict[str, str] = {
    "p2_found": instants_sql.CELLS,
    "p2_values": instants_sql.VALUES,
    "p4_periods": instants_sql.SPANS,
    "p5_summary": " UNION ALL ".join(summary_sql(t, r) for t, rules in RULES.items() for r in rules),
    "p3_found": CHILDREN_SQL,
    "p3_objects": objects_sql.objects(ELEMENTS_SQL),
    "p4_found": instants_sql.PERIODS,
    "p7_found": instants_sql.normalised(INSTANTS),
    "p1_found": f"SELECT table_name, field_name, row_id FROM ({ORPHANS})",
    "p1_orphans_by_month": f"SELECT table_name, field_name, strftime(make_timestamp(t), '%Y-%m-01') AS period, count(*) AS orphan_rows, count(DISTINCT k) AS missing_keys FROM ({ORPHANS}) GROUP BY 1, 2, 3",
    "p5_found": " UNION ALL ".join(breaking_sql(t, r) for t, rules in RULES.items() for r in rules),
    "p5_footers": " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{r.column}' AS column_name, count(*) AS n_rows, count(*) - count({r.column}) AS n_nulls, min({r.column}) AS least, max({r.column}) AS greatest, count(DISTINCT {r.column}) AS n_candidates FROM {t}" for t, rules in RULES.items() for r in rules),
    "p6_found": " UNION ALL ".join(first_change_sql(t, k) for t, k in ((POLICIES, "PolId"), (PREMIUMS, "PolTPId"))),
}
