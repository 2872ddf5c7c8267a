"""Keys of sources, sinks, projection and filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from icuflow.catalog.registry import query
from icuflow.functions import values as val
from icuflow.operators.concepts import item_map, to_concepts
from icuflow.operators.ordered import first_per_key
from icuflow.operators.tables import repair_suffixes
from icuflow.session import scratch_path
from icuflow.sources.tables import first_rows, load_run_logs, read_csv, scan, stage, write_csv


def events_with_k(spark, folder, *columns):
    """Events with the number held in ``props``."""
    return scan(spark, folder, "events", *{*columns, "props"}).withColumn(
        "k", F.get_json_object("props", "$.k").cast("int")
    ).drop("props")


SQL_K = "CAST(json_extract(props, '$.k') AS INTEGER)"


@query("scan_project", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, folder):
    return scan(spark, folder, "events", "event_id", "user_id", "event_type", "value")


@query("export_all", "SELECT * FROM customer")
def _(spark, folder):
    return stage(scan(spark, folder, "customer"), "export")


@query("capped_fetch", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 100000")
def _(spark, folder):
    return first_rows(scan(spark, folder, "events", "event_id", "user_id", "value"), 100000, "event_id")


@query("csv_roundtrip", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, user_id, event_type, value, props FROM events")
def _(spark, folder):
    df = scan(spark, folder, "events")
    back = read_csv(spark, write_csv(df, scratch_path(spark, "events-csv")), df.schema)
    return back.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"), "user_id", "event_type", "value", "props"
    )


@query("csv_sink", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def _(spark, folder):
    out = scan(spark, folder, "events", "user_id", "value").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )
    return read_csv(spark, write_csv(out, scratch_path(spark, "users-csv")), out.schema)


@query("staged_table", """
    WITH spend AS (SELECT user_id, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY user_id)
    SELECT user_id, total, n FROM spend WHERE total > 3000""")
def _(spark, folder):
    spend = scan(spark, folder, "events", "user_id", "value").groupBy("user_id").agg(
        F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n")
    )
    return stage(spend, "spend").filter(F.col("total") > 3000)


@query("run_log_union", """
    SELECT CAST(event_id % 4 + 9 * CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                 WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS run_number, user_id AS agent_id, event_id, value FROM events""")
def _(spark, folder):
    logs = scan(spark, folder, "events", "event_id", "event_type", "user_id", "value").select(
        (F.col("event_id") % 4).cast("int").alias("run_number"), F.col("user_id").alias("agent_id"), "event_id", "value",
        "event_type",
    )
    root = scratch_path(spark, "runs")
    logs.write.partitionBy("event_type").option("header", True).csv(root)
    paths = [f"{root}/event_type={t}" for t in ("click", "error", "purchase", "signup", "view")]
    return load_run_logs(spark, paths, "run_number int, agent_id long, event_id long, value double").select(
        "run_number", "agent_id", "event_id", "value"
    )


@query("cte_chain", """
    WITH per_user AS (SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY user_id),
    graded AS (SELECT *, CASE WHEN total >= 3500 THEN 'high' WHEN total >= 3000 THEN 'middle' ELSE 'low' END AS grade FROM per_user)
    SELECT grade, count(*) AS users, CAST(sum(n) AS BIGINT) AS events, round(avg(total), 4) AS mean_total FROM graded GROUP BY grade""")
def _(spark, folder):
    return spark.sql("""
        WITH per_user AS (SELECT user_id, count(1) AS n, sum(value) AS total FROM {events} GROUP BY user_id),
        graded AS (SELECT n, total, CASE WHEN total >= 3500 THEN 'high' WHEN total >= 3000 THEN 'middle' ELSE 'low' END AS grade
                   FROM per_user)
        SELECT grade, count(1) AS users, sum(n) AS events, round(avg(total), 4) AS mean_total FROM graded GROUP BY grade
    """, events=scan(spark, folder, "events", "user_id", "value"))


# several codes fused into one concept, each with its own range and unit
CODE_MAP = [
    (code, name, low, low_in, high, high_in, shift, divide)
    for name, codes, low, low_in, high, high_in, shift, divide in [
        ("heartrate", range(0, 20), 0.0, False, 300.0, False, 0.0, 1.0),
        ("spo2", range(20, 35), 0.0, False, 100.0, True, 0.0, 1.0),
        ("tempc", range(35, 50), 70.0, False, 120.0, False, -32.0, 1.8),
        ("glucose", range(50, 90), 0.0, False, None, False, 0.0, 1.0),
    ] for code in codes
]
SQL_CONCEPT = f"""CASE WHEN {SQL_K} < 20 THEN 'heartrate' WHEN {SQL_K} < 35 THEN 'spo2' WHEN {SQL_K} < 50 THEN 'tempc' ELSE 'glucose' END"""


def coded_events(spark, folder):
    rows = events_with_k(spark, folder, "event_id", "value").select("event_id", F.col("k").alias("itemid"), F.col("value").alias("valuenum"))
    return to_concepts(rows, item_map(spark, CODE_MAP))


@query("item_concept_map", f"SELECT event_id, {SQL_CONCEPT} AS concept FROM events WHERE {SQL_K} < 90")
def _(spark, folder):
    return coded_events(spark, folder).select("event_id", "concept")


@query("range_null_out", """
    SELECT event_id, CASE event_type WHEN 'click' THEN CASE WHEN value > 5 AND value < 150 THEN value END
           WHEN 'view' THEN CASE WHEN value >= 10.01 AND value <= 100 THEN value END
           WHEN 'error' THEN CASE WHEN value > 70 AND value < 120 THEN value END
           ELSE value END AS value FROM events""")
def _(spark, folder):
    v, t = F.col("value"), F.col("event_type")
    return scan(spark, folder, "events", "event_id", "event_type", "value").select("event_id", (
        F.when(t == "click", val.in_range(v, 5, False, 150, False))
        .when(t == "view", val.in_range(v, 10.01, True, 100, True))
        .when(t == "error", val.in_range(v, 70, False, 120, False)).otherwise(v)
    ).alias("value"))


@query("unit_convert", f"""
    SELECT event_id, {SQL_CONCEPT} AS concept, round(CASE WHEN {SQL_K} < 20 THEN CASE WHEN value < 300 THEN value END
           WHEN {SQL_K} < 35 THEN CASE WHEN value <= 100 THEN value END
           WHEN {SQL_K} < 50 THEN CASE WHEN value > 70 AND value < 120 THEN (value - 32) / 1.8 END
           ELSE value END, 8) AS num FROM events WHERE {SQL_K} < 90""")
def _(spark, folder):
    return coded_events(spark, folder).select("event_id", "concept", F.round("num", 8).alias("num"))


IN_LIST = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 4, 9, 25, 49]


@query("in_list_filter", f"SELECT event_id, {SQL_K} AS k FROM events WHERE {SQL_K} IN ({', '.join(map(str, IN_LIST))})")
def _(spark, folder):
    return events_with_k(spark, folder, "event_id").filter(F.col("k").isin(IN_LIST))


@query("null_safe_filter", """
    SELECT event_type, count(*) FILTER (e <> 1) AS known_good, count(*) FILTER (e IS DISTINCT FROM 1) AS not_bad
    FROM (SELECT event_type, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 1 END AS e FROM events) GROUP BY event_type""")
def _(spark, folder):
    e = F.col("event_id") % 3
    rows = scan(spark, folder, "events", "event_id", "event_type").withColumn(
        "error", F.when(e == 0, None).when(e == 1, 0).otherwise(1)
    )
    return rows.groupBy("event_type").agg(
        F.count_if(F.col("error") != 1).alias("known_good"), F.count_if(~F.col("error").eqNullSafe(1)).alias("not_bad")
    )


@query("text_like_flag", """
    SELECT doc_id, CASE WHEN lower(text) LIKE '%copyright%' THEN 1 ELSE 0 END AS has_word,
           CASE WHEN regexp_matches(lower(text), '(license|password)') THEN 1 ELSE 0 END AS has_either FROM documents""")
def _(spark, folder):
    text = F.lower("text")
    return scan(spark, folder, "documents", "doc_id", "text").select(
        "doc_id", val.flag(text.contains("copyright")).alias("has_word"),
        val.flag(text.rlike("(license|password)")).alias("has_either"),
    )


@query("string_range_flag", """
    SELECT p_partkey, CASE WHEN p_brand || ' ' BETWEEN 'Brand#1 ' AND 'Brand#15 ' THEN 1
                           WHEN p_brand || ' ' BETWEEN 'Brand#2 ' AND 'Brand#2 ' THEN 1 ELSE 0 END AS inside,
           CASE WHEN p_brand BETWEEN 'Brand#2 ' AND 'Brand#25' THEN 1 ELSE 0 END AS unpadded FROM part""")
def _(spark, folder):
    padded = F.concat("p_brand", F.lit(" "))
    return scan(spark, folder, "part", "p_partkey", "p_brand").select(
        "p_partkey", val.flag(val.in_code_ranges(padded, [("Brand#1 ", "Brand#15 "), ("Brand#2 ", "Brand#2 ")])).alias("inside"),
        val.flag(val.in_code_ranges(F.col("p_brand"), [("Brand#2 ", "Brand#25")])).alias("unpadded"),
    )


@query("star_except", "SELECT * EXCLUDE (o_orderdate, o_orderpriority) FROM orders")
def _(spark, folder):
    return scan(spark, folder, "orders").drop("o_orderdate", "o_orderpriority")


@query("rename_after_join", """
    SELECT e.user_id, e.n AS n, round(e.total, 4) AS total, p.n AS n_right, round(p.total, 4) AS total_right
    FROM (SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY user_id) e
    LEFT JOIN (SELECT user_id, count(*) AS n, sum(value) AS total FROM events WHERE event_type = 'purchase' GROUP BY user_id) p
    ON p.user_id = e.user_id""")
def _(spark, folder):
    events = scan(spark, folder, "events", "user_id", "event_type", "value")

    def summary(df):
        return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return repair_suffixes(summary(events), summary(events.filter(F.col("event_type") == "purchase")), ["user_id"])


@query("dedupe_first", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
      FROM lineitem) WHERE rn = 1""")
def _(spark, folder):
    lines = scan(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return first_per_key(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("mask_filter", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem
    WHERE l_quantity > 30 AND l_discount > l_tax + 0.04 AND l_returnflag <> 'N'""")
def _(spark, folder):
    lines = scan(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return lines.filter(
        (F.col("l_quantity") > 30) & (F.col("l_discount") > F.col("l_tax") + 0.04) & (F.col("l_returnflag") != "N")
    ).drop("l_returnflag")


@query("fill_zero", """
    SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'
               GROUP BY o_custkey) ON o_custkey = c_custkey""")
def _(spark, folder):
    spent = scan(spark, folder, "orders", "o_custkey", "o_orderstatus", "o_totalprice").filter(
        F.col("o_orderstatus") == "F"
    ).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    return scan(spark, folder, "customer", "c_custkey").join(spent, "c_custkey", "left").fillna({"n": 0, "total": 0.0})


@query("cap_flag", "SELECT user_id, CAST(least(count(*) FILTER (event_type = 'error' AND value > 200), 1) AS BIGINT) AS had_error FROM events GROUP BY user_id")
def _(spark, folder):
    hit = (F.col("event_type") == "error") & (F.col("value") > 200)
    return scan(spark, folder, "events", "user_id", "event_type", "value").groupBy("user_id").agg(
        val.cap_flag(F.count_if(hit)).alias("had_error")
    )


@query("safe_int_parse", f"""
    SELECT event_id, CAST(try_cast(CASE WHEN regexp_full_match(c, '[0-9]+') THEN c END AS INTEGER) AS DOUBLE) AS number
    FROM (SELECT event_id, substr(concat({SQL_K}, '0', event_type), 1, 3) AS c FROM events)""")
def _(spark, folder):
    code = F.concat(F.col("k").cast("string"), F.lit("0"), F.col("event_type"))
    return events_with_k(spark, folder, "event_id", "event_type").select(
        "event_id", val.code_prefix_number(code).cast("double").alias("number")
    )


@query("valid_value_filter", f"""
    SELECT event_id, v FROM (SELECT event_id, CASE WHEN {SQL_K} = 13 THEN NULL ELSE value - 10 END AS v,
                                    CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS t FROM events)
    WHERE v IS NOT NULL AND v > 0 AND t <> ''""")
def _(spark, folder):
    rows = events_with_k(spark, folder, "event_id", "event_type", "value").select(
        "event_id", F.when(F.col("k") == 13, None).otherwise(F.col("value") - 10).alias("v"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("t"),
    )
    return rows.filter(F.col("v").isNotNull() & (F.col("v") > 0) & (F.col("t") != "")).drop("t")


@query("distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def _(spark, folder):
    return scan(spark, folder, "part", "p_brand", "p_type").distinct()
