"""Keys of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from icuflow.catalog.basics import SQL_K, events_with_k
from icuflow.catalog.clinical_sql import with_views
from icuflow.catalog.registry import query
from icuflow.functions import values as val
from icuflow.operators.concepts import concept_columns
from icuflow.operators.ordered import exact_quantiles
from icuflow.operators.tables import occupancy_share, group_rate
from icuflow.plans.run_logs import agent_stay, demand_by_run
from icuflow.sources.clinical import clinical_views
from icuflow.sources.tables import scan, stage

TYPES = ["click", "error", "purchase", "signup", "view"]


@query("pivot_min_max_avg", "SELECT user_id, " + ", ".join(
    f"round({f}(value) FILTER (event_type = '{t}'), 8) AS {t}_{n}" for t in TYPES for n, f in [("min", "min"), ("max", "max"), ("mean", "avg")]
) + " FROM events GROUP BY user_id")
def _(spark, folder):
    wide = scan(spark, folder, "events", "user_id", "event_type", "value").groupBy("user_id").agg(
        *concept_columns(TYPES, ["min", "max", "mean"], "event_type", "value")
    )
    return wide.select("user_id", *[F.round(c, 8).alias(c) for c in wide.columns if c != "user_id"])


@query("flag_max", """
    SELECT user_id, max(CASE WHEN event_type = 'error' AND value > 150 THEN 1 ELSE 0 END) AS high_error,
           CAST(max(CASE WHEN event_type = 'view' AND value > 150 THEN 1 END) AS DOUBLE) AS high_view FROM events GROUP BY user_id""")
def _(spark, folder):
    high = F.col("value") > 150
    return scan(spark, folder, "events", "user_id", "event_type", "value").groupBy("user_id").agg(
        F.max(val.flag((F.col("event_type") == "error") & high)).alias("high_error"),
        F.max(F.when((F.col("event_type") == "view") & high, 1)).cast("double").alias("high_view"),
    )


@query("signed_sum", """
    SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -1 * l_quantity ELSE l_quantity END) AS net FROM lineitem GROUP BY l_suppkey""")
def _(spark, folder):
    q = F.col("l_quantity")
    return scan(spark, folder, "lineitem", "l_suppkey", "l_quantity", "l_returnflag").groupBy("l_suppkey").agg(
        F.sum(F.when((F.col("l_returnflag") == "R") & (q > 0), -q).otherwise(q)).alias("net")
    )


@query("conditional_distinct", """
    SELECT CAST(CAST(ts AS DATE) - CAST(user_id % 7 AS INTEGER) AS VARCHAR) AS day, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS clickers,
           count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewers, count(DISTINCT user_id) AS users
    FROM events GROUP BY 1""")
def _(spark, folder):
    shifted = scan(spark, folder, "events", "user_id", "event_type", "ts").select(
        F.date_sub(F.to_date("ts"), (F.col("user_id") % 7).cast("int")).cast("string").alias("day"), "event_type", "user_id"
    )
    # one row per (day, user) with its flags, so the distinct counts are plain sums
    seen = shifted.groupBy("day", "user_id").agg(*[
        F.max(val.flag(F.col("event_type") == t)).alias(n) for n, t in [("clicked", "click"), ("viewed", "view")]
    ])
    return seen.groupBy("day").agg(
        F.sum("clicked").alias("clickers"), F.sum("viewed").alias("viewers"), F.count(F.lit(1)).alias("users")
    )


@query("having_span", """
    SELECT user_id, event_type, round((epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) / 3600.0::DOUBLE, 6) AS span_hours
    FROM events GROUP BY user_id, event_type HAVING min(ts) <> max(ts) AND count(*) > 5 AND max(CASE WHEN value > 100 THEN 1 ELSE 0 END) = 1""")
def _(spark, folder):
    spans = scan(spark, folder, "events", "user_id", "event_type", "ts", "value").groupBy("user_id", "event_type").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), F.max(val.flag(F.col("value") > 100)).alias("hit")
    )
    return spans.filter((F.col("start") != F.col("end")) & (F.col("n") > 5) & (F.col("hit") == 1)).select(
        "user_id", "event_type", F.round(val.hours(F.col("end"), F.col("start")), 6).alias("span_hours")
    )


@query("group_rate", """
    SELECT l_partkey, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS event_count, count(*) AS row_count,
           round(count(*) FILTER (l_returnflag = 'R') / count(*)::DOUBLE, 8) AS rate
    FROM lineitem GROUP BY l_partkey HAVING count(*) FILTER (l_returnflag = 'R') >= 10""")
def _(spark, folder):
    rows = scan(spark, folder, "lineitem", "l_partkey", "l_returnflag").withColumn(
        "returned", val.flag(F.col("l_returnflag") == "R")
    )
    return group_rate(rows, ["l_partkey"], "returned", 10).withColumn("rate", F.round("rate", 8))


@query("sum_flags", "SELECT user_id, " + ", ".join(
    f"CAST(count(*) FILTER (event_type = '{t}') AS BIGINT) AS is_{t}" for t in TYPES[1:]) + " FROM events GROUP BY user_id")
def _(spark, folder):
    dummies = scan(spark, folder, "events", "user_id", "event_type").select(
        "user_id", *val.one_hot(F.col("event_type"), TYPES, "is_")
    )
    return dummies.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in dummies.columns if c != "user_id"])


@query("group_max", """
    SELECT o_custkey, max(o_totalprice) AS most, max(o_totalprice) FILTER (o_orderstatus = 'F') AS most_fatal FROM orders GROUP BY o_custkey""")
def _(spark, folder):
    return scan(spark, folder, "orders", "o_custkey", "o_totalprice", "o_orderstatus").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("most"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("most_fatal")
    )


@query("daily_inflow", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS arrivals FROM orders GROUP BY 1")
def _(spark, folder):
    return scan(spark, folder, "orders", "o_orderdate").groupBy(
        F.to_date("o_orderdate").cast("string").alias("day")
    ).agg(F.count(F.lit(1)).alias("arrivals"))


SQL_OCC = "SELECT run, step, " + ", ".join(
    f"round(CASE WHEN n_{t} > 0 THEN n_{t} / (80 + 20 * (run % 3))::DOUBLE * 100 END, 8) AS {t}" for t in TYPES
) + " FROM (SELECT CAST(event_id % 4 AS INTEGER) AS run, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS step, " + ", ".join(
    f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in TYPES) + " FROM events GROUP BY ALL)"


def occupancy(spark, folder):
    rows = scan(spark, folder, "events", "event_id", "ts", "event_type").select(
        (F.col("event_id") % 4).cast("int").alias("run"),
        F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("step"), "event_type",
    )
    capacity = rows.select("run").distinct().withColumn("capacity", 80 + 20 * (F.col("run") % 3))
    wide = occupancy_share(rows, capacity, ["run", "step"], "event_type", TYPES)
    return wide.select("run", "step", *[F.round(t, 8).alias(t) for t in TYPES])


@query("occupancy_share", SQL_OCC)
def _(spark, folder):
    return occupancy(spark, folder)


@query("occupancy_quartiles", f"WITH occ AS ({SQL_OCC}) " + " UNION ALL ".join(
    f"SELECT '{t}' AS unit, min({t}) AS low, round(quantile_cont({t}, 0.25), 6) AS q1, round(quantile_cont({t}, 0.5), 6) AS q2, "
    f"round(quantile_cont({t}, 0.75), 6) AS q3, max({t}) AS high FROM occ" for t in TYPES))
def _(spark, folder):
    long = occupancy(spark, folder).unpivot(["run", "step"], TYPES, "unit", "share").filter(F.col("share").isNotNull())
    # a share is a whole number of beds over the capacity, so few distinct values are ranked
    counts = stage(long.groupBy("unit", "share").agg(F.count(F.lit(1)).alias("n")), "shares")
    quartiles = exact_quantiles(counts, "share", ["unit"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    ends = counts.groupBy("unit").agg(F.min("share").alias("low"), F.max("share").alias("high"))
    return ends.join(quartiles, "unit").select("unit", "low", *[F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")], "high")


@query("cohort_mean_std", """
    SELECT event_type, round(avg(value), 8) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS n FROM events GROUP BY event_type""")
def _(spark, folder):
    return scan(spark, folder, "events", "event_type", "value").groupBy("event_type").agg(
        F.round(F.avg("value"), 8).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count(F.lit(1)).alias("n")
    )


def runs(key, body, *views):
    return query(key, with_views(body, *views))


@runs("last_value_by_run", """
    SELECT run_number, least(any_value(n_doctors), any_value(n_nurses)) AS doctors, greatest(any_value(n_doctors), any_value(n_nurses)) AS nurses,
           max(max_agents) AS capacity, round(arg_max(demand_serviced, step), 8) AS demand FROM run_model GROUP BY run_number""", "run_model")
def _(spark, folder):
    out = demand_by_run(clinical_views(spark, folder)["run_model"])
    return out.withColumn("demand", F.round("demand", 8))


@runs("run_agent_los", "SELECT run_number, agent_id, max(days_in_hospital) AS los FROM run_agent GROUP BY ALL", "run_agent")
def _(spark, folder):
    return agent_stay(clinical_views(spark, folder)["run_agent"])


@runs("run_fatal_los", "SELECT run_number, agent_id, max(days_in_hospital) AS los FROM run_agent WHERE out_flag = 1 GROUP BY ALL", "run_agent")
def _(spark, folder):
    return agent_stay(clinical_views(spark, folder)["run_agent"], fatal=True)


@query("conditional_rate", """
    SELECT c_mktsegment, round(avg(CASE WHEN c_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0 END), 8) AS share, count(*) AS n FROM customer GROUP BY c_mktsegment""")
def _(spark, folder):
    return scan(spark, folder, "customer", "c_mktsegment", "c_acctbal").groupBy("c_mktsegment").agg(
        F.round(F.avg(val.flag(F.col("c_acctbal") > 5000)), 8).alias("share"), F.count(F.lit(1)).alias("n")
    )


@query("class_share", """
    SELECT round(avg((label % 3 = 0)::INTEGER), 8) AS q0, round(avg((label % 3 = 1)::INTEGER), 8) AS q1,
           round(avg((label % 3 = 2)::INTEGER), 8) AS q2 FROM embeddings""")
def _(spark, folder):
    y = F.col("label") % 3
    return scan(spark, folder, "embeddings", "label").agg(*[F.round(F.avg(val.flag(y == c)), 8).alias(f"q{c}") for c in range(3)])


@query("padded_spell", f"""
    SELECT user_id, CAST(date_trunc('second', min(ts)) - INTERVAL 1 HOUR AS VARCHAR) AS starttime,
           CAST(date_trunc('second', max(ts)) + INTERVAL 4 HOUR AS VARCHAR) AS endtime FROM events WHERE {SQL_K} >= 50 GROUP BY user_id""")
def _(spark, folder):
    rows = events_with_k(spark, folder, "user_id", "ts").filter(F.col("k") >= 50)
    return rows.groupBy("user_id").agg(
        val.plus(F.date_trunc("second", F.min("ts")), hours=-1).cast("string").alias("starttime"),
        val.plus(F.date_trunc("second", F.max("ts")), hours=4).cast("string").alias("endtime"),
    )
