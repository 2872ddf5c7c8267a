"""Keys of the ordered operators, sorts, set operations and row generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from icuflow.catalog.basics import SQL_K, events_with_k
from icuflow.catalog.registry import query
from icuflow.functions import values as val
from icuflow.operators.generate import daily_snapshots, densify, repeat_days
from icuflow.operators.ordered import (
    CHUNK, ecdf, last_per_key, number_rows, previous_values, quantile_curve, running_totals, time_chunk,
)
from icuflow.operators.tables import group_rate
from icuflow.sources.tables import scan, stage

ORDER = ["ts", "event_id"]


def chunked_events(spark, folder):
    return scan(spark, folder, "events", "event_id", "user_id", "event_type", "ts", "value").withColumn(CHUNK, time_chunk("ts"))


@query("row_number_rank", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events")
def _(spark, folder):
    return number_rows(chunked_events(spark, folder), ["user_id"], ORDER, CHUNK, "rn").select("event_id", "rn")


@query("latest_row", """
    SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1""")
def _(spark, folder):
    rows = scan(spark, folder, "events", "user_id", "event_type", "event_id", "ts", "value")
    return last_per_key(rows, ["user_id", "event_type"], ORDER).drop("ts")


@query("lag_partition_flag", """
    SELECT event_id, CAST(lag(event_id) OVER (PARTITION BY user_id, value > 100 ORDER BY ts, event_id) AS DOUBLE) AS previous FROM events""")
def _(spark, folder):
    rows = chunked_events(spark, folder).withColumn("high", F.col("value") > 100)
    return previous_values(rows, ["user_id", "high"], ORDER, CHUNK, {"previous": (F.col("event_id"), F.lit(True))}).select(
        "event_id", F.col("previous").cast("double").alias("previous")
    )


@query("lag_computed_partition", """
    SELECT event_id, lag(event_type) OVER (PARTITION BY user_id, CASE WHEN event_type = 'error' OR value > 80 THEN 1 ELSE 0 END
           ORDER BY ts, event_id) AS previous FROM events""")
def _(spark, folder):
    rows = chunked_events(spark, folder).withColumn("class", val.flag((F.col("event_type") == "error") | (F.col("value") > 80)))
    return previous_values(rows, ["user_id", "class"], ORDER, CHUNK, {"previous": (F.col("event_type"), F.lit(True))}).select(
        "event_id", "previous"
    )


SQL_SPELL = """
    SELECT *, CASE WHEN lag(event_type) OVER w = 'error' THEN 1 WHEN event_type = 'signup' AND value > 100 THEN 1
                   WHEN date_sub('hour', date_trunc('second', lag(ts) OVER w), date_trunc('second', ts)) > 8 THEN 1 ELSE 0 END AS fresh
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def spell_starts(spark, folder):
    rows = previous_values(chunked_events(spark, folder), ["user_id"], ORDER, CHUNK, {
        "last_type": (F.col("event_type"), F.lit(True)), "last_time": (F.col("ts"), F.lit(True)),
    })
    return rows.withColumn("fresh", val.flag(
        (F.col("last_type") == "error") | ((F.col("event_type") == "signup") & (F.col("value") > 100))
        | (val.whole_hours(F.col("ts"), F.col("last_time")) > 8)
    ))


@query("new_spell_flag", f"SELECT event_id, fresh FROM ({SQL_SPELL})")
def _(spark, folder):
    return spell_starts(spark, folder).select("event_id", "fresh")


@query("sessionize", f"SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS spell FROM ({SQL_SPELL})")
def _(spark, folder):
    return running_totals(stage(spell_starts(spark, folder), "starts"), ["user_id"], ["ts"], CHUNK, {"spell": F.col("fresh")}, ties_together=True).select(
        "event_id", "spell"
    )


@query("cumulative_caretime", """
    SELECT user_id, day, round(sum(ratio) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), 8) AS cum_ratio FROM (
      SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'click') / count(*)::DOUBLE AS ratio
      FROM events GROUP BY ALL)""")
def _(spark, folder):
    # one row per user and day at most, so a user has no more rows than days
    daily = scan(spark, folder, "events", "user_id", "event_type", "ts").groupBy("user_id", F.to_date("ts").alias("date")).agg(
        (F.count_if(F.col("event_type") == "click") / F.count(F.lit(1))).alias("ratio")
    ).withColumn(CHUNK, F.floor(F.unix_date("date") / 365))
    return running_totals(daily, ["user_id"], ["date"], CHUNK, {"cum_ratio": F.col("ratio")}).select(
        "user_id", F.col("date").cast("string").alias("day"), F.round("cum_ratio", 8).alias("cum_ratio")
    )


@query("prev_row_impute", """
    SELECT event_id, coalesce(v, lag(v) OVER (PARTITION BY user_id ORDER BY ts, event_id), 5) AS value
    FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events)""")
def _(spark, folder):
    rows = chunked_events(spark, folder).withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    rows = previous_values(rows, ["user_id"], ORDER, CHUNK, {"before": (F.col("v"), F.lit(True))})
    return rows.select("event_id", F.coalesce("v", "before", F.lit(5.0)).alias("value"))


@query("ecdf_table", """
    SELECT n, CAST(count(*) AS BIGINT) AS days, round(sum(count(*)) OVER (ORDER BY n) / sum(count(*)) OVER ()::DOUBLE, 8) AS ecdf
    FROM (SELECT count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)) GROUP BY n""")
def _(spark, folder):
    daily = scan(spark, folder, "events", "user_id", "ts").groupBy("user_id", F.to_date("ts")).agg(F.count(F.lit(1)).alias("per_day"))
    return ecdf(daily, "per_day", hold=stage).select(F.col("per_day").alias("n"), F.col("n").alias("days"), F.round("ecdf", 8).alias("ecdf"))


@query("ecdf_by_group", """
    SELECT DISTINCT user_id % 4 AS band, event_type, round(cume_dist() OVER (PARTITION BY user_id % 4 ORDER BY event_type), 8) AS ecdf FROM events""")
def _(spark, folder):
    rows = scan(spark, folder, "events", "user_id", "event_type").withColumn("band", F.col("user_id") % 4)
    # categories come from a dictionary, so one chunk holds them all
    return ecdf(rows, "event_type", ["band"], F.lit(0)).select("band", "event_type", F.round("ecdf", 8).alias("ecdf"))


@query("quantile_curve", """
    SELECT event_type, i, round(i / n::DOUBLE, 8) AS x, value AS y FROM (
      SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n
      FROM events)""")
def _(spark, folder):
    return quantile_curve(scan(spark, folder, "events", "event_type", "value"), "value", ["event_type"], hold=stage).withColumn("x", F.round("x", 8))


@query("multi_key_sort", """
    SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderstatus, o_orderpriority DESC, o_totalprice, o_orderkey""")
def _(spark, folder):
    return scan(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").orderBy(
        "o_orderstatus", F.desc("o_orderpriority"), "o_totalprice", "o_orderkey"
    )


@query("topk_rate", """
    SELECT l_partkey, round(sum((l_returnflag = 'R')::INTEGER) / count(*)::DOUBLE, 8) AS rate FROM lineitem GROUP BY l_partkey
    HAVING sum((l_returnflag = 'R')::INTEGER) >= 10 ORDER BY sum((l_returnflag = 'R')::INTEGER) / count(*)::DOUBLE DESC, l_partkey LIMIT 50""")
def _(spark, folder):
    rows = scan(spark, folder, "lineitem", "l_partkey", "l_returnflag").withColumn("returned", val.flag(F.col("l_returnflag") == "R"))
    return group_rate(rows, ["l_partkey"], "returned", 10).orderBy(F.desc("rate"), "l_partkey").limit(50).select(
        "l_partkey", F.round("rate", 8).alias("rate")
    )


@query("union_all_events", """
    SELECT event_id AS id, user_id AS stay, value, 0 AS ended FROM events UNION ALL
    SELECT o_orderkey, o_custkey, 0.0, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END FROM orders""")
def _(spark, folder):
    charted = scan(spark, folder, "events", "event_id", "user_id", "value").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("stay"), "value", F.lit(0).alias("ended")
    )
    ended = scan(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("stay"), F.lit(0.0).alias("value"),
        val.flag(F.col("o_orderstatus") == "F").alias("ended"),
    )
    return charted.unionByName(ended)


@query("union_distinct", """
    SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.08""")
def _(spark, folder):
    lines = scan(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_discount")

    def part(test):
        return lines.filter(test).select("l_partkey", "l_suppkey")
    return part(F.col("l_quantity") > 45).unionByName(part(F.col("l_discount") > 0.08)).dropDuplicates(["l_partkey", "l_suppkey"])


@query("daily_snapshots", """
    SELECT o_orderkey, CAST(d0 + i AS VARCHAR) AS date, i AS day_of_stay, CASE WHEN i < n THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS out_flag
    FROM (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d0, CAST(o_orderkey % 9 - 1 AS INTEGER) AS n,
                 unnest(CAST(range(0, o_orderkey % 9) AS INTEGER[])) AS i FROM orders)""")
def _(spark, folder):
    stays = scan(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").select(
        "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("start"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 9 - 1).cast("int")).alias("end"),
    )
    return daily_snapshots(stays, "o_orderkey", "start", "end", F.col("o_orderstatus") == "F").withColumn("date", F.col("date").cast("string"))


@query("day_range_explode", """
    SELECT o_orderkey, unnest(range(o_orderkey % 5, o_orderkey % 5 + o_custkey % 4)) AS day FROM orders""")
def _(spark, folder):
    rows = scan(spark, folder, "orders", "o_orderkey", "o_custkey").select(
        "o_orderkey", (F.col("o_orderkey") % 5).alias("first"), (F.col("o_orderkey") % 5 + F.col("o_custkey") % 4 - 1).alias("last")
    )
    return repeat_days(rows, "first", "last", "day").select("o_orderkey", "day")


@query("densify_days", f"""
    SELECT user_id, CAST(day AS INTEGER) AS day, coalesce(n, 0) AS n, coalesce(high, 0) AS high
    FROM (SELECT user_id, unnest(range(0, 20)) AS day FROM (SELECT DISTINCT user_id FROM events))
    FULL JOIN (SELECT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS day, count(*) AS n, count(*) FILTER ({SQL_K} > 90) AS high
               FROM events GROUP BY ALL) USING (user_id, day)""")
def _(spark, folder):
    rows = events_with_k(spark, folder, "user_id", "ts").groupBy(
        "user_id", F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 90).alias("high"))
    return densify(rows, rows.select("user_id").distinct(), "user_id", "day", 19, ["n", "high"])
