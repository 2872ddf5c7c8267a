"""Keys of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from icuflow.catalog.basics import SQL_K, events_with_k
from icuflow.catalog.registry import query
from icuflow.functions.values import plus, within_days
from icuflow.operators import pairs
from icuflow.operators.joins import asof_lookback, interval_join, join_stays
from icuflow.operators.ordered import first_per_key
from icuflow.operators.tables import group_rate
from icuflow.sources.tables import scan


def per_user(df, name):
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.round(F.sum("value"), 4).alias(f"sum_{name}"))


@query("inner_star_join", """
    SELECT n_name, p_brand, o_orderstatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def _(spark, folder):
    lines = scan(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    orders = scan(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    customers = scan(spark, folder, "customer", "c_custkey", "c_nationkey")
    star = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(scan(spark, folder, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(scan(spark, folder, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    )
    return star.groupBy("n_name", "p_brand", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query("left_feature_join", """
    WITH f AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL)
    SELECT u.user_id, CAST(v.n AS DOUBLE) AS n_view, v.s AS sum_view, CAST(c.n AS DOUBLE) AS n_click, c.s AS sum_click, CAST(p.n AS DOUBLE) AS n_large, p.s AS sum_large
    FROM (SELECT DISTINCT user_id FROM events) u
    LEFT JOIN (SELECT * FROM f WHERE event_type = 'view') v USING (user_id)
    LEFT JOIN (SELECT * FROM f WHERE event_type = 'click') c USING (user_id)
    LEFT JOIN (SELECT user_id, count(*) AS n, round(sum(value), 4) AS s FROM events WHERE value > 200 GROUP BY user_id) p USING (user_id)""")
def _(spark, folder):
    events = scan(spark, folder, "events", "user_id", "event_type", "value")
    stays = events.select("user_id").distinct()
    for name, test in [("view", F.col("event_type") == "view"), ("click", F.col("event_type") == "click"), ("large", F.col("value") > 200)]:
        stays = stays.join(per_user(events.filter(test), name), "user_id", "left")
    return stays.select("user_id", *[
        F.col(c).cast("double").alias(c) if c.startswith("n_") else F.col(c) for c in stays.columns if c != "user_id"
    ])


@query("right_join_filtered", """
    SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM lineitem RIGHT JOIN orders ON o_orderkey = l_orderkey
    WHERE l_partkey IS NOT NULL GROUP BY o_orderstatus""")
def _(spark, folder):
    lines = scan(spark, folder, "lineitem", "l_orderkey", "l_partkey")
    orders = scan(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    # lines are counted per order before the join, so no order is hot in it
    counted = lines.groupBy("l_orderkey").agg(F.count("l_partkey").alias("lines"))
    rows = counted.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "right").filter(F.col("lines") > 0)
    return rows.groupBy("o_orderstatus").agg(F.sum("lines").alias("n"), F.count(F.lit(1)).alias("orders"))


@query("full_outer_using", """
    SELECT user_id, CAST(p.n AS DOUBLE) AS purchases, CAST(e.n AS DOUBLE) AS errors
    FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 150 GROUP BY user_id) p
    FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 150 GROUP BY user_id) e
    USING (user_id)""")
def _(spark, folder):
    high = scan(spark, folder, "events", "user_id", "event_type", "value").filter(F.col("value") > 150)

    def count(kind, name):
        return high.filter(F.col("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias(name))
    return count("purchase", "purchases").join(count("error", "errors"), ["user_id"], "full")


@query("window_range_join", """
    WITH s AS (SELECT user_id, min(ts) AS t0 FROM events GROUP BY user_id)
    SELECT user_id, count(*) FILTER (ts <= t0 + INTERVAL 1 DAY) AS first_24h,
           count(*) FILTER (CAST(ts AS DATE) - CAST(t0 AS DATE) <= 1) AS two_days
    FROM events JOIN s USING (user_id)
    WHERE ts <= t0 + INTERVAL 1 DAY OR CAST(ts AS DATE) - CAST(t0 AS DATE) <= 1 GROUP BY user_id""")
def _(spark, folder):
    events = scan(spark, folder, "events", "user_id", "event_id", "ts")
    stays = events.groupBy("user_id").agg(F.min("ts").alias("intime"))
    by_hours = F.col("ts").between(F.col("intime"), plus(F.col("intime"), days=1))
    by_day = within_days(F.col("ts"), F.col("intime"), 0, 1)
    return join_stays(events, stays, ["user_id"], ["event_id"], by_hours | by_day).groupBy("user_id").agg(
        F.count_if(by_hours).alias("first_24h"), F.count_if(by_day).alias("two_days")
    )


@query("point_in_interval_join", """
    WITH spells AS (SELECT user_id, CAST(ts AS DATE) AS d, min(ts) - INTERVAL 1 HOUR AS t0, max(ts) + INTERVAL 4 HOUR AS t1
                    FROM events WHERE event_type = 'signup' GROUP BY ALL)
    SELECT e.event_id, CASE WHEN s.user_id IS NULL THEN 0 ELSE 1 END AS inside, CAST(s.d AS VARCHAR) AS day
    FROM events e LEFT JOIN spells s ON s.user_id = e.user_id AND e.ts BETWEEN s.t0 AND s.t1 WHERE e.event_type = 'view'""")
def _(spark, folder):
    events = scan(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    spells = events.filter(F.col("event_type") == "signup").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        plus(F.min("ts"), hours=-1).alias("start"), plus(F.max("ts"), hours=4).alias("end")
    )
    views = events.filter(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    return interval_join(views, spells, ["user_id"], "ts", "start", "end").select(
        "event_id", F.when(F.col("start").isNull(), 0).otherwise(1).alias("inside"), F.col("day").cast("string").alias("day")
    )


@query("asof_lookback_join", """
    SELECT p.event_id, CAST(CASE WHEN p.ts - c.ts <= INTERVAL 48 HOUR THEN c.event_id END AS DOUBLE) AS click_id,
           CASE WHEN p.ts - c.ts <= INTERVAL 48 HOUR THEN c.value END AS click_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON c.user_id = p.user_id AND p.ts >= c.ts""")
def _(spark, folder):
    events = scan(spark, folder, "events", "event_id", "user_id", "event_type", "ts", "value")
    purchases = events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = events.filter(F.col("event_type") == "click").select(
        "user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value")
    )
    return asof_lookback(purchases, clicks, ["user_id"], "ts", ["click_id", "click_value"], 48 * 3600).select(
        "event_id", F.col("click_id").cast("double").alias("click_id"), "click_value"
    )


@query("left_on_vs_where", """
    SELECT o_orderstatus, count(*) AS kept_all, count(l_quantity) AS matched,
           count(*) FILTER (l_quantity IS NOT NULL) AS kept_matching
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity >= 45 GROUP BY o_orderstatus""")
def _(spark, folder):
    orders = scan(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    lines = scan(spark, folder, "lineitem", "l_orderkey", "l_quantity")
    # an outer join cannot split a hot key on its right side, so the lines are counted per order first
    counted = lines.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_quantity") >= 45).alias("hits"), F.count(F.lit(1)).alias("lines")
    )
    on = F.col("o_orderkey") == F.col("l_orderkey")
    inside = orders.join(counted.filter(F.col("hits") > 0), on, "left").groupBy("o_orderstatus").agg(
        F.sum(F.greatest(F.coalesce("hits", F.lit(1)), F.lit(1))).alias("kept_all"), F.sum(F.coalesce("hits", F.lit(0))).alias("matched")
    )
    after = orders.join(counted, on, "left").filter(F.col("hits") > 0).groupBy("o_orderstatus").agg(
        F.sum("hits").alias("kept_matching")
    )
    return inside.join(after, "o_orderstatus")


TOP = 20
SQL_PAIRS = f"""
    WITH rows AS (SELECT DISTINCT user_id, {SQL_K} AS code, CAST(user_id % 2 AS BIGINT) AS died FROM events),
    best AS (SELECT code FROM (SELECT code, sum(died) AS d, count(*) AS n FROM rows GROUP BY code) WHERE d >= 10
             ORDER BY d::DOUBLE / n DESC, code LIMIT {TOP}),
    top AS (SELECT * FROM rows WHERE code IN (SELECT code FROM best)),
    pairs AS (SELECT a.code AS code_a, b.code AS code_b, a.user_id, a.died FROM top a JOIN top b ON a.user_id = b.user_id AND a.code < b.code)"""


def code_pairs(spark, folder):
    """Users as stays, the number in props as code; every odd user died."""
    rows = events_with_k(spark, folder, "user_id").select("user_id", F.col("k").alias("code")).distinct().withColumn(
        "died", F.col("user_id") % 2
    )
    ranked = pairs.ranked_codes(group_rate(rows, ["code"], "died", least=10), "code", TOP)
    masks = pairs.stay_masks(rows, ranked, "user_id", "code", TOP, [F.max("died").alias("died")])
    return ranked, masks


def named(table, ranked):
    """Places back to codes, the smaller code first."""
    a, b = F.col("code_x"), F.col("code_y")
    return (
        table.join(F.broadcast(ranked.select(F.col("place").alias("a"), F.col("code").alias("code_x"))), "a")
        .join(F.broadcast(ranked.select(F.col("place").alias("b"), F.col("code").alias("code_y"))), "b")
        .withColumns({"code_a": F.least(a, b), "code_b": F.greatest(a, b)}).drop("a", "b", "code_x", "code_y")
    )


@query("pair_cooccurrence", SQL_PAIRS + """
    SELECT code_a, code_b, count(*) AS n, CAST(sum(died) AS BIGINT) AS events FROM pairs GROUP BY code_a, code_b""")
def _(spark, folder):
    ranked, masks = code_pairs(spark, folder)
    return named(pairs.pair_counts(masks, TOP, "died"), ranked).select("code_a", "code_b", "n", "events")


@query("collect_ids", SQL_PAIRS + """
    SELECT code_a, code_b, user_id // 1000 AS slice, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS ids
    FROM pairs WHERE (code_a, code_b) IN (SELECT (code_a, code_b) FROM pairs GROUP BY ALL HAVING count(*) >= 10) GROUP BY ALL""")
def _(spark, folder):
    ranked, masks = code_pairs(spark, folder)
    frequent = pairs.pair_counts(masks, TOP, "died").filter(F.col("n") >= 10).select("a", "b")
    lists = pairs.bounded_lists(pairs.stays_with_pairs(masks, frequent, "user_id", TOP), ["a", "b"], "user_id")
    return named(lists, ranked).select("code_a", "code_b", "slice", F.concat_ws(",", "user_ids").alias("ids"))


@query("explode_ids", SQL_PAIRS + """
    SELECT user_id, count(*) AS pairs FROM pairs WHERE (code_a, code_b) IN (
        SELECT (code_a, code_b) FROM pairs GROUP BY ALL HAVING count(*) >= 10) GROUP BY user_id""")
def _(spark, folder):
    _, masks = code_pairs(spark, folder)
    frequent = pairs.pair_counts(masks, TOP, "died").filter(F.col("n") >= 10).select("a", "b")
    lists = pairs.bounded_lists(pairs.stays_with_pairs(masks, frequent, "user_id", TOP), ["a", "b"], "user_id")
    return lists.select(F.explode("user_ids").alias("user_id")).groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"))


@query("first_row_join", """
    SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o
    ON o_custkey = c_custkey AND rn = 1""")
def _(spark, folder):
    orders = scan(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    first = first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return scan(spark, folder, "customer", "c_custkey", "c_mktsegment").join(
        first, F.col("c_custkey") == F.col("o_custkey"), "left"
    ).select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice")


@query("composite_key_join", """
    SELECT user_id, CAST(d AS VARCHAR) AS day, a.n AS events, b.n AS large
    FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY ALL) a
    JOIN (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE value > 100 GROUP BY ALL) b USING (user_id, d)""")
def _(spark, folder):
    daily = scan(spark, folder, "events", "user_id", "ts", "value").withColumn("day", F.to_date("ts").cast("string"))

    def count(df, name):
        return df.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias(name))
    return count(daily, "events").join(count(daily.filter(F.col("value") > 100), "large"), ["user_id", "day"])


@query("semi_join_ids", """
    SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)
    AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def _(spark, folder):
    orders = scan(spark, folder, "orders", "o_custkey", "o_orderstatus", "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    large = orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)).select("c_custkey")
    both = large.intersect(orders.filter(F.col("o_orderstatus") == "O").select("c_custkey"))
    return scan(spark, folder, "customer", "c_custkey", "c_name").join(both, "c_custkey", "left_semi")
