"""Keys of scalar functions, ladders, encoders and class probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from icuflow.catalog.basics import SQL_K, events_with_k
from icuflow.catalog.clinical_sql import with_views
from icuflow.catalog.joins import SQL_PAIRS, TOP, code_pairs
from icuflow.catalog.registry import query
from icuflow.catalog.score_sql import SCORES, driver, graded, summed
from icuflow.functions import ladder, values as val
from icuflow.operators import pairs
from icuflow.operators.tables import binary_encode, category_codes, fit_categories
from icuflow.plans import features, scores
from icuflow.plans.diagnoses import pair_rates
from icuflow.plans.echo import NUMBER_PATTERNS, echo_notes
from icuflow.rules import diagnoses as dx
from icuflow.rules import items as it
from icuflow.rules import scores as sc
from icuflow.sources.clinical import clinical_views
from icuflow.sources.tables import scan



def aged_orders(spark, folder):
    """Orders with a birth date derived from the customer."""
    return scan(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn(
        "dob", F.date_add(F.lit("1910-01-01").cast("date"), ((F.col("o_custkey") * 211) % 32500).cast("int"))
    )


SQL_AGED = "(SELECT *, DATE '1910-01-01' + CAST((o_custkey * 211) % 32500 AS INTEGER) AS dob FROM orders)"
SQL_YEARS = "(year(o_orderdate) - year(dob))"
SQL_AGE = "(CAST(o_orderdate AS DATE) - dob) / 365.242::DOUBLE"


@query("days_between", """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS INTEGER) AS days
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def _(spark, folder):
    lines = scan(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = scan(spark, folder, "orders", "o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days")
    )


@query("age_year_boundary", f"SELECT o_orderkey, CAST({SQL_YEARS} AS INTEGER) AS age FROM {SQL_AGED}")
def _(spark, folder):
    return aged_orders(spark, folder).select("o_orderkey", val.years_by_boundary(F.col("o_orderdate"), F.col("dob")).alias("age"))


@query("age_fractional", f"SELECT o_orderkey, round({SQL_AGE}, 2) AS age, CAST(floor({SQL_AGE}) AS BIGINT) AS whole FROM {SQL_AGED}")
def _(spark, folder):
    age = val.years_fractional(F.col("o_orderdate"), F.col("dob"))
    return aged_orders(spark, folder).select("o_orderkey", F.round(age, 2).alias("age"), F.floor(age).alias("whole"))


@query("age_bands", f"""
    SELECT o_orderkey, CASE WHEN {SQL_YEARS} > 89 THEN '>89' WHEN {SQL_YEARS} > 64 THEN '65-89' WHEN {SQL_YEARS} > 39 THEN '40-64'
           WHEN {SQL_YEARS} > 14 THEN '15-39' WHEN {SQL_YEARS} > 1 THEN '1-14' ELSE 'neonate' END AS band,
           CASE WHEN {SQL_AGE} > 15 THEN 'adult' WHEN {SQL_AGE} > 1 THEN 'middle' ELSE 'neonate' END AS grouped FROM {SQL_AGED}""")
def _(spark, folder):
    years = val.years_by_boundary(F.col("o_orderdate"), F.col("dob"))
    age = val.years_fractional(F.col("o_orderdate"), F.col("dob"))
    return aged_orders(spark, folder).select(
        "o_orderkey", val.banded(years, dx.AGE_BANDS, dx.AGE_BAND_ABOVE).alias("band"),
        val.banded(age, dx.OASIS_AGE_BANDS, dx.OASIS_AGE_ABOVE).alias("grouped"),
    )


@query("date_shift", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 7 - 3 AS INTEGER) AS VARCHAR) AS day FROM orders")
def _(spark, folder):
    return scan(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        "o_orderkey", F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 7 - 3).cast("int")).cast("string").alias("day")
    )


@query("hours_between", """
    SELECT event_id, date_sub('hour', TIMESTAMP '2024-01-01 00:30:00', date_trunc('second', ts)) AS whole,
           round((epoch_us(ts) // 1000000 - epoch_us(TIMESTAMP '2024-01-01 00:30:00') // 1000000) / 3600::DOUBLE, 8) AS hours FROM events""")
def _(spark, folder):
    start = F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    return scan(spark, folder, "events", "event_id", "ts").select(
        "event_id", val.whole_hours(F.col("ts"), start).alias("whole"), F.round(val.hours(F.col("ts"), start), 8).alias("hours")
    )


@query("logistic_prob", """
    SELECT o_orderkey, round(1 / (1 + exp(6.1746::DOUBLE - 0.1275::DOUBLE * s)), 8) AS oasis_prob,
           round(1 / (1 + exp(7.7631::DOUBLE - 0.0737::DOUBLE * s - 0.9971::DOUBLE * ln(s + 1))), 8) AS saps2_prob
    FROM (SELECT o_orderkey, o_orderkey % 120 AS s FROM orders)""")
def _(spark, folder):
    s = F.col("o_orderkey") % 120
    (a, b), (c, d, e) = sc.OASIS_LOGIT, sc.SAPS2_LOGIT
    return scan(spark, folder, "orders", "o_orderkey").select(
        "o_orderkey", F.round(ladder.logistic(a + b * s), 8).alias("oasis_prob"),
        F.round(ladder.logistic(c + d * s + e * F.log(s + 1)), 8).alias("saps2_prob"),
    )


SQL_TERMS = " ".join(
    f"+ CASE WHEN {SQL_K} % {i + 2} = 0 THEN {w!r}::DOUBLE * {m!r}::DOUBLE + {a!r}::DOUBLE ELSE {w!r}::DOUBLE * value END"
    for i, (w, m, a) in enumerate(it.SPECIMEN_TERMS.values()))


@query("imputed_logit", f"""
    SELECT event_id, round(1 / (1 + exp(-({it.SPECIMEN_INTERCEPT!r}::DOUBLE + {it.SPECIMEN_PO2_WEIGHT!r}::DOUBLE * value {SQL_TERMS}))), 8) AS prob FROM events""")
def _(spark, folder):
    rows = events_with_k(spark, folder, "event_id", "value").select("event_id", F.col("value").alias("po2"), *[
        F.when(F.col("k") % (i + 2) != 0, F.col("value")).alias(t) for i, t in enumerate(it.SPECIMEN_TERMS)
    ])
    return rows.select("event_id", F.round(features.specimen_probability(), 8).alias("prob"))


@query("ratio_derived", f"""
    SELECT event_id, round(100 * value / nullif(f, 0), 8) AS ratio, round(f / 100 * 713 - {SQL_K} / 0.8::DOUBLE - value, 8) AS gradient
    FROM (SELECT *, CASE WHEN {SQL_K} >= 21 THEN {SQL_K}::DOUBLE END AS f FROM events)""")
def _(spark, folder):
    f = F.when(F.col("k") >= 21, F.col("k").cast("double"))
    pressure = it.AIR_PRESSURE - it.WATER_PRESSURE
    return events_with_k(spark, folder, "event_id", "value").select(
        "event_id", F.round(F.try_divide(100 * F.col("value"), f), 8).alias("ratio"),
        F.round(f / 100 * pressure - F.col("k") / it.RESPIRATORY_QUOTIENT - F.col("value"), 8).alias("gradient"),
    )


@query("coalesce_pick", """
    SELECT user_id, coalesce(max(value) FILTER (event_type = 'view' AND value > 150), max(value) FILTER (event_type = 'click' AND value > 150),
                             max(value)) AS best FROM events GROUP BY user_id""")
def _(spark, folder):
    t, v = F.col("event_type"), F.col("value")
    best = [F.max(F.when((t == name) & (v > 150), v)) for name in ("view", "click")]
    return scan(spark, folder, "events", "user_id", "event_type", "value").groupBy("user_id").agg(F.coalesce(*best, F.max(v)).alias("best"))


# measures for the ladders: smallest and largest reading per user, scaled into the range of each measure
LADDER_MEASURES = {"click": ("heartrate", 40.0, 0.5), "view": ("meanbp", 15.0, 0.5), "error": ("tempc", 33.0, 0.03), "purchase": ("resprate", 5.0, 0.2)}
LADDER_PARTS = ["heartrate_score", "meanbp_score", "resprate_score", "temp_score"]
SQL_LADDER = "(SELECT user_id, " + ", ".join(
    f"{b!r}::DOUBLE + {s!r}::DOUBLE * {f}(value) FILTER (event_type = '{t}' AND value > 3) AS {m}_{f}"
    for t, (m, b, s) in LADDER_MEASURES.items() for f in ("min", "max")) + " FROM events GROUP BY user_id)"


def ladder_measures(spark, folder):
    t, v = F.col("event_type"), F.col("value")
    return scan(spark, folder, "events", "user_id", "event_type", "value").groupBy("user_id").agg(*[
        (b + s * fn(F.when((t == name) & (v > 3), v))).alias(f"{m}_{stat}")
        for name, (m, b, s) in LADDER_MEASURES.items() for stat, fn in (("min", F.min), ("max", F.max))
    ])


@query("score_ladder", "SELECT user_id, " + ", ".join(
    f"CAST({p} AS DOUBLE) AS {p}" for p in LADDER_PARTS) + " FROM (SELECT user_id, " + ", ".join(
    graded(p, sc.OASIS[p]) for p in LADDER_PARTS) + f" FROM {SQL_LADDER})")
def _(spark, folder):
    return ladder_measures(spark, folder).select("user_id", *[ladder.points(sc.OASIS[p]).cast("double").alias(p) for p in LADDER_PARTS])


@query("score_total", "SELECT user_id, " + summed(LADDER_PARTS) + " AS total FROM (SELECT user_id, " + ", ".join(
    graded(p, sc.OASIS[p]) for p in LADDER_PARTS) + f" FROM {SQL_LADDER})")
def _(spark, folder):
    graded_rows = ladder_measures(spark, folder).select("user_id", *[ladder.points(sc.OASIS[p]).alias(p) for p in LADDER_PARTS])
    return graded_rows.select("user_id", ladder.total(LADDER_PARTS).alias("total"))


@query("score_driver_value", "SELECT user_id, " + ", ".join(f"round({n}, 8) AS {n}" for n in sc.OASIS_DRIVERS) + " FROM (SELECT user_id, " + ", ".join(
    driver(n, sc.OASIS[p]) for n, p in sc.OASIS_DRIVERS.items()) + f" FROM {SQL_LADDER})")
def _(spark, folder):
    return ladder_measures(spark, folder).select("user_id", *[
        F.round(ladder.deciding_value(sc.OASIS[p]), 8).alias(n) for n, p in sc.OASIS_DRIVERS.items()
    ])


@query("expire_flag", with_views("""
    SELECT icustay_id, CASE WHEN deathtime <= outtime THEN 1 WHEN dischtime <= outtime AND discharge_location = 'DEAD/EXPIRED' THEN 1 ELSE 0 END AS died
    FROM persons""", "persons", extra=SCORES))
def _(spark, folder):
    v = clinical_views(spark, folder)
    return v["icustays"].join(v["admissions"], "hadm_id").select("icustay_id", scores.expire_flag().alias("died"))


@query("admission_class", with_views("""
    SELECT icustay_id, CASE WHEN first_surgical AND admission_type = 'ELECTIVE' THEN 'ScheduledSurgical'
                            WHEN first_surgical AND admission_type IS NOT NULL THEN 'UnscheduledSurgical' ELSE 'Medical' END AS class,
           CAST(CASE WHEN admission_type IS NULL THEN NULL WHEN admission_type = 'ELECTIVE' AND any_surgical THEN 1 ELSE 0 END AS DOUBLE) AS elective
    FROM icustays JOIN admissions USING (hadm_id)
    JOIN (SELECT hadm_id, first(coalesce(contains(lower(curr_service), 'surg'), FALSE) ORDER BY transfertime, curr_service NULLS FIRST) AS first_surgical
          FROM services GROUP BY hadm_id) USING (hadm_id)
    JOIN (SELECT i.icustay_id, coalesce(bool_or(contains(lower(curr_service), 'surg') OR curr_service = 'ORTHO'), FALSE) AS any_surgical
          FROM icustays i LEFT JOIN services s ON s.hadm_id = i.hadm_id AND s.transfertime < i.intime + INTERVAL 1 DAY GROUP BY ALL) USING (icustay_id)
    """, "icustays", "admissions", "services"))
def _(spark, folder):
    v = clinical_views(spark, folder)
    persons = v["icustays"].select("icustay_id", "hadm_id").join(v["admissions"].select("hadm_id", "admission_type"), "hadm_id")
    classes = persons.join(scores.first_service(v), "hadm_id", "left").select("icustay_id", scores.admission_class().alias("class"))
    elective = persons.join(scores.surgical_by_stay(v), "icustay_id").select(
        "icustay_id", scores.elective_surgery().cast("double").alias("elective")
    )
    return classes.join(elective, "icustay_id")


@query("note_regex_extract", with_views(
    "SELECT row_id, indication, status, bp, " + ", ".join(NUMBER_PATTERNS) + " FROM echo_notes", "echo_notes", extra=SCORES))
def _(spark, folder):
    return echo_notes(clinical_views(spark, folder)["noteevents"]).select("row_id", "indication", "status", "bp", *NUMBER_PATTERNS)


@query("note_timestamp", with_views("SELECT row_id, CAST(charttime AS VARCHAR) AS charttime FROM echo_notes", "echo_notes", extra=SCORES))
def _(spark, folder):
    return echo_notes(clinical_views(spark, folder)["noteevents"]).select("row_id", F.col("charttime").cast("string").alias("charttime"))


SQL_CHAPTERS = "(VALUES " + ", ".join(f"({a}, {b}, '{t}')" for a, b, t in dx.CHAPTERS) + ") AS c(lo, hi, label)"


@query("code_chapter_bucket", f"""
    SELECT p_partkey, coalesce(label, 'Other') AS chapter FROM part LEFT JOIN {SQL_CHAPTERS} ON p_partkey % 1000 > lo AND p_partkey % 1000 < hi""")
def _(spark, folder):
    return scan(spark, folder, "part", "p_partkey").select("p_partkey", val.chapter(F.col("p_partkey") % 1000).alias("chapter"))


@query("rate_bins", """
    SELECT l_partkey, CASE WHEN r < 0.5 THEN 0 WHEN r < 0.7 THEN 1 ELSE 2 END AS single,
           CAST(CASE WHEN r >= 0.9 THEN 2 WHEN r >= 0.5 THEN 1 END AS DOUBLE) AS pair
    FROM (SELECT l_partkey, count(*) FILTER (l_returnflag <> 'N') / count(*)::DOUBLE AS r FROM lineitem GROUP BY l_partkey)""")
def _(spark, folder):
    rates = scan(spark, folder, "lineitem", "l_partkey", "l_returnflag").groupBy("l_partkey").agg(
        F.avg(val.flag(F.col("l_returnflag") != "N")).alias("rate")
    )
    return rates.select("l_partkey", val.rate_bin(F.col("rate"), dx.SINGLE_BINS, 0).alias("single"),
                        val.rate_bin(F.col("rate"), dx.PAIR_BINS).cast("double").alias("pair"))


@query("one_hot", """
    SELECT o_orderkey, (p = '2-HIGH')::INTEGER AS "prio_2-HIGH", (p = '3-MEDIUM')::INTEGER AS "prio_3-MEDIUM",
           (p = '4-NOT SPECIFIED')::INTEGER AS "prio_4-NOT SPECIFIED", (p = '5-LOW')::INTEGER AS "prio_5-LOW"
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS p FROM orders)""")
def _(spark, folder):
    orders = scan(spark, folder, "orders", "o_orderkey", "o_orderpriority").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("p")
    )
    return orders.select("o_orderkey", *val.one_hot(F.col("p"), fit_categories(orders, "p"), "prio_"))


@query("binary_encode", """
    WITH c AS (SELECT b, row_number() OVER (ORDER BY b) AS o FROM (SELECT DISTINCT p_brand AS b FROM part))
    SELECT p_partkey, """ + ", ".join(f"CAST((o >> {4 - i}) & 1 AS INTEGER) AS brand_{i}" for i in range(5)) + " FROM part JOIN c ON b = p_brand")
def _(spark, folder):
    parts = scan(spark, folder, "part", "p_partkey", "p_brand")
    return binary_encode(parts, category_codes(parts, "p_brand"), "p_brand", "brand").drop("p_brand")


@query("reverse_one_hot", """
    SELECT event_id, CASE event_type WHEN 'click' THEN 'CSRU' WHEN 'view' THEN 'MICU' WHEN 'error' THEN 'SICU' ELSE 'Other' END AS unit FROM events""")
def _(spark, folder):
    t = F.col("event_type")
    flags = {"CSRU": val.flag(t == "click"), "MICU": val.flag(t == "view"), "SICU": val.flag(t == "error")}
    return scan(spark, folder, "events", "event_id", "event_type").select("event_id", val.first_set_flag(flags, "Other").alias("unit"))


@query("caretime_ratio", """
    SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
           round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0)::DOUBLE, 8) AS ratio FROM events GROUP BY ALL""")
def _(spark, folder):
    t = F.col("event_type")
    return scan(spark, folder, "events", "user_id", "event_type", "ts").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(
        F.round(F.try_divide(F.count_if(t == "click"), F.count_if(t == "view")), 8).alias("ratio")
    )


@query("cap_age", f"SELECT o_orderkey, CAST(least(CASE WHEN {SQL_YEARS} > 89 THEN 90 ELSE {SQL_YEARS} END, 90) AS INTEGER) AS age FROM {SQL_AGED}")
def _(spark, folder):
    age = val.years_by_boundary(F.col("o_orderdate"), F.col("dob"))
    return aged_orders(spark, folder).select("o_orderkey", F.when(age > 89, 90).otherwise(age).alias("age"))


SQL_PROBS = """(SELECT event_id, a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM (
    SELECT event_id, 1 + event_id % 7 AS a, 1 + event_id % 5 AS b, 1 + event_id % 11 AS c FROM events))"""


def three_probs(spark, folder):
    e = F.col("event_id")
    a, b, c = 1 + e % 7, 1 + e % 5, 1 + e % 11
    return scan(spark, folder, "events", "event_id").select("event_id", *[(x / (a + b + c)).alias(f"p{i}") for i, x in enumerate((a, b, c))])


@query("prior_reweight", f"""
    SELECT event_id, round(p1 * 0.2::DOUBLE / (p1 * 0.2::DOUBLE + (1 - p1) * 1.8::DOUBLE), 8) AS w,
           round(p0 * 2.4::DOUBLE / t, 8) AS w0, round(p1 * 0.15::DOUBLE / t, 8) AS w1, round(p2 * 0.45::DOUBLE / t, 8) AS w2
    FROM (SELECT *, p0 * 2.4::DOUBLE + p1 * 0.15::DOUBLE + p2 * 0.45::DOUBLE AS t FROM {SQL_PROBS})""")
def _(spark, folder):
    p = [F.col(f"p{i}") for i in range(3)]
    w = val.reweight_classes(p, [0.8, 0.05, 0.15], [1 / 3] * 3)
    return three_probs(spark, folder).select(
        "event_id", F.round(val.reweight(p[1], 0.1, 0.5), 8).alias("w"), *[F.round(x, 8).alias(f"w{i}") for i, x in enumerate(w)]
    )


@query("argmax_class", f"""
    SELECT event_id, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS best,
           CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 OR p2 <= 10 * p1 THEN 1 ELSE 2 END AS careful,
           CASE event_id % 3 - 1 WHEN -1 THEN 2 ELSE event_id % 3 - 1 END AS recoded FROM {SQL_PROBS}""")
def _(spark, folder):
    p = [F.col(f"p{i}") for i in range(3)]
    y = F.col("event_id") % 3 - 1
    return three_probs(spark, folder).select(
        "event_id", val.argmax_class(p).alias("best"), val.cautious_class(p).alias("careful"),
        F.when(y == -1, 2).otherwise(y).alias("recoded"),
    )


@query("parse_datetime", """
    SELECT event_id, CAST(try_strptime(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d') END, '%Y-%m-%d') AS VARCHAR) AS parsed FROM events""")
def _(spark, folder):
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
    return scan(spark, folder, "events", "event_id", "ts").select("event_id", val.parse_time(text, "yyyy-MM-dd").cast("string").alias("parsed"))


@query("lift_over_single", SQL_PAIRS + """,
    s AS (SELECT code, sum(died) / count(*)::DOUBLE AS r FROM top GROUP BY code),
    p AS (SELECT code_a, code_b, sum(died) / count(*)::DOUBLE AS r FROM pairs GROUP BY ALL HAVING count(*) >= 10)
    SELECT code_a, code_b, round(p.r, 8) AS rate, CASE WHEN p.r > x.r + 0.15 OR p.r > y.r + 0.15 THEN 1 ELSE 0 END AS lifted
    FROM p JOIN s x ON x.code = code_a JOIN s y ON y.code = code_b""")
def _(spark, folder):
    ranked, masks = code_pairs(spark, folder)
    table = pair_rates(pairs.pair_counts(masks, TOP, "died"), ranked, "code", 10)
    lifted = (F.col("rate") > F.col("rate_a") + 0.15) | (F.col("rate") > F.col("rate_b") + 0.15)
    return table.select(
        F.least("code_a", "code_b").alias("code_a"), F.greatest("code_a", "code_b").alias("code_b"),
        F.round("rate", 8).alias("rate"), val.flag(lifted).alias("lifted"),
    )


