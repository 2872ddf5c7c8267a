"""Keys of sampling, preparation and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from icuflow.catalog.basics import SQL_K, events_with_k
from icuflow.catalog.clinical_sql import with_views
from icuflow.catalog.registry import query
from icuflow.functions.values import flag, hashed_uniform
from icuflow.operators import metrics, prepare, sampling
from icuflow.sources.clinical import clinical_views
from icuflow.sources.tables import scan, stage



def sql_draw(purpose: str, key: str) -> str:
    """SQL of a repeatable draw in [0, 1)."""
    return f"(CAST('0x' || substr(md5('{purpose}|' || {key}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


SQL_U = sql_draw("draw", "event_id")
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def draws(spark, folder):
    """One draw per event: a uniform number, a band, an age and a segment."""
    e = F.col("event_id")
    segment = F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (e % 5 + 1).cast("int"))
    return events_with_k(spark, folder, "event_id").select(
        "event_id", hashed_uniform(e, "draw").alias("u"), (e % 4).alias("band"), segment.alias("segment"), "k"
    )


SQL_SEGMENT = "([" + ", ".join(f"'{s}'" for s in SEGMENTS) + "])[CAST(event_id % 5 AS INTEGER) + 1]"


@query("inverse_cdf_sample", f"""
    WITH c AS (SELECT user_id % 4 AS band, event_type, count(*) AS n FROM events GROUP BY ALL),
    f AS (SELECT band, event_type, sum(n) OVER (PARTITION BY band ORDER BY event_type) / sum(n) OVER (PARTITION BY band)::DOUBLE AS p FROM c)
    SELECT event_id, min(event_type) AS drawn FROM (SELECT event_id, event_id % 4 AS band, {SQL_U} AS u FROM events) d
    JOIN f ON f.band = d.band AND p > u GROUP BY event_id""")
def _(spark, folder):
    observed = scan(spark, folder, "events", "user_id", "event_type").select((F.col("user_id") % 4).alias("band"), F.col("event_type").alias("drawn"))
    return sampling.draw_categories(draws(spark, folder), observed, ["band"], "u", "drawn").select("event_id", "drawn")


SQL_AGES = "SELECT least(15 + (c_custkey * 7) % 80, 90) AS age, * FROM customer"


def ages(spark, folder):
    return scan(spark, folder, "customer").withColumn("age", F.least(15 + (F.col("c_custkey") * 7) % 80, F.lit(90)))


@query("inverse_cdf_numeric", f"""
    WITH f AS (SELECT age, sum(count(*)) OVER (ORDER BY age) / sum(count(*)) OVER ()::DOUBLE AS p FROM ({SQL_AGES}) GROUP BY age)
    SELECT event_id, min(age) AS age FROM (SELECT event_id, {SQL_U} AS u FROM events) JOIN f ON p >= u GROUP BY event_id""")
def _(spark, folder):
    return sampling.draw_numbers(draws(spark, folder), ages(spark, folder), "u", "age").select("event_id", "age")


@query("bernoulli_conditional", f"""
    SELECT event_id, CAST({SQL_U} < p AS INTEGER) AS gender_m FROM events
    JOIN (SELECT c_mktsegment, avg((c_acctbal > 5000)::INTEGER) AS p FROM customer GROUP BY c_mktsegment) ON c_mktsegment = {SQL_SEGMENT}""")
def _(spark, folder):
    observed = scan(spark, folder, "customer", "c_mktsegment", "c_acctbal").withColumnRenamed("c_mktsegment", "segment")
    return sampling.bernoulli(draws(spark, folder), observed, "segment", flag(F.col("c_acctbal") > 5000), "u", "event_id", "gender_m").select(
        "event_id", "gender_m"
    )


@query("matched_donor", f"""
    WITH d AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, row_number() OVER w AS place, count(*) OVER g AS n, avg(c_acctbal) OVER g AS mean
               FROM customer WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey ORDER BY {sql_draw("donor", "c_custkey")}, c_custkey),
                                    g AS (PARTITION BY c_mktsegment, c_nationkey))
    SELECT e.event_id, CASE WHEN n IS NULL THEN 'none' WHEN n >= 10 THEN 'donor' ELSE 'mean' END AS matched,
           CAST(CASE WHEN n >= 10 THEN c_custkey END AS DOUBLE) AS donor, round(CASE WHEN n >= 10 THEN c_acctbal ELSE mean END, 6) AS c_acctbal
    FROM events e LEFT JOIN d ON c_mktsegment = {SQL_SEGMENT} AND c_nationkey = {SQL_K} % 28
     AND place = CASE WHEN n >= 10 THEN floor({SQL_U} * n) + 1 ELSE 1 END""")
def _(spark, folder):
    wanted = draws(spark, folder).withColumn("nation", F.col("k") % 28).select("event_id", "u", "segment", "nation")
    donors = scan(spark, folder, "customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal").withColumnsRenamed(
        {"c_mktsegment": "segment", "c_nationkey": "nation"}
    )
    out = sampling.matched_donor(wanted, donors, ["segment", "nation"], "u", "event_id", "c_custkey", ["c_acctbal"])
    return out.select("event_id", "matched", F.col("c_custkey").cast("double").alias("donor"), F.round("c_acctbal", 6).alias("c_acctbal"))


def age_group(age):
    return F.when(age > 89, 3).when(age >= 65, 2).when(age >= 40, 1).otherwise(0)


SQL_BAND = "CASE WHEN {0} > 89 THEN 3 WHEN {0} >= 65 THEN 2 WHEN {0} >= 40 THEN 1 ELSE 0 END"


@query("widened_cohort_std", f"""
    WITH d AS (SELECT *, {SQL_BAND.format('age')} AS band FROM ({SQL_AGES})), w AS (SELECT DISTINCT {SQL_SEGMENT} AS segment, {SQL_K} AS age FROM events)
    SELECT segment, w.age, round(avg(c_acctbal) FILTER (d.band = {SQL_BAND.format('w.age')}), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std
    FROM w JOIN d ON c_mktsegment = segment AND (d.band = {SQL_BAND.format('w.age')} OR d.band = {SQL_BAND.format('(w.age + 25)')} OR d.band = {SQL_BAND.format('(w.age - 25)')})
    GROUP BY ALL""")
def _(spark, folder):
    wanted = draws(spark, folder).select("segment", F.col("k").alias("age"))
    donors = ages(spark, folder).withColumnRenamed("c_mktsegment", "segment")
    return sampling.widened_std(wanted, donors, ["segment"], "age", age_group, "c_acctbal").withColumns(
        {"mean": F.round("mean", 4), "std": F.round("std", 4)}
    )


SQL_NORMAL = f"sqrt(-2 * ln(1 - {sql_draw('noise1|c_acctbal', 'event_id')})) * cos(2 * pi() * {sql_draw('noise2|c_acctbal', 'event_id')})"


@query("matched_donor_noise", f"""
    WITH c AS (SELECT *, {SQL_BAND.format('age')} AS band FROM ({SQL_AGES})),
    d AS (SELECT c_custkey, c_mktsegment, c_nationkey, band, c_acctbal, row_number() OVER w AS place, count(*) OVER g AS n, avg(c_acctbal) OVER g AS mean
          FROM c WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey, band ORDER BY {sql_draw("donor", "c_custkey")}, c_custkey),
                        g AS (PARTITION BY c_mktsegment, c_nationkey, band)),
    e AS (SELECT event_id, {SQL_SEGMENT} AS segment, event_id % 28 AS nation, {SQL_K} AS age, {SQL_BAND.format(SQL_K)} AS band, {SQL_U} AS u, {SQL_NORMAL} AS z FROM events),
    s AS (SELECT segment, nation, w.age, stddev_samp(c_acctbal) AS std FROM (SELECT DISTINCT segment, nation, age FROM e) w JOIN c ON c_mktsegment = segment AND c_nationkey = nation
          AND (c.band = {SQL_BAND.format('w.age')} OR c.band = {SQL_BAND.format('(w.age + 25)')} OR c.band = {SQL_BAND.format('(w.age - 25)')}) GROUP BY ALL)
    SELECT e.event_id, CASE WHEN n IS NULL THEN 'none' WHEN n >= 10 THEN 'donor' ELSE 'mean' END AS matched,
           round(CASE WHEN n >= 10 THEN c_acctbal ELSE mean + coalesce(std * z, 0) END, 4) AS c_acctbal
    FROM e LEFT JOIN d ON c_mktsegment = e.segment AND c_nationkey = e.nation AND d.band = e.band AND place = CASE WHEN n >= 10 THEN floor(u * n) + 1 ELSE 1 END
    LEFT JOIN s ON s.segment = e.segment AND s.nation = e.nation AND s.age = e.age""")
def _(spark, folder):
    """Small cohorts: a normal draw around their mean with the deviation of the cohort widened by age."""
    wanted = draws(spark, folder).select(
        "event_id", "u", "segment", (F.col("event_id") % 28).alias("nation"), F.col("k").alias("age"), age_group(F.col("k")).alias("band"))
    donors = ages(spark, folder).select(
        "c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), "age", age_group(F.col("age")).alias("band"), "c_acctbal")
    found = sampling.matched_donor(wanted, donors, ["segment", "nation", "band"], "u", "event_id", "c_custkey", ["c_acctbal"])
    spread = sampling.widened_std(wanted, donors, ["segment", "nation"], "age", age_group, "c_acctbal")
    out = sampling.with_noise(found, spread, ["segment", "nation", "age"], "event_id", "c_acctbal")
    return out.select("event_id", "matched", F.round("c_acctbal", 4).alias("c_acctbal"))


@query("kde_grid", with_views("""
    SELECT x::DOUBLE AS x, round(avg(exp(-pow((x - round(los)) / 0.6::DOUBLE, 2) / 2)) / (0.6::DOUBLE * sqrt(2 * pi())), 8) AS density
    FROM icustays, (SELECT unnest(range(0, 51)) AS x) GROUP BY x""", "icustays"))
def _(spark, folder):
    stays = clinical_views(spark, folder)["icustays"].select(F.round("los").alias("los"))
    return sampling.kde(stays, "los", range(51), 0.6).withColumn("density", F.round("density", 8))


@query("train_test_split", f"SELECT vec_id, CASE WHEN {sql_draw('split', 'vec_id')} < 0.25 THEN 'test' ELSE 'train' END AS side FROM embeddings")
def _(spark, folder):
    return scan(spark, folder, "embeddings", "vec_id").select("vec_id", prepare.split_name("vec_id", 0.25).alias("side"))


@query("undersample", f"""
    WITH r AS (SELECT vec_id, label % 3 AS y, row_number() OVER (PARTITION BY label % 3 ORDER BY {sql_draw('balance', 'vec_id')}, vec_id) AS place FROM embeddings)
    SELECT vec_id, y FROM r WHERE place <= (SELECT min(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label % 3))""")
def _(spark, folder):
    rows = scan(spark, folder, "embeddings", "vec_id", "label").select("vec_id", (F.col("label") % 3).alias("y"))
    return prepare.undersample(rows, "y", "vec_id")


SCALED = [f"x{i}" for i in range(64)]


@query("standard_scale", "WITH v AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(64)) + f""",
    {sql_draw('split', 'vec_id')} >= 0.25 AS train FROM embeddings)
    SELECT vec_id, """ + ", ".join(f"round((x{i} - m{i}) / s{i}, 6) AS x{i}" for i in range(64)) + " FROM v, (SELECT " + ", ".join(
    f"avg(x{i}) AS m{i}, stddev_pop(x{i}) AS s{i}" for i in range(64)) + " FROM v WHERE train)")
def _(spark, folder):
    rows = scan(spark, folder, "embeddings", "vec_id", "embedding").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)]
    )
    train = rows.filter(prepare.split_name("vec_id") == "train")
    return prepare.scale(train, SCALED, rows)[0].select("vec_id", *[F.round(c, 6).alias(c) for c in SCALED])


@query("confusion_metrics", """
    SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tn, count(*) FILTER (quality = 0 AND toxic = 0) AS fp,
           count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 1 AND toxic = 0) AS tp,
           round(avg((quality = 1 - toxic)::INTEGER), 8) AS accuracy,
           round(ifnull(avg((toxic = 0)::INTEGER) FILTER (quality = 1), 0), 8) AS recall,
           round(ifnull(avg(quality) FILTER (toxic = 0), 0), 8) AS precision FROM labels""")
def _(spark, folder):
    out = metrics.confusion(scan(spark, folder, "labels", "quality", "toxic"), F.col("quality"), 1 - F.col("toxic"))
    return out.withColumns({c: F.round(c, 8) for c in ("accuracy", "recall", "precision")})


SQL_SCORED = """(SELECT quality AS y, (2 * ((l.doc_id * 7919) % 101) / 101.0::DOUBLE + quality) / 3 AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def scored(spark, folder):
    labels = scan(spark, folder, "labels", "doc_id", "quality")
    rows = labels.join(scan(spark, folder, "documents", "doc_id"), "doc_id")
    u = 2 * ((F.col("doc_id") * 7919) % 101) / F.lit(101.0)
    return rows.select(F.col("quality").alias("y"), ((u + F.col("quality")) / 3).alias("s"))


@query("roc_auc", f"""
    WITH r AS {SQL_SCORED}, p AS (SELECT s, sum(sum(y)) OVER (ORDER BY s DESC) / sum(sum(y)) OVER () AS tpr,
                                        sum(sum(1 - y)) OVER (ORDER BY s DESC) / sum(sum(1 - y)) OVER () AS fpr FROM r GROUP BY s)
    SELECT 'point' AS part, round(s, 8) AS score, round(fpr, 8) AS x, round(tpr, 8) AS y FROM p UNION ALL
    SELECT 'area', NULL, NULL, round(avg(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0 END), 8)
    FROM r a JOIN r b ON a.y = 1 AND b.y = 0""")
def _(spark, folder):
    counts = metrics.threshold_counts(scored(spark, folder), "y", "s", stage)
    points = metrics.roc_points(counts, "s").select(
        F.lit("point").alias("part"), F.round("s", 8).alias("score"), F.round("fpr", 8).alias("x"), F.round("tpr", 8).alias("y")
    )
    none = F.lit(None).cast("double")
    return points.unionByName(metrics.roc_auc(counts).select(
        F.lit("area").alias("part"), none.alias("score"), none.alias("x"), F.round("auc", 8).alias("y")))


@query("pr_auc", f"""
    WITH r AS {SQL_SCORED}, p AS (SELECT s, sum(sum(y)) OVER (ORDER BY s DESC) AS tp, sum(count(*)) OVER (ORDER BY s DESC) AS k, sum(sum(y)) OVER () AS pos FROM r GROUP BY s),
    q AS (SELECT s, tp / pos AS recall, tp / k AS precision, lag(tp / pos, 1, 0) OVER (ORDER BY s DESC) AS r0, lag(tp / k, 1, 1) OVER (ORDER BY s DESC) AS p0 FROM p)
    SELECT 'point' AS part, round(s, 8) AS score, round(recall, 8) AS x, round(precision, 8) AS y FROM q UNION ALL
    SELECT 'area', NULL, NULL, round(sum((recall - r0) * (precision + p0) / 2), 8) FROM q""")
def _(spark, folder):
    counts = metrics.threshold_counts(scored(spark, folder), "y", "s", stage)
    points = metrics.pr_points(counts, "s").select(
        F.lit("point").alias("part"), F.round("s", 8).alias("score"), F.round("recall", 8).alias("x"), F.round("precision", 8).alias("y")
    )
    none = F.lit(None).cast("double")
    return points.unionByName(metrics.pr_auc(counts, "s").select(
        F.lit("area").alias("part"), none.alias("score"), none.alias("x"), F.round("pr_auc", 8).alias("y")))


@query("f1_threshold_sweep", f"""
    WITH r AS {SQL_SCORED}, f AS (SELECT t, coalesce(2 * sum((s > t AND y = 1)::INTEGER) / nullif(sum((s > t)::INTEGER) + sum(y), 0)::DOUBLE, 0) AS f1
        FROM r, (SELECT i * 0.05::DOUBLE AS t FROM range(0, 20) x(i)) GROUP BY t)
    SELECT round(t, 4) AS threshold, round(f1, 8) AS f1, CAST(row_number() OVER (ORDER BY f1 DESC, t) = 1 AS INTEGER) AS best FROM f""")
def _(spark, folder):
    return metrics.f1_sweep(scored(spark, folder), "y", "s", [i * 0.05 for i in range(20)]).select(
        F.round("threshold", 4).alias("threshold"), F.round("f1", 8).alias("f1"), "best"
    )


@query("avg_precision_weighted", """
    WITH r AS (SELECT label % 3 AS y, (label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 3 AS c FROM embeddings),
    a AS (SELECT k, count(*) FILTER (y = k) AS p, count(*) FILTER (c = k) AS called, count(*) FILTER (y = k AND c = k) AS t, count(*) AS n
          FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY k)
    SELECT round(sum(p * (t / p::DOUBLE * (t / called::DOUBLE) + (1 - t / p::DOUBLE) * p / n)) / any_value(n), 8) AS average_precision FROM a""")
def _(spark, folder):
    y = F.col("label")
    rows = scan(spark, folder, "embeddings", "vec_id", "label").select((y % 3).alias("y"), ((y + flag(F.col("vec_id") % 7 == 0)) % 3).alias("c"))
    return metrics.average_precision_weighted(rows, F.col("y"), F.col("c"), [0, 1, 2]).select(
        F.round("average_precision", 8).alias("average_precision")
    )
