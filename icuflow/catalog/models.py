"""Keys of imputation, classifiers, validation and the end-to-end models.

The statements of the tree ensembles grow the same trees in DuckDB (:mod:`icuflow.catalog.tree_sql`) and give every probability. What can't be grown
there is held to what its definition says: coefficients at their optimum, and probabilities worked out again from the fitted weights.
"""

from __future__ import annotations

import json
from itertools import product

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from icuflow.catalog.clinical_sql import with_views
from icuflow.catalog.extracts import CATEGORIES, DUMMIES, KNOWN, MIN_DEATHS, MIN_PAIRS, TOP, day_table
from icuflow.catalog.features import VITAL
from icuflow.catalog.registry import query
from icuflow.catalog.sampling import sql_draw
from icuflow.catalog.tree_sql import boosted_sql, forest_sql, table_sql
from icuflow.functions.values import flag, one_hot
from icuflow.learn import evaluate
from icuflow.learn.impute import RIDGE, fit_imputer
from icuflow.learn.models import MODELS, TREES, drawn_waves, ensemble, waves
from icuflow.learn.trees import Ensemble
from icuflow.operators import prepare
from icuflow.operators.metrics import roc_auc_by
from icuflow.plans import extracts, outcomes, scores
from icuflow.plans.diagnoses import diagnosis_features
from icuflow.plans.stay_days import SCORE_FEATURES
from icuflow.sources.clinical import clinical_views
from icuflow.sources.tables import scan, stage

SIZE = 64
NAMES = [f"x{i}" for i in range(SIZE)]
SPLIT = f"{sql_draw('split', 'vec_id')} < 0.25"
FOLD = f"CAST(floor({sql_draw('fold', 'vec_id')} * 5) AS INT)"
FOLDS = range(5)


def table(spark, folder, classes):
    """All embeddings as feature vectors, the label reduced to ``classes`` classes, staged once."""
    rows = scan(spark, folder, "embeddings", "vec_id", "embedding", "label").select(
        "vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
        (F.col("label") % classes).cast("int").alias("label"),
    )
    return stage(rows, "vectors")


def sides(df):
    side = prepare.split_name("vec_id")
    return df.filter(side == "train"), df.filter(side == "test")


def sql_rows(classes, learnt=f"NOT {SPLIT}", where="true"):
    """Rows for the statements that grow trees."""
    return table_sql(f"""SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, CAST(label % {classes} AS INT) AS y, {learnt} AS learnt,
      {FOLD} AS fold FROM embeddings WHERE {where}""")


def sql_probabilities(name, cells):
    """(e, id, p0, p1, ...) of a grown ensemble."""
    one = cells[0]
    p = range(one.classes)
    if one.kind != "boost":
        return f"SELECT e, id, {', '.join(f'sum(p{c} ORDER BY t) / {one.rounds} AS p{c}' for c in p)} FROM {name} WHERE p0 IS NOT NULL GROUP BY e, id"
    if one.outputs == 1:
        return f"SELECT e, id, 1 - 1 / (1 + exp(-m)) AS p0, 1 / (1 + exp(-m)) AS p1 FROM {name} WHERE r = {one.rounds}"
    ms = ", ".join(f"max(CASE WHEN k = {c} THEN m END) AS m{c}" for c in p)
    total = " + ".join(f"exp(m{c} - mx)" for c in p)
    return f"""SELECT e, id, {', '.join(f'exp(m{c} - mx) / ({total}) AS p{c}' for c in p)}
      FROM (SELECT *, greatest({', '.join(f'm{c}' for c in p)}) AS mx FROM (SELECT e, id, {ms} FROM {name} WHERE r = {one.rounds} GROUP BY e, id))"""


def sql_grown(name, cells, history=False):
    return forest_sql(name, cells) if cells[0].kind != "boost" else boosted_sql(name, cells, history)


def sql_predictions(model, *class_counts):
    """Rounded probabilities and the called class of the test rows."""
    parts = []
    for c in class_counts:
        cells = [ensemble(model, c, SIZE)]
        best = " ".join(f"WHEN p{k} = greatest({', '.join(f'p{j}' for j in range(c))}) THEN {k}" for k in range(c))
        parts.append(f"""SELECT * FROM (WITH RECURSIVE {sql_rows(c)}, {sql_grown('grown', cells)}
          SELECT {c} AS classes, p.id AS vec_id, t.y AS label, {', '.join(f'round(p{k}, 6) AS p{k}' if k < c else f'NULL::DOUBLE AS p{k}' for k in range(3))},
            CASE {best} END AS called
          FROM ({sql_probabilities('grown', cells)}) p JOIN t_rows t ON t.id = p.id WHERE NOT t.learnt)""")
    return " UNION ALL ".join(parts)


def predictions(spark, folder, model, *class_counts):
    out = None
    for classes in class_counts:
        train, test = sides(table(spark, folder, classes))
        rows = MODELS[model](train, classes=classes, key="vec_id").predict(test)
        probs = [F.round(F.get("prob", F.lit(k)), 6).alias(f"p{k}") for k in range(3)]
        part = rows.select(F.lit(classes).alias("classes"), "vec_id", "label", *probs, evaluate.called_class(classes).alias("called"))
        out = part if out is None else out.unionByName(part)
    return out


def checked(rows, train, classes, again, learns=None):
    """Test rows with what must hold for every fitted model; ``train`` are the predictions for the training side.

    Probabilities sum to one, the called class has the largest one, and ``again``, the probabilities worked out from the model's weights,
    agree. Over the training side the mean log loss must lie at least a hundredth below that of the class shares, which no constant reaches;
    ``learns`` is another test of that kind.
    """
    total = F.aggregate("prob", F.lit(0.0), lambda a, x: a + x)
    same = flag(F.aggregate(F.zip_with("prob", again, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: F.greatest(a, x)) < 1e-8)
    out = rows.select(
        F.lit(classes).alias("classes"), "vec_id", "label", flag(F.abs(total - 1) < 1e-6).alias("sums_to_one"),
        flag(F.get("prob", evaluate.called_class(classes)) == F.array_max("prob")).alias("called_is_largest"), same.alias("follows_from_weights"),
    )
    if learns is not None:
        return out.withColumn("learns", learns)
    loss = train.agg(F.avg(-F.log(F.greatest(F.get("prob", F.col("label")), F.lit(1e-12)))).alias("l")).scalar()
    shares = train.groupBy("label").agg(F.count("*").alias("n")).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h")).scalar()
    return out.withColumn("learns", flag(loss < 0.99 * shares))


def sql_checked(*class_counts):
    return " UNION ALL ".join(
        f"SELECT {c} AS classes, vec_id, CAST(label % {c} AS INTEGER) AS label, 1 AS sums_to_one, 1 AS called_is_largest, 1 AS follows_from_weights, 1 AS learns "
        f"FROM embeddings WHERE {SPLIT}" for c in class_counts)


def plain(df):
    """Rows with the features as an array ``x``."""
    return df.withColumn("x", vector_to_array("features"))


def dot(x, weights, constant):
    """Linear form with fixed weights."""
    w = F.from_json(F.lit(json.dumps([float(v) for v in weights])), "array<double>")
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(constant)), lambda s, v: s + v)


def logistic(z):
    return 1 / (1 + F.exp(-z))


def sql_pair():
    """Three rounds of two columns that are filled from each other, the one with fewer gaps (x1) first."""
    steps = ["""p0 AS (SELECT vec_id, vec_id % 5 = 0 AS g0, vec_id % 6 = 0 AS g1, CASE WHEN vec_id % 5 = 0 THEN m0 ELSE x0 END AS x0, CASE WHEN vec_id % 6 = 0 THEN m1 ELSE x1 END AS x1
      FROM raw, (SELECT avg(x0) FILTER (vec_id % 5 != 0) AS m0, avg(x1) FILTER (vec_id % 6 != 0) AS m1 FROM raw))"""]
    for i in range(6):
        mine, other = ("x1", "x0") if i % 2 == 0 else ("x0", "x1")
        gap = f"g{mine[1]}"
        steps.append(f"""p{i + 1} AS (SELECT vec_id, g0, g1, {other}, CASE WHEN {gap} THEN mean + slope * ({other} - around) ELSE {mine} END AS {mine}
      FROM p{i}, (SELECT regr_slope({mine}, {other}) / (1 + {RIDGE}) AS slope, avg({mine}) AS mean, avg({other}) AS around FROM p{i} WHERE NOT {gap}))""")
    return "raw AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1 FROM embeddings), " + ", ".join(steps)


@query("iterative_impute", f"WITH {sql_pair()} SELECT e.vec_id, " + ", ".join(
    f"CASE WHEN e.vec_id % {5 + i} != 0 THEN round(CAST(embedding[{i + 1}] AS DOUBLE), 4) END AS x{i}" for i in range(SIZE)) + ", " + ", ".join(
    f"CAST(e.vec_id % {5 + i} = 0 AS INTEGER) AS filled{i}" for i in range(SIZE)) + ", round(p6.x0, 6) AS pair0, round(p6.x1, 6) AS pair1 FROM embeddings e JOIN p6 USING (vec_id)")
def _(spark, folder):
    """All 64 columns have gaps, at different rows, and each is filled from the other 63; ``pair`` are the first two filled from each other alone."""
    gap = [F.col("vec_id") % (5 + i) == 0 for i in range(SIZE)]
    rows = stage(scan(spark, folder, "embeddings", "vec_id", "embedding").select(
        "vec_id", *[F.when(~gap[i], F.col("embedding")[i].cast("double")).alias(n) for i, n in enumerate(NAMES)]), "gaps")
    _, full = fit_imputer(rows, NAMES)
    _, two = fit_imputer(rows.select("vec_id", "x0", "x1"), ["x0", "x1"])
    known = [F.when(~gap[i], F.round(n, 4)).alias(n) for i, n in enumerate(NAMES)]
    near = [flag(gap[i] & F.col(NAMES[i]).between(-5, 5)).alias(f"filled{i}") for i in range(SIZE)]
    pair = two.select("vec_id", F.round("x0", 6).alias("pair0"), F.round("x1", 6).alias("pair1"))
    return full.select("vec_id", *known, *near).join(pair, "vec_id")


for _model in TREES:
    query(_model, sql_predictions(_model, 2, 3))(lambda spark, folder, model=_model: predictions(spark, folder, model, 2, 3))


def curve_of(fitted, z):
    """Probabilities from a margin by the logistic curve of a one-column model."""
    p = logistic(z * float(fitted.coefficients[0]) + float(fitted.intercept))
    return F.array(1 - p, p)


def below_constant(train, margins):
    """Whether the hinge losses of the margins, by class, add up to a hundredth less at least than those of the best constants."""
    t = [F.col("label") == c for c in margins]
    hinge = [F.avg(F.greatest(F.lit(0.0), 1 - F.when(y, z).otherwise(-z))) for y, z in zip(t, margins.values())]
    flat = [2 * F.least(F.avg(flag(y)), 1 - F.avg(flag(y))) for y in t]
    return train.agg(flag(sum(hinge[1:], hinge[0]) < 0.99 * sum(flat[1:], flat[0])).alias("ok")).scalar()


@query("linear_svm", sql_checked(2))
def _(spark, folder):
    train, test = sides(table(spark, folder, 2))
    fitted = MODELS["linear_svm"](train, classes=2, key="vec_id")
    svm, curve = fitted.model
    z = dot(F.col("x"), svm.coefficients.toArray(), svm.intercept)
    return checked(plain(fitted.predict(test)), None, 2, curve_of(curve, z), below_constant(plain(train), {1: z}))


@query("rbf_svm", sql_checked(3))
def _(spark, folder):
    train, test = sides(table(spark, folder, 3))
    fitted = MODELS["rbf_svm"](train, classes=3, key="vec_id")
    lifted = waves(F.col("x"), *drawn_waves(SIZE, 0.05, 256))
    margins = [dot(F.col("_lifted"), m.model[0].coefficients.toArray(), m.model[0].intercept) for m in fitted.model]
    parts = [curve_of(m.model[1], z)[1] for m, z in zip(fitted.model, margins)]
    total = parts[0] + parts[1] + parts[2]
    rows = plain(fitted.predict(test.withColumn("_plain", F.col("features"))).withColumn("features", F.col("_plain"))).withColumn("_lifted", lifted)
    learns = below_constant(plain(train).withColumn("_lifted", lifted), dict(enumerate(margins)))
    return checked(rows, None, 3, F.array(*[p / total for p in parts]), learns)


@query("logistic_regression", f"""
    SELECT 'row' AS part, vec_id AS id, CAST(label % 2 AS INTEGER) AS label, 1 AS follows_from_weights, 1 AS learns FROM embeddings WHERE {SPLIT}
    UNION ALL SELECT 'coefficient', i, NULL, 1, 1 FROM range(0, {SIZE} + 1) r(i)""")
def _(spark, folder):
    """Test rows, and for each coefficient and the constant (last) whether the penalised loss has no slope there."""
    train, test = sides(table(spark, folder, 2))
    fitted = MODELS["logistic_regression"](train, classes=2, key="vec_id")
    w, b = fitted.model.coefficients.toArray(), float(fitted.model.intercept)
    p = logistic(dot(F.col("x"), w, b))
    rows = checked(plain(fitted.predict(test)), fitted.predict(train), 2, F.array(1 - p, p)).select(
        F.lit("row").alias("part"), F.col("vec_id").alias("id"), "label", "follows_from_weights", "learns")
    known = plain(train)
    miss = p - F.col("label")
    slopes = known.agg(*[F.avg(miss * F.get("x", F.lit(i))).alias(f"s{i}") for i in range(SIZE)], F.avg(miss).alias(f"s{SIZE}"), F.count("*").alias("n"))
    penalty = [*[float(c) for c in w], 0.0]
    flat = F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("id"), flag(F.abs(F.col(f"s{i}") + F.lit(penalty[i]) / (100.0 * F.col("n"))) < 1e-6).alias("at_optimum"))
        for i in range(SIZE + 1)])).alias("c")
    learns = rows.agg(F.min("learns")).scalar()
    return rows.unionByName(slopes.select(flat).select(
        F.lit("coefficient").alias("part"), F.col("c.id").alias("id"), F.lit(None).cast("int").alias("label"),
        F.col("c.at_optimum").alias("follows_from_weights"), learns.alias("learns")))


@query("mlp", sql_checked(2))
def _(spark, folder):
    train, test = sides(table(spark, folder, 2))
    fitted = MODELS["mlp"](train, classes=2)
    return checked(plain(fitted.predict(test)), fitted.predict(train), 2, forward(F.col("x"), [SIZE, 10, 10, 2], fitted.model.weights.toArray()))


def forward(x, layers, weights):
    """Class probabilities of a feed-forward net: sigmoid layers, then a softmax; weights of a layer column by column, then its constants."""
    at = 0
    for n, (size, units) in enumerate(zip(layers, layers[1:])):
        matrix = weights[at : at + size * units].reshape(size, units)
        constants = weights[at + size * units : at + (size + 1) * units]
        at += (size + 1) * units
        z = [dot(x, matrix[:, j], constants[j]) for j in range(units)]
        x = F.array(*([logistic(v) for v in z] if n < len(layers) - 2 else [F.exp(v) for v in z]))
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.transform(x, lambda v: v / total)


@query("lasso_cv", " UNION ALL ".join(f"SELECT '{n}' AS feature, 1 AS optimal" for n in NAMES))
def _(spark, folder):
    """Whether each coefficient is at its optimum: the residual's mean product with a feature is the penalty, or below it where the coefficient is 0."""
    train = sides(table(spark, folder, 2))[0]
    found = evaluate.lasso_cv(train, "vec_id", NAMES).collect()
    weights, alpha = {r.feature: r.coefficient for r in found}, found[0].alpha
    x = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    means = x.agg(F.avg("y"), *[F.avg(F.get("x", F.lit(i))) for i in range(SIZE)]).first()
    centred = [F.get("x", F.lit(i)) - means[i + 1] for i in range(SIZE)]
    rest = F.col("y") - means[0]
    for n, c in zip(NAMES, centred):
        rest = rest - c * weights[n]
    slopes = x.agg(*[F.avg(rest * c) for c in centred]).first()
    good = [(n, int(abs(g - alpha * (1 if weights[n] > 0 else -1)) < 1e-7 if weights[n] else abs(g) <= alpha + 1e-7)) for n, g in zip(NAMES, slopes)]
    return spark.createDataFrame(good, "feature string, optimal int")


TREE_BASES = [ensemble(name, 3, SIZE) for name in TREES]


def with_fold(spec, fold):
    return Ensemble(**{**spec.__dict__, "fold": fold})


def sql_out_of_fold():
    """Out-of-fold probabilities of the tree bases on the training side: the model of a row's fold never learnt from it."""
    parts, names = [], []
    for name, spec in zip(TREES, TREE_BASES):
        cells = [with_fold(spec, f) for f in FOLDS]
        names.append(sql_grown(name, cells))
        parts.append(f"SELECT '{name}' AS part, t.id AS vec_id, t.fold, round(p0, 6) AS p0, round(p1, 6) AS p1, round(p2, 6) AS p2 "
                     f"FROM ({sql_probabilities(name, cells)}) p JOIN t_rows t ON t.id = p.id AND t.fold = p.e")
    return f"SELECT * FROM (WITH RECURSIVE {sql_rows(3, 'true', f'NOT ({SPLIT})')}, {', '.join(names)} {' UNION ALL '.join(parts)})"


@query("stacking", f"""{sql_out_of_fold()}
    UNION ALL SELECT 'logistic_regression', vec_id, {FOLD}, NULL, NULL, 1 FROM embeddings WHERE NOT ({SPLIT})
    UNION ALL SELECT 'stacked', vec_id, NULL, NULL, NULL, 1 FROM embeddings WHERE {SPLIT}""")
def _(spark, folder):
    """Out-of-fold probabilities of the tree bases; the linear base's and the stack's, whose weights DuckDB can't fit, must sum to one."""
    train, test = sides(table(spark, folder, 3))
    stacked = evaluate.Stack(train, "vec_id", 3, propagate=[0, 1, 2])
    total = F.aggregate("prob", F.lit(0.0), lambda a, x: a + x)
    sums = F.when(F.abs(total - 1) < 1e-9, 1.0)
    grown = F.col("name") != "logistic_regression"
    held = stacked.scores.select(
        F.col("name").alias("part"), "vec_id", "fold", *[F.when(grown, F.round(F.get("prob", F.lit(k)), 6)).alias(f"p{k}") for k in range(2)],
        F.when(grown, F.round(F.get("prob", F.lit(2)), 6)).otherwise(sums).alias("p2"))
    none = F.lit(None)
    return held.unionByName(stacked.predict(test).select(
        F.lit("stacked").alias("part"), "vec_id", none.cast("int").alias("fold"), none.cast("double").alias("p0"), none.cast("double").alias("p1"), sums.alias("p2")))


KFOLD = [with_fold(ensemble("random_forest", 2, SIZE), f) for f in FOLDS]


@query("kfold_accuracy", f"""WITH RECURSIVE {sql_rows(2, 'true')}, {sql_grown('grown', KFOLD)},
    each AS (SELECT t.fold, avg(CAST(t.y = CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS DOUBLE)) AS accuracy
      FROM ({sql_probabilities('grown', KFOLD)}) p JOIN t_rows t ON t.id = p.id AND t.fold = p.e GROUP BY t.fold)
    SELECT round(avg(accuracy), 8) AS accuracy, round(2 * stddev_pop(accuracy), 8) AS two_sd FROM each""")
def _(spark, folder):
    found = evaluate.kfold_accuracy(table(spark, folder, 2), "vec_id", "random_forest", 2)
    return found.select(F.round("accuracy", 8).alias("accuracy"), F.round("two_sd", 8).alias("two_sd"))


GRID = list(product((3, 5, 7, 9), (1, 3, 5)))
GRID_CELLS = [evaluate.grid_cell(depth=d, least=float(w), fold=f) for d, w in GRID for f in FOLDS]
GRID_R2 = list(product((0.03, 0.05, 0.07), (5, 6, 7)))
GRID_R2_CELLS = [evaluate.grid_cell_r2(rate=r, depth=d, fold=f) for r, d in GRID_R2 for f in FOLDS]


@query("grid_search", f"""WITH RECURSIVE {sql_rows(2, 'true')}, {boosted_sql('grown', GRID_CELLS)},
    held AS (SELECT e // 5 AS cell, fold, y, 1 / (1 + exp(-m)) AS p FROM (SELECT g.e, t.fold, g.y, g.m FROM grown g JOIN t_rows t ON t.id = g.id AND t.fold = g.e % 5 WHERE g.r = 140)),
    each AS (SELECT a.cell, a.fold, avg(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS auc
      FROM held a JOIN held b ON b.cell = a.cell AND b.fold = a.fold WHERE a.y = 1 AND b.y = 0 GROUP BY a.cell, a.fold)
    SELECT CAST(d AS INT) AS max_depth, CAST(w AS INT) AS min_leaf, round(avg(auc), 8) AS auc
    FROM each JOIN (VALUES {', '.join(f'({i}, {d}, {w})' for i, (d, w) in enumerate(GRID))}) g(cell, d, w) USING (cell) GROUP BY d, w""")
def _(spark, folder):
    """All 12 cells at 140 rounds and 5 folds."""
    return evaluate.grid_search(table(spark, folder, 2), "vec_id").select("max_depth", "min_leaf", F.round("auc", 8).alias("auc"))


@query("grid_search_r2", f"""WITH RECURSIVE {sql_rows(2, 'true')}, {boosted_sql('grown', GRID_R2_CELLS)},
    held AS (SELECT g.e // 5 AS cell, t.fold, g.y::DOUBLE AS y, CAST(g.m > 0.5 AS INT)::DOUBLE AS c FROM grown g JOIN t_rows t ON t.id = g.id AND t.fold = g.e % 5 WHERE g.r = 90),
    each AS (SELECT cell, fold, 1 - sum((y - c) * (y - c)) / (var_pop(y) * count(*)) AS r2 FROM held GROUP BY cell, fold)
    SELECT CAST(l AS DOUBLE) AS learning_rate, CAST(d AS INT) AS max_depth, round(avg(r2), 8) AS r2
    FROM each JOIN (VALUES {', '.join(f'({i}, {r}, {d})' for i, (r, d) in enumerate(GRID_R2))}) g(cell, l, d) USING (cell) GROUP BY l, d""")
def _(spark, folder):
    """All 9 cells at 90 rounds and 5 folds."""
    return evaluate.grid_search_r2(table(spark, folder, 2), "vec_id").select("learning_rate", "max_depth", F.round("r2", 8).alias("r2"))


@query("feature_importance", f"""WITH RECURSIVE {sql_rows(3)}, {sql_grown('grown', TREE_BASES[:1])},
    gains AS (SELECT sf, sum(sg) AS g FROM (SELECT DISTINCT t, node // 2 AS n, sf, sg FROM grown WHERE sf >= 0) GROUP BY sf)
    SELECT 'x' || f AS feature, round(coalesce(g, 0) / (SELECT max(g) FROM gains), 6) AS importance FROM t_cuts LEFT JOIN gains ON sf = f""")
def _(spark, folder):
    train, _ = sides(table(spark, folder, 3))
    found = evaluate.importance_table(spark, MODELS["random_forest"](train, classes=3, key="vec_id").importances, NAMES)
    return found.select("feature", F.round("importance", 6).alias("importance"))


@query("gain_importance", f"""WITH RECURSIVE {sql_rows(3)}, {sql_grown('grown', TREE_BASES[2:], True)}
    SELECT 'x' || sf AS feature, round(avg(sg), 6) AS gain FROM (SELECT DISTINCT k, r, l, node // 2 AS n, sf, sg FROM grown WHERE sf >= 0)
    GROUP BY sf ORDER BY avg(sg) DESC, feature LIMIT 10""")
def _(spark, folder):
    """The ten features with the largest mean gain in the three-class boosted model."""
    train, _ = sides(table(spark, folder, 3))
    fitted = MODELS["boosting_regularized"](train, classes=3, key="vec_id")
    return evaluate.gain_table(spark, fitted.model, NAMES).select("feature", F.round("gain", 6).alias("gain"))


DIAGNOSIS = ["deathrate_cat_1", "deathrate_cat_2", "deathrate_int_cat_1", "deathrate_int_cat_2", "age"]
SHARES = ("accuracy", "recall", "precision", "auc", "pr_auc", "best_threshold", "best_f1")


@query("mortality_model", with_views(f"""
    SELECT 'random_forest' AS model, count(*) AS n_test, count(*) FILTER (died = 1) AS n_deaths, {', '.join(f'1 AS {c}_in_range' for c in SHARES)},
      1 AS follows_from_cells, 1 AS auc_by_pairs, 1 AS learns
    FROM (SELECT o.icustay_id, o.icustay_expire_flag AS died FROM oasis o) WHERE {sql_draw('split', 'icustay_id')} < 0.25""", "oasis", extra=KNOWN))
def _(spark, folder):
    """Diagnosis flags, both scores' inputs, vital signs and one-hot categories of every stay."""
    v = clinical_views(spark, folder, stage)
    f = scores.score_features(v, "all_scores", stage)
    main = diagnosis_features(stage(extracts.all_diagnoses(v), "diagnoses"), MIN_DEATHS, MIN_PAIRS, TOP, stage)
    graded = scores.oasis(v, f).join(scores.sofa(v, f).drop("subject_id", "hadm_id"), "icustay_id", "left").select(
        "icustay_id", "icustay_expire_flag", *SCORE_FEATURES)
    dummies = [c.alias(f"dummy_{i}_{j}") for i, name in enumerate(CATEGORIES) for j, c in enumerate(one_hot(F.col(name), CATEGORIES[name], ""))]
    kept = main.select("icustay_id", *DIAGNOSIS, *dummies)
    rows = stage(kept.join(graded, "icustay_id").join(f["vitals"].drop("subject_id", "hadm_id"), "icustay_id"), "stays")
    scaled = [*DIAGNOSIS, *SCORE_FEATURES, *VITAL]
    learnt, scored = outcomes.mortality_scores(
        rows, "icustay_id", "icustay_expire_flag", [*scaled, *[c for c in kept.columns if c.startswith("dummy_")]], scaled)
    found = outcomes.mortality_metrics(scored, "random_forest")
    n, right = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.col("tp") + F.col("tn")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    follows = (F.abs(F.col("accuracy") - share(right, n)) < 1e-9) & (F.abs(F.col("recall") - share(F.col("tp"), F.col("tp") + F.col("fn"))) < 1e-9) & (
        F.abs(F.col("precision") - share(F.col("tp"), F.col("tp") + F.col("fp"))) < 1e-9) & (
        F.col("best_f1") >= share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")) - 1e-9)
    again = roc_auc_by(scored.withColumn("all", F.lit(0)), ["all"], "label", "score").select("auc").scalar()
    train_auc = roc_auc_by(learnt.withColumn("all", F.lit(0)), ["all"], "label", "score").select("auc").scalar()
    return found.select(
        "model", n.alias("n_test"), (F.col("fn") + F.col("tp")).alias("n_deaths"), *[flag(F.col(c).between(0, 1)).alias(f"{c}_in_range") for c in SHARES],
        flag(follows).alias("follows_from_cells"), flag(F.abs(F.col("auc") - again) < 1e-9).alias("auc_by_pairs"), flag(train_auc > 0.8).alias("learns"))


@query("outcome_model", " UNION ALL ".join(
    f"SELECT '{m}' AS model, 1 AS reweighted_in_range, 1 AS plain_in_range, 1 AS cautious_in_range, {1 if m in TREES else 'NULL'} AS learns" for m in outcomes.LINE_UP))
def _(spark, folder):
    """All five models on every feature of the day table, called in three ways; ``learns`` where the called class comes straight from what was fitted."""
    out = F.col("out_flag")
    rows = day_table(spark, folder).withColumn("label", F.when(out == -1, 2).otherwise(out)).withColumn(
        "row_id", F.concat_ws("|", "icustay_id", "day_of_stay")
    )
    scaled = ["age", *SCORE_FEATURES, "day_of_stay", "cum_caretime_doctors", "cum_caretime_nurses", *VITAL]
    flags = ["procedure_significantevents", "procedure_ventilation", *[f"icd9_code_cat_{i}" for i in range(5)], *DIAGNOSIS[:4]]
    dummies = [F.col(f"`{d}`").alias(f"dummy_{i}") for i, d in enumerate(DUMMIES)]
    rows = stage(rows.select("row_id", "label", *scaled, *flags, *dummies), "days")
    columns = [*scaled, *flags, *[f"dummy_{i}" for i in range(len(DUMMIES))]]
    found = outcomes.outcome_model(rows, "row_id", "label", columns, scaled)
    return found.select("model", *[flag(F.col(c).between(0, 1)).alias(f"{c}_in_range") for c in ("reweighted", "plain", "cautious")], F.when(F.col("model").isin(*TREES), flag(F.col("fitted") > 0.4)).alias("learns"))
