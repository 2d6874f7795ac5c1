"""Feature engineering, models and metrics. Where a fit has a closed form, the SQL
computes it."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from roadlens.catalog.job_queries import RISK_ATTRIBUTES, feature_rows, rounded
from roadlens.catalog.registry import query
from roadlens.models import features as X
from roadlens.models import learners as L
from roadlens.models import metrics as E
from roadlens.models import selection as N
from roadlens.models import vocabulary as V
from roadlens.operators import joins as J
from roadlens.operators import sampling as M
from roadlens.plans import crash_models, risk, volume
from roadlens.session import materialize

COUNT_FEATURES = ("sample_speed", "speed_change", "arc_length", "curve_max_angle", "speed_limit",
                  "road_lanes", "road_priority", "slope", "tri")
COUNT_FLAGS = ("roundabout", "tunnel", "bridge")
COUNT_CATEGORIES = ("weather", "event_type", "circulation_poi", "road_cycle", "interaction_poi")


def slots(column: str, size: int):
    """The slots of a vector as columns f0, f1, ..."""
    values = vector_to_array(column)
    return [values[i].alias(f"f{i}") for i in range(size)]


# ---- features


@query("assemble_features", """
    SELECT arc, arc_length AS f0, curve_max_angle AS f1, CAST(road_priority AS DOUBLE) AS f2
    FROM fx_arcs""")
def assemble_features(t):
    rows = X.assemble_features(t["fx_arcs"], ["arc_length", "curve_max_angle", "road_priority"])
    return rows.select("arc", *slots("features", 3))


# few enough rows for the median sketch to be exact: the lower middle value
@query("assemble_features_keep", """
    WITH m AS (SELECT quantile_disc(slope, 0.5) AS a, quantile_disc(speed_limit, 0.5) AS b
               FROM fx_arcs)
    SELECT arc, slope, speed_limit, coalesce(slope, a) AS f0,
           CAST(coalesce(speed_limit, b) AS DOUBLE) AS f1, arc_length AS f2 FROM fx_arcs, m""")
def assemble_features_keep(t):
    rows = X.assemble_features_keep(t["fx_arcs"], ["slope", "speed_limit", "arc_length"])
    return rows.select("arc", "slope", "speed_limit", *slots("features", 3))


LABELS = """
    WITH l AS (SELECT interaction_poi AS v,
                      row_number() OVER (ORDER BY count(*) DESC, interaction_poi) - 1 AS i
               FROM fx_arcs WHERE interaction_poi IS NOT NULL GROUP BY interaction_poi),
         n AS (SELECT count(*) AS size FROM l)"""


@query("string_index", LABELS + """
    SELECT arc, interaction_poi, CAST(coalesce(i, size) AS DOUBLE) AS interaction_poi_index
    FROM fx_arcs CROSS JOIN n LEFT JOIN l ON v = interaction_poi""")
def string_index(t):
    return X.string_index(t["fx_arcs"].select("arc", "interaction_poi"), "interaction_poi")


@query("one_hot", LABELS + """
    SELECT arc, CAST(size AS INT) AS n_slots, CAST(i AS INT) AS hot
    FROM fx_arcs CROSS JOIN n LEFT JOIN l ON v = interaction_poi""")
def one_hot(t):
    indexed = X.string_index(t["fx_arcs"].select("arc", "interaction_poi"), "interaction_poi")
    values = vector_to_array("interaction_poi_encoded")
    place = F.nullif(F.array_position(values, 1.0).cast("int"), F.lit(0))
    return X.one_hot(indexed, "interaction_poi").select(
        "arc", F.size(values).alias("n_slots"), (place - 1).alias("hot")
    )


@query("feature_pipeline", """
    WITH l AS (SELECT interaction_poi AS v,
                      row_number() OVER (ORDER BY count(*) DESC, interaction_poi) - 1 AS i
               FROM fx_arcs WHERE interaction_poi IS NOT NULL GROUP BY interaction_poi),
         p AS (SELECT CAST(road_priority AS VARCHAR) AS pv,
                      row_number() OVER (ORDER BY count(*) DESC, CAST(road_priority AS VARCHAR)) - 1 AS pi
               FROM fx_arcs GROUP BY road_priority),
         n AS (SELECT (SELECT count(*) FROM l) AS a, (SELECT count(*) FROM p) AS b)
    SELECT arc, CAST(coalesce(i, a) AS DOUBLE) AS interaction_poi_index,
           CAST(pi AS DOUBLE) AS road_priority_index, CAST(a + b AS INT) AS n_slots
    FROM fx_arcs CROSS JOIN n LEFT JOIN l ON v = interaction_poi
    JOIN p ON pv = CAST(road_priority AS VARCHAR)""")
def feature_pipeline(t):
    names = ["interaction_poi", "road_priority"]
    rows = X.fit_encoding(t["fx_arcs"], names).transform(t["fx_arcs"])
    vectors = X.assembler([n + X.ENCODED for n in names]).transform(rows)
    return vectors.select(
        "arc", *[n + X.INDEX for n in names],
        F.size(vector_to_array("features")).alias("n_slots"),
    )


# as many categories as orders, numbered by ranges of a distributed sort
@query("vocabulary_index", """
    WITH l AS (SELECT trip_id, row_number() OVER (ORDER BY count(*) DESC, CAST(trip_id AS VARCHAR)) - 1 AS i
               FROM fx_events GROUP BY trip_id)
    SELECT trip_id, arc, CAST(i AS DOUBLE) AS trip_id_index, (SELECT CAST(count(*) AS INT) FROM l) AS n_slots,
           CAST(i AS INT) AS hot
    FROM fx_events JOIN l USING (trip_id)""")
def vocabulary_index(t):
    rows = t["fx_events"].select("trip_id", "arc")
    found = V.fit_vocabulary(rows, ["trip_id"])
    encoded = found.one_hot(found.index(rows))
    sparse = F.from_json(F.to_json(F.struct("trip_id_encoded")),
                         "trip_id_encoded struct<size:int,indices:array<int>>")["trip_id_encoded"]
    return encoded.select("trip_id", "arc", "trip_id_index", sparse["size"].alias("n_slots"),
                          sparse["indices"][0].alias("hot"))


@query("vector_slice", """
    SELECT arc, curve_max_angle AS f0, CAST(seq AS DOUBLE) AS f1 FROM fx_arcs""")
def vector_slice(t):
    # one input's name begins with another's
    inputs = ["arc_length", "curve_max_angle", "curve_max_angle_wide", "seq"]
    wide = t["fx_arcs"].withColumn("curve_max_angle_wide", F.col("curve_max_angle") * 2)
    rows = X.assemble_features(wide, inputs, "raw")
    return X.vector_slice(rows, ["curve_max_angle", "seq"], inputs, "raw", "picked").select(
        "arc", *slots("picked", 2)
    )


SPLIT = "CASE WHEN ('0x' || substr(md5('42:' || arc), 1, 8))::UBIGINT % 100 < 80"


@query("split_train_test", f"""
    SELECT arc, aadt, {SPLIT} THEN 'train' ELSE 'test' END AS split FROM fx_aadt""")
def split_train_test(t):
    train, test = M.split_train_test(t["fx_aadt"], ["arc"])
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )


# ---- linear models


def _speed_rows(t):
    return X.assemble_features(t["fx_events"].select("arc", "sample_speed", "speed_change"),
                               ["sample_speed"])


@query("linear_regression", """
    SELECT 'sample_speed' AS name, round(regr_slope(speed_change, sample_speed), 3) AS value
    FROM fx_events
    UNION ALL SELECT 'intercept', round(regr_intercept(speed_change, sample_speed), 3)
    FROM fx_events""")
def linear_regression(t):
    model = L.linear("speed_change").fit(_speed_rows(t))
    return rounded(E.named_coefficients(t.spark, model, ["sample_speed"]), 3)


@query("named_coefficients", """
    WITH c AS (SELECT covar_pop(curve_max_angle, arc_length) AS a_y,
                      covar_pop(seq, arc_length) AS b_y, covar_pop(curve_max_angle, seq) AS a_b,
                      var_pop(curve_max_angle) AS a_a, var_pop(seq) AS b_b,
                      avg(arc_length) AS mean_y, avg(curve_max_angle) AS mean_a,
                      avg(seq) AS mean_b FROM fx_arcs),
         s AS (SELECT *, (a_y * b_b - b_y * a_b) / (a_a * b_b - a_b * a_b) AS ca,
                      (b_y * a_a - a_y * a_b) / (a_a * b_b - a_b * a_b) AS cb FROM c)
    SELECT 'curve_max_angle' AS name, round(ca, 5) AS value FROM s
    UNION ALL SELECT 'seq', round(cb, 5) FROM s
    UNION ALL SELECT 'intercept', round(mean_y - ca * mean_a - cb * mean_b, 5) FROM s""")
def named_coefficients(t):
    rows = X.assemble_features(t["fx_arcs"], ["curve_max_angle", "seq"])
    model = L.linear("arc_length").fit(rows)
    return rounded(E.named_coefficients(t.spark, model, X.slot_names(rows)), 5)


@query("predict", """
    WITH m AS (SELECT regr_slope(speed_change, sample_speed) AS a,
                      regr_intercept(speed_change, sample_speed) AS b FROM fx_events)
    SELECT arc, sample_speed, round(a * sample_speed + b, 3) AS prediction FROM fx_events, m""")
def predict(t):
    rows = _speed_rows(t)
    scored = L.linear("speed_change").fit(rows).transform(rows)
    return rounded(scored.select("arc", "sample_speed", "prediction"), 3)


CRASHED = """
    WITH c AS (SELECT arc, count(*) AS n FROM fx_crashes GROUP BY arc),
         d AS (SELECT a.arc, CASE WHEN road_priority >= 3 THEN 1 ELSE 0 END AS x,
                      arc_length, CAST(coalesce(n, 0) AS DOUBLE) AS y,
                      CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS z
               FROM fx_arcs a LEFT JOIN c ON c.arc = a.arc)"""


def _crashed(t):
    """Per arc: x, whether it is a minor road; y, its crashes; z, whether there were any."""
    counted = J.key_counts(t["fx_crashes"], "arc", "n")
    rows = J.join_left(t["fx_arcs"], counted, "arc").na.fill(0, ["n"])
    return materialize(X.assemble_features(rows.select(
        "arc", "arc_length", (F.col("road_priority") >= 3).cast("int").alias("x"),
        F.col("n").cast("double").alias("y"), F.expr("CAST(n > 0 AS DOUBLE)").alias("z"),
    ), ["x"]))


@query("zero_label_predictions", CRASHED + """,
    m AS (SELECT regr_slope(y, arc_length) AS a, regr_intercept(y, arc_length) AS b FROM d)
    SELECT arc, y, round(a * arc_length + b, 5) AS prediction FROM d, m WHERE y = 0""")
def zero_label_predictions(t):
    rows = X.assemble_features(_crashed(t).drop("features"), ["arc_length"])
    scored = L.linear("y").fit(rows).transform(rows)
    return rounded(scored.where("y = 0").select("arc", "y", "prediction"), 5)


# a GLM on one 0/1 feature fits the two group means
GROUPS = CRASHED + """,
    g AS (SELECT avg(y) FILTER (WHERE x = 0) AS y0, avg(y) FILTER (WHERE x = 1) AS y1,
                 sum(y) FILTER (WHERE x = 0) AS s0, sum(y) FILTER (WHERE x = 1) AS s1,
                 avg(z) FILTER (WHERE x = 0) AS z0, avg(z) FILTER (WHERE x = 1) AS z1,
                 avg(y) AS mean, count(*) AS n FROM d)"""


@query("poisson_glm", GROUPS + """
    SELECT 'x' AS name, round(ln(y1 / y0), 4) AS value FROM g
    UNION ALL SELECT 'intercept', round(ln(y0), 4) FROM g""")
def poisson_glm(t):
    model = L.poisson("y").fit(_crashed(t))
    return rounded(E.named_coefficients(t.spark, model, ["x"]), 4)


@query("binomial_glm", GROUPS + """
    SELECT 'x' AS name, round(ln(z1 / (1 - z1)) - ln(z0 / (1 - z0)), 4) AS value FROM g
    UNION ALL SELECT 'intercept', round(ln(z0 / (1 - z0)), 4) FROM g""")
def binomial_glm(t):
    model = L.binomial("z").fit(_crashed(t))
    return rounded(E.named_coefficients(t.spark, model, ["x"]), 4)


@query("zero_inflated_pair", GROUPS + """
    SELECT arc, round(CASE x WHEN 0 THEN z0 ELSE z1 END, 5) AS p_crash,
           round(CASE x WHEN 0 THEN y0 ELSE y1 END, 5) AS lambda,
           round(CASE x WHEN 0 THEN y0 * z0 ELSE y1 * z1 END, 5) AS expected FROM d, g""")
def zero_inflated_pair(t):
    rows = _crashed(t)
    scored = L.zero_inflated_pair(rows, "y", "z").transform(rows)
    return rounded(scored.select("arc", "p_crash", "lambda", "expected"), 5)


STATISTICS = GROUPS + """,
    s AS (SELECT
      2 * sum(CASE WHEN y > 0 THEN y * ln(y / CASE x WHEN 0 THEN y0 ELSE y1 END) ELSE 0 END
              - (y - CASE x WHEN 0 THEN y0 ELSE y1 END)) AS deviance,
      2 * sum(CASE WHEN y > 0 THEN y * ln(y / mean) ELSE 0 END - (y - mean)) AS null_deviance,
      sum(y * ln(CASE x WHEN 0 THEN y0 ELSE y1 END) - CASE x WHEN 0 THEN y0 ELSE y1 END
          - lgamma(y + 1)) AS log_likelihood FROM d, g)"""


@query("glm_diagnostics", STATISTICS + """
    SELECT 'deviance' AS name, round(deviance, 3) AS value, NULL::DOUBLE AS std_error FROM s
    UNION ALL SELECT 'null_deviance', round(null_deviance, 3), NULL FROM s
    UNION ALL SELECT 'explained_deviance', round(null_deviance - deviance, 3), NULL FROM s
    UNION ALL SELECT 'degrees_of_freedom', n - 2, NULL FROM g
    UNION ALL SELECT 'x', round(ln(y1 / y0), 3), round(sqrt(1 / s0 + 1 / s1), 3) FROM g
    UNION ALL SELECT 'intercept', round(ln(y0), 3), round(sqrt(1 / s0), 3) FROM g""")
def glm_diagnostics(t):
    model = L.poisson("y").fit(_crashed(t))
    report = E.glm_report(t.spark, {"count": (model, E.glm_statistics(model))}, ["x"]).drop("model")
    return rounded(report.where(~F.col("name").isin("aic", "bic", "log_likelihood")), 3)


@query("information_criteria", STATISTICS + """
    SELECT 'aic' AS name, round(4 - 2 * log_likelihood, 3) AS value FROM s
    UNION ALL SELECT 'bic', round(2 * ln(n) - 2 * log_likelihood, 3) FROM s, g
    UNION ALL SELECT 'log_likelihood', round(log_likelihood, 3) FROM s""")
def information_criteria(t):
    found = E.glm_statistics(L.poisson("y").fit(_crashed(t)))
    names = ["aic", "bic", "log_likelihood"]
    return rounded(E.named_values(t.spark, names, [found[n] for n in names], "name", "value"), 3)


# ---- metrics

METRIC_SQL = """count(*) AS n_rows, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
    round(avg((y - p) ** 2), 4) AS mse, round(avg(abs(y - p)), 4) AS mae,
    round(1 - avg((y - p) ** 2) / var_pop(y), 4) AS r2"""
PREDICTED = "WITH v AS (SELECT arc, sample_speed AS y, trip_id % 50 + 0.5::DOUBLE AS p FROM fx_events)"


def _predicted(t):
    guess = (F.col("trip_id") % 50 + F.lit(0.5)).alias("p")
    return t["fx_events"].select("arc", F.col("sample_speed").alias("y"), guess)


@query("regression_metrics", f"{PREDICTED} SELECT {METRIC_SQL} FROM v")
def regression_metrics(t):
    return rounded(E.regression_metrics(_predicted(t), "y", "p"), 4)


@query("metrics_by_split", f"""{PREDICTED}
    SELECT {SPLIT} THEN 'train' ELSE 'test' END AS split, {METRIC_SQL} FROM v GROUP BY 1""")
def metrics_by_split(t):
    return rounded(E.metrics_by_split(M.with_split(_predicted(t), ["arc"]), "y", "p"), 4)


# ---- trees, forests, selection


def _risk_table(t):
    return risk.risk_table(t["fx_event_rows"], t["fx_crashes"], RISK_ATTRIBUTES)


def _sample(t, ratio=4):
    return risk.model_sample(_risk_table(t), ratio)


def _one_model(t, algorithm, features, **options):
    spec = risk.ModelSpec(algorithm, algorithm, features, **options)
    _, scored, _ = risk.fit_spec(spec, _sample(t))
    return rounded(E.metrics_by_split(scored, risk.LABEL))


# A tree that is deep enough for one feature of few values predicts the mean of each value,
# and so do a forest without bootstrap and boosting, whose later trees have nothing left.
GROUP_MEANS = """
    SELECT road_priority, round(avg(curve_max_angle), 6) AS prediction FROM fx_arcs
    GROUP BY road_priority"""


def _one_feature(t):
    return X.assemble_features(t["fx_arcs"], ["road_priority"])


def _mean_per_value(t, learner):
    rows = _one_feature(t)
    scored = learner.fit(rows).transform(rows)
    return scored.groupBy("road_priority").agg(F.round(F.max("prediction"), 6).alias("prediction"))


@query("decision_tree", GROUP_MEANS)
def decision_tree(t):
    return _mean_per_value(t, L.tree("curve_max_angle"))


@query("random_forest", GROUP_MEANS)
def random_forest(t):
    learner = L.forest("curve_max_angle", 5).setBootstrap(False).setFeatureSubsetStrategy("all")
    return _mean_per_value(t, learner)


@query("gradient_boosting", GROUP_MEANS)
def gradient_boosting(t):
    return _mean_per_value(t, L.boosted("curve_max_angle"))


@query("cross_validate", f"""
    WITH f AS (SELECT road_priority, curve_max_angle AS y,
                      ('0x' || substr(md5('{L.SEED}:' || arc), 1, 8))::UBIGINT % {L.FOLDS} AS fold FROM fx_arcs),
         k AS (SELECT DISTINCT fold FROM f),
         m AS (SELECT k.fold, road_priority, avg(y) AS p FROM f JOIN k ON f.fold <> k.fold GROUP BY 1, 2),
         e AS (SELECT fold, sqrt(avg((y - p) * (y - p))) AS rmse FROM f JOIN m USING (fold, road_priority)
               GROUP BY fold)
    SELECT max_depth, max_bins, (SELECT round(avg(rmse), 6) FROM e) AS rmse
    FROM (SELECT unnest({L.TREE_GRID["maxDepth"]}) AS max_depth), (SELECT unnest({L.TREE_GRID["maxBins"]}) AS max_bins)""")
def cross_validate(t):
    model = L.cross_validate(_one_feature(t), L.tree("curve_max_angle"), L.TREE_GRID,
                             "curve_max_angle", ["arc"])
    scores = [(p["maxDepth"], p["maxBins"], s) for p, s in L.grid_scores(model)]
    return rounded(t.spark.createDataFrame(scores, "max_depth int, max_bins int, rmse double"))


@query("chi_square_select", """
    WITH r AS (SELECT CAST(road_priority AS VARCHAR) AS v, CASE WHEN slope > 0 THEN 1 ELSE 0 END AS y FROM fx_arcs),
         s AS (SELECT v AS slot, h, y, count(*) AS n FROM (
                 SELECT d.v, CASE WHEN r.v = d.v THEN 1 ELSE 0 END AS h, y FROM r, (SELECT DISTINCT v FROM r) d)
               GROUP BY ALL),
         m AS (SELECT *, sum(n) OVER (PARTITION BY slot, h) * sum(n) OVER (PARTITION BY slot, y)
                         / sum(n) OVER (PARTITION BY slot) AS expected FROM s),
         c AS (SELECT slot, sum((n - expected) * (n - expected) / expected) AS chi FROM m GROUP BY slot)
    SELECT 'road_priority_encoded_' || slot AS feature FROM c ORDER BY chi DESC LIMIT 3""")
def chi_square_select(t):
    positive = F.when(F.col("slope") > 0, 1).otherwise(0)
    labelled = t["fx_arcs"].select(F.col("road_priority").cast("string"), positive.alias("uphill"))
    rows = X.fit_encoding(labelled, ["road_priority"]).transform(labelled)
    vectors = X.assemble_features(rows, ["road_priority_encoded"])
    _, names = X.chi_square_select(vectors, "features", "uphill", 3)
    return t.spark.createDataFrame([(n,) for n in names], "feature string")


def _mixed_sql(numbers, categories, label: str, top: int) -> str:
    """Contingency tables of every slot spelled out, expected counts and all."""
    edges = ", ".join(f"list_distinct(quantile_cont(CAST({c} AS DOUBLE), [{', '.join(str(i / 10) for i in range(1, 10))}])) AS {c}"
                      for c in numbers)
    parts = [f"SELECT '{c}' AS slot, CASE WHEN d.{c} IS NULL THEN -1 ELSE len(list_filter(e.{c}, lambda x: x < d.{c})) END AS v, y FROM d, e"
             for c in numbers]
    parts += [f"SELECT '{c}=' || w.v AS slot, CASE WHEN CAST(d.{c} AS VARCHAR) = w.v THEN 1 ELSE 0 END AS v, y FROM d, "
              f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM d WHERE {c} IS NOT NULL) w" for c in categories]
    return f"""
    WITH d AS (SELECT *, CASE WHEN {label} THEN 1 ELSE 0 END AS y FROM fx_arcs),
         e AS (SELECT {edges} FROM d),
         o AS (SELECT slot, v, y, count(*) AS n FROM ({" UNION ALL ".join(parts)}) GROUP BY ALL),
         r AS (SELECT slot, v, sum(n) AS r FROM o GROUP BY ALL), c AS (SELECT slot, y, sum(n) AS c FROM o GROUP BY ALL),
         t AS (SELECT slot, sum(n) AS t FROM o GROUP BY ALL),
         x AS (SELECT slot, r * c / t AS e, coalesce(n, 0) AS n
               FROM r JOIN c USING (slot) JOIN t USING (slot) LEFT JOIN o USING (slot, v, y)),
         k AS (SELECT slot, (count(DISTINCT v) - 1) AS degrees FROM r GROUP BY slot),
         s AS (SELECT slot, sum((n - e) * (n - e) / e) AS statistic, max(degrees) AS degrees FROM x JOIN k USING (slot)
               GROUP BY slot HAVING max(degrees) > 0),
         z AS (SELECT *, (cbrt(statistic / degrees) - (1 - 2 / (9.0 * degrees))) / sqrt(2 / (9.0 * degrees)) AS score FROM s)
    SELECT slot, round(statistic, 6) AS statistic, degrees, round(score, 6) AS score
    FROM z ORDER BY z.score DESC, slot LIMIT {top}"""


MIXED = (("arc_length", "curve_max_angle", "speed_limit", "seq"), ("interaction_poi", "road_priority"))


@query("select_mixed_slots", _mixed_sql(*MIXED, "coalesce(slope > 0, false)", 10))
def select_mixed_slots(t):
    uphill = F.coalesce(F.col("slope") > 0, F.lit(False)).cast("int")
    return rounded(N.select_slots(t["fx_arcs"].withColumn("uphill", uphill), *MIXED, "uphill", 10))


@query("feature_importance", "SELECT 'road_priority' AS feature, 1.0::DOUBLE AS importance")
def feature_importance(t):
    rows = _one_feature(t)
    model = L.tree("curve_max_angle").fit(rows)
    return E.feature_importance(t.spark, model.featureImportances, X.slot_names(rows))


@query("decision_tree_job")
def decision_tree_job(t):
    return _one_model(t, "decision_tree", risk.BASIC)


@query("random_forest_job")
def random_forest_job(t):
    return _one_model(t, "random_forest", risk.FULL)


@query("gradient_boosting_job")
def gradient_boosting_job(t):
    return _one_model(t, "gradient_boosting", risk.FULL)


@query("branch_pipeline")
def branch_pipeline(t):
    return _one_model(t, "branch_forest", (*risk.FULL, risk.CRASH))


@query("cross_validate_job")
def cross_validate_job(t):
    rows = X.assemble_features(_sample(t), risk.BASIC)
    train = rows.where("split = 'train'")
    model = L.cross_validate(train, L.tree(risk.LABEL), L.TREE_GRID, risk.LABEL, ["_key"])
    scores = [(p["maxDepth"], p["maxBins"], s) for p, s in L.grid_scores(model)]
    return rounded(t.spark.createDataFrame(scores, "max_depth int, max_bins int, rmse double"))


@query("chi_square_select_job")
def chi_square_select_job(t):
    rows = X.assemble_features(_sample(t), risk.ENCODED)
    _, names = X.chi_square_select(rows, "features", risk.CRASH, 5)
    return t.spark.createDataFrame([(n,) for n in names], "feature string")


@query("feature_importance_job")
def feature_importance_job(t):
    specs = [s for s in risk.model_specs() if s.name == "model_3"]
    return rounded(risk.model_importance(_risk_table(t), specs[0]))


# ---- jobs


VOLUMES = """
    WITH a AS (SELECT arc FROM fx_event_rows UNION SELECT arc FROM fx_crashes),
         v AS (SELECT arc, avg(aadt) AS aadt FROM fx_aadt_nan GROUP BY arc),
         c AS (SELECT arc, count(*) AS crashes FROM fx_crashes GROUP BY arc),
         k AS (SELECT a.arc, CASE WHEN NOT isnan(aadt) THEN aadt END AS aadt, coalesce(crashes, 0) AS crashes
               FROM a LEFT JOIN v USING (arc) LEFT JOIN c USING (arc))"""


def _checked(rows, value: str):
    """Known values as they are; of predicted ones, that they lie among the known."""
    known = rows.where("NOT is_predicted").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    return rows.select(
        "arc", "is_predicted",
        F.when(~F.col("is_predicted"), F.round(value, 6)).alias("known"),
        F.col(value).between(known["lo"], known["hi"]).alias("in_range"))


@query("impute_target", VOLUMES + """
    SELECT arc, aadt IS NULL AS is_predicted, round(aadt, 6) AS known, true AS in_range FROM k""")
def impute_target(t):
    return _checked(volume.impute_target(feature_rows(t)), "aadt")


@query("predict_rate", VOLUMES + """
    SELECT arc, coalesce(aadt, 0) = 0 AS is_predicted, round(crashes / nullif(aadt, 0), 6) AS known,
           true AS in_range FROM k""")
def predict_rate(t):
    return _checked(volume.predict_rate(feature_rows(t)), "crashes_aadt")


@query("impute_target_job")
def impute_target_job(t):
    return rounded(volume.impute_target(feature_rows(t)))


@query("impute_target_metrics")
def impute_target_metrics(t):
    fitted = volume.fit_target(feature_rows(t), F.col("aadt"), "aadt", volume.VOLUME_FEATURES)
    return rounded(fitted.metrics())


@query("predict_rate_job")
def predict_rate_job(t):
    return rounded(volume.predict_rate(feature_rows(t)), 9)


@query("predict_rate_road")
def predict_rate_road(t):
    return rounded(volume.predict_rate(feature_rows(t), columns=volume.ROAD_FEATURES), 9)


@query("model_comparison")
def model_comparison(t):
    return rounded(risk.model_comparison(_risk_table(t)))


def _least_squares_sql(numeric, flags, keys: str, seed: int) -> str:
    """Normal equations by elimination over a list of rows, and the errors of the test rows."""
    columns = [*numeric, *flags]
    typed = ", ".join([*(f"CAST({c} AS DOUBLE) AS {c}" for c in numeric),
                       *(f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END::DOUBLE AS {c}" for c in flags)])
    known = " AND ".join(f"{c} IS NOT NULL" for c in numeric)
    equations = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in [*columns, "y"]) + "]" for a in columns)
    predicted = " + ".join(f"{c} * b[{i}]" for i, c in enumerate(columns, 1))
    means = ", ".join(f"avg({c})" for c in columns)
    unpivoted = " UNION ALL ".join(f"SELECT '{c}' AS name, b[{i}] AS value FROM s" for i, c in enumerate(columns, 1))
    return f"""
    WITH c AS (SELECT arc, count(*) AS n FROM fx_crashes GROUP BY arc),
         d AS (SELECT {typed}, CAST(coalesce(n, 0) AS DOUBLE) AS y,
                      ('0x' || substr(md5('{seed}:' || {keys}), 1, 8))::UBIGINT % 100 < 80 AS train
               FROM fx_event_rows LEFT JOIN c USING (arc) WHERE {known}),
         m AS (SELECT [{equations}] AS a, [{means}] AS xs, avg(y) AS ys FROM d WHERE train),
         e AS (SELECT xs, ys, list_reduce(generate_series(1, {len(columns)})::BIGINT[],
                 lambda a, k: list_transform(a, lambda r, i: CASE WHEN i = k
                   THEN list_transform(r, lambda v: v / a[k][k])
                   ELSE list_transform(r, lambda v, j: v - r[k] * a[k][j] / a[k][k]) END), a) AS a FROM m),
         f AS (SELECT xs, ys, list_transform(a, lambda r: r[{len(columns) + 1}]) AS b FROM e),
         s AS (SELECT b, ys - list_inner_product(b, xs) AS b0 FROM f),
         t AS (SELECT y, {predicted} + b0 AS p FROM d, s WHERE NOT train)
    SELECT name, round(value, 6) AS value FROM ({unpivoted}
      UNION ALL SELECT 'intercept', b0 FROM s
      UNION ALL SELECT 'rmse', sqrt(avg((y - p) ** 2)) FROM t
      UNION ALL SELECT 'mse', avg((y - p) ** 2) FROM t
      UNION ALL SELECT 'mae', avg(abs(y - p)) FROM t
      UNION ALL SELECT 'r2', 1 - avg((y - p) ** 2) / var_pop(y) FROM t)"""


@query("crash_count_regression",
       _least_squares_sql(COUNT_FEATURES, COUNT_FLAGS, "trip_id || '|' || arc", 123))
def crash_count_regression(t):
    return rounded(crash_models.crash_count_regression(
        t["fx_event_rows"], t["fx_crashes"], COUNT_FEATURES, COUNT_FLAGS, ["trip_id", "arc"]
    ))


@query("crash_count_glm_job")
def crash_count_glm_job(t):
    return rounded(crash_models.crash_count_glm(
        t["fx_event_rows"], t["fx_crashes"], COUNT_CATEGORIES
    ))


# one category of two values is one 0/1 feature, so both models fit the two groups' means
@query("crash_count_glm", """
    WITH c AS (SELECT arc, count(*) AS y FROM fx_crashes GROUP BY arc),
         r AS (SELECT road_cycle, row_number() OVER (ORDER BY count(*) DESC, road_cycle) - 1 AS x
               FROM fx_event_rows GROUP BY road_cycle),
         g AS (SELECT x, count(*) AS n, sum(coalesce(y, 0)) AS s, avg(coalesce(y, 0)) AS m,
                      avg(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS z
               FROM fx_event_rows JOIN r USING (road_cycle) LEFT JOIN c USING (arc) GROUP BY x),
         p AS (SELECT a.n AS n0, a.s AS s0, a.m AS m0, a.z AS z0, b.n AS n1, b.s AS s1, b.m AS m1, b.z AS z1
               FROM g a, g b WHERE a.x = 0 AND b.x = 1)
    SELECT 'count' AS model, 'road_cycle_index' AS name, round(ln(m1 / m0), 4) AS value,
           round(sqrt(1 / s0 + 1 / s1), 4) AS std_error FROM p
    UNION ALL SELECT 'count', 'intercept', round(ln(m0), 4), round(sqrt(1 / s0), 4) FROM p
    UNION ALL SELECT 'crash', 'road_cycle_index', round(ln(z1 / (1 - z1)) - ln(z0 / (1 - z0)), 4),
           round(sqrt(1 / (n0 * z0 * (1 - z0)) + 1 / (n1 * z1 * (1 - z1))), 4) FROM p
    UNION ALL SELECT 'crash', 'intercept', round(ln(z0 / (1 - z0)), 4),
           round(sqrt(1 / (n0 * z0 * (1 - z0))), 4) FROM p""")
def crash_count_glm(t):
    report = crash_models.crash_count_glm(t["fx_event_rows"], t["fx_crashes"], ["road_cycle"])
    return rounded(report.where(F.col("name").isin("road_cycle_index", "intercept")), 4)
