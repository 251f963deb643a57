"""Class balance, exact splits, metrics and severity classifiers.

Metric operators are checked against SQL on three fixed rule classifiers
computed from the tables (deterministic predictions); the forests, whose
trees SQL cannot restate, are registered without an oracle and covered by
invariant tests instead.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gravis import SEVERITY_CLASSES
from gravis.operators import metrics as M
from gravis.operators import models as ML
from gravis.operators import neighbors as NB
from gravis.operators import sampling as S
from gravis.operators import search as SE
from gravis.plans import params as P
from gravis.plans.oracle import with_cases
from gravis.plans.q_stats import rollup_importance
from gravis.plans.registry import register
from gravis.session import cut_lineage
from gravis.sources.tables import cases

TARGET = "gravidade_lesao"
RULE_MODELS = ["regra_vitima", "regra_via", "regra_idade"]


def rule_predictions(spark, sf_dir):
    """(modelo, id, true, predicted) for three fixed rule classifiers."""
    c = cases(spark, sf_dir).select("id_sinistro", TARGET, "tipo_de_vitima", "tipo_via", "idade")
    v = F.col("tipo_de_vitima")
    r = F.col("tipo_via")
    a = F.col("idade")
    preds = {
        "regra_vitima": F.when(v == "1-URGENT", "FATAL").when(v == "2-HIGH", "GRAVE").otherwise("LEVE"),
        "regra_via": F.when(r == "AUTOMOBILE", "FATAL").when(r == "BUILDING", "GRAVE").otherwise("LEVE"),
        "regra_idade": F.when(a > 60, "FATAL").when(a <= 18, "GRAVE").otherwise("LEVE"),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("modelo"), e.alias("predito")) for k, e in preds.items()])
    return c.select("id_sinistro", TARGET, F.explode(arr).alias("m")).select(
        "m.modelo", "id_sinistro", TARGET, "m.predito")


_RULES_SQL = """preds AS (
  SELECT 'regra_vitima' AS modelo, id_sinistro, gravidade_lesao,
         CASE tipo_de_vitima WHEN '1-URGENT' THEN 'FATAL' WHEN '2-HIGH' THEN 'GRAVE' ELSE 'LEVE' END AS predito FROM cases
  UNION ALL
  SELECT 'regra_via', id_sinistro, gravidade_lesao,
         CASE tipo_via WHEN 'AUTOMOBILE' THEN 'FATAL' WHEN 'BUILDING' THEN 'GRAVE' ELSE 'LEVE' END FROM cases
  UNION ALL
  SELECT 'regra_idade', id_sinistro, gravidade_lesao,
         CASE WHEN idade > 60 THEN 'FATAL' WHEN idade <= 18 THEN 'GRAVE' ELSE 'LEVE' END FROM cases)"""

_REPORT_SQL = _RULES_SQL + """,
pc AS (SELECT modelo, gravidade_lesao AS t, predito AS p, count(*) AS n FROM preds GROUP BY ALL),
cls AS (SELECT * FROM (VALUES ('FATAL'), ('GRAVE'), ('LEVE')) v(classe)),
mods AS (SELECT DISTINCT modelo FROM pc),
base AS (
  SELECT m.modelo, c.classe,
         coalesce(sum(n) FILTER (WHERE t = c.classe AND p = c.classe), 0) AS tp,
         coalesce(sum(n) FILTER (WHERE t = c.classe), 0) AS support,
         coalesce(sum(n) FILTER (WHERE p = c.classe), 0) AS predicted
  FROM mods m CROSS JOIN cls c JOIN pc ON pc.modelo = m.modelo GROUP BY m.modelo, c.classe),
rep AS (
  SELECT modelo, classe, support,
         CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM base),
rep2 AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1
  FROM rep)"""


def _r9(c):
    return F.round(c, 9)


def _report(spark, sf_dir):
    pr = rule_predictions(spark, sf_dir)
    return pr, M.per_class_report(pr, TARGET, "predito", model_col="modelo")


@register("confusion_matrix", "M11,S7",
          with_cases("""SELECT modelo, gravidade_lesao,
       count(*) FILTER (WHERE predito = 'FATAL') AS pred_fatal,
       count(*) FILTER (WHERE predito = 'GRAVE') AS pred_grave,
       count(*) FILTER (WHERE predito = 'LEVE') AS pred_leve
FROM preds GROUP BY modelo, gravidade_lesao""", extra_ctes=_RULES_SQL))
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(rule_predictions(spark, sf_dir), TARGET, "predito", model_col="modelo")


@register("class_report", "M12",
          with_cases("""SELECT modelo, classe, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM rep2""", extra_ctes=_REPORT_SQL))
def class_report(spark, sf_dir):
    _, rep = _report(spark, sf_dir)
    return rep.select("modelo", "classe", _r9("precision").alias("precision"), _r9("recall").alias("recall"),
                      _r9("f1").alias("f1"), "support")


@register("fatal_grave_metrics", "M13,S6",
          with_cases("""SELECT modelo, classe, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(f1, 9) AS f1 FROM rep2 WHERE classe IN ('FATAL', 'GRAVE')""", extra_ctes=_REPORT_SQL))
def fatal_grave_metrics(spark, sf_dir):
    _, rep = _report(spark, sf_dir)
    return rep.filter(F.col("classe").isin("FATAL", "GRAVE")).select(
        "modelo", "classe", _r9("precision").alias("precision"), _r9("recall").alias("recall"), _r9("f1").alias("f1"))


_MACRO_SQL = _REPORT_SQL + """,
acc AS (SELECT modelo, sum(n) FILTER (WHERE t = p) / sum(n) AS accuracy FROM pc GROUP BY modelo),
macro AS (
  SELECT r.modelo, avg(f1) AS f1_macro, avg(recall) AS recall_macro, avg(precision) AS precision_macro,
         sum(f1 * support) / sum(support) AS f1_weighted, any_value(accuracy) AS accuracy
  FROM rep2 r JOIN acc a ON r.modelo = a.modelo GROUP BY r.modelo)"""


def _macro(spark, sf_dir):
    pr, rep = _report(spark, sf_dir)
    return M.summary_metrics(rep, pr, TARGET, "predito", model_col="modelo")


@register("macro_metrics", "M14,M15",
          with_cases("""SELECT modelo, round(f1_macro, 9) AS f1_macro, round(recall_macro, 9) AS recall_macro,
       round(precision_macro, 9) AS precision_macro, round(f1_weighted, 9) AS f1_weighted,
       round(accuracy, 9) AS accuracy FROM macro""", extra_ctes=_MACRO_SQL))
def macro_metrics(spark, sf_dir):
    m = _macro(spark, sf_dir)
    return m.select("modelo", *[_r9(c).alias(c) for c in
                                ["f1_macro", "recall_macro", "precision_macro", "f1_weighted", "accuracy"]])


@register("best_model", "M16",
          with_cases("""SELECT modelo, round(f1_macro, 9) AS f1_macro FROM macro
ORDER BY round(f1_macro, 9) DESC, CASE modelo WHEN 'regra_vitima' THEN 1 WHEN 'regra_via' THEN 2 ELSE 3 END
LIMIT 1""", extra_ctes=_MACRO_SQL))
def best_model(spark, sf_dir):
    m = _macro(spark, sf_dir).select("modelo", _r9("f1_macro").alias("f1_macro"))
    return M.best_model(m, "modelo", RULE_MODELS)


def _probabilities(spark, sf_dir):
    """Class probabilities derived from the keys (as a model's vector)."""
    c = cases(spark, sf_dir).select("id_sinistro", "idade", "mes_sinistro", "dia_sinistro")
    a = (F.col("idade") % 7 + 1).cast("double")
    b = F.col("mes_sinistro").cast("double")
    d = F.col("dia_sinistro").cast("double")
    tot = a + b + d
    return c.select("id_sinistro", array_to_vector(F.array(a / tot, b / tot, d / tot)).alias("probability"))


_PROB_SQL = """pr AS (SELECT id_sinistro,
  CAST(idade % 7 + 1 AS DOUBLE) / (CAST(idade % 7 + 1 AS DOUBLE) + mes_sinistro + dia_sinistro) AS p0,
  CAST(mes_sinistro AS DOUBLE) / (CAST(idade % 7 + 1 AS DOUBLE) + mes_sinistro + dia_sinistro) AS p1,
  CAST(dia_sinistro AS DOUBLE) / (CAST(idade % 7 + 1 AS DOUBLE) + mes_sinistro + dia_sinistro) AS p2 FROM cases)"""


@register("threshold_decision", "M6",
          with_cases("""SELECT id_sinistro,
       CASE WHEN p2 >= 0.3 THEN 'LEVE' WHEN p1 >= 0.3 THEN 'GRAVE' ELSE 'FATAL' END AS predito_referencia,
       CASE WHEN p0 >= 0.3 THEN 'FATAL' WHEN p1 >= 0.3 THEN 'GRAVE' ELSE 'LEVE' END AS predito_pretendido
FROM pr""", extra_ctes=_PROB_SQL))
def threshold_decision(spark, sf_dir):
    labels = list(SEVERITY_CLASSES)
    p = _probabilities(spark, sf_dir)
    p = ML.threshold_decision(p, "probability", labels, P.THRESHOLD_RULE_REFERENCE,
                              P.THRESHOLD_DEFAULT_REFERENCE, "predito_referencia")
    p = ML.threshold_decision(p, "probability", labels, P.THRESHOLD_RULE_INTENDED,
                              P.THRESHOLD_DEFAULT_INTENDED, "predito_pretendido")
    return p.select("id_sinistro", "predito_referencia", "predito_pretendido")


# --- class balance and exact sampling sizes ----------------------------------

@register("class_weights", "M3,A5",
          with_cases("""SELECT gravidade_lesao, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 9) AS weight,
       round(100.0 * n_c / sum(n_c) OVER (), 9) AS share_pct
FROM (SELECT gravidade_lesao, count(*) AS n_c FROM cases GROUP BY gravidade_lesao)"""))
def class_weights(spark, sf_dir):
    t = S.class_weight_table(cases(spark, sf_dir), TARGET)
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(0))
    return t.select(TARGET, "n_c", _r9("weight").alias("weight"),
                    _r9(F.lit(100.0) * F.col("n_c") / F.sum("n_c").over(w)).alias("share_pct"))


# The order key of the samplers, as SQL states it.
_KEY = f"md5(CAST(id_sinistro AS VARCHAR) || ':{P.SEED}')"
# Test rows per class: ceil(fraction * n) in all, what rounding down leaves to the largest remainders.
_QUOTAS = f"""quotas AS (
  SELECT gravidade_lesao, n, CAST(floor(share) AS BIGINT) + CASE WHEN row_number() OVER (
           ORDER BY share - floor(share) DESC, gravidade_lesao) <= in_all - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS n_test
  FROM (SELECT *, in_all * n / sum(n) OVER () AS share FROM (
    SELECT *, ceil(round({P.TEST_FRACTION} * sum(n) OVER (), 9)) AS in_all FROM (
      SELECT gravidade_lesao, count(*) AS n FROM cases GROUP BY gravidade_lesao))))"""
_RANKED = f"""ranked AS (
  SELECT id_sinistro, gravidade_lesao, count(*) OVER (PARTITION BY gravidade_lesao) AS n,
         row_number() OVER (PARTITION BY gravidade_lesao ORDER BY {_KEY}, id_sinistro) AS place FROM cases)"""


def _split(spark, sf_dir):
    return S.stratified_split(cases(spark, sf_dir), TARGET, ["id_sinistro"], P.TEST_FRACTION, P.SEED)


@register("split_sizes", "M1",
          with_cases("SELECT gravidade_lesao, n, n_test, n - n_test AS n_train FROM quotas", extra_ctes=_QUOTAS))
def split_sizes(spark, sf_dir):
    return _split(spark, sf_dir).groupBy(TARGET).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_test"), 1)).alias("n_test"),
        F.count(F.when(~F.col("is_test"), 1)).alias("n_train"))


@register("split_rows", "M1",
          with_cases("SELECT id_sinistro, gravidade_lesao, place <= n_test AS is_test FROM ranked JOIN quotas USING (gravidade_lesao)",
                     extra_ctes=_RANKED + ",\n" + _QUOTAS))
def split_rows(spark, sf_dir):
    """Which rows the stratified split holds out."""
    return _split(spark, sf_dir).select("id_sinistro", TARGET, "is_test")


def _undersampled(spark, sf_dir):
    return S.undersample(cases(spark, sf_dir), TARGET, ["id_sinistro"], P.SEED)


@register("undersample_sizes", "M7",
          with_cases("""SELECT gravidade_lesao, min(n) OVER () AS n_kept
FROM (SELECT gravidade_lesao, count(*) AS n FROM cases GROUP BY gravidade_lesao)"""))
def undersample_sizes(spark, sf_dir):
    return _undersampled(spark, sf_dir).groupBy(TARGET).agg(F.count(F.lit(1)).alias("n_kept"))


@register("undersample_rows", "M7",
          with_cases("SELECT id_sinistro, gravidade_lesao FROM ranked WHERE place <= (SELECT min(n) FROM ranked)",
                     extra_ctes=_RANKED))
def undersample_rows(spark, sf_dir):
    """Which rows the under-sampling keeps."""
    return _undersampled(spark, sf_dir).select("id_sinistro", TARGET)


def _folds(spark, sf_dir):
    return ML.stratified_folds(cases(spark, sf_dir), 3, P.SEED, label=TARGET)


@register("fold_sizes", "M9",
          with_cases("""SELECT gravidade_lesao, CAST(f.fold AS INTEGER) AS fold, (n - f.fold + 2) // 3 AS n
FROM (SELECT gravidade_lesao, count(*) AS n FROM cases GROUP BY gravidade_lesao)
CROSS JOIN (SELECT range AS fold FROM range(0, 3)) f"""))
def fold_sizes(spark, sf_dir):
    return _folds(spark, sf_dir).groupBy(TARGET, "fold").agg(F.count(F.lit(1)).alias("n"))


@register("fold_rows", "M9",
          with_cases("SELECT id_sinistro, gravidade_lesao, CAST((place - 1) % 3 AS INTEGER) AS fold FROM ranked", extra_ctes=_RANKED))
def fold_rows(spark, sf_dir):
    """Which fold every row lies in."""
    return _folds(spark, sf_dir).select("id_sinistro", TARGET, "fold")


# --- forests (no SQL oracle: randomised tree learners) ------------------------

def model_data(spark, sf_dir):
    """Features for every case, the exact stratified split, and lineage cut
    into the shared checkpoint folder (the forests re-read it many times)."""
    ff = ML.build_features(cases(spark, sf_dir))
    split = S.stratified_split(ff.data, "label", ["id_sinistro"], P.TEST_FRACTION, P.SEED)
    ff.data = cut_lineage(ML.spread(split))
    return ff


def _train_test(ff):
    train = ff.data.filter(~F.col("is_test")).drop("is_test")
    test = ff.data.filter(F.col("is_test")).drop("is_test")
    return train, test


@register("rf_predictions", "M2,M3,M5,N5,N8")
def rf_predictions(spark, sf_dir):
    ff = model_data(spark, sf_dir)
    train, test = _train_test(ff)
    model = ML.deep_forest(P.RF_TREES, P.RF_DEPTH).fit(ML.with_balanced_weights(train))
    pred = ML.predict_named(model, test, ff.labels)
    return pred.select("id_sinistro", TARGET, "predito", vector_to_array("probability").alias("probabilidades"))


@register("rf_importance", "M4,R4,R5,F11")
def rf_importance(spark, sf_dir):
    ff = model_data(spark, sf_dir)
    train, _ = _train_test(ff)
    model = ML.deep_forest(P.RF_TREES, P.RF_DEPTH, weight_col=None).fit(train)
    df = ML.importances(model, list(zip(ff.slot_names, ff.slot_source)), spark)
    from gravis.functions.scalar import risk_tier
    from gravis.operators.rates import ranked
    top = ranked(df, [F.col("importancia").desc(), F.col("variavel").asc()], k=P.TOP_FEATURES)
    return top.withColumn("nivel", risk_tier(F.col("importancia") * 100, P.IMPORTANCE_TIER_CUTS,
                                             P.IMPORTANCE_TIER_LABELS, strict=True))


@register("rf_importance_rollup", "M4,A28")
def rf_importance_rollup(spark, sf_dir):
    ff = model_data(spark, sf_dir)
    train, _ = _train_test(ff)
    model = ML.deep_forest(P.RF_TREES, P.RF_DEPTH, weight_col=None).fit(train)
    df = ML.importances(model, list(zip(ff.slot_names, ff.slot_source)), spark)
    per_source = df.groupBy(F.col("origem").alias("variavel")).agg(F.sum("importancia").alias("peso"))
    return rollup_importance(per_source)


def _eval(models_preds):
    """Stack (modelo, true, predicted) rows of several models and report."""
    stacked = None
    for name, p in models_preds:
        part = p.select(F.lit(name).alias("modelo"), TARGET, "predito")
        stacked = part if stacked is None else stacked.unionByName(part)
    rep = M.per_class_report(stacked, TARGET, "predito", model_col="modelo")
    return stacked, rep, M.summary_metrics(rep, stacked, TARGET, "predito", model_col="modelo")


@register("rf_threshold_metrics", "M6,M13")
def rf_threshold_metrics(spark, sf_dir):
    ff = model_data(spark, sf_dir)
    train, test = _train_test(ff)
    model = ML.deep_forest(P.RF_TREES, P.RF_DEPTH).fit(ML.with_balanced_weights(train))
    pred = ML.predict_named(model, test, ff.labels)
    ref = ML.threshold_decision(pred, "probability", ff.labels, P.THRESHOLD_RULE_REFERENCE,
                                P.THRESHOLD_DEFAULT_REFERENCE, "predito_ref")
    ref = ML.threshold_decision(ref, "probability", ff.labels, P.THRESHOLD_RULE_INTENDED,
                                P.THRESHOLD_DEFAULT_INTENDED, "predito_int")
    ref = cut_lineage(ref.select(TARGET, "predito", "predito_ref", "predito_int"))
    _, rep, _ = _eval([("Baseline", ref),
                       ("Baseline+limiar", ref.select(TARGET, F.col("predito_ref").alias("predito"))),
                       ("Baseline+limiar_pretendido", ref.select(TARGET, F.col("predito_int").alias("predito")))])
    return rep.filter(F.col("classe").isin("FATAL", "GRAVE"))


def _smote(train):
    return NB.smote(train, "label", "id_sinistro", "features", k=5, seed=P.SEED)


@register("smote_resample", "M8,J6")
def smote_resample(spark, sf_dir):
    """The training split raised to equal class sizes with synthetic rows
    interpolated towards approximate same-class nearest neighbours."""
    ff = model_data(spark, sf_dir)
    train, _ = _train_test(ff)
    res = _smote(train)
    return res.select("id_sinistro", TARGET, "label", "synthetic", "origem", "vizinho",
                      vector_to_array("features").alias("features"))


def _search(spark, sf_dir, preset):
    ff = model_data(spark, sf_dir)
    train, _ = _train_test(ff)
    rows = train.select("id_sinistro", "label", "features")
    found = SE.grid_search(rows, **P.REFERENCE_GRID, k=3, seed=P.SEED, preset=preset,
                           resample=lambda d: _smote(d).drop("synthetic", "origem", "vizinho"))
    listed = [(v["num_trees"], v["max_depth"], v["min_instances"], acc, v == found.best) for v, acc in found.scores]
    return spark.createDataFrame(listed, "num_trees int, max_depth int, min_instances int, cv_accuracy double, melhor boolean")


@register("grid_search", "M9,M10,S8")
def grid_search(spark, sf_dir):
    """The reference's search: folds of the training set raised by SMOTE (Q8, "before")."""
    return _search(spark, sf_dir, "before")


@register("grid_search_inside", "M9,M10")
def grid_search_inside(spark, sf_dir):
    """The same grid with SMOTE inside each training part (Q8, "inside"): held-out folds are real rows."""
    return _search(spark, sf_dir, "inside")


@register("model_comparison", "M2,M7,M8,M9,M10,M14,M15,M16,M17")
def model_comparison(spark, sf_dir):
    """Macro metrics of the five compared models, and the best of the first three (ties to Baseline)."""
    ff = model_data(spark, sf_dir)
    train, test = _train_test(ff)
    fitted = SE.fit_model_set(train, test, ff.labels, P.RF_TREES, P.RF_DEPTH, P.REFERENCE_GRID, seed=P.SEED,
                              forest=ML.deep_forest)
    counts = cut_lineage(M.pair_counts(fitted.predictions, TARGET, "predito", "modelo"))
    rep = M.report_from_counts(counts, TARGET, "predito", model_col="modelo")
    summ = M.summary_from_counts(rep, counts, TARGET, "predito", model_col="modelo")
    best = M.best_model(summ, "modelo", SE.CANDIDATES).select(F.col("modelo").alias("_best"))
    return summ.join(F.broadcast(best), F.col("modelo") == F.col("_best"), "left").select(
        "modelo", "f1_macro", "recall_macro", "precision_macro", "f1_weighted", "accuracy",
        F.col("_best").isNotNull().alias("melhor"))


@register("logistic_curve", "A26")
def logistic_curve(spark, sf_dir):
    """Logistic fit of is-FATAL on age (0/1 target), evaluated at every
    distinct age in the data."""
    c = cases(spark, sf_dir).filter(F.col("idade").isNotNull())
    d = c.select(F.col("idade").cast("double").alias("idade"),
                 (F.col(TARGET) == "FATAL").cast("double").alias("label"))
    asm = VectorAssembler(inputCols=["idade"], outputCol="features")
    model = LogisticRegression(maxIter=100, tol=1e-10).fit(asm.transform(d))
    ages = asm.transform(d.select("idade").distinct())
    out = model.transform(ages).select("idade", vector_to_array("probability")[1].alias("p_fatal"))
    return out.withColumn("intercepto", F.lit(float(model.intercept))).withColumn(
        "coeficiente", F.lit(float(model.coefficients[0])))


@register("logistic_score_equations", "A26",
          with_cases("""SELECT round(avg(CASE WHEN gravidade_lesao = 'FATAL' THEN 1.0 ELSE 0.0 END), 5) AS mean_p,
       round(avg(CASE WHEN gravidade_lesao = 'FATAL' THEN idade ELSE 0.0 END), 3) AS mean_age_p, count(*) AS n
FROM cases WHERE idade IS NOT NULL"""))
def logistic_score_equations(spark, sf_dir):
    """What the maximum-likelihood curve must satisfy: mean p = mean y, mean age p = mean age y."""
    curve = logistic_curve(spark, sf_dir).select(F.col("idade").alias("_age"), "p_fatal")
    ages = cases(spark, sf_dir).filter(F.col("idade").isNotNull()).groupBy(F.col("idade").cast("double").alias("_age")).agg(
        F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    return ages.join(curve, "_age").agg(
        F.round(F.sum(F.col("n") * F.col("p_fatal")) / n, 5).alias("mean_p"),
        F.round(F.sum(F.col("n") * F.col("_age") * F.col("p_fatal")) / n, 3).alias("mean_age_p"), n.alias("n"))


@register("sample_invariants", "P17",
          with_cases("""SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS distinct_ids, least(count(*), 1000) AS known
FROM cases"""))
def sample_invariants(spark, sf_dir):
    """The fixed-size sample: its size, its different ids, and those that are case ids."""
    ids = cases(spark, sf_dir).select("id_sinistro")
    got = cut_lineage(S.seeded_sample(ids, 1000, ["id_sinistro"], P.SEED))
    # 1000 ids go to the cases, which stay where they are
    met = ids.join(F.broadcast(got.distinct()), "id_sinistro", "left_semi").distinct()
    known = got.join(met, "id_sinistro", "left_semi")
    return got.select("id_sinistro", F.lit(0).alias("k")).unionByName(known.select("id_sinistro", F.lit(1).alias("k"))).agg(
        F.count(F.when(F.col("k") == 0, 1)).alias("n"), F.count_distinct("id_sinistro").alias("distinct_ids"),
        F.count(F.when(F.col("k") == 1, 1)).alias("known"))


def _run_summary_sql():
    from gravis.plans.q_stats import PREDICTIVE_FEATURES, _CODED_SQL, _corr_sql_expr
    rows = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS variavel, round({_corr_sql_expr(c, 'gravidade_num')}, 9) AS r FROM coded"
        for c in PREDICTIVE_FEATURES)
    band = ("CASE WHEN idade > 0 AND idade <= 18 THEN '0-18' WHEN idade > 18 AND idade <= 25 THEN '19-25' "
            "WHEN idade > 25 AND idade <= 35 THEN '26-35' WHEN idade > 35 AND idade <= 45 THEN '36-45' "
            "WHEN idade > 45 AND idade <= 60 THEN '46-60' WHEN idade > 60 AND idade <= 100 THEN '60+' "
            "ELSE 'DESCONHECIDO' END")
    legal = "CASE WHEN idade < 18 THEN 'MENOR' WHEN idade >= 18 THEN 'MAIOR' ELSE 'DESCONHECIDO' END"
    return with_cases(f"""SELECT (SELECT count(*) FROM cases) AS registros,
       (SELECT count(*) FROM cases) AS registros_modelo,
       CAST((SELECT count(DISTINCT municipio) + count(DISTINCT tipo_via) + count(DISTINCT tipo_de_vitima)
               + count(DISTINCT {legal}) + count(DISTINCT {band}) + 6 FROM cases) AS INTEGER) AS features,
       (SELECT string_agg(variavel, ', ' ORDER BY posicao) FROM (
          SELECT variavel, row_number() OVER (ORDER BY abs(r) DESC, variavel) AS posicao
          FROM ({rows}) WHERE r IS NOT NULL) WHERE posicao <= 3) AS top3""", extra_ctes=_CODED_SQL)


@register("run_summary", "M17,P19", _run_summary_sql())
def run_summary(spark, sf_dir):
    """Rows analysed, rows modelled, feature count and the three strongest
    leak-free variables by |r| with the target."""
    from gravis.plans.q_stats import leakfree_correlation_ranking
    src = ML.with_person_bands(cases(spark, sf_dir))
    slots = [F.count_distinct(c).alias(c) for c in ML.CATEGORICAL]  # one slot a category, and one a number
    row = src.agg(F.count(F.lit(1)).alias("n"), *slots).first()
    features = sum(row[c] for c in ML.CATEGORICAL) + 1 + len(ML.SCALED) + len(ML.RAW_NUMERIC)
    top = leakfree_correlation_ranking(spark, sf_dir).filter(F.col("posicao") <= 3)
    top3 = top.agg(F.array_join(F.sort_array(F.collect_list(F.struct("posicao", "variavel"))).getField("variavel"),
                                ", ").alias("top3"))
    return top3.select(F.lit(row["n"]).cast("long").alias("registros"),
                       F.lit(row["n"]).cast("long").alias("registros_modelo"),
                       F.lit(features).alias("features"), "top3")
