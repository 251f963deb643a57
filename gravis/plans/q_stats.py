"""Descriptive statistics, distributions, correlations, regression and tests."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravis.operators import encode as E
from gravis.operators import rates as R
from gravis.operators import stats as S
from gravis.plans import params as P
from gravis.plans.oracle import with_cases
from gravis.plans.registry import register
from gravis.sources.tables import cases, cases_dirty

TARGET = "gravidade_lesao"
STRING_FEATURES = ["municipio", "regiao_administrativa", "tipo_via", "tipo_de_vitima", "sexo"]
NUMERIC_FEATURES = ["id_sinistro", "idade", "ano_sinistro", "mes_sinistro", "dia_sinistro", "valor"]
ALL_FEATURES = STRING_FEATURES + NUMERIC_FEATURES
# Leak-free view: identifiers and scope columns removed (the deny list).
PREDICTIVE_FEATURES = ["municipio", "tipo_via", "tipo_de_vitima", "sexo", "idade",
                       "ano_sinistro", "mes_sinistro", "dia_sinistro", "valor"]

# Variable families of the importance roll-up.
FAMILIES = {
    "TEMPORAL": ["dia_sinistro", "mes_sinistro", "ano_sinistro"],
    "DEMOGRAFICO": ["idade", "sexo", "faixa_etaria_legal", "faixa_etaria_demografica"],
    "GEOGRAFICO": ["municipio"],
    "COMPORTAMENTAL": ["tipo_de_vitima", "tipo_via"],
}


def coded_cases(spark, sf_dir):
    """Cases with every text column replaced by its sorted-order code and the
    target code ``gravidade_num`` (FATAL=0, GRAVE=1, LEVE=2)."""
    c = cases(spark, sf_dir)
    cols = STRING_FEATURES + [TARGET]
    out, _ = E.ordinal_encode(c, cols, suffix="__code")
    keep = [F.col(f"{x}__code").cast("double").alias(x) for x in STRING_FEATURES]
    keep.append(F.col(f"{TARGET}__code").cast("double").alias("gravidade_num"))
    keep += [F.col(x) for x in NUMERIC_FEATURES]
    return out.select(TARGET, *keep)


_CODED_SQL = ("coded AS (SELECT gravidade_lesao, "
              + ", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS {c}" for c in STRING_FEATURES)
              + ", CAST(dense_rank() OVER (ORDER BY gravidade_lesao) - 1 AS DOUBLE) AS gravidade_num, "
              + ", ".join(NUMERIC_FEATURES) + " FROM cases)")


def _r9(c):
    return F.round(c, 9)


# --- grouped descriptive statistics ---------------------------------------

@register("std_by_severity", "A12,F7",
          with_cases("SELECT gravidade_lesao, round(stddev_samp(idade), 9) AS std, "
                     "round_even(stddev_samp(idade), 2) AS std_2 FROM cases GROUP BY gravidade_lesao"))
def std_by_severity(spark, sf_dir):
    c = cases(spark, sf_dir)
    out = S.std_by_group(c, "idade", TARGET, places=None)
    two = S.std_by_group(c, "idade", TARGET, places=2).withColumnRenamed("std", "std_2")
    return out.select(TARGET, _r9("std").alias("std")).join(two, TARGET)


@register("describe_by_severity", "A13,A15",
          with_cases("""SELECT gravidade_lesao, count(idade) AS count, round(avg(idade), 9) AS mean,
       round(stddev_samp(idade), 9) AS std, CAST(min(idade) AS DOUBLE) AS min,
       quantile_cont(idade, 0.25) AS q25, quantile_cont(idade, 0.5) AS q50,
       quantile_cont(idade, 0.75) AS q75, CAST(max(idade) AS DOUBLE) AS max
FROM cases WHERE idade IS NOT NULL GROUP BY gravidade_lesao"""))
def describe_by_severity(spark, sf_dir):
    d = S.describe_by_group(cases(spark, sf_dir), "idade", TARGET)
    return d.withColumn("mean", _r9("mean")).withColumn("std", _r9("std"))


@register("box_summary", "A22",
          with_cases("""SELECT c.gravidade_lesao, count(*) AS n, q1, md AS median, q3,
       CAST(min(idade) FILTER (WHERE idade >= q1 - 1.5 * (q3 - q1) AND idade <= q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_low,
       CAST(max(idade) FILTER (WHERE idade >= q1 - 1.5 * (q3 - q1) AND idade <= q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_high,
       count(*) FILTER (WHERE NOT (idade >= q1 - 1.5 * (q3 - q1) AND idade <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM cases_dirty c JOIN q ON c.gravidade_lesao = q.g
WHERE idade IS NOT NULL GROUP BY c.gravidade_lesao, q1, md, q3""", dirty=True,
                     extra_ctes="""q AS (SELECT gravidade_lesao AS g, quantile_cont(idade, 0.25) AS q1,
       quantile_cont(idade, 0.5) AS md, quantile_cont(idade, 0.75) AS q3
FROM cases_dirty WHERE idade IS NOT NULL AND gravidade_lesao IS NOT NULL GROUP BY gravidade_lesao)"""))
def box_summary(spark, sf_dir):
    return S.box_summary(cases_dirty(spark, sf_dir), "idade", TARGET)


@register("box_severity_by_victim", "A22,N11",
          with_cases("""SELECT c.tipo_de_vitima, count(*) AS n, q1, md AS median, q3,
       CAST(min(g) FILTER (WHERE g >= q1 - 1.5 * (q3 - q1) AND g <= q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_low,
       CAST(max(g) FILTER (WHERE g >= q1 - 1.5 * (q3 - q1) AND g <= q3 + 1.5 * (q3 - q1)) AS DOUBLE) AS whisker_high,
       count(*) FILTER (WHERE NOT (g >= q1 - 1.5 * (q3 - q1) AND g <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM sc c JOIN q ON c.tipo_de_vitima = q.v GROUP BY c.tipo_de_vitima, q1, md, q3""",
                     extra_ctes="""sc AS (SELECT tipo_de_vitima,
       CASE gravidade_lesao WHEN 'FATAL' THEN 3 WHEN 'GRAVE' THEN 2 ELSE 1 END AS g FROM cases),
q AS (SELECT tipo_de_vitima AS v, quantile_cont(g, 0.25) AS q1, quantile_cont(g, 0.5) AS md,
       quantile_cont(g, 0.75) AS q3 FROM sc GROUP BY tipo_de_vitima)"""))
def box_severity_by_victim(spark, sf_dir):
    """Box numbers of the 1-2-3 severity score per victim type."""
    from gravis.functions.scalar import severity_score
    c = cases(spark, sf_dir).select("tipo_de_vitima", severity_score(TARGET).alias("g"))
    return S.box_summary(c, "g", "tipo_de_vitima")


def _score_box_sql(key, src):
    """Oracle of box numbers of the severity score per ``key`` of ``src``."""
    inside = "g >= q1 - 1.5 * (q3 - q1) AND g <= q3 + 1.5 * (q3 - q1)"
    return (f"""SELECT c.{key}, count(*) AS n, q1, md AS median, q3,
       CAST(min(g) FILTER (WHERE {inside}) AS DOUBLE) AS whisker_low,
       CAST(max(g) FILTER (WHERE {inside}) AS DOUBLE) AS whisker_high,
       count(*) FILTER (WHERE NOT ({inside})) AS outliers
FROM sc c JOIN q ON c.{key} = q.v GROUP BY c.{key}, q1, md, q3""",
            f"""sc AS (SELECT {key}, CASE gravidade_lesao WHEN 'FATAL' THEN 3 WHEN 'GRAVE' THEN 2 ELSE 1 END AS g FROM {src}),
q AS (SELECT {key} AS v, quantile_cont(g, 0.25) AS q1, quantile_cont(g, 0.5) AS md,
       quantile_cont(g, 0.75) AS q3 FROM sc GROUP BY {key})""")


_SEX_BOX = _score_box_sql("sexo", "cases")


@register("box_severity_by_sex", "A22,N11", with_cases(_SEX_BOX[0], extra_ctes=_SEX_BOX[1]))
def box_severity_by_sex(spark, sf_dir):
    from gravis.functions.scalar import severity_score
    return S.box_summary(cases(spark, sf_dir).select("sexo", severity_score(TARGET).alias("g")), "g", "sexo")


_BAND_SQL = "CASE " + " ".join(
    f"WHEN idade > {lo} AND idade <= {hi} THEN '{t}'" for lo, hi, t in (
        (0, 18, "0-18"), (18, 25, "19-25"), (25, 35, "26-35"), (35, 45, "36-45"), (45, 60, "46-60"), (60, 100, "60+"))) + " END"
_BAND_BOX = _score_box_sql("faixa", "top_banded")


@register("box_severity_by_band", "A22,N11,N12", with_cases(_BAND_BOX[0], extra_ctes=f"""banded AS (
  SELECT gravidade_lesao, {_BAND_SQL} AS faixa FROM cases),
top_bands AS (SELECT faixa FROM banded WHERE faixa IS NOT NULL GROUP BY faixa ORDER BY count(*) DESC, faixa LIMIT {P.TOP_BANDS}),
top_banded AS (SELECT * FROM banded WHERE faixa IN (SELECT faixa FROM top_bands)),
""" + _BAND_BOX[1]))
def box_severity_by_band(spark, sf_dir):
    """Box numbers of the severity score in the most frequent age bands."""
    from gravis.functions.scalar import age_band, severity_score
    c = cases(spark, sf_dir).select(age_band("idade").alias("faixa"), severity_score(TARGET).alias("g")).filter("faixa IS NOT NULL")
    top = c.groupBy("faixa").count().orderBy(F.desc("count"), "faixa").limit(P.TOP_BANDS)
    return S.box_summary(c.join(F.broadcast(top), "faixa", "left_semi"), "g", "faixa")  # a handful of bands


# --- distributions ----------------------------------------------------------

def _hist_sql(src_cte, value, bins):
    return with_cases(f"""SELECT grid.bin, lo + (grid.bin - 1) * ((hi - lo) / {bins}) AS bin_lo,
       lo + grid.bin * ((hi - lo) / {bins}) AS bin_hi, count(b.bin) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(1, {bins + 1})) grid CROSS JOIN s
LEFT JOIN b ON grid.bin = b.bin WHERE lo IS NOT NULL GROUP BY grid.bin, lo, hi""",
                      extra_ctes=src_cte + f""",
s AS (SELECT CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM src WHERE {value} IS NOT NULL),
b AS (SELECT CAST(least(floor(({value} - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER) + 1 AS bin
      FROM src, s WHERE {value} IS NOT NULL)""")


@register("age_histogram", "A23", _hist_sql("src AS (SELECT idade FROM cases)", "idade", P.AGE_BINS))
def age_histogram(spark, sf_dir):
    return S.histogram(cases(spark, sf_dir), "idade", P.AGE_BINS)


def _muni_rate_cte():
    from gravis.plans.q_rates import sev_sql
    return sev_sql(["municipio"], scale=100, name="m0") + ",\nsrc AS (SELECT fatal_rate FROM m0 WHERE total >= 600)"


@register("rate_histogram", "A23,P9", _hist_sql(_muni_rate_cte(), "fatal_rate", P.RATE_BINS))
def rate_histogram(spark, sf_dir):
    m = R.min_support(R.severity_matrix(cases(spark, sf_dir), ["municipio"], scale=100), P.MIN_SUPPORT)
    return S.histogram(m, "fatal_rate", P.RATE_BINS)


_NP = P.DENSITY_POINTS


@register("age_density", "A24",
          with_cases(f"""SELECT ponto, round(x, 9) AS x,
       round(sum(exp(-pow((x - idade) / bw, 2) / 2.0)) * (1.0 / (n * bw * sqrt(2.0 * pi()))), 9) AS densidade
FROM g, cases WHERE idade IS NOT NULL GROUP BY ponto, x, bw, n""",
                     extra_ctes=f"""s AS (SELECT count(*) AS n, stddev_samp(idade) AS sd, CAST(min(idade) AS DOUBLE) AS lo,
       CAST(max(idade) AS DOUBLE) AS hi FROM cases WHERE idade IS NOT NULL),
g AS (SELECT CAST(range AS INTEGER) AS ponto, lo + range * ((hi - lo) / {_NP - 1}) AS x,
       sd * pow(n, -1.0 / 5.0) AS bw, n FROM range(0, {_NP}), s)"""))
def age_density(spark, sf_dir):
    d = S.gaussian_density(cases(spark, sf_dir), "idade", _NP)
    return d.select("ponto", _r9("x").alias("x"), _r9("densidade").alias("densidade"))


# --- correlation -------------------------------------------------------------

def _corr_sql_expr(x, y):
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _ranking_sql(features):
    rows = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS variavel, round({_corr_sql_expr(c, 'gravidade_num')}, 9) AS r FROM coded" for c in features)
    return with_cases(f"""SELECT variavel, r, abs(r) AS abs_r,
       CAST(row_number() OVER (ORDER BY abs(r) DESC, variavel) AS INTEGER) AS posicao
FROM ({rows}) WHERE r IS NOT NULL""", extra_ctes=_CODED_SQL)


def _target_corrs(spark, sf_dir, features):
    """r of each feature (text as sorted-order code) with the target code,
    from one scan of the case view."""
    text = [c for c in features if c in STRING_FEATURES]
    num = [c for c in features if c in NUMERIC_FEATURES]
    return S.target_correlations(cases(spark, sf_dir), TARGET, text, num)


def _ranking(spark, sf_dir, features):
    corrs = _target_corrs(spark, sf_dir, features)
    return S.correlation_ranking(corrs.select("variavel", _r9("r").alias("r")))


@register("correlation_ranking", "A16,A17,R3,R5,N7,F6", _ranking_sql(ALL_FEATURES))
def correlation_ranking(spark, sf_dir):
    return _ranking(spark, sf_dir, ALL_FEATURES)


@register("leakfree_correlation_ranking", "A17,P12,R3,R5", _ranking_sql(PREDICTIVE_FEATURES))
def leakfree_correlation_ranking(spark, sf_dir):
    return _ranking(spark, sf_dir, PREDICTIVE_FEATURES)


MATRIX_VARS = ["gravidade_num", "tipo_de_vitima", "sexo", "municipio", "tipo_via",
               "regiao_administrativa", "idade", "mes_sinistro", "dia_sinistro", "ano_sinistro"]


def _matrix_sql():
    rows = []
    for i, a in enumerate(MATRIX_VARS):
        for b in MATRIX_VARS[i:]:
            e = f"round({_corr_sql_expr(a, b)}, 9)"
            rows.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, {e} AS r FROM coded")
            if a != b:
                rows.append(f"SELECT '{b}', '{a}', {e} FROM coded")
    return with_cases("\nUNION ALL\n".join(rows), extra_ctes=_CODED_SQL)


@register("correlation_matrix", "A18", _matrix_sql())
def correlation_matrix(spark, sf_dir):
    m = S.correlation_matrix(coded_cases(spark, sf_dir), MATRIX_VARS)
    return m.select("var_a", "var_b", _r9("r").alias("r"))


_TARGET_ROWS = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variavel, round({_corr_sql_expr(c, 'gravidade_num')}, 9) AS r FROM coded" for c in PREDICTIVE_FEATURES)


def _top_matrix_sql():
    names = ["gravidade_num", *PREDICTIVE_FEATURES]
    rows = "\nUNION ALL\n".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, round({_corr_sql_expr(a, b)}, 9) AS r FROM coded"
                                for a in names for b in names)
    return with_cases(f"""SELECT * FROM ({rows})
WHERE var_a IN (SELECT variavel FROM picked) AND var_b IN (SELECT variavel FROM picked)""",
                      extra_ctes=_CODED_SQL + f""",
picked AS (SELECT 'gravidade_num' AS variavel UNION ALL SELECT variavel FROM (
  SELECT variavel FROM ({_TARGET_ROWS}) WHERE r IS NOT NULL ORDER BY abs(r) DESC, variavel LIMIT {P.TOP_CORRELATED}))""")


@register("top_correlation_matrix", "A18,R3,R4", _top_matrix_sql())
def top_correlation_matrix(spark, sf_dir):
    """Correlations among the target and the variables that correlate most with it."""
    top = _ranking(spark, sf_dir, PREDICTIVE_FEATURES).filter(F.col("posicao") <= P.TOP_CORRELATED)
    names = ["gravidade_num", *[r["variavel"] for r in top.select("variavel").collect()]]  # TOP_CORRELATED names
    m = S.correlation_matrix(coded_cases(spark, sf_dir), names)
    return m.select("var_a", "var_b", _r9("r").alias("r"))


def _top3_sql():
    rows = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS variavel, CAST({c} AS VARCHAR) AS chave, count(*) FILTER (WHERE gravidade_lesao = 'FATAL') / count(*) AS fatal_rate,
       count(*) FILTER (WHERE gravidade_lesao = 'GRAVE') / count(*) AS grave_rate,
       count(*) FILTER (WHERE gravidade_lesao = 'LEVE') / count(*) AS leve_rate, count(*) AS total
FROM cases WHERE {c} IS NOT NULL AND gravidade_lesao IS NOT NULL GROUP BY {c}""" for c in PREDICTIVE_FEATURES if c != "valor")
    return with_cases(f"""SELECT * FROM ({rows}) WHERE variavel IN (
  SELECT variavel FROM ({_TARGET_ROWS}) WHERE r IS NOT NULL AND variavel <> 'valor' ORDER BY abs(r) DESC, variavel LIMIT 3)""",
                      extra_ctes=_CODED_SQL)


@register("top3_severity_shares", "A8,R4", _top3_sql())
def top3_severity_shares(spark, sf_dir):
    """Row-normalised severity tables of the three predictive variables that
    correlate most with the target (money values apart), stacked."""
    names = [c for c in PREDICTIVE_FEATURES if c != "valor"]
    top = [r["variavel"] for r in _ranking(spark, sf_dir, names).filter("posicao <= 3").select("variavel").collect()]
    parts = [m.select(F.lit(c).alias("variavel"), F.col(c).cast("string").alias("chave"), "fatal_rate", "grave_rate",
                      "leve_rate", "total") for c, m in zip(top, R.severity_matrices(cases(spark, sf_dir), [[c] for c in top]))]
    return functools.reduce(DataFrame.unionByName, parts)


@register("regression_lines", "A25",
          with_cases("\nUNION ALL\n".join(
              f"SELECT '{c}' AS variavel, round(regr_slope(gravidade_num, {c}), 9) AS slope, "
              f"round(regr_intercept(gravidade_num, {c}), 6) AS intercept, "
              f"round(regr_r2(gravidade_num, {c}), 9) AS r2, CAST(regr_count(gravidade_num, {c}) AS BIGINT) AS n FROM coded"
              for c in PREDICTIVE_FEATURES), extra_ctes=_CODED_SQL))
def regression_lines(spark, sf_dir):
    text = [c for c in PREDICTIVE_FEATURES if c in STRING_FEATURES]
    num = [c for c in PREDICTIVE_FEATURES if c in NUMERIC_FEATURES]
    r = S.target_regressions(cases(spark, sf_dir), TARGET, text, num)
    return r.select("variavel", _r9("slope").alias("slope"), F.round("intercept", 6).alias("intercept"),
                    _r9("r2").alias("r2"), F.col("n").cast("long").alias("n"))


def _f_sql():
    per = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS variavel, gravidade_lesao AS g, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v "
        f"FROM coded WHERE {c} IS NOT NULL AND gravidade_lesao IS NOT NULL GROUP BY gravidade_lesao"
        for c in PREDICTIVE_FEATURES)
    return with_cases("""SELECT p.variavel, CAST(k AS BIGINT) AS grupos, CAST(tn AS BIGINT) AS n,
       CAST(k - 1 AS BIGINT) AS df1, CAST(tn - k AS BIGINT) AS df2,
       round((sum(p.n * pow(m - grand, 2)) / (k - 1)) / (sum(p.n * v) / (tn - k)), 9) AS f,
       CASE WHEN k = 2 THEN 'T-test' ELSE 'ANOVA' END AS teste
FROM per p JOIN tot t ON p.variavel = t.variavel
GROUP BY p.variavel, k, tn, grand HAVING k >= 2""",
                      extra_ctes=_CODED_SQL + f",\nper AS ({per}),\n"
                      "tot AS (SELECT variavel, sum(n) AS tn, count(*) AS k, sum(n * m) / sum(n) AS grand "
                      "FROM per GROUP BY variavel)")


@register("group_f_test", "A27", _f_sql())
def group_f_test(spark, sf_dir):
    text = [c for c in PREDICTIVE_FEATURES if c in STRING_FEATURES]
    num = [c for c in PREDICTIVE_FEATURES if c in NUMERIC_FEATURES]
    f = S.target_anova(cases(spark, sf_dir), TARGET, text, num)
    return f.withColumn("f", _r9("f"))


@register("group_significance", "A27,F12",
          _f_sql().replace("SELECT p.variavel", "SELECT *, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' "
                           "WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS significancia FROM (SELECT *, "
                           "round(pow(1 + 2 * f / df2, -df2 / 2.0), 9) AS p_value FROM (SELECT p.variavel", 1) + "))")
def group_significance(spark, sf_dir):
    """F test with p-value and stars; three classes give df1 = 2, whose
    p-value the oracle states in closed form."""
    text = [c for c in PREDICTIVE_FEATURES if c in STRING_FEATURES]
    num = [c for c in PREDICTIVE_FEATURES if c in NUMERIC_FEATURES]
    f = S.target_anova(cases(spark, sf_dir), TARGET, text, num).withColumn("f", _r9("f"))
    return S.with_p_value(f).withColumn("p_value", _r9("p_value"))


# --- importance roll-up -------------------------------------------------------

def family_of(col):
    expr = None
    for fam, members in FAMILIES.items():
        cond = F.col(col).isin(members)
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    return expr.otherwise(F.lit("OUTRO"))


def rollup_importance(weights, feature="variavel", weight="peso"):
    """Sum feature weights by family with each family's share (percent)."""
    fam = weights.withColumn("familia", family_of(feature))
    g = fam.groupBy("familia").agg(F.sum(weight).alias("soma"), F.count(F.lit(1)).alias("variaveis"))
    total = F.sum("soma").over(Window.partitionBy())  # a row per family
    return g.select("familia", "soma", "variaveis", F.try_divide(F.lit(100.0) * F.col("soma"), total).alias("share_pct"))


def _family_case(col):
    parts = " ".join(f"WHEN {col} IN ({', '.join(repr(m) for m in ms)}) THEN '{f}'" for f, ms in FAMILIES.items())
    return f"CASE {parts} ELSE 'OUTRO' END"


@register("importance_rollup", "A28",
          with_cases(f"""SELECT familia, round(sum(peso), 9) AS soma, count(*) AS variaveis,
       round(100.0 * sum(peso) / (SELECT sum(peso) FROM w), 6) AS share_pct
FROM (SELECT *, {_family_case('variavel')} AS familia FROM w) GROUP BY familia""",
                     extra_ctes=_CODED_SQL + ",\nw AS (" + "\nUNION ALL\n".join(
                         f"SELECT '{c}' AS variavel, round(abs({_corr_sql_expr(c, 'gravidade_num')}), 9) AS peso FROM coded"
                         for c in PREDICTIVE_FEATURES) + ")"))
def importance_rollup(spark, sf_dir):
    """Roll-up of per-variable weights into families; here the weights are
    |r| with the target, so the roll-up is checkable against SQL (the model
    importances go through the same function in ``rf_importance_rollup``)."""
    corrs = _target_corrs(spark, sf_dir, PREDICTIVE_FEATURES)
    w = corrs.select("variavel", _r9(F.abs("r")).alias("peso"))
    out = rollup_importance(w)
    return out.select("familia", _r9("soma").alias("soma"), "variaveis",
                      F.round("share_pct", 6).alias("share_pct"))
