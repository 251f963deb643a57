"""Rate tables by time, place and group; rankings; comparisons; KPI row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravis.functions.scalar import month_abbr, ratio, risk_tier
from gravis.operators import rates as R
from gravis.plans import params as P
from gravis.plans.oracle import with_cases
from gravis.plans.registry import register
from gravis.sources.tables import cases


def sev_sql(keys, src="cases", scale=1, name="rates", extra_where=""):
    """Oracle text of a severity matrix (counts, total, rates) as CTEs."""
    kl = ", ".join(keys)
    conds = [f"{k} IS NOT NULL" for k in keys] + ["gravidade_lesao IS NOT NULL"]
    if extra_where:
        conds.append(extra_where)
    mul = "" if scale == 1 else f"{scale} * "
    return f"""{name}_n AS (
  SELECT {kl},
         count(*) FILTER (WHERE gravidade_lesao = 'FATAL') AS n_fatal,
         count(*) FILTER (WHERE gravidade_lesao = 'GRAVE') AS n_grave,
         count(*) FILTER (WHERE gravidade_lesao = 'LEVE') AS n_leve,
         count(*) AS total
  FROM {src} WHERE {' AND '.join(conds)} GROUP BY {kl}),
{name} AS (
  SELECT *, {mul}n_fatal / total AS fatal_rate, {mul}n_grave / total AS grave_rate,
         {mul}n_leve / total AS leve_rate FROM {name}_n)"""


def _rank(order_sql):
    return f"CAST(row_number() OVER (ORDER BY {order_sql}) AS INTEGER) AS posicao"


def _matrix(spark, sf_dir, keys, scale=1, df=None):
    return R.severity_matrix(df if df is not None else cases(spark, sf_dir), keys, scale=scale)


def _desc(col, key):
    return [F.col(col).desc(), F.col(key).asc()]


# --- one matrix per calendar or place key ---------------------------------

@register("severity_by_month", "A6,A7,R2,R5",
          with_cases(f"SELECT *, {_rank('fatal_rate DESC, mes_sinistro')} FROM rates",
                     extra_ctes=sev_sql(["mes_sinistro"])))
def severity_by_month(spark, sf_dir):
    m = _matrix(spark, sf_dir, ["mes_sinistro"])
    return R.ranked(m, _desc("fatal_rate", "mes_sinistro"))


@register("severity_by_day", "A6,A7,R2,R5",
          with_cases(f"SELECT *, {_rank('fatal_rate DESC, dia_sinistro')} FROM rates",
                     extra_ctes=sev_sql(["dia_sinistro"])))
def severity_by_day(spark, sf_dir):
    m = _matrix(spark, sf_dir, ["dia_sinistro"])
    return R.ranked(m, _desc("fatal_rate", "dia_sinistro"))


_WEEK_CTE = """wk AS (SELECT *, CAST((dia_sinistro - 1) // 7 + 1 AS INTEGER) AS semana_mes FROM cases)"""


@register("severity_by_week", "A6,A7,F4",
          with_cases("SELECT * FROM rates",
                     extra_ctes=_WEEK_CTE + ",\n" + sev_sql(["semana_mes"], src="wk", scale=100)))
def severity_by_week(spark, sf_dir):
    df = R.with_week_of_month(cases(spark, sf_dir))
    return R.severity_matrix(df, ["semana_mes"], scale=100)


@register("severity_by_municipality", "A6,A7,A11,F8,J5",
          with_cases("SELECT * FROM rates", extra_ctes=sev_sql(["municipio"], scale=100)))
def severity_by_municipality(spark, sf_dir):
    return _matrix(spark, sf_dir, ["municipio"], scale=100)


@register("severity_by_victim", "A6,A7,A8",
          with_cases("SELECT * FROM rates", extra_ctes=sev_sql(["tipo_de_vitima"], scale=100)))
def severity_by_victim(spark, sf_dir):
    return _matrix(spark, sf_dir, ["tipo_de_vitima"], scale=100)


@register("severity_by_sex", "A6,A7,A8",
          with_cases("SELECT * FROM rates", extra_ctes=sev_sql(["sexo"], scale=100)))
def severity_by_sex(spark, sf_dir):
    return _matrix(spark, sf_dir, ["sexo"], scale=100)


@register("flagged_municipalities", "R8",
          with_cases(f"""SELECT municipio, fatal_rate, posicao, posicao <= {P.WORST_MUNICIPALITIES} AS destaque FROM (
  SELECT *, {_rank('fatal_rate DESC, municipio')} FROM rates)""",
                     extra_ctes=sev_sql(["municipio"], scale=100, name="m0")
                     + f",\nrates AS (SELECT * FROM m0 WHERE total >= {P.MIN_SUPPORT})"))
def flagged_municipalities(spark, sf_dir):
    """Supported municipalities by fatal rate, the worst ones flagged."""
    m = R.min_support(_matrix(spark, sf_dir, ["municipio"], scale=100), P.MIN_SUPPORT)
    r = R.ranked(m, _desc("fatal_rate", "municipio"))
    return r.select("municipio", "fatal_rate", "posicao", (F.col("posicao") <= P.WORST_MUNICIPALITIES).alias("destaque"))


@register("flagged_victims", "R8",
          with_cases(f"SELECT tipo_de_vitima, leve_rate, leve_rate >= {P.VICTIM_FLAG_PCT} AS destaque FROM rates",
                     extra_ctes=sev_sql(["tipo_de_vitima"], scale=100)))
def flagged_victims(spark, sf_dir):
    """Victim types whose light-injury rate reaches the flag value."""
    m = _matrix(spark, sf_dir, ["tipo_de_vitima"], scale=100)
    return m.select("tipo_de_vitima", "leve_rate", (F.col("leve_rate") >= P.VICTIM_FLAG_PCT).alias("destaque"))


@register("top_fatal_months", "R4,R5",
          with_cases(f"SELECT * FROM (SELECT *, {_rank('fatal_rate DESC, mes_sinistro')} FROM rates) "
                     f"WHERE posicao <= {P.TOP_MONTHS}", extra_ctes=sev_sql(["mes_sinistro"])))
def top_fatal_months(spark, sf_dir):
    m = _matrix(spark, sf_dir, ["mes_sinistro"])
    return R.ranked(m, _desc("fatal_rate", "mes_sinistro"), k=P.TOP_MONTHS)


@register("top_fatal_days", "R4,R5",
          with_cases(f"SELECT * FROM (SELECT *, {_rank('fatal_rate DESC, dia_sinistro')} FROM rates) "
                     f"WHERE posicao <= {P.TOP_DAYS}", extra_ctes=sev_sql(["dia_sinistro"])))
def top_fatal_days(spark, sf_dir):
    m = _matrix(spark, sf_dir, ["dia_sinistro"])
    return R.ranked(m, _desc("fatal_rate", "dia_sinistro"), k=P.TOP_DAYS)


# --- interactions ----------------------------------------------------------

@register("crosstab_victim_road", "A9",
          with_cases("SELECT * FROM rates", extra_ctes=sev_sql(["tipo_de_vitima", "tipo_via"])))
def crosstab_victim_road(spark, sf_dir):
    return _matrix(spark, sf_dir, ["tipo_de_vitima", "tipo_via"])


def _top5_sql(support):
    return with_cases(
        "SELECT * FROM rates",
        extra_ctes=sev_sql(["municipio"], name="muni") + f""",
top5 AS (SELECT municipio FROM muni WHERE total >= {support}
         ORDER BY fatal_rate DESC, municipio LIMIT {P.TOP_INTERACTION}),
sel AS (SELECT * FROM cases WHERE municipio IN (SELECT municipio FROM top5)),
""" + sev_sql(["municipio", "tipo_via"], src="sel"))


@register("top5_city_road", "A9,P8,J1,R4", _top5_sql(P.MIN_SUPPORT))
def top5_city_road(spark, sf_dir):
    """(municipality, road) rates for the top-5 municipalities. Both matrices
    come from one grouping-sets scan; restricting the (municipality, road)
    matrix to the top-5 keys equals the matrix of their rows."""
    muni, pair = R.severity_matrices(cases(spark, sf_dir), [["municipio"], ["municipio", "tipo_via"]])
    muni = R.min_support(muni, P.MIN_SUPPORT)
    top = R.top_k_keys(muni, "municipio", _desc("fatal_rate", "municipio"), P.TOP_INTERACTION)
    return R.semi_join_keys(pair, top, "municipio")


_DAYS = list(range(1, 32))


@register("month_day_pivot", "A10,F5",
          with_cases("SELECT mes_sinistro, lower(strftime(make_date(2000, mes_sinistro, 1), '%b')) AS mes_nome, "
                     + ", ".join(
              f"count(idade) FILTER (WHERE dia_sinistro = {d}) AS d{d:02d}" for d in _DAYS)
              + " FROM cases WHERE mes_sinistro IS NOT NULL AND dia_sinistro IS NOT NULL"
              " GROUP BY mes_sinistro"))
def month_day_pivot(spark, sf_dir):
    c = cases(spark, sf_dir).filter(F.col("mes_sinistro").isNotNull() & F.col("dia_sinistro").isNotNull())
    wide = c.groupBy("mes_sinistro").pivot("dia_sinistro", _DAYS).agg(F.count("idade"))
    wide = wide.select("mes_sinistro", month_abbr("mes_sinistro").alias("mes_nome"),
                       *[F.col(str(d)).alias(f"d{d:02d}") for d in _DAYS])
    return wide.na.fill(0)


# --- municipal ranking -----------------------------------------------------

def _muni_sql(body, support=P.MIN_SUPPORT, scale=1):
    return with_cases(body, extra_ctes=sev_sql(["municipio"], scale=scale, name="m0")
                      + f",\nrates AS (SELECT * FROM m0 WHERE total >= {support})")


def _supported(spark, sf_dir, scale=1):
    return R.min_support(_matrix(spark, sf_dir, ["municipio"], scale=scale), P.MIN_SUPPORT)


@register("municipal_risk_ranking", "P9,R2,R4,R5,F11",
          _muni_sql(f"SELECT *, fatal_rate > (SELECT avg(fatal_rate) FROM rates) AS acima_media FROM ("
                    f"SELECT *, {_rank('fatal_rate DESC, municipio')} FROM rates) "
                    f"WHERE posicao <= {P.TOP_MUNICIPALITIES}"))
def municipal_risk_ranking(spark, sf_dir):
    """Top municipalities by fatal share (minimum support), flagged when
    above the mean share of all supported municipalities."""
    m = _supported(spark, sf_dir)
    # the mean of the aggregated table, in the same plan
    m = m.withColumn("acima_media", F.col("fatal_rate") > F.avg("fatal_rate").over(Window.partitionBy()))
    return R.ranked(m, _desc("fatal_rate", "municipio"), k=P.TOP_MUNICIPALITIES)


@register("safest_municipalities", "P9,R2,R4,R5",
          _muni_sql(f"SELECT * FROM (SELECT *, {_rank('fatal_rate ASC, municipio')} FROM rates) "
                    f"WHERE posicao <= {P.SAFEST_MUNICIPALITIES}"))
def safest_municipalities(spark, sf_dir):
    return R.ranked(_supported(spark, sf_dir), [F.col("fatal_rate").asc(), F.col("municipio").asc()],
                    k=P.SAFEST_MUNICIPALITIES)


@register("municipal_rate_stats", "A14,R6",
          _muni_sql("""SELECT round(avg(fatal_rate), 9) AS mean, round(median(fatal_rate), 9) AS median,
       round(stddev_samp(fatal_rate), 9) AS std, count(*) AS groups,
       (SELECT municipio FROM rates ORDER BY fatal_rate DESC, municipio LIMIT 1) AS worst_municipio,
       (SELECT municipio FROM rates ORDER BY fatal_rate ASC, municipio LIMIT 1) AS best_municipio,
       max(fatal_rate) AS worst_rate, min(fatal_rate) AS best_rate
FROM rates"""))
def municipal_rate_stats(spark, sf_dir):
    m = _supported(spark, sf_dir)
    return m.agg(
        F.round(F.avg("fatal_rate"), 9).alias("mean"),
        F.round(F.median("fatal_rate"), 9).alias("median"),
        F.round(F.stddev_samp("fatal_rate"), 9).alias("std"),
        F.count(F.lit(1)).alias("groups"),
        F.min_by("municipio", F.struct(-F.col("fatal_rate"), F.col("municipio"))).alias("worst_municipio"),
        F.min_by("municipio", F.struct(F.col("fatal_rate"), F.col("municipio"))).alias("best_municipio"),
        F.max("fatal_rate").alias("worst_rate"),
        F.min("fatal_rate").alias("best_rate"),
    )


@register("municipal_outliers", "A14,P10",
          _muni_sql(f"SELECT * FROM rates WHERE fatal_rate > {P.OUTLIER_RATE_PCT} "
                    f"OR total > {P.OUTLIER_TOTAL}", scale=100))
def municipal_outliers(spark, sf_dir):
    m = _supported(spark, sf_dir, scale=100)
    return m.filter((F.col("fatal_rate") > P.OUTLIER_RATE_PCT) | (F.col("total") > P.OUTLIER_TOTAL))


# --- group comparisons -----------------------------------------------------

@register("worst_month_per_victim", "R7",
          with_cases("""SELECT tipo_de_vitima, mes_sinistro AS pior_mes, fatal_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY tipo_de_vitima ORDER BY fatal_rate DESC, mes_sinistro) AS rn
  FROM rates) WHERE rn = 1""", extra_ctes=sev_sql(["tipo_de_vitima", "mes_sinistro"])))
def worst_month_per_victim(spark, sf_dir):
    m = _matrix(spark, sf_dir, ["tipo_de_vitima", "mes_sinistro"])
    return R.argmax_per_group(m, "tipo_de_vitima", "mes_sinistro", "fatal_rate", out_key="pior_mes")


@register("dec_vs_apr", "A21,F9",
          with_cases(f"""SELECT max(fatal_rate) FILTER (WHERE mes_sinistro = {P.MONTH_A}) AS rate_a,
       max(fatal_rate) FILTER (WHERE mes_sinistro = {P.MONTH_B}) AS rate_b,
       (rate_a - rate_b) / rate_b * 100 AS diff_pct FROM rates""",
                     extra_ctes=sev_sql(["mes_sinistro"], scale=100)))
def dec_vs_apr(spark, sf_dir):
    m = _matrix(spark, sf_dir, ["mes_sinistro"], scale=100)
    return R.compare_two_keys(m, "mes_sinistro", P.MONTH_A, P.MONTH_B, "fatal_rate")


_CLUSTER = ", ".join(str(d) for d in P.DAY_CLUSTER)


@register("day_cluster_impact", "A20,F9",
          with_cases(f"""SELECT round(cluster_mean, 9) AS cluster_mean, round(others_mean, 9) AS others_mean,
       round((cluster_mean - others_mean) / others_mean * 100, 9) AS impact_pct FROM (
  SELECT avg(fatal_rate) FILTER (WHERE dia_sinistro IN ({_CLUSTER})) AS cluster_mean,
         avg(fatal_rate) FILTER (WHERE dia_sinistro NOT IN ({_CLUSTER})) AS others_mean FROM rates)""",
                     extra_ctes=sev_sql(["dia_sinistro"], scale=100)))
def day_cluster_impact(spark, sf_dir):
    m = _matrix(spark, sf_dir, ["dia_sinistro"], scale=100)
    out = R.cluster_vs_rest(m, "dia_sinistro", P.DAY_CLUSTER, "fatal_rate")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@register("one_vs_others", "A19",
          with_cases(f"""SELECT measure, round(chosen, 9) AS chosen, round(others_mean, 9) AS others_mean FROM (
  SELECT 'fatal_rate' AS measure, max(fatal_rate) FILTER (WHERE tipo_de_vitima = '{P.CHOSEN_VICTIM}') AS chosen,
         avg(fatal_rate) FILTER (WHERE tipo_de_vitima <> '{P.CHOSEN_VICTIM}') AS others_mean FROM rates
  UNION ALL
  SELECT 'grave_rate', max(grave_rate) FILTER (WHERE tipo_de_vitima = '{P.CHOSEN_VICTIM}'),
         avg(grave_rate) FILTER (WHERE tipo_de_vitima <> '{P.CHOSEN_VICTIM}') FROM rates
  UNION ALL
  SELECT 'leve_rate', max(leve_rate) FILTER (WHERE tipo_de_vitima = '{P.CHOSEN_VICTIM}'),
         avg(leve_rate) FILTER (WHERE tipo_de_vitima <> '{P.CHOSEN_VICTIM}') FROM rates)""",
                     extra_ctes=sev_sql(["tipo_de_vitima"], scale=100)))
def one_vs_others(spark, sf_dir):
    m = _matrix(spark, sf_dir, ["tipo_de_vitima"], scale=100)
    out = R.one_vs_others(m, "tipo_de_vitima", P.CHOSEN_VICTIM, ["fatal_rate", "grave_rate", "leve_rate"])
    return out.select("measure", F.round("chosen", 9).alias("chosen"),
                      F.round("others_mean", 9).alias("others_mean"))


# --- tiers and highlights --------------------------------------------------

def _tier_sql(col, cuts, labels, reach=">="):
    parts = " ".join(f"WHEN {col} {reach} {c} THEN '{lab}'" for c, lab in zip(cuts, labels))
    return f"CASE {parts} ELSE '{labels[-1]}' END"


@register("risk_tiers", "F11",
          with_cases(f"""SELECT 'mes' AS tabela, CAST(mes_sinistro AS VARCHAR) AS chave, fatal_rate,
       {_tier_sql('fatal_rate', P.MONTH_TIER_CUTS, P.MONTH_TIER_LABELS)} AS nivel FROM mes
UNION ALL
SELECT 'municipio', municipio, fatal_rate,
       {_tier_sql('fatal_rate', P.MUNICIPAL_TIER_CUTS, P.MUNICIPAL_TIER_LABELS, '>')} FROM muni
UNION ALL
SELECT 'vitima', tipo_de_vitima, fatal_rate,
       {_tier_sql('fatal_rate', P.VICTIM_TIER_CUTS, P.VICTIM_TIER_LABELS)} FROM vit""",
                     extra_ctes=",\n".join([sev_sql(["mes_sinistro"], scale=100, name="mes"),
                                           sev_sql(["municipio"], scale=100, name="muni"),
                                           sev_sql(["tipo_de_vitima"], scale=100, name="vit")])))
def risk_tiers(spark, sf_dir):
    c = cases(spark, sf_dir)
    parts = [
        ("mes", "mes_sinistro", P.MONTH_TIER_CUTS, P.MONTH_TIER_LABELS, False),
        ("municipio", "municipio", P.MUNICIPAL_TIER_CUTS, P.MUNICIPAL_TIER_LABELS, True),
        ("vitima", "tipo_de_vitima", P.VICTIM_TIER_CUTS, P.VICTIM_TIER_LABELS, False),
    ]
    mats = R.severity_matrices(c, [[p[1]] for p in parts], scale=100)  # one scan
    out = []
    for (name, key, cuts, labels, strict), m in zip(parts, mats):
        out.append(m.select(F.lit(name).alias("tabela"), F.col(key).cast("string").alias("chave"),
                            "fatal_rate", risk_tier("fatal_rate", cuts, labels, strict).alias("nivel")))
    return reduce(DataFrame.unionByName, out)


_HL = ", ".join(str(d) for d in P.HIGHLIGHT_DAYS)


@register("flagged_days", "R8,R5",
          with_cases(f"""SELECT dia_sinistro, fatal_rate, posicao, dia_sinistro IN ({_HL}) AS destaque,
       dia_sinistro IN ({_CLUSTER}) AS cluster, posicao <= 3 AS top3 FROM (
  SELECT *, {_rank('fatal_rate DESC, dia_sinistro')} FROM rates)""",
                     extra_ctes=sev_sql(["dia_sinistro"], scale=100)))
def flagged_days(spark, sf_dir):
    m = _matrix(spark, sf_dir, ["dia_sinistro"], scale=100)
    r = R.ranked(m, _desc("fatal_rate", "dia_sinistro"))
    return r.select("dia_sinistro", "fatal_rate", "posicao",
                    F.col("dia_sinistro").isin(list(P.HIGHLIGHT_DAYS)).alias("destaque"),
                    F.col("dia_sinistro").isin(list(P.DAY_CLUSTER)).alias("cluster"),
                    (F.col("posicao") <= 3).alias("top3"))


# --- KPI row ---------------------------------------------------------------

_KPI_SQL = with_cases(f"""SELECT total_casos, fatal_pct, rate_a, rate_b,
       (rate_a - rate_b) / rate_b * 100 AS diff_sazonal_pct,
       pior_municipio, pior_rate, melhor_municipio, melhor_rate,
       pior_rate / melhor_rate AS razao_municipal FROM (SELECT
  (SELECT count(*) FROM cases) AS total_casos,
  (SELECT 100 * count(*) FILTER (WHERE gravidade_lesao = 'FATAL') / count(*) FROM cases) AS fatal_pct,
  (SELECT fatal_rate FROM mes WHERE mes_sinistro = {P.MONTH_A}) AS rate_a,
  (SELECT fatal_rate FROM mes WHERE mes_sinistro = {P.MONTH_B}) AS rate_b,
  (SELECT municipio FROM muni ORDER BY fatal_rate DESC, municipio LIMIT 1) AS pior_municipio,
  (SELECT max(fatal_rate) FROM muni) AS pior_rate,
  (SELECT municipio FROM muni ORDER BY fatal_rate ASC, municipio LIMIT 1) AS melhor_municipio,
  (SELECT min(fatal_rate) FROM muni) AS melhor_rate)""",
                      extra_ctes=sev_sql(["mes_sinistro"], scale=100, name="mes") + ",\n"
                      + sev_sql(["municipio"], scale=100, name="muni0")
                      + f",\nmuni AS (SELECT * FROM muni0 WHERE total >= {P.MIN_SUPPORT})")


@register("kpi_dashboard", "A29,P18,P19,R6,A21,F10", _KPI_SQL)
def kpi_dashboard(spark, sf_dir):
    """One row of headline numbers from ONE scan of the case view: a
    grouping-sets aggregate over (month), (municipality) and the grand total,
    checkpointed (a few dozen rows), then read by each part."""
    from gravis.session import cut_lineage
    c = cases(spark, sf_dir)
    g = F.col("gravidade_lesao")
    sets = c.groupingSets([[F.col("mes_sinistro")], [F.col("municipio")], []], "mes_sinistro", "municipio").agg(
        F.count(F.lit(1)).alias("rows"), F.count(g).alias("total"),
        F.count(F.when(g == "FATAL", 1)).alias("n_fatal"),
        F.grouping_id(F.col("mes_sinistro"), F.col("municipio")).alias("_gid"))
    sets = cut_lineage(sets)
    overall = sets.filter(F.col("_gid") == 3).select(
        F.col("rows").alias("total_casos"), (F.lit(100) * F.col("n_fatal") / F.col("rows")).alias("fatal_pct"))
    mes = (sets.filter((F.col("_gid") == 1) & F.col("mes_sinistro").isNotNull() & (F.col("total") > 0))
           .select("mes_sinistro", (F.lit(100) * F.col("n_fatal") / F.col("total")).alias("fatal_rate")))
    seasonal = R.compare_two_keys(mes, "mes_sinistro", P.MONTH_A, P.MONTH_B, "fatal_rate")
    seasonal = seasonal.withColumnRenamed("diff_pct", "diff_sazonal_pct")
    muni = (sets.filter((F.col("_gid") == 2) & F.col("municipio").isNotNull() & (F.col("total") > 0)
                        & (F.col("total") >= P.MIN_SUPPORT))
            .select("municipio", (F.lit(100) * F.col("n_fatal") / F.col("total")).alias("fatal_rate")))
    extremes = muni.agg(
        F.min_by("municipio", F.struct(-F.col("fatal_rate"), F.col("municipio"))).alias("pior_municipio"),
        F.max("fatal_rate").alias("pior_rate"),
        F.min_by("municipio", F.struct(F.col("fatal_rate"), F.col("municipio"))).alias("melhor_municipio"),
        F.min("fatal_rate").alias("melhor_rate"))
    row = combine_one_row_frames([overall, seasonal, extremes])
    return row.withColumn("razao_municipal", ratio("pior_rate", "melhor_rate"))


def combine_one_row_frames(frames):
    """Put several one-row aggregates side by side without a join: stack them
    (each fills only its own columns) and take the one non-null per column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cols = [c for f in frames for c in f.columns]
    return stacked.agg(*[F.max(c).alias(c) for c in cols])
