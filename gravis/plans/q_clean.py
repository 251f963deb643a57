"""Cleaning, normalisation, encoding and frequency analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from gravis import NOT_AVAILABLE
from gravis.functions.scalar import age_band, age_band_order, severity_score, sex_code
from gravis.functions.text import normalize_name
from gravis.operators import clean as C
from gravis.operators import encode as E
from gravis.operators import freq as Q
from gravis.operators import sampling as S
from gravis.plans import params as P
from gravis.plans.oracle import with_cases
from gravis.plans.registry import register
from gravis.sources.tables import DIRTY_COLUMNS, cases, cases_dirty, table


def _dirty(body, extra=""):
    return with_cases(body, dirty=True, extra_ctes=extra)


_YEARS = ", ".join(str(y) for y in P.KEEP_YEARS)


@register("csv_year_filter", "P1,P2",
          _dirty(f"""SELECT id_sinistro, CAST(TRY_CAST(ano_texto AS DOUBLE) AS INTEGER) AS ano_sinistro
FROM cases_dirty WHERE TRY_CAST(ano_texto AS DOUBLE) IN ({_YEARS})"""))
def csv_year_filter(spark, sf_dir):
    d = cases_dirty(spark, sf_dir).select("id_sinistro", "ano_texto")
    return C.year_filter(d, "ano_texto", P.KEEP_YEARS).withColumnRenamed("ano_texto", "ano_sinistro")


_EXTRACT_COLS = ["id_sinistro", "municipio", "gravidade_lesao", "sexo", "idade",
                 "ano_sinistro", "mes_sinistro", "dia_sinistro"]


@register("consolidate_union", "U1",
          with_cases(f"""SELECT {', '.join(_EXTRACT_COLS)} FROM cases WHERE ano_sinistro <= 1997
UNION ALL BY NAME
SELECT {', '.join(_EXTRACT_COLS)}, tipo_via FROM cases WHERE ano_sinistro >= 1998"""))
def consolidate_union(spark, sf_dir):
    c = cases(spark, sf_dir)
    first = c.filter(F.col("ano_sinistro") <= 1997).select(*_EXTRACT_COLS)
    second = c.filter(F.col("ano_sinistro") >= 1998).select(*_EXTRACT_COLS, "tipo_via")
    return C.consolidate(first, second)


@register("drop_duplicate_rows", "U4", _dirty("SELECT DISTINCT * FROM cases_dirty"))
def drop_duplicate_rows(spark, sf_dir):
    return C.drop_duplicate_rows(cases_dirty(spark, sf_dir))


@register("distinct_values", "U5", _dirty("SELECT DISTINCT municipio FROM cases_dirty"))
def distinct_values(spark, sf_dir):
    return cases_dirty(spark, sf_dir).select("municipio").distinct()


_STR_DIRTY = ["municipio", "gravidade_lesao", "sexo", "ano_texto", "regiao_administrativa",
              "tipo_via", "tipo_de_vitima"]


def _recode_sql(c):
    return (f"coalesce(CASE WHEN {c} = 'NAO DISPONIVEL' THEN 'DESCONHECIDO' ELSE {c} END, "
            f"'DESCONHECIDO') AS {c}")


@register("recode_and_fill", "N1,N2,P14",
          _dirty("SELECT id_sinistro, idade, mes_sinistro, dia_sinistro, valor, "
                 + ", ".join(_recode_sql(c) for c in _STR_DIRTY) + " FROM cases_dirty"))
def recode_and_fill(spark, sf_dir):
    d = cases_dirty(spark, sf_dir)
    return C.recode_and_fill(d, C.columns_of_type(d, "string"))


@register("median_fill", "N3,J2",
          _dirty("""SELECT id_sinistro, coalesce(CAST(idade AS DOUBLE), (SELECT median(idade) FROM cases_dirty)) AS idade,
       CAST(mes_sinistro AS DOUBLE) AS mes_sinistro, CAST(dia_sinistro AS DOUBLE) AS dia_sinistro,
       CAST(valor AS DOUBLE) AS valor FROM cases_dirty"""))
def median_fill(spark, sf_dir):
    d = cases_dirty(spark, sf_dir).select("id_sinistro", "idade", "mes_sinistro", "dia_sinistro", "valor")
    return C.median_fill(d, ["idade", "mes_sinistro", "dia_sinistro", "valor"])


@register("fold_accents", "F1,F2,F3",
          """SELECT doc_id, regexp_replace(strip_accents(upper(trim(replace(text, 'ß', 'SS'),
       chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)))), '[^\\x00-\\x7F]', '', 'g') AS texto
FROM documents""")
def fold_accents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.select("doc_id", normalize_name("text").alias("texto"))


def _band_sql(col):
    edges, labels = (0, 18, 25, 35, 45, 60, 100), ("0-18", "19-25", "26-35", "36-45", "46-60", "60+")
    lab = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN '{t}'"
                   for lo, hi, t in zip(edges[:-1], edges[1:], labels))
    pos = " ".join(f"WHEN {col} > {lo} AND {col} <= {hi} THEN {i}"
                   for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])))
    return f"CASE {lab} END AS faixa, CAST(CASE {pos} END AS DOUBLE) AS faixa_ordem"


@register("age_bands", "N12", _dirty(f"SELECT id_sinistro, idade, {_band_sql('idade')} FROM cases_dirty"))
def age_bands(spark, sf_dir):
    d = cases_dirty(spark, sf_dir)
    return d.select("id_sinistro", "idade", age_band("idade").alias("faixa"),
                    age_band_order("idade").cast("double").alias("faixa_ordem"))


@register("iqr_filter", "N4,P7,A15",
          _dirty("""SELECT id_sinistro, idade FROM cases_dirty,
  (SELECT quantile_cont(idade, 0.25) AS q1, quantile_cont(idade, 0.75) AS q3 FROM cases_dirty) q
WHERE idade >= q1 - 1.5 * (q3 - q1) AND idade <= q3 + 1.5 * (q3 - q1)"""))
def iqr_filter(spark, sf_dir):
    d = cases_dirty(spark, sf_dir).select("id_sinistro", "idade")
    return C.iqr_filter(d, "idade")


_Z_COLS = ["idade", "ano_sinistro", "valor"]


@register("zscore", "N6,J2",
          with_cases("SELECT id_sinistro, " + ", ".join(
              f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 9) AS {c}_z"
              for c in _Z_COLS) + " FROM cases"))
def zscore(spark, sf_dir):
    c = cases(spark, sf_dir).select("id_sinistro", *_Z_COLS)
    z = C.zscore(c, _Z_COLS, suffix="_z")
    return z.select("id_sinistro", *[F.round(f"{x}_z", 9).alias(f"{x}_z") for x in _Z_COLS])


_FITTED_UNTIL = 1997


@register("fitted_cleaning", "N3,N4,N6,J2",
          _dirty(f"""SELECT id_sinistro, idade, valor, round((idade - mi) / si, 9) AS idade_z, round((valor - mv) / sv, 9) AS valor_z
FROM (SELECT id_sinistro, coalesce(idade, med_i) AS idade, coalesce(valor, med_v) AS valor FROM novos, med) n, q, m
WHERE idade >= q1 - 1.5 * (q3 - q1) AND idade <= q3 + 1.5 * (q3 - q1)""", extra=f"""anos AS (
  SELECT id_sinistro, idade, CAST(valor AS DOUBLE) AS valor, TRY_CAST(ano_texto AS DOUBLE) AS ano FROM cases_dirty),
antigos AS (SELECT * FROM anos WHERE ano IN ({_YEARS}) AND ano <= {_FITTED_UNTIL}),
novos AS (SELECT * FROM anos WHERE ano IN ({_YEARS}) AND ano > {_FITTED_UNTIL}),
med AS (SELECT median(idade) AS med_i, median(valor) AS med_v FROM antigos),
cheios AS (SELECT coalesce(idade, med_i) AS idade, coalesce(valor, med_v) AS valor FROM antigos, med),
q AS (SELECT quantile_cont(idade, 0.25) AS q1, quantile_cont(idade, 0.75) AS q3 FROM cheios),
m AS (SELECT avg(idade) AS mi, coalesce(nullif(stddev_pop(idade), 0), 1) AS si,
             avg(valor) AS mv, coalesce(nullif(stddev_pop(valor), 0), 1) AS sv
      FROM cheios, q WHERE idade >= q1 - 1.5 * (q3 - q1) AND idade <= q3 + 1.5 * (q3 - q1))"""))
def fitted_cleaning(spark, sf_dir):
    """Cleaning fitted on the rows up to one year, kept as a table, applied to the later rows."""
    d = C.year_filter(cases_dirty(spark, sf_dir).select("id_sinistro", "ano_texto", "idade", "valor"), "ano_texto", P.KEEP_YEARS)
    old, new = d.filter(F.col("ano_texto") <= _FITTED_UNTIL), d.filter(F.col("ano_texto") > _FITTED_UNTIL)
    kept = C.fit_cleaning(old, ["idade", "valor"], ["idade"], ["idade", "valor"]).table(spark)
    st = C.CleaningStatistics.of_table(kept)
    out = st.scale(st.filter(st.fill(new)), "_z")
    return out.select("id_sinistro", "idade", "valor", *[F.round(f"{x}_z", 9).alias(f"{x}_z") for x in ("idade", "valor")])


@register("ordinal_encode", "N7,J3",
          with_cases("""SELECT id_sinistro,
       CAST(dense_rank() OVER (ORDER BY municipio) - 1 AS INTEGER) AS municipio_num,
       CAST(dense_rank() OVER (ORDER BY gravidade_lesao) - 1 AS INTEGER) AS gravidade_lesao_num,
       CAST(dense_rank() OVER (ORDER BY tipo_via) - 1 AS INTEGER) AS tipo_via_num
FROM cases"""))
def ordinal_encode(spark, sf_dir):
    c = cases(spark, sf_dir).select("id_sinistro", "municipio", "gravidade_lesao", "tipo_via")
    out, _ = E.ordinal_encode(c, ["municipio", "gravidade_lesao", "tipo_via"])
    return out.select("id_sinistro", "municipio_num", "gravidade_lesao_num", "tipo_via_num")


_OH = ["municipio", "tipo_via", "tipo_de_vitima"]


@register("onehot_counts", "N9,J4",
          with_cases("\nUNION ALL\n".join(
              f"SELECT '{c}' AS coluna, {c} AS valor, count(*) AS n FROM cases GROUP BY {c}" for c in _OH)))
def onehot_counts(spark, sf_dir):
    return E.one_hot_counts(cases(spark, sf_dir), _OH)


@register("severity_map", "N11",
          _dirty("""SELECT id_sinistro, gravidade_lesao,
       CASE gravidade_lesao WHEN 'FATAL' THEN 3 WHEN 'GRAVE' THEN 2 ELSE 1 END AS gravidade_num_correta
FROM cases_dirty"""))
def severity_map(spark, sf_dir):
    d = cases_dirty(spark, sf_dir)
    return d.select("id_sinistro", "gravidade_lesao",
                    severity_score("gravidade_lesao").alias("gravidade_num_correta"))


@register("sex_map", "N10",
          _dirty("""SELECT id_sinistro, sexo,
       CAST(CASE sexo WHEN 'FEMININO' THEN 0 WHEN 'MASCULINO' THEN 1 END AS DOUBLE) AS sexo_bin FROM cases_dirty"""))
def sex_map(spark, sf_dir):
    d = cases_dirty(spark, sf_dir)
    return d.select("id_sinistro", "sexo", sex_code("sexo").cast("double").alias("sexo_bin"))


_SCOPE = {"regiao_administrativa": "AMERICA", "tipo_via": "AUTOMOBILE"}
_SENTINEL_COLS = ["gravidade_lesao", "municipio", "sexo"]


@register("scope_filter", "P3,P4,P5",
          _dirty("""SELECT id_sinistro, municipio, gravidade_lesao, sexo FROM cases_dirty
WHERE regiao_administrativa = 'AMERICA' AND tipo_via = 'AUTOMOBILE'
  AND gravidade_lesao IS DISTINCT FROM 'NAO DISPONIVEL'
  AND municipio IS DISTINCT FROM 'NAO DISPONIVEL'
  AND sexo IS DISTINCT FROM 'NAO DISPONIVEL'"""))
def scope_filter(spark, sf_dir):
    d = C.equals_all(cases_dirty(spark, sf_dir), _SCOPE)
    d = C.exclude_value(d, _SENTINEL_COLS, NOT_AVAILABLE)
    return d.select("id_sinistro", "municipio", "gravidade_lesao", "sexo")


_STEPS = ["sexo", "gravidade_lesao", "municipio"]


def _step_ok(c):
    return f"({c} IS NOT NULL AND {c} <> 'NAO DISPONIVEL')"


def _stepwise_sql():
    conds, aggs = [], ["count(*) AS s0"]
    for i, c in enumerate(_STEPS, 1):
        conds.append(_step_ok(c))
        aggs.append(f"count(*) FILTER (WHERE {' AND '.join(conds)}) AS s{i}")
    rows = "\nUNION ALL\n".join(
        f"SELECT {i} AS passo, '{c}' AS coluna, s{i - 1} AS antes, s{i} AS depois, s{i - 1} - s{i} AS removidos FROM s"
        for i, c in enumerate(_STEPS, 1))
    return _dirty(rows, extra=f"s AS (SELECT {', '.join(aggs)} FROM cases_dirty)")


@register("stepwise_filter_counts", "P6", _stepwise_sql())
def stepwise_filter_counts(spark, sf_dir):
    return C.stepwise_counts(cases_dirty(spark, sf_dir), _STEPS)


@register("drop_any_null", "P11",
          _dirty("SELECT * FROM cases_dirty WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in DIRTY_COLUMNS)))
def drop_any_null(spark, sf_dir):
    return C.drop_any_null(cases_dirty(spark, sf_dir))


# Columns never used for prediction (death follow-up leaks,
# identifiers, scope columns), as the reference lists them.
LEAK_AND_ID_COLUMNS = ["local_obito", "tempo_sinistro_obito", "ano_obito", "dia_obito", "mes_obito",
                       "ano_mes_obito", "data_obito", "nacionalidade", "grau_de_instrucao", "profissao",
                       "id_sinistro", "id_veiculo", "cod_ibge", "regiao_administrativa", "regiao_norm",
                       "tipo_veiculo_vitima", "gravidade_num"]


@register("leakfree_projection", "P12,P13,P14",
          with_cases("""SELECT municipio, tipo_via, tipo_de_vitima, sexo, idade, gravidade_lesao,
       ano_sinistro, mes_sinistro, dia_sinistro, valor FROM cases"""))
def leakfree_projection(spark, sf_dir):
    return C.drop_present(cases(spark, sf_dir), LEAK_AND_ID_COLUMNS + ["data_sinistro", "ano_mes_sinistro"])


@register("seeded_sample", "P17",
          with_cases(f"SELECT * FROM cases ORDER BY md5(CAST(id_sinistro AS VARCHAR) || ':{P.SEED}'), id_sinistro LIMIT 1000"))
def seeded_sample(spark, sf_dir):
    return S.seeded_sample(cases(spark, sf_dir), 1000, ["id_sinistro"], P.SEED)


@register("value_counts_share", "A1,A2,A5,R1",
          _dirty("""SELECT ano_texto, count(*) AS n,
       100 * count(*) / (SELECT count(*) FROM cases_dirty) AS share_pct,
       (SELECT count(*) FROM cases_dirty) AS total
FROM cases_dirty WHERE ano_texto IS NOT NULL GROUP BY ano_texto"""))
def value_counts_share(spark, sf_dir):
    return Q.value_counts_share(cases_dirty(spark, sf_dir), "ano_texto").orderBy("ano_texto")


_TOP_COLS = ["gravidade_lesao", "sexo", "municipio", "tipo_de_vitima"]


@register("top5_multi_column", "A3,A4",
          _dirty("SELECT coluna, valor, n, posicao, 100 * n / (SELECT count(*) FROM cases_dirty) AS share_pct FROM ("
                 "SELECT *, CAST(row_number() OVER (PARTITION BY coluna ORDER BY n DESC, valor) AS INTEGER) AS posicao "
                 "FROM (" + "\nUNION ALL\n".join(
                     f"SELECT '{c}' AS coluna, {c} AS valor, count(*) AS n FROM cases_dirty "
                     f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in _TOP_COLS) + ")) WHERE posicao <= 5"))
def top5_multi_column(spark, sf_dir):
    return Q.top_k_per_column(cases_dirty(spark, sf_dir), _TOP_COLS, 5)
