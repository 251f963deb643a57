"""SQL text of the case views, shared by every oracle query.

DuckDB runs these as CTEs over the driver's pre-registered parquet views.
They restate, in SQL, the rules that ``gravis.sources.tables`` builds with the
DataFrame API, so each oracle check compares two independent formulations.
"""

CASES_SQL = """
cases AS (
  SELECT o_orderkey AS id_sinistro,
         n_name AS municipio, r_name AS regiao_administrativa,
         c_mktsegment AS tipo_via, o_orderpriority AS tipo_de_vitima,
         CASE WHEN o_custkey % 3 = 0 THEN 'FEMININO' ELSE 'MASCULINO' END AS sexo,
         CAST((o_custkey * 37 + o_orderkey * 11) % 105 AS INT) AS idade,
         CASE o_orderstatus WHEN 'F' THEN 'FATAL' WHEN 'P' THEN 'GRAVE' ELSE 'LEVE' END AS gravidade_lesao,
         CAST(year(o_orderdate) AS INT) AS ano_sinistro,
         CAST(month(o_orderdate) AS INT) AS mes_sinistro,
         CAST(day(o_orderdate) AS INT) AS dia_sinistro,
         o_totalprice AS valor
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey
)"""

CASES_DIRTY_SQL = """
cases_dirty AS (
  SELECT id_sinistro,
         CASE WHEN id_sinistro % 17 = 0 THEN NULL WHEN id_sinistro % 19 = 0 THEN 'NAO DISPONIVEL' ELSE municipio END AS municipio,
         CASE WHEN id_sinistro % 23 = 0 THEN 'NAO DISPONIVEL' ELSE gravidade_lesao END AS gravidade_lesao,
         CASE WHEN id_sinistro % 13 = 0 THEN NULL ELSE sexo END AS sexo,
         CAST(CASE WHEN id_sinistro % 11 = 0 THEN NULL WHEN id_sinistro % 101 = 0 THEN 400 ELSE idade END AS DOUBLE) AS idade,
         CASE WHEN id_sinistro % 29 = 0 THEN 'junk' ELSE CAST(ano_sinistro AS VARCHAR(10)) END AS ano_texto,
         regiao_administrativa, tipo_via, tipo_de_vitima, mes_sinistro, dia_sinistro, valor
  FROM cases
  UNION ALL
  SELECT id_sinistro, municipio, gravidade_lesao, sexo, CAST(idade AS DOUBLE), CAST(ano_sinistro AS VARCHAR(10)),
         regiao_administrativa, tipo_via, tipo_de_vitima, mes_sinistro, dia_sinistro, valor
  FROM cases WHERE id_sinistro % 50 = 0
  UNION ALL
  SELECT id_sinistro, municipio, gravidade_lesao, sexo, CAST(idade AS DOUBLE), CAST(ano_sinistro AS VARCHAR(10)),
         regiao_administrativa, tipo_via, tipo_de_vitima, mes_sinistro, dia_sinistro, valor
  FROM cases WHERE id_sinistro % 50 = 0
)"""


def with_cases(body: str, dirty: bool = False, extra_ctes: str = "") -> str:
    """Prefix ``body`` with the case CTEs (and optional further CTEs)."""
    ctes = [CASES_SQL]
    if dirty:
        ctes.append(CASES_DIRTY_SQL)
    if extra_ctes:
        ctes.append(extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + body
