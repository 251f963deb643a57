"""End-to-end jobs over the source extracts (the reference's three stages).

1. ``consolidate_extracts``: read two yearly extracts, keep the wanted
   years, union by name, write the merged extract, summarise it.
2. ``prepare_cases`` + ``analysis_tables``: clean, fit the state-wide
   statistics, narrow to the scope, then the rate and statistics tables;
   ``train_models``: the compared classifiers and every result file.
3. ``dashboard_tables``: monthly / daily / municipal / victim tables and KPI.

Every step is a DataFrame operator from ``gravis.operators``; the jobs only
wire them together and write results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravis import MISSING, NOT_AVAILABLE, UNKNOWN
from gravis.functions.scalar import age_band
from gravis.functions.text import normalize_name
from gravis.operators import clean as C
from gravis.operators import encode as E
from gravis.operators import freq as Q
from gravis.operators import metrics as M
from gravis.operators import models as ML
from gravis.operators import rates as R
from gravis.operators import sampling as S
from gravis.operators import search as SE
from gravis.plans import params as P
from gravis.session import cut_lineage
from gravis.sources import extracts as X

# The reference's scope (motorcycle victims in the Sao Paulo
# metropolitan region; only the municipality column is accent-folded) and
# the columns its summaries list.
SCOPE = {"tipo_veiculo_vitima": "MOTOCICLETA", "regiao_administrativa": "METROPOLITANA DE SÃO PAULO"}
SCOPE_SENTINEL_COLUMNS = ["gravidade_lesao", "faixa_etaria_legal", "sexo"]
SUMMARY_COLUMNS = ["gravidade_lesao", "sexo", "tipo_veiculo_vitima", "regiao_administrativa"]
YEARS = tuple(range(2020, 2026))


def consolidate_extracts(spark: SparkSession, path_a: str, path_b: str, out_path: str | None = None,
                         years=YEARS, year_col: str = "ano_sinistro", bad_path: str | None = None):
    """Stage 1. Returns (merged table or None, year counts, top-5 summary). Lines that
    do not fit their extract's header are left out; with ``bad_path`` they are written
    there as Parquet, with the extract they come from."""
    found = [(p, X.read_checked(spark, p)) for p in (path_a, path_b)]
    parts = [C.year_filter(e.rows, year_col, years) for _, e in found if e is not None]
    bad = C.consolidate(*[e.bad.withColumn("extrato", F.lit(p)) for p, e in found if e is not None])
    if bad_path and bad is not None:
        bad.write.mode("overwrite").parquet(bad_path)
    merged = C.consolidate(*[p for p in parts if p is not None and not p.isEmpty()])
    if merged is None:
        return None, None, None
    if out_path:
        X.write_extract(merged, out_path)
    years_tab = Q.value_counts_share(merged, year_col)
    present = [c for c in SUMMARY_COLUMNS if c in merged.columns]
    top = Q.top_k_per_column(merged, present, 5) if present else None
    return merged, years_tab, top


UNFILLED = ["id_sinistro"]
UNSCALED = ["mes_sinistro", "dia_sinistro"]


def _plain_cases(df: DataFrame) -> DataFrame:
    """The cleaning that needs no statistic: de-duplicated, typed, text recoded and
    filled, place names normalised. Bands wait for the filled age."""
    d = C.drop_duplicate_rows(df)  # on the rows as loaded, before typing
    if dict(d.dtypes).get("idade") == "string":
        d = X.type_columns(d)
    d = C.recode_and_fill(d)
    if "municipio" in d.columns:
        d = d.withColumn("municipio", normalize_name("municipio"))
    return d


class CaseCleaner:
    """Fitted cleaning: the statistics of one table and the codes of its places,
    saved and applied to later tables. Places the fitted table does not have get the
    number of its places as code. The codes stay a distributed table."""

    def __init__(self, statistics: C.CleaningStatistics, codes: DataFrame | None):
        self.statistics, self.codes = statistics, codes

    @classmethod
    def fit(cls, df: DataFrame) -> CaseCleaner:
        return cls._of_plain(cut_lineage(_plain_cases(df)))

    @classmethod
    def _of_plain(cls, d: DataFrame) -> CaseCleaner:
        fill = C.columns_of_type(d, "numeric", exclude=UNFILLED)
        fence = [c for c in ("idade",) if c in d.columns]
        st = C.fit_cleaning(d, fill, fence, C.columns_of_type(d, "numeric", exclude=UNSCALED))
        kept = st.filter(st.fill(d))
        return cls(st, E.ordinal_codes(kept.na.fill(MISSING, subset=["municipio"]), ["municipio"]) if "municipio" in d.columns else None)

    def apply(self, df: DataFrame, zscore_suffix: str = "_z") -> DataFrame:
        return self._apply_plain(_plain_cases(df), zscore_suffix)

    def _apply_plain(self, d: DataFrame, zscore_suffix: str) -> DataFrame:
        d = self.statistics.fill(d)
        if "idade" in d.columns:
            d = d.withColumn("idade_faixa", age_band("idade"))
        d = self.statistics.scale(self.statistics.filter(d), zscore_suffix)
        if self.codes is not None and "municipio" in d.columns:
            d = E.look_up_codes(d.na.fill(MISSING, subset=["municipio"]), self.codes, ["municipio"])
        return d

    def save(self, spark: SparkSession, path: str) -> None:
        """Both tables as one published set: a failed save leaves the last one in place."""
        out = ResultSet(spark, path)
        self.statistics.table(spark).coalesce(1).write.parquet(out.path("estatisticas"))
        if self.codes is not None:
            self.codes.write.parquet(out.path("codigos"))
        out.publish()

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CaseCleaner:
        paths = published(spark, path)
        if not paths:
            raise FileNotFoundError(f"no cleaning was saved in {path}")
        return cls(C.CleaningStatistics.of_table(spark.read.parquet(paths["estatisticas"])),
                   spark.read.parquet(paths["codigos"]) if "codigos" in paths else None)


def prepare_cases(df: DataFrame, scope: dict | None = SCOPE, zscore_suffix: str = "_z",
                  cleaner: CaseCleaner | None = None) -> DataFrame:
    """Stage 2 cleaning in the reference's order: de-duplicate, recode and
    fill text, exact-median fill numbers, normalise place names, age bands,
    IQR filter on age, z-scores (kept beside the raw values), place code;
    the statistics are fitted on the whole table and only THEN is the scope
    applied. With ``cleaner`` (fitted on another table) nothing is fitted here.
    The result is checkpointed: every analysis reads it."""
    d = _plain_cases(df)
    if cleaner is None:
        d = cut_lineage(d)  # read by the fit's scans and by the rows' own
        cleaner = CaseCleaner._of_plain(d)
    d = cleaner._apply_plain(d, zscore_suffix)
    if scope:
        absent = [c for c in [*scope, *SCOPE_SENTINEL_COLUMNS] if c not in d.columns]
        if absent:
            raise ValueError(f"the scope needs columns {absent}")
        d = C.exclude_value(C.equals_all(d, scope), SCOPE_SENTINEL_COLUMNS, UNKNOWN)
    return cut_lineage(d)


def analysis_tables(cases: DataFrame, support: int = 100) -> dict[str, DataFrame]:
    """Stage 2 rate tables (fractions), on a prepared table; all matrices
    come from one grouping-sets scan."""
    mes, dia, muni, vv, vm = R.severity_matrices(
        cases, [["mes_sinistro"], ["dia_sinistro"], ["municipio"], ["tipo_de_vitima", "tipo_via"],
                ["tipo_de_vitima", "mes_sinistro"]])
    muni = R.min_support(muni, support)
    return {
        "mensal": R.ranked(mes, [F.col("fatal_rate").desc(), F.col("mes_sinistro")]),
        "diario": R.ranked(dia, [F.col("fatal_rate").desc(), F.col("dia_sinistro")]),
        "municipios": R.ranked(muni, [F.col("fatal_rate").desc(), F.col("municipio")]),
        "vitima_via": vv,
        "pior_mes_vitima": R.argmax_per_group(vm, "tipo_de_vitima", "mes_sinistro", "fatal_rate",
                                              out_key="pior_mes"),
    }


def dashboard_cases(spark: SparkSession, prepared: DataFrame | None, path: str | None = None, scope: dict | None = SCOPE) -> DataFrame | None:
    """Stage 3 input: the prepared table, or without one the extract at ``path``,
    typed, in the scope and without the raw sentinel; None without either."""
    if prepared is not None:
        return prepared
    raw = X.read_extract(spark, path) if path else None
    return None if raw is None else cut_lineage(sentinel_scope(X.type_columns(raw), scope))


def dashboard_tables(cases: DataFrame, support: int = 100, month_a: int = 12, month_b: int = 4,
                     chosen_victim: str = "CONDUTOR", cluster=(24, 25, 26)) -> dict[str, DataFrame]:
    """Stage 3 chart tables (percentages) and the comparisons behind the
    KPIs. The five matrices come from one grouping-sets scan."""
    mes, dia, vit, muni, sem = R.severity_matrices(
        R.with_week_of_month(cases),
        [["mes_sinistro"], ["dia_sinistro"], ["tipo_de_vitima"], ["municipio"], ["semana_mes"]], scale=100)
    muni = R.min_support(muni, support)
    return {
        "mensal": mes, "diario": dia, "vitima": vit, "municipios": muni,
        "semanal": sem,
        "sazonal": R.compare_two_keys(mes, "mes_sinistro", month_a, month_b, "fatal_rate"),
        "cluster_dias": R.cluster_vs_rest(dia, "dia_sinistro", cluster, "fatal_rate"),
        "vitima_vs_outros": R.one_vs_others(vit, "tipo_de_vitima", chosen_victim,
                                            ["fatal_rate", "grave_rate", "leve_rate"]),
        "estatisticas_municipais": R.rate_stats(muni, "fatal_rate"),
    }


def land_cases(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Write the joined case view once, as Parquet partitioned by year, and
    return a reader of it: at scale, repeated analyses then read pruned
    columns (and pruned year partitions) instead of re-running the
    orders x customer shuffle join each time."""
    from gravis.sources.tables import cases as case_view
    # no shuffle by year (a year is a large share of all rows): every task
    # writes its own rows of each year, sorted so one file is open at a time
    (case_view(spark, sf_dir).sortWithinPartitions("ano_sinistro").write.mode("overwrite")
     .partitionBy("ano_sinistro").parquet(path))
    return spark.read.parquet(path)


def sentinel_scope(df: DataFrame, scope: dict | None = SCOPE) -> DataFrame:
    """Stage 3 fallback scope on the raw table: scope equality and the raw
    sentinel excluded (missing values kept)."""
    d = C.equals_all(df, {k: v for k, v in (scope or {}).items() if k in df.columns}) if scope else df
    return C.exclude_value(d, [c for c in SCOPE_SENTINEL_COLUMNS if c in d.columns], NOT_AVAILABLE)


# Headers of the result files the reference writes.
METRIC_HEADERS = {"modelo": "Modelo", "f1_macro": "F1-macro", "recall_macro": "Recall-macro",
                  "precision_macro": "Precision-macro"}
CLASS_HEADERS = {"classe": "Classe", "precision": "Precision", "recall": "Recall", "f1": "F1"}


class ResultSet:
    """Result files of one run, published together. Files go to a folder of the
    run's own; ``publish`` appends their list to the ``manifest`` table in one
    one-task write, whose commit is the only thing that makes the run visible. A
    run that fails leaves the last published one in place."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.out_dir, self.run = spark, out_dir.rstrip("/"), uuid.uuid4().hex
        self.names: list[str] = []

    def path(self, name: str) -> str:
        self.names.append(name)
        return f"{self.out_dir}/run-{self.run}/{name}"

    def publish(self) -> None:
        rows = [(self.run, name, f"{self.out_dir}/run-{self.run}/{name}") for name in self.names]
        (self.spark.createDataFrame(rows, "run string, name string, path string").withColumn("published", F.current_timestamp())
         .coalesce(1).write.mode("append").parquet(f"{self.out_dir}/manifest"))


def published(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """name -> path of the run published last; empty if none was."""
    from pyspark.errors import AnalysisException
    try:
        m = spark.read.parquet(f"{out_dir.rstrip('/')}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return {}
        raise
    last = m.agg(F.max(F.struct("published", "run")).alias("x")).first()["x"]
    return {r["name"]: r["path"] for r in m.where(F.col("run") == last["run"]).collect()} if last else {}


def write_results(out_dir: str, summary: DataFrame, report: DataFrame, confusion: DataFrame,
                  search: list[tuple[str, str]] | None = None, threshold: DataFrame | None = None,
                  results: ResultSet | None = None) -> None:
    """Write the result set: per-model macro metrics, the F1 comparison, the
    FATAL / GRAVE metrics (plain and with the threshold rule), one confusion matrix
    per model and the search report. Every input is small (one row per model or
    class). With ``results`` the files belong to that set, else they go to ``out_dir``."""
    def place(name: str) -> str:
        return results.path(name) if results else f"{out_dir.rstrip('/')}/{name}"
    metrics = summary.select(*[F.col(k).alias(v) for k, v in METRIC_HEADERS.items()])
    X.write_metric_table(metrics, place("metricas_modelos"))
    X.write_metric_table(metrics.select("Modelo", "F1-macro"), place("comparacao_modelos"))
    for name, rep in (("metricas_fatal_grave", report), ("metricas_fatal_grave_threshold", threshold)):
        if rep is not None:
            fg = rep.filter(F.col("classe").isin("FATAL", "GRAVE"))
            cols = ["modelo"] if "modelo" in fg.columns else []
            X.write_metric_table(fg.select(*cols, *[F.col(k).alias(v) for k, v in CLASS_HEADERS.items()]), place(name))
    X.write_per_model(confusion, place("matriz_confusao"))
    if search:
        X.write_report(summary.sparkSession, search, place("gridsearch_resultados"))


# Columns that a modelled row must have, and the reference's numbers
# (scaled over the whole table by ``prepare_cases``).
ESSENTIAL = ["sexo", "gravidade_lesao", "faixa_etaria_legal", "tipo_de_vitima"]
SCALED_BEFORE = ["idade_z", "ano_sinistro_z"]


def model_frame(prepared: DataFrame) -> DataFrame:
    """Rows to model: complete, and with an id of their own (an accident's id is
    shared by its victims), made from all columns of the de-duplicated table."""
    rows = ML.with_person_bands(prepared)
    for c in ESSENTIAL:
        rows = rows.filter(C.complete_and_known(c, NOT_AVAILABLE))
    return rows.withColumn(ML.ID, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).bitwiseAND((1 << 63) - 1))


def _class_report(report: DataFrame, summary: DataFrame, model: str) -> list[tuple[str, str]]:
    """(class or average, precision / recall / F1 / support) lines of one model."""
    rows = report.filter(F.col("modelo") == model).orderBy("classe").collect()
    s = summary.filter(F.col("modelo") == model).first()
    lines = [(r["classe"], f"{r['precision']:.2f} {r['recall']:.2f} {r['f1']:.2f} {r['support']}") for r in rows]
    return lines + [("accuracy", f"{s['accuracy']:.2f}"), ("macro avg", f"{s['precision_macro']:.2f} {s['recall_macro']:.2f} {s['f1_macro']:.2f}"),
                    ("weighted avg", f"{s['f1_weighted']:.2f}")]


def train_models(prepared: DataFrame, out_dir: str, trees: int = P.RF_TREES, depth: int = P.RF_DEPTH, grid: dict = P.REFERENCE_GRID,
                 fit_rows: int | None = None, test_fraction: float = P.TEST_FRACTION, seed: int = P.SEED,
                 preset: str = "before") -> dict[str, str]:
    """Stage 2 models on a prepared extract (``prepare_cases``): features, split,
    importances, the five compared forests, threshold rule, all result files and
    the saved models, published as one set. Returns name -> path."""
    spark = prepared.sparkSession
    rows = model_frame(prepared)
    features = ML.CaseFeatures(scaled=[], raw=[*[c for c in SCALED_BEFORE if c in rows.columns], *ML.RAW_NUMERIC]).fit(rows)
    data = features.transform(rows).select(ML.ID, ML.TARGET, "label", "features")
    data = cut_lineage(ML.spread(S.stratified_split(data, "label", [ML.ID], test_fraction, seed)))
    train, test = (data.filter(F.col("is_test") == flag).drop("is_test") for flag in (False, True))
    fitted = SE.fit_model_set(train, test, features.labels, trees, depth, grid, fit_rows, seed, preset)
    counts = cut_lineage(M.pair_counts(fitted.predictions, ML.TARGET, "predito", "modelo"))
    report = M.report_from_counts(counts, ML.TARGET, "predito", model_col="modelo")
    summary = cut_lineage(M.summary_from_counts(report, counts, ML.TARGET, "predito", model_col="modelo"))
    best = M.best_model(summary, "modelo", SE.CANDIDATES)

    base = ML.predict_named(fitted.models["Baseline"], test, features.labels)
    ruled = ML.threshold_decision(base, "probability", features.labels, P.THRESHOLD_RULE_REFERENCE, P.THRESHOLD_DEFAULT_REFERENCE)
    threshold = M.per_class_report(ruled, ML.TARGET, "predito_limiar")
    plain = ML.random_forest(trees, depth, weight_col=None, seed=seed).fit(ML.spread(train))
    importance = ML.importances(plain, features.slots, spark)

    out = ResultSet(spark, out_dir)
    for name, model in fitted.models.items():
        model.write().save(out.path(f"modelo_{name.lower()}"))
    features.save(out.path("variaveis"))
    confusion = counts.groupBy("modelo", ML.TARGET).agg(*[
        F.sum(F.when(F.col("predito") == c, F.col("n")).otherwise(0)).alias(f"pred_{c.lower()}") for c in features.labels])
    search = [("melhores_parametros", str(fitted.search.best)), ("melhor_score", f"{fitted.search.accuracy:.3f}"),
              *_class_report(report, summary, "GridSearch+SMOTE")]
    write_results(out_dir, summary, report.filter("modelo = 'Baseline'").drop("modelo"), confusion, search, threshold, out)
    X.write_metric_table(importance.orderBy(F.col("importancia").desc(), "variavel"), out.path("importancia_features"))
    total = data.agg(F.count(F.lit(1)).alias("registros_modelo"))
    run = best.select(F.col("modelo").alias("melhor_modelo"), "f1_macro").withColumn("variaveis", F.lit(len(features.slots)))
    X.write_metric_table(run.withColumn("registros_modelo", F.lit(total.first()[0])), out.path("resumo"))
    out.publish()
    return published(spark, out_dir)
