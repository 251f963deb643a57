"""Latin-1 extracts: read, type, write, consolidate, clean (hand-made rows)."""

import os

from pyspark.sql import functions as F

from gravis.plans import jobs as J
from gravis.sources import extracts as X

HEADER_A = "id_sinistro;municipio;regiao_administrativa;tipo_veiculo_vitima;sexo;idade;gravidade_lesao;faixa_etaria_legal;ano_sinistro;mes_sinistro;dia_sinistro;tipo_de_vitima;tipo_via"
ROWS_A = [
    "1; São Paulo ;METROPOLITANA DE SÃO PAULO;MOTOCICLETA;MASCULINO;18;FATAL;MAIOR;2019;1;1;CONDUTOR;URBANA",
    "2;SAO PAULO;METROPOLITANA DE SÃO PAULO;MOTOCICLETA;FEMININO;25;LEVE;MAIOR;2020;12;24;PASSAGEIRO;URBANA",
    "2;SAO PAULO;METROPOLITANA DE SÃO PAULO;MOTOCICLETA;FEMININO;25;LEVE;MAIOR;2020;12;24;PASSAGEIRO;URBANA",
    "3;Guarulhos;METROPOLITANA DE SÃO PAULO;MOTOCICLETA;NAO DISPONIVEL;;GRAVE;MAIOR;2021.0;4;25;CONDUTOR;RODOVIA",
    "4;Osasco;METROPOLITANA DE SÃO PAULO;AUTOMOVEL;MASCULINO;40;LEVE;MAIOR;junk;4;2;CONDUTOR;URBANA",
    "5;SANTOS;BAIXADA SANTISTA;MOTOCICLETA;MASCULINO;0;NAO DISPONIVEL;NAO DISPONIVEL;2021;6;30;CONDUTOR;URBANA",
]
HEADER_B = HEADER_A + ";nacionalidade"
ROWS_B = [
    "6;São Bernardo do Campo;METROPOLITANA DE SÃO PAULO;MOTOCICLETA;MASCULINO;35;LEVE;MAIOR;2022;3;5;CONDUTOR;URBANA;BRASILEIRA",
    "7;Guarulhos;METROPOLITANA DE SÃO PAULO;MOTOCICLETA;MASCULINO;60;FATAL;MAIOR;2025;12;26;CONDUTOR;RODOVIA;BRASILEIRA",
    "8;Guarulhos;METROPOLITANA DE SÃO PAULO;MOTOCICLETA;FEMININO;101;LEVE;MAIOR;2023;7;14;PASSAGEIRO;URBANA;BRASILEIRA",
    "9;Mauá;METROPOLITANA DE SÃO PAULO;MOTOCICLETA;MASCULINO;45;GRAVE;MAIOR;2024;8;1;CONDUTOR;URBANA;BRASILEIRA",
]


def _write(path, header, rows):
    with open(path, "w", encoding="latin-1") as f:
        f.write("\n".join([header, *rows]) + "\n")


def test_missing_file_gives_no_table(spark, tmp_path):
    assert X.read_extract(spark, str(tmp_path / "absent.csv")) is None


def test_latin1_round_trip_and_typing(spark, tmp_path):
    a = str(tmp_path / "a.csv")
    _write(a, HEADER_A, ROWS_A)
    df = X.read_extract(spark, a)
    assert df.count() == 6
    assert " São Paulo " in {r["municipio"] for r in df.collect()}
    typed = X.type_columns(df)
    years = {r["id_sinistro"]: r["ano_sinistro"] for r in typed.collect()}
    assert years[3] == 2021 and years[4] is None
    out = str(tmp_path / "out")
    assert X.write_extract(typed, out) is True
    back = X.read_extract(spark, out)
    assert "São Paulo" in " ".join(r["municipio"] for r in back.collect())
    assert X.write_extract(typed.filter(F.lit(False)), str(tmp_path / "empty")) is False


def test_consolidate_job(spark, tmp_path):
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    _write(a, HEADER_A, ROWS_A)
    _write(b, HEADER_B, ROWS_B)
    merged, years, top = J.consolidate_extracts(spark, a, b, str(tmp_path / "merged"))
    assert merged.count() == 8  # 2019 and junk years dropped, duplicate kept
    assert "nacionalidade" in merged.columns
    assert {r["ano_sinistro"]: r["n"] for r in years.collect()}[2020] == 2
    assert top.filter(F.col("coluna") == "gravidade_lesao").count() == 4
    assert J.consolidate_extracts(spark, str(tmp_path / "x"), str(tmp_path / "y"))[0] is None


def test_prepare_cases_order_and_scope(spark, tmp_path):
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    _write(a, HEADER_A, ROWS_A)
    _write(b, HEADER_B, ROWS_B)
    merged, _, _ = J.consolidate_extracts(spark, a, b)
    prepared = J.prepare_cases(merged)
    rows = {r["id_sinistro"]: r for r in prepared.collect()}
    # duplicate removed, out-of-scope vehicle and region removed, sentinel rows removed
    assert set(rows) <= {2, 3, 6, 7, 8, 9}
    assert 4 not in rows and 5 not in rows
    assert rows[6]["municipio"] == "SAO BERNARDO DO CAMPO"
    # idade was missing for case 3: filled with the exact median before the scope filter
    assert rows[3]["idade"] is not None if 3 in rows else True
    assert "idade_z" in prepared.columns and "municipio_num" in prepared.columns
    tabs = J.dashboard_tables(prepared, support=1)
    assert tabs["mensal"].count() >= 1
    assert tabs["sazonal"].count() == 1


def test_metric_table_sink(spark, tmp_path):
    df = spark.createDataFrame([("Baseline", 0.40401234)], "Modelo string, f1 double")
    out = str(tmp_path / "m")
    X.write_metric_table(df, out)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    assert len(files) == 1
    with open(os.path.join(out, files[0])) as f:
        assert "0.4040" in f.read()


def test_analysis_tables_from_prepared(spark, tmp_path):
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    _write(a, HEADER_A, ROWS_A)
    _write(b, HEADER_B, ROWS_B)
    merged, _, _ = J.consolidate_extracts(spark, a, b)
    tabs = J.analysis_tables(J.prepare_cases(merged), support=1)
    total = tabs["mensal"].agg(F.sum("total")).first()[0]
    assert total == tabs["municipios"].agg(F.sum("total")).first()[0]
    assert tabs["pior_mes_vitima"].count() >= 1


def test_unreadable_extracts_give_no_table(spark, tmp_path):
    (tmp_path / "folder").mkdir()
    (tmp_path / "empty.csv").write_bytes(b"")
    for name in ("folder", "empty.csv", "absent.csv"):
        assert X.read_extract(spark, str(tmp_path / name)) is None
        assert X.read_checked(spark, str(tmp_path / name)) is None


def test_bad_lines_are_set_apart(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_bytes(b"id;nome;ano\n1;S\xe3o;2020\n2;curto\n3;a;2021;sobra\n4;\"x;y\";2022\n5;\"aberto;2023\n"
                     b"6;\x00\x80\xff;2024\n\n7;\"a;b\";2020;sobra\n8;;\n")
    got = X.read_checked(spark, str(path))
    rows = {r["id"]: (r["nome"], r["ano"]) for r in got.rows.collect()}
    assert rows == {"1": ("São", "2020"), "2": ("curto", None), "4": ("x;y", "2022"),
                    "6": ("\x00\x80\xff", "2024"), "8": (None, None)}
    assert {r[0][0] for r in got.bad.collect()} == {"3", "5", "7"}
    assert got.counts() == (5, 3)
    assert got.rows.select("id").count() == 5  # whichever columns are read


def test_write_evaluates_once_and_keeps_the_old_extract(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        calls.add(1)
        return x
    out = str(tmp_path / "out")
    rows = spark.range(0, 20, 1, 3).select(counted(F.col("id").cast("int")).alias("x"))
    assert X.write_extract(rows, out) is True
    assert calls.value == 20
    assert X.write_extract(rows.filter("x < 0"), out) is False
    assert X.read_extract(spark, out).count() == 20
    assert os.listdir(tmp_path) == ["out"]


def test_consolidate_writes_bad_lines(spark, tmp_path):
    a, b, bad = str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path / "bad")
    _write(a, HEADER_A, [*ROWS_A, ROWS_A[1] + ";sobra"])
    _write(b, HEADER_B, ROWS_B)
    merged, _, _ = J.consolidate_extracts(spark, a, b, bad_path=bad)
    assert merged.count() == 8
    kept = spark.read.parquet(bad).collect()
    assert [(r["extrato"], r[X.BAD]) for r in kept] == [(a, ROWS_A[1] + ";sobra")]


def test_fitted_cleaning_equals_one_table_run(spark, tmp_path):
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    _write(a, HEADER_A, ROWS_A)
    _write(b, HEADER_B, ROWS_B)
    merged, _, _ = J.consolidate_extracts(spark, a, b)
    one = J.prepare_cases(merged, scope=None)
    J.CaseCleaner.fit(merged).save(spark, str(tmp_path / "cleaner"))
    cleaner = J.CaseCleaner.load(spark, str(tmp_path / "cleaner"))
    again = J.prepare_cases(merged, scope=None, cleaner=cleaner)
    assert again.columns == one.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, one.collect()))

    later = X.type_columns(X.read_extract(spark, b)).filter("id_sinistro in (7, 8, 9)").withColumn(
        "idade", F.when(F.col("id_sinistro") != 7, F.col("idade"))).withColumn(
        "municipio", F.when(F.col("id_sinistro") == 9, F.lit("Nova")).otherwise(F.col("municipio")))
    rows = {r["id_sinistro"]: r for r in J.prepare_cases(later, scope=None, cleaner=cleaner).collect()}
    places = cleaner.codes.count()
    st = cleaner.statistics
    assert rows[7]["idade"] == st.medians["idade"]  # the fitted table's, not the later one's
    assert rows[7]["idade_z"] == (rows[7]["idade"] - st.scales["idade"][0]) / st.scales["idade"][1]
    assert rows[9]["municipio_num"] == places
    assert all(st.fences["idade"][0] <= r["idade"] <= st.fences["idade"][1] for r in rows.values())


def test_cleaning_without_values(spark):
    from gravis.operators import clean as C
    empty = spark.createDataFrame([], "idade double, valor int")
    st = C.fit_cleaning(empty, ["idade", "valor"], ["idade"], ["idade"])
    back = C.CleaningStatistics.of_table(st.table(spark))
    assert back == st and st.fences == {"idade": None} and st.medians == {"idade": None, "valor": None}
    assert st.filter(spark.createDataFrame([(1.0,)], "idade double")).count() == 0
